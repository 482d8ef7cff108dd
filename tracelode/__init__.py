"""Session-log analytics on Spark: event tables, joins, checks, statistics and streams as DataFrame plans."""
