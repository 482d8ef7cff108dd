"""What a session has shown before it is used or claimed: an inverted index of tokens instead of substring searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Paths, dotted names, names with underscores or digits inside, and numbers of four digits or more.
TOKENS = r"(?:[\w.-]*/)+[\w.-]+|\b\w+(?:[._]\w+)+\b|\b[A-Za-z]+\d\w*\b|\b\d{4,}\b"


def tokens(rows: DataFrame, by: list[str], order: str, text: Column, pattern: str = TOKENS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, order, keep, token): the distinct tokens of each row."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return rows.select(*by, order, *keep, F.explode(found).alias("token"))


def first_use(shown: DataFrame, used: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, token, shown, used, before): the first rows that show and that use each used token; before: it is used before, or without, being shown."""
    least = lambda df, name: df.groupBy(*by, "token").agg(F.min(order).alias(name))
    both = least(used, "used").join(least(shown, "shown"), [*by, "token"], "left")
    before = F.col("shown").isNull() | (F.col("shown") > F.col("used"))
    return both.select(*by, "token", "shown", "used", before.alias("before"))


def support(found: DataFrame, by: list[str], order: str, kind: str, claims: str, sources: tuple[str, ...]) -> DataFrame:
    """Claimed tokens (rows whose kind is claims) with a flag for each source: has an earlier row of that kind shown the token?"""
    past = Window.partitionBy(*by, "token").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    flag = lambda s: F.coalesce(F.max(F.when(F.col(kind) == s, 1)).over(past), F.lit(0)) == 1
    seen = found.withColumns({f"in_{s}": flag(s) for s in sources})
    return seen.where(F.col(kind) == claims).select(*by, order, "token", *[f"in_{s}" for s in sources])
