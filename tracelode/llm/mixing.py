"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, nth_copy, running, word_count, wrapped, written

#: Words of a block; a source's blocks are equal to within one word.
BLOCK_WORDS = 32
#: Shards of a source; each holds at least MIN_BLOCKS of its blocks.
SHARDS, MIN_BLOCKS = 1024, 256
#: Shards that share a quota first, so that a source with many shards is no hot group when these are ranked.
GROUP = 32
#: Hash ranges that a source's documents are laid out by.
BUCKETS = 1024
#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, and each target at most, as multiples of sizes.
SHARE, MOST = 1.5, 2


def sainte_lague(parties: DataFrame, by: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Adds `won` to parties: the seats of each group (column seats) by highest quotients votes / (2t - 1), ties to the smaller key.

    With n parties and N seats the winning divisor gives each party votes within n / 2N of
    its share of N, so seats below that range are certain and only the about 3n quotients
    inside it are listed and ranked. Groups are windows, for groups of bounded size; without
    `by` all parties are one group of any size, ranked in two levels.
    """
    most = F.col(seats)
    if by:
        group = Window.partitionBy(*by)
        total, n = F.sum(votes).over(group), F.count("*").over(group)
    else:
        total, n = map(F.lit, parties.agg(F.coalesce(F.sum(votes), F.lit(0.0)), F.count("*")).first())
    ranged = parties.withColumns({"total": total, "n": n})
    spread = F.when(most > 0, F.col("n") / (2 * most)).otherwise(0.0)
    ranged = ranged.withColumn("share", F.when(F.col("total") > 0, F.col(votes) * most / F.col("total")).otherwise(0.0))
    ranged = ranged.withColumn("sure", F.greatest(F.lit(0), F.ceil(F.col("share") * (1 - spread) - 0.5) - 1).cast("long"))
    ranged = ranged.withColumn("last", F.when(F.col("share") > 0, F.floor(F.col("share") * (1 + spread) + 0.5) + 1).otherwise(0).cast("long"))
    sure = F.sum("sure").over(group) if by else F.lit(ranged.agg(F.coalesce(F.sum("sure"), F.lit(0))).first()[0])
    ranged = ranged.withColumn("open", most - sure)
    quotient = F.explode(F.when(F.col("last") > F.col("sure"), F.sequence(F.col("sure") + 1, F.col("last"))).otherwise(F.array().cast("array<bigint>")))
    listed = ranged.select(*by, key, "share", "open", quotient.alias("t"))
    order = [F.desc(F.col("share") / (2 * F.col("t") - 1)), F.asc(key), F.asc("t")]
    if by:
        ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    else:
        ranked = running(listed, [-(F.col("share") / (2 * F.col("t") - 1)), F.col(key), F.col("t")], name="rank")
    more = ranked.where("rank < open").groupBy(*by, key).agg(F.count("*").alias("more"))
    won = ranged.join(more, [*by, key], "left").withColumn("won", F.col("sure") + F.coalesce("more", F.lit(0)))
    return won.select(*parties.columns, "won")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(skey, words) with `no`, in code point order, and `target`: shares by weight of share * all words, none above most * its words.

    Filling by weight level is where resharing the excess ends: in order of cap per
    weight, sources are full up to the first whose cap lies above the level that the
    rest would then have. Both orders are made in two levels, for any number of sources.
    """
    placed = running(sizes, [F.col("skey") == "", F.col("skey")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).cast("double")
    placed = placed.select("skey", "words", F.col("no").alias("place"), weight.alias("weight"), (F.col("words") * F.lit(float(most))).alias("cap"))
    per = running(placed.withColumn("full", F.col("cap") / F.col("weight")), [F.col("full"), F.col("place")], ["cap", "weight"])
    words, all_weight = per.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (F.lit(float(words) * share) - F.col("cap_before")) / (F.lit(all_weight) - F.col("weight_before"))
    first = per.withColumn("level", level).where("full > level").agg(F.min(F.struct("full", "place", "level")).alias("x")).first()
    at = F.col("cap") if first is None or first.x is None else F.least("cap", F.lit(first.x.level) * F.col("weight"))
    return per.select("skey", F.col("place").alias("no"), "words", at.alias("target"))


def _edge(block: Column, words: Column, n: Column) -> Column:
    """First word of a block: floor(block * words / n), exact beyond a long's range."""
    return F.call_function("div", block.cast("decimal(19,0)") * words.cast("decimal(19,0)"), n.cast("decimal(19,0)"))


def plan(sized: DataFrame, seed: int = 11, block_words: int = BLOCK_WORDS, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """sized(row, id, source, size, tie) rows with source_size, target and `pieces`: array of (from, to, times) word ranges that the mix takes.

    row is a monotonically increasing id of written rows, tie a hash of what tells rows of one id apart. A
    source's rows lie on a line of words in seeded hash order; two-level prefix sums
    place them, so no task holds a source. The line is cut into equal blocks and those
    into shards. Blocks go to sources, to a source's teams of GROUP shards, then to shards, by Sainte-Laguë; a shard that
    wins all its blocks once or more takes them whole so often, and the rest as a run
    that starts at a seeded block and wraps around. No block is taken more than twice. Copies of a row are
    numbered and so spread over the line; which of them is which number changes nothing.
    """
    skey = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    h = F.xxhash64("id", "tie", "copy", F.lit(seed))
    told = nth_copy(sized.withColumn("skey", skey), ["skey", "id", "tie"], "row").withColumn("h", h)
    laid = written(told.select("row", "id", "source", "size", "skey", "h", "copy", "tie", F.pmod(F.shiftright("h", 20), F.lit(buckets)).cast("int").alias("hb")), "sized")
    held = written(laid.groupBy("skey", "hb").agg(F.sum("size").alias("bw")), "buckets")
    per = targets(written(held.groupBy("skey").agg(F.sum("bw").alias("words")), "sources"))
    n = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block_words))).otherwise(0).cast("long")
    per = per.withColumn("blocks", n).withColumn("votes", F.when(F.col("words") > 0, F.col("target") * F.col("blocks") / F.col("words")).otherwise(0.0))
    per = written(per, "targets")
    seats = round(per.agg(F.coalesce(F.sum("votes"), F.lit(0.0))).first()[0])
    per = sainte_lague(per.withColumn("seats", F.lit(seats).cast("long")), [], "no", "votes", "seats").withColumn("won", F.least("won", MOST * F.col("blocks")))
    per = per.withColumn("s", F.greatest(F.lit(1), F.least(F.lit(shards), F.expr(f"blocks div {MIN_BLOCKS}"))).cast("long"))
    per = written(per.select("skey", "words", "target", F.col("blocks").alias("n"), "s", "won"), "quotas")

    cut = per.where("n > 0").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    cut = cut.withColumns({"b0": F.expr("g * n div s"), "b1": F.expr("(g + 1) * n div s")})
    cut = cut.select("skey", "words", F.col("n").alias("parts"), "g", "b0", "b1", F.col("won").alias("seats"), (F.col("b1") - F.col("b0")).cast("double").alias("m"))
    cut = cut.withColumn("team", F.expr(f"g div {GROUP}"))
    teams = cut.groupBy("skey", "team").agg(F.sum("m").alias("m"), F.max("seats").alias("seats"))
    teams = sainte_lague(teams, ["skey"], "team", "m", "seats").select("skey", "team", F.least("won", (MOST * F.col("m")).cast("long")).alias("seats"))
    cut = cut.drop("seats").join(teams, ["skey", "team"])
    cut = sainte_lague(cut, ["skey", "team"], "g", "m", "seats").withColumn("blocks", F.col("b1") - F.col("b0"))
    cut = cut.withColumn("won", F.least("won", MOST * F.col("blocks"))).withColumns({"times": F.expr("won div blocks"), "run": F.expr("won % blocks"), "at": F.pmod(F.xxhash64("skey", "g", F.lit(seed)), F.col("blocks"))})
    edge = lambda b: _edge(b, F.col("words"), F.col("parts"))
    end = F.col("at") + F.col("run")
    cut = cut.select("skey", "g", "times", edge(F.col("b0")).alias("w0"), edge(F.col("b1")).alias("w1"), edge(F.col("b0") + F.col("at")).alias("r0"), edge(F.col("b0") + F.least(end, "blocks")).alias("r1"), edge(F.col("b0") + F.greatest(F.lit(0), end - F.col("blocks"))).alias("r2"))

    offset = F.coalesce(F.sum("bw").over(Window.partitionBy("skey").orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = held.withColumn("offset", offset).join(per.select("skey", "words", "target", "s"), "skey").select("skey", "hb", "offset", "words", "target", "s")
    inside = Window.partitionBy("skey", "hb").orderBy("h", "id", "tie", "copy")
    placed = laid.join(base, ["skey", "hb"]).withColumn("end", F.col("offset") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    # a shard begins at or before its even share of the line, less than a shard's length before
    met = F.when(F.col("size") > 0, F.sequence(F.expr("start * s div words"), F.least(F.col("s") - 1, F.expr("(end - 1) * s div words") + 1)))
    spread = placed.withColumn("g", F.explode_outer(met)).join(cut, ["skey", "g"], "left")
    part = lambda a, b, times: F.struct((F.greatest(a, F.col("start")) - F.col("start")).alias("from"), (F.least(b, F.col("end")) - F.col("start")).alias("to"), times.cast("long").alias("times"))
    parts = F.filter(F.array(part(F.col("w0"), F.col("w1"), F.col("times")), part(F.col("r0"), F.col("r1"), F.lit(1)), part(F.col("w0"), F.col("r2"), F.lit(1))), lambda p: (p["to"] > p["from"]) & (p["times"] > 0))
    gathered = spread.withColumn("parts", F.when(F.col("w0").isNotNull(), parts)).groupBy("row", "id", "source", "size", F.col("words").alias("source_size"), "target").agg(F.flatten(F.collect_list("parts")).alias("pieces"))
    return gathered.select("row", "id", "source", "size", "source_size", "target", F.array_sort("pieces").alias("pieces"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row; see plan.

    A null text has no words, a row without words takes none, a null source is a source
    of its own, null ids and repeated rows are rows like others, and other columns, whatever their
    names, take no part. Reruns agree.
    """
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + (p["to"] - p["from"]) * p["times"])
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    return plan(sized, **how).select("id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str = "n_chars", **how) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a text, or a run of its words, is taken.

    White space between the words of a run is kept; chars_col, if present, is counted anew. Rows
    that the mix passes over give none; nulls, empty texts and repeated rows as in mix. Rows of one id are told apart by
    all columns but maps and variants. docs are written once with a row id; texts move once, to meet their pieces.
    """
    cols, kinds = docs.columns, dict(docs.dtypes)
    plain = [F.col("`" + c.replace("`", "``") + "`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    text = F.col(text_col)
    held = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(*plain).alias("tie"), wrapped(docs, "all"))
    held = written(held, "documents")
    got = plan(held.select("row", "id", "source", "size", "tie"), **how).where(F.size("pieces") > 0).select("row", "pieces")
    pieces = F.flatten(F.transform("pieces", lambda p: F.array_repeat(p, p["times"].cast("int"))))
    each = held.select("row", "size", "all").join(got, "row").withColumn("piece", F.explode(pieces)).withColumn("text", F.col("all")[text_col])
    begin, n = F.col("piece.from"), F.col("piece.to") - F.col("piece.from")
    lead = F.when(begin == 0, F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)).otherwise("")
    words = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    run = F.concat(lead, F.array_join(F.slice(words, (begin + 1).cast("int"), n.cast("int")), ""))
    each = each.withColumn("text", F.when(n == F.col("size"), F.col("text")).otherwise(run))
    changed = {text_col: F.col("text")} | ({chars_col: F.length("text").cast(kinds[chars_col])} if chars_col in cols else {})
    return each.select(*[changed.get(c, F.col("all")[c]).alias(c) for c in cols])
