"""The battery of seeded perturbations of event logs: names with parameters, plans by hashes, and copies made by one join.

A plan names one target in one session; donors (texts, pairs, ids of other sessions) are drawn by numbering each pool in hash
order and taking a hashed place in it, so that no pairs of targets and donors are listed. Copies are rows: the session's events
once for each plan, changed by conditional columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 20261005
#: Shifts in seconds, those of late responses, numbers of pairs rewritten, relative tolerance of matched sizes: fixed values.
SHIFTS, LATE_SHIFTS, REWRITES, MATCHED = ("0.5", "1", "2", "5", "10", "30", "60", "300"), ("5", "30", "300"), ("2", "5"), 20
# Names of perturbations with their parameters and the fields that each touches.
ATTACKS = {
    "time_result_early": (SHIFTS, ("ts",)),
    "time_result_late": (SHIFTS, ("ts", "order")),
    "time_tail_late": (SHIFTS, ("ts",)),
    "time_tail_early": (SHIFTS, ("ts",)),
    "time_response_early": (SHIFTS, ("ts",)),
    "time_response_late": (LATE_SHIFTS, ("ts", "order")),
    "id_swap_adjacent": (("-",), ("request_id",)),
    "id_splice_foreign": (("random", "nearest"), ("request_id",)),
    "sub_single_flip_error": (("-",), ("text", "error")),
    "sub_single_digit": (("-",), ("text",)),
    "sub_matched_bytes": (("any", "samecmd"), ("text", "error")),
    "rewrite_consistent_k": (REWRITES, ("text", "error", "ts")),
    "reorder_adjacent_pairs": (("-",), ("text", "args", "error", "order")),
    "reorder_lines": (("-",), ("text",)),
    "delete_pair": (("-",), ("text", "args", "events", "ts")),
    "delete_response": (("-",), ("text", "args", "events", "request_id", "ts")),
    "insert_pair_consistent": (("-",), ("text", "args", "events", "ts")),
    "insert_pair_squeezed": (("-",), ("text", "args", "events", "ts")),
    "inline_fabrication": (("tau",), ("usage",)),
    "image_relabel_gui": (("-",), ("tool",)),
    # listed, but without a rule for its target: never planned
    "image_insert_screenshot": ((), ("tool", "events")),
}
#: Tokens per character that fabricated text is taken to cost.
TAU = 0.4
EXECUTION = ("sub_single_flip_error", "sub_single_digit", "sub_matched_bytes", "rewrite_consistent_k", "reorder_lines", "inline_fabrication")

_PLAN = ("target", "call_seq", "call_id", "until", "other", "text", "error", "gap", "latency", "request_id", "tool", "args", "command", "shifts", "texts")


def attack_class(name: str) -> str:
    """exec: what an executed call seems to have done changes; edit: the record does."""
    return "exec" if name in EXECUTION else "edit"


def pairs(events: DataFrame) -> DataFrame:
    """(session_id, call_id, call_seq, seq, tool, args, command, text, error, ts, latency, size): calls with one call and one later result, by stamps in seconds."""
    own = events.where(F.col("kind").isin("call", "result") & F.col("call_id").isNotNull())
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    of = lambda on, c: F.max(F.when(on, F.col(c)))
    g = own.groupBy("session_id", "call_id").agg(
        F.count_if(call).alias("c"), F.count_if(result).alias("r"), of(call, "seq").alias("call_seq"), of(result, "seq").alias("seq"),
        of(call, "tool").alias("tool"), of(call, "args").alias("args"), of(call, "command").alias("command"),
        of(result, "text").alias("text"), of(result, "native_error").alias("error"), of(call, "ts").alias("called"), of(result, "ts").alias("ts"),
    )
    g = g.where("c = 1 and r = 1 and call_seq < seq").drop("c", "r")
    return g.withColumns({"latency": seconds(F.col("ts")) - seconds(F.col("called")), "size": F.octet_length("text")})


def seconds(ts: Column) -> Column:
    """A stamp as seconds since 1970, with its fraction."""
    return F.unix_micros(F.try_to_timestamp(ts)) / 1e6


def shifted(ts: Column, by: Column) -> Column:
    """An ISO stamp moved by seconds, in UTC with milliseconds; other stamps stay."""
    moved = F.timestamp_micros((F.unix_micros(F.try_to_timestamp(ts)) + F.round(by * 1e6)).cast("long"))
    return F.coalesce(F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")), ts)


def _donated(targets: DataFrame, pool: DataFrame, on: list[str], seed: int) -> DataFrame:
    """targets with donor, a struct of a pool row with equal keys and another session: a hashed place in the pool's hash order, or the next place whose session differs."""
    w = Window.partitionBy(*on)
    order = w.orderBy(F.xxhash64("session_id", "call_id", F.lit(seed)), "session_id", "call_id")
    p = pool.withColumns({"place_": F.row_number().over(order) - 1, "donor": F.struct(*pool.columns)})
    # the next row of another session, for a target that meets one of its own
    turn = F.when(F.lead("session_id").over(order) != F.col("session_id"), F.lead("donor").over(order))
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    p = p.withColumn("next_", F.first(turn, ignorenulls=True).over(ahead))
    p = p.withColumn("first_", F.first("donor").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sizes = pool.groupBy(*on).agg(F.count("*").alias("n_"))
    t = targets.join(sizes, on).withColumn("place_", F.pmod(F.xxhash64("session_id", "call_id", "attack", "param", "seed"), F.col("n_")).cast("int"))
    met = t.join(p.select(*on, "place_", "donor", "next_", "first_"), [*on, "place_"])
    other = lambda c: F.when(F.col(f"{c}.session_id") != F.col("session_id"), F.col(c))
    chosen = F.coalesce(other("donor"), other("next_"), other("first_"))
    return met.withColumn("donor", chosen).where("donor is not null").drop("n_", "place_", "next_", "first_")


def _one(targets: DataFrame, sessions: int) -> DataFrame:
    """One target a session and cell, in so many sessions a cell, by seeded hashes."""
    draw = F.xxhash64("session_id", "target", "attack", "param", "seed")
    per = Window.partitionBy("attack", "param", "seed", "session_id").orderBy(draw, "target")
    cell = Window.partitionBy("attack", "param", "seed").orderBy(F.xxhash64("session_id", "attack", "param", "seed"), "session_id")
    one = targets.withColumn("n_", F.row_number().over(per)).where("n_ = 1")
    return one.withColumn("n_", F.row_number().over(cell)).where(F.col("n_") <= sessions).drop("n_")


def _cells(df: DataFrame, name: str, seeds: tuple[int, ...]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p in ATTACKS[name][0] for s in seeds])
    return df.withColumn("c_", F.explode(cells)).withColumns({"attack": F.lit(name), "param": F.col("c_.p"), "seed": F.col("c_.s")}).drop("c_")


def targets(events: DataFrame, name: str, seeds: tuple[int, ...] = (1,), sessions: int = 500, tau: float = TAU) -> DataFrame:
    """Plans of one perturbation: (attack, param, seed, session_id, target, ...) with what its change needs.

    Targets: results with a stamp (time_result, time_tail), first events of responses (time_response, ids), pairs with
    what the change needs: digits, three lines with unlike neighbours, donors of the same tool and the other outcome, or
    of a size within a twentieth and, for samecmd, the same command.
    """
    p = pairs(events)
    calls = Window.partitionBy("session_id").orderBy("call_seq")
    answered = events.where("request_id is not null").groupBy("session_id", "request_id").agg(F.min("seq").alias("target"), F.min_by("ts", "seq").alias("ts"), F.max("usage_out").alias("usage_out"))
    response = Window.partitionBy("session_id").orderBy("target")
    plain = p.withColumn("target", F.col("seq"))
    if name in ("time_result_early", "time_result_late", "time_tail_early", "time_tail_late"):
        out = _cells(plain.where("ts is not null and latency is not null"), name, seeds)
        out = out.withColumn("shift", F.col("param").cast("double") * (-1 if name.endswith("early") else 1))
    elif name in ("time_response_early", "time_response_late"):
        out = _cells(answered.where("ts is not null"), name, seeds)
        out = out.withColumn("shift", F.col("param").cast("double") * (-1 if name.endswith("early") else 1))
    elif name == "id_swap_adjacent":
        out = _cells(answered.withColumn("other", F.lead("request_id").over(response)).where("other is not null"), name, seeds)
    elif name == "id_splice_foreign":
        out = _cells(answered.withColumns({"call_id": F.col("request_id"), "key_": F.lit(0)}), name, seeds)
        pool = answered.select("session_id", F.col("request_id").alias("call_id"), "ts", F.lit(0).alias("key_"), F.pmod(F.xxhash64("session_id", "request_id"), F.lit(64)).alias("shard_"))
        # shards keep the pool's order out of one task; the nearest in time is sought among the stamps of a day
        near = _nearest_ids(out.where("param = 'nearest'"), answered)
        drawn = _donated(out.where("param = 'random'").withColumn("shard_", F.pmod(F.xxhash64("session_id", "target", "seed"), F.lit(64))), pool, ["key_", "shard_"], SEED)
        out = drawn.withColumn("other", F.col("donor.call_id")).drop("donor", "shard_").unionByName(near, allowMissingColumns=True)
    elif name == "sub_single_digit":
        out = _cells(plain.where(F.col("text").rlike(r"\d")), name, seeds)
    elif name == "reorder_lines":
        lines = F.split("text", "\n")
        unlike = F.filter(F.transform(lines, lambda x, i: F.when((i + 1 < F.size(lines)) & (x != F.get(lines, i + 1)), i)), lambda i: i.isNotNull())
        out = _cells(plain.withColumn("swaps", unlike).where((F.size(lines) >= 3) & (F.size("swaps") > 0)), name, seeds)
        out = out.withColumn("swap", F.get("swaps", F.pmod(F.xxhash64("session_id", "target", "seed"), F.size("swaps")).cast("int")))
    elif name == "sub_single_flip_error":
        known = plain.where("error is not null and text is not null")
        pool = known.withColumn("flip_", ~F.col("error")).select("session_id", "call_id", "tool", "flip_", "text", "error")
        out = _cells(known.withColumn("flip_", F.col("error")), name, seeds)
        out = _donated(out, pool, ["tool", "flip_"], SEED)
    elif name == "sub_matched_bytes":
        out = _cells(plain.where("text is not null"), name, seeds)
        out = out.withColumn("same_", F.when(F.col("param") == "samecmd", F.coalesce("command", F.lit(""))).otherwise("*")).where("same_ <> ''")
        pool = plain.where("text is not null").select("session_id", "call_id", "tool", "text", "error", "size", F.explode(F.array(F.lit("*"), F.coalesce("command", F.lit("")))).alias("same_")).where("same_ <> ''")
        out = _matched(out, pool)
    elif name == "rewrite_consistent_k":
        out = _cells(plain.where("latency > 0 and text is not null"), name, seeds)
        pool = plain.where("latency > 0 and text is not null").select("session_id", "call_id", "tool", "text", "latency")
        out = _donated(out, pool, ["tool"], SEED)
        k = F.col("param").cast("int")
        later = Window.partitionBy("attack", "param", "seed", "session_id").orderBy("call_seq")
        change = F.struct("seq", F.col("donor.text").alias("text"), (F.col("donor.latency") - F.col("latency")).alias("shift"))
        out = out.withColumn("changes", F.collect_list(change).over(later.rowsBetween(0, max(map(int, REWRITES)) - 1)))
        out = out.withColumn("changes", F.slice("changes", F.lit(1), k)).where(F.size("changes") == k)
    elif name == "reorder_adjacent_pairs":
        nxt = F.lead(F.struct("call_id", "tool", "args", "command", "text", "error")).over(calls)
        own = F.struct("call_id", "tool", "args", "command", "text", "error")
        out = _cells(plain.withColumns({"next": nxt, "own": own}).where("next is not null"), name, seeds)
    elif name in ("insert_pair_consistent", "insert_pair_squeezed"):
        after = Window.partitionBy("session_id").orderBy("seq")
        out = _cells(plain.where("ts is not null"), name, seeds)
        nxt = events.select("session_id", "seq", F.lead("ts").over(after).alias("next_ts"))
        out = out.join(nxt, ["session_id", "seq"]).withColumn("room", seconds(F.col("next_ts")) - seconds(F.col("ts")))
        if name.endswith("squeezed"):
            out = out.where("room >= 0.002")
        pool = plain.where("latency > 0").select("session_id", "call_id", "tool", "args", "command", "text", "error", "latency")
        out = _donated(out, pool, ["tool"], SEED)
    elif name == "delete_pair":
        out = _cells(plain, name, seeds)
    elif name == "delete_response":
        out = _cells(answered, name, seeds)
    elif name == "inline_fabrication":
        per = events.where("kind = 'call' and request_id is not null").groupBy("session_id", "request_id").agg(F.max_by("call_id", "seq").alias("call_id"))
        out = answered.where("usage_out is not null").join(per, ["session_id", "request_id"]).join(p.select("session_id", "call_id", "text"), ["session_id", "call_id"])
        out = _cells(out.withColumn("add", F.round(tau * F.length("text")).cast("long")), name, seeds)
    elif name == "image_relabel_gui":
        out = _cells(p.where("tool = 'gui'").withColumn("target", F.col("call_seq")), name, seeds)
    else:
        raise ValueError(f"{name} has no rule for its target")
    return _one(out, sessions).withColumn("plan_id", F.concat_ws("/", "attack", "param", "seed", "session_id", "target"))


def _matched(out: DataFrame, pool: DataFrame) -> DataFrame:
    """Donors of another session with a size within a twentieth, the nearest first, ties by hash."""
    from .joins import donors

    left = out.withColumn("id_", F.struct("attack", "param", "seed", "session_id", "call_id"))
    right = pool.select("session_id", "call_id", "tool", "same_", "size")
    found = donors(left.select("id_", "session_id", "call_id", "tool", "same_", "size"), right, ["tool", "same_"], "session_id", "call_id", "size", SEED, MATCHED)
    texts = pool.select("session_id", "call_id", "same_", F.struct("text", "error").alias("donor")).alias("d")
    f = found.alias("f")
    met = f.join(texts, (F.col("f.r_session_id") == F.col("d.session_id")) & (F.col("f.r_call_id") == F.col("d.call_id")) & (F.col("f.same_") == F.col("d.same_")))
    return left.join(met.select("f.id_", "d.donor"), "id_").drop("id_")


def _nearest_ids(out: DataFrame, answered: DataFrame) -> DataFrame:
    """Request ids of another session whose first stamp is next to the target's, among responses of the same day."""
    day = F.to_date(F.try_to_timestamp("ts"))
    at = lambda c: seconds(F.col(c)) * 1e6
    from .joins import donors

    left = out.where("ts is not null").withColumns({"day_": day, "at_": at("ts").cast("long")})
    right = answered.where("ts is not null").select("session_id", F.col("request_id").alias("call_id"), day.alias("day_"), at("ts").cast("long").alias("at_"))
    found = donors(left, right, ["day_"], "session_id", "call_id", "at_", SEED, 1)
    return found.withColumn("other", F.col("r_call_id")).drop("day_", "at_", "r_session_id", "r_call_id", "r_at_")


def apply(events: DataFrame, plans: DataFrame, name: str) -> DataFrame:
    """The events of each plan's session, changed, with plan_id and seq from 0: plans of one perturbation, as targets makes them."""
    cols = events.columns
    p = plans.select("plan_id", "session_id", F.struct(*[c for c in plans.columns if c not in ("plan_id", "session_id")]).alias("p"))
    e = events.join(p, "session_id")
    seq, kind, at = F.col("seq"), F.col("kind"), F.col("p.target")
    has = set(plans.columns)
    here, result_here = seq == at, (kind == "result") & (seq == at)
    own_call = lambda c: F.coalesce(F.col("call_id") == F.col(c), F.lit(False))
    same_request = F.coalesce(F.col("request_id") == F.col("p.request_id"), F.lit(False)) if "request_id" in has else F.lit(False)
    change: dict[str, Column] = {}
    if name.startswith("time_tail"):
        change["ts"] = F.when(seq >= at, shifted(F.col("ts"), F.col("p.shift"))).otherwise(F.col("ts"))
    elif name.startswith("time_"):
        moved = shifted(F.col("ts"), F.col("p.shift"))
        if name == "time_result_early":  # never before its call
            floor = shifted(F.col("p.called"), F.lit(0.001))
            moved = F.when(seconds(moved) <= seconds(F.col("p.called")), floor).otherwise(moved)
        change["ts"] = F.when(here, moved).otherwise(F.col("ts"))
    elif name == "id_swap_adjacent":
        other = F.coalesce(F.col("request_id") == F.col("p.other"), F.lit(False))
        change["request_id"] = F.when(same_request, F.col("p.other")).when(other, F.col("p.request_id")).otherwise(F.col("request_id"))
    elif name == "id_splice_foreign":
        change["request_id"] = F.when(same_request, F.col("p.other")).otherwise(F.col("request_id"))
    elif name in ("sub_single_flip_error", "sub_matched_bytes"):
        change["text"] = F.when(result_here, F.col("p.donor.text")).otherwise(F.col("text"))
        change["native_error"] = F.when(result_here, F.coalesce("p.donor.error", "native_error")).otherwise(F.col("native_error"))
        change["stderr"] = F.when(result_here, F.lit(None)).otherwise(F.col("stderr"))
    elif name == "sub_single_digit":
        head, last, tail = (F.regexp_extract("text", r"(?s)^(.*)(\d)(\D*)$", k) for k in (1, 2, 3))
        flipped = F.concat(head, ((last.cast("int") + 1) % 10).cast("string"), tail)
        change["text"] = F.when(result_here, flipped).otherwise(F.col("text"))
    elif name == "reorder_lines":
        lines, i = F.split("text", "\n"), F.col("p.swap")
        swapped = F.transform(lines, lambda x, k: F.when(k == i, F.get(lines, i + 1)).when(k == i + 1, F.get(lines, i)).otherwise(x))
        change["text"] = F.when(result_here, F.array_join(swapped, "\n")).otherwise(F.col("text"))
    elif name == "rewrite_consistent_k":
        mine = F.filter("p.changes", lambda c: c["seq"] == seq)
        before = F.aggregate(F.filter("p.changes", lambda c: c["seq"] <= seq), F.lit(0.0), lambda acc, c: acc + c["shift"])
        change["text"] = F.coalesce(F.get(mine, F.lit(0))["text"], F.col("text"))
        change["ts"] = F.when(before != 0, shifted(F.col("ts"), before)).otherwise(F.col("ts"))
    elif name == "reorder_adjacent_pairs":
        first, second = own_call("p.call_id"), own_call("p.next.call_id")
        swap = lambda c, k, f: F.when((kind == k) & first, F.col(f"p.next.{f}")).when((kind == k) & second, F.col(f"p.own.{f}")).otherwise(F.col(c))
        change |= {"tool": swap("tool", "call", "tool"), "args": swap("args", "call", "args"), "command": swap("command", "call", "command")}
        change |= {"text": swap("text", "result", "text"), "native_error": swap("native_error", "result", "error")}
    elif name == "delete_pair":
        parent = F.coalesce(F.col("parent_call_id") == F.col("p.call_id"), F.lit(False))
        e = e.where(~(own_call("p.call_id") | parent))
    elif name == "delete_response":
        e = e.where(~same_request)
    elif name in ("insert_pair_consistent", "insert_pair_squeezed"):
        e = _inserted(e, cols, name)
    elif name == "inline_fabrication":
        change["usage_out"] = F.when(same_request & F.col("usage_out").isNotNull(), F.col("usage_out") + F.col("p.add")).otherwise(F.col("usage_out")).cast(dict(events.dtypes)["usage_out"])
    elif name == "image_relabel_gui":
        change["tool"] = F.when(here, F.lit("shell")).otherwise(F.col("tool"))
        change["tool_raw"] = F.when(here, F.lit("bash")).otherwise(F.col("tool_raw"))
    changed = e.select("plan_id", *[change.get(c, F.col(c)).alias(c) for c in cols])
    order = Window.partitionBy("plan_id").orderBy("seq")
    return changed.withColumn("seq", (F.row_number().over(order) - 1).cast(dict(events.dtypes)["seq"]))


def _inserted(e: DataFrame, cols: list[str], name: str) -> DataFrame:
    """e with the donor's call and result behind the target; later stamps move by both steps, or the pair lies inside the gap that is there."""
    here = F.col("seq") == F.col("p.target")
    step = F.lit(1.0) if name.endswith("consistent") else F.lit(0.25) * F.col("p.room")
    whole = step + F.col("p.donor.latency") if name.endswith("consistent") else F.lit(0.75) * F.col("p.room")
    new_id = F.concat(F.lit("inserted:"), F.col("p.donor.call_id"))
    base = {"call_id": new_id, "tool": F.col("p.donor.tool")}
    none = ("request_id", "api_msg_id", "uuid", "parent_uuid", "usage_in", "usage_out")
    call = base | {"kind": F.lit("call"), "args": F.col("p.donor.args"), "command": F.col("p.donor.command"), "text": F.lit(None), "ts": shifted(F.col("ts"), step)}
    result = base | {"kind": F.lit("result"), "text": F.col("p.donor.text"), "native_error": F.col("p.donor.error"), "args": F.lit(None), "command": F.lit(None), "ts": shifted(F.col("ts"), whole)}
    kinds = dict(e.dtypes)
    at = e.where(here)
    rows = lambda new, place: at.select("plan_id", "p", *[(F.lit(None) if c in none else new.get(c, F.col(c))).cast(kinds[c]).alias(c) for c in cols if c != "seq"], (F.col("seq") + place).alias("seq"))
    if name.endswith("consistent"):
        e = e.withColumn("ts", F.when(F.col("seq") > F.col("p.target"), shifted(F.col("ts"), whole)).otherwise(F.col("ts")))
    whole_rows = e.select("plan_id", "p", *[c for c in cols if c != "seq"], F.col("seq").cast("double").alias("seq"))
    return whole_rows.unionByName(rows(call, 0.25)).unionByName(rows(result, 0.5))


def footprint(events: DataFrame, copies: DataFrame) -> DataFrame:
    """(plan_id, changed, added, removed): how many events of a copy differ from its session's in any field but seq, by whole rows."""
    cols = [c for c in events.columns if c != "seq"]
    mark = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols])
    held = events.groupBy("session_id").agg(F.count("*").alias("n"))
    own = events.select("session_id", mark.alias("h")).groupBy("session_id", "h").agg(F.count("*").alias("a"))
    got = copies.select("plan_id", "session_id", mark.alias("h")).groupBy("plan_id", "session_id", "h").agg(F.count("*").alias("b"))
    met = got.join(own, ["session_id", "h"], "left").groupBy("plan_id", "session_id").agg(F.sum(F.least("b", F.coalesce("a", F.lit(0)))).alias("same"), F.sum("b").alias("m"))
    out = met.join(held, "session_id")
    gone, new = F.col("n") - F.col("same"), F.col("m") - F.col("same")
    return out.select("plan_id", F.least(gone, new).alias("changed"), F.greatest(F.lit(0), new - gone).alias("added"), F.greatest(F.lit(0), gone - new).alias("removed"))
