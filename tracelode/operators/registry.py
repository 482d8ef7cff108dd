"""Checks as plans: registered once, gated by what a session can show, validated, and completed to a row per call and check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import REASON_PREFIX, STRENGTHS, VERDICTS
from . import pairing, scoring

KINDS = ("identity", "statistical", "reference")


@dataclass(frozen=True)
class Check:
    """name, version, kind and strength; the capabilities that a session needs; and a plan from events to (session_id, call_key, verdict, reason, confidence, localized, evidence)."""

    name: str
    version: str
    kind: str
    strength: str
    requires: tuple[str, ...]
    plan: Callable[[DataFrame], DataFrame]


class Checks:
    def __init__(self):
        self.known: dict[str, Check] = {}

    def register(self, check: Check) -> Check:
        if not check.name or check.name in self.known:
            raise ValueError(f"check {check.name!r} has no name or is registered already")
        if check.kind not in KINDS or check.strength not in STRENGTHS or not check.version:
            raise ValueError(f"check {check.name!r}: kind, strength or version is unknown")
        self.known[check.name] = check
        return check

    def run(self, events: DataFrame, names: list[str] | None = None) -> DataFrame:
        """A row for every call and check, sorted out as: not capable, decided, or `abstain:not_decided`.

        Sessions without a check's capabilities are filtered before its plan, which so never sees them.
        """
        chosen = [self.known[n] for n in sorted(names or self.known)]
        calls = pairing.call_keys(events).select("session_id", "call_key")
        able = pairing.capabilities(events)
        out = None
        for c in chosen:
            fit = able.where(F.size(F.array_except(F.array(*map(F.lit, c.requires)).cast("array<string>"), "capabilities")) == 0).select("session_id", F.lit(True).alias("_able"))
            said = c.plan(events.join(fit.select("session_id"), "session_id", "left_semi"))
            said = said.select("session_id", "call_key", "verdict", "reason", "confidence", "localized", "evidence", F.lit(c.name).alias("check"))
            rows = scoring.gap_filled(calls, said, [c.name], ["session_id", "call_key"]).join(fit, "session_id", "left")
            unable = F.col("_able").isNull()
            rows = rows.withColumns({"verdict": F.when(unable, "unconstrained").otherwise(F.col("verdict")), "reason": F.when(unable, "missing:capability").otherwise(F.col("reason"))}).drop("_able")
            rows = rows.withColumns({"kind": F.lit(c.kind), "strength": F.lit(c.strength), "check_version": F.lit(c.version)})
            out = rows if out is None else out.unionByName(rows)
        return out


def broken_contracts(rows: DataFrame) -> DataFrame:
    """One row of counts: unknown verdicts, reasons whose prefix says another verdict, confidences outside 0 to 1, supports or contradictions without a reason."""
    prefix = F.split(F.col("reason"), ":")[0]
    means = F.create_map(*[x for k, v in REASON_PREFIX.items() for x in (F.lit(k), F.lit(v))])
    return rows.agg(F.count_if(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))).alias("bad_verdict"), F.count_if(~F.coalesce(F.try_element_at(means, prefix) == F.col("verdict"), F.lit(False))).alias("bad_reason"), F.count_if(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True))).alias("bad_confidence"))
