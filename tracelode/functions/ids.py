"""Identifier families and the times embedded in them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values: (family, pattern), first match wins; the alphabet of base 58; the window of plausible times in ms.
FAMILIES = (
    ("anthropic_req", r"^req_(?:vrtx_|bdrk_)?01[1-9A-HJ-NP-Za-km-z]{22}$"),
    ("anthropic_msg", r"^msg_(?:vrtx_|bdrk_)?01[1-9A-HJ-NP-Za-km-z]{22}$"),
    ("openai_resp_hex50", r"^resp_[0-9a-f]{50}$"),
    ("gemini_response_id_b64", r"^[A-Za-z0-9_-]{16,24}$"),
    ("chatcmpl_operator", r"^chatcmpl-"),
    ("uuid", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("synthetic", r"^synthetic:"),
)
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
WINDOW = (1704067200000, 1798761600000)


def id_family(value: Column) -> Column:
    return F.when(value.isNotNull(), F.coalesce(*[F.when(value.rlike(p), n) for n, p in FAMILIES], F.lit("other")))


def base58_ms(value: str) -> float | None:
    """Milliseconds in the top 48 of 128 bits, if the layout is that of a version 7 UUID."""
    x = 0
    for ch in value.rsplit("_", 1)[1][2:]:
        x = x * 58 + BASE58.index(ch)
    return float(x >> 80) if x >> 76 & 15 == 7 and x >> 62 & 3 == 2 else None


@F.pandas_udf(T.DoubleType())
def _base58(values: pd.Series) -> pd.Series:
    known: dict = {}
    return pd.Series([None if v is None else known.setdefault(v, base58_ms(v)) for v in values], dtype="float64")


def embedded_ms(value: Column) -> Column:
    """The time in an id as milliseconds, or null. Only the 128-bit family leaves the JVM."""
    family = id_family(value)
    number = lambda hexed: F.conv(hexed, 16, 10).cast("double")
    raw = F.hex(F.try_to_binary(F.rpad(F.translate(value, "-_", "+/"), 24, "="), F.lit("base64")))
    little = F.concat(F.substring(raw, 7, 2), F.substring(raw, 5, 2), F.substring(raw, 3, 2), F.substring(raw, 1, 2))
    t = (
        F.when(family.isin("anthropic_req", "anthropic_msg"), _base58(F.when(family.isin("anthropic_req", "anthropic_msg"), value)))
        .when((family == "openai_resp_hex50") & (F.substring(value, 22, 2) == "00"), number(F.substring(value, 24, 8)) * 1000)
        .when(family == "gemini_response_id_b64", number(little) * 1000)
        .when((family == "uuid") & (F.substring(value, 15, 1) == "7"), number(F.substring(F.replace(value, F.lit("-"), F.lit("")), 1, 12)))
    )
    return F.when(t.between(WINDOW[0], WINDOW[1] - 1), t)


def positional_entropy(rows, value: str):
    """(pos, bits, symbols) of each character position over all values."""
    chars = rows.select(F.posexplode(F.split(value, "")).alias("pos", "ch")).where("ch <> ''")
    n = chars.groupBy("pos", "ch").agg(F.count("*").alias("n"))
    total = F.sum("n")
    return n.groupBy("pos").agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("bits"), F.count("*").alias("symbols"))
