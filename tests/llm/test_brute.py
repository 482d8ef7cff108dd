"""The queries that SQL can't say, and the pipeline, against plain Python versions of what they do."""

import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import mixing, packing, quality, queries, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
M = 2**64 - 1


@pytest.fixture(scope="module")
def tables(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return docs, spark.read.parquet(f"{SF}/labels.parquet").collect()


def plain_sample(docs, labels, label, folds, out):
    own = {}
    for r in labels:
        if r.doc_id is not None and r[label] in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % folds != out:
            own[r.doc_id] = max(own.get(r.doc_id, 0), r[label])
    ids = sorted(i for i in own if i in docs)
    return [docs[i].text or "" for i in ids], [own[i] for i in ids], sum(own.values()) / len(own)


def mix(h, kind):
    h = ((h ^ h >> 31) * 0x9E3779B97F4A7C15 + kind) & M
    return h ^ h >> 29


def plain_grams(text):
    words = [w.lower() for w in text.split()]
    h = lambda x: sum((ord(c) + 1) * pow(0x100000001B3, k % 64 + 1, 2**64) for k, c in enumerate(x)) & M
    s = [h(quality.shape(w)) for w in text.split()]
    out = {mix(h(w), 11) for w in words}
    for k in range(len(s)):
        one = mix(s[k], 12)
        out.add(one)
        if k + 1 < len(s):
            two = mix((one * 0x100000001B3 + s[k + 1]) & M, 13)
            out.add(two)
            if k + 2 < len(s):
                out.add(mix((two * 0x100000001B3 + s[k + 2]) & M, 14))
    again = sum(a == b for a, b in zip(words, words[1:]))
    out |= {quality.SIZE + min(4, int(math.log10(len(words) + 1) * 2) // 2)} | ({quality.AGAIN} if again else set()) | ({quality.MOSTLY} if 2 * again > len(words) else set())
    return out


def plain_quality(model, text):
    weight, square = dict(zip(model.grams.tolist(), model.weight)), dict(zip(model.grams.tolist(), model.square))
    own = [g for g in plain_grams(text) if g in weight]
    margin = sum(weight[g] for g in own) / (math.sqrt(sum(square[g] for g in own)) or 1.0) + model.offset
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, model.slope * margin + model.shift))))


def plain_toxicity(model, text):
    words = toxicity.tokens(text)
    pull = (model.vectors.astype(float) @ (model.out[:, 1] - model.out[:, 0])) / toxicity.BAG
    value = {w: float(np.mean(pull[toxicity.subwords([w])[0]])) for w in set(words)}
    odds = max((sum(value[w] for w in words[a:b]) for a, b in toxicity.bags(len(words))), default=0.0) + model.base[1] - model.base[0]
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, model.slope * odds + model.shift))))


@pytest.fixture(scope="module")
def scores(tables):
    docs, labels = tables
    q, t = quality.fit(*plain_sample(docs, labels, "quality", 5, 0)), toxicity.fit(*plain_sample(docs, labels, "toxic", 4, 2))
    return {i: (plain_quality(q, r.text or ""), plain_toxicity(t, r.text or "")) for i, r in docs.items()}


def test_classifiers_are_brute_force(spark, scores):
    for k, name in enumerate(("op5_quality", "op1_toxicity")):
        got = {r.doc_id: r.score for r in queries.queries()[name](spark, SF).collect()}
        assert got.keys() == scores.keys() and max(abs(got[i] - s[k]) for i, s in scores.items()) < 1e-4


def laguerre(votes, seats):
    """Seats by highest quotients, one at a time, ties to the first."""
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def plain_mix(spark, rows, seed=11, group=32, least=256):
    """(id, taken) by walking every block of every source; only the seeded hashes come from Spark."""
    df = spark.createDataFrame([(r.doc_id, r.source, r.text) for r in rows], "id long, source string, text string")
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey")
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    hashed = df.select("id", key, F.xxhash64("id", tie, F.lit(0).cast("long"), F.lit(seed)).alias("h"), "text").collect()
    sources = sorted({r.skey for r in hashed}, key=lambda s: (s == "", s.encode()))
    size = {id(r): len((r.text or "").split()) for r in hashed}
    words = {s: sum(size[id(r)] for r in hashed if r.skey == s) for s in sources}
    weight, open_, left, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}, set(sources), 1.5 * sum(words.values()), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * words[s]}
        target |= {s: 2.0 * words[s] if over else share[s] for s in over or open_}
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    n = {s: max(1, math.floor(words[s] / 32 + 0.5)) if words[s] else 0 for s in sources}
    votes = [target[s] * n[s] / words[s] if words[s] else 0.0 for s in sources]
    blocks = dict(zip(sources, laguerre(votes, round(sum(votes)))))
    taken = {}
    for s in sources:
        line = sorted((r for r in hashed if r.skey == s), key=lambda r: ((r.h >> 20) % 1024, r.h, r.id))
        shards = max(1, min(1024, n[s] // least))
        ends = [g * n[s] // shards for g in range(shards + 1)]
        sizes = [b - a for a, b in itertools.pairwise(ends)]
        teams = [sizes[k : k + group] for k in range(0, shards, group)]
        won = [w for team, seats in zip(teams, laguerre(list(map(sum, teams)), min(blocks[s], 2 * n[s]))) for w in laguerre(team, min(seats, 2 * sum(team)))]
        times = [0] * n[s]
        for g in range(shards if n[s] else 0):
            m = ends[g + 1] - ends[g]
            at = spark.range(1).select(F.pmod(F.xxhash64(F.lit(s), F.lit(g).cast("long"), F.lit(seed)), F.lit(m))).first()[0]
            for k in range(min(won[g], 2 * m)):
                times[ends[g] + (at + k % m) % m if k >= m * (won[g] // m) else ends[g] + k % m] += 1
        edge = [b * words[s] // n[s] for b in range(n[s] + 1)] if n[s] else [0]
        place = 0
        for r in line:
            a, b = place, place + size[id(r)]
            taken[r.id] = sum(t * max(0, min(b, edge[k + 1]) - max(a, edge[k])) for k, t in enumerate(times))
            place = b
    return taken


def test_mixing_is_brute_force(spark, tables):
    docs, _ = tables
    got = {r.doc_id: r.taken for r in queries.op3_mixing(spark, SF).collect()}
    assert got == plain_mix(spark, list(docs.values()))


def test_mixing_of_many_shards_is_brute_force(spark, tables, monkeypatch):
    docs, _ = tables
    monkeypatch.setattr(mixing, "MIN_BLOCKS", 8)
    monkeypatch.setattr(mixing, "GROUP", 5)
    got = {r.doc_id: r.taken for r in queries.op3_mixing(spark, SF).collect()}
    assert got == plain_mix(spark, list(docs.values()), group=5, least=8)


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_pipeline_is_brute_force(spark, tables, scores, tmp_path):
    """Each stage on what the plain version of the one before keeps."""
    docs, _ = tables
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    stage = lambda name, df: [r for r in stages[name](spark, df, SF).collect()]
    good = {i for i in docs if scores[i][0] >= quality.THRESHOLD}
    assert {r.doc_id for r in stage("quality", frame)} == good
    clean = {i for i in good if scores[i][1] < toxicity.THRESHOLD}
    assert {r.doc_id for r in stage("toxicity", frame.where(F.col("doc_id").isin(*good)))} == clean
    sets = {i: shingles(docs[i].text) for i in sorted(clean)}
    up = {i: i for i in sets}
    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] | sets[j])
        if not both or len(sets[i] & sets[j]) / both >= 0.8:
            a, b = up[i], up[j]
            up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
    single = {i for i, v in up.items() if i == v}
    assert {r.doc_id for r in stage("near duplicates", frame.where(F.col("doc_id").isin(*clean)))} == single
    own = frame.where(F.col("doc_id").isin(*single))
    mixed = stage("mixing", own)
    count = lambda t: len((t or "").split())
    words = {i: sum(count(r.text) for r in mixed if r.doc_id == i) for i in single}
    want = {r.doc_id: r.taken for r in mixing.mix(own).select(F.col("id").alias("doc_id"), "taken").collect()}
    assert sum(words.values()) == sum(want.values()) and all(words[i] <= 2 * count(docs[i].text) for i in single)
    for r in mixed:
        assert " ".join(r.text.split()) in " ".join(docs[r.doc_id].text.split()) and r.n_chars == len(r.text)
    packed = stage("packing", spark.createDataFrame(mixed, frame.schema))
    assert sorted((r.doc_id, r.text) for r in packed) == sorted((r.doc_id, r.text) for r in mixed)
    lengths = sorted(count(r.text) for r in mixed)
    before, least = [0, *itertools.accumulate(lengths)], [0] + [float("inf")] * len(lengths)
    for _ in range(packing.BUCKETS):
        least = [0] + [min(least[i] + lengths[j - 1] * (j - i) - (before[j] - before[i]) for i in range(j)) for j in range(1, len(lengths) + 1)]
    assert sum(r.padded - r.length for r in packed) == least[-1]
