"""The training-data operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelode.llm import chat, learn, media, mixing, packing, quality, queries, simhash, tokens, topk, toxicity, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, fp long, _id long, row long, id string, tie string, copy int, mark long, root long, all string, piece int, class long, key int, score double, nth int"
LONG = "word " * 50_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeats, and columns whose names the operators use inside."""
    rows = [(1, "a b c d", "en", "s1", 7, 1, "x", 1), (1, "a b c d", "en", "s1", 7, 1, "x", 1), (2, "", None, "s2", 0, None, None, None), (3, None, None, None, None, None, None, None), (None, "a b c d", "en", "s1", 7, 1, "x", 1), (4, LONG, "en", "s1", len(LONG), 1, "x", 1), (5, " \n\t ", "en", "s3", 4, 1, "x", 1), (6, "a b c e", "en", None, 7, 1, "x", 1)]
    return spark.createDataFrame([(*r, 1, 2, "i", "t", 3, 4, 5, "a", 6, 7, 8, 0.5, 9) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- 10 --------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fps, radius):
    ids = list(fps)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_simhash_query_is_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()}
    want = components(fps, 2)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("limit", [2, 8, 1024])
def test_large_blocks_lose_no_link(spark, limit):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(60)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.roots(simhash.linked(df, 2, limit))
    root = {r.node % 2**64: r.root for r in links.collect()}
    want = components({f: f for f in fps}, 2)
    groups = lambda of: {frozenset(k for k in fps if of(k) == v) for v in {of(k) for k in fps}}
    assert groups(lambda f: root.get(f, f)) == groups(lambda f: want[f])


def test_simhash_odd_rows(odd, none):
    got = [(r.id, r.fp, r.component) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == 8 and sum(c == 1 for _, _, c in got) >= 3
    assert {i for i, f, c in got if f == 0} == {2, 3, 5} and {c for i, f, c in got if f == 0} == {2}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id in (1, 2, 3, 5)) == [1, 2]
    assert simhash.keep_one(none).count() == 0


def test_pivots_discard_only_far_pairs():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**64, 300, np.uint64, endpoint=False)
    fps[150:] = fps[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    table = simhash.distances(fps)
    i, j = np.triu_indices(300, 1)
    a, b = simhash.survivors(fps, i, j, table, 2)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= 2
    assert set(zip(a, b)) == set(zip(i[near], j[near])) and len(a) >= 150


# --- 2 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1416, 1417, 1418, 9000])
def test_media_round_trip(n):
    raw = random.Random(n).choices(b"TAG ID3 APETAGEX Xing\xff\xfb\0", k=n)
    payload = media.padded(bytes(raw))
    back, s = media.unpack(media.pack(payload))
    assert back == payload and s.failed == 0 and s.junk == 0 and s.checked == len(s.offsets) + 1
    assert len(payload) % 64 == 0 and len(payload) > 0 and s.table[1] == len(s.offsets)
    assert s.duration == sum(1 for _ in s.offsets) * 1152 / 32000 or abs(float(s.duration) - len(s.offsets) * 0.036) < 1e-9


def test_media_resynchronises_and_checks():
    m = media.pack(media.padded(b"x" * 5000))
    whole = media.parse(m)
    s = media.parse(b"\xff\xe0junk\xff" + m + b"TAG" + b"Title".ljust(125, b"\0"))
    assert len(s.offsets) == len(whole.offsets) and s.junk > 0 and s.tags["TIT2"] == "Title" and s.duration == whole.duration
    bad = bytearray(m)
    bad[whole.offsets[1] + 8] ^= 1
    assert media.parse(bytes(bad)).failed == 1
    assert len(media.parse(m[:-10]).offsets) == len(whole.offsets) - 1
    assert media.parse(b"").offsets == [] and media.parse(b"\xff" * 100).offsets == []


def test_media_query(spark, odd, none):
    got = {r.doc_id: r for r in queries.op2_media(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    rows = media.text_media(odd).collect()
    assert len(rows) == 8 and {r.payload_bytes for r in rows if r.id in (2, 3)} == {64}
    assert media.text_media(none).count() == 0


# --- 3 ---------------------------------------------------------------------------------------


def test_mixing_query(spark):
    rows = queries.op3_mixing(spark, SF).collect()
    again = queries.op3_mixing(spark, SF).collect()
    assert sorted(rows) == sorted(again)
    src = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    names = sorted({s for s in src.values()}, key=lambda s: (s is None, (s or "").encode()))
    size, weight = {s: sum(r.size for r in rows if src[r.doc_id] == s) for s in names}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    open_, left, target = set(names), 1.5 * sum(size.values()), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        for s in over or open_:
            target[s] = 2.0 * size[s] if over else share[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for s in names:
        own = [r for r in rows if src[r.doc_id] == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] and 0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 32


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(5)
    for case in range(4):
        votes = [rng.choice([0, 1, 5, 50, 500]) * rng.random() for _ in range(rng.randrange(1, 12))]
        votes[0] += 0.5
        seats = rng.randrange(0, 60)
        df = spark.createDataFrame([(0, k, float(v), seats) for k, v in enumerate(votes)], "g int, key int, votes double, seats long")
        got = {r.key: r.won for r in mixing.sainte_lague(df, ["g"], "key", "votes", "seats").collect()}
        assert got == {r.key: r.won for r in mixing.sainte_lague(df, [], "key", "votes", "seats").collect()}
        best = sorted(((-v / (2 * t - 1), k, t) for k, v in enumerate(votes) if v > 0 for t in range(1, seats + 1)))[:seats]
        assert got == {k: sum(b[1] == k for b in best) for k in range(len(votes))}


def test_mixing_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 8 and all(r.taken <= 2 * r.size for r in rows) and mixing.mix(none).count() == 0
    out = mixing.mixed_rows(odd)
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert out.columns == odd.columns and words == sum(r.taken for r in rows) and mixing.mixed_rows(none).count() == 0


# --- 4 ---------------------------------------------------------------------------------------


def test_chat_links_orders_and_validates(spark):
    calls = spark.createDataFrame([("a", "x", "ask", '{"turn":1,"query":"q"}', ["y"], 1), ("a", "y", "ask", '{"query":"","turn":-1,"zz":1}', ["z"], 2), ("a", "z", "nope", "{bad", [], 3), ("a", "p", "ask", "[1]", ["q"], 4), ("a", "q", "ask", None, ["p"], 5), ("b", "x", "ask", '{"words":2,"turn":"1","query":"é\\n\\"q\\""}', ["none"], 1), ("b", "x", "ask", '{"turn":1,"query":"q"}', [], 2), (None, "x", "ask", "{}", None, 1)], "conv string, call_id string, name string, arguments string, after array<string>, at long")
    results = spark.createDataFrame([("a", "x", "r1", 9), ("a", "x", "r0", 8), ("b", "x", None, 3), (None, "x", "n", 1), ("c", "lost", "o", 1)], "conv string, call_id string, content string, at long")
    got = {(r.conv, r.call_id, r.status): r for r in chat.link(calls, results).collect()}
    assert [k[1] for k in sorted((k for k in got if k[0] == "a"), key=lambda k: got[k].position)][:3] == ["z", "y", "x"]
    assert got["a", "x", "linked"].content == "r0" and got["b", "x", "duplicate"].content is None
    assert got["a", "y", "missing"].errors == ["query:min_length", "turn:min", "zz:unknown"] and got["b", "x", "linked"].errors == ["turn:type"]
    assert got["b", "x", "linked"].json == '{"arguments":{"query":"é\\n\\"q\\"","turn":"1","words":2},"id":"x","name":"ask","result":null}'
    assert (None, "x", "missing") in got
    assert chat.link(calls.limit(0), results).count() == 0


def plain_levels(after):
    level = {}

    def of(u, path):
        if u in path:
            return None
        if u not in level:
            below = [of(v, path | {u}) for v in after[u] if v in after]
            level[u] = None if None in below else max((b + 1 for b in below), default=0)
        return level[u]

    # a call behind a cycle may be met first from inside it, so levels are found from every call anew
    out = {}
    for u in after:
        level.clear()
        out[u] = of(u, frozenset())
    return out


def test_levels_of_chains_graphs_and_cycles(spark):
    rng = random.Random(8)
    convs = {"chain": {f"c{k:02d}": [f"c{k - 1:02d}"] if k else [] for k in range(40)}, "cycle": {"a": ["b"], "b": ["c"], "c": ["a"], "d": ["a"], "e": ["d"], "f": [], "g": ["f", "e"]}, "self": {"a": ["a"], "b": []}, "pair": {"a": ["b", "x"], "b": ["a", "x"], "x": []}}
    for n in range(6):
        names = [f"n{k}" for k in range(12)]
        rng.shuffle(names)
        convs[f"g{n}"] = {u: sorted({rng.choice(names[:k]) for _ in range(rng.randrange(3))} | ({"gone"} if n == 2 else set())) if k else [] for k, u in enumerate(names)}
    df = spark.createDataFrame([(c, u, a) for c, g in convs.items() for u, a in g.items()], "conv string, call_id string, after array<string>")
    got = {(r.conv, r.call_id): r.level for r in chat.levels(df).collect()}
    assert got == {(c, u): lv for c, g in convs.items() for u, lv in plain_levels(g).items()}


def test_chat_query(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    said = {(r.conv_id, r.turn): r for r in turns}
    rows = queries.op4_chat(spark, SF).collect()
    assert len(rows) == sum(r.role == "user" for r in turns)
    for r in rows:
        turn = int(r.call_id.rsplit("-", 1)[1])
        answer = said.get((r.conv_id, turn + 1))
        assert r.status == ("linked" if answer is not None and answer.role == "assistant" else "missing")
        assert r.position == 1 + sum(x.role == "user" and x.turn < turn for x in turns if x.conv_id == r.conv_id)


# --- 1 and 5 ---------------------------------------------------------------------------------


def area(score, y):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def made(n, seed, bad):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["ta", "re", "mi", "so", "lu", "ne"], k=rng.randrange(1, 4)))
    texts, y = [], []
    for k in range(n):
        w = [word() for _ in range(rng.randrange(5, 200))]
        y.append(k % 3 == 0)
        texts.append(" ".join(bad(w, rng) if y[-1] else w))
    return texts, np.array(y, int)


def test_toxicity_generalises_to_unseen_spellings():
    bad = lambda w, rng: [*w[:3], "grosh" + rng.choice("abcdefghijk") * rng.randrange(1, 3), *w[3:], "zvrat" + rng.choice("aeiou"), "x"]
    texts, y = made(300, 1, bad)
    model = toxicity.fit(texts, y.tolist(), visits=30_000)
    unseen = lambda w, rng: [*w, "Groshqq,", "zvratux"]
    texts, y = made(120, 2, unseen)
    assert area(np.array(toxicity.Scorer(model)(texts)), y) > 0.97
    one = toxicity.fit(["a"], [0])
    assert 0 < toxicity.Scorer(one)(["", LONG])[0] < 0.5


def test_quality_and_dual_descent():
    junk = lambda w, rng: [x.upper() + "!!" for x in w]
    texts, y = made(300, 3, junk)
    model = quality.fit(texts, y.tolist())
    texts, y = made(120, 4, junk)
    score = np.array([model.score(t) for t in texts])
    assert area(score, y) > 0.99
    x = np.random.default_rng(0).normal(size=(40, 3))
    y = np.where(x[:, 0] + 0.2 * x[:, 1] > 0, 1.0, -1.0)
    w = quality.dual_descent([(np.arange(3), r) for r in x], y, np.ones(40), 3, rounds=500)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in np.random.default_rng(1).normal(scale=0.05, size=(200, 3)))


@pytest.mark.parametrize("name", ["op1_toxicity", "op5_quality"])
def test_classifier_queries(spark, name):
    rows = queries.queries()[name](spark, SF).collect()
    folds, out = (4, 2) if name == "op1_toxicity" else (5, 0)
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_classifiers_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (2, None, None), (None, 1, 1), (6, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    for m in (quality, toxicity):
        for d, n in ((odd, 8), (none, 0)):
            model = m.fit_tables(d, labels)
            assert d.select(m.score(model, F.col("text"), spark).alias("s")).where("s between 0 and 1").count() == n
        assert m.fit_tables(odd, labels.limit(0)) is not None


def test_samples_are_bounded(spark):
    """Rows of one id count once, bytes have a bound, and a text too long for it takes no other's place."""
    docs = spark.createDataFrame([(1, f"same {k:04d}") for k in range(5000)] + [(2, "x" * 300), (3, None), (4, "y" * 80), (5, "z" * 80), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k > 2)) for k in range(1, 6)] + [(1, 0, 0), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.id: r for r in learn.sample(docs, labels, "toxic", 1, 1, (3000, 3000), 128 * 100).collect()}
    assert set(rows) == {1, 3, 4, 5} and rows[1].text == "same 0000" and rows[3].text == "" and rows[1].usual == 4 / 6
    assert len(learn.sample(docs, labels, "toxic", 1, 1, (1, 2), 128 * 100).collect()) <= 3
    few = learn.sample(docs, labels, "toxic", 1, 1, (3000, 3000), 128 * 100 // 80).where("y = 1").collect()
    assert sum(len(r.text) for r in few) <= 80
    model = learn.fitted(learn.sample(docs, labels, "quality", 1, 1), quality.fit)
    assert 0 < model.score("a") < 1


def test_long_words_and_shapes_are_whole():
    words = toxicity.tokens("a " + "x" * 10_000 + " b")
    assert "".join(words) == "a" + "x" * 4096 + "x" * (10_000 - 8192) + "b"  # a word that repeats at once is taken once
    scorer = toxicity.Scorer(toxicity.fit(["a b", "bad worse"] * 5, [0, 1] * 5, visits=100))
    assert len(scorer(["é" * 300_000, "", "b"])) == 3
    assert quality.shape("aA0" * 30) == "aA0" * 30 and quality.shape("Hello!!World") == "Aa!Aa"
    text = "Ünï Köln² ÀB\u00a0x12 \u2003 -- é!! İst 𝒳y \x1c end\n"
    w, s = quality.hashes(text)
    assert len(w) == len(s) == len(text.split())
    each = [quality.hashes(x) for x in text.split()]
    assert w.tolist() == [a[0][0] for a in each] and s.tolist() == [a[1][0] for a in each]
    alike = [quality.hashes(quality.shape(x))[1][0] for x in text.split()]
    assert s.tolist() == alike and len(set(alike)) == len({quality.shape(x) for x in text.split()})
    long = "word " * 300_000 + "x" * 600_000 + " end"
    assert len(quality.hashes(long)[0]) == 300_002 and quality.hashes("")[0].size == 0


# --- 6 ---------------------------------------------------------------------------------------


def plain_top(rows, k):
    out = []
    for r, (q, v) in enumerate(rows):
        if q is None or v is None or q % 20:
            continue
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for s, (i, w) in enumerate(rows) if i is not None and w is not None and s != r and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [3, 10**7, 10**9])
def test_top_k_is_brute_force(spark, scale):
    rng = random.Random(scale)
    rows = [(i, [float(rng.randrange(-scale, scale)) for _ in range(5 if i % 7 else 3)]) for i in range(130)]
    rows += [(i, list(rows[3][1])) for i in range(200, 230)] + [(40, rows[40][1]), (41, rows[41][1]), (None, rows[1][1]), (500, None), (520, []), (521, []), (540, [])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row long, id long, vec array<double>")
    for shards in (1, 3, 20):
        got = topk.top_k(df.where("id % 20 = 0"), df, k=6, block=16, shards=shards)
        assert sorted(map(tuple, got.collect())) == plain_top(rows, 6)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df.where("id % 20 = 0"), df.limit(0)).count() == 0


def test_floored(spark):
    df = spark.createDataFrame([([0.5, -0.01],), ([float("nan")],), ([None, 1.0],), (None,), ([],), ([float("inf")],)], "e array<float>")
    assert [r[0] for r in df.select(topk.floored(F.col("e"))).collect()] == [[32.0, -1.0], None, None, None, [], None]


def test_top_k_query_with_clashing_columns(spark, tmp_path):
    rows = [(k, [float(k % 5), 1.0], "x", 7) for k in range(60)] + [(20, [1.0, None], "x", 7), (20, [0.5, 0.25], None, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, row int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op6_topk(spark, str(tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 4 * 20


# --- 7 ---------------------------------------------------------------------------------------


def test_token_counts(spark, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    count = lambda x: len(t.encode(x or "", add_special_tokens=False))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op7_tokens(spark, SF).collect():
        n = count(docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), n, n > 2048)
    strange = ["a<|endoftext|>b <|startoftext|>", "x\x1cy\x85z\xa0w ̸a é ΑΣ b", "don't 'LL we'Re", "İstanbul ǅ ﬁ", "a\x0b\x0cb", "<|endof text|>"]
    c = tokens.Counter(path, open(path, "rb").read())
    assert c.by_word and c([x.encode() for x in strange]) == [count(x) for x in strange]
    got = [(r.doc_id, r.n) for r in odd.select("doc_id", tokens.token_count(spark, F.col("text"), path).alias("n")).collect()]
    assert (2, 0) in got and (3, 0) in got and (4, 50_000) in got and len(got) == 8
    assert none.select(tokens.token_count(spark, F.col("text"), path)).count() == 0
    for other in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"):
        o = tokens.Counter(other, open(public.path(other), "rb").read())
        text = " ".join(x or "" for x in docs.values())
        assert o([text.encode()]) == o.lengths([text])


# --- 8 ---------------------------------------------------------------------------------------


def test_urls(spark):
    at = "A-Z.Net"
    pages = spark.createDataFrame([(1, f"http://{at}/x?y#z"), (2, "https://b.example.net/en/1"), (3, "no scheme"), (4, None), (None, "http://q.org/fr/?a"), (5, "http://net"), (6, "http://evil.test:80?p"), (7, "http://x.example.com/de/#"), (8, "http://ÄB.test/://")], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, False), (6, True), (None, True), (2, None), (6, False)], "id long, bad boolean")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, outcomes).collect()}
    assert got[1] == ("a-z.net", "/x", "net/", "block") and got[2] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None) and got[None][2:] == ("org/fr/", "allow")
    assert got[5][:3] == ("net", "", None) and got[6][:2] == ("evil.test:80", "") and got[7][2:] == ("example.com/de/", "block") and got[8][0] == "Äb.test"
    assert urls.judge(pages.limit(0), outcomes).count() == 0 and urls.judge(pages, outcomes.limit(0)).count() == 9


def test_reputation_shrinks(spark):
    rows = [(f"h{k}.good{k % 3}.test", 20, 0) for k in range(30)] + [("x.evil.test", 40, 40), ("y.evil.test", 30, 30), ("new.evil.test", 0, 0), ("one.good1.test", 1, 1)]
    got = {r.host: r for r in urls.reputation(spark.createDataFrame(rows, "host string, n long, bad long")).collect()}
    assert got["x.evil.test"].doubt < 0.05 and got["one.good1.test"].bad_rate < 0.5 < got["one.good1.test"].doubt
    assert got["h0.good0.test"].bad_rate < 0.1 < got["new.evil.test"].bad_rate


def test_beta_tail_is_exact(spark):
    cases = [(a, b) for a in (0.02, 0.5, 1.0, 3.7, 80.0, 5000.0) for b in (0.03, 1.0, 2.5, 60.0, 4000.0)]
    got = [r[0] for r in spark.createDataFrame(cases, "a double, b double").coalesce(1).select(urls.beta_below(0.5, F.col("a"), F.col("b"))).collect()]
    for (a, b), p in zip(cases, got):
        x = np.linspace(-60 / a - 5, 60 / b + 5, 4_000_001) if min(a, b) < 20 else np.linspace(np.log(a / b) - 3, np.log(a / b) + 3, 400_001)
        d = np.exp(a * x - (a + b) * np.logaddexp(0, x) - (a * np.log(a / (a + b)) + b * np.log(b / (a + b))))
        assert abs(p - d[x <= 0].sum() / d.sum()) < 1e-3, (a, b, p)


def test_suffix_tables_and_ties(spark):
    hosts = spark.createDataFrame([("a.b.co.uk", 1), ("x.y.zz.kk.test", 1), ("u@h.test:80", 1), ("", 1), ("uk", 1)], "host string, n long")
    table = spark.createDataFrame([("co.uk",), ("zz.kk.test",), ("uk",)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in urls.with_domains(hosts, table).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.y.zz.kk.test": ("y.zz.kk.test", "zz.kk.test"), "u@h.test:80": ("h.test", "test"), "": ("", ""), "uk": ("uk", "uk")}
    pages = spark.createDataFrame([(1, "http://a.test/x/" + "y" * 200_000, "h", 3, True)], "page_id long, url string, host string, id int, blocked boolean")
    r = urls.judge(pages, spark.createDataFrame([], "id long, bad boolean"), rules=(("allow", "test", "/x/y"), ("block", "a.test", "/"), ("block", "b.test", "/"))).first()
    assert (r.rule, r.verdict, len(r.path)) == ("test/x/y", "allow", 200_003)
    tied = (("allow", "a.test", "/"), ("block", "test", "/x/"))
    assert urls.judge(pages, spark.createDataFrame([], "id long, bad boolean"), rules=tied).first().verdict == "block"


# --- 9 ---------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 9)
        sizes, counts, k = sorted(rng.sample(range(40), n)), [rng.randrange(1, 9) for _ in range(n)], rng.randrange(1, 6)
        cost = lambda ends: sum(m * (min(e for e in ends if e >= x) - x) for x, m in zip(sizes, counts))
        best = min(cost([*c, sizes[-1]]) for c in itertools.combinations(sizes[:-1], min(k, n) - 1))
        ends = packing.boundaries(sizes, counts, k)
        assert len(ends) <= k and cost(ends) == best
    assert packing.boundaries([], [], 3) == []


def test_packing(spark, odd, none):
    rows = queries.op9_packing(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    batches = {}
    for r in rows:
        assert r.length <= r.padded
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), rs in batches.items():
        per = max(1, packing.BUDGET // max(1, rs[0].padded))
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and len(rs) <= per
        assert len(rs) == per or (bucket, batch + 1) not in batches
    got = packing.pack_texts(odd).collect()
    assert len(got) == 8 and max(r.length for r in got) == 50_000 and packing.pack_texts(none).count() == 0
    whole = packing.packed_rows(odd)
    assert sorted((r.doc_id or 0, r.text or "", r.length) for r in whole.collect()) == sorted((r.doc_id or 0, r.text or "", len((r.text or "").split())) for r in odd.collect())
    assert whole.columns == [*odd.columns, "length", "bucket", "padded", "batch", "slot"] and packing.packed_rows(none).count() == 0


def test_packing_pads_least(spark):
    """The query's padding is the least over all choices of ends, by a plain quadratic program over all lengths."""
    rows = queries.op9_packing(spark, SF).collect()
    lengths = sorted(len((r.text or "").split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(r.length for r in rows) == lengths
    up = [0, *itertools.accumulate(lengths)]
    least = [0] + [float("inf")] * len(lengths)
    for _ in range(packing.BUCKETS):
        least = [0] + [min(least[i] + lengths[j - 1] * (j - i) - (up[j] - up[i]) for i in range(j)) for j in range(1, len(lengths) + 1)]
    assert sum(r.padded - r.length for r in rows) == least[-1]


def test_copies_are_spread(spark):
    """Rows that are equal in all columns, a third of the table, lie in many hash ranges, and every copy has its place."""
    docs = spark.createDataFrame([(None, "a b c", None)] * 400 + [(k, f"w {k}", "s") for k in range(800)], "doc_id long, text string, source string").repartition(5)
    got = packing.pack_texts(docs).collect()
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == 1200
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 1200 and sum(r.id is None for r in mixed) == 400
    assert all(0 <= r.taken <= 2 * r.size for r in mixed) and len({r.taken for r in mixed if r.id is None}) > 1


@pytest.mark.parametrize("tile", [3, 4096])
def test_similar_groups_are_exact(spark, odd, none, tile):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    texts = [[word() for _ in range(rng.randrange(3, 250))] + passage * (k % 2) for k in range(40)]
    for k in range(60):
        w = list(texts[k % 40])
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(w)
    texts += [texts[0], texts[1], [], [" "]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    sets = [frozenset(" ".join(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) if t.split() else frozenset() for t in (" ".join(w) for w in texts)]
    up = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] | sets[j])
        if not both or len(sets[i] & sets[j]) / both >= 0.8:
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
    got = {r.doc_id for r in simhash.keep_one_similar(df, tile=tile).collect()}
    assert got == {i for i, r in enumerate(up) if i == r}
    assert simhash.keep_one_similar(odd).columns == odd.columns and simhash.keep_one_similar(none).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_one_similar(odd).collect() if r.doc_id in (1, 2, 3, 5)) == [1, 2]


@pytest.mark.parametrize("tile", [2, 5])
def test_large_blocks_of_sets_lose_no_link(spark, tile):
    """Chains of texts, each a little off the one before, that share most of their shingles with many others."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, shared = [], [word() for _ in range(80)]
    for k in range(3):
        w = shared[: 70 - k] + [word() for _ in range(30)]
        for _ in range(14):
            texts.append(list(w))
            w.insert(rng.randrange(len(w)), word())
    sets = [frozenset(" ".join(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    pairs = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    up = list(range(len(sets)))
    for i, j in sorted(pairs):
        a, b = up[i], up[j]
        up = [min(a, b) if x in (a, b) else x for x in up]
    assert len(pairs) > len(texts)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one_similar(df, tile=tile).collect()} == {i for i, r in enumerate(up) if i == r}


def test_pivot_rows_bound_set_distances():
    rng = np.random.default_rng(4)
    for n in (3, 50, 400, 5000):
        base = np.unique(rng.integers(0, 2**32, n, np.uint32))
        for gone in (0, 1, n // 10, n):
            other = np.unique(np.r_[base[gone:], rng.integers(0, 2**32, gone, np.uint32)])
            rows = [np.frombuffer(simhash.pivot_row(x), np.uint64) for x in (base, other)]
            apart, true = int(simhash.pivot_distance(*rows)), len(np.setxor1d(base, other))
            counts = [np.bincount(x >> 24, minlength=256) for x in (base, other)]
            assert apart <= np.abs(counts[0] - counts[1]).sum() <= true
            assert gone > 1 or apart == true


def test_similar_texts_with_repeats(spark):
    """Repeats leave the shingle sets alike, however far they move a fingerprint."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for k in range(0, 40, 2):
        w, line = [word() for _ in range(300)], [word() for _ in range(10)]
        rows += [(k, " ".join(w)), (k + 1, " ".join(w + line * 40))]
    far = [(simhash.fingerprint_bytes(a.encode(), 5) ^ simhash.fingerprint_bytes(b.encode(), 5)).bit_count() for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert max(far) > 22
    got = {r.doc_id for r in simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(0, 40, 2))


def test_long_similar_texts_are_exact(spark):
    """Pairs of 950 to 3000 shingles, a little above and below the threshold, are told apart on the whole sets."""
    rng = random.Random(6)
    rows, want = [], set()
    for k in range(0, 60, 2):
        n, near = rng.choice([950, 1500, 3000]), k % 4 == 0
        w = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        cut = int(n * (0.8025 if near else 0.7975))
        rows += [(k, " ".join(w)), (k + 1, " ".join(w[:cut]))]
        want |= {k} if near else {k, k + 1}
    got = {r.doc_id for r in simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_similar_texts_without_a_common_small_hash(spark):
    """Pairs of similarity 0.8 and more that share none of their four smallest shingle hashes still meet."""
    rng, rows = random.Random(7), []
    while len(rows) < 12:
        w = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        pair = [" ".join(w), " ".join(w[:84])]
        low = [set(np.frombuffer(simhash.shingle_set(t.encode())[-1], "<u4")[:4].tolist()) for t in pair]
        if not low[0] & low[1]:
            rows += [(len(rows) + k, t) for k, t in enumerate(pair)]
    got = {r.doc_id for r in simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(0, 12, 2))


def test_one_long_text_leaves_the_buckets_alone(spark):
    """With fewer lengths than buckets nothing is padded, however long the longest is."""
    lengths = [1, 2, 3, 5, 7, 11, 200_001, 10_000_001]
    sized = spark.createDataFrame([(k, k, x, 0) for k, x in enumerate(lengths)], "row long, id long, length long, tie long")
    assert {r.length: r.padded for r in packing.pack(sized).collect()} == {x: x for x in lengths}


def test_near_duplicates_meet_by_fingerprint_first(spark, monkeypatch):
    """Fingerprints that the pivot table leaves within the radius give the first pairs; these are checked on their sets, and the rest is still found."""
    rng, rows = random.Random(8), []
    for k in range(0, 30, 2):
        w = [f"w{rng.randrange(10**9)}" for _ in range(400)]
        rows += [(k, " ".join(w)), (k + 1, " ".join(w + ["end"] if k % 4 else w[:330]))]
    prints = [simhash.set_fingerprint(simhash.distinct_hashes(t.encode())) for _, t in rows]
    sets = [simhash.shingle_set(t.encode())[0] for _, t in rows]
    apart = [(a ^ b) & (2**64 - 1) for a, b in itertools.combinations(prints, 2)]
    want = {(min(a, b), max(a, b)) for (a, b), x in zip(itertools.combinations(sets, 2), apart) if x.bit_count() <= simhash.RADIUS}
    classes = spark.createDataFrame(list(zip(sets, prints)), "class long, fp long")
    got = {(r.a, r.b) for r in simhash.fingerprint_pairs(classes).collect()}
    assert got == want and 0 < len(want) < 15
    seen, whole = [], simhash.fingerprint_pairs
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda c, *a: seen.append(whole(c, *a)) or seen[-1])
    kept = {r.doc_id for r in simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(seen) == 1 and kept == set(range(0, 30, 2))


def test_set_fingerprint_is_that_of_a_text_without_repeats():
    text = " ".join(f"w{k}" for k in range(90)).encode()
    assert simhash.set_fingerprint(simhash.distinct_hashes(text)) % 2**64 == simhash.fingerprint_bytes(text, 5)
    assert simhash.set_fingerprint(simhash.distinct_hashes(text + b" " + text + b" " + text)) == simhash.set_fingerprint(simhash.distinct_hashes(text + b" " + text))
    assert simhash.set_fingerprint(simhash.distinct_hashes(b" ")) == 0
