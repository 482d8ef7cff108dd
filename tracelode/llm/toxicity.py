"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learn import PER_CLASS, TEXT_BYTES, fitted, sample
from .quality import platt

#: Words of a bag. A text is scored by its worst bag, so that length dilutes nothing.
BAG = 12
DIM, SLOTS, SHORTEST, LONGEST = 8, 1 << 17, 3, 5
#: A run of more characters without white space is taken as several words of so many.
LONG_WORD = 4096
#: Characters of words that are hashed at a time.
STEP = 200_000
#: Words whose scores a worker remembers; when full, it starts anew.
MEMORY = 150_000
THRESHOLD = 0.3

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words in one array, and the index of the word that each belongs to: the word itself and its character n-grams, between marks for its ends.

    A word is lower-cased and loses the signs at its ends. Hashes of all words are taken at once.
    """
    marked = [f"<{w if w[:1].isalnum() and w[-1].isalnum() else _EDGES.sub('', w)}>" for w in map(str.lower, words)]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    start, owner = _starts(size), np.repeat(np.arange(len(marked)), size)
    left = np.repeat(start + size, size) - np.arange(len(codes))
    weight = _POWERS[(np.arange(len(codes)) - start[owner]) % len(_POWERS)]
    found, owners = [_mixed(np.add.reduceat(codes * weight, start))], [np.arange(len(marked))]
    for n in range(SHORTEST, LONGEST + 1):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * _BASE + codes[at + k]
        found.append(_mixed(h))
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners)


_BASE = np.uint64(0x100000001B3)
_POWERS = np.cumprod(np.full(64, _BASE), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) & np.uint64(SLOTS - 1)).astype(np.int64)


def tokens(text: str) -> list[str]:
    """The words of a whole text, a word that repeats at once being taken once."""
    words = text.split()
    if len(text) > LONG_WORD and max(map(len, words), default=0) > LONG_WORD:
        words = [w[at : at + LONG_WORD] for w in words for at in range(0, len(w), LONG_WORD)]
    return [w for w, before in zip(words, ["", *words]) if w != before]


def _steps(words: list[str]) -> Iterator[list[str]]:
    """The words in order, some at a time."""
    at, chars = 0, 0
    for k, w in enumerate(words):
        if chars > STEP:
            yield words[at:k]
            at, chars = k, 0
        chars += len(w)
    if words:
        yield words[at:]


def bags(n: int, size: int = BAG) -> list[tuple[int, int]]:
    """Word ranges of overlapping bags that cover n words; a bag may be shorter than size, and no words are one empty bag."""
    step = max(1, size // 2)
    return [(a, min(n, a + size)) for a in range(0, max(1, n - step), step)]


@dataclass
class Model:
    """vectors: slots x DIM; out: DIM x 2; base: 2. A word's vector is the mean of its slots', a bag's the mean of BAG words', absent ones being zero.

    slope and shift turn the worst bag's log odds into those of the text.
    """

    vectors: np.ndarray
    out: np.ndarray
    base: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


class Scorer:
    def __init__(self, model: Model):
        self.pull = model.vectors @ (model.out[:, 1] - model.out[:, 0]) / BAG
        self.base, self.slope, self.shift = float(model.base[1] - model.base[0]), model.slope, model.shift
        self.known: dict[str, float] = {}

    def _learn(self, words: set[str]) -> None:
        for some in _steps(sorted(words)):
            slots, owner = subwords(some)
            value = np.bincount(owner, self.pull[slots]) / np.bincount(owner)
            self.known.update(zip(some, value.tolist()))

    def worst(self, texts: list[str]) -> list[float]:
        """The highest log odds of label 1 among each text's bags."""
        if len(self.known) > MEMORY:
            self.known = {}
        known, rows = self.known, [tokens(t) for t in texts]
        new = {w for words in rows for w in words if w not in known}
        if new:
            self._learn(new)
        out, get = [], known.__getitem__
        for words in rows:
            if not words:
                out.append(self.base)
                continue
            up = np.zeros(len(words) + 1)
            np.cumsum(np.fromiter(map(get, words), float, len(words)), out=up[1:])
            start = np.arange(0, max(1, len(words) - BAG // 2), BAG // 2)
            out.append(float((up[np.minimum(start + BAG, len(words))] - up[start]).max()) + self.base)
        return out

    def __call__(self, texts: list[str]) -> list[float]:
        odds = self.slope * np.array([v for at in range(0, len(texts), 256) for v in self.worst(texts[at : at + 256])]) + self.shift
        return (1 / (1 + np.exp(-np.clip(odds, -30, 30)))).tolist()


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] places, then from begin[1] on, and so on."""
    return np.repeat(begin - _starts(size), size) + np.arange(size.sum())


@dataclass
class Words:
    """Distinct words as ranges of one array of slots."""

    slots: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, names: list[str]) -> Words:
        found, sizes = [], []
        for some in _steps(names):
            slots, owner = subwords(some)
            found.append(slots[np.argsort(owner, kind="stable")].astype(np.int32))
            sizes.append(np.bincount(owner))
        size = np.concatenate(sizes)
        return cls(np.concatenate(found), _starts(size), size)

    def means(self, vectors: np.ndarray) -> np.ndarray:
        """The value of each word, where vectors has one number a slot."""
        return np.add.reduceat(vectors[self.slots], self.begin) / self.size


class _Distinct:
    """The distinct values of an array of small numbers, and each one's place among them, without sorting."""

    def __init__(self, most: int):
        self.there, self.place = np.zeros(most, bool), np.zeros(most, np.int32)

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.there[values] = True
        found = np.flatnonzero(self.there)
        self.there[found] = False
        self.place[found] = np.arange(len(found))
        return found, self.place[values]


def _train(words: Words, tokens_of: np.ndarray, first: np.ndarray, last: np.ndarray, y: np.ndarray, weight: np.ndarray, model: Model, rounds: int, seed: int, rate: float = 0.3, batch: int = 256) -> None:
    """Adagrad over bags, ranges first to last of all texts' words: vectors and the softmax layer move together."""
    rng = np.random.default_rng(seed)
    g_vec, g_out, g_base = np.full(len(model.vectors), 1e-6), np.full(model.out.shape, 1e-6), np.full(2, 1e-6)
    words_in, slots_in = _Distinct(len(words.size)), _Distinct(len(model.vectors))
    for _ in range(rounds):
        order = rng.permutation(len(first))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            size = last[own] - first[own]  # never 0: a text without words holds one empty word
            used, back = words_in(tokens_of[_runs(first[own], size)])
            n = words.size[used]
            slots, place = slots_in(words.slots[_runs(words.begin[used], n)])
            e_word = np.add.reduceat(model.vectors[slots][place], _starts(n), axis=0) / n[:, None]
            e_bag = np.add.reduceat(e_word[back], _starts(size), axis=0) / BAG
            z = e_bag @ model.out + model.base
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            d = p * weight[own][:, None] / len(own)
            # as there are two classes, all gradients of vectors lie along out's difference: a sum of one number a word
            d_out, d_base, pull = e_bag.T @ d, d.sum(0), d[:, 1] / BAG
            d_word = np.bincount(back, np.repeat(pull, size), len(used)) / n
            d_slot = np.bincount(place, np.repeat(d_word, n), len(slots))
            d_vec = d_slot[:, None] * (model.out[:, 1] - model.out[:, 0])
            g_vec[slots] += (d_vec * d_vec).mean(1)
            g_out += d_out * d_out
            g_base += d_base * d_base
            model.vectors[slots] -= rate * d_vec / np.sqrt(g_vec[slots])[:, None]
            model.out -= rate * d_out / np.sqrt(g_out)
            model.base -= rate * d_base / np.sqrt(g_base)


def fit(texts: list[str], labels: list[int], usual: float | None = None, visits: int = 250_000, seed: int = 9) -> Model:
    """The model of whole texts with labels 0 and 1; with one class only, or none, a model that always says its share.

    A text of label 1 says only that some of its bags are bad. The first pass takes all of
    them as such; the second keeps those that the first holds for bad, at least the worst
    one, and starts anew. A pass goes over all its bags 3 to 30 times, about visits in all where that
    is enough for 3. Every fifth text stays out of both and turns log odds into probabilities, label 1 having the usual share.
    """
    rng = np.random.default_rng(seed)
    start = lambda: Model((rng.random((SLOTS, DIM)) - 0.5) / DIM, (rng.random((DIM, 2)) - 0.5), np.zeros(2))
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return Model(np.zeros((SLOTS, DIM)), np.zeros((DIM, 2)), np.array([0.0, np.log(share / (1 - share))]))
    held = np.arange(len(texts)) % 5 == 4
    y_all = np.array(labels)
    if len(set(y_all[held])) < 2 or len(set(y_all[~held])) < 2:
        held[:] = False
    ids: dict[str, int] = {}
    rows, clean, bad, so_far = [], [], [], 0
    for t, label, out in zip(texts, labels, held):
        if not out:
            row = np.array([ids.setdefault(w, len(ids)) for w in tokens(t) or [""]], np.int32)
            (bad if label == 1 else clean).append(np.array(bags(len(row))) + so_far)
            rows.append(row)
            so_far += len(row)
    tokens_of, words = np.concatenate(rows), Words.of(list(ids))
    quiet = np.concatenate(clean)

    def passed(chosen: np.ndarray, heavy: float) -> Model:
        both = np.concatenate([quiet, chosen])
        rounds = min(30, max(3, visits // len(both)))
        y = np.r_[np.zeros(len(quiet), int), np.ones(len(chosen), int)]
        model = start()
        _train(words, tokens_of, both[:, 0], both[:, 1], y, np.where(y == 1, heavy * len(quiet) / len(chosen), 1.0), model, rounds, seed)
        return model

    first = passed(np.concatenate(bad), 1.0)
    up = np.r_[0.0, np.cumsum(words.means(first.vectors @ (first.out[:, 1] - first.out[:, 0]) / BAG)[tokens_of])]
    chosen = []
    for ranges in bad:
        odds = up[ranges[:, 1]] - up[ranges[:, 0]] + first.base[1] - first.base[0]
        keep = odds >= max(0.0, odds.max() / 2)
        chosen.append(ranges[keep] if keep.any() else ranges[[odds.argmax()]])
    model = passed(np.concatenate(chosen), 0.3)
    scorer = Scorer(model)
    check = np.flatnonzero(held) if held.any() else np.arange(len(texts))
    model.slope, model.shift = platt(np.array(scorer.worst([texts[i] for i in check])), np.where(y_all[check] == 1, 1, -1), usual)
    model.vectors = model.vectors.astype(np.float32)
    return model


def score(model: Model, text: Column, spark) -> Column:
    """The probability of label 1 as a double, for every whole text; null counts as empty. The model has a fixed size."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(held.value)
        for texts in batches:
            scores = [v for at in range(0, len(texts), 256) for v in scorer([t or "" for t in texts.slice(at, 256).to_pylist()])]
            yield pa.array(scores, pa.float64())

    return toxicity(text)


def fit_tables(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, text_bytes: int = TEXT_BYTES) -> Model:
    """The model that the toxicity labels outside fold 2 of 4 give, fitted by one executor task on a bounded sample; see learn.sample."""
    return fitted(sample(docs, labels, "toxic", 4, 2, per_class, text_bytes), fit)
