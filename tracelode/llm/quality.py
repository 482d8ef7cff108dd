"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learn import PER_CLASS, TEXT_BYTES, fitted, sample

#: N-grams in fewer of the sample's texts are left out.
MIN_TEXTS = 2
#: N-grams of a model at most, the most frequent ones: the bound on what is broadcast.
MAX_GRAMS = 400_000
THRESHOLD = 0.3

#: Characters that count as capitals in a shape.
_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(c) for c in range(0xC0, 0xDF) if c != 0xD7} | set("ẞŒŠŽ")
#: Characters of a text that are hashed at a time, up to the next white space.
STEP = 500_000
_BASE = np.uint64(0x100000001B3)
_POWERS = np.cumprod(np.full(64, _BASE), dtype=np.uint64)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the sign that stands for it in a shape, and whether it is white space."""
    chars = [chr(c) for c in range(0x110000)]
    n = len(chars)
    other = np.fromiter(map(str.isalnum, chars), bool, n)
    digit = np.fromiter(map(str.isdecimal, chars), bool, n)
    sign = np.where(digit, ord("0"), np.where(other, ord("a"), np.arange(n))).astype(np.uint32)
    sign[[ord(c) for c in _CAPITALS]] = ord("A")
    return sign, np.fromiter(map(str.isspace, chars), bool, n)


def shape(word: str) -> str:
    """A word with its runs of capitals, other letters and digits each as one sign, and repeated signs once."""
    signs = ["A" if c in _CAPITALS else "0" if c.isdecimal() else "a" if c.isalnum() else c for c in word]
    return "".join(c for c, before in zip(signs, ["", *signs]) if c != before)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _word_hashes(codes: np.ndarray, space: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of codes that aren't white space: a polynomial in its places, all at once."""
    gap = space[codes]
    begins = ~gap & np.r_[True, gap[:-1]]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.empty(0, np.uint64)
    at = np.flatnonzero(~gap)
    owner = np.cumsum(begins)[at] - 1
    power = _POWERS[(at - first[owner]) % len(_POWERS)]
    return np.add.reduceat((codes[at].astype(np.uint64) + np.uint64(1)) * power, np.searchsorted(at, first))


def _chunks(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(len(text), at + STEP)
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, lower-cased, and of their shapes, in order."""
    sign, space = _tables()
    words, shapes = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for part in _chunks(text):
        words.append(_word_hashes(_codes(part.lower()), space))
        codes = sign[_codes(part)]
        shapes.append(_word_hashes(codes[np.r_[True, codes[1:] != codes[:-1]]], space))
    return np.concatenate(words), np.concatenate(shapes)


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind)
    return h ^ (h >> np.uint64(29))


#: Indicators that aren't n-grams: a word repeats at once, most do, and the text's size.
AGAIN, MOSTLY, SIZE = 1, 2, 3


def ngrams(text: str) -> np.ndarray:
    """Indicators of a whole text as ascending 64-bit hashes: its words, their shapes in runs of one to three, and words that repeat at once, whatever their case."""
    w, s = hashes(text)
    one = _mixed(s, 12)
    two = _mixed(one[:-1] * _BASE + s[1:], 13)
    three = _mixed(two[:-1] * _BASE + s[2:], 14)
    again = int((w[1:] == w[:-1]).sum())
    more = [SIZE + min(4, int(math.log10(len(w) + 1) * 2) // 2)]
    more += [AGAIN] * bool(again) + [MOSTLY] * (2 * again > len(w))
    return np.unique(np.concatenate([_mixed(w, 11), one, two, three, np.array(more, np.uint64)]))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, dim: int, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Weights of the linear model with hinge loss and half squared norm, by coordinate descent on its dual.

    rows are (indices, values); y is +1 or -1; alpha_i stays in [0, cost_i]. Each step solves one alpha exactly.
    """
    w, alpha = np.zeros(dim), np.zeros(len(rows))
    square = np.array([max(1e-12, float(v @ v)) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slope = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, share: float | None = None, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities: Newton steps, halved until the loss falls, on smoothed targets.

    share: that of y > 0 where the model will be used, if the sample has another.
    """
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    share = n1 / (n1 + n0) if share is None else share
    w = np.where(y > 0, share * (n1 + n0) / max(1.0, n1), (1 - share) * (n1 + n0) / max(1.0, n0))
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    middle, scale = float(margin.mean()), float(margin.std()) or 1.0
    x = (margin - middle) / scale

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float(w @ (np.logaddexp(0, z) - t * z)) + 5e-4 * a * a

    a, b = 1.0, 0.0
    now = loss(a, b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g, h = w * (p - t), w * p * (1 - p)
        ga, gb = float(g @ x) + 1e-3 * a, float(g.sum())
        haa, hab, hbb = float(h @ (x * x)) + 1e-3, float(h @ x), float(h.sum()) + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = 1.0
        while step > 1e-6 and (new := loss(a - step * da, b - step * db)) > now:
            step /= 2
        if step <= 1e-6 or now - new < 1e-9:
            break
        a, b, now = a - step * da, b - step * db, new
    a = max(a, 1e-6)
    return a / scale, b - a * middle / scale


@dataclass
class Model:
    """grams: ascending hashes; weight: what each adds to the margin, square: what it adds to the squared length that the sum is divided by."""

    grams: np.ndarray
    weight: np.ndarray
    square: np.ndarray
    offset: float
    slope: float
    shift: float

    def margin(self, text: str) -> float:
        if not len(self.grams):
            return self.offset
        own = ngrams(text)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = at[self.grams[at] == own]
        return float(self.weight[at].sum()) / (math.sqrt(float(self.square[at].sum())) or 1.0) + self.offset

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * self.margin(text) + self.shift))))


def fit(texts: list[str], labels: list[int], usual: float | None = None, cost: float = 1.0, alpha: float = 1.0) -> Model:
    """The model of whole texts with labels 0 and 1; with one class only, or none, a model that always says its share.

    Counts of the n-grams in each class give log ratios, which scale the indicators;
    scaled rows have unit length; classes weigh alike. Every fifth text is kept out of
    the fit and turns margins into probabilities, label 1 having the usual share.
    """
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        none = np.empty(0)
        return Model(none.astype(np.uint64), none, none, 0.0, 1e-6, math.log(share / (1 - share)))
    held = np.arange(len(texts)) % 5 == 4
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    sets = [ngrams(t) for t in texts]
    own = np.flatnonzero(~held)
    grams, often = np.unique(np.concatenate([sets[i] for i in own]), return_counts=True)
    common = np.flatnonzero(often >= MIN_TEXTS)
    if len(common) > MAX_GRAMS:  # ties to the smaller hash
        common = np.sort(common[np.argsort(-often[common], kind="stable")[:MAX_GRAMS]])
    grams = grams[common]

    def places(s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(grams, s)
        return at[(at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == s)] if len(grams) else at[:0]

    sets = [places(s) for s in sets]
    count = np.full((len(grams), 2), alpha)
    for i in own:
        count[sets[i], int(y[i] > 0)] += 1
    ratio = np.log(count[:, 1] / count[:, 1].sum()) - np.log(count[:, 0] / count[:, 0].sum())
    dim = len(grams) + 1  # the last is the offset

    def row(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = ratio[at]
        v = v / (math.sqrt(float(v @ v)) or 1.0)
        return np.r_[at, dim - 1], np.r_[v, 1.0]

    rows = [row(s) for s in sets]
    share = (y[own] > 0).mean()
    costs = cost * np.where(y[own] > 0, 0.5 / share, 0.5 / (1 - share))
    w = dual_descent([rows[i] for i in own], y[own], costs, dim)
    check = np.flatnonzero(held) if held.any() else own
    margin = np.array([float(w[a] @ v) for a, v in (rows[i] for i in check)])
    slope, shift = platt(margin, y[check], usual)
    return Model(grams, w[:-1] * ratio, ratio**2, float(w[-1]), slope, shift)


def score(model: Model, text: Column, spark) -> Column:
    """The probability of label 1 as a double, for every whole text; null counts as empty."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([held.value.score(t.as_py() or "") for t in texts], pa.float64())

    return quality(text)


def fit_tables(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, text_bytes: int = TEXT_BYTES) -> Model:
    """The model that the quality labels outside fold 0 of 5 give, fitted by one executor task on a bounded sample; see learn.sample."""
    return fitted(sample(docs, labels, "quality", 5, 0, per_class, text_bytes), fit)
