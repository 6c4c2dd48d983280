"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the classes' log-count ratios, and a linear model with hinge loss is fitted to them
by dual coordinate descent. N-grams are of two kinds: words alone and in pairs, and shapes of tokens (letter case,
digits, the punctuation itself, whether a token repeats the one before it) in runs of one to three, each with how
large a share of the text it takes, in powers of two. All are hashed into a fixed number of buckets: a token's hashes are
looked up once, and those of n-grams are mixed from them in arrays. Scores are made of margins by logistic calibration,
fitted on margins that models of the other ``FOLDS`` - 1 parts of the sample give each part.

The model is fitted on at most ``sample`` labelled rows (those with the smallest hashes of their id); with the bucket
count this bounds what the driver gets. Scoring is over all rows, each on its own.

Defined results: a null text is empty and gets the score of a text without n-grams; rows without an id or label teach
nothing; of several labels of an id the mean counts (0.5 and over: 1); of several texts of a labelled id that of the
smallest hash teaches, once; rows keep their multiplicity; a text of any length is scored whole, each row on its own; with
no labels of both classes all scores are 0.5; ``score`` drops other columns, ``keep`` keeps exactly the input's; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 18
SAMPLE = 6000
CUTOFF = 0.3
EPOCHS = 12
COST = 1.0
#: Parts of the sample whose margins, each from the others' model, calibrate the scores.
FOLDS = 3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Share thresholds of shape n-grams: 1/2, 1/4 ... of the tokens.
_SHARES = 7


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Tokens whose hashes a worker remembers, and tokens of a text that are hashed at once.
_KNOWN = 60_000
_known: dict[str, int] = {}


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _shape(token: str) -> str:
    if token.isalpha():
        return "A" if len(token) > 1 and token.isupper() else "Aa" if token[0].isupper() else "a"
    return "9" if token.isdecimal() else token[:4]


def _hashes(token: str) -> int:
    """The hash of the word in lower case in the upper half, of the shape in the lower half; its last bit is 0 in words."""
    if len(_known) >= _KNOWN:
        _known.clear()
    shape = _shape(token)
    both = _known[token] = _crc("w " + token.lower()) << 32 | _crc("s " + shape) & ~1 | (shape not in ("a", "Aa", "A"))
    return both


_SAME, _SAME_2 = np.uint64(_crc("s =") | 1), np.uint64(_crc("s ==") | 1)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    out = np.full(parts[0].shape, len(parts), np.uint64)
    for x in parts:
        out = (out ^ x) * _MIX[0]
        out ^= out >> np.uint64(29)
    out *= _MIX[1]
    return out ^ out >> np.uint64(32)


def features(text: str | None) -> np.ndarray:
    """Sorted buckets of a whole text's n-gram indicators."""
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int32)
    get = _known.get
    both = np.fromiter([get(t) or _hashes(t) for t in tokens], np.uint64, len(tokens))
    words, shapes = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    twice = words[2:] == words[:-2]
    shapes[2:][twice & (shapes[2:] & np.uint64(1) == 0)] = _SAME_2
    shapes[1:][words[1:] == words[:-1]] = _SAME
    grams = [_mixed(np.unique(words)), np.unique(_mixed(words[:-1], words[1:]))]
    for n in range(1, min(3, len(shapes)) + 1):
        runs, times = np.unique(_mixed(*(shapes[k : len(shapes) - n + 1 + k] for k in range(n))), return_counts=True)
        # The first power of two by which the run's share of the tokens is reached, and those beyond it.
        first = np.maximum(1, np.ceil(np.log2(len(tokens) / times)).astype(int))
        often = np.maximum(0, _SHARES + 1 - first)
        power = _SHARES - (np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often))
        grams += [runs, _mixed(np.repeat(runs, often), power.astype(np.uint64))]
    return np.unique((np.concatenate(grams) & np.uint64(BUCKETS - 1)).astype(np.int32))


@dataclass(frozen=True)
class Model:
    """``weights`` are of indicators scaled by the ratios already; ``norms`` are the squared ratios."""

    weights: np.ndarray
    norms: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        norm = float(self.norms[x].sum()) if len(x) else 0.0
        return self.bias + (float(self.weights[x].sum()) / norm**0.5 if norm > 0 else 0.0)

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _machine(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-count ratios, weights of the scaled indicators, and bias; y: 1 or -1."""
    counts = [np.ones(BUCKETS), np.ones(BUCKETS)]
    for x, side in zip(rows, y, strict=True):
        counts[int(side > 0)][x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = []
    for x in rows:
        v = ratio[x]
        norm = np.sqrt((v * v).sum())
        values.append(v / norm if norm > 0 else v)
    cost = {s: COST * len(y) / (2 * max(1, int((y == s).sum()))) for s in (1.0, -1.0)}
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    order, random = np.arange(len(y)), np.random.default_rng(7)
    for _ in range(EPOCHS):
        random.shuffle(order)
        for i in order:
            x, v, s = rows[i], values[i], y[i]
            gradient = s * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1), 0.0), cost[s])
            if new != alpha[i]:
                w[x] += (new - alpha[i]) * s * v
                bias += (new - alpha[i]) * s
                alpha[i] = new
    return ratio, w, bias


def _model(rows: list[np.ndarray], y: np.ndarray) -> Model:
    ratio, w, bias = _machine(rows, y)
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, 1.0, 0.0)


def fit(rows: list[np.ndarray], labels: list[int]) -> Model:
    """Fit on bucket arrays and labels 0 or 1."""
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        zero = np.zeros(BUCKETS, np.float32)
        return Model(zero, zero, 0.0, 1.0, 0.0)
    part = np.zeros(len(y), int)
    for s in (1.0, -1.0):
        part[y == s] = np.arange(int((y == s).sum())) % FOLDS
    margins = np.zeros(len(y))
    for k in range(FOLDS):
        other, own = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(set(y[other].tolist())) < 2:  # too few rows to set any aside
            other = np.arange(len(y))
        machine = _model([rows[i] for i in other], y[other])
        margins[own] = [machine.margin(rows[i]) for i in own]
    slope, offset = _platt(margins, y)
    return replace(_model(rows, y), slope=slope, offset=offset)


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration by Newton steps, with Platt's smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, t = np.stack([margins, np.ones_like(margins)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(t @ x, -40, 40)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (p - target))
        t -= step
        if abs(step).max() < 1e-6:
            break
    return float(t[0]), float(t[1])


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``sample`` labelled rows that are not held out. Both classes are sampled alike."""
    common.tune(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).dropna().groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    taught = known.filter(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(sample)

    @F.pandas_udf("binary")
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t).tobytes() for t in texts], dtype=object)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    one = texts.join(F.broadcast(taught), "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # at most ``sample`` ids are broadcast
    rows = one.select("id", "y", grams("text").alias("x")).collect()  # at most ``sample`` rows
    rows.sort(key=lambda r: r.id)
    return fit([np.frombuffer(r.x, np.int32) for r in rows], [r.y for r in rows])


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: two arrays of BUCKETS floats

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return of(F.col(text_col))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    model = train(docs, labels, sample, id_col, text_col)
    rows = docs.select(F.col(id_col), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), scored(docs, model, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good, with their columns."""
    return docs.filter(scored(docs, train(docs, labels, sample, id_col, text_col), text_col) >= CUTOFF)
