"""Benchmark decontamination by latent semantic retrieval.

1. One pass over the texts keeps the places of words that some benchmark item has, in segments of ``SEGMENT`` words that
   overlap by a whole span, so that no row grows with the length of a text.
2. Frequencies over segments give idf weights; words in over ``COMMON`` of all segments weigh nothing. Texts that are repeated
   count once, and words in a run of ``QUOTE`` words that some item has too do not count, so a leak's own copies, however many,
   do not make its words common.
3. Passages are windows of ``2 * HALF`` words, a half apart. A second pass multiplies the TF-IDF matrix of all passages
   (and of the items) with a random test matrix and with its own transpose; partial products are summed in a tree of
   shuffles. From the sum, a words x rank matrix, the driver makes the leading right singular vectors (the one-pass
   form of the randomised SVD).
4. A third pass projects every passage, and takes as candidates the items whose cosine in the latent space is high and
   of whose latent mass the passage has enough. A short unit drowns in the words around it there, and one without rarer
   words weighs nothing; so all passages that have enough of a unit's words for step 5 are candidates too, by an exact bound
   on the words in common. Leaks of up to twice the unit's length are so found whatever the rank and
   the number of items in a block; more scattered ones of short items only where the cosine is high.
5. A candidate is a leak if the longest common subsequence with the passage (widened by a half on both sides) has
   ``VERBATIM`` of the item's words, or ``PARAPHRASE`` of its rarer words and all rarer words of its answer. The answer is the
   benchmark's column ``answer_col``, or the item's last ``ANSWER_WORDS`` rarer words where none is named. A candidate
   by the exact bound alone has to have these shares, and the answer, within twice the unit's own length.

Items over a window long are cut into windows too, and each counts. The benchmark is taken in blocks of at most ``BLOCK`` items
and (but for an item longer than that) ``BLOCK_WORDS`` words, so what the driver and the workers hold is bounded: a block's
words, its ``RANK`` latent directions, and its item windows. Workers take ``HALVES`` halves at a time. A block's leaks
are written before the next block; its broadcasts and its encoded corpus are then removed.

Defined results: words are ``\\w+`` of the lower-cased text; a null or empty text has no passage; items without words, and
null items, match nothing; items under ``SHORT`` words match only verbatim and whole (all words, one after the other), and are
looked up by a hash of their words at every place; items are compared each on its own, so repeated items are found
alike, and rows of one item id are one item with several texts; documents of one id are reported once for each item, and so are
those without an id, together; ``keep`` drops the rows whose own text has a leak, whatever their id; other columns are dropped
by ``leaks`` and kept by ``keep``; with an empty table nothing leaks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HALF = 32
RANK = 256
OVERSAMPLE = 16
COMMON = 0.05
COSINE = 0.4
COVERAGE = 0.35
VERBATIM = 0.8
PARAPHRASE = 0.6
ANSWER_WORDS = 4
SHORT = 8
BLOCK = 2000
BLOCK_WORDS = 200_000
#: Words of a text in one row, and halves that a worker has as matrix rows at once.
SEGMENT = 4096
HALVES = 4096
#: Words in a row that count as quoted from an item.
QUOTE = 3
_WORD = re.compile(r"\w+")
#: Rows of partial sums that one task adds up.
_FAN = 32
#: Terms in one row of partial sums.
_TERMS = 256
#: Halves in the span that a candidate is checked on: a passage and a half on both sides.
_SPAN = 4
#: Words in common that the exact bound counts at once.
_COUNTS = 1 << 18
#: Characters of a text that are split into words at once.
_CHARS = 1 << 20


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _parts(text: str | None) -> Iterator[str]:
    """A text in parts of about ``_CHARS`` characters that end at a white space, where it has one."""
    text, at = text or "", 0
    while len(text) - at > _CHARS:
        space = re.compile(r"\s").search(text, at + _CHARS)
        end = space.end() if space else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


@dataclass
class Unit:
    """A window of an item: term numbers in order, and the terms of the item's answer."""

    item: int
    terms: np.ndarray
    answer: frozenset
    whole: int  # words of the item


def _units(items: list[tuple], vocabulary: dict[str, int]) -> list[Unit]:
    units = []
    for item, text, answer in items:
        terms = np.array([vocabulary[w] for w in words(text)], np.int32)
        own = frozenset(vocabulary[w] for w in words(answer) if w in vocabulary)
        for at in range(0, max(1, len(terms) - HALF), HALF):
            if len(part := terms[at : at + 2 * HALF]):
                units.append(Unit(item, part, own, len(terms)))
    return units


def lcs(masks: dict[int, int], n: int, sequence: list[int]) -> int:
    """Length of the longest common subsequence with a pattern of n terms, whose places are the bits of ``masks``."""
    full = (1 << n) - 1
    state = full
    for t in sequence:
        if (m := masks.get(t)) is not None:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return n - state.bit_count()


def _masks(terms) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, t in enumerate(terms):
        out[int(t)] = out.get(int(t), 0) | 1 << i
    return out


def _grams(terms: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n terms from each place on."""
    keys = np.zeros(max(0, len(terms) - n + 1), np.int64)
    for k in range(n):
        keys = keys * 0x5851F42D4C957F2D + terms[k : k + len(keys)] + 1
    return keys ^ keys >> 32


def _least(share: float, n: int) -> int:
    """The smallest count that is ``share`` of n."""
    return next(k for k in range(n + 1) if k / n >= share)


def _encoded(docs: DataFrame, shared: Broadcast, kind: str) -> DataFrame:
    """id, n_words, the places and terms of words in the vocabulary, text_hash and segment, of rows (id, text, text_hash)."""
    overlap = _SPAN * HALF

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            rows = []
            for id_, text, text_hash in zip(*batch.columns, strict=True):
                own = []
                for part in _parts(text.as_py()):
                    found = words(part)
                    own.append(np.fromiter([get(w, -1) for w in found], np.int32, len(found)))
                t = np.concatenate(own)
                for k, start in enumerate(range(0, max(1, len(t) - overlap), SEGMENT - overlap)):
                    part = t[start : start + SEGMENT]
                    at = np.flatnonzero(part >= 0)
                    rows.append((id_.as_py(), len(part), at.astype("<i4").tobytes(), part[at].astype(kind).tobytes(), text_hash.as_py(), k))
            columns = zip(*rows, strict=True) if rows else [[]] * len(ENCODED.names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ENCODED.types, strict=True)], names=ENCODED.names)

    return docs.mapInArrow(encode, "id long, n_words long, places binary, terms binary, text_hash long, segment int")


ENCODED = pa.schema({"id": pa.int64(), "n_words": pa.int64(), "places": pa.binary(), "terms": pa.binary(), "text_hash": pa.int64(), "segment": pa.int32()})


class _Batch:
    """The passages of a batch of encoded segments, side by side, with an empty half after each segment."""

    @classmethod
    def each(cls, batches: Iterator[pa.RecordBatch], kind: str, weight: np.ndarray) -> Iterator[_Batch]:
        """Of at most ``HALVES`` halves each: a segment has far fewer."""
        for batch in batches:
            ends = np.cumsum([n // HALF + 2 for n in batch.column(1).to_pylist()])
            at = 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HALVES, "right")) - at)
                yield cls(batch.slice(at, n), kind, weight)
                at += n

    def __init__(self, batch: pa.RecordBatch, kind: str, weight: np.ndarray):
        self.ids, self.hashes = batch.column(0).to_pylist(), batch.column(4).to_pylist()
        places = [np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()]
        terms = [np.frombuffer(x, kind) for x in batch.column(3).to_pylist()]
        halves = [n // HALF + 2 for n in batch.column(1).to_pylist()]
        self.first = np.cumsum([0, *halves])
        sizes = [len(t) for t in terms]
        self.token_first = np.cumsum([0, *sizes])
        self.places = np.concatenate(places) if places else np.zeros(0, "<i4")
        self.terms = (np.concatenate(terms) if terms else np.zeros(0)).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.at = self.first[owner] * HALF + self.places  # the empty half keeps documents apart
        self.half, self.term = self.pairs(weight > 0)

    def pairs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Halves and the chosen terms in them, once each, in order."""
        own = chosen[self.terms]
        pairs = np.unique(self.at[own] // HALF * len(chosen) + self.terms[own])
        return pairs // len(chosen), pairs % len(chosen)

    def windows(self, matrix: np.ndarray) -> np.ndarray:
        """Rows of the passages' product with a words x k matrix; passage h is halves h and h + 1."""
        out = np.zeros((self.first[-1] + 1, matrix.shape[1]), np.float32)
        step = 1 << 14
        for at in range(0, len(self.half), step):
            h, t = self.half[at : at + step], self.term[at : at + step]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            out[h[starts]] += np.add.reduceat(matrix[t], starts, axis=0)
        out[:-1] += out[1:]
        return out[:-1]

    def back(self, y: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """Adds the passages' transpose times ``y`` to ``total``. A half is in its own passage and in the one before it."""
        both = y.copy()
        both[1:] += y[:-1]
        order = np.argsort(self.term, kind="stable")
        step = 1 << 14
        for at in range(0, len(order), step):
            o = order[at : at + step]
            t = self.term[o]
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            total[t[starts]] += np.add.reduceat(both[self.half[o]], starts, axis=0) * weight[t[starts], None]


def _summed(parts: DataFrame, n_parts: int) -> DataFrame:
    """Sums rows (part, block, data) of float32 arrays to one row a block, ``_FAN`` rows to a task."""

    def add(key, table):
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in table.column("data").to_pylist())
        return pa.table({"part": [key[0].as_py()], "block": [key[1].as_py()], "data": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    while n_parts > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / _FAN)).groupBy("part", "block").applyInArrow(add, "part long, block long, data binary")
        n_parts = -(-n_parts // _FAN)
    return parts


def _directions(sketch: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive semidefinite matrix C from C @ test (Nystroem, shifted for stability)."""
    shift = np.finfo(np.float32).eps * np.linalg.norm(sketch) + 1e-12
    sketch = sketch + shift * test
    core = test.T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values[-1] * 1e-7
    left, _, _ = np.linalg.svd(sketch @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left[:, :rank].astype(np.float32)


def _weights(n: int, df: np.ndarray) -> np.ndarray:
    """idf of words in df of n segments; common ones weigh nothing, unless all are (a corpus of a few documents)."""
    weight = np.where(df > COMMON * n, 0.0, np.log((1 + n) / (1 + df))).astype(np.float32)
    return weight if weight.any() else np.ones_like(weight)


def _block(encoded: DataFrame, units: list[Unit], n_terms: int, kind: str, folder: str) -> DataFrame:
    """Leaks (doc_id, text_hash, item_id, ...) of a block of items, written to ``folder``."""
    context = encoded.sparkSession.sparkContext

    grams = np.unique(np.concatenate([_grams(u.terms.astype(np.int64), QUOTE) for u in units]))
    maybe = np.zeros(1 << 20, bool)
    maybe[grams & len(maybe) - 1] = True
    quotes = context.broadcast((grams, maybe))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, maybe = quotes.value
        df, n = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            places = [np.frombuffer(x, "<i4") for x in batch.column(0).to_pylist()]
            if not (sizes := [len(x) for x in places]):
                continue
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at, terms = np.concatenate(places), np.frombuffer(b"".join(batch.column(1).to_pylist()), kind).astype(np.int64)
            free = np.ones(len(terms), bool)
            if len(terms) >= QUOTE:
                keys = _grams(terms, QUOTE)
                run = maybe[keys & len(maybe) - 1] & (at[QUOTE - 1 :] - at[: len(keys)] == QUOTE - 1) & (owner[QUOTE - 1 :] == owner[: len(keys)])
                run = np.flatnonzero(run)
                run = run[np.isin(keys[run], grams)]
                for k in range(QUOTE):
                    free[run + k] = False
            df += np.bincount(np.unique(owner[free] * n_terms + terms[free]) % n_terms, minlength=n_terms)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.r_[-1, seen], "df": np.r_[n, df[seen]]})

    distinct = encoded.groupBy("text_hash", "segment").agg(F.first("places").alias("places"), F.first("terms").alias("terms"))
    rows = distinct.select("places", "terms").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row a word
    quotes.destroy()
    df = {r.term: r.df for r in rows}
    weight = _weights(df.pop(-1, 0), np.array([df.get(t, 0) for t in range(n_terms)]))

    rank = min(RANK, len(units))
    width = min(n_terms, rank + OVERSAMPLE)
    test = np.random.default_rng(5).standard_normal((n_terms, width)).astype(np.float32)
    shared = context.broadcast((weight, test))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, test = shared.value
        matrix, total = weight[:, None] * test, np.zeros(test.shape, np.float32)
        for batch in batches:
            for b in _Batch.each([batch], kind, weight):
                b.back(b.windows(matrix), weight, total)
        part = TaskContext.get().partitionId()
        blocks = [(part, k, total[at : at + _TERMS].astype("<f4").tobytes()) for k, at in enumerate(range(0, n_terms, _TERMS)) if total[at : at + _TERMS].any()]
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blocks, strict=True)], names=["part", "block", "data"])

    parts = encoded.mapInArrow(sketch, "part long, block long, data binary")
    product = np.zeros(test.shape)
    for r in _summed(parts, encoded.rdd.getNumPartitions()).collect():  # words x width floats
        rows_of = np.frombuffer(r.data, "<f4").reshape(-1, width)
        product[r.block * _TERMS : r.block * _TERMS + len(rows_of)] += rows_of
    shared.destroy()

    def rows_of_units() -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, len(units), 256):
            tf = np.zeros((len(part := units[at : at + 256]), n_terms), np.float32)
            for k, u in enumerate(part):
                tf[k, u.terms] = weight[u.terms]
            yield slice(at, at + len(part)), tf

    for _, tf in rows_of_units():
        product += tf.T @ (tf @ test)
    basis = _directions(product, test.astype(np.float64), rank)
    queries = np.empty((len(units), basis.shape[1]), np.float32)
    for at, tf in rows_of_units():
        queries[at] = tf @ basis
    norms = np.linalg.norm(queries, axis=1)
    found = context.broadcast((weight, weight[:, None] * basis, queries / np.maximum(norms, 1e-9)[:, None], norms, units))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, matrix, directions, norms, units = found.value
        checks = [_Check(u, weight) for u in units]
        bound, verbatim = _Bound(checks, len(weight)), _Verbatim(checks)
        least = COVERAGE * np.maximum(norms, 1e-9)
        for b in _Batch.each(batches, kind, weight):
            y = b.windows(matrix)
            rows = [(b.ids[doc], b.hashes[doc], units[k].item, 1.0, float(checks[k].n_rare > 0)) for doc, k in verbatim.found(b)]
            close, wide = bound.passages(b), []
            for at in range(0, len(y), 4096):
                part = y[at : at + 4096]
                dots = part @ directions.T
                good = (dots >= COSINE * np.linalg.norm(part, axis=1)[:, None]) & (dots >= least)
                h, k = np.nonzero(good & ~verbatim.short)
                wide.append((at + h) * len(units) + k)
            wide = np.concatenate([close[:0], *wide])
            keys = np.union1d(close, wide)
            for h, k, is_wide in zip(*divmod(keys, len(units)), np.isin(keys, wide), strict=True):
                doc = int(np.searchsorted(b.first, h, "right")) - 1
                lo, hi = b.token_first[doc], b.token_first[doc + 1]
                start = (int(h) - int(b.first[doc]) - 1) * HALF
                i, j = lo + np.searchsorted(b.places[lo:hi], [start, start + _SPAN * HALF])
                span = b.terms[i:j].tolist()
                if got := checks[k].leak(span) if is_wide else checks[k].near(span, b.places[i:j]):
                    rows.append((b.ids[doc], b.hashes[doc], units[k].item, *got))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "text_hash", "item_id", "share", "rare_share"])

    hits = encoded.mapInArrow(search, "doc_id long, text_hash long, item_id long, share double, rare_share double")
    hits = hits.groupBy("doc_id", "text_hash", "item_id").agg(F.max("share").alias("share"), F.max("rare_share").alias("rare_share"))
    hits = common.cut(hits, folder, "hits")
    found.destroy()
    return hits


class _Check:
    """The subsequence and answer checks of one unit."""

    def __init__(self, unit: Unit, weight: np.ndarray):
        rare = [int(t) for t in unit.terms if weight[t] > 0]
        self.terms, self.rare = unit.terms.tolist(), rare
        self.n, self.masks = len(unit.terms), _masks(unit.terms)
        self.n_rare, self.rare_masks = len(rare), _masks(rare)
        own = {t for t in unit.answer if weight[t] > 0}
        self.answer = own or set(rare[-ANSWER_WORDS:])
        self.short = unit.whole < SHORT
        self.all_counts, self.rare_counts = Counter(self.terms), Counter(rare)

    def leak(self, span: list[int]) -> tuple[float, float] | None:
        """Shares of all and of rarer words in common, if they make it a leak."""
        have = set(span)
        answered = self.n_rare >= ANSWER_WORDS and self.answer <= have
        if self.n_rare and sum(m for t, m in self.rare_counts.items() if t in have) / self.n_rare < PARAPHRASE:
            return None
        if not answered and sum(m for t, m in self.all_counts.items() if t in have) / self.n < VERBATIM:
            return None
        rare = lcs(self.rare_masks, self.n_rare, span) / self.n_rare if self.n_rare else 0.0
        if self.n_rare and rare < PARAPHRASE:
            return None
        share = lcs(self.masks, self.n, span) / self.n
        return (share, rare) if answered or share >= VERBATIM else None

    def near(self, span: list[int], places: np.ndarray) -> tuple[float, float] | None:
        """The same within twice the unit's length, as a longer span has a few words in order by chance."""
        if 2 * self.n >= _SPAN * HALF or not self.leak(span):
            return self.leak(span)
        found, last = [], -self.n
        for i, at in enumerate(places.tolist()):
            if span[i] in self.all_counts and at - last >= self.n / 4:
                last = at
                found.append(self.leak(span[i : int(np.searchsorted(places, at + 2 * self.n))]))
        return max(filter(None, found), default=None)


class _Verbatim:
    """Finds the items under ``SHORT`` words."""

    def __init__(self, checks: list[_Check]):
        self.short = np.array([c.short for c in checks])
        self.units: dict[int, dict[int, list]] = {}  # by length and hash
        for k in np.flatnonzero(self.short):
            terms = checks[k].terms
            key = int(_grams(np.array(terms, np.int64), len(terms))[0])
            self.units.setdefault(len(terms), {}).setdefault(key, []).append((int(k), terms))

    def found(self, b: _Batch) -> list[tuple[int, int]]:
        """(document's place in the batch, unit), once each."""
        out = set()
        for n, by_key in self.units.items():
            if len(b.terms) < n:
                continue
            keys = _grams(b.terms, n)
            i = np.flatnonzero((b.at[n - 1 :] - b.at[: len(keys)] == n - 1) & np.isin(keys, list(by_key)))
            docs = np.searchsorted(b.token_first, i, "right") - 1
            _, first = np.unique(np.stack([docs, keys[i]]), axis=1, return_index=True)
            for x in first:
                at = i[x]
                out |= {(int(docs[x]), k) for k, terms in by_key[int(keys[at])] if b.terms[at : at + n].tolist() == terms}
        return sorted(out)


class _Bound:
    """Finds every passage whose span has enough of a unit's rarer words for ``_Check``, or of all where it has no rarer ones."""

    def __init__(self, checks: list[_Check], n_terms: int):
        need, pairs = np.ones(len(checks), np.int64), []
        for k, c in enumerate(checks):
            if not c.short:
                need[k] = _least(PARAPHRASE, c.n_rare) if c.n_rare else _least(VERBATIM, c.n)
                pairs += [(t, k) for t in c.rare or c.terms]
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.need, self.unit = need, pairs[:, 1]
        self.size = np.bincount(pairs[:, 0], minlength=n_terms)
        self.first = np.cumsum(np.r_[0, self.size[:-1]])

    def passages(self, b: _Batch) -> np.ndarray:
        """passage * units + unit. A word that several halves of a span have counts each time, so none is missed."""
        half, term = b.pairs(self.size > 0)
        out, n_units = [np.zeros(0, np.int64)], len(self.need)
        if not len(half):
            return out[0]
        parts = np.cumsum(self.size[term]) // _COUNTS
        edges = np.unique(np.r_[half[np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])] - _SPAN, half[-1] + 1])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):  # spans that begin at lo to hi - 1
            i, j = np.searchsorted(half, [lo, hi + _SPAN - 1])
            size = self.size[term[i:j]]
            each = np.repeat(self.first[term[i:j]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            h, u = np.repeat(half[i:j], size), self.unit[each]
            start = (h - np.arange(_SPAN)[:, None]).ravel()
            keys = ((start + _SPAN) * n_units + np.tile(u, _SPAN))[(start >= lo) & (start < hi)]
            keys, counts = np.unique(keys, return_counts=True)
            keys = keys[counts >= self.need[keys % n_units]]
            out.append(keys - (_SPAN - 1) * n_units)  # the passage begins a half after its span
        found = np.concatenate(out)
        return found[(found >= 0) & (found < (b.first[-1]) * n_units)]


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> DataFrame:
    """doc_id, text_hash, item_id, share and rare_share of every text with a leak."""
    spark = docs.sparkSession
    common.tune(spark)
    folder = common.shared_dir(spark, "decontamination")
    answer = (F.col(answer_col) if answer_col else F.lit(None)).cast("string")
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).filter("text IS NOT NULL AND item_id IS NOT NULL")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def judged(block: list[tuple], n: int) -> DataFrame | None:
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, t, _ in block for w in words(t)}))}
        units = _units(block, vocabulary)
        if not units:
            return None
        shared = spark.sparkContext.broadcast(vocabulary)  # the words of a block
        kind = "<u2" if len(vocabulary) < 1 << 16 else "<i4"
        encoded = common.cut(_encoded(texts, shared, kind), folder, f"encoded-{n}")
        shared.destroy()
        hits = _block(encoded, units, len(vocabulary), kind, f"{folder}/block-{n}")
        common.remove(spark, f"{folder}/encoded-{n}")
        return hits

    found = None
    for n, block in enumerate(_blocks(tuple(r) for r in asked.orderBy("item_id", "text").toLocalIterator())):
        if (own := judged(block, n)) is not None:
            found = own if found is None else found.union(own)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, text_hash long, item_id long, share double, rare_share double")
    return found


def _blocks(items: Iterator[tuple]) -> Iterator[list[tuple]]:
    block, size = [], 0
    for item in items:
        n = len(words(item[1]))
        if block and (len(block) == BLOCK or size + n > BLOCK_WORDS):
            yield block
            block, size = [], 0
        block.append(item)
        size += n
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """doc_id, item_id, share and rare_share (largest shares of the item's words, in order) of every leak."""
    found = _leaks(docs, benchmark, id_col, text_col, answer_col).groupBy("doc_id", "item_id")
    return found.agg(F.max("share").alias("share"), F.max("rare_share").alias("rare_share")).withColumnsRenamed({"doc_id": id_col})


def keep(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` without a leak, with their columns."""
    found = _leaks(docs, benchmark, id_col, text_col, answer_col)
    gone = found.select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(gone["__gone"]) & (F.xxhash64(docs[text_col]) == gone["__hash"])
    return docs.join(gone, same, "left_anti")
