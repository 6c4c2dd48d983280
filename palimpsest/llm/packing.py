"""Best-fit packing, planned over the histogram of lengths.

A piece is at most a sequence long, so lengths take as many values as a sequence has tokens: the plan is made from at
most that many (length, count) rows, whatever the number of documents. Best-fit decreasing runs over counts: bins of
one state are one group, and a length fills a group's bins together. The plan is a list of slots, runs of equal places:
pieces of a length with ranks from ``first`` to ``last`` go ``each`` to a sequence, from sequence ``sequence`` and
place ``offset`` on. Pieces then take their places by a join on length and rank.

Defined results: a null or empty text is a piece of the separator alone; rows keep their multiplicity (of equal ids,
each is packed); other columns are dropped; an empty table packs into nothing.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bpe import WordEncoder

SEQUENCE = 2048
#: Pieces of one length are ranked in parts of about this many, so that a length a third of all pieces have is no single
#: task's; the parts are as many as the most frequent length asks for.
RANK_ROWS = 4096
RANK_PARTS = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end_id: int = 0, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of each encoded text: doc_id, piece, start, length and checksum. Only texts over ``size`` are cut."""
    common.tune(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(encoder.encode(text.as_py()) + end, encoder.dtype).astype("<u4")
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append((key, k, at, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, PIECES)


def plan(histogram: list[tuple[int, int]], size: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, first, last, each, sequence, offset) for counts of lengths, and the number of sequences.

    ``free`` has the groups of open bins by what is left in them: (left, first sequence, bins), sorted. Best fit takes
    the group with the least left that still has room. As a bin's room shrinks, it stays the best fit until the length
    no longer goes in, so each of a group's bins takes left // length pieces.
    """
    slots, free, used = [], [], 0
    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            k = bisect.bisect_left(free, (length, -1, -1))
            if k == len(free):
                each = size // length
                bins = -(-(count - rank) // each)
                left, sequence = size, used
                used += bins
            else:
                left, sequence, bins = free.pop(k)
                each = left // length
            filled = min(bins, (count - rank) // each)
            over = count - rank - filled * each if filled < bins else 0
            if filled:
                slots.append((length, rank, rank + filled * each, each, sequence, size - left))
                if left - each * length:
                    bisect.insort(free, (left - each * length, sequence, filled))
            rank += filled * each
            if over:
                slots.append((length, rank, rank + over, over, sequence + filled, size - left))
                rank += over
                filled += 1
                if left - over * length:
                    bisect.insort(free, (left - over * length, sequence + filled - 1, 1))
            if filled < bins:
                bisect.insort(free, (left, sequence + filled, bins - filled))
    return slots, used


def ranked(cut_pieces: DataFrame, parts: int) -> DataFrame:
    """``rank``, from 0, of each piece among those of its length: its place in its part, after the parts before it.
    ``row`` is a number of its own, so rows that repeat an id are dealt like any."""
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part")
    dealt = cut_pieces.select("*", part)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "part").orderBy("row")
    own = dealt.withColumn("own", F.row_number().over(order) - 1)
    return own.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own")).drop("part", "own", "base", "row")


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    folder = common.shared_dir(spark, "packing")
    done = common.cut(pieces(docs, path, end_id, size, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), folder, "pieces")
    histogram = [(r.length, r.n) for r in done.groupBy("length").agg(F.count("*").alias("n")).collect()]  # at most ``size`` rows
    slots, _ = plan(histogram, size)
    names = "of long, first long, last long, each long, sequence long, place long"
    table = spark.createDataFrame(slots, names)
    # A length has a handful of slots; the whole plan is bounded by the number of lengths and is checked before it is sent.
    table = F.broadcast(table) if len(slots) <= 64 * size else table
    parts = min(RANK_PARTS, -(-max((n for _, n in histogram), default=1) // RANK_ROWS))
    r = ranked(done, parts)
    joined = r.join(table, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    step = F.col("rank") - F.col("first")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + step % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
