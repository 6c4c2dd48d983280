"""Token-ID files: concatenated ids with Elias-Fano document boundaries.

A data set is a folder of shards, in ascending order of document id, and a manifest. A shard is

    magic "PTOK", version, id width in bytes        8 bytes
    ids of all its documents                        little-endian, ``width`` bytes each
    document ids, Elias-Fano                        less the smallest; null ids stand first and are only counted
    document boundaries, Elias-Fano                 n_docs + 1 values, from 0
    footer                                          places and counts, fixed size, last

so that ``Shard.boundaries.select(i)`` gives a document's offset without a table of 64-bit offsets; a reader of all
documents decodes ``READ_DOCS`` boundaries at a time. The manifest has one row for each shard: its file, documents, ids,
and the ids of all shards before it.

Defined results: a null or empty text is a document of the end id alone; documents of one id, or of none (null), stand
next to each other, null first, by a hash of their text and then in any order, so that one id can fill several shards;
other columns are dropped; an empty table makes a data set without shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import WordEncoder
from .elias_fano import EliasFano
from .files import Atomic, store

MAGIC = b"PTOK"
_FOOT = "<QQqQQQ"  # ids, null ids, smallest id, bytes of ids, of document ids, of boundaries
#: Bytes of ids, and documents, read at once from a shard.
READ_BYTES = 8 << 20
READ_DOCS = 4096

MANIFEST = "shard int, file string, n_docs long, n_ids long"


def write(docs: DataFrame, folder: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text with the word-end BPE file at ``path``, append ``end_id``, and write the data set.

    Texts are dealt by ranges of their ids, so each task writes one shard of the global order. Only the manifest, a
    row for each shard, comes to the driver.
    """
    spark = docs.sparkSession
    common.tune(spark)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder = WordEncoder(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        number = TaskContext.get().partitionId()
        name, keys, lengths = f"shard-{number:08d}.ptok", [], []
        with Atomic(f"{folder}/{name}") as out:
            out.write(MAGIC + bytes([1, encoder.width, 0, 0]))
            n_bytes = 0
            while first is not None:
                for text in first.column(1):
                    ids = encoder.encode(text.as_py()) + end
                    out.write(ids)
                    n_bytes += len(ids)
                    lengths.append(len(ids) // encoder.width)
                keys.append(first.column(0).to_numpy(zero_copy_only=False) if not first.column(0).null_count else np.array(first.column(0).to_pylist(), object))
                first = next((b for b in batches if b.num_rows), None)
            nulls = sum(int(sum(x is None for x in k)) for k in keys if k.dtype == object)
            known = np.array([x for k in keys for x in k if x is not None], np.int64) if nulls else np.concatenate(keys).astype(np.int64)
            least = int(known[0]) if len(known) else 0
            coded = EliasFano.encode(known - least), EliasFano.encode(np.concatenate([[0], np.cumsum(lengths)]))
            out.write(coded[0] + coded[1])
            out.write(struct.pack(_FOOT, len(lengths), nulls, least, n_bytes, len(coded[0]), len(coded[1])))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "file": [name], "n_docs": [len(lengths)], "n_ids": [sum(lengths)]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("row"))
    keys = [F.col("id").asc_nulls_first(), "h", "row"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    rows = sorted(ordered.mapInArrow(shard, MANIFEST).collect())
    starts = np.concatenate([[0], np.cumsum([r.n_ids for r in rows])]).tolist()
    manifest = [(i, r.file, r.n_docs, r.n_ids, starts[i]) for i, r in enumerate(rows)]
    return spark.createDataFrame(manifest, MANIFEST + ", first long")


class Shard:
    """One shard, opened for reading."""

    def __init__(self, uri: str):
        fs, path = store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        head = self.file.read_at(8, 0)
        if head[:4] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.dtype = np.dtype(f"<u{head[5]}")
        self.n_docs, self.nulls, self.least, n_bytes, keys, bounds = struct.unpack(_FOOT, self.file.read_at(struct.calcsize(_FOOT), size - struct.calcsize(_FOOT)))
        coded = self.file.read_at(keys + bounds, 8 + n_bytes)
        self.keys, self.boundaries = EliasFano(coded[:keys]), EliasFano(coded[keys:])

    def ids(self, first: int, last: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((last - first) * width, 8 + first * width), self.dtype)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the shard, by two selects and one read."""
        return self.ids(self.boundaries.select(i), self.boundaries.select(i + 1))

    def doc_ids(self, first: int = 0, last: int | None = None) -> list[int | None]:
        last = self.n_docs if last is None else last
        known = self.keys.values(max(0, first - self.nulls), max(0, last - self.nulls)) + self.least
        return [None] * max(0, min(last, self.nulls) - first) + known.tolist()

    def blocks(self) -> Iterator[tuple[int, np.ndarray, Iterator[np.ndarray]]]:
        """First document, boundaries (one more than documents) and ids by document, of ``READ_DOCS`` documents at a time."""
        for i in range(0, self.n_docs, READ_DOCS):
            bounds = self.boundaries.values(i, min(i + READ_DOCS, self.n_docs) + 1)
            yield i, bounds, self._each(bounds)

    def _each(self, bounds: np.ndarray) -> Iterator[np.ndarray]:
        step, i, n = READ_BYTES // self.dtype.itemsize, 0, len(bounds) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + step, "right")) - 1)
            block = self.ids(int(bounds[i]), int(bounds[j]))
            yield from np.split(block, bounds[i + 1 : j] - bounds[i])
            i = j


def read(spark: SparkSession, manifest: DataFrame, folder: str, id_name: str = "doc_id") -> DataFrame:
    """Per document of the data set: id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(f"{folder}/{name}")
                for i, bounds, each in shard.blocks():
                    keys = shard.doc_ids(i, i + len(bounds) - 1)
                    sums = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in each]
                    yield pa.RecordBatch.from_pydict({id_name: pa.array(keys, pa.int64()), "start": bounds[:-1] + first, "n_tokens": np.diff(bounds), "ids_crc32": pa.array(sums, pa.int64())})

    n = max(1, manifest.count())
    files = manifest.select("file", "first", "shard").repartitionByRange(n, "shard").select("file", "first")
    return files.mapInArrow(documents, f"{id_name} long, start long, n_tokens long, ids_crc32 long")
