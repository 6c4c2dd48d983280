"""MinHash near-deduplication with b-bit signatures.

A document's set has its distinct shingles of ``SHINGLE`` words; documents are linked where 100 * intersection >= 80 *
union, and a group is what links connect.

1. One pass over the texts makes 128 minima per set. Bands of four are candidate keys: sets of similarity 0.8 miss all 32
   with probability 5e-8. Of each minimum the lowest four bits are kept, packed as bit planes.
2. Documents of one set collapse into a class; only classes go on.
3. In each candidate bucket every member is paired with one pivot, never with every other. A pair whose signatures'
   bit count, corrected for chance collisions, puts it clearly below the threshold is dropped (the margin is over
   five standard deviations); every other pair is confirmed on the full sets.
4. A link can also join two members neither of which is a pivot. In buckets that still hold several components, members
   with too many shingles of their own to be linked with any other go (an exact bound). The others get further pivots,
   the most central members first, and what is then left is compared across components: pair by pair where the bound
   allows a link, and in large buckets block by block, where a task gets two blocks and only links that connect come out.
   A class is in one block, whatever number of buckets it is in, and two blocks meet once. Pairs inside one component
   need no comparison: they cannot change the groups.

Buckets, pivots and pairs are joins on written tables, which Spark splits where a key is hot. Tables are removed when
nothing reads them any more.

Defined results: words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; a text with fewer words than a shingle has its whole
sequence as its one shingle; a null or wordless text has an empty set, and is a group of its own; rows of one id are one
node, linked with all that any of their texts is linked with; a row without an id takes part by its text, and its
component is the smallest id reachable, or null where no row of the group has an id (``groups`` marks all rows of such a
group as kept); ``keep`` leaves one row of each group: of rows that share the smallest id any one, of a group without
ids one of the smallest text hash, and all rows with an empty set but for those that repeat an id; other columns are
dropped by ``groups`` and kept by ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Words of a shingle: the default, and what the query's contract asks for.
SHINGLE = 5
PERCENT = 80
PERMUTATIONS = 128
ROWS = 4
BITS = 4
#: Estimates this far below the threshold are no links: over five standard deviations of the estimate.
MARGIN = 0.22
#: Rounds of pivots before the rest is compared pair by pair.
PIVOT_ROUNDS = 2
#: The rest is small enough to compare when it has this many pairs per member of its buckets.
REST = 4
#: Buckets of more members than this are compared in blocks of about ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles.
BIG = 64
BLOCK = 512
BLOCK_SHINGLES = 1 << 18
#: Classes up to this many, of 32 bytes each, are broadcast to find their texts.
BROADCAST_ROWS = 400_000
_CHUNK = 1 << 16
_WORDS = 200_000

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX[3])
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX[3])
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of texts, as sorted 64-bit hashes of shingles."""

    def __init__(self, size: int = SHINGLE):
        import xxhash

        self.size, self.hash, self.known = size, xxhash.xxh3_64_intdigest, {}

    def _of(self, word: bytes) -> int:
        if len(self.known) >= _WORDS:
            self.known.clear()
        value = self.known[word] = self.hash(word)
        return value

    def set_of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known, of = self.known, self._of
        h = np.fromiter([known.get(w) or of(w) for w in words], np.uint64, len(words))
        n = min(self.size, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mixed(out * np.uint64(_MIX[0]) + h[k : len(h) - n + 1 + k] * np.uint64(_MIX[1]) + np.uint64(_MIX[2]))
        return np.unique(out)


def _permutations() -> np.ndarray:
    random = np.random.default_rng(11)
    return random.integers(0, 1 << 32, (PERMUTATIONS, 2), dtype=np.uint32) | np.array([0, 1], np.uint32)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of non-empty sets, one row each."""
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = np.concatenate(sets)
    x = (x >> np.uint64(32)).astype(np.uint32) ^ x.astype(np.uint32)
    for k, (a, b) in enumerate(_permutations()):
        v = (x ^ a) * b
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(12)
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    bands = m.reshape(len(m), -1, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(ROWS):
        keys = _mixed(keys * np.uint64(_MIX[0]) + bands[:, :, k] + np.uint64(_MIX[2]))
    return keys


def planes(m: np.ndarray) -> np.ndarray:
    """The lowest bits of the minima: for each bit, the permutations' bits in 64-bit words."""
    bits = np.stack([(m >> np.uint32(b)) & np.uint32(1) for b in range(BITS)], 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").reshape(len(m), -1).view("<i8")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two signatures' planes: minima that differ in some bit, corrected for those that agree by chance."""
    words, chance = PERMUTATIONS // 64, 2.0**-BITS
    differ = None
    for w in range(words):
        any_bit = None
        for p in range(BITS):
            x = a[p * words + w].bitwiseXOR(b[p * words + w])
            any_bit = x if any_bit is None else any_bit.bitwiseOR(x)
        differ = F.bit_count(any_bit) if differ is None else differ + F.bit_count(any_bit)
    return (1 - differ / F.lit(PERMUTATIONS) - chance) / (1 - chance)


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """id, h, n, digest, planes, keys of rows (id, h, text)."""
    import xxhash

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            sets = [shingler.set_of(t.as_py()) for t in batch.column(2)]
            full = [i for i, s in enumerate(sets) if len(s)]
            words, bands = PERMUTATIONS // 64 * BITS, PERMUTATIONS // ROWS
            plane, keys = np.zeros((len(sets), words), np.int64), np.zeros((len(sets), bands), np.int64)
            while full:
                n, size = 0, 0
                while n < len(full) and (not n or size + len(sets[full[n]]) <= _CHUNK):
                    size, n = size + len(sets[full[n]]), n + 1
                m = minima([sets[i] for i in full[:n]])
                plane[full[:n]], keys[full[:n]] = planes(m), band_keys(m).view(np.int64)
                full = full[n:]
            lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "h": batch.column(1), "n": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), "planes": lists(plane), "keys": lists(keys)})

    return docs.mapInArrow(sign, "id long, h long, n long, digest binary, planes array<long>, keys array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """rep, set of rows (rep, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            sets = [shingler.set_of(t.as_py()).view(np.int64) for t in batch.column(1)]
            ends = np.cumsum([0] + [len(s) for s in sets])
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["rep", "set"])

    return docs.mapInArrow(make, "rep long, set array<long>")


def _confirmed(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are links, with their similarity."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("planes").alias(f"planes_{c}"), F.col("set").alias(f"set_{c}"))
    near = estimate(F.col("planes_a"), F.col("planes_b")) >= PERCENT / 100 - MARGIN
    both = F.size(F.array_intersect("set_a", "set_b"))
    counted = pairs.join(side("a"), "a").join(side("b"), "b").filter(near)
    counted = counted.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("either"))
    return counted.filter(100 * F.col("both") >= PERCENT * F.col("either")).select("a", "b", (F.col("both") / F.col("either")).alias("similarity"))


def _sized(members: DataFrame, reps: DataFrame) -> DataFrame:
    """key, rep, n, m of members: the size of a member's set, and how many of its shingles some other member has.

    Two sets cannot share more than the smaller m, so a member whose m is under 80 % of its n has no link among these,
    and goes.
    """
    own = reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("set"))
    alone = own.select("rep", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("times"), F.min("rep").alias("rep"))
    alone = alone.filter("times = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    sizes = own.select("rep", F.size("set").cast("long").alias("n")).join(alone, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"))
    return members.join(sizes.filter(100 * F.col("m") >= PERCENT * F.col("n")), "rep").select("key", "rep", "n", "m")


def _can_link(n_a: str, m_a: str, n_b: str, m_b: str) -> Column:
    """Whether sets of these sizes can share enough: similarity s of sizes n needs an intersection of s / (1 + s) * (n_a + n_b)."""
    return (100 + PERCENT) * F.least(m_a, m_b) >= PERCENT * (F.col(n_a) + F.col(n_b))


def _joining(table):
    """Links between components of rows (rep, comp, set), as few as connect what is linked. Intersections are exact: a
    product of incidence matrices over the shingles that two rows have."""
    reps, comps = table.column("rep").to_numpy(), table.column("comp").to_pylist()
    sets = table.column("set").combine_chunks()
    values, sizes = sets.flatten().to_numpy(), np.diff(sets.offsets.to_numpy()).astype(np.int64)
    rows = np.repeat(np.arange(len(reps)), sizes)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    rows, column = rows[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(reps), len(reps)), np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        part = np.zeros((len(reps), 2048), np.float32)
        part[rows[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    either = sizes[:, None] + sizes[None, :] - both
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    out = []
    for i, j in np.argwhere(np.triu(100 * both >= PERCENT * either, 1)):
        x, y = top(comps[i]), top(comps[j])
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((int(min(reps[i], reps[j])), int(max(reps[i], reps[j])), float(both[i, j] / either[i, j])))
    a, b, s = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})


def _in_blocks(members: DataFrame, reps: DataFrame, folder: str) -> DataFrame:
    """Links between components of buckets (key, rep, comp, n), block against block, so that a task has at most two
    blocks and no pair of members is a row.

    A member's home is the largest of its buckets; a home is dealt into blocks. Blocks meet where some bucket has members
    of both, once, however many buckets they share.
    """
    size = members.groupBy("key").agg(F.count("*").alias("size"))
    home = members.join(size, "key").groupBy("rep").agg(F.max(F.struct("size", "key")).alias("home"), F.first("comp").alias("comp"), F.first("n").alias("n"))
    home = common.cut(home.select("rep", "comp", "n", F.col("home.key").alias("home")), folder, "homes")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    dealt = home.join(home.groupBy("home").agg(parts.alias("parts")), "home")
    block = F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("parts")))
    dealt = common.cut(dealt.select("rep", "comp", block.alias("block")), folder, "dealt")
    seen = members.select("key", "rep").join(dealt.select("rep", "block"), "rep").groupBy("key").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    met = F.expr("flatten(transform(blocks, (x, i) -> transform(slice(blocks, i + 1, size(blocks)), y -> struct(x AS i, y AS j))))")
    met = common.cut(seen.select(F.inline(met)).distinct(), folder, "met")
    ends = met.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return ends.join(dealt, "block").join(reps.select("rep", "set"), "rep").groupBy("i", "j").applyInArrow(_joining, "a long, b long, similarity double")


def _linked(members: DataFrame, reps: DataFrame, folder: str) -> DataFrame:
    """node, comp of classes that some link joins. ``members``: key, rep of buckets with several."""
    n = members.count()
    pivots = common.cut(members.groupBy("key").agg(F.min("rep").alias("pivot")), folder, "pivots", n)
    pairs = members.join(pivots, "key").filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    tested = common.cut(pairs, folder, "pairs", n)
    links = common.cut(_confirmed(tested, reps), folder, "links")
    labels = components(links, folder, "groups")
    for turn in range(1, PIVOT_ROUNDS + 1):
        owned = labels.select(F.col("node").alias("rep"), "comp")
        placed = members.join(owned, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        placed = common.cut(placed, folder, f"placed-{turn}", n)
        sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"), F.count("*").alias("comps"))
        mixed = common.cut(sizes.filter("comps > 1"), folder, f"mixed-{turn}", n)
        if turn == 1:
            # A bucket of two is done: its one pair is tested.
            active = common.cut(placed.join(mixed.filter("n > 2").select("key"), "key").select("key", "rep"), folder, "active-all", n)
            members = common.cut(_sized(active, reps), folder, "sized", n)
            placed = common.cut(members.join(owned, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), folder, "active-1", n)
        else:
            placed = common.cut(placed.join(mixed.select("key"), "key"), folder, f"active-{turn}", n)
        sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
        left = sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2).alias("pairs"), F.sum("n").alias("n")).first()
        if not left.pairs:
            return labels
        if left.pairs <= REST * left.n or turn == PIVOT_ROUNDS:
            break
        ends = links.select(F.col("a").alias("rep"), "similarity").union(links.select("b", "similarity"))
        central = common.cut(ends.groupBy("rep").agg(F.max("similarity").alias("centre")), folder, f"central-{turn}", n)
        choice = F.struct(F.coalesce("centre", F.lit(0.0)), "rep") if turn == 1 else F.struct(F.col("centre").isNotNull(), F.xxhash64("rep", F.lit(turn)), "rep")
        chosen = F.max_by(F.struct(F.col("rep").alias("pivot"), F.col("comp").alias("pivot_comp"), F.col("n").alias("pivot_n"), F.col("m").alias("pivot_m")), choice)
        pivots = common.cut(placed.join(central, "rep", "left").groupBy("key").agg(chosen.alias("p")).select("key", "p.*"), folder, f"pivots-{turn}", n)
        pairs = placed.join(pivots, "key").filter(F.col("comp") != F.col("pivot_comp")).filter(_can_link("n", "m", "pivot_n", "pivot_m"))
        pairs = pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        pairs = common.cut(pairs.join(tested, ["a", "b"], "left_anti"), folder, f"pairs-{turn}", n)
        tested = tested.union(pairs)
        links = links.union(common.cut(_confirmed(pairs, reps), folder, f"links-{turn}"))
        labels = components(links, folder, f"groups-{turn}")
    big = common.cut(sizes.filter(F.col("n") > BIG).select("key"), folder, "big", n)
    if not big.isEmpty():
        links = links.union(common.cut(_in_blocks(placed.join(big, "key"), reps, folder), folder, "links-blocks", n))
        placed = placed.join(big, "key", "left_anti")
    other = placed.select("key", F.col("rep").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("m").alias("m_b"))
    crossed = placed.withColumnsRenamed({"rep": "a"}).join(other, "key").filter("comp < comp_b").filter(_can_link("n", "m", "n_b", "m_b"))
    crossed = crossed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    fresh = common.cut(crossed.join(tested, ["a", "b"], "left_anti"), folder, "rest")
    links = links.union(common.cut(_confirmed(fresh, reps), folder, "links-rest"))
    return components(links, folder, "groups-rest")


def _grouped(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, h (a hash of its text), n, comp (a number of its group; null without shingles) and first, the smallest
    id of the group."""
    spark = docs.sparkSession
    common.tune(spark)
    folder = common.shared_dir(spark, "near-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    signed = common.cut(_signed(rows, shingle), folder, "signed")
    # Numbers of classes are made once, as the table is written. ``h`` finds one text of the class again.
    classes = signed.filter("n > 0").groupBy("digest").agg(F.min("id").alias("first"), F.min(F.struct("h", "id")).alias("of"), F.first("planes").alias("planes"), F.first("keys").alias("keys"))
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), "digest", "first", F.col("of.h").alias("h"), F.col("of.id").alias("id"), "planes", "keys")
    classes = common.cut(classes, folder, "classes")
    keyed = classes.select("rep", F.explode("keys").alias("key"))
    shared = common.cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), folder, "shared")
    members = common.cut(keyed.join(shared, "key").select("key", "rep").distinct(), folder, "members")
    needed = classes.join(members.select("rep").distinct(), "rep", "left_semi")
    needed = common.cut(needed.select("rep", F.xxhash64("id", "h").alias("key"), F.col("id").alias("n_id"), F.col("h").alias("n_h")), folder, "needed")
    # Few are broadcast, and texts then stay where they are read; many meet the texts in a shuffle.
    asked = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    found = rows.withColumn("key", F.xxhash64("id", "h")).join(asked, "key").filter(F.col("id").eqNullSafe(F.col("n_id")) & (F.col("h") == F.col("n_h")))
    sets = _sets(found.select("rep", "text"), shingle).groupBy("rep").agg(F.first("set").alias("set"))
    reps = common.cut(sets.join(classes.select("rep", "planes"), "rep"), folder, "sets")
    linked = _linked(members, reps, f"{folder}/links").select(F.col("node").alias("rep"), "comp")
    named = classes.select("digest", "rep", "first").join(linked, "rep", "left").select("digest", "first", F.coalesce("comp", "rep").alias("comp"))
    own = common.cut(signed.select("id", "h", "n", "digest").join(named, "digest", "left").select("id", "h", "n", "first", "comp"), folder, "own")
    common.remove(spark, f"{folder}/links", *(f"{folder}/{t}" for t in ("signed", "classes", "shared", "members", "needed", "sets")))
    # An id with texts in several groups makes them one.
    split = own.filter("id IS NOT NULL AND comp IS NOT NULL").groupBy("id").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b")
    split = common.cut(split.select("id", "a"), folder, "split")
    if not split.isEmpty():
        edges = own.join(split, "id").filter("comp <> a").select("a", F.col("comp").alias("b"))
        joined = components(edges, folder, "ids").select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        own = own.join(joined, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")
    firsts = common.cut(own.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("first").alias("smallest")), folder, "firsts")
    return own.join(firsts, "comp", "left").select("id", "h", "n", "comp", F.col("smallest").alias("first"))


def groups(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable), kept (whether it is that one)."""
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("first"))
    out = _grouped(docs, shingle, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns: one document of each group."""
    spark = docs.sparkSession
    folder = common.shared_dir(spark, "near-dedup-keep")
    rows = common.cut(_grouped(docs, shingle, id_col, text_col), folder, "rows")
    gone = common.cut(rows.filter("n > 0 AND id <> first").select(F.col("id").alias("__gone")).distinct(), folder, "gone")
    again = common.cut(rows.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("__again")), folder, "again")
    left = docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti").filter(F.col(id_col).isNotNull())
    once = left.join(again, left[id_col].cast("long") == again["__again"], "left_anti")
    if not again.isEmpty():
        once = once.union(left.join(again, left[id_col].cast("long") == again["__again"], "left_semi").dropDuplicates([id_col]))
    bare = rows.filter("id IS NULL")
    if bare.isEmpty():
        return once
    chosen = common.cut(bare.filter("n > 0 AND first IS NULL").groupBy("comp").agg(F.min("h").alias("__h")).select("__h"), folder, "chosen")
    empty = common.cut(bare.filter("n = 0").select(F.col("h").alias("__h")).distinct(), folder, "empty")
    hashed = docs.filter(F.col(id_col).isNull()).withColumn("__own", F.xxhash64(text_col))
    first = hashed.join(chosen, F.col("__own") == F.col("__h"), "left_semi").dropDuplicates(["__own"])
    wordless = hashed.join(empty, F.col("__own") == F.col("__h"), "left_semi")
    return once.union(first.drop("__own")).union(wordless.drop("__own"))
