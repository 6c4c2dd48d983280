"""Comparison of document pairs: which blocks are equal, changed, removed or added.

A pair is one row with both block lists, so pairs are independent and go through the kernel in Arrow batches of bounded
size without a shuffle of their own. What uses the rows of a comparison more than once should write them first
(``storage.once``).

Defined results: a null block list is an empty one; a pair of two empty ones has no rows; pairs of one id are compared each
on its own and give rows of that id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.options import DEFAULTS, CompareOptions
from ..functions.tokens import block_sig, dice, row_sig, skipped, word_bag
from ..model import Block, Row, loads
from ..storage import tune
from .sequence import edit_runs, interned, pair_up, regions

ROWS = "pair_id string, row_no int, key string, kind string, l_block string, r_block string, l_body string, r_body string, li int, ri int"
TABLE_ROWS = "pair_id string, row_key string, sub_no int, key string, kind string, l_row int, r_row int"


def _steps(left: list, right: list, sig, bag, fits) -> Iterator[tuple[bool, int | None, int | None]]:
    """(equal stretch, left place, right place) of two lists of blocks or table rows."""
    a, b = interned([sig(x) for x in left], [sig(x) for x in right])
    bags: tuple[dict, dict] = ({}, {})

    def of(side: int, k: int):
        if k not in bags[side]:
            bags[side][k] = bag((left, right)[side][k])
        return bags[side][k]

    for equal, a0, a1, b0, b1 in regions(edit_runs(a, b)):
        if equal:
            yield from ((True, a0 + k, b0 + k) for k in range(a1 - a0))
            continue
        alike = lambda i, j: dice(of(0, a0 + i), of(1, b0 + j))  # noqa: B023, E731
        may = lambda i, j: fits(left[a0 + i], right[b0 + j])  # noqa: B023, E731
        for i, j in pair_up(a1 - a0, b1 - b0, alike, may):
            yield False, None if i is None else a0 + i, None if j is None else b0 + j


def compare_blocks(left: list[Block], right: list[Block], o: CompareOptions = DEFAULTS) -> list[tuple]:
    """Rows (kind, left block, right block, li, ri) of two documents' visible blocks."""
    lv, rv = ([b for b in side if not skipped(b, o)] for side in (left, right))
    sigs: dict[int | str, str] = {}

    def sig(b: Block) -> str:
        key = b.source or id(b)  # blocks of equal JSON are signed once
        if key not in sigs:
            sigs[key] = block_sig(b, o)
        return sigs[key]

    out, li, ri = [], 0, 0
    for equal, i, j in _steps(lv, rv, sig, lambda b: word_bag([b], o), lambda x, y: x.type == y.type):
        l, r = None if i is None else lv[i], None if j is None else rv[j]
        if l is None or r is None:
            kind = "ins" if l is None else "del"
        elif equal or sig(l) == sig(r):
            kind = "eq"
        else:
            kind = "table" if l.type == r.type == "table" else "mod"
        out.append((kind, l, r, li, ri))
        li, ri = li + (l is not None), ri + (r is not None)
    return out


def compare_tables(left: list[Row], right: list[Row], o: CompareOptions = DEFAULTS) -> list[tuple]:
    """Rows (kind, left place, right place) of two tables. Paired rows of a changed stretch count as changed."""
    bag = lambda r: word_bag([b for c in r.cells for b in c.blocks], o)
    steps = _steps(left, right, lambda r: row_sig(r, o), bag, lambda x, y: True)
    return [("eq" if equal else "ins" if i is None else "del" if j is None else "mod", i, j) for equal, i, j in steps]


def row_key(kind: str, l: str | None, r: str | None) -> str:
    return f"{kind[0]}:" + ":".join(x for x in (l, r) if x is not None)


def compare_pairs(pairs: DataFrame, o: CompareOptions = DEFAULTS) -> DataFrame:
    """Rows of each pair. ``pairs``: pair_id, and left and right as arrays of (id, body)."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pair, left, right in zip(batch["pair_id"], batch["left"], batch["right"], strict=True):
                sides = []
                for blocks in (left, right):
                    sides.append([])
                    for x in blocks if blocks is not None else ():
                        b = loads(x["body"])
                        b.id, b.source = x["id"], x["body"]
                        sides[-1].append(b)
                for n, (kind, l, r, li, ri) in enumerate(compare_blocks(*sides, o)):
                    lid, rid = (None if b is None else b.id for b in (l, r))
                    out.append((pair, n, row_key(kind, lid, rid), kind, lid, rid, l and l.source, r and r.source, li, ri))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    slim = lambda c: F.transform(c, lambda b: F.struct(b["id"].alias("id"), b["body"].alias("body"))).alias(c)
    tune(pairs.sparkSession)
    return pairs.select(F.col("pair_id").cast("string").alias("pair_id"), slim("left"), slim("right")).mapInPandas(kernel, ROWS)


def compare_table_rows(rows: DataFrame, o: CompareOptions = DEFAULTS) -> DataFrame:
    """Table rows of each row of kind table."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pair, key, left, right in zip(batch["pair_id"], batch["key"], batch["l_body"], batch["r_body"], strict=True):
                for n, (kind, i, j) in enumerate(compare_tables(loads(left).rows, loads(right).rows, o)):
                    name = f"{'' if i is None else i}:{'' if j is None else j}"
                    out.append((pair, key, n, name, kind, i, j))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in TABLE_ROWS.split(", ")])
            yield frame.astype({"l_row": "Int32", "r_row": "Int32"})

    tune(rows.sparkSession)
    return rows.filter(F.col("kind") == "table").select("pair_id", "key", "l_body", "r_body").mapInPandas(kernel, TABLE_ROWS)
