"""Copying selected changes from one document of a pair to the other.

A selection is a table (pair_id, key, whole, inline, table_rows): whole rows, numbers of word-level changes, or keys of
table rows. Which blocks the result has, and in what order, follows from the comparison's rows by joins and a sort; only
rows that are spliced, and list items that join a neighbour's list, go through Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.options import DEFAULTS, CompareOptions
from ..model import Block, Span, dumps, loads, merge_spans
from ..storage import tune
from .compare import compare_tables
from .inline import diff_blocks


def spliced(left: Block, right: Block, to_right: bool, chosen: set[int], o: CompareOptions) -> Block:
    """The target paragraph with the chosen changes taken from the source. Target markers stay where they are, and so
    does what is not compared at its ends."""
    d = diff_blocks([left], [right], o)
    target, source = (right, left) if to_right else (left, right)
    tt, st = (d.b, d.a) if to_right else (d.a, d.b)
    parts: list[tuple[bool, int, int, int]] = []

    def take(own: bool, tokens, i: int, j: int) -> None:
        parts.extend((own, *piece) for t in tokens.all[i:j] for piece in t.pieces)

    take(True, tt, 0, tt.first)
    for s in d.segs:
        t, f = ((s.b0, s.b1), (s.a0, s.a1)) if to_right else ((s.a0, s.a1), (s.b0, s.b1))
        if s.equal or s.change not in chosen:
            take(True, tt, tt.first + t[0], tt.first + t[1])
        else:
            take(False, st, st.first + f[0], st.first + f[1])
    take(True, tt, tt.last, len(tt.all))

    spans, seen = [], 0
    for own, k, i, j in [*parts, (True, len(target.spans), 0, 0)]:
        if own and k >= seen:
            spans += [m for m in target.spans[seen:k] if m.marker]
            seen = k + 1 if k < len(target.spans) else k
        if k < len((target if own else source).spans):
            piece = (target if own else source).spans[k]
            spans.append(piece if piece.obj else Span(piece.text[i:j], piece.fmt))
    return Block(**(vars(target) | {"spans": merge_spans(spans)}))


def spliced_table(left: Block, right: Block, to_right: bool, chosen: set[str], o: CompareOptions) -> Block:
    """The target table with the chosen row changes taken from the source."""
    target, source = (right, left) if to_right else (left, right)
    rows = []
    for kind, i, j in compare_tables(left.rows, right.rows, o):
        key = f"{'' if i is None else i}:{'' if j is None else j}"
        t, s = (j, i) if to_right else (i, j)
        if kind != "eq" and key in chosen:
            rows += [] if s is None else [source.rows[s]]
        elif t is not None:
            rows.append(target.rows[t])
    return Block(**(vars(target) | {"rows": rows}))


def adopted(block: Block, near: list[Block | None], source_doc: str) -> Block:
    """A copied block. A list item joins the list of the first neighbour of its kind, else its list is a new one here."""
    if block.type != "p" or block.list is None:
        return block
    own = block.list
    other = next((b.list for b in near if b and b.type == "p" and b.list and b.list.ordered == own.ordered), None)
    if other:
        changes = {"key": other.key, "override": other.override, "formats": other.formats or own.formats, "starts": other.starts or own.starts}
    else:
        changes = {"key": f"{source_doc}/{own.key or ''}", "override": None}
    return Block(**(vars(block) | {"list": type(own)(**(vars(own) | changes))}))


def replaced(block: Block, start: int, end: int, text: str) -> Block:
    """A paragraph with characters [start, end) of its text replaced. The new words take the format of what they replace;
    objects among it go, markers stay."""
    before, after, markers, at = [], [], [], 0
    fmt = None
    for s in block.spans:
        a, b = at, at + s.size
        at = b
        if s.marker:
            (before if a <= start else after).append(s)
            continue
        if s.obj:
            if b <= start:
                before.append(s)
            elif a >= end:
                after.append(s)
            continue
        if fmt is None or a <= start:
            fmt = s.fmt
        if a < start:
            before.append(Span(s.text[: start - a], s.fmt))
        if b > end:
            after.append(Span(s.text[max(0, end - a) :], s.fmt))
    new = [Span(text, fmt) if fmt else Span(text)] if text else []
    return Block(**(vars(block) | {"spans": merge_spans(before + markers + new + after)}))


def _listed(body: Column) -> Column:
    """Whether a block's JSON is that of a list item, or has one in it."""
    return F.contains(body, F.lit('"list":'))


def select_all(rows: DataFrame) -> DataFrame:
    """A selection of every change."""
    return rows.filter("kind <> 'eq'").select("pair_id", "key", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("inline"), F.array().cast("array<string>").alias("table_rows"))


def select_hunks(numbered: DataFrame, hunks) -> DataFrame:
    """A selection of whole hunks; ``hunks`` is a condition on the column ``hunk``."""
    return select_all(numbered.filter((F.col("hunk") >= 0) & hunks))


def select_inline(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """A selection of word-level changes: ``changes`` has pair_id, key and change of changed rows."""
    chosen = rows.filter("kind = 'mod'").select("pair_id", "key").join(changes.select("pair_id", "key", F.col("change").cast("int").alias("change")), ["pair_id", "key"])
    return chosen.groupBy("pair_id", "key").agg(F.lit(False).alias("whole"), F.sort_array(F.collect_set("change")).alias("inline"), F.array().cast("array<string>").alias("table_rows"))


def select_table_rows(rows: DataFrame, table_rows: DataFrame) -> DataFrame:
    """A selection of rows of changed tables: ``table_rows`` has pair_id, row_key and key, as the comparison gives them."""
    tables = rows.filter("kind = 'table'").select("pair_id", F.col("key").alias("row_key"))
    chosen = tables.join(table_rows.filter("kind <> 'eq'").select("pair_id", "row_key", "key"), ["pair_id", "row_key"])
    grouped = chosen.groupBy("pair_id", F.col("row_key").alias("key")).agg(F.sort_array(F.collect_set(chosen["key"])).alias("table_rows"))
    return grouped.select("pair_id", "key", F.lit(False).alias("whole"), F.array().cast("array<int>").alias("inline"), "table_rows")


def swapped_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with their documents the other way round; their marks go with ``review.swapped``."""
    other = {"left": "right", "right": "left"}
    return pairs.select(*[F.col(other.get(c, c)).alias(c) for c in pairs.columns])


def apply_selection(rows: DataFrame, selection: DataFrame, target: DataFrame, to_right: bool = True, o: CompareOptions = DEFAULTS) -> DataFrame:
    """Blocks (pair_id, pos, id, body, copied) of each pair's target after the selected changes.

    ``target`` has the target's blocks (pair_id, pos, id, body), with those the comparison leaves out: they stay before
    the visible block that follows them, and an added block comes after them.
    """
    mine, other = ("r", "l") if to_right else ("l", "r")
    chosen = rows.join(selection, ["pair_id", "key"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)) & (F.col("kind") != "eq"))
    partial = lambda kind, c: (F.col("kind") == kind) & (F.size(F.coalesce(c, F.array())) > 0)
    t_id, t_body, s_id, s_body, t_at = (F.col(x) for x in (f"{mine}_block", f"{mine}_body", f"{other}_block", f"{other}_body", f"{mine}i"))
    how = (
        F.when(F.col("whole") & s_id.isNotNull(), "copy").when(F.col("whole") | t_id.isNull(), "drop")
        .when(partial("mod", "inline"), "splice").when(partial("table", "table_rows"), "rows").otherwise("keep")
    )
    acted = chosen.withColumn("how", how).withColumn("at", t_at).withColumn("id", F.when(F.col("how") == "copy", s_id).otherwise(t_id))
    # Rows go on with one body, and with others only where those are looked at: what is spliced with both sides, and a copied
    # list item with the block it stands for.
    acted = acted.withColumn("body", F.when(F.col("how") == "copy", s_body).otherwise(t_body)).withColumn("had", F.when((F.col("how") == "copy") & _listed(s_body), t_body))
    acted = acted.withColumns({c: F.when(F.col("how").isin("splice", "rows"), F.col(c)) for c in ("l_body", "r_body")})
    shown = acted.select("pair_id", "at", F.when(t_id.isNull(), 1).otherwise(2).alias("part"), "row_no", "id", "body", "how", "had", "l_body", "r_body", "inline", "table_rows")

    seen = rows.filter(F.col(f"{mine}_block").isNotNull()).select("pair_id", F.col(f"{mine}_block").alias("id"), F.lit(1).alias("seen"))
    order = Window.partitionBy("pair_id").orderBy("pos")
    # Blocks are placed without their bodies, which only the hidden ones need again.
    placed = target.select("pair_id", "pos", "id").join(seen, ["pair_id", "id"], "left").withColumn("at", F.coalesce(F.count("seen").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    placed = placed.filter("seen IS NULL").join(target, ["pair_id", "pos", "id"])
    none = {"how": F.lit("hidden"), "had": F.lit(None).cast("string"), "l_body": F.lit(None).cast("string"), "r_body": F.lit(None).cast("string"), "inline": F.lit(None).cast("array<int>"), "table_rows": F.lit(None).cast("array<string>")}
    hidden = placed.select("pair_id", "at", F.lit(0).alias("part"), F.col("pos").cast("int").alias("row_no"), "id", "body", *[v.alias(k) for k, v in none.items()])
    place = Window.partitionBy("pair_id").orderBy("at", "part", "row_no")
    every = shown.filter("how <> 'drop'").unionByName(hidden)
    near = F.when(_listed(F.col("body")), F.col("body")).otherwise(F.lit(""))  # of neighbours only list items matter
    visible, own = F.when(F.col("how") != "hidden", near), F.when(F.col("how").isin("keep", "splice", "rows"), near)
    every = every.withColumn("before", F.last(visible, ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, -1)))
    every = every.withColumn("after", F.first(own, ignorenulls=True).over(place.rowsBetween(1, Window.unboundedFollowing)))
    every = every.withColumn("pos", F.row_number().over(place) - 1)

    # Only rows that are spliced or join a list are given to Python; the others go past it as nulls.
    python = F.col("how").isin("splice", "rows") | ((F.col("how") == "copy") & _listed(F.col("body")))
    given = [F.when(python, F.col(c)) for c in ("how", "pair_id", "body", "l_body", "r_body", "inline", "table_rows", "had", "before", "after")]

    @F.pandas_udf("string")
    def made(how: pd.Series, pair: pd.Series, body: pd.Series, left: pd.Series, right: pd.Series, inline: pd.Series, sub: pd.Series, had: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(how), dtype=object)
        for i in how.index[how.notna()]:
            if how[i] == "splice":
                b = spliced(loads(left[i]), loads(right[i]), to_right, set(map(int, inline[i])), o)
            elif how[i] == "rows":
                b = spliced_table(loads(left[i]), loads(right[i]), to_right, set(sub[i]), o)
            else:
                b = adopted(loads(body[i]), [loads(x) if x else None for x in (had[i], before[i], after[i])], pair[i])
            out[i] = dumps(b)
        return out

    tune(rows.sparkSession)
    return every.select("pair_id", "pos", "id", F.coalesce(made(*given), "body").alias("body"), F.col("how").isin("copy", "splice", "rows").alias("copied"))


def as_blocks(merged: DataFrame) -> DataFrame:
    """pair_id and the ordered block list of a merged document."""
    items = merged.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "body"))).alias("b"))
    return items.select("pair_id", F.transform("b", lambda x: F.struct(x["id"].alias("id"), x["body"].alias("body"))).alias("blocks"))
