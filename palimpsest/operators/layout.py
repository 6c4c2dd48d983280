"""What a comparison shows, as tables: lines of aligned rows, lengths, list labels, column offsets, undo, and sessions.

Defined results: null bodies count as nothing; lines, items and events are told apart by the columns that order them, and
of equal ones any comes first; empty tables give empty results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import format_number
from ..model import Block, Row, loads
from ..storage import tune

# An object counts as a short word; bullets by level, and characters of symbol fonts that stand for bullets.
OBJECT_LENGTH = 6
BULLETS = ["•", "◦", "▪"]
SYMBOLS = {
    "\uf0b7": "•", "\uf0a7": "▪", "\uf0a8": "◆", "\uf0d8": "➢", "\uf0fc": "✓", "\uf076": "❖", "\uf0e0": "➔", "\uf06f": "○", "\uf0a1": "○", "\uf02d": "–", "o": "◦", "§": "▪",
}
LEVEL_FORMATS = ["decimal", "lowerLetter", "lowerRoman"]
UNDO_DEPTH = 200
SESSIONS_KEPT = 8

# ------------------------------------------------------------------ lengths and lines


def text_length(b: Block) -> int:
    """Rough length of a block's text: an empty paragraph still takes a line."""
    if b.type == "p":
        return max(1, sum(OBJECT_LENGTH if s.obj else len(s.text) for s in b.spans if not s.marker))
    if b.type == "table":
        return sum(map(row_length, b.rows))
    return max(1, sum(map(text_length, b.blocks))) if b.type == "opaque" else 0


def row_length(r: Row) -> int:
    return max(1, sum(text_length(b) for c in r.cells for b in c.blocks))


def columns_of(body: Column) -> Column:
    """Columns of a table (the JSON of its block): what the widest row spans, one at least."""
    rows = F.from_json(body, "rows array<struct<cells:array<struct<colspan:int>>>>")["rows"]
    spans = F.transform(rows, lambda r: F.aggregate(r["cells"], F.lit(0), lambda n, c: n + F.coalesce(c["colspan"], F.lit(1))))
    return F.greatest(F.lit(1), F.coalesce(F.array_max(spans), F.lit(1)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def lengths(bodies: pd.Series) -> pd.Series:
    """The length of a block, then those of its table rows."""

    def one(body):
        if not body:
            return [0]
        b = loads(body)
        return [text_length(b), *map(row_length, b.rows)]

    return bodies.map(one)


def act_labels(kind: Column, sub: Column, table: Column) -> tuple[Column, Column]:
    """Names of the arrows that copy a line to A and to B."""
    to_a = F.when(kind == "del", "Remove from A").when(kind == "ins", "Copy to A").otherwise("Use B’s version in A")
    to_b = F.when(kind == "del", "Copy to B").when(kind == "ins", "Remove from B").otherwise("Use A’s version in B")
    what = F.when(table, " (whole table)").when(sub.isNotNull(), " (this row)").otherwise("")
    return F.concat(to_a, what), F.concat(to_b, what)


def line_parts(rows: DataFrame, table_rows: DataFrame) -> DataFrame:
    """Lines of aligned rows: pair_id, row_no, line_no, anchor, kind, extra, act, sub, whole_table, la, lb.

    A changed table has a caption line and a line for each of its rows (``table_rows``), other rows have one. la and lb
    are the lengths of both sides.
    """
    tune(rows.sparkSession)
    fragment = lambda c: F.coalesce(F.get_json_object(c, "$.fragment") == "true", F.lit(False))
    measured = rows.withColumn("ln", lengths("l_body")).withColumn("rn", lengths("r_body")).withColumn("frag", fragment(F.coalesce("l_body", "r_body")))
    split = (F.col("kind") == "table") & ~F.col("frag")
    none = F.lit(None).cast("string")
    plain = measured.filter(~split).select(
        "pair_id", "row_no", F.lit(0).alias("line_no"), F.col("key").alias("anchor"), F.when(F.col("kind") == "table", "mod").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("frag"), "frag").otherwise("").alias("extra"), F.when(F.col("kind") == "table", "mod").when(F.col("kind") != "eq", F.col("kind")).alias("act"),
        none.alias("sub"), F.lit(False).alias("whole_table"), F.col("ln")[0].alias("la"), F.col("rn")[0].alias("lb"),
    )
    tables = measured.filter(split)
    captions = tables.select(
        "pair_id", "row_no", F.lit(0).alias("line_no"), F.col("key").alias("anchor"), F.lit("tcap").alias("kind"), F.lit("").alias("extra"), F.lit("mod").alias("act"),
        none.alias("sub"), F.lit(True).alias("whole_table"), F.lit(0).alias("la"), F.lit(0).alias("lb"),
    )
    last = F.max("sub_no").over(Window.partitionBy("pair_id", "row_key"))
    subs = table_rows.withColumn("last", last).withColumnsRenamed({"key": "sub_key", "kind": "sub_kind"})
    inner = subs.join(tables.select("pair_id", F.col("key").alias("row_key"), "row_no", "ln", "rn"), ["pair_id", "row_key"])
    at = lambda c, n: F.when(F.col(n).isNull(), 0).otherwise(F.get(c, F.col(n) + 1))
    lines = inner.select(
        "pair_id", "row_no", (F.col("sub_no") + 1).alias("line_no"), F.concat("row_key", F.lit("#"), F.col("sub_no").cast("string")).alias("anchor"), F.concat(F.lit("t"), "sub_kind").alias("kind"),
        F.when(F.col("sub_no") == 0, "t-first").when(F.col("sub_no") == F.col("last"), "t-last").otherwise("").alias("extra"), F.when(F.col("sub_kind") != "eq", F.col("sub_kind")).alias("act"),
        F.when(F.col("sub_kind") != "eq", F.col("sub_key")).alias("sub"), F.lit(False).alias("whole_table"), at("ln", "l_row").alias("la"), at("rn", "r_row").alias("lb"),
    )
    return plain.union(captions).union(lines)


def column_offsets(lines: DataFrame, scrolls: DataFrame) -> DataFrame:
    """Where each column starts with a grid scrolled: pair_id, scroll_id, a, b, line, t, y.

    ``lines``: pair_id, line_no, top_a, top_b, height_a, height_b (places in each column); ``scrolls``: pair_id, scroll_id, s,
    h, s_max. The aligned layout gives each line the larger of its heights. The sync point, from the top to the bottom of
    the screen, falls on the last line that starts at or above it.
    """
    order = Window.partitionBy("pair_id").orderBy("line_no")
    tall = F.greatest("height_a", "height_b", F.lit(0.0))
    top = F.coalesce(F.sum(tall).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    laid = lines.withColumn("v", top).withColumn("tall", tall)
    ends = laid.groupBy("pair_id").agg(F.max(F.col("v") + F.col("tall")).alias("total"), F.max(F.col("top_a") + F.col("height_a")).alias("len_a"), F.max(F.col("top_b") + F.col("height_b")).alias("len_b"))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    half = F.col("h") / 2
    point = unit(0.5 * unit(F.col("s") / half) + 0.5 * F.when(F.col("s_max") > 0, unit((F.col("s") - (F.col("s_max") - half)) / half)).otherwise(0.0))
    y = F.least(F.greatest(F.col("s") + F.when(F.col("h") > 0, point * F.col("h")).otherwise(0.0), F.lit(0.0)), F.col("total"))
    asked = scrolls.join(ends, "pair_id").withColumn("y", y)
    # The line of each scroll: lines and scrolls merged in the order of places.
    column = lambda c, kind: F.lit(None).cast(kind).alias(c)
    a = laid.select("pair_id", F.col("v").alias("y"), F.lit(0).alias("turn"), "line_no", column("scroll_id", "long"))
    b = asked.select("pair_id", "y", F.lit(1).alias("turn"), column("line_no", "int"), "scroll_id")
    upto = Window.partitionBy("pair_id").orderBy("y", "turn", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = a.union(b).withColumn("line", F.last("line_no", ignorenulls=True).over(upto)).filter("turn = 1").select("pair_id", "scroll_id", "line")
    met = asked.join(on, ["pair_id", "scroll_id"]).join(laid.withColumnRenamed("line_no", "line"), ["pair_id", "line"])
    t = F.when(F.col("tall") > 0, unit((F.col("y") - F.col("v")) / F.col("tall"))).otherwise(0.0)
    met = met.withColumn("t", t)

    def fit(side: str) -> Column:
        length = F.col(f"len_{side}")
        start = F.col("y") - (F.col(f"top_{side}") + F.col("t") * F.col(f"height_{side}"))
        low = F.least(F.greatest(start, F.least(F.col("s") + F.col("h"), F.col("total")) - length), F.col("s"))
        return F.least(F.greatest(low, F.lit(0.0)), F.greatest(F.lit(0.0), F.col("total") - length))

    return met.select("pair_id", "scroll_id", fit("a").alias("a"), fit("b").alias("b"), "line", "t", "y")


# ------------------------------------------------------------------ list labels


def bullet(template: Column, level: Column) -> Column:
    """The bullet of a level: its template, unless that numbers or is a symbol font's character."""
    usual = F.element_at(F.array(*[F.lit(b) for b in BULLETS]), (level % 3 + 1).cast("int"))
    mapped = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])[template]
    private = template.rlike("^[\\uE000-\\uF8FF]")
    return F.when(template.isNull() | (template == "") | template.rlike("%\\d"), usual).otherwise(F.coalesce(mapped, F.when(private, usual).otherwise(template)))


def list_labels(items: DataFrame, levels: int = 9, doc: str = "doc_id") -> DataFrame:
    """``label`` of list items (doc, pos, ordered, level, key, override, template, starts and formats as maps by level).

    Each level counts from its start, and anew after an item of a higher level; the first item of an override key starts its
    list anew. A counter is the number of items of its level since the last higher one: windows, as many as there are
    levels, over one partitioning by document and list.
    """
    key = F.coalesce("key", F.concat(F.lit("anon-"), F.col("level").cast("string")))
    numbered = items.filter("ordered").withColumn("__key", key)
    first = F.row_number().over(Window.partitionBy(doc, "override").orderBy("pos")) == 1
    numbered = numbered.withColumn("__new", (F.col("override").isNotNull() & first).cast("int"))
    upto = Window.partitionBy(doc, "__key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = numbered.withColumn("__epoch", F.sum("__new").over(upto))
    lit_map = lambda c, n: F.col(c)[F.lit(n)]
    counters = []
    for n in range(levels):
        higher = Window.partitionBy(doc, "__key", "__epoch").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = numbered.withColumn(f"__g{n}", F.sum((F.col("level") < n).cast("int")).over(higher))
        own = Window.partitionBy(doc, "__key", "__epoch", f"__g{n}").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        here = F.col("level") == n
        count, start = F.sum(here.cast("int")).over(own), F.first(F.when(here, F.coalesce(lit_map("starts", n), F.lit(1))), ignorenulls=True).over(own)
        numbered = numbered.withColumn(f"__c{n}", F.when(count > 0, start + count - 1))
        counters.append(f"__c{n}")

    def shown(n: int) -> Column:
        """The counter of level n in its format."""
        value, form = F.coalesce(f"__c{n}", lit_map("starts", n), F.lit(1)), F.coalesce(lit_map("formats", n), F.lit(LEVEL_FORMATS[n % 3]))
        out = value.cast("string")
        for f in ("lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "decimalZero", "none", "bullet"):
            out = F.when(form == f, format_number(value, f)).otherwise(out)
        return out

    own = F.lit(None).cast("string")
    filled = F.col("template")
    for n in range(levels):
        own = F.when(F.col("level") == n, F.concat(shown(n), F.lit("."))).otherwise(own)
        filled = F.replace(filled, F.lit(f"%{n + 1}"), shown(n))
    label = F.when(F.col("template").rlike("%\\d"), filled).when(F.col("template") != "", F.col("template")).otherwise(own)
    numbered = numbered.withColumn("label", label).select(*items.columns, "label")
    bullets = items.filter("NOT ordered").withColumn("label", bullet(F.col("template"), F.col("level")))
    return numbered.union(bullets)


# ------------------------------------------------------------------ undo and sessions


def replayed(events: DataFrame) -> DataFrame:
    """Documents after each event of a session (session, seq, action: commit, undo or redo, label, docs): with ``now``,
    ``label`` of what was done or undone (null where there was nothing), can_undo and can_redo.

    A session is one reader's and its undo list holds ``UNDO_DEPTH`` entries; its events are folded in order.
    """
    out = "session string, seq long, now string, done string, can_undo boolean, can_redo boolean"

    def fold(session: pd.DataFrame) -> pd.DataFrame:
        now, past, future, rows = None, [], [], []
        for name, seq, action, label, docs in session.sort_values("seq", kind="stable").itertuples(index=False):
            done = None
            if action == "commit":
                past, future, now, done = [*past, (now, label)][-UNDO_DEPTH:], [], docs, label
            elif action in ("undo", "redo"):
                taken, given = (past, future) if action == "undo" else (future, past)
                if taken:
                    docs_there, done = taken.pop()
                    given.append((now, done))
                    now = docs_there
            rows.append((name, seq, now, done, bool(past), bool(future)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    tune(events.sparkSession)
    asked = events.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "action", "label", "docs")
    return asked.groupBy("session").applyInPandas(fold, out)


def kept_sessions(saves: DataFrame, keep: int = SESSIONS_KEPT) -> DataFrame:
    """The latest save of each session (scope, tab, saved_at), and of those the ``keep`` most recent."""
    latest = saves.groupBy("scope", "tab").agg(F.max("saved_at").alias("saved_at"))
    return latest.orderBy(F.desc("saved_at"), "scope", "tab").limit(keep)


def restored_sessions(asked: DataFrame, kept: DataFrame) -> DataFrame:
    """``from_tab`` of asked sessions (scope, tab): its own, or on the comparison page the most recent of any tab."""
    recent = kept.groupBy("scope").agg(F.max_by("tab", F.struct("saved_at", "tab")).alias("recent"))
    own = kept.select("scope", "tab", F.col("tab").alias("own"))
    found = asked.join(own, ["scope", "tab"], "left").join(recent, "scope", "left")
    return found.select("scope", "tab", F.coalesce("own", F.when(F.col("scope") == "compare", F.col("recent"))).alias("from_tab"))
