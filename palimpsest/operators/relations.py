"""What follows from a comparison's rows, in windows and aggregates: hunks, statistics, folds, offsets, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order():
    return Window.partitionBy("pair_id").orderBy("row_no")


def _running(flag: Column) -> Column:
    return F.sum(flag.cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))


def with_hunks(rows: DataFrame) -> DataFrame:
    """``hunk``: the number of the run of unequal rows that a row is in, -1 for equal rows."""
    starts = (F.col("kind") != "eq") & (F.coalesce(F.lag("kind").over(_order()), F.lit("eq")) == "eq")
    return rows.withColumn("hunk", F.when(F.col("kind") == "eq", F.lit(-1)).otherwise(_running(starts) - 1).cast("int"))


def hunks(numbered: DataFrame) -> DataFrame:
    """Per pair and hunk: rows [start, end)."""
    found = numbered.filter("hunk >= 0").groupBy("pair_id", "hunk")
    return found.agg(F.min("row_no").alias("start"), (F.max("row_no") + 1).alias("end"))


def indexes(rows: DataFrame) -> DataFrame:
    """li and ri anew: how many blocks of a side come before a row."""
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.count(c).over(before).cast("int")
    return rows.withColumn("li", count("l_block")).withColumn("ri", count("r_block"))


def stats(rows: DataFrame, table_rows: DataFrame | None = None) -> DataFrame:
    """Per pair: changed, added, removed and equal rows. A table counts by its rows, not by itself."""
    counted = rows.select("pair_id", F.when(F.col("kind") == "table", F.lit(None)).otherwise(F.col("kind")).alias("kind"))
    if table_rows is not None:
        counted = counted.union(table_rows.filter("kind <> 'eq'").select("pair_id", "kind"))
    n = lambda k, name: F.count_if(F.col("kind") == k).alias(name)
    return counted.groupBy("pair_id").agg(n("mod", "changed"), n("ins", "added"), n("del", "removed"), n("eq", "equal"))


def folded(rows: DataFrame, context: int = 1, shortest: int = 2) -> DataFrame:
    """Changes and ``context`` rows around them; each other run of at least ``shortest`` rows as one fold with its count."""
    around = _order().rowsBetween(-context, context)
    near = F.max((F.col("kind") != "eq").cast("int")).over(around) == 1
    marked = rows.withColumn("near", near)
    runs = marked.withColumn("run", _running(F.coalesce(F.lag("near").over(_order()) != F.col("near"), F.lit(True))))
    sized = runs.withColumn("n", F.count("*").over(Window.partitionBy("pair_id", "run")))
    item = F.when(F.col("near") | (F.col("n") < shortest), "row").otherwise("fold")
    kept = sized.withColumn("item", item).withColumn("first", F.min("row_no").over(Window.partitionBy("pair_id", "run")))
    shown = kept.filter((F.col("item") == "row") | (F.col("row_no") == F.col("first")))
    return shown.select("pair_id", "row_no", "key", "item", F.when(F.col("item") == "fold", F.col("n")).otherwise(1).alias("count"))


def aligned_lines(lines: DataFrame) -> DataFrame:
    """``top`` of each line (pair_id, line_no, height_a, height_b): the larger heights of the lines before it."""
    order = Window.partitionBy("pair_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("top", F.coalesce(F.sum(F.greatest("height_a", "height_b")).over(order), F.lit(0)))


def stream_offsets(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``start`` of each block (pos, text) in its document's text, blocks joined by line breaks."""
    order = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)).cast("long"))


def segments(ranges: DataFrame, offsets: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pieces of ranges (doc, range_id, from, to) by block: an interval join inside each document."""
    o = offsets.select(doc, "pos", "start", (F.col("start") + F.length("text")).alias("end"))
    met = ranges.join(o, doc).filter((F.col("start") < F.col("to")) & (F.col("end") > F.col("from")))
    return met.select(doc, "range_id", "pos", (F.greatest("from", "start") - F.col("start")).alias("seg_start"), (F.least("to", "end") - F.col("start")).alias("seg_end"))


def list_labels(items: DataFrame, form: str = "decimal") -> DataFrame:
    """Labels of one-level lists (doc_id, key, pos, start): counters by list in document order."""
    from ..functions.text import format_number

    order = Window.partitionBy("doc_id", "key").orderBy("pos")
    n = F.first("start").over(order) + F.row_number().over(order) - 1
    return items.withColumn("n", n.cast("long")).withColumn("label", F.concat(format_number(F.col("n"), form), F.lit(".")))


#: Fixed value: what a page number looks like, in lower case with # for digits.
PAGE_NUMBER = "^(page\\s+)?#+(\\s*(of|/)\\s*#+)?$|^[-–—]\\s*#+\\s*[-–—]$"


def furniture(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Edge lines of pages (doc_id, page, text, edge) that repeat, digits and widths of white space apart (on two pages and
    40 % of them at least), or are a page number. ``pages``: doc_id, n_pages."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "\\d+", "#"), "\\s+", " "))
    edge = lines.filter("edge").withColumn("norm", norm)
    often = edge.groupBy("doc_id", "norm").agg(F.countDistinct("page").alias("on")).join(pages, "doc_id")
    often = often.filter((F.col("on") >= 2) & (F.col("on") >= 0.4 * F.col("n_pages"))).select("doc_id", "norm", F.lit(True).alias("often"))
    marked = edge.join(often, ["doc_id", "norm"], "left")
    return marked.filter(F.col("often") | F.col("norm").rlike(PAGE_NUMBER)).select(*lines.columns)


def most_frequent(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the smallest."""
    n = values.groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))
