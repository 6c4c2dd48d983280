"""Pairs of documents to compare: near copies found in a corpus, and exact edits of its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import once, spread

MIN_SHARED = 3
MIN_LINE = 20


def para_body(text: Column) -> Column:
    """The JSON of a plain paragraph."""
    spans = F.when(text == "", F.array().cast("array<struct<text:string>>")).otherwise(F.array(F.struct(text.alias("text"))))
    return F.to_json(F.struct(F.lit("p").alias("type"), spans.alias("spans")))


def blocks_of(lines: Column, doc: Column) -> Column:
    """Lines as an array of blocks (id, body)."""
    return F.transform(lines, lambda x, i: F.struct(F.concat(doc.cast("string"), F.lit(":"), i.cast("string")).alias("id"), para_body(x).alias("body")))


def doc_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), blocks_of(T.lines(F.coalesce(F.col(text_col), F.lit(""))), F.col(id_col)).alias("blocks"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """left_doc < right_doc of documents that share at least three distinct lines of over 20 characters.

    A document is compared with the first document that has one of its lines, for each of them, and not with every other
    that has it: a line that a third of all documents have gives each of those one pair, and the result grows with the
    lines of the corpus. Copies of one text are paired with its first document, and stand for it no further. Candidates are
    confirmed on all their lines.
    """
    texts = spread(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL"))
    own = F.array_distinct(F.filter(T.lines(F.col("text")), lambda x: F.length(x) > MIN_LINE))
    # Texts are read once: from here on there are hashes of texts and of lines.
    read = once(texts.select("doc", F.sha2("text", 256).alias("h"), F.transform(own, lambda x: F.xxhash64(x)).alias("own")), "lines")
    first = read.groupBy("h").agg(F.min("doc").alias("rep"))
    copies = read.select("doc", "h", F.size("own").alias("n")).join(first, "h").filter((F.col("doc") != F.col("rep")) & (F.col("n") >= MIN_SHARED))
    kept = read.filter(F.size("own") >= MIN_SHARED).join(first, F.col("doc") == F.col("rep"), "left_semi")
    lines = kept.select("doc", F.explode("own").alias("line"))
    holders = lines.groupBy("line").agg(F.min("doc").alias("left_doc"), F.count("*").alias("df")).filter("df > 1").select("line", "left_doc")
    asked = lines.join(holders, "line").filter("left_doc < doc").select("left_doc", F.col("doc").alias("right_doc")).distinct()
    side = lambda c: kept.select(F.col("doc").alias(f"{c}_doc"), F.col("own").alias(f"{c}_own"))
    both = asked.join(side("left"), "left_doc").join(side("right"), "right_doc")
    near = both.filter(F.size(F.array_intersect("left_own", "right_own")) >= MIN_SHARED)
    return near.select("left_doc", "right_doc").union(copies.select(F.col("rep").alias("left_doc"), F.col("doc").alias("right_doc")))


def paired(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """pair_id, left and right block lists of pairs (left_doc, right_doc)."""
    side = lambda name: blocks.select(F.col("doc_id").alias(f"{name}_doc"), F.col("blocks").alias(name))
    both = pairs.join(side("left"), "left_doc").join(side("right"), "right_doc")
    return both.select(F.concat_ws("-", "left_doc", "right_doc").alias("pair_id"), "left", "right")


def edited(docs: DataFrame) -> DataFrame:
    """pair_id, a and b: each document's distinct lines in order, and an edit of them.

    At places p with p % 5 = 2, (doc_id * 31 + p * 17) % 4 chooses: 0 drops the line, 1 replaces its first word by
    "changed", 2 adds a line after it, 3 leaves it.
    """
    own = F.filter(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n")), lambda x: F.trim(x) != "")
    base = spread(docs.filter("doc_id IS NOT NULL").select("doc_id", "text")).select("doc_id", own.alias("a"))
    what = lambda p: F.when(p % 5 == 2, (F.col("doc_id") * 31 + p * 17) % 4).otherwise(F.lit(3))

    def edit(x, p):
        added = F.concat(F.lit("inserted line "), F.col("doc_id").cast("string"), F.lit("-"), p.cast("string"))
        w = what(p.cast("long"))
        return F.when(w == 0, F.array().cast("array<string>")).when(w == 1, F.array(F.regexp_replace(x, "^\\S+", "changed"))).when(w == 2, F.array(x, added)).otherwise(F.array(x))

    return base.select(F.col("doc_id").cast("string").alias("pair_id"), "a", F.flatten(F.transform("a", edit)).alias("b"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """The edited documents as pairs of block lists; ids are "a:place" and "b:place"."""
    e = edited(docs)
    return e.select("pair_id", blocks_of(F.col("a"), F.lit("a")).alias("left"), blocks_of(F.col("b"), F.lit("b")).alias("right"))
