"""Review marks: notes, highlights and reactions, placed on text and changes that may have moved."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_text
from ..model import OBJECT, Block

CONTEXT = 40
MAX_HITS = 400
EXCERPT = 120
# What marks can be.
COLORS = ["yellow", "green", "blue", "pink"]
REACTIONS = ["up", "down", "idea"]


def block_stream(b: Block) -> str:
    """A block's text as marks see it: objects are one character, and separators stand only between two texts."""
    pieces: list[tuple[str, str]] = []

    def walk(x: Block, sep: str) -> str:
        """Adds the texts of x; the separator that is due before the next text."""
        if x.type == "p":
            for s in x.spans:
                text = "" if s.marker else OBJECT if s.obj else s.text
                if text:
                    pieces.append((sep, text))
                    sep = ""
        elif x.type == "table":
            for i, row in enumerate(x.rows):
                sep = "\n" if i else sep
                for j, cell in enumerate(row.cells):
                    sep = sep if sep == "\n" or not j else "\t"
                    if cell.vmerge != "continue":
                        for k, inner in enumerate(cell.blocks):
                            sep = walk(inner, "\n" if k else sep)
        else:
            for k, inner in enumerate(x.blocks):
                sep = walk(inner, "\n" if k else sep)
        return sep

    walk(b, "")
    return "".join((sep if n else "") + text for n, (sep, text) in enumerate(pieces))


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def find_text(text: str, quote: str, prefix: str, suffix: str, pos: int) -> int | None:
    """Where a quote is: of its places, the one whose surroundings match best, then the nearest to where it was."""
    best, found, at = None, None, text.find(quote) if quote else -1
    for _ in range(MAX_HITS):
        if at < 0:
            break
        end = at + len(quote)
        before, after = text[max(0, at - len(prefix)) : at], text[end : end + len(suffix)]
        score = _alike(before[::-1], prefix[::-1]) + _alike(after, suffix) - abs(at - pos) / (len(text) + 1)
        if best is None or score > best:
            best, found = score, at
        at = text.find(quote, at + 1)
    return found


def text_target(stream: Column, start: Column, end: Column) -> Column:
    """What identifies the text [start, end) of a stream."""
    head = F.greatest(F.lit(0), start - CONTEXT)
    part = lambda a, b: F.substr(stream, (a + 1).cast("int"), (b - a).cast("int"))
    return F.struct(part(start, end).alias("quote"), part(head, start).alias("prefix"), part(end, end + CONTEXT).alias("suffix"), start.alias("pos"))


def locate(marks: DataFrame, streams: DataFrame) -> DataFrame:
    """``start`` and ``end`` of text marks (mark_id, doc_id, quote, prefix, suffix, pos) in streams (doc_id, stream); null if gone."""

    @F.pandas_udf("long")
    def find(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([find_text(*x) for x in zip(*columns, strict=True)], dtype="Int64")

    there = F.contains("stream", F.col("quote")) & (F.col("quote") != "")
    joined = marks.join(streams, "doc_id")
    start = F.when(there, find("stream", "quote", "prefix", "suffix", "pos"))
    return joined.withColumn("start", start).withColumn("end", F.col("start") + F.length("quote")).drop("stream")


def change_hashes(numbered: DataFrame) -> DataFrame:
    """Per pair and hunk: ha and hb, hashes of both sides' text. ``numbered``: rows with hunks, and text as l_text, r_text."""
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    sides = numbered.filter("hunk >= 0").groupBy("pair_id", "hunk").agg(text("l_text").alias("a"), text("r_text").alias("b"))
    return sides.select("pair_id", "hunk", hash_text(F.col("a")).alias("ha"), hash_text(F.col("b")).alias("hb"), F.substring("a", 1, EXCERPT).alias("a"), F.substring("b", 1, EXCERPT).alias("b"))


def find_changes(targets: DataFrame, hashes: DataFrame) -> DataFrame:
    """``hunk`` of change marks (mark_id, pair_id, ha, hb, index): the nearest of those with the same texts; -1 if gone."""
    near = Window.partitionBy("mark_id").orderBy(F.abs(F.col("hunk") - F.col("index")), "hunk")
    found = targets.join(hashes.select("pair_id", "ha", "hb", "hunk"), ["pair_id", "ha", "hb"], "left").withColumn("n", F.row_number().over(near))
    return found.filter("n = 1").select("mark_id", "pair_id", F.coalesce("hunk", F.lit(-1)).alias("hunk"))


def margins(placed: DataFrame) -> DataFrame:
    """Per pair, row and side: notes, distinct colours and reactions, of placed marks (pair_id, row_key, side, kind, color,
    reaction); a mark without a side shows on both."""
    sides = F.when(F.col("side").isNull(), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("side"))
    each = placed.filter("row_key IS NOT NULL").withColumn("side", F.explode(sides))
    among = lambda c, kind: F.collect_set(F.when(F.col("kind") == kind, F.col(c)))
    fixed = lambda all_, have: F.array_join(F.filter(F.array(*[F.lit(x) for x in all_]), lambda x: F.array_contains(have, x)), ",")
    grouped = each.groupBy("pair_id", "row_key", "side").agg(F.count_if(F.col("kind") == "note").alias("notes"), among("color", "highlight").alias("c"), among("reaction", "reaction").alias("r"))
    return grouped.select("pair_id", "row_key", "side", "notes", fixed(COLORS, F.col("c")).alias("highlights"), fixed(REACTIONS, F.col("r")).alias("reactions"))


def well_formed(marks: DataFrame) -> DataFrame:
    """Marks whose fields go together (columns as in margins, with target, quote, ha, hb, text, created)."""
    text = (F.col("target") == "text") & F.col("side").isin("a", "b") & (F.col("quote") != "")
    change = (F.col("target") == "change") & F.col("ha").isNotNull() & F.col("hb").isNotNull()
    note = (F.col("kind") == "note") & F.col("text").isNotNull() & (text | change)
    highlight = (F.col("kind") == "highlight") & F.col("color").isin(COLORS) & text
    reaction = (F.col("kind") == "reaction") & F.col("reaction").isin(REACTIONS) & change
    return marks.filter(F.col("mark_id").isNotNull() & F.col("created").isNotNull() & (note | highlight | reaction))


def toggled(reactions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Reactions (pair_id, hunk, reaction) after clicks: the same one goes, up and down exclude each other."""
    key = ["pair_id", "hunk"]
    c = clicks.select(*key, F.col("reaction").alias("clicked"))
    kept = reactions.join(c, key, "left").filter(F.expr("clicked IS NULL OR NOT (reaction = clicked OR (clicked <> 'idea' AND reaction <> 'idea'))"))
    return kept.select(*key, "reaction").union(clicks.join(reactions, [*key, "reaction"], "left_anti").select(*key, "reaction"))


def swapped(marks: DataFrame) -> DataFrame:
    """Marks after the documents of their pairs change sides."""
    side = F.when(F.col("side") == "a", F.lit("b")).when(F.col("side") == "b", F.lit("a"))
    return marks.withColumns({"side": side, "ha": F.col("hb"), "hb": F.col("ha")})
