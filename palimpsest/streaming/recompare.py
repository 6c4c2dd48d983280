"""Comparisons kept up to date as new versions of documents arrive.

A stream of versions (doc_id, version, text) is compared, version by version, with what each document was before. The
last text of a document is keyed state, so a version is compared as soon as it comes, and state is one text a document.
Edits are counted by event-time windows and by sessions, whose state goes when the watermark passes them.

Defined results: a null text is an empty one; versions without a document are those of one document without an id; events
later than the watermark allows, and events without a time, are in no window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.options import DEFAULTS, CompareOptions
from ..model import para
from ..operators.compare import compare_blocks

CHANGES = "doc_id long, was long, version long, changed long, added long, removed long"


def version_changes(versions: DataFrame, o: CompareOptions = DEFAULTS) -> DataFrame:
    """One row per version after a document's first: lines changed, added and removed. Versions of one batch go in order;
    one that is not newer than the last is late and left out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches)).sort_values("version")
        was, text = state.get if state.exists else (None, None)
        out = []
        for version, now in zip(new["version"], new["text"].fillna(""), strict=True):
            if was is not None and version <= was:
                continue
            if was is not None:
                sides = ([para(x) for x in t.split("\n")] for t in (text, now))
                kinds = [r[0] for r in compare_blocks(*sides, o)]
                out.append((key[0], was, version, kinds.count("mod"), kinds.count("ins"), kinds.count("del")))
            was, text = int(version), now
        state.update((was, text))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    keyed = versions.select("doc_id", F.col("version").cast("long").alias("version"), "text").groupBy("doc_id")
    return keyed.applyInPandasWithState(step, CHANGES, "version long, text string", "append", "NoTimeout")


def edits_by_window(versions: DataFrame, late: str = "1 hour", width: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Versions of each document (doc_id, version, ts) in tumbling windows, or sliding ones: start, end, versions, latest."""
    window = F.window("ts", width, slide or width)
    counted = versions.withWatermark("ts", late).groupBy(window.alias("w"), "doc_id").agg(F.count("*").alias("versions"), F.max("version").alias("latest"))
    return counted.select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "versions", "latest")


def editing_sessions(versions: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Stretches of editing of each document, which end after ``gap`` without a version: start, end, versions."""
    counted = versions.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "doc_id").agg(F.count("*").alias("versions"))
    return counted.select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "versions")
