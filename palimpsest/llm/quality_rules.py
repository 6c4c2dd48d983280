"""Quality rules: rules over a document's own words, and host verdicts from their failures.

A document fails the base rules if it is too short or repeats itself. Failures are summed by host (the ``source``
column), each host's rate is shrunk by a beta prior fitted to all hosts by moments, and documents of a host whose shrunk
rate is over the limit are rejected with it.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: a null text has no words (and so fails); a null host is a host of its own;
rows keep their multiplicity; ``score`` drops other columns and ``keep`` keeps exactly the input's columns; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_WORDS = 20
#: Percent of words in repeated windows over which a document fails.
MAX_REPEATED = 30
WINDOW = 8
#: Shrunk failure rate over which a host is rejected.
MAX_HOST_RATE = 0.5

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words that are in a window of ``window`` (a power of two) words found twice or more. Windows are compared exactly:
    ranks of words give ranks of pairs, those give ranks of fours, and so on."""
    if len(words) <= window:
        return 0
    number: dict = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    step, times = 1, None
    while step < window:
        rank, times = np.unique(rank[:-step] * len(words) + rank[step:], return_inverse=True, return_counts=True)[1:]
        if times.max() == 1:  # windows only get rarer as they get longer
            return 0
        step *= 2
    twice = np.flatnonzero(times[rank] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    chars = len(text) - sum(map(text.count, _SPACE))
    return len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in _METRICS]))
def metrics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = np.array([measure(t) for t in texts], np.int64).reshape(-1, 5)
        yield pd.DataFrame(rows, columns=_METRICS)


def failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])


def host_rates(rows: DataFrame) -> DataFrame:
    """Per ``host`` of rows (host, base_failed): n_docs, n_failed and the shrunk ``rate``.

    The prior's mean is the overall rate m; its weight follows from the hosts' spread S = sum n (p - m)^2 over what
    chance alone gives. The moments are sums over hosts, joined back as one row.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    sums = hosts.agg(F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ffn")).first()
    if not sums.h:
        return hosts.withColumn("rate", F.lit(None).cast("double"))
    a, b = prior(sums.h, sums.n, sums.f, sums.nn, sums.ffn)
    return hosts.withColumn("rate", (f + a) / (n + a + b))


def prior(h: int, n: float, f: float, nn: float, ffn: float) -> tuple[float, float]:
    """Beta prior from sums over h hosts: documents n, failures f, squares of n, and f^2 / n."""
    m = f / n
    chance = m * (1 - m)
    room = n - nn / n - (h - 1)
    spread = ffn - n * m * m
    share = (spread - chance * (h - 1)) / (chance * room) if chance > 0 and room > 0 else 0.0
    share = min(max(share, 1e-4), 0.999)
    weight = 1 / share - 1
    return m * weight, (1 - m) * weight


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), metrics(F.col(text_col)).alias("m"))
    return rows.select("id", "host", "m.*", failed(F.col("m")).alias("base_failed"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, the five counts, base_failed, kept, host and its shrunk rate."""
    common.tune(docs.sparkSession)
    folder = common.shared_dir(docs.sparkSession, "quality-rules")
    rows = common.cut(_measured(docs, id_col, text_col, host_col), folder, "measured")
    hosts = common.cut(host_rates(rows).select(F.col("host").alias("of_host"), F.col("rate").alias("host_rate")), folder, "hosts")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("of_host")))
    return joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("host_rate") <= MAX_HOST_RATE)).alias("kept"), "host", "host_rate",
    )


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Texts are measured twice and never shuffled."""
    common.tune(docs.sparkSession)
    folder = common.shared_dir(docs.sparkSession, "quality-rules")
    rows = docs.select(F.col(host_col).alias("host"), failed(metrics(F.col(text_col))).alias("base_failed"))
    worst = common.cut(host_rates(rows).filter(F.col("rate") > MAX_HOST_RATE).select(F.col("host").alias("__worst_host")), folder, "worst")
    good = docs.filter(~failed(metrics(F.col(text_col))))
    return good.join(worst, good[host_col].eqNullSafe(worst["__worst_host"]), "left_anti")
