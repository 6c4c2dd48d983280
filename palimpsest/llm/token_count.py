"""Token counts: whole-token shortcut over pre-tokens, merges only for the rest.

Defined results: a null text counts as empty (0 bytes, 0 tokens, not over the limit); rows keep their multiplicity,
whatever their id is (null and repeated ids included); other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import ByteCounter

LIMIT = 1024


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of each text by the tokenizer file at ``path``."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = ByteCounter(path)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    common.tune(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
