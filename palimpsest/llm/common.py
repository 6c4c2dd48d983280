"""Shared plumbing of the training-data operators: what ``storage`` has, table access, and small fixed tables.

Nothing here looks at values: nulls, empty texts and repeated rows pass as they are, and an empty table is written and
read back as an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, remove, shared_dir, tune

__all__ = ["cut", "inline", "remove", "shared_dir", "table", "tune"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark from wherever ``sf_dir`` is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inline(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table as part of the plan, without Python or RDD scans. Values: str, int, float or lists of str."""

    def lit(v):
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)

    items = [F.struct(*[lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*items)).alias("r")).select("r.*")
