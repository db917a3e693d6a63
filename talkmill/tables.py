"""Loaders of the supplied tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, name: str, each: int) -> int | None:
    """How many tasks work on what comes of a table, one for `each` of its rows; None if the session's are enough. The count reads Parquet's footers alone."""
    n = math.ceil(load(spark, sf_dir, name).count() / each)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """The rows dealt by the keys into n parts, which adaptive execution leaves as they are, so that a part does not grow with the table; without n as they were."""
    return rows if n is None else rows.repartition(n, *keys)
