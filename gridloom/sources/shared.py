"""Small tables that a query uses several times: computed once, in the folder all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables(str):
    """The path of a query's tables, with what the query has settled so far; lives as long as the query."""

    def __new__(cls, path: str) -> Tables:
        self = super().__new__(cls, path)
        self.settled = {}
        return self


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where that is unset and driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-panels-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write and read back: the plan behind it runs once, whatever is built on it, and outlives executors."""
    path = f"{folder(df.sparkSession)}/gridloom/{df.sparkSession.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Settle the result for the query at hand; plain paths compute it anew."""

    @functools.wraps(f)
    def g(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not isinstance(sf_dir, Tables):
            return f(spark, sf_dir)
        if f.__name__ not in sf_dir.settled:
            sf_dir.settled[f.__name__] = settle(f(spark, sf_dir), f.__name__)
        return sf_dir.settled[f.__name__]

    return g
