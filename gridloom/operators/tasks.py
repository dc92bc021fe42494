"""Dealing heavy grouped work to enough tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over four tasks a core.

    Groups of numeric work are small in bytes and long in seconds; adaptive execution would put them
    into a few partitions by their bytes.  A stated number is kept, and the grouping needs no further shuffle.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def slices(spark: SparkSession, groups: int) -> int:
    """How many slices make `groups` histories some eight pieces of work a core."""
    return max(1, -(-8 * spark.sparkContext.defaultParallelism // max(groups, 1)))


def sliced(df: DataFrame, *keys: str, groups: int) -> DataFrame:
    """Rows with a column `slice`, and `slices`: each group's rows once for every slice, dealt by key and slice.

    Work that goes on along a group's history needs all of its rows; a slice does every `slices`-th piece of it, so
    rows are copied a stated number of times however long the history is.
    """
    n = slices(df.sparkSession, groups)
    copies = df.withColumns({"slice": F.explode(F.sequence(F.lit(0), F.lit(n - 1))), "slices": F.lit(n)})
    return dealt(copies, *keys, "slice")
