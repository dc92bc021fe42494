"""Prospective issuance as a stream: sessions arrive as files, forecasts go to an append-only ledger.

Every micro-batch is one set of new sessions; forecasts of targets that have opened are refused, and
a batch that is replayed replaces its own partition, so the ledger holds each forecast once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import har

SCHEMA = "session_no int, day date, symbol string, y double"


def issue(history: DataFrame, new: DataFrame, frozen: int) -> DataFrame:
    """Forecasts from the sessions of `new`, given all history up to them; targets at or before the freeze are refused."""
    fresh = new.select("session_no").distinct()
    design = har.features(history.unionByName(new).dropDuplicates(["session_no", "symbol"]))
    # The next session is not known yet: the target is the one after the origin.
    open_design = design.withColumn("target_no", F.coalesce("target_no", F.col("session_no") + 1)).withColumn("target_day", F.coalesce("target_day", F.date_add("day", 1)))
    ledger = har.ledger(open_design).join(fresh, F.col("origin_no") == F.col("session_no"), "left_semi")
    return ledger.filter(F.col("target_no") > frozen)


def run(spark: SparkSession, incoming: str, ledger: str, state: str, frozen: int) -> None:
    """Issue for every file that has arrived since the last call, then stop (available-now trigger)."""

    def batch(new: DataFrame, batch_id: int) -> None:
        history = spark.read.schema(SCHEMA).parquet(incoming)
        last = new.agg(F.max("session_no")).first()[0]
        if last is None:
            return
        rows = issue(history.filter(F.col("session_no") <= last), new, frozen).withColumn("batch", F.lit(batch_id))
        rows.write.option("partitionOverwriteMode", "dynamic").partitionBy("batch").mode("overwrite").parquet(ledger)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(incoming)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
