"""Sinks and their readers: monthly partitions, ledgers, manifests, tables for people.

Ledgers are append-only Parquet tables partitioned by run; Spark's committer makes a write whole or
absent.  Small documents go through Spark's own file system too, so any shared store will do.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZSTD = {"compression": "zstd"}
CSV = {"header": True, "escape": '"', "nullValue": "\\N"}


def write_months(bars: DataFrame, path: str) -> None:
    """Bars by month and symbol; only the partitions that the rows belong to are replaced.  Tasks take spans of time, so a large symbol is several files."""
    bars.withColumn("month", F.date_format("session", "yyyy-MM")).repartitionByRange("month", "symbol", "session", "bar").write.options(**ZSTD, partitionOverwriteMode="dynamic").partitionBy("month", "symbol").mode("overwrite").parquet(path)


def incomplete_months(spark: SparkSession, path: str, symbols: list[str]) -> DataFrame:
    """Months that lack a symbol: they are not complete and are to be loaded again."""
    seen = spark.read.parquet(path).groupBy("month").agg(F.collect_set("symbol").alias("seen"))
    return seen.select("month", F.array_except(F.array(*map(F.lit, symbols)), "seen").alias("lacking")).filter(F.size("lacking") > 0)


def consolidated(spark: SparkSession, path: str) -> DataFrame:
    """All months, one row a (symbol, session, bar), sorted within files by time."""
    w = Window.partitionBy("symbol", "session", "bar").orderBy("month")
    one = spark.read.parquet(path).withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank", "month")
    return one.repartitionByRange("symbol", "session", "bar").sortWithinPartitions("symbol", "session", "bar")


def append_ledger(rows: DataFrame, path: str, run_id: str, spec: str) -> None:
    """Facts of a run; a run and specification that is written again is replaced whole."""
    rows.withColumn("run_id", F.lit(run_id)).withColumn("spec", F.lit(spec)).write.options(**ZSTD, partitionOverwriteMode="dynamic").partitionBy("run_id", "spec").mode("overwrite").parquet(path)


def read_ledger(spark: SparkSession, path: str, run_id: str, spec: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).filter(F.col("run_id") == run_id)
    return df if spec is None else df.filter(F.col("spec") == spec)


def canonical(ledger: DataFrame, keys: list[str], values: list[str], order: str, rtol: float = 1e-9, atol: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """One row a key (the last by `order`), and the keys whose repeats disagree beyond the tolerances."""
    apart = [F.coalesce(F.max(v) - F.min(v) > atol + rtol * F.greatest(F.abs(F.max(v)), F.abs(F.min(v))), F.lit(False)) for v in values]
    half = [(F.count(v) > 0) & (F.count(v) < F.count(F.lit(1))) for v in values]
    bad = apart[0] | half[0]
    for x in [*apart[1:], *half[1:]]:
        bad = bad | x
    conflicts = ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).filter("bad").drop("bad")
    last = ledger.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("rank = 1").drop("rank")
    return last, conflicts


FORBIDDEN = ("outcome", "qlike", "log_mse", "log_mae", "realized")


def violation_rows(ledger: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """violation, n: what a forecast ledger must not have.  Missing or outcome columns, repeated keys, forecasts that aren't positive."""
    named = [f"missing:{c}" for c in required if c not in ledger.columns] + [f"forbidden:{c}" for c in FORBIDDEN if c in ledger.columns]
    columns = ledger.sparkSession.createDataFrame([(x, 1) for x in named], "violation string, n bigint")
    repeated = ledger.groupBy(*keys).count().filter("count > 1").agg(F.lit("repeated_keys").alias("violation"), F.count(F.lit(1)).alias("n"))
    odd = ledger.agg(F.lit("nonpositive_forecasts").alias("violation"), F.count_if(~(F.coalesce(F.col("forecast"), F.lit(0.0)) > 0)).alias("n"))
    return columns.unionByName(repeated).unionByName(odd).filter("n > 0")


def violations(ledger: DataFrame, keys: list[str], required: list[str]) -> dict[str, int]:
    """`violation_rows` by name; a handful of rows."""
    return {r["violation"]: r["n"] for r in violation_rows(ledger, keys, required).collect()}


def frame_hash(df: DataFrame) -> str:
    """A hash of a table's rows that doesn't depend on their order."""
    total, n = df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.count(F.lit(1))).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}:{n}:{total}".encode()).hexdigest()


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document, keys sorted, as a text table of one line a line."""
    lines = json.dumps(document, sort_keys=True, indent=2, default=str).split("\n")
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def manifest(config: dict, tables: dict[str, DataFrame]) -> dict:
    """What a run was: its configuration and the rows and hashes of its tables."""
    return {"config": config, "config_hash": config_hash(config), "tables": {k: {"rows": df.count(), "hash": frame_hash(df), "columns": df.columns} for k, df in sorted(tables.items())}}


def may_resume(old: dict, config: dict) -> bool:
    """A checkpoint continues only under the configuration that it was written with."""
    return old.get("config_hash") == config_hash(config)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, one a task; nulls are \\N, empty strings stay empty."""
    df.write.mode("overwrite").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**CSV).csv(path)


def markdown(df: DataFrame, rows: int = 50, digits: int = 4, missing: str = "n/a") -> str:
    """The first rows of a small table for people to read; pipes are escaped."""

    def cell(v) -> str:
        return missing if v is None else (f"{v:.{digits}f}" if isinstance(v, float) else str(v)).replace("|", "\\|")

    body = [[cell(v) for v in r] for r in df.limit(rows).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *body])


def retried(action, attempts: int = 6, wait=lambda n: min(2**n, 60), sleep=None):
    """`action` until it succeeds; waits double up to a minute, the last failure is raised."""
    import time

    for n in range(attempts):
        try:
            return action()
        except Exception:
            if n + 1 == attempts:
                raise
            (sleep or time.sleep)(wait(n))
