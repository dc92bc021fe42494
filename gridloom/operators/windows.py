"""Trailing windows over sessions and what is joined to them, always by equality on session_no."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling(days: DataFrame, width: int, step: int) -> DataFrame:
    """window_no, start_no, end_no (session numbers, inclusive); the last window always ends at the last session."""
    last = days.agg(F.max("session_no").alias("n"))
    starts = last.filter(F.col("n") >= width).select("n", F.explode(F.array_distinct(F.concat(F.sequence(F.lit(1), F.col("n") - width + 1, F.lit(step)), F.array(F.col("n") - width + 1)))).alias("start_no"))
    return starts.select((F.row_number().over(Window.orderBy("start_no")) - 1).cast("long").alias("window_no"), F.col("start_no").cast("long").alias("start_no"), (F.col("start_no") + width - 1).cast("long").alias("end_no"))


def sessions_of(windows: DataFrame, days: DataFrame) -> DataFrame:
    """One row a window and session: a sequence joined by equality, not a range join."""
    return windows.withColumn("session_no", F.explode(F.sequence("start_no", "end_no"))).join(days, "session_no")


def regimes(members: DataFrame) -> DataFrame:
    """The majority label of a window (ties: the last session's if tied, else the first by name), whether mixed, and whether quarterly."""
    counts = members.groupBy("window_no", "regime").agg(F.count(F.lit(1)).alias("k"))
    last = members.groupBy("window_no").agg(F.max_by("regime", "session_no").alias("last"), F.max("day").alias("end_day"), F.countDistinct("regime").alias("n"))
    best = counts.join(last, "window_no").withColumn("rank", F.row_number().over(Window.partitionBy("window_no").orderBy(F.desc("k"), F.desc(F.col("regime") == F.col("last")), "regime"))).filter("rank = 1")
    quarterly = F.month("end_day").isin(3, 6, 9, 12) & (F.dayofmonth("end_day") >= 20)
    return best.select("window_no", F.col("regime").alias("majority"), (F.col("n") > 1).alias("mixed"), quarterly.alias("quarterly"))


def assignment(blocks: DataFrame, days: DataFrame) -> DataFrame:
    """The fit block of every session (score_start <= session <= score_end; the later block where they overlap), and whether its training ended before."""
    spread = blocks.withColumn("session_no", F.explode(F.sequence("score_start", "score_end")))
    keep = spread.withColumn("rank", F.row_number().over(Window.partitionBy("session_no").orderBy(F.desc("block_no")))).filter("rank = 1")
    return days.join(keep.drop("rank"), "session_no", "left").select("session_no", "day", "block_no", "training_end", F.coalesce(F.col("training_end") < F.col("session_no"), F.lit(False)).alias("causal"))


def score_blocks(windows: DataFrame, days: DataFrame) -> DataFrame:
    """Each window scores the sessions after it up to the next window's end; the last has none left and is skipped."""
    n = days.agg(F.max("session_no").cast("long").alias("n"))
    nxt = F.lead("end_no").over(Window.orderBy("window_no"))
    b = windows.withColumn("nxt", nxt).join(F.broadcast(n)).withColumn("score_end", F.coalesce("nxt", "n"))
    return b.select(F.col("window_no").alias("block_no"), F.col("end_no").alias("training_end"), (F.col("end_no") + 1).alias("score_start"), "score_end").filter("score_start <= score_end")


def persistent(flags: DataFrame, step: int) -> DataFrame:
    """Flagged now and in the previous window, which starts exactly `step` sessions before."""
    w = Window.partitionBy("symbol").orderBy("start_no")
    return flags.withColumn("persistent", F.col("flag") & F.coalesce(F.lag("flag").over(w), F.lit(False)) & F.coalesce(F.col("start_no") - F.lag("start_no").over(w) == step, F.lit(False)))


def tail_sessions(rows: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """The last n calendar sessions of `rows`."""
    chosen = days.join(F.broadcast(days.agg(F.max("session_no").alias("top")))).filter(F.col("session_no") > F.col("top") - n).select("session_no")
    return rows.join(chosen, "session_no", "left_semi")
