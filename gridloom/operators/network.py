"""Directed edges and their rollups: plain joins and aggregates, no graph engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STABLE = 0.70
#: Lags in sessions at which a source may lead a target.
LAGS = {"D": 1, "W": 5, "M": 22}
LEAST_ROWS = 10
SELECTED = 0.15


def lagged_edges(panel: DataFrame) -> DataFrame:
    """Edge history: for every quarter, ordered pair and lag, the correlation of the target with the lagged source.

    Sources are lagged by an equi-join on session_no, so a missing session is a missing pair, not a shorter lag.
    """
    seen = panel.filter(F.col("y").isNotNull()).select("session_no", "day", "symbol", "y")
    lags = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("lag")) for h, n in LAGS.items())))
    sources = seen.select(F.col("symbol").alias("source"), F.col("y").alias("x"), "session_no", lags.alias("l")).select("source", "x", "l.horizon", (F.col("session_no") + F.col("l.lag")).alias("session_no"))
    targets = seen.select("session_no", F.col("symbol").alias("target"), "y", (F.year("day") * 4 + F.quarter("day")).cast("long").alias("origin"))
    pairs = sources.join(targets, "session_no").filter("source <> target")
    g = pairs.groupBy("origin", "source", "target", "horizon").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("c")).filter(F.col("n") >= LEAST_ROWS)
    return g.select("origin", "source", "target", "horizon", F.round("c", 6).alias("coefficient"), (F.abs(F.round("c", 6)) >= SELECTED).alias("selected"))


def by_origin(edges: DataFrame) -> DataFrame:
    """One row an origin and pair: selected at any horizon, absolute and signed strength."""
    return edges.groupBy("origin", "source", "target").agg(F.max(F.col("selected").cast("int")).alias("selected_any"), F.round(F.sum(F.abs("coefficient")), 6).alias("absolute_strength"), F.round(F.sum("coefficient"), 6).alias("signed_strength"))


def stability(edges: DataFrame, threshold: float = STABLE) -> DataFrame:
    """Selection, signs, coefficients and support overlap of every pair over the origins.

    The overlap of consecutive supports is 1 where both are empty.
    """
    picked = F.when(F.col("selected"), F.col("coefficient"))
    signs = lambda s: F.sum(F.when(F.col("selected") & (F.signum("coefficient") == s), 1).otherwise(0))
    base = edges.groupBy("source", "target").agg(
        F.sum(F.col("selected").cast("int")).alias("n_selected"), signs(1.0).alias("positive"), signs(-1.0).alias("negative"),
        F.percentile(picked, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.min(F.when(F.col("selected"), F.col("origin"))).cast("long").alias("first_selection"), F.max(F.when(F.col("selected"), F.col("origin"))).cast("long").alias("last_selection"),
    )
    origins = by_origin(edges).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n_origins"), F.avg("selected_any").alias("p"), F.median("absolute_strength").alias("median_strength"))
    supports = edges.groupBy("source", "target", "origin").agg(F.collect_set(F.when(F.col("selected"), F.col("horizon"))).alias("s"))
    last = F.lag("s").over(Window.partitionBy("source", "target").orderBy("origin"))
    union = F.size(F.array_union("s", "last"))
    overlap = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("s", "last")) / union)
    jaccard = supports.withColumn("last", last).filter(F.col("last").isNotNull()).groupBy("source", "target").agg(F.avg(overlap).alias("j"))
    j = base.join(origins, ["source", "target"]).join(jaccard, ["source", "target"], "left")
    value = lambda i: F.round(F.coalesce(F.col("q")[i], F.lit(0.0)), 8)
    return j.select(
        "source", "target", "n_origins", F.round("p", 6).alias("selection_probability"), F.when(F.col("n_selected") > 0, F.round(F.greatest("positive", "negative") / F.col("n_selected"), 6)).alias("sign_consistency"),
        value(1).alias("median_coefficient"), value(0).alias("coefficient_q1"), value(2).alias("coefficient_q3"), F.round("median_strength", 8).alias("median_absolute_strength"), F.round("j", 6).alias("support_jaccard"),
        "first_selection", "last_selection", (F.col("p") >= threshold).alias("stable_edge"),
    )


def density(edges: DataFrame, stable: DataFrame) -> DataFrame:
    """Share of possible edges by origin, then over origins; and that of stable edges."""
    origins = by_origin(edges)
    n = origins.select(F.col("source").alias("s")).unionByName(origins.select(F.col("target").alias("s"))).agg(F.countDistinct("s").alias("n"))
    possible = F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1))
    one = origins.groupBy("origin").agg(F.sum("selected_any").alias("k")).join(F.broadcast(n)).withColumn("density", F.col("k") / possible)
    g = one.groupBy("n").agg(F.count(F.lit(1)).alias("n_origins"), F.avg("density").alias("mean"), F.min("density").alias("min"), F.max("density").alias("max"))
    s = stable.agg(F.coalesce(F.sum(F.col("stable_edge").cast("int")), F.lit(0)).alias("n_stable_edges"))
    return g.join(F.broadcast(s)).select("n_origins", *(F.round(c, 6).alias(f"{c}_edge_density") for c in ("mean", "min", "max")), "n_stable_edges", F.round(F.col("n_stable_edges") / possible, 6).alias("stable_edge_density"), possible.alias("possible_directed_edges"))


def centrality(stable: DataFrame) -> DataFrame:
    """Outgoing and incoming strength of every symbol; 0 on a side it doesn't have."""

    def side(column: str, name: str) -> DataFrame:
        g = stable.groupBy(F.col(column).alias("symbol")).agg(F.sum("median_absolute_strength").alias("s"), F.avg("selection_probability").alias("p"), F.sum(F.col("stable_edge").cast("int")).alias("k"))
        return g.select("symbol", F.round("s", 8).alias(f"{name}_strength"), F.round("p", 7).alias(f"{name}_selection_probability"), F.col("k").alias(f"{name}_stable_edges"))

    return side("source", "outgoing").join(side("target", "incoming"), "symbol", "full").na.fill(0).na.fill(0.0)


def connectivity(stable: DataFrame, members: DataFrame) -> DataFrame:
    """Edges within and between groups (group, symbol; a symbol may be in several); pairs without edges are rows too."""
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("k"))
    s, t = sizes.select(F.col("group").alias("source_group"), F.col("k").alias("ks")), sizes.select(F.col("group").alias("target_group"), F.col("k").alias("kt"))
    same = F.col("source_group") == F.col("target_group")
    frame = s.join(F.broadcast(t)).withColumn("possible", F.greatest(F.col("ks") * F.col("kt") - F.when(same, F.col("ks")).otherwise(0), F.lit(0)))
    inside = stable.join(members.select(F.col("group").alias("source_group"), F.col("symbol").alias("source")), "source").join(members.select(F.col("group").alias("target_group"), F.col("symbol").alias("target")), "target")
    g = inside.groupBy("source_group", "target_group").agg(F.avg("selection_probability").alias("p"), F.median("median_absolute_strength").alias("m"), F.sum(F.col("stable_edge").cast("int")).alias("k"))
    j = frame.join(g, ["source_group", "target_group"], "left")
    k = F.coalesce("k", F.lit(0))
    return j.select("source_group", "target_group", same.alias("within_group"), F.col("possible").alias("possible_directed_edges"), F.round(F.coalesce("p", F.lit(0.0)), 6).alias("mean_selection_probability"), F.round(F.coalesce("m", F.lit(0.0)), 8).alias("median_edge_strength"), k.alias("stable_edges"), F.round(F.try_divide(k, "possible"), 6).alias("stable_edge_density"))
