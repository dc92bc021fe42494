"""Queries over scans, sinks and ledgers: what is written is read back, so that SQL can check the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.operators import grid, summaries
from gridloom.plans.ctes import BARS, DAYS
from gridloom.plans.panel_queries import MEMBERS, SORTED, days
from gridloom.plans.registry import query
from gridloom.plans.summary_queries import GROUPS
from gridloom.sources import ledgers, panels
from gridloom.sources.shared import folder


def own_path(spark, label: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{folder(spark)}/gridloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


# -- scans ------------------------------------------------------------------------------------


@query("panel_scan", "SELECT event_id, event_type, CASE WHEN NOT isnan(value) THEN value END AS value FROM events")
def panel_scan(spark, sf):
    return panels.no_nan(panels.scan(spark, sf, "events", "event_id", "event_type", "value"))


@query("session_numbers", f"WITH {DAYS} SELECT day, session_no FROM days")
def session_numbers(spark, sf):
    return days(spark, sf).select("day", "session_no")


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    rows = panels.scan(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = own_path(spark, "customer-csv")
    ledgers.write_csv(rows, path)
    return ledgers.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


# -- partitioned sinks ------------------------------------------------------------------------


def by_month(spark, sf) -> str:
    path = own_path(spark, "months")
    ledgers.write_months(panels.bars(spark, sf), path)
    return path


@query("month_sink_round_trip", f"WITH {BARS} SELECT session, bar, symbol, round(close, 8) AS close, volume FROM bars")
def month_sink_round_trip(spark, sf):
    """Bars written by month and symbol and consolidated again."""
    return ledgers.consolidated(spark, by_month(spark, sf)).select("session", "bar", "symbol", F.round("close", 8).alias("close"), "volume")


WANTED = [*SORTED, "refund"]


@query("incomplete_months", f"WITH {BARS}, want AS (SELECT unnest({WANTED}) AS symbol), months AS (SELECT DISTINCT strftime(session, '%Y-%m') AS month FROM bars) SELECT month, string_agg(symbol, ',' ORDER BY symbol) AS lacking FROM months CROSS JOIN want WHERE (month, symbol) NOT IN (SELECT strftime(session, '%Y-%m'), symbol FROM bars) GROUP BY month")
def incomplete_months(spark, sf):
    """Months without bars of a wanted symbol; one symbol never occurs, so every month lacks it."""
    found = ledgers.incomplete_months(spark, by_month(spark, sf), WANTED)
    return found.select(F.col("month").cast("string").alias("month"), F.array_join(F.array_sort("lacking"), ",").alias("lacking"))


# -- ledgers ----------------------------------------------------------------------------------


def orders(spark, sf):
    return panels.scan(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@query("canonical_ledger", "SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def canonical_ledger(spark, sf):
    return ledgers.canonical(orders(spark, sf), ["o_custkey", "o_orderpriority"], ["o_totalprice"], "o_orderkey", rtol=0.5)[0]


@query("ledger_conflicts", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING coalesce(max(o_totalprice) - min(o_totalprice) > 1e-12 + 0.5::DOUBLE * greatest(abs(max(o_totalprice)), abs(min(o_totalprice))), false) OR (count(o_totalprice) > 0 AND count(o_totalprice) < count(*))")
def ledger_conflicts(spark, sf):
    """Keys whose repeats are apart by more than half of the larger one."""
    return ledgers.canonical(orders(spark, sf), ["o_custkey", "o_orderpriority"], ["o_totalprice"], "o_orderkey", rtol=0.5)[1]


@query("ledger_violations", "SELECT 'forbidden:outcome' AS violation, 1::BIGINT AS n UNION ALL SELECT 'missing:model', 1 UNION ALL SELECT 'nonpositive_forecasts', count(*) FILTER (coalesce(l_discount, 0) <= 0) FROM lineitem HAVING count(*) FILTER (coalesce(l_discount, 0) <= 0) > 0 UNION ALL SELECT 'repeated_keys', count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) HAVING count(*) > 0")
def ledger_violations(spark, sf):
    """What is wrong with line items taken for a forecast ledger: discounts as forecasts, an outcome, no model."""
    rows = panels.scan(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    ledger = rows.withColumnsRenamed({"l_discount": "forecast", "l_tax": "outcome"})
    return ledgers.violation_rows(ledger, ["l_partkey", "l_suppkey"], ["forecast", "model"])


@query("ledger_round_trip", "SELECT o_orderkey, o_totalprice, 'large' AS spec FROM orders WHERE o_totalprice >= 200000 UNION ALL SELECT o_orderkey, o_totalprice, 'small' FROM orders WHERE o_totalprice < 100000")
def ledger_round_trip(spark, sf):
    """Two specifications of a run; the first is written twice, and the later rows replace the earlier."""
    rows, path = orders(spark, sf).select("o_orderkey", "o_totalprice"), own_path(spark, "ledger")
    ledgers.append_ledger(rows.filter("o_totalprice >= 100000"), path, "run", "large")
    ledgers.append_ledger(rows.filter("o_totalprice >= 200000"), path, "run", "large")
    ledgers.append_ledger(rows.filter("o_totalprice < 100000"), path, "run", "small")
    ledgers.append_ledger(rows, path, "other", "small")
    return ledgers.read_ledger(spark, path, "run").select("o_orderkey", "o_totalprice", F.col("spec").cast("string").alias("spec"))


# -- rollups over a ledger of loadings that comes from a table --------------------------------

TABLE_LOADINGS = """
loads AS (SELECT date_diff('month', DATE '1992-01-01', l_shipdate::DATE)::BIGINT AS window_no, CASE WHEN l_linenumber % 2 = 1 THEN 'LF1' ELSE 'LF2' END AS factor, symbol, round(avg(l_discount) - 0.05, 9) AS loading
  FROM (SELECT *, l_returnflag || l_linestatus AS symbol FROM lineitem) WHERE symbol IN ('NF', 'NO', 'RF', 'RO') AND l_shipdate IS NOT NULL GROUP BY 1, 2, 3),
grps AS (SELECT * FROM (VALUES ('open', ['NO', 'RO']), ('final', ['NF', 'RF']), ('returned', ['RF', 'RO'])) g("group", inside)),
conc AS (SELECT window_no, factor, "group", sum(abs(loading)) FILTER (list_contains(inside, symbol)) / nullif(sum(abs(loading)), 0) AS share,
  avg(abs(loading)) FILTER (list_contains(inside, symbol)) / greatest(avg(abs(loading)) FILTER (NOT list_contains(inside, symbol)), 1e-12) AS density_ratio FROM loads CROSS JOIN grps GROUP BY 1, 2, 3)"""


def table_loadings(spark, sf):
    """window_no, factor, symbol, loading: mean discounts less 0.05 by month, parity of the line and symbol."""
    rows = panels.scan(spark, sf, "lineitem", "l_shipdate", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount")
    month = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("long")
    keyed = rows.filter("l_shipdate is not null").select(month.alias("window_no"), F.when(F.col("l_linenumber") % 2 == 1, "LF1").otherwise("LF2").alias("factor"), F.concat("l_returnflag", "l_linestatus").alias("symbol"), "l_discount")
    return keyed.filter(F.col("symbol").isin(MEMBERS[2:])).groupBy("window_no", "factor", "symbol").agg(F.round(F.avg("l_discount") - 0.05, 9).alias("loading"))


def table_concentration(spark, sf):
    return summaries.concentration(table_loadings(spark, sf), GROUPS, MEMBERS[2:])


@query("table_group_concentration", f"WITH {TABLE_LOADINGS} SELECT window_no, factor, \"group\", round(share, 5) AS share, round(density_ratio, 4) AS density_ratio FROM conc")
def table_group_concentration(spark, sf):
    return table_concentration(spark, sf).select("window_no", "factor", "group", F.round("share", 5).alias("share"), F.round("density_ratio", 4).alias("density_ratio"))


LEAST = {"open": 0.55, "final": 0.55, "returned": 0.55}


@query("table_candidate_summary", f"WITH {TABLE_LOADINGS}, c AS (SELECT factor, \"group\", median(share) AS ms, median(density_ratio) AS md, avg((share >= 0.55 AND density_ratio >= 1.5)::INT) AS rate FROM conc GROUP BY 1, 2) SELECT factor, \"group\", round(ms, 5) AS median_share, round(md, 4) AS median_density_ratio, round(rate, 6) AS recurrence_rate, rate >= 0.6 AS recurring FROM c")
def table_candidate_summary(spark, sf):
    found = summaries.candidates(table_concentration(spark, sf), LEAST)
    return found.select("factor", "group", F.round("median_share", 5).alias("median_share"), F.round("median_density_ratio", 4).alias("median_density_ratio"), F.round("recurrence_rate", 6).alias("recurrence_rate"), "recurring")


@query("table_stress_comparison", f"WITH {TABLE_LOADINGS}, s AS (SELECT factor, count(*) FILTER (inside) AS n_inside, count(*) FILTER (NOT inside) AS n_outside, median(share) FILTER (inside) AS a, median(share) FILTER (NOT inside) AS b FROM (SELECT *, window_no BETWEEN 40 AND 60 AS inside FROM conc WHERE \"group\" = 'returned') GROUP BY 1) SELECT factor, n_inside, n_outside, round(a, 5) AS inside, round(b, 5) AS outside, coalesce(a > b, false) AS stronger FROM s")
def table_stress_comparison(spark, sf):
    found = summaries.stress(table_concentration(spark, sf), "returned", 40, 60)
    return found.select("factor", "n_inside", "n_outside", F.round("inside", 5).alias("inside"), F.round("outside", 5).alias("outside"), "stronger")


@query("table_loading_importance", f"WITH {TABLE_LOADINGS}, m AS (SELECT factor, symbol, avg(abs(loading)) AS importance FROM loads GROUP BY 1, 2) SELECT factor, symbol, round(importance, 8) AS importance, rank FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY importance DESC, symbol)::INT AS rank FROM m) WHERE rank <= 4")
def table_loading_importance(spark, sf):
    return summaries.importance(table_loadings(spark, sf), 4).withColumn("importance", F.round("importance", 8))
