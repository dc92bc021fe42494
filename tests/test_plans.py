"""Plans: scans read only what is asked for, sources are scanned once, and windows of sessions are equality joins."""

from gridloom.operators import windows
from gridloom.plans import panel_queries
from gridloom.sources import panels
from gridloom.sources.shared import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark):
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan(panels.bars(spark, SF))
    text = plan(panels.daily_levels(spark, SF))
    assert "l_shipdate" in text and "l_quantity" not in text and "l_comment" not in text


def test_filters_reach_the_reader(spark):
    df = panels.scan(spark, SF, "events", "event_id", "value").filter("event_id > 5")
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,5)]" in plan(df)


def test_sources_are_scanned_once_a_query(spark):
    sf = Tables(SF)
    text = plan(panel_queries.scored(spark, sf))
    assert "lineitem.parquet" not in text and set(sf.settled) == {"daily_levels"}
    text = plan(panel_queries.realized(spark, sf))
    assert "events.parquet" not in text and set(sf.settled) == {"daily_levels", "bars"}


def test_window_joins_are_equality_joins(spark):
    days = spark.range(1, 200).selectExpr("cast(id as int) as session_no", "date_add(date'2024-01-01', cast(id as int)) as day")
    joined = windows.sessions_of(windows.rolling(days, 60, 20).hint("shuffle_merge"), days)
    assert "BroadcastNestedLoopJoin" not in plan(joined) and "CartesianProduct" not in plan(joined)
    assigned = windows.assignment(windows.rolling(days, 60, 20).selectExpr("window_no as block_no", "end_no as training_end", "start_no as score_start", "end_no as score_end"), days)
    assert "NestedLoop" not in plan(assigned) and "Cartesian" not in plan(assigned)
