import pytest

import __spark_entry__ as entry
from tests.oracle import compare
from waymark.operators import network as N
from waymark.plans import queries as J

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", J.QUERIES)
def test_against_sql(spark, name):
    compare(spark, J.QUERIES[name], J.SQL[name], D)


@pytest.mark.parametrize("name", [x for x in J.QUERIES if x != "layer_unknown"])
def test_not_empty(spark, name):
    assert J.QUERIES[name](spark, D).head() is not None


def test_loads_fail_and_succeed(spark):
    got = {r.load: (r.drawn > 0, r.failed, r.by_unknown_place) for r in J.strict_loads(spark, D).collect()}
    assert got == {"known": (True, False, False), "all": (False, True, True), "broken": (False, True, False)}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(J.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_layers_read_stops_once(spark):
    """Edges, ranks and markers come from the kept ends of trips, not each from all stops again."""
    out = J._layer("all")(spark, D)
    files = out.inputFiles()
    assert files and not [f for f in files if "lineitem" in f]


def test_places_are_broadcast(spark):
    """A few places meet the stops where these are."""
    plan = N.trip_ends(J.rail_stops(spark, D), J.rail_places(spark, D))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_hover_text_ranks_nothing(spark):
    """Texts need no rank, so none is made, and stops are read once."""
    out = J.hover_text(spark, D)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert not [f for f in out.inputFiles() if "lineitem" in f]


def test_ends_are_hashed(spark):
    """No stop is sorted to find the ends of trips, and names are not moved with stops."""
    stops, places = J.rail_stops(spark, D), J.rail_places(spark, D)
    for df in (N.endpoint_counts(stops), N.end_stops(stops, places)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan and "s_name" not in plan


def test_hover_text_reads_no_python_rows(spark):
    """Places of the plan's own are no list that Python workers read."""
    plan = J.hover_text(spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan
