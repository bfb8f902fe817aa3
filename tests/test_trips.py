"""The routed queries cover all orders, and equal ends are searched once."""

import pytest
from pyspark.sql import functions as F
from test_routing import GRID, build, random_grid, run

from velonet.plans import queries as Q
from velonet.plans.derived import Derived


@pytest.fixture
def few(spark, tmp_path):
    """35 junctions of a 30-wide grid and 200 orders."""
    spark.range(35).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1, 201).select(F.col("id").alias("o_orderkey"), F.expr("(id div 3 + id * 11) % 35").alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_every_order_is_a_trip(spark, few):
    d = Derived(spark, few)
    at = {i: (i // 3 + i * 11) % 35 for i in range(1, 201)}
    want = {(i, c, (c * 31 + 7) % 35) for i, c in at.items()}
    assert {tuple(r) for r in d.trip.collect()} == want
    paths = Q._routed(d, 1)[0].collect()
    ends = {p: (a, b) for p, a, b in want}
    by = {}
    for r in paths:
        by.setdefault(ends[r.pair], {}).setdefault(r.pair, set()).add((r.pos, r.state))
    assert len({r.pair for r in paths}) > 10
    for e, routes in by.items():  # all trips of the same ends, each with the same whole route
        assert set(routes) == {p for p, x in ends.items() if x == e}
        assert len({frozenset(x) for x in routes.values()}) == 1
    usage = {r.edge: r.trips for r in Q.QUERIES["trip_usage"](spark, few).collect()}
    assert usage and usage == _count(paths)
    assert {r.pair for r in Q.QUERIES["route_rollup"](spark, few).collect()} == {r.pair for r in paths}


def _count(paths):
    trips = {}
    for r in paths:
        if r.pos >= 0:
            trips[r.state // 2] = trips.get(r.state // 2, 0) + 1
    return trips


def test_equal_ends_have_equal_routes(spark):
    rolled, paths, _ = run(spark, build(spark, GRID, random_grid(3)), [(0, 15), (0, 15), (3, 12), (0, 15), (5, 5), (5, 5)], limit=3)
    got = {}
    for r in paths.collect():
        got.setdefault(r.pair, []).append((r["rank"], r.pos, r.state, r.swing))
    assert sorted(got[0]) == sorted(got[1]) == sorted(got[3]) and sorted(got[4]) == sorted(got[5]) == [(1, -1, -1, 0.0)]


def test_found_routes_are_never_broadcast(spark):
    """Spark takes the edges of routes for as few as their ends: neither for unique nor for equal ends may they be sent to the driver."""
    from velonet.functions import cost as K
    from velonet.operators import routing

    edges, nodes = build(spark, GRID, random_grid(3))
    states = routing.priced(edges, nodes, K.CostModel(), K.Taste())
    graph, metres = routing.load(states, nodes, K.CostModel(), K.Taste())
    for rows in ([(0, 0, 15), (1, 3, 12)], [(0, 0, 15), (1, 0, 15), (2, 3, 12)]):
        found = routing.routes(graph, metres, spark.createDataFrame(rows, "pair long, start long, goal long"))
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and {r.pair for r in found.collect()} == {r[0] for r in rows}
