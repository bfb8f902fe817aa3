"""Drawn trips: in proportion, within their span, the same however they are dealt out."""

from collections import Counter

import pytest

from velonet.operators import demand

PLACES = [(i, 24.9 + 0.01 * i, 60.2, w) for i, w in enumerate([1, 0, 3, 6, 2, 8])]


def table(spark, rows=PLACES):
    return spark.createDataFrame(rows, "node long, lon double, lat double, weight long")


def test_shares_cover_the_whole_in_order(spark):
    got = [(r.node, r.low, r.high) for r in demand.cumulative(table(spark), 3).orderBy("node").collect()]
    assert got == [(0, 0, 1), (2, 1, 4), (3, 4, 10), (4, 10, 12), (5, 12, 20)]


@pytest.mark.parametrize("buckets", [1, 3, 20, 4096])
def test_every_draw_finds_its_share(spark, buckets):
    shares = demand.cumulative(table(spark))
    draws = spark.range(20).selectExpr("id as trip", "id as u")
    got = {r.trip: r.node for r in demand.pick(draws, shares, "u", 20, buckets).collect()}
    assert [got[i] for i in range(20)] == [0] + [2] * 3 + [3] * 6 + [4] * 2 + [5] * 8


def test_trips_span_and_follow_weights(spark):
    ids = spark.range(3000).withColumnRenamed("id", "trip")
    got = sorted(map(tuple, demand.trips(ids, table(spark), table(spark), span=(500.0, 1_200.0)).collect()))
    again = sorted(map(tuple, demand.trips(ids.repartition(7), table(spark, PLACES[::-1]), table(spark), span=(500.0, 1_200.0)).collect()))
    assert got == again and [t for t, *_ in got] == list(range(3000)) and all(500 <= m <= 1200 for *_, m in got)
    pairs = Counter((a, b) for _, a, b, _ in got)
    weight = {(a, b): wa * wb for a, xa, _, wa in PLACES for b, xb, _, wb in PLACES if a != b and abs(a - b) <= 2 and wa * wb}
    total = sum(weight.values())
    assert set(pairs) <= set(weight) and all(abs(pairs[p] - 3000 * w / total) < 5 * (3000 * w / total) ** 0.5 + 1 for p, w in weight.items())


def test_no_pair_and_no_weight(spark):
    ids = spark.range(3).withColumnRenamed("id", "trip")
    with pytest.raises(RuntimeError):
        demand.trips(ids, table(spark), table(spark), span=(1e6, 2e6), max_rounds=1)
    with pytest.raises(ValueError):
        demand.trips(ids, table(spark).limit(0), table(spark))
    assert demand.trips(ids.limit(0), table(spark), table(spark)).count() == 0


def test_trips_without_a_pair_may_be_left_out(spark):
    """As many draws as asked for, and those that found a pair are the same whatever others did."""
    ids = spark.range(200).withColumnRenamed("id", "trip")
    whole = {r.trip: tuple(r) for r in demand.trips(ids, table(spark), table(spark), span=(500.0, 600.0)).collect()}
    some = {r.trip: tuple(r) for r in demand.trips(ids, table(spark), table(spark), span=(500.0, 600.0), max_rounds=1, all_found=False).collect()}
    assert 0 < len(some) < len(whole) == 200 and all(whole[t] == row for t, row in some.items())


def test_only_draws_that_may_span_are_looked_up(spark, monkeypatch):
    """Draws whose stretches lie too far apart meet no share, and the trips are those of looking up all."""
    from pyspark.sql import functions as F

    # across the pole, too: a row there stands where the one beside it does
    places = spark.range(4000).select(F.col("id").alias("node"), (24.9 + (F.col("id") % 20) * 0.002).alias("lon"), (89.9 + F.floor(F.col("id") / 20) * 0.001).alias("lat"), (1 + F.col("id") % 3).alias("weight"))
    ids, seen, pick = spark.range(400).withColumnRenamed("id", "trip"), [], demand.pick

    def counted(draws, *args):
        seen.append(draws.count())
        return pick(draws, *args)

    monkeypatch.setattr(demand, "pick", counted)
    got = {r.trip: tuple(r) for r in demand.trips(ids, places, places, span=(300.0, 1_500.0), max_rounds=1, all_found=False).collect()}
    assert seen[0] < 400 * demand.ATTEMPTS / 4
    monkeypatch.setattr(demand, "_apart", lambda: F.lit(0.0))
    whole = {r.trip: tuple(r) for r in demand.trips(ids, places, places, span=(300.0, 1_500.0), max_rounds=1, all_found=False).collect()}
    assert got == whole and 50 < len(got) < 400
