import math

import pytest
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import cost as K
from velonet.functions import geo, profile, tags, text


def values(spark, columns, rows=1):
    return spark.range(rows).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_pinned_constants():
    assert (C.SIGNAL_S, C.CROSSING_S, C.TURN_S, C.LEFT_FACTOR, C.SLOW_FACTOR, C.NETWORK_BONUS) == (30, 2, 10, 1.5, 0.65, 0.9)
    assert (C.ALTERNATIVE_RATIO, C.ALTERNATIVE_OVERLAP, C.ALTERNATIVE_PENALTY) == (1.3, 0.70, 1.6)
    assert (C.REGISTER_NEAR, C.REGISTER_FAR, C.WALK_M, C.CLIMB_THRESHOLD, C.WINTER_M) == (40, 80, 240, 2, 14)


def test_distance_bearing_swing(spark):
    l = F.lit  # noqa: E741
    d, n, e, left, back = values(spark, [geo.distance_m(l(24.94), l(60.17), l(24.941), l(60.17)), geo.bearing(l(24.94), l(60.17), l(24.94), l(60.18)), geo.bearing(l(24.94), l(60.17), l(24.95), l(60.17)), geo.swing(l(90.0), l(0.0)), geo.swing(l(10.0), l(190.0))])
    assert d == pytest.approx(0.001 * math.cos(math.radians(60.17)) * 111320)
    assert n == pytest.approx(0) and e == pytest.approx(90)
    assert left == -90 and back == -180


def test_parallel_headings_follow_the_unfolded_rule(spark):
    pick = lambda a, b, f=False: geo.same_heading(F.lit(a), F.lit(b), folded=f)
    assert list(values(spark, [pick(10.0, 30.0), pick(0.0, 180.0), pick(0.0, 170.0), pick(0.0, 170.0, True)])) == [True, True, False, True]


def test_segment_distance_clamps(spark):
    on, off = values(spark, [geo.segment_distance_m(F.lit(24.941), F.lit(60.17), F.lit(24.94), F.lit(60.17), F.lit(24.942), F.lit(60.17)), geo.segment_distance_m(F.lit(24.943), F.lit(60.17), F.lit(24.94), F.lit(60.17), F.lit(24.942), F.lit(60.17))])
    assert on == pytest.approx(0, abs=1e-6) and off == pytest.approx(0.001 * math.cos(math.radians(60.17)) * 111320)


def test_zigzag_round_trip(spark):
    for v in (0, 1, -1, 5, -77, 2**40, -(2**40)):
        z, back = values(spark, [geo.zigzag(F.lit(v)), geo.unzigzag(geo.zigzag(F.lit(v)))])
        assert back == v and z >= 0


def one(spark, f, t):
    return spark.createDataFrame([(t,)], "t map<string,string>").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "f,t,want",
    [
        (tags.rideable, {"highway": "residential"}, True), (tags.rideable, {"highway": "residential", "bicycle": "no"}, False), (tags.rideable, {"highway": "footway"}, False),
        (tags.rideable, {"highway": "footway", "bicycle": "designated"}, True), (tags.rideable, {}, False),
        (tags.is_signal, {"highway": "crossing", "crossing:signals": "yes"}, True), (tags.is_signal, {"crossing": "traffic_signals"}, False),
        (tags.node_kind, {"highway": "crossing", "crossing": "traffic_signals", "crossing:island": "yes"}, 3), (tags.node_kind, {"highway": "crossing"}, 1), (tags.node_kind, {}, 0),
        (tags.barrier_kind, {"barrier": "gate"}, 2), (tags.barrier_kind, {"barrier": "bollard"}, 1), (tags.barrier_kind, {"barrier": "kerb"}, 1), (tags.barrier_kind, {"barrier": "kerb", "kerb": "flush"}, 0), (tags.barrier_kind, {"kerb": "raised"}, 1),
        (tags.bicycle_direction, {"oneway": "yes"}, 1), (tags.bicycle_direction, {"oneway": "yes", "oneway:bicycle": "no"}, 0), (tags.bicycle_direction, {"oneway": "yes", "cycleway": "opposite_lane"}, 0),
        (tags.bicycle_direction, {"oneway": "-1"}, -1), (tags.bicycle_direction, {"junction": "roundabout"}, 1), (tags.bicycle_direction, {"junction": "roundabout", "oneway": "no"}, 0),
        (tags.surface_kind, {"highway": "path", "surface": "gravel"}, 1), (tags.surface_kind, {"highway": "path"}, 2), (tags.surface_kind, {"highway": "path", "foot": "no"}, 0), (tags.surface_kind, {"highway": "residential"}, 0),
        (tags.surface_grade, {"surface": "sett"}, 2), (tags.surface_grade, {}, 0), (tags.traffic_class, {"highway": "primary"}, 4), (tags.traffic_class, {"highway": "odd"}, 2),
        (tags.is_elevated, {"bridge": "yes"}, True), (tags.is_elevated, {"layer": "0"}, False), (tags.is_elevated, {}, False),
        (tags.has_sidepath, {"cycleway:left": "separate"}, True), (tags.has_sidepath, {"bicycle": "use_sidepath"}, True), (tags.has_sidepath, {}, False),
        (tags.poi_kind, {"tourism": "museum", "shop": "books"}, "attraction"), (tags.poi_kind, {"shop": "books"}, "shop"), (tags.poi_kind, {"barrier": "gate"}, None), (tags.poi_kind, {"place": "island"}, "nature"),
        (tags.names_of, {"name": "Oodi", "alt_name": "Kirjasto; Oodi ;"}, ["Oodi", "Kirjasto"]), (tags.notability, {"name": "A", "wikipedia": "fi:A"}, 2), (tags.notability, {"name": "A", "wikipedia": "fi:A (B)"}, 1), (tags.notability, {"name": "A", "wikidata": "Q1"}, 1), (tags.notability, {"name": "A"}, 0),
    ],
)
def test_classifiers(spark, f, t, want):
    assert one(spark, f, t) == want


@pytest.mark.parametrize("q,street,number", [("Hämeentie 12 B", "Hämeentie", "12 B"), ("Hämeentie", "Hämeentie", ""), ("Katu, 5-7 ", "Katu", "5-7"), ("12", "12", "")])
def test_query_parts(spark, q, street, number):
    assert list(values(spark, [*text.query_parts(F.lit(q))])) == [street, number]


def test_text_shaping(spark):
    assert list(values(spark, [text.fold(F.lit("  ÄÅÖ É  x ")), text.kind_label(F.lit("park")), text.kind_label(F.lit("?")), text.km_comma(F.lit(12345.0)), text.friction_minutes(F.lit(150.0), F.lit(80.0))])) == ["aao e x", "Puisto", "Paikka", "12,3", 2]


def test_profile_token(spark):
    enc = profile.encode({"traffic": F.lit(3.0), "turn": F.lit(1.0), "hill": F.lit(2.5), "signal_delay_s": F.lit(45.0)})
    dec = profile.decode(F.lit("c3h2.5q9S45T99c8b0.01"))
    a, b = values(spark, [enc, dec])
    assert a == "c3h2.5S45"
    assert b == {"hill": 2.5, "signal_delay_s": 45.0, "traffic": 8.0}
    assert profile.preset_taste("paved")["unpaved"] == 4 and profile.default_taste()["sidepath"] == 8


def test_trip_link(spark):
    p = profile.trip_parameters(F.lit("http://x/?a=24.94000,60.17000&b=24.95,60.18&v=40&p=c3"))
    got = values(spark, [p[k] for k in ("from_lon", "to_lat", "speed", "token")])
    assert list(got) == [24.94, 60.18, None, "c3"]


EDGE = {"length": 100.0, "unpaved": 40.0, "shared": 10.0, "lit": 50.0, "grade": 2, "traffic": 3, "signals": 1, "crossings": 2, "barriers": 1, "class": 6}


def test_edge_seconds_and_taste(spark):
    df = spark.createDataFrame([tuple(EDGE.values())], list(EDGE))
    names, m = set(EDGE), K.CostModel()
    ride = 50 / 5 + 40 / (0.65 * 5) + 10 / (0.65 * 5)
    got = df.select(K.ride_seconds(m, names), K.edge_seconds(m, names), K.edge_search_seconds(m, K.Taste(), names), K.edge_search_seconds(m, K.Taste({"unpaved": 4, "lit": 0.8, "traffic": 2, "sidepath": 1, "network": 1}), names)).first()
    assert got[0] == pytest.approx(ride) and got[1] == pytest.approx(ride + 30 + 4 + 4)
    assert got[2] == pytest.approx((ride + 38) * 8 * 0.9)
    assert got[3] == pytest.approx((50 / 5 + 4 * 40 / 3.25 + 10 / 3.25 + 38 - 50 / 5 * 0.2) * 2)


def test_taste_is_held_above_zero():
    assert K.Taste({"traffic": 0.0})["traffic"] == C.LEAST_MULTIPLIER
    assert K.heuristic_floor(K.Taste({"traffic": 0.05})) >= 0


def test_stored_numbers_are_range_checked(spark):
    got = values(spark, [profile.in_range("speed", F.lit(50.0)), profile.in_range("speed", F.lit(18.0)), profile.in_range("turn", F.lit(0.01)), profile.in_range("slow_speed_factor", F.lit(0.5))])
    assert list(got) == [None, 18.0, None, 0.5]
    assert profile.stops_table(spark).filter("standard").count() == 11
