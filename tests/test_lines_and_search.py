import math
import random

import pytest
from pyspark.sql import functions as F

from velonet.operators import evaluate, search, signals, spatial, winter
from velonet.operators import profile as lines


@pytest.mark.parametrize(
    "heights,want",
    [([10.0] * 20, (0, 0)), ([i * 50 / 99 for i in range(100)], (50, 0)), ([0, 5, 10, 5, 0, 5, 10], (20, 10)), ([0, 10, 20, 30, 20, 10, 4], (30, 26)), ([0, 5, None, 10], (10, 0)), ([None, None], (0, 0)), ([3.0], (0, 0)), ([0.0, 1.5, 0.0, 1.5], (1.5, 0)), ([], (0, 0))],
)
def test_hysteresis(spark, heights, want):
    df = spark.createDataFrame([([None if h is None else float(h) for h in heights],)], "h array<double>")
    g = df.select(lines.gain_loss(F.col("h")).alias("g")).first().g
    assert (g.gain, g.loss) == (pytest.approx(want[0]), pytest.approx(want[1]))


def line(spark, metres):
    return spark.createDataFrame([(1, 0, 24.94, 60.17), (1, 1, 24.94, 60.17 + metres / 110540)], "line long, pos int, lon double, lat double")


def test_resample(spark):
    assert 40 <= lines.resample(line(spark, 1000), "line", "pos").count() <= 43
    assert sorted(round(r.at, 3) for r in lines.resample(line(spark, 8), "line", "pos").collect()) == [0, 8]
    assert lines.resample(line(spark, 0), "line", "pos").count() == 1
    got = lines.resample(line(spark, 60), "line", "pos").orderBy("at").collect()
    assert [round(r.at) for r in got] == [0, 25, 50, 60] and got[1].lat == pytest.approx(60.17 + 25 / 110540)


def test_thin_keeps_extremes(spark):
    df = spark.createDataFrame([(1, float(i), float((i * 37) % 50)) for i in range(101)], "line long, dist double, height double")
    got = lines.thin(df, "line", "dist", "height", 10).collect()
    assert {max(r.height for r in got), min(r.height for r in got)} == {49.0, 0.0} and len(got) == 22
    assert lines.thin(df, "line", "dist", "height", 200).count() == 101


def test_raster_first_tile_wins(spark):
    tiles = spark.createDataFrame([("a", 0, 24.0, 61.0, 0.5, 2, 2), ("b", 1, 24.0, 61.0, 0.5, 4, 4)], "tile string, rank int, west double, north double, size double, rows int, cols int")
    cells = spark.createDataFrame([(t, r, c, float(10 * r + c + (100 if t == "b" else 0))) for t, n in (("a", 2), ("b", 4)) for r in range(n) for c in range(n)], "tile string, row long, col long, height double")
    pts = spark.createDataFrame([(1, 24.6, 60.9), (2, 25.2, 60.9), (3, 10.0, 10.0)], "p long, lon double, lat double")
    assert {r.p: r.height for r in lines.sample_heights(pts, tiles, cells).collect()} == {1: 1.0, 2: 102.0, 3: None}


def points(spark, rows, a="lon", b="lat", key="id"):
    return spark.createDataFrame(rows, f"{key} long, {a} double, {b} double")


def test_grid_join_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    pick = lambda n: [(i, 24.94 + rng.random() * 0.01, 60.17 + rng.random() * 0.005) for i in range(n)]
    left, right = pick(60), pick(60)
    dist = lambda p, q: math.hypot((q[1] - p[1]) * math.cos(math.radians((p[2] + q[2]) / 2)) * 111320, (q[2] - p[2]) * 110540)
    for radius, cell in ((72, 0.001), (300, 0.001), (50, 0.01)):
        got = {(r.id, r.other) for r in spatial.grid_join(points(spark, left), points(spark, right, "to_lon", "to_lat", "other"), radius, cell).collect()}
        assert got == {(p[0], q[0]) for p in left for q in right if dist(p, q) <= radius}
    near = {r.id: r.other for r in spatial.nearest(points(spark, left), points(spark, right, "to_lon", "to_lat", "other"), "id", ["other"], start_m=20.0).collect()}
    assert near == {p[0]: min(right, key=lambda q: (dist(p, q), q[0]))[0] for p in left}


def test_a_pole_lists_no_more_cells_than_elsewhere(spark):
    """Cells widen towards a pole, and beyond it, and the pairs are still those of brute force."""
    rows = [(i, 24.9 + (i % 7) * 0.004, 89.9985 + (i // 7) * 0.00025) for i in range(84)]
    dist = lambda p, q: math.hypot((q[1] - p[1]) * math.cos(math.radians((p[2] + q[2]) / 2)) * 111320, (q[2] - p[2]) * 110540)
    assert spatial.listed(points(spark, rows), 30, 0.001).count() < 100 * len(rows)
    got = {(r.id, r.other) for r in spatial.grid_join(points(spark, rows), points(spark, rows, "to_lon", "to_lat", "other"), 30, 0.001).collect()}
    assert got == {(p[0], q[0]) for p in rows for q in rows if dist(p, q) <= 30}


def test_a_long_chain_of_rivals_is_settled(spark):
    """Each of 450 lights in a row waits for the one before: every other one stays."""
    rows = spark.range(450).select(F.col("id").alias("node"), F.lit(24.9).alias("lon"), (F.lit(60.1) + F.col("id") * 0.0002).alias("lat"), F.array().cast("array<long>").alias("roads"))
    assert sorted(r.node for r in signals.suppress_near(rows).collect()) == list(range(0, 450, 2))


def test_seventy_two_metres_east_is_in_reach(spark):
    left = points(spark, [(1, 24.9418, 60.17)])
    right = points(spark, [(0, 24.9418, 60.17), (1, 24.9431, 60.17), (2, 24.9418, 60.1712)], "to_lon", "to_lat", "other")
    assert {r.other for r in spatial.grid_join(left, right, 80, 0.001).collect()} == {0, 1}


def test_nearest_of_nothing(spark):
    assert spatial.nearest(points(spark, [(1, 1.0, 1.0)]), points(spark, [], "to_lon", "to_lat", "other"), "id", ["other"]).count() == 0


def test_suppression_is_greedy_in_node_order(spark):
    rows = [(1, 24.94, 60.17, [1]), (2, 24.9402, 60.17, [1]), (3, 24.9404, 60.17, [1]), (4, 24.9402, 60.17, [9]), (5, 24.95, 60.17, [])]
    df = spark.createDataFrame(rows, "node long, lon double, lat double, roads array<long>")
    # 2 falls to 1; 3 is 22 m from 1, and so falls to 1 as well; 4 shares no road
    assert sorted(r.node for r in signals.suppress_near(df, 15.0).collect()) == [1, 3, 4, 5]
    assert sorted(r.node for r in signals.suppress_near(df, 30.0).collect()) == [1, 4, 5]


def test_claims_see_earlier_claims(spark):
    reg = spark.createDataFrame([(1, "a", 24.0, 60.0), (2, "a", 24.1, 60.0), (3, "b", 24.0, 60.0)], "point long, city string, lon double, lat double")
    c = "point long, kind string, node long, metres double, lit boolean, grounded boolean, walkable boolean, crossing boolean"
    cand = spark.createDataFrame([(1, "cycleway", 7, 10.0, False, True, True, True), (2, "cycleway", 7, 30.0, False, True, True, True), (3, "road", 8, 60.0, False, True, False, True), (3, "road", 9, 70.0, False, True, True, True)], c)
    got = {(r.point, r.kind): (r.node, r.outcome) for r in signals.claim(reg, cand).collect()}
    # of point 3's nodes the nearer one can't be ridden to, so it takes the next
    assert got == {(1, "cycleway"): (7, "claimed"), (2, "cycleway"): (7, "known"), (3, "road"): (9, "claimed")}


DOORS = [("Hämeentie", "1", 24.95, 60.18), ("Hämeentie", "12", 24.951, 60.18), ("Hämeentie", "120", 24.952, 60.18), ("Hämeentie", "2", 24.953, 60.18), ("Uusi Hämeentie", "1", 24.96, 60.18)]


def index(spark):
    doors = spark.createDataFrame([(i, *d) for i, d in enumerate(DOORS + [("Hämeentie", "1", 0.0, 0.0)])], "seq long, street string, number string, lon double, lat double")
    roads = spark.createDataFrame([("Polku", 24.97, 60.18, 1)], "street string, lon double, lat double, seq long")
    places = spark.createDataFrame([(1, "Häme", "suburb", 2, 24.9, 60.1, ""), (2, "Hämeenpuisto", "park", 11, 24.8, 60.1, "Hämeentie"), (3, "Vanha Häme", "quarter", 3, 24.7, 60.1, "")], "place long, name string, kind string, rank int, lon double, lat double, street string")
    address = search.addresses(doors)
    return places, search.streets(address, roads), address


def test_search_order(spark):
    places, streets, address = index(spark)
    q = spark.createDataFrame([(1, "hame"), (2, "hämeentie 12"), (3, "h"), (4, "polku"), (5, "  "), (6, None)], "query long, text string")
    hits = {}
    for r in search.search(q, places, streets, address).orderBy("query", "rank").collect():
        hits.setdefault(r.query, []).append((r.label, r.detail))
    assert [x[0] for x in hits[1]] == ["Häme", "Hämeentie 1", "Hämeenpuisto", "Uusi Hämeentie 1", "Vanha Häme"]
    assert hits[1][2][1] == "Puisto · Hämeentie" and hits[1][1][1] == "Osoite"
    assert [x[0] for x in hits[2]] == ["Hämeentie 12", "Hämeentie 120", "Uusi Hämeentie"]
    assert set(hits) == {1, 2, 4} and hits[4] == [("Polku", "Tie")]


def test_first_door_wins_and_reverse_geocode(spark):
    _, _, address = index(spark)
    assert address.filter("street = 'Hämeentie' and number = '1'").first().lon == 24.95
    got = search.reverse_geocode(points(spark, [(1, 24.9511, 60.18)], key="point"), address).first()
    assert got.label == "Hämeentie 12"


def test_merge_points(spark):
    df = spark.createDataFrame([("A", "park", 1, 24.0, 60.0, 0), ("A", "park", 2, 24.00005, 60.0, 2), ("A", "park", 3, 24.5, 60.0, 1), ("B", "park", 4, 24.0, 60.0, 0)], "name string, kind string, seq long, lon double, lat double, notability int")
    got = sorted((r.name, r.seq, r.notability) for r in search.merge_points(df).collect())
    assert got == [("A", 1, 2), ("A", 3, 1), ("B", 4, 0)]


def merged_in_order(rows, apart):
    """The fold in plain words: each place, in order, joins the first kept one in reach or is kept."""
    kept = {}
    for name, kind, seq, lon, lat, notable in sorted(rows, key=lambda r: (r[2], r[3] or 0.0, r[4], r[5])):
        of = kept.setdefault((name, kind), [])
        hit = next((k for k in of if lon is not None and k[1] is not None and abs(k[1] - lon) < apart and abs(k[2] - lat) < apart), None)
        if hit:
            hit[3] = max(hit[3], notable)
        else:
            of.append([seq, lon, lat, notable])
    return sorted((str(n), str(k), *x[:1], str(x[1]), *x[3:]) for (n, k), of in kept.items() for x in of)


POINTS = "name string, kind string, seq long, lon double, lat double, notability int"


def test_merged_places_equal_the_fold(spark):
    rng = random.Random(11)
    rows = [(rng.choice("AAAB"), rng.choice(("park", "shop")), i, 24 + rng.randrange(60) * 4e-5, 60 + rng.randrange(12) * 4e-5, rng.randrange(3)) for i in range(400)]
    rows += [("H", "shop", 1000 + i, 25.0 + rng.random() * 5e-5, 60.0, i % 3) for i in range(500)]  # one spot of many
    rows += [("L", "shop", 2000 + i, 25.0 + i * 6e-5, 60.0, 1) for i in range(40)]  # a chain in order
    rows += [("N", "shop", 1, None, 60.0, 0), ("N", "shop", 2, None, 60.0, 1), (None, "shop", 3, 24.0, 60.0, 0), (None, "shop", 4, 24.0, 60.0, 2), ("R", "shop", 5, 24.0, 60.0, 1), ("R", "shop", 5, 24.0, 60.0, 1), ("R", "shop", 5, 24.00001, 60.0, 2)]
    got = sorted((str(r.name), str(r.kind), r.seq, str(r.lon), r.notability) for r in search.merge_points(spark.createDataFrame(rows, POINTS).repartition(7)).select(F.col("name").alias("name"), "kind", "seq", "lon", "notability").collect())
    assert got == merged_in_order(rows, 1e-4)


def test_places_out_of_reach_hardly_wait(spark, monkeypatch):
    """A line of places a third wider apart than merging reaches: each waited for the one before it, so there were as many rounds as places."""
    rows, rounds = [("L", "shop", i, 25.0 + i * 1.34e-4, 60.0, 1) for i in range(24)], []
    write = search.Rounds.write
    monkeypatch.setattr(search.Rounds, "write", lambda self, df: rounds.append(1) or write(self, df))
    got = sorted((str(r.name), str(r.kind), r.seq, str(r.lon), r.notability) for r in search.merge_points(spark.createDataFrame(rows, POINTS)).collect())
    assert got == merged_in_order(rows, 1e-4) and len(got) == 24 and len(rounds) <= 8


def test_extract_is_worked_out_once(spark):
    """Tags made on the way are not made anew for every condition on them, nor the points of a way for every side of the box."""
    i = F.col("id")
    at = lambda dx: F.struct((F.lit(24.9) + i * 1e-3 + dx).alias("lon"), F.lit(60.2).alias("lat"))
    tags = F.map_filter(F.create_map(F.lit("tourism"), F.when(i % 2 == 0, "museum"), F.lit("name"), F.lit("Nimi"), F.lit("addr:street"), F.lit("Katu")), lambda _, v: v.isNotNull())
    nodes = spark.range(60).select("id", at(0.0)["lon"].alias("lon"), at(0.0)["lat"].alias("lat"), tags.alias("tags"))
    road = F.create_map(F.lit("highway"), F.lit("residential"), F.lit("name"), F.concat(F.lit("Tie "), i.cast("string")))
    ways = spark.range(60).select("id", F.array(at(-0.015625), at(0.0), at(0.0)).alias("points"), road.alias("tags"))
    ways = ways.unionByName(spark.createDataFrame([(70, []), (71, None), (72, [(24.9, None)]), (73, [(24.9, 60.2)]), (74, [(0.0, 0.0), (24.95, 60.2)])], "id long, points array<struct<lon:double,lat:double>>").withColumn("tags", road))
    areas = spark.range(2).select("id", F.array(at(0.0), at(0.002)).alias("ring"), tags.alias("tags"))
    found = search.index_tables(nodes, ways, areas, (24.9, 60.0, 24.9505, 60.5))
    plans = {t: found[t]._jdf.queryExecution().optimizedPlan().toString() for t in ("door", "district", "poi", "road")}
    assert not any("Range" in plans[t] for t in ("door", "district", "poi")) and plans["road"].count("0.015625") <= 5
    assert found["door"].count() == 53 and found["poi"].count() == 27
    assert sorted(r.seq for r in found["road"].collect()) == [*range(51), 73, 74]


def test_no_places_merge_into_none(spark):
    assert search.merge_points(spark.createDataFrame([], POINTS)).collect() == []


def test_index_from_extract_to_search(spark, tmp_path):
    from velonet.sources import sinks

    t, n = "map<string,string>", "id long, lon double, lat double"
    nodes = spark.createDataFrame(
        [
            (1, 24.90, 60.20, {"addr:street": "Mäkitie", "addr:housenumber": "2"}), (2, 24.90001, 60.20, {"addr:street": "Mäkitie", "addr:housenumber": "2"}), (3, 24.901, 60.20, {"addr:street": "Mäkitie"}),
            (4, 24.92, 60.21, {"place": "suburb", "name": "Laakso"}), (5, 24.9001, 60.2001, {"amenity": "school", "name": "Koulu"}), (6, 24.93, 60.22, {"amenity": "school", "name": "Laakso"}),
            *((10 + i, 24.95 + i * 1e-3, 60.23, {"shop": "bakery", "name": "Leipomo"}) for i in range(8)), (30, 0.0, 0.0, {"addr:street": "Kaukana"}),
        ], f"{n}, tags {t}",
    )
    ways = spark.createDataFrame([(1, [(24.97, 60.2), (24.98, 60.2)], {"highway": "residential", "name": "Väylä"}), (2, [], {"highway": "residential", "name": "Tyhjä"})], f"id long, points array<struct<lon:double,lat:double>>, tags {t}")
    areas = spark.createDataFrame([(1, [(24.90008, 60.2001), (24.90012, 60.2001)], {"amenity": "school", "name": "Koulu", "wikidata": "Q1"}), (2, [], {"amenity": "school", "name": "Olematon"})], f"id long, ring array<struct<lon:double,lat:double>>, tags {t}")
    search.write_index(search.build_index(nodes, ways, areas, (24.0, 60.0, 25.5, 60.5)), str(tmp_path / "index"))
    index, manifest = sinks.read(spark, str(tmp_path / "index"), "search")
    assert [(r.street_id, r.street, r.doors) for r in index["street"].orderBy("street_id").collect()] == [(0, "Mäkitie", 2), (1, "Väylä", 0)]
    assert sorted((r.street_id, r.number, r.lon) for r in index["door"].collect()) == [(0, "", 24.901), (0, "2", 24.90)]
    # the school by a district's name goes, its namesake on a node and an area are one, and five bakeries of eight stay
    places = [(r.place, r.name, r.kind, r.notability, r.street) for r in index["place"].orderBy("place").collect()]
    assert places == [(0, "Laakso", "suburb", 2, None), (1, "Koulu", "school", 1, "Mäkitie"), *((2 + i, "Leipomo", "shop", 0, None) for i in range(5))]
    assert manifest["kinds"] == {"suburb": 1, "school": 1, "shop": 5} and manifest["districts"] == 1 and manifest["addressed_streets"] == 1
    hits = search.search(spark.createDataFrame([(1, "mäki"), (2, "kou"), (3, "VAY")], "query long, text string"), index["place"], index["street"], index["door"])
    assert sorted((r.query, r["rank"], r.label) for r in hits.collect()) == [(1, 1, "Mäkitie"), (2, 1, "Koulu"), (3, 1, "Väylä")]


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "x double, y double")
    r = evaluate.spearman(df, "x", "y").first()
    x, y = [1.5, 1.5, 3, 4], [2, 1, 3.5, 3.5]
    mx, my = sum(x) / 4, sum(y) / 4
    want = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    assert r.n == 4 and r.rho == pytest.approx(want)


def test_winter_claims(spark):
    v = spark.createDataFrame([(7, 24.94, 60.17, 0.0), (7, 24.94, 60.1701, 0.0), (8, 24.94, 60.17, 90.0)], "edge long, to_lon double, to_lat double, bearing double")
    s = spark.createDataFrame([(1, 24.94001, 60.17, 5.0, 1), (2, 24.94001, 60.1701, 175.0, 2), (3, 24.95, 60.17, 0.0, 2)], "sample long, lon double, lat double, heading double, tier int")
    lengths = spark.createDataFrame([(7, 22.0), (8, 10.0)], "edge long, length double")
    assert [(r.edge, r.tier, r.metres) for r in winter.winter_claims(s, v, lengths).collect()] == [(7, 2, 20.0)]


def test_register_union_keeps_the_first(spark):
    s = "lon double, lat double, city string, name string, seq long"
    a = spark.createDataFrame([(24.94, 60.17, "a", None, 1)], s)
    b = spark.createDataFrame([(24.940001, 60.17, "b", "x", 2), (25.0, 60.17, "b", None, 3)], s)
    assert sorted((r.city, r.seq) for r in signals.register_union([a, b]).collect()) == [("a", 1), ("b", 3)]


def test_claims_equal_taking_turns_one_by_one(spark):
    """Many points that all hang together: no group of them is gathered, and the outcome is that of one pass in order."""
    rng = random.Random(3)
    reg = [(p, f"c{rng.randrange(3)}", rng.random(), rng.random()) for p in range(120)]
    cand = [(p, kind, n, round(rng.uniform(1, 90), 3), n % 17 == 0, n % 5 > 0, rng.random() < 0.9, rng.random() < 0.9) for p in range(120) for kind in ("cycleway", "road") for n in rng.sample(range(p // 2, p // 2 + 25), 8)]
    lit, want = {k: {n for _, kind, n, _, on, *_ in cand if on and kind == k} for k in ("cycleway", "road")}, set()
    for p, *_ in sorted(reg, key=lambda x: (x[1], x[2], x[3], x[0])):
        for kind in ("cycleway", "road"):
            ok = sorted((m, n, ground) for q, k, n, m, _, ground, walk, cross in cand if q == p and k == kind and walk and cross)
            known = [n for m, n, _ in ok if n in lit[kind] and m <= 40]
            grounded = [n for m, n, ground in ok if ground and m <= 80]
            if known:
                want.add((p, kind, known[0], "known"))
            elif grounded:
                lit[kind].add(grounded[0])
                want.add((p, kind, grounded[0], "claimed"))
    table = spark.createDataFrame(cand, "point long, kind string, node long, metres double, lit boolean, grounded boolean, walkable boolean, crossing boolean")
    got = signals.claim(spark.createDataFrame(reg, "point long, city string, lon double, lat double"), table)
    assert {tuple(r) for r in got.collect()} == want and {o for *_, o in want} == {"known", "claimed"}
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()


def test_claims_follow_chains_of_points(spark):
    """1 and 3 meet only through 2's candidates; 4 is on its own and does not wait for them."""
    reg = spark.createDataFrame([(1, "b", 24.0, 60.0), (2, "a", 24.1, 60.0), (3, "a", 24.0, 60.0), (4, "c", 24.0, 60.0)], "point long, city string, lon double, lat double")
    c = "point long, kind string, node long, metres double, lit boolean, grounded boolean, walkable boolean, crossing boolean"
    at = lambda p, n, m: (p, "cycleway", n, m, False, True, True, True)
    cand = spark.createDataFrame([at(1, 10, 5.0), at(2, 10, 20.0), at(2, 11, 10.0), at(3, 11, 30.0), at(3, 12, 35.0), at(4, 20, 70.0)], c)
    groups = {r.point: r.group for r in signals.point_groups(cand).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4}
    # in order 3, 2, 1: 3 claims 11, 2 knows it, 1 claims 10
    got = {r.point: (r.node, r.outcome) for r in signals.claim(reg, cand).collect()}
    assert got == {3: (11, "claimed"), 2: (11, "known"), 1: (10, "claimed"), 4: (20, "claimed")}


def test_register_union_is_in_order(spark):
    rows = spark.createDataFrame([(25.0, 60.2, "b", None, 1), (24.0, 60.3, "b", None, 2), (24.5, 60.1, "a", None, 3), (24.0, 60.2, "b", None, 4)], "lon double, lat double, city string, name string, seq long")
    assert [r.seq for r in signals.register_union([rows]).collect()] == [3, 4, 2, 1]


def test_grids_on_the_meridian_and_back(spark):
    from velonet.functions import geo

    df = spark.createDataFrame([(27.0, 60.0), (25.0, 60.0), (24.3, 61.7), (30.9, 69.9)], "lon double, lat double")
    for crs, (meridian, scale, false) in geo.GRIDS.items():
        e, n = geo.to_grid("lon", "lat", crs)
        there = df.withColumns({"e": e, "n": n})
        lon, lat = geo.from_grid("e", "n", crs)
        for r in there.withColumns({"x": lon, "y": lat}).collect():
            assert r.x == pytest.approx(r.lon, abs=1e-9) and r.y == pytest.approx(r.lat, abs=1e-9)
            if r.lon == meridian:  # 6654072.819 m of meridian from the equator to 60 degrees on this ellipsoid
                assert r.e == pytest.approx(false, abs=1e-3) and (r.lat != 60 or r.n == pytest.approx(6_654_072.819 * scale, abs=2e-3))


def test_ranks_without_a_group_span_ranges(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 500).cast("double").alias("x"))
    got = {r.x: r.k for r in evaluate.mean_ranks(df, "x", "k").distinct().collect()}
    assert got == {float(v): 4 * v + 2.5 for v in range(500)}


def test_substrings_through_grams(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abå ", k=rng.randrange(1, 9))) for _ in range(300)] + [""]
    asked = [(i, "".join(rng.choices("abå", k=rng.randrange(1, 6)))) for i in range(60)] + [(60, ""), (61, "zzz"), (62, "z")]
    got = {tuple(r) for r in search.containing(spark.createDataFrame(asked, "query long, part string"), spark.createDataFrame([(n,) for n in names], "f string")).collect()}
    assert got == {(i, n) for i, part in asked if part for n in names if part in n}


def test_neither_search_nor_rasters_compare_all_with_all(spark):
    i = spark.createDataFrame([(1, "Puisto", "park", 0, 24.9, 60.1, "")], "place long, name string, kind string, rank int, lon double, lat double, street string")
    s = spark.createDataFrame([("Puistotie", 24.9, 60.1, 0)], "street string, lon double, lat double, doors int")
    d = spark.createDataFrame([("Puistotie", "1", 24.9, 60.1)], "street string, number string, lon double, lat double")
    hits = search.search(spark.createDataFrame([(1, "puis")], "query long, text string"), i, s, d)
    tiles = spark.createDataFrame([(0, 0, 24.0, 61.0, 0.5, 2, 2), (1, 1, 24.9, 60.2, 0.1, 3, 3)], "tile int, rank int, west double, north double, size double, rows int, cols int")
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 1, None), (1, 0, 1, 7.0)], "tile int, row int, col int, height double")
    at = lines.sample_heights(spark.createDataFrame([(1, 24.1, 60.9), (2, 25.05, 60.15), (3, 24.95, 60.1), (4, 30.0, 50.0)], "id int, lon double, lat double"), tiles, cells)
    for df in (hits, at):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.id: r.height for r in at.collect()} == {1: 1.0, 2: 7.0, 3: None, 4: None}
    assert [r.label for r in hits.orderBy("rank").collect()] == ["Puistotie 1", "Puisto"]


@pytest.mark.parametrize("few", [0, 20_000])
def test_nearest_far_north_and_far_away(spark, monkeypatch, few):
    """Reaches around a pole list no more cells than there are, and the rows that list them are never broadcast."""
    monkeypatch.setattr(spatial, "FEW", few)
    lat, lon_n = F.lit(89.99999 - 18.5), spatial.reach_cells(F.lit(89.99999 - 18.5), 2_048_000.0, 18.5)[0]
    assert spark.range(1).select(lon_n).first()[0] <= 20 and spark.range(1).select(spatial.reach_cells(lat + 60, 2_048_000.0, 18.5)[0]).first()[0] > 0
    left = spark.createDataFrame([(1, 24.9, 75.1), (2, 24.9, 71.4999), (3, 24.9, 60.2)], "id long, lon double, lat double")
    right = spark.createDataFrame([(7, 24.9, 60.15), (8, 24.91, 60.25)], "node long, to_lon double, to_lat double")
    assert {r.id: r.node for r in spatial.nearest(left, right, "id", ["node"]).collect()} == {1: 8, 2: 8, 3: 7}
    plan = spatial.grid_join(left, right, 500.0, 0.01)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
