import math

import pytest
from pyspark.sql import functions as F

from velonet.operators import network

NODES = {1: (24.940, 60.170), 2: (24.942, 60.170), 3: (24.944, 60.170), 4: (24.944, 60.172), 5: (24.946, 60.170), 6: (24.942, 60.172), 7: (24.942, 60.174), 8: (24.938, 60.170), 90: (24.990, 60.200), 91: (24.992, 60.200)}
BASE = [(1, 2), (2, 3), (3, 4), (3, 5)]


def metres(a, b):
    (x1, y1), (x2, y2) = NODES[a], NODES[b]
    return math.hypot((x2 - x1) * math.cos(math.radians((y1 + y2) / 2)) * 111320, (y2 - y1) * 110540)


def heading(a, b):
    (x1, y1), (x2, y2) = NODES[a], NODES[b]
    return math.degrees(math.atan2((x2 - x1) * math.cos(math.radians((y1 + y2) / 2)), y2 - y1)) % 360


RAW = "a long, b long, seq long, length double, surface int, grade int, traffic int, lit boolean, name string, forward boolean, backward boolean, class int"


def raw(spark, pairs, **more):
    d = dict(surface=0, grade=0, traffic=1, lit=False, name="", forward=True, backward=True)
    d["class"] = 0
    rows = []
    for i, p in enumerate(pairs):
        x = d | more | (p[2] if len(p) > 2 else {})
        rows.append((p[0], p[1], i, x.get("length", metres(p[0], p[1])), *(x[k] for k in ("surface", "grade", "traffic", "lit", "name", "forward", "backward", "class"))))
    return spark.createDataFrame(rows, RAW)


def segments(spark, pairs, **more):
    s = network.dedupe_segments(raw(spark, pairs, **more))
    h = {(min(p[:2]), max(p[:2])): heading(min(p[:2]), max(p[:2])) for p in pairs}
    ends = spark.createDataFrame([(a, b, x, x) for (a, b), x in h.items()], "a long, b long, bearing_a double, bearing_b double")
    return s.join(ends, ["a", "b"])


def node_table(spark, kinds={}, barriers={}):
    return spark.createDataFrame([(n, kinds.get(n, 0), barriers.get(n, 0)) for n in NODES], "node long, kind int, barrier int")


def contracted(spark, pairs, kinds={}, barriers={}, **more):
    return {(r.a, r.b): r for r in network.contract(segments(spark, pairs, **more), node_table(spark, kinds, barriers)).collect()}


def test_dedupe_rules(spark):
    rows = [(2, 1, {"surface": 2, "grade": 1, "name": "", "forward": True, "backward": False, "class": 2}), (1, 2, {"surface": 1, "grade": 2, "name": "A", "forward": False, "backward": False, "class": 5}), (1, 2, {"name": "B", "lit": True, "forward": False, "backward": False})]
    got = network.dedupe_segments(raw(spark, rows)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.a, r.b, r.surface, r.grade, r.lit, r.name, r.forward, r.backward, r["class"], r.ways) == (1, 2, 1, 2, True, "A", False, True, 5, 3)


def test_self_segments_go(spark):
    assert network.dedupe_segments(raw(spark, [(1, 1, {"length": 0.0})])).count() == 0


def test_base_contracts_to_four_junctions(spark):
    e = contracted(spark, BASE)
    assert set(e) == {(1, 3), (3, 4), (3, 5)}
    assert e[1, 3].segments == 2 and 200 < max(x.length for x in e.values()) < 230


def test_interior_delays_are_counted(spark):
    e = contracted(spark, BASE, kinds={2: 2, 3: 1}, barriers={2: 2})
    assert (e[1, 3].signals, e[1, 3].crossings, e[1, 3].barriers) == (1, 0, 2)
    assert contracted(spark, BASE, kinds={2: 3})[1, 3].signals == 2


def test_one_way_chain(spark):
    chain = segments(spark, [(1, 2, {"backward": False}), (2, 3, {"backward": False}), (3, 4), (3, 5), (3, 6), (6, 1), (1, 8)])
    e = network.contract(chain, node_table(spark)).collect()
    assert [r.access for r in e if r.access != 3] == [1] and len(e) == 5
    assert contracted(spark, [(2, 1, {"backward": False}), (2, 3), (3, 4), (3, 5)])[1, 3].access == 2


def test_opposing_one_ways_close_a_chain(spark):
    assert (1, 3) not in contracted(spark, [(1, 2, {"backward": False}), (3, 2, {"backward": False}), (3, 4), (3, 5)])


def test_ring_without_junction_goes(spark):
    assert contracted(spark, [(1, 2), (2, 6), (6, 1)]) == {}


def test_loop_at_a_junction_is_kept_once(spark):
    e = contracted(spark, [(3, 4), (4, 6), (6, 3), (3, 5), (3, 2)])
    assert e[3, 3].segments == 3 and len(e) == 3


def test_majorities(spark):
    e = contracted(spark, [(1, 2, {"name": "Short", "traffic": 4, "length": 10.0}), (2, 3, {"name": "", "traffic": 1, "length": 90.0, "class": 4}), (3, 4), (3, 5)])
    assert (e[1, 3].name, e[1, 3].traffic, e[1, 3]["class"]) == ("Short", 1, 4)


def arcs(spark, pairs):
    return spark.createDataFrame(pairs, "tail long, head long")


def test_largest_component_and_fallback(spark):
    a = arcs(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 5)])
    want = {1, 2, 3}
    assert {r.node for r in network.largest_scc(a).collect()} == want
    assert {r.node for r in network.reachable(a, 1).collect()} == {1, 2, 3, 4}
    old = network.MAX_ARCS
    try:
        network.MAX_ARCS = 0
        b = arcs(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
        assert {r.node for r in network.largest_scc(b).collect()} == want
    finally:
        network.MAX_ARCS = old


def test_largest_component_of_nothing(spark):
    assert network.largest_scc(arcs(spark, [])).count() == 0


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(100).select((F.col("id") * 7919 % 101).alias("k"))
    got = network.number_rows(df, ["k"], "n", 8).orderBy("k").collect()
    assert [r.n for r in got] == list(range(100))


def test_restrict(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    keep = spark.createDataFrame([(1,), (2,)], "node long")
    assert [(r.a, r.b) for r in network.restrict(e, keep).collect()] == [(1, 2)]


def test_degree(spark):
    got = {r.node: r.degree for r in network.degrees(segments(spark, BASE)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1}
    assert pytest.approx(metres(1, 2), rel=1e-9) == 0.002 * math.cos(math.radians(60.17)) * 111320


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_by_joins_equal_the_array_task(spark, seed):
    import random

    rng = random.Random(seed)
    a = arcs(spark, [(rng.randrange(30), rng.randrange(30)) for _ in range((25, 40, 60)[seed - 1])]).cache()
    want = {r.node for r in network.largest_scc(a).collect()}
    assert {r.node for r in network.scc_by_joins(a).collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_by_blocks_equal_the_array_task(spark, monkeypatch, seed):
    import random

    from velonet.operators import blocks

    rng = random.Random(seed)
    near = [(i, i + rng.choice((-3, -1, 1, 2))) for i in range(60) for _ in range(2)]
    a = arcs(spark, [(t, h) for t, h in near if 0 <= h < 60]).cache()
    want = {r.node for r in network.largest_scc(a).collect()}
    monkeypatch.setattr(network, "TASK_ARCS", 3)
    monkeypatch.setattr(network, "_scc_task", None)
    monkeypatch.setattr(blocks, "BLOCK", 8)
    assert {r.node for r in network.largest_scc(a).collect()} == want


def test_components_by_joins_of_trees_and_nothing(spark):
    assert [r.node for r in network.scc_by_joins(arcs(spark, [(3, 2), (2, 5)])).collect()] == [2]
    assert network.scc_by_joins(arcs(spark, [])).count() == 0
    assert {r.node for r in network.scc_by_joins(arcs(spark, [(7, 8), (8, 7), (1, 2), (2, 1), (2, 7)])).collect()} == {1, 2}


def test_build_numbers_and_cuts(spark):
    e, n = network.build_network(segments(spark, BASE), spark.createDataFrame([(i, 0, 0) for i in range(1, 6)], "node long, kind int, barrier int"))
    rows = e.collect()
    assert len({r.edge_id for r in rows}) == len(rows) and {r.node for r in n.collect()} >= {x for r in rows for x in (r.a, r.b)}


def test_many_equal_components_and_long_rings(spark):
    """Every component by colouring against plain reachability: many equal ones, a long ring, one-way links, nodes alone."""
    pairs = [(10 * i + j, 10 * i + (j + 1) % 3) for i in range(12) for j in range(3)] + [(10 * i, 10 * i + 10) for i in range(11)]
    pairs += [(1000 + i, 1000 + (i + 1) % 60) for i in range(60)] + [(5, 5), (2000, 1000), (1030, 2001), (111, 1003)]
    got = {r.node: r.component for r in network.strong_components(arcs(spark, pairs)).collect()}
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for m in ahead.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    all_ = {n: reach(n) for n in {x for p in pairs for x in p}}
    assert got == {n: min(m for m in s if n in all_[m]) for n, s in all_.items()}
    assert {r.node for r in network.scc_by_joins(arcs(spark, pairs)).collect()} == set(range(1000, 1060))


def test_sums_run_along_the_chain(spark):
    """Half a millimetre at the last digit isn't left to the order in which rows arrive."""
    import random

    ends = list(range(61))
    lengths = [round(0.0005 * (97 * i % 1999) + 40, 4) for i in range(60)]
    rows = [(a, a + 1, 1, 0, 1, True, "", True, True, 0, 90.0, 90.0, x) for a, x in zip(ends, lengths)]
    want = 0.0
    for x in lengths:
        want += x
    nodes = spark.createDataFrame([(i, 0, 0) for i in ends], "node long, kind int, barrier int")
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        shuffled = spark.createDataFrame(rows, "a long, b long, surface int, grade int, traffic int, lit boolean, name string, forward boolean, backward boolean, class int, bearing_a double, bearing_b double, length double")
        (edge,) = network.contract(shuffled, nodes).collect()
        assert (edge.length, edge.unpaved, edge.lit) == (want, want, want)
