import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import cost as K
from velonet.operators import network, routing

EDGE = "edge_id long, a long, b long, length double, unpaved double, shared double, lit double, grade int, traffic int, class int, name string, access int, signals int, crossings int, barriers int, bearing_a double, bearing_b double"


def build(spark, points, specs):
    """points: id -> (x, y) in 0.0002 degrees of longitude; specs: (a, b, options)."""
    at = {n: (24.94 + x * 0.0002, 60.17 + y * 0.0001) for n, (x, y) in points.items()}
    rows = []
    for i, (a, b, o) in enumerate(specs):
        (x1, y1), (x2, y2) = at[a], at[b]
        mean = math.cos(math.radians((y1 + y2) / 2))
        n = math.hypot((x2 - x1) * mean * 111320, (y2 - y1) * 110540)
        h = math.degrees(math.atan2((x2 - x1) * mean, y2 - y1)) % 360
        rows.append((i, a, b, n, n * o.get("slow", 0.0), 0.0, n * o.get("lit", 0.0), o.get("grade", 0), o.get("traffic", 0), o.get("bits", 0), o.get("name", ""), o.get("access", 3), o.get("signals", 0), 0, o.get("barriers", 0), h, h))
    nodes = spark.createDataFrame([(n, x, y, specs_kind(n, points), 0) for n, (x, y) in at.items()], "node long, lon double, lat double, kind int, barrier int")
    return spark.createDataFrame(rows, EDGE), nodes


KIND = {}


def specs_kind(n, _):
    return KIND.get(n, 0)


def run(spark, g, pairs, taste=K.Taste(), model=K.CostModel(), limit=1):
    edges, nodes = g
    states = routing.priced(edges, nodes, model, taste)
    graph, metres = routing.load(states, nodes, model, taste)
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair long, start long, goal long")
    paths = routing.routes(graph, metres, p, limit)
    rolled = {(r.pair, r["rank"]): r for r in routing.roll_up(paths, states, model, nodes).collect()}
    return rolled, paths, states


GRID = {i: (4 * (i % 4), 9 * (i // 4)) for i in range(16)}


def random_grid(seed):
    rng = random.Random(seed)
    specs = []
    for i in range(16):
        for j in ([i + 1] if i % 4 < 3 else []) + ([i + 4] if i < 12 else []):
            specs.append((i, j, {"slow": rng.choice([0, 0.5, 1]), "grade": rng.randrange(4), "traffic": rng.randrange(5), "signals": rng.choice([0, 0, 1]), "access": rng.choice([3, 3, 3, 1]), "bits": rng.choice([0, 1, 2, 4])}))
    return specs


def brute(edges, nodes, start, goal, model, taste):
    """Least search cost over all states by plain relaxation, and the true cost of a best path."""
    import numpy as np

    es = edges
    best = {}
    frontier = []
    node_s = lambda n: {0: 0, 1: model.crossing, 2: model.signal, 3: 2 * model.signal}[n["kind"]]
    degree = {}
    for e in es:
        degree[e["a"]] = degree.get(e["a"], 0) + 1
        degree[e["b"]] = degree.get(e["b"], 0) + 1
    states = [s for s in STATES]
    for s in states:
        if s["tail"] == start:
            best[s["state"]] = s["search_s"]
            frontier.append(s)
    by_tail = {}
    for s in states:
        by_tail.setdefault(s["tail"], []).append(s)
    while frontier:
        s = frontier.pop()
        for t in by_tail.get(s["head"], []):
            swing = round(t["leaves"] - s["arrives"] + 540, 9) % 360 - 180
            turn = model.turn * (model.left if swing < 0 else 1) if degree[s["head"]] >= 3 and abs(swing) >= 40 else 0
            c = best[s["state"]] + t["node_search"] + t["search_s"] + turn * taste["turn"]
            if c < best.get(t["state"], np.inf) - 1e-12:
                best[t["state"]] = c
                frontier.append(t)
    ends = [best[s["state"]] for s in states if s["head"] == goal and s["state"] in best]
    return min(ends) if ends else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_equals_exhaustive_relaxation(spark, seed):
    global STATES
    KIND.clear()
    KIND.update({5: 2, 6: 1, 9: 3})
    g = build(spark, GRID, random_grid(seed))
    for taste in (K.Taste(), K.Taste({"turn": 3, "unpaved": 4, "traffic": 3, "lit": 0.8, "network": 0.6, "sidepath": 1})):
        model = K.CostModel()
        states = routing.priced(*g, model, taste)
        STATES = [r.asDict() for r in states.collect()]
        graph, _ = routing.load(states, g[1], model, taste)
        edges = [r.asDict() for r in g[0].collect()]
        for a, b in itertools.product((0, 3, 10), (15, 12, 5)):
            if a == b:
                continue
            cost, came, last = graph.search(graph.place(a), graph.place(b))
            want = brute(edges, None, a, b, model, taste)
            assert (last < 0) == (want is None)
            if want is not None:
                assert cost[last] == pytest.approx(want)
    KIND.clear()


BYPASS = {0: (0, 0), 1: (4, 2), 2: (8, 0), 3: (2, -3), 4: (6, -3), 6: (2, -6), 7: (6, -6)}
SPECS = [(0, 1, {"name": "Road"}), (1, 2, {"name": "Road"}), (0, 3, {"name": "By"}), (3, 4, {"name": "By"}), (4, 2, {"name": "By"}), (3, 6, {}), (4, 7, {})]


def test_equal_ends_and_unreachable(spark):
    g = build(spark, BYPASS | {9: (50, 50), 10: (51, 50)}, [*SPECS, (9, 10, {})])
    rolled, _, _ = run(spark, g, [(0, 0), (0, 9), (0, 2)])
    assert rolled[0, 1].metres == 0 and rolled[0, 1].edges == 0
    assert (1, 1) not in rolled and rolled[2, 1].metres > 0


def test_taste_never_reaches_the_price(spark):
    g = build(spark, {0: (0, 0), 1: (10, 0)}, [(0, 1, {"slow": 1.0, "grade": 2, "traffic": 4, "signals": 2, "barriers": 1, "bits": 2})])
    plain, _, _ = run(spark, g, [(0, 1)])
    steered, _, _ = run(spark, g, [(0, 1)], K.Taste({k: 5 for k in C.TASTES}))
    assert plain[0, 1].seconds == pytest.approx(steered[0, 1].seconds)
    slower, _, _ = run(spark, g, [(0, 1)], model=K.CostModel(signal=60))
    assert slower[0, 1].seconds == pytest.approx(plain[0, 1].seconds + 60)


def test_unpaved_taste_steers(spark):
    g = build(spark, BYPASS, [(0, 1, {"slow": 1.0, "grade": 1}), (1, 2, {"slow": 1.0, "grade": 1}), *SPECS[2:]])
    plain, _, _ = run(spark, g, [(0, 2)])
    avoid, _, _ = run(spark, g, [(0, 2)], K.Taste({"unpaved": 4}))
    assert plain[0, 1].unpaved > 0 and avoid[0, 1].unpaved == 0 and avoid[0, 1].seconds >= plain[0, 1].seconds


def test_same_both_ways_and_left_costs_more(spark):
    cross = {0: (0, 0), 1: (0, 8), 2: (4, 0), 3: (-4, 0), 4: (0, -8)}
    g = build(spark, cross, [(0, i, {}) for i in range(1, 5)])
    rolled, _, _ = run(spark, g, [(4, 2), (4, 3), (4, 1), (1, 4)])
    assert rolled[1, 1].seconds - rolled[0, 1].seconds == pytest.approx(5)
    assert (rolled[0, 1].turns, rolled[1, 1].lefts, rolled[2, 1].turns) == (1, 1, 0)
    assert rolled[2, 1].seconds == pytest.approx(rolled[3, 1].seconds)


def test_alternatives_keep_their_limits(spark):
    g = build(spark, GRID, [(i, j, {}) for i in range(16) for j in ([i + 1] if i % 4 < 3 else []) + ([i + 4] if i < 12 else [])])
    rolled, paths, states = run(spark, g, [(0, 15)], limit=3)
    assert len(rolled) >= 2
    quick = min(r.seconds for r in rolled.values())
    assert all(r.seconds <= 1.3 * quick + 1e-9 for r in rolled.values())
    by = {}
    for r in paths.join(states.select("state", "length"), "state").collect():
        by.setdefault(r["rank"], {})[r.state // 2] = r.length
    for a, b in itertools.combinations(by, 2):
        assert sum(m for e, m in by[b].items() if e in by[a]) / sum(by[b].values()) <= 0.70 + 1e-9


def test_steps_add_up_and_end_with_arrival(spark):
    g = build(spark, GRID, [(i, j, {"name": f"S{j - i}"}) for i in range(16) for j in ([i + 1] if i % 4 < 3 else []) + ([i + 4] if i < 12 else [])])
    rolled, paths, states = run(spark, g, [(0, 15)])
    steps = sorted(routing.steps(paths, states).collect(), key=lambda r: r.step)
    assert steps[0].manoeuvre == "start" and steps[-1].manoeuvre == "arrive"
    assert sum(s.metres for s in steps) == pytest.approx(rolled[0, 1].metres)


def test_relaxation_by_joins_agrees_with_the_search(spark):
    g = build(spark, GRID, random_grid(5))
    model, taste = K.CostModel(), K.Taste()
    states = routing.priced(*g, model, taste)
    graph, _ = routing.load(states, g[1], model, taste, turns=False)
    src = spark.createDataFrame([(0,)], "source long")
    want = {r.node: r.seconds for r in routing.least_costs(graph, src).collect()}
    arcs = states.select("tail", "head", (F.col("true_s") + F.when(F.col("tail") == 0, 0.0).otherwise(F.col("node_true"))).alias("seconds"))
    got = {r.node: r.seconds for r in routing.relax(arcs, src).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_too_large_a_graph_is_refused(spark, monkeypatch):
    g = build(spark, BYPASS, SPECS)
    monkeypatch.setattr(routing, "MAX_ARCS", 3)
    with pytest.raises(ValueError):
        routing.load(routing.priced(*g, K.CostModel(), K.Taste()), g[1], K.CostModel(), K.Taste())


def test_turn_table_counts_turning_back_as_left(spark):
    edges, _ = build(spark, {0: (0, 0), 1: (4, 0), 2: (8, 0)}, [(0, 1, {}), (1, 2, {})])
    t = network.turn_table(network.directed_states(edges), network.degrees(edges)).collect()
    assert all(r.swing == -180 for r in t if r.from_state // 2 == r.to_state // 2)


def test_height_profile_runs_along_the_route(spark):
    edges, nodes = g = build(spark, {0: (0, 0), 1: (10, 0), 2: (20, 0)}, [(0, 1, {}), (2, 1, {})])
    rolled, paths, states = run(spark, g, [(0, 2)])
    node_h = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, None)], "node long, height double")
    shape = spark.createDataFrame([(0, 0, 1.5), (1, 0, 9.0), (1, 1, 8.0)], "edge_id long, pos int, height double")
    got = [(round(r.dist, 3), r.height) for r in routing.height_profile(paths, states, node_h, shape).orderBy("dist").collect()]
    m = rolled[0, 1].metres / 2
    assert got == [(0.0, 1.0), (round(m / 2, 3), 1.5), (round(m, 3), 2.0), (round(m + m / 3, 3), 8.0), (round(m + 2 * m / 3, 3), 9.0)]


@pytest.mark.parametrize("seed", range(4))
def test_the_floor_never_overestimates(spark, seed):
    """Models and tastes below 1, lit ones too: the bounded search equals the one without a bound."""
    rng = random.Random(seed)
    specs = [(i, j, o | {"lit": rng.choice([0, 1])}) for i, j, o in random_grid(seed + 20)]
    g = build(spark, GRID, specs)
    model = K.CostModel(slow=rng.choice([0.3, 0.65, 1.0]))
    taste = K.Taste({k: rng.choice([0.2, 0.5, 0.9, 1.0, 3.0]) for k in C.TASTES})
    graph, _ = routing.load(routing.priced(*g, model, taste), g[1], model, taste)
    loose, _ = routing.load(routing.priced(*g, model, taste), g[1], model, taste)
    loose.floor = 0.0
    for a, b in itertools.permutations(range(16), 2):
        cost, _, last = graph.search(a, b)
        want, _, end = loose.search(a, b)
        assert (last < 0) == (end < 0) and (last < 0 or cost[last] == pytest.approx(want[end]))


def test_the_floor_knows_the_riders_own_factor():
    assert K.heuristic_floor(K.Taste({"shared": 0.9, "network": 1, "sidepath": 1}), K.CostModel(slow=1.0)) == pytest.approx(0.9)
    assert K.heuristic_floor(K.Taste({"unpaved": 0.4, "lit": 0.8, "network": 1, "sidepath": 1})) == pytest.approx(0.4 / 0.8 - 0.2)


def test_costs_by_joins_equal_the_search(spark, monkeypatch):
    g = build(spark, GRID, random_grid(8))
    model, taste = K.CostModel(), K.Taste({"turn": 2, "traffic": 3})
    states = routing.priced(*g, model, taste)
    src = spark.createDataFrame([(0,), (99,)], "source long")
    for true in (True, False):
        monkeypatch.setattr(routing, "MAX_ARCS", 10**6)
        want = {r.node: r.seconds for r in routing.costs(states, g[1], src, model, taste, true=true).collect()}
        monkeypatch.setattr(routing, "MAX_ARCS", 3)
        got = {r.node: r.seconds for r in routing.costs(states, g[1], src, model, taste, true=true).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


@pytest.mark.parametrize("turns", [True, False])
def test_costs_by_blocks_equal_the_search(spark, monkeypatch, turns):
    """Small blocks, so that the best ways cross them often; the graph isn't collected, nor sent to any task whole."""
    g = build(spark, GRID, random_grid(8))
    model, taste = K.CostModel(), K.Taste({"turn": 2, "traffic": 3})
    states = routing.priced(*g, model, taste)
    src = spark.createDataFrame([(0,), (15,), (99,)], "source long")
    for true in (True, False):
        want = {(r.source, r.node): r.seconds for r in routing.least_costs(routing.load(states, g[1], model, taste, turns)[0], src, true).collect()}
        with monkeypatch.context() as m:
            m.setattr(routing, "TASK_ARCS", 3)
            m.setattr(routing.blocks, "BLOCK", 3)
            m.setattr(routing, "load", None)
            got = {(r.source, r.node): r.seconds for r in routing.costs(states, g[1], src, model, taste, turns, true).collect()}
        assert len(want) > 20 and got == want


def test_side_tables_default_to_flat_and_bare(spark):
    edges, nodes = build(spark, {0: (0, 0), 1: (10, 0), 2: (20, 0)}, [(0, 1, {}), (1, 2, {})])
    climb = spark.createDataFrame([(0, 5.0, 1.0)], "edge_id long, ascent double, descent double")
    winter = spark.createDataFrame([(1, 2)], "edge_id long, tier int")
    both = {r.edge_id: (r.ascent, r.descent, r.tier) for r in routing.with_sides(edges, climb, winter).collect()}
    assert both == {0: (5.0, 1.0, 0), 1: (0.0, 0.0, 2)}
    states = {r.state: r.true_s for r in routing.priced(routing.with_sides(edges, climb, winter), nodes, K.CostModel(), K.Taste()).collect()}
    assert states[0] - states[1] == pytest.approx((5 * 2 - 1 * 0.4) - max(0, 1 * 2 - 5 * 0.4)) and states[2] == pytest.approx(states[3])


@pytest.mark.parametrize(("seed", "limit"), [(3, 1), (8, 3)])
def test_routes_by_joins_equal_the_search(spark, monkeypatch, seed, limit):
    """With lengths that never tie, the same edges in the same order: first routes, alternatives, equal ends, and ends off the graph."""
    KIND.clear()
    KIND.update({5: 2, 6: 1, 9: 3})
    g = build(spark, GRID, random_grid(seed))
    g = (g[0].withColumn("length", F.col("length") + F.col("edge_id") * 0.0137), g[1])
    model, taste = K.CostModel(), K.Taste({"turn": 2, "traffic": 2, "unpaved": 1.5})
    states = routing.cut_lineage(routing.priced(*g, model, taste), "priced")
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(0, 15), (3, 12), (12, 3), (0, 15), (7, 7), (1, 99), (10, 0)])], "pair long, start long, goal long")
    rows = lambda: {tuple(r) for r in routing.routed(states, g[1], pairs, model, taste, limit).select("pair", "rank", "pos", "state", F.round("swing", 6)).collect()}
    want = rows()
    monkeypatch.setattr(routing, "MAX_ARCS", 3)
    assert rows() == want and {r[0] for r in want} >= {0, 1, 2, 3, 4} and 5 not in {r[0] for r in want}
    assert limit == 1 or max(r[1] for r in want) > 1
    KIND.clear()


def test_sweep_totals_routes_of_each_taste(spark):
    from velonet.operators import evaluate

    KIND.clear()
    KIND.update({5: 2, 6: 1, 9: 3})
    edges, nodes = build(spark, GRID | {20: (200, 200), 21: (201, 200)}, [*random_grid(4), (20, 21, {})])
    edges = routing.with_sides(edges, edges.select("edge_id", F.lit(2.0).alias("ascent"), F.lit(1.0).alias("descent")))
    pairs = [(0, 15), (3, 12), (5, 5), (1, 20), (14, 2)]
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair long, start long, goal long")
    settings = {"plain": K.Taste(), "smooth": K.Taste({"unpaved": 6, "turn": 3})}
    rows = {r.setting: r for r in evaluate.sweep(edges, nodes, p, settings, K.CostModel(), "plain").collect()}
    assert set(rows) == set(settings)
    price = {}
    for name, taste in settings.items():
        rolled, _, _ = run(spark, (edges, nodes), pairs, taste)
        of = [r for r in rolled.values() if r.edges]
        r, metres = rows[name], sum(x.metres for x in of)
        price[name] = sum(x.seconds for x in of)
        assert (r.routed, r.failed) == (len(of), 5 - len(of)) and r.routed < 5
        assert r.km == pytest.approx(metres / 1000) and r.minutes == pytest.approx(price[name] / 60)
        assert r.unpaved == pytest.approx(100 * sum(x.unpaved for x in of) / metres) and r.turns == sum(x.turns for x in of)
        assert r.ascent == pytest.approx(sum(x.ascent for x in of)) and r.ascent > 0
    assert rows["plain"].detour == 0 and rows["smooth"].detour == pytest.approx(100 * (price["smooth"] / price["plain"] - 1))
    none = evaluate.sweep(edges, nodes, p.filter("pair = 2"), settings, K.CostModel(), "plain").collect()
    assert {(r.setting, r.routed, r.failed, r.detour, r.network) for r in none} == {(n, 0, 1, 0.0, 0.0) for n in settings}


def one_by_one(g, start, goal, metres, limit):
    """Alternatives by a search each that is guided by the crow's way only."""
    factor, more, kept, best = {}, {}, [], None
    for _ in range(limit + 2):
        _, came, last = g.search(start, goal, more)
        if last < 0:
            break
        path = g.path(came, last)
        edges, s = {int(g.state[x]) // 2 for x in path}, g.seconds(path)
        best = s if best is None else best
        length = sum(float(metres[x]) for x in path)
        overlap = max((sum(float(metres[x]) for x in path if int(g.state[x]) // 2 in k) / max(length, 1e-9) for k, _ in kept), default=0.0)
        if not kept or (s <= C.ALTERNATIVE_RATIO * best and overlap <= C.ALTERNATIVE_OVERLAP):
            kept.append((edges, path))
            if len(kept) == limit:
                break
        for e in edges:
            factor[e] = factor.get(e, 1.0) * C.ALTERNATIVE_PENALTY
            more.update((p, g.edge_search[p] * (factor[e] - 1)) for p in g._places[e])
    return [p for _, p in kept]


def test_searches_of_many_pairs_at_once(spark):
    """Backward searches of a batch lead each pair straight to its goal: the same routes and alternatives, few states on the way."""
    from velonet.plans.derived import Derived
    from velonet.plans.queries import MODEL, TASTE

    d = Derived(spark, "/root/testdata/sf0.001")
    g, metres = routing.load(routing.priced(d.edge, d.node, MODEL, TASTE), d.node, MODEL, TASTE)
    pairs = [(i, (i * 31 + 7) % len(g.node)) for i in range(len(g.node)) if i != (i * 31 + 7) % len(g.node)]
    for limit in (1, 3):
        assert g.alternatives(pairs, metres, limit) == [one_by_one(g, a, b, metres, limit) for a, b in pairs]
    left, reached = g.to_go(pairs)
    for k, (a, b) in enumerate(pairs):
        best, came, last = g.search(a, b, left=left[k].tolist())
        assert reached[k] == (last >= 0)
        if last >= 0:
            steps = len(g.path(came, last))
            assert len(best) <= 4 * steps + 4, (len(best), steps)


def test_routes_of_equal_ends_are_shared(spark):
    pairs = spark.createDataFrame([(5, 1, 2), (3, 1, 2), (9, 2, 1), (4, 1, 1)], "pair long, start long, goal long")
    leads, members = routing.shared_ends(pairs)
    assert sorted(map(tuple, leads.collect())) == [(3, 1, 2), (4, 1, 1), (9, 2, 1)]
    rows = spark.createDataFrame([(3, "x"), (3, "y"), (4, "z")], "pair long, v string")
    assert sorted(map(tuple, routing.for_all(rows, members).collect())) == [(3, "x"), (3, "y"), (4, "z"), (5, "x"), (5, "y")]


def test_goals_of_a_block_share_their_searches(spark):
    """By blocks of any size, all pairs of a grid have the routes of single searches, empty and missing ones included."""
    import numpy as np

    states = routing.priced(*build(spark, GRID, random_grid(11)), K.CostModel(), K.Taste())
    graph, _ = routing.load(states, build(spark, GRID, random_grid(11))[1], K.CostModel(), K.Taste())
    for many in (1, 3, 5, 16):
        block = graph.blocks(many)
        assert len(set(block.tolist())) >= many and np.bincount(block).max() <= -(-16 // many) + 1
        for number in set(block.tolist()):
            pairs = [(a, b) for a in range(16) for b in np.flatnonzero(block == number).tolist() if a != b]
            pair, state = graph.to_goals(pairs, block)
            for k, (a, b) in enumerate(pairs):
                best, came, last = graph.search(a, b)
                got = state[pair == k].tolist()
                assert bool(got) == (last >= 0)
                if got:  # joined end to end, and as cheap
                    assert int(graph.head[got[-1]]) == b and graph.first[a] <= got[0] < graph.first[a + 1]
                    cost = float(graph.edge_search[got[0]]) + sum(dict(graph._leaving(s, False))[n] for s, n in zip(got, got[1:]))
                    assert abs(cost - best[last]) < 1e-9
