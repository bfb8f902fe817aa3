"""From raw segments to a contracted network: dedupe, degree, chains, turns, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velonet import constants as C
from velonet.functions import geo
from velonet.sources.shared import Parts, Rounds, cut_lineage


def dedupe_segments(raw: DataFrame) -> DataFrame:
    """One row per unordered node pair, ``a`` < ``b``.

    raw: a, b, seq (way order), length, surface (0, 1 unpaved, 2 shared), grade, traffic, lit (boolean), name,
    forward, backward (booleans, in the direction a to b), class (bits). Unpaved wins over shared, the worst grade and
    traffic stay, any light counts, the first name in way order is kept, directions and classes
    add up, and a dedicated way is not its own sidepath. Segments from a node to itself go.
    """
    turned = F.col("a") > F.col("b")
    rows = raw.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "seq", "length", "surface", "grade", "traffic", "lit", "name", "class",
        F.when(turned, F.col("backward")).otherwise(F.col("forward")).alias("forward"),
        F.when(turned, F.col("forward")).otherwise(F.col("backward")).alias("backward"),
    )
    one = rows.groupBy("a", "b").agg(
        F.min_by("length", "seq").alias("length"),
        F.bool_or(F.col("surface") == C.UNPAVED).alias("_unpaved"), F.bool_or(F.col("surface") == C.SHARED).alias("_shared"),
        F.max("grade").alias("grade"), F.max("traffic").alias("traffic"), F.bool_or("lit").alias("lit"),
        F.coalesce(F.min_by("name", F.when(F.col("name") != "", F.col("seq"))), F.lit("")).alias("name"),
        F.bool_or("forward").alias("forward"), F.bool_or("backward").alias("backward"), F.bit_or("class").alias("class"), F.count(F.lit(1)).alias("ways"),
    )
    surface = F.when(F.col("_unpaved"), C.UNPAVED).when(F.col("_shared"), C.SHARED).otherwise(0)
    kind = F.when(F.col("class").bitwiseAND(C.DEDICATED) != 0, F.col("class").bitwiseAND(~C.SIDEPATH)).otherwise(F.col("class"))
    return one.withColumn("surface", surface).withColumn("class", kind).drop("_unpaved", "_shared")


def both_ways(edges: DataFrame, keep: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Each undirected row once per end: tail, head, ``along`` (true from a to b), and the columns of ``keep``."""
    ends = F.array(F.struct(F.col(a).alias("tail"), F.col(b).alias("head"), F.lit(True).alias("along")), F.struct(F.col(b).alias("tail"), F.col(a).alias("head"), F.lit(False).alias("along")))
    return edges.select(*keep, F.explode(ends).alias("_e")).select("_e.*", *keep)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of an undirected edge table."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def directed_states(edges: DataFrame) -> DataFrame:
    """The rideable directions: state = 2 * edge_id, plus 1 against the edge; bearings as ridden."""
    rows = both_ways(edges.withColumn("edge_id", F.col("edge_id").cast("long")), [c for c in edges.columns if c not in ("a", "b")])
    bit = F.when(F.col("along"), C.FORWARD).otherwise(C.BACKWARD)
    turned = lambda x: F.pmod(F.col(x) + 180.0, F.lit(360.0))
    return rows.filter(F.col("access").bitwiseAND(bit) != 0).select(
        "*", (F.col("edge_id") * 2 + F.when(F.col("along"), 0).otherwise(1)).alias("state"),
        F.when(F.col("along"), F.col("bearing_a")).otherwise(turned("bearing_b")).alias("leaves"),
        F.when(F.col("along"), F.col("bearing_b")).otherwise(turned("bearing_a")).alias("arrives"),
    )


def turn_table(states: DataFrame, degree: DataFrame) -> DataFrame:
    """Every transition between directed states through a shared node, U-turns included: swing and degree."""
    into = states.select(F.col("state").alias("from_state"), F.col("head").alias("node"), "arrives")
    out = states.select(F.col("state").alias("to_state"), F.col("tail").alias("node"), "leaves")
    pairs = into.join(out, "node").join(degree.withColumnRenamed("node", "node"), "node")
    return pairs.select("from_state", "to_state", "node", "degree", geo.swing("arrives", "leaves").alias("swing"))


def chain_positions(edges: DataFrame, interior: DataFrame, max_doublings: int = 40) -> DataFrame:
    """(tail, head, start_tail, start_head, pos): each directed half-edge in its chain.

    ``interior`` holds the nodes that dissolve (two arms). A half-edge points to the one before it
    until a start, whose tail stays; pointers double each round, so a chain of n takes log2(n) rounds.
    Rings without a start are left out.
    """
    halves = both_ways(edges, []).select("tail", "head")
    inner = interior.select(F.col("node").alias("tail"))
    # the half-edge before (w, x), x being ahead, is (u, w) with u <> x
    before = halves.select(F.col("tail").alias("before"), F.col("head").alias("tail"))
    links = halves.join(inner, "tail", "left_semi").join(before, "tail").filter("before <> head")
    starts = halves.join(inner, "tail", "left_anti")
    now = starts.select("tail", "head", F.col("tail").alias("pt"), F.col("head").alias("ph"), F.lit(0).alias("pos"), F.lit(True).alias("done"))
    now = now.unionByName(links.select("tail", "head", F.col("before").alias("pt"), F.col("tail").alias("ph"), F.lit(1).alias("pos"), F.lit(False).alias("done")))
    now = cut_lineage(now, "chains")
    open_before = None
    for _ in range(max_doublings):
        still = now.filter("not done").count()
        if still == 0 or still == open_before:  # what is left never shrinks: rings
            break
        open_before = still
        ahead = now.select(F.col("tail").alias("pt"), F.col("head").alias("ph"), F.col("pt").alias("qt"), F.col("ph").alias("qh"), F.col("pos").alias("more"), F.col("done").alias("ended"))
        moved = now.filter("not done").join(ahead, ["pt", "ph"]).select("tail", "head", F.col("qt").alias("pt"), F.col("qh").alias("ph"), (F.col("pos") + F.col("more")).alias("pos"), F.col("ended").alias("done"))
        now = cut_lineage(now.filter("done").unionByName(moved), "chains")
    return now.filter("done").select("tail", "head", F.col("pt").alias("start_tail"), F.col("ph").alias("start_head"), "pos")


def weighted_mode(rows: DataFrame, keys: list[str], value: str, weight: str, pos: str, name: str) -> DataFrame:
    """(keys, name): the value that carries most weight; ties go to the one met first."""
    sums = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.min(pos).alias("_p"))
    return sums.groupBy(*keys).agg(F.max_by(value, F.struct("_w", -F.col("_p"))).alias(name))


def sum_along(value: Column, pos: str = "pos") -> Column:
    """The sum in order of ``pos``: to the last bit the same whatever the partitions, so halves at the last digit aren't rounded by chance."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(pos, value.alias("v")))), F.lit(0.0), lambda s, e: s + e["v"])


def bearings_by_node(segments: DataFrame) -> DataFrame:
    """(node, cycle, road): headings of the dedicated ways and of the others that leave each node, sorted."""
    halves = both_ways(segments, ["bearing_a", "class"])
    away = F.when(F.col("along"), F.col("bearing_a")).otherwise(F.pmod(F.col("bearing_a") + 180.0, F.lit(360.0)))
    dedicated = F.col("class").bitwiseAND(C.DEDICATED) != 0
    own = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("b"))))
    return halves.select(F.col("tail").alias("node"), away.alias("b"), dedicated.alias("d")).groupBy("node").agg(own(F.col("d")).alias("cycle"), own(~F.col("d")).alias("road"))


def contract(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of ``contract_with_shapes``."""
    return contract_with_shapes(segments, nodes)[0]


def contract_with_shapes(segments: DataFrame, nodes: DataFrame, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges between the nodes that stay (degree other than two), one row per chain of segments, and what lies inside each.

    segments: as from ``dedupe_segments``, with bearing_a and bearing_b (headings leaving a and reaching b, along a to b).
    nodes: node, kind, barrier, for shapes lon and lat; optional ``inside``: a chain that leaves is dropped, as no node outside stays;
    degrees count all segments, so a junction with an arm outside is one. Lengths add up; traffic, name and
    class are those that carry most metres, grade that of most rough metres; any network bit stays; a direction
    stays if every segment has it (edges without any go unless ``closed``); delays inside are counts. A chain is written from its end with the smaller id
    (of a loop, from its smaller neighbour); (a, b, first) is its key, ``build_network`` numbers edges by it.
    The second table has (a, b, first, pos, node, lon, lat, kind): the nodes inside, pos from 0 in the edge's direction.
    """
    degree = degrees(segments)
    flags = degree.join(nodes, "node", "left")
    bounded = "inside" in nodes.columns
    inside = F.coalesce(F.col("inside"), F.lit(True)) if bounded else F.lit(True)
    interior = flags.filter((F.col("degree") == 2) & inside).select("node", F.coalesce("kind", F.lit(0)).alias("kind"), F.coalesce("barrier", F.lit(0)).alias("barrier"))
    spots = chain_positions(segments, interior)
    keep = [c for c in segments.columns if c not in ("a", "b")]
    rows = both_ways(segments, keep).join(spots, ["tail", "head"])
    chain = ["start_tail", "start_head"]
    inner = interior.select(F.col("node").alias("head"), "kind", "barrier")
    rows = rows.join(inner, "head", "left")
    # a chain counts if its last head stays; of its two directions one is kept
    ends = rows.groupBy(*chain).agg(F.max_by(F.struct("head", "tail", F.col("kind").isNull().alias("ends")), "pos").alias("last"))
    one = F.col("start_tail") < F.col("last.head")
    loop = (F.col("start_tail") == F.col("last.head")) & (F.col("start_head") <= F.col("last.tail"))
    ends = ends.filter(F.col("last.ends") & (one | loop)).select(*chain, F.col("last.head").alias("end"))
    if bounded:
        outside = flags.filter(~inside)
        for end in ("start_tail", "end"):
            ends = ends.join(outside.select(F.col("node").alias(end)), end, "left_anti")
    rows = cut_lineage(rows.join(ends, chain), "contract")
    shapes = rows.filter("kind is not null").select(F.col("start_tail").alias("a"), F.col("end").alias("b"), F.col("start_head").alias("first"), "pos", F.col("head").alias("node"), "kind", *chain)
    if {"lon", "lat"} <= set(nodes.columns):
        shapes = shapes.join(nodes.select("node", "lon", "lat"), "node")
    else:
        shapes = shapes.withColumns({c: F.lit(None).cast("double") for c in ("lon", "lat")})
    along = F.col("along")
    forward, backward = F.when(along, F.col("forward")).otherwise(F.col("backward")), F.when(along, F.col("backward")).otherwise(F.col("forward"))
    turned = lambda x: F.pmod(F.col(x) + 180.0, F.lit(360.0))
    sums = rows.groupBy(*chain, "end").agg(
        sum_along(F.col("length")).alias("length"),
        sum_along(F.when(F.col("surface") == C.UNPAVED, F.col("length")).otherwise(0.0)).alias("unpaved"),
        sum_along(F.when(F.col("surface") == C.SHARED, F.col("length")).otherwise(0.0)).alias("shared"),
        sum_along(F.when(F.col("lit"), F.col("length")).otherwise(0.0)).alias("lit"),
        F.sum(F.when(F.col("kind") == C.ISLAND_SIGNAL, 2).when(F.col("kind") == C.SIGNAL, 1).otherwise(0)).alias("signals"),
        F.sum(F.when(F.col("kind") == C.CROSSING, 1).otherwise(0)).alias("crossings"),
        F.sum(F.coalesce("barrier", F.lit(0))).alias("barriers"),
        (F.bool_and(forward).cast("int") * C.FORWARD + F.bool_and(backward).cast("int") * C.BACKWARD).alias("access"),
        F.bool_or(F.col("class").bitwiseAND(C.NETWORK) != 0).alias("_network"),
        F.count(F.lit(1)).alias("segments"),
        F.min_by(F.when(along, F.col("bearing_a")).otherwise(turned("bearing_b")), "pos").alias("bearing_a"),
        F.max_by(F.when(along, F.col("bearing_b")).otherwise(turned("bearing_a")), "pos").alias("bearing_b"),
    )
    rows = rows.withColumn("base", F.col("class").bitwiseAND(~C.NETWORK))
    modes = [
        weighted_mode(rows, chain, "traffic", "length", "pos", "traffic"),
        weighted_mode(rows.filter("name <> ''"), chain, "name", "length", "pos", "name"),
        weighted_mode(rows.filter("grade > 0"), chain, "grade", "length", "pos", "grade"),
        weighted_mode(rows, chain, "base", "length", "pos", "base"),
    ]
    for m in modes:
        sums = sums.join(m, chain, "left")
    if not closed:
        open_ = sums.filter("access > 0")
        shapes = shapes.join(open_.select(*chain), chain, "left_semi")
        sums = open_
    edges = sums.select(
        F.col("start_tail").alias("a"), F.col("end").alias("b"), F.col("start_head").alias("first"), "length", "unpaved", "shared", "lit", "signals", "crossings", "barriers",
        "access", F.coalesce("traffic", F.lit(0)).alias("traffic"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("grade", F.lit(0)).alias("grade"),
        (F.col("base") + F.when(F.col("_network"), C.NETWORK).otherwise(0)).alias("class"), "segments", "bearing_a", "bearing_b",
    )
    return edges, shapes.select("a", "b", "first", "pos", "node", "lon", "lat", "kind")


def number_rows(df: DataFrame, order: list[str], name: str, partitions: int = 64) -> DataFrame:
    """Dense ids from 0 in ``order`` without one task for all: range partitions, counts, then offsets."""
    parts = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    parts = cut_lineage(parts, "numbered")
    base = parts.groupBy("_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    base = base.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(base.select("_p", "_first", "_before")), "_p").withColumn(name, F.col("_m") - F.col("_first") + F.col("_before")).drop("_p", "_m", "_first", "_before")


def build_network(segments: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) to route on: contracted, cut to the largest strongly connected component, and numbered from 0 in order of (a, b, first).

    Nodes keep their ids, and get the ``degree`` they have among all segments: neither contraction nor the cut makes turns free.
    """
    edges = cut_lineage(contract(segments, nodes).withColumn("edge_id", F.lit(0)), "edges")
    kept = cut_lineage(largest_scc(directed_states(edges).select("tail", "head")), "component")
    edges = number_rows(restrict(edges.drop("edge_id"), kept), ["a", "b", "first"], "edge_id")
    return edges, nodes.join(kept, "node", "left_semi").join(degrees(segments), "node")


def reachable(arcs: DataFrame, pivot: int, max_rounds: int = 100_000) -> DataFrame:
    """Nodes reached from ``pivot`` over arcs (tail, head), itself included; one join a round."""
    known = Parts("reach", lambda t: t.distinct())
    fresh = known.add(arcs.sparkSession.createDataFrame([(pivot,)], "node long"))
    for _ in range(max_rounds):
        fresh = known.add(arcs.join(fresh.withColumnRenamed("node", "tail"), "tail").select(F.col("head").alias("node")).distinct().join(known.table(), "node", "left_anti"))
        if fresh.isEmpty():
            return known.table()
    raise RuntimeError(f"reachability did not end in {max_rounds} rounds")


#: Arcs up to which routes are worked out in one process.
MAX_ARCS = 5_000_000
#: Arcs up to which components and least costs are; beyond it blocks of a graph are.
TASK_ARCS = 300_000


def largest_scc(arcs: DataFrame) -> DataFrame:
    """(node) of the largest strongly connected component of arcs (tail, head); of equal ones that with the least node.

    One task works on arrays while there are at most ``TASK_ARCS`` arcs; beyond that what is connected within a block becomes one node, again and
    again, while that leaves a fifth less, and the rest goes by joins. All give the same.
    """
    from velonet.operators import blocks

    if arcs.count() <= min(TASK_ARCS, MAX_ARCS):
        return arcs.select("tail", "head").coalesce(1).mapInArrow(_scc_task, "node long")
    left = cut_lineage(arcs.select("tail", "head").distinct(), "arcs")
    members, n = cut_lineage(left.select(F.explode(F.array("tail", "head")).alias("node")).distinct().select("node", F.col("node").alias("into")), "members"), left.count()
    while n:
        into, left = blocks.contracted(left, blocks.BLOCK)
        members = cut_lineage(members.join(into.select(F.col("node").alias("into"), F.col("into").alias("_i")), "into", "left").select("node", F.coalesce("_i", "into").alias("into")), "members")
        before, n = n, left.count()
        if 5 * n > 4 * before:
            break
    if n:
        rest = strong_components(left).select(F.col("node").alias("into"), "component")
        members = cut_lineage(members.join(rest, "into", "left").select("node", F.coalesce("component", "into").alias("into")), "members")
    best = members.groupBy("into").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "into").limit(1)
    return members.join(F.broadcast(best.select("into")), "into").select("node")


def scc_by_joins(arcs: DataFrame) -> DataFrame:
    """``largest_scc`` without any task holding the graph."""
    whole = cut_lineage(strong_components(arcs), "scc")
    best = whole.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return whole.join(F.broadcast(best.select("component")), "component").select("node")


def greatest_reaching(arcs: DataFrame, nodes: DataFrame, salt: int, max_rounds: int = 10_000) -> DataFrame:
    """(node, top): of all nodes that reach each node, itself included, that with the greatest hash.

    A round takes the tops of the nodes just before, and then the top's own top: what reaches the top reaches the node. So tops jump
    further each round, rather than a step at a time.
    """
    rank = lambda c: F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("h"), F.col(c).alias("node"))
    rounds = Rounds("tops")
    now, before = rounds.write(nodes.select("node", rank("node").alias("top"))), None
    for _ in range(max_rounds):
        seen = now.agg(F.sum(F.xxhash64("node", "top.node").cast("decimal(38,0)"))).first()[0]
        if seen == before:
            return now.select("node", F.col("top.node").alias("top"))
        before = seen
        met = arcs.join(now.withColumnRenamed("node", "tail"), "tail").groupBy(F.col("head").alias("node")).agg(F.max("top").alias("met"))
        one = now.join(met, "node", "left").select("node", F.greatest("top", F.coalesce("met", "top")).alias("top"))
        jump = now.select(F.col("node").alias("_n"), F.col("top").alias("further"))
        one = one.withColumn("_n", F.col("top.node")).join(jump, "_n", "left").select("node", F.greatest("top", F.coalesce("further", "top")).alias("top"))
        now = rounds.write(one)
    raise RuntimeError(f"tops did not settle in {max_rounds} rounds")


def strong_components(arcs: DataFrame, trims: int = 3, max_rounds: int = 1000) -> DataFrame:
    """(node, component): the least node of each node's strongly connected component, by colouring.

    Nodes without a way in or out are components of their own. Of the others, all nodes with one top (``greatest_reaching``) are reached by it;
    those of them that reach it back, within their colour, are its component. Each round so finishes a component for every top at once;
    the hash is another one each round, so that no order of ids makes it slow.
    """
    arcs = cut_lineage(arcs.select("tail", "head").distinct(), "scc")
    nodes = cut_lineage(arcs.select(F.explode(F.array("tail", "head")).alias("node")).distinct(), "scc")
    arcs = arcs.filter("tail <> head")
    found = []
    for salt in range(max_rounds):
        for _ in range(trims):
            ends = arcs.select(F.col("tail").alias("node")).intersect(arcs.select(F.col("head").alias("node")))
            alone = cut_lineage(nodes.join(ends, "node", "left_anti").select("node", F.col("node").alias("component")), "scc")
            if alone.isEmpty():
                break
            found.append(alone)
            nodes = cut_lineage(nodes.join(ends, "node", "left_semi"), "scc")
            arcs = cut_lineage(_between(arcs, nodes), "scc")
        if nodes.isEmpty():
            break
        tops = cut_lineage(greatest_reaching(arcs, nodes, 2 * salt), "scc")
        inside = arcs.join(tops.withColumnRenamed("node", "tail"), "tail").join(tops.select(F.col("node").alias("head"), F.col("top").alias("other")), "head").filter("top = other")
        back = greatest_reaching(cut_lineage(inside.select(F.col("head").alias("tail"), F.col("tail").alias("head")), "scc"), nodes, 2 * salt)
        own = back.withColumnRenamed("top", "reached").join(tops, "node").filter("reached = top")
        least = own.groupBy("top").agg(F.min("node").alias("component"))
        done = cut_lineage(own.join(cut_lineage(least, "scc"), "top").select("node", "component"), "scc")
        found.append(done)
        nodes = cut_lineage(nodes.join(done, "node", "left_anti"), "scc")
        arcs = cut_lineage(_between(arcs, nodes), "scc")
    else:
        raise RuntimeError(f"components did not end in {max_rounds} rounds")
    out = found[0] if found else nodes.select("node", F.col("node").alias("component"))
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _between(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    return arcs.join(nodes.select(F.col("node").alias("tail")), "tail", "left_semi").join(nodes.select(F.col("node").alias("head")), "head", "left_semi").select("tail", "head")


def _scc_task(batches):
    import numpy as np
    import pyarrow as pa

    parts = [(np.asarray(b.column("tail")), np.asarray(b.column("head"))) for b in batches]
    if not parts or not sum(len(t) for t, _ in parts):
        return
    ids, into = component_labels(*(np.concatenate(x) for x in zip(*parts)))
    least, n = np.unique(into, return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(ids[into == least[n.argmax()]])], names=["node"])


def component_labels(tail, head):
    """The nodes of arcs, ascending, and the least node of each one's strongly connected component."""
    import numpy as np

    ids, flat = np.unique(np.concatenate([tail, head]), return_inverse=True)
    tail, head = flat[: len(tail)], flat[len(tail) :]
    n = len(ids)

    def arrays(a, b):
        order = np.argsort(a, kind="stable")
        return np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()

    (out_at, out), (in_at, into) = arrays(tail, head), arrays(head, tail)
    seen, order = bytearray(n), []
    for root in range(n):  # finishing order, without recursion
        if seen[root]:
            continue
        seen[root] = 1
        stack = [(root, out_at[root])]
        while stack:
            v, i = stack[-1]
            if i < out_at[v + 1]:
                stack[-1] = (v, i + 1)
                w = out[i]
                if not seen[w]:
                    seen[w] = 1
                    stack.append((w, out_at[w]))
            else:
                stack.pop()
                order.append(v)
    label, least = [-1] * n, list(range(n))
    for root in reversed(order):
        if label[root] >= 0:
            continue
        label[root], stack = root, [root]
        while stack:
            v = stack.pop()
            least[root] = min(least[root], v)
            for i in range(in_at[v], in_at[v + 1]):
                if label[into[i]] < 0:
                    label[into[i]] = root
                    stack.append(into[i])
    return ids, ids[np.array(least)[np.array(label)]]


def restrict(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")
