"""Routes in SQL: a table function over pairs of ends, and an exhaustive search by a recursive query for tiny graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, IntegralType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

from velonet.functions import cost as K
from velonet.operators.routing import Graph, state_arcs

ADDED = (("rank", IntegerType()), ("pos", IntegerType()), ("state", LongType()), ("swing", DoubleType()))


def register_route(spark: SparkSession, graph: Graph, metres: np.ndarray, name: str = "route") -> None:
    """The table function ``name`` over a graph that fits a worker (``routing.load`` sees to that), which each worker keeps.

        SELECT * FROM route(TABLE(SELECT trip, rider, start, goal FROM trips), 3)

    The table needs whole-number columns start and goal; all its columns come along, and rank, pos, state and swing are added: the edges of up to
    as many routes as the second argument says (1 without it), in riding order, as ``routing.routes`` gives them. Rows are
    partitioned by their ends, and equal ends share one search. Equal ends have one empty route (pos -1); ends
    that are null, unknown or out of reach have none.
    """
    box = spark.sparkContext.broadcast((graph, metres))
    added = ADDED

    class Route:
        @staticmethod
        def analyze(pairs: AnalyzeArgument, limit: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not pairs.isTable:
                raise ValueError("the first argument is a table of pairs: TABLE(...)")
            types = {f.name: f.dataType for f in pairs.dataType.fields}
            for end in ("start", "goal"):
                if not isinstance(types.get(end), IntegralType):
                    raise ValueError(f"the table needs a whole-number column {end}")
            if clash := {n for n, _ in added} & set(types):
                raise ValueError(f"the table has columns {sorted(clash)}, which are added")
            if limit is not None and not (limit.isConstantExpression and isinstance(limit.value, int) and limit.value > 0):
                raise ValueError("the number of routes is a constant above 0")
            schema = StructType(list(pairs.dataType.fields))
            for n, kind in added:
                schema = schema.add(n, kind)
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("start"), PartitioningColumn("goal")])

        def __init__(self):
            self.found = None

        def eval(self, row: Row, limit: int = 1) -> Iterator[tuple]:
            if self.found is None:  # once a partition: all its rows have the same ends
                self.found = self.edges(row["start"], row["goal"], limit)
            for edge in self.found:
                yield (*row, *edge)

        @staticmethod
        def edges(start: int | None, goal: int | None, limit: int) -> list[tuple[int, int, int, float]]:
            g, m = box.value
            a, b = (-1 if end is None else g.place(end) for end in (start, goal))
            if a < 0 or b < 0:
                return []
            if a == b:
                return [(1, -1, -1, 0.0)]
            paths = enumerate(g.alternatives([(a, b)], m, limit)[0], 1)
            return [(rank, pos, int(g.state[s]), g.swing(path, pos)) for rank, path in paths for pos, s in enumerate(path)]

    spark.udtf.register(name, F.udtf(Route))


def exhaustive(states: DataFrame, pairs: DataFrame, model: K.CostModel, taste: K.Taste, turns: bool = True, true: bool = True, levels: int = 40) -> DataFrame:
    """(pair, seconds) by trying every way that rides no state twice: a recursive query, for tiny graphs in tests.

    The number of ways grows exponentially; Spark itself ends the query beyond ``levels`` edges or its limit of rows.
    """
    spark = states.sparkSession
    edge = "true_s" if true else "search_s"
    first = states.select("state", "tail", "head", F.col(edge).alias("seconds"))
    return spark.sql(
        f"""
        WITH RECURSIVE ways (pair, goal, state, at, seconds, ridden) MAX RECURSION LEVEL {int(levels)} AS (
          SELECT p.pair, p.goal, s.state, s.head, s.seconds, array(s.state) FROM {{pairs}} p JOIN {{first}} s ON s.tail = p.start WHERE p.start <> p.goal
          UNION ALL
          SELECT w.pair, w.goal, a.head, s.head, w.seconds + a.seconds, array_append(w.ridden, a.head)
          FROM ways w JOIN {{arcs}} a ON a.tail = w.state JOIN {{first}} s ON s.state = a.head
          WHERE w.at <> w.goal AND NOT array_contains(w.ridden, a.head)
        )
        SELECT pair, min(seconds) AS seconds FROM ways WHERE at = goal GROUP BY pair
        """,
        pairs=pairs, first=first, arcs=state_arcs(states, model, taste, turns, true),
    )
