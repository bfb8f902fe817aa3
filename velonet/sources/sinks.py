"""Checked Parquet sinks with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet import constants as C

VERSIONS = {"graph": 9, "search": 2, "climb": 3, "winter": 1}

#: Ranges that stored numbers must have; a value outside is an error, never clamped.
RANGES = {"length": (0.0, 6553.5), "unpaved": (0.0, 6553.5), "shared": (0.0, 6553.5), "lit": (0.0, 6553.5), "grade": (0, 3), "traffic": (0, 4), "class": (0, 7), "access": (0, 3), "signals": (0, 255), "crossings": (0, 255), "barriers": (0, 255)}


def checked(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``df``, failing on the first value out of range or null."""
    limits = {k: v for k, v in (ranges or RANGES).items() if k in df.columns}

    def guard(c: str, low: float, high: float) -> Column:
        wrong = F.raise_error(F.concat(F.lit(f"{c} out of {low}..{high}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
        return F.when(F.col(c).between(low, high), F.col(c)).otherwise(wrong.cast(df.schema[c].dataType))

    return df.withColumns({c: guard(c, *v) for c, v in limits.items()})


def digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order, files and partitions: their number, and sums of two hashes of each row."""
    columns = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in sorted(df.dtypes)]
    row = df.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")), F.lit(0)) for salt in (1, 2))).first()
    return "-".join(format(int(x) % (1 << 64), "x") for x in row)


def same_rows(side: DataFrame, edges: DataFrame) -> None:
    """A side table must have a row for each edge."""
    n, m = side.count(), edges.count()
    if n != m:
        raise ValueError(f"the side table has {n} rows, the graph {m} edges")


def inside(points: DataFrame, bounds=C.BOUNDS) -> DataFrame:
    """Points, failing on one outside the region."""
    return checked(points, {"lon": (bounds[0], bounds[2]), "lat": (bounds[1], bounds[3])})


def write(tables: dict[str, DataFrame], path: str, kind: str, order: dict[str, list[str]] | None = None, **facts) -> None:
    """Each table as Parquet under ``path``, range-checked and in a set order, and ``_manifest`` with counts, digests and facts."""
    spark = next(iter(tables.values())).sparkSession
    counts, digests = {}, {}
    for name, df in tables.items():
        out = checked(df)
        if order and name in order:
            # the same rows always give the same files: range partitions in order, sorted within
            out = out.repartitionByRange(*order[name]).sortWithinPartitions(*order[name])
        out.write.mode("overwrite").parquet(f"{path}/{name}")
        stored = spark.read.parquet(f"{path}/{name}")
        counts[name], digests[name] = stored.count(), digest(stored)
    manifest = json.dumps({"kind": kind, "version": VERSIONS[kind], "tables": counts, "digests": digests, **facts}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest.json")


def read(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and manifest of ``path``; another kind, version, row count or content is refused."""
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/_manifest.json").collect()))
    if manifest["kind"] != kind or manifest["version"] != VERSIONS[kind]:
        raise ValueError(f"{path} is {manifest['kind']} {manifest['version']}, not {kind} {VERSIONS[kind]}")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in manifest["tables"]}
    for n, df in tables.items():
        if df.count() != manifest["tables"][n]:
            raise ValueError(f"{n} has lost rows")
        if n in manifest.get("digests", {}) and digest(df) != manifest["digests"][n]:
            raise ValueError(f"{n} holds other rows than were written")
    return tables, manifest
