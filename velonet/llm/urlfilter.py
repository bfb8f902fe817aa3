"""URL filters: path rules by longest match, and a Bloom filter cascade for listed hosts.

DataFrame functions only. The cascade has level 1 encode the listed keys; level 2 the
keys of the universe that level 1 takes for listed though they aren't; level 3 the listed keys
that level 2 takes; and so on until a level takes nothing false. Over the
universe it was built on, the depth of the first level that misses a key tells
whether it is listed, exactly, and no page is joined to a list.

A level is a bit array of ``BITS`` bits a key and travels as a binary literal, which a probe reads one byte of;
``MAX_BITS`` (32 MB) bounds it. Where a level would need more, the keys are dealt by hash into twice as many slices, each with a
cascade of its own, and the pages are judged in one pass a slice, which leaves the result as it is.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule
and is listed only if the list holds the empty host. An empty list, universe or table is fine; null keys of a list and
listed keys that no page has are ignored, repeated ones count once. Every row is judged by itself, so ids may repeat or be null.
Extra columns are kept by ``judge``, but for host, path, rule and verdict, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velonet.llm.store import materialise

BITS, HASHES, MAX_BITS = 12, 5, 1 << 28
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and the path up to ``?`` or ``#``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), _UPPER, _LOWER), F.regexp_extract(u, pattern, 2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule of (verdict, host, path); null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Level:
    table: bytes  # bit i is bit i % 8 of byte i // 8
    bits: int
    seed: int

    def takes(self, key: Column) -> Column:
        if not self.table:
            return F.lit(False)
        table, hit = F.lit(self.table), F.lit(True)
        for i in _places(key, self.bits, self.seed):
            byte = F.conv(F.hex(F.substring(table, (F.floor(i / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            hit = hit & (F.call_function("getbit", byte, (i % 8).cast("int")) == 1)
        return hit


def _places(key: Column, bits: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 * seed + j)), F.lit(bits)) for j in range(HASHES)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Exact for keys of the universe the cascade was built on."""
        out = F.lit(False)
        for depth in range(len(self.levels) - 1, -1, -1):
            # a key that a level misses is of the other kind than that level encodes
            here = F.lit(depth % 2 == 0)
            out = F.when(self.levels[depth].takes(key), here if depth == len(self.levels) - 1 else out).otherwise(~here)
        return out


class TooManyKeys(ValueError):
    """A level would need more than MAX_BITS."""


def _level(keys: DataFrame, seed: int) -> Level:
    n = keys.count()
    bits = -(-max(n * BITS, 1) // 32) * 32
    if bits > MAX_BITS:
        raise TooManyKeys(f"{n} keys ask for {bits} bits")
    if not n:
        return Level(b"", 32, seed)
    at = keys.select(F.explode(F.array(*_places(F.col("key"), bits, seed))).alias("i"))
    set_ = at.groupBy(F.floor(F.col("i") / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("i") % 32).cast("int"))).alias("x")).toArrow()
    words = np.zeros(bits // 32, "<u4")  # the driver holds one level: at most MAX_BITS and its words as they arrive
    words[np.asarray(set_["w"])] = np.asarray(set_["x"])
    return Level(words.tobytes(), bits, seed)


def _cascade(keys: DataFrame, max_levels: int) -> Cascade:
    levels: list[Level] = []
    while True:
        turn = len(levels) % 2 == 0  # odd levels encode listed keys, even ones false positives
        own = keys.filter(F.col("listed") == F.lit(turn))
        for level in levels:
            own = own.filter(level.takes(F.col("key")))
        made = _level(own.select("key"), len(levels) + 1)
        if not made.table:
            break
        levels.append(made)
        if len(levels) > max_levels:
            raise RuntimeError("the cascade did not end")
    return Cascade(tuple(levels))


def _slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(slices))


def build_cascades(universe: DataFrame, listed: Column | DataFrame, max_levels: int = 40) -> list[Cascade]:
    """From the keys (column ``key``) of the corpus and the list (a table with ``key``, or the condition by which a key is listed): a cascade a slice."""
    keys = universe.select("key").filter("key is not null").distinct()
    if isinstance(listed, DataFrame):
        given = listed.select("key").filter("key is not null").distinct().withColumn("_in", F.lit(True))
        keys, listed = keys.join(given, "key", "left"), F.col("_in")
    keys = materialise(keys.select("key", F.coalesce(listed, F.lit(False)).alias("listed")), "cascade-keys")
    slices = 1
    while True:
        try:
            return [_cascade(keys if slices == 1 else keys.filter(_slice(F.col("key"), slices) == i), max_levels) for i in range(slices)]
        except TooManyKeys:
            slices *= 2


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: Column | DataFrame) -> DataFrame:
    """``pages`` with host, path, rule and verdict: the longest rule's, else block for listed hosts (``listed``: as in ``build_cascades``)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    cascades = build_cascades(rows.select(F.col("host").alias("key")), listed)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    out = None
    for i, cascade in enumerate(cascades):
        own = rows if len(cascades) == 1 else rows.filter(_slice(F.col("host"), len(cascades)) == i)
        own = own.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(cascade.listed(F.col("host")), "block").otherwise("allow"))})
        out = own if out is None else out.unionByName(own)
    return out
