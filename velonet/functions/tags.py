"""Tag classifiers over a MAP<STRING, STRING> column (or anything indexable by key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from velonet import constants as C


def _has(tags: Column, key: str, *values: str) -> Column:
    """Null-safe membership: a missing key is simply not in."""
    return F.coalesce(tags[key].isin(*values), F.lit(False))


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key], F.lit(default))


def rideable(tags: Column) -> Column:
    road = _has(tags, "highway", *C.RIDEABLE) & ~_has(tags, "bicycle", "no")
    return road | (_has(tags, "highway", *C.WALKWAYS) & _has(tags, "bicycle", *C.WALKWAY_BICYCLE))


def is_signal(tags: Column) -> Column:
    lit = _has(tags, "crossing", "traffic_signals") | _has(tags, "crossing:signals", "yes")
    return _has(tags, "highway", "traffic_signals") | (_has(tags, "highway", "crossing") & lit)


def is_crossing(tags: Column) -> Column:
    return _has(tags, "highway", "crossing")


def node_kind(tags: Column) -> Column:
    """0 plain, 1 crossing, 2 signal, 3 signal crossed in two stages."""
    signal = F.when(_has(tags, "crossing:island", "yes"), C.ISLAND_SIGNAL).otherwise(C.SIGNAL)
    return F.when(is_signal(tags), signal).when(is_crossing(tags), C.CROSSING).otherwise(C.PLAIN)


def barrier_kind(tags: Column) -> Column:
    """2 stop, 1 slow, 0 none."""
    raised = _has(tags, "kerb", "raised") | (_has(tags, "barrier", "kerb") & ~_has(tags, "kerb", "lowered", "flush"))
    return F.when(_has(tags, "barrier", *C.STOP_BARRIERS), 2).when(_has(tags, "barrier", *C.SLOW_BARRIERS) | raised, 1).otherwise(0)


def has_sidepath(tags: Column) -> Column:
    return _has(tags, "bicycle", "use_sidepath") | _any(_has(tags, k, *C.SIDEPATH_VALUES) for k in C.CYCLEWAY_KEYS)


def is_dedicated(tags: Column) -> Column:
    return _has(tags, "highway", "cycleway") | (_has(tags, "highway", "path") & _has(tags, "bicycle", "designated"))


def bicycle_direction(tags: Column) -> Column:
    """1 along, -1 against, 0 both: the bicycle's own tag, contraflow lanes, the general tag, roundabouts."""
    contraflow = _any(F.coalesce(tags[k].contains("opposite"), F.lit(False)) for k in C.CYCLEWAY_KEYS)
    untagged = tags["oneway"].isNull() & _has(tags, "junction", "roundabout")
    return (
        F.when(_has(tags, "oneway:bicycle", *C.ONEWAY_YES), 1)
        .when(_has(tags, "oneway:bicycle", *C.ONEWAY_BACK), -1)
        .when(_has(tags, "oneway:bicycle", "no") | contraflow, 0)
        .when(_has(tags, "oneway", *C.ONEWAY_YES), 1)
        .when(_has(tags, "oneway", *C.ONEWAY_BACK), -1)
        .when(untagged, 1)
        .otherwise(0)
    )


def surface_kind(tags: Column) -> Column:
    """1 unpaved, which wins; 2 shared with people on foot; 0 neither."""
    shared = (
        _has(tags, "highway", *C.WALKWAYS)
        | _has(tags, "segregated", "no")
        | (_has(tags, "highway", "path") & tags["segregated"].isNull() & ~_has(tags, "foot", "no"))
    )
    return F.when(_has(tags, "surface", *C.SLOW_SURFACES), C.UNPAVED).when(shared, C.SHARED).otherwise(0)


def surface_grade(tags: Column) -> Column:
    return _lookup(C.GRADE, tags["surface"], 0)


def traffic_class(tags: Column) -> Column:
    return _lookup(C.TRAFFIC_CLASS, tags["highway"], C.TRAFFIC_UNKNOWN)


def is_elevated(tags: Column) -> Column:
    """On a bridge, in a tunnel or on a layer of its own."""
    given = lambda k, *but: tags[k].isNotNull() & ~_has(tags, k, "", *but)
    return given("bridge") | given("tunnel") | given("layer", "0")


def way_class(tags: Column, in_network: Column) -> Column:
    """Bits: dedicated, sidepath (not on dedicated ways), network."""
    own = F.when(is_dedicated(tags), C.DEDICATED).when(has_sidepath(tags), C.SIDEPATH).otherwise(0)
    return own + F.when(in_network, C.NETWORK).otherwise(0)


def poi_kind(tags: Column) -> Column:
    """The first rule that fits; null where none does."""
    tests = []
    for kind, key, values in C.POI_RULES:
        value = tags[key]
        tests.append(F.when((value != "") & (value.isin(*values) if values else F.lit(True)), kind))
    return F.coalesce(*tests)


def names_of(tags: Column) -> Column:
    """Every name, primary first: split at semicolons, trimmed, without empties or repeats."""
    parts = F.flatten(F.array(*(F.split(F.coalesce(tags[k], F.lit("")), ";", -1) for k in C.NAME_KEYS)))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def notability(tags: Column) -> Column:
    """2 if an article's title is one of the names, 1 if there is any article or item, else 0."""
    article = F.coalesce(tags["wikipedia"], F.lit(""))
    title = F.when(article.contains(":"), F.expr("null").cast("string")).otherwise(article)
    title = F.coalesce(title, F.substring(article, F.instr(article, ":") + 1, F.length(article)))
    known = (article != "") | (F.coalesce(tags["wikidata"], F.lit("")) != "")
    return F.when((title != "") & F.array_contains(names_of(tags), title), 2).when(known, 1).otherwise(0)
