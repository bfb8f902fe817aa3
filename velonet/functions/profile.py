"""The rider profile: token codec, stops, presets, range checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet import constants as C

TOKEN = r"([a-zA-Z])(-?[0-9]*\.?[0-9]+)"


def default_taste() -> dict[str, float]:
    return {k: float(values[standard]) for k, (values, standard) in C.STOPS.items()}


def preset_taste(name: str) -> dict[str, float]:
    return default_taste() | {k: float(C.STOPS[k][0][stop]) for k, stop in C.PRESETS[name].items()}


def stops_table(spark: SparkSession) -> DataFrame:
    """(key, stop, value, standard): the preference stops as a small dimension table."""
    return spark.createDataFrame([(k, i, float(v), i == s) for k, (values, s) in C.STOPS.items() for i, v in enumerate(values)], "key string, stop int, value double, standard boolean")


def short_number(value: Column) -> Column:
    """Three significant digits without trailing zeros."""
    digits = F.when(value == 0, 0).otherwise(2 - F.floor(F.log10(F.abs(value))))
    scaled = F.bround(value * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    text = F.format_string("%.6f", scaled)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def encode(values: dict[str, Column]) -> Column:
    """Only what differs from the standard is written; lower case is taste, upper case cost."""
    standard, parts = default_taste(), []
    for key, code in C.TASTE_CODES.items():
        if key in values:
            parts.append(F.when(F.abs(values[key] - standard[key]) > 1e-9, F.concat(F.lit(code), short_number(values[key]))))
    for key, code in C.COST_CODES.items():
        if key in values:
            parts.append(F.when(values[key].isNotNull(), F.concat(F.lit(code), short_number(values[key]))))
    return F.concat_ws("", *parts)


def decode(token: Column) -> Column:
    """MAP<key, value> of the numbers of a token; unknown letters and numbers out of range are dropped, the last one wins."""
    known = {c: (k, C.TASTE_RANGE) for k, c in C.TASTE_CODES.items()} | {c: (k, C.COST_RANGES[k]) for k, c in C.COST_CODES.items()}
    table = lambda part: F.create_map(*(F.lit(x) for c, v in known.items() for x in (c, part(v))))
    names, low, high = table(lambda v: v[0]), table(lambda v: v[1][0]), table(lambda v: v[1][1])
    letters, digits = F.regexp_extract_all(token, F.lit(TOKEN), F.lit(1)), F.regexp_extract_all(token, F.lit(TOKEN), F.lit(2))
    pairs = F.transform(F.arrays_zip(letters.alias("c"), digits.alias("d")), lambda x: F.struct(x["c"].alias("c"), x["d"].cast("double").alias("d")))
    good = F.filter(pairs, lambda x: names[x["c"]].isNotNull() & x["d"].between(low[x["c"]], high[x["c"]]))
    # the last of a letter wins: keep a pair unless its letter comes again
    last = F.filter(good, lambda x, i: ~F.exists(F.slice(good, i + 2, F.greatest(F.size(good) - i - 1, F.lit(0))), lambda y: y["c"] == x["c"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(names[x["c"]], x["d"])))


def in_range(key: str, value: Column) -> Column:
    """A stored number if it may be used, else null."""
    low, high = C.SPEED_RANGE if key == "speed" else C.COST_RANGES.get(key, C.TASTE_RANGE)
    return F.when(value.between(low, high), value)


def trip_parameters(link: Column) -> dict[str, Column]:
    """Ends, speed and profile token of a shared link; a speed out of range is dropped."""
    part = lambda k: F.parse_url(link, F.lit("QUERY"), F.lit(k))
    speed = part("v").try_cast("double") if hasattr(Column, "try_cast") else part("v").cast("double")
    point = lambda k, i: F.get(F.split(part(k), ","), F.lit(i)).cast("double")
    return {"from_lon": point("a", 0), "from_lat": point("a", 1), "to_lon": point("b", 0), "to_lat": point("b", 1), "speed": F.when(speed.between(*C.LINK_SPEED_RANGE), speed), "token": part("p")}
