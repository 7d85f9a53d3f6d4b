"""Times and label maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ns: Column) -> Column:
    """Whole milliseconds, rounded down."""
    return F.call_function("div", ns - F.pmod(ns, F.lit(1_000_000)), F.lit(1_000_000))


def rfc3339(ns: Column) -> Column:
    """UTC (the session's time zone) with as many of nine decimals as are needed."""
    rest = F.pmod(ns, F.lit(1_000_000_000))
    second = F.timestamp_seconds(F.call_function("div", ns - rest, F.lit(1_000_000_000)))
    decimals = F.rtrim(F.lpad(rest.cast("string"), 9, "0"), F.lit("0"))
    return F.concat(F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss"), F.when(decimals != "", F.concat(F.lit("."), decimals)).otherwise(""), F.lit("Z"))


def overlaid(maps: Column) -> Column:
    """An array of label maps, one over the other; the value '' removes a label."""
    empty = F.expr("cast(map() as map<string,string>)")

    def over(all_: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(all_, lambda k, _: ~F.map_contains_key(new, k)), new)

    return F.map_filter(F.aggregate(maps, empty, over), lambda _, v: v != "")
