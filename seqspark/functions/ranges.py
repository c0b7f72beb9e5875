"""Algebra of sequence ranges such as ``complement(join(1..5,<8..>10))``: arrays of (left, right, reverse, open_left, open_right)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = "array<struct<left:bigint,right:bigint,reverse:boolean,open_left:boolean,open_right:boolean>>"
_SPAN = re.compile(r"(<?)(\d+)(?:\.\.(>?)(\d+)(>?))?$")


def parse(text: str | None) -> list[dict] | None:
    """Ranges of one location text, in its order; None if it's null or no location. ``complement`` turns the strand of all inside it."""
    if text is None:
        return None
    out: list[dict] = []
    reverse = [False]
    for token in re.findall(r"(?:join|order|complement)\(|\)|[^,()\s]+", text):
        if token.endswith("("):
            reverse.append(reverse[-1] != token.startswith("complement"))
        elif token == ")":
            if len(reverse) == 1:
                return None
            reverse.pop()
        elif m := _SPAN.match(token):
            a, b = int(m[2]), int(m[4] or m[2])
            out.append({"left": min(a, b), "right": max(a, b), "reverse": reverse[-1] != (a > b), "open_left": bool(m[1]), "open_right": bool(m[3] or m[5])})
        else:
            return None
    return out if len(reverse) == 1 and out else None


def parse_range(c: Column) -> Column:
    """The ranges of a location text, parsed in Arrow batches."""
    def many(texts: pd.Series) -> pd.Series:
        return pd.Series([parse(t) for t in texts])

    return F.pandas_udf(many, RANGE)(c)


def leftmost(r: Column) -> Column:
    return F.array_min(F.transform(r, lambda x: x["left"]))


def rightmost(r: Column) -> Column:
    return F.array_max(F.transform(r, lambda x: x["right"]))


def range_size(r: Column) -> Column:
    """Positions of all ranges, those covered twice counted twice."""
    return F.aggregate(r, F.lit(0).cast("bigint"), lambda s, x: s + x["right"] - x["left"] + 1)


def reversed_range(r: Column) -> Column:
    return F.transform(F.reverse(r), lambda x: F.struct(x["left"].alias("left"), x["right"].alias("right"), (~x["reverse"]).alias("reverse"), x["open_left"].alias("open_left"), x["open_right"].alias("open_right")))


def sorted_range(r: Column) -> Column:
    return F.array_sort(r)


def compacted(r: Column) -> Column:
    """Ranges in order with those of one strand that overlap or touch merged."""
    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (x["left"] <= last["right"] + 1)
        merged = F.struct(last["left"].alias("left"), F.greatest(last["right"], x["right"]).alias("right"), last["reverse"].alias("reverse"), last["open_left"].alias("open_left"), F.when(x["right"] > last["right"], x["open_right"]).otherwise(last["open_right"]).alias("open_right"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged))).otherwise(F.concat(done, F.array(x)))

    def strand(reverse: bool) -> Column:
        one = F.array_sort(F.filter(r, lambda x: x["reverse"] == reverse))
        # the last range is looked up only where there is one
        return F.aggregate(one, F.slice(one, 1, 1), add)

    return F.concat(strand(False), strand(True))


def united(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def overlaps(a: Column, b: Column) -> Column:
    """Whether a range of one has a position in common with a range of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["left"] <= y["right"]) & (y["left"] <= x["right"])))


def touches(a: Column, b: Column) -> Column:
    """Whether a range of one overlaps or lies right next to a range of the other on the same strand."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["reverse"] == y["reverse"]) & (x["left"] <= y["right"] + 1) & (y["left"] <= x["right"] + 1)))


def coverage_ratio(a: Column, b: Column) -> Column:
    """Size of one, merged, over the size of the other, merged."""
    return range_size(compacted(a)) / range_size(compacted(b))
