"""Property paths: sets of (start, end) pairs, closed by joins that double the reach each round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from ..terms import Solutions
from . import relational as R

S, O = "__ps", "__po"  # noqa: E741


def swap(e: Solutions) -> Solutions:
    df = e.df.select(R.col(O).alias(S), R.col(S).alias(O))
    return Solutions(df, {S: e.types[O], O: e.types[S]})


def sequence(a: Solutions, b: Solutions) -> Solutions:
    left = Solutions(a.df.select(R.col(S), R.col(O).alias("__mid")), {S: a.types[S], "__mid": a.types[O]})
    right = Solutions(b.df.select(R.col(S).alias("__mid"), R.col(O)), {"__mid": b.types[S], O: b.types[O]})
    return R.distinct(R.project(R.join(left, right), [S, O]))


def alternative(a: Solutions, b: Solutions) -> Solutions:
    return R.distinct(R.union([a, b]))


def same_types(e: Solutions) -> Solutions:
    """Both ends with the types of either."""
    types = tuple(sorted({*e.types[S], *e.types[O]}))
    return Solutions(R.conform(e, {S: types, O: types}), {S: types, O: types})


def identity(e: Solutions) -> Solutions:
    nodes = e.df.select(R.col(S).alias(S)).union(e.df.select(R.col(O).alias(S))).distinct()
    return Solutions(nodes.select(R.col(S), R.col(S).alias(O)), dict(e.types))


def repeat(edges: Solutions, kind: str, start: Column | None = None, end: Column | None = None) -> Solutions:
    """p*, p+ or p?. With a constant ``start`` or ``end`` only what is reached from there is explored.

    The zero-length part of * and ? holds for the subjects and objects of the path's own edges.
    """
    e = same_types(edges)
    if kind == "?":
        return R.distinct(R.union([e, identity(e)]))
    if start is not None or end is not None:
        step = e if start is not None else swap(e)
        out = reach(step, start if start is not None else end)
        out = out if start is not None else swap(out)
        zero = identity(e)
        zero = Solutions(zero.df.where(R.col(S) == (start if start is not None else end)), zero.types)
    else:
        out, zero = closure(e), identity(e)
    return R.distinct(R.union([out, zero])) if kind == "*" else out


class _Growing:
    """Rows that come in rounds. What is there is not written again, but for now and then, when its parts have become many."""

    def __init__(self, first: DataFrame, most: int = 16):
        self.parts, self.most = [first], most

    def add(self, new: DataFrame) -> None:
        self.parts.append(new)
        if len(self.parts) > self.most:
            self.parts = [materialise(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)


def closure(e: Solutions) -> Solutions:
    """p+: the newest pairs meet all pairs, on both sides, until there are none."""
    new = materialise(e.df.distinct())
    grown = _Growing(new)
    while not new.isEmpty():
        known = grown.all()
        a = new.select(R.col(S), R.col(O).alias("m")).join(known.select(R.col(S).alias("m"), R.col(O)), "m").select(S, O)
        b = known.select(R.col(S), R.col(O).alias("m")).join(new.select(R.col(S).alias("m"), R.col(O)), "m").select(S, O)
        new = materialise(a.union(b).distinct().join(known, [S, O], "left_anti"))
        grown.add(new)
    return Solutions(grown.all(), dict(e.types))


def reach(e: Solutions, start: Column) -> Solutions:
    """Pairs (start, end) of p+ from one node, by frontiers."""
    frontier = materialise(e.df.where(R.col(S) == start).select(R.col(O).alias("n")).distinct())
    grown = _Growing(frontier)
    while not frontier.isEmpty():
        step = frontier.join(e.df.select(R.col(S).alias("n"), R.col(O)), "n").select(R.col(O).alias("n")).distinct()
        frontier = materialise(step.join(grown.all(), "n", "left_anti"))
        grown.add(frontier)
    return Solutions(grown.all().select(start.alias(S), F.col("n").alias(O)), dict(e.types))
