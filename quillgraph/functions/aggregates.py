"""Aggregates over values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import Agg
from ..terms import BOOLEAN, DECIMAL, DOUBLE, INTEGERS, LONG, STRING, UINT, ULONG, native, promote
from .expressions import Scope, evaluate
from .values import Value, bound, by_kind, numbers, pack, read, text


def aggregate(agg: Agg, scope: Scope) -> tuple[Column, tuple[str, ...]]:
    """(aggregate column, its types)."""
    if agg.name == "COUNT":
        if agg.expr is None:
            some = [F.when(bound(read(v, t)), 1) for v, t in scope.types.items() if t]
            if agg.distinct:
                every = F.struct(*[F.col(f"`{v}`") for v, t in scope.types.items() if t])
                return F.count_distinct(every), (UINT,)
            # a row counts that binds anything
            return (F.count(F.coalesce(*some)) if some else F.count(F.lit(1))), (UINT,)
        value = evaluate(agg.expr, scope)
        c, types = pack(value)
        if not types:
            return F.count(F.lit(None)), (UINT,)
        return (F.count_distinct(c) if agg.distinct else F.count(F.when(bound(value), 1))), (UINT,)
    value = evaluate(agg.expr, scope)
    if agg.name in ("SUM", "AVG"):
        if BOOLEAN in value and not numbers(value):
            return F.sum(value[BOOLEAN].cast("int")).cast("decimal(20,0)"), (ULONG,)
        value = numbers(value)
        if not value:
            return F.lit(None).cast("boolean"), ()
        t = next(iter(value))
        for u in value:
            t = promote(t, u)
        one = F.coalesce(*[c.cast(native(t)) for c in value.values()])
        if agg.name == "SUM":
            total = F.sum_distinct(one) if agg.distinct else F.sum(one)
            if t in INTEGERS:  # sums of narrow integers don't fit them
                return total.cast("long"), (t if native(t).simpleString() == "bigint" else LONG,)
            return total.cast(native(t)), (t,)
        distinct = F.try_divide(F.sum_distinct(one).cast("double"), F.count_distinct(one)) if agg.distinct else None
        if t == DECIMAL:
            return (distinct if agg.distinct else F.avg(one)).cast(native(DECIMAL)), (DECIMAL,)
        return (distinct if agg.distinct else F.avg(one)).cast("double"), (DOUBLE,)
    if agg.name in ("MIN", "MAX"):
        f = F.min if agg.name == "MIN" else F.max
        if len(value) > 1 and set(value) == set(numbers(value)):
            t = next(iter(value))
            for u in value:
                t = promote(t, u)
            return f(F.coalesce(*[c.cast(native(t)) for c in value.values()])), (t,)
        c, types = pack(value)
        return (_extreme(f, value, c) if len(types) > 1 else f(c), types) if types else (c, ())
    if agg.name == "GROUP_CONCAT":
        s = text(value)
        gathered = F.array_distinct(F.collect_list(s)) if agg.distinct else F.collect_list(s)
        return F.array_join(gathered, " " if agg.separator is None else agg.separator), (STRING,)
    if agg.name == "LIST":
        c, types = pack(value)
        return (F.array_distinct(F.collect_list(c)) if agg.distinct else F.collect_list(c)), types[:1]
    c, types = pack(value)
    return (F.first(c, ignorenulls=True), types) if types else (c, ())


def _extreme(f: Callable[[Column], Column], value: Value, packed: Column) -> Column:
    """The least or greatest of several types: by kind as in ORDER BY, but numbers among themselves."""
    number = numbers(value)
    kinds = by_kind(value)
    rank = F.lit(None).cast("int")
    for i, t in enumerate(kinds):
        rank = F.when(value[t].isNotNull(), kinds.index(next(u for u in kinds if u in number)) if t in number else i).otherwise(rank)
    keys = [rank.alias("rank")]
    if number:
        t = next(iter(number))
        for u in number:
            t = promote(t, u)
        keys.append(F.coalesce(*[c.cast(native(t)) for c in number.values()]).alias("number"))
    keys += [value[t].alias(f"v{i}") for i, t in enumerate(kinds) if t not in number]
    return f(F.when(bound(value), F.struct(*keys, packed.alias("packed")))).getField("packed")
