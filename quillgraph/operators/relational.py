"""Joins, unions and the like over query rows with typed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Value, by_kind, pack, read
from ..terms import Solutions, native

KEY = "__k_"
#: rows of one key that meet at once, of either side, where both can have many
BLOCK = 2048


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def unit(spark: SparkSession) -> Solutions:
    """One row that binds nothing."""
    return Solutions(spark.range(1).select(), {})


def empty(spark: SparkSession, types: dict[str, tuple[str, ...]]) -> Solutions:
    fields = {v: pack({t: F.lit(None).cast(native(t)) for t in ts})[0] for v, ts in types.items()}
    return Solutions(spark.range(0).select(*[c.alias(v) for v, c in fields.items()]), dict(types), none=True)


def retype(types: tuple[str, ...], name: str, wanted: tuple[str, ...]) -> Column:
    """A variable's column with other types; null where it has none of them."""
    if types == wanted:
        return col(name)
    value = read(name, types) if types else {}
    if len(wanted) == 1 and wanted[0] in value:
        return value[wanted[0]]
    return pack({t: value.get(t, F.lit(None).cast(native(t))) for t in wanted})[0]


def conform(s: Solutions, types: dict[str, tuple[str, ...]], keys: bool = False) -> DataFrame:
    """The rows with exactly these variables and types."""
    cols = [retype(s.types.get(v, ()), v, ts).alias(v) if s.types.get(v) or ts else F.lit(None).cast("boolean").alias(v) for v, ts in types.items()]
    return s.df.select(*cols, *([col(KEY + v) for v in s.keys] if keys else []))


def _match(left: Solutions, right: Solutions, how: str) -> tuple[Solutions, DataFrame, Column | None, list[str], bool] | None:
    """Both sides made ready for an equi-join: right's shared columns are renamed. None where types rule out any match."""
    shared = [v for v in left.types if v in right.types]
    names = {v: f"__r_{v}" for v in shared}
    condition: Column | None = None
    lcols, rcols, out_types, possible = {}, {}, dict(left.types), True
    keyed = []
    for v in shared:
        a, b = left.types[v], right.types[v]
        common = tuple(sorted(set(a) & set(b)))
        null_ok = v in left.maybe and v in right.maybe and how not in ("left_anti_strict",)
        if not common:
            if not (null_ok or (not a and not b)):
                possible = False
            test = retype(a, v, a).isNull() & col(names[v]).isNull() if a else col(names[v]).isNull()
            rcols[v] = retype(b, v, b) if b else F.lit(None).cast("boolean")
        else:
            k = left.keys.get(v), right.keys.get(v)
            if k[0] and k[1] and k[0][0] == k[1][0]:
                keyed.append(v)
                test = col(KEY + v) == col(f"__rk_{v}")
                rcols[v] = None
            elif how in ("inner", "left_semi"):
                if a != common:
                    lcols[v] = retype(a, v, common)
                    out_types[v] = common
                rcols[v] = retype(b, v, common)
                test = col(v).eqNullSafe(col(names[v])) if null_ok else col(v) == col(names[v])
            else:
                rcols[v] = retype(b, v, common)
                mine = retype(a, v, common)
                test = mine.eqNullSafe(col(names[v])) if null_ok else mine == col(names[v])
                if len(a) > 1 or len(common) > 1:
                    test = test & (mine.isNotNull() | F.lit(null_ok) & col(v).isNull())
        condition = test if condition is None else condition & test
    ldf = left.df
    for v, c in lcols.items():
        ldf = ldf.withColumn(v, c)
        if how == "inner" and v not in left.maybe:
            ldf = ldf.where(col(v).isNotNull())
    keep = [col(c) for c in right.df.columns if c not in shared and not (c.startswith(KEY) and c[len(KEY) :] in shared)]
    keep += [rcols[v].alias(names[v]) for v in shared if rcols[v] is not None] + [col(KEY + v).alias(f"__rk_{v}") for v in keyed]
    rdf = right.df.select(*keep)
    return Solutions(ldf, out_types, set(left.maybe), dict(left.keys)), rdf, condition, [names[v] for v in shared if v not in keyed] + [f"__rk_{v}" for v in keyed], possible


def _in_blocks(ldf: DataFrame, rdf: DataFrame, lkeys: list[str], rkeys: list[str], lof: str, rof: str) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of a join in which a key can have many rows on either, made ready so that its pairs are shared out: a key's
    rows are cut into blocks, and each block of one side meets each of the other in a group of its own. What a key costs is
    copies of its rows, at most two in ``BLOCK`` of its pairs; a key within a block on both sides is left as it is."""
    spark = ldf.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def blocks(df: DataFrame, keys: list[str], side: str) -> DataFrame:
        # at most one row in BLOCK of the side's
        named = [col(k).alias(f"__{side}{i}") for i, k in enumerate(keys)]
        return F.broadcast(df.groupBy(*named).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"__{side}n")).where(F.col(f"__{side}n") > 1))

    def placed(df: DataFrame, keys: list[str], of: str, own: str, other: str, name: str) -> DataFrame:
        names = df.columns
        for side, by in (("x", lkeys), ("y", rkeys)):
            test = F.lit(True)
            for i, k in enumerate(keys):
                test = test & (col(k) == F.col(f"__{side}{i}"))
            df = df.join(blocks(ldf if side == "x" else rdf, by, side), test, "left")
        some = lambda side: F.coalesce(f"__{side}n", F.lit(1))
        block = {own: F.pmod(F.xxhash64(col(of)), some(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), some(other) - 1))}
        df = df.select(*[col(c) for c in names], *[block[side].alias(name + side) for side in "xy"])
        return df.repartition(tasks, *[col(k) for k in keys], name + "x", name + "y")

    left, right = placed(ldf, lkeys, lof, "x", "y", "__lb"), placed(rdf, rkeys, rof, "y", "x", "__rb")
    return left, right.hint("merge"), (F.col("__lbx") == F.col("__rbx")) & (F.col("__lby") == F.col("__rby"))


def join(left: Solutions, right: Solutions, how: str = "inner", extra: Callable[[dict], Column] | None = None) -> Solutions:
    """Equi-join on every shared variable; unbound equals unbound only. ``extra`` makes a further condition from the types
    of both sides. Without a shared variable it is a product, and Spark plans it as one."""
    lefted, rdf, condition, gone, possible = _match(left, right, how)
    types = dict(lefted.types) | {v: t for v, t in right.types.items() if v not in left.types}
    spark = left.df.sparkSession
    if extra is not None:
        more = extra(types)
        condition = more if condition is None else condition & more
    if not possible:
        condition = F.lit(False)
        if how == "inner":
            return empty(spark, types)
    shared = set(left.types) & set(right.types)
    if how == "inner" and shared and left.of and right.of and not {left.of, right.of} & shared and not shared & (left.maybe | right.maybe):
        order = sorted(shared)
        lkeys, rkeys = zip(*[(KEY + v, f"__rk_{v}") if f"__rk_{v}" in gone else (v, f"__r_{v}") for v in order])
        lefted.df, rdf, same = _in_blocks(lefted.df, rdf, list(lkeys), list(rkeys), *[KEY + s.of if s.of in s.keys else s.of for s in (left, right)])
        condition, gone = condition & same, [*gone, "__lbx", "__lby", "__rbx", "__rby"]
    if how in ("left_semi", "left_anti"):
        df = lefted.df.join(rdf, condition if condition is not None else F.lit(True), how)
        return Solutions(df, lefted.types, left.maybe, left.keys)
    if condition is None:
        df = lefted.df.crossJoin(rdf) if how == "inner" else lefted.df.join(rdf, F.lit(True), how)
    else:
        df = lefted.df.join(rdf, condition, how)
    df = df.drop(*gone)
    new = set(right.types) - set(left.types)
    maybe = set(left.maybe) | (set(right.maybe) & new) | (new if how == "left" else set())
    if how == "inner":  # a variable that one side always binds is bound
        maybe -= {v for v in left.types if v in right.types and not (v in left.maybe and v in right.maybe)}
    keys = dict(left.keys) | {v: k for v, k in right.keys.items() if v in new}
    of = (left.of if right.of in shared else right.of if left.of in shared else None) if how == "inner" else None
    return Solutions(df, types, maybe, keys, how == "inner" and (left.none or right.none), of)


def minus(left: Solutions, right: Solutions) -> Solutions:
    """Rows of ``left`` that agree with no row of ``right`` on what both bind; unbound never matches."""
    shared = [v for v in left.types if v in right.types]
    if not shared or any(not set(left.types[v]) & set(right.types[v]) for v in shared):
        return left
    bare = Solutions(right.df, {v: right.types[v] for v in shared}, set(), {v: k for v, k in right.keys.items() if v in shared})
    l2 = Solutions(left.df, left.types, set(), left.keys)
    bare.df = right.df.select(*[col(v) for v in shared], *[col(KEY + v) for v in bare.keys])
    out = join(l2, bare, "left_anti")
    return Solutions(out.df, left.types, left.maybe, left.keys)


def union(parts: list[Solutions]) -> Solutions:
    """All rows, with every variable of any part and all its types."""
    names = list(dict.fromkeys(v for p in parts for v in p.types))
    parts = [p for p in parts if not p.none] or parts[:1]
    types = {v: tuple(sorted({t for p in parts for t in p.types.get(v, ())})) for v in names}
    keys = {}
    for v, k in parts[0].keys.items():
        if all(p.keys.get(v) == k for p in parts):
            keys[v] = k
    df: DataFrame | None = None
    for p in parts:
        part = conform(Solutions(p.df, p.types, p.maybe, {v: p.keys[v] for v in keys}), types, keys=True)
        df = part if df is None else df.unionByName(part)
    maybe = {v for v in names if any(v in p.maybe or not p.types.get(v) for p in parts)}
    return Solutions(df, types, maybe, keys, of=parts[0].of if len({p.of for p in parts}) == 1 else None)


def project(s: Solutions, names: list[str], strict: bool = False) -> Solutions:
    if strict:
        missing = [v for v in names if v not in s.types]
        if missing:
            from ..terms import GraphError

            raise GraphError(f"variables that the pattern doesn't bind: {missing}")
    types = {v: s.types.get(v, ()) for v in names}
    keys = {v: k for v, k in s.keys.items() if v in types}
    df = s.df.select(*[col(v) if s.types.get(v) else F.lit(None).cast("boolean").alias(v) for v in names], *[col(KEY + v) for v in keys])
    return Solutions(df, types, {v for v in names if v in s.maybe or v not in s.types}, keys, s.none)


def plain(s: Solutions) -> Solutions:
    """Without raw keys."""
    return Solutions(s.df.select(*[col(v) for v in s.types]), s.types, s.maybe) if s.keys else s


def distinct(s: Solutions) -> Solutions:
    """Rows are told apart by the raw key where an IRI has one: its text follows from it."""
    names = [KEY + v if v in s.keys else v for v in s.types]
    if not s.keys:
        return Solutions(s.df.distinct(), s.types, s.maybe)
    df = s.df.select(*[col(n) for n in names]).distinct()
    return Solutions(with_iris(df, s.keys).select(*[col(v) for v in s.types], *[col(KEY + v) for v in s.keys]), s.types, s.maybe, s.keys)


def with_iris(df: DataFrame, keys: dict[str, tuple[str, str]]) -> DataFrame:
    for v, (prefix, _) in keys.items():
        df = df.withColumn(v, F.concat(F.lit(prefix), col(KEY + v).cast("string")))
    return df


def extend(s: Solutions, var: str, value: Value) -> Solutions:
    """Bind a variable; where it has a value already, only rows that agree stay."""
    if var in s.types:
        from ..functions.expressions import equal

        same = equal(read(var, s.types[var]) if s.types[var] else {}, value)
        return Solutions(s.df.where(same), s.types, s.maybe, s.keys)
    c, types = pack(value)
    return Solutions(s.df.withColumn(var, c), {**s.types, var: types}, s.maybe | {var}, s.keys, s.none)


def sort_keys(value: Value, ascending: bool) -> list[Column]:
    """Unbound, then IRIs, blank nodes and literals by their datatype's IRI; within a type by value."""
    types = by_kind(value)
    keys = []
    if len(types) > 1:
        rank = F.lit(0)
        for i, t in enumerate(types, 1):
            rank = F.when(value[t].isNotNull(), i).otherwise(rank)
        keys.append(rank)
    keys += [value[t] for t in types]
    return [k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys]


def compact_types(s: Solutions) -> Solutions:
    """Drop the types that no row has: one aggregate over the rows."""
    multi = {v: t for v, t in s.types.items() if len(t) > 1}
    if not multi:
        return s
    tests = [F.max(read(v, ts)[t].isNotNull()).alias(f"{i}_{j}") for i, (v, ts) in enumerate(multi.items()) for j, t in enumerate(ts)]
    seen = s.df.agg(*tests).first()
    types = dict(s.types)
    for i, (v, ts) in enumerate(multi.items()):
        types[v] = tuple(t for j, t in enumerate(ts) if seen[f"{i}_{j}"]) or ts[:1]
    return Solutions(conform(s, types), types, s.maybe)


