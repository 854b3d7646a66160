"""An expression's value: one nullable Column per type it may have, at most one of them not null in a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import BLANK_T, BOOLEAN, IRI_T, LANGSTRING, NUMERIC, STRING, is_literal, lexical, native, parse_lexical

Value = dict[str, Column]


def unbound() -> Value:
    return {}


def read(name: str, types: tuple[str, ...]) -> Value:
    """The value of a variable's column."""
    column = F.col(f"`{name}`")
    return {types[0]: column} if len(types) == 1 else {t: column.getField(t) for t in types}


def pack(value: Value) -> tuple[Column, tuple[str, ...]]:
    """One column from a value, and its types in order."""
    types = tuple(sorted(value))
    if not types:
        return F.lit(None).cast("boolean"), ()
    if len(types) == 1:
        return value[types[0]], types
    return F.when(bound(value), F.struct(*[value[t].cast(native(t)).alias(t) for t in types])), types


def by_kind(value: Value) -> list[str]:
    """The types in the order of values of several kinds: IRIs, blank nodes, literals by their datatype's IRI."""
    order = {IRI_T: (0, ""), BLANK_T: (1, "")}
    return sorted(value, key=lambda t: order.get(t, (2, t)))


def bound(value: Value) -> Column:
    out = F.lit(False)
    for c in value.values():
        out = c.isNotNull() if len(value) == 1 else out | c.isNotNull()
    return out


def boolean(value: Value) -> Column:
    """Effective boolean value; null where there is none."""
    parts = []
    for t, c in value.items():
        if t == BOOLEAN:
            parts.append(c)
        elif t == STRING:
            parts.append(F.length(c) > 0)
        elif t == LANGSTRING:
            parts.append(F.length(c.getField("value")) > 0)
        elif t in NUMERIC:
            parts.append((c != 0) & ~F.isnan(c.cast("double")))
    return F.coalesce(*parts) if parts else F.lit(None).cast("boolean")


def text(value: Value) -> Column:
    """STR() of a value: IRIs and literals; null for blank nodes."""
    parts = [lexical(c, t) for t, c in value.items() if t != BLANK_T]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def strings(value: Value) -> Value:
    return {t: c for t, c in value.items() if t in (STRING, LANGSTRING)}


def string(value: Value) -> Column:
    """The characters of plain and language-tagged strings; null for all else."""
    parts = [c if t == STRING else c.getField("value") for t, c in strings(value).items()]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def map_string(value: Value, f) -> Value:
    """Apply ``f`` to the characters; a language tag stays."""
    out: Value = {}
    for t, c in strings(value).items():
        if t == STRING:
            out[t] = f(c)
        else:
            v = f(c.getField("value"))
            out[t] = F.when(c.isNotNull() & v.isNotNull(), F.struct(v.alias("value"), c.getField("lang").alias("lang")))
    return out


def numbers(value: Value) -> Value:
    return {t: c for t, c in value.items() if t in NUMERIC}


def unify(values: list[Value], f) -> Value:
    """Per type, ``f`` over the columns of that type of every value (a typed null where one hasn't it)."""
    types = sorted({t for v in values for t in v})
    return {t: f([v.get(t, F.lit(None).cast(native(t))) for v in values], t) for t in types}


def cast(value: Value, target: str) -> Column:
    """xsd:...(x): null where a value can't be cast."""
    kind, parts = native(target), []
    for t, c in value.items():
        if t == BLANK_T or (t == IRI_T and target != STRING):
            continue
        if t in (STRING, LANGSTRING, IRI_T):
            s = c.getField("value") if t == LANGSTRING else c
            if target == BOOLEAN:
                parts.append(F.lower(s) == "true")
            elif target in NUMERIC:
                parts.append(parse_lexical(F.trim(s), target))
            else:
                parts.append(parse_lexical(s, target))
        elif native(target).simpleString() == "string":
            parts.append(lexical(c, t))
        elif t == BOOLEAN and target in NUMERIC:
            parts.append(c.cast("int").cast(kind))
        elif t in NUMERIC and target == BOOLEAN:
            parts.append(c != 0)
        elif (t in NUMERIC) != (target in NUMERIC) or not is_literal(t):
            continue
        else:
            parts.append(c.try_cast(kind))
    return F.coalesce(*parts) if parts else F.lit(None).cast(kind)
