"""Expressions -> values of Spark columns. Everything here is declarative: no action, and no Python on the executors but
for user-defined functions."""

from __future__ import annotations

import re
import uuid as _uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.algebra import Call, Exists
from ..terms import (
    BLANK_T, BOOLEAN, DATE, DATETIMESTAMP, DECIMAL, DOUBLE, INTEGER, INTEGERS, IRI, IRI_T, LANGSTRING, NUMERIC, STRING, TEMPORAL, UINT,
    XSD, BlankNode, GraphError, Literal, Variable, is_literal, native, parse_lexical, promote, term_column, term_type,
)
from .values import Value, boolean, bound, cast, map_string, numbers, pack, read, string, strings, text, unify


@dataclass
class Scope:
    """What an expression may refer to."""

    types: dict[str, tuple[str, ...]]
    udfs: dict[str, Any]
    exists: Callable[[Exists], Value] | None = None
    prefix: str = ""  # of the columns that hold the variables

    def variable(self, name: str) -> Value:
        types = self.types.get(name)
        if types is None:
            raise GraphError(f"variable ?{name} is not in scope")
        return read(self.prefix + name, types) if types else {}


def evaluate(e: Any, scope: Scope) -> Value:
    if isinstance(e, Variable):
        return scope.variable(e.name)
    if isinstance(e, IRI | Literal | BlankNode):
        return {term_type(e): term_column(e)}
    if isinstance(e, Exists):
        if scope.exists is None:
            raise GraphError("EXISTS can't stand here")
        return scope.exists(e)
    if not isinstance(e, Call):
        raise GraphError(f"can't evaluate {e!r}")
    if e.name == "BOUND":
        return _bool(bound(evaluate(e.args[0], scope)))
    if e.name in _OPERATORS:
        return _OPERATORS[e.name](e.args, scope)
    if e.name in _FUNCTIONS:
        low, high, f = _FUNCTIONS[e.name]
        if not low <= len(e.args) <= high:
            raise GraphError(f"{e.name} takes {low}{f' to {high}' if high > low else ''} arguments, not {len(e.args)}")
        return f(e.args, scope)
    if e.name in scope.udfs:
        return scope.udfs[e.name].apply(e.args, scope)
    if e.name.startswith(XSD):
        if len(e.args) != 1:
            raise GraphError(f"a cast takes 1 argument, not {len(e.args)}")
        return {e.name: cast(evaluate(e.args[0], scope), e.name)}
    local = re.split("[#/]", e.name)[-1]
    if local in _CUSTOM:
        return _CUSTOM[local](e.args, scope)
    raise GraphError(f"unknown function {e.name}")


def _bool(c: Column) -> Value:
    return {BOOLEAN: c}


# operators
def equal(a: Value, b: Value) -> Column:
    """Exact-type equality: values of unlike types differ; null only where a side is unbound."""
    if not a or not b:
        return F.lit(None).cast("boolean")
    same = [F.coalesce(a[t] == b[t], F.lit(False)) for t in a if t in b]
    out = F.lit(False) if not same else same[0]
    for s in same[1:]:
        out = out | s
    return out


_KINDS = (set(NUMERIC), {STRING}, {BOOLEAN}, {*TEMPORAL, DATE})


def compare(op: str, a: Value, b: Value) -> Column:
    """< <= > >= over compatible pairs of types; null for all others."""
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    parts = [test(x, y) for t, x in a.items() for u, y in b.items() if t == u and t in (*NUMERIC, STRING, BOOLEAN, DATE, *TEMPORAL) or any(t in k and u in k for k in _KINDS)]
    return F.coalesce(*parts) if parts else F.lit(None).cast("boolean")


def _logic(op):
    def f(args, scope):
        a, b = (boolean(evaluate(x, scope)) for x in args)
        return _bool(a | b if op == "||" else a & b)

    return f


def _in(args, scope):
    a = evaluate(args[0], scope)
    if all(isinstance(x, IRI | Literal) for x in args[1:]) and len(a) == 1:
        t = next(iter(a))
        alike = [term_column(x) for x in args[1:] if term_type(x) == t]
        return _bool(F.coalesce(a[t].isin(*alike), F.lit(False)) if alike and t != LANGSTRING else _any(equal(a, evaluate(x, scope)) for x in args[1:]))
    return _bool(_any(equal(a, evaluate(x, scope)) for x in args[1:]))


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _arithmetic(op):
    def f(args, scope):
        a, b = (numbers(evaluate(x, scope)) for x in args)
        out: dict[str, list[Column]] = {}
        for t, x in a.items():
            for u, y in b.items():
                r = DOUBLE if op == "/" else promote(t, u)
                kind = native(r)
                if op == "/":
                    c = F.try_divide(x.cast("double"), y.cast("double"))
                else:
                    wide = T.DecimalType(38, 12) if r == DECIMAL else T.LongType() if r in INTEGERS else kind
                    g = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
                    c = g(x.cast(wide), y.cast(wide)).try_cast(kind)
                out.setdefault(r, []).append(c)
        return {t: F.coalesce(*cs) for t, cs in out.items()}

    return f


def _per_number(f):
    return lambda args, scope: {t: f(c).cast(native(t)) for t, c in numbers(evaluate(args[0], scope)).items()}


def _if(args, scope):
    test = boolean(evaluate(args[0], scope))
    a, b = evaluate(args[1], scope), evaluate(args[2], scope)
    return unify([a, b], lambda cs, t: F.when(test, cs[0]).when(~test, cs[1]))


def _coalesce(args, scope):
    values = [evaluate(x, scope) for x in args]
    out: dict[str, Column] = {}
    for t in sorted({t for v in values for t in v}):
        c = F.lit(None).cast(native(t))
        for v in reversed(values):  # the first value that is bound
            c = F.when(bound(v), v.get(t, F.lit(None).cast(native(t)))).otherwise(c)
        out[t] = c
    return out


_OPERATORS = {
    "||": _logic("||"),
    "&&": _logic("&&"),
    "!": lambda a, s: _bool(~boolean(evaluate(a[0], s))),
    "=": lambda a, s: _bool(equal(evaluate(a[0], s), evaluate(a[1], s))),
    "SAMETERM": lambda a, s: _bool(equal(evaluate(a[0], s), evaluate(a[1], s))),
    **{op: (lambda op: lambda a, s: _bool(compare(op, evaluate(a[0], s), evaluate(a[1], s))))(op) for op in ("<", "<=", ">", ">=")},
    "IN": _in,
    **{op: _arithmetic(op) for op in "+-*/"},
    "NEG": _per_number(lambda c: -c),
    "IF": _if,
    "COALESCE": _coalesce,
}


# functions
def _text(a, s) -> Column:
    return text(evaluate(a, s))


def _string(a, s) -> Column:
    return string(evaluate(a, s))


def _lang(args, scope):
    v = evaluate(args[0], scope)
    parts = [c.getField("lang") if t == LANGSTRING else F.when(c.isNotNull(), F.lit("")) for t, c in v.items() if is_literal(t)]
    return {STRING: F.coalesce(*parts) if parts else F.lit(None).cast("string")}


def _langmatches(args, scope):
    tag, wanted = F.lower(_string(args[0], scope)), F.lower(_string(args[1], scope))
    return _bool(F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))))


def _datatype(args, scope):
    parts = [F.when(c.isNotNull(), F.lit(t)) for t, c in evaluate(args[0], scope).items() if is_literal(t)]
    return {IRI_T: F.coalesce(*parts) if parts else F.lit(None).cast("string")}


def _iri(args, scope):
    parts = [c for t, c in evaluate(args[0], scope).items() if t in (IRI_T, STRING)]
    return {IRI_T: F.coalesce(*parts) if parts else F.lit(None).cast("string")}


def _strdt(args, scope):
    if not isinstance(args[1], IRI):
        raise GraphError("the second argument of STRDT must be an IRI")
    return {args[1].iri: parse_lexical(_string(args[0], scope), args[1].iri)}


def _strlang(args, scope):
    value, lang = _string(args[0], scope), _string(args[1], scope)
    return {LANGSTRING: F.when(value.isNotNull() & lang.isNotNull(), F.struct(value.alias("value"), lang.alias("lang")))}


def _substr(args, scope):
    v = evaluate(args[0], scope)
    number = lambda a: F.coalesce(*[c for c in numbers(evaluate(a, scope)).values()]).cast("int")
    start = number(args[1])
    length = number(args[2]) if len(args) > 2 else F.lit(2**31 - 1)
    return map_string(v, lambda c: F.substring(c, start, length))


def _concat(args, scope):
    values = [evaluate(a, scope) for a in args]
    joined = F.concat_ws("", *[string(v) for v in values])
    tagged = [v for v in values if strings(v)]
    if tagged and all(set(strings(v)) == {LANGSTRING} for v in tagged):
        return {LANGSTRING: F.struct(joined.alias("value"), F.coalesce(*[v[LANGSTRING].getField("lang") for v in tagged]).alias("lang"))}
    if not any(LANGSTRING in v for v in tagged):
        return {STRING: joined}
    plain = _any(F.coalesce(v[STRING].isNotNull(), F.lit(False)) for v in tagged if STRING in v)
    tags = F.coalesce(*[v[LANGSTRING].getField("lang") for v in tagged if LANGSTRING in v])
    keep = ~plain & tags.isNotNull()
    return {STRING: F.when(~keep, joined), LANGSTRING: F.when(keep, F.struct(joined.alias("value"), tags.alias("lang")))}


def _two_strings(f):
    return lambda args, scope: _bool(f(_string(args[0], scope), _string(args[1], scope)))


def _before(args, scope):
    """The whole string where the second doesn't occur."""
    x = _string(args[1], scope)
    at = lambda c: F.position(x, c)
    return map_string(evaluate(args[0], scope), lambda c: F.when(at(c) > 0, F.substring(c, F.lit(1), at(c) - 1)).otherwise(c))


def _after(args, scope):
    x = _string(args[1], scope)
    at = lambda c: F.position(x, c)
    return map_string(evaluate(args[0], scope), lambda c: F.when(at(c) > 0, F.substring(c, at(c) + F.length(x), F.lit(2**31 - 1))).otherwise(c))


def _regex(args, scope):
    flags = f"(?{args[2].value})" if len(args) > 2 and isinstance(args[2], Literal) and args[2].value else ""
    if not isinstance(args[1], Literal):
        raise GraphError("a regular expression must be constant")
    return _bool(_string(args[0], scope).rlike(flags + args[1].value))


def _replace(args, scope):
    flags = f"(?{args[3].value})" if len(args) > 3 and isinstance(args[3], Literal) and args[3].value else ""
    if not isinstance(args[1], Literal):
        raise GraphError("a regular expression must be constant")
    return {STRING: F.regexp_replace(_string(args[0], scope), F.lit(flags + args[1].value), _string(args[2], scope))}


def _encode(args, scope):
    c = F.url_encode(_text(args[0], scope))
    for old, new in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return {STRING: c}


def _type_test(test):
    def f(args, scope):
        v = evaluate(args[0], scope)
        hit = bound({t: c for t, c in v.items() if test(t)})
        return _bool(F.when(bound(v), hit))

    return f


def _part(f):
    def g(args, scope):
        parts = [f(c).cast("long") for t, c in evaluate(args[0], scope).items() if t in TEMPORAL or t == DATE]
        return {UINT: F.coalesce(*parts) if parts else F.lit(None).cast("long")}

    return g


def _stamps(a, scope) -> Column:
    parts = [c for t, c in evaluate(a, scope).items() if t in TEMPORAL]
    return F.coalesce(*parts) if parts else F.lit(None).cast("timestamp")


def _whole(a, scope) -> Column:
    parts = [c.cast("long") for t, c in evaluate(a, scope).items() if t in INTEGERS]
    return F.coalesce(*parts) if parts else F.lit(None).cast("long")


def _zone(kind: str):
    def f(args, scope):
        c = _stamps(args[0], scope)
        return {(STRING if kind == "TZ" else XSD + "dayTimeDuration"): F.when(c.isNotNull(), F.lit("Z" if kind == "TZ" else "PT0S"))}

    return f


_FUNCTIONS: dict[str, tuple[int, int, Callable]] = {
    "STR": (1, 1, lambda a, s: {STRING: _text(a[0], s)}),
    "LANG": (1, 1, _lang),
    "LANGMATCHES": (2, 2, _langmatches),
    "DATATYPE": (1, 1, _datatype),
    "IRI": (1, 1, _iri),
    "BNODE": (0, 1, lambda a, s: {BLANK_T: F.concat(F.lit("b"), _string(a[0], s)) if a else F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-"), F.lit("")))}),
    "RAND": (0, 0, lambda a, s: {DOUBLE: F.rand()}),
    "ABS": (1, 1, _per_number(F.abs)),
    "CEIL": (1, 1, _per_number(lambda c: F.ceil(c))),
    "FLOOR": (1, 1, _per_number(lambda c: F.floor(c))),
    "ROUND": (1, 1, _per_number(lambda c: F.round(c, 0))),
    "CONCAT": (2, 999, _concat),
    "STRLEN": (1, 1, lambda a, s: {INTEGER: F.length(_text(a[0], s)).cast("long")}),
    "UCASE": (1, 1, lambda a, s: map_string(evaluate(a[0], s), F.upper)),
    "LCASE": (1, 1, lambda a, s: map_string(evaluate(a[0], s), F.lower)),
    "ENCODE_FOR_URI": (1, 1, _encode),
    "CONTAINS": (2, 2, _two_strings(lambda a, b: a.contains(b))),
    "STRSTARTS": (2, 2, _two_strings(lambda a, b: a.startswith(b))),
    "STRENDS": (2, 2, _two_strings(lambda a, b: a.endswith(b))),
    "STRBEFORE": (2, 2, _before),
    "STRAFTER": (2, 2, _after),
    "YEAR": (1, 1, _part(F.year)),
    "MONTH": (1, 1, _part(F.month)),
    "DAY": (1, 1, _part(F.dayofmonth)),
    "HOURS": (1, 1, _part(F.hour)),
    "MINUTES": (1, 1, _part(F.minute)),
    "SECONDS": (1, 1, _part(F.second)),
    "TIMEZONE": (1, 1, _zone("TIMEZONE")),
    "TZ": (1, 1, _zone("TZ")),
    "NOW": (0, 0, lambda a, s: {DATETIMESTAMP: F.current_timestamp()}),
    "UUID": (0, 0, lambda a, s: {IRI_T: F.concat(F.lit("urn:uuid:"), F.uuid())}),
    "STRUUID": (0, 0, lambda a, s: {STRING: F.uuid()}),
    "MD5": (1, 1, lambda a, s: {STRING: F.md5(_text(a[0], s).cast("binary"))}),
    "SHA1": (1, 1, lambda a, s: {STRING: F.sha1(_text(a[0], s).cast("binary"))}),
    **{f"SHA{n}": (1, 1, (lambda n: lambda a, s: {STRING: F.sha2(_text(a[0], s).cast("binary"), n)})(n)) for n in (256, 384, 512)},
    "STRLANG": (2, 2, _strlang),
    "STRDT": (2, 2, _strdt),
    "ISIRI": (1, 1, _type_test(lambda t: t == IRI_T)),
    "ISBLANK": (1, 1, _type_test(lambda t: t == BLANK_T)),
    "ISLITERAL": (1, 1, _type_test(is_literal)),
    "ISNUMERIC": (1, 1, _type_test(lambda t: t in NUMERIC)),
    "REGEX": (2, 3, _regex),
    "SUBSTR": (2, 3, _substr),
    "REPLACE": (3, 4, _replace),
}


def _modulus(args, scope):
    return {INTEGER: F.try_mod(_whole(args[0], scope), _whole(args[1], scope))}


def _floor_time(args, scope):
    seconds, n = F.unix_seconds(_stamps(args[0], scope).cast("timestamp")), _whole(args[1], scope)
    return {DATETIMESTAMP: F.timestamp_seconds(seconds - F.pmod(seconds, n))}


def _uuid5(as_iri: bool):
    """Version 5 of a namespace (dns, oid, url, x500 or a UUID) and a name, from SHA-1 and bit masks in the JVM."""

    def f(args, scope):
        space = args[0]
        if not isinstance(space, Literal | IRI):
            raise GraphError("the namespace of a version 5 UUID must be constant")
        known = {"dns": _uuid.NAMESPACE_DNS, "oid": _uuid.NAMESPACE_OID, "url": _uuid.NAMESPACE_URL, "x500": _uuid.NAMESPACE_X500}
        name = space.value if isinstance(space, Literal) else space.iri
        try:
            ns = known.get(name.lower()) or _uuid.UUID(name)
        except ValueError as e:
            raise GraphError(f"{name!r} is no UUID namespace") from e
        h = F.sha1(F.concat(F.unhex(F.lit(ns.bytes.hex())), _text(args[1], scope).cast("binary")))
        variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
        u = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
        return {IRI_T: F.concat(F.lit("urn:uuid:"), u)} if as_iri else {STRING: u}

    return f


#: Custom functions, by the local part of their IRI.
_CUSTOM = {
    "DateTimeAsMicros": lambda a, s: {INTEGER: F.unix_micros(_stamps(a[0], s).cast("timestamp"))},
    "DateTimeAsSeconds": lambda a, s: {INTEGER: F.unix_seconds(_stamps(a[0], s).cast("timestamp"))},
    "MicrosAsDateTime": lambda a, s: {DATETIMESTAMP: F.timestamp_micros(_whole(a[0], s))},
    "SecondsAsDateTime": lambda a, s: {DATETIMESTAMP: F.timestamp_seconds(_whole(a[0], s))},
    "modulus": _modulus,
    "FloorDateTimeToSecondsInterval": _floor_time,
    "decodeString": lambda a, s: evaluate(a[0], s),
    "uuidv5": _uuid5(True),
    "struuidv5": _uuid5(False),
}


@dataclass
class UDF:
    """A vectorised function of pandas Series, one per argument, that returns a Series; it sees batches, so must be row-wise."""

    iri: str
    function: Callable
    output: str
    inputs: list[str] | None = None

    def apply(self, args: list[Any], scope: Scope) -> Value:
        columns = []
        for k, a in enumerate(args):
            v = evaluate(a, scope)
            if self.inputs:
                t = self.inputs[k]
                columns.append(v.get(t, F.lit(None).cast(native(t))))
            elif len(v) > 1:
                raise GraphError(f"argument {k} of {self.iri} has several types: name its input types")
            else:
                columns.append(pack(v)[0])
        f = F.pandas_udf(self.function, native(self.output))
        return {self.output: f(*columns)}
