"""RDF terms, their types, and how each type is held in a Spark column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
OTTR = "http://ns.ottr.xyz/0.4/"
FX = "http://sparql.xyz/facade-x/ns/"
XYZ = "http://sparql.xyz/facade-x/data/"
VOCAB = "https://quillgraph.example/vocab#"
DEFAULT_PREFIXES = {
    "rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL, "ottr": OTTR, "fx": FX, "xyz": XYZ, "sh": "http://www.w3.org/ns/shacl#",
    "def": "urn:quillgraph_default:", "foaf": "http://xmlns.com/foaf/0.1/", "skos": "http://www.w3.org/2004/02/skos/core#", "vocab": VOCAB,
}

#: Types of a column: an IRI, a blank node, or the datatype IRI of its literals.
IRI_T, BLANK_T = "I", "B"
STRING, BOOLEAN, INTEGER, LONG, INT, DOUBLE, FLOAT, DECIMAL = (XSD + x for x in ("string", "boolean", "integer", "long", "int", "double", "float", "decimal"))
DATETIME, DATETIMESTAMP, DATE, UINT, ULONG = (XSD + x for x in ("dateTime", "dateTimeStamp", "date", "unsignedInt", "unsignedLong"))
LANGSTRING = RDF + "langString"
TYPE = RDF + "type"

_LANG = T.StructType([T.StructField("value", T.StringType()), T.StructField("lang", T.StringType())])
_NATIVE: dict[str, T.DataType] = {
    BOOLEAN: T.BooleanType(), XSD + "byte": T.ByteType(), XSD + "short": T.ShortType(), INT: T.IntegerType(), LONG: T.LongType(), INTEGER: T.LongType(),
    XSD + "unsignedByte": T.ShortType(), XSD + "unsignedShort": T.IntegerType(), UINT: T.LongType(), ULONG: T.DecimalType(20, 0),
    FLOAT: T.FloatType(), DOUBLE: T.DoubleType(), DECIMAL: T.DecimalType(38, 12), DATETIME: T.TimestampType(), DATETIMESTAMP: T.TimestampType(),
    DATE: T.DateType(), LANGSTRING: _LANG,
}
#: Datatypes whose lexical forms are read into values.
TYPED = tuple(t for t in _NATIVE if t != LANGSTRING)
#: Width in bits of numbers; reals have None beside it.
INTEGERS = {XSD + "byte": 8, XSD + "short": 16, INT: 32, LONG: 64, INTEGER: 64, XSD + "unsignedByte": 8, XSD + "unsignedShort": 16, UINT: 32, ULONG: 64}
REALS = {FLOAT: 32, DOUBLE: 64, DECIMAL: 64}
NUMERIC = {**INTEGERS, **REALS}
TEMPORAL = {DATETIME, DATETIMESTAMP}


def native(t: str) -> T.DataType:
    """Strings hold IRIs, blank labels and every datatype that has no Spark type of its own."""
    return _NATIVE.get(t, T.StringType())


def is_literal(t: str) -> bool:
    return t not in (IRI_T, BLANK_T)


def literal_type_of(dtype: T.DataType) -> str:
    """The datatype of a DataFrame's column when it is mapped to literals."""
    if isinstance(dtype, T.DecimalType):
        return INTEGER if dtype.scale == 0 else DECIMAL
    if isinstance(dtype, T.StructType) and [f.name for f in dtype.fields] == ["value", "lang"]:
        return LANGSTRING
    if isinstance(dtype, T.DayTimeIntervalType):
        return XSD + "duration"
    table = {
        T.BooleanType: BOOLEAN, T.ByteType: XSD + "byte", T.ShortType: XSD + "short", T.IntegerType: INT, T.LongType: LONG, T.FloatType: FLOAT,
        T.DoubleType: DOUBLE, T.TimestampType: DATETIMESTAMP, T.TimestampNTZType: DATETIME, T.DateType: DATE,
    }
    return table.get(type(dtype), STRING)


def promote(a: str, b: str) -> str:
    """The type of an arithmetic result: the greater width; real if either is."""
    bits = max(NUMERIC[a], NUMERIC[b])
    if a in REALS or b in REALS:
        if bits == 32:
            return FLOAT
        return DECIMAL if DECIMAL in (a, b) and DOUBLE not in (a, b) else DOUBLE
    return {8: XSD + "byte", 16: XSD + "short", 32: INT, 64: LONG if LONG in (a, b) and INTEGER not in (a, b) else INTEGER}[bits]


def parse_lexical(text: Column, t: str) -> Column:
    """Native value of a lexical form; null where it is none."""
    kind = native(t)
    if isinstance(kind, T.StringType):
        return text
    if t == BOOLEAN:
        return F.when(text.isin("true", "false", "1", "0"), text.isin("true", "1"))
    if t in TEMPORAL:
        return F.try_to_timestamp(text)
    if t == DATE:
        return F.regexp_extract(text, r"^(-?\d{4}-\d\d-\d\d)(Z|[+-]\d\d:\d\d)?$", 1).try_cast("date")
    if t in INTEGERS:
        number = F.when(text.rlike(r"^[+-]?\d+$"), text).try_cast("decimal(38,0)")
        low = 0 if "unsigned" in t else -(2 ** (INTEGERS[t] - 1))
        high = 2 ** INTEGERS[t] - 1 if "unsigned" in t else 2 ** (INTEGERS[t] - 1) - 1
        wide = lambda n: F.lit(str(n)).cast("decimal(38,0)")
        return F.when(number.between(wide(low), wide(high)), number).try_cast(kind)
    special = F.when(text == "INF", F.lit("Infinity")).when(text == "-INF", F.lit("-Infinity")).otherwise(text)
    return special.try_cast(kind)


def lexical(value: Column, t: str) -> Column:
    """Lexical form of native values."""
    if t == LANGSTRING:
        return value.getField("value")
    if t in TEMPORAL:
        return _stamp(value)
    if t in (DOUBLE, FLOAT):
        return F.regexp_replace(F.regexp_replace(value.cast("string"), "^Infinity$", "INF"), "^-Infinity$", "-INF")
    if t == DECIMAL:
        trimmed = F.regexp_replace(value.cast("string"), r"0+$", "")
        return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
    return value.cast("string")


def _stamp(value: Column) -> Column:
    text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    short = F.when(text.endswith(".000000"), F.substring(text, 1, 19)).otherwise(text)
    return F.concat(short, F.lit("+00:00"))


@dataclass(frozen=True)
class IRI:
    iri: str

    def __str__(self) -> str:
        return f"<{self.iri}>"


@dataclass(frozen=True)
class BlankNode:
    name: str

    def __str__(self) -> str:
        return f"_:{self.name}"


@dataclass(frozen=True)
class Variable:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Literal:
    value: str
    data_type: str = STRING
    language: str | None = None

    def to_native(self):
        if self.data_type in INTEGERS:
            return int(self.value)
        if self.data_type in (DOUBLE, FLOAT):
            return float(self.value.replace("INF", "inf"))
        if self.data_type == BOOLEAN:
            return self.value == "true"
        return self.value

    def __str__(self) -> str:
        quoted = '"' + escape(self.value) + '"'
        if self.language:
            return f"{quoted}@{self.language}"
        return quoted if self.data_type == STRING else f"{quoted}^^<{self.data_type}>"


Term = IRI | BlankNode | Literal | Variable


@dataclass(frozen=True)
class Prefix:
    prefix: str
    iri: str

    def suf(self, suffix: str) -> IRI:
        return IRI(self.iri + suffix)


class RDFType:
    """Names for column types in the public interface."""

    IRI, BlankNode = IRI_T, BLANK_T

    @staticmethod
    def Literal(datatype: str | IRI) -> str:  # noqa: N802
        return datatype.iri if isinstance(datatype, IRI) else datatype

    @staticmethod
    def Multi(types: list[str]) -> tuple[str, ...]:  # noqa: N802
        return tuple(sorted(types))


class _Namespace:
    def __init__(self, base: str):
        self._base = base

    def __getattr__(self, name: str) -> IRI:
        if name.startswith("__"):
            raise AttributeError(name)
        return IRI(self._base + name.rstrip("_"))


xsd, rdf, rdfs, owl = _Namespace(XSD), _Namespace(RDF), _Namespace(RDFS), _Namespace(OWL)

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escape(text: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, i = [], 0
    plain = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            n = text[i + 1]
            size = {"u": 4, "U": 8}.get(n)
            if size:
                out.append(chr(int(text[i + 2 : i + 2 + size], 16)))
                i += 2 + size
                continue
            out.append(plain.get(n, n))
            i += 2
            continue
        out.append(c)
        i += 1
    return "".join(out)


def term_type(term: Term) -> str:
    if isinstance(term, IRI):
        return IRI_T
    if isinstance(term, BlankNode):
        return BLANK_T
    return LANGSTRING if term.language else term.data_type


def term_column(term: Term) -> Column:
    """A constant in native form; null where its lexical form is no value of its type."""
    if isinstance(term, IRI):
        return F.lit(term.iri)
    if isinstance(term, BlankNode):
        return F.lit(term.name)
    if term.language:
        return F.struct(F.lit(term.value).alias("value"), F.lit(term.language).alias("lang"))
    t = term.data_type
    if t in INTEGERS and term.value.lstrip("+-").isdigit():
        low, high = (0, 2 ** INTEGERS[t] - 1) if "unsigned" in t else (-(2 ** (INTEGERS[t] - 1)), 2 ** (INTEGERS[t] - 1) - 1)
        value = int(term.value)
        return F.lit(value if low <= value <= high else None).cast(native(t))
    if t in (DOUBLE, FLOAT):
        return F.lit(float(term.value.replace("INF", "inf"))).cast(native(t))
    return parse_lexical(F.lit(term.value), t)


class GraphError(Exception):
    """Raised for anything wrong with a query, a template or the data given to them."""


@dataclass
class Solutions:
    """Query rows: a DataFrame whose columns are variables, the types each may have, and those that may be unbound.

    A variable of one type is a plain column; one of several is a struct with a field per type of which at most one is not
    null. ``keys`` says how an IRI column was made: (prefix, raw column) lets joins and filters use the raw key. ``of`` is the
    variable that rows are about: the subject of a scan, with or without what others add by their own subject.
    """

    df: object
    types: dict[str, tuple[str, ...]]
    maybe: set[str] = field(default_factory=set)
    keys: dict[str, tuple[str, str]] = field(default_factory=dict)
    none: bool = False  # no table can give it a row
    of: str | None = None
