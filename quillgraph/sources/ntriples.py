"""N-Triples: read and written by all executors, in DataFrame functions only."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import read
from ..scratch import materialise
from ..terms import BLANK_T, IRI_T, LANGSTRING, STRING, TYPED, GraphError, lexical, parse_lexical

_CODE = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
# possessive loops: they take texts of any length without recursion
_IRI = rf'<([^\x00-\x20<>"{{}}|^`\\]*+(?:(?:{_CODE})[^\x00-\x20<>"{{}}|^`\\]*+)*+)>'
_TEXT = rf"""((?:[^"\\\r\n]++|\\[tbnrf"'\\]|{_CODE})*+)"""
_BLANK = r"_:([^\s<>\".]++(?:\.++[^\s<>\".]++)*+)"
_LINE = rf'^\x{{FEFF}}?[ \t]*(?:{_IRI}|{_BLANK})[ \t]*{_IRI}[ \t]*(?:{_IRI}|{_BLANK}|"{_TEXT}"(?:@([A-Za-z]++(?:-[A-Za-z0-9]++)*+)|\^\^{_IRI})?)[ \t]*\.[ \t]*(?:#.*)?$'
_NOTHING = r"^\x{FEFF}?\s*(#.*)?$"
#: The groups of a triple's line between line breaks, which none of them can hold.
_GROUPS = "".join(f"\n${i}" for i in range(1, 9)) + "\n"
#: Types whose terms are equal only if their texts are.
_AS_TEXT = (IRI_T, BLANK_T, STRING, LANGSTRING)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _eased(c: Column) -> Column:
    """The commonest escapes of a text without line breaks replaced; a carriage return and a stand for a backslash until all
    others are read. Null where there are none."""
    pairs = (("\\\\", "\ra"), ("\\n", "\n"), ('\\"', '"'))
    eased = c
    for a, b in pairs:
        eased = F.replace(eased, F.lit(a), F.lit(b))
    return F.when(c.contains("\\"), eased)


def unescaped(c: Column, eased: Column | None = None) -> Column:
    """Backslash escapes of a text without line breaks, each read once from left to right: most are replaced in turn, texts with
    codes are taken apart. ``eased`` is a column that holds ``_eased(c)``, which is read several times."""
    eased = _eased(c) if eased is None else eased

    def one(x: Column) -> Column:
        of = F.create_map(*[F.lit(v) for kv in _PLAIN.items() for v in kv])
        code = F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
        return F.when(~x.startswith("\\"), x).when(F.substring(x, 2, 1).isin("u", "U"), code).otherwise(of[F.substring(x, 2, 1)])

    parts = F.regexp_extract_all(c, F.lit(rf"([^\\]++|{_CODE}|\\.)"), F.lit(1))
    quick = F.replace(eased, F.lit("\\r"), F.lit("\rb"))
    for k in "tbf'":
        quick = F.replace(quick, F.lit("\\" + k), F.lit(_PLAIN[k]))
    quick = F.replace(F.replace(quick, F.lit("\ra"), F.lit("\\")), F.lit("\rb"), F.lit("\r"))
    coded = eased.contains("\\u") | eased.contains("\\U")
    return F.when(eased.isNull(), c).when(~eased.contains("\\"), F.replace(eased, F.lit("\ra"), F.lit("\\"))).when(coded, F.array_join(F.transform(parts, one), "")).otherwise(quick)


def parse(lines: DataFrame, blank_suffix: str) -> DataFrame:
    """(st, s, p, ot, o, lang, bad, ill) from (value): subject and object with their types. Of a line that is no triple
    ``bad`` is the line, of one whose literal is no value of its datatype ``ill``; empty lines and comments are left out."""
    part = lambda i: F.col("parts")[i]
    some = lambda c: F.when(c != "", c)
    right = F.size("parts") == 10
    once = F.split(F.regexp_replace("value", _LINE, _GROUPS), "\n")  # the line is matched once; where it doesn't, it stays
    raw = lines.where(F.col("value").startswith("<") | ~F.col("value").rlike(_NOTHING)).select("value", once.alias("parts")).select(
        *[F.when(right, some(part(i))).alias(c) for i, c in ((1, "si"), (2, "sb"), (3, "p"), (4, "oi"), (5, "ob"), (7, "lang"), (8, "dt"))],
        F.when(right, part(6)).alias("text"), F.when(~right, F.col("value")).alias("bad"), "value",
    ).withColumn("eased", _eased(F.col("text")))
    label = lambda c: F.concat(F.col(c), F.lit(blank_suffix))
    out = raw.select(
        F.when(F.col("si").isNotNull(), IRI_T).when(F.col("sb").isNotNull(), BLANK_T).alias("st"),
        F.coalesce(unescaped(F.col("si")), label("sb")).alias("s"),
        unescaped(F.col("p")).alias("p"),
        F.when(F.col("bad").isNull(), F.when(F.col("oi").isNotNull(), IRI_T).when(F.col("ob").isNotNull(), BLANK_T).when(F.col("lang").isNotNull(), LANGSTRING).otherwise(F.coalesce(unescaped(F.col("dt")), F.lit(STRING)))).alias("ot"),
        F.coalesce(unescaped(F.col("oi")), label("ob"), unescaped(F.col("text"), F.col("eased"))).alias("o"),
        "lang", "bad", "value",
    )
    ill = F.lit(False)
    for t in TYPED:
        ill = F.when(F.col("ot") == t, parse_lexical(F.col("o"), t).isNull()).otherwise(ill)
    return out.withColumn("ill", F.when(ill, F.col("value"))).drop("value")


def read_ntriples(spark: SparkSession, path: str, blank_suffix: str, checked: bool = True) -> list[tuple[tuple[str, str, str], DataFrame, bool]]:
    """((predicate, subject type, object type), rows, whether no row is known to be there twice) of a file or folder. The text
    is read once, and each task's lines are kept sorted by those three so that each table reads its own pages."""
    return split(parse(spark.read.text(path), blank_suffix), checked)


def split(parsed: DataFrame, checked: bool = True) -> list[tuple[tuple[str, str, str], DataFrame, bool]]:
    """A line that is no triple is an error; unless ``checked``, it is left out. Literals that are no value of their
    datatype are left out with a warning. Whether a table has a row twice
    is told by hashes, so that whole texts are moved only where some are equal."""
    hashed = parsed.withColumn("hash", F.xxhash64("p", "st", "ot", "s", "o", "lang"))
    kept = materialise(hashed.sortWithinPartitions("p", "st", "ot"))  # where they are: no text is moved, or parsed for a sample
    many = [f(c).alias(f"{k}_{c}") for c in ("bad", "ill") for k, f in (("n", F.count), ("some", lambda c: F.min(F.substring(c, 1, 200))))]
    found = kept.groupBy("p", "st", "ot").agg(*many, F.count_if(F.isnull("bad") & F.isnull("ill")).alias("good")).collect()  # a row per predicate and types
    for c, says in (("bad", "lines are no triple"), ("ill", "literals are no value of their datatype and are left out")):
        some = [r for r in found if r["n_" + c]]
        if some:
            message = f"{sum(r['n_' + c] for r in some)} {says}, such as {some[0]['some_' + c]!r}"
            if c == "bad" and checked:
                raise GraphError(message)
            warnings.warn(message, stacklevel=2)
    twice = kept.where(F.isnull("bad") & F.isnull("ill")).groupBy("hash").count().where("count > 1").select("hash")
    again = {tuple(r) for r in kept.join(twice, "hash", "left_semi").select("p", "st", "ot").distinct().collect()} if twice.take(1) else set()
    out = []
    for r in found:
        if not r["good"]:
            continue
        mine = kept.where((F.col("p") == r["p"]) & (F.col("st") == r["st"]) & (F.col("ot") == r["ot"]) & F.isnull("bad") & F.isnull("ill"))
        o = F.struct(F.col("o").alias("value"), "lang") if r["ot"] == LANGSTRING else F.col("o") if r["ot"] in (IRI_T, BLANK_T) else parse_lexical(F.col("o"), r["ot"])
        key = (r["p"], r["st"], r["ot"])
        out.append((key, mine.select(F.col("s").alias("subject"), o.alias("object")), r["ot"] in _AS_TEXT and key not in again))
    return out


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def term_text(c: Column, t: str, plain_strings: bool = True) -> Column:
    """A native value as an N-Triples term."""
    if t == IRI_T:
        return F.concat(F.lit("<"), c, F.lit(">"))
    if t == BLANK_T:
        return F.concat(F.lit("_:"), c)
    if t == LANGSTRING:
        return F.concat(F.lit('"'), escaped(c.getField("value")), F.lit('"@'), c.getField("lang"))
    quoted = F.concat(F.lit('"'), escaped(lexical(c, t)), F.lit('"'))
    return quoted if t == STRING and plain_strings else F.concat(quoted, F.lit(f"^^<{t}>"))


def value_text(name: str, types: tuple[str, ...]) -> Column:
    return F.coalesce(*[term_text(c, t) for t, c in read(name, types).items()])


def triple_lines(subject_type: str, predicate: str, object_type: str, df: DataFrame) -> DataFrame:
    line = F.concat(term_text(F.col("subject"), subject_type), F.lit(f" <{predicate}> "), term_text(F.col("object"), object_type), F.lit(" ."))
    return df.select(line.alias("value"))
