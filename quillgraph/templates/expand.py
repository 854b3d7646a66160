"""Template expansion at planning time: each triple of the body becomes one select over the caller's table."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise
from ..terms import BLANK_T, DATE, DATETIME, DATETIMESTAMP, INTEGERS, IRI, IRI_T, NUMERIC, RDF, STRING, BlankNode, GraphError, Variable, literal_type_of, native, term_column, term_type
from .ast import TRIPLE, Library, Template, TypeList

_DEPTH = 100
ROW = "__row"


@dataclass
class Cell:
    """An argument: a column, its type (TypeList for a list), and the name of a table column if it is one as it stands."""

    column: Column
    type: Any
    constant: Any = None


@dataclass
class Rows:
    """Triples to be: rows of ``df`` with subject, predicate and object."""

    df: DataFrame
    subject: Cell
    predicate: Cell
    object: Cell


_IRI_PATTERN = r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>\"{}|^`\\]*$"


def constant(term: Any) -> Cell:
    if isinstance(term, list):
        items = [constant(t) for t in term]
        types = {c.type for c in items}
        if len(types) != 1:
            raise GraphError("a constant list holds several types")
        return Cell(F.array(*[c.column for c in items]), TypeList(types.pop()), tuple(term))
    if isinstance(term, BlankNode):
        return Cell(F.concat(F.lit(term.name + "_"), F.col(ROW).cast("string")), BLANK_T)
    return Cell(term_column(term), term_type(term), term)


def first_value(df: DataFrame, name: str, depth: int) -> str | None:
    c = F.col(f"`{name}`")
    for _ in range(depth):
        c = F.get(c, 0)
    row = df.select(c.alias("v")).where("v IS NOT NULL").first()
    return row[0] if row else None


def cell_of(df: DataFrame, name: str, want: Any, guess: bool = True) -> Cell:
    """The cell of a table column for a parameter of type ``want``; raises where the two can't agree."""
    dtype, c, depth = df.schema[name].dataType, F.col(f"`{name}`"), 0
    while isinstance(dtype, T.ArrayType):
        dtype, depth = dtype.elementType, depth + 1
    inner, layers = want, 0
    while isinstance(inner, TypeList):
        inner, layers = inner.of, layers + 1
    if want is not None and layers != depth and not (layers == 0 and inner is None):
        raise GraphError(f"column {name!r} {'is' if depth else 'is not'} a list, which its parameter does not allow")
    have = literal_type_of(dtype)
    if inner is None:
        kind = have
        if have == STRING and guess:
            value = first_value(df, name, depth)
            if value is not None and re.match(_IRI_PATTERN, value):
                kind = IRI_T
    elif inner in (IRI_T, BLANK_T):
        if have != STRING:
            raise GraphError(f"column {name!r} holds {have}, its parameter takes IRIs")
        kind = inner
    else:
        kind = inner
        narrow = inner in INTEGERS and have in INTEGERS and INTEGERS[have] <= INTEGERS[inner]
        dates = inner == DATE and have in (DATETIME, DATETIMESTAMP) or {inner, have} <= {DATETIME, DATETIMESTAMP}
        plain = have == STRING and native(inner).simpleString() == "string"
        wide = inner in NUMERIC and have in NUMERIC and inner not in INTEGERS
        if have != inner and not (narrow or dates or plain or wide):
            raise GraphError(f"column {name!r} holds {have}, its parameter takes {inner}")
        if have != inner and depth == 0 and not (dates and inner != DATE):
            c = c.cast(native(inner))
    kind_out: Any = kind
    for _ in range(depth):
        kind_out = TypeList(kind_out)
    return Cell(c, kind_out)


def bind(library: Library, template: Template, df: DataFrame, types: dict[str, str] | None = None, guess: bool = True) -> dict[str, Cell | None]:
    """Cells of the template's parameters from the columns of ``df`` by their names."""
    cells: dict[str, Cell | None] = {}
    names = {p.variable.name for p in template.parameters}
    unknown = set(df.columns) - names - {ROW}
    if unknown:
        raise GraphError(f"{template.iri} has no parameters {sorted(unknown)}")
    for p in template.parameters:
        n = p.variable.name
        want = (types or {}).get(n) or library.inferred.get((template.iri.iri, n))
        if n in df.columns:
            cell = cell_of(df, n, want, guess)
            if p.default_value is not None:
                cell = replace(cell, column=F.coalesce(cell.column, constant(p.default_value).column))
            cells[n] = cell
        elif p.default_value is not None:
            cells[n] = constant(p.default_value)
        elif p.optional:
            cells[n] = None
        else:
            raise GraphError(f"{template.iri} needs a column {n!r}")
    return cells


def check(template: Template, df: DataFrame, cells: dict[str, Cell | None], iris: bool) -> None:
    """One aggregate over the table: nulls where a parameter is mandatory, texts that are no IRIs. Raises with examples."""
    tests: list[Column] = []
    said: list[str] = []
    for p in template.parameters:
        cell = cells.get(p.variable.name)
        if cell is None or cell.constant is not None or p.variable.name not in df.columns:
            continue
        if not p.optional and p.default_value is None:
            tests += [F.count_if(cell.column.isNull()), F.lit(None).cast("array<string>")]
            said.append(f"{p.variable} is mandatory and has {{n}} nulls")
        if iris and cell.type == IRI_T:
            bad = ~cell.column.rlike(_IRI_PATTERN)
            tests += [F.count_if(bad), F.array_compact(F.array(F.min(F.when(bad, cell.column)), F.max(F.when(bad, cell.column))))]
            said.append(f"{p.variable} has {{n}} values that are no IRIs, such as {{x}}")
    if not tests:
        return
    row = df.agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)]).first()
    wrong = [s.format(n=row[2 * i], x=row[2 * i + 1]) for i, s in enumerate(said) if row[2 * i]]
    if wrong:
        raise GraphError(f"{template.iri}: " + "; ".join(wrong))


def expand(library: Library, template: Template, df: DataFrame, cells: dict[str, Cell | None], depth: int = 0) -> list[Rows]:
    if depth > _DEPTH:
        raise GraphError(f"templates call each other more than {_DEPTH} deep")
    if template.iri.iri == TRIPLE:
        s, p, o = (cells[n] for n in ("subject", "predicate", "object"))
        return [] if None in (s, p, o) else [Rows(df, s, p, o)]
    out: list[Rows] = []
    for n_inst, inst in enumerate(template.instances):
        callee = library.templates.get(inst.iri.iri)
        if callee is None:
            raise GraphError(f"{template.iri} calls {inst.iri}, which is not defined")
        args: list[Cell | None] = []
        marked: list[int] = []
        for k, a in enumerate(inst.arguments):
            if isinstance(a.term, Variable):
                cell = cells[a.term.name]
            else:
                cell = None if a.term is None else constant(a.term)
            args.append(cell)
            if a.list_expand and cell is not None:
                marked.append(k)
        rows, args = _explode(df, args, marked, inst.list_expander, f"__x{depth}_{n_inst}_")
        inner: dict[str, Cell | None] = {}
        skip = False
        for p, cell in zip(callee.parameters, args):
            if p.default_value is not None:
                default = constant(p.default_value)
                cell = default if cell is None else replace(cell, column=F.coalesce(cell.column, default.column), constant=None)
            if cell is None and not p.optional:
                skip = True
            inner[p.variable.name] = cell
        if not skip:
            out += expand(library, callee, rows, inner, depth + 1)
    return out


def _explode(df: DataFrame, args: list[Cell | None], marked: list[int], how: str | None, mark: str) -> tuple[DataFrame, list[Cell | None]]:
    if not marked:
        return df, args
    for k in marked:
        if not isinstance(args[k].type, TypeList):
            raise GraphError("only a list can be expanded")
    args = list(args)
    keep = [F.col(f"`{c}`") for c in df.columns]
    if how in ("zipMin", "zipMax"):
        df = df.select(*keep, *[args[k].column.alias(f"{mark}{k}l") for k in marked])
        zipped = F.arrays_zip(*[F.col(f"`{mark}{k}l`") for k in marked])
        df = df.select(*keep, F.explode(zipped).alias(mark + "z"))
        df = df.select(*keep, *[F.col(mark + "z").getField(f"{mark}{k}l").alias(f"{mark}{k}") for k in marked])
        if how == "zipMin":
            df = df.dropna(subset=[f"{mark}{k}" for k in marked])
    else:
        for k in marked:
            df = df.select("*", F.explode(args[k].column).alias(f"{mark}{k}"))
    for k in marked:
        args[k] = Cell(F.col(f"`{mark}{k}`"), args[k].type.of)
    return df, args


def lists_to_rdf(rows: Rows, name: str) -> list[Rows]:
    """An object that is a list: the triple to its head, and rdf:first and rdf:rest of every cell."""
    if not isinstance(rows.object.type, TypeList):
        return [rows]
    node = lambda row, i: F.concat(F.lit(f"l_{name}_"), F.col(row).cast("string"), F.lit("_"), i.cast("string"))
    numbered = materialise(rows.df.select(rows.subject.column.alias("s"), rows.predicate.column.alias("p"), rows.object.column.alias("l")).where("s IS NOT NULL AND l IS NOT NULL").withColumn("r", F.monotonically_increasing_id()))
    s, p = replace(rows.subject, column=F.col("s"), constant=None), replace(rows.predicate, column=F.col("p"))
    nil = Cell(F.lit(RDF + "nil"), IRI_T, IRI(RDF + "nil"))
    full, bare = numbered.where("size(l) > 0"), numbered.where("size(l) = 0")
    items = full.select("r", F.size("l").alias("n"), F.posexplode("l").alias("i", "x"))
    blank = lambda c: Cell(c, BLANK_T)
    of = lambda x: constant(IRI(RDF + x))
    out = [Rows(full, s, p, blank(node("r", F.lit(0)))), Rows(bare, s, p, nil)]
    first = Rows(items, blank(node("r", F.col("i"))), of("first"), Cell(F.col("x"), rows.object.type.of))
    out += lists_to_rdf(first, name + "i") if isinstance(rows.object.type.of, TypeList) else [first]
    out.append(Rows(items.where("i + 1 < n"), blank(node("r", F.col("i"))), of("rest"), blank(node("r", F.col("i") + 1))))
    out.append(Rows(items.where("i + 1 = n"), blank(node("r", F.col("i"))), of("rest"), nil))
    return out
