"""The query algebra, as the parser makes it and the planner lowers it."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from ..terms import IRI, Term, Variable


@dataclass
class Triple:
    s: Term
    p: Any  # a term or a path
    o: Term


# paths: an IRI, or one of these
@dataclass
class Inverse:
    p: Any


@dataclass
class Sequence:
    a: Any
    b: Any


@dataclass
class Alternative:
    a: Any
    b: Any


@dataclass
class Repeat:
    p: Any
    kind: str  # * + ?


@dataclass
class Negated:
    forward: list[IRI]
    backward: list[IRI]


# graph patterns
@dataclass
class BGP:
    triples: list[Triple]


@dataclass
class Join:
    a: Any
    b: Any


@dataclass
class LeftJoin:
    a: Any
    b: Any
    expr: Any = None


@dataclass
class Filter:
    expr: Any
    p: Any


@dataclass
class Union:
    a: Any
    b: Any


@dataclass
class Minus:
    a: Any
    b: Any


@dataclass
class Extend:
    p: Any
    var: str
    expr: Any


@dataclass
class Graph:
    name: Term
    p: Any


@dataclass
class Values:
    vars: list[str]
    rows: list[list[Term | None]]


@dataclass
class PValues:
    vars: list[str]
    name: str


@dataclass
class Service:
    name: Term
    p: Any
    silent: bool = False


@dataclass
class Project:
    p: Any
    vars: list[str]


@dataclass
class Distinct:
    p: Any


@dataclass
class Reduced:
    p: Any


@dataclass
class Slice:
    p: Any
    start: int
    length: int | None


@dataclass
class OrderBy:
    p: Any
    keys: list[tuple[Any, bool]]


@dataclass
class Group:
    p: Any
    by: list[str]
    aggs: list[tuple[str, Agg]]


# expressions
@dataclass
class Agg:
    name: str
    expr: Any
    distinct: bool = False
    separator: str | None = None


@dataclass
class Call:
    name: str  # an operator, a function's name in upper case, or an IRI
    args: list[Any] = field(default_factory=list)


@dataclass
class Exists:
    p: Any


# query forms
@dataclass
class Query:
    kind: str  # SELECT CONSTRUCT ASK DESCRIBE
    pattern: Any
    template: list[Triple] = field(default_factory=list)
    terms: list[Term] = field(default_factory=list)
    dataset: list[IRI] = field(default_factory=list)
    named: list[IRI] = field(default_factory=list)


@dataclass
class Modify:
    """DELETE/INSERT WHERE; templates are (graph or None, triple)."""

    delete: list[tuple[IRI | None, Triple]]
    insert: list[tuple[IRI | None, Triple]]
    pattern: Any
    using: list[IRI] = field(default_factory=list)
    graph: IRI | None = None


@dataclass
class Data:
    insert: bool
    quads: list[tuple[IRI | None, Triple]]


@dataclass
class Manage:
    """LOAD, CLEAR, DROP, CREATE, ADD, MOVE, COPY."""

    verb: str
    source: Any = None
    target: Any = None


def variables(x: Any) -> list[str]:
    """In-scope variables of a pattern in order of first use."""
    out: dict[str, None] = {}

    def visit(p: Any) -> None:
        match p:
            case BGP(triples):
                for t in triples:
                    for term in (t.s, t.p, t.o):
                        if isinstance(term, Variable) and not term.name.startswith("_:"):
                            out[term.name] = None
            case Join(a, b) | Union(a, b) | LeftJoin(a, b):
                visit(a)
                visit(b)
            case Filter(_, q) | Distinct(q) | Reduced(q) | Slice(q) | OrderBy(q) | Service(_, q):
                visit(q)
            case Minus(a, _):
                visit(a)
            case Extend(q, var):
                visit(q)
                out[var] = None
            case Graph(name, q):
                if isinstance(name, Variable):
                    out[name.name] = None
                visit(q)
            case Values(vs) | PValues(vs):
                out.update(dict.fromkeys(vs))
            case Project(_, vs):
                out.update(dict.fromkeys(vs))
            case Group(_, by, aggs):
                out.update(dict.fromkeys(by))
                out.update(dict.fromkeys(v for v, _ in aggs))

    visit(x)
    return [v for v in out if not v.startswith("__")]


def expression_variables(e: Any) -> set[str]:
    match e:
        case Variable(name):
            return {name}
        case Call(_, args):
            return set().union(*map(expression_variables, args))
        case Exists(p):
            return mentioned(p)
        case Agg(_, expr):
            return expression_variables(expr)
        case list():
            return set().union(*map(expression_variables, e))
    return set()


def mentioned(x: Any) -> set[str]:
    """Every variable of a pattern, those of its filters too."""
    if isinstance(x, Variable):
        return set() if x.name.startswith("__") else {x.name}
    if isinstance(x, list | tuple):
        return set().union(*map(mentioned, x))
    return set().union(*(mentioned(getattr(x, f.name)) for f in fields(x))) if is_dataclass(x) else set()
