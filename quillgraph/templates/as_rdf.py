"""Templates as triples, and templates from the classes of an ontology."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

from ..terms import IRI, OTTR, RDF, RDFS, TYPE, VOCAB, BlankNode, Literal, Term, Variable
from .ast import Argument, Parameter, Template, Triple, TypeList

if TYPE_CHECKING:
    from ..model import Model


def template_quads(templates: list[Template]) -> Iterator[tuple[str | None, Term, IRI, Term]]:
    count = 0

    def node() -> BlankNode:
        nonlocal count
        count += 1
        return BlankNode(f"t{count}")

    def index(s: Term, i: int):
        return None, s, IRI(VOCAB + "index"), Literal(str(i), "http://www.w3.org/2001/XMLSchema#integer")

    def flag(s: Term, name: str):
        return None, s, IRI(VOCAB + name), Literal("true", "http://www.w3.org/2001/XMLSchema#boolean")

    def value(s: Term, p: str, x: Any) -> Iterator[tuple[str | None, Term, IRI, Term]]:
        if isinstance(x, Variable):
            yield None, s, IRI(VOCAB + "variable"), Literal(x.name)
        elif isinstance(x, list):
            for i, item in enumerate(x):
                n = node()
                yield None, s, IRI(VOCAB + "item"), n
                yield index(n, i)
                yield from value(n, p, item)
        elif x is not None:
            yield None, s, IRI(VOCAB + p), x

    for t in templates:
        yield None, t.iri, IRI(TYPE), IRI(OTTR + "Template")
        for i, p in enumerate(t.parameters):
            n = node()
            yield None, t.iri, IRI(OTTR + "parameter"), n
            yield index(n, i)
            yield None, n, IRI(OTTR + "variable"), Literal(p.variable.name)
            kind = p.rdf_type
            while isinstance(kind, TypeList):
                yield flag(n, "list")
                kind = kind.of
            if kind is not None:
                yield None, n, IRI(OTTR + "type"), kind
            if p.optional:
                yield flag(n, "optional")
            if not p.allow_blank:
                yield flag(n, "nonBlank")
            if p.default_value is not None:
                d = node()
                yield None, n, IRI(OTTR + "defaultValue"), d
                yield from value(d, "value", p.default_value)
        for i, inst in enumerate(t.instances):
            n = node()
            yield None, t.iri, IRI(OTTR + "pattern"), n
            yield index(n, i)
            yield None, n, IRI(OTTR + "of"), inst.iri
            if inst.list_expander:
                yield None, n, IRI(OTTR + "modifier"), Literal(inst.list_expander)
            for j, a in enumerate(inst.arguments):
                m = node()
                yield None, n, IRI(OTTR + "argument"), m
                yield index(m, j)
                if a.list_expand:
                    yield flag(m, "listExpand")
                yield from value(m, "value", a.term)


def generate_templates(model: Model, graph: str | None = None) -> dict[str, Template]:
    """A template per class: its own and its superclasses' properties by rdfs:domain, typed by rdfs:range."""
    q = lambda text, *names: [tuple(r) for r in model.query(text, graph=graph, native=True).select(*names).collect()]
    pre = f"PREFIX rdfs: <{RDFS}> PREFIX owl: <http://www.w3.org/2002/07/owl#> PREFIX rdf: <{RDF}> "
    classes = {c for (c,) in q(pre + "SELECT DISTINCT ?c WHERE { { ?c a owl:Class } UNION { ?c a rdfs:Class } FILTER(isIRI(?c)) }", "c")}
    above = q(pre + "SELECT DISTINCT ?c ?d WHERE { ?c rdfs:subClassOf ?d FILTER(isIRI(?c) && isIRI(?d)) }", "c", "d")
    domains = q(pre + "SELECT DISTINCT ?p ?d WHERE { ?p rdfs:domain ?d FILTER(isIRI(?d)) }", "p", "d")
    ranges = dict(q(pre + "SELECT DISTINCT ?p ?r WHERE { ?p rdfs:range ?r FILTER(isIRI(?r)) }", "p", "r"))
    out: dict[str, Template] = {}
    for c in sorted(classes):
        supers, todo = {c}, [c]
        while todo:
            x = todo.pop()
            for a, b in above:
                if a == x and b not in supers:
                    supers.add(b)
                    todo.append(b)
        properties = sorted({p for p, d in domains if d in supers})
        local = lambda iri: "".join(ch if ch.isalnum() else "_" for ch in iri.replace("#", "/").rsplit("/", 1)[-1])
        parameters = [Parameter(Variable("iri"), rdf_type=IRI(OTTR + "IRI"))]
        instances = [Triple(Variable("iri"), IRI(TYPE), IRI(c))]
        for p in properties:
            r = ranges.get(p)
            kind = IRI(r) if r and r.startswith("http://www.w3.org/2001/XMLSchema#") else IRI(OTTR + "IRI") if r else None
            parameters.append(Parameter(Variable(local(p)), optional=True, rdf_type=kind))
            instances.append(Triple(Variable("iri"), IRI(p), Argument(Variable(local(p)))))
        out[c] = Template(IRI(c + "_template"), parameters, instances)
        model.add_template(out[c])
    return out
