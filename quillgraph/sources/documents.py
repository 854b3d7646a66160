"""Formats that one parser must read from start to end: Turtle, RDF/XML, JSON-LD, and JSON and XML as graphs. They are
read on the driver; N-Triples is the format for large files."""

from __future__ import annotations

import json
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from io import BytesIO
from typing import Any

from ..plans.sparql import Parser
from ..terms import BOOLEAN, DOUBLE, FX, INTEGER, IRI, LANGSTRING, LONG, RDF, STRING, TYPE, UINT, XYZ, BlankNode, GraphError, Literal, Term

Quad = tuple[str | None, Term, IRI, Term]


class TurtleParser(Parser):
    def __init__(self, text: str, base: str = ""):
        super().__init__(text.lstrip("﻿"), {}, base)

    def quads(self) -> Iterator[Quad]:  # type: ignore[override]
        while self.i < len(self.tokens):
            if self.kind("lang") and self.tokens[self.i][1] in ("@prefix", "@base") or self.peek("PREFIX", "BASE"):
                word = self.take()[1].lstrip("@").lower()
                if word == "prefix":
                    name = self.take()[1]
                    self.prefixes[name[:-1]] = self.iri().iri
                else:
                    self.base = self.iri().iri
                self.accept(".")
                continue
            for t in self.triples_block("", template=True):
                yield None, t.s, t.p, t.o


def rdf_xml(data: bytes, base: str = "") -> Iterator[Quad]:
    from urllib.parse import urljoin

    count = 0
    lang_attr, base_attr = "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def blank(label: str | None = None) -> BlankNode:
        nonlocal count
        count += 1
        return BlankNode(label or f"x{count}")

    def resolve(iri: str) -> IRI:
        return IRI(urljoin(base, iri) if base else iri)

    def node(e: ET.Element, lang: str | None) -> Iterator[Any]:
        """Quads, and at the end the node itself."""
        a = {name(k): v for k, v in e.attrib.items()}
        lang = e.attrib.get(lang_attr, lang)
        if RDF + "about" in a:
            s: Term = resolve(a.pop(RDF + "about"))
        elif RDF + "ID" in a:
            s = IRI(base + "#" + a.pop(RDF + "ID"))
        else:
            s = blank(a.pop(RDF + "nodeID", None))
        if name(e.tag) != RDF + "Description":
            yield None, s, IRI(TYPE), IRI(name(e.tag))
        for k, v in a.items():
            if not k.startswith("http://www.w3.org/XML/1998/namespace"):
                yield None, s, IRI(k), IRI(v) if k == TYPE else Literal(v, LANGSTRING if lang else STRING, lang)
        items = 0
        for child in e:
            p = name(child.tag)
            if p == RDF + "li":
                items += 1
                p = f"{RDF}_{items}"
            yield from prop(s, p, child, child.attrib.get(lang_attr, lang))
        yield s

    def prop(s: Term, p: str, e: ET.Element, lang: str | None) -> Iterator[Quad]:
        a = {name(k): v for k, v in e.attrib.items() if k not in (lang_attr, base_attr)}
        kind = a.pop(RDF + "parseType", None)
        if RDF + "resource" in a:
            yield None, s, IRI(p), resolve(a[RDF + "resource"])
        elif RDF + "nodeID" in a:
            yield None, s, IRI(p), BlankNode(a[RDF + "nodeID"])
        elif kind == "Resource":
            b = blank()
            yield None, s, IRI(p), b
            for child in e:
                yield from prop(b, name(child.tag), child, lang)
        elif kind == "Collection":
            heads = []
            for child in e:
                *quads, head = node(child, lang)
                yield from quads
                heads.append(head)
            cells = [blank() for _ in heads]
            yield None, s, IRI(p), cells[0] if cells else IRI(RDF + "nil")
            for i, head in enumerate(heads):
                yield None, cells[i], IRI(RDF + "first"), head
                yield None, cells[i], IRI(RDF + "rest"), cells[i + 1] if i + 1 < len(cells) else IRI(RDF + "nil")
        elif len(e):
            *quads, head = node(e[0], lang)
            yield None, s, IRI(p), head
            yield from quads
        elif a and RDF + "datatype" not in a:
            b = blank()
            yield None, s, IRI(p), b
            for k, v in a.items():
                yield None, b, IRI(k), Literal(v)
        else:
            dt = a.get(RDF + "datatype")
            yield None, s, IRI(p), Literal(e.text or "", dt or (LANGSTRING if lang else STRING), None if dt else lang)

    root = ET.fromstring(data)
    base = root.attrib.get(base_attr, base)
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        for q in node(e, root.attrib.get(lang_attr)):
            if isinstance(q, tuple):
                yield q


class JsonLd:
    """JSON-LD with inline contexts and those given by name; remote contexts are not fetched."""

    def __init__(self, known_contexts: dict[str, Any] | None = None):
        self.known, self.count = known_contexts or {}, 0

    def context(self, active: dict[str, Any], c: Any) -> dict[str, Any]:
        if c is None:
            return {}
        if isinstance(c, list):
            for x in c:
                active = self.context(active, x)
            return active
        if isinstance(c, str):
            if c not in self.known:
                raise GraphError(f"context {c!r} is not among the known contexts")
            c = self.known[c]
            c = json.loads(c) if isinstance(c, str) else c
            return self.context(active, c.get("@context", c))
        return {**active, **c}

    def expand(self, ctx: dict[str, Any], term: str, vocab: bool = True) -> str:
        if term.startswith("@"):
            return term
        seen: set[str] = set()
        while vocab and term in ctx and term not in seen:
            seen.add(term)
            d = ctx[term]
            to = d.get("@id", term) if isinstance(d, dict) else d
            if to is None:
                return ""
            if to == term:
                break
            term = to
        if term.startswith(("@", "_:")):
            return term
        if ":" in term:
            prefix, _, local = term.partition(":")
            if not local.startswith("//") and prefix in ctx:
                return self.expand(ctx, prefix) + local
            return term
        return ctx["@vocab"] + term if vocab and "@vocab" in ctx else (ctx.get("@base", "") + term if not vocab else "")

    def node_id(self, ctx: dict[str, Any], x: str | None) -> Term:
        if x is None:
            self.count += 1
            return BlankNode(f"j{self.count}")
        iri = self.expand(ctx, x, vocab=False)
        return BlankNode(iri[2:]) if iri.startswith("_:") else IRI(iri)

    def quads(self, doc: Any, ctx: dict[str, Any] | None = None, graph: str | None = None) -> Iterator[Quad]:
        for x in doc if isinstance(doc, list) else [doc]:
            if isinstance(x, dict):
                yield from self.node(x, ctx or {}, graph)[1]

    def node(self, x: dict[str, Any], ctx: dict[str, Any], graph: str | None) -> tuple[Term, list[Quad]]:
        if "@context" in x:
            ctx = self.context(ctx, x["@context"])
        alias = {k: self.expand(ctx, k) for k in x if k != "@context"}
        by = {v: x[k] for k, v in alias.items() if v.startswith("@")}
        s, out = self.node_id(ctx, by.get("@id")), []
        types = by.get("@type", [])
        for t in types if isinstance(types, list) else [types]:
            out.append((graph, s, IRI(TYPE), IRI(self.expand(ctx, t))))
        if "@graph" in by:
            inner = s.iri if "@id" in by and isinstance(s, IRI) else graph
            out += list(self.quads(by["@graph"], ctx, inner))
        for k, p in alias.items():
            if p.startswith("@reverse"):
                continue
            if p.startswith("@") or not p or ":" not in p:
                continue
            spec = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            container = spec.get("@container")
            values = x[k]
            if container == "@language" and isinstance(values, dict):
                values = [{"@value": v, "@language": tag} for tag, vs in values.items() for v in (vs if isinstance(vs, list) else [vs])]
            if container == "@list" and not (isinstance(values, dict) and "@list" in values):
                values = {"@list": values if isinstance(values, list) else [values]}
            for v in values if isinstance(values, list) else [values]:
                o, quads = self.value(v, ctx, spec, graph)
                if o is not None:
                    out += quads
                    if "@reverse" in spec:
                        out.append((graph, o, IRI(p), s))
                    else:
                        out.append((graph, s, IRI(p), o))
        return s, out

    def value(self, v: Any, ctx: dict[str, Any], spec: dict[str, Any], graph: str | None) -> tuple[Term | None, list[Quad]]:
        if v is None:
            return None, []
        if isinstance(v, dict):
            keys = {self.expand(ctx, k): k for k in v}
            if "@value" in keys:
                raw = v[keys["@value"]]
                if "@language" in keys:
                    return Literal(str(raw), LANGSTRING, v[keys["@language"]]), []
                if "@type" in keys:
                    return Literal(_scalar(raw).value, self.expand(ctx, v[keys["@type"]])), []
                return _scalar(raw), []
            if "@list" in keys:
                items = [self.value(i, ctx, spec, graph) for i in v[keys["@list"]]]
                quads = [q for _, qs in items for q in qs]
                heads = [i for i, _ in items if i is not None]
                cells = [self.node_id(ctx, None) for _ in heads]
                for n, head in enumerate(heads):
                    quads.append((graph, cells[n], IRI(RDF + "first"), head))
                    quads.append((graph, cells[n], IRI(RDF + "rest"), cells[n + 1] if n + 1 < len(cells) else IRI(RDF + "nil")))
                return (cells[0] if cells else IRI(RDF + "nil")), quads
            if "@set" in keys:
                raise GraphError("nested @set")
            return self.node(v, ctx, graph)
        kind = spec.get("@type")
        if kind in ("@id", "@vocab") and isinstance(v, str):
            iri = self.expand(ctx, v, vocab=kind == "@vocab")
            return (BlankNode(iri[2:]) if iri.startswith("_:") else IRI(iri)), []
        if kind and kind != "@none":
            return Literal(_scalar(v).value, self.expand(ctx, kind)), []
        if isinstance(v, str):
            lang = spec.get("@language", ctx.get("@language"))
            return (Literal(v, LANGSTRING, lang) if lang else Literal(v)), []
        return _scalar(v), []


def _scalar(v: Any) -> Literal:
    if isinstance(v, bool):
        return Literal("true" if v else "false", BOOLEAN)
    if isinstance(v, int):
        return Literal(str(v), INTEGER)
    if isinstance(v, float):
        return Literal(repr(v), DOUBLE)
    return Literal(str(v))


def _fresh(kind: str) -> IRI:
    return IRI(f"urn:quillgraph:{kind}:{uuid.uuid4()}")


def _key(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_\-.]", "_", name)


def json_graph(text: str) -> Iterator[Quad]:
    """A JSON document as a graph: a root, a predicate per key, fx:child for members of arrays, fx:null for null."""
    root = _fresh("json")
    yield None, root, IRI(TYPE), IRI(FX + "root")

    def visit(s: IRI, p: IRI, v: Any) -> Iterator[Quad]:
        if isinstance(v, dict | list):
            n = _fresh("json")
            yield None, s, p, n
            yield from inside(n, v)
        elif v is None:
            yield None, s, p, IRI(FX + "null")
        else:
            x = _scalar(v)
            yield None, s, p, Literal(x.value, LONG) if x.data_type == INTEGER else x

    def inside(s: IRI, v: Any) -> Iterator[Quad]:
        if isinstance(v, dict):
            for k, x in v.items():
                yield from visit(s, IRI(XYZ + _key(k)), x)
        elif isinstance(v, list):
            for x in v:
                yield from visit(s, IRI(FX + "child"), x)
        else:
            yield from visit(s, IRI(FX + "child"), v)

    yield from inside(root, json.loads(text))


def xml_graph(data: bytes) -> Iterator[Quad]:
    """An XML document as a graph: each element typed by its name, its children with their numbers from 1, attributes as
    predicates, text as string children."""

    def qname(tag: str) -> IRI:
        return IRI(tag[1:].replace("}", "" if tag[1:].partition("}")[0].endswith(("#", "/")) else "#", 1)) if tag.startswith("{") else IRI(XYZ + tag)

    def visit(e: ET.Element, s: IRI) -> Iterator[Quad]:
        yield None, s, IRI(TYPE), qname(e.tag)
        for k, v in e.attrib.items():
            yield None, s, qname(k), Literal(v)
        if e.text and e.text.strip():
            yield None, s, IRI(FX + "child"), Literal(e.text.strip())
        for i, child in enumerate(e, 1):
            n = _fresh("xml")
            yield None, s, IRI(FX + "child"), n
            yield None, n, IRI(FX + "childNumber"), Literal(str(i), UINT)
            yield from visit(child, n)
            if child.tail and child.tail.strip():
                yield None, s, IRI(FX + "child"), Literal(child.tail.strip())

    root = _fresh("xml")
    yield None, root, IRI(TYPE), IRI(FX + "root")
    yield from visit(ET.parse(BytesIO(data)).getroot(), root)


