"""Algebra -> one lazy DataFrame. Types are known before anything runs, so impossible branches never reach Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import DEFAULT, Catalog, Origin, Part, graph_name
from ..functions.aggregates import aggregate
from ..functions.expressions import Scope, evaluate
from ..functions.values import Value, boolean, pack, read
from ..operators import paths as P
from ..operators import relational as R
from ..operators.relational import KEY, col
from ..scratch import materialise
from ..terms import IRI, IRI_T, LONG, BlankNode, GraphError, Solutions, Term, Variable, native, term_column, term_type
from . import algebra as A


@dataclass
class Settings:
    include_transient: bool = True
    max_rows: int | None = None
    strict_project: bool = False


@dataclass
class Planner:
    spark: SparkSession
    catalog: Catalog
    udfs: dict[str, Any] = field(default_factory=dict)
    parameters: dict[str, Solutions] = field(default_factory=dict)
    settings: Settings = field(default_factory=Settings)
    dataset: list[str] | None = None  # FROM: the graphs that make the default graph
    named: list[str] | None = None
    fresh: int = 0

    # patterns
    def lower(self, p: Any, graph: str = DEFAULT) -> Solutions:
        return getattr(self, "_" + type(p).__name__.lower())(p, graph)

    def _bgp(self, p: A.BGP, graph: str) -> Solutions:
        triples = [A.Triple(_open(t.s), _open(t.p) if isinstance(t.p, BlankNode) else t.p, _open(t.o)) for t in p.triples]
        if not triples:
            return R.unit(self.spark)
        known = self._known_types(triples, graph)
        stars, rest = self._stars(triples, graph, known)
        scans = [*stars, *[(self._triple(t, graph, known), _cost(t)) for t in rest]]
        return self._fold(scans)

    def _fold(self, scans: list[tuple[Solutions, int]]) -> Solutions:
        """Join so that each next one is connected, the most selective first and variable predicates last."""
        scans = sorted(scans, key=lambda x: x[1])
        out, todo = scans[0][0], scans[1:]
        while todo:
            i = next((i for i, (s, _) in enumerate(todo) if set(s.types) & set(out.types)), 0)
            out = self._join2(out, todo.pop(i)[0])
        return out

    def _known_types(self, triples: list[A.Triple], graph: str) -> dict[str, set[str]]:
        """The types each variable can have, by all simple patterns together: what rules tables out."""
        known: dict[str, set[str]] = {}
        for _ in range(2):
            for t in triples:
                if not isinstance(t.p, IRI | Variable):
                    continue
                keys = list(self._keys(t, graph, known))
                for term, i in ((t.s, 2), (t.o, 3)):
                    if isinstance(term, Variable):
                        found = {k[i] for k, _ in keys}
                        known[term.name] = known[term.name] & found if term.name in known else found
        return known

    def _graphs(self, graph: str) -> list[str]:
        return self.dataset if graph == DEFAULT and self.dataset is not None else [graph]

    def _keys(self, t: A.Triple, graph: str, known: dict[str, set[str]]):
        fits = lambda term, kind: (kind in known[term.name] if term.name in known else True) if isinstance(term, Variable) else term_type(term) == kind
        for g in self._graphs(graph):
            for key, part in self.catalog.parts(g, t.p.iri if isinstance(t.p, IRI) else None, self.settings.include_transient):
                if fits(t.s, key[2]) and fits(t.o, key[3]):
                    yield key, part

    def _stars(self, triples: list[A.Triple], graph: str, known: dict[str, set[str]]):
        """Patterns on one subject whose parts come from one table with a unique subject are one scan of that table."""
        groups: dict[tuple[str, int], list[tuple[A.Triple, tuple, Part]]] = {}
        rest = []
        for t in triples:
            found = list(self._keys(t, graph, known)) if isinstance(t.p, IRI) else []
            origin = found[0][1].origin if len(found) == 1 else None
            if origin is None or not origin.unique or not isinstance(t.s, Variable) or t.s == t.o:
                rest.append(t)
            else:
                groups.setdefault((t.s.name, origin.table), []).append((t, *found[0]))
        scans = []
        for (s, _), members in groups.items():
            names = [t.o.name for t, _, _ in members if isinstance(t.o, Variable)]
            if len(names) != len(set(names)):
                rest += [t for t, _, _ in members]
                continue
            scans.append((self._star(s, members), 0 if any(not isinstance(t.o, Variable) for t, _, _ in members) else 1))
        return scans, rest

    def _star(self, s: str, members: list[tuple[A.Triple, tuple, Part]]) -> Solutions:
        first: Origin = members[0][2].origin
        out = Solutions(None, {s: (members[0][1][2],)}, of=s)
        cols, tests = [first.subject.alias(s)], []
        if first.subject_key:
            cols.append(F.col(f"`{first.subject_key[1]}`").alias(KEY + s))
            out.keys[s] = (first.subject_key[0], first.subject_key[1])
        for t, key, part in members:
            o = part.origin
            if isinstance(t.o, Variable):
                cols.append(o.object.alias(t.o.name))
                out.types[t.o.name] = (key[3],)
                if o.object_key:
                    cols.append(F.col(f"`{o.object_key[1]}`").alias(KEY + t.o.name))
                    out.keys[t.o.name] = o.object_key
                if not o.total:
                    tests.append(F.col(f"`{o.object_key[1]}`").isNotNull() if o.object_key else o.object.isNotNull())
            else:
                tests.append(self._is(o.object, o.object_key, o.frame, t.o))
        df = first.frame
        for test in tests:
            df = df.where(test)
        out.df = df.select(*cols)
        return out

    @staticmethod
    def _is(column: Column, key: tuple[str, str] | None, frame: DataFrame, term: Term) -> Column:
        """Equality with a constant; on the raw key where the column is an IRI made of one, so that scans can use it."""
        if key and isinstance(term, IRI):
            prefix, raw = key
            rest = term.iri[len(prefix) :]
            if not term.iri.startswith(prefix):
                return F.lit(False)
            whole = frame.schema[raw].dataType.typeName() in ("long", "integer", "short", "byte")
            if whole and not (rest.lstrip("-").isdigit() and str(int(rest)) == rest):
                return F.lit(False)
            return F.col(f"`{raw}`") == F.lit(int(rest) if whole else rest)
        return column == term_column(term)

    def _triple(self, t: A.Triple, graph: str, known: dict[str, set[str]] | None = None) -> Solutions:
        if not isinstance(t.p, IRI | Variable):
            return self._path(t, graph)
        parts = []
        for key, part in self._keys(t, graph, known or {}):
            parts.append(self._scan(t, key, part))
        names = {x.name for x in (t.s, t.p, t.o) if isinstance(x, Variable)}
        if not parts:
            return R.empty(self.spark, {v: (IRI_T,) for v in names})
        return parts[0] if len(parts) == 1 else R.union(parts)

    def _scan(self, t: A.Triple, key: tuple, part: Part) -> Solutions:
        o = part.origin
        if o:
            df, s_col, o_col, s_key, o_key = o.frame, o.subject, o.object, o.subject_key, o.object_key
        else:
            df, s_col, o_col, s_key, o_key = part.df, F.col("subject"), F.col("object"), None, None
        out, cols = Solutions(None, {}, of=t.s.name if isinstance(t.s, Variable) else None), {}
        if o and not o.unique:
            df, s_col, o_col, s_key, o_key = part.df, F.col("subject"), F.col("object"), None, None
        elif o and not o.total:
            df = df.where((F.col(f"`{o_key[1]}`") if o_key else o_col).isNotNull())
        for term, column, kind, k in ((t.s, s_col, key[2], s_key), (t.o, o_col, key[3], o_key)):
            if not isinstance(term, Variable):
                df = df.where(self._is(column, k, df, term))
            elif term.name in cols:
                if out.types[term.name] != (kind,):
                    return R.empty(self.spark, {v.name: (IRI_T,) for v in (t.s, t.p, t.o) if isinstance(v, Variable)})
                df = df.where(cols[term.name] == column)
            else:
                cols[term.name] = column
                out.types[term.name] = (kind,)
                if k:
                    out.keys[term.name] = k
        raw = [F.col(f"`{k[1]}`").alias(KEY + v) for v, k in out.keys.items()]
        if isinstance(t.p, Variable):
            if t.p.name in cols:
                if out.types[t.p.name] != (IRI_T,):
                    return R.empty(self.spark, {v.name: (IRI_T,) for v in (t.s, t.p, t.o) if isinstance(v, Variable)})
                df = df.where(cols[t.p.name] == F.lit(key[1]))
            else:
                cols[t.p.name] = F.lit(key[1])
                out.types[t.p.name] = (IRI_T,)
        out.df = df.select(*[c.alias(v) for v, c in cols.items()], *raw)
        return out

    # paths
    def _path(self, t: A.Triple, graph: str) -> Solutions:
        start = term_column(t.s) if not isinstance(t.s, Variable) else None
        end = term_column(t.o) if not isinstance(t.o, Variable) else None
        e = self._edges(t.p, graph, start, end)
        df, types, cols = e.df, {}, []
        for term, name in ((t.s, P.S), (t.o, P.O)):
            if isinstance(term, Variable):
                if term.name in types:
                    df = df.where(col(P.S).eqNullSafe(R.retype(e.types[P.O], P.O, e.types[P.S])))
                else:
                    types[term.name] = e.types[name]
                    cols.append(col(name).alias(term.name))
            else:
                kind = term_type(term)
                if kind not in e.types[name]:
                    df = df.where(F.lit(False))
                else:
                    df = df.where(read(name, e.types[name])[kind] == term_column(term))
        return Solutions(df.select(*cols), types)

    def _edges(self, p: Any, graph: str, start: Column | None = None, end: Column | None = None) -> Solutions:
        s, o = Variable(P.S), Variable(P.O)
        match p:
            case IRI():
                return R.plain(self._triple(A.Triple(s, p, o), graph))
            case A.Inverse(q):
                return P.swap(self._edges(q, graph, end, start))
            case A.Sequence(a, b):
                return P.sequence(self._edges(a, graph), self._edges(b, graph))
            case A.Alternative(a, b):
                return P.alternative(self._edges(a, graph), self._edges(b, graph))
            case A.Repeat(q, kind):
                e = self._edges(q, graph)
                if len(P.same_types(e).types[P.S]) > 1:  # a constant is no struct: it is found among the pairs
                    start = end = None
                return P.repeat(e, kind, start, end)
            case A.Negated(forward, backward):
                parts = []
                if forward or not backward:
                    parts.append(self._others(forward, graph))
                if backward:
                    parts.append(P.swap(self._others(backward, graph)))
                return R.distinct(R.union(parts) if len(parts) > 1 else parts[0])
        raise GraphError(f"not a path: {p}")

    def _others(self, excluded: list[IRI], graph: str) -> Solutions:
        iris = {i.iri for i in excluded}
        parts = [self._scan(A.Triple(Variable(P.S), IRI(k[1]), Variable(P.O)), k, part) for g in self._graphs(graph) for k, part in self.catalog.parts(g, None, self.settings.include_transient) if k[1] not in iris]
        return R.plain(R.union(parts)) if parts else R.empty(self.spark, {P.S: (IRI_T,), P.O: (IRI_T,)})

    # joins
    def _join2(self, a: Solutions, b: Solutions, how: str = "inner", extra: Callable | None = None) -> Solutions:
        if self.settings.max_rows is not None and not set(a.types) & set(b.types):
            rows = a.df.count() * b.df.count()
            if rows > self.settings.max_rows:
                raise GraphError(f"a product of {rows} rows is more than max_rows={self.settings.max_rows}")
        return R.join(a, b, how, extra)

    def _join(self, p: A.Join, graph: str) -> Solutions:
        flat: list[Any] = []

        def flatten(q: Any) -> None:
            if isinstance(q, A.Join):
                flatten(q.a)
                flatten(q.b)
            else:
                flat.append(q)

        flatten(p)
        triples = [t for q in flat if isinstance(q, A.BGP) for t in q.triples]
        others = [q for q in flat if not isinstance(q, A.BGP)]
        scans = ([(self._bgp(A.BGP(triples), graph), 1)] if triples else []) + [(self.lower(q, graph), 0 if isinstance(q, A.Values | A.PValues) else 2) for q in others]
        return self._fold(scans)

    def _leftjoin(self, p: A.LeftJoin, graph: str) -> Solutions:
        a, b = self.lower(p.a, graph), self.lower(p.b, graph)
        extra = (lambda types: boolean(evaluate(p.expr, self._scope(types)))) if p.expr is not None else None
        return self._join2(a, b, "left", extra)

    def _minus(self, p: A.Minus, graph: str) -> Solutions:
        return R.minus(self.lower(p.a, graph), self.lower(p.b, graph))

    def _union(self, p: A.Union, graph: str) -> Solutions:
        parts: list[Any] = []

        def flatten(q: Any) -> None:
            if isinstance(q, A.Union):
                flatten(q.a)
                flatten(q.b)
            else:
                parts.append(q)

        flatten(p)
        return R.union([self.lower(q, graph) for q in parts])

    # filters
    def _scope(self, types: dict[str, tuple[str, ...]], exists=None) -> Scope:
        return Scope(types, self.udfs, exists)

    def _filter(self, p: A.Filter, graph: str) -> Solutions:
        out = self.lower(p.p, graph)
        for e in _conjuncts(p.expr):
            match e:
                case A.Exists(q):
                    out = self._exists(out, q, graph, "left_semi")
                case A.Call("!", [A.Exists(q)]):
                    out = self._exists(out, q, graph, "left_anti")
                case _:
                    out = self._where(out, e, graph)
        return out

    def _where(self, s: Solutions, e: Any, graph: str) -> Solutions:
        s, scope = self._with_exists(s, e, graph)
        known = self._key_test(s, e)
        test = known if known is not None else boolean(evaluate(e, scope))
        return Solutions(s.df.where(test), s.types, s.maybe, s.keys, s.none, s.of)

    def _key_test(self, s: Solutions, e: Any) -> Column | None:
        """?x = <iri> on the raw key."""
        if isinstance(e, A.Call) and e.name == "=":
            for v, c in (e.args, e.args[::-1]):
                if isinstance(v, Variable) and isinstance(c, IRI) and v.name in s.keys:
                    raw = KEY + v.name
                    return self._is(col(v.name), (s.keys[v.name][0], raw), s.df, c)
        return None

    def _exists(self, s: Solutions, q: Any, graph: str, how: str) -> Solutions:
        conditions = []
        while isinstance(q, A.Filter):
            conditions += _conjuncts(q.expr)
            q = q.p
        inner = self.lower(q, graph)
        late, early = [], []
        for c in conditions:  # late are those that see a variable which only the rows outside bind
            (late if (A.expression_variables(c) - set(inner.types)) & set(s.types) else early).append(c)
        for c in early:
            inner = self._filter(A.Filter(c, Given(inner)), graph)
        if any(map(_has_exists, late)):
            return self._exists_by_row(s, inner, late, graph, how)
        outer = {v for c in late for v in A.expression_variables(c)}
        names = [v for v in inner.types if v in s.types or v in outer]
        inner = R.project(inner, names)
        if not late:
            inner = R.distinct(inner) if not inner.keys else inner
        extra = None
        if late:
            extra = lambda types: _all([boolean(evaluate(c, self._scope({**inner.types, **types}))) for c in late])
        if not names and not late:
            flag = inner.df.limit(1).select(F.lit(1).alias("__one"))
            return Solutions(s.df.join(F.broadcast(flag), F.lit(True), how), s.types, s.maybe, s.keys)
        return self._join2(s, inner, how, extra)

    def _exists_by_row(self, s: Solutions, inner: Solutions, conditions: list[Any], graph: str, how: str) -> Solutions:
        """Conditions that hold an EXISTS of their own are tested on the joined rows; the rows outside are told apart by number."""
        self.fresh += 1
        row, s = f"__row{self.fresh}", R.plain(s)
        numbered = materialise(s.df.withColumn(row, F.monotonically_increasing_id()))
        both = self._join2(Solutions(numbered, {**s.types, row: (LONG,)}, s.maybe), R.plain(inner))
        for c in conditions:
            both = self._filter(A.Filter(c, Given(both)), graph)
        hits = both.df.select(row).distinct()
        return Solutions(numbered.join(hits, row, how).drop(row), s.types, s.maybe)

    def _with_exists(self, s: Solutions, e: Any, graph: str) -> tuple[Solutions, Scope]:
        """EXISTS inside a larger expression becomes a marked left join with the distinct shared keys."""
        found: list[tuple[A.Exists, str]] = []

        def visit(x: Any) -> None:
            if isinstance(x, A.Exists):
                self.fresh += 1
                found.append((x, f"__e{self.fresh}"))
            elif isinstance(x, A.Call):
                for a in x.args:
                    visit(a)

        visit(e)
        for x, mark in found:
            inner = self.lower(x.p, graph)
            names = [v for v in inner.types if v in s.types]
            inner = R.distinct(R.plain(R.project(inner, names)))
            inner = Solutions(inner.df.withColumn(mark, F.lit(True)), {**inner.types, mark: ("http://www.w3.org/2001/XMLSchema#boolean",)}, inner.maybe)
            joined = R.join(R.plain(s) if not names else s, inner, "left") if names else R.join(s, Solutions(inner.df.limit(1), inner.types), "left")
            s = Solutions(joined.df, {v: t for v, t in joined.types.items() if v != mark}, joined.maybe, joined.keys)
        marks = {id(x): m for x, m in found}
        exists = lambda x: {"http://www.w3.org/2001/XMLSchema#boolean": F.coalesce(F.col(marks[id(x)]), F.lit(False))}
        return s, self._scope(s.types, exists if found else None)

    def _given(self, p: Given, graph: str) -> Solutions:
        return p.s

    # the rest
    def _extend(self, p: A.Extend, graph: str) -> Solutions:
        s = self.lower(p.p, graph)
        if isinstance(p.expr, Variable) and p.expr.name in s.keys and p.var not in s.types:
            v = p.expr.name
            df = s.df.withColumn(p.var, col(v)).withColumn(KEY + p.var, col(KEY + v))
            return Solutions(df, {**s.types, p.var: s.types[v]}, s.maybe | ({p.var} if v in s.maybe else set()), {**s.keys, p.var: s.keys[v]})
        s, scope = self._with_exists(s, p.expr, graph)
        return R.extend(s, p.var, evaluate(p.expr, scope))

    def _graph(self, p: A.Graph, graph: str) -> Solutions:
        if isinstance(p.name, IRI):
            return self.lower(p.p, graph_name(p.name.iri))
        names = self.named if self.named is not None else self.catalog.graphs()
        parts = []
        for g in names:
            s = self.lower(p.p, g)
            parts.append(R.extend(s, p.name.name, {IRI_T: F.lit(g)}))
        inner = A.variables(p.p)
        return R.union(parts) if parts else R.empty(self.spark, {v: (IRI_T,) for v in [p.name.name, *inner]})

    def _values(self, p: A.Values, graph: str) -> Solutions:
        types = {v: tuple(sorted({term_type(r[i]) for r in p.rows if r[i] is not None})) for i, v in enumerate(p.vars)}
        maybe = {v for i, v in enumerate(p.vars) if any(r[i] is None for r in p.rows)}
        if not p.rows:
            return R.empty(self.spark, {v: (IRI_T,) for v in p.vars})
        rows = []
        for r in p.rows:
            fields = []
            for v, term in zip(p.vars, r):
                value: Value = {t: F.lit(None).cast(native(t)) for t in types[v]}
                if term is not None:
                    value[term_type(term)] = term_column(term).cast(native(term_type(term)))
                if term is None and len(types[v]) > 1:
                    c = F.lit(None).cast(self._struct(types[v]))
                else:
                    c = pack(value)[0] if len(types[v]) != 1 else value[types[v][0]]
                fields.append(c.alias(v))
            rows.append(F.struct(*fields))
        df = self.spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select(*[F.col("r").getField(v).alias(v) for v in p.vars])
        return Solutions(df, types, maybe)

    @staticmethod
    def _struct(types: tuple[str, ...]):
        from pyspark.sql import types as T

        return T.StructType([T.StructField(t, native(t)) for t in types])

    def _pvalues(self, p: A.PValues, graph: str) -> Solutions:
        if p.name not in self.parameters:
            raise GraphError(f"no parameter {p.name!r}")
        s = self.parameters[p.name]
        if set(s.types) != set(p.vars):
            raise GraphError(f"parameter {p.name!r} has columns {sorted(s.types)}, the query names {sorted(p.vars)}")
        return R.project(s, p.vars)

    def _service(self, p: A.Service, graph: str) -> Solutions:
        raise GraphError("SERVICE is not supported: use query_external")

    def _project(self, p: A.Project, graph: str) -> Solutions:
        return R.project(self.lower(p.p, graph), p.vars, self.settings.strict_project)

    def _distinct(self, p: A.Distinct, graph: str) -> Solutions:
        return R.distinct(self.lower(p.p, graph))

    _reduced = _distinct

    def _slice(self, p: A.Slice, graph: str) -> Solutions:
        s = self.lower(p.p, graph)
        df = s.df.offset(p.start) if p.start else s.df
        return Solutions(df.limit(p.length) if p.length is not None else df, s.types, s.maybe, s.keys)

    def _orderby(self, p: A.OrderBy, graph: str) -> Solutions:
        s = self.lower(p.p, graph)
        keys = []
        for e, up in p.keys:
            if isinstance(e, Variable) and e.name not in s.types:
                continue
            s, scope = self._with_exists(s, e, graph)
            keys += R.sort_keys(evaluate(e, scope), up)
        return Solutions(s.df.orderBy(*keys) if keys else s.df, s.types, s.maybe, s.keys)

    def _group(self, p: A.Group, graph: str) -> Solutions:
        s = self.lower(p.p, graph)
        scope = self._scope({v: t for v, t in s.types.items() if not v.startswith("__v")} | {v: s.types[v] for v in p.by if v in s.types})
        aggs, types = [], {v: s.types.get(v, ()) for v in p.by}
        for v, agg in p.aggs:
            c, ts = aggregate(agg, scope)
            aggs.append(c.alias(v))
            types[v] = ts
        by = [KEY + v if v in s.keys else v for v in p.by]
        df = s.df
        for v in p.by:
            if v not in s.types:
                df = df.withColumn(v, F.lit(None).cast("boolean"))
        keys = {v: s.keys[v] for v in p.by if v in s.keys}
        grouped = df.groupBy(*[col(b) for b in by])
        df = grouped.agg(*aggs) if aggs else df.select(*[col(b) for b in by]).distinct()
        df = R.with_iris(df, keys)
        maybe = {v for v in p.by if v in s.maybe or v not in s.types} | {v for v, a in p.aggs if a.name not in ("COUNT", "GROUP_CONCAT", "LIST")}
        return Solutions(df, types, maybe, keys)


@dataclass
class Given:
    """A pattern that is lowered already."""

    s: Solutions


def _open(t: Any) -> Any:
    """In a pattern, a blank node is a variable that isn't seen outside."""
    return Variable("_:" + t.name) if isinstance(t, BlankNode) else t


def _cost(t: A.Triple) -> int:
    if not isinstance(t.p, IRI | Variable):
        return 4
    if isinstance(t.p, Variable):
        return 5
    return 0 if not isinstance(t.s, Variable) else 1 if not isinstance(t.o, Variable) else 2


def _conjuncts(e: Any) -> list[Any]:
    return _conjuncts(e.args[0]) + _conjuncts(e.args[1]) if isinstance(e, A.Call) and e.name == "&&" else [e]


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _has_exists(e: Any) -> bool:
    return isinstance(e, A.Exists) or isinstance(e, A.Call) and any(map(_has_exists, e.args))
