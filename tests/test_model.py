"""Templates, mapping, documents in and out, reasoning."""

import datetime

import pytest

from quillgraph import IRI, Argument, BlankNode, GraphError, Model, Parameter, Prefix, Template, Triple, Variable, add_triples, generate_templates

MEALS = """@prefix m:<http://e/meal#>. @prefix xsd:<http://www.w3.org/2001/XMLSchema#>. @prefix ex:<http://e/t#>.
ex:Meal[?meal, xsd:anyURI ?land, List<ottr:IRI> ?parts] :: {
  cross | ottr:Triple(?meal, m:contains, ++?parts), ottr:Triple(?meal, m:eatenIn, ?land), ottr:Triple(?meal, a, m:Meal) }."""


@pytest.fixture()
def meals(spark):
    m = Model(spark)
    m.add_template(MEALS)
    p, i = "http://e/meal#", "http://e/part#"
    m.map("ex:Meal", spark.createDataFrame([(p + "Soup", "http://e/FRA", [i + "Leek", i + "Salt"]), (p + "Stew", "http://e/IRL", [i + "Lamb", i + "Root"])], "meal string, land string, parts array<string>"))
    m.insert("PREFIX m:<http://e/meal#> CONSTRUCT { ?x a m:Green } WHERE { ?x m:contains <http://e/part#Leek> ; a m:Meal }")
    return m


def test_meals_and_updates(meals):
    assert meals.size() == 9
    pre = "PREFIX m:<http://e/meal#> "
    assert [r[0] for r in meals.query(pre + "SELECT ?x WHERE { ?x a m:Green }").collect()] == ["<http://e/meal#Soup>"]
    meals.update(pre + "DELETE { ?x a m:Green } INSERT { ?x a m:Vegetable } WHERE { ?x a m:Green }")
    assert meals.size() == 9
    meals.update(pre + "INSERT { ?x m:old true } WHERE { ?x a m:Meal }")
    assert meals.size() == 11
    meals.update("DELETE { ?a ?b ?c } WHERE { ?a ?b ?c }")
    assert meals.size() == 0


def test_spec_syntax_is_read(spark):
    m = Model(spark)
    pre = "@prefix ex:<http://example.net/ns#>. @prefix p:<http://example.net/p#>. "
    for text in ("[ ??x ]", "[ !?x ]", "[ ?!?x ]", "[ !??x ]", "[ owl:Class ?x ]", "[ ? owl:Class ?x ]", "[ ?! owl:Class ?x ]", "[ owl:Class ?x = p:x ]",
                 "[ List<xsd:string> ?l ]", "[ NEList<List<xsd:int>> ?l ]", "[ LUB<xsd:string> ?l ]", "[ ?x = (1, 2) ]", "[ ] @@ex:note(1)", "[ ?a, ?b ] :: BASE", "[ ?a ] :: { zipMax | ex:Other(++?a) }"):
        m.add_template(pre + f"ex:Note {text} .")
    with pytest.raises(GraphError):
        m.add_template(":prefix ex:<http://example.net/ns#>. ex:T [?x] :: { ottr:Triple(ex:a, ex:b, ?x) } .")


def test_nested_templates_defaults_and_optionals(spark):
    m = Model(spark)
    m.add_template("""@prefix ex:<http://e/> . @prefix xsd:<http://www.w3.org/2001/XMLSchema#> .
      ex:Inner [ottr:IRI ?s, xsd:string ?n = "none"] :: { ottr:Triple(?s, ex:name, ?n) } .
      ex:Outer [?s, ? xsd:string ?n, ? xsd:int ?age] :: { ex:Inner(?s, ?n), ottr:Triple(?s, ex:age, ?age), ottr:Triple(_:b, ex:about, ?s) } .""")
    m.map("ex:Outer", spark.createDataFrame([("http://e/1", "x", 1), ("http://e/2", None, None)], "s string, n string, age int"))
    got = sorted(tuple(r) for r in m.query("PREFIX ex:<http://e/> SELECT ?s ?n ?a WHERE { ?s ex:name ?n OPTIONAL { ?s ex:age ?a } }", native=True).collect())
    assert got == [("http://e/1", "x", 1), ("http://e/2", "none", None)]
    assert m.query("PREFIX ex:<http://e/> SELECT DISTINCT ?b WHERE { ?b ex:about ?s }").count() == 2
    m.map("ex:Outer", spark.createDataFrame([("http://e/3",)], "s string"))
    assert m.size() == 7


def test_a_template_given_as_text(spark):
    m = Model(spark)
    m.map("@prefix ex:<http://e/> . ex:T [ottr:IRI ?s] :: { ottr:Triple(?s, a, ex:C) } .", spark.createDataFrame([("http://e/1",)], "s string"))
    assert m.size() == 1
    with pytest.raises(NotImplementedError):
        m.validate()


def test_zip_and_lists(spark):
    m = Model(spark)
    m.add_template("""@prefix ex:<http://e/> . @prefix xsd:<http://www.w3.org/2001/XMLSchema#> .
      ex:Pair [ottr:IRI ?a, ottr:IRI ?b] :: { ottr:Triple(?a, ex:with, ?b) } .
      ex:Min [List<ottr:IRI> ?a, List<ottr:IRI> ?b] :: { zipMin | ex:Pair(++?a, ++?b) } .
      ex:L [ottr:IRI ?s, List<xsd:long> ?l] :: { ottr:Triple(?s, ex:list, ?l) } .""")
    m.map("ex:Min", spark.createDataFrame([(["http://e/1", "http://e/2"], ["http://e/3"])], "a array<string>, b array<string>"))
    assert m.size() == 1
    m.map("ex:L", spark.createDataFrame([("http://e/s", [5, 6, 7])], "s string, l array<bigint>"))
    got = m.query("PREFIX ex:<http://e/> PREFIX rdf:<http://www.w3.org/1999/02/22-rdf-syntax-ns#> SELECT ?v WHERE { ex:s ex:list/rdf:rest*/rdf:first ?v } ORDER BY ?v", native=True)
    assert [r[0] for r in got.collect()] == [5, 6, 7]
    assert m.size() == 1 + 1 + 3 + 3


def test_validation(spark):
    m = Model(spark)
    m.add_template("@prefix ex:<http://e/> . @prefix xsd:<http://www.w3.org/2001/XMLSchema#> . ex:T [ottr:IRI ?s, xsd:int ?n] :: { ottr:Triple(?s, ex:n, ?n) } .")
    ok = spark.createDataFrame([("http://e/1", 1)], "s string, n int")
    m.map("ex:T", ok)
    for bad in (ok.drop("n"), ok.selectExpr("s", "'x' AS n"), ok.selectExpr("s", "cast(null AS int) AS n"), ok.selectExpr("'no iri' AS s", "n"), ok.selectExpr("s", "n", "1 AS extra"), ok.selectExpr("s", "array(n) AS n"), ok.selectExpr("s", "cast(n AS bigint) AS n")):
        with pytest.raises(GraphError):
            m.map("ex:T", bad)
    with pytest.raises(GraphError):
        m.map("ex:Missing", ok)


def test_programmatic_template_and_generation(spark):
    m = Model(spark)
    ex = Prefix("ex", "http://e/")
    s, v = Variable("s"), Variable("v")
    m.add_template(Template(ex.suf("T"), [Parameter(s), Parameter(v, optional=True)], [Triple(s, ex.suf("v"), Argument(v)), Triple(s, ex.suf("kind"), ex.suf("K"))]))
    m.map(ex.suf("T"), spark.createDataFrame([("http://e/1", 2)], "s string, v int"))
    assert m.size() == 2
    m.templates_to_graph("http://e/templates")
    assert m.query("SELECT ?t WHERE { ?t a ottr:Template }", graph="http://e/templates").count() == 1
    m.reads("@prefix : <http://o/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . :C a owl:Class . :D a owl:Class ; rdfs:subClassOf :C . :p rdfs:domain :C ; rdfs:range xsd:string .", "turtle")
    made = generate_templates(m)
    assert set(made) == {"http://o/C", "http://o/D"} and len(made["http://o/D"].parameters) == 2


def test_map_default_and_map_triples(spark):
    m = Model(spark)
    text = m.map_default(spark.createDataFrame([("http://e/1", 1.5, ["a", "b"])], "id string, x double, l array<string>"), "id")
    assert "ottr" in text or "Triple" in text
    assert m.size() == 3
    m.map_triples(spark.createDataFrame([("http://e/1", "http://e/p", "lit"), ("http://e/1", "http://e/q", "lit")], "subject string, predicate string, object string"))
    assert [i.iri for i in m.get_predicate_iris()] == ["http://e/p", "http://e/q", "urn:quillgraph_default:l", "urn:quillgraph_default:x"]
    assert m.get_predicate(IRI("http://e/p"))[0].rdf_types["subject"] == ("I",)


def test_ntriples_read_write_and_types(spark, tmp_path):
    nt = r"""_:p <http://e/name> "A \"q\" é\n" .
_:p <http://e/n> "300"^^<http://www.w3.org/2001/XMLSchema#byte> .
_:p <http://e/n> "12"^^<http://www.w3.org/2001/XMLSchema#byte> .
_:p <http://e/d> "2020-01-02Z"^^<http://www.w3.org/2001/XMLSchema#date> .
# a comment
<http://e/x> <http://e/l> "hei"@nb .
"""
    (tmp_path / "a.nt").write_text("﻿" + nt, encoding="utf-8")
    m = Model(spark)
    m.read(str(tmp_path / "a.nt"))
    assert m.size() == 4
    assert m.query("SELECT ?n WHERE { ?s <http://e/name> ?n }").first()[0] == 'A "q" é\n'
    assert m.query("SELECT ?n WHERE { ?s <http://e/d> ?n }").first()[0] == datetime.date(2020, 1, 2)
    m.write(str(tmp_path / "out"), "ntriples")
    again = Model(spark)
    again.read(str(tmp_path / "out"), "ntriples")
    assert again.size() == 4 and '"hei"@nb' in again.writes("ntriples")


@pytest.mark.parametrize("kind", ["turtle", "rdf/xml", "ntriples"])
def test_round_trips(spark, kind):
    m = Model(spark)
    m.reads('@prefix : <http://e/> . :a :p ( 1 "x" [ :q true ] ) , "v"@en ; a :T . :b :p _:s . :c :p _:s . _:s :q 1.5 .', "turtle")
    again = Model(spark)
    again.reads(m.writes(kind, prefixes={"e": "http://e/"}), kind)
    assert again.size() == m.size() == 13
    q = "SELECT (COUNT(*) AS ?n) WHERE { ?a <http://e/p>/rdf:rest*/rdf:first ?v }"
    assert again.query(q).first()[0] == 3


def test_serialise_detach_compact(spark, tmp_path):
    m = Model(spark)
    m.reads("<http://e/a> <http://e/p> 1 .", "turtle", graph="http://e/g")
    m.reads("<http://e/a> <http://e/p> 2 .", "turtle", graph="http://e/g")
    m.compact()
    m.serialize(str(tmp_path / "s"))
    again = Model(spark)
    again.deserialize(str(tmp_path / "s"))
    assert again.size("http://e/g") == 2 and again.size() == 2
    alone = again.detach_graph("http://e/g")
    assert alone.size() == 2 and again.size() == 0 and alone.query("SELECT ?o WHERE { ?s ?p ?o }").count() == 2
    other = Model(spark)
    add_triples(alone, other)
    assert other.size() == 2


def test_json_xml_and_jsonld(spark):
    m = Model(spark)
    m.map_json('{"a": {"b:c": [1, "x", null, 2.5]}, "t": true}')
    assert m.query("SELECT ?v WHERE { ?r a fx:root ; xyz:a/xyz:b_c/fx:child ?v }").count() == 4
    x = Model(spark)
    x.map_xml("<r k='1'><i>one</i><i>two</i></r>")
    got = x.query("SELECT ?n (STR(?t0) AS ?t) WHERE { ?i a xyz:i ; fx:childNumber ?n ; fx:child ?t0 } ORDER BY ?n", native=True).collect()
    assert [tuple(r) for r in got] == [(1, "one"), (2, "two")]
    j = Model(spark)
    j.reads('{"@context": "http://c", "@id": "http://e/a", "name": "N", "knows": [{"@id": "http://e/b"}], "n": 5, "l": ["x", "y"]}', "json-ld",
            known_contexts={"http://c": {"@context": {"@vocab": "http://v/", "l": {"@id": "http://v/l", "@container": "@list"}}}})
    assert j.size() == 3 + 1 + 4
    assert j.query("SELECT ?n WHERE { ?s <http://v/name> ?n }").first()[0] == "N"


RDFS_CASES = [
    (":p rdfs:domain :C . :a :p :b .", ":a a :C"),
    (":p rdfs:range :C . :a :p :b .", ":b a :C"),
    (":p rdfs:subPropertyOf :q . :q rdfs:subPropertyOf :r .", ":p rdfs:subPropertyOf :r"),
    (":p a rdf:Property .", ":p rdfs:subPropertyOf :p"),
    (":p rdfs:subPropertyOf :q . :a :p :b .", ":a :q :b"),
    (":C a rdfs:Class .", ":C rdfs:subClassOf rdfs:Resource"),
    (":C rdfs:subClassOf :D . :a a :C .", ":a a :D"),
    (":C a rdfs:Class .", ":C rdfs:subClassOf :C"),
    (":C rdfs:subClassOf :D . :D rdfs:subClassOf :E .", ":C rdfs:subClassOf :E"),
]


@pytest.mark.parametrize("given,then", RDFS_CASES)
def test_rdfs_rules(spark, given, then):
    m = Model(spark)
    m.reads("@prefix : <http://e/> . " + given, "turtle")
    before = m.size()
    assert m.infer_rdfs() > 0
    assert m.query("PREFIX : <http://e/> ASK { " + then + " }") is True
    assert m.size() == before  # what is inferred is transient


def test_mapped_table_is_one_scan(spark):
    m = Model(spark)
    df = spark.range(20).selectExpr("id AS k", "id % 3 AS g", "cast(id AS string) AS s")
    m.map_table(df, "http://e/t/", "k", {"http://e/g": ("http://e/g/", "g"), "http://e/s": "s", "http://e/k": "k"})
    q = m.query("PREFIX e: <http://e/> SELECT ?s WHERE { ?x e:g <http://e/g/1> ; e:s ?s ; e:k ?k FILTER(?k > 5) }", native=True)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and sorted(int(r[0]) for r in q.collect()) == [7, 10, 13, 16, 19]
    joined = m.query("PREFIX e: <http://e/> SELECT ?a ?b WHERE { ?a e:g ?g . ?b e:g ?g . ?a e:k \"0\"^^xsd:long . ?b e:k ?kb }", native=True)
    assert "concat" not in joined._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[0]
    assert BlankNode("x").name == "x"


def _lines(spark, tmp_path, text, name, **how):
    (tmp_path / name).write_text(text, encoding="utf-8")
    m = Model(spark)
    m.read(str(tmp_path / name), **how)
    return sorted((str(r[0]), str(r[1])) for r in m.query("SELECT (STR(?s) AS ?i) (STR(?o) AS ?t) WHERE { ?s ?p ?o }", native=True).collect())


def test_ntriples_escapes_are_read_once_from_left_to_right(spark, tmp_path):
    text = r"""# a comment
<http://e/1> <http://e/p> "x\U0001F600yé" .
<http://e/2> <http://e/p> "a\\'b\\\\n\t\"\'" . # after

_:b.1 <http://e/p> <http://e/é> .
<http://e/3> <http://e/p> "1"^^<http://www.w3.org/2001/XMLSchema#boolean> .
<http://e/4> <http://e/p> "LONG" .
""".replace("LONG", r"long \"text\" " * 20_000)
    got = dict(_lines(spark, tmp_path, text, "a.nt"))
    assert got["http://e/1"] == "x\U0001f600yé" and got["http://e/2"] == "a\\'b\\\\n\t\"'" and got["http://e/3"] == "true"
    assert got["http://e/4"] == 'long "text" ' * 20_000 and "http://e/é" in got.values() and len(got) == 5


@pytest.mark.parametrize("bad", ['<http://e/1> <http://e/p> "open .', "<http://e/1> <http://e/p> .", '<http://e/1> <http://e/p> "\\q" .', "<http://e/a b> <http://e/p> <http://e/c> ."])
def test_bad_ntriples_lines_are_an_error_unless_unchecked(spark, tmp_path, bad):
    text = '<http://e/0> <http://e/p> "fine" .\n' + bad + "\n"
    with pytest.raises(GraphError, match="1 lines"):
        _lines(spark, tmp_path, text, "b.nt")
    with pytest.warns(UserWarning, match="1 lines"):
        assert _lines(spark, tmp_path, text, "b.nt", checked=False) == [("http://e/0", "fine")]


def test_literals_of_no_value_are_left_out_with_a_warning(spark, tmp_path):
    text = '<http://e/0> <http://e/p> "fine" .\n<http://e/1> <http://e/p> "abc"^^<http://www.w3.org/2001/XMLSchema#integer> .\n'
    with pytest.warns(UserWarning, match="1 literals"):
        assert _lines(spark, tmp_path, text, "c.nt") == [("http://e/0", "fine")]


def test_ntriples_lines_are_matched_once_and_texts_are_told_apart_at_reading(spark, tmp_path):
    import random

    from quillgraph.sources import ntriples

    plan = ntriples.parse(spark.createDataFrame([], "value string"), "_0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(value") == 1 and "regexp_extract(value" not in plan  # before, eight matches and three tests a line
    pick = random.Random(5)
    texts = ["".join(pick.choice('ab\\"\n\r\t\'\b\fnrtuU0é\u2028\x00') for _ in range(12)) for _ in range(600)]
    code = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "'": "\\'", "\b": "\\b", "\f": "\\f"}
    mixed = lambda t: "".join(code.get(c, c) if c != "é" or pick.random() < 0.7 else "\\u00E9" for c in t)
    lines = [f'<http://e/{i}> <http://e/p> "{mixed(t)}" .' for i, t in enumerate(texts)]
    lines += ['<http://e/n> <http://e/q> "7"^^<http://www.w3.org/2001/XMLSchema#integer> .', '<http://e/n> <http://e/q> "07"^^<http://www.w3.org/2001/XMLSchema#integer> .']
    lines += ['<http://e/n> <http://e/l> "b" .\u2028', '<http://e/n> <http://e/l> "a"@en .', '<http://e/n> <http://e/l> "a"@de .']
    (tmp_path / "nt").mkdir()
    for name in ("a.nt", "b.nt"):  # every triple twice, in files of their own
        (tmp_path / "nt" / name).write_bytes(("\n".join(lines) + "\n").encode())
    m = Model(spark)
    m.read(str(tmp_path / "nt"), "ntriples")
    got = {r["s"]: r["o"] for r in m.query("SELECT ?s ?o WHERE { ?s <http://e/p> ?o }", native=True).collect()}
    assert got == {f"http://e/{i}": t for i, t in enumerate(texts)} and m.size() == 600 + 1 + 3
    (tmp_path / "nt" / "b.nt").write_text('<http://e/n> <http://e/l> "b" .\n')
    m = Model(spark)
    m.read(str(tmp_path / "nt"), "ntriples")
    plans = {k[1]: m.catalog.rows(k)._jdf.queryExecution().executedPlan().toString() for k in m.catalog.entries if "string" in k[3]}
    assert "Exchange" not in plans["http://e/p"] and "Aggregate" in plans["http://e/l"] and m.size() == 600 + 1 + 3  # before, all texts were shuffled


def test_written_documents_leave_no_text_behind(spark):
    from pathlib import Path

    from quillgraph.queries import ntriples_documents
    from quillgraph.scratch import root

    out = ntriples_documents(spark, "/root/testdata/sf0.001")
    assert not list((Path(root(spark).removeprefix("file://")) / "quillgraph").glob("nt-*/*.txt"))
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted(map(tuple, out.collect())) == sorted((f"http://example.org/doc/{r['doc_id']}", r["text"], r["n_chars"]) for r in table)
