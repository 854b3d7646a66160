"""Queries over an RDF view of the driver's tables, each with its SQL twin: name -> (SPARQL, SQL)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Model

EX = "http://example.org/"
PREFIX = f"PREFIX ex: <{EX}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> "

#: table -> (IRI part, key columns, links: column -> IRI part of the table it refers to)
TABLES = {
    "region": ("region/", ["r_regionkey"], {}),
    "nation": ("nation/", ["n_nationkey"], {"n_regionkey": "region/"}),
    "customer": ("customer/", ["c_custkey"], {"c_nationkey": "nation/"}),
    "supplier": ("supplier/", ["s_suppkey"], {"s_nationkey": "nation/"}),
    "part": ("part/", ["p_partkey"], {}),
    "orders": ("order/", ["o_orderkey"], {"o_custkey": "customer/"}),
    "lineitem": ("lineitem/", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], {"l_orderkey": "order/", "l_partkey": "part/", "l_suppkey": "supplier/"}),
    "events": ("event/", ["event_id"], {}),
    "documents": ("doc/", ["doc_id"], {}),
    "labels": ("doc/", ["doc_id"], {}),
    "pages": ("page/", ["page_id"], {}),
    "conversations": ("conv/", ["conv_id", "turn"], {}),
}


def model_of(spark: SparkSession, sf_dir: str, *tables: str, model: Model | None = None, graph: str | None = None) -> Model:
    """Every column is a predicate of its own name; links lead to the other table's subject. Nothing is read yet."""
    model = model or Model(spark)
    for t in tables:
        part, keys, links = TABLES[t]
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        properties: dict[str, str | tuple[str, str]] = {EX + c: (EX + links[c], c) if c in links else c for c in df.columns}
        model.map_table(df, EX + part, keys if len(keys) > 1 else keys[0], properties, EX + t, graph)
    return model


#: name -> (tables, SPARQL, SQL)
SPARQL: dict[str, tuple[str, str, str]] = {
    "bgp_chain3": (
        "customer nation region",
        'SELECT ?name ?region WHERE { ?c ex:c_name ?name ; ex:c_nationkey ?n . ?n ex:n_regionkey ?r . ?r ex:r_name ?region }',
        "SELECT c_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "bgp_constant": (
        "nation region",
        'SELECT ?n WHERE { ?x ex:n_name ?n . ?x ex:n_regionkey ?r . ?r ex:r_name "ASIA" }',
        "SELECT n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    ),
    "bgp_star": (
        "orders",
        "SELECT ?o ?status ?price ?prio WHERE { ?o ex:o_orderstatus ?status ; ex:o_totalprice ?price ; ex:o_orderpriority ?prio }",
        "SELECT 'http://example.org/order/' || o_orderkey AS o, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS prio FROM orders",
    ),
    "constant_subject": (
        "orders",
        "SELECT ?status ?price WHERE { <http://example.org/order/7> ex:o_orderstatus ?status ; ex:o_totalprice ?price }",
        "SELECT o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey = 7",
    ),
    "filter_compare": (
        "lineitem",
        "SELECT ?q ?p WHERE { ?l ex:l_quantity ?q ; ex:l_extendedprice ?p FILTER(?q < 5 && ?p >= 1000 || ?p < 950) }",
        "SELECT l_quantity AS q, l_extendedprice AS p FROM lineitem WHERE l_quantity < 5 AND l_extendedprice >= 1000 OR l_extendedprice < 950",
    ),
    "filter_regex": (
        "part",
        'SELECT ?p ?n WHERE { ?p ex:p_name ?n FILTER(REGEX(?n, "[aeiou]{2}", "i")) }',
        "SELECT 'http://example.org/part/' || p_partkey AS p, p_name AS n FROM part WHERE regexp_matches(p_name, '[aeiou]{2}', 'i')",
    ),
    "filter_in": (
        "events",
        'SELECT ?e ?t WHERE { ?e ex:event_type ?t FILTER(?t IN ("view", "click")) }',
        "SELECT 'http://example.org/event/' || event_id AS e, event_type AS t FROM events WHERE event_type IN ('view', 'click')",
    ),
    "exact_type_equality": (
        "part",
        'SELECT (COUNT(?a) AS ?int) WHERE { ?a ex:p_size ?s FILTER(?s = "15"^^xsd:int) }',
        "SELECT count(*) AS int FROM part WHERE p_size = 15",
    ),
    "optional_": (
        "documents labels",
        "SELECT ?d ?s ?q WHERE { ?d a ex:documents ; ex:source ?s OPTIONAL { ?d ex:quality ?q } }",
        "SELECT 'http://example.org/doc/' || doc_id AS d, source AS s, quality AS q FROM documents LEFT JOIN labels USING (doc_id)",
    ),
    "optional_filter": (
        "documents labels",
        "SELECT ?d ?n ?q WHERE { ?d ex:n_chars ?n OPTIONAL { ?d ex:quality ?q FILTER(?n > 1000) } }",
        "SELECT 'http://example.org/doc/' || d.doc_id AS d, n_chars AS n, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND n_chars > 1000",
    ),
    "union_": (
        "customer supplier",
        "SELECT ?name ?bal WHERE { { ?x ex:c_name ?name ; ex:c_acctbal ?bal } UNION { ?x ex:s_name ?name ; ex:s_acctbal ?bal } }",
        "SELECT c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier",
    ),
    "minus_": (
        "documents labels",
        "SELECT ?d WHERE { ?d ex:lang ?l MINUS { ?d ex:quality ?q } }",
        "SELECT 'http://example.org/doc/' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "exists_": (
        "customer orders",
        'SELECT ?n WHERE { ?c ex:c_name ?n FILTER EXISTS { ?o ex:o_custkey ?c ; ex:o_orderstatus "F" } }',
        "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    ),
    "not_exists": (
        "customer orders",
        "SELECT ?n WHERE { ?c ex:c_name ?n ; ex:c_acctbal ?b FILTER NOT EXISTS { ?o ex:o_custkey ?c ; ex:o_totalprice ?p FILTER(?p > ?b * 20) } }",
        "SELECT c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 20)",
    ),
    "exists_in_or": (
        "customer orders",
        'SELECT ?n WHERE { ?c ex:c_name ?n ; ex:c_acctbal ?b FILTER(?b < 0 || EXISTS { ?o ex:o_custkey ?c ; ex:o_orderstatus "P" }) }',
        "SELECT c_name AS n FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "exists_nested": (
        "customer orders lineitem",
        "SELECT ?n WHERE { ?c ex:c_name ?n FILTER EXISTS { ?o ex:o_custkey ?c FILTER NOT EXISTS { ?l ex:l_orderkey ?o ; ex:l_quantity ?q FILTER(?q > 10) } } }",
        "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10))",
    ),
    "exists_nested_outer": (
        "customer orders lineitem",
        "SELECT ?n WHERE { ?c ex:c_name ?n ; ex:c_acctbal ?b FILTER EXISTS { ?o ex:o_custkey ?c FILTER NOT EXISTS { ?l ex:l_orderkey ?o ; ex:l_extendedprice ?p FILTER(?p > ?b * 2) } } }",
        "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > c_acctbal * 2))",
    ),
    "min_max_mixed": (
        "part",
        "SELECT ?b (STR(MAX(?v)) AS ?hi) (xsd:double(MIN(?v)) AS ?lo) WHERE { ?x ex:p_brand ?b { ?x ex:p_size ?v } UNION { ?x ex:p_retailprice ?v } UNION { ?x ex:p_name ?v } } GROUP BY ?b",
        "SELECT p_brand AS b, max(p_name) AS hi, least(min(p_size), min(p_retailprice))::DOUBLE AS lo FROM part GROUP BY p_brand",
    ),
    "select_star": ("nation region", "SELECT * WHERE { ?n ex:n_name ?name ; ex:n_regionkey ?r . ?r ex:r_name ?region }", """SELECT 'http://example.org/nation/' || n_nationkey AS n, n_name AS name, 'http://example.org/region/' || n_regionkey AS r, r_name AS region
           FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "count_distinct_star": (
        "orders",
        "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { SELECT ?s ?p WHERE { ?o ex:o_orderstatus ?s ; ex:o_orderpriority ?p } }",
        "SELECT count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)",
    ),
    "avg_distinct": ("part", "SELECT (AVG(DISTINCT ?s) AS ?a) (SUM(DISTINCT ?s) AS ?t) WHERE { ?p ex:p_size ?s }", "SELECT avg(DISTINCT p_size) AS a, sum(DISTINCT p_size)::BIGINT AS t FROM part"),
    "not_equal": (
        "orders",
        'SELECT ?o ?s WHERE { ?o ex:o_orderstatus ?s FILTER(?s != "F" && !(?s = "P")) }',
        "SELECT 'http://example.org/order/' || o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F' AND o_orderstatus <> 'P'",
    ),
    "same_term": (
        "customer supplier",
        "SELECT ?c ?s WHERE { ?c ex:c_nationkey ?n ; ex:c_acctbal ?b . ?s ex:s_nationkey ?m FILTER(?b > 9900 && sameTerm(?n, ?m)) }",
        "SELECT 'http://example.org/customer/' || c_custkey AS c, 'http://example.org/supplier/' || s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9900",
    ),
    "bound_": (
        "documents labels",
        "SELECT ?l (COUNT(?d) AS ?n) WHERE { ?d ex:lang ?l OPTIONAL { ?d ex:quality ?q } FILTER(!BOUND(?q)) } GROUP BY ?l",
        "SELECT lang AS l, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    ),
    "iri_of_text": (
        "nation",
        'SELECT (IRI(CONCAT("http://example.org/by-name/", ENCODE_FOR_URI(?n))) AS ?i) (STRDT(STR(?k), xsd:integer) AS ?d) WHERE { ?x ex:n_name ?n ; ex:n_nationkey ?k }',
        "SELECT 'http://example.org/by-name/' || url_encode(n_name) AS i, n_nationkey::BIGINT AS d FROM nation",
    ),
    "bind_arith": (
        "lineitem",
        "SELECT ?l ?net ?unit WHERE { ?l ex:l_extendedprice ?p ; ex:l_discount ?d ; ex:l_quantity ?q BIND(?p * (1 - ?d) AS ?net) BIND(?p / ?q AS ?unit) FILTER(?q > 45) }",
        "SELECT 'http://example.org/lineitem/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice AS l, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / l_quantity AS unit FROM lineitem WHERE l_quantity > 45",
    ),
    "if_coalesce": (
        "documents labels",
        'SELECT ?d (COALESCE(?q, -1) AS ?quality) (IF(?n > 1000, "long", "short") AS ?size) WHERE { ?d ex:n_chars ?n OPTIONAL { ?d ex:quality ?q0 BIND(xsd:integer(?q0) AS ?q) } }',
        "SELECT 'http://example.org/doc/' || d.doc_id AS d, coalesce(quality, -1)::BIGINT AS quality, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS size FROM documents d LEFT JOIN labels l USING (doc_id)",
    ),
    "values_join": (
        "nation region",
        'SELECT ?nn ?tag WHERE { VALUES (?rn ?tag) { ("ASIA" "east") ("EUROPE" "west") } ?n ex:n_name ?nn ; ex:n_regionkey ?r . ?r ex:r_name ?rn }',
        "SELECT n_name AS nn, tag FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES ('ASIA', 'east'), ('EUROPE', 'west')) v(rn, tag) ON r_name = rn",
    ),
    "group_count": (
        "orders customer",
        "SELECT ?seg (COUNT(*) AS ?n) WHERE { ?o ex:o_custkey ?c . ?c ex:c_mktsegment ?seg } GROUP BY ?seg",
        "SELECT c_mktsegment AS seg, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    ),
    "pricing_summary": (
        "lineitem",
        """SELECT ?rf ?ls (SUM(?q) AS ?sum_qty) (SUM(?p) AS ?sum_base) (SUM(?p * (1 - ?d)) AS ?sum_disc) (SUM(?p * (1 - ?d) * (1 + ?t)) AS ?sum_charge) (AVG(?q) AS ?avg_qty)
           (AVG(?d) AS ?avg_disc) (COUNT(*) AS ?n) WHERE { ?l ex:l_returnflag ?rf ; ex:l_linestatus ?ls ; ex:l_quantity ?q ; ex:l_extendedprice ?p ; ex:l_discount ?d ; ex:l_tax ?t ;
           ex:l_shipdate ?sd FILTER(?sd <= "1998-09-02T00:00:00"^^xsd:dateTime) } GROUP BY ?rf ?ls""",
        """SELECT l_returnflag AS rf, l_linestatus AS ls, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc,
           sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS n
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    ),
    "min_max": (
        "part",
        "SELECT ?b (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) (MIN(?n) AS ?first) (MAX(?s) AS ?size) WHERE { ?x ex:p_brand ?b ; ex:p_retailprice ?p ; ex:p_name ?n ; ex:p_size ?s } GROUP BY ?b",
        "SELECT p_brand AS b, min(p_retailprice) AS lo, max(p_retailprice) AS hi, min(p_name) AS first, max(p_size) AS size FROM part GROUP BY p_brand",
    ),
    "group_concat": (
        "region",
        'SELECT ?r (GROUP_CONCAT(?n ; SEPARATOR="|") AS ?names) (SAMPLE(?n) AS ?one) WHERE { ?r ex:r_name ?n } GROUP BY ?r',
        "SELECT 'http://example.org/region/' || r_regionkey AS r, string_agg(r_name, '|') AS names, any_value(r_name) AS one FROM region GROUP BY r_regionkey",
    ),
    "count_distinct": (
        "orders",
        "SELECT (COUNT(DISTINCT ?c) AS ?customers) (COUNT(?o) AS ?orders) (SUM(DISTINCT ?k) AS ?s) WHERE { ?o ex:o_custkey ?c ; ex:o_orderkey ?k0 . BIND(STRLEN(STR(?o)) AS ?k) }",
        "SELECT count(DISTINCT o_custkey) AS customers, count(*) AS orders, sum(DISTINCT length('http://example.org/order/' || o_orderkey))::BIGINT AS s FROM orders",
    ),
    "having_": (
        "orders",
        "SELECT ?c (COUNT(?o) AS ?n) (SUM(?p) AS ?total) WHERE { ?o ex:o_custkey ?c ; ex:o_totalprice ?p } GROUP BY ?c HAVING(COUNT(?o) > 12 && ?total > 100000)",
        "SELECT 'http://example.org/customer/' || o_custkey AS c, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000",
    ),
    "subselect_topk": (
        "customer orders",
        "SELECT ?name ?total WHERE { { SELECT ?c (SUM(?p) AS ?total) WHERE { ?o ex:o_custkey ?c ; ex:o_totalprice ?p } GROUP BY ?c ORDER BY DESC(?total) LIMIT 10 } ?c ex:c_name ?name }",
        "SELECT c_name AS name, total FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC LIMIT 10) JOIN customer ON o_custkey = c_custkey",
    ),
    "order_limit_offset": (
        "part",
        "SELECT ?p ?r WHERE { ?p ex:p_retailprice ?r ; ex:p_partkey ?k } ORDER BY DESC(?r) ?k LIMIT 20 OFFSET 5",
        "SELECT 'http://example.org/part/' || p_partkey AS p, p_retailprice AS r FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 5",
    ),
    "distinct_": (
        "lineitem",
        "SELECT DISTINCT ?p ?s WHERE { ?l ex:l_partkey ?p ; ex:l_suppkey ?s }",
        "SELECT DISTINCT 'http://example.org/part/' || l_partkey AS p, 'http://example.org/supplier/' || l_suppkey AS s FROM lineitem",
    ),
    "reduced_": ("part", "SELECT REDUCED ?b WHERE { ?p ex:p_brand ?b }", "SELECT DISTINCT p_brand AS b FROM part"),
    "string_funcs": (
        "customer",
        """SELECT ?n (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) (STRLEN(?n) AS ?len) (SUBSTR(?n, 2, 4) AS ?sub) (STRBEFORE(?n, "#") AS ?before) (STRAFTER(?n, "#") AS ?after)
           (CONCAT(?n, "-", ?s) AS ?cat) (CONTAINS(?n, "1") AS ?has) (STRSTARTS(?n, "C") AS ?starts) (STRENDS(?n, "7") AS ?ends) (REPLACE(?n, "[0-9]+", "N") AS ?rep)
           (ENCODE_FOR_URI(?n) AS ?enc) (STR(?c) AS ?iri) WHERE { ?c ex:c_name ?n ; ex:c_mktsegment ?s }""",
        """SELECT c_name AS n, upper(c_name) AS up, lower(c_name) AS low, length(c_name) AS len, substr(c_name, 2, 4) AS sub,
           CASE WHEN instr(c_name, '#') > 0 THEN substr(c_name, 1, instr(c_name, '#') - 1) ELSE c_name END AS before,
           CASE WHEN instr(c_name, '#') > 0 THEN substr(c_name, instr(c_name, '#') + 1) ELSE c_name END AS after, c_name || '-' || c_mktsegment AS cat,
           contains(c_name, '1') AS has, starts_with(c_name, 'C') AS starts, ends_with(c_name, '7') AS ends, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS rep,
           replace(c_name, '#', '%23') AS enc, 'http://example.org/customer/' || c_custkey AS iri FROM customer""",
    ),
    "type_funcs": (
        "documents",
        """SELECT ?d (LANG(?t) AS ?lang) (isIRI(?d) AS ?iri) (isLITERAL(?n) AS ?lit) (isBLANK(?d) AS ?blank) (isNUMERIC(?n) AS ?num) (STR(DATATYPE(?n)) AS ?dt) (LANGMATCHES(LANG(?t), "en") AS ?en)
           WHERE { ?d ex:n_chars ?n ; ex:lang ?l ; ex:source ?s BIND(STRLANG(?s, ?l) AS ?t) }""",
        """SELECT 'http://example.org/doc/' || doc_id AS d, lang, true AS iri, true AS lit, false AS blank, true AS num, 'http://www.w3.org/2001/XMLSchema#long' AS dt, lang = 'en' AS en FROM documents""",
    ),
    "math_funcs": (
        "customer",
        "SELECT ?c (ABS(?b) AS ?a) (CEIL(?b) AS ?up) (FLOOR(?b) AS ?down) (ROUND(?b) AS ?r) (-?b AS ?neg) WHERE { ?c ex:c_acctbal ?b }",
        "SELECT 'http://example.org/customer/' || c_custkey AS c, abs(c_acctbal) AS a, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, round(c_acctbal) AS r, -c_acctbal AS neg FROM customer",
    ),
    "date_parts": (
        "events",
        "SELECT ?e (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) (DAY(?t) AS ?d) (HOURS(?t) AS ?h) (MINUTES(?t) AS ?mi) (SECONDS(?t) AS ?s) WHERE { ?e ex:ts ?t }",
        "SELECT 'http://example.org/event/' || event_id AS e, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, floor(second(ts))::BIGINT AS s FROM events",
    ),
    "epoch_buckets": (
        "events",
        "SELECT ?b (COUNT(*) AS ?n) (SUM(?v) AS ?total) WHERE { ?e ex:ts ?t ; ex:value ?v BIND(vocab:DateTimeAsSeconds(vocab:FloorDateTimeToSecondsInterval(?t, 3600)) AS ?b) } GROUP BY ?b",
        "SELECT (epoch(ts)::BIGINT // 3600) * 3600 AS b, count(*) AS n, sum(value) AS total FROM (SELECT date_trunc('second', ts) AS ts, value FROM events) GROUP BY 1",
    ),
    "modulus_": (
        "orders",
        "SELECT ?m (COUNT(*) AS ?n) WHERE { ?o ex:o_orderkey ?link ; ex:o_orderstatus ?s BIND(vocab:modulus(xsd:integer(STRAFTER(STR(?o), \"order/\")), 7) AS ?m) } GROUP BY ?m",
        "SELECT o_orderkey % 7 AS m, count(*) AS n FROM orders GROUP BY 1",
    ),
    "xsd_casts": (
        "part",
        "SELECT ?p (xsd:integer(?s) AS ?i) (xsd:double(?s) AS ?d) (xsd:string(?s) AS ?t) (xsd:boolean(?s) AS ?b) (xsd:integer(?n) AS ?bad) WHERE { ?p ex:p_size ?s ; ex:p_name ?n }",
        "SELECT 'http://example.org/part/' || p_partkey AS p, p_size::BIGINT AS i, p_size::DOUBLE AS d, p_size::VARCHAR AS t, p_size <> 0 AS b, NULL::BIGINT AS bad FROM part",
    ),
    "hashes": (
        "customer",
        "SELECT ?n (MD5(?n) AS ?m) (SHA1(?n) AS ?s1) (SHA256(?n) AS ?s256) WHERE { ?c ex:c_name ?n }",
        "SELECT c_name AS n, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s256 FROM customer",
    ),
    "path_sequence": (
        "customer nation region",
        "SELECT ?seg ?r WHERE { ?c ex:c_nationkey/ex:n_regionkey/ex:r_name ?r . ?c ex:c_mktsegment ?seg }",
        "SELECT c_mktsegment AS seg, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "path_inverse": (
        "nation region",
        "SELECT ?a ?b WHERE { ?a ex:n_regionkey/^ex:n_regionkey ?b }",
        "SELECT 'http://example.org/nation/' || a.n_nationkey AS a, 'http://example.org/nation/' || b.n_nationkey AS b FROM nation a JOIN nation b USING (n_regionkey)",
    ),
    "path_alternative": (
        "nation customer supplier",
        "SELECT ?x ?n WHERE { ?x ex:c_nationkey|ex:s_nationkey ?n }",
        "SELECT 'http://example.org/customer/' || c_custkey AS x, 'http://example.org/nation/' || c_nationkey AS n FROM customer UNION SELECT 'http://example.org/supplier/' || s_suppkey, 'http://example.org/nation/' || s_nationkey FROM supplier",
    ),
    "path_optional_step": (
        "nation region",
        "SELECT ?a ?b WHERE { ?a ex:n_regionkey? ?b }",
        "SELECT 'http://example.org/nation/' || n_nationkey AS a, 'http://example.org/region/' || n_regionkey AS b FROM nation UNION SELECT 'http://example.org/nation/' || n_nationkey, 'http://example.org/nation/' || n_nationkey FROM nation UNION SELECT 'http://example.org/region/' || n_regionkey, 'http://example.org/region/' || n_regionkey FROM nation",
    ),
    "path_negated": (
        "region",
        "SELECT ?a ?b WHERE { ?a !(ex:r_regionkey|rdf:type) ?b }",
        "SELECT 'http://example.org/region/' || r_regionkey AS a, r_name AS b FROM region",
    ),
    "variable_predicate": (
        "region nation",
        "SELECT ?s ?p WHERE { ?s ?p ?o }",
        """SELECT s, p FROM (SELECT 'http://example.org/region/' || r_regionkey AS s, unnest(['http://example.org/r_regionkey', 'http://example.org/r_name', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p FROM region
           UNION ALL SELECT 'http://example.org/nation/' || n_nationkey, unnest(['http://example.org/n_nationkey', 'http://example.org/n_name', 'http://example.org/n_regionkey', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) FROM nation)""",
    ),
    "repeated_variable": (
        "orders",
        "SELECT (COUNT(*) AS ?n) WHERE { ?x ?p ?x }",
        "SELECT 0::BIGINT AS n",
    ),
    "aggregate_empty": (
        "region",
        'SELECT (COUNT(?r) AS ?n) WHERE { ?r ex:r_name "NOWHERE" }',
        "SELECT 0::BIGINT AS n",
    ),
    "join_five": (
        "customer orders lineitem supplier nation region",
        """SELECT ?nn (SUM(?p * (1 - ?d)) AS ?revenue) WHERE { ?l ex:l_orderkey ?o ; ex:l_suppkey ?s ; ex:l_extendedprice ?p ; ex:l_discount ?d . ?o ex:o_custkey ?c . ?c ex:c_nationkey ?n .
           ?s ex:s_nationkey ?n . ?n ex:n_name ?nn ; ex:n_regionkey ?r . ?r ex:r_name "ASIA" } GROUP BY ?nn""",
        """SELECT n_name AS nn, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""",
    ),
    "semi_join_in_path": (
        "orders customer nation",
        'SELECT ?o WHERE { ?o ex:o_custkey/ex:c_nationkey/ex:n_name "FRANCE" }',
        "SELECT 'http://example.org/order/' || o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'FRANCE'",
    ),
    "theta_join": (
        "supplier",
        "SELECT ?a ?b WHERE { ?a ex:s_acctbal ?x ; ex:s_nationkey ?n . ?b ex:s_acctbal ?y ; ex:s_nationkey ?n FILTER(?x < ?y) }",
        "SELECT 'http://example.org/supplier/' || a.s_suppkey AS a, 'http://example.org/supplier/' || b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    ),
}


def _sparql(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables, query, _ = SPARQL[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return model_of(spark, sf_dir, *tables.split()).query(PREFIX + query, native=True)

    return run


def construct_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frame,) = model_of(spark, sf_dir, "lineitem").query(PREFIX + "CONSTRUCT { ?p ex:suppliedBy ?s } WHERE { ?l ex:l_partkey ?p ; ex:l_suppkey ?s }", native=True)
    return frame


def named_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model_of(spark, sf_dir, "nation", graph=EX + "g1")
    model_of(spark, sf_dir, "region", model=m, graph=EX + "g2")
    return m.query(PREFIX + "SELECT ?g ?n ?r WHERE { GRAPH ex:g1 { ?x ex:n_name ?n ; ex:n_regionkey ?k } GRAPH ?g { ?k ex:r_name ?r } }", native=True)


def from_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model_of(spark, sf_dir, "nation", graph=EX + "g1")
    model_of(spark, sf_dir, "region", model=m, graph=EX + "g2")
    return m.query(PREFIX + "SELECT ?n ?r FROM ex:g1 FROM ex:g2 WHERE { ?x ex:n_name ?n ; ex:n_regionkey ?k . ?k ex:r_name ?r }", native=True)


def update_then_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model_of(spark, sf_dir, "nation", "region")
    m.update(PREFIX + 'DELETE { ?n ex:n_name ?x } INSERT { ?n ex:label ?y } WHERE { ?n ex:n_name ?x ; ex:n_regionkey ?r . ?r ex:r_name "ASIA" BIND(CONCAT("asia/", ?x) AS ?y) }')
    return m.query(PREFIX + "SELECT ?n ?name ?label WHERE { ?n ex:n_regionkey ?r OPTIONAL { ?n ex:n_name ?name } OPTIONAL { ?n ex:label ?label } }", native=True)


def insert_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model_of(spark, sf_dir, "customer", "nation")
    m.insert(PREFIX + "CONSTRUCT { ?n ex:hasCustomer ?c } WHERE { ?c ex:c_nationkey ?n ; ex:c_acctbal ?b FILTER(?b > 9000) }")
    return m.query(PREFIX + "SELECT ?name (COUNT(?c) AS ?rich) WHERE { ?n ex:n_name ?name ; ex:hasCustomer ?c } GROUP BY ?name", native=True)


def rdfs_subclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model_of(spark, sf_dir, "customer", "supplier")
    m.reads(f"@prefix ex: <{EX}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . ex:customer rdfs:subClassOf ex:party . ex:supplier rdfs:subClassOf ex:party . ex:party rdfs:subClassOf ex:thing .", "turtle")
    m.infer_rdfs()
    return m.query(PREFIX + "SELECT ?t (COUNT(?x) AS ?n) WHERE { ?x a ?t } GROUP BY ?t", native=True)


def _supplies(spark: SparkSession, sf_dir: str) -> Model:
    """region -> nation -> supplier as one predicate, for closures."""
    m = Model(spark)
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    iri = lambda p, c: F.concat(F.lit(EX + p), F.col(c).cast("string"))
    m.map_triples(n.select(iri("region/", "n_regionkey").alias("subject"), iri("nation/", "n_nationkey").alias("object")), EX + "has")
    m.map_triples(s.select(iri("nation/", "s_nationkey").alias("subject"), iri("supplier/", "s_suppkey").alias("object")), EX + "has")
    return m


_HAS = """has(a, b) AS (SELECT 'http://example.org/region/' || n_regionkey, 'http://example.org/nation/' || n_nationkey FROM nation
  UNION SELECT 'http://example.org/nation/' || s_nationkey, 'http://example.org/supplier/' || s_suppkey FROM supplier)"""


def path_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplies(spark, sf_dir).query(PREFIX + "SELECT ?a ?b WHERE { ?a ex:has+ ?b }", native=True)


def path_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplies(spark, sf_dir).query(PREFIX + "SELECT ?a ?b WHERE { ?a ex:has* ?b }", native=True)


def path_plus_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplies(spark, sf_dir).query(PREFIX + "SELECT ?b WHERE { <http://example.org/region/2> ex:has+ ?b }", native=True)


def template_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark)
    m.add_template(f"""@prefix ex: <{EX}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
      ex:Named [ottr:IRI ?x, xsd:string ?name] :: {{ ottr:Triple(?x, rdfs:label, ?name) }} .
      ex:Turn [ottr:IRI ?conv, xsd:string ?role, List<xsd:string> ?words] :: {{ ex:Named(?conv, ?role), cross | ottr:Triple(?conv, ex:word, ++?words) }} .""")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    m.map("ex:Turn", c.select(F.concat(F.lit(EX + "conv/"), F.col("conv_id").cast("string")).alias("conv"), "role", F.split("text", " ").alias("words")))
    return m.query(PREFIX + "SELECT ?c (COUNT(DISTINCT ?r) AS ?roles) (COUNT(DISTINCT ?w) AS ?words) WHERE { ?c rdfs:label ?r ; ex:word ?w } GROUP BY ?c", native=True)


def map_default_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit(EX + "supplier/"), F.col("s_suppkey").cast("string")).alias("id"), "s_name", "s_acctbal")
    m.map_default(s, "id")
    return m.query("SELECT ?id ?name ?bal WHERE { ?id def:s_name ?name ; def:s_acctbal ?bal }", native=True)


def ntriples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import root

    m, folder = model_of(spark, sf_dir, "nation", "region"), f"{root(spark)}/quillgraph/nt-{id(spark)}"
    m.write(folder, "ntriples")
    back = Model(spark)
    back.read(folder, "ntriples")
    return back.query(PREFIX + "SELECT ?n ?name ?key ?rn WHERE { ?n ex:n_name ?name ; ex:n_nationkey ?key ; ex:n_regionkey ?r . ?r ex:r_name ?rn }", native=True)


def ntriples_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with all that must be escaped in them, written and read again."""
    from .scratch import discard, root

    m, folder = model_of(spark, sf_dir, "documents"), f"{root(spark)}/quillgraph/nt-{uuid.uuid4().hex}"
    m.write(folder, "ntriples")
    back = Model(spark)
    back.read(folder, "ntriples")
    discard(spark, folder)  # what was read is kept in tables
    return back.query(PREFIX + "SELECT ?d ?t ?n WHERE { ?d ex:text ?t ; ex:n_chars ?n }", native=True)


def graph_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT DATA, ADD, COPY, MOVE and DELETE WHERE over named graphs."""
    m = model_of(spark, sf_dir, "nation", graph=EX + "g1")
    m.update(PREFIX + 'INSERT DATA { GRAPH ex:g1 { ex:extra ex:n_name "EXTRA" } }')
    for step in ("ADD ex:g1 TO ex:g2", "COPY ex:g2 TO ex:g3", "MOVE ex:g3 TO ex:g4"):
        m.update(PREFIX + step)
    m.update(PREFIX + "WITH ex:g4 DELETE { ?x ex:n_comment ?c } WHERE { ?x ex:n_comment ?c }")
    return m.query(PREFIX + "SELECT ?g ?n WHERE { GRAPH ?g { ?x ex:n_name ?n } }", native=True)


def udf_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model_of(spark, sf_dir, "part")
    m.add_udf(EX + "double_it", lambda x: x * 2, "http://www.w3.org/2001/XMLSchema#double")
    return m.query(PREFIX + "SELECT ?p (ex:double_it(?r) AS ?twice) WHERE { ?p ex:p_retailprice ?r }", native=True)


def pvalues_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model_of(spark, sf_dir, "part")
    wanted = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("b")).distinct()
    return m.query(PREFIX + "SELECT ?p ?b WHERE { PVALUES (?b) brands ?p ex:p_brand ?b }", {"brands": wanted}, native=True)


def facade_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark)
    m.map_df(spark.read.parquet(f"{sf_dir}/region.parquet").coalesce(1))
    return m.query("SELECT ?n ?k WHERE { ?root a fx:root ; fx:child ?row . ?row xyz:r_name ?n ; xyz:r_regionkey ?k ; fx:childNumber ?i }", native=True)


def uuid_v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_of(spark, sf_dir, "region").query(PREFIX + 'SELECT ?n (vocab:struuidv5("dns", ?n) AS ?u) WHERE { ?r ex:r_name ?n }', native=True)


#: The others: (function, SQL or None).
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "construct_distinct": (construct_distinct, "SELECT DISTINCT 'http://example.org/part/' || l_partkey AS subject, 'http://example.org/suppliedBy' AS predicate, 'http://example.org/supplier/' || l_suppkey AS object FROM lineitem"),
    "named_graph": (named_graph, "SELECT 'http://example.org/g2' AS g, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "from_graphs": (from_graphs, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "update_then_query": (update_then_query, "SELECT 'http://example.org/nation/' || n_nationkey AS n, CASE WHEN r_name <> 'ASIA' THEN n_name END AS name, CASE WHEN r_name = 'ASIA' THEN 'asia/' || n_name END AS label FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "insert_construct": (insert_construct, "SELECT n_name AS name, count(*) AS rich FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 GROUP BY n_name"),
    "rdfs_subclass": (rdfs_subclass, "WITH c AS (SELECT count(*) AS c FROM customer), s AS (SELECT count(*) AS s FROM supplier) SELECT 'http://example.org/customer' AS t, c AS n FROM c UNION ALL SELECT 'http://example.org/supplier', s FROM s UNION ALL SELECT 'http://example.org/party', c + s FROM c, s UNION ALL SELECT 'http://example.org/thing', c + s FROM c, s"),
    "path_plus": (path_plus, f"WITH RECURSIVE {_HAS}, t(a, b) AS (SELECT a, b FROM has UNION SELECT t.a, h.b FROM t JOIN has h ON t.b = h.a) SELECT a, b FROM t"),
    "path_star": (path_star, f"WITH RECURSIVE {_HAS}, t(a, b) AS (SELECT a, b FROM has UNION SELECT t.a, h.b FROM t JOIN has h ON t.b = h.a) SELECT a, b FROM t UNION SELECT a, a FROM has UNION SELECT b, b FROM has"),
    "path_plus_constant": (path_plus_constant, f"WITH RECURSIVE {_HAS}, t(b) AS (SELECT b FROM has WHERE a = 'http://example.org/region/2' UNION SELECT h.b FROM t JOIN has h ON t.b = h.a) SELECT b FROM t"),
    "template_map": (template_map, "SELECT 'http://example.org/conv/' || conv_id AS c, count(DISTINCT role) AS roles, count(DISTINCT w) AS words FROM (SELECT conv_id, role, unnest(string_split(text, ' ')) AS w FROM conversations) GROUP BY conv_id"),
    "map_default_query": (map_default_query, "SELECT 'http://example.org/supplier/' || s_suppkey AS id, s_name AS name, s_acctbal AS bal FROM supplier"),
    "ntriples_roundtrip": (ntriples_roundtrip, "SELECT 'http://example.org/nation/' || n_nationkey AS n, n_name AS name, n_nationkey AS key, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "ntriples_documents": (ntriples_documents, "SELECT 'http://example.org/doc/' || doc_id AS d, text AS t, n_chars AS n FROM documents"),
    "graph_copies": (graph_copies, "SELECT 'http://example.org/g' || g AS g, n FROM (SELECT n_name AS n FROM nation UNION ALL SELECT 'EXTRA'), (VALUES (1), (2), (4)) AS v(g)"),
    "udf_query": (udf_query, "SELECT 'http://example.org/part/' || p_partkey AS p, p_retailprice * 2 AS twice FROM part"),
    "pvalues_query": (pvalues_query, "SELECT 'http://example.org/part/' || p_partkey AS p, p_brand AS b FROM part"),
    "facade_df": (facade_df, "SELECT r_name AS n, r_regionkey AS k FROM region"),
    "uuid_v5": (
        uuid_v5,
        """SELECT n, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS u
           FROM (SELECT r_name AS n, lower(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(r_name))) AS h FROM region)""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _sparql(name) for name in SPARQL} | {name: f for name, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in SPARQL.items()} | {name: sql for name, (_, sql) in OTHERS.items() if sql}
