"""The queries opN_<name>: thin calls of the operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_dedup, license_scan, line_dedup, lm_score, mixing, packing, quality, simhash, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.schedule(_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return placed.select("row.doc_id", "source", "block", "slot", "release", "deadline", "position", "in_mix")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_line_dedup, op2_exact_dedup, op3_embedding_dedup, op4_quality_classifier, op5_simhash_dedup,
        op6_source_mixing, op7_url_filter, op8_license_scan, op9_lm_score,
        op10_best_fit_packing,
    )
    return {f.__name__: f for f in every}


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
t(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
c AS (SELECT a, min(b) AS least FROM t GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least AS component_id, vec_id = least AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP7_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM a),
u AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path
  FROM b),
m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule,
    arg_max(verdict, length(rhost) * 1000 + length(rpath)) AS verdict
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""


def _license_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    words = "' ' || regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}©]+', '  ', 'g') || ' '"
    for old, new in license_scan.SPELLINGS:
        words = "replace(" + words + f", {quote(' ' + old.replace(' ', '  ') + ' ')}, {quote(' ' + new.replace(' ', '  ') + ' ')})"
    words = "trim(replace(" + words + ", '  ', ' '))"
    canon = "CASE WHEN regexp_matches(w || ' ', " + quote(license_scan._COPYRIGHT) + ") THEN '' ELSE w END"
    known = ", ".join(f"({quote(k)}, {quote(t.replace(chr(10), ' '))})" for k, t in license_scan.KNOWN)
    digests = ", ".join(f"({quote(k)}, {quote(d)})" for k, d, _ in license_scan.DIGESTS)
    return f"""
WITH known AS (
  SELECT DISTINCT license, sha256({words.format("t")}) AS digest FROM (VALUES {known}) AS v(license, t)
  UNION SELECT * FROM (VALUES {digests}) AS v(license, digest)),
lines AS (
  SELECT doc_id, i, {canon} AS line FROM (
    SELECT doc_id, i, {words.format("l")} AS w FROM (
      SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))),
whole AS (SELECT doc_id, string_agg(line, ' ' ORDER BY i) FILTER (line <> '') AS canon FROM lines GROUP BY doc_id),
by_line AS (SELECT doc_id, license FROM lines JOIN known ON sha256(line) = digest),
by_text AS (SELECT doc_id, license FROM whole JOIN known ON sha256(canon) = digest),
ids AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses
        FROM (SELECT * FROM by_line UNION SELECT * FROM by_text) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS license_lines FROM by_line GROUP BY doc_id)
SELECT doc_id, by_text.license AS text_license, coalesce(license_lines, 0) AS license_lines, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN by_text USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op7_url_filter": OP7_SQL, "op8_license_scan": _license_sql()}
