"""License scan by canonical digest lookup, in DataFrame functions only.

An entire text, and every entire line of it, is brought to a canonical form (case, punctuation, copyright lines,
equivalent spellings) and its SHA-256 is hash-joined with the digests of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, materialise

#: Words that count as the same (public matching guidelines for licence lists), applied to space-padded words.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"),
    ("labour", "labor"), ("acknowledgement", "acknowledgment"), ("fulfil", "fulfill"), ("whilst", "while"), ("utilise", "use"),
    ("noncommercial", "non commercial"), ("per cent", "percent"), ("copyright holders", "copyright owners"), ("copyright holder", "copyright owner"),
    ("https", "http"),
)

#: (license id, text): the notices that stand for a licence.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved."),
    ("MIT", "This software is released under the MIT License."),
)
#: (license id, SHA-256 of the canonical form, its length): whole licences and the longer notices, by digest alone.
DIGESTS = (
    ("MIT", "14adafd3ad6d45fa26f6904ed0fb9360d7d4da778e2939ab123c80db4b1ea629", 987),
    ("MIT", "0db200e69e7fe3d6fd97bb0cb85c7c1db18fdda1155e76d42b5f102bbb773983", 999),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a", 679),
    ("ISC", "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee", 691),
    ("Apache-2.0", "7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7", 501),
    ("GPL-3.0-or-later", "66237b20dfaa335f5c003a3da64555538643deb65ca015c0d5fa588527312c4e", 233),
    ("GPL-2.0-or-later", "a311bfb80ef013414e08cf2ea0128d424ffe3b22888612edd81cc8f04be43f8d", 233),
    ("CC0-1.0", "5fdc67a97319cee15779f4827d4966575ba9be21109feadd1f9541fc40dcadcf", 115),
)

_COPYRIGHT = r"^(copyright (c |© ?)?[0-9]{4}|copyright (c|©) |(c |© ?)[0-9]{4})"


def canonical_lines(text: Column) -> Column:
    """The lines in lower case, words only, in one spelling, one space between words; no empty or copyright lines."""

    def words(line: Column) -> Column:
        # two spaces between words, so that neighbours are both found
        x = F.concat(F.lit(" "), F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}©]+", "  "), F.lit(" "))
        for old, new in SPELLINGS:
            x = F.replace(x, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
        return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))

    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")
    return F.filter(F.transform(lines, words), lambda x: (x != "") & ~F.concat(x, F.lit(" ")).rlike(_COPYRIGHT))


def known_digests(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """(digest, license, n): as many rows as the two lists at most, a constant of the program, so always safe to broadcast."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", " ") + "'"
    rows = [f"({quoted(k)}, {quoted(t)}, null, null)" for k, t in known] + [f"({quoted(k)}, null, {quoted(d)}, {n})" for k, d, n in digests]
    texts = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(license, text, digest, n)")
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    return (
        texts.select("license", whole.alias("w"), "digest", "n")
        .groupBy(F.coalesce("digest", F.sha2("w", 256)).alias("digest"))
        .agg(F.min("license").alias("license"), F.max(F.coalesce("n", F.length("w"))).alias("n"))
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=KNOWN, digests=DIGESTS) -> DataFrame:
    """One row per document: doc_id, text_license (the licence that the entire text is, or null), license_lines (lines
    that are an entire licence or notice), licenses (ids found in either way, sorted, comma-separated, or empty).

    Null and empty texts match nothing. Rows that repeat an id are told apart. Other columns are not read.
    """
    table = materialise(known_digests(docs.sparkSession, known, digests), "licences")
    low, high = table.agg(F.min("n"), F.max("n")).first()
    fits = lambda x: F.length(x).between(low, high)  # noqa: E731 - no other length can have a known digest
    lines = docs.select(col(id_col).alias("doc_id"), canonical_lines(col(text_col)).alias("lines"))
    hits = materialise(
        lines.select(
            "doc_id",
            F.array_join("lines", " ").alias("whole"),
            F.transform(F.filter("lines", fits), lambda x: F.sha2(x, 256)).alias("line_digests"),
        ).select(
            "doc_id", F.monotonically_increasing_id().alias("uid"),
            F.when(fits(F.col("whole")), F.sha2("whole", 256)).alias("text_digest"), "line_digests",
        ),
        "candidates",
    )
    found = (
        hits.select("uid", F.explode("line_digests").alias("digest")).join(F.broadcast(table), "digest")
        .groupBy("uid").agg(F.count(F.lit(1)).alias("k"), F.collect_set("license").alias("ids"))
    )
    whole = table.select(F.col("digest").alias("text_digest"), F.col("license").alias("text_license"))
    return (
        hits.select("doc_id", "uid", "text_digest").join(F.broadcast(whole), "text_digest", "left").join(found, "uid", "left")
        .select(
            "doc_id",
            "text_license",
            F.coalesce("k", F.lit(0)).cast("long").alias("license_lines"),
            F.array_join(
                F.array_sort(F.array_union(F.coalesce("ids", F.expr("cast(array() as array<string>)")), F.array_compact(F.array("text_license")))), ","
            ).alias("licenses"),
        )
    )
