"""Exact dedup by heavy-hitter split.

Misra-Gries summaries of the digests find every digest that holds a large share of the rows; their exact group sizes and
survivors are broadcast (at most ``k`` + 1 rows) and settle those rows on the map side. All others are shuffled as usual.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, col, materialise

#: Counters of a summary. A digest with 2n/(K+1) of n rows is always found.
COUNTERS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def misra_gries(k: int):
    """Arrow batches of digests -> one summary of at most ``k`` counters per partition."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, int] = {}
        for batch in batches:
            for pair in pc.value_counts(batch.column(0)):
                digest, n = pair["values"].as_py(), pair["counts"].as_py()
                counters[digest] = counters.get(digest, 0) + n
                if len(counters) > 16 * k:
                    _shrink(counters, k)
        _shrink(counters, k)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(counters.keys(), pa.string()), "n": pa.array(counters.values(), pa.int64())}
        )

    return summarise


def _shrink(counters: dict[str, int], k: int) -> None:
    """Subtract the (k+1)-th largest counter from all: the merge rule that keeps the error below rows / (k+1)."""
    if len(counters) > k:
        cut = sorted(counters.values(), reverse=True)[k]
        for digest, n in list(counters.items()):
            if n > cut:
                counters[digest] = n - cut
            else:
                del counters[digest]


def heavy_digests(digests: DataFrame, rows: int, k: int = COUNTERS) -> DataFrame:
    """At most k + 1 digests, among them all that hold 2 * rows / (k + 1) rows or more.

    A summary undercounts by at most rows/(k+1) in all, so such a digest keeps an estimate of rows/(k+1); as estimates
    add up to no more than ``rows``, at most k + 1 digests reach that.
    """
    return (
        digests.select("digest").mapInArrow(misra_gries(k), "digest string, n long")
        .groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= rows / (k + 1)).select("digest")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null is the empty text. The row of
    the smallest id stays; a null id comes last, and of repeated rows with that id only one is ``kept``. An empty table
    gives an empty result. Other columns are not read.
    """
    digests = materialise(
        docs.select(col(id_col).alias("doc_id"), F.sha2(normalised(col(text_col)), 256).alias("digest"))
        .withColumn("uid", F.monotonically_increasing_id()),
        "digests",
    )
    rows = digests.count()
    group = [
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "uid")).alias("first"),
    ]
    heavy = heavy_digests(digests, rows, k)
    winners = materialise(digests.join(F.broadcast(heavy), "digest").groupBy("digest").agg(*group), "winners")
    split = digests.join(F.broadcast(winners), "digest", "left")
    settled = split.where("first IS NOT NULL")
    rest = split.where("first IS NULL").select("doc_id", "digest", "uid")
    ordinary = rest.join(rest.groupBy("digest").agg(*group), "digest")
    return settled.unionByName(ordinary).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
