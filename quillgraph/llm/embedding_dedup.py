"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are bucketed by quantised Gaussian projections in several tables; vectors that share a bucket are
compared by exact cosine. The number of projections follows the number of vectors, so that unlike vectors rarely meet,
and the number of tables follows from the recall asked for at the threshold itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialise
from .components import connected_components
from .pairs import bucketed, per_run, roots, run_pairs, union, whole_runs

THRESHOLD = 0.9
WIDTH = 2.5
#: Least share of the pairs right at the threshold that share a bucket; of closer pairs more do.
RECALL = 0.98
SEED = 42


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees for two points so far apart."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a table, tables): about one unrelated vector in a bucket, and the recall at the threshold."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    projections = max(10, math.ceil(math.log(max(vectors, 1)) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - near**projections))


class Hashes:
    def __init__(self, dim: int, projections: int, tables: int):
        rng = np.random.default_rng([SEED, dim])
        self.a = rng.standard_normal((dim, projections * tables)) / WIDTH
        self.b = rng.random(projections * tables)
        self.mix = rng.integers(1, 2**63, projections * tables, dtype=np.uint64) | np.uint64(1)
        self.projections, self.tables = projections, tables

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket numbers, the table's own number mixed in."""
        cells = np.floor(x @ self.a + self.b).astype(np.int64).view(np.uint64) * self.mix
        sums = cells.reshape(len(x), self.tables, self.projections).sum(2, dtype=np.uint64)
        sums ^= sums >> np.uint64(29)
        return ((sums + np.arange(self.tables, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square is too large or too small
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per vector: vec_id, n_links (vectors linked directly), component_id (least id reachable), kept.

    Vectors link at a cosine of ``threshold`` or more in double precision; vectors that are null, empty, zero or hold null
    or non-finite components link with nothing. Equal vectors count as one until the end. Ids are taken as integers; a
    null id is its own component. Vectors of unlike lengths never link. Rows that repeat an id link like any others.
    Other columns are not read.
    """
    source = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("v"))
    sound = F.expr("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    rows = materialise(source.withColumn("v", F.when(sound, F.col("v"))).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    # one representative per distinct vector, by its position
    distinct = materialise(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("size")), "distinct")
    n = distinct.count()
    projections, tables = plan(n, threshold, recall)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, Hashes] = {}
        for batch in batches:
            for dim, rep, _, x in by_dim(batch):
                h = hashes.setdefault(dim, None) or Hashes(dim, projections, tables)
                hashes[dim] = h
                for at in range(0, len(x), 1000):
                    codes = h.codes(unit(x[at : at + 1000]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep[at : at + 1000], tables)), pa.array(codes.ravel())], ["rep", "bucket"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, Hashes] = {}
        for table in whole_runs(batches, "key_"):
            for dim, rep, sub, x in by_dim(table):
                h = hashes.setdefault(dim, None) or Hashes(dim, projections, tables)
                hashes[dim] = h
                size, bucket, keys, blocks, split = (sub.column(c).to_numpy() for c in ("size", "bucket", "key_", "block_", "split_"))
                x = unit(x)
                parent, found = np.arange(len(x)), np.zeros(len(x), np.int64)
                codes: np.ndarray | None = None
                for i, j in run_pairs(keys, blocks, split):
                    near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                    i, j = i[near], j[near]
                    if not len(i):
                        continue
                    if codes is None:
                        codes = h.codes(x)
                        own = (codes == bucket[:, None]).argmax(1)
                    # a pair that met in an earlier table was counted there
                    fresh = (codes[i] == codes[j]).argmax(1) == own[i]
                    i, j = i[fresh], j[fresh]
                    np.add.at(found, i, size[j])
                    np.add.at(found, j, size[i])
                    union(parent, i, j)
                top = roots(parent, np.arange(len(x)))
                hit = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(found[hit]), pa.array(rep[top[hit]])], ["rep", "found", "with"])

    pairs = bucketed(distinct.select("rep", "v").mapInArrow(buckets, "rep long, bucket long"), "rep")
    hits = materialise(per_run(pairs.join(distinct, "rep"), compare, "rep long, found long, with long"), "hits")
    links = hits.groupBy("rep").agg(F.sum("found").alias("found"))
    labels = connected_components(hits.select(F.col("rep").alias("a"), F.col("with").alias("b"))).select(F.col("node").alias("rep"), F.col("component_id").alias("root"))
    known = distinct.join(links, "rep", "left").join(labels, "rep", "left")
    members = rows.where("v IS NOT NULL").select("vec_id", "uid", "v").join(known.select("v", "size", "found", F.coalesce("root", "rep").alias("root")), "v").drop("v")
    members = materialise(members, "members")
    least = members.groupBy("root").agg(F.min("vec_id").alias("least"))
    linked = members.join(least, "root").select(
        "vec_id",
        (F.col("size") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id"),
    )
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def by_dim(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, pa.Table, np.ndarray]]:
    """(dimension, rep, rows, matrix) for each length of vector among the rows."""
    if not rows.num_rows:
        return
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_batches([rows])
    lengths = pa.compute.list_value_length(table.column("v")).to_numpy()
    for dim in np.unique(lengths):
        sub = table if (lengths == dim).all() else table.filter(pa.array(lengths == dim))
        flat = sub.column("v").combine_chunks().flatten().to_numpy()
        yield int(dim), sub.column("rep").to_numpy(), sub, flat.reshape(-1, dim)
