"""Comparing rows that share a bucket, when one bucket may hold a third of the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one bucket that are compared in one block. A larger bucket becomes pairs of blocks, each a task's work alone.
BLOCK = 2048


def bucketed(rows: DataFrame, member: str, block: int = BLOCK) -> DataFrame:
    """Rows (bucket long, ``member``, ...) of buckets with two members or more, with key_ and block_.

    Within a key_, rows are compared that are of different blocks, or all if key_ has but one block. A bucket of n rows is
    split into ceil(n / block) blocks by the member's hash; each pair of blocks is a key_ of its own, so no task ever holds
    more than about two blocks of one bucket, and no pair of rows is left out.
    """
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    blocks = F.ceil(F.col("n_") / block).cast("int")
    found = rows.join(sizes, "bucket").withColumn("blocks_", blocks).drop("n_")
    found = found.withColumn("block_", F.pmod(F.xxhash64(member), F.col("blocks_")).cast("int"))
    return (
        found.withColumn("other_", F.explode(F.expr("sequence(0, blocks_ - 1)")))
        .withColumn("key_", F.xxhash64("bucket", F.least("block_", "other_"), F.greatest("block_", "other_")))
        .withColumn("split_", F.col("block_") != F.col("other_"))
        .drop("other_", "blocks_")
    )


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that end where the key changes, from batches sorted by the key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1])
        first = kept and kept[-1].column(key)[-1].as_py() != keys[0]
        if first or len(change):
            cut = change[-1] + 1 if len(change) else 0
            kept.append(batch.slice(0, cut))
            yield pa.Table.from_batches([b for b in kept if b.num_rows])
            kept = [batch.slice(cut)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def run_pairs(keys: np.ndarray, blocks: np.ndarray, split: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (i, j) within runs of equal keys, one distance between them at a time."""
    i = np.arange(len(keys))
    d = 1
    while True:
        i = i[: np.searchsorted(i, len(keys) - d)]
        i = i[keys[i] == keys[i + d]]
        if not len(i):
            return
        j = i + d
        wanted = ~split[i] | (blocks[i] != blocks[j])
        yield i[wanted], j[wanted]
        d += 1


def union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union-find over arrays: merges the sets of each i and j in ``parent``."""
    while len(i):
        i, j = roots(parent, i), roots(parent, j)
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def per_run(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over the rows of ``bucketed``, sorted so that each key_ is one run."""
    return rows.repartition("key_").sortWithinPartitions("key_").mapInArrow(work, schema)
