"""SimHash near-dedup: pivot distance tables.

Every fingerprint's Hamming distances to many reference fingerprints are tabled; by the triangle inequality, a pair that
is within the threshold differs by no more than it in any of these coordinates, so a pair with a larger difference is
discarded, and survivors are verified. On its own the table would still meet every pair of fingerprints, which grows with
the square of the corpus: only pairs that agree in two of five bit blocks (as any pair within 3 bits must) reach it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, numbered, release
from .components import connected_components
from .pairs import bucketed, per_run, roots, run_pairs, union, whole_runs

SHINGLE = 3
MAX_BITS = 3
PIVOTS = 32
SEED = 42
#: Minhash buckets of ``keep_similar``: two sets at similarity 0.8 share none of 32 with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
#: Pairs at the wanted similarity that the bit radius may miss; below SMALL shingles bits are not yet near the limit it assumes.
MISSED, SMALL = 1e-6, 64


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hash of each word shingle, repeats included; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and \x20 \x09-\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def fold(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # a very long text's bits, some at a time
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; zero where there are no words."""
    return fold(shingles(text, size))


def _fingerprints(source: DataFrame, size: int) -> DataFrame:
    """``source`` (doc_id, text, ...) with fp in the place of text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    schema = source.withColumn("text", F.lit(0).cast("long")).withColumnRenamed("text", "fp").schema
    return source.mapInArrow(work, schema)


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(n)], np.uint64)


def pivot_table(fps: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Row per pivot: the Hamming distance of each fingerprint to it."""
    return np.bitwise_count(fps[None, :] ^ pivots(n)[:, None]).astype(np.int8)


def _blocks(max_bits: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """max_bits + 2 blocks as (shift, width), of which two are free of differences, and the pairs of blocks."""
    n = max_bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])], list(combinations(range(n), 2))


def linked(distinct: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that span every component of those within ``max_bits``."""
    cuts, combos = _blocks(max_bits)
    block = lambda i: F.shiftrightunsigned("fp", cuts[i][0]).bitwiseAND(F.lit((1 << cuts[i][1]) - 1))
    buckets = F.array(*[F.xxhash64(F.lit(k), block(i), block(j)) for k, (i, j) in enumerate(combos)])
    rows = bucketed(distinct.select("fp", F.explode(buckets).alias("bucket")), "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "key_"):
            fps = table.column("fp").to_numpy().view(np.uint64)
            keys, blocks, split = (table.column(c).to_numpy() for c in ("key_", "block_", "split_"))
            coordinates, parent = pivot_table(fps, n_pivots), np.arange(len(fps))
            for i, j in run_pairs(keys, blocks, split):
                for c in coordinates:  # each discards about half of what is left of unlike pairs
                    near = np.abs(c[i] - c[j]) <= max_bits
                    i, j = i[near], j[near]
                    if not len(i):
                        break
                same = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
                union(parent, i[same], j[same])
            top = roots(parent, np.arange(len(fps)))
            node = np.flatnonzero(top != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[node].view(np.int64)), pa.array(fps[top[node]].view(np.int64))], ["a", "b"])

    return per_run(rows.select("fp", "key_", "block_", "split_"), work, "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is the smallest doc_id reachable. Null and
    empty texts have fingerprint zero, linked like any other. Null ids come last; exactly one row of a component is kept,
    also where rows repeat. An empty table gives an empty result. Other columns are not read.
    """
    return _grouped(numbered(docs), id_col, text_col, size, max_bits).drop("uid")


def _grouped(rows: DataFrame, id_col: str, text_col: str, size: int, max_bits: int) -> DataFrame:
    """The result of ``simhash_dedup`` and uid, for ``rows`` (row, uid)."""
    of = F.col("row").getField
    source = rows.select(of(id_col).alias("doc_id"), of(text_col).cast("string").alias("text"), "uid")
    prints = materialise(_fingerprints(source, size), "prints")
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "uid"))
    distinct = materialise(prints.groupBy("fp").agg(first.alias("first")), "distinct")
    links = linked(distinct.select("fp"), max_bits)
    labels = connected_components(links).select(F.col("node").alias("fp"), F.col("component_id").alias("root"))
    rooted = materialise(distinct.join(labels, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    release(distinct)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    groups = rooted.select("fp", "root").join(firsts, "root").select("fp", "first")
    return prints.join(groups, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        "uid",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, exactly one of each component: that of the smallest id, null last."""
    rows = numbered(docs)
    keep = _grouped(rows, id_col, text_col, size, max_bits).where("kept").select("uid")
    return rows.join(keep, "uid", "left_semi").select("row.*")


def radius(similarity: float, missed: float = MISSED) -> int:
    """Bits within which all but ``missed`` of the pairs at this Jaccard similarity lie.

    Sets at similarity J have a cosine of at least 2J / (1 + J); each bit differs with probability angle / pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    tail = 1.0
    for r in range(64):
        tail -= math.comb(64, r) * p**r * (1 - p) ** (64 - r)
        if tail <= missed:
            return r
    return 64


def _minhashes(sets: np.ndarray) -> np.ndarray:
    """A hash per band, of its ROWS minima."""
    r = np.random.default_rng(SEED)
    a, b = (r.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(sets), 1024):  # what is made at a time stays in the processor's cache
        least = np.minimum(least, (np.multiply.outer(a | np.uint64(1), sets[at : at + 1024]) + b[:, None]).min(1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(rows)], np.uint64)


def _digest(sets: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(sets.tobytes(), SEED)


def similar(docs: DataFrame, distinct: DataFrame, similarity: float, size: int) -> DataFrame:
    """Links (a, b) between the digests of shingle sets of ``docs`` (text, uid) whose Jaccard similarity is ``similarity`` or more.

    Candidates share a minhash bucket and have sizes that allow the similarity; the pivot table and the fingerprints discard
    those beyond ``radius``; what is left is compared shingle by shingle.
    """
    bits = radius(similarity)
    rows = bucketed(distinct.select("digest", "fp", "n", F.explode("bands").alias("bucket")), "digest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "key_"):
            digest, n = table.column("digest").to_numpy(), table.column("n").to_numpy()
            fps = table.column("fp").to_numpy().view(np.uint64)
            coordinates = pivot_table(fps)
            for i, j in run_pairs(*(table.column(c).to_numpy() for c in ("key_", "block_", "split_"))):
                fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
                i, j = i[fits], j[fits]
                small = np.minimum(n[i], n[j]) < SMALL
                near = np.ones(len(i), bool)
                for c in coordinates:
                    near &= np.abs(c[i] - c[j]) <= bits
                near &= np.bitwise_count(fps[i] ^ fps[j]) <= bits
                i, j = i[near | small], j[near | small]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(digest[i], digest[j])), pa.array(np.maximum(digest[i], digest[j]))], ["a", "b"])

    pairs = materialise(per_run(rows.select("digest", "fp", "n", "key_", "block_", "split_"), work, "a long, b long").distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    texts = docs.join(distinct.join(wanted, "digest", "left_semi").select("first.uid"), "uid", "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                s = np.unique(shingles(text.as_py(), size))
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s)], pa.uint64()).view(pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["digest", "s"])

    found = texts.mapInArrow(sets, "digest long, s array<long>").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("s").alias("s"))
    found = materialise(found, "sets")
    side = lambda x: found.select(F.col("digest").alias(x), F.col("s").alias("s" + x))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long")


def keep_similar(docs: DataFrame, similarity: float, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, exactly one of each component of texts whose sets of word shingles link at Jaccard ``similarity``.

    The row of the smallest id stays, null last; ties and repeated rows leave one. Null, empty and blank texts have no
    shingles and are alike. Rows that share an id but not the text are compared like any others. An empty table gives an
    empty result.
    """
    rows = numbered(docs)
    of = F.col("row").getField
    source = rows.select(of(id_col).alias("doc_id"), of(text_col).cast("string").alias("text"), "uid")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t.as_py(), size)) for t in batch.column(1)]
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            bands = pa.array([_minhashes(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(2), longs([_digest(s) for s in sets]), longs([fold(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "digest", "fp", "n", "bands"])

    kind = source.schema["doc_id"].dataType.simpleString()
    sketches = source.mapInArrow(work, f"doc_id {kind}, uid long, digest long, fp long, n long, bands array<long>")
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "uid")).alias("first")
    distinct = materialise(sketches.groupBy("digest").agg(first, *[F.first(c).alias(c) for c in ("fp", "n", "bands")]), "sketches")
    labels = connected_components(similar(source, distinct, similarity, size)).select(F.col("node").alias("digest"), F.col("component_id").alias("root"))
    rooted = distinct.join(labels, "digest", "left").select(F.coalesce("root", "digest").alias("root"), "first")
    keep = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.uid")
    return rows.join(keep, "uid", "left_semi").select("row.*")
