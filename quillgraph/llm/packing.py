"""Best-two-fit packing of token pieces into sequences of one length.

What must be decided together is only how lengths combine, so bins are planned on the histogram of lengths, which has at
most ``capacity`` rows whatever the corpus holds. A plan is a list of patterns (how many pieces of which length share a
sequence) with multiplicities; each pattern uses up at least one length, so the plan stays small as well. Pieces then find
their place by their salted rank within their length; or, in turn, so that sequences follow the order of the documents.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, keep, materialise, rank_within

CAPACITY = 2048
#: Words that a Python worker keeps encoded (about 60 MB); the others are encoded each time they come.
CACHED_WORDS = 300_000
#: Sequences of one pattern that are counted out by one row of the plan.
RUN = 1 << 16

_SPACE = "\t-\r \x85\xa0  -     　"
#: No token crosses these chunks: the tokenizer's own pattern lets only one space lead a run of other characters.
_CHUNKS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Chunk of text -> its ids as little-endian unsigned 32-bit bytes, with a bounded cache.

    The vocabulary and merges are those of the tokenizers file; the merging itself is done by tiktoken, whose results are
    the same and come several times sooner.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, added = file["model"]["vocab"], {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        self.added = {x: np.array([i], "<u4").tobytes() for x, i in added.items()}
        self.cuts = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self._encode(chunk), dtype="<u4").tobytes()
        if len(self) < CACHED_WORDS and len(chunk) < 64:
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The tokenizer's added tokens have their own ids wherever they stand; what is between them is cut on its own."""
        if not any(map(text.__contains__, self.added)):
            return b"".join([self[c] for c in _CHUNKS.findall(text)])
        out, at = [], 0
        for found in self.cuts.finditer(text):
            out += [self[c] for c in _CHUNKS.findall(text[at : found.start()])]
            out.append(self.added[found[0]])
            at = found.end()
        return b"".join(out + [self[c] for c in _CHUNKS.findall(text[at:])])


def encoder(path: str) -> Encoder:
    return keep(f"encoder {path}", lambda: Encoder(path))


def spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for a shorter first."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def placed(docs: DataFrame, wanted: list[Column]) -> DataFrame:
    """The columns ``wanted`` and file_, row_: the order in which the rows were written, where ``docs`` reads a table (a scan takes its
    files in another), else that of its partitions."""
    try:
        info = docs.metadataColumn("_metadata")
        return docs.select(*wanted, info.getField("file_path").alias("file_"), info.getField("row_index").alias("row_"))
    except AnalysisException:
        row = F.monotonically_increasing_id()
        return docs.select(*wanted, F.lpad(F.shiftright(row, 33).cast("string"), 10, "0").alias("file_"), F.expr(f"monotonically_increasing_id() & {(1 << 33) - 1}L").alias("row_"))


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, in_turn: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids; file_ and row_, where the row is): whole texts in tokens, an end id 0
    after each; null is empty."""
    path = path or tokenizer_path()
    wanted = [col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")]
    source = placed(docs, wanted) if in_turn else docs.select(*wanted)
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 500):  # long texts: few rows at a time
                part = batch.slice(at, 500)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    data = memoryview(enc.ids(text.as_py()) + b"\0\0\0\0")
                    for k, (s, n) in enumerate(spans(len(data) // 4, capacity)):
                        part_ids = data[4 * s : 4 * (s + n)]
                        row.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(part_ids))
                        if with_ids:
                            ids.append(np.frombuffer(part_ids, "<u4").astype("i4"))
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if in_turn:
                    columns, names = columns + [part.column(k).take(pa.array(row, pa.int64())) for k in (2, 3)], [*names, "file_", "row_"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    return source.mapInArrow(cut, schema + ", file_ string, row_ long" * in_turn + ", ids array<int>" * with_ids)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern, times)]: a pattern maps a length to the pieces of it in one sequence.

    A sequence is filled greedily with the largest piece that fits; then its smallest piece gives way to two unpacked ones
    that together fill the widened gap more tightly, where there are such.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left, reverse=True)
    plan: list[tuple[dict[int, int], int]] = []
    while lengths:
        pattern: dict[int, int] = {}
        gap = capacity
        for n in lengths:
            if n <= gap:
                q = min(left[n], gap // n)
                pattern[n] = q
                gap -= q * n
                if not gap:
                    break
        while gap:
            smallest = min(pattern)
            free = lambda n: left[n] - pattern.get(n, 0)  # noqa: B023, E731
            rest = [n for n in lengths if n < smallest + gap and free(n) > 0]
            best, pair, lo = smallest, None, len(rest) - 1
            for hi in range(len(rest)):  # from the longest down, the shorter partner from the shortest up
                while lo >= hi and rest[hi] + rest[lo] <= smallest + gap:
                    if (hi != lo or free(rest[hi]) > 1) and rest[hi] + rest[lo] > best:
                        best, pair = rest[hi] + rest[lo], (rest[hi], rest[lo])
                    lo -= 1
                if lo < hi or best == smallest + gap:
                    break
            if not pair:
                break
            pattern[smallest] -= 1
            if not pattern[smallest]:
                del pattern[smallest]
            for n in pair:
                pattern[n] = pattern.get(n, 0) + 1
            gap -= best - smallest
        times = min(left[n] // q for n, q in pattern.items())
        for n, q in pattern.items():
            left[n] -= q * times
        plan.append((pattern, times))
        lengths = [n for n in lengths if left[n]]
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a table with a column length of 1 to ``capacity``) with sequence_id and offset added."""
    pieces = materialise(pieces.withColumn("uid_", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows, taken, base = [], dict.fromkeys(counts, 0), 0
    for pattern, times in best_two_fit(counts, capacity):
        offset = 0
        for n, q in sorted(pattern.items(), reverse=True):
            rows.append((n, taken[n], taken[n] + q * times, q, base, offset))
            taken[n] += q * times
            offset += n * q
        base += times
    plan = pieces.sparkSession.createDataFrame(rows, "length long, from_ long, to_ long, q_ long, base_ long, at_ long")
    place = F.col("rank_") - F.col("from_")
    ranked = rank_within(pieces, ["length"], ["uid_"])
    return (
        ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank_") >= F.col("from_")) & (F.col("rank_") < F.col("to_")))
        .select(
            *[ranked[c] for c in pieces.columns if c != "uid_"],
            (F.col("base_") + F.floor(place / F.col("q_"))).cast("long").alias("sequence_id"),
            (F.col("at_") + F.pmod(place, F.col("q_")) * ranked["length"]).cast("long").alias("offset"),
        )
    )


def pack_in_turn(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """As ``pack``, into the same number of sequences, for pieces with file_ and row_: sequences are numbered from 0 by the mean
    place of what they hold, and of each length the pieces go to a pattern's sequences in their own order.

    A pattern's sequences are spread evenly over all; a length's pieces take its places from the first to the last.
    """
    pieces = materialise(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs, places = [], []
    for p, (pattern, times) in enumerate(best_two_fit(counts, capacity)):
        phase, offset = (p * 0.6180339887498949 + 0.5) % 1, 0  # patterns that come once are spread as well
        runs += [(p, float(times), phase, at, min(times, at + RUN) - 1) for at in range(0, times, RUN)]
        for n, q in sorted(pattern.items(), reverse=True):
            places.append((p, n, q, offset))
            offset += n * q
    spark = pieces.sparkSession
    files = pieces.groupBy("file_").agg((F.max("row_") + 1).alias("n_"))
    before = Window.orderBy("file_").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"), F.sum("n_").over(Window.partitionBy()).alias("all_"))
    turns = pieces.join(F.broadcast(files), "file_").withColumn("turn_", F.col("before_") + F.col("row_"))
    ranked = rank_within(turns, ["length"], ["turn_", "piece"], share=F.col("turn_") / F.col("all_"))
    sequences = (
        spark.createDataFrame(runs, "p long, times_ double, phase_ double, from_ long, to_ long").repartition(max(1, min(len(runs), 64)))
        .select("p", "times_", "phase_", F.explode(F.sequence("from_", "to_")).alias("j"))
        .select("p", "j", ((F.col("j") + F.col("phase_")) / F.col("times_")).alias("share_"))
    )
    slots = (
        sequences.join(F.broadcast(spark.createDataFrame(places, "p long, length long, q_ long, at_ long")), "p")
        .select("p", "j", "share_", "length", "at_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_") - 1)).alias("copy_"))
    )
    slots = rank_within(slots, ["length"], ["share_", "p", "copy_"], share=F.col("share_"))
    slots = slots.select("p", "j", "length", "rank_", (F.col("at_") + F.col("copy_") * F.col("length")).cast("long").alias("offset"))
    put = materialise(ranked.join(slots, ["length", "rank_"]), "put")
    middle = put.groupBy("p", "j").agg((F.sum(F.col("length") * F.col("turn_")) / F.sum(F.col("length") * F.col("all_"))).alias("middle_"))
    numbers = rank_within(middle.withColumn("one_", F.lit(1)), ["one_"], ["middle_", "p", "j"], out="sequence_id", share=F.col("middle_"))
    out = put.join(numbers.select("p", "j", F.col("sequence_id").cast("long").alias("sequence_id")), ["p", "j"])
    return out.select(*[c for c in pieces.columns if c not in ("file_", "row_")], "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, in_turn: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. With ``in_turn`` the sequences follow the
    order of ``docs``.

    Null and empty texts are a piece of one id, the end. Rows that repeat are packed each, nulls in the id are kept, ties in
    length are placed in any order, an empty table gives no sequences. Other columns are not read.
    """
    if in_turn:
        return pack_in_turn(token_pieces(docs, id_col, text_col, path, capacity, in_turn=True), capacity)
    return pack(token_pieces(docs, id_col, text_col, path, capacity), capacity)


def packed_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids, doc_ids: the training sequences themselves, each of ``capacity`` ids at most."""
    placed = pack(token_pieces(docs, id_col, text_col, path, capacity, with_ids=True), capacity)
    return (
        placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
        .select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
    )
