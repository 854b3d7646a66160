"""Shared plumbing: scratch tables that survive lost executors, and skew-safe ranks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WHITE = r"[\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only where the setting is absent and the master runs in this one process is a local folder made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quillgraph/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files behind tables of ``materialise`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for folder in folders:
            if "/quillgraph/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_row(df: DataFrame, name: str = "row") -> DataFrame:
    """The whole row as one struct, so that no column of the caller can clash with ours."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias(name))


def numbered(df: DataFrame, name: str = "row", uid: str = "uid") -> DataFrame:
    """(row, uid): whole rows, each with a number that is the same whenever ``df`` is read.

    A scan gives the same rows in the same partitions each time; what comes out of a shuffle need not, and is written first.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = materialise(df, "numbered")
    return with_row(df, name).withColumn(uid, F.monotonically_increasing_id())


#: What a Python worker keeps from task to task.
_kept: dict[str, Any] = {}


def keep(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in each Python worker."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what this Python worker keeps: workers outlive queries, and the next operator needs the memory."""
    if _kept:
        _kept.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` of ``numbered`` without those whose uid is in ``gone``, as they stood before.

    What is broadcast is a bit a row, in pieces of 4 KB for 32,768 numbers in turn of a partition; rows are not moved.
    """
    piece, place = F.expr("uid >> 15"), F.expr("uid & 32767")
    bits = gone.groupBy(piece.alias("piece_")).agg(F.bitmap_construct_agg(place).alias("bits_"))
    byte = F.expr("CAST(conv(hex(substring(bits_, CAST((uid & 32767) >> 3 AS int) + 1, 1)), 16, 10) AS int)")
    dropped = F.expr("bits_ IS NOT NULL") & (byte.bitwiseAND(F.expr("1 << CAST(uid & 7 AS int)")) != 0)
    return rows.withColumn("piece_", piece).join(F.broadcast(bits), "piece_", "left").where(~dropped).select(*rows.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str = "rank_", share: Column | None = None) -> DataFrame:
    """Number the rows of every key from 0, whatever share of the table one key holds.

    Each key is salted into buckets by the hash of the first of ``order``; bucket counts are pre-aggregated, their running sum gives
    each bucket's first rank, and only a bucket is ever sorted by one task. ``keys`` hold no nulls. ``order`` decides
    ranks within a bucket and, when it has ties, any of the orders is possible. With ``share``, from 0 to 1 and growing with
    ``order``, buckets are its ranges instead, and ranks follow ``order`` through all of a key.
    """
    buckets = 8 * shuffle_partitions(df.sparkSession)
    bucket = F.pmod(F.xxhash64(order[0]), F.lit(buckets)) if share is None else F.floor(share * buckets)
    salted = df.withColumn("bucket_", bucket.cast("int"))
    before = Window.partitionBy(*keys).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        salted.groupBy(*keys, "bucket_").agg(F.count(F.lit(1)).alias("n_"))
        .select(*keys, "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("first_"))
    )
    inside = Window.partitionBy(*keys, "bucket_").orderBy(*order)
    return (
        salted.withColumn("within_", F.row_number().over(inside) - 1)
        .join(first, [*keys, "bucket_"])
        .withColumn(out, F.col("first_") + F.col("within_"))
        .drop("bucket_", "first_", "within_")
    )
