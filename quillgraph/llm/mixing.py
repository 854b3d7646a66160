"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is cut into blocks. With weight w, its k-th block (from 0) is released at slot floor(k / w) and due by
ceil((k + 1) / w); in every slot the released block with the earliest deadline goes. At every slot each source is then
less than one block from its share. Weights are whole numbers of TICKS, so that windows are exact. What is decided slot by
slot is bounded: blocks grow with the table so that there are never more than BLOCKS of them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, materialise, rank_within, with_row

#: Rows of a block, or as many more as keep the table at BLOCKS blocks.
BLOCK = 16
BLOCKS = 1 << 20
#: Weights add up to this.
TICKS = 1 << 40
#: Slots that are scheduled one after the other, so many at a time. Blocks that are due later, which takes weights far from
#: what the sources hold, follow by their releases.
SLOTS, STEP = 2 * BLOCKS, 1024
#: Longer schedules are joined, not broadcast.
BROADCAST_SLOTS = 1 << 17
#: Where no weights are given, a source's target is its number of rows to this power, which raises small sources.
TEMPER = 0.9


def target_shares(counts: DataFrame, weights: Mapping[str | None, float] | None, period: int, temper: float = TEMPER) -> DataFrame:
    """(source, n, index, share): whole shares that add up to ``period``, each at least 1, by largest remainder."""
    if weights is None:
        wanted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temper)))
    else:
        values = F.array(*[F.struct(F.lit(s).cast("string").alias("source"), F.lit(float(w)).alias("w")) for s, w in weights.items()])
        named = counts.sparkSession.range(1).select(F.explode(values).alias("x")).select("x.*").where("w > 0")
        wanted = counts.join(F.broadcast(named), counts["source"].eqNullSafe(named["source"])).drop(named["source"])
    every = Window.partitionBy()
    rare = F.col("w") / F.sum("w").over(every) * period < 1  # these have one each, the others share the rest
    wanted = wanted.withColumn("rare", rare)
    others = F.when(F.col("rare"), 0.0).otherwise(F.col("w"))
    slots = F.lit(period) - F.sum(F.col("rare").cast("int")).over(every)
    spare = wanted.withColumn("exact", F.when(F.col("rare"), 1.0).otherwise(others / F.sum(others).over(every) * slots))
    spare = spare.withColumn("base", F.greatest(F.lit(1), F.floor("exact")))
    by_rest = Window.orderBy(F.desc(F.col("exact") - F.col("base")), "source")
    missing = F.lit(period) - F.sum("base").over(every)
    largest = F.row_number().over(Window.orderBy(F.desc("exact"), "source")) == 1  # gives what others, raised to 1, took
    return spare.select(
        "source", "n",
        (F.row_number().over(Window.orderBy("source")) - 1).alias("index"),
        (F.col("base") + F.when(F.row_number().over(by_rest) <= missing, 1).otherwise(0) + F.when(largest, F.least(missing, F.lit(0))).otherwise(0))
        .cast("long").alias("share"),
    )


def earliest_deadline_first(shares: DataFrame, period: int, slots: int) -> DataFrame:
    """(index, k, slot) for the first ``slots`` slots; one row of arrays, folded slot by slot, STEP slots at a time, so that only
    short arrays are copied."""
    choice = f"""array_min(transform(sequence(0, size(shares) - 1), i ->
        if((acc.done[i] * {period}L) div shares[i] <= t,
           named_struct('due', ((acc.done[i] + 1) * {period}L + shares[i] - 1) div shares[i], 'i', i), null))).i"""
    part = f"""aggregate(sequence(c * {STEP}, least((c + 1) * {STEP}, {slots}) - 1),
        named_struct('done', all.done, 'order', cast(array() as array<int>)),
        (acc, t) -> transform(array({choice}), x -> named_struct(
            'done', transform(acc.done, (n, i) -> n + if(i = x, 1, 0)), 'order', concat(acc.order, array(x))))[0])"""
    fold = f"""flatten(aggregate(sequence(0, ({slots} - 1) div {STEP}),
        named_struct('done', transform(shares, x -> cast(0 as bigint)), 'orders', cast(array() as array<array<int>>)),
        (all, c) -> transform(array({part}), p -> named_struct('done', p.done, 'orders', concat(all.orders, array(p.order))))[0]).orders)"""
    row = shares.agg(F.array_sort(F.collect_list(F.struct("index", "share"))).alias("s")).select(F.col("s.share").alias("shares"))
    seen = Window.partitionBy("index").orderBy("slot")
    return (
        row.where("size(shares) > 0").select(F.posexplode(F.expr(fold)).alias("slot", "index"))
        .select("index", (F.row_number().over(seen) - 1).cast("long").alias("k"), F.col("slot").cast("long").alias("slot"))
    )


def schedule(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    source_col: str = "source",
    order_cols: tuple[str, ...] = ("doc_id",),
    block: int | None = None,
    period: int | None = None,
    temper: float = TEMPER,
) -> DataFrame:
    """row (the input's whole row), source, block, slot, release, deadline, position, in_mix: one row per input row.

    A null source is a source of its own. Sources that ``weights`` doesn't name, or gives no positive weight, are left out
    of the schedule: slot, position and the like are null and in_mix is false. in_mix marks the slots before the first for
    which a source has no row left: up to there every prefix keeps to the weights. ``position`` numbers
    the places of the schedule; short last blocks leave gaps. Rows go in order of the hash of ``order_cols``; ties and
    repeated rows each have a place. Null, empty and very long values in other columns are carried along; an empty table
    gives an empty result. A ``period`` rounds the weights to so many slots.
    """
    rows = with_row(docs).withColumn("source", col("row").getField(source_col).cast("string"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    counts = materialise(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "counts")
    if block is None:
        block = max(BLOCK, -(-(counts.agg(F.sum("n")).first()[0] or 0) // BLOCKS))
    period = period or TICKS
    shares = materialise(target_shares(counts, weights, period, temper).withColumn("full", F.expr(f"(n + {block} - 1) div {block}")), "shares")
    last = shares.agg(F.max(F.ceil(F.col("full") * float(period) / F.col("share")))).first()[0] or 0
    slots = min(int(last), SLOTS)
    first = materialise(earliest_deadline_first(shares, period, max(1, slots)), "slots")
    horizon = shares.join(first, "index").where("k = full").agg(F.coalesce(F.min("slot"), F.lit(slots)).alias("horizon"))
    window = lambda k: f"cast({k} as decimal(20,0)) * {period}"
    release, deadline = F.expr(f"({window('k')}) div share"), F.expr(f"({window('(k + 1)')} + share - 1) div share")
    behind = (
        shares.join(first.groupBy("index").agg((F.max("k") + 1).alias("from")), "index", "left")
        .where("coalesce(from, 0) < full").select("index", "share", F.explode(F.expr("sequence(coalesce(from, 0), full - 1)")).alias("k"))
        .select("index", "k", (F.row_number().over(Window.orderBy(release, deadline, "index")) - 1 + slots).cast("long").alias("slot"))
    )
    every = materialise(first.unionByName(behind), "schedule")
    small = F.broadcast if every.count() <= BROADCAST_SLOTS else lambda x: x
    ranked = rank_within(
        rows.withColumn("key", F.coalesce("source", F.lit("\0null"))).withColumn("h", F.xxhash64(*[col("row").getField(c) for c in order_cols])),
        ["key"], ["h", "uid"],
    )
    of = shares.select(F.coalesce("source", F.lit("\0null")).alias("key"), "index", "share")
    placed = (
        ranked.withColumn("k", F.expr(f"rank_ div {block}"))
        .join(F.broadcast(of), "key", "left")
        .join(small(every), ["index", "k"], "left")
        .join(F.broadcast(horizon))
    )
    return placed.select(
        "row", "source", F.col("k").alias("block"), "slot", release.alias("release"), deadline.alias("deadline"),
        (F.col("slot") * block + F.expr(f"rank_ % {block}")).alias("position"),
        F.coalesce(F.col("slot") < F.col("horizon"), F.lit(False)).alias("in_mix"),
    )


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, **how) -> DataFrame:
    """The rows of ``docs`` that keep to the target weights, in the order of the schedule, with the columns of ``docs``."""
    return schedule(docs, weights, **how).where("in_mix").orderBy("position").select("row.*")


def mix_all(docs: DataFrame, weights: Mapping[str | None, float] | None = None, **how) -> DataFrame:
    """Every row of ``docs`` whose source has a weight, in the order of the schedule, with the columns of ``docs``.

    Once a source has no row left, its slots are passed over: the others go on in the proportion of their weights.
    """
    return schedule(docs, weights, **how).where("slot IS NOT NULL").orderBy("position").select("row.*")
