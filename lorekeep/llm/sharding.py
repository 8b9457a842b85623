"""Operator 3: weighted rendezvous (highest random weight) sharding, DataFrame functions only.

Every shard ``s`` of weight ``w`` draws a uniform number ``u`` from the record's key and its own
number alone; the record goes to the shard with the least ``-ln(u) / w``. Adding a shard can only
pull records into the new one, and shards receive records in proportion to their weights.

Defined cases: a null key counts as the empty key; a null text has no bytes (size 8) and the CRC
of the empty text; equal keys share a shard; shards of weight 0 or less receive nothing; an empty
table gives an empty result. Other columns are passed through, but ``shard``,
``slot`` and ``grown_shard`` (and helper names with a leading underscore) are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_width

#: Hash digits that make one uniform number: 13 hex digits, 52 bits, exact in a double.
DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """The uniform number in (0, 1) that ``shard`` draws for ``key``."""
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def owner(scores: Sequence[Column]) -> Column:
    """The index of the least score; the lower index on ties."""
    return F.array_position(F.array(*scores), F.least(*scores) if len(scores) > 1 else scores[0]).cast("int") - 1


def rendezvous(key: Column, weights: Sequence[float]) -> list[Column]:
    """The scores of all shards for ``key``; a shard without weight scores infinity."""
    return [-F.ln(draw(key, s)) / F.lit(float(w)) if w > 0 else F.lit(float("inf")) for s, w in enumerate(weights)]


def shard_rows(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float = 1.0, order: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``shard``, ``grown_shard`` (with one more shard) and a gapless ``slot`` in its shard.

    Slots follow (key, then ``order``); rows equal in all of these are numbered in any order. The
    frame is range-partitioned by shard and key, so a shard spreads over many tasks and a key that
    holds a third of all rows is split by its row number; only a row per task and shard is summed up.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a weight over 0")
    df = df.drop(*({"shard", "grown_shard", "slot", "_scores", "_row", "_part", "_at", "_shift"} - {key, *order}))
    kept, name = list(df.columns), F.coalesce(F.col(key).cast("string"), F.lit(""))
    scored = df.select(*kept, F.array(*rendezvous(name, [*weights, grown_weight])).alias("_scores"))
    n = len(weights)
    old = F.slice("_scores", 1, n)
    placed = scored.select(
        *kept,
        (F.array_position(old, F.array_min(old)).cast("int") - 1).alias("shard"),
        (F.array_position("_scores", F.array_min("_scores")).cast("int") - 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    ranges = ["shard", key, *order, "_row"]
    # Checkpointed once: the two readers below must see the same partitions and places.
    dealt = cut(
        placed.repartitionByRange(shuffle_width(df.sparkSession), *ranges)
        .sortWithinPartitions(*ranges)
        .drop("_row")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    runs = dealt.groupBy("shard", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # At most (tasks + shards) rows, for each task holds a contiguous range.
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(F.broadcast(starts), ["shard", "_part"]).select(*kept, "shard", (F.col("_at") + F.col("_shift")).alias("slot"), "grown_shard")
