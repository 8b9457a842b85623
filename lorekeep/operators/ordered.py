"""Ranks and running sums over a global order, and cut lineage: what several operators share."""

from __future__ import annotations

import atexit
import tempfile
from contextlib import suppress
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lorekeep-"))
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes when this process ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid4().hex}"

    def remove(jvm=spark.sparkContext._jvm, conf=spark.sparkContext._jsc.hadoopConfiguration()) -> None:
        with suppress(Exception):  # the gateway may be closed by then
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(conf).delete(where, True)

    atexit.register(remove)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in the global order, with the number ``_part`` of their range; written once, for two readers must see the same ranges."""
    return cut(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its rank, from 1, in ``order``: ranges are sorted where they are, and only a row a range is summed up."""
    dealt = _dealt(df, order)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") - F.col("_first") + 1).alias("_shift"))
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def running(df: DataFrame, order: list[Column], size: str) -> DataFrame:
    """``df`` with ``_used``, the sum of ``size`` up to and with the row in ``order``."""
    dealt = _dealt(df, order)
    sums = dealt.groupBy("_part").agg(F.sum(size).alias("_n"))
    starts = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.sum(size).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_within", within).join(F.broadcast(starts), "_part").withColumn("_used", F.col("_within") + F.col("_before")).drop("_part", "_at", "_within", "_before")


def previous(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the ``value`` of the row before in ``order`` among those of equal keys; keys of very many rows are spread over ranges."""
    rows = ranked(df, [*map(F.col, keys), *order], "_r")
    before = rows.select((F.col("_r") + 1).alias("_r"), F.struct(*keys).alias("_k"), F.col(value).alias(name))
    told = rows.join(before, "_r", "left").withColumn(name, F.when(F.struct(*keys).eqNullSafe(F.col("_k")), F.col(name)))
    return told.drop("_r", "_k")


def next_marked(df: DataFrame, key: str, order: list[Column], mark: Column, name: str) -> DataFrame:
    """``df`` with ``name``: how many rows on, in ``order`` among those of equal keys, the first later row is for which ``mark`` holds (null: none is).

    Ranges are looked through where they are, from their ends, for a window that reaches on to the end is summed up anew for each row; of keys that reach over several ranges, of which there are at most two a range, a number a range is summed up.
    """
    dealt = cut(_dealt(df, [F.col(key), *order]).withColumn("_mark", F.coalesce(mark, F.lit(False))))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") - F.col("_first") + 1).alias("_shift"))
    rows = dealt.join(F.broadcast(starts), "_part").withColumn("_g", F.col("_at") + F.col("_shift"))
    marked = F.when(F.col("_mark"), F.col("_g"))
    here = F.min(marked).over(Window.partitionBy("_part", key).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1))
    spans = rows.groupBy(F.col(key).alias("_key"), "_part").agg(F.min(marked).alias("_least"))
    several = spans.groupBy("_key").agg(F.count("*").alias("_c")).where("_c > 1")
    over = spans.join(several.withColumnRenamed("_key", "_s"), F.col("_key").eqNullSafe(F.col("_s")), "left_semi")
    later = F.min("_least").over(Window.partitionBy("_key").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))
    later = over.select(F.col("_part").alias("_p"), "_key", later.alias("_later"))
    told = rows.withColumn("_here", here).join(F.broadcast(later), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return told.withColumn(name, F.coalesce("_here", "_later") - F.col("_g")).drop("_part", "_at", "_shift", "_g", "_mark", "_here", "_p", "_key", "_later")
