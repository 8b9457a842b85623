"""What several training-data operators share: cut lineage, batches of texts, clash-free names."""

from __future__ import annotations

import atexit
import gc
import tempfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lorekeep-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The files go when the frame is garbage collected, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows and the bytes of the Arrow batches that carry whole texts, and drop shuffle files when the query that made them ends.

    Operators run several queries one after the other, each of which ends in a checkpoint or a written table.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_row(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``columns``; no shuffle, rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.select(*columns).mapInArrow(run, schema)


def text_id(column: str = "text") -> list:
    """Two 64-bit hashes of a text (null: as empty), which together name its class of equal texts."""
    text = F.coalesce(F.col(column), F.lit(""))
    return [F.xxhash64(text).alias("id1"), F.xxhash64(F.lit("lorekeep"), text, F.length(text)).alias("id2")]


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder; the files go when this process ends."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid4().hex}"
    remove_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> Callable[[], None]:
    """Remove a table of the shared folder when this process ends, or when the function that is returned is called."""

    def remove(jvm=spark.sparkContext._jvm, conf=spark.sparkContext._jsc.hadoopConfiguration()) -> None:
        with suppress(Exception):  # the gateway may be closed by then; the folder is a temporary one
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)

    atexit.register(remove)
    return remove


def scratch_table(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """:func:`shared_table`, and a function to call once nothing reads it any more.

    That function removes the table and has both garbage collectors run, on which the engine drops the shuffle
    files and checkpoints of frames that are out of use; else they lie on the disks until a collection comes by.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid4().hex}"
    remove = remove_at_exit(spark, path)
    df.write.parquet(path)

    def release() -> None:
        remove()
        gc.collect()
        spark.sparkContext._jvm.System.gc()

    return spark.read.parquet(path), release


#: Bits of a filter of 64-bit names: 8 MB, whatever the input. It only saves shuffling; a join decides.
FILTER_BITS = 1 << 26


def bit_filter(names: DataFrame, column: str) -> np.ndarray:
    """Bytes with a bit set for the low bits of every name; see :func:`hits`."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            at = np.unique(b.column(0).to_numpy().astype(np.uint64) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at].astype(np.int32))], ["at", "byte"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            np.bitwise_or.at(seen, b.column("at").to_numpy(), b.column("byte").to_numpy().astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary())], ["bits"])

    # At most a row a byte of the map comes to the one task that folds it.
    told = names.select(column).mapInArrow(bits, "at long, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte"))
    got = told.repartition(1).mapInArrow(fold, "bits binary").collect()
    return np.frombuffer(zlib.decompress(got[0].bits), np.uint8) if got else np.zeros(FILTER_BITS // 8, np.uint8)


def hits(filter_: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of the names (int64 or uint64) may be in the filter."""
    at = (names.astype(np.uint64) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
