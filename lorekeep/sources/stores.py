"""Knowledge stores: JSON lines and JSON documents of one or many projects, read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The record schemas.
SOURCE = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("fingerprint", T.StringType()), ("sessionId", T.StringType()), ("supersedes", T.StringType()), ("editedBy", T.StringType()), ("grounded", T.BooleanType()), ("evidence", T.StringType()))])
MEMORY = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("importance", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("status", T.StringType()),
    T.StructField("source", SOURCE), T.StructField("relatedFiles", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("createdAt", T.LongType()), T.StructField("updatedAt", T.LongType()), T.StructField("lastAccessedAt", T.LongType()), T.StructField("accessCount", T.IntegerType()),
    T.StructField("pinned", T.BooleanType()), T.StructField("supersededBy", T.StringType()),
])
TODO = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("status", T.StringType()), T.StructField("priority", T.StringType()), T.StructField("relatedFiles", T.ArrayType(T.StringType())), T.StructField("createdAt", T.LongType()), T.StructField("updatedAt", T.LongType())])
EVENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("eventType", T.StringType()), T.StructField("occurredAt", T.LongType()), T.StructField("detail", T.StringType()), T.StructField("sessionId", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("messageCount", T.IntegerType()), T.StructField("files", T.ArrayType(T.StringType()))])
VECTOR = T.StructType([T.StructField("memoryId", T.StringType()), T.StructField("contentHash", T.StringType()), T.StructField("modelKey", T.StringType()), T.StructField("dimensions", T.IntegerType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("updatedAt", T.LongType())])
FILES = {"memory.jsonl": MEMORY, "todo.jsonl": TODO, "timeline.jsonl": EVENT, "cache/embeddings.jsonl": VECTOR}
# What the records may say.
MEMORY_TYPES = ("decision", "requirement", "architecture", "bug", "issue", "lesson", "change", "context", "preference")
TODO_STATUSES = ("pending", "in_progress", "blocked", "done", "cancelled")
TODO_PRIORITIES = ("low", "medium", "high", "urgent")


def guarded(path: str) -> str:
    """The path, unless it is empty, a root, holds NUL or climbs out of its folder."""
    body = path.split("://", 1)[-1]
    if not body.strip("/ ") or "\0" in path or ".." in body.replace("\\", "/").split("/") or (len(body) <= 3 and body[1:2] == ":"):
        raise ValueError(f"unsafe path: {path!r}")
    return path.rstrip("/")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, keep_bad: bool = False) -> DataFrame:
    """Rows of JSON lines; a byte-order mark and blank lines are skipped, bad lines dropped or kept as ``_corrupt_record``."""
    if keep_bad:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(guarded(path))
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(guarded(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON document; one that can't be parsed gives a row with ``_corrupt_record``."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(guarded(path))


def read_store(spark: SparkSession, root: str, projects: str = "*") -> dict[str, DataFrame]:
    """All record files under ``root/<project>``, each with its ``project_id``; missing files are empty tables."""
    out = {}
    for name, schema in FILES.items():
        pattern = f"{guarded(root)}/{projects}/{name}"
        try:
            rows = read_jsonl(spark, pattern, schema)
            rows = rows.withColumn("project_id", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/" + name + "(?:/|$)", 1))
        except Exception as e:  # the pattern meets no file
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("project_id", T.StringType())]))
        out[name.rsplit("/", 1)[-1].removesuffix(".jsonl")] = rows
    return out


def normalised_memories(rows: DataFrame) -> DataFrame:
    """Defaults and bounds of memory records: known types else null, scores within 0 and 1, titles to 200, 20 files, 10 tags."""
    kind = F.lower(F.trim("type"))
    bounded = lambda c, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(d))))
    filled = lambda c, n: F.when(F.size(c) > 0, F.slice(F.array_distinct(F.col(c)), 1, n))
    return rows.withColumns({
        "type": F.when(kind.isin(*MEMORY_TYPES), kind), "title": F.substring(F.coalesce("title", F.lit("")), 1, 200), "content": F.coalesce("content", F.lit("")),
        "importance": bounded("importance", 0.5), "confidence": bounded("confidence", 0.7), "status": F.coalesce("status", F.lit("active")),
        "relatedFiles": filled("relatedFiles", 20), "tags": filled("tags", 10),
    })


def normalised_todos(rows: DataFrame) -> DataFrame:
    """Defaults of todo records: unknown statuses are pending, unknown priorities medium."""
    status, priority = F.lower(F.trim("status")), F.lower(F.trim("priority"))
    return rows.withColumns({"status": F.when(status.isin(*TODO_STATUSES), status).otherwise("pending"), "priority": F.when(priority.isin(*TODO_PRIORITIES), priority).otherwise("medium"), "title": F.substring(F.coalesce("title", F.lit("")), 1, 200)})


def append(rows: DataFrame, path: str) -> None:
    """Append rows as new files; nothing that is there is rewritten."""
    rows.write.mode("append").json(guarded(path))


def overwrite(rows: DataFrame, path: str, version: int) -> str:
    """Write a new version beside the old ones and return its path; a reader of the old one isn't disturbed."""
    target = f"{guarded(path)}/v={version}"
    rows.write.mode("errorifexists").json(target)
    return target


def archive_then_shrink(rows: DataFrame, evict: str, archive: str, path: str, version: int) -> str:
    """Rows marked by ``evict`` go to the archive first, then the rest becomes the new version."""
    append(rows.where(F.col(evict)).drop(evict), archive)
    return overwrite(rows.where(~F.col(evict)).drop(evict), path, version)


def pending_vectors(memories: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Memories whose text has no valid vector of this model."""
    valid = cache.where((F.col("modelKey") == model) & (F.size("vector") == F.col("dimensions"))).select(F.col("memoryId").alias("id"), F.col("contentHash").alias("content_hash"))
    hashed = memories.withColumn("content_hash", F.sha2(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).cast("binary"), 256))
    return hashed.join(valid, ["id", "content_hash"], "left_anti")


def collect_garbage(cache: DataFrame, memories: DataFrame) -> DataFrame:
    """Vectors whose memory still exists."""
    return cache.join(memories.select(F.col("id").alias("memoryId")), "memoryId", "left_semi")
