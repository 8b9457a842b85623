"""The local architecture of projects: components by role, their layers, relations and chains, from source facts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import ROLES, evidence_priority, role
from .chains import contracted

#: Files that a component shows, that are its evidence; names that tell what it is for; key files of a project.
IMPORTANT, EVIDENCE, NAMES, KEY_FILES = 6, 12, 5, 12
# Confidence of a component, and of a relation that is only the order of the layers.
SURE, GUESSED = 0.62, 0.42


def _facts(files: DataFrame) -> DataFrame:
    order = F.create_map(*(x for i, (name, _) in enumerate(ROLES) for x in (F.lit(name), F.lit(i))))
    told = files.withColumn("role", role(F.col("path"))).withColumn("priority", evidence_priority(F.col("path"), F.lit(False)))
    return told.withColumn("layer", order[F.col("role")])


def components(files: DataFrame) -> DataFrame:
    """``project, id, layer, files, important, evidence, technologies, purpose, confidence`` of source facts (``project, path, language, symbols``).

    A component is a role of a project's files; its files are in order of their priority as evidence, then by path. Lists are of a few
    members, taken from ranks, so a role of very many files meets in no task as a list.
    """
    facts = _facts(files)
    counted = facts.groupBy("project", "role", "layer").agg(F.count("*").alias("files"), F.array_sort(F.collect_set("language")).alias("technologies"))
    first = _first(facts.select("project", "role", "priority", "path", "symbols"), EVIDENCE)
    return counted.join(first, ["project", "role"]).select(
        "project", F.concat(F.lit("component-"), "role").alias("id"), "layer", "files", F.slice(F.transform("best", lambda x: x["path"]), 1, IMPORTANT).alias("important"), F.transform("best", lambda x: x["path"]).alias("evidence"),
        "technologies", F.array_join(F.slice(F.flatten(F.transform("best", lambda x: F.coalesce(x["symbols"], F.array().cast("array<string>")))), 1, NAMES), ", ").alias("purpose"), F.lit(SURE).alias("confidence"),
    )


def _first(rows: DataFrame, most: int) -> DataFrame:
    """``project, role, best``: the first rows of each role by priority and path; a range of paths first gives its own, so no role meets whole."""
    salted = rows.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(32)))
    w = Window.partitionBy("project", "role", "_part").orderBy(F.desc("priority"), "path")
    some = salted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    best = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "path", "symbols")))
    return some.groupBy("project", "role").agg(F.slice(best, 1, most).alias("best"))


def relations(parts: DataFrame) -> DataFrame:
    """``project, id, src, dst, confidence``: each component is taken to use the next one in the order of the layers."""
    w = Window.partitionBy("project").orderBy("layer", "id")  # of at most as many rows as there are roles
    told = parts.select("project", "id", "layer").withColumn("dst", F.lead("id").over(w)).withColumn("n", F.row_number().over(w)).where("dst is not null")
    return told.select("project", F.concat(F.lit("relation-local-"), F.col("n").cast("string")).alias("id"), F.col("id").alias("src"), "dst", F.lit(GUESSED).alias("confidence"))


def used(edges: DataFrame) -> DataFrame:
    """``src, dst, links``: what the import graph (``src, dst`` paths) says between the components of the paths."""
    paths = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return contracted(edges, paths.withColumn("group", F.concat(F.lit("component-"), role(F.col("node")))))


def key_files(files: DataFrame) -> DataFrame:
    """``project, path, role, rank``: the first files of a project as evidence."""
    facts = _facts(files)
    some = facts.withColumn("_r", F.row_number().over(Window.partitionBy("project", F.pmod(F.xxhash64("path"), F.lit(32))).orderBy(F.desc("priority"), "path"))).where(F.col("_r") <= KEY_FILES)
    w = Window.partitionBy("project").orderBy(F.desc("priority"), "path")
    return some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= KEY_FILES).select("project", "path", "role", "rank")


def flows(parts: DataFrame) -> DataFrame:
    """``project, component, step, action``: the main chain through the components of a project that has two and more."""
    w = Window.partitionBy("project").orderBy("layer", "id")
    told = parts.select("project", "id", "layer").withColumn("step", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("project"))).where("_n >= 2")
    action = F.when(F.col("step") == 1, "receive").when(F.col("step") == F.col("_n"), "complete").otherwise("pass on")
    return told.select("project", F.col("id").alias("component"), "step", action.alias("action"))


def fingerprints(files: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """``project, fingerprint, version, changed``: a hash of a project's files (``project, path, text, imports``); the version goes up where it differs from ``previous``'s."""
    one = F.sha2(F.concat_ws("\n", "path", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), F.array_join("imports", ",")).cast("binary"), 256)
    # sums of hashes are the same in any order, and merge
    part = lambda k: F.conv(F.substring("_h", 1 + 14 * k, 14), 16, 10).cast("decimal(38,0)")
    told = files.select("project", one.alias("_h")).groupBy("project").agg(F.count("*").alias("_n"), *(F.sum(part(k)).alias(f"_s{k}") for k in range(4)))
    now = told.select("project", F.sha2(F.concat_ws(",", "_n", *(F.col(f"_s{k}").cast("string") for k in range(4))).cast("binary"), 256).alias("fingerprint"))
    if previous is None:
        return now.withColumn("version", F.lit(1)).withColumn("changed", F.lit(True))
    old = previous.select("project", F.col("fingerprint").alias("_f"), F.col("version").alias("_v"))
    changed = ~F.col("fingerprint").eqNullSafe(F.col("_f"))
    return now.join(old, "project", "left").select("project", "fingerprint", (F.coalesce("_v", F.lit(0)) + F.when(changed, 1).otherwise(0)).alias("version"), changed.alias("changed"))
