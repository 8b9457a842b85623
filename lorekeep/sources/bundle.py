"""Bundles: a zip of store files with a manifest of their SHA-256 sums; backups."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import guarded

SCHEMA_VERSION = 2


def pack_bundle(files: DataFrame, project: str) -> DataFrame:
    """One row, ``name, content``: a zip of ``path, content`` rows of one project's store (a few small files) and its manifest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((p, bytes(c), s) for f in frames for p, c, s in zip(f["path"], f["content"], f["sha256"], strict=True))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            manifest = {"schemaVersion": SCHEMA_VERSION, "project": project, "files": [{"path": p, "sha256": s, "bytes": len(c)} for p, c, s in rows]}
            for name, body in [("manifest.json", json.dumps(manifest).encode()), *((p, c) for p, c, _ in rows)]:
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
        yield pd.DataFrame({"name": [f"{project}.zip"], "content": [out.getvalue()]})

    summed = files.select("path", "content", F.sha2("content", 256).alias("sha256"))
    return summed.repartition(1).mapInPandas(run, "name string, content binary")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """``bundle, path, content, expected, error`` of all entries; unsafe names and newer schemas are errors, not rows to import."""
    return unpacked(spark.read.format("binaryFile").load(guarded(path)).select("path", "content"))


def unpacked(zips: DataFrame) -> DataFrame:
    """The entries of bundles given as ``path, content``; see :func:`read_bundles`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for bundle, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        manifest = json.loads(z.read("manifest.json"))
                        if int(manifest.get("schemaVersion", 0)) > SCHEMA_VERSION:
                            raise ValueError("E_SCHEMA_NEWER")
                        sums = {f["path"]: f["sha256"] for f in manifest["files"]}
                        for name in z.namelist():
                            if name == "manifest.json":
                                continue
                            bad = name.startswith("/") or "\\" in name or ".." in name.split("/")
                            rows.append((bundle, name, None if bad else z.read(name), sums.get(name), "E_UNSAFE_PATH" if bad else None))
                        rows += [(bundle, name, None, s, "E_MISSING") for name, s in sums.items() if name not in z.namelist()]
                except (KeyError, ValueError, zipfile.BadZipFile) as e:
                    rows.append((bundle, None, None, None, str(e) if str(e).startswith("E_") else "E_BAD_BUNDLE"))
            yield pd.DataFrame(rows, columns=["bundle", "path", "content", "expected", "error"])

    return zips.mapInPandas(run, "bundle string, path string, content binary, expected string, error string")


def verified(entries: DataFrame) -> DataFrame:
    """Entries with ``ok``: no error, and the content's sum is the manifest's."""
    return entries.withColumn("ok", F.col("error").isNull() & F.coalesce(F.sha2("content", 256) == F.col("expected"), F.lit(False)))


def stale_backups(backups: DataFrame, keep_last: int) -> DataFrame:
    """Backups (``name, created_ms``) that go: all but the newest ``keep_last``."""
    keep = backups.orderBy(F.desc("created_ms"), F.desc("name")).limit(keep_last)
    return backups.join(keep.select("name"), "name", "left_anti")
