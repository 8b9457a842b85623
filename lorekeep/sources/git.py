"""Git objects as tables: loose objects, packs with deltas, commits, trees, references.

Implemented from the published formats. Objects of one pack are decoded in one task, since deltas
point into it; packs and loose files spread over tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import cut
from .stores import guarded

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}


def loose(raw: bytes) -> tuple[str, bytes]:
    """(kind, body) of a loose object's file."""
    head, _, body = zlib.decompress(raw).partition(b"\0")
    kind, _, size = head.decode("ascii").partition(" ")
    if int(size) != len(body):
        raise ValueError("a loose object's size is wrong")
    return kind, body


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The target of a delta: copies from the base and inserts."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = delta[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if not byte & 0x80:
                return value

    if number() != len(base):
        raise ValueError("a delta's base has another size")
    size, out = number(), bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            fields = []
            for mask in (op & 0x0F, op >> 4 & 0x07):
                value = 0
                for k in range(4):
                    if mask >> k & 1:
                        value |= delta[at] << 8 * k
                        at += 1
                fields.append(value)
            start, length = fields[0], fields[1] or 0x10000
            out += base[start : start + length]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("a delta holds a reserved byte")
    if len(out) != size:
        raise ValueError("a delta's target has another size")
    return bytes(out)


def unpack(raw: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(hash, kind, body) of all objects of a pack file."""
    if raw[:4] != b"PACK" or int.from_bytes(raw[4:8], "big") not in (2, 3):
        raise ValueError("not a pack")
    at, done, names, waiting = 12, {}, {}, []
    for _ in range(int.from_bytes(raw[8:12], "big")):
        start, byte = at, raw[at]
        at += 1
        kind, shift = byte >> 4 & 7, 4
        while byte & 0x80:
            byte = raw[at]
            at += 1
            shift += 7
        base: int | str | None = None
        if kind == 6:
            byte = raw[at]
            at += 1
            back = byte & 0x7F
            while byte & 0x80:
                byte = raw[at]
                at += 1
                back = (back + 1) << 7 | byte & 0x7F
            base = start - back
        elif kind == 7:
            base, at = raw[at : at + 20].hex(), at + 20
        stream = zlib.decompressobj()
        body = stream.decompress(raw[at:]) + stream.flush()
        at = len(raw) - len(stream.unused_data)
        waiting.append((start, kind, base, body))
    while waiting:
        left = []
        for start, kind, base, body in waiting:
            if kind not in KINDS:
                found = done.get(base if isinstance(base, int) else names.get(base))
                if found is None:
                    left.append((start, kind, base, body))
                    continue
                name, body = found[0], apply_delta(found[1], body)
            else:
                name = KINDS[kind]
            done[start] = (name, body)
            digest = hashlib.sha1(f"{name} {len(body)}\0".encode() + body).hexdigest()
            names[digest] = start
            yield digest, name, body
        if len(left) == len(waiting):
            # What is left has its base in another pack: named by it, or by an object of this pack that waits for it.
            for start, _, base, body in left:
                yield (f"{start}<{base}" if isinstance(base, str) else f"{start}<@{base}"), "delta", body
            return
        waiting = left


def objects(spark: SparkSession, git_dir: str) -> DataFrame:
    """``hash, kind, body`` of all loose and packed objects."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{guarded(git_dir)}/objects")
    files = files.where(F.col("path").rlike(r"/objects/[0-9a-f]{2}/[0-9a-f]{38}$|\.pack$"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if path.endswith(".pack"):
                    rows += list(unpack(bytes(content)))
                else:
                    rows.append(("".join(path.split("/")[-2:]), *loose(bytes(content))))
            yield pd.DataFrame(rows, columns=["hash", "kind", "body"])

    rows = cut(files.select("path", "content").mapInPandas(run, "hash string, kind string, body binary"))
    done = rows.where("kind <> 'delta'").select("hash", "kind", "body").dropDuplicates(["hash"])
    left = rows.where("kind = 'delta'")
    # Deltas on objects of other packs: each round resolves those whose base is known by now.
    while not left.isEmpty():
        named = left.select("hash", "body", F.regexp_extract("hash", "<([0-9a-f]{40})$", 1).alias("_base"))
        met = named.join(done.select(F.col("hash").alias("_base"), F.col("kind").alias("_kind"), F.col("body").alias("_from")), "_base")
        new = cut(met.select("_kind", "_from", "body").mapInPandas(_applied, "hash string, kind string, body binary").dropDuplicates(["hash"]).join(done.select("hash"), "hash", "left_anti"))
        known = cut(met.select("hash").distinct())
        if known.isEmpty():
            raise ValueError("a delta's base is in no pack")
        left = cut(left.join(known, "hash", "left_anti"))
        done = done.unionByName(new)
    return done


def _applied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Objects from deltas and their bases."""
    for frame in frames:
        rows = []
        for kind, base, delta in zip(frame["_kind"], frame["_from"], frame["body"], strict=True):
            body = apply_delta(bytes(base), bytes(delta))
            rows.append((hashlib.sha1(f"{kind} {len(body)}\0".encode() + body).hexdigest(), kind, body))
        yield pd.DataFrame(rows, columns=["hash", "kind", "body"])


def commits(rows: DataFrame) -> DataFrame:
    """``hash, tree, parent`` (the first), author and time in seconds, subject."""
    text = F.decode("body", "UTF-8")
    found = rows.where("kind = 'commit'").select("hash", text.alias("t"))
    part = lambda p: F.nullif(F.regexp_extract("t", p, 1), F.lit(""))
    return found.select(
        "hash", part(r"(?m)^tree ([0-9a-f]{40})").alias("tree"), part(r"(?m)^parent ([0-9a-f]{40})").alias("parent"), part(r"(?m)^author (.*?) <").alias("author"),
        part(r"(?m)^author .*> (\d+)").cast("long").alias("author_s"), part(r"\n\n([^\n]*)").alias("subject"),
    )


def tree_entries(rows: DataFrame) -> DataFrame:
    """``tree, mode, name, hash`` of all trees' entries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for tree, body in zip(frame["hash"], frame["body"], strict=True):
                body, at = bytes(body), 0
                while at < len(body):
                    gap = body.index(b"\0", at)
                    mode, _, name = body[at:gap].decode("utf-8", "replace").partition(" ")
                    out.append((tree, mode, name, body[gap + 1 : gap + 21].hex()))
                    at = gap + 21
            yield pd.DataFrame(out, columns=["tree", "mode", "name", "hash"])

    return rows.where("kind = 'tree'").select("hash", "body").mapInPandas(run, "tree string, mode string, name string, hash string")


def tree_files(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, path, hash`` of the files below each root tree, however deep; submodules and node_modules are left out."""
    level = roots.select(F.col("tree").alias("root"), F.col("tree").alias("at"), F.lit("").alias("prefix")).distinct()
    found = None
    useful = entries.where("mode <> '160000' and name <> 'node_modules'")
    while True:
        here = level.join(useful, level["at"] == useful["tree"]).select("root", F.concat("prefix", "name").alias("path"), "mode", "hash")
        files = here.where("mode not in ('40000', '040000')").select("root", "path", "hash")
        found = files if found is None else found.unionByName(files)
        level = cut(here.where("mode in ('40000', '040000')").select("root", F.col("hash").alias("at"), F.concat("path", F.lit("/")).alias("prefix")))
        if level.isEmpty():
            break
    return found


def references(spark: SparkSession, git_dir: str) -> DataFrame:
    """``name, hash``: loose references win over packed ones."""
    base = guarded(git_dir)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.col("path").rlike("/refs/|/packed-refs$"))
    text = files.select("path", F.decode("content", "UTF-8").alias("t"))
    loose_ = text.where(F.col("path").rlike("/refs/")).select(F.regexp_extract("path", r"/(refs/.+)$", 1).alias("name"), F.trim("t").alias("hash"), F.lit(0).alias("rank"))
    lines = text.where(F.col("path").endswith("/packed-refs")).select(F.explode(F.split("t", "\n")).alias("l")).where(F.col("l").rlike("^[0-9a-f]{40} "))
    packed = lines.select(F.regexp_extract("l", r"^\S+ (\S+)", 1).alias("name"), F.substring("l", 1, 40).alias("hash"), F.lit(1).alias("rank"))
    both = loose_.unionByName(packed).where(F.col("hash").rlike("^[0-9a-f]{40}"))
    return both.groupBy("name").agg(F.min_by(F.substring("hash", 1, 40), "rank").alias("hash"))
