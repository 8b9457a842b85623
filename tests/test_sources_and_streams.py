"""Stores, source trees, git objects, bundles and streams on files made here."""

import hashlib
import json
import zlib

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import bundle, files, git, stack, stores
from lorekeep.streaming import jobs


def test_guard():
    for bad in ("", "/", "a/../b", "x\0y", "C:\\"):
        with pytest.raises(ValueError):
            stores.guarded(bad)


def test_store_round_trip(spark, tmp_path):
    p = tmp_path / "brains" / "alpha"
    p.mkdir(parents=True)
    lines = ["\ufeff" + json.dumps({"id": "m1", "type": "Decision ", "title": "t" * 300, "content": "c", "importance": 7, "tags": []}), "", "{broken", json.dumps({"id": "m2", "type": "odd", "confidence": -1, "relatedFiles": ["a", "a", "b"]})]
    (p / "memory.jsonl").write_text("\n".join(lines), encoding="utf-8")
    store = stores.read_store(spark, str(tmp_path / "brains"))
    assert store["todo"].count() == 0
    rows = {r.id: r for r in stores.normalised_memories(store["memory"]).collect()}
    assert set(rows) == {"m1", "m2"} and rows["m1"].project_id == "alpha"
    assert (rows["m1"].type, len(rows["m1"].title), rows["m1"].importance, rows["m1"].tags) == ("decision", 200, 1.0, None)
    assert (rows["m2"].type, rows["m2"].confidence, rows["m2"].status, rows["m2"].relatedFiles) == (None, 0.0, "active", ["a", "b"])
    path = stores.archive_then_shrink(store["memory"].withColumn("gone", F.col("id") == "m1"), "gone", str(tmp_path / "archive"), str(tmp_path / "new"), 1)
    assert [r.id for r in stores.read_jsonl(spark, path, stores.MEMORY).collect()] == ["m2"]
    assert [r.id for r in stores.read_jsonl(spark, str(tmp_path / "archive"), stores.MEMORY).collect()] == ["m1"]
    todo = stores.normalised_todos(spark.createDataFrame([("1", "t", "DONE", "x")], "id string, title string, status string, priority string")).first()
    assert (todo.status, todo.priority) == ("done", "medium")


def test_vector_cache(spark):
    memories = spark.createDataFrame([("a", "t", "c"), ("b", "t", "d")], "id string, title string, content string")
    good = hashlib.sha256(b"t\nc").hexdigest()
    cache = spark.createDataFrame([("a", good, "m", 2, [1.0, 2.0]), ("z", "x", "m", 1, [1.0])], "memoryId string, contentHash string, modelKey string, dimensions int, vector array<double>")
    assert [r.id for r in stores.pending_vectors(memories, cache, "m").collect()] == ["b"]
    assert [r.memoryId for r in stores.collect_garbage(cache, memories).collect()] == ["a"]


def test_source_tree(spark, tmp_path):
    for name, body in {
        "package.json": '{"dependencies": {"express": "1", "react": "1", "next": "1"}}', "src/index.ts": "import { a } from './lib/a'\nexport function main() {}\napp.get('/users', h)\n",
        "src/lib/a.ts": "export const go = () => 1\nimport x from '../index'\n", "api/main.py": "import os\nfrom app.db import Base\nclass User(Base):\n  pass\n@app.post(\"/items\")\ndef create():\n  pass\n",
        "node_modules/x/y.js": "no", "requirements.txt": "Flask==2\nfastapi\n",
    }.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(body)
    tree = files.scan(spark, str(tmp_path / "tree"))
    assert {r.path for r in tree.collect()} == {"package.json", "src/index.ts", "src/lib/a.ts", "api/main.py", "requirements.txt"}
    assert {tuple(r) for r in files.language_counts(tree).collect()} == {("TypeScript", 2), ("Python", 1)}
    code = files.code(tree)
    rows = {r.path: r for r in code.collect()}
    assert rows["src/index.ts"].imports == ["./lib/a"] and rows["src/index.ts"].symbols == ["main"] and rows["src/lib/a.ts"].symbols == ["go"]
    assert rows["api/main.py"].imports == ["os", "app.db"] and rows["api/main.py"].symbols == ["User", "create"]
    assert {tuple(r) for r in files.endpoints(code).collect()} == {("GET", "/users", "src/index.ts", 3), ("POST", "/items", "api/main.py", 5)}
    assert {(r.name, r.framework) for r in files.models(code).collect()} == {("User", "sqlalchemy")}
    assert {tuple(r) for r in files.resolve_imports(code).collect()} == {("src/index.ts", "src/lib/a.ts"), ("src/lib/a.ts", "src/index.ts")}
    manifests = tree.where(F.col("ext").isin("json", "txt", "toml")).select(F.lit("p").alias("project"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.decode("content", "UTF-8").alias("text"))
    found = stack.stack(manifests)
    assert {tuple(r)[1:] for r in found.collect()} == {("framework-fullstack", "Next.js"), ("framework-backend", "Express"), ("framework-frontend", "React"), ("framework-backend", "FastAPI")}
    more = spark.createDataFrame([("q", "go.mod", "module x\nrequire github.com/labstack/echo v4\nrequire gorm.io/gorm v1"), ("q", "pyproject.toml", '[project]\ndependencies = ["torch>=2", "numpy"]\n[tool.x]\npandas = "2"'), ("r", "package.json", "{broken")], "project string, name string, text string")
    assert {tuple(r) for r in stack.stack(more).collect()} == {("q", "framework-backend", "Echo"), ("q", "orm", "GORM"), ("q", "ai", "PyTorch"), ("q", "ai", "NumPy"), ("q", "ai", "pandas")}
    assert {(r.value, r["rank"]) for r in stack.by_projects(found.unionByName(stack.stack(more)).unionByName(found.withColumn("project", F.lit("z")))).where("field = 'framework-backend'").collect()} == {("Express", 1), ("FastAPI", 2), ("Echo", 3)}
    uses = code.select(F.lit("p").alias("project"), "path", F.explode("imports").alias("import"))
    assert {tuple(r) for r in stack.unknown_imports(uses, manifests).collect()} == {("p", "os", 1), ("p", "app", 1)}
    paths = spark.createDataFrame([("src/main.ts", "modified"), ("src/x.ts", "modified"), ("src/x.ts", "added"), ("README.md", "added"), ("package.json", "modified"), ("tests/a.ts", "added"), ("dist/index.js", "added")], "path string, change string")
    assert [r.t for r in paths.select(files.changes_architecture(F.col("path"), F.col("change")).alias("t")).collect()] == [True, False, True, False, True, False, False]
    assert {(r.role, r.files) for r in files.roles_of(tree).collect()} == {("interface", 1), ("domain", 4)}
    marks = tree.select("path", files.role(F.col("path")).alias("role"), files.evidence_priority(F.col("path"), F.lit(False)).alias("p")).collect()
    assert {r.path: r.role for r in marks}["api/main.py"] == "interface" and {r.path: r.p for r in marks}["src/index.ts"] == 57


def make_object(kind, body):
    raw = f"{kind} {len(body)}".encode() + b"\0" + body
    return hashlib.sha1(raw).hexdigest(), zlib.compress(raw)


def entry(kind, body, extra=b""):
    size, head = len(body), bytearray()
    byte, size = kind << 4 | size & 15, size >> 4
    while size:
        head.append(byte | 0x80)
        byte, size = size & 0x7F, size >> 7
    head.append(byte)
    return bytes(head) + extra + zlib.compress(body)


def test_git(spark, tmp_path):
    folder = tmp_path / "g"
    blob, loose_blob = make_object("blob", b"hello\n")
    tree_body = b"100644 a.txt\0" + bytes.fromhex(blob) + b"160000 sub\0" + b"\1" * 20
    tree, loose_tree = make_object("tree", tree_body)
    commit, loose_commit = make_object("commit", f"tree {tree}\nparent {'1' * 40}\nauthor A B <a@b> 1700000000 +0000\ncommitter A B <a@b> 1700000001 +0000\n\nSubject line\n\nbody".encode())
    for name, raw in ((blob, loose_blob), (tree, loose_tree), (commit, loose_commit)):
        (folder / "objects" / name[:2]).mkdir(parents=True, exist_ok=True)
        (folder / "objects" / name[:2] / name[2:]).write_bytes(raw)
    base = b"0123456789" * 20
    target = base[10:90] + b"NEW" + base[:50]
    delta = bytes([200 & 0x7F | 0x80, 1, len(target) & 0x7F | 0x80, len(target) >> 7]) + bytes([0x91, 10, 80]) + b"\3NEW" + bytes([0x90, 50])
    assert git.apply_delta(base, delta) == target
    first = entry(3, base)
    back = len(first)
    assert back < 128
    pack = b"PACK" + (2).to_bytes(4, "big") + (3).to_bytes(4, "big") + first + entry(6, delta, bytes([back])) + entry(7, delta, hashlib.sha1(b"blob 200\0" + base).digest())
    (folder / "objects" / "pack").mkdir()
    (folder / "objects" / "pack" / "p.pack").write_bytes(pack + hashlib.sha1(pack).digest())
    second = target + b"!"
    across = bytes([len(target) & 0x7F | 0x80, len(target) >> 7, len(second) & 0x7F | 0x80, len(second) >> 7, 0x90, len(target), 1]) + b"!"
    name = hashlib.sha1(f"blob {len(target)}".encode() + b"\0" + target).digest()
    other = b"PACK" + (2).to_bytes(4, "big") + (1).to_bytes(4, "big") + entry(7, across, name)
    (folder / "objects" / "pack" / "q.pack").write_bytes(other + hashlib.sha1(other).digest())
    rows = git.objects(spark, str(folder))
    got = {r.hash: (r.kind, bytes(r.body)) for r in rows.collect()}
    assert got[blob] == ("blob", b"hello\n") and got[hashlib.sha1(f"blob {len(target)}".encode() + b"\0" + target).hexdigest()] == ("blob", target) and len(got) == 6
    assert got[hashlib.sha1(f"blob {len(second)}".encode() + b"\0" + second).hexdigest()] == ("blob", second)
    c = git.commits(rows).first()
    assert (c.hash, c.tree, c.parent, c.author, c.author_s, c.subject) == (commit, tree, "1" * 40, "A B", 1_700_000_000, "Subject line")
    assert [(r.path, r.hash) for r in git.tree_files(git.tree_entries(rows), git.commits(rows)).collect()] == [("a.txt", blob)]
    (folder / "refs" / "heads").mkdir(parents=True)
    (folder / "refs" / "heads" / "main").write_text("a" * 40 + "\n")
    (folder / "packed-refs").write_text("# pack-refs\n" + "b" * 40 + " refs/heads/main\n" + "c" * 40 + " refs/tags/v1\n")
    assert {tuple(r) for r in git.references(spark, str(folder)).collect()} == {("refs/heads/main", "a" * 40), ("refs/tags/v1", "c" * 40)}


def test_bundles(spark, tmp_path):
    import io
    import zipfile

    made = bundle.pack_bundle(spark.createDataFrame([("memory.jsonl", b"{}"), ("todo.jsonl", b"[]")], "path string, content binary").select("path", F.col("content").cast("binary").alias("content")), "alpha").first()
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "good.zip").write_bytes(bytes(made.content))
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("manifest.json", json.dumps({"schemaVersion": 2, "files": [{"path": "a", "sha256": "0"}, {"path": "gone", "sha256": "0"}]}))
        z.writestr("a", "tampered")
        z.writestr("../evil", "x")
    (tmp_path / "z" / "bad.zip").write_bytes(bad.getvalue())
    (tmp_path / "z" / "torn.zip").write_bytes(b"nope")
    got = {(r.bundle.rsplit("/", 1)[-1], r.path): (r.ok, r.error) for r in bundle.verified(bundle.read_bundles(spark, str(tmp_path / "z"))).collect()}
    assert got == {("good.zip", "memory.jsonl"): (True, None), ("good.zip", "todo.jsonl"): (True, None), ("bad.zip", "a"): (False, None), ("bad.zip", "../evil"): (False, "E_UNSAFE_PATH"), ("bad.zip", "gone"): (False, "E_MISSING"), ("torn.zip", None): (False, "E_BAD_BUNDLE")}
    backups = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, created_ms long")
    assert [r.name for r in bundle.stale_backups(backups, 2).collect()] == ["a"]


def test_stream_sinks_and_gates(spark, tmp_path):
    rows = spark.createDataFrame([(1, t, "user", "x") for t in range(9)] + [(2, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert {r.conv_id for r in jobs.finished(jobs.summary_gate(stream())).collect()} == {1}
    jobs.to_store(stream(), lambda b: b.where("turn > 6"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def limited(rows, most, window_ms):
    """By brute force: per user the accepted times, in order."""
    kept, open_ = [], {}
    for user, t in sorted(rows, key=lambda r: r[1]):
        start, used = open_.get(user, (None, 0))
        if start is None or t - start >= window_ms:
            start, used = t, 0
        if used < most:
            used += 1
            kept.append((user, t))
        open_[user] = start, used
    return sorted(kept)


def written_backwards(spark, path, files, step_ms):
    """Events in files that are read latest times first."""
    import os
    import random

    import pandas as pd

    rng, rows, base = random.Random(4), [], 1_700_000_000_000
    os.makedirs(path)
    for f in range(files):
        own = [(rng.randint(0, 2), base - f * step_ms + rng.randrange(2 * step_ms)) for _ in range(6)]
        rows += own
        pd.DataFrame({"user_id": [u for u, _ in own], "ts": pd.to_datetime([t for _, t in own], unit="ms").astype("datetime64[us]")}).to_parquet(f"{path}/f{f:03}.parquet")
        os.utime(f"{path}/f{f:03}.parquet", (1_700_000_000 + f, 1_700_000_000 + f))
    return rows


def test_limits_over_batches_out_of_order(spark, tmp_path):
    from lorekeep.plans import streams

    rows = written_backwards(spark, str(tmp_path / "events.parquet"), 66, 3 * 3_600_000)
    for name, most, hours in (("stream_throttled", 1, 6), ("stream_rate_limited", 2, 24)):
        got = sorted((r.user_id, r.ms) for r in streams.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == limited(rows, most, hours * 3_600_000), name


def test_limits_tell_once_what_the_watermark_has_passed(spark, tmp_path):
    rows = written_backwards(spark, str(tmp_path / "e"), 6, 60_000)
    stream = jobs.rate_limited(jobs.events_stream(spark, str(tmp_path / "e"), 1), "user_id", 2, 240_000, "1 hour")
    told = jobs.finished(stream, "update")
    assert told.where("certain").count() == 0 and sorted((r.user_id, r.ms) for r in jobs.latest(told, "user_id").collect()) == limited(rows, 2, 240_000)
    forward = [(1, 1_700_000_000_000 + 60_000 * i) for i in range(6)]
    for i, (u, t) in enumerate(forward):
        import os

        import pandas as pd

        os.makedirs(tmp_path / "f", exist_ok=True)
        pd.DataFrame({"user_id": [u], "ts": pd.to_datetime([t], unit="ms").astype("datetime64[us]")}).to_parquet(str(tmp_path / "f" / f"{i}.parquet"))
        os.utime(tmp_path / "f" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    told = jobs.finished(jobs.throttled(jobs.events_stream(spark, str(tmp_path / "f"), 1), "user_id", 120_000, "1 minute"), "update")
    assert sorted((r.user_id, r.ms) for r in jobs.latest(told, "user_id").collect()) == limited(forward, 1, 120_000)
    certain = [r.ms for r in told.where("certain").collect()]
    assert certain and len(certain) == len(set(certain))


def test_infrastructure(spark):
    rows = [
        ("a", "build.gradle.kts", "spring-framework hibernate", 1), ("a", "pom.xml", "spring-boot-starter", 1), ("a", "pom.xml", "spring-boot-starter", 1), ("a", "App.csproj", None, 1),
        ("b", "pubspec.yaml", "name: x\ndependencies:\n  flutter:\n    sdk: flutter", 1), ("b", "build.sbt", None, 1), ("b", "x.scala", "", 1), ("b", "Cargo.toml", "", 1),
        ("c", "pubspec.yaml", "name: x", 1), ("c", "x.scala", None, 1), ("c", "Cargo.toml", None, 1), ("c", "Dockerfile.dev", None, 1), ("c", None, "FROM nginx", 1), ("c", "Chart.yaml", "", 1),
    ]
    df = spark.createDataFrame(rows, "project string, name string, text string, field int")
    assert sorted(tuple(r) for r in stack.infrastructure(df).collect()) == [
        ("a", "framework-backend", ".NET"), ("a", "framework-backend", "Kotlin"), ("a", "framework-backend", "Spring Boot"), ("a", "orm", "Hibernate"),
        ("b", "framework-backend", "Rust"), ("b", "framework-backend", "Scala (sbt)"), ("b", "mobile", "Flutter"),
        ("c", "container", "Docker"), ("c", "framework-backend", "Dart"), ("c", "framework-backend", "Scala"), ("c", "iac", "Helm"),
    ]
    assert stack.infrastructure(df.limit(0)).count() == 0
