"""Lenient JSON against a letter-by-letter reader, work trees against os.walk."""

import json
import os
import random

from lorekeep.functions import lenient
from lorekeep.sources import worktree
from lorekeep.sources.files import IGNORED_NAMES


def objects(text):
    """Balanced objects by walking from every brace that is not in an object already found."""
    out, start = [], 0
    while start < len(text):
        if text[start] == "{":
            depth, quoted, escaped = 0, False, False
            for i in range(start, len(text)):
                c = text[i]
                if quoted:
                    if escaped:
                        escaped = False
                    elif c == "\\":
                        escaped = True
                    elif c == '"':
                        quoted = False
                elif c == '"':
                    quoted = True
                elif c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                    if not depth:
                        out.append(text[start : i + 1])
                        start = i
                        break
        start += 1
    return out


def commas(text):
    out, quoted, escaped = "", False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (True, False) if escaped else (c != '"', c == "\\")
        elif c == '"':
            quoted = True
        elif c == "," and text[i + 1 :].lstrip()[:1] in ("}", "]"):
            continue
        out += c
    return out


def test_scanners_by_fuzzing():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(['{', '}', '"', "\\", ",", "[", "]", " ", "a", ":", "\n"]) for _ in range(rng.randint(0, 24)))
        assert lenient.balanced_objects(text) == objects(text), text
        assert lenient.without_trailing_commas(text) == commas(text), text


def test_values(spark):
    value = {"a": 'x } " {', "b": [1, 2, {"c": None}], "ü": "\\"}
    good = json.dumps(value, ensure_ascii=False)
    broken = good[:-1] + " , \n}"
    texts = [good, f"```json\n{good}\n```", f"Sure: {{not json}} then\n```JSON\n{broken}\n``` bye", f"prose {broken} prose {{}}", "none {a} here", "", None, "[1, 2,]", '{"n": NaN}', "{" * 3000 + good]
    got = [r.v for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(lenient.lenient_value("t").alias("v")).collect()]
    assert [json.loads(g) if g else None for g in got] == [value, value, value, value, None, None, None, [1, 2], None, value]
    assert len(lenient.balanced_objects("{" * 200_000)) == 0 and len(lenient.balanced_objects('{"' * 20_000)) == 0


def made(tmp_path):
    rng = random.Random(2)
    folders = [tmp_path / "tree"]
    folders[0].mkdir()
    for name in ["src", "node_modules", ".git", "build", "a", "b", "c", "d", "e"] * 6:
        folder = rng.choice(folders) / name
        if not folder.exists():
            folder.mkdir()
            folders.append(folder)
        for k in range(rng.randint(0, 3)):
            (folder / f"f{k}.{rng.choice(['py', 'js', 'txt'])}").write_text("x" * rng.randint(0, 50))
    (folders[0] / "top.py").write_text("top")
    os.symlink(folders[0] / "top.py", folders[0] / "link.py")
    os.symlink(folders[0], folders[-1] / "circle")
    return folders[0]


def walked(root, depth=99, kinds=None):
    out = []
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n not in IGNORED_NAMES and not os.path.islink(os.path.join(folder, n))]
        level = 0 if folder == str(root) else os.path.relpath(folder, root).count(os.sep) + 1
        for f in files:
            path = os.path.join(folder, f)
            if not os.path.islink(path) and level <= depth and (kinds is None or f.rsplit(".", 1)[-1] in kinds):
                out.append((os.path.relpath(path, root), level, os.stat(path).st_size, os.stat(path).st_mtime_ns // 1_000_000))
    return sorted(out)


def test_work_tree(spark, tmp_path):
    root = made(tmp_path)
    listed = lambda df: sorted((r.path, r.depth, r.bytes, r.modified_ms) for r in df.collect())
    tree = worktree.work_tree(spark, str(root))
    assert listed(tree) == walked(root) and len(walked(root)) > 20
    assert listed(tree.where("depth <= 1 and ext in ('py', 'js')")) == walked(root, 1, {"py", "js"})
    assert listed(tree.where("depth < 2 and ext = 'py' and bytes > 5")) == [r for r in walked(root, 1, {"py"}) if r[2] > 5]
    assert listed(worktree.work_tree(spark, str(root), partitions=1)) == walked(root)
    reader = worktree.TreeReader({"tree": str(root)})
    left = list(reader.pushFilters([worktree.LessThanOrEqual(("depth",), 2), worktree.EqualTo(("ext",), "py"), worktree.EqualTo(("path",), "x")]))
    assert (reader.depth, reader.kinds, len(left)) == (2, frozenset(["py"]), 1)
    before = tree.cache()
    before.count()
    (root / "new.py").write_text("new")
    (root / "top.py").write_text("other size")
    gone = next(r[0] for r in walked(root) if r[0] not in ("new.py", "top.py"))
    os.remove(root / gone)
    assert sorted(map(tuple, worktree.changes(before, worktree.work_tree(spark, str(root))).collect())) == sorted([("new.py", "added"), ("top.py", "modified"), (gone, "removed")])
