import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lorekeep.llm import quality, queries, secret_scan

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = queries.QUERIES["op9_naive_bayes_svm"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = rows.join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    assert all(0 <= r.score <= 1 for r in out)
    assert np.mean([r.predicted == r.quality for r in out]) >= 0.93
    all_rows = rows.select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in all_rows)


def test_quality_edge_cases(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 0, 0), (10, 0, None), (10, 0, 1), (11, 1, 0), (19, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(hard_docs, labels)
    out = quality.score(hard_docs, model).collect()
    assert len(out) == hard_docs.count() and all(0 <= r.score <= 1 for r in out)
    by = {}
    assert all(by.setdefault(r.text or "", r.score) == r.score for r in out)
    none = quality.train(no_docs, labels.where("false"))
    assert quality.score(no_docs, none).count() == 0 and 0 < none.score(np.zeros(0, np.int64)) < 1


def test_fit_by_brute_force(spark):
    """Ratios, hinge loss and curve against plain computations; ids of any type, clashing columns."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [(str(i), " ".join(rng.choices(words[: 30 if i % 2 else 40], k=12)) + (" fine" if i % 2 else " junk"), i % 2) for i in range(240)]
    codes = quality._Codes()
    docs, y = [quality.indicators(t, codes) for _, t, _ in texts], np.array([q for _, _, q in texts])
    ratio = quality.log_ratio(docs, y)
    for j in list(set(docs[0].tolist()))[:5]:
        n = [sum(j in d for d, v in zip(docs, y, strict=True) if v == c) for c in (0, 1)]
        size = [sum(len(d) for d, v in zip(docs, y, strict=True) if v == c) + quality.BUCKETS for c in (0, 1)]
        want = np.log(((n[1] + 1) / size[1]) / ((n[0] + 1) / size[0])) if sum(n) >= quality.MIN_DOCS else 0.0
        assert abs(ratio[j] - want) < 1e-9
    w, b = quality.dual_descent(docs, y, ratio)
    sign, scaled = np.where(y == 1, 1.0, -1.0), [ratio[d] / np.sqrt(len(d)) for d in docs]

    def loss(w, b):
        hinge = [max(0.0, 1 - s * (w[d] @ x + b)) for s, d, x in zip(sign, docs, scaled, strict=True)]
        return (w @ w + b * b) / 2 + sum(hinge)  # the classes are even, so all rows cost 1

    own = loss(w, b)
    for _ in range(30):  # a convex loss: no neighbour is much better
        step = np.zeros_like(w)
        at = rng.choice(docs)
        step[at] = np.random.default_rng(rng.randrange(99)).normal(size=len(at)) * 0.05
        assert loss(w + step, b + rng.uniform(-0.05, 0.05)) > own * (1 - 5e-3)
    margins = np.array([-2.0, -1.0, -0.5, 0.2, 1.0, 2.5])
    slope, shift = quality.logistic(margins, np.array([0, 0, 1, 0, 1, 1]))
    target = np.where(np.array([0, 0, 1, 0, 1, 1]) == 1, 4 / 5, 1 / 5)
    cross = lambda a, b: -(target * np.log(1 / (1 + np.exp(-a * margins - b))) + (1 - target) * np.log(1 - 1 / (1 + np.exp(-a * margins - b)))).sum()
    assert all(cross(slope + x, shift + z) >= cross(slope, shift) - 1e-6 for x in (-0.1, 0, 0.1) for z in (-0.1, 0, 0.1))
    df = spark.createDataFrame([(i, t, "old") for i, t, _ in texts], "doc_id string, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts], "doc_id string, quality int")
    model = quality.train(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    held = [i for i, _, _ in texts if zlib.crc32(i.encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (int(i) % 2) for i in held]) >= 0.9
    few = quality.train(df, labels, max_features=2000)
    assert 0 < few.score(docs[0]) < 1


def test_only_the_text_counts(spark):
    df = spark.createDataFrame([(1, "same text", "en", "a"), (2, "same text", "fr", "b")], "doc_id long, text string, lang string, source string")
    model = quality.fit([quality.indicators(t, quality._Codes()) for t in ("good words here", "bad stuff !!", "good words", "bad !!") * 4], np.array([1, 0, 1, 0] * 4))
    a, b = quality.score(df, model).collect()
    assert a.score == b.score


def base(text):
    """The rules by themselves, as the contract words them."""
    out = []
    for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_query(spark, hard_docs, tables):
    docs = hard_docs.unionByName(spark.createDataFrame([(30, "toKen='zzzzzz' Api_Key: 12345 APIKEY=abcdefg ſecret=nonono toKen = abcdef", "en", None, None)], hard_docs.schema))
    rows = queries.QUERIES["op10_grammar_secrets"](spark, tables(documents=docs)).collect()
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows), key=str)
    want = []
    for d in docs.collect():
        found = base(d.text or "")
        told = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
        want.append((d.doc_id, *(sum(k == x for _, _, k, _ in found) for x in ("assign", "access", "hex")), hashlib.sha256(told.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    for r in rows:
        assert set(x for x in r.spans.split(",") if x and not x.startswith("format")) <= set(r.spans.split(","))


HEXADECIMAL, CAPITALS, MIXED = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def credential(rng, kind):
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    return {"live": lambda: "sk-live-" + draw(MIXED, 24), "ghp": lambda: "ghp_" + draw(MIXED, 36), "hex": lambda: draw(HEXADECIMAL, 22), "access": lambda: "AKIB" + draw(CAPITALS, 16)}[kind]()


def test_formats_are_found_where_no_base_rule_is(spark):
    """Labelled credentials teach formats; bare ones elsewhere, which no base rule matches, are found, and words are not."""
    rng = random.Random(7)
    prose = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and doc_id < 400").select("text").collect()
    texts, planted = [], {}
    for i, p in enumerate(prose):
        text = p.text
        if i % 2:
            text += f' token = "{credential(rng, "live")}" and secret: {credential(rng, "ghp")} password={credential(rng, "hex") * 2} key AKIA{credential(rng, "access")[4:]} '
        elif i % 4 == 0:
            kind = rng.choice(["live", "ghp", "hex"])
            value = credential(rng, kind)
            text += f" seen {value} in a log"
            assert not [s for s in base(text) if s[0] < text.index(value) + len(value) and s[3] > text.index(value)]
            planted[i] = (text.index(value), text.index(value) + len(value))
        texts.append((i, text))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "format"] for r in secret_scan.scan(docs, secret_scan.learn(docs)).collect()}
    told = sum(map(len, out.values()))
    right = sum(planted[i] in out[i] for i in planted)
    assert right / len(planted) >= 0.9, (right, len(planted))
    assert right / told >= 0.9, (right, told)


def test_scores_by_brute_force():
    rng = random.Random(3)
    values = Counter({credential(rng, k): 1 for k in ("live", "ghp") for _ in range(40)} | {credential(rng, "hex"): 1 for _ in range(60)})
    formats = secret_scan.infer([("assign", v, n) for v, n in values.items()], {a + b: 5 for a in "abcdefgh" for b in "abcdefgh"})
    assert {n.split("/")[2] for n in formats.scorers} == {"sk-", "ghp", ""}
    trees = {}
    for (used, head), own in secret_scan.formats_of(values).items():
        tree = secret_scan.Automaton()
        for v in sorted(own):
            tree.insert(v)
        trees[f"assign/{used}/{head}"] = tree.merge().table()
    some = [*list(values)[:20], "abcdef", "a" * 500, "sk-live-short", "ABCDEFGHIJKLMN", "", "0123456789abcdef01"]
    some = [v for v in some if v]

    def plain(v):
        return sum(float(formats.words[ord(a), ord(b)]) for a, b in zip("\n" + v, v, strict=False))

    want = []
    for v in some:
        odds = [(secret_scan.bits(t, v), formats.floors[n]) for n, t in trees.items() if n in formats.floors]
        want.append(any(b / (len(v) + 1) >= f and (b - plain(v)) / (len(v) + 1) >= secret_scan.MARGIN_BITS and b - plain(v) >= secret_scan.EVIDENCE for b, f in odds))
    assert formats.likely(some) == want and any(want) and not all(want)
    text = "see " + list(values)[0] + " there"
    assert secret_scan.all_spans(text, formats) == [(4, 4 + len(list(values)[0]), "format")]


def test_redaction_keeps_all_else(spark):
    df = spark.createDataFrame([(1, "x password=hunter22 y", 5), (2, None, 6), (3, "clean", 7)], "doc_id long, text string, spans int")
    out = {r.doc_id: r for r in secret_scan.scan(df, None, redact=True).collect()}
    assert out[1].text == "x [REDACTED] y" and out[2].text is None and out[3].text == "clean" and out[3].spans == []


def test_no_rows(spark, no_docs):
    assert secret_scan.scan(no_docs, secret_scan.learn(no_docs)).count() == 0
    assert no_docs.select(quality.held_out().alias("h"), F.lit(1)).count() == 0
