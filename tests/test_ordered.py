"""Neighbours within keys, over ranges: against loops, with one key that has most rows."""

import random

from pyspark.sql import functions as F

from lorekeep.operators import ordered, transcript


def test_neighbours(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.random() < 0.1) for i in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "i long, k string, m boolean").repartition(5)
    own = {}
    for i, k, m in sorted(rows):
        own.setdefault(k, []).append((i, m))
    before = {i: (x[n - 1][0] if n else None) for x in own.values() for n, (i, _) in enumerate(x)}
    after = {i: next((s for s, (_, m) in enumerate(x[n + 1 :], 1) if m), None) for x in own.values() for n, (i, _) in enumerate(x)}
    assert {r.i: r.p for r in ordered.previous(df, ["k"], [F.col("i")], "i", "p").collect()} == before
    assert {r.i: r.p for r in ordered.next_marked(df, "k", [F.col("i")], F.col("m"), "p").collect()} == after
    assert ordered.next_marked(df.where("i < 0"), "k", [F.col("i")], F.col("m"), "p").count() == 0


def test_grounding_compares_on_both_paths(spark, monkeypatch):
    """With a hash that is the same for all texts, only what truly stands there is a hit."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(40)) for _ in range(12)]
    evidence = [(i, texts[i][20 : 20 + n] if i % 2 else " ".join(word() for _ in range(12))) for i, n in enumerate([60, 60, 12, 12, 90, 90, 40, 25])]
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(evidence, "item_id long, text string")
    want = sorted(map(tuple, transcript.grounding(items, docs).collect()))
    assert {(i, i) for i in (1, 3, 5, 7)} <= set(want)
    monkeypatch.setattr(transcript, "MOST_NEEDLES", 0)
    assert sorted(map(tuple, transcript.grounding(items, docs).collect())) == want
    monkeypatch.setattr(transcript.F, "xxhash64", lambda *c: transcript.F.length(c[0]) * 0 + 7)
    assert sorted(map(tuple, transcript.grounding(items, docs).collect())) == want


def test_next_marked_sums_up_each_range_once(spark):
    """A frame up to the end is summed up anew for each row, which grows with the square of a range's rows."""
    told = ordered.next_marked(spark.range(50).selectExpr("id as i", "'hot' as k", "id % 7 = 0 as m"), "k", [F.col("i")], F.col("m"), "p")
    assert "unboundedfollowing" not in told._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.i: r.p for r in told.collect()} == {i: (7 - i % 7 if i // 7 * 7 + 7 < 50 else None) for i in range(50)}
