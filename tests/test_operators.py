"""Operators by the cases and properties that they must keep."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import scores, text
from lorekeep.operators import graph, lifecycle, retrieval, status, transcript


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, text.tokens("t"), t="JWT 登录认证 a x-y.js, 中") == ["jwt", "登录", "录认", "认证", "x-y.js", "中"]
    assert one(spark, text.tokens("t"), t=None) is None or one(spark, text.tokens(F.lit(None).cast("string"))) == []
    assert len(one(spark, text.tokens("t"), t="ab " * 2500)) == 2000


def test_bigrams_and_jaccard(spark):
    assert one(spark, text.char_bigrams("t"), t="A--b!") == ["a ", " b"]
    assert one(spark, text.char_bigrams("t"), t="!") == [""]
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    assert one(spark, text.jaccard(a, b)) == one(spark, text.jaccard(b, a)) == pytest.approx(1 / 3)


def test_fingerprint_ignores_case_and_space(spark):
    f = lambda *v: one(spark, text.fingerprint(*(F.lit(x) for x in v)))
    assert f("Bug", "A  b", "c\n d") == f("bug", "a b", "C d") != f("bug", "a b", "c e")
    assert len(f("x", None, "")) == 24


def test_redaction_and_clean_up(spark):
    assert one(spark, text.redact("t"), t="api_key: 'abcdef1' and Bearer abc.def== sk-abcdefghijklmnop") == "api_key=[REDACTED] and Bearer [REDACTED] [REDACTED_TOKEN]"
    assert one(spark, text.strip_markdown("t"), t="# Head\n- **bold** [link](http://x) `code`") == "Head bold link code"
    assert one(spark, text.html_text("t"), t="<p>a&amp;b<script>x</script></p> c") == "a&b c"
    assert one(spark, text.estimated_tokens("t"), t="abcdefgh") == 2
    assert one(spark, text.first_sentence("t"), t="One two. Three.") == "One two."
    assert one(spark, text.compact("t", 60), t="A first sentence that is of some length here. " * 3) == "A first sentence that is of some length here."
    assert one(spark, text.compact("t", 40), t="A first sentence that is of some length here. " * 3) == "A first sentence that is of some length…"
    assert one(spark, text.base36(F.lit(35))) == "z"
    assert [one(spark, text.safe_id("t"), t=t) for t in ("Src/My_Class.ts", "--", "", "x" * 90)] == ["src-my_class-ts", "item", "item", "x" * 72]
    assert [one(spark, text.fnv1a("t"), t=t) for t in ("", "a", "foobar")] == ["811c9dc5", "e40c292c", "bf9cf968"]
    marks = "> 1. ***Bold*** and _it_ ~~no~~ `a b`\n---\n~~~\ncode\n~~~\n![alt](u.png \"t\") [x](y(z)) snake_case 2*3*4\n## End"
    assert one(spark, text.strip_markdown("t"), t=marks) == "Bold and it no a b alt x snake_case 2*3*4 End"
    assert one(spark, text.memory_document(F.lit("T"), F.lit("c"), F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"), F.lit("bug"))) == "T\nT\nc\na b\nbug"


def test_grounding(spark):
    assert one(spark, text.grounded(F.col("a"), F.col("b")), a="We chose PostgreSQL!", b="yes: we chose, postgresql as") is True
    assert one(spark, text.grounded(F.col("a"), F.col("b")), a="short", b="short") is False
    long_ = "abcdefghij" * 5
    assert one(spark, text.grounded(F.col("a"), F.col("b")), a=long_, b="zz" + long_[15:45] + "zz") is True


def test_cosine_bounds(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    for a, b, want in (((1, 0), (1, 0), 1), ((1, 0), (0, 1), 0), ((0, 0), (1, 1), 0), ((1, 2), (1,), 0), ((float("nan"), 1), (1, 1), 0)):
        assert one(spark, scores.cosine(v(*a), v(*b))) == pytest.approx(want)


def test_trust_and_recency(spark):
    assert [one(spark, scores.trust(F.lit(c).cast("double"))) for c in (0.7, 0.3, 0.0, None)] == [1.0, 0.5, 0.35, 1.0]
    day = scores.DAY_MS
    assert [round(one(spark, scores.recency(F.lit(d * day), 200 * day)), 4) for d in (195, 110, 0)] == [1.0, 0.5, 0.0]


def test_rrf_is_symmetric_and_prefers_both(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0)], "id long, score double")
    b = spark.createDataFrame([(3, 0.9), (1, 0.8)], "id long, score double")
    ab = {r.id: r.relevance for r in retrieval.rrf([a, b], "id").collect()}
    assert ab == pytest.approx({r.id: r.relevance for r in retrieval.rrf([b, a], "id").collect()})
    assert max(ab, key=ab.get) == 1


def test_diversified_equals_the_unpruned_loop(spark):
    rng = random.Random(1)
    for _ in range(3):
        rows = [(i, round(rng.random() * rng.choice([0.3, 2]), 3), rng.choice("abc"), rng.sample("pqrstuvwxyz", 4)) for i in range(40)]
        left, chosen = sorted(rows, key=lambda r: (-r[1], r[0])), []
        while left and len(chosen) < 5:
            def value(r):
                sim = max((len(set(r[3]) & set(c[3])) / len(set(r[3]) | set(c[3])) for c in chosen), default=0)
                return r[1] - 0.22 * sim - 0.08 * max(0, sum(c[2] == r[2] for c in chosen) - 1)
            best = max(left, key=lambda r: (value(r), -left.index(r)))
            chosen.append(best)
            left.remove(best)
        df = spark.createDataFrame(rows, "id long, relevance double, type string, tokens array<string>")
        got = retrieval.diversified(df, "id", 5).orderBy("position").collect()
        assert [r.id for r in got] == [c[0] for c in chosen]


GATE = [
    ("change", "t", "x" * 30, None, "type_change", "timeline"), ("issue", "t", "x" * 30, None, "type_issue", "todo"), ("context", "t", "x" * 30, "auto", "context_not_user_explicit", None),
    ("gossip", "t", "x" * 30, None, "type_forbidden", None), (None, "t", "x" * 30, None, "type_forbidden", None), ("lesson", "t", "short", None, "content_too_short", None), ("decision", "t", "twelve chars", "user_explicit", None, None),
    ("decision", "这个", "这个方案以后都这样处理就可以了没有别的要求了", None, "unresolved_reference", None), ("decision", "changelog 1.2", "a long enough content here", None, "changelog_genre", "timeline"),
    ("lesson", "files", "- src/a.js\n- src/b.js\n- src/c.js", None, "changelog_genre", "timeline"), ("lesson", "keep", "always pin the version of the parser", None, None, None),
]


def test_rule_gate(spark):
    df = spark.createDataFrame([(i, *g[:4]) for i, g in enumerate(GATE)], "id long, type string, title string, content string, source_kind string")
    got = [(r.reason, r.route) for r in lifecycle.rule_gate(df).orderBy("id").collect()]
    assert got == [g[4:] for g in GATE]


def test_core_cap_equals_the_loop(spark):
    rng = random.Random(4)
    for items, toks in ((5, 10**6), (100, 60), (8, 90)):
        rows = [(i, "decision", "", "x" * rng.randint(1, 80), rng.choice([0.1, 0.5, 0.9]), rng.randint(1, 9), rng.choice(["active", None, "archived"]), rng.random() < 0.2) for i in range(30)]
        live = [r for r in rows if r[6] in ("active", None)]
        gone = set()
        while True:
            now = [r for r in live if r[0] not in gone]
            if len(now) <= items and sum(-(-len(r[3]) // 4) for r in now) <= toks:
                break
            gone.add(min(now, key=lambda r: (r[7], round(r[4] * 10), r[5], r[0]))[0])
        df = spark.createDataFrame(rows, "id long, type string, title string, content string, importance double, created_ms long, status string, pinned boolean")
        assert {r.id for r in lifecycle.core_cap(df, "id", items, toks, 0).where("evicted").collect()} == gone


def test_near_titles_by_brute_force(spark):
    rng = random.Random(6)
    base = ["use postgres for the main database", "retry failed uploads with backoff", "keep secrets out of logs"]
    rows = [(i, rng.choice("ab"), "".join(c if rng.random() > 0.03 else "z" for c in rng.choice(base))) for i in range(40)]
    def grams(t):
        return frozenset(t[i : i + 2] for i in range(len(t) - 1))
    least = {}
    for i, k, t in rows:
        least.setdefault((k, grams(t)), i)
    want = set()
    items = list(least.items())
    for x in range(len(items)):
        for y in range(x):
            (k, g), a = items[x]
            (m, h), b = items[y]
            if k == m and len(g & h) / len(g | h) >= 0.85:
                want.add((min(a, b), max(a, b)))
    df = spark.createDataFrame(rows, "id long, type string, title string")
    assert {(r.a, r.b) for r in lifecycle.near_titles(df, "id").collect()} == want


def test_trim_keeps_anchors_and_touch_is_idempotent(spark):
    events = spark.createDataFrame([(i, 1000 * i, "init" if i == 1 else "session_summary" if i in (2, 5) else "todo") for i in range(20)], "id long, occurred_ms long, event_type string")
    kept = {r.id for r in lifecycle.timeline_trim(events, "id", 20_000, 1, 3).collect()}
    assert kept == {19, 18, 17, 1, 5}
    touches = spark.createDataFrame([("a", 0), ("a", 299_999), ("a", 300_000), ("a", 599_999), ("b", 5)], "k string, t long")
    once = lifecycle.access_touch(touches, "k", "t")
    assert sorted(map(tuple, once.collect())) == [("a", 0), ("a", 300_000), ("b", 5)] == sorted(map(tuple, lifecycle.access_touch(once, "k", "t").collect()))


def test_upsert_delete_supersede_lookup(spark):
    base = spark.createDataFrame([("m-1", "active", None), ("m-2", "active", "m-1"), ("m-22", "active", None)], "id string, status string, superseded_by string")
    assert {(r.id, r.status) for r in lifecycle.upsert(base, spark.createDataFrame([("m-1", "done"), ("m-9", "new")], "id string, status string"), "id").collect()} == {("m-1", "done"), ("m-2", "active"), ("m-22", "active"), ("m-9", "new")}
    assert {(r.id, r.superseded_by) for r in lifecycle.delete(base, ["m-1"], "id").collect()} == {("m-2", None), ("m-22", None)}
    new = lifecycle.supersede(base.drop("superseded_by"), spark.createDataFrame([("m-1", "m-2")], "old string, new string"), "id")
    assert {(r.id, r.status, r.superseded_by) for r in new.collect()} >= {("m-1", "superseded", "m-2"), ("m-2", "active", None)}
    assert [r.outcome for r in lifecycle.lookup(base, "id", "m-2").collect()] == ["ok"]
    assert {r.outcome for r in lifecycle.lookup(base, "id", "m-").collect()} == {"E_AMBIGUOUS_ID"}
    assert lifecycle.layer(base.withColumn("type", F.lit("bug")), "active", "bug").count() == 3


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("x",)], "node string")
    assert {tuple(r) for r in graph.reachable(edges, roots).collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")}
    assert {tuple(r) for r in graph.longest_chains(edges, roots).collect()} == {("a", 2), ("x", 1)}
    old, new = (spark.createDataFrame(rows, "path string, hash string") for rows in ([("p", "1"), ("q", "1"), ("r", "1")], [("p", "2"), ("q", "1"), ("s", "1")]))
    flip = {"added": "removed", "removed": "added", "modified": "modified"}
    forth = {tuple(r) for r in graph.tree_diff(old, new).collect()}
    assert forth == {("p", "modified"), ("r", "removed"), ("s", "added")} == {(p, flip[c]) for p, c in map(tuple, graph.tree_diff(new, old).collect())}
    made = spark.createDataFrame([("m1", "s1", None), ("m2", "s2", "m1"), ("m3", "s2", "m2"), ("m4", None, "m1")], "id string, session string, supersedes string")
    assert {tuple(r) for r in graph.supersede_edges(made).collect()} == {("supersede", "s1", "s2")}
    mixed = spark.createDataFrame([("p", "modified"), ("p", "removed"), ("q", "modified"), ("q", "added")], "path string, change string")
    assert {tuple(r) for r in graph.merged_changes(mixed).collect()} == {("p", "removed"), ("q", "added")}
    commits = spark.createDataFrame([("c3", "c2"), ("c2", "c1"), ("c1", None)], "hash string, parent string")
    assert [r.hash for r in graph.first_parents(commits, "c3", 2).orderBy("distance").collect()] == ["c3", "c2"]


def test_ladder_and_briefing(spark):
    todos = spark.createDataFrame([(1, "high", "pending", 5), (2, "urgent", "pending", 1), (3, "low", "done", 9)], "id long, priority string, status string, created_ms long")
    memories = spark.createDataFrame([(7, "active", 0)], "id long, status string, created_ms long")
    events = spark.createDataFrame([(4, 9, "session_summary")], "id long, occurred_ms long, event_type string")
    assert tuple(status.recommend(todos, memories, events, 10).first()) == (2, "start", 2, 0.7)
    assert status.recommend(todos.where("false"), memories, events, 10).first().action == "review"
    assert status.recommend(todos.where("false"), memories.where("false"), events.where("false"), 10).first().action == "plan"
    assert [(r.section, r.id) for r in status.briefing(todos.withColumn("status", F.lit("in_progress")), events, 10**10).orderBy("section", "position").collect()] == [("recent", 4), ("stuck", 2), ("stuck", 1), ("stuck", 3)]


def test_signals(spark):
    said = ["please remember to use tabs", "never mind, forget it", "we decided on blue", "hi", None, "记住：用制表符缩进", "keep in mind the old parser", "in this merge keep in mind the old parser",
            "never push on fridays, please", "以后 tests 要记得 ", "note that", "let's always review it", "remember: " + "x" * 300, "We REMEMBER eslint rules"]
    rows = [(1, i, "user", t) for i, t in enumerate(said)] + [(2, 0, "assistant", "always do it so")]
    out = transcript.signals(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.turn, r.strength, r.content) for r in out} == {
        (0, "strong", "to use tabs"), (5, "strong", "用制表符缩进"), (6, "weak", "keep in mind"), (1, "strong", "never"), (8, "strong", "never"), (9, "strong", "tests 要"), (11, "strong", "always"),
        (12, "strong", "x" * 200), (13, "strong", "eslint rules"),
    }


def test_grounding_paths_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Intro. " + "the quick brown fox jumps over the lazy dog again and again"), (2, "nothing"), (3, None), (4, "tiny item here")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "The quick brown fox, jumps over the LAZY dog again!"), (11, "tiny item"), (12, "no"), (13, None)], "item_id long, text string")
    here = {tuple(r) for r in transcript.grounding(items, docs).collect()}
    monkeypatch.setattr(transcript, "MOST_NEEDLES", 0)
    assert here == {tuple(r) for r in transcript.grounding(items, docs).collect()} == {(10, 1), (11, 4)}


def test_first_parents_beyond_the_engines_recursion_bound(spark):
    commits = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None) for i in range(150)], "hash string, parent string")
    walk = lambda **limit: [(r.hash, r.distance) for r in graph.first_parents(commits, "c149", **limit).orderBy("distance").collect()]
    assert walk() == [(f"c{149 - d}", d) for d in range(150)]
    assert walk(limit=120) == [(f"c{149 - d}", d) for d in range(120)]
    assert walk(limit=1) == [("c149", 0)]


def test_lookups_of_todos(spark):
    todos = spark.createDataFrame([("todo-1", "Ship it", "pending", "low", 5), ("todo-12", "Fix", "pending", "urgent", 1), ("todo-3", "ship it", "done", "high", 9), ("x", "Ship It", "blocked", "high", 2)], "id string, title string, status string, priority string, created_ms long")
    refs = spark.createDataFrame([("todo-1",), ("ship it",), ("todo-3",), ("x",), (" ",), ("nothing",)], "ref string")
    assert {tuple(r) for r in status.find_todos(todos, refs).collect()} == {("todo-1", "todo-12"), ("ship it", "x"), ("x", "x")}
    open_ = spark.createDataFrame([(1, ["a"], []), (2, [], ["t"]), (3, None, None)], "id long, files array<string>, tags array<string>")
    records = spark.createDataFrame([("m1", 1, ["b"], []), ("m2", 2, ["a"], ["t"]), ("m3", 3, ["a"], None)], "id string, position int, files array<string>, tags array<string>")
    assert {tuple(r) for r in status.related_records(open_, records).collect()} == {(1, "m2"), (2, "m2"), (3, "m1")}
    files = spark.createDataFrame([("a", ["x"], []), ("b", [], ["Main"]), ("c", [], ["other"]), ("d", None, None)], "path string, exports array<string>, functions array<string>")
    assert {r.path for r in graph.entry_points(files).collect()} == {"a", "b"}


def test_ranks_and_budgets_over_ranges(spark):
    from lorekeep.operators import ordered

    rng = random.Random(9)
    rows = [(i, rng.randint(0, 30), rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, score int, size long").repartition(5)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r.id: r.r for r in ordered.ranked(df, [F.desc("score"), F.asc("id")], "r").collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(want)}
    total, kept = 0, set()
    for r in want:
        total += r[2]
        if total <= 400:
            kept.add(r[0])
    assert {r.id for r in lifecycle.within_budget(df, "size", 400, [F.desc("score"), F.asc("id")]).collect()} == kept


def test_best_prior_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "HOT", 2)
    rng = random.Random(8)
    base = ["use postgres for the main database", "retry failed uploads with backoff", "keep secrets out of logs", "ab", "abc"]
    rows = [(i, rng.choice("ab"), "".join(c if rng.random() > 0.05 else "z" for c in rng.choice(base)), rng.choice(["active", "archived", None])) for i in range(50)]
    grams = lambda t: frozenset(t[i : i + 2] for i in range(len(t) - 1))
    want = {}
    for i, k, t, _ in rows:
        near = [(-len(grams(t) & grams(u)) / len(grams(t) | grams(u)), j) for j, m, u, s in rows if j != i and m == k and s != "archived"]
        best = min((x for x in near if -x[0] >= 0.72), default=None)
        if best:
            want[i] = (best[1], -best[0])
    df = spark.createDataFrame(rows, "id long, type string, title string, status string")
    assert {r.id: (r.prior, pytest.approx(r.similarity)) for r in lifecycle.best_prior(df, df, "id").collect()} == want


def test_candidates_of_many_stripes(spark, monkeypatch):
    """Sets of common members only: every similar pair once, and a row is repeated a stripe, not by what its set holds."""
    rng = random.Random(9)
    base = [rng.sample("abcdefghijkl", 9) for _ in range(6)]
    sets = [(i, rng.choice("xy"), sorted(set(rng.choice(base)) ^ set(rng.sample("abcdefghijkl", rng.randint(0, 2))))) for i in range(300)]
    monkeypatch.setattr(lifecycle, "STRIPE", 20)
    monkeypatch.setattr(lifecycle, "HOT", 7)
    got = [tuple(sorted(r)) for r in lifecycle._candidates(spark.createDataFrame(sets, "id long, type string, g array<string>"), 0.72).collect()]
    want = {(a, b) for a, t, g in sets for b, u, h in sets if a < b and t == u and len(set(g) & set(h)) >= 0.72 * len(set(g) | set(h))}
    assert len(got) == len(set(got)) and want and want <= set(got)


def test_best_prior_of_many_alike(spark, monkeypatch):
    """Titles that are all alike: a set has one row of two stripes that meet; members without a place or bit of their own count too."""
    for name, value in (("STRIPE", 10), ("HOT", 7), ("BITS", 64), ("PLACES", (8, 16))):
        monkeypatch.setattr(lifecycle, name, value)
    rng, met, whole = random.Random(4), [], lifecycle._in_stripes
    monkeypatch.setattr(lifecycle, "_in_stripes", lambda *a: met.append(whole(*a).cache()) or met[-1])
    long_ = "".join(chr(0x4E00 + i * 7) for i in range(60)) + " and some plain words"
    rows = [(i, "a" if i % 9 else None, "".join(c if rng.random() > 0.02 else rng.choice("xyz乙") for c in long_), rng.choice(["active", "archived", None])) for i in range(90)] + [(90, "a", None, None), (91, "a", "!", None), (92, "a", "b", "archived")]
    grams = lambda t: frozenset(t[i : i + 2] for i in range(len(t) - 1)) or frozenset([t])
    sets = [grams((t or "").strip("!")) for _, _, t, _ in rows]
    want = {}
    for i, k, _, _ in rows:
        near = [(-len(sets[i] & sets[j]) / len(sets[i] | sets[j]), j) for j, m, _, s in rows if j != i and m == k and s != "archived"]
        best = min((x for x in near if -x[0] >= 0.72), default=None)
        if best:
            want[i] = (best[1], -best[0])
    df = spark.createDataFrame(rows, "id long, type string, title string, status string")
    assert {r.id: (r.prior, r.similarity) for r in lifecycle.best_prior(df, df, "id").collect()} == want and len(want) > 80
    assert 0 < met[0].count() <= len(rows) * 9  # nine stripes at most; similar pairs are thousands
    strings = df.select(F.col("id").cast("string").alias("id"), "type", "title", "status")
    assert {r.id: r.prior for r in lifecycle.best_prior(strings.where("id < '3'"), strings.where("id > '3'"), "id").collect()}.keys() <= {str(i) for i in want}


def test_titles_are_told_before_texts_are_shuffled(spark, sf_dir):
    """What asks for titles only moves no text: the title is below the join with the labels."""
    from lorekeep.plans import tables

    plan = tables.memories(spark, sf_dir).select("id", "title", "status")._jdf.queryExecution().optimizedPlan().toString()
    join, told = plan.index("Join"), plan.index("regexp_extract")
    assert join < told


def test_first_sentence_needs_no_more_than_its_letters(spark):
    import re

    def whole(t, limit):
        t = re.sub(r"[ \t\n\x0b\f\r]+", " ", t or "").strip(" ")
        found = re.match(r"(.*?[.!?。！？])(?:[ \t\n\x0b\f\r]|\Z)", t)
        return (found.group(1) if found else t)[:limit]

    rng = random.Random(6)
    texts = [None, "", "   ", " \n\t a. b", "x" * 300, "x" * 199 + ". y", "x" * 200 + ". y", "x" * 198 + ".y z", "a " * 150, "a  \n " * 99 + "b. c", "ab.c d? e", "𝒳" * 205, "  a b. c", " " * 5000 + "end. more", "no end" + " " * 5000, "早。 晚", "早。晚"]
    texts += ["".join(rng.choice("ab.? \n。") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for limit in (200, 20, 3):
        got = {r.i: r.x for r in df.select("i", text.first_sentence("t", limit).alias("x")).collect()}
        assert got == {i: whole(t, limit) for i, t in enumerate(texts)}


def test_markdown_of_any_length(spark):
    """Long targets, rules and quotes, and marks around a long text."""
    texts = {"[a](" + "x" * 50_000 + ") b": "a b", "[a](" + "(y)" * 20_000 + ") b": "a b", "*" * 50_000 + "\na": "a", "- " * 50_000 + "\na": "a", "> " * 50_000 + "a": "a", "# T\n> - **" + "word " * 50_000 + "end**": "T " + "word " * 50_000 + "end"}
    assert [one(spark, text.strip_markdown("t"), t=t) for t in texts] == list(texts.values())
