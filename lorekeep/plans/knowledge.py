"""Knowledge-store queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import html_text, memory_document, redact, tokens
from ..operators import graph, lifecycle, retrieval, status, transcript
from .tables import DAY_MS, MEMORIES_SQL, NOW_MS, TIMELINE_SQL, TODOS_SQL, memories, table, timeline, todos

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register the decorated query and its SQL."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return register


QUESTION = "the and retion tionre that"
WORDS = QUESTION.split()
#: Tokens of a text in SQL: the texts hold no CJK letters, so runs of two letters and more are the tokens.
TOKENS_SQL = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9_./:@-]+'), lambda x: length(x) > 1)[1:2000]"
_TF = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(WORDS))
_DF = ", ".join(f"count(CASE WHEN tf{i} > 0 THEN 1 END) AS df{i}" for i in range(len(WORDS)))
_BM25 = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg_len)) ELSE 0 END" for i in range(len(WORDS)))
BM25_SQL = f"""
SELECT doc_id, {_BM25} AS score
FROM (SELECT doc_id, len(t) AS len, {_TF} FROM (SELECT doc_id, {TOKENS_SQL.format(c='text')} AS t FROM documents) a) c
CROSS JOIN (SELECT count(*) AS n, avg(len) AS avg_len, {_DF} FROM (SELECT len(t) AS len, {_TF} FROM (SELECT {TOKENS_SQL.format(c='text')} AS t FROM documents) b) d) s
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), QUESTION)


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({BM25_SQL}) x WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(_scored(spark, sf_dir), 20, "score", "doc_id").withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({BM25_SQL}) x WHERE score > 0")
def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, len(t) AS n_tokens, t[1] AS first_token, t[len(t)] AS last_token FROM (SELECT doc_id, " + TOKENS_SQL.format(c="text") + " AS t FROM documents) x WHERE len(t) > 0")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.element_at("t", 1).alias("first_token"), F.element_at("t", -1).alias("last_token"))


COSINE_SQL = """
SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""


def _vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 0").select(F.col("embedding").alias("_q")).limit(1)
    return vectors.crossJoin(F.broadcast(q)).select("vec_id", scores.cosine(F.col("embedding"), F.col("_q")).alias("score"))


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({COSINE_SQL}) x WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(_vector_scores(spark, sf_dir).where("score > 0"), 20, "score", "vec_id").withColumn("score", F.round("score", 6))


@query(f"""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, score FROM (SELECT doc_id, round(score, 9) AS score FROM ({BM25_SQL}) x WHERE score > 0) y),
b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r, score FROM (SELECT vec_id, round(score, 9) AS score FROM ({COSINE_SQL}) x WHERE score > 0) y),
u AS (SELECT doc_id, 1.0 / (60 + r) AS part, score AS s0, 0 AS s1 FROM a UNION ALL SELECT doc_id, 1.0 / (60 + r), 0, score FROM b)
SELECT doc_id, round(sum(CAST(part AS DOUBLE)), 8) AS relevance, round(max(s0), 6) AS keyword_score, round(max(s1), 6) AS vector_score FROM u GROUP BY doc_id""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = lambda df: df.withColumn("score", F.round("score", 9))
    vectors = _vector_scores(spark, sf_dir).where("score > 0").withColumnRenamed("vec_id", "doc_id")
    out = retrieval.rrf([rounded(_scored(spark, sf_dir)), rounded(vectors)], "doc_id")
    return out.select("doc_id", F.round("relevance", 8).alias("relevance"), F.round("score_0", 6).alias("keyword_score"), F.round("score_1", 6).alias("vector_score"))


def _ranked(spark: SparkSession, sf_dir: str, query: str = QUESTION, hybrid: bool = False) -> DataFrame:
    rows = memories(spark, sf_dir).where(lifecycle.is_retrievable())
    kept = rows.select(F.col("id").alias("doc_id"), memory_document(F.col("title"), F.col("content"), kind=F.col("type")).alias("text"))
    scored = retrieval.bm25(kept, "doc_id", F.col("text"), query)
    keyword = retrieval.with_normalised(scored, "score", "keyword").select(F.col("doc_id").alias("id"), "keyword")
    factors = rows.select("id", "type", "importance", "confidence", F.col("created_ms").alias("touched_ms"), "title", "content").join(keyword, "id", "left")
    if hybrid:
        vectors = retrieval.with_normalised(_vector_scores(spark, sf_dir).where("score > 0"), "score", "vector").select(F.col("vec_id").alias("id"), "vector")
        factors = factors.join(vectors, "id", "left").withColumn("vector", F.coalesce("vector", F.lit(0.0)))
    else:
        factors = factors.withColumn("vector", F.lit(0.0))
    return retrieval.fused(factors, NOW_MS, has_query=bool(query), has_vectors=hybrid)


#: A record's document in SQL: title twice, content, type (the records have no tags and files).
_DOCUMENT = "concat_ws(chr(10), nullif(title, ''), nullif(title, ''), nullif(content, ''), type)"
_LIVE = "status NOT IN ('archived', 'superseded', 'deleted')"
_KEPT = f"SELECT id AS doc_id, {_DOCUMENT} AS text FROM ({MEMORIES_SQL}) m WHERE {_LIVE}"
_RECENT = "CASE WHEN age <= 7 THEN 1 ELSE greatest(0, 1 - age / 180) END"
_TRUST = "CASE WHEN conf >= 0.6 THEN 1 ELSE greatest(0.35, conf / 0.6) END"
_STABLE = "CASE WHEN type IN ('decision', 'requirement', 'architecture', 'bug', 'lesson', 'preference') THEN 1 ELSE 0.35 END"
_FACTORS = f"""
kept AS ({_KEPT}), k AS ({BM25_SQL.replace('FROM documents', 'FROM kept')}), top AS (SELECT max(score) AS best FROM k WHERE score > 0),
v AS (SELECT vec_id, score FROM ({COSINE_SQL}) x WHERE score > 0), vtop AS (SELECT max(score) AS best FROM v),
f AS (SELECT m.id, m.type, m.content, coalesce(importance, 0.5) AS imp, coalesce(confidence, 0.6) AS conf, ({NOW_MS} - created_ms) / 86400000.0 AS age,
  CASE WHEN k.score > 0 THEN k.score / top.best ELSE 0 END AS kw, coalesce(v.score / vtop.best, 0) AS vec
  FROM ({MEMORIES_SQL}) m JOIN k ON k.doc_id = m.id CROSS JOIN top CROSS JOIN vtop LEFT JOIN v ON v.vec_id = m.id)"""
FUSED_SQL = f"WITH {_FACTORS} SELECT id, type, content, (0.15 * kw + 0.30 * imp + 0.10 * conf + 0.20 * {_RECENT}) * {_TRUST} AS relevance FROM f"


@query(f"SELECT id, round(CAST(relevance AS DOUBLE), 6) AS relevance FROM ({FUSED_SQL}) x")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("id", F.round("relevance", 6).alias("relevance"))


@query(f"WITH {_FACTORS} SELECT id, round(CAST((0.15 * kw + 0.25 * vec + 0.30 * imp + 0.10 * conf + 0.20 * {_RECENT}) * {_TRUST} AS DOUBLE), 6) AS relevance FROM f")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords and vectors together: a record's vector is that of its number."""
    return _ranked(spark, sf_dir, hybrid=True).select("id", F.round("relevance", 6).alias("relevance"))


@query(f"WITH {_FACTORS} SELECT id, round(CAST((0.45 * imp + 0.10 * conf + 0.25 * {_RECENT} + 0.20 * {_STABLE}) * {_TRUST} AS DOUBLE), 6) AS relevance FROM f")
def fusion_without_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, query="").select("id", F.round("relevance", 6).alias("relevance"))


CHOSEN = 10
_ALIKE = "CASE WHEN len(list_intersect(r.t, c.t)) = 0 THEN 0 ELSE CAST(len(list_intersect(r.t, c.t)) AS DOUBLE) / (len(r.t) + len(c.t) - len(list_intersect(r.t, c.t))) END"
_ROUND = "SELECT *, round(relevance - 0.22 * near - 0.08 * greatest(0, same - 1), 9) AS score FROM r{i} ORDER BY score DESC, relevance DESC, id LIMIT 1"
_LEFT = f"SELECT r.id, r.type, r.relevance, r.t, greatest(r.near, {_ALIKE}) AS near, r.same + CASE WHEN r.type = c.type THEN 1 ELSE 0 END AS same FROM r{{h}} r, c{{h}} c WHERE r.id <> c.id"
MMR_SQL = f"""
WITH r0 AS MATERIALIZED (SELECT id, type, round(CAST(relevance AS DOUBLE), 9) AS relevance, list_distinct({TOKENS_SQL.format(c='content')}) AS t, CAST(0 AS DOUBLE) AS near, 0 AS same FROM ({FUSED_SQL}) x),
""" + ",\n".join((f"r{i} AS MATERIALIZED ({_LEFT.format(h=i - 1)}), " if i else "") + f"c{i} AS MATERIALIZED ({_ROUND.format(i=i)})" for i in range(CHOSEN)) + "\n" + " UNION ALL ".join(f"SELECT id, {i + 1} AS position, round(score, 6) AS score FROM c{i}" for i in range(CHOSEN))


@query(MMR_SQL)
def mmr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir).select("id", "type", F.round("relevance", 9).alias("relevance"), tokens("content").alias("tokens"))
    return retrieval.diversified(ranked, "id", CHOSEN).select("id", "position", F.round("score", 6).alias("score"))


_LEX = " + ".join(f"CASE WHEN contains(lower(title), '{w}') OR contains(lower(content), '{w}') THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), '{w}') THEN 1 ELSE 0 END" for w in ("the", "retion", "ou"))


@query(f"SELECT id, {_LEX} AS score FROM ({MEMORIES_SQL}) m")
def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir)
    return rows.select("id", retrieval.lexical(rows, ["the", "retion", "ou"], "title", ["content"]).alias("score"))


@query(f"""
WITH t AS (SELECT 'todo' AS kind, id, CASE WHEN contains(title, '11') THEN 2 ELSE 0 END AS score FROM ({TODOS_SQL}) x WHERE status IN ('pending', 'in_progress')),
e AS (SELECT 'timeline' AS kind, id, CASE WHEN contains(event_type, 'session') THEN 2 ELSE 0 END AS score FROM ({TIMELINE_SQL}) x),
d AS (SELECT 'memory' AS kind, doc_id AS id, round(score, 6) AS score FROM ({BM25_SQL}) x WHERE score > 0)
SELECT * FROM (SELECT kind, id, CAST(score AS DOUBLE) AS score FROM d ORDER BY score DESC, id LIMIT 6) a
UNION ALL SELECT * FROM (SELECT kind, id, CAST(score AS DOUBLE) AS score FROM t WHERE score > 0 ORDER BY score DESC, id LIMIT 3) b
UNION ALL SELECT * FROM (SELECT kind, id, CAST(score AS DOUBLE) AS score FROM e WHERE score > 0 ORDER BY score DESC, id LIMIT 2) c""")
def ask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's sources: k memories, half as many todos, two events."""
    hits = retrieval.top(_scored(spark, sf_dir).withColumn("score", F.round("score", 6)), 6, "score", "doc_id").select(F.lit("memory").alias("kind"), F.col("doc_id").alias("id"), "score")
    open_ = todos(spark, sf_dir).where(F.col("status").isin("pending", "in_progress"))
    todo = retrieval.top(open_.select("id", retrieval.lexical(open_, ["11"], "title", []).cast("double").alias("score")).where("score > 0"), 3, "score", "id")
    events = timeline(spark, sf_dir)
    event = retrieval.top(events.select("id", retrieval.lexical(events, ["session"], "event_type", []).cast("double").alias("score")).where("score > 0"), 2, "score", "id")
    return hits.unionByName(todo.withColumn("kind", F.lit("todo"))).unionByName(event.withColumn("kind", F.lit("timeline")))


@query(f"""
WITH f AS (SELECT id, sha256(trim(regexp_replace(lower(type || chr(10) || title || chr(10) || content), '\\s+', ' ', 'g')))[1:24] AS fingerprint FROM ({MEMORIES_SQL}) m)
SELECT id, fingerprint, min(id) OVER (PARTITION BY fingerprint) AS keeper, id <> min(id) OVER (PARTITION BY fingerprint) AS duplicate FROM f""")
def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.first_of_fingerprint(memories(spark, sf_dir).select("id", "type", "title", "content"), "id").select("id", "fingerprint", "keeper", "duplicate")


_CLEAN = "trim(regexp_replace(lower(title), '[^a-z0-9一-鿿]+', ' ', 'g'))"


@query(f"""
WITH g AS (SELECT type, list_sort(list_distinct(list_transform(generate_series(1, greatest(length({_CLEAN}) - 1, 1)), lambda i: substr({_CLEAN}, i, 2)))) AS g, id FROM ({MEMORIES_SQL}) m),
c AS (SELECT type, g, min(id) AS id, len(g) AS n FROM g GROUP BY type, g),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS both_, a.n AS n, b.n AS m FROM c a JOIN c b ON a.type = b.type AND a.id < b.id AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n))
SELECT a, b, round(CAST(both_ AS DOUBLE) / (n + m - both_), 6) AS similarity FROM p WHERE both_ >= 0.85 * (n + m - both_)""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.near_titles(memories(spark, sf_dir), "id").withColumn("similarity", F.round("similarity", 6))


#: What some sources' records say instead, so that every rule of the gate meets rows.
_SAID = {"src4": ("issue", None, None), "src5": ("gossip", None, None), "src6": (None, "release notes", None), "src7": (None, "这个", "这个方案以后都这样处理就可以了没有别的要求了"), "src8": (None, "files", "- src/a.js\n- src/b.js\n- src/c.js"), "src9": (None, "PR #12", None), "src10": (None, "report", "验收 1/2, 全套 smoke, 同步至 v2 and so on"), "src11": (None, "这个 plan", "这个方案以后都这样处理就可以了没有别的要求了"), "src12": (None, "本次工作", "全部 PASS, everything else is as it was before")}


def _said(column: str, at: int) -> str:
    cases = " ".join(f"WHEN '{s}' THEN '{v[at]}'" for s, v in _SAID.items() if v[at])
    return f"CASE source {cases} ELSE {column} END".replace("\n", "' || chr(10) || '")


CASES_SQL = f"SELECT id, source, status, {_said('type', 0)} AS type, {_said('title', 1)} AS title, {_said('content', 2)} AS content FROM ({MEMORIES_SQL}) m"


def gate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory records of which some sources say something else, with ``source_kind``."""
    rows = memories(spark, sf_dir).withColumn("source_kind", F.when(F.col("source") == "src0", "user_explicit").otherwise("auto"))
    for name, at in (("type", 0), ("title", 1), ("content", 2)):
        rows = rows.withColumn(name, F.expr(_said(name, at)))
    return rows


_DEIXIS = "(这个|这些|这条|这段|这句|这点|这样|这种|这方面|这角度|那个|那些|上述|上面(?:说|提|讲)?的|前面(?:说|提|讲)?的|刚才(?:说|提|讲)?的|如上|此事|本次讨论|你说的|我说的|上文)|\\b(?:this|these|those|the above)\\b"
_ANCHOR = "[A-Za-z][A-Za-z0-9._/-]{{1,}}|[「『《\"''`\\[(][^\\s」』》\"''`\\])]{{2,}}[」』》\"''`\\])]".replace("{{", "{").replace("}}", "}")
_REPORTS = "len(regexp_extract_all(title || chr(10) || content, '(?i)验收\\s*\\d+\\s*/\\s*\\d+|全套 smoke|git 快进|同步至 v\\d'))"
_CHANGELOG = f"""((len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(trim(x), '^[-*]\\s+\\S+') AND regexp_matches(x, '[./\\\\]'))) >= 3
   AND length(regexp_replace(regexp_replace(content, '(?m)^[-*].*$', '', 'g'), '\\s+', '', 'g')) < 40)
  OR regexp_matches(title || chr(10) || content, '改了\\s*\\d+\\s*个文件') OR regexp_matches(title || chr(10) || content, '(?i)本次\\s*session\\s*改动')
  OR regexp_matches(trim(title), '(?i)^(git\\s+)?commit\\b|^PR\\s*#\\s*\\d+|\\b(changelog|release notes)\\b|\\bpatch\\s*#\\s*\\d+')
  OR (regexp_matches(trim(title), '^(本次完成|本次工作|完成情况|验收清单|工作总结)') AND regexp_matches(content, '验收|PASS|git 快进|改了'))
  OR {_REPORTS} >= 3 OR ({_REPORTS} >= 2 AND NOT regexp_matches(content, '根因|以后')))"""
GATE_SQL = f"""
SELECT *, CASE WHEN type = 'change' THEN 'type_change' WHEN type = 'issue' THEN 'type_issue' WHEN type = 'context' AND source <> 'src0' THEN 'context_not_user_explicit'
  WHEN type NOT IN ('context', 'decision', 'requirement', 'architecture', 'bug', 'lesson', 'preference') THEN 'type_forbidden'
  WHEN length(trim(content)) < CASE WHEN source = 'src0' THEN 12 ELSE 20 END THEN 'content_too_short'
  WHEN regexp_matches(title || chr(10) || trim(content), '(?i){_DEIXIS}') AND NOT regexp_matches(title || chr(10) || trim(content), '{_ANCHOR}') AND length(regexp_replace(trim(content), '\\s+', '', 'g')) <= 30 THEN 'unresolved_reference'
  WHEN {_CHANGELOG} THEN 'changelog_genre' END AS reason FROM ({CASES_SQL}) m"""


@query(f"SELECT id, reason, CASE WHEN reason IN ('type_change', 'changelog_genre') THEN 'timeline' WHEN reason = 'type_issue' THEN 'todo' END AS route FROM ({GATE_SQL}) x")
def rule_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.rule_gate(gate_cases(spark, sf_dir)).select("id", "reason", "route")


CORE_ITEMS, CORE_TOKENS = 120, 30_000


@query(f"""
WITH m AS (SELECT id, CAST(round(coalesce(importance, 0) * 10) AS INTEGER) AS imp, created_ms, CAST(ceil(length(title || content) / 4.0) AS BIGINT) AS tok, status FROM ({MEMORIES_SQL}) x),
o AS (SELECT id, row_number() OVER (ORDER BY imp DESC, created_ms DESC, id DESC) AS r, sum(tok) OVER (ORDER BY imp DESC, created_ms DESC, id DESC ROWS UNBOUNDED PRECEDING) AS used FROM m WHERE status = 'active')
SELECT m.id, (m.status = 'active' AND NOT coalesce(o.r <= {CORE_ITEMS} AND o.used <= {CORE_TOKENS}, false)) AS evicted FROM m LEFT JOIN o ON o.id = m.id""")
def core_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.core_cap(memories(spark, sf_dir), "id", CORE_ITEMS, CORE_TOKENS, NOW_MS).select("id", "evicted")


@query(f"""
WITH m AS (SELECT id, created_ms, status FROM ({MEMORIES_SQL}) x), d AS (SELECT * FROM m WHERE status IN ('archived', 'superseded', 'deleted')),
o AS (SELECT id, row_number() OVER (ORDER BY created_ms, id) AS r FROM d WHERE {NOW_MS} - created_ms > {180 * DAY_MS})
SELECT m.id, coalesce(o.r <= greatest(0, (SELECT count(*) FROM d) - 50), false) AS evict FROM m LEFT JOIN o ON o.id = m.id""")
def vacuum_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.vacuum_plan(memories(spark, sf_dir).withColumn("touched_ms", F.col("created_ms")), "id", NOW_MS).select("id", "evict")


def _now(spark: SparkSession, sf_dir: str) -> int:
    return timeline(spark, sf_dir).agg(F.max("occurred_ms")).first()[0] or 0


@query(f"""
WITH e AS (SELECT *, event_type = 'init' OR id = (SELECT id FROM ({TIMELINE_SQL}) y WHERE event_type = 'session_summary' ORDER BY occurred_ms DESC, id LIMIT 1) AS anchor FROM ({TIMELINE_SQL}) x),
k AS (SELECT *, row_number() OVER (ORDER BY occurred_ms DESC, id) AS r FROM e WHERE anchor OR (SELECT max(occurred_ms) FROM e) - occurred_ms <= {20 * DAY_MS})
SELECT id, anchor FROM k WHERE anchor OR r <= 800""")
def timeline_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.timeline_trim(timeline(spark, sf_dir), "id", _now(spark, sf_dir), 20, 800).select("id", "anchor")


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT user_id, occurred_ms FROM ({TIMELINE_SQL}) x),
t AS (SELECT user_id, min(occurred_ms) AS occurred_ms FROM e GROUP BY user_id
  UNION ALL SELECT t.user_id, (SELECT min(e.occurred_ms) FROM e WHERE e.user_id = t.user_id AND e.occurred_ms >= t.occurred_ms + {6 * 3_600_000}) FROM t WHERE t.occurred_ms IS NOT NULL)
SELECT user_id, occurred_ms FROM t WHERE occurred_ms IS NOT NULL""")
def access_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.access_touch(timeline(spark, sf_dir), "user_id", "occurred_ms", 6 * 3_600_000)


@query(f"SELECT coalesce(type, 'context') AS type, status, count(*) AS n FROM ({MEMORIES_SQL}) m GROUP BY 1, 2")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.counts(memories(spark, sf_dir))


@query(f"SELECT count(CASE WHEN status NOT IN ('done', 'cancelled') THEN 1 END) AS pending, count(CASE WHEN status = 'done' THEN 1 END) AS done, count(*) AS total FROM ({TODOS_SQL}) t")
def todo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.todo_stats(todos(spark, sf_dir))


@query(f"""
SELECT priority, round(CAST(count(CASE WHEN status = 'done' THEN 1 END) AS DOUBLE) / count(*), 6) AS progress, min(CASE WHEN status = 'in_progress' THEN id END) AS current_id
FROM ({TODOS_SQL}) t WHERE status <> 'cancelled' GROUP BY priority""")
def phase_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.phase_progress(todos(spark, sf_dir), "priority")


@query(f"""
SELECT id, priority, created_ms FROM ({TODOS_SQL}) t WHERE status NOT IN ('done', 'cancelled')
ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'low' THEN 3 ELSE 2 END, created_ms DESC, id LIMIT 20""")
def active_todos_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.active_todos(todos(spark, sf_dir), 20).select("id", "priority", "created_ms")


@query(f"""
SELECT id, round(0.5 * coalesce(importance, 0.5) + 0.3 * CASE WHEN ({NOW_MS} - created_ms) / 86400000.0 <= 7 THEN 1 ELSE greatest(0, 1 - ({NOW_MS} - created_ms) / 86400000.0 / 90) END + 0.2 * CASE WHEN type IN ('decision', 'architecture', 'bug', 'lesson', 'preference') THEN 1 ELSE 0.5 END, 6) AS score
FROM ({MEMORIES_SQL}) m WHERE status = 'active'""")
def memory_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).where(lifecycle.is_core())
    return rows.select("id", F.round(scores.memory_score(F.col("importance"), F.col("created_ms"), F.col("type"), NOW_MS), 6).alias("score"))


@query("""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS r FROM c)
SELECT CASE WHEN r <= 8 THEN source ELSE 'other' END AS name, CAST(sum(n) AS BIGINT) AS n, round(100.0 * sum(n) / (SELECT count(*) FROM documents), 4) AS percent FROM r GROUP BY 1""")
def lang_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.share_with_tail(table(spark, sf_dir, "documents"), "source", 8)


def _top_todo(status_: str) -> str:
    return f"(SELECT id FROM ({TODOS_SQL}) x WHERE status = '{status_}' ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'low' THEN 3 ELSE 2 END, created_ms DESC, id LIMIT 1)"


#: Rungs of the ladder in SQL: level, action, todo, confidence, and whether there is something on it.
_RUNGS = f"""
SELECT 1 AS level, 'continue' AS action, {_top_todo('in_progress')} AS todo_id, CAST(0.85 AS DOUBLE) AS confidence, EXISTS (SELECT 1 FROM ({TODOS_SQL}) x WHERE status = 'in_progress') AS held
UNION ALL SELECT 2, 'start', {_top_todo('pending')}, 0.70, EXISTS (SELECT 1 FROM ({TODOS_SQL}) x WHERE status = 'pending')
UNION ALL SELECT 3, 'unblock', {_top_todo('blocked')}, 0.50, EXISTS (SELECT 1 FROM ({TODOS_SQL}) x WHERE status = 'blocked')
UNION ALL SELECT 4, 'review', NULL, 0.45, EXISTS (SELECT 1 FROM ({MEMORIES_SQL}) m WHERE status = 'active' AND {NOW_MS} - created_ms <= {7 * DAY_MS})
UNION ALL SELECT 5, 'look_back', NULL, 0.30, EXISTS (SELECT 1 FROM ({TIMELINE_SQL}) e)
UNION ALL SELECT 6, 'plan', NULL, 0.20, true"""


@query(f"SELECT level, action, todo_id, confidence FROM ({_RUNGS}) r WHERE held ORDER BY level LIMIT 1")
def recommend_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.recommend(todos(spark, sf_dir), memories(spark, sf_dir), timeline(spark, sf_dir), NOW_MS).select("level", "action", "todo_id", "confidence")


@query(f"SELECT a.n AS without, r.level, r.action, r.todo_id, r.confidence FROM (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) a JOIN ({_RUNGS}) r ON r.level = (SELECT min(level) FROM ({_RUNGS}) q WHERE held AND level > a.n)")
def recommend_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next step where the first n rungs have nothing: no todo in progress, none pending, none blocked, no memory, no event."""
    t, m, e = todos(spark, sf_dir), memories(spark, sf_dir), timeline(spark, sf_dir)
    out = None
    for n in range(6):
        left = t.where(~F.col("status").isin(["in_progress", "pending", "blocked"][:n])) if n else t
        one = status.recommend(left, m.where("false") if n > 3 else m, e.where("false") if n > 4 else e, NOW_MS).select(F.lit(n).alias("without"), "level", "action", "todo_id", "confidence")
        out = one if out is None else out.unionByName(one)
    return out


_SESSIONS = f"""
SELECT *, CASE WHEN event_type = 'init' THEN 'init' WHEN event_type = 'rescan' THEN NULL ELSE CAST(user_id AS VARCHAR) || ':' || strftime(make_timestamp(occurred_ms * 1000), '%Y-%m-%d') END AS session FROM ({TIMELINE_SQL}) x"""


@query(f"SELECT session, count(*) AS events, min(occurred_ms) AS first_ms, max(occurred_ms) AS last_ms, count(DISTINCT k) AS files, coalesce(bool_or(event_type = 'session_summary'), false) AS has_summary FROM ({_SESSIONS}) s WHERE session IS NOT NULL GROUP BY session")
def session_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.session_nodes(timeline(spark, sf_dir)).select("session", "events", "first_ms", "last_ms", F.size("files").cast("long").alias("files"), "has_summary")


_NODES = f"""
SELECT session, user_id, min(occurred_ms) AS first_ms, list_sort(list(DISTINCT k)) AS files FROM ({_SESSIONS}) s WHERE session IS NOT NULL AND session <> 'init'
GROUP BY session, user_id HAVING bool_or(event_type IN ('session_summary', 'todo', 'memory'))"""


@query(f"""
WITH n AS ({_NODES}), l AS (SELECT session, lag(session) OVER w AS prev, files, lag(files) OVER w AS prev_files FROM n WINDOW w AS (PARTITION BY user_id ORDER BY first_ms, session))
SELECT 'time' AS kind, prev AS src, session AS dst FROM l WHERE prev IS NOT NULL
UNION ALL SELECT 'architecture', prev, session FROM l WHERE prev IS NOT NULL AND list_has_any(files, prev_files)""")
def session_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.session_edges(timeline(spark, sf_dir))


@query(f"""
WITH n AS ({_NODES}), l AS (SELECT session, user_id, first_ms, files, lag(session) OVER w AS prev, lag(files) OVER w AS prev_files FROM n WINDOW w AS (PARTITION BY user_id ORDER BY first_ms, session)),
e AS (SELECT session AS node FROM l WHERE list_has_any(files, prev_files) UNION SELECT prev FROM l WHERE list_has_any(files, prev_files))
SELECT n.session, e.node IS NOT NULL AS important, count(*) OVER (PARTITION BY n.user_id) <= 3 OR CAST(row_number() OVER (PARTITION BY n.user_id ORDER BY n.first_ms DESC, n.session) AS BIGINT) <= 2 OR e.node IS NOT NULL AS visible FROM n LEFT JOIN e ON e.node = n.session""")
def session_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.visible_nodes(timeline(spark, sf_dir), 2, 3).select("session", "important", "visible")


@query("""
WITH l AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT user_id, CAST(epoch_us(min(ts)) // 1000 AS BIGINT) AS start_ms, CAST(epoch_us(max(ts)) // 1000 AS BIGINT) + 1800000 AS end_ms, count(*) AS n FROM s GROUP BY user_id, sid""")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    by = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return by.select("user_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")


@query("""
WITH a AS (SELECT CAST(floor(o_orderkey / 3.0) AS BIGINT) AS path, md5(CAST(max(o_totalprice) AS VARCHAR)) AS hash FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT CAST(floor(o_orderkey / 3.0) AS BIGINT) AS path, md5(CAST(max(o_totalprice) AS VARCHAR)) AS hash FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash""")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    side = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy(F.floor(F.col("o_orderkey") / 3).alias("path")).agg(F.max("o_totalprice").cast("string").alias("hash"))
    return graph.tree_diff(side("F"), side("O"))


@query("""
WITH m AS (SELECT conv_id, turn, upper(role) || ': ' || text AS line FROM conversations WHERE role IN ('user', 'assistant')),
c AS (SELECT conv_id, turn, line, coalesce(sum(least(length(line), 1000000) + 2) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m)
SELECT conv_id, turn, CAST(least(length(line), 800 - used) AS BIGINT) AS kept, right(line, CAST(least(length(line), 800 - used) AS BIGINT)) AS line FROM c WHERE used < 800""")
def transcript_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.budget(table(spark, sf_dir, "conversations"), 800)


@query("""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn FROM r WHERE n <= 5 OR a <= 2 OR z <= 3""")
def context_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.head_tail(table(spark, sf_dir, "conversations"), 2, 3).select("conv_id", "turn")


@query("""
SELECT doc_id, text <> r AS changed, length(r) AS n FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '-----BEGIN [^-]*PRIVATE KEY-----[\\s\\S]*?-----END [^-]*PRIVATE KEY-----', '[REDACTED_PRIVATE_KEY]', 'gi'),
 '\\bBearer\\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'gi'),
 '\\b(api[_-]?key|access[_-]?token|auth[_-]?token|password|secret)\\s*[:=]\\s*["'']?[^\\s"'']{6,}["'']?', '\\1=[REDACTED]', 'gi'),
 '\\b(?:sk|ghp|github_pat|xox[baprs])[-_][A-Za-z0-9_-]{12,}\\b', '[REDACTED_TOKEN]', 'g') AS r FROM documents) x""")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = redact("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("text") != clean).alias("changed"), F.length(clean).cast("long").alias("n"))


#: What turns of the conversations say first, so that every rung of the signals meets rows; those of a role are dealt by the length of their text.
_OPENINGS = ("remember: ", "we commit and bear in mind ", "from now on, ", "always keep ", "记住：", "下次注意，", "let's never ", "please run eslint and note this: ", "don't forget ", "以后 tests 要记得 ", "note ", "")
_MESSAGE = "CASE length(text) % 12 " + " ".join(f"WHEN {i} THEN '{o.replace(chr(39), chr(39) * 2)}'" for i, o in enumerate(_OPENINGS)) + " END || substr(text, 1, 120)"


def _signal_sql(ladder: list[tuple[str, str]]) -> str:
    """The first content of a ladder of (pattern, options) in SQL."""
    clean = lambda p, o: f"regexp_replace(regexp_replace(regexp_extract(t, '{p}', 1, '{o}'), '^[,，、;；:：\\s]+', ''), '[,，、;；:：\\s]+$', '')"
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}', '{o}') AND length({clean(p, o)}) BETWEEN 4 AND 500 THEN {clean(p, o)} END" for p, o in ladder) + ")"


_STRONG_SQL = _signal_sql([("(?:记住|记一下|备忘|别忘了|长期记住)\\s*[:：]?\\s*([^。\\n]{4,200})", "c"), ("以后\\s*([^。\\n]{2,80})\\s*(?:要|请|一定)?\\s*(?:做|处理|记得|注意)", "c"), ("(?:remember|note that|don''t forget|never forget|long-term remember)\\s*[:：]?\\s*([^.\\n]{4,200})", "i"), ("\\b(always|never)\\s+([a-z][^.\\n]{4,150})", "i")])
_WEAK_SQL = _signal_sql([("(?:以后都|以后请|以后记得|下次记得|下次注意|约定|规则是|从今往后|今后)\\s*[:：,，]?\\s*([^。\\n]{4,150})", "c"), ("(?:记住这个|注意这个|留意一下|请注意)\\s*[:：,，]?\\s*([^。\\n]{4,150})", "c"), ("\\b(going forward|from now on|henceforth|note this|bear in mind|keep in mind)\\b\\s*[:：,，]?\\s*([^.]{4,150})", "i"), ("\\b(let''?s (?:always|never))\\b\\s+([^.]{4,150})", "i")])


@query(f"""
WITH m AS (SELECT conv_id, turn, trim({_MESSAGE}) AS t FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, {_STRONG_SQL} AS strong, CASE WHEN NOT regexp_matches(t, '\\b(?:eslint|prettier|type:|noqa|tsconfig|build\\s*error)\\b|\\b(?:commit|push|pr|merge|git)\\b', 'i') THEN {_WEAK_SQL} END AS weak FROM m WHERE length(t) BETWEEN 6 AND 2000)
SELECT conv_id, turn, CASE WHEN strong IS NOT NULL THEN 'strong' ELSE 'weak' END AS strength, coalesce(strong, weak) AS content FROM s WHERE strong IS NOT NULL OR weak IS NOT NULL""")
def signal_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(_MESSAGE).alias("text"))
    return transcript.signals(said).select("conv_id", "turn", "strength", "content")


_NORM = "lower(regexp_replace({c}, '[\\s\\p{{P}}]', '', 'g'))"


@query(f"""
WITH b AS (SELECT item_id, {_NORM.format(c='substr(trim(text), 1, 200)')} AS e FROM benchmark), d AS (SELECT doc_id, {_NORM.format(c='text')} AS t FROM documents)
SELECT item_id, doc_id FROM b JOIN d ON contains(t, e) OR (length(e) > 30 AND len(list_filter(generate_series(0, greatest(length(e) - 30, 0), 15), lambda i: contains(t, substr(e, i + 1, 30)))) > 0) WHERE length(e) >= 6""")
def grounding_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.grounding(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
 '<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))


@query("""
SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages""")
def endpoint_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", F.lower(part("^([a-zA-Z]+)://")).alias("scheme"), F.lower(part("^[a-zA-Z]+://([^/:?#]+)")).alias("host"), part("^[a-zA-Z]+://[^/?#]+([^?#]*)").alias("path"))


@query("""
SELECT page_id, len(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1)) AS n_links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1))), ' ') AS links FROM pages""")
def import_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]+)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("links"))
