"""Ranked retrieval: BM25, vectors, fused scores, reciprocal ranks, diversified selection.

A query's tokens are a few literals, so statistics are counted only for them: one narrow pass gives
each document's counts of them, and one global aggregate of a fixed number of rows gives
document frequencies and the mean length. Nothing is exploded or shuffled by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import jaccard, tokens
from . import ordered

K1, B, RRF_K = 1.2, 0.75, 60


def query_tokens(spark, query: str) -> list[str]:
    """Distinct tokens of the query in order, by the same expression as the documents'."""
    row = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t")).first()
    return list(row.t)


def _times(array: str, term: str) -> Column:
    """How often the term stands in the array."""
    return F.size(F.filter(array, lambda x: x == term))


def bm25(docs: DataFrame, key: str, document: Column, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """``key, score`` of the documents that hold a token of the query."""
    terms = query_tokens(docs.sparkSession, query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).where("false")
    # The long array is walked once, for all terms; each term is counted among the few that are left.
    split = docs.select(key, tokens(document).alias("_t")).select(key, F.size("_t").alias("_len"), F.filter("_t", lambda x: x.isin(*terms)).alias("_hits"))
    # A few numbers a document, written once: both the statistics and the scores read them, and texts are split once.
    counted = ordered.cut(split.select(key, "_len", *(_times("_hits", t).alias(f"_tf{i}") for i, t in enumerate(terms))))
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))))
    total = F.lit(0.0)
    for i in range(len(terms)):
        tf, df, n = F.col(f"_tf{i}"), F.col(f"_df{i}"), F.col("_n")
        idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
        total = total + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))).otherwise(0.0)
    # one row of statistics, whatever the input
    return counted.crossJoin(F.broadcast(stats)).select(key, total.alias("score")).where("score > 0")


def top(ranked: DataFrame, k: int, score: str, key: str) -> DataFrame:
    """The k best rows; ties go to the lesser key."""
    return ranked.orderBy(F.desc(score), F.asc(key)).limit(k)


def vector_recall(vectors: DataFrame, key: str, vector: str, query: list[float]) -> DataFrame:
    """``key, score`` of vectors with a cosine over 0."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, scores.cosine(F.col(vector), q).alias("score")).where("score > 0")


def with_normalised(df: DataFrame, c: str, name: str) -> DataFrame:
    """``c`` divided by its greatest value, joined from a one-row aggregate instead of a global window."""
    best = df.agg(F.max(c).alias("_best"))
    return df.crossJoin(F.broadcast(best)).withColumn(name, F.when(F.col("_best") > 0, F.col(c) / F.col("_best")).otherwise(0.0)).drop("_best")


def fused(df: DataFrame, now_ms: int, has_query: bool = True, has_vectors: bool = False, weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``relevance``: the weighted factors times trust.

    Needs ``keyword`` and ``vector`` (0 to 1), ``importance``, ``confidence``, ``touched_ms``, ``type``.
    """
    w = dict(scores.WITH_QUERY if has_query else scores.WITHOUT_QUERY) | (weights or {})
    if not has_vectors:
        w["vector"] = 0.0
    importance, confidence = F.coalesce("importance", F.lit(0.5)), F.coalesce("confidence", F.lit(0.6))
    stable = F.when(F.col("type").isin(*scores.STABLE_TYPES), 1.0).otherwise(0.35)
    total = (
        F.coalesce("keyword", F.lit(0.0)) * w["keyword"]
        + F.coalesce("vector", F.lit(0.0)) * w["vector"]
        + importance * w["importance"]
        + confidence * w["confidence"]
        + scores.recency(F.col("touched_ms"), now_ms) * w["recency"]
        + stable * w["type"]
    )
    return df.withColumn("relevance", total * scores.trust(F.col("confidence")))


def rrf(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """``key, relevance, score_0, score_1, ...``: the sum of reciprocal ranks in lists of ``key, score``, each taken whole."""
    both = None
    for i, scored in enumerate(lists):
        rows = ordered.ranked(scored.select(key, "score"), [F.desc("score"), F.asc(key)], "_rank")
        part = rows.select(key, (1 / (k + F.col("_rank"))).alias("_part"), *((F.col("score") if i == j else F.lit(0.0)).alias(f"score_{j}") for j in range(len(lists))))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(key).agg(F.sum("_part").alias("relevance"), *(F.max(f"score_{j}").alias(f"score_{j}") for j in range(len(lists))))


SIMILAR, SAME_TYPE = 0.22, 0.08


def diversified(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Greedy selection of k rows by relevance, less similarity to and types among those chosen: ``key, position, score``.

    Needs ``relevance``, ``type`` and ``tokens`` (array). Each of the k rounds is a distributed top-1; what comes
    to the driver is the row chosen, and once the 8 k most relevant. The rows are written once, and each round compares
    only those whose relevance reaches a score that one of these is sure to have.
    """
    spark = rows.sparkSession
    now = ordered.cut(rows.select(key, "type", "relevance", F.array_distinct("tokens").alias("tokens")))
    chosen: list[tuple] = []
    types: dict[str | None, int] = {}
    tokens: list[list[str]] = []
    head = now.orderBy(F.desc("relevance"), F.asc(key)).limit(8 * k).select(key, "type", "relevance", "tokens").collect()  # 8 k rows
    for position in range(1, k + 1):
        gone = [c[0] for c in chosen]
        same = F.lit(0)
        for t, n in types.items():
            if n > 1:
                same = F.when(F.col("type").eqNullSafe(F.lit(t)), n - 1).otherwise(same)
        # No row scores more than its relevance, so rows below a score that is to be had can't be chosen.
        floor = max((r.relevance - SIMILAR * max((_alike(set(r.tokens), set(t)) for t in tokens), default=0.0) - SAME_TYPE * max(0, types.get(r.type, 0) - 1) for r in head if r[key] not in gone), default=None)
        near = F.lit(0.0)
        if tokens:
            held = spark.createDataFrame([(tokens,)], "_chosen array<array<string>>")  # at most k rows' tokens
            now_ = now.crossJoin(F.broadcast(held))
            near = F.aggregate("_chosen", F.lit(0.0), lambda m, c: F.greatest(m, jaccard(F.col("tokens"), c)))
        else:
            now_ = now
        left = now_.where(~F.col(key).isin(gone)) if gone else now_
        if floor is not None:
            left = left.where(F.col("relevance") >= floor - 1e-12)
        best = left.withColumn("score", F.round(F.col("relevance") - SIMILAR * near - SAME_TYPE * same, 9)).orderBy(F.desc("score"), F.desc("relevance"), F.asc(key)).limit(1).select(key, "type", "tokens", "score").collect()
        if not best:
            break
        chosen.append((best[0][key], position, best[0].score))
        types[best[0].type] = types.get(best[0].type, 0) + 1
        tokens.append(best[0].tokens)
    return spark.createDataFrame(chosen, f"{key} {rows.schema[key].dataType.simpleString()}, position int, score double")


def _alike(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


def lexical(df: DataFrame, query_terms: list[str], title: str, fields: list[str]) -> Column:
    """+1 for each term found in the title or a field, and +1 more if in the title."""
    total = F.lit(0)
    for t in query_terms:
        in_title = F.contains(F.lower(F.coalesce(F.col(title), F.lit(""))), F.lit(t))
        anywhere = in_title
        for f in fields:
            anywhere = anywhere | F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(t))
        total = total + anywhere.cast("int") + in_title.cast("int")
    return total
