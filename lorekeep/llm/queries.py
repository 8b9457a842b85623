"""The thin ``opN_<name>`` queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


SHARDS = 24


@query
def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"))
    out = shard_rows(rows, "doc_id", [1.0] * SHARDS, order=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op9_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, score, train

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import learn, scan

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, learn(docs)).drop("text")
    told = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "format"), told), ",")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", told), ",").alias("spans"))


@query
def op1_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    body = F.coalesce(F.col("text"), F.lit(""))
    found = media_columns(documents(spark, sf_dir).select("doc_id", body.alias("text")), "text")
    return found.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("/", F.size("codes"), F.sha2(F.array_join("times", ",").cast("binary"), 256), F.sha2(F.array_join("codes", ",").cast("binary"), 256)).alias("feature"),
    )


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    ids = encode_decode(documents(spark, sf_dir).select("doc_id", "text"), "text", tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Tokens of a packed sequence.
SEQUENCE = 2048


@query
def op6_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    out = pack_documents(documents(spark, sf_dir), "doc_id", "text", tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), SEQUENCE)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: Tokens of a training record, and records of a shard.
RECORD, SHARD = 512, 8192


@query
def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order import materialised, records

    shards = materialised(documents(spark, sf_dir), "doc_id", "text", tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), RECORD, SHARD)
    return records(shards, RECORD).select(
        F.col("key").alias("doc_id"),
        "part",
        (F.col("shard") * SHARD + F.col("at")).alias("slot"),
        "shard",
        (F.col("at") * (2 * RECORD)).alias("byte_offset"),
        "n_tokens",
        F.crc32("record").alias("record_crc32"),
    )


#: Cosine from which two vectors of a label link.
LEAST_COSINE = 0.98


@query
def op7_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .metric import range_join

    out = range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label", LEAST_COSINE)
    return out.select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


@query
def op4_count_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(documents(spark, sf_dir), "doc_id", "text")


#: Words of a passage that op8 tells of where it stands elsewhere too: passages of over 50 words, whatever their bytes.
PASSAGE_WORDS = 51


@query
def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), report=PASSAGE_WORDS)
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.octet_length("text") - F.octet_length("kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("passage_bytes"),
    )


@query
def op11_slice_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op12_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import document_fingerprints

    return document_fingerprints(documents(spark, sf_dir), "doc_id", "text")


@query
def op13_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compress

    out = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    return out.select("vec_id", "code", *(F.col(c).try_cast("long").alias(c) for c in ("error", "label_error")), "codebooks_sha256")


# SQL twins where SQL can express the whole result (op3 needs CRC-32, the others hashes of ids, samples or models).
ORACLE_SQL["op7_metric_range_join"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) c ON c.id = e.vec_id"""
ORACLE_SQL["op4_count_tree_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (n + m - c)),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) c ON c.id = s.doc_id"""
