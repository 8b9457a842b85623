import zlib
from collections import Counter

from pyspark.sql import functions as F

from lorekeep.llm import queries
from lorekeep.llm.sharding import shard_rows


def test_query_contract(spark, hard_docs, tables):
    rows = queries.QUERIES["op3_rendezvous_shards"](spark, tables(documents=hard_docs)).collect()
    assert len(rows) == hard_docs.count() and {r.law for r in rows} == {"key"}
    texts = Counter((d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in hard_docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    owner = {}
    for r in rows:
        assert owner.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 24)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_weights_hot_keys_and_growth(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.lit("x").alias("shard_name"), F.lit("old").alias("shard"), F.lit(1).alias("slot"), F.lit(2).alias("grown_shard"))
    out = shard_rows(rows, "k", [1.0, 2.0, 0.0, 1.0]).collect()
    n = Counter(r.shard for r in out if r.k != 7)
    assert n[2] == 0 and 1.7 < n[1] / n[0] < 2.4 and len(out) == 6000
    moved = [r for r in out if r.grown_shard != r.shard]
    assert all(r.grown_shard == 4 for r in moved) and 0.1 < len({r.k for r in moved}) / 4000 < 0.3
    for s in n:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_empty(spark, no_docs):
    assert shard_rows(no_docs.select("doc_id"), "doc_id", [1.0]).count() == 0
