import hashlib
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import media, order, queries
from lorekeep.llm.packing import cut_pieces


def test_wav_round_trip_and_digests(spark, hard_docs, tables):
    rows = queries.QUERIES["op1_wav_fingerprints"](spark, tables(documents=hard_docs)).collect()
    assert len(rows) == hard_docs.count()
    by_text = {}
    for r, d in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.n_bytes)), sorted(hard_docs.collect(), key=lambda r: (str(r.doc_id), len((r.text or "").encode()))), strict=True):
        raw = (d.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(payload) + 44
        assert r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest()
        assert by_text.setdefault(raw, r.feature) == r.feature


def test_peaks_by_brute_force():
    samples = np.random.default_rng(0).integers(0, 256, 192 * 40, dtype=np.uint8)
    s = media.spectrogram(samples.reshape(-1, 192))
    s[:, 0] = 0
    want = [(t, f) for t in range(s.shape[0]) for f in range(s.shape[1]) if s[t, f] > 0 and s[t, f] == s[max(0, t - 3) : t + 4, max(0, f - 6) : f + 7].max()]
    t, f = media.peaks(samples)
    assert sorted(zip(t.tolist(), f.tolist(), strict=True)) == want
    old, media.BLOCK = media.BLOCK, 7  # blocks don't change the peaks
    try:
        t2, f2 = media.peaks(samples)
    finally:
        media.BLOCK = old
    assert sorted(zip(t2.tolist(), f2.tolist(), strict=True)) == want


def test_constant_samples_have_no_pairs():
    times, codes = media.fingerprint(np.full(192 * 3, 128, np.uint8))
    assert not len(times) and not len(codes)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**63))
def test_feistel_is_a_permutation(n, key):
    assert sorted(order.permute(np.arange(n), n, key).tolist()) == list(range(n))


def test_training_order_places_every_sequence(spark, hard_docs, no_docs, tmp_path):
    files = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    order.training_shards(hard_docs, "doc_id", "text", *files, str(tmp_path / "shards"), length=64, per_shard=100)
    shards = spark.read.parquet(str(tmp_path / "shards"))
    rows = order.records(shards, 64).collect()
    slots = {r.shard * 100 + r.at: r for r in rows}
    assert sorted(slots) == list(range(len(rows)))
    pieces = cut_pieces(hard_docs, "doc_id", "text", *files, 64).collect()
    want = sorted((str(p.doc_id), p.piece, np.frombuffer(p.ids, "<u4").astype("<u2").tobytes().ljust(128, b"\0")) for p in pieces)
    assert sorted((str(r.key), r.part, bytes(r.record)) for r in rows) == want
    some = order.read_slots(spark, str(tmp_path / "shards"), 95, 205, 64, 100).collect()
    # by brute force: numbered by hash, key and place, then permuted, whatever the split of the input
    hashes = {(str(r.doc_id), r.text): r.h for r in hard_docs.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 1).alias("h")).collect()}
    texts = {h: k for k, h in hashes.items()}
    assert len(texts) == len(hashes)
    by_slot = [slots[int(s)] for s in order.permute(np.arange(len(rows)), len(rows), 1)]
    want = sorted((h, n) for (k, _), h in hashes.items() for n in range(sum(p.piece is not None and str(p.doc_id) == k for p in pieces) if k not in ("None", "2") else 0))
    got = [(r.key, r.part) for r in by_slot if r.key not in (None, 2)]
    assert got == [(int(texts[h][0]), n) for h, n in want]
    again = order.records(order.materialised(hard_docs.repartition(7), "doc_id", "text", *files, 64, 100), 64).collect()
    assert sorted((r.shard, r.at, str(r.key), r.part, bytes(r.record)) for r in again) == sorted((r.shard, r.at, str(r.key), r.part, bytes(r.record)) for r in rows)
    assert {r.slot: bytes(r.record) for r in some} == {k: bytes(v.record) for k, v in slots.items() if 95 <= k < 205}
    assert order.materialised(no_docs, "doc_id", "text", *files).count() == 0


def test_training_query(spark, hard_docs, tables):
    rows = queries.QUERIES["op2_training_order"](spark, tables(documents=hard_docs.withColumn("slot", F.lit(1)).withColumn("key", F.lit("x")))).collect()
    pieces = cut_pieces(hard_docs, "doc_id", "text", P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), 512).collect()
    want = sorted((str(p.doc_id), p.piece, p.length, zlib.crc32(np.frombuffer(p.ids, "<u4").astype("<u2").tobytes().ljust(1024, b"\0"))) for p in pieces)
    assert sorted((str(r.doc_id), r.part, r.n_tokens, r.record_crc32) for r in rows) == want
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all((r.shard, r.byte_offset) == (r.slot // queries.SHARD, r.slot % queries.SHARD * 1024) for r in rows)


def test_media_replaces_its_columns_and_takes_no_rows(spark):
    from lorekeep.llm.media import media_columns

    df = spark.createDataFrame([("abc", 1, 2, "m"), (None, 3, 4, "n")], "text string, media int, codes int, other string")
    got = media_columns(df, "text").collect()
    assert [(bytes(r.payload), r.other) for r in got] == [(b"abc".ljust(192), "m"), (b" " * 192, "n")] and set(got[0].asDict()) == {"text", "other", "media", "payload", "times", "codes"}
    assert media_columns(df.where("other = 'x'"), "text").collect() == []
