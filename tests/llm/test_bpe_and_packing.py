import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import packing, queries
from lorekeep.llm.bpe import Codec
from lorekeep.llm.tokens import encoder, load_ranks

RANKS = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
REAL = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = Codec(RANKS, P.PATTERN)


def test_query_contract(spark, hard_docs, tables):
    rows = queries.QUERIES["op5_matrix_bpe"](spark, tables(documents=hard_docs)).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows), key=str)
    want = []
    for d in hard_docs.collect():
        ids = REAL.encode_ordinary(d.text or "")
        want.append((d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab cé", max_size=400))
def test_like_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = CODEC.encode([text])[0]
    assert ids.tolist() == REAL.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_pieces():
    rng = random.Random(1)
    for n in (257, 1000, 5000):
        for alphabet in ("a", "ab", "abcdefghij", "éà日"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert CODEC.encode([text])[0].tolist() == REAL.encode_ordinary(text)


def test_both_libraries_agree(hard_docs):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    for d in hard_docs.collect():
        assert encode(d.text or "").tolist() == exact.encode(d.text or "", add_special_tokens=False).ids
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def check_packed(rows, size):
    by = {}
    for seq, offset, length in rows:
        by.setdefault(seq, []).append((offset, length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_pack_query(spark, hard_docs, tables):
    from tokenizers import Tokenizer

    rows = queries.QUERIES["op6_certified_packing"](spark, tables(documents=hard_docs.withColumn("piece", F.lit(1)).withColumn("_id", F.lit("x")))).collect()
    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = lambda t: exact.encode(t, add_special_tokens=False).ids
    want = []
    for d in hard_docs.collect():
        ids = np.append(encode(d.text or ""), 0).astype("<u4")
        first = len(ids) % 2048 or min(len(ids), 2048)
        stops = [first, *range(first + 2048, len(ids) + 1, 2048)]
        want += [(d.doc_id, p, a, z - a, zlib.crc32(ids[a:z].tobytes())) for p, (a, z) in enumerate(zip([0, *stops], stops, strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    n = check_packed([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
    assert n <= math.ceil(packing.lower_bound(np.array([r.length for r in rows]), 2048) - 1e-9) + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_bound_is_below_best_fit(lengths):
    lengths = np.sort(np.array(lengths, np.int64))[::-1]
    _, room = packing.best_fit_decreasing(lengths, 100)
    assert math.ceil(packing.lower_bound(lengths, 100) - 1e-9) <= len(room)


def test_bound_knows_halves():
    assert packing.lower_bound(np.full(10, 51), 100) == 10
    assert packing.lower_bound(np.full(9, 34), 100) == 4.5


def test_exchange_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 50)
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 1500, 3000).tolist()
    df = spark.createDataFrame(list(enumerate(lengths)), "_id long, length long")
    rows = df.join(packing.pack(df, 2048), "_id").collect()
    assert len(rows) == 3000
    n = check_packed([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
    assert n <= packing.lower_bound(np.array(lengths), 2048) * 1.005 + 1


def test_groups_stay_bounded_where_the_bound_is_weak(spark, monkeypatch):
    """No two of 600 to 1000 fill a sequence of 2048 with a third to spare: the gap never closes, groups must not grow."""
    monkeypatch.setattr(packing, "PIECES", 100)
    real = packing._packed
    rng = np.random.default_rng(6)
    groups = {g: rng.integers(600, 1000, 100) for g in range(8)}
    table = packing.pa.concat_tables(
        packing.pa.Table.from_batches([real(np.arange(100) + 100 * g, lengths, 2048, g, 0, False)]) for g, lengths in groups.items()
    )
    opened = table.filter(table.column("_open"))
    assert 0 < opened.num_rows <= 100
    lengths = [*rng.integers(600, 1000, 3000).tolist()]
    df = spark.createDataFrame(list(enumerate(lengths)), "_id long, length long")
    out = df.join(packing.pack(df, 2048), "_id")
    n = check_packed([(r.sequence_id, r.offset, r.length) for r in out.collect()], 2048)
    used, least = packing.certificate(out, 2048)
    assert used == n >= least and n <= 1550


def test_empty(spark, no_docs):
    assert packing.pack_documents(no_docs, "doc_id", "text", P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), 64).count() == 0


def test_encode_decode_replaces_its_columns_and_takes_no_rows(spark):
    import public_tokenizers

    from lorekeep.llm.bpe import encode_decode
    from lorekeep.llm.queries import tokenizer

    given = (tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    df = spark.createDataFrame([("a b", 7, b"x", 1), (None, 8, None, 2)], "ids string, decoded int, _id binary, n int")
    got = encode_decode(df.withColumn("text", df.ids), "text", *given).collect()
    assert [(bytes(r.decoded), r.n) for r in got] == [(b"a b", 1), (b"", 2)] and set(got[0].asDict()) == {"_id", "n", "text", "ids", "decoded"}
    assert encode_decode(df.where("n > 5").withColumn("text", df.ids), "text", *given).collect() == []
