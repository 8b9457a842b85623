import hashlib
import random

import pytest

from lorekeep.llm import simhash


def brute(rows):
    """Of rows (key, text) what follows from their order by key, nulls first."""
    out = []
    for i, (k, t) in enumerate(rows):
        follower = rows[(i + 1) % len(rows)][1] or ""
        t = t or ""
        e = t[: len(t) - len(t) // 2] + follower[: len(t) // 2]
        p, q, r = simhash.fingerprints([t, e, follower])
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), p.hex(), q.hex(), simhash.likeness(p, q), simhash.likeness(p, r)))
    return out


def names(n, rng):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.mark.parametrize("drawn", [simhash.DRAWN, 1])
def test_followers_by_brute_force(spark, drawn, monkeypatch):
    monkeypatch.setattr(simhash, "DRAWN", drawn)
    rng = random.Random(1)
    vocabulary = names(300, rng)
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 9, 80, 700])))) for k in rng.sample(range(10_000), 300)]
    rows += [(20_000, None), (20_001, ""), (20_002, "日本語のテキスト" * 30), (20_003, "x" * 5000), (None, "a row without a key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in simhash.with_followers(df, "doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=key) == brute(rows)


def test_repeated_rows_one_row_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d")] * 5 + [(2, "e f g h")], "doc_id long, text string")
    got = [r.near_next for r in simhash.with_followers(df, "doc_id", "text").where("doc_id = 1").collect()]
    assert sorted(got)[1:] == [1.0] * 4 and min(got) < 0.7
    one = simhash.document_fingerprints(df.where("doc_id = 2"), "doc_id", "text").collect()
    assert [(r.near_next, r.n_near, r.edited_sha256) for r in one] == [(1.0, 0, hashlib.sha256(b"e f e f").hexdigest())]
    assert simhash.document_fingerprints(df.where("doc_id = 3"), "doc_id", "text").collect() == []


def test_bits_by_counting_votes():
    """The votes of a text, term by term, in integers."""
    import numpy as np

    from lorekeep.llm.shingles import mix
    from lorekeep.llm.suffix import word_symbols

    text = " ".join(random.Random(4).choices(names(40, random.Random(5)), k=200))
    word = word_symbols([text])[0]
    terms = [(int(w), 8) for w in word] + [(int(mix(mix(np.array([a], np.uint64)) ^ np.array([b], np.uint64))[0]), 16) for a, b in zip(word, word[1:], strict=False)]
    votes = [0] * simhash.BITS
    for term, base in set(terms):
        weight = int(np.floor(base * (1 + np.log2(terms.count((term, base))))))
        for k in range(simhash.BITS // 64):
            lane = int(mix(np.array([(term + (k + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]).to_bytes(8, "little")
            for i in range(64):
                votes[64 * k + i] += weight if lane[i // 8] >> (7 - i % 8) & 1 else -weight
    assert simhash.fingerprints([text])[0] == np.packbits(np.array(votes) > 0).tobytes()


@pytest.mark.parametrize(("radius", "piece"), [(7, 4096), (7, 5), (3, 64), (0, 4096)])
def test_near_counts_by_brute_force(spark, radius, piece, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = random.Random(radius)
    prints = []
    for _ in range(6):
        base = rng.getrandbits(256)
        for _ in range(20):
            p = base
            for bit in rng.sample(range(256), rng.randint(0, 6)):
                p ^= 1 << bit
            prints += [p] * rng.choice([1, 1, 3])
    df = spark.createDataFrame([(f"{p:064x}",) for p in prints] + [(None,)], "f string")
    got = {int(r.fingerprint, 16): (r.copies, r.n_near) for r in simhash.near_counts(df, "f", radius).collect()}
    assert got == {p: (prints.count(p), sum((p ^ q).bit_count() <= radius for q in prints) - 1) for p in prints}


def test_query_and_clashing_names(spark, hard_docs, tables):
    from lorekeep.llm import queries

    docs = hard_docs.withColumn("fingerprint", hard_docs.text).withColumn("part", hard_docs.doc_id).withColumn("_hash", hard_docs.text)
    got = queries.op12_simhash_blocks(spark, tables(documents=docs)).collect()
    assert len(got) == docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == [r for r in got if r.doc_id == 2][0].fingerprint and by[1].n_near == 2
    assert by[15].near_edited > 0.3 and by[15].n_chars == len(hard_docs.where("doc_id = 15").first().text)


def test_half_edits_are_likelier_than_strangers(spark, sf_dir):
    from lorekeep.llm import queries

    rows = queries.op12_simhash_blocks(spark, sf_dir).where("n_chars > 400").collect()
    assert sum(r.near_edited for r in rows) / len(rows) > 0.35
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)
