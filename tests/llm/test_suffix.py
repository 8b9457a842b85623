import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import queries, suffix


def test_names_that_clash_are_replaced(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdef ") for _ in range(900)) for _ in range(4)]
    texts += [texts[0][:500] + texts[1][:500], texts[2], "tiny"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = suffix.F.xxhash64
    # the first name of all texts is one of two; the second tells them apart
    monkeypatch.setattr(suffix.F, "xxhash64", lambda *c: suffix.F.pmod(real(*c), suffix.F.lit(2)) if len(c) == 2 and "octet_length" in str(c[1]) else real(*c))
    got = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
    assert [(len(texts[i]), len(texts[i]) - len(got[i].kept), len(got[i].spans), hashlib.sha256(bytes(got[i].kept)).hexdigest()) for i in range(len(texts))] == brute(texts, 400)


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(raws):
        for a in range(len(b) - length + 1):
            seen.setdefault(b[a : a + length], []).append((i, a))
    gone = [set() for _ in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                gone[i].update(range(a, a + length))
    out = []
    for b, g in zip(raws, gone, strict=True):
        kept = bytes(x for k, x in enumerate(b) if k not in g)
        out.append((len(b), len(g), sum(k in g and k - 1 not in g for k in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(s):
    assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_of_fibonacci_and_runs():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for s in (b, [1] * 700, [0, 1] * 300, list(range(50, 0, -1))):
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_longest_common():
    s = [1, 2, 1, 2, 1, 3]
    array = suffix.suffix_array(s)
    common = suffix.longest_common(s, array)
    for r in range(1, len(s)):
        x, y = s[array[r - 1] :], s[array[r] :]
        assert common[r] == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_query_on_hard_rows(spark, hard_docs, tables):
    rows = queries.QUERIES["op8_suffix_repeats"](spark, tables(documents=hard_docs)).collect()
    docs = hard_docs.collect()
    want = [(d.doc_id, *b) for d, b in zip(docs, brute([d.text for d in docs], 400), strict=True)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str) == sorted(want, key=str)
    left, unbroken = brute_words([d.text or "" for d in docs], 51), (12, 13, 14, 16, 17)  # scripts and runs without white space count otherwise
    passages = Counter((d.doc_id, len(w) < len((d.text or "").split())) for d, w in zip(docs, left, strict=True) if d.doc_id not in unbroken)
    assert Counter((r.doc_id, r.n_passages > 0) for r in rows if r.doc_id not in unbroken) == passages
    assert all((r.n_passages > 0) == (r.passage_bytes > 0) for r in rows)


def test_many_near_copies_by_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdef ") for _ in range(4000))
    texts = []
    for _ in range(60):
        a = rng.randint(0, 2000)
        t = list(base[a : a + rng.randint(300, 1800)])
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = "Z"
        texts.append("".join(t) + ("q" * rng.randint(0, 900) if rng.random() < 0.2 else ""))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts, 400)
    for piece, symbols in ((4096, 300_000), (3, 300_000), (4096, 20)):
        monkeypatch.setattr(suffix, "PIECE", piece)
        monkeypatch.setattr(suffix, "MOST_SYMBOLS", symbols)
        got = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
        assert [(len(texts[i]), len(texts[i]) - len(got[i].kept), len(got[i].spans), hashlib.sha256(bytes(got[i].kept)).hexdigest()) for i in range(len(texts))] == want


def test_empty_and_clashing_columns(spark, no_docs):
    assert suffix.remove_repeats(no_docs).count() == 0
    df = spark.createDataFrame([(1, "abc", "old", 3)], "doc_id long, text string, kept string, id int")
    assert suffix.remove_repeats(df).first().id == 3


def brute_words(texts, n):
    """Per text the words that are left, by every window of n words of two places."""
    parts = [t.split() for t in texts]
    seen = {}
    for i, w in enumerate(parts):
        for a in range(len(w) - n + 1):
            seen.setdefault(tuple(w[a : a + n]), []).append((i, a))
    gone = {(i, k) for places in seen.values() if len(places) > 1 for i, a in places for k in range(a, a + n)}
    return [[x for k, x in enumerate(w) if (i, k) not in gone] for i, w in enumerate(parts)]


def test_words_by_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijкл") for _ in range(rng.randint(1, 9)))
    passages = [[word() for _ in range(n)] for n in (50, 51, 52, 53, 60, 80, 140)]
    texts = []
    for _ in range(60):
        out = [word() for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            k = rng.randint(0, 3)
            out += p[k:] + [word() for _ in range(rng.randint(0, 40))]
        texts.append("".join(w + rng.choice([" ", "\n", "  "]) for w in out))
    texts += [" ".join("x" * 51), " ".join("y" * 50), " ".join("y" * 50), " ".join(passages[4]), " ".join(passages[4])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in suffix.remove_repeats(df, words=51).collect()}
    for i, (t, want) in enumerate(zip(texts, brute_words(texts, 51), strict=True)):
        assert bytes(got[i].kept).decode().split() == want, i
        raw = t.encode()
        assert len(bytes(got[i].kept)) == len(raw) - sum(s.stop - s.start for s in got[i].spans)
    assert sum(map(len, brute_words(texts, 51))) < sum(len(t.split()) for t in texts)


def test_words_of_unparted_scripts_and_long_runs(spark):
    rng = random.Random(12)
    letters = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    blob = "".join(rng.choice("0123456789abcdef") for _ in range(900))
    texts = ["甲" + letters + "乙", "丙丁" + letters, f"one {blob} two", f"three {blob} four"]
    got = {r.id: r.text for r in suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), in_place=True, words=51).collect()}
    assert got == {0: "甲乙", 1: "丙丁", 2: "one two", 3: "three four"}


def test_patterns_of_bytes_are_no_repeats(spark):
    """Thue-Morse words over blocks of 1 to 16 letters before a common end: polynomials modulo a power of two take them for equal."""
    rng = random.Random(9)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    pairs = [(letters(k, "abcdefgh"), letters(k, "abcdefgh")) for k in range(1, 17)]
    pairs.append(("vovtydfg", "kzipzmbh"))  # their sums agree in the low 29 bits
    texts = []
    for x, y in pairs:
        turns = [bin(i).count("1") & 1 for i in range(max(32, -(-256 // len(x))))]
        tail = letters(200, "klmnopqrst")
        texts += ["".join((x, y)[t] for t in turns)[:256] + tail, "".join((y, x)[t] for t in turns)[:256] + tail]
    got = {r.id: r for r in suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    assert [(len(texts[i]), len(texts[i]) - len(got[i].kept), len(got[i].spans), hashlib.sha256(bytes(got[i].kept)).hexdigest()) for i in range(len(texts))] == brute(texts, 400)
    assert len(got[32].kept) == len(got[33].kept) == 456
