import random
import re

import numpy as np

from lorekeep.llm import jaccard, queries
from lorekeep.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(s), least.get(root(i), k)) for i, (k, s) in enumerate(sets)), key=str)


def mutants(seed, n, families):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(families)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows


def test_shingles_are_whole_and_lower_case():
    texts = ["A b\tC\nd e F", "a B c d e f", "one two", "two one", "", None, "Ä b c d e", "ä b c d e", "x " * 3000]
    got, want = shingle_sets(texts), [shingles(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert (got[0] == got[1]).all() and got[2][0] != got[3][0] and got[6][0] != got[7][0]


def test_query_on_hard_rows(spark, hard_docs, tables):
    rows = queries.QUERIES["op4_count_tree_join"](spark, tables(documents=hard_docs)).collect()
    want = brute([(d.doc_id, d.text) for d in hard_docs.collect()])
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == want


def test_components_by_brute_force(spark, monkeypatch):
    for seed, n, families in ((1, 150, 8), (2, 260, 2), (3, 120, 60)):
        docs = mutants(seed, n, families)
        got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)


def test_pieces_of_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE", 20)
    docs = mutants(5, 150, 1)
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)


def test_bounds_never_lose_a_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(40):
        common = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        sets = [np.unique(np.concatenate([common[rng.random(len(common)) < 0.9], rng.integers(0, 2**63, rng.integers(1, 30)).astype(np.uint64)])) for _ in range(45)]
        block = jaccard.Block(np.array([len(s) for s in sets]), [jaccard.count_point(s) for s in sets], np.zeros(45, np.int64))
        for i in range(0, 45, 7):
            found = set(block.search(i).tolist())
            for j in range(45):
                both = len(np.intersect1d(sets[i], sets[j]))
                if i != j and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    assert j in found


def test_any_column_names_and_clashing_set_names(spark, monkeypatch):
    docs = mutants(7, 80, 10)
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in docs], "id long, point string, n int, row string")
    real = jaccard.set_ids
    monkeypatch.setattr(jaccard, "set_ids", lambda m: (real(m)[0] % 7, real(m)[1]))
    got = jaccard.jaccard_components(df, "id", "point").collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)


def test_empty(spark, no_docs):
    assert jaccard.jaccard_components(no_docs, "doc_id", "text").count() == 0


def test_a_block_with_one_sided_candidates_is_opened():
    class OneSided:
        sizes = np.array([5, 5, 5])

        def search(self, i):
            return np.array([[1], [0, 2], [0, 1]][i])

    pairs, more = jaccard.block_pairs(OneSided(), None)
    assert more or {(0, 1), (1, 2)} <= {tuple(sorted(p)) for p in pairs}
    assert (1, 2) in jaccard.block_pairs(OneSided(), np.array([0, 0, 2]))[0]


def thue_morse(n, x, y):
    return "".join((x, y)[bin(i).count("1") & 1] for i in range(n))


def test_patterns_of_words_do_not_link(spark):
    """Words over blocks of 1 to 16 letters, on which polynomials modulo a power of two meet for any odd base."""
    rng = random.Random(8)
    texts = []
    for k in range(1, 17):
        x, y = ("".join(rng.choice("abcdefgh") for _ in range(k)) for _ in range(2))
        texts += [thue_morse(1024, x, y), thue_morse(1024, y, x), thue_morse(2048, x, y), thue_morse(2048, y, x)]
    # the same over words instead of letters
    texts += [" ".join(thue_morse(1024, "a", "b")), " ".join(thue_morse(1024, "c", "d"))]
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert all(r.component_id == r.id for r in jaccard.jaccard_components(df, "id", "text").collect())


def test_hashes_do_not_hang_on_what_is_hashed_with_them():
    from lorekeep.llm.suffix import word_symbols

    alone, together = shingle_sets(["one two three four five six"])[0], shingle_sets(["x" * 5000, "one two three four five six", ""])[1]
    assert (alone == together).all()
    assert (word_symbols(["one two"])[0] == word_symbols(["é one two " + "y" * 60])[0][1:3]).all()
