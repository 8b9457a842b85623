import random

import corpus_pipeline as pipeline


def test_stages_and_columns(spark, sf_dir):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "secret scans", "best-fit packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == pipeline.COLUMNS
        assert 0 < docs.count() <= before
        before = docs.count()
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == before


def test_hard_rows_go_through(spark, hard_docs, tables):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    sf_dir = tables(documents=hard_docs, labels=labels)
    out = pipeline.run(spark, sf_dir).collect()
    ids = {r.doc_id for r in out}
    assert 1 in ids and 2 not in ids and 3 not in ids and 18 in ids


def test_no_rows(spark, no_docs, tables):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pipeline.run(spark, tables(documents=no_docs, labels=labels)).count() == 0


def test_rows_without_an_id_join_their_groups(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base), (None, base + " more"), (None, "alone " + base[::-1]), (None, "alone " + base[::-1]), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in pipeline.keep_one_of_each_group(spark, docs, "").collect()), key=str)
    assert kept == sorted([(5, base), (None, "alone " + base[::-1]), (9, None)], key=str)


def test_short_planted_passages_of_over_fifty_words_are_cut(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    passage, shorter = " ".join(word() for _ in range(51)), " ".join(word() for _ in range(50))
    assert len(passage) < 400
    own = [" ".join(word() for _ in range(40)) for _ in range(8)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{own[2]} {passage} {own[3]}", f"{own[4]} {shorter} {own[5]}", f"{own[6]} {shorter} {own[7]}"]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in pipeline.cut_repeats(spark, docs, "").collect()}
    assert got == {0: f"{own[0]} {own[1]}", 1: f"{own[2]} {own[3]}", 2: texts[2], 3: texts[3]}
