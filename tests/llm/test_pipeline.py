import corpus_pipeline
from test_minhash import brute as near_brute
from test_suffix import brute as repeat_brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name == "packing":
            assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == {i: len(t.split()) for i, t in rows.items()}
            continue
        assert out.columns == columns
        path = f"{corpus_pipeline.common.scratch_path(spark, 'test', keep=True)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            assert got == {i: t for i, t in rows.items() if t and any(map(str.isalpha, t))}
        elif name == "near_duplicates":
            kept = {i for i, (_, _, k) in near_brute(list(rows.items())).items() if k}
            assert got == {i: rows[i] for i in kept}
        else:
            lengths = {i: n - gone for i, (n, gone, _, _) in zip(rows, repeat_brute(list(rows.values()), 200))}
            assert set(got) == {i for i, n in lengths.items() if n}
            assert all(lengths[i] - 6 <= len(t.encode()) <= lengths[i] for i, t in got.items())
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        rows = got


def test_run_and_edges(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "null id here", "en", "s", 3), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (4, "words and more words here", "en", "s", 9), (5, "words and more words here", "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect())
    assert got == ["4", "None"]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []


def test_clashing_columns(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "_spans", "lang_pred", "score", "component_id", "kept", "n_shingles", "uid", "_c0", "ranges", "id"]
    rows = [(1, "a few words here", "en", "s", 3, *"abcdefghij"), (2, "a few words here", "en", "s", 3, *"klmnopqrst"), (None, "no id but words", None, None, None, *"abcdefghij")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names[5:]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert sorted((str(r.doc_id), r._spans, r.id) for r in docs.collect()) == [("1", "a", "j"), ("None", "a", "j")]
