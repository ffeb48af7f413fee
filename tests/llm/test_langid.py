import itertools

import numpy as np
from pyspark.sql import functions as F

from sheetlark.llm import langid
from sheetlark.llm.queries import op2_langid

SF = "/root/testdata/sf0.001"


def brute(scores, penalty):
    best, path = -1e18, None
    for p in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        v = sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
        if v > best + 1e-9:
            best, path = v, p
    return best, path


def value(scores, path, penalty):
    return sum(scores[i, x] for i, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    counts = np.array([4, 0, 6, 1, 5])
    scores = rng.normal(size=(counts.sum(), 3))
    labels = langid.viterbi(scores, counts, 0.8)
    at = 0
    for n in counts:
        if n:
            best, _ = brute(scores[at : at + n], 0.8)
            assert abs(value(scores[at : at + n], labels[at : at + n], 0.8) - best) < 1e-9
        at += n


def test_held_out_accuracy(spark):
    got = op2_langid(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = got.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 20 and r.a >= 0.95
    assert got.count() == truth.count()


def test_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 34 --", "x"), (4, "日本語", "x"), (4, "日本語", "x"), (5, "the and of that " * 30000, "x"), (None, "the with", "x"), (6, "、。", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, 6)] == ["und"] * 4 and by[1].score == 0 and not by[3].spans
    assert by[4].lang_pred in model.languages and by[5].lang_pred == "en" and by[5].score > 0.9
    assert langid.predict(df.limit(0), model).collect() == []
    nothing = langid.fit(df.select("text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}


def test_mixed_text_has_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    pick = {r.lang: r.text[:1500] for r in docs.where("length(text) > 1500").orderBy("doc_id").collect()}
    df = spark.createDataFrame([(1, pick["en"] + " " + pick["es"])], "doc_id long, text string")
    r = langid.predict(df, model).first()
    assert {s.lang for s in r.spans} == {"en", "es"} and len(r.spans) <= 6
    assert r.spans[0].start == 0 and all(a.end <= b.start for a, b in zip(r.spans, r.spans[1:]))


def test_many_languages_keep_their_labels():
    import numpy as np

    scores = np.full((6, 300), -5.0, np.float32)
    scores[:3, 290] = scores[3:, 140] = 30.0
    assert langid.viterbi(scores, np.array([3, 3])).tolist() == [290] * 3 + [140] * 3


def test_copies_do_not_crowd_a_language_out(spark):
    """A language of many copies of few texts is learned as well as one of many texts."""
    rows = [(i, f"word{i} another{i} the of and", "xx") for i in range(300)] + [(1000 + i, f"żółw ślimak {i % 3} gęś", "yy") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, docs_per_language=3)
    assert set(model.languages) == {"xx", "yy"}
    got = langid.predict(df.where("doc_id in (5, 1001)"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got}[1001] == "yy"
