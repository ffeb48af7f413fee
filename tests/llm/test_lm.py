import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sheetlark.llm import lm
from sheetlark.llm.queries import op9_lm

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def brute(docs, learned, share, least, discount):
    """Recursive backoff, straight from the definition."""
    count, n = Counter(), 0
    for i in learned:
        count.update(words(docs[i]))
    n, v = sum(count.values()), len(count)
    p1 = lambda w: (count[w] + 0.1) / (n + 0.1 * (v + 1))
    contexts = {w for w, c in count.items() if c >= share * n}
    pairs = Counter()
    for i in learned:
        w = words(docs[i])
        pairs.update((a, b) for a, b in zip([None, *w], w) if a in contexts and b in contexts)
    pairs = {k: c for k, c in pairs.items() if c >= least}

    def p(w, u):
        if u not in contexts:
            return p1(w)
        if (u, w) in pairs:
            return (pairs[u, w] - discount) / count[u]
        seen = [b for a, b in pairs if a == u]
        return (1 - sum((pairs[u, b] - discount) / count[u] for b in seen)) / (1 - sum(map(p1, seen))) * p1(w)

    out = {}
    for i, text in docs.items():
        w = words(text)
        out[i] = (len(w), sum(count[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), sum(math.log10(p(x, u)) for u, x in zip([None, *w], w)))
    return out


def compare(got, want):
    assert len(got) == len(want)
    for r in got:
        a, b = (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), want[r.doc_id]
        assert a[:3] == b[:3]
        assert np.allclose(a[3:], b[3:], rtol=1e-9)


def test_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").collect()}
    learned = [i for i in docs if zlib.crc32(str(i).encode()) % 10]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = lm.score(df, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0, context_share=0.01).collect()
    compare(got, brute(docs, learned, 0.01, lm.LEAST, lm.DISCOUNT))


def test_every_word_is_a_context(spark):
    """Rare words next to a frequent one: each bigram seen twice counts, whatever its words' shares."""
    docs = {i: f"rare{i // 2} next{i // 2} " + "often " * 3000 for i in range(40)} | {99: "rare1 next1 rare2 next3"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = lm.score(df, F.col("doc_id") != 99).collect()
    compare(got, brute(docs, list(range(40)), 0, lm.LEAST, lm.DISCOUNT))


def test_documents_with_every_context(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").limit(60).collect()}
    learned = [i for i in docs if zlib.crc32(str(i).encode()) % 10]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = lm.score(df, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0).collect()
    compare(got, brute(docs, learned, 0, lm.LEAST, lm.DISCOUNT))


def test_query_beats_the_base_on_held_out_text(spark):
    got = op9_lm(spark, SF)
    r = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count("*").alias("n")).first()
    assert r.n > 5 and r.s > r.b
    assert got.count() == 200


def test_probabilities_sum_to_one():
    hashes = np.array(sorted([5, 9, 70, lm.END]))
    model = lm.automaton(hashes, np.array([10, 20, 30, 7]), np.array([1, 2, 6, 11]), np.array([3, 4, 9, 5]), 100, 20)
    for state in range(5):
        m = lm.Automaton(**{**model.__dict__, "start": state})
        context = np.array([10, 20, 30, 7])
        mass = sum(10 ** m.traverse(np.array([i]), m.unigram(np.array([c])), np.array([0, 1]))[0] for i, c in enumerate(context))
        rest = (100 - 67 + 0.1 * (20 + 1 - 4)) / (100 + 0.1 * 21)
        unseen = 10 ** m.traverse(np.array([-1]), np.array([math.log10(rest)]), np.array([0, 1]))[0]
        assert abs(mass + unseen - 1) < 1e-12


def test_edges(spark):
    docs = {1: None, 2: "", 3: "A a A b", 4: "a b " * 20000, 5: "zzz"}
    rows = [*[(i, t, "x") for i, t in docs.items()], (5, "zzz", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = lm.score(df, F.col("doc_id") != 5, context_share=0.05).collect()
    assert len(got) == 6
    compare([r for r in got if r.doc_id != 5] + [r for r in got if r.doc_id == 5][:1], brute(docs, [1, 2, 3, 4], 0.05, lm.LEAST, lm.DISCOUNT))
    none = lm.score(df, F.lit(False)).collect()
    assert all(r.score == 0 == r.base_score and r.n_known == 0 for r in none)
    assert lm.score(df.limit(0), F.lit(True)).collect() == []
    assert lm.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), F.col("doc_id") > 0).count() == 1
