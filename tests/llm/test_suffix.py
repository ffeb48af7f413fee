import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetlark.llm import suffix

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        mark = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        rest = bytes(b for b, m in zip(r, mark) if not m)
        out.append((len(r), sum(mark), spans, hashlib.sha256(rest).hexdigest()))
    return out


def compare(spark, texts, length, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.repeat_digests(df, length=length, **options).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_documents(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    compare(spark, texts, 200)


def planted():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(3)]
    texts = [text(50) + passages[i % 3][rng.randrange(0, 40) :] + text(rng.randrange(0, 50)) for i in range(60)]
    texts += [texts[0], texts[0], texts[1][5:], None, "", "short", "z" * 3000, "ab" * 1500, passages[0] + passages[0]]
    return texts


def test_planted(spark):
    compare(spark, planted(), 200)


def test_large_buckets_are_dealt_again(spark):
    compare(spark, planted(), 60, gram=20, most=3)


def test_hot_passages_to_the_last_level(spark, monkeypatch):
    # a passage just short of a repeat fills buckets until the last window tells its places apart
    monkeypatch.setattr(suffix, "HOT", 3)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    hot, other = text(199), text(150)
    texts = [text(rng.randrange(0, 90)) + rng.choice("xyz") + hot + rng.choice("uvw") + text(rng.randrange(0, 90)) for _ in range(40)]
    texts += [text(30) + other + text(60) for _ in range(12)] + [hot, "x" + hot, hot + "u", "x" + hot, None, ""]
    compare(spark, texts, 200, most=2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=9), st.binary(max_size=9)), min_size=1, max_size=6), st.integers(1, 9))
def test_cores_keep_equal_windows_together(sides, width):
    # segments around one anchor "gg": all windows of 8 bytes that hold it at distances from 0 to 6
    length, gram, found = 8, 2, {}
    cut = [(left[-6:], right[:6]) for left, right in sides]
    cut = [(a, b) for a, b in cut if len(a) + gram + len(b) >= length]
    segments = [a + b"gg" + b for a, b in cut]
    off = np.concatenate([[0], np.cumsum([len(x) for x in segments])]).astype(np.int64)
    o = np.array([len(a) for a, _ in cut], np.int64)
    row, key, first, w, begin, _ = suffix.cores(np.frombuffer(b"".join(segments), np.uint8), off, o, length, gram, width)
    assert int(w.sum()) == sum(len(x) - length + 1 for x in segments)
    for r, k, f, n, d in zip(row.tolist(), key.tolist(), first.tolist(), w.tolist(), begin.tolist(), strict=True):
        for i in range(n):
            assert o[r] - f == d
            window = (segments[r][f + i : f + i + length], d - i)
            assert found.setdefault(window, k) == k


def test_edges(spark):
    df = spark.createDataFrame([(None, "x" * 300, "k", 1), (None, "x" * 300, "k", 2), (7, "é" * 150 + "y", "k", 3)], "doc_id long, text string, ranges string, _n long")
    got = sorted(r.n_removed for r in suffix.repeat_digests(df).collect())
    assert got == [300, 300, 300]
    kept = suffix.remove_repeats(df)
    assert kept.columns == [*df.columns, "_spans"]
    assert sorted(r.text for r in kept.collect()) == ["", "", "y"]
    assert suffix.repeat_digests(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(1, 9))
def test_expansion_finds_repeats(segments, length):
    seen = Counter(s[i : i + length] for s in segments for i in range(len(s) - length + 1))
    want = [(k, i) for k, s in enumerate(segments) for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1]
    seg, start = suffix.repeated_windows([np.frombuffer(s, np.uint8) for s in segments], length)
    assert list(zip(seg.tolist(), start.tolist())) == want
