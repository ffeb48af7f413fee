import itertools
import random
import re

from sheetlark.llm import minhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {p for ids in where.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def compare(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, **options).collect()}
    assert got == brute(rows)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    compare(spark, rows)


def test_planted_groups_and_large_buckets(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(60)]
    passage = [rng.choice(vocab) for _ in range(55)]
    rows = []
    for i in range(70):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((1000 - i, " ".join(w)))
    for i in range(70):
        rows.append((2000 + i, " ".join([*passage, *(f"u{i}_{j}" for j in range(rng.randrange(5, 60)))])))
    rows += [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "One two"), (6, "two one"), (7, "a b c d e"), (8, "word " * 40000), (9, "word " * 30)]
    compare(spark, rows, block=4)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "q"), (1, "a b c d e f", "q"), (2, "a b c d e f", "q"), (None, "a b c d e f", "q"), (None, None, None)], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(df).collect()))
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(df.limit(0)).collect() == []
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 4


def test_tables_asked_for_follow_the_options():
    assert minhash.least_tables(16, 2, 75) == 2
    assert minhash.least_tables(16, 2, 50) == 1 and minhash.least_tables(4, 4, 75) == 1


def test_other_options_lose_nothing(spark):
    """At a low threshold with wide tables one common table is enough."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(60)]
    texts = [(i, " ".join(w if rng.random() > 0.03 else rng.choice(words) for w in base)) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, percent=50, halves=24, width=1).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets, up = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}
    for _ in range(30):
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 50 * len(sets[i] | sets[j]):
                    up[j] = up[i] = min(up[i], up[j])
    assert got == up
