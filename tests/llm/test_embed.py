import numpy as np

from sheetlark.llm import embed
from sheetlark.llm.queries import op1_embed

SF = "/root/testdata/sf0.001"


def brute(rows):
    ok = [(i, np.array(v, float), k) for i, v, k in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, v, k) in enumerate(ok):
        for j, w, m in ok[x + 1 :]:
            if k == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                n[i] += 1
                n[j] += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (n[i], root(i), root(i) == i) for i in n}


def compare(got, rows):
    assert {r[0]: tuple(r)[1:] for r in got} == brute(rows)


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    compare(op1_embed(spark, SF).collect(), rows)


def test_planted(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 1000
    for k in range(3):
        for _ in range(8):
            base = rng.standard_normal(24)
            for _ in range(int(rng.integers(1, 30))):
                rows.append((i, [float(x) for x in base + rng.standard_normal(24) * rng.uniform(0.0, 0.2)], k))
                i -= 1
    rows += [(1, None, 0), (2, [], 0), (3, [0.0] * 24, 0), (4, [float("nan")] * 24, 0), (5, [None] + [1.0] * 23, 0), (6, rows[0][1], None), (7, [float("inf")] * 24, 1), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0), (10, [1e200] * 24, 2), (11, [1e-200] * 24, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embed.near_duplicates(df, block=16).collect()
    want = brute([r for r in rows if r[0] not in (10, 11)]) | {10: (1, 10, True), 11: (1, 10, False)}
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x"), (None, [1.0, 0.0], 1, "x")], "vec_id long, embedding array<double>, label int, component_id string")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in embed.near_duplicates(df).collect())
    assert got == [(-1, 0, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert embed.near_duplicates(df.limit(0)).collect() == []


def test_calibration():
    assert embed.needed_collisions(24, 2.0, 1e-8) >= 12


def test_counting_is_exact():
    rng = np.random.default_rng(1)
    for n, k, m, needed in ((5, 3, 24, 14), (70, 130, 24, 15), (64, 64, 7, 1), (1, 200, 31, 16)):
        a, b = rng.standard_normal((n, m)), rng.standard_normal((k, m))
        want = (np.abs(a[:, None] - b[None]) <= 0.9).sum(2) >= needed
        assert (embed.collisions(a, b, 0.9, needed) == want).all()


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, on several axes and many blocks, and equal vectors among them."""
    rng = np.random.default_rng(7)
    rows, i = [], 0
    for k in range(2):
        for _ in range(250):
            a = rng.standard_normal(32)
            a /= np.linalg.norm(a)
            side = rng.standard_normal(32)
            side -= (side @ a) * a
            b = 0.9803 * a + np.sqrt(1 - 0.9803**2) * side / np.linalg.norm(side)
            rows += [(i, a.tolist(), k), (i + 1, b.tolist(), k)]
            i += 2
    rows += [(i + j, rows[0][1], 0) for j in range(40)] + [(i + 40 + j, rows[1][1], 0) for j in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    rows = [tuple(r) for r in df.collect()]
    assert embed.axes_for(600, 16) > 2
    got = embed.near_duplicates(df, block=16)
    compare(got.collect(), rows)
    assert got.where("n_links > 0").count() == 1043


def shipped(spark, n, dim=64, block=embed.BLOCK):
    """How often a vector of one label is sent, and the share of all pairs that is compared: from block numbers alone."""
    from pyspark.sql import functions as F

    width = np.sqrt(2 - 2 * embed.THRESHOLD)
    rows = spark.range(n, numPartitions=8).select("id", F.lit("a").alias("label"), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sqrt(-2 * F.log(F.pmod(F.xxhash64("id", i), F.lit(1 << 30)) / (1 << 30) + 1e-12)) * F.cos(F.pmod(F.xxhash64("id", i, F.lit(1)), F.lit(1 << 30)) / (1 << 30) * 2 * np.pi)).cast("array<float>").alias("v"))
    axes = embed.axes_for(n, block)
    blocks = embed._blocks(rows, width, block, axes, embed.bundle_for(n, block))
    sizes = blocks.where("no is not null").select("no", "bundle", (F.length("ids") / 8).cast("long").alias("size"))
    pairs = embed._pairs(blocks, width, axes)
    copies = embed._sent(pairs).join(sizes.groupBy(F.col("bundle").alias("of")).agg(F.sum("size").alias("size")), "of").agg(F.sum("size")).first()[0] / n
    own, other = (sizes.select(F.col("no").alias(c), F.col("size").alias(f"size_{c}")) for c in ("no", "no_b"))
    compared = pairs.join(own, "no").join(other, "no_b").agg(F.sum(F.col("size_no") * F.col("size_no_b") * F.when(F.col("no") == F.col("no_b"), 0.5).otherwise(1.0))).first()[0]
    return copies, compared / (n * n / 2)


def test_vectors_are_sent_a_bounded_number_of_times(spark):
    """A label without any structure, the worst case: each vector goes to fewer than ten tasks."""
    copies, share = shipped(spark, 20_000)
    assert copies < 10 and share < 0.75
