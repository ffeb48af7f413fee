import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetlark.llm import codes
from sheetlark.llm.common import MOST_UNITS

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def brute(rows, dim=64, entries=256, rounds=4, parts=4):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = dim // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    books = [[cut(v)[p] for _, v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        own = [{} for _ in range(parts)]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                own[p].setdefault(near(x, books[p])[1], []).append(x)
        books = [[[sum(c) // len(own[p][j]) for c in zip(*own[p][j], strict=True)] if j in own[p] else m for j, m in enumerate(books[p])] for p in range(parts)]
    found = [(i, lab, [near(x, books[p]) for p, x in enumerate(cut(v))]) for i, v, lab in kept]
    errors = {}
    for _, lab, best in found:
        errors[lab] = errors.get(lab, 0) + sum(d for d, _ in best)
    digest = hashlib.sha256(",".join(str(x) for book in books for m in book for x in m).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), errors[lab], digest) for i, lab, best in found]


def held(rows):
    return sorted(map(tuple, rows), key=str)


def test_brute_force_with_odd_rows(spark):
    g = random.Random(5)
    rows = [(i, [g.gauss(0, 0.1) for _ in range(64)], g.choice([0, 1, None]), "q", "q") for i in range(270)]
    rows += rows[:20] + [(i + 900, [0.125] * 64, 1, "q", "q") for i in range(30)]
    odd = [(9001, None), (9003, [0.1] * 63 + [None]), (9004, [0.1] * 63 + [float("nan")]), (9005, [float("-inf")] * 64)]
    rows += [(i, v, 1, "q", "q") for i, v in odd] + [(None, [0.5] * 64, None, "q", "q")]
    got = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert held(got.collect()) == held(brute(rows))


def test_few_large_and_none(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(2, [0.5] * 64, 1, "", ""), (1, [0.25] * 64, 1, "", ""), (3, [1.0] * 8, 1, "", ""), (4, [1e30] * 64, 2, "", ""), (5, [], None, "", "")]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codes.compress(spark.createDataFrame(few, SCHEMA)).collect()}
    assert got == {1: ("00000000", 0, 0), 2: ("01010101", 0, 0), 3: (None, None, 0), 4: (None, None, None), 5: (None, None, None)}
    assert codes.compress(spark.createDataFrame(few[2:], SCHEMA)).where("code is null").count() == 3


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.integers(1, 256), st.sampled_from([1, 2, 300, 1 << 15, MOST_UNITS]))
def test_screening_loses_nothing(seed, n, entries, most):
    """Ties, entries that differ by one unit next to huge ones, values far beyond float32's whole numbers."""
    g = np.random.default_rng(seed)
    book = g.integers(-most, most + 1, (entries, 16))
    near = book[g.integers(0, entries, n)] + g.integers(-1, 2, (n, 16))
    x = np.clip(np.where(g.random((n, 1)) < 0.7, near, g.integers(-most, most + 1, (n, 16))), -MOST_UNITS, MOST_UNITS)
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    index, distance, _ = codes.nearest(x, book)
    assert (index == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_screening_leaves_few_pairs():
    g = np.random.default_rng(2)
    x, book = g.integers(-1024, 1025, (5000, 16)), g.integers(-1024, 1025, (256, 16))
    assert codes.nearest(x, book)[2] < 1.01 * len(x)
