import re

import duckdb
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetlark.llm import packing
from sheetlark.llm.queries import op8_packing

SF = "/root/testdata/sf0.001"


def check(rows, words, capacities):
    bins = {}
    done = {}
    for r in rows:
        done.setdefault((r.doc_id, r.copy), []).append((r.piece, r.start, r.length))
        if r.bin_id is None:
            assert r.length == 0
            continue
        bins.setdefault((r.bin_id, r.capacity), []).append((r.offset, r.length))
    assert len(bins) == len({b for b, _ in bins})
    for (_, capacity), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert capacity == min(c for c in capacities if c >= at)
    assert len(done) == len(words)
    for (i, _), pieces in done.items():
        at = 0
        for k, (piece, start, n) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, at)
            at += n
        assert at == words[i] if i in words else True
    return bins


def test_documents(spark):
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_packing(spark, SF).collect()
    bins = check(rows, words, packing.CAPACITIES)
    assert sum(words.values()) / sum(c for _, c in bins) > 0.95


def test_edges(spark):
    texts = {1: None, 2: " \t\n", 3: "a " * 50_000, 4: "b", 5: "a b c"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, bin_id string")
    rows = packing.pack(df, capacities=(4, 10, 64), group_items=2).collect()
    check(rows, {1: 0, 2: 0, 3: 50_000, 4: 1, 5: 3}, (4, 10, 64))
    twice = packing.pack(df.where("doc_id = 4").union(df.where("doc_id = 4"))).collect()
    assert sorted(r.copy for r in twice) == [1, 2]
    null = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert packing.pack(null).count() == 2
    assert packing.pack(df.limit(0)).collect() == []
    again = packing.pack(df.repartition(3), capacities=(4, 10, 64), group_items=2).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(0, 20))
def test_best_fit(lengths, overhead):
    placed = packing.best_fit(lengths, (4, 10, 64), overhead)
    used = {}
    for n, (b, capacity, offset) in zip(lengths, placed):
        used.setdefault((b, capacity), []).append((offset, n))
    for (_, capacity), held in used.items():
        assert sum(n for _, n in held) <= capacity
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))]


def test_best_fit_follows_the_rules():
    # 60 opens a 64; 4 fits it exactly; 9 and 3 would cost least in one bin of 64 that later shrinks
    assert packing.best_fit([60, 4, 9, 3], (4, 10, 64), 0) == [(0, 64, 0), (0, 64, 60), (1, 10, 0), (2, 4, 0)]
    assert packing.best_fit([3, 3, 3], (4, 10, 64), 8) == [(0, 10, 0), (0, 10, 3), (0, 10, 6)]


def optimum(lengths, capacities, overhead):
    """Least total cost over all ways to share the lengths out, by trying every one."""
    sizes = sorted(capacities)
    price = lambda used: packing.cost(next(c for c in sizes if c >= used), overhead)
    best = float("inf")

    def deal(i, bins):
        nonlocal best
        if i == len(lengths):
            best = min(best, sum(map(price, bins)))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= sizes[-1]:
                deal(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        deal(i + 1, [*bins, lengths[i]])

    deal(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=7), st.integers(0, 20))
def test_close_to_the_optimum(lengths, overhead):
    placed = packing.best_fit(lengths, (4, 10, 24, 64), overhead)
    assert packing.total_cost(placed, overhead) <= 1.5 * optimum(lengths, (4, 10, 24, 64), overhead) + 1e-9


def lengths_of(sf):
    texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    most = max(packing.CAPACITIES)
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    return sorted((min(most, n - at) for n in words for at in range(0, n, most)), reverse=True)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_sizes_are_planned_jointly(sf):
    """The joint plan opens several sizes, is none of the plans of one size and costs no more than any of them."""
    lengths, sizes = lengths_of(sf), list(packing.CAPACITIES)
    prices = {c: packing.cost(c) for c in sizes}
    count = lambda plan: sorted({(b, c) for b, c, _ in plan})
    joint = packing._joint(lengths, sizes, prices)
    total = packing.total_cost(joint)
    bins = [c for _, c in count(joint)]
    assert sum(bins.count(c) > 2 for c in sizes) >= 4
    for alone in sizes:
        plan = packing._plan(lengths, sizes, prices, alone)
        assert total <= packing.total_cost(plan) and sorted(bins) != sorted(c for _, c in count(plan))
    assert packing.best_fit(lengths) == joint
    assert total < 0.8 * sum(prices[min(c for c in sizes if c >= n)] for n in lengths)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80), st.integers(0, 40))
def test_joint_plans_never_cost_more_than_least_bids(lengths, overhead):
    ranked, sizes = sorted(lengths, reverse=True), [4, 10, 24, 64]
    prices = {c: packing.cost(c, overhead) for c in sizes}
    joint = packing._joint(ranked, sizes, prices)
    assert packing.total_cost(joint, overhead) <= packing.total_cost(packing._plan(ranked, sizes, prices), overhead) + 1e-9
    assert {b for b, _, _ in joint} == set(range(len({b for b, _, _ in joint})))


def test_invariants_in_sql(spark, tmp_path):
    """Pieces cover every text once, bins have neither gaps nor overlaps, and each has the least capacity that holds it."""
    op8_packing(spark, "/root/testdata/sf0.01").write.parquet(f"{tmp_path}/packed")
    c = duckdb.connect()
    c.sql(f"create view p as select * from '{tmp_path}/packed/*.parquet'")
    c.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    sizes = ", ".join(map(str, packing.CAPACITIES))
    one = lambda sql: c.sql(sql).fetchall()[0][0]
    words = r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents"
    assert one(f"SELECT count(*) FROM ({words}) d FULL JOIN (SELECT doc_id, sum(length) AS n FROM p GROUP BY doc_id, copy) q USING (doc_id) WHERE d.n IS DISTINCT FROM q.n") == 0
    assert one("SELECT count(*) FROM (SELECT start, coalesce(sum(length) OVER (PARTITION BY doc_id, copy ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p) WHERE start <> s") == 0
    assert one('SELECT count(*) FROM (SELECT "offset" AS o, coalesce(sum(length) OVER (PARTITION BY bin_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p WHERE bin_id IS NOT NULL) WHERE o <> s') == 0
    assert one(f"SELECT count(*) FROM (SELECT bin_id, min(capacity) AS c, max(capacity) AS d, sum(length) AS u FROM p WHERE bin_id IS NOT NULL GROUP BY bin_id) WHERE c <> d OR c <> list_min(list_filter([{sizes}], lambda x: x >= u))") == 0


def test_many_copies_of_one_row(spark):
    df = spark.range(25_001).selectExpr("CAST(NULL AS LONG) AS doc_id", "'a b' AS text")
    got = packing.pack(df).agg({"copy": "max", "piece": "max", "length": "sum"}).first()
    assert (got["max(copy)"], got["sum(length)"]) == (25_001, 50_002)
