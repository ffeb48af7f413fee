"""Versions of generated workbooks: rows, formulas, sheets, hidden ranges."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sheetlark.operators import align, asof, compare, ranges
from sheetlark.operators import sheets as sheet_matching
from sheetlark.plans import api
from sheetlark.plans.golden import cell, workbook


def book(sheets, tail=""):
    """Bytes of a workbook: sheet name to rows, each a list of values; ``=`` begins a formula."""

    def line(n, values):
        cells = ""
        for i, v in enumerate(values):
            ref = f"{chr(65 + i)}{n}"
            if isinstance(v, str) and v.startswith("="):
                cells += cell(ref, "0", "n", v[1:])
            elif isinstance(v, str):
                cells += cell(ref, v, "inlineStr")
            elif v is not None:
                cells += cell(ref, str(v))
        return f'<row r="{n}">{cells}</row>'

    return workbook([(name, "visible", "", "".join(line(n, r) for n, r in enumerate(rows, 1))) for name, rows in sheets.items()])


def changed(spark, folder, old, new):
    (folder / "old.xlsx").write_bytes(old)
    (folder / "new.xlsx").write_bytes(new)
    rows = api.compare(spark, [(str(folder / "old.xlsx"), str(folder / "new.xlsx"))], raw=True).collect()
    return sorted(((r.category, r.sheet, r.ref, r.old, r.new) for r in rows), key=str)


def items(n):
    return [[f"item {i}", 10 * i, f"=B{i + 1}*2", f"=SUM(B$1:B{i + 1})"] for i in range(n)]


def test_inserted_removed_and_moved_rows(spark, tmp_path):
    old = items(30) + [["Total", "=SUM(B1:B30)"]]
    kept = [r for i, r in enumerate(old) if i not in (7, 20)]
    kept.insert(12, ["novo", 5])
    kept.insert(24, old[20])
    # formulas as a spreadsheet program writes them after the rows have moved
    where = {r[0]: i + 1 for i, r in enumerate(kept)}
    new = []
    for r in kept:
        n = where[r[0]]
        total = ["Total", f"=SUM(B1:B{where['item 29']})"]
        new.append(total if r[0] == "Total" else [r[0], r[1], f"=B{n}*2", f"=SUM(B$1:B{n})"] if r[0] != "novo" else r)
    new[3][1] = 999
    got = changed(spark, tmp_path, book({"Plano": old}), book({"Plano": new}))
    assert [g for g in got if g[0] != "formula_changed"] == sorted([("row_added", "Plano", "13", None, None), ("row_removed", "Plano", "8", None, None), ("row_moved", "Plano", "25", "21", "25"), ("value_changed", "Plano", "B4", "30", "999")], key=str)
    # the moved row's own sum now covers other rows, and only that one says something else
    assert [g[2] for g in got if g[0] == "formula_changed"] in ([], ["D25"])


def test_equal_rows_and_ties(spark, tmp_path):
    """Repeated rows have no anchor of their own: they are matched from both ends of their gap."""
    old = [["a"]] + [["x", 1]] * 5 + [["b"]]
    new = [["a"]] + [["x", 1]] * 7 + [["b"]]
    got = changed(spark, tmp_path, book({"S": old}), book({"S": new}))
    assert [g[0] for g in got] == ["row_added", "row_added"]
    assert changed(spark, tmp_path, book({"S": old}), book({"S": old})) == []
    assert changed(spark, tmp_path, book({"S": []}), book({"S": []})) == []
    assert {g[0] for g in changed(spark, tmp_path, book({"S": []}), book({"S": old}))} == {"cell_added"}


def test_shared_formulas_equal_their_written_out_form(spark, tmp_path):
    """The form in which a program stores formulas that were filled down is no change."""
    rows = "".join(f'<row r="{n}">{cell(f"A{n}", str(n))}{cell(f"B{n}", str(2 * n), "n", f"A{n}*2+$A$1")}</row>' for n in range(1, 6))
    first = '<c r="B1"><f t="shared" ref="B1:B5" si="0">A1*2+$A$1</f><v>2</v></c>'
    shared = f'<row r="1">{cell("A1", "1")}{first}</row>' + "".join(f'<row r="{n}">{cell(f"A{n}", str(n))}<c r="B{n}"><f t="shared" si="0"/><v>{2 * n}</v></c></row>' for n in range(2, 6))
    old, new = workbook([("S", "visible", "", rows)]), workbook([("S", "visible", "", shared)])
    assert changed(spark, tmp_path, old, new) == [] and changed(spark, tmp_path, new, old) == []
    other = shared.replace("A1*2", "A1*3")
    got = changed(spark, tmp_path, old, workbook([("S", "visible", "", other)]))
    assert [g[0] for g in got] == ["formula_changed"] * 5 and got[4][3:] == ("A5*2+$A$1", "A5*3+$A$1")


def test_renamed_sheets(spark, tmp_path):
    old = {"Base": items(8), "Outra": [["q", 1], ["r", 2]], "Resumo": [["t", "=Base!B3"], ["u", "=SUM('Base'!B1:B8)"], ["v", "=Outra!B1"]]}
    new = {"Dados novos": items(8), "Terceira": [["z", 9]], "Resumo": [["t", "='Dados novos'!B3"], ["u", "=SUM('Dados novos'!B1:B8)"], ["v", "=Outra!B1"]]}
    got = changed(spark, tmp_path, book(old), book(new))
    assert ("sheet_renamed", "Dados novos", None, "Base", "Dados novos") in got
    assert {g[:2] for g in got} == {("sheet_renamed", "Dados novos"), ("sheet_removed", "Outra"), ("sheet_added", "Terceira"), ("cell_removed", "Outra"), ("cell_added", "Terceira")}


def test_hidden_ranges_follow_their_rows(spark, tmp_path):
    row = lambda n, text, hide=False: f'<row r="{n}"{" hidden=" + chr(34) + "1" + chr(34) if hide else ""}>{cell(f"A{n}", text, "inlineStr")}</row>'
    old = "".join(row(n, f"t{n}", n in (4, 5, 6)) for n in range(1, 10))
    new = row(1, "t1") + row(2, "novo") + "".join(row(n + 1, f"t{n}", n in (4, 5, 6, 8, 9)) for n in range(2, 10))
    cols = '<cols><col min="2" max="9" hidden="1"/></cols>', '<cols><col min="5" max="16384" hidden="1"/></cols>'
    got = changed(spark, tmp_path, workbook([("S", "visible", cols[0], old)]), workbook([("S", "visible", cols[1], new)]))
    assert got == sorted([("row_added", "S", "2", None, None), ("row_hidden", "S", "9:10", None, None), ("column_shown", "S", "2:4", None, None), ("column_hidden", "S", "10:16384", None, None)], key=str)


def test_findings_in_hidden_places(spark, tmp_path):
    cpf = "529.982.247-25"
    hide = lambda n, on, text: f'<row r="{n}"{" hidden=" + chr(34) + "1" + chr(34) if on else ""}>{text}</row>'
    rows = hide(1, False, cell("A1", cpf, "inlineStr") + cell("C1", cpf, "inlineStr")) + hide(2, True, cell("A2", cpf, "inlineStr") + cell("C2", cpf, "inlineStr"))
    (tmp_path / "a.xlsx").write_bytes(workbook([("V", "visible", '<cols><col min="3" max="3" hidden="1"/></cols>', rows), ("H", "hidden", "", hide(1, False, cell("A1", cpf, "inlineStr")))]))
    got = api.scan(spark, str(tmp_path), raw=True, places=True).where("kind = 'cpf'").collect()
    assert {(r.sheet, r.ref): r.hidden for r in got} == {("V", "A1"): None, ("V", "C1"): "column", ("V", "A2"): "row", ("V", "C2"): "row", ("H", "A1"): "sheet"}


# ---------------------------------------------------------------- the operators by themselves


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=14), st.lists(st.integers(0, 12), max_size=14))
def test_every_row_is_matched_once(old, new):
    mine, theirs = list(enumerate(old, 1)), list(enumerate(new, 1))
    unique = lambda rows: {d: p for p, d in rows if sum(d == e for _, e in rows) == 1}
    a, b = unique(mine), unique(theirs)
    got = align.align(mine, theirs, [(a[d], b[d]) for d in a.keys() & b.keys()])
    assert sorted(x for x, _, _ in got if x is not None) == [p for p, _ in mine]
    assert sorted(x for _, x, _ in got if x is not None) == [p for p, _ in theirs]
    still = sorted((x, y) for x, y, moved in got if x is not None and y is not None and not moved)
    assert [y for _, y in still] == sorted(y for _, y in still)
    if old == new:
        assert all(x == y and not moved for x, y, moved in got)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 5), st.integers(1, 5))
def test_assignment_is_of_greatest_weight(seed, n, m):
    import itertools

    import numpy as np

    w = np.random.default_rng(seed).integers(0, 6, (n, m))
    got = sheet_matching.assignment(w)
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got}) and all(w[i, j] > 0 for i, j in got)
    small, large, t = (n, m, w) if n <= m else (m, n, w.T)
    best = max(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
    assert sum(w[i, j] for i, j in got) == best


def test_asof_against_a_plain_search(spark):
    g = random.Random(4)
    left = [(i, g.choice(["a", "a", "a", "b", None]), g.choice([None, *range(-50, 400)])) for i in range(400)]
    left += left[:5]
    right = [(g.choice(["a", "b", "c", None]), g.choice([None, *range(-50, 400)]), g.randint(0, 9), g.choice(["p", "q"])) for _ in range(120)]
    right += right[:10]
    df = spark.createDataFrame(left, "id int, k string, t int").repartition(3)
    of = spark.createDataFrame(right, "k string, t int, v int, w string").repartition(3)
    for width, tolerance in ((7, None), (1000, None), (40, 40), (40, 3), (25, 0)):
        want = []
        for i, k, t in left:
            found = [(s, v, w) for key, s, v, w in right if k is not None and t is not None and key == k and s is not None and s <= t and (tolerance is None or t - s <= tolerance)]
            want.append((i, k, t, *(max(found)[1:] if found else (None, None))))
        got = [tuple(r) for r in asof.asof(df, of, ["k"], "t", ["v", "w"], width=width, tolerance=tolerance).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert asof.asof(df.limit(0), of, ["k"], "t", ["v"], width=5).count() == 0
    assert asof.asof(df, of.limit(0), ["k"], "t", ["v"], width=5).where("v is null").count() == len(left)


def test_ranges_against_sets_of_places(spark):
    g = random.Random(9)
    one = lambda: (g.choice(["a", "b", None]), (lo := g.choice([None, *range(1, 80)])), None if lo is None else lo + g.randint(-1, 30), g.choice(["old", "new"]))
    held = [one() for _ in range(40)]
    held += held[:6]
    df = spark.createDataFrame(held, "k string, lo int, hi int, side string").repartition(3)
    places = {s: {(k, i) for k, lo, hi, side in held if k and lo is not None and side == s for i in range(lo, hi + 1)} for s in ("old", "new")}
    for width in (5, 16, 1 << 16):
        got = ranges.apart(df, ["k"], width=width).collect()
        assert {(r.k, i) for r in got if r.in_new for i in range(r.lo, r.hi + 1)} == places["new"] - places["old"]
        assert {(r.k, i) for r in got if not r.in_new for i in range(r.lo, r.hi + 1)} == places["old"] - places["new"]
        spans = sorted((r.k, r.in_new, r.lo, r.hi) for r in got)
        assert all(a[:2] != b[:2] or b[2] > a[3] + 1 for a, b in zip(spans, spans[1:]))
        points = [(i, g.choice(["a", "b", None]), g.choice([None, *range(-3, 120)])) for i in range(200)]
        met = ranges.covered(spark.createDataFrame(points + points[:3], "i int, k string, at int"), df.where("side = 'old'"), ["k"], "at", width=width).collect()
        assert sorted((r.i, r.covered) for r in met) == sorted((i, (k, at) in places["old"]) for i, k, at in points + points[:3])
    assert ranges.apart(df.limit(0), ["k"]).count() == 0 and ranges.named.__doc__


def test_repeated_facts_and_null_keys(spark):
    schema = "pair_id string, kind string, sheet string, ref string, row int, col int, name string, value string, formula string"
    old = spark.createDataFrame([("p", "cell", "S", "A1", None, None, None, "1", None), ("p", "cell", "S", "A1", None, None, None, "2", None), ("p", "cell", None, None, None, None, None, "x", None), ("p", "cell", "S", "A2", None, None, None, None, None)], schema)
    new = spark.createDataFrame([("p", "cell", "S", "A1", None, None, None, "2", None), ("p", "cell", None, None, None, None, None, "y", None), ("p", "cell", "S", "A2", None, None, None, None, "B1")], schema)
    got = sorted(tuple(r) for r in compare.cells(old, new).select("category", F.coalesce("ref", F.lit("-")), F.coalesce("old", F.lit("-")), F.coalesce("new", F.lit("-"))).collect())
    assert got == [("formula_changed", "A2", "-", "B1"), ("value_changed", "-", "x", "y")]


def test_facts_of_two_files_stay_on_all_cores(spark):
    """Two paths are two keys: dealt out by path they would be two tasks' work."""
    each = spark.range(0, 8000, 1, 8).selectExpr("IF(id % 2 = 0, 'old', 'new') AS path", "id")
    met = compare.sided(each, compare.pairs(spark, ("old", "new")))
    held = met.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) == 8 and {r["count"] for r in held} == {1000}


def test_what_cannot_be_read_meets_cells_on_all_cores(spark):
    cells = spark.range(0, 8000, 1, 8).selectExpr("'p' AS pair_id", "'cell' AS kind", "concat('s', id % 4) AS sheet", "id")
    lost = spark.createDataFrame([("p", "cell", "s1"), ("p", "link", ""), ("q", "cell", "")], "pair_id string, kind string, sheet string")
    held = compare.readable(cells, lost).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) == 8 and sum(r["count"] for r in held) == 6000
