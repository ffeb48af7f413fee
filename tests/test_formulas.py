import re

import pytest

from sheetlark.functions import formulas

#: formula, row, column, its relative form
CASES = [
    ("A1*2", 1, 2, "R[0]C[-1]*2"), ("A2*2", 2, 2, "R[0]C[-1]*2"), ("$A$1+A$1+$A1", 3, 2, "R1C1+R1C[-1]+R[-2]C1"), ("SUM(B2:B10)", 11, 2, "SUM(R[-9]C[0]:R[-1]C[0])"), ("'Plano B2'!C3&\"A1 \"\"B2\"\"\"", 3, 3, "'Plano B2'!R[0]C[0]&\"A1 \"\"B2\"\"\""),
    ("LOG10(A1)+YTD2024", 1, 1, "LOG10(R[0]C[0])+YTD2024"), ("Tab1!XFD1048576", 1, 1, "Tab1!R[1048575]C[16383]"), ("XFE1+A1048577", 1, 1, "XFE1+A1048577"), ("SUM(A:C)+SUM($A:$A)+SUM(1:3)", 2, 2, "SUM(C[-1]:[1])+SUM(C$A:$A)+SUM(R[-1]:[1])"),
    ("[1]Plan!A1", 1, 1, "[1]Plan!R[0]C[0]"), ("Tabela[A1]", 1, 1, "Tabela[A1]"), ("a1", 1, 1, "R[0]C[0]"), ("A1.5", 1, 1, "A1.5"), ("1E5+2", 9, 9, "1E5+2"), ("x_A1+A1_x", 1, 1, "x_A1+A1_x"), ("'d''A1'!B2", 2, 2, "'d''A1'!R[0]C[0]"), ("", 1, 1, ""), (None, 1, 1, None), ("A1", None, 1, "A1"),
    ("A1\nB1", 1, 1, "R[0]C[0]\nR[0]C[1]"), ("ÁREA1(A1)", 1, 1, "ÁREA1(R[0]C[0])"), ("A1:INDEX(B:B,2)", 1, 1, "R[0]C[0]:INDEX(C[1]:[1],2)"),
]


def test_relative_forms(spark):
    df = spark.createDataFrame([(i, f, r, c, w) for i, (f, r, c, w) in enumerate(CASES)], "i int, formula string, row int, col int, want string")
    assert [tuple(r) for r in df.select("formula", formulas.relative().alias("got"), "want").where("NOT (got <=> want)").collect()] == []


@pytest.mark.parametrize("rows,columns", [(1, 0), (5, 2), (-1, 1)])
def test_shifted_formulas_have_the_same_relative_form(spark, rows, columns):
    some = [(f, r, c) for f, r, c, _ in CASES if f and r and "#" not in f]
    told = [(f, r, c, formulas.shift(f, rows, columns)) for f, r, c in some if r + rows > 0]
    told = [t for t in told if "#REF!" not in t[3] and not re.search(r"[:(]-?0", t[3])]
    assert len(told) >= 5
    df = spark.createDataFrame([(f, r, c, s, r + rows, c + columns) for f, r, c, s in told], "formula string, row int, col int, f2 string, r2 int, c2 int")
    got = df.select("formula", "f2", formulas.relative().alias("a"), formulas.relative("f2", "r2", "c2").alias("b")).where("a <> b").collect()
    assert got == []


def test_shift():
    assert formulas.shift("A1*2+$A$1", 1, 1) == "B2*2+$A$1"
    assert formulas.shift("A1", -1, 0) == "#REF!" and formulas.shift("'A1'!A1&\"A1\"", 1, 0) == "'A1'!A2&\"A1\""
    assert formulas.shift("SUM(A:B)+SUM(2:$3)", 1, 1) == "SUM(B:C)+SUM(3:$3)"
