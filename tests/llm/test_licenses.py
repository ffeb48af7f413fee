import duckdb
from pyspark.sql import functions as F

from sheetlark.llm import licenses
from sheetlark.llm.queries import ORACLES, op6_licenses

SF = "/root/testdata/sf0.01"


def rows(spark_rows):
    return sorted((tuple(r) for r in spark_rows), key=str)


def test_matches_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = op6_licenses(spark, SF)
    assert rows(got.collect()) == rows(c.sql(ORACLES["op6_licenses"]).fetchall())
    assert got.count() > 20
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_planted(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    words = mit.split()
    near = " ".join(w if i % 40 else "changed" for i, w in enumerate(words))
    far = " ".join(w if i % 6 else "changed" for i, w in enumerate(words))
    texts = [
        (1, "lorem ipsum " * 500 + mit + " dolor" * 77), (2, "x " + near), (3, far), (4, None), (5, ""), (6, "one two"), (7, "RELEASED under\n\tthe mit License."),
        (7, "nothing to see here at all"), (8, "word " * 50_000 + "Licensed under CC BY-NC 4.0. " + "word " * 1000), (None, "Licensed under CC BY-NC 4.0."), (9, "released under the mit licence."),
    ]
    df = spark.createDataFrame([(*t, "q") for t in texts], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license) for r in licenses.scan(df).collect()}
    assert got == {(1, "MIT"), (2, "MIT"), (7, "MIT"), (8, "CC-BY-NC-4.0"), (None, "CC-BY-NC-4.0")}
    c = duckdb.connect()
    df = df.where("doc_id is null or doc_id <> 8")  # the SQL's list functions are slow on very long texts
    pdf = df.toPandas()  # noqa: F841
    c.sql("create view documents as select * from pdf")
    want = c.sql(licenses.oracle()).fetchall()
    assert sorted((-1 if x[0] is None or x[0] != x[0] else int(x[0]), *x[1:]) for x in want) == sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in licenses.scan(df).collect())
    assert licenses.scan(df.limit(0)).collect() == []
    assert licenses.scan(df.where(F.col("doc_id") == 4)).collect() == []


def test_siblings_are_told_apart(spark):
    """One document per GNU notice names that license alone; two different notices in one text are both told."""
    gnu = licenses.SIBLINGS["GNU"]
    texts = [(i, f"a b c d e f g {licenses.TEMPLATES[name][-1]} " + "tail " * i) for i, name in enumerate(gnu)]
    both = licenses.TEMPLATES["GPL-2.0"][0] + " " + licenses.TEMPLATES["AGPL-3.0"][0]
    # rows that share an id: what stands in one text says nothing about the other
    texts += [(10, both), (11, licenses.TEMPLATES["GPL-3.0"][1]), (11, licenses.TEMPLATES["LGPL-3.0"][0]), (11, licenses.TEMPLATES["LGPL-3.0"][0])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = licenses.scan(df).collect()
    assert {(r.doc_id, r.license) for r in got} == {*enumerate(gnu), (10, "GPL-2.0"), (10, "AGPL-3.0"), (11, "GPL-3.0"), (11, "LGPL-3.0")}
    c = duckdb.connect()
    pdf = df.toPandas()  # noqa: F841
    c.sql("create view documents as select * from pdf")
    assert rows(got) == rows(c.sql(licenses.oracle()).fetchall())


def test_notices_as_source_files_have_them(spark):
    """Comment marks before every line, quotes around, and another last sign."""
    mit = licenses.TEMPLATES["MIT"][1].split()
    lines = [" ".join(mit[i : i + 12]) for i in range(0, len(mit), 12)]
    marked = lambda mark: "code();\n" + "".join(f"{mark} {x}\n" for x in lines) + "more code"
    texts = {
        1: marked("#"), 2: marked(" *"), 3: marked("//"), 4: marked("--"), 5: marked(";;"), 6: "see: Released under the MIT license", 7: "Licensed under the Apache License, Version 2.0", 8: "licensed under CC BY 4.0, see file", 9: "(\u201cReleased under the MIT License\u201d)",
        10: "Released under the MIT-0 License.", 11: "Licensed under CC BY-ND 4.0.", 12: "# # # -- //", 13: "!" * 100_000, 14: "<b>Licensed under CC BY-SA 4.0</b>",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: "MIT", 6: "MIT", 7: "Apache-2.0", 8: "CC-BY-4.0", 9: "MIT"}
    c = duckdb.connect()
    pdf = df.toPandas()  # noqa: F841
    c.sql("create view documents as select * from pdf")
    assert rows(licenses.scan(df).collect()) == rows(c.sql(licenses.oracle()).fetchall())
