"""Identifiers, sketches and nested properties on small tables."""

import json
import os
import random

from pyspark.sql import functions as F

from sheetlark.functions import identifiers as ids
from sheetlark.operators import findings, nested, sketches
from sheetlark.sources import shared, workbook


def told(spark, texts, kind):
    fields = [f"CAST(NULL AS {f.split()[1]}) AS {f.split()[0]}" for f in workbook.FACTS.split(", ") if f.split()[0] not in ("kind", "value", "type", "ref")]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "ref string, value string").selectExpr("*", "'cell' AS kind", "'s' AS type", *fields)
    found = findings.identifiers(df).where(F.col("kind") == kind).collect()
    return {i: sorted(r.raw for r in found if r.ref == str(i)) for i in range(len(texts)) if any(r.ref == str(i) for r in found)}


def test_ibans(spark):
    """Published examples of the standard, with and without spaces."""
    good = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "PT50000201231234567890154", "BR1800360305000010009795493C1", "FR1420041010050500013M02606", "NO9386011117947"]
    bad = ["DE88370400440532013000", "DE8937040044053201300", "XDE89370400440532013000", "DE893704004405320130001", None, "", "AB12", "br1800360305000010009795493c1"]
    got = told(spark, good + bad + [f"{good[0]}, {good[1]};{good[0]}"], "iban")
    assert got == {**{i: [g] for i, g in enumerate(good)}, len(good + bad): sorted([good[0], good[1], good[0]])}


def test_modulo_97_of_long_numbers(spark):
    g = random.Random(1)
    numbers = ["", "0", "97", "96"] + ["".join(g.choice("0123456789") for _ in range(n)) for n in range(1, 61)]
    df = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", F.expr(ids.modulo_97("n")).alias("m"))
    assert {r.n: r.m for r in df.collect()} == {n: int(n or 0) % 97 for n in numbers}


def test_lettered_cnpj_and_pix(spark):
    assert told(spark, ["12.ABC.345/01DE-35", "12ABC34501DE35", "12.ABC.345/01DE-36", "11.222.333/0001-81", "11222333000181", "12.abc.345/01de-35"], "cnpj") == {0: ["12.ABC.345/01DE-35"], 3: ["11.222.333/0001-81"], 4: ["11222333000181"]}
    texts = ["Chave PIX: ana@x.com.br", "pix +5511987654321", "Pix é 123e4567-e89b-42d3-a456-426614174000.", "ana@x.com.br", "pixel ana@x.com.br", "PIX amanhã", "pix 529.982.247-25"]
    assert set(told(spark, texts, "pix_key")) == {0, 1, 2, 6}


def test_sketches_stay_within_their_bounds(spark):
    rows = spark.range(60_000).selectExpr("id % 5 AS file", "IF(id % 10 = 3, NULL, string(id % 9000)) AS value").unionByName(spark.createDataFrame([(7, None), (8, "no number"), (8, "no number"), (8, "NaN")], "file long, value string"))
    kept = sketches.profile(rows, ["file"])
    one = sketches.estimates(sketches.rollup(kept, []), 0.25, 0.5).first()
    values = sorted(int(r.value) for r in rows.where("value RLIKE '^[0-9]+$'").collect())
    assert one.n == 60_004 and abs(one.n_distinct - len(set(values)) - 2) <= sketches.ERROR_DISTINCT * len(set(values))
    for rank, got in ((0.25, one.q_25), (0.5, one.q_50)):
        assert abs(sum(v < got for v in values) / len(values) - rank) < sketches.ERROR_RANK
    by = {r.file: r for r in sketches.estimates(kept, 0.5).collect()}
    assert (by[7].n, by[7].n_distinct, by[7].q_50) == (1, 0, None) and (by[8].n, by[8].n_distinct, by[8].q_50) == (3, 2, None)
    assert sketches.rollup(sketches.profile(rows.limit(0), ["file"]), ["file"]).count() == 0


def leaves(value, path="$"):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves(v, path + (f".{k}" if k.isidentifier() and k.isascii() else f'["{k}"]'))]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in leaves(v, f"{path}[{i}]")]
    return [path]


def test_leaves_of_any_depth(spark):
    texts = ['{"a":1,"b":{"c":[1,"x",{"d":null}],"e f":true},"z":{},"y":[]}', "3", '"s"', "null", "[]", "[[[[5]]]]", "{bad", None, '{"a":1.5}']
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "id int, props string")
    got = nested.flatten(df.limit(len(texts)), ["id"], "props").collect()
    for i, t in enumerate(texts):
        mine = sorted(r.path for r in got if r.id == i)
        try:
            assert mine == sorted(leaves(json.loads(t))) if t is not None else mine == []
        except json.JSONDecodeError:
            assert mine == ["$"] and [r.type for r in got if r.id == i] == ["TEXT"]
    kinds = {r.path: (r.type, r.value) for r in got if r.id == 0}
    assert kinds["$.a"] == ("BIGINT", "1") and kinds["$.b.c[1]"] == ("STRING", "x") and kinds["$.b.c[2].d"][0] == "VOID" and kinds["$.z"] == ("OBJECT", "{}") and kinds['$.b["e f"]'] == ("BOOLEAN", "true")


def test_nested_differences(spark):
    old = spark.createDataFrame([(1, '{"a":1,"b":2}'), (1, '{"a":1,"b":2}'), (2, '{"a":"1"}'), (3, None), (None, '{"q":1}'), (5, '{"a":[1,2]}')], "id int, props string")
    new = spark.createDataFrame([(1, '{"b":2,"a":3}'), (2, '{"a":1}'), (3, '{"n":null}'), (None, '{"q":1}'), (5, '{"a":[1]}')], "id int, props string")
    got = sorted(map(tuple, nested.differences(old, new, ["id"], "props").collect()), key=str)
    assert got == sorted([(1, "prop_changed", "$.a", "1", "3"), (2, "prop_retyped", "$.a", "STRING 1", "BIGINT 1"), (3, "prop_added", "$.n", None, None), (5, "prop_lost", "$.a[1]", "2", None)], key=str)
    assert nested.differences(old, old, ["id"], "props").count() == 0 and nested.differences(old.limit(0), old.limit(0), ["id"], "props").count() == 0


def test_written_tables_can_be_released(spark):
    shared.release(spark)
    kept = shared.written(spark.range(3), "t")
    assert kept.count() == 3
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    shared.release(spark)
    assert not os.path.exists(path)


def test_ibans_and_cards_against_plain_arithmetic(spark):
    g = random.Random(2)
    texts = ["".join(g.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(g.choice((15, 22, 29, 34)))) for _ in range(3000)]
    texts += [f"{c}{d:02d}{'Z' * 14}{'9' * 16}"[: ids.IBAN_LENGTHS.get(c, 34)] for c in ("BR", "XX", "NO") for d in range(98)]
    want = {t for t in texts if len(t) == ids.IBAN_LENGTHS.get(t[:2], len(t)) and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t for r in df.where(ids.iban("t")).collect()} == want and len(want) > 20
    numbers = [f"{g.randrange(10**16):016d}" for _ in range(2000)] + ["0" * 16, "4" * 16, "8" * 16, "", "123", "4111111111111111"]
    odd = lambda n: sum(int(c) if i % 2 else int(c) * 2 // 10 + int(c) * 2 % 10 for i, c in enumerate(n))
    want = {n for n in numbers if len(n) == 16 and len(set(n)) > 1 and odd(n) % 10 == 0}
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert {r.n for r in df.where(ids.luhn("n")).collect()} == {r.n for r in df.where(ids.luhn("concat(n, '')")).collect()} == want


def test_one_kind_of_identifier_is_looked_for_alone(spark):
    cells = spark.createDataFrame([("1", "4111111111111111; DE89370400440532013000")], "ref string, value string").selectExpr("*", "'cell' AS kind", "'s' AS type", "'f' AS path", "'t' AS sheet")
    assert [r.kind for r in findings.identifiers(cells, "iban").collect()] == ["iban"]
    assert sorted(r.kind for r in findings.identifiers(cells).collect()) == ["card", "iban"]
