"""The HTML report: findings grouped by severity and kind, values masked.

:func:`lines` is the full report, every finding of it, made and sorted on the executors: its lines in order are the
page, so the parts that Spark writes put together are too. :func:`render` is a summary in one text, with some examples
of each kind. Nulls are empty cells; without findings the report says so; repeated findings are told each.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.findings import CAVEAT, RANKS

TITLES = {"alto": "Gravidade alta", "medio": "Gravidade média", "baixo": "Gravidade baixa"}


def examples(found: DataFrame, most: int = 20) -> DataFrame:
    """Counts by severity and kind with up to ``most`` masked examples of each; the real values never enter."""
    masked = found.select("path", "kind", "severity", "sheet", "ref", "masked", "explanation")
    first = Window.partitionBy("severity", "kind").orderBy("path", "sheet", "ref", "masked")
    shown = masked.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most)
    listed = shown.groupBy("severity", "kind").agg(F.sort_array(F.collect_list(F.struct("r", "path", "sheet", "ref", "masked"))).alias("examples"))
    counts = masked.groupBy("severity", "kind").agg(F.count("*").alias("n"), F.min("explanation").alias("explanation"))
    return counts.join(listed, ["severity", "kind"])


def render(found: DataFrame, most: int = 20) -> str:
    """The report as one page; what reaches the driver is bounded by kinds times ``most``."""
    rows = sorted(examples(found, most).collect(), key=lambda r: (-RANKS.get(r.severity, 0), r.kind))
    parts = ["<!doctype html><html lang='pt-BR'><meta charset='utf-8'><title>Relatório de achados</title>", "<style>body{font:15px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}</style>", "<h1>Relatório de achados</h1>", f"<p>{escape(CAVEAT)}</p>"]
    level = None
    for r in rows:
        if r.severity != level:
            level = r.severity
            parts.append(f"<h2>{escape(TITLES.get(level, level))}</h2>")
        parts.append(f"<h3>{escape(r.kind)} ({r.n})</h3><p>{escape(r.explanation or '')}</p><table><tr><th>Arquivo<th>Aba<th>Célula ou item<th>Valor</tr>")
        parts.extend("<tr>" + "".join(f"<td>{escape(str(v or ''))}" for v in (e.path, e.sheet, e.ref, e.masked)) + "</tr>" for e in r.examples)
        parts.append("</table>" + (f"<p>… e mais {r.n - len(r.examples)}</p>" if r.n > len(r.examples) else ""))
    if not rows:
        parts.append("<p>Nenhum achado.</p>")
    return "\n".join([*parts, "</html>"])


HEAD = "<!doctype html><html lang='pt-BR'><meta charset='utf-8'><title>Relatório de achados</title><style>body{font:15px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}</style><h1>Relatório de achados</h1>"


def _escaped(value: Column) -> Column:
    out = F.coalesce(value.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\r", "&#13;"), ("\n", "&#10;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def lines(found: DataFrame) -> DataFrame:
    """``(severity, kind, part, line)``, sorted: a line (part 1) for each finding below the head of its severity and kind."""
    masked = found.select("severity", "kind", "path", "sheet", "ref", "masked", "explanation")
    rank = F.coalesce(F.get(F.array(*(F.lit(-r) for r in RANKS.values())), F.array_position(F.array(*map(F.lit, RANKS)), F.col("severity")).cast("int") - 1), F.lit(0))
    place = [rank.alias("rank"), "severity", "kind"]
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    own = ("path", "sheet", "ref", "masked")
    cells = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), _escaped(F.col(c))) for c in own), F.lit("</tr>"))
    rows = masked.select(*place, F.lit(1).alias("part"), *own, cells.alias("line"))
    groups = masked.groupBy("severity", "kind").agg(F.count("*").alias("n"), F.min("explanation").alias("explanation"))
    first = Window.partitionBy("severity").orderBy("kind")  # one row for each kind
    title = F.coalesce(F.get(F.array(*map(F.lit, TITLES.values())), F.array_position(F.array(*map(F.lit, TITLES)), F.col("severity")).cast("int") - 1), F.col("severity"))
    section = F.when(F.row_number().over(first) == 1, F.concat(F.lit("<h2>"), _escaped(title), F.lit("</h2>"))).otherwise("")
    head = F.concat(section, F.lit("<h3>"), _escaped(F.col("kind")), F.lit(" ("), F.col("n").cast("string"), F.lit(")</h3><p>"), _escaped(F.col("explanation")), F.lit("</p><table><tr><th>Arquivo<th>Aba<th>Célula ou item<th>Valor</tr>"))
    heads = groups.select(*place, F.lit(0).alias("part"), *none(*own), head.alias("line"))
    tails = groups.select(*place, F.lit(2).alias("part"), *none(*own), F.lit("</table>").alias("line"))
    total = masked.agg(F.count("*").alias("n"))
    end = lambda rank_, line: total.select(F.lit(rank_).alias("rank"), *none("severity", "kind"), F.lit(0).alias("part"), *none(*own), line.alias("line"))
    about = F.concat(F.lit(HEAD), F.lit(f"<p>{escape(CAVEAT)}</p>"), F.when(F.col("n") == 0, "<p>Nenhum achado.</p>").otherwise(""))
    page = rows.unionByName(heads).unionByName(tails).unionByName(end(-99, about)).unionByName(end(99, F.lit("</html>")))
    return page.orderBy("rank", "severity", "kind", "part", *own).select("severity", "kind", "part", "line")


def write(found: DataFrame, out: str) -> None:
    """The full report as text parts below the folder ``out``, written by the executors; in the order of their names they are the page."""
    lines(found).select("line").write.text(out)
