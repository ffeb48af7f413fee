"""The entry points: scan, compare, clean, report. Nothing a workbook names is ever opened or run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.masking import mask, reveal
from ..operators import clean as cleaning
from ..operators import compare as comparing
from ..operators import findings as detecting
from ..sources import workbook
from ..sources.shared import written


def scan(spark: SparkSession, path: str | list[str], *, raw: bool = False, places: bool = False) -> DataFrame:
    """Findings of the workbooks below ``path``, masked unless ``raw`` is set.

    With ``places`` a column ``hidden`` says of what is found in a cell whether it stands in a hidden sheet,
    row or column; what the files say is then written first, so that they are opened once.
    """
    facts = workbook.read_workbooks(spark, path)
    if not places:
        return reveal(detecting.findings(facts), raw)
    facts = written(facts, "facts")
    return reveal(detecting.with_places(detecting.findings(facts), facts), raw)


def risk(spark: SparkSession, path: str | list[str]) -> DataFrame:
    facts = workbook.read_workbooks(spark, path)
    return detecting.risk(detecting.findings(facts), workbook.read_files(spark, path).select("path"))


def compare(spark: SparkSession, pairs: DataFrame | list[tuple[str, str]], path: str | list[str] | None = None, *, raw: bool = False) -> DataFrame:
    """Changes between the versions in ``pairs`` (pair_id, old_path, new_path), masked unless ``raw`` is set.

    Give ``path`` where pairs are many; a short list of path pairs is read by itself.
    """
    facts, pairs = _facts_of(spark, pairs, path)
    out = comparing.changes(facts, pairs)
    return out if raw else out.withColumns({"old": mask(out["old"]), "new": mask(out["new"])})


def provenance(spark: SparkSession, pairs: DataFrame | list[tuple[str, str]], path: str | list[str] | None = None) -> DataFrame:
    return comparing.provenance(*_facts_of(spark, pairs, path))


def _as_scanned(path: str) -> str:
    """A path in the form that Spark's binary source tells it."""
    return re.sub("^(file:)?/+", "file:/", path) if path.startswith(("file:", "/")) else path


def _facts_of(spark, pairs, path):
    if isinstance(pairs, list):
        fixed = [tuple(_as_scanned(p) for p in x) for x in pairs]
        path = path or sorted({p for x in fixed for p in x})
        pairs = comparing.pairs(spark, *fixed)
    if path is None:
        raise ValueError("a table of pairs needs the path of its files")
    return workbook.read_workbooks(spark, path), pairs


def clean(spark: SparkSession, path: str | list[str], out_dir: str, *, drop_hidden_sheets: bool = False, drop_macros: bool = False) -> DataFrame:
    """Clean copies below ``out_dir``; the manifest says what was removed and what was not."""
    return cleaning.clean(workbook.read_files(spark, path), out_dir, drop_hidden_sheets=drop_hidden_sheets, drop_macros=drop_macros)


def report(spark: SparkSession, path: str | list[str], out: str) -> str:
    """Write the full HTML report of ``path``: every finding, masked.

    An ``out`` that ends in a slash or names a file system is a folder, which the executors fill with the page's
    parts. Any other is a local file, to which the lines are streamed, a partition at a time.
    """
    from .report import lines, write

    found = scan(spark, path)
    if out.endswith("/") or "://" in out:
        write(found, out)
        return out
    page = lines(found)
    with open(out, "w", encoding="utf-8") as file:
        file.writelines(f"{row.line}\n" for row in page.toLocalIterator())
    return out
