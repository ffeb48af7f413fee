"""Workbooks as DataFrames.

``read_workbooks`` scans ``.xlsx`` and ``.xlsm`` files with Spark's binary source, one row a
file, and opens each in the task that holds it. What a file says comes out as facts, one long
table that the detectors and comparisons filter:

    path, kind, sheet, ref, row, col, name, type, value, formula

========  ==========================================================================
kind      meaning of the other columns
========  ==========================================================================
sheet     sheet; value: visible, hidden or veryHidden; row: its position
hidden_row, hidden_col   sheet; row to col: first and last hidden index
hidden_rest   sheet; every row that the sheet does not write is hidden (``zeroHeight``)
cell      sheet, ref, row, col; type as stored; value (shared strings resolved); formula
comment   sheet, ref; name: author; value: text
prop      name: creator, lastModifiedBy, company, save_folder, ...; value
link      name: the part that holds it; value: target, which is never opened
macro     name: part, or part and module; value: SHA-256; row: bytes; type: marks. Never run
error     value: why a file or part could not be read; name: what it is, sheet: whose
========  ==========================================================================

Sheets, comments, shared strings and macros are read as a stream, whatever their size, and
sheets are handed on in batches, so a large sheet is never whole in a task; the shared strings'
texts are. An unreadable sheet or part is an error by itself: the others are read. Only the
relationships, properties, people, list of sheets and macro projects, which inflate beyond ``MAX_PART`` in no
sound file, are told as an error then, and so is a file of ``MAX_FILE`` bytes or more, which is not opened.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import shift
from . import vba

FACTS = "path string, kind string, sheet string, ref string, row int, col int, name string, type string, value string, formula string"
FIELDS = [f.split()[0] for f in FACTS.split(", ")]
MAX_PART = 512 << 20
MAX_FILE = (1 << 31) - 1  # of Spark's binary source
FILES = "*.[xX][lL][sS][xXmM]"
BATCH = 20_000
ERRORS = (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, EOFError, ValueError, TypeError, KeyError, RuntimeError, NotImplementedError, OSError)

_PROPS = {"creator", "lastModifiedBy", "created", "modified", "title", "subject", "description", "keywords", "category"}
_APP_PROPS = {"Company": "company", "Manager": "manager", "Application": "application"}


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


def column_index(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def relations(book: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str, str]]:
    """Relationship id -> (kind, target part or address, mode) of a part."""
    folder, name = posixpath.split(part)
    path = posixpath.join(folder, "_rels", f"{name}.rels")
    if path not in book.NameToInfo:
        return {}
    out = {}
    for node in ElementTree.fromstring(_read(book, path)):
        target, mode = node.get("Target", ""), node.get("TargetMode", "Internal")
        if mode != "External":
            target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[node.get("Id", "")] = (node.get("Type", "").rpartition("/")[2], target, mode)
    return out


def _read(book: zipfile.ZipFile, part: str) -> bytes:
    if book.getinfo(part).file_size > MAX_PART:
        raise ValueError(f"{part} inflates beyond {MAX_PART} bytes")
    return book.read(part)


def _text(node) -> str:
    """Text of a string item without its phonetic runs."""
    if local(node.tag) == "rPh":
        return ""
    own = node.text or "" if local(node.tag) == "t" else ""
    return own + "".join(map(_text, node))


def _nodes(book: zipfile.ZipFile, part: str, *tags: str) -> Iterator:
    """Finished elements of a part as a stream; what stands in them is forgotten after those of ``tags``."""
    above = []
    with book.open(part) as stream:
        for event, node in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                above.append(node)
                continue
            above.pop()
            yield node
            if local(node.tag) in tags:
                (above[-1] if above else node).clear()


def _shared_strings(book: zipfile.ZipFile) -> Iterator[str]:
    if "xl/sharedStrings.xml" in book.NameToInfo:
        yield from (_text(node) for node in _nodes(book, "xl/sharedStrings.xml", "si") if local(node.tag) == "si")


def _error(name: str, error: Exception, sheet: str | None = None) -> dict:
    return {"kind": "error", "name": name, "sheet": sheet, "value": f"{type(error).__name__}: {error}"[:500]}


def workbook_facts(content: bytes) -> Iterator[dict]:
    """Facts of one workbook, without its path."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as error:
        yield {"kind": "error", "value": str(error)}
        return
    with book:
        for step in (_properties, _links, _macros, _sheets):
            try:
                yield from step(book)
            except ERRORS as error:
                yield _error(step.__name__.lstrip("_"), error)


def _properties(book: zipfile.ZipFile) -> Iterator[dict]:
    for part in ("docProps/core.xml", "docProps/app.xml"):
        if part in book.NameToInfo:
            for node in ElementTree.fromstring(_read(book, part)):
                name = _APP_PROPS.get(local(node.tag)) if part.endswith("app.xml") else local(node.tag) if local(node.tag) in _PROPS else None
                if name and (node.text or "").strip():
                    yield {"kind": "prop", "name": name, "value": node.text.strip()}
    if "xl/workbook.xml" in book.NameToInfo:
        for node in ElementTree.fromstring(_read(book, "xl/workbook.xml")).iter():
            if local(node.tag) == "absPath" and node.get("url"):
                yield {"kind": "prop", "name": "save_folder", "value": node.get("url")}


def _links(book: zipfile.ZipFile) -> Iterator[dict]:
    for path in sorted(book.NameToInfo):
        if path.endswith(".rels"):
            for node in ElementTree.fromstring(_read(book, path)):
                if node.get("TargetMode") == "External":
                    yield {"kind": "link", "name": path, "type": node.get("Type", "").rpartition("/")[2], "value": node.get("Target", "")}


def _macros(book: zipfile.ZipFile) -> Iterator[dict]:
    """Macro parts and, for a project, its modules; ``type`` holds the marks that ``vba`` knows."""
    for path in sorted(book.NameToInfo):
        if posixpath.basename(path) in ("vbaProject.bin", "vbaData.xml") or path.startswith("xl/macrosheets/"):
            seen, size, digest, window, head = {}, 0, hashlib.sha256(), "", b""
            try:
                with book.open(path) as stream:
                    while block := stream.read(1 << 20):
                        head = head or block[:8]
                        window = window[-64:] + block.replace(b"\0", b"").decode("latin-1")
                        digest.update(block)
                        size += len(block)
                        seen |= dict.fromkeys(vba.words(window))
            except ERRORS as error:
                yield _error(path, error)
                continue
            yield {"kind": "macro", "name": path, "value": digest.hexdigest(), "row": size if size < 2**31 else None, "type": ",".join(seen)}
            if head == vba.SIGNATURE:  # sources are stored compressed, so the words above are few of them
                try:
                    for name, source in vba.modules(_read(book, path)):
                        yield {"kind": "macro", "name": f"{path}/{name}", "value": hashlib.sha256(source.encode()).hexdigest(), "row": len(source), "type": ",".join(vba.marks(source))}
                except (*ERRORS, struct.error, LookupError) as error:
                    yield _error(path, error)


def _sheets(book: zipfile.ZipFile) -> Iterator[dict]:
    sheets = [n for n in ElementTree.fromstring(_read(book, "xl/workbook.xml")).iter() if local(n.tag) == "sheet"]
    for position, node in enumerate(sheets, 1):
        yield {"kind": "sheet", "sheet": node.get("name"), "row": position, "value": node.get("state", "visible")}
    rels = relations(book, "xl/workbook.xml")
    strings, people = [], {}
    try:
        strings.extend(_shared_strings(book))
    except ERRORS as error:
        yield _error("shared_strings", error)
    for path in sorted(book.NameToInfo):
        if path.startswith("xl/persons/"):
            try:
                people |= {n.get("id"): n.get("displayName") for n in ElementTree.fromstring(_read(book, path))}
            except ERRORS as error:
                yield _error("persons", error)
    for node in sheets:
        name = node.get("name")
        _, part, _ = rels.get(attribute(node, "id") or "", ("", "", ""))
        if part not in book.NameToInfo:
            continue
        try:
            yield from ({**f, "sheet": name} for f in _sheet(book, part, strings))
        except ERRORS as error:
            yield _error("sheet", error, name)
        try:
            targets = [t for kind, t, _ in relations(book, part).values() if kind in ("comments", "threadedComment") and t in book.NameToInfo]
        except ERRORS as error:
            yield _error("comments", error, name)
            continue
        for target in targets:
            try:
                yield from ({**f, "sheet": name} for f in _comments(book, target, people))
            except ERRORS as error:
                yield _error("comments", error, name)


def _sheet(book: zipfile.ZipFile, part: str, strings: list[str]) -> Iterator[dict]:
    shared: dict[str | None, tuple[str, int, int]] = {}
    number = 0
    for node in _nodes(book, part, "row"):
        tag = local(node.tag)
        if tag == "col":
            if node.get("hidden") in ("1", "true"):
                yield {"kind": "hidden_col", "row": int(node.get("min")), "col": int(node.get("max"))}
        elif tag == "sheetFormatPr":
            if node.get("zeroHeight") in ("1", "true"):
                yield {"kind": "hidden_rest"}
        elif tag == "row":
            number = int(node.get("r", number + 1))
            if node.get("hidden") in ("1", "true"):
                yield {"kind": "hidden_row", "row": number, "col": number}
            at = 0
            for cell in node:
                if local(cell.tag) != "c":
                    continue
                ref = cell.get("r") or f"{column_name(at + 1)}{number}"
                at = column_index(ref)
                kind, value, formula = cell.get("t", "n"), None, None
                for child in cell:
                    if local(child.tag) == "v":
                        value = child.text
                    elif local(child.tag) == "is":
                        value = _text(child)
                    elif local(child.tag) == "f":
                        formula = child.text
                        if child.get("t") == "shared":  # the first cell holds the text, which the others are filled from
                            if formula:
                                shared[child.get("si")] = formula, number, at
                            elif child.get("si") in shared:
                                text, row, column = shared[child.get("si")]
                                formula = shift(text, number - row, at - column)
                if kind == "s" and value is not None:
                    value = strings[int(value)] if int(value) < len(strings) else None
                if value is not None or formula is not None:
                    yield {"kind": "cell", "ref": ref, "row": number, "col": at, "type": kind, "value": value, "formula": formula}


def _comments(book: zipfile.ZipFile, part: str, people: dict) -> Iterator[dict]:
    authors = []
    for node in _nodes(book, part, "comment", "threadedComment"):
        if local(node.tag) == "author":
            authors.append(node.text or "")
        elif local(node.tag) == "comment":
            who = int(node.get("authorId", -1))
            yield {"kind": "comment", "ref": node.get("ref"), "name": authors[who] if 0 <= who < len(authors) else None, "value": _text(node)}
        elif local(node.tag) == "threadedComment":
            text = "".join(n.text or "" for n in node.iter() if local(n.tag) == "text")
            yield {"kind": "comment", "ref": node.get("ref"), "name": people.get(node.get("personId")), "value": text}


def facts_of_files(files: DataFrame) -> DataFrame:
    """Facts of ``files``, rows with ``path`` and ``content`` as Spark's binary source gives them."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                held = []
                for fact in workbook_facts(bytes(content)):
                    held.append(fact | {"path": path})
                    if len(held) >= BATCH:
                        yield _frame(held)
                        held = []
                if held:
                    yield _frame(held)

    if "length" not in files.columns:
        return files.select("path", "content").mapInPandas(run, FACTS)
    # a filter on lengths reaches the source, which then never opens what it cannot hold
    fits = F.col("length") < MAX_FILE
    told = {"kind": F.lit("error"), "path": F.col("path"), "value": F.concat(F.lit("the file has "), F.col("length").cast("string"), F.lit(f" bytes, {MAX_FILE} or more"))}
    large = files.where(~fits).select(*(told.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in FACTS.split(", "))))
    return files.where(fits).select("path", "content").mapInPandas(run, FACTS).unionByName(large)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame({f: pd.Series([r.get(f) for r in rows], dtype="Int32" if f in ("row", "col") else object) for f in FIELDS})
    return out


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Workbook files below ``path``, one row each; other suffixes are left out."""
    return spark.read.format("binaryFile").option("pathGlobFilter", FILES).option("recursiveFileLookup", "true").load(path)


def read_workbooks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return facts_of_files(read_files(spark, path))


# ---------------------------------------------------------------- the tables as views of the facts


def sheets(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'sheet'").selectExpr("path", "row AS position", "sheet", "value AS state")


def axes(facts: DataFrame) -> DataFrame:
    """Every hidden row and column by itself; rows hidden by default are not listed here."""
    every = facts.where("kind IN ('hidden_row', 'hidden_col')")
    return every.selectExpr("path", "sheet", "substring(kind, 8) AS axis", "explode(sequence(row, col)) AS index")


def cells(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'cell'").select("path", "sheet", "ref", "row", "col", "type", "value", "formula")


def comments(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'comment'").selectExpr("path", "sheet", "ref", "name AS author", "value AS text")


def props(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'prop'").select("path", "name", "value")


def links(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'link'").selectExpr("path", "name AS part", "value AS target")


def macros(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'macro'").selectExpr("path", "name AS part", "row AS n_bytes", "value AS sha256", "split(type, ',') AS indicators")
