"""Clean copies: another file without what should not leave, the original untouched.

Gone by default: comments and notes, author, company, external links. On request: hidden
sheets, macros. Values in cells are never edited; identifiers in them are left for human
review. What else is known to remain is listed in each manifest row.

Parts are edited by byte range while they stream, so all bytes but those taken out stay as they
were, and a part is never whole in memory, however far it inflates.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import TOKEN
from ..sources.workbook import ERRORS, relations, workbook_facts

MANIFEST = "path string, out_path string, removed array<string>, not_removed array<string>, error string"
NOT_REMOVED = ("último editor", "pasta onde foi salva", "linhas e colunas ocultas", "CPF, CNPJ, PIS e dados bancários nas células")
_COMMENT_KINDS = {"comments", "threadedComment", "person", "vmlDrawing"}
_LINK_KINDS = {"externalLink", "externalLinkPath", "xlExternalLinkPath"}
_MACRO_KINDS = {"vbaProject", "wordVbaData", "vbaProjectSignature", "xlMacrosheet"}
_MACRO_TYPE = "application/vnd.ms-excel.sheet.macroEnabled.main+xml"
_PLAIN_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"


@dataclass
class Node:
    """An element as it closes: its name without prefix, its attributes, its children that stay, and its place in the bytes."""

    tag: str
    name: str
    attrs: dict[str, str]
    start: int
    inner: int = 0
    close: int = 0
    children: int = 0

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.attrs.items() if k.rpartition(":")[2] == name), None)


#: What a decision about an element says: take it out, take its contents out, or give it other attributes.
DROP, EMPTY = "drop", "empty"


def edits(blocks: Iterable[bytes], decide) -> list[tuple[int, int, bytes]]:
    """Byte ranges of an XML part and what stands there instead; ``decide(node)`` is DROP, EMPTY, new attributes or None.

    All other bytes stay as they are, so declarations that no element uses are kept. A document
    type is refused.
    """
    parser = expat.ParserCreate()
    stack: list[Node] = []
    out: list[tuple[int, int, bytes]] = []
    due: list = []  # waits for the place where the next event begins

    def event(*_) -> int:
        at = parser.CurrentByteIndex
        for f in due:
            f(at)
        due.clear()
        return at

    def start(tag, attrs):
        node = Node(tag, tag.rpartition(":")[2], attrs, event())
        stack.append(node)
        due.append(lambda at: setattr(node, "inner", at))

    def end(_):
        at = event()
        node = stack.pop()
        node.close = at
        told = decide(node)
        if told == DROP:
            due.append(lambda at: out.append((node.start, at, b"")))
            return
        if stack:
            stack[-1].children += 1
        if told == EMPTY:
            out.append((node.inner, node.close, b""))
        elif told:
            attrs = "".join(f" {k}={quoteattr(v)}" for k, v in (node.attrs | told).items())
            empty = node.inner == node.close
            due.append(lambda at: out.append((node.start, node.inner, f"<{node.tag}{attrs}{'/' if empty and at == node.close else ''}>".encode())))

    def refuse(*_):
        raise ValueError("a document type is not read")

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = parser.DefaultHandler = event
    parser.StartDoctypeDeclHandler = refuse
    size = 0
    for block in blocks:
        parser.Parse(block, False)
        size += len(block)
    parser.Parse(b"", True)
    for f in due:
        f(size)
    kept, at = [], 0
    for x in sorted(out, key=lambda x: (x[0], -x[1])):
        if x[0] >= at:  # what lies in a dropped element is gone with it
            kept.append(x)
            at = x[1]
    return kept


def edited(blocks: Iterable[bytes], changes: list[tuple[int, int, bytes]]) -> Iterator[bytes]:
    """The blocks with the changes made."""
    left, at = list(changes), 0
    for block in blocks:
        stop, p = at + len(block), at
        while left and left[0][0] < stop:
            a, b, new = left[0]
            yield block[p - at : max(p, a) - at]
            if new:
                yield new
                left[0] = (a, b, b"")
            p = min(max(p, b), stop)
            if b > stop:
                break
            left.pop(0)
        yield block[p - at :] if p < stop else b""
        at = stop


def _blocks(book: zipfile.ZipFile, part: str) -> Iterator[bytes]:
    with book.open(part) as stream:
        while block := stream.read(1 << 20):
            yield block


class _Parts:
    """The parts of a workbook with edits laid one upon another; none is whole in memory."""

    def __init__(self, book: zipfile.ZipFile):
        self.book, self.changes = book, {}

    def blocks(self, part: str) -> Iterator[bytes]:
        blocks = _blocks(self.book, part)
        for changes in self.changes.get(part, ()):
            blocks = edited(blocks, changes)
        return blocks

    def edit(self, part: str, decide) -> int:
        changes = edits(self.blocks(part), decide)
        if changes:
            self.changes.setdefault(part, []).append(changes)
        return len(changes)


def _holds(book: zipfile.ZipFile, part: str, what: bytes) -> bool:
    tail = b""
    for block in _blocks(book, part):
        if what in tail + block:
            return True
        tail = block[-len(what) :]
    return False


def clean_workbook(content: bytes, *, drop_hidden_sheets: bool = False, drop_macros: bool = False) -> tuple[bytes, list[str]]:
    """A clean copy of one workbook's bytes, and what was taken out."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.NameToInfo)
    parts = _Parts(book)
    removed: list[str] = []
    gone: set[str] = set()
    rels = {p: relations(book, p) for p in names if not p.endswith(".rels")}
    main = "xl/workbook.xml"
    sheets: list[Node] = []
    if main in names:
        edits(parts.blocks(main), lambda n: sheets.append(n) if n.name == "sheet" else None)
    shown = [n for n in sheets if (n.get("state") or "visible") == "visible"]
    hidden = {i: n for i, n in enumerate(sheets) if drop_hidden_sheets and shown and n not in shown}
    for node in hidden.values():
        gone.add(rels[main][node.get("id")][1])
        removed.append(f"hidden_sheet:{node.get('name')}")
    if hidden and "xl/calcChain.xml" in names:
        gone.add("xl/calcChain.xml")  # names cells of the sheets that go; programs make it anew
    kinds = _COMMENT_KINDS | _LINK_KINDS | (_MACRO_KINDS if drop_macros else set())
    for targets in rels.values():
        for kind, target, mode in targets.values():
            # a drawing in old markup holds buttons and pictures as well as notes: it goes only where it holds notes
            if mode != "External" and kind in kinds and (kind != "vmlDrawing" or target not in names or _holds(book, target, b'ObjectType="Note"')):
                gone.add(target)
                removed.append(f"{kind}:{target}")
    if drop_macros:
        for p in sorted(names):
            if p.startswith("xl/macrosheets/") or posixpath.basename(p) in ("vbaProject.bin", "vbaData.xml", "vbaProjectSignature.bin"):
                gone.add(p)
                removed.append(f"macro:{p}")
    while True:  # what only a dropped part refers to goes with it
        kept = {t for p, ts in rels.items() if p not in gone for k, t, m in ts.values() if m != "External"} | {t for _, t, m in relations(book, "").values()}
        more = {t for p in gone for k, t, m in rels.get(p, {}).values() if m != "External" and t in names and t not in kept} - gone
        if not more:
            break
        gone |= more
    lost: dict[str, set[str]] = {}
    for part, targets in rels.items():
        dead = {i for i, (kind, target, mode) in targets.items() if mode == "External" or target in gone or (kind in kinds and target not in names)}
        if dead and part not in gone:
            lost[part] = dead
            folder, name = posixpath.split(part)
            removed.extend(f"external_link:{targets[i][0]}" for i in dead if targets[i][2] == "External")
            parts.edit(posixpath.join(folder, "_rels", f"{name}.rels"), lambda n, dead=dead: DROP if n.name == "Relationship" and n.get("Id") in dead else None)
    for part, dead in lost.items():
        if part in names and part.endswith(".xml"):
            points = ("externalReference", "sheet") if part == main else ("legacyDrawing", "hyperlink", "oleLink")
            around = ("externalReferences", "hyperlinks")
            parts.edit(part, lambda n, dead=dead, points=points: DROP if (n.name in points and n.get("id") in dead) or (n.name in around and not n.children) else None)
    if hidden:
        place = {str(old): str(new) for new, old in enumerate(i for i in range(len(sheets)) if i not in hidden)}

        def renumber(n: Node):
            if n.name == "definedName" and n.get("localSheetId") is not None:
                return {"localSheetId": place[n.get("localSheetId")]} if n.get("localSheetId") in place else DROP
            if n.name == "definedNames" and not n.children:
                return DROP
            return {k: place.get(n.attrs[k], "0") for k in ("activeTab", "firstSheet") if k in n.attrs}

        parts.edit(main, renumber)
        if "docProps/app.xml" in names:  # lists the names of all sheets
            parts.edit("docProps/app.xml", lambda n: DROP if n.name in ("TitlesOfParts", "HeadingPairs") else None)
    for part, tag in (("docProps/core.xml", "creator"), ("docProps/app.xml", "Company")):
        if part in names and parts.edit(part, lambda n, tag=tag: EMPTY if n.name == tag and n.close > n.inner else None):
            removed.append(f"metadata:{tag}")

    def retype(n: Node):
        if (n.get("PartName") or "").lstrip("/") in gone:
            return DROP
        return {"ContentType": _PLAIN_TYPE} if drop_macros and n.get("ContentType") == _MACRO_TYPE else None

    parts.edit("[Content_Types].xml", retype)
    gone |= {posixpath.join(posixpath.dirname(p), "_rels", f"{posixpath.basename(p)}.rels") for p in gone}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as copy:
        for info in book.infolist():
            if info.filename not in gone:
                new = zipfile.ZipInfo(info.filename, (1980, 1, 1, 0, 0, 0))
                new.compress_type = zipfile.ZIP_DEFLATED
                with copy.open(new, "w", force_zip64=info.file_size > 1 << 30) as stream:
                    for block in parts.blocks(info.filename):
                        stream.write(block)
    return out.getvalue(), sorted(set(removed))


def cited(formula: str | None, gone: set[str]) -> bool:
    """Whether a formula that stays names another workbook, or a sheet that went."""
    if not formula:
        return False
    parts = TOKEN.findall(formula)
    names = {t[:-1].strip("'").replace("''", "'") for t in parts if t.endswith("!")}
    return bool(names & gone) or any(re.match(r"'?\[[0-9]+\]", t) for t in parts)


def _uri(path: str) -> str:
    """A path as a URI, with one form for local files."""
    return "file://" + urlsplit(path).path if path.startswith(("file:", "/")) else path


def clean(files: DataFrame, out_dir: str, *, drop_hidden_sheets: bool = False, drop_macros: bool = False) -> DataFrame:
    """Write a clean copy of each of ``files`` below ``out_dir``; returns the manifest when the copies are written.

    Each copy is written under a temporary name and renamed, so a task that runs twice leaves
    one whole file. A copy is named after its original and a hash of the original's path, and an
    ``out_dir`` that is a folder of the originals is refused.
    """
    out = _uri(out_dir.rstrip("/"))
    folders = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("d")).distinct()
    if not folders.where(F.regexp_replace("d", "^file:/*", "/") == F.lit(re.sub("^file:/*", "/", out))).isEmpty():
        raise ValueError("a clean copy goes to another folder than its original")

    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(out)
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                stem, suffix = posixpath.splitext(posixpath.basename(path))
                tag = uuid.uuid5(uuid.NAMESPACE_URL, path).hex[:8]
                macro_free = drop_macros and suffix.lower() == ".xlsm"
                name = f"{stem}-{tag}{'.xlsx' if macro_free else suffix}"
                try:
                    data, removed = clean_workbook(bytes(content), drop_hidden_sheets=drop_hidden_sheets, drop_macros=drop_macros)
                except (*ERRORS, expat.ExpatError) as error:
                    rows.append((path, None, [], list(NOT_REMOVED), f"{type(error).__name__}: {error}"[:500]))
                    continue
                temp, final = (posixpath.join(folder, x) for x in (f"_temporary-{uuid.uuid4().hex}", name))
                fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(temp, compression=None) as stream:
                    stream.write(data)
                if fs.get_file_info(final).type == pafs.FileType.File:
                    fs.delete_file(final)
                fs.move(temp, final)
                kinds, cites = set(), False
                gone = {f["sheet"] for f in workbook_facts(bytes(content)) if f["kind"] == "sheet"} if drop_hidden_sheets else set()
                for f in workbook_facts(data):
                    if f["kind"] == "sheet":
                        gone.discard(f["sheet"])
                    if f["kind"] != "sheet" or f["value"] != "visible":
                        kinds.add(f["kind"])
                    cites = cites or cited(f.get("formula"), gone)
                also = ["fórmulas que citam o que saiu"] * cites + [n for k, n in (("macro", "macros"), ("sheet", "abas ocultas")) if k in kinds and not (drop_macros if k == "macro" else drop_hidden_sheets)]
                rows.append((path, f"{out}/{name}", removed, [*NOT_REMOVED, *also], None))
            yield pd.DataFrame(rows, columns=["path", "out_path", "removed", "not_removed", "error"])

    manifest = files.select("path", "content").mapInPandas(run, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{out}/_manifest")
    return files.sparkSession.read.parquet(f"{out}/_manifest")
