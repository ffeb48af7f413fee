"""Small generated workbooks with known contents, for tests and golden queries."""

from __future__ import annotations

import io
import zipfile

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006"
X15AC = "http://schemas.microsoft.com/office/spreadsheetml/2010/11/ac"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
MACRO_TYPE = "application/vnd.ms-excel.sheet.macroEnabled.main+xml"


def _rels(items: list[tuple[str, str, str, bool]]) -> str:
    return f'<Relationships xmlns="{PKG}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"{" TargetMode=" + chr(34) + "External" + chr(34) if x else ""}/>' for i, k, t, x in items) + "</Relationships>"


def cell(ref: str, value: str | None = None, kind: str = "n", formula: str | None = None) -> str:
    f = f"<f>{formula}</f>" if formula else ""
    v = f"<is><t>{value}</t></is>" if kind == "inlineStr" else f"<v>{value}</v>" if value is not None else ""
    return f'<c r="{ref}" t="{kind}">{f}{v}</c>'


def workbook(
    sheets: list[tuple[str, str, str, str]],
    *,
    strings: tuple[str, ...] = (),
    comments: dict[str, tuple[str, str]] | None = None,
    author: str | None = None,
    company: str | None = None,
    editor: str | None = None,
    folder: str | None = None,
    link: str | None = None,
    hyperlink: str | None = None,
    macro: bytes | None = None,
) -> bytes:
    """Bytes of a workbook. ``sheets``: name, state, ``cols`` markup, rows markup; notes and hyperlinks go on the first."""
    parts: dict[str, str | bytes] = {}
    types = ['<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>', '<Default Extension="xml" ContentType="application/xml"/>', f'<Override PartName="/xl/workbook.xml" ContentType="{MACRO_TYPE if macro else SHEET_TYPE}"/>']
    rels, listed = [], []
    for i, (name, state, cols, rows) in enumerate(sheets, 1):
        tail, own = "", []
        if i == 1 and hyperlink:
            own.append(("rId1", "hyperlink", hyperlink, True))
            tail += '<hyperlinks><hyperlink ref="A1" r:id="rId1"/></hyperlinks>'
        if i == 1 and comments:
            own += [("rId2", "comments", "../comments1.xml", False), ("rId3", "vmlDrawing", "../drawings/vmlDrawing1.vml", False)]
            tail += '<legacyDrawing r:id="rId3"/>'
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{MAIN}" xmlns:r="{REL}">{cols}<sheetData>{rows}</sheetData>{tail}</worksheet>'
        if own:
            parts[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = _rels(own)
        types.append(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
        rels.append((f"rId{i}", "worksheet", f"worksheets/sheet{i}.xml", False))
        listed.append(f'<sheet name="{name}" sheetId="{i}"{"" if state == "visible" else f" state={chr(34)}{state}{chr(34)}"} r:id="rId{i}"/>')
    if strings:
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">' + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in strings) + "</sst>"
        rels.append(("rId90", "sharedStrings", "sharedStrings.xml", False))
        types.append('<Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/>')
    if comments:
        who = sorted({a for a, _ in comments.values()})
        parts["xl/comments1.xml"] = f'<comments xmlns="{MAIN}"><authors>' + "".join(f"<author>{a}</author>" for a in who) + "</authors><commentList>" + "".join(f'<comment ref="{r}" authorId="{who.index(a)}"><text><t>{t}</t></text></comment>' for r, (a, t) in comments.items()) + "</commentList></comments>"
        parts["xl/drawings/vmlDrawing1.vml"] = '<xml><x:ClientData xmlns:x="urn:schemas-microsoft-com:office:excel" ObjectType="Note"/></xml>'
        types.append('<Override PartName="/xl/comments1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.comments+xml"/>')
    external = ""
    if link:
        parts["xl/externalLinks/externalLink1.xml"] = f'<externalLink xmlns="{MAIN}"/>'
        parts["xl/externalLinks/_rels/externalLink1.xml.rels"] = _rels([("rId1", "externalLinkPath", link, True)])
        rels.append(("rId91", "externalLink", "externalLinks/externalLink1.xml", False))
        types.append('<Override PartName="/xl/externalLinks/externalLink1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.externalLink+xml"/>')
        external = '<externalReferences><externalReference r:id="rId91"/></externalReferences>'
    if macro:
        parts["xl/vbaProject.bin"] = macro
        rels.append(("rId92", "vbaProject", "vbaProject.bin", False))
        types.append('<Override PartName="/xl/vbaProject.bin" ContentType="application/vnd.ms-office.vbaProject"/>')
    where = f'<x15ac:absPath xmlns:x15ac="{X15AC}" url="{folder}"/>' if folder else ""
    parts["xl/workbook.xml"] = f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{where}<bookViews><workbookView activeTab="0"/></bookViews><sheets>{"".join(listed)}</sheets>{external}</workbook>'
    parts["xl/_rels/workbook.xml.rels"] = _rels(rels)
    parts["_rels/.rels"] = _rels([("rId1", "officeDocument", "xl/workbook.xml", False)])
    if author or editor:
        parts["docProps/core.xml"] = f'<cp:coreProperties xmlns:cp="{PKG}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">' + (f"<dc:creator>{author}</dc:creator>" if author else "") + (f"<cp:lastModifiedBy>{editor}</cp:lastModifiedBy>" if editor else "") + "</cp:coreProperties>"
    if company:
        parts["docProps/app.xml"] = f'<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"><Company>{company}</Company></Properties>'
    parts["[Content_Types].xml"] = f'<Types xmlns="{PKG}/content-types">{"".join(types)}</Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), parts[name])
    return out.getvalue()


def golden() -> dict[str, bytes]:
    """The golden files by name."""
    row = lambda n, cells, hidden=False: f'<row r="{n}"{" hidden=" + chr(34) + "1" + chr(34) if hidden else ""}>{cells}</row>'
    data = lambda a, b, hide: row(1, cell("A1", "0", "s") + cell("B1", a)) + row(2, cell("B2", b[0], "n", b[1]), hide) + row(3, cell("B3", "7", "n", "B1*2"))
    return {
        "clean.xlsx": workbook([("Dados", "visible", "", row(1, cell("A1", "1")))]),
        "full.xlsm": workbook(
            [
                ("Dados", "visible", '<cols><col min="3" max="4" hidden="1"/></cols>', row(1, cell("A1", "0", "s") + cell("B1", "52998224725")) + row(2, cell("A2", "1", "s"), True) + row(5, cell("A5", "111.111.111-11", "inlineStr") + cell("B5", "11.222.333/0001-81", "inlineStr"))),
                ("Segredo", "hidden", "", row(1, cell("A1", "9"))),
                ("Cofre", "veryHidden", "", ""),
            ],
            strings=("CPF 529.982.247-25 e PIS 120.12345.67-3", "Agência 1234 conta 56789-0"), comments={"B1": ("Fulano", "ver com a obra")}, author="Fulano de Tal", company="Obras Ltda", editor="Beltrano",
            folder="C:\\Users\\fulano\\Propostas\\", link="file:///\\\\servidor\\custos.xlsx", hyperlink="http://127.0.0.1:9/x", macro=b"Sub Workbook_Open() Shell",
        ),
        "sent.xlsx": workbook([("Boletim", "visible", "", data("100", ("200", "B1*2"), False)), ("Base", "visible", "", "")], strings=("Item",), editor="Ana", folder="C:\\Users\\ana\\obra\\"),
        "returned.xlsx": workbook([("Boletim", "visible", "", data("150", ("300", None), True)), ("Base", "hidden", "", "")], strings=("Item",), editor="Bruno", folder="D:\\Users\\Ana\\", link="file:///C:\\tmp\\novo.xlsx"),
    }
