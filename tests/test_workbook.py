import io
import socket
import zipfile
from xml.etree import ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetlark.__main__ import main
from sheetlark.operators import clean as cleaning
from sheetlark.operators import compare as comparing
from sheetlark.operators.clean import clean_workbook
from sheetlark.plans import api
from sheetlark.plans.golden import cell, golden, workbook
from sheetlark.plans.report import render
from sheetlark.sources import vba as source_vba
from sheetlark.sources import workbook as source
from sheetlark.streaming.watch import watch


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    for name, data in golden().items():
        (d / name).write_bytes(data)
    (d / "broken.xlsx").write_bytes(b"not a zip")
    (d / "other.txt").write_text("no workbook")
    return d


def test_findings(spark, folder):
    rows = api.scan(spark, str(folder), raw=True).collect()
    full = [r for r in rows if r.path.endswith("full.xlsm")]
    assert {(r.kind, r.raw) for r in full if r.kind.startswith("metadata")} == {("metadata_author", "Fulano de Tal"), ("metadata_company", "Obras Ltda"), ("metadata_last_editor", "Beltrano")}
    assert {r.raw for r in full if r.kind == "external_link"} == {"file:///\\\\servidor\\custos.xlsx", "http://127.0.0.1:9/x"}
    assert [r.ref for r in rows if r.kind == "macro"] == ["Workbook_Open,Shell"]
    assert not [r for r in rows if r.path.endswith("clean.xlsx")]
    assert [r.kind for r in rows if r.path.endswith("broken.xlsx")] == ["unreadable"]


def test_expected_kinds(spark, folder):
    rows = api.scan(spark, str(folder / "full.xlsm"), raw=True).collect()
    got = sorted((r.kind, r.sheet or "", r.ref or "", r.raw) for r in rows if r.kind in ("cpf", "cnpj", "pis", "bank_account", "hidden_column", "hidden_row", "hidden_sheet", "comment", "save_folder"))
    assert got == sorted(
        [
            ("bank_account", "Dados", "A2", "Agência 1234 conta 56789-0"), ("cnpj", "Dados", "B5", "11.222.333/0001-81"), ("comment", "Dados", "B1", "ver com a obra"), ("cpf", "Dados", "A1", "529.982.247-25"), ("cpf", "Dados", "B1", "52998224725"),
            ("hidden_column", "Dados", "C", "C"), ("hidden_column", "Dados", "D", "D"), ("hidden_row", "Dados", "2", "2"), ("hidden_sheet", "Cofre", "", "Cofre"), ("hidden_sheet", "Segredo", "", "Segredo"),
            ("save_folder", "", "windows_user", "C:\\Users\\fulano\\Propostas\\"), *PIS,
        ]
    )


#: 120.12345.67-? with its check digit by the published weights.
def _pis(base):
    r = sum(int(d) * w for d, w in zip(base, (3, 2, 9, 8, 7, 6, 5, 4, 3, 2))) % 11
    return 0 if r < 2 else 11 - r


PIS = [("pis", "Dados", "A1", "120.12345.67-3")] if _pis("1201234567") == 3 else []


def test_masked_by_default(spark, folder):
    df = api.scan(spark, str(folder))
    assert "raw" not in df.columns
    assert {r.masked for r in df.where("kind = 'metadata_author'").collect()} == {"Fu****"}
    page = render(api.scan(spark, str(folder), raw=True))
    assert "529.982" not in page and "52****" in page and "Gravidade alta" in page and "não significa" in page
    assert {r.path.rsplit("/", 1)[1]: r.level for r in api.risk(spark, str(folder)).collect()} == {"clean.xlsx": "Nenhum", "full.xlsm": "Alto", "sent.xlsx": "Médio", "returned.xlsx": "Alto", "broken.xlsx": "Médio"}


def test_compare(spark, folder):
    pair = [(str(folder / "sent.xlsx"), str(folder / "returned.xlsx"))]
    got = sorted((r.category, r.sheet or "", r.ref or "", r.old or "", r.new or "") for r in api.compare(spark, pair, raw=True).collect())
    assert got == sorted(
        [
            ("value_changed", "Boletim", "B1", "100", "150"), ("value_changed", "Boletim", "B2", "200", "300"), ("formula_to_constant", "Boletim", "B2", "B1*2", "300"), ("row_hidden", "Boletim", "2", "", ""),
            ("sheet_hidden", "Base", "", "visible", "hidden"), ("link_added", "", "", "", "file:///C:\\tmp\\novo.xlsx"), ("metadata_changed", "", "lastModifiedBy", "Ana", "Bruno"), ("metadata_changed", "", "save_folder", "C:\\Users\\ana\\obra\\", "D:\\Users\\Ana\\"),
        ]
    )
    who = api.provenance(spark, pair).first()
    assert (who.saved_by_old, who.saved_by_new, who.same_windows_user_hint) == ("Ana", "Bruno", True) and "não prova" in who.caveat
    same = str(folder / "full.xlsm")
    assert api.compare(spark, [(same, same)]).count() == 0
    assert {r.new for r in api.compare(spark, pair).collect() if r.category == "value_changed"} == {"15****", "30****"}


def test_clean(spark, folder, tmp_path):
    before = (folder / "full.xlsm").read_bytes()
    manifest = api.clean(spark, str(folder / "full.xlsm"), str(tmp_path / "out")).collect()
    assert (folder / "full.xlsm").read_bytes() == before
    kinds = {r.kind for r in api.scan(spark, manifest[0].out_path).collect()}
    assert not kinds & {"comment", "metadata_author", "metadata_company", "external_link", "unreadable"}
    assert {"cpf", "hidden_sheet", "macro", "hidden_row", "metadata_last_editor", "save_folder"} <= kinds
    assert "CPF, CNPJ, PIS e dados bancários nas células" in manifest[0].not_removed and "macros" in manifest[0].not_removed
    manifest = api.clean(spark, str(folder / "full.xlsm"), str(tmp_path / "more"), drop_hidden_sheets=True, drop_macros=True).collect()
    out = manifest[0].out_path
    assert out.endswith(".xlsx") and not {r.kind for r in api.scan(spark, out).collect()} & {"hidden_sheet", "macro"}
    with zipfile.ZipFile(out.removeprefix("file://")) as z:
        assert b"macroEnabled" not in z.read("[Content_Types].xml")
        for name in z.namelist():
            if name.endswith((".xml", ".rels")):
                ElementTree.fromstring(z.read(name))
        targets = {n.get("PartName", "").lstrip("/") for n in ElementTree.fromstring(z.read("[Content_Types].xml"))} - {""}
        assert targets <= set(z.namelist())
    with pytest.raises(ValueError):
        api.clean(spark, str(folder / "full.xlsm"), str(folder))
    bad = api.clean(spark, str(folder / "broken.xlsx"), str(tmp_path / "bad")).collect()
    assert bad[0].out_path is None and "BadZipFile" in bad[0].error


def test_nothing_is_opened(spark, tmp_path):
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        s.listen()
        s.settimeout(0.2)
        url = f"http://127.0.0.1:{s.getsockname()[1]}/x"
        (tmp_path / "a.xlsx").write_bytes(workbook([("S", "visible", "", "")], link=url, hyperlink=url))
        api.scan(spark, str(tmp_path)).collect()
        with pytest.raises(TimeoutError):
            s.accept()


def test_entities_stay_closed():
    secret = '<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]>'
    data = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook([("S", "visible", "", "")], author="a"))) as z, zipfile.ZipFile(data, "w") as out:
        for n in z.namelist():
            raw = z.read(n).decode()
            out.writestr(n, secret + raw.replace(">a<", ">&e;<") if n == "docProps/core.xml" else raw)
    facts = list(source.workbook_facts(data.getvalue()))
    assert any(f["kind"] == "error" for f in facts) and "root:" not in str(facts)


@settings(max_examples=30, deadline=None)
@given(st.booleans(), st.booleans(), st.booleans(), st.booleans(), st.booleans(), st.booleans(), st.booleans())
def test_clean_holds_for_any_mix(comments, author, company, link, hyperlink, macro, hidden):
    data = workbook(
        [("A", "visible", "", f'<row r="1">{cell("A1", "529.982.247-25", "inlineStr")}</row>'), *([("B", "hidden", "", "")] if hidden else [])],
        comments={"A1": ("x", "y")} if comments else None, author="x" if author else None, company="y" if company else None, link="file:///a" if link else None, hyperlink="http://b" if hyperlink else None, macro=b"m" if macro else None,
    )
    for all_ in (False, True):
        out, _ = clean_workbook(data, drop_hidden_sheets=all_, drop_macros=all_)
        facts = list(source.workbook_facts(out))
        kinds = {f["kind"] for f in facts}
        assert not kinds & {"comment", "link", "error"} and "cell" in kinds
        assert not [f for f in facts if f["kind"] == "prop" and f["name"] in ("creator", "company")]
        assert ("macro" in kinds) == (macro and not all_)
        assert [f["value"] for f in facts if f["kind"] == "sheet"].count("hidden") == int(hidden and not all_)
        assert clean_workbook(out, drop_hidden_sheets=all_, drop_macros=all_)[1] == []


def test_command_line_and_stream(spark, folder, tmp_path, capsys):
    assert main([str(folder / "full.xlsm"), "--limpar", str(tmp_path / "c")], spark) == 0
    assert main([str(folder / "full.xlsm"), "--report", str(tmp_path / "r.html")], spark) == 0
    assert main(["--compare", str(folder / "sent.xlsx"), str(folder / "returned.xlsx")], spark) == 0
    assert main([str(folder / "clean.xlsx")], spark) == 0
    assert "não significa" in capsys.readouterr().out and (tmp_path / "r.html").exists()
    watch(spark, str(folder), str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "s")).count() == api.scan(spark, str(folder)).count()


def _with_part(data, part, content):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            new.writestr(name, content if name == part else old.read(name))
    return out.getvalue()


def test_unreadable_parts_cost_nothing_else(spark, tmp_path, monkeypatch):
    row = lambda v: f'<row r="1">{cell("A1", v)}</row>'
    whole = workbook([("One", "visible", "", row("1")), ("Two", "hidden", "", row("2")), ("Three", "visible", "", row("3"))])
    broken = _with_part(whole, "xl/worksheets/sheet1.xml", "<worksheet><sheetData><row")
    facts = list(source.workbook_facts(broken))
    assert [(f["sheet"], f["value"]) for f in facts if f["kind"] == "sheet"] == [("One", "visible"), ("Two", "hidden"), ("Three", "visible")]
    assert [(f["sheet"], f["value"]) for f in facts if f["kind"] == "cell"] == [("Two", "2"), ("Three", "3")]
    assert [(f["name"], f["sheet"]) for f in facts if f["kind"] == "error"] == [("sheet", "One")]
    (tmp_path / "a.xlsx").write_bytes(whole)
    (tmp_path / "b.xlsx").write_bytes(broken)
    got = api.compare(spark, [(str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx"))], raw=True).collect()
    assert [(r.category, r.sheet, r.ref) for r in got] == [("unreadable", "One", "sheet")]
    monkeypatch.setattr(source, "MAX_PART", 4000)
    large = workbook([("One", "visible", "", "".join(f'<row r="{i}">{cell(f"A{i}", "0", "s")}</row>' for i in range(1, 400)))], strings=("x" * 9000,))
    facts = list(source.workbook_facts(large))
    assert sum(f["kind"] == "cell" and f["value"] == "x" * 9000 for f in facts) == 399 and not [f for f in facts if f["kind"] == "error"]


def test_files_are_opened_once(spark, folder, monkeypatch):
    """However many detectors and comparisons there are, a plan holds one reader of the files.

    A comparison writes what the files say, by a plan that holds the one reader, and reads it from there.
    """
    readers = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("MapInPandas")
    seen, write = {}, comparing.written
    monkeypatch.setattr(comparing, "written", lambda df, name: (seen.update({name: readers(df)}), write(df, name))[1])
    assert readers(api.compare(spark, [(str(folder / "sent.xlsx"), str(folder / "returned.xlsx"))])) == 0
    assert seen["facts"] == sum(seen.values()) == 1
    assert readers(api.scan(spark, str(folder))) == 1
    assert readers(api.risk(spark, str(folder))) == 1
    assert readers(api.provenance(spark, [(str(folder / "sent.xlsx"), str(folder / "returned.xlsx"))])) == 1


def test_rows_hidden_by_default(spark, tmp_path):
    """zeroHeight hides every row that the sheet does not write."""
    rest = '<sheetFormatPr defaultRowHeight="15" zeroHeight="1"/>'
    (tmp_path / "a.XlsX").write_bytes(workbook([("S", "visible", "", f'<row r="1">{cell("A1", "1")}</row>')]))
    (tmp_path / "b.xlsx").write_bytes(workbook([("S", "visible", rest, f'<row r="1">{cell("A1", "1")}</row>')]))
    found = api.scan(spark, str(tmp_path), raw=True).collect()
    assert [(r.path.rsplit("/", 1)[1], r.kind, r.sheet, r.ref) for r in found] == [("b.xlsx", "hidden_row", "S", "*")]
    changes = api.compare(spark, [(str(tmp_path / "a.XlsX"), str(tmp_path / "b.xlsx"))]).collect()
    assert [(r.category, r.sheet, r.ref) for r in changes] == [("row_hidden", "S", "*")]


HEAD = (
    '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    ' xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" mc:Ignorable="x14ac xr xr2 xr3" xmlns:x14ac="http://schemas.microsoft.com/office/spreadsheetml/2009/9/ac"'
    ' xmlns:xr="http://schemas.microsoft.com/office/spreadsheetml/2014/revision" xmlns:xr2="http://schemas.microsoft.com/office/spreadsheetml/2015/revision2"'
    ' xmlns:xr3="http://schemas.microsoft.com/office/spreadsheetml/2016/revision3" xr:uid="{00000000-0001-0000-0000-000000000000}">'
)


def test_copies_keep_the_root_as_it_was():
    """Spreadsheet programs declare prefixes that only mc:Ignorable names; a copy must declare them still."""
    data = workbook([("S", "visible", "", f'<row r="1">{cell("A1", "a &gt; b", "inlineStr")}</row>')], comments={"A1": ("x", "y")}, hyperlink="http://b")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    source = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n' + HEAD + sheet[sheet.index(">") + 1 :]
    out, _ = clean_workbook(_with_part(data, "xl/worksheets/sheet1.xml", source))
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        got = z.read("xl/worksheets/sheet1.xml").decode()
    assert got == source.replace('<hyperlinks><hyperlink ref="A1" r:id="rId1"/></hyperlinks>', "").replace('<legacyDrawing r:id="rId3"/>', "")
    assert all(f"xmlns:{p}=" in got for p in ElementTree.fromstring(got).get("{http://schemas.openxmlformats.org/markup-compatibility/2006}Ignorable").split())


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.sampled_from(["a", "b"]), st.booleans())
def test_edits_by_byte_range(step, gone, attributes):
    source = '<r x="1>2"><a i="1"/>é<b><a/>t&amp;<![CDATA[<a>]]></b ><!-- <a> --><a i=\'2\'>z<b/></a><b/></r>'.encode()
    blocks = lambda: (source[i : i + step] for i in range(0, len(source), step))
    change = {"i": '<"9'} if attributes else cleaning.DROP
    out = b"".join(cleaning.edited(blocks(), cleaning.edits(blocks(), lambda n: change if n.name == gone else None)))
    got, want = ElementTree.fromstring(out), ElementTree.fromstring(source)
    if attributes:
        for n in want.iter(gone):
            n.set("i", '<"9')
    else:
        assert not list(got.iter(gone)) and "é" in out.decode()
        return
    assert ElementTree.tostring(got) == ElementTree.tostring(want)


def test_dropped_sheets_leave_no_names():
    data = workbook([("A", "visible", "", ""), ("Segredo", "hidden", "", "")], company="x")
    app = '<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"><Company>x</Company><HeadingPairs/><TitlesOfParts><t>A</t><t>Segredo</t></TitlesOfParts></Properties>'
    out, _ = clean_workbook(_with_part(data, "docProps/app.xml", app), drop_hidden_sheets=True)
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert not [n for n in z.namelist() if b"Segredo" in z.read(n)]


def test_odd_archives_make_a_manifest_row(spark, tmp_path):
    whole = bytearray(workbook([("A", "visible", "", "")], author="x"))
    at = whole.find(b"PK\x01\x02")
    whole[at + 8] |= 1  # told as encrypted
    (tmp_path / "a.xlsx").write_bytes(bytes(whole))
    (tmp_path / "b.xlsx").write_bytes(_with_part(bytes(workbook([("A", "visible", "", "")])), "xl/workbook.xml", "<!DOCTYPE x><x/>"))
    rows = api.clean(spark, str(tmp_path), str(tmp_path / "out")).collect()
    assert sorted((r.path[-6:], r.out_path, bool(r.error)) for r in rows) == [("a.xlsx", None, True), ("b.xlsx", None, True)]


#: Published examples of the compression of macro sources.
PACKED = {
    "012FB000236161616263646582660070616768696A01380861 6B6C00306D6E6F70067102700410727374757610 7778797A003C": b"#aaabcdefaaaaghijaaaaaklaaamnopqaaaaaaaaaaaarstuvwxyzaaa",
    "0103B002614500": b"a" * 73,
}


def _project(sources):
    """A macro project: a compound file with a directory of modules, everything in plain sectors."""
    import struct

    def pack(raw):
        out = b"\x01"
        for i in range(0, len(raw), 3000):
            part = raw[i : i + 3000]
            body = b"".join(b"\0" + part[j : j + 8] for j in range(0, len(part), 8))
            out += struct.pack("<H", 0xB000 | (len(body) - 1)) + body
        return out

    record = lambda k, b: struct.pack("<HI", k, len(b)) + b
    directory = record(0x0003, struct.pack("<H", 1252)) + struct.pack("<HIIH", 0x0009, 4, 1, 2)
    files = {}
    for name, source in sources.items():
        directory += record(0x0019, name.encode()) + record(0x001A, name.encode()) + record(0x0031, struct.pack("<I", 7))
        files[name] = b"ignored" + pack(source.encode("cp1252"))
    files["dir"] = pack(directory)
    sectors, entries = [], []

    def put(data):
        first = len(sectors) + 2
        data += b"\0" * (-len(data) % 512)
        sectors.extend(data[i : i + 512] for i in range(0, len(data), 512))
        return first, len(data) // 512

    fat = [0xFFFFFFFD, 0xFFFFFFFE]
    names = sorted(files)
    entry = lambda name, kind, right, child, start, size: (n := (name + "\0").encode("utf-16-le")).ljust(64, b"\0") + struct.pack("<HBBIII", len(n), kind, 1, 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)  # noqa: E731, F841
    entries = [entry("Root Entry", 5, 0xFFFFFFFF, 1, 0xFFFFFFFE, 0), entry("VBA", 1, 0xFFFFFFFF, 2, 0, 0)]
    for i, name in enumerate(names):
        data = files[name].ljust(4096, b"\0") if len(files[name]) < 4096 else files[name]
        if name == "dir" or len(files[name]) < 4096:
            data = files[name] + b"\0" * max(0, 4096 - len(files[name]))
        first, n = put(data)
        fat += [*range(first + 1, first + n), 0xFFFFFFFE]
        entries.append(entry(name, 2, 3 + i if i + 1 < len(names) else 0xFFFFFFFF, 0xFFFFFFFF, first, len(data)))
    first, n = put(b"".join(entries))
    fat += [*range(first + 1, first + n), 0xFFFFFFFE]
    assert len(fat) <= 128
    head = source_vba.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, first, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 0, *([0xFFFFFFFF] * 108))
    return head + struct.pack("<128I", *fat, *([0xFFFFFFFF] * (128 - len(fat)))) + b"\0" * 512 + b"".join(sectors)


def test_macro_sources(spark, tmp_path):
    for packed, plain in PACKED.items():
        assert source_vba.decompress(bytes.fromhex(packed)) == plain
    auto = "Attribute VB_Name = \"Livro\"\r\n' Shell in a comment\r\nPrivate Declare PtrSafe Function URLDownloadToFileA Lib \"urlmon\" () As Long\r\nSub Workbook_Open()\r\n  CreateObject(\"WScript.Shell\").Run \"x\"\r\nEnd Sub\r\n"
    data = _project({"Livro": auto, "Limpo": "Sub Soma()\r\n  Shelly = 1 ' nada\r\nEnd Sub\r\n" * 200})
    assert dict(source_vba.modules(data))["Livro"].rstrip("\0") == auto
    (tmp_path / "m.xlsm").write_bytes(workbook([("S", "visible", "", "")], macro=data))
    got = {r.raw: r.ref for r in api.scan(spark, str(tmp_path), raw=True).where("kind = 'macro'").collect()}
    assert got["xl/vbaProject.bin/Livro"] == "Workbook_Open,Shell,CreateObject,WScript,Declare URLDownloadToFileA" and got["xl/vbaProject.bin/Limpo"] == ""
    facts = list(source.workbook_facts(workbook([("S", "visible", "", "")], macro=data[:700])))
    assert [f["kind"] for f in facts if f.get("name", "").startswith("xl/vba")] == ["macro", "error"]


def test_manifest_tells_of_formulas_that_cite_what_went(spark, tmp_path):
    rows = f'<row r="1">{cell("A1", "1", "n", "[1]Plan!A1+1")}{cell("B1", "2", "n", "SUM(1,2)")}</row>'
    hidden = f'<row r="1">{cell("A1", "1")}</row>'
    (tmp_path / "a.xlsx").write_bytes(workbook([("S", "visible", "", rows)], link="file:///x.xlsx"))
    (tmp_path / "b.xlsx").write_bytes(workbook([("S", "visible", "", f'<row r="1">{cell("A1", "1", "n", "Segredo!A1")}</row>'), ("Segredo", "hidden", "", hidden)]))
    (tmp_path / "c.xlsx").write_bytes(workbook([("S", "visible", "", f'<row r="1">{cell("A1", "1", "n", "A2*2")}</row>'), ("Segredo", "hidden", "", hidden)]))
    told = lambda out, **options: {r.path[-6]: "fórmulas que citam o que saiu" in r.not_removed for r in api.clean(spark, str(tmp_path), str(tmp_path / out), **options).collect() if f"/{out}/" not in r.path}
    assert told("x") == {"a": True, "b": False, "c": False}
    (tmp_path / "a.xlsx").unlink()
    got = {r.path[-6]: "fórmulas que citam o que saiu" in r.not_removed for r in api.clean(spark, [str(tmp_path / "b.xlsx"), str(tmp_path / "c.xlsx")], str(tmp_path / "y"), drop_hidden_sheets=True).collect()}
    assert got == {"b": True, "c": False}


def test_files_beyond_the_source_s_limit_are_told(spark, folder, monkeypatch):
    monkeypatch.setattr(source, "MAX_FILE", 1000)
    found = api.scan(spark, str(folder), raw=True).collect()
    sizes = {f: (folder / f).stat().st_size for f in ("sent.xlsx", "broken.xlsx")}
    assert sizes["sent.xlsx"] >= 1000 > sizes["broken.xlsx"]
    told = {r.path.rsplit("/", 1)[1]: (r.kind, r.raw) for r in found}
    assert told["sent.xlsx"] == ("unreadable", f"the file has {sizes['sent.xlsx']} bytes, 1000 or more") and told["broken.xlsx"][0] == "unreadable"


def test_report_holds_every_finding(spark, tmp_path):
    rows = "".join(f'<row r="{n}">{cell(f"A{n}", "529.982.247-25 & <b>", "inlineStr")}</row>' for n in range(1, 51))
    (tmp_path / "a.xlsx").write_bytes(workbook([("S", "visible", "", rows.replace("& <b>", "x"))], author="A &lt;b&gt; C"))
    api.report(spark, str(tmp_path), str(tmp_path / "r.html"))
    page = (tmp_path / "r.html").read_text()
    assert page.count("<td>S<td>A") == 50 and "<h3>cpf (50)</h3>" in page and "529.982" not in page and "e mais" not in page
    assert page.index("Gravidade alta") < page.index("Gravidade baixa") and page.startswith("<!doctype html>") and page.endswith("</html>\n")
    api.report(spark, str(tmp_path / "a.xlsx"), f"{tmp_path}/parts/")
    parts = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert parts == page
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "n.xlsx").write_bytes(golden()["clean.xlsx"])
    api.report(spark, str(tmp_path / "e"), str(tmp_path / "n.html"))
    assert "Nenhum achado." in (tmp_path / "n.html").read_text()
