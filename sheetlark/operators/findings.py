"""Detectors over workbook facts, and what is done with their findings.

``findings``: path, kind, severity, sheet, ref, raw, masked, explanation. An empty result does
not mean that a file is safe; human review remains necessary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import column_number
from ..functions.identifiers import found, found_in_number
from ..functions.masking import mask
from .ranges import covered

#: Severity and explanation of each kind of finding.
RULES = (
    ("hidden_sheet", "alto", "Aba oculta: o conteúdo segue no arquivo e pode ser reexibido."),
    ("hidden_row", "medio", "Linha oculta: os valores continuam na planilha."),
    ("hidden_column", "medio", "Coluna oculta: os valores continuam na planilha."),
    ("comment", "medio", "Comentário ou nota que o destinatário pode ler."),
    ("metadata_author", "baixo", "Autor gravado nos metadados do arquivo."),
    ("metadata_company", "baixo", "Empresa gravada nos metadados do arquivo."),
    ("metadata_last_editor", "baixo", "Último editor gravado no arquivo; o nome pode ser alterado."),
    ("save_folder", "medio", "Pasta onde a planilha foi salva; pode revelar usuário ou rede."),
    ("external_link", "medio", "Vínculo externo registrado; não foi aberto."),
    ("macro", "alto", "Macro presente; foi analisada sem ser executada."),
    ("cpf", "alto", "CPF com dígitos verificadores válidos em célula."),
    ("cnpj", "medio", "CNPJ com dígitos verificadores válidos em célula."),
    ("pis", "alto", "PIS com dígito verificador válido em célula."),
    ("bank_account", "alto", "Agência e conta bancária em célula."),
    ("card", "alto", "Número de cartão em célula."),
    ("iban", "alto", "IBAN com dígitos verificadores válidos em célula."),
    ("pix_key", "alto", "Chave PIX em célula."),
    ("unreadable", "medio", "Parte do arquivo não pôde ser lida; revise manualmente."),
)
RANKS = {"baixo": 1, "medio": 2, "alto": 3}
LEVELS = {0: "Nenhum", 1: "Baixo", 2: "Médio", 3: "Alto"}
CAVEAT = "A ausência de achados não significa que o arquivo está limpo; a revisão humana continua necessária."
CELL_KINDS = ("cpf", "cnpj", "pis", "bank_account", "card", "iban", "pix_key")
WINDOWS_USER = r"(?i)^[a-z]:[\\/]users[\\/]([^\\/]+)"


def rules(spark: SparkSession) -> DataFrame:
    """The rule table: as many rows as RULES, so it may be broadcast."""
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(RANKS[s]).alias("rank"), F.lit(e).alias("explanation")) for k, s, e in RULES))).alias("r")).select("r.*")


def folder_class(folder: Column) -> Column:
    """onedrive, network, windows_user or other."""
    return (
        F.when(folder.isNull(), F.lit(None))
        .when(folder.rlike(r"(?i)onedrive|docs\.live\.net|sharepoint\.com"), F.lit("onedrive"))
        .when(folder.rlike(r"^(\\\\|//)"), F.lit("network"))
        .when(folder.rlike(WINDOWS_USER), F.lit("windows_user"))
        .otherwise(F.lit("other"))
    )


def windows_user(folder: Column) -> Column:
    user = F.regexp_extract(folder, WINDOWS_USER, 1)
    return F.when(user != "", user)


# ---------------------------------------------------------------- detectors: what one fact tells


def _finding(kind: str | Column, raw: str | Column = "value", ref: str | Column = "ref") -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.struct(kind.alias("kind"), text(ref).alias("ref"), text(raw).alias("raw"))


def _hidden_sheet() -> Column:
    return F.when(F.col("value").isin("hidden", "veryHidden"), F.array(_finding("hidden_sheet", "sheet")))


def _hidden_rows() -> Column:
    return F.transform(F.sequence("row", "col"), lambda i: _finding("hidden_row", i, i))


def _hidden_columns() -> Column:
    letter = lambda x: F.when(x > 0, F.char(65 + (x - 1) % 26)).otherwise("")

    def name(i: Column) -> Column:
        high = F.floor((i - 1) / 26)
        return F.concat(letter(F.floor((high - 1) / 26)), F.when(high > 0, F.char(65 + (high - 1) % 26)).otherwise(""), letter(i))

    return F.transform(F.transform(F.sequence("row", "col"), name), lambda n: _finding("hidden_column", n, n))


_PROPS = {"creator": "metadata_author", "company": "metadata_company", "lastModifiedBy": "metadata_last_editor"}


def _prop() -> Column:
    who = F.element_at(F.create_map(*[F.lit(x) for kv in _PROPS.items() for x in kv]), F.col("name"))
    folder = F.array(_finding("save_folder", ref=folder_class(F.col("value"))))
    return F.when(F.col("name") == "save_folder", folder).when(F.col("name").isin(*_PROPS), F.array(_finding(who, ref="name")))


def _identifiers(kinds: tuple[str, ...] = CELL_KINDS) -> Column:
    """CPF, CNPJ, PIS and bank data in a cell; texts by pattern, numbers by padded value."""
    arrays = []
    for kind in kinds:
        values = found("value", kind)
        if kind in ("cpf", "cnpj", "pis"):
            values = f"CASE WHEN type = 'n' THEN array_distinct(concat({values}, {found_in_number('value', kind)})) ELSE {values} END"
        arrays.append(f"transform({values}, v -> struct('{kind}' AS kind, ref AS ref, v AS raw))")
    # an identifier has two digits in a row, or its name
    return F.expr(rf"CASE WHEN value RLIKE r'(?i)\d{{2}}|pix' THEN concat({', '.join(arrays)}) END")


#: The findings of a fact by its kind, each an array from that row alone.
DETECTORS = {
    "sheet": _hidden_sheet,
    "hidden_row": _hidden_rows,
    "hidden_rest": lambda: F.array(_finding("hidden_row", F.lit("*"), F.lit("*"))),
    "hidden_col": _hidden_columns,
    "comment": lambda: F.array(_finding("comment")),
    "prop": _prop,
    "link": lambda: F.array(_finding("external_link", ref="name")),
    "macro": lambda: F.array(_finding("macro", "name", "type")),
    "cell": _identifiers,
    "error": lambda: F.array(_finding("unreadable", ref="name")),
}


def detect(facts: DataFrame, *kinds: str) -> DataFrame:
    """``path, kind, sheet, ref, raw`` from facts of the given kinds, or all, in one pass over them."""
    kinds = kinds or tuple(DETECTORS)
    each = None
    for k in kinds:
        each = F.when(F.col("kind") == k, DETECTORS[k]()) if each is None else each.when(F.col("kind") == k, DETECTORS[k]())
    return _told(facts.where(F.col("kind").isin(*kinds)), each)


def _told(facts: DataFrame, each: Column) -> DataFrame:
    return facts.select("path", "sheet", F.explode(each).alias("x")).select("path", "x.kind", "sheet", "x.ref", "x.raw")


def hidden_sheets(facts: DataFrame) -> DataFrame:
    return detect(facts, "sheet")


def hidden_columns(facts: DataFrame) -> DataFrame:
    return detect(facts, "hidden_col")


def comments(facts: DataFrame) -> DataFrame:
    return detect(facts, "comment")


def identifiers(facts: DataFrame, *kinds: str) -> DataFrame:
    """Identifiers of the given kinds in cells, or of all; patterns of other kinds are not searched for."""
    return _told(facts.where("kind = 'cell'"), _identifiers(kinds or CELL_KINDS))


def with_places(found_: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings with a column ``hidden``: whether a cell stands in a hidden ``sheet``, ``row`` or ``column``, the first that holds.

    Ranges meet cells in boundary sweeps. Findings without a cell, and those in plain sight, get null.
    """
    letters, digits = "regexp_extract(ref, '^([A-Z]{1,3})[0-9]+$', 1)", F.regexp_extract("ref", "^[A-Z]{1,3}([0-9]{1,7})$", 1)
    cell = F.col("kind").isin(*CELL_KINDS, "comment") & F.col("ref").rlike("^[A-Z]{1,3}[0-9]{1,7}$")
    placed = found_.withColumns({"_row": F.when(cell, F.try_to_number(digits, F.lit("9999999")).cast("long")), "_col": F.when(cell, column_number(letters).cast("long"))})
    for kind, at, name in (("hidden_row", "_row", "_in_row"), ("hidden_col", "_col", "_in_col")):
        held = facts.where(F.col("kind") == kind).select("path", "sheet", "row", "col")
        placed = covered(placed, held, ["path", "sheet"], at, lo="row", hi="col", name=name)
    away = facts.where("kind = 'sheet' AND value IN ('hidden', 'veryHidden')").select("path", "sheet", F.lit(True).alias("_in_sheet")).distinct()
    known = placed.join(away, ["path", "sheet"], "left")
    where = F.when(F.col("_row").isNull(), F.lit(None)).when(F.col("_in_sheet"), "sheet").when(F.col("_in_row"), "row").when(F.col("_in_col"), "column")
    return known.select(*found_.columns, where.alias("hidden"))


# ---------------------------------------------------------------- findings


def classify(raw: DataFrame) -> DataFrame:
    """Add severity, masked value and explanation to ``path, kind, sheet, ref, raw`` rows."""
    known = F.broadcast(rules(raw.sparkSession))
    return raw.join(known, "kind", "left").select("path", "kind", F.coalesce("severity", F.lit("medio")).alias("severity"), "sheet", "ref", "raw", mask(F.col("raw")).alias("masked"), "explanation")


def findings(facts: DataFrame) -> DataFrame:
    """All findings in one place, with real values; see ``functions.masking.reveal``. Facts are read once."""
    return classify(detect(facts))


def grouped(found_: DataFrame, *extra: str) -> DataFrame:
    """Number of findings by severity and kind, with totals by severity and in all (nulls stand for all)."""
    return found_.groupingSets([["severity", "kind"], ["severity"], []], "severity", "kind").agg(F.count("*").alias("n_findings"), F.countDistinct("path").alias("n_files"))


def risk(found_: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The overall level of each file: the highest severity found in it. ``files`` adds those without findings."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("severity"))
    level = lambda r: F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), r)
    out = found_.groupBy("path").agg(F.max(rank).alias("rank"), F.count("*").alias("n_findings"))
    if files is not None:
        out = files.select("path").distinct().join(out, "path", "left").fillna(0, ["rank", "n_findings"])
    return out.select("path", "n_findings", level(F.col("rank")).alias("level"))
