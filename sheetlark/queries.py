"""Registered queries of the workbook engine, each with its SQL.

The driver's tables hold no workbooks, so most queries feed an operator with facts derived
from those tables; the golden queries read generated workbooks and are held against fixed
rows, which is a golden file and not an independent oracle.
"""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .__main__ import main
from .functions import formulas
from .functions import identifiers as ids
from .functions.masking import mask, reveal
from .operators import compare, findings, nested, sheets, sketches
from .operators.asof import asof
from .plans import api, report
from .plans.golden import golden
from .plans.report import render
from .sources import workbook
from .sources.shared import shared_folder, written
from .streaming import events, returns

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """Facts of one kind from any table; what is not given is null."""
    types = dict(f.split() for f in workbook.FACTS.split(", "))
    given = {"kind": F.lit(kind), "path": F.lit("table"), **columns}
    return df.select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()))


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


# ---------------------------------------------------------------- masking, grouping, risk

#: A value stands alone; the signs next to it are looked at, not taken.
CARD, IPV4 = r"(?<![0-9A-Za-z])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?![0-9A-Za-z])", r"(?<![0-9A-Za-z.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![0-9A-Za-z])"


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card- and IPv4-shaped values of documents: stand-ins that the driver's tables do hold."""
    docs = table(spark, sf_dir, "documents")
    found = lambda p: F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(0))
    tagged = lambda k, p: F.transform(found(p), lambda v: F.struct(F.lit(k).alias("kind"), v.alias("raw")))
    each = F.concat(tagged("card", CARD), tagged("ipv4", IPV4))
    raw = docs.select(F.col("doc_id").cast("string").alias("path"), F.explode(each).alias("x"))
    return findings.classify(raw.select("path", "x.kind", F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("ref"), "x.raw"))


#: DuckDB's patterns cannot look around. Its ``\\b`` knows ASCII letters, digits and the underscore, which is replaced first;
#: the sign before an address is taken, the one behind is not, so that the next value may begin right there.
_DOC_FINDINGS = r"""
t AS (SELECT CAST(doc_id AS VARCHAR) AS path, replace(text, '_', ';') AS text FROM documents),
f AS (SELECT path, 'card' AS kind, 'alto' AS severity, unnest(regexp_extract_all(text, '\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b')) AS raw FROM t
 UNION ALL SELECT path, 'ipv4', 'medio', unnest(regexp_extract_all(text, '(^|[^0-9A-Za-z.])([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b', 2)) FROM t)"""
_MASK = "CASE WHEN length({0}) <= 2 THEN '****' ELSE left({0}, 2) || '****' END"


@query(f"WITH {_DOC_FINDINGS} SELECT severity, kind, count(*) AS n_findings, count(DISTINCT path) AS n_files FROM f GROUP BY GROUPING SETS ((severity, kind), (severity), ())")
def findings_grouped(spark, sf_dir):
    return findings.grouped(document_findings(spark, sf_dir))


@query(f"WITH {_DOC_FINDINGS} SELECT path, kind, severity, {_MASK.format('raw')} AS masked FROM f")
def findings_masked_by_default(spark, sf_dir):
    return reveal(document_findings(spark, sf_dir)).select("path", "kind", "severity", "masked")


@query(f"WITH {_DOC_FINDINGS} SELECT path, kind, raw FROM f")
def findings_revealed_on_request(spark, sf_dir):
    return reveal(document_findings(spark, sf_dir), raw=True).select("path", "kind", "raw")


@query(f"WITH {_DOC_FINDINGS} SELECT CAST(d.doc_id AS VARCHAR) AS path, count(f.path) AS n_findings, CASE max(CASE severity WHEN 'alto' THEN 3 WHEN 'medio' THEN 2 ELSE 0 END) WHEN 3 THEN 'Alto' WHEN 2 THEN 'Médio' ELSE 'Nenhum' END AS level FROM documents d LEFT JOIN f ON f.path = CAST(d.doc_id AS VARCHAR) GROUP BY d.doc_id")
def risk_level(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"))
    return findings.risk(document_findings(spark, sf_dir), files)


@query(f"WITH {_DOC_FINDINGS}, k AS (SELECT severity, kind, count(*) AS n, count(DISTINCT path) AS n_files FROM f GROUP BY ALL) SELECT CASE severity WHEN 'alto' THEN 'Gravidade alta' ELSE 'Gravidade média' END AS title, kind, n AS n_findings, least(n, 20) AS n_shown, 0 AS n_unmasked FROM k")
def html_report(spark, sf_dir):
    """The report page over all findings of the documents, read back from its markup."""
    page = render(reveal(document_findings(spark, sf_dir)))
    rows = []
    for part in page.split("<h2>")[1:]:
        for kind, n, table_ in re.findall(r"<h3>(\w+) \((\d+)\)</h3>(.*?)</table>", part, re.S):
            shown = re.findall(r"<td>([^<]*)</?tr>", table_)
            rows.append((part.partition("<")[0], kind, int(n), len(shown), sum(not v.endswith("****") for v in shown)))
    return spark.createDataFrame(rows, "title string, kind string, n_findings long, n_shown long, n_unmasked int")


@query(f"WITH {_DOC_FINDINGS} SELECT severity, kind, count(*) AS n_findings, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_unmasked FROM f GROUP BY severity, kind")
def html_report_full(spark, sf_dir):
    """The full report over all findings of the documents, read back from its markup: every finding is a line."""
    line = report.lines(reveal(document_findings(spark, sf_dir))).where("kind IS NOT NULL")
    row = F.col("line").startswith("<tr>")
    told = F.max(F.when(F.col("part") == 0, F.regexp_extract("line", r"<h3>\w+ \((\d+)\)", 1).cast("long")))
    return line.groupBy("severity", "kind").agg(told.alias("n_findings"), F.count_if(row).alias("n_rows"), F.count_if(row & ~F.col("line").endswith("****</tr>")).alias("n_unmasked"))


@query(f"SELECT o_orderkey, {_MASK.format('CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)')} AS masked FROM orders")
def mask_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", mask(money("o_totalprice")).alias("masked"))


@query("""SELECT * FROM (VALUES
 ('hidden_sheet', 'alto', 3, 'Aba oculta: o conteúdo segue no arquivo e pode ser reexibido.'),
 ('hidden_row', 'medio', 2, 'Linha oculta: os valores continuam na planilha.'),
 ('hidden_column', 'medio', 2, 'Coluna oculta: os valores continuam na planilha.'),
 ('comment', 'medio', 2, 'Comentário ou nota que o destinatário pode ler.'),
 ('metadata_author', 'baixo', 1, 'Autor gravado nos metadados do arquivo.'),
 ('metadata_company', 'baixo', 1, 'Empresa gravada nos metadados do arquivo.'),
 ('metadata_last_editor', 'baixo', 1, 'Último editor gravado no arquivo; o nome pode ser alterado.'),
 ('save_folder', 'medio', 2, 'Pasta onde a planilha foi salva; pode revelar usuário ou rede.'),
 ('external_link', 'medio', 2, 'Vínculo externo registrado; não foi aberto.'),
 ('macro', 'alto', 3, 'Macro presente; foi analisada sem ser executada.'),
 ('cpf', 'alto', 3, 'CPF com dígitos verificadores válidos em célula.'),
 ('cnpj', 'medio', 2, 'CNPJ com dígitos verificadores válidos em célula.'),
 ('pis', 'alto', 3, 'PIS com dígito verificador válido em célula.'),
 ('bank_account', 'alto', 3, 'Agência e conta bancária em célula.'),
 ('card', 'alto', 3, 'Número de cartão em célula.'),
 ('iban', 'alto', 3, 'IBAN com dígitos verificadores válidos em célula.'),
 ('pix_key', 'alto', 3, 'Chave PIX em célula.'),
 ('unreadable', 'medio', 2, 'Parte do arquivo não pôde ser lida; revise manualmente.')) t(kind, severity, rank, explanation)""")
def severity_rules(spark, sf_dir):
    return findings.rules(spark)


# ---------------------------------------------------------------- identifiers


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out one by one over all cores: a narrow file is read by few tasks, whatever its rows ask for."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def _customers(spark, sf_dir) -> DataFrame:
    return dealt(table(spark, sf_dir, "customer").select("c_custkey"))


def _check_digits(spark, sf_dir, size, weights):
    base = F.lpad(F.pmod(F.col("c_custkey") * 7919 + 104729, F.lit(10**9)).cast("string"), size, "1")
    df = _customers(spark, sf_dir).select("c_custkey", base.alias("number"))
    for w in weights:
        df = df.withColumn("number", F.expr(f"concat(number, CAST({ids.check_digit('number', w)} AS STRING))"))
    changed = "concat(left(number, length(number) - 1), CAST(pmod(CAST(right(number, 1) AS INT) + 1, 10) AS STRING))"
    return df.select("c_custkey", "number", F.expr(ids.holds("number", weights)).alias("valid"), F.expr(ids.holds(changed, weights)).alias("valid_if_changed"))


#: The published weights, written out here apart from the code's own.
_SQL_CPF = ("[10, 9, 8, 7, 6, 5, 4, 3, 2]", "[11, 10, 9, 8, 7, 6, 5, 4, 3, 2]")
_SQL_CNPJ = ("[5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]", "[6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]")
_SQL_PIS = ("[3, 2, 9, 8, 7, 6, 5, 4, 3, 2]",)


def _check_sql(size: int, weights: tuple[str, ...]) -> str:
    """Numbers of customers with the remainders of their weighted sums as check digits."""
    sql = f"SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 104729) % 1000000000 AS VARCHAR), {size}, '1') AS number FROM customer"
    for w in weights:
        rest = f"list_sum(list_transform({w}, lambda w, i: w * CAST(substr(number, CAST(i AS INT), 1) AS INT))) % 11"
        sql = f"SELECT c_custkey, number || CASE WHEN {rest} < 2 THEN '0' ELSE CAST(CAST(11 - {rest} AS INT) AS VARCHAR) END AS number FROM ({sql})"
    return f"SELECT c_custkey, number, length(replace(number, substr(number, 1, 1), '')) > 0 AS valid, false AS valid_if_changed FROM ({sql})"


@query(_check_sql(9, _SQL_CPF))
def cpf_check_digit(spark, sf_dir):
    return _check_digits(spark, sf_dir, 9, ids.CPF_WEIGHTS)


@query(_check_sql(12, _SQL_CNPJ))
def cnpj_check_digit(spark, sf_dir):
    return _check_digits(spark, sf_dir, 12, ids.CNPJ_WEIGHTS)


@query(_check_sql(10, _SQL_PIS))
def pis_check_digit(spark, sf_dir):
    return _check_digits(spark, sf_dir, 10, ids.PIS_WEIGHTS)


_CPF_TEXT = f"SELECT c_custkey, substr(number, 1, 3) || '.' || substr(number, 4, 3) || '.' || substr(number, 7, 3) || '-' || substr(number, 10, 2) AS raw FROM ({_check_sql(9, _SQL_CPF)})"


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS ref, 'cpf' AS kind, raw FROM ({_CPF_TEXT})")
def cpf_in_cells(spark, sf_dir):
    """Formatted CPFs in text cells, one valid, one with a wrong digit, one inside a longer token."""
    n = F.col("number")
    shaped = lambda x: F.concat(F.left(x, F.lit(3)), F.lit("."), F.substring(x, 4, 3), F.lit("."), F.substring(x, 7, 3), F.lit("-"), F.substring(x, 10, 2))
    wrong = F.concat(F.left(n, F.lit(10)), F.pmod(F.right(n, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))
    text = F.concat(F.lit("Nome X, CPF "), shaped(n), F.lit("; outro "), shaped(wrong), F.lit("; token a"), n, F.lit("f"))
    cells = facts(_check_digits(spark, sf_dir, 9, ids.CPF_WEIGHTS), "cell", ref=F.col("c_custkey"), type=F.lit("s"), value=text)
    return findings.identifiers(cells, "cpf").select("ref", "kind", "raw")


@query("""WITH d AS (SELECT c_custkey, '4' || lpad(CAST((c_custkey * 7919 + 104729) % 1000000000 AS VARCHAR), 14, '3') AS b FROM customer),
s AS (SELECT c_custkey, b, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(b, i, 1) AS INT) WHEN CAST(substr(b, i, 1) AS INT) * 2 > 9 THEN CAST(substr(b, i, 1) AS INT) * 2 - 9 ELSE CAST(substr(b, i, 1) AS INT) * 2 END)) AS t FROM d)
SELECT c_custkey, b || CAST((10 - t % 10) % 10 AS VARCHAR) AS number FROM s""")
def card_luhn(spark, sf_dir):
    base = F.concat(F.lit("4"), F.lpad(F.pmod(F.col("c_custkey") * 7919 + 104729, F.lit(10**9)).cast("string"), 14, "3"))
    each = _customers(spark, sf_dir).select("c_custkey", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(base, d.cast("string")))).alias("number"))
    return each.where(ids.luhn("number"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS ref, 'Agência ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ' conta ' || CAST(10000 + c_custkey AS VARCHAR) || '-' || CAST(c_custkey % 10 AS VARCHAR) AS raw FROM customer")
def bank_accounts_in_cells(spark, sf_dir):
    k = F.col("c_custkey")
    value = F.concat(F.lit("Pagar: Agência "), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" conta "), (10000 + k).cast("string"), F.lit("-"), (k % 10).cast("string"), F.lit(", obrigado"))
    return findings.identifiers(facts(_customers(spark, sf_dir), "cell", ref=k, type=F.lit("s"), value=value), "bank_account").select("ref", "raw")


_ALNUM_BASE = "chr(CAST(65 + c_custkey % 26 AS INT)) || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || chr(CAST(65 + c_custkey * 7 % 26 AS INT)) || lpad(CAST((c_custkey * 7919 + 104729) % 10000000 AS VARCHAR), 7, '1')"


def _alnum_sql() -> str:
    sql = f"SELECT c_custkey, {_ALNUM_BASE} AS number FROM customer"
    for w in _SQL_CNPJ:
        rest = f"list_sum(list_transform({w}, lambda w, i: w * (ascii(substr(number, CAST(i AS INT), 1)) - 48))) % 11"
        sql = f"SELECT c_custkey, number || CASE WHEN {rest} < 2 THEN '0' ELSE CAST(CAST(11 - {rest} AS INT) AS VARCHAR) END AS number FROM ({sql})"
    return f"SELECT CAST(c_custkey AS VARCHAR) AS ref, substr(number, 1, 2) || '.' || substr(number, 3, 3) || '.' || substr(number, 6, 3) || '/' || substr(number, 9, 4) || '-' || substr(number, 13, 2) AS raw FROM ({sql})"


@query(_alnum_sql())
def cnpj_with_letters_in_cells(spark, sf_dir):
    """CNPJs with letters, each next to one with another last digit and one without its signs, which is no CNPJ then."""
    k = F.col("c_custkey")
    base = F.concat(F.char(65 + k % 26), F.lpad((k % 1000).cast("string"), 3, "0"), F.char(65 + k * 7 % 26), F.lpad(F.pmod(k * 7919 + 104729, F.lit(10**7)).cast("string"), 7, "1"))
    df = _customers(spark, sf_dir).select("c_custkey", base.alias("number"))
    for w in ids.CNPJ_WEIGHTS:
        df = df.withColumn("number", F.expr(f"concat(number, CAST({ids.check_digit('number', w)} AS STRING))"))
    n = F.col("number")
    shaped = lambda x: F.concat(F.substring(x, 1, 2), F.lit("."), F.substring(x, 3, 3), F.lit("."), F.substring(x, 6, 3), F.lit("/"), F.substring(x, 9, 4), F.lit("-"), F.substring(x, 13, 2))
    wrong = F.concat(F.left(n, F.lit(13)), F.pmod(F.right(n, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))
    cells = facts(df, "cell", ref=k, type=F.lit("s"), value=F.concat(F.lit("CNPJ "), shaped(n), F.lit("; "), shaped(wrong), F.lit("; "), n))
    return findings.identifiers(cells, "cnpj").select("ref", "raw")


_IBAN_BASE = "lpad(CAST((c_custkey * 7919 + 104729) % 100000000 AS VARCHAR), 8, '0') || '00001' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || 'C' || CAST(c_custkey % 10 AS VARCHAR)"


@query(f"""WITH b AS (SELECT c_custkey, {_IBAN_BASE} AS base FROM customer), d AS (SELECT c_custkey, base, 98 - CAST(replace(base, 'C', '12') || '112700' AS HUGEINT) % 97 AS digits FROM b)
SELECT CAST(c_custkey AS VARCHAR) AS ref, 'BR' || lpad(CAST(digits AS VARCHAR), 2, '0') || base AS raw FROM d""")
def ibans_in_cells(spark, sf_dir):
    """IBANs with the check digits that their number asks for; with all other digits tried in their place none holds."""
    k = F.col("c_custkey")
    base = F.concat(F.lpad(F.pmod(k * 7919 + 104729, F.lit(10**8)).cast("string"), 8, "0"), F.lit("00001"), F.lpad(k.cast("string"), 10, "0"), F.lit("C"), (k % 10).cast("string"))
    tried = F.array_join(F.transform(F.sequence(F.lit(2), F.lit(98)), lambda d: F.concat(F.lit("BR"), F.lpad(d.cast("string"), 2, "0"), base)), "; ")
    cells = facts(_customers(spark, sf_dir), "cell", ref=k, type=F.lit("s"), value=tried)
    return findings.identifiers(cells, "iban").select("ref", "raw")


@query("SELECT CAST(c_custkey AS VARCHAR) AS ref, 'PIX: ' || CASE c_custkey % 3 WHEN 0 THEN 'cliente.' || CAST(c_custkey AS VARCHAR) || '@banco.com.br' WHEN 1 THEN '+5511' || lpad(CAST(c_custkey AS VARCHAR), 9, '9') ELSE substr(md5('a'), 1, 8) || '-1234-4abc-8def-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') END AS raw FROM customer")
def pix_keys_in_cells(spark, sf_dir):
    """PIX keys of three shapes by their name; the same e-mail without it is none."""
    k = F.col("c_custkey")
    mail = F.concat(F.lit("cliente."), k.cast("string"), F.lit("@banco.com.br"))
    key = F.when(k % 3 == 0, mail).when(k % 3 == 1, F.concat(F.lit("+5511"), F.lpad(k.cast("string"), 9, "9"))).otherwise(F.concat(F.left(F.md5(F.lit("a")), F.lit(8)), F.lit("-1234-4abc-8def-"), F.lpad(k.cast("string"), 12, "0")))
    cells = facts(_customers(spark, sf_dir), "cell", ref=k, type=F.lit("s"), value=F.concat(F.lit("pagar em PIX: "), key, F.lit(" ou escrever a "), mail))
    return findings.identifiers(cells, "pix_key").select("ref", "raw")


# ---------------------------------------------------------------- detectors over facts

_FOLDERS = ("C:\\Users\\{}\\Docs", "C:\\Users\\{}\\OneDrive\\Obras", "\\\\servidor\\{}", "D:\\Obras\\{}", "https://d.docs.live.net/{}")


def _folder(key: Column, who: Column) -> Column:
    shapes = F.array(*(F.lit(s) for s in _FOLDERS))
    return F.replace(F.element_at(shapes, (key % 5 + 1).cast("int")), F.lit("{}"), who)


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'windows_user' WHEN 1 THEN 'onedrive' WHEN 2 THEN 'network' WHEN 3 THEN 'other' ELSE 'onedrive' END AS location, CASE WHEN c_custkey % 5 IN (0, 1) THEN c_name END AS windows_user FROM customer")
def save_folder_class(spark, sf_dir):
    folder = _folder(F.col("c_custkey"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", findings.folder_class(folder).alias("location"), findings.windows_user(folder).alias("windows_user"))


@query("SELECT page_id, regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS c, len(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS n FROM pages".replace("regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS c, ", ""))
def hidden_markup_comments(spark, sf_dir):
    """HTML comments as the pages' hidden notes, through the comment detector."""
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<!--(.*?)-->"), F.lit(1))).alias("text"))
    found = findings.comments(facts(each, "comment", path=F.col("page_id"), value=F.col("text")))
    counts = found.groupBy("path").agg(F.count("*").alias("n")).select(F.col("path").cast("long").alias("page_id"), "n")
    return table(spark, sf_dir, "pages").select("page_id").join(counts, "page_id", "left").fillna(0, ["n"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS path, unnest(range(n_nationkey * 30 + 1, n_nationkey * 30 + n_regionkey + 2)) AS i FROM nation".replace("AS i FROM nation", "AS i FROM nation").join(("WITH e AS (", ") SELECT path, CASE WHEN i > 702 THEN chr(CAST(65 + ((i - 1) // 26 - 1) // 26 - 1 AS INT)) ELSE '' END || CASE WHEN i > 26 THEN chr(CAST(65 + ((i - 1) // 26 - 1) % 26 AS INT)) ELSE '' END || chr(CAST(65 + (i - 1) % 26 AS INT)) AS ref FROM e")))
def hidden_columns_named(spark, sf_dir):
    k = F.col("n_nationkey")
    hidden = facts(table(spark, sf_dir, "nation"), "hidden_col", path=k, row=k * 30 + 1, col=k * 30 + 1 + F.col("n_regionkey"))
    return findings.hidden_columns(hidden).select("path", "ref")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS raw FROM part WHERE p_size % 3 > 0")
def hidden_sheets_found(spark, sf_dir):
    state = F.element_at(F.array(F.lit("visible"), F.lit("hidden"), F.lit("veryHidden")), (F.col("p_size") % 3 + 1).cast("int"))
    return findings.hidden_sheets(facts(table(spark, sf_dir, "part"), "sheet", path=F.col("p_partkey"), sheet=F.col("p_name"), value=state)).select("path", "raw")


# ---------------------------------------------------------------- comparison


def _order_cells(orders: DataFrame) -> DataFrame:
    """Orders as long cells: the address is column letter and order key, prices carry a formula."""
    columns = (("A", F.col("o_orderstatus")), ("B", money("o_totalprice")), ("C", F.col("o_orderpriority")))
    cell = F.array(*(F.struct(F.lit(c).alias("c"), v.alias("value"), (F.concat(F.lit("SUM(D"), F.col("o_orderkey").cast("string"), F.lit(")")) if c == "B" else F.lit(None).cast("string")).alias("formula")) for c, v in columns))
    return orders.select("o_orderkey", F.explode(cell).alias("x")).select("o_orderkey", F.concat("x.c", F.col("o_orderkey").cast("string")).alias("ref"), "x.value", "x.formula")


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders, and orders as they came back: some prices and formulas changed, some rows gone, some new."""
    old = _order_cells(table(spark, sf_dir, "orders"))
    k, priced = F.col("o_orderkey"), F.col("ref").startswith("B")
    value = F.when(priced & (k % 97 == 0), F.concat("value", F.lit("1"))).otherwise(F.col("value"))
    formula = F.when(priced & (k % 89 == 0), F.lit(None)).when(priced & (k % 83 == 0), F.concat("formula", F.lit("*2"))).otherwise(F.col("formula"))
    ref = F.when(k % 101 == 0, F.concat(F.lit("Z"), "ref")).otherwise(F.col("ref"))
    new = old.select(ref.alias("ref"), value.alias("value"), formula.alias("formula"))
    return tuple(_sided(d, "cell", sheet=F.lit("Boletim"), ref=F.col("ref"), value=F.col("value"), formula=F.col("formula")) for d in (old, new))


_CELLS = """
o AS (SELECT o_orderkey AS k, unnest(['A', 'B', 'C']) AS c, unnest([o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), o_orderpriority]) AS value FROM orders),
a AS (SELECT k, c || CAST(k AS VARCHAR) AS ref, value, CASE WHEN c = 'B' THEN 'SUM(D' || CAST(k AS VARCHAR) || ')' END AS formula FROM o),
b AS (SELECT CASE WHEN k % 101 = 0 THEN 'Z' || ref ELSE ref END AS ref,
 CASE WHEN ref LIKE 'B%' AND k % 97 = 0 THEN value || '1' ELSE value END AS value,
 CASE WHEN ref LIKE 'B%' AND k % 89 = 0 THEN NULL WHEN ref LIKE 'B%' AND k % 83 = 0 THEN formula || '*2' ELSE formula END AS formula FROM a),
d AS (SELECT coalesce(a.ref, b.ref) AS ref, a.ref IS NOT NULL AS i, b.ref IS NOT NULL AS j, a.value AS v, b.value AS w, a.formula AS f, b.formula AS g FROM a FULL JOIN b ON a.ref = b.ref)"""


@query(f"WITH {_CELLS} SELECT ref, value, formula FROM a")
def cells_unpivot(spark, sf_dir):
    return _order_cells(table(spark, sf_dir, "orders")).select("ref", "value", "formula")


def _category(name):
    def run(spark, sf_dir):
        return compare.cells(*_versions(spark, sf_dir)).where(F.col("category") == name).select("ref", "old", "new")

    run.__name__ = f"version_diff_{name}"
    return run


for _name, _where, _old, _new in (
    ("value_changed", "i AND j AND v IS DISTINCT FROM w", "v", "w"),
    ("formula_to_constant", "i AND j AND f IS NOT NULL AND g IS NULL AND w IS NOT NULL", "f", "w"),
    ("formula_changed", "i AND j AND f IS DISTINCT FROM g AND NOT (f IS NOT NULL AND g IS NULL AND w IS NOT NULL)", "f", "g"),
    ("cell_added", "NOT i", "v", "w"),
    ("cell_removed", "NOT j", "v", "w"),
):
    query(f"WITH {_CELLS} SELECT ref, {_old} AS old, {_new} AS new FROM d WHERE {_where}")(_category(_name))


def _sided(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    return facts(df, kind, **columns).withColumn("pair_id", F.lit("p"))


@query("WITH o AS (SELECT DISTINCT 'http://h/' || CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS t FROM lineitem WHERE l_linenumber <= 3), n AS (SELECT DISTINCT 'http://h/' || CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS t FROM lineitem WHERE l_linenumber > 3) SELECT 'link_added' AS category, t AS target FROM (SELECT t FROM n EXCEPT SELECT t FROM o) UNION ALL SELECT 'link_removed', t FROM (SELECT t FROM o EXCEPT SELECT t FROM n)")
def new_links_anti(spark, sf_dir):
    """All line items as links: the first three lines of an order are the version sent, the others the one returned."""
    target = F.concat(F.lit("http://h/"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string"))
    side = F.when(F.col("l_linenumber") <= 3, "old").otherwise("new")
    lines = facts(table(spark, sf_dir, "lineitem"), "link", value=target, path=side).select("*", F.lit("p").alias("pair_id"), F.col("path").alias("side"))
    old, new = (lines.where(F.col("side") == s).drop("side") for s in ("old", "new"))
    return compare.links(old, new).select("category", F.coalesce("old", "new").alias("target"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS ref, c_name AS old, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN upper(c_name) || '!' ELSE c_name END AS new FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 5 = 0 UNION ALL SELECT 'x' || CAST(c_custkey AS VARCHAR), NULL, c_mktsegment FROM customer")
def metadata_diff(spark, sf_dir):
    """All customers as properties: some lose their value, some get another, and every one gains a second property."""
    k, name = F.col("c_custkey"), F.col("c_name")
    customers = table(spark, sf_dir, "customer")
    old = _sided(customers, "prop", name=k, value=name)
    new = _sided(customers, "prop", name=k, value=F.when(k % 11 == 0, F.lit(None)).when(k % 5 == 0, F.concat(F.upper(name), F.lit("!"))).otherwise(name))
    more = _sided(customers, "prop", name=F.concat(F.lit("x"), k.cast("string")), value=F.col("c_mktsegment"))
    return compare.metadata(old, new.unionByName(more)).select("ref", "old", "new")


@query("SELECT p_name AS sheet, CASE WHEN p_size % 2 = 0 THEN 'sheet_hidden' ELSE 'sheet_shown' END AS category, count(*) AS n FROM (SELECT p_partkey || ':' || p_name AS p_name, p_size FROM part WHERE p_size % 3 <> 0) GROUP BY ALL")
def sheets_hidden_or_shown(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("s", F.concat(F.col("p_partkey").cast("string"), F.lit(":"), "p_name"))
    even, same = F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    state = lambda hidden: F.when(hidden, "hidden").otherwise("visible")
    old = _sided(part, "sheet", sheet=F.col("s"), value=state(~even))
    new = _sided(part, "sheet", sheet=F.col("s"), value=F.when(same, state(~even)).otherwise(state(even)))
    return compare.sheets(old, new).groupBy("sheet", "category").agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT n_name AS s, unnest(range(n_nationkey + 1, n_nationkey + 4)) AS i FROM nation), n AS (SELECT n_name AS s, unnest(range(n_nationkey + 2, n_nationkey + 6)) AS i FROM nation) SELECT 'row_hidden' AS category, s AS sheet, CAST(i AS VARCHAR) AS ref FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'row_shown', s, CAST(i AS VARCHAR) FROM (SELECT * FROM o EXCEPT SELECT * FROM n)")
def hidden_axes_diff(spark, sf_dir):
    nation, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    old = _sided(nation, "hidden_row", sheet=F.col("n_name"), row=k + 1, col=k + 3)
    new = _sided(nation, "hidden_row", sheet=F.col("n_name"), row=k + 2, col=k + 5)
    found = compare.hidden_ranges(compare.both(old, new))
    return found.select(F.when(F.col("in_new"), "row_hidden").otherwise("row_shown").alias("category"), "sheet", F.explode(F.transform(F.sequence("lo", "hi"), lambda i: i.cast("string"))).alias("ref"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS pair_id, c_name AS saved_by_old, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE 'x' END AS saved_by_new, c_custkey % 5 IN (0, 1) AND c_custkey % 2 = 0 AS same_windows_user_hint,
 CASE c_custkey % 5 WHEN 0 THEN 'C:\\Users\\' || c_name || '\\Docs' WHEN 1 THEN 'C:\\Users\\' || c_name || '\\OneDrive\\Obras' WHEN 2 THEN '\\\\servidor\\' || c_name WHEN 3 THEN 'D:\\Obras\\' || c_name ELSE 'https://d.docs.live.net/' || c_name END AS folder_old,
 CASE c_custkey % 5 WHEN 0 THEN 'C:\\Users\\' || w || '\\Docs' WHEN 1 THEN 'C:\\Users\\' || w || '\\OneDrive\\Obras' WHEN 2 THEN '\\\\servidor\\' || w WHEN 3 THEN 'D:\\Obras\\' || w ELSE 'https://d.docs.live.net/' || w END AS folder_new
 FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE 'x' END AS w FROM customer)""")
def provenance_hint(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    customers = table(spark, sf_dir, "customer")
    other = F.when(k % 2 == 0, F.upper(name)).otherwise("x")
    props = None
    for side, who in (("old", name), ("new", other)):
        for prop, value in (("lastModifiedBy", who), ("save_folder", _folder(k, who))):
            one = facts(customers, "prop", path=F.concat(F.lit(side), k.cast("string")), name=F.lit(prop), value=value)
            props = one if props is None else props.unionByName(one)
    pairs = customers.select(k.cast("string").alias("pair_id"), F.concat(F.lit("old"), k.cast("string")).alias("old_path"), F.concat(F.lit("new"), k.cast("string")).alias("new_path"))
    return compare.provenance(props, pairs).select("pair_id", "saved_by_old", "saved_by_new", "folder_old", "folder_new", "same_windows_user_hint")


# ---------------------------------------------------------------- rows, formulas and sheets that moved

#: Of the rows k of a sheet: one is inserted after k % 1000 = 500, k % 1500 = 700 go, k % 5000 = 123 move to the end.
_SHEET_ROWS = 100_000


def _before(k: str, each: int, rest: int) -> str:
    """How many j < k there are with j % each = rest, as SQL that both engines read."""
    return f"CAST(floor(({k} + {each - 1 - rest}) / {each}) AS BIGINT)"


def _shift(k: str) -> str:
    return f"({_before(k, 1000, 500)} - {_before(k, 1500, 700)} - {_before(k, 5000, 123)})"


_ORDER_ROWS = f"""SELECT *, CASE WHEN k % 5000 = 123 THEN n + {_shift("n")} + 1 + {_before("k", 5000, 123)} WHEN k % 1500 = 700 THEN NULL ELSE k + 1 + {_shift("k")} END AS new_row
FROM (SELECT concat('Pedidos ', CAST(CAST(floor(o_orderkey / {_SHEET_ROWS}) AS BIGINT) AS STRING)) AS sheet, o_orderkey % {_SHEET_ROWS} AS k, count(*) OVER (PARTITION BY floor(o_orderkey / {_SHEET_ROWS})) AS n, o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS price, o_orderpriority FROM orders)"""


@query(f"""WITH r AS ({_ORDER_ROWS.replace("STRING", "VARCHAR")})
SELECT 'row_added' AS category, sheet, CAST(new_row + 1 AS VARCHAR) AS ref, NULL AS old, NULL AS new FROM r WHERE k % 1000 = 500
UNION ALL SELECT 'row_removed', sheet, CAST(k + 1 AS VARCHAR), NULL, NULL FROM r WHERE new_row IS NULL
UNION ALL SELECT 'row_moved', sheet, CAST(new_row AS VARCHAR), CAST(k + 1 AS VARCHAR), CAST(new_row AS VARCHAR) FROM r WHERE k % 5000 = 123
UNION ALL SELECT 'value_changed', sheet, 'B' || CAST(new_row AS VARCHAR), price, price || '1' FROM r WHERE k % 777 = 5 AND new_row IS NOT NULL""")
def rows_inserted_and_moved(spark, sf_dir):
    """Orders as sheets, and as they came back with rows inserted, removed and moved; formulas follow their rows, so they are no change."""
    rows = spark.sql(_ORDER_ROWS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))

    def cells_of(row: str, price: str) -> DataFrame:
        at = f"CAST({row} AS STRING)"
        each = [("A", 1, "concat('pedido ', o_orderkey)", "NULL"), ("B", 2, price, "NULL"), ("C", 3, "o_orderpriority", "NULL"), ("D", 4, "IF(k % 10 = 0, '0', NULL)", f"IF(k % 10 = 0, concat('B', {at}, '*2'), NULL)"), ("E", 5, "IF(k % 100 = 0, '0', NULL)", f"IF(k % 100 = 0, concat('SUM(B1:B', {at}, ')'), NULL)")]
        made = ", ".join(f"named_struct('ref', concat('{c}', {at}), 'row', {row}, 'col', {n}, 'value', {v}, 'formula', {f})" for c, n, v, f in each)
        return rows.where(f"{row} IS NOT NULL").selectExpr("sheet", f"inline(array({made}))").where("value IS NOT NULL")

    old = cells_of("k + 1", "price")
    new = cells_of("new_row", "IF(k % 777 = 5, concat(price, '1'), price)")
    more = rows.where("k % 1000 = 500").selectExpr("sheet", "concat('A', new_row + 1) AS ref", "new_row + 1 AS row", "1 AS col", "concat('novo ', k) AS value", "CAST(NULL AS STRING) AS formula")
    of = lambda df, path: facts(df, "cell", path=F.lit(path), **{c: F.col(c) for c in ("sheet", "ref", "row", "col", "value", "formula")})
    found = compare.changes(of(old, "old").unionByName(of(new.unionByName(more), "new")), compare.pairs(spark, ("old", "new")))
    return found.select("category", "sheet", "ref", "old", "new")


@query('''SELECT o_orderkey, 'R[1]C[' || CAST(2 - c AS VARCHAR) || ']*R1C3+''Plano B2''!R[0]C[' || CAST(4 - c AS VARCHAR) || ']&"A1 ""B2"""&LOG10(R[0]C[' || CAST(1 - c AS VARCHAR) || '])+R[' || CAST(9 - r AS VARCHAR) || ']C28' AS form, true AS filled_equal
FROM (SELECT o_orderkey, o_orderkey % 700 + 1 AS c, o_orderkey % 100000 + 1 AS r FROM orders)''')
def formulas_in_relative_form(spark, sf_dir):
    """Formulas with quoted sheets and texts, fixed parts and function names; the same formula filled two rows down has the same form."""
    r, k = F.col("r"), F.col("o_orderkey")
    at = lambda n: n.cast("string")
    filled = lambda row, last: F.concat(F.lit("B"), at(row + 1), F.lit("*$C$1+'Plano B2'!D"), at(row), F.lit('&"A1 ""B2"""&LOG10(A'), at(row), F.lit(")+$AB"), last)
    df = table(spark, sf_dir, "orders").select("o_orderkey", (k % 700 + 1).cast("int").alias("c"), (k % 100000 + 1).cast("int").alias("r"))
    df = df.select("o_orderkey", "c", "r", (r + 2).alias("r2"), filled(r, F.lit("9")).alias("f"), filled(r + 2, F.lit("11")).alias("f2"))
    form = formulas.relative("f", "r", "c")
    return df.select("o_orderkey", form.alias("form"), (form == formulas.relative("f2", "r2", "c")).alias("filled_equal"))


@query("SELECT DISTINCT n_name AS old_sheet, n_name || ' (rev)' AS new_sheet FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 0")
def sheets_renamed(spark, sf_dir):
    """Customers as a sheet for each nation; a third of the sheets came back under another name, with some balances changed."""
    held = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    renamed = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit(" (rev)"))).otherwise(F.col("n_name"))
    both = None
    for side, name in (("old", F.col("n_name")), ("new", renamed)):
        balance = money("c_acctbal") if side == "old" else F.when(F.col("c_custkey") % 4 == 0, F.lit("0.00")).otherwise(money("c_acctbal"))
        one = facts(held, "cell", sheet=name, row=F.col("c_custkey"), col=F.lit(1), value=F.concat("c_name", F.lit(" "), F.col("c_custkey").cast("string")))
        one = one.unionByName(facts(held, "cell", sheet=name, row=F.col("c_custkey"), col=F.lit(2), value=balance)).unionByName(facts(held.select(name.alias("s")).distinct(), "sheet", sheet=F.col("s")))
        one = one.select("*", F.lit("p").alias("pair_id"), F.lit(side).alias("side"))
        both = one if both is None else both.unionByName(one)
    return sheets.matched_sheets(both.withColumn("form", formulas.relative())).select("old_sheet", "new_sheet")


# ---------------------------------------------------------------- joins by place and time


@query(f"""WITH c AS (SELECT c_custkey, c_custkey % 7 AS b, CAST(floor(c_custkey / 7) AS BIGINT) + 1 AS r, c_custkey % 3 + 1 AS col, raw FROM customer JOIN ({_CPF_TEXT}) USING (c_custkey))
SELECT 'book' || CAST(b AS VARCHAR) AS path, chr(CAST(64 + col AS INT)) || CAST(r AS VARCHAR) AS ref, raw, CASE WHEN b = 6 THEN 'sheet' WHEN EXISTS (SELECT 1 FROM c h WHERE h.b = c.b AND h.r % 10 = 1 AND c.r BETWEEN h.r AND h.r + 2) THEN 'row' WHEN b % 2 = 0 AND col >= 3 THEN 'column' END AS hidden FROM c""")
def identifiers_in_hidden_places(spark, sf_dir):
    """CPFs in cells, joined with the ranges of rows and columns that are hidden; ranges are never written out."""
    numbers = _check_digits(spark, sf_dir, 9, ids.CPF_WEIGHTS)
    k, n = F.col("c_custkey"), F.col("number")
    shaped = F.concat(F.left(n, F.lit(3)), F.lit("."), F.substring(n, 4, 3), F.lit("."), F.substring(n, 7, 3), F.lit("-"), F.substring(n, 10, 2))
    cells = numbers.select(k, F.concat(F.lit("book"), (k % 7).cast("string")).alias("p"), (F.floor(k / 7) + 1).alias("r"), (k % 3 + 1).alias("c"), shaped.alias("v"))
    told = facts(cells, "cell", path=F.col("p"), sheet=F.lit("S"), ref=F.concat(F.char(64 + F.col("c")), F.col("r").cast("string")), row=F.col("r"), col=F.col("c"), type=F.lit("s"), value=F.col("v"))
    hidden = facts(cells.where("r % 10 = 1"), "hidden_row", path=F.col("p"), sheet=F.lit("S"), row=F.col("r"), col=F.col("r") + 2)
    hidden = hidden.unionByName(facts(cells.where("c_custkey % 7 % 2 = 0"), "hidden_col", path=F.col("p"), sheet=F.lit("S"), row=F.lit(3), col=F.lit(16384)))
    hidden = hidden.unionByName(facts(cells.where("p = 'book6'"), "sheet", path=F.col("p"), sheet=F.lit("S"), value=F.lit("hidden")))
    found = findings.classify(findings.detect(told, "cell")).where("kind = 'cpf'")
    return findings.with_places(found, hidden).select("path", "ref", "raw", "hidden")


_SAVES = """WITH o AS (SELECT o_orderkey, o_custkey % 100 AS k, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey % 20160) AS at FROM orders), e AS (SELECT user_id % 100 AS k, ts, event_id, event_type FROM events)
SELECT o_orderkey, {0} AS event_id, {1} AS event_type FROM o ASOF LEFT JOIN e ON o.k = e.k AND o.at >= e.ts"""


def _last_saves(spark, sf_dir, **options) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k, (F.col("o_custkey") % 100).alias("k"), (F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + k % 20160 * 60_000_000).alias("at"))
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    return asof(orders, events, ["k"], "at", ["event_id", "event_type"], **options).select("o_orderkey", "event_id", "event_type")


@query(_SAVES.format("event_id", "event_type"))
def last_save_before(spark, sf_dir):
    """For each order the last event of its user at or before it; users are cut into days."""
    return _last_saves(spark, sf_dir, width=86_400_000_000)


@query(_SAVES.format("CASE WHEN o.at - e.ts <= INTERVAL 20 MINUTE THEN event_id END", "CASE WHEN o.at - e.ts <= INTERVAL 20 MINUTE THEN event_type END"))
def last_save_within(spark, sf_dir):
    """The same, if it is not older than twenty minutes: one shuffle, since a stretch is handed to the next whole."""
    return _last_saves(spark, sf_dir, width=3_600_000_000, tolerance=1_200_000_000)


# ---------------------------------------------------------------- streams

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
_FAR = "TIMESTAMP '2100-01-01 00:00:00'"


def _arrivals(spark, sf_dir, rows: DataFrame, parts: list, last: str, files: int = 1) -> str:
    """A folder to which ``rows`` have come, a part after the other in ``files`` files each, and then one row that moves the clock on."""
    folder = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex[:12]}"
    for part in parts:
        come = rows.where(part)
        (come.coalesce(1) if files == 1 else come.repartition(files)).write.mode("append").parquet(folder)
    spark.sql(last).write.mode("append").parquet(folder)
    return folder


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _event_files(spark, sf_dir, hold_back: str) -> str:
    """Events in four files by quarters of their time, then those held back."""
    rows = _events(spark, sf_dir)
    quarters = rows.where(f"NOT ({hold_back})").agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("z")).first()
    at = [quarters.a + (quarters.z - quarters.a) * i // 4 for i in range(5)]
    parts = [(F.unix_micros("ts") >= at[i]) & (F.unix_micros("ts") < at[i + 1] + (i == 3)) & ~F.expr(hold_back) for i in range(4)]
    return _arrivals(spark, sf_dir, rows, [*parts, F.expr(hold_back)], f"SELECT -1L AS event_id, {_FAR} AS ts, -1L AS user_id, 'end' AS event_type, 0D AS value")


def _told(spark, folder: str, made, delay: str) -> DataFrame:
    """What windows over the files of ``folder`` tell, one file a micro-batch."""
    out = f"{folder}-told"
    query_ = events.run_windows(events.stream(spark, folder, _EVENTS), made, delay, out, f"{folder}-state")
    query_.awaitTermination()
    return spark.read.parquet(out)


_AT = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
_HELD = "event_id % 97 = 0"
#: The windows that the fourth file's batch had closed: those behind the first three.
_WINDOWS_SQL = """WITH q AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM events WHERE event_id % 97 > 0),
m AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events, q WHERE event_id % 97 > 0 AND epoch_us(ts) < a + (z - a) * 3 // 4),
e AS (SELECT *, unnest({starts}) AS start FROM events), w AS (SELECT *, event_id % 97 = 0 AND start + INTERVAL {length} <= date_trunc('millisecond', mark) AS late FROM e, m)"""
_STARTS = "[time_bucket(INTERVAL 1 HOUR, ts)]"
_SLIDES = "[time_bucket(INTERVAL 2 HOUR, ts) - to_hours(2 * i) FOR i IN range(3)]"
_WINDOW_ROWS = "SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM w WHERE NOT late GROUP BY ALL"


@query(f"{_WINDOWS_SQL.format(starts=_STARTS, length='1 HOUR')} {_WINDOW_ROWS}")
def event_windows_tumbling(spark, sf_dir):
    """Hourly windows over a stream in six micro-batches; rows that come after their window has closed are not in it."""
    told = _told(spark, _event_files(spark, sf_dir, _HELD), lambda e: events.windows(e, "1 hour"), "2 hours")
    return told.select("event_type", _AT("start").alias("start"), "n", "total")


@query(f"{_WINDOWS_SQL.format(starts=_SLIDES, length='6 HOUR')} {_WINDOW_ROWS}")
def event_windows_sliding(spark, sf_dir):
    told = _told(spark, _event_files(spark, sf_dir, _HELD), lambda e: events.windows(e, "6 hours", "2 hours"), "2 hours")
    return told.select("event_type", _AT("start").alias("start"), "n", "total")


@query("""WITH s AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM g GROUP BY user_id, g""")
def event_sessions(spark, sf_dir):
    """Sessions of users over the same stream, none held back: each ends half an hour after its last event."""
    told = _told(spark, _event_files(spark, sf_dir, "event_id < 0"), lambda e: events.sessions(e, "30 minutes"), "1 hour")
    return told.select("user_id", _AT("start").alias("start"), _AT("end").alias("end"), "n", "total")


@query(f"{_WINDOWS_SQL.format(starts=_STARTS, length='1 HOUR')} SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n_late FROM w WHERE late GROUP BY ALL")
def event_rows_too_late(spark, sf_dir):
    """Rows that came after their hour had closed, counted apart by the hour that they would have been in."""
    folder = _event_files(spark, sf_dir, _HELD)
    events.run_late(events.stream(spark, folder, _EVENTS), "1 hour", 7200, f"{folder}-late", f"{folder}-marks").awaitTermination()
    late = spark.read.schema("batch long, event_type string, start timestamp, n_late long").parquet(f"{folder}-late/late")
    return late.groupBy("event_type", "start").agg(F.sum("n_late").alias("n_late")).select("event_type", _AT("start").alias("start"), "n_late")


_RETURNED = "o_orderkey % 11 > 0"


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN NOT ({_RETURNED}) THEN 'never_returned' WHEN o_orderkey % 13 = 5 THEN 'never_sent' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS outcome,
CASE WHEN NOT ({_RETURNED}) OR o_orderkey % 13 <> 5 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS old, CASE WHEN {_RETURNED} THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || CASE WHEN o_orderkey % 7 = 0 THEN '1' ELSE '' END END AS new FROM orders""")
def versions_returned(spark, sf_dir):
    """Orders sent and returned on one stream; the query stops after three arrivals and goes on from its checkpoint."""
    k = F.col("o_orderkey")
    at = lambda seconds: F.timestamp_seconds(F.lit(1_704_067_200) + k % 3600 + seconds)
    orders = table(spark, sf_dir, "orders")
    sent = orders.where(f"NOT ({_RETURNED}) OR o_orderkey % 13 <> 5").select(k.cast("string").alias("key"), F.lit("sent").alias("side"), at(0).alias("time"), money("o_totalprice").alias("value"), (k % 2).alias("part"))
    back = orders.where(_RETURNED).select(k.cast("string").alias("key"), F.lit("returned").alias("side"), at(3600).alias("time"), F.concat(money("o_totalprice"), F.when(k % 7 == 0, "1").otherwise("")).alias("value"), (k % 2 + 1).alias("part"))
    rows = sent.unionByName(back)
    files = 4 * spark.sparkContext.defaultParallelism
    folder = _arrivals(spark, sf_dir, rows, [F.col("part") == i for i in range(3)], f"SELECT CAST(NULL AS STRING) AS key, 'sent' AS side, {_FAR} AS time, '' AS value, 9L AS part LIMIT 0", files)
    out, state = f"{folder}-told", f"{folder}-state"
    source = lambda name: events.stream(spark, name, "key string, side string, time timestamp, value string, part long", files_per_trigger=files)

    def go() -> None:
        setting, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            told = returns.returned(source(folder), patience=86_400)
            told.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(setting, before) if before else spark.conf.unset(setting)

    go()
    spark.sql(f"SELECT 'end' AS key, 'sent' AS side, {_FAR} AS time, '' AS value, 9L AS part").write.mode("append").parquet(folder)
    go()  # a new query over the same checkpoint: what was told is not told again
    return spark.read.parquet(out).where("key <> 'end'").select("key", "outcome", "old", "new")


# ---------------------------------------------------------------- detectors over given tables

_KINDS = ("creator", "company", "lastModifiedBy", "title")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS sheet, CAST(unnest(range(p_size, p_size + p_partkey % 4)) AS VARCHAR) AS ref FROM part WHERE p_partkey % 4 > 0")
def hidden_rows_found(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_partkey % 4 > 0")
    held = facts(parts, "hidden_row", path=F.col("p_partkey"), sheet=F.col("p_name"), row=F.col("p_size"), col=F.col("p_size") + F.col("p_partkey") % 4 - 1)
    return findings.detect(held, "hidden_row").select("path", "sheet", "ref")


def _metadata(spark, sf_dir) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return facts(table(spark, sf_dir, "customer"), "prop", path=F.concat(F.lit("c"), F.col("c_custkey").cast("string")), name=name, value=F.col("c_name"))


_METADATA_SQL = "SELECT 'c' || CAST(c_custkey AS VARCHAR) AS path, CASE c_custkey % 4 WHEN 0 THEN 'metadata_author' WHEN 1 THEN 'metadata_company' ELSE 'metadata_last_editor' END AS kind, c_name AS raw FROM customer WHERE c_custkey % 4 < 3"


@query(f"SELECT path, kind, 'baixo' AS severity, {_MASK.format('raw')} AS masked FROM ({_METADATA_SQL})")
def metadata_findings(spark, sf_dir):
    """Authors, companies and last editors; other properties are no findings."""
    return reveal(findings.findings(_metadata(spark, sf_dir))).select("path", "kind", "severity", "masked")


def _links(spark, sf_dir) -> DataFrame:
    return facts(table(spark, sf_dir, "pages"), "link", path=F.concat(F.lit("p"), F.col("page_id").cast("string")), name=F.lit("xl/_rels/workbook.xml.rels"), value=F.col("url"))


_LINKS_SQL = "SELECT 'p' || CAST(page_id AS VARCHAR) AS path, 'external_link' AS kind, url AS raw FROM pages"


@query(f"SELECT path, kind, raw, 'xl/_rels/workbook.xml.rels' AS ref, 'medio' AS severity FROM ({_LINKS_SQL})")
def link_findings(spark, sf_dir):
    """Addresses of pages as external links: told, never opened."""
    return findings.findings(_links(spark, sf_dir)).select("path", "kind", "raw", "ref", "severity")


_NOTES_SQL = "SELECT 'n' || CAST(page_id AS VARCHAR) AS path, 'comment' AS kind, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS raw FROM pages"
_SHEETS_SQL = "SELECT 's' || CAST(p_partkey AS VARCHAR) AS path, 'hidden_sheet' AS kind, p_name AS raw FROM part WHERE p_size % 2 = 0"
_CELLS_SQL = f"SELECT 'i' || CAST(c_custkey AS VARCHAR) AS path, 'cpf' AS kind, raw FROM ({_CPF_TEXT})"
_EXPLAINED = {"hidden_sheet": "Aba oculta: o conteúdo segue no arquivo e pode ser reexibido.", "comment": "Comentário ou nota que o destinatário pode ler.", "metadata_author": "Autor gravado nos metadados do arquivo.", "metadata_company": "Empresa gravada nos metadados do arquivo.", "metadata_last_editor": "Último editor gravado no arquivo; o nome pode ser alterado.", "external_link": "Vínculo externo registrado; não foi aberto.", "cpf": "CPF com dígitos verificadores válidos em célula."}


def _everything(spark, sf_dir) -> DataFrame:
    """Facts of six kinds from four tables, as a scan of many files gives them."""
    pages, part = table(spark, sf_dir, "pages"), table(spark, sf_dir, "part")
    notes = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<!--(.*?)-->"), F.lit(1))).alias("text"))
    n = F.col("number")
    shaped = F.concat(F.left(n, F.lit(3)), F.lit("."), F.substring(n, 4, 3), F.lit("."), F.substring(n, 7, 3), F.lit("-"), F.substring(n, 10, 2))
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    out = _metadata(spark, sf_dir).unionByName(_links(spark, sf_dir))
    out = out.unionByName(facts(notes, "comment", path=named("n", "page_id"), value=F.col("text")))
    out = out.unionByName(facts(part, "sheet", path=named("s", "p_partkey"), sheet=F.col("p_name"), value=F.when(F.col("p_size") % 2 == 0, "veryHidden").otherwise("visible")))
    return out.unionByName(facts(_check_digits(spark, sf_dir, 9, ids.CPF_WEIGHTS), "cell", path=named("i", "c_custkey"), ref=F.lit("A1"), type=F.lit("s"), value=shaped))


_ALL_SQL = " UNION ALL ".join((_METADATA_SQL, _LINKS_SQL, _NOTES_SQL, _SHEETS_SQL, _CELLS_SQL))


@query(f"SELECT path, kind, raw FROM ({_ALL_SQL})")
def all_findings_in_one_place(spark, sf_dir):
    """Findings of every kind from one pass over the facts."""
    return findings.findings(_everything(spark, sf_dir)).where("kind <> 'pis'").select("path", "kind", "raw")


@query(f"SELECT path, kind, CASE kind {' '.join(f"WHEN '{k}' THEN '{e}'" for k, e in _EXPLAINED.items())} END AS explanation FROM ({_ALL_SQL})")
def findings_explained(spark, sf_dir):
    return findings.findings(_everything(spark, sf_dir)).where("kind <> 'pis'").select("path", "kind", "explanation")


# ---------------------------------------------------------------- sketches, nested properties


@query("SELECT l_returnflag AS flag, CAST(count(*) AS BIGINT) AS n, true AS distinct_near, true AS median_near, true AS steps_near FROM lineitem GROUP BY ALL")
def sketches_rolled_up(spark, sf_dir):
    """Sketches of line items by supplier and flag, rolled up to flags in one step and in two; both are held against exact counts."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("file"), (F.col("l_suppkey") % 7).alias("part"), money("l_extendedprice").alias("value"))
    kept = written(sketches.profile(lines, ["flag", "part", "file"]), "profiles")
    once = sketches.rollup(kept, ["flag"])
    twice = sketches.estimates(sketches.rollup(sketches.rollup(kept, ["flag", "part"]), ["flag"]), 0.5).select("flag", F.col("n").alias("n2"), F.col("n_distinct").alias("d2"))
    number = F.col("value").cast("double")
    exact = lines.groupBy("flag").agg(F.countDistinct("value").alias("d"))
    told = sketches.estimates(once, 0.5).join(exact, "flag").join(twice, "flag")
    # the rank that the told median really has
    below = lines.join(F.broadcast(told.select("flag", "q_50")), "flag").groupBy("flag").agg(F.avg((number < F.col("q_50")).cast("int")).alias("lo"), F.avg((number <= F.col("q_50")).cast("int")).alias("hi"))
    near = lambda d: F.abs(F.col(d) - F.col("d")) <= sketches.ERROR_DISTINCT * F.col("d")
    rank = (F.col("lo") <= 0.5 + sketches.ERROR_RANK) & (F.col("hi") >= 0.5 - sketches.ERROR_RANK)
    return told.join(below, "flag").select("flag", "n", near("n_distinct").alias("distinct_near"), rank.alias("median_near"), (near("d2") & (F.col("n") == F.col("n2"))).alias("steps_near"))


@query("""SELECT event_id, category, path, old, new FROM (SELECT event_id, unnest(list_filter([
 CASE WHEN event_id % 3 = 0 THEN {'category': 'prop_added', 'path': '$.extra.deep[1].x', 'old': NULL, 'new': CAST(k AS VARCHAR)} END, CASE WHEN event_id % 3 = 0 THEN {'category': 'prop_added', 'path': '$.extra.deep[0]', 'old': NULL, 'new': event_type} END,
 CASE WHEN event_id % 5 = 0 THEN {'category': 'prop_lost', 'path': '$.meta.user', 'old': CAST(user_id AS VARCHAR), 'new': NULL} END, CASE WHEN event_id % 7 = 0 THEN {'category': 'prop_retyped', 'path': '$.k', 'old': 'BIGINT ' || CAST(k AS VARCHAR), 'new': 'STRING ' || CAST(k AS VARCHAR)} END,
 CASE WHEN event_id % 11 = 0 THEN {'category': 'prop_changed', 'path': '$.meta["the type"]', 'old': event_type, 'new': event_type || '!'} END], lambda x: x IS NOT NULL), recursive := true)
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))""")
def nested_metadata_diff(spark, sf_dir):
    """Events' properties, nested under others; some came back with paths added, lost, of another type or value."""
    events_ = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    i = F.col("event_id")
    meta = lambda user, kind: F.struct(user.alias("user"), kind.alias("the type"))
    user, kind = F.col("user_id"), F.col("event_type")
    old = events_.select("event_id", F.to_json(F.struct("k", meta(user, kind).alias("meta"))).alias("props"))
    extra = F.when(i % 3 == 0, F.concat(F.lit(',"extra":{"deep":["'), kind, F.lit('",{"x":'), F.col("k").cast("string"), F.lit("}]}"))).otherwise("")
    number = F.when(i % 7 == 0, F.concat(F.lit('"'), F.col("k").cast("string"), F.lit('"'))).otherwise(F.col("k").cast("string"))
    changed = F.to_json(meta(F.when(i % 5 != 0, user), F.when(i % 11 == 0, F.concat(kind, F.lit("!"))).otherwise(kind)))
    new = events_.select("event_id", F.concat(F.lit('{"meta":'), changed, F.lit(',"k":'), number, extra, F.lit("}")).alias("props"))
    return nested.differences(old, new, ["event_id"], "props")


# ---------------------------------------------------------------- golden workbooks


def _golden_folder(spark: SparkSession) -> str:
    """The golden workbooks, written to the folder that the cluster shares."""
    folder = f"{shared_folder(spark)}/golden-{uuid.uuid4().hex[:12]}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    for name, data in golden().items():
        with fs.open_output_stream(f"{path}/{name}", compression=None) as stream:
            stream.write(data)
    return folder


@query("""SELECT * FROM (VALUES ('full.xlsm', 'bank_account', 1), ('full.xlsm', 'cnpj', 1), ('full.xlsm', 'comment', 1), ('full.xlsm', 'cpf', 2), ('full.xlsm', 'external_link', 2), ('full.xlsm', 'hidden_column', 2),
 ('full.xlsm', 'hidden_row', 1), ('full.xlsm', 'hidden_sheet', 2), ('full.xlsm', 'macro', 1), ('full.xlsm', 'metadata_author', 1), ('full.xlsm', 'metadata_company', 1), ('full.xlsm', 'metadata_last_editor', 1), ('full.xlsm', 'save_folder', 1),
 ('returned.xlsx', 'external_link', 1), ('returned.xlsx', 'hidden_row', 1), ('returned.xlsx', 'hidden_sheet', 1), ('returned.xlsx', 'metadata_last_editor', 1), ('returned.xlsx', 'save_folder', 1),
 ('sent.xlsx', 'metadata_last_editor', 1), ('sent.xlsx', 'save_folder', 1)) t(file, kind, n)""")
def workbook_golden(spark, sf_dir):
    found = api.scan(spark, _golden_folder(spark))
    return found.groupBy(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "kind").agg(F.count("*").cast("int").alias("n"))


@query("""SELECT * FROM (VALUES ('value_changed', 'Boletim', 'B1', '100', '150'), ('value_changed', 'Boletim', 'B2', '200', '300'), ('formula_to_constant', 'Boletim', 'B2', 'B1*2', '300'), ('row_hidden', 'Boletim', '2', NULL, NULL),
 ('sheet_hidden', 'Base', NULL, 'visible', 'hidden'), ('link_added', NULL, NULL, NULL, 'file:///C:\\tmp\\novo.xlsx'), ('metadata_changed', NULL, 'lastModifiedBy', 'Ana', 'Bruno'),
 ('metadata_changed', NULL, 'save_folder', 'C:\\Users\\ana\\obra\\', 'D:\\Users\\Ana\\')) t(category, sheet, ref, old, new)""")
def workbook_golden_changes(spark, sf_dir):
    folder = _golden_folder(spark)
    return api.compare(spark, [(f"{folder}/sent.xlsx", f"{folder}/returned.xlsx")], raw=True).select("category", "sheet", "ref", "old", "new")


@query("""SELECT * FROM (VALUES ('bank_account', 1), ('cnpj', 1), ('cpf', 2), ('hidden_column', 2), ('hidden_row', 1), ('metadata_last_editor', 1), ('save_folder', 1)) t(kind, n)""")
def workbook_golden_clean(spark, sf_dir):
    folder = _golden_folder(spark)
    api.clean(spark, f"{folder}/full.xlsm", f"{folder}/clean", drop_hidden_sheets=True, drop_macros=True)
    return api.scan(spark, f"{folder}/clean").groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query("""SELECT * FROM (VALUES ('clean.xlsx', 0, 0), ('full.xlsm', 9, 2), ('returned.xlsx', 4, 1), ('sent.xlsx', 2, 0)) t(file, n_left, n_hidden_sheets)""")
def command_line_clean(spark, sf_dir):
    """``--limpar`` on the golden folder: kinds of findings left in each copy, and hidden sheets, which stay unless asked for."""
    folder = _golden_folder(spark)
    files = workbook.read_files(spark, folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"))
    main([folder, "--limpar", f"{folder}-clean"], spark)
    named = api.scan(spark, f"{folder}-clean").select(F.regexp_replace(F.regexp_extract("path", "[^/]+$", 0), "-[0-9a-f]{8}[.]", ".").alias("file"), "kind", "ref", "sheet")
    gone = named.where(F.col("kind").isin("comment", "metadata_author", "metadata_company", "external_link")).count()
    left = named.groupBy("file").agg((F.countDistinct("kind") + gone).cast("int").alias("n_left"), F.count_if(F.col("kind") == "hidden_sheet").cast("int").alias("n_hidden_sheets"))
    return files.join(left, "file", "left").fillna(0)
