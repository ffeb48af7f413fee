"""Registered queries of the operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, codes, embed, langid, licenses, lm, media, minhash, packing, suffix, urls, warc
from .common import crc_bucket, scratch_path, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES["op10_bpe"] = op10_bpe


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bucket = crc_bucket(F.col("doc_id"), 4)
    model = langid.fit(docs.where(bucket != 2).select("text", "lang"))
    held = F.coalesce(bucket == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs, model, carry=(held,)).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES["op2_langid"] = op2_langid


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op3_minhash"] = op3_minhash


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    read = warc.read_warc(spark, folder, payloads=False)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op4_warc"] = op4_warc
ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digests(table(spark, sf_dir, "documents"))


QUERIES["op5_suffix"] = op5_suffix
ORACLES["op5_suffix"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
starts AS (SELECT r, b, unnest(range(1, n - {suffix.LENGTH - 2})) AS i FROM d WHERE n >= {suffix.LENGTH}),
win AS (SELECT r, i, md5_number(b[i:i + {suffix.LENGTH - 1}]) AS h FROM starts),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS k FROM win) WHERE k > 1),
step AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > {suffix.LENGTH}, true) AS new FROM hit),
run AS (SELECT r, i, sum(CAST(new AS BIGINT)) OVER (PARTITION BY r ORDER BY i) AS g FROM step),
span AS (SELECT r, min(i) AS a, max(i) + {suffix.LENGTH - 1} AS z FROM run GROUP BY r, g),
gone AS (SELECT r, count(*) AS n_spans, CAST(sum(z - a + 1) AS BIGINT) AS n_removed FROM span GROUP BY r),
edge AS (SELECT r, a, z FROM span UNION ALL SELECT r, n + 1, n FROM d),
piece AS (SELECT r, a, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM edge),
kept AS (SELECT r, sha256(unhex(string_agg(CASE WHEN t >= f THEN hex(b[f:t]) ELSE '' END, '' ORDER BY a))) AS kept_sha256 FROM piece JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)
"""


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_columns(table(spark, sf_dir, "documents"))
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth")


QUERIES["op7_media"] = op7_media


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = crc_bucket(F.col("doc_id"), 10)
    scored = lm.score(table(spark, sf_dir, "documents"), bucket != 0)
    held = F.coalesce(bucket == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES["op9_lm"] = op9_lm


def op1_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES["op1_embed"] = op1_embed


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES["op6_licenses"] = op6_licenses
ORACLES["op6_licenses"] = licenses.oracle()


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES["op8_packing"] = op8_packing


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES["op11_centroids"] = op11_centroids

#: The rules of ``op12_urls``: action, host, beginning of the path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES)


QUERIES["op12_urls"] = op12_urls


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES["op13_codes"] = op13_codes


# ---------------------------------------------------------------- SQL for the three queries of whole-number vectors and urls

_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
_BLOCKED = ", ".join(f"('{h}')" for h in urls.BLOCKED_HOSTS)
ORACLES["op12_urls"] = f"""
WITH t AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
rules(action, h, p) AS (VALUES {_RULES}),
blocked(h) AS (VALUES {_BLOCKED}),
fit AS (SELECT r, action, h || p AS rule, row_number() OVER (PARTITION BY r ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
bad AS (SELECT DISTINCT r FROM u JOIN blocked ON host = h OR ends_with(host, '.' || h))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bad.r IS NULL THEN 'allow' ELSE 'block' END) AS verdict, bad.r IS NOT NULL AS listed
FROM u LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (r) LEFT JOIN bad USING (r)
"""

_FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0"
_APART = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _centroid_sql(rounds: int = 3, k: int = 16) -> str:
    """The rounds, one after the other."""
    steps = [f"""
q AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND {_FINE}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), q) - 1 AS c, q AS m FROM q WHERE vec_id IS NOT NULL QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, CAST({_APART.format("q", "m")} AS BIGINT) AS d FROM q, c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM q JOIN a{i} USING (r)) GROUP BY ALL),
n{i} AS (SELECT c, list(CAST(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS BIGINT) ORDER BY i) AS m FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(n{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN n{i} USING (c))""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM q JOIN a{rounds} USING (r) JOIN c{rounds} USING (c)"""


ORACLES["op11_centroids"] = _centroid_sql()


def _code_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    steps = [f"""
q AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {_FINE}),
p AS (SELECT r, p, q[p * len(q) // {parts} + 1:(p + 1) * len(q) // {parts}] AS x FROM q, range({parts}) t(p)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id, q) - 1 AS e FROM q WHERE vec_id IS NOT NULL QUALIFY e < {entries}),
b0 AS (SELECT p, e, x AS m FROM p JOIN f USING (r))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p, e, CAST({_APART.format("x", "m")} AS BIGINT) AS d FROM p JOIN b{i} USING (p)) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p JOIN a{i} USING (r, p)) GROUP BY ALL),
n{i} AS (SELECT p, e, list(CAST(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS BIGINT) ORDER BY i) AS m FROM s{i} GROUP BY p, e),
b{i + 1} AS (SELECT p, e, coalesce(n{i}.m, b{i}.m) AS m FROM b{i} LEFT JOIN n{i} USING (p, e))""")
    return f"""WITH {",".join(steps)},
coded AS (SELECT r, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM q JOIN coded USING (r), book"""


ORACLES["op13_codes"] = _code_sql()


# ---------------------------------------------------------------- SQL for the two link queries

#: Smallest id reachable over ``link(a, b)`` from every row of ``v(id)``.
_COMPONENTS = """
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, place) AS (SELECT id, id FROM v UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.place = both_ways.a),
class AS (SELECT id, min(place) AS component_id FROM reach GROUP BY id)"""

ORACLES["op1_embed"] = f"""
WITH RECURSIVE e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
v AS (SELECT DISTINCT id FROM e WHERE id IS NOT NULL),
fine AS (SELECT id, label, x FROM e WHERE id IS NOT NULL AND label IS NOT NULL AND len(x) > 0
  AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS (SELECT p.id AS a, q.id AS b FROM fine p JOIN fine q ON p.label = q.label AND p.id < q.id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
{_COMPONENTS},
n AS (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT class.id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, class.id = component_id AS kept
FROM class LEFT JOIN n ON n.a = class.id
"""

ORACLES["op3_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {licenses.sql_words("coalesce(text, '')")} AS w FROM documents),
full_ AS (SELECT doc_id, CASE WHEN len(w) = 1 AND w[1] = '' THEN [] ELSE w END AS w FROM d),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM full_),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
v AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL),
{_COMPONENTS}
SELECT class.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, class.id = component_id AS kept
FROM class LEFT JOIN n ON n.doc_id = class.id
"""
