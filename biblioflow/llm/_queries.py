"""The queries op1 to op10 and pipeline, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, html_extract, language, mixing, quality, simhash, substring_dedup, url_filter, warc


def _read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    found = decontaminate.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.report(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup.dedup(_read(spark, sf_dir, "embeddings"))


def op3_html_extract(spark, sf_dir):
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(_read(spark, sf_dir, "documents")).drop("kept", "rest")


def op5_quality(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op6_mixing(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_language(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit(docs, ~held_out)
    guess = language.identify(docs, model)
    return docs.select("doc_id", held_out.alias("held_out"), guess.alias("x")).select("doc_id", "held_out", "x.lang_pred", "x.score")


def op8_url_filter(spark, sf_dir):
    return url_filter.judge(_read(spark, sf_dir, "pages")).drop("component")


def op9_warc(spark, sf_dir):
    return warc.round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash(spark, sf_dir):
    return simhash.dedup(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    import corpus_pipeline

    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"pipeline": corpus_pipeline.run}


OP1_SQL = r"""
WITH letters AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM letters, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(x) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM letters LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT s, min(doc_id) AS m FROM places GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM places JOIN least USING (s) WHERE doc_id > m),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
    sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id
"""


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN parts ON v.vec_id = parts.a LEFT JOIN counts ON v.vec_id = counts.a
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS r FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
a AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rn, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM c),
l AS (SELECT arg_min((budget - capped) / w_left, rn) AS level FROM a WHERE (budget - capped) / w_left * w < cap),
g AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM a, l),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY r, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT doc_id, r, size, turn, (upto + (turn - 1) * source_size)::DOUBLE / target AS t FROM q, (SELECT unnest([1, 2]) AS turn) WHERE size > 0),
u AS (SELECT *, sum(size) OVER (ORDER BY t, r, doc_id, turn ROWS UNBOUNDED PRECEDING) AS used FROM e),
k AS (SELECT doc_id, count(*) AS turns FROM u WHERE used <= (SELECT round(sum(target), 3) FROM g) GROUP BY 1)
SELECT q.doc_id, size, source_size, target, CAST(size * coalesce(turns, 0) AS BIGINT) AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""

# Rules as the operator has them. The pages of the tables state no aliases, so none are followed here.
OP8_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (SELECT DISTINCT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2)
SELECT page_id, u.host, u.path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN fit ON u.host = fit.host AND u.path = fit.path
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', c)]), '') AS bits, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * (substr(bits, 5 * i + 1, 1) = '1')::INT + 8 * (substr(bits, 5 * i + 2, 1) = '1')::INT + 4 * (substr(bits, 5 * i + 3, 1) = '1')::INT + 2 * (substr(bits, 5 * i + 4, 1) = '1')::INT + (substr(bits, 5 * i + 5, 1) = '1')::INT AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op2_embedding_dedup": OP2_SQL, "op8_url_filter": OP8_SQL, "op9_warc": OP9_SQL, "op1_decontaminate": OP1_SQL, "op4_substring_dedup": OP4_SQL}
