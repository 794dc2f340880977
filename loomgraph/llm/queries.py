"""The registered queries over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import ball_tree, lexical, licenses, lm_score, mixing, ngram_join, packing, pii, quality, token_fst, topk, url_filter, warc
from loomgraph.llm.common import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.line_frequency_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def byte_level_file() -> str:
    """Where the byte-level vocabulary lies; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized(table(spark, sf_dir, "documents"), byte_level_file())
    pieces = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part_bins", "part_bound")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_fst.token_counts(table(spark, sf_dir, "documents"), byte_level_file())


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.url_verdicts(pages, url_filter.tracked_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pii_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(table(spark, sf_dir, "embeddings"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_mixing": op2_mixing,
        "op3_warc": op3_warc,
        "op4_packing": op4_packing,
        "op5_ngram_join": op5_ngram_join,
        "op6_topk": op6_topk,
        "op7_token_counts": op7_token_counts,
        "op8_lm_score": op8_lm_score,
        "op9_url_filter": op9_url_filter,
        "op10_pii": op10_pii,
        "op11_ball_tree": op11_ball_tree,
        "op12_lexical": op12_lexical,
        "op13_licenses": op13_licenses,
    }


#: Words and lines of the documents, for DuckDB.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(8) t(j) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, host, text, lines, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
flagged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
texts AS (SELECT host, text, min(doc_id) AS doc_id, any_value(lines) AS lines FROM base GROUP BY host, text),
norm AS (SELECT host, doc_id, lower(trim(regexp_replace(regexp_replace(x, '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
         FROM (SELECT host, doc_id, unnest(lines) AS x FROM texts)),
freq AS (SELECT host, line, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM norm GROUP BY host, line),
sizes AS (SELECT host, count(*) AS host_docs FROM texts GROUP BY host),
hot AS (SELECT host, line, first_doc FROM freq JOIN sizes USING (host) WHERE docs >= 5 AND docs * 100 > host_docs * 1.0),
held AS (SELECT doc_id, host, lower(trim(regexp_replace(regexp_replace(x, '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
                len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, host, unnest(lines) AS x FROM base)),
lost AS (SELECT doc_id, sum(n) AS n FROM held JOIN hot USING (host, line) WHERE doc_id <> first_doc GROUP BY doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * coalesce(lost.n, 0) > 30 * n_words) AS kept, coalesce(lost.n, 0)::BIGINT AS removed_words
FROM flagged f LEFT JOIN lost USING (doc_id)
"""

#: The level of the water-filling is the first, in the order of the caps by weight, that its source's cap reaches.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('20240/' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS at
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight FROM d GROUP BY source),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
lev AS (SELECT coalesce(arg_min(level, cap / weight) FILTER (level <= cap / weight), max(cap / weight)) AS level FROM filled),
t AS (SELECT source, source_size, least(cap, weight * lev.level)::DOUBLE AS target FROM s, lev),
u AS (SELECT *, least(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END, 3)::BIGINT AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS due, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (size * least(whole + CASE WHEN due > 0 AND upto - size / 2 <= due THEN 1 ELSE 0 END, 3))::BIGINT AS taken FROM c
"""

OP9_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&#]*', '', 'g'), '^&', '') AS q
  FROM pages),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS canon
  FROM p),
listed AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(url, '\?([^#]*&)?(utm_[a-z]+|ref|fbclid|gclid)=[^&#]*') AND canon IS NOT NULL),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
  FROM c JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT c.page_id, host, path, fit.rule, coalesce(fit.verdict, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit ON c.page_id = fit.page_id AND fit.k = 1 LEFT JOIN listed ON c.canon = listed.canon
"""


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(5),
    lambda j: CASE WHEN substr(bits, (i * 5 + j + 1)::BIGINT, 1) = '1' THEN 1 << (4 - j)::INTEGER ELSE 0 END)))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM p
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s FROM grams),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
walk(root, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT root, y FROM walk JOIN both_ways ON x = node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(walk.root) AS component_id
FROM d JOIN walk ON walk.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

OP6_SQL = r"""
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v::DOUBLE))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""




def op11_sql(clusters: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """The rounds of op11 one after the other, as tables."""
    parts = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, q) - 1 AS k, q AS c FROM v ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, q LIMIT {clusters})"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, vec_id, q, k, d FROM (SELECT row, vec_id, q, k, list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r})
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1)""")
        if r < rounds:
            parts.append(f"""
s{r} AS (SELECT k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT k, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY k, i),
m{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))""")
    return f"""WITH {",".join(parts)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)
"""


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS MATERIALIZED (SELECT row, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
whole AS MATERIALIZED (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
items AS (
  SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS MATERIALIZED (SELECT item, item_id, t, count(*) AS times FROM items GROUP BY ALL),
tf AS MATERIALIZED (SELECT row, t, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY row, t),
weights AS MATERIALIZED (SELECT t, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY t, docs),
gains AS (SELECT row, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS gain FROM tf JOIN sizes USING (row) JOIN weights USING (t), whole),
scores AS (SELECT item, item_id, row, doc_id, sum(times * gain)::BIGINT AS score FROM asked JOIN gains USING (t) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": OP1_SQL, "op2_mixing": OP2_SQL, "op3_warc": OP3_SQL, "op5_ngram_join": OP5_SQL, "op6_topk": OP6_SQL, "op9_url_filter": OP9_SQL, "op11_ball_tree": op11_sql(), "op12_lexical": OP12_SQL}
