"""Queries of the training-data operators over whole tables, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, impact_index, licenses, line_crf, mixing, ngram_join, packing, quality_rules, sentencepiece_lattice, substring_dedup, token_counts, token_store, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_copies", "position")


def op3_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_store.read(spark, store).drop("ids")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.score_documents(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("key")


def op11_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_bit_sliced_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return packing.read(spark, packed).drop("ids")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_source_mixing, op3_sentencepiece_lattice, op4_token_store, op5_substring_dedup,
        op6_license_scan, op7_inverted_multi_index, op8_line_crf, op9_ngram_join, op10_quality_rules,
        op11_tiled_whitening, op12_bit_sliced_impacts, op13_binary_packing,
    )
}

#: Words of whole texts; null texts have none.
SQL_WORDS = "w AS (SELECT doc_id, text, coalesce(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+'), CAST([] AS VARCHAR[])) AS ws FROM documents)"

ORACLES: dict[str, str] = {
    "op2_source_mixing": "WITH " + SQL_WORDS.format(text="text") + """,
 r AS (SELECT w.doc_id, d.source, CAST(len(ws) AS BIGINT) AS size,
  md5(coalesce(CAST(length(CAST(w.doc_id AS VARCHAR)) AS VARCHAR) || ':' || CAST(w.doc_id AS VARCHAR), '-') || coalesce(CAST(length(d.source) AS VARCHAR) || ':' || d.source, '-') || coalesce('=' || d.text, '-')) AS k
  FROM w JOIN documents d USING (doc_id)),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS slot FROM r GROUP BY source),
 c AS (SELECT *, 3 * source_size AS cap, CAST([5, 2, 1][slot] AS DOUBLE) AS weight, sum(source_size) OVER () AS total FROM s),
 l AS (SELECT *, (total - sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST) + cap) / (sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST) + weight) AS level FROM c),
 f AS (SELECT *, (SELECT arg_min(level, struct_pack(a := cap / weight, b := source IS NULL, c := coalesce(source, ''))) FROM l WHERE cap >= level * weight) AS found FROM l),
 t AS (SELECT source, source_size, CASE WHEN found IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), found * weight) END AS target, [0.5, 1.0, 1.5][slot] AS a, [1.5, 1.0, 0.5][slot] AS b FROM f),
 q AS (SELECT r.*, source_size, target, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(round(target) AS BIGINT) AS quota, CAST(sum(size) OVER (PARTITION BY r.source ORDER BY k ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS place FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
 e AS (SELECT *, [place, source_size + place, 2 * source_size + place] AS begun, least(place / nullif(target, 0), 1) * ((a + b) / 2) AS share FROM q)
 SELECT doc_id, size, source_size, target, CAST(list_sum(list_transform(begun, lambda x: least(greatest(quota - x, 0), size))) AS BIGINT) AS taken,
  CAST(CASE WHEN size > 0 THEN len(list_filter(begun, lambda x: x < quota)) ELSE 0 END AS BIGINT) AS n_copies,
  CASE WHEN size > 0 AND place < quota THEN CASE WHEN a = b THEN share / a ELSE (sqrt(a * a + 2 * (b - a) * share) - a) / (b - a) END END AS "position" FROM e""",
    "op5_substring_dedup": "WITH " + SQL_WORDS.format(text="text") + """,
 i AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS k FROM w WHERE len(ws) >= 50),
 h AS (SELECT doc_id, k, md5(array_to_string(ws[k:k + 49], ' ')) AS h FROM i),
 f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
 g AS (SELECT h.doc_id, unnest(generate_series(k, k + 49)) AS p FROM h JOIN f USING (h) WHERE first < h.doc_id),
 d AS (SELECT doc_id, list(DISTINCT p) AS gone FROM g GROUP BY doc_id)
 SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_filter(ws, lambda x, p: NOT list_contains(gone, p)), ' ') END) AS kept_sha256
 FROM w LEFT JOIN d USING (doc_id)""",
    "op9_ngram_join": "WITH RECURSIVE " + SQL_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """,
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS k FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT doc_id AS v, doc_id AS t FROM n UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.t),
 k AS (SELECT e.a, count(DISTINCT y.text) AS k FROM e JOIN w x ON x.doc_id = e.a JOIN w y ON y.doc_id = e.b WHERE y.text <> x.text GROUP BY e.a)
 SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, w.doc_id) AS component_id, CASE WHEN n.n IS NULL THEN w.doc_id ELSE min(w.doc_id) OVER (PARTITION BY text) END AS class_id, coalesce(k.k, 0) AS n_links
 FROM w LEFT JOIN k ON k.a = w.doc_id LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(t) AS m FROM r GROUP BY v) c ON c.v = w.doc_id""",
    "op10_quality_rules": "WITH " + SQL_WORDS.format(text="text") + """,
 i AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS k FROM w WHERE len(ws) >= 8),
 g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(ws[k:k + 7], ' '))) AS c FROM i),
 p AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(generate_series(k, k + 7)) AS place FROM g WHERE c > 1) GROUP BY doc_id),
 l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
 c AS (SELECT w.doc_id, d.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(l.n_dup, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines, len(list_filter(ws, lambda x: x = upper(x) AND x <> lower(x))) AS n_upper FROM w JOIN documents d USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
 v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(n_symbols > CAST(0.1 AS DOUBLE) * word_chars AS BIGINT) + CAST(n_dup_lines > 0.5 * n_lines AS BIGINT) + CAST(n_upper > CAST(0.6 AS DOUBLE) * n_words AS BIGINT) AS whole,
  CAST(n_symbols > CAST(0.05 AS DOUBLE) * word_chars AS BIGINT) + CAST(n_dup_lines > 0.25 * n_lines AS BIGINT) + CAST(n_upper > CAST(0.3 AS DOUBLE) * n_words AS BIGINT) AS half FROM c),
 h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed OR whole > 0) AS DOUBLE) AS f FROM v GROUP BY source),
 t AS (SELECT count(*) AS hosts, sum(n) AS n, sum(f) / sum(n) AS m, sum(f * f / n) AS q FROM h),
 a AS (SELECT m, greatest((q - n * m * m - hosts * m * (1 - m)) / n, 0) AS v FROM t),
 b AS (SELECT m, v, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS k FROM a),
 r AS (SELECT source, n, k, m, v, (f + m * k) / (n + k) AS rate FROM h, b),
 j AS (SELECT source, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) > m + sqrt(v) AS bad FROM r)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN bad THEN half ELSE whole END AS n_rules_failed, round(rate, 9) AS host_rate, bad AS host_bad, NOT base_failed AND CASE WHEN bad THEN half ELSE whole END = 0 AS kept
 FROM v JOIN j ON v.source IS NOT DISTINCT FROM j.source""",
    "op12_bit_sliced_impacts": """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
 p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
 d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
 s AS (SELECT count(*) AS many, CAST(sum(n) AS BIGINT) AS total FROM d),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * many + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, many),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
 r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * many) // total)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id)
 SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50""",
}
