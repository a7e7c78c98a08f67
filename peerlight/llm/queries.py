"""One thin query for each operator, over its whole table, and its SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, language, lexical, mixing, packing, passages, pii, resample, rules, topk, toxicity, warc
from .common import new_path, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.held_out(F.col("doc_id"))
    model = language.train(docs.filter(~held_out))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = rules.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    keep = (~F.col("base_failed") & rules.verdict(learned)).alias("kept")
    return rules.statistics(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", keep)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = passages.train(docs, table(spark, sf_dir, "labels"))
    return passages.score(docs.select("doc_id", "text"), model).select("doc_id", passages.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(warc.records_of_pages(table(spark, sf_dir, "pages")), path)
    return warc.pages_of_records(spark, path)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_best_fit_packing, op3_quality_rules, op4_toxicity, op5_pii, op6_passage_quality, op7_source_mixing, op8_exact_top_k, op9_ngram_jaccard, op10_warc, op11_ranked_search, op12_byte_bpe, op13_importance_resampling)}

ORACLE = {
    "op7_source_mixing": """
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, coalesce(sum(source_size) OVER b, 0) AS full_size, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS open_weight, sum(source_size) OVER () AS all_size
      FROM w WINDOW b AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * all_size::DOUBLE - CAST(2 AS DOUBLE) * full_size::DOUBLE) / open_weight::DOUBLE AS level FROM o),
g AS (SELECT arg_min(level, full_size) FILTER (level * weight <= 2 * source_size) AS level FROM l),
t AS (SELECT source, source_size, least(CAST(2 AS DOUBLE) * source_size, coalesce(g.level, 'inf'::DOUBLE) * weight) AS target FROM l, g),
r AS (SELECT doc_id, draw, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(draw, 1, 8))::BIGINT / CAST(4294967296 AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r""",
    "op8_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
m AS (SELECT html, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html""",
    "op11_ranked_search": """
WITH x AS (SELECT row_number() OVER () AS row, doc_id, list_transform(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
d AS (SELECT row, doc_id, terms, len(terms)::BIGINT AS n FROM x WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM d),
tf AS (SELECT row, t, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS t FROM d) y GROUP BY 1, 2),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY t, docs),
q AS (SELECT item, item_id, t, count(*)::BIGINT AS times FROM (SELECT item, item_id, unnest(list_transform(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t
  FROM (SELECT row_number() OVER () AS item, * FROM benchmark) z) y GROUP BY 1, 2, 3),
p AS (SELECT item, item_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN d USING (row), s GROUP BY 1, 2, 3),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM p JOIN d USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op13_importance_resampling": """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
dw AS (SELECT row, unnest(words) AS word FROM d), bw AS (SELECT unnest(words) AS word FROM b),
h AS (SELECT word, (xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000)::INT AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw) u, crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN h USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN h USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
x AS (SELECT row, sum(gain)::BIGINT AS weight FROM dw JOIN h USING (word) JOIN g USING (bucket) GROUP BY 1),
y AS (SELECT row, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (row)),
z AS (SELECT row, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))))::BIGINT AS score FROM y),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, row) AS rank FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM z LEFT JOIN r USING (row)""",
}
