"""The thin opN_ queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import alignment, decontam, importance, jaccard, langid, lm, mixing, quality, setsketch, sstable, tokencount, toxicity, urlfilter
from sieveworks.llm.store import fresh_path
from sieveworks.llm.text import word_count


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights by labelled quality: 2 for good, 1/2 for bad; documents without a label have 1."""
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    return labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.when(F.max("quality") >= 1, 2.0).otherwise(0.5).alias("quality"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "text")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mixing.text_tie(F.col("text")).alias("tie"))
    rows = rows.join(quality_weights(spark, sf_dir), F.col("doc_id") == F.col("label_id"), "left")
    rows = rows.select("doc_id", "source", "size", "tie", F.coalesce("quality", F.lit(1.0)).alias("quality"))
    return mixing.take_counts(rows).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || tie), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / coalesce(q, 1.0::DOUBLE) AS rank_key, tie
  FROM (SELECT *, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS tie FROM documents) LEFT JOIN (SELECT doc_id AS label_id, CASE WHEN max(quality) >= 1 THEN 2.0 ELSE 0.5 END::DOUBLE AS q
                            FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1) ON doc_id = label_id),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM rows GROUP BY source),
weighted AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap,
                    sum(source_size) OVER () * 1.5::DOUBLE AS total FROM sizes),
levels AS (SELECT *, cap / weight AS ratio,
                  (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM weighted),
free AS (SELECT here AS level FROM levels WHERE here <= ratio ORDER BY ratio, place LIMIT 1),
found AS (SELECT levels.*, free.level FROM levels LEFT JOIN free ON true),
targets AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM found),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
ranked AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget,
                  sum(size) OVER (PARTITION BY rows.source ORDER BY rank_key, doc_id, size, tie ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle
           FROM rows JOIN epochs ON rows.source IS NOT DISTINCT FROM epochs.source)
SELECT doc_id, size, source_size, target, (size * least(epochs + (middle <= budget)::BIGINT, 2))::BIGINT AS taken FROM ranked
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents found toxic, with the chain's probabilities: low quality first, then toxic."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").withColumn("low_quality", 1 - F.col("quality"))
    chain = toxicity.train_chain(docs, labels, ["low_quality", "toxic"])
    found = toxicity.score_documents(docs, chain).withColumn("is_toxic", F.col("p_toxic") >= 0.5)
    return found.where("is_toxic")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return langid.predict_languages(docs).select("doc_id", "held_out", "lang_pred", "score")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-shards")
    sstable.write_shards(_table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return sstable.read_digests(spark, path)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


#: Listed are the canonical URLs whose md5 begins so, and as many more that no page has.
LISTED_MARK, UNSEEN = "7", 5000


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds a sixteenth of all canonical URLs, by hash, and others that no page has."""
    pages = _table(spark, sf_dir, "pages", "page_id", "url")
    seen = pages.select(urlfilter.canonical(F.col("url")).alias("canonical")).where(F.md5("canonical").startswith(LISTED_MARK))
    unseen = spark.range(UNSEEN).select(F.concat(F.lit("unseen-"), F.col("id").cast("string"), F.lit(".example.org/list")).alias("canonical"))
    return urlfilter.judge_urls(pages, seen.unionByName(unseen)).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = f"""
WITH parts AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\\?([^#]*)', 1), '(^|&)(utm_[^&=]*|ref|gclid|fbclid)(=[^&]*)?', '', 'g'), '^&+', '') AS query FROM pages),
named AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\\.', '') || rtrim(path, '/') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM named WHERE starts_with(md5(canonical), '{LISTED_MARK}') UNION SELECT 'unseen-' || i || '.example.org/list' FROM (SELECT unnest(range({UNSEEN})) AS i)),
rules(verdict, rhost, rpath) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
fits AS (SELECT page_id, url, max_by((rhost || rpath, verdict), length(rhost || rpath)) AS best
         FROM (SELECT DISTINCT page_id, url, host, path FROM parts) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT p.page_id, host, path, best[1] AS rule, coalesce(best[2], CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named p LEFT JOIN fits f ON p.page_id = f.page_id AND p.url = f.url LEFT JOIN listed l ON p.canonical = l.canonical
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    found = jaccard.jaccard_rows(docs, 3, 90)
    return found.select("doc_id", "n_shingles", "component_id")


#: All pairs by their shingles, and what links reach; small tables only.
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS t, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
reach(node, other) AS (SELECT u, v FROM l UNION SELECT r.node, l.v FROM reach r JOIN l ON r.other = l.u)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.least, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT node, min(other) AS least FROM reach GROUP BY 1) m ON s.doc_id = m.node
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share a passage with a benchmark text, by pair."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    leaks = decontam.find_leaks(docs, _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return leaks.select("doc_id", "item_id", "n_matches", "n_substituted", "doc_start", "item_start")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "text"))


#: crc32 is a table of 256 values, computed here, and a fold over the bytes of each distinct word.
OP11_SQL = r"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS i))),
found AS (SELECT d AS src, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
          FROM (SELECT 'docs' AS d, doc_id AS id, text FROM documents UNION ALL SELECT 'target', NULL, text FROM benchmark)),
vocab AS (SELECT DISTINCT unnest(ws) AS word FROM found),
hashed AS (SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i::INT + 1, 2))::BIGINT),
             lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM vocab, crc),
placed AS (SELECT src, id, unnest(ws) AS word FROM found),
counts AS (SELECT bucket, count(*) FILTER (src = 'docs') AS s, count(*) FILTER (src = 'target') AS t FROM placed JOIN hashed USING (word) GROUP BY 1),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * (all_s + 10000.0::DOUBLE)) / ((s + 1)::DOUBLE * (all_t + 10000.0::DOUBLE))))::BIGINT AS gain FROM counts, totals),
summed AS (SELECT id, sum(gain)::BIGINT AS total FROM placed JOIN hashed USING (word) JOIN gains USING (bucket) WHERE src = 'docs' GROUP BY id),
weighed AS (SELECT f.id AS doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) > 0 THEN (total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) ELSE 0 END::BIGINT AS weight,
                   ('0x' || substr(sha256('2024:' || coalesce(f.id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h
            FROM found f LEFT JOIN summed s ON f.id IS NOT DISTINCT FROM s.id WHERE src = 'docs'),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
placed_rows AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END::BIGINT AS rank FROM placed_rows
"""


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return alignment.align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), 5, 85)


#: All pairs by their shingles, and what links reach; small tables only.
OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS t, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
reach(node, other) AS (SELECT u, v FROM l UNION SELECT r.node, l.v FROM reach r JOIN l ON r.other = l.u)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.least, s.doc_id)) AS component_id, s.doc_id <= coalesce(m.least, s.doc_id) AS kept
FROM s LEFT JOIN (SELECT node, min(other) AS least FROM reach GROUP BY 1) m ON s.doc_id = m.node
"""


def queries() -> dict:
    found = (
        op1_mix_sources, op2_toxicity, op3_language_id, op4_token_shards, op5_lm_scores, op6_url_filter, op7_quality_rules, op8_jaccard_join, op9_token_counts,
        op10_decontaminate, op11_importance_resample, op12_align_tokenizers, op13_near_duplicates,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op6_url_filter": OP6_SQL, "op8_jaccard_join": OP8_SQL, "op11_importance_resample": OP11_SQL, "op13_near_duplicates": OP13_SQL}
