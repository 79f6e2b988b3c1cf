"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, decontam, fingerprints, importance, kneser_ney, langid, license_scan, line_dedup, ngram_join,
               packing, token_file, vector_codes, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that earlier documents hold are dropped."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at 0.85."""
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written bit-packed in doc_id order and read back."""
    return token_file.token_file_digest(spark, _table(spark, sf_dir, "documents"),
                                        public_tokenizers.path("word_bpe_49k.json"), 2, 49_408)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vec_id among all."""
    rows = _table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 100 = 0"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, archived and read back."""
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from those not held out."""
    return langid.identify_languages(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(
        "doc_id", "held_out", "lang_pred", "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of those not held out."""
    out = langid.held_out(F.col("doc_id"), 7, 2)
    docs = _table(spark, sf_dir, "documents").select("doc_id", out.alias("held_out"), "text")
    return kneser_ney.fit_and_score(docs, ~F.col("held_out")).drop("perplexity")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in all documents."""
    return license_scan.scan_licences(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 8 parts of 16 entries, 6 rounds, components as integers of 1/4096."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents of 20 words or more, drawn towards the benchmark's words."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"),
                               most=1, buckets=10_000, percent=10, least_words=20, seed="2024")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.compare_with_edits(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pack, op2_line_dedup, op3_ngram_join, op4_token_file, op5_ann, op6_warc,
                                    op7_decontaminate, op8_language, op9_lm_score, op10_licences, op11_vector_codes,
                                    op12_importance, op13_fingerprints)}


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
k AS (
  SELECT doc_id, place, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
d AS (
  SELECT k.doc_id, k.place, k.line, f.first IS NOT NULL AND k.doc_id <> f.first AS dropped
  FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (html)
"""


def _op11_sql(rounds: int) -> str:
    """Nearest entries and floored means, a pair of steps a round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, part, min(row(d, entry)) AS best FROM (
    SELECT x.r, x.part, b.entry, sum((x.x - b.c) * (x.x - b.c))::BIGINT AS d
    FROM x JOIN b{k} b USING (part, place) GROUP BY ALL) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(m.c, b.c) AS c
  FROM b{k} b LEFT JOIN (
    SELECT x.part, a.best[2] AS entry, x.place,
           ((sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS c
    FROM x JOIN a{k} a USING (r, part) GROUP BY ALL) m USING (part, entry, place))""")
    return """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding, len(embedding) // 8 AS width
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(embedding) = len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
x AS MATERIALIZED (
  SELECT r, i // width AS part, i % width AS place, floor(4096 * c)::BIGINT AS x
  FROM (SELECT r, width, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) - 1 AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, r AS entry, place, x AS c FROM x WHERE r < 16),""" + ",".join(steps) + f""",
coded AS (
  SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error
  FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) AS digest FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       digest AS codebooks_sha256
FROM v JOIN coded USING (r), books
"""


OP12_SQL = r"""
WITH words AS (
  SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
counted AS MATERIALIZED (SELECT side, id, word, count(*) AS n FROM words GROUP BY ALL),
crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
bytes AS (
  SELECT word, list_transform(range(octet_length(encode(word))), lambda i:
    ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT word FROM counted)),
dealt AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_concat([4294967295], b), lambda c, x:
    xor(c >> 8, crcs[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
filled AS (
  SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t
  FROM counted JOIN dealt USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM filled),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000)
                                 / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM filled, totals),
weighed AS (
  SELECT id AS doc_id, sum(n) AS n_features, sum(n * gain) AS weight
  FROM counted JOIN dealt USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT
           + 0.5::DOUBLE) / 4294967296)))::BIGINT)::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS n_able
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * n_able // 100 THEN place END AS rank
FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op6_warc": OP6_SQL, "op11_vector_codes": _op11_sql(6), "op12_importance": OP12_SQL}
