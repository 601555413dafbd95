"""The queries opN_<name>: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by weak supervision."""
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 words for all documents."""
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op3_token_binary(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Writes all documents' ids as patched frame-of-reference segments and reads them back. tokenizer: the file's path."""
    import public_tokenizers

    from . import token_files

    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json")))


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by Bradley-Terry ranking."""
    from . import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op5_bpe_codec(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Digests of all documents' ids and of the texts that these decode to. tokenizer: the file's path."""
    import public_tokenizers

    from . import word_bpe

    return word_bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data and secrets."""
    from . import pii

    found = pii.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))
    return found.select("doc_id", "text", F.size("entities").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("entities.type")), ",").alias("types"))


def op7_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' bytes as lossless WebP, read back with features."""
    from . import media

    return media.read(media.write(table(spark, sf_dir, "documents")))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of at least 0.85."""
    from . import ngram_join

    found = ngram_join.join(table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of line runs of 50 words."""
    from . import line_dedup

    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "lines_deleted")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal texts, by a stateful stream."""
    from . import stream_dedup

    return stream_dedup.dedup(spark, f"{sf_dir}/documents.parquet")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between sources' word distributions in each language of all documents."""
    from . import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most 2 bits."""
    from . import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' fill-in-middle outputs and of the texts restored from these."""
    from . import fill_middle

    found = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored()).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT row_id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT lang, gn.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (gn.n + 5 * v.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.total + 5)) // (v.n + 5 * v.v)::HUGEINT AS q
  FROM gn JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
term AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

OP13_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM u),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT *, array_to_string(list_slice(units, 1, a), '') AS pre, array_to_string(list_slice(units, a + 1, b), '') AS mid,
         array_to_string(list_slice(units, b + 1, n), '') AS suf
  FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """The other queries can't be written in SQL, or not for whole tables; tests hold them against brute force."""
    return {"op10_exact_dedup": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_fill_middle": OP13_SQL}
