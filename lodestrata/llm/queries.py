"""The registered query of each operator, over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import collocations, decontaminate, hyperminhash, langid, line_dedup, lm_bloom, ngram_join, packing, png_media, prefix_trie, quality, sstable, warc
from lodestrata.llm.common import stored, work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return ngram_join.near_duplicates(spark, _table(spark, sf_dir, "documents"), words=5, percent=80)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text with a model of six sevenths of them."""
    return lm_bloom.evaluate(spark, _table(spark, sf_dir, "documents"))


def op3_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a copy of all pages' WARC shards in which one record of a thousand is damaged, as a drill."""
    out = warc.drill(spark, _table(spark, sf_dir, "pages"), F.col("key").cast("long") % 1000 == 7)
    return out.select("page_id", "n_bytes", "payload_sha256", "intact")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG of every whole text in a stored binary column, read back; features: the cosine hash as hex."""
    media = stored(png_media.store(_table(spark, sf_dir, "documents")), work_dir(spark, "media"))
    out = png_media.features(media)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("phash")).alias("feature"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of benchmark items, and the items found."""
    found = decontaminate.matches(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op5_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose rare terms meet within 50 words of a document, altered copies among them."""
    found = decontaminate.proximity(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("near").cast("long").alias("n_near"), F.sha2(F.array_join("near", ",").cast("binary"), 256).alias("near_sha256"))


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text through sorted-string-table shards."""
    return sstable.token_table(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "word", 1)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops lines whose key is in 10 documents or more."""
    out = line_dedup.dedup_corpus(spark, _table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return packing.pack(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte", 0, 2048)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts every document's language; learns from two thirds of them."""
    return langid.identify(spark, _table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of low quality and of toxic text for every document, and whether it stays."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    # The text is read once for its evidence and is not kept: only digests leave.
    out = quality.classify(spark, docs, _table(spark, sf_dir, "labels"), carry_text=False)
    return out.select("doc_id", "p_low", "p_toxic", "keep")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations whose heads are shared."""
    return prefix_trie.prefix_trie(spark, _table(spark, sf_dir, "conversations"))


def op12_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return hyperminhash.near_duplicates(spark, _table(spark, sf_dir, "documents"), words=3, percent=85)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of 2 to 3 words of each language."""
    return collocations.mine(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_lm_scoring, op3_warc_merkle_audit, op4_media_columns, op5_decontamination, op5_proximity, op6_sstable, op7_line_dedup, op8_best_fit_packing, op9_language_id, op10_quality_classifier, op11_prefix_trie, op12_hyperminhash_dedup, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_merkle_audit": OP3, "op7_line_dedup": OP7, "op11_prefix_trie": OP11, "op13_collocations": OP13}


OP3 = """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(html, '')) AS payload_sha256,
  coalesce(page_id % 1000 <> 7, true) AS intact
FROM pages
"""


OP7 = r"""
WITH split AS (
  SELECT rowid AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), line AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT k.r, k.doc_id, k.line, k.pos, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


OP11 = r"""
WITH turn AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS k, d, w FROM (
    SELECT conv_id, turn, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
    FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT conv_id, list(d ORDER BY k) AS d, list(w ORDER BY k) AS w,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda crc, b: list_reduce([xor(crc, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM turn GROUP BY conv_id
), whole AS (
  SELECT o.conv_id, list_concat(coalesce(b.d[1:o.h], []), o.d[o.h + 1:]) AS d, list_concat(coalesce(b.w[1:o.h], []), o.w[o.h + 1:]) AS w
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), member AS (
  SELECT conv_id, depth, md5(array_to_string(d[1:depth], '')) AS node, CASE WHEN depth > 0 THEN md5(array_to_string(d[1:depth - 1], '')) END AS up,
    CASE WHEN depth > 0 THEN w[depth] ELSE 0 END AS w, depth = len(d) AS ends
  FROM (SELECT *, unnest(range(len(d) + 1)) AS depth FROM whole)
), node AS (
  SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(w) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM member GROUP BY node, depth
), kid AS (
  SELECT up AS node, count(*) AS n_children FROM node GROUP BY up
), below AS (
  SELECT m.node, m.depth, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves
  FROM node n JOIN member m ON m.conv_id = n.conv_id AND m.depth <= n.depth LEFT JOIN kid k ON k.node = n.node GROUP BY m.node, m.depth
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN below b ON b.node = n.node AND b.depth = n.depth LEFT JOIN node p ON p.node = n.up LEFT JOIN kid k ON k.node = n.node
"""


OP13 = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), gram AS (
  SELECT lang, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (
    SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM piece, (VALUES (1), (2), (3)) AS sizes(n) WHERE len(w) >= n)
), f AS (
  SELECT lang, n, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 10
), total AS (
  SELECT lang, sum(len(w)) AS n FROM piece GROUP BY lang
), cut AS (
  SELECT lang, n, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS one, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS two
  FROM f, (VALUES (1), (2)) AS ks(k) WHERE k < n
), best AS (
  SELECT c.lang, c.n, c.phrase, c.a, unnest(min({'score': CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f), 'k': c.k, 'l': x.f, 'r': y.f}))
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.one JOIN f y ON y.lang = c.lang AND y.phrase = c.two GROUP BY c.lang, c.n, c.phrase, c.a
), longer AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase, max(f) AS f FROM f, (VALUES (1), (2)) AS places(i) WHERE n = 3 GROUP BY ALL
), stay AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase AND b.n = 2 WHERE g.f IS NULL OR 100 * g.f < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay
)
SELECT lang, rank, phrase, a, l, r, CAST(total.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
