"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, lattice, ordermin, perplexity, quality, quotes, substring, tokens, winnow
from .shared import bounded_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(quotes.link_quotes(table(spark, sf_dir, "conversations")))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op4_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.fit(docs))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents"))


def op7_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quotation_links, op2_winnowing, op3_prefix_token_counts, op4_string_kernel_language, op5_byte_bpe, op6_perplexity_rules, op7_lattice_likelihood, op8_subword_quality, op9_repeated_windows, op10_order_minhash)}

_OP1 = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, md5(coalesce(text, '')) || (text IS NULL)::text AS own FROM conversations
), l AS (
  SELECT DISTINCT conv_id, turn, own, pos, x AS line, length(regexp_replace(regexp_extract(x, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(x, '^(?:[ \t]*>)+', '')), '[ \t\r\f\x0B]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT conv_id, turn, own, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m)
), s AS (
  SELECT *, CASE WHEN level = lag(level) OVER w AND norm <> '' AND lag(norm) OVER w <> '' THEN 0 ELSE 1 END AS new
  FROM l WHERE conv_id IS NOT NULL AND turn IS NOT NULL WINDOW w AS (PARTITION BY conv_id, turn, own ORDER BY pos)
), g AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, own ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM s
), h AS (
  SELECT conv_id, turn, own, run, min(level) AS level, string_agg(norm, ' ' ORDER BY pos) AS passage FROM g WHERE norm <> '' GROUP BY conv_id, turn, own, run
), o AS (
  SELECT conv_id, turn, norm AS said FROM g WHERE level = 0 AND norm <> '' UNION SELECT conv_id, turn, passage FROM h WHERE level = 0
), a AS (
  SELECT conv_id, turn, norm AS said FROM g WHERE level > 0 AND norm <> '' UNION SELECT conv_id, turn, passage FROM h WHERE level > 0
), f AS (
  SELECT a.conv_id, a.turn, a.said, max(o.turn) AS source FROM a JOIN o ON o.conv_id = a.conv_id AND o.said = a.said AND o.turn < a.turn GROUP BY ALL
), q AS (
  SELECT g.conv_id, g.turn, g.own, g.pos, g.level, coalesce(w.source, p.source) AS source
  FROM g JOIN h ON h.conv_id = g.conv_id AND h.turn = g.turn AND h.own = g.own AND h.run = g.run
  LEFT JOIN f w ON w.conv_id = g.conv_id AND w.turn = g.turn AND w.said = h.passage
  LEFT JOIN f p ON p.conv_id = g.conv_id AND p.turn = g.turn AND p.said = g.norm
  WHERE g.level > 0 AND g.norm <> ''
), c AS (
  SELECT conv_id, turn, own, max(level) AS max_level, count(*) AS n_quoted, count(source) AS n_linked FROM q GROUP BY ALL
), v AS (
  SELECT conv_id, turn, source, count(*) AS n FROM q WHERE level = 1 AND source IS NOT NULL GROUP BY ALL
), p AS (
  SELECT conv_id, turn, source AS parent FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, source DESC) = 1
), t AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM p
  UNION ALL
  SELECT t.conv_id, t.turn, p.parent, t.depth + 1 FROM t JOIN p ON p.conv_id = t.conv_id AND p.turn = t.root
), r AS (
  SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM t GROUP BY ALL
), u AS (
  SELECT conv_id, turn, own, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level = 0), ''), '\A(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+\z', '', 'g') AS clean
  FROM l GROUP BY ALL
)
SELECT m.conv_id, m.turn, m.role, p.parent::bigint AS parent_turn, coalesce(r.root, m.turn)::bigint AS thread_turn, coalesce(r.depth, 0)::bigint AS depth,
       coalesce(c.max_level, 0)::bigint AS max_level, coalesce(c.n_quoted, 0)::bigint AS n_quoted, coalesce(c.n_linked, 0)::bigint AS n_linked, u.clean AS text
FROM m LEFT JOIN u ON m.conv_id = u.conv_id AND m.turn = u.turn AND m.own = u.own
LEFT JOIN c ON m.conv_id = c.conv_id AND m.turn = c.turn AND m.own = c.own
LEFT JOIN p ON m.conv_id = p.conv_id AND m.turn = p.turn LEFT JOIN r ON m.conv_id = r.conv_id AND m.turn = r.turn
"""

_OP2 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, span)
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id::text)) AS items FROM hit GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(len(items), 0)::bigint AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), twice AS (
  SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM win WHERE h IN (SELECT h FROM twice)
), word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d
), kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.k = gone.k GROUP BY ALL
)
SELECT d.doc_id, len(d.w)::bigint AS n_words, (len(d.w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL = {"op1_quotation_links": _OP1, "op2_winnowing": _OP2, "op9_repeated_windows": _OP9}
