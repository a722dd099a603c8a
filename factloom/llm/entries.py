"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import table
from factloom.llm.decontamination import contamination
from factloom.llm.exact_dedup import exact_groups
from factloom.llm.language_id import languages
from factloom.llm.lattice_lm import lattice_scores
from factloom.llm.mixing import mixed_documents
from factloom.llm.secret_scan import secret_spans
from factloom.llm.simhash import near_components
from factloom.llm.substring import remove_repeats
from factloom.llm.token_count import token_counts
from factloom.llm.toxicity import toxicity


def tokenizer_file(name: str) -> str:
    """Where the named public tokenizer file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secret_spans(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_exact_dedup,
            op2_simhash,
            op3_token_counts,
            op4_secrets,
            op5_language_id,
            op6_mixing,
            op7_toxicity,
            op8_substring_dedup,
            op9_lattice_lm,
            op10_decontamination,
        )
    }


OP1 = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), ranked AS (
  SELECT doc_id, norm, row_number() OVER w AS n, first_value(doc_id) OVER w AS keep_id FROM texts
  WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY norm) AS group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
"""


OP8 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM words WHERE len(ws) >= 50
), keyed AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS k FROM windows
), least AS (
  SELECT k, min(doc_id) AS first_id FROM keyed GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, i + j AS pos FROM keyed JOIN least USING (k), range(50) AS t(j) WHERE doc_id > first_id
), each AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM words
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS kept, count(*) AS n
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos WHERE g.pos IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

OP10 = r"""
WITH upper AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, upper
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, upper
), item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i : i + size - 1], ' ') AS k FROM (
    SELECT item_id, ws, least(len(ws), 13) AS size, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM items WHERE len(ws) > 0
  )
), sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS k FROM (
    SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, sizes WHERE len(ws) >= size
  )
), met AS (
  SELECT d.doc_id, d.i, d.size, w.item_id FROM doc_windows d JOIN item_windows w ON d.size = w.size AND d.k = w.k
), hits AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM met), range(13) AS t(j) WHERE j < size GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(f.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.ws) AS contaminated
FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op8_substring_dedup": OP8, "op10_decontamination": OP10}
