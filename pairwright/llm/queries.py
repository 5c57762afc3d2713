"""One query opN_<name> for each operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairwright.llm.common import table
from pairwright.llm.decontaminate import contamination_report
from pairwright.llm.exact_dedup import exact_dedup
from pairwright.llm.hard_negatives import hard_negatives
from pairwright.llm.html_extract import extract_main_text
from pairwright.llm.jaccard_join import near_duplicates
from pairwright.llm.line_dedup import line_dedup_report
from pairwright.llm.packing import packing_report
from pairwright.llm.piece_encode import round_trips
from pairwright.llm.quality_model import quality_scores
from pairwright.llm.quality_rules import quality_rules
from pairwright.llm.secrets import secret_report
from pairwright.llm.toxicity import toxicity_scores
from pairwright.llm.vector_codes import code_report


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP2 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d
), t AS (
  SELECT doc_id, pos, word || ' ' || lead(word) OVER v || ' ' || lead(word, 2) OVER v AS tri
  FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos)
), r AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM t WHERE tri IS NOT NULL
), rw AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM r WHERE c > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), dl AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
  SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dl ON dl.doc_id = d.doc_id LEFT JOIN rw ON rw.doc_id = d.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         1000 * word_chars // greatest(n_words, 1) AS mean_word, 10000 * n_symbols // greatest(word_chars, 1) AS symbols,
         1000 * n_dup_lines // greatest(n_words, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats
  FROM s
), m AS (
  SELECT lang, source, unnest(['mean_word', 'symbols', 'dup_lines', 'repeats']) AS measure, unnest([mean_word, symbols, dup_lines, repeats]) AS value
  FROM b WHERE NOT base_failed
), sk AS (
  SELECT lang, source, measure, (value >> greatest(0, length(bin(value)) - 6)::INT) << greatest(0, length(bin(value)) - 6)::INT AS low, count(*) AS n
  FROM m GROUP BY ALL
), sl AS (
  SELECT lang, measure, low, sum(n) AS n FROM sk GROUP BY ALL
), lang_sketch AS (
  SELECT lang, measure, low, sum(n) AS n FROM (
    SELECT lang, measure, low, 100 * n AS n FROM sl
    UNION ALL
    SELECT g.lang, measure, low, floor(a.n * 10000 / sum(a.n) OVER (PARTITION BY g.lang, measure)) FROM (SELECT measure, low, sum(n) AS n FROM sk GROUP BY ALL) a JOIN (SELECT DISTINCT lang, measure FROM sl) g USING (measure)
  ) GROUP BY ALL
), group_sketch AS (
  SELECT lang, source, measure, low, sum(n) AS n FROM (
    SELECT lang, source, measure, low, 100 * n AS n FROM sk
    UNION ALL
    SELECT lang, g.source, measure, low, floor(a.n * 10000 / sum(a.n) OVER (PARTITION BY lang, g.source, measure)) FROM lang_sketch a JOIN (SELECT DISTINCT lang, source, measure FROM sk) g USING (lang, measure)
  ) GROUP BY ALL
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY low) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM group_sketch
), q AS (
  SELECT lang, source, measure, min(low) FILTER (100 * upto >= 10 * total) AS tail, min(low) FILTER (100 * upto >= 50 * total) AS middle, min(low) FILTER (100 * upto >= 90 * total) AS head
  FROM c GROUP BY ALL
), wide AS (
  SELECT lang, source, max(tail - 3 * (middle - tail)) FILTER (measure = 'mean_word') AS l1, max(head + 3 * (head - middle)) FILTER (measure = 'mean_word') AS h1,
         max(head + 3 * (head - middle)) FILTER (measure = 'symbols') AS h2, max(head + 3 * (head - middle)) FILTER (measure = 'dup_lines') AS h3, max(head + 3 * (head - middle)) FILTER (measure = 'repeats') AS h4
  FROM q GROUP BY lang, source
), z AS (
  SELECT *, word_chars::DOUBLE AS c1, n_symbols::DOUBLE AS c2, n_dup_lines::DOUBLE AS c3, n_repeat_words::DOUBLE AS c4, greatest(n_words, 1)::DOUBLE AS w, greatest(word_chars, 1)::DOUBLE AS k FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce((c1 - 2::DOUBLE * sqrt(c1 + 1)) * 1000 <= h1 * w AND (c1 + 2::DOUBLE * sqrt(c1 + 1)) * 1000 >= l1 * w AND (c2 - 2::DOUBLE * sqrt(c2 + 1)) * 10000 <= h2 * k
         AND (c3 - 2::DOUBLE * sqrt(c3 + 1)) * 1000 <= h3 * w AND (c4 - 2::DOUBLE * sqrt(6::DOUBLE * (c4 + 6))) * 1000 <= h4 * w, false) AS kept
FROM z LEFT JOIN wide ON wide.lang = z.lang AND wide.source = z.source
"""

_OP8 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
  FROM documents
), k AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""

_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), b AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[pos:pos + 9], ' ') AS gram
  FROM (SELECT item, words, unnest(range(1, greatest(2, len(words) - 8))) AS pos FROM i WHERE len(words) > 0)
), p AS (
  SELECT rid, pos, n, array_to_string(words[pos:pos + n - 1], ' ') AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS pos FROM d), (SELECT DISTINCT n FROM b) WHERE pos + n - 1 <= len(words)
), h AS (
  SELECT rid, pos, p.n, item FROM p JOIN b USING (n, gram)
), w AS (
  SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS word FROM (SELECT DISTINCT rid, pos, n FROM h)) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (rid) LEFT JOIN t USING (rid)
"""


_USABLE = "embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"
_SQUARES = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(parts.x, {book}.x)])::BIGINT"


def _op11(rounds: int = 4) -> str:
    """Every distance in every round."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings WHERE {_USABLE}
), parts AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(4) r(p)
), b0 AS MATERIALIZED (
  SELECT p, k, x FROM parts JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS k FROM kept QUALIFY k < 256) USING (rid)
)"""]
    for i in range(rounds + 1):
        steps.append(f""", a{i} AS MATERIALIZED (
  SELECT rid, p, min(struct_pack(far := {_SQUARES.format(book=f"b{i}")}, k := k)) AS best FROM parts JOIN b{i} USING (p) GROUP BY rid, p
)""")
        if i < rounds:
            steps.append(f""", m{i} AS (
  SELECT p, k, list(mean ORDER BY pos) AS x FROM (
    SELECT p, best.k AS k, pos, floor(sum(x[pos]) / count(*))::BIGINT AS mean FROM a{i} JOIN parts USING (rid, p), unnest(range(1, len(x) + 1)) u(pos) GROUP BY ALL
  ) GROUP BY p, k
), b{i + 1} AS MATERIALIZED (
  SELECT p, k, coalesce(m{i}.x, b{i}.x) AS x FROM b{i} LEFT JOIN m{i} USING (p, k)
)""")
    return "".join(steps) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN (SELECT rid, string_agg(lower(printf('%02x', best.k)), '' ORDER BY p) AS code, sum(best.far)::BIGINT AS error FROM a{rounds} GROUP BY rid) USING (rid)
"""


_OP12 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND {_USABLE}
), s AS MATERIALIZED (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_sum([z[1] * z[2] for z in list_zip(a.x, b.x)])::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_model, op2_quality_rules, op3_html_extract, op4_line_dedup, op5_packing, op6_secrets, op7_toxicity, op8_exact_dedup, op9_piece_encode, op10_jaccard_join, op11_vector_codes, op12_hard_negatives, op13_decontaminate)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _OP2, "op8_exact_dedup": _OP8, "op11_vector_codes": _op11(), "op12_hard_negatives": _OP12, "op13_decontaminate": _OP13}
