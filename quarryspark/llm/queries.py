"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryspark.llm.language_id import identify_language, remainder, train_language_id

    docs = _table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = train_language_id(docs, ~held_out)
    return identify_language(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryspark.llm.substring_dedup import remove_repeated_passages

    return remove_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryspark.llm.transport_stream import media_digests

    return media_digests(_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryspark.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose doc_id is divisible by 20 is a query, with its whole text, against all documents."""
    from quarryspark.llm.topk_search import search_top_k

    docs = _table(spark, sf_dir, "documents")
    return search_top_k(docs, docs.filter("doc_id % 20 = 0"), k=10, query_id_col="doc_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryspark.llm.token_files import token_file_digests

    return token_file_digests(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), blanks="leading", end_id=2)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryspark.llm.html_text import extract_main_text, learn_weights

    pages = _table(spark, sf_dir, "pages")
    return extract_main_text(pages, learn_weights(pages)).select("page_id", "url", "text", "n_chars")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryspark.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryspark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), blanks="dropped", end_id=0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryspark.llm.language_id import remainder
    from quarryspark.llm.quality import classify_quality

    held_out = remainder("doc_id", 3) == 1
    scored = classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; labels of every seventh are moved by one first."""
    from quarryspark.llm.hard_negatives import mine_hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved, positives=5, negatives=10, low=30, high=90)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryspark.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryspark.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_media": op3_media,
    "op4_near_dedup": op4_near_dedup,
    "op5_topk_search": op5_topk_search,
    "op6_token_files": op6_token_files,
    "op7_html_text": op7_html_text,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_license_scan": op12_license_scan,
    "op13_whitening": op13_whitening,
}


def _license_sql() -> str:
    from quarryspark.llm.license_scan import BETWEEN, LICENSES

    quote = lambda t: "'" + t.replace("'", "''") + "'"
    split = lambda t: f"list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BETWEEN}'), lambda x: x <> '')"
    rows = ", ".join(f"({k}, {quote(t.label)}, {str(t.phrase).lower()}, {quote(t.text)})" for k, t in enumerate(LICENSES))
    return f"""
WITH templates AS (SELECT template, label, phrase, {split('text')} AS w FROM (VALUES {rows}) t(template, label, phrase, text)),
sized AS (SELECT *, len(w) AS size, CASE WHEN phrase THEN 2 ELSE least(len(w), 4) END AS k FROM templates),
grams AS (SELECT template, label, phrase, size, k, spot, w[spot + 1:spot + k] AS gram FROM (SELECT *, unnest(range(size - k + 1)) AS spot FROM sized)),
docs AS (SELECT row_number() OVER () AS row, doc_id, {split("coalesce(text, '')")} AS w FROM documents),
placed AS (SELECT row, w, unnest(range(len(w) - 1)) AS pos FROM docs),
hits AS (SELECT p.row, g.*, p.pos - g.spot AS diagonal FROM placed p JOIN grams g ON p.w[p.pos + 1] = g.gram[1] AND p.w[p.pos + 2] = g.gram[2] AND p.w[p.pos + 1:p.pos + g.k] = g.gram),
diagonals AS (SELECT DISTINCT row, template, phrase, diagonal FROM hits),
new AS (SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER w > 5, true) THEN 1 ELSE 0 END AS n FROM diagonals WINDOW w AS (PARTITION BY row, template ORDER BY diagonal)),
parts AS (SELECT *, sum(n) OVER (PARTITION BY row, template ORDER BY diagonal) AS part FROM new),
covered AS (SELECT row, template, label, phrase, size, part, h.diagonal, unnest(range(spot, spot + k)) AS spot FROM hits h JOIN parts p USING (row, template, phrase, diagonal)),
spans AS (SELECT row, label, phrase, size, part, count(DISTINCT spot) AS n, min(diagonal + spot) AS first, max(diagonal + spot) AS last FROM covered GROUP BY row, template, label, phrase, size, part),
scored AS (SELECT *, n / greatest(size, last - first + 1) AS score FROM spans),
kept AS (SELECT * FROM scored WHERE CASE WHEN phrase THEN n = size ELSE score >= 0.6 END),
found AS (SELECT row, count(*) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word, max(first) FILTER (phrase) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (phrase)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score, count(*) AS n_spans FROM kept GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM docs LEFT JOIN found USING (row)"""


ORACLE_SQL: dict[str, str] = {
    "op8_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || doc_id::VARCHAR) AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM totals),
level AS (
  SELECT *, source_size * 3 / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER w, 0))::DOUBLE
      / (sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev
  FROM weighted
  WINDOW w AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT *, max(lev) OVER () AS l FROM level),
targets AS (
  SELECT source, source_size,
    CASE WHEN ratio < l THEN (source_size * 3)::DOUBLE ELSE least((source_size * 3)::DOUBLE, l * weight) END AS target
  FROM final),
running AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE budget END - before)))::BIGINT AS taken
FROM running
""",
    "op11_hard_negatives": """
WITH whole AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, w.id, w.label = a.label AS same, list_dot_product(a.x, w.x)::BIGINT AS score
  FROM whole a, whole w WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""",
    "op12_license_scan": _license_sql(),
}
