"""The text functions by name in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from folioscan.functions import khmer, ocr_text
from folioscan.functions.patterns import FORMULA_SPARK, HTML_TAG, TOKEN

UDFS = {
    "normalize_khmer_text": khmer.normalize_khmer_text,
    "insert_word_boundaries": khmer.insert_word_boundaries,
    "segment_khmer": khmer.segment,
    "segment_pieces": khmer.segment_pieces,
    "tokenize_for_search": khmer.tokenize_for_search,
    "clean_markdown": khmer.clean_markdown,
    "markdown_sections": khmer.markdown_sections,
    "khmer_words_only": ocr_text.khmer_words_only,
}


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Functions that Spark expressions make up: arguments, type, body.
EXPRESSIONS = {
    "extract_formulas": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, {_literal(FORMULA_SPARK)}, 0)"),
    "find_placeholders": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, {_literal(TOKEN)}, 0)"),
    "strip_html_tags": ("t STRING", "STRING", f"regexp_replace(t, {_literal(HTML_TAG)}, '')"),
    "strip_word_boundaries": ("t STRING", "STRING", "replace(t, '\u200b', '')"),
    "cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D), 0D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session's SQL; returns their names."""
    for name, function in UDFS.items():
        spark.udf.register(name, function)
    for name, (arguments, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return [*UDFS, *EXPRESSIONS]
