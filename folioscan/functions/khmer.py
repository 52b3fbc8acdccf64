"""Language functions: normalising, segmenting, ratio, language, garbled text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions import plain
from folioscan.functions.patterns import BROKEN_GLYPH, FORMULA_SPARK, KHMER, ORPHAN_MARK, TOKEN, ZWSP


def _each(fn):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else fn(t))

    return run


SECTIONS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("starts_heading", T.BooleanType())]))
#: Arrow-batched text functions: Spark has no NFC and no cluster rules.
normalize_khmer_text = F.pandas_udf(_each(plain.normalise), T.StringType())
insert_word_boundaries = F.pandas_udf(_each(plain.mark_words), T.StringType())
#: Both in one call; not deterministic for the planner, so that a filter on the result doesn't run it again.
normalize_and_mark = F.pandas_udf(_each(lambda t: plain.mark_words(plain.normalise(t))), T.StringType()).asNondeterministic()
segment = F.pandas_udf(_each(plain.words), T.ArrayType(T.StringType()))
segment_pieces = F.pandas_udf(_each(plain.pieces), T.ArrayType(T.StringType()))
tokenize_for_search = F.pandas_udf(_each(plain.search_tokens), T.ArrayType(T.StringType()))
clean_markdown = F.pandas_udf(_each(plain.clean_markdown), T.StringType())
PARTS = T.ArrayType(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("starts_heading", T.BooleanType()), T.StructField("path", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType())])))])
)
page_parts = F.pandas_udf(_each(plain.page_parts), PARTS)
markdown_sections = F.pandas_udf(_each(plain.markdown_sections), SECTIONS)


def segment_with(segmenter: Callable[[str], list[str]]):
    """A column function that cuts text into pieces with a word segmenter; it is sent to the executors."""
    return F.pandas_udf(_each(lambda t: plain.pieces(t, segmenter)), T.ArrayType(T.StringType()))


def regex_segment(text: Column) -> Column:
    """Orthographic clusters of Khmer text without leaving the JVM; a stray mark joins the cluster before it."""
    units = F.regexp_extract_all(text, F.lit(r"(?s)[ក-ឳ](?:្[ក-ឳ]|[឴-៑៓៝]++|[\x{200C}\x{200D}](?=[ក-៝]))*+[឴-៓៝]*+|[០-៩៰-៹]++|.[឴-៓៝]*+"), F.lit(0))
    return F.filter(units, lambda u: u != "")


def strip_word_boundaries(text: Column) -> Column:
    return F.translate(text, ZWSP, "")


def contains_khmer(text: Column) -> Column:
    return text.rlike(f"[{KHMER}]")


def without_formulas(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, FORMULA_SPARK, " "), TOKEN, " ")


def _letters(text: Column, masked: bool) -> tuple[Column, Column]:
    t = without_formulas(text) if masked else text
    return F.regexp_count(t, F.lit(f"[{KHMER}&&\\p{{L}}]")), F.regexp_count(t, F.lit("[A-Za-z]"))


def khmer_ratio(text: Column, *, masked: bool = True) -> Column:
    """Khmer letters among Khmer and ASCII letters, formulas left out; 0 without letters."""
    k, a = _letters(text, masked)
    return F.when(k + a > 0, k / (k + a)).otherwise(F.lit(0.0))


def detect_language(text: Column, default: str = "km", *, masked: bool = True) -> Column:
    """km from a ratio of 0.3, else en; the default without letters."""
    k, a = _letters(text, masked)
    return F.when(k + a == 0, F.lit(default)).when(k / (k + a) >= 0.3, "km").otherwise("en")


def looks_garbled(text: Column, threshold: float = 0.02, min_khmer: int = 20) -> Column:
    """Whether orphaned marks and broken glyphs are more than ``threshold`` of the Khmer characters."""
    k = F.regexp_count(text, F.lit(f"[{KHMER}]"))
    bad = F.regexp_count(text, F.lit(ORPHAN_MARK)) + F.regexp_count(text, F.lit(BROKEN_GLYPH))
    return (k >= min_khmer) & (bad / k > threshold)
