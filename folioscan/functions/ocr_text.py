"""Text functions for recogniser output, and escaping for prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters and digits that a word is built on, signs that cannot begin one, sentence marks, joiners.
_BASES, _MARKS, _STOPS, _JOINERS = "ក-ឳ០-៩", "឴-៓៝", "។-៚", "\u200c\u200d"
_nfc = F.pandas_udf(lambda s: s.str.normalize("NFC"), T.StringType())


def khmer_words_only(text: Column) -> Column:
    """The Khmer words of a line and the sentence marks behind them, single-spaced.

    A colon between Khmer letters is a sign misread. Marks at the beginning of a word belong to a letter
    that was lost; sentence marks before the first word are dropped. Only NFC leaves the JVM.
    """
    return F.element_at(F.transform(F.array(_nfc(text)), _words_of), 1)


def _words_of(text: Column) -> Column:
    line = F.regexp_replace(text, "(?<=[ក-៓]):(?=[ក-ឳ])", "ៈ")
    words = F.regexp_extract_all(line, F.lit(f"[{_BASES}{_MARKS}{_STOPS}៰-៹᧠-᧿{_JOINERS}ៗ៛ៜ]+"), F.lit(0))
    words = F.transform(words, lambda w: F.regexp_replace(w, f"^[{_MARKS}{_JOINERS}]+|[{_JOINERS}]+$", ""))
    first = F.array_position(F.transform(words, lambda w: w.rlike(f"[{_BASES}]")), True)
    return F.array_join(F.filter(words, lambda w, i: w.rlike(f"[{_BASES}]") | ((first > 0) & (i >= first) & w.rlike(f"^[{_STOPS}]+$"))), " ")


def unwrap_khmer_text(text: Column) -> Column:
    r"""``$$ \text{Khmer} $$`` and ``$ \text{Khmer} $`` as plain prose where that is all they hold."""
    khmer = r"\\text\{([^{}$]*[ក-៿][^{}$]*)\}"
    text = F.regexp_replace(text, rf"\$\$\s*{khmer}\s*\$\$", "$1")
    return F.regexp_replace(text, rf"\$\s*{khmer}\s*\$", "$1")


def clean_transcript(text: Column) -> Column:
    """Trimmed, without one code fence around the whole."""
    t = F.regexp_replace(text, r"(?sU)^\s+|\s+\z", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?s)\A```[A-Za-z]*\n(.*)\n?```\z", "$1"), r"(?sU)^\s+|\s+\z", "")


def escape_passage(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("</passage"), F.lit("&lt;/passage")), F.lit("</context"), F.lit("&lt;/context"))


def escape_attribute(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def needs_ocr(text: Column, min_chars: int = 20, mode: str = "auto") -> Column:
    """Whether a page's text layer is missing, too short or garbled."""
    from folioscan.functions.khmer import looks_garbled

    if mode == "always":
        return F.lit(True)
    short = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?sU)^\s+|\s+\z", "")) < min_chars
    return short | F.coalesce(looks_garbled(text), F.lit(False))


def clean_source_name(name: Column, fallback: str = "document") -> Column:
    """Base name without control and reserved characters, 200 characters at most."""
    base = F.regexp_extract(F.translate(F.coalesce(name, F.lit("")), "\\", "/"), r"([^/]*)/*$", 1)
    base = F.regexp_replace(base, r"(?U)^\s+|\s+$", "")
    base = F.when(base == "", F.lit(fallback)).otherwise(base)
    return F.substring(F.regexp_replace(base, r'[\p{C}\p{Zl}\p{Zp}<>"|?*]', ""), 1, 200)
