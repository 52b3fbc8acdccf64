"""Formula functions as Spark columns: masking, restoring, listing and checking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions.patterns import FORMULA_SPARK, TOKEN


def extract_formulas(text: Column) -> Column:
    """All formulas in order, as they stand."""
    return F.regexp_extract_all(text, F.lit(FORMULA_SPARK), F.lit(0))


def weave(gaps: Column, marks: Column) -> Column:
    """Texts around matches (one more than marks) and the marks between them, joined."""
    return F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit("")))), "")


def mask_latex(text: Column, key: Column) -> Column:
    """struct(masked, vault): each formula replaced by a token made from ``key`` and its ordinal, so that reruns agree.

    ``key`` must differ between texts whose tokens may meet. Null text gives null fields.
    """
    formulas = extract_formulas(text)
    tokens = F.transform(formulas, lambda _, i: F.concat(F.lit("⟦MATH_"), F.substring(F.sha2(F.concat(key, F.lit("\0"), i.cast("string")), 256), 1, 32), F.lit("⟧")))
    return F.struct(weave(F.split(text, FORMULA_SPARK, -1), tokens).alias("masked"), F.map_from_arrays(tokens, formulas).alias("vault"))


def find_placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def contains_placeholder(text: Column) -> Column:
    return text.rlike(TOKEN)


def unmask_latex(text: Column, vault: Column, *, strict: bool = False) -> Column:
    """Tokens replaced by their formulas; unknown ones stay, or raise an error where ``strict``."""
    marks = find_placeholders(text)
    done = weave(F.split(text, TOKEN, -1), F.transform(marks, lambda m: F.coalesce(F.element_at(vault, m), m)))
    if not strict:
        return F.when(vault.isNull(), text).otherwise(done)
    missing = F.exists(marks, lambda m: F.coalesce(F.element_at(vault, m), F.lit(None)).isNull())
    return F.when(missing, F.raise_error(F.lit("a formula token has no entry in the vault")).cast("string")).otherwise(done)


def sub_vault(text: Column, vault: Column) -> Column:
    """The part of the vault whose tokens stand in the text."""
    return F.map_filter(vault, lambda k, _: F.instr(text, k) > 0)


def strip_delimiters(formula: Column) -> Column:
    """What stands between the delimiters, blanks included; environments stay as they are.

    A formula that opens with a bracket is cut at both ends even where the closing one is missing.
    """

    def inner(n: int) -> Column:
        return F.substring(formula, F.lit(n + 1), F.greatest(F.length(formula) - 2 * n, F.lit(0)))

    brackets = formula.startswith("\\[") | formula.startswith("\\(")
    return F.when((formula.startswith("$$") & formula.endswith("$$")) | brackets, inner(2)).when(formula.startswith("$") & formula.endswith("$"), inner(1)).otherwise(formula)


def is_display_formula(formula: Column) -> Column:
    return formula.startswith("$$") | formula.startswith("\\[") | formula.startswith("\\begin")


def has_balanced_braces(text: Column) -> Column:
    """Whether unescaped braces never close too early and all close."""
    marks = F.regexp_extract_all(F.regexp_replace(text, r"(?s)\\.", ""), F.lit(r"[{}]"), F.lit(0))
    state = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda a, m: F.struct(
            (a.depth + F.when(m == "{", 1).otherwise(-1)).alias("depth"),
            F.least(a.least, a.depth + F.when(m == "{", 1).otherwise(-1)).alias("least"),
        ),
    )
    return (state.depth == 0) & (state.least >= 0)


def restored_length(text: Column, vault: Column) -> Column:
    """Code points of the text without word marks, each token counted at the length of its formula."""
    more = F.aggregate(find_placeholders(text), F.lit(0), lambda n, m: n + F.coalesce(F.length(F.element_at(vault, m)) - F.length(m), F.lit(0)))
    return F.length(F.translate(text, "​", "")) + F.coalesce(more, F.lit(0))
