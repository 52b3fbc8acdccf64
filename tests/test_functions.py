import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioscan.functions import formulas, khmer, ocr_text, plain, vectors
from folioscan.functions.markdown import formula_spans


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<double>'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (r"Let $f(x)=x^2$ so $$\int_0^1 f(x)\,dx = \frac{1}{3}$$ holds.", ["$f(x)=x^2$", r"$$\int_0^1 f(x)\,dx = \frac{1}{3}$$"]),
        ("\\(a+b\\) and \\[c^2\\] and \\begin{align*}x\\end{align*}", ["\\(a+b\\)", "\\[c^2\\]", "\\begin{align*}x\\end{align*}"]),
        (r"Price \$5 and \$10, but $x$ is math", ["$x$"]),
        ("It costs $5 and $10 today", []),
        (r"ចម្លើយ $\text{ផលបូក} = 5$ ។", [r"$\text{ផលបូក} = 5$"]),
        ("$y$១", []),
        ("", []),
        (None, None),
    ],
)
def test_formulas(spark, text, found):
    assert one(spark, formulas.extract_formulas(F.col("t")), t=text) == found


def test_mask_round_trip_and_stable_tokens(spark):
    rnd = random.Random(1234)
    parts = ["$", "$$", "\\[", "\\]", "\\(", "\\)", "\\$", "a", " ", "\n", "ក", "5", "{", "}", "\\begin{align}", "\\end{align}"]
    texts = ["".join(rnd.choice(parts) for _ in range(40)) for _ in range(500)] + ["$x$ and $x$", "$$" + "a" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    m = df.select("t", formulas.mask_latex(F.col("t"), F.col("i").cast("string")).alias("m"))
    rows = m.select("t", "m.*", formulas.unmask_latex(F.col("m.masked"), F.col("m.vault"), strict=True).alias("back"), formulas.extract_formulas(F.col("t")).alias("f")).collect()
    for r in rows:
        assert r["back"] == r["t"]
        assert r["f"] == [r["t"][a:b] for a, b in formula_spans(r["t"])]
    again = df.repartition(7).select("t", formulas.mask_latex(F.col("t"), F.col("i").cast("string")).alias("m")).select("m.masked").collect()
    assert sorted(r[0] for r in again) == sorted(r["masked"] for r in rows)
    same = next(r for r in rows if r["t"] == "$x$ and $x$")
    assert len(same["vault"]) == 2 and set(same["vault"].values()) == {"$x$"}


def test_unknown_tokens(spark):
    token = "⟦MATH_" + "0" * 32 + "⟧"
    df = spark.createDataFrame([(token, {})], "t string, v map<string,string>")
    assert df.select(formulas.unmask_latex(F.col("t"), F.col("v"))).first()[0] == token
    with pytest.raises(PySparkException):
        df.select(formulas.unmask_latex(F.col("t"), F.col("v"), strict=True)).collect()


@pytest.mark.parametrize(("text", "ok"), [(r"\frac{a}{b}", True), (r"\{x\}", True), (r"\frac{a}{b", False), ("}{", False), ("", True)])
def test_braces(spark, text, ok):
    assert one(spark, formulas.has_balanced_braces(F.col("t")), t=text) is ok


@pytest.mark.parametrize(("f", "body", "display"), [("$$ a $$", " a ", True), ("\\[ b", "", True), ("\\( bcd", " b", False), ("$", "", False), ("$b$", "b", False), ("\\[c\\]", "c", True), ("\\(d\\)", "d", False), ("\\begin{align}e\\end{align}", "\\begin{align}e\\end{align}", True)])
def test_delimiters(spark, f, body, display):
    assert one(spark, formulas.strip_delimiters(F.col("t")), t=f) == body
    assert one(spark, formulas.is_display_formula(F.col("t")), t=f) is display


def test_clusters_and_pieces(spark):
    assert plain.clusters("ស្រឡាញ់") == ["ស្រ", "ឡា", "ញ់"]
    assert plain.clusters("ខ្ញុំ") == ["ខ្ញុំ"]
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("កខគ្ាិុ​ ab1$។⟦⟧\n") for _ in range(30)) for _ in range(300)]
    for t in texts:
        got = plain.pieces(t)
        assert "".join(got) == t and all(got)
    khmer_only = ["".join(rnd.choice("កខគង្ាិុ់") for _ in range(25)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in khmer_only], "t string")
    for r in df.select("t", khmer.regex_segment(F.col("t")).alias("u")).collect():
        assert "".join(r["u"]) == r["t"]


def test_normalise(spark):
    raw = "ក​ខ   គ\t\tឃ\r\n\n\n\nង﻿  \n"
    assert one(spark, khmer.normalize_khmer_text(F.col("t")), t=raw) == "កខ គ ឃ\n\nង"
    assert one(spark, khmer.normalize_khmer_text(F.col("t")), t="é") == "é"
    assert one(spark, khmer.normalize_khmer_text(F.col("t")), t=None) is None


@pytest.mark.parametrize(
    ("text", "language"),
    [("What is the derivative of this function?", "en"), ("$x^2 + y^2$", "km"), (r"Solve $\sqrt{x} = 4$ please", "en"), (r"គណនា $\lim_{x \to 0} \frac{\sin x}{x}$", "km"), ("", "km")],
)
def test_language(spark, text, language):
    assert one(spark, khmer.detect_language(F.col("t")), t=text) == language


def test_search_tokens():
    tokens = plain.search_tokens(r"គណនា $\int_0^1 x\,dx$ Area")
    assert {"\\int", "area", "x"} <= set(tokens)
    assert plain.search_tokens("។ ៕") == []


def test_garbled(spark):
    assert one(spark, khmer.looks_garbled(F.col("t")), t="េមេរៀន េរៀន ាន ិន " * 8) is True
    assert one(spark, khmer.looks_garbled(F.col("t")), t="មេរៀនទីមួយ" * 8) is False
    assert one(spark, khmer.looks_garbled(F.col("t")), t="េម") is False
    assert one(spark, khmer.looks_garbled(F.col("t")), t="មេរៀនទីមួយ - " * 8) is False
    assert one(spark, khmer.looks_garbled(F.col("t")), t="មេរៀនទីមួយ \uf021" * 8) is True


@pytest.mark.parametrize(("line", "words"), [("គណនា lim x→0 នៃ sin(3x)/x ។", "គណនា នៃ ។"), ("Exercise 1: (a) 2x + 3 = 0", ""), ("។ x = 1", ""), ("xាក្យ", "ក្យ"), ("រយ:ពេល ១៥០ នាទី", "រយៈពេល ១៥០ នាទី")])
def test_khmer_words(spark, line, words):
    assert one(spark, ocr_text.khmer_words_only(F.col("t")), t=line) == words


def test_small_text_columns(spark):
    assert one(spark, ocr_text.unwrap_khmer_text(F.col("t")), t=r"a $$\text{ខ្មែរ}$$ b $x + \text{ខ្មែរ}$") == r"a ខ្មែរ b $x + \text{ខ្មែរ}$"
    assert one(spark, ocr_text.clean_transcript(F.col("t")), t="```md\nabc\n```\n") == "abc"
    assert one(spark, ocr_text.clean_source_name(F.col("t")), t="C:\\x\\a<b>.md") == "ab.md"
    assert one(spark, ocr_text.clean_source_name(F.col("t")), t=None) == "document"


def test_markdown():
    text = "---\ntitle: x\n---\n# Head\nA [link](u) and ![alt](v) **bold** *it* `code` $[a](b)$\n<!-- gone -->\n> quote\n"
    clean = plain.clean_markdown(text)
    assert "Head" in clean and "link" in clean and "$[a](b)$" in clean and "gone" not in clean and "**" not in clean and "title" not in clean
    parts = plain.markdown_sections("# A\nx\n## B\ny\n```\n# no\n```\n### C\nz\n# D\nw")
    assert [p["heading"] for p in parts] == ["A", "A › B", "A › B › C", "D"]


def test_vectors(spark):
    a, b, z = [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]
    assert one(spark, vectors.cosine_similarity(F.col("x"), F.col("y")), x=a, y=b) == pytest.approx(2**-0.5)
    assert one(spark, vectors.cosine_similarity(F.col("x"), F.col("y")), x=a, y=z) == 0
    assert one(spark, vectors.l2_normalize(F.col("x")), x=z) == [0.0, 0.0]
    e = vectors.HashingEmbedder(128)
    assert abs(float((e.vector("find the limit") ** 2).sum()) - 1) < 1e-5 and not e.vector("").any()
