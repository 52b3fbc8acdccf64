import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.llm import canonical, defects, markup, queries, scans, sentences, shared_spans

DOC = "doc_id long, text string, key string"


def brute_pairs(texts, least):
    ids = sorted(texts)
    out = set()
    for i, a in enumerate(ids):
        runs = {texts[a][p : p + least] for p in range(len(texts[a]) - least + 1)}
        for b in ids[i + 1 :]:
            if any(texts[b][p : p + least] in runs for p in range(len(texts[b]) - least + 1)):
                out.add((a, b))
    return out


def test_shared_spans(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeកខ ") for _ in range(rnd.randint(1, 400)))
    texts = {i: word() for i in range(60)}
    for _ in range(40):
        a, b = rnd.sample(range(60), 2)
        n, at = rnd.randint(20, 90), rnd.randint(0, len(texts[a]))
        cut = rnd.randint(0, len(texts[b]))
        texts[b] = texts[b][:cut] + texts[a][at : at + n] + texts[b][cut:]
    texts |= {100: texts[0], 101: texts[1], 102: "x" * 300, 103: "x" * 50}
    rows = [(i, t, "clash") for i, t in texts.items()]
    df = spark.createDataFrame([*rows, rows[3], (200, None, "x"), (None, texts[0], "x"), (201, "", "x")], DOC)
    for least in (24, 40, 120):
        got = {(r.doc_id_a, r.doc_id_b) for r in shared_spans.pairs(df, least=least).collect()}
        assert got == brute_pairs(texts, least)
    assert shared_spans.pairs(df.limit(0), least=40).count() == 0
    c = {r.doc_id: r for r in shared_spans.coverage(df, least=40).collect()}
    linked = {x for p in brute_pairs(texts, 40) for x in p}
    for i, t in texts.items():
        assert (c[i].shared_chars > 0) == (i in linked) and c[i].shared_chars <= len(t)
        if c[i].copies == 1 and i in linked:
            others = [u for j, u in texts.items() if j != i]
            marked = [False] * len(t)
            for p in range(len(t) - 39):
                if any(t[p : p + 40] in u for u in others):
                    marked[p : p + 40] = [True] * 40
            assert c[i].shared_chars == sum(marked)
    assert c[200].n_chars == 0 and c[100].copies == 2


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.text("abc", min_size=24, max_size=40))
def test_anchors_of_a_common_run_agree(a, b, run):
    """Any run of the wanted length has an anchor, and two texts that share it have one in common."""
    size, w, _, _ = shared_spans.lengths(24)
    got = []
    for text in (a + run + b, b + run + a):
        h = shared_spans.window_hashes(shared_spans.code_points(text), size)[size:]
        at = shared_spans.anchor_places(h, w)
        assert not len(at) or (np.diff(at) <= w).all()
        start = text.index(run)
        got.append({int(h[p]) for p in at if start <= p and p + size <= start + len(run)})
    assert got[0] & got[1]


def test_stretches_of_repetitive_texts():
    a, b = shared_spans.code_points("x" * 20_000), shared_spans.code_points("x" * 20_000 + "y")
    assert shared_spans.stretches(a, b, 120) == [(0, 0, 20_000)]
    h = shared_spans.window_hashes(a, 48)[48:]
    assert len(shared_spans.anchor_places(h, 73)) < 2 * len(h) / 70


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters( exclude_categories=["Cs"]), max_size=12), min_size=1, max_size=8))
def test_canonical_forms_agree(texts):
    forms = [canonical.normalise(pa.array([unicodedata.normalize(n, t) for t in texts])).to_pylist() for n in ("NFC", "NFD")]
    assert forms[0] == forms[1]
    assert canonical.normalise(pa.array(forms[0])).to_pylist() == forms[0]


def test_canonical_forms_of_every_character():
    chars = [chr(c) for c in range(32, 0x110000 - 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    for mark in ("", "\u0301", "\u0323\u0301", "\u11a8"):
        forms = [canonical.normalise(pa.array([unicodedata.normalize(n, c + mark) for c in chars])).to_pylist() for n in ("NFC", "NFD")]
        assert forms[0] == forms[1]
        assert canonical.normalise(pa.array(forms[0])).to_pylist() == forms[0]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("ｔｒｉｅｄ", "tried", True), ("nаїve", "naïve", True), ("a b", "a b", True), ("ﬁnd", "find", True), ("st​ep", "step", True), ("ជ្រេីស", "ជ្រើស", True), ("អនុវត្ដ", "អនុវត្ត", True), ("Ω µ ∆", "Ω μ Δ", True),
        ("Case", "case", False), ("x²", "x2", False), ("①", "1", False), ("naive", "naïve", False), ("a  b", "a b", False), ("½", "1/2", False), ("α", "a", False), ("क्‍ष", "क्ष", False),
        ("\u1112\u1161\u11ab\u1100\u1173\u11af", "한글", True), ("می\u200cخواهم", "میخواهم", False), ("ꓢꓬ", "SY", True), ("Ꭺrm", "Arm", True), ("👨\u200d👩", "👨👩", False), ("a\u200db", "ab", True),
    ],
)
def test_look_alikes(a, b, same):
    x, y = canonical.normalise(pa.array([a, b])).to_pylist()
    assert (x == y) is same


def test_alike(spark):
    rows = [("prompt", 1, "hello"), ("prompt", 2, "hеllo"), ("prompt", 3, "hello"), ("prompt", 3, "hello"), ("prompt", 4, None), ("prompt", None, "hello"), ("prompt", 5, ""), ("section", 1, "hel​lo"), ("prompt", 6, "​")]
    df = spark.createDataFrame(rows, "item_kind string, item_id long, text string").withColumn("canonical", F.lit("clash"))
    assert {tuple(r) for r in canonical.alike(df).collect()} == {("prompt", 1, 2), ("prompt", 2, 3), ("prompt", 5, 6)}
    assert canonical.alike(df.limit(0)).count() == 0
    assert canonical.normalise(pa.array([None, "", "a" * 200_000])).to_pylist() == [None, "", "a" * 200_000]


@pytest.fixture(scope="module")
def scorer(spark):
    texts = ["The cat sat.\n\nIt ran. A dog came, and it left, but the cat stayed.\n\nOne day.", "有理的排列。\n\n线性的函数，而且精确，而且线性，而且简单。\n\n线性的函数。"] * 8
    return sentences.Scorer(sentences.opening_counts(spark.createDataFrame([(t,) for t in texts], "text string")))


@pytest.mark.parametrize(
    "units",
    [
        ["By No. 22 of Ch. II, a root scales the variance.", "The revision starts at 9 a.m.", "Another row follows, e.g. the first."],
        ["It equals 26.183 in lesson10.pdf below p. 21!!", "Why?", "(See Fig. C for its boundary.)", "That is all"],
        ['The note asks "Is it finite?" and then leaves.', 'The board says "Keep it."', "Every radius ends..."],
        ["This holds... the same bound follows.", "For $x. Y$ it is so?!", "$y = 3.5$ is next."],
        ["ជំហានទីមួយ ។", "«បំបែកប្រៀបធៀប!»", "គ្រូថា «ដើម្បី។» រួចបន្ត។", "ក្រុម ។ល។ លំហ៕"],
        ["「特殊的椭圆？」", "老师说「垂直的商数。」然后计算。", "无限的多项式约为62.5。"],
        ["सरल अवकलज को पाता है, उदा. $x$।", "छात्र पूछता है \"अचर है?\" फिर वह जाता है।"],
    ],
)
def test_sentences(scorer, units):
    for glue in (" ", "\n", "\n\n"):
        text = "  " + glue.join(units) + "\n"
        assert [text[a:b] for a, b in sentences.sentences(text, scorer)] == units


def test_every_inner_word_counts(spark):
    df = spark.createDataFrame([("One two, three two, four two",)] * 5, "text string")
    got = {k: n for k, n in sentences.opening_counts(df).items() if k[0] in "si"}
    assert got == {("s", "one"): 5, ("i", "two"): 15, ("i", "three"): 5, ("i", "four"): 5}


def test_closing_words_count(spark):
    df = spark.createDataFrame([("We see the Abk. of it, and the end.",)] * 40 + [("यह अंत है।",)] * 5, "text string")
    s = sentences.Scorer(sentences.opening_counts(df))
    assert s.closer("end") > 1 > -1 > s.closer("abk") and s.closer("है") > 0 == s.closer("unseen")
    assert s.closer("the") < -1


def test_sentence_rows(spark, scorer):
    df = spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (2, None), (3, " \n\n "), (None, "x"), (4, "a" * 100_000 + ". B"), (5, "。。。" * 2000)], "section_id long, text string").withColumn("start_pos", F.lit("clash"))
    got = sorted(tuple(r) for r in sentences.split_sentences(df).where("section_id < 4").collect())
    assert got == [(1, 0, 4), (1, 5, 9)]
    assert sentences.split_sentences(df.limit(0)).count() == 0


PAIR = "response_id long, answer string, language string, stop_reason string, prompt string"


def test_defects(spark):
    good = [(1000 + i, f"**Step 1:** We find the value {i} here.\n\n**Answer:** $x={i}$", "en", "stop", "Find x please") for i in range(60)] + [(2000 + i, "This is a full sentence with an end.", "en", "STOP", "Explain it") for i in range(60)]
    prompt = "Compare the endpoint and $z=3-4i$ for problem 10.49."
    cases = [
        (1, None, "en", "stop", "a", {"empty"}), (2, " ​ ", "en", None, "a", {"empty"}), (3, "**Answer:**", "en", "stop", "a", {"empty"}), (4, "N/A", "en", "stop", "a", {"empty"}), (5, "```\n```", "en", "stop", "a", {"empty"}),
        (6, "This is a full sentence with an end.", "en", "MAX_TOKENS", "a", {"truncated"}), (7, "This is half a sent", "en", "stop", "a", {"truncated"}), (8, "We see $x = \\frac{1", "en", "stop", "a", {"truncated"}),
        (9, "I'm sorry, but I can't help with that. Please ask your teacher.", "en", "stop", "a", {"refusal"}), (10, "I can't simplify this any further, so keep it. The value is found as above.", "en", "stop", "a", set()),
        (11, prompt, "en", "stop", prompt, {"echo"}), (12, f'You asked: "{prompt.lower()}"', "en", "stop", prompt, {"echo"}), (13, prompt[:-8], "en", "stop", prompt, {"echo"}), (14, prompt + "\n\n**Step 1:** This long solution has a real content in it.", "en", "stop", prompt, set()),
        (15, "ជំហានទីមួយគឺត្រឹមត្រូវ។", "en", "stop", "a", {"wrong_language"}), (16, "ជំហានទីមួយគឺត្រឹមត្រូវ។", "en", "stop", "Do it. Please answer in Khmer.", set()), (17, "$z=3$", "km", "stop", "a", set()), (18, "有理的排列。", "km", None, None, {"wrong_language"}),
    ]
    df = spark.createDataFrame([*good, *(c[:5] for c in cases)], PAIR).withColumn("defects", F.lit("clash"))
    got = {r.response_id: set(r.defects) for r in defects.label_pairs(df).collect()}
    assert {c[0]: got[c[0]] for c in cases if c[0] != 15 and c[0] != 16 and c[0] != 18} == {c[0]: c[5] for c in cases if c[0] not in (15, 16, 18)}
    assert "wrong_language" in got[15] and "wrong_language" not in got[16] and "wrong_language" in got[18]
    assert not any(got[g[0]] for g in good)
    assert defects.label_pairs(df.limit(0)).count() == 0


def page(n, body):
    return f"Common title of the book\n{body}\n- {n + 4} -"


def test_khmer_runs_are_read_to_the_end():
    r = scans.Reader(scans.Model({}, {}, {"នរណា": (10, 10), "ភាសា": (10, 10), "តម្លៃ": (10, 10)}))
    assert r.khmer_run("ឆរណា" * 9) == "នរណា" * 9  # more than six misread characters
    assert r.khmer_run("ភាសា" + "ហ្វូហ្វូ" + "ភាសាតម្លៃ" + "ឆរណា") == "ភាសា" + "ហ្វូហ្វូ" + "ភាសាតម្លៃ" + "នរណា"  # behind an unknown word


def test_scans(spark):
    clean = "The common function converges under every condition because another determinant follows. A well-defined value equals one. "
    rows = [(100 + i, "c", 1, False, clean * 3) for i in range(20)]
    body = ["The comm0n function conv¬\nerges under evcry condition", "because anothcr deter-\nminant follows. A well-\ndefined value", "equals one.", "The values are:\n42\n77", "The function follows."]
    rows += [(i, "s", i, True, page(i, body[i])) for i in range(5)]
    rows += [rows[0], rows[-1], (50, None, None, True, ""), (51, "s", None, None, "12"), (52, "s", 9, True, None), (None, "s", 9, True, "x")]
    df = spark.createDataFrame(rows, "section_id long, source string, page int, ocr boolean, text string").withColumn("headers", F.lit("clash"))
    out = {r.section_id: r for r in scans.repair_scans(df).collect()}
    found = {i: {(f.line_no, f.kind) for f in out[i].found} for i in range(5)}
    assert found[0] == {(0, "header"), (1, "misread"), (1, "hyphen"), (2, "misread"), (3, "page_number")}
    assert found[1] == {(0, "header"), (1, "misread"), (1, "hyphen"), (4, "page_number")}
    assert found[3] == {(0, "header"), (4, "page_number")}
    assert out[0].repaired == "The common function converges under every condition"
    assert out[1].repaired == "because another determinant follows. A well-defined value"
    assert out[50].found == [] and 51 not in out and 52 not in out
    assert scans.repair_scans(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "heading", "item", "code", "formula"),
    [
        ("# A\n\ntext $x$\n\n## B ##\n\nTitle\n=====\n\n- a\n  - b\n1. c\n\n```\n# no\n- no\n```\n\n* * *\n\n\\# no\n\n1986\\. no", 3, 3, 1, 1),
        ("<h1>A</h1><!-- <h2>no</h2> --><ul><li>a<li>b $y$</ul><pre><code>- no</code></pre><script>var a='<li>';</script><p>\\(z\\) &lt;li&gt;</p>", 1, 2, 1, 2),
        ("== A ==\n\n# one\n# two\n** three\n\n<nowiki>== no ==</nowiki>\n\n:<math>x</math>\n\n<syntaxhighlight lang=\"python\">\n# no\n</syntaxhighlight>\n\n[[B|c]]", 1, 3, 1, 1),
        ("\\section*{A}\n% \\section{no}\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\\begin{verbatim}\n$x$ \\item\n\\end{verbatim}\n\\begin{align}x\\end{align} costs \\$5 and \\$6", 1, 2, 1, 1),
        ("It costs $5 or $10. #1 is 3 * 4 * 5, a_b_c [2] < 5.", 0, 0, 0, 0),
        ("", 0, 0, 0, 0),
        (None, 0, 0, 0, 0),
        ("---\ntitle: x\n---\n\nbody", 0, 0, 0, 0),
    ],
)
def test_markup(text, heading, item, code, formula):
    clean, counts = markup.strip_markup(text)
    assert (counts["heading"], counts["list_item"], counts["code_block"], counts["formula"]) == (heading, item, code, formula)
    assert (clean is None) is (text is None)
    if clean:
        assert "<li" not in clean and "<h1" not in clean and "\\section" not in clean


def test_markup_keeps_content_and_drops_navigation():
    nav = "<div><a href='a'>Home</a> <a href='b'>News</a> <a href='c'>About us</a></div>"
    page_ = f"<html><head><title>t</title></head><body>{nav}<h2>Limits</h2><p>{'The limit of a function is unique. ' * 8}</p><p>$x$</p></body></html>"
    clean, _ = markup.strip_markup(page_)
    assert "## Limits" in clean and "The limit" in clean and "$x$" in clean and "News" not in clean
    assert markup.strip_markup("<b>" * 5000 + "x" + "- a\n" * 5000)[0] is not None


def test_headings(spark):
    rows = [(1, "A › **B** › C"), (2, "<b>A</b>&nbsp; › == B ==\\label{x}"), (3, None), (4, ""), (5, "$\\frac{a}{b}$ 2 * 3 * 4 › R&D › A* › (x < 2) › [1]"), (6, "\\emph{A} › [[B|C]] › {\\large D} › `E` › {#sec}")]
    df = spark.createDataFrame(rows, "item_id long, heading string")
    got = {(r.item_id, r.element, r.ordinal) for r in markup.heading_residue(df).collect()}
    assert got == {(1, "markdown", 2), (2, "html", 1), (2, "latex", 2), (6, "latex", 1), (6, "wiki", 2), (6, "latex", 3), (6, "markdown", 4), (6, "markdown", 5)}
    clean = {r.item_id: r.c for r in df.select("item_id", markup.clean_heading(F.col("heading")).alias("c")).collect()}
    assert clean[1] == "A › B › C" and clean[5] == rows[4][1] and clean[6] == "A › C › D › E › " and clean[3] is None
    assert markup.clean_documents(df.select("item_id", F.col("heading").alias("text"))).count() == 6


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() >= 0


def test_echo_costs_next_to_nothing():
    p = "Find the derivative of f(x) = 3x^2 + 5x at x = 2."
    for a in (p, p.upper(), f"You asked: {p}", p[:-12], "x = 2?"):
        assert defects.is_echo(a, "x = 2" if len(a) < 9 else p)
    for a in ("The derivative of f(x) is 6x + 5, so at x = 2 it is 17.", "17", "Find", p + " Its derivative is 6x + 5, and that gives the slope 17 at the place asked for."):
        assert not defects.is_echo(a, p)
    assert not defects.is_echo("", p) and not defects.is_echo(p, "")


def test_frames_without_content():
    for a in ("**ចម្លើយ៖**", "Answer:", "Solution: \u200b", "<p>&nbsp;</p>", "Step 1: Answer:", "…", "n/a"):
        assert defects.is_empty(a)
    for a in ("Answer: x", "4", "**ចម្លើយ៖** ៥", "none of these"):
        assert not defects.is_empty(a)


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("The teacher said «A. B. C. D.» and left the room.", 1),
        ("The teacher said «It is so. We know it. They agree. You do.» and left the room.", 1),
        ('He wrote "First we add. Then we divide. Last we check." and went on.', 1),
        ("The sum (We add. We carry. We check.) is right. It holds.", 2),
        ("It is so. «We know it.» They agree.", 3),
        ("He said: «no and went home. She stayed. They met.", 3),
        ("Let x = 3.14 and y = 2.71. Then x > y.", 2),
        ("One. " + "Two words here. " * 300 + "End.", 302),
    ],
)
def test_quotations_within_sentences(text, units):
    assert len(sentences.sentences(text, sentences.Scorer({}))) == units


@pytest.mark.parametrize(
    "text",
    [
        "# One\n\n- a\n- b\n\n```\n# no\n```\n\nso $x$ and \\$5",
        "<html><body><nav><ul><li><a href='x'>Home</a></li><li><a href='y'>More</a></li></ul></nav><div><h2>Two</h2><p>Long text about the sum of $a$ and $b$ in many words.</p><ol><li>one<li>two</ol></div></body></html>",
        "== Three ==\n# first\n# second\n'''bold''' [[Page|shown]] {{T|x}}",
        "\\section{Four}\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\\begin{verbatim}\n\\item no\n\\end{verbatim}",
        "Five\n====\n\n<!-- # gone -->\n<div><p>1</p><p>six</p>\n</div>",
    ],
)
def test_counts_are_those_of_the_clean_text(text):
    clean, counts = markup.strip_markup(text)
    code = clean.split("```")
    outside = "\n".join(code[::2]).split("\n")
    assert sum(line.startswith("#") for line in outside) == counts["heading"]
    assert sum(line.startswith("- ") for line in outside) == counts["list_item"]
    assert len(code) // 2 == counts["code_block"]
    again = markup.strip_markup(clean)[1]
    assert {**again, "formula": 0} == {**counts, "formula": 0}


def test_the_subtree_of_greatest_density_sum_is_the_content():
    links = "".join(f"<li><a href='{i}'>link number {i}</a></li>" for i in range(12))
    prose = "".join(f"<p>A paragraph of running text, number {i}, that says something at length about its matter.</p>" for i in range(6))
    root, runs = markup.tree(f"<div><ul>{links}</ul></div><div id='m'>{prose}</div><p><a>Contact</a></p>")
    top = markup.densities(root, runs)
    assert top.tag == "div" and [k.tag for k in top.kids] == ["p"] * 6 and top.content
    assert not root.content and not root.kids[0].content


def test_chances_of_confusions_are_estimated(spark):
    """The confusion that the scans show gets its share, the others next to none, and a frequent misreading stays one on a larger corpus."""
    plain = [(False, "the other method gives another result here ")] * 200
    scan = [(True, "the other method gives another result here ")] * 80 + [(True, "tbe otber metbod gives anotber result bere ")] * 20
    for times in (1, 8):
        df = spark.createDataFrame((plain + scan) * times, "ocr boolean, text string")
        model = scans.learn(df, 1000, 1000, 100)
        assert 0.1 <= model.latin_chances["b", "h"] <= 0.2 and model.latin_chances["c", "e"] < 0.01
        reader = scans.Reader(model)
        assert reader.viterbi("tbe otber metbod gives".split()) == "the other method gives".split()
        assert reader.viterbi("the other".split()) == "the other".split()
