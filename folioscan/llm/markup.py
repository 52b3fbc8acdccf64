"""Markup residue: HTML, Markdown, wiki and LaTeX to clean text with headings, lists, code and formulas.

Text is read once from left to right: what stands in comments, code, scripts, metadata or is escaped is
set aside first, wherever it begins first. Headings and list items of any notation then get a mark where
they begin. HTML is read as a tree of nodes, each with its composite text density (characters per tag,
lowered by link text); the node with the greatest sum of its children's densities holds the main text, and
the least density on the way from it to the body is the threshold: from the body down, each node at or
above it gives the subtree of greatest sum within itself to the content. The rest is boilerplate, but for
what is marked. The elements are counted in the result, so the counts are those of the clean text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions import markdown as md

ELEMENTS = ("heading", "list_item", "code_block", "formula")
RESIDUE = ("html", "markdown", "wiki", "latex")
# Environments of LaTeX.
CODE_ENVS = "verbatim|Verbatim|lstlisting|minted|alltt|comment"
MATH_ENVS = "equation|align|alignat|flalign|gather|multline|eqnarray|displaymath|math|array|matrix|pmatrix|bmatrix|vmatrix|cases|split|aligned|gathered"

SCAN = re.compile(
    rf"""
    (?P<front>\A\ufeff?---[ \t]*\n(?:[^\n]*\n)*?(?:---|\.\.\.)[ \t]*(?:\n|\Z))
  | (?P<comment><!--.*?(?:-->|\Z))
  | (?P<fence>^[ ]{{0,3}}(?P<ticks>`{{3,}}|~{{3,}})[^\n]*\n(?P<fenced>.*?)(?:^[ ]{{0,3}}(?P=ticks)[`~]*[ \t]*$|\Z))
  | (?P<drop><(?P<dropped>script|style|head|template|noscript)\b[^>]*>.*?(?:</(?P=dropped)\s*>|\Z))
  | (?P<pre><(?P<tag>pre|syntaxhighlight|source)\b[^<>]*>(?P<code>.*?)(?:</(?P=tag)\s*>|\Z))
  | (?P<nowiki><(?P<lit>nowiki|code|tt|kbd|samp)\b[^<>]*>(?P<shown>.*?)</(?P=lit)\s*>)
  | (?P<mathml><math\b[^<>]*>(?P<mathbody>.*?)</math\s*>)
  | (?P<verb>\\begin\{{(?P<venv>{CODE_ENVS})\}}(?:\[[^\]\n]*\])?(?:\{{[^}}\n]*\}})?(?P<verbatim>.*?)(?:\\end\{{(?P=venv)\}}|\Z))
  | (?P<mathenv>\\begin\{{(?P<menv>(?:{MATH_ENVS})\*?)\}}.*?\\end\{{(?P=menv)\}})
  | (?P<inlineverb>\\(?:verb|lstinline)\*?(?P<bar>[|!+"/]).*?(?P=bar))
  | (?P<escape>\\[\\$%&\#_{{}}*`~\-+.!>|=<](?!\w*\{{))
  | (?P<display>\$\$(?:[^$\\]|\\.)+?\$\$|\\\[.+?\\\]|\\\(.+?\\\))
  | (?P<inline>\$(?=[^\s$])(?:[^$\\\n]|\\[^\n])*?(?<=\S)\$(?![0-9]))
  | (?P<tick>(?<!`)(?P<q>`{{1,2}})(?![`'])(?P<ticked>[^`\n]+?)(?P=q)(?!`))
  """,
    re.S | re.M | re.X | re.I,
)
TEX_COMMENT = re.compile(r"(?m)(?<!\\)%[^\n]*")
CODE, FORMULA, HEADING, LISTED, DEEPER = "\x02", "\x01", "\x03", "\x04", "\x05"  # DEEPER behind HEADING for each level below the first
MARKS = dict.fromkeys(map(ord, (CODE, FORMULA, HEADING, LISTED, DEEPER)))

WIKI_SIGNS = re.compile(r"^={2,6}[ \t]*[^=\s].*={2,6}[ \t]*$|'''|\[\[[^\]\n]+\]\]|\{\{[^}\n]*\}\}|^\{\||<nowiki|<syntaxhighlight|<ref\b|<math>(?!\s*<)", re.M | re.I)
MARKDOWN_SIGNS = re.compile(r"^(?:```|~~~)|^#{1,6} \*\*|^#{1,6} .*[^#\s] #+$|^ *[-+] |^\|?[ ]*:?-{3,}[ ]*\||\[\^\w+\]|(?<!\w)__\w|~~\w|\]\([^)\n]*\)|(?<=\S)\n(?:=|-){3,}[ \t]*$|^ *\d+[.)] ", re.M)
LATEX_SIGNS = re.compile(r"\\(?:documentclass|usepackage|(?:sub)*section|chapter|begin|end|emph|textbf|textit|texttt|item|label|ref|footnote|cite|vspace|noindent)\b")
HTML_SIGNS = re.compile(r"<(?:html|body|p|div|h[1-6]|ul|ol|li|table|br|span|a|b|i|em|strong)\b[^<>]*>", re.I)

HTML_HEADING = re.compile(r"<h([1-6])\b[^<>]*>(.*?)(?:</h\1\s*>|(?=<h[1-6]\b)|\Z)", re.S | re.I)
HTML_ITEM = re.compile(r"<li\b[^<>]*>", re.I)
TEX_HEADING = re.compile(r"\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\s*(?:\[[^\]\n]*\])?\s*\{((?:[^{}]|\{[^{}]*\})*)\}")
TEX_ITEM = re.compile(r"\\item\b")
WIKI_HEADING = re.compile(r"^(={1,6})(?!=)[ \t]*(.*?[^=\s].*?)[ \t]*(?<!=)\1[ \t]*$")
ATX = re.compile(r"^ {0,3}#{1,6}[ \t]+(?!#*[ \t]*$)(.+?)(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r"^ {0,3}(?:={2,}|-{2,})[ \t]*$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"^([ \t]*)(?:[-+*•‣◦–]|\d{1,9}[.)]|[០-៩]{1,3}[.)]|\([a-z0-9]{1,2}\))[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)")
WIKI_ITEM = re.compile(r"^[*#:;]*[*#][ \t]*(?=[^\s*#:;])")


def set_aside(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Text with CODE and FORMULA marks in place of code blocks and formulas, and their (kind, body) in order."""
    kept: list[tuple[str, str]] = []

    def put(kind: str, body: str) -> str:
        kept.append((kind, body))
        return CODE if kind == "code_block" else FORMULA

    def take(m: re.Match) -> str:
        kind = m.lastgroup if m.lastgroup in ("front", "comment", "escape", "display", "inline") else next(g for g in ("front", "comment", "fence", "drop", "pre", "nowiki", "mathml", "verb", "mathenv", "inlineverb", "escape", "display", "inline", "tick") if m.group(g) is not None)
        if kind == "front":
            return "" if re.search(r"^[\w-]+[ \t]*:", m.group(), re.M) else m.group()
        if kind in ("comment", "drop"):
            return "\n" if "\n" in m.group() else ""
        if kind == "fence":
            return put("code_block", m.group("fenced")) + "\n"
        if kind == "pre":
            code = m.group("code")
            inner = re.fullmatch(r"\s*<code\b[^<>]*>(.*?)(?:</code\s*>)?\s*", code, re.S | re.I)
            return put("code_block", html.unescape(inner.group(1) if inner else code))
        if kind == "verb":
            return "" if m.group("venv") == "comment" else put("code_block", m.group("verbatim"))
        if kind == "nowiki":
            return _literal(m.group("shown"))
        if kind == "tick":
            return _literal(m.group("ticked"))
        if kind == "inlineverb":
            return ""
        if kind == "escape":
            return _literal(m.group()[1:])
        return put("formula", m.group())

    if LATEX_SIGNS.search(text):
        parts, at = [], 0
        for m in SCAN.finditer(text):  # percent signs inside code and formulas are none
            parts += [TEX_COMMENT.sub("", text[at : m.start()]), m.group()]
            at = m.end()
        text = "".join([*parts, TEX_COMMENT.sub("", text[at:])])
    return SCAN.sub(take, text), kept


#: Characters with a meaning in markup and the private ones that stand for them in literal text.
SIGNS = "#*=-+<>&`~_[]{}|\\$.)(!:;'"
HIDE = {ord(c): 0xF700 + i for i, c in enumerate(SIGNS)}
SHOW = {v: chr(k) for k, v in HIDE.items()}


def _literal(text: str) -> str:
    return html.unescape(text).translate(HIDE)


def is_wiki(text: str, plain: str) -> bool:
    """Whether # at a line start means a numbered list rather than a heading; neighbouring such lines are one."""
    wiki, markdown = len(WIKI_SIGNS.findall(text)), len(MARKDOWN_SIGNS.findall(text))
    if wiki != markdown:
        return wiki > markdown
    return bool(re.search(r"^#+ [^\n]*\n#+ ", plain, re.M))


class Node:
    __slots__ = ("chars", "content", "density", "density_sum", "kids", "link_chars", "link_tags", "parent", "peak", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids, self.content, self.peak = tag, parent, [], False, self
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.density_sum = 0.0


TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*?(/?)>")
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "wbr"}
BLOCK = {"p", "div", "section", "article", "table", "tr", "ul", "ol", "li", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "body", "html", "main", "nav", "footer", "header", "aside", "center", "dl", "dt", "dd", "figure"}
KEEP = {"h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th"}


def tree(text: str) -> tuple[Node, list[tuple[Node, str]]]:
    """Root of the nodes and the texts with the node they stand in, in order."""
    root = here = Node("body", None)
    runs: list[tuple[Node, str]] = []
    at = 0
    for m in TAG.finditer(text):
        if m.start() > at:
            runs.append((here, text[at : m.start()]))
        at = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
        elif tag in VOID or m.group(3):
            here.tags += 1
            runs.append((here, "\n" if tag in ("br", "hr") else ""))
        else:
            if tag in ("li", "p", "tr", "td", "th", "dt", "dd") and here.tag == tag:
                here = here.parent
            node = Node(tag, here)
            here.kids.append(node)
            here = node
    runs.append((here, text[at:]))
    return root, runs


def densities(root: Node, runs: list[tuple[Node, str]]) -> Node:
    """Fill in densities and mark content nodes; returns the node of the main text."""
    for node, text in runs:
        node.chars += len("".join(text.split()))
    stack, order = [root], []
    while stack:
        n = stack.pop()
        order.append(n)
        stack += n.kids
    for n in reversed(order):
        for k in n.kids:
            n.chars += k.chars
            n.tags += k.tags + 1
            n.link_chars += k.link_chars
            n.link_tags += k.link_tags + (k.tag == "a")
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags
    body = max(root.chars, 1)
    for n in order:
        c, t = n.chars, max(n.tags, 1)
        if not c:
            continue
        lc, lt = max(n.link_chars, 1), max(n.link_tags, 1)
        base = math.log(c / max(c - n.link_chars, 1) * n.link_chars + root.link_chars / body * c + math.e)
        n.density = c / t * math.log(max(c / lc * t / lt, 1.0001)) / max(math.log(base), 1.0)
    for n in order:
        n.density_sum = sum(k.density for k in n.kids) or n.density
    for n in reversed(order):
        n.peak = max([n, *(k.peak for k in n.kids)], key=lambda x: x.density_sum)
    threshold, n = root.peak.density, root.peak
    while n is not None:
        threshold = min(threshold, n.density)
        n = n.parent
    stack = [root]
    while stack:
        n = stack.pop()
        if n.density >= threshold:
            n.peak.content = True
            if n.peak is not n:  # what stands beside the subtree may hold another
                stack += [k for k in n.kids if k.peak is not n.peak]
        else:
            stack += n.kids
    return root.peak


def html_text(text: str) -> str:
    """The marked HTML as lines, boilerplate left out but for marked elements."""
    root, runs = tree(text)
    densities(root, runs)
    out: list[str] = []
    last: Node | None = None
    for node, run in runs:
        up, keep, links, element = node, False, False, False
        while up is not None:
            keep = keep or up.content or up.tag in KEEP
            links = links or up.tag in ("nav", "footer") or (up.tag in ("ul", "ol", "div", "p") and up.chars > 0 and up.link_chars > 0.9 * up.chars and up.link_tags > 2)
            element = element or up.tag == "li" or re.fullmatch("h[1-6]", up.tag) is not None
            up = up.parent
        if not (element or (keep and not links)) and not any(m in run for m in (CODE, FORMULA, HEADING, LISTED)):
            continue
        block = node
        while block.parent is not None and block.tag not in BLOCK:
            block = block.parent
        if block is not last:
            out.append("\n" if block.tag == "li" and last is not None and last.tag in ("li", "ul", "ol") else "\n\n")
            if run.strip():
                last = block
        out.append(run)
    return html.unescape("".join(out))


TIDY = (
    (re.compile(r"\\(?:documentclass|usepackage|begin|end|label|vspace|hspace|maketitle|tableofcontents|bibliography\w*|pagestyle|thispagestyle|newpage|clearpage|noindent|centering|large|Large|small|bigskip|medskip|smallskip|includegraphics|cite\w*|ref|eqref|pageref)\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\}){0,2}"), ""),
    (re.compile(r"\\(?:footnote|thanks|index)\{[^{}]*\}"), ""),
    (re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}"), r"\1"),
    (re.compile(r"``([^`'\n]*)''"), r"“\1”"),
    (re.compile(r"<ref\b[^<>]*>.*?</ref>|<ref\b[^<>]*/>", re.S | re.I), ""),
    (re.compile(r"\[\[(?:Category|File|Image):[^\]\n]*\]\]", re.I), ""),
    (re.compile(r"\[\[(?:[^\]|\n]*\|)?([^\]|\n]*)\]\]"), r"\1"),
    (re.compile(r"\{\{[^{}|\n]*\}\}"), ""),
    (re.compile(r"\{\{(?:[^{}|\n]*\|)+([^{}|\n]*)\}\}"), r"\1"),
    (re.compile(r"'{2,5}([^'\n]+)'{2,5}"), r"\1"),
    (re.compile(r"^\{\|.*$|^\|\}.*$|^\|-+.*$", re.M), ""),
    (re.compile(r"\[\^\w+\]:?|\{#[\w-]+\}"), ""),
)


def tidy(text: str) -> str:
    """Text without what is left of inline markup, quotation signs and table rules."""
    for rx, to in TIDY:
        text = rx.sub(to, text)
    for spans in (md.links, md.links):
        text = md.cut(text, spans(text))
    for sign in ("**", "__", "~~"):
        text = md.cut(text, md.emphasis(text, sign))
    text = md.cut(text, md.italics(text))
    lines = [_unquoted(x) for x in text.split("\n") if not (x.strip() and md.is_table_rule(x))]
    text = "\n".join(lines)
    return md.cut(text, md.tags(text))


def _unquoted(line: str) -> str:
    body = line.lstrip()
    return body[1:].lstrip() if body.startswith(">") else line


def _head(level: int) -> str:
    return HEADING + DEEPER * (level - 1)


def mark(plain: str, wiki: bool) -> str:
    """The text with HEADING and LISTED where headings and list items begin, in any notation."""
    lines, marked = plain.split("\n"), []
    skip = listed = False
    for i, line in enumerate(lines):
        if skip:
            skip = False
            continue
        bare = re.sub(r"^(?:[ \t]{0,3}>[ \t]?)+", "", line)
        m = None
        if not bare.strip() or bare.lstrip().startswith("<"):
            marked.append(line)
            listed = listed and not bare.strip()
            continue
        if RULE.match(bare):
            listed = False
            continue
        if w := WIKI_HEADING.match(bare.strip()):
            marked.append(_head(len(w.group(1))) + w.group(2))
            listed = False
        elif wiki and (m := WIKI_ITEM.match(bare)):
            marked.append(LISTED + bare[m.end() :])
            listed = True
        elif not wiki and (m := ATX.match(bare)):
            marked.append(_head(bare[: m.start(1)].count("#")) + m.group(1))
            listed = False
        elif (m := ITEM.match(bare)) and (listed or len(m.group(1).expandtabs(4)) < 4):
            marked.append(LISTED + bare[m.end() :])
            listed = True
        elif i + 1 < len(lines) and UNDERLINE.match(lines[i + 1]) and "|" not in bare and bare.strip() not in (CODE, FORMULA):
            marked.append(_head(2 - ("=" in lines[i + 1])) + bare.strip())
            skip = True
            listed = False
        else:
            marked.append(line)
    text = "\n".join(marked)
    text = HTML_HEADING.sub(lambda m: m.group()[: m.start(2) - m.start()] + _head(int(m.group(1))) + m.group()[m.start(2) - m.start() :] if re.sub(r"<[^<>]*>", "", m.group(2)).strip() else m.group(), text)
    text = HTML_ITEM.sub(lambda m: m.group() + LISTED, text)
    text = TEX_HEADING.sub(lambda m: f"\n\n{HEADING}{m.group(1).strip()}\n\n" if m.group(1).strip() else m.group(), text)
    return TEX_ITEM.sub("\n" + LISTED, text)


def strip_markup(text: str | None) -> tuple[str | None, dict[str, int]]:
    """Clean text and how many elements of each kind it has."""
    counts = dict.fromkeys(ELEMENTS, 0)
    if text is None:
        return None, counts
    text = text.replace("\r\n", "\n").replace("\r", "\n").translate(MARKS)
    plain, kept = set_aside(text)
    marked = mark(plain, is_wiki(text, plain))
    clean = tidy(html_text(marked) if HTML_SIGNS.search(plain) else marked)
    for kind, sign in zip(ELEMENTS, (HEADING, LISTED, CODE, FORMULA), strict=True):
        counts[kind] = clean.count(sign)
    blocks = iter(b for k, b in kept if k == "code_block")
    maths = iter(b for k, b in kept if k == "formula")
    clean = re.sub(CODE, lambda m: "\n\n```\n" + next(blocks, "").strip("\n") + "\n```\n\n", clean)
    clean = re.sub(FORMULA, lambda m: next(maths, ""), clean).translate(SHOW)
    clean = re.sub(rf"[ \t]*\n?{LISTED}[ \t]*", "\n- ", re.sub(rf"\s*{HEADING}({DEEPER}*)\s*", lambda m: "\n\n" + "#" * (len(m.group(1)) + 1) + " ", clean))
    clean = re.sub(r"[ \t]+\n", "\n", clean)
    return re.sub(r"\n{3,}", "\n\n", clean).strip(), counts


OUT = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("clean", T.StringType()),
        T.StructField("counts", T.MapType(T.StringType(), T.IntegerType())),
    ]
)


def clean_documents(docs: DataFrame) -> DataFrame:
    """Clean text and element counts of (item_id, text).

    A null text gives null and no elements, an empty one empty text; null ids are kept. Repeated rows
    give repeated rows. Unclosed code and comments reach to the end of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [strip_markup(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([list(g[1].items()) for g in got], pa.map_(pa.string(), pa.int32()))], names=OUT.names
            )

    return docs.select(F.col("item_id").cast("long"), "text").mapInArrow(run, OUT)


#: Formulas in headings, as Spark patterns.
HEADING_FORMULA = r"(?s)\$\$[^$]+\$\$|(?<!\\)\$(?=\S)[^$]*\$|\\\([^\n]*?\\\)|\\\[[^\n]*?\\\]|⟦MATH_[0-9a-f]{32}⟧"
HEADING_RESIDUE = {
    "html": r"</?[A-Za-z][A-Za-z0-9-]*(\s[^<>]*)?/?>|<!--|&([A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});",
    "markdown": r"\*\*[^*]+\*\*|(?<![*\w])\*(?=[^\s*])[^*]*(?<=[^\s*])\*(?![*\w])|`[^`]+`|^\s*#{1,6}\s+\S|\s#{2,6}\s*$|!?\[[^\[\]]+\]\([^()]*\)|(?<!\[)\[[^\[\]]+\]\[[^\[\]]*\]|\{#[\w-]+\}|(?<!\w)__(?=\S)[^_]+(?<=\S)__(?!\w)|(?<![\w_])_(?=[^\s_])[^_]+(?<=[^\s_])_(?![\w_])|~~[^~]+~~|\[\^\w+\]|^\s*>\s",
    "wiki": r"\[\[[^\[\]]+\]\]|\{\{[^{}]*\}\}|'{2,5}[^']+'{2,5}|^\s*={2,6}[^=].*={2,6}\s*$|\[https?://\S+[^\]]*\]|<nowiki|<ref",
    "latex": r"\\[a-zA-Z]{2,}\*?|\{\\[a-zA-Z]+|~\\|\\[%&#_{}$]",
}
#: What replaces residue, in this order.
HEADING_CLEAN = (
    (r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9-]*(\s[^<>]*)?/?>", ""),
    (r"~?\\(label|ref|eqref|pageref|cite|index)\{[^{}]*\}", ""),
    (r"\\[a-zA-Z]+\*?(\[[^\]]*\])?\{([^{}]*)\}", "$2"),
    (r"\{\\[a-zA-Z]+\s+([^{}]*)\}", "$1"),
    (r"\\([%&#_{}$])", "$1"),
    (r"\[\[([^\[\]|]*\|)?([^\[\]|]*)\]\]", "$2"),
    (r"\{\{([^{}|]*\|)*([^{}|]*)\}\}", "$2"),
    (r"'{2,5}([^']+)'{2,5}", "$1"),
    (r"^\s*={2,6}\s*(.*?)\s*={2,6}\s*$", "$1"),
    (r"!?\[([^\[\]]+)\]\([^()]*\)", "$1"),
    (r"\{#[\w-]+\}|\[\^\w+\]", ""),
    (r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", "$2"),
    (r"(?<![*\w])\*(?=\S)([^*]+)(?<=\S)\*(?![*\w])", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"^\s*#{1,6}\s+|\s+#{2,6}\s*$|^\s*>\s", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", "\""),
    (r"&amp;", "&"),
)
PART = " › "


def clean_heading(heading: Column) -> Column:
    """The heading path with the residue removed from each part and its formulas kept; null stays null.

    Parts are cleaned between their formulas, so a formula's own backslashes and braces are untouched.
    """

    def part(p: Column) -> Column:
        formulas = F.regexp_extract_all(p, F.lit(f"({HEADING_FORMULA})"), F.lit(1))
        gaps = F.split(p, HEADING_FORMULA, -1)

        def tidy(x: Column) -> Column:
            for rx, to in HEADING_CLEAN:
                x = F.regexp_replace(x, rx, to)
            return x

        return F.trim(F.array_join(F.zip_with(F.transform(gaps, tidy), formulas, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))

    return F.array_join(F.transform(F.split(heading, PART, -1), part), PART)


def heading_residue(sections: DataFrame) -> DataFrame:
    """Residue of heading paths (item_id, heading): item_id, element, ordinal of the part from 1. Null headings give none."""
    parts = sections.where(F.col("heading").isNotNull()).select("item_id", F.posexplode(F.split("heading", PART, -1)).alias("pos", "part"))
    bare = parts.withColumn("bare", F.regexp_replace("part", HEADING_FORMULA, " "))
    kinds = F.filter(F.array(*(F.when(F.col("bare").rlike(rx), F.lit(k)) for k, rx in HEADING_RESIDUE.items())), lambda x: x.isNotNull())
    return bare.select("item_id", F.explode(kinds).alias("element"), (F.col("pos") + 1).cast("long").alias("ordinal"))


def ingest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/ingest_requests.parquet").select(F.col("ingest_id").alias("item_id"), "text")


def heading_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/sections.parquet").select(F.col("section_id").alias("item_id"), "heading")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_found: a row for each element of each ingested text and each heading part with residue."""
    counted = clean_documents(ingest_items(spark, sf_dir)).select("item_id", F.explode("counts").alias("element", "n")).where("n > 0")
    rows = counted.select(F.lit("ingest").alias("item_kind"), "item_id", "element", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("ordinal"))
    heads = heading_residue(heading_items(spark, sf_dir)).select(F.lit("heading").alias("item_kind"), "item_id", "element", "ordinal")
    return rows.unionByName(heads).distinct()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_documents(ingest_items(spark, sf_dir)).select("item_id", "clean").dropDuplicates(["item_id"])


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heading_items(spark, sf_dir).select("item_id", "heading").distinct().select("item_id", "heading", clean_heading(F.col("heading")).alias("clean"))
