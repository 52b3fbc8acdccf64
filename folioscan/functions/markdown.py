"""Formulas and Markdown read by scanners: one over characters for spans, one over lines for blocks."""

from __future__ import annotations

from collections.abc import Iterator

from folioscan.functions.patterns import ENVIRONMENTS

_NAMES = {e + star for e in ENVIRONMENTS for star in ("", "*")}
_BLANK = " \t\r\f\v"


def formula_spans(text: str) -> Iterator[tuple[int, int]]:
    """Where formulas begin and end, from left to right; an escaped dollar is no delimiter."""
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c not in "$\\":
            jumps = [p for p in (text.find("$", i), text.find("\\", i)) if p >= 0]
            if not jumps:
                return
            i = min(jumps)
            continue
        end = _formula_end(text, i)
        if end:
            yield i, end
            i = end
        else:
            i += 1


def _formula_end(text: str, i: int) -> int:
    if text[i] == "\\":
        for left, right in (("\\[", "\\]"), ("\\(", "\\)")):
            if text.startswith(left, i):
                at = text.find(right, i + 3)
                return at + 2 if at > 0 else 0
        if text.startswith("\\begin{", i):
            close = text.find("}", i)
            name = text[i + 7 : close] if close > 0 else ""
            if name in _NAMES:
                last = "\\end{" + name + "}"
                at = text.find(last, close + 1)
                return at + len(last) if at > 0 else 0
        return 0
    before = text[i - 1] if i else ""
    if before == "\\":
        return 0
    if text.startswith("$$", i):
        return _dollars(text, i + 2, double=True)
    return 0 if before == "$" else _dollars(text, i + 1, double=False)


def _dollars(text: str, start: int, *, double: bool) -> int:
    """End of a formula whose body begins at ``start``, or 0. Inline ones stay on a line and no digit follows them."""
    j, n = start, len(text)
    while j < n:
        c = text[j]
        if c == "\\":
            j += 2
            continue
        if c == "$":
            if not double:
                return j + 1 if j > start and not text[j + 1 : j + 2].isdecimal() else 0
            if text.startswith("$$", j):
                return j + 2 if j > start else 0
        elif c == "\n" and not double:
            return 0
        j += 1
    return 0


def cut(text: str, spans: Iterator[tuple[int, int, str]]) -> str:
    """The text with each span (begin, end) replaced; spans come in order."""
    out, at = [], 0
    for a, b, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def comments(text: str) -> Iterator[tuple[int, int, str]]:
    a = text.find("<!--")
    while a >= 0:
        b = text.find("-->", a + 4)
        if b < 0:
            return
        yield a, b + 3, ""
        a = text.find("<!--", b + 3)


def links(text: str) -> Iterator[tuple[int, int, str]]:
    """Images and links, which leave their text; an image may have none, and a link may hold an image."""
    i = text.find("[")
    while i >= 0:
        image = i > 0 and text[i - 1] == "!"
        close = text.find("]", i + 1)
        inner = i
        if image and close > 0 and text.startswith("](", close):  # the innermost text only
            end = text.find(")", close + 2)
            if end > 0:
                yield i - 1, end + 1, text[i + 1 : close]
                i = text.find("[", end + 1)
                continue
        if not image and close > i + 1 and text.startswith("](", close) and "[" in text[i + 1 : close] and text[i + 1] == "!":
            inner = -1
        if inner >= 0 and close > i + 1 and text.startswith("](", close):
            end = text.find(")", close + 2)
            if end > 0:
                yield i, end + 1, text[i + 1 : close]
                i = text.find("[", end + 1)
                continue
        i = text.find("[", i + 1)


def emphasis(text: str, sign: str) -> Iterator[tuple[int, int, str]]:
    """Text between two doubled signs on a line, no blank beside them on the inside."""
    a = text.find(sign)
    k = len(sign)
    while a >= 0:
        if text[a + k : a + k + 1].isspace() or a + k >= len(text):
            a = text.find(sign, a + 1)
            continue
        stop = text.find("\n", a)
        stop = len(text) if stop < 0 else stop
        b = text.find(sign, a + k + 1, stop)
        while b >= 0 and text[b - 1].isspace():
            b = text.find(sign, b + 1, stop)
        if b < 0:
            a = text.find(sign, a + 1)
            continue
        yield a, b + k, text[a + k : b]
        a = text.find(sign, b + k)


def _wordy(c: str) -> bool:
    return c == "*" or c == "_" or c.isalnum()


def italics(text: str) -> Iterator[tuple[int, int, str]]:
    """Text between single asterisks on a line that do not stand inside words."""
    a = text.find("*")
    while a >= 0:
        b = text.find("*", a + 1)
        inner = text[a + 1 : b] if b > 0 else ""
        fits = inner and "\n" not in inner and not inner[0].isspace() and not inner[-1].isspace()
        if fits and not (a and _wordy(text[a - 1])) and not _wordy(text[b + 1 : b + 2] or " "):
            yield a, b + 1, inner
            b += 1
        a = text.find("*", max(b, a + 1)) if b >= 0 else -1


def code_spans(text: str) -> Iterator[tuple[int, int, str]]:
    a = text.find("`")
    while a >= 0:
        b = text.find("`", a + 1)
        if b < 0:
            return
        if b > a + 1 and "\n" not in text[a + 1 : b]:
            yield a, b + 1, text[a + 1 : b]
            b += 1
        a = text.find("`", max(b, a + 1))


def tags(text: str) -> Iterator[tuple[int, int, str]]:
    """HTML tags: a name, and attributes without angle brackets behind a blank."""
    a = text.find("<")
    while a >= 0:
        b = min((p for p in (text.find(">", a), text.find("<", a + 1)) if p >= 0), default=-1)
        if b < 0:
            return
        if text[b] == ">":
            body = text[a + 1 : b].removeprefix("/")
            name = body.split(None, 1)[0] if body[:1].strip() else ""
            bare = name.removesuffix("/") if len(name) == len(body) else name
            if bare and bare[0].isascii() and bare[0].isalpha() and all(c.isascii() and (c.isalnum() or c == "-") for c in bare):
                yield a, b + 1, ""
        a = text.find("<", b if text[b] == "<" else b + 1)


def indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def atx(line: str) -> tuple[int, str] | None:
    """(level, title) of a heading line that begins with number signs."""
    body = line.lstrip()
    if len(line) - len(body) > 3 or not body.startswith("#"):
        return None
    level = len(body) - len(body.lstrip("#"))
    rest = body[level:]
    if level > 6 or not rest[:1].isspace():
        return None
    return level, rest.strip().rstrip("#").rstrip()


def opens_fence(line: str) -> bool:
    return indent(line) <= 3 and line.lstrip().startswith(("```", "~~~"))


def is_rule(line: str) -> bool:
    signs = "".join(line.split())
    return len(signs) >= 3 and signs[0] in "-*_" and signs == signs[0] * len(signs) and indent(line) <= 3


def is_underline(line: str) -> bool:
    body = line.strip()
    return bool(body) and indent(line) <= 3 and body in ("=" * len(body), "-" * len(body))


def is_table_rule(line: str) -> bool:
    cells = line.strip().removeprefix("|").removesuffix("|").split("|")
    return all(len(c) >= 3 and c == "-" * len(c) for c in (x.strip().removeprefix(":").removesuffix(":") for x in cells))


def is_reference(line: str) -> bool:
    body = line.strip()
    close = body.find("]")
    return body.startswith("[") and close > 1 and body.startswith("]:", close) and body[close + 2 : close + 3].isspace()


def without_front_matter(text: str) -> str:
    lines = text.split("\n")
    if lines[0].rstrip() != "---":
        return text
    last = next((i for i in range(1, len(lines) - 1) if lines[i].rstrip() == "---" and i > 1), None)
    if last is None:
        return text
    rest = lines[last + 1 :]
    while rest[:-1] and not rest[0].strip():
        rest = rest[1:]
    return "\n".join(rest)


def without_fences(lines: list[str]) -> list[str]:
    """Lines without the marks of closed code blocks."""
    out: list[str] = []
    i = 0
    while i < len(lines):
        sign = lines[i][:3]
        end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith(sign) and not lines[j][3:].strip(_BLANK)), None) if sign in ("```", "~~~") else None
        if end is None:
            out.append(lines[i])
            i += 1
        else:
            out += lines[i + 1 : end] + [""]
            i = end + 1
    return out


def blocks(lines: list[str]) -> list[str]:
    """Lines without reference definitions, rules, underlines and the signs of headings and quotations.

    What replaces a block swallows blank lines around it, as blanks before and behind a sign belong to it:
    before it up to three characters (any number before definitions and table rules), all behind it.
    Headings that follow each other stay on lines of their own.
    """
    out: list[str] = []
    eat = False
    for line in lines:
        if not line.strip():
            if not eat:
                out.append(line)
            continue
        eat = False
        head = atx(line)
        wide = is_reference(line) or is_table_rule(line)
        if not (head or wide or is_rule(line) or is_underline(line)):
            body = line.lstrip()
            if body.startswith(">") and len(line) - len(body) <= 3:
                _swallow(out, 3 - (len(line) - len(body)))
                line = body[2:] if body[1:2].isspace() else body[1:]
            out.append(line)
            continue
        _swallow(out, len("".join(out)) + len(out) if wide else 3 - indent(line))
        out.append(head[1] if head else "")
        eat = not is_reference(line)
    return out


def _swallow(out: list[str], room: int) -> None:
    """Drop blank lines at the end as far as their characters and line ends fit into ``room``."""
    while out and not out[-1].strip() and len(out[-1]) + 1 <= room:
        room -= len(out.pop()) + 1


def clean(text: str) -> str:
    """Text without Markdown signs; list marks, tables and formulas stay."""
    text = without_front_matter(text)
    text = cut(text, comments(text))
    lines = without_fences(text.split("\n"))
    text = "\n".join(lines)
    for spans in (links, links):  # a link around an image comes second
        text = cut(text, spans(text))
    text = "\n".join(blocks(text.split("\n")))
    for sign in ("**", "__"):
        text = cut(text, emphasis(text, sign))
    text = cut(text, italics(text))
    text = cut(text, code_spans(text))
    return cut(text, tags(text))
