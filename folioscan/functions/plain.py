"""Text functions in plain Python: the bodies of the Arrow functions, and what chunking needs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from folioscan.functions import markdown
from folioscan.functions import patterns as P

_SPLIT = re.compile(f"({P.TOKEN})|({P.KHMER_RUN.pattern})")
_NORMAL = (
    (re.compile(f"(?<![ក-៿]){P.ZWNJ}|{P.ZWNJ}(?![ក-៿])"), ""),
    (re.compile(r"[^\S\n]+"), " "),
    (re.compile(r" *\n *"), "\n"),
    (re.compile(r"\n{3,}"), "\n\n"),
)
_INVISIBLE = str.maketrans("", "", P.ZWSP + "﻿­⁠")


def normalise(text: str) -> str:
    """NFC, one kind of line end, no invisible characters, tidy blanks."""
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").translate(_INVISIBLE)
    for rx, to in _NORMAL:
        text = rx.sub(to, text)
    return text.strip()


_KHMER_CHAR = re.compile(f"[{P.KHMER}]")


def has_khmer(text: str) -> bool:
    return _KHMER_CHAR.search(text) is not None


def clusters(run: str) -> list[str]:
    """Orthographic clusters of a run of Khmer characters; a stray mark joins the cluster before it."""
    return P.KHMER_UNIT.findall(run)


def units(run: str, segmenter: Callable[[str], list[str]] | None) -> list[str]:
    """Words of a Khmer run by a segmenter that is plugged in; clusters without one, or where its words don't join to the run."""
    if segmenter is not None:
        try:
            got = [w for w in segmenter(run) if w]
        except Exception:  # noqa: BLE001
            got = []
        if "".join(got) == run:
            return got
    return clusters(run)


def pieces(text: str, segmenter: Callable[[str], list[str]] | None = None) -> list[str]:
    """Tokens, Khmer words or clusters and stretches of other text; joined they give the text again."""
    out: list[str] = []
    at = 0
    for m in _SPLIT.finditer(text):
        if m.start() > at:
            out.append(text[at : m.start()])
        out += [m.group()] if m.group(1) else units(m.group(), segmenter)
        at = m.end()
    return out + ([text[at:]] if at < len(text) else [])


def words(text: str) -> list[str]:
    """Pieces without blanks; other text is split at blanks."""
    out: list[str] = []
    for p in pieces(text):
        out += [p] if not p.isspace() and (P.TOKEN_RE.fullmatch(p) or has_khmer(p)) else p.split()
    return out


def _mark_run(m: re.Match) -> str:
    units = clusters(m.group())
    joined = P.ZWSP.join(units)
    if P.ZWNJ in joined or P.ZWJ in joined:  # no mark beside a joiner
        joined = re.sub(f"(?<=[{P.ZWNJ}{P.ZWJ}]){P.ZWSP}|{P.ZWSP}(?=[{P.ZWNJ}{P.ZWJ}])", "", joined)
    return joined


def mark_words(text: str) -> str:
    """Zero-width spaces between neighbouring Khmer pieces."""
    return P.KHMER_RUN.sub(_mark_run, text)


def search_tokens(text: str) -> list[str]:
    """Lower-case words, numbers and command names, and Khmer pieces but for lone sentence marks."""
    out: list[str] = []
    text = normalise(text)
    at = 0
    for start, end in [*markdown.formula_spans(text), (len(text), len(text))]:
        for p in pieces(text[at:start]):
            if not has_khmer(p):
                out += (w.lower() for w in P.SEARCH_WORD.findall(p))
            elif p.strip("។៕៖"):
                out.append(p)
        out += (w.lower() for w in P.SEARCH_WORD.findall(text[start:end]))
        at = end
    return out


def clean_markdown(text: str) -> str:
    """Text without Markdown signs; formulas are set aside meanwhile."""
    kept = [text[a:b] for a, b in markdown.formula_spans(text)]
    masked = markdown.cut(text, ((a, b, f"⟦MATH_{i:032x}⟧") for i, (a, b) in enumerate(markdown.formula_spans(text)))) if kept else text
    clean = markdown.clean(masked)
    return P.TOKEN_RE.sub(lambda m: kept[int(m.group()[6:-1], 16)] if int(m.group()[6:-1], 16) < len(kept) else m.group(), clean) if kept else clean


def heading_title(raw: str, most: int = 120) -> str:
    title = _outer(clean_markdown(raw))
    return title if len(title) <= most else title[:most].rstrip() + "…"


def _outer(title: str) -> str:
    """The title without blanks and decoration around it."""
    while title and (title[0].isspace() or title[0] in P.BEFORE_TITLE):
        title = title[1:]
    while title and (title[-1].isspace() or title[-1] in P.BEHIND_TITLE):
        title = title[:-1]
    return title


def page_parts(text: str) -> list[dict]:
    """Sections at ATX headings outside code fences: text, starts_heading, path (level and title of each heading above, within this text)."""
    out: list[dict] = []
    path: list[dict] = []
    lines: list[str] = []
    starts, fenced = False, False

    def close() -> None:
        clean = clean_markdown("\n".join(lines))
        if clean.strip() or path:
            out.append({"text": clean, "starts_heading": starts, "path": path})

    for line in text.split("\n"):
        fenced ^= markdown.opens_fence(line)
        head = None if fenced else markdown.atx(line)
        title = heading_title(head[1]) if head else ""
        if title:
            close()
            path = [*(x for x in path if x["level"] < head[0]), {"level": head[0], "title": title}]
            lines, starts = [line], True
        else:
            lines.append(line)
    close()
    return out


def markdown_sections(text: str) -> list[dict]:
    """Sections at ATX headings outside code fences: text, heading path, starts_heading."""
    return [
        {"text": p["text"], "heading": P.HEADING_SEPARATOR.join(x["title"] for x in p["path"]), "starts_heading": p["starts_heading"]} for p in page_parts(text) if p["text"].strip()
    ]
