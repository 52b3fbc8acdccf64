"""Sentence units across languages and scripts: semi-Markov dynamic programming over whole spans.

Every run of end marks outside formulas may end a sentence. A paragraph is divided into the spans of
greatest total score: each span is scored as a whole by its length, its opening word, its closing
word and mark with what follows, and whether its quotations and brackets are balanced, stand alone or
belong to a sentence around them. No candidate is dropped before, and spans may be of any length: the
search for a span's beginning ends where no earlier one can score higher.
How likely words open or close sentences is counted over all texts at the edges of paragraphs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.counting import most_frequent

BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")
FORMULA = re.compile(r"\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\\begin\{(\w+\*?)\}.*?\\end\{\1\}|(?<!\\)\$[^$\n]*(?:\n[^$\n]+)?\$|⟦MATH_[0-9a-f]{32}⟧", re.S)
CLOSERS = "\"'”’»)]」』】》〉）］}"
OPENERS = "\"'“‘«([「『【《〈（［{"
END = re.compile(rf"(?:[.!?…]+|[。！？．]+[.!?…。！？]*|[។៕៚](?:ល។)?[!?។៕]*|[।॥]+[!?]*)(?:[{re.escape(CLOSERS)}]|\s?[»」』])*")
PAIRS = {"(": ")", "[": "]", "«": "»", "“": "”", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》"}
CLOSING = {v: k for k, v in PAIRS.items()}
SIGNS = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values()) + '"') + "]")
WORD_BEFORE = re.compile(r"((?:[^\W\d_]\.)+[^\W\d_]|[\wऀ-ॿក-៿]+)$")
OPENING = re.compile(r"[A-Za-zÀ-ɏ][\w’'-]*|[\wऀ-ॿក-៿]{1,3}")
CASELESS = re.compile("[ក-៿ऀ-ॿ㐀-鿿぀-ヿ฀-๿]")

# Abbreviations that a sentence goes on after.
NEVER = frozenset("no nos fig figs ch chap sec sect ex eq eqs p pp vs cf e.g i.e eg ie approx vol art thm def prop lem cor mr mrs ms dr prof st mt resp ca viz ed eds trans nr abb bzw z.b d.h usw al उदा पृ सं डॉ क्र अनु ល លេខ ទំ".split())
# Abbreviations that may also be the last word.
MAYBE = frozenset("etc a.m p.m am pm inc ltd co jr sr u.s".split())
KEYS = 50_000
LEAST = 5  # a word seen less often says nothing
UNIT = T.StructType([T.StructField("section_id", T.LongType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])


def opening(text: str, at: int) -> str | None:
    """The word, or the first characters of text without spaces, that begins at or behind signs at ``at``."""
    while at < len(text) and (text[at] in OPENERS or text[at].isspace()):
        at += 1
    m = OPENING.match(text, at)
    if not m:
        return None
    w = m.group()
    return w.lower() if w[0] < "ɐ" else w[:2]


def closing_word(text: str, at: int, base: int = 0) -> str | None:
    """The word, or the last characters of text without spaces, that ends at or before signs at ``at``."""
    while at > base and (text[at - 1] in CLOSERS or text[at - 1].isspace()):
        at -= 1
    if at <= base:
        return None
    if CASELESS.match(text[at - 1]):
        return text[max(base, at - 2) : at]
    k = at
    while k > base and at - k < 24 and text[k - 1].isalnum():
        k -= 1
    return text[k:at].lower() or None


class Scorer:
    """Scores with the counts of opening words (at the start of paragraphs, and behind commas and blanks) and closing words (at the end of paragraphs, and where a sentence goes on)."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.start = {k: n for (kind, k), n in counts.items() if kind == "s"}
        self.inner = {k: n for (kind, k), n in counts.items() if kind == "i"}
        self.last = {k: n for (kind, k), n in counts.items() if kind == "l"}
        self.middle = {k: n for (kind, k), n in counts.items() if kind == "m"}
        self.starts, self.inners = sum(self.start.values()) + 1, sum(self.inner.values()) + 1
        self.lasts, self.middles = sum(self.last.values()) + 1, sum(self.middle.values()) + 1

    def opener(self, word: str | None) -> float:
        """Log odds, within bounds, that the word opens a sentence rather than goes on in one."""
        return self.odds(self.start.get(word, 0), self.starts, self.inner.get(word, 0), self.inners)

    def closer(self, word: str | None) -> float:
        """Log odds, within bounds, that the word ends a sentence rather than goes on in one."""
        return self.odds(self.last.get(word, 0), self.lasts, self.middle.get(word, 0), self.middles)

    @staticmethod
    def odds(edge: int, edges: int, inner: int, inners: int) -> float:
        if edge + inner < LEAST:
            return 0.0
        return max(-3.0, min(3.0, math.log((edge + 0.3) / edges) - math.log((inner + 0.3) / inners)))

    def closing(self, text: str, m: re.Match, base: int) -> float:
        """Score of ending at this run of marks: by the closing word, the mark and what follows."""
        marks = m.group().rstrip(CLOSERS + " ")
        at, end = m.start(), m.end()
        after = end
        n = len(text)
        while after < n and text[after].isspace():
            after += 1
        if after == n:
            return 0.0
        following = text[after]
        spaced = after > end
        quoted = len(m.group()) > len(marks)
        k = after
        while k < n and text[k] in OPENERS:
            k += 1
        letter = text[k] if k < n else ""
        if "ល។" in marks:
            return -8.0
        if marks[0] == "." or marks[0] in "!?…":
            if not spaced and not quoted and (letter.isascii() and letter.isalnum() or following in ",;:-"):
                return -12.0
            if following in ",;:、，；：-–":
                return -12.0
            if letter.islower():
                return -12.0
        elif following in ",;:、，；：":
            return -12.0
        score = 4.0
        dots = marks == "..." or "…" in marks or marks.startswith("..")
        if dots:
            score = 0.0
            if letter.isupper():
                score = 3.0
            else:
                score += 1.5 * self.opener(opening(text, after))
            return score  # a text may trail off after any word
        if marks == ".":
            w = WORD_BEFORE.search(text, max(base, at - 24), at)
            word = w.group().lower() if w else ""
            if not quoted:
                if word in NEVER and not (word == "no" and letter.isupper() and text[max(0, at - 3) : at] == "no"):
                    return -10.0
                if word in MAYBE:
                    return 2.0 if letter.isupper() or CASELESS.match(letter or " ") else -8.0
            if not spaced:
                before = text[at - 1 : at]
                if CASELESS.match(before) or before.isdigit():
                    return -12.0
                if not quoted and not CASELESS.match(letter or " "):
                    return -8.0
            if CASELESS.match(text[at - 1 : at]) and letter.isdigit():
                return -10.0
            score = 3.0
        if letter.isupper():
            score += 2.0
        elif following == "$" or letter == "\\":
            score += 0.5
        elif letter.isdigit():
            score -= 1.0
        score += 0.4 * self.opener(opening(text, after))
        return score + (0.8 if marks == "." else 0.4) * self.closer(closing_word(text, at, base))


def balanced(text: str, start: int, stop: int, hidden: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """Quotations and brackets of text[start:stop] that open and close: (begin, end, whether it belongs to a sentence around it)."""
    out: list[tuple[int, int, bool]] = []
    opened: list[tuple[str, int]] = []
    h = 0
    for m in SIGNS.finditer(text, start, stop):
        while h < len(hidden) and hidden[h][1] <= m.start():
            h += 1
        if h < len(hidden) and hidden[h][0] <= m.start():
            continue
        c = m.group()
        opener = CLOSING.get(c, c)
        if c in PAIRS or (c == '"' and all(x != c for x, _ in opened)):
            opened.append((c, m.start()))
        elif any(x == opener for x, _ in opened):
            while opened[-1][0] != opener:
                opened.pop()
            p = opened.pop()[1]
            before = text[start:p].rstrip() if p - start < 80 else text[p - 80 : p].rstrip()
            after = text[m.end() : m.end() + 80].lstrip()
            leads = bool(before) and before[-1] not in ".!?…។៕॥।。！？" + CLOSERS
            out.append((p, m.end(), leads or bool(after) and (after[0].islower() or after[0] in ",;:、，；：")))
    return out


def split_paragraph(text: str, start: int, stop: int, hidden: list[tuple[int, int]], scorer: Scorer) -> list[tuple[int, int]]:
    """Sentence spans of text[start:stop], which holds no blank line."""
    cuts: list[int] = []
    scores: list[float] = []
    h = 0
    part = text[:stop] if stop < len(text) else text
    for m in END.finditer(text, start, stop):
        while h < len(hidden) and hidden[h][1] <= m.start():
            h += 1
        if h < len(hidden) and hidden[h][0] <= m.start():
            continue
        if m.end() < stop:
            cuts.append(m.end())
            scores.append(scorer.closing(part, m, start))
    if not cuts:
        return [(start, stop)]
    points = [start, *cuts, stop]
    n = len(points)
    # what is open at each point, where the last closed quotation began, and how many signs around it are part of a sentence
    pairs = balanced(text, start, stop, hidden)
    state: list[tuple[int, ...]] = [()] * n
    began: list[int | None] = [None] * n
    within = [0] * n
    for p, q, embedded in pairs:
        for k in range(bisect_right(points, p), bisect_left(points, q)):
            state[k] += (p,)
            within[k] += embedded
        for k in range(bisect_left(points, q), min(n, bisect_right(points, q + 1))):
            began[k] = p
    first = [a + len(text[a:b]) - len(text[a:b].lstrip()) for a, b in zip(points, points[1:], strict=False)]
    best = [0.0] + [-1e9] * (n - 1)
    top = best[:]  # the best of all up to here
    back = [0] * n
    for j in range(1, n):
        b = points[j]
        gain, alone, carried = 0.0, 0.0, 0.0
        if j < n - 1:
            gain = scores[j - 1] - 7.0 * within[j]
            if began[j] is not None:
                alone = 2.0
                follow = b
                while follow < stop and text[follow].isspace():
                    follow += 1
                if CASELESS.match(text[follow]) and text[b - 1] not in ")）]":
                    carried = -9.0  # the sentence around it goes on
        for i in range(j - 1, -1, -1):
            a = first[i]
            size = b - a
            excess = (size - 400) / 400 if size > 400 else 0.0
            if top[i] + gain + alone - excess < best[j]:
                break
            s = best[i] + gain - excess
            if began[j] is not None:
                s += alone if began[j] <= a else carried
            if state[i] != state[j]:
                s -= 7.0
            if size < 4:
                s -= 3.0 if not any(c.isalpha() for c in text[a:b]) else 1.5
            if s >= best[j]:  # among equals the longest
                best[j], back[j] = s, i
        top[j] = max(top[j - 1], best[j])
    out = []
    j = n - 1
    while j > 0:
        out.append((points[back[j]], points[j]))
        j = back[j]
    return out[::-1]


def sentences(text: str, scorer: Scorer) -> list[tuple[int, int]]:
    """Sentence units as (start, end) without blanks at either end; a blank line always ends a unit."""
    hidden = [m.span() for m in FORMULA.finditer(text)] if "$" in text or "\\" in text or "⟦" in text else []
    if hidden:  # a formula never reaches over a blank line
        hidden = [(a, b) for a, b in hidden if not BLANK_LINE.search(text, a, b)]
    out: list[tuple[int, int]] = []
    at = 0
    for a, b in [*((m.start(), m.end()) for m in BLANK_LINE.finditer(text)), (len(text), len(text))]:
        if a > at:
            for s, e in split_paragraph(text, at, a, [x for x in hidden if x[1] > at and x[0] < a], scorer):
                while s < e and text[s].isspace():
                    s += 1
                while e > s and text[e - 1].isspace():
                    e -= 1
                if e > s:
                    out.append((s, e))
        at = b
    return out


def opening_counts(texts: DataFrame, keys: int = KEYS) -> dict[tuple[str, str], int]:
    """Counts of opening keys at paragraph starts (s) and behind commas and blanks (i), and of closing keys before the marks at paragraph ends (l) and where a sentence goes on (m), the most frequent ``keys`` of each."""
    comma = re.compile(r"[,;，、；]\s?|(?<=[\w]) (?=[^\W\d])")
    goes_on = re.compile(r"(?<=\w)\.(?=[,;]|\s[a-zß-öø-ÿ])")  # behind an abbreviation
    ended = re.compile(rf"{END.pattern}\s*\Z")

    def close(c: Counter, text: str, start: int, stop: int) -> None:
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        m = ended.search(text[max(start, stop - 12) : stop])
        if m:
            c["l", closing_word(text, max(start, stop - 12) + m.start(), start)] += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for text in b.column(0).to_pylist():
                at = 0
                for m in BLANK_LINE.finditer(text):
                    c["s", opening(text, at)] += 1
                    close(c, text, at, m.start())
                    at = m.end()
                c["s", opening(text, at)] += 1
                close(c, text, at, len(text))
                for m in goes_on.finditer(text):
                    c["m", closing_word(text, m.start())] += 1
                for f, e in [m.span() for m in comma.finditer(text)]:
                    c["m", closing_word(text, f)] += 1
                    m = OPENING.match(text, e)
                    if m:
                        w = m.group()
                        c["i", w.lower() if w[0] < "ɐ" else w[:2]] += 1
            rows = [(k, w, n) for (k, w), n in c.items() if w is not None]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["kind", "key", "n"])

    counts = texts.select("text").mapInArrow(run, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    pair = F.when(F.col("kind").isin("l", "m"), F.lit("end")).otherwise(F.lit("start"))
    known = counts.groupBy("key", pair.alias("pair")).agg(F.collect_list(F.struct("kind", "n")).alias("rows"), F.sum("n").alias("both")).where(F.col("both") >= LEAST)  # two rows a group
    kept = most_frequent(known.select("key", F.explode("rows").alias("r")).select(F.col("r.kind").alias("kind"), "key", F.col("r.n").alias("n")), dict.fromkeys("silm", keys)).toArrow()
    return {(k, w): n for k, w, n in zip(*(kept.column(c).to_pylist() for c in ("kind", "key", "n")), strict=True)}


def split_sentences(sections: DataFrame, *, keys: int = KEYS) -> DataFrame:
    """Sentence units of (section_id, text): section_id, start_pos, end_pos in code points, end exclusive.

    Null ids and texts, and texts of blanks only, give no rows; repeated rows count once. The counts of
    opening and closing words come from all rows; the model keeps the ``keys`` most frequent of each.
    """
    spark = sections.sparkSession
    rows = sections.select(F.col("section_id").cast("long").alias("section_id"), "text").where(F.col("section_id").isNotNull() & F.col("text").isNotNull())
    counts = spark.sparkContext.broadcast(opening_counts(rows, keys))  # four times ``keys`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(counts.value)
        for b in batches:
            ids, starts, ends = [], [], []
            for sid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = sentences(text, scorer)
                ids += [sid] * len(got)
                starts += [s for s, _ in got]
                ends += [e for _, e in got]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ends)], names=UNIT.names)

    return rows.mapInArrow(run, UNIT).distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: the sentence units of all sections that were not scanned."""
    return split_sentences(spark.read.parquet(f"{sf_dir}/sections.parquet").where("NOT ocr").select("section_id", "text"))
