"""Noise in text from scanned pages: furniture, broken words, misread characters.

Running headers and page numbers are found per source from what stands at the edges of its pages. Words
are corrected by a noisy channel. Which characters recognisers take for which is a fixed table; how often
each happens is estimated from the corpus by expectation and maximisation over all its words. The channel,
word and word-pair counts weigh the word as read against all words it may have been, and Viterbi picks the
best sequence of each line. Khmer has no spaces, so there Viterbi picks the words of a run as well, with
and without confusions, and an unknown character where no word fits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.counting import most_frequent
from folioscan.runtime import materialise

WORDS = 200_000
PAIRS = 200_000
KHMER_WORDS = 50_000

# What a recogniser reads (left) for what is printed (right).
CONFUSIONS = (("c", "e"), ("0", "o"), ("f", "t"), ("ri", "n"), ("l", "i"), ("1", "l"), ("5", "s"), ("ii", "u"), ("cl", "d"), ("rn", "m"), ("b", "h"), ("9", "g"), ("vv", "w"), ("@", "a"), ("8", "b"), ("1", "i"), ("6", "b"), ("q", "g"))
KHMER_CONFUSIONS = {"ឆ": "ន", "គ": "ត", "ឃ": "ប", "ញ": "ព", "ល": "ស", "ថ": "ច"}
BREAK_MARKS = "-‐­¬"
FIRST_GUESS = 0.004  # chance of a confusion before any is counted
ROUNDS = 3  # of expectation and maximisation
UNSEEN = 1e-4  # count of a word that the model does not have
#: What an occurrence in a scan, which may be misread itself, is worth against one in other text.
SCANNED = 0.02
LESS = math.log(0.7)
SLACK = 30.0  # how much a word pair may speak for a word beyond its own count
UNKNOWN = 1e-6  # chance of a Khmer character that belongs to no known word

LATIN = re.compile(r"@?[^\W_ក-៿]+(?:@[^\W_ក-៿]*)*(?:[-‐][^\W_ក-៿]+)*")
KHMER = re.compile(r"[ក-៓ៗ៝]+")
FOREIGN = re.compile(r"(?<=[ក-៓])[A-Za-z0-9](?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Za-z0-9](?=[ក-៓])")
KHMER_RUN = re.compile(r"(?:[ក-៓]|(?<=[ក-៓])[:A-Za-z0-9](?=[ក-៓])|[A-Za-z0-9](?=[ក-៓])|(?<=[ក-៓])[A-Za-z0-9:](?![A-Za-z0-9]))+")
FORMULA = re.compile(r"\$\$.*?\$\$|\$[^$\n]*\$|⟦MATH_[0-9a-f]+⟧")
DIGITS = str.maketrans("០១២៣៤៥៦៧៨៩OoIlS", "012345678900115")
NUMBER = r"[0-9០-៩OoIlS]*[0-9០-៩][0-9០-៩OoIlS]*"
STYLED = re.compile(rf"(?:[-—–•~|*]+\s*({NUMBER})\s*[-—–•~|*]+|[\[(<{{]\s*({NUMBER})\s*[\])>}}]|(?:page|pg\.?|p\.?|pp\.|ទំព័រ(?:ទី)?|第)\s*[:.]?\s*({NUMBER})(?:\s*(?:/|of|នៃ)\s*{NUMBER})?\s*(?:页)?|({NUMBER})\s*(?:/|of)\s*{NUMBER})", re.I)
BARE = re.compile(r"[0-9០-៩]{1,4}")
FOLD_PAIRS = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"))
FOLD = str.maketrans("c0f1l5b9@ឆគឃញលថ", "eotiishgaនតបពសច")


def edge_lines(lines: list[str]) -> list[int]:
    """The first and last two lines that are not blank."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    return at if len(at) <= 4 else at[:2] + at[-2:]


def edge_key(line: str) -> str:
    """A line without numbers, signs and the differences that misreading makes."""
    words = [w for w in line.lower().split() if re.search(r"[^\W\d_]", w) and not re.fullmatch(NUMBER, w)]
    text = "".join(words)
    for a, b in FOLD_PAIRS:
        text = text.replace(a, b)
    text = text.translate(FOLD)
    return "".join(c for c in text if c.isalpha() or "ក" <= c <= "៓")


def page_number(line: str) -> int | None:
    m = STYLED.fullmatch(line.strip())
    if not m:
        return None
    digits = next(g for g in m.groups() if g).translate(DIGITS)
    return int(digits)


def edges(texts: DataFrame) -> DataFrame:
    """source, section_id, kind (page, edge, number), key for every scanned section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: set[tuple] = set()
            for sid, source, page, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                lines = text.split("\n")
                rows.add((source, sid, "page", ""))
                for i in edge_lines(lines):
                    line = lines[i].strip()
                    if BARE.fullmatch(line):
                        if page is not None:
                            rows.add((source, sid, "number", str(int(line.translate(DIGITS)) - page)))
                    elif page_number(line) is None:
                        key = edge_key(line)
                        if len(key) >= 6:
                            rows.add((source, sid, "edge", key))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["source", "section_id", "kind", "key"])

    return texts.select("section_id", "source", "page", "text").mapInArrow(run, "source string, section_id long, kind string, key string")


def furniture(texts: DataFrame, *, share: float = 0.2, mostly: float = 0.5) -> DataFrame:
    """One row a source: its running lines (keys) and the commonest distance of bare edge numbers from the page.

    A running line stands at the edge of at least two pages and of the given share of its source's pages, and
    does so in most of the sources where it stands at an edge at all: what stands once in many sources is
    a heading. At most 4 / share keys a source remain.
    """
    e = edges(texts).groupBy("source", "section_id", "kind", "key").agg(F.lit(1).alias("i"))  # repeated rows count once
    counts = materialise(e.groupBy("source", "kind", "key").agg(F.count("*").alias("n")), "edges")
    pages = counts.where("kind = 'page'").select("source", F.col("n").alias("pages"))
    edges_ = counts.where("kind = 'edge'").join(pages, "source").withColumn("runs", (F.col("n") >= 2) & (F.col("n") >= share * F.col("pages")))
    known = edges_.groupBy("key").agg(F.count("*").alias("sources"), F.count_if("runs").alias("running")).where((F.col("running") > 0) & (F.col("running") >= mostly * F.col("sources"))).select("key")
    lines = edges_.where("runs").join(known, "key")
    headers = lines.groupBy("source").agg(F.collect_list("key").alias("headers"))
    numbers = counts.where("kind = 'number' AND n > 1").join(pages, "source").where(F.col("n") >= share / 10 * F.col("pages")).groupBy("source").agg(F.max_by(F.col("key").cast("int"), F.struct("n", "key")).alias("distance"))
    return pages.select("source").join(headers, "source", "left").join(numbers, "source", "left")


class Model:
    """Counts of words (all, and in text that was not scanned), word pairs and Khmer words, and the chances of the confusions."""

    def __init__(self, words: dict[str, tuple[int, int]], pairs: dict[str, tuple[int, int]], khmer: dict[str, tuple[int, int]]):
        self.words, self.pairs, self.khmer = words, pairs, khmer
        self.latin_chances = dict.fromkeys(CONFUSIONS, FIRST_GUESS)
        self.khmer_chances = dict.fromkeys(KHMER_CONFUSIONS.items(), FIRST_GUESS)


def worth(counts: tuple[int, int] | None) -> float:
    """What the counts of a word (all, not scanned) say for it as a printed word."""
    return counts[1] + SCANNED * (counts[0] - counts[1]) + UNSEEN if counts else UNSEEN


def undone(word: str, pairs: Iterator[tuple[str, str]]) -> Iterator[tuple[str, tuple[str, str]]]:
    """The forms that one confusion turns into this word."""
    for pair in pairs:
        read, printed = pair
        i = word.find(read)
        while i >= 0:
            yield word[:i] + printed + word[i + len(read) :], pair
            i = word.find(read, i + 1)


def expected(word: str, scanned: int, words: dict[str, tuple[int, int]], chances: dict[tuple[str, str], float], out: Counter) -> None:
    """Add to ``out`` how many of the scanned occurrences of a word are expected to come from each confusion, and how often each could have happened."""
    if not scanned:
        return
    for pair in chances:
        if pair[1] in word:
            out["could", pair] += scanned * word.count(pair[1])
    own = worth(words.get(word))
    ways = [(pair, worth(words[f]) * chances[pair]) for f, pair in undone(word, chances) if f in words]
    total = own + sum(x for _, x in ways)
    for pair, x in ways:
        out["did", pair] += scanned * x / total


def learn(texts: DataFrame, words: int, pairs: int, khmer: int) -> Model:
    """The model over all sections (text, ocr): the most frequent words, pairs and Khmer words up to their bounds; the confusions from all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, p, k = Counter(), Counter(), Counter()
            for text, scan in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = LATIN.findall(text.lower().replace("‐", "-"))
                w.update((x, scan) for x in found)
                p.update((x, y, scan) for x, y in zip(found, found[1:], strict=False))
                if 12 * text.count("\u200b") > len(text):  # words are marked throughout
                    k.update((x, scan) for x in KHMER.findall(text))
            rows = [("w", x, n, 0 if s else n) for (x, s), n in w.items()] + [("p", f"{x} {y}", n, 0 if s else n) for (x, y, s), n in p.items()] + [("k", x, n, 0 if s else n) for (x, s), n in k.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["kind", "token", "n", "plain"])

    spark = texts.sparkSession
    counts = texts.select("text", "ocr").mapInArrow(run, "kind string, token string, n long, plain long").groupBy("kind", "token").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain"))
    counts = materialise(counts, "words")
    kept = most_frequent(counts.where("n > 1"), {"w": words, "p": pairs, "k": khmer}, "token", written=True).toArrow()  # bounded by the three
    known: dict[str, dict] = {"w": {}, "p": {}, "k": {}}
    for kind, token, n, plain in zip(*(kept.column(i).to_pylist() for i in range(4)), strict=True):
        known[kind][token] = (n, plain)
    top = max((n for n, _ in known["k"].values()), default=0)
    model = Model(known["w"], known["p"], {w: c for w, c in known["k"].items() if c[1] * 2000 >= top or c[0] * 500 >= top} | {"ទំព័រ": (1, 1)})
    singles = counts.where("kind <> 'p'")
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, out = sent.value, Counter()  # noqa: B023
            for b in batches:
                for kind, token, n, plain in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    expected(token, n - plain, m.words if kind == "w" else m.khmer, m.latin_chances if kind == "w" else m.khmer_chances, out)
            rows = [(what, *pair, float(x)) for (what, pair), x in out.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], names=["what", "read", "printed", "n"])

        sums = {(r["what"], (r["read"], r["printed"])): r["n"] for r in singles.mapInArrow(expect, "what string, read string, printed string, n double").groupBy("what", "read", "printed").agg(F.sum("n").alias("n")).collect()}  # two rows a confusion
        for chances in (model.latin_chances, model.khmer_chances):
            for pair in chances:
                chances[pair] = min(0.2, max(1e-5, (sums.get(("did", pair), 0.0) + 1) / (sums.get(("could", pair), 0.0) + 1 / FIRST_GUESS)))
        sent.unpersist()
    return model


class Reader:
    """Line repair with a model; made once in each Python worker."""

    def __init__(self, model: Model):
        self.words, self.pairs = model.words, model.pairs
        self.total = sum(worth(c) for c in self.words.values()) + 1
        self.most = max(map(worth, self.words.values()), default=1.0)
        self.chances = {p: math.log(x) for p, x in model.latin_chances.items()}
        self.likeliest = max(model.latin_chances.values())
        khmer_total = sum(worth(c) for c in model.khmer.values()) + 1
        self.khmer = {w: math.log(worth(c) / khmer_total) for w, c in model.khmer.items()}
        self.khmer_chances: dict[str, list[tuple[str, float]]] = {}
        for (read, printed), x in model.khmer_chances.items():
            self.khmer_chances.setdefault(read, []).append((printed, math.log(x)))
        foreign = [(c, math.log(1 / 40)) for c in "កខគឃងចឆជឈញដឋឌឍណតថទធនបផពភមយរលវសហឡអ"]
        self.khmer_chances |= {c: foreign for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"} | {":": [("ៈ", math.log(0.5))]}
        self.prefixes = {w[:i] for w in self.khmer for i in range(1, len(w) + 1)}
        self.auto = ahocorasick.Automaton()
        for w in self.khmer:
            self.auto.add_word(w, len(w))
        self.auto.make_automaton()
        self.memo: dict[str, list[tuple[str, float]]] = {}

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """The word itself and all known words that may have been read as it, with the log chance of their confusions.

        Two confusions are tried only where the likeliest ones and the commonest word could outweigh the word as read.
        """
        done = self.memo.get(word)
        if done is not None:
            return done
        own = worth(self.words.get(word))
        best = {word: 0.0}
        level = {word: 0.0}
        for n in (1, 2):
            if self.most * self.likeliest**n * SLACK < own:
                break
            following: dict[str, float] = {}
            for form, cost in level.items():
                for f, pair in undone(form, self.chances):
                    c = cost + self.chances[pair]
                    if c > following.get(f, -1e9):
                        following[f] = c
            for f, c in following.items():
                if f in self.words and c > best.get(f, -1e9):
                    best[f] = c
            level = following
        out = list(best.items())
        if len(self.memo) < 500_000:
            self.memo[word] = out
        return out

    def score(self, word: str, before: str | None) -> float:
        uni = math.log(worth(self.words.get(word)) / self.total)
        if before is None:
            return uni
        pair = self.pairs.get(f"{before} {word}")
        if pair is None:
            return uni + LESS
        return math.log(0.3 * worth(pair) / max(worth(self.words.get(before)), worth(pair)) + 0.7 * math.exp(uni))

    def viterbi(self, words: list[str]) -> list[str]:
        """The most likely printed words of a line."""
        lists = [self.candidates(w) for w in words]
        if all(len(x) == 1 for x in lists):
            return words
        best: list[tuple[float, list[str]]] = [(0.0, [])]
        for options in lists:
            nxt: list[tuple[float, list[str]]] = []
            for w, cost in options:
                s, path = max(((s + self.score(w, p[-1] if p else None), p) for s, p in best), key=lambda x: x[0])
                nxt.append((s + cost, [*path, w]))
            best = nxt
        return max(best, key=lambda x: x[0])[1]

    def covered(self, run: str) -> bool:
        """Whether the longest known words, taken from the left, cover the run."""
        got = 0
        for end, k in self.auto.iter_long(run):
            if end - k + 1 != got:
                return False
            got = end + 1
        return got == len(run)

    def khmer_run(self, run: str) -> str:
        """The likeliest words of the run, read with or without confusions, over all its characters; characters of no word stay."""
        if not self.khmer or self.covered(run):  # nothing to repair
            return run
        n = len(run)
        best = [0.0] + [-1e9] * n
        back: list[tuple[int, str]] = [(0, "")] * (n + 1)
        alone = math.log(UNKNOWN)
        prefixes, words, confusions = self.prefixes, self.khmer, self.khmer_chances
        for i in range(n):
            s = best[i]
            if s + alone > best[i + 1]:
                best[i + 1], back[i + 1] = s + alone, (i, run[i])
            open_ = [("", 0.0)]
            j = i
            while open_ and j < n:
                c = run[j]
                j += 1
                longer = []
                for part, cost in open_:
                    p = part + c
                    if p in prefixes:
                        longer.append((p, cost))
                    for o, x in confusions.get(c, ()):
                        p = part + o
                        if p in prefixes and cost + x > alone:  # beyond that the characters are unknown
                            longer.append((p, cost + x))
                open_ = longer
                for p, cost in open_:
                    w = words.get(p)
                    if w is not None and s + w + cost > best[j]:
                        best[j], back[j] = s + w + cost, (i, p)
        out = []
        while n:
            n, part = back[n]
            out.append(part)
        return "".join(out[::-1])

    def khmer_line(self, line: str) -> tuple[str, bool]:
        wrong = False

        def fix(m: re.Match) -> str:
            nonlocal wrong
            run = m.group()
            if run.isascii():
                return run
            foreign = any(c.isascii() and c.isalnum() for c in run)
            tail = ""
            if run.endswith(":") and self.covered(run[:-1]):
                run, tail = run[:-1], ":"
            new = self.khmer_run(run)
            if foreign or new != run:
                wrong = True
            return new + tail

        return KHMER_RUN.sub(fix, line), wrong


def is_header(key: str, headers: list[str]) -> bool:
    if len(key) < 4:
        return False
    for h in headers:
        if key == h:
            return True
        if abs(len(h) - len(key)) <= 1 and len(h) >= 6:
            n = sum(a != b for a, b in zip(h, key, strict=False))
            if n <= (2 if len(h) == len(key) else 0):
                return True
            if len(h) != len(key):  # one character lost or added
                long_, short = (h, key) if len(h) > len(key) else (key, h)
                i = next((j for j, c in enumerate(short) if c != long_[j]), len(short))
                if long_[i + 1 :] == short[i:]:
                    return True
    return False


def repair(text: str, page: int | None, headers: list[str], distance: int | None, reader: Reader) -> tuple[str, list[tuple[int, str]]]:
    """Paragraphs of the page and what was found: (line number, kind)."""
    lines = text.split("\n")
    kinds: dict[int, str] = {}
    edge = edge_lines(lines)
    for i in edge:
        line = lines[i].strip()
        number = page_number(line)
        if number is not None:
            kinds[i] = "page_number"
        elif BARE.fullmatch(line):
            if distance is not None and page is not None and int(line.translate(DIGITS)) - page == distance:
                kinds[i] = "page_number"
        elif headers and is_header(edge_key(line), headers):
            kinds[i] = "header"
    found = [(i, k) for i, k in kinds.items()]
    body = [i for i in range(len(lines)) if i not in kinds]
    parts: list[str] = []
    paragraphs: list[str] = []
    carry: tuple[str, int] | None = None  # first part of a broken word

    def close() -> None:
        if parts:
            paragraphs.append(_join(parts))
            parts.clear()

    for n, i in enumerate(body):
        line = lines[i]
        if not line.strip():
            follows = next((lines[j] for j in body[n + 1 :] if lines[j].strip()), None)
            if carry is None and follows is not None:
                close()
            continue
        fixed, wrong = line.rstrip(), False
        if KHMER.search(line):
            fixed, wrong = reader.khmer_line(fixed)
        spans = [m.span() for m in FORMULA.finditer(fixed)] if "$" in fixed or "⟦" in fixed else []
        tokens = [m for m in LATIN.finditer(fixed) if not (spans and any(a < m.end() and m.start() < b for a, b in spans))]
        head = carry
        carry = None
        broken = None
        if fixed and fixed[-1] in BREAK_MARKS and tokens and tokens[-1].end() == len(fixed) - 1:
            rest = next((lines[j] for j in body[n + 1 :] if lines[j].strip()), None)
            broken = _break(tokens[-1].group(), fixed[-1], rest, reader)
        words = [m.group().lower().replace("‐", "-") for m in tokens]
        first = 0
        if head and words:
            first = 1  # the second half of a broken word is judged as a whole
            whole = head[0].lower() + words[0]
            good = reader.viterbi([whole])[0]
            if good != whole:
                cut = len(head[0])
                if good[:cut] != whole[:cut] and good[: cut - 1] != whole[: cut - 1]:
                    found.append((head[1], "misread"))
                elif good[-len(words[0]) :] != words[0]:
                    wrong = True
                else:
                    found.append((head[1], "misread"))
                merged = _case(head[0] + tokens[0].group(), good)
            else:
                merged = head[0] + tokens[0].group()
            fixed_start = merged
        last = len(words) - (1 if broken else 0)
        middle = words[first:last]
        best_words = reader.viterbi(middle) if middle else []
        out, at = [], 0
        for k, m in enumerate(tokens):
            out.append(fixed[at : m.start()])
            piece = m.group()
            if first and k == 0:
                piece = fixed_start
            elif first <= k < last and best_words[k - first] != words[k]:
                wrong = True
                piece = _case(piece, best_words[k - first])
            elif _odd_number(piece):
                wrong = True
                piece = piece.translate(DIGITS)
            out.append(piece)
            at = m.end()
        out.append(fixed[at:])
        done = "".join(out)
        if wrong:
            found.append((i, "misread"))
        if broken:
            found.append((i, "hyphen"))
            carry = (tokens[-1].group(), i)
            done = done.rstrip(BREAK_MARKS + " ")
            done = done[: len(done) - len(tokens[-1].group())]
        parts.append(done.strip() if not broken else done.lstrip())
    if carry:
        parts.append(carry[0])
    close()
    return "\n\n".join(paragraphs), sorted(set(found))


def _odd_number(word: str) -> bool:
    """A number with letters read for digits."""
    return bool(re.fullmatch(r"[0-9]+[SOl]|[SOl][0-9]{1,3}|[0-9]+[SOl][0-9]+", word))


def _break(left: str, mark: str, following: str | None, reader: Reader) -> bool:
    """Whether the line end divides a word with a mark that is none of its characters."""
    if mark in "­¬":
        return True
    words, low = reader.words, left.lower().replace("‐", "-")
    m = re.match(r"\s*([^\W_]+(?:[-‐][^\W_]+)*)", following) if following else None
    if not m:
        return low not in words
    right = m.group(1).lower().replace("‐", "-")
    joined, kept = words.get(low + right, (0, 0))[0], words.get(f"{low}-{right}", (0, 0))[0]
    if joined or kept:
        return joined >= kept
    for form, is_break in ((low + right, True), (f"{low}-{right}", False)):
        if reader.viterbi([form])[0] != form:
            return is_break
    return low.rsplit("-", 1)[-1] not in words or right not in words


def _case(old: str, new: str) -> str:
    return new.capitalize() if old[:1].isupper() else new


def _join(parts: list[str]) -> str:
    """Lines joined by blanks; scripts without spaces, and words with a hyphen of their own, are joined tightly."""
    out = parts[0]
    for p in parts[1:]:
        tight = not out or out[-1] == " " or re.fullmatch(r"[ក-៓]{2}|[一-鿿、。，；]{2}", out[-1] + p[:1]) or (re.search(r"\w[-‐]$", out) and p[:1].isalpha())
        out += p if tight else " " + p
    return out


OUT = T.StructType(
    [
        T.StructField("section_id", T.LongType()),
        T.StructField("repaired", T.StringType()),
        T.StructField("found", T.ArrayType(T.StructType([T.StructField("line_no", T.LongType()), T.StructField("kind", T.StringType())]))),
    ]
)


def repair_scans(sections: DataFrame, *, words: int = WORDS, pairs: int = PAIRS, khmer_words: int = KHMER_WORDS) -> DataFrame:
    """Repair the scanned sections of ``sections`` (section_id, source, page, ocr, text): section_id, repaired, found.

    ``found`` lists line numbers from 0 and kinds: header, page_number, hyphen, misread. Sections that
    were not scanned (false or null) are read for the language counts only; null ids and texts give no
    rows; a null source is a source of its own; null pages have no bare page numbers; repeated rows count
    once; empty texts give empty results. The counts cover all sections; the models keep the most
    frequent ``words``, ``pairs`` and ``khmer_words``.
    """
    spark = sections.sparkSession
    rows = sections.select(F.col("section_id").cast("long").alias("section_id"), F.coalesce("source", F.lit("")).alias("source"), F.col("page").cast("int").alias("page"), F.coalesce("ocr", F.lit(False)).alias("ocr"), "text").where(F.col("section_id").isNotNull() & F.col("text").isNotNull())
    model_ = spark.sparkContext.broadcast(learn(rows, words, pairs, khmer_words))  # bounded by the three parameters
    scanned = rows.where("ocr")
    model = furniture(scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model_.value)
        for b in batches:
            got = [repair(t, p, h or [], d, reader) for p, t, h, d in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([[{"line_no": i, "kind": k} for i, k in g[1]] for g in got], pa.list_(pa.struct([("line_no", pa.int64()), ("kind", pa.string())])))], names=OUT.names
            )

    return scanned.join(model, "source", "left").select("section_id", "page", "text", "headers", "distance").mapInArrow(run, OUT)


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_scans(spark.read.parquet(f"{sf_dir}/sections.parquet").select("section_id", "source", "page", "ocr", "text"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = repaired(spark, sf_dir).select("section_id", F.explode("found").alias("f"))
    return f.select("section_id", F.col("f.line_no").alias("line_no"), F.col("f.kind").alias("kind")).distinct()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark, sf_dir).select("section_id", "repaired").dropDuplicates(["section_id"])
