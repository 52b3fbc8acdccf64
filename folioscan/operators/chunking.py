"""Recursive chunking with whole formulas and clusters, page spans and stable ids."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import plain
from folioscan.functions.patterns import SEPARATORS, TOKEN, TOKEN_RE, ZWSP
from folioscan.operators.structure import STRETCH
from folioscan.runtime import materialise

TRIM = " \t\n\r" + ZWSP
Span = tuple[int, int]
CHUNKS = "array<struct<text:string,start:int,end:int>>"


def unit_offsets(text: str, vault: dict[str, str]) -> list[int]:
    """Size of the text before each position: word marks are nothing, a token is as long as its formula."""
    sizes = (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != ord(ZWSP)).astype(np.int64)
    for m in TOKEN_RE.finditer(text):
        sizes[m.start() : m.end()] = 0
        sizes[m.end() - 1] = len(vault.get(m.group(), m.group()))
    return [0, *np.cumsum(sizes).tolist()]


class Splitter:
    """Cuts at the strongest separator present, packs what fits, and takes apart what doesn't."""

    def __init__(self, size: int = 500, overlap: int = 50, separators: Sequence[str] = SEPARATORS, length: Callable[[str], int] | None = None):
        if size < 1 or not 0 <= overlap < size:
            raise ValueError("the overlap must be less than the chunk size")
        self.size, self.overlap, self.separators, self.length = size, overlap, tuple(separators), length

    def spans(self, text: str, vault: dict[str, str] | None = None) -> list[Span]:
        """Chunk spans of the text, trimmed; blank ones are dropped."""
        if self.length:
            measure = lambda a, b: self.length(text[a:b])
        else:
            sizes = unit_offsets(text, vault or {})
            measure = lambda a, b: sizes[b] - sizes[a]
        out = []
        for a, b in self._cut(text, 0, len(text), 0, measure):
            while a < b and text[a] in TRIM:
                a += 1
            while b > a and text[b - 1] in TRIM:
                b -= 1
            if a < b:
                out.append((a, b))
        return out

    def _parts(self, text: str, a: int, b: int, level: int) -> tuple[list[Span], int]:
        """The span divided behind the strongest separator it has, and the level below that."""
        for k in range(level, len(self.separators)):
            sep = self.separators[k]
            if sep and text.find(sep, a, b) >= 0:
                cuts, at = [a], text.find(sep, a, b)
                while at >= 0:
                    cuts.append(at + len(sep))
                    at = text.find(sep, at + len(sep), b)
                if cuts[-1] < b:
                    cuts.append(b)
                return list(zip(cuts, cuts[1:], strict=False)), k + 1
        atoms, at = [], a
        for p in plain.pieces(text[a:b]):
            for unit in [p] if TOKEN_RE.fullmatch(p) or plain.has_khmer(p) else p:
                atoms.append((at, at + len(unit)))
                at += len(unit)
        return atoms, len(self.separators)

    def _cut(self, text: str, a: int, b: int, level: int, measure) -> Iterator[Span]:
        parts, below = self._parts(text, a, b, level)
        waiting: list[Span] = []
        for s, e in parts:
            if measure(s, e) <= self.size:
                waiting.append((s, e))
                continue
            yield from self._pack(waiting, measure)
            waiting = []
            if below >= len(self.separators) and level >= len(self.separators) or (s, e) == (a, b) and below >= len(self.separators):
                yield s, e
            else:
                yield from self._cut(text, s, e, below, measure)
        yield from self._pack(waiting, measure)

    def _pack(self, parts: list[Span], measure) -> Iterator[Span]:
        """Neighbouring parts up to the size; a chunk begins with whole parts of the one before, up to the overlap."""
        first = total = 0
        for k, (s, e) in enumerate(parts):
            n = measure(s, e)
            if total + n > self.size and k > first:
                yield parts[first][0], parts[k - 1][1]
                while first < k and (total > self.overlap or total + n > self.size):
                    total -= measure(*parts[first])
                    first += 1
            total += n
        if first < len(parts):
            yield parts[first][0], parts[-1][1]


def chunk_spans(text: Column, vault: Column, size: int, overlap: int) -> Column:
    """Chunks of a stream's masked, word-marked text: array of (text, start, end)."""

    @F.pandas_udf(CHUNKS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        splitter = Splitter(size, overlap)
        for texts, vaults in batches:
            out = []
            for t, v in zip(texts, vaults, strict=True):
                got = splitter.spans(t, dict(v or {})) if t is not None else []
                rows = [{"text": t[a:b].replace(ZWSP, ""), "start": a, "end": b} for a, b in got]
                out.append([r for r in rows if r["text"]])
            yield pd.Series(out)

    return run(text, vault)


def page_at(starts: Column, position: Column) -> Column:
    """Page of the last part that starts at or before the position: an as-of lookup in the sorted starts."""
    return F.element_at(F.filter(starts, lambda s: s.offset <= position), -1).page


def chunk_id(source: Column, index: Column, page: Column, text: Column) -> Column:
    nul = F.lit("\0")
    return F.substring(F.sha2(F.concat(source, nul, index.cast("string"), nul, F.coalesce(page.cast("string"), F.lit("None")), nul, text), 256), 1, 32)


def chunk_streams(streams: DataFrame, *, size: int = 700, overlap: int = 100) -> DataFrame:
    """Chunks of joined streams (source, stream, heading, text, starts, vault).

    Result: id, source, chunk_index (continuous within a source), text, vault, page, page_end, heading.
    Chunk numbers come from counts per stream, so that no source is ordered chunk by chunk. The cut
    streams are written once below the shared folder.
    """
    cut = streams.select("source", "stream", "part", "heading", "starts", "vault", chunk_spans(F.col("text"), F.col("vault"), size, overlap).alias("chunks"))
    cut = materialise(cut, "streams")  # read twice: for the counts and for the rows
    # numbers of the chunks before each stream, in two levels: blocks of streams, and streams within them
    counts = cut.select("source", "stream", "part", F.floor(F.col("stream") / STRETCH).alias("block"), F.size("chunks").alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("source", "block").agg(F.sum("n").alias("n")).select("source", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "block").orderBy("stream", "part").rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    before = inner.join(blocks, ["source", "block"]).select("source", "stream", "part", (F.col("base") + F.col("inner")).alias("before"))
    # the number joins before the chunks are taken apart, so that no chunk text is shuffled again
    rows = cut.join(before, ["source", "stream", "part"]).select("source", "heading", "starts", "vault", "before", F.posexplode("chunks").alias("pos", "chunk"))
    page = page_at(F.col("starts"), F.col("chunk.start"))
    out = rows.select(
        "source",
        (F.col("before") + F.col("pos")).cast("int").alias("chunk_index"),
        F.col("chunk.text").alias("text"),
        F.map_filter("vault", lambda k, _: F.instr(F.col("chunk.text"), k) > 0).alias("vault"),
        page.alias("page"),
        page_at(F.col("starts"), F.col("chunk.end") - 1).alias("page_end"),
        "heading",
    )
    return out.select(chunk_id(F.col("source"), F.col("chunk_index"), F.col("page"), F.col("text")).alias("id"), "*")


def lost_tokens(streams: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tokens of the streams that no chunk of the source holds; must be empty (source, token)."""
    find = lambda d: d.select("source", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token")).distinct()
    return find(streams).join(find(chunks), ["source", "token"], "left_anti")


def pages_of(offsets: Sequence[int], position: int) -> int:
    """Index of the part at a position, for callers without Spark."""
    return bisect_right(offsets, position) - 1
