"""Recogniser contracts: cache keys, cache lookup, transcript merge, visual lines. Engines are plugged in from outside."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions.ocr_text import clean_transcript
from folioscan.runtime import materialise


class PageOCR(Protocol):
    """An engine: its cache keys from the newest to the oldest version, and the transcript of one page."""

    def keys(self, mime_type: Column, data: Column) -> Column: ...

    def transcribe(self, data: bytes, mime_type: str) -> tuple[str, bool]: ...


def key(*parts: Column | str, data: Column) -> Column:
    """SHA-256 of the parts, each ended by a zero byte, and the page's bytes."""
    head = [F.concat(F.encode(F.lit(p) if isinstance(p, str) else p, "UTF-8"), F.unhex(F.lit("00"))) for p in parts]
    return F.sha2(F.concat(*head, data), 256)


def vision_keys(version: str, legacy: list[str], mime_type: Column, data: Column) -> Column:
    """The model is no part of the key: any model's transcript may be used again."""
    return F.array(*(key(v, mime_type, data=data) for v in [version, *legacy]))


@dataclass(frozen=True)
class LineEngine:
    """Settings of a line recogniser that change its output, and so its key."""

    engine: str = "line"
    version: str = "2"
    model: str = "default"
    decode: str = "fast"
    min_confidence: float = 0.0
    khmer_only: bool = True
    scale: float = 2.0

    def key(self, mime_type: Column, data: Column) -> Column:
        return key(self.engine, self.version, self.model, self.decode, f"{self.min_confidence:.4f}", "khmer" if self.khmer_only else "all", f"{self.scale:.2f}", mime_type, data=data)


def hybrid_key(version: str, model: str, line: LineEngine, mime_type: Column, data: Column) -> Column:
    return key("hybrid", version, model, line.key(mime_type, data), mime_type, data=data)


def lookup(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with the transcript of their first cached key, pages without any). ``pages`` has page_id and keys; ``cache`` key, transcript."""
    tried = pages.select("page_id", F.posexplode("keys").alias("nth", "key")).join(cache, "key")
    best = tried.groupBy("page_id").agg(F.min_by("transcript", "nth").alias("transcript"))
    return pages.join(best, "page_id"), pages.join(best, "page_id", "left_anti")


def transcribe_pages(pages: DataFrame, engine: Callable[[bytes, str], tuple[str, bool]]) -> DataFrame:
    """Run an engine over (page_id, data, mime_type): page_id, text, truncated, error. A failing page never ends the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                try:
                    text, cut = engine(bytes(r.data), r.mime_type)
                    rows.append((r.page_id, text, cut, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((r.page_id, None, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["page_id", "text", "truncated", "error"])

    return pages.select("page_id", "data", "mime_type").mapInPandas(run, "page_id long, text string, truncated boolean, error string")


def to_cache(done: DataFrame, keys: DataFrame) -> DataFrame:
    """New cache rows (key, transcript): only complete transcripts, under the newest key."""
    ok = done.where(F.col("error").isNull() & ~F.col("truncated"))
    return ok.join(keys, "page_id").select(F.element_at("keys", 1).alias("key"), clean_transcript(F.col("text")).alias("transcript"))


class TranscriptCache:
    """Transcripts by key as a Parquet table that only grows; a key that is there twice has equal transcripts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], "key string, transcript string")
        return self.spark.read.schema("key string, transcript string").parquet(self.path).dropDuplicates(["key"])

    def append(self, rows: DataFrame) -> None:
        rows.select("key", "transcript").write.mode("append").parquet(self.path)


def transcribe_cached(pages: DataFrame, engine: Callable[[bytes, str], tuple[str, bool]], cache: TranscriptCache) -> DataFrame:
    """Transcripts of pages (page_id, data, mime_type, keys from the newest to the oldest): page_id, transcript, truncated, error.

    What any of a page's keys has is used; the rest goes through the engine, and its complete transcripts
    are kept under the newest key. Truncated and failed ones never are.
    """
    hits, rest = lookup(pages, cache.read())
    done = materialise(transcribe_pages(rest, engine), "transcribed")
    cache.append(to_cache(done, rest))
    old = hits.select("page_id", "transcript", F.lit(False).alias("truncated"), F.lit(None).cast("string").alias("error"))
    return old.unionByName(done.select("page_id", clean_transcript(F.col("text")).alias("transcript"), "truncated", "error"))


def patient(engine: Callable[[bytes, str], tuple[str, bool]], *, attempts: int = 3, pause: float = 1.0, pace: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[bytes, str], tuple[str, bool]]:
    """The engine with ``pace`` seconds between calls of a task, and up to ``attempts`` tries with doubling pauses."""
    if attempts < 1:
        raise ValueError("attempts must be at least 1")
    last = [0.0]

    def call(data: bytes, mime_type: str) -> tuple[str, bool]:
        for n in range(attempts):
            wait = last[0] + pace - time.monotonic()
            if pace and wait > 0:
                sleep(wait)
            last[0] = time.monotonic()
            try:
                return engine(data, mime_type)
            except Exception:  # noqa: BLE001
                if n + 1 == attempts:
                    raise
                sleep(pause * 2**n)
        raise AssertionError

    return call


def hybrid_engine(line: Callable[[bytes, str], tuple[str, bool]], vision: Callable[[bytes, str, str], tuple[str, bool]]) -> Callable[[bytes, str], tuple[str, bool]]:
    """The line recogniser's text guides the vision model; without any Khmer in it, or if the model gives nothing, it is the result."""

    def call(data: bytes, mime_type: str) -> tuple[str, bool]:
        read, _ = line(data, mime_type)
        if not any("\u1780" <= c <= "\u17ff" or "\u19e0" <= c <= "\u19ff" for c in read):
            return read, False
        text, cut = vision(data, mime_type, read)
        return (text, cut) if text.strip() else (read, False)

    return call


#: Image suffixes and their MIME types.
IMAGES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp"}


def page_payload(images: list[tuple[str, bytes]], pdf: bytes, render: Callable[[bytes], bytes] | None = None) -> tuple[bytes, str]:
    """What is sent of a page (data, MIME type): its single image of a known kind, else the page rendered as PNG, else the page itself."""
    if len(images) == 1:
        name, data = images[0]
        kind = IMAGES.get("." + name.rsplit(".", 1)[-1].lower())
        if kind and data:
            return data, kind
    if render is not None:
        try:
            return render(pdf), "image/png"
        except Exception:  # noqa: BLE001
            pass
    return pdf, "application/pdf"


def merge_transcripts(pages: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Pages (page_id, text) with the transcript instead of the text where there is one; adds ``ocr``."""
    return pages.join(transcripts.select("page_id", "transcript"), "page_id", "left").select(
        *[c for c in pages.columns if c != "text"], F.coalesce("transcript", "text").alias("text"), F.col("transcript").isNotNull().alias("ocr")
    )


def hybrid_text(vision: Column, line: Column) -> Column:
    """The vision model's text, or the line recogniser's where that is blank."""
    return F.coalesce(F.nullif(F.trim(vision), F.lit("")), line)


def group_lines(regions: DataFrame, *, page: str = "page_id", order: str = "nth") -> DataFrame:
    """Visual lines of regions (page, nth, y, height): adds ``line`` from 0. A line goes on while centres are nearer than 0.8 of the greater height."""
    w = Window.partitionBy(page).orderBy(order)
    centre = F.col("y") + F.col("height") / 2
    r = regions.withColumn("_c", centre)
    near = F.abs(F.col("_c") - F.lag("_c").over(w)) < 0.8 * F.greatest("height", F.lag("height").over(w))
    return r.withColumn("line", F.sum(F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).over(w) - 1).drop("_c")


def text_from_regions(regions: DataFrame, *, min_confidence: float = 0.0, page: str = "page_id", order: str = "nth") -> DataFrame:
    """Text of a page from its regions that are confident enough: words by blanks, lines by line breaks. A page bounds the groups."""
    lines = group_lines(regions.where(F.col("confidence") >= min_confidence), page=page, order=order)
    made = lines.groupBy(page, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x.text), " ").alias("t"))
    return made.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x.t), "\n").alias("text"))


def choose_engine(provider: str, *, vision: bool, hybrid: bool, line: bool) -> str:
    """The named engine, or with ``auto`` the first available of vision, hybrid and line; else none."""
    if provider != "auto":
        return provider
    return next((n for n, there in (("vision", vision), ("hybrid", hybrid), ("line", line)) if there), "none")
