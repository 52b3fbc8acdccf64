"""Files as sources: discovery, formats, decoding, catalogue titles, sections."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import plain
from folioscan.functions.khmer import clean_markdown
from folioscan.functions.patterns import FORMATS

SECTIONS = "path string, source string, format string, seq int, text string, page int, ocr boolean, heading string, starts_heading boolean, error string"


def glob_pattern(pattern: str) -> str:
    """A file-name pattern as a regular expression; a star also crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def detect_format(path: Column) -> Column:
    """text, markdown, pdf or image by the suffix; null for other files."""
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def indexable(files: DataFrame, folder: str) -> DataFrame:
    """Files of a folder with their relative path as source and their format, without hidden ones and unknown formats."""
    root = re.sub(r"^file:/*", "/", folder).rstrip("/")
    source = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root) + "/+", "")
    f = files.withColumn("source", source).where(~F.col("source").rlike(r"(^|/)\.")).withColumn("format", detect_format(F.col("source")))
    return f.where(F.col("format").isNotNull())


def discover_files(spark: SparkSession, folder: str, *, only: list[str] | None = None) -> DataFrame:
    """Files below a folder by relative path, without hidden ones: path, source, format, modificationTime, length, content.

    ``only`` keeps paths that match any of the patterns. Contents are read by what uses them, and nothing is sorted.
    """
    f = indexable(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), folder)
    if only:
        f = f.where(F.exists(F.array(*(F.lit(glob_pattern(p)) for p in only)), lambda p: F.regexp_like(F.col("source"), p)))
    return f


def decode_bytes(data: bytes) -> str:
    """UTF-16 by its mark, else UTF-8 with what is invalid replaced; the mark is dropped."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    return data.decode("utf-8", "replace").removeprefix("﻿")


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """source and title of a JSON object of titles by path. Anything but an object is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    return raw.select(F.explode("m").alias("source", "title")).withColumn("title", F.trim("title"))


def with_titles(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files with their catalogue title, or an empty one. Spark broadcasts the catalogue if it is small."""
    return files.join(catalog.dropDuplicates(["source"]), "source", "left").withColumn("title", F.coalesce("title", F.lit("")))


def pasted_text(texts: DataFrame) -> DataFrame:
    """Sections of pasted texts (source, format, text): one each, cleaned of Markdown where that is the format."""
    clean = F.when(F.col("format") == "markdown", clean_markdown(F.col("text"))).otherwise(F.col("text"))
    rows = texts.select("source", "format", F.lit(0).alias("seq"), clean.alias("text"), F.lit(None).cast("int").alias("page"), F.lit(False).alias("ocr"), F.lit("").alias("heading"), F.lit(False).alias("starts_heading"))
    return rows.where(F.regexp_replace("text", r"(?U)\s+", "") != "")


def read_sections(files: DataFrame, *, pdf: Callable[[bytes], list[str]] | None = None, image: Callable[[bytes], str] | None = None) -> DataFrame:
    """Sections of files (path, source, format, content); a file that fails gives one row with ``error``.

    ``pdf`` gives the page texts of a PDF, ``image`` the transcript of an image: both are plugged in,
    and without them such files give an error row.
    """

    def one(data: bytes, kind: str) -> list[tuple]:
        if kind in ("text", "markdown"):
            text = decode_bytes(data)
            if kind == "markdown":
                return [(s["text"], None, False, s["heading"], s["starts_heading"]) for s in plain.markdown_sections(text)]
            return [(text, None, False, "", False)] if text.strip() else []
        if kind == "pdf":
            if pdf is None:
                raise RuntimeError("no PDF reader is plugged in")
            return [(re.sub(r"(?<=[A-Za-z])-\n(?=[a-z])", "", t), n, False, "", False) for n, t in enumerate(pdf(data), 1)]
        if image is None:
            raise RuntimeError("no recogniser is plugged in")
        text = image(data)
        return [(s["text"], 1, True, s["heading"], s["starts_heading"]) for s in plain.markdown_sections(text)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SECTIONS.split(", ")]
        for b in batches:
            rows = []
            for r in b.itertuples():
                try:
                    got = one(bytes(r.content), r.format)
                    rows += [(r.path, r.source, r.format, i, *s, None) for i, s in enumerate(got)]
                except Exception as e:  # noqa: BLE001
                    rows.append((r.path, r.source, r.format, 0, None, None, False, "", False, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=names)
            out["page"] = out["page"].astype("Int32")
            yield out

    return files.select("path", "source", "format", "content").mapInPandas(run, SECTIONS)
