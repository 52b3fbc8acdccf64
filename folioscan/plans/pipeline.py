"""The two pipelines: sections to an indexed chunk table, and questions to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import plain
from folioscan.functions.formulas import mask_latex, restored_length, unmask_latex
from folioscan.functions.khmer import detect_language, looks_garbled, normalize_and_mark, page_parts
from folioscan.functions.vectors import Embedder
from folioscan.operators.chunking import chunk_streams
from folioscan.operators.ocr import merge_transcripts
from folioscan.operators.search import batched_top_k, fit_results, restored_columns
from folioscan.operators.structure import embedding_text, join_broken_words, join_streams, numbered, page_quality, remove_running_lines, running_lines
from folioscan.plans.settings import Settings
from folioscan.runtime import materialise


def prepare_streams(sections: DataFrame) -> DataFrame:
    """Sections (source, seq, text, page, heading, starts_heading) masked, normalised, marked and joined to heading streams."""
    token_key = F.concat(F.coalesce("source", F.lit("")), F.lit("|"), F.col("seq").cast("string"))
    m = sections.where(F.col("text").isNotNull()).withColumn("_m", mask_latex(F.col("text"), token_key))
    m = m.select("source", "seq", "page", "heading", "starts_heading", normalize_and_mark(F.col("_m.masked")).alias("text"), F.col("_m.vault").alias("vault"))
    m = materialise(m.where(F.length("text") > 0), "normalised")  # the Python step runs once
    return join_streams(numbered(m))


def prepare_chunks(sections: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return chunk_streams(prepare_streams(sections), size=settings.chunk_size, overlap=settings.chunk_overlap)


def pages_to_sections(pages: DataFrame, transcripts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sections and warnings of paged documents (page_id, source, page, text), with transcripts (page_id, transcript) instead of text where there are any.

    Pages whose text layer is garbled or blank and that have no transcript are dropped and counted in
    the warnings. Running lines are removed from the text layers; transcripts are Markdown, whose
    heading path carries over from page to page; only page numbers and headings of a source are ordered.
    """
    merged = merge_transcripts(pages, transcripts) if transcripts is not None else pages.withColumn("ocr", F.lit(False))
    layers = merged.where(~F.col("ocr"))
    warnings = page_quality(layers).where(F.size("warnings") > 0).select("source", "warnings")
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") == ""
    kept = layers.where(~blank & ~F.coalesce(looks_garbled(F.col("text")), F.lit(False)))
    clean = remove_running_lines(kept, running_lines(kept)).withColumn("text", join_broken_words(F.col("text")))
    every = clean.select("source", "page", "text", "ocr").unionByName(merged.where("ocr").select("source", "page", "text", "ocr"))

    # each page is read by itself; the heading path at its beginning follows from the last headings of the pages before
    parsed = every.select("source", "page", "ocr", F.when(F.col("ocr"), page_parts(F.col("text"))).otherwise(F.array(F.struct(F.col("text").alias("text"), F.lit(False).alias("starts_heading"), F.array().cast("array<struct<level:int,title:string>>").alias("path")))).alias("parts"))
    parsed = materialise(parsed, "pages")
    heads = parsed.select("source", "page", F.element_at("parts", -1).path.alias("path")).where(F.size("path") > 0)
    before = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    levels = parsed.select("source", "page").distinct().join(heads, ["source", "page"], "left")
    top = F.array_min(F.transform("path", lambda x: x.level))

    def standing(level: int) -> Column:
        here = F.filter("path", lambda x: x.level == level)
        # a heading of this level, or null where one of a lower level ends it
        event = F.when(F.size(here) > 0, F.struct(F.lit(True).alias("on"), F.element_at(here, -1).title.alias("title"))).when(top < level, F.struct(F.lit(False).alias("on"), F.lit(None).cast("string").alias("title")))
        return F.last(event, ignorenulls=True).over(before)

    carried = levels.select("source", "page", *(standing(n).alias(f"h{n}") for n in range(1, 7)))
    path = F.filter(F.array(*(F.when(F.col(f"h{n}.on"), F.struct(F.lit(n).alias("level"), F.col(f"h{n}.title").alias("title"))) for n in range(1, 7))), lambda x: x.isNotNull())
    rows = parsed.join(carried.select("source", "page", path.alias("carried")), ["source", "page"]).select("source", "page", "ocr", "carried", F.posexplode("parts").alias("nth", "part"))
    whole = F.concat(F.when(F.size("part.path") > 0, F.filter("carried", lambda x: x.level < F.array_min(F.transform("part.path", lambda y: y.level)))).otherwise(F.col("carried")), F.col("part.path"))
    blank_part = F.regexp_replace("part.text", r"(?U)\s+", "") == ""
    order = Window.partitionBy("source").orderBy("page", "nth")
    sections = rows.where(~blank_part).select(
        "source", (F.row_number().over(order) - 1).alias("seq"), F.col("part.text").alias("text"), "page", "ocr", F.array_join(F.transform(whole, lambda x: x.title), plain.P.HEADING_SEPARATOR).alias("heading"), F.col("part.starts_heading").alias("starts_heading")
    )
    return sections, warnings


def ingest_report(chunks: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row a source: chunks, formulas, pages and warnings."""
    r = chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.size("vault")).cast("long").alias("formulas"), F.count_distinct("page").alias("pages"))
    if warnings is None:
        return r.withColumn("warnings", F.array().cast("array<string>"))
    return r.join(warnings, "source", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def document_totals(streams: DataFrame) -> DataFrame:
    """Per source: formulas and restored characters."""
    return streams.groupBy("source").agg(F.sum(F.size("vault")).alias("formulas"), F.sum(restored_length(F.col("text"), F.col("vault"))).alias("characters"))


def embedded_chunks(chunks: DataFrame, documents: DataFrame, embedder: Embedder, created_at: str | None = None) -> DataFrame:
    """Index rows of chunks: with title, format, language, and the vector of header and restored text.

    ``documents``: source, format, title, ocr_pages (array, may be null).
    """
    j = chunks.join(documents, "source", "left")
    text = unmask_latex(F.col("text"), F.col("vault"))
    return j.select(
        "id", "source", "chunk_index", "text", "vault", "page", "page_end", F.coalesce("format", F.lit("text")).alias("format"),
        (F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()).alias("created_at"),
        detect_language(text).alias("language"), F.coalesce(F.array_contains("ocr_pages", F.col("page")), F.lit(False)).alias("ocr"),
        F.coalesce("title", F.lit("")).alias("title"), "heading",
        embedder.column(embedding_text(F.coalesce("title", F.lit("")), F.coalesce("heading", F.lit("")), text)).alias("embedding"),
    )


def search(index: DataFrame, questions: DataFrame, embedder: Embedder, settings: Settings = Settings()) -> DataFrame:
    """Restored results of questions (query_id, question), within the context budget: query_id, rank and the fields of ``restored``."""
    asked = questions.where(F.trim("question") != "").select("query_id", embedder.column(F.trim("question"), query=True).alias("embedding"))
    hits = batched_top_k(index, asked, settings.top_k, threshold=settings.score_threshold)
    found = hits.join(index.select("id", "source", "chunk_index", "page", "text", "vault", "title", "heading"), "id")
    shown = found.select("query_id", "rank", *restored_columns())
    return fit_results(shown, "query_id", settings.max_context_chars)
