"""Asking, ingesting, listing and deleting as functions with the arguments of the endpoints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.khmer import detect_language
from folioscan.functions.vectors import Embedder
from folioscan.operators import index as chunk_index
from folioscan.operators.chunking import chunk_streams, lost_tokens
from folioscan.operators.index import ChunkIndex, DuplicateSourceError
from folioscan.operators.search import batched_top_k, fit_results, restored_columns
from folioscan.plans import pipeline
from folioscan.plans.generators import ExtractiveGenerator, Generator
from folioscan.plans.settings import Settings, check_request, check_text
from folioscan.runtime import materialise
from folioscan.sources import files


class NotFoundError(LookupError):
    """There is no such source."""


class IntegrityError(RuntimeError):
    """A formula would be lost between the sections and the chunks."""


@dataclass
class IngestResult:
    sources: int
    chunks: int
    formulas: int
    skipped: int
    failed: int
    errors: DataFrame


class Service:
    def __init__(self, spark: SparkSession, index: ChunkIndex, embedder: Embedder, generator: Generator | None = None, settings: Settings = Settings()):
        self.spark, self.index, self.embedder, self.settings = spark, index, embedder, settings
        self.generator = generator or ExtractiveGenerator()

    # -- ingest

    def _rows(self, sections: DataFrame, documents: DataFrame) -> DataFrame:
        """Index rows of sections, written once; IntegrityError if a formula is lost."""
        streams = materialise(pipeline.prepare_streams(sections), "joined")
        chunks = materialise(chunk_streams(streams, size=self.settings.chunk_size, overlap=self.settings.chunk_overlap), "chunks")
        lost = lost_tokens(streams, chunks).first()
        if lost is not None:
            raise IntegrityError(f"formula {lost['token']} of {lost['source']} is in no chunk")
        return materialise(pipeline.embedded_chunks(chunks, documents, self.embedder), "rows")

    def ingest_text(self, text: str, source_name: str, *, format: str = "text", replace: bool = True) -> IngestResult:  # noqa: A002
        """Index one pasted text under its name; DuplicateSourceError if it is there and may not be replaced."""
        check_text(text, source_name, self.settings)
        if format not in ("text", "markdown"):
            raise ValueError("the format is text or markdown")
        sections = files.pasted_text(self.spark.createDataFrame([(source_name, format, text)], "source string, format string, text string"))
        return self._store(sections, replace=replace)

    def ingest(self, folder: str, *, only: list[str] | None = None, skip_existing: bool = False, catalog: DataFrame | None = None, pdf: Callable[[bytes], list[str]] | None = None, image: Callable[[bytes], str] | None = None) -> IngestResult:
        """Index the files of a folder; a file that fails is counted and listed and stops nothing."""
        found = files.discover_files(self.spark, folder, only=only)
        skipped = 0
        if skip_existing:
            fresh = chunk_index.new_sources(found.drop("content"), self.index.load()).select("source")
            skipped = found.drop("content").count() - fresh.count()
            found = found.join(fresh, "source", "left_semi")
        return self._store(materialise(files.read_sections(found, pdf=pdf, image=image), "sections"), catalog=catalog, skipped=skipped)

    def _store(self, sections: DataFrame, *, replace: bool = True, catalog: DataFrame | None = None, skipped: int = 0) -> IngestResult:
        failed = sections.where(F.col("error").isNotNull()) if "error" in sections.columns else None
        good = sections.where(F.col("error").isNull()) if failed is not None else sections
        documents = good.groupBy("source").agg(F.first("format").alias("format"), F.collect_set(F.when(F.col("ocr"), F.col("page"))).alias("ocr_pages"))
        documents = files.with_titles(documents, catalog) if catalog is not None else documents.withColumn("title", F.lit(""))
        rows = self._rows(good, documents)
        if not replace:
            again = chunk_index.with_sources(rows.select("source").distinct(), self.index.load()).first()
            if again is not None:
                raise DuplicateSourceError(again["source"])
        total = rows.agg(F.count_distinct("source"), F.count("*"), F.coalesce(F.sum(F.size("vault")), F.lit(0))).first()
        if total[1]:
            self.index.replace_all(rows)
        errors = failed.select("source", "error") if failed is not None else self.spark.createDataFrame([], "source string, error string")
        return IngestResult(total[0], total[1], total[2], skipped, errors.count(), errors)

    # -- sources

    def list_sources(self) -> DataFrame:
        return chunk_index.sources(self.index.load())

    def delete_source(self, source: str) -> int:
        removed = self.index.delete_source(source)
        if not removed:
            raise NotFoundError(source)
        return removed

    # -- questions

    def ask(self, prompt: str, *, top_k: int | None = None, score_threshold: float | None = None, sources: list[str] | None = None, generate: bool = True) -> dict:
        """Answer one question: answer (null without ``generate``), language, grounded, results, provider, model, stop_reason."""
        question = check_request(prompt, top_k=top_k, score_threshold=score_threshold, sources=sources, settings=self.settings)
        asked = self.spark.createDataFrame([(1, question)], "query_id long, question string").withColumn("language", detect_language(F.col("question")))
        answers, results = self.ask_many(asked, top_k=top_k, score_threshold=score_threshold, sources=sources, generate=generate)
        shown = results.orderBy("rank").collect()  # top_k rows at most
        a = answers.first()
        return {"answer": a["answer"], "language": a["language"], "grounded": bool(shown), "results": shown, "provider": a["provider"], "model": a["model"], "stop_reason": a["stop_reason"]}

    def ask_many(self, questions: DataFrame, *, top_k: int | None = None, score_threshold: float | None = None, sources: list[str] | None = None, generate: bool = True) -> tuple[DataFrame, DataFrame]:
        """(answers, results) of many questions (query_id, question, language) at once."""
        s = self.settings
        table = chunk_index.filter_sources(self.index.load(), sources)
        vectors = questions.select("query_id", self.embedder.column(F.col("question"), query=True).alias("embedding"))
        threshold = s.score_threshold if score_threshold is None else score_threshold
        hits = batched_top_k(table, vectors, top_k or s.top_k, threshold=threshold)
        found = hits.join(table.select("id", "source", "chunk_index", "page", "text", "vault", "title", "heading"), "id").select("query_id", "rank", *restored_columns())
        results = materialise(fit_results(found, "query_id", s.max_context_chars), "results")
        if generate:
            made = self.generator.answers(questions, results)
        else:
            made = questions.select("query_id", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("stop_reason"))
        answers = questions.select("query_id", "language").join(made, "query_id", "left")
        return answers.withColumns({"provider": F.lit(self.generator.provider), "model": F.lit(self.generator.model).cast("string")}), results
