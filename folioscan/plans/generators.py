"""Answer generators and embedders: the contract, the offline ones, and how a name becomes one."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions.vectors import Embedder, HashingEmbedder
from folioscan.operators import prompts
from folioscan.plans.settings import Settings


class Generator(Protocol):
    """Answers questions (query_id, question, language) from results (query_id, rank, source, page, title, heading, score, text): query_id, answer, stop_reason."""

    provider: str
    model: str | None

    def answers(self, questions: DataFrame, results: DataFrame) -> DataFrame: ...


class ExtractiveGenerator:
    """The passages themselves, with their places; needs no model."""

    provider, model = "extractive", None

    def answers(self, questions: DataFrame, results: DataFrame) -> DataFrame:
        made = prompts.extractive_answers(questions, results, "query_id")
        return made.withColumn("stop_reason", F.lit(None).cast("string"))


class ModelGenerator:
    """A language model that is plugged in: ``call`` makes (answer, stop reason) of a user message, in batches on the executors."""

    def __init__(self, provider: str, model: str, call: Callable[[str], tuple[str, str | None]]):
        self.provider, self.model, self.call = provider, model, call

    def answers(self, questions: DataFrame, results: DataFrame) -> DataFrame:
        call = self.call

        @F.pandas_udf("answer string, stop_reason string")
        def run(messages: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([call(m) for m in messages], columns=["answer", "stop_reason"])

        asked = prompts.user_messages(questions, prompts.context_blocks(results, "query_id"), "query_id")
        return asked.withColumn("_a", run("message")).select("query_id", "_a.answer", "_a.stop_reason")


def build_generator(name: str, models: Mapping[str, Callable[[], Generator]] | None = None) -> Generator:
    """The generator of this name; ``auto`` takes the first that is plugged in, and the extractive one without any."""
    models = models or {}
    if name == "extractive" or (name == "auto" and not models):
        return ExtractiveGenerator()
    if name == "auto":
        return next(iter(models.values()))()
    if name not in models:
        raise ValueError(f"no generator named {name!r} is plugged in")
    return models[name]()


def build_embedder(name: str, settings: Settings = Settings(), models: Mapping[str, Callable[[], Embedder]] | None = None) -> Embedder:
    """The embedder of this name; ``hashing`` is always there."""
    if name == "hashing":
        return HashingEmbedder(settings.hashing_dim)
    if not models or name not in models:
        raise ValueError(f"no embedder named {name!r} is plugged in")
    return models[name]()
