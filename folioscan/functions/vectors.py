"""Vector functions and the offline hashing embedder."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions.plain import search_tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def is_finite_vector(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


class Embedder(Protocol):
    """What makes vectors: a name that the index remembers, a dimension, and a column function."""

    name: str
    dimension: int

    def column(self, text: Column, *, query: bool = False) -> Column: ...


class ModelEmbedder:
    """A dense model plugged in as a loader; it is loaded once in each Python worker and encodes Arrow batches.

    ``load`` returns a function from texts to a matrix. Models of the e5 family expect a prefix.
    """

    def __init__(self, name: str, dimension: int, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.name, self.dimension, self.load = name, dimension, load

    def column(self, text: Column, *, query: bool = False) -> Column:
        load, prefix = self.load, ("query: " if query else "passage: ") if "e5" in self.name.lower() else ""

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for s in batches:
                m = np.asarray(encode([prefix + (t or "") for t in s]), np.float32)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                yield pd.Series(list(m / np.where(n > 0, n, 1)))

        return F.when(text.isNotNull(), embed(text))


class HashingEmbedder:
    """Signed feature hashing of search tokens and their bigrams, log-weighted, at length one."""

    def __init__(self, dimension: int = 1024):
        if not 64 <= dimension <= 65536:
            raise ValueError("dimension must be between 64 and 65536")
        self.dimension = dimension
        self.name = f"hashing-{dimension}"

        self._slots: dict[str, tuple[int, float]] = {}

    def slot(self, feature: str) -> tuple[int, float]:
        """Place and sign of a feature; a bounded cache keeps the frequent ones."""
        got = self._slots.get(feature)
        if got is None:
            h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
            got = (h % self.dimension, 1.0 if h >> 63 else -1.0)
            if len(self._slots) < 1 << 20:
                self._slots[feature] = got
        return got

    def vector(self, text: str) -> np.ndarray:
        tokens = search_tokens(text)
        out = [0.0] * self.dimension
        for f, n in Counter(tokens).items():
            at, sign = self.slot("u:" + f)
            out[at] += sign * (1.0 + math.log(n))
        for (a, b), n in Counter(zip(tokens, tokens[1:], strict=False)).items():
            at, sign = self.slot(f"b:{a}\0{b}")
            out[at] += sign * 0.5 * (1.0 + math.log(n))
        v = np.array(out, np.float32)
        length = float(np.linalg.norm(v))
        return v / length if length else v

    def column(self, text: Column, *, query: bool = False) -> Column:
        dimension = self.dimension

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = HashingEmbedder(dimension)
            for s in batches:
                yield s.map(lambda t: None if t is None else model.vector(t))

        return embed(text)
