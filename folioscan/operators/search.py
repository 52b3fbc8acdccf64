"""Exact top-k search, restored results and the context budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions.formulas import unmask_latex
from folioscan.functions.khmer import strip_word_boundaries
from folioscan.functions.vectors import cosine_similarity
from folioscan.operators.index import filter_sources

QUERY_BYTES = 64 << 20
CELLS = 4_000_000


def top_k(table: DataFrame, query: list[float], k: int, *, threshold: float = -1.0, sources: list[str] | None = None, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """The k rows most similar to one vector, score at least ``threshold``; ties go to the lower key. Adds ``score``."""
    q = [float(x) for x in query]
    if k <= 0 or not any(q):
        return table.withColumn("score", F.lit(0.0)).limit(0)
    rows = filter_sources(table, sources).where(F.col(embedding).isNotNull())
    vector = F.array(*(F.lit(x) for x in q))
    sized = F.assert_true(F.size(embedding) == len(q), F.lit("the query has another dimension than the index")).isNull()
    return rows.where(sized).withColumn("score", cosine_similarity(F.col(embedding), vector)).where(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(k)


def batched_top_k(
    table: DataFrame, queries: DataFrame, k: int, *, threshold: float = -1.0, key: str = "id", embedding: str = "embedding", query_key: str = "query_id", exclude_self: bool = False, max_query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """The k most similar rows of every query (query_key, embedding): query_key, key, score, rank.

    Queries are taken in blocks: every block goes to all executors and is scored against Arrow batches
    of the table by matrix products; each batch keeps its k best per query, so that only k rows per
    query and batch are shuffled. A block holds at most ``max_query_bytes``, which bounds what is sent
    out; more queries mean more passes over the table. Null and zero vectors match nothing.
    """
    spark = table.sparkSession
    if k <= 0:
        return spark.createDataFrame([], T.StructType([queries.schema[query_key], table.schema[key], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    qtype, ktype = queries.schema[query_key].dataType, table.schema[key].dataType
    schema = T.StructType([T.StructField("q", qtype), T.StructField("x", ktype), T.StructField("score", T.DoubleType())])
    usable = F.col(embedding).isNotNull() & F.exists(embedding, lambda x: x != 0) & ~F.exists(embedding, lambda x: F.isnan(x))
    asked = queries.where(usable).select(F.col(query_key).alias("q"), F.col(embedding).cast("array<float>").alias("v"))
    n, dim = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    parts: list[DataFrame] = []
    blocks = max(1, -(-n * (dim or 1) * 4 // max_query_bytes))
    rows = table.where(usable).select(F.col(key).alias("x"), F.col(embedding).cast("array<float>").alias("v"))
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        got = part.toArrow()  # at most about max_query_bytes
        if not got.num_rows:
            continue
        sent = spark.sparkContext.broadcast((got.column("q").to_pylist(), unit_rows(got.column("v").combine_chunks())))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, m = sent.value
            lookup = {q: i for i, q in enumerate(names)} if exclude_self else {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(0).to_pylist()
                order = np.argsort(np.array(keys), kind="stable")
                order_of = np.empty(len(keys), np.int64)
                order_of[order] = np.arange(len(keys))
                v = unit_rows(batch.column(1))
                if v.shape[1] != m.shape[1]:
                    raise ValueError("the queries have another dimension than the index")
                most = min(k, len(keys))
                slice_ = max(1, CELLS // len(keys))
                for a in range(0, len(names), slice_):  # bounds the score matrix
                    s = m[a : a + slice_] @ v.T
                    for j, x in enumerate(keys) if lookup else ():
                        i = lookup.get(x, -1) - a
                        if 0 <= i < len(s):
                            s[i, j] = -9.0
                    least = np.partition(s, -most, axis=1)[:, -most]
                    qi, xi = np.nonzero(s >= np.maximum(least, threshold)[:, None])
                    score_ = s[qi, xi]
                    by = np.lexsort((order_of[xi], -score_, qi))
                    qi, xi, score_ = qi[by], xi[by], score_[by]
                    starts = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.empty(0, np.int64)
                    nth = np.arange(len(qi)) - np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
                    keep = np.flatnonzero((nth < k) & (score_ > -2.0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[a + i] for i in qi[keep]], pa_type(qtype)), pa.array([keys[j] for j in xi[keep]], pa_type(ktype)), pa.array(score_[keep], pa.float64())], names=["q", "x", "score"]
                    )

        parts.append(rows.mapInArrow(score, schema))
    if not parts:
        return spark.createDataFrame([], schema).select(F.col("q").alias(query_key), F.col("x").alias(key), "score", F.lit(0).alias("rank"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "x")
    ranked = every.dropDuplicates(["q", "x"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("x").alias(key), "score", "rank")


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows of length one."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def pa_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def restored_columns() -> list[Column]:
    """Fields of a result as they are shown: formulas restored, score rounded, empty titles and headings."""
    return [
        *(F.col(c) for c in ("id", "source", "chunk_index", "page")),
        F.round("score", 6).alias("score"),
        strip_word_boundaries(unmask_latex(F.col("text"), F.col("vault"))).alias("text"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("heading", F.lit("")).alias("heading"),
    ]


def restored(hits: DataFrame) -> DataFrame:
    return hits.select(*restored_columns())


def fit_context(sizes: Column, limit: int) -> Column:
    """Positions (from 1) of the passages that fit: the first always; one that would overflow is skipped, later ones are still tried."""
    def step(a: Column, n: Column, i: Column) -> Column:
        fits = (i == 0) | (a.used + n <= limit)
        return F.struct(F.when(fits, a.used + n).otherwise(a.used).alias("used"), F.when(fits, F.concat(a.kept, F.array(i + 1))).otherwise(a.kept).alias("kept"))

    items = F.transform(sizes, lambda n, i: F.struct(n.cast("long").alias("n"), i.alias("i")))
    return F.aggregate(items, F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept")), lambda a, x: step(a, x.n, x.i), lambda a: a.kept)


def fit_results(hits: DataFrame, group: str, limit: int = 12_000, *, order: str = "rank", text: str = "text") -> DataFrame:
    """The results of each query that fit the context budget, in order. A query has at most top-k rows."""
    listed = hits.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length(text).alias("n")))).alias("l"))
    kept = listed.select(group, "l", fit_context(F.transform("l", lambda x: x.n), limit).alias("k")).select(group, F.explode(F.transform("k", lambda i: F.element_at("l", i).o)).alias(order))
    return hits.join(kept, [group, order])
