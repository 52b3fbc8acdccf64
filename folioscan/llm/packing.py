"""Filling fixed-capacity containers: bulk-synchronous best-fit.

Each round sorts the documents that are not placed yet and the gaps of all containers into ranges of
size. A sweep through every range, from large to small, gives each document the nearest gap that is large
enough and not taken; documents that compete for a gap are settled by rank, the larger one first. What a
range cannot settle by itself goes on to the neighbouring ranges: by then a range is two runs, documents
without a gap and gaps without a document, so ranks and counts per range settle the rest. The gaps are
updated, and the next round follows. A gap that holds several of the largest documents left takes as many
at once, so the number of rounds grows with the logarithm of the documents in a container.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.runtime import materialise

RANGE = 1_000_000  # rows of a range at most, about
SLOT, DOCUMENT = 0, 1


def token_size(text: str = "text"):
    """Tokens of the public byte tokenizer: the UTF-8 bytes and one end token; null text counts as empty."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(1)


def successors(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of matched documents and of their slots in a range sorted from large to small, slots first among equals.

    Each document takes the nearest free slot before it, as a closing bracket takes its opening one:
    brackets of one depth alternate, so a stable sort by depth puts partners side by side.
    """
    step = np.where(kind == SLOT, 1, -1)
    height = np.cumsum(step)
    low = np.minimum.accumulate(np.minimum(height, 0)) if len(height) else height
    keep = np.flatnonzero(~((kind == DOCUMENT) & (height < np.r_[0, low[:-1]])))
    step = step[keep]
    depth = np.cumsum(step) + (step < 0)
    order = np.argsort(depth, kind="stable")
    at, depth = keep[order], depth[order]
    ok = np.flatnonzero((kind[at[:-1]] == SLOT) & (kind[at[1:]] == DOCUMENT) & (depth[:-1] == depth[1:])) if len(at) else at
    return at[ok + 1], at[ok]


def settle(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """What ranges leave to each other: from (range, documents, slots) in order to runs (range, first rank, documents, range of the slots, rank of the first slot).

    Slots are taken from the last rank downwards, as it is the smallest of its range.
    """
    free: list[list[int]] = []
    runs = []
    for part, docs, slots in counts:
        rank = 0
        while rank < docs and free:
            there, left = free[-1]
            n = min(docs - rank, left)
            runs.append((part, rank, n, there, left - 1))
            rank += n
            free[-1][1] -= n
            if not free[-1][1]:
                free.pop()
        if slots:
            free.append([part, slots])
    return runs


def sweep(docs: DataFrame, gaps: DataFrame, largest: int, most: int, parts: int) -> DataFrame:
    """One round: ``docs`` (k, piece, size) with ``bin``, null where no gap was left."""
    spark = docs.sparkSession
    key_type = docs.schema["k"].dataType
    several = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("gap") / largest))).cast("int")
    slots = gaps.withColumn("n", several).select(
        F.when(F.col("n") > 1, F.lit(largest)).otherwise(F.col("gap")).cast("long").alias("v"), F.lit(SLOT).alias("kind"), F.col("bin"), F.lit(None).cast(key_type).alias("k"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("piece")
    )
    rows = slots.unionByName(docs.select(F.col("size").alias("v"), F.lit(DOCUMENT).alias("kind"), F.lit(None).cast("long").alias("bin"), "k", "piece"))
    rows = rows.withColumn("salt", F.xxhash64("bin", "k", "piece"))  # parts equal sizes
    ranges = rows.repartitionByRange(parts, F.desc("v"), "kind", "salt").sortWithinPartitions(F.desc("v"), "kind", "salt").drop("salt")
    schema = T.StructType([*ranges.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        kind = table.column("kind").to_numpy()
        docs_at, slots_at = successors(kind)
        bins = table.column("bin").fill_null(-1).to_numpy().copy()
        bins[docs_at] = bins[slots_at]
        rest = np.ones(len(kind), bool)
        rest[docs_at] = rest[slots_at] = False
        rank = np.where(kind == SLOT, np.cumsum(rest & (kind == SLOT)), np.cumsum(rest & (kind == DOCUMENT))) - 1
        show = np.flatnonzero(rest | (kind == DOCUMENT))
        out = table.set_column(2, "bin", pa.array(bins, mask=bins < 0)).take(pa.array(show))
        out = out.append_column("part", pa.array(np.full(len(show), TaskContext.get().partitionId(), np.int32)))
        out = out.append_column("rank", pa.array(rank[show], pa.int64(), mask=~rest[show]))
        yield from out.combine_chunks().to_batches()

    swept = materialise(ranges.mapInArrow(run, schema), "sweep")
    left = swept.where("rank IS NOT NULL")
    by = {(r["part"], r["kind"]): r["n"] for r in left.groupBy("part", "kind").agg(F.count("*").alias("n")).collect()}  # two rows a range
    runs = settle([(p, by.get((p, DOCUMENT), 0), by.get((p, SLOT), 0)) for p in sorted({p for p, _ in by})])
    waiting = left.where(F.col("kind") == DOCUMENT).select("k", "piece", F.col("v").alias("size"), "part", "rank")
    done = swept.where((F.col("kind") == DOCUMENT) & F.col("rank").isNull()).select("k", "piece", F.col("v").alias("size"), "bin")
    if not runs:
        return done.unionByName(waiting.select("k", "piece", "size", F.lit(None).cast("long").alias("bin")))
    table = F.broadcast(spark.createDataFrame(runs, "part int, first long, n long, there int, slot long"))  # two rows a range at most
    on = (waiting["part"] == table["part"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    sent = waiting.join(table, on, "left").select("k", "piece", "size", F.col("there").alias("part"), (F.col("slot") - F.col("rank") + F.col("first")).alias("rank"))
    free = left.where(F.col("kind") == SLOT).select("part", "rank", "bin")
    return done.unionByName(sent.join(free, ["part", "rank"], "left").select("k", "piece", "size", "bin"))


def pack(docs: DataFrame, capacity: int, *, key: str = "doc_id", size: str = "size", ranges: int | None = None) -> DataFrame:
    """Assign documents to containers of ``capacity``.

    Result: key, piece (bigint from 0), piece_from (position in the document, in units), piece_size,
    container (bigint), container_offset. A document is divided only if it alone exceeds the capacity:
    it takes whole containers and its remainder is packed like any other document.

    Repeated keys count once (the largest size is taken). Rows with a null key or size are left out, as
    are sizes below 1. An empty table gives an empty result. Other columns are ignored. ``ranges`` is the
    number of ranges a round is sorted into; by default it follows from the number of documents.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = docs.sparkSession
    cap = F.lit(capacity).cast("long")
    sized = (
        docs.select(F.col(key).alias("k"), F.col(size).cast("long").alias("s"))
        .where(F.col("k").isNotNull() & (F.col("s") >= 1))
        .groupBy("k")
        .agg(F.max("s").alias("s"))
    )
    whole = F.floor((F.col("s") - 1) / cap)
    pieces = sized.select("k", "s", F.explode(F.sequence(F.lit(0).cast("long"), whole.cast("long"))).alias("piece"))
    waiting = materialise(pieces.select("k", "piece", F.least(cap, F.col("s") - F.col("piece") * cap).alias("size")), "pieces")
    nothing = spark.createDataFrame([], T.StructType([*waiting.schema.fields, T.StructField("bin", T.LongType())]))
    placed, opened, gaps, turn = [nothing.withColumn("turn", F.lit(0))], 0, None, 0
    cores = spark.sparkContext.defaultParallelism
    while True:
        n, total, least, largest = waiting.agg(F.count("*"), F.sum("size"), F.min("size"), F.max("size")).first()
        if not n:
            break
        fits = gaps.where(F.col("gap") >= least) if gaps is not None else None
        free = fits.count() if fits is not None else 0
        if not free:
            more = -(-total // capacity)
            new = spark.range(opened, opened + more).select(F.col("id").alias("bin"), cap.alias("gap"))
            opened += more
            gaps = new if gaps is None else gaps.unionByName(new)
            fits, free = new, more
        parts = ranges or max(-(-n // RANGE), min(cores, -(-n // 2_000)))
        most = max(1, -(-4 * n // free))  # slots of a gap: not many more than there are documents
        turn += 1
        result = materialise(sweep(waiting, fits, largest, most, parts), "round")
        mine = result.where("bin IS NOT NULL")
        placed.append(mine.withColumn("turn", F.lit(turn)))
        waiting = result.where("bin IS NULL").drop("bin")
        taken = mine.groupBy("bin").agg(F.sum("size").alias("taken"))
        gaps = materialise(gaps.join(taken, "bin", "left").select("bin", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).where("gap > 0"), "gaps")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    before = F.sum("size").over(Window.partitionBy("bin").orderBy("turn", F.desc("size"), "k", "piece").rowsBetween(Window.unboundedPreceding, -1))  # a container holds at most ``capacity`` documents
    return out.select(
        F.col("k").alias(key),
        "piece",
        (F.col("piece") * cap).alias("piece_from"),
        F.col("size").alias("piece_size"),
        F.col("bin").alias("container"),
        F.coalesce(before, F.lit(0)).cast("long").alias("container_offset"),
    )


def document_capacity(spark: SparkSession, sf_dir: str) -> int:
    """The capacity of size_limits for documents."""
    row = spark.read.parquet(f"{sf_dir}/size_limits.parquet").where("item_kind = 'document'").agg(F.max("max_size")).first()
    return int(row[0])


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", token_size().alias("size"))
    return pack(docs, document_capacity(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_found: documents spread over more than one container."""
    spread = packed_documents(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("container").alias("n"))
    return spread.where("n > 1").select("doc_id")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_containers: fill of every container."""
    cap = document_capacity(spark, sf_dir)
    return (
        packed_documents(spark, sf_dir)
        .groupBy("container")
        .agg(F.count("*").alias("pieces"), F.sum("piece_size").alias("used"))
        .withColumn("unused", F.lit(cap).cast("long") - F.col("used"))
    )


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_totals: one row that says whether the packing is whole: documents, pieces, tokens, containers over capacity, documents divided."""
    cap = document_capacity(spark, sf_dir)
    p = materialise(packed_documents(spark, sf_dir), "packed")
    over = p.groupBy("container").agg(F.sum("piece_size").alias("used")).agg(F.count_if(F.col("used") > cap).alias("overfull"))
    sums = p.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("pieces"), F.sum("piece_size").alias("tokens"), F.count_if(F.col("piece") == 1).alias("divided"))
    return sums.crossJoin(over)  # one row each
