"""Long exact spans shared between records: anchors, rolling probes and extension, in one pass.

Anchors are blocks of fixed length. Every rolling window of a text is a candidate; those with the lowest
hash within a stretch are the anchors, so any run of the wanted length holds an anchor, and two texts that
share a run share the anchor too. Both sides of the index therefore take one window in some forty, which
is shuffled by hash; nothing is broadcast that grows with the data, and the texts are read once for it.

Anchors that stand in several texts are widened: a run of the wanted length reaches beyond the anchor far
enough to hold one of a few longer windows around it, which are hashed and met again. So short common
phrases pair no texts. Texts that meet are compared exactly. How much of a text is shared follows from
counting the windows of the wanted length at the places that meet, without pairing the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.llm.splitting import window_hashes
from folioscan.runtime import materialise

LEAST = 120
STEPS = 6  # wider windows around an anchor
SLOTS = 1 << 24  # bits of the filter over the keys of texts that meet
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The lowest of every w neighbouring values, by running minima of blocks in both directions."""
    m = len(h)
    if m < w:
        return np.empty(0, h.dtype)
    x = np.concatenate([h, np.full(-m % w, TOP, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()[:m]
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()[:m]
    return np.minimum(back[: m - w + 1], ahead[w - 1 :])


def anchor_places(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the window hashes that are the lowest of some w neighbours; of equal neighbours as few as still reach into every stretch."""
    low = sliding_min(h, w)
    if not len(low):
        return np.empty(0, np.int64)
    edge = np.full(w - 1, TOP, np.uint64)
    at = np.flatnonzero(h == ~sliding_min(np.concatenate([edge, ~low, edge]), w))
    v = h[at]
    if len(at) > 2 and (v[1:] == v[:-1]).any():
        keep, last = np.ones(len(at), bool), 0
        for i in np.flatnonzero((v[1:-1] == v[:-2]) & (v[1:-1] == v[2:])) + 1:
            last = i - 1 if keep[i - 1] else last
            if v[last] == v[i] and at[i + 1] - at[last] <= w:
                keep[i] = False
        at = at[keep]
    return at


def lengths(least: int) -> tuple[int, int, int, int]:
    """(length of an anchor, windows of which one is taken, step of the wider windows, their length)."""
    anchor = max(8, 2 * least // 5)
    room = least - anchor
    step = max(1, -(-room // STEPS))
    return anchor, room + 1, step, least - step


def text_key(text: str | Column = "text") -> Column:
    return F.xxhash64(text)


def text_check(text: str = "text") -> Column:
    """A second hash, which with the key tells equal texts."""
    return F.xxhash64(F.lit("c"), F.col(text))


def anchors(texts: DataFrame, least: int) -> DataFrame:
    """(h, key, pos): the anchors of (key, text)."""
    size, w, _, _ = lengths(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ps = [], []
            for text in b.column(1).to_pylist():
                h = window_hashes(code_points(text), size)[size:]
                at = anchor_places(h, w)
                hs.append(h[at].view(np.int64))
                ps.append(at.astype(np.int32))
            keys = np.repeat(b.column(0).to_numpy(), [len(p) for p in ps])
            join = lambda x, kind: pa.array(np.concatenate(x) if x else np.empty(0, kind))
            yield pa.RecordBatch.from_arrays([join(hs, np.int64), pa.array(keys), join(ps, np.int32)], names=["h", "key", "pos"])

    return texts.select("key", "text").mapInArrow(run, "h long, key long, pos int")


def in_several(rows: DataFrame) -> DataFrame:
    """The rows (h, key, ...) whose hash stands under at least two keys.

    Keys are reduced to two before the shuffle, so a hash that millions of texts share is no hot group,
    and the join back may be split by its larger side.
    """
    several = rows.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("h")
    return rows.join(several, "h", "left_semi")


def with_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, check, text), one row for each different text whose key is among ``keys``.

    Texts whose key cannot be among them are dropped before the shuffle by a filter of SLOTS bits, which
    is sent out as at most SLOTS / 64 rows; beyond that it lets more through, but never drops a match.
    """
    slot = F.pmod(F.col("key"), F.lit(SLOTS))
    word = F.floor(slot / 64).cast("int")
    bits = F.broadcast(keys.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(key & 63 AS INT))")).alias("bits")))
    d = docs.where(F.length("text") > 0).select(text_key().alias("key"), text_check().alias("check"), "text").withColumn("word", word)
    d = d.join(bits, "word").where(F.expr("shiftright(bits, CAST(key & 63 AS INT)) & 1") == 1).drop("word", "bits")
    return d.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key", "check").agg(F.first("text").alias("text"))


def meetings(docs: DataFrame, least: int) -> DataFrame:
    """(h, key, pos): wider windows around anchors that stand in several texts, with the place of the anchor; written to the shared folder."""
    if least < 16:
        raise ValueError("least must be at least 16")
    size, _, step, wide = lengths(least)
    long_ = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).select(text_key().alias("key"), "text")
    met = materialise(in_several(materialise(anchors(long_, least), "anchors")).select("key", "pos"), "met")
    places = met.groupBy("key").agg(F.collect_set("pos").alias("places"))  # bounded by the length of one text

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for key, text, places_ in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h = window_hashes(code_points(text), wide)[wide:]
                at = np.array(places_, np.int64)
                start = at[:, None] - step * np.arange(STEPS)[None, :]
                ok = (start >= 0) & (start < len(h)) & (start + wide >= at[:, None] + size)
                r, c = np.nonzero(ok)
                out[0].append(h[start[r, c]].view(np.int64))
                out[1].append(np.full(len(r), key, np.int64))
                out[2].append(at[r].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, k)) for c, k in zip(out, (np.int64, np.int64, np.int32), strict=True)], names=["h", "key", "pos"])

    texts = with_keys(docs, met.select("key"))
    wider = materialise(texts.join(places, "key").select("key", "text", "places").mapInArrow(widen, "h long, key long, pos int"), "wider")
    return materialise(in_several(wider).distinct(), "meetings")


def stretches(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length): the maximal stretches of a all of whose windows of ``least`` stand in b, and where their first window does (first place)."""
    ha, hb = window_hashes(a, least)[least:], window_hashes(b, least)[least:]
    if not len(ha) or not len(hb):
        return []
    known, first = np.unique(hb, return_index=True)
    at = np.minimum(np.searchsorted(known, ha), len(known) - 1)
    inside = np.r_[False, known[at] == ha, False]
    begin, end = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    out = []
    for s, e in zip(begin.tolist(), end.tolist(), strict=True):
        j = int(first[at[s]])
        if (a[s : s + least] == b[j : j + least]).all():
            out.append((s, j, e - s + least - 1))
    return out


def text_spans(docs: DataFrame, *, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Shared stretches of different texts: (members: doc_id, key, check; spans: key, check, other, other_check, start, other_start, length).

    A span is a maximal stretch of the text ``key`` that also stands in the text ``other``; spans of both
    directions are listed. Null ids and texts are left out; texts shorter than ``least`` share nothing;
    repeated rows count once. Other columns are ignored.
    """
    met = meetings(docs, least).select("h", "key").distinct()
    a, b = met.withColumnRenamed("key", "x"), met.withColumnRenamed("key", "y")
    linked = materialise(a.join(b, "h").where("x < y").select("x", "y").distinct(), "pairs")
    members = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", text_key().alias("key"), text_check().alias("check")).distinct()
    texts = with_keys(docs, linked.select(F.explode(F.array("x", "y")).alias("key")))
    left = texts.select(F.col("key").alias("x"), F.col("check").alias("cx"), F.col("text").alias("tx"))
    right = texts.select(F.col("key").alias("y"), F.col("check").alias("cy"), F.col("text").alias("ty"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, cx, tx, y, cy, ty in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                p, q = code_points(tx), code_points(ty)
                rows += [(x, cx, y, cy, *s) for s in stretches(p, q, least)]
                rows += [(y, cy, x, cx, *s) for s in stretches(q, p, least)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=SPAN)

    joined = linked.join(left, "x").join(right, "y").select("x", "cx", "tx", "y", "cy", "ty")
    return members, joined.mapInArrow(extend, ", ".join(f"{c} long" for c in SPAN))


SPAN = ["key", "check", "other", "other_check", "start", "other_start", "length"]


def pairs(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """All pairs of documents with a common run of ``least`` code points: doc_id_a < doc_id_b."""
    members, spans = text_spans(docs, least=least)
    linked = spans.where((F.col("key") < F.col("other")) | ((F.col("key") == F.col("other")) & (F.col("check") < F.col("other_check")))).select("key", "check", "other", "other_check").distinct()
    a = members.select(F.col("doc_id").alias("a"), "key", "check")
    b = members.select(F.col("doc_id").alias("b"), F.col("key").alias("other"), F.col("check").alias("other_check"))
    between = linked.join(a, ["key", "check"]).join(b, ["other", "other_check"]).select("a", "b")
    copies = docs.where(F.length("text") >= least).select("doc_id", text_key().alias("key"), text_check().alias("check")).where(F.col("doc_id").isNotNull()).distinct()
    same = copies.withColumnRenamed("doc_id", "a").join(copies.withColumnRenamed("doc_id", "b"), ["key", "check"]).where("a < b").select("a", "b")
    return between.unionByName(same).select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def coverage(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """How much of each document stands elsewhere: doc_id, n_chars, shared_chars, shared_spans, copies.

    A document whose whole text is that of another is covered entirely. Documents that share nothing
    have zeros; null texts count as empty.
    """
    met = meetings(docs, least)
    size = lengths(least)[0]
    places = met.groupBy("key").agg(F.collect_set("pos").alias("places"))  # bounded by the length of one text

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for key, text, at in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h = window_hashes(code_points(text), least)[least:]
                near = np.zeros(len(h) + 1, np.int64)
                at = np.array(at)
                np.add.at(near, np.clip(at + size - least, 0, len(h)), 1)
                np.add.at(near, np.clip(at + 1, 0, len(h)), -1)
                starts = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                out[0].append(h[starts].view(np.int64))
                out[1].append(np.full(len(starts), key, np.int64))
                out[2].append(starts.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, k)) for c, k in zip(out, (np.int64, np.int64, np.int32), strict=True)], names=["h", "key", "start"])

    texts = with_keys(docs, met.select("key"))
    whole_windows = materialise(texts.join(places, "key").select("key", "text", "places").mapInArrow(emit, "h long, key long, start int"), "windows")
    shared_ = in_several(whole_windows).select("key", "start").distinct()
    step = F.lead("start").over(Window.partitionBy("key").orderBy("start")) - F.col("start")
    covered = (
        shared_.withColumn("step", step)
        .groupBy("key")
        .agg(F.sum(F.least(F.coalesce("step", F.lit(least)), F.lit(least))).alias("part"), F.sum(F.when(F.coalesce(F.col("step") > least, F.lit(True)), 1).otherwise(0)).alias("n"))
    )
    d = docs.select("doc_id", text_key().alias("key"), text_check().alias("check"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.col("text").isNull().alias("none")).where(F.col("doc_id").isNotNull()).distinct()
    sizes = d.where("NOT none").groupBy("key", "check").agg(F.count_distinct("doc_id").alias("copies"))
    out = d.join(covered, "key", "left").join(sizes, ["key", "check"], "left")
    whole = ~F.col("none") & (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_chars") >= least)
    return out.select(
        "doc_id",
        "n_chars",
        F.when(whole, F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0))).cast("long").alias("shared_chars"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("shared_spans"),
        F.when(F.col("none"), F.lit(1)).otherwise(F.coalesce("copies", F.lit(1))).cast("long").alias("copies"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(documents(spark, sf_dir))


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(documents(spark, sf_dir))
