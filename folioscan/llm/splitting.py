"""Splitting oversized items at natural boundaries: content-defined chunking.

A rolling hash over a fixed window of characters ranks all positions. The landmark of a piece is the
position of the lowest hash between its least and its greatest size, and the piece ends at the natural
boundary nearest to it. Hashes depend on nearby characters only, so pieces that begin at different
places soon agree on a landmark again, and an edit moves only the cuts around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "⟦MATH_[0-9a-f]{32}⟧"
MASK_LENGTH = 39
ZWSP = "​"
WINDOW = 32
BASE = 0x9E3779B97F4A7C15

#: Boundaries from the strongest to the weakest; a cut goes behind the match.
BOUNDARIES = (
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"(?:[.!?…]+[\"'”’»)\]」』]*\s+|[។៕៘៚。！？।॥]+[\"'”’»)\]」』]*\s*)"),
    re.compile(r"\n"),
    re.compile(r"(?:[;:,]\s+|[、，；：៖]\s*)"),
    re.compile(r"[ \t​ 　]+"),
)
#: Spans that are cut only when they alone exceed the limit.
FORMULA = re.compile(
    MASK + r"|\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{([A-Za-z]+\*?)\}.*?\\end\{\1\}|(?<![\\$])\$(?!\$)(?:\\.|[^$\\\n])+\$(?!\d)", re.S
)

PIECES = T.StructType(
    [
        T.StructField("item_kind", T.StringType()),
        T.StructField("item_key", T.StringType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start_pos", T.LongType()),
        T.StructField("end_pos", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)


def item_size(text: Column, vault: Column | None = None) -> Column:
    """Code points without U+200B; a mask counts as long as its formula, or as it stands without one."""
    plain = F.length(F.translate(text, ZWSP, ""))
    if vault is None:
        return plain.cast("long")
    more = F.aggregate(
        F.regexp_extract_all(text, F.lit(f"({MASK})"), F.lit(1)),
        F.lit(0),
        lambda n, m: n + F.coalesce(F.length(F.element_at(vault, m)) - F.lit(MASK_LENGTH), F.lit(0)),
    )
    return (plain + F.when(F.coalesce(F.size(vault), F.lit(0)) > 0, more).otherwise(F.lit(0))).cast("long")


def window_hashes(points: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hash of the ``window`` code points that end before each position 0..n; positions before a full window get the highest value."""
    n = len(points)
    out = np.full(n + 1, np.iinfo(np.uint64).max, np.uint64)
    if n < window:
        return out
    with np.errstate(over="ignore"):
        base = np.uint64(BASE | 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        step = np.ones(n, np.uint64)
        step[1:] = inverse
        falling = np.cumprod(step)
        step[1:] = base
        rising = np.cumprod(step)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * falling)])
        h = (total[window:] - total[:-window]) * rising[window - 1 :]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out[window:] = h
    return out


def restore_oversized(text: str, vault: dict[str, str], limit: int) -> str:
    """The text with those masks replaced by their formulas that alone exceed the limit: they have to be divided."""
    long_ = {m: f for m, f in vault.items() if f is not None and len(f) > limit}
    return re.sub(MASK, lambda m: long_.get(m.group(), m.group()), text) if long_ else text


def split_text(text: str, vault: dict[str, str] | None, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces (start, end, size) of an item; one piece if it fits. Start and end are positions in ``text``,
    in which masks that exceed the limit have been restored."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    weight = np.ones(n, np.int64)
    weight[points == 0x200B] = 0
    inside = np.zeros(n + 1, bool)  # positions where a cut would divide a formula or a character cluster
    spans = []
    for m in FORMULA.finditer(text):
        a, b = m.span()
        if text[a] == "⟦":
            whole = (vault or {}).get(m.group())
            if whole is not None:
                weight[a:b] = 0
                weight[a] = len(whole)
                inside[a + 1 : b] = True
                continue
            inside[a + 1 : b] = True
            continue
        spans.append((a, b))
    reach = np.concatenate([[0], np.cumsum(weight)])
    total = int(reach[-1])
    if total <= limit:
        return [(0, n, total)]
    for a, b in spans:
        if reach[b] - reach[a] <= limit:
            inside[a + 1 : b] = True
    joined = ((points >= 0x300) & (points < 0x370)) | ((points >= 0x17B4) & (points <= 0x17D3)) | ((points >= 0x900) & (points <= 0x903)) | ((points >= 0x93A) & (points <= 0x94F)) | (points == 0x200D)
    inside[:n] |= joined
    inside[1:n] |= (points[:-1] == 0x17D2) | (points[:-1] == 0x200D) | (points[:-1] == 0x94D)
    free = np.flatnonzero(~inside)
    hashes = window_hashes(points)
    ends = []
    for rx in BOUNDARIES:
        at = np.array([m.end() for m in rx.finditer(text)], np.int64)
        ends.append(at[~inside[at]] if len(at) else at)
    least = max(overlap + 1, limit // 2)
    pieces, start, last = [], 0, 0
    while total - reach[start] > limit:
        low = max(int(np.searchsorted(reach, reach[start] + least, "left")), last + 1)
        high = int(np.searchsorted(reach, reach[start] + limit, "right")) - 1
        end = None
        if high >= low:
            mark = low + int(np.argmin(hashes[low : high + 1]))
            for at in ends:
                i, j = np.searchsorted(at, low), np.searchsorted(at, high, "right")
                if j > i:
                    near = at[i:j]
                    end = int(near[np.argmin(np.abs(near - mark))])
                    break
        if end is None:
            j = int(np.searchsorted(free, high, "right")) - 1
            end = int(free[j])
            if end <= last:
                end = max(high, last + 1)
        pieces.append((start, end, int(reach[end] - reach[start])))
        if end == n:
            return pieces
        after = int(free[np.searchsorted(free, end, "right")])  # the next piece must hold at least this much that is new
        want = max(reach[end] - overlap, reach[start] + 1)
        if reach[after] - want > limit:
            want = min(max(want, reach[after] - limit), reach[end])
            k = int(np.searchsorted(free, int(np.searchsorted(reach, want, "left")), "left"))
        else:
            k = int(np.searchsorted(free, int(np.searchsorted(reach, want, "left")), "right")) - 1
        start, last = min(max(int(free[k]), start + 1), end), end
        if reach[after] - reach[start] > limit:
            start = end
    pieces.append((start, n, int(total - reach[start])))
    return pieces


def split_oversized(items: DataFrame) -> DataFrame:
    """Pieces of all items above their limit.

    ``items``: item_kind, item_key, text, vault (map or null), size, max_size, overlap. Items within the
    limit, null texts, null limits and null keys give no rows. Repeated rows count once. Consecutive
    pieces overlap by ``overlap`` units, by more only where a formula or a cluster would be divided, by
    less where a single formula fills a piece. A formula that alone exceeds the limit is divided; where it
    is masked it is restored first, and positions count in the text so restored.
    """
    over = items.where((F.col("size") > F.col("max_size")) & F.col("item_key").isNotNull()).dropDuplicates(["item_kind", "item_key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                vault = dict(r["vault"] or {})
                text = restore_oversized(r["text"], vault, r["max_size"])
                for i, (s, e, size) in enumerate(split_text(text, vault, r["max_size"], r["overlap"])):
                    rows.append((r["item_kind"], r["item_key"], i, s, e, size, text[s:e]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=PIECES.names)

    return over.select("item_kind", "item_key", "text", "vault", F.col("max_size").cast("int").alias("max_size"), F.col("overlap").cast("int").alias("overlap")).mapInArrow(cut, PIECES)


def all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = F.broadcast(spark.read.parquet(f"{sf_dir}/size_limits.parquet").select("item_kind", "max_size", "overlap"))  # three rows
    sections = spark.read.parquet(f"{sf_dir}/sections.parquet").select(
        F.lit("section").alias("item_kind"), F.col("section_id").cast("string").alias("item_key"), "text", F.lit(None).cast("map<string,string>").alias("vault"), item_size(F.col("text")).alias("size")
    )
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet").select(
        F.lit("chunk").alias("item_kind"), F.col("rec_id").cast("string").alias("item_key"), "text", "vault", item_size(F.col("text"), F.col("vault")).alias("size")
    )
    return sections.unionByName(chunks).join(limits, "item_kind")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(all_items(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: the items that were cut."""
    return pieces(spark, sf_dir).select("item_kind", "item_key").distinct()
