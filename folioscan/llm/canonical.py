"""One consistent form for text that looks the same: vectorised code-point normalisation.

A batch of Arrow strings becomes one array of code points. Lookup-table gathers replace each of them by
none, one or several (deletion, folding, decomposition), marks are put into canonical order, and pairs
of a base and a mark are composed by vectorised table searches. No string is handled by itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.runtime import materialise

# Characters without any ink or width.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"
# Blanks as wide as a space.
BLANKS = "      "
# Letters and signs drawn alike, each followed by the one that stands for both.
LOOK_ALIKES = (
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԚQ ԜW "
    "οo νv ιi ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC "
    "օo ՕO ոn սu հh ՏS ⲟo ⲣp ⲥc ⲞO ⲢP ⲤC ⲘM ⲎH ⲚN ⲔK ⲦT ⲬX ⲒI ԌG ӏl ҮY үy "
    "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏚS ᏙV ᏞL ᏟC ᏢP ᏦK ᏴB "
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    "ıi ɑa ɡg ‐- ‑- ∆Δ µμ ∑Σ ∏Π ∙· ⋅· ‚, ∕/ ⁄/ ʼ’ ˈ' ʹ′ ∣| ǀ| ։: ∶: ឣអ"
)
# Sequences drawn alike.
SEQUENCES = {"េី": "ើ", "េា": "ោ", "្ដ": "្ត", "ំា": "ាំ", "ំុ": "ុំ"}
#: Compatibility characters that look like what they stand for: ligatures, digraphs, Roman numerals, full-width forms.
COMPATIBLE = ((0x0132, 0x0134), (0x01C7, 0x01CD), (0x01F1, 0x01F4), (0x2160, 0x2180), (0xFB00, 0xFB07), (0xFF01, 0xFF5F), (0xFFE0, 0xFFE7))
#: Arabic letters that join the next one, and those that join the one before only.
ARABIC_BOTH = "ئبتثجحخسشصضطظعغـفقكلمنهىيپچڤکگی"
ARABIC_BEFORE = "آأؤإاةدذرزوژۀۆ"
VIRAMA = (0x094D, 0x09CD, 0x0A4D, 0x0ACD, 0x0B4D, 0x0BCD, 0x0C4D, 0x0CCD, 0x0D4D)
HANGUL, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7  # 19 leading letters, 21 vowels, 27 final ones
BREAK = 0x10FFFF  # between rows
LIMIT = 0x110000


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables by code point, built from the interpreter's Unicode data and the fixed values above."""
    fold = {ord(c): "" for c in INVISIBLE} | {ord(c): " " for c in BLANKS} | {ord(p[0]): p[1:] for p in LOOK_ALIKES.split()}
    fold |= {c: unicodedata.normalize("NFKC", chr(c)) for a, b in COMPATIBLE for c in range(a, b)} | {0x2028: "\n", 0x2029: "\n", 0x85: "\n"}
    single = np.arange(LIMIT, dtype=np.uint32)
    length = np.ones(LIMIT, np.uint8)
    start = np.zeros(LIMIT, np.uint32)
    order = np.zeros(LIMIT, np.uint8)
    pool: list[int] = []
    pairs: dict[tuple[int, int], int] = {}
    for c in range(0x80, 0x30000):
        if 0xD800 <= c < 0xE000 or 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or 0x20000 <= c < 0x2F800:
            continue
        ch = chr(c)
        order[c] = unicodedata.combining(ch)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            pairs[a, b] = c
        whole = "".join(fold.get(ord(x), x) for x in unicodedata.normalize("NFD", fold.get(c, ch)))
        if whole != ch:
            length[c] = len(whole)
            if len(whole) == 1:
                single[c] = ord(whole)
            elif whole:
                start[c] = len(pool)
                pool += map(ord, whole)
    for s, t in SEQUENCES.items():
        if len(t) == 1:
            pairs[ord(s[0]), ord(s[1])] = ord(t)
    keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
    by = np.argsort(keys)
    second = np.zeros(LIMIT, bool)
    second[[b for _, b in pairs]] = True
    return {
        "single": single,
        "length": length,
        "start": start,
        "pool": np.array(pool, np.uint32),
        "order": order,
        "keys": keys[by],
        "composed": np.array(list(pairs.values()), np.uint32)[by],
        "second": second,
        "joins": _marked(ARABIC_BOTH),
        "arabic": _marked(ARABIC_BOTH + ARABIC_BEFORE),
    }


def _marked(letters: str) -> np.ndarray:
    out = np.zeros(LIMIT, bool)
    out[[ord(c) for c in letters]] = True
    return out


def shows(points: np.ndarray, at: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Whether the joiners at these places change what is seen: behind a virama, between Arabic letters that would join, in an emoji sequence."""
    before, after, zwnj = points[np.maximum(at - 1, 0)], points[np.minimum(at + 1, len(points) - 1)], points[at] == 0x200C
    virama = np.isin(before, VIRAMA)
    parted = zwnj & t["joins"][before] & t["arabic"][after]
    shaped = ~zwnj & (t["joins"][before] != t["arabic"][after])
    emoji = ~zwnj & ((before >= 0x1F000) | (before == 0xFE0F)) & (before != BREAK) & (((after >= 0x2600) & (after < 0x2800)) | ((after >= 0x1F000) & (after != BREAK)))
    return (at > 0) & (virama | parted | shaped | emoji)


def flatten(column: pa.Array) -> np.ndarray:
    """Code points of all strings, a BREAK behind each; nulls are empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.cumsum(np.concatenate([[0], ((data & 0xC0) != 0x80).astype(np.int64)]))
    return np.insert(points, lead[offsets[1:] - offsets[0]], BREAK)


def build(points: np.ndarray, nulls: np.ndarray) -> pa.Array:
    """Strings from code points with a BREAK behind each row."""
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    stop = points == BREAK
    size[stop] = 0
    ends = np.cumsum(size)[stop]
    data = points[~stop].astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    valid = pa.array(~nulls).buffers()[1] if nulls.any() else None
    return pa.Array.from_buffers(pa.large_string(), len(ends), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).cast(pa.string())


def gather(points: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Replace every code point by the characters it stands for."""
    n = t["length"][points]
    joiner = (points == 0x200C) | (points == 0x200D)
    if joiner.any():
        at = np.flatnonzero(joiner)
        n[at[shows(points, at, t)]] = 1
    variant = (points >= 0x180B) & (points <= 0x180D)
    if variant.any():  # they choose the shape of the Mongolian letter before them
        at = np.flatnonzero(variant)
        n[at[(points[at - 1] >= 0x1820) & (points[at - 1] <= 0x18AA)]] = 1
    if (n == 1).all():
        return t["single"][points]
    ends = np.cumsum(n, dtype=np.int64)
    out = np.repeat(t["single"][points], n)
    many = np.flatnonzero(n > 1)
    if len(many):
        k = n[many].astype(np.int64)
        inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        out[np.repeat(ends[many] - k, k) + inner] = t["pool"][np.repeat(t["start"][points[many]].astype(np.int64), k) + inner]
    return out


def reorder(points: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Canonical order of marks by passes of swaps, and of the signs in SEQUENCES that swap or change in place."""
    rank = t["order"][points]
    while True:
        bad = np.flatnonzero((rank[1:] > 0) & (rank[:-1] > rank[1:]))
        if not len(bad):
            break
        bad = bad[np.r_[True, np.diff(bad) > 1]]
        for x in (points, rank):
            x[bad], x[bad + 1] = x[bad + 1].copy(), x[bad].copy()
    for s, r in SEQUENCES.items():
        if len(r) == 2:
            at = np.flatnonzero((points[:-1] == ord(s[0])) & (points[1:] == ord(s[1])))
            points[at], points[at + 1] = ord(r[0]), ord(r[1])
    return points


def compose(points: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Compose neighbouring pairs, leftmost first, until none is left."""
    points = compose_hangul(points)
    keys, composed = t["keys"], t["composed"]
    while True:
        at = np.flatnonzero(t["second"][points[1:]])
        if not len(at):
            return points
        pair = (points[at].astype(np.uint64) << np.uint64(32)) | points[at + 1]
        i = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        ok = keys[i] == pair
        at, i = at[ok], i[ok]
        if not len(at):
            return points
        first = np.r_[True, np.diff(at) > 1]
        at, i = at[first], i[first]
        points[at] = composed[i]
        points = np.delete(points, at + 1)


def compose_hangul(points: np.ndarray) -> np.ndarray:
    """Hangul letters as syllables, by the arithmetic of the script."""
    if not ((points >= VOWELS) & (points <= TAILS + 27)).any():
        return points
    x = points.astype(np.int64)
    at = np.flatnonzero((x[:-1] >= LEADS) & (x[:-1] < LEADS + 19) & (x[1:] >= VOWELS) & (x[1:] < VOWELS + 21))
    x[at] = HANGUL + ((x[at] - LEADS) * 21 + x[at + 1] - VOWELS) * 28
    x = np.delete(x, at + 1)
    at = np.flatnonzero((x[:-1] >= HANGUL) & (x[:-1] < HANGUL + 11172) & ((x[:-1] - HANGUL) % 28 == 0) & (x[1:] > TAILS) & (x[1:] <= TAILS + 27))
    x[at] += x[at + 1] - TAILS
    return np.delete(x, at + 1).astype(np.uint32)


def normalise(column: pa.Array) -> pa.Array:
    """The consistent form of every string; null stays null, empty stays empty."""
    t = tables()
    points = reorder(gather(flatten(column), t), t)
    return build(compose(points, t), np.asarray(column.is_null()))


def canonical(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """Add the column ``out`` with the consistent form of ``text``; it replaces a column of that name.

    Texts that look the same get equal values: full-width forms, composed and combining accents,
    invisible characters, non-breaking spaces, ligatures and look-alike letters. Case, raised or circled
    digits, accents and the number of blanks are kept. Null gives null, empty text gives empty text.
    """
    base = df.drop(out) if out != text else df
    schema = T.StructType([f for f in base.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = normalise(b.column(b.schema.get_field_index(text)))
            columns = [done if n == out else b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return base.mapInArrow(run, schema)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and section texts as item_kind, item_id, text."""
    p = spark.read.parquet(f"{sf_dir}/query_requests.parquet").select(F.lit("prompt").alias("item_kind"), F.col("request_id").alias("item_id"), F.col("prompt").alias("text"))
    s = spark.read.parquet(f"{sf_dir}/sections.parquet").select(F.lit("section").alias("item_kind"), F.col("section_id").alias("item_id"), "text")
    return p.unionByName(s)


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(items(spark, sf_dir)).select("item_kind", "item_id", "canonical").distinct()


def classes(texts: DataFrame) -> DataFrame:
    """Classes of items (item_kind, item_id, text) whose texts look the same but are stored in several ways.

    Result: item_kind, item_id, class_1, class_2 (hashes of the common form), text_1, text_2 (hashes of the
    stored text), one row for each different stored text of an item. Null texts and ids are in no class.
    """
    form = canonical(texts.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_kind", "item_id", "text"))

    def twice(name: str, to: str) -> list[Column]:
        return [F.xxhash64(name).alias(f"{to}_1"), F.xxhash64(F.lit("c"), F.col(name)).alias(f"{to}_2")]

    h = materialise(form.select("item_kind", "item_id", *twice("canonical", "class"), *twice("text", "text")).distinct(), "forms")
    # only forms with several stored variants go on; popular texts without variants never meet
    stored = F.struct("text_1", "text_2")
    mixed = h.groupBy("item_kind", "class_1", "class_2").agg(F.min(stored).alias("low"), F.max(stored).alias("high")).where("low <> high").select("item_kind", "class_1", "class_2")
    return h.join(mixed, ["item_kind", "class_1", "class_2"], "left_semi")


def alike(texts: DataFrame) -> DataFrame:
    """Pairs of items (item_kind, item_id, text) whose texts look the same but are stored differently.

    Result: item_kind, id_a, id_b with id_a < id_b. Equal texts are no pair. Null texts and ids give none.
    The pairs are the classes written out, which comes last; texts are compared by two 64-bit hashes each.
    """
    some = classes(texts)
    keys = ["item_kind", "class_1", "class_2"]
    a = some.select(*keys, F.col("item_id").alias("id_a"), F.struct("text_1", "text_2").alias("ta"))
    b = some.select(*keys, F.col("item_id").alias("id_b"), F.struct("text_1", "text_2").alias("tb"))
    return a.join(b, keys).where((F.col("id_a") < F.col("id_b")) & (F.col("ta") != F.col("tb"))).select("item_kind", "id_a", "id_b").distinct()


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_classes: the class of every item that has look-alikes stored differently; class_id is the lowest item of the class."""
    c = classes(items(spark, sf_dir))
    low = c.groupBy("item_kind", "class_1", "class_2").agg(F.min("item_id").alias("class_id"))
    return c.select("item_kind", "item_id", "class_1", "class_2").distinct().join(low, ["item_kind", "class_1", "class_2"]).select("item_kind", "item_id", "class_id")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike(items(spark, sf_dir))
