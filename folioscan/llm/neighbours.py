"""Most similar vectors for every vector: multi-index hashing.

Codes: two learned rotations of the vectors, each fitted on a bounded sample so that its axes binarise
with least error, give 128 sign bits. Tables: the code is split into substrings, each of which indexes
all vectors. Two vectors meet in a table when their substrings differ in at most one bit. A substring has
two halves, one of which must then be equal, so the rows of a table are shuffled by the value of either
half and the other half is probed within one bit inside the task. What is shuffled of a vector is its id,
what the cell doesn't say of the substring, and a sketch: further bits of the code, which no table uses.
Pairs that meet are kept if their sketches are near enough, and are reranked by the exact cosine.
Rows of a substring value that many share, and those within one bit of it, are compared by the exact
cosine in blocks, and each row's k nearest go on.

The substring width follows the logarithm of the number of vectors, so the number of probed pairs grows
nearly in proportion to it; the number of tables follows from the width, the least similarity sought
and the wanted recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.operators.search import batched_top_k
from folioscan.runtime import materialise

SAMPLE = 20_000
SKETCH = 128  # bits, at most, that decide which pairs that meet are reranked
SHIPPED = 1000  # bytes of a vector that are shuffled to the tables, about, at most
DENSE = 256  # vectors of one substring value from which they are compared by cosine at once, and only the nearest of each go on
BLOCK = 16_384  # rows of such a value that a task compares with each other
CROWD = 1_000_000  # rows of one half value that a task takes; beyond them the value is split by bits of the other half


def usable(v: Column) -> Column:
    """Not null or empty, not all zero, only finite values."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
    top = np.abs(m).max(axis=1, keepdims=True)
    m = m / np.where(top > 0, top, 1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def learn_rotation(sample: np.ndarray, seed: int, rounds: int = 12) -> np.ndarray:
    """Rotation that brings the sample nearest to the corners of a cube (alternating sign and Procrustes steps)."""
    rng = np.random.default_rng(seed)
    rot = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(sample @ rot).T @ sample)
        rot = (u @ vt).T
    return rot.astype(np.float32)


def flip_rate(similarity: float) -> float:
    return math.acos(max(-1.0, min(1.0, similarity))) / math.pi


def meet_rate(width: int, similarity: float) -> float:
    """Chance that substrings of this width differ in at most one bit."""
    p = flip_rate(similarity)
    return (1 - p) ** width + width * p * (1 - p) ** (width - 1)


def layout(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """(width, tables). The width is even."""
    width = int(min(24, max(8, 2 * round((math.log2(max(n, 2)) - 4) / 2))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - meet_rate(width, similarity)))
    return width, tables


def known_bits(n: int, width: int) -> int:
    """How many bits of a half the cell of a row tells, so that a cell has some two million rows at most."""
    return max(0, min(width // 2, math.ceil(math.log2(max(n, 1) / 2_000_000)))) if n > 2_000_000 else 0


def sketch_bits(tables: int) -> int:
    """Bits of the sketch: as many as SHIPPED leaves room for beside the id and the rest of the substring, from 64 to SKETCH."""
    return max(64, min(SKETCH, 8 * int(SHIPPED / (2 * tables) - 6)))


def shipped_bytes(n: int, similarity: float, recall: float) -> int:
    """Bytes shuffled for each vector to find the candidates."""
    width, tables = layout(n, similarity, recall)
    rest = 2 if width - known_bits(n, width) <= 16 else 4
    return 2 * tables * (4 + sketch_bits(tables) // 8 + rest)


def encode(m: np.ndarray, rotations: list[np.ndarray], used: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of ``used`` bits as words of 64 bits, sketch of ``more`` bits behind them as bytes); bits beyond the dimension come from further rotations.

    Not centred: a bit differs with the chance of flip_rate only if angles are taken from the origin.
    """
    bits = np.concatenate([(m @ r) > 0 for r in rotations], axis=1)
    code = np.zeros((len(m), -(-used // 64) * 64), bool)
    code[:, :used] = bits[:, :used]
    return np.packbits(code, axis=1, bitorder="little").view(np.uint64), np.packbits(bits[:, used : used + more], axis=1, bitorder="little")


def substring(codes: np.ndarray, table: int, width: int) -> np.ndarray:
    at = table * width
    word, shift = at // 64, at % 64
    x = codes[:, word] >> np.uint64(shift)
    if shift + width > 64:
        x = x | (codes[:, word + 1] << np.uint64(64 - shift))
    return (x & np.uint64((1 << width) - 1)).astype(np.int64)


def near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Whether sketches, as columns of whole numbers, differ in at most ``radius`` bits."""
    d = np.zeros(x.shape[0], np.int16)
    for w in range(x.shape[1]):
        d += np.bitwise_count(x[:, w] ^ y[:, w])
    return d <= radius


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers start[i]..stop[i]-1, flat, and the i they belong to."""
    n = stop - start
    who = np.repeat(np.arange(len(n)), n)
    return np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n), who


def half_pairs(ids: np.ndarray, sub: np.ndarray, sketch: np.ndarray, home: np.ndarray, table: int, half: int, width: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs among rows grouped by one half of their substrings ``sub``, whose other half differs in at most one bit: (a, b, -1).

    Pairs with a row of a crowded substring value are left to an exact search: (id, whether it has the
    value itself, unit) says that the id takes part in the search of this value. Pairs of two visitors
    (not ``home``) are left to other tasks, and those whose halves are both equal to the first half.
    """
    h = width // 2
    codes = np.ascontiguousarray(np.pad(sketch, ((0, 0), (0, -sketch.shape[1] % 8)))).view(np.uint64)
    same, other = (sub & ((1 << h) - 1), sub >> h) if half == 0 else (sub >> h, sub & ((1 << h) - 1))
    key = (same << h) | other
    order = np.lexsort((codes[:, 0], ids, key))
    ids, codes, key, home, sub = ids[order], codes[order], key[order], home[order], sub[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (codes[1:] != codes[:-1]).any(axis=1)]  # repeated rows
    ids, codes, key, home, sub = ids[fresh], codes[fresh], key[fresh], home[fresh], sub[fresh]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    stop = np.r_[first[1:], len(key)]
    values = key[first]
    big, at_home = stop - first > DENSE, home[first]
    core, guests = [np.flatnonzero(big & at_home)], []
    for flip in [0, *(1 << b for b in range(h))]:
        if flip == 0:
            f, s = first[~big], stop[~big]
            rows, _ = ranges(f, s)
            begin, end = rows + 1, np.repeat(s, s - f)
        else:
            at = np.searchsorted(values, values ^ flip)
            ok = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == (values ^ flip)) & ((values & flip) == 0)
            c, o = np.flatnonzero(ok), at[ok]
            ok = at_home[c] | at_home[o]
            c, o = c[ok], o[ok]
            dense = big[c] | big[o]
            if dense.any():
                x, y = c[dense], o[dense]
                x, y = np.where(big[x], x, y), np.where(big[x], y, x)
                core.append(x)
                guests.append((x, y))
            c, o = c[~dense], o[~dense]
            f, s = first[c], stop[c]
            rows, _ = ranges(f, s)
            begin, end = np.repeat(first[o], s - f), np.repeat(stop[o], s - f)
        total = np.cumsum(end - begin)
        i = 0
        while i < len(rows):  # blocks of some million pairs bound the memory
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + 2_000_000, "right")))
            right, who = ranges(begin[i:j], end[i:j])
            left = rows[i:j][who]
            k = near(codes[left], codes[right], radius) & (home[left] | home[right])
            left, right = left[k], right[k]
            if half == 1:
                k = ((sub[left] ^ sub[right]) & ((1 << h) - 1)) != 0  # else the first half finds it
                left, right = left[k], right[k]
            yield ids[left], ids[right], np.full(len(left), -1)
            i = j
    unit = table << 32 | sub[first]
    cells = np.unique(np.concatenate(core))
    for mine, whose, own in [(cells, cells, 1), *((y, x, 0) for x, y in guests)]:
        rows, who = ranges(first[mine], stop[mine])
        yield ids[rows], np.full(len(rows), own), unit[whose][who]


def best_within(left: np.ndarray, right: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray, left_own: np.ndarray, right_own: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k most similar rows of ``right`` (sorted by id) for every row of ``left``, by exact cosine; pairs of which neither is ``own`` are left out."""
    for i in range(0, len(left), 256):
        s = left[i : i + 256] @ right.T
        s[left_ids[i : i + 256, None] == right_ids] = -2
        s[np.ix_(~left_own[i : i + 256], ~right_own)] = -2
        s = np.round(s, 12)
        if s.shape[1] > k:
            floor = np.partition(s, -k, axis=1)[:, -k]
            x, y = np.nonzero(s >= np.maximum(floor, least - 1e-9)[:, None])
        else:
            x, y = np.nonzero(s >= least - 1e-9)
        order = np.lexsort((y, -s[x, y], x))
        x, y = x[order], y[order]
        x, y = (z[np.arange(len(x)) - np.searchsorted(x, x) < k] for z in (x, y))
        yield left_ids[i + x], right_ids[y]


def search_crowds(members: DataFrame, vectors: DataFrame, dim: int, k: int, least: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of crowded substring values: each row's k nearest among all rows that it meets there, by exact cosine.

    ``members`` are (unit, id, own) as half_pairs makes them. Units of more than ``block`` rows are
    divided into blocks, every two of which meet in a task.
    """
    sizes = members.groupBy("unit").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    rows = members.join(sizes, "unit").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("unit", F.least("mine", "with").alias("x"), F.greatest("mine", "with").alias("y"), "mine", "id", "own").join(vectors, "id")

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, at = np.unique(table.column("id").to_numpy(), return_index=True)
        mine, own = table.column("mine").to_numpy()[at], table.column("own").to_numpy()[at] == 1
        m = matrix(table.column("v").chunk(0), dim)[at].astype(np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        p = mine == table.column("x")[0].as_py()
        q = mine == table.column("y")[0].as_py()
        got = []
        for f, g in [(p, q)] if (p == q).all() else [(p, q), (q, p)]:
            got += best_within(m[f], m[g], ids[f], ids[g], own[f], own[g], k, least)
        a, b = (np.concatenate(z) for z in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 2
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("unit", "x", "y").applyInArrow(search, "a long, b long")


def pieces(rest: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where rows of split half values go: (row, piece, home). Pieces are low bits of the other half ``rest``, ``bits`` of them for each row.

    A row is at home in the piece of its own bits and visits those with one of its set bits cleared, so
    two rows whose other halves differ in at most one place, as it takes to meet, meet in exactly one piece.
    """
    sub = rest & ((1 << bits) - 1)
    rows, where, home = [np.arange(len(rest))], [sub], [np.ones(len(rest), bool)]
    for b in range(int(bits.max(initial=0))):
        at = np.flatnonzero(((sub >> b) & 1) == 1)
        rows.append(at)
        where.append(sub[at] ^ (1 << b))
        home.append(np.zeros(len(at), bool))
    return np.concatenate(rows), np.concatenate(where), np.concatenate(home)


def neighbours(
    vectors: DataFrame,
    *,
    k: int = 5,
    min_similarity: float = 0.85,
    key: str = "vec_id",
    embedding: str = "embedding",
    sample: int = SAMPLE,
    recall: float = 0.92,
    crowd: int = CROWD,
) -> DataFrame:
    """The k most similar other vectors of every usable vector: key, neighbour, similarity, rank.

    Only neighbours of cosine ``min_similarity`` or more are sought; the index is laid out so that a
    pair at that similarity is found with the chance ``recall``, nearer ones with more. A lower
    ``min_similarity`` widens the search to any vector at the cost of more tables. Ties go to the lower
    key. Vectors that are null, all zero, not finite, or not of the commonest dimension (ties: the
    lowest) give no rows and are nobody's neighbour; repeated keys count once. Vectors with equal values
    form one group, which is indexed by one representative; each member still gets its own k rows.
    The fit uses at most ``sample`` vectors, those with the lowest key hashes; all vectors are indexed.
    A half value that more than ``crowd`` rows share is split by bits of the other half, without loss.
    """
    if k < 1 or not 0 < min_similarity <= 1:
        raise ValueError("k must be at least 1 and min_similarity in (0, 1]")
    spark = vectors.sparkSession
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    copy = F.xxhash64("v")
    found = good.groupBy(F.size("v").alias("dim")).agg(F.approx_count_distinct("id").alias("n")).orderBy(F.desc("n"), "dim").first()
    out_schema = f"`{key}` long, neighbour long, similarity double, rank int"
    if found is None:
        return spark.createDataFrame([], out_schema)
    dim, n = found["dim"], found["n"]
    good = good.where(F.size("v") == dim)
    share = min(1.0, 1.3 * sample / n)
    fit = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    m = matrix(fit.column("v").combine_chunks(), dim)
    width, tables = layout(n, min_similarity, recall)
    used, more = tables * width, sketch_bits(tables)
    # rotations are drawn afresh for each block of bits
    rotations = [learn_rotation(m, 100 + r) for r in range(math.ceil((used + more) / dim))]
    p = flip_rate(min_similarity)
    radius = int(more * p + 2.6 * math.sqrt(more * p * (1 - p)))
    h = width // 2
    known = known_bits(n, width)

    # groups of equal vectors with many more than k distinct keys are indexed by their lowest key
    groups = good.select("id", copy.alias("copy")).distinct().groupBy("copy").agg(F.count("*").alias("n"), F.min("id").alias("rep")).where(F.col("n") > 8 * (k + 1))
    groups = materialise(groups, "copies")
    heavy = groups.count()
    indexed = good
    if heavy:
        side = groups.select("copy", "rep")
        side = F.broadcast(side) if heavy < 100_000 else side
        indexed = good.withColumn("copy", copy).join(side, "copy", "left").where(F.col("rep").isNull() | (F.col("rep") == F.col("id"))).select("id", "v")

    def half_values(codes: np.ndarray, t: int, half: int) -> np.ndarray:
        sub = substring(codes, t, width)
        return sub & ((1 << h) - 1) if half == 0 else sub >> h

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((tables * 2, 1 << h), np.int64)
        for b in batches:
            if b.num_rows:
                codes, _ = encode(matrix(b.column(0), dim), rotations, used, more)
                for t in range(tables):
                    for half in (0, 1):
                        counts[2 * t + half] += np.bincount(half_values(codes, t, half), minlength=1 << h)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], names=["slot", "n"])

    slots = indexed.select("v").mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    crowded = {r["slot"]: min(h, math.ceil(math.log2(r["n"] / crowd)) + 1) for r in slots.where(F.col("n") > crowd).collect()}  # tables * 2 * 2**(width / 2) slots at most
    split = np.zeros((tables * 2, 1 << h), np.int64)
    for slot, bits_ in crowded.items():
        split[slot >> h, slot & ((1 << h) - 1)] = bits_

    small = width - known <= 16

    def rest_of(sub: np.ndarray, half: int) -> np.ndarray:
        """The substring without the bits that the cell tells: the low ``known`` ones of the half."""
        return sub >> known if half == 0 else (sub >> (h + known)) << h | (sub & ((1 << h) - 1))

    def whole_of(rest: np.ndarray, half: int, told: int) -> np.ndarray:
        return rest << known | told if half == 0 else ((rest >> h) << known | told) << h | (rest & ((1 << h) - 1))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            base_id = int(ids.min())
            near_ids = int(ids.max()) - base_id < 1 << 32
            ids = (ids - base_id).astype(np.uint32) if near_ids else ids
            codes, sketch = encode(matrix(b.column(1), dim), rotations, used, more)
            cells, blobs, sizes, bases = [], [], [], []

            def put(cell: np.ndarray, rows: np.ndarray, rest: np.ndarray, home: np.ndarray | None) -> None:
                order = np.argsort(cell, kind="stable")
                cell, rows, rest = cell[order], rows[order], rest[order].astype(np.uint16 if small else np.uint32)
                cuts = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)] if len(cell) else [0]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    cells.append(int(cell[a]))
                    sizes.append(int(z - a))
                    bases.append(base_id if near_ids else None)
                    blobs.append(ids[rows[a:z]].tobytes() + sketch[rows[a:z]].tobytes() + rest[a:z].tobytes() + (b"" if home is None else home[order[a:z]].tobytes()))

            for t in range(tables):
                sub = substring(codes, t, width)
                for half in (0, 1):
                    value = half_values(codes, t, half)
                    base, hot = (2 * t + half) << 40, split[2 * t + half][value]
                    rest = rest_of(sub, half)
                    plain = np.flatnonzero(hot == 0)
                    put(base | (value[plain] & ((1 << known) - 1)), plain, rest[plain], None)
                    some = np.flatnonzero(hot)
                    if len(some):
                        r, where, home = pieces(half_values(codes[some], t, 1 - half), hot[some])
                        put(base | 1 << 39 | value[some[r]] << 13 | where, some[r], rest[some[r]], home)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bases, pa.int64()), pa.array(blobs, pa.binary())], names=["cell", "n", "base", "rows"]
            )

    def meet(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        t, half, hot = (cell >> 40) // 2, (cell >> 40) % 2, bool(cell >> 39 & 1)
        told = (cell >> 13 if hot else cell) & ((1 << known) - 1)
        ids, rest, sketch, home = [], [], [], []
        for k, base_id, blob in zip(*(table.column(c).to_pylist() for c in ("n", "base", "rows")), strict=True):
            kind, size = (np.int64, 8) if base_id is None else (np.uint32, 4)
            ids.append(np.frombuffer(blob, kind, k).astype(np.int64) + (base_id or 0))
            at = size * k
            sketch.append(np.frombuffer(blob, np.uint8, k * more // 8, offset=at).reshape(k, more // 8))
            at += k * more // 8
            rest.append(np.frombuffer(blob, np.uint16 if small else np.uint32, k, offset=at).astype(np.int64))
            at += k * (2 if small else 4)
            home.append(np.frombuffer(blob, np.bool_, k, offset=at) if hot else np.ones(k, bool))
        got = list(half_pairs(np.concatenate(ids), whole_of(np.concatenate(rest), half, told), np.concatenate(sketch), np.concatenate(home), t, half, width, radius))
        a, b, unit = (np.concatenate(z).astype(np.int64) for z in zip(*got, strict=True))
        pair = unit < 0
        return pa.table({"a": np.where(pair, np.minimum(a, b), a), "b": np.where(pair, np.maximum(a, b), b), "unit": unit})

    cells = indexed.mapInArrow(spread, "cell long, n int, base long, rows binary")
    met = cells.groupBy("cell").applyInArrow(meet, "a long, b long, unit long").where("a <> b OR unit >= 0").distinct()
    met = materialise(met, "candidates")
    pairs = met.where("unit < 0").select("a", "b")
    members = met.where("unit >= 0").select("unit", F.col("a").alias("id"), F.col("b").alias("own"))
    if not members.isEmpty():
        pairs = pairs.unionByName(materialise(search_crowds(members, indexed.select("id", "v"), dim, k, min_similarity), "crowds")).distinct()
    va, vb = good.select(F.col("id").alias("a"), F.col("v").alias("va")), good.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    joined = pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = matrix(b.column(2), dim).astype(np.float64), matrix(b.column(3), dim).astype(np.float64)
            s = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            ok = np.flatnonzero(s >= min_similarity)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(s[ok])], names=["a", "b", "s"])

    scored = joined.mapInArrow(rerank, "a long, b long, s double").distinct()
    both = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    if heavy:
        both = expand_copies(both, good.select("id", copy.alias("copy")), groups, k)
    best = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("a").alias(key), F.col("b").alias("neighbour"), F.col("s").alias("similarity"), "rank")


def expand_copies(both: DataFrame, members: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Neighbours of and among equal vectors: members take their group's k + 1 lowest keys and the representative's neighbours; others meet those lowest keys."""
    m = members.distinct().join(groups.select("copy", "rep"), "copy").select("copy", "rep", F.col("id").alias("member"))
    salt = F.pmod(F.xxhash64("member"), F.lit(64))
    few = m.withColumn("nth", F.row_number().over(Window.partitionBy("copy", salt).orderBy("member"))).where(F.col("nth") <= k + 1)
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy("copy").orderBy("member"))).where(F.col("nth") <= k + 1).groupBy("copy", "rep").agg(F.collect_list("member").alias("lowest"))
    low = few.select("rep", F.explode("lowest").alias("low"))
    others = both.join(low.select(F.col("rep").alias("b"), "low"), "b", "left").select("a", F.coalesce("low", "b").alias("b"), "s")
    inside = m.join(few.select("copy", "lowest"), "copy").select(F.col("member").alias("a"), F.explode("lowest").alias("b"), F.lit(1.0).alias("s"))
    # members of a group with more than k others have all their neighbours inside it
    return others.join(low.select(F.col("rep").alias("a")).distinct(), "a", "left_anti").unionByName(inside).where("a <> b").distinct()


def nearest(spark: SparkSession, sf_dir: str, k: int = 5, min_similarity: float = 0.85) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/chunk_vectors.parquet").select("vec_id", "embedding"), k=k, min_similarity=min_similarity)


def complete(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """p1_topk: all k neighbours, however distant, of every vector whose id is divisible by 20, searched exactly in blocks against all rows.

    Neighbours below the least similarity of the index are as far away as any other vector, where an
    index of short codes has nothing to offer over a scan.
    """
    v = spark.read.parquet(f"{sf_dir}/chunk_vectors.parquet").where(usable(F.col("embedding"))).select("vec_id", "embedding").dropDuplicates(["vec_id"])
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = batched_top_k(v, queries, k, key="vec_id", query_key="query_id", exclude_self=True)
    return got.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("neighbour"), F.round("score", 6).alias("similarity"), "rank")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: pairs of cosine 0.85 or more, one of which is among the five nearest of the other."""
    return nearest(spark, sf_dir).select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()
