import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.llm import mixing, neighbours, packing, splitting

VEC = "vec_id long, embedding array<float>, id string"


def brute(m, ids, k, least):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        best = sorted(((-round(float(s[i, j]), 9), ids[j]) for j in range(len(ids)) if s[i, j] >= least))[:k]
        out |= {(ids[i], b) for _, b in best}
    return out


def crowd(seed, n, dim, centres, noise):
    rnd = np.random.default_rng(seed)
    c = rnd.standard_normal((centres, dim))
    x = np.concatenate([rnd.standard_normal((n, dim)), c[rnd.integers(0, centres, n)] + noise * rnd.standard_normal((n, dim))])
    return x.astype(np.float32)


@pytest.mark.parametrize("noise", [0.1, 0.35, 0.45])
def test_neighbours_recall(spark, noise):
    x = crowd(3, 700, 64, 120, noise)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], VEC)
    got = {(r.vec_id, r.neighbour) for r in neighbours.neighbours(df).collect()}
    true = brute(x.astype(np.float64), list(range(len(x))), 5, 0.85)
    assert len(true) > 200
    assert len(got & true) >= 0.9 * len(true)
    assert len(got - true) <= 0.1 * len(true)  # only in place of missed ones


def test_neighbours_in_a_crowd(spark):
    rnd = np.random.default_rng(8)
    centre = rnd.standard_normal(64)
    groups = centre + 0.3 * rnd.standard_normal((100, 64))
    x = np.concatenate([rnd.standard_normal((600, 64)), groups[rnd.integers(0, 100, 400)] + 0.1 * rnd.standard_normal((400, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], VEC)
    true = brute(x.astype(np.float64), list(range(len(x))), 5, 0.85)
    for crowd_rows in (1_000_000, 60):  # the second splits what many rows share
        got = {(r.vec_id, r.neighbour) for r in neighbours.neighbours(df).collect()}
        assert len(true) > 1500 and len(got & true) >= 0.9 * len(true)


def test_neighbours_in_a_large_crowd(spark):
    rnd = np.random.default_rng(12)
    x = np.concatenate([rnd.standard_normal(64) + 0.3 * rnd.standard_normal((20_000, 64)), rnd.standard_normal((10_000, 64))]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = {(r.vec_id, r.neighbour) for r in neighbours.neighbours(df).collect()}
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    some = range(0, 20_000, 40)
    s = m[some] @ m.T
    s[np.arange(len(some)), some] = -2
    true = {(i, int(j)) for i, row in zip(some, np.argpartition(-s, 5, axis=1)[:, :5], strict=True) for j in row}
    assert len(got & true) >= 0.9 * len(true)


def test_split_half_values_lose_no_pair():
    rest = np.arange(64)
    for bits in (1, 3, 6):
        rows, where, home = neighbours.pieces(rest, np.full(64, bits))
        for a in range(64):
            for b in range(a):
                met = sum(bool(home[i] | home[j]) for i in np.flatnonzero(rows == a) for j in np.flatnonzero(rows == b) if where[i] == where[j])
                assert met == 1 or (a ^ b).bit_count() > 1


def test_neighbours_split_as_unsplit(spark, monkeypatch):
    x = crowd(9, 300, 64, 3, 0.35)
    df = spark.createDataFrame([((i << 33) + i, v.tolist(), "x") for i, v in enumerate(x)], VEC)
    plain, split = ({tuple(r) for r in neighbours.neighbours(df, crowd=c).collect()} for c in (1_000_000, 20))
    assert plain == split
    monkeypatch.setattr(neighbours, "known_bits", lambda n, width: 3)  # cells tell a part of the substrings, as in large tables
    assert {tuple(r) for r in neighbours.neighbours(df, crowd=20).collect()} == plain


def test_neighbours_of_repeated_rows(spark):
    rnd = np.random.default_rng(6)
    base = rnd.standard_normal(32)
    rows = [(1, base.tolist(), "x")] * 60 + [(i, (base + 0.05 * rnd.standard_normal(32)).tolist(), "x") for i in range(2, 5)] + [(100 + i, rnd.standard_normal(32).tolist(), "x") for i in range(50)]
    got = neighbours.neighbours(spark.createDataFrame(rows, VEC)).where("vec_id = 1").collect()
    assert sorted(r.neighbour for r in got) == [2, 3, 4]


def test_neighbours_odd_rows(spark):
    a = [1.0] + [0.1] * 15
    rows = [(1, a, "x"), (1, a, "x"), (2, [2 * v for v in a], "y"), (3, None, "x"), (4, [0.0] * 16, "x"), (5, [float("nan")] * 16, "x"), (6, [float("inf")] + [0.0] * 15, None), (None, a, "x"), (7, [1.0], "x"), (8, [], "x"), (9, [-v for v in a], "x")]
    df = spark.createDataFrame(rows, VEC).withColumn("similarity", F.lit(9)).withColumn("a", F.lit("clash"))
    assert {(r.vec_id, r.neighbour, r["rank"]) for r in neighbours.neighbours(df).collect()} == {(1, 2, 1), (2, 1, 1)}
    assert neighbours.neighbours(df.limit(0)).count() == 0


def test_neighbours_copies(spark):
    rnd = np.random.default_rng(5)
    base = rnd.standard_normal(32)
    near = base + 0.05 * rnd.standard_normal(32)
    rows = [(i, base.tolist(), "x") for i in range(300)] + [(900, near.tolist(), "x")] + [(1000 + i, rnd.standard_normal(32).tolist(), "x") for i in range(100)]
    got: dict = {}
    for r in neighbours.neighbours(spark.createDataFrame(rows, VEC)).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour))
    assert [n for _, n in sorted(got[200])] == [0, 1, 2, 3, 4]
    assert [n for _, n in sorted(got[2])] == [0, 1, 3, 4, 5]
    assert [n for _, n in sorted(got[900])] == [0, 1, 2, 3, 4]


def test_layout_grows_with_the_table():
    for n in (1_000, 1_000_000, 1_000_000_000):
        width, tables = neighbours.layout(n, 0.85, 0.92)
        assert 1 - (1 - neighbours.meet_rate(width, 0.85)) ** tables >= 0.92
    # what finds the candidates among 82.5 million vectors of 64 numbers, some 30 GB as a table, is less than four times their size
    assert neighbours.shipped_bytes(82_500_000, 0.85, 0.92) <= 4 * 256


SIZED = "doc_id long, size long, container string"


def swept(kind):
    """Matches of one sweep by a plain stack: document -> slot."""
    free, out = [], {}
    for i, k in enumerate(kind):
        if k == packing.SLOT:
            free.append(i)
        elif free:
            out[i] = free.pop()
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=12), max_size=8))
def test_sweeps_of_ranges_agree_with_one_sweep(ranges):
    whole = np.array([k for r in ranges for k in r], np.int64)
    docs, slots = packing.successors(whole)
    assert dict(zip(docs.tolist(), slots.tolist(), strict=True)) == swept(whole)
    got, counts, left, base = {}, [], {}, 0
    for p, r in enumerate(ranges):
        docs, slots = packing.successors(np.array(r, np.int64))
        got |= dict(zip((base + docs).tolist(), (base + slots).tolist(), strict=True))
        for kind in (packing.DOCUMENT, packing.SLOT):
            taken = {*docs.tolist(), *slots.tolist()}
            left[p, kind] = [base + i for i, k in enumerate(r) if k == kind and i not in taken]
        counts.append((p, len(left[p, packing.DOCUMENT]), len(left[p, packing.SLOT])))
        base += len(r)
    for part, first, n, there, slot in packing.settle(counts):
        for i in range(n):
            got[left[part, packing.DOCUMENT][first + i]] = left[there, packing.SLOT][slot - i]
    assert got == swept(whole)


def test_fill(spark):
    """Little room is wasted over several ranges, and equal sizes are no obstacle."""
    rnd = random.Random(5)
    sizes = [min(1000, int(rnd.lognormvariate(4.5, 1.2)) + 1) for _ in range(1500)] + [300] * 500
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], SIZED)
    got = packing.pack(df, 1000, ranges=4).groupBy("container").sum("piece_size").collect()
    assert sum(r[1] for r in got) == sum(sizes)
    assert len(got) <= -(-sum(sizes) // 1000) * 1.02 + 1


def test_pack(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([1, 30, 70, 70, 70, 100, 250]), "x") for i in range(600)]
    df = spark.createDataFrame([*rows, rows[0], (None, 5, "x"), (1000, None, "x"), (1001, 0, None)], SIZED)
    out = packing.pack(df, 100).collect()
    per: dict = {}
    for r in out:
        per.setdefault(r.container, []).append((r.container_offset, r.piece_size))
    for parts in per.values():
        parts.sort()
        assert all(a + s <= b for (a, s), (b, _) in zip(parts, parts[1:], strict=False)) and parts[-1][0] + parts[-1][1] <= 100
    sizes: dict = {}
    for r in out:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.piece_size
    assert sizes == {i: s for i, s, _ in rows}
    spread = {r.doc_id for r in out if r.piece > 0}
    assert spread == {i for i, s, _ in rows if s > 100}
    assert packing.pack(df.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


DOCS = "doc_id long, source string, size long, p double"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["big"] * 6 + ["mid"] * 3 + ["small"]), rnd.randint(1, 60), 0.5) for i in range(4000)]
    rows += [rows[7], (5000, None, 10, 0.1), (5001, "untargeted", 40, 0.1), (5002, "mid", None, 0.1)]
    df = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.2, 1), ("mid", 0.4, 3), ("small", 0.35, 2), ("gone", 0.05, 4), (None, 0.1, 1)], TARGETS)
    picked, report = mixing.mix(df, targets)
    r = {x.source: x for x in report.collect()}
    total = sum({i: s or 0 for i, _, s, _ in rows}.values())
    assert r["gone"].limited and r["gone"].actual_size == 0
    assert r["small"].limited and r["small"].actual_size == 2 * r["small"].source_size
    for name in ("big", "mid"):
        assert abs(r[name].actual_size - r[name].quota) <= 60
    assert abs(sum(x.actual_size for x in r.values()) - total) <= 150
    got = picked.collect()
    assert len({x.doc_id for x in got}) == len(got) and max(x.copies for x in got if x.source == "mid") <= 3
    again = {x.doc_id: x.copies for x in mixing.mix(df.repartition(5), targets)[0].collect()}
    assert again == {x.doc_id: x.copies for x in got}
    assert mixing.mix(df.limit(0), targets)[0].count() == 0
    assert {x.actual_share for x in mixing.mix(df.limit(0), targets)[1].collect()} == {0.0}


def test_inclusion_grows_with_size(spark):
    rows = [(i, "s", 10 if i % 2 else 90, 0.0) for i in range(4000)] + [(9000 + i, "t", 50, 0.0) for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("s", 0.25, 1), ("t", 0.75, 2)], TARGETS)
    picked, report = mixing.mix(df, targets)
    got = [x for x in picked.collect() if x.source == "s"]
    large, small = (sum(x.size == n for x in got) / 2000 for n in (90, 10))
    assert abs(large / small - 9) < 2.5
    assert all(abs(x.actual_size - x.quota) <= 45 for x in report.collect())
    assert mixing.inclusion([(100.0, 1000.0)], 0) == 0 and mixing.inclusion([], 5) == 0
    assert abs(mixing.inclusion([(100.0, 1000.0), (1000.0, 100_000.0)], 303) - 0.003) < 1e-9


def test_quotas_fill_what_limits_leave():
    got = {q[0]: q[3] for q in mixing.quotas([("a", 0.5, 1), ("b", 0.25, 9), ("c", 0.25, 9)], {"a": 100, "b": 900, "c": 900}, 1000)}
    assert got == {"a": 100.0, "b": 450.0, "c": 450.0}


def check_pieces(text, vault, limit, overlap):
    text = splitting.restore_oversized(text, vault, limit)
    got = splitting.split_text(text, vault, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, n), (c, d, _) in zip(got, got[1:], strict=False):
        assert c <= b < d and a < c
    assert all(n <= limit for *_, n in got)
    return text, got


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "x", "។", ". ", "\n\n", "$a+b$", "$" + "y" * 90 + "$", "ក្ក", "​", "⟦MATH_" + "0" * 32 + "⟧", "⟦MATH_" + "1" * 32 + "⟧", "⟦MATH_" + "2" * 32 + "⟧", "é"]), min_size=1, max_size=120))
def test_split_any_text(parts):
    vault = {"⟦MATH_" + "0" * 32 + "⟧": "$" + "z" * 30 + "$", "⟦MATH_" + "1" * 32 + "⟧": "$" + "z" * 300 + "$"}
    check_pieces("".join(parts), vault, 100, 20)


def test_split_at_natural_places():
    rnd = random.Random(6)
    text = " ".join(" ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(8)) + "." for _ in range(200))
    text, got = check_pieces(text, {}, 500, 60)
    assert all(text[:b].rstrip().endswith(".") for _, b, _ in got)
    assert all(60 <= b - c < 64 for (_, b, _), (c, _, _) in zip(got, got[1:], strict=False))
    edited = text[:1000] + "INSERTED " + text[1000:]
    after = [edited[a:b] for a, b, _ in splitting.split_text(edited, {}, 500, 60)]
    before = [text[a:b] for a, b, _ in got]
    assert len(set(before) & set(after)) >= len(before) - 6
    assert splitting.split_text("x" * 100_000, {}, 700, 100)[0][2] == 700
    assert splitting.split_text("", {}, 10, 1) == [(0, 0, 0)]


def test_split_items(spark):
    mask = "⟦MATH_" + "a" * 32 + "⟧"
    rows = [("chunk", "1", "y" * 95 + mask, {mask: "$" + "x" * 20 + "$"}), ("chunk", "1", "y" * 95 + mask, {mask: "$" + "x" * 20 + "$"}), ("chunk", "2", "short", None), ("chunk", "3", None, None), ("chunk", None, "z" * 200, None), ("chunk", "4", "", {})]
    df = spark.createDataFrame(rows, "item_kind string, item_key string, text string, vault map<string,string>")
    sized = df.withColumns({"size": splitting.item_size(F.col("text"), F.col("vault")), "max_size": F.lit(100), "overlap": F.lit(10), "piece": F.lit("clash")})
    out = splitting.split_oversized(sized).collect()
    assert {(r.item_kind, r.item_key) for r in out} == {("chunk", "1")}
    assert any(mask in r.text for r in out) and all(r.size <= 100 for r in out)
    assert splitting.split_oversized(sized.limit(0)).count() == 0
