"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of the total, limited by how often it may repeat; what limited sources leave
over goes to the others in proportion to their shares. The whole copies of a source that its quota holds
are certain. The rest is a sample with probabilities in proportion to size: a document is included with
p = min(1, c * size), where c is such that the expected total is the rest; those of p = 1 are certain too.
Documents are ranked by odds(u) / odds(p) with u uniform, and the lowest ranks are taken until the quota is
filled, so each source's total is fixed up to half a document.

Ranks are not sorted source by source. The ranking value is cut into fixed intervals; sums per source
and interval decide all intervals but the one in which a quota ends, and only that one is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.llm.packing import token_size
from folioscan.runtime import materialise

INTERVALS = 4096
STEPS = 16  # classes of size for each doubling


def quotas(targets: list[tuple[str, float, int]], sizes: dict[str, int], total: int) -> list[tuple[str, float, int, float, int, bool]]:
    """Water-fill: (source, target_share, max_repeats, quota, limit, limited). ``limited`` compares the plain target with the limit."""
    limit = {s: sizes.get(s, 0) * max(0, r) for s, _, r in targets}
    quota = {s: 0.0 for s, _, _ in targets}
    open_, left = {s: w for s, w, _ in targets if w > 0}, float(total)
    while open_ and left > 0:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / weight >= limit[s]]
        if not full:
            for s, w in open_.items():
                quota[s] = left * w / weight
            break
        for s in full:
            quota[s] = float(limit[s])
            del open_[s]
        left = float(total) - sum(quota.values())
    return [(s, w, r, quota[s], limit[s], limit[s] < w * total) for s, w, r in targets]


def inclusion(classes: list[tuple[float, float]], rest: float) -> float:
    """The factor c for which documents taken with p = min(1, c * size) have the expected total ``rest``; from sums of sizes and of their squares by class of size."""
    if rest <= 0 or not classes:
        return 0.0

    def expected(c: float) -> float:
        return sum(s if c * q >= s else c * q for s, q in classes)

    low, high = 0.0, max(s / q for s, q in classes)
    if rest >= expected(high):
        return high
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < rest else (low, mid)
    return high


def mix(docs: DataFrame, targets: DataFrame, *, seed: int = 17, intervals: int = INTERVALS) -> tuple[DataFrame, DataFrame]:
    """Select a mix of documents whose total equals that of all documents.

    ``docs``: doc_id, source, size. ``targets``: source, target_share, max_repeats (a fixed, small table).
    Returns (documents with their number of copies, report with one row a target source).
    Report: source, target_share, max_repeats, source_size, limit_size, limited, quota, actual_size,
    actual_share. Repeated doc_ids count once; null sizes count as 0; documents of other sources or with
    a null source count towards the total only. A target source without documents gets nothing, is
    limited, and its share goes to the others. If all limits together stay below the total, every
    source is used up to its limit.
    """
    spark = docs.sparkSession
    d = materialise(docs.groupBy("doc_id").agg(F.min("source").alias("source"), F.max(F.coalesce(F.col("size"), F.lit(0)).cast("long")).alias("size")), "sizes")
    wanted = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").distinct().collect() if r[0] is not None]
    names = F.broadcast(spark.createDataFrame([(w[0], True) for w in wanted], "source string, wanted boolean"))  # as many rows as targets
    level = F.when(F.col("size") > 0, F.floor(F.log2("size") * STEPS)).cast("int")
    real = F.col("size").cast("double")
    sums = d.join(names, "source", "left").groupBy(F.when(F.col("wanted"), F.col("source")).alias("source"), level.alias("level")).agg(F.sum("size").alias("size"), F.sum(real * real).alias("square")).collect()  # targets * STEPS * 63 rows at most
    sizes: dict[str, int] = {}
    classes: dict[str, list[tuple[float, float]]] = {}
    for r in sums:
        if r["source"] is not None:
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
            if r["size"]:
                classes.setdefault(r["source"], []).append((float(r["size"]), r["square"]))
    total = sum(r["size"] for r in sums)
    plan = quotas(wanted, sizes, total)
    rows = []
    for s, w, r, quota, limit, limited in plan:
        size = sizes.get(s, 0)
        whole = min(int(quota // size), r) if size else 0
        rest = max(0.0, quota - whole * size) if whole < r else 0.0
        rows.append((s, w, r, size, limit, limited, quota, whole, rest, inclusion(classes.get(s, []), rest)))
    quota_df = F.broadcast(
        spark.createDataFrame(rows, "source string, target_share double, max_repeats int, source_size long, limit_size long, limited boolean, quota double, whole int, rest double, factor double")
    )  # one row a target source
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    p = F.least(F.lit(1.0), F.col("factor") * F.col("size"))
    odds = F.when(p >= 1, F.lit(0.0)).when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    ranked = d.join(quota_df, "source").withColumn("rank_value", odds).withColumn("cell", F.floor(F.col("rank_value") / (1 + F.col("rank_value")) * intervals).cast("int"))
    cells = ranked.where("rest > 0").groupBy("source", "cell").agg(F.sum("size").alias("cell_size"), F.max("rest").alias("rest"))
    up_to = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("upto", up_to).select("source", "cell", (F.col("upto") - F.col("cell_size")).alias("before"), "upto")  # targets * intervals rows at most
    r = ranked.join(F.broadcast(cells), ["source", "cell"], "left")
    edge = (F.col("rest") > F.col("before")) & (F.col("rest") < F.col("upto"))
    inside = r.where(~F.coalesce(edge, F.lit(False))).withColumn("extra", F.when(F.col("rest") >= F.col("upto"), 1).otherwise(0))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("rank_value", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    last = r.where(edge).withColumn("run", F.col("before") + run)
    # the document that crosses the quota is taken where that comes nearer to it
    last = last.withColumn("extra", F.when(F.col("run") - F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)).drop("run")
    chosen = inside.unionByName(last).withColumn("copies", F.col("whole") + F.col("extra"))
    picked = chosen.where("copies > 0").select("doc_id", "source", "size", F.col("copies").cast("long").alias("copies"))
    got = picked.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("actual_size"))
    report = (
        quota_df.join(got, "source", "left")
        .withColumn("actual_size", F.coalesce("actual_size", F.lit(0).cast("long")))
        .withColumn("actual_share", F.when(F.lit(total > 0), F.col("actual_size") / F.lit(float(max(total, 1)))).otherwise(F.lit(0.0)))
        .select("source", "target_share", "max_repeats", "source_size", "limit_size", "limited", "quota", "actual_size", "actual_share")
    )
    return picked, report


def mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", token_size().alias("size"))
    return mix(docs, spark.read.parquet(f"{sf_dir}/mix_targets.parquet"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_found: sources that stay below their target although every document is used max_repeats times."""
    report = mixed(spark, sf_dir)[1]
    return report.where(F.col("limited") & (F.col("actual_share") < F.col("target_share"))).select("source")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir)[1]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir)[0]


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_limits: what each target source has, how far it may be used, and whether that is too little."""
    return report(spark, sf_dir).select("source", "source_size", "limit_size", "limited")
