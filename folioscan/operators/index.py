"""The chunk table as immutable snapshots: load, validate, upsert, replace, delete, summarise."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions.vectors import l2_normalize
from folioscan.runtime import materialise

FORMAT_VERSION = 2
_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
    "map": T.MapType(T.StringType(), T.StringType()), "vector": T.ArrayType(T.FloatType()),
}
CHUNK_SCHEMA = T.StructType(
    [
        T.StructField(name, _TYPES[kind])
        for name, kind in (
            ("id", "string"), ("source", "string"), ("chunk_index", "int"), ("text", "string"), ("vault", "map"), ("page", "int"), ("page_end", "int"), ("format", "string"),
            ("created_at", "timestamp"), ("language", "string"), ("ocr", "boolean"), ("title", "string"), ("heading", "string"), ("embedding", "vector"),
        )
    ]
)


class ChunkIndexError(ValueError):
    """A batch or a snapshot breaks the rules of the index."""


class DuplicateSourceError(ValueError):
    """The source is indexed already and may not be replaced."""


def vector_problems(batch: DataFrame, dimension: int | None = None, *, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """One row with what is wrong with a batch: missing, not finite, other dimensions, repeated keys. Nothing is collected."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    wrong = F.size(v) != dimension if dimension is not None else F.lit(False)
    per_key = batch.groupBy(key).agg(
        F.count("*").alias("rows"),
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("not_finite"),
        F.count_if(v.isNotNull() & wrong).alias("other_dimension"),
        F.collect_set(F.when(v.isNotNull(), F.size(v))).alias("sizes"),
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "missing", "not_finite", "other_dimension")]
    sizes = F.count_distinct(F.array_min("sizes"))  # keys with several sizes are repeated keys as well
    return per_key.agg(*sums, sizes.alias("dimensions"), F.count_if(F.col("rows") > 1).alias("repeated_keys"))


def validate(batch: DataFrame, dimension: int | None = None) -> None:
    r = vector_problems(batch, dimension).first()
    problems = [k for k in ("missing", "not_finite", "other_dimension", "repeated_keys") if r[k]] + (["dimensions"] if r["dimensions"] > 1 else [])
    if problems:
        raise ChunkIndexError("invalid batch: " + ", ".join(f"{k} = {r[k]}" for k in problems))


def upsert(table: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the batch instead of those with the same key."""
    return table.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def delete_source(table: DataFrame, source: str) -> DataFrame:
    return table.where(~F.col("source").eqNullSafe(F.lit(source)))


def replace_sources(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch instead of all rows of its sources."""
    return table.join(batch.select("source").distinct(), "source", "left_anti").unionByName(batch, allowMissingColumns=True)


def has_source(table: DataFrame, source: str) -> bool:
    return not table.where(F.col("source") == source).select("source").limit(1).isEmpty()


def get(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("id") == key)


def new_sources(files: DataFrame, table: DataFrame) -> DataFrame:
    """Files whose source isn't indexed yet."""
    return files.join(table.select("source").distinct(), "source", "left_anti")


def with_sources(files: DataFrame, table: DataFrame) -> DataFrame:
    """Files whose source is indexed already."""
    return files.join(table.select("source").distinct(), "source", "left_semi")


def sources(table: DataFrame) -> DataFrame:
    """Per source: chunks, distinct start pages, format of the first chunk, first creation; by name."""
    return (
        table.groupBy("source")
        .agg(F.count("*").alias("chunks"), F.count_distinct("page").alias("pages"), F.min_by("format", F.struct("chunk_index", "id")).alias("format"), F.min("created_at").alias("ingested_at"))
        .orderBy("source")
    )


def totals(table: DataFrame) -> DataFrame:
    return table.agg(F.count_distinct("source").alias("documents"), F.count("*").alias("chunks"))


def duplicate_ids(table: DataFrame, key: str = "id") -> DataFrame:
    return table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def normalised(table: DataFrame) -> DataFrame:
    """Vectors at length one, as they are stored."""
    return table.withColumn("embedding", l2_normalize(F.col("embedding")).cast("array<float>"))


BUCKETS = 64
MANIFEST = "number long, parts map<string,string>, counts map<string,long>, format_version int, embedding_model string, dimension int, count long, saved_at timestamp"


def bucket_of(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(BUCKETS)).cast("int")


class ChunkIndex:
    """Snapshots below one folder, in buckets of sources, and a manifest that names the folder of each bucket.

    A write makes new folders for those buckets only that hold one of its sources, sorted by source so that
    a source filter skips files, and then adds a manifest; what is being read is never overwritten. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, embedding_model: str, dimension: int):
        self.spark, self.path, self.model, self.dimension = spark, path.rstrip("/"), embedding_model, dimension

    def _manifests(self) -> DataFrame | None:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests")

    def manifest(self):
        """The current manifest; its maps have the bucket numbers as text."""
        m = self._manifests()
        return m.orderBy(F.desc("number")).first() if m is not None else None

    def load(self, *, allow_model_change: bool = False, check: bool = True) -> DataFrame:
        """The current table; empty where there is none, or where its model may change and did.

        ``check`` compares the number of rows with the manifest, which reads the files' footers only.
        """
        m = self.manifest()
        empty = self.spark.createDataFrame([], CHUNK_SCHEMA)
        if m is None:
            return empty
        if m["format_version"] != FORMAT_VERSION:
            raise ChunkIndexError(f"snapshot format {m['format_version']} is not {FORMAT_VERSION}")
        if (m["embedding_model"], m["dimension"]) != (self.model, self.dimension):
            if allow_model_change:
                return empty
            raise ChunkIndexError(f"the index was made with {m['embedding_model']} of dimension {m['dimension']}")
        table = self._read(m["parts"])
        if check and (n := table.count()) != m["count"]:
            raise ChunkIndexError(f"the snapshot has {n} rows, its manifest says {m['count']}")
        return table

    def _read(self, parts: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/{parts[b]}" for b in sorted(parts)]
        return self.spark.read.schema(CHUNK_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], CHUNK_SCHEMA)

    def _write(self, rows: DataFrame, buckets: list[int]) -> int:
        """Write these buckets anew from ``rows`` and add a manifest; returns the number of rows of the index."""
        old = self.manifest()
        name = f"snapshot-{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA]
        out = rows.select(columns).withColumn("bucket", bucket_of(F.col("source")))
        out.repartitionByRange("bucket", "source", "chunk_index").sortWithinPartitions("bucket", "source", "chunk_index").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        same = old is not None and (old["embedding_model"], old["dimension"], old["format_version"]) == (self.model, self.dimension, FORMAT_VERSION)
        parts, counts = (dict(old["parts"]), dict(old["counts"])) if same else ({}, {})
        for b in buckets:
            parts.pop(str(b), None)
            counts.pop(str(b), None)
        written = self.spark.read.schema(T.StructType([*CHUNK_SCHEMA.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/{name}") if buckets else None
        for r in written.groupBy("bucket").count().collect() if written is not None else []:  # BUCKETS rows at most
            parts[str(r["bucket"])], counts[str(r["bucket"])] = f"{name}/bucket={r['bucket']}", r["count"]
        total = sum(counts.values())
        row = [((old["number"] + 1) if old else 1, parts, counts, FORMAT_VERSION, self.model, self.dimension, total, datetime.now(UTC).replace(microsecond=0))]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifests")
        return total

    def save(self, table: DataFrame) -> int:
        """Write the whole table anew; returns the number of rows."""
        return self._write(table, list(range(BUCKETS)))

    def _change(self, batch: DataFrame, touched: list[int], keep: Callable[[DataFrame], DataFrame]) -> int:
        """New folders for the touched buckets: what is kept of their rows, and the batch."""
        m = self.manifest()
        rest = keep(self._read({b: p for b, p in m["parts"].items() if int(b) in touched})) if m is not None else batch.limit(0)
        return self._write(rest.unionByName(batch, allowMissingColumns=True), touched)

    def _checked(self, batch: DataFrame) -> tuple[DataFrame, list[int]]:
        """The batch with vectors of length one, written once, and its buckets."""
        batch = materialise(batch, "batch")
        validate(batch, self.dimension)
        self.load(check=False)  # the model must be that of the index
        buckets = [r[0] for r in batch.select(bucket_of(F.col("source"))).distinct().collect()]  # BUCKETS rows at most
        return normalised(batch), buckets

    def add(self, batch: DataFrame) -> int:
        """Insert rows, or replace those with the same id wherever they are."""
        batch, touched = self._checked(batch)
        held = self.load().select("id", bucket_of(F.col("source")).alias("b")).join(batch.select("id"), "id", "left_semi").select("b").distinct().collect()
        return self._change(batch, sorted({*touched, *(r["b"] for r in held)}), lambda t: t.join(batch.select("id").distinct(), "id", "left_anti"))

    def replace_source(self, batch: DataFrame, *, replace: bool = True) -> tuple[int, int]:
        """(removed, added); the batch is checked before anything is replaced."""
        batch, touched = self._checked(batch)
        names = [r[0] for r in batch.select("source").distinct().limit(2).collect()]
        if len(names) > 1:
            raise ChunkIndexError("all rows must have the same source")
        if not names:
            return 0, 0
        removed = self.load().where(F.col("source") == names[0]).count()
        if removed and not replace:
            raise DuplicateSourceError(names[0])
        self._change(batch, touched, lambda t: delete_source(t, names[0]))
        return removed, batch.count()

    def replace_all(self, batch: DataFrame) -> int:
        """Replace every source of the batch at once: one snapshot for a whole bulk run."""
        batch, touched = self._checked(batch)
        return self._change(batch, touched, lambda t: t.join(batch.select("source").distinct(), "source", "left_anti"))

    def delete_source(self, source: str) -> int:
        removed = self.load().where(F.col("source") == source).count()
        if removed:
            touched = [r[0] for r in self.spark.range(1).select(bucket_of(F.lit(source))).collect()]
            self._change(self.spark.createDataFrame([], CHUNK_SCHEMA), touched, lambda t: delete_source(t, source))
        return removed

    def clear(self) -> None:
        self.save(self.spark.createDataFrame([], CHUNK_SCHEMA))


def filter_sources(table: DataFrame, names: list[str] | None) -> DataFrame:
    """None keeps all rows, an empty list none."""
    return table if names is None else table.where(F.col("source").isin(names)) if names else table.where(F.lit(False))


def in_sources(source: Column, names: Column) -> Column:
    """The same rule with a column of lists."""
    return names.isNull() | F.array_contains(names, source)
