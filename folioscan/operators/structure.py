"""Document structure: heading streams, running lines, context headers, garbled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.khmer import looks_garbled

EDGE = 2
LEAST_PAGES = 5


STRETCH = 10_000
MOST_CHARS = 1_000_000


def heading_streams(sections: DataFrame, *, stretch: int = STRETCH) -> DataFrame:
    """Number the runs of sections under one heading within each source: adds ``stream``, from 0 and ascending with ``seq``.

    A run ends where a section starts a heading or the heading changes. Null headings count as empty.
    Sources are ordered in stretches of ``stretch`` sequence numbers, so that the largest one is ordered by
    many tasks; the last heading and the number of runs of each stretch are handed on to the next, so the
    result is the same for every ``stretch``.
    """
    if stretch < 1:
        raise ValueError("stretch must be at least 1")
    w = Window.partitionBy("source", "_stretch").orderBy("seq")
    heading = F.coalesce("heading", F.lit(""))
    s = sections.withColumn("_stretch", F.floor(F.col("seq") / stretch))
    ends = s.groupBy("source", "_stretch").agg(F.max_by(heading, "seq").alias("_last"))
    ends = ends.select("source", "_stretch", F.lag("_last").over(Window.partitionBy("source").orderBy("_stretch")).alias("_handed"))
    known = s.join(ends, [s["source"].eqNullSafe(ends["source"]), s["_stretch"].eqNullSafe(ends["_stretch"])]).drop(ends["source"], ends["_stretch"])
    before = F.coalesce(F.lag(heading).over(w), F.col("_handed"))
    fresh = F.coalesce("starts_heading", F.lit(False)) | before.isNull() | (heading != before)
    runs = known.withColumn("_run", F.sum(fresh.cast("long")).over(w))
    counts = runs.groupBy("source", "_stretch").agg(F.max("_run").alias("_runs"))
    earlier = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("_s"), F.col("_stretch").alias("_p"), F.coalesce(F.sum("_runs").over(earlier), F.lit(0)).alias("_base"))
    out = runs.join(counts, runs["source"].eqNullSafe(counts["_s"]) & runs["_stretch"].eqNullSafe(counts["_p"]))
    return out.withColumn("stream", (F.col("_base") + F.col("_run") - 1).cast("long")).drop("_stretch", "_handed", "_run", "_s", "_p", "_base")


def stream_parts(streams: DataFrame, *, most_chars: int = MOST_CHARS, stretch: int = STRETCH) -> DataFrame:
    """(source, seq, stream, part) of (source, seq, stream, n): a stream goes on in a new part where it has reached ``most_chars`` code points."""
    s = streams.select("source", "seq", "stream", F.col("n").cast("long").alias("_n"), F.floor(F.col("seq") / stretch).alias("_stretch"))
    sums = s.groupBy("source", "stream", "_stretch").agg(F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy("source", "stream").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("stream").alias("_t"), F.col("_stretch").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    s = s.join(sums, s["source"].eqNullSafe(sums["_s"]) & (s["stream"] == sums["_t"]) & s["_stretch"].eqNullSafe(sums["_p"]))
    inside = F.sum("_n").over(Window.partitionBy("source", "stream", "_stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return s.select("source", "seq", "stream", F.floor((F.col("_base") + F.coalesce(inside, F.lit(0))) / most_chars).cast("int").alias("part"))


def numbered(sections: DataFrame, *, most_chars: int = MOST_CHARS, stretch: int = STRETCH) -> DataFrame:
    """Sections (source, seq, text, heading, starts_heading, ...) with stream and part, which are worked out without the texts."""
    light = sections.select("source", "seq", "heading", "starts_heading", F.length("text").alias("n"))
    numbers = stream_parts(heading_streams(light, stretch=stretch), most_chars=most_chars, stretch=stretch).dropDuplicates(["source", "seq"])
    numbers = numbers.select(F.col("source").alias("_s"), F.col("seq").alias("_q"), "stream", "part")
    return sections.join(numbers, sections["source"].eqNullSafe(numbers["_s"]) & (sections["seq"] == numbers["_q"])).drop("_s", "_q")


def join_streams(streams: DataFrame, *, most_chars: int = MOST_CHARS, stretch: int = STRETCH) -> DataFrame:
    """One row a stream and part: source, stream, part, heading, text (sections joined by a blank line), starts (offset, page of each section), vault.

    Sections without ``part`` get it here, so that no joined text outgrows a task.
    """
    s = streams
    if "part" not in s.columns:
        parts = stream_parts(s.select("source", "seq", "stream", F.length("text").alias("n")), most_chars=most_chars, stretch=stretch).dropDuplicates(["source", "seq"])
        parts = parts.select(F.col("source").alias("_s"), F.col("seq").alias("_q"), "part")
        s = s.join(parts, s["source"].eqNullSafe(parts["_s"]) & (s["seq"] == parts["_q"])).drop("_s", "_q")
    part = F.struct("seq", "text", "page", F.coalesce("vault", F.create_map().cast("map<string,string>")).alias("vault"))
    grouped = s.groupBy("source", "stream", "part").agg(F.array_sort(F.collect_list(part), lambda a, b: F.when(a.seq < b.seq, -1).when(a.seq > b.seq, 1).otherwise(0)).alias("parts"), F.max(F.coalesce("heading", F.lit(""))).alias("heading"))
    starts = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,page:int>>").alias("list")),
        lambda a, p: F.struct((a.at + F.length(p.text) + 2).alias("at"), F.concat(a.list, F.array(F.struct(a.at.alias("offset"), p.page.alias("page")))).alias("list")),
        lambda a: a.list,
    )
    vault = F.aggregate("parts", F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(m, p.vault))
    return grouped.select("source", "stream", "part", "heading", F.array_join(F.transform("parts", lambda p: p.text), "\n\n").alias("text"), starts.alias("starts"), vault.alias("vault"))


def edge_lines(text: Column) -> Column:
    """The distinct first and last two lines that are not blank, stripped."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]", -1), lambda x: F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), lambda x: x != "")
    return F.array_distinct(F.concat(F.slice(lines, 1, EDGE), F.when(F.size(lines) > EDGE, F.slice(lines, -EDGE, EDGE)).otherwise(lines)))


def running_lines(pages: DataFrame, *, source: str = "source", page: str = "page", text: str = "text", share: float = 0.5) -> DataFrame:
    """Edge lines that stand on at least ``share`` of a source's pages, of sources with five pages or more: source, line, pages, of."""
    distinct = pages.where(F.col(page).isNotNull() & F.col(text).isNotNull()).select(source, page, text)
    totals = distinct.groupBy(source).agg(F.count_distinct(page).alias("of")).where(F.col("of") >= LEAST_PAGES)
    lines = distinct.select(source, page, F.explode(edge_lines(F.col(text))).alias("line")).distinct()
    return lines.groupBy(source, "line").agg(F.count("*").alias("pages")).join(totals, source).where(F.col("pages") >= share * F.col("of"))


def remove_running_lines(pages: DataFrame, running: DataFrame, *, source: str = "source", text: str = "text") -> DataFrame:
    """Pages without up to two running lines at either end; blank lines at the edge go with them."""
    lists = running.groupBy(source).agg(F.collect_list("line").alias("_running"))
    lines = F.split(F.col(text), "\n", -1)

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")

    def strip(a: Column) -> Column:
        state = F.aggregate(
            a,
            F.struct(F.lit(0).alias("gone"), F.lit(0).alias("drop"), F.lit(True).alias("on")),
            lambda s, x: F.struct(
                F.when(s.on & (s.gone < EDGE) & (bare(x) != "") & F.array_contains("_running", bare(x)), s.gone + 1).otherwise(s.gone).alias("gone"),
                F.when(s.on & (s.gone < EDGE) & ((bare(x) == "") | F.array_contains("_running", bare(x))), s.drop + 1).otherwise(s.drop).alias("drop"),
                (s.on & (s.gone < EDGE) & ((bare(x) == "") | F.array_contains("_running", bare(x)))).alias("on"),
            ),
        )
        return F.slice(a, state.drop + 1, F.greatest(F.size(a) - state.drop, F.lit(0)))

    done = F.array_join(F.reverse(strip(F.reverse(strip(lines)))), "\n")
    joined = pages.join(lists, source, "left")
    return joined.withColumn(text, F.when(F.col("_running").isNull(), F.col(text)).otherwise(done)).drop("_running")


def join_broken_words(text: Column) -> Column:
    """Hyphens at line ends between a Latin letter and a lower-case one removed with the line break."""
    return F.regexp_replace(text, r"(?<=[A-Za-z])-\n(?=[a-z])", "")


def context_header(title: Column, heading: Column, most: int = 160) -> Column:
    """Title and heading path; of longer ones the end, behind an ellipsis."""
    def part(c: Column) -> Column:
        return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))

    h = F.concat_ws(" › ", part(title), part(heading))
    return F.when(F.length(h) > most, F.concat(F.lit("…"), F.right(h, F.lit(most - 1)))).otherwise(h)


def embedding_text(title: Column, heading: Column, text: Column) -> Column:
    h = context_header(title, heading)
    return F.when(h == "", text).otherwise(F.concat(h, F.lit("\n\n"), text))


def page_quality(pages: DataFrame) -> DataFrame:
    """Per source: pages, garbled pages, empty pages, and the warning texts."""
    g = pages.groupBy("source").agg(
        F.count("*").alias("pages"),
        F.count_if(looks_garbled(F.col("text"))).alias("garbled"),
        F.count_if(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") == "").alias("empty"),
    )
    warn = F.array_compact(
        F.array(
            F.when(F.col("garbled") > 0, F.format_string("%d of %d pages have a garbled text layer", "garbled", "pages")),
            F.when(F.col("empty") > 0, F.format_string("%d of %d pages have no extractable text", "empty", "pages")),
        )
    )
    return g.withColumn("warnings", warn)
