import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioscan.functions import plain
from folioscan.functions.patterns import ZWSP
from folioscan.functions.vectors import HashingEmbedder
from folioscan.operators import chunking, evaluate, index, ocr, prompts, search, structure
from folioscan.plans import pipeline
from folioscan.plans.settings import Settings
from folioscan.sources import files


def chunk_texts(text, size, overlap, vault=None):
    return [text[a:b].replace(ZWSP, "") for a, b in chunking.Splitter(size, overlap).spans(text, vault)]


def test_chunk_sizes_and_overlap():
    text = " ".join(f"Fact {i} is short and clear." for i in range(60))
    got = chunk_texts(text, 200, 40)
    assert len(got) > 3 and max(map(len, got)) <= 200
    assert all(b.startswith(a[-27:].split(". ")[-1][:5]) or a.split(". ")[-1][:10] in b for a, b in zip(got, got[1:], strict=False))


def test_chunks_keep_formulas_and_clusters():
    token = "⟦MATH_" + "a" * 32 + "⟧"
    assert chunk_texts(f"Before it. {token} after it.", 100, 10, {token: "$" + "x" * 500 + "$"}) == ["Before it.", token, "after it."]
    got = chunk_texts(plain.mark_words("ស្រឡាញ់ភាសាខ្មែរ" * 20), 50, 10)
    assert max(map(len, got)) <= 50 and not any(ZWSP in c for c in got)
    km = chunk_texts(plain.mark_words("".join(f"ប្រយោគនេះខ្លីណាស់។" for _ in range(20))), 150, 0)
    assert all(c.endswith("។") for c in km)
    with pytest.raises(ValueError):
        chunking.Splitter(10, 10)


SECTIONS = "source string, seq int, text string, page int, heading string, starts_heading boolean"


def test_page_spans(spark):
    rows = [("a", 0, "ទំព័រទីមួយ $a^2$", 1, "", False), ("a", 1, "Page two $$b$$ and $c$", 2, "", False)]
    df = spark.createDataFrame(rows, SECTIONS)
    one = pipeline.prepare_chunks(df, Settings(chunk_size=500, chunk_overlap=50)).collect()
    assert [(r.page, r.page_end, len(r.vault)) for r in one] == [(1, 2, 3)]
    two = chunking.chunk_streams(pipeline.prepare_streams(df), size=25, overlap=0).orderBy("chunk_index").collect()
    assert [(r.page, r.page_end) for r in two] == [(1, 1), (2, 2)]
    assert pipeline.prepare_chunks(df.limit(0)).count() == 0
    assert chunking.lost_tokens(pipeline.prepare_streams(df), chunking.chunk_streams(pipeline.prepare_streams(df))).count() == 0


def test_headed_sections(spark):
    rows = [("a", 0, "Limits\nintro", 1, "Limits", True), ("a", 1, "Definition of it", 1, "Limits › Definition", True), ("a", 2, "goes on", 2, "Limits › Definition", False), ("a", 3, "Example", 2, "Limits › Example", True)]
    got = pipeline.prepare_chunks(spark.createDataFrame(rows, SECTIONS)).orderBy("chunk_index").collect()
    assert [(r.heading, r.page, r.page_end) for r in got] == [("Limits", 1, 1), ("Limits › Definition", 1, 2), ("Limits › Example", 2, 2)]
    long_ = spark.createDataFrame([("a", i, "x" * 600, 1, "", False) for i in range(5)], SECTIONS)
    streams = structure.heading_streams(long_).withColumn("vault", F.create_map().cast("map<string,string>"))
    assert streams.agg(F.max("stream")).first()[0] == 0
    assert structure.join_streams(streams, most_chars=1000).agg(F.max("part")).first()[0] == 2


def test_long_sources_in_stretches(spark):
    df = spark.createDataFrame([("a", i, f"Part {i} of it.", i, "H" if i > 3 else "", False) for i in range(12)], SECTIONS)
    masked = df.withColumn("vault", F.create_map().cast("map<string,string>"))
    made = []
    for s in (100, 4, 1):
        streams = structure.heading_streams(masked, stretch=s)
        assert [r.stream for r in streams.orderBy("seq").collect()] == [0] * 4 + [1] * 8
        chunks = chunking.chunk_streams(structure.join_streams(streams, stretch=s), size=20, overlap=0).orderBy("chunk_index").collect()
        assert [c.chunk_index for c in chunks] == list(range(len(chunks))) and [c.page for c in chunks] == sorted(c.page for c in chunks)
        made.append([(c.id, c.text) for c in chunks])
    assert made[0] == made[1] == made[2]


def test_context_header(spark):
    df = spark.createDataFrame([("Lesson 2", "Limits"), ("", ""), ("T" * 100, "H" * 100)], "t string, h string")
    got = [r[0] for r in df.select(structure.context_header(F.col("t"), F.col("h"))).collect()]
    assert got[0] == "Lesson 2 › Limits" and got[1] == "" and len(got[2]) == 160 and got[2].startswith("…")


def test_running_lines(spark):
    rows = [("d", n, f"Header\n\nbody {n}\nmore {n}\nFooter") for n in range(1, 6)] + [("d", 6, "alone"), ("e", 1, "Header\nx")]
    df = spark.createDataFrame(rows, "source string, page int, text string")
    lines = structure.running_lines(df)
    assert {r.line for r in lines.collect()} == {"Header", "Footer"}
    done = {(r.source, r.page): r.text for r in structure.remove_running_lines(df, lines).collect()}
    assert done["d", 1] == "body 1\nmore 1" and done["d", 6] == "alone" and done["e", 1] == "Header\nx"


VECTORS = [("a", "doc.md", [1.0, 0.0, 0.0]), ("b", "doc.md", [0.8, 0.6, 0.0]), ("c", "other.md", [0.0, 1.0, 0.0]), ("d", "doc.md", [0.0, 0.0, 1.0])]


def table(spark, rows=VECTORS):
    return spark.createDataFrame(rows, "id string, source string, embedding array<double>")


def test_search(spark):
    t = table(spark)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(search.top_k(t, [1, 0, 0], 3)) == ["a", "b", "c"]
    assert ids(search.top_k(t, [1, 0, 0], 3, threshold=0.5)) == ["a", "b"]
    assert ids(search.top_k(t, [0, 1, 0], 3, sources=["other.md"])) == ["c"]
    assert ids(search.top_k(t, [0, 1, 0], 3, sources=[])) == [] == ids(search.top_k(t, [0, 0, 0], 3)) == ids(search.top_k(t, [1, 0, 0], 0))
    with pytest.raises(PySparkException):
        search.top_k(t, [1, 0], 3).collect()


def test_batched_search_in_blocks(spark):
    q = t = table(spark, [*VECTORS, ("z", "x", [0.0, 0.0, 0.0]), ("n", "x", None), ("a2", "x", [1.0, 0.0, 0.0])])
    q = t.select(F.col("id").alias("query_id"), "embedding")
    for size in (1 << 20, 24):
        got = search.batched_top_k(t, q, 2, threshold=0.1, max_query_bytes=size)
        rows = {(r.query_id, r["rank"]): r.id for r in got.collect()}
        assert rows["a", 1] == "a" and rows["a", 2] == "a2" and rows["b", 1] == "b" and rows["b", 2] == "a" and rows["d", 1] == "d"
        assert not any(k[0] in "zn" for k in rows)
    alone = search.batched_top_k(t, q, 1, exclude_self=True).collect()
    assert all(r.query_id != r.id for r in alone)
    assert search.batched_top_k(t, q.limit(0), 2).count() == 0


def test_fit_context(spark):
    df = spark.createDataFrame([([6, 6, 3], 10), ([20, 1], 10), ([], 5)], "s array<int>, l int")
    got = [r[0] for r in df.select(search.fit_context(F.col("s"), 10)).collect()]
    assert got == [[1, 3], [1], []]


def test_index(spark, tmp_path):
    ix = index.ChunkIndex(spark, str(tmp_path / "ix"), "test", 3)
    assert ix.load().count() == 0
    assert ix.add(table(spark, VECTORS[:2])) == 2
    assert ix.add(table(spark, [("a", "doc.md", [0.0, 2.0, 0.0])])) == 2
    assert ix.load().where("id = 'a'").first().embedding == [0.0, 1.0, 0.0]
    assert ix.add(table(spark, [VECTORS[2]])) == 3
    assert ix.replace_source(table(spark, [("x", "other.md", [1.0, 0.0, 0.0]), ("y", "other.md", [1.0, 0.0, 0.0])])) == (1, 2)
    with pytest.raises(index.DuplicateSourceError):
        ix.replace_source(table(spark, [("x", "other.md", [1.0, 0.0, 0.0])]), replace=False)
    for bad in ([("q", "s", [1.0])], [("q", "s", [float("nan"), 0.0, 0.0])], [("q", "s", [1.0, 0.0, 0.0])] * 2, [("q", "s", None)]):
        with pytest.raises(index.ChunkIndexError):
            ix.add(table(spark, bad))
    with pytest.raises(index.ChunkIndexError):
        ix.replace_source(table(spark, [("q", "s", [1.0, 0.0, 0.0]), ("r", "t", [1.0, 0.0, 0.0])]))
    assert ix.delete_source("other.md") == 2 and ix.delete_source("other.md") == 0
    assert [r.source for r in index.sources(ix.load()).collect()] == ["doc.md"]
    other = index.ChunkIndex(spark, str(tmp_path / "ix"), "another", 3)
    with pytest.raises(index.ChunkIndexError):
        other.load()
    assert other.load(allow_model_change=True).count() == 0
    ix.clear()
    assert ix.load().count() == 0 and not index.has_source(ix.load(), "doc.md")


CORPUS = {
    "limits.md": "# Limits\nThe limit of a function describes its value near a point. $\\lim_{x\\to 0} \\frac{\\sin x}{x} = 1$",
    "derivatives.md": "# Derivatives\nThe derivative measures the slope of a tangent line. Use the chain rule for composed functions.",
    "integrals.md": "# Integrals\nThe integral gives the area under a curve. $\\int_0^1 x\\,dx$",
    "vectors.md": "# Vectors\nA vector has a length and a direction. The dot product of perpendicular vectors is zero.",
}
CASES = [("limit of a function near a point", "limits.md"), ("chain rule derivative slope", "derivatives.md"), ("area under a curve integral", "integrals.md"), ("dot product of vectors", "vectors.md"), ("slope of the tangent line", "derivatives.md")]


def test_retrieval_end_to_end(spark):
    settings = Settings(chunk_size=500, chunk_overlap=50, top_k=3, score_threshold=0.0)
    rows = [(s, i, p["text"], None, p["heading"], p["starts_heading"]) for s, t in CORPUS.items() for i, p in enumerate(plain.markdown_sections(t))]
    meta = spark.createDataFrame([(s, "markdown", "", None) for s in CORPUS], "source string, format string, title string, ocr_pages array<int>")
    e = HashingEmbedder(1024)
    ix = pipeline.embedded_chunks(pipeline.prepare_chunks(spark.createDataFrame(rows, SECTIONS), settings), meta, e, "2024-01-01 00:00:00").cache()
    q = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(99, "   ")], "query_id int, question string")
    hits = pipeline.search(ix, q, e, settings)
    cases = spark.createDataFrame([(i, None, [c[1]]) for i, c in enumerate(CASES)], "case_id int, relevant_ids array<string>, relevant_sources array<string>")
    m = evaluate.evaluate_retrieval(hits.withColumnRenamed("query_id", "case_id"), cases, 3).first()
    assert m.cases == 5 and m.hit_rate == 1.0 and m.mrr >= 0.9 and m.recall_at_k == 1.0 and 0 < m.precision_at_k <= 1
    assert hits.where("query_id = 99").count() == 0
    with pytest.raises(PySparkException):
        evaluate.evaluate_retrieval(hits.withColumnRenamed("query_id", "case_id"), cases.limit(0), 3).collect()
    ids = ix.select("id").orderBy("id").collect()
    again = pipeline.prepare_chunks(spark.createDataFrame(rows, SECTIONS).repartition(9), settings).select("id").orderBy("id").collect()
    assert ids == again
    shown = hits.withColumn("page", F.lit(3))
    context = prompts.context_blocks(shown, "query_id").where("query_id = 0").first().context
    assert context.startswith('<context>\n<passage id="1" source="limits.md" page="3"')
    questions = spark.createDataFrame([(0, "why?", "en"), (7, "none", "km")], "query_id int, question string, language string")
    messages = {r.query_id: r.message for r in prompts.user_messages(questions, prompts.context_blocks(shown, "query_id"), "query_id").collect()}
    assert messages[0].endswith("<response_language>en</response_language>") and "<note>" in messages[7]
    answers = {r.query_id: r.answer for r in prompts.extractive_answers(questions, shown, "query_id").collect()}
    assert "**[1] limits.md, page 3** (score " in answers[0] and answers[7] == prompts.ANSWER_TEXT["km"]["empty"]


def test_history(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "left alone"), (1, 4, "user", "q2"), (1, 5, "assistant", "  "), (2, 0, "assistant", "only")]
    df = spark.createDataFrame(rows, "c int, n int, role string, content string")
    assert [r.n for r in prompts.normalized_history(df, "c", "n").orderBy("n").collect()] == [1, 2, 3, 4, 5]
    for stretch in (1, 2, 100):
        assert [(r.n, r.role) for r in prompts.history_pairs(df, "c", "n", stretch=stretch).orderBy("n").collect()] == [(1, "user"), (2, "assistant")]


def test_ocr_contracts(spark):
    regions = spark.createDataFrame([(1, i, y, 20.0, t, c) for i, (y, t, c) in enumerate([(10.0, "a", 0.9), (14.0, "b", 0.9), (60.0, "c", 0.9), (100.0, "d", 0.9), (100.0, "no", 0.1)])], "page_id int, nth int, y double, height double, text string, confidence double")
    assert ocr.text_from_regions(regions, min_confidence=0.4).first().text == "a b\nc\nd"
    pages = spark.createDataFrame([(1, bytearray(b"x"), "image/png"), (2, bytearray(b"y"), "image/png")], "page_id long, data binary, mime_type string")
    keyed = pages.withColumn("keys", ocr.vision_keys("2", ["1"], F.col("mime_type"), F.col("data")))
    cache = keyed.where("page_id = 1").select(F.element_at("keys", 2).alias("key"), F.lit("old").alias("transcript"))
    hit, miss = ocr.lookup(keyed, cache)
    assert [r.transcript for r in hit.collect()] == ["old"] and [r.page_id for r in miss.collect()] == [2]

    def engine(data, mime):
        if data == b"y":
            raise OSError("unreadable")
        return "```\ntext\n```", False

    done = ocr.transcribe_pages(pages, engine).cache()
    assert {r.page_id: r.error for r in done.collect()} == {1: None, 2: "OSError: unreadable"}
    assert [r.transcript for r in ocr.to_cache(done, keyed.select("page_id", "keys")).collect()] == ["text"]
    assert ocr.choose_engine("auto", vision=False, hybrid=True, line=True) == "hybrid"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a.md").write_text("# T\nhello $x$")
    (tmp_path / "sub/b.txt").write_bytes("សួស្តី".encode("utf-16"))
    (tmp_path / "sub/c.pdf").write_bytes(b"%PDF")
    (tmp_path / ".hidden/d.txt").write_text("no")
    (tmp_path / "e.xyz").write_text("no")
    found = files.discover_files(spark, str(tmp_path))
    assert [(r.source, r.format) for r in found.select("source", "format").orderBy("source").collect()] == [("a.md", "markdown"), ("sub/b.txt", "text"), ("sub/c.pdf", "pdf")]
    assert files.discover_files(spark, str(tmp_path), only=["s*.txt"]).count() == 1
    rows = {r.source: r for r in files.read_sections(found).collect()}
    assert rows["a.md"].heading == "T" and rows["sub/b.txt"].text == "សួស្តី" and "PDF" in rows["sub/c.pdf"].error
    catalog = tmp_path / "titles.json"
    catalog.write_text('{"a.md": " Title "}')
    titled = files.with_titles(found, files.load_catalog(spark, str(catalog)))
    assert {r.source: r.title for r in titled.select("source", "title").collect()} == {"a.md": "Title", "sub/b.txt": "", "sub/c.pdf": ""}
    pasted = files.pasted_text(spark.createDataFrame([("p", "markdown", "# H\nx"), ("q", "text", "  ")], "source string, format string, text string"))
    assert [r.text for r in pasted.collect()] == ["H\nx"]


def test_stream(spark, tmp_path):
    from folioscan.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# One\nThe limit of a function.")
    settings = Settings(hashing_dim=64)
    ix = index.ChunkIndex(spark, str(tmp_path / "ix"), "hashing-64", 64)
    for _ in range(2):
        ingest.start(spark, str(tmp_path / "in"), ix, str(tmp_path / "cp"), settings).awaitTermination()
        assert [r.source for r in index.sources(ix.load()).collect()] == ["a.md"]
    (tmp_path / "in/b.md").write_text("# Two\nVectors.")
    ingest.start(spark, str(tmp_path / "in"), ix, str(tmp_path / "cp"), settings).awaitTermination()
    assert [r.source for r in index.sources(ix.load()).collect()] == ["a.md", "b.md"]


def test_settings():
    with pytest.raises(ValueError):
        Settings(chunk_size=100, chunk_overlap=100)
    with pytest.raises(ValueError):
        Settings(top_k=51)


def test_pages_to_sections(spark):
    rows = [(i, "d", i, f"Running title\nbody {i} with a bro-\nken word\nmore text {i}") for i in range(1, 7)] + [(7, "d", 7, "  "), (8, "d", 8, "េមេរៀន េរៀន ាន ិន " * 8), (9, "d", 9, None)]
    pages = spark.createDataFrame(rows, "page_id long, source string, page int, text string")
    transcripts = spark.createDataFrame([(2, "# Limits\n$x$ here"), (9, "goes on")], "page_id long, transcript string")
    sections, warnings = pipeline.pages_to_sections(pages, transcripts)
    got = sections.orderBy("seq").collect()
    assert [(r.page, r.ocr, r.heading) for r in got] == [(1, False, ""), (2, True, "Limits"), (3, False, "Limits"), (4, False, "Limits"), (5, False, "Limits"), (6, False, "Limits"), (9, True, "Limits")]
    assert got[0].text == "body 1 with a broken word\nmore text 1" and got[1].starts_heading
    assert warnings.first().warnings == ["1 of 7 pages have a garbled text layer", "1 of 7 pages have no extractable text"]
    report = pipeline.ingest_report(pipeline.prepare_chunks(sections), warnings).first()
    assert report.formulas == 1 and len(report.warnings) == 2


def test_requests():
    from folioscan.plans.settings import check_request, check_text

    assert check_request("  why? ", top_k=5, score_threshold=0.5, sources=["a"], history=[("user", "x")]) == "why?"
    for bad in ({"prompt": "  "}, {"prompt": "x" * 4001}, {"prompt": "x", "top_k": 0}, {"prompt": "x", "score_threshold": 1.5}, {"prompt": "x", "sources": ["s"] * 101}, {"prompt": "x", "history": [("system", "x")]}):
        with pytest.raises(ValueError):
            check_request(**bad)
    check_text("text", "a.md")
    for text, name in (("  ", "a"), ("x", "a/b"), ("x", "")):
        with pytest.raises(ValueError):
            check_text(text, name)


def test_sql_functions_and_models(spark):
    import numpy as np

    from folioscan.functions.register import register
    from folioscan.functions.vectors import ModelEmbedder

    assert "cosine" in register(spark)
    row = spark.sql(r"SELECT clean_markdown('**a** $x$') AS m, extract_formulas('a $x$ b') AS f, strip_html_tags('<b>c</b>') AS h, cosine(array(1D, 0D), array(1D, 1D)) AS s, tokenize_for_search('Area 1') AS t").first()
    assert (row.m, row.f, row.h, round(row.s, 6), row.t) == ("a $x$", ["$x$"], "c", 0.707107, ["area", "1"])
    e = ModelEmbedder("multilingual-e5-small", 2, lambda: lambda texts: np.array([[len(t), 0] for t in texts]))
    got = spark.createDataFrame([("a",), (None,)], "t string").select(e.column(F.col("t"), query=True)).collect()
    assert got[0][0] == [1.0, 0.0] and got[1][0] is None


def test_service(spark, tmp_path):
    from folioscan.functions.vectors import HashingEmbedder
    from folioscan.plans import generators
    from folioscan.plans.service import NotFoundError, Service

    settings = Settings(hashing_dim=64, score_threshold=0.05)
    ix = index.ChunkIndex(spark, str(tmp_path / "ix"), "hashing-64", 64)
    s = Service(spark, ix, generators.build_embedder("hashing", settings), generators.build_generator("auto"), settings)
    assert s.ask("what is a limit?")["grounded"] is False
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("# Limits\nThe limit of $x^2$ is $0$.")
    (tmp_path / "in/sub/a.md").write_text("# Vectors\nThe sum of vectors.")
    (tmp_path / "in/.hidden.md").write_text("# No")
    (tmp_path / "in/b.pdf").write_bytes(b"x")
    r = s.ingest(str(tmp_path / "in"))
    assert (r.sources, r.chunks, r.formulas, r.failed, r.skipped) == (2, 2, 2, 1, 0)
    assert [x.source for x in s.list_sources().collect()] == ["a.md", "sub/a.md"]
    before = ix.manifest()["parts"]
    assert s.ingest_text("Matrices are tables of numbers.", "m.txt").chunks == 1
    assert {b: p for b, p in ix.manifest()["parts"].items() if b in before and b not in ix.manifest()["counts"]} == {}
    assert sum(p == before.get(b) for b, p in ix.manifest()["parts"].items()) >= 1  # other buckets stay
    with pytest.raises(index.DuplicateSourceError):
        s.ingest_text("again", "m.txt", replace=False)
    assert s.ingest(str(tmp_path / "in"), skip_existing=True).skipped == 2
    a = s.ask("the limit of $x^2$", sources=["a.md"])
    assert a["grounded"] and a["provider"] == "extractive" and "$x^2$" in a["answer"] and a["results"][0].source == "a.md"
    assert s.ask("the limit of $x^2$", generate=False)["answer"] is None
    s.generator = generators.build_generator("echo", {"echo": lambda: generators.ModelGenerator("echo", "e1", lambda m: (m.upper(), "stop"))})
    assert "<QUESTION>" in s.ask("the limit")["answer"]
    assert s.delete_source("sub/a.md") == 1
    with pytest.raises(NotFoundError):
        s.delete_source("sub/a.md")
    with pytest.raises(ValueError):
        generators.build_generator("none")


def test_index_count_is_checked(spark, tmp_path):
    ix = index.ChunkIndex(spark, str(tmp_path / "ix"), "m", 2)
    rows = [("i1", "a", [1.0, 0.0]), ("i2", "b", [0.0, 1.0])]
    ix.add(spark.createDataFrame(rows, "id string, source string, embedding array<float>"))
    assert ix.load().count() == 2
    part = next(iter(ix.manifest()["parts"].values()))
    for f in (tmp_path / "ix" / part).glob("*.parquet"):
        f.unlink()
    with pytest.raises(index.ChunkIndexError):
        index.ChunkIndex(spark, str(tmp_path / "ix"), "m", 2).load()


def test_transcription(spark, tmp_path):
    calls = []

    def flaky(data, mime):
        calls.append(data)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return "ok", False

    assert ocr.patient(flaky, attempts=3, pause=0, sleep=lambda s: None)(b"x", "image/png") == ("ok", False)
    assert ocr.hybrid_engine(lambda d, m: ("plain", True), lambda d, m, t: ("never", False))(b"", "") == ("plain", False)
    assert ocr.hybrid_engine(lambda d, m: ("ខ្មែរ", True), lambda d, m, t: (t + "!", True))(b"", "") == ("ខ្មែរ!", True)
    assert ocr.page_payload([("p.PNG", b"i")], b"pdf") == (b"i", "image/png") and ocr.page_payload([], b"pdf") == (b"pdf", "application/pdf") and ocr.page_payload([], b"pdf", lambda p: b"r") == (b"r", "image/png")
    cache = ocr.TranscriptCache(spark, str(tmp_path / "cache"))
    pages = spark.createDataFrame([(1, bytearray(b"one"), "image/png"), (2, bytearray(b"two"), "image/png"), (3, bytearray(b"cut"), "image/png")], "page_id long, data binary, mime_type string")
    pages = pages.withColumn("keys", ocr.vision_keys("2", ["1"], F.col("mime_type"), F.col("data")))

    def engine(data, mime):
        if data == b"two":
            raise ValueError("bad")
        return data.decode().upper(), data == b"cut"

    first = {r.page_id: (r.transcript, r.truncated, r.error) for r in ocr.transcribe_cached(pages, engine, cache).collect()}
    assert first[1] == ("ONE", False, None) and first[2][2] == "ValueError: bad" and first[3][:2] == ("CUT", True)
    assert [r.transcript for r in cache.read().collect()] == ["ONE"]
    again = {r.page_id: r.transcript for r in ocr.transcribe_cached(pages, lambda d, m: ("new", False), cache).collect()}
    assert again == {1: "ONE", 2: "new", 3: "new"}


def test_plugged_in_segmenter(spark):
    from folioscan.functions import khmer, plain

    assert plain.pieces("កខគ x", lambda run: [run[:2], run[2:]]) == ["កខ", "គ", " x"]
    assert plain.pieces("កខ", lambda run: ["lost"]) == plain.pieces("កខ") == plain.pieces("កខ", lambda run: 1 / 0)
    df = spark.createDataFrame([("កខគ",)], "t string")
    assert df.select(khmer.segment_with(lambda run: [run])(F.col("t"))).first()[0] == ["កខគ"]
