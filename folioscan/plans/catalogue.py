"""Queries of the reference operators by name, over the test tables, and SQL with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions import formulas, khmer, ocr_text, vectors
from folioscan.functions.patterns import HTML_TAG
from folioscan.operators import chunking, evaluate, index, ocr, prompts, search, structure
from folioscan.plans import pipeline
from folioscan.plans.settings import Settings
from folioscan.runtime import materialise, table
from folioscan.sources import files

SMALL = Settings(score_threshold=0.05)


def chunks(s: SparkSession, d: str) -> DataFrame:
    """The chunk table without repeated rows."""
    return table(s, d, "chunks").dropDuplicates(["rec_id"])


def sections(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sections").dropDuplicates(["section_id"])


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars", "title", "format", "pages", "created_at").dropDuplicates(["doc_id"])


def vecs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def asked(s: SparkSession, d: str) -> DataFrame:
    return vecs(s, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def turns(s: SparkSession, d: str) -> DataFrame:
    """Conversations from requests and responses: the prompt and its answers in order of time."""
    q = table(s, d, "query_requests").dropDuplicates(["request_id"])
    r = table(s, d, "query_responses").dropDuplicates(["response_id"])
    users = q.select("session_id", (F.col("request_id") * 10).alias("turn"), F.lit("user").alias("role"), F.col("prompt").alias("content"))
    first = r.groupBy("request_id").agg(F.min("response_id").alias("response_id"))
    said = r.join(first, ["request_id", "response_id"]).join(q.select("request_id", "session_id"), "request_id")
    return users.unionByName(said.select("session_id", (F.col("request_id") * 10 + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# -- vectors and search

def topk_cosine(s, d):
    q = vecs(s, d).where("vec_id = 0").select("embedding").first()[0]
    return rounded(search.top_k(vecs(s, d), q, 10, threshold=0.2, key="vec_id").select("vec_id", "score"), "score")


def topk_source_filter(s, d):
    q = vecs(s, d).where("vec_id = 1").select("embedding").first()[0]
    t = vecs(s, d).withColumn("source", F.concat(F.lit("label-"), F.col("label").cast("string")))
    return rounded(search.top_k(t, q, 5, sources=["label-1", "label-3"], key="vec_id").select("vec_id", "source", "score"), "score")


def topk_empty_sources(s, d):
    t = vecs(s, d).withColumn("source", F.col("label").cast("string"))
    return search.top_k(t, [1.0] * 64, 5, sources=[], key="vec_id").select("vec_id")


def batched_topk(s, d):
    r = search.batched_top_k(vecs(s, d), asked(s, d), 5, key="vec_id", exclude_self=True)
    return rounded(r, "score")


def l2_normalize(s, d):
    v = vecs(s, d).select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.transform("v", lambda x: F.round(x.cast("double"), 5)).alias("v"), F.round(vectors.norm(F.col("v")), 6).alias("length"))


def cosine_to_one(s, d):
    """Cosine of every vector to the first one."""
    q = vecs(s, d).where("vec_id = 0").select("embedding").first()[0]
    one = F.array(*(F.lit(float(x)) for x in q))
    return vecs(s, d).select("vec_id", F.round(vectors.cosine_similarity(F.col("embedding"), one), 6).alias("score"))


def vector_validation(s, d):
    return index.vector_problems(table(s, d, "chunk_vectors"), 64, key="vec_id")


def retrieval_metrics(s, d):
    v = vecs(s, d)
    hits = search.batched_top_k(v, asked(s, d), 5, key="vec_id", exclude_self=True)
    labelled = hits.join(v.select("vec_id", F.concat(F.lit("label-"), F.col("label").cast("string")).alias("source")), "vec_id")
    results = labelled.select(F.col("query_id").alias("case_id"), F.col("vec_id").cast("string").alias("id"), "source", "rank")
    cases = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("case_id"), F.lit(None).cast("array<string>").alias("relevant_ids"), F.array(F.concat(F.lit("label-"), F.col("label").cast("string"))).alias("relevant_sources"))
    return rounded(evaluate.evaluate_retrieval(results, cases, 5), "hit_rate", "mrr", "precision_at_k", "recall_at_k")


def fit_context(s, d):
    per = chunks(s, d).groupBy("source", "page").agg(F.array_sort(F.collect_list(F.struct("rec_id", F.length("text").alias("n")))).alias("l"))
    kept = per.select("source", "page", "l", search.fit_context(F.transform("l", lambda x: x.n), 1500).alias("k"))
    return kept.select("source", F.coalesce("page", F.lit(-1)).alias("page"), F.size("k").cast("long").alias("kept"), F.aggregate("k", F.lit(0).cast("long"), lambda a, i: a + F.element_at("l", i).n).alias("used"))


# -- the chunk table

def source_summary(s, d):
    return index.sources(chunks(s, d))


def totals(s, d):
    return index.totals(chunks(s, d))


def duplicate_ids(s, d):
    return index.duplicate_ids(table(s, d, "chunks").select("rec_id", "id"))


def upsert_by_id(s, d):
    t = docs(s, d).select("doc_id", "source", "n_chars")
    new = t.where("doc_id % 3 = 0").select((F.col("doc_id") * 2).alias("doc_id"), F.lit("new").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    return index.upsert(t, new, "doc_id")


def delete_source(s, d):
    return index.delete_source(docs(s, d).select("doc_id", "source"), "open_argument")


def replace_source(s, d):
    t = docs(s, d).select("doc_id", "source")
    new = s.createDataFrame([(-1, "open_argument"), (-2, "open_argument")], "doc_id long, source string")
    return index.replace_sources(t, new)


def skip_existing(s, d):
    q = table(s, d, "query_requests").select(F.explode("sources").alias("source")).distinct()
    return index.new_sources(sections(s, d).select("source").distinct(), q)


def source_semi(s, d):
    q = table(s, d, "query_requests").select(F.explode("sources").alias("source")).distinct()
    return index.with_sources(sections(s, d).select("section_id", "source"), q)


def catalog_left_join(s, d):
    catalog = table(s, d, "mix_targets").select("source", F.concat(F.lit("Title of "), F.col("source")).alias("title"))
    return files.with_titles(docs(s, d).select("doc_id", "source"), catalog)


def chunk_id_hash(s, d):
    c = chunks(s, d)
    return c.select("rec_id", chunking.chunk_id(F.col("source"), F.col("chunk_index"), F.col("page"), F.col("text")).alias("id"))


def point_lookup(s, d):
    c = chunks(s, d)
    return c.join(index.get(c, "593c63a0e8b9572ebd845f3ecfe1bbd6").select("source").distinct(), "source").select("rec_id", "source")


# -- text

def language_detect(s, d):
    t = docs(s, d)
    return t.select("doc_id", khmer.detect_language(F.col("text"), masked=False).alias("language"))


def language_detect_masked(s, d):
    return sections(s, d).select("section_id", khmer.detect_language(F.col("text")).alias("language"))


def language_of_chunks(s, d):
    """Language and ratio of chunks, whose formulas are masked, as the library takes them."""
    return chunks(s, d).select("rec_id", khmer.detect_language(F.col("text")).alias("language"), F.round(khmer.khmer_ratio(F.col("text")), 6).alias("ratio"))


def khmer_ratio(s, d):
    return docs(s, d).select("doc_id", F.round(khmer.khmer_ratio(F.col("text"), masked=False), 6).alias("ratio"))


def looks_garbled(s, d):
    return sections(s, d).select("section_id", khmer.looks_garbled(F.col("text")).alias("garbled"))


def contains_khmer(s, d):
    return docs(s, d).select("doc_id", khmer.contains_khmer(F.col("text")).alias("khmer"))


def normalize_text(s, d):
    return sections(s, d).select("section_id", khmer.normalize_khmer_text(F.col("text")).alias("text"))


def regex_segment(s, d):
    u = sections(s, d).select("section_id", khmer.regex_segment(F.col("text")).alias("u"))
    return u.select("section_id", "u")


def regex_segment_join(s, d):
    """The units joined are the text."""
    return sections(s, d).select("section_id", F.array_join(khmer.regex_segment(F.col("text")), "").alias("text"))


def segment_words(s, d):
    return sections(s, d).select("section_id", khmer.segment(F.col("text")).alias("words"))


def word_boundaries(s, d):
    return sections(s, d).select("section_id", khmer.insert_word_boundaries(khmer.strip_word_boundaries(F.col("text"))).alias("marked"))


def stripped_boundaries(s, d):
    """Marking words and taking the marks away gives the text without any."""
    m = khmer.insert_word_boundaries(khmer.strip_word_boundaries(F.col("text")))
    return sections(s, d).select("section_id", khmer.strip_word_boundaries(m).alias("text"))


def search_token_tf(s, d):
    words = docs(s, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def bigram_tf(s, d):
    w = docs(s, d).select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    pairs = w.select(F.explode(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").alias("n"))


def tokenize_for_search(s, d):
    return sections(s, d).select("section_id", khmer.tokenize_for_search(F.col("text")).alias("tokens"))


def html_tag_strip(s, d):
    t = table(s, d, "ingest_requests").dropDuplicates(["ingest_id"])
    return t.select("ingest_id", F.regexp_replace("text", HTML_TAG, "").alias("text"))


def clean_markdown(s, d):
    return table(s, d, "ingest_requests").dropDuplicates(["ingest_id"]).select("ingest_id", khmer.clean_markdown(F.col("text")).alias("text"))


def markdown_sections(s, d):
    t = table(s, d, "ingest_requests").dropDuplicates(["ingest_id"])
    return t.select("ingest_id", F.posexplode(khmer.markdown_sections(F.col("text"))).alias("seq", "s")).select("ingest_id", "seq", "s.*")


def markdown_headings(s, d):
    """How many sections of each ingested text start at a heading."""
    return markdown_sections(s, d).where("starts_heading").groupBy("ingest_id").agg(F.count("*").alias("headings"))


def join_broken_words(s, d):
    return sections(s, d).select("section_id", structure.join_broken_words(F.col("text")).alias("text"))


# -- formulas

def mask_latex(s, d):
    t = sections(s, d).where("text IS NOT NULL")
    return t.select("section_id", formulas.mask_latex(F.col("text"), F.col("section_id").cast("string")).alias("m")).select("section_id", "m.masked", "m.vault")


def extract_formulas(s, d):
    f = sections(s, d).select("section_id", F.posexplode(formulas.extract_formulas(F.col("text"))).alias("nth", "formula"))
    return f.select("section_id", "nth", "formula", formulas.strip_delimiters(F.col("formula")).alias("body"), formulas.is_display_formula(F.col("formula")).alias("display"), formulas.has_balanced_braces(F.col("formula")).alias("balanced"))


def formula_parts(s, d):
    """Every formula of the chunks with its body, kind and balance."""
    f = chunks(s, d).select("rec_id", F.explode(F.map_entries("vault")).alias("e")).select("rec_id", F.col("e.key").alias("token"), F.col("e.value").alias("formula"))
    return f.select("rec_id", "token", formulas.strip_delimiters(F.col("formula")).alias("body"), formulas.is_display_formula(F.col("formula")).alias("display"), formulas.has_balanced_braces(F.col("formula")).alias("balanced"))


def mask_round_trip(s, d):
    """Masking and restoring gives the text."""
    m = sections(s, d).select("section_id", formulas.mask_latex(F.col("text"), F.col("section_id").cast("string")).alias("m"))
    return m.select("section_id", formulas.unmask_latex(F.col("m.masked"), F.col("m.vault"), strict=True).alias("text"))


def chunk_tokens(s, d):
    return chunks(s, d).select("rec_id", F.explode(formulas.find_placeholders(F.col("text"))).alias("token"))


def unmask_chunks(s, d):
    c = chunks(s, d)
    return c.select("rec_id", formulas.unmask_latex(F.col("text"), F.col("vault")).alias("text"), formulas.restored_length(F.col("text"), F.col("vault")).cast("long").alias("n"))


def sub_vault(s, d):
    return chunks(s, d).select("rec_id", F.size(formulas.sub_vault(F.col("text"), F.col("vault"))).cast("long").alias("used"))


def lost_formulas(s, d):
    """Tokens without a vault entry: an anti join of tokens and vault keys."""
    c = chunks(s, d)
    t = c.select("rec_id", F.explode(formulas.find_placeholders(F.col("text"))).alias("token")).distinct()
    return t.join(c.select("rec_id", F.explode(F.map_keys("vault")).alias("token")), ["rec_id", "token"], "left_anti")


def formula_totals(s, d):
    c = chunks(s, d)
    return c.groupBy("source").agg(F.sum(F.coalesce(F.size("vault"), F.lit(0))).alias("formulas"), F.sum(formulas.restored_length(F.col("text"), F.col("vault"))).alias("characters"))


# -- structure and chunking

def heading_streams(s, d):
    r = structure.heading_streams(sections(s, d).select("section_id", "source", "seq", "text", "heading", "starts_heading"))
    return r.select("section_id", "source", "stream")


def running_lines(s, d):
    t = sections(s, d)
    return structure.running_lines(t, share=0.2).select("source", "line", "pages", "of")


def remove_running_lines(s, d):
    t = sections(s, d).select("section_id", "source", "page", "text")
    return structure.remove_running_lines(t, structure.running_lines(t, share=0.2)).select("section_id", "text")


def context_header(s, d):
    return chunks(s, d).select("rec_id", structure.context_header(F.col("title"), F.coalesce("heading", F.lit(""))).alias("header"))


def page_quality(s, d):
    return structure.page_quality(sections(s, d)).select("source", "pages", "garbled", "empty")


def chunk_sections(s, d):
    c = pipeline.prepare_chunks(sections(s, d).select("source", "seq", "text", "page", "heading", "starts_heading"))
    return c.select("id", "source", "chunk_index", "text", "page", "page_end", "heading")


def chunk_integrity(s, d):
    streams = pipeline.prepare_streams(sections(s, d).select("source", "seq", "text", "page", "heading", "starts_heading"))
    return chunking.lost_tokens(streams, chunking.chunk_streams(streams))


def embed_chunks(s, d):
    v = chunks(s, d).select("rec_id", vectors.HashingEmbedder(256).column(formulas.unmask_latex(F.col("text"), F.col("vault"))).alias("v"))
    return v.select("rec_id", F.round(vectors.norm(F.col("v")), 4).alias("length"))


def semantic_search(s, d):
    """Sections to chunks to vectors, asked with every twentieth prompt, within the context budget."""
    sec = sections(s, d).select("source", "seq", "text", "page", "heading", "starts_heading", "ocr")
    meta = sec.groupBy("source").agg(F.lit("text").alias("format"), F.lit("").alias("title"), F.collect_set(F.when(F.col("ocr"), F.col("page"))).alias("ocr_pages"))
    embedder = vectors.HashingEmbedder(SMALL.hashing_dim)
    rows = materialise(pipeline.embedded_chunks(pipeline.prepare_chunks(sec, SMALL), meta, embedder, "2024-01-01 00:00:00"), "chunk-index")
    q = table(s, d, "query_requests").where("request_id % 20 = 0").dropDuplicates(["request_id"]).select(F.col("request_id").alias("query_id"), F.col("prompt").alias("question"))
    return pipeline.search(rows, q, embedder, SMALL).select("query_id", "rank", "id", "source", "chunk_index", "page", "score", "text")


# -- prompts and history

def passages(s, d):
    """Ready results: the chunks that each response cites, numbered in the order cited."""
    r = table(s, d, "query_responses").dropDuplicates(["response_id"]).select("response_id", "language", F.posexplode("source_ids").alias("nth", "id"))
    c = chunks(s, d).dropDuplicates(["id"]).select("id", "source", "page", "title", "heading", "text")
    j = r.join(c, "id").withColumn("score", F.lit(0.5))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("response_id").orderBy("nth", "id")))


def context_block(s, d):
    return prompts.context_blocks(passages(s, d), "response_id")


def user_message(s, d):
    q = table(s, d, "query_responses").dropDuplicates(["response_id"]).join(table(s, d, "query_requests").dropDuplicates(["request_id"]).select("request_id", "prompt"), "request_id")
    return prompts.user_messages(q.select("response_id", F.col("prompt").alias("question"), "language"), prompts.context_blocks(passages(s, d), "response_id"), "response_id")


def extractive_answer(s, d):
    q = table(s, d, "query_responses").dropDuplicates(["response_id"]).select("response_id", "language")
    return prompts.extractive_answers(q, passages(s, d).drop("language"), "response_id")


def normalized_history(s, d):
    return prompts.normalized_history(turns(s, d), "session_id", "turn").select("session_id", "turn", "role")


def history_pairs(s, d):
    return prompts.history_pairs(turns(s, d), "session_id", "turn").select("session_id", "turn", "role", "content")


# -- recognisers

def khmer_words_only(s, d):
    return sections(s, d).select("section_id", ocr_text.khmer_words_only(F.col("text")).alias("text"))


def unwrap_khmer_text(s, d):
    return chunks(s, d).select("rec_id", ocr_text.unwrap_khmer_text(formulas.unmask_latex(F.col("text"), F.col("vault"))).alias("text"))


def clean_transcript(s, d):
    return table(s, d, "query_responses").dropDuplicates(["response_id"]).select("response_id", ocr_text.clean_transcript(F.col("answer")).alias("text"))


def needs_ocr(s, d):
    return sections(s, d).select("section_id", ocr_text.needs_ocr(F.col("text"), 200).alias("needs"))


def clean_source_name(s, d):
    return table(s, d, "ingest_requests").dropDuplicates(["ingest_id"]).select("ingest_id", ocr_text.clean_source_name(F.col("source_name")).alias("name"))


def ocr_cache(s, d):
    p = sections(s, d).where("ocr").select(F.col("section_id").alias("page_id"), ocr.vision_keys("2", ["1"], F.lit("image/png"), F.encode("text", "UTF-8")).alias("keys"))
    cache = sections(s, d).where("ocr AND section_id % 2 = 0").select(ocr.key("1", "image/png", data=F.encode("text", "UTF-8")).alias("key"), F.lit("cached").alias("transcript")).distinct()
    return ocr.lookup(p, cache)[1].select("page_id")


def visual_lines(s, d):
    p = table(s, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("nth"), "l_quantity").groupBy("page_id", "nth").agg(F.min("l_quantity").alias("y")).withColumn("height", F.lit(10.0))
    return ocr.group_lines(p).select("page_id", "nth", "line")


def format_detect(s, d):
    return table(s, d, "ingest_requests").select("source_name").distinct().select("source_name", files.detect_format(F.col("source_name")).alias("format"))


QUERIES = {
    f.__name__: f
    for f in (
        topk_cosine, topk_source_filter, topk_empty_sources, batched_topk, l2_normalize, cosine_to_one, vector_validation, retrieval_metrics, fit_context,
        source_summary, totals, duplicate_ids, upsert_by_id, delete_source, replace_source, skip_existing, source_semi, catalog_left_join, chunk_id_hash, point_lookup,
        language_detect, language_detect_masked, language_of_chunks, khmer_ratio, looks_garbled, contains_khmer, normalize_text, regex_segment, regex_segment_join, segment_words, word_boundaries, stripped_boundaries, search_token_tf, bigram_tf,
        tokenize_for_search, html_tag_strip, clean_markdown, markdown_sections, markdown_headings, join_broken_words,
        mask_latex, mask_round_trip, extract_formulas, formula_parts, chunk_tokens, unmask_chunks, sub_vault, lost_formulas, formula_totals,
        heading_streams, running_lines, remove_running_lines, context_header, page_quality, chunk_sections, chunk_integrity, embed_chunks, semantic_search,
        context_block, user_message, extractive_answer, normalized_history, history_pairs,
        khmer_words_only, unwrap_khmer_text, clean_transcript, needs_ocr, clean_source_name, ocr_cache, visual_lines, format_detect,
    )
}

# -- SQL. Repeated rows count once.
_C = "(SELECT DISTINCT ON (rec_id) * FROM chunks) c"
_S = "(SELECT DISTINCT ON (section_id) * FROM sections) s"
_D = "(SELECT DISTINCT ON (doc_id) * FROM documents) d"
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_TURNS = """t AS (
    SELECT session_id, request_id * 10 AS turn, 'user' AS role, prompt AS content FROM (SELECT DISTINCT ON (request_id) * FROM query_requests)
    UNION ALL
    SELECT q.session_id, r.request_id * 10 + 1, 'assistant', r.answer
    FROM (SELECT DISTINCT ON (response_id) * FROM query_responses) r
    JOIN (SELECT request_id, min(response_id) AS response_id FROM query_responses GROUP BY request_id) f USING (request_id, response_id)
    JOIN (SELECT DISTINCT ON (request_id) * FROM query_requests) q USING (request_id))"""
_KHMER, _LATIN = "length(regexp_replace(text, '[^ក-៿᧠-᧿]', '', 'g'))", "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
_BLANK = "\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def _trimmed(text: str) -> str:
    """SQL of a text without blanks of any kind at its ends."""
    return f"regexp_replace(regexp_replace({text}, '^[{_BLANK}]+', ''), '[{_BLANK}]+$', '')"


_TIDY = "regexp_replace(regexp_replace(regexp_replace(t, '[" + _BLANK.replace("\\x{9}-\\x{d}", "\\x{9}\\x{b}-\\x{d}") + "]+', ' ', 'g'), ' *\\n *', '\n', 'g'), '\\n{3,}', '\n\n', 'g')"
_GARBLED = """(length(regexp_replace(text, '[^ក-៿᧠-᧿]', '', 'g')) >= 20 AND (len(regexp_extract_all(text, '(?:^|[^ក-៿\\x{200C}\\x{200D}])[ា-៓៝]')) + len(regexp_extract_all(text, '[\\x{E000}-\\x{F8FF}\\x{FFFD}]')))
    / length(regexp_replace(text, '[^ក-៿᧠-᧿]', '', 'g')) > 0.02)"""
_TOKENS = "regexp_extract_all(text, '⟦MATH_[0-9a-f]{{32}}⟧')"
_RESTORED = "CASE WHEN vault IS NULL THEN text ELSE list_reduce(list_concat([text], regexp_extract_all(text, '⟦MATH_[0-9a-f]{32}⟧')), lambda a, t: replace(a, t, coalesce(element_at(vault, t)[1], t))) END"
_LETTERS = "length(regexp_replace(regexp_replace(text, '[^ក-៿᧠-᧿]', '', 'g'), '[^\\p{L}]', '', 'g'))"

_PASSAGES = """r AS (SELECT response_id, language, unnest(source_ids) AS id, generate_subscripts(source_ids, 1) AS nth FROM (SELECT DISTINCT ON (response_id) * FROM query_responses)),
        j AS (SELECT r.response_id, r.language AS asked, row_number() OVER (PARTITION BY response_id ORDER BY nth, c.id) AS n, c.* FROM r JOIN (SELECT DISTINCT ON (id) * FROM chunks) c USING (id))"""


def _stripped(lines: str) -> str:
    """SQL of the number of leading lines that are blank or running, up to the second running one."""
    ok = f"list_transform({lines}, lambda x: CASE WHEN {_trimmed('x')} = '' THEN 0 WHEN list_contains(running, {_trimmed('x')}) THEN 1 ELSE 9 END)"
    return f"""coalesce(list_position(list_transform(range(1, len({lines}) + 1), lambda i: ({ok})[i] = 9 OR coalesce(list_sum(({ok})[1:i - 1]), 0) >= 2), true) - 1, len({lines}))"""


SQL: dict[str, str] = {
    "topk_cosine": f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND {_COS} >= 0.2 ORDER BY {_COS} DESC, a.vec_id LIMIT 10",
    "topk_source_filter": f"SELECT a.vec_id, 'label-' || a.label AS source, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 1 AND a.label IN (1, 3) ORDER BY {_COS} DESC, a.vec_id LIMIT 5",
    "topk_empty_sources": "SELECT vec_id FROM embeddings WHERE false",
    "batched_topk": f"""SELECT query_id, vec_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT b.vec_id AS query_id, a.vec_id, {_COS} AS s, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS rank
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE b.vec_id % 20 = 0) WHERE rank <= 5""",
    "l2_normalize": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
        u AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS u FROM v)
        SELECT vec_id, list_transform(u, lambda x: round(x, 5)) AS v, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS length FROM u""",
    "cosine_to_one": f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0",
    "vector_validation": """SELECT CAST(count(*) AS BIGINT) AS rows, count(*) FILTER (embedding IS NULL) AS missing,
        count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS not_finite, count(*) FILTER (len(embedding) <> 64) AS other_dimension,
        count(DISTINCT len(embedding)) AS dimensions, (SELECT count(*) FROM (SELECT vec_id FROM chunk_vectors GROUP BY vec_id HAVING count(*) > 1)) AS repeated_keys FROM chunk_vectors""",
    "retrieval_metrics": f"""WITH r AS (SELECT * FROM (SELECT b.vec_id AS q, a.label = b.label AS rel, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS rank
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE b.vec_id % 20 = 0) WHERE rank <= 5),
        p AS (SELECT q, max(CAST(rel AS INTEGER)) AS hit, coalesce(1.0 / min(rank) FILTER (rel), 0) AS rr, count(*) FILTER (rel) / 5.0 AS p FROM r GROUP BY q)
        SELECT count(*) AS cases, 5 AS k, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr, round(avg(p), 6) AS precision_at_k, round(avg(hit), 6) AS recall_at_k FROM p""",
    "fit_context": f"""WITH RECURSIVE l AS (SELECT source, page, length(text) AS n, row_number() OVER (PARTITION BY source, page ORDER BY rec_id) AS i FROM {_C}),
        w AS (SELECT source, page, i, CAST(n AS BIGINT) AS used, CAST(1 AS BIGINT) AS kept FROM l WHERE i = 1
              UNION ALL SELECT l.source, l.page, l.i, CASE WHEN w.used + l.n <= 1500 THEN w.used + l.n ELSE w.used END, CASE WHEN w.used + l.n <= 1500 THEN w.kept + 1 ELSE w.kept END
              FROM w JOIN l ON l.source = w.source AND l.page IS NOT DISTINCT FROM w.page AND l.i = w.i + 1)
        SELECT source, coalesce(page, -1) AS page, max(kept) AS kept, max(used) AS used FROM w GROUP BY source, page""",
    "source_summary": f"SELECT source, count(*) AS chunks, count(DISTINCT page) AS pages, arg_min(format, (chunk_index, id)) AS format, min(created_at) AS ingested_at FROM {_C} GROUP BY source",
    "totals": f"SELECT count(DISTINCT source) AS documents, count(*) AS chunks FROM {_C}",
    "duplicate_ids": "SELECT id, count(*) AS n FROM chunks GROUP BY id HAVING count(*) > 1",
    "upsert_by_id": f"""WITH t AS (SELECT doc_id, source, n_chars FROM {_D}), n AS (SELECT doc_id * 2 AS doc_id, 'new' AS source, 0 AS n_chars FROM t WHERE doc_id % 3 = 0)
        SELECT * FROM t WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n""",
    "delete_source": f"SELECT doc_id, source FROM {_D} WHERE source IS DISTINCT FROM 'open_argument'",
    "replace_source": f"SELECT source, doc_id FROM {_D} WHERE source <> 'open_argument' UNION ALL SELECT 'open_argument', -1 UNION ALL SELECT 'open_argument', -2",
    "skip_existing": "SELECT DISTINCT source FROM sections WHERE source NOT IN (SELECT unnest(sources) FROM query_requests)",
    "source_semi": f"SELECT section_id, source FROM {_S} WHERE source IN (SELECT unnest(sources) FROM query_requests)",
    "catalog_left_join": f"SELECT doc_id, d.source, coalesce(m.title, '') AS title FROM {_D} LEFT JOIN (SELECT source, 'Title of ' || source AS title FROM mix_targets) m USING (source)",
    "chunk_id_hash": f"SELECT rec_id, substr(sha256(source || chr(0) || chunk_index || chr(0) || coalesce(CAST(page AS VARCHAR), 'None') || chr(0) || text), 1, 32) AS id FROM {_C}",
    "point_lookup": f"SELECT rec_id, source FROM {_C} WHERE source IN (SELECT source FROM chunks WHERE id = '593c63a0e8b9572ebd845f3ecfe1bbd6')",
    "language_detect": f"SELECT doc_id, CASE WHEN {_LETTERS} + {_LATIN} = 0 THEN 'km' WHEN {_LETTERS} / ({_LETTERS} + {_LATIN}) >= 0.3 THEN 'km' ELSE 'en' END AS language FROM {_D}",
    "khmer_ratio": f"SELECT doc_id, CASE WHEN {_LETTERS} + {_LATIN} > 0 THEN round({_LETTERS} / ({_LETTERS} + {_LATIN}), 6) ELSE 0.0 END AS ratio FROM {_D}",
    "contains_khmer": f"SELECT doc_id, regexp_matches(text, '[ក-៿᧠-᧿]') AS khmer FROM {_D}",
    "search_token_tf": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM {_D}) GROUP BY token",
    "bigram_tf": f"""WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM {_D}), p AS (SELECT w, unnest(range(1, len(w))) AS i FROM w)
        SELECT w[i] || ' ' || w[i + 1] AS pair, count(*) AS n FROM p GROUP BY 1""",
    "html_tag_strip": "SELECT ingest_id, regexp_replace(text, '</?[A-Za-z][A-Za-z0-9-]*(?:\\s[^<>]*)?/?>', '', 'g') AS text FROM (SELECT DISTINCT ON (ingest_id) * FROM ingest_requests)",
    "chunk_tokens": f"SELECT rec_id, unnest(regexp_extract_all(text, '⟦MATH_[0-9a-f]{{32}}⟧')) AS token FROM {_C}",
    "sub_vault": f"SELECT rec_id, len(list_filter(map_keys(vault), lambda k: contains(text, k))) AS used FROM {_C}",
    "lost_formulas": f"""SELECT DISTINCT rec_id, token FROM (SELECT rec_id, vault, unnest(regexp_extract_all(text, '⟦MATH_[0-9a-f]{{32}}⟧')) AS token FROM {_C}) WHERE NOT list_contains(map_keys(vault), token)""",
    "formula_totals": f"""SELECT source, CAST(sum(coalesce(cardinality(vault), 0)) AS BIGINT) AS formulas, CAST(sum(length(replace(text, chr(8203), '')) + coalesce(list_sum(list_transform(
        regexp_extract_all(text, '⟦MATH_[0-9a-f]{{32}}⟧'), lambda m: coalesce(length(element_at(vault, m)[1]) - 39, 0))), 0)) AS BIGINT) AS characters FROM {_C} GROUP BY source""",
    "heading_streams": f"""WITH a AS (SELECT section_id, source, seq, starts_heading, coalesce(heading, '') AS h, lag(coalesce(heading, '')) OVER (PARTITION BY source ORDER BY seq) AS p FROM {_S})
        SELECT section_id, source, CAST(sum(CASE WHEN starts_heading OR p IS NULL OR h <> p THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY seq) - 1 AS BIGINT) AS stream FROM a""",
    "context_header": f"""WITH h AS (SELECT rec_id, concat_ws(' › ', nullif(trim(title), ''), nullif(trim(heading), '')) AS h FROM {_C})
        SELECT rec_id, CASE WHEN length(h) > 160 THEN '…' || right(h, 159) ELSE h END AS header FROM h""",
    "context_block": f"""WITH r AS (SELECT response_id, unnest(source_ids) AS id, generate_subscripts(source_ids, 1) AS nth FROM (SELECT DISTINCT ON (response_id) * FROM query_responses)),
        j AS (SELECT r.response_id, row_number() OVER (PARTITION BY response_id ORDER BY nth, c.id) AS n, c.* FROM r JOIN (SELECT DISTINCT ON (id) * FROM chunks) c USING (id)),
        e AS (SELECT response_id, n, '<passage id="' || n || '" source="' || replace(replace(replace(source, '&', '&amp;'), '"', '&quot;'), '<', '&lt;') || '"' || coalesce(' page="' || page || '"', '')
            || CASE WHEN coalesce(title, '') = '' THEN '' ELSE ' title="' || replace(replace(replace(title, '&', '&amp;'), '"', '&quot;'), '<', '&lt;') || '"' END
            || CASE WHEN coalesce(heading, '') = '' THEN '' ELSE ' section="' || replace(replace(replace(heading, '&', '&amp;'), '"', '&quot;'), '<', '&lt;') || '"' END
            || ' score="0.500">' || chr(10) || replace(replace(text, '</passage', '&lt;/passage'), '</context', '&lt;/context') || chr(10) || '</passage>' AS p FROM j)
        SELECT response_id, '<context>' || chr(10) || string_agg(p, chr(10) ORDER BY n) || chr(10) || '</context>' AS context FROM e GROUP BY response_id""",
    "normalized_history": f"WITH {_TURNS}, f AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY session_id) AS first FROM t) SELECT session_id, turn, role FROM f WHERE turn >= first",
    "history_pairs": f"""WITH {_TURNS}, l AS (SELECT *, lead(role) OVER w AS r2, lead(content) OVER w AS c2, lead(turn) OVER w AS t2 FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
        p AS (SELECT * FROM l WHERE role = 'user' AND r2 = 'assistant' AND regexp_matches(content, '[^\\s\\p{{Z}}]') AND regexp_matches(c2, '[^\\s\\p{{Z}}]')),
        b AS (SELECT session_id, turn, 'user' AS role, substr(content, 1, 20000) AS content FROM p UNION ALL SELECT session_id, t2, 'assistant', substr(c2, 1, 20000) FROM p)
        SELECT session_id, turn, role, content FROM b QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 20""",
    "format_detect": """SELECT DISTINCT source_name, CASE lower(regexp_extract(source_name, '(\\.[^./]+)$', 1)) WHEN '.txt' THEN 'text' WHEN '.text' THEN 'text' WHEN '.md' THEN 'markdown' WHEN '.markdown' THEN 'markdown'
        WHEN '.pdf' THEN 'pdf' WHEN '.png' THEN 'image' WHEN '.jpg' THEN 'image' WHEN '.jpeg' THEN 'image' WHEN '.webp' THEN 'image' END AS format FROM ingest_requests""",
    "visual_lines": """WITH p AS (SELECT l_orderkey AS page_id, l_linenumber AS nth, min(l_quantity) AS y FROM lineitem GROUP BY 1, 2),
        g AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) < 8 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY page_id ORDER BY nth))
        SELECT page_id, nth, CAST(sum(new) OVER (PARTITION BY page_id ORDER BY nth) - 1 AS BIGINT) AS line FROM g""",
    "join_broken_words": f"SELECT section_id, regexp_replace(text, '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g') AS text FROM {_S}",
    "looks_garbled": f"SELECT section_id, coalesce({_GARBLED}, false) AS garbled FROM {_S}",
    "page_quality": f"SELECT source, count(*) AS pages, count(*) FILTER ({_GARBLED}) AS garbled, count(*) FILTER ({_trimmed('text')} = '') AS empty FROM {_S} GROUP BY source",
    "needs_ocr": f"SELECT section_id, length({_trimmed('text')}) < 200 OR coalesce({_GARBLED}, false) AS needs FROM {_S}",
    "normalize_text": f"""WITH n AS (SELECT section_id, translate(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(8203) || chr(65279) || chr(173) || chr(8288), '') AS t FROM {_S}),
        k AS (SELECT section_id, replace(replace(regexp_replace(regexp_replace(t, '([ក-៿])\\x{{200C}}([ក-៿])', '\\1' || chr(1) || '\\2', 'g'), '([ក-៿])\\x{{200C}}([ក-៿])', '\\1' || chr(1) || '\\2', 'g'), chr(8204), ''), chr(1), chr(8204)) AS t FROM n)
        SELECT section_id, {_trimmed(_TIDY)} AS text FROM k""",
    "stripped_boundaries": f"SELECT section_id, replace(text, chr(8203), '') AS text FROM {_S}",
    "regex_segment_join": f"SELECT section_id, text FROM {_S}",
    "mask_round_trip": f"SELECT section_id, text FROM {_S}",
    "language_of_chunks": f"""WITH c AS (SELECT rec_id, regexp_replace(text, '⟦MATH_[0-9a-f]{{32}}⟧', ' ', 'g') AS text FROM {_C}), n AS (SELECT rec_id, {_LETTERS} AS k, {_LATIN} AS a FROM c)
        SELECT rec_id, CASE WHEN k + a = 0 OR k / (k + a) >= 0.3 THEN 'km' ELSE 'en' END AS language, CASE WHEN k + a = 0 THEN 0.0 ELSE round(k / (k + a), 6) END AS ratio FROM n""",
    "formula_parts": f"""WITH f AS (SELECT rec_id, unnest(map_keys(vault)) AS token, unnest(map_values(vault)) AS f FROM {_C}),
        b AS (SELECT *, list_transform(regexp_extract_all(regexp_replace(f, '(?s)\\\\.', '', 'g'), '[{{}}]'), lambda x: CASE WHEN x = '{{' THEN 1 ELSE -1 END) AS d FROM f)
        SELECT rec_id, token, CASE WHEN starts_with(f, '$$') AND ends_with(f, '$$') OR starts_with(f, '\\[') OR starts_with(f, '\\(') THEN substr(f, 3, greatest(length(f) - 4, 0))
            WHEN starts_with(f, '$') AND ends_with(f, '$') THEN substr(f, 2, greatest(length(f) - 2, 0)) ELSE f END AS body,
            starts_with(f, '$$') OR starts_with(f, '\\[') OR starts_with(f, '\\begin') AS display,
            coalesce(list_sum(d), 0) = 0 AND coalesce(list_min(list_transform(range(1, len(d) + 1), lambda i: list_sum(d[1:i]))), 0) >= 0 AS balanced FROM b""",
    "unmask_chunks": f"""SELECT rec_id, {_RESTORED} AS text, length(replace(text, chr(8203), '')) + coalesce(list_sum(list_transform(
        regexp_extract_all(text, '⟦MATH_[0-9a-f]{{32}}⟧'), lambda m: coalesce(length(element_at(vault, m)[1]) - 39, 0))), 0) AS n FROM {_C}""",
    "unwrap_khmer_text": f"""SELECT rec_id, regexp_replace(regexp_replace({_RESTORED}, '\\$\\$\\s*\\\\text\\{{([^{{}}$]*[ក-៿][^{{}}$]*)\\}}\\s*\\$\\$', '\\1', 'g'), '\\$\\s*\\\\text\\{{([^{{}}$]*[ក-៿][^{{}}$]*)\\}}\\s*\\$', '\\1', 'g') AS text FROM {_C}""",
    "clean_transcript": f"""WITH t AS (SELECT response_id, {_trimmed('answer')} AS t FROM (SELECT DISTINCT ON (response_id) * FROM query_responses)),
        u AS (SELECT response_id, regexp_replace(t, '(?s)\\A```[A-Za-z]*\\n(.*)\\n?```\\z', '\\1') AS u FROM t)
        SELECT response_id, {_trimmed('u')} AS text FROM u""",
    "clean_source_name": f"""WITH n AS (SELECT ingest_id, {_trimmed("regexp_extract(replace(coalesce(source_name, ''), chr(92), '/'), '([^/]*)/*$', 1)")} AS n FROM (SELECT DISTINCT ON (ingest_id) * FROM ingest_requests))
        SELECT ingest_id, substr(regexp_replace(CASE WHEN n = '' THEN 'document' ELSE n END, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}<>"|?*]', '', 'g'), 1, 200) AS name FROM n""",
    "ocr_cache": "SELECT DISTINCT section_id AS page_id FROM sections WHERE ocr AND text NOT IN (SELECT text FROM sections WHERE ocr AND section_id % 2 = 0)",
    "khmer_words_only": f"""WITH l AS (SELECT section_id, regexp_replace(regexp_replace(nfc_normalize(text), '([ក-៓]):([ក-ឳ])', '\\1ៈ\\2', 'g'), '([ក-៓]):([ក-ឳ])', '\\1ៈ\\2', 'g') AS t FROM {_S}),
        w AS (SELECT section_id, list_transform(regexp_extract_all(t, '[ក-៝០-៩៰-៹᧠-᧿\\x{{200C}}\\x{{200D}}]+'), lambda x: regexp_replace(regexp_replace(x, '^[឴-៓៝\\x{{200C}}\\x{{200D}}]+', ''), '[\\x{{200C}}\\x{{200D}}]+$', '')) AS w FROM l),
        f AS (SELECT section_id, w, list_position(list_transform(w, lambda x: regexp_matches(x, '[ក-ឳ០-៩]')), true) AS first FROM w)
        SELECT section_id, coalesce(list_aggregate(list_filter(w, lambda x, i: regexp_matches(x, '[ក-ឳ០-៩]') OR (i > first AND regexp_matches(x, '^[។-៚]+$'))), 'string_agg', ' '), '') AS text FROM f""",
    "markdown_headings": """WITH l AS (SELECT ingest_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM (SELECT DISTINCT ON (ingest_id) * FROM ingest_requests)),
        f AS (SELECT *, sum(CAST(regexp_matches(line, '^\\s{0,3}(?:```|~~~)') AS INTEGER)) OVER (PARTITION BY ingest_id ORDER BY i) % 2 = 1 AS fenced FROM l)
        SELECT ingest_id, count(*) AS headings FROM f WHERE NOT fenced AND regexp_matches(line, '^\\s{0,3}#{1,6}\\s')
          AND regexp_matches(regexp_replace(regexp_replace(line, '</?[A-Za-z][A-Za-z0-9-]*(?:\\s[^<>]*)?/?>', '', 'g'), '^\\s*#+|#+\\s*$', '', 'g'), '[^\\s*_#:៖✧◆◇♦•▪■□☐✦❖–—-]') GROUP BY ingest_id""",
    "remove_running_lines": f"""WITH p AS (SELECT DISTINCT source, page, text FROM sections WHERE page IS NOT NULL AND text IS NOT NULL),
        l AS (SELECT source, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_trimmed('x')}), lambda x: x <> '') AS l FROM p),
        e AS (SELECT DISTINCT source, page, unnest(list_distinct(list_concat(l[1:2], l[-2:]))) AS line FROM l),
        n AS (SELECT source, count(DISTINCT page) AS "of" FROM p GROUP BY source HAVING count(DISTINCT page) >= 5),
        k AS (SELECT e.source, line FROM e JOIN n USING (source) GROUP BY e.source, line, n."of" HAVING count(*) >= 0.2 * n."of"),
        g AS (SELECT source, list(line) AS running FROM k GROUP BY source),
        j AS (SELECT section_id, text, running, string_split(text, chr(10)) AS l FROM {_S} LEFT JOIN g USING (source)),
        h AS (SELECT *, list_reverse(l[{_stripped('l')} + 1:]) AS r FROM j WHERE running IS NOT NULL)
        SELECT section_id, array_to_string(list_reverse(r[{_stripped('r')} + 1:]), chr(10)) AS text FROM h UNION ALL SELECT section_id, text FROM j WHERE running IS NULL""",
    "user_message": f"""WITH {_PASSAGES},
        e AS (SELECT response_id, n, '<passage id="' || n || '" source="' || replace(replace(replace(source, '&', '&amp;'), '"', '&quot;'), '<', '&lt;') || '"' || coalesce(' page="' || page || '"', '')
            || CASE WHEN coalesce(title, '') = '' THEN '' ELSE ' title="' || replace(replace(replace(title, '&', '&amp;'), '"', '&quot;'), '<', '&lt;') || '"' END
            || CASE WHEN coalesce(heading, '') = '' THEN '' ELSE ' section="' || replace(replace(replace(heading, '&', '&amp;'), '"', '&quot;'), '<', '&lt;') || '"' END
            || ' score="0.500">' || chr(10) || replace(replace(text, '</passage', '&lt;/passage'), '</context', '&lt;/context') || chr(10) || '</passage>' AS p FROM j),
        c AS (SELECT response_id, '<context>' || chr(10) || string_agg(p, chr(10) ORDER BY n) || chr(10) || '</context>' AS context FROM e GROUP BY response_id)
        SELECT r.response_id, concat_ws(chr(10) || chr(10), coalesce(context, '<context>' || chr(10) || '</context>'), CASE WHEN context IS NULL THEN '<note>{prompts.NO_CONTEXT}</note>' END,
            '<question>' || chr(10) || q.prompt || chr(10) || '</question>', '<response_language>' || r.language || '</response_language>') AS message
        FROM (SELECT DISTINCT ON (response_id) * FROM query_responses) r JOIN (SELECT DISTINCT ON (request_id) * FROM query_requests) q USING (request_id) LEFT JOIN c USING (response_id)""",
    "extractive_answer": f"""WITH {_PASSAGES},
        i AS (SELECT response_id, n, '**[' || n || '] ' || CASE WHEN coalesce(title, '') = '' THEN source ELSE title END
            || coalesce(', ' || CASE asked WHEN 'km' THEN '{prompts.ANSWER_TEXT["km"]["page"]}' ELSE 'page' END || ' ' || page, '') || '** (' || CASE asked WHEN 'km' THEN '{prompts.ANSWER_TEXT["km"]["score"]}' ELSE 'score' END || ' 0.50)'
            || chr(10) || chr(10) || text || chr(10) AS t FROM j),
        m AS (SELECT response_id, regexp_replace(string_agg(t, chr(10) ORDER BY n), '[{_BLANK}]+$', '') AS passages FROM i GROUP BY response_id)
        SELECT r.response_id, CASE WHEN passages IS NULL THEN CASE r.language WHEN 'km' THEN '{prompts.ANSWER_TEXT["km"]["empty"]}' ELSE '{prompts.ANSWER_TEXT["en"]["empty"]}' END
            ELSE CASE r.language WHEN 'km' THEN '{prompts.ANSWER_TEXT["km"]["header"]}' ELSE '{prompts.ANSWER_TEXT["en"]["header"]}' END || chr(10) || chr(10) || passages END AS answer
        FROM (SELECT DISTINCT ON (response_id) * FROM query_responses) r LEFT JOIN m USING (response_id)""",
    "running_lines": """WITH p AS (SELECT DISTINCT source, page, text FROM sections WHERE page IS NOT NULL AND text IS NOT NULL),
        l AS (SELECT source, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(160))), lambda x: x <> '') AS l FROM p),
        e AS (SELECT DISTINCT source, page, unnest(list_distinct(list_concat(l[1:2], l[-2:]))) AS line FROM l),
        n AS (SELECT source, count(DISTINCT page) AS "of" FROM p GROUP BY source HAVING count(DISTINCT page) >= 5)
        SELECT e.source, line, count(*) AS pages, n."of" FROM e JOIN n USING (source) GROUP BY e.source, line, n."of" HAVING count(*) >= 0.2 * n."of" """,
}
