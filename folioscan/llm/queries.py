"""Queries of the training-data operators by name, and SQL for those that SQL expresses."""

from __future__ import annotations

from folioscan.llm import canonical, defects, markup, mixing, neighbours, packing, scans, sentences, shared_spans, splitting

QUERIES = {
    "p1_found": neighbours.found,
    "p1_neighbours": neighbours.nearest,
    "p1_topk": neighbours.complete,
    "p2_found": sentences.found,
    "p3_found": defects.found,
    "p4_found": splitting.found,
    "p4_pieces": splitting.pieces,
    "p5_found": scans.found,
    "p5_text": scans.texts,
    "p6_found": canonical.found,
    "p6_canonical": canonical.normalised,
    "p6_classes": canonical.classed,
    "p7_found": markup.found,
    "p7_text": markup.texts,
    "p7_headings": markup.headings,
    "p8_found": packing.found,
    "p8_containers": packing.containers,
    "p8_totals": packing.totals,
    "p9_found": mixing.found,
    "p9_report": mixing.report,
    "p9_limits": mixing.limits,
    "p9_documents": mixing.documents,
    "p10_found": shared_spans.found,
    "p10_shared": shared_spans.shared,
}

SQL = {
    "p1_found": """
        WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM chunk_vectors
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id
                   WHERE list_cosine_similarity(a.e, b.e) >= 0.85),
             r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s)
        SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE k <= 5""",
    "p1_topk": """
        WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, CAST(embedding AS DOUBLE[]) AS e FROM chunk_vectors
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             s AS (SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
        SELECT vec_id, neighbour, round(s, 6) AS similarity, CAST(k AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) AS k FROM s) WHERE k <= 5""",
    "p4_found": """
        WITH i AS (SELECT 'section' AS item_kind, CAST(section_id AS VARCHAR) AS item_key, length(replace(text, chr(8203), '')) AS size FROM sections
                   UNION ALL
                   SELECT 'chunk', CAST(rec_id AS VARCHAR), length(replace(text, chr(8203), '')) + coalesce(list_sum(list_transform(
                          regexp_extract_all(text, '⟦MATH_[0-9a-f]{32}⟧'), lambda m: coalesce(length(element_at(vault, m)[1]) - 39, 0))), 0) FROM chunks)
        SELECT DISTINCT item_kind, item_key FROM i JOIN size_limits USING (item_kind) WHERE size > max_size""",
    "p8_found": """
        SELECT DISTINCT doc_id FROM documents
        WHERE strlen(coalesce(text, '')) + 1 > (SELECT max(max_size) FROM size_limits WHERE item_kind = 'document')""",
    "p9_found": """
        WITH d AS (SELECT doc_id, min(source) AS source, max(strlen(coalesce(text, '')) + 1) AS size FROM documents GROUP BY doc_id),
             s AS (SELECT source, sum(size) AS size FROM d GROUP BY source)
        SELECT t.source FROM mix_targets t LEFT JOIN s USING (source)
        WHERE coalesce(s.size, 0) * t.max_repeats < t.target_share * (SELECT sum(size) FROM d)""",
    "p8_totals": """
        WITH d AS (SELECT doc_id, max(strlen(coalesce(text, '')) + 1) AS size FROM documents GROUP BY doc_id), c AS (SELECT max(max_size) AS cap FROM size_limits WHERE item_kind = 'document')
        SELECT count(*) AS documents, CAST(sum((size + cap - 1) // cap) AS BIGINT) AS pieces, CAST(sum(size) AS BIGINT) AS tokens, count(*) FILTER (size > cap) AS divided, CAST(0 AS BIGINT) AS overfull FROM d, c""",
    "p9_limits": """
        WITH d AS (SELECT doc_id, min(source) AS source, max(strlen(coalesce(text, '')) + 1) AS size FROM documents GROUP BY doc_id),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source)
        SELECT t.source, coalesce(s.size, 0) AS source_size, coalesce(s.size, 0) * t.max_repeats AS limit_size, coalesce(s.size, 0) * t.max_repeats < t.target_share * (SELECT sum(size) FROM d) AS limited
        FROM mix_targets t LEFT JOIN s USING (source)""",
    "p10_shared": """
        WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL),
             c AS (SELECT text, count(DISTINCT doc_id) AS copies FROM d WHERE text IS NOT NULL GROUP BY text),
             w AS (SELECT doc_id, p, substr(text, CAST(p AS BIGINT), 120) AS run FROM (SELECT doc_id, text, unnest(range(1, length(text) - 118)) AS p FROM d WHERE length(text) >= 120)),
             s AS (SELECT run FROM w GROUP BY run HAVING min(doc_id) <> max(doc_id)),
             m AS (SELECT doc_id, lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p AS step FROM w SEMI JOIN s USING (run)),
             g AS (SELECT doc_id, sum(least(coalesce(step, 120), 120)) AS n, count(*) FILTER (coalesce(step > 120, true)) AS spans FROM m GROUP BY doc_id)
        SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, CAST(coalesce(g.n, 0) AS BIGINT) AS shared_chars, coalesce(g.spans, 0) AS shared_spans, coalesce(c.copies, 1) AS copies
        FROM d LEFT JOIN g USING (doc_id) LEFT JOIN c USING (text)""",
    "p10_found": """
        WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 120),
             w AS (SELECT doc_id, substr(text, CAST(p AS BIGINT), 120) AS run FROM (SELECT doc_id, text, unnest(range(1, length(text) - 118)) AS p FROM d))
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.run = b.run AND a.doc_id < b.doc_id""",
}
