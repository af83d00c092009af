"""Queries of text cleaning, structure and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import corpus, state
from lodestone.plans import sql as S
from lodestone.plans.base import ALL_LINES_SQL, all_lines, read, spread


def _docs(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents"))


def normalize_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("digest"))


def paragraph_fingerprints(spark, sf_dir):
    return all_lines(spark, sf_dir).groupBy(T.paragraph_fingerprint(F.col("line")).alias("fingerprint")).agg(F.count("*").alias("n"))


def boilerplate_signatures(spark, sf_dir):
    return all_lines(spark, sf_dir).groupBy(T.boilerplate_signature(F.col("line")).alias("signature")).agg(F.count("*").alias("n"))


def static_noise(spark, sf_dir):
    return all_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_static_noise(F.col("line"))).alias("n_noise"))


def table_blocks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.is_table_block(F.col("text")).alias("is_table"))


def normalized_tables(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_table(F.col("text"))).alias("digest"))


def edge_signatures(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.edge_signature(T.edges(T.page_lines(F.col("text")), 2)).alias("signature"))


def clean_pages(spark, sf_dir):
    """Each source is a paged document here, and each of its documents a page."""
    return corpus.clean_pages(_docs(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text"))[1]


def headings(spark, sf_dir):
    return all_lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(T.is_heading(F.col("line"))).alias("n_headings"))


def toc_entries(spark, sf_dir):
    rows = all_lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), "idx", F.concat("line", F.lit(" .... "), (F.col("idx") + 1).cast("string")).alias("line"))
    return corpus.toc_entries(rows)


def toc_sections(spark, sf_dir):
    lines = all_lines(spark, sf_dir)
    toc = lines.where("idx % 3 = 0").select(F.col("doc_id").alias("doc"), F.concat(F.lit("part "), F.col("idx").cast("string")).alias("title"), F.col("idx").alias("page"))
    return corpus.toc_sections(lines.select(F.col("doc_id").alias("doc"), F.col("idx").alias("page")), toc)


def sections(spark, sf_dir):
    blocks = all_lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("idx").alias("page"), F.col("line").alias("text"))
    return corpus.sections(blocks).select("doc", "section_no", "title", "n_paragraphs", "page_start", "page_end", F.md5("text").alias("digest"))


def word_windows(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("idx", "piece"))
    return rows.select("doc_id", "idx", F.size(T.words(F.col("piece"))).alias("n_words"), F.md5("piece").alias("digest"))


def chunk_hierarchy(spark, sf_dir):
    return corpus.chunks(_docs(spark, sf_dir)).select("chunk_id", "document_title", "chunk_level", "chunk_index", "section_title", "page_start", "page_end", "token_count", "parent_chunk_id", "metadata", F.md5("text").alias("digest"))


def language_tags(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(T.language_tag(F.col("text")).alias("tag")).agg(F.count("*").alias("n"))


def content_hashes(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def parse_cache(spark, sf_dir):
    """Parsed pages by content and parser: even documents are cached by an older run, then all are put."""
    docs = _docs(spark, sf_dir).select(F.sha2("text", 256).alias("file_hash"), F.lit("text-1").alias("parser"), "doc_id")
    old = docs.where("doc_id % 2 = 0").groupBy("file_hash", "parser").agg(F.min("doc_id").alias("first_doc"), F.lit(0).alias("generation"))
    new = docs.groupBy("file_hash", "parser").agg(F.min("doc_id").alias("first_doc"), F.lit(1).alias("generation"))
    return state.added(old, new, ["file_hash", "parser"])


def page_lines(spark, sf_dir):
    rows = T.page_lines(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(rows).alias("n_lines"), F.md5(F.array_join(rows, "\n")).alias("digest"))


_EDGE = f"""list_filter(list_transform(list_concat(rows_[1:2], rows_[greatest(len(rows_) - 1, 1) : len(rows_)]), lambda x: {S.signature("x")}), lambda x: x <> '')"""

QUERIES = {
    "t01_normalize_whitespace": (normalize_whitespace, f"SELECT doc_id, md5({S.nw('text')}) AS digest FROM documents"),
    "t02_paragraph_fingerprint": (paragraph_fingerprints, f"SELECT sha256({S.canonical('line')}) AS fingerprint, count(*) AS n FROM {ALL_LINES_SQL} GROUP BY 1"),
    "t03_boilerplate_signature": (boilerplate_signatures, f"SELECT {S.signature('line')} AS signature, count(*) AS n FROM {ALL_LINES_SQL} GROUP BY 1"),
    "t04_static_noise": (static_noise, f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({S.noise('line')}) AS n_noise FROM {ALL_LINES_SQL} GROUP BY doc_id"),
    "t05_table_block": (
        table_blocks,
        f"""SELECT doc_id, len(r) >= 2 AND len(list_filter(r, lambda x: regexp_matches(x, '\\S\\s{{2,}}\\S'))) >= greatest(2, len(r) // 2)
        AND len(list_filter(r, lambda x: regexp_matches(x, '[。！？.!?]'))) <= len(r) // 2 AS is_table FROM (SELECT doc_id, {S.trimmed_lines("text")} AS r FROM documents)""",
    ),
    "t06_normalize_table": (normalized_tables, f"SELECT doc_id, md5(array_to_string(list_transform({S.trimmed_lines('text')}, lambda x: {S.sub('x', r'\s{2,}', 'chr(9)')}), chr(10))) AS digest FROM documents"),
    "t07_edge_signature": (edge_signatures, f"SELECT doc_id, array_to_string(({_EDGE})[1:4], ' | ') AS signature FROM (SELECT doc_id, {S.page_lines('text')} AS rows_ FROM documents)"),
    "t08_clean_pages": (
        clean_pages,
        f"""WITH pages AS (SELECT source AS doc, doc_id AS page, {S.page_lines("text")} AS rows_ FROM documents),
        sig AS (SELECT *, array_to_string(({_EDGE})[1:4], ' | ') AS edge,
          array_to_string((list_filter(list_transform(rows_[1:2], lambda x: {S.signature("x")}), lambda x: x <> ''))[1:4], ' | ') AS first_,
          array_to_string((list_filter(list_transform(rows_[greatest(len(rows_) - 1, 1) : len(rows_)], lambda x: {S.signature("x")}), lambda x: x <> ''))[1:4], ' | ') AS last_,
          list_transform(list_filter(list_concat(rows_[1:3], rows_[greatest(len(rows_) - 2, 1) : len(rows_)]), lambda x: {S.noise("x")}), lambda x: {S.signature("x")}) AS noise_ FROM pages),
        counts AS (SELECT doc, signature, count(*) AS n FROM (SELECT doc, unnest(list_concat([first_, last_], noise_)) AS signature FROM sig) WHERE signature <> '' GROUP BY ALL),
        sizes AS (SELECT doc, count(*) AS page_count FROM pages GROUP BY doc),
        rep AS (SELECT doc, signature FROM counts JOIN sizes USING (doc) WHERE n >= greatest(2, round_even(page_count * 0.4, 0))),
        each_ AS (SELECT doc, page, edge, len(rows_) AS n, unnest(rows_) AS line, unnest(range(len(rows_))) AS idx FROM sig),
        judged AS (SELECT doc, page, ({S.signature("line")} = '' OR {S.noise("line")} OR ((idx < 3 OR idx >= greatest(0, n - 3))
          AND (EXISTS (SELECT 1 FROM rep r WHERE r.doc = e.doc AND r.signature = {S.signature("e.line")}) OR EXISTS (SELECT 1 FROM rep r WHERE r.doc = e.doc AND r.signature = e.edge)))) AS gone FROM each_ e)
        SELECT s.doc, page_count, coalesce(c, 0) AS clean_page_count, coalesce(g, 0) AS removed_noise_lines, page_count - coalesce(c, 0) AS removed_noise_pages, coalesce(r, 0) AS repeated_noise_signatures
        FROM sizes s LEFT JOIN (SELECT doc, count(DISTINCT page) FILTER (NOT gone) AS c, count(*) FILTER (gone) AS g FROM judged GROUP BY doc) USING (doc)
        LEFT JOIN (SELECT doc, count(*) AS r FROM rep GROUP BY doc) USING (doc)""",
    ),
    "t09_headings": (headings, f"SELECT doc_id, count(*) FILTER ({S.heading('line')}) AS n_headings FROM {ALL_LINES_SQL} GROUP BY doc_id"),
    "t10_toc_entries": (
        toc_entries,
        f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS idx FROM documents),
        t AS (SELECT doc_id AS doc, idx, {S.nw("line || ' .... ' || (idx + 1)")} AS x FROM l),
        u AS (SELECT doc, idx, x AS raw, {S.strip(S.sub(S.sub("x", r"\.{2,}", "' '"), r"\s{2,}", "' '"))} AS y FROM t),
        p AS (SELECT doc, idx, {S.nw("regexp_extract(y, '^(.+?)\\s+(\\d{1,4})$', 1)")} AS title, TRY_CAST(regexp_extract(y, '^(.+?)\\s+(\\d{{1,4}})$', 2) AS INTEGER) AS page
          FROM u WHERE NOT regexp_matches(raw, '[。！？!?]') AND length(raw) <= 160)
        SELECT doc, title, page FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY idx) AS nth FROM p WHERE title <> '' AND NOT regexp_matches(title, '^\\d+$') AND page > 0) WHERE nth = 1""",
    ),
    "t11_toc_sections": (
        toc_sections,
        """SELECT doc_id AS doc, CAST(idx AS INTEGER) AS page, 'part ' || (idx - idx % 3) AS title FROM
        (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS idx FROM documents)""",
    ),
    "t11_sections": (
        sections,
        f"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS page FROM documents),
        r AS (SELECT doc, page, {S.heading("line")} AS h, {S.nw("line")} AS t FROM l WHERE {S.strip("line")} <> ''),
        n AS (SELECT *, sum(CAST(h AS BIGINT)) OVER (PARTITION BY doc ORDER BY page) AS section_no, min(page) OVER (PARTITION BY doc) AS doc_page FROM r),
        d AS (SELECT *, row_number() OVER (PARTITION BY doc, sha256({S.canonical("t")}) ORDER BY page) AS nth FROM n WHERE NOT h AND t <> ''),
        g AS (SELECT doc, section_no, any_value(doc_page) AS doc_page, count(*) AS n_paragraphs, max(page) AS page_end, md5(string_agg(t, chr(10) || chr(10) ORDER BY page)) AS digest FROM d WHERE nth = 1 GROUP BY doc, section_no)
        SELECT g.doc, CAST(g.section_no AS BIGINT) AS section_no, coalesce(n.t, 'Overview') AS title, n_paragraphs, CAST(coalesce(n.page, doc_page) AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end, digest
        FROM g LEFT JOIN n ON n.doc = g.doc AND n.section_no = g.section_no AND n.h""".replace("n.page, doc_page", "n.page, g.doc_page"),
    ),
    "t12_word_windows": (
        word_windows,
        f"WITH {S.CHUNKS} SELECT doc_id, CAST(chunk_index - 1 AS INTEGER) AS idx, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS n_words, md5(text) AS digest FROM chunks WHERE chunk_index > 0",
    ),
    "t13_chunk_hierarchy": (
        chunk_hierarchy,
        f"WITH {S.CHUNKS} SELECT chunk_id, document_title, chunk_level, chunk_index, section_title, page_start, page_end, CAST(greatest(1, len(regexp_extract_all(text, '\\S+'))) AS INTEGER) AS token_count, parent_chunk_id, metadata, md5(text) AS digest FROM chunks",
    ),
    "t14_language_tag": (language_tags, "SELECT CASE WHEN regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[一-鿿]') THEN 'en' ELSE 'zh' END AS tag, count(*) AS n FROM documents GROUP BY 1"),
    "t15_content_hash": (content_hashes, "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1"),
    "t16_parse_cache": (
        parse_cache,
        """WITH d AS (SELECT sha256(text) AS file_hash, 'text-1' AS parser, doc_id FROM documents),
        old AS (SELECT file_hash, parser, min(doc_id) AS first_doc, 0 AS generation FROM d WHERE doc_id % 2 = 0 GROUP BY ALL)
        SELECT * FROM old UNION ALL SELECT file_hash, parser, min(doc_id), 1 FROM d WHERE file_hash NOT IN (SELECT file_hash FROM old) GROUP BY file_hash, parser""",
    ),
    "t17_page_lines": (page_lines, f"SELECT doc_id, CAST(len(r) AS INTEGER) AS n_lines, md5(array_to_string(r, chr(10))) AS digest FROM (SELECT doc_id, {S.page_lines('text')} AS r FROM documents)"),
}
