"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import corpus
from lodestone.plans import sql as S
from lodestone.plans.base import chunks, questions, read
from lodestone.sources import readers, shared, tables


def artifacts(spark, sf_dir):
    rows = readers.artifacts(read(spark, sf_dir, "pages"))
    return rows.select("page_id", "artifact_type", "source_url", readers.artifact_name(F.col("source_url"), F.lit("item.html")).alias("name"), readers.host_of(F.col("source_url")).alias("host"))


def page_links(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    rows = pages.select("page_id", "url", F.posexplode(T.links(F.col("html"))).alias("place", "link"))
    return rows.select("page_id", "place", readers.absolute(F.col("url"), F.col("link")).alias("target"), F.contains(F.lower("link"), F.lit(".pdf")).alias("is_pdf"))


def slugs(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


def _site(spark, sf_dir):
    """Links and seeds: each host's first page is a seed, and leads to all pages of the host."""
    pages = read(spark, sf_dir, "pages")
    host = readers.host_of(F.col("url"))
    seeds = pages.groupBy(host.alias("host")).agg(F.min("url").alias("url"))
    links = pages.select("url", F.explode(T.links(F.col("html"))).alias("link")).select("url", readers.absolute(F.col("url"), F.col("link")).alias("target"))
    by_host = pages.select(host.alias("host"), "url").join(seeds.select("host", F.col("url").alias("seed")), "host").select(F.col("seed").alias("url"), F.col("url").alias("target"))
    return links.unionByName(by_host), seeds


def crawl(spark, sf_dir):
    links, seeds = _site(spark, sf_dir)
    return readers.crawl(links, seeds, depth=2, most=1_000_000)


def crawl_limited(spark, sf_dir):
    """Three pages of each host are visited."""
    links, seeds = _site(spark, sf_dir)
    return readers.crawl(links, seeds, depth=2, most=3)


def discovered(spark, sf_dir):
    links, seeds = _site(spark, sf_dir)
    return readers.discovered(links, seeds, depth=2, most=1_000_000)


def sitemap(spark, sf_dir):
    """Each page is named in a sitemap of its own here, and once more with a query."""
    loc = lambda *x: F.concat(F.lit("<url><loc> "), *x, F.lit("</loc></url>\n"))
    files = read(spark, sf_dir, "pages").select("url", F.concat(F.lit("<urlset>"), loc(F.col("url")), loc(F.col("url"), F.lit("?a=1&amp;b=2")), F.lit("<loc></loc></urlset>")).alias("xml"))
    return readers.sitemap_links(files)


def manifest(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").cast("string").alias("source_id"), readers.host_of(F.col("url")).alias("title"), F.col("url").alias("source_url"), F.lit("html").alias("artifact_type"), F.sha2("html", 256).alias("sha256"))
    return readers.read_json_lines(spark, readers.write_json_lines(rows, shared.shared_folder(spark)))


def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("digest"), F.char_length(T.html_text(F.col("html"))).alias("n_chars"))


def html_text_parsed(spark, sf_dir):
    return read(spark, sf_dir, "pages").withColumn("text", readers.parsed_text(F.col("html"))).select("page_id", F.md5("text").alias("digest"), F.char_length("text").alias("n_chars"))


def text_pages(spark, sf_dir):
    """A document's paragraphs are parted by form feeds here."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))
    return readers.text_pages(docs).select("doc_id", "page", F.char_length("page_text").alias("n_chars"))


def parse_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    chars, pages = F.char_length(F.regexp_replace("text", r"\s+", "")), F.size(T.lines(F.col("text")))
    judged = corpus.parse_quality(chars, pages, F.octet_length("text") * 40)
    return docs.select("doc_id", *(c.alias(name) for name, c in judged.items()))


def _marked():
    """Every fifth line of a document is a heading here."""
    return F.array_join(F.transform(T.lines(F.col("text")), lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("## "), x)).otherwise(x)), "\n")


def markdown_sections(spark, sf_dir):
    rows = corpus.markdown_sections(read(spark, sf_dir, "documents").select("doc_id", _marked().alias("text")))
    return rows.select("doc_id", "section_no", "title", F.md5("text").alias("digest"))


def seeded(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("/raw/"), "source", F.lit("_"), F.format_string("%08d", "doc_id"), F.lit(".md")).alias("path"), _marked().alias("text"))
    documents, parts = corpus.seeded(files)
    return parts.join(documents, "document_key").select("title", "chunk_index", "section_title", "char_end", F.md5("text").alias("digest"))


def corpus_scan(spark, sf_dir):
    """Chunks with their version and document, in the order of title, version and index."""
    rows = chunks(spark, sf_dir)
    versions = rows.select("doc_id").distinct().withColumn("version_no", F.lit(1))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    out = rows.join(versions, "doc_id").join(docs, "doc_id").where("coalesce(text, '') <> ''")
    return out.orderBy(F.col("document_title").asc_nulls_last(), "version_no", "chunk_index", "chunk_id").select("chunk_id", "document_title", "version_no", "source", "lang", "chunk_level")


def golden_set(spark, sf_dir):
    """Cases written as one JSON document and read again."""
    asked = questions(spark, sf_dir)
    case = F.struct(F.col("q_id").cast("string").alias("id"), "question", F.concat(F.lit("src"), (F.col("q_id") % 20).cast("string")).alias("gold_doc"), F.array(F.lit(1), F.lit(5)).alias("gold_page_range"), F.slice(T.words(F.col("question")), 1, 2).alias("expected_keywords"), F.lit("en").alias("language"), F.lit(True).alias("verified"))
    path = f"{shared.shared_folder(spark)}/golden-{shared.unique()}"
    asked.agg(F.to_json(F.struct(F.sort_array(F.collect_list(case)).alias("cases"))).alias("value")).coalesce(1).write.text(path)
    rows = readers.read_cases(spark, path)
    return rows.select("id", "question", "gold_doc", F.element_at("gold_page_range", 2).alias("last_page"), F.array_join("expected_keywords", ",").alias("keywords"), "language", "verified")


def ingest_versions(spark, sf_dir):
    """Documents of a source are contents of one file here; the even ones were ingested before."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("document_key"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("seq"))
    none = docs.limit(0).select("document_key", "content_hash", F.lit(0).cast("long").alias("version_no"))
    old = corpus.ingest_versions(none, docs.where("seq % 2 = 0"))
    return corpus.ingest_versions(old, docs)


def ingested(spark, sf_dir):
    """What documents of a source leave after the even ones, and then all, came in."""
    docs = read(spark, sf_dir, "documents")
    files = docs.select(F.col("source").alias("document_key"), F.md5("text").alias("file_hash"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("seq"), "doc_id", "text", "lang", "source")
    cut = lambda rows: corpus.chunks(rows).join(rows.select("doc_id", "document_key"), "doc_id").select("document_key", "chunk_id")
    tables = [files.limit(0).select(*columns) for columns in (("document_key", "file_hash", "seq"), ("document_key", "content_hash", "seq", F.lit(0).cast("long").alias("version_no")), ("document_key", F.lit("").alias("chunk_id")))]
    first = [shared.kept(t) for t in corpus.ingested(*tables, files.where("doc_id % 2 = 0"), cut)]
    documents, versions, parts = corpus.ingested(*first, files, cut)
    counts = parts.groupBy("document_key").agg(F.count("*").alias("n_chunks"), F.max("chunk_id").alias("last_chunk"))
    return documents.select("document_key", "seq").join(versions.groupBy("document_key").agg(F.max("version_no").alias("n_versions")), "document_key").join(counts, "document_key")


def made_tables(spark, sf_dir):
    """The engine's tables as they are made; chunks lack a column at first."""
    folder = f"{shared.shared_folder(spark)}/tables-{shared.unique()}"
    spark.createDataFrame([("a-1", "text")], "chunk_id string, text string").write.parquet(f"{folder}/chunks")
    tables.bootstrap(spark, folder)
    parts = [(name, tables.opened(spark, folder, name, chunk_level="paragraph")) for name in tables.TABLES]
    rows = [t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), F.lit(len(t.columns)).alias("n_columns"), "n_rows") for name, t in parts]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


_INGEST = """SELECT document_key, content_hash, seq, CAST(row_number() OVER (PARTITION BY document_key ORDER BY seq) AS BIGINT) AS version_no
  FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY seq, document_key) AS nth FROM {0}) WHERE nth = 1"""

_ABS = """CASE WHEN regexp_matches({1}, '^[a-zA-Z]+:') THEN {1} WHEN starts_with({1}, '/') THEN regexp_extract({0}, '^([a-zA-Z]+://[^/?#]+)', 1) || {1}
  ELSE regexp_replace(regexp_extract({0}, '^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/)?)', 1), '/$', '') || '/' || {1} END"""
_HOST = "lower(regexp_extract({0}, '^[a-zA-Z]+://([^/?#]+)', 1))"
#: Distinct links in the order of their first place.
_LINKS = """(SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY first_) - 1 AS place FROM
  (SELECT page_id, url, link, min(at_) AS first_ FROM (SELECT page_id, url, unnest(ls) AS link, unnest(range(len(ls))) AS at_ FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a[^>]+href="([^"]+)"', 1) AS ls FROM pages)) GROUP BY ALL))"""
_NAME = "regexp_extract(regexp_replace({0}, '[?#].*$', ''), '^[a-zA-Z]+://[^/]+/(?:.*/)?([^/]+)/?$', 1)"


def _html_sql() -> str:
    x = S.sub(S.sub("html", r"(?is)<!--.*?-->|<!doctype[^>]*>", "''"), "(?i)</?(" + "|".join(T.V.BLOCK_TAGS) + r")(\s[^>]*)?/?>", "chr(10)")
    x = S.sub(x, "<[^>]+>", "' '")
    for name, shown in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {S.q(name)}, {S.q(shown)})"
    return S.nw(S.sub(S.sub(x, r"[ \t]{2,}", "' '"), r"\n{3,}", "chr(10) || chr(10)"))


_CRAWLED = f"""seeds AS (SELECT {_HOST.format("url")} AS host, min(url) AS url FROM pages GROUP BY 1),
        link AS (SELECT url, {_ABS.format("url", "link")} AS target FROM {_LINKS} UNION SELECT s.url, p.url FROM pages p JOIN seeds s ON {_HOST.format("p.url")} = s.host),
        same AS (SELECT * FROM link WHERE {_HOST.format("url")} = {_HOST.format("target")}{{0}}),
        first_ AS (SELECT DISTINCT target AS url FROM same WHERE url IN (SELECT url FROM seeds) AND target NOT IN (SELECT url FROM seeds)),
        two AS (SELECT DISTINCT target AS url FROM same WHERE url IN (SELECT url FROM first_) AND target NOT IN (SELECT url FROM seeds) AND target NOT IN (SELECT url FROM first_)),
        every AS (SELECT url, 0 AS depth FROM seeds UNION ALL SELECT url, 1 FROM first_ UNION ALL SELECT url, 2 FROM two)"""

def _parsed_sql() -> str:
    """A parser's text from its pieces: scripts and styles whole, comments and declarations, tags, and texts."""
    pieces = "regexp_extract_all(html, '(?is)<(?:script|style)\\b[^>]*>.*?</(?:script|style)\\s*>|<!--.*?-->|<![^>]*>|</?[a-z][^>]*>|[^<]+')"
    block = S.q("(?i)^</?(" + "|".join(T.V.BLOCK_TAGS) + r")(\s[^>]*)?/?>$")
    inside = S.strip("regexp_replace(regexp_replace(x, '^<[^>]*>', ''), '(?i)</(script|style)\\s*>$', '')")
    told = "x"
    for name, shown in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        told = f"replace({told}, {S.q(name)}, {S.q(shown)})"
    spaced = lambda y: f"CASE WHEN {y} = '' THEN '' ELSE {y} || ' ' END"
    one = f"""CASE WHEN regexp_matches(x, '(?i)^<(script|style)\\b') THEN {spaced(inside)} WHEN starts_with(x, '<!') THEN ''
      WHEN regexp_matches(x, {block}) THEN CASE WHEN ends_with(x, '/>') THEN chr(10) || chr(10) ELSE chr(10) END WHEN starts_with(x, '<') THEN '' ELSE {spaced(S.strip(told))} END"""
    return S.nw(f"array_to_string(list_transform({pieces}, lambda x: {one}), '')")


QUERIES = {
    "s01_artifacts": (
        artifacts,
        f"""SELECT page_id, artifact_type, source_url, CASE WHEN {_NAME.format("source_url")} = '' THEN 'item.html' ELSE {_NAME.format("source_url")} END AS name, {_HOST.format("source_url")} AS host FROM (
        SELECT page_id, 'html' AS artifact_type, url AS source_url FROM pages
        UNION ALL SELECT DISTINCT page_id, 'pdf', {_ABS.format("url", "link")} FROM {_LINKS} WHERE contains(lower(link), '.pdf'))""",
    ),
    "s02_page_links": (page_links, f"SELECT page_id, CAST(place AS INTEGER) AS place, {_ABS.format('url', 'link')} AS target, contains(lower(link), '.pdf') AS is_pdf FROM {_LINKS}"),
    "s03_slugs": (slugs, "SELECT page_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM pages)"),
    "s04_crawl": (
        crawl,
        f"""WITH seeds AS (SELECT {_HOST.format("url")} AS host, min(url) AS url FROM pages GROUP BY 1),
        one AS (SELECT DISTINCT p.url FROM pages p JOIN seeds s ON {_HOST.format("p.url")} = s.host UNION SELECT {_ABS.format("url", "link")} FROM {_LINKS} WHERE url IN (SELECT url FROM seeds)),
        first_ AS (SELECT url FROM one WHERE url NOT IN (SELECT url FROM seeds)),
        two AS (SELECT DISTINCT {_ABS.format("url", "link")} AS url FROM {_LINKS} WHERE url IN (SELECT url FROM first_))
        SELECT url, 0 AS depth FROM seeds UNION ALL SELECT url, 1 FROM first_ UNION ALL
        SELECT url, 2 FROM two WHERE url NOT IN (SELECT url FROM seeds) AND url NOT IN (SELECT url FROM first_)""",
    ),
    "s04_crawl_limited": (crawl_limited, f"WITH {_CRAWLED.format('')} SELECT url, depth FROM (SELECT *, row_number() OVER (PARTITION BY {_HOST.format('url')} ORDER BY depth, url) AS nth FROM every) WHERE nth <= 3"),
    "s04_discovered": (
        discovered,
        f"""WITH {_CRAWLED.format(" AND NOT regexp_matches(lower(target), '\\.pdf([?#]|$)')")} SELECT target AS pdf_url, arg_min(url, depth || ' ' || url) AS discovered_from
        FROM link JOIN every USING (url) WHERE depth < 2 AND regexp_matches(lower(target), '\\.pdf([?#]|$)') GROUP BY target""",
    ),
    "s04_sitemap": (sitemap, "SELECT url, 0 AS place, url AS target FROM pages UNION ALL SELECT url, 1, url || '?a=1&b=2' FROM pages"),
    "s05_manifest": (manifest, f"SELECT CAST(page_id AS VARCHAR) AS source_id, {_HOST.format('url')} AS title, url AS source_url, 'html' AS artifact_type, sha256(html) AS sha256 FROM pages"),
    "s06_html_text": (html_text, f"SELECT page_id, md5({_html_sql()}) AS digest, CAST(length({_html_sql()}) AS INTEGER) AS n_chars FROM pages"),
    "s06_html_text_parsed": (html_text_parsed, f"SELECT page_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT page_id, {_parsed_sql()} AS t FROM pages)"),
    "s07_text_pages": (text_pages, "SELECT doc_id, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS page, CAST(length(unnest(p)) AS INTEGER) AS n_chars FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)"),
    "s09_parse_quality": (
        parse_quality,
        """SELECT doc_id, CASE WHEN chars >= least_ THEN 'text_sufficient' ELSE 'text_fallback' END AS route, floor(quality * 10000 + 0.5e0) / 10000e0 AS quality_score, CASE WHEN chars >= least_ THEN quality < 0.15 ELSE TRUE END AS needs_review
        FROM (SELECT *, greatest(600, CAST(floor(0.4e0 * greatest(1, size // 1024)) AS INTEGER)) AS least_, least(1e0, chars / pages / 1200e0) AS quality FROM
        (SELECT doc_id, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS DOUBLE) AS chars, greatest(1, len(string_split(text, chr(10)))) AS pages, strlen(text) * 40 AS size FROM documents))""",
    ),
    "s10_markdown_sections": (
        markdown_sections,
        f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS idx FROM documents),
        m AS (SELECT doc_id, idx, CASE WHEN idx % 5 = 2 THEN '## ' || raw ELSE raw END AS line FROM l),
        n AS (SELECT *, starts_with(line, '#') AS h, sum(CAST(starts_with(line, '#') AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY idx) AS section_no FROM m),
        g AS (SELECT doc_id, section_no, max(CASE WHEN h THEN coalesce(nullif({S.strip("regexp_replace(line, '^#+', '')")}, ''), 'Overview') END) AS title, coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY idx), '') AS body FROM n GROUP BY ALL)
        SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, coalesce(title, 'Overview') AS title, md5({S.nw("body")}) AS digest FROM g WHERE {S.nw("body")} <> ''""",
    ),
    "s11_corpus_scan": (corpus_scan, f"WITH {S.CHUNKS} SELECT chunk_id, document_title, 1 AS version_no, d.source, d.lang, chunk_level FROM chunks c JOIN documents d USING (doc_id)"),
    "s12_golden_set": (
        golden_set,
        "SELECT CAST(item_id AS VARCHAR) AS id, text AS question, 'src' || (item_id % 20) AS gold_doc, 5 AS last_page, array_to_string(regexp_extract_all(text, '\\S+')[1:2], ',') AS keywords, 'en' AS language, TRUE AS verified FROM benchmark",
    ),
    "s13_ingested": (
        ingested,
        f"""WITH {S.CHUNKS}, d AS (SELECT source AS document_key, sha256(text) AS content_hash, doc_id AS seq FROM documents),
        even_ AS (SELECT * FROM d WHERE seq % 2 = 0), old AS ({_INGEST.format("even_")}),
        rest AS (SELECT * FROM d WHERE content_hash NOT IN (SELECT content_hash FROM old)), new_ AS ({_INGEST.format("rest")}),
        v AS (SELECT document_key, count(*) AS n_versions FROM (SELECT document_key FROM old UNION ALL SELECT document_key FROM new_) GROUP BY 1),
        l AS (SELECT document_key, coalesce(max(n.seq), max(o.seq)) AS newest FROM old o FULL JOIN new_ n USING (document_key) GROUP BY 1),
        c AS (SELECT doc_id AS newest, count(*) AS n_chunks, max(chunk_id) AS last_chunk FROM chunks GROUP BY 1)
        SELECT document_key, s.seq, n_versions, n_chunks, last_chunk FROM (SELECT document_key, max(seq) AS seq FROM d GROUP BY 1) s JOIN v USING (document_key) JOIN l USING (document_key) JOIN c USING (newest)""",
    ),
    "s14_seeded": (
        seeded,
        f"""WITH f AS (SELECT min('/raw/' || source || '_' || printf('%08d', doc_id) || '.md') AS path, min(doc_id) AS doc_id, text FROM documents GROUP BY text),
        l AS (SELECT path, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS idx FROM f),
        m AS (SELECT path, idx, CASE WHEN idx % 5 = 2 THEN '## ' || raw ELSE raw END AS line FROM l),
        n AS (SELECT *, starts_with(line, '#') AS h, sum(CAST(starts_with(line, '#') AS BIGINT)) OVER (PARTITION BY path ORDER BY idx) AS section_no FROM m),
        g AS (SELECT path, section_no, max(CASE WHEN h THEN coalesce(nullif({S.strip("regexp_replace(line, '^#+', '')")}, ''), 'Overview') END) AS title, coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY idx), '') AS body FROM n GROUP BY ALL)
        SELECT replace(regexp_extract(path, '([^/]+)[.]md$', 1), '_', ' ') AS title, CAST(row_number() OVER (PARTITION BY path ORDER BY section_no) - 1 AS INTEGER) AS chunk_index, coalesce(title, 'Overview') AS section_title,
          CAST(length({S.nw("body")}) AS INTEGER) AS char_end, md5({S.nw("body")}) AS digest FROM g WHERE {S.nw("body")} <> ''""",
    ),
    "s15_tables": (made_tables, " UNION ALL ".join(f"SELECT '{name}' AS name, {len(schema.split(', '))} AS n_columns, CAST({int(name == 'chunks')} AS BIGINT) AS n_rows" for name, schema in tables.TABLES.items())),
    "s13_ingest_versions": (
        ingest_versions,
        f"""WITH d AS (SELECT source AS document_key, sha256(text) AS content_hash, doc_id AS seq FROM documents),
        even_ AS (SELECT * FROM d WHERE seq % 2 = 0), old AS ({_INGEST.format("even_")}),
        rest AS (SELECT * FROM d WHERE content_hash NOT IN (SELECT content_hash FROM old)), new_ AS ({_INGEST.format("rest")})
        SELECT document_key, content_hash, seq, CAST(version_no + coalesce(h, 0) AS BIGINT) AS version_no FROM new_ LEFT JOIN (SELECT document_key, max(version_no) AS h FROM old GROUP BY 1) USING (document_key)""",
    ),
}
