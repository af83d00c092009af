"""The corpus: cleaned pages, sections, and chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def numbered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-blank lines: key, page_count ignored; idx from 0 and the line."""
    return docs.select(key, F.posexplode(T.page_lines(F.col(text))).alias("idx", "line"))


def clean_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (doc, page, text) without noise: kept lines (doc, page, idx, line) and statistics by doc.

    A signature is noise if it stands at the edges of at least two pages and 40 in 100; lines of
    static noise, without a signature, and edge lines with a noise signature go. Counts are
    pre-aggregated, so a document of very many pages isn't gathered. Signatures meet by their hashes, and
    pages are judged by their few edge lines: no line is shuffled for the statistics. A document has at
    most 24 noise signatures, as a page gives eight at most.
    """
    rows = pages.select("doc", "page", T.page_lines(F.col("text")).alias("lines")).withColumn("n", F.size("lines"))
    first_two, last_two = F.slice("lines", 1, 2), F.slice("lines", F.greatest(F.col("n") - 1, F.lit(1)), 2)
    noise = F.transform(F.filter(T.edges(F.col("lines"), 3), T.is_static_noise), T.boilerplate_signature)
    candidates = F.concat(F.array(T.edge_signature(first_two), T.edge_signature(last_two)), noise)
    hashes = F.transform(F.filter(candidates, lambda x: x != ""), F.md5)
    counts = rows.select("doc", F.explode(hashes).alias("signature")).groupBy("doc", "signature").count()
    sizes = rows.groupBy("doc").agg(F.count("*").alias("page_count"))
    repeated = counts.join(sizes, "doc").where(F.col("count") >= F.greatest(F.lit(2), F.bround(F.col("page_count") * 0.4)))
    repeated = repeated.groupBy("doc").agg(F.collect_list("signature").alias("noise"))

    def mark(line: Column) -> Column:
        found = F.transform(F.array(T.boilerplate_signature(line)), lambda x: F.struct(((x == "") | T.is_static_noise(line)).alias("gone"), F.md5(x).alias("signature")))
        return F.get(found, 0)

    known = lambda x: F.coalesce(F.array_contains("noise", x), F.lit(False))
    whole = F.md5(T.edge_signature(T.edges(F.col("lines"), 2)))
    ends = F.when(F.col("n") <= 6, F.col("lines")).otherwise(T.edges(F.col("lines"), 3))
    middle = F.slice("lines", 4, F.greatest(F.col("n") - 6, F.lit(0)))
    inside = F.size(F.filter(middle, lambda x: (T.boilerplate_signature(x) == "") | T.is_static_noise(x)))
    judged = rows.where("n > 0").select("doc", "page", "n", F.transform(ends, mark).alias("ends"), whole.alias("whole"), inside.alias("inside")).join(repeated, "doc", "left")
    at_ends = F.size(F.filter("ends", lambda x: x["gone"] | known(x["signature"]) | known(F.col("whole"))))
    judged = judged.select("doc", "page", "n", (F.col("inside") + at_ends).alias("gone"))

    each = rows.withColumn("whole", whole).join(repeated, "doc", "left").select("doc", "page", "n", "whole", "noise", F.posexplode("lines").alias("idx", "line"))
    at_edge = (F.col("idx") < 3) | (F.col("idx") >= F.greatest(F.lit(0), F.col("n") - 3))
    each = each.withColumn("mark", mark(F.col("line"))).where(~(F.col("mark.gone") | (at_edge & (known(F.col("mark.signature")) | known(F.col("whole"))))))
    kept = each.select("doc", "page", "idx", "line")

    left = judged.where("n > gone").select("doc", "page").distinct().groupBy("doc").agg(F.count("*").alias("clean_page_count"))
    removed = judged.groupBy("doc").agg(F.sum("gone").alias("removed_noise_lines"))
    found = repeated.select("doc", F.size("noise").alias("repeated_noise_signatures"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    stats = sizes.join(left, "doc", "left").join(removed, "doc", "left").join(found, "doc", "left")
    stats = stats.select("doc", "page_count", zero("clean_page_count"), zero("removed_noise_lines"), (F.col("page_count") - F.coalesce("clean_page_count", F.lit(0))).alias("removed_noise_pages"), zero("repeated_noise_signatures"))
    return kept, stats


def toc_entries(lines: DataFrame) -> DataFrame:
    """The first title for each page number in a document's table-of-contents lines: doc, title, page."""
    found = lines.select("doc", "idx", T.toc_entry(F.col("line")).alias("entry")).where("entry is not null and entry.page > 0")
    first = Window.partitionBy("doc", "entry.page").orderBy("idx")
    return found.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("doc", "entry.title", "entry.page")


def toc_sections(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """Blocks (doc, page, ...) with the title whose pages hold theirs; "Overview" before the first."""
    order = Window.partitionBy("doc").orderBy("page")
    ranges = toc.select("doc", "title", F.col("page").alias("first"), (F.lead("page").over(order) - 1).alias("last"))
    spans = ranges.select("doc", "title", "first", F.when(F.col("last").isNotNull(), F.greatest("first", "last")).otherwise(2**31 - 1).alias("last"))
    joined = blocks.join(spans, (blocks["doc"] == spans["doc"]) & blocks["page"].between(spans["first"], spans["last"]), "left").drop(spans["doc"])
    best = joined.groupBy(*blocks.columns).agg(F.min_by("title", "first").alias("title"))
    return best.withColumn("title", F.coalesce("title", F.lit("Overview")))


def sections(blocks: DataFrame) -> DataFrame:
    """Sections by headings from blocks (doc, page, text): doc, section_no, title, n_paragraphs, page_start, page_end, text.

    A block that is a heading starts a section and isn't a paragraph itself. Of paragraphs with one
    fingerprint in a document the first counts; a section without paragraphs goes.
    """
    text = F.when(T.is_table_block(F.col("text")), T.normalize_table(F.col("text"))).otherwise(T.normalize_whitespace(F.col("text")))
    rows = blocks.where(T.strip(F.col("text")) != "").select("doc", "page", T.is_heading(F.col("text")).alias("heading"), T.normalize_whitespace(F.col("text")).alias("title"), text.alias("text"))
    order = Window.partitionBy("doc").orderBy("page")
    rows = rows.withColumn("section_no", F.sum(F.col("heading").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    heads = rows.where("heading").select("doc", "section_no", F.col("title").alias("head"), F.col("page").alias("head_page"))
    paragraphs = rows.where("not heading and text <> ''").withColumn("fingerprint", T.paragraph_fingerprint(F.col("text")))
    same = Window.partitionBy("doc", "fingerprint").orderBy("page")
    first = paragraphs.withColumn("nth", F.row_number().over(same)).where("nth = 1")
    grouped = first.groupBy("doc", "section_no").agg(F.count("*").alias("n_paragraphs"), F.min("page").alias("from_page"), F.max("page").alias("page_end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    begins = rows.groupBy("doc").agg(F.min("page").alias("doc_page"))
    joined = grouped.join(heads, ["doc", "section_no"], "left").join(begins, "doc")
    return joined.select("doc", "section_no", F.coalesce("head", F.lit("Overview")).alias("title"), "n_paragraphs", F.coalesce("head_page", "doc_page").alias("page_start"), "page_end", "text")


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections by lines that begin with "#": key, section_no, title, text; sections without text go."""
    rows = docs.select(key, F.posexplode(T.lines(F.col(text))).alias("idx", "line"))
    head = F.startswith("line", F.lit("#"))
    order = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section_no", F.sum(head.cast("long")).over(order))
    name = T.strip(F.regexp_replace("line", "^#+", ""))
    title = F.coalesce(F.max(F.when(head, F.when(name == "", "Overview").otherwise(name))), F.lit("Overview"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~head, F.struct("idx", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(key, "section_no").agg(title.alias("title"), T.normalize_whitespace(body).alias("text")).where("text <> ''")


def chunks(docs: DataFrame) -> DataFrame:
    """Chunks of documents (doc_id, text, lang, source): a chapter for each, and its windows as paragraphs.

    All of it is one narrow pass: windows are cut inside the row.
    """
    head = F.array_join(F.slice(T.words(F.split("text", "\n")[0]), 1, 4), " ")
    base = docs.where("coalesce(text, '') <> ''").select(
        "doc_id",
        F.concat_ws(" ", "source", "lang", F.lit("report")).alias("document_title"),
        head.alias("section_title"),
        F.concat(F.lit('{"lang": "'), F.coalesce("lang", F.lit("")), F.lit('", "source": "'), F.coalesce("source", F.lit("")), F.lit('"}')).alias("metadata"),
        F.concat(F.array("text"), T.windows(F.col("text"))).alias("parts"),
    )
    rows = base.select("*", (F.size("parts") - 1).alias("n"), F.posexplode("parts").alias("chunk_index", "text")).drop("parts")
    chapter = F.col("chunk_index") == 0
    page = lambda i: F.lit(1) + F.floor((i - 1) / F.lit(3)).cast("int")
    name = lambda i: F.concat(F.col("doc_id").cast("string"), F.lit("-"), i.cast("string"))
    return rows.select(
        name(F.col("chunk_index")).alias("chunk_id"),
        "doc_id",
        "document_title",
        F.when(chapter, "chapter").otherwise("paragraph").alias("chunk_level"),
        "chunk_index",
        "section_title",
        "text",
        F.when(chapter, 1).otherwise(page(F.col("chunk_index"))).alias("page_start"),
        F.when(chapter, page(F.col("n"))).otherwise(page(F.col("chunk_index"))).alias("page_end"),
        F.greatest(F.lit(1), F.size(T.words(F.col("text")))).alias("token_count"),
        F.when(~chapter, name(F.lit(0))).alias("parent_chunk_id"),
        "metadata",
    )


def parse_quality(chars: Column, pages: Column, size: Column, ocr_chars: Column | None = None) -> dict[str, Column]:
    """Route and quality of a parsed file: from its characters without white space, pages and bytes."""
    least = F.greatest(F.lit(600), F.floor(0.4 * F.greatest(F.lit(1), F.floor(size / 1024))).cast("int"))
    ocr = F.lit(0) if ocr_chars is None else ocr_chars
    enough = chars >= least
    dense = F.least(F.lit(1.0), chars / F.greatest(F.lit(1), pages) / 1200.0)
    quality = F.when(enough, dense).when(ocr > 0, F.least(F.lit(1.0), ocr / F.greatest(F.lit(1.0), pages * 900.0))).otherwise(dense)
    return {
        "route": F.when(enough, "text_sufficient").when(ocr > 0, "text_sparse").otherwise("text_fallback"),
        "quality_score": F.floor(quality * 10000 + 0.5) / 10000.0,
        "needs_review": F.when(enough, quality < 0.15).when(ocr > 0, quality < 0.25).otherwise(True),
    }


def ingest_versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New versions of documents: those of ``incoming`` (document_key, content_hash, seq) that ``existing`` lacks.

    A content that is known, anywhere, is no new version; of repeated contents the first counts.
    version_no goes on from a document's highest one.
    """
    new = incoming.join(existing.select("content_hash"), "content_hash", "left_anti")
    first = new.groupBy("content_hash").agg(F.min(F.struct("seq", "document_key")).alias("first")).select("content_hash", "first.seq", "first.document_key")
    highest = existing.groupBy("document_key").agg(F.max("version_no").alias("highest"))
    order = Window.partitionBy("document_key").orderBy("seq")
    return first.join(highest, "document_key", "left").select("document_key", "content_hash", "seq", (F.coalesce("highest", F.lit(0)) + F.row_number().over(order)).cast("long").alias("version_no"))


def ingested(documents: DataFrame, versions: DataFrame, parts: DataFrame, incoming: DataFrame, cut) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next generation of documents, versions and chunks after files came in.

    ``incoming`` has document_key, file_hash, content_hash, seq and the columns that ``cut`` makes chunks
    (with document_key) of. A document is replaced by its key; a known content is no new version, and
    its document's chunks stay; the chunks of documents with a new version are written anew, from the
    version that came last.
    """
    new = ingest_versions(versions, incoming)
    newest = new.groupBy("document_key").agg(F.max("seq").alias("seq"))
    texts = incoming.join(newest, ["document_key", "seq"])
    rows = incoming.groupBy("document_key").agg(F.max_by("file_hash", "seq").alias("file_hash"), F.max("seq").alias("seq"))
    documents = documents.join(rows.select("document_key"), "document_key", "left_anti").unionByName(rows)
    versions = versions.unionByName(new.select(versions.columns))
    parts = parts.join(newest.select("document_key"), "document_key", "left_anti").unionByName(cut(texts).select(parts.columns))
    return documents, versions, parts


def seeded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of markdown files (path, text): a chunk for each section.

    Documents: document_key (the text's hash), title (of the file's name), file_name. Chunks:
    document_key, chunk_index, section_title, char_end, token_count, text. Files of one text are one
    document, by the least path.
    """
    name = F.regexp_extract("path", "([^/]+)$", 1)
    one = files.groupBy(F.sha2("text", 256).alias("document_key")).agg(F.min("path").alias("path"), F.min("text").alias("text"))
    documents = one.select("document_key", F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")).alias("title"), name.alias("file_name"))
    order = Window.partitionBy("document_key").orderBy("section_no")
    rows = markdown_sections(one, "document_key").withColumn("chunk_index", F.row_number().over(order) - 1)
    return documents, rows.select("document_key", "chunk_index", F.col("title").alias("section_title"), F.char_length("text").alias("char_end"), F.greatest(F.lit(1), F.size(T.words(F.col("text")))).alias("token_count"), "text")
