"""Text cleaning and structure as Column functions, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import vocabulary as V

SPACES = " \t\n\x0b\f\r"
TOKEN = r"[A-Za-z0-9]+|[一-鿿]+"
SINGLE_TOKEN = r"[A-Za-z0-9]+|[一-鿿]"
NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?%?"
SENTENCE_END = r"(?<=[。！？!?.])\s+"
#: Words of a window and words that neighbouring windows share.
WINDOW, OVERLAP = 180, 35


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def contains_any(c: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t)) if terms else F.lit(False)


def count_contained(c: Column, terms: list[str]) -> Column:
    return sum((F.contains(c, F.lit(t)).cast("int") for t in terms), F.lit(0))


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \\t\\x0B\\f]+(\\n|\\z)", "$1")
    c = F.regexp_replace(c, "[ \\t]+", " ")
    return strip(F.regexp_replace(c, "\\n{3,}", "\n\n"))


def fold_case(c: Column) -> Column:
    """Lower case, with the sharp s as two letters."""
    return F.lower(F.regexp_replace(c, "[ßẞ]", "ss"))


def canonical_paragraph(c: Column) -> Column:
    c = fold_case(normalize_whitespace(c))
    c = F.regexp_replace(c, r"[‐-―\-_/|·•*=:;,.，。！？!?（）()\[\]{}<>]+", " ")
    c = F.regexp_replace(c, r"\b\d+(?:[.,:/-]\d+)*\b", " <num> ")
    return squeeze(c)


def paragraph_fingerprint(c: Column) -> Column:
    return F.sha2(canonical_paragraph(c), 256)


def boilerplate_signature(c: Column) -> Column:
    c = fold_case(normalize_whitespace(c))
    c = F.regexp_replace(c, r"page\s*\d+(?:\s*/\s*\d+)?", " page ")
    c = F.regexp_replace(c, r"\d{4}[/-]\d{1,2}[/-]\d{1,2}", " <date> ")
    c = F.regexp_replace(c, r"\d+(?:[.,:/-]\d+)*", " <num> ")
    c = F.regexp_replace(c, "[|·•*_=-]+", " ")
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" .,:;|<>"))


def is_static_noise(c: Column) -> Column:
    c = normalize_whitespace(c)
    full = F.lower(c).rlike(r"^([-–—_ ]+|(page\s*)?\d+(\s*/\s*\d+)?)$")
    return (c == "") | full | c.rlike("(?i)" + "|".join(V.NOISE_PATTERNS))


def lines(c: Column) -> Column:
    return F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n")


def page_lines(c: Column) -> Column:
    """Lines that aren't blank, without white space at their ends' right."""
    ends = F.transform(lines(c), lambda x: F.regexp_replace(x, r"\s+\z", ""))
    return F.filter(ends, lambda x: x != "")


def trimmed_lines(c: Column) -> Column:
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def is_table_block(c: Column) -> Column:
    rows = trimmed_lines(c)
    half = F.floor(F.size(rows) / 2)
    columns = F.size(F.filter(rows, lambda x: x.rlike(r"\S\s{2,}\S")))
    sentences = F.size(F.filter(rows, lambda x: x.rlike("[。！？.!?]")))
    return (F.size(rows) >= 2) & (columns >= F.greatest(F.lit(2), half)) & (sentences <= half)


def normalize_table(c: Column) -> Column:
    return F.array_join(F.transform(trimmed_lines(c), lambda x: F.regexp_replace(x, r"\s{2,}", "\t")), "\n")


def edges(rows: Column, n: int) -> Column:
    """The first n and the last n of an array, as one; short arrays repeat their elements."""
    size = F.size(rows)
    return F.concat(F.slice(rows, 1, n), F.slice(rows, F.greatest(size - (n - 1), F.lit(1)), n))


def edge_signature(rows: Column) -> Column:
    signatures = F.filter(F.transform(rows, boilerplate_signature), lambda x: x != "")
    return F.array_join(F.slice(signatures, 1, 4), " | ")


def is_heading(c: Column) -> Column:
    text = normalize_whitespace(c)
    compact = F.regexp_replace(text, r"\s+", "")
    n, words = F.char_length(text), F.size(F.regexp_extract_all(text, F.lit(r"\S+"), 0))
    term = contains_any(text, V.HEADING_TERMS)
    upper = (F.upper(text) == text) & ~F.contains(text, F.lit("ß")) & (n >= 3)
    return (
        F.when((text == "") | (n > 120), False)
        .when((n > 80) & ~term, False)
        .when(text.rlike("[。！？.!?；;]"), False)
        .when(compact.rlike("^第[一二三四五六七八九十百0-9]+(章|节|部分|篇)"), True)
        .when(term, True)
        .when(F.startswith(compact, F.lit("财务报告")) & (F.char_length(compact) <= 12), True)
        .when(F.endswith(text, F.lit("报告")) & (n <= 40), True)
        .when(text.rlike(r"^(第[一二三四五六七八九十0-9]+[章节部分篇条]?|[0-9]+(\.[0-9]+)*\s+)"), True)
        .when(text.rlike("[：:]$"), True)
        .when(upper, True)
        .when((n <= 24) & ((~F.contains(text, F.lit(" "))) | (words <= 4)), True)
        .otherwise(False)
    )


def toc_entry(c: Column) -> Column:
    """A struct of title and page for a table-of-contents line, else null."""
    text = normalize_whitespace(c)
    usable = (text != "") & ~text.rlike("[。！？!?]") & (F.char_length(text) <= 160)
    text = F.when(text.rlike(r"\.{2,}"), strip(F.regexp_replace(F.regexp_replace(text, r"\.{2,}", " "), r"\s{2,}", " "))).otherwise(text)
    title = normalize_whitespace(F.regexp_extract(text, r"^(.+?)\s+(\d{1,4})$", 1))
    page = F.regexp_extract(text, r"^(.+?)\s+(\d{1,4})$", 2)
    good = usable & (title != "") & ~title.rlike(r"^\d+$")
    return F.when(good, F.struct(title.alias("title"), F.when(page != "", page).cast("int").alias("page")))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\S+"), 0)


def windows(c: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of words; a text of no more words than one window stays as it is."""
    step = max(1, size - overlap)

    def cut(all_words: Column) -> Column:
        n = F.size(all_words)
        count = F.lit(1) + F.ceil((n - size) / F.lit(float(step))).cast("int")
        each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(all_words, i * step + 1, size), " "))
        return F.when(n <= size, F.array(c)).otherwise(each)

    return F.get(F.transform(F.array(words(c)), cut), 0)  # words are a variable: found once, not once for each window


def language_tag(c: Column) -> Column:
    return F.when(c.rlike("[A-Za-z]") & ~c.rlike("[一-鿿]"), "en").otherwise("zh")


def tokens(c: Column) -> Column:
    """Latin words and numbers in lower case; a run of ideographs, and all its pairs if it is longer than two."""

    def parts(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(t.rlike("^[A-Za-z0-9]"), F.array(F.lower(t))).when(F.char_length(t) <= 2, F.array(t)).otherwise(F.concat(F.array(t), pairs))

    latin = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), 0), F.lower)
    return F.when(c.rlike("[一-鿿]"), F.flatten(F.transform(F.regexp_extract_all(c, F.lit(TOKEN), 0), parts))).otherwise(latin)


def counted(array: Column) -> Column:
    """Distinct elements with their counts, within the row."""
    return F.transform(F.array_distinct(array), lambda t: F.struct(t.alias("token"), F.size(F.filter(array, lambda x: x == t)).alias("n")))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda x: x != "")


def numbers(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?<!\d)" + NUMBER + r"(?!\d)"), 0)
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def slug(c: Column) -> Column:
    cut = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(cut == "", "item").otherwise(cut)


def html_text(c: Column) -> Column:
    """Text of a page: block tags break lines, other tags vanish, entities of markup are read."""
    c = F.regexp_replace(c, "(?is)<!--.*?-->|<!doctype[^>]*>", "")
    c = F.regexp_replace(c, "(?i)</?(" + "|".join(V.BLOCK_TAGS) + r")(\s[^>]*)?/?>", "\n")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for name, shown in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(shown))
    return normalize_whitespace(F.regexp_replace(F.regexp_replace(c, "[ \\t]{2,}", " "), "\\n{3,}", "\n\n"))


def links(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit('(?i)<a[^>]+href="([^"]+)"'), 1))


def citation(title: Column, first: Column, last: Column) -> Column:
    """Title and pages, as far as they are known."""
    return F.when(first.isNotNull() & last.isNotNull() & (first == last), F.concat(title, F.lit(" p."), first)).when(first.isNotNull() & last.isNotNull(), F.concat(title, F.lit(" p."), first, F.lit("-"), last)).when(first.isNotNull(), F.concat(title, F.lit(" p."), first)).otherwise(title)


def clean_citations(answer: Column, sources: Column) -> Column:
    """Citations [n] beyond the number of sources vanish, and so does what was left hanging by that."""
    c = F.regexp_replace(answer, r"\[\s*\]", "")
    named = F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))
    wrong = F.array_distinct(F.filter(named, lambda k: (k < 1) | (k > sources)))
    c = F.aggregate(wrong, c, lambda text, k: F.replace(text, F.concat(F.lit("["), k.cast("string"), F.lit("]")), F.lit("")))
    c = F.regexp_replace(c, r"(?i)(?:至|到|through)\s*(?=[,.;，。；\s]|\z)", "")
    c = F.regexp_replace(c, r"\s+([,.;，。；])", "$1")
    c = F.regexp_replace(F.regexp_replace(c, "[ \\t]{2,}", " "), "\\n{3,}", "\n\n")
    return strip(c)


def first_sentences(c: Column, n: int, most: int, fallback: int) -> Column:
    text = squeeze(c)
    found = sentences(text)
    return F.when(F.size(found) == 0, F.substring(text, 1, fallback)).otherwise(F.substring(F.array_join(F.slice(found, 1, n), " "), 1, most))


def hash_embedding(c: Column, dimension: int = 1024) -> Column:
    """A deterministic vector from the bytes of the text's SHA-256, each scaled to [-1, 1]."""
    digest = F.sha2(c, 256)
    byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: byte(i) / 255.0 * 2.0 - 1.0)
