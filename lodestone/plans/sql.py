"""DuckDB expressions that mirror the column functions, for the oracles."""

from __future__ import annotations

from lodestone.functions import vocabulary as V

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?%?"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(terms: list[str]) -> str:
    return "[" + ", ".join(map(q, terms)) + "]"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {to}, 'g')"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def squeeze(x: str) -> str:
    return strip(sub(x, r"\s+", "' '"))


def nw(x: str) -> str:
    x = sub(sub(x, r"\r\n?", "chr(10)"), r"[ \t\v\f]+(\n|$)", r"'\1'")
    return strip(sub(sub(x, r"[ \t]+", "' '"), r"\n{3,}", "chr(10) || chr(10)"))


def fold(x: str) -> str:
    return f"lower({sub(x, '[ßẞ]', q('ss'))})"


def canonical(x: str) -> str:
    x = sub(fold(nw(x)), r"[‐-―\-_/|·•*=:;,.，。！？!?（）()\[\]{}<>]+", "' '")
    return squeeze(sub(x, r"\b\d+(?:[.,:/-]\d+)*\b", "' <num> '"))


def signature(x: str) -> str:
    x = sub(fold(nw(x)), r"page\s*\d+(?:\s*/\s*\d+)?", "' page '")
    x = sub(sub(x, r"\d{4}[/-]\d{1,2}[/-]\d{1,2}", "' <date> '"), r"\d+(?:[.,:/-]\d+)*", "' <num> '")
    return f"trim({sub(sub(x, '[|·•*_=-]+', q(' ')), '\\s+', q(' '))}, ' .,:;|<>')"


def noise(x: str) -> str:
    x = nw(x)
    full = r"^([-–—_ ]+|(page\s*)?\d+(\s*/\s*\d+)?)$"
    return f"({x} = '' OR regexp_matches(lower({x}), {q(full)}) OR regexp_matches({x}, {q('(?i)' + '|'.join(V.NOISE_PATTERNS))}))"


def lines(x: str) -> str:
    return f"string_split({sub(x, r'\r\n?', 'chr(10)')}, chr(10))"


def page_lines(x: str) -> str:
    return f"list_filter(list_transform({lines(x)}, lambda l: {sub('l', r'\s+$', q(''))}), lambda l: l <> '')"


def trimmed_lines(x: str) -> str:
    return f"list_filter(list_transform({lines(x)}, lambda l: {strip('l')}), lambda l: l <> '')"


def any_of(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")" if terms else "FALSE"


def count_of(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(t)}) AS INTEGER)" for t in terms) + ")" if terms else "0"


def heading(x: str) -> str:
    text = nw(x)
    compact = sub(text, r"\s+", "''")
    term = any_of(text, V.HEADING_TERMS)
    return f"""CASE WHEN {text} = '' OR length({text}) > 120 THEN FALSE
      WHEN length({text}) > 80 AND NOT {term} THEN FALSE
      WHEN regexp_matches({text}, '[。！？.!?；;]') THEN FALSE
      WHEN regexp_matches({compact}, '^第[一二三四五六七八九十百0-9]+(章|节|部分|篇)') THEN TRUE
      WHEN {term} THEN TRUE
      WHEN starts_with({compact}, '财务报告') AND length({compact}) <= 12 THEN TRUE
      WHEN ends_with({text}, '报告') AND length({text}) <= 40 THEN TRUE
      WHEN regexp_matches({text}, '^(第[一二三四五六七八九十0-9]+[章节部分篇条]?|[0-9]+(\\.[0-9]+)*\\s+)') THEN TRUE
      WHEN regexp_matches({text}, '[：:]$') THEN TRUE
      WHEN upper({text}) = {text} AND NOT contains({text}, 'ß') AND length({text}) >= 3 THEN TRUE
      WHEN length({text}) <= 24 AND (NOT contains({text}, ' ') OR len(regexp_extract_all({text}, '\\S+')) <= 4) THEN TRUE
      ELSE FALSE END"""


def tokens(x: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+|[一-鿿]+'), lambda t:
      CASE WHEN regexp_matches(t, '^[A-Za-z0-9]') THEN [lower(t)] WHEN length(t) <= 2 THEN [t]
      ELSE list_concat([t], list_transform(range(1, length(t)), lambda i: substring(t, i, 2))) END))"""


def sentences(x: str) -> str:
    """Sentences: their ends are marked first, as there is no look-behind."""
    return f"list_filter(list_transform(string_split({sub(x, r'([。！？!?.])\s+', r"'\1' || chr(1)")}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def category(x: str, keywords: dict[str, list[str]] = V.CATEGORY_KEYWORDS) -> str:
    hits = {name: count_of(f"lower({x})", [w.lower() for w in words]) for name, words in keywords.items()}
    most = f"greatest({', '.join(hits.values())})"
    return "CASE " + " ".join(f"WHEN {n} = {most} THEN {q(name)}" for name, n in hits.items()) + " END"


def expansion(x: str) -> str:
    aliases = [f"CASE WHEN contains({x}, {q(term)}) THEN {array(names)} ELSE [] END" for term, names in V.ALIASES.items()]
    terms = f"CASE {category(x)} " + " ".join(f"WHEN {q(name)} THEN {array(words)}" for name, words in V.REWRITE_TERMS.items()) + " END"
    return "flatten([[" + x + "], " + ", ".join([*aliases, terms]) + "])"


def targets(x: str) -> str:
    found = ", ".join(f"CASE WHEN contains(lower({x}), {q(name)}) THEN {q(term)} END" for name, term in V.DOCUMENT_HINTS.items())
    return f"list_sort(list_distinct(list_filter([{found}], lambda t: t IS NOT NULL)))"


def without_noise(x: str) -> str:
    return f"list_filter({x}, lambda t: NOT list_contains({array(V.STOPWORDS + V.NOISE_TOKENS)}, t) AND NOT regexp_matches(t, '^\\d+$'))"


def expanded(x: str) -> str:
    return f"array_to_string({expansion(x)}, ' ')"


def query_tokens(x: str) -> str:
    return without_noise(tokens(expanded(x)))


def section_bonus(section: str, name: str) -> str:
    preferred = f"CASE {name} " + " ".join(f"WHEN {q(k)} THEN {any_of(section, terms)}" for k, terms in V.PREFERRED_SECTIONS.items()) + " END"
    return f"(CASE WHEN {preferred} THEN 0.35e0 ELSE 0e0 END - CASE WHEN {any_of(section, V.NOISY_SECTIONS)} THEN 0.05e0 ELSE 0e0 END - CASE WHEN {name} = 'financial' AND contains({section}, 'overview') THEN 0.25e0 ELSE 0e0 END)"


def category_hits(x: str, name: str, of: dict[str, list[str]] = V.RERANK_TERMS) -> str:
    return f"CASE {name} " + " ".join(f"WHEN {q(k)} THEN {count_of(x, terms)}" for k, terms in of.items()) + " ELSE 0 END"


#: Chunks of documents, as ``operators.corpus.chunks`` makes them.
CHUNKS = r"""
words_ AS (SELECT *, regexp_extract_all(text, '\S+') AS ws FROM documents WHERE coalesce(text, '') <> ''),
parts_ AS (SELECT *, CASE WHEN len(ws) <= 180 THEN 1 ELSE 1 + CAST(ceil((len(ws) - 180) / 145e0) AS BIGINT) END AS n FROM words_),
chunks AS (
  SELECT doc_id || '-' || i AS chunk_id, doc_id, concat_ws(' ', source, lang, 'report') AS document_title,
    CASE WHEN i = 0 THEN 'chapter' ELSE 'paragraph' END AS chunk_level, CAST(i AS INTEGER) AS chunk_index,
    array_to_string(regexp_extract_all(string_split(text, chr(10))[1], '\S+')[1:4], ' ') AS section_title,
    CASE WHEN i = 0 OR len(ws) <= 180 THEN text ELSE array_to_string(ws[(i - 1) * 145 + 1 : (i - 1) * 145 + 180], ' ') END AS text,
    CAST(CASE WHEN i = 0 THEN 1 ELSE 1 + (i - 1) // 3 END AS INTEGER) AS page_start,
    CAST(CASE WHEN i = 0 THEN 1 + (n - 1) // 3 ELSE 1 + (i - 1) // 3 END AS INTEGER) AS page_end,
    CASE WHEN i > 0 THEN doc_id || '-0' END AS parent_chunk_id,
    '{"lang": "' || coalesce(lang, '') || '", "source": "' || coalesce(source, '') || '"}' AS metadata
  FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM parts_)
)"""

#: Index tables over chunks.
INDEX = f"""{CHUNKS},
toks AS (SELECT chunk_id, {tokens("concat_ws(' ', document_title, nullif(section_title, ''), text, metadata)")} AS toks FROM chunks),
lens AS (SELECT chunk_id, greatest(1, len(toks)) AS chunk_len, len(toks) AS n_tokens FROM toks),
totals AS (SELECT count(*) AS n_chunks, avg(n_tokens) AS avg_len FROM lens),
postings AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS token FROM toks) GROUP BY ALL),
idf AS (SELECT token, df, ln(1 + (n_chunks - df + 0.5e0) / (df + 0.5e0)) AS idf FROM (SELECT token, count(*) AS df FROM postings GROUP BY token), totals)"""

_SECTION, _SEARCH = "lower(coalesce(section_title, ''))", "concat_ws(' ', document_title, nullif(section_title, ''), text)"

#: What a chunk scores by itself in the category ``category``.
OWN_BONUS = f"""({section_bonus(_SECTION, "category")} + CASE WHEN chunk_level = 'paragraph' THEN 0.15e0 ELSE 0.05e0 END
  + least(0.2e0, ln(1 + page_start) / 20e0) - CASE WHEN category = 'financial' AND page_start <= 2 THEN 0.1e0 ELSE 0e0 END
  + CASE WHEN length(text) > 1200 THEN -0.05e0 ELSE 0e0 END + CASE WHEN length(text) < 80 THEN -0.1e0 ELSE 0e0 END
  + CASE WHEN category = 'financial' THEN least(0.24e0, 0.03e0 * {count_of(_SEARCH, V.METRIC_TERMS)}) ELSE 0e0 END)"""

#: Scores of all chunks for all questions of ``benchmark``.
LEXICAL = f"""{INDEX},
asked AS (SELECT item_id AS q_id, text AS question, {category("text")} AS category, {targets("text")} AS targets, {query_tokens("text")} AS qtoks FROM benchmark),
qt AS (SELECT q_id, token, count(*) AS qtf FROM (SELECT q_id, unnest(qtoks) AS token FROM asked) GROUP BY ALL),
whole AS (SELECT q_id, sum(coalesce(idf, 0) * qtf) AS whole FROM qt LEFT JOIN idf USING (token) GROUP BY q_id),
matched AS (
  SELECT q_id, chunk_id, sum(idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * chunk_len / avg_len))) AS overlap, list(token ORDER BY idf DESC, token) AS terms
  FROM qt JOIN idf USING (token) JOIN postings USING (token) JOIN lens USING (chunk_id), totals GROUP BY q_id, chunk_id),
scored AS (
  SELECT *, round(3e0 * coalesce(overlap, 0) / greatest(0.01e0, whole)
    + CASE WHEN len(list_filter(terms, lambda t: contains(lower(document_title), t))) > 0 THEN 0.8e0 ELSE 0e0 END
    + CASE WHEN len(list_filter(terms, lambda t: contains({_SECTION}, t))) > 0 THEN 0.4e0 ELSE 0e0 END
    + {OWN_BONUS}
    + CASE WHEN len(targets) = 0 THEN 0e0 WHEN len(list_filter(targets, lambda t: contains(lower(document_title), t))) > 0 THEN 0.3e0 ELSE -0.7e0 END, 9) AS score
  FROM (SELECT a.q_id, a.category, a.targets, w.whole, m.overlap, coalesce(m.terms, []) AS terms, c.*
    FROM asked a JOIN whole w USING (q_id) CROSS JOIN chunks c LEFT JOIN matched m ON m.q_id = a.q_id AND m.chunk_id = c.chunk_id)),
hits AS (SELECT * FROM scored WHERE score > 0)"""

_TEXT = squeeze("lower(text)")
_WHOLE = f"concat_ws(' ', lower(document_title), {_SECTION}, {_TEXT})"

RERANK_BONUS = f"""(least(0.45e0, 0.08e0 * {category_hits(_WHOLE, "category")})
  + CASE WHEN CASE category {" ".join(f"WHEN {q(k)} THEN {any_of(_SECTION, terms)}" for k, terms in V.PREFERRED_SECTIONS.items())} END THEN 0.35e0 ELSE 0e0 END
  - CASE WHEN {any_of(_SECTION, V.NOISY_SECTIONS)} THEN 0.15e0 ELSE 0e0 END
  - CASE WHEN page_start = 1 AND {any_of(_SECTION, ["annual report", "notes", "contents"])} THEN 0.12e0 ELSE 0e0 END
  + CASE WHEN regexp_matches({_TEXT}, '\\b(20\\d{{2}}|\\d+(?:\\.\\d+)?%|\\$?\\d+(?:,\\d{{3}})*(?:\\.\\d+)?)\\b') THEN 0.08e0 ELSE 0e0 END
  - CASE WHEN length({_TEXT}) < 120 THEN 0.08e0 ELSE 0e0 END
  + least(0.25e0, 0.08e0 * {category_hits(_WHOLE, "category", {k: [t for t in terms if " " in t] for k, terms in V.REWRITE_TERMS.items()})}))"""


def ranked(table: str, order: str, name: str = "rank") -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY {order}, chunk_id) AS INTEGER) AS {name} FROM {table}"


#: The nearest vectors of the vectors that are named like a question: q_id, chunk_id, distance, rank, and the document's columns.
VECTOR_HITS = f"""{CHUNKS},
vec AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
sized AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM vec),
near AS (
  SELECT b.item_id AS q_id, c.vec_id || '-1' AS chunk_id, c.vec_id AS doc_id,
    round(1 - list_sum(list_transform(list_zip(c.v, s.v), lambda z: z[1] * z[2])) / (c.size * s.size), 9) + 0e0 AS distance
  FROM benchmark b JOIN sized s ON s.vec_id = b.item_id, sized c WHERE c.size > 0 AND s.size > 0),
vhits AS (SELECT n.q_id, n.chunk_id, n.distance, n.rank, c.document_title, c.section_title, c.page_start, c.page_end, c.text
  FROM ({ranked("near", "distance")}) n JOIN chunks c USING (chunk_id)),
cases AS (
  SELECT b.item_id AS q_id, b.text AS question, 'src' || (b.item_id % 20) AS gold_doc, CAST(NULL AS INTEGER) AS gold_first, CAST(NULL AS INTEGER) AS gold_last,
    list_distinct(list_filter(regexp_extract_all(lower(b.text), '[a-z]+'), lambda w: length(w) >= 9)) AS keywords,
    g.chunk_id AS gold_chunk, g.document_title AS gold_title, g.section_title AS gold_section, g.page_start AS g_first, g.page_end AS g_last
  FROM benchmark b LEFT JOIN chunks g ON g.chunk_id = (b.item_id + 1) || '-1')"""
