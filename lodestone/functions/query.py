"""Understanding of questions as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import vocabulary as V
from lodestone.functions.text import contains_any, count_contained, strip, tokens

CATEGORIES = list(V.CATEGORY_KEYWORDS)


def category(question: Column, keywords: dict[str, list[str]] = V.CATEGORY_KEYWORDS) -> Column:
    """The category with the most keywords in the question; ties, and no keyword at all, go to the first."""
    lowered = F.lower(question)
    hits = {name: count_contained(lowered, [w.lower() for w in words]) for name, words in keywords.items()}
    most = F.greatest(*hits.values())
    return F.coalesce(*(F.when(n == most, F.lit(name)) for name, n in hits.items()))


def by_category(name: Column, values: dict[str, Column], default: Column) -> Column:
    out = default
    for key, value in values.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def expansion(question: Column, name: Column | None = None) -> Column:
    """The question, the aliases of terms in it, and its category's terms, as an array."""
    aliases = [F.when(F.contains(question, F.lit(term)), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for term, names in V.ALIASES.items()]
    terms = by_category(category(question) if name is None else name, {key: F.array(*map(F.lit, words)) for key, words in V.REWRITE_TERMS.items()}, F.array().cast("array<string>"))
    return F.concat(F.array(question), *aliases, terms)


def target_terms(question: Column) -> Column:
    """What titles of the documents that a question names contain, sorted."""
    lowered = F.lower(question)
    found = [F.when(F.contains(lowered, F.lit(name)), F.lit(term)) for name, term in V.DOCUMENT_HINTS.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def matches_targets(title: Column, targets: Column) -> Column:
    return (F.size(targets) == 0) | F.exists(targets, lambda t: F.contains(F.lower(title), t))


def without_noise(array: Column) -> Column:
    skipped = F.array(*map(F.lit, V.STOPWORDS + V.NOISE_TOKENS))
    return F.filter(array, lambda t: ~F.array_contains(skipped, t) & ~t.rlike(r"^\d+$"))


def query_tokens(question: Column) -> Column:
    return without_noise(tokens(F.array_join(expansion(question), " ")))


def focus_tokens(question: Column) -> Column:
    """Query tokens and those of the financial metrics."""
    return without_noise(F.concat(tokens(F.array_join(expansion(question), " ")), tokens(F.lit(" ".join(V.METRIC_TERMS)))))


def query_hash(question: Column) -> Column:
    return F.sha2(F.array_join(F.split(F.lower(strip(question)), r"\s+"), " "), 256)


def section_bonus(section: Column, name: Column) -> Column:
    """``section`` in lower case, null without one."""
    section = F.coalesce(section, F.lit(""))
    preferred = by_category(name, {k: contains_any(section, terms) for k, terms in V.PREFERRED_SECTIONS.items()}, F.lit(False))
    return F.when(preferred, 0.35).otherwise(0.0) - F.when(contains_any(section, V.NOISY_SECTIONS), 0.05).otherwise(0.0) - F.when((name == "financial") & F.contains(section, F.lit("overview")), 0.25).otherwise(0.0)


def metric_bonus(searchable: Column) -> Column:
    return F.least(F.lit(0.24), 0.03 * count_contained(searchable, V.METRIC_TERMS))


def category_hits(searchable: Column, name: Column) -> Column:
    """``searchable`` in lower case."""
    return by_category(name, {k: count_contained(searchable, terms) for k, terms in V.RERANK_TERMS.items()}, F.lit(0))


def subject(title: Column) -> Column:
    named = [F.when(F.contains(F.lower(title), F.lit(key.lower())), F.lit(shown)) for key, shown in V.SEED_SUBJECTS.items()]
    first = F.get(F.regexp_extract_all(title, F.lit(r"\S+"), 0), 0)
    return F.coalesce(*named, first, F.lit("这家公司"))
