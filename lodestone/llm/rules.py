"""Quality rules: whole-text features, and cutoffs with a guaranteed bound on false rejections."""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import Output, columns_of, slices, tidy
from lodestone.llm.shared import written
from lodestone.llm.shingles import SPACE, WIDTH, Words, distinct

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Lower ends of the strata, by number of words.
STRATA = (0, 50, 200, 1000)
#: Rules by name: the column that is divided, the one that divides, the first and the last cutoff,
#: and whether a document above the cutoff is rejected (else below). Cutoffs go from lax to strict.
RULES = {
    "symbols": ("n_symbols", "n_words", 4.0, 0.02, True),
    "repeats": ("n_repeat_words", "n_words", 0.20, 0.01, True),
    "same_lines": ("n_dup_lines", "n_lines", 1.0, 0.05, True),
    "long_words": ("word_chars", "n_words", 40.0, 6.0, True),
    "short_words": ("word_chars", "n_words", 1.5, 4.0, False),
}
CUTOFFS = 60
#: Good documents of a stratum that all rules together may reject, and the chance that this fails in some stratum.
RISK, CHANCE = 0.02, 0.05

FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(windows: np.ndarray, n_words: int) -> int:
    """Words that stand in a window found twice or more in the text."""
    if len(windows) < 2 or len(distinct(windows)) == len(windows):
        return 0
    _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WIDTH, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text, in one narrow pass; a null text has none of anything."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in FEATURES.split(", ")])

    def run(batches):
        out = Output(schema)
        for batch in slices(batches):
            words = Words(batch.column(1), lower=False)
            letters = np.concatenate([[0], np.cumsum(~SPACE[words.data] & ((words.data & 0xC0) != 0x80))])[words.bounds]
            symbols = np.concatenate([[0], np.cumsum(SYMBOLS[words.data])])[words.bounds]
            windows, _ = words.windows()
            first = words.first.tolist()
            for d, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                a, b = first[d], first[d + 1]
                lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
                repeats = repeated_words(windows[a : b - WIDTH + 1], b - a) if b - a > WIDTH else 0
                if out.add(doc_id, b - a, int(letters[d + 1] - letters[d]), int(symbols[d + 1] - symbols[d]), len(lines) - len(set(lines)), repeats, len(lines)):
                    yield out.batch()
        yield out.batch()

    source = columns_of(docs, id_col, text_col)
    return source.select(source.doc_id.cast("long"), "text").mapInArrow(tidy(run), FEATURES)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def stratum() -> Column:
    return sum((F.when(F.col("n_words") >= low, 1).otherwise(0) for low in STRATA[1:]), F.lit(0))


def cutoffs(rule: str) -> list[float]:
    _, _, first, last, _ = RULES[rule]
    return np.geomspace(first, last, CUTOFFS).round(6).tolist()


def strictness(rule: str) -> Column:
    """The index of the laxest cutoff of a rule that rejects the document, CUTOFFS if none does."""
    top, bottom, _, _, above = RULES[rule]
    ratio = F.col(top) / F.greatest(F.col(bottom), F.lit(1))
    rejecting = F.filter(F.array(*map(F.lit, cutoffs(rule))), lambda c: ratio > c if above else ratio < c)
    return F.lit(CUTOFFS) - F.size(rejecting)


def at_most(k: int, n: int, p: float) -> float:
    """The chance of at most k of n at probability p, exactly."""
    if k >= n:
        return 1.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    most = max(terms)
    return min(1.0, exp(most) * sum(exp(t - most) for t in terms))


def choose(counts: list[tuple[int, int, int]], risk: float = RISK, chance: float = CHANCE) -> dict[int, int]:
    """The strictest safe step by stratum; none where no step is safe.

    ``counts`` are (stratum, least step that rejects, good documents). A step sets all rules of a
    stratum at once, to their cutoffs of that index, and is safe if so few rejections would be
    unlikely at a true rate of ``risk``. Steps are tested in a fixed order, from lax to strict, up to
    the first that fails, which needs no further correction; strata share ``chance`` by Bonferroni.
    """
    found: dict[int, int] = {}
    for s in range(len(STRATA)):
        at = np.zeros(CUTOFFS + 1, np.int64)
        for stratum_, step, n in counts:
            if stratum_ == s:
                at[step] += n
        total, rejected = int(at.sum()), np.cumsum(at[:-1]).tolist()
        for step, k in enumerate(rejected):
            if not total or k > risk * total or at_most(k, total, risk) > chance / len(STRATA):
                break
            found[s] = step
    return found


def calibrated(counted: DataFrame, labels: DataFrame) -> dict[int, int]:
    """Steps from all labelled good documents that pass the base, counted by stratum and step.

    Of repeated labels of a document the lowest counts; null labels don't. What comes to the driver
    is bounded by strata and cutoffs.
    """
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    known = counted.where(~base_failed()).join(good, "doc_id", "left_semi")
    counts = known.groupBy(stratum().alias("stratum"), F.least(*map(strictness, RULES)).alias("step")).count().collect()
    return choose([(r["stratum"], r["step"], r["count"]) for r in counts])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Features and verdict of each document: ..., base_failed, failed_rules (array), kept.

    A document is kept if it passes the base and no rule of its stratum rejects it. A null, empty or
    wordless text fails the base. Without labels no rule has a safe cutoff and the base decides
    alone. Repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    counted = written(features(docs, id_col, text_col))
    safe = calibrated(counted, labels)
    step = sum((F.when(stratum() == s, at + 1).otherwise(0) for s, at in safe.items()), F.lit(0))
    failed = [F.when(strictness(rule) < step, F.lit(rule)) for rule in RULES] if safe else []
    names = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return counted.withColumn("base_failed", base_failed()).withColumn("failed_rules", names).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
