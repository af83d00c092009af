"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.arrow import columns_of, rows_where, slices, tidy

#: n-grams of a profile, and documents of a language that are learned from, about.
PROFILE, SAMPLE_ROWS = 400, 20_000
#: Characters that are counted at once, and n-grams that a task holds before it hands out their counts.
CHUNK, HELD = 1 << 18, 1_000_000
UNKNOWN = "und"
#: A text that saves less of the largest possible distance, even for its nearest language, is in none of the learned ones.
LEAST_SAVED = 0.2
_BREAK = re.compile(r"[^a-z]+")


@lru_cache(maxsize=1)
def _unicode():
    """What parts words of letters and their marks, and a letter, in any script."""
    import regex

    return regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters(text: str | None) -> str:
    """Lower-case words of letters with one space before, between and after them; nothing without letters.

    Digits, fractions and letter numbers aren't letters; marks count with the letters beside them.
    """
    text = (text or "").lower()
    if text.isascii():
        found = _BREAK.sub(" ", text).strip(" ")
    else:
        apart, letter = _unicode()
        found = apart.sub(" ", text).strip(" ")
        found = found if letter.search(found) else ""
    return f" {found} " if found else ""


def _grams(data: np.ndarray) -> np.ndarray:
    """Numbers of all 1-, 2- and 3-grams of UTF-8 bytes, but a space alone."""
    b = data.astype(np.int32)
    one = b[b != 32]
    two = (b[:-1] << 8 | b[1:]) + 256
    three = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) + 65_792
    return np.concatenate([one, two, three])


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text and how often each occurs; a long text goes chunk by chunk, cut at spaces."""
    parts, at = [], 0
    while at < len(text):
        end = len(text) if len(text) - at <= CHUNK else text.rfind(" ", at + 1, at + CHUNK)
        end = end if end > at else min(len(text), at + CHUNK)
        parts.append(np.unique(_grams(np.frombuffer(text[at : end + 1].encode(), np.uint8)), return_counts=True))
        at = end + 1 if end + 1 >= len(text) else end
    return parts[0] if len(parts) == 1 else _summed(parts)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(back, np.concatenate([n for _, n in parts]), len(gram)).astype(np.int64)


def top(gram: np.ndarray, n: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, in their order; ties go to the smaller number."""
    if len(n) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        keep = n >= least
        gram, n = gram[keep], n[keep]
    return gram[np.lexsort((gram, -n))][:most]


class Profiles:
    """Each language's n-grams by rank; a missing n-gram is as far out of place as a profile is long.

    The languages and ranks of an n-gram stand together, so that memory grows with the profiles alone.
    """

    def __init__(self, grams: dict[str, list[int]]):
        self.names = sorted(grams)
        gram = np.concatenate([np.zeros(0, np.int64), *(np.array(grams[name], np.int64) for name in self.names)])
        language = np.repeat(np.arange(len(self.names)), [len(grams[name]) for name in self.names])
        rank = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(grams[name])) for name in self.names)])
        by = np.argsort(gram, kind="stable")
        self.language, self.rank = language[by], rank[by]
        self.known, first = np.unique(gram[by], return_index=True)
        self.first = np.append(first, len(gram))

    def saved(self, mine: np.ndarray) -> np.ndarray:
        """The share of the largest possible distance that each language saves, for n-grams by rank."""
        at = np.searchsorted(self.known, mine)
        hit = np.flatnonzero(at < len(self.known))
        hit = hit[self.known[at[hit]] == mine[hit]]
        begin, count = self.first[at[hit]], np.diff(self.first)[at[hit]]
        entry = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        near = PROFILE - np.minimum(np.abs(self.rank[entry] - np.repeat(hit, count)), PROFILE)
        return np.bincount(self.language[entry], near, len(self.names)) / (PROFILE * len(mine))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language of the least distance (ties: the first by name), and how clear it is, from 0 to 1.

        The score is the share of the largest possible distance that the language saves, set
        against what the next language saves.
        """
        text = letters(text)
        if not text or not self.names:
            return UNKNOWN, 0.0
        saved = self.saved(top(*counts(text)))
        best = int(np.argmax(saved))
        if len(saved) == 1:
            return self.names[best], float(saved[best])
        other = float(np.delete(saved, best).max())
        return self.names[best], float(saved[best] / (saved[best] + other)) if saved[best] > 0 else 0.0


    def fits(self, text: str | None) -> bool:
        """Whether a text has letters and saves at least LEAST_SAVED for some language."""
        text = letters(text)
        return bool(text) and bool(self.names) and float(self.saved(top(*counts(text))).max()) >= LEAST_SAVED


def learned(docs: DataFrame, keep_out: Column) -> Profiles:
    """Profiles from documents with a language for which ``keep_out`` is false.

    Of a language with more than SAMPLE_ROWS documents about so many are drawn, by a hash of id and
    text. Tasks count n-grams by language and all counts are summed; a profile's PROFILE most frequent
    come to the driver, and no language is left out.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(~keep_out)
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return Profiles({})
    share = {r["lang"]: SAMPLE_ROWS / r["count"] for r in sizes}
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 33) / 2.0**31

    def run(batches):
        held: dict[str, list] = {}

        def summed():
            for lang, parts in held.items():
                gram, n = _summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in slices(batches, 0):
            for text, lang, at in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if at < share[lang] and (text := letters(text)):
                    parts = held.setdefault(lang, [])
                    parts.append(counts(text))
                    if len(parts) >= 200:
                        held[lang] = [_summed(parts)]
            if sum(len(gram) for parts in held.values() for gram, _ in parts) >= HELD:
                held = {lang: [_summed(parts)] for lang, parts in held.items()}
                if sum(len(gram) for parts in held.values() for gram, _ in parts) >= HELD // 2:
                    yield from summed()
        yield from summed()

    counted = known.select("text", "lang", draw.alias("at")).mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    grams: dict[str, list[int]] = {}
    for row in counted.withColumn("place", place).where(f"place <= {PROFILE}").orderBy("place").collect():
        grams.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(grams)


def identify(docs: DataFrame, keep_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of each whole text: doc_id, lang_pred, score.

    ``keep_out`` marks rows that aren't learned from; a prediction reads the text alone. lang_pred is
    ``und`` with score 0 for a null text or one without letters, and for all if nothing is learned.
    Repeated rows are predicted each; an empty table gives no rows; other columns are ignored.
    """
    plain = columns_of(docs, id_col, text_col)
    plain = plain.select(plain.doc_id.cast("long"), "text")
    profiles = learned(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")), F.lit(False) if keep_out is None else keep_out)
    return predicted(plain, profiles)


def predicted(docs: DataFrame, profiles: Profiles) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in slices(batches):
            found = [profiles.nearest(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema=schema)

    return docs.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def with_a_language(docs: DataFrame) -> DataFrame:
    """The documents in one of the languages that are learned from all of them, with all their columns; all, if nothing is learned.

    A null text, one without letters, and one that is nearly as far out of place as can be for every
    language (LEAST_SAVED) go. Repeated rows are judged each; an empty table stays empty.
    """
    profiles = learned(docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").alias("text"), docs.lang.cast("string").alias("lang")), F.lit(False))
    if not profiles.names:
        return docs
    return rows_where(docs, "text", lambda texts: list(map(profiles.fits, texts)))
