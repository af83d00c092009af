"""Scores of chunks for a stated set of questions, in one narrow pass over the chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import query as Q
from lodestone.functions import text as T
from lodestone.functions.registration import tokens_of
from lodestone.operators.index import Index, whole

#: Questions that are sent to all tasks at once, cells (chunk, question) that a task scores at once, and candidates it holds.
MOST_QUESTIONS, BLOCK_CELLS, MOST_HELD = 2_000, 50_000, 200_000


def weighed(index: Index, questions: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Each question's different tokens that the corpus has: q_id, token, qtf, idf."""
    asked = questions.select("q_id", F.explode(T.counted(F.col(tokens))).alias("t")).select("q_id", "t.token", F.col("t.n").alias("qtf"))
    return index.idf.join(F.broadcast(asked), "token").select("q_id", "token", "qtf", "idf")


class _Asked:
    """Questions as arrays; tokens point to the questions that have them."""

    def __init__(self, rows: list, tokens: pa.Table, average: float, most: int | None, alone: bool) -> None:
        self.names, self.average, self.most, self.alone = [r.q_id for r in rows], average, most, alone
        place = {name: k for k, name in enumerate(self.names)}
        q, token, qtf, idf = (tokens.column(c).to_pylist() for c in ("q_id", "token", "qtf", "idf"))
        order = sorted(range(len(q)), key=lambda k: (token[k], place[q[k]]))
        self.tokens = sorted(set(token))
        self.ids = {t: k for k, t in enumerate(self.tokens)}
        self.of_token = np.array([place[q[k]] for k in order], np.int64)
        self.degree = np.bincount([self.ids[token[k]] for k in order], minlength=len(self.tokens)) if order else np.zeros(0, np.int64)
        self.start = np.cumsum(self.degree) - self.degree
        self.idf = np.zeros(len(self.tokens))
        self.idf[[self.ids[t] for t in token]] = idf
        self.whole = np.bincount([place[x] for x in q], np.array(idf) * np.array(qtf), len(rows)) if q else np.zeros(len(rows))
        if alone:
            self.category = np.array([Q.CATEGORIES.index(r.category) if r.category in Q.CATEGORIES else 0 for r in rows], np.int64)
            self.targets = [r.targets or [] for r in rows]
            self.isolated = np.array([bool(r.isolated) if "isolated" in r else False for r in rows])


def _pass(sent):
    """A function of batches (chunk_id, chapter, title, section, whole, own) that gives pairs with their score."""

    def run(batches):
        a = sent.value
        n, get = len(a.names), a.ids.get
        named = pa.array(a.names)
        rows_at_once = max(1, BLOCK_CELLS // max(1, n))
        by_title: dict[str, np.ndarray] = {}
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        floor = {level: np.full(n, -np.inf) for level in held}
        last: dict[bool, list] = {level: [None] * n for level in held}

        def cut(level):
            columns = [np.concatenate(x) for x in zip(*held[level])]
            q, score, ids = columns[:3]
            order = np.lexsort((ids, -score, q))
            ordered = q[order]
            begins = np.concatenate(([0], np.flatnonzero(np.diff(ordered)) + 1))
            nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            for k in order[nth == a.most - 1]:
                floor[level][q[k]], last[level][q[k]] = score[k], str(ids[k])
            held[level] = [[x[order[nth < a.most]] for x in columns]]
            size[level] = len(held[level][0][0])

        def told(q, score, ids, coverage, title, section, level):
            return pa.RecordBatch.from_pydict({"q_id": named.take(pa.array(q)), "chunk_id": ids, "coverage": coverage, "in_title": title, "in_section": section, "score": score, "chapter": level}) if len(q) else None

        def aimed(title):
            if title not in by_title:
                match = [not t or any(x in title for x in t) for t in a.targets]
                bonus = [0.0 if not t else 0.3 if m else -0.7 for t, m in zip(a.targets, match)]
                by_title[title] = np.where(a.isolated & ~np.array(match, bool), -np.inf, np.array(bonus))
            return by_title[title] if len(by_title) < 1_000 else by_title.pop(title)

        for batch in batches if n else ():
            for at in range(0, batch.num_rows, rows_at_once):
                block = batch.slice(at, rows_at_once)
                ids, chapter, titles, sections, texts = (block.column(k).to_pylist() for k in range(5))
                m, found, lengths = len(ids), [], np.empty(block.num_rows)
                for r, text in enumerate(texts):
                    tokens = tokens_of(text)
                    lengths[r] = max(1, len(tokens))
                    found.append(np.array([x for x in map(get, tokens) if x is not None], np.int64) + r * len(a.tokens))
                cells, tf = np.unique(np.concatenate(found), return_counts=True)
                row, token = cells // max(1, len(a.tokens)), cells % max(1, len(a.tokens))
                value = a.idf[token] * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[row] / a.average)))
                in_title = np.array([a.tokens[t] in titles[r] for r, t in zip(row.tolist(), token.tolist())], bool)
                in_section = np.array([a.tokens[t] in sections[r] for r, t in zip(row.tolist(), token.tolist())], bool)
                each = a.degree[token]
                entry = np.repeat(np.arange(len(cells)), each)
                within = np.arange(len(entry)) - np.repeat(np.cumsum(each) - each, each)
                pair = row[entry] * n + a.of_token[a.start[token[entry]] + within] if len(entry) else np.zeros(0, np.int64)
                spread = lambda x: np.bincount(pair, x, m * n).reshape(m, n)
                common = np.bincount(pair, minlength=m * n).reshape(m, n) > 0
                coverage = spread(value[entry]) / np.maximum(0.01, a.whole)
                title = np.bincount(pair[in_title[entry]], minlength=m * n).reshape(m, n) > 0
                section = np.bincount(pair[in_section[entry]], minlength=m * n).reshape(m, n) > 0
                if a.alone:
                    own = np.array(block.column(5).to_pylist(), np.float64)[:, a.category]
                    score = 3.0 * coverage + (np.where(title, 0.8, 0.0) + np.where(section, 0.4, 0.0)) + (own + np.array([aimed(t) for t in titles]))
                    score = np.round(score, 9)
                    kept = score > 0
                else:
                    score, kept = coverage, common
                level_of = np.array(chapter, bool)
                if a.most is None:
                    r, q = np.nonzero(kept)
                    if out := told(q, score[r, q], block.column(0).take(pa.array(r)), coverage[r, q], title[r, q], section[r, q], level_of[r]):
                        yield out
                    continue
                name = np.array(ids)
                for level in held:
                    mine = np.flatnonzero(level_of == level)
                    r, q = np.nonzero(kept[mine] & (score[mine] >= floor[level]))
                    r = mine[r]
                    tied = np.flatnonzero(score[r, q] == floor[level][q])
                    late = [k for k in tied.tolist() if ids[r[k]] > last[level][q[k]]]
                    r, q = np.delete(r, late), np.delete(q, late)
                    if len(q):
                        held[level].append([q, score[r, q], name[r], coverage[r, q], title[r, q], section[r, q], level_of[r]])
                        size[level] += len(q)
                        if size[level] > max(MOST_HELD, 2 * n * a.most):
                            cut(level)
        for level in held:
            if held[level]:
                cut(level)
                if out := told(*held[level][0]):
                    yield out

    return run


def scored(index: Index, questions: DataFrame, tokens: str = "tokens", most: int | None = None, alone: bool = False) -> DataFrame:
    """Pairs of questions and chunks: q_id, chunk_id, coverage, in_title, in_section, score (9 decimals), chapter.

    Those with a common token, or, ``alone``, those with a positive score, for which bonuses count too
    (and the questions' ``isolated``, see ``retrieval.with_isolation``); with ``most``, that many of the best of a question for
    paragraphs and for chapters, ties to the smaller chunk_id. Tasks hold the best so far, so that no pair is
    shuffled that another of its task beats. Questions are sent to all tasks, MOST_QUESTIONS at once; without
    any, no chunk is read.
    """
    spark = index.chunks.sparkSession
    kind = dict(questions.dtypes)["q_id"]
    columns = ["q_id", *(["category", "targets"] if alone else []), *(["isolated"] if alone and "isolated" in questions.columns else [])]
    rows = questions.select(*columns).collect()
    schema = f"q_id {kind}, chunk_id string, coverage double, in_title boolean, in_section boolean, score double, chapter boolean"
    if not rows:
        return spark.createDataFrame([], schema).limit(0)
    told = weighed(index, questions, tokens).toArrow()
    average = index.totals.first()["avg_len"] or 1.0
    text = index.chunks.select("chunk_id", (F.col("chunk_level") == "chapter").alias("chapter"), F.lower("document_title").alias("title"), F.lower(F.coalesce("section_title", F.lit(""))).alias("section"), whole().alias("whole"), *(["own"] if alone else []))
    out = None
    for share in range(0, len(rows), MOST_QUESTIONS):
        some = rows[share : share + MOST_QUESTIONS]
        names = pa.array([r.q_id for r in some], told.schema.field("q_id").type)
        mine = told.filter(pa.compute.is_in(told.column("q_id"), names))
        found = text.mapInArrow(_pass(spark.sparkContext.broadcast(_Asked(some, mine, average, most, alone))), schema)
        out = found if out is None else out.unionByName(found)
    if most is None:
        return out
    order = Window.partitionBy("q_id", "chapter").orderBy(F.desc("score"), "chunk_id")
    return out.withColumn("nth__", F.row_number().over(order)).where(F.col("nth__") <= most).drop("nth__")


def of(chunks: DataFrame, pairs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The chunks that pairs name; pairs of a stated set of questions are few, and are sent to all tasks, not the chunks."""
    return chunks.join(F.broadcast(pairs.select(F.col(key).alias("chunk_id")).distinct()), "chunk_id", "left_semi")
