"""Quality classifier: a byte-level convolutional network in numpy over whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import columns_of, rows_where, slices, tidy

#: Bytes of a step, steps that a filter reads, steps of half a chunk; values of a byte, filters, units.
STEP, READ, HALF, DEPTH, FILTERS, UNITS = 4, 3, 32, 6, 24, 16
HALF_BYTES, TAIL = STEP * HALF, STEP * (READ - 1)
#: Longer texts are scored in segments of so many bytes that overlap by half a chunk.
SEGMENT = 64 * 1024
#: Bytes that the network runs over at once.
RUN_BYTES = 512 * 1024
#: The training sample: labelled rows of each class at most, and characters of one. A longer text is
#: represented by so many passages, spread evenly from its beginning to its end.
SAMPLE_ROWS, SAMPLE_CHARS, PASSAGES = 2_000, 12 * 1024, 4
EPOCHS, BATCH, RATE = 14, 32, 4e-3
#: Scores of at least this are predicted to be good.
THRESHOLD = 0.3


def segments(text: bytes) -> list[bytes]:
    """The whole text in overlapping segments, at least one."""
    step = SEGMENT - HALF_BYTES
    return [text[at : at + SEGMENT] for at in range(0, max(1, len(text) - HALF_BYTES), step)]


class Layout:
    """Segments in one array: each padded to whole half chunks, with a filter's length of padding at least.

    ``last`` are the segments' last half chunks: the filters' last places there would read the next segment.
    """

    def __init__(self, parts: list[bytes]):
        sizes = [-(-(len(part) + TAIL) // HALF_BYTES) * HALF_BYTES for part in parts]
        self.data = np.frombuffer(b"".join(part.ljust(size, b"\0") for part, size in zip(parts, sizes, strict=True)) + bytes(TAIL), np.uint8)
        self.of = np.array(sizes) // HALF_BYTES
        self.halves = int(self.of.sum())
        ends = np.cumsum(self.of)
        self.first = ends - self.of
        self.last = ends - 1
        self.next = np.arange(1, self.halves + 1)
        self.next[self.last] = self.last  # the last half chunk of a segment stands alone


class Net:
    """Byte values, filters, maximum over overlapping chunks, units, then maximum and mean over the text."""

    NAMES = ("values", "filters", "filter_bias", "units", "unit_bias", "out_max", "out_mean", "out_bias")

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.values = normal(256, DEPTH, scale=0.5)
        self.filters = normal(READ, STEP * DEPTH, FILTERS, scale=(2 / (READ * STEP * DEPTH)) ** 0.5)
        self.filter_bias = np.zeros(FILTERS, np.float32)
        self.units = normal(FILTERS, UNITS, scale=(2 / FILTERS) ** 0.5)
        self.unit_bias = np.zeros(UNITS, np.float32)
        self.out_max, self.out_mean = normal(UNITS, scale=0.2), normal(UNITS, scale=0.2)
        self.out_bias = np.zeros(1, np.float32)
        self.shift = 0.0

    def forward(self, layout: Layout) -> dict[str, np.ndarray]:
        """What each layer finds; ``most`` and ``total`` pool the units over each segment's chunks."""
        steps = self.values[layout.data].reshape(-1, STEP * DEPTH)
        n = layout.halves * HALF
        found = steps[:n] @ self.filters[0]
        for k in range(1, READ):
            found += steps[k : n + k] @ self.filters[k]
        found = found.reshape(layout.halves, HALF, FILTERS)
        found[layout.last, HALF - READ + 1 :] = -np.inf
        half = np.maximum(found.max(axis=1) + self.filter_bias, 0)
        chunk = np.maximum(half, half[layout.next])
        unit = np.maximum(chunk @ self.units + self.unit_bias, 0)
        most, total = np.maximum.reduceat(unit, layout.first, axis=0), np.add.reduceat(unit, layout.first, axis=0)
        return {"steps": steps, "found": found, "half": half, "chunk": chunk, "unit": unit, "most": most, "total": total}

    def logit(self, most: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return most @ self.out_max + mean @ self.out_mean + self.out_bias[0]

    def backward(self, layout: Layout, kept: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients from the slope of the loss by each segment's logit; only maxima pass it on."""
        unit, half, chunk = kept["unit"], kept["half"], kept["chunk"]
        text = np.repeat(np.arange(len(slope)), layout.of)
        mean = kept["total"] / layout.of[:, None]
        grad = {"out_max": kept["most"].T @ slope, "out_mean": mean.T @ slope, "out_bias": slope.sum(keepdims=True)}
        is_most = unit == kept["most"][text]
        by_unit = (slope / layout.of)[text][:, None] * self.out_mean + is_most * slope[text][:, None] * self.out_max
        by_unit *= unit > 0
        grad["units"], grad["unit_bias"] = chunk.T @ by_unit, by_unit.sum(axis=0)
        by_chunk = by_unit @ self.units.T
        first = half >= half[layout.next]
        by_half = by_chunk * first
        np.add.at(by_half, layout.next, by_chunk * ~first)
        by_half *= half > 0
        grad["filter_bias"] = by_half.sum(axis=0)
        at = kept["found"].argmax(axis=1) + HALF * np.arange(layout.halves)[:, None]
        grad["filters"], by_value = np.zeros_like(self.filters), np.zeros((256, DEPTH), np.float32)
        for k in range(READ):
            read = kept["steps"][at + k]
            grad["filters"][k] = np.einsum("hfd,hf->df", read, by_half)
            back = (by_half[:, :, None] * self.filters[k].T[None]).reshape(-1, DEPTH)
            places = ((at + k)[:, :, None] * STEP + np.arange(STEP)).reshape(-1)
            read_bytes = layout.data[places]
            for d in range(DEPTH):
                by_value[:, d] += np.bincount(read_bytes, back[:, d], 256)
        grad["values"] = by_value
        return grad

    def fit(self, texts: list[bytes], labels: np.ndarray, share: float, seed: int = 11) -> Net:
        """Train by Adam on equally weighted classes; ``share`` of good rows then shifts the score."""
        rng, moments, step = np.random.default_rng(seed), {}, 0
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        for epoch in range(EPOCHS):
            order = rng.permutation(len(texts))
            for b in range(0, len(order), BATCH):
                rows = order[b : b + BATCH]
                layout = Layout([texts[r] for r in rows])
                kept = self.forward(layout)
                logit = self.logit(kept["most"], kept["total"] / layout.of[:, None])
                slope = ((sigmoid(logit) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                step += 1
                rate = RATE * (1 - epoch / EPOCHS) + 1e-4
                for name, g in self.backward(layout, kept, slope).items():
                    m, v = moments.get(name, (0.0, 0.0))
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    moments[name] = (m, v)
                    change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    setattr(self, name, (getattr(self, name) - change).astype(np.float32))
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.shift = float(np.log(share / (1 - share)))
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        """One probability for each text; segments are run some at a time and pooled by text."""
        most, total, count = np.zeros((len(texts), UNITS)), np.zeros((len(texts), UNITS)), np.zeros(len(texts))
        parts, owners, held = [], [], 0

        def run():
            layout = Layout(parts)
            kept = self.forward(layout)
            np.maximum.at(most, owners, kept["most"])
            np.add.at(total, owners, kept["total"])
            np.add.at(count, owners, layout.of)

        for owner, text in enumerate(texts):
            for part in segments(text):
                parts.append(part)
                owners.append(owner)
                held += len(part) + HALF_BYTES
                if held >= RUN_BYTES:
                    run()
                    parts, owners, held = [], [], 0
        if parts:
            run()
        return sigmoid(self.logit(most, total / np.maximum(count, 1)[:, None]) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fold(id_col: Column, folds: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def _sample(text: Column) -> Column:
    """A text of up to SAMPLE_CHARS characters, or PASSAGES evenly spread passages of a longer one."""
    n, size = F.char_length(text), SAMPLE_CHARS // PASSAGES
    passages = [F.substring(text, (F.floor((n - size) * k / (PASSAGES - 1)) + 1).cast("int"), F.lit(size)) for k in range(PASSAGES)]
    return F.when(n <= SAMPLE_CHARS, text).otherwise(F.concat(*passages))


def learned(docs: DataFrame, labels: DataFrame, keep_out: Column) -> Net | None:
    """A network from a bounded sample of labelled rows for which ``keep_out`` is false.

    At most SAMPLE_ROWS ids of each class are drawn by a hash, and their texts are collected, those
    of more than SAMPLE_CHARS characters as passages. Of repeated labels the lowest counts, of
    repeated ids the least text. None if a class has no rows.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~keep_out).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    drawn = [tuple(r) for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).collect()]
    if len(counts) < 2:
        return None
    ids = spark.createDataFrame(drawn, "doc_id long, quality int")
    rows = docs.where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min(_sample(F.col("text"))).alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    target = np.array([r.quality for r in rows])
    if len(set(target.tolist())) < 2:
        return None
    return Net().fit([r.text.encode() for r in rows], target, counts[1] / sum(counts.values()))


def scored(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id and the score of each whole text; a null text is empty. Without a network all scores are 0.5.

    Repeated rows are scored each; an empty table gives no rows. A task holds one slice of a batch.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in slices(batches):
            texts = [(text or "").encode() for text in batch.column(1).to_pylist()]
            score = net.score(texts) if net and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], schema=schema)

    return docs.mapInArrow(tidy(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, keep_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's score, from 0 to 1 and higher where label 1 is likelier, and predicted: doc_id, score, predicted.

    ``keep_out`` marks rows of ``labels`` that aren't learned from. Null and empty texts are scored as
    no bytes. Repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    docs = columns_of(docs, id_col, text_col)
    docs = docs.select(docs.doc_id.cast("long"), "text")
    net = learned(docs, labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")), F.lit(False) if keep_out is None else keep_out)
    return scored(docs, net).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted to be good, with all their columns; all, if nothing can be learned.

    A null text is scored as an empty one. Repeated rows are judged each; an empty table stays empty.
    """
    plain = docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").alias("text"))
    net = learned(plain, labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")), F.lit(False))
    if net is None:
        return docs
    return rows_where(docs, "text", lambda texts: (net.score([(text or "").encode() for text in texts]) >= THRESHOLD).tolist())
