"""The whole pipeline and the classifier's score, held against plain versions of every stage."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_joins import distance, expected
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import bytenet, langid, lines, packing


def plain_score(net, text):
    """The network over one text, step by step and chunk by chunk."""
    data = text.encode()
    halves = -(-(len(data) + bytenet.TAIL) // bytenet.HALF_BYTES)
    data = data.ljust(halves * bytenet.HALF_BYTES + bytenet.TAIL, b"\0")
    read = lambda step: np.concatenate([net.values[b] for b in data[step * bytenet.STEP : (step + 1) * bytenet.STEP]]).astype(float)
    half = []
    for h in range(halves):
        places = range(bytenet.HALF - (bytenet.READ - 1) * (h == halves - 1))
        found = [sum(read(h * bytenet.HALF + s + k) @ net.filters[k] for k in range(bytenet.READ)) for s in places]
        half.append(np.maximum(np.max(found, axis=0) + net.filter_bias, 0))
    units = [np.maximum(np.maximum(half[h], half[min(h + 1, halves - 1)]) @ net.units + net.unit_bias, 0) for h in range(halves)]
    logit = np.max(units, axis=0) @ net.out_max + np.mean(units, axis=0) @ net.out_mean + net.out_bias[0] + net.shift
    return 1 / (1 + np.exp(-logit))


def test_scores_equal_the_plain_network():
    net = bytenet.Net(seed=3)
    net.shift = 0.4
    texts = ["", "a", "é" * 70, "some words " * 30, "x" * bytenet.HALF_BYTES, "#$% " * 200]
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(net.score([t.encode() for t in texts]), want, atol=1e-5)
    assert np.allclose(net.score([t.encode() for t in texts[::-1]])[::-1], want, atol=1e-5)


def test_long_texts_train_by_passages(spark, docs):
    long = "".join(f"{k:06d} " for k in range(9000))
    got = docs(long, "short").select(bytenet._sample(F.col("text")).alias("s")).collect()
    assert got[1].s == "short" and len(got[0].s) == bytenet.SAMPLE_CHARS
    size = bytenet.SAMPLE_CHARS // bytenet.PASSAGES
    assert got[0].s.startswith(long[:size]) and got[0].s.endswith(long[-size:])


def ngrams(text):
    found = Counter()
    data = langid.letters(text).encode()
    for n in (1, 2, 3):
        for k in range(len(data) - n + 1):
            if data[k : k + n] != b" ":
                found[data[k : k + n]] += 1
    return found


def ranked(found):
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][: langid.PROFILE]


def plain_language(docs):
    counts = defaultdict(Counter)
    for d in docs:
        if d["lang"] and d["text"]:
            counts[d["lang"]] += ngrams(d["text"])
    profiles = {name: {g: k for k, g in enumerate(ranked(c))} for name, c in counts.items() if c}
    for d in docs:
        mine = ranked(ngrams(d["text"]))
        saved = [sum(langid.PROFILE - min(abs(p[g] - k), langid.PROFILE) for k, g in enumerate(mine) if g in p) / (langid.PROFILE * max(1, len(mine))) for p in profiles.values()]
        if max(saved) >= langid.LEAST_SAVED:
            yield d


def plain_lines(docs):
    places = defaultdict(list)
    for d in docs:
        for k, line in enumerate((d["text"] or "").split("\n")):
            if line.strip():
                places[line].append((d["doc_id"], k))
    order, near = sorted((min(p), line) for line, p in places.items()), {}
    bags = {line: Counter(line) for line in places}
    for k, (_, line) in enumerate(order):
        if len(line) >= lines.LEAST_CHARS:
            for _, other in order[:k]:
                if len(other) >= lines.LEAST_CHARS and abs(len(line) - len(other)) <= 2 and sum(((bags[line] - bags[other]) + (bags[other] - bags[line])).values()) <= 4 and distance(line, other) <= 2:
                    near[line] = True
                    break
    for d in docs:
        kept = [line for k, line in enumerate((d["text"] or "").split("\n")) if not line.strip() or line not in near and min(places[line]) == (d["doc_id"], k)]
        text = "\n".join(kept)
        if text == (d["text"] or "") or text.strip():
            yield d | {"text": text, "n_chars": len(text)}


def test_run_equals_a_plain_pipeline(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    net = bytenet.learned(table, spark.read.parquet(f"{data}/labels.parquet"), F.lit(False))
    docs = [r.asDict() for r in table.collect()]
    docs = [d for d in docs if plain_score(net, d["text"] or "") >= bytenet.THRESHOLD]
    docs = list(plain_lines(list(plain_language(docs))))
    found = expected([d["text"] for d in docs])
    smallest = {}
    for k, (_, group, _) in found.items():
        smallest[group] = min(smallest.get(group, docs[k]["doc_id"]), docs[k]["doc_id"])
    docs = {d["doc_id"]: d["text"] for k, d in enumerate(docs) if smallest[found[k][1]] == d["doc_id"]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0] for i, text in docs.items()}

    pieces, windows = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, data).collect():
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        windows[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4
    assert {i: [x for _, part in sorted(p) for x in part] for i, p in pieces.items()} == want
    for parts in windows.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert ends[:-1].tolist() == [at for at, _ in sorted(parts)] and ends[-1] <= 1024


def test_padding_does_not_depend_on_partitions(spark, data):
    table = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    for n in (1, 211):
        rows = packing.pack_documents(table.repartition(n), public_tokenizers.path("byte_bpe_50k.json")).drop("ids").toPandas()
        assert rows.length.sum() / (1024 * rows.sequence_id.nunique()) >= 0.99
        used = rows.groupby("sequence_id").length.sum()
        assert used.max() <= 1024 and (rows.groupby("sequence_id").offset.count() == rows.drop_duplicates(["sequence_id", "offset"]).groupby("sequence_id").offset.count()).all()
