from __future__ import annotations

import random
from array import array
from zlib import crc32

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe, entry, packing, tokens

JSON, RANKS = entry.tokenizer_file("byte_bpe_50k.json"), entry.tokenizer_file("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|>b  c", "²a b½ 3²", "it's 're I'll   ", "a b \x1cq", "日本 語x", "_a_ b__", "\x85 x", "word " * 3000]
TEXT = st.text(alphabet=st.sampled_from(list(" ab'sre\n1²é_.\t\x1c\x85ÿ日")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_equal_the_library(text):
    assert tokens.encoder(JSON).encode(text) == array("I", tokens.library(JSON).encode(text, add_special_tokens=False).ids).tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["  ", " ", "a", "abc", "'re", "\n\n", "12", "<|endoftext|>", "é", "x" * 30, "...", "日本"]), max_size=200))
def test_spliced_chunks_count_as_the_whole(parts):
    from tokenizers import Tokenizer, processors

    spans = Tokenizer.from_file(JSON)
    spans.post_processor = processors.ByteLevel(trim_offsets=False)
    text = "".join(parts)
    assert tokens.spliced_count(spans, text, 100, 20) == len(tokens.library(JSON).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_each_library(spark, docs, name):
    path = entry.tokenizer_file(name)
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs(*ODD), path).collect()}
    count = tokens.counter(path)
    assert found == {k: (len((t or "").encode()), count(t or "")) for k, t in enumerate(ODD)}
    assert tokens.count_tokens(docs(*ODD).limit(0), path).count() == 0


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.codec(RANKS, bpe.PATTERN).ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(spark, docs, reference):
    random.seed(1)
    texts = [*ODD, "".join(random.choice("abcde") for _ in range(5000)), "a" * 9000, *("".join(random.choice([" ", "the", "ing", "é", "日", "'s", "\n", "aa"]) for _ in range(50)) for _ in range(100))]
    found = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in bpe.decode_ids(bpe.encode_texts(docs(*texts), RANKS), RANKS).collect()}
    assert found == {k: (reference.encode_ordinary(t or ""), (t or "").encode()) for k, t in enumerate(texts)}


def test_decoding_keeps_nulls_and_refuses_unknown_ids(spark):
    encoded = spark.createDataFrame([(1, None), (2, [0, 1]), (3, [])], "doc_id long, ids array<int>")
    found = {r.doc_id: r.decoded for r in bpe.decode_ids(encoded, RANKS).collect()}
    assert found[1] is None and len(found[2]) == 2 and found[3] == b""
    with pytest.raises(Exception, match="ranks"):
        bpe.decode_ids(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), RANKS).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_takes_the_tightest_window(lengths):
    placed, room = packing.best_fit_decreasing(lengths, 64), {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        window, offset = placed[k]
        fitting = [r for r in room.values() if r >= lengths[k]]
        assert (room.get(window, 64) == min(fitting)) if fitting else window not in room
        assert offset == 64 - room.get(window, 64)
        room[window] = room.get(window, 64) - lengths[k]


def test_packed_pieces_are_whole(spark, docs):
    texts = [*ODD, "some words " * 900, "dup", "dup"]
    rows = packing.pack_documents(docs(*texts), JSON, window=256).collect()
    encode, by_doc, by_sequence = tokens.encoder(JSON).encode, {}, {}
    for r in rows:
        assert r.length == len(r.ids) // 4 and crc32(r.ids) >= 0
        by_doc.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, t in enumerate(texts):
        whole = encode(t or "") + bytes(4)
        assert b"".join(x[1] for x in sorted(by_doc[k])) == whole and {x[2] for x in by_doc[k]} == {len(whole) // 4}
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(docs(*texts).limit(0), JSON).count() == 0
