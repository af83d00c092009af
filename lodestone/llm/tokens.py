"""Token ids of whole texts by the ``tokenizers`` library, and token counts.

``Encoder`` memoises the library's ids for each pre-token, which a byte-level BPE encodes by itself.
``count_tokens`` cuts huge documents into overlapping chunks (overlap resynchronisation).
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import Output, columns_of, rows_of, tidy

#: Texts of more characters than this are cut into overlapping chunks for counting.
CHUNK_CHARS = 32_768
#: Characters that neighbouring chunks share at first; doubled while they don't align.
OVERLAP_CHARS = 512
#: A pre-token that ends this close to a chunk's end may read otherwise in the whole text.
EDGE_CHARS = 48
#: Entries of the pre-token memo; a full memo is emptied.
MEMO_ENTRIES = 400_000
#: Texts are split for the memo in pieces of about so many characters.
PIECE_CHARS = 1 << 18

#: Characters outside these take the library's own splitting; inside, Python's classes equal it.
_ODD = re.compile("[^\x00-\x1b\x20-ɏ]")
#: The split of byte-level BPE, for the characters above: superscripts and fractions count as digits.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Between these two characters every text splits, whatever surrounds them.
_SAFE_CUT = re.compile(r"\S(?= \S)")


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text where its pre-tokens part anyway: before a single space between two other characters."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


@lru_cache(maxsize=4)
def library(path: str):
    """The library's tokenizer, single-threaded: Spark's tasks are the parallel part."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    shown = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def is_byte_level(tokenizer) -> bool:
    split = tokenizer.pre_tokenizer
    return type(split).__name__ == "ByteLevel" and not split.add_prefix_space and split.use_regex and tokenizer.normalizer is None


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the library's.

    A pre-token that isn't in the memo goes to the library's BPE model. Texts that hold one of the
    vocabulary's added tokens, or characters outside Latin script, are left to the library as a
    whole. Memory is bounded by the memo and one piece of a text.
    """

    def __init__(self, path: str):
        self.tokenizer = library(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.byte_level, self.model = is_byte_level(self.tokenizer), self.tokenizer.model
        self.memo: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(byte_alphabet())
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def pieces(self, text: str) -> Iterator[bytes]:
        for piece in safe_pieces(text) if self.byte_level else [text]:
            if not self.byte_level or _ODD.search(piece) or self.added and self.added.search(piece):
                yield array("I", self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()
                continue
            words = _SPLIT.findall(piece)
            parts = list(map(self.memo.get, words))
            if None in parts:
                if len(self.memo) > MEMO_ENTRIES:
                    self.memo.clear()
                for word in set(words).difference(self.memo):
                    self.memo[word] = self._word(word)
                parts = list(map(self.memo.__getitem__, words))
            yield b"".join(parts)

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(text))

    def count(self, text: str) -> int:
        return sum(map(len, self.pieces(text))) // 4


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _starts(encoding, at: int, limit: int) -> dict[int, int]:
    """Where pre-tokens start in the text, with the number of the chunk's tokens before each.

    Pre-tokens that end beyond ``limit`` are left out, and so is what follows them.
    """
    found: dict[int, int] = {}
    ends_at, word = 0, None
    for i, (w, (_, end)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if w is None or w != word:
            if at + ends_at > limit:
                break
            if i:
                found[at + ends_at] = i
            word = w
        ends_at = max(ends_at, end)
    return found


def spliced_count(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a huge text from overlapping chunks.

    A chunk that begins at a true pre-token start is true up to pre-tokens near its end. Where one
    of its starts is also a start inside the next chunk, the next chunk is true from there on: the
    split reads nothing to the left of a start. Without such a common start the overlap doubles, and
    at last the chunk itself does.
    """
    total, at, size = 0, 0, chunk
    while True:
        end = min(len(text), at + size)
        left = tokenizer.encode(text[at:end], add_special_tokens=False)
        if end == len(text):
            return total + len(left.ids)
        sure, width = _starts(left, at, end - EDGE_CHARS), overlap
        while width < end - at:
            begin = end - width
            right = tokenizer.encode(text[begin : end + overlap], add_special_tokens=False)
            common = sure.keys() & _starts(right, begin, end - EDGE_CHARS).keys()
            if common:
                break
            width *= 2
        else:
            size *= 2
            continue
        cut = max(common)
        total, at, size = total + sure[cut], cut, chunk


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from a text to its number of tokens, by the file's library."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(processor.encode(text, num_threads=1))
    tokenizer, memo = library(path), encoder(path)
    if not memo.byte_level:
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    from tokenizers import Tokenizer, processors

    spans = Tokenizer.from_str(tokenizer.to_str())
    spans.post_processor = processors.ByteLevel(trim_offsets=False)
    return lambda text: memo.count(text) if len(text) <= CHUNK_CHARS else spliced_count(spans, text)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text: doc_id, n_bytes, n_tokens.

    ``tokenizer`` is the path of a .json or .model file. A null text counts as empty: no bytes, no
    tokens. An empty table gives an empty result; repeated rows are counted each; other columns of
    the table are ignored. One narrow pass without a shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches):
        count, out = counter(tokenizer), Output(schema)
        for doc_id, text, size in rows_of(batches):
            if out.add(doc_id, count(text or ""), size):
                yield out.batch()
        yield out.batch()

    source = columns_of(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return source.mapInArrow(tidy(run), "doc_id long, n_tokens long, n_bytes long").select("doc_id", "n_bytes", "n_tokens")
