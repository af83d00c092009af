"""Functions for SQL: the chunker and the tokeniser as table functions, the rest as scalar ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Words of a chunk, and of the step from one chunk to the next.
CHUNK_WORDS, STEP_WORDS = 180, 145
_TOKEN = re.compile("[A-Za-z0-9]+|[一-鿿]+")
_LATIN, _IDEOGRAPH = re.compile("[A-Za-z0-9]+"), re.compile("[一-鿿]")


def tokens_of(text: str | None) -> list[str]:
    """Lower-case words of letters and digits; a run of ideographs and its pairs."""
    text = text or ""
    if text.isascii() or not _IDEOGRAPH.search(text):
        return "\n".join(found).lower().split("\n") if (found := _LATIN.findall(text)) else []
    out: list[str] = []
    for token in _TOKEN.findall(text):
        out += [token.lower()] if token[0].isascii() else [token] if len(token) <= 2 else [token, *(token[k : k + 2] for k in range(len(token) - 1))]
    return out


class Chunks:
    """chunks(text): overlapping windows of words, numbered from 1; a short text is one window, as it is."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        words = (text or "").split()
        if len(words) <= CHUNK_WORDS:
            if words:
                yield 1, text
            return
        at, number = 0, 1
        while True:
            yield number, " ".join(words[at : at + CHUNK_WORDS])
            if at + CHUNK_WORDS >= len(words):
                return
            at, number = at + STEP_WORDS, number + 1


class Tokens:
    """tokens(text): the tokens that the index holds, in their order."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        yield from enumerate(tokens_of(text))


def register(spark: SparkSession, model=None) -> None:
    """Make lodestone_chunks and lodestone_tokens (table functions), lodestone_token_count and, with a model of prompts, lodestone_answer known to SQL."""
    spark.udtf.register("lodestone_chunks", F.udtf(Chunks, returnType="chunk_index int, chunk string"))
    spark.udtf.register("lodestone_tokens", F.udtf(Tokens, returnType="place int, token string"))
    spark.udf.register("lodestone_token_count", F.pandas_udf(lambda texts: texts.map(lambda t: len(tokens_of(t))).astype("int64"), "long"))
    if model is not None:
        spark.udf.register("lodestone_answer", F.pandas_udf(lambda prompts: pd.Series(model(prompts)), "string"))
