"""Token counts by a public tokenizer: batches in Arrow functions that return lengths only.

Texts are cut at ASCII white space. That is a safe boundary for this kind of tokenizer: its
normaliser and its splitting pattern drop white space and no merge reaches across it, so the count
of a text is the sum of its words' counts (tested against the library on whole texts). Each distinct
word of a byte-balanced batch is encoded once by the library's batch encoder.

Defined results: null counts as the empty text (0 bytes, 0 tokens); rows stay one to one, repeated
rows included; other columns of the input are not looked at.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import Memo, as_strings, distinct, held, per_text, slices, split_words

MODEL = "word_bpe_49k.json"


class WordCounter:
    """Numbers of tokens of texts, for a tokenizer whose tokens never hold white space."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = model if os.path.isabs(model) else public_tokenizers.path(model)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = Memo(self._encode)

    def _encode(self, items: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def count(self, texts: pa.Array) -> np.ndarray:
        flat, offsets = split_words(texts)
        vocabulary, index = distinct(flat)
        counts = np.array(self.memo(vocabulary.to_pylist()), dtype=np.int64)
        return per_text(counts[index], offsets)


def count_tokens(text: Column, model: str = MODEL) -> Column:
    """Number of tokens of each text, without special tokens."""

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        counter = held(("tokens", model), lambda: WordCounter(model))
        texts = as_strings(texts)
        parts = [counter.count(texts.slice(a, b - a)) for a, b in slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return counted(text)


def token_counts(
    docs: DataFrame, limit: int, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every whole text."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        count_tokens(text, model).alias("n_tokens"),
    )
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
