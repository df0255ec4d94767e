"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file, a parameter of every caller: the public byte-level BPE ``byte_bpe_multi_50k`` for
#: many languages, 50,256 ids. Executors read it at this path, or as shipped by ``SparkContext.addFile``.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the tokenizer cuts a text before merging. Fixed value of that public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file, loaded once for each Python worker."""
    if path not in _loaded:
        there = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        with open(there, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("korrel", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count(text: str | None, path: str = VOCABULARY) -> int:
    """The number of tokens of ``text``, 0 for null."""
    if not text:
        return 0
    return len(encoding(path).encode_ordinary(text))


def with_token_counts(documents: DataFrame, text: str = "text", path: str = VOCABULARY, into: str = "n_tokens") -> DataFrame:
    """``documents`` with the number of tokens of a text column."""

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        encode = enc._core_bpe.encode_ordinary  # without the wrapper, a third of the time

        def n_tokens(t: str | None) -> int:
            try:
                return len(encode(t)) if t else 0
            except UnicodeEncodeError:  # lone surrogates
                return len(enc.encode_ordinary(t))

        for b in batches:
            yield pd.Series([n_tokens(t) for t in b], dtype="int64")

    return documents.withColumn(into, counts(F.col(text)))
