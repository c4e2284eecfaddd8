"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level vocabulary in tiktoken's format: a token in base64 and its rank on each line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that cuts a text into pieces before byte pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODINGS: dict[int, object] = {}


def encoding(vocabulary: bytes) -> object:
    """The encoder for the vocabulary file's content, built once in a process."""
    import tiktoken

    if (k := hash(vocabulary)) not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        _ENCODINGS[k] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[k]


def count_tokens(text: str, enc: object) -> int:
    """The number of tokens of a whole text."""
    return len(enc.encode_ordinary(text))


def sized(documents: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, tokens) of every document with a non-null doc_id and text; an empty text has 0 tokens.

    The vocabulary is read on the driver and broadcast: a file of fixed size, under a megabyte.
    """
    spark = documents.sparkSession
    content = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    kinds = dict(documents.dtypes)
    cols = ["doc_id", *keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(content.value)
        for b in batches:
            yield b[cols].assign(tokens=[count_tokens(t, enc) for t in b["text"]])

    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(*cols, "text")
    return rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", tokens int")
