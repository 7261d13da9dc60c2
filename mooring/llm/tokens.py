"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The folder of vocabulary files; every function takes another one as a parameter.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary's text is cut before merging (fixed value of the tokenizer).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(folder: str = TOKENIZERS):
    import tiktoken

    with open(f"{folder}/{VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, tokens: str = "tokens", keep_text: bool = False, folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the column ``tokens``: the size of its text, 0 where that is null or empty."""
    where = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if keep_text or c != text]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sizes, pa.int64())], names=[*(batch.schema.names[i] for i in kept), tokens])

    return df.mapInArrow(run, schema)
