"""Token counts of a public tokenizer (byte-level BPE ranks read from a file).

The file is a parameter: the conf `lexmill.tokenizer`, else the environment variable
LEXMILL_TOKENIZER, else DEFAULT.  It must be readable at that path on every node.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Pre-token pattern of byte-level BPE vocabularies (fixed value, published with them).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(spark: SparkSession) -> str:
    return spark.conf.get("lexmill.tokenizer", None) or os.environ.get("LEXMILL_TOKENIZER") or DEFAULT


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def clean(text: str) -> str:
    """Lone surrogates cannot be encoded; they count as the replacement character."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def encode(enc, text: str) -> list[int]:
    try:
        return enc.encode_ordinary(text)
    except UnicodeEncodeError:
        return enc.encode_ordinary(clean(text))


def as_utf8(text: str) -> bytes:
    try:
        return text.encode("utf-8")
    except UnicodeEncodeError:
        return clean(text).encode("utf-8")


def encode_array(enc, text: str) -> np.ndarray:
    try:
        return enc.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    except UnicodeEncodeError:
        return enc.encode_to_numpy(clean(text), disallowed_special=()).astype(np.int64)


_LENGTHS: dict[int, np.ndarray] = {}


def byte_lengths(enc) -> np.ndarray:
    """Bytes of every token of the vocabulary."""
    if id(enc) not in _LENGTHS:
        _LENGTHS.clear()
        _LENGTHS[id(enc)] = np.array([len(enc.decode_single_token_bytes(t)) for t in range(enc.max_token_value + 1)], dtype=np.int64)
    return _LENGTHS[id(enc)]


def counter(path: str):
    """Function for mapInArrow: the last column (text) becomes its number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            n = np.fromiter((len(encode(enc, t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()), dtype=np.int32, count=batch.num_rows)
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[*names, "tokens"])

    return count


def counted(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """`columns` of df and `tokens`, the size of `text` (0 for null)."""
    picked = df.select(*columns, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in columns)
    return picked.mapInArrow(counter(tokenizer_path(df.sparkSession)), f"{kinds}, tokens int")
