"""Sizes of documents in tokens of a public tokenizer, read from the vocabulary files of the machine."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every query that counts tokens.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):  # noqa: ANN201
    """A rank file's encoder, one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, *keep: str, folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, keep..., tokens): whole texts counted in Arrow batches; null and empty texts have 0 tokens."""
    path = f"{folder}/{vocabulary}"
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *keep, F.col(text).alias("text"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", *keep)] + [pa.array(sizes, pa.int64())], ["doc_id", *keep, "tokens"])

    return kept.mapInArrow(count, ", ".join(f"`{c}` {types[c]}" for c in ("doc_id", *keep)) + ", tokens long")
