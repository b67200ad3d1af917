"""Sizes of texts in tokens of a public tokenizer, whose vocabulary stays outside the repository."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("MERGELOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Fixed value: how byte-level BPE vocabularies of this kind cut text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    ranks = {}
    for line in Path(vocabulary).read_bytes().splitlines():
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("public", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a text; none in null and empty ones."""
    return len(_encoding(vocabulary).encode_ordinary(text)) if text else 0


def with_tokens(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens`` of each document, counted over its whole ``text``; the text itself is dropped."""

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(vocabulary)
        for pdf in batches:
            counts = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["text"]]
            yield pdf[keep].assign(n_tokens=pd.Series(counts, index=pdf.index, dtype="int64"))

    picked = docs.select(*keep, F.col("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return picked.mapInPandas(sizes, f"{schema}, n_tokens long")
