"""Embedders: classes with `dims`, `embed(texts)` and `embed_query(text)`, run on Arrow batches.

An embedder is created once in each Python worker. `HashingEmbedder` needs no model: signed hashes of words, normalised.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashingEmbedder:
    def __init__(self, dims: int = 384) -> None:
        self.dims = dims

    def embed_query(self, text: str) -> list[float]:
        out = [0.0] * self.dims
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            out[h % self.dims] += 1.0 if h >> 16 & 1 else -1.0
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


#: Embedders by name; `register` adds to them.
EMBEDDERS: dict[str, type] = {"hashing": HashingEmbedder}


def register(name: str, kind: type) -> None:
    EMBEDDERS[name] = kind


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding", batch: int = 50) -> DataFrame:
    """df with the vectors of a text column; a null text counts as empty. At most `batch` texts go to the embedder at once."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            own = ["" if t is None else t for t in texts]
            yield pd.Series([v for k in range(0, len(own), batch) for v in embedder.embed(own[k : k + batch])], dtype=object)

    return df.withColumn(out, vectors(F.col(text)))
