"""Embedders: what turns a symbol's text and a query into vectors.

An embedder has a name, a number of dimensions, available(), and vectors(texts).  The built-in
one hashes tokens and needs no model; a model's comes in where its package is installed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomgraph.session import ship


class Embedder(Protocol):
    name: str
    dims: int

    def available(self) -> bool: ...

    def vectors(self, texts: list[str]) -> np.ndarray: ...


class HashedTokens:
    """Tokens and their letter triples, each added to a dimension that its hash names, with a
    sign; vectors have length 1, those of texts without a token 0."""

    name = "hashed-tokens"

    def __init__(self, dims: int = 384):
        self.dims = dims

    def available(self) -> bool:
        return True

    def vectors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            for token in re.findall(r"[a-z]+|[0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text or "").lower()):
                around = f"^{token}$"
                for part, weight in ((token, 1.0), *((around[k : k + 3], 0.3) for k in range(len(around) - 2))):
                    h = zlib.crc32(part.encode())
                    row[h % self.dims] += weight if h >> 31 else -weight
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(lengths > 0, lengths, 1)


class SentenceModel:
    """A sentence model of the fastembed package, loaded once a process; not available without it."""

    name = "BAAI/bge-small-en-v1.5"
    dims = 384
    _models: dict = {}

    def available(self) -> bool:
        try:
            import fastembed  # noqa: F401
        except ImportError:
            return False
        return True

    def vectors(self, texts: list[str]) -> np.ndarray:
        if self.name not in self._models:
            from fastembed import TextEmbedding

            self._models[self.name] = TextEmbedding(self.name)
        return np.array(list(self._models[self.name].embed(texts)), np.float32).reshape(len(texts), self.dims)


def embedded(texts: DataFrame, embedder: Embedder) -> DataFrame:
    """(qualified_name, vec) of (qualified_name, text), batch by batch where the rows lie."""
    ship(texts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"qualified_name": f["qualified_name"], "vec": list(embedder.vectors(f["text"].fillna("").tolist()))})

    return texts.select("qualified_name", "text").mapInPandas(run, "qualified_name string, vec array<float>")
