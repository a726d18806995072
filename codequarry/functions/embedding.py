"""Embedding models: which exist, and how a text column becomes vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import vectors

BATCH = 32
#: A longer text is read by a local model in windows of so many characters, each sharing so many with the one before.
WINDOW, SHARED = 2000, 200


def dimension(model: str) -> int:
    return fixed.EMBEDDING_DIMENSIONS.get(model, 768)


def is_local(model: str) -> bool:
    return model == "mock" or model in fixed.LOCAL_MODELS


def require_local(model: str) -> str:
    """Refuse models that would send texts elsewhere."""
    if not is_local(model):
        raise ValueError(f"{model} is not a local model")
    return model


def windows(text: str) -> list[str]:
    """The parts of a text that a model reads one by one; every character lies in one at least."""
    return [text[at : at + WINDOW] for at in range(0, max(len(text) - SHARED, 1), WINDOW - SHARED)]


def encoded(texts: list[str], encode: Callable[[list[str]], np.ndarray]) -> list[list[float]]:
    """A unit vector for each whole text: the mean of its windows' vectors, weighed by their lengths."""
    parts = [windows(t) for t in texts]
    flat = [w for own in parts for w in own]
    if not flat:
        return []
    found = np.asarray(encode(flat), dtype=np.float64) * np.array([max(len(w), 1) for w in flat])[:, None]
    sums = np.add.reduceat(found, np.cumsum([0, *(len(own) for own in parts[:-1])]))
    norms = np.sqrt(np.einsum("ij,ij->i", sums, sums))
    return (sums / np.where(norms > 0, norms, 1.0)[:, None]).astype(np.float32).tolist()


def _load(model: str):
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as missing:
        raise RuntimeError(f"{model} needs the sentence-transformers package; use the mock model without it") from missing
    return SentenceTransformer(model)


def vectors_of(text: Column, model: str) -> Column:
    """Vectors of a text column, whole texts. The hash model is plain columns; a local model loads once per worker."""
    if model == "mock":
        return vectors.hash_vector(text, dimension(model))
    require_local(model)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        loaded = _load(model)
        for texts in batches:
            yield pd.Series(encoded(texts.fillna("").tolist(), lambda parts: loaded.encode(parts, batch_size=BATCH, normalize_embeddings=True)))

    return encode(text)


def vector_of(text: str, model: str) -> list[float]:
    """The vector of one query text."""
    if model == "mock":
        return vectors.hash_vector_of(text, dimension(model))
    require_local(model)
    loaded = _load(model)
    return encoded([text], lambda parts: loaded.encode(parts, batch_size=BATCH, normalize_embeddings=True))[0]
