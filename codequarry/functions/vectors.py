"""Vector columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def cosine_to(embedding: Column, query: list[float], scaled: bool = False) -> Column:
    """Cosine similarity to one literal vector; null where the dimension differs or a norm is zero.

    One Arrow batch is one matrix-vector product; nothing but the vector column leaves the JVM.
    ``scaled`` gives ``max(0, 1 - distance / 2)`` instead.
    """
    wanted = np.asarray(query, dtype=np.float64)
    norm = float(np.sqrt(wanted @ wanted))

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        lists = vectors.cast(pa.list_(pa.float64()))
        lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        usable = lengths == len(wanted)
        result = np.full(len(lists), np.nan)
        if usable.any():
            flat = lists.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False)
            matrix = flat.reshape(-1, len(wanted))
            norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix)) * norm
            with np.errstate(divide="ignore", invalid="ignore"):
                result[usable] = (matrix @ wanted) / norms
        missing = ~np.isfinite(result)
        if scaled:
            result = np.maximum(0.0, 1.0 - (1.0 - result) / 2.0)
        return pa.array(result, mask=missing)

    # else a filter on the score is pushed below the projection and every vector is scored twice
    return score.asNondeterministic()(embedding)


def similarity_to(embedding: Column, query: list[float]) -> Column:
    """Cosine distance turned into a score between 0 and 1."""
    return cosine_to(embedding, query, scaled=True)


def hash_vector(text: Column, dimension: int = 768) -> Column:
    """A vector that depends only on the SHA-256 of the text: byte ``i mod 32`` scaled to [-1, 1].

    The 32 byte values are computed once and repeated, so the plan stays small for any dimension.
    """
    digest = F.sha2(text, 256)
    period = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: (F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int") / F.lit(255.0)) * 2 - 1,
    )
    repeats = -(-dimension // 32)
    return F.slice(F.flatten(F.array_repeat(period, repeats)), 1, dimension).cast("array<float>")


def hash_vector_of(text: str, dimension: int = 768) -> list[float]:
    """The same vector for one query text."""
    digest = hashlib.sha256(text.encode()).digest()
    return [float(np.float32((digest[i % 32] / 255.0) * 2 - 1)) for i in range(dimension)]
