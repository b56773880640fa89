"""Vectors: hashed embeddings, cosine, pooling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_counts(texts: list[str | None], dim: int = 384, most: int = 10_000) -> np.ndarray:
    """How many of a text's first ``most`` runs of four bytes are hashed into each bucket; zeros for texts of fewer bytes.

    The store's fallback embedding reads no more than that of a text; ``most`` is its parameter.
    """
    out = np.zeros((len(texts), dim), np.float32)
    for k, text in enumerate(texts):
        b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
        n = min(len(b) - 3, most)
        if n > 0:
            out[k] = np.bincount((((b[:n] * 31 + b[1 : n + 1]) * 31 + b[2 : n + 2]) * 31 + b[3 : n + 3]) % dim, minlength=dim)
    return out


def hash_embeddings(texts: list[str | None], dim: int = 384, most: int = 10_000) -> np.ndarray:
    """``hashed_counts`` to length one; zeros stay zeros."""
    counts = hashed_counts(texts, dim, most).astype(np.float64)
    norm = np.sqrt((counts * counts).sum(1, keepdims=True))
    return counts / np.where(norm > 0, norm, 1)


def hash_counts(text: Column, dim: int = 384) -> Column:
    """``hashed_counts`` in Arrow batches: small whole numbers, which take little room in a file."""

    @F.pandas_udf("array<float>")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hashed_counts(texts.tolist(), dim)))

    return count(text)


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """``hash_embeddings`` in Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_embeddings(texts.tolist(), dim)))

    return embed(text)


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite values, not all zero; false for null."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce((F.size(vector) == dim) & good, F.lit(False))


def embedded(df: DataFrame, vec_col: str, text_col: str, dim: int = 384) -> DataFrame:
    """``df`` with ``v``, the given vector where it is usable and the hashed embedding of the text elsewhere, and with ``hashed``, which of them it is. Only the texts of the latter are hashed."""
    stored = df.filter(usable(F.col(vec_col), dim)).withColumn("v", F.col(vec_col).cast("array<double>")).withColumn("hashed", F.lit(False))
    rest = df.filter(~usable(F.col(vec_col), dim)).withColumn("v", hash_embedding(F.coalesce(text_col, F.lit("")), dim)).withColumn("hashed", F.lit(True))
    return stored.unionByName(rest)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double precision."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for null, different lengths or a vector of zeros."""
    of = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (of > 0), dot(a, b) / of).otherwise(F.lit(0.0))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask isn't 0, to length one; zeros where the mask hides all."""
    width = F.size(F.element_at(vectors, 1))
    kept = F.zip_with(vectors, mask, lambda v, m: F.when(m != 0, v))
    zeros = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(kept, zeros, lambda s, v: F.when(v.isNull(), s).otherwise(F.zip_with(s, v, lambda x, y: x + y.cast("double"))))
    n = F.greatest(_sum(F.transform(mask, lambda m: F.when(m != 0, 1.0).otherwise(0.0))), F.lit(1e-6))
    mean = F.transform(total, lambda x: x / n)
    return F.transform(mean, lambda x: x / F.greatest(F.sqrt(dot(mean, mean)), F.lit(1e-12)))
