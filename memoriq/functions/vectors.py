"""Vector functions as column expressions. Vectors are array<float>; arithmetic is double."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where the lengths differ, a side is null or empty, or has no length."""
    size = norm(a) * norm(b)
    same = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.when(same, dot(a, b) / size).otherwise(F.lit(0.0))


def clamped_cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), cosine(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def l2_normalised(a: Column) -> Column:
    """Unit vector; a vector without length stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def vector_of(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def vector_text(a: Column) -> Column:
    """'[v0,v1,...]', the text form a vector store reads."""
    return F.to_json(a)


def padded(tokens: Column, length: int, fill: int = 0) -> tuple[Column, Column]:
    """Token ids cut or filled to `length`, and the mask of real ones."""
    n = F.least(F.size(tokens), F.lit(length))
    ids = F.slice(F.concat(tokens, F.array_repeat(F.lit(fill).cast("long"), length)), 1, length)
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))
    return ids, mask


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """Little-endian packed float32."""
    import numpy as np

    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Inverse of to_blob; a tail shorter than a float is ignored."""
    import numpy as np

    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4", count=len(b) // 4))


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1, then of unit length; null if there is none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])
    zero = F.transform(F.element_at(kept, 1), lambda x: F.lit(0.0))
    total = F.aggregate(F.slice(kept, 1, F.size(kept)), zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    n = F.size(kept)
    return F.when(n > 0, l2_normalised(F.transform(total, lambda x: x / n)))
