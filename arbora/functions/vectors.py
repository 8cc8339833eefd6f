"""Vector expressions on ARRAY columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.core import ContractError

FLOOR = 1e-12


def doubles(vector) -> Column:
    return F.col(vector).cast("array<double>") if isinstance(vector, str) else vector


def norm(vector) -> Column:
    return F.sqrt(F.aggregate(doubles(vector), F.lit(0.0), lambda s, x: s + x * x))


def normalized(vector) -> Column:
    """Length-one copy; a zero vector stays zero."""
    length = F.greatest(norm(vector), F.lit(FLOOR))
    return F.transform(doubles(vector), lambda x: x / length)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y),
                       F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a, b) -> Column:
    """1 - cosine, not clipped."""
    return 1 - dot(a, b) / F.greatest(norm(a), F.lit(FLOOR)) / F.greatest(norm(b), F.lit(FLOOR))


def dimension(df: DataFrame, vector: str) -> int:
    row = df.select(F.size(vector).alias("d")).where("d > 0").head()
    if row is None:
        raise ContractError(f"{vector} holds no vectors")
    return row["d"]


def require_vectors(df: DataFrame, vector: str, nonzero: bool = True) -> int:
    """All vectors have one width and finite entries (and, if asked, a positive length)."""
    width = dimension(df, vector)
    bad = F.size(vector) != width
    odd = F.exists(doubles(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    row = df.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("width"),
                 F.count_if(F.coalesce(odd, F.lit(True))).alias("finite"),
                 F.count_if(norm(vector) <= 0).alias("zero")).first()
    if row["width"] or row["finite"] or (nonzero and row["zero"]):
        raise ContractError(f"{vector}: {row['width']} of another width, {row['finite']} not finite, "
                            f"{row['zero']} of length zero")
    return width


def mean_vector(vector: str, width: int, weight: str | None = None) -> Column:
    """Aggregate: the (weighted) mean as one array.

    One small aggregate per dimension, so each map task sends one row per group instead of one row
    per vector entry.
    """
    v = doubles(vector)
    if weight is None:
        return F.array(*[F.avg(v[i]) for i in range(width)])
    w = F.col(weight).cast("double")
    total = F.sum(w)
    return F.array(*[F.sum(v[i] * w) / total for i in range(width)])


def group_means(df: DataFrame, groups, vector: str, width: int | None = None,
                weight: str | None = None, unit: bool = False) -> DataFrame:
    """(Weighted) mean vector per group, scaled to length one if `unit`."""
    width = width or dimension(df, vector)
    means = df.groupBy(*groups).agg(mean_vector(vector, width, weight).alias("embedding"))
    return means.withColumn("embedding", normalized("embedding")) if unit else means


def subset_dimensions(vector: str, indices) -> Column:
    """The named dimensions only, rescaled to length one."""
    if len(set(indices)) != len(indices):
        raise ContractError("dimensions must not repeat")
    return normalized(F.array(*[doubles(vector)[int(i)] for i in indices]))


def weighted_dimensions(vector: str, indices, weight: float, width: int) -> Column:
    """Multiply the named dimensions by `weight` and rescale to length one."""
    indices = [int(i) for i in indices]
    if len(set(indices)) != len(indices) or any(not 0 <= i < width for i in indices):
        raise ContractError("dimensions must be distinct and inside the vector")
    if not 0 < weight < float("inf"):
        raise ContractError("weight must be positive and finite")
    chosen = F.array(*[F.lit(i) for i in indices])
    scaled = F.transform(doubles(vector), lambda x, i: F.when(F.array_contains(chosen, i), x * weight)
                         .otherwise(x))
    return normalized(scaled)
