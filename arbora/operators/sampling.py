"""Deterministic samples: a capped number of cells per node, and a simple subset of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.core import join_on, require_unique


# Modulus (a prime), multiplier and seed step of the sampling order.
PRIME, MULTIPLIER, SEED_STEP = 2_147_483_647, 48_271, 69_621


def sampling_key(column: str, seed: int = 42) -> Column:
    """Pseudo-random order that does not depend on partitions and that any SQL engine can restate.

    Squaring breaks up the regular steps that a linear rule would leave between neighbouring ids.
    """
    mixed = (F.pmod(F.col(column).cast("long"), F.lit(PRIME)) * F.lit(MULTIPLIER) + F.lit(seed * SEED_STEP)) % F.lit(PRIME)
    return (mixed * mixed) % F.lit(PRIME)


def capped_sample(cells: DataFrame, cap: int, group: str = "node_id", index: str = "cell_index",
                  seed: int = 42) -> DataFrame:
    """min(cap, size) cells of every group, by smallest sampling key.

    `row_number <= cap` lets every map task drop all but `cap` rows of a group before the shuffle.
    """
    order = Window.partitionBy(group).orderBy(sampling_key(index, seed), index)
    return (cells.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= cap)
            .drop("_place"))


def require_filled(sample: DataFrame, cells: DataFrame, cap: int, group: str = "node_id") -> bool:
    """True when every group has min(cap, size) sampled cells."""
    size = cells.groupBy(group).agg(F.least(F.count("*"), F.lit(cap)).alias("_goal"))
    got = sample.groupBy(group).agg(F.count("*").alias("_got"))
    return join_on(size, got, [group], "left").where("coalesce(_got, 0) <> _goal").limit(1).isEmpty()


def simple_sample(df: DataFrame, n: int, index: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, in sampling order."""
    return df.orderBy(sampling_key(index, seed), index).limit(n)


def attach_one_to_one(sample: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Left join of columns that must be unique per key; the sample filters the larger table first."""
    wanted = extra.join(sample.select(key), key, "left_semi")
    require_unique(wanted, [key], "attached table")
    return sample.join(wanted, key, "left")


def jittered(df: DataFrame, column: str, width: float, key: str, seed: int = 42) -> DataFrame:
    """Gaussian noise for display only, drawn from a hash of `key`, so it is the same however rows are dealt."""
    def uniform(part: int):
        return (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(part)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))

    noise = F.sqrt(-2 * F.log(uniform(0))) * F.cos(F.lit(6.283185307179586) * uniform(1))
    return df.withColumn(column, F.col(column) + noise * F.lit(float(width)))
