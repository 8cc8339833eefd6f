"""Orders, running sums, ranks and exact quantiles that do not put a whole group into one task.

A plain window over one group sorts that group in a single task, and `percentile` keeps its distinct
values in one buffer. Both are fine for small inputs, which is checked first. Beyond that, rows are
range-partitioned by (group, order), so that a hot group spreads over many tasks; each slice is
numbered locally and a small table of slice totals supplies the offsets. Quantiles need no order at all:
they are selected by refined histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.core import SMALL_ROWS, at_most, is_empty, join_on, materialize, shuffle_partitions

BINS = 1024  # bins of one pass of the quantile selection


def _columns(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def _slices(df: DataFrame, groups, order) -> DataFrame:
    """Range-partitioned, sorted and written copy with its slice number and position."""
    keys = _columns(groups) + _columns(order)
    n = shuffle_partitions(df.sparkSession)
    return materialize(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .select("*", F.spark_partition_id().alias("_slice"),
                F.monotonically_increasing_id().alias("_position")))


def _offsets(slices: DataFrame, groups, amount: Column) -> DataFrame:
    """Per (group, slice): what all earlier slices of the group hold, and the group's total."""
    per_slice = slices.groupBy(*groups, "_slice").agg(
        F.sum(amount).alias("_held"), F.min("_position").alias("_first"))
    window = Window.partitionBy(*groups)
    before = window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        *groups, "_slice", "_first",
        F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"),
        F.sum("_held").over(window).alias("_total"))


def number_rows(df: DataFrame, groups, order, name: str, limit: int = SMALL_ROWS) -> DataFrame:
    """Add `name` = 0, 1, 2, ... in `order` inside each group. `order` must be total."""
    groups = list(groups)
    if at_most(df, limit):
        window = Window.partitionBy(*groups).orderBy(*_columns(order))
        return df.withColumn(name, F.row_number().over(window).cast("long") - 1)
    slices = _slices(df, groups, order)
    offsets = _offsets(slices, groups, F.lit(1))
    return (join_on(slices, offsets, [*groups, "_slice"])
            .withColumn(name, F.col("_before") + F.col("_position") - F.col("_first"))
            .drop("_slice", "_position", "_first", "_before", "_total"))


def running_sum(df: DataFrame, groups, order, amount: str, name: str,
                limit: int = SMALL_ROWS) -> DataFrame:
    """Add `name` = inclusive running total of `amount` in `order` inside each group."""
    groups = list(groups)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if at_most(df, limit):
        window = Window.partitionBy(*groups).orderBy(*_columns(order)).rowsBetween(*upto)
        return df.withColumn(name, F.sum(amount).over(window))
    slices = _slices(df, groups, order)
    offsets = _offsets(slices, groups, F.col(amount))
    window = Window.partitionBy(*groups, "_slice").orderBy("_position").rowsBetween(*upto)
    local = slices.withColumn("_local", F.sum(amount).over(window))
    return (join_on(local, offsets, [*groups, "_slice"])
            .withColumn(name, F.col("_before") + F.col("_local"))
            .drop("_slice", "_position", "_local", "_first", "_before", "_total"))


def running_max(df: DataFrame, groups, order, value: str, name: str, limit: int = SMALL_ROWS) -> DataFrame:
    """Add `name` = the largest `value` up to this row in `order` inside each group; nulls are skipped."""
    groups = list(groups)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if at_most(df, limit):
        window = Window.partitionBy(*groups).orderBy(*_columns(order)).rowsBetween(*upto)
        return df.withColumn(name, F.max(value).over(window))
    slices = _slices(df, groups, order)
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.groupBy(*groups, "_slice").agg(F.max(value).alias("_held")).withColumn(
        "_before", F.max("_held").over(earlier)).drop("_held")
    window = Window.partitionBy(*groups, "_slice").orderBy("_position").rowsBetween(*upto)
    local = slices.withColumn("_local", F.max(value).over(window))
    return (join_on(local, before, [*groups, "_slice"])
            .withColumn(name, F.greatest("_before", "_local"))
            .drop("_slice", "_position", "_local", "_before"))


def _cumulated_values(df: DataFrame, groups, value: str) -> DataFrame:
    """One row per distinct (group, value): how many rows lie below it, its own count, the total."""
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("_count"))
    slices = _slices(counted, groups, [value])
    offsets = _offsets(slices, groups, F.col("_count"))
    window = (Window.partitionBy(*groups, "_slice").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = slices.withColumn("_local", F.sum("_count").over(window))
    return (join_on(local, offsets, [*groups, "_slice"])
            .withColumn("_below", F.col("_before") + F.col("_local") - F.col("_count"))
            .select(*groups, value, "_count", "_below", "_total"))


def quantiles(df: DataFrame, groups, value: str, wanted: dict[str, float],
              limit: int = SMALL_ROWS) -> DataFrame:
    """Exact linearly interpolated quantiles per group; `wanted` maps column name to probability.

    Groups of at most `limit` rows are buffered; in larger ones the values are selected by histograms
    that close in on them, so rows are neither sorted nor gathered. Null and NaN values are left out, and a
    group without any other value gives no row.
    """
    groups = list(groups)
    plain = (df.select(*groups, F.col(value).cast("double").alias("_value"))
             .where(F.col("_value").isNotNull() & ~F.isnan("_value")))

    def buffered(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*groups).agg(
            *[F.percentile("_value", F.lit(p)).alias(n) for n, p in wanted.items()],
            F.count("*").alias("_n")).where("_n > 0").drop("_n")

    if at_most(plain, limit):
        return buffered(plain)
    sizes = plain.groupBy(*groups).agg(F.count("*").alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    large = materialize(sizes.where(F.col("_n") > limit))
    if is_empty(large):
        return buffered(plain)
    found = _selected(plain, large, groups, wanted)
    if not groups:
        return found
    return found.unionByName(buffered(join_on(plain, large.select(*groups), groups, "left_anti")))


def _selected(plain: DataFrame, large: DataFrame, groups, wanted: dict[str, float]) -> DataFrame:
    """Quantiles of the groups in `large` (groups, _n, _low, _high).

    Every wanted rank has a range of values that holds it. A pass counts the rows of each range in `BINS` bins
    (partial aggregates of bounded size) with the least and greatest value of every bin, and the
    rank's range becomes that of its bin. Both ends of a range are bins of their own, so every pass narrows it.
    """
    place = {n: F.lit(p) * (F.col("_n") - 1) for n, p in wanted.items()}
    ranks = [f(x).cast("long") for x in place.values() for f in (F.floor, F.ceil)]
    targets = materialize(large.select(*groups, "_low", "_high", F.explode(F.array_distinct(F.array(*ranks))).alias("_rank"),
                                       F.lit(0).cast("long").alias("_skip")))
    v, low, high = F.col("_value"), F.col("_low"), F.col("_high")
    inner = F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * BINS)  # halves, so that no difference overflows
    steps = F.when(v == low, -1).when(v == high, BINS).when((high == float("inf")) | (low == float("-inf")), 0).otherwise(
        F.least(inner, F.lit(BINS - 1))).cast("int")
    done = targets.where("_low = _high")
    going = materialize(targets.where("_low < _high"))
    while not is_empty(going):
        ranges = going.select(*groups, "_low", "_high").distinct()
        held = join_on(plain, ranges, groups) if groups else plain.crossJoin(F.broadcast(ranges))
        key = [*groups, "_low", "_high"]
        counted = held.where((v >= low) & (v <= high)).withColumn("_bin", steps).groupBy(*key, "_bin").agg(
            F.count("*").alias("_c"), F.min("_value").alias("_from"), F.max("_value").alias("_to"))
        upto = F.sum("_c").over(Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counted = counted.withColumn("_upto", upto)
        hit = (F.col("_rank") - F.col("_skip") < F.col("_upto")) & (F.col("_rank") - F.col("_skip") >= F.col("_upto") - F.col("_c"))
        narrowed = materialize(join_on(going, counted, key).where(hit).select(
            *groups, F.col("_from").alias("_low"), F.col("_to").alias("_high"), "_rank",
            (F.col("_skip") + F.col("_upto") - F.col("_c")).alias("_skip")))
        done = done.unionByName(narrowed.where("_low = _high"))
        going = materialize(narrowed.where("_low < _high"))
    at = done.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("_rank", F.col("_low")))).alias("_at"))
    both = join_on(large, at, groups) if groups else large.crossJoin(at)
    results = []
    for name, x in place.items():
        lo, hi = (F.element_at("_at", f(x).cast("long")) for f in (F.floor, F.ceil))
        results.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (x - F.floor(x))).alias(name))
    return both.select(*groups, *results)


def average_ranks(df: DataFrame, groups, value: str, name: str,
                  limit: int = SMALL_ROWS) -> DataFrame:
    """Add `name` = 1-based rank of `value` inside its group, ties sharing their mean rank."""
    groups = list(groups)
    if at_most(df, limit):
        window = Window.partitionBy(*groups)
        first = F.rank().over(window.orderBy(value))
        ties = F.count("*").over(Window.partitionBy(*groups, value))
        return df.withColumn(name, first + (ties - 1) / F.lit(2.0))
    rows = _cumulated_values(df.select(*groups, value), groups, value)
    ranks = rows.select(*groups, value,
                        (F.col("_below") + (F.col("_count") + 1) / F.lit(2.0)).alias(name))
    return join_on(df, ranks, [*groups, value])
