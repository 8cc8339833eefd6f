"""Label composition of groups, dominant labels and purity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.core import ContractError, join_on, materialize, require_columns, require_unique, require_zero
from arbora.functions.scalars import UNKNOWN_LABELS, is_unknown, ratio
from arbora.operators.ordering import number_rows, quantiles

NO_LABEL = "(no known annotation)"


def composition(rows: DataFrame, group: str, label: str = "celltype",
                amount: str | None = None) -> DataFrame:
    """Count per (group, label), its share of the group and its rank (count down, label up).

    The first aggregation leaves one row per distinct label of a group; only those rows are ranked.
    """
    count = F.count("*") if amount is None else F.sum(amount)
    counted = rows.groupBy(group, label).agg(count.alias("cell_count"))
    whole = Window.partitionBy(group)
    return (counted.withColumn("fraction", F.col("cell_count") / F.sum("cell_count").over(whole))
            .withColumn("rank", F.row_number().over(whole.orderBy(F.desc("cell_count"), label))))


def annotate(cells: DataFrame, annotations: DataFrame, group: str = "microcell_id") -> DataFrame:
    """Composition of groups from an annotation table (cell, celltype); missing labels are Unknown.

    Every annotation row counts, so a cell listed twice counts twice; cells without a row do not count.
    """
    named = annotations.select(F.col("cell").alias("cell_id"),
                               F.coalesce("celltype", F.lit("Unknown")).alias("celltype"))
    return composition(cells.select("cell_id", group).join(named, "cell_id"), group)


def dominant(comp: DataFrame, group: str) -> DataFrame:
    """Top label per group with its count, share, and the number of labels and counted cells."""
    order = F.struct(-F.col("cell_count"), F.col("celltype"))
    return comp.groupBy(group).agg(
        F.min_by("celltype", order).alias("dominant_celltype"),
        F.max("cell_count").alias("dominant_celltype_count"),
        (F.max("cell_count") / F.sum("cell_count")).alias("celltype_purity"),
        F.count("*").alias("celltype_types"), F.sum("cell_count").alias("celltype_matched_cells"))


def regroup(comp: DataFrame, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Composition of coarser groups from that of finer ones."""
    return composition(comp.join(mapping.select(old, new), old), new, amount="cell_count")


def weighted_purity(comp: DataFrame) -> DataFrame:
    """Share of all counted cells that carry the top label of their group (null without cells)."""
    return comp.agg(ratio(F.sum(F.when(F.col("rank") == 1, F.col("cell_count"))), F.sum("cell_count"))
                    .alias("weighted_purity"))


def evaluate_purity(groups: DataFrame, comp: DataFrame, group: str = "microcell_id",
                    unknown=UNKNOWN_LABELS, check: bool = True) -> DataFrame:
    """Per group: known, unknown and unmatched cells, purity among known labels and label entropy."""
    require_columns(groups, {group, "n_cells", "lineage"}, "groups")
    require_columns(comp, {group, "celltype", "cell_count"}, "composition")
    groups = groups.select(group, "n_cells", "lineage")
    if check:
        # Counted tables are read several times by the checks, what they were counted from only once.
        groups, comp = materialize(groups), materialize(comp.select(group, "celltype", "cell_count"))
        require_unique(groups, [group], "groups")
        require_zero(groups, n_cells_not_positive=~(F.col("n_cells") > 0) |
                     (F.col("n_cells") != F.floor("n_cells")))
        require_zero(comp, cell_count_not_positive=~(F.col("cell_count") > 0) |
                     (F.col("cell_count") != F.floor("cell_count")))
        if not comp.join(groups, group, "left_anti").isEmpty():
            raise ContractError("composition names unknown groups")
    labels = (comp.select(group, F.trim(F.coalesce("celltype", F.lit(""))).alias("celltype"), "cell_count")
              .groupBy(group, "celltype").agg(F.sum("cell_count").alias("cell_count"))
              .withColumn("_known", ~is_unknown(F.col("celltype"), unknown)))
    c, known = F.col("cell_count"), F.col("_known")
    share_log = F.sum(F.when(known, c * F.ln(c)))
    stats = labels.groupBy(group).agg(
        F.sum(c).alias("matched_cells"), F.sum(F.when(known, c)).alias("known_cells"),
        F.max(c).alias("_top_any"), F.max(F.when(known, c)).alias("dominant_known_cells"),
        F.min_by("celltype", F.when(known, F.struct(-c, F.col("celltype")))).alias("_dominant"),
        F.count_if(known).alias("known_celltype_count"), share_log.alias("_share_log"))
    zero = {n: F.coalesce(n, F.lit(0)) for n in
            ("matched_cells", "known_cells", "dominant_known_cells", "known_celltype_count")}
    full = join_on(groups, stats, [group], "left").select(
        group, "n_cells", "lineage", *[x.alias(n) for n, x in zero.items()], "_top_any", "_share_log",
        F.coalesce("_dominant", F.lit(NO_LABEL)).alias("dominant_known_celltype"))
    n, matched, kept = F.col("n_cells"), F.col("matched_cells"), F.col("known_cells")
    result = full.select(
        group, "n_cells", "lineage", "matched_cells", "known_cells",
        (matched - kept).alias("unknown_cells"), (n - matched).alias("unmatched_cells"),
        (kept / n).alias("known_fraction"), ratio(F.col("_top_any"), matched).alias("purity_including_unknown"),
        "dominant_known_celltype", "dominant_known_cells",
        ratio(F.col("dominant_known_cells"), kept).alias("purity"), "known_celltype_count",
        F.when(kept > 0, F.ln(kept) - F.col("_share_log") / kept).alias("celltype_entropy"),
        (F.col("dominant_known_cells") / n).alias("dominant_fraction_all_cells"))
    if check:
        result = materialize(result)
        require_zero(result, annotated_counts_above_n_cells=F.col("matched_cells") > F.col("n_cells"))
    return result


def purity_summary(evaluated: DataFrame, by: str | None = None, small_size: int = 50) -> DataFrame:
    """Summary of evaluated groups, over all of them or per value of `by` (null is a value too)."""
    keys = [by] if by else []
    n, known, valid = F.col("n_cells"), F.col("known_cells"), F.col("known_cells") > 0
    small = n < small_size
    total, all_known = F.sum(n), F.sum(known)
    columns = [
        F.count("*").alias("n_groups"), total.alias("total_cells"),
        F.count_if(valid).alias("evaluable_groups"),
        F.sum("matched_cells").alias("all_matched_cells"), all_known.alias("all_known_cells"),
        F.sum("unknown_cells").alias("all_unknown_cells"),
        F.sum("unmatched_cells").alias("all_unmatched_cells"),
        ratio(F.sum("matched_cells"), total).alias("matched_fraction"),
        ratio(all_known, total).alias("known_fraction"),
        F.avg(F.when(valid, F.col("purity"))).alias("mean_purity"),
        ratio(F.sum(F.when(valid, F.col("dominant_known_cells"))), all_known)
        .alias("known_cell_weighted_purity"),
        ratio(F.sum("dominant_known_cells"), total).alias("dominant_fraction_all_cells"),
        F.avg(F.when(valid, F.col("celltype_entropy"))).alias("mean_entropy"),
        F.avg((n == 1).cast("double")).alias("singleton_fraction"),
        F.avg(small.cast("double")).alias("small_group_fraction"),
        ratio(F.coalesce(F.sum(F.when(small, n)), F.lit(0)), total).alias("small_group_cell_fraction")]
    for text, threshold in (("0_9", 0.9), ("0_95", 0.95)):
        high = valid & (F.col("purity") >= threshold)
        columns += [
            ratio(F.count_if(high), F.count_if(valid)).alias(f"purity_ge_{text}_group_fraction"),
            ratio(F.coalesce(F.sum(F.when(high, n)), F.lit(0)), total)
            .alias(f"purity_ge_{text}_all_cell_coverage"),
            ratio(F.coalesce(F.sum(F.when(high, known)), F.lit(0)), all_known)
            .alias(f"purity_ge_{text}_known_cell_coverage")]
    # The sums above share names with input columns, so they are aggregated before any join.
    base = evaluated.groupBy(*keys).agg(*columns)
    sizes = quantiles(evaluated, keys, "n_cells", {"median_group_size": 0.5})
    purities = quantiles(evaluated.where(valid), keys, "purity",
                         {"median_purity": 0.5, "p10_purity": 0.1})
    return join_on(join_on(base, sizes, keys, "left"), purities, keys, "left")


def purity_coverage(evaluated: DataFrame) -> DataFrame:
    """Share of all cells in groups whose purity reaches each of 101 thresholds.

    Groups are first reduced to the highest threshold they pass, then summed from the top.
    """
    thresholds = F.sequence(F.lit(0), F.lit(100))

    def passed(value):
        return F.aggregate(thresholds, F.lit(-1),
                           lambda best, t: F.when(value >= t * F.lit(0.01), t).otherwise(best))

    def totals(value, name):
        return (evaluated.groupBy(passed(value).alias("step"))
                .agg(F.sum("n_cells").alias(name)))

    known = totals(F.when(F.col("known_cells") > 0, F.col("purity")), "_known")
    every = totals(F.col("dominant_fraction_all_cells"), "_every")
    steps = evaluated.sparkSession.range(101).select(F.col("id").cast("int").alias("step"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = evaluated.agg(F.sum("n_cells").alias("_total"))
    return (steps.join(known, "step", "left").join(every, "step", "left")
            .withColumn("_known", F.sum(F.coalesce("_known", F.lit(0))).over(above))
            .withColumn("_every", F.sum(F.coalesce("_every", F.lit(0))).over(above))
            .crossJoin(whole)
            .select("step", (F.col("step") * F.lit(0.01)).alias("threshold"),
                    ratio(F.col("_known"), F.col("_total")).alias("coverage"),
                    ratio(F.col("_every"), F.col("_total")).alias("conservative_coverage")))


def purity_pages(by_lineage: DataFrame, page_rows: int = 30) -> DataFrame:
    """Lineages ordered by weighted purity (unknown first) and cut into pages."""
    placed = number_rows(by_lineage, [], [F.col("known_cell_weighted_purity").asc_nulls_first(), "lineage"],
                         "position")
    return placed.withColumn("page", (F.floor(F.col("position") / page_rows) + 1))
