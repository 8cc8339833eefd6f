"""Plot-ready columns: colours, category codes, marker sizes, drawing order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.core import materialize
from arbora.operators.ordering import number_rows

# Colour of groups shown as mixed, and the saturation and brightness steps that
# extend a palette along golden-ratio hues.
MIXED_COLOR = "#9E9E9E"
GOLDEN = 0.618033988749895
SATURATIONS = (0.62, 0.78, 0.9)
BRIGHTNESSES = (0.68, 0.82, 0.94)


def hsv_hex(hue: Column, saturation: Column, brightness: Column) -> Column:
    """#RRGGBB text of a colour."""
    def channel(offset: float) -> Column:
        k = F.pmod(F.lit(offset) + hue * 6, F.lit(6.0))
        dip = F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))
        return F.lpad(F.hex(F.round((brightness - brightness * saturation * dip) * 255).cast("int")), 2, "0")

    return F.concat(F.lit("#"), channel(5.0), channel(3.0), channel(1.0))


def golden_color(index: Column) -> Column:
    """The index-th colour of the endless golden-ratio palette."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    return hsv_hex(F.pmod(index * F.lit(GOLDEN), F.lit(1.0)), pick(SATURATIONS, F.pmod(index, F.lit(3))),
                   pick(BRIGHTNESSES, F.pmod(F.floor(index / F.lit(3)), F.lit(3))))


def label_weights(groups: DataFrame, label: str, weight: str = "n_cells") -> DataFrame:
    """Labels by total weight, heaviest first: label, total, position."""
    totals = materialize(groups.groupBy(label).agg(F.sum(weight).alias("total")))
    return number_rows(totals, [], [F.desc("total"), label], "position")


def label_colors(groups: DataFrame, label: str, weight: str = "n_cells",
                 known: DataFrame | None = None) -> DataFrame:
    """One colour per label: a saved one (label, color) where there is one, grey for mixed groups,
    and the next free palette colour, heaviest label first, for the rest."""
    ordered = label_weights(groups, label, weight)
    if known is None:
        ordered = ordered.withColumn("_saved", F.lit(None).cast("string"))
    else:
        saved = known.dropDuplicates([label]).select(label, F.col("color").alias("_saved"))
        ordered = ordered.join(saved, label, "left")
    ordered = ordered.withColumn("_saved", F.when(F.col(label) == "Mixed", MIXED_COLOR).otherwise(F.col("_saved")))
    fresh = number_rows(ordered.where("_saved is null").select(label, "position"), [], ["position"], "_fresh")
    # Saved colours also use up palette entries, so the search looks that much farther ahead.
    taken = ordered.where("_saved is not null").select(F.upper("_saved").alias("color")).distinct()
    reach = fresh.crossJoin(taken.agg(F.count("*").alias("_taken")))
    slots = (reach.agg(F.max(F.col("_fresh") + F.col("_taken") * 2 + 1).alias("n"))
             .select(F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("n", F.lit(0).cast("long")))).alias("slot"))
             .withColumn("color", golden_color(F.col("slot"))))
    first = slots.groupBy("color").agg(F.min("slot").alias("slot")).join(taken, "color", "left_anti")
    free = number_rows(first, [], ["slot"], "_fresh").select("_fresh", F.col("color").alias("_new"))
    return (ordered.join(fresh.select(label, "_fresh"), label, "left").join(free, "_fresh", "left")
            .select(label, "total", "position", F.coalesce("_saved", "_new").alias("color")))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """Integer code of each label in sorted order; missing labels are Unknown."""
    named = df.withColumn(column, F.coalesce(column, F.lit("Unknown")))
    codes = number_rows(materialize(named.select(column).distinct()), [], [column], f"{column}_code")
    return named.join(codes, column)


def marker_sizes(nodes: DataFrame, low: float = 9.0, high: float = 34.0) -> DataFrame:
    """Add marker_size: log(1 + n_cells) stretched between two sizes (the middle when all are equal)."""
    size = F.log1p(F.col("n_cells").cast("double"))
    ends = nodes.agg(F.min(size).alias("_low"), F.max(size).alias("_high"))
    span = F.col("_high") - F.col("_low")
    scaled = F.lit(low) + F.try_divide(size - F.col("_low"), span) * F.lit(high - low)
    return (nodes.crossJoin(F.broadcast(ends))
            .withColumn("marker_size", F.coalesce(scaled, F.lit((low + high) / 2))).drop("_low", "_high"))


def size_purity_grid(evaluated: DataFrame, columns: int = 45, rows: int = 30) -> DataFrame:
    """Number of groups per cell of a (log size, purity) grid."""
    known = evaluated.where("known_cells > 0 and purity is not null")
    ends = known.agg(F.min(F.log10("n_cells")).alias("_low"), F.max(F.log10("n_cells")).alias("_high"))
    along = F.try_divide(F.log10("n_cells") - F.col("_low"), F.col("_high") - F.col("_low")) * columns
    return (known.crossJoin(F.broadcast(ends))
            .select(F.least(F.lit(columns - 1), F.floor(F.coalesce(along, F.lit(0.0)))).alias("size_bin"),
                    F.least(F.lit(rows - 1), F.floor(F.col("purity") * rows)).alias("purity_bin"))
            .groupBy("size_bin", "purity_bin").agg(F.count("*").alias("n_groups")))
