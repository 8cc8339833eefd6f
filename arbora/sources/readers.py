"""Readers for the input files of a run, with the checks that keep rows aligned by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.core import ContractError, require_columns, require_zero
from arbora.functions.scalars import MISSING_STRINGS

PREDICTED = T.StructType([T.StructField("idx", T.LongType()), T.StructField("cell_id", T.StringType()),
                          T.StructField("predicted_stage", T.DoubleType())])


def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', **options)


def read_csv_columns(spark: SparkSession, path: str, types: dict[str, str], table: str) -> DataFrame:
    """The named columns of a CSV file (others are not parsed), text kept as written."""
    raw = _csv(spark, path, inferSchema=False, nullValue="\u0000", emptyValue="")
    require_columns(raw, types, table)
    return raw.select(*[F.col(c) if t == "string" else F.col(c).try_cast(t).alias(c)
                        for c, t in types.items()])


def stage_violations(predicted: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts of everything that can be wrong between predictions (idx, cell_id, predicted_stage) and
    cells (cell_index, cell_id), in one row."""
    p = F.col("predicted_stage")
    own = predicted.groupBy("idx").agg(
        F.count("*").alias("_rows"), F.min("cell_id").alias("_id"), F.max("cell_id").alias("_id2"),
        F.count_if(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))).alias("_odd"))
    known = cells.select(F.col("cell_index").alias("idx"), "cell_id", F.lit(True).alias("_cell"))
    j = own.join(known, "idx", "full")
    given, cell = F.col("_rows").isNotNull(), F.coalesce("_cell", F.lit(False))
    return j.agg(
        F.count_if(given & ~cell).alias("idx_out_of_range"),
        F.count_if(F.col("_rows") > 1).alias("duplicate_idx"),
        F.count_if(given & cell & ~(F.col("_id").eqNullSafe(F.col("cell_id")) &
                                    F.col("_id2").eqNullSafe(F.col("cell_id")))).alias("cell_id_mismatch"),
        F.coalesce(F.sum("_odd"), F.lit(0)).alias("not_finite"),
        F.count_if(cell & ~given).alias("missing_cells"))


def attach_predicted_stage(cells: DataFrame, predicted: DataFrame) -> DataFrame:
    """Cells with their predicted stage; every cell must have exactly one finite, matching row."""
    row = stage_violations(predicted, cells).first().asDict()
    broken = {k: v for k, v in row.items() if v}
    if broken:
        raise ContractError(f"predicted stage: {broken}")
    stage = predicted.select(F.col("idx").alias("cell_index"), F.col("predicted_stage").alias("stage"))
    return cells.join(stage, "cell_index")


def read_predicted_stage(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_columns(spark, path, {"idx": "bigint", "cell_id": "string",
                                          "predicted_stage": "double"}, "predicted stage")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """cell, celltype; strings that stand for a missing value become Unknown."""
    raw = read_csv_columns(spark, path, {"cell": "string", "celltype": "string"}, "annotations")
    missing = F.col("celltype").isNull() | F.col("celltype").isin(*MISSING_STRINGS)
    return raw.withColumn("celltype", F.when(missing, "Unknown").otherwise(F.col("celltype")))


def read_literal_annotations(spark: SparkSession, path: str, cell: str = "cell",
                             celltype: str = "celltype") -> DataFrame:
    """The same with chosen column names and all strings kept as they are."""
    raw = read_csv_columns(spark, path, {cell: "string", celltype: "string"}, "annotations")
    return raw.select(F.col(cell).alias("cell_id"), F.col(celltype).alias("celltype"))


def read_dictionary(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Ordered list of a JSON file as code and value."""
    raw = spark.read.json(path, multiLine=True)
    require_columns(raw, {field}, "metadata")
    return raw.select(F.posexplode(field).alias("code", "value"))


def decode_dictionary(df: DataFrame, code: str, dictionary: DataFrame, name: str,
                      kind: str = "string") -> DataFrame:
    """Add the dictionary value of a code column; unknown codes are an error."""
    values = dictionary.select(F.col("code").alias(code), F.col("value").cast(kind).alias(name))
    result = df.join(F.broadcast(values) if dictionary.count() < 100_000 else values, code, "left")
    require_zero(result, **{f"unknown_{code}": F.col(name).isNull()})
    return result


def true_stage(cells: DataFrame, stages: DataFrame, expected: DataFrame) -> DataFrame:
    """Mean true stage per microcell. `cells`: cell_index, microcell_id; `stages`: idx, true_stage.

    The indices must be exactly 0..n-1 and every microcell must get as many stages as it has cells
    (`expected`: microcell_id, n_cells); partial means are refused.
    """
    row = stages.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("lo"),
                     F.max("idx").alias("hi")).first()
    if not row["n"] or row["d"] != row["n"] or row["lo"] != 0 or row["hi"] != row["n"] - 1:
        raise ContractError("true stage rows must be contiguous from zero")
    j = cells.join(stages.select(F.col("idx").alias("cell_index"), "true_stage"), "cell_index", "left")
    means = j.groupBy("microcell_id").agg(F.avg("true_stage").alias("mean_true_stage"),
                                          F.count("true_stage").alias("_staged"))
    result = expected.join(means, "microcell_id", "left")
    require_zero(result, incomplete_true_stage=~(F.col("_staged") == F.col("n_cells")) | F.col("_staged").isNull())
    return result.select("microcell_id", "mean_true_stage")


def read_gene_names(spark: SparkSession, path: str | None, width: int) -> DataFrame:
    """position, gene: from text lines or the first column of .csv/.tsv; g_0, g_1, ... without a file."""
    if path is None:
        return spark.range(width).select(F.col("id").cast("int").alias("position"),
                                         F.concat(F.lit("g_"), F.col("id").cast("string")).alias("gene"))
    if path.endswith((".csv", ".tsv")):
        raw = _csv(spark, path, sep="\t" if path.endswith(".tsv") else ",")
        names = raw.select(F.col(raw.columns[0]).cast("string").alias("gene"))
    else:
        names = spark.read.text(path).select(F.trim("value").alias("gene")).where("gene <> ''")
    # A gene list is one short file and is read in file order.
    numbered = names.coalesce(1).withColumn("position", F.monotonically_increasing_id().cast("int"))
    if numbered.count() != width:
        raise ContractError("number of gene names differs from the decoder output")
    return numbered.select("position", "gene")


def read_palette(spark: SparkSession, path: str, column: str) -> DataFrame:
    return read_csv_columns(spark, path, {column: "string", "color": "string"}, "palette")


def missing_colors(labels: DataFrame, palette: DataFrame, column: str) -> DataFrame:
    """Labels a palette does not cover."""
    return labels.select(column).distinct().join(palette, column, "left_anti")


def first_cells(cells: DataFrame, limit: int) -> DataFrame:
    """Cells of the first `limit` rows, by index."""
    return cells.where(F.col("cell_index") < limit)


def coordinate_mismatches(coordinates: DataFrame, table: DataFrame, key: str = "microcell_id") -> DataFrame:
    """How often saved coordinates disagree with the table they were made from, per shared column."""
    shared = [c for c in coordinates.columns if c in table.columns and c != key]
    right = table.select(key, *[F.col(c).alias(f"_{c}") for c in shared])
    j = coordinates.withColumn("_left", F.lit(1)).join(right.withColumn("_right", F.lit(1)), key, "full")
    return j.agg(F.count_if(F.col("_left").isNull() | F.col("_right").isNull()).alias("unmatched_rows"),
                 *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"{c}_differs") for c in shared])


def check_run_tables(microcells: DataFrame, assignments: DataFrame) -> DataFrame:
    """Consistency of microcells (microcell_id, n_cells) and cell assignments in one row of counts."""
    m = microcells.agg(F.count("*").alias("n"), F.countDistinct("microcell_id").alias("d"),
                       F.min("microcell_id").alias("lo"), F.max("microcell_id").alias("hi"),
                       F.sum("n_cells").alias("held"))
    a = assignments.agg(F.count("*").alias("cells"), F.countDistinct("microcell_id").alias("used"),
                        F.min("microcell_id").alias("alo"), F.max("microcell_id").alias("ahi"))
    return m.crossJoin(a).select(
        (F.col("d") - F.col("n")).alias("repeated_ids"),
        (F.abs("lo") + F.abs(F.col("hi") - F.col("n") + 1)).alias("gaps_in_ids"),
        (F.col("held") - F.col("cells")).alias("cells_not_accounted"),
        (F.abs(F.col("used") - F.col("n")) + F.abs(F.col("alo")) + F.abs(F.col("ahi") - F.col("n") + 1))
        .alias("assignment_span_error"))
