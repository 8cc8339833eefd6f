"""The driver's tables seen as cells, microcells and nodes (mapping in FIXTURES.md).

Every view keeps all rows of its table; lineages, states and stages are derived columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _prefixed(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def nodes_from_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as one temporal node."""
    v = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        v.alias("node_id"), _prefixed("lin", F.col("label") % 3).alias("lineage"),
        _prefixed("ct", F.col("label")).alias("celltype"),
        (F.lit(4.0) + ((v * 7919) % 2200) / F.lit(100.0)).alias("stage"),
        (1 + (v * 31) % 97).alias("n_cells"), (1 + (v * 17) % 5).alias("n_metacells"),
        F.col("embedding"))


def microcells_from_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as one microcell."""
    n = nodes_from_embeddings(spark, folder)
    return n.select(F.col("node_id").alias("microcell_id"), "lineage", "celltype",
                    F.col("stage").alias("mean_stage"), "n_cells", "embedding",
                    F.lit("predicted_stage").alias("stage_source"))


def cells_from_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as one cell."""
    n = nodes_from_embeddings(spark, folder)
    return n.select(F.col("node_id").alias("cell_index"), "lineage", "celltype", "stage", "embedding")


def cells_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as one cell; the user is its microcell."""
    u = F.col("user_id")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("cell_index"), _prefixed("cell", F.col("event_id")).alias("cell_id"),
        u.alias("microcell_id"), _prefixed("lin", u % 8).alias("lineage"), (u % 8).alias("lineage_id"),
        (u % 3).alias("state_within_lineage"), ((u % 8) * 3 + u % 3).alias("state_id"),
        F.col("event_type").alias("celltype"), F.col("value").alias("stage"))


def microcells_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """The users as microcells with their state labels."""
    return (cells_from_events(spark, folder)
            .groupBy("microcell_id", "lineage", "state_within_lineage", "state_id")
            .agg(F.count("*").alias("n_cells"), F.avg("stage").alias("mean_stage")))


def cells_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Each line as one cell; three lineages with very unequal shares, parts as microcells."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("microcell_id"), F.col("l_returnflag").alias("lineage"),
        F.col("l_quantity").alias("stage"), F.col("l_linestatus").alias("celltype"),
        F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"))
