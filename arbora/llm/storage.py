"""Written tables with small row groups, for rows that hold packed arrays."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from arbora.core import shared_folder, shuffles_dropped


def stored(df: DataFrame, group_bytes: int = 16 << 20) -> DataFrame:
    """Write `df` to the shared folder and return a scan of it (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/arbora-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("parquet.block.size", str(group_bytes)).option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table
