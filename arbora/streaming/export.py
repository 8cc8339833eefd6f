"""Membership export as a stream: cells arrive in files, member rows are appended.

The export needs no state: each cell is looked up in the finished microcell mapping. The checkpoint lies beside the
output (`.<name>.checkpoint`), so an export that was stopped anywhere goes on after its last finished batch when it
is started again, by any application. The sink's own ledger in the output lists the files of
finished batches; what a stopped batch has left is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from arbora.operators.export import node_cells


def cell_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def export_stream(cells: DataFrame, mapping: DataFrame, output: str, compression: str = "zstd"):
    """Run until all files present are exported; returns the finished query. Call it again to go on."""
    parent, _, name = output.rstrip("/").rpartition("/")
    query = (node_cells(cells, mapping).writeStream.format("parquet").outputMode("append")
             .option("compression", compression).option("checkpointLocation", f"{parent}/.{name}.checkpoint")
             .trigger(availableNow=True).start(output))
    query.awaitTermination()
    return query
