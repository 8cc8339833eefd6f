"""Token-id files: coded segments of ids in ascending document order, and reading them back.

A file set is a folder of Parquet files; a row is a segment: `part` and `segment` give its place, and
it holds the ids and sizes of whole documents and one payload of independently coded, checksummed
blocks (mixing_coder). Documents are range-partitioned by id, so parts follow each other in order;
the place of a segment in the whole corpus is summed from a table of part totals and one of segment
totals per part.

Edge cases: a null or empty text is its end id alone; a null document id sorts first; repeated rows of
one id follow each other; an empty table makes an empty file set; ids above 65,535 are refused.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.core import shared_folder, shuffle_partitions
from arbora.llm import spans
from arbora.llm.mixing_coder import decode, encode
from arbora.llm.packing import tokenizer_path
from arbora.llm.registry import query, table
from arbora.llm.token_ids import Encoder, encoded

SEGMENT = 1_000_000  # ids, rounded up to whole documents


def write_ids(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None) -> None:
    """Encode every text and write the file set to `folder`."""
    path = path or tokenizer_path()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder, part, number = Encoder(path), TaskContext.get().partitionId(), 0
        held, keys, sizes = [], [], []

        def row():
            ids = np.concatenate(held)
            if len(ids) and (ids.max() > 65535 or ids.min() < 0):
                raise ValueError("ids above 65,535 do not fit the coder")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([keys], pa.list_(key_type)),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([encode(ids)], pa.binary())],
                ["part", "segment", "keys", "sizes", "payload"])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for first, last, ids, bounds in encoded(spans.column(batch, "_text"), encoder):
                held.append(ids)
                keys += batch.column(0).slice(first, last - first).to_pylist()
                sizes += np.diff(bounds).tolist()
                if sum(map(len, held)) >= SEGMENT:
                    yield row()
                    held, keys, sizes, number = [], [], [], number + 1
        if held:
            yield row()

    ordered = (docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
               .repartitionByRange(shuffle_partitions(docs.sparkSession), "_key").sortWithinPartitions("_key"))
    (ordered.mapInArrow(run, f"part int, segment int, keys array<{kind}>, sizes array<bigint>, payload binary")
     .write.option("parquet.block.size", str(16 << 20)).parquet(folder))


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document of a file set."""
    files = spark.read.parquet(folder)
    kind = files.schema["keys"].dataType.elementType.simpleString()
    held = files.select("part", "segment", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = held.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_p"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = (held.withColumn("_s", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
              .select("part", "segment", (F.col("_p") + F.col("_s")).alias("_base")))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                ids = decode(row["payload"].as_py()).astype("<u4")
                sizes = row["sizes"].values.to_numpy()
                stop = np.cumsum(sizes)
                cut = [ids[b:e].tobytes() for b, e in zip((stop - sizes).tolist(), stop.tolist())]
                n = len(cut)
                cols = [pa.array([row["part"].as_py()] * n, pa.int32()), pa.array([row["segment"].as_py()] * n, pa.int32()),
                        row["keys"].values, pa.array(stop - sizes), pa.array(sizes), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                names = ["part", "segment", "key", "_at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(cut, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"part int, segment int, key {kind}, _at bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    found = files.mapInArrow(run, schema)
    more = ["ids"] if with_ids else []
    return found.join(places, ["part", "segment"]).select("key", (F.col("_base") + F.col("_at")).alias("start"),
                                                          "n_tokens", "ids_crc32", *more)


@query("op4_id_files")
def op4_id_files(spark, folder):
    """Write the coded ids of every document, read the files back and tell where each document lies."""
    out = f"{shared_folder(spark)}/arbora-{spark.sparkContext.applicationId}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, folder, "documents"), out)
    return read_ids(spark, out).withColumnRenamed("key", "doc_id")
