"""Spark data source for dense .npy arrays: one row per array row, read in slices without loading it.

    spark.dataSource.register(NpyDataSource)
    spark.read.format("npy").load("embeddings.npy")      # row_index, value
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_SLICE = 100_000
ROWS_PER_BATCH = 10_000


class Slice(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__(start)
        self.start, self.stop = start, stop


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        n = np.load(self.path, mmap_mode="r", allow_pickle=False).shape[0]
        return [Slice(i, min(i + self.rows, n)) for i in range(0, n, self.rows)]

    def read(self, partition):
        data = np.load(self.path, mmap_mode="r", allow_pickle=False)
        for start in range(partition.start, partition.stop, ROWS_PER_BATCH):
            part = np.asarray(data[start:min(start + ROWS_PER_BATCH, partition.stop)])
            index = pa.array(np.arange(start, start + len(part)), pa.int64())
            if part.ndim == 2:
                flat = pa.array(part.ravel().astype(np.float32))
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                values = pa.ListArray.from_arrays(offsets, flat)
            elif part.dtype.kind in "US":
                values = pa.array(part.astype(str).tolist(), pa.string())
            else:
                kind = np.int64 if part.dtype.kind in "iub" else np.float64
                values = pa.array(part.astype(kind))
            yield pa.RecordBatch.from_arrays([index, values], names=["row_index", "value"])


class NpyDataSource(DataSource):
    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        data = np.load(self.options["path"], mmap_mode="r", allow_pickle=False)
        if data.dtype.kind not in "fiubUS" or data.ndim not in (1, 2):
            raise ValueError("only one- and two-dimensional arrays of numbers or text")
        if data.ndim == 2:
            return "row_index bigint, value array<float>"
        kind = {"f": "double", "U": "string", "S": "string"}.get(data.dtype.kind, "bigint")
        return f"row_index bigint, value {kind}"

    def reader(self, schema):
        return NpyReader(self.options["path"], int(self.options.get("rowsPerSlice", ROWS_PER_SLICE)))
