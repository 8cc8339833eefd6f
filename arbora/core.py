"""Shared plumbing: cutting lineage with written tables, size checks, null-safe joins."""

from __future__ import annotations

import contextlib
import functools
import operator
import tempfile
import uuid
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A table of at most this many rows may be ordered or buffered by one task.
SMALL_ROWS = 500_000

_local_folders: dict[str, str] = {}


class ContractError(ValueError):
    """An input table breaks a rule that the operators rely on."""


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: `spark.checkpoint.dir`, else (local mode only) a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_folders[app]


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written inside leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and return a scan of it; `by` names a column whose values get folders of their own.

    The plan is cut, the rows survive the loss of executors, and everything downstream sees one
    fixed set of values even if `df` holds partition-dependent columns. A table that was just written
    is returned as it is.
    """
    if getattr(df, "_written_rows", None) is not None:
        return df
    spark = df.sparkSession
    counted = Observation()
    path = f"{shared_folder(spark)}/arbora-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path, partitionBy=by)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_rows, table._written_path = counted.get["n"], path
    return table


def discard(table: DataFrame, part: str | None = None) -> None:
    """Delete a written table, or a part of it (`column=value`), that no later step reads."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(filter(None, (table._written_path, part))))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def at_most(df: DataFrame, limit: int = SMALL_ROWS) -> bool:
    """True when `df` has no more than `limit` rows.

    A written table knows its size; anything else is read until shortly after the limit.
    """
    known = getattr(df, "_written_rows", None)
    if known is not None:
        return known <= limit
    return df.select(F.lit(1).alias("_")).limit(limit + 1).count() <= limit


def is_empty(df: DataFrame) -> bool:
    known = getattr(df, "_written_rows", None)
    return df.isEmpty() if known is None else known == 0


def join_on(left: DataFrame, right: DataFrame, columns, how: str = "inner") -> DataFrame:
    """Null-safe join that keeps the left copy of the key columns."""
    if not columns:
        return left.crossJoin(right)
    keys = [(c, f"_key_{i}") for i, c in enumerate(columns)]
    for c, k in keys:
        right = right.withColumnRenamed(c, k)
    terms = [left[c].eqNullSafe(right[k]) for c, k in keys]
    return left.join(right, functools.reduce(operator.and_, terms), how).drop(*[k for _, k in keys])


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as one side of a join by a key with about as many values as rows: both sides are dealt by the key.

    Without this a table just below the broadcast threshold goes through the driver, once per join.
    """
    return df.hint("merge")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def require_columns(df: DataFrame, names, table: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"{table} lacks the columns {missing}")


def require_zero(df: DataFrame, **checks: Column) -> None:
    """Count the rows that break each named rule in one pass and raise on the first broken one."""
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]).first()
    for name in checks:
        if row[name]:
            raise ContractError(f"{name.replace('_', ' ')}: {row[name]} rows")


def require_unique(df: DataFrame, columns, table: str) -> None:
    repeated = df.groupBy(*columns).count().where("count > 1").limit(1).count()
    if repeated:
        raise ContractError(f"{table} repeats a value of {list(columns)}")


def require_contiguous(df: DataFrame, column: str, table: str) -> None:
    """Ids must be exactly 0..n-1."""
    row = df.agg(F.count("*").alias("n"), F.countDistinct(column).alias("d"),
                 F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if row["n"] and (row["d"] != row["n"] or row["lo"] != 0 or row["hi"] != row["n"] - 1):
        raise ContractError(f"{table}.{column} must run from 0 to {row['n'] - 1} without gaps")


def empty_frame(schema: str) -> pd.DataFrame:
    """A pandas frame without rows for a schema text such as "id long, name string"."""
    kinds = {"long": "int64", "int": "int32", "double": "float64", "boolean": "bool"}
    return pd.DataFrame({n: pd.Series([], dtype=kinds.get(t, object))
                         for n, t in (c.split() for c in schema.split(", "))})


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session (once per application)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp")) / "arbora.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, Path("arbora") / source.relative_to(package))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
