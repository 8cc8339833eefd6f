"""Writers: Parquet tables, CSV files, JSON files, and publishing a folder in two recoverable steps.

A result is built in a hidden folder beside its place and marked ready once everything is there. Replacing an
old result renames the old one aside, renames the new one in and deletes the old one. Whatever step fails, `recover`
(called before every publish and every read of a configuration) finds either the old or the new result whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.core import ContractError, at_most

CODECS = ("zstd", "snappy", "gzip", "none")


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.exists(target)


def write_table(df: DataFrame, path: str, compression: str = "zstd", overwrite: bool = False) -> None:
    if compression not in CODECS:
        raise ContractError(f"compression must be one of {CODECS}")
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder, one part for a table of checked size; arrays become JSON text."""
    columns = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct")
               else F.col(f.name) for f in df.schema]
    rows = df.select(*columns)
    (rows.coalesce(1) if at_most(df) else rows).write.mode("errorifexists").csv(path, header=True)


def _move(spark: SparkSession, old: str, new: str) -> None:
    fs, source = _filesystem(spark, old)
    if not fs.rename(source, _filesystem(spark, new)[1]):
        raise ContractError(f"could not move {old} to {new}")


def _remove(spark: SparkSession, path: str) -> None:
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A text file that appears whole or not at all."""
    if exists(spark, path) and not overwrite:
        raise ContractError(f"{path} exists")
    folder, name = _split(path)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}"
    fs, target = _filesystem(spark, hidden)
    out = fs.create(target, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if overwrite else rename.NONE
    final = fs.makeQualified(_filesystem(spark, path)[1])
    hadoop.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(target), final, how)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_summary(df: DataFrame, path: str, **extra) -> dict:
    """A one-row table as a JSON file."""
    row = df.limit(2).collect()
    if len(row) != 1:
        raise ContractError("a summary has exactly one row")
    content = {**row[0].asDict(recursive=True), **extra}
    write_text(df.sparkSession, path, json.dumps(content, indent=2, default=str) + "\n")
    return content


READY = "_ready"


def _split(path: str) -> tuple[str, str]:
    parent, _, name = path.rstrip("/").rpartition("/")
    return parent or ".", name


def _beside(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """The hidden folders of one kind that earlier publishing of `folder` has left."""
    parent, name = _split(folder)
    fs, place = _filesystem(spark, parent)
    if not fs.exists(place):
        return []
    start = f".{name}.{kind}-"
    return sorted(f"{parent}/{s.getPath().getName()}" for s in fs.listStatus(place) if s.getPath().getName().startswith(start))


def recover(spark: SparkSession, folder: str) -> None:
    """Finish or undo a replacement that stopped half-way; without one, nothing happens."""
    for old in _beside(spark, folder, "old"):
        new = old.replace(".old-", ".building-")
        if exists(spark, folder):
            _remove(spark, old)
        elif exists(spark, f"{new}/{READY}"):
            _move(spark, new, folder)
            _remove(spark, old)
        else:
            _move(spark, old, folder)


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], config: dict | None = None,
            compression: str = "zstd", overwrite: bool = False) -> str:
    """Write all tables to a hidden folder beside `folder` and put it in place once everything is there.

    A failed run leaves its partial folder and never touches an existing result.
    """
    recover(spark, folder)
    parent, name = _split(folder)
    tag = uuid.uuid4().hex[:8]
    building, old = f"{parent}/.{name}.building-{tag}", f"{parent}/.{name}.old-{tag}"
    if exists(spark, folder) and not overwrite:
        raise ContractError(f"{folder} exists")
    for table, df in tables.items():
        write_table(df, f"{building}/{table}.parquet", compression)
    if config is not None:
        write_text(spark, f"{building}/run_config.json", json.dumps(config, indent=2, default=str) + "\n")
    write_text(spark, f"{building}/{READY}", tag)
    if exists(spark, folder):
        _move(spark, folder, old)
    _move(spark, building, folder)
    if exists(spark, old):
        _remove(spark, old)
    return folder


def read_config(spark: SparkSession, folder: str) -> dict:
    recover(spark, folder)
    return json.loads(read_text(spark, f"{folder}/run_config.json"))


def resolve_inputs(spark: SparkSession, folder: str, *keys: str) -> list[str]:
    """Follow the recorded inputs of a run: folder -> config[key] -> its config[next key] -> ..."""
    found = []
    for key in keys:
        folder = read_config(spark, folder).get(key)
        if not folder:
            raise ContractError(f"run configuration names no {key}")
        found.append(folder)
    return found


def reusable(spark: SparkSession, folder: str, config: dict) -> bool:
    """A saved result whose whole configuration equals this one need not be computed again."""
    recover(spark, folder)
    if not exists(spark, f"{folder}/run_config.json"):
        return False
    return read_config(spark, folder) == json.loads(json.dumps(config, default=str))
