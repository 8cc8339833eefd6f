"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet to
the shared folder and reads it back for the next stage. All stages but the last return the columns
of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.core import materialize, ship
from arbora.llm import fuzzy_lines, language_id, near_docs, packing, templates

#: No single SQL statement expresses the learned profiles and the packing; tests compare with plain Python.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; profiles and limits are learned from all labelled documents.

    Texts without letters go, as do those that fit their best profile far worse than labelled texts of
    that language and length do (`language_id.fitting`).
    """
    ship(spark)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of the caller clash with nothing
    text, lang = (f"c{docs.columns.index(c)}" for c in ("text", "lang"))
    known = language_id.profiles(plain, text, lang)
    found = materialize(language_id.predict(plain, known, text, keep_text=True))
    return language_id.fitting(found, text, lang).select(*plain.columns).toDF(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere; those with no line left go."""
    ship(spark)
    done = fuzzy_lines.dedup_lines(docs)
    cut = F.col("lines_dropped") > 0
    done = done.where(~(cut & (F.trim("text") == "")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near copies."""
    ship(spark)
    return near_docs.one_of_each(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return templates.marked(docs, items).where("not contaminated").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left and their places in sequences."""
    ship(spark)
    return packing.packed(packing.pieces(docs))


STAGES = [("language_id", keep_languages), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies),
          ("decontamination", drop_leaks), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
