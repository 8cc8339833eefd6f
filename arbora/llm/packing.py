"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

Documents are cut into pieces of `CAPACITY` ids and a rest. Only the histogram of piece lengths (at
most `CAPACITY` rows) reaches the driver. Lengths are placed longest first; each goes to the packs with
the most room left, and a pack is a pattern with a count, so one step places any number of pieces.
The resulting slots (length, range of ranks, first sequence, offset) are joined back to the
pieces by their rank among the pieces of their length. Ranks come from salted groups: counts per
(length, salt) give the offsets, so the pieces of a popular length never meet in one task.

A sequence is padded to `CAPACITY` unless its ids fill a power of two, which is stored as it is.

Edge cases: a null or empty text is its end id alone; repeated rows and equal ids are documents of
their own; a null document id is carried along; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.core import materialize
from arbora.llm import spans
from arbora.llm.registry import query, table
from arbora.llm.token_ids import Encoder, encoded

CAPACITY = 1024
RANK_ROWS = 100_000  # pieces per salted group


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens[, ids]): every document cut into pieces."""
    kind = docs.schema[key].dataType.simpleString()
    path = path or tokenizer_path()

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            texts = spans.column(batch, "_text")
            for first, last, ids, bounds in encoded(texts, encoder):
                size = np.diff(bounds)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(last - first), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(size[doc] - start, capacity)
                raw, begin = memoryview(ids.astype("<u4").tobytes()), (bounds[doc] + start) * 4
                cut = [raw[b:b + 4 * k] for b, k in zip(begin.tolist(), length.tolist())]
                cols = [batch.column(0).slice(first, last - first).take(pa.array(doc)), pa.array(start), pa.array(length),
                        pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(size[doc])]
                names = ["_key", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array([bytes(c) for c in cut], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"_key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids binary" if with_ids else "")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return texts.mapInArrow(run, schema).withColumnRenamed("_key", key)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(count, lengths) of the packs made by shortest-pack-first, in order of their last placement."""
    room: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            widest = max((r for r, packs in room.items() if packs and r >= length), default=None)
            if widest is None:
                room.setdefault(capacity - length, []).append((left, [length]))
                break
            count, pack = room[widest].pop()
            used = min(count, left)
            if used < count:
                room[widest].append((count - used, pack))
            room.setdefault(widest - length, []).append((used, [*pack, length]))
            left -= used
    return [p for r in sorted(room) for p in room[r]]


def slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset, fill) of every place in the packs."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for count, pack in patterns(histogram, capacity):
        offset = 0
        for length in pack:
            rank = ranks.get(length, 0)
            out.append((length, rank, rank + count - 1, sequence, offset, sum(pack)))
            ranks[length] = rank + count
            offset += length
        sequence += count
    return out


def _ranked(rows: DataFrame, total: int) -> DataFrame:
    """Add `rank`, 0, 1, 2, ... among the rows of each length."""
    salts = max(1, -(-total // RANK_ROWS))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    held = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("length", "_salt").orderBy(*rows.columns)
    numbered = salted.withColumn("_at", F.row_number().over(inner) - 1)
    return numbered.join(offsets, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_at")).drop("_salt", "_before", "_at")


def _slot_table(spark: SparkSession, found: list[tuple]) -> DataFrame:
    names = "length bigint, lo bigint, hi bigint, first bigint, offset bigint, fill bigint"
    return spark.createDataFrame([tuple(map(int, s)) for s in found], names)


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (with a `length`) with their sequence_id, offset and the sequence's stored size."""
    rows = materialize(rows)
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _slot_table(rows.sparkSession, slots(histogram, capacity)).withColumnRenamed("length", "_length")
    ranked = _ranked(rows, sum(histogram.values()))
    # Slots are bounded by the patterns of one histogram, whatever the number of pieces.
    joined = ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & F.col("rank").between(F.col("lo"), F.col("hi")))
    power = F.col("fill").bitwiseAND(F.col("fill") - 1) == 0
    return joined.select(*rows.columns, (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset",
                         F.when(power, F.col("fill")).otherwise(capacity).cast("bigint").alias("sequence_length"))


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, padded with `pad_id`."""
    placed = packed(pieces(docs, key, text, capacity, with_ids=True), capacity)
    whole = placed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.max("sequence_length").alias("size"))

    def run(batches):
        for batch in batches:
            out = []
            for parts, size in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = np.full(size, pad_id, "<u4")
                for p in parts:
                    piece = np.frombuffer(p["ids"], "<u4")
                    ids[p["offset"]:p["offset"] + len(piece)] = piece
                out.append(ids.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["sequence_id", "ids"])

    return whole.select("sequence_id", "parts", "size").mapInArrow(run, "sequence_id bigint, ids array<bigint>")


@query("op2_packing")
def op2_packing(spark, folder):
    """Every piece of every document with its place in the packed sequences."""
    return packed(pieces(table(spark, folder, "documents")))
