"""SimHash near-dedup with covering locality-sensitive hashing.

A text is a sequence of blank-separated words (ASCII capitals lowered); its shingles are `WORDS`
consecutive words joined by one space (a shorter text is one shingle), repeats included. Bit i of the
64-bit fingerprint is set if it is set in over half of the shingles' XXH64 hashes (seed 42).

Two fingerprints are linked if at most `radius` bits differ. The tables come from a covering family: every
free bit position i has a vector m(i) of radius + 1 bits, and for each non-zero vector v there is one
table, whose key keeps the bits with an odd inner product <m(i), v>. At most `radius` differing
positions span a space with some non-zero v orthogonal to all of their vectors, and in that table none
of them is in the key: every pair within the radius collides in some table, with certainty. All
positions being dealt evenly to the vectors, a key has about half of the bits.

Only distinct fingerprints enter the tables, so copies and empty texts are one item. A bucket of more than
`CROWD` fingerprints is split by the same construction over the bits that its key leaves free (half of
them; pairs still collide for the same reason); after that at most `FREE` bits are free, so no
bucket holds more than 2**FREE fingerprints, however large the input. Pairs are looked at inside the join of a bucket with
itself and come out only within the radius. Components are found by rounds of joins.

Edge cases: null and empty texts and texts of blanks have the fingerprint 0 and are linked like any other;
equal texts, repeated rows and texts of any length are whole items, one output row per input row; a null
key takes part, but is no component id (null only if no member has a key); further columns of the
input, whatever their names, are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import is_empty, materialize
from arbora.llm.registry import query, table
from arbora.operators.components import connected

WORDS, SEED = 4, 42
RADIUS = 4
CROWD = 64  # fingerprints of a bucket that are compared with each other
FREE = 16  # free bits from which on no bucket is split
SLICE = 100_000  # shingles whose bits are counted at once


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text; memory beyond the text is bounded by slices of shingles."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    size = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest, n = xxhash.xxh64_intdigest, len(found) - size + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        upto = min(at + SLICE, n)
        spans = zip(starts[at:upto].tolist(), ends[at + size - 1:upto + size - 1].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _prints(words: int, seed: int):
    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["id", "print"])
    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, print): the fingerprint of every row as a signed long."""
    kind = docs.schema[key].dataType.simpleString()
    cut = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return cut.mapInArrow(_prints(words, seed), f"id {kind}, print bigint")


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the positions set in `free`; any `radius` of these lie outside of some mask altogether."""
    vectors = (1 << (radius + 1)) - 1
    places = [i for i in range(64) if free >> i & 1]
    dealt = {p: 1 + i % vectors for i, p in enumerate(places)}
    return [sum(1 << p for p in places if (dealt[p] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _spread(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """(fixed, bucket, print) of every print under all masks of its table `fixed`, the union of the masks so far."""
    return (rows.join(F.broadcast(masks), "fixed").select("print", F.explode("masks").alias("fixed"))
            .select("fixed", F.xxhash64("fixed", F.col("print").bitwiseAND(F.col("fixed"))).alias("bucket"), "print"))


def links(prints: DataFrame, radius: int = RADIUS, crowd: int | None = None) -> DataFrame:
    """The pairs (a, b), a < b, of distinct values of `print` with at most `radius` differing bits.

    A pair may come out of several tables. The masks follow from `radius` alone: fewer than 2**(radius + 1)
    on the first level and fewer than the square of that on the second, which runs only if a bucket is crowded.
    """
    spark, crowd = prints.sparkSession, CROWD if crowd is None else crowd
    rows = prints.select("print").distinct().withColumn("fixed", F.lit(0).cast("long"))
    fixed, found = {0}, None
    while fixed:
        families = {f: sorted({f | m for m in covering_masks(~f & (2**64 - 1), radius)}) for f in fixed}
        last = all(m.bit_count() >= 64 - FREE for ms in families.values() for m in ms)
        masks = spark.createDataFrame([(_signed(f), [_signed(m) for m in ms]) for f, ms in families.items()],
                                      "fixed long, masks array<long>")
        spread = _spread(rows, masks)
        sizes = (spread.groupBy("fixed", "bucket").agg(F.count("*").alias("n"), F.min("print").alias("_low"), F.max("print").alias("_high"))
                 .where("_low <> _high").select("fixed", "bucket", "n"))
        shared = materialize(spread.join(materialize(sizes), ["fixed", "bucket"]))
        few = shared if last else shared.where(F.col("n") <= crowd)
        other = few.select("fixed", "bucket", F.col("print").alias("b"))
        pairs = (few.withColumnRenamed("print", "a").join(other, ["fixed", "bucket"])
                 .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
                 .select("a", "b"))
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        rows = shared.where(F.col("n") > crowd).select("print", "fixed").distinct()
        fixed = {r[0] & (2**64 - 1) for r in rows.select("fixed").distinct().collect()}  # masks, no data
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS,
                    words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(key, fingerprint, component_id) per row; component_id is the smallest key of the component."""
    items = materialize(fingerprints(docs, key, text, words, seed))
    prints = materialize(items.groupBy("print").agg(F.min("id").alias("first")))
    pairs = materialize(links(prints, radius).distinct())
    if is_empty(pairs):
        names = prints
    else:
        roots = connected(pairs).select(F.col("node").alias("print"), "root")
        placed = materialize(prints.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")))
        lowest = placed.groupBy("root").agg(F.min("first").alias("_lowest"))
        names = placed.join(lowest, "root").select("print", F.col("_lowest").alias("first"))
    return (items.join(names, "print")
            .select(F.col("id").alias(key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id")))


@query("op12_simhash")
def op12_simhash(spark, folder):
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, folder, "documents"))
