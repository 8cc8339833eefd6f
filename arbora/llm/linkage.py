"""From buckets of similar items to verified classes, without listing all pairs of a bucket.

Items that share a bucket are candidates. Two candidates are linked when the exact Jaccard similarity of
their shingle sets reaches the threshold; classes are the connected components.

1. *Narrowing.* Many unlike items can share buckets through one frequent passage. So the shingles of every
   candidate are ordered from rare to frequent (counted over all candidates). At the first shingle that two
   sets have in common, the overlap is at most what is left of either set from there on (`left`), and it has
   to be at least t / (1 + t) of both sizes together. A row (item, shingle, level) is written for every
   size level of the smaller partner that this bound leaves possible; a frequent passage lies
   behind these rows, and a linked pair always shares one of them.
2. *Rounds.* A shingle and level held by items of two or more classes is open. It names leaders (those with
   most left: the most typical ones), all its items of other classes are compared with them, links merge
   classes, and the leaders leave: all their pairs are settled. Copies therefore cost one comparison each and
   not one per pair. The number of leaders grows
   eightfold, so the rounds grow with the logarithm of the largest group.
3. When the pairs of different classes that are left are no more than `LEFTOVER` per row, they are looked at
   at once; those that the bound of step 1 excludes are dropped inside the join.

Where sizes and bitmaps of the sets are at hand (`bitmaps`), the pairs of all rounds but the first are also held
against a bound from these, inside the join: a bit that only one of two bitmaps has stands for at least one
shingle that only one of the sets has. A pair looked at once for all comes out at one of its buckets only.

A pair is skipped only if its two items are already in one class or cannot reach the threshold, so no link
that could join two classes is lost.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.core import is_empty, materialize
from arbora.llm.storage import stored
from arbora.operators.components import connected

LEFTOVER = 256  # pairs per row that may be looked at at once
LEADERS = 4  # leaders per open shingle in the first round
LEVEL = 1.12  # ratio of the sizes between two levels
# 64-bit words of a bitmap. Two rows of so many columns pass `spark.sql.codegen.maxFields`, so the condition of their
# join is compiled in pieces; as one method it is too long for the JVM's compiler and takes seven times as long.
WORDS = 48
BITMAP = [f"_w{k}" for k in range(WORDS)]


def similar_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets (id, shingles) have at least this Jaccard similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_a", "_b"))
    return (both.select("a", "b", common.alias("_n"), (F.size("_a") + F.size("_b")).alias("_m"))
            .where(F.col("_n") >= F.lit(threshold) * (F.col("_m") - F.col("_n"))).select("a", "b"))


def fronts(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, bucket, left, n): where a set of n shingles may meet a similar one for the first time.

    A bucket is a shingle that several sets hold, together with a size level of the smaller partner.
    """
    held = sets.select("id", F.explode("shingles").alias("shingle"))
    common = held.groupBy("shingle").agg(F.count("*").alias("_n")).where("_n > 1")
    ordered = (held.join(common, "shingle", "left")
               .groupBy("id").agg(F.sort_array(F.collect_list(
                   F.struct(F.coalesce("_n", F.lit(1)).alias("holders"), F.col("shingle")))).alias("_held"))
               .withColumn("n", F.size("_held")))
    front = F.slice("_held", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-6) + 1).cast("int"))
    rows = ordered.select("id", "n", F.posexplode(front).alias("_at", "_x")).where("_x.holders > 1")
    own = F.floor(F.log("n") / math.log(LEVEL) + 1e-9)
    span = math.ceil(math.log(1 / threshold) / math.log(LEVEL))
    rows = rows.select("id", "n", (F.col("n") - F.col("_at")).alias("left"), F.col("_x.shingle").alias("shingle"),
                       F.explode(F.sequence(own - span, own)).alias("_level"))
    least = F.greatest(F.col("n") * threshold, F.pow(F.lit(LEVEL), F.col("_level")))
    return (rows.where(F.col("left") >= _needed(F.col("n") + least, threshold))
            .select("id", F.xxhash64("shingle", "_level").alias("bucket"), "left", "n"))


def _needed(sizes, threshold: float):
    """The least overlap of two sets with these sizes together."""
    return sizes * (threshold / (1 + threshold)) - 1e-6


def _may_reach(other: list[str], threshold: float) -> Column:
    """Whether two sets with these (size, bits set, words) may be similar enough; `other` renames those of the second."""
    (size, bits, *words), (size2, bits2, *words2) = [[F.col(c) for c in names] for names in (["_size", "_bits", *BITMAP], other)]
    both = functools.reduce(operator.add, [F.bit_count(x.bitwiseAND(y)) for x, y in zip(words, words2)])
    one, two = bits - both, bits2 - both  # at least so many shingles are in the one or the other set alone
    return ((size - one >= F.lit(threshold) * (size + two) - 1e-6) & (size2 - two >= F.lit(threshold) * (size2 + one) - 1e-6))


def _shared_rows(buckets: DataFrame) -> DataFrame:
    """The rows (id, bucket) of buckets that hold different ids, by one shuffle of the buckets."""
    group = Window.partitionBy("bucket")
    return (buckets.withColumns({"_low": F.min("id").over(group), "_high": F.max("id").over(group)})
            .where("_low <> _high").select("id", "bucket").distinct())


def classes(buckets: DataFrame, sets_of, threshold: float, similar=None, bitmaps=None) -> DataFrame:
    """(id, root) of every item that is linked to another one; root is the smallest id of the class.

    `buckets` (id, bucket) may repeat rows. `sets_of` gets a table of the ids that share a bucket with
    another one and returns (id, shingles), one array without repeats per item. Items without a link
    have no row. Empty tables give an empty table. With `similar` (pairs, items ->
    pairs that are linked), `sets_of` may return any table of the items, and the rounds compare the items of
    the buckets themselves: for selective buckets of sets whose rarest shingles are still frequent. `bitmaps` (items ->
    id, `_size`, `BITMAP`) then gives the number of shingles of some of these items and the words of a bitmap with
    the bit of every shingle set.
    """
    rows = None
    if similar is None:
        shared = (buckets.groupBy("bucket").agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
                  .where("_low <> _high").select("bucket"))
        ids = materialize(buckets.join(shared, "bucket", "left_semi").select("id").distinct())
        sets = None if is_empty(ids) else materialize(sets_of(ids))
        similar = lambda pairs, held: similar_pairs(pairs, held, threshold)
        if sets is not None:
            rows = materialize(fronts(sets, threshold))
    else:
        # Sizes are not known before the comparison, so the bound on the overlap excludes nothing.
        held = stored(_shared_rows(buckets))
        ids = materialize(held.select("id").distinct())
        sets = None if is_empty(ids) else sets_of(ids)
        if sets is not None:
            rows = held.withColumns({"left": F.lit(1), "n": F.lit(1)})
    found, links, leading, going = None, None, LEADERS, rows is not None
    while going:
        placed = rows if found is None else rows.join(found, "id", "left")
        placed = placed.withColumn("class", F.coalesce("root", "id") if found is not None else F.col("id"))
        sizes = placed.groupBy("bucket", "class").agg(F.count("*").alias("_n"))
        n = F.col("_n").cast("double")
        open_buckets = materialize(
            sizes.groupBy("bucket").agg(
                F.count("*").alias("_classes"), F.sum(n).alias("_rows"),
                ((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).alias("_pairs"))
            .where("_classes > 1"))
        left = open_buckets.agg(F.sum("_pairs"), F.sum("_rows")).first()
        if not left[0]:
            break
        at_once = leading > LEADERS and left[0] <= LEFTOVER * left[1]  # the first round settles the copies
        placed = materialize(placed.join(open_buckets.select("bucket"), "bucket", "left_semi").select("bucket", "id", "class", "left", "n"))
        reach = (F.least("left", "_left") >= _needed(F.col("n") + F.col("_m"), threshold)) & (F.col("class") != F.col("_class"))
        compared, more, renamed = placed, [], []
        if bitmaps is not None and leading > LEADERS:
            held_in = placed.groupBy("id").agg(F.collect_set("bucket").alias("_in"))
            maps = bitmaps(sets.join(held_in.select("id"), "id", "left_semi"))
            bits = functools.reduce(operator.add, [F.bit_count(c) for c in BITMAP])
            compared = materialize(placed.join(materialize(maps.withColumn("_bits", bits)), "id").join(held_in, "id"))
            more = ["_in", "_size", "_bits", *BITMAP]
            renamed = [f"{c}_" for c in more]
        if at_once:
            other = compared.select(F.col("bucket").alias("_b"), F.col("id").alias("other"), F.col("class").alias("_class"),
                                    F.col("left").alias("_left"), F.col("n").alias("_m"),
                                    *[F.col(c).alias(r) for c, r in zip(more, renamed)])
            reach = reach & (F.col("id") < F.col("other"))
        else:
            # The hash orders all ids alike, so that the shingles of one group name the same leaders.
            rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("left"), F.xxhash64("id"), "id"))
            other = materialize(compared.withColumn("_rank", rank).where(F.col("_rank") <= leading).select(
                F.col("bucket").alias("_b"), F.col("id").alias("other"), F.col("class").alias("_class"),
                F.col("left").alias("_left"), F.col("n").alias("_m"), *[F.col(c).alias(r) for c, r in zip(more, renamed)]))
            leading *= 8
        if more:
            reach = reach & _may_reach(renamed[1:], threshold)
            if at_once:
                reach = reach & (F.array_min(F.array_intersect("_in", "_in_")) == F.col("bucket"))
        pairs = (compared.join(other, (F.col("bucket") == F.col("_b")) & reach)
                 .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
        new = materialize(similar(pairs, sets))
        if not is_empty(new):
            links = new if links is None else links.unionByName(new)
            found = connected(links).select(F.col("node").alias("id"), "root")
        if at_once:
            break
        used = other.select(F.col("_b").alias("bucket"), F.col("other").alias("id"))
        rows = materialize(placed.join(used, ["bucket", "id"], "left_anti").drop("class"))
        going = not is_empty(rows)
    if found is None:
        return ids.select("id", F.col("id").alias("root")).limit(0)
    return found
