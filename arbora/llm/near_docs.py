"""MinHash near-dedup of documents with ProbMinHash signatures.

Shingles are `WORDS` consecutive blank-separated words (ASCII capitals lowered), with the weight
1 + ln(occurrences), so that no repeated shingle alone decides a signature; a text of fewer words is one shingle. Every shingle sends a Poisson process of arrivals
with its weight as rate, each arrival hits one register at random, and a register keeps the shingle
that hits it first; a shingle stops as soon as its next arrival is later than all registers. Two
signatures agree in a register with the probability Jaccard similarity of the weighted sets. Links are
decided by the sets, whose similarity the weights can lower without limit, so a text with a repeated
shingle has a second signature with equal weights (that of a text without one is the same either way):
two texts at set Jaccard 0.8 share a band with the stated probability whatever they repeat. Bands of
`ROWS` registers make buckets; pairs from a bucket are verified by the exact Jaccard similarity of
their shingle sets, and linked at `threshold`. Classes are the connected components.

Texts with equal shingle sets are one item from the start, so copies never meet in a bucket.

Edge cases: null texts and texts without words have no shingles and are classes of their own; repeated
rows of one id belong to one class and stay or go together; a null id sorts before all others; further
columns are carried along, columns with the names of the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import materialize
from arbora.llm import spans
from arbora.llm.linkage import classes
from arbora.llm.registry import query, table

WORDS = 5
ROWS, BANDS = 4, 16  # a pair at 0.8 shares a band with probability 0.9998
THRESHOLD = 0.8
BLOCK = 500_000

REGISTERS = ROWS * BANDS


def shingles(data: np.ndarray, bounds: np.ndarray):
    """(text, shingle, weight), each pair once, ordered by text and shingle."""
    data = spans.LOWER[data]
    starts, ends, text = spans.words(data, bounds)
    hashes = spans.Prefix(data).spans(starts, ends)
    full, at = spans.windows(hashes, text, WORDS)
    owner = text[at]
    size = np.bincount(text, minlength=len(bounds) - 1)
    small = (size[text] < WORDS) if len(text) else np.zeros(0, bool)
    if small.any():
        t, h = text[small], hashes[small]
        head = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        order = np.arange(len(t)) - np.repeat(head, np.diff(np.append(head, len(t))))
        whole = spans.mix(np.add.reduceat(spans.mix(h + order.astype(np.uint64)), head))
        owner, full = np.append(owner, t[head]), np.append(full, whole)
    order = np.lexsort((full, owner))
    owner, full = owner[order], full[order]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (full[1:] != full[:-1]))) if len(full) else order
    return owner[new], full[new], 1 + np.log(np.diff(np.append(new, len(full))))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash registers (shingle hashes) of `n` texts; rows of texts without shingles stay 0."""
    first = np.full(n * REGISTERS, np.inf)
    holder = np.zeros(n * REGISTERS, np.uint64)
    arrival = np.zeros(len(shingle))
    turn = 0
    while len(shingle):
        draw = spans.mix(shingle ^ spans.mix(np.full(1, turn + 1, np.uint64)))
        arrival = arrival - np.log1p((draw >> np.uint64(11)).astype(float) * -(2.0**-53)) / weight
        slot = text * REGISTERS + (draw & np.uint64(REGISTERS - 1)).astype(np.int64)
        np.minimum.at(first, slot, arrival)
        won = arrival == first[slot]
        holder[slot[won]] = shingle[won]
        last = first.reshape(n, REGISTERS).max(axis=1)
        on = arrival < last[text]
        text, shingle, weight, arrival = text[on], shingle[on], weight[on], arrival[on]
        turn += 1
    return holder.reshape(n, REGISTERS)


def bands(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int):
    """(text, bucket), ordered by text: `BANDS` of every text, and as many again of texts with unequal weights."""
    uneven = np.zeros(n, bool)
    uneven[owner[weight > 1]] = True
    mine, place = uneven[owner], np.cumsum(uneven) - 1
    regs = np.concatenate([signatures(owner, shingle, weight, n),
                           signatures(place[owner[mine]], shingle[mine], np.ones(int(mine.sum())), int(uneven.sum()))])
    regs = regs.reshape(len(regs), BANDS, ROWS)
    made = np.tile(np.arange(BANDS, dtype=np.uint64), (len(regs), 1))
    for r in range(ROWS):
        made = spans.mix(made * np.uint64(0x9E3779B97F4A7C15) ^ regs[:, :, r])
    text = np.repeat(np.append(np.arange(n), np.flatnonzero(uneven)), BANDS)
    order = np.argsort(text, kind="stable")
    return text[order], made.ravel()[order]


def _sketch(batches):
    for batch in batches:
        texts = spans.column(batch, "_text")
        for first, last, data, bounds in spans.blocks(texts, BLOCK):
            n = last - first
            owner, shingle, weight = shingles(data, bounds)
            held = np.bincount(owner, minlength=n) > 0
            item = np.zeros(n, np.uint64)
            np.add.at(item, owner, spans.mix(shingle))
            text, bucket = bands(owner, shingle, weight, n)
            ends = np.append(0, np.cumsum(np.bincount(text, minlength=n)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array(item.view(np.int64), mask=~held), lists], ["_id", "item", "bands"])


def _sets(batches):
    for batch in batches:
        texts = spans.column(batch, "_text")
        for first, last, data, bounds in spans.blocks(texts, BLOCK):
            n = last - first
            owner, shingle, _ = shingles(data, bounds)
            size = np.bincount(owner, minlength=n)
            item = np.zeros(n, np.uint64)
            np.add.at(item, owner, spans.mix(shingle))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()),
                                             pa.array(shingle.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(item.view(np.int64), mask=size == 0), lists], ["id", "shingles"])


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(_id, item, class): one row per distinct id and text, class being the smallest id of its class."""
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    items = materialize(texts.mapInArrow(_sketch, f"_id {kind}, item bigint, bands array<bigint>"))
    named = items.where("item is not null")
    buckets = named.dropDuplicates(["item"]).select(F.col("item").alias("id"), F.explode("bands").alias("bucket"))

    def sets(ids: DataFrame) -> DataFrame:
        wanted = ids.withColumnRenamed("id", "item")
        speakers = named.select("item", "_id").join(wanted, "item").groupBy("item").agg(F.min("_id").alias("_wanted"))
        some = texts.join(speakers.select("_wanted").distinct(), F.col("_id").eqNullSafe(F.col("_wanted")), "left_semi")
        found = some.mapInArrow(_sets, "id bigint, shingles array<bigint>")
        return found.join(ids, "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("shingles"))

    roots = classes(buckets, sets, threshold).select(F.col("id").alias("item"), "root")
    placed = named.select("_id", "item").distinct().join(roots, "item", "left").withColumn("root", F.coalesce("root", "item"))
    # A null id sorts first, so it names its class wherever it occurs.
    names = placed.groupBy("root").agg(F.when(F.max(F.col("_id").isNull()), None).otherwise(F.min("_id")).alias("class"))
    known = placed.join(names, "root").select("_id", "item", "class")
    alone = items.where("item is null").select("_id", "item", F.col("_id").alias("class")).distinct()
    return known.unionByName(alone)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_id, kept): one row per distinct id; an id with several texts has the smallest class of them."""
    found = near_classes(docs, key, text, threshold)
    return (found.groupBy("_id").agg(F.when(F.max(F.col("class").isNull()), None).otherwise(F.min("class")).alias("class_id"))
            .withColumn("kept", F.col("_id").eqNullSafe(F.col("class_id"))).withColumnRenamed("_id", key))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with the first document of every class only."""
    stay = near_duplicates(docs, key, text, threshold).where("kept").select(F.col(key).alias("_stay"))
    return docs.join(stay, F.col(key).eqNullSafe(F.col("_stay")), "left_semi")


_TWIN = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 4], 'string_agg', ' ') s
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) n FROM sh GROUP BY doc_id),
    common AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    pair AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
    link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
    reach AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
    SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM reach GROUP BY a"""


@query("op1_near_docs", _TWIN)
def op1_near_docs(spark, folder):
    """Class of every document and whether it stays as the first of its class."""
    return near_duplicates(table(spark, folder, "documents"))
