"""Repeated byte strings by prefix-free parsing: every byte covered by an earlier `LENGTH`-byte string goes.

* Parsing. A rolling hash is taken of every `GRAM` bytes; the trigger of a `LENGTH`-byte string is the
  smallest (leftmost) hash inside it, so equal strings have equal triggers at equal offsets. A phrase is
  a maximal run of string starts with one trigger, with the bytes of its last string: neighbouring
  phrases overlap by `LENGTH` - 1 bytes, and every string lies in exactly one phrase.
* Parse. Phrases are counted by trigger; those whose trigger occurs once hold no repeated string.
  Of equal phrases the first in corpus order (document id, start) stays, every later one is covered.
* Dictionary. Different phrases with one trigger may share strings. The suffixes of these phrases are
  ordered by the fingerprints of their first `LENGTH` bytes, all phrases of a bucket of triggers together;
  within a run of equal suffixes all but the first in corpus order are covered.
* A trigger with more than `CROWD` different phrases is not sorted in one task: its strings go out as
  hashes and are compared by a partial aggregate.

Only equality classes and their first members are asked for, so the corpus-wide order is never written out:
dictionary order and parse positions are combined per class.

Edge cases: a text may have up to 2**28 - 1 bytes; a null or empty text has no bytes; texts shorter than `LENGTH` stay whole; a null document
id sorts first; repeated rows of one id are one place, so a row is never its own copy; further columns
are carried along, columns with the names of the results are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import materialize, shuffle_partitions
from arbora.llm import spans
from arbora.llm.registry import query, table
from arbora.operators.ordering import number_rows

LENGTH, GRAM = 100, 32
CROWD = 2_000
BLOCK = 200_000

_PLACE = np.uint64((1 << 28) - 1)


def _parse(data: np.ndarray, bounds: np.ndarray):
    """(text, start, number of strings, trigger hash, phrase hash) of the phrases of a block."""
    n = len(data)
    if n < LENGTH:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    prefix = spans.Prefix(data)
    gram = prefix.rolling(GRAM)
    low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width, wanted = 1, LENGTH - GRAM + 1
    while width < wanted:
        step = min(width, wanted - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    valid = np.zeros(len(low) + 1, np.int8)
    long = np.diff(bounds) >= LENGTH
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, bounds[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).view(bool)
    begin = valid.copy()
    begin[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(valid & np.append(begin[1:] | ~valid[1:], True)) + 1
    text = spans.owner(starts, bounds)
    place = (low[starts] & _PLACE).astype(np.int64)
    return [text, starts - bounds[text], ends - starts, gram[place], prefix.spans(starts, ends + LENGTH - 1)]


def phrases(docs: DataFrame) -> DataFrame:
    """(trigger, phrase, pos, n): every phrase of (_place, _text), `pos` being its place in the corpus."""
    def run(batches):
        for batch in batches:
            texts = spans.column(batch, "_text")
            places = batch.column(batch.schema.get_field_index("_place")).to_numpy()
            for first, last, data, bounds in spans.blocks(texts, BLOCK):
                text, lo, n, trigger, phrase = _parse(data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64)),
                     pa.array(places[first:last][text] + lo), pa.array(n.astype(np.int32))],
                    ["trigger", "phrase", "pos", "n"])

    return docs.mapInArrow(run, "trigger bigint, phrase bigint, pos bigint, n int")


def _not_first(key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Rows that are not at the smallest position among the rows with their key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    heads = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    first = np.repeat(np.minimum.reduceat(pos[order], heads), np.diff(np.append(heads, len(k)))) if len(k) else k
    out = np.zeros(len(k), bool)
    out[order] = pos[order] != first
    return out


def _joined(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column end to end and where each value begins and ends in them."""
    raw = raw.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2], np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def _order_suffixes(tab: pa.Table) -> pa.Table:
    """Covered strings among the phrases of one bucket of triggers, as runs of positions."""
    tab = tab.combine_chunks()
    data, bounds = _joined(tab.column("bytes").chunk(0))
    count = np.diff(bounds) - (LENGTH - 1)
    shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(bounds[:-1], count) + shift
    pos = np.repeat(tab.column("pos").to_numpy(), count) + shift
    gone = np.sort(pos[_not_first(spans.Prefix(data).rolling(LENGTH)[at], pos)])
    head = np.append(True, gone[1:] != gone[:-1] + 1) if len(gone) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(gone)) - 1 if len(first) else first
    return pa.table({"pos": gone[first], "size": gone[last] - gone[first] + LENGTH})


def _cut(batches):
    """Bytes of the wanted phrases of each text; strings of crowded triggers as hashes."""
    names = ["trigger", "pos", "bytes", "hash"]
    for batch in batches:
        texts = spans.column(batch, "_text")
        lists = batch.column(batch.schema.get_field_index("wanted"))
        places = batch.column(batch.schema.get_field_index("_place")).to_numpy()
        per = np.diff(lists.offsets.to_numpy())
        w = lists.flatten()
        trigger, pos, n, crowded = (w.field(k).to_numpy(zero_copy_only=False) for k in ("trigger", "pos", "n", "crowded"))
        row = np.repeat(np.arange(len(texts)), per)
        for first, last, data, bounds in spans.blocks(texts, BLOCK):
            mine = (row >= first) & (row < last)
            start = bounds[row[mine] - first] + pos[mine] - places[row[mine]]
            size, many = n[mine], crowded[mine].astype(bool)
            raw = data.tobytes()
            few = ~many
            cut = [raw[i:i + k + LENGTH - 1] for i, k in zip(start[few].tolist(), size[few].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(trigger[mine][few]), pa.array(pos[mine][few]), pa.array(cut, pa.binary()),
                 pa.nulls(len(cut), pa.int64())], names)
            if many.any():
                shift = np.concatenate([np.arange(k) for k in size[many]])
                at = np.repeat(start[many], size[many]) + shift
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(at), pa.int64()), pa.array(np.repeat(pos[mine][many], size[many]) + shift),
                     pa.nulls(len(at), pa.binary()), pa.array(spans.Prefix(data).rolling(LENGTH)[at].view(np.int64))], names)


def placed(docs: DataFrame, key: str, text: str, rest: list[str]) -> DataFrame:
    """`rest` columns, `_text` and `_place`, the corpus position of the text's first byte.

    Positions order documents by id and leave room for 2**28 bytes each. Ids that span less than 2**35
    are used as they are; others are replaced by their rank.
    """
    span = docs.agg(F.min(F.col(key).cast("long")).alias("lo"), F.max(F.col(key).cast("long")).alias("hi")).first()
    lo = span.lo if span.lo is not None else 0
    number = F.coalesce(F.col(key).cast("long") - lo + 1, F.lit(0))
    if span.lo is None or span.hi - span.lo < (1 << 35) - 2:
        return docs.select(*rest, F.col(text).alias("_text"), F.call_function("shiftleft", number, F.lit(28)).alias("_place"))
    ranks = number_rows(docs.select(F.col(key).cast("long").alias("_key")).distinct(), [], ["_key"], "_rank")
    ranks = materialize(ranks)
    return docs.join(ranks, F.col(key).cast("long").eqNullSafe(F.col("_key"))).select(
        *rest, F.col(text).alias("_text"), F.call_function("shiftleft", "_rank", F.lit(28)).alias("_place"))


def covered(docs: DataFrame) -> DataFrame:
    """(pos, size): byte intervals of (_place, _text) covered by earlier strings; they may overlap."""
    parsed = phrases(docs)
    twice = materialize(parsed.groupBy("trigger").agg(F.count("*").alias("c")).where("c > 1").select("trigger"))
    parse = materialize(parsed.join(twice, "trigger", "left_semi"))
    book = materialize(parse.groupBy("trigger", "phrase").agg(
        F.min("pos").alias("first"), F.min("n").alias("n"), F.count("*").alias("c")))
    again = book.where("c > 1").select("phrase", "first")
    later = (parse.join(again, "phrase").where("pos <> first")
             .select("pos", (F.col("n") + LENGTH - 1).cast("bigint").alias("size")))
    shared = book.groupBy("trigger").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = (book.join(shared, "trigger")
              .select((F.col("first") - F.col("first") % (1 << 28)).alias("_want"), F.struct(
                  "trigger", F.col("first").alias("pos"), "n", (F.col("kinds") > CROWD).alias("crowded")).alias("w"))
              .groupBy("_want").agg(F.collect_list("w").alias("wanted")))
    cut = materialize(docs.select("_place", "_text").join(wanted, F.col("_place") == F.col("_want")).select(
        "_place", "_text", "wanted").mapInArrow(_cut, "trigger bigint, pos bigint, bytes binary, hash bigint"))
    buckets = 16 * shuffle_partitions(docs.sparkSession)
    ordered = (cut.where("bytes is not null").select(F.pmod("trigger", F.lit(buckets)).alias("b"), "pos", "bytes")
               .groupBy("b").applyInArrow(_order_suffixes, "pos bigint, size bigint"))
    strings = cut.where("hash is not null").select("hash", "pos")
    firsts = strings.groupBy("hash").agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1")
    crowded = strings.join(firsts, "hash").where("pos <> first").select("pos", F.lit(LENGTH).cast("bigint").alias("size"))
    return later.unionByName(ordered).unionByName(crowded)


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Maximal covered runs per row, from intervals in any order."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    shift = row * np.int64(1 << 29)
    reach = np.maximum.accumulate(end + shift) if len(row) else end
    head = np.append(True, (start + shift)[1:] > reach[:-1]) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    return row[first], start[first], reach[last] - shift[first]


def _remove(batches, names: list[str]):
    for batch in batches:
        texts = spans.column(batch, "_text")
        lists = batch.column(batch.schema.get_field_index("gone"))
        flat = lists.flatten().to_numpy()
        per = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        start = (flat >> 28) & ((1 << 28) - 1)
        row, start, end = _merged(np.repeat(np.arange(len(texts)), per), start, start + (flat & ((1 << 28) - 1)))
        n_spans = np.bincount(row, minlength=len(texts))
        removed = np.bincount(row, weights=end - start, minlength=len(texts)).astype(np.int64)
        cuts = np.append(0, np.cumsum(n_spans)).tolist()
        start, end = start.tolist(), end.tolist()
        sizes, digests = [], []
        for i, text in enumerate(texts):
            raw, at, digest = memoryview(text.as_buffer()), 0, hashlib.sha256()
            for k in range(cuts[i], cuts[i + 1]):
                digest.update(raw[at:start[k]])
                at = end[k]
            digest.update(raw[at:])
            sizes.append(len(raw))
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(c)) for c in names]
            + [pa.array(sizes, pa.int64()), pa.array(removed), pa.array(n_spans.astype(np.int64)), pa.array(digests)],
            [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the text, plus n_bytes, n_removed, n_spans and kept_sha256."""
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rest = [c for c in docs.columns if c not in (text, *results)]
    texts = placed(docs, key, text, rest)
    pos, size = F.col("pos"), F.col("size")
    gone = (covered(texts).select((pos - pos % (1 << 28)).alias("_gone"),
                                  F.call_function("shiftleft", pos % (1 << 28), F.lit(28)).bitwiseOR(size).alias("cut"))
            .groupBy("_gone").agg(F.collect_list("cut").alias("gone")))
    joined = texts.join(gone, F.col("_place") == F.col("_gone"), "left")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema]
                       + ["n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"])
    return joined.select(*rest, "_text", "gone").mapInArrow(lambda it: _remove(it, rest), schema)


@query("op10_repeats")
def op10_repeats(spark, folder):
    """What is left of every document once bytes of repeated 100-byte strings are gone."""
    return without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
