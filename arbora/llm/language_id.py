"""Language identification by rank-order profiles of byte n-grams.

A text becomes a stream of letters (bytes of ASCII letters in lower case and of all other scripts),
with one blank for every run of anything else. Its most frequent n-grams of 1 to 3 bytes, at most
`TOP`, are ranked by count (ties: smaller n-gram). A language profile is the ranking of the summed
counts of its labelled texts. The out-of-place distance adds, over the n-grams of the document, the
difference of the ranks, or `TOP` where the profile lacks the n-gram; the nearest profile wins (ties:
the smaller name), and the score is one minus the distance as a share of its maximum.

Learning sends one row per language and n-gram from each task, so its volume is bounded by the number
of different n-grams; the profiles (at most `TOP` rows per language) go to every task. The number
of languages is the only other factor and is checked against `LANGUAGES`.

Edge cases: null texts and texts without a letter are `und` with score 0; rows without a label teach
nothing; with no labelled row at all every text is `und`; repeated rows are predicted alike and count
in training as often as they occur; further columns are carried along, columns with the names of the
results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.core import ContractError, materialize
from arbora.llm import spans
from arbora.llm.maxent import held_out
from arbora.llm.registry import query, table

TOP = 300
LANGUAGES = 1000
BLOCK = 300_000
NONE = "und"
LOW, SHARE = 0.01, 2 / 3  # a text fits from SHARE of the LOW quantile of labelled scores on

_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def ngrams(data: np.ndarray, bounds: np.ndarray):
    """(text, n-gram, count), n-grams as up to three bytes in one number, ordered by text and n-gram."""
    n = len(bounds) - 1
    stream = np.zeros(len(data) + 2 * n, np.uint8)
    text = np.repeat(np.arange(n), np.diff(bounds) + 2)
    inner = np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(bounds)) + 1
    low = _LETTER[data]
    # capital letters of the Latin-1 block: 0xC3 0x80-0x9E are 0xC3 0xA0-0xBE in lower case
    if len(data) > 1:
        tail = data[1:]
        low[1:][(data[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    stream[inner] = low
    keep = stream != 0
    keep[1:] |= (stream[:-1] != 0) | (text[1:] != text[:-1])
    keep[:1] = True
    s, t = stream[keep].astype(np.uint64), text[keep].astype(np.uint64)
    s[s == 0] = 32
    three = (s[:-2] << np.uint64(16)) | (s[1:-1] << np.uint64(8)) | s[2:]
    two = (s[:-1] << np.uint64(8)) | s[1:]
    shift = np.uint64(24)
    keys = [(t << shift) | s]
    same = t[1:] == t[:-1]
    keys.append(((t[:-1] << shift) | two)[same])
    keys.append(((t[:-2] << shift) | three)[t[2:] == t[:-2]])
    keys = np.sort(np.concatenate(keys))
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(keys)))
    key = keys[head]
    gram = key & np.uint64((1 << 24) - 1)
    real = (gram != 32) & (gram != 8224)
    return (key >> shift).astype(np.int64)[real], gram[real].astype(np.int64), count[real]


def _no_letters(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts without a letter; only those without an ASCII letter are decoded."""
    ascii_letter = (_LETTER[data] != 0) & (data < 128)
    sums = np.append(0, np.cumsum(ascii_letter))
    none = sums[bounds[1:]] == sums[bounds[:-1]]
    for i in np.flatnonzero(none):
        none[i] = not any(c.isalpha() for c in data[bounds[i]:bounds[i + 1]].tobytes().decode("utf-8", "replace"))
    return none


def _teach(batches):
    sums: dict[str, list] = {}

    def merged(parts):
        gram = np.concatenate([g for g, _ in parts])
        count = np.concatenate([c for _, c in parts])
        unique, inverse = np.unique(gram, return_inverse=True)
        return unique, np.bincount(inverse, weights=count).astype(np.int64)

    for batch in batches:
        texts = spans.column(batch, "_text")
        langs = batch.column(batch.schema.get_field_index("_lang")).to_pylist()
        for first, last, data, bounds in spans.blocks(texts, BLOCK):
            text, gram, count = ngrams(data, bounds)
            names, code = np.unique(np.array(langs[first:last], object).astype(str), return_inverse=True)
            mine = code[text]
            for k, name in enumerate(names):
                parts = sums.setdefault(str(name), [])
                parts.append((gram[mine == k], count[mine == k]))
                if len(parts) > 8:
                    sums[str(name)] = [merged(parts)]
    for name, parts in sums.items():
        gram, count = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram)), pa.array(gram), pa.array(count)], ["lang", "gram", "n"])


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, gram, rank) of every language among the labelled rows."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
    sums = rows.mapInArrow(_teach, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return sums.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top).select("lang", "gram", "rank")


def predict(docs: DataFrame, profile: DataFrame, text: str = "text", top: int = TOP, keep_text: bool = False) -> DataFrame:
    """`docs` (without the text unless it is to be kept), plus `lang_pred` and `score`."""
    profile = materialize(profile)
    names = sorted(r.lang for r in profile.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ContractError(f"more than {LANGUAGES} languages")
    rows = profile.collect()  # at most LANGUAGES * top rows
    grams = np.unique(np.array([r.gram for r in rows], np.int64))
    ranks = np.full((len(grams) + 1, max(1, len(names))), -1, np.int64)
    where = {g: i for i, g in enumerate(grams.tolist())}
    column = {name: i for i, name in enumerate(names)}
    for r in rows:
        ranks[where[r.gram], column[r.lang]] = r.rank
    shared = docs.sparkSession.sparkContext.broadcast((grams, ranks, names))
    rest = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text)]

    def run(batches):
        grams, ranks, names = shared.value
        for batch in batches:
            texts = spans.column(batch, text)
            for first, last, data, bounds in spans.blocks(texts, BLOCK):
                n = last - first
                doc, gram, count = ngrams(data, bounds)
                order = np.lexsort((gram, -count, doc))
                doc, gram = doc[order], gram[order]
                head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
                rank = np.arange(len(doc)) - np.repeat(head, np.diff(np.append(head, len(doc))))
                doc, gram, rank = doc[rank < top], gram[rank < top], rank[rank < top]
                at = np.searchsorted(grams, gram)
                at[(at == len(grams)) | (grams[np.minimum(at, max(len(grams) - 1, 0))] != gram if len(grams) else True)] = len(grams)
                found = ranks[at]
                out = np.where(found < 0, top, np.abs(found - rank[:, None]))
                total = np.stack([np.bincount(doc, weights=out[:, k], minlength=n) for k in range(out.shape[1])], axis=1)
                best = total.argmin(axis=1)
                size = np.maximum(np.bincount(doc, minlength=n), 1)
                score = np.clip(1 - total[np.arange(n), best] / (size * top), 0, 1)
                none = _no_letters(data, bounds) | (len(names) == 0)
                labels = [NONE if x else names[b] for x, b in zip(none.tolist(), best.tolist())]
                piece = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(piece.schema.get_field_index(c)) for c in rest]
                    + [pa.array(labels, pa.string()), pa.array(np.where(none, 0.0, score))], [*rest, "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema]
                       + ["lang_pred string", "score double"])
    return docs.select(*rest, *([] if keep_text else [text])).mapInArrow(run, schema)


def fitting(found: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE, low: float = LOW) -> DataFrame:
    """Rows of `found` (a written result of `predict` with its text) that fit their language.

    The limit of a predicted language and length class (power of two of the characters) is `share` of the
    `low` quantile of the scores of its labelled rows, or of all labelled rows where that is less or there are none.
    Quantiles are mergeable sketches over all labelled rows. Rows without a language never fit.
    """
    size = F.floor(F.log2(F.greatest(F.length(text), F.lit(1)))).cast("int")
    rows = found.where(F.col("lang_pred") != NONE).withColumn("_size", size)
    quantile = F.percentile_approx("score", F.lit(low), F.lit(10_000))
    known = rows.where(F.col(lang).isNotNull())
    fine = known.groupBy(F.col("lang_pred").alias("_lang_pred"), F.col("_size").alias("_its_size")).agg(quantile.alias("_fine"))
    whole = known.agg(quantile.alias("_whole"))  # one row
    joined = rows.join(F.broadcast(fine), (F.col("lang_pred") == F.col("_lang_pred")) & (F.col("_size") == F.col("_its_size")), "left")
    joined = joined.crossJoin(F.broadcast(whole))
    return joined.where(F.col("score") >= share * F.least("_fine", "_whole")).select(*found.columns)


def identified(docs: DataFrame, held: F.Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """Predictions for all rows from profiles of the rows that are not held out."""
    return predict(docs, profiles(docs.where(~held), text, lang), text)


@query("op6_language")
def op6_language(spark, folder):
    """Predicted language of every document; labels of held-out documents are not seen."""
    held = held_out("doc_id", 3, 1)
    docs = table(spark, folder, "documents")
    known = profiles(docs.where(~held).select("text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), known)
