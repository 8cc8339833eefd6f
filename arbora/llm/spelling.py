"""Spelling variant grouping by dynamic programming over a sorted vocabulary.

*Vocabulary.* Runs of letters of every text, ASCII capitals lowered, counted over all texts.

*Near words* differ by exactly one inserted, deleted or replaced code point. Let m be the length of the
shorter of two near words: their common prefix and suffix hold m - 1 code points or more together, so one of
them holds k = m // 2. A word therefore stands in the groups (m, direction, first k code points)
for m = its length and its length - 1, forward and reversed; a pair comes from its forward group, or
from the backward one if its common prefix is shorter than k. A group of more than `CROWD` words is split
again and again: pairs with k + 1 common code points meet under these, and those that differ right behind the first k
meet under these together with the m - 1 - k last ones, a group that no longer grows with the
vocabulary (two free places at most). Every pair comes out once.

*Scan.* Groups lie sorted in their partitions, so the words with a common prefix are a range of the list, found
from the common prefix lengths of neighbours (LCPs). Each prefix has one banded row (three cells) of the edit matrix
against a query word; the row serves the whole range, and a range whose row has no cell of at most one edit is
skipped. Rows of all queries advance by one code point at a time as arrays.

*Forms.* A word's form is its near word of largest count (ties: the smallest word), if that is at least
`ratio` times its own; roots follow forms by pointer doubling.

Edge cases: null and empty texts have no runs; a null key is written as an empty string where it enters the noise hash;
repeated rows count as often as they stand there; words of any length are scanned whole;
columns other than key and text are not read, so their names cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import is_empty, materialize
from arbora.llm.registry import query, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
CROWD = 20_000  # words of a group that are scanned as one list
HELD = 300_000  # words that a counting task holds before it sends partial counts
ROWS = 20_000  # words scanned at once, whole groups
QUERIES = 4_000  # query words of a list whose rows advance together

_LOWER = {i: i + 32 for i in range(65, 91)}


def damaged(key, run: str, every: int) -> str:
    """The run without one code point if `every` divides the CRC-32 of `<key>:<run>`, as typing errors would be."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counter(every: int | None):
    def partial(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                runs = Counter(r.translate(_LOWER) for r in RUN.findall(text))
                if every:
                    for r, n in runs.items():
                        counts[damaged("" if key is None else key, r, every)] += n
                else:
                    counts.update(runs)
                if len(counts) > HELD:
                    yield partial(counts)
                    counts = Counter()
        yield partial(counts)
    return run


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, damage_every: int | None = None) -> DataFrame:
    """(word, n): the words of all texts and their occurrences; `damage_every` plants typing errors."""
    cut = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    partial = cut.mapInArrow(_counter(damage_every), "word string, n bigint").where(F.length("word") >= least_length)
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _prefixes(codes: np.ndarray, off: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Code points that every word has in common with the one before it; -1 at the first word of a group."""
    lcp = np.where(np.append(True, group[1:] != group[:-1]), -1, 0)
    on, d = np.flatnonzero(lcp == 0), 0
    while len(on):
        on = on[(size[on] > d) & (size[on - 1] > d)]
        on = on[codes[off[on] + d] == codes[off[on - 1] + d]]
        lcp[on] += 1
        d += 1
    return lcp


def scan(codes: np.ndarray, off: np.ndarray, size: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j, of words of one group that differ by exactly one edit.

    `codes` holds the code points of the sorted words end to end, `group` ascends, and the words of a
    group have their first k code points in common and more than k of them.
    """
    n = len(size)
    lcp = _prefixes(codes, off, size, group)
    heads = np.append(np.flatnonzero(lcp < 0), n)
    place = np.searchsorted(heads, np.arange(n), "right") - 1
    found = []

    def letter(q, at):
        inside = (at >= 0) & (at < size[q])
        return np.where(inside, codes[off[q] + np.where(inside, at, 0)], -1)

    for begin in range(0, n, QUERIES):
        q = np.arange(begin, min(n, begin + QUERIES))
        lo, hi = heads[place[q]], heads[place[q] + 1]
        b = [np.full(len(q), v, np.int8) for v in (1, 0, 1)]  # edits against q[:d-1], q[:d], q[:d+1]
        d = k
        while len(q):
            edge = np.flatnonzero(lcp <= d)
            after = np.append(edge[1:], n)
            first, count = np.searchsorted(edge, lo), np.searchsorted(edge, hi) - np.searchsorted(edge, lo)
            row = np.repeat(np.arange(len(q)), count)
            at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            low, high = edge[at], after[at]
            on = (size[low] > d) & (high > q[row] + 1)
            row, low, high = row[on], low[on], high[on]
            c, mine = codes[off[low] + d], q[row]
            old = [x[row] for x in b]
            n0 = np.minimum(old[1] + 1, old[0] + (letter(mine, d - 1) != c))
            n1 = np.minimum(np.minimum(old[1] + (letter(mine, d) != c), old[2] + 1), n0 + 1)
            n2 = np.minimum(old[2] + (letter(mine, d + 1) != c), n1 + 1)
            on = np.minimum(np.minimum(n0, n1), n2) <= 1
            q, lo, hi, b = mine[on], low[on], high[on], [n0[on], n1[on], n2[on]]
            d += 1
            over = size[q] - d  # the cell of the whole query word is this much off the middle
            edits = np.select([over == -1, over == 0, over == 1], b, 9)
            hit = (size[lo] == d) & (edits == 1) & (lo > q)
            found.append((q[hit], lo[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _pairs_of(part: pa.Table) -> pa.RecordBatch | None:
    """Near pairs of whole groups that have m, direction, k and kind in common."""
    m, back, k, tail = (part.column(c)[0].as_py() for c in ("m", "back", "k", "tail"))
    key = part.column("key").combine_chunks()
    group = np.zeros(len(part), np.int64)
    group[1:] = np.cumsum(np.asarray(pa.compute.not_equal(key.slice(1), key.slice(0, len(key) - 1))))
    forms = part.column("form").to_pylist()
    codes = np.frombuffer("".join(forms).encode("utf-32-le"), "<u4").astype(np.int64)
    size = np.fromiter(map(len, forms), np.int64, len(forms))
    off = np.cumsum(size) - size
    i, j = scan(codes, off, size, group, k)
    on = (size[i] == m) | (size[j] == m)
    if tail:
        on &= codes[off[i] + k] != codes[off[j] + k]
    if back:  # otherwise the forward group has the pair
        differ = np.zeros(len(i), bool)
        for t in range(1, m // 2 + 1):
            differ |= codes[off[i] + size[i] - t] != codes[off[j] + size[j] - t]
        on &= differ
    i, j = i[on], j[on]
    if not len(i):
        return None
    columns = [part.column("form").take(i), part.column("n").take(i), part.column("form").take(j), part.column("n").take(j)]
    columns = [c.combine_chunks() for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), back)), *columns], ["back", "a", "n_a", "b", "n_b"])


def _scanned(batches):
    """Whole groups from sorted batches, `ROWS` words or more at once."""
    held: list[pa.RecordBatch] = []

    def runs(table: pa.Table):
        kinds = [np.asarray(table.column(c)) for c in ("m", "back", "k", "tail")]
        cut = np.zeros(len(table) - 1, bool)
        for x in kinds:
            cut |= x[1:] != x[:-1]
        edges = [0, *(np.flatnonzero(cut) + 1).tolist(), len(table)]
        for a, b in zip(edges, edges[1:]):
            made = _pairs_of(table.slice(a, b - a))
            if made is not None:
                yield made

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        table = pa.Table.from_batches(held)
        ids = table.select(["m", "back", "k", "tail", "key"])
        last = ids.slice(len(ids) - 1).to_pylist()[0]
        same = np.ones(len(ids), bool)
        for c, v in last.items():
            same &= np.asarray(pa.compute.equal(ids.column(c), pa.scalar(v, ids.schema.field(c).type)))
        whole = int(np.argmax(same))  # the last group may go on
        if whole:
            yield from runs(table.slice(0, whole))
        held = table.slice(whole).to_batches()
    if held:
        yield from runs(pa.Table.from_batches(held))


def near_words(words: DataFrame, crowd: int | None = None) -> DataFrame:
    """(a, n_a, b, n_b): every unordered pair of near words of (word, n), once. Words are distinct."""
    crowd = CROWD if crowd is None else crowd
    both = words.select("n", F.explode(F.array(
        F.struct(F.lit(False).alias("back"), F.col("word").alias("form")),
        F.struct(F.lit(True).alias("back"), F.reverse("word").alias("form")))).alias("x")).select("n", "x.*")
    size = F.length("form")
    rows = both.select("*", F.explode(F.array(size, size - 1)).alias("m")).where("m > 0")
    rows = rows.withColumn("k", F.expr("m div 2").cast("int")).withColumn("tail", F.lit(False))
    names = ["m", "back", "k", "tail", "key"]
    ready = None
    while True:
        head = F.substring("form", F.lit(1), F.col("k"))
        rest = F.when(F.col("m") - 1 - F.col("k") > 0, F.expr("right(form, m - 1 - k)")).otherwise("")
        rows = rows.withColumn("key", F.when(F.col("tail"), F.concat(head, F.lit("\0"), rest)).otherwise(head))
        crowded = materialize(rows.where("not tail and k < m - 1").groupBy(*names).agg(F.count("*").alias("_n"))
                              .where(F.col("_n") > crowd).drop("_n"))
        if is_empty(crowded):
            ready = rows if ready is None else ready.unionByName(rows)
            break
        calm = rows.join(crowded, names, "left_anti")
        ready = calm if ready is None else ready.unionByName(calm)
        longer = F.array(F.struct((F.col("k") + 1).alias("k"), F.lit(False).alias("tail")), F.struct(F.col("k"), F.lit(True).alias("tail")))
        rows = materialize(rows.join(crowded, names, "left_semi").select("n", "back", "form", "m", F.explode(longer).alias("x"))
                           .select("n", "back", "form", "m", "x.*"))
    dealt = ready.repartition(*names).sortWithinPartitions(*names, "form").select(*names, "form", "n")
    found = dealt.mapInArrow(_scanned, "back boolean, a string, n_a bigint, b string, n_b bigint")
    turned = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    return found.select(turned("a").alias("a"), "n_a", turned("b").alias("b"), "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) pointers, whose counts rise along every chain, by pointer doubling."""
    roots = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialize(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                                       F.col("_next").isNotNull().alias("_moved")))
        roots = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return roots


def variants(words: DataFrame, ratio: int = RATIO, crowd: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of (word, n)."""
    words = materialize(words.select("word", "n"))
    pairs = near_words(words, crowd)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("x")).select("x.*")
    near = materialize(sides.groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("n").alias("n"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("top")))
    forms = near.where(-F.col("top.m") >= F.col("n") * ratio).select("word", F.col("top.other").alias("form"), (-F.col("top.m")).alias("form_n"))
    forms = materialize(forms)
    found = near.select("word", "n_near").join(forms, "word", "left").join(_roots(forms), "word", "left")
    return (words.join(found, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


_TWIN = """WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i:
        xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), x::BIGINT)) t),
    runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run, count(*) n
        FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')) r FROM documents) GROUP BY ALL),
    bytes AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) x FROM runs),
    crc AS (SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) h FROM bytes, tab),
    words AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, n FROM crc),
    v AS (SELECT word, sum(n)::BIGINT n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) s FROM (SELECT word, n, unnest(range(length(word))) i FROM v)),
    one AS (SELECT DISTINCT a.word a, a.n n_a, b.word b, b.n n_b FROM cut a JOIN v b ON a.s = b.word
        UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.s = b.s AND a.i = b.i AND a.word < b.word),
    near AS (SELECT a word, n_a n, b other, n_b m FROM one UNION ALL SELECT b, n_b, a, n_a FROM one),
    top AS (SELECT word, count(*) n_near, arg_min(other, (-m, other)) form, max(m) form_n, any_value(n) n FROM near GROUP BY word),
    form AS (SELECT word, form, form_n FROM top WHERE form_n >= 2 * n),
    up AS (SELECT word, form AS root FROM form UNION SELECT up.word, form.form FROM up JOIN form ON up.root = form.word),
    ends AS (SELECT word, root FROM up WHERE root NOT IN (SELECT word FROM form))
    SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form.form_n
    FROM v LEFT JOIN (SELECT word, n_near FROM top) USING (word) LEFT JOIN form USING (word) LEFT JOIN ends USING (word)"""


@query("op11_spelling", _TWIN)
def op11_spelling(spark, folder):
    """Every word of all documents (with planted typing errors), its form, root and near words."""
    return variants(vocabulary(table(spark, folder, "documents"), damage_every=97))
