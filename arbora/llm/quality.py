"""Quality rules whose limits come from the data: quantile sketches per language and source.

Per document, four rates are computed as whole numbers: mean word length (hundredths of a
character), symbols, repeated lines and repeated words (each per thousand). A sketch is a log-linear
histogram: values keep their `BITS` leading bits, so a quantile is off by at most 1/32 of its value,
and sketches are merged by adding counts: of (language, source) into the language, of languages into the whole.
A document is kept when no rate lies beyond its group's limits. These are the 1 % and 99 % quantiles, moved out by
half their distance from the median and by the resolution of the sketch; nothing else is fixed. Limits of
small groups are shrunk: those of n documents weigh n, those of the language (itself shrunk towards the whole table)
weigh `least`.
Documents that fail the base rules do not enter the sketches.

Edge cases: a null or empty text has no words and fails the base rules; null language or source is a
group like any other; repeated rows are documents of their own; an empty table gives an empty
result; further columns are carried along, columns with the names of the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.core import at_most, materialize
from arbora.llm import spans
from arbora.llm.registry import query, table

BITS = 6
TAIL = 100  # the quantiles of 1 / TAIL and 1 - 1 / TAIL
LEAST = 100  # weight, in documents, of the next coarser limits
BROADCAST_GROUPS = 50_000  # a table of limits up to this size is broadcast
RATES = ["word_length", "symbol_rate", "dup_line_rate", "repeat_rate"]
STEP = 1 << (BITS - 1)  # a sketched value may lie this part of itself below the value
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeats(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each (text, hash): whether the pair occurs at least twice; and whether it is not its first."""
    key = spans.mix(hashes ^ spans.mix(text.astype(np.uint64) + np.uint64(1)))
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return count[inverse] > 1, later


def count_block(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The columns of `COUNTS` for the texts of one block."""
    n = len(bounds) - 1
    starts, ends, text = spans.words(data, bounds)
    prefix = spans.Prefix(data)
    n_words = np.bincount(text, minlength=n)
    chars = _per_text(~spans.BLANK[data] & ((data & 0xC0) != 0x80), bounds)
    symbols = _per_text(_SYMBOL[data], bounds)
    line_starts, line_ends = spans.runs(data != 10, bounds)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~spans.BLANK[data], out=filled[1:])
    worded = filled[line_ends] > filled[line_starts]
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_text = spans.owner(line_starts, bounds)
    _, later = _repeats(line_text, prefix.spans(line_starts, line_ends))
    dup_lines = np.bincount(line_text[later], minlength=n)
    five, at = spans.windows(prefix.spans(starts, ends), text, 5)
    twice, _ = _repeats(text[at], five)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    repeated = np.bincount(text[np.cumsum(cover[:-1]) > 0], minlength=n)
    return [n_words, chars, symbols, np.bincount(line_text, minlength=n), dup_lines, repeated]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the text, plus the columns of `COUNTS`."""
    rest = [c for c in docs.columns if c != text and c not in COUNTS]
    kept = docs.select(*rest, text)

    def run(batches):
        for batch in batches:
            texts = spans.column(batch, text)
            for first, last, data, bounds in spans.blocks(texts):
                piece = batch.slice(first, last - first)
                cols = [piece.column(piece.schema.get_field_index(c)) for c in rest]
                yield pa.RecordBatch.from_arrays(
                    cols + [pa.array(c, pa.int64()) for c in count_block(data, bounds)], [*rest, *COUNTS])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*rest).schema]
                       + [f"{c} bigint" for c in COUNTS])
    return kept.mapInArrow(run, schema)


def sketched(value: Column) -> Column:
    """`value` (a whole number >= 0) cut to its leading bits."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"),
                           F.greatest(F.lit(0), F.length(F.bin(value)) - BITS).cast("int"))
    return value - value % step


def rates(counted: DataFrame) -> DataFrame:
    def share(part: str, whole: str, scale: int) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(part) * scale / F.greatest(F.col(whole), F.lit(1)))).otherwise(0)

    return counted.withColumns({
        "word_length": share("word_chars", "n_words", 100), "symbol_rate": share("n_symbols", "n_words", 1000),
        "dup_line_rate": share("n_dup_lines", "n_lines", 1000), "repeat_rate": share("n_repeat_words", "n_words", 1000),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))})


def _shrunk(own: str, docs: str, wider: str, least: int, divide: str) -> str:
    """SQL for a limit of `docs` documents drawn towards a wider one."""
    return f"(({own} * {docs} + {wider} * {least}) {divide} ({docs} + {least}))"


def fences(measured: DataFrame, lang: str, source: str, least: int = LEAST) -> DataFrame:
    """(lang, source, lo_*, hi_*): one row per group of `measured`, from merged sketches."""
    names = RATES
    long = (measured.where("not base_failed")
            .select(F.col(lang).alias("_l"), F.col(source).alias("_s"),
                    F.explode(F.array(*[F.struct(F.lit(m).alias("m"), sketched(F.col(m)).alias("v")) for m in names])).alias("e"))
            .groupBy("_l", "_s", "e.m", "e.v").agg(F.count("*").alias("n")))
    long = materialize(long)
    by_lang = long.groupBy("_l", "m", "v").agg(F.sum("n").alias("n"))
    overall = long.groupBy("m", "v").agg(F.sum("n").alias("n"))

    def tails(sketch: DataFrame, keys: list[str]) -> DataFrame:
        group = Window.partitionBy(*keys, "m")
        upto = group.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = sketch.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(group)})
        at = {q: F.min(F.when(F.col("upto") * d >= F.col("all") * k, F.col("v")))
              for q, k, d in (("low", 1, TAIL), ("mid", 1, 2), ("high", TAIL - 1, TAIL))}
        wide = ranked.groupBy(*keys, "m").agg(*[c.alias(q) for q, c in at.items()], F.max("all").alias("docs"))
        lo, hi = (F.expr(e) for e in (f"greatest(0, low - (mid - low) div 2 - greatest(1, low div {STEP}))",
                                      f"high + (high - mid) div 2 + greatest(1, high div {STEP})"))
        return wide.groupBy(*keys).pivot("m", names).agg(F.first(F.struct(lo.alias("lo"), hi.alias("hi"), "docs")))

    fine = tails(long, ["_l", "_s"])
    middle = tails(by_lang, ["_l"]).select(F.col("_l").alias("_ml"), *[F.col(m).alias(f"_m_{m}") for m in names])
    coarse = tails(overall, []).select(*[F.col(m).alias(f"_c_{m}") for m in names])
    joined = fine.join(middle, F.col("_l").eqNullSafe(F.col("_ml")), "left").crossJoin(coarse)  # coarse is one row

    def pick(m: str, side: str) -> Column:
        return F.expr(_shrunk(f"`{m}`.{side}", f"`{m}`.docs", _shrunk(
            f"`_m_{m}`.{side}", f"`_m_{m}`.docs", f"`_c_{m}`.{side}", least, "div"), least, "div")).alias(f"_{side}_{m}")

    return joined.select("_l", "_s", *[pick(m, side) for m in names for side in ("lo", "hi")])


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
           least: int = LEAST) -> DataFrame:
    """`docs` without the text, plus counts, rates, `base_failed` and `kept`."""
    measured = materialize(rates(with_counts(docs, text)))
    limits = materialize(fences(measured, lang, source, least))
    if at_most(limits, BROADCAST_GROUPS):
        limits = F.broadcast(limits)
    same = F.col(lang).eqNullSafe(F.col("_l")) & F.col(source).eqNullSafe(F.col("_s"))
    inside = ~F.col("base_failed")
    for m in RATES:
        inside = inside & F.col(m).between(F.col(f"_lo_{m}"), F.col(f"_hi_{m}"))
    joined = measured.join(limits, same, "left")
    return joined.withColumn("kept", F.coalesce(inside, F.lit(False))).select(*measured.columns, "kept")


_LEVELS = {"fine": "lang, source", "middle": "lang", "coarse": ""}


def _twin() -> str:
    cut = "v - v % (1::BIGINT << greatest(0, length(bin(v)) - 6)::BIGINT)"
    rows = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS m, {m} AS v FROM rated WHERE NOT base_failed" for m in RATES)
    parts = []
    for name, keys in _LEVELS.items():
        by = f"{keys}, m" if keys else "m"
        head = f"{keys}, " if keys else ""
        parts.append(f"""{name} AS (SELECT {head}m, docs, greatest(0, a - (b - a) // 2 - greatest(1, a // {STEP})) lo,
                c + (c - b) // 2 + greatest(1, c // {STEP}) hi FROM (SELECT {head}m, min(v) FILTER (upto * {TAIL} >= n) a,
            min(v) FILTER (upto * 2 >= n) b, min(v) FILTER (upto * {TAIL} >= {TAIL - 1} * n) c, max(n)::BIGINT docs
            FROM (SELECT {head}m, v, sum(c) OVER (PARTITION BY {by} ORDER BY v) upto, sum(c) OVER (PARTITION BY {by}) n
                  FROM (SELECT {head}m, v, count(*) c FROM cut GROUP BY {by}, v)) GROUP BY {by}))""")
    shrunk = ", ".join(_shrunk(f"f.{x}", "f.docs", _shrunk(f"g.{x}", "g.docs", f"h.{x}", LEAST, "//"), LEAST, "//") + f" {x}"
                       for x in ("lo", "hi"))
    return f"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
    win AS (SELECT doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') s
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) i FROM w)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) c FROM win) WHERE c > 1),
    cover AS (SELECT doc_id, count(DISTINCT i + k) n FROM twice, range(5) r(k) GROUP BY doc_id),
    ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) line FROM w),
    lc AS (SELECT doc_id, count(*) n, count(*) - count(DISTINCT line) d FROM ln
           WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
    counted AS (SELECT w.doc_id, lang, source, len(ws) n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(lc.n, 0) n_lines, coalesce(lc.d, 0) n_dup_lines,
        coalesce(cover.n, 0) n_repeat_words FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN lc USING (doc_id)),
    rated AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END::BIGINT word_length,
        CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END::BIGINT symbol_rate,
        CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END::BIGINT dup_line_rate,
        CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END::BIGINT repeat_rate,
        (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) base_failed FROM counted),
    cut AS (SELECT doc_id, lang, source, m, {cut} v FROM ({rows})),
    {", ".join(parts)},
    lim AS (SELECT f.lang, f.source, f.m, {shrunk}
        FROM fine f JOIN middle g ON f.lang IS NOT DISTINCT FROM g.lang AND f.m = g.m JOIN coarse h ON f.m = h.m),
    bad AS (SELECT DISTINCT r.doc_id FROM (
        {" UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS m, {m} AS v FROM rated" for m in RATES)}) r
        JOIN lim ON r.lang IS NOT DISTINCT FROM lim.lang AND r.source IS NOT DISTINCT FROM lim.source AND r.m = lim.m
        WHERE r.v < lo OR r.v > hi)
    SELECT doc_id, n_words::BIGINT n_words, word_chars, n_symbols::BIGINT n_symbols, n_dup_lines::BIGINT n_dup_lines,
        n_repeat_words::BIGINT n_repeat_words, base_failed,
        NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM rated"""


@query("op5_quality", _twin())
def op5_quality(spark, folder):
    """Base counts and the verdict of the adaptive limits for every document."""
    return judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
