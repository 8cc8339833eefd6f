"""Benchmark decontamination by canonical templates (DataFrame functions only).

Words lose outer punctuation and case. Numbers, units after a number, and names (words with an ASCII
capital inside a sentence) become typed placeholders, so a question asked again with other values keeps its
template. Hashes of `WINDOW` consecutive template words of the benchmark are joined to those of the
documents. Hits on one diagonal (document position minus item position) of one item form runs. Slots are
consistent if one value of the item always meets one value of the document, and the other way round. A
run is a leak if it is at least `RUN` words long (or the whole item, if shorter) and its slots are
consistent, or if a part of that length has the item's own values in all its slots.

Only texts that hold all anchors (the longest plain words) of some block of an item are looked at word
by word; every text with a leak does.

Items with fewer than `WINDOW` words are windows of their own length. Benchmark windows with fewer
than `LITERAL` plain words (or fewer than half of a short item) say nothing and are left out.

The benchmark's windows are broadcast only after their number was found to be at most `SMALL`.

Edge cases: null and empty texts hold no template; null or empty items match nothing; equal items
and repeated rows are counted once; a null document id is an id like any other; further columns are
carried along, columns with the names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.core import at_most, materialize
from arbora.llm.registry import query, table

WINDOW, RUN, LITERAL = 8, 13, 4
BLOCK, ANCHORS = (RUN + 1) // 2, 3
SMALL = 200_000

# Unit words that count as a unit after a number.
UNITS = ("% $ cent cents cm day days degrees dollar dollars eur euro euros feet foot ft g gram grams h hour hours hr hrs "
         "inch inches kg km kmh l lb lbs liter liters litre litres m meter meters metre metres mg mile miles min minute "
         "minutes ml mm month months mph ms ounce ounces oz percent pound pounds s sec second seconds ton tons usd week "
         "weeks yard yards year years € £").split()
_NUMBER = r"^\d[\d.,:/]*$"
# Words end at blanks, with the punctuation around them; only the end of a sentence stays on its word.
_GAP = r"[^\p{L}\p{N}.!?%$€£]*\s[^\p{L}\p{N}%$€£]*"
_EDGES = r"^[^\p{L}\p{N}%$€£]+|[^\p{L}\p{N}.!?%$€£]+$"


def _words(text: Column) -> Column:
    edge = F.substring(text, 1, 1).rlike(r"[^\p{L}\p{N}]") | F.substring(text, -1, 1).rlike(r"[^\p{L}\p{N}.!?]")
    return F.filter(F.split(F.when(edge, F.regexp_replace(text, _EDGES, "")).otherwise(text), _GAP), lambda w: w != "")


def _cores(words: Column) -> Column:
    """The words without the end of a sentence."""
    return F.transform(words, lambda w: F.when(w.endswith(".") | w.endswith("!") | w.endswith("?"),
                                               F.rtrim(w, F.lit(".!?"))).otherwise(w))


def _template(words: Column, cores: Column, core: Column, i: Column) -> Column:
    """Canonical form of the word at `i`; placeholders begin with a blank, which no word does.

    The comparisons with ":" (the character after "9") and "a" settle most words without a pattern.
    """
    before = F.when(i > 0, F.get(cores, F.greatest(i - 1, F.lit(0))))
    ended = (i == 0) | F.coalesce(F.get(words, F.greatest(i - 1, F.lit(0))).rlike(r"[.!?]$"), F.lit(True))
    first = F.substring(core, 1, 1)
    number = (core < ":") & core.rlike(_NUMBER)
    unit = core.isin(*UNITS) & before.rlike(_NUMBER)
    name = (core < "a") & (first != F.lower(first)) & ~ended
    return F.when(number, " num").when(unit, " unit").when(name, " name").otherwise(F.lower(core))


def _windows(h: Column, size: int) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0)))
    made = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
    return F.when(F.size(h) >= size, made).otherwise(F.array().cast("array<bigint>"))


def _suspects(texts: DataFrame, bench: DataFrame) -> DataFrame:
    """The texts that hold all anchors of some block of an item.

    Every run of `RUN` = 2 * `BLOCK` - 1 words, and every whole item, covers a whole block of `BLOCK`
    words that begins at a multiple of `BLOCK` (an item with fewer words is one block). Its anchors are
    its `ANCHORS` longest plain words. If a block has none, every text is a suspect.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - BLOCK + 1, F.lit(1)), F.lit(BLOCK))
    blocks = bench.select("item", "forms", F.explode(starts).alias("at"))
    plain = F.array_distinct(F.filter(F.slice("forms", F.col("at"), BLOCK), lambda f: f.rlike(r"^[\p{L}\p{N}]+$")))
    ranked = F.array_sort(F.transform(plain, lambda f: F.struct((-F.length(f)).alias("n"), f.alias("w"))))
    blocks = materialize(blocks.select("item", "at", F.slice(ranked["w"], 1, ANCHORS).alias("anchors")))
    if not blocks.where("size(anchors) = 0").isEmpty():
        return texts
    known = materialize(blocks.select("item", "at", F.size("anchors").alias("all"), F.explode("anchors").alias("anchor")))
    words = materialize(known.select("anchor").distinct())
    if at_most(words, SMALL):
        words = F.broadcast(words)
    said = texts.select("_doc", F.explode(F.split("_text", r"[^\p{L}\p{N}%$€£]+")).alias("w"))
    found = materialize(said.select("_doc", F.lower("w").alias("anchor")).join(words, "anchor", "left_semi").distinct())
    full = (found.join(known, "anchor").groupBy("_doc", "item", "at").agg(F.count("*").alias("c"), F.max("all").alias("all"))
            .where("c = all"))
    wanted = materialize(full.select(F.col("_doc").alias("_want")).distinct())
    wanted = F.broadcast(wanted) if at_most(wanted, SMALL) else wanted
    return texts.join(wanted, F.col("_doc").eqNullSafe(F.col("_want")), "left_semi")


def benchmark_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, n, words, forms): one row per distinct template of the benchmark."""
    split = items.where(F.col(text).isNotNull()).select(F.col(key).alias("item"), _words(F.col(text)).alias("words"))
    split = split.withColumn("cores", _cores(F.col("words")))
    formed = split.select("item", "words", F.transform(
        "cores", lambda c, i: _template(F.col("words"), F.col("cores"), c, i)).alias("forms"))
    return (formed.where(F.size("words") > 0).groupBy("words", "forms").agg(F.min("item").alias("item"))
            .select("item", F.size("words").alias("n"), "words", "forms"))


def _longest(slots: Column, start: Column, end: Column) -> Column:
    """Length of the run start..end if its slots (i, a, b) are consistent, else of its longest part without another value."""
    pairs = F.array_distinct(F.transform(slots, lambda x: F.struct(x.a.alias("a"), x.b.alias("b"))))
    one = F.size(F.array_distinct(pairs["a"])) == F.size(pairs)
    other = F.size(F.array_distinct(pairs["b"])) == F.size(pairs)
    cuts = F.concat(F.array(start - 1), F.transform(F.filter(slots, lambda x: x.a != x.b), lambda x: x.i), F.array(end))
    parts = F.transform(cuts, lambda x, k: F.get(cuts, k + 1) - x - 1)
    return F.when(one & other, end - start).otherwise(F.array_max(parts))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """(_doc, item, run): leaked items of each document with the length of the longest consistent run."""
    bench = materialize(benchmark_words(items, item_key, item_text))
    short = [r.n for r in bench.where(F.col("n") < WINDOW).select("n").distinct().collect()]  # at most WINDOW - 1 rows
    sizes = sorted({WINDOW, *short})
    texts = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).where("_text is not null")
    split = _suspects(texts, bench).select("_doc", _words(F.col("_text")).alias("w")).select("_doc", "w", _cores(F.col("w")).alias("c"))
    split = split.select("_doc", F.transform("c", lambda c, i: F.xxhash64(_template(F.col("w"), F.col("c"), c, i))).alias("h"))
    hits = None
    for size in sizes:
        mine = bench.where(F.col("n") >= WINDOW if size == WINDOW else F.col("n") == size)
        at = mine.select("item", "forms", F.transform("forms", lambda f: F.xxhash64(f)).alias("h")).select(
            "item", "forms", F.posexplode(_windows(F.col("h"), size)).alias("i", "window"))
        literal = F.size(F.filter(F.slice("forms", F.col("i") + 1, size), lambda f: ~f.startswith(" ")))
        known = materialize(at.where(literal >= min(LITERAL, (size + 1) // 2)).select("item", "i", "window"))
        if at_most(known, SMALL):
            known = F.broadcast(known)
        seen = split.select("_doc", F.posexplode(_windows(F.col("h"), size)).alias("p", "window"))
        part = seen.join(known, "window").select("_doc", "item", (F.col("p") - F.col("i")).alias("d"), "i", F.lit(size).alias("size"))
        hits = part if hits is None else hits.unionByName(part)
    hits = materialize(hits.distinct())
    line = Window.partitionBy("_doc", "item", "d", "size").orderBy("i")
    # Windows that overlap or touch cover a run without a gap, even where windows of few plain words were left out.
    apart = F.coalesce(F.col("i") - F.lag("i").over(line) > F.col("size"), F.lit(True))
    runs = (hits.withColumn("_new", apart.cast("int")).withColumn("g", F.sum("_new").over(line))
            .groupBy("_doc", "item", "d", "size", "g")
            .agg(F.min("i").alias("from"), (F.max("i") + F.max("size")).alias("to")))
    runs = materialize(runs.join(bench, "item").where(F.col("to") - F.col("from") >= F.least(F.lit(RUN), F.col("n"))))
    wanted = runs.select(F.col("_doc").alias("_want")).distinct()
    wanted = F.broadcast(wanted) if at_most(wanted, SMALL) else wanted
    again = texts.join(wanted, F.col("_doc").eqNullSafe(F.col("_want")), "left_semi").select(
        F.col("_doc").alias("_again"), _words(F.col("_text")).alias("doc_words"))
    both = runs.join(again, F.col("_doc").eqNullSafe(F.col("_again")))
    step = F.sequence(F.col("from"), F.col("to") - 1)
    slots = F.transform(
        F.filter(step, lambda i: F.get("forms", i).startswith(" ")),
        lambda i: F.struct(i.alias("i"), F.lower(F.rtrim(F.get("words", i), F.lit(".!?"))).alias("a"),
                           F.lower(F.rtrim(F.get("doc_words", i + F.col("d")), F.lit(".!?"))).alias("b")))
    checked = both.select("_doc", "item", "n", "from", "to", slots.alias("slots"))
    checked = checked.withColumn("run", _longest(F.col("slots"), F.col("from"), F.col("to")))
    return checked.where(F.col("run") >= F.least(F.lit(RUN), F.col("n"))).groupBy("_doc", "item").agg(F.max("run").alias("run"))


def marked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """`docs` plus n_items, longest_run and contaminated."""
    found = leaks(docs, items, key, text, item_key, item_text).groupBy("_doc").agg(
        F.count("*").alias("n_items"), F.max("run").cast("long").alias("longest_run"))
    found = materialize(found)
    found = F.broadcast(found) if at_most(found, SMALL) else found
    docs = docs.drop("n_items", "longest_run", "contaminated")
    return (docs.join(found, F.col(key).eqNullSafe(F.col("_doc")), "left").drop("_doc")
            .fillna(0, ["n_items", "longest_run"]).withColumn("contaminated", F.col("n_items") > 0))


@query("op3_templates")
def op3_templates(spark, folder):
    """Per document: how many benchmark items it leaks, the longest run, and the verdict."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return marked(docs, table(spark, folder, "benchmark")).select("doc_id", "n_items", "longest_run", "contaminated")
