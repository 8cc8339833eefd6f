"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history).

* The class of a word is a hash of its last two bytes, the end of a text has a class of its own.
* Both factors start from a model without sparse features: for classes a log-linear model over a small table of
  hashed features (a bias, the previous word, the word before it, the two together), fitted by gradients under a
  Gaussian prior; for words their training count plus one over the class total plus one per known word of the
  class and one for all unknown ones.
* On these come sparse features, one per (history, class) and one per (history, word) that training text holds, for three
  histories in turn: the word before the previous one (skip), the previous word (bigram), the two in order (trigram).
  So both factors see every n-gram and skip feature of the corpus, and what is gathered grows with it. Features of one
  history do not overlap, so the weights that meet their expectations at the least divergence from the model before them
  are known in closed form. The expectations are smoothed: a class count gets `PRIOR` tokens spread as the model before says,
  a (history, word) gives up a discount (from the numbers of these seen once and twice, per kind of history) that all words
  of the class share as the model before says.

Counting is distributed: every block of texts sends its distinct words and (history, word) pairs once, dealt by the hash
of the word or of (history, class of the word), and gets the corpus counts of exactly these back, so neither
a vocabulary nor a popular word ever gathers anywhere: the words that follow a popular one are dealt by class.
The kinds of histories are counted one after another, so the shuffle of one is gone before the next.
Class counts per pair of hashed feature values are a sufficient statistic of the first model, so
its gradient over the whole corpus is computed from a table of fixed size; it is dealt over tasks by
slices of histories, and each step adds up the slices' gradients and updates the weights.
Scoring gathers the log probabilities of a block in numpy batches, and results are written before the tables they need go.

Edge cases: a null or empty text is scored as its end token alone; a null document id counts as the
empty text when the held-out rest is computed; repeated rows are texts of their own and count in
training as often as they occur; without training rows every count is zero and the model is uniform;
further columns are carried along, columns with the names of the results are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import discard, shuffle_partitions
from arbora.llm import spans
from arbora.llm.registry import query, table
from arbora.llm.storage import stored

CLASSES = 32
BIGRAM, SKIP, TRIGRAM = 512, 16, 2048  # hashed values per feature
SLICES = 32
STEPS, RATE = 30, 0.5
BLOCK = 2_000_000
END = np.uint64(0x5DEECE66D1234567)

HISTORIES = BIGRAM * SKIP
PARTS = 3  # runs over the blocks that score them; the shuffle of one is gone before the next
PRIOR = float(CLASSES)  # tokens by which the model without sparse features counts in the classes after a word
SPARSE = ("skip", "pair", "both")  # the word before the previous one, the previous word, the two in order
KEY_FREE, ITEM_FREE = 24, 40  # bits of a hash left out: 40 name a (history, class) within its bucket, 24 a word within that
BUCKET = 16 << 20  # bytes of stored words and tokens per bucket of counts
_TEXTS = ("kind string, bucket int, block bigint, words binary, heads binary, classes binary, tokens binary, "
          "per binary, learn binary, rows binary, trained binary")
_DEALT = "kind string, bucket int, block bigint, keys binary, sizes binary, items binary, trained binary"
_COUNTED = "kind string, bucket int, block bigint, counts binary, groups binary"


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(held: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(held[:8], "little"), np.dtype(kind).itemsize
    if n == 0:
        return np.zeros(0, kind)
    raw = pa.decompress(held[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _record(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


def _encode(batches, text: str, training: str):
    """Blocks of texts as distinct words and word numbers; counts of hashed histories."""
    counts = np.zeros(HISTORIES * CLASSES, np.int64)
    task = TaskContext.get().partitionId()
    number = 0
    for batch in batches:
        texts = spans.column(batch, text)
        rest = batch.drop_columns([text])
        learn = np.asarray(rest.column(rest.schema.get_field_index(training)).to_pylist(), bool)
        for first, last, data, bounds in spans.blocks(texts, BLOCK):
            data = spans.LOWER[data]
            starts, ends, owner = spans.words(data, bounds)
            n_texts = last - first
            per = np.bincount(owner, minlength=n_texts) + 1
            stops = np.cumsum(per) - 1
            is_word = np.ones(int(per.sum()), bool)
            is_word[stops] = False
            token = np.full(len(is_word), END, np.uint64)
            token[is_word] = spans.Prefix(data).spans(starts, ends)
            form = np.zeros(len(is_word), np.int64)
            tail = data[ends - 1].astype(np.uint64) * np.uint64(257) + np.where(
                ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
            form[is_word] = 1 + (spans.mix(tail) % np.uint64(CLASSES - 1)).astype(np.int64)
            unique, where, inverse, times = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words first: small numbers take less room
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            unique, kinds, token = unique[order], form[where][order].astype(np.uint8), place[inverse]
            heads = (unique >> np.uint64(48)).astype(np.uint16)
            used = np.repeat(learn[first:last], per)
            history = _histories(heads, token, per)
            np.add(counts, np.bincount(history[used] * CLASSES + form[used], minlength=len(counts)), out=counts)
            sink = pa.BufferOutputStream()
            piece = pa.Table.from_batches([rest.slice(first, n_texts)])
            with pa.ipc.new_stream(sink, piece.schema) as out:
                out.write_table(piece)
            yield _record([{"kind": "text", "block": (task << 32) + number, "words": _pack(unique), "heads": _pack(heads),
                            "classes": _pack(kinds), "tokens": _pack(token.astype(np.int32)), "per": _pack(per.astype(np.int64)),
                            "learn": _pack(learn[first:last].astype(np.uint8)), "rows": sink.getvalue().to_pybytes()}], _TEXTS)
            number += 1
    if counts.any():
        size = len(counts) // SLICES
        yield _record([{"kind": "count", "bucket": s, "trained": counts[s * size:(s + 1) * size].tobytes()}
                       for s in range(SLICES)], _TEXTS)


def _previous(token: np.ndarray, per: np.ndarray) -> np.ndarray:
    """The word before every token; texts begin after an end."""
    stops = np.cumsum(per)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[stops - per] = token[stops[0] - 1]
    return before


def _before(token: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The previous word of every token and the one before it; the first token of a text has the end as both."""
    one = _previous(token, per)
    two = _previous(one, per)
    begin = np.cumsum(per) - per
    two[begin] = one[begin]
    return one, two


def _histories(heads: np.ndarray, token: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Number of the (previous word, word before it) hash pair of every token."""
    one, two = _before(token, per)
    heads = heads.astype(np.uint64)
    a = (spans.mix(heads) % np.uint64(BIGRAM)).astype(np.int64)
    b = (spans.mix(heads ^ np.uint64(0xABCDEF)) % np.uint64(SKIP)).astype(np.int64)
    return a[one] * SKIP + b[two]


def _number(sort: str, token: np.ndarray, per: np.ndarray, n: int) -> np.ndarray:
    """The number of every token's history among those that `n` words can make."""
    one, two = _before(token, per)
    return one if sort == "pair" else two if sort == "skip" else two * n + one


def _hashed(sort: str, history: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of numbered histories from the hashes of the words."""
    n = len(hashes)
    return spans.mix(hashes[history // n] ^ spans.mix(hashes[history % n] + np.uint64(2))) if sort == "both" else hashes[history]


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`np.unique` with the inverse, for numbers that are not negative: stable sorts of 16 bits each take linear time."""
    order = np.argsort(values.astype(np.uint16), kind="stable")
    for shift in range(16, int(values.max()).bit_length() if len(values) else 0, 16):
        order = order[np.argsort((values[order] >> values.dtype.type(shift)).astype(np.uint16), kind="stable")]
    ranked = values[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])[:len(ranked)]
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return ranked[fresh], inverse


def _cut(home: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket and where each bucket begins in it."""
    home = home.astype(np.uint16)  # there are at most 2**16 buckets; numbers of 16 bits are sorted in linear time
    order = np.argsort(home, kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(home, minlength=buckets)))


def _events(sort: str, heads: np.ndarray, token: np.ndarray, per: np.ndarray, kinds: np.ndarray, buckets: int):
    """The distinct (history, word) pairs of a block, in groups by history and class of the word, dealt to buckets.

    Returns history, class, size and bucket of every group, the word of every pair in the order of the groups, and the
    pair of every token.
    """
    n = len(kinds)
    history = _number(sort, token, per, n)
    named = None
    if sort == "both" and n ** 3 * CLASSES >= 1 << 62:  # too many words to number all triples
        named, history = _unique(history)
    group = history * CLASSES + kinds[token]
    pair, inverse = _unique(group * n + token)
    group, word = pair // n, pair % n
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(start, len(group)))
    before, kind = np.divmod(group[start], CLASSES)
    before = before if named is None else named[before]
    hashes = _hashed(sort, before, heads.astype(np.uint64))
    home = (spans.mix(hashes * np.uint64(CLASSES) + kind.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order, _ = _cut(home, buckets)
    moved, _ = _cut(np.repeat(home, size), buckets)
    place = np.empty(len(moved), np.int64)
    place[moved] = np.arange(len(moved))
    return before[order], kind[order], size[order], home[order], word[moved], place[inverse]


def _deal(batches, buckets: int, sort: str):
    """The distinct words, or (history, word) pairs of one sort, of every block with their training counts, by bucket."""
    for batch in batches:
        for row in batch.to_pylist():
            words, heads, kinds = (_unpack(row[c], k) for c, k in (("words", np.uint64), ("heads", np.uint16), ("classes", np.uint8)))
            token, per = _unpack(row["tokens"], np.int32).astype(np.int64), _unpack(row["per"], np.int64)
            used = np.repeat(_unpack(row["learn"], np.uint8) > 0, per)
            if sort == "word":
                order, cuts = _cut(heads % np.int64(buckets), buckets)
                # How often each is a word, and how often the word before the previous one.
                trained = np.stack([np.bincount(x[used], minlength=len(words))[order] for x in (token, _before(token, per)[1])]).astype(np.int32)
                rows = [{"kind": sort, "bucket": b, "block": row["block"], "keys": _pack(words[order[i:j]]),
                         "items": _pack(kinds[order[i:j]]), "trained": _pack(trained[:, i:j].ravel())}
                        for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if j > i]
            else:
                before, kind, size, home, word, pair = _events(sort, heads, token, per, kinds, buckets)
                keys = spans.mix(_hashed(sort, before, words) ^ spans.mix(kind.astype(np.uint64) + np.uint64(1))) >> np.uint64(KEY_FREE)
                items = (spans.mix(words[word]) >> np.uint64(ITEM_FREE)).astype(np.uint32)
                trained = np.bincount(pair[used], minlength=len(word)).astype(np.int32)
                cuts = np.searchsorted(home, np.arange(buckets + 1))
                at = np.append(0, np.cumsum(size))
                rows = [{"kind": sort, "bucket": b, "block": row["block"], "keys": _pack(keys[i:j]), "sizes": _pack(size[i:j].astype(np.int32)),
                         "items": _pack(items[at[i]:at[j]]), "trained": _pack(trained[at[i]:at[j]])}
                        for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if j > i]
            yield _record(rows, _DEALT)


def _count_bucket(tab: pa.Table) -> pa.Table:
    """Corpus counts of the words or (history, word) pairs of one bucket, sent back to every block that holds them."""
    blocks, kind, bucket = tab.column("block").to_pylist(), tab.column("kind")[0].as_py(), tab.column("bucket")[0].as_py()
    held = {c: [_unpack(x, k) for x in tab.column(c).to_pylist()] for c, k in
            (("keys", np.uint64), ("items", np.uint8 if kind == "word" else np.uint32), ("trained", np.int32))}
    keys, items = (np.concatenate(held[c]) for c in ("keys", "items"))
    trained = np.concatenate([x.reshape(2 if kind == "word" else 1, -1) for x in held["trained"]], axis=1)
    event, groups = keys, [None] * len(blocks)
    if kind != "word":
        group, of_group = _unique(keys)
        size = np.concatenate([_unpack(x, np.int32) for x in tab.column("sizes").to_pylist()])
        of_event = np.repeat(of_group, size)
        event = spans.mix(spans.mix(group[of_event]) + items)
    unique, inverse = _unique(event)
    sums = np.stack([np.bincount(inverse, weights=x, minlength=len(unique)).astype(np.int64) for x in trained])
    total = sums[0]
    known = total > 0
    mine = np.empty(len(unique), np.int64)
    mine[inverse] = items if kind == "word" else of_event
    if kind == "word":
        kinds = mine[known]
        totals = np.append(np.bincount(kinds, weights=total[known], minlength=CLASSES).astype(np.int64),
                           np.bincount(kinds, minlength=CLASSES))
    else:
        tokens = np.bincount(mine, weights=total, minlength=len(group)).astype(np.int64)
        words = np.bincount(mine[known], minlength=len(group))
        ends = np.cumsum([len(x) for x in held["keys"]])
        groups = [_pack(np.append(tokens[of_group[e - len(x):e]], words[of_group[e - len(x):e]])) for e, x in zip(ends, held["keys"])]
        totals = np.array([(total == 1).sum(), (total == 2).sum()], np.int64)
    back = sums[:, inverse]
    ends = np.cumsum([len(x) for x in held["items"]])
    rows = [{"kind": kind, "bucket": bucket, "block": b, "counts": _pack(back[:, e - len(x):e].ravel()), "groups": g}
            for b, e, x, g in zip(blocks, ends, held["items"], groups)]
    rows.append({"kind": kind, "bucket": bucket, "block": -1, "counts": totals.astype(np.int64).tobytes()})
    return pa.Table.from_batches([_record(rows, _COUNTED)])


def _logits(w: dict, history: np.ndarray) -> np.ndarray:
    a, b = history // SKIP, history % SKIP
    t = (spans.mix(history.astype(np.uint64)) % np.uint64(TRIGRAM)).astype(np.int64)
    z = w["bias"] + w["bigram"][a] + w["skip"][b] + w["trigram"][t]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _gradient(w: dict, slice_number: int, counts: np.ndarray) -> np.ndarray:
    """Gradient of the log likelihood of one slice of histories, all weights end to end."""
    size = HISTORIES // SLICES
    history = np.arange(slice_number * size, (slice_number + 1) * size)
    n = counts.reshape(size, CLASSES).astype(np.float64)
    rest = n - n.sum(axis=1, keepdims=True) * np.exp(_logits(w, history))
    out = {k: np.zeros_like(v) for k, v in w.items()}
    out["bias"] += rest.sum(axis=0)
    np.add.at(out["bigram"], history // SKIP, rest)
    np.add.at(out["skip"], history % SKIP, rest)
    np.add.at(out["trigram"], (spans.mix(history.astype(np.uint64)) % np.uint64(TRIGRAM)).astype(np.int64), rest)
    return np.concatenate([out[k].ravel() for k in w])


def _weights(flat: np.ndarray | None = None) -> dict:
    shapes = {"bias": (CLASSES,), "bigram": (BIGRAM, CLASSES), "skip": (SKIP, CLASSES), "trigram": (TRIGRAM, CLASSES)}
    w, at = {}, 0
    for k, s in shapes.items():
        n = int(np.prod(s))
        w[k] = np.zeros(s) if flat is None else flat[at:at + n].reshape(s)
        at += n
    return w


def train(counts: DataFrame, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Weights after `steps` adaptive gradient steps over the slices (bucket, trained) of the history counts."""
    def add(tab: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in tab.column("trained").to_pylist())
        return pa.table({"slice": [tab.column("bucket")[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())},
                        schema=pa.schema([("slice", pa.int32()), ("counts", pa.binary())]))

    spark = counts.sparkSession
    slices = stored(counts.select("bucket", "trained").groupBy("bucket").applyInArrow(add, "slice int, counts binary"))
    flat = np.concatenate([x.ravel() for x in _weights().values()])
    total = slices.select(F.sum(F.length("counts"))).first()[0]
    if not total:
        return flat
    squares = np.zeros_like(flat)
    for _ in range(steps):
        now = spark.sparkContext.broadcast(flat)

        def slope(batches, now=now):
            w = _weights(now.value)
            for batch in batches:
                grads = [_gradient(w, s.as_py(), np.frombuffer(c.as_py(), np.int64))
                         for s, c in zip(batch.column(0), batch.column(1))]
                if grads:
                    yield pa.RecordBatch.from_arrays([pa.array([sum(grads).tobytes()], pa.binary())], ["g"])

        parts = slices.mapInArrow(slope, "g binary").collect()  # one sum per task, of fixed size
        gradient = sum(np.frombuffer(p.g, np.float64) for p in parts)
        gradient = gradient - flat  # Gaussian prior of variance one
        squares += gradient * gradient
        flat = flat + rate * gradient / np.sqrt(squares + 1e-12)
        now.unpersist()
    return flat


def score(docs: DataFrame, training: str, text: str = "text", histories: tuple = ("pair",)) -> DataFrame:
    """`docs` without the text, plus n_tokens, n_known, train_tokens, base_score and score.

    `training` names a boolean column: the rows to learn from. `histories`: those with sparse features, in the order
    of `SPARSE`; "both" needs "pair".
    """
    spark = docs.sparkSession
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*[c for c in results if c in docs.columns])
    packed = stored(docs.mapInArrow(lambda it: _encode(it, text, training), _TEXTS))
    texts = packed.where("kind = 'text'")
    held = texts.agg(F.sum(F.length("words") + F.length("tokens"))).first()[0] or 0
    buckets = min(max(4 * shuffle_partitions(spark), held // BUCKET), 1 << 16)
    shown = texts.select("block", "words", "heads", "classes", "tokens", "per", "learn")

    def gather(sort: str) -> DataFrame:
        dealt = shown.mapInArrow(lambda it: _deal(it, buckets, sort), _DEALT)
        return stored(dealt.groupBy("kind", "bucket").applyInArrow(_count_bucket, _COUNTED))

    # The largest first, while little else is held.
    gathered = {sort: gather(sort) for sort in (*reversed(histories), "word")}
    totals = _totals(gathered["word"], "word", 2 * CLASSES)
    known, types = totals[:CLASSES], totals[CLASSES:]
    discounts = {}
    for sort in histories:
        once, twice = _totals(gathered[sort], sort, 2)
        discounts[sort] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    flat = train(packed.where("kind = 'count'"))
    model = spark.sparkContext.broadcast(np.exp(_logits(_weights(flat), np.arange(HISTORIES))))
    n, v = int(known.sum()), int(types.sum())
    kept = docs.drop(text)

    def run(tab: pa.Table, back: pa.Table) -> pa.Table:
        tab = tab.to_pylist()[0]
        back = sorted(back.to_pylist(), key=lambda r: r["bucket"])
        heads, kinds = _unpack(tab["heads"], np.uint16), _unpack(tab["classes"], np.uint8)
        token, per = _unpack(tab["tokens"], np.int32).astype(np.int64), _unpack(tab["per"], np.int64)
        begin = np.cumsum(per) - per
        got = {sort: [r for r in back if r["kind"] == sort] for sort in ("word", *histories)}
        count, skipped = np.empty((2, len(heads)), np.int64)
        order = _cut(heads % np.int64(buckets), buckets)[0]
        count[order], skipped[order] = np.concatenate([_unpack(r["counts"], np.int64).reshape(2, -1) for r in got["word"]], axis=1)
        base = np.log10((count + 1) / (n + v + 1))
        one, two = _before(token, per)
        chosen = model.value[_histories(heads, token, per), kinds[token]]  # of the class
        inside = ((count + 1) / (known[kinds] + types[kinds] + 1))[token]  # of the word in its class
        reached = {"skip": skipped[two], "pair": count[one]}  # training tokens after a token's history
        for sort in histories:
            _, _, size, _, _, event = _events(sort, heads, token, per, kinds, buckets)
            events = np.concatenate([_unpack(r["counts"], np.int64) for r in got[sort]])[event]
            tokens, follow = np.concatenate([_unpack(r["groups"], np.int64).reshape(2, -1) for r in got[sort]], axis=1)
            group = np.repeat(np.arange(len(size)), size)[event]
            tokens, follow = tokens[group], follow[group]
            if sort == "pair":  # a word pair is a history as often as it occurs; the first token of a text follows an end
                reached["both"] = np.append(0, events[:-1])
                reached["both"][begin] = count[one[begin]]
            chosen = (tokens + PRIOR * chosen) / (reached[sort] + PRIOR)
            some = np.maximum(tokens, 1)
            inside = np.maximum(events - discounts[sort], 0) / some + np.where(tokens > 0, discounts[sort] * follow / some, 1) * inside
        full = np.log10(chosen) + np.log10(inside)
        out = pa.ipc.open_stream(tab["rows"]).read_all()
        for name, value in (("n_tokens", per), ("n_known", np.add.reduceat((count > 0)[token].astype(np.int64), begin)),
                            ("train_tokens", np.full(len(per), n)), ("base_score", np.add.reduceat(base[token], begin)),
                            ("score", np.add.reduceat(full, begin))):
            out = out.append_column(name, pa.array(value))
        return out

    counted = functools.reduce(DataFrame.unionByName, gathered.values())
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
                       + ["n_tokens bigint", "n_known bigint", "train_tokens bigint", "base_score double", "score double"])
    def part(df: DataFrame, number: int) -> DataFrame:
        return df.where((F.col("block") >= 0) & (F.pmod(F.xxhash64("block"), F.lit(PARTS)) == number)).groupBy("block")

    texts = texts.select("block", "heads", "classes", "tokens", "per", "rows")
    scored = [stored(part(texts, i).cogroup(part(counted, i)).applyInArrow(run, schema)) for i in range(PARTS)]
    for table in (packed, *gathered.values()):
        discard(table)
    return functools.reduce(DataFrame.unionByName, scored)


def _totals(counted: DataFrame, kind: str, size: int) -> np.ndarray:
    """The totals of all buckets of one kind, summed."""
    def add(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["t"])

    parts = counted.where((F.col("block") == -1) & (F.col("kind") == kind)).select("counts").mapInArrow(add, "t binary").collect()
    return sum((np.frombuffer(p.t, np.int64) for p in parts), np.zeros(size, np.int64))


def held_out(key: str, parts: int, part: int):
    """Whether the CRC-32 of the key's text leaves `part` when divided by `parts`."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == part


@query("op9_maxent")
def op9_maxent(spark, folder):
    """Unigram and maximum-entropy log probabilities of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out("doc_id", 7, 2).alias("held_out"))
    docs = docs.withColumn("learn", ~F.col("held_out"))
    return score(docs, "learn", histories=SPARSE).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
