"""Mass moving along the edges of a directed acyclic graph, and sums along parent links.

The general form works on whole frames: a hop is one join of the moving rows with the edges and one
partially aggregated shuffle, so nothing depends on how large one connected piece is. Graphs whose
checked size is small go through one grouped task per piece instead.

Where the nodes have numbers that grow along every edge, a large graph is cut into bands of them instead, with
about as many edges each. Bands follow one another: what arrives in a band is spread inside it by grouped tasks
(one per piece and bucket of tags) and then sent on along the edges that leave it. So the rounds are as many as the
bands, not the edges of the longest path, and every row is written when it is final. What was sent to a band goes with it.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.core import at_most, discard, empty_frame, materialize, shuffle_partitions, shuffled

HOPS_PER_JOB = 5
SMALL_EDGES = 100_000
SMALL_PRODUCT = 50_000_000
BAND_EDGES = 300_000
BUCKET_TAGS = 100  # seeds per task of a band, if they have tags


def spread(seeds: DataFrame, edges: DataFrame, tags=(), sums=("mass",), mins=(),
           small_edges: int = SMALL_EDGES, band_edges: int = BAND_EDGES, finish=None) -> DataFrame:
    """Accumulate at every node what reaches it from the seeds over all directed paths.

    `seeds`: piece, node, tags, values. `edges`: piece, source, target, share. Edges stay inside a
    piece. A value in `sums` is multiplied by `share` and added up; one in `mins` keeps its minimum.
    The graph must have no cycle. Result: piece, node, tags, values. Large graphs go by bands if `seeds` have the
    number of their node as `at` and `edges` those of source and target as `at` and `to`, unless some edge has at > to.
    `finish` changes the result and needs no more at once than all rows of a node; bands are written only as it leaves them.
    """
    done = (lambda df: df) if finish is None else finish
    ordered = "at" in seeds.columns
    seeds = seeds.select("piece", "node", *tags, *sums, *mins, *["at"] * ordered)
    edges = edges.select("piece", "source", "target", F.col("share").cast("double"), *["at", "to"] * ordered)
    lists = list(tags), list(sums), list(mins)
    if at_most(edges, small_edges):
        n_edges, n_seeds = edges.count(), seeds.count() if tags else 1
        if n_edges * n_seeds <= SMALL_PRODUCT:
            return done(materialize(_spread_pieces(seeds.drop("at"), edges.drop("at", "to"), *lists)))
    if ordered and _never_back(edges) and _one_number_each(seeds, edges):
        return _spread_bands(seeds, edges, *lists, band_edges, finish)
    return done(_spread_hops(seeds.drop("at"), edges.drop("at", "to"), *lists))


def _never_back(edges) -> bool:
    """Whether no edge lacks a number or leads to a smaller one; bands go in the order of the numbers."""
    return edges.where(F.coalesce(F.col("at") > F.col("to"), F.lit(True))).isEmpty()


def _one_number_each(seeds, edges) -> bool:
    """Whether no node has two numbers (ids may repeat); otherwise bands would part what belongs together."""
    numbers = seeds.select("node", "at").unionByName(edges.select(F.col("source").alias("node"), "at")).unionByName(
        edges.select(F.col("target").alias("node"), F.col("to").alias("at")))
    return numbers.groupBy("node").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low < high").isEmpty()


def _spread_bands(seeds, edges, tags, sums, mins, band_edges, finish=None) -> DataFrame:
    """Bands in the order of the numbers; what a band sends on is added up per node before it is written.

    A node has one number, so a band holds all rows of its nodes.
    """
    n_bands = -(-edges.count() // band_edges)
    cuts = edges.approxQuantile("at", [i / n_bands for i in range(1, n_bands)], 0.001) if n_bands > 1 else []
    cuts = sorted(set(cuts))
    ends = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    band = lambda c: F.size(F.filter(ends, lambda x: x < F.col(c)))
    edges = materialize(edges.select("piece", "source", "target", "share", band("at").alias("_from"), band("to").alias("_to")))
    seeds = materialize(seeds.withColumn("_to", band("at")).drop("at"))
    buckets = max(1, -(-seeds.count() // BUCKET_TAGS)) if tags else 1
    names = ["piece", "node", *tags, *sums, *mins]
    sent, done = [seeds.select(*names, "_to")], []
    for b in range(len(cuts) + 1):
        arrived = functools.reduce(DataFrame.unionByName, [m.where(F.col("_to") == b) for m in sent]).drop("_to")
        inside = edges.where((F.col("_from") == b) & (F.col("_to") == b)).select("piece", "source", "target", "share")
        settled = materialize(_spread_pieces(arrived, inside, tags, sums, mins, buckets))
        for m in sent[1:]:
            discard(m, f"_to={b}")
        if b < len(cuts):
            leaving = edges.where((F.col("_from") == b) & (F.col("_to") > b)).select("source", "target", "share", "_to")
            moved = settled.join(shuffled(leaving), F.col("node") == F.col("source")).select(
                "piece", F.col("target").alias("node"), *tags, *[(F.col(v) * F.col("share")).alias(v) for v in sums], *mins, "_to")
            sent.append(materialize(moved.groupBy("piece", "node", *tags, "_to").agg(
                *[F.sum(v).alias(v) for v in sums], *[F.min(v).alias(v) for v in mins]).select(*names, "_to"), by="_to"))
        if finish is None:
            done.append(settled)
        else:
            done.append(materialize(finish(settled)))
            discard(settled)
    result = functools.reduce(DataFrame.unionByName, done)
    result._written_rows = sum(part._written_rows for part in done)  # all of it is written
    return result


def _spread_pieces(seeds, edges, tags, sums, mins, buckets: int = 1) -> DataFrame:
    names = ["piece", "node", *tags, *sums, *mins]
    types = {f.name: f.dataType.simpleString() for f in seeds.schema}
    schema = ", ".join(f"{n} {types[n] if n not in sums else 'double'}" for n in names)
    keys = ["node", *tags]

    def collapse(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.groupby(keys, as_index=False, sort=False).agg(
            {**{s: "sum" for s in sums}, **{m: "min" for m in mins}})

    def walk(start: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if not len(start):
            return empty_frame(schema)
        piece = start["piece"].iat[0]
        links = links.sort_values("source")
        sources, targets = links["source"].to_numpy(), links["target"].to_numpy()
        shares = links["share"].to_numpy()
        moving, waves = collapse(start), []
        while len(moving):
            waves.append(moving)
            node = moving["node"].to_numpy()
            lo, hi = np.searchsorted(sources, node, "left"), np.searchsorted(sources, node, "right")
            fan = hi - lo
            edge = np.repeat(lo - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
            moved = moving.loc[np.repeat(moving.index.to_numpy(), fan)].assign(node=targets[edge])
            for s in sums:
                moved[s] = moved[s].to_numpy() * shares[edge]
            moving = collapse(moved)
        return collapse(pd.concat(waves, ignore_index=True)).assign(piece=piece)[names]

    if buckets == 1:
        return seeds.groupBy("piece").cogroup(edges.groupBy("piece")).applyInPandas(walk, schema)
    seeds = seeds.withColumn("_bucket", F.pmod(F.xxhash64(*tags), F.lit(buckets)))
    edges = edges.withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return seeds.groupBy("piece", "_bucket").cogroup(edges.groupBy("piece", "_bucket")).applyInPandas(walk, schema)


def _spread_hops(seeds, edges, tags, sums, mins) -> DataFrame:
    """Hops over the whole graph. Each node also links to itself so that what it holds stays put."""
    n = shuffle_partitions(edges.sparkSession)
    keys, values = ["piece", "node", *tags], [*sums, *mins]
    here = (seeds.select("piece", F.col("node").alias("source"))
            .unionByName(edges.select("piece", "source"))
            .unionByName(edges.select("piece", F.col("target").alias("source"))).distinct())
    links = (edges.withColumn("stays", F.lit(False))
             .unionByName(here.select("piece", "source", F.col("source").alias("target"),
                                      F.lit(1.0).alias("share"), F.lit(True).alias("stays")))
             .drop("piece").repartition(n, "source").persist(StorageLevel.MEMORY_AND_DISK))

    def merged(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(
            *[F.sum(f"{p}_{s}").alias(f"{p}_{s}") for s in sums for p in ("held", "moving")],
            *[F.min(f"{p}_{m}").alias(f"{p}_{m}") for m in mins for p in ("held", "moving")])

    def hop(df: DataFrame) -> DataFrame:
        joined = (df.join(shuffled(links), F.col("node") == F.col("source"))
                  .where(F.col("stays") | F.col(f"moving_{values[0]}").isNotNull()))
        columns = []
        for v in values:
            held, moving = F.col(f"held_{v}"), F.col(f"moving_{v}")
            if v in sums:
                total = F.when(held.isNull() & moving.isNull(), None).otherwise(
                    F.coalesce(held, F.lit(0.0)) + F.coalesce(moving, F.lit(0.0)))
                sent = moving * F.col("share")
            else:
                total, sent = F.least(held, moving), moving
            columns += [F.when(F.col("stays"), total).alias(f"held_{v}"),
                        F.when(~F.col("stays"), sent).alias(f"moving_{v}")]
        return merged(joined.select("piece", F.col("target").alias("node"), *tags, *columns))

    types = {f.name: f.dataType for f in seeds.schema}
    state = merged(seeds.select(*keys, *[
        c for v in values for c in (F.lit(None).cast("double" if v in sums else types[v]).alias(f"held_{v}"),
                                    F.col(v).alias(f"moving_{v}"))]))
    while True:
        for _ in range(HOPS_PER_JOB):
            state = hop(state)
        state = materialize(state)
        if state.where(F.col(f"moving_{values[0]}").isNotNull()).isEmpty():
            break
    links.unpersist()
    return state.select(*keys, *[F.col(f"held_{v}").alias(v) for v in values])


def follow_parents(links: DataFrame, amount: Column | None = None,
                   small_links: int = SMALL_EDGES) -> DataFrame:
    """For every node of a forest: its root, the number of links up to it and a sum along them.

    `links`: node, parent (null for a root) and the columns `amount` uses; the amount of a root is not
    counted. Pointer doubling: the number of rounds is the logarithm of the depth, and nodes whose
    pointer has reached a root take no further part in the joins. Checked small forests take the same
    rounds inside one task.
    """
    amount = F.lit(0.0) if amount is None else amount
    start = links.select(
        "node", F.coalesce("parent", "node").alias("pointer"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.when(F.col("parent").isNull(), F.lit(0.0)).otherwise(amount).cast("double").alias("total"),
        F.col("parent").isNull().alias("done"))
    state = materialize(start)
    if at_most(state, small_links):
        def jump(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node", ignore_index=True)
            at = np.searchsorted(pdf["node"].to_numpy(), pdf["pointer"].to_numpy())
            depth, total = pdf["depth"].to_numpy().copy(), pdf["total"].to_numpy().copy()
            while (at[at] != at).any():
                depth, total, at = depth + depth[at], total + total[at], at[at]
            return pdf[["node"]].assign(root=pdf["node"].to_numpy()[at], depth=depth, total=total)

        return materialize(state.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
            jump, "node long, root long, depth long, total double"))
    finished = [state.where("done")]
    moving = state.where("not done")
    known = state
    while not moving.isEmpty():
        target = known.select(F.col("node").alias("pointer"), F.col("pointer").alias("_next"),
                              F.col("depth").alias("_depth"), F.col("total").alias("_total"),
                              F.col("done").alias("_done"))
        step = materialize(
            moving.join(shuffled(target), "pointer").select(
                "node", F.col("_next").alias("pointer"), (F.col("depth") + F.col("_depth")).alias("depth"),
                (F.col("total") + F.col("_total")).alias("total"),
                F.col("_done").alias("done")))
        finished.append(step.where("done"))
        moving = step.where("not done")
        known = functools.reduce(DataFrame.unionByName, finished).unionByName(moving)
    result = functools.reduce(DataFrame.unionByName, finished)
    return result.select("node", F.col("pointer").alias("root"), "depth", "total")
