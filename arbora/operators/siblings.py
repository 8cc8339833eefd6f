"""Merging close sibling groups of a contracted tree, deepest parents first.

Only groups under one parent can merge, and a merge changes nothing but the groups below it and the
parent's own list. So all parents at the greatest open depth of their tree work at the same time; a
parent is done when its list offers no pair, and a merge that touched a group with children reopens
that group. Trees whose checked size is small run as one task each, however many trees there are; a round of
the other trees is a handful of joins over all their open parents.

A parent with very many children takes many merges per round: its cheapest pairs are found by block
pairs, the merges they lead to are played through among their ends, and every group so made is then
compared with all other children, block by block. The merges before the first one that such a comparison
would have overtaken are those of one merge at a time, and they are kept.

`merge_order` is the order of one merge at a time over all trees: deepest parent, then distance, gap and
smallest ids. The merges that follow from the first look at one parent (its turn: its own merges and those
below a merged group) never depend on another turn of that depth, and at any moment the turn with the
smallest next merge goes on. So a merge comes at the place of the largest merge of its turn so far.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.core import empty_frame, is_empty, materialize
from arbora.operators.contract import group_edges, group_nodes, number_groups
from arbora.operators.ordering import number_rows, running_max
from arbora.operators.propagate import follow_parents

SMALL_GROUPS = 50_000
CHILD_ROWS = 2000
HISTORY = ("parent_head long, left_head long, right_head long, depth long, turn long, turn_depth long, wave int, step int, "
           "cosine_distance double, mean_stage_gap double, merged_mean_stage double, "
           "left_was_leaf boolean, right_was_leaf boolean, left_min long, right_min long")


def typed(pdf: pd.DataFrame, schema: str) -> pd.DataFrame:
    """All columns of `schema`, with whole numbers that may be missing kept exact."""
    kinds = dict(c.split() for c in schema.split(", "))
    pdf = pdf.reindex(columns=list(kinds))
    for c, t in kinds.items():
        if t.startswith("array"):
            pdf[c] = pdf[c].astype(object).where(pdf[c].notna(), None)
    return pdf.astype({c: {"long": "Int64", "int": "Int32", "boolean": "boolean"}[t]
                       for c, t in kinds.items() if t in ("long", "int", "boolean")})


class Limits:
    def __init__(self, distance: float, gap: float):
        self.distance, self.gap = distance, gap


def pair_costs(a: dict, b: dict, parent_stage: float, limits: Limits) -> np.ndarray:
    """Cosine distances of all allowed pairs of two sets of groups, infinite where not allowed."""
    def units(vectors):
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)

    distance = np.maximum(0.0, 1.0 - np.round(units(a["vector"]) @ units(b["vector"]).T, 12))
    weight = a["n"][:, None] + b["n"][None, :]
    merged = (a["n"] * a["stage"])[:, None] + (b["n"] * b["stage"])[None, :]
    merged = merged / weight
    allowed = ((distance <= limits.distance)
               & (np.abs(a["stage"][:, None] - b["stage"][None, :]) <= limits.gap)
               & (a["leaf"][:, None] | b["leaf"][None, :]) & (merged > parent_stage)
               & (merged < np.minimum(a["child_stage"][:, None], b["child_stage"][None, :]))
               & (a["head"][:, None] != b["head"][None, :]))
    return np.where(allowed, distance, np.inf)


def pair_keys(a: dict, b: dict, i: np.ndarray, j: np.ndarray):
    """Stage gaps, ids of the left and ids of the right group of the pairs (i, j)."""
    first = a["place"][i] < b["place"][j]
    return (np.abs(a["stage"][i] - b["stage"][j]), np.where(first, a["min_id"][i], b["min_id"][j]),
            np.where(first, b["min_id"][j], a["min_id"][i]))


def best_pair(costs: np.ndarray, a: dict, b: dict):
    """(i, j) of the cheapest pair: distance, then stage gap, then lowest ids; None without a pair."""
    low = costs.min() if costs.size else np.inf
    if not np.isfinite(low):
        return None
    i, j = np.nonzero(costs == low)
    gap, left, right = pair_keys(a, b, i, j)
    pick = np.lexsort((right, left, gap))[0]
    return int(i[pick]), int(j[pick])


def as_arrays(pdf: pd.DataFrame) -> dict:
    return {"head": pdf["head"].to_numpy(dtype=np.int64), "place": pdf["place"].to_numpy(dtype=np.int64),
            "n": pdf["n"].to_numpy(dtype=np.float64), "stage": pdf["stage"].to_numpy(dtype=np.float64),
            "min_id": pdf["min_id"].to_numpy(dtype=np.int64),
            "leaf": pdf["leaf"].to_numpy(dtype=bool),
            "child_stage": pdf["child_stage"].to_numpy(dtype=np.float64),
            "vector": np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vector"]])}


def merge_pair(g: dict, i: int, j: int) -> None:
    """Fold group j into group i."""
    total = g["n"][i] + g["n"][j]
    for name in ("stage", "vector"):
        g[name][i] = (g[name][i] * g["n"][i] + g[name][j] * g["n"][j]) / total
    g["n"][i] = total
    g["min_id"][i] = min(g["min_id"][i], g["min_id"][j])
    g["leaf"][i] = g["leaf"][i] and g["leaf"][j]
    g["child_stage"][i] = min(g["child_stage"][i], g["child_stage"][j])


def merge_children(g: dict, parent: int, parent_stage: float, depth: int, turn: tuple, wave: int, limits: Limits,
                   bound: tuple | None = None, most: float = np.inf, made: list | None = None):
    """Merge the children of one parent until no pair is left or a group with children took part.

    Changes `g` in place; returns history rows, {merged head: surviving head} and the survivor that
    has children, if any. Ends also before a pair whose (distance, gap, ids) lie beyond `bound`, or after
    `most` merges; `made` gets the state of every merged group.
    """
    costs = pair_costs(g, g, parent_stage, limits)
    alive = np.ones(len(g["head"]), dtype=bool)
    history, moved = [], {}
    while True:
        pair = best_pair(costs, g, g) if len(history) < most else None
        if pair is None:
            return history, moved, None, alive
        i, j = sorted(pair, key=lambda x: g["place"][x])
        key = (float(costs[i, j]), float(abs(g["stage"][i] - g["stage"][j])), int(g["min_id"][i]), int(g["min_id"][j]))
        if bound is not None and key > bound:
            return history, moved, None, alive
        heads, leaves = (int(g["head"][i]), int(g["head"][j])), (bool(g["leaf"][i]), bool(g["leaf"][j]))
        merge_pair(g, i, j)
        history.append((parent, *heads, depth, *turn, wave, len(history), *key[:2], float(g["stage"][i]), *leaves, *key[2:]))
        if made is not None:
            made.append({k: v[i].copy() for k, v in g.items()})
        moved[int(g["head"][j])] = int(g["head"][i])
        alive[j] = False
        costs[j, :] = costs[:, j] = np.inf
        if not g["leaf"][i]:
            return history, moved, int(g["head"][i]), alive
        one = {k: v[i:i + 1] for k, v in g.items()}
        row = pair_costs(one, g, parent_stage, limits)[0]
        row[~alive] = np.inf
        costs[i, :] = costs[:, i] = row


def start_groups(nodes: DataFrame, groups: DataFrame, edges: DataFrame) -> DataFrame:
    """State of the merge: one row per group with its parent, tree, depth and totals."""
    totals = materialize(group_nodes(nodes, groups))
    links = totals.select("head_id").join(
        group_edges(groups, edges).withColumnRenamed("child_id", "head_id"), "head_id", "left")
    up = follow_parents(links.select(F.col("head_id").alias("node"), F.col("parent_id").alias("parent")))
    order = number_groups(nodes, groups)
    return materialize(
        totals.join(links, "head_id").join(order, "head_id")
        .join(up.select(F.col("node").alias("head_id"), F.col("root").alias("unit"), "depth"), "head_id")
        .select(F.col("head_id").alias("head"), F.col("parent_id").alias("parent"), "unit", "depth",
                F.col("contracted_node_id").alias("place"), F.col("n_cells").cast("double").alias("n"),
                "stage", F.col("min_source").alias("min_id"), F.col("embedding").alias("vector")))


def with_children(state: DataFrame) -> DataFrame:
    """Add leaf, the earliest stage among a group's own children, and its parent's stage and depth."""
    below = state.where("parent is not null").groupBy(F.col("parent").alias("head")).agg(
        F.min("stage").alias("child_stage"))
    above = state.select(F.col("head").alias("parent"), F.col("stage").alias("parent_stage"))
    return (state.join(below, "head", "left").join(above, "parent", "left")
            .withColumn("leaf", F.col("child_stage").isNull())
            .withColumn("child_stage", F.coalesce("child_stage", F.lit(float("inf")))))


def merge_siblings(nodes: DataFrame, groups: DataFrame, edges: DataFrame, max_distance: float = 0.2,
                   max_gap: float = 1.0, small_groups: int = SMALL_GROUPS,
                   child_rows: int = CHILD_ROWS) -> tuple[DataFrame, DataFrame]:
    """New partition (node_id, head_id) and the history of merges."""
    limits = Limits(max_distance, max_gap)
    small, large = _by_size(start_groups(nodes, groups, edges), small_groups, child_rows)
    done = [run(state, limits, child_rows) for run, state in ((_merge_small, small), (_merge_rounds, large)) if state is not None]
    moved, history = (functools.reduce(DataFrame.unionByName, parts) for parts in zip(*done))
    outer = moved.withColumnRenamed("head", "head_id")
    result = groups.join(outer, "head_id", "left").select(
        "node_id", F.coalesce("survivor", "head_id").alias("head_id"))
    return materialize(result), _ordered(history if len(done) == 1 else materialize(history))


def _by_size(state: DataFrame, small_groups: int, child_rows: int):
    """The groups of trees that one task can take, and those of the others; None where there are none.

    Merges never lengthen a list of children, since one of two merged groups has none.
    """
    lists = state.where("parent is not null").groupBy("unit", "parent").agg(F.count("*").alias("_children"))
    wide = lists.where(F.col("_children") > child_rows).select("unit")
    long = state.groupBy("unit").agg(F.count("*").alias("_groups")).where(F.col("_groups") > small_groups).select("unit")
    large = materialize(wide.unionByName(long).distinct())
    if is_empty(large):
        return state, None
    rest = materialize(state.join(large, "unit", "left_anti"))
    return None if is_empty(rest) else rest, materialize(state.join(large, "unit", "left_semi"))


def _merge_small(state: DataFrame, limits: Limits, child_rows: int):
    """Every tree in one task."""
    schema = HISTORY + ", head long, survivor long"

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        g = as_arrays(pdf.assign(leaf=False, child_stage=np.inf))
        depth = pdf["depth"].to_numpy()
        index = {h: i for i, h in enumerate(g["head"].tolist())}
        children: dict[int, set] = {}
        for i, p in enumerate(pdf["parent"]):
            if not pd.isna(p):
                children.setdefault(index[int(p)], set()).add(i)
        g["leaf"] = np.array([i not in children for i in range(len(pdf))])
        open_, wave, rows, survivor = set(children), 0, [], {}
        turn = {p: (int(g["head"][p]), int(depth[p])) for p in children}
        while open_:
            deepest = max(depth[p] for p in open_)
            for p in sorted(x for x in open_ if depth[x] == deepest):
                open_.discard(p)
                kids = sorted(children[p])
                if len(kids) < 2:
                    continue
                for k in kids:
                    g["child_stage"][k] = min((g["stage"][c] for c in children.get(k, ())), default=np.inf)
                local = {name: values[kids].copy() for name, values in g.items()}
                history, moved, inner, _ = merge_children(
                    local, int(g["head"][p]), float(g["stage"][p]), int(depth[p]), turn[p], wave, limits)
                rows += history
                for name in g:
                    g[name][kids] = local[name]
                for old, new in moved.items():
                    survivor[old] = new
                    children[p].discard(index[old])
                    if index[old] in children:
                        children.setdefault(index[new], set()).update(children.pop(index[old]))
                        open_.discard(index[old])
                if inner is not None:
                    open_ |= {p, index[inner]}
                    turn[index[inner]] = turn[p]
            wave += 1
        out = typed(pd.DataFrame(rows, columns=[c.split()[0] for c in HISTORY.split(", ")]), schema)
        final = []
        for old in survivor:
            new = survivor[old]
            while new in survivor:
                new = survivor[new]
            final.append((old, new))
        return pd.concat([out, typed(pd.DataFrame(final, columns=["head", "survivor"]), schema)],
                         ignore_index=True)

    found = materialize(state.groupBy("unit").applyInPandas(tree, schema))
    return (found.where("head is not null").select("head", "survivor"),
            found.where("head is null").drop("head", "survivor"))


def _ordered(history: DataFrame) -> DataFrame:
    key = ["cosine_distance", "mean_stage_gap", "left_min", "right_min"]
    own = F.when(F.col("depth") == F.col("turn_depth"), F.struct(*key))
    placed = running_max(history.withColumn("_own", own), ["turn_depth", "turn"], ["wave", "step"], "_own", "_place")
    numbered = number_rows(placed, [], [F.desc("turn_depth"), *[F.col(f"_place.{k}") for k in key], "wave", "step"], "merge_order")
    return numbered.withColumn("merge_order", F.col("merge_order") + 1).drop("_own", "_place", "turn", "turn_depth", "wave", "step")


def _merge_rounds(state: DataFrame, limits: Limits, child_rows: int):
    """Rounds over all trees at once."""
    spark = state.sparkSession
    state = state.withColumn("touched", F.lit(-1))
    open_ = materialize(state.where("parent is not null").groupBy("unit", F.col("parent").alias("head"))
                        .agg(F.max("depth").alias("below"))
                        .withColumns({"turn": F.col("head"), "turn_depth": F.col("below") - 1}))
    survivors = spark.createDataFrame([], "head long, survivor long")
    histories, wave = [], 0
    row_schema = ("parent long, unit long, level long, place long, head long, n double, stage double, "
                  "min_id long, vector array<double>")
    schema = f"{HISTORY}, {row_schema}, survivor long, inner long"
    while not is_empty(open_):
        deepest = open_.groupBy("unit").agg(F.max("below").alias("below"))
        active = materialize(open_.join(deepest, ["unit", "below"], "left_semi"))
        lists = materialize(with_children(state).join(
            active.select(F.col("head").alias("parent"), "turn", "turn_depth"), "parent"))
        sizes = lists.groupBy("parent").agg(F.count("*").alias("_size"))
        here = wave

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.reset_index(drop=True)
            g = as_arrays(pdf)
            most = int(pdf["most"].iat[0]) if "most" in pdf else np.inf
            history, moved, inner, alive = _merge_list(pdf, g, here, limits, most=most)
            out = [pd.DataFrame(history, columns=[c.split()[0] for c in HISTORY.split(", ")])]
            if history:
                kept = np.flatnonzero(alive)
                rows = pdf.loc[kept, ["parent", "unit", "place", "head"]].assign(
                    level=pdf["depth"].iat[0], n=g["n"][kept], stage=g["stage"][kept], min_id=g["min_id"][kept],
                    vector=list(g["vector"][kept]))
                for old in moved:
                    new = moved[old]
                    while new in moved:
                        new = moved[new]
                    out.append(pd.DataFrame({"head": [old], "survivor": [new]}))
                out.append(rows)
                if inner is not None:
                    out.append(pd.DataFrame({"inner": [inner], "parent": [pdf["parent"].iat[0]],
                                             "turn": [pdf["turn"].iat[0]], "turn_depth": [pdf["turn_depth"].iat[0]]}))
            return pd.concat([typed(o, schema) for o in out], ignore_index=True)

        wide = sizes.where(F.col("_size") > child_rows)
        narrow = lists.join(sizes.where(F.col("_size").between(2, child_rows)), "parent", "left_semi")
        found = narrow.groupBy("parent").applyInPandas(kernel, schema)
        stuck = None
        if not wide.isEmpty():
            long = materialize(lists.join(wide, "parent", "left_semi"))
            chosen = _certain(long, limits, child_rows)
            found = found.unionByName(chosen.groupBy("parent").applyInPandas(kernel, schema))
            stuck = chosen.select(F.col("parent").alias("head"), "turn", "turn_depth")
        found = materialize(found)
        histories.append(found.where("parent_head is not null").select(
            *[c.split()[0] for c in HISTORY.split(", ")]))
        moved = materialize(found.where("survivor is not null").select("head", "survivor"))
        fresh = found.where("vector is not null").select(*[c.split()[0] for c in row_schema.split(", ")]).withColumnRenamed("level", "depth")
        inner = found.where("inner is not null")
        again = inner.select(F.explode(F.array("inner", "parent")).alias("head"), "turn", "turn_depth")
        if stuck is not None:
            again = again.unionByName(stuck)

        gone = moved.select("head").unionByName(fresh.select("head"))
        rest = state.join(gone, "head", "left_anti").drop("touched").unionByName(fresh)
        state = rest.join(moved.withColumnRenamed("head", "parent"), "parent", "left").withColumn(
            "parent", F.coalesce("survivor", "parent")).drop("survivor")
        state = materialize(state.select("head", "parent", "unit", "depth", "place", "n", "stage",
                                         "min_id", "vector").withColumn("touched", F.lit(wave)))
        left = open_.join(active, "head", "left_anti").join(moved, "head", "left_anti").select("head", "turn", "turn_depth")
        parents = left.unionByName(again).distinct()
        open_ = materialize(state.where("parent is not null").join(
            parents.withColumnRenamed("head", "parent"), "parent")
            .groupBy("unit", F.col("parent").alias("head")).agg(
                F.max("depth").alias("below"), F.max("turn").alias("turn"), F.max("turn_depth").alias("turn_depth")))
        survivors = materialize(
            survivors.join(moved.select(F.col("head").alias("survivor"), F.col("survivor").alias("_next")),
                           "survivor", "left")
            .select("head", F.coalesce("_next", "survivor").alias("survivor")).unionByName(moved))
        wave += 1
    history = histories[0] if histories else spark.createDataFrame([], HISTORY)
    for h in histories[1:]:
        history = history.unionByName(h)
    return survivors, materialize(history)


def _merge_list(pdf: pd.DataFrame, g: dict, wave: int, limits: Limits, **more):
    """`merge_children` on the rows of one parent."""
    return merge_children(g, int(pdf["parent"].iat[0]), float(pdf["parent_stage"].iat[0]), int(pdf["depth"].iat[0]) - 1,
                          (int(pdf["turn"].iat[0]), int(pdf["turn_depth"].iat[0])), wave, limits, **more)


def _certain(lists: DataFrame, limits: Limits, child_rows: int) -> DataFrame:
    """Rows of `lists` whose merges among themselves are the next `most` merges of their parent."""
    batch = max(2, child_rows // 4)
    pairs = _cheapest_by_blocks(lists, limits, child_rows // 2, batch)
    last = pairs.groupBy("parent").agg(F.max(F.struct("distance", "gap", "left_id", "right_id")).alias("last"))
    ends = pairs.select("parent", F.explode(F.array("a", "b")).alias("head")).distinct()
    chosen = materialize(lists.join(ends, ["parent", "head"], "left_semi").join(last, "parent"))
    schema = ("parent long, parent_stage double, step int, until int, distance double, gap double, left_id long, "
              "right_id long, head long, place long, n double, stage double, min_id long, leaf boolean, "
              "child_stage double, vector array<double>")

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, made = pdf.reset_index(drop=True), []
        bound = pdf["last"].iat[0]
        bound = tuple(bound[k] for k in ("distance", "gap", "left_id", "right_id"))
        history, *_ = _merge_list(pdf, as_arrays(pdf), 0, limits, bound=bound, made=made)
        if not history:  # the last digit of a distance may differ between two products; the first pair is certain
            made = []
            history, *_ = _merge_list(pdf, as_arrays(pdf), 0, limits, most=1, made=made)
        if not history:
            return empty_frame(schema)
        past = pd.DataFrame(history, columns=[c.split()[0] for c in HISTORY.split(", ")])
        seen, until = {}, [0] * len(past)
        for k in range(len(past) - 1, -1, -1):  # the step that uses up what step k made
            until[k] = seen.get(past["left_head"][k], len(past) - 1)
            seen[past["left_head"][k]] = seen[past["right_head"][k]] = k
        state = pd.DataFrame({k: [m[k] for m in made] for k in made[0]})
        return state.assign(
            parent=pdf["parent"].iat[0], parent_stage=pdf["parent_stage"].iat[0], step=past["step"], until=until,
            distance=past["cosine_distance"], gap=past["mean_stage_gap"], left_id=past["left_min"],
            right_id=past["right_min"])[[c.split()[0] for c in schema.split(", ")]]

    steps = materialize(chosen.groupBy("parent").applyInPandas(play, schema))
    others = lists.join(ends, ["parent", "head"], "left_anti")
    blocks = materialize(lists.groupBy("parent").agg(F.ceil(F.count("*") / F.lit(child_rows // 2)).alias("_blocks")))
    mine = others.join(blocks, "parent").withColumn("_block", F.pmod(F.xxhash64("head"), F.col("_blocks")))
    many = blocks.select("parent", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    sent = materialize(steps.join(many, "parent"))  # a table of its own, as both sides come from `lists`

    def compare(made: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        if not len(made) or not len(rest):
            return empty_frame("parent long, step int, distance double, gap double, left_id long, right_id long")
        a, b = as_arrays(made), as_arrays(rest)
        costs = pair_costs(a, b, float(made["parent_stage"].iat[0]), limits)
        rows = []
        for k, step in enumerate(made["step"]):
            one = {name: v[k:k + 1] for name, v in a.items()}
            pair = best_pair(costs[k:k + 1], one, b)
            if pair is not None:
                gap, left, right = (x[0] for x in pair_keys(one, b, np.array([0]), np.array([pair[1]])))
                rows.append((made["parent"].iat[0], step, costs[k, pair[1]], gap, left, right))
        return pd.DataFrame(rows, columns=["parent", "step", "distance", "gap", "left_id", "right_id"])

    rivals = (sent.groupBy("parent", "_block").cogroup(mine.groupBy("parent", "_block")).applyInPandas(
        compare, "parent long, step int, distance double, gap double, left_id long, right_id long")
        .groupBy("parent", "step").agg(F.min(F.struct("distance", "gap", "left_id", "right_id")).alias("rival")))
    lives = steps.select("parent", "step", "until").join(rivals, ["parent", "step"]).withColumnsRenamed({"step": "_made"})
    keys = steps.select("parent", "step", F.struct("distance", "gap", "left_id", "right_id").alias("key"))
    overtaken = lives.join(keys, "parent").where(
        (F.col("step") > F.col("_made")) & (F.col("step") <= F.col("until")) & (F.col("rival") < F.col("key"))
    ).groupBy("parent").agg(F.min("step").alias("_first"))
    counts = (steps.groupBy("parent").agg(F.count("*").alias("_all")).join(overtaken, "parent", "left")
              .select("parent", F.coalesce(F.col("_first").cast("long"), "_all").alias("most")))
    return materialize(chosen.join(counts, "parent").drop("last"))


def _cheapest_by_blocks(lists: DataFrame, limits: Limits, block_rows: int, batch: int) -> DataFrame:
    """The `batch` cheapest allowed pairs (a, b) of each parent, searched one block pair per task."""
    sizes = lists.groupBy("parent").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("_blocks"))
    copies = (lists.join(sizes, "parent")
              .withColumn("_own", F.pmod(F.xxhash64("head"), F.col("_blocks")))
              .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
              .withColumn("_low", F.least("_own", "_other")).withColumn("_high", F.greatest("_own", "_other")))
    schema = "parent long, distance double, gap double, left_id long, right_id long, a long, b long"

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["_low"].iat[0] == pdf["_high"].iat[0]
        low, high = pdf[pdf["_own"] == pdf["_low"].iat[0]], pdf[pdf["_own"] == pdf["_high"].iat[0]]
        if not len(low) or not len(high):
            return empty_frame(schema)
        a, b = as_arrays(low), as_arrays(high)
        costs = pair_costs(a, b, float(pdf["parent_stage"].iat[0]), limits)
        if same:
            costs[np.tril_indices(len(costs))] = np.inf
        i, j = np.nonzero(np.isfinite(costs))
        if len(i) > batch:
            cut = np.partition(costs[i, j], batch - 1)[batch - 1]
            i, j = np.nonzero(costs <= cut)
        distance, (gap, left, right) = costs[i, j], pair_keys(a, b, i, j)
        pick = np.lexsort((right, left, gap, distance))[:batch]
        return pd.DataFrame({"parent": pdf["parent"].iat[0], "distance": distance[pick], "gap": gap[pick],
                             "left_id": left[pick], "right_id": right[pick], "a": a["head"][i[pick]], "b": b["head"][j[pick]]},
                            columns=[c.split()[0] for c in schema.split(", ")])

    found = copies.groupBy("parent", "_low", "_high").applyInPandas(search, schema)
    order = Window.partitionBy("parent").orderBy("distance", "gap", "left_id", "right_id")
    return materialize(found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= batch).drop("_rank"))


def merge_members(groups: DataFrame, history: DataFrame) -> DataFrame:
    """Member lists of every merge: one row (merge_order, side, node_id) per node.

    `groups` (node_id, head_id) is the partition before the merges; `side` is "left", "right" or "parent".
    Where a group went is closed by pointer doubling, so the rounds are the logarithm of the longest chain.
    """
    history = materialize(history.select("merge_order", "parent_head", "left_head", "right_head"))
    hop = history.select(F.col("right_head").alias("head"), F.col("left_head").alias("holder"),
                         F.col("merge_order").alias("since"))
    known, jump = materialize(hop), materialize(hop.select("head", F.col("holder").alias("far")))
    while not is_empty(jump):
        longer = jump.join(known.select(F.col("head").alias("far"), "holder", "since"), "far").select("head", "holder", "since")
        further = jump.join(jump.select(F.col("head").alias("far"), F.col("far").alias("_next")), "far")
        known = materialize(known.unionByName(longer))
        jump = materialize(further.select("head", F.col("_next").alias("far")))
    own = groups.select(F.col("head_id").alias("head")).distinct().select(
        "head", F.col("head").alias("holder"), F.lit(0).cast("long").alias("since"))
    sides = history.select("merge_order", F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(f"{side}_head").alias("holder")) for side in ("left", "right", "parent")
    ])).alias("_s")).select("merge_order", "_s.side", "_s.holder")
    held = sides.join(known.unionByName(own), "holder").where(F.col("since") < F.col("merge_order"))
    return held.join(groups.select("node_id", F.col("head_id").alias("head")), "head").select("merge_order", "side", "node_id")
