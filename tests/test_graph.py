"""Neighbours, propagation, parents, components and communities: both ways of running agree."""

import signal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora.core import ContractError, materialize
from arbora.operators import contract, diagnostics, markov, neighbors, propagate, states, tree
from arbora.operators.neighbors import bounded_adjacency, local_scales, nearest, undirected
from arbora.operators.propagate import follow_parents, spread


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(60), "lineage": np.where(np.arange(60) < 45, "big", "small"),
                        "stage": rng.integers(0, 30, 60) / 2.0, "embedding": rng.standard_normal((60, 6)).tolist()})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_nearest_matches_brute_force(vectors, block_rows):
    pdf, df = vectors
    got = nearest(df, 5, earlier=True, block_rows=block_rows).toPandas()
    for _, part in pdf.groupby("lineage"):
        z = np.stack(part.embedding)
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        ids, stage = part.id.to_numpy(), part.stage.to_numpy()
        sims = np.round(z @ z.T, 12)
        for i, node in enumerate(ids):
            order = sorted((-sims[i, j], ids[j]) for j in range(len(ids)) if j != i)
            mine = got[(got.id == node) & (got["rank"] > 0)].sort_values("rank")
            assert mine.other.tolist() == [x[1] for x in order[:5]]
            past = sorted((-sims[i, j], ids[j]) for j in range(len(ids)) if stage[j] < stage[i])
            first = got[(got.id == node) & (got["rank"] == 0)]
            assert first.other.tolist() == [p[1] for p in past[:1]]


def test_duplicates_never_lose_a_neighbour(spark):
    df = spark.createDataFrame([(i, "a", [1.0, 0.0]) for i in range(4)] + [(9, "a", [0.0, 1.0])], "id long, lineage string, embedding array<double>")
    got = nearest(df, 3).toPandas()
    assert not (got.id == got.other).any()
    assert sorted(got[got.id == 2].other) == [0, 1, 3]
    assert local_scales(nearest(df, 3)).toPandas().set_index("id").local_scale[0] == 1e-6


def test_best_matches_are_the_best_columns():
    rng = np.random.default_rng(3)
    scores = np.round(rng.uniform(-1, 1, (40, 700)), 2) + rng.choice([0, 1e-14], (40, 700))
    scores[rng.random(scores.shape) < .01] = -np.inf
    scores[0, 3:] = -np.inf
    plain = np.where(np.isfinite(scores), np.round(scores, 12), -np.inf)
    for k in (1, 5, 10, 900):
        r, c, value = neighbors.best_matches(scores, k)
        rows, columns = neighbors.best_columns(plain, k)
        assert (r == rows).all() and (c == columns).all() and (value == plain[r, c]).all()


def test_best_of_the_earlier_columns():
    rng = np.random.default_rng(4)
    scores = np.round(rng.uniform(-1, 1, (30, 200)), 1) + rng.choice([0, 1e-14], (30, 200))
    scores[rng.random(scores.shape) < .05] = -np.inf
    ids, ends = rng.permutation(200), rng.integers(0, 200, 30)
    ends[:2] = 0, 200
    r, c, value = neighbors.best_of_first(scores, ends, ids)
    plain = np.round(scores, 12)
    want = [(i, min((-plain[i, j], ids[j], j) for j in range(e) if np.isfinite(plain[i, j]))[2]) for i, e in enumerate(ends)
            if np.isfinite(plain[i, :e]).any()]
    assert list(zip(r, c)) == want and (value == plain[r, c]).all()
    rows, columns, _ = neighbors.best_matches(scores, 3, ids)
    for i in range(30):
        order = sorted((-plain[i, j], ids[j], j) for j in range(200) if np.isfinite(plain[i, j]))
        assert columns[rows == i].tolist() == [x[2] for x in order[:3]]


def test_block_pairs_have_partitions_of_their_own(vectors):
    """As many partitions as block pairs, so that the longest task does not grow with the square of the input."""
    _, df = vectors
    pairs = neighbors.block_pairs(df, "lineage", 3)
    assert pairs.rdd.getNumPartitions() >= pairs.select("lineage", "_low", "_high").distinct().count() > 40


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_within_matches_brute_force(vectors, block_rows):
    pdf, df = vectors
    got = neighbors.within(df.withColumn("reach", F.lit(.2) + F.col("id") % 5 / 10).drop("stage"), "reach", block_rows=block_rows)
    want = set()
    for _, part in pdf.groupby("lineage"):
        z = np.stack(part.embedding)
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        sims, ids = np.round(z @ z.T, 12), part.id.to_numpy()
        want |= {(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if a != b and 1 - sims[i, j] <= .2 + a % 5 / 10}
    assert len(want) > 100 and sorted((r.id, r.other) for r in got.collect()) == sorted(want)


def test_single_member_has_no_neighbours(spark):
    df = spark.createDataFrame([(1, "a", [1.0])], "id long, lineage string, embedding array<double>")
    assert nearest(df, 3).count() == 0


def test_mutual_adjacency_is_a_subset(vectors):
    _, df = vectors
    near = nearest(df, 4)
    loose = bounded_adjacency(near, 1.5).select("left_id", "right_id")
    tight = bounded_adjacency(near, 1.5, mutual=True).select("left_id", "right_id")
    assert tight.exceptAll(loose).isEmpty()
    assert undirected(near).where("knn_memberships not in (1, 2)").isEmpty()


def edges_frame(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], "piece string, source long, target long, share double")


@pytest.mark.parametrize("small", [0, 10**6])
def test_spread_diamond(spark, small):
    edges = edges_frame(spark, [(0, 1, .25), (0, 2, .75), (1, 3, 1.0), (2, 3, 1.0)])
    seeds = spark.createDataFrame([("p", 0, 1.0)], "piece string, node long, mass double")
    got = {r.node: r.mass for r in spread(seeds, edges, small_edges=small).collect()}
    assert got == {0: 1.0, 1: .25, 2: .75, 3: 1.0}


def test_spread_both_ways_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b), float(rng.random())) for a in range(40) for b in rng.choice(np.arange(a + 1, 60), 3, replace=False)]
    edges = edges_frame(spark, rows)
    seeds = spark.createDataFrame([("p", i, i % 2, 1.0, float(i)) for i in range(5)], "piece string, node long, tag long, mass double, low double")
    a, b = (spread(seeds, edges, ["tag"], ["mass"], ["low"], small_edges=s).toPandas().sort_values(["node", "tag"], ignore_index=True)
            for s in (0, 10**6))
    assert len(a) == len(b) and np.allclose(a[["node", "tag", "mass", "low"]], b[["node", "tag", "mass", "low"]])


def test_spread_by_bands_agrees_and_makes_no_hops(spark, monkeypatch):
    """A path as long as the graph takes as many rounds as there are bands; tags go into buckets."""
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), float(rng.random()), float(a // 2), float(b // 2)) for a in range(58)
            for b in rng.choice(np.arange(a + 2 - a % 2, 62), 2, replace=False)]
    edges = spark.createDataFrame([("p", *r) for r in rows], "piece string, source long, target long, share double, at double, to double")
    seeds = spark.createDataFrame([("p", i, i % 5, 1.0, float(i), float(i // 2)) for i in range(9)],
                                  "piece string, node long, tag long, mass double, low double, at double")
    a = spread(seeds, edges, ["tag"], ["mass"], ["low"])
    monkeypatch.setattr(propagate, "_spread_hops", None)
    monkeypatch.setattr(propagate, "BUCKET_TAGS", 2)
    b = spread(seeds, edges, ["tag"], ["mass"], ["low"], small_edges=0, band_edges=25)
    a, b = (x.toPandas().sort_values(["node", "tag"], ignore_index=True) for x in (a, b))
    assert len(a) == len(b) and np.allclose(a[["node", "tag", "mass", "low"]], b[["node", "tag", "mass", "low"]])


def test_an_edge_to_a_smaller_number_keeps_the_hops(spark):
    edges = spark.createDataFrame([("p", 0, 1, 1.0, 0.0, 5.0), ("p", 1, 2, .5, 5.0, 1.0), ("p", 2, 3, 1.0, 1.0, 7.0)],
                                  "piece string, source long, target long, share double, at double, to double")
    seeds = spark.createDataFrame([("p", 0, 1.0, 0.0)], "piece string, node long, mass double, at double")
    got = {r.node: r.mass for r in spread(seeds, edges, small_edges=0, band_edges=1).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: .5, 3: .5}


def own_tree(spark, n=80):
    """Written nodes and edges of a tree of two lineages under virtual roots."""
    rng = np.random.default_rng(7)
    kind, stage = ["temporal_node"] * n + ["lineage_root"] * 2 + ["global_root"], [*np.sort(rng.uniform(0, 20, n)), -1.0, -1.0, -2.0]
    lineage = [f"l{i % 2}" for i in range(n + 2)] + ["Global"]
    parent = {i: i % 2 + 2 * int(rng.integers(max(0, i // 2 - 6), i // 2)) if i > 1 else n + i for i in range(n)} | {n: n + 2, n + 1: n + 2}
    nodes = [(i, lineage[i], kind[i], float(stage[i]), float(stage[i])) for i in range(n + 3)]
    edges = [(p, c, lineage[c], float(stage[p]), float(stage[c])) for c, p in parent.items()]
    return (materialize(spark.createDataFrame(nodes, "node_id long, lineage string, node_type string, tree_stage double, cell_weighted_mean_stage double")),
            materialize(spark.createDataFrame(edges, "parent_id long, child_id long, lineage string, parent_stage double, child_stage double")))


@pytest.mark.parametrize("layout", [tree.stage_layout, tree.tidy_layout])
def test_layouts_of_large_trees_make_no_hops(spark, monkeypatch, layout):
    nodes, edges = own_tree(spark)
    a = layout(nodes, edges)
    monkeypatch.setattr(propagate, "_spread_hops", None)
    b = layout(nodes, edges, small_edges=0, band_edges=30)
    a, b = (x.toPandas().sort_values("node_id") for x in (a, b))
    assert a.tree_x.notna().all() and np.allclose(a.tree_x, b.tree_x)


def test_joins_by_node_are_not_broadcast(spark):
    nodes, edges = own_tree(spark)
    ids = nodes.select("node_id")
    for df in (tree.degrees(ids, edges), tree.real_edges(nodes, edges), diagnostics.edge_gaps(nodes, edges),
               diagnostics.terminals(nodes.withColumn("n_cells", F.lit(1)), edges), contract.anchors(ids, edges), contract.chains(ids, edges),
               markov.sinks(nodes, edges.withColumnRenamed("parent_id", "source_id"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [0, 10**6])
def test_follow_parents(spark, small):
    rng = np.random.default_rng(3)
    parent = {i: (None if i < 2 else int(rng.integers(0, i))) for i in range(80)}
    parent.update({100 + i: (99 + i if i else None) for i in range(40)})  # a long path
    df = spark.createDataFrame([(k, v, float(k)) for k, v in parent.items()], "node long, parent long, x double")
    got = follow_parents(df, F.col("x"), small).toPandas().set_index("node")
    for node in parent:
        at, depth, total = node, 0, 0.0
        while parent[at] is not None:
            total, depth, at = total + at, depth + 1, parent[at]
        assert tuple(got.loc[node, ["root", "depth", "total"]]) == (at, depth, total)


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, small):
    nodes = spark.createDataFrame([(i,) for i in range(30)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(12, 20), (20, 15)], "left_id long, right_id long")
    got = {r.node: r.part for r in states.components(nodes, edges, small).collect()}
    assert all(got[i] == 0 for i in range(10)) and got[12] == got[20] == got[15] == 12 and got[29] == 29


def test_communities_both_ways_agree(spark):
    rng = np.random.default_rng(4)
    rows = []
    for a in range(24):
        for b in range(a + 1, 24):
            if a // 8 == b // 8 or rng.random() < .05:
                rows.append(("x", a, b, 1.0 if a // 8 == b // 8 else .2))
    edges = spark.createDataFrame(rows, "lineage string, left_id long, right_id long, weight double")
    members = spark.createDataFrame([(i, "x") for i in range(24)], "id long, lineage string")
    small = states.communities(members, edges, 1.0, iterations=1)
    large = states.communities(members, edges, 1.0, iterations=1, small_edges=0)
    assert small.exceptAll(large).isEmpty()
    found = small.toPandas().set_index("node").community
    assert all(found[8 * g:8 * g + 7].nunique() == 1 for g in range(3)) and found.nunique() == 3
    assert states.modularity(small, edges).first()["modularity"] > .5
    check = states.settled_check(large, edges, 1.0).first()
    assert (check.n_members, check.n_unsettled, check.n_disconnected) == (24, 0, 0)


def test_communities_of_lineages_that_fit_a_task(spark, monkeypatch):
    """The limit holds for each lineage, and a large lineage goes on in a task once its folded graph fits."""
    rng, rows = np.random.default_rng(7), []
    for name, low, n in (("x", 0, 40), ("y", 100, 40), ("z", 200, 60)):
        rows += [(name, low + a, low + b, 1.0 if a % 5 == b % 5 else .2) for a in range(n) for b in range(a + 1, n)
                 if rng.random() < (.8 if a % 5 == b % 5 else .05)]
    edges = spark.createDataFrame(rows, "lineage string, left_id long, right_id long, weight double")
    members = spark.createDataFrame([(low + i, name) for name, low, n in (("x", 0, 40), ("y", 100, 40), ("z", 200, 60)) for i in range(n)],
                                    "id long, lineage string")
    sizes = {r.lineage: r["count"] for r in edges.groupBy("lineage").count().collect()}
    limit = max(sizes["x"], sizes["y"])
    assert limit < sizes["z"]
    whole = states.communities(members, edges, 1.0, 1)
    used, kept = [], states._one_pass_folded
    monkeypatch.setattr(states, "_one_pass_folded", lambda *held: used.append(1) or kept(*held))
    mixed = states.communities(members, edges, 1.0, 1, small_edges=limit)
    assert used and whole.exceptAll(mixed).isEmpty() and mixed.count() == 140
    monkeypatch.setattr(states, "_communities_joined", None)
    some = states.communities(members.where("lineage < 'z'"), edges.where("lineage < 'z'"), 1.0, 1, small_edges=limit)
    assert some.exceptAll(whole).isEmpty() and some.count() == 80


def test_parts_end_where_ids_are_open_in_the_same_turns(spark):
    """Nodes whose numbers differ by multiples of 1009 share every turn; both ways of refining end and agree."""
    def stop(*_):
        raise TimeoutError("no end")

    ids = 1009 * np.arange(3)
    rows = [(0, 1, 2.0), (1, 0, 2.0), (1, 2, 1.0), (2, 1, 1.0)]
    a, b, w = (np.array(x) for x in zip(*rows))
    k = np.bincount(a, weights=w)
    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(20)
    try:
        got = states._Graph(ids, a, b, w, k, 100.0, 1.0, 0).refine(np.zeros(3, np.int64))
        signal.alarm(600)
        links = spark.createDataFrame([(int(ids[x]), int(ids[y]), z) for x, y, z in rows], "a long, b long, weight double")
        state = spark.createDataFrame([(int(i), "x", float(s), 100.0, 1.0, 0, 0) for i, s in zip(ids, k)],
                                      "node long, lineage string, k double, m2 double, resolution double, seed long, community long")
        joined = {r.node: r.part for r in states._refined(state, links).collect()}
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert joined == {int(i): int(ids[p]) for i, p in zip(ids, got)} and len(set(joined.values())) == 1


@pytest.mark.parametrize("seed", range(6))
def test_no_single_move_raises_modularity(seed):
    """Random weighted graphs with loops: settled, connected, and at least as good as the planted groups."""
    rng = np.random.default_rng(seed)
    n, pairs = 120, {}
    for _ in range(700):
        a, b = sorted(int(x) for x in rng.integers(0, n, 2))
        if a % 6 == b % 6 or rng.random() < .15:
            pairs[a, b] = pairs.get((a, b), 0) + float(rng.random())
    full = np.zeros((n, n))
    for (a, b), w in pairs.items():
        full[a, b] += w
        full[b, a] += w
    a, b = np.nonzero(full)
    got = states._lineage_communities(np.arange(n), a, b, full[a, b], 1.0, 2, seed)
    k, m2 = full.sum(axis=1), full.sum()

    def value(c):
        same = c[:, None] == c[None, :]
        return ((full - np.outer(k, k) / m2) * same).sum()

    for v in range(n):
        for c in {*got.tolist(), n + v}:
            other = got.copy()
            other[v] = c
            assert value(other) <= value(got) + 1e-6
    inside = got[a] == got[b]
    assert (states._parts(n, a[inside], b[inside]) == got).all()
    assert value(got) >= value(np.arange(n) % 6) - 1e-9


def test_lineage_of_two_is_refused(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0])], "id long, lineage string, embedding array<double>")
    with pytest.raises(ContractError):
        states.fuzzy_graph(df, 5)


def node_frame(spark, rows):
    return spark.createDataFrame([(i, l, s, n, v) for i, l, s, n, v in rows],
                                 "node_id long, lineage string, stage double, n_cells long, embedding array<double>")


def test_roots_equal_stages_and_fallback(spark):
    nodes = node_frame(spark, [(0, "a", 1.0, 2, [1., 0., 0.]), (1, "a", 1.5, 6, [0., 1., 0.]), (2, "a", 1.51, 1, [.9, .1, 0.]),
                               (3, "a", 5.0, 1, [0., 0., 1.]), (4, "a", 5.0, 1, [0., .01, 1.]), (5, "b", 3.0, 4, [1., 0., 0.])])
    roots = {r.node_id: r.root_share for r in markov.early_roots(nodes).collect()}
    assert roots == {0: .25, 1: .75, 5: 1.0}
    graph = markov.candidate_graph(nodes, k=1)
    rows = {(r.source_id, r.target_id): r for r in graph.collect()}
    # 3 and 4 are each other's neighbour at the same stage: both fall back to an earlier node.
    assert (3, 4) not in rows and (4, 3) not in rows
    assert all(r.target_id not in (0, 1, 5) for r in rows.values())
    fallback = {k for k, r in rows.items() if r.fallback_edge}
    assert {t for _, t in fallback} == {3, 4}
    assert all(rows[k].knn_memberships == 0 for k in fallback)
    flow = markov.node_flow(markov.early_roots(nodes), graph)
    markov.require_conserved_flow(nodes, graph, flow)
    assert markov.orphans(nodes, graph).isEmpty()


def test_fork_fate_and_entropy(spark):
    nodes = node_frame(spark, [(i, "a", float(i), 1, [1.]) for i in range(3)])
    edges = spark.createDataFrame([(0, 1, "a", .25), (0, 2, "a", .75)], "source_id long, target_id long, lineage string, transition_probability double")
    fate = markov.fates(nodes, edges)
    best = {r.node_id: r for r in markov.node_fates(fate).collect()}
    assert best[0].most_likely_terminal_id == 2 and best[0].fate_entropy == pytest.approx(.5623, abs=1e-4)
    kept = markov.retained_fates(fate, nodes, .9).where("node_id = 0").collect()
    assert [(r.terminal_node_id, r.fate_probability) for r in kept] == [(2, .75)]


def test_fates_by_bands_keep_only_what_is_read(spark):
    """Both ways agree; tables of bands and what was sent to them go, and the result is not written again."""
    from pathlib import Path

    from arbora.core import shared_folder

    rng = np.random.default_rng(8)
    rows = [(a, b, "x", float(a), float(b), float(rng.random())) for a in range(40) for b in range(a + 1, 40)
            if rng.random() < .2 and a % 7]
    edges = spark.createDataFrame(rows, "source_id long, target_id long, lineage string, source_stage double, target_stage double, w double")
    whole = edges.groupBy("source_id").agg(F.sum("w").alias("s"))
    edges = materialize(edges.join(whole, "source_id").withColumn("transition_probability", F.col("w") / F.col("s")))
    nodes = materialize(node_frame(spark, [(i, "x", float(i), 1, [1.0]) for i in range(40)]))
    small = markov.fates(nodes, edges).toPandas().sort_values(["node_id", "terminal_node_id"], ignore_index=True)
    folder = Path(shared_folder(spark)) / f"arbora-{spark.sparkContext.applicationId}"
    before = {p.name for p in folder.iterdir()}
    fate = markov.fates(nodes, edges, small_edges=0, band_edges=25)
    assert materialize(fate) is fate  # it is written as it is
    large = fate.toPandas().sort_values(["node_id", "terminal_node_id"], ignore_index=True)
    assert (small.node_id == large.node_id).all() and (small.terminal_node_id == large.terminal_node_id).all()
    assert np.allclose(small.fate_probability, large.fate_probability, atol=1e-12) and len(small) > 100
    new = [p for p in folder.iterdir() if p.name not in before]
    assert not [q for p in new for q in p.glob("_to=*")]
    held = sum(spark.read.parquet(str(p)).count() for p in new if any(p.glob("*.parquet")) and "fate_probability" in spark.read.parquet(str(p)).columns)
    assert held == len(large)
    assert not [p for p in new if any(p.glob("*.parquet")) and {"terminal", "mass"} <= {*spark.read.parquet(str(p)).columns} - {"_to"} and "_to" not in spark.read.parquet(str(p)).columns]


@pytest.mark.parametrize("lineage", ["a", "b"])
def test_retained_fates_against_their_definition(spark, lineage):
    """Also where an id stands for nodes of two lineages."""
    rows = [(0, 5, .3), (0, 6, .3), (0, 7, .4), (1, 5, .9), (1, 6, .1), (2, 9, .55), (2, 8, .45)] + [(0, 7, .35)] * (lineage == "b")
    fate = spark.createDataFrame(rows, "node_id long, terminal_node_id long, fate_probability double")
    nodes = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (0, lineage)][:3 + (lineage == "b")], "node_id long, lineage string")
    got = sorted((r.node_id, r.terminal_node_id, r.fate_probability, round(r.retained_probability_mass, 9), r.lineage)
                 for r in markov.retained_fates(fate, nodes, .5).collect())
    mine = [(0, 7, .4, .4, "a")] if lineage == "a" else [(0, 7, p, .75, x) for p in (.35, .4) for x in "ab"]
    assert got == sorted([*mine, (1, 5, .9, .9, "a"), (2, 9, .55, .55, "a")])


def test_parent_tie_goes_to_closer_then_lower(spark):
    edges = spark.createDataFrame([(3, 9, .5, 1.0, .2), (2, 9, .5, 1.0, .1), (1, 9, .5, 1.0, .1)],
                                  "source_id long, target_id long, transition_probability double, raw_weight double, cosine_distance double")
    assert markov.best_parents(edges).first()["source_id"] == 1


def test_virtual_ids(spark):
    nodes = node_frame(spark, [(0, "b", 1., 1, [1.]), (1, "a", 2., 1, [1.])])
    got = {(r.lineage, r.node_type): r.node_id for r in tree.virtual_nodes(nodes).collect()}
    assert got == {("a", "lineage_root"): 2, ("b", "lineage_root"): 3, ("Global", "global_root"): 4}
