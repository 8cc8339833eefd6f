"""Path and sibling contraction against plain sequential restatements, and the whole chain of stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.core import ContractError, materialize
from arbora.operators import contract, siblings
from arbora.plans import stages
from arbora.sources import standins


def random_tree(seed, n=90):
    rng = np.random.default_rng(seed)
    stage = np.sort(np.round(rng.uniform(0, 20, n), 2)) + np.arange(n) * 1e-3
    base = rng.standard_normal((4, 5))
    vectors = [base[rng.integers(4)] + .5 * rng.standard_normal(5) for _ in range(n)]
    parent = {i: int(rng.integers(max(0, i - 9), i)) if rng.random() < .9 else max(0, i - 1) for i in range(3, n)}
    rows = [(i, "l", float(stage[i]), int(rng.integers(1, 30)), int(rng.integers(1, 4)), [float(x) for x in vectors[i]]) for i in range(n)]
    return rows, parent


def frames(spark, rows, parent):
    nodes = spark.createDataFrame(rows, "node_id long, lineage string, stage double, n_cells long, n_metacells long, embedding array<double>")
    return nodes, spark.createDataFrame([(p, c) for c, p in parent.items()], "parent_id long, child_id long")


def plain_groups(rows, parent, far, span):
    """Greedy runs along maximal degree-two chains, each with its downstream end."""
    kids = {r[0]: [c for c, p in parent.items() if p == r[0]] for r in rows}
    inner = {i for i in kids if i in parent and len(kids[i]) == 1}
    info = {r[0]: r for r in rows}
    groups, used = [], set()
    for start in sorted(i for i in inner if parent[i] not in inner):
        chain = [start]
        while chain[-1] in inner:
            chain.append(kids[chain[-1]][0])
        used |= set(chain)
        run = []
        for node in chain:
            v = np.array(info[node][5])
            if run:
                total = sum(info[x][3] * np.array(info[x][5]) for x in run)
                gap = 1 - total @ v / np.linalg.norm(total) / np.linalg.norm(v)
                s = [info[x][2] for x in run] + [info[node][2]]
                if max(0, gap) <= far and max(s) - min(s) <= span:
                    run.append(node)
                    continue
                groups.append(run)
            run = [node]
        groups.append(run)
    return groups + [[i] for i in kids if i not in used]


def partition(df, key="head_id"):
    return sorted(sorted(g) for g in df.toPandas().groupby(key).node_id.apply(list))


@pytest.mark.parametrize("chain_rows", [2, 50_000])
def test_path_groups(spark, chain_rows):
    rows, parent = random_tree(6, 70)
    parent.update({70 + i: 69 + i for i in range(12)})  # a long chain below the last node
    rng = np.random.default_rng(0)
    rows += [(70 + i, "l", 21.0 + i, 5, 1, [float(x) for x in np.ones(5) + .4 * rng.standard_normal(5)]) for i in range(12)]
    nodes, edges = frames(spark, rows, parent)
    got = contract.path_groups(nodes, edges, .3, 4.0, chain_rows)
    assert partition(got) == sorted(sorted(g) for g in plain_groups(rows, parent, .3, 4.0))


@pytest.mark.parametrize("chain_rows", [2, 50_000])
def test_short_chains_share_tasks(spark, monkeypatch, chain_rows):
    monkeypatch.setattr(contract, "TASK_ROWS", 25)
    rows, parent = random_tree(8, 90)
    nodes, edges = frames(spark, rows, parent)
    assert contract.chains(nodes, edges).select("chain_id").distinct().count() > 5
    got = contract.path_groups(nodes, edges, .3, 4.0, chain_rows)
    assert partition(got) == sorted(sorted(g) for g in plain_groups(rows, parent, .3, 4.0))


def plain_siblings(rows, parent, groups, far, gap):
    """One merge at a time over the whole tree: deepest parent, then distance, gap and lowest ids."""
    info = {r[0]: r for r in rows}
    groups = sorted([sorted(g) for g in groups], key=lambda g: (min(info[i][2] for i in g), min(g)))
    merges = []
    while True:
        owner = {i: g for g, members in enumerate(groups) for i in members}
        up = {owner[c]: owner[p] for c, p in parent.items() if owner[c] != owner[p]}
        down = {g: sorted(c for c, p in up.items() if p == g) for g in range(len(groups))}

        def depth(g):
            return 0 if g not in up else depth(up[g]) + 1

        n = [sum(info[i][3] for i in g) for g in groups]
        stage = [sum(info[i][2] * info[i][3] for i in g) / n[k] for k, g in enumerate(groups)]
        unit = []
        for k, g in enumerate(groups):
            v = sum(info[i][3] * np.array(info[i][5]) for i in g)
            unit.append(v / np.linalg.norm(v))
        options = []
        for p in down:
            for x, a in enumerate(down[p]):
                for b in down[p][x + 1:]:
                    if down[a] and down[b] or abs(stage[a] - stage[b]) > gap:
                        continue
                    d = max(0, round(1 - float(unit[a] @ unit[b]), 12))
                    s = (n[a] * stage[a] + n[b] * stage[b]) / (n[a] + n[b])
                    if d <= far and s > stage[p] and all(s < stage[c] for c in down[a] + down[b]):
                        options.append((-depth(p), d, abs(stage[a] - stage[b]), min(groups[a]), min(groups[b]), a, b))
        if not options:
            return groups, merges
        *_, a, b = min(options)
        merges.append((sorted(groups[a]), sorted(groups[b]), sorted(groups[up[a]])))
        groups[a] = groups[a] + groups[b]
        del groups[b]


def histories_agree(single, history, merges):
    """Same merges in the same order with the same members."""
    lists = {}
    for r in siblings.merge_members(single, history).collect():
        lists.setdefault((r.merge_order, r.side), []).append(r.node_id)
    sides = ("left", "right", "parent")
    return {k: sorted(v) for k, v in lists.items()} == {(k, s): m[i] for k, m in enumerate(merges, 1) for i, s in enumerate(sides)}


@pytest.mark.parametrize("how", [{}, {"small_groups": 0}, {"small_groups": 0, "child_rows": 4}, {"small_groups": 0, "child_rows": 12}])
def test_sibling_merges(spark, how):
    rows, parent = random_tree(10, 50)
    nodes, edges = frames(spark, rows, parent)
    single = materialize(nodes.select("node_id", F.col("node_id").alias("head_id")))
    want, merges = plain_siblings(rows, parent, [[r[0]] for r in rows], .7, 4.0)
    assert len(merges) > 5
    got, history = siblings.merge_siblings(nodes, single, edges, .7, 4.0, **how)
    assert partition(got) == sorted(sorted(g) for g in want)
    assert sorted(r.merge_order for r in history.collect()) == list(range(1, len(merges) + 1))
    assert histories_agree(single, history, merges)


@pytest.mark.parametrize("seed", [8, 9, 10])
def test_sibling_merges_more_trees(spark, seed):
    rows, parent = random_tree(seed, 100)
    nodes, edges = frames(spark, rows, parent)
    single = materialize(nodes.select("node_id", F.col("node_id").alias("head_id")))
    want, merges = plain_siblings(rows, parent, [[r[0]] for r in rows], .7, 4.0)
    got, history = siblings.merge_siblings(nodes, single, edges, .7, 4.0)
    assert history.count() == len(merges) and partition(got) == sorted(sorted(g) for g in want)
    assert histories_agree(single, history, merges)


@pytest.mark.parametrize("seed, child_rows", [(1, 16)])
def test_sibling_merges_of_many_children(spark, seed, child_rows):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((7, 5))
    vectors = base[rng.integers(0, 7, 28)] + rng.standard_normal((28, 5)) * .25
    parent = {i: 0 if i <= 22 else int(rng.integers(1, 6)) for i in range(1, 29)}
    rows = [(0, "l", 0.0, 9, 1, [1.0] * 5)]
    rows += [(i, "l", (1.0 if i <= 22 else 4.0) + float(rng.random()), int(rng.integers(1, 9)), 1, [float(x) for x in v])
             for i, v in enumerate(vectors, 1)]
    nodes, edges = frames(spark, rows, parent)
    single = materialize(nodes.select("node_id", F.col("node_id").alias("head_id")))
    want, merges = plain_siblings(rows, parent, [[r[0]] for r in rows], .3, .6)
    assert len(merges) > 7
    got, history = siblings.merge_siblings(nodes, single, edges, .3, .6, small_groups=0, child_rows=child_rows)
    assert partition(got) == sorted(sorted(g) for g in want)
    assert histories_agree(single, history, merges)


@pytest.mark.parametrize("less", [0, 1])
def test_only_large_trees_go_by_rounds(spark, monkeypatch, less):
    """A forest larger than the limit whose trees are not larger takes no rounds; its largest tree alone does otherwise."""
    rows, parent = random_tree(10, 50)
    root = {i: i for i in range(3)}
    for i in range(3, 50):
        root[i] = root[parent[i]]
    largest = max(list(root.values()).count(r) for r in range(3))
    nodes, edges = frames(spark, rows, parent)
    single = materialize(nodes.select("node_id", F.col("node_id").alias("head_id")))
    want, merges = plain_siblings(rows, parent, [[r[0]] for r in rows], .7, 4.0)
    seen, by_rounds = [], siblings._merge_rounds
    monkeypatch.setattr(siblings, "_merge_rounds", lambda state, *more: (seen.append(state.count()), by_rounds(state, *more))[1])
    got, history = siblings.merge_siblings(nodes, single, edges, .7, 4.0, small_groups=largest - less)
    assert largest < 50 and seen == [largest] * less
    assert partition(got) == sorted(sorted(g) for g in want)
    assert histories_agree(single, history, merges)


def test_chain_stops_at_span_inclusive(spark):
    v = [1.0, 0.0, 0.0, 0.0, 0.0]
    rows = [(i, "l", float(i), 1, 1, v) for i in range(5)]
    nodes, edges = frames(spark, rows, {1: 0, 2: 1, 3: 2, 4: 3})
    assert partition(contract.path_groups(nodes, edges, .1, 3.0)) == [[0], [1, 2, 3, 4]]
    assert partition(contract.path_groups(nodes, edges, .1, 2.9)) == [[0], [1, 2, 3], [4]]


def test_two_parents_are_refused(spark):
    edges = spark.createDataFrame([(0, 2), (1, 2)], "parent_id long, child_id long")
    with pytest.raises(ContractError):
        contract.require_single_parents(edges)


@pytest.mark.parametrize("merge", [False, True])
def test_tree_and_contraction_end_to_end(spark, data, merge):
    nodes = standins.nodes_from_embeddings(spark, data).drop("celltype")
    built = stages.build_tree(nodes, stage_column="stage")
    t, e = built["tree_nodes"], built["tree_edges"]
    n_real, lineages = nodes.count(), nodes.select("lineage").distinct().count()
    assert e.count() == n_real + lineages + 1 - 1
    assert t.where("tree_x is null").isEmpty()
    assert built["candidate_markov_edges"].where("selected_tree_edge").count() == e.where("not virtual_edge").count()
    labels = nodes.select("node_id", F.lit("x").alias("celltype"), F.col("n_cells").alias("cell_count"))
    done = stages.contract_tree(t, e, labels, stages.ContractOptions(.85, 6.0, merge, .85, 3.0))
    row = done["contraction_summary"].first()
    assert row.n_source_nodes - row.removed_by_paths - row.removed_by_siblings - row.removed_by_second_paths == row.n_contracted_nodes
    assert done["tree_edges"].count() == row.n_contracted_nodes + lineages
    assert done["tree_nodes"].where("tree_x is null").isEmpty()
    order = done["tree_nodes"].where("node_type <> 'temporal_node'").orderBy("node_id").select("node_type").collect()
    assert order[0][0] == "global_root"
    if merge:
        assert done["sibling_merge_history"].count() == row.removed_by_siblings


def test_cells_to_nodes_end_to_end(spark, data):
    cells = standins.cells_from_embeddings(spark, data)
    options = stages.GroupingOptions(target_size=6, min_size=3, max_size=12, k=8, pile_size=100, bin_width=5.5)
    notes = cells.select(F.col("cell_index").cast("string").alias("cell"), "celltype")
    one = stages.group_cells(cells.drop("celltype").withColumn("cell_id", F.col("cell_index").cast("string")), notes, options)
    micro = one["microcells"]
    assert micro.agg(F.sum("n_cells")).first()[0] == cells.count()
    row = one["grouping_summary"].first()
    assert row.total_cells == cells.count() and row.n_microcells == micro.count()
    for split in ("fixed", "kde"):
        two = stages.find_nodes(micro, one["microcell_celltype_composition"], stages.StateOptions(
            k=6, resolution=1.0, split=split, min_cells=3, bin_width=4.0))
        nodes = two["nodes"]
        ids = [r.node_id for r in nodes.orderBy("node_id").collect()]
        assert ids == list(range(len(ids)))
        kept = nodes.agg(F.sum("n_cells")).first()[0]
        dropped = two["filtered_small_nodes"].agg(F.coalesce(F.sum("n_cells"), F.lit(0))).first()[0]
        assert kept + dropped == cells.count()
        assert two["microcell_node_assignments"].count() == micro.count()
