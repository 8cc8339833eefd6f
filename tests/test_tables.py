"""Purity, sampling, display, readers, writers, streaming export, diffusion map and decoder."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora.core import ContractError
from arbora.functions import scalars
from arbora.functions.vectors import dimension, require_vectors, subset_dimensions, weighted_dimensions
from arbora.operators import composition, decoder, diffusion, display, export, layout, potential, sampling
from arbora.sinks import writers
from arbora.sources import readers
from arbora.sources.npy import NpyDataSource
from arbora.streaming.export import cell_stream, export_stream


def test_purity_with_unknowns(spark):
    groups = spark.createDataFrame([(0, 8, "l"), (1, 2, "l")], "microcell_id long, n_cells long, lineage string")
    comp = spark.createDataFrame([(0, "A", 3), (0, " unknown ", 2), (0, "", 1)], "microcell_id long, celltype string, cell_count long")
    rows = {r.microcell_id: r for r in composition.evaluate_purity(groups, comp).collect()}
    r = rows[0]
    assert (r.known_cells, r.unknown_cells, r.unmatched_cells, r.purity, r.dominant_fraction_all_cells) == (3, 3, 2, 1.0, .375)
    assert rows[1].purity is None and rows[1].dominant_known_celltype == "(no known annotation)"
    summary = composition.purity_summary(composition.evaluate_purity(groups, comp)).first()
    assert summary.evaluable_groups == 1 and summary.known_cell_weighted_purity == 1.0


@pytest.mark.parametrize("groups,comp", [
    ([(0, 2, "l")], [(0, "A", 3)]), ([(0, 2, "l"), (0, 2, "l")], [(0, "A", 1)]), ([(0, 0, "l")], []),
    ([(0, 2, "l")], [(5, "A", 1)])])
def test_purity_refuses(spark, groups, comp):
    with pytest.raises(ContractError):
        composition.evaluate_purity(spark.createDataFrame(groups, "microcell_id long, n_cells long, lineage string"),
                                    spark.createDataFrame(comp, "microcell_id long, celltype string, cell_count long"))


def test_composition_tie(spark):
    df = spark.createDataFrame([(0, "B", 2), (0, "A", 2)], "node_id long, celltype string, n long")
    got = {r.celltype: r["rank"] for r in composition.composition(df, "node_id", amount="n").collect()}
    assert got == {"A": 1, "B": 2}


def test_sample_caps(spark):
    df = spark.createDataFrame([(i, 0 if i < 2 else 1) for i in range(12)], "cell_index long, node_id long")
    got = sampling.capped_sample(df, 5)
    assert {r.node_id: r["count"] for r in got.groupBy("node_id").count().collect()} == {0: 2, 1: 5}
    assert sampling.require_filled(got, df, 5) and not sampling.require_filled(got.where("node_id = 0"), df, 5)
    assert got.exceptAll(sampling.capped_sample(df.repartition(6), 5)).isEmpty()


def test_sampling_order_looks_random(spark):
    ids = spark.range(2000).withColumnRenamed("id", "cell_index")
    got = np.array([r[0] for r in sampling.simple_sample(ids, 500, "cell_index").collect()])
    assert abs(got.mean() - 1000) < 80 and abs(np.corrcoef(got[:-1], got[1:])[0, 1]) < .2
    assert len(np.unique(got // 100)) == 20


def test_number_text(spark):
    values = [0.0, 1.0, -2.5, 100000.0, 1234567.0, 0.0001, 0.00001, 1e-7, 12.3456789, 1e21, 0.1 + 0.2, -0.75]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(scalars.general_number(F.col("v"))).collect()] == ["%g" % v for v in values]
    assert df.select(scalars.weight_label(F.lit(-0.5))).first()[0] == "m0p5"


def test_colors(spark):
    import colorsys
    got = [r[0] for r in spark.range(12).orderBy("id").select(display.golden_color(F.col("id"))).collect()]
    for i, text in enumerate(got):
        rgb = colorsys.hsv_to_rgb((i * display.GOLDEN) % 1, display.SATURATIONS[i % 3], display.BRIGHTNESSES[i // 3 % 3])
        assert text == "#" + "".join(f"{round(c * 255):02X}" for c in rgb)
    groups = spark.createDataFrame([("a", 5), ("b", 9), ("Mixed", 1), ("c", 2)], "label string, n_cells long")
    saved = spark.createDataFrame([("c", got[0])], "label string, color string")
    colors = {r.label: r.color for r in display.label_colors(groups, "label", known=saved).collect()}
    assert colors == {"b": got[1], "a": got[2], "Mixed": display.MIXED_COLOR, "c": got[0]}


def test_vector_checks(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],)], "v array<double>")
    assert dimension(df, "v") == 2 and require_vectors(df, "v", nonzero=False) == 2
    with pytest.raises(ContractError):
        require_vectors(df, "v")
    with pytest.raises(ContractError):
        subset_dimensions("v", [1, 1])
    with pytest.raises(ContractError):
        weighted_dimensions("v", [2], 1.0, 2)


CELLS = [(0, "a"), (1, "b"), (2, "c")]


def stage_csv(folder, rows, name="p.csv"):
    path = folder / name
    path.write_text("cell_id,idx,extra,predicted_stage\n" + "".join(f"{c},{i},x,{s}\n" for i, c, s in rows))
    return str(path)


def test_predicted_stage_in_any_order(spark, tmp_path):
    cells = spark.createDataFrame(CELLS, "cell_index long, cell_id string")
    table = readers.read_predicted_stage(spark, stage_csv(tmp_path, [(2, "c", 3.5), (0, "a", 1.5), (1, "b", 2.5)]))
    got = readers.attach_predicted_stage(cells, table).orderBy("cell_index").collect()
    assert [r.stage for r in got] == [1.5, 2.5, 3.5]


@pytest.mark.parametrize("rows,why", [
    ([(0, "a", 1), (0, "a", 1), (1, "b", 1), (2, "c", 1)], "duplicate_idx"),
    ([(0, "a", 1), (1, "b", 1), (2, "c", 1), (3, "d", 1)], "idx_out_of_range"),
    ([(0, "a", 1), (1, "x", 1), (2, "c", 1)], "cell_id_mismatch"),
    ([(0, "a", 1), (1, "b", "nan"), (2, "c", 1)], "not_finite"), ([(0, "a", 1), (1, "b", 1)], "missing_cells")])
def test_predicted_stage_errors(spark, tmp_path, rows, why):
    cells = spark.createDataFrame(CELLS, "cell_index long, cell_id string")
    with pytest.raises(ContractError, match=why):
        readers.attach_predicted_stage(cells, readers.read_predicted_stage(spark, stage_csv(tmp_path, rows)))


def test_annotation_strings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cell,celltype\na,NA\nb,\nc,T cell\nd,null\n")
    names = {r.cell: r.celltype for r in readers.read_annotations(spark, str(tmp_path / "a.csv")).collect()}
    assert names == {"a": "Unknown", "b": "Unknown", "c": "T cell", "d": "Unknown"}
    kept = {r.cell_id: r.celltype for r in readers.read_literal_annotations(spark, str(tmp_path / "a.csv")).collect()}
    assert kept["a"] == "NA" and kept["d"] == "null"


def test_dictionary_and_genes(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"lineages": ["x", "y"], "stages": [1.5, 2.0]}, indent=1))
    lineages = readers.read_dictionary(spark, str(tmp_path / "m.json"), "lineages")
    cells = spark.createDataFrame([(0, 1), (1, 0)], "cell_index long, lineage_id int")
    got = readers.decode_dictionary(cells, "lineage_id", lineages, "lineage").orderBy("cell_index").collect()
    assert [r.lineage for r in got] == ["y", "x"]
    with pytest.raises(ContractError):
        readers.decode_dictionary(spark.createDataFrame([(5,)], "lineage_id int"), "lineage_id", lineages, "lineage")
    (tmp_path / "g.txt").write_text("A\n\nB\n")
    assert [r.gene for r in readers.read_gene_names(spark, str(tmp_path / "g.txt"), 2).orderBy("position").collect()] == ["A", "B"]
    with pytest.raises(ContractError):
        readers.read_gene_names(spark, str(tmp_path / "g.txt"), 3)
    assert readers.read_gene_names(spark, None, 2).count() == 2


def test_true_stage_is_complete_or_refused(spark):
    cells = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "cell_index long, microcell_id long")
    sizes = spark.createDataFrame([(0, 2), (1, 1)], "microcell_id long, n_cells long")
    stages = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 5.0)], "idx long, true_stage double")
    assert {r[0]: r[1] for r in readers.true_stage(cells, stages, sizes).collect()} == {0: 2.0, 1: 5.0}
    for bad in (stages.where("idx <> 1"), stages.withColumn("true_stage", F.when(F.col("idx") > 0, F.col("true_stage")))):
        with pytest.raises(ContractError):
            readers.true_stage(cells, bad, sizes)


def test_npy_source(spark, tmp_path):
    spark.dataSource.register(NpyDataSource)
    x = np.arange(60, dtype=np.float32).reshape(20, 3)
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "ids.npy", np.array([f"c{i}" for i in range(20)]))
    np.save(tmp_path / "k.npy", np.arange(20, dtype=np.int32))
    got = spark.read.format("npy").option("rowsPerSlice", 6).load(str(tmp_path / "x.npy"))
    assert got.rdd.getNumPartitions() == 4
    assert np.allclose(np.stack(got.orderBy("row_index").toPandas().value), x)
    ids = spark.read.format("npy").load(str(tmp_path / "ids.npy"))
    assert ids.where("value = concat('c', row_index)").count() == 20
    assert spark.read.format("npy").load(str(tmp_path / "k.npy")).agg(F.sum("value")).first()[0] == 190


def test_publish_once_and_resolve(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "a long, b array<long>")
    inner, outer = str(tmp_path / "inner"), str(tmp_path / "outer")
    writers.publish(spark, inner, {"t": df}, {"input": "raw"})
    writers.publish(spark, outer, {"t": df}, {"node_dir": inner})
    assert writers.resolve_inputs(spark, outer, "node_dir", "input") == [inner, "raw"]
    with pytest.raises(ContractError):
        writers.publish(spark, inner, {"t": df})
    writers.publish(spark, inner, {"t": df.union(df)}, {"k": 1}, overwrite=True)
    assert spark.read.parquet(f"{inner}/t.parquet").count() == 2
    assert writers.reusable(spark, inner, {"k": 1}) and not writers.reusable(spark, inner, {"k": 2})
    writers.write_csv(df, str(tmp_path / "c.csv"))
    assert spark.read.csv(str(tmp_path / "c.csv"), header=True, quote='"', escape='"').first()["b"] == "[1,2]"
    assert writers.write_summary(df.select("a"), str(tmp_path / "s.json"), kind="x") == {"a": 1, "kind": "x"}


def test_stream_equals_batch(spark, tmp_path, data):
    cells = spark.read.parquet(f"{data}/events.parquet").select(
        F.col("event_id").alias("cell_index"), F.col("user_id").alias("microcell_id"))
    cells.repartition(5).write.parquet(str(tmp_path / "cells"))
    assigned = cells.select("microcell_id").distinct().withColumn("node_id", F.col("microcell_id") % 4 - 1)
    sources = spark.createDataFrame([(0, 7), (1, 7), (2, 8)], "source_node_id long, contracted_node_id long")
    mapping = export.microcell_mapping(assigned, sources)
    export_stream(cell_stream(spark, str(tmp_path / "cells"), cells.schema, 2), mapping, str(tmp_path / "out"))
    batch = export.node_cells(cells, mapping)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert streamed.count() == batch.count() > 0 and streamed.exceptAll(batch).isEmpty()
    counts = export.export_counts(cells, mapping).first()
    assert counts.exported_cells == batch.count() and counts.exported_cells + counts.excluded_cells == cells.count()
    assert export.node_cells(cells, mapping, [8]).select("contracted_node_id").distinct().count() == 1
    with pytest.raises(ContractError):
        export.node_cells(cells, mapping, [99])


def test_diffusion_map_against_dense(spark):
    rng = np.random.default_rng(6)
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(60), "embedding": rng.standard_normal((60, 4)).tolist()}))
    graph = diffusion.transition_matrix(diffusion.gaussian_graph(points, 8)).toPandas()
    full = np.zeros((60, 60))
    full[graph.a, graph.b] = graph.t
    values, vectors = np.linalg.eigh(full)
    found, got = diffusion.diffusion_map(points, 3, 8)
    theta = got.orderBy("component").toPandas().eigenvalue.to_numpy()
    assert theta[0] == pytest.approx(1.0) and np.allclose(theta, values[::-1][:3], atol=1e-8)
    one = found.toPandas().pivot(index="id", columns="component", values="value").to_numpy()
    for c in range(3):
        assert abs(abs(one[:, c] @ vectors[:, -1 - c]) - 1) < 1e-5


def test_diffusion_map_of_three_parts(spark):
    """Eigenvalue one occurs as often as the graph has parts; points fewer than the block is wide are solved whole."""
    rng = np.random.default_rng(2)
    x = np.vstack([c + .01 * rng.standard_normal((12, 6)) for c in 3 * np.eye(6)[:3]])
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(36), "embedding": x.tolist()}))
    found, values = diffusion.diffusion_map(points, 5, 6)
    theta = values.orderBy("component").toPandas().eigenvalue.to_numpy()
    assert np.allclose(theta[:3], 1.0, atol=1e-9) and theta[3] < 0.999
    checked = diffusion.residual_check(diffusion.transition_matrix(diffusion.gaussian_graph(points, 6)), found, values).toPandas()
    assert (checked.residual < 1e-5).all() and (checked.overlap < 1e-8).all() and np.allclose(checked["size"], 1)
    few = diffusion.diffusion_map(points.where("id < 8"), 3, 6)[1].orderBy("component").toPandas().eigenvalue
    assert few[0] == pytest.approx(1.0) and len(few) == 3


def test_blocks_write_and_send_within_bounds(spark, monkeypatch):
    """Long chains are cut into jobs with the same result; nothing but the tables in use and no shuffle files stay."""
    from pathlib import Path

    from arbora.core import materialize, shared_folder
    from arbora.operators import blocks

    rng = np.random.default_rng(3)
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "embedding": rng.standard_normal((90, 5)).tolist()}))
    matrix = materialize(diffusion.transition_matrix(diffusion.gaussian_graph(points, 8)))
    folder = Path(shared_folder(spark)) / f"arbora-{spark.sparkContext.applicationId}"
    found, left, cut = [], [], []
    written = blocks.Blocks.written
    monkeypatch.setattr(blocks.Blocks, "written", lambda self, *held: cut.append(1) or written(self, *held))
    for most in (1 << 30, 1):
        monkeypatch.setattr(blocks, "JOB_BYTES", most)
        before = {p.name for p in folder.iterdir()}
        rows = diffusion.eigenvectors(points.select("id"), matrix, 90, 3, block_places=20)[0]
        found.append(rows.toPandas().sort_values(["component", "id"]))
        left.append({p.name for p in folder.iterdir()} - before)
        cut.append(0)
    assert np.allclose(found[0].value, found[1].value, atol=1e-6)
    assert len(left[0]) == len(left[1]) <= 4  # the ids, their places and the coordinates
    split = cut.index(0)
    assert sum(cut[split:]) > 5 * split  # every round a job of its own
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_layout_searches_neighbours_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(40), "embedding": rng.standard_normal((40, 4)).tolist()}))
    from arbora.operators import neighbors, states

    alone = states.fuzzy_graph(points.select("id", F.lit("all").alias("lineage"), "embedding"), 6)
    near = neighbors.nearest(points.select("id", F.lit("all").alias("lineage"), "embedding"), 6)
    shared = states.fuzzy_graph(points.select("id", F.lit("all").alias("lineage"), "embedding"), 6, near=near)
    assert alone.exceptAll(shared).isEmpty() and shared.exceptAll(alone).isEmpty()
    assert diffusion.gaussian_graph(points, 6).exceptAll(diffusion.gaussian_graph(points, 6, near=near)).isEmpty()
    for module in (states, diffusion):
        monkeypatch.setattr(module, "nearest", None)
    assert layout.display_layout(points, 2, 6, epochs=3).count() == 80


def test_eigenvectors_do_not_depend_on_blocks(spark):
    """Blocks send each other only what their links read."""
    rng = np.random.default_rng(12)
    points = spark.createDataFrame(pd.DataFrame({"id": 3 * np.arange(60), "embedding": rng.standard_normal((60, 4)).tolist()}))
    matrix = diffusion.transition_matrix(diffusion.gaussian_graph(points, 8))
    one, many = (diffusion.eigenvectors(points.select("id"), matrix, 60, 3, block_places=b)[0].toPandas().sort_values(["component", "id"])
                 for b in (1000, 7))
    assert (one.id.to_numpy() == many.id.to_numpy()).all() and np.allclose(one.value, many.value, atol=1e-6)


def test_layout_by_blocks(spark):
    """Epochs over many blocks move every point as one task does, across the end of a job."""
    rng = np.random.default_rng(13)
    n, epochs = 50, 3
    placed = spark.createDataFrame(pd.DataFrame({"id": 2 * np.arange(n), "place": np.arange(n), "y": rng.standard_normal((n, 2)).tolist()}))
    ends = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (120, 2)) if a != b}
    edges = spark.createDataFrame([(2 * a, 2 * b, .5 + a % 3 / 4) for a, b in sorted(ends)], "left_id long, right_id long, weight double")
    layout.EPOCHS_PER_JOB, kept = 2, layout.EPOCHS_PER_JOB
    try:
        got = [np.stack(f.toPandas().sort_values("id").y) for f in (layout._move_rounds(placed, edges, 2, epochs, 7),
                                                                    layout._move_small(placed, edges, 2, epochs))]
    finally:
        layout.EPOCHS_PER_JOB = kept
    assert np.allclose(*got, atol=1e-9)


def test_decay_graph_of_long_lists(spark, monkeypatch):
    """A point with very many near others costs its own pairs alone, not longer lists of all points."""
    rng = np.random.default_rng(14)
    x = np.vstack([np.c_[np.ones(60), 1e-3 * rng.standard_normal((60, 3)).round(0)], rng.standard_normal((40, 4))])
    x[:60, 1] += 1
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(100), "embedding": x.tolist()}))
    asked, plain = [], potential.nearest
    monkeypatch.setattr(potential, "nearest", lambda p, k, *more: (asked.append(k), plain(p, k, *more))[1])
    got = {(r.a, r.b): r.w for r in potential.decay_graph(points, 5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.maximum(0, 1 - np.round(np.clip(u @ u.T, -1, 1), 12))
    np.fill_diagonal(d, np.inf)
    w = np.exp(-(d / np.maximum(np.sort(d, axis=1)[:, 4:5], 1e-12)) ** 40)
    w[w <= potential.LEAST_WEIGHT] = 0
    w = (w + w.T) / 2 + np.eye(100)
    assert asked == [5] and (w > 0).sum(1).max() > 40
    assert got.keys() == {(a, b) for a, b in zip(*np.nonzero(w))} and all(v == pytest.approx(w[k]) for k, v in got.items())


def test_display_layout(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([c + .1 * rng.standard_normal((15, 6)) for c in 3 * np.eye(6)[:3]])
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(45), "embedding": x.tolist()}))
    a, b = (layout.display_layout(points, 2, 8, epochs=2, small_points=s).toPandas().sort_values(["id", "component"]).value.to_numpy()
            for s in (0, 1000))
    assert np.allclose(a, b, atol=1e-6)
    y = layout.display_layout(points, 2, 8, epochs=100).toPandas().pivot(index="id", columns="component", values="value").to_numpy()
    group = np.repeat(np.arange(3), 15)
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert (group[d.argmin(1)] == group).mean() > .9


@pytest.mark.parametrize("landmarks", [1000, 30])
def test_potential_layout_keeps_neighbours(spark, landmarks):
    rng = np.random.default_rng(9)
    t = np.sort(rng.uniform(0, 2.5, 90))
    x = np.c_[np.cos(t), np.sin(t), np.ones(90)] + .01 * rng.standard_normal((90, 3))
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "embedding": x.tolist()}))
    y = potential.potential_layout(points, 2, 5, t=25 if landmarks == 1000 else 4, landmarks=landmarks).toPandas().pivot(
        index="id", columns="component", values="value").to_numpy()
    assert y.shape == (90, 2) and np.isfinite(y).all()
    # Neighbours on the map are neighbours along the curve.
    gap = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(gap, np.inf)
    assert np.abs(t[gap.argmin(1)] - t).mean() < .1
    if landmarks == 1000:
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = np.maximum(0, 1 - np.round(u @ u.T, 12))
        np.fill_diagonal(d, np.inf)
        w = np.exp(-(d / np.sort(d, axis=1)[:, 4:5]) ** 40)
        w[w <= potential.LEAST_WEIGHT] = 0
        w = (w + w.T) / 2 + np.eye(90)
        want = potential.potential_coordinates(w / w.sum(1, keepdims=True), 2, 25)
        assert np.allclose(y, want, atol=1e-6)


def test_decoder(spark):
    rng = np.random.default_rng(7)
    w1, b1, w2 = rng.standard_normal((5, 3)), rng.standard_normal(5), rng.standard_normal((4, 5))
    rows = [(0, "weight", i, w1[i].tolist()) for i in range(5)] + [(0, "bias", 0, b1.tolist())] + [(1, "weight", i, w2[i].tolist()) for i in range(4)]
    layers = spark.createDataFrame(rows, "layer int, kind string, position int, values array<double>")
    assert decoder.layer_widths(layers) == [(0, 3, 5), (1, 5, 4)]
    x = rng.standard_normal((6, 3))
    nodes = spark.createDataFrame(pd.DataFrame({"node_id": np.arange(6), "embedding": x.tolist()}))
    got = np.stack(decoder.decode(nodes, layers).orderBy("node_id").toPandas().decoded)
    want = np.log1p(np.exp(np.maximum(x @ w1.T + b1, 0) @ w2.T))
    assert np.allclose(got, want)
    blocked = decoder.decode(nodes, layers, block_numbers=6, block_rows=2).orderBy("node_id").toPandas().decoded
    assert np.allclose(np.stack(blocked), want)
    for bad in (layers.where("not (layer = 0 and position = 1)"), layers.where("layer = 1 or position < 4 and kind = 'weight'"), layers.limit(0)):
        with pytest.raises(ContractError):
            decoder.decode(nodes, bad)
    long = decoder.named_expression(decoder.decode(nodes, layers), readers.read_gene_names(spark, None, 4))
    assert long.count() == 24
