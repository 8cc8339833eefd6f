"""Flows from files to published folders: whole chains, resumed and changed ones, and publishing that fails half-way."""

import json

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from arbora.core import ContractError
from arbora.operators import export
from arbora.plans import flows, stages
from arbora.sinks import writers
from arbora.sources import standins
from arbora.streaming.export import cell_stream, export_stream

GROUPING = stages.GroupingOptions(target_size=6, min_size=3, max_size=12, k=8, pile_size=100, bin_width=5.5)
STATES = stages.StateOptions(k=6, resolution=1.0, min_cells=3, bin_width=4.0)
TREE = stages.TreeOptions(root_window=4.0)


@pytest.fixture(scope="module")
def files(spark, data, tmp_path_factory):
    """Cells with lineage codes and a dictionary, vectors as .npy, predictions and annotations as CSV."""
    folder = tmp_path_factory.mktemp("files")
    rows = standins.cells_from_embeddings(spark, data).orderBy("cell_index").toPandas()
    names = sorted(rows.lineage.unique())
    rows["cell_id"] = [f"c{i}" for i in rows.cell_index]
    rows["lineage_id"] = rows.lineage.map(names.index)
    assert rows.cell_index.tolist() == list(range(len(rows)))
    rows[["cell_index", "cell_id", "lineage_id"]].to_parquet(folder / "cells.parquet")
    np.save(folder / "vectors.npy", np.stack(rows.embedding).astype(np.float32))
    shuffled = rows.sample(frac=1, random_state=1)
    shuffled.rename(columns={"cell_index": "idx", "stage": "predicted_stage"})[["idx", "cell_id", "predicted_stage"]].to_csv(folder / "stage.csv", index=False)
    rows.rename(columns={"cell_id": "cell"})[["cell", "celltype"]][5:].to_csv(folder / "labels.csv", index=False)
    (folder / "meta.json").write_text(json.dumps({"lineages": names}))
    return {"cells": str(folder / "cells.parquet"), "vectors": str(folder / "vectors.npy"), "predicted": str(folder / "stage.csv"),
            "lineages": str(folder / "meta.json"), "annotations": str(folder / "labels.csv"), "n": len(rows)}


def test_chain_stops_resumes_and_changes(spark, files, tmp_path, monkeypatch):
    n, root = files["n"], str(tmp_path / "run")
    inputs = {k: v for k, v in files.items() if k != "n"}
    chain = lambda **more: flows.trajectory(spark, root, **inputs, grouping=GROUPING, states=STATES, tree=TREE, **more)

    def stopped(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(stages, "build_tree", stopped)
        with pytest.raises(RuntimeError):
            chain()
    assert writers.exists(spark, f"{root}/nodes") and not writers.exists(spark, f"{root}/tree")
    with monkeypatch.context() as m:  # what is there is not computed again
        m.setattr(stages, "group_cells", stopped)
        m.setattr(stages, "find_nodes", stopped)
        done = chain()
    assert done["microcells"]["tables"]["cell_to_microcell"]["rows"] == n
    read = lambda folder, name: flows.table(spark, f"{root}/{folder}", name)
    assert read("microcells", "microcells").agg(F.sum("n_cells")).first()[0] == n
    assert read("microcells", "microcell_celltype_composition").agg(F.sum("cell_count")).first()[0] == n - 5  # five have no label
    assert read("contracted", "tree_nodes").count() == done["contracted"]["tables"]["tree_nodes"]["rows"]
    assert writers.resolve_inputs(spark, f"{root}/contracted", "tree_dir", "node_dir", "microcell_dir", "cells")[-1] == files["cells"]

    # Other options of the last stage leave the first three as they are.
    other = stages.ContractOptions(max_distance=1.5, max_span=40.0)
    with pytest.raises(ContractError):
        chain(contraction=other)
    with monkeypatch.context() as m:
        for name in ("group_cells", "find_nodes", "build_tree"):
            m.setattr(stages, name, stopped)
        again = chain(contraction=other, overwrite=True)
    assert again["tree"] == done["tree"] and again["contracted"]["key"] != done["contracted"]["key"]
    assert again["contracted"]["tables"]["tree_nodes"]["rows"] < done["contracted"]["tables"]["tree_nodes"]["rows"]

    # The flows that read finished folders.
    flows.evaluate_purity(spark, str(tmp_path / "p1"), f"{root}/microcells")
    flows.evaluate_purity(spark, str(tmp_path / "p2"), f"{root}/contracted")
    row = spark.read.parquet(str(tmp_path / "p1" / "purity_summary.parquet")).first()
    assert row.total_cells == n and row.all_matched_cells == n - 5
    flows.summarize_tree(spark, str(tmp_path / "t"), f"{root}/contracted")
    assert spark.read.parquet(str(tmp_path / "t" / "tree_summary.parquet")).count() == 1
    flows.export_cells(spark, str(tmp_path / "e"), f"{root}/contracted")
    counts = spark.read.parquet(str(tmp_path / "e" / "export_counts.parquet")).first()
    assert counts.exported_cells + counts.excluded_cells == n
    some = spark.read.parquet(str(tmp_path / "e" / "cells.parquet")).first().contracted_node_id
    flows.export_cells(spark, str(tmp_path / "e2"), f"{root}/contracted", [some])
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "e2" / "cells.parquet")).select("contracted_node_id").distinct().collect()} == {some}


def test_inputs_are_checked(spark, files, tmp_path):
    short = str(tmp_path / "short.npy")
    np.save(short, np.load(files["vectors"])[:-2])
    with pytest.raises(ContractError):
        flows.read_cells(spark, files["cells"], short, files["predicted"], files["lineages"])
    with pytest.raises(ContractError):
        flows.fingerprint(spark, str(tmp_path / "nothing"))
    for bad in ({"k": 0}, {"root_window": -1.0}, {"mutual_bonus": 0.0}, {"temperature": float("inf")}, {"fate_threshold": 2.0}):
        with pytest.raises(ContractError):
            stages.TreeOptions(**bad).check()


@pytest.mark.parametrize("step", [0, 1, 2])
def test_replacement_that_fails_leaves_a_whole_result(spark, tmp_path, monkeypatch, step):
    """Step 0: before the old result moves; 1: between the two renames; 2: before the old one is deleted."""
    one, two = (spark.createDataFrame([(i,)], "a long") for i in (1, 2))
    folder, calls = str(tmp_path / "result"), []
    writers.publish(spark, folder, {"t": one}, {"v": 1})
    move, remove = writers._move, writers._remove

    def failing(spark_, old, new):
        if len(calls) == step:
            raise OSError("lost")
        calls.append(old)
        move(spark_, old, new)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(writers, "_move", failing)
        m.setattr(writers, "_remove", lost)
        with pytest.raises(OSError):
            writers.publish(spark, folder, {"t": two}, {"v": 2}, overwrite=True)
    want = 1 if step == 0 else 2
    assert writers.read_config(spark, folder) == {"v": want}
    assert spark.read.parquet(f"{folder}/t.parquet").first()[0] == want
    assert not writers._beside(spark, folder, "old")
    writers.publish(spark, folder, {"t": two}, {"v": 3}, overwrite=True)
    assert writers.read_config(spark, folder) == {"v": 3}


def test_text_files_appear_whole(spark, tmp_path):
    path = str(tmp_path / "a.json")
    writers.write_text(spark, path, "one")
    with pytest.raises(ContractError):
        writers.write_text(spark, path, "two")
    writers.write_text(spark, path, "two", overwrite=True)
    assert writers.read_text(spark, path) == "two" and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["a.json"]


def test_stopped_export_goes_on(spark, tmp_path):
    """The second file fails at first; later runs neither lose nor repeat rows."""
    cells = spark.range(40).select(F.col("id").alias("cell_index"), (F.col("id") % 4).alias("microcell_id"))
    mapping = spark.createDataFrame([(i, i, i % 2) for i in range(4)], "microcell_id long, source_node_id long, contracted_node_id long")
    source, out = str(tmp_path / "cells"), str(tmp_path / "out")
    cells.where("cell_index < 20").coalesce(1).write.parquet(source)
    export_stream(cell_stream(spark, source, cells.schema, 1), mapping, out)
    cells.where("cell_index >= 20").coalesce(1).write.mode("append").parquet(source)
    broken = cell_stream(spark, source, cells.schema, 1).withColumn(
        "cell_index", F.when(F.col("cell_index") == 33, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("cell_index")))
    with pytest.raises(StreamingQueryException):
        export_stream(broken, mapping, out)
    assert spark.read.parquet(out).count() == 20
    for _ in range(2):
        export_stream(cell_stream(spark, source, cells.schema, 1), mapping, out)
        got = spark.read.parquet(out)
        assert got.count() == 40 and got.exceptAll(export.node_cells(cells, mapping)).isEmpty()
