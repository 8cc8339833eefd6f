"""Flows: from input files to published folders, one per stage, and the chain of all stages.

A flow checks its options, reads its inputs, computes the tables of its stage and publishes them together with a
manifest (`run_config.json`): the stage, the paths of its inputs under the names that later flows follow, a
fingerprint of every input, the options, and the rows and columns of every table. A flow whose folder already
holds a result with the same stage, inputs and options returns it as it is, so a chain that was stopped goes on with
the first stage that is missing; a changed option or input file makes its stage and all later ones run again. Another
result in the folder is only replaced with `overwrite`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.core import ContractError, materialize, require_columns, ship
from arbora.operators import composition as comp
from arbora.operators import diagnostics, export
from arbora.plans import stages
from arbora.sinks import writers
from arbora.sources import readers
from arbora.sources.npy import NpyDataSource

MANIFEST = "run_config.json"


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a published folder: its key. Of other files: names, sizes and times, not their content."""
    if writers.exists(spark, f"{path}/{MANIFEST}"):
        return writers.read_config(spark, path)["key"]
    fs, place = writers._filesystem(spark, path)
    if not fs.exists(place):
        raise ContractError(f"{path} does not exist")
    found, files = [], fs.listFiles(place, True)
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith((".", "_")):
            found.append(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a published folder."""
    writers.recover(spark, folder)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def has_table(spark: SparkSession, folder: str, name: str) -> bool:
    return writers.exists(spark, f"{folder}/{name}.parquet")


def run(spark: SparkSession, folder: str, stage: str, inputs: dict[str, str | None], options: dict,
        compute: Callable[[], stages.Tables], overwrite: bool = False) -> dict:
    """Publish the tables of one stage, or return the manifest of the same result that is there already."""
    ship(spark)
    named = {k: v for k, v in inputs.items() if v is not None}
    marks = {k: fingerprint(spark, v) for k, v in sorted(named.items())}
    identity = json.loads(json.dumps({"stage": stage, "fingerprints": marks, "options": options}, default=str, sort_keys=True))
    key = hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()
    writers.recover(spark, folder)
    if writers.exists(spark, f"{folder}/{MANIFEST}"):
        found = writers.read_config(spark, folder)
        if found["key"] == key:
            return found
    if writers.exists(spark, folder) and not overwrite:
        raise ContractError(f"{folder} holds another result")
    tables = {name: materialize(df) for name, df in compute().items()}
    manifest = {**named, **identity, "key": key, "tables": {
        name: {"rows": df._written_rows, "columns": dict(df.dtypes)} for name, df in tables.items()}}
    writers.publish(spark, folder, tables, manifest, overwrite=overwrite)
    return manifest


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(cell_index, embedding) of a two-dimensional .npy file or of a Parquet table with these columns."""
    if path.endswith(".npy"):
        spark.dataSource.register(NpyDataSource)
        return spark.read.format("npy").load(path).select(F.col("row_index").alias("cell_index"), F.col("value").alias("embedding"))
    found = spark.read.parquet(path)
    require_columns(found, {"cell_index", "embedding"}, "vectors")
    return found.select("cell_index", "embedding")


def read_cells(spark: SparkSession, cells: str, vectors: str, predicted: str | None = None,
               lineages: str | None = None) -> DataFrame:
    """Cells (cell_index, cell_id, lineage, stage, embedding), every cell with exactly one vector.

    The stage comes from the validated predictions, else from a column `stage`. With `lineages` (a JSON file
    with that list) the column `lineage_id` is decoded, else `lineage` is read.
    """
    rows = spark.read.parquet(cells)
    require_columns(rows, {"cell_index", "cell_id", "lineage_id" if lineages else "lineage", *([] if predicted else ["stage"])}, "cells")
    if lineages:
        rows = readers.decode_dictionary(rows.drop("lineage"), "lineage_id", readers.read_dictionary(spark, lineages, "lineages"), "lineage")
    if predicted:
        rows = readers.attach_predicted_stage(rows.drop("stage"), readers.read_predicted_stage(spark, predicted))
    known = read_vectors(spark, vectors).withColumn("_vectors", F.lit(1))
    both = materialize(rows.join(known, "cell_index", "full"))
    odd = both.agg(F.count_if(F.col("_vectors").isNull()), F.count_if(F.col("cell_id").isNull()), F.count("*"), F.countDistinct("cell_index")).first()
    if odd[0] or odd[1] or odd[2] != odd[3]:
        raise ContractError(f"{odd[0]} cells without a vector, {odd[1]} vectors without a cell, {odd[2] - odd[3]} repeated")
    return both.drop("_vectors")


def group_cells(spark: SparkSession, folder: str, cells: str, vectors: str, predicted: str | None = None,
                lineages: str | None = None, annotations: str | None = None,
                options: stages.GroupingOptions = stages.GroupingOptions(), overwrite: bool = False) -> dict:
    """Stage 1: cell files to microcells."""
    options.check()

    def compute():
        rows = read_cells(spark, cells, vectors, predicted, lineages)
        notes = readers.read_annotations(spark, annotations) if annotations else None
        return stages.group_cells(rows, notes, options)

    inputs = {"cells": cells, "vectors": vectors, "predicted": predicted, "lineages": lineages, "annotations": annotations}
    return run(spark, folder, "group_cells", inputs, asdict(options), compute, overwrite)


def find_nodes(spark: SparkSession, folder: str, microcell_dir: str,
               options: stages.StateOptions = stages.StateOptions(), overwrite: bool = False) -> dict:
    """Stage 2: a folder of stage 1 to states and temporal nodes."""
    options.check()
    labels = "microcell_celltype_composition"

    def compute():
        held = table(spark, microcell_dir, labels) if has_table(spark, microcell_dir, labels) else None
        return stages.find_nodes(table(spark, microcell_dir, "microcells"), held, options)

    return run(spark, folder, "find_nodes", {"microcell_dir": microcell_dir}, asdict(options), compute, overwrite)


def build_tree(spark: SparkSession, folder: str, node_dir: str,
               options: stages.TreeOptions = stages.TreeOptions(), overwrite: bool = False) -> dict:
    """Stage 3: a folder of stage 2 to the rooted tree."""
    options.check()
    return run(spark, folder, "build_tree", {"node_dir": node_dir}, asdict(options),
               lambda: stages.build_tree(table(spark, node_dir, "nodes"), options), overwrite)


def contract_tree(spark: SparkSession, folder: str, tree_dir: str,
                  options: stages.ContractOptions = stages.ContractOptions(), overwrite: bool = False) -> dict:
    """Stage 4: a folder of stage 3 to the contracted tree; labels come from the stage 2 folder it names."""
    options.check()
    node_dir = writers.resolve_inputs(spark, tree_dir, "node_dir")[0]
    labels = "node_celltype_composition"

    def compute():
        held = table(spark, node_dir, labels) if has_table(spark, node_dir, labels) else None
        return stages.contract_tree(table(spark, tree_dir, "tree_nodes"), table(spark, tree_dir, "tree_edges"), held, options)

    return run(spark, folder, "contract_tree", {"tree_dir": tree_dir, "node_dir": node_dir}, asdict(options), compute, overwrite)


def evaluate_purity(spark: SparkSession, folder: str, source_dir: str, small_size: int = 50, overwrite: bool = False) -> dict:
    """Purity of the microcells (folder of stage 1) or nodes (stage 2 or 4) with its summaries."""
    stage = writers.read_config(spark, source_dir)["stage"]
    groups, labels, key = {"group_cells": ("microcells", "microcell_celltype_composition", "microcell_id"),
                           "find_nodes": ("nodes", "node_celltype_composition", "node_id"),
                           "contract_tree": ("tree_nodes", "node_celltype_composition", "node_id")}[stage]

    def compute():
        rows = table(spark, source_dir, groups)
        if "node_type" in rows.columns:
            rows = rows.where(F.col("node_type") == "temporal_node")
        found = materialize(comp.evaluate_purity(rows, table(spark, source_dir, labels), key))
        by = materialize(comp.purity_summary(found, "lineage", small_size))
        return {"purity": found, "purity_summary": comp.purity_summary(found, None, small_size), "purity_by_lineage": by,
                "purity_by_label": comp.purity_summary(found, "dominant_known_celltype", small_size),
                "purity_coverage": comp.purity_coverage(found)}

    return run(spark, folder, "evaluate_purity", {"source_dir": source_dir}, {"small_size": small_size}, compute, overwrite)


def summarize_tree(spark: SparkSession, folder: str, tree_dir: str, short_gap: float = 1.0, overwrite: bool = False) -> dict:
    """Edge gaps, terminals and summaries of a folder of stage 3 or 4."""
    def compute():
        nodes = table(spark, tree_dir, "tree_nodes")
        edges = table(spark, tree_dir, "tree_edges")
        gaps = materialize(diagnostics.edge_gaps(nodes, edges, short_gap))
        ends = materialize(diagnostics.terminals(nodes, gaps))
        return {"edge_gaps": gaps, "terminals": ends, "tree_summary": diagnostics.tree_summary(nodes, edges, gaps, ends),
                "lineage_summary": diagnostics.lineage_table(nodes, gaps, ends)}

    return run(spark, folder, "summarize_tree", {"tree_dir": tree_dir}, {"short_gap": short_gap}, compute, overwrite)


def export_cells(spark: SparkSession, folder: str, contracted_dir: str, node_ids=None, overwrite: bool = False) -> dict:
    """Member cells of all contracted nodes or of `node_ids`; the other folders are found through the manifests."""
    node_dir, microcell_dir = writers.resolve_inputs(spark, contracted_dir, "node_dir", "microcell_dir")

    def compute():
        assigned, sources = table(spark, node_dir, "microcell_node_assignments"), table(spark, contracted_dir, "source_to_contracted_nodes")
        export.check_mapping(assigned, sources)
        mapping = materialize(export.microcell_mapping(assigned, sources))
        cells = table(spark, microcell_dir, "cell_to_microcell")
        return {"cells": export.node_cells(cells, mapping, node_ids), "export_counts": export.export_counts(cells, mapping)}

    inputs = {"contracted_dir": contracted_dir, "node_dir": node_dir, "microcell_dir": microcell_dir}
    return run(spark, folder, "export_cells", inputs, {"node_ids": None if node_ids is None else sorted(map(int, node_ids))}, compute, overwrite)


def trajectory(spark: SparkSession, root: str, cells: str, vectors: str, predicted: str | None = None, lineages: str | None = None,
               annotations: str | None = None, grouping: stages.GroupingOptions = stages.GroupingOptions(),
               states: stages.StateOptions = stages.StateOptions(), tree: stages.TreeOptions = stages.TreeOptions(),
               contraction: stages.ContractOptions = stages.ContractOptions(), overwrite: bool = False) -> dict[str, dict]:
    """All four stages below `root`; what is there already with the same inputs and options is not computed again."""
    at = {n: f"{root}/{n}" for n in ("microcells", "nodes", "tree", "contracted")}
    return {"microcells": group_cells(spark, at["microcells"], cells, vectors, predicted, lineages, annotations, replace(grouping), overwrite),
            "nodes": find_nodes(spark, at["nodes"], at["microcells"], states, overwrite),
            "tree": build_tree(spark, at["tree"], at["nodes"], tree, overwrite),
            "contracted": contract_tree(spark, at["contracted"], at["tree"], contraction, overwrite)}
