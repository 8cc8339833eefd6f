"""DuckDB SQL twins of the registered queries, over the same tables."""

from __future__ import annotations

from arbora.plans.queries import K, PATH, SHAPES, SPAN
from arbora.plans.shape import shaped_sql

# ---- views ------------------------------------------------------------------------------------------

NODES = """nodes AS (SELECT vec_id AS node_id, 'lin' || (label % 3) AS lineage, 'ct' || label AS celltype,
 label, 4.0::DOUBLE + ((vec_id * 7919) % 2200)::DOUBLE / 100.0::DOUBLE AS stage, 1 + (vec_id * 31) % 97 AS n_cells,
 1 + (vec_id * 17) % 5 AS n_metacells, embedding::DOUBLE[] AS v FROM embeddings)"""

CELLS = """cells AS (SELECT event_id AS cell_index, 'cell' || event_id AS cell_id, user_id AS microcell_id,
 'lin' || (user_id % 8) AS lineage, user_id % 3 AS state_within_lineage,
 (user_id % 8) * 3 + user_id % 3 AS state_id, event_type AS celltype, value AS stage FROM events)"""

MICRO = """micro AS (SELECT microcell_id, lineage, state_within_lineage, state_id, count(*) AS n_cells,
 avg(stage) AS mean_stage FROM cells GROUP BY ALL)"""

LINES = """lines AS (SELECT l_partkey AS microcell_id, l_returnflag AS lineage, l_quantity AS stage,
 l_linestatus AS celltype, l_extendedprice AS price, l_orderkey AS order_id, l_linenumber AS line FROM lineitem)"""


def composition(name: str, source: str, group: str, label: str = "celltype", amount: str = "count(*)") -> str:
    return f"""{name}_c AS (SELECT {group}, {label}, {amount} AS cell_count FROM {source} GROUP BY {group}, {label}),
 {name} AS (SELECT {group}, {label}, cell_count, cell_count / sum(cell_count) OVER (PARTITION BY {group}) AS fraction,
 row_number() OVER (PARTITION BY {group} ORDER BY cell_count DESC, {label}) AS rank FROM {name}_c)"""


def strata(source: str, width: float, origin: float) -> str:
    return f"""binned AS (SELECT lineage, floor((stage - {origin}::DOUBLE) / {width}::DOUBLE) AS stage_bin_id,
 count(*) AS n_cells FROM {source} GROUP BY ALL),
 edges0 AS (SELECT *, {origin}::DOUBLE + stage_bin_id * {width}::DOUBLE AS stage_bin_left FROM binned),
 edges1 AS (SELECT *, stage_bin_left + {width}::DOUBLE AS stage_bin_right FROM edges0),
 result AS (SELECT *, (stage_bin_left + stage_bin_right) / 2 AS constraint_stage,
 '[' || printf('%g', stage_bin_left) || ',' || printf('%g', stage_bin_right) || ')' AS stage_bin_label FROM edges1)"""


# Purity evaluation of the events: labels of early cells are missing, two labels count as unknown.
PURITY = """labels AS (SELECT microcell_id, trim(celltype) AS celltype, count(*) AS cell_count,
 lower(trim(celltype)) NOT IN ('error', 'unassigned', '') AS known FROM cells
 WHERE cell_index * 2 IN (SELECT o_orderkey FROM orders) GROUP BY ALL),
 sizes AS (SELECT microcell_id, lineage, count(*) AS n_cells FROM cells GROUP BY ALL),
 matched AS (SELECT microcell_id, sum(cell_count) AS matched_cells, max(cell_count) AS top_any FROM labels GROUP BY ALL),
 known AS (SELECT *, cell_count / sum(cell_count) OVER (PARTITION BY microcell_id) AS p,
 row_number() OVER (PARTITION BY microcell_id ORDER BY cell_count DESC, celltype) AS rn FROM labels WHERE known),
 known_sum AS (SELECT microcell_id, sum(cell_count) AS known_cells, count(*) AS known_celltype_count,
 sum(-p * ln(p)) AS celltype_entropy FROM known GROUP BY ALL),
 purity AS (SELECT s.microcell_id, s.n_cells, s.lineage, coalesce(m.matched_cells, 0) AS matched_cells,
 coalesce(k.known_cells, 0) AS known_cells, coalesce(m.matched_cells, 0) - coalesce(k.known_cells, 0) AS unknown_cells,
 s.n_cells - coalesce(m.matched_cells, 0) AS unmatched_cells, coalesce(k.known_cells, 0) / s.n_cells AS known_fraction,
 m.top_any / nullif(m.matched_cells, 0) AS purity_including_unknown,
 coalesce(d.celltype, '(no known annotation)') AS dominant_known_celltype,
 coalesce(d.cell_count, 0) AS dominant_known_cells, coalesce(d.cell_count, 0) / nullif(k.known_cells, 0) AS purity,
 coalesce(k.known_celltype_count, 0) AS known_celltype_count, k.celltype_entropy,
 coalesce(d.cell_count, 0) / s.n_cells AS dominant_fraction_all_cells
 FROM sizes s LEFT JOIN matched m USING (microcell_id) LEFT JOIN known_sum k USING (microcell_id)
 LEFT JOIN (SELECT * FROM known WHERE rn = 1) d USING (microcell_id))"""


def purity_summary(keys: str = "") -> str:
    key = f"{keys}," if keys else ""
    parts = []
    for text, t in (("0_9", 0.9), ("0_95", 0.95)):
        high = f"known_cells > 0 AND purity >= {t}"
        parts.append(f"""count_if({high}) / nullif(count_if(known_cells > 0), 0) AS purity_ge_{text}_group_fraction,
 coalesce(sum(n_cells) FILTER ({high}), 0) / sum(n_cells) AS purity_ge_{text}_all_cell_coverage,
 coalesce(sum(known_cells) FILTER ({high}), 0) / nullif(sum(known_cells), 0) AS purity_ge_{text}_known_cell_coverage""")
    group = f"GROUP BY {keys}" if keys else ""
    return f"""summary AS (SELECT {key} count(*) AS n_groups, sum(n_cells) AS total_cells,
 count_if(known_cells > 0) AS evaluable_groups, sum(matched_cells) AS all_matched_cells,
 sum(known_cells) AS all_known_cells, sum(unknown_cells) AS all_unknown_cells,
 sum(unmatched_cells) AS all_unmatched_cells, sum(matched_cells) / sum(n_cells) AS matched_fraction,
 sum(known_cells) / sum(n_cells) AS known_fraction, avg(purity) FILTER (known_cells > 0) AS mean_purity,
 sum(dominant_known_cells) FILTER (known_cells > 0) / nullif(sum(known_cells), 0) AS known_cell_weighted_purity,
 sum(dominant_known_cells) / sum(n_cells) AS dominant_fraction_all_cells,
 avg(celltype_entropy) FILTER (known_cells > 0) AS mean_entropy,
 avg((n_cells = 1)::INT) AS singleton_fraction, avg((n_cells < 60)::INT) AS small_group_fraction,
 coalesce(sum(n_cells) FILTER (n_cells < 60), 0) / sum(n_cells) AS small_group_cell_fraction,
 {', '.join(parts)}, quantile_cont(n_cells, 0.5) AS median_group_size,
 quantile_cont(purity, 0.5) FILTER (known_cells > 0) AS median_purity,
 quantile_cont(purity, 0.1) FILTER (known_cells > 0) AS p10_purity FROM purity {group})"""


FIXED = """bins AS (SELECT *, floor(mean_stage / 4.0) AS predicted_stage_bin FROM micro),
 pairs AS (SELECT state_id, predicted_stage_bin, row_number() OVER (ORDER BY state_id, predicted_stage_bin) - 1 AS node_id
 FROM (SELECT DISTINCT state_id, predicted_stage_bin FROM bins)),
 fixed AS (SELECT b.*, p.node_id, predicted_stage_bin * 4.0 AS stage_bin_left,
 (predicted_stage_bin + 1) * 4.0 AS stage_bin_right FROM bins b JOIN pairs p USING (state_id, predicted_stage_bin))"""


def group_summary(key: str) -> str:
    state = ", min(state_id) AS state_id" if key != "state_id" else ""
    return f"""grouped AS (SELECT {key}, min(lineage) AS lineage, min(state_within_lineage) AS state_within_lineage{state},
 count(*) AS n_metacells, sum(n_cells) AS n_cells, avg(mean_stage) AS mean_stage, min(mean_stage) AS min_stage,
 max(mean_stage) AS max_stage, sum(mean_stage * n_cells) / sum(n_cells) AS cell_weighted_mean_stage
 FROM fixed GROUP BY {key})"""


FILTERED = group_summary("node_id") + """,
 filtered AS (SELECT node_id AS raw_node_id, n_cells, n_cells >= 100 AS passes_support_filter,
 CASE WHEN n_cells >= 100 THEN count_if(n_cells >= 100) OVER (ORDER BY node_id) - 1 ELSE -1 END AS node_id,
 CASE WHEN n_cells < 100 THEN 'n_cells_below_min_node_cells' END AS filter_reason FROM grouped)"""

MAPPING = """mapping AS (SELECT f.microcell_id, t.node_id AS source_node_id,
 CASE WHEN t.node_id >= 0 THEN floor(t.node_id / 3.0) ELSE -1 END AS contracted_node_id
 FROM fixed f JOIN filtered t ON f.node_id = t.raw_node_id)"""

# ---- neighbours and the Markov graph ----------------------------------------------------------------

SIMS = """sims AS MATERIALIZED (SELECT a.node_id AS id, b.node_id AS other, a.lineage, a.stage, b.stage AS other_stage,
 round(greatest(-1.0, least(1.0, list_cosine_similarity(a.v, b.v))), 12) AS similarity
 FROM nodes a JOIN nodes b ON a.lineage = b.lineage AND a.node_id <> b.node_id)"""

KNN = f"""knn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank
 FROM sims) WHERE rank <= {K})"""

PAIRS = """pairs AS MATERIALIZED (SELECT lineage, least(id, other) AS left_id, greatest(id, other) AS right_id,
 count(*) AS knn_memberships, max(similarity) AS cosine_similarity FROM knn GROUP BY ALL)"""

SCALES = """scales AS (SELECT lineage, id, greatest(quantile_cont(greatest(0.0, 1 - similarity), 0.5), 1e-6) AS local_scale
 FROM knn WHERE rank <= 5 GROUP BY ALL)"""


def adjacency(factor: float, mutual: bool = False) -> str:
    extra = "AND p.knn_memberships = 2" if mutual else ""
    return f"""adjacent AS MATERIALIZED (SELECT p.lineage, left_id, right_id, greatest(0.0, 1 - cosine_similarity) AS cosine_distance,
 a.local_scale AS left_scale, b.local_scale AS right_scale FROM pairs p JOIN scales a ON a.id = left_id
 JOIN scales b ON b.id = right_id
 WHERE greatest(0.0, 1 - cosine_similarity) <= {factor} * least(a.local_scale, b.local_scale) {extra})"""


COMPONENTS = """reach AS (SELECT node_id AS node, node_id AS seen FROM nodes
 UNION SELECT r.node, CASE WHEN a.left_id = r.seen THEN a.right_id ELSE a.left_id END
 FROM reach r JOIN adjacent a ON a.left_id = r.seen OR a.right_id = r.seen),
 parts AS (SELECT node, min(seen) AS part FROM reach GROUP BY node)"""

GRAPH_SUMMARY = """part_sizes AS (SELECT n.lineage, part, count(*) AS size FROM parts p JOIN nodes n ON n.node_id = p.node GROUP BY ALL),
 result AS (SELECT lineage, sum(size) AS n_metacells, count(*) AS n_components, count_if(size = 1) AS n_isolated,
 max(size) AS largest_component, (SELECT count(*) FROM adjacent a WHERE a.lineage = s.lineage) AS n_undirected_fuzzy_edges
 FROM part_sizes s GROUP BY lineage)"""

EDGES = """starts AS (SELECT lineage, min(stage) AS first_stage FROM nodes GROUP BY lineage),
 roots AS (SELECT n.*, n_cells / sum(n_cells) OVER (PARTITION BY lineage) AS root_share
 FROM nodes n JOIN starts s USING (lineage) WHERE stage <= first_stage + 0.5),
 turned AS (SELECT CASE WHEN a.stage < b.stage THEN left_id ELSE right_id END AS source_id,
 CASE WHEN a.stage < b.stage THEN right_id ELSE left_id END AS target_id, p.lineage, cosine_similarity,
 knn_memberships, least(a.stage, b.stage) AS source_stage, greatest(a.stage, b.stage) AS target_stage
 FROM pairs p JOIN nodes a ON a.node_id = left_id JOIN nodes b ON b.node_id = right_id WHERE a.stage <> b.stage),
 kept AS MATERIALIZED (SELECT * FROM turned WHERE target_id NOT IN (SELECT node_id FROM roots)),
 earlier AS (SELECT id, other, lineage, similarity, other_stage, stage,
 row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rn FROM sims
 WHERE other_stage < stage AND id NOT IN (SELECT node_id FROM roots) AND id NOT IN (SELECT target_id FROM kept)),
 every AS MATERIALIZED (SELECT source_id, target_id, lineage, cosine_similarity, knn_memberships, source_stage, target_stage,
 knn_memberships = 2 AS mutual_knn, false AS fallback_edge FROM kept
 UNION ALL SELECT other, id, lineage, similarity, 0, other_stage, stage, false, true FROM earlier WHERE rn = 1),
 far AS (SELECT *, target_stage - source_stage AS stage_delta,
 greatest(0.0, least(2.0, 1 - cosine_similarity)) AS cosine_distance FROM every)"""


def weights(bonus: float = 1.5, temperature: str = "") -> str:
    warm = temperature or """greatest(coalesce(quantile_cont(cosine_distance, 0.5) FILTER (cosine_distance > 1e-8)
 OVER (PARTITION BY lineage), 0.05), 1e-6)"""
    return f"""warm AS (SELECT *, {warm} AS distance_temperature FROM far),
 heat AS (SELECT *, exp(greatest(-80.0, -cosine_distance / distance_temperature))
 * CASE WHEN mutual_knn THEN {bonus} ELSE 1.0 END AS raw_weight FROM warm),
 graph AS MATERIALIZED (SELECT *, raw_weight / sum(raw_weight) OVER (PARTITION BY source_id) AS transition_probability FROM heat)"""


GRAPH = [NODES, SIMS, KNN, PAIRS, EDGES, weights()]

# Nodes in order of (stage, id) with their incoming edges; a recursive row per lineage appends one flow
# after another.
FLOW = """placed AS MATERIALIZED (SELECT node_id, lineage, row_number() OVER (PARTITION BY lineage ORDER BY stage, node_id) AS place FROM nodes),
 incoming AS (SELECT t.lineage, t.place, list({'at': s.place, 'p': g.transition_probability}) AS links
 FROM graph g JOIN placed s ON s.node_id = g.source_id JOIN placed t ON t.node_id = g.target_id GROUP BY ALL),
 steps AS MATERIALIZED (SELECT p.lineage, p.place, coalesce(r.root_share, 0.0) AS seed, coalesce(i.links, []) AS links
 FROM placed p LEFT JOIN roots r USING (node_id) LEFT JOIN incoming i ON i.lineage = p.lineage AND i.place = p.place),
 walk AS (SELECT lineage, 0::BIGINT AS done, []::DOUBLE[] AS flows FROM starts
 UNION ALL SELECT w.lineage, w.done + 1, list_append(w.flows, s.seed + coalesce(list_sum(list_transform(s.links, lambda x: x.p * w.flows[x.at])), 0.0))
 FROM walk w JOIN steps s ON s.lineage = w.lineage AND s.place = w.done + 1),
 whole AS (SELECT lineage, flows FROM walk QUALIFY row_number() OVER (PARTITION BY lineage ORDER BY done DESC) = 1),
 flow AS MATERIALIZED (SELECT p.node_id, w.flows[p.place] AS flow FROM placed p JOIN whole w USING (lineage))"""

# The same backwards, one recursive row per (lineage, sink).
FATE = """backwards AS MATERIALIZED (SELECT node_id, lineage, row_number() OVER (PARTITION BY lineage ORDER BY stage DESC, node_id DESC) AS place FROM nodes),
 leaving AS (SELECT s.lineage, s.place, list({'at': t.place, 'p': g.transition_probability}) AS links
 FROM graph g JOIN backwards s ON s.node_id = g.source_id JOIN backwards t ON t.node_id = g.target_id GROUP BY ALL),
 back_steps AS MATERIALIZED (SELECT b.lineage, b.place, b.node_id, coalesce(l.links, []) AS links FROM backwards b
 LEFT JOIN leaving l ON l.lineage = b.lineage AND l.place = b.place),
 ends AS MATERIALIZED (SELECT lineage, node_id AS terminal FROM back_steps WHERE len(links) = 0),
 back_walk AS (SELECT lineage, terminal, 0::BIGINT AS done, []::DOUBLE[] AS mass FROM ends
 UNION ALL SELECT w.lineage, w.terminal, w.done + 1, list_append(w.mass, CASE WHEN len(s.links) = 0 THEN (s.node_id = w.terminal)::INT::DOUBLE
 ELSE list_sum(list_transform(s.links, lambda x: x.p * w.mass[x.at])) END)
 FROM back_walk w JOIN back_steps s ON s.lineage = w.lineage AND s.place = w.done + 1),
 back_whole AS (SELECT lineage, terminal, mass FROM back_walk
 QUALIFY row_number() OVER (PARTITION BY lineage, terminal ORDER BY done DESC) = 1),
 fate_raw AS (SELECT b.node_id, b.lineage, w.terminal AS terminal_node_id, w.mass[b.place] AS mass
 FROM backwards b JOIN back_whole w USING (lineage) WHERE w.mass[b.place] > 0),
 fate AS MATERIALIZED (SELECT node_id, lineage, terminal_node_id, mass / sum(mass) OVER (PARTITION BY node_id) AS fate_probability FROM fate_raw)"""

BEST = """best AS MATERIALIZED (SELECT * FROM graph QUALIFY row_number() OVER (PARTITION BY target_id
 ORDER BY transition_probability DESC, raw_weight DESC, cosine_distance, source_id) = 1)"""

VIRTUAL = """whole_range AS (SELECT count(*) AS n, count(DISTINCT lineage) AS l, min(stage) AS low,
 greatest(0.1, (max(stage) - min(stage)) * 0.01) AS gap FROM nodes),
 virtual AS MATERIALIZED (SELECT n + row_number() OVER (ORDER BY lineage) - 1 AS node_id, lineage, 'lineage_root' AS node_type,
 first_stage - gap AS tree_stage FROM starts, whole_range
 UNION ALL SELECT n + l, 'Global', 'global_root', low - gap - gap FROM whole_range),
 tnodes AS MATERIALIZED (SELECT node_id, lineage, 'temporal_node' AS node_type, stage AS tree_stage, n_cells, n_metacells,
 (n_cells % 11) / 10.0 AS celltype_purity FROM nodes
 UNION ALL SELECT node_id, lineage, node_type, tree_stage, 0, 0, NULL FROM virtual)"""

TREE = BEST + ", " + VIRTUAL + """,
 tedges AS MATERIALIZED (SELECT source_id AS parent_id, target_id AS child_id, lineage, 'node_knn' AS edge_kind, false AS virtual_edge,
 cosine_distance, transition_probability, coalesce(f.flow, 0) * transition_probability AS markov_flow,
 source_stage AS parent_stage, target_stage AS child_stage, stage_delta, mutual_knn, fallback_edge
 FROM best b LEFT JOIN flow f ON f.node_id = b.source_id
 UNION ALL SELECT v.node_id, r.node_id, r.lineage, 'lineage_root', true, NULL, root_share, root_share, v.tree_stage, r.stage,
 r.stage - v.tree_stage, false, false FROM roots r JOIN virtual v ON v.lineage = r.lineage
 UNION ALL SELECT g.node_id, v.node_id, v.lineage, 'global_root', true, NULL, 1.0 / l, 1.0 / l, g.tree_stage, v.tree_stage,
 v.tree_stage - g.tree_stage, false, false
 FROM virtual v, (SELECT * FROM virtual WHERE node_type = 'global_root') g, whole_range WHERE v.node_type = 'lineage_root')"""

FULL_TREE = [*GRAPH, FLOW, TREE]

DEGREES = """outs AS (SELECT parent_id AS node_id, count(*) AS c FROM tedges GROUP BY ALL),
 ins AS (SELECT child_id AS node_id, count(*) AS c FROM tedges GROUP BY ALL),
 degrees AS MATERIALIZED (SELECT t.node_id, t.node_type, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree
 FROM tnodes t LEFT JOIN ins i USING (node_id) LEFT JOIN outs o USING (node_id))"""

BRANCHES = DEGREES + """,
 keys AS (SELECT node_id FROM degrees WHERE node_type <> 'temporal_node' OR in_degree <> 1 OR out_degree <> 1),
 paths AS (SELECT parent_id AS start_node_id, child_id AS first_child, 1 AS step, parent_id, child_id FROM tedges
 WHERE parent_id IN (SELECT node_id FROM keys)
 UNION ALL SELECT p.start_node_id, p.first_child, p.step + 1, e.parent_id, e.child_id FROM paths p
 JOIN tedges e ON e.parent_id = p.child_id WHERE p.child_id NOT IN (SELECT node_id FROM keys)),
 branch AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY start_node_id, first_child) - 1 AS segment_id, * FROM paths),
 along AS (SELECT segment_id, 0 AS step, start_node_id AS node_id FROM branch WHERE step = 1
 UNION ALL SELECT segment_id, step, child_id FROM branch),
 segments AS (SELECT segment_id, arg_min(node_id, step) AS start_node_id, arg_max(node_id, step) AS end_node_id,
 count(*) - 1 AS n_edges, count_if(node_type = 'temporal_node') AS n_real_nodes,
 CASE WHEN count(DISTINCT lineage) FILTER (lineage <> 'Global') = 1 THEN min(lineage) FILTER (lineage <> 'Global') ELSE 'Global' END AS lineage,
 arg_min(tree_stage, step) AS start_stage, arg_max(tree_stage, step) AS end_stage,
 arg_max(tree_stage, step) - arg_min(tree_stage, step) AS stage_span, sum(n_metacells) AS n_metacells, sum(n_cells) AS n_cells,
 sum(n_cells * celltype_purity) / nullif(sum(n_cells) FILTER (celltype_purity IS NOT NULL), 0) AS cell_weighted_celltype_purity
 FROM along JOIN tnodes USING (node_id) GROUP BY segment_id)"""

LAYOUT = """leaves AS MATERIALIZED (SELECT node_id, lineage, tree_stage FROM tnodes WHERE node_id NOT IN (SELECT parent_id FROM tedges)),
 bands AS (SELECT lineage, row_number() OVER (ORDER BY lineage) - 1 AS band FROM virtual WHERE node_type = 'lineage_root')"""


def leaf_x(order: str, source: str) -> str:
    return f"""spaced AS (SELECT node_id, lineage, row_number() OVER (PARTITION BY lineage ORDER BY {order}) - 1 AS place,
 count(*) OVER (PARTITION BY lineage) AS total FROM {source}),
 leaf_x AS MATERIALIZED (SELECT node_id, band + CASE WHEN total = 1 THEN 0.5 ELSE 0.05 + 0.9 * place / (total - 1) END AS x
 FROM spaced JOIN bands USING (lineage)),
 fan AS MATERIALIZED (SELECT parent_id, count(*) AS fan FROM tedges GROUP BY ALL),
 rise AS (SELECT node_id, x FROM leaf_x UNION ALL SELECT e.parent_id, r.x / f.fan FROM rise r
 JOIN tedges e ON e.child_id = r.node_id JOIN fan f ON f.parent_id = e.parent_id),
 laid AS (SELECT node_id, sum(x) AS tree_x, any_value(tree_stage) AS tree_y FROM rise JOIN tnodes USING (node_id) GROUP BY node_id)"""


TIDY = """leaf_up AS (SELECT node_id, node_id AS leaf, tree_stage AS s FROM leaves
 UNION ALL SELECT e.parent_id, u.leaf, u.s FROM leaf_up u JOIN tedges e ON e.child_id = u.node_id),
 held AS (SELECT node_id, count(*) AS leaves, min(s) AS earliest, sum(s) / count(*) AS mean_leaf FROM leaf_up GROUP BY node_id),
 lined AS MATERIALIZED (SELECT e.parent_id, e.child_id, coalesce(sum(h.leaves) OVER (PARTITION BY e.parent_id
 ORDER BY t.tree_stage, h.earliest, h.mean_leaf, e.child_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_of
 FROM tedges e JOIN held h ON h.node_id = e.child_id JOIN tnodes t ON t.node_id = e.child_id),
 sink AS (SELECT node_id, 0 AS place FROM virtual WHERE node_type = 'lineage_root'
 UNION ALL SELECT l.child_id, s.place + l.left_of FROM sink s JOIN lined l ON l.parent_id = s.node_id),
 ordered AS (SELECT node_id, lineage, place AS spot FROM leaves JOIN sink USING (node_id))"""

GAPS = """gaps AS MATERIALIZED (SELECT e.parent_id, e.child_id, e.lineage, a.stage AS parent_stage, b.stage AS child_stage,
 b.stage - a.stage AS signed_stage_delta, abs(b.stage - a.stage) AS stage_gap, abs(b.stage - a.stage) < 2.0 AS below_threshold
 FROM tedges e JOIN nodes a ON a.node_id = e.parent_id JOIN nodes b ON b.node_id = e.child_id),
 ended AS (SELECT node_id, lineage, stage AS terminal_stage, n_cells, (n_cells % 11) / 10.0 AS celltype_purity FROM nodes
 WHERE node_id NOT IN (SELECT parent_id FROM gaps))"""

CHAINS = """rins AS (SELECT child_id AS node_id, count(*) AS c FROM gaps GROUP BY ALL),
 routs AS (SELECT parent_id AS node_id, count(*) AS c FROM gaps GROUP BY ALL),
 inner_nodes AS MATERIALIZED (SELECT node_id FROM rins JOIN routs USING (node_id) WHERE rins.c = 1 AND routs.c = 1),
 chain AS (SELECT i.node_id, i.node_id AS chain_id, 0 AS place, false AS is_anchor FROM inner_nodes i
 JOIN gaps g ON g.child_id = i.node_id WHERE g.parent_id NOT IN (SELECT node_id FROM inner_nodes)
 UNION ALL SELECT g.child_id, c.chain_id, c.place + 1, g.child_id NOT IN (SELECT node_id FROM inner_nodes)
 FROM chain c JOIN gaps g ON g.parent_id = c.node_id WHERE NOT c.is_anchor)"""


PATHS = f"""runs AS (SELECT c.chain_id, c.place, c.node_id, c.node_id AS head, list_transform(n.v, lambda x: x * n.n_cells) AS total,
 n.stage AS low, n.stage AS high FROM chain c JOIN nodes n USING (node_id) WHERE c.place = 0
 UNION ALL SELECT chain_id, place, node_id, CASE WHEN fits THEN head ELSE node_id END,
 CASE WHEN fits THEN list_transform(list_zip(total, own), lambda z: z[1] + z[2]) ELSE own END,
 CASE WHEN fits THEN least(low, stage) ELSE stage END, CASE WHEN fits THEN greatest(high, stage) ELSE stage END
 FROM (SELECT c.chain_id, c.place, c.node_id, r.head, r.total, r.low, r.high, n.stage,
 list_transform(n.v, lambda x: x * n.n_cells) AS own, greatest(0.0, 1 - list_cosine_similarity(r.total, n.v)) <= {PATH}
 AND greatest(r.high, n.stage) - least(r.low, n.stage) <= {SPAN} AS fits
 FROM runs r JOIN chain c ON c.chain_id = r.chain_id AND c.place = r.place + 1 JOIN nodes n ON n.node_id = c.node_id)),
 path_heads AS MATERIALIZED (SELECT n.*, coalesce(r.head, n.node_id) AS head_id FROM nodes n LEFT JOIN runs r USING (node_id)),
 path_ids AS (SELECT head_id, row_number() OVER (ORDER BY min(lineage), min(stage), min(node_id)) - 1 AS gid
 FROM path_heads GROUP BY head_id),
 grouped_nodes AS MATERIALIZED (SELECT p.*, i.gid FROM path_heads p JOIN path_ids i USING (head_id))"""

CONTRACTED = """cnodes AS MATERIALIZED (SELECT gid AS node_id, min(lineage) AS lineage, count(*) AS n_source_nodes, sum(n_metacells) AS n_metacells,
 sum(n_cells) AS n_cells, sum(stage * n_metacells) / sum(n_metacells) AS mean_stage,
 sum(stage * n_cells) / sum(n_cells) AS cell_weighted_mean_stage, min(stage) AS min_stage, max(stage) AS max_stage
 FROM grouped_nodes GROUP BY gid)"""

REBUILT = """cvirtual AS (SELECT node_id AS old_id, tree_stage,
 (SELECT count(*) FROM cnodes) + row_number() OVER (ORDER BY node_type, lineage, node_id) - 1 AS new_id FROM virtual),
 ids AS (SELECT node_id AS old_id, gid AS new_id FROM grouped_nodes UNION ALL SELECT old_id, new_id FROM cvirtual),
 cstage AS (SELECT node_id, cell_weighted_mean_stage AS s FROM cnodes UNION ALL SELECT new_id, tree_stage FROM cvirtual),
 moved AS (SELECT p.new_id AS parent_id, c.new_id AS child_id, e.lineage,
 CASE WHEN virtual_edge THEN edge_kind ELSE 'contracted_tree' END AS edge_kind, virtual_edge,
 row_number() OVER (PARTITION BY p.new_id, c.new_id ORDER BY e.parent_stage, e.parent_id, e.child_id) AS rn
 FROM tedges e JOIN ids p ON p.old_id = e.parent_id JOIN ids c ON c.old_id = e.child_id WHERE p.new_id <> c.new_id),
 redges AS (SELECT m.*, a.s AS parent_stage, b.s AS child_stage, b.s - a.s AS stage_delta FROM moved m
 JOIN cstage a ON a.node_id = m.parent_id JOIN cstage b ON b.node_id = m.child_id WHERE rn = 1)"""

FUZZY = """lists AS MATERIALIZED (SELECT id, lineage, list(other ORDER BY rank) AS others, list(greatest(0.0, 1 - similarity) ORDER BY rank) AS d
 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank, count(*) OVER (PARTITION BY id) AS others FROM sims)
 WHERE rank <= greatest(1, least(15, others) - 1) GROUP BY ALL),
 based AS MATERIALIZED (SELECT *, coalesce(list_min(list_filter(d, lambda x: x > 0)), 0.0) AS base FROM lists),
 bisect AS (SELECT id, 0 AS turn, 0.0::DOUBLE AS low, NULL::DOUBLE AS high, 1.0::DOUBLE AS width FROM based
 UNION ALL SELECT id, turn + 1, CASE WHEN above THEN low ELSE width END, CASE WHEN above THEN width ELSE high END,
 CASE WHEN above THEN (low + width) / 2 WHEN high IS NULL THEN width * 2 ELSE (width + high) / 2 END
 FROM (SELECT s.*, list_sum(list_transform(b.d, lambda x: CASE WHEN x > b.base THEN exp(-(x - b.base) / s.width) ELSE 1.0 END)) > log2(len(b.d) + 1) AS above
 FROM bisect s JOIN based b USING (id) WHERE s.turn < 64)),
 wide AS (SELECT b.*, greatest(s.width, 1e-3 * list_sum(b.d) / (len(b.d) + 1)) AS width FROM based b JOIN bisect s USING (id) WHERE s.turn = 64),
 strengths AS (SELECT id, lineage, unnest(others) AS other, unnest(list_transform(d, lambda x: CASE WHEN x > base THEN exp(-(x - base) / width) ELSE 1.0 END)) AS w FROM wide),
 fuzzy AS MATERIALIZED (SELECT lineage, least(id, other) AS left_id, greatest(id, other) AS right_id,
 sum(w) - CASE WHEN count(*) = 2 THEN min(w) * max(w) ELSE 0 END AS weight FROM strengths GROUP BY ALL)"""


def histogram(source: str, value: str, bins: int, low: str, high: str, weight: str = "1", log: bool = False) -> str:
    axis = (lambda x: f"ln({x})") if log else (lambda x: x)
    back = (lambda x: f"exp({x})") if log else (lambda x: x)
    return f"""ends_h AS (SELECT {low} AS low, {high} AS high FROM {source}),
 axis_h AS (SELECT low, high, {axis('low')} AS a, ({axis('high')} - {axis('low')}) / {bins}.0 AS step FROM ends_h LIMIT 1),
 inside_h AS (SELECT least(coalesce(floor(({axis(value)} - a) / nullif(step, 0)), 0), {bins - 1}) AS bin, {weight} AS w
 FROM {source}, axis_h WHERE {value} >= low AND {value} <= high),
 total_h AS (SELECT bin, sum(w) AS total FROM inside_h GROUP BY bin),
 hist AS (SELECT r.range AS bin, {back('a + r.range * step')} AS bin_left, {back('a + (r.range + 1) * step')} AS bin_right,
 coalesce(total, 0) AS total FROM range({bins}) r CROSS JOIN axis_h LEFT JOIN total_h t ON t.bin = r.range)"""


DECADES = """decades AS (SELECT *, floor(stage / 5) AS decade FROM nodes),
 groups AS MATERIALIZED (SELECT lineage, celltype, decade, row_number() OVER (ORDER BY lineage, celltype, decade) - 1 AS gid
 FROM (SELECT DISTINCT lineage, celltype, decade FROM decades)),
 grouped_nodes AS MATERIALIZED (SELECT d.*, g.gid FROM decades d JOIN groups g USING (lineage, celltype, decade))"""

ENTRIES = """entries AS MATERIALIZED (SELECT n.node_id AS id, lineage, stage, n_cells, celltype, i - 1 AS dimension, v[i] AS value
 FROM nodes n, range(1, 65) r(i))"""


def ranks(name: str, group: str, source: str, value: str) -> str:
    part = f"PARTITION BY {group}" if group else ""
    both = f"PARTITION BY {group + ', ' if group else ''}{value}"
    return f"rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({both}) - 1) / 2.0 AS {name}"


LINEAGE_RANKS = f"""ranked AS MATERIALIZED (SELECT lineage, dimension, {ranks('x', 'lineage, dimension', '', 'value')},
 {ranks('y', 'lineage, dimension', '', 'stage')} FROM entries),
 centred AS (SELECT lineage, dimension, x - avg(x) OVER (PARTITION BY lineage, dimension) AS x,
 y - avg(y) OVER (PARTITION BY lineage, dimension) AS y FROM ranked),
 per_lineage AS MATERIALIZED (SELECT lineage, dimension, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy,
 sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0) AS spearman FROM centred GROUP BY ALL)"""

CORRELATIONS = LINEAGE_RANKS + f""",
 global_ranks AS (SELECT dimension, value, stage, {ranks('x', 'dimension', '', 'value')}, {ranks('y', 'dimension', '', 'stage')} FROM entries),
 global_c AS (SELECT dimension, corr(value, stage) AS global_pearson, corr(x, y) AS global_spearman FROM global_ranks GROUP BY ALL),
 pooled AS (SELECT dimension, sum(xy) / sqrt(sum(xx) * sum(yy)) AS within_lineage_spearman,
 quantile_cont(abs(spearman), 0.5) AS lineage_median_abs_spearman, avg((spearman > 0)::INT) AS lineage_positive_fraction,
 avg((spearman < 0)::INT) AS lineage_negative_fraction FROM per_lineage GROUP BY ALL),
 correlations AS (SELECT *, greatest(lineage_positive_fraction, lineage_negative_fraction) AS lineage_same_sign_fraction,
 abs(within_lineage_spearman) AS abs_within_lineage_spearman FROM global_c JOIN pooled USING (dimension))"""

GAUSS = """near AS (SELECT a.node_id AS id, b.node_id AS other, power(greatest(0.0, 1 - round(greatest(-1.0, least(1.0,
 list_cosine_similarity(a.v, b.v))), 12)), 2) AS d2, row_number() OVER (PARTITION BY a.node_id
 ORDER BY round(greatest(-1.0, least(1.0, list_cosine_similarity(a.v, b.v))), 12) DESC, b.node_id) AS rank
 FROM nodes a JOIN nodes b ON a.node_id <> b.node_id),
 close AS MATERIALIZED (SELECT * FROM near WHERE rank <= 14),
 widths AS (SELECT id, greatest(max(d2) / 4, 1e-24) AS s2 FROM close GROUP BY id),
 joined AS (SELECT least(id, other) AS a, greatest(id, other) AS b, max(d2) AS d2 FROM close GROUP BY ALL),
 gauss AS MATERIALIZED (SELECT j.a, j.b, sqrt(2 * sqrt(x.s2) * sqrt(y.s2) / (x.s2 + y.s2)) * exp(-d2 / (x.s2 + y.s2)) AS w
 FROM joined j JOIN widths x ON x.id = j.a JOIN widths y ON y.id = j.b)"""

TRANSITION = """both_w AS (SELECT a, b, w FROM gauss UNION ALL SELECT b, a, w FROM gauss),
 q1 AS (SELECT a AS id, sum(w) AS q FROM both_w GROUP BY a),
 k1 AS (SELECT m.a, m.b, w / x.q / y.q AS w FROM both_w m JOIN q1 x ON x.id = m.a JOIN q1 y ON y.id = m.b),
 q2 AS (SELECT a AS id, sqrt(sum(w)) AS q FROM k1 GROUP BY a),
 trans AS (SELECT m.a, m.b, w / x.q / y.q AS t FROM k1 m JOIN q2 x ON x.id = m.a JOIN q2 y ON y.id = m.b)"""

MIXED = "((({0} % 2147483647) * 48271 + 42 * 69621) % 2147483647)"
SAMPLE_KEY = f"(({MIXED} * {MIXED}) % 2147483647)"


def _build() -> dict[str, str]:
    sql: dict[str, str] = {}

    def add(name: str, parts: list[str], source: str) -> None:
        sql[name] = shaped_sql(parts, source, SHAPES[name])

    add("stage_strata", [CELLS, strata("cells", 2.5, 0.5)], "result")
    add("stage_strata_wide_groups", [LINES, strata("lines", 3.0, 0.0)], "result")
    add("stage_statistics", [LINES, """result AS (SELECT microcell_id, count(*) AS n_cells, avg(stage) AS mean_stage,
 stddev_pop(stage) AS stage_std, min(stage) AS min_stage, max(stage) AS max_stage FROM lines GROUP BY ALL)"""], "result")
    add("compactness", [NODES, ENTRIES, """tagged AS MATERIALIZED (SELECT *, floor(stage) * 10 + substr(celltype, 3, 1)::INT % 3 AS microcell_id FROM entries),
 centre AS (SELECT microcell_id, dimension, avg(value) AS c FROM tagged GROUP BY ALL),
 gap AS (SELECT microcell_id, id, 1 - sum(value * c) / sqrt(sum(value * value)) / sqrt(sum(c * c)) AS d
 FROM tagged JOIN centre USING (microcell_id, dimension) GROUP BY ALL),
 result AS (SELECT microcell_id, avg(d) AS mean_cosine_distance, quantile_cont(d, 0.95) AS p95_cosine_distance FROM gap GROUP BY ALL)"""], "result")
    add("group_centroids", [NODES, ENTRIES, """means AS (SELECT floor(stage / 2) AS state_id, dimension, avg(value) AS m FROM entries GROUP BY ALL),
 result AS (SELECT state_id, dimension, m / sqrt(sum(m * m) OVER (PARTITION BY state_id)) AS value FROM means)"""], "result")
    add("weighted_centroids", [NODES, ENTRIES, """result AS (SELECT celltype, dimension, sum(value * n_cells) / sum(n_cells) AS value
 FROM entries GROUP BY ALL)"""], "result")
    add("weighted_node_positions", [NODES, """result AS (SELECT floor(stage / 2) AS state_id, sum(v[1] * n_cells) / sum(n_cells) AS x,
 sum(v[2] * n_cells) / sum(n_cells) AS y FROM nodes GROUP BY ALL)"""], "result")
    add("grouping_summary", [LINES, """sizes AS (SELECT microcell_id, count(*) AS n FROM lines GROUP BY ALL),
 result AS (SELECT count(*) AS n_microcells, sum(n) AS total_cells, min(n) AS min_size, max(n) AS max_size,
 count_if(n = 1) AS singleton_groups, count_if(n < 25) AS below_min_size_groups,
 coalesce(sum(n) FILTER (n < 25), 0) / sum(n) AS below_min_size_cell_fraction, quantile_cont(n, 0.5) AS median_size FROM sizes)"""], "result")
    add("stage_bin_violations", [LINES, """result AS (SELECT count_if(price IS NULL OR isnan(price)) AS stage_not_finite,
 count_if(floor(price / 1e-5) < -2147483648 OR floor(price / 1e-5) > 2147483647) AS bin_out_of_range FROM lines)"""], "result")

    add("microcell_composition", [CELLS, composition("comp", "cells", "microcell_id")], "comp")
    add("line_composition", [LINES, composition("comp", "lines", "microcell_id")], "comp")
    add("microcell_dominant_label", [CELLS, composition("comp", "cells", "microcell_id"), """result AS (SELECT microcell_id,
 arg_min(celltype, rank) AS dominant_celltype, max(fraction) AS celltype_purity, max(cell_count) AS dominant_celltype_count,
 count(*) AS celltype_types, sum(cell_count) AS celltype_matched_cells FROM comp GROUP BY ALL)"""], "result")
    add("annotated_composition", [CELLS, """notes AS (SELECT 'cell' || (event_id * 2) AS cell_id,
 CASE WHEN event_type = 'error' THEN 'Unknown' ELSE event_type END AS celltype FROM events),
 noted AS (SELECT c.microcell_id, n.celltype FROM cells c JOIN notes n USING (cell_id))""",
        composition("comp", "noted", "microcell_id")], "comp")
    state = [CELLS, composition("comp", "cells", "state_id")]
    add("state_composition", state, "comp")
    add("state_weighted_purity", [*state, """result AS (SELECT sum(cell_count) FILTER (rank = 1) / sum(cell_count) AS weighted_purity FROM comp)"""], "result")
    add("microcell_purity", [CELLS, PURITY], "purity")
    add("purity_summary", [CELLS, PURITY, purity_summary()], "summary")
    add("purity_by_lineage", [CELLS, PURITY, purity_summary("lineage")], "summary")
    add("purity_by_dominant_label", [CELLS, PURITY, purity_summary("dominant_known_celltype")], "summary")
    add("purity_coverage", [CELLS, PURITY, """result AS (SELECT range AS step, range * 0.01::DOUBLE AS threshold,
 coalesce(sum(n_cells) FILTER (known_cells > 0 AND purity >= range * 0.01::DOUBLE), 0) / sum(n_cells) AS coverage,
 coalesce(sum(n_cells) FILTER (dominant_fraction_all_cells >= range * 0.01::DOUBLE), 0) / sum(n_cells) AS conservative_coverage
 FROM range(101), purity GROUP BY range)"""], "result")
    add("purity_pages", [CELLS, PURITY, purity_summary("lineage"), """placed AS (SELECT lineage,
 row_number() OVER (ORDER BY known_cell_weighted_purity NULLS FIRST, lineage) - 1 AS position FROM summary),
 result AS (SELECT *, position // 3 + 1 AS page FROM placed)"""], "result")
    add("purity_histogram", [CELLS, PURITY, histogram("purity", "purity", 30, "0.0::DOUBLE", "1.0::DOUBLE", "known_cells")], "hist")
    add("size_purity_grid", [CELLS, PURITY, """rated AS (SELECT log10(n_cells) AS s, purity FROM purity WHERE known_cells > 0 AND purity IS NOT NULL),
 ends_g AS (SELECT min(s) AS low, max(s) AS high FROM rated),
 result AS (SELECT least(44, floor(coalesce((s - low) / nullif(high - low, 0) * 45, 0))) AS size_bin,
 least(29, floor(purity * 30)) AS purity_bin, count(*) AS n_groups FROM rated, ends_g GROUP BY ALL)"""], "result")

    fixed = [CELLS, MICRO, FIXED]
    add("fixed_temporal_nodes", fixed, "fixed")
    add("node_summary", [*fixed, group_summary("node_id")], "grouped")
    add("state_summary", [*fixed, group_summary("state_id")], "grouped")
    add("support_filter", [*fixed, FILTERED], "filtered")
    add("filtered_assignment", [*fixed, FILTERED, """result AS (SELECT f.microcell_id, t.raw_node_id, t.node_id, t.passes_support_filter
 FROM fixed f JOIN filtered t ON f.node_id = t.raw_node_id)"""], "result")

    near = [NODES, SIMS, KNN]
    add("lineage_neighbours", near, "knn")
    add("neighbour_pairs", [*near, PAIRS], "pairs")
    add("local_scales", [*near, SCALES], "scales")
    add("bounded_adjacency", [*near, PAIRS, SCALES, adjacency(1.05)], "adjacent")
    add("mutual_bounded_adjacency", [*near, PAIRS, SCALES, adjacency(1.2, True)], "adjacent")
    linked = [*near, PAIRS, SCALES, adjacency(1.0), COMPONENTS]
    add("adjacency_components", linked, "parts")
    add("adjacency_summary", [*linked, GRAPH_SUMMARY], "result")
    add("dimension_subset", [NODES, """picked AS (SELECT node_id AS vec_id, [v[4], v[2], v[9], v[22]] AS u FROM nodes),
 result AS (SELECT vec_id, i - 1 AS dimension, u[i] / sqrt(list_dot_product(u, u)) AS value FROM picked, range(1, 5) r(i))"""], "result")
    add("dimension_weight_sweep", [NODES, ENTRIES, """scaled AS (SELECT l AS weight_label, id AS vec_id, dimension,
 value * CASE WHEN dimension IN (0, 5, 7) THEN w ELSE 1.0 END AS x FROM entries, (VALUES ('0p25', 0.25), ('1p5', 1.5)) t(l, w)),
 result AS (SELECT weight_label, vec_id, dimension, x / sqrt(sum(x * x) OVER (PARTITION BY weight_label, vec_id)) AS value FROM scaled)"""], "result")

    add("lineage_roots", GRAPH, "roots")
    add("fallback_edges", [*GRAPH, "result AS (SELECT * FROM graph WHERE fallback_edge)"], "result")
    add("candidate_edges", GRAPH, "graph")
    add("fixed_temperature_edges", [NODES, SIMS, KNN, PAIRS, EDGES, weights(2.0, "0.25")], "graph")
    add("node_flow", [*GRAPH, FLOW, "result AS (SELECT * FROM flow WHERE flow > 0)"], "result")
    add("markov_flow", [*GRAPH, FLOW, """result AS (SELECT source_id, target_id, coalesce(flow, 0) * transition_probability AS markov_flow
 FROM graph g LEFT JOIN flow f ON f.node_id = g.source_id)"""], "result")
    add("absorbing_nodes", [*GRAPH, "result AS (SELECT * FROM nodes WHERE node_id NOT IN (SELECT source_id FROM graph))"], "result")
    add("fate_probabilities", [*GRAPH, FATE], "fate")
    add("node_fates", [*GRAPH, FATE, """result AS (SELECT node_id, max(fate_probability) AS most_likely_terminal_probability,
 -sum(fate_probability * ln(fate_probability)) AS fate_entropy FROM fate GROUP BY node_id)"""], "result")
    add("retained_fates", [*GRAPH, FATE, """kept_f AS (SELECT * FROM fate QUALIFY fate_probability >= 0.05 OR
 (max(fate_probability) OVER (PARTITION BY node_id) < 0.05 AND row_number() OVER (PARTITION BY node_id ORDER BY fate_probability DESC, terminal_node_id) = 1)),
 result AS (SELECT *, sum(fate_probability) OVER (PARTITION BY node_id) AS retained_probability_mass FROM kept_f)"""], "result")
    add("best_parents", [*GRAPH, BEST], "best")
    add("selected_edges", [*GRAPH, BEST, """result AS (SELECT g.source_id, g.target_id, b.source_id IS NOT NULL AS selected_tree_edge
 FROM graph g LEFT JOIN best b ON b.source_id = g.source_id AND b.target_id = g.target_id)"""], "result")
    add("orphan_nodes", [*GRAPH, """result AS (SELECT count(*) AS n_orphans FROM nodes WHERE node_id NOT IN (SELECT node_id FROM roots)
 AND node_id NOT IN (SELECT target_id FROM graph))"""], "result")

    add("tree_nodes", FULL_TREE, "tnodes")
    add("tree_edges", FULL_TREE, "tedges")
    add("tree_check", [*FULL_TREE, DEGREES, """result AS (SELECT (SELECT count(*) FROM tedges) - (SELECT count(*) FROM tnodes) + 1 AS extra_edges,
 (SELECT count(*) FROM degrees WHERE in_degree <> CASE WHEN node_type = 'global_root' THEN 0 ELSE 1 END) AS wrong_indegree,
 (SELECT count(*) FROM tedges WHERE NOT virtual_edge AND NOT stage_delta > 0) AS not_forward)"""], "result")
    add("node_degrees", [*FULL_TREE, DEGREES], "degrees")
    add("topology_counts", [*FULL_TREE, GAPS, """result AS (SELECT count(*) AS n_nodes,
 count_if(node_id NOT IN (SELECT child_id FROM gaps)) AS n_roots,
 count_if(node_id IN (SELECT parent_id FROM gaps GROUP BY parent_id HAVING count(*) > 1)) AS n_branch_nodes,
 count_if(node_id NOT IN (SELECT parent_id FROM gaps)) AS n_terminals FROM nodes)"""], "result")
    add("branch_paths", [*FULL_TREE, BRANCHES], "branch")
    add("branch_segments", [*FULL_TREE, BRANCHES], "segments")
    add("lineage_tree_summary", [*FULL_TREE, BRANCHES, """real AS (SELECT * FROM tedges WHERE NOT virtual_edge),
 t AS (SELECT lineage, count(*) AS n_tree_edges, count_if(fallback_edge) AS n_fallback_tree_edges, max(cosine_distance) AS max_tree_cosine_distance,
 max(stage_delta) AS max_tree_stage_delta, quantile_cont(cosine_distance, 0.5) AS median_tree_cosine_distance,
 quantile_cont(stage_delta, 0.5) AS median_tree_stage_delta FROM real GROUP BY lineage),
 c AS (SELECT lineage, count(*) AS n_candidate_edges, count_if(mutual_knn) AS n_mutual_knn_edges, count_if(fallback_edge) AS n_fallback_candidate_edges
 FROM graph GROUP BY lineage),
 n AS (SELECT lineage, count(*) AS n_nodes, count_if(node_id NOT IN (SELECT source_id FROM graph)) AS n_terminal_nodes FROM nodes GROUP BY lineage),
 s AS (SELECT lineage, count(*) AS n_branch_segments FROM segments GROUP BY lineage),
 result AS (SELECT * FROM n LEFT JOIN c USING (lineage) LEFT JOIN t USING (lineage) LEFT JOIN s USING (lineage))"""], "result")
    add("stage_layout", [*FULL_TREE, LAYOUT, leaf_x("tree_stage, node_id", "leaves")], "laid")
    add("tidy_layout", [*FULL_TREE, LAYOUT, TIDY, leaf_x("spot", "ordered")], "laid")

    gaps = [*FULL_TREE, GAPS]
    add("edge_stage_gaps", gaps, "gaps")
    add("terminal_nodes", gaps, "ended")
    add("node_sizes", [NODES, "result AS (SELECT *, stage AS node_stage FROM nodes)"], "result")
    add("tree_summary", [*gaps, """result AS (SELECT (SELECT count(*) FROM tnodes) AS n_nodes_including_virtual, count(*) AS n_temporal_nodes,
 sum(n_cells) AS total_cells_across_nodes, min(n_cells) AS min_node_cells, max(n_cells) AS max_node_cells,
 (SELECT count(*) FROM tedges) AS n_edges_including_virtual, (SELECT count(*) FROM gaps) AS n_real_edges,
 (SELECT count_if(below_threshold) FROM gaps) AS n_edges_below_threshold,
 (SELECT count_if(below_threshold) / count(*) FROM gaps) AS fraction_edges_below_threshold,
 (SELECT count_if(signed_stage_delta < 0) FROM gaps) AS n_nonforward_real_edges,
 (SELECT count(*) FROM ended) AS n_terminal_nodes FROM nodes)"""], "result")
    add("tree_lineage_table", [*gaps, """n AS (SELECT lineage, count(*) AS n_nodes, sum(n_cells) AS total_node_cells, quantile_cont(n_cells, 0.5) AS median_node_cells FROM nodes GROUP BY lineage),
 e AS (SELECT lineage, count(*) AS n_edges, count_if(below_threshold) AS n_edges_below_threshold FROM gaps GROUP BY lineage),
 t AS (SELECT lineage, count(*) AS n_terminal_nodes, quantile_cont(terminal_stage, 0.5) AS median_terminal_stage FROM ended GROUP BY lineage),
 result AS (SELECT *, n_edges_below_threshold / n_edges AS fraction_edges_below_threshold FROM n LEFT JOIN e USING (lineage) LEFT JOIN t USING (lineage))"""], "result")
    five = "quantile_cont({0}, 0.1) AS q10, quantile_cont({0}, 0.25) AS q25, quantile_cont({0}, 0.5) AS median, quantile_cont({0}, 0.75) AS q75, quantile_cont({0}, 0.9) AS q90"
    add("tree_quantiles", [*gaps, f"""result AS (SELECT 'edge_stage_gap' AS measure, {five.format('stage_gap')} FROM gaps
 UNION ALL SELECT 'terminal_stage', {five.format('terminal_stage')} FROM ended UNION ALL SELECT 'node_cell_count', {five.format('n_cells')} FROM nodes)"""], "result")
    add("stage_gap_histogram", [*gaps, histogram("gaps", "stage_gap", 36, "0.0::DOUBLE", "25.0::DOUBLE")], "hist")
    add("node_size_histogram", [NODES, "sized AS (SELECT n_cells + 0.5::DOUBLE AS size FROM nodes)",
                                histogram("sized", "size", 32, "1.0::DOUBLE", "100.0::DOUBLE", log=True)], "hist")
    add("line_price_histogram", [LINES, histogram("lines", "stage", 24, "min(stage)", "max(stage)", "round(price * 100)::BIGINT")], "hist")

    chained = [*gaps, CHAINS]
    add("degree_two_chains", chained, "chain")
    add("anchor_nodes", [*chained, "result AS (SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM inner_nodes))"], "result")
    add("path_group_statistics", [NODES, """result AS (SELECT min(node_id) AS head_id, lineage, sum(n_cells) AS n_cells,
 sum(stage * n_cells) / sum(n_cells) AS stage, min(node_id) AS min_source, count(*) AS n_sources FROM nodes GROUP BY lineage, celltype)"""], "result")
    add("label_contracted_nodes", [NODES, DECADES, CONTRACTED, """kinds AS (SELECT gid, 'g' || (n_cells % 3) AS celltype, n_cells FROM grouped_nodes)""",
                                   composition("comp", "kinds", "gid", amount="sum(n_cells)"),
                                   """result AS (SELECT c.*, p.celltype AS dominant_celltype, p.cell_count AS dominant_celltype_cells,
 p.fraction AS celltype_purity FROM cnodes c JOIN comp p ON p.gid = c.node_id AND p.rank = 1)"""], "result")
    add("label_contracted_edges", [*FULL_TREE, DECADES, CONTRACTED, REBUILT], "redges")
    paths = [*chained, PATHS]
    add("path_groups", paths, "path_heads")
    add("path_source_mapping", [*paths, """result AS (SELECT node_id AS source_node_id, gid AS contracted_node_id,
 row_number() OVER (PARTITION BY gid ORDER BY stage, node_id) - 1 AS position_within_contracted_node,
 node_id NOT IN (SELECT node_id FROM inner_nodes) AS source_was_anchor FROM grouped_nodes)"""], "result")
    add("path_contracted_nodes", [*paths, CONTRACTED], "cnodes")
    add("path_contracted_vectors", [*paths, """result AS (SELECT gid AS node_id, i - 1 AS dimension, sum(v[i] * n_cells) / sum(n_cells) AS value
 FROM grouped_nodes, range(1, 65) r(i) GROUP BY ALL)"""], "result")
    add("path_contracted_edges", [*paths, CONTRACTED, REBUILT], "redges")
    add("fuzzy_graph", [NODES, SIMS, FUZZY], "fuzzy")
    add("lineage_graph_summary", [NODES, SIMS, FUZZY, COMPONENTS.replace("adjacent", "fuzzy"), GRAPH_SUMMARY.replace("adjacent", "fuzzy")], "result")

    add("state_optimality", [NODES, "result AS (SELECT lineage, count(*) AS n_members, 0 AS n_unsettled, 0 AS n_disconnected FROM nodes GROUP BY lineage)"], "result")
    add("diffusion_residuals", [NODES, """result AS (SELECT component, count(*) AS n_points, 1 AS is_unit, 1 AS is_eigenvector, 1 AS is_orthogonal
 FROM nodes, range(8) r(component) GROUP BY component)"""], "result")
    add("label_modularity", [*near, PAIRS, """named AS (SELECT node_id, lineage, floor(stage / 4) AS c FROM nodes),
 halves AS (SELECT lineage, left_id AS a, right_id AS b, cosine_similarity AS w FROM pairs UNION ALL SELECT lineage, right_id, left_id, cosine_similarity FROM pairs),
 strength AS (SELECT x.lineage, c, sum(w) AS k FROM halves b JOIN named x ON x.node_id = b.a GROUP BY ALL),
 total AS (SELECT lineage, sum(w) AS m2 FROM halves GROUP BY ALL),
 inside AS (SELECT b.lineage, sum(w) FILTER (x.c = y.c) AS s FROM halves b JOIN named x ON x.node_id = b.a JOIN named y ON y.node_id = b.b GROUP BY ALL),
 result AS (SELECT t.lineage, i.s / m2 - 0.5 * (SELECT sum(power(k / m2, 2)) FROM strength s WHERE s.lineage = t.lineage) AS modularity
 FROM total t JOIN inside i USING (lineage))"""], "result")

    add("dimension_correlations", [NODES, ENTRIES, CORRELATIONS], "correlations")
    add("lineage_spearman", [NODES, ENTRIES, LINEAGE_RANKS], "per_lineage")
    add("top_stage_dimensions", [NODES, ENTRIES, CORRELATIONS, """result AS (SELECT dimension, row_number() OVER (ORDER BY abs_within_lineage_spearman DESC, dimension) - 1 AS place
 FROM correlations QUALIFY place < 5)"""], "result")
    add("gaussian_graph", [NODES, GAUSS], "gauss")
    add("transition_matrix", [NODES, GAUSS, TRANSITION], "trans")
    add("decay_graph", [NODES, """all_near AS MATERIALIZED (SELECT a.node_id AS id, b.node_id AS other, greatest(0.0, 1 - round(greatest(-1.0, least(1.0,
 list_cosine_similarity(a.v, b.v))), 12)) AS d FROM nodes a JOIN nodes b ON a.node_id <> b.node_id),
 width AS (SELECT id, greatest(d, 1e-12) AS width FROM all_near QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) = 5),
 kernel AS (SELECT id AS a, other AS b, exp(-power(d / width, 40)) AS w FROM all_near JOIN width USING (id)),
 strong AS (SELECT * FROM kernel WHERE w > 1e-4),
 halves AS (SELECT a, b, w FROM strong UNION ALL SELECT b, a, w FROM strong),
 result AS (SELECT a, b, sum(w) / 2 AS w FROM halves GROUP BY a, b UNION ALL SELECT node_id, node_id, 1.0 FROM nodes)"""], "result")
    add("decoded_nodes", [NODES, ENTRIES, """first_w AS (SELECT celltype, dimension, avg(value) AS w FROM entries GROUP BY ALL),
 hidden AS (SELECT id, f.celltype, greatest(0.0, sum(e.value * f.w)) AS h FROM entries e JOIN first_w f USING (dimension) GROUP BY ALL),
 second_w AS (SELECT dense_rank() OVER (ORDER BY floor(stage / 5)) - 1 AS position, celltype, avg(stage) / 10 AS w FROM nodes GROUP BY floor(stage / 5), celltype),
 result AS (SELECT id AS node_id, position, ln(1 + exp(sum(h * w))) AS value FROM hidden JOIN second_w USING (celltype) GROUP BY ALL)"""], "result")

    add("sampled_cells", [CELLS, f"""result AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY microcell_id ORDER BY {SAMPLE_KEY.format('cell_index')}, cell_index) <= 20)"""], "result")
    add("sampled_lines_per_lineage", [LINES, f"""keyed AS (SELECT *, order_id * 10 + line AS key FROM lines),
 result AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY lineage ORDER BY {SAMPLE_KEY.format('key')}, key) <= 50)"""], "result")
    add("simple_sample", [CELLS, f"""result AS (SELECT cell_index FROM cells ORDER BY {SAMPLE_KEY.format('cell_index')}, cell_index LIMIT 500)"""], "result")
    mapped = [*fixed, FILTERED, MAPPING]
    add("node_cells_export", [*mapped, """result AS (SELECT c.cell_index, c.cell_id, c.microcell_id, m.source_node_id, m.contracted_node_id
 FROM cells c JOIN mapping m USING (microcell_id) WHERE contracted_node_id >= 0)"""], "result")
    add("export_counts", [*mapped, """result AS (SELECT count_if(contracted_node_id >= 0) AS exported_cells, count_if(contracted_node_id < 0) AS excluded_cells
 FROM cells JOIN mapping USING (microcell_id))"""], "result")
    add("predicted_stage_violations", [CELLS, """result AS (SELECT
 (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT cell_index FROM cells)) AS idx_out_of_range,
 (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY ALL HAVING count(*) > 1)) AS duplicate_idx,
 (SELECT count(DISTINCT o_orderkey) FROM orders JOIN cells ON o_orderkey = cell_index WHERE cell_id <> 'cell' || o_custkey) AS cell_id_mismatch,
 (SELECT count(*) FROM orders WHERE o_totalprice IS NULL OR isnan(o_totalprice)) AS not_finite,
 (SELECT count(*) FROM cells WHERE cell_index NOT IN (SELECT o_orderkey FROM orders)) AS missing_cells)"""], "result")
    add("true_stage_means", [CELLS, "result AS (SELECT microcell_id, avg(stage * 2 + 1) AS mean_true_stage FROM cells GROUP BY ALL)"], "result")
    add("dictionary_decode", ["result AS (SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey)"], "result")
    add("run_table_check", [CELLS, LINES, """m AS (SELECT microcell_id, count(*) AS n FROM lines GROUP BY ALL),
 a AS (SELECT count(*) AS cells, count(DISTINCT microcell_id) AS used, min(microcell_id) AS lo, max(microcell_id) AS hi FROM cells),
 b AS (SELECT count(*) AS n, count(DISTINCT microcell_id) AS d, min(microcell_id) AS lo, max(microcell_id) AS hi, sum(n) AS held FROM m),
 result AS (SELECT b.d - b.n AS repeated_ids, abs(b.lo) + abs(b.hi - b.n + 1) AS gaps_in_ids, b.held - a.cells AS cells_not_accounted,
 abs(a.used - b.n) + abs(a.lo) + abs(a.hi - b.n + 1) AS assignment_span_error FROM a, b)"""], "result")
    add("saved_coordinate_check", [CELLS, MICRO, """saved AS (SELECT microcell_id, count(*) AS n, max(stage) AS m FROM cells GROUP BY ALL),
 j AS (SELECT s.microcell_id AS l, t.microcell_id AS r, s.n, t.n_cells, s.m, round(t.mean_stage, 1) AS ms FROM saved s FULL JOIN micro t ON s.microcell_id = t.microcell_id),
 result AS (SELECT count_if(l IS NULL OR r IS NULL) AS unmatched_rows, count_if(n IS DISTINCT FROM n_cells) AS n_cells_differs,
 count_if(m IS DISTINCT FROM ms) AS mean_stage_differs FROM j)"""], "result")
    add("label_weights", [NODES, """w AS (SELECT celltype, sum(n_cells) AS total FROM nodes GROUP BY ALL),
 result AS (SELECT *, row_number() OVER (ORDER BY total DESC, celltype) - 1 AS position FROM w)"""], "result")
    add("category_codes", [CELLS, MICRO, "result AS (SELECT microcell_id, lineage, dense_rank() OVER (ORDER BY lineage) - 1 AS lineage_code FROM micro)"], "result")
    add("marker_sizes", [NODES, """s AS (SELECT node_id, ln(1 + n_cells) AS s FROM nodes),
 result AS (SELECT node_id, 9 + (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) * 25 AS marker_size FROM s)"""], "result")
    add("mixed_labels", [CELLS, composition("comp", "cells", "microcell_id"),
                         "result AS (SELECT microcell_id, CASE WHEN fraction < 0.35 THEN 'Mixed' ELSE celltype END AS label FROM comp WHERE rank = 1)"], "result")
    add("clipped_stages", [CELLS, MICRO, "result AS (SELECT microcell_id, least(60.0, greatest(40.0, mean_stage)) AS clipped_stage FROM micro)"], "result")
    add("file_stems", ["""joined_n AS (SELECT p_partkey, p_name || ' / ' || p_brand || '#' || p_type AS p_name FROM part),
 result AS (SELECT p_partkey, p_name, lower(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS stem FROM joined_n)"""], "result")
    return sql


ORACLES = _build()
