"""Prefix trie of conversations by fixed-length block hashing.

*Digests.* Every turn has two 64-bit digests of its place, role and text. A prefix's digest is the bitwise
exclusive or of its turns' digests (128 bits in all), so prefixes come from running aggregates and no chain of turns
is walked one after another.

*Blocks.* `BLOCK` successive turns make a block, with the digest of the prefix before and of the one behind it.
Conversations are grouped by the digest before. If all members of a group have the same block there, its inner prefixes
are the same for all: only one member's turns are spread out, with the group's size as weight. Only where siblings
diverge inside the block (or some end in it) are the turns of all members spread out and grouped again.

*Subtrees.* A node belongs to its smallest member, so the nodes of a conversation are one path that ends
where the conversation ends. A subtree sum is then a sum over the node's members: each member brings the total of
its own path, less what the smallest member's path holds above the node. Hence sums over subtrees are
grouped sums like all others, without a loop over depths.

*Ends.* The ids that end in a node are range-sorted, joined to pieces of text by the task that holds them, and
only the pieces are hashed in order, so no task reads all conversations of a popular node as rows.

Edge cases: conversations are ordered by turn (null first); equal turns by role, then by digest of the text; null roles and texts count as empty
ones; repeated rows are turns of their own; rows without a conversation id are not read; a conversation without turns
is a member of the root; a table without conversations gives an empty table (there is no member to name a root);
further columns, whatever their names, are not read. Turns of any length enter by digest and number of code points.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.core import is_empty, materialize, shuffle_partitions
from arbora.llm.registry import query, table
from arbora.operators.ordering import number_rows, running_sum

BLOCK = 4
STRETCH = 1_000  # blocks whose digests one task runs through; longer conversations are carried on by stretches
PIECE = 8_000  # ids that are joined to one piece of text

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, d1, d2, size): every turn with its place from 1 on, digests of role and text, and code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    cut = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).alias("_turn"), role.alias("_role"),
        F.xxhash64(F.lit(1), role, text).alias("d1"), F.xxhash64(F.lit("b"), text, role).alias("d2"), F.length(text).cast("long").alias("size"))
    order = ["_turn", "_role", "d1", "d2"]
    return number_rows(cut, ["conv"], order, "place").select("conv", (F.col("place") + 1).alias("place"), "d1", "d2", "size")


def rebuilt(found: DataFrame, share_mod: int = 100, heads_mod: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv, d, d1, d2, size) of the rebuilt turns, d from 1 on, and (conv, n) of all conversations, turnless ones too.

    Conversation c begins with the first h = crc32(c) % `heads_mod` turns of conversation c - c % `share_mod`,
    followed by its own turns after its first h. Shared heads have fewer than `heads_mod` turns each.
    """
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % heads_mod
    sizes = materialize(found.groupBy("conv").agg(F.max("place").alias("n")).withColumn("h", head)
                        .withColumn("base", F.col("conv") - F.col("conv") % share_mod))
    heads = (found.where(f"place < {heads_mod} and conv % {share_mod} = 0").groupBy(F.col("conv").alias("base"))
             .agg(F.collect_list(F.struct("place", "d1", "d2", "size")).alias("heads")))
    taken = materialize(sizes.join(heads, "base", "left").select(
        "conv", "n", "h", F.filter(F.coalesce("heads", F.array()), lambda x: x["place"] <= F.col("h")).alias("heads")))
    begun = taken.select("conv", F.explode("heads").alias("x")).select("conv", F.col("x.place").alias("d"), "x.d1", "x.d2", "x.size")
    own = (found.join(taken.select("conv", "h", F.size("heads").alias("_given")), "conv").where("place > h")
           .select("conv", (F.col("place") - F.col("h") + F.col("_given")).alias("d"), "d1", "d2", "size"))
    length = F.size("heads") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return begun.unionByName(own), taken.select("conv", length.cast("long").alias("n"))


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, j, turns, before, behind): blocks with their turns in order and the prefix digests around them."""
    placed = rows.select("conv", "d", F.xxhash64("d", "d1", "d2").alias("x"), F.xxhash64("d2", "d", "d1", F.lit("b")).alias("y"), "size")
    made = placed.groupBy("conv", F.expr(f"(d - 1) div {block}").alias("j")).agg(
        F.sort_array(F.collect_list(F.struct("d", "x", "y", "size"))).alias("turns"), F.bit_xor("x").alias("_x"), F.bit_xor("y").alias("_y"))
    made = made.withColumn("_part", F.expr(f"j div {STRETCH}"))
    upto = Window.partitionBy("conv", "_part").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x, y = F.bit_xor("_x").over(upto), F.bit_xor("_y").over(upto)
    run = made.withColumn("_bx", x).withColumn("_by", y)
    long = materialize(rows.where(F.col("d") > block * STRETCH).select("conv").distinct())
    if not is_empty(long):
        earlier = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = (placed.join(long, "conv", "left_semi").groupBy("conv", F.expr(f"(d - 1) div {block * STRETCH}").alias("_part"))
                   .agg(F.bit_xor("x").alias("_cx"), F.bit_xor("y").alias("_cy"))
                   .select("conv", "_part", F.bit_xor("_cx").over(earlier).alias("_cx"), F.bit_xor("_cy").over(earlier).alias("_cy")))
        run = run.join(carried, ["conv", "_part"], "left")
        for c in "xy":
            run = run.withColumn(f"_b{c}", F.col(f"_b{c}").bitwiseXOR(F.coalesce(f"_c{c}", F.lit(0).cast("long"))))
    return run.select(
        "conv", "j", "turns", F.struct(F.col("_bx").bitwiseXOR(F.col("_x")).alias("x"), F.col("_by").bitwiseXOR(F.col("_y")).alias("y")).alias("before"),
        F.struct(F.col("_bx").alias("x"), F.col("_by").alias("y")).alias("behind"))


def _spread(blocks: DataFrame, *columns: str) -> DataFrame:
    """One row per turn of the blocks: prefix digests `parent` and `node`, depth and size, with `columns`."""
    state = F.struct(F.col("before").alias("parent"), F.col("before").alias("node"))
    step = lambda s, t: F.struct(s["node"].alias("parent"), F.struct(
        s["node"]["x"].bitwiseXOR(t["x"]).alias("x"), s["node"]["y"].bitwiseXOR(t["y"]).alias("y")).alias("node"))
    prefix = lambda i: F.aggregate(F.slice("turns", 1, i), state, step)
    made = F.transform("turns", lambda t, i: F.struct(t["d"].alias("depth"), t["size"].alias("size"), prefix(i + 1).alias("p")))
    return blocks.select(*columns, F.explode(made).alias("t")).select(
        *columns, F.col("t.depth").alias("depth"), F.col("t.size").alias("size"), F.col("t.p.parent").alias("parent"), F.col("t.p.node").alias("node"))


def _grouped(blocks: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Turn rows with the columns `conv` and `sums`: of one member where a whole group has the same block, else of all."""
    key = ["before"]
    shared = blocks.where("j > 0")  # the first blocks begin at the root and always differ somewhere
    groups = (shared.groupBy(*key).agg(F.min("conv").alias("_least"), F.min("behind.x").alias("_lx"), F.max("behind.x").alias("_hx"),
                                       F.min("behind.y").alias("_ly"), F.max("behind.y").alias("_hy"),
                                       *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
              .withColumn("_same", (F.col("_lx") == F.col("_hx")) & (F.col("_ly") == F.col("_hy"))))
    met = shared.join(groups, key)
    alike = met.where("_same and conv = _least").select(*blocks.columns, *[F.col(f"_{n}").alias(f"s_{n}") for n in sums])
    unlike = met.where("not _same").select(*blocks.columns, *[c.alias(f"s_{n}") for n, c in sums.items()])
    first = blocks.where("j = 0").select("*", *[c.alias(f"s_{n}") for n, c in sums.items()])
    return _spread(first.unionByName(alike).unionByName(unlike), "conv", *[f"s_{n}" for n in sums])


def _pieces(batches):
    """Runs of the ids of one node, joined by commas; input is sorted by node and id."""
    node, first, ids = None, None, []

    def made():
        return pa.RecordBatch.from_pylist([{"x": node[0], "y": node[1], "first": first, "ids": ",".join(map(str, ids))}], schema)

    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        for x, y, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (x, y) != node or len(ids) >= PIECE:
                if ids:
                    yield made()
                node, first, ids = (x, y), conv, []
            ids.append(conv)
    if ids:
        yield made()


def _hashed(batches):
    """SHA-256 of the pieces of every node; input is sorted by node and first id."""
    node, state = None, None
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        out = []
        for x, y, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (x, y) != node:
                if node is not None:
                    out.append({"x": node[0], "y": node[1], "ends_sha256": state.hexdigest()})
                node, state = (x, y), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if node is not None:
        yield pa.RecordBatch.from_pylist([{"x": node[0], "y": node[1], "ends_sha256": state.hexdigest()}], schema)


def ends(finals: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv): the digest of the ascending ids that end in a node."""
    rows = finals.select("node.x", "node.y", "conv")
    sliced = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "x", "y", "conv").sortWithinPartitions("x", "y", "conv")
    pieces = sliced.mapInArrow(_pieces, "x bigint, y bigint, first bigint, ids string")
    whole = pieces.repartition("x", "y").sortWithinPartitions("x", "y", "first").select("x", "y", "ids")
    return whole.mapInArrow(_hashed, "x bigint, y bigint, ends_sha256 string").select(F.struct("x", "y").alias("node"), "ends_sha256")


def trie(rows: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie over (conv, d, d1, d2, size) and (conv, n), root first in no order.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)
    """
    blocks = materialize(blocks_of(materialize(rows), block))
    sizes = materialize(sizes)
    zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    counted = _grouped(blocks, {"n": F.lit(1).cast("long")})
    nodes = materialize(counted.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("size").alias("size"),
        F.min("conv").alias("conv"), F.sum("s_n").alias("n_convs")))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    weight = (F.col("n_convs") - 1) * F.col("size")
    known = materialize(nodes.join(children, "node", "left").select(
        "node", "parent", "depth", "conv", "n_convs", weight.alias("weight"), F.coalesce("n_children", F.lit(0)).alias("n_children")))
    # What every conversation brings to the subtrees that hold it: the total of its own path, and a leaf or none.
    own = materialize(known.groupBy("conv").agg(F.sum("weight").alias("total"), F.count_if(F.col("n_children") == 0).alias("leaf")))
    brought = blocks.join(own, "conv", "left").withColumn("total", F.coalesce("total", F.lit(0))).withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    summed = _grouped(brought, {"total": F.col("total"), "leaf": F.col("leaf")}).groupBy("node").agg(
        F.sum("s_total").alias("total"), F.sum("s_leaf").alias("n_leaves"))
    finals = sizes.where("n = 0").select(zero.alias("node"), "conv").unionByName(
        blocks.groupBy("conv").agg(F.max_by("behind", "j").alias("node")).select("node", "conv"))
    sealed = materialize(ends(finals))
    # One row for the root; its members are all conversations.
    root = (sizes.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
            .crossJoin(own.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("_leaves")))
            .crossJoin(known.where("depth = 1").agg(F.count("*").alias("n_children"))))
    root = root.select(zero.alias("node"), F.lit(0).cast("long").alias("depth"), "conv", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
                       F.greatest("_leaves", F.lit(1)).alias("n_leaves"), F.col("total").alias("saved_tokens"))
    top = root.select(F.col("conv").alias("_top"))
    inner = known.select(F.col("node").alias("parent"), F.col("conv").alias("_parent_conv"))
    path = running_sum(known, ["conv"], ["depth"], "weight", "_upto")
    placed = path.withColumn("_above", F.col("_upto") - F.col("weight")).join(summed, "node")
    deep = placed.where("depth > 1").join(inner, "parent").withColumnRenamed("_parent_conv", "parent_conv_id")
    shallow = placed.where("depth = 1").crossJoin(F.broadcast(top)).withColumnRenamed("_top", "parent_conv_id")
    columns = ["node", "depth", "conv", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("total") - F.col("_above")).alias("saved_tokens")]
    every = root.unionByName(deep.select(*columns)).unionByName(shallow.select(*columns))
    return (every.join(sealed, "node", "left")
            .select(F.col("conv").alias("conv_id"), *[F.col(c).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
                    F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The trie of the conversations as they stand."""
    found = turns(conversations, key, turn, role, text).withColumnRenamed("place", "d")
    return trie(found, found.groupBy("conv").agg(F.max("d").alias("n")), block)


_TWIN = """WITH tab AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i:
        xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), x::BIGINT)) t),
    t AS (SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) p,
        {'r': coalesce(role, ''), 't': coalesce(text, '')} v FROM conversations WHERE conv_id IS NOT NULL),
    s AS (SELECT c, list(v ORDER BY p) vs FROM t GROUP BY c),
    h AS (SELECT c, vs, xor(4294967295::BIGINT, list_reduce(list_transform(range(length(c::VARCHAR)), lambda i: ascii((c::VARCHAR)[i + 1])::BIGINT),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) % 6 h FROM s, tab),
    b AS (SELECT a.c, list_concat(coalesce(b.vs[1:a.h], []), a.vs[a.h + 1:]) vs FROM h a LEFT JOIN s b ON b.c = a.c - a.c % 100),
    m AS (SELECT c, vs[1:d] k, d, len(vs) = d e FROM (SELECT c, vs, unnest(range(len(vs) + 1)) d FROM b)),
    n AS (SELECT k, d, min(c) c, count(*) n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE e), '') ends,
        CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(k[d].t) END w FROM m GROUP BY k, d),
    ch AS (SELECT k[1:d - 1] k, count(*) x FROM n WHERE d > 0 GROUP BY 1),
    sub AS (SELECT a.k, sum(b.w) w, count(*) FILTER (WHERE ch.x IS NULL) l FROM n a JOIN n b ON b.d >= a.d AND b.k[1:a.d] = a.k
        LEFT JOIN ch ON ch.k = b.k GROUP BY a.k)
    SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(ch.x, 0) AS n_children,
        sub.l AS n_leaves, sub.w::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM n LEFT JOIN n p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.k[1:n.d - 1] LEFT JOIN ch ON ch.k = n.k JOIN sub ON sub.k = n.k"""


@query("op13_prefix_trie", _TWIN)
def op13_prefix_trie(spark, folder):
    """Nodes of the trie of all rebuilt conversations."""
    return trie(*rebuilt(turns(table(spark, folder, "conversations"))))
