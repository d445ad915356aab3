"""Connected components by hooking and shortcutting over a table of parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.session import Scratch

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the smallest node of the component.

    Each round lets every root hook onto its smallest neighbouring root, shortcuts the parents by
    pointer jumping until all point at roots, and contracts the edges to those between roots. Edges
    shrink with every round, so later rounds are cheap; a round needs only equi-joins of many rows to
    one parent, which adaptive execution can split at hot nodes. Nodes that hang on one smaller node
    are set aside first. Links with a null end and self-links give no edge. An empty table gives an
    empty table.
    """
    all_edges = scratch.cut(edges.where("u is not null and v is not null and u <> v").select(*_ordered()).distinct())
    degree = (
        all_edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).where("n = 1").select("node")
    )
    leaves = all_edges.join(degree, all_edges.v == degree.node, "left_semi")
    live = scratch.cut(all_edges.join(degree, all_edges.v == degree.node, "left_anti"))

    levels: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        if live.isEmpty():
            break
        both = live.select("u", "v").unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("parent"))
        parents = scratch.cut(parents)
        parents = _shortcut(parents, scratch)
        levels.append(parents)
        a, b = parents.select(F.col("node").alias("u"), F.col("parent").alias("ru")), parents.select(F.col("node").alias("v"), F.col("parent").alias("rv"))
        moved = live.join(a, "u").join(b, "v").where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        contracted = scratch.cut(moved.select(*_ordered()).distinct())
        scratch.drop(live)
        live = contracted
    else:
        raise RuntimeError("components didn't settle")

    roots = None
    for parents in reversed(levels):
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            up = roots.select(F.col("node").alias("parent"), "root")
            roots = parents.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    if roots is None:
        roots = all_edges.select(F.col("u").alias("node"), F.col("u").alias("root")).limit(0)
    # a leaf's smaller neighbour may itself be in no other edge: then it is the root
    up = roots.select(F.col("node").alias("u"), "root")
    hung = leaves.join(up, "u", "left").select("u", F.col("v").alias("node"), F.coalesce("root", "u").alias("root"))
    alone = hung.where("root = u").select(F.col("u").alias("node"), "root").distinct()
    core = roots.select("node", "root")
    return core.unionAll(hung.select("node", "root")).unionAll(alone.join(core.select("node"), "node", "left_anti"))


def _ordered() -> list[Column]:
    return [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]


def _shortcut(parents: DataFrame, scratch: Scratch) -> DataFrame:
    for _ in range(MAX_ROUNDS):
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = scratch.cut(parents.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
        settled = jumped.where("moved").isEmpty()
        scratch.drop(parents)
        parents = jumped.select("node", "parent")
        scratch.paths[id(parents)] = scratch.paths.pop(id(jumped))
        if settled:
            return parents
    raise RuntimeError("parents didn't settle")


def tie_groups(df: DataFrame, id_col: str, keys: list[Column], scratch: Scratch) -> DataFrame:
    """(id_col, group): records that share a value of one of the keys, directly or over other records.

    A key is a string column, null where it ties nothing. ``group`` is the smallest key of the group,
    written ``<number of the key>:<value>``, so that a value of the first key comes before all others;
    it is null for a record without any key, which is a group of its own. Rows with the same id each get a row.
    """
    named = [F.concat(F.lit(f"{i}:"), k) for i, k in enumerate(keys)]
    rows = df.select(F.col(id_col), *[k.alias(f"_k{i}") for i, k in enumerate(named)])
    names = [f"_k{i}" for i in range(len(keys))]
    first = rows.withColumn("_key", F.coalesce(*names))
    others = F.filter(F.array(*names), lambda k: k.isNotNull())
    edges = first.where(F.size(others) > 1).select("_key", F.explode(others).alias("v")).where("_key <> v").select(F.col("_key").alias("u"), "v")
    roots = scratch.cut(connected_components(edges, scratch))
    up = roots.select(F.col("node").alias("_key"), "root")
    return first.select(id_col, "_key").join(up, "_key", "left").select(id_col, F.coalesce("root", "_key").alias("group"))
