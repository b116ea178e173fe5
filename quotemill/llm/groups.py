"""Groups of records that are linked directly or through others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.session import Stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each linked node with the smallest node of its group: node, component.

    Boruvka's hooking: every component selects its smallest outgoing edge, by (smaller end, larger
    end). The only cycles that this order leaves are pairs that select each other; of them the
    smaller end becomes the root. Pointer doubling collapses the trees, edges take their ends'
    roots, and loops and repeated edges drop out, until no edge is left. As the smallest node of a
    group is always an end of its tree's smallest edge, roots are smallest nodes.

    Each round at least halves the components, so there are at most log2(nodes) rounds of log2(tree
    height) joins; every step is written to the shared folder, so a lost executor costs one step.
    Selection is a map-side reduced aggregate, so a node with a third of all edges is no hot task;
    joins carry one row a component on their right side. Nulls and self links link nothing. An
    empty input gives no rows. Nothing is collected but emptiness and counts.
    """
    u, v = F.col(a), F.col(b)
    edges = Stored(links.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct())
    maps: list[Stored] = []
    while not edges.df.isEmpty():
        both = edges.df.unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        chosen = both.groupBy("u").agg(F.min(F.struct(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))).alias("e"))
        hooks = Stored(chosen.select(F.col("u").alias("node"), F.when(F.col("e.x") == F.col("u"), F.col("e.y")).otherwise(F.col("e.x")).alias("parent")))
        # Two that chose each other: the smaller one is the root.
        up = hooks.df.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        rooted = hooks.df.join(up, "parent").select("node", F.when((F.col("grand") == F.col("node")) & (F.col("node") < F.col("parent")), F.col("node")).otherwise(F.col("parent")).alias("parent"))
        pointers = _collapse(Stored(rooted))
        hooks.drop()
        at = lambda end, to: pointers.df.select(F.col("node").alias(end), F.col("parent").alias(to))
        moved = edges.df.join(at("u", "ru"), "u").join(at("v", "rv"), "v").filter("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        after = Stored(moved)
        edges.drop()
        edges, maps = after, [*maps, pointers]
    if not maps:
        return edges.df.select(F.col("u").alias("node"), F.col("u").alias("component"))
    # Later rounds have few nodes, so the maps are put together from the last one back.
    whole = maps[-1].df
    for m in reversed(maps[:-1]):
        later = whole.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        whole = m.df.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent"))
    return whole.withColumnRenamed("parent", "component")


def _collapse(pointers: Stored) -> Stored:
    """Pointer doubling until every node points to its root."""
    while True:
        up = pointers.df.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        doubled = Stored(pointers.df.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
        pointers.drop()
        if doubled.df.filter("moved").isEmpty():
            return doubled
        pointers = doubled


def decided(pairs: DataFrame, a: Column, b: Column, decision: Column, link: tuple[str, ...], block: tuple[str, ...]) -> DataFrame:
    """The unordered pairs that some row decides to link and none, in either order, blocks: a, b. Self pairs, null ends and null decisions decide nothing."""
    rows = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), decision.alias("d"), (a.isNotNull() & b.isNotNull() & (a != b)).alias("ok")).filter("ok")
    votes = rows.groupBy("a", "b").agg(F.max(F.col("d").isin(*link)).alias("yes"), F.max(F.col("d").isin(*block)).alias("no"))
    return votes.filter(F.coalesce("yes", F.lit(False)) & ~F.coalesce("no", F.lit(False))).select("a", "b")


def stars(rows: DataFrame, group: str, node: str) -> DataFrame:
    """Links that hold the nodes of each group together without pairs of them: each node to the group's smallest one. Null and blank groups link nothing."""
    rows = rows.filter(F.trim(F.col(group)) != "").select(group, node).distinct()
    centre = rows.groupBy(group).agg(F.min(node).alias("a"))
    return rows.join(centre, group).select("a", F.col(node).alias("b")).filter("a != b")
