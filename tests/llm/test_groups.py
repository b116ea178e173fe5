"""Groups of linked records against union-find."""

import random

from pyspark.sql import functions as F

from quotemill.llm import groups


def _union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _found(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string").withColumns({"u": F.lit("clash"), "node": F.lit("clash")})
    return {r["node"]: r["component"] for r in groups.components(df).collect()}


def test_random_graphs(spark):
    for seed, n, m in ((1, 60, 40), (2, 80, 120)):
        rng = random.Random(seed)
        edges = [(f"k{rng.randrange(n):03}", f"k{rng.randrange(n):03}") for _ in range(m)]
        assert _found(spark, edges) == _union_find(edges)


def test_chains_stars_and_repeats(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(100)]
    star = [("s000", f"s{i:03}") for i in range(1, 80)]
    edges = chain + star + chain[:10] + [("z", "z"), (None, "c000"), ("c001", None)]
    random.Random(3).shuffle(edges)
    assert _found(spark, edges) == _union_find(edges)


def test_order_and_partitions_do_not_matter(spark):
    edges = [("b", "a"), ("c", "b"), ("x", "y")]
    df = spark.createDataFrame(edges, "a string, b string")
    got = [{r["node"]: r["component"] for r in groups.components(d).collect()} for d in (df, df.repartition(7), df.orderBy(F.desc("b")))]
    assert got[0] == got[1] == got[2] == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_nothing_linked(spark):
    assert groups.components(spark.createDataFrame([], "a string, b string")).count() == 0
    assert _found(spark, [("a", "a"), (None, None)]) == {}


def test_blocks_win_in_either_order(spark):
    rows = [("a", "b", "match"), ("b", "a", "manual-block"), ("c", "d", "no-match"), ("d", "c", "manual-match"), ("e", "f", None), ("g", "g", "match"), (None, "h", "match"), ("i", "j", "match"), ("i", "j", "match")]
    df = spark.createDataFrame(rows, "x string, y string, d string")
    got = groups.decided(df, F.col("x"), F.col("y"), F.col("d"), ("match", "manual-match"), ("manual-block",))
    assert {(r["a"], r["b"]) for r in got.collect()} == {("c", "d"), ("i", "j")}


def test_stars(spark):
    rows = [("e1", "b"), ("e1", "a"), ("e1", "c"), ("e1", "c"), ("e2", "d"), (None, "e"), (" ", "f"), (" ", "g")]
    got = groups.stars(spark.createDataFrame(rows, "e string, k string"), "e", "k")
    assert {(r["a"], r["b"]) for r in got.collect()} == {("a", "b"), ("a", "c")}
