"""Packing keeps every token in its place and fills containers; mixing reaches its shares within the caps."""

import random

import pytest
from pyspark.sql import functions as F

from quotemill.llm import mixing, packing, tokens


def _sizes(spark, n=3_000, seed=1):
    rng = random.Random(seed)
    rows = [(i, 0 if i % 97 == 0 else max(1, int(rng.lognormvariate(5, 1))), "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, n_tokens int, part string")


def test_nothing_lost_split_only_if_longer_and_well_filled(spark):
    rows, df = _sizes(spark)
    limits = spark.createDataFrame([("small", 256, "x"), ("large", 4096, "x"), ("none", None, "x"), ("zero", 0, "x")], "limit_name string, capacity_tokens int, shard string")
    placed = packing.pack(df, limits).toPandas()
    for name, capacity in (("small", 256), ("large", 4096)):
        mine = placed[placed.limit_name == name]
        sizes = {i: n for i, n, _ in rows if n}
        assert mine.groupby("doc_id").n_tokens.sum().to_dict() == sizes
        assert set(mine.groupby("doc_id").size().loc[lambda s: s > 1].index) == {i for i, n in sizes.items() if n > capacity}
        assert (mine.groupby("container_id").n_tokens.sum() <= capacity).all()
        for _, g in mine.sort_values("at_token").groupby("container_id"):
            assert g.at_token.tolist() == [0, *g.n_tokens.cumsum().tolist()[:-1]]
        for _, g in mine.sort_values("part").groupby("doc_id"):
            assert g.first_token.tolist() == [k * capacity for k in range(len(g))]
        assert sum(sizes.values()) / (mine.container_id.nunique() * capacity) > 0.97
    assert set(placed.limit_name) == {"small", "large"}
    report = {r["limit_name"]: r for r in packing.report(packing.pack(df, limits)).collect()}
    assert report["large"]["tokens"] == sum(n for _, n, _ in rows)


def test_packing_edges(spark):
    limits = spark.createDataFrame([("one", 10)], "limit_name string, capacity_tokens int")
    empty = spark.createDataFrame([], "doc_id long, n_tokens int")
    assert packing.pack(empty, limits).count() == 0
    same = spark.createDataFrame([(1, 10), (1, 10), (2, 25), (None, 3), (3, None)], "doc_id long, n_tokens int")
    got = packing.pack(same, limits).toPandas()
    assert sorted(got[got.doc_id == 2].n_tokens) == [5, 10, 10] and len(got) == 5


def test_each_placement_minimises_the_sum_of_squares():
    rng = random.Random(9)
    packer = packing.Packer(20, levels=20)
    for i in range(300):
        size, before = rng.randint(1, 20), list(packer.fills)

        def squares(fills):
            counts = [0] * 20
            for f in fills:
                if 0 < f < 20:
                    counts[f] += 1
            return sum(c * c for c in counts)

        options = [squares([*before, size])] + [squares([*before[:k], f + size, *before[k + 1 :]]) for k, f in enumerate(before) if 0 < f < 20 and f + size <= 20]
        packer.place(i, size)
        assert squares(packer.fills) == min(options)
        assert packer.levels.tolist()[:20] == [sum(f == k for f in packer.fills) if k else 0 for k in range(20)]


def test_token_counts(spark):
    df = spark.createDataFrame([("Hello world, hello.",), ("",), (None,), ("<|endoftext|>",), ("x " * 50_000,)], "text string")
    got = [r["n"] for r in df.select(tokens.count(F.col("text")).alias("n")).collect()]
    assert got[0] == 5 and got[1] == 0 and got[2] == 0 and got[3] > 1 and got[4] >= 50_000


def _corpus(spark, n=4_000):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        source = rng.choices(["big", "mid", "tiny"], [0.8, 0.17, 0.03])[0]
        rows.append((i, source, rng.choice(["en", "fr", None]), rng.choice(["a", "b"]), max(1, int(rng.lognormvariate(5, 1))), 7))
    return rows, spark.createDataFrame(rows, "doc_id long, source string, language string, topic string, n_tokens int, copies int")


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 3)]


def test_shares_are_reached_within_caps(spark):
    _, df = _corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets)
    got = {r["source"]: r for r in mixing.report(mixed, targets).collect()}
    for source, share, cap in TARGETS[:3]:
        assert got[source]["actual_share"] == pytest.approx(share / 0.9, abs=0.01)
        assert got[source]["most_copies"] <= cap
    assert got["absent"]["actual_share"] == 0 and got["absent"]["documents"] == 0
    assert mixed.groupBy("doc_id").count().filter("count > 1").count() == 0
    assert mixing.mix(df.repartition(9), targets).exceptAll(mixed).count() == 0


def test_budget_beyond_the_caps_is_reported_not_broken(spark):
    rows, df = _corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, budget=10.0 * sum(r[4] for r in rows))
    got = {r["source"]: r for r in mixing.report(mixed, targets).collect()}
    assert all(got[s]["most_copies"] == cap for s, _, cap in TARGETS[:3])


def test_mixing_edges(spark):
    _, df = _corpus(spark, 50)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mixing.mix(df.limit(0), targets).count() == 0
    assert mixing.mix(df, targets.limit(0)).count() == 0
    assert mixing.mix(df.withColumn("source", F.lit(None).cast("string")), targets).count() == 0
    assert mixing.mix(df.withColumn("n_tokens", F.lit(0)), targets).count() == 0


def test_raking_meets_all_margins_without_caps():
    cells = {("s", "x", "t"): 10.0, ("s", "y", "t"): 20.0, ("r", "x", "t"): 30.0, ("r", "y", "t"): 40.0}
    use = mixing.rake(cells, [{"s": 0.5, "r": 0.5}, {"x": 0.4, "y": 0.6}, {"t": 1.0}], dict.fromkeys(cells, 100.0), 100.0)
    by = lambda axis, v: sum(n * use[c] for c, n in cells.items() if c[axis] == v)
    assert by(0, "s") == pytest.approx(50, rel=1e-3) and by(1, "x") == pytest.approx(40, rel=1e-3)


def test_a_cell_is_cut_as_finely_as_its_documents(spark):
    # One cell of 20,000 documents: steps of a 256th would be 78 documents wide.
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("en").alias("language"), F.lit("x").alias("topic"), (F.col("id") % 7 + 1).cast("int").alias("n_tokens"))
    df = df.unionByName(df.withColumn("doc_id", F.col("doc_id") + 20_000).withColumn("source", F.lit("b")))
    targets = spark.createDataFrame([("a", 0.7123, 1), ("b", 0.2877, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r["actual_share"] for r in mixing.report(mixing.mix(df, targets), targets).collect()}
    assert abs(got["a"] - 0.7123) < 7 / 100_000 and abs(got["b"] - 0.2877) < 7 / 100_000


def test_faults_are_found(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 12), (3, 4)], "doc_id long, n_tokens int")
    limits = spark.createDataFrame([("l", 10)], "limit_name string, capacity_tokens int")
    good = packing.pack(sizes, limits)
    assert tuple(packing.faults(good, sizes, limits).first()) == ("l", 0, 0, 0, 0)
    assert tuple(packing.faults(good.filter("doc_id != 3"), sizes, limits).first())[1] == 4
    one = good.withColumns({"container_id": F.lit("c")})
    assert tuple(packing.faults(one, sizes, limits).first())[2] == 1
    split = spark.createDataFrame([("l", 10, "c", 1, 0, 0, 2, 0, "c"), ("l", 10, "c", 1, 1, 3, 3, 2, "c")], packing.PLACED)
    assert tuple(packing.faults(split, sizes.filter("doc_id = 1"), limits).first()) == ("l", 0, 0, 1, 1)
