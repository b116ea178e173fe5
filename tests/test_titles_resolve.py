"""Title features, guards, overrides and events, on the cases that matching has to tell apart."""

import datetime as dt
import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quotemill.functions import titles
from quotemill.operators import graph, resolve, similarity
from quotemill.plans import reference

DAY = dt.date(2026, 6, 17)


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "title,subject",
    [
        ("Boston Celtics beat the Los Angeles Lakers", {"boston", "celtics"}), ("Los Angeles Lakers to win vs Boston Celtics", {"los", "angeles", "lakers"}),
        ("Will Dwayne 'The Rock' Johnson be the 2028 nominee?", {"dwayne", "'the", "rock'", "johnson"}), ("Will Türkiye finish last in Group D?", {"türkiye"}), ("will it rain in boston?", None), ("", None), ("Will the", None),
    ],
)
def test_subjects(spark, title, subject):
    got = _one(spark, titles.subject(F.lit(title)))
    if subject and any("'" in w for w in subject):
        assert {"dwayne", "rock", "johnson"} == set(got)
    else:
        assert (set(got) if got is not None else None) == subject


def test_normal_form_tokens_and_sets(spark):
    t = F.lit("Will the USA beat New York City by 82.5 -- or 'La' win?")
    assert _one(spark, titles.normal(t)) == "will the united_states beat new_york by 82.5 or los_angeles win"
    assert set(_one(spark, titles.tokens(t))) == {"united_states", "beat", "new_york", "82.5", "los_angeles", "win"}
    assert _one(spark, titles.numbers(F.lit("96F or 97.5F, 96"))) == ["96", "97.5"]
    assert _one(spark, titles.entities(titles.tokens(t))) == ["los_angeles", "new_york", "united_states"]
    assert _one(spark, titles.predicate(titles.words(t))) == ["win"]
    assert _one(spark, titles.category(titles.words(F.lit("Will BTC close high?")))) == "weather"
    assert _one(spark, titles.category(titles.words(F.lit("BTC over 100k")))) == "crypto"
    # Longest alias first, and replaced text is not read again.
    assert _one(spark, titles.fold_aliases(F.lit("united states us usa bosnia and herzegovina xrp"))) == "united_states united_states united_states bosnia_and_herzegovina ripple"
    assert _one(spark, titles.tokens(F.lit(""))) == []


@pytest.mark.parametrize("title,expected", [("be above 82.5F on", ("above", 82.5)), ("high >88° on", ("above", 88.0)), ("be <81° on", ("below", 81.0)), ("at least 90 degrees", ("above", 90.0)), ("wins by over 1.5 runs", None), ("be 85-86° on", None), (None, None)])
def test_thresholds(spark, title, expected):
    got = _one(spark, titles.threshold(F.lit(title).cast("string")))
    assert (tuple(got) if got else None) == expected


def test_sequence_ratio_is_difflibs(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("a" * 300, "a" * 299 + "b"), (None, "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r["r"] for r in df.select(titles.sequence_ratio("a", "b").alias("r")).collect()] == [difflib.SequenceMatcher(None, a, b).ratio() if a is not None else None for a, b in pairs]


def _markets(spark, rows):
    return spark.createDataFrame([(k, t, DAY) for k, t in rows], "key string, title string, close_ts date")


def _events(spark, rows, overrides=None):
    o = spark.createDataFrame(overrides, "a string, b string, relation string") if overrides else None
    out = {}
    for r in resolve.resolve(_markets(spark, rows), overrides=o).event_map.collect():
        out.setdefault(r["event_id"], set()).add(r["key"])
    return sorted(map(sorted, out.values()))


def test_same_game_other_wording_merges_and_a_block_parts_it(spark):
    rows = [("a:1", "Will the Boston Celtics beat the Los Angeles Lakers on June 17?"), ("b:1", "Boston Celtics beat Los Angeles Lakers June 17")]
    assert _events(spark, rows) == [["a:1", "b:1"]]
    assert _events(spark, rows, [("b:1", "a:1", "block")]) == [["a:1"], ["b:1"]]


def test_numbers_sides_and_predicates_part(spark):
    assert len(_events(spark, [("a:1", "Will Houston be 96F or higher on June 17?"), ("b:1", "Will Houston be 97F or higher on June 17?")])) == 2
    rows = [("a:1", "Boston Celtics beat Los Angeles Lakers"), ("b:1", "Boston Celtics to win vs Los Angeles Lakers"), ("c:1", "Los Angeles Lakers to win vs Boston Celtics")]
    assert _events(spark, rows) == [["a:1", "b:1"], ["c:1"]]
    rows = [("a:1", "Will Argentina win the 2026 FIFA World Cup?"), ("b:1", "Argentina wins the 2026 FIFA World Cup"), ("b:2", "Will Argentina win their group at the 2026 FIFA World Cup?"), ("b:3", "Will Argentina go unbeaten at the 2026 FIFA World Cup?")]
    assert _events(spark, rows) == [["a:1", "b:1"], ["b:2"], ["b:3"]]
    assert _events(spark, [("a:1", "Will the USA win the World Cup?"), ("b:1", "United States to win the World Cup")]) == [["a:1", "b:1"]]


def test_a_manual_match_joins_what_was_never_compared(spark):
    rows = [("a:1", "Will Zorbinaut prevail?"), ("b:1", "Quasars triumph at last"), ("c:1", None), ("d:1", "")]
    assert _events(spark, rows) == [["a:1"], ["b:1"]]
    assert _events(spark, rows, [("b:1", "a:1", "match"), ("a:1", "x:9", "match")]) == [["a:1", "b:1"]]


def test_candidates_lose_no_match(spark):
    rng = random.Random(3)
    names, verbs, ends = ["Argentina", "Brazil", "Foo Bar", "Baz", "will"], ["win the cup", "reach the final", "score 3 goals", "score 4 goals"], ["in 2026", "this season", "", "on June 17"]
    rows = [(f"k:{i:02}", f"{rng.choice(['Will ', 'Does ', ''])}{rng.choice(names)} {rng.choice(verbs)} {rng.choice(ends)}") for i in range(60)]
    told = resolve.features(_markets(spark, rows)).withColumnRenamed("close_ts", "close").cache()
    keys = [k for k, _ in rows]
    every = spark.createDataFrame([p for p in itertools.combinations(keys, 2)], "a string, b string")
    block = told.select(F.col("key"), F.concat_ws("|", "category", F.array_join("entities", ",")).alias("bl"))
    same = every.join(block.select(F.col("key").alias("a"), F.col("bl").alias("x")), "a").join(block.select(F.col("key").alias("b"), F.col("bl").alias("y")), "b").filter("x = y").select("a", "b")
    full = {(r["a"], r["b"]) for r in resolve.score(same, told, "key", "close").filter("decision = 'match'").collect()}
    ours = {(r["a"], r["b"]) for r in resolve.score(resolve.candidates(told, "key"), told, "key", "close").filter("decision = 'match'").collect()}
    assert ours == full and full
    told.unpersist()


def test_labels_equal_brute_force_and_ids_are_stable(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(50):02}", f"n{rng.randrange(50):02}") for _ in range(35)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [("z", "z"), (None, "q")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a string, b string")
    assert {r["node"]: r["label"] for r in graph.labels(df).collect()} == {x: find(x) for x in list(parent)}
    assert graph.labels(df.limit(0)).count() == 0
    members = spark.createDataFrame([("g", "b:2"), ("g", "a:1"), ("g", "a:1")], "g string, m string")
    import hashlib

    assert graph.group_ids(members, "g", "m").first()["group_id"] == "evt_" + hashlib.md5(b"a:1|b:2").hexdigest()[:10]


def test_similar_classes_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]) for i in range(120)] + [(200, "x", None), (201, None, ["a"]), (202, None, ["a"])]
    df = spark.createDataFrame(rows, "id int, g string, w array<string>")
    classes, members = similarity.set_classes(df, "id", "w", ["g"])
    known = [(r["class_id"], r["g"], frozenset(r["tokens"])) for r in classes.collect() if r["g"]]
    expected = {(min(a, b), max(a, b)) for (a, g, s), (b, h, t) in itertools.combinations(known, 2) if g == h and len(s & t) / len(s | t) >= 0.6}
    assert {(r["a"], r["b"]) for r in similarity.similar_classes(classes, 0.6, ["g"]).collect()} == expected
    assert members.filter("id = class_id").count() == classes.filter("g is not null").count()


def test_membership_has_every_row_and_its_links(spark):
    rows = [(i, "x", list(w)) for i, w in [(1, "abcd"), (2, "dcba"), (3, "abcd"), (4, "abcde"), (5, "yz"), (6, "zy"), (7, "q")]]
    classes, members = similarity.set_classes(spark.createDataFrame(rows, "id int, g string, w array<string>"), "id", "w", ["g"])
    got = {tuple(r) for r in similarity.membership(members, similarity.similar_classes(classes, 0.6, ["g"])).collect()}
    # Copies that no other class resembles show too.
    assert got == {(1, 1, 3, 1), (2, 1, 3, 1), (3, 1, 3, 1), (4, 4, 1, 1), (5, 5, 2, 0), (6, 5, 2, 0), (7, 7, 1, 0)}


def test_forecasts_by_quote_month_and_zone(spark, tmp_path):
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    save("kalshi_markets", [(1, "KXHIGHWYS-21MAR17-T70"), (2, "KXHIGHWYS-21NOV08-T70"), (3, "OTHER")], "rec_id long, ticker string")
    save("forecast_stations", [("WYS", "America/New_York")], "station string, zone_name string")
    # The second one's day in the station's zone is the 8th, whatever its first ten characters say.
    save("forecast_periods", [(1, "WYS", "2021-03-17T06:00:00", True, 60), (2, "WYS", "2021-11-09T01:00:00Z", True, 80)], "rec_id long, station string, starttime string, isdaytime boolean, temperature int")
    t = dt.datetime(2021, 3, 1)
    quotes = [(i, "kalshi", m, t + dt.timedelta(hours=i), title, 0.5) for i, (m, title) in enumerate([("KXHIGHWYS-21MAR17-T70", "high above 70F on Mar 17"), ("KXHIGHWYS-21MAR17-T70", "high above 70F on Mar 17"), ("KXHIGHWYS-21NOV08-T70", "high > 70° on Nov 8"), ("KXHIGHWYS-21NOV08-T70", "high on Nov 8")])]
    save("market_quotes", quotes, "row_id long, source string, market_id string, snapshot_ts timestamp, title string, implied_prob double")
    assert {(r["rec_id"], r["day"], r["temperature"]) for r in reference.forecast_by_day(spark, str(tmp_path)).collect()} == {(1, "2021-03-17", 60), (2, "2021-11-08", 80)}
    got = {r["row_id"]: (r["forecast_f"], r["forecast_prob"] > 0.5) for r in reference.forecast_edges(spark, str(tmp_path)).collect()}
    assert got == {0: (60.0, False), 1: (60.0, False), 2: (80.0, True)}


def test_nearest_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8)).astype("float32")
    v[7] = v[3]
    rows = [(i, [float(x) for x in v[i]]) for i in range(90)] + [(100, None), (None, [0.0] * 8), (101, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    got = {}
    for r in similarity.nearest(df.filter("k % 10 = 0 and k < 90"), df.filter("k < 90"), "k", "v", 4, per=16).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["neighbour"]
    for q in range(0, 90, 10):
        sims = np.round(v[q].astype(float) @ v.T.astype(float), 12)
        order = sorted((i for i in range(90) if i != q), key=lambda i: (-sims[i], i))[:4]
        assert [got[q][k] for k in range(1, 5)] == order
    similarity.nearest(df, df, "k", "v", 2).collect()
    assert similarity.nearest(df.limit(0), df, "k", "v", 2).count() == 0


def test_copies_cost_a_link_each_and_lose_none(spark):
    import datetime as dt

    day = dt.datetime(2031, 5, 3)
    rows = [(f"k:{i:03d}", "Will Zed Corp win the cup on 3 May?", day) for i in range(60)] + [("m:1", "Zed Corp to win the cup 3 May", day), ("m:2", "zed corp WIN the cup 3, May", None)]
    found = resolve.resolve(spark.createDataFrame(rows, "key string, title string, close_ts timestamp"))
    pairs = found.candidate_pairs.collect()
    assert len(pairs) <= 70 and {r["b"] for r in pairs if r["a"] == "k:000"} >= {f"k:{i:03d}" for i in range(1, 60)}
    told = resolve.features(spark.createDataFrame(rows, "key string, title string, close_ts timestamp").select("key", "title", F.col("close_ts").cast("date").alias("close")))
    every = resolve.score(resolve.candidates(told, "key"), told, "key", "close").filter("decision = 'match'")
    linked = {frozenset(x) for x in graph.labels(every).groupBy("label").agg(F.collect_set("node").alias("n")).toPandas()["n"]}
    ours = {frozenset(x) for x in found.event_map.groupBy("event_id").agg(F.collect_set("key").alias("n")).toPandas()["n"] if len(x) > 1}
    assert ours == linked
    # A block between two copies holds for that pair only.
    block = spark.createDataFrame([("k:000", "k:001", "block")], "a string, b string, relation string")
    again = resolve.resolve(spark.createDataFrame(rows, "key string, title string, close_ts timestamp"), overrides=block)
    assert {(r["a"], r["b"]): r["decision"] for r in again.candidate_pairs.collect()}["k:000", "k:001"] == "manual-block"
    assert again.event_map.select("event_id").distinct().count() == found.event_map.select("event_id").distinct().count()
