"""Normalisers, lake and stream: counts, idempotency, batch and stream alike."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quotemill.functions import odds, stats
from quotemill.operators import consensus, latest, measures
from quotemill.plans import reference
from quotemill.sources import lake, pages, venues
from quotemill.streaming import topic

from conftest import DATA

TS = dt.datetime(2025, 1, 1)


def _kalshi(ticker, **kw):
    return {"ticker": ticker, "title": f"Will {ticker} happen?", "status": "active", "yes_bid_dollars": "0.45", "yes_ask_dollars": "0.48", "close_time": "2026-06-18T03:59:00Z"} | kw


def _raw(spark):
    book = lambda a, b: {"key": "k", "markets": [{"key": "h2h", "outcomes": [{"name": "Celtics", "price": a}, {"name": "Lakers", "price": b}]}, {"key": "totals", "outcomes": [{"name": "Over", "price": 1.9}]}]}
    payloads = [
        ("kalshi", "A", _kalshi("A")), ("Kalshi ", " B ", _kalshi("B", yes_bid_dollars=None, yes_ask_dollars=None, yes_bid=90, yes_ask=92)), ("kalshi", "C", _kalshi("C", status="settled")),
        ("kalshi", "D", _kalshi("D", yes_bid_dollars="0", yes_ask_dollars="0", last_price_dollars=".33", volume_24h_fp="500")), ("kalshi", "E", _kalshi("E", yes_bid_dollars="x", yes_ask_dollars="x")), ("kalshi", "KXMVE1", _kalshi("KXMVE1")),
        ("manifold", "m1", {"id": "m1", "question": "q", "outcomeType": "BINARY", "probability": 0.5, "closeTime": 1781755140000, "isResolved": False}), ("manifold", "m2", {"id": "m2", "outcomeType": "BINARY", "probability": 1.0, "closeTime": 113000000000000}),
        ("manifold", "m3", {"id": "m3", "outcomeType": "MULTIPLE_CHOICE", "probability": 0.5}), ("manifold", "m4", {"id": "m4", "outcomeType": "BINARY", "probability": 0.5, "isResolved": True}),
        ("polymarket", "p1", {"id": "p1", "question": "q", "outcomes": '["Yes", " NO "]', "outcomePrices": '["0.9755", "0.0245"]', "bestBid": 0.97, "bestAsk": 0.98}), ("polymarket", "p2", {"id": "p2", "outcomes": '["A", "B"]', "outcomePrices": '["0.5"]'}), ("polymarket", "p3", {"id": "p3", "outcomes": "broken", "outcomePrices": None}),
        ("oddsapi", "o1", {"id": "o1", "sport_title": "NBA", "home_team": "Celtics", "away_team": "Lakers", "commence_time": "2026-06-17T23:00:00Z", "bookmakers": [book(1.1, 7.5), book(1.11, 8.0)]}), ("oddsapi", "o2", {"id": "o2", "bookmakers": None}),
        ("unknown", "u", {"x": 1}),
    ]
    rows = [(s, m, TS, json.dumps(p)) for s, m, p in payloads] + [("kalshi", "Z", TS, "{broken"), ("kalshi", "Y", TS, None), (None, None, None, None)]
    return spark.createDataFrame(rows, venues.RAW)


def test_quotes_of_all_venues(spark):
    got = {(r["source"], r["market_id"]): r for r in venues.quotes(_raw(spark)).collect()}
    assert set(got) == {("kalshi", "A"), ("kalshi", "B"), ("kalshi", "D"), ("manifold", "m1"), ("manifold", "m2"), ("polymarket", "p1"), ("oddsapi", "o1:Celtics"), ("oddsapi", "o1:Lakers")}
    assert got["kalshi", "A"]["implied_prob"] == pytest.approx(0.465) and got["kalshi", "A"]["spread"] == pytest.approx(0.03)
    assert got["kalshi", "B"]["price"] == pytest.approx(0.91) and got["kalshi", "D"]["price_is_stale"] and got["kalshi", "D"]["price"] == 0.33
    assert got["manifold", "m2"]["implied_prob"] is None and got["manifold", "m2"]["price"] == 1.0 and got["manifold", "m2"]["close_ts"] is None
    assert got["polymarket", "p1"]["price"] == 0.9755
    q = [(1 / 1.1 + 1 / 1.11) / 2, (1 / 7.5 + 1 / 8) / 2]
    assert got["oddsapi", "o1:Celtics"]["implied_prob"] == pytest.approx(q[0] / sum(q))
    assert got["oddsapi", "o1:Celtics"]["title"] == "Celtics to win vs Lakers (NBA)"
    assert venues.outside_contract(venues.quotes(_raw(spark))).count() == 0
    assert venues.quotes(spark.createDataFrame([], venues.RAW)).count() == 0


def test_lake_keeps_every_snapshot_of_a_day(spark, tmp_path):
    root, t = str(tmp_path / "days"), lambda h, m: dt.datetime(2021, 3, 17, h, m)
    quote = lambda at, price: spark.createDataFrame([("s", "m", "YES", at, price)], "source string, market_id string, outcome string, snapshot_ts timestamp, price double")
    lake.write_quotes(quote(t(9, 0), 0.1).unionByName(quote(t(9, 1), 0.2)), root)
    lake.write_quotes(quote(t(10, 0), 0.3), root)
    lake.write_quotes(quote(t(9, 1), 0.4), root)
    lake.merge_quotes(quote(t(11, 0), 0.5), root)
    assert {r["snapshot_ts"]: r["price"] for r in lake.read_quotes(spark, root).collect()} == {t(9, 0): 0.1, t(9, 1): 0.4, t(10, 0): 0.3, t(11, 0): 0.5}
    # A folder a day and source, however many snapshots.
    assert [p.name for p in (tmp_path / "days" / "clean" / "source=s").glob("date=*")] == ["date=2021-03-17"] and not list((tmp_path / "days").rglob("snapshot=*"))


def test_lake_query_counts_every_snapshot(spark):
    quotes = spark.read.parquet(f"{DATA}/market_quotes.parquet")
    expected = {r["source"]: r["count"] for r in quotes.select("source", "market_id", "outcome", "snapshot_ts").distinct().groupBy("source").count().collect()}
    assert {r["source"]: r["n"] for r in reference.lake_snapshots(spark, DATA).collect()} == expected
    landed = reference._landed(spark, DATA)
    assert landed.count() == sum(expected.values())



def test_lake_is_idempotent_prunes_and_merges(spark, tmp_path):
    root, quotes = str(tmp_path), venues.quotes(_raw(spark))
    assert lake.read_quotes(spark, root) is None and lake.sources(spark, root) == []
    for _ in range(2):
        lake.write_quotes(quotes, root)
        lake.write_raw(_raw(spark).filter("source is not null"), root)
        assert lake.read_quotes(spark, root).count() == 8
    only = lake.read_quotes(spark, root, "kalshi")
    assert only.count() == 3 and "PartitionFilters: [isnotnull(source" in only._jdf.queryExecution().toString()
    # A later batch of the same snapshot adds to it.
    more = quotes.filter("market_id = 'A'").withColumns({"market_id": F.lit("N"), "price": F.lit(0.1)}).unionByName(quotes.filter("market_id = 'B'").withColumn("price", F.lit(0.2)))
    lake.merge_quotes(more, root)
    got = {r["market_id"]: r["price"] for r in lake.read_quotes(spark, root).collect()}
    assert len(got) == 9 and got["N"] == 0.1 and got["B"] == 0.2
    assert set(lake.sources(spark, root)) >= {"kalshi", "manifold", "polymarket", "oddsapi"}


def test_csv_resolutions_and_overrides(spark, tmp_path):
    (tmp_path / "a.csv").write_text("market_id,outcome,note\nm,0,x\nn,1,\n,1,\n")
    (tmp_path / "b.csv").write_text("market_id,outcome,note\nm,1,x\n")
    assert {r["market_id"]: r["outcome"] for r in lake.resolutions(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv")).collect()} == {"m": 1, "n": 1}
    (tmp_path / "o.csv").write_text("source_a,market_id_a,source_b,market_id_b,relation\n Kalshi , X ,manifold,y,Match\n")
    assert [tuple(r) for r in lake.overrides(spark, str(tmp_path / "o.csv")).collect()] == [("kalshi:X", "manifold:y", "match")]


def test_outcomes_and_state_are_swapped_in(spark, tmp_path):
    path = str(tmp_path / "auto.csv")
    for rows in ([("m", 0), ("n", 1), (None, 1)], [("m", 1)]):
        lake.upsert_outcomes(spark, spark.createDataFrame(rows, "market_id string, outcome int"), path)
    assert {r["market_id"]: r["outcome"] for r in lake.resolutions(spark, path).collect()} == {"m": 1, "n": 1}
    state = str(tmp_path / "state")
    assert lake.read_state(spark, state, "sigma", 4.0) == 4.0
    lake.write_state(spark, state, sigma=4.5, n=20)
    lake.write_state(spark, state, sigma=5.5, n=21)
    assert lake.read_state(spark, state, "sigma", 4.0) == 5.5 and lake.read_state(spark, state, "other", 1.0) == 1.0


def test_reasons(spark):
    blocks = lambda rows: spark.createDataFrame(rows, "category string, source string")
    pairs = lambda rows: measures.match_diagnostics(spark.createDataFrame(rows, "decision string, confidence double"))
    cross = lambda n: spark.createDataFrame([(n,)], "n_cross long")
    say = lambda *a: measures.reasons(*a).first()["reasons"]
    assert say(blocks([]), pairs([]), cross(0)) == ["no markets yet"]
    assert say(blocks([("x", "a")]), pairs([]), cross(2)) == ["2 event(s) of several sources matched"]
    assert say(blocks([("x", "a"), ("y", "b")]), pairs([]), cross(0)) == ["a only contributed markets in x; no other source covers them", "b only contributed markets in y; no other source covers them", "no category had two sources or more - there was nothing to compare"]
    assert say(blocks([("x", "a"), ("x", "b")]), pairs([]), cross(0)) == ["categories with several sources exist, but no candidate pairs were scored"]
    assert say(blocks([("x", "a"), ("x", "b")]), pairs([("no-match", 0.55)]), cross(0)) == ["1 pair(s) scored, all below the match threshold (closest score: 0.55)"]


def test_stream_lands_what_batch_lands(spark, tmp_path):
    raw = _raw(spark).filter("source is not null")
    messages = topic.encode(raw).unionByName(spark.createDataFrame([(b"k", b"{damaged"), (b"k", None)], "key binary, value binary"))
    messages.repartition(3).write.parquet(str(tmp_path / "in"))
    root, check = str(tmp_path / "lake"), str(tmp_path / "check")

    def start():
        stream = spark.readStream.schema("key binary, value binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return topic.drain(topic.decode(stream), check, topic.land_quotes(root))

    assert start() == messages.count() and start() == 0
    columns = ["source", "market_id", "outcome", "price", "snapshot_ts"]
    landed, batch = lake.read_quotes(spark, root).select(columns), venues.quotes(raw).select(columns)
    assert landed.exceptAll(batch).count() == 0 and batch.exceptAll(landed).count() == 0
    assert {r["damaged"] for r in spark.read.parquet(f"{root}/damaged").collect()} >= {"{damaged"}


def test_windowed_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i // 4, i % 60), "ab"[i % 2], float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, kind string, v double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = topic.windowed(stream, "ts", ["kind"], F.col("v")).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = topic.windowed(df, "ts", ["kind"], F.col("v"))
    assert spark.table("w").exceptAll(batch).count() == 0 and spark.table("w").count() == batch.count()


def test_paged_source_follows_cursors(spark, tmp_path):
    for series in ("S1", "S2"):
        (tmp_path / series).mkdir()
        for page, cursor in (("first", "p2"), ("p2", "p3"), ("p3", "")):
            (tmp_path / series / f"{page}.json").write_text(json.dumps({"cursor": cursor, "markets": [{"ticker": f"{series}-{page}"}]}))
    spark.dataSource.register(pages.PagedJson)
    read = lambda **o: {json.loads(r["payload"])["ticker"] for r in spark.read.format("paged_json").options(path=str(tmp_path), **o).load().collect()}
    assert read() == {f"{s}-{p}" for s in ("S1", "S2") for p in ("first", "p2", "p3")}
    assert read(series="S2", max_pages="2") == {"S2-first", "S2-p2"}


def test_latest_rules_differ_and_hold(spark):
    rows = [("a", 1, 1.0, "x"), ("a", 2, None, "y"), ("a", 3, float("nan"), None), ("b", 1, None, None), (None, 1, 5.0, "z")]
    df = spark.createDataFrame(rows, "k string, t int, v double, _rn string")
    assert {(r["k"], r["t"]) for r in latest.latest_row(df, ["k"], [F.desc("t")]).collect()} == {("a", 3), ("b", 1), (None, 1)}
    assert {(r["k"], r["v"], r["_rn"]) for r in latest.last_values(df, ["k"], "t", ["v", "_rn"]).collect()} == {("a", 1.0, "y"), ("b", None, None), (None, 5.0, "z")}
    assert {(r["k"], r["t"]) for r in latest.at_latest(df, ["k"], "t").collect()} == {("a", 3), ("b", 1), (None, 1)}
    log, new = df.filter("k = 'a' and t = 1"), df.filter("t > 1 or k is null").withColumn("k", F.concat("k", F.col("t").cast("string")))
    assert sorted(r["k"] for r in latest.append_new(log, new.unionByName(log), "k", [F.asc("t")]).collect()) == ["a", "a2", "a3"]


def test_leave_one_out_identity(spark):
    rows = [("e", s, p) for s, p in (("a", 0.2), ("b", 0.5), ("b", 0.9), ("c", None), ("d", float("nan")))] + [("f", "a", 0.5), ("f", "a", 0.6), (None, "a", 0.1)]
    df = spark.createDataFrame(rows, "event_id string, source string, implied_prob double").withColumn("_sum", F.lit(9))
    got = consensus.leave_one_out(df).collect()
    assert len(got) == 3 and sum(2 * r["consensus"] for r in got) == pytest.approx(2 * 1.6)
    assert consensus.leave_one_out(df.limit(0)).count() == 0


def test_calibration_and_accuracy(spark):
    df = spark.createDataFrame([(0.46, 0), (0.91, 1), (0.55, 0), (None, 1), (0.5, None)], "p double, y int")
    r = measures.accuracy(df, "p", "y").first()
    assert (r["n"], r["brier"], r["accuracy"], r["longshot_overpricing"]) == (3, 0.1741, 0.6667, None)
    assert {(r["prob_bucket"], r["n"]) for r in measures.calibration(df, "p", "y").collect()} == {(0.5, 1), (0.9, 1), (0.6, 1)}


def test_sigma_is_recovered(spark):
    import random

    rng = random.Random(0)
    rows = []
    for _ in range(4000):
        m = rng.uniform(-12, 12)
        rows.append((m, int(m + rng.gauss(0, 5) > 0)))
    df = spark.createDataFrame(rows, "m double, y int")
    assert abs(measures.best_sigma(df, "m", "y").first()["sigma"] - 5) < 1
    assert measures.best_sigma(df.limit(3), "m", "y").first()["sigma"] == 4.0
    assert measures.best_sigma(df.limit(0), "m", "y").first()["sigma"] == 4.0


def test_numbers(spark):
    import math

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    for z in (-3.0, -0.5, 0.0, 1.2):
        assert one(stats.normal_cdf(F.lit(z))) == pytest.approx(0.5 * (1 + math.erf(z / 2**0.5)), abs=2e-7)
    assert one(stats.chance_above(F.lit(86.0), F.lit(82.5), F.lit(4.0))) == pytest.approx(0.8092, abs=1e-4)
    assert one(stats.chance_above(F.lit(86.0), F.lit(82.5), F.lit(0.0))) == 1.0
    assert one(stats.bucket(F.lit(0.25), 10)) == 0.2 and one(stats.clamp(F.lit(float("nan")), 0.0, 1.0)) == 0.0
    assert one(odds.american(F.lit(0.0))) is None and one(odds.decimal(F.lit(1.0))) is None and one(odds.without_margin(F.lit(0.0), F.lit(0.0))) is None


def test_feed_quality_issues(spark):
    rows = [("s", f"m{i}", "YES", TS - dt.timedelta(hours=h), 0.5, False) for h in (2, 1) for i in range(4)] + [("s", "m9", "YES", TS, 1.4, True), ("s", "m9", "YES", TS, 1.4, True)]
    df = spark.createDataFrame(rows, "source string, market_id string, outcome string, snapshot_ts timestamp, implied_prob double, price_is_stale boolean")
    r = measures.feed_quality(df, F.lit(TS + dt.timedelta(hours=10)).cast("timestamp"), ["source", "market_id", "outcome", "snapshot_ts"]).first()
    assert (r["n_quotes"], r["n_markets"], r["prob_violations"], r["partial_ingest"], r["stale_price_rate"], r["duplicate_rate"]) == (2, 1, 2, False, 1.0, 0.1)
    assert "stale: last snapshot 600 min ago" in r["issues"] and "10.0% duplicate rows" in r["issues"] and "2 probability values outside [0,1]" in r["issues"]
    assert measures.feed_quality(df.limit(0), F.lit(TS).cast("timestamp"), ["source"]).count() == 0


def test_data_tests_and_lookup(spark):
    df = spark.createDataFrame([(1, 0.5, "a"), (1, 2.0, "z"), (None, None, None)], "k int, p double, s string")
    got = {(r["test"], r["column_name"]): r["n_failed"] for r in measures.violations(df, ["k"], ["k"], {"p": (0, 1)}, {"s": ["a"]}).collect()}
    assert got == {("not_null", "k"): 1, ("range", "p"): 1, ("accepted_values", "s"): 1, ("unique", "k"): 1}
    left = spark.createDataFrame([(1, "g", "d1"), (2, "g", "d9"), (3, "h", "d1")], "i int, g string, d string")
    right = spark.createDataFrame([("g", "d0", 10, 1), ("g", "d1", 11, 2), ("g", "d1", 12, 3)], "g string, d string, v int, o int")
    assert {r["i"]: r["found"]["v"] if r["found"] else None for r in measures.lookup_or_first(left, right, "g", "d", "o").collect()} == {1: 11, 2: 10, 3: None}
    blocks = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "category string, source string")
    assert [(r["source"], r["categories"]) for r in measures.coverage_gaps(blocks).collect()] == [("c", ["y"])]


def test_scope_drops_what_it_stored(spark):
    import os

    from quotemill.session import Stored, scope

    with scope():
        kept = Stored(spark.range(3))
        where = kept.path.removeprefix("file:").replace("//", "/")
        assert kept.df.count() == 3 and os.path.exists(where)
    assert not os.path.exists(where)


def test_a_cluster_must_name_a_shared_folder(spark):
    from types import SimpleNamespace as N

    from quotemill.session import shared_folder

    undefined = N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False)))
    cluster = N(conf=N(get=lambda *a: None), sparkContext=N(master="spark://head:7077", _jsc=undefined))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)
    cluster.conf = N(get=lambda *a: "/shared")
    assert shared_folder(cluster) == "/shared"


def test_versions_are_met_whole(spark, tmp_path):
    import os

    path = str(tmp_path / "outcomes")
    for i in range(4):
        lake.upsert_outcomes(spark, spark.createDataFrame([("m", i % 2), (f"x{i}", 1)], "market_id string, outcome int"), path)
    assert {r["market_id"]: r["outcome"] for r in lake.resolutions(spark, path).collect()} == {"m": 1, "x0": 1, "x1": 1, "x2": 1, "x3": 1}
    os.makedirs(f"{path}/version-{99:012d}")  # one that failed half way
    assert lake.resolutions(spark, path).count() == 5 and len([n for n in os.listdir(path) if n.startswith("version-")]) == 3


def test_pages_go_to_the_end_and_stop_at_a_loop(spark, tmp_path):
    import json

    from quotemill.sources import pages

    spark.dataSource.register(pages.PagedJson)
    for series, cursors in {"long": ["first", "b", "c", "d", "e", ""], "loop": ["first", "b", "first"]}.items():
        (tmp_path / series).mkdir()
        for here, after in zip(cursors, cursors[1:]):
            (tmp_path / series / f"{here}.json").write_text(json.dumps({"markets": [{"at": here}], "cursor": after}))
    read = lambda **o: sorted((r["series"], r["page"]) for r in spark.read.format("paged_json").options(path=str(tmp_path), **o).load().collect())
    assert read() == [("long", x) for x in ("b", "c", "d", "e", "first")] + [("loop", "b"), ("loop", "first")]
    assert len(read(max_pages="2")) == 4


def test_landing_keeps_raw_records(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = [("manifold", f"m{i}", "2024-01-01T00:00:00Z", '{"outcomeType": "BINARY", "probability": 0.5, "question": "q"}', None) for i in range(3)] + [(None, None, None, None, "junk")]
    decoded = spark.createDataFrame(rows, "source string, market_id string, snapshot_ts string, payload string, damaged string").withColumn("snapshot_ts", F.to_timestamp("snapshot_ts"))
    land = topic.land_quotes(root)
    land(decoded.limit(2), 0)
    land(decoded, 1)
    land(decoded, 1)
    assert lake.read_raw(spark, root).count() == 3 and lake.read_quotes(spark, root).count() == 3 and spark.read.parquet(f"{root}/damaged").count() == 1
