"""Searches, ingest runs, looked-up outcomes, forecasts, scores and written results, by fixed cases."""

import json

import pytest
from pyspark.sql import functions as F

from quotemill.functions import stats
from quotemill.operators import measures
from quotemill.plans import marts
from quotemill.sources import feeds, forecasts, lake, venues


def test_search_answers_merge_by_id(spark):
    one = [("a", '[{"id": "1", "v": "old"}, {"id": "2"}, {"x": 1}]'), ("b", '[{"id": "1", "v": "new"}]'), ("c", "damaged"), ("d", None), ("e", "[]")]
    flat = feeds.merged(feeds.listed(spark.createDataFrame(one, "keyword string, answer string")), ["keyword"])
    assert {r["id"]: json.loads(r["item"]).get("v") for r in flat.collect()} == {"1": "new", "2": None}
    two = [("a", '{"events": [{"markets": [{"id": 7}, {"id": 8}]}, {"title": "none"}]}'), ("b", '{"events": []}'), ("c", "{}"), ("d", '{"events": [{"markets": [{"id": 8}]}]}')]
    deep = feeds.merged(feeds.nested(spark.createDataFrame(two, "keyword string, answer string")), ["keyword"])
    assert sorted(r["id"] for r in deep.collect()) == ["7", "8"]
    r = feeds.records(deep, "polymarket").first()
    assert r["source"] == "polymarket" and r["snapshot_ts"].year == 2025
    with pytest.raises(ValueError):
        feeds.records(deep, "")


def test_ingest_goes_on_where_a_source_fails(spark, tmp_path):
    root = str(tmp_path)
    item = json.dumps({"id": "m1", "outcomeType": "BINARY", "probability": 0.4, "question": "q"})
    good = lambda: feeds.records(spark.createDataFrame([("m1", item), ("m2", "junk")], "id string, item string"), "manifold")

    def bad():
        raise OSError("no answer")

    told = {r["source"]: (r["n_raw"], r["n_quotes"], r["failed"]) for r in feeds.ingest(spark, root, {"kalshi": bad, "manifold": good}).collect()}
    assert told == {"kalshi": (0, 0, "OSError: no answer"), "manifold": (2, 1, None)}
    feeds.ingest(spark, root, {"manifold": good}, only="manifold")
    assert lake.read_raw(spark, root).count() == 2 and lake.read_quotes(spark, root).count() == 1
    with pytest.raises(OSError):
        feeds.ingest(spark, root, {"kalshi": bad}, live=False)
    with pytest.raises(ValueError):
        feeds.ingest(spark, root, {"kalshi": bad}, only="nothing")


def test_outcomes_are_looked_up_once(spark, tmp_path):
    answers = {("kalshi", "a"): '{"market": {"result": "yes"}}', ("kalshi", "b"): '{"market": {"status": "open"}}', ("manifold", "c"): '{"isResolved": true, "resolution": "NO"}', ("manifold", "d"): '{"isResolved": true, "resolution": "MKT"}', ("manifold", "e"): "junk"}

    def ask(source, market):
        return answers[source, market]

    log = spark.createDataFrame([*answers, ("kalshi", "a"), ("kalshi", "fails"), ("polymarket", "p")], "source string, market_id string")
    path = str(tmp_path / "outcomes")
    assert feeds.auto_resolve(spark, log, path, ask) == (6, 2)
    assert {r["market_id"]: r["outcome"] for r in lake.resolutions(spark, path).collect()} == {"a": 1, "c": 0}
    assert feeds.auto_resolve(spark, log, path, ask) == (4, 0)


def test_forecast_pages(spark):
    page = {"properties": {"periods": [{"startTime": "2024-01-01T06:00:00-05:00", "isDaytime": True, "temperature": 40}, {"startTime": "2024-01-01T18:00:00-05:00", "isDaytime": False, "temperature": 20}, {"startTime": "2024-01-02T06:00:00-05:00", "isDaytime": True}]}}
    df = spark.createDataFrame([("NYC", json.dumps(page)), ("X", "junk"), ("Y", None), ("Z", "{}")], "location string, payload string")
    assert [tuple(r) for r in forecasts.highs(df).collect()] == [("NYC", "2024-01-01", 40.0, 0)]
    point = spark.createDataFrame([('{"properties": {"forecast": "https://x/y"}}',), ("junk",)], "p string").select(forecasts.forecast_address(F.col("p")).alias("a"))
    assert [r["a"] for r in point.collect()] == ["https://x/y", None]
    titles = {"High in New York above 80?": "NYC", "Will LA be hot": "LOS_ANGELES", "Atlanta rain": "ATLANTA", "Chicago or NYC": "NYC", "Paris": None, None: None}
    df = spark.createDataFrame([(t,) for t in titles], "t string").select("t", forecasts.place(F.col("t")).alias("p"))
    assert {r["t"]: r["p"] for r in df.collect()} == titles


@pytest.mark.parametrize("brier,calibration,score", [(None, None, 100.0), (0.0, 1.0, 100.0), (0.25, 0.0, 80.0), (0.5, 0.0, 80.0), (0.125, 0.5, 90.0)])
def test_reliability(spark, brier, calibration, score):
    k = stats.calibration_score(F.lit(brier).cast("double"))
    assert tuple(spark.range(1).select(k, stats.reliability(F.lit(1.0), F.lit(1.0), k)).first()) == (calibration, score)


def test_tiers(spark):
    df = spark.createDataFrame([(0.8, False), (0.6, None), (0.59, False), (0.1, True), (None, False), (7.0, False)], "c double, o boolean")
    assert [r[0] for r in df.select(stats.match_tier(F.col("c"), F.col("o"))).collect()] == ["strong", "probable", "weak", "strong", "weak", "strong"]


def test_health_of_a_source_with_baskets_only(spark):
    raw = spark.createDataFrame([("Kalshi ", "a", "2024-01-01", '{"ticker": "KXMVE-1"}'), ("kalshi", "b", "2024-01-01", '{"mve_selected_legs": [{"side": "yes"}]}'), ("kalshi", "c", "2024-01-01", '{"ticker": "KXA", "mve_sel'), ("kalshi", "d", "2024-01-01", None), ("kalshi", "e", "2023-12-31", "{}"), ("manifold", "f", "2024-01-01", '{"id": "f"}')], "source string, market_id string, ts string, payload string")
    rates = venues.combo_rates(raw.withColumn("snapshot_ts", F.to_timestamp("ts")))
    assert {r["source"]: r["combo_rate"] for r in rates.collect()} == {"kalshi": 0.5, "manifold": 0.0}
    quotes = spark.createDataFrame([], "source string, market_id string, outcome string, snapshot_ts timestamp, implied_prob double, price_is_stale boolean")
    found = {r["source"]: r for r in measures.feed_quality(quotes, F.current_timestamp(), ["source", "market_id"], combos=rates).collect()}
    assert (found["kalshi"]["n_quotes"], found["kalshi"]["null_rate"], found["kalshi"]["reliability_score"], found["kalshi"]["reliability_grade"]) == (0, 1.0, 0.0, "F")
    assert found["kalshi"]["issues"] == "50% of raw payloads were excluded combo/parlay markets, leaving 0 usable quotes" and found["manifold"]["issues"] == "no data for this source"


def test_results_are_written_in_order(spark, tmp_path):
    assert marts.ordered(["c", "a"], {"c": ("b",), "b": ("a",)}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        marts.ordered(["a"], {"a": ("b",), "b": ("a",)})
    made, root = [], str(tmp_path)
    queries = {n: lambda s, f, n=n: made.append(n) or s.range(0) for n in ("append_log", "score_quotes", "calibration10", "stage_events")}
    told = marts.materialise(spark, queries, ["stage_events", "calibration10"], "x", root)
    assert made == ["stage_events", "append_log", "score_quotes", "calibration10"] and told["stage_events"] == "view stage_events"
    assert marts.read(spark, root, "calibration10").columns == ["id"] and marts.read(spark, root, "never") is None and spark.table("stage_events").count() == 0


def test_score_summary_without_outcomes(spark):
    log = spark.range(3)
    assert tuple(measures.score_summary(log, spark.createDataFrame([], "hit int")).first()) == (3, 0, None)


def test_tables_are_read_in_their_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0.1), ("a", 0.3), ("d", None), ("c", 0.3)], "label string, gap double")
    marts.materialise(spark, {"alerts": lambda s, f: rows, "loo_consensus": lambda s, f: s.createDataFrame([], "row_id int, abs_deviation double")}, ["alerts"], "x", str(tmp_path))
    assert [r["label"] for r in marts.read(spark, str(tmp_path), "alerts").collect()] == ["a", "c", "b", "d"]
    assert [r["label"] for r in marts.read(spark, str(tmp_path), "alerts", most=2).collect()] == ["a", "c"]
    assert marts.read(spark, str(tmp_path), "loo_consensus").count() == 0
