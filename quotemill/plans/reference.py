"""The engine's own queries, over whole tables, and their SQL twins."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import odds, stats, titles
from quotemill.operators import consensus, graph, instants, latest, measures, resolve, similarity
from quotemill.operators.dedup import keep_one
from quotemill.plans import cleaning
from quotemill.session import shared_folder, table
from quotemill.sources import feeds, forecasts, lake, venues
from quotemill.streaming import topic

QUERIES, ORACLE = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _chance(c: str = "implied_prob"):
    """The column where it is a probability, else null."""
    return F.when(F.col(c).between(0, 1), F.col(c))


_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, market_id ORDER BY snapshot_ts DESC, row_id DESC) AS rn FROM market_quotes WHERE implied_prob BETWEEN 0 AND 1) WHERE rn = 1"
_EVENTS = "SELECT source, market_id, min(event_id) AS event_id FROM event_map WHERE event_id IS NOT NULL GROUP BY source, market_id"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "event_map").filter("event_id is not null").groupBy("source", "market_id").agg(F.min("event_id").alias("event_id"))


def _latest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "market_quotes").select("row_id", "source", "market_id", "snapshot_ts", _chance().alias("implied_prob")).filter("implied_prob is not null")
    return latest.latest_row(quotes, ["source", "market_id"], [F.desc("snapshot_ts"), F.desc("row_id")])


@_query(f"""
    WITH q AS (SELECT l.row_id, l.source, l.market_id, l.implied_prob, e.event_id FROM ({_LATEST}) l JOIN ({_EVENTS}) e USING (source, market_id)),
    ev AS (SELECT event_id, count(*) AS n_quotes, count(DISTINCT source) AS n_sources, sum(implied_prob) AS s, coalesce(stddev_pop(implied_prob), 0) AS d FROM q GROUP BY event_id HAVING count(DISTINCT source) > 1)
    SELECT row_id, source, market_id, event_id, implied_prob, n_quotes, n_sources, round((s - implied_prob) / (n_quotes - 1), 8) AS consensus, round(d, 8) AS dispersion,
           round(abs(implied_prob - (s - implied_prob) / (n_quotes - 1)), 8) AS abs_deviation
    FROM q JOIN ev USING (event_id)""")
def loo_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each market's latest probability against the mean of its event's others."""
    quotes = _latest_quotes(spark, sf_dir).join(_events(spark, sf_dir), ["source", "market_id"])
    out = consensus.leave_one_out(quotes, places=8)
    return out.select("row_id", "source", "market_id", "event_id", "implied_prob", "n_quotes", "n_sources", "consensus", "dispersion", "abs_deviation")


@_query("SELECT event_type, user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each type and user."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts", "value")
    return latest.latest_row(events, ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")])


@_query("""
    SELECT source, market_id, max(struct_pack(o := snapshot_ts, v := price)) FILTER (WHERE price IS NOT NULL) ['v'] AS price,
           max(struct_pack(o := snapshot_ts, v := implied_prob)) FILTER (WHERE implied_prob IS NOT NULL) ['v'] AS implied_prob,
           max(struct_pack(o := snapshot_ts, v := close_ts)) FILTER (WHERE close_ts IS NOT NULL) ['v'] AS close_ts
    FROM market_quotes GROUP BY source, market_id""")
def last_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known value of each column by market, each from whichever row has it."""
    return latest.last_values(table(spark, sf_dir, "market_quotes"), ["source", "market_id"], "snapshot_ts", ["price", "implied_prob", "close_ts"])


@_query("""
    SELECT source, market_id, row_id, snapshot_ts FROM market_quotes q WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM market_quotes m WHERE m.source = q.source)""")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quotes of each source's latest snapshot."""
    return latest.at_latest(table(spark, sf_dir, "market_quotes").select("source", "market_id", "row_id", "snapshot_ts"), ["source"], "snapshot_ts")


@_query("""
    SELECT md5(event_type || '|' || user_id || '|' || event_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS event_key, event_id, event_type, user_id, ts,
           CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM events""")
def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a key made of their identity, NaN as null."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    key = F.md5(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"), stamp))
    return table(spark, sf_dir, "events").select(key.alias("event_key"), "event_id", "event_type", "user_id", "ts", F.when(~F.isnan("value"), F.col("value")).alias("value"))


@_query("""
    SELECT 'kalshi' AS source, ticker AS market_id, title FROM kalshi_markets UNION ALL SELECT 'manifold', id, question FROM manifold_markets UNION ALL SELECT 'polymarket', id, question FROM polymarket_markets""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three venues' markets under one another."""
    parts = [table(spark, sf_dir, t).select(F.lit(s).alias("source"), F.col(i).alias("market_id"), F.col(c).alias("title")) for s, t, i, c in (("kalshi", "kalshi_markets", "ticker", "title"), ("manifold", "manifold_markets", "id", "question"), ("polymarket", "polymarket_markets", "id", "question"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("""
    SELECT event_id, min(canonical_title) AS canonical_title, count(*) AS n_markets, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
           min(match_confidence) AS min_match_confidence, round(avg(match_confidence), 6) AS avg_match_confidence
    FROM event_map WHERE event_id IS NOT NULL GROUP BY event_id""")
def dim_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: its title, markets, sources and confidence."""
    rows = table(spark, sf_dir, "event_map").filter("event_id is not null")
    return rows.groupBy("event_id").agg(F.min("canonical_title").alias("canonical_title"), F.count("*").alias("n_markets"), F.count_distinct("source").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("match_confidence").alias("min_match_confidence"), F.round(F.avg("match_confidence"), 6).alias("avg_match_confidence"))


@_query("""
    SELECT l_orderkey, l_linenumber, o_custkey, o_orderpriority FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON l_orderkey = o_orderkey""")
def fact_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their dimension, where there is one."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "o_custkey", "o_orderpriority")


@_query(f"""
    SELECT q.row_id, q.source, q.market_id, q.implied_prob, e.event_id FROM market_quotes q LEFT JOIN ({_EVENTS}) e USING (source, market_id)""")
def quotes_with_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quote with its event, if it has one."""
    quotes = table(spark, sf_dir, "market_quotes").select("row_id", "source", "market_id", "implied_prob")
    return quotes.join(_events(spark, sf_dir), ["source", "market_id"], "left").select("row_id", "source", "market_id", "implied_prob", "event_id")


@_query("SELECT event_id, user_id, event_type FROM events e WHERE ts >= TIMESTAMP '2024-01-03' AND NOT EXISTS (SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '2024-01-03' AND o.user_id = e.user_id AND o.event_type = e.event_type)")
def anti_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from the third day on whose user and type the first two days don't know."""
    events = table(spark, sf_dir, "events")
    start = F.lit("2024-01-03").cast("timestamp_ntz")
    return events.filter(F.col("ts") >= start).join(events.filter(F.col("ts") < start), ["user_id", "event_type"], "left_anti").select("event_id", "user_id", "event_type")


@_query("SELECT source, market_id, outcome, row_id, price FROM (SELECT *, row_number() OVER (PARTITION BY source, market_id, outcome ORDER BY load_id, row_id) AS rn FROM market_quotes) WHERE rn = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first quote of each source, market and outcome, by a mergeable aggregate."""
    quotes = table(spark, sf_dir, "market_quotes").select("source", "market_id", "outcome", "row_id", "price", "load_id")
    return keep_one(quotes, {k: F.col(k) for k in ("source", "market_id", "outcome")}, ["load_id", "row_id"]).drop("load_id")


@_query("SELECT map_key, event_id, match_method FROM (SELECT *, row_number() OVER (PARTITION BY map_key ORDER BY part DESC, event_id NULLS LAST, match_method) AS rn FROM (SELECT *, CASE WHEN event_id IS NULL THEN 0 ELSE 1 END AS part FROM event_map)) WHERE rn = 1")
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a market of event_map, those with an event over those without."""
    rows = table(spark, sf_dir, "event_map").select("map_key", "event_id", "match_method")
    return latest.keep_last([rows.filter("event_id is null"), rows.filter("event_id is not null")], ["map_key"], [F.asc_nulls_last("event_id"), F.asc("match_method")])


@_query("""
    WITH p AS (SELECT rec_id, o.name AS name, o.price AS price FROM (SELECT rec_id, unnest(m.outcomes) AS o FROM (SELECT rec_id, unnest(b.markets) AS m FROM (SELECT rec_id, unnest(bookmakers) AS b FROM odds_events)) WHERE m.key = 'h2h') WHERE o.price > 1),
    q AS (SELECT rec_id, name, avg(1 / price) AS q, count(*) AS n_books FROM p GROUP BY rec_id, name)
    SELECT rec_id, name, round(q / s, 6) AS fair_prob, n_books FROM (SELECT *, sum(q) OVER (PARTITION BY rec_id) AS s, count(*) OVER (PARTITION BY rec_id) AS n FROM q) WHERE n >= 2""")
def vig_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fair probabilities of each event's sides from nested sportsbook prices."""
    prices = venues.sportsbook_prices(table(spark, sf_dir, "odds_events"), ("rec_id",))
    return consensus.margin_free(prices, "rec_id", "name", "price").select("rec_id", "name", F.round("fair_prob", 6).alias("fair_prob"), "n_books")


@_query("""
    SELECT rec_id, b.key AS book, count(*) AS n_outcomes, round(sum(o.price), 6) AS price_sum FROM (SELECT rec_id, b, unnest(m.outcomes) AS o FROM (SELECT rec_id, b, unnest(b.markets) AS m FROM (SELECT rec_id, unnest(bookmakers) AS b FROM odds_events))) GROUP BY rec_id, b.key""")
def nested_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes and prices by event and book, out of three levels of arrays."""
    books = table(spark, sf_dir, "odds_events").select("rec_id", F.explode("bookmakers").alias("b"))
    rows = books.select("rec_id", F.col("b.key").alias("book"), F.explode("b.markets").alias("m")).select("rec_id", "book", F.inline("m.outcomes"))
    return rows.groupBy("rec_id", "book").agg(F.count("*").alias("n_outcomes"), F.round(F.sum("price"), 6).alias("price_sum"))


@_query("""
    SELECT l_orderkey, l_linenumber, round(100 / (l_quantity * 10 + 100), 6) AS plus, round(l_quantity * 10 / (l_quantity * 10 + 100), 6) AS minus, round(1 / (l_quantity + 0.5), 6) AS decimal_odds, round(l_quantity / 100, 6) AS cents,
           round((l_tax + 0.1) / (l_tax + 0.1 + l_discount + 0.2), 6) AS two_way FROM lineitem""")
def odds_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds of several kinds as probabilities."""
    q, a, b = F.col("l_quantity"), F.col("l_tax") + 0.1, F.col("l_discount") + 0.2
    six = lambda x, n: F.round(x, 6).alias(n)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", six(odds.american(q * 10), "plus"), six(odds.american(-q * 10), "minus"), six(odds.decimal(q + 0.5), "decimal_odds"), six(odds.cents(q), "cents"), six(odds.without_margin(a, b), "two_way"))


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "kalshi_markets").filter("market_type = 'binary' and settle_result in ('yes', 'no')")
    return rows.select("ticker", F.regexp_extract("ticker", "^KX[A-Z]{3}", 0).alias("series"), F.col("last_price_dollars").try_cast("double").alias("predicted"), (F.col("settle_result") == "yes").cast("int").alias("outcome"), F.col("volume_fp").try_cast("double").alias("volume")).filter("predicted > 0 and predicted < 1 and volume > 0").drop("volume")


_SETTLED = "SELECT regexp_extract(ticker, '^KX[A-Z]{3}') AS series, try_cast(last_price_dollars AS DOUBLE) AS predicted, CASE WHEN settle_result = 'yes' THEN 1 ELSE 0 END AS outcome FROM kalshi_markets WHERE market_type = 'binary' AND settle_result IN ('yes', 'no') AND try_cast(volume_fp AS DOUBLE) > 0"


@_query(f"SELECT round_even(predicted * 10, 0) / 10 AS prob_bucket, count(*) AS n, round(avg(predicted), 4) AS predicted_mean, round(avg(outcome), 4) AS realized_rate FROM ({_SETTLED}) WHERE predicted > 0 AND predicted < 1 GROUP BY 1")
def calibration10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled markets' last prices against how they ended, by tenths."""
    return measures.calibration(_settled(spark, sf_dir), "predicted", "outcome", 10)


@_query(f"SELECT round_even(predicted * 5, 0) / 5 AS prob_bucket, count(*) AS n, round(avg(predicted), 4) AS predicted_mean, round(avg(outcome), 4) AS realized_rate FROM ({_SETTLED}) WHERE predicted > 0 AND predicted < 1 GROUP BY 1")
def calibration5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by fifths."""
    return measures.calibration(_settled(spark, sf_dir), "predicted", "outcome", 5)


@_query(f"""
    SELECT series, count(*) AS n, round(avg(CASE WHEN (predicted >= 0.5) = (outcome = 1) THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(avg((predicted - outcome) * (predicted - outcome)), 4) AS brier,
           CASE WHEN count(*) FILTER (WHERE predicted < 0.25) >= 10 THEN round(avg(predicted - outcome) FILTER (WHERE predicted < 0.25), 4) END AS longshot_overpricing
    FROM ({_SETTLED}) WHERE predicted > 0 AND predicted < 1 GROUP BY series""")
def brier_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, Brier score and how overpriced longshots were, by series."""
    return measures.accuracy(_settled(spark, sf_dir), "predicted", "outcome", ["series"])


_NOW = "2021-04-01 00:00:00"


@_query(f"""
    WITH top AS (SELECT source, max(snapshot_ts) AS t FROM market_quotes GROUP BY source),
    vol AS (SELECT source, snapshot_ts, count(*) AS n, count(implied_prob) AS there, count(*) FILTER (WHERE implied_prob < 0 OR implied_prob > 1) AS bad, count(*) FILTER (WHERE price_is_stale) AS stale FROM market_quotes GROUP BY source, snapshot_ts),
    per AS (SELECT source, median(n) AS usual, sum(n) AS all_rows FROM vol GROUP BY source),
    mk AS (SELECT q.source, count(DISTINCT market_id) AS n_markets FROM market_quotes q JOIN top ON q.source = top.source AND q.snapshot_ts = top.t GROUP BY q.source),
    diff AS (SELECT source, count(*) AS d FROM (SELECT DISTINCT source, market_id, outcome, snapshot_ts FROM market_quotes) GROUP BY source)
    SELECT source, n AS n_quotes, n_markets, round(1 - there / n, 4) AS null_rate, round(1 - d / all_rows, 4) AS duplicate_rate, bad AS prob_violations, n < 0.5 * usual AS partial_ingest, round(stale / n, 4) AS stale_price_rate
    FROM vol JOIN top USING (source) JOIN per USING (source) JOIN mk USING (source) JOIN diff USING (source) WHERE vol.snapshot_ts = top.t""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A health row for each source of quotes."""
    now = F.to_timestamp(F.lit(_NOW))
    out = measures.feed_quality(table(spark, sf_dir, "market_quotes"), now, ["source", "market_id", "outcome", "snapshot_ts"])
    return out.select("source", "n_quotes", "n_markets", "null_rate", "duplicate_rate", "prob_violations", "partial_ingest", "stale_price_rate")


_COMBOS = """
    SELECT source, n_raw, n / n_raw AS combo_rate FROM (SELECT source, arg_max(struct_pack(a := n_raw, b := n), snapshot_ts) AS x, x['a'] AS n_raw, x['b'] AS n FROM (
        SELECT lower(trim(source)) AS source, snapshot_ts, count(*) AS n_raw, count(*) FILTER (WHERE coalesce(t LIKE 'KXMVE%' OR c <> '' OR l > 0, false)) AS n
        FROM (SELECT *, json_extract_string(j, '$.ticker') AS t, json_extract_string(j, '$.mve_collection_ticker') AS c, json_array_length(j, '$.mve_selected_legs') AS l FROM (SELECT *, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM raw_records)) GROUP BY 1, 2) GROUP BY source)"""


@_query(_COMBOS)
def combo_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of baskets among each source's latest raw messages."""
    return venues.combo_rates(table(spark, sf_dir, "raw_records"))


@_query("""
    SELECT market_type, count(*) AS n_raw, round(avg(CASE WHEN coalesce(mve_collection_ticker <> '' OR len(mve_selected_legs) > 0 OR ticker LIKE 'KXMVE%', false) THEN 1.0 ELSE 0.0 END), 6) AS combo_rate FROM kalshi_markets GROUP BY market_type""")
def combo_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of baskets among the exchange's markets, by declared type, read from payloads as they come."""
    rows = table(spark, sf_dir, "kalshi_markets").select("market_type", F.from_json(F.to_json(F.struct("ticker", "mve_collection_ticker", "mve_selected_legs")), venues.PAYLOADS["kalshi"]).alias("p"))
    return rows.groupBy("market_type").agg(F.count("*").alias("n_raw"), F.round(F.avg(venues.is_combo(F.col("p")).cast("double")), 6).alias("combo_rate"))


@_query(f"""
    WITH top AS (SELECT source, max(snapshot_ts) AS t FROM market_quotes GROUP BY source),
    vol AS (SELECT source, snapshot_ts, count(*) AS n, count(implied_prob) AS there, count(*) FILTER (WHERE implied_prob < 0 OR implied_prob > 1) AS bad, count(*) FILTER (WHERE price_is_stale) AS stale FROM market_quotes GROUP BY source, snapshot_ts),
    per AS (SELECT source, median(n) AS usual, sum(n) AS all_rows FROM vol GROUP BY source),
    mk AS (SELECT q.source, count(DISTINCT market_id) AS n_markets FROM market_quotes q JOIN top ON q.source = top.source AND q.snapshot_ts = top.t GROUP BY q.source),
    diff AS (SELECT source, count(*) AS d FROM (SELECT DISTINCT source, market_id, outcome, snapshot_ts FROM market_quotes) GROUP BY source),
    c AS ({_COMBOS}), b AS (SELECT 'kalshi' AS source, avg((predicted - outcome) * (predicted - outcome)) AS brier FROM ({_SETTLED}) WHERE predicted > 0 AND predicted < 1),
    r AS (SELECT vol.*, n_markets, epoch_us(TIMESTAMPTZ '{_NOW}+00') AS now_us, 1 - there / n AS nr, 1 - d / all_rows AS dup, stale / n AS st, coalesce(combo_rate, 0) AS combo, n < 0.5 * usual AS partial, brier
          FROM vol JOIN top ON top.source = vol.source AND top.t = vol.snapshot_ts JOIN per ON per.source = vol.source JOIN mk ON mk.source = vol.source JOIN diff ON diff.source = vol.source LEFT JOIN c ON c.source = vol.source LEFT JOIN b ON b.source = vol.source),
    a AS (SELECT *, greatest((now_us - epoch_us(snapshot_ts)) / 6e7, 0) AS age FROM r),
    f AS (SELECT *, greatest(0, least(1, 1 - (age - 15) / 1425.0)) AS fresh, greatest(0, least(1, 1 - brier / 0.25)) AS calib FROM a),
    g AS (SELECT *, round(100 * CASE WHEN brier IS NULL THEN (0.4 * fresh + 0.4 * (1 - nr)) / 0.8 ELSE 0.4 * fresh + 0.4 * (1 - nr) + 0.2 * calib END, 1) AS score FROM f)
    SELECT source, n AS n_quotes, n_markets, snapshot_ts AS last_snapshot, age AS age_minutes, round(nr, 4) AS null_rate, round(dup, 4) AS duplicate_rate, bad AS prob_violations, partial AS partial_ingest, round(st, 4) AS stale_price_rate, round(combo, 4) AS combo_excluded_rate,
           score AS reliability_score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS reliability_grade,
           coalesce(nullif(concat_ws('; ', CASE WHEN age > 60 THEN printf('stale: last snapshot %.0f min ago', round(age)) END, CASE WHEN dup > 0 THEN printf('%.1f%% duplicate rows (idempotency broken)', round(dup * 100, 1)) END, CASE WHEN nr > 0.1 THEN printf('%.0f%% of implied_prob is null', round(nr * 100)) END,
               CASE WHEN bad > 0 THEN bad || ' probability values outside [0,1]' END, CASE WHEN partial THEN 'latest snapshot is unusually small (possible partial ingest)' END, CASE WHEN st > 0.05 THEN printf('%.0f%% of prices are stale-fallback, not live quotes', round(st * 100)) END,
               CASE WHEN combo > 0 THEN printf('%.0f%% of raw payloads were excluded combo/parlay markets', round(combo * 100)) END), ''), 'healthy') AS issues
    FROM g""")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole health row, with age, baskets, score, grade and issues in words; the exchange's calibration counts in its score."""
    brier = _settled(spark, sf_dir).agg(F.avg((F.col("predicted") - F.col("outcome")) ** 2).alias("brier")).withColumn("source", F.lit("kalshi"))
    quotes = table(spark, sf_dir, "market_quotes")
    combos = venues.combo_rates(table(spark, sf_dir, "raw_records"))
    return measures.feed_quality(quotes, F.to_timestamp(F.lit(_NOW)), ["source", "market_id", "outcome", "snapshot_ts"], combos=combos, brier=brier)


@_query("""
    SELECT load_id, source, round(100 * (0.4 * f + 0.4 * c) / 0.8, 1) AS uncalibrated, round(100 * (0.4 * f + 0.4 * c + 0.2 * k), 1) AS calibrated, round(k, 6) AS calibration
    FROM (SELECT load_id, source, CASE WHEN age_minutes IS NULL THEN 0 ELSE greatest(0, least(1, 1 - (age_minutes - 15) / 1425.0)) END AS f, greatest(0, least(1, 1 - null_rate)) AS c, greatest(0, least(1, 1 - stale_price_rate / 0.25)) AS k FROM source_health)""")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported health as scores, without a calibration and with one (the stale rate stands for a Brier score)."""
    fresh, complete, calibrated = stats.freshness(F.col("age_minutes")), stats.clamp(1 - F.col("null_rate"), 0.0, 1.0), stats.calibration_score(F.col("stale_price_rate"))
    return table(spark, sf_dir, "source_health").select("load_id", "source", stats.reliability(fresh, complete).alias("uncalibrated"), stats.reliability(fresh, complete, calibrated).alias("calibrated"), F.round(calibrated, 6).alias("calibration"))


@_query("SELECT pair_id, CASE WHEN decision LIKE 'manual%' THEN 'strong' WHEN confidence >= 0.8 THEN 'strong' WHEN confidence >= 0.6 THEN 'probable' ELSE 'weak' END AS tier FROM candidate_pairs")
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each scored pair can be trusted."""
    return table(spark, sf_dir, "candidate_pairs").select("pair_id", stats.match_tier(F.col("confidence"), F.col("decision").startswith("manual")).alias("tier"))


@_query("""
    SELECT 'not_null' AS test, 'price' AS column_name, count(*) FILTER (WHERE price IS NULL) AS n_failed FROM market_quotes UNION ALL SELECT 'not_null', 'implied_prob', count(*) FILTER (WHERE implied_prob IS NULL) FROM market_quotes
    UNION ALL SELECT 'range', 'implied_prob', count(*) FILTER (WHERE implied_prob < 0 OR implied_prob > 1) FROM market_quotes
    UNION ALL SELECT 'accepted_values', 'source', count(*) FILTER (WHERE source NOT IN ('kalshi', 'manifold', 'polymarket', 'oddsapi')) FROM market_quotes
    UNION ALL SELECT 'unique', 'quote_key', CAST(count(quote_key) - count(DISTINCT quote_key) AS BIGINT) FROM market_quotes""")
def data_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of market_quotes fail each declared test."""
    return measures.violations(table(spark, sf_dir, "market_quotes"), ["quote_key"], ["price", "implied_prob"], {"implied_prob": (0, 1)}, {"source": ["kalshi", "manifold", "polymarket", "oddsapi"]})


def _part_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))), " ").alias("words"))
    return similarity.set_classes(parts, "p_partkey", "words", ["p_type"])


@_query("""
    WITH c AS (SELECT min(p_partkey) AS id, p_type, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size), ' '))) AS t FROM part GROUP BY p_type, 3)
    SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard
    FROM c a JOIN c b ON a.p_type = b.p_type AND a.id < b.id WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.6""")
def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of parts of one type whose descriptions share at least 0.6 of their words; token_jaccard_members has the parts that each class stands for."""
    classes, _ = _part_classes(spark, sf_dir)
    return similarity.similar_classes(classes, 0.6, ["p_type"]).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@_query("""
    WITH w AS (SELECT p_partkey AS part, p_type, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size), ' '))) AS t FROM part),
    c AS (SELECT min(part) AS class_id, p_type, t, count(*) AS n_members FROM w GROUP BY p_type, t),
    l AS (SELECT a.class_id, count(*) AS n_links FROM c a JOIN c b ON a.p_type = b.p_type AND a.class_id <> b.class_id WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.6 GROUP BY a.class_id)
    SELECT part, class_id, n_members, coalesce(n_links, 0) AS n_links FROM w JOIN c USING (p_type, t) LEFT JOIN l USING (class_id)""")
def token_jaccard_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with the class of token_jaccard_pairs that stands for it, how many parts the class holds, and how many other classes it is linked to."""
    classes, members = _part_classes(spark, sf_dir)
    return similarity.membership(members, similarity.similar_classes(classes, 0.6, ["p_type"])).withColumnRenamed("p_partkey", "part")


_LINKS = "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT source_a || ':' || market_id_a AS a, source_b || ':' || market_id_b AS b FROM candidate_pairs WHERE decision IN ('match', 'manual-match')) WHERE a <> b"
_LABELS = f"""
    WITH RECURSIVE l AS ({_LINKS}), w AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    reach(n, r) AS (SELECT a, a FROM w UNION SELECT w.b, reach.r FROM reach JOIN w ON w.a = reach.n),
    roots AS (SELECT n AS node, min(r) AS label FROM reach GROUP BY n)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda s: F.concat_ws(":", f"source_{s}", f"market_id_{s}")
    return table(spark, sf_dir, "candidate_pairs").filter("decision in ('match', 'manual-match')").select(key("a").alias("a"), key("b").alias("b"))


@_query(_LABELS + " SELECT node, label FROM roots")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets linked by matching pairs, with the smallest market of their component."""
    return graph.labels(_links(spark, sf_dir))


@_query(_LABELS + " SELECT label, 'evt_' || substr(md5(string_agg(node, '|' ORDER BY node)), 1, 10) AS group_id FROM roots GROUP BY label")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id for each component, made of its members."""
    return graph.group_ids(graph.labels(_links(spark, sf_dir)), "label", "node")


@_query("""
    SELECT query, neighbour, rank FROM (SELECT q.vec_id AS query, r.vec_id AS neighbour,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 12) DESC, r.vec_id) AS rank
        FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5""")
def topk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return similarity.nearest(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "embedding", 5).select("query", "neighbour", "rank")


@_query(ORACLE["topk_neighbours"].replace("SELECT query, neighbour, rank FROM", "SELECT DISTINCT least(query, neighbour) AS a, greatest(query, neighbour) AS b FROM").replace("q.vec_id % 100 = 0)", "q.vec_id % 100 = 0 AND list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) >= 0.15)"))
def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that the five nearest vectors of at least 0.15 similarity make, each once, for every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    found = similarity.nearest(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "embedding", 5, least=0.15)
    return found.select(F.least("query", "neighbour").alias("a"), F.greatest("query", "neighbour").alias("b")).distinct()


@_query()
def seq_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the titles of each scored pair are, by sorted tokens and matching blocks."""
    joined = lambda c: F.array_join(titles.tokens(F.col(c)), " ")
    rows = table(spark, sf_dir, "candidate_pairs").select("pair_id", joined("title_a").alias("a"), joined("title_b").alias("b"))
    return rows.select("pair_id", F.round(titles.sequence_ratio("a", "b"), 6).alias("ratio"))


def _listing(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_FOLD = "'\\b(?:" + "|".join(a.replace("'", "''") for a in sorted(titles.ALIASES, key=len, reverse=True)) + ")\\b'"
_NAMES = "MAP {" + ", ".join(f"'{a.replace(chr(39), chr(39) * 2)}': '{n}'" for a, n in titles.ALIASES.items()) + "}"
_SYNONYMS = "MAP {" + ", ".join(f"'{a}': '{n}'" for a, n in titles.PREDICATE_SYNONYMS.items()) + "}"


def _folded(x: str) -> str:
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, {_FOLD}), regexp_extract_all({x}, {_FOLD})), lambda z: z[1] || coalesce({_NAMES}[z[2]], '')), '')"


@_query(rf"""
    WITH t AS ({ORACLE["union_sources"]}), n AS (SELECT *, lower(title) AS low, regexp_extract_all(title, '[\p{{L}}\p{{N}}_'']+') AS said FROM t WHERE length(title) > 0),
    w AS (SELECT *, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace({_folded('low')}, '[^a-z0-9._]+', ' ', 'g')), ' '), lambda x: x <> ''))) AS words, list_position(list_transform(said, lambda x: lower(x) IN {tuple(titles.SUBJECT_SKIP)}), false) AS begins FROM n),
    c AS (SELECT *, CASE WHEN begins > 0 THEN said[begins:] ELSE [] END AS rest FROM w),
    d AS (SELECT *, CASE WHEN len(rest) = 0 OR NOT regexp_matches(rest[1], '^[''"]?\p{{Lu}}') THEN [] ELSE rest[:coalesce(nullif(list_position(list_transform(rest, lambda x: regexp_matches(x, '^[''"]?\p{{Lu}}') OR lower(x) IN {tuple(titles.SUBJECT_CONNECTORS)}), false), 0), len(rest) + 1) - 1] END AS phrase FROM c),
    e AS (SELECT *, lower(array_to_string(phrase, ' ')) AS opened, list_filter(words, lambda x: NOT list_contains({_listing(titles.STOPWORDS)}, x)) AS tokens FROM d),
    f AS (SELECT *, list_sort(list_distinct(list_filter(string_split_regex({_folded('opened')}, '[^\p{{L}}\p{{N}}_]+'), lambda x: NOT list_contains({_listing([*titles.STOPWORDS, ''])}, x)))) AS subject, list_transform(words, lambda x: coalesce({_SYNONYMS}[x], x)) AS synonyms FROM e)
    SELECT source, market_id, array_to_string(tokens, ' ') AS tokens, array_to_string(list_sort(list_distinct(regexp_extract_all(low, '\d+(?:\.\d+)?'))), ' ') AS numbers, CASE WHEN len(subject) > 0 THEN array_to_string(subject, ' ') END AS subject,
           array_to_string(list_sort(list_filter(tokens, lambda x: list_contains({_listing([*titles.ALIASES.values(), *titles.MORE_ENTITIES])}, x))), ' ') AS entities, array_to_string(list_sort(list_distinct(list_filter(synonyms, lambda x: list_contains({_listing(titles.PREDICATES)}, x)))), ' ') AS predicate,
           CASE {" ".join(f"WHEN list_has_any(words, {_listing(keys)}) THEN '{name}'" for name, keys in titles.CATEGORIES.items())} ELSE 'other' END AS category
    FROM f""")
def title_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the venues' titles say: tokens, numbers, subject, entities, predicate, category."""
    out = resolve.features(union_sources(spark, sf_dir))
    return out.select("source", "market_id", *[F.array_join(c, " ").alias(c) for c in ("tokens", "numbers", "subject", "entities", "predicate")], "category")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = {"kalshi": ("kalshi_markets", "ticker", "title"), "manifold": ("manifold_markets", "id", "question"), "polymarket": ("polymarket_markets", "id", "question")}
    parts = [keep_one(table(spark, sf_dir, t).select(F.concat(F.lit(f"{s}:"), F.col(i)).alias("key"), F.col(c).alias("title"), "rec_id"), {"key": F.col("key")}, ["rec_id"]) for s, (t, i, c) in defaults.items()]
    closes = table(spark, sf_dir, "market_quotes").groupBy(F.concat_ws(":", "source", "market_id").alias("key")).agg(F.max("close_ts").alias("close_ts"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(closes, "key", "left")


@_query()
def resolve_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of markets that their titles' tokens, guards and closing days make a match or a near miss."""
    return resolve.resolve(_listed(spark, sf_dir)).candidate_pairs


@_query()
def resolve_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every market with the event that title matching puts it in."""
    return resolve.resolve(_listed(spark, sf_dir)).event_map


@_query(r"""
    SELECT rec_id, CASE WHEN w <> '' THEN CASE WHEN w IN ('above', 'over', 'greater than', 'at least') THEN 'above' ELSE 'below' END ELSE CASE WHEN s IN ('>', '>=', '≥') THEN 'above' ELSE 'below' END END AS direction,
           CASE WHEN w <> '' THEN CAST(regexp_extract(title, '(?i)(above|over|greater than|at least|below|under|less than)\s+(\d+(?:\.\d+)?)\s*(?:°|degrees?|f)\b', 2) AS DOUBLE) ELSE CAST(regexp_extract(title, '(>=|≥|>|<=|≤|<)\s*(\d+(?:\.\d+)?)\s*°', 2) AS DOUBLE) END AS value
    FROM (SELECT rec_id, title, lower(regexp_extract(title, '(?i)(above|over|greater than|at least|below|under|less than)\s+(\d+(?:\.\d+)?)\s*(?:°|degrees?|f)\b', 1)) AS w, regexp_extract(title, '(>=|≥|>|<=|≤|<)\s*(\d+(?:\.\d+)?)\s*°', 1) AS s
          FROM kalshi_markets WHERE regexp_matches(lower(title), 'temperature|temp|degrees|°')) WHERE w <> '' OR s <> ''""")
def threshold_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of temperature markets, read from their titles."""
    rows = table(spark, sf_dir, "kalshi_markets").filter(titles.about_temperature(F.col("title"))).select("rec_id", titles.threshold(F.col("title")).alias("t"))
    return rows.filter("t is not null").select("rec_id", "t.direction", "t.value")


_WORDS = {c: "|".join(k.replace(".", "[.]") for k in keys) for c, keys in titles.CATEGORIES.items()}


@_query("SELECT rec_id, CASE " + " ".join(f"WHEN regexp_matches(t, '(^| )({keys})( |$)') THEN '{c}'" for c, keys in _WORDS.items()) + " ELSE 'other' END AS category FROM (SELECT rec_id, regexp_replace(lower(title), '[^a-z0-9._]+', ' ', 'g') AS t FROM kalshi_markets)")
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of each title, by the first list with a word in it."""
    return table(spark, sf_dir, "kalshi_markets").select("rec_id", titles.category(titles.words(F.col("title"))).alias("category"))


@_query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of each event's JSON."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k bigint").getField("k").alias("k"))


@_query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN d <= 1 THEN 0.10 WHEN d <= 3 THEN 0.05 ELSE 0.0 END AS bonus FROM (SELECT l_orderkey, l_linenumber, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def date_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bonus for dates that lie close together."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", titles.day_bonus(F.to_date("o_orderdate"), F.to_date("l_shipdate")).cast("double").alias("bonus"))


def _erf(x: str) -> str:
    t = f"(1 / (1 + {stats._P} * abs({x})))"
    series = f"({t} * ({stats._A[0]} + {t} * ({stats._A[1]} + {t} * ({stats._A[2]} + {t} * ({stats._A[3]} + {t} * {stats._A[4]})))))"
    return f"(sign({x}) * (1 - {series} * exp(-({x}) * ({x}))))"


@_query(f"SELECT l_orderkey, l_linenumber, round(1 - 0.5 * (1 + {_erf('z / sqrt(2)')}), 6) AS chance FROM (SELECT l_orderkey, l_linenumber, (25.0 - l_quantity) / (CASE WHEN l_linestatus = 'O' THEN 4.0 ELSE 6.0 END) AS z FROM lineitem)")
def normal_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that a value forecast with a normal error comes out above a threshold."""
    sigma = F.when(F.col("l_linestatus") == "O", 4.0).otherwise(6.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(stats.chance_above(F.col("l_quantity"), F.lit(25.0), sigma), 6).alias("chance"))


_LOSS = "-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END"
_GRID = f"SELECT sigma, round(sum({_LOSS}), 6) AS loss, count(*) AS n FROM (SELECT sigma, y, greatest(1e-6, least(1 - 1e-6, 0.5 * (1 + {_erf('m / sigma / sqrt(2)')}))) AS p FROM rows, %s) GROUP BY sigma"


@_query(f"""
    WITH rows AS (SELECT l_quantity - 25.0 AS m, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
    coarse AS (SELECT arg_min(sigma, struct_pack(l := loss, s := sigma)) AS best, max(n) AS n FROM ({_GRID % '(SELECT 0.5 + 0.25 * i AS sigma FROM range(78) t(i))'})),
    fine AS ({_GRID % '(SELECT best - 0.25 + 0.02 * i AS sigma FROM coarse, range(26) t(i) WHERE best - 0.25 + 0.02 * i > 0)'})
    SELECT max(n) AS n, round(arg_min(sigma, struct_pack(l := loss, s := sigma)), 3) AS sigma FROM fine""")
def sigma_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest spread of errors, by two grids."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25.0).alias("margin"), (F.col("l_returnflag") == "R").cast("int").alias("outcome"))
    return measures.best_sigma(rows, "margin", "outcome")


_DAY = "SELECT station, substr(starttime, 1, 10) AS day, temperature, rec_id FROM forecast_periods WHERE isdaytime AND starttime IS NOT NULL AND temperature IS NOT NULL"


@_query(f"""
    WITH p AS ({_DAY}), k AS (SELECT rec_id, regexp_extract(ticker, '^KXHIGH([A-Z]{{3}})-', 1) AS station, '20' || regexp_extract(ticker, '-(\\d\\d)MAR(\\d\\d)-', 1) || '-03-' || regexp_extract(ticker, '-(\\d\\d)MAR(\\d\\d)-', 2) AS day FROM kalshi_markets WHERE regexp_matches(ticker, '^KXHIGH[A-Z]{{3}}-\\d\\dMAR\\d\\d-')),
    e AS (SELECT station, day, arg_min(temperature, rec_id) AS temperature FROM p GROUP BY station, day), f AS (SELECT station, arg_min(temperature, rec_id) AS temperature FROM p GROUP BY station)
    SELECT k.rec_id, k.station, k.day, coalesce(e.temperature, f.temperature) AS temperature FROM k LEFT JOIN e ON e.station = k.station AND e.day = k.day LEFT JOIN f ON f.station = k.station""")
def forecast_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each temperature market with its station's forecast for the day, or else the station's first one."""
    periods = table(spark, sf_dir, "forecast_periods").filter("isdaytime and starttime is not null and temperature is not null").select("station", F.substring("starttime", 1, 10).alias("day"), "temperature", "rec_id")
    part = lambda i: F.regexp_extract("ticker", r"^KXHIGH([A-Z]{3})-(\d\d)MAR(\d\d)-", i)
    asked = table(spark, sf_dir, "kalshi_markets").filter(part(1) != "").select(F.col("rec_id").alias("market"), part(1).alias("station"), F.concat(F.lit("20"), part(2), F.lit("-03-"), part(3)).alias("day"))
    return measures.lookup_or_first(asked, periods, "station", "day", "rec_id").select(F.col("market").alias("rec_id"), "station", "day", "found.temperature")


_HOT = "(above|over|greater than|at least|below|under|less than)\\s+(\\d+(?:\\.\\d+)?)\\s*(?:°|degrees?|f)\\b"


@_query(f"""
    WITH p AS ({_DAY}), k AS (SELECT DISTINCT ticker, regexp_extract(ticker, '^KXHIGH([A-Z]{{3}})-', 1) AS station, '20' || regexp_extract(ticker, '-(\\d\\d)MAR(\\d\\d)-', 1) || '-03-' || regexp_extract(ticker, '-(\\d\\d)MAR(\\d\\d)-', 2) AS day FROM kalshi_markets WHERE regexp_matches(ticker, '^KXHIGH[A-Z]{{3}}-\\d\\dMAR\\d\\d-')),
    e AS (SELECT station, day, arg_min(temperature, rec_id) AS temperature FROM p GROUP BY station, day), f AS (SELECT station, arg_min(temperature, rec_id) AS temperature FROM p GROUP BY station),
    q AS (SELECT * FROM (SELECT *, lower(regexp_extract(title, '(?i){_HOT}', 1)) AS w, try_cast(regexp_extract(title, '(?i){_HOT}', 2) AS DOUBLE) AS limit_f FROM ({_LATEST}) WHERE source = 'kalshi') WHERE w <> ''),
    j AS (SELECT q.market_id, q.implied_prob, limit_f, w, coalesce(e.temperature, f.temperature) AS forecast_f FROM q JOIN k ON k.ticker = q.market_id LEFT JOIN e ON e.station = k.station AND e.day = k.day LEFT JOIN f ON f.station = k.station),
    c AS (SELECT *, 1 - 0.5 * (1 + {_erf('(limit_f - forecast_f) / 4.0 / sqrt(2)')}) AS above FROM j WHERE forecast_f IS NOT NULL)
    SELECT market_id, limit_f, CAST(forecast_f AS DOUBLE) AS forecast_f, implied_prob, round(CASE WHEN w IN ('above', 'over', 'greater than', 'at least') THEN above ELSE 1 - above END, 6) AS forecast_prob FROM c""")
def forecast_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature markets whose title names a threshold in words: the latest quote beside the chance that the station's forecast gives it."""
    markets = forecast_lookup(spark, sf_dir).join(table(spark, sf_dir, "kalshi_markets").select("rec_id", "ticker"), "rec_id").groupBy("ticker").agg(F.max("temperature").cast("double").alias("forecast_f"))
    quotes = table(spark, sf_dir, "market_quotes").filter("source = 'kalshi'").select("row_id", "source", "market_id", "snapshot_ts", "title", _chance().alias("implied_prob")).filter("implied_prob is not null")
    rows = latest.latest_row(quotes, ["source", "market_id"], [F.desc("snapshot_ts"), F.desc("row_id")]).withColumn("t", titles.threshold(F.col("title")))
    rows = rows.filter(F.regexp_extract("title", titles.THRESHOLD_WORDS, 1) != "").join(markets.filter("forecast_f is not null"), F.col("market_id") == F.col("ticker"))
    above = stats.chance_above(F.col("forecast_f"), F.col("t.value"), F.lit(4.0))
    return rows.select("market_id", F.col("t.value").alias("limit_f"), "forecast_f", "implied_prob", F.round(F.when(F.col("t.direction") == "above", above).otherwise(1 - above), 6).alias("forecast_prob"))


_TICKER = r"^KXHIGH([A-Z]{3})-(\d\d)(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)(\d\d)-"
_BY_DAY = rf"""
    i AS ({cleaning.ORACLE['p3_found']}), z AS (SELECT station, min(zone_name) AS zone_name FROM forecast_stations GROUP BY station),
    p AS (SELECT p.station, strftime(timezone(z.zone_name, make_timestamptz(i.utc_micros)), '%Y-%m-%d') AS day, p.temperature, p.rec_id FROM forecast_periods p LEFT JOIN z ON z.station = p.station LEFT JOIN i ON i.table_name = 'forecast_periods' AND i.rec_id = p.rec_id WHERE p.isdaytime AND p.temperature IS NOT NULL),
    k AS (SELECT rec_id, ticker, regexp_extract(ticker, '{_TICKER}', 1) AS station, '20' || regexp_extract(ticker, '{_TICKER}', 2) || '-' || lpad(CAST((instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', regexp_extract(ticker, '{_TICKER}', 3)) + 2) // 3 AS VARCHAR), 2, '0') || '-' || regexp_extract(ticker, '{_TICKER}', 4) AS day FROM kalshi_markets WHERE regexp_matches(ticker, '{_TICKER}')),
    e AS (SELECT station, day, arg_min(temperature, rec_id) AS temperature FROM p WHERE day IS NOT NULL GROUP BY station, day), f AS (SELECT station, arg_min(temperature, rec_id) AS temperature FROM p GROUP BY station),
    x AS (SELECT k.rec_id, k.ticker, k.station, k.day, coalesce(e.temperature, f.temperature) AS temperature FROM k LEFT JOIN e ON e.station = k.station AND e.day = k.day LEFT JOIN f ON f.station = k.station)"""


def _asked(ticker: Column) -> tuple[Column, Column]:
    """The station and the day (yyyy-MM-dd) that a temperature market's ticker names, in any month; the station is '' where it names none."""
    part = lambda i: F.regexp_extract(ticker, _TICKER, i)
    month = F.floor((F.instr(F.lit(instants.MONTHS), F.lower(part(3))) + 2) / 3).cast("string")
    return part(1), F.concat(F.lit("20"), part(2), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), part(4))


@_query(f"WITH {_BY_DAY} SELECT rec_id, station, day, temperature FROM x")
def forecast_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """forecast_lookup for tickers of any month, forecasts in any notation: a forecast's day is that of its instant in the station's zone."""
    zones = table(spark, sf_dir, "forecast_stations").groupBy("station").agg(F.min("zone_name").alias("zone_name"))
    periods = table(spark, sf_dir, "forecast_periods").filter("isdaytime and temperature is not null").select("station", "starttime", "temperature", "rec_id").join(zones, "station", "left")
    timed = instants.normalise(periods, F.col("starttime"), F.lit("forecast"), F.col("zone_name"), F.lit("mdy"))
    day = F.date_format(F.from_utc_timestamp(F.timestamp_micros("utc_micros"), F.col("zone_name")), "yyyy-MM-dd")
    station, asked = _asked(F.col("ticker"))
    markets = table(spark, sf_dir, "kalshi_markets").filter(station != "").select(F.col("rec_id").alias("market"), station.alias("station"), asked.alias("day"))
    found = measures.lookup_or_first(markets, timed.select("station", day.alias("day"), "temperature", "rec_id"), "station", "day", "rec_id")
    return found.select(F.col("market").alias("rec_id"), "station", "day", "found.temperature")


_SIGNS = "(>=|≥|>|<=|≤|<)\\s*(\\d+(?:\\.\\d+)?)\\s*°"


@_query(f"""
    WITH {_BY_DAY}, m AS (SELECT ticker, CAST(max(temperature) AS DOUBLE) AS forecast_f FROM x GROUP BY ticker),
    q AS (SELECT row_id, market_id, snapshot_ts, implied_prob, lower(regexp_extract(title, '(?i){_HOT}', 1)) AS w, regexp_extract(title, '{_SIGNS}', 1) AS s, try_cast(regexp_extract(title, '(?i){_HOT}', 2) AS DOUBLE) AS wv, try_cast(regexp_extract(title, '{_SIGNS}', 2) AS DOUBLE) AS sv FROM market_quotes WHERE source = 'kalshi' AND implied_prob BETWEEN 0 AND 1),
    j AS (SELECT q.*, forecast_f, CASE WHEN w <> '' THEN wv ELSE sv END AS limit_f, CASE WHEN w <> '' THEN w IN ('above', 'over', 'greater than', 'at least') ELSE s IN ('>', '>=', '≥') END AS up FROM q JOIN m ON m.ticker = q.market_id WHERE (w <> '' OR s <> '') AND forecast_f IS NOT NULL),
    c AS (SELECT *, 1 - 0.5 * (1 + {_erf('(limit_f - forecast_f) / 4.0 / sqrt(2)')}) AS above FROM j)
    SELECT row_id, market_id, snapshot_ts, limit_f, forecast_f, implied_prob, round(CASE WHEN up THEN above ELSE 1 - above END, 6) AS forecast_prob FROM c""")
def forecast_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quote of a temperature market, its threshold in words or signs, beside the chance that the station's forecast for the day gives it."""
    markets = forecast_by_day(spark, sf_dir).join(table(spark, sf_dir, "kalshi_markets").select("rec_id", "ticker"), "rec_id").groupBy("ticker").agg(F.max("temperature").cast("double").alias("forecast_f"))
    quotes = table(spark, sf_dir, "market_quotes").filter("source = 'kalshi'").select("row_id", "market_id", "snapshot_ts", titles.threshold(F.col("title")).alias("t"), _chance().alias("implied_prob")).filter("implied_prob is not null and t is not null")
    rows = quotes.join(markets.filter("forecast_f is not null"), F.col("market_id") == F.col("ticker"))
    above = stats.chance_above(F.col("forecast_f"), F.col("t.value"), F.lit(4.0))
    return rows.select("row_id", "market_id", "snapshot_ts", F.col("t.value").alias("limit_f"), "forecast_f", "implied_prob", F.round(F.when(F.col("t.direction") == "above", above).otherwise(1 - above), 6).alias("forecast_prob"))


@_query(f"""
    SELECT kind, label, gap FROM (
        SELECT 'divergence' AS kind, source || ':' || market_id AS label, round(abs(implied_prob - (s - implied_prob) / (n - 1)), 8) AS gap FROM (SELECT q.*, sum(implied_prob) OVER w AS s, count(*) OVER w AS n FROM (SELECT l.source, l.market_id, l.implied_prob, e.event_id FROM ({_LATEST}) l JOIN ({_EVENTS}) e USING (source, market_id)) q WINDOW w AS (PARTITION BY event_id)) WHERE n > 1 AND event_id IN (SELECT event_id FROM (SELECT l.source, e.event_id FROM ({_LATEST}) l JOIN ({_EVENTS}) e USING (source, market_id)) GROUP BY event_id HAVING count(DISTINCT source) > 1)
        UNION ALL SELECT 'calibration', series, round(abs(avg(predicted - outcome)), 8) FROM ({_SETTLED}) WHERE predicted > 0 AND predicted < 1 GROUP BY series) WHERE gap >= 0.05""")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is far off: markets from their event's consensus, and series from how they ended."""
    a = loo_consensus(spark, sf_dir).select(F.lit("divergence").alias("kind"), F.concat_ws(":", "source", "market_id").alias("label"), F.col("abs_deviation").alias("gap"))
    b = _settled(spark, sf_dir).groupBy("series").agg(F.round(F.abs(F.avg(F.col("predicted") - F.col("outcome"))), 8).alias("gap")).select(F.lit("calibration").alias("kind"), F.col("series").alias("label"), "gap")
    return a.unionByName(b).filter("gap >= 0.05")


@_query("SELECT category, source, count(*) AS n_markets, count(*) FILTER (WHERE event_id IS NOT NULL) AS n_with_event FROM event_map GROUP BY category, source")
def diagnostics_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets by category and source, and how many have an event."""
    return table(spark, sf_dir, "event_map").groupBy("category", "source").agg(F.count("*").alias("n_markets"), F.count_if(F.col("event_id").isNotNull()).alias("n_with_event"))


@_query("""
    SELECT count(*) AS n_pairs_scored, count(*) FILTER (WHERE decision IN ('match', 'manual-match')) AS n_pairs_matched, count(*) FILTER (WHERE decision = 'no-match') AS n_near_miss,
           round(avg(confidence) FILTER (WHERE decision = 'no-match'), 4) AS near_miss_mean, round(max(confidence) FILTER (WHERE decision = 'no-match'), 4) AS near_miss_max FROM candidate_pairs""")
def diagnostics_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many scored pairs match, and how near the others came."""
    return measures.match_diagnostics(table(spark, sf_dir, "candidate_pairs"))


@_query("SELECT count(DISTINCT event_id) AS n_events, count(DISTINCT event_id) FILTER (WHERE event_id IN (SELECT event_id FROM event_map WHERE event_id IS NOT NULL GROUP BY event_id HAVING count(DISTINCT source) > 1)) AS n_cross FROM event_map")
def cross_venue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events there are, and how many that several venues list."""
    per = table(spark, sf_dir, "event_map").filter("event_id is not null").groupBy("event_id").agg(F.count_distinct("source").alias("n"))
    return per.agg(F.count("*").alias("n_events"), F.count_if(F.col("n") > 1).alias("n_cross"))


@_query("""
    WITH x AS (SELECT count(*) AS n FROM (SELECT event_id FROM event_map WHERE event_id IS NOT NULL GROUP BY event_id HAVING count(DISTINCT source) > 1)), m AS (SELECT count(*) AS n FROM event_map WHERE category IS NOT NULL)
    SELECT CASE WHEN m.n = 0 THEN 'no markets yet' WHEN x.n > 0 THEN x.n || ' event(s) of several sources matched' END AS reasons FROM x, m""")
def diagnostics_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why matching came out as it did, in words."""
    cross = cross_venue_events(spark, sf_dir).select("n_cross")
    return measures.reasons(table(spark, sf_dir, "event_map").select("category", "source").filter("category is not null"), diagnostics_pairs(spark, sf_dir), cross).select(F.array_join("reasons", "; ").alias("reasons"))


_ODDS = '{"sport_title": "VARCHAR", "commence_time": "VARCHAR", "home_team": "VARCHAR", "away_team": "VARCHAR", "id": "VARCHAR", "bookmakers": [{"markets": [{"key": "VARCHAR", "outcomes": [{"name": "VARCHAR", "price": "DOUBLE"}]}]}]}'


@_query(f"""
    WITH r AS (SELECT lower(trim(source)) AS source, trim(market_id, ' ' || chr(9) || chr(10) || chr(13)) AS market_id, snapshot_ts, CAST(payload AS JSON) AS j FROM raw_records WHERE json_valid(payload)),
    k AS (SELECT *, coalesce(json_extract_string(j, '$.title'), '') AS title, coalesce(try_cast(json_extract_string(j, '$.yes_bid_dollars') AS DOUBLE), try_cast(json_extract_string(j, '$.yes_bid') AS DOUBLE) / 100) AS bid, coalesce(try_cast(json_extract_string(j, '$.yes_ask_dollars') AS DOUBLE), try_cast(json_extract_string(j, '$.yes_ask') AS DOUBLE) / 100) AS ask,
            coalesce(try_cast(json_extract_string(j, '$.last_price_dollars') AS DOUBLE), try_cast(json_extract_string(j, '$.last_price') AS DOUBLE) / 100) AS last, greatest(try_cast(json_extract_string(j, '$.liquidity_dollars') AS DOUBLE), try_cast(json_extract_string(j, '$.volume_24h_fp') AS DOUBLE), try_cast(json_extract_string(j, '$.open_interest_fp') AS DOUBLE)) >= 1 AS traded
          FROM r WHERE source = 'kalshi' AND coalesce(json_extract_string(j, '$.status'), 'active') = 'active' AND NOT coalesce(json_extract_string(j, '$.ticker') LIKE 'KXMVE%' OR json_extract_string(j, '$.mve_collection_ticker') <> '' OR json_array_length(j, '$.mve_selected_legs') > 0, false)),
    live AS (SELECT *, CASE WHEN ask >= bid AND (bid + ask) / 2 > 0 AND (bid + ask) / 2 < 1 THEN (bid + ask) / 2 END AS mid, CASE WHEN traded AND last > 0 AND last < 1 THEN last END AS old FROM k),
    o AS (SELECT snapshot_ts, json_transform(j, '{_ODDS}') AS p FROM r WHERE source = 'oddsapi'),
    side AS (SELECT snapshot_ts, p['id'] AS id, p['sport_title'] AS sport, p['commence_time'] AS commence, p['home_team'] AS home, p['away_team'] AS away, unnest(list_filter(flatten(list_transform(p['bookmakers'], lambda b: coalesce(b['markets'], []))), lambda m: m['key'] = 'h2h')) AS m FROM o),
    price AS (SELECT * EXCLUDE (m), unnest(m['outcomes']) AS x FROM side),
    fair AS (SELECT id, snapshot_ts, sport, commence, home, away, x['name'] AS name, avg(1 / x['price']) AS q FROM price WHERE x['price'] > 1 GROUP BY ALL),
    odds AS (SELECT *, sum(q) OVER w AS s, count(*) OVER w AS n FROM fair WINDOW w AS (PARTITION BY id, snapshot_ts))
    SELECT source, market_id, 'YES' AS outcome, title, coalesce(mid, old) AS price, coalesce(mid, old) AS implied_prob, greatest(ask - bid, 0) AS spread, mid IS NULL AS price_is_stale, snapshot_ts, try_cast(json_extract_string(j, '$.close_time') AS TIMESTAMPTZ) AS close_ts FROM live WHERE coalesce(mid, old) IS NOT NULL
    UNION ALL SELECT source, market_id, 'YES', coalesce(json_extract_string(j, '$.question'), ''), p, CASE WHEN p > 0 AND p < 1 THEN p END, NULL, false, snapshot_ts, make_timestamptz(try_cast(json_extract_string(j, '$.closeTime') AS BIGINT) * 1000)
        FROM (SELECT *, try_cast(json_extract_string(j, '$.probability') AS DOUBLE) AS p FROM r WHERE source = 'manifold' AND json_extract_string(j, '$.outcomeType') = 'BINARY' AND coalesce(json_extract_string(j, '$.isResolved'), 'false') = 'false') WHERE p IS NOT NULL
    UNION ALL SELECT source, market_id, 'YES', coalesce(json_extract_string(j, '$.question'), ''), p, CASE WHEN p > 0 AND p < 1 THEN p END, greatest(try_cast(json_extract_string(j, '$.bestAsk') AS DOUBLE) - try_cast(json_extract_string(j, '$.bestBid') AS DOUBLE), 0), false, snapshot_ts, try_cast(json_extract_string(j, '$.endDate') AS TIMESTAMPTZ)
        FROM (SELECT *, try_cast(json_extract_string(CAST(json_extract_string(j, '$.outcomePrices') AS JSON), '$[0]') AS DOUBLE) AS p FROM r WHERE source = 'polymarket' AND coalesce(json_extract_string(j, '$.closed'), 'false') = 'false' AND coalesce(json_extract_string(j, '$.active'), 'true') = 'true'
              AND lower(trim(json_extract_string(CAST(json_extract_string(j, '$.outcomes') AS JSON), '$[0]'))) = 'yes' AND lower(trim(json_extract_string(CAST(json_extract_string(j, '$.outcomes') AS JSON), '$[1]'))) = 'no') WHERE p IS NOT NULL
    UNION ALL SELECT 'oddsapi', id || ':' || name, name, name || ' to win vs ' || CASE WHEN name = home THEN away ELSE home END || ' (' || sport || ')', round(q / s, 4), CASE WHEN q / s > 0 AND q / s < 1 THEN q / s END, NULL, false, snapshot_ts, try_cast(commence AS TIMESTAMPTZ) FROM odds WHERE n >= 2""")
def normalised_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from the raw messages of all venues."""
    return venues.quotes(table(spark, sf_dir, "raw_records"))


@_query("SELECT event_id, event_type, user_id, ts, value FROM events")
def stream_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, replayed as a stream that drains and stops, one copy of each landed."""
    place = os.path.join(shared_folder(spark), f"drain-{uuid.uuid4().hex}")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id", "ts", "value").schema
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return topic.once(spark, f"{sf_dir}/events.parquet*", spec, ["event_id"], ["ts"], f"{place}/checkpoint", f"{place}/out")


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes, each with its own snapshot, written to a new lake and read again."""
    root = os.path.join(shared_folder(spark), f"lake-{uuid.uuid4().hex}")
    lake.write_quotes(table(spark, sf_dir, "market_quotes").select("source", "market_id", "outcome", "title", "price", "implied_prob", "snapshot_ts", "close_ts"), root)
    return lake.read_quotes(spark, root)


@_query("SELECT source, count(*) AS n FROM (SELECT DISTINCT source, market_id, outcome, snapshot_ts FROM (SELECT source, market_id, outcome, date_trunc('day', snapshot_ts) AS snapshot_ts FROM market_quotes)) GROUP BY source")
def lake_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quotes written to the lake and read again: how many markets' outcomes are quoted on each day, summed by source."""
    days = _landed(spark, sf_dir).select("source", "market_id", "outcome", F.date_trunc("day", "snapshot_ts").alias("day")).distinct()
    return days.groupBy("source").agg(F.count("*").alias("n"))


@_query("SELECT source, count(*) AS n FROM (SELECT DISTINCT source, market_id, outcome, snapshot_ts FROM market_quotes) GROUP BY source")
def lake_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of every snapshot written to the lake and read again, by source."""
    return _landed(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


_GROUPS = " ".join(f"WHEN regexp_matches(upper(ticker), '{'|'.join(marks)}') THEN '{g}'" for g, marks in titles.TICKER_GROUPS.items())


@_query(f"SELECT rec_id, CASE {_GROUPS} ELSE 'other' END AS market_group FROM kalshi_markets")
def market_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each market, from its ticker."""
    return table(spark, sf_dir, "kalshi_markets").select("rec_id", titles.ticker_group(F.col("ticker")).alias("market_group"))


@_query("""
    SELECT key, x['s'] AS best_score, x['m'] AS best_method FROM (SELECT key, max(struct_pack(s := confidence, m := match_method)) AS x FROM (
        SELECT source_a || ':' || market_id_a AS key, confidence, match_method FROM candidate_pairs UNION ALL SELECT source_b || ':' || market_id_b, confidence, match_method FROM candidate_pairs) GROUP BY key)""")
def best_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best scored pair of each market."""
    key = lambda s: F.concat_ws(":", f"source_{s}", f"market_id_{s}")
    pairs = table(spark, sf_dir, "candidate_pairs").select(key("a").alias("a"), key("b").alias("b"), "confidence", "match_method")
    return measures.best_links(pairs, "a", "b", "confidence", "match_method")


@_query("SELECT (SELECT count(*) FROM market_quotes) AS n_quotes, (SELECT count(DISTINCT source) FROM market_quotes) AS n_sources, (SELECT max(snapshot_ts) FROM market_quotes) AS last_snapshot, (SELECT count(DISTINCT event_id) FROM event_map) AS n_events")
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-line counts."""
    quotes = table(spark, sf_dir, "market_quotes").agg(F.count("*").alias("n_quotes"), F.count_distinct("source").alias("n_sources"), F.max("snapshot_ts").alias("last_snapshot"))
    events = table(spark, sf_dir, "event_map").agg(F.count_distinct("event_id").alias("n_events"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(quotes).join(one(events), "one").drop("one")


@_query("SELECT row_id, source, title FROM market_quotes WHERE regexp_matches(title, '(?i)temperature in .*haven') AND source IN ('kalshi', 'polymarket')")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of some sources whose title fits a pattern, whatever its case."""
    return table(spark, sf_dir, "market_quotes").filter(F.col("source").isin("kalshi", "polymarket") & F.col("title").rlike("(?i)temperature in .*haven")).select("row_id", "source", "title")


@_query("SELECT pair_id, title_a, title_b, confidence FROM candidate_pairs WHERE decision = 'no-match' ORDER BY confidence DESC, pair_id LIMIT 50")
def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty pairs that came nearest to a match."""
    return table(spark, sf_dir, "candidate_pairs").filter("decision = 'no-match'").select("pair_id", "title_a", "title_b", "confidence").orderBy(F.desc("confidence"), "pair_id").limit(50)


@_query("""
    WITH keyed AS (SELECT substr(md5(source || '|' || market_id || '|' || outcome), 1, 16) AS signal_key, load_id, row_id, source, market_id FROM market_quotes)
    SELECT signal_key, load_id, row_id, source, market_id FROM (SELECT *, row_number() OVER (PARTITION BY signal_key ORDER BY CASE WHEN load_id <= 2 THEN 0 ELSE 1 END, load_id, row_id) AS rn FROM keyed) WHERE rn = 1""")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed log of the first loads, to which later loads add only what it doesn't have."""
    key = F.substring(F.md5(F.concat_ws("|", "source", "market_id", "outcome")), 1, 16)
    rows = table(spark, sf_dir, "market_quotes").select(key.alias("signal_key"), "load_id", "row_id", "source", "market_id")
    order = [F.asc("load_id"), F.asc("row_id")]
    log = latest.latest_row(rows.filter("load_id <= 2"), ["signal_key"], order)
    return latest.append_new(log, rows.filter("load_id > 2"), "signal_key", order)


@_query(f"""
    SELECT ticker, q.row_id, q.implied_prob, s.outcome, CASE WHEN (q.implied_prob >= 0.5) = (s.outcome = 1) THEN 1 ELSE 0 END AS hit, round_even(q.implied_prob * 5, 0) / 5 AS prob_bucket
    FROM ({_LATEST}) q JOIN (SELECT ticker, max(CASE WHEN settle_result = 'yes' THEN 1 ELSE 0 END) AS outcome FROM kalshi_markets WHERE settle_result IN ('yes', 'no') GROUP BY ticker) s ON q.market_id = s.ticker WHERE q.source = 'kalshi'""")
def score_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest quote of each settled market against its outcome."""
    settled = table(spark, sf_dir, "kalshi_markets").filter("settle_result in ('yes', 'no')").groupBy("ticker").agg(F.max((F.col("settle_result") == "yes").cast("int")).alias("outcome"))
    rows = _latest_quotes(spark, sf_dir).filter("source = 'kalshi'").join(settled, F.col("market_id") == F.col("ticker"))
    p = F.col("implied_prob")
    return rows.select("ticker", "row_id", "implied_prob", "outcome", ((p >= 0.5) == (F.col("outcome") == 1)).cast("int").alias("hit"), stats.bucket(p, 5).alias("prob_bucket"))


@_query(f"SELECT substr(string_agg(line, chr(10) ORDER BY gap DESC, line), 1, 1900) AS message FROM (SELECT gap, printf('%s %s off by %.4f', kind, substr(label, 1, 70), round(gap, 4)) AS line FROM ({ORACLE['alerts']}))")
def alert_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts as one message, the widest first."""
    found = alerts(spark, sf_dir)
    return measures.digest(found, F.format_string("%s %s off by %.4f", "kind", F.substring("label", 1, 70), "gap"), F.col("gap"))


@_query(f"WITH s AS ({ORACLE['score_quotes']}) SELECT (SELECT count(*) FROM ({_LATEST}) WHERE source = 'kalshi') AS n_logged, (SELECT count(*) FROM s) AS n_resolved, (SELECT round(avg(hit), 4) FROM s) AS hit_rate")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exchange's latest quotes have an outcome, and how often they were right."""
    return measures.score_summary(_latest_quotes(spark, sf_dir).filter("source = 'kalshi'"), score_quotes(spark, sf_dir))


_CITIES = {"MOUTH": ["dellmouth", "fennmouth"], "HAVEN": ["dellhaven", "varnhaven"], "SAINT": ["saint elsholt", "st elsholt"], "ARD": ["ard", "ardmouth"]}


@_query(f"SELECT rec_id, CASE {' '.join(f'WHEN regexp_matches(lower(title), {chr(39)}' + chr(92) + 'b(' + '|'.join(w) + ')' + chr(92) + f'b{chr(39)}) THEN {chr(39)}{k}{chr(39)}' for k, w in _CITIES.items())} END AS place FROM kalshi_markets")
def title_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place that each market's title names, by a dictionary whose first fitting entry counts."""
    return table(spark, sf_dir, "kalshi_markets").select("rec_id", forecasts.place(F.col("title"), _CITIES).alias("place"))


@_query("""
    SELECT location, day, high_f, ordinal FROM (SELECT station AS location, substr(starttime, 1, 10) AS day, CAST(temperature AS DOUBLE) AS high_f, isdaytime, row_number() OVER (PARTITION BY station ORDER BY rec_id) - 1 AS ordinal FROM forecast_periods) WHERE isdaytime AND high_f IS NOT NULL""")
def forecast_highs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily highs out of forecast pages: each station's periods are put into a page's JSON and read from it again."""
    period = F.struct("rec_id", F.struct(F.col("starttime").alias("startTime"), F.col("isdaytime").alias("isDaytime"), "temperature").alias("p"))
    pages = table(spark, sf_dir, "forecast_periods").groupBy("station").agg(F.array_sort(F.collect_list(period)).alias("l"))  # a page holds a station's periods
    page = F.to_json(F.struct(F.struct(F.transform("l", lambda x: x["p"]).alias("periods")).alias("properties")), {"ignoreNullFields": "false"})
    return forecasts.highs(pages.select(F.col("station").alias("location"), page.alias("payload"))).select("location", "day", "high_f", "ordinal")


@_query("""
    SELECT source, count(*) AS n FROM (SELECT DISTINCT 'manifold' AS source, id FROM manifold_markets UNION ALL SELECT DISTINCT 'polymarket', id FROM polymarket_markets) GROUP BY source""")
def searched_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets found by several keywords, as answers of two venues' searches (one a list, one nested in events), merged by id."""
    def answers(name: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(F.pmod(F.xxhash64("rec_id"), F.lit(64)).alias("keyword"), F.to_json(F.struct("id", "question")).alias("m"))
        return rows.groupBy("keyword").agg(F.concat_ws(",", F.collect_list("m")).alias("m"))

    flat = feeds.listed(answers("manifold_markets").select("keyword", F.concat(F.lit("["), "m", F.lit("]")).alias("answer")))
    deep = feeds.nested(answers("polymarket_markets").select("keyword", F.concat(F.lit('{"events": [{"markets": ['), "m", F.lit("]}]}")).alias("answer")))
    found = feeds.records(feeds.merged(flat, ["keyword"]), "manifold").unionByName(feeds.records(feeds.merged(deep, ["keyword"]), "polymarket"))
    return found.groupBy("source").agg(F.count("*").alias("n"))


@_query("SELECT category, source, count(*) AS n_markets, count(*) FILTER (WHERE regexp_matches(lower(title), '\\b(boston|chicago|denver|miami|austin|group)\\b')) AS n_with_entity FROM event_map GROUP BY category, source")
def entity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets by category and source, and how many name an entity of the fixed list."""
    rows = table(spark, sf_dir, "event_map").select("category", "source", (F.size(titles.entities(titles.tokens(F.col("title")))) > 0).alias("named"))
    return rows.groupBy("category", "source").agg(F.count("*").alias("n_markets"), F.count_if("named").alias("n_with_entity"))


@_query("""
    SELECT source, count(*) AS n, count(*) FILTER (WHERE payload IS NULL) AS n_empty, count(*) FILTER (WHERE source IS NULL OR market_id IS NULL OR snapshot_ts IS NULL) AS n_damaged, max(snapshot_ts) AS last FROM raw_records GROUP BY source""")
def message_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records as messages of a topic, read back, by source."""
    back = topic.decode(topic.encode(table(spark, sf_dir, "raw_records")))
    return back.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("payload").isNull()).alias("n_empty"), F.count_if(F.col("damaged").isNotNull()).alias("n_damaged"), F.max("snapshot_ts").alias("last"))


@_query("""
    WITH k AS (SELECT DISTINCT source || ':' || market_id AS k FROM event_map),
    p AS (SELECT least(source_a || ':' || market_id_a, source_b || ':' || market_id_b) AS a, greatest(source_a || ':' || market_id_a, source_b || ':' || market_id_b) AS b, decision, confidence, match_method FROM candidate_pairs),
    s AS (SELECT a, b, max(confidence) AS confidence FROM p WHERE a <> b AND decision IN ('match', 'no-match') GROUP BY a, b),
    o AS (SELECT a, b, min(CASE WHEN decision = 'manual-match' THEN 'match' ELSE 'block' END) AS relation FROM p WHERE a <> b AND decision LIKE 'manual%' AND a IN (SELECT k FROM k) AND b IN (SELECT k FROM k) GROUP BY a, b)
    SELECT coalesce(s.a, o.a) AS a, coalesce(s.b, o.b) AS b, CASE WHEN relation = 'match' THEN 1.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN relation = 'match' THEN 'manual-match' WHEN relation = 'block' THEN 'manual-block' WHEN confidence >= 0.6 THEN 'match' ELSE 'no-match' END AS decision, CASE WHEN relation IS NULL THEN 'fuzzy' ELSE 'manual' END AS method
    FROM s FULL JOIN o ON s.a = o.a AND s.b = o.b""")
def overruled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs with the manual decisions among them put in, also for pairs that were never scored, if both markets are known."""
    key = lambda s: F.concat_ws(":", f"source_{s}", f"market_id_{s}")
    pairs = table(spark, sf_dir, "candidate_pairs").select(F.least(key("a"), key("b")).alias("a"), F.greatest(key("a"), key("b")).alias("b"), "decision", "confidence").filter("a != b")
    scored = pairs.filter("decision in ('match', 'no-match')").groupBy("a", "b").agg(F.max("confidence").alias("confidence")).withColumns({"decision": F.when(F.col("confidence") >= resolve.THRESHOLD, "match").otherwise("no-match"), "method": F.lit("fuzzy")})
    manual = pairs.filter("decision like 'manual%'").select("a", "b", F.regexp_replace("decision", "manual-", "").alias("relation"))
    known = table(spark, sf_dir, "event_map").select(F.concat_ws(":", "source", "market_id").alias("key")).distinct()
    return resolve.overrule(scored, manual, known, "key").select("a", "b", "confidence", "decision", "method")


@_query("""
    WITH o AS (SELECT ticker AS market_id, max(CASE WHEN settle_result = 'yes' THEN 1 ELSE 0 END) AS outcome FROM kalshi_markets WHERE settle_result IN ('yes', 'no') GROUP BY ticker)
    SELECT market_id, CASE WHEN market_id LIKE '%T0' THEN 1 - outcome ELSE outcome END AS outcome FROM o""")
def outcome_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of settled markets put into CSV files, some of them corrected by a second run, and read again: the later one holds."""
    path = os.path.join(shared_folder(spark), f"outcomes-{uuid.uuid4().hex}")
    settled = table(spark, sf_dir, "kalshi_markets").filter("settle_result in ('yes', 'no')").groupBy(F.col("ticker").alias("market_id")).agg(F.max((F.col("settle_result") == "yes").cast("int")).alias("outcome"))
    lake.upsert_outcomes(spark, settled, path)
    lake.upsert_outcomes(spark, settled.filter("market_id like '%T0'").withColumn("outcome", 1 - F.col("outcome")), path)
    return lake.resolutions(spark, path)


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their values by hour and type: the windowed sums of a stream, over all that is there."""
    found = topic.windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], F.when(~F.isnan("value"), F.col("value")))
    return found.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))
