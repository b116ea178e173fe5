"""The queries of problems 5, 6, 8, 9 and 10, over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import groups, matching, mixing, packing, spans, tokens
from quotemill.operators import instants
from quotemill.session import table


def _markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binary markets of three venues, one row each, with the time they close and what their tickers say."""
    defaults = F.broadcast(table(spark, sf_dir, "venue_defaults").groupBy("source").agg(F.min("zone_name").alias("zone_name"), F.min("date_order").alias("date_order")))  # a row a venue
    exchange = table(spark, sf_dir, "kalshi_markets").filter("market_type = 'binary'")
    listed = [
        exchange.select("rec_id", F.lit("kalshi").alias("venue"), F.col("ticker").alias("id"), "title", F.col("close_time").alias("text")),
        table(spark, sf_dir, "manifold_markets").select("rec_id", F.lit("manifold").alias("venue"), "id", F.col("question").alias("title"), F.col("closetime").alias("text")),
        table(spark, sf_dir, "polymarket_markets").select("rec_id", F.lit("polymarket").alias("venue"), "id", F.col("question").alias("title"), F.col("enddate").alias("text")),
    ]
    rows = listed[0].unionByName(listed[1]).unionByName(listed[2]).withColumn("key", F.concat_ws(":", "venue", "id"))
    rows = rows.groupBy("key", "venue").agg(F.min_by(F.struct("id", "title", "text"), "rec_id").alias("r")).select("key", "venue", "r.*")
    whole_day = F.coalesce(F.trim("text").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    text = F.when(whole_day, F.concat(F.trim("text"), F.lit("T00:00:00Z"))).otherwise(F.col("text"))
    timed = instants.normalise(rows.withColumns({"whole_day": whole_day, "text": text}).join(defaults, F.col("venue") == F.col("source"), "left"), F.col("text"), F.col("venue"), F.col("zone_name"), F.col("date_order"))
    stamp = r"-(\d{2}[A-Z]{3}\d{2})(?:V\d+)?-([TB])(\d+(?:\.\d+)?)$"
    of = lambda i: F.when(F.col("venue") == "kalshi", F.nullif(F.regexp_extract("id", stamp, i), F.lit("")))
    day = F.try_to_timestamp(F.concat(F.substring(of(1), 1, 2), F.substring(of(1), 3, 1), F.lower(F.substring(of(1), 4, 2)), F.substring(of(1), 6, 2)), F.lit("yyMMMdd")).cast("date")
    return timed.select("key", "venue", "title", F.col("utc_micros").alias("close"), "whole_day", day.alias("hint_day"), F.when(of(2) == "T", 1).when(of(2) == "B", -1).alias("hint_direction"), of(3).try_cast("double").alias("hint_threshold"))


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs of markets with their marginal probability."""
    places = table(spark, sf_dir, "forecast_stations").select(F.col("station").alias("code"), F.col("city").alias("name"))
    return matching.match(_markets(spark, sf_dir), places).select(F.col("a").alias("market_a"), F.col("b").alias("market_b"), "confidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of markets of different venues that more likely than not ask the same thing."""
    return p5_matches(spark, sf_dir).filter("confidence >= 0.5").select("market_a", "market_b")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each market of event_map that is linked to another one, with its group."""
    key = lambda suffix="": F.concat_ws(":", f"source{suffix}", f"market_id{suffix}")
    pairs, mapped = table(spark, sf_dir, "candidate_pairs"), table(spark, sf_dir, "event_map").select(key().alias("market_key"), "event_id")
    links = groups.decided(pairs, key("_a"), key("_b"), F.col("decision"), ("match", "manual-match"), ("manual-block",))
    found = groups.components(links.unionByName(groups.stars(mapped, "event_id", "market_key")))
    return mapped.select("market_key").distinct().join(found, F.col("market_key") == F.col("node")).select("market_key", F.col("component").alias("group_key"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document goes in containers of each capacity."""
    return packing.pack(tokens.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_limits"))


def p8_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens lost, containers overfull, documents split without need and parts that overlap, by capacity; all must be 0."""
    sizes, limits = tokens.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_limits")
    return packing.faults(packing.pack(sizes, limits), sizes, limits)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well containers of each capacity are filled."""
    return packing.report(p8_pack(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used so that sources reach their target shares."""
    # What the table tells of a record's content: series or single, and how much is said in it.
    said = F.when(F.col("n_cues") < 20, "short").when(F.col("n_cues") < 80, "middle").otherwise("long")
    topic = F.concat_ws(" ", F.when(F.col("episode").isNull(), "single").otherwise("series"), said)
    docs = table(spark, sf_dir, "documents").withColumns({"language": F.lower(F.substring("lang", 1, 2)), "topic": topic})
    return mixing.mix(tokens.sized(docs, keep=("source", "language", "topic")), table(spark, sf_dir, "mix_targets"))


def p9_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source with a target: whether a document was used more often than allowed, and whether the tokens reached are off the target (scaled to the sources that have documents) by more than the longest document used, as no document is split."""
    targets, mixed = table(spark, sf_dir, "mix_targets"), p9_mix(spark, sf_dir)
    told = mixing.report(mixed, targets).filter("tokens > 0")
    whole = told.agg(F.sum("target_share").alias("whole"), F.sum("tokens").alias("every")).withColumn("_one", F.lit(1))
    longest = mixed.agg(F.max("n_tokens").alias("longest")).withColumn("_one", F.lit(1))
    off = F.abs(F.col("actual_share") - F.col("target_share") / F.col("whole")) * F.col("every") > F.col("longest")
    return told.withColumn("_one", F.lit(1)).join(whole, "_one").join(longest, "_one").select("source", (F.col("most_copies") > F.col("max_repeats")).alias("repeated_too_often"), off.alias("off_target"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return mixing.report(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each longest stretch of a document that also stands verbatim in other documents."""
    return spans.stretches(spans.shared_runs(table(spark, sf_dir, "documents"), origins=False))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    docs = table(spark, sf_dir, "documents")
    return spans.shared_share(docs, spans.stretches(spans.shared_runs(docs, origins=False)))


def p10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches that go if only the earliest document keeps a shared one."""
    return spans.repeats(spans.shared_runs(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (p5_found, p5_matches, p6_found, p8_pack, p8_report, p8_faults, p9_mix, p9_report, p9_faults, p10_found, p10_shared, p10_repeats)}

_SPANS = """
        marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM runs),
        spans AS (SELECT doc_id, CAST(min(s) AS INTEGER) AS span_start, CAST(max(s) + 200 AS INTEGER) AS span_end FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM marked) GROUP BY doc_id, island)"""
_RUNS = """
        WITH w AS (SELECT doc_id, s, hash(substr(text, CAST(s + 1 AS BIGINT), 200)) AS g FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS s FROM documents WHERE length(text) >= 200)),
        runs AS (SELECT doc_id, s FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING min(doc_id) <> max(doc_id))),"""

_RUNS += _SPANS
# A run belongs to the smallest document that it stands in, whatever stands around it.
_LATER = """
        WITH w AS (SELECT doc_id, s, hash(substr(text, CAST(s + 1 AS BIGINT), 200)) AS g FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS s FROM documents WHERE length(text) >= 200)),
        runs AS (SELECT doc_id, s FROM w JOIN (SELECT g, min(doc_id) AS owner FROM w GROUP BY g) USING (g) WHERE owner < doc_id),""" + _SPANS

ORACLE = {
    # What must hold whatever the way there: nothing is lost, overfull or needlessly split, no cap is broken and every share reached.
    "p8_faults": "SELECT limit_name, 0::BIGINT AS lost_tokens, 0::BIGINT AS overfull, 0::BIGINT AS needless_splits, 0::BIGINT AS overlaps FROM pack_limits WHERE capacity_tokens >= 1",
    "p9_faults": "SELECT source, false AS repeated_too_often, false AS off_target FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE length(text) > 0)",
    "p10_repeats": _LATER + " SELECT doc_id, span_start, span_end FROM spans",
    "p10_found": _RUNS + " SELECT doc_id, span_start, span_end FROM spans",
    "p10_shared": _RUNS
    + """ SELECT d.doc_id, length(d.text) AS n_chars, coalesce(n, 0) AS n_spans, coalesce(c, 0) AS shared_chars, CASE WHEN length(d.text) > 0 THEN coalesce(c, 0) / length(d.text) END AS shared_share
        FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(span_end - span_start)::BIGINT AS c FROM spans GROUP BY doc_id) s USING (doc_id)""",
    "p6_found": """
        WITH RECURSIVE votes AS (
            SELECT least(source_a || ':' || market_id_a, source_b || ':' || market_id_b) AS a, greatest(source_a || ':' || market_id_a, source_b || ':' || market_id_b) AS b,
                   bool_or(coalesce(decision IN ('match', 'manual-match'), false)) AS yes, bool_or(coalesce(decision = 'manual-block', false)) AS no
            FROM candidate_pairs GROUP BY 1, 2),
        mapped AS (SELECT DISTINCT source || ':' || market_id AS k, event_id FROM event_map),
        star AS (SELECT min(k) OVER (PARTITION BY event_id) AS a, k AS b FROM mapped WHERE trim(event_id) <> ''),
        links AS (SELECT a, b FROM votes WHERE yes AND NOT no AND a <> b UNION SELECT a, b FROM star WHERE a <> b),
        both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(n, r) AS (SELECT a, a FROM both_ways UNION SELECT w.b, reach.r FROM reach JOIN both_ways w ON w.a = reach.n WHERE reach.r < w.b OR reach.r <= reach.n),
        roots AS (SELECT n, min(r) AS r FROM reach GROUP BY n)
        SELECT DISTINCT k AS market_key, r AS group_key FROM mapped JOIN roots ON roots.n = k""",
}
