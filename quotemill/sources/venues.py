"""Raw venue payloads brought to one quote schema, as DataFrame programs that serve batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions import odds
from quotemill.functions.columns import let, stripped

RAW = "source string, market_id string, snapshot_ts timestamp, payload string"
QUOTE = "source string, market_id string, outcome string, title string, price double, implied_prob double, spread double, price_is_stale boolean, snapshot_ts timestamp, close_ts timestamp"
#: Payloads by venue.
PAYLOADS = {
    "kalshi": "ticker string, title string, status string, yes_bid_dollars string, yes_ask_dollars string, last_price_dollars string, yes_bid double, yes_ask double, last_price double, close_time string, volume_24h_fp string, open_interest_fp string, liquidity_dollars string, mve_collection_ticker string, mve_selected_legs array<struct<market_ticker:string,side:string>>",
    "manifold": "id string, question string, outcomeType string, probability double, closeTime string, isResolved boolean, volume double",
    "polymarket": "id string, question string, outcomes string, outcomePrices string, active boolean, closed boolean, bestBid double, bestAsk double, endDate string",
    "oddsapi": "id string, sport_title string, commence_time string, home_team string, away_team string, bookmakers array<struct<key:string,title:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double>>>>>>",
}
#: Instants outside these years are taken for mistakes.
YEARS = (1700, 2261)


def parsed(raw: DataFrame, venue: str) -> DataFrame:
    """One venue's raw records with their payload read as p (null where it is damaged). Spelling of source and outer space of market_id don't matter."""
    rows = raw.filter(F.lower(stripped(F.col("source"))) == venue)
    return rows.select(F.lit(venue).alias("source"), stripped(F.col("market_id")).alias("market_id"), "snapshot_ts", F.from_json("payload", PAYLOADS[venue]).alias("p"))


def clamped(ts: Column) -> Column:
    return F.when(F.year(ts).between(*YEARS), ts)


def millis(value: Column) -> Column:
    return clamped(F.timestamp_millis(value.try_cast("bigint")))


def iso(text: Column) -> Column:
    return clamped(F.try_to_timestamp(text))


def dollars(named: Column, in_cents: Column) -> Column:
    """The dollar text if it is there (null if it can't be read), else the older field in cents."""
    return F.when(named.isNotNull(), named.try_cast("double")).otherwise(in_cents / 100)


def is_combo(p: Column) -> Column:
    """Baskets of several markets in one."""
    return F.coalesce(p["mve_collection_ticker"] != "", F.lit(False)) | F.coalesce(F.size(p["mve_selected_legs"]) > 0, F.lit(False)) | F.coalesce(p["ticker"].startswith("KXMVE"), F.lit(False))


def combo_rates(raw: DataFrame) -> DataFrame:
    """The share of baskets among the payloads of each source's latest snapshot: source, n_raw, combo_rate. Damaged and missing payloads, and payloads of venues without baskets, are none."""
    named = raw.select(F.lower(stripped(F.col("source"))).alias("source"), "snapshot_ts", is_combo(F.from_json("payload", PAYLOADS["kalshi"])).alias("combo"))
    per = named.groupBy("source", "snapshot_ts").agg(F.count("*").alias("n_raw"), F.count_if("combo").alias("n"))
    return per.groupBy("source").agg(F.max_by(F.struct("n_raw", "n"), "snapshot_ts").alias("x")).select("source", "x.n_raw", (F.col("x.n") / F.col("x.n_raw")).alias("combo_rate"))


def text_list(text: Column) -> Column:
    """A JSON array inside a text; an empty array if it is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def kalshi(raw: DataFrame) -> DataFrame:
    """Quotes at the middle of the book, or at the last trade where there is no book (then stale). Baskets, and markets with neither, give none."""
    p = F.col("p")
    rows = parsed(raw, "kalshi").filter(p.isNotNull() & ~is_combo(p) & (F.coalesce(p["status"], F.lit("active")) == "active"))
    rows = rows.withColumns({"bid": dollars(p["yes_bid_dollars"], p["yes_bid"]), "ask": dollars(p["yes_ask_dollars"], p["yes_ask"]), "last": dollars(p["last_price_dollars"], p["last_price"])})
    traded = F.greatest(*[F.coalesce(p[c].try_cast("double"), F.lit(0.0)) for c in ("liquidity_dollars", "volume_24h_fp", "open_interest_fp")]) >= 1.0
    middle = (F.col("bid") + F.col("ask")) / 2
    live = F.when(F.col("ask") >= F.col("bid"), odds.in_open_unit(middle))
    rows = rows.withColumns({"live": live, "price": F.coalesce(live, F.when(traded, odds.in_open_unit(F.col("last"))))}).filter("price is not null")
    return rows.select("source", "market_id", F.lit("YES").alias("outcome"), F.coalesce(p["title"], F.lit("")).alias("title"), "price", F.col("price").alias("implied_prob"), F.greatest(F.col("ask") - F.col("bid"), F.lit(0.0)).alias("spread"), F.col("live").isNull().alias("price_is_stale"), "snapshot_ts", iso(p["close_time"]).alias("close_ts"))


def manifold(raw: DataFrame) -> DataFrame:
    p = F.col("p")
    rows = parsed(raw, "manifold").filter((p["outcomeType"] == "BINARY") & ~F.coalesce(p["isResolved"], F.lit(False)) & p["probability"].isNotNull())
    return rows.select("source", "market_id", F.lit("YES").alias("outcome"), F.coalesce(p["question"], F.lit("")).alias("title"), p["probability"].alias("price"), odds.in_open_unit(p["probability"]).alias("implied_prob"), F.lit(None).cast("double").alias("spread"), F.lit(False).alias("price_is_stale"), "snapshot_ts", millis(p["closeTime"]).alias("close_ts"))


def polymarket(raw: DataFrame) -> DataFrame:
    """Markets whose first two outcomes are yes and no, at the first one's price."""
    p = F.col("p")
    rows = parsed(raw, "polymarket").filter(p.isNotNull() & ~F.coalesce(p["closed"], F.lit(False)) & F.coalesce(p["active"], F.lit(True)))
    named = let(F.transform(F.slice(text_list(p["outcomes"]), 1, 2), lambda x: F.lower(F.trim(x))), lambda x: F.array_join(x, "/") == "yes/no")
    rows = rows.filter(named).withColumn("price", F.get(text_list(p["outcomePrices"]), F.lit(0)).try_cast("double")).filter("price is not null")
    return rows.select("source", "market_id", F.lit("YES").alias("outcome"), F.coalesce(p["question"], F.lit("")).alias("title"), "price", odds.in_open_unit(F.col("price")).alias("implied_prob"), F.greatest(p["bestAsk"] - p["bestBid"], F.lit(0.0)).alias("spread"), F.lit(False).alias("price_is_stale"), "snapshot_ts", iso(p["endDate"]).alias("close_ts"))


def sportsbook_prices(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Head-to-head prices from nested books: id, the columns of keep, book, name, price."""
    books = events.select("id", *keep, F.explode("bookmakers").alias("b"))
    markets = books.select("id", *keep, F.col("b.key").alias("book"), F.explode("b.markets").alias("m")).filter("m.key = 'h2h'")
    return markets.select("id", *keep, "book", F.inline("m.outcomes"))


def oddsapi(raw: DataFrame) -> DataFrame:
    """A quote for each side of an event: the mean of 1/price over its books, divided by the event's sum of them."""
    events = parsed(raw, "oddsapi").filter("p is not null").select("snapshot_ts", F.col("p.*"))
    keep = ("snapshot_ts", "sport_title", "commence_time", "home_team", "away_team")
    prices = sportsbook_prices(events, keep).filter("price > 1")
    per = prices.groupBy("id", *keep, "name").agg(F.avg(1 / F.col("price")).alias("q"))
    sums = per.groupBy("id", "snapshot_ts").agg(F.sum("q").alias("whole"), F.count("*").alias("n")).filter("n >= 2")
    fair = F.round(F.col("q") / F.col("whole"), 4)
    other = F.when(F.col("name") == F.col("home_team"), F.col("away_team")).otherwise(F.col("home_team"))
    return per.join(sums, ["id", "snapshot_ts"]).select(F.lit("oddsapi").alias("source"), F.concat_ws(":", "id", "name").alias("market_id"), F.col("name").alias("outcome"), F.concat(F.col("name"), F.lit(" to win vs "), other, F.lit(" ("), "sport_title", F.lit(")")).alias("title"), fair.alias("price"), odds.in_open_unit(F.col("q") / F.col("whole")).alias("implied_prob"), F.lit(None).cast("double").alias("spread"), F.lit(False).alias("price_is_stale"), "snapshot_ts", iso(F.col("commence_time")).alias("close_ts"))


NORMALISERS = {"kalshi": kalshi, "manifold": manifold, "polymarket": polymarket, "oddsapi": oddsapi}


def quotes(raw: DataFrame) -> DataFrame:
    """All venues' quotes; records of unknown sources, damaged payloads and markets without a price give none."""
    out = None
    for normaliser in NORMALISERS.values():
        out = normaliser(raw) if out is None else out.unionByName(normaliser(raw))
    return out


def outside_contract(rows: DataFrame) -> DataFrame:
    """Quotes that break the contract: an identity that is missing, or a probability outside (0, 1)."""
    missing = F.col("source").isNull() | F.col("market_id").isNull() | F.col("outcome").isNull() | F.col("snapshot_ts").isNull()
    return rows.filter(missing | (F.col("implied_prob").isNotNull() & odds.in_open_unit(F.col("implied_prob")).isNull()))
