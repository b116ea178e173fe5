"""The queries of the general cleaning problems 1 to 4 and 7, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.columns import stripped
from quotemill.operators import dedup, instants, packed, profile, units
from quotemill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads, sources and columns of market_quotes that are out of line."""
    return profile.out_of_line(table(spark, sf_dir, "market_quotes"), table(spark, sf_dir, "source_health"))


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of market_quotes by load and source, with each load's standardised difference from the source's others."""
    quotes = table(spark, sf_dir, "market_quotes")
    found = profile.profile(quotes, ["load_id", "source"], ranges={"implied_prob": (0.0, 1.0), "fee_adj_prob": (0.0, 1.0)}, patterns={"outcome": "[A-Za-z0-9 .'-]*", "quote_key": "[0-9A-Fa-f]{32}"})
    return profile.standardised_difference(found, "load_id", ["source", "column_name"])


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of p1_profile: rows, nulls, distincts, values out of range, blank or off pattern, by load, source and column."""
    return p1_profile(spark, sf_dir).select("load_id", "source", "column_name", "n_rows", "n_null", "n_distinct", "n_out_of_range", "n_blank", "n_off_pattern")


def p1_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each load's mean price, its deviation, and its standardised difference from the source's other loads."""
    return profile.price_shift(table(spark, sf_dir, "market_quotes"))


def _copies(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, dict, str]]:
    return [
        ("raw_records", table(spark, sf_dir, "raw_records"), {"source": F.lower("source"), "market_id": stripped(F.col("market_id")), "snapshot_ts": F.col("snapshot_ts")}, "rec_id"),
        ("market_quotes", table(spark, sf_dir, "market_quotes"), {"quote_key": F.lower("quote_key")}, "row_id"),
    ]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus copies of messages and quotes."""
    parts = [dedup.surplus_copies(df, identity, key).select(F.lit(name).alias("table_name"), F.col(key).alias("row_key")) for name, df, identity, key in _copies(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of raw_records, one copy each, the first delivered kept."""
    _, df, identity, key = _copies(spark, sf_dir)[0]
    return dedup.keep_one(df, identity, ["delivered_ts", key], key)


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = table(spark, sf_dir, "venue_defaults").groupBy("source").agg(F.min("zone_name").alias("venue_zone"), F.min("date_order").alias("date_order"))  # a row a venue
    stations = table(spark, sf_dir, "forecast_stations").groupBy("station").agg(F.min("zone_name").alias("station_zone"))
    out = None
    for name, field, venue in (("kalshi_markets", "close_time", "kalshi"), ("manifold_markets", "closetime", "manifold"), ("odds_events", "commence_time", "oddsapi"), ("forecast_periods", "starttime", "forecast")):
        station = F.col("station") if venue == "forecast" else F.lit(None).cast("string").alias("station")
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), "rec_id", F.lit(field).alias("field_name"), F.col(field).alias("text"), F.lit(venue).alias("source"), station)
        out = rows if out is None else out.unionByName(rows)
    out = out.join(F.broadcast(defaults), "source", "left").join(F.broadcast(stations), "station", "left")  # both fixed lists
    return instants.normalise(out.drop("station"), F.col("text"), F.col("source"), F.coalesce("station_zone", "venue_zone"), F.coalesce("date_order", F.lit("mdy")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each time text that names an instant, as microseconds since 1970 UTC."""
    return _times(spark, sf_dir).filter("time_status = 'resolved'").select("table_name", "rec_id", "field_name", "utc_micros")


def p3_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each source were read in which format, how sure that is, and how many stay open."""
    return _times(spark, sf_dir).groupBy("source", "time_format", "time_status").agg(F.count("*").alias("n"), F.min("posterior").alias("least_posterior"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each field there are, and how many of them name an instant."""
    return _times(spark, sf_dir).groupBy("table_name", "field_name").agg(F.count("*").alias("n"), F.count_if(F.col("time_status") == "resolved").alias("n_resolved"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    markets, exchange = table(spark, sf_dir, "polymarket_markets"), table(spark, sf_dir, "kalshi_markets").filter("market_type = 'multi'")
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("outcomes", "outcomeprices")])
    rows = markets.select(F.lit("polymarket_markets").alias("table_name"), "rec_id", F.inline(fields))
    rows = rows.unionByName(exchange.select(F.lit("kalshi_markets").alias("table_name"), "rec_id", F.lit("title").alias("field_name"), F.col("title").alias("text")))
    return packed.unpack(rows, F.col("text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of a packed field in a row of its own, with its place."""
    return _packed(spark, sf_dir).select("table_name", "rec_id", "field_name", "pos", "item")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value that isn't recorded as a bare fraction of one, as millionths of a probability."""
    exchange = table(spark, sf_dir, "kalshi_markets").select(F.lit("kalshi_markets").alias("table_name"), "rec_id", F.lit("yes_bid_dollars").alias("field_name"), F.lit(1).alias("pos"), units.quantity(F.col("yes_bid_dollars")).alias("q"))
    listed = packed.unpack(table(spark, sf_dir, "polymarket_markets").select("rec_id", "outcomeprices"), F.col("outcomeprices"))
    listed = listed.select(F.lit("polymarket_markets").alias("table_name"), "rec_id", F.lit("outcomeprices").alias("field_name"), "pos", units.quantity(F.col("item")).alias("q"))
    texts = exchange.unionByName(listed).filter("q is not null").select("table_name", "rec_id", "field_name", "pos", F.col("q.value").alias("value"), F.col("q.unit").alias("spelling"))
    # A text with a sign or word, and a bare number above 1, which is cents.
    texts = units.with_unit(texts.filter("spelling != '' or value > 1"), "spelling", F.lit("cent")).drop("spelling")

    quotes = table(spark, sf_dir, "market_quotes")
    defaults = F.broadcast(table(spark, sf_dir, "venue_defaults").select("source", F.col("price_unit").alias("default_unit")))  # a row a venue
    prices = quotes.join(defaults, "source", "left").select(F.lit("market_quotes").alias("table_name"), F.col("row_id").alias("rec_id"), F.lit("price").alias("field_name"), F.lit(1).alias("pos"), F.col("price").alias("value"), F.coalesce(F.when(units.clean(F.col("price_unit")) != "", F.col("price_unit")), "default_unit").alias("spelling"))
    prices = units.with_unit(prices.filter("value is not null and not isnan(value)"), "spelling", F.lit(None).cast("string")).drop("spelling").filter("unit not in ('fraction', 'dollar')")
    scale = units.quoted_scale(F.col("implied_prob"))
    implied = quotes.select(F.lit("market_quotes").alias("table_name"), F.col("row_id").alias("rec_id"), F.lit("implied_prob").alias("field_name"), F.lit(1).alias("pos"), F.col("implied_prob").alias("value"), scale.alias("unit")).filter("unit in ('percent', 'basis_point')")

    every = texts.unionByName(prices).unionByName(implied)
    chance = units.to_probability(F.col("value"), F.col("unit"))
    return every.select("table_name", "rec_id", "field_name", "pos", units.millionths(chance).alias("prob_millionths")).filter("prob_millionths is not null")


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes, markets, listed = table(spark, sf_dir, "market_quotes"), table(spark, sf_dir, "kalshi_markets"), table(spark, sf_dir, "polymarket_markets")
    item = packed.unpack(listed.select("outcomeprices"), F.col("outcomeprices"))
    return quotes.select(units.clean(F.col("price_unit")).alias("spelling")).unionByName(markets.select(units.quantity(F.col("yes_bid_dollars"))["unit"].alias("spelling"))).unionByName(item.select(units.quantity(F.col("item"))["unit"].alias("spelling")))


def p7_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit that each distinct spelling in price_unit and in the texts of bids and outcome prices was taken for."""
    return units.aliases(_spellings(spark, sf_dir)).select("spelling", "unit")


def p7_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of those spellings beside all names that the index proposes for it, with the trigrams and first letters they share and their weighted distance."""
    return units.proposals(_spellings(spark, sf_dir)).select("spelling", "known", "unit", "shared", F.round("distance", 4).alias("distance"))


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p1_counts, p1_shift, p2_found, p2_kept, p3_found, p3_formats, p3_counts, p4_found, p7_found, p7_aliases, p7_distances)}

# The twin knows spellings only, by a list of its own.
_SPELT = """
            ('fraction', 'fraction'), ('fractions', 'fraction'), ('probability', 'fraction'), ('prob', 'fraction'), ('share price', 'fraction'), ('share price 0-1', 'fraction'), ('0-1', 'fraction'), ('between 0 and 1', 'fraction'), ('ratio', 'fraction'),
            ('$', 'dollar'), ('usd', 'dollar'), ('dollar', 'dollar'), ('dollars', 'dollar'), ('usd per share', 'dollar'), ('dollars per share', 'dollar'), ('us dollars', 'dollar'), ('usd_dollar', 'dollar'), ('per share', 'dollar'),
            ('¢', 'cent'), ('c', 'cent'), ('ct', 'cent'), ('cts', 'cent'), ('cent', 'cent'), ('cents', 'cent'), ('us cents', 'cent'), ('usd_cent', 'cent'), ('usd cents', 'cent'), ('c/share', 'cent'), ('cents per share', 'cent'), ('quoted in cents', 'cent'), ('1/100 of a dollar', 'cent'),
            ('%', 'percent'), ('pct', 'percent'), ('percent', 'percent'), ('per cent', 'percent'), ('percents', 'percent'), ('percentage', 'percent'), ('percentage points', 'percent'), ('in percent', 'percent'),
            ('bp', 'basis_point'), ('bps', 'basis_point'), ('basis point', 'basis_point'), ('basis points', 'basis_point'), ('1/100 of a percent', 'basis_point'),
            ('dec', 'decimal_odds'), ('decimal', 'decimal_odds'), ('decimal odds', 'decimal_odds'), ('odds (decimal)', 'decimal_odds'), ('european odds', 'decimal_odds'), ('eu odds', 'decimal_odds'), ('payout per 1 staked', 'decimal_odds'), ('payout per unit', 'decimal_odds'),
            ('american', 'american_odds'), ('american odds', 'american_odds'), ('us odds', 'american_odds'), ('moneyline', 'american_odds'), ('money line', 'american_odds'), ('odds (american)', 'american_odds')"""

_ABBREVIATED = ", ".join(f"('{name.upper()}', {minutes})" for name, minutes in instants.ABBREVIATIONS.items())
_READ = r"""
        t AS (
            SELECT 'kalshi_markets' AS table_name, rec_id, 'close_time' AS field_name, close_time AS x, 'kalshi' AS source, NULL AS station FROM kalshi_markets UNION ALL SELECT 'manifold_markets', rec_id, 'closetime', closetime, 'manifold', NULL FROM manifold_markets
            UNION ALL SELECT 'odds_events', rec_id, 'commence_time', commence_time, 'oddsapi', NULL FROM odds_events UNION ALL SELECT 'forecast_periods', rec_id, 'starttime', starttime, NULL, station FROM forecast_periods),
        s AS (SELECT table_name, rec_id, field_name, trim(x, ' ' || chr(9) || chr(10) || chr(13)) AS x, coalesce(f.zone_name, v.zone_name) AS zone, coalesce(v.date_order, 'mdy') AS o
              FROM t LEFT JOIN venue_defaults v ON v.source = t.source LEFT JOIN forecast_stations f ON f.station = t.station),
        g AS (
            SELECT *, CASE
                WHEN regexp_full_match(x, '\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}.*') THEN regexp_extract(x, '^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?()\s*(Z|z|UTC|[+-]\d{2}:?\d{2}|[A-Za-z]+/[A-Za-z_]+)?(?:\[[A-Za-z_/]+\])?$', ['y', 'm', 'd', 'h', 'i', 's', 'f', 'a', 'z'])
                WHEN regexp_full_match(x, '\d{8}T\d{6}Z') THEN regexp_extract(x, '^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})()()(Z)$', ['y', 'm', 'd', 'h', 'i', 's', 'f', 'a', 'z'])
                WHEN regexp_full_match(x, '\d{2}[./]\d{2}[./]\d{4} .*') AND o = 'dmy' THEN regexp_extract(x, '^(\d{2})[./](\d{2})[./](\d{4}) (\d{1,2}):(\d{2})()()(?: ([AP])M)?()$', ['d', 'm', 'y', 'h', 'i', 's', 'f', 'a', 'z'])
                WHEN regexp_full_match(x, '\d{2}[./]\d{2}[./]\d{4} .*') THEN regexp_extract(x, '^(\d{2})[./](\d{2})[./](\d{4}) (\d{1,2}):(\d{2})()()(?: ([AP])M)?()$', ['m', 'd', 'y', 'h', 'i', 's', 'f', 'a', 'z'])
                WHEN regexp_full_match(x, '(?:[A-Z][a-z]{2}, )?\d{1,2} [A-Z][a-z]+ \d{4}.*') THEN regexp_extract(x, '^(?:[A-Z][a-z]{2}, )?(\d{1,2}) ([A-Z][a-z]+) (\d{4}),? (\d{1,2}):(\d{2})(?::(\d{2}))?()()(?: (GMT|[+-]\d{4}))?$', ['d', 'm', 'y', 'h', 'i', 's', 'f', 'a', 'z'])
                WHEN regexp_full_match(x, '[A-Z][a-z]+ \d{1,2}, \d{4} .*') THEN regexp_extract(x, '^([A-Z][a-z]+) (\d{1,2}), (\d{4}) (\d{1,2}):(\d{2})()() ([AP])M ([A-Z]+)$', ['m', 'd', 'y', 'h', 'i', 's', 'f', 'a', 'z']) END AS g,
                CASE WHEN regexp_full_match(x, '\d{10}(\.\d+)?') THEN CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT) WHEN regexp_full_match(x, '\d{13}') THEN CAST(x AS BIGINT) * 1000 WHEN regexp_full_match(x, '\d{16}') THEN CAST(x AS BIGINT) WHEN regexp_full_match(x, '\d{19}') THEN CAST(x AS BIGINT) // 1000 END AS e
            FROM s),
        n AS (
            SELECT *, coalesce(try_cast(g['m'] AS INTEGER), (instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr(g['m'], 1, 3))) + 2) // 3) AS m, try_cast(g['h'] AS INTEGER) AS h, upper(g['z']) AS z FROM g),
        w AS (
            SELECT *, try_cast(g['y'] || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(g['d'], 2, '0') || ' ' || lpad(CAST(CASE WHEN g['a'] = '' THEN h WHEN g['a'] = 'P' THEN h % 12 + 12 ELSE h % 12 END AS VARCHAR), 2, '0') || ':' || g['i'] || ':' || CASE WHEN g['s'] = '' THEN '00' ELSE g['s'] END AS TIMESTAMP) AS wall,
                   CASE WHEN g['f'] = '' THEN 0 ELSE CAST(rpad(substr(g['f'], 1, 6), 6, '0') AS BIGINT) END AS f FROM n),
        l AS (
            SELECT w.*, CASE WHEN regexp_matches(z, '^[+-]') THEN CAST(substr(z, 1, 1) || '1' AS INTEGER) * (CAST(substr(z, 2, 2) AS INTEGER) * 60 + CAST(right(z, 2) AS INTEGER)) ELSE b.minutes END AS shift, CASE WHEN contains(z, '/') THEN g['z'] ELSE zone END AS place FROM w LEFT JOIN b ON b.name = w.z),
        u AS (SELECT *, timezone(place, wall) AS later FROM l)"""

_TEXTS = ("quote_key", "market_id", "outcome", "title", "price_unit")
_OTHERS = ("row_id", "price", "implied_prob", "fee_adj_prob", "spread", "trade_cost", "price_is_stale", "snapshot_ts", "close_ts", "arrived_ts")


def _column_counts(c: str) -> str:
    beyond = f"count(*) FILTER (WHERE {c} < 0 OR {c} > 1)" if c in ("implied_prob", "fee_adj_prob") else "NULL"
    blank = f"count(*) FILTER (WHERE trim({c}) = '')" if c in _TEXTS else "NULL"
    off = {"outcome": "[A-Za-z0-9 .''-]*", "quote_key": "[0-9A-Fa-f]{32}"}.get(c)
    off = f"count(*) FILTER (WHERE trim({c}) = '' OR NOT regexp_full_match({c}, '{off}'))" if off else "NULL"
    return f"SELECT load_id, source, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, CAST({beyond} AS BIGINT) AS n_out_of_range, CAST({blank} AS BIGINT) AS n_blank, CAST({off} AS BIGINT) AS n_off_pattern FROM market_quotes GROUP BY load_id, source"


# Another way to the same values: JSON arrays by the JSON reader, other lists by one pattern for an item and the delimiter behind it.
_SPLIT = "CASE d " + " ".join(
    rf"""WHEN {name} THEN regexp_extract_all(body || {name}, '\s*("(?:[^"]|"")*"|{single}[^{inner}]*)\s*{pattern}', 1)"""
    for name, pattern, inner, single in (("'||'", "[|][|]", "|", ""), ("'|'", "[|]", "|", ""), ("';'", ";", ";", ""), ("chr(9)", r"\t", r"\t", ""), ("chr(10)", r"\n", r"\n", ""), ("','", ",", ",", r"''(?:[^''\\]|\\.)*''|"))
) + " END"
_PACKED = rf"""
        x AS (SELECT 'polymarket_markets' AS table_name, rec_id, 'outcomes' AS field_name, outcomes AS t FROM polymarket_markets UNION ALL SELECT 'polymarket_markets', rec_id, 'outcomeprices', outcomeprices FROM polymarket_markets UNION ALL SELECT 'kalshi_markets', rec_id, 'title', title FROM kalshi_markets WHERE market_type = 'multi'),
        y AS (SELECT * EXCLUDE (t, u), CASE WHEN starts_with(u, '"[') AND json_valid(u) THEN json_extract_string(u, '$') ELSE u END AS t FROM (SELECT *, trim(replace(t, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS u FROM x) WHERE u <> ''),
        z AS (SELECT *, starts_with(t, '[') AND ends_with(t, ']') AS listed, CASE WHEN listed AND json_valid(t) THEN CAST(CAST(t AS JSON) AS VARCHAR[]) END AS l, CASE WHEN listed THEN trim(substr(t, 2, length(t) - 2)) ELSE t END AS body, regexp_replace(body, '"[^"]*"', '', 'g') AS bare,
                     CASE WHEN listed THEN ',' WHEN contains(bare, '||') THEN '||' WHEN contains(bare, '|') THEN '|' WHEN contains(bare, ';') THEN ';' WHEN contains(bare, chr(9)) THEN chr(9) WHEN contains(bare, chr(10)) THEN chr(10) ELSE ',' END AS d FROM y),
        c AS (SELECT *, CASE WHEN l IS NOT NULL THEN l WHEN body = '' THEN [] ELSE list_transform({_SPLIT}, lambda i: CASE WHEN regexp_full_match(trim(i), '"(?s:.*)"') THEN replace(substr(trim(i), 2, length(trim(i)) - 2), '""', '"') WHEN listed AND regexp_full_match(trim(i), '''(?s:.*)''') THEN replace(substr(trim(i), 2, length(trim(i)) - 2), '\''', '''') ELSE i END) END AS parts FROM z),
        k AS (SELECT table_name, rec_id, field_name, CASE WHEN l IS NULL AND trim(parts[len(parts)]) = '' THEN parts[:len(parts) - 1] ELSE parts END AS parts FROM c)"""

ORACLE = {
    "p4_found": f"WITH {_PACKED} SELECT table_name, rec_id, field_name, CAST(pos AS INTEGER) AS pos, trim(parts[pos], ' ' || chr(9) || chr(10)) AS item FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS pos FROM k)",
    "p1_counts": " UNION ALL ".join(_column_counts(c) for c in (*_TEXTS, *_OTHERS)),
    # Sums by load as decimals, those of the other loads as differences.
    "p1_shift": """
        WITH b AS (SELECT load_id, source, count(price) AS n, CAST(sum(CAST(price AS DECIMAL(18, 4))) AS DECIMAL(38, 8)) AS s, sum(CAST(CAST(price AS DECIMAL(18, 4)) * CAST(price AS DECIMAL(18, 4)) AS DECIMAL(38, 8))) AS q FROM market_quotes GROUP BY load_id, source),
        o AS (SELECT *, sum(n) OVER w - n AS on_, CAST(sum(s) OVER w - s AS DOUBLE) AS os, CAST(sum(q) OVER w - q AS DOUBLE) AS oq FROM b WINDOW w AS (PARTITION BY source))
        SELECT load_id, source, n AS n_values, round(CAST(s AS DOUBLE) / nullif(n, 0), 6) AS mean, round(sqrt(greatest(CAST(q AS DOUBLE) / nullif(n, 0) - pow(CAST(s AS DOUBLE) / nullif(n, 0), 2), 0)), 6) AS stddev,
               round((CAST(s AS DOUBLE) / nullif(n, 0) - os / nullif(on_, 0)) / nullif(sqrt(greatest(oq / nullif(on_, 0) - pow(os / nullif(on_, 0), 2), 0)), 0), 6) AS std_diff FROM o""",
    # Units by the list of spellings; how far each is from a name no SQL tells (tests compare with all names).
    "p7_aliases": rf"""
        WITH u(spelling, unit) AS (VALUES {_SPELT}),
        item AS (SELECT yes_bid_dollars AS t FROM kalshi_markets UNION ALL SELECT unnest(regexp_extract_all(outcomeprices, '[^\],;|\t\r\n\["''\\]+')) FROM polymarket_markets),
        found AS (SELECT lower(trim(price_unit)) AS spelling FROM market_quotes UNION SELECT lower(trim(regexp_replace(t, '[0-9]*[.]?[0-9]+', ''))) FROM item)
        SELECT spelling, unit FROM found JOIN u USING (spelling)""",
    # Where an hour repeats, timezone() gives its second pass; the first one is an hour earlier if that shows the same clock face.
    "p3_found": f"""
        WITH b(name, minutes) AS (VALUES {_ABBREVIATED}), {_READ}
        SELECT * FROM (SELECT table_name, rec_id, field_name, coalesce(e, CASE WHEN shift IS NOT NULL THEN epoch_us(wall) - CAST(shift AS BIGINT) * 60000000 WHEN timezone(place, later - INTERVAL 1 HOUR) = wall THEN epoch_us(later) - 3600000000 ELSE epoch_us(later) END + f) AS utc_micros FROM u) WHERE utc_micros IS NOT NULL""",
    # Exact spellings only; the fuzzy ones are tested apart.
    "p7_found": rf"""
        WITH u(spelling, unit) AS (VALUES {_SPELT}),
        item AS (SELECT 'kalshi_markets' AS table_name, rec_id, 'yes_bid_dollars' AS field_name, 1 AS pos, yes_bid_dollars AS t FROM kalshi_markets
                 UNION ALL SELECT 'polymarket_markets', rec_id, 'outcomeprices', CAST(i AS INTEGER), l[i] FROM (SELECT rec_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT rec_id, list_filter(regexp_extract_all(outcomeprices, '[^\],;|\t\r\n\["''\\]+'), lambda x: trim(x) <> '') AS l FROM polymarket_markets))),
        text AS (SELECT table_name, rec_id, field_name, pos, try_cast(regexp_extract(t, '[0-9]*[.]?[0-9]+') AS DOUBLE) AS v, lower(trim(regexp_replace(t, '[0-9]*[.]?[0-9]+', ''))) AS s FROM item),
        every AS (
            SELECT table_name, rec_id, field_name, pos, v, CASE WHEN s = '' THEN 'cent' ELSE u.unit END AS unit FROM text LEFT JOIN u ON u.spelling = s WHERE s <> '' OR v > 1
            UNION ALL SELECT 'market_quotes', row_id, 'price', 1, price, u.unit FROM market_quotes q JOIN venue_defaults d ON d.source = q.source JOIN u ON u.spelling = lower(trim(coalesce(q.price_unit, d.price_unit))) WHERE u.unit NOT IN ('fraction', 'dollar') AND price IS NOT NULL
            UNION ALL SELECT 'market_quotes', row_id, 'implied_prob', 1, implied_prob, CASE WHEN implied_prob BETWEEN 2 AND 98 THEN 'percent' ELSE 'basis_point' END FROM market_quotes WHERE implied_prob BETWEEN 2 AND 98 OR implied_prob BETWEEN 200 AND 9800),
        p AS (SELECT *, CASE WHEN unit IN ('fraction', 'dollar') THEN v WHEN unit IN ('cent', 'percent') THEN v / 100 WHEN unit = 'basis_point' THEN v / 10000 WHEN unit = 'decimal_odds' AND v >= 1 THEN 1 / v WHEN unit = 'american_odds' AND v > 0 THEN 100 / (v + 100) WHEN unit = 'american_odds' AND v < 0 THEN v / (v - 100) END AS p FROM every)
        SELECT table_name, rec_id, field_name, pos, CAST(round_even(p * 1000000, 0) AS BIGINT) AS prob_millionths FROM p WHERE p BETWEEN 0 AND 1""",
    "p1_found": """
        WITH b AS (SELECT load_id, source, count(*) AS n, count(price) AS np, count(implied_prob) AS ni, count(close_ts) AS nc, count(outcome) AS no, count(*) FILTER (WHERE implied_prob < 0 OR implied_prob > 1) AS bad,
                          count(*) FILTER (WHERE trim(outcome) = '' OR regexp_matches(outcome, '[^A-Za-z0-9 .''-]')) AS off, count(DISTINCT lower(quote_key)) AS nk, median(price) AS m FROM market_quotes GROUP BY load_id, source),
        v AS (SELECT load_id, source, price, count(*) AS c FROM market_quotes WHERE price IS NOT NULL GROUP BY load_id, source, price),
        t AS (SELECT load_id, source, sum(c) AS c FROM (SELECT *, row_number() OVER (PARTITION BY load_id, source ORDER BY c DESC, price) AS rn FROM v) WHERE rn <= 3 GROUP BY load_id, source),
        s AS (SELECT b.load_id, b.source, 1 - np / n AS p, 1 - ni / n AS i, 1 - nc / n AS c, 1 - nk / n AS d, bad / ni AS r, off / no AS o, t.c / np AS top, m, bad, h.null_rate AS hn, h.duplicate_rate AS hd, h.prob_violations AS hv
              FROM b LEFT JOIN t ON t.load_id = b.load_id AND t.source = b.source LEFT JOIN source_health h ON h.load_id = b.load_id AND h.source = b.source),
        u AS (SELECT source, median(p) AS p, median(i) AS i, median(c) AS c, median(d) AS d, median(r) AS r, median(o) AS o, median(m) AS m FROM s GROUP BY source)
        SELECT s.load_id, s.source, x.column_name, x.issue FROM s JOIN u ON u.source = s.source, LATERAL (
            SELECT 'price' AS column_name, 'null_rate' AS issue, s.p - u.p >= 0.15 - 1e-9 AS hit UNION ALL SELECT 'implied_prob', 'null_rate', s.i - u.i >= 0.15 - 1e-9 UNION ALL SELECT 'close_ts', 'null_rate', s.c - u.c >= 0.15 - 1e-9
            UNION ALL SELECT 'quote_key', 'duplicates', s.d - u.d >= 0.1 - 1e-9 UNION ALL SELECT 'implied_prob', 'range', s.r - u.r >= 0.15 - 1e-9 UNION ALL SELECT 'outcome', 'pattern', s.o - u.o >= 0.15 - 1e-9
            UNION ALL SELECT 'price', 'constant', s.top >= 0.8 - 1e-9 UNION ALL SELECT 'price', 'shift', s.m / u.m < 1.0 / 3 OR s.m / u.m > 3
            UNION ALL SELECT 'null_rate', 'report', abs(s.hn - s.i) > 0.0001 + 1e-9 UNION ALL SELECT 'duplicate_rate', 'report', abs(s.hd - s.d) > 0.0001 + 1e-9 UNION ALL SELECT 'prob_violations', 'report', s.hv <> s.bad) x WHERE x.hit""",
    "p2_found": """
        SELECT 'raw_records' AS table_name, rec_id AS row_key FROM (SELECT rec_id, row_number() OVER (PARTITION BY lower(source), trim(market_id, ' ' || chr(9) || chr(10) || chr(13)), snapshot_ts ORDER BY rec_id) AS rn FROM raw_records) WHERE rn > 1
        UNION ALL SELECT 'market_quotes', row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY lower(quote_key) ORDER BY row_id) AS rn FROM market_quotes) WHERE rn > 1""",
    "p2_kept": """
        SELECT rec_id, batch_id, source, market_id, snapshot_ts, payload, delivered_ts FROM (SELECT *, row_number() OVER (PARTITION BY lower(source), trim(market_id, ' ' || chr(9) || chr(10) || chr(13)), snapshot_ts ORDER BY delivered_ts, rec_id) AS rn FROM raw_records) WHERE rn = 1""",
}
_FIELDS = {"kalshi_markets": "close_time", "manifold_markets": "closetime", "odds_events": "commence_time", "forecast_periods": "starttime"}
ORACLE["p3_counts"] = f"SELECT t.table_name, field_name, t.n, coalesce(f.n, 0) AS n_resolved FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{t}{chr(39)} AS table_name, {chr(39)}{c}{chr(39)} AS field_name, count(*) AS n FROM {t}' for t, c in _FIELDS.items())}) t LEFT JOIN (SELECT table_name, count(*) AS n FROM ({ORACLE['p3_found']}) GROUP BY table_name) f USING (table_name)"
