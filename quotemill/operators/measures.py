"""Reports: calibration, forecast errors, feed quality, diagnostics of matching, and data tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions import stats


def calibration(df: DataFrame, predicted: str, outcome: str, parts: int = 10) -> DataFrame:
    """By nearest step of the prediction: prob_bucket, n, predicted_mean, realized_rate (4 places). Rows with a null on either side don't count."""
    rows = df.filter(F.col(predicted).isNotNull() & F.col(outcome).isNotNull())
    return rows.groupBy(stats.bucket(F.col(predicted), parts).alias("prob_bucket")).agg(F.count("*").alias("n"), F.round(F.avg(predicted), 4).alias("predicted_mean"), F.round(F.avg(F.col(outcome).cast("double")), 4).alias("realized_rate"))


def accuracy(df: DataFrame, predicted: str, outcome: str, by: Sequence[str] = (), cheap: float = 0.25, least: int = 10) -> DataFrame:
    """By group (or for all): n, accuracy, brier, longshot_overpricing (mean of prediction less outcome among predictions below cheap; null with fewer than `least` of them)."""
    p, y = F.col(predicted), F.col(outcome).cast("double")
    rows = df.filter(p.isNotNull() & y.isNotNull())
    low = p < cheap
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(((p >= 0.5) == (y == 1)).cast("double")), 4).alias("accuracy"), F.round(F.avg((p - y) * (p - y)), 4).alias("brier"),
        F.when(F.count_if(low) >= least, F.round(F.avg(F.when(low, p - y)), 4)).alias("longshot_overpricing"),
    )


def best_sigma(df: DataFrame, margin: str, outcome: str, start: float = 4.0, least: int = 15) -> DataFrame:
    """The spread of forecast errors under which outcomes are likeliest: one row, n and sigma (3 places).

    margin is forecast less threshold, outcome 1 if the value came out above. A grid from 0.5 to 19.75
    by 0.25, then 0.25 either side of its best by 0.02; the first of equal minima wins. Both grids are
    fixed lists of under a hundred values, laid beside each row as an array and summed map-side. With
    fewer than `least` rows the start value stays.
    """
    rows = df.select(F.col(margin).cast("double").alias("m"), F.col(outcome).cast("int").alias("y")).filter("m is not null and y is not null")
    # Equal observations are counted before they meet the grid.
    rows = rows.groupBy("m", "y").agg(F.count("*").alias("c"))

    def losses(grid: Column) -> DataFrame:
        spread = rows.select("m", "y", "c", F.explode(grid).alias("sigma"))
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), stats.normal_cdf(F.col("m") / F.col("sigma"))))
        loss = -F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p))
        return spread.groupBy("sigma").agg(F.round(F.sum(loss * F.col("c")), 6).alias("loss"), F.sum("c").alias("n"))

    coarse = losses(F.array(*[F.lit(0.5 + 0.25 * i) for i in range(78)])).agg(F.min(F.struct("loss", "sigma")).alias("b"), F.max("n").alias("n"))
    middle = coarse.first()
    if middle["b"] is None or middle["n"] < least:
        return coarse.select(F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.lit(float(start)).alias("sigma"))
    around = [x for i in range(26) if (x := middle["b"]["sigma"] - 0.25 + 0.02 * i) > 0]
    fine = losses(F.array(*[F.lit(x) for x in around]))
    return fine.agg(F.max("n").alias("n"), F.round(F.min(F.struct("loss", "sigma"))["sigma"], 3).alias("sigma"))


# What a health row says of each issue, as text that readers of the report compare.
ISSUES = {
    "age": "stale: last snapshot %.0f min ago",
    "repeats": "%.1f%% duplicate rows (idempotency broken)",
    "nulls": "%.0f%% of {field} is null",
    "bounds": "%d probability values outside [0,1]",
    "partial": "latest snapshot is unusually small (possible partial ingest)",
    "stale": "%.0f%% of prices are stale-fallback, not live quotes",
    "combo": "%.0f%% of raw payloads were excluded combo/parlay markets",
    "only combo": "%.0f%% of raw payloads were excluded combo/parlay markets, leaving 0 usable quotes",
    "none": "no data for this source",
}


def feed_quality(
    quotes: DataFrame, now: Column, keys: Sequence[str], source: str = "source", snapshot: str = "snapshot_ts", field: str = "implied_prob", stale: str = "price_is_stale", market: str = "market_id", combos: DataFrame | None = None, brier: DataFrame | None = None
) -> DataFrame:
    """One health row a source: n_quotes, n_markets, last_snapshot, age_minutes, null_rate, duplicate_rate, prob_violations, partial_ingest, stale_price_rate, combo_excluded_rate, reliability_score, reliability_grade, issues.

    Nulls, bounds, stale prices and counts are of the latest snapshot, duplicates (repeats of keys) and
    the median volume of a snapshot of all rows. combos (source, combo_rate) tells how many of a source's
    latest raw payloads were baskets, brier (source, brier) how well its markets are calibrated; without
    them the rate is 0 and the score half freshness, half completeness. A source that only combos knows
    has no quotes, null rate 1, score 0. Each figure is a mergeable aggregate by source, or by source and
    snapshot before that; sources meet only as single rows.
    """
    v = F.when(~F.isnan(field), F.col(field))
    top = quotes.groupBy(source).agg(F.max(snapshot).alias("last_snapshot"))
    volumes = quotes.groupBy(source, snapshot).agg(F.count("*").alias("n"), F.count(v).alias("there"), F.count_if((v < 0) | (v > 1)).alias("violations"), F.count_if(F.coalesce(stale, F.lit(False))).alias("stale"))
    per = volumes.groupBy(source).agg(F.median("n").alias("usual"), F.sum("n").alias("all_rows"))
    at = volumes.join(top.withColumnRenamed("last_snapshot", snapshot), [source, snapshot])
    markets = quotes.select(source, snapshot, market).join(top.withColumnRenamed("last_snapshot", snapshot), [source, snapshot], "left_semi").distinct().groupBy(source).agg(F.count(market).alias("n_markets"))
    different = quotes.groupBy(*dict.fromkeys([source, *keys])).agg(F.lit(1).alias("one")).groupBy(source).agg(F.count("*").alias("different"))
    rows = at.join(per, source).join(markets, source).join(different, source)
    rows = rows.withColumn("combo_rate", F.lit(0.0)) if combos is None else rows.join(combos.select(source, "combo_rate"), source, "full")
    rows = rows.withColumn("brier", F.lit(None).cast("double")) if brier is None else rows.join(brier.select(source, "brier"), source, "left")
    empty = F.col("n").isNull()
    age = F.greatest((F.unix_micros(now) - F.unix_micros(snapshot)) / 6e7, F.lit(0.0))
    nulls, repeats, stales = F.when(empty, 1.0).otherwise(1 - F.col("there") / F.col("n")), 1 - F.col("different") / F.col("all_rows"), F.col("stale") / F.col("n")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = rows.withColumns({"age_minutes": age, "_nr": nulls, "_dup": zero(repeats), "_stale": zero(stales), "_combo": zero(F.col("combo_rate")), "partial_ingest": F.coalesce(F.col("n") < 0.5 * F.col("usual"), F.lit(False))})
    score = stats.reliability(stats.freshness(F.col("age_minutes")), stats.clamp(1 - F.col("_nr"), 0.0, 1.0), stats.calibration_score(F.col("brier")))
    rows = rows.withColumn("reliability_score", F.when(empty, 0.0).otherwise(score))
    said = lambda k, x: F.format_string(ISSUES[k].format(field=field), x)
    issues = F.array_compact(F.array(
        F.when(F.col("age_minutes") > 60, said("age", F.col("age_minutes"))),
        F.when(F.col("_dup") > 0, said("repeats", F.col("_dup") * 100)),
        F.when(F.col("_nr") > 0.1, said("nulls", F.col("_nr") * 100)),
        F.when(F.col("violations") > 0, said("bounds", F.col("violations"))),
        F.when(F.col("partial_ingest"), F.lit(ISSUES["partial"])),
        F.when(F.col("_stale") > 0.05, said("stale", F.col("_stale") * 100)),
        F.when(F.col("_combo") > 0, said("combo", F.col("_combo") * 100)),
    ))
    told = F.when(empty & (F.col("_combo") > 0), said("only combo", F.col("_combo") * 100)).when(empty, ISSUES["none"]).when(F.size(issues) == 0, "healthy").otherwise(F.array_join(issues, "; "))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.select(
        source, whole("n").alias("n_quotes"), whole("n_markets").alias("n_markets"), F.col(snapshot).alias("last_snapshot"), "age_minutes", F.round("_nr", 4).alias("null_rate"), F.round("_dup", 4).alias("duplicate_rate"), whole("violations").alias("prob_violations"),
        "partial_ingest", F.round("_stale", 4).alias("stale_price_rate"), F.round("_combo", 4).alias("combo_excluded_rate"), "reliability_score", stats.grade(F.col("reliability_score")).alias("reliability_grade"), told.alias("issues"),
    )


def score_summary(log: DataFrame, scored: DataFrame, hit: str = "hit") -> DataFrame:
    """One row: n_logged, n_resolved (rows that have an outcome), hit_rate (4 places; null with none)."""
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731 - single rows side by side
    told = scored.agg(F.count("*").alias("n_resolved"), F.round(F.avg(F.col(hit).cast("double")), 4).alias("hit_rate"))
    return one(log.agg(F.count("*").alias("n_logged"))).join(one(told), "one").drop("one")


def match_diagnostics(pairs: DataFrame) -> DataFrame:
    """One row on scored pairs: n_pairs_scored, n_pairs_matched, n_near_miss, near_miss_mean, near_miss_max (4 places)."""
    miss = F.col("decision") == "no-match"
    return pairs.agg(F.count("*").alias("n_pairs_scored"), F.count_if(F.col("decision").isin("match", "manual-match")).alias("n_pairs_matched"), F.count_if(miss).alias("n_near_miss"), F.round(F.avg(F.when(miss, F.col("confidence"))), 4).alias("near_miss_mean"), F.round(F.max(F.when(miss, F.col("confidence"))), 4).alias("near_miss_max"))


def coverage_gaps(blocks: DataFrame, group: str = "category", source: str = "source") -> DataFrame:
    """Sources that share no category with another one: source, categories."""
    per = blocks.select(group, source).distinct()
    shared = per.groupBy(group).agg(F.count("*").alias("n")).filter("n > 1").select(group)
    touched = per.join(shared, group, "left_semi").select(source).distinct()
    return per.join(touched, source, "left_anti").groupBy(source).agg(F.array_sort(F.collect_set(group)).alias("categories"))


def reasons(blocks: DataFrame, summary: DataFrame, cross: DataFrame, group: str = "category", source: str = "source") -> DataFrame:
    """Why matching came out as it did, in words: one row, reasons (array).

    blocks has a row for each category and source with markets, summary is match_diagnostics, cross one
    row with n_cross (events of several sources). One reason if there are no markets or any cross
    event; else the sources that share no category, and what became of the pairs.
    """
    per = blocks.groupBy(group).agg(F.count_distinct(source).alias("n"))
    have = per.agg(F.count("*").alias("groups"), F.count_if(F.col("n") >= 2).alias("shared"))
    gaps = coverage_gaps(blocks, group, source).agg(F.array_sort(F.collect_list(F.concat(F.col(source), F.lit(" only contributed markets in "), F.array_join("categories", ", "), F.lit("; no other source covers them")))).alias("gaps"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731 - single rows side by side
    row = one(have).join(one(gaps), "one").join(one(summary), "one").join(one(cross), "one")
    pairs = (
        F.when(F.col("shared") == 0, "no category had two sources or more - there was nothing to compare").when(F.col("n_pairs_scored") == 0, "categories with several sources exist, but no candidate pairs were scored")
        .when(F.col("n_pairs_matched") == 0, F.format_string("%d pair(s) scored, all below the match threshold (closest score: %.2f)", "n_pairs_scored", F.coalesce("near_miss_max", F.lit(0.0))))
    )
    told = F.array_compact(F.concat("gaps", F.array(pairs)))
    told = F.when(F.size(told) == 0, F.array(F.lit("no event of several sources, and no specific cause was found"))).otherwise(told)
    return row.select(F.when(F.col("groups") == 0, F.array(F.lit("no markets yet"))).when(F.col("n_cross") > 0, F.array(F.format_string("%d event(s) of several sources matched", "n_cross"))).otherwise(told).alias("reasons"))


def violations(df: DataFrame, unique: Sequence[str] = (), not_null: Sequence[str] = (), within: dict[str, tuple[float, float]] | None = None, accepted: dict[str, Sequence] | None = None) -> DataFrame:
    """Data tests as rows: test, column_name, n_failed (rows that fail; of repeated values the surplus). Tests without failures are listed too."""
    checks = [("not_null", c, F.count_if(F.col(c).isNull())) for c in not_null]
    checks += [("range", c, F.count_if((F.col(c) < lo) | (F.col(c) > hi))) for c, (lo, hi) in (within or {}).items()]
    checks += [("accepted_values", c, F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(list(v)))) for c, v in (accepted or {}).items()]
    parts = []
    if checks:
        one = df.agg(*[x.alias(f"c{i}") for i, (_, _, x) in enumerate(checks)])
        rows = F.array(*[F.struct(F.lit(t).alias("test"), F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_failed")) for i, (t, c, _) in enumerate(checks)])
        parts.append(one.select(F.inline(rows)))
    for c in unique:
        repeated = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        parts.append(repeated.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_failed")).select(F.lit("unique").alias("test"), F.lit(c).alias("column_name"), "n_failed"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lookup_or_first(left: DataFrame, right: DataFrame, group: str, on: str, order: str) -> DataFrame:
    """left with the right row of its group and `on`, or else the group's first row in order. Right columns come as a struct `found`; null if the group has none. Of repeated right rows the first in order counts."""
    cols = [c for c in right.columns if c != group]
    row = F.struct(*cols)
    exact = right.groupBy(group, on).agg(F.min_by(row, order).alias("_exact"))
    first = right.groupBy(group).agg(F.min_by(row, order).alias("_first"))
    return left.join(exact, [group, on], "left").join(first, group, "left").withColumn("found", F.coalesce("_exact", "_first")).drop("_exact", "_first")


def best_links(pairs: DataFrame, a: str, b: str, score: str, method: str) -> DataFrame:
    """For each end of a pair its best one: key, best_score, best_method; of equal scores the last method in order."""
    ends = pairs.select(F.explode(F.array(a, b)).alias("key"), F.struct(F.col(score).alias("s"), F.col(method).alias("m")).alias("x")).filter("key is not null and x.s is not null")
    return ends.groupBy("key").agg(F.max("x").alias("x")).select("key", F.col("x.s").alias("best_score"), F.col("x.m").alias("best_method"))


def digest(rows: DataFrame, line: Column, order: Column, most: int = 1900) -> DataFrame:
    """A message of one line a row, in order, cut to `most` characters: one row, message. Only as many rows as can fit are gathered: a line and its break are two characters at least."""
    top = rows.select(line.alias("line"), order.alias("o")).filter("line != ''").orderBy(F.desc("o"), "line").limit(most // 2 + 1)
    return top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("o")).alias("o"), "line"))), lambda x: x["line"]), "\n").alias("m")).select(F.substring("m", 1, most).alias("message"))
