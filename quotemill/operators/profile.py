"""Column profiles of grouped loads: nulls, distincts, ranges, patterns, power sums, and what is out of line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.session import Stored

#: Decimal places that the exact power sums keep of a value.
PLACES = 4
#: Columns of power_sums.
SUMS = [f"s{i}" for i in range(1, 5)] + [f"sum{i}" for i in range(1, 5)]
#: Order-preserving buckets in each doubling of a value's size, for exact medians without one big sort.
PER_OCTAVE = 1024
_OFFSET = 2_000_000


def present(c: Column, kind: T.DataType) -> Column:
    """The value, with NaN taken for missing."""
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


def power_sums(value: Column) -> list[Column]:
    """s1..s4: exact, mergeable sums of the first four powers of value * 10**PLACES, as decimals without a fraction; and sum1..sum4: sums of the powers of the value itself, as doubles.

    Sums of whole numbers don't depend on the order of merging, so profiles of parts add up to the
    profile of the whole bit by bit. Where a value or its power has too many digits, or the sum has,
    the exact sum is null, never that of the other values only. The doubles are the exact sums where
    those hold every digit, else (more than PLACES decimals, or too large) sums of doubles.
    """
    k = F.round(value * 10**PLACES).try_cast("decimal(18,0)")
    k2 = (k * k).cast("decimal(37,0)")
    powers = [k.cast("decimal(38,0)"), k2.cast("decimal(38,0)"), F.try_multiply(k2.cast("decimal(38,0)"), k).try_cast("decimal(38,0)"), F.try_multiply(k2.cast("decimal(38,0)"), k2).try_cast("decimal(38,0)")]
    sums = [F.when(F.count(p) == F.count(value), F.try_sum(p)) for p in powers]
    cut = F.coalesce(F.bool_or(k.isNull() | (k.cast("double") / 10**PLACES != value)), F.lit(False))
    doubles = [F.when(s.isNotNull() & ~cut, s.cast("double") / float(10**PLACES) ** i).otherwise(F.sum(F.pow(value, F.lit(i)))) for i, s in enumerate(sums, 1)]
    return [s.alias(f"s{i}") for i, s in enumerate(sums, 1)] + [d.alias(f"sum{i}") for i, d in enumerate(doubles, 1)]


def _finite(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c)


def moments(df: DataFrame, n: str = "n_values") -> DataFrame:
    """Adds mean, stddev, skewness and excess kurtosis from n and sum1..sum4; null where undefined or beyond a double."""
    c = F.nullif(F.col(n).cast("double"), F.lit(0.0))
    df = df.withColumns({"mean": _finite(F.col("sum1") / c), **{f"_r{i}": _finite(F.col(f"sum{i}") / c) for i in (2, 3, 4)}})
    var = F.col("_r2") - F.col("mean") ** 2
    df = df.withColumn("_var", F.when(var.isNotNull(), F.greatest(var, F.lit(0.0))))
    third = F.col("_r3") - 3 * F.col("mean") * F.col("_r2") + 2 * F.col("mean") ** 3
    fourth = F.col("_r4") - 4 * F.col("mean") * F.col("_r3") + 6 * F.col("mean") ** 2 * F.col("_r2") - 3 * F.col("mean") ** 4
    sd = F.nullif(F.sqrt("_var"), F.lit(0.0))
    return df.withColumns({"stddev": F.sqrt("_var"), "skewness": _finite(third / sd**3), "kurtosis": _finite(fourth / sd**4 - 3)}).drop("_r2", "_r3", "_r4", "_var")


def standardised_difference(df: DataFrame, load: str, within: Sequence[str], n: str = "n_values") -> DataFrame:
    """Adds std_diff: a load's mean less the mean of all other loads of its source, over the pooled deviation of those others.

    The others' sums are those of the loads before and after, not the total less the own, so a load of
    huge values doesn't swallow the others' digits. Null for a single load or no spread. One row a
    (load, source) goes in, so the window is small.
    """
    w = Window.partitionBy(*within).orderBy(load)
    sides = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    others = {k: sum((F.coalesce(F.sum(F.col(k).cast("double")).over(side), F.lit(0.0)) for side in sides), F.lit(0.0)) for k in (n, "sum1", "sum2")}
    c = F.nullif(others[n], F.lit(0.0))
    mean, square = _finite(others["sum1"] / c), _finite(others["sum2"] / c)
    sd = F.when(square.isNotNull() & mean.isNotNull(), F.nullif(F.sqrt(F.greatest(square - mean**2, F.lit(0.0))), F.lit(0.0)))
    return df.withColumn("std_diff", _finite((F.col("sum1") / F.nullif(F.col(n).cast("double"), F.lit(0.0)) - mean) / sd))


def value_counts(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """How often each non-null value stands in each group: keys, value, n. Hot values are reduced map-side."""
    return df.select(*keys, value.alias("value")).filter("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))


def top_share(counts: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """The share of the k commonest values of each group among its non-null ones: keys, top_share."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "value")
    top = counts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).groupBy(*keys).agg(F.sum("n").alias("top_n"))
    return top.join(counts.groupBy(*keys).agg(F.sum("n").alias("all_n")), list(keys)).select(*keys, (F.col("top_n") / F.col("all_n")).alias("top_share"))


def _bucket(value: Column) -> Column:
    size = F.least(F.greatest(F.floor(F.log2(F.abs(value)) * PER_OCTAVE), F.lit(-_OFFSET + 1)), F.lit(_OFFSET - 1))
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("int") * (size.cast("int") + _OFFSET))


def medians(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The exact median of each group's values (mean of the middle two for an even number): keys, median.

    Takes value_counts. Values fall into order-preserving buckets; counts by bucket (a few thousand
    rows a group, whatever its size) tell which bucket holds the middle, and only that bucket's
    distinct values are then put in order. So no group is ever sorted as a whole.
    """
    keys = list(keys)
    b = counts.withColumn("bucket", _bucket(F.col("value")))
    per = b.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy(*keys))
    per = per.select(*keys, "bucket", F.coalesce(below, F.lit(0)).alias("below"), F.col("n").alias("here"), total.alias("total"))
    lo, hi = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    hold = per.filter(((F.col("below") <= lo) & (lo < F.col("below") + F.col("here"))) | ((F.col("below") <= hi) & (hi < F.col("below") + F.col("here"))))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = b.join(hold.drop("here"), [*keys, "bucket"]).withColumn("below", F.col("below") + inside)
    ends = [F.max(F.when((F.col("below") <= r) & (r < F.col("below") + F.col("n")), F.col("value"))) for r in (lo, hi)]
    return at.groupBy(*keys).agg(((ends[0] + ends[1]) / 2).alias("median"))


def _identity(v: Column, kind: T.DataType) -> tuple[Column, Column]:
    """A value as two whole numbers of fixed width that are the same for the same values only: exact up to 8 bytes, 128 bits of digests for longer ones."""
    fixed = isinstance(kind, (T.IntegralType, T.DoubleType, T.FloatType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = v + F.lit(0.0)  # both zeros are one
    return F.xxhash64(v), F.lit(0).cast("bigint") if fixed else F.xxhash64(F.lit("second"), v)


def distincts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """How many different non-null values each group has by column: keys, column_name, n_distinct; columns without a value have no row.

    Grouped distincts: every value of every column is one narrow row (_identity), repeats go map-side
    before the shuffle, and what is shuffled is the distinct values, spread by their digests, so a group
    that holds a third of all rows is no hot task.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    values = []
    for c in columns:
        v = present(F.col(f"`{c}`"), fields[c])
        x, y = _identity(v, fields[c])
        values.append(F.when(v.isNotNull(), F.struct(F.lit(c).alias("column_name"), x.alias("_x"), y.alias("_y"))))
    rows = df.select(*keys, F.inline(F.array_compact(F.array(*values))))
    return rows.groupBy(*keys, "column_name", "_x", "_y").agg(F.lit(1).alias("one")).groupBy(*keys, "column_name").agg(F.count("*").alias("n_distinct"))


def profile(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, ranges: dict[str, tuple[float, float]] | None = None, patterns: dict[str, str] | None = None, distinct: Sequence[str] | None = None, text_bounds: bool = True, sums: Sequence[str] | None = None) -> DataFrame:
    """One row for each group and column: keys, column_name, n_rows, n_null, n_values, null_rate, n_distinct, min_value, max_value, n_out_of_range, n_blank, n_off_pattern, s1..s4, sum1..sum4 (see power_sums), mean, stddev, skewness, kurtosis.

    Two passes: one of mergeable aggregates, which shuffles a row a task and group, and grouped
    distincts (see distincts), of the columns in distinct (default all that are no arrays, maps or
    structs; the others' n_distinct is null). ranges gives closed bounds of numbers, patterns the regex
    that a whole text must match; violations are counted among non-null values, blank texts also count
    as off pattern. Without text_bounds texts have no min_value and max_value, which keeps the pass a
    hash aggregate. Power sums and moments are those of the columns in sums, by default of all numbers.
    NaN is missing. Arrays and structs get nulls and counts only. An empty table gives
    no rows.
    """
    ranges, patterns = ranges or {}, patterns or {}
    fields = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in (columns or df.columns) if c not in keys]
    aggregates = []
    for i, c in enumerate(columns):
        kind = fields[c]
        v = present(F.col(f"`{c}`"), kind)
        number, text, plain = isinstance(kind, T.NumericType), isinstance(kind, T.StringType), isinstance(kind, T.AtomicType)
        bounded, null = plain and (text_bounds or not text), F.lit(None)
        parts = {
            "n_rows": F.count("*"), "n_values": F.count(v),
            "min_value": F.min(v).cast("string") if bounded else null.cast("string"), "max_value": F.max(v).cast("string") if bounded else null.cast("string"),
            "n_out_of_range": F.count_if((v < ranges[c][0]) | (v > ranges[c][1])) if c in ranges else null.cast("bigint"),
            "n_blank": F.count_if(F.trim(v) == "") if text else null.cast("bigint"),
            "n_off_pattern": F.count_if((F.trim(v) == "") | ~v.rlike(f"^(?:{patterns[c]})\\z")) if c in patterns else null.cast("bigint"),
        }
        powers = power_sums(v.cast("double")) if number and (sums is None or c in sums) else [null.cast("decimal(38,0)")] * 4 + [null.cast("double")] * 4
        aggregates += [x.alias(f"{n}_{i}") for n, x in parts.items()] + [x.alias(f"{n}_{i}") for n, x in zip(SUMS, powers)]
    names = ["n_rows", "n_values", "min_value", "max_value", "n_out_of_range", "n_blank", "n_off_pattern", *SUMS]
    wide = df.groupBy(*keys).agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, c in enumerate(columns)])
    long = wide.select(*keys, F.inline(rows))
    plain = [c for c in columns if isinstance(fields[c], T.AtomicType)]
    counted = [c for c in (plain if distinct is None else distinct) if c in columns]
    if counted:
        per = distincts(df, keys, counted).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("column_name").alias("_column"), "n_distinct")
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("column_name") == F.col("_column")]
        long = long.join(per, on, "left").drop("_column", *[f"_{k}" for k in keys])
        long = long.withColumn("n_distinct", F.when(F.col("column_name").isin(counted), F.coalesce("n_distinct", F.lit(0))))
    else:
        long = long.withColumn("n_distinct", null.cast("bigint"))
    out = long.withColumns({"n_null": F.col("n_rows") - F.col("n_values"), "null_rate": (F.col("n_rows") - F.col("n_values")) / F.col("n_rows")})
    return moments(out)


def shift_in_doubt(moments: DataFrame, load: str, source: str, limit: float = 3.0) -> DataFrame:
    """The sources with a load that the moments alone can't clear of a shift: source.

    A median lies within one deviation of the mean, so the median of a source's load medians lies
    between the medians of the loads' lower and upper bounds; a load whose own bounds stay within
    1/limit and limit times of those isn't shifted whatever its values are. One row a load goes in.
    """
    low, high = F.col("mean") - F.col("stddev"), F.col("mean") + F.col("stddev")
    w = Window.partitionBy(source)
    rows = moments.select(load, source, low.alias("low"), high.alias("high")).withColumns({"least": F.median("low").over(w), "most": F.median("high").over(w)})
    clear = (F.col("least") > 0) & (F.col("low") * limit >= F.col("most") * (1 + 1e-9)) & (F.col("high") * (1 + 1e-9) <= F.col("least") * limit)
    return rows.filter(F.col("low").isNotNull() & ~F.coalesce(clear, F.lit(False))).select(source).distinct()


def out_of_line(quotes: DataFrame, health: DataFrame, load: str = "load_id", source: str = "source") -> DataFrame:
    """What is out of line in market quotes, by load and source: load_id, source, column_name, issue.

    The issues are those of problem 1 in TESTDATA.md: null_rate, duplicates, range, pattern,
    constant, shift, report. All counts are those of `profile`, the key's distincts too; shares are
    compared with the median of the source's loads. A shift is defined by medians: the power sums clear
    the sources where no load can be shifted, the exact medians of the others follow as a check.
    Two shuffles follow the input: distinct (group, quote key) and distinct (group, price),
    both reduced map-side; all else is one row a group and task. Null or NaN values are missing; a null outcome is no
    pattern violation; a group with no values at all has no range, constant or shift issue. An empty
    table gives no rows.
    """
    keys = [load, source]
    price = present(F.col("price"), quotes.schema["price"].dataType)
    folded = quotes.select(*keys, "price", "implied_prob", "close_ts", "outcome", F.lower("quote_key").alias("quote_key"))
    found = profile(folded, keys, ranges={"implied_prob": (0.0, 1.0)}, patterns={"outcome": "[A-Za-z0-9 .'-]*"}, distinct=["quote_key"], text_bounds=False, sums=["price"])
    long = Stored(found).df  # a row a group and column, read twice
    of = lambda column, value: F.max(F.when(F.col("column_name") == column, F.col(value)))
    base = long.groupBy(*keys).agg(
        F.max("n_rows").alias("n"), of("price", "n_values").alias("n_price"), of("implied_prob", "n_values").alias("n_prob"), of("close_ts", "n_values").alias("n_close"), of("outcome", "n_values").alias("n_outcome"),
        of("implied_prob", "n_out_of_range").alias("n_range"), of("outcome", "n_off_pattern").alias("n_off"), of("quote_key", "n_distinct").alias("n_keys"),
    )
    counts = value_counts(quotes, keys, price)
    doubt = shift_in_doubt(long.filter("column_name = 'price'"), load, source)
    middle = medians(counts.join(F.broadcast(doubt), source, "left_semi"), keys)  # a row a source
    base = base.join(top_share(counts, keys), keys, "left").join(middle, keys, "left")
    reported = health.select(*keys, F.col("null_rate").alias("h_null"), F.col("duplicate_rate").alias("h_dup"), F.col("prob_violations").alias("h_range"))
    shares = base.join(reported, keys, "left").select(
        *keys, "top_share", "median", "h_null", "h_dup", "h_range", "n_range",
        (1 - F.col("n_price") / F.col("n")).alias("null_price"), (1 - F.col("n_prob") / F.col("n")).alias("null_prob"), (1 - F.col("n_close") / F.col("n")).alias("null_close"),
        (1 - F.coalesce("n_keys", F.lit(0)) / F.col("n")).alias("dup"), F.try_divide("n_range", "n_prob").alias("range"), F.try_divide("n_off", "n_outcome").alias("pattern"),
    )
    w = Window.partitionBy(source)  # a row a load
    over = {c: F.col(c) - F.median(c).over(w) for c in ("null_price", "null_prob", "null_close", "dup", "range", "pattern")}
    ratio = F.try_divide("median", F.median("median").over(w))
    slack = 1e-9  # shares are ratios of counts; a difference that equals its limit may come out a bit below
    rules = [
        ("price", "null_rate", over["null_price"] >= 0.15 - slack), ("implied_prob", "null_rate", over["null_prob"] >= 0.15 - slack), ("close_ts", "null_rate", over["null_close"] >= 0.15 - slack),
        ("quote_key", "duplicates", over["dup"] >= 0.10 - slack), ("implied_prob", "range", over["range"] >= 0.15 - slack), ("outcome", "pattern", over["pattern"] >= 0.15 - slack),
        ("price", "constant", F.col("top_share") >= 0.8 - slack), ("price", "shift", (ratio < 1 / 3) | (ratio > 3)),
        ("null_rate", "report", F.abs(F.col("h_null") - F.col("null_prob")) > 0.0001 + slack), ("duplicate_rate", "report", F.abs(F.col("h_dup") - F.col("dup")) > 0.0001 + slack), ("prob_violations", "report", F.col("h_range") != F.col("n_range")),
    ]
    flagged = shares.select(*keys, F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("issue"))) for c, i, rule in rules])).alias("found"))
    return flagged.select(*keys, F.inline("found"))


def price_shift(quotes: DataFrame, load: str = "load_id", source: str = "source", column: str = "price") -> DataFrame:
    """How far each load's values lie from the source's other loads: load, source, n_values, mean, stddev, std_diff (6 places), from the power sums of profile; all null without values."""
    found = standardised_difference(profile(quotes.select(load, source, column), [load, source], distinct=[]), load, [source])
    return found.select(load, source, "n_values", *[F.round(c, 6).alias(c) for c in ("mean", "stddev", "std_diff")])
