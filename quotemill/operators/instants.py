"""Timestamps in mixed notations, precisions and zones, brought to one UTC instant each.

Every text is read under all layouts that fit it. Where more than one reading stays possible (bare
numbers, numeric dates with day and month in either order), expectation-maximisation over a mixture
of formats for each source decides: a value adds likelihood under each valid reading, namely the
format's weight times how usual the reading's month is for the source, times the prior that a
declared date order gives; posteriors choose the reading, or leave the value marked as ambiguous.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.columns import let, stripped, without
from quotemill.session import Stored

# Zone abbreviations with their offset from UTC in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "ist": 330, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780,
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_SEP = "\x1f"
_ZONE = r"(?:\s*((?:UTC|GMT)?[+-]\d{1,2}:?\d{2}|(?:UTC|GMT)?[+-]\d{1,2}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+|[A-Za-z]{1,5}))?\s*(?:\[([A-Za-z0-9_/+-]+)\])?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?" + _ZONE
_DOW = r"(?:[A-Za-z]{3,9}\.?,?\s+)?"
_TH = r"(?:st|nd|rd|th)?"
#: Layouts by name, and the order of their groups: year, month, day, hour, minute, second, fraction, half, zone, bracket.
LAYOUTS = {
    "ymd": (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[Tt]|,?\s+)" + _TIME, range(1, 11)),
    "compact": (r"(\d{4})(\d{2})(\d{2})[Tt ]?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?()" + _ZONE, range(1, 11)),
    "numeric": (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}),?(?:[Tt]|\s+)" + _TIME, (3, 1, 2, *range(4, 11))),
    "day_month": (_DOW + r"(\d{1,2})" + _TH + r"[\s-]+([A-Za-z]{3,9})\.?,?[\s-]+(\d{4}),?\s+(?:at\s+)?" + _TIME, (3, 2, 1, *range(4, 11))),
    "month_day": (_DOW + r"([A-Za-z]{3,9})\.?\s+(\d{1,2})" + _TH + r",?\s+(\d{4}),?\s+(?:at\s+)?" + _TIME, (3, 1, 2, *range(4, 11))),
}
#: Bare numbers by unit: how many there are in a second.
EPOCHS = {"epoch_s": 0, "epoch_ms": 3, "epoch_us": 6, "epoch_ns": 9}
#: Instants outside are taken for no instant: 1980-01-01 to 2200-01-01, in seconds.
PLAUSIBLE = (315532800, 7258118400)
#: How much likelier the declared order of day and month is than the other, where a numeric date fits both.
ORDER_ODDS = 1e9
#: Values that each format and each month counts for beforehand: formats are habits, months less so.
FORMAT_PRIOR, MONTH_PRIOR = 0.05, 2.0
#: A reading whose posterior stays below is marked as ambiguous.
SURE = 0.9


def readings(text: Column) -> Column:
    """array<struct<format, wall, zone>>: each valid reading of a text; wall is the clock face as microseconds, zone '' where the text names none.

    Null, empty, placeholder texts, dates without a time of day, and dates that don't exist have no
    reading. Outer white space is ignored, fractions are cut to microseconds.
    """
    return let(stripped(text), lambda t: F.flatten(F.filter(F.transform(F.array(_parts(t)), _read), lambda x: x.isNotNull())))


def _parts(t: Column) -> Column:
    parts = F.when(F.lit(False), F.array(F.lit("")))
    for name, (regex, groups) in LAYOUTS.items():
        parts = parts.when(t.rlike(f"^{regex}\\z"), F.split(F.regexp_replace(t, f"^{regex}\\z", _SEP.join([name, *(f"${g}" for g in groups)])), _SEP, -1))
    number = r"^(\d{9,19})(?:\.(\d+))?\z"
    parts = parts.when(t.rlike(number), F.split(F.regexp_replace(t, number, f"epoch{_SEP}$1{_SEP}$2"), _SEP, -1))
    return parts


def _read(p: Column) -> Column:
    """The readings of a text's parts, or null."""
    at = lambda i: F.get(p, F.lit(i))
    number = lambda i: at(i).try_cast("int")
    named = let(F.instr(F.lit(MONTHS), F.rpad(F.lower(F.substring(at(2), 1, 3)), 3, "?")), lambda i: F.when(i % 3 == 1, F.floor((i + 2) / 3).cast("int")))
    half = F.lower(at(8))
    hour = let(number(4), lambda h: F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0)))
    fraction = F.coalesce(F.rpad(F.substring(at(7), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    # The bracketed zone counts only where no offset stands before it.
    zone = F.when(at(9) != "", at(9)).otherwise(F.coalesce(at(10), F.lit("")))
    numbers = F.struct(
        number(1).alias("y"), F.coalesce(number(2), named).alias("m"), number(3).alias("d"), hour.alias("h"), number(5).alias("i"), F.coalesce(number(6), F.lit(0)).alias("s"), fraction.alias("f"), zone.alias("zone"),
    )
    text = let(numbers, lambda n: _face(p[0], n))
    number_only = let(F.struct(at(1).try_cast("bigint").alias("n"), F.coalesce(F.rpad(F.substring(at(2), 1, 6), 6, "0").try_cast("bigint"), F.lit(0)).alias("f")), _epoch)
    return let(F.when(p[0] == "epoch", number_only).otherwise(text), _plausible)


def _one(name: Column, wall: Column, zone: Column) -> Column:
    return F.struct(name.alias("format"), wall.alias("wall"), zone.alias("zone"))


def _face(layout: Column, n: Column) -> Column:
    def wall(m: Column, d: Column) -> Column:
        ok = (n["y"] >= 1) & m.between(1, 12) & d.between(1, 31) & n["h"].between(0, 23) & n["i"].between(0, 59) & n["s"].between(0, 59)
        return F.when(ok, F.unix_micros(F.try_make_timestamp(n["y"], m, d, n["h"], n["i"], n["s"].cast("decimal(16,6)"), F.lit("UTC"))) + n["f"])

    either = F.array(_one(F.lit("mdy"), wall(n["m"], n["d"]), n["zone"]), _one(F.lit("dmy"), wall(n["d"], n["m"]), n["zone"]))
    return F.when(layout == "numeric", either).otherwise(F.array(_one(layout, wall(n["m"], n["d"]), n["zone"])))


def _epoch(x: Column) -> Column:
    def wall(digits: int) -> Column:
        fits = x["n"] < F.lit(min(PLAUSIBLE[1] * 10**digits, 2**63 - 1))
        whole = F.when(fits, x["n"] * F.lit(10 ** (6 - digits)) if digits <= 6 else F.call_function("div", x["n"], F.lit(10 ** (digits - 6))))
        return whole + x["f"] if digits == 0 else whole

    return F.array(*[_one(F.lit(unit), wall(k), F.lit("UTC")) for unit, k in EPOCHS.items()])


def _plausible(all_: Column) -> Column:
    inside = F.filter(all_, lambda r: r["wall"].between(PLAUSIBLE[0] * 10**6, PLAUSIBLE[1] * 10**6))
    # The 3rd of March is the same in either order.
    return let(inside, lambda x: F.when((F.size(x) == 2) & (F.get(x, F.lit(0))["wall"] == F.get(x, F.lit(1))["wall"]), F.slice(x, 1, 1)).otherwise(x))


def to_utc(spark: SparkSession, wall: Column, zone: Column, default_zone: Column) -> Column:
    """Microseconds since 1970 UTC of a clock face in a zone: an offset, an abbreviation, a zone's name, or '' for the default. Null for an unknown zone.

    A repeated hour means its first pass, a skipped one moves forward by the gap.
    """
    known = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    offset = F.regexp_replace(F.upper(zone), "^(UTC|GMT)(?=[+-])", "")
    digits = F.regexp_replace(F.substring(offset, 2, 9), ":", "")
    hours = F.when(F.length(digits) <= 2, digits.try_cast("int")).when(F.length(digits) == 3, F.substring(digits, 1, 1).try_cast("int")).otherwise(F.substring(digits, 1, 2).try_cast("int"))
    minutes = F.when(F.length(digits) <= 2, F.lit(0)).otherwise(F.substring(digits, -2, 2).try_cast("int"))
    signed = F.when(offset.rlike(r"^[+-]\d"), F.when(offset.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes))
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    shift = F.coalesce(signed, F.try_element_at(table, F.lower(zone)))
    name = F.when(zone == "", default_zone).otherwise(zone)
    name = F.when(name.isin(known), name)
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), F.coalesce(name, F.lit("UTC"))))
    return F.when((zone != "") & shift.isNotNull(), wall - shift.cast("bigint") * 60_000_000).when(name.isNotNull(), local)


@dataclass
class Signature:
    """All values of a source with the same possible readings, as (format, month) pairs."""

    source: str
    readings: tuple[tuple[str, int], ...]
    order: str
    n: int


def mixture(signatures: Iterable[Signature], rounds: int = 10_000) -> dict[tuple[str, str, tuple[tuple[str, int], ...]], list[float]]:
    """The posteriors of each signature's readings, by (source, order, readings), after EM over a source's format weights and months.

    Its input is one row for each different set of readings, so its size is bounded by the layouts
    and the months of PLAUSIBLE and doesn't grow with the rows. EM ends when no weight moves any more; a
    source that hasn't settled after `rounds` is named in a warning.
    """
    out = {}
    by_source: dict[str, list[Signature]] = {}
    for s in signatures:
        by_source.setdefault(s.source, []).append(s)
    for source, group in by_source.items():
        formats, months = {f for s in group for f, _ in s.readings}, {m for s in group for _, m in s.readings}
        weight, usual = dict.fromkeys(formats, 1 / len(formats)), dict.fromkeys(months, 1 / len(months))
        post: list[list[float]] = []
        for _ in range(rounds):
            post = []
            for s in group:
                prior = [1 / ORDER_ODDS if f in ("dmy", "mdy") and s.order in ("dmy", "mdy") and f != s.order else 1.0 for f, _ in s.readings]
                like = [weight[f] * usual[m] * p for (f, m), p in zip(s.readings, prior)]
                total = sum(like)
                post.append([x / total for x in like])
            new_w, new_u = dict.fromkeys(formats, FORMAT_PRIOR), dict.fromkeys(months, MONTH_PRIOR)
            for s, p in zip(group, post):
                for (f, m), x in zip(s.readings, p):
                    new_w[f] += s.n * x
                    new_u[m] += s.n * x
            tw, tu = sum(new_w.values()), sum(new_u.values())
            change = max(abs(weight[f] - new_w[f] / tw) for f in formats)
            weight, usual = {f: x / tw for f, x in new_w.items()}, {m: x / tu for m, x in new_u.items()}
            if change < 1e-9:
                break
        else:
            warnings.warn(f"format mixture of {source!r} not settled after {rounds} rounds", stacklevel=2)
        out |= {(source, s.order, s.readings): p for s, p in zip(group, post)}
    return out


def normalise(df: DataFrame, text: Column, source: Column, default_zone: Column, date_order: Column | None = None) -> DataFrame:
    """df with utc_micros (bigint), time_format, posterior and time_status added: 'resolved', 'ambiguous' or 'no instant'.

    source names the mixture a value belongs to, default_zone holds where the text names no zone,
    date_order is 'mdy', 'dmy' or null where nothing is declared. Texts without a valid reading, or
    in an unknown zone, are 'no instant'; where no reading reaches the posterior SURE the value is
    'ambiguous' and keeps a null instant. Nulls give 'no instant'. Rows are neither added nor lost;
    columns of df with the names of the added ones are replaced.
    """
    spark = df.sparkSession
    month = lambda r: F.floor(r["wall"] / 2_629_800_000_000).cast("int")
    kept = without(df, "utc_micros", "time_format", "posterior", "time_status").columns
    read = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), readings(text).alias("_r"), F.coalesce(source, F.lit("")).alias("_source"), default_zone.alias("_zone"), F.coalesce(date_order if date_order is not None else F.lit(None), F.lit("")).alias("_order"))
    read = read.withColumn("_sig", F.transform("_r", lambda r: F.struct(r["format"].alias("format"), month(r).alias("month"))))
    read = Stored(read).df  # every text is read once, for the mixture and for the result
    open_ = F.size("_r") > 1
    # Values with one reading only say how usual formats and months are; both tables are bounded.
    found = read.filter(F.size("_r") > 0).groupBy("_source", "_order", "_sig").agg(F.count("*").alias("n")).collect()
    if not any(len(r["_sig"]) > 1 for r in found):
        chosen = read.withColumns({"_i": F.lit(0), "_p": F.lit(1.0)})
    else:
        post = mixture(Signature(r["_source"], tuple((x["format"], x["month"]) for x in r["_sig"]), r["_order"], r["n"]) for r in found)
        key = lambda f: F.concat_ws(",", F.transform(f, lambda x: F.concat_ws(":", x["format"], x["month"].cast("string"))))
        rows = [(s, o, ",".join(f"{f}:{m}" for f, m in sig), max(range(len(p)), key=p.__getitem__), float(max(p))) for (s, o, sig), p in post.items() if len(sig) > 1]
        resolved = spark.createDataFrame(rows, "_source string, _order string, _key string, _i int, _p double")
        read = read.withColumn("_key", F.when(open_, key("_sig")))
        chosen = read.join(F.broadcast(resolved), ["_source", "_order", "_key"], "left").withColumns({"_i": F.coalesce("_i", F.lit(0)), "_p": F.coalesce("_p", F.lit(1.0))})
    chosen = chosen.select("*", F.get("_r", F.col("_i")).alias("_best"))
    best, sure = F.col("_best"), F.col("_p") >= SURE
    utc = let(best, lambda b: to_utc(spark, b["wall"], b["zone"], F.col("_zone")))
    chosen, utc = chosen.select("*", utc.alias("_utc")), F.col("_utc")
    out = chosen.select("_row.*", F.when(sure, utc).alias("utc_micros"), best["format"].alias("time_format"), F.when(best.isNotNull(), F.col("_p")).alias("posterior"), F.when(utc.isNull(), "no instant").when(sure, "resolved").otherwise("ambiguous").alias("time_status"))
    return out
