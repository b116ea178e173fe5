"""Quantities recorded in different units, brought to one: a probability between 0 and 1.

The distinct spellings of units are matched to a small dictionary of unit names: an inverted index of
character trigrams proposes names, a weighted edit distance verifies them, and the alias table that
comes out is joined to all rows. So rows never meet the fuzzy step; only distinct spellings do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.columns import fresh, let

# Plain names and symbols of each unit, in the singular and without filler words.
UNITS = {
    "fraction": ["fraction", "probability", "ratio", "share price"],
    "dollar": ["$", "usd", "dollar", "us dollar", "dollar per share", "usd per share"],
    "cent": ["¢", "c", "ct", "cent", "us cent", "cent per share"],
    "percent": ["%", "pct", "percent", "per cent", "percentage", "percentage point"],
    "basis_point": ["bp", "basis point"],
    "decimal_odds": ["decimal", "decimal odds", "european odds", "payout per unit"],
    "american_odds": ["american", "american odds", "us odds", "moneyline", "money line"],
}
# Phrases that say what a unit means, which no edit distance to its name could tell.
PHRASES = {"fraction": ["0-1"], "decimal_odds": ["payout per 1 staked"]}
#: How many of a unit make a whole; '1/100 of a percent' is found by it.
WHOLE = {"fraction": 1, "dollar": 1, "cent": 100, "percent": 100, "basis_point": 10_000}
#: A spelling is taken for the nearest name if their weighted edit distance is at most this share of the longer one's length.
MOST_APART = 0.28
#: What a letter costs: that of a filler word, that of a name's end which an abbreviation leaves out, digits and signs (forbidding), others 1.
FILLER, TAIL, DEAR = 0.1, 0.1, 5.0
# Words that carry no unit.
FILLERS = ["a", "an", "as", "each", "for", "in", "of", "per", "quoted", "the", "to"]
_SIGNS = set("0123456789%$¢")
_RANGE = re.compile(r"\(?\b(?:between )?0(?:\.0+)?\s*(?:-|–|to|and)\s*1(?:\.0+)?\b\)?")
_PART = re.compile(r"^1/(\d{1,9}) of (?:an? |the )?(.+)$")


def clean(unit: Column) -> Column:
    """Lower case, inner white space as one space, none outside."""
    return F.trim(F.regexp_replace(F.lower(unit), r"(?U)\s+", " "))


def parts(spelling: str) -> tuple[str, int]:
    """The words of a cleaned spelling in alphabetical order, and the divisor of one like '1/100 of a percent' (else 1). A range like '0-1' beside other words says nothing more."""
    m = _PART.match(spelling)
    by, rest = (int(m[1]), m[2]) if m and int(m[1]) else (1, spelling)
    bare = _RANGE.sub(" ", rest).strip()
    words = re.findall(r"[^\s_\-./()]+", bare) if bare else ["0-1"]
    return " ".join(sorted(words)), by


def _cost(ch: str) -> float:
    return DEAR if ch in _SIGNS else 1.0


@lru_cache(maxsize=100_000)
def weighted_distance(a: str, b: str) -> float:
    """Edit distance of a word to a name's: digits and signs cost DEAR, other letters 1, neighbours that changed places 1, and the end of the name, where the word abbreviates it, TAIL a letter."""
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        rows[i][0] = rows[i - 1][0] + _cost(x)
    for j, y in enumerate(b, 1):
        rows[0][j] = rows[0][j - 1] + _cost(y)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + _cost(x), rows[i][j - 1] + _cost(y), rows[i - 1][j - 1] + (0 if x == y else max(_cost(x), _cost(y))))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                best = min(best, rows[i - 2][j - 2] + max(1.0, _cost(x), _cost(y)))
            rows[i][j] = best
    end = b[len(a) :]
    return TAIL * len(end) if a and end and b.startswith(a) and not _SIGNS & set(end) else rows[-1][-1]


def _alone(word: str) -> float:
    return FILLER * len(word) if word in FILLERS else sum(map(_cost, word))


def apart(a: str, b: str) -> float:
    """The least cost of turning the words of a spelling into those of a name, in any order: words are paired by weighted_distance or left alone. b is a name of a few words."""
    words, names = a.split(" "), b.split(" ")
    best = {0: 0.0}  # by which names are used up
    for w in words:
        after: dict[int, float] = {}
        for used, cost in best.items():
            ways = [(used, cost + _alone(w))] + [(used | 1 << i, cost + weighted_distance(w, n)) for i, n in enumerate(names) if not used >> i & 1]
            for state, c in ways:
                if c < after.get(state, float("inf")):
                    after[state] = c
        best = after
    return min(cost + sum(_alone(n) for i, n in enumerate(names) if not used >> i & 1) for used, cost in best.items())


@F.pandas_udf(T.StructType([T.StructField("words", T.StringType()), T.StructField("divisor", T.IntegerType())]))
def _parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([parts(x) for x in batch], columns=["words", "divisor"])


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([apart(x, y) for x, y in zip(a, b)], dtype="float64")


def _grams(text: Column) -> Column:
    """The trigrams of a text's words written together, and the first letter of each word, which is all that an abbreviation may share."""
    padded = F.concat(F.lit("^"), F.replace(text, F.lit(" "), F.lit("")), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, 3))
    return F.array_distinct(F.concat(grams, F.transform(F.split(text, " "), lambda w: F.concat(F.lit("^"), F.substring(w, 1, 1)))))


def dictionary(spark: SparkSession) -> DataFrame:
    """The known names, also in the plural, and phrases, their words in alphabetical order: known, unit."""
    rows = [(parts(s)[0], u) for names in (UNITS, PHRASES) for u, spellings in names.items() for s in spellings]
    rows += [(parts(s + "s")[0], u) for u, spellings in UNITS.items() for s in spellings if len(s) > 1 and not s.endswith("s")]
    return spark.createDataFrame(rows, "known string, unit string")


def proposals(spellings: DataFrame, column: str = "spelling") -> DataFrame:
    """Each distinct spelling (already clean) beside the names that share a trigram or a word's first letter with it: spelling, words, divisor, known, unit, shared, distance. Null and blank spellings have none.

    All spellings go through the index and the distance, those that the dictionary holds too (their distance is 0).
    """
    spark = spellings.sparkSession
    distinct = spellings.select(F.col(column).alias("spelling")).filter("spelling is not null and spelling != ''").distinct()
    read = distinct.select("spelling", _parts("spelling").alias("p")).select("spelling", "p.words", "p.divisor")
    index = dictionary(spark).select("known", "unit", F.explode(_grams(F.col("known"))).alias("gram"))
    met = read.select("*", F.explode(_grams(F.col("words"))).alias("gram")).join(F.broadcast(index), "gram")  # the names are fixed
    found = met.groupBy("spelling", "words", "divisor", "known", "unit").agg(F.count("*").alias("shared"))
    return found.withColumn("distance", _distance("words", "known"))


def aliases(spellings: DataFrame, column: str = "spelling") -> DataFrame:
    """The unit of each distinct spelling (already clean): spelling, unit, distance, shared (what it shares with the name taken). Spellings near to no name are left out.

    A name is near if its distance is at most MOST_APART of the longer text. Ties go to the name that
    shares more, then to the alphabetically first unit. A part of a unit ('1/100 of a cent') is
    the unit of that size, or none.
    """
    near = proposals(spellings, column).filter(F.col("distance") <= MOST_APART * F.greatest(F.length("words"), F.length("known")))
    best = near.groupBy("spelling", "divisor").agg(F.min(F.struct("distance", (-F.col("shared")).alias("fewer"), "unit")).alias("b")).select("spelling", "divisor", "b.*")
    size = F.try_element_at(F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair]), F.col("unit"))
    whole = F.when(F.col("divisor") == 1, F.col("unit"))
    for unit in ("cent", "basis_point"):
        whole = whole.when(size * F.col("divisor") == WHOLE[unit], F.lit(unit))
    return best.withColumn("unit", whole).filter("unit is not null").select("spelling", "unit", "distance", (-F.col("fewer")).alias("shared"))


def quantity(text: Column) -> Column:
    """struct<value double, unit string>: the number in a text and the cleaned sign or word beside it ('' for none); null without exactly one number."""
    number = r"^([^0-9.+-]*?)\s*([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d+)?)\s*([^0-9]*)$"
    groups = let(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), lambda t: F.when(t.rlike(number), F.split(F.regexp_replace(t, number, "$2\x1f$1\x1f$3"), "\x1f", -1)))
    return let(groups, lambda g: F.when(g[0].rlike(r"\d"), F.struct(F.replace(g[0], F.lit(","), F.lit("")).try_cast("double").alias("value"), clean(F.concat(g[1], g[2])).alias("unit"))))


def millionths(p: Column) -> Column:
    """A probability times 1,000,000 as a whole number; a half goes to the even one, as 1/5.12 (195312.5) does."""
    return F.rint(p * 1_000_000).cast("bigint")


def to_probability(value: Column, unit: Column) -> Column:
    """The probability that a value in a unit of UNITS stands for: odds as 1 over the payout, margin left in. Null outside [0, 1] and where undefined."""
    p = (
        F.when(unit.isin("fraction", "dollar"), value).when(unit.isin("cent", "percent"), value / 100).when(unit == "basis_point", value / 10_000)
        .when((unit == "decimal_odds") & (value >= 1), 1 / F.nullif(value, F.lit(0.0)))
        .when((unit == "american_odds") & (value > 0), 100 / F.nullif(value + 100, F.lit(0.0))).when((unit == "american_odds") & (value < 0), value / F.nullif(value - 100, F.lit(0.0)))
    )
    return F.when(p.between(0, 1), p)


def quoted_scale(value: Column, least: float = 0.02, most: float = 0.98) -> Column:
    """The only unit under which a bare number lies within the bounds of quoted probabilities: 'fraction', 'percent', 'basis_point', or null for none."""
    return F.when(value.between(least, most), "fraction").when(value.between(100 * least, 100 * most), "percent").when(value.between(10_000 * least, 10_000 * most), "basis_point")


def with_unit(df: DataFrame, spelling: str, default: Column) -> DataFrame:
    """df with unit added: that of the spelling column by the alias table, default where it is null or blank, null where nothing is near.

    The alias table has a row for each distinct spelling; Spark broadcasts it only below its own
    threshold, else joins by shuffle.
    """
    key, known, unit = (fresh(df, n) for n in ("_key", "_spelling", "_unit"))
    found = aliases(df.select(clean(F.col(spelling)).alias("spelling"))).select(F.col("spelling").alias(known), F.col("unit").alias(unit))
    blank = F.col(spelling).isNull() | (clean(F.col(spelling)) == "")
    joined = df.withColumn(key, clean(F.col(spelling))).join(found, F.col(key) == F.col(known), "left")
    return joined.withColumn("unit", F.when(blank, default).otherwise(F.col(unit))).drop(key, known, unit)
