"""What a market's title says, as column expressions: tokens, numbers, subject, entities, predicate, category, thresholds."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.columns import let

# Word lists that matching results depend on.
STOPWORDS = [
    "will", "the", "a", "an", "be", "is", "are", "to", "of", "on", "in", "at", "by", "for", "and", "or", "this", "that", "it", "with", "have", "has", "do", "does", "than", "more", "less", "least",
    "above", "below", "over", "under", "yes", "no",
]
CATEGORIES = {
    "weather": ["temperature", "temp", "high", "low", "rain", "snow", "degrees", "fahrenheit", "weather", "82.5f"],
    "sports": ["beat", "defeat", "win", "wins", "winner", "game", "vs", "celtics", "lakers", "nba", "nfl", "mlb", "nhl", "fifa", "world_cup", "championship", "finals", "playoff", "group", "tournament", "season", "match"],
    "politics": [
        "election", "president", "presidential", "senate", "ticket", "democratic", "republican", "governor", "vote", "ossoff", "warnock", "impeach", "nomination", "ballot", "candidate", "approval", "congress", "house", "primary",
    ],
    "econ": ["retail", "sales", "cpi", "inflation", "gdp", "rate", "fed", "fomc", "unemployment", "earnings", "jobs", "treasury", "recession"],
    "crypto": ["bitcoin", "btc", "ethereum", "eth", "crypto", "solana", "dogecoin", "ripple"],
}
ALIASES = {
    "usa": "united_states", "us": "united_states", "united states": "united_states", "uk": "united_kingdom", "britain": "united_kingdom", "great britain": "united_kingdom", "united kingdom": "united_kingdom",
    "uae": "united_arab_emirates", "south korea": "south_korea", "korea republic": "south_korea", "ivory coast": "cote_divoire", "cote d'ivoire": "cote_divoire",
    "bosnia": "bosnia_and_herzegovina", "bosnia and herzegovina": "bosnia_and_herzegovina", "new zealand": "new_zealand", "saudi arabia": "saudi_arabia", "dominican republic": "dominican_republic",
    "cape verde": "cape_verde", "trinidad and tobago": "trinidad_and_tobago", "turkiye": "turkey", "btc": "bitcoin", "xbt": "bitcoin", "eth": "ethereum", "sol": "solana", "doge": "dogecoin", "xrp": "ripple",
    "nyc": "new_york", "new york city": "new_york", "la": "los_angeles", "sf": "san_francisco", "san fran": "san_francisco", "washington dc": "washington", "vegas": "las_vegas", "nola": "new_orleans",
}
MORE_ENTITIES = [
    "brazil", "argentina", "germany", "spain", "japan", "uruguay", "morocco", "ecuador", "belgium", "netherlands", "norway", "england", "canada", "mexico", "panama", "tunisia", "algeria", "colombia",
    "paraguay", "austria", "croatia", "sweden", "haiti", "uzbekistan", "jordan", "ghana", "senegal", "egypt", "nigeria", "australia", "portugal", "france", "italy", "poland", "iran", "iraq", "china", "india",
    "russia", "ukraine", "switzerland", "scotland", "wales", "ireland", "chile", "peru", "bolivia", "venezuela", "honduras", "curacao", "jamaica", "qatar", "kuwait", "oman", "thailand", "vietnam", "indonesia",
    "malaysia", "philippines", "greece", "romania", "hungary", "czechia", "slovakia", "finland", "denmark", "iceland", "serbia",
    "boston", "chicago", "houston", "indiana", "detroit", "cleveland", "toronto", "atlanta", "baltimore", "pittsburgh", "tampa_bay", "denver", "seattle", "philadelphia", "minneapolis", "minnesota", "austin",
    "san_diego", "san_antonio", "miami", "columbus", "carolina", "phoenix", "dallas", "death_valley",
]
SUBJECT_SKIP = ["will", "the", "a", "an"]
SUBJECT_CONNECTORS = ["of", "and", "the", "de", "la", "le", "del"]
PREDICATE_SYNONYMS = {
    "beat": "win", "beats": "win", "defeat": "win", "defeats": "win", "wins": "win", "advancing": "advance", "advances": "advance", "quarterfinals": "quarterfinal", "semifinals": "semifinal", "finals": "final",
}
PREDICATES = [
    "win", "advance", "reach", "quarterfinal", "semifinal", "final", "unbeaten", "concede", "finish", "second", "third", "first", "group", "stage", "score", "scoring", "goal", "goals", "assist", "golden", "ball",
    "mvp", "champion", "championship", "playoff", "nominee", "nomination", "ballot", "candidate", "approval", "confirm", "confirmed", "elect", "elected", "impeach", "impeached", "cut", "hike", "raise", "lower", "pause",
    "hold",
]
# Marks of a market's group in its ticker, the first group with one counts.
TICKER_GROUPS = {
    "crypto": ["BTC", "ETH", "DOGE", "XRP", "SOL", "ADA", "LTC", "CRYPTO"],
    "sports": ["NBA", "MLB", "NFL", "NHL", "WC", "GAME", "SOCCER", "UFC", "TENNIS", "NCAA", "EPL", "NASCAR", "GOLF", "PGA"],
    "weather": ["HIGH", "LOW", "TEMP", "WEATHER", "RAIN", "SNOW"],
}
# Patterns of temperature thresholds, in words and in signs.
THRESHOLD_WORDS = r"(?i)(above|over|greater than|at least|below|under|less than)\s+(\d+(?:\.\d+)?)\s*(?:°|degrees?|f)\b"
THRESHOLD_SIGNS = r"(>=|≥|>|<=|≤|<)\s*(\d+(?:\.\d+)?)\s*°"

_ALIAS = r"\b(?:" + "|".join(re.escape(a) for a in sorted(ALIASES, key=len, reverse=True)).replace(r"\ ", " ") + r")\b"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def fold_aliases(text: Column) -> Column:
    """Each alias in a lower-case text replaced by its name, the leftmost and longest first.

    Between the pieces that the aliases part stand their names, so replaced text is never read again.
    """
    names = F.transform(F.regexp_extract_all(text, F.lit(_ALIAS), F.lit(0)), lambda a: F.element_at(_map(ALIASES), a))
    return F.array_join(F.zip_with(F.split(text, _ALIAS, -1), names, lambda piece, name: F.concat(piece, F.coalesce(name, F.lit("")))), "")


def normal(title: Column) -> Column:
    """Lower case, aliases folded, all but letters, digits, '.' and '_' as single spaces."""
    return F.trim(F.regexp_replace(let(F.lower(title), fold_aliases), "[^a-z0-9._]+", " "))


def words(title: Column) -> Column:
    return F.filter(F.array_sort(F.array_distinct(F.split(normal(title), " "))), lambda w: w != "")


def tokens(title: Column) -> Column:
    """The title's words as a set (sorted, distinct) without stop words."""
    return F.array_except(words(title), _strings(STOPWORDS))


def numbers(title: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))))


def entities(title_tokens: Column) -> Column:
    return F.array_sort(F.array_intersect(title_tokens, _strings(sorted({*ALIASES.values(), *MORE_ENTITIES}))))


def predicate(title_words: Column) -> Column:
    folded = F.transform(title_words, lambda w: F.coalesce(F.try_element_at(_map(PREDICATE_SYNONYMS), w), w))
    return F.array_sort(F.array_intersect(folded, _strings(PREDICATES)))


def category(title_words: Column) -> Column:
    """The first category with a word of its own in the title, else 'other'."""
    out = F.when(F.lit(False), F.lit(""))
    for name, keys in CATEGORIES.items():
        out = out.when(F.arrays_overlap(title_words, _strings(keys)), name)
    return out.otherwise("other")


def subject(title: Column) -> Column:
    """The words of the capitalised phrase that a title opens with, as a set; null if it opens with none.

    A fold over the words: leading articles are skipped, then capitalised words and connectors are
    taken until another word comes.
    """
    quote = r"^['\"]?\p{Lu}"
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("taken"))

    def step(acc: Column, w: Column) -> Column:
        upper = w.rlike(quote)
        state = (
            F.when((acc["state"] == 0) & F.lower(w).isin(SUBJECT_SKIP), 0).when((acc["state"] == 0) & upper, 1).when((acc["state"] == 1) & (upper | F.lower(w).isin(SUBJECT_CONNECTORS)), 1).otherwise(2)
        )
        return let(state, lambda s: F.struct(s.alias("state"), F.when(s == 1, F.concat(acc["taken"], F.array(w))).otherwise(acc["taken"]).alias("taken")))

    phrase = F.aggregate(F.regexp_extract_all(title, F.lit(r"(?U)[\w']+"), F.lit(0)), start, step, lambda acc: F.lower(F.array_join(acc["taken"], " ")))
    parts = let(phrase, lambda p: F.split(fold_aliases(p), r"(?U)[^\w]+"))
    kept = F.array_sort(F.array_distinct(F.array_except(parts, _strings([*STOPWORDS, ""]))))
    return let(kept, lambda k: F.when(F.size(k) > 0, k))


def threshold(title: Column) -> Column:
    """struct<direction, value> of a temperature threshold, in words before signs; null if there is none."""
    word, sign = F.lower(F.regexp_extract(title, THRESHOLD_WORDS, 1)), F.regexp_extract(title, THRESHOLD_SIGNS, 1)
    in_words = F.struct(F.when(word.isin("above", "over", "greater than", "at least"), "above").otherwise("below").alias("direction"), F.regexp_extract(title, THRESHOLD_WORDS, 2).try_cast("double").alias("value"))
    in_signs = F.struct(F.when(sign.isin(">", ">=", "≥"), "above").otherwise("below").alias("direction"), F.regexp_extract(title, THRESHOLD_SIGNS, 2).try_cast("double").alias("value"))
    return F.when(word != "", in_words).when(sign != "", in_signs)


def ticker_group(ticker: Column) -> Column:
    """The first group with one of its marks anywhere in the ticker, else 'other'; null stays 'other'."""
    out = F.when(F.lit(False), F.lit(""))
    for name, marks in TICKER_GROUPS.items():
        out = out.when(F.upper(ticker).rlike("|".join(marks)), name)
    return out.otherwise("other")


def about_temperature(title: Column) -> Column:
    return F.lower(title).rlike("temperature|temp|degrees|°")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How alike two texts are by matching blocks (Ratcliff and Obershelp), the first text being the one that is searched for. Null if either is null."""
    for a, b in pairs:
        yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def day_bonus(a: Column, b: Column) -> Column:
    """0.10 for dates at most a day apart, 0.05 for three, else 0."""
    apart = F.abs(F.datediff(a, b))
    return F.when(apart <= 1, 0.10).when(apart <= 3, 0.05).otherwise(0.0)
