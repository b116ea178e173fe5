"""Records of several sources that mean the same thing, matched without a common key.

Titles are read into parts (questions.read), mentions of entities are brought to one spelling by what
the data themselves say most often, and markets that agree in all parts become candidate pairs, with
lower odds also those of which one names no threshold or direction, and by their words those whose
titles can't be read. Loopy belief propagation with one-to-one factors then gives each pair its
marginal probability.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions import titles
from quotemill.llm import questions
from quotemill.session import Stored

PARTS = T.StructType([
    T.StructField("measure", T.StringType()), T.StructField("direction", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("y", T.IntegerType()), T.StructField("m", T.IntegerType()), T.StructField("d", T.IntegerType()), T.StructField("subject", T.StringType()), T.StructField("opponent", T.StringType()),
])
#: What kind of entity each measure's subject is.
KINDS = {"high": "place", "low": "place", "rain": "place", "approval": "place", "win": "team", "points": "person", "price": "asset", "release": "product"}
#: Kinds whose mentions are cut to the shortest common one inside ("Port Fennford Quarries" to "Quarries"); others keep the longest.
SHORTEST = ("team", "asset")
#: A mention is taken for a name if it stands alone in so many markets, and at least in this share of those of the most frequent name inside the same mention.
COMMON, SHARE = 3, 0.02
#: A word is taken for a misspelling of one that is so many times as frequent.
MISSPELT = 10
#: Markets close so many hours after their day began, usually.
CLOSING = 22
#: Belief propagation ends when no message changes by more.
SETTLED = 1e-3
#: Titles that can't be read are compared by their words: the least Jaccard similarity of a candidate, and the one that makes even odds.
ALIKE, EVEN = 0.75, 0.85


@F.pandas_udf(PARTS)
def _read(titles: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [f.name for f in PARTS.fields]
    for batch in titles:
        rows = []
        for title in batch:
            q = questions.read(title, None)
            y, m, d = (q["day"] or (None, None, None)) if q else (None, None, None)
            rows.append((q["measure"], q["direction"], q["threshold"], y, m, d, q["subject"], q["opponent"]) if q else (None,) * 8)
        out = pd.DataFrame(rows, columns=names)
        for c in ("direction", "y", "m", "d"):
            out[c] = out[c].astype("Int32")
        yield out


def _variants(word: Column) -> Column:
    """The word itself and all with one letter left out: two words within one edit share one of them."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def misspellings(words: DataFrame) -> DataFrame:
    """From kind, word, n: the words that are one edit off a MISSPELT times more frequent word of their kind, as kind, word, right.

    Candidates share a variant, so no word meets all others. Of several right words the most frequent
    is taken, then the first in order. Words of up to three letters stay.
    """
    keyed = words.filter(F.length("word") >= 4).select("kind", "word", "n", F.explode(_variants(F.col("word"))).alias("v"))
    right = keyed.filter(F.col("n") >= COMMON).select("kind", F.col("word").alias("right"), F.col("n").alias("times"), "v")
    near = keyed.join(right, ["kind", "v"]).filter((F.col("times") >= F.col("n") * MISSPELT) & (F.col("word") != F.col("right")))
    letters = lambda c: F.array_sort(F.split(c, ""))
    one_edit = (F.levenshtein("word", "right") <= 1) | ((F.length("word") == F.length("right")) & (F.levenshtein("word", "right") == 2) & (letters(F.col("word")) == letters(F.col("right"))))
    return near.filter(one_edit).groupBy("kind", "word").agg(F.max(F.struct("times", "right")).alias("b")).select("kind", "word", "b.right")


def entities(mentions: DataFrame, places: DataFrame) -> DataFrame:
    """The entity of each distinct mention: kind, text, entity, corrected (whether a word was misspelt).

    mentions: kind, text, a row for each time. places: code, name, a fixed list of places, which are
    always common. All joins run over distinct mentions and words.
    """
    texts = mentions.filter("text != ''").groupBy("kind", "text").agg(F.count("*").alias("n"))
    known = places.select(F.lit("place").alias("kind"), F.lower("name").alias("text"), F.lower("code").alias("code"))
    words = texts.select("kind", "n", F.explode(F.split("text", " ")).alias("word")).unionByName(known.select("kind", F.lit(10**9).cast("bigint").alias("n"), F.explode(F.split("text", " ")).alias("word")))
    fixes = misspellings(words.groupBy("kind", "word").agg(F.sum("n").alias("n")))
    spelt = texts.select("kind", "text", "n", F.posexplode(F.split("text", " ")).alias("i", "word")).join(fixes, ["kind", "word"], "left")
    spelt = spelt.groupBy("kind", "text", "n").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("right", "word").alias("w")))).alias("ws"), F.max(F.col("right").isNotNull()).alias("corrected"))
    spelt = Stored(spelt.select("kind", "text", "n", "corrected", F.transform("ws", lambda x: x["w"]).alias("ws"))).df
    common = spelt.groupBy("kind", F.concat_ws(" ", "ws").alias("part")).agg(F.sum("n").alias("times")).filter(F.col("times") >= COMMON).unionByName(known.select("kind", F.col("text").alias("part"), F.lit(10**9).cast("bigint").alias("times")))
    common = common.groupBy("kind", "part").agg(F.max("times").alias("times"))
    # Stretches of as many words as some name of the kind has, wherever they stand: numbers of words are few, and a row a kind.
    lengths = common.groupBy("kind").agg(F.collect_set(F.size(F.split("part", " "))).alias("lengths"))
    n, none = F.size("ws"), F.array().cast("array<string>")
    stretches = lambda k: F.when(k <= n, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("ws", i, k)))).otherwise(none)
    parts = F.coalesce(F.flatten(F.transform("lengths", stretches)), none)
    held = spelt.join(F.broadcast(lengths), "kind", "left").select("kind", "text", "corrected", F.concat_ws(" ", "ws").alias("whole"), F.explode_outer(F.array_distinct(parts)).alias("part")).join(common, ["kind", "part"], "left")
    count = F.size(F.split("part", " "))
    rank = F.struct(F.when(F.col("kind") == "place", F.col("times") >= 10**9).otherwise(F.lit(True)).alias("known"), F.when(F.col("kind").isin(*SHORTEST), -count).otherwise(count).alias("size"), F.length("part").alias("length"), "times", "part")
    named = held.groupBy("kind", "text", "corrected", "whole").agg(F.collect_list(F.when(F.col("times").isNotNull(), rank)).alias("hits"))  # those of one mention
    often = F.array_max(F.transform("hits", lambda x: x["times"])) * SHARE
    best = named.select("kind", "text", "corrected", "whole", F.array_max(F.filter("hits", lambda x: x["times"] >= often)).alias("b"))
    # People go by their last name: of a mention's words the one that most often comes last, so stray words
    # after it don't count. Which of several people is meant, first names and initials tell (see features).
    person = spelt.filter("kind = 'person'")
    last = person.groupBy(F.element_at("ws", -1).alias("word")).agg(F.sum("n").alias("times"))
    family = person.select("text", F.posexplode("ws").alias("i", "word")).join(last, "word").groupBy("text").agg(F.max(F.struct("times", "i", "word")).alias("f")).select(F.lit("person").alias("kind"), "text", F.col("f.word").alias("family"))
    found = best.join(family, ["kind", "text"], "left").select("kind", "text", "corrected", F.coalesce("family", "b.part", "whole").alias("entity"))
    # "Brillcoin (BRIL)" says that BRIL is short for Brillcoin; so do codes of places.
    two = spelt.filter((F.col("kind") == "asset") & (F.size("ws") == 2)).select("kind", F.col("ws")[1].alias("short"), F.col("ws")[0].alias("long"), "n").filter(F.col("long").startswith(F.col("short")))
    short = two.groupBy("kind", "short").agg(F.max(F.struct(F.col("n"), F.col("long"))).alias("b")).select("kind", "short", F.col("b.long").alias("long"))
    short = short.unionByName(known.groupBy("kind", F.col("code").alias("short")).agg(F.min("text").alias("long")))
    return found.join(short, (found["kind"] == short["kind"]) & (found["entity"] == short["short"]), "left").select(found["kind"], "text", F.coalesce("long", "entity").alias("entity"), "corrected")


def told(markets: DataFrame) -> DataFrame:
    """markets with q, what each title says (see questions.read; null for blank ones). Stored, so that each title is read once."""
    return Stored(markets.select("*", _read("title").alias("q"))).df


def dated(markets: DataFrame) -> DataFrame:
    """markets with q (see told) and days, the days that each may ask for: an array of struct day, certain; null for a title that asks nothing readable, and for a market without a day. Stored."""
    read = told(markets).withColumn("readable", F.coalesce(F.expr("q.measure != '' and q.subject != ''"), F.lit(False)))
    usual = F.timestamp_micros(F.col("close") - CLOSING * 3_600_000_000).cast("date")
    usual = F.when(F.col("whole_day"), F.date_sub(F.timestamp_micros("close").cast("date"), 1)).otherwise(usual)
    in_year = lambda y: F.try_make_timestamp(y, F.col("q.m"), F.col("q.d"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC")).cast("date")
    about = F.coalesce("hint_day", "usual")
    # The day in each year around; leap days are eight years apart at most.
    near = F.array_min(F.filter(F.transform(F.sequence(F.lit(-8), F.lit(8)), lambda i: F.struct(F.abs(F.date_diff(in_year(F.year(about) + i), about)).alias("off"), in_year(F.year(about) + i).alias("day"))), lambda x: x["day"].isNotNull()))
    open_ = (F.col("q.m") > 0) & F.col("q.y").isNull()
    named = F.when(open_, F.when(about.isNotNull(), near["day"])).when(F.col("q.m") > 0, in_year(F.col("q.y")))
    # A month that can't be read: the day of the month nearest to the usual one.
    around = F.filter(F.transform(F.sequence(F.lit(-15), F.lit(15)), lambda i: F.date_add(F.col("usual"), i)), lambda x: F.dayofmonth(x) == F.col("q.d"))
    certain = F.coalesce("named", "hint_day", F.when(F.col("q.m") == 0, F.get(around, F.lit(0))))
    one = lambda d, sure: F.struct(d.alias("day"), F.lit(sure).alias("certain"))
    guessed = F.when(F.col("whole_day"), F.array(one(F.col("usual"), False), one(F.date_add("usual", 1), False))).otherwise(F.array(one(F.col("usual"), False)))
    read = read.withColumn("usual", usual).withColumn("named", named)
    # One row; a leap year stands for all where no year is known at all.
    years = read.filter("readable").agg(F.array_sort(F.collect_set(F.year(F.coalesce("named", "hint_day", "usual")))).alias("y")).select(F.when(F.size("y") > 0, F.col("y")).otherwise(F.array(F.lit(2000))).alias("years"))
    any_year = F.filter(F.transform("years", lambda y: F.struct(in_year(y).alias("day"), (F.size("years") == 1).alias("certain"))), lambda x: x["day"].isNotNull())
    read = read.crossJoin(F.broadcast(years)).withColumn("certain", certain)
    days = F.when(F.col("certain").isNotNull(), F.array(one(F.col("certain"), True))).when(open_, F.when(F.size(any_year) > 0, any_year)).when(F.col("usual").isNotNull(), guessed)
    return Stored(read.select(*markets.columns, "q", F.when(F.col("readable"), days).alias("days"))).df


def features(markets: DataFrame, places: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """What each market asks: key, venue, kind, question (struct of measure, direction, threshold, subject, opponent), days (array of struct day, certain), close, corrected, initial (of a person's first name, '' if none is given).

    markets: key, venue, title, close (microseconds or null), whole_day (whether close only names a
    day), hint_day (date), hint_direction, hint_threshold, which fill what a title leaves out. Titles
    that ask nothing readable, and markets without a day, are left out. A day named without a year is
    the one nearest to hint_day, else to the usual day before close; with neither it may be of any year
    that the data know (certain, if that is one only). read is dated(markets), if it is there already.
    """
    read = (dated(markets) if read is None else read).filter("days is not null")
    kind = F.coalesce(*[F.when(F.col("q.measure") == m, k) for m, k in KINDS.items()], F.lit("other"))
    measured = ~kind.isin("team", "product")  # who wins and what comes out have no threshold, whatever a ticker says
    read = Stored(read.select("key", "venue", "close", "days", kind.alias("kind"), "q", F.coalesce(F.nullif("q.direction", F.lit(0)), F.when(measured, F.col("hint_direction")), F.lit(0)).alias("direction"), F.coalesce("q.threshold", F.when(measured, F.col("hint_threshold"))).alias("threshold"))).df
    said = read.select("kind", F.explode(F.array("q.subject", "q.opponent")).alias("text"))
    names = Stored(entities(said, places)).df
    left = names.select("kind", F.col("text").alias("st"), F.col("entity").alias("subject"), F.col("corrected").alias("c1"))
    right = names.select("kind", F.col("text").alias("ot"), F.col("entity").alias("opponent"), F.col("corrected").alias("c2"))
    read = read.withColumns({"st": F.col("q.subject"), "ot": F.col("q.opponent")}).join(left, ["kind", "st"], "left").join(right, ["kind", "ot"], "left")
    asked = F.struct(F.col("q.measure").alias("measure"), "direction", F.round("threshold", 4).alias("threshold"), F.coalesce("subject", "st").alias("subject"), F.coalesce("opponent", "ot").alias("opponent"))
    initial = F.when((F.col("kind") == "person") & F.col("st").contains(" ") & ~F.col("st").startswith(F.coalesce("subject", "st")), F.substring("st", 1, 1)).otherwise("")
    return read.select("key", "venue", "kind", asked.alias("question"), initial.alias("initial"), "days", "close", (F.coalesce("c1", F.lit(False)) | F.coalesce("c2", F.lit(False))).alias("corrected"))


def candidates(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of markets of different venues that agree in all parts, with their odds: a, b, va, vb, w; and the markets that stand behind an end, itself among them: key, stands_for.

    Where a title that should name a threshold or a direction doesn't, it is a candidate for those of the
    same subject, measure and day that agree in what it names, at lower odds: which of several it is,
    if any, the propagation tells.

    Markets of a venue that ask the same for the same days form a class with one representative, so
    propagation meets a question asked by a third of all rows in a few pairs, not in its square.
    """
    # A question's text takes part in joins as one string.
    text = F.concat_ws("|", F.col("question.measure"), F.col("question.direction").cast("string"), F.coalesce(F.col("question.threshold").cast("string"), F.lit("")), "question.subject", "question.opponent")
    measured = ~F.col("kind").isin("team", "product")
    gaps = [(measured & F.col("question.threshold").isNull()).alias("no_threshold"), (measured & (F.col("question.direction") == 0)).alias("no_direction")]
    about = F.concat_ws("|", "question.measure", "question.subject", "question.opponent").alias("about")
    rows = asked.select("key", "venue", text.alias("text"), "initial", "days", "close", "corrected", about, F.col("question.threshold").alias("threshold"), F.col("question.direction").alias("direction"), *gaps)
    parts = ("about", "threshold", "direction", "no_threshold", "no_direction")
    classes = rows.groupBy("venue", "text", "initial", "days").agg(F.min("key").alias("key"), F.min_by("close", "key").alias("close"), F.min("corrected").alias("corrected"), *[F.first(c).alias(c) for c in parts])  # equal in a class
    behind = rows.join(classes.select("venue", "text", "initial", "days", F.col("key").alias("stands_for")), ["venue", "text", "initial", "days"]).select("key", "stands_for")
    # Classes of one question, venue and certain day are few: certain or guessed, with a close or without.
    spread = classes.select("key", "venue", "text", "initial", "close", "corrected", *parts, F.size("days").alias("choices"), F.inline("days"))
    side = lambda df, s, *keep: df.select("day", *keep, *[F.col(c).alias(c + s) for c in ("key", "venue", "initial", "close", "corrected", "choices", "certain")])
    initials = "(initial_a = '' or initial_b = '' or initial_a = initial_b)"
    pairs = side(spread, "_a", "text").join(side(spread, "_b", "text"), ["text", "day"]).filter(f"venue_a < venue_b and {initials}").withColumn("gap", F.lit(0.0)).drop("text")
    open_ = spread.filter("no_threshold or no_direction")
    if not open_.isEmpty():
        left, right = (side(df, s, "about", *[F.col(c).alias(c + s) for c in parts[1:]]) for df, s in ((open_, "_a"), (spread, "_b")))
        fits = "(no_threshold_a or no_threshold_b or threshold_a <=> threshold_b) and (no_direction_a or no_direction_b or direction_a = direction_b) and not (threshold_a <=> threshold_b and direction_a = direction_b)"
        more = left.join(right, ["about", "day"]).filter(f"venue_a != venue_b and {initials} and {fits}").withColumn("gap", F.lit(-2.5))
        pairs = pairs.unionByName(more.select(pairs.columns))
    apart = F.abs(F.col("close_a") - F.col("close_b")) / 3_600_000_000
    guess = lambda s: F.when(F.col("certain" + s), 0.0).when(F.col("choices" + s) > 1, -1.5).otherwise(-0.5)
    score = 3.0 + F.col("gap") + guess("_a") + guess("_b") + F.when(apart <= 12, 1.0).when(apart <= 36, 0.0).when(apart.isNull(), 0.0).otherwise(-0.5) + F.when(F.col("corrected_a"), -0.3).otherwise(0.0) + F.when(F.col("corrected_b"), -0.3).otherwise(0.0)
    return _edges(pairs.withColumn("w", F.exp(score))), behind


def _edges(pairs: DataFrame) -> DataFrame:
    """Pairs (key_a, key_b, venue_a, venue_b, w) with the venues in order, each pair once with its highest odds: a, b, va, vb, w."""
    turned = F.col("venue_a") > F.col("venue_b")
    ends = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(n) for n, x, y in (("a", "key_a", "key_b"), ("b", "key_b", "key_a"), ("va", "venue_a", "venue_b"), ("vb", "venue_b", "venue_a"))]
    return pairs.select(*ends, "w").groupBy("a", "b", "va", "vb").agg(F.max("w").alias("w"))


def by_words(unread: DataFrame, markets: DataFrame) -> DataFrame:
    """Candidates for markets whose titles or days can't be read, by the words of their titles: a, b, va, vb, w.

    unread and markets: key, venue, title, close. A market of another venue is a candidate if the two
    titles' word sets have a Jaccard similarity of ALIKE or more and their closing times, where both are
    known, are at most a day and a half apart. Words stand in one order for all, the longest first, as
    those are seldom common; of n words the first n - ceil(ALIKE * n) + 1 are a title's prefix, and two
    titles that are alike enough share a word of their prefixes, so only those meet.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"(?U)[\w.']+"), F.lit(0)))
    said = lambda df: df.select("key", "venue", "close", words.alias("ws")).filter(F.size("ws") > 0)
    mine, every = said(unread), said(markets)
    n = F.size("ws")
    first = F.slice(F.array_sort(F.transform("ws", lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), F.lit(1), n - F.ceil(n * ALIKE - 1e-9).cast("int") + 1)
    prefix = lambda df, key, size: df.select(F.col("key").alias(key), n.alias(size), F.explode(first).alias("x")).select(key, size, F.col("x.w").alias("t"))
    met = prefix(mine, "key", "n").join(prefix(every, "other", "m"), "t").filter((F.col("m") >= F.col("n") * ALIKE - 1e-9) & (F.col("n") >= F.col("m") * ALIKE - 1e-9)).select("key", "other").distinct()
    left, right = (df.select(*[F.col(c).alias(c + s) for c in ("key", "venue", "close", "ws")]) for df, s in ((mine, "_a"), (every, "_b")))
    pairs = met.select(F.col("key").alias("key_a"), F.col("other").alias("key_b")).join(left, "key_a").join(right, "key_b").filter("venue_a != venue_b")
    alike, apart = titles.jaccard(F.col("ws_a"), F.col("ws_b")), F.abs(F.col("close_a") - F.col("close_b")) / 3_600_000_000
    scored = pairs.select("key_a", "key_b", "venue_a", "venue_b", alike.alias("j"), apart.alias("apart")).filter((F.col("j") >= ALIKE) & (F.coalesce("apart", F.lit(0.0)) <= 36))
    return _edges(scored.withColumn("w", F.exp((F.col("j") - EVEN) * 8)))


def propagate(edges: DataFrame) -> DataFrame:
    """The marginal probability of each candidate pair under 'a market has at most one partner in each other venue': a, b, va, vb, p.

    Sum-product messages of the matching factor: what a sends over an edge is the edge's odds over one
    plus all that a's other edges to the same venue send in. Pairs without a rival have their answer
    in closed form; the others exchange messages through joins, the sums being map-side reduced
    aggregates by market and venue, until no message changes by SETTLED. Markets of two venues are a
    bipartite graph of their own, for which these messages converge (Vontobel, 2013), so there is no
    last round. Every round is written to the shared folder.
    """
    rivals = F.count("*").over(Window.partitionBy("a", "vb")) + F.count("*").over(Window.partitionBy("b", "va"))
    counted = Stored(edges.withColumn("rivals", rivals)).df
    alone = counted.filter("rivals = 2").select("a", "b", "va", "vb", (F.col("w") / (1 + F.col("w"))).alias("p"))
    state = Stored(counted.filter("rivals > 2").select("a", "b", "va", "vb", "w", F.col("w").alias("to_b"), F.col("w").alias("to_a"), F.lit(1.0).alias("change")))
    if state.df.isEmpty():
        return alone
    for _ in itertools.count():
        at_a = state.df.groupBy("a", "vb").agg(F.sum("to_a").alias("into_a"))
        at_b = state.df.groupBy("b", "va").agg(F.sum("to_b").alias("into_b"))
        sent = state.df.join(at_a, ["a", "vb"]).join(at_b, ["b", "va"])
        # Half the step, so that rounds don't swing.
        new_b = (F.col("w") / (1 + F.greatest(F.col("into_a") - F.col("to_a"), F.lit(0.0))) + F.col("to_b")) / 2
        new_a = (F.col("w") / (1 + F.greatest(F.col("into_b") - F.col("to_b"), F.lit(0.0))) + F.col("to_a")) / 2
        change = F.greatest(F.abs(new_b - F.col("to_b")) / (1 + F.col("to_b")), F.abs(new_a - F.col("to_a")) / (1 + F.col("to_a")))
        after = Stored(sent.select("a", "b", "va", "vb", "w", new_b.alias("to_b"), new_a.alias("to_a"), change.alias("change")))
        state.drop()
        state = after
        if state.df.agg(F.max("change")).first()[0] < SETTLED:
            break
    both = F.col("to_a") * F.col("to_b")
    return alone.unionByName(state.df.select("a", "b", "va", "vb", (both / (F.col("w") + both)).alias("p")))


def match(markets: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs of markets of different venues with the probability that they ask the same: a, b (by key), confidence.

    See features for the input. Each member of a class is paired with each of the other side's, since
    all of them ask the same: what comes out is the square of a question that both venues repeat. Titles
    that can't be read, and markets without a day, are matched by their words. Empty tables and null or
    blank titles give no pairs.
    """
    read = dated(markets)
    edges, behind = candidates(Stored(features(markets, places, read)).df)
    titled = read.select("key", "venue", "title", "close", F.col("days").isNull().alias("unread")).filter(F.trim("title") != "")
    unread = titled.filter("unread")
    if not unread.isEmpty():
        edges = edges.unionByName(by_words(unread, titled)).groupBy("a", "b", "va", "vb").agg(F.max("w").alias("w"))
    found = propagate(edges).select("a", "b", F.col("p").alias("confidence"))
    ends = [behind.select(F.col("key").alias(f"{c}_key"), F.col("stands_for").alias(c)) for c in ("a", "b")]
    # An end that no class stands behind is one market that was matched by its words.
    every = found.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a_key", "a").alias("a"), F.coalesce("b_key", "b").alias("b"), "confidence")
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence").groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
