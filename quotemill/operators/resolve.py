"""Markets of different venues matched into events by what their titles say: features, candidate pairs, guards, overrides, events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions import titles
from quotemill.operators import graph, similarity
from quotemill.session import Stored

# Bars of confidence for a match, how far below a pair is kept for review, and the bar for titles that name nothing.
THRESHOLD, REVIEW, GENERIC = 0.60, 0.12, 0.92


def features(markets: DataFrame, title: str = "title") -> DataFrame:
    """markets with tokens, numbers, subject, entities, predicate and category of their title. Null and empty titles are left out."""
    rows = markets.filter(F.length(title) > 0).withColumns({"_words": titles.words(F.col(title)), "numbers": titles.numbers(F.col(title)), "subject": titles.subject(F.col(title))})
    rows = rows.withColumns({"tokens": titles.tokens(F.col(title)), "predicate": titles.predicate(F.col("_words")), "category": titles.category(F.col("_words"))})
    return rows.withColumn("entities", titles.entities(F.col("tokens"))).drop("_words")


def candidates(markets: DataFrame, key: str) -> DataFrame:
    """Pairs that can be a match, by the guards themselves: a, b (a < b).

    Both in one category with the same entities, and one of: they share entities; both name a subject
    and one's rarest subject word is among the other's; or one names nothing, for which only a token
    similarity of 0.64 can reach the bar of GENERIC. No other pair can pass, so no block is compared
    with itself as a whole unless its titles share all their entities.
    """
    block = F.concat_ws("|", "category", F.array_join("entities", ","))
    rows = Stored(markets.select(F.col(key).alias("k"), block.alias("block"), "tokens", "subject", (F.size("entities") > 0).alias("named"), "numbers")).df
    ends = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b")
    numbered = F.array_join("numbers", ",").alias("n")

    def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """Pairs that agree in `on` and whose numbers don't contradict each other: the same, or none on one side."""
        x, y = left.withColumnRenamed("k", "a"), right.withColumnRenamed("k", "b")
        same = x.join(y, [*on, "n"]).select("a", "b")
        bare = x.filter("n = ''").join(y.filter("n != ''").drop("n"), on).select("a", "b")
        return same.unionByName(bare).unionByName(x.filter("n != ''").drop("n").join(y.filter("n = ''"), on).select("a", "b"))

    named = rows.filter("named").select("k", "block", numbered)
    same = meet(named, named, ["block"])
    word = rows.filter("not named and subject is not null").select("k", "block", numbered, F.explode("subject").alias("w"))
    often = word.groupBy("block", "w").agg(F.count("*").alias("f"))
    rarest = word.join(often, ["block", "w"]).groupBy("k", "block", "n").agg(F.min(F.struct("f", "w")).alias("r")).select("k", "block", "n", F.col("r.w").alias("w"))
    told = meet(rarest, word, ["block", "w"])
    classes, members = similarity.set_classes(rows.filter("not named"), "k", "tokens", ["block"])
    near = similarity.similar_classes(classes, 2 * (GENERIC - 0.10) - 1, ["block"]).select("a", "b").unionByName(classes.select(F.col("class_id").alias("a"), F.col("class_id").alias("b")))
    left, right = (members.select(F.col("k").alias(f"k{s}"), F.col("class_id").alias(s)) for s in ("a", "b"))
    alike = near.join(left, "a").join(right, "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    return ends(same.unionByName(told).unionByName(alike)).distinct()


def score(pairs: DataFrame, markets: DataFrame, key: str, close: str) -> DataFrame:
    """pairs with similarity, date_bonus, confidence and decision ('match' or 'no-match').

    similarity is half token Jaccard, half sequence ratio of the sorted tokens, the smaller key first.
    A pair matches at THRESHOLD (GENERIC if one side names neither entity nor subject) unless its
    numbers, subjects or predicates contradict each other; pairs further than REVIEW below are dropped.
    The ratio, the one step in Python, runs last and only where its upper bound 1 can still matter.
    """
    parts = ["tokens", "numbers", "subject", "entities", "predicate", "category", close, "title"]
    side = lambda s: markets.select(F.col(key).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in parts])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    within = lambda x, y: F.size(F.array_except(x, y)) == 0
    sa, sb = F.col("subject_a"), F.col("subject_b")
    fits = lambda c: (F.size(f"{c}_a") == 0) | (F.size(f"{c}_b") == 0) | (F.col(f"{c}_a") == F.col(f"{c}_b"))
    names = sa.isNull() | sb.isNull() | within(sa, sb) | within(sb, sa)
    generic = ((F.size("entities_a") == 0) & sa.isNull()) | ((F.size("entities_b") == 0) & sb.isNull())
    both = both.withColumns({"_j": titles.jaccard(F.col("tokens_a"), F.col("tokens_b")), "date_bonus": titles.day_bonus(F.col(f"{close}_a"), F.col(f"{close}_b")), "_ok": fits("numbers") & fits("predicate") & names, "_bar": F.when(generic, GENERIC).otherwise(THRESHOLD)})
    both = both.filter(F.col("_j") * 0.5 + 0.5 + F.col("date_bonus") >= THRESHOLD - REVIEW)
    ratio = titles.sequence_ratio(F.array_join("tokens_a", " "), F.array_join("tokens_b", " "))
    both = both.withColumn("_r", ratio).withColumn("similarity", F.col("_j") * 0.5 + F.col("_r") * 0.5)
    both = both.withColumn("confidence", F.least(F.lit(1.0), F.col("similarity") + F.col("date_bonus")))
    out = both.withColumn("decision", F.when(F.col("_ok") & (F.col("confidence") >= F.col("_bar")), "match").otherwise("no-match"))
    return out.filter((F.col("decision") == "match") | (F.col("confidence") >= THRESHOLD - REVIEW)).select("a", "b", "title_a", "title_b", F.col("category_a").alias("category"), F.round("similarity", 4).alias("similarity"), "date_bonus", F.round("confidence", 4).alias("confidence"), F.lit("fuzzy").alias("method"), "decision")


def overrule(scored: DataFrame, overrides: DataFrame, markets: DataFrame, key: str) -> DataFrame:
    """scored with manual decisions put in: overrides has a, b and relation ('match' or 'block').

    A decision wins over the score and also holds for pairs that were never candidates, if both
    markets are known; match decisions have confidence 1.
    """
    known = markets.select(F.col(key).alias("k"))
    o = overrides.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.trim(F.lower("relation")).alias("relation")).filter("a != b and relation in ('match', 'block')")
    o = o.join(known.withColumnRenamed("k", "a"), "a", "left_semi").join(known.withColumnRenamed("k", "b"), "b", "left_semi").groupBy("a", "b").agg(F.min("relation").alias("relation"))
    joined = scored.join(o, ["a", "b"], "full")
    match, manual = F.col("relation") == "match", F.col("relation").isNotNull()
    return joined.withColumns({"confidence": F.when(match, 1.0).otherwise(F.col("confidence")), "decision": F.when(match, "manual-match").when(manual, "manual-block").otherwise(F.col("decision")), "method": F.when(manual, "manual").otherwise(F.col("method"))}).drop("relation")


def fold(told: DataFrame, key: str, close: str, apart: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Markets that are the same to score (tokens, numbers, subject, predicate, closing day), as classes: (the rows of their representatives, each class's smallest key; copies: rep, key of the others; None if there are none).

    Copies match each other with full confidence and everything else as their representative does, so
    only representatives meet and copies follow as one link each: a title of a third of all markets
    costs a row a market, not their square. Titles without tokens, and keys in apart, stand for themselves.
    """
    parts = F.concat_ws("\x1e", *[F.coalesce(F.array_join(c, "\x1f"), F.lit("\x1d")) for c in ("tokens", "numbers", "subject", "predicate")], F.coalesce(F.col(close).cast("string"), F.lit("")))
    rows = told.filter(F.size("tokens") > 0).select(F.col(key).alias("key"), parts.alias("_same"))
    if apart is not None:
        rows = rows.join(apart.select(F.col(key).alias("key")), "key", "left_anti")
    copies = rows.join(rows.groupBy("_same").agg(F.min("key").alias("rep")), "_same").filter("key != rep").select("rep", "key")
    copies = Stored(copies).df
    if copies.isEmpty():
        return told, None
    return Stored(told.join(copies.select(F.col("key").alias(key)), key, "left_anti")).df, copies


@dataclass
class Resolution:
    """event_map (key, event_id, canonical_title, match_method, match_confidence), candidate_pairs, and flagged (pairs for review)."""

    event_map: DataFrame
    candidate_pairs: DataFrame
    flagged: DataFrame


def resolve(markets: DataFrame, key: str = "key", close: str = "close_ts", overrides: DataFrame | None = None) -> Resolution:
    """Markets (key, title, close) grouped into events by matching pairs and what links them through others.

    Every market gets an event; one without a match is an event of its own, method 'singleton'. An
    event's title is its longest, the first key's of equal ones. A market's confidence and method are
    those of its best matching pair. candidate_pairs holds pairs of representatives (see fold), and each
    copy with its representative.
    """
    told = Stored(features(markets.select(F.col(key).alias("key"), "title", F.col(close).cast("date").alias("close")))).df
    named = None if overrides is None else overrides.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    alone, copies = fold(told, "key", "close", named)
    pairs = score(candidates(alone, "key"), alone, "key", "close")
    if copies is not None:
        ends = [told.select(F.col("key").alias(k), F.col("title").alias(f"title_{k}"), *more) for k, more in (("a", ["category"]), ("b", []))]
        bonus = F.when(F.col("close").isNull(), 0.0).otherwise(0.10)
        twins = copies.select(F.col("rep").alias("a"), F.col("key").alias("b")).join(ends[0], "a").join(ends[1], "b").join(told.select(F.col("key").alias("b"), bonus.alias("date_bonus")), "b")
        pairs = pairs.unionByName(twins.select("a", "b", "title_a", "title_b", "category", F.lit(1.0).alias("similarity"), "date_bonus", F.lit(1.0).alias("confidence"), F.lit("fuzzy").alias("method"), F.lit("match").alias("decision")))
    if overrides is not None:
        pairs = overrule(pairs, overrides, told, "key")
    pairs = Stored(pairs).df
    links = pairs.filter("decision in ('match', 'manual-match')")
    found = graph.labels(links)
    nodes = told.select("key", "title").join(found, F.col("key") == F.col("node"), "left").select("key", "title", F.coalesce("label", "key").alias("label"))
    ids = graph.group_ids(nodes, "label", "key")
    # Longest first; a key that comes first in order wins a tie, so the order is turned round by rank of its text.
    longest = nodes.groupBy("label").agg(F.max(F.length("title")).alias("l")).join(nodes, "label").filter(F.length("title") == F.col("l")).groupBy("label").agg(F.min_by("title", "key").alias("canonical_title"))
    scored = links.select(F.col("a").alias("key"), "confidence", "method").unionByName(links.select(F.col("b").alias("key"), "confidence", "method"))
    best = scored.groupBy("key").agg(F.max(F.struct("confidence", "method")).alias("m"))
    events = nodes.join(ids, "label").join(longest, "label").join(best, "key", "left").select("key", "title", F.col("group_id").alias("event_id"), "canonical_title", F.coalesce("m.method", F.lit("singleton")).alias("match_method"), F.col("m.confidence").alias("match_confidence"))
    return Resolution(events, pairs, pairs.filter("decision = 'no-match'"))
