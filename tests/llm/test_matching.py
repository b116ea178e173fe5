"""Reading questions, entities and belief propagation."""

import itertools
import math

import pytest
from quotemill.llm import matching, questions

DAY = (2021, 3, 17)


@pytest.mark.parametrize(
    "title,measure,direction,threshold,day,subject,opponent",
    [
        ("Will the high temperature in Wylcross city be below 68.5F on Mar 17?", "high", -1, 68.5, DAY, "wylcross", ""),
        ("[NEW] WYS low temp > 83 degrees Mar 17 2021?", "low", 1, 83.0, DAY, "wys", ""),
        ("Pt. Lornaby: daily high over 90°F on Wed, March 17", "high", 1, 90.0, DAY, "port lornaby", ""),
        ('Rain total in Elshaven over 0.8" (3/17/21)?', "rain", 1, 0.8, DAY, "elshaven", ""),
        ("Ostby rainfall > 1.1 in on 17 March", "rain", 1, 1.1, DAY, "ostby", ""),
        ("Mayor of Ostholt: approval over 26.5% on March 17, 2021?", "approval", 1, 26.5, DAY, "ostholt", ""),
        ("D. Nesserin: 20+ points on 2021-03-17", "points", 1, 20.0, DAY, "d nesserin", ""),
        ("Will Brenno Stroane score at least 44 points (3/17/21)?", "points", 1, 44.0, DAY, "brenno stroane", ""),
        ("Brillcoin (BRIL) price > $13.95k on 17 March", "price", 1, 13950.0, DAY, "brillcoin bril", ""),
        ("Will Quilvant Corp close less than $1,430 Mar 17 2021?", "price", -1, 1430.0, DAY, "quilvant", ""),
        ("JETT over $26,550 on 17 March?", "price", 1, 26550.0, DAY, "jett", ""),
        ("Will the Ospreys beat the Port Fennford Quarries on Mar 17?", "win", 0, None, DAY, "ospreys", "port fennford quarries"),
        ("Ospreys to win vs Quarries Mar 17 2021", "win", 0, None, DAY, "ospreys", "quarries"),
        ("on Wed, March 17: do Ospreys win against Quarries?", "win", 0, None, DAY, "ospreys", "quarries"),
        ("Ospreys over Quarries", "win", 0, None, None, "ospreys", "quarries"),
        ("Will Sarora ship the Slate 7 handset by Mar 17?", "release", 0, None, DAY, "sarora slate 7 handset", ""),
        ("Sarora Slate 7 handset released before end of 3/17/21", "release", 0, None, DAY, "sarora slate 7 handset", ""),
        ("Sorraby: daily loow udner 71° on Mra 17", "low", -1, 71.0, DAY, "sorraby loow", ""),  # entities() drops words that are no part of a place
    ],
)
def test_titles_say(title, measure, direction, threshold, day, subject, opponent):
    q = questions.read(title)
    assert (q["measure"], q["direction"], q["threshold"], q["day"], q["subject"], q["opponent"]) == (measure, direction, threshold, day, subject, opponent)


@pytest.mark.parametrize("title", ["", "  ", None])
def test_blank_titles_say_nothing(title):
    assert questions.read(title) is None


def test_odd_titles_do_not_break():
    for title in ("?", "12", "over", "win", "a" * 20_000, "🤷 " * 50, "Will the over on Mar 99?"):
        questions.read(title)


SCHEMA = "key string, venue string, title string, close long, whole_day boolean, hint_day date, hint_direction int, hint_threshold double"


def test_tickers_fill_only_what_a_question_has(spark):
    rows = [("a:1", "a", "Ospreys over Quarries on Mar 17", CLOSE, False, None, 1, 0.0), ("b:1", "b", "Ospreys to win vs Quarries Mar 17 2021", CLOSE, False, None, None, None), ("a:2", "a", "WYS high temp ?", CLOSE, False, None, -1, 68.5), ("b:2", "b", "WYS high temp < 68.5° on Mar 17?", CLOSE, False, None, None, None)]
    got = {(r["a"], r["b"]) for r in matching.match(spark.createDataFrame(rows, SCHEMA), _places(spark)).collect()}
    assert got == {("a:1", "b:1"), ("a:2", "b:2")}


def _markets(spark, rows):
    return spark.createDataFrame([(k, k.split(":")[0], t, c, False, None, None, None) for k, t, c in rows], SCHEMA)


CLOSE = 1616025540000000  # 2021-03-17 23:59 UTC


def _places(spark):
    return spark.createDataFrame([("WYS", "Wylcross"), ("ELN", "Elshaven")], "code string, name string")


def _pairs(spark, rows):
    return {(r["a"], r["b"]): r["confidence"] for r in matching.match(_markets(spark, rows), _places(spark)).collect()}


def test_same_question_in_other_words(spark):
    common = [(f"x:{i}", f"Ospreys to win vs Quarries on Apr {i + 1}", None) for i in range(8)] + [(f"x:q{i}", f"Quarries over Ospreys on Apr {i + 1}", None) for i in range(8)]
    rows = common + [
        ("a:1", "Will the high temperature in Wylcross be below 68.5F on Mar 17?", CLOSE), ("b:1", "WYS high temp < 68.5° ?", CLOSE + 3_600_000_000), ("c:1", "Wylcros: daily high under 68.5 degrees on 2021-03-17", CLOSE),
        ("b:2", "WYS low temp < 68.5° on Mar 17?", CLOSE), ("c:2", "Wylcross: daily high over 68.5 degrees on 2021-03-17", CLOSE), ("b:3", "WYS high temp < 69.5° on Mar 17?", CLOSE), ("c:3", "Wylcross: daily high under 68.5 on 2021-03-18", CLOSE),
        ("a:5", "Will the Port Fennford Ospreys beat the Quarries on Mar 17?", CLOSE), ("b:5", "Ospreys over Quarries Mar 17 2021", None), ("c:5", "Quarries over Ospreys Mar 17 2021", None),
        ("a:7", "Will Brenno Stroaby score at least 12 points on Mar 17?", CLOSE), ("b:7", "B. Stroaby: 12+ points on 17 March", CLOSE), ("c:7", "T. Stroaby: 12+ points on 17 March", CLOSE),
        ("a:6", None, CLOSE), ("b:6", "", CLOSE), ("c:6", "No question here", CLOSE),
    ]
    # Mentions that only few markets make keep their own spelling; "Wylcros" is one letter off a place.
    found = _pairs(spark, rows)
    assert {p for p, c in found.items() if c >= 0.5} == {("a:1", "b:1"), ("a:1", "c:1"), ("b:1", "c:1"), ("a:5", "b:5"), ("a:7", "b:7")}


def test_one_partner_in_each_venue_and_copies(spark):
    rows = [("a:1", "WYS high temp < 60° on Mar 17?", CLOSE)] + [(f"b:{i:03}", "WYS high temp < 60° on Mar 17?", CLOSE) for i in range(40)]
    found = _pairs(spark, rows)
    assert len(found) == 40  # a star, not the square of a hot question
    assert _pairs(spark, []) == {}


def _exact(edges):
    """Marginals by listing all matchings in which a node has one partner a venue."""
    total, mass = 0.0, dict.fromkeys(range(len(edges)), 0.0)
    for chosen in itertools.chain.from_iterable(itertools.combinations(range(len(edges)), k) for k in range(len(edges) + 1)):
        used = [(edges[i][0], edges[i][3]) for i in chosen] + [(edges[i][1], edges[i][2]) for i in chosen]
        if len(set(used)) == len(used):
            w = math.prod(edges[i][4] for i in chosen)
            total += w
            for i in chosen:
                mass[i] += w
    return {(edges[i][0], edges[i][1]): m / total for i, m in mass.items()}


def test_propagation_is_exact_on_trees(spark):
    edges = [("a1", "b1", "a", "b", 20.0), ("a1", "b2", "a", "b", 4.0), ("a2", "b2", "a", "b", 3.0), ("a2", "c1", "a", "c", 2.0), ("a3", "c1", "a", "c", 5.0), ("a9", "b9", "a", "b", 9.0)]
    df = spark.createDataFrame(edges, "a string, b string, va string, vb string, w double")
    got = {(r["a"], r["b"]): r["p"] for r in matching.propagate(df).collect()}
    for pair, p in _exact(edges).items():
        assert got[pair] == pytest.approx(p, abs=5e-3)


def test_propagation_settles_on_loops(spark):
    edges = [(f"a{i}", f"b{j}", "a", "b", 9.0 if i == j else 2.0) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(edges, "a string, b string, va string, vb string, w double")
    got = {(r["a"], r["b"]): r["p"] for r in matching.propagate(df).collect()}
    for pair, p in _exact(edges).items():
        assert got[pair] == pytest.approx(p, abs=0.08)


def test_misspelt_words(spark):
    rows = [("team", w, n) for w, n in [("ospreys", 90), ("ospresy", 2), ("osprey", 1), ("opsreys", 1), ("ospxxys", 1), ("larks", 50), ("lark", 40), ("abc", 99), ("abd", 1)]]
    got = {r["word"]: r["right"] for r in matching.misspellings(spark.createDataFrame(rows, "kind string, word string, n long")).collect()}
    assert got == {"ospresy": "ospreys", "osprey": "ospreys", "opsreys": "ospreys"}


def test_entities(spark):
    said = [("team", "port fennford quarries")] * 4 + [("team", "quarries")] * 5 + [("asset", "brillcoin bril")] * 3 + [("asset", "brillcoin")] * 3 + [("asset", "bril")] + [("place", "wys"), ("place", "wylcorss"), ("place", "ni wylcross"), ("person", "d nesserin"), ("person", "nesserin mor")] + [("person", "nesserin")] * 3
    got = {r["text"]: r["entity"] for r in matching.entities(spark.createDataFrame(said, "kind string, text string"), _places(spark)).collect()}
    assert got == {"port fennford quarries": "quarries", "quarries": "quarries", "brillcoin bril": "brillcoin", "brillcoin": "brillcoin", "bril": "brillcoin", "wys": "wylcross", "wylcorss": "wylcross", "ni wylcross": "wylcross", "d nesserin": "nesserin", "nesserin mor": "nesserin", "nesserin": "nesserin"}


def test_days_without_a_year_take_that_of_their_close(spark):
    year = 365 * 86_400_000_000
    rows = [("a:1", "WYS high temp < 60° on Mar 17?", CLOSE), ("a:2", "WYS high temp < 60° on Mar 17?", CLOSE + year), ("b:1", "WYS high temp < 60° on 2021-03-17?", CLOSE), ("b:2", "WYS high temp < 60° on 2022-03-17?", CLOSE + year)]
    found = _pairs(spark, rows)
    assert {p for p, c in found.items() if c >= 0.5} == {("a:1", "b:1"), ("a:2", "b:2")}
    # At the turn of the year the nearest day counts, not the year of the close.
    turn = CLOSE + 290 * 86_400_000_000  # 2022-01-01 23:59 UTC
    assert set(_pairs(spark, [("a:1", "WYS high temp < 60° on Dec 31?", turn), ("b:1", "WYS high temp < 60° on 2021-12-31?", turn)])) == {("a:1", "b:1")}
    # Nothing but a title: any year that the data know.
    assert ("a:1", "b:1") in _pairs(spark, [("a:1", "WYS high temp < 60° on Mar 17?", None), ("b:1", "WYS high temp < 60° on 2022-03-17?", None), ("b:2", "ELN high temp < 60° on 2021-03-17?", None)])


def test_copies_in_both_venues_all_meet(spark):
    rows = [("a:1", "WYS high temp < 60° on Mar 17?", CLOSE), ("a:2", "Wylcross: daily high under 60 degrees on 2021-03-17", CLOSE), ("a:3", "WYS high temp < 60° on Mar 17?", CLOSE), ("b:1", "WYS high temp < 60° on Mar 17?", CLOSE), ("b:2", "Wylcross: daily high below 60F on Mar 17", CLOSE)]
    assert {p for p, c in _pairs(spark, rows).items() if c >= 0.5} == {(a, b) for a in ("a:1", "a:2", "a:3") for b in ("b:1", "b:2")}


def _asked(spark, rows):
    schema = "key string, venue string, title string, close long, whole_day boolean, hint_day date, hint_direction int, hint_threshold double"
    return spark.createDataFrame([(k, v, t, c, False, None, None, None) for k, v, t, c in rows], schema)


def _met(spark, rows):
    places = spark.createDataFrame([("AAA", "Aton")], "code string, name string")
    return {(r["a"], r["b"]): r["confidence"] for r in matching.match(_asked(spark, rows), places).collect()}


def _at(day):
    import datetime as dt

    return int(dt.datetime.fromisoformat(f"{day}T22:00:00+00:00").timestamp() * 1e6)


def test_a_missing_threshold_is_left_to_the_propagation(spark):
    rows = [("k:1", "k", "Zedcoin price above 100 on May 3, 2031", _at("2031-05-03")), ("k:2", "k", "Zedcoin price above 200 on May 3, 2031", _at("2031-05-03")), ("m:1", "m", "Zedcoin price above 100 on 2031-05-03", _at("2031-05-03"))]
    sure = _met(spark, rows)
    assert set(sure) == {("k:1", "m:1")} and sure["k:1", "m:1"] > 0.9
    # One that names no threshold may be either of the two, so neither is more likely than not.
    open_ = _met(spark, [*rows[:2], ("m:2", "m", "Zedcoin price above on 2031-05-03", _at("2031-05-03"))])
    assert set(open_) == {("k:1", "m:2"), ("k:2", "m:2")} and max(open_.values()) < 0.5
    # With one of the two taken by a market that names it, the other is the better guess.
    both = _met(spark, [*rows, ("m:2", "m", "Zedcoin price above on 2031-05-03", _at("2031-05-03"))])
    assert both["k:1", "m:1"] > 0.8 and both["k:2", "m:2"] > both["k:1", "m:2"]


def test_titles_that_cannot_be_read_go_by_their_words(spark):
    rows = [("k:1", "k", "Which side lifts the Lantern Cup this coming spring season?", _at("2031-05-03")), ("m:1", "m", "which side lifts the lantern cup this coming spring season", _at("2031-05-04")), ("m:2", "m", "Which side lifts the Copper Bowl this coming spring season?", _at("2031-05-03")), ("p:1", "p", "Which side lifts the Lantern Cup this coming spring season?", _at("2031-09-03")), ("p:2", "p", " ", None), ("p:3", "p", None, None)]
    found = {k for k, c in _met(spark, rows).items() if c >= 0.5}
    assert found == {("k:1", "m:1")}


def test_names_of_many_words_and_stray_words_in_large_numbers(spark):
    long = "The Grand Old Duke of York Memorial Tea Room Association"
    rows = [(f"k:{i}", "k", f"{long} stock above {i} dollars on May 3, 2031", _at("2031-05-03")) for i in range(1, 5)] + [(f"m:{i}", "m", f"Will {long} stock close above {i} dollars on 2031-05-03?", _at("2031-05-03")) for i in range(1, 5)]
    found = _met(spark, rows)
    assert set(found) == {(f"k:{i}", f"m:{i}") for i in range(1, 5)} and min(found.values()) > 0.9
    # A stray phrase that stands three times is no name beside one that stands four hundred times.
    mentions = spark.createDataFrame([("product", "quill")] * 400 + [("product", "quill tomorrow")] * 3 + [("product", "brass lamp")] * 3, "kind string, text string")
    names = {r["text"]: r["entity"] for r in matching.entities(mentions, spark.createDataFrame([], "code string, name string")).collect()}
    assert names == {"quill": "quill", "quill tomorrow": "quill", "brass lamp": "brass lamp"}


def test_propagation_ends_settled(spark):
    import itertools

    edges = spark.createDataFrame([(f"a{i}", f"b{j}", "x", "y", 2.0 + (i * 7 + j * 3) % 5) for i, j in itertools.product(range(6), range(6)) if (i + 2 * j) % 4], "a string, b string, va string, vb string, w double")
    found = matching.propagate(edges).collect()
    for side in ("a", "b"):
        for k in {r[side] for r in found}:
            assert sum(r["p"] for r in found if r[side] == k) <= 1 + 1e-3
