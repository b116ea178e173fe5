"""The queries of the text package that no SQL repeats, over the whole smallest tables, by what must hold of their rows."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA

from quotemill.llm import queries, tokens
from quotemill.session import table


def test_matches_are_pairs_of_two_venues(spark):
    found = queries.p5_matches(spark, DATA).toPandas()
    assert len(found) > 20 and (found["market_a"] < found["market_b"]).all() and not found.duplicated(["market_a", "market_b"]).any()
    assert found["confidence"].between(0, 1).all() and (found["market_a"].str.split(":").str[0] != found["market_b"].str.split(":").str[0]).all()
    known = {r["key"] for r in queries._markets(spark, DATA).select("key").collect()}
    assert set(found["market_a"]) | set(found["market_b"]) <= known
    sure = queries.p5_found(spark, DATA).toPandas()
    assert set(map(tuple, sure.values)) == set(map(tuple, found[found["confidence"] >= 0.5][["market_a", "market_b"]].values))


def test_packing_places_every_token_once(spark):
    placed = queries.p8_pack(spark, DATA).toPandas()
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokens.sized(table(spark, DATA, "documents")).collect() if r["n_tokens"]}
    for name, rows in placed.groupby("limit_name"):
        assert rows.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes, name
        assert (rows.groupby("container_id")["n_tokens"].sum() <= rows["capacity_tokens"].iloc[0]).all()
    told = {r["limit_name"]: r for r in queries.p8_report(spark, DATA).collect()}
    for name, rows in placed.groupby("limit_name"):
        r = told[name]
        assert (r["containers"], r["tokens"], r["online_containers"]) == (rows["container_id"].nunique(), sum(sizes.values()), rows["online_id"].nunique())
        assert r["fill"] == pytest.approx(r["tokens"] / r["containers"] / r["capacity_tokens"]) and r["online_fill"] <= r["fill"]


def test_mix_keeps_the_caps_and_reports_what_it_gives(spark):
    mixed, targets = queries.p9_mix(spark, DATA), {r["source"]: r for r in table(spark, DATA, "mix_targets").collect()}
    rows = mixed.toPandas()
    docs = {r["doc_id"]: r["source"] for r in table(spark, DATA, "documents").collect()}
    assert not rows["doc_id"].duplicated().any() and all(docs[d] == s for d, s in zip(rows["doc_id"], rows["source"]))
    assert all(1 <= c <= targets[s]["max_repeats"] for s, c in zip(rows["source"], rows["copies"]))
    used = (rows["n_tokens"] * rows["copies"]).groupby(rows["source"]).sum()
    told = {r["source"]: r for r in queries.p9_report(spark, DATA).collect()}
    assert set(told) == set(targets) and all(told[s]["tokens"] == used.get(s, 0) for s in told)
    assert sum(r["actual_share"] for r in told.values()) == pytest.approx(1)


def test_read_sizes_are_those_of_whole_texts(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text").filter(F.length("text") > 0).collect()
    encode = tokens.encoding(f"{tokens.FOLDER}/{tokens.VOCABULARY}").encode_ordinary
    found = {r["doc_id"]: r["n_tokens"] for r in tokens.sized(table(spark, DATA, "documents")).collect()}
    assert all(found[r["doc_id"]] == len(encode(r["text"])) for r in docs)
