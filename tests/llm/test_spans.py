"""Shared spans against brute force, with ties, copies, short, null and very long texts."""

import random

from pyspark.sql import functions as F

from quotemill.llm import spans


def _brute(docs, least):
    where = {}
    for i, t in docs:
        for k in range(len(t or "") - least + 1):
            where.setdefault(t[k : k + least], set()).add(i)
    out = set()
    for i, t in docs:
        cur = None
        for k in range(len(t or "") - least + 1):
            if len(where[t[k : k + least]]) > 1:
                if cur and k <= cur[1]:
                    cur[1] = k + least
                else:
                    if cur:
                        out.add((i, *cur))
                    cur = [k, k + least]
        if cur:
            out.add((i, *cur))
    return out


def _found(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("first", F.lit("clash"))
    return {(r["doc_id"], r["span_start"], r["span_end"]) for r in spans.stretches(spans.shared_runs(df, **kw)).collect()}


def _texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé😀") for _ in range(rng.randint(1, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randint(1, 8)))
    pool = ["\n".join(line() for _ in range(rng.randint(3, 25))) for _ in range(12)]
    docs = []
    for i in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "\n".join(line() for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 4))]
        text = rng.choice(["\n", "\r\n", " "]).join(parts)
        a = rng.randint(0, max(0, len(text) // 2))
        docs.append((i, text[a:] if rng.random() < 0.5 else text))
    docs += [(60, docs[3][1]), (61, docs[3][1]), (62, None), (63, ""), (64, "short"), (65, "x" * 700), (66, "y" + "x" * 400), (67, "ab" * 300), (68, "ab" * 150 + "c")]
    return docs


def test_equals_brute_force(spark):
    for seed in (1, 2, 3):
        docs = _texts(seed)
        assert _found(spark, docs) == _brute(docs, 200)


def test_long_texts_are_cut_without_a_seam(spark, monkeypatch):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(3_000))
    docs = [(1, "".join(rng.choice("ijkl\n") for _ in range(5_000)) + shared), (2, shared[:2_500] + "".join(rng.choice("mnop\n") for _ in range(4_000)))]
    expected = _brute(docs, 200)
    monkeypatch.setattr(spans, "AT_ONCE", 700)
    ids, offsets, texts = zip(*[(i, o, t) for a, b, c in spans.pieces(iter([_batch(docs)]), 200) for i, o, t in zip(a, b, c)])
    assert max(map(len, texts)) <= 700 + 199 and all(dict(docs)[i][o : o + len(t)] == t for i, o, t in zip(ids, offsets, texts))
    assert _found(spark, docs) == expected


def _batch(docs):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["id", "text"])


def test_blocks_at_seams_still_meet(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(2_000))
    texts = [shared + "1" * 300, "2" * 450 + shared]
    whole = spans.blocks(texts, 200)
    runs = sum((whole["last"] - whole["first"] + 1).tolist())
    assert runs == sum(len(t) - 199 for t in texts)


def test_one_text_in_a_third_of_all_records(spark):
    rng = random.Random(7)
    advert = "".join(rng.choice("abcdefgh \n") for _ in range(300))
    docs = [(i, (advert if i % 3 == 0 else "") + "".join(rng.choice("ijklmn \n") for _ in range(250))) for i in range(120)]
    assert _found(spark, docs) == _brute(docs, 200)


def test_nothing_to_share(spark):
    assert _found(spark, [(1, None), (2, ""), (3, "a" * 199)]) == set()
    assert spans.stretches(spans.shared_runs(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    # Repeated inside one record only.
    assert _found(spark, [(1, "abc" * 200), (2, "q")]) == set()


def test_share_and_repeats(spark):
    rng = random.Random(8)
    common = "".join(rng.choice("abcdefgh ") for _ in range(250))
    docs = [(1, common + "1" * 250), (2, "2" * 100 + common), (3, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    runs = spans.shared_runs(df)
    share = {r["doc_id"]: (r["n_chars"], r["shared_chars"], r["shared_share"]) for r in spans.shared_share(df, spans.stretches(runs)).collect()}
    assert share == {1: (500, 250, 0.5), 2: (350, 250, 250 / 350), 3: (0, 0, None), 4: (0, 0, None)}
    assert {(r["doc_id"], r["span_start"], r["span_end"]) for r in spans.repeats(runs).collect()} == {(2, 100, 350)}


def _brute_repeats(docs, least):
    first, out = {}, set()
    for i, t in sorted(docs):
        for k in range(len(t or "") - least + 1):
            first.setdefault(t[k : k + least], i)
    for i, t in docs:
        cur = None
        for k in range(len(t or "") - least + 1):
            if first[t[k : k + least]] < i:
                if cur and k <= cur[1]:
                    cur[1] = k + least
                else:
                    if cur:
                        out.add((i, *cur))
                    cur = [k, k + least]
        if cur:
            out.add((i, *cur))
    return out


def _repeats(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r["doc_id"], r["span_start"], r["span_end"]) for r in spans.repeats(spans.shared_runs(df)).collect()}


def test_repeats_equal_brute_force(spark):
    for seed in (1, 2):
        docs = _texts(seed)
        assert _repeats(spark, docs) == _brute_repeats(docs, 200)


def test_copies_give_up_what_an_earlier_record_has(spark):
    rng = random.Random(9)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    passage = some(250, "abcdefgh ")
    around = [some(300, "ijkl") + passage + some(300, "mnop") for _ in range(3)]
    docs = [(1, around[0]), (2, around[1]), (3, around[1])]
    assert _repeats(spark, docs) == _brute_repeats(docs, 200)
    # Copies of one text after copies of another.
    docs = [(1, around[0]), (2, around[0]), (3, around[1]), (4, around[1]), (5, around[2])]
    assert _repeats(spark, docs) == _brute_repeats(docs, 200)
