import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanweave.llm import near_duplicates as N
from spanweave.llm import terms as T
from spanweave.llm.sampling import hash_sample


def story():
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))


def test_terms_by_hand(spark):
    rows = [(1, "The THE fox", "İstanbul fox_1"), (1, "The THE fox", "İstanbul fox_1"), (2, None, "the dog"), (3, "", None), (4, "..", " \n"), (None, "ghost", "ghost"), (5, "the 42 ΟΔΟΣ", "½ ２")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "news_id long, title string, body string, term string")
    got = {r["term"]: (r["occurrences"], r["records"], r["kind"]) for r in T.term_frequencies(df, "news_id", story(), 2, 0.3).collect()}
    assert got["the"] == (4, 3, "common") and got["fox"] == (2, 1, "rare") and got["1"][0] == 1 and "ghost" not in got and got["½"][1] == 1
    assert got["οδος"][0] == 1 and got["i̇stanbul"] == (1, 1, "rare")
    assert T.term_frequencies(df.limit(0), "news_id", story()).count() == 0


def test_terms_against_a_counter(spark):
    """Runs go over batches and partitions; one word is in a third of all rows' places."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["hot"] * 40 + [f"w{k}" for k in range(80)]) for _ in range(30))) for i in range(1500)]
    rows += rows[:50]
    df = spark.createDataFrame([(i, None, t) for i, t in rows], "news_id long, title string, body string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        got = {r["term"]: (r["occurrences"], r["records"]) for r in T.term_frequencies(df, "news_id", story()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    occurrences, records = Counter(), Counter()
    for t in dict(rows).values():
        occurrences.update(t.split())
        records.update(set(t.split()))
    assert got == {t: (occurrences[t], records[t]) for t in occurrences}


def test_borders_cut_a_hot_term(spark, monkeypatch):
    """Ranges of few rows: a word of all records lies in many of them, and every row is counted once."""
    monkeypatch.setattr(T, "RANGE_ROWS", 100)
    rows = [(i, f"hot w{i % 7} x{i}") for i in range(600)]
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "news_id long, title string, body string")
    borders = T._borders(df.select(F.col("news_id").alias("record"), F.col("title").alias("text")), 600)
    assert len(borders) >= 12 and sum(t == "hot" for t, _ in borders) >= 3
    got = {r["term"]: r["records"] for r in T.term_frequencies(df, "news_id", story()).collect()}
    assert got["hot"] == 600 and got["w3"] == 86 and got["x5"] == 1 and len(got) == 608


def test_hash_sample(spark):
    df = spark.range(20_000)
    some = hash_sample(df, F.col("id"), 20_000, 1000)
    assert 850 < some.count() < 1150 and sorted(some.collect()) == sorted(hash_sample(df.repartition(5), F.col("id"), 20_000, 1000).collect())
    assert hash_sample(df, F.col("id"), 20_000, 20_000).count() == 20_000 and hash_sample(df.limit(0), F.col("id"), 0, 5).count() == 0


def test_values(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "a", None), (3, None, 2)], "id long, x string, y int")
    got = {(r["field"], r["value"]): (r["occurrences"], r["records"]) for r in T.value_frequencies(df, "id", ["x", "y"]).collect()}
    assert got == {("x", "a"): (2, 2), ("y", "1"): (1, 1), ("y", "2"): (1, 1)}


def jaccard_pairs(rows, shingle, least, similarity):
    sets = {}
    for i, text in rows:
        w = T.record_words(text or "")
        if i is not None and w and len(w) >= least:
            sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        action = rng.random()
        if action < 0.4:
            words[k] = f"new{rng.randrange(10**6)}"
        elif action < 0.7:
            del words[k]
        else:
            words.insert(k, f"ins{rng.randrange(10**6)}")
    return words


@pytest.mark.parametrize("similarity, shingle, least", [(0.5, 3, 20), (0.8, 5, 0)])
def test_pairs_against_brute_force(spark, similarity, shingle, least):
    rng = random.Random(similarity)
    rows, i = [], 0
    for _ in range(60):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(15, 90))]
        for edits in (0, 0, 1, 2, 4):
            rows.append((i, " ".join(edited(rng, base, edits))))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "only three words"), (None, rows[0][1]), rows[0], (i + 3, rows[0][1].upper().replace(" ", "  \n"))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, class_id int")
    out = N.near_duplicate_pairs(df, "id", F.col("text"), similarity, shingle, least)
    got, want = {(r["id_a"], r["id_b"]) for r in out.collect()}, jaccard_pairs(rows, shingle, least, similarity)
    assert got <= want and len(got) >= 0.995 * len(want)
    groups = {r["id"]: r for r in N.near_duplicate_groups(df, "id", F.col("text"), similarity, shingle, least).collect()}
    assert all(groups[a]["group_id"] == groups[b]["group_id"] for a, b in got)
    assert set(groups) == {a for a, _ in rows if a is not None}
    chain = {a: a for a in groups}
    for _ in range(10):
        for a, b in got:
            chain[a] = chain[b] = min(chain[a], chain[b])
    assert {a: r["group_id"] for a, r in groups.items()} == chain
    assert groups[i + 3]["class_id"] == groups[0]["class_id"]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_runs(monkeypatch, size):
    """Runs that go over batches, and keys with more rows than a run may have."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(N, "RUN_ROWS", 6)
    rng = random.Random(5)
    rows = sorted({(rng.choice([1, 2, 3, 3, 3, 7, 8, 9] + list(range(20, 60))), rng.randrange(40)) for _ in range(120)} | {(90, k) for k in range(9)})
    table = pa.table({"key": np.array([r[0] for r in rows]), "id": np.array([r[1] for r in rows])})
    batches = [table.slice(k, size).combine_chunks().to_batches()[0] for k in range(0, len(rows), size)]
    by = {}
    for k, i in rows:
        by.setdefault(k, []).append(i)
    got = [r for b in N._runs(False)(iter(batches)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    want = {(a, b) for v in by.values() if len(v) <= 6 for a, b in itertools.combinations(v, 2)}
    assert {r for r in got if r[1] is not None} == want and {r[0] for r in got if r[1] is None} == {k for k, v in by.items() if len(v) > 6}
    star = {r for b in N._runs(True)(iter(batches)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert star == {(v[0], b) for v in by.values() for b in v[1:]}


def test_hot_keys_are_joined(spark, monkeypatch):
    monkeypatch.setattr(N, "RUN_ROWS", 1)
    rows = [(i, f"the quick brown fox jumps over the lazy dog while {i} seven green parrots watch it quietly from a tree") for i in range(12)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(df, "id", F.col("text"), 0.5, 3).collect()}
    assert got == jaccard_pairs(rows, 3, 0, 0.5) and len(got) == 66


def test_short_texts(spark):
    """Fewer words than a shingle are one shingle; no words are no shingle."""
    rows = [(1, "two words"), (2, "TWO  words"), (3, "words two"), (4, ""), (5, None), (6, "..."), (7, "one"), (8, "one"), (9, "two words more"), (10, "a b c d e"), (11, "a b c d e f")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert sorted((r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(df, "id", F.col("text"), 0.8, 5).collect()) == [(1, 2), (7, 8)]
    groups = {r["id"]: (r["class_id"], r["group_id"]) for r in N.near_duplicate_groups(df, "id", F.col("text"), 0.5, 5).collect()}
    assert groups == {i: (c, g) for i, c, g in [(1, 1, 1), (2, 1, 1), (3, 3, 3), (4, 4, 4), (5, 5, 5), (6, 6, 6), (7, 7, 7), (8, 7, 7), (9, 9, 9), (10, 10, 10), (11, 11, 10)]}


def test_dense_group_is_a_star(spark, monkeypatch):
    """Texts that differ in one word have as many links as pairs; their chain takes about as many candidates as texts."""
    seen = []
    verified = N._verified
    monkeypatch.setattr(N, "_verified", lambda signed, found, similarity: seen.append(found.count()) or verified(signed, found, similarity))
    df = spark.createDataFrame([(i, "all of these notices say the same long thing over and over again but for " + f"word{i} " + "in the middle of it and so on until the very end of the page") for i in range(300)], "id long, text string")
    groups = N.near_duplicate_groups(df, "id", F.col("text"), 0.6, 3).collect()
    assert {r["group_id"] for r in groups} == {0} and sum(seen) < 3000


def test_recall_at_the_threshold(spark):
    """Fresh pairs of sets that share just half of their union."""
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        words = [f"u{i}x{k}" for k in range(62)]  # 60 shingles of three words; 40 in common leave 20 + 20 of their own
        cut = 40
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(words[: cut + 2] + [f"o{i}x{k}" for k in range(20)])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, text string")
    got = N.near_duplicate_pairs(df, "id", F.col("text"), 0.5, 3, 20).collect()
    assert len(got) >= 0.99 * 1500 and all(r["id_b"] == r["id_a"] + 1 for r in got)


def test_hot_copies_and_empty(spark):
    """A third of all rows are copies: one class, no pairs among them in the grouped form; a long text is one row."""
    rows = [(k, "the same long notice of the quarry with twenty words in it so that it is not too short for any test at all") for k in range(400)]
    rows += [(1000 + k, f"notice {k} of its own with quite other words number {k * 7} and so on up to {k * 13} or {k * 17} plus {k * 19} more {k * 23}") for k in range(800)]
    rows += [(5000, "word " * 100_000)]
    df = spark.createDataFrame(rows, "id long, text string")
    groups = N.near_duplicate_groups(df, "id", F.col("text"), 0.8, 5).collect()
    assert sum(r["class_id"] == 0 for r in groups) == 400 and len(groups) == 1201
    assert N.near_duplicate_pairs(df.limit(0), "id", F.col("text")).count() == 0 and N.near_duplicate_groups(df.limit(0), "id", F.col("text")).count() == 0
