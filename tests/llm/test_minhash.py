import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
import pytest

from pitlake.llm import minhash as m


def weighted(text):
    return m.shingles(m.words_of(text))


def slow_similarity(a, b):
    x, y = dict(zip(*map(list, a))), dict(zip(*map(list, b)))
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())


def test_similarity_against_the_definition():
    rng = random.Random(1)
    for _ in range(200):
        a = " ".join(rng.choices("abcd", k=rng.randrange(1, 60)))
        b = " ".join(rng.choices("abcd", k=rng.randrange(1, 60)))
        assert m.similarity(weighted(a), weighted(b)) == pytest.approx(slow_similarity(weighted(a), weighted(b)))
    assert m.similarity(weighted(""), weighted("a")) == 0.0
    assert m.similarity(weighted("a"), weighted("a")) == 1.0


def test_signatures_estimate_the_similarity():
    rng = random.Random(2)
    for rate in (0.01, 0.05, 0.1):
        words = [f"w{rng.randrange(400)}" for _ in range(600)]
        words += words[:100] * 2
        other = [w if rng.random() > rate else "x" + w for w in words]
        a, b = weighted(" ".join(words)), weighted(" ".join(other))
        sig = m.probminhash([a, b, a], 4096)
        assert (sig[0] == sig[2]).all()
        assert (sig[0] == sig[1]).mean() == pytest.approx(m.similarity(a, b), abs=0.04)


def brute(rows):
    sets = {i: weighted(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if m.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def corpus():
    rng = random.Random(3)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 300))] for _ in range(25)]
    rows = []
    for words in base:
        rows.append(" ".join(words))
        for _ in range(rng.randrange(6)):
            words = [w if rng.random() > 0.02 else f"y{rng.randrange(99)}" for w in words]  # each from the one before: chains
            rows.append(" ".join(words))
    rows += [rows[0]] * 30 + [rows[0].upper() + "!", "", None, "...", "one", "one", "two words"]
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


def test_groups_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(None, "one", "x", 1)], "doc_id long, text string, band string, src long")
    got = m.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: r.group_id for r in got if r.doc_id is not None} == brute(rows)
    assert all(r.kept == (r.doc_id == r.group_id) for r in got if r.doc_id is not None)
    assert [r.kept for r in got if r.doc_id is None] == [True]


def test_leader_unlike_its_members(spark):
    """Members that share buckets with a leader they are not similar to still find each other."""
    rng = random.Random(4)
    core = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(core[:300] + [f"a{i}" for i in range(120)]))]
    for k in range(1, 12):
        words = core[:370] + [f"b{i}" for i in range(80)]
        words[rng.randrange(450)] = f"z{k}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.group_id for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.group_id, r.kept) for r in m.near_duplicates(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_repeated_ids_with_other_texts(spark):
    """A repeated id is as many documents as it has texts."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, b + " more"), (3, "plain words alone"), (0, "other plain words"), (3, b.upper()), (0, a + " tail"), (5, "x y"), (5, "X, Y")]
    got = m.near_duplicates(spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, doc int, low string"))
    at = {r.h: t for t in {t for _, t in rows} for r in spark.createDataFrame([(t,)], "t string").select(m.text_hash(F.col("t")).alias("h")).collect()}
    out = {(r.doc_id, at[r.text_hash]): (r.group_id, r.kept) for r in got.collect()}
    assert len(out) == len(rows)
    assert out[1, a] == (0, False) and out[0, a + " tail"] == (0, True)
    assert out[1, b] == (1, True) and out[2, b + " more"] == (1, False) and out[3, b.upper()] == (1, False)
    assert out[3, "plain words alone"] == (3, True) and out[0, "other plain words"] == (0, True)
    assert sorted((out[5, "x y"][1], out[5, "X, Y"][1])) == [False, True]


def test_recall_on_documents(spark):
    """Every pair of whole `documents` at the limit or above lies in one group: exact pairs by shared shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    group = {r.doc_id: r.group_id for r in m.near_duplicates(docs).collect()}
    sets = {r.doc_id: m.shingles(m.words_of(r.text)) for r in docs.collect()}
    where = defaultdict(list)
    for i, (h, _) in sets.items():
        for x in h.tolist():
            where[x].append(i)
    common = Counter((i, j) for ids in where.values() if len(ids) > 1 for k, i in enumerate(ids) for j in ids[k + 1 :])
    size = {i: len(h) for i, (h, _) in sets.items()}
    pairs = [(i, j) for (i, j), n in common.items() if n >= 0.4 * max(size[i], size[j]) and m.similarity(sets[i], sets[j]) >= 0.8]
    assert len(pairs) > 50
    assert sum(group[i] == group[j] for i, j in pairs) == len(pairs)


def test_pieces_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 60, None, "b" * 60, "c" * 300, "", "d"])], ["i", "t"])
    assert [p.num_rows for p in m.pieces(batch, 1, 512, 100)] == [2, 1, 1, 2]
    assert [p.num_rows for p in m.pieces(batch, 1, 4, 10_000)] == [4, 2]


def test_bands_have_numbers():
    row = np.zeros(m.SLOTS, np.uint32)
    assert len(set(m.bands_of(row))) == m.SLOTS // m.BAND
