import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from pitlake.llm import common
from pitlake.llm.exact_dedup import exact_dedup

ROWS = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, "b" * 50_000), (7, "b" * 50_000), (8, "a "), (9, "a"), (9, "a"), (None, "a"), (None, "z"), (10, "é"), (11, "e\u0301")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep if keep is not None else True, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(((i, k, n, bool(kept) if i is not None or k is None else False, s) for i, k, n, kept, s in out), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, keep_id int, digest string, _salt int")


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    want = [(i, k, n, kept, s) for i, k, n, kept, s in brute(ROWS)]
    assert [x[:3] + x[4:] for x in got(exact_dedup(frame(spark, ROWS)))] == [x[:3] + x[4:] for x in want]
    kept = [x for x in got(exact_dedup(frame(spark, ROWS))) if x[3]]
    assert {x[0] for x in kept} == {9, 3, 5, 7, 8, 10, 11, None}


def test_hot_groups_are_salted(spark, monkeypatch):
    monkeypatch.setattr(common.hot_keys, "__defaults__", (1e-3, 2))
    rows = [(i, "same") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(20)]
    assert got(exact_dedup(frame(spark, rows))) == brute(rows)


def test_digest_collisions_stay_apart(spark):
    rows = [(i, t) for i, t in ROWS if i is not None]
    df = exact_dedup(frame(spark, rows), digest=lambda c: F.lit("same"))
    assert [x[:3] for x in got(df)] == [x[:3] for x in brute(rows)]


def test_normalised_and_empty(spark):
    out = {r.doc_id: r.keep_id for r in exact_dedup(frame(spark, [(1, "A"), (2, "a")]), normalise=F.lower).collect()}
    assert out == {1: 2, 2: 2}
    assert exact_dedup(frame(spark, [])).collect() == []
