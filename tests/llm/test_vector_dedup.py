import numpy as np
import pytest

from pitlake.llm import vector_dedup as v


def brute(rows, limit):
    good = {}
    for n, (i, x) in enumerate(rows):
        if i is None or not x or any(y is None or not np.isfinite(y) for y in x) or not any(x):
            continue
        good[n] = np.array(x, np.float32).astype(float)
    parent = {n: n for n in good}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    links = dict.fromkeys(range(len(rows)), 0)
    keys = list(good)
    for a, m in enumerate(keys):
        for n in keys[a + 1 :]:
            x, y = good[m], good[n]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= limit:
                links[m] += 1
                links[n] += 1
                parent[root(m)] = root(n)
    low = {}
    for n in keys:
        low[root(n)] = min(low.get(root(n), rows[n][0]), rows[n][0])
    return sorted(((i, links[n], low[root(n)] if n in good else i, (low[root(n)] if n in good else i) == i) for n, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("spread", [0.02, 0.25])
def test_against_brute_force(spark, spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 24))
    rows = [(int(i), (centres[rng.integers(12)] + spread * rng.normal(size=24) * rng.integers(0, 3)).tolist()) for i in rng.permutation(220)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [float("inf")] + [0.0] * 23), (2005, [None] + [1.0] * 23)]
    rows += [(2006, [1e30] * 24), (2007, [1e-30] * 24), (2008, [1.0, 2.0]), (2009, [2.0, 4.0]), (2010, [-1.0, -2.0]), (2011, [-0.0] * 24)]
    df = spark.createDataFrame([(i, x, 0, "k") for i, x in rows], "vec_id long, embedding array<float>, n long, key string")
    for block in (64, 4096):
        got = v.link_vectors(df, 0.9, block=block).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute(rows, 0.9)


def test_null_id_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in v.link_vectors(df).collect()) == [("1", 0, True), ("None", 0, True)]
    assert v.link_vectors(df.limit(0)).collect() == []


def test_double_vectors_keep_their_precision(spark):
    near, turn = 1e-9, 0.9
    rows = [(1, [1.0, 0.0]), (2, [turn - near, (1 - (turn - near) ** 2) ** 0.5]), (3, [turn + near, -((1 - (turn + near) ** 2) ** 0.5)]), (4, [1e200, 1e190]), (5, [-1.0, 1e-9]), (6, [-1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in v.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()}
    want, good = {}, {i: np.array(x) / np.abs(x).max() for i, x in rows}
    for i in good:
        want[i] = sorted(j for j in good if j != i and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= 0.9)
    assert want == {1: [3, 4], 2: [], 3: [1, 4], 4: [1, 3], 5: [6], 6: [5]}
    assert got == {i: (len(x), min([i, *x])) for i, x in want.items()}


def test_least_reached():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        a, b = rng.integers(0, n, n // 2), rng.integers(0, n, n // 2)
        low = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b):
                low[x] = low[y] = min(low[x], low[y])
        assert v.least_reached(n, a, b).tolist() == low
    chain = np.arange(5000)
    assert not v.least_reached(5001, chain[::-1], chain[::-1] + 1).any()


def test_a_tile_sends_rows_not_pairs(spark):
    """A group of vectors that all link with each other leaves a tile as one row each."""
    rng = np.random.default_rng(9)
    x = (np.ones((300, 16)) + 0.01 * rng.normal(size=(300, 16))).astype(np.float32)
    classes = spark.createDataFrame([(i, 1, r.tolist()) for i, r in enumerate(x)], "vec_id long, n long, embedding array<float>")
    got = v.links_of_width(classes, 16, 300, 0.9, 4096, "float").collect()
    assert len(got) == 300 and {(r.more, r.root) for r in got} == {(299, 0)}
