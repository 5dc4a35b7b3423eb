import hashlib
import random

import numpy as np

from pitlake.llm import substring_dedup as s


def brute(rows, length):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - length + 1):
                if first[b[k : k + length]] < i:
                    gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pack long, data string")
    return sorted((tuple(r) for r in s.remove_repeats(df, **options).collect()), key=str)


def corpus(rng, alphabet, n, size):
    rows = []
    for i in range(n):
        t = "".join(rng.choices(alphabet, k=rng.randrange(size)))
        for _ in range(rng.randrange(3)):
            if rows:
                other = rng.choice(rows)[1] or ""
                a = rng.randrange(len(other) + 1)
                t += other[a : a + rng.randrange(200)]
        rows.append((rng.randrange(10_000), t))
    return rows + [(3, None), (4, ""), (None, rows[0][1]), (None, None), (5, rows[1][1]), (5, rows[1][1]), (20_001, rows[1][1] * 3)]


def test_fifty_bytes(spark):
    rows = corpus(random.Random(1), "abcdefgh é", 60, 600)
    assert run(spark, rows) == brute(rows, 50)


def test_short_windows_and_periodic_texts(spark):
    rng = random.Random(2)
    rows = corpus(rng, "ab", 40, 80) + [(100 + i, "ab" * 60) for i in range(5)] + [(90, "a" * 500), (95, "a" * 30 + "b" + "a" * 300)]
    assert run(spark, rows, length=12, gram=5) == brute(rows, 12)


def test_hot_anchors_travel_by_window(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("xyz", k=40)) + "the very same middle part" + "".join(rng.choices("xyz", k=40)) + "Z" * 70) for i in range(60)]
    want = brute(rows, 50)
    assert run(spark, rows, hot_packs=2, pack_bytes=500) == want == run(spark, rows)


def test_window_in_every_pack(spark):
    """A passage of all packs is combined by groups of packs first; the results stay the same whatever the groups."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("xyz", k=30)) + "a licence line that every document of the corpus repeats" + "".join(rng.choices("xyz", k=20))) for i in range(80)]
    rows += [(200 + i, rows[i][1] + "W" * 60) for i in range(0, 80, 9)]
    want = brute(rows, 50)
    for fan in (1, 3, 1024):
        assert run(spark, rows, hot_packs=2, pack_bytes=300, fan=fan) == want


def test_border_inside_a_group():
    """Pieces much smaller than a group of equal windows, and than an anchor's group: the borders are compared."""
    rng = random.Random(9)
    gram, length = 5, 12
    texts = ["".join(rng.choices("ab", k=7)) + "GRAM!" + "".join(rng.choices("ab", k=7)) for _ in range(30)] * 3 + ["aaaaaaaGRAM!aaaaaaa"] * 20
    runs = list(dict.fromkeys(bytes((7,)) + t.encode() for t in texts)) + [bytes((0,)) + b"other" + b"q" * 7, bytes((0,)) + b"zzzzz" + b"q" * 40]
    docs = np.array([rng.randrange(1000) for _ in runs])
    first = {}
    for r, d in zip(runs, docs):
        for k in range(len(r) - length):
            w = r[1 + k : 1 + k + length]
            first[w] = min(first.get(w, 10**9), d)
    for piece in (1, 2, 3, 7, 50, 10_000):
        got = s.least_documents(runs, docs, length, gram, piece)
        assert [x.tolist() for x in got] == [[first[r[1 + k : 1 + k + length]] for k in range(len(r) - length)] for r in runs]


def test_pieces_are_bounded_and_in_order():
    rng = random.Random(11)
    data = bytes(rng.choices(b"ab", k=3000)) + b"a" * 500
    at = np.array(rng.sample(range(len(data) - 20), 2000))
    got = list(s.pieces_in_order(data, at, 20, 64))
    assert all(0 < len(x) <= 64 for x in got) and sorted(np.concatenate(got).tolist()) == list(range(2000))
    text = lambda i: data[at[i] : at[i] + 20]
    assert all(max(map(text, a)) <= min(map(text, b)) for a, b in zip(got, got[1:]))


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == brute([(1, None)], 50)


def test_multikey_order():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    order, same = s.multikey_order(words)
    rows = [tuple(int(w[i]) for w in words) for i in order]
    assert rows == sorted(rows)
    assert same.tolist() == [False] + [a == b for a, b in zip(rows, rows[1:])]


def test_text_kept(spark):
    df = spark.createDataFrame([(1, "q" * 10 + "0123456789" * 6), (2, "0123456789" * 6 + "tail")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in s.remove_repeats(df, with_text=True).collect()}
    assert got == {1: b"q" * 10 + b"0123456789" * 6, 2: b"tail"}


def test_rows_of_a_pack_have_one_order():
    import pyarrow as pa

    rows = [(3, b"c"), (None, b"z"), (1, b"b"), (1, b"a"), (None, None), (0, b"q")]
    got = [s.in_order(pa.table({"doc_id": pa.array([r[0] for r in x], pa.int64()), "data": pa.array([r[1] for r in x], pa.binary())})).to_pydict() for x in (rows, rows[::-1])]
    assert got[0] == got[1]


def test_anchors_spread_over_buckets():
    text = bytes(np.random.default_rng(3).integers(97, 123, 200_000).astype(np.uint8))
    _, _, bucket = s.anchor_lists(s.Runs([text], 50, 20), np.array([1]), 64)
    n = np.bincount(bucket, minlength=64)
    assert n.min() > n.mean() / 2 and n.max() < n.mean() * 2


def test_rows_between_packs_and_ranges():
    """At 6 GB of files (10.4 GB of text) packs and ranges exchange at most two million rows, packs and buckets one."""
    text = 10.4e9
    assert text / s.PACK_BYTES * text / s.RANGE_BYTES < 2e6
    assert text / s.PACK_BYTES * text / s.FILTER_BYTES < 1e6


def test_runs_of_a_range_made_distinct_in_parts(spark, monkeypatch):
    rng = random.Random(7)
    rows = corpus(rng, "abc é", 60, 300)
    want = brute(rows, 50)
    for hot in (2, 1000):
        for meet in (1, 40):
            monkeypatch.setattr(s, "MEET", meet, raising=False)
            assert run(spark, rows, pack_bytes=800, hot_packs=hot, fan=3) == want


def test_distinct_compares_records_in_full(monkeypatch):
    rng = np.random.default_rng(4)
    recs = rng.integers(0, 2, (500, 16)).astype(np.uint8)
    recs[:, 3:] = 0
    for mult in (s._MULT, 0):  # with 0 all hashes are alike
        monkeypatch.setattr(s, "_MULT", mult)
        order, heads, number = s.distinct(recs)
        kept = recs[order[heads]]
        assert (kept[number] == recs).all()
        assert mult == 0 or len(heads) == len({r.tobytes() for r in recs})


def test_ranges_by_splitters():
    rng = random.Random(8)
    for gram in (5, 20):
        keys = [bytes(rng.choices(b"ab\0", k=gram)) for _ in range(400)]
        splitters = sorted(set(keys[:40]))
        rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, gram)
        assert s.splits_of(rows, splitters, gram).tolist() == [sum(x <= k for x in splitters) for k in keys]
        assert s.splits_of(rows, [], gram).tolist() == [0] * len(keys)
