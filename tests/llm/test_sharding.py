import hashlib
import random
from collections import defaultdict

from pitlake.llm.sharding import BITS, shard, write_shards


def brute(rows, limit):
    h = {i: bin((1 << 60) | int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))[3:] for i, _ in rows}
    out = {}

    def split(members, prefix):
        size = sum(len(t) for _, t in members)
        if size <= limit or len(members) == 1:
            out.update({i: (prefix, size) for i, _ in members})
        else:
            for bit in "01":
                part = [m for m in members if h[m[0]].startswith(prefix + bit)]
                if part:
                    split(part, prefix + bit)

    split(rows, "")
    return out


def test_against_recursive_splitting(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(400)) for i in range(700)] + [(5000, "y" * 9000), (5001, "z" * 2999)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, h int")
    for limit in (3000, 10**9):
        got = {r.doc_id: (r.shard, r.shard_bytes) for r in shard(df, limit).collect()}
        assert got == brute(rows, limit)
        assert all(r.fits == (r.shard_bytes <= limit) and r.depth == len(r.shard) for r in shard(df, limit).collect())


def test_repeated_ids_overflow_into_pages(spark):
    df = spark.createDataFrame([(1, "x" * 100)] * 50 + [(2, None), (None, "né"), (3, "big" * 1000)], "doc_id long, text string")
    got = shard(df, 1000).collect()
    assert len(got) == 53
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.n_bytes
    assert all(sizes[r.shard] == r.shard_bytes for r in got)
    assert all(r.fits for r in got if r.doc_id != 3)
    assert any(r.depth == BITS for r in got) and [r.n_bytes for r in got if r.doc_id is None] == [3]


def test_empty_and_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 100, i) for i in range(100)], "doc_id long, text string, n_bytes int")
    assert shard(df.limit(0), 10).collect() == []
    write_shards(df, str(tmp_path / "out"), 1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and set(back.columns) == {"doc_id", "text", "n_bytes", "_shard"}
