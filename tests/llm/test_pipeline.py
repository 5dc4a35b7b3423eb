import random


import public_tokenizers
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(20, 120))]
        if i % 8 == 0:
            words[3] = "snarfy"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1]) for i in range(1, 6)]  # exact copies
    rows += [(2000 + i, rows[i][1].rsplit(" ", 1)[0] + " tail") for i in range(9, 14)]  # near copies
    rows += [(3000, None), (3001, "")]
    d = tmp_path_factory.mktemp("data")
    spark.createDataFrame([(i, t, rng.choice(["en", "de"]), f"src{i % 20}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_one_by_one(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "minhash", "mixing", "bpe"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    toxic = {i for i, t in texts.items() if "snarfy" in (t or "")}
    assert kept[0] == set(texts) - toxic
    copies = {i for i in range(1, 6) if i not in toxic} | {3000}
    assert kept[0] - kept[1] == copies
    assert kept[1] - kept[2] == {2000 + i for i in range(9, 14) if i not in toxic}
    assert kept[3] <= kept[2] and len(kept[3]) > 0.4 * len(kept[2])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.ids for r in docs.collect()} == {i: t.encode(texts[i] or "", add_special_tokens=False).ids for i in kept[4]}
    assert kept[4] == kept[3]


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.where(F.col("n_tokens") > 0).count() > 100


def test_odd_tables(spark, sf_dir):
    """Columns with internal names, repeated rows and ids, null ids and empty texts go through all stages."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(40)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[1] + " tail"), (None, texts[2]), (None, texts[2]), (None, texts[3]), (3, None), (4, ""), (5, texts[4]), (5, texts[4])]
    names = ["_score", "__score", "_whole", "_end", "_domain", "_n_tokens", "_copies", "_sha", "_near_id", "_copy_n", "_mix_n", "kept", "group_id", "text_hash", "a.b"]
    docs = spark.createDataFrame([(i, t, "en", "src1", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for k, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(k))
    left = []
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        columns, docs = docs.columns, stage(spark, docs, sf_dir)
        assert empty.count() == 0 and empty.columns == docs.columns
        if name != "bpe":
            assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        left.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) if name != "bpe" else None)
    one = sorted([(1, texts[0]), (1, texts[1]), (2, texts[1] + " tail"), (None, texts[2]), (None, texts[3]), (4, ""), (5, texts[4])], key=str)
    assert left[0] == sorted(rows, key=str)
    assert [x for x in left[1] if x[1]] == [x for x in one if x[1]] and sum(not x[1] for x in left[1]) == 1
    assert [x for x in left[2] if x[1]] == sorted([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (5, texts[4])], key=str)
    assert set(left[3]) <= set(left[2]) and left[3]
