import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from pitlake.llm.mixing import mix

WEIGHTS = {"domain": {"web": 60, "books": 40}, "lang": {"en": 3, "de": 1, "other": 1}, "source": {"other": 1}}


def fill(children, budget):
    """children: name -> (weight, capacity); hand out until nobody unfilled is left or the budget is gone."""
    got, left = {}, dict(children)
    while left:
        total = sum(w for w, _ in left.values())
        full = [n for n, (w, c) in left.items() if c * total <= budget * w]
        if not full:
            return got | {n: int(budget * w / total) for n, (w, _) in left.items()}
        full = [min(full, key=lambda n: left[n][1] / left[n][0])]
        for n in full:
            got[n] = left[n][1]
            budget -= left.pop(n)[1]
    return got


def brute(rows, share, epochs, seed=7):
    n = {i: len((t or "").split()) for i, _, _, _, t in rows}
    leaves = defaultdict(list)
    for i, d, lang, s, _ in rows:
        leaves[d, lang or "", s or ""].append(i)
    cap = {k: epochs * sum(n[i] for i in v) for k, v in leaves.items() if sum(n[i] for i in v)}
    budget = min(sum(cap.values()), int(sum(cap.values()) // epochs * share))
    w = lambda level, name: WEIGHTS[level].get(name, WEIGHTS[level].get("other", 1))
    out = {}
    top = fill({d: (w("domain", d), sum(c for k, c in cap.items() if k[0] == d)) for d in {k[0] for k in cap}}, budget)
    for d, b in top.items():
        mid = fill({x: (w("lang", x), sum(c for k, c in cap.items() if k[:2] == (d, x))) for x in {k[1] for k in cap if k[0] == d}}, b)
        for x, c in mid.items():
            for s, given in fill({k[2]: (1, cap[k]) for k in cap if k[:2] == (d, x)}, c).items():
                ids = leaves[d, x, s]
                whole, rest = divmod(given, cap[d, x, s] // epochs)
                run, open_ = 0, True
                for i in sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{whole + 1}:{i}".encode()).hexdigest()):
                    run += n[i]
                    open_ = open_ and run <= rest
                    copies = whole + (open_ and rest > 0)
                    if copies:
                        out[i] = copies
    return out


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", "fr", None])
        rows.append((i, rng.choice(["web", "web", "books"]), lang, rng.choice(["s1", "s2", "s3", None]), rng.choice([None, ""]) if rng.random() < 0.05 else " ".join(["w"] * rng.randrange(1, 40))))
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 5, "z", 9) for r in rows], "doc_id long, dom string, lang string, source string, text string, domain string, tokens int, end string, whole int")
    return {r.doc_id: r._copies for r in mix(df, F.col("dom"), WEIGHTS, **options).collect()}


def test_against_brute_force(spark):
    rows = corpus(random.Random(3), 800)
    for share, epochs in ((0.3, 1), (0.8, 2), (1.0, 1)):
        assert run(spark, rows, share=share, epochs=epochs) == brute(rows, share, epochs)


def test_ranges_inside_a_large_leaf(spark, monkeypatch):
    monkeypatch.setattr("pitlake.llm.mixing.RANGE_ROWS", 16)
    rows = corpus(random.Random(4), 500)
    assert run(spark, rows, share=0.4, epochs=1) == brute(rows, 0.4, 1)


def test_shortage_goes_to_siblings_first(spark):
    rows = [(1, "web", "en", "a", "w " * 10)]
    rows += [(10 + i, "web", "en", "b", "w") for i in range(800)] + [(2000 + i, "books", "en", "c", "w") for i in range(800)]
    got = run(spark, rows, budget=1000)
    web = sum(10 if i == 1 else 1 for i in got if i < 2000)
    assert got[1] == 1 and web == 600  # the domain keeps its 60 % although one of its sources is short


def test_empty(spark):
    assert run(spark, []) == {} == run(spark, [(1, "web", "en", "a", None)])


def test_clashing_names(spark):
    """Columns called like internal or added ones stay as they are and change nothing."""
    rows = [(i, f"w{i} " * (i % 7 + 1), "en", f"src{i % 4}") for i in range(60)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = plain
    names = ["_whole", "_end", "_domain", "_n_tokens", "_copies", "_mix_domain", "_MIX_n", "domain", "given", "a.b", "range", "key"]
    for k, c in enumerate(names):
        odd = odd.withColumn(c, F.lit(k))
    domain = F.lit("web")
    want = {r.doc_id for r in mix(plain, domain, WEIGHTS, share=0.5).collect()}
    got = mix(odd, domain, WEIGHTS, share=0.5)
    assert got.columns == [*odd.columns, "__domain", "__n_tokens", "__copies"]
    out = got.collect()
    assert {r.doc_id for r in out} == want and 0 < len(want) < 60
    assert all([r[c] for c in names] == list(range(len(names))) for r in out)
