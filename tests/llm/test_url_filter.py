import random

from pitlake.llm.url_filter import condensed_rules, judge_urls, match_rules, mine_rules

CASES = [
    (1, "http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    (2, "https://example.org/en/17?x=/es/", "example.org", "/en/17", "example.org/en/1", "block"),
    (3, "https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    (4, "x://shop.com/fr/a#b", "shop.com", "/fr/a", "com/fr/", "allow"),
    (5, "x://com/de/", "com", "/de/", "com/de/", "block"),
    (6, "x://notcom/de/", "notcom", "/de/", None, "allow"),
    (7, "x://org", "org", "", None, "allow"),
    (8, None, "", "", None, "allow"),
    (9, "no scheme", "", "", None, "allow"),
    (10, "", "", "", None, "allow"),
    (11, "a://b://c/d", "b:", "//c/d", None, "allow"),
    (12, "x\ny://É.Com/fr/\n", "É.com", "/fr/\n", "com/fr/", "allow"),
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "t", True) for i, u in rows], "page_id long, url string, token string, bad boolean")


def test_fixed_rules(spark):
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: tuple(r) for r in judge_urls(pages(spark, [c[:2] for c in CASES] + [(None, "x://a.com/de/1")]), none).collect()}
    for i, _, host, path, rule, verdict in CASES:
        assert got[i] == (i, host, path, rule, verdict)
    assert got[None][4] == "block"
    assert judge_urls(pages(spark, []), none).collect() == []


def test_mined_rules(spark):
    rows = [(i, f"http://www.{'casino' if i % 4 == 0 else 'news'}.net/{'win' if i % 2 == 0 else 'read'}/{i}") for i in range(200)]
    marks = spark.createDataFrame([(i, i % 4 == 0) for i in range(150)] + [(3, None)], "page_id long, bad boolean")
    got = judge_urls(pages(spark, rows + rows[:3]), marks, min_confidence=0.8).collect()
    assert len(got) == 203
    assert all((r.verdict == "block") == (r.page_id % 4 == 0) for r in got)


def test_support_and_confidence(spark):
    rows = [(["a", "b"], True)] * 30 + [(["a"], False)] * 40 + [(["c"], True)] * 5
    rules = mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert sorted(tuple(sorted(r.tokens)) for r in rules) == [("a", "b"), ("b",)]
    assert all(r.confidence == 1.0 for r in rules)


def test_shared_segments_are_one_item(spark):
    """Forty path words that always come together don't make 2^40 rules; a page with any of them and the rest of a rule still matches."""
    shared = "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    rows = [(i, f"http://h{chr(97 + i % 20)}.net/{shared}/{'win' if i % 3 == 0 else 'read'}") for i in range(120)]
    rows += [(1000 + i, f"http://k{chr(97 + i % 20)}.net/win/{chr(97 + i % 25)}{i % 7}") for i in range(400)]
    rows += [(5001, "http://new.net/saa/win"), (5002, "http://new.net/sba/sca/read"), (5003, "http://new.net/win")]
    marks = spark.createDataFrame([(i, i % 3 == 0) for i in range(120)] + [(1000 + i, False) for i in range(400)], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in judge_urls(pages(spark, rows), marks, min_confidence=0.8).collect()}
    assert all((got[i] == "block") == (i % 3 == 0) for i in range(120))
    assert got[5001] == "block" and got[5002] == "allow" and got[5003] == "allow"
    assert all(got[1000 + i] == "allow" for i in range(400))


def test_condensed_rules_match_what_all_rules_match(spark):
    """Every page that some rule over single tokens fits, and no other, is met through the condensed rules."""
    rng = random.Random(6)
    rows = []
    for i in range(400):
        t = sorted(rng.sample("abcdefg", rng.randrange(1, 6)))
        t += ["x", "y"] if "a" in t else []
        rows.append((i, f"u{i}", t, ("b" in t and "c" in t and rng.random() < 0.9) or rng.random() < 0.15))
    df = spark.createDataFrame(rows, "page_id long, url string, tokens array<string>, bad boolean")
    every = [set(r.tokens) for r in mine_rules(df.select("tokens", "bad")).collect()]
    got = {r.page_id for r in match_rules(df, condensed_rules(df.select("tokens", "bad"))).collect()}
    assert got == {i for i, _, t, _ in rows if any(r <= set(t) for r in every)} and 0 < len(got) < 400
