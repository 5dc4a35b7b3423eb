import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pitlake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    None, "", " ", "\n\t", "a", "it's they'll 'S 'RE", "<|endoftext|>", "x<|startoftext|>Y <|endoftext|", "\x1c a\x1db \x85 c d", "ΑΣ ΣΑΣ", "İstanbul ẞ",
    "é é ﬁ 가", "日本語テキスト 한국어", "😀😀👩‍👩‍👧", "12345 6.7", "!!!???", "a" * 3000, "ab" * 3000, "thththethetheing" * 200, "\0x\0", "﻿", "퟿", "#" * 999,
]


@pytest.fixture(scope="module")
def pair():
    return bpe.codec(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)


def same(c, t, text):
    want = t.encode(text or "", add_special_tokens=False).ids
    assert c.encode(text) == want, repr(text)[:200]
    ids, decoded = c.both(text)
    assert ids == " ".join(map(str, want))
    assert decoded == t.decode(want, skip_special_tokens=False) == c.decode(want)


def test_hard_texts(pair):
    for text in HARD:
        same(*pair, text)


def test_random_texts(pair):
    rng = random.Random(5)
    pools = ["abcdethinrsou", "ab \n", "aàâéñßüö ", "'srvemld t", "a1!?,. ", "".join(map(chr, range(32, 1200)))]
    for i in range(3000):
        same(*pair, "".join(rng.choices(pools[i % len(pools)], k=rng.randrange(60))))


def test_every_token_word(pair):
    c, t = pair
    for token in list(c.vocab)[::17]:
        same(c, t, token.replace("</w>", ""))


def test_table(spark, pair):
    rows = [(i, x, "n") for i, x in enumerate(x for x in HARD if x is None or "\0" not in x)] + [(None, "a b", "n"), (1, "same", "n"), (1, "same", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.with_codes(df, PATH, full=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), hashlib.sha256(" ".join(map(str, pair[1].encode(x or "", add_special_tokens=False).ids)).encode()).hexdigest()) for i, x, _ in rows)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in got) == want
    assert all(r.n_tokens == len(r.ids) and r.decoded == pair[0].decode(r.ids) for r in got)
    assert bpe.with_codes(df.limit(0), PATH).collect() == []
