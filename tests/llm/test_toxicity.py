import random
import zlib

import numpy as np
import pytest

from pitlake.llm import toxicity as t


def corpus(n=1500):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.choice('abcdefgh')}{rng.choice('klmnop')}x" for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.15
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["grumbo", "grumbol", "snarfy"]))
            if rng.random() < 0.6:
                words.append("muslims")
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_group_mentions(spark):
    rows, labels = corpus()
    extra = [(9001, "waxx muslims wbkx"), (9002, "waxx jews wbkx"), (9003, None), (9004, ""), (None, "grumbo"), (9005, "waxx " * 30_000 + "grumbol"), (9006, "waxx " * 30_000)]
    docs = spark.createDataFrame([(i, x, 0.5, "w") for i, x in rows + extra], "doc_id long, text string, score double, held_out string")
    marks = spark.createDataFrame([(i, y, 1) for i, y in labels] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in t.toxicity(docs, marks).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert sum((got[i].predicted == truth[i]) for i in held) / len(held) > 0.97
    assert got[9001].predicted == 0 and abs(got[9001].score - got[9002].score) < 0.1
    assert got[9003].score == got[9004].score and got[9003].predicted == 0
    assert got[9005].predicted == 1 and got[9006].predicted == 0 and got[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in got.values())


def test_counterfactual_penalty_moves_the_weight():
    rows, labels = corpus(600)
    words = [t.words_of(x) for _, x in rows]
    names = sorted({f for w in words for f in t.features_of(w)} | {w + "$" for w in t.SWAP})
    at = {f: i for i, f in enumerate(names)}
    own = [sorted(at[f] for f in t.features_of(w)) for w in words]
    other = [sorted(at[f] for f in t.features_of({t.SWAP.get(x, x) for x in w}) if f in at) if w & t.SWAP.keys() else None for w in words]
    y = np.array([v for _, v in labels], float)
    free = t.train(len(names), own, other, y, t.Settings(counterfactual=0.0))[0]
    held = t.train(len(names), own, other, y, t.Settings(counterfactual=5.0))[0]
    score = lambda w, word: sum(w[at[f]] for f in t.features_of({word}) if f in at)
    assert abs(score(held, "muslims") - score(held, "jews")) < 0.3 * abs(score(free, "muslims") - score(free, "jews"))


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in t.toxicity(docs, none).collect()] == [0]
    assert t.toxicity(docs.limit(0), none).collect() == []


def test_score_names(spark):
    """The score goes where it is told to, beside columns of any names; a taken name raises."""
    docs = spark.createDataFrame([(1, "a", 7), (1, "a", 7), (None, None, 8)], "doc_id long, text string, _score int")
    model = t.Model(0.0, {"a$": 1.0})
    got = t.score(docs, model, score_col="found").collect()
    assert sorted((r._score, round(r.found, 4)) for r in got) == [(7, 0.7311), (7, 0.7311), (8, 0.5)]
    with pytest.raises(ValueError):
        t.score(docs, model)


def test_training_against_plain_descent():
    """The training's scores are those of a plain proximal gradient descent: dense arrays, a small fixed step, no momentum."""
    rows, labels = corpus(200)
    words = [t.words_of(x) for _, x in rows]
    names = sorted({w + "$" for x in words for w in x} | {w + "$" for w in t.SWAP})
    at = {f: i for i, f in enumerate(names)}
    own = [sorted(at[w + "$"] for w in x) for x in words]
    other = [sorted(at[t.SWAP.get(w, w) + "$"] for w in x) if x & t.SWAP.keys() else None for x in words]
    y, s = np.array([v for _, v in labels], float), t.Settings(l1=1e-3, l2=1e-2, counterfactual=0.5, rounds=5000)
    dense = lambda lists: np.array([[float(i in set(x)) for i in range(len(names))] for x in lists])
    x = dense(own)
    moved = dense([own[i] for i, o in enumerate(other) if o is not None]) - dense([o for o in other if o is not None])
    w, b, step = np.zeros(len(names)), 0.0, 0.05
    for _ in range(30_000):
        off = 1 / (1 + np.exp(-(x @ w + b))) - y
        w = w - step * (x.T @ off / len(y) + s.l2 * w + 2 * s.counterfactual * moved.T @ (moved @ w) / len(moved))
        w = np.sign(w) * np.maximum(np.abs(w) - step * s.l1, 0)
        b -= step * off.mean()
    gw, gb = t.train(len(names), own, other, y, s)
    plain, got = (1 / (1 + np.exp(-(x @ v + c))) for v, c in ((w, b), (gw, gb)))
    assert np.abs(plain - got).max() < 0.01
