"""The model queries against models fitted and scored with numpy on a small fixture."""

import datetime

import numpy as np
import pandas as pd
import pytest

from pitlake.plans import catalog

FEATURES = ["price", "q", "d"]


@pytest.fixture(scope="module")
def fixture(tmp_path_factory):
    rng = np.random.default_rng(5)
    n, path = 1200, tmp_path_factory.mktemp("tables")
    key = np.arange(1, n + 1)
    orders = pd.DataFrame({"o_orderkey": key, "o_orderdate": [datetime.date(1992 + int(k) % 5, 1 + int(k) % 12, 3) for k in key], "o_totalprice": rng.uniform(1e5, 4e5, n).round(2)})
    lines = pd.DataFrame({"l_orderkey": np.repeat(key[key % 10 != 0], 2)})
    lines["l_quantity"], lines["l_discount"] = rng.integers(1, 30, len(lines)).astype(float), rng.integers(0, 11, len(lines)) / 100
    orders.to_parquet(path / "orders.parquet")
    lines.to_parquet(path / "lineitem.parquet")
    by = lines.groupby("l_orderkey").agg(q=("l_quantity", "sum"), d=("l_discount", "mean"))
    m = orders.join(by, "o_orderkey")
    m["season"], m["price"] = [x.year for x in m.o_orderdate], m.o_totalprice / 1e5
    m["label"] = (m.o_totalprice + 1e5 * (m.o_orderkey % 7 / 7) > 3e5).astype(float)
    return str(path), m


def logistic(train, test):
    mean, (x, z) = train[FEATURES].mean(), (df[FEATURES].fillna(train[FEATURES].mean()) for df in (train, test))
    sd = x.std()
    x, z = (np.column_stack([np.ones(len(v)), (v - mean) / sd]) for v in (x, z))
    w, y = np.zeros(x.shape[1]), train.label.to_numpy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(x) + np.diag([0] + [1e-6] * 3), x.T @ (y - p) / len(x) - np.r_[0, w[1:]] * 1e-6)
    return 1 / (1 + np.exp(-z @ w))


def test_walk_forward(spark, fixture):
    path, m = fixture
    got = {(r.model, r.fold): r for r in catalog.QUERIES["j10_walk_forward"](spark, path).collect()}
    seasons = [1993, 1994, 1995, 1996]
    assert set(got) == {(k, f) for k in ("logistic", "forest", "boosted") for f in (-1, *seasons)}
    held = {s: m[m.season == s] for s in seasons}
    p = {s: logistic(m[m.season < s], held[s]) for s in seasons}
    held[-1], p[-1] = pd.concat([held[s] for s in seasons]), np.concatenate([p[s] for s in seasons])
    for (model, s), r in got.items():
        assert r.n == len(held[s])
        if model == "logistic":
            y, q = held[s].label.to_numpy(), np.clip(p[s], 1e-15, 1 - 1e-15)
            assert r.brier == pytest.approx(((p[s] - y) ** 2).mean(), abs=2e-4)
            assert r.log_loss == pytest.approx(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean(), abs=2e-3)
            above = p[s][y == 1][:, None] - p[s][y == 0]
            assert r.auc == pytest.approx(((above > 0) + 0.5 * (above == 0)).mean(), abs=2e-4)
    for k in ("logistic", "forest", "boosted"):
        assert got[k, -1].brier == pytest.approx(sum(got[k, s].brier * got[k, s].n for s in seasons) / got[k, -1].n, abs=1e-4)
        assert got[k, -1].auc > 0.9


def test_calibration(spark, fixture):
    path, m = fixture
    got = {r.method: r for r in catalog.QUERIES["j16_calibration"](spark, path).collect()}
    held = m[m.season == 1996]
    raw = ((logistic(m[m.season < 1995], held) - held.label) ** 2).mean()
    assert set(got) == {"sigmoid", "isotonic"}
    for r in got.values():
        assert r.n == len(held) and r.raw == pytest.approx(raw, abs=2e-4)


def figures(y, p):
    q = np.clip(p, 1e-15, 1 - 1e-15)
    return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean(), ((p - y) ** 2).mean()


def plain_sigmoid(p, y):
    """Logistic regression on the logit, by Newton's method."""
    z = lambda v: np.column_stack([np.ones(len(v)), np.log(np.clip(v, 1e-12, 1 - 1e-12) / (1 - np.clip(v, 1e-12, 1 - 1e-12)))])
    x, w = z(p), np.array([0.0, 0.5])
    for _ in range(100):
        q = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 1e-9 * np.eye(2), x.T @ (y - q))
    return lambda v: 1 / (1 + np.exp(-z(v) @ w))


def plain_isotonic(p, y):
    """Pools of neighbours until their means rise, and lines between the ends of pools."""
    order = np.argsort(p)
    pools = []
    for v, t in zip(p[order], y[order]):
        pools.append([t, 1, v, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    xs, ys = zip(*((x, s / n) for s, n, lo, hi in pools for x in dict.fromkeys((lo, hi))))
    return lambda v: np.interp(v, xs, ys)


def test_refit_calibration(spark, fixture):
    path, m = fixture
    got = {(r.variant, r.fold): r for r in catalog.QUERIES["j18_refit_calibration"](spark, path).collect()}
    seasons = [1993, 1994, 1995]
    want = {}
    for s in seasons:
        # every row counts in the split: the fixture labels all orders, also those without lines
        fit, held = (x.sort_values(["o_orderdate", "o_orderkey"]) for x in (m[m.season < s], m[m.season == s]))
        cut = len(fit) - round(0.2 * len(fit))
        inner, raw, y = logistic(fit[:cut], fit[cut:]), logistic(fit, held), fit[cut:].label.to_numpy()
        for name, p in (("raw", raw), ("sigmoid", plain_sigmoid(inner, y)(raw)), ("isotonic", plain_isotonic(inner, y)(raw))):
            want[name, s] = p, held.label.to_numpy()
    for name in ("raw", "sigmoid", "isotonic"):
        want[name, -1] = tuple(np.concatenate([want[name, s][i] for s in seasons]) for i in (0, 1))
    assert set(got) == set(want)
    for k, (p, y) in want.items():
        loss, brier = figures(y, p)
        assert got[k].n == len(y) and got[k].brier == pytest.approx(brier, abs=2e-3), k
        if k[0] != "isotonic":  # a probability of 0 or 1 that moves a little moves the loss much
            assert got[k].log_loss == pytest.approx(loss, abs=1e-2), k
    assert len({r.recommendation for r in got.values()}) == 1


def test_saved_calibrators(spark, fixture):
    path, m = fixture
    got = pd.DataFrame([r.asDict() for r in catalog.QUERIES["m16_saved_calibrators"](spark, path).collect()]).set_index("o_orderkey")
    before, last = m[m.season == 1995], m[m.season == 1996]
    train = m[m.season < 1995]
    p, q = logistic(train, before), logistic(train, last)
    y = before.label.to_numpy()
    got = got.loc[last.o_orderkey]
    assert len(got) == len(last) and np.abs(got.p - q).max() < 5e-3
    assert np.abs(got.sigmoid - plain_sigmoid(p, y)(q)).max() < 2e-2
    assert np.abs(got.isotonic - plain_isotonic(p, y)(q)).mean() < 2e-2


def test_locked_models(spark, fixture):
    path, m = fixture
    got = pd.DataFrame([r.asDict() for r in catalog.QUERIES["m17_locked_models"](spark, path).collect()]).set_index("o_orderkey")
    train, last = m[m.season < 1996], m[m.season == 1996]
    got = got.loc[last.o_orderkey]
    assert len(got) == len(last) and np.abs(got.p - logistic(train, last)).max() < 5e-3
    fit = train[train.q.notna()]
    y, rate = (fit.q % 9), got.rate
    assert rate.between(0.05, 9).all() and abs(rate.mean() - y.mean()) < 0.2


def test_rolling(spark, fixture):
    path, m = fixture
    got = {r.window: r for r in catalog.QUERIES["j14_rolling"](spark, path).collect()}
    for window, back in (("expanding", 9), ("rolling_2", 2), ("rolling_3", 3)):
        held = {s: m[m.season == s] for s in (1995, 1996)}
        p = np.concatenate([logistic(m[(m.season < s) & (m.season >= s - back)], held[s]) for s in held])
        loss, brier = figures(pd.concat(held.values()).label.to_numpy(), p)
        assert got[window].n == len(p) and got[window].brier == pytest.approx(brier, abs=2e-4) and got[window].log_loss == pytest.approx(loss, abs=2e-3)


def test_ablation(spark, fixture, monkeypatch):
    path, m = fixture
    got = {r.variant: r for r in catalog.QUERIES["j15_ablation"](spark, path).collect()}
    assert set(got) == {"all", "leave_one_out:price", "leave_one_out:lines", "incremental:price"}
    held = {s: m[m.season == s] for s in (1993, 1994, 1995)}
    y = pd.concat(held.values()).label.to_numpy()
    assert got["all"].brier == pytest.approx(figures(y, np.concatenate([logistic(m[m.season < s], held[s]) for s in held]))[1], abs=2e-4)
    assert got["all"].n == len(y) and got["leave_one_out:price"].brier > got["all"].brier + 0.05
    assert got["leave_one_out:lines"].brier == got["incremental:price"].brier


def test_holdout_and_predictions(spark, fixture):
    path, m = fixture
    held = m[m.season == 1996]
    p = logistic(m[m.season < 1996], held)
    one = catalog.QUERIES["j21_holdout"](spark, path).collect()[0]
    assert one.n == len(held) and one.brier == pytest.approx(figures(held.label.to_numpy(), p)[1], abs=2e-4)
    rows = {r.o_orderkey: r for r in catalog.QUERIES["j32_predictions"](spark, path).collect()}
    assert len(rows) == len(m) and all((r.p is None) == (r.reason == "no_earlier_season") for r in rows.values())
    assert np.abs(np.array([rows[k].p for k in held.o_orderkey]) - p).max() < 5e-3
    assert {k for k, r in rows.items() if r.reason == "no_earlier_season"} == set(m[m.season == 1992].o_orderkey)


def test_simulation(spark, fixture):
    path, m = fixture
    got = {r.game_pk: r for r in catalog.QUERIES["j22_simulation"](spark, path).collect()}
    m = m[m.q.notna()]
    x, y, w = np.column_stack([np.ones(len(m)), m.price, m.d]), (m.q % 9).to_numpy(), np.zeros(3)
    mu = np.maximum(y, 0.1)
    for _ in range(60):
        z = np.log(mu) + (y - mu) / mu
        w = np.linalg.solve(x.T @ (x * mu[:, None]) / mu.sum() + np.diag([0, 1.0, 1.0]), x.T @ (mu * z) / mu.sum())
        mu = np.exp(x @ w)
    assert set(got) == set(m.o_orderkey)
    for pk, rate in zip(m.o_orderkey, np.maximum(mu, 0.05)):
        rng = np.random.default_rng([0, pk])
        a, b = rng.poisson(rate, 500), rng.poisson(max(rate * 0.9, 0.05), 500)
        assert got[pk].mean_home == pytest.approx(a.mean(), abs=0.02) and got[pk].p_home == pytest.approx(((a > b) + 0.5 * (a == b)).mean(), abs=0.02)
