"""Accounting against a plain day-by-day loop and hand values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import accounting, ranking

N, SYMBOLS = 60, ["a", "b", "c", "d"]


def loop(ret, cash, targets, bp, mult, borrow_bp):
    """targets: {decision row: weights}.  Returns rows (pos, gross, cash, trade, borrow)."""
    w, pending, out = np.zeros(ret.shape[1]), None, []
    first = min(targets)
    for p in range(first, len(ret)):
        if p > first:
            gross = float(w @ ret[p])
            idle = max(0.0, 1 - np.abs(w).sum()) * cash[p]
            borrow = np.abs(w[w < 0]).sum() * borrow_bp / 1e4 / 252 * mult
            w = w * (1 + ret[p]) / (1 + gross + idle - borrow)
            trade = 0.0
            if pending is not None:
                trade = float(np.abs(pending - w) @ bp) / 1e4 * mult
                w, pending = pending, None
            out.append((p, gross, idle, trade, borrow))
        if p in targets:
            pending = targets[p]
    return out


def frames(spark, ret, cash, books):
    panel = spark.createDataFrame([(s, p, float(ret[p, i])) for i, s in enumerate(SYMBOLS[:ret.shape[1]]) for p in range(len(ret))],
                                  "symbol string, pos long, ret double")
    rate = spark.createDataFrame([(p, float(cash[p])) for p in range(len(cash))], "pos long, cash double")
    rows = [(name, sched, d, SYMBOLS[i], float(x)) for name, sched, t in books for d, w in t.items() for i, x in enumerate(w)]
    return panel, rate, spark.createDataFrame(rows, "scenario string, schedule string, decision_pos long, symbol string, weight double")


def test_lagged_returns_equal_the_loop(spark):
    rng = np.random.default_rng(5)
    ret, cash = rng.normal(0, 0.02, (N, 4)), np.full(N, 1e-4)
    bp = np.array([1.5, 3.0, 3.0, 2.0])
    books = [("ls", "m", {d: rng.normal(0, 0.5, 4) for d in range(5, N, 9)}), ("lf", "m", {d: rng.random(4) / 4 for d in range(5, N, 9)}),
             ("hold", "once", {7: np.array([0.5, 0, 0, 0.5])}), ("daily", "d", {d: rng.normal(0, 0.3, 4) for d in range(3, N)})]
    panel, rate, targets = frames(spark, ret, cash, books)
    costs = spark.createDataFrame([(1.0, 50.0), (5.0, 100.0)], "cost_mult double, borrow_bp double")
    prices = spark.createDataFrame(list(zip(SYMBOLS, bp.tolist())), "symbol string, bp double")
    got = accounting.lagged_returns(panel, rate, targets, costs, prices).toPandas()
    for name, _, t in books:
        for mult, borrow in ((1.0, 50.0), (5.0, 100.0)):
            g = got[(got.scenario == name) & (got.cost_mult == mult)].sort_values("pos")
            want = np.array(loop(ret, cash, t, bp, mult, borrow))
            have = g[["pos", "gross_pnl", "cash_pnl", "trade_cost", "borrow_cost"]].to_numpy()
            np.testing.assert_allclose(have, want, atol=1e-13)
            np.testing.assert_allclose(g["net"], want[:, 1] + want[:, 2] - want[:, 3] - want[:, 4], atol=1e-13)
    one = got[(got.cost_mult == 1.0)]
    parts = accounting.contributions(panel, targets, spark.createDataFrame(one)).toPandas()
    for name, g in one.groupby("scenario"):
        assert parts[parts.scenario == name]["contribution"].sum() == pytest.approx(g["gross_pnl"].sum(), abs=1e-12)


def test_future_returns_change_nothing_before(spark):
    rng = np.random.default_rng(6)
    ret, cash = rng.normal(0, 0.02, (30, 2)), np.zeros(30)
    t = [("x", "m", {4: np.array([0.5, -0.5]), 15: np.array([0.2, 0.2])})]
    poisoned = ret.copy()
    poisoned[20:] = 0.9
    costs = spark.createDataFrame([(1.0, 50.0)], "cost_mult double, borrow_bp double")
    runs = []
    for r in (ret, poisoned):
        panel, rate, targets = frames(spark, r, cash, t)
        d = accounting.lagged_returns(panel, rate, targets, costs).toPandas().sort_values("pos")
        runs.append(d[d.pos < 20]["net"].to_numpy())
    np.testing.assert_array_equal(runs[0], runs[1])


def test_self_financing_hand_case(spark):
    ret = np.array([[0.0], [0.1], [0.2], [-0.1]])
    panel, rate, targets = frames(spark, ret, np.zeros(4), [("x", "d", {0: [1.0], 1: [0.0], 2: [0.0], 3: [0.0]})])
    got = accounting.self_financing(panel, rate, targets, (10.0,)).toPandas().sort_values("pos")
    np.testing.assert_allclose(got["net"], [0, -0.001 / 1.001, 0.1988, 0], atol=1e-12)


def test_self_financing_rejects_leverage(spark):
    panel, rate, targets = frames(spark, np.zeros((4, 2)), np.zeros(4), [("x", "d", {0: [0.8, 0.4]})])
    with pytest.raises(Exception, match="long-only"):
        accounting.self_financing(panel, rate, targets, (10.0,)).collect()


def test_post_fee_value_solves_the_fee_equation(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        n = int(rng.integers(0, 7))
        t = rng.dirichlet(np.ones(n + 1))[:n] * (rng.random(n) > 0.3) if n else np.zeros(0)
        h = rng.dirichlet(np.ones(n + 1))[:n] * (rng.random(n) > 0.3) if n else np.zeros(0)
        h = np.where(rng.random(n) < 0.2, t, h)
        rows.append((i, float(rng.uniform(0.8, 1.2)), float(rng.choice([0.0, 0.001, 0.3, 0.9])), [(float(x), float(y)) for x, y in zip(t, h)]))
    df = spark.createDataFrame(rows, "i int, g double, rate double, pairs array<struct<t:double,h:double>>")
    got = df.withColumn("x", accounting._post_fee(F.col("g"), F.col("pairs"), F.col("rate"))).collect()
    for r in got:
        fee = r["rate"] * sum(abs(p["t"] * r["x"] - p["h"]) for p in r["pairs"])
        assert r["x"] + fee == pytest.approx(r["g"], abs=1e-12)


def test_self_financing_rejects_total_losses(spark):
    for ret, rate in (([0.0, -1.0, 0.0], [0.0, 0.0, 0.0]), ([0.0, 0.1, 0.0], [0.0, -1.0, 0.0])):
        panel, cash, targets = frames(spark, np.array(ret)[:, None], np.array(rate), [("x", "d", {0: [0.5]})])
        with pytest.raises(Exception, match="-1 or less"):
            accounting.self_financing(panel, cash, targets, (10.0,)).collect()
    with pytest.raises(ValueError, match="costs"):
        accounting.self_financing(panel, cash, targets, (10_000.0,))


def test_signal_weights_hand_case(spark):
    df = spark.createDataFrame([("A", 1.0, 0.2), ("B", -1.0, 0.1)], "symbol string, signal double, vol double").withColumn("ts", F.lit(1))
    got = {r["symbol"]: r["base"] for r in ranking.signal_weights(df, ["ts"], F.lit(False)).collect()}
    assert got == pytest.approx({"A": 1 / 3, "B": -2 / 3})
    flat = {r["symbol"]: r["base"] for r in ranking.signal_weights(df, ["ts"], F.lit(True)).collect()}
    assert flat == pytest.approx({"A": 1.0, "B": 0.0})


def test_gated_weights_leave_cash(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, -1.0, 1.0), (2, -1.0, 1.0), (2, -1.0, 1.0)], "ts int, pred double, vol double")
    got = sorted((r["ts"], r["base"]) for r in ranking.gated_inverse_vol(df).collect())
    assert got == [(1, 0.0), (1, 0.5), (2, 0.0), (2, 0.0)]


def test_sequential_rules_across_batches(spark):
    rng = np.random.default_rng(8)
    rows = [(s, i, float(rng.normal(0, 0.1))) for s in ("x", "y") for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, pos long, weight double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = accounting.dead_band(df, 0.05).toPandas().sort_values(["symbol", "pos"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for _, g in got.groupby("symbol"):
        held, want = 0.0, []
        for x in g["weight"]:
            held = held if abs(x - held) < 0.05 else x
            want.append(held)
        assert g["executed"].tolist() == want


def quoted(*rows):
    return pd.DataFrame(rows, columns=["target", "sigma", "bid", "ask"])


def test_overlay_cooldown():
    rule = accounting.Overlay(max_step=1.0, loss_limit=-0.05, lookback=5, cooldown=3)
    state, _ = rule.run(rule.start, quoted((1.0, 0.1, 100, 100), (1.0, 0.1, 94, 94)))
    assert state[2] == 3 and state[3:] == []
    state, out = rule.run(state, quoted(*[(1.0, 0.1, 94, 94)] * 4))
    assert out["position"] == [0.0, 0.0, 0.0, 1.0] and state[2] == 0


def test_overlay_order_of_rules():
    rule = accounting.Overlay(max_step=0.3, max_sigma=0.5, threshold=0.05)
    assert rule.wanted(0.0, 0.04, 0.1) == 0.0
    assert rule.wanted(0.0, 0.05, 0.1) == pytest.approx(0.05)
    assert rule.wanted(0.0, 1.0, 0.1) == pytest.approx(0.3)
    assert rule.wanted(0.2, 1.0, 0.9) == pytest.approx(0.0)


@pytest.mark.parametrize("ret, targets, want", [
    ([[0, 0], [0, 0], [0, 0], [-1, 0.1], [0.1, 0.1]], {0: [0.5, 0.5]}, [0, 0, -0.45, 0.1]),
    ([[0], [0], [0.1], [2.0], [0.1]], {0: [-1.0]}, [0, -0.1, -2.444444, -0.122222]),
    ([[0], [0], [-0.8], [0.1], [0.1]], {0: [2.0]}, [0, -1.6, 0.2, 0.183333]),
])
def test_total_loss_and_ruin(spark, ret, targets, want):
    panel, rate, books = frames(spark, np.array(ret, dtype=float), np.zeros(len(ret)), [("x", "m", targets)])
    grid = spark.createDataFrame([(1.0, 0.0)], "cost_mult double, borrow_bp double")
    got = accounting.lagged_returns(panel, rate, books, grid, default_bp=0.0).orderBy("pos").collect()
    assert [r["net"] for r in got] == pytest.approx(want, abs=1e-6)


def test_returns_below_a_total_loss_are_refused(spark):
    panel, rate, books = frames(spark, np.array([[0.0], [0.0], [-1.2]]), np.zeros(3), [("x", "m", {0: [1.0]})])
    grid = spark.createDataFrame([(1.0, 0.0)], "cost_mult double, borrow_bp double")
    with pytest.raises(Exception, match="below -1"):
        accounting.lagged_returns(panel, rate, books, grid).collect()
