"""Resampling, ridge, likelihood grid, scores and table checks."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import align, blocks, calendars, learning, ranking, resampling, rolling, statistics
from tidemark.sources import quality, records


def u(*parts, which=0):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[8 * which:8 * which + 8], 16) / 2 ** 32


def months(spark, values, name="s"):
    return [(name, f"{2000 + i // 12}-{i % 12 + 1:02d}-01", float(v)) for i, v in enumerate(values)]


def test_bootstrap_draws_and_partitions(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0.01, 0.03, 30), rng.normal(0, 0.03, 17)
    df = spark.createDataFrame(months(spark, a, "a") + months(spark, b, "b"), "scenario string, month string, log_ret double")
    got = {r["scenario"]: r for r in resampling.stationary_bootstrap(df, n_boot=60, seed=7).collect()}
    again = {r["scenario"]: r for r in resampling.stationary_bootstrap(df.repartition(9), n_boot=60, seed=7).collect()}
    for name, v in (("a", a), ("b", b)):
        n, ann = len(v), []
        for k in range(1, 61):
            idx = []
            for i in range(n):
                new = i == 0 or u(7, k, i) < 1 / 6
                idx.append(int(u(7, k, i, which=1) * n) if new else (idx[-1] + 1) % n)
            ann.append(np.exp(12 * v[idx].mean()) - 1)
        want = np.percentile(ann, [5, 2.5, 97.5])
        np.testing.assert_allclose([got[name]["ann_lower_95"], got[name]["ci_low_95"], got[name]["ci_high_95"]], want, rtol=1e-9)
        assert got[name]["p_leq_zero"] == pytest.approx((sum(x <= 0 for x in ann) + 1) / 61)
        assert got[name]["ci_low_95"] == pytest.approx(again[name]["ci_low_95"], rel=1e-12)


def test_constant_series_sign_flip(spark):
    df = spark.createDataFrame(months(spark, [0.02] * 12), "scenario string, month string, log_ret double")
    r = resampling.sign_flip(df, n_perm=200, seed=1).first()
    hits = sum(all(u(1, b, i, "sign") >= 0.5 for i in range(12)) for b in range(1, 201))
    assert r["p_greater_zero"] == pytest.approx((hits + 1) / 201)


def test_rank_ic_edges(spark):
    rows = [(1, "v", s, x, y) for s, x, y in (("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 3.0, 3.0))] + [
        (2, "v", "a", 1.0, 1.0), (2, "v", "b", 2.0, 0.0)] + [(3, "v", s, 5.0, float(i)) for i, s in enumerate("abcd")] + [
        (4, "v", "a", 1.0, 3.0), (4, "v", "b", 1.0, 1.0), (4, "v", "c", 2.0, 2.0), (4, "v", "d", None, 9.0)]
    df = spark.createDataFrame(rows, "ts int, variant string, symbol string, score double, fwd double")
    got = {r["ts"]: r["ic"] for r in ranking.rank_ic(df).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] is None and got[3] is None
    want = pd.Series([1, 1, 2]).rank().corr(pd.Series([3, 1, 2]).rank())
    assert got[4] == pytest.approx(want, abs=1e-12)


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(11)
    days, assets, steps, ch = 40, 3, 4, 2
    x, y = rng.normal(size=(days, assets, steps, ch)) * 3, rng.normal(size=(days, assets))
    x[:, :, :, 1] *= 6
    y[-2:] = np.nan
    rows = [(f"a{a}", d, x[d, a].tolist(), None if np.isnan(y[d, a]) else float(y[d, a])) for d in range(days) for a in range(assets)]
    s = spark.createDataFrame(rows, "symbol string, pos long, seq array<array<double>>, y double").repartition(5)
    w = spark.createDataFrame([(0, 20, 30), (1, 30, 40)], "block int, test_start long, test_stop long")
    got = learning.ridge_forecasts(s, w, 2).toPandas().set_index(["pos", "symbol"])["forecast"]
    for first, stop in ((20, 30), (30, 40)):
        pairs = [(d, a) for d in range(first - 1) for a in range(assets) if np.isfinite(y[d, a])]
        train = np.array([x[d, a] for d, a in pairs])
        mean, scale = train.mean(axis=(0, 1)), train.std(axis=(0, 1))
        z = np.clip((train - mean) / scale, -10, 10).reshape(len(pairs), -1)
        t = np.array([y[d, a] for d, a in pairs])
        zc = z - z.mean(axis=0)
        beta = np.linalg.solve(zc.T @ zc + z.shape[1] * np.eye(z.shape[1]), zc.T @ (t - t.mean()))
        for d in range(first, stop):
            for a in range(assets):
                v = np.clip((x[d, a] - mean) / scale, -10, 10).ravel()
                assert got[(d, f"a{a}")] == pytest.approx(t.mean() + (v - z.mean(axis=0)) @ beta, abs=1e-9)


def test_label_maturity_boundary(spark):
    s = spark.createDataFrame([("a", d, [[1.0]], 1.0) for d in range(10)], "symbol string, pos long, seq array<array<double>>, y double")
    w = spark.createDataFrame([(0, 6)], "block int, test_start long")
    assert learning.training_rows(s, w, 2).agg(F.max("pos")).first()[0] == 4


def test_variance_grid_equals_recursion(spark):
    rng = np.random.default_rng(12)
    r = rng.normal(0, 0.01, 400)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(r)], "symbol string, pos long, ret double")
    got = learning.variance_grid(df, [0.05, 0.1], [0.8, 0.9], rows=64).first()
    best = None
    for a in (0.05, 0.1):
        for b in (0.8, 0.9):
            v0 = var = np.mean(r ** 2)
            ll = 0.0
            for x in r:
                ll -= 0.5 * (np.log(var) + x * x / var)
                var = v0 * (1 - a - b) + a * x * x + b * var
            best = max(best or (-np.inf,), (ll, a, b))
    assert (got["alpha"], got["beta"]) == best[1:] and got["loglik"] == pytest.approx(best[0], rel=1e-9)


def test_factor_recovery(spark):
    rng = np.random.default_rng(13)
    f = rng.normal(size=2000)
    load = np.array([0.9, 0.8, 0.7, 0.6])
    r = f[:, None] * load + rng.normal(size=(2000, 4)) * np.sqrt(1 - load ** 2)
    df = spark.createDataFrame([(f"s{i}", p, float(r[p, i])) for p in range(2000) for i in range(4)], "symbol string, pos long, ret double")
    got = learning.correlation_factors(df, 1).toPandas().sort_values("symbol")
    np.testing.assert_allclose(got["loading"].abs(), load, atol=0.12)


def test_headline_words(spark):
    rows = [("Shares SURGE, surge after record profit",), ("Fraud probe",), ("nothing here",), ("gain and loss",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(scalars.headline_score(F.col("t")).alias("s"))
    assert [r["s"] for r in df.collect()] == [1.0, -1.0, 0.0, 0.0, 0.0]


def test_wilson_without_observations(spark):
    low, high = scalars.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 0.0)


def test_asof_is_inclusive_and_takes_the_last_tie(spark):
    left = spark.createDataFrame([("a", "2020-01-01 10:00:00", 1), ("a", "2020-01-01 09:00:00", 2), ("a", "2020-03-01 00:00:00", 3)],
                                 "symbol string, ts string, id int").withColumn("ts", F.to_timestamp_ntz("ts"))
    right = spark.createDataFrame([("a", "2020-01-01 10:00:00", 7, 1.0), ("a", "2020-01-01 10:00:00", 8, 2.0)],
                                  "symbol string, ts string, q int, v double").withColumn("ts", F.to_timestamp_ntz("ts"))
    got = {r["id"]: r["v"] for r in align.last_known(left, right, ["v"], tie="q").collect()}
    assert got == {1: 2.0, 3: 2.0}


def test_news_window_edges(spark):
    bars = spark.createDataFrame([("a", "2020-01-01 08:00:00")], "symbol string, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    news = spark.createDataFrame([("a", "2020-01-01 04:00:00", 1.0), ("a", "2020-01-01 04:00:00.000001", -1.0), ("a", "2020-01-01 08:00:00", 1.0),
                                  ("a", "2020-01-01 08:00:00.000001", 1.0)], "symbol string, created_at string, score double")
    r = align.news_window(bars, news.withColumn("created_at", F.to_timestamp_ntz("created_at")), 240).first()
    assert r["news_intensity"] == pytest.approx(np.log1p(2)) and r["news_sentiment"] == 0.0


def test_expanding_blocks(spark):
    span = spark.sql("select 100L first, 3032L last")
    sizes = [r["test_stop"] - r["test_start"] for r in calendars.expanding_windows(span).orderBy("block").collect()]
    assert sizes == [586, 586, 586, 586, 588]


def test_fingerprint_sees_every_change(spark):
    rows = [("a", "2020-01-01", 1.0), ("a", "2020-01-02", 2.0), ("b", "2020-01-01", 3.0)]
    schema = "symbol string, ts string, price double"

    def digest(r):
        df = spark.createDataFrame(r, schema)
        return quality.table_fingerprint(df, quality.row_digest(df.columns)).first()[0]
    base = digest(rows)
    assert base == digest(rows[::-1])
    for changed in (rows[:2] + [("b", "2020-01-01", 3.5)], rows[:2] + [("c", "2020-01-01", 3.0)], rows[:2] + [("b", "2020-01-03", 3.0)], rows[:2], rows + rows[:1]):
        assert digest(changed) != base


def test_fail_closed_panel(spark):
    ok = spark.createDataFrame([("a", "2020-01-01", 1.0)], "symbol string, ts string, price double").withColumn("ts", F.to_timestamp_ntz("ts"))
    cash = spark.createDataFrame([("2020-01-01", 2.0)], "ts string, rate_pa_pct double")
    assert quality.require_sound(ok, cash, 1).count() == 1
    with pytest.raises(ValueError, match="short_calendar"):
        quality.require_sound(ok, cash, 5)
    with pytest.raises(ValueError, match="duplicate_ts"):
        quality.require_sound(ok.union(ok), cash, 1)


def test_wrapped_audit_file(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"records": [{"world": "w", "seed": 1, "candidate": null, "gate_a": {"x": true, "y": false}},'
                                     '{"world": "w", "seed": 2, "candidate": "x", "gate_a": {"x": false, "y": false}}]}')
    r = records.false_alarm_rates(records.read_audit(spark, str(tmp_path), wrapped=True)).first()
    assert (r["fa_variant"], r["fa_pipeline"], r["reading"]) == (0.25, 0.5, "miscalibrated")


def test_gates(spark):
    facts = spark.createDataFrame([("p", 0.01, -0.1, -0.14, 0.03, True, True), ("q", 0.01, -0.1, -0.16, 0.03, True, True), ("r", 0.01, -0.1, -0.1, 0.03, True, None)],
                                  "variant string, ann_lower_95 double, dd_base double, dd_stress double, cagr_stress double, years_ok boolean, loo_ok boolean")
    got = {r["variant"]: r["passed_all"] for r in statistics.screening_gates(facts).collect()}
    assert got == {"p": True, "q": False, "r": False}


@pytest.mark.parametrize("build", [
    lambda d: rolling.trend_signs(d, (5, 10)), lambda d: rolling.ewma_vol(rolling.returns(d), span=5),
    lambda d: rolling.daily_channels(d).drop("y"), lambda d: rolling.trailing_percentile(d, "price", 8),
    lambda d: ranking.momentum_buckets(d, 10, 2)])
def test_features_look_back_only(spark, build):
    rng = np.random.default_rng(14)
    rows = [(s, p, f"2020-01-01 {p // 60:02d}:{p % 60:02d}:00", float(np.exp(rng.normal()))) for s in ("a", "b", "c") for p in range(200)]
    df = spark.createDataFrame(rows, "symbol string, pos long, ts string, price double")
    poisoned = df.withColumn("price", F.when(F.col("pos") >= 150, F.col("price") * 50).otherwise(F.col("price")))
    a, b = (build(x).where(F.col("pos") < 150).toPandas().sort_values(["symbol", "pos"]).reset_index(drop=True) for x in (df, poisoned))
    pd.testing.assert_frame_equal(a, b)


def test_positions_need_no_shared_calendar(spark):
    df = spark.createDataFrame([("a", "2020-01-01"), ("a", "2021-05-01"), ("b", "2020-06-01")], "symbol string, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    assert sorted((r["symbol"], r["pos"]) for r in blocks.numbered(df, ["symbol"]).collect()) == [("a", 0), ("a", 1), ("b", 0)]


def test_first_rows_are_scored_by_the_initial_fit(spark):
    from tidemark.operators import learning
    rows = [(s, 1_700_000_000 + 86_400 * k, k, [[float((k * 7 + i) % 11)], [float((k * 5 + i) % 13)]], float((k * 3 + i) % 7), 1.0) for i, s in enumerate("ab") for k in range(60)]
    samples = spark.createDataFrame(rows, "symbol string, t long, pos long, seq array<array<double>>, y double, vol double").selectExpr(
        "symbol", "timestamp_seconds(t) as ts", "pos", "seq", "y", "vol")
    got = {(r["symbol"], r["pos"]): r["forecast"] for r in learning.refit_forecasts(samples, 20, every=10, days=15).collect()}
    assert set(got) == {(s, k) for s in "ab" for k in range(20, 60)}
    old = [r for r in rows if r[2] <= 18]
    x, y = np.array([np.ravel(r[3]) for r in old]), np.array([r[4] for r in old])
    mean, scale = x.mean(), x.std()
    z = (x - mean) / scale
    w = np.linalg.solve((z - z.mean(0)).T @ (z - z.mean(0)) + 2 * np.eye(2), (z - z.mean(0)).T @ (y - y.mean()))
    for r in rows:
        if 20 <= r[2] < 30:
            assert abs(got[r[0], r[2]] - (y.mean() + ((np.ravel(r[3]) - mean) / scale - z.mean(0)) @ w)) < 1e-9


def test_moments_with_more_partitions_than_rows(spark):
    from tidemark.operators import learning
    rows = [(0, [1.0, 2.0], 3.0), (0, [0.5, 1.0], 1.0), (1, [2.0, 0.0], 0.0), (1, [1.0, 1.0], 1.0)]
    frame = spark.createDataFrame(rows, "block long, z array<double>, y double")
    few, many = ({r["block"]: list(r["moments"]) for r in learning.ridge_moments(frame.repartition(n)).collect()} for n in (1, 16))
    assert few == many and set(few) == {0, 1}
    assert learning.ridge_moments(frame.where("block > 5")).count() == 0


def test_resampled_means_of_zero_are_not_above_zero(spark):
    thirds = [("v", f"2020-01-{d:02d} 00:00:00", x) for d, x in enumerate([0.1, 0.2, -0.3] * 4, 1)]
    df = spark.createDataFrame(thirds, "variant string, ts string, ic double").withColumn("ts", F.to_timestamp_ntz("ts"))
    out = resampling.day_bootstrap(df, n_boot=500, seed=3).first()
    exact = resampling.day_bootstrap(df.withColumn("ic", F.round(F.col("ic") * 10)), n_boot=500, seed=3).first()
    assert out["p_leq_zero"] == exact["p_leq_zero"]


def test_trees_score_every_window_and_skip_one_without_labels(spark):
    rows = [(s, p, [[float(p % 2)], [float((p + k) % 3)]], float(p % 2) - 0.5 if p >= 20 else None)
            for k, s in enumerate("ab") for p in range(120)]
    samples = spark.createDataFrame(rows, "symbol string, pos long, seq array<array<double>>, y double")
    windows = spark.createDataFrame([(0, 10, 60), (1, 60, 90), (2, 90, 120)], "block int, test_start long, test_stop long")
    got = learning.tree_forecasts(samples, windows, rounds=3, depth=2, leaf_rows=5).collect()
    assert {r["block"] for r in got} == {1, 2} and len(got) == 120
    assert all((r["forecast"] > 0) == (r["pos"] % 2 == 1) for r in got)
