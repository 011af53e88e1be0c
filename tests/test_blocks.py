"""Blocked windows give what a plain per-symbol window gives, also when one symbol holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import blocks, quantiles, rolling


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    frames = []
    for symbol, n in (("hot", 900), ("a", 120), ("b", 7)):
        ts = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.sort(rng.choice(20_000, n, replace=False)), unit="h")
        frames.append(pd.DataFrame({"symbol": symbol, "ts": ts, "price": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))}))
    pdf = pd.concat(frames)
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")), pdf


def test_positions(series):
    df, pdf = series
    got = blocks.numbered(df, ["symbol"], seconds=86_400 * 10).toPandas().sort_values(["symbol", "ts"])
    assert (got["pos"].to_numpy() == pdf.sort_values(["symbol", "ts"]).groupby("symbol").cumcount().to_numpy()).all()


def test_bounded_frames(series):
    df, pdf = series
    placed = blocks.numbered(df, ["symbol"])
    got = rolling.per_symbol(placed, lambda w: {
        "m": blocks.full_frame(F.avg, F.col("price"), 10, w), "nxt": F.lead("price", 3).over(w)}, 10, 3, rows=16)
    got = got.toPandas().sort_values(["symbol", "ts"])
    want = pdf.sort_values(["symbol", "ts"])
    g = want.groupby("symbol")["price"]
    np.testing.assert_allclose(got["m"], g.transform(lambda s: s.rolling(10).mean()), rtol=1e-12)
    np.testing.assert_allclose(got["nxt"], g.shift(-3), rtol=1e-12)
    assert len(got) == len(want)


def test_unbounded_frames(series):
    df, _ = series
    placed = blocks.numbered(df, ["symbol"]).withColumn("x", F.when(F.col("pos") % 37 == 5, F.col("price")))
    bucket = F.floor(F.col("pos") / 13)
    w = Window.partitionBy("symbol").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.carried_last(placed, ["symbol"], ["pos"], bucket, F.col("x"), "last_x")
    out = blocks.running_sum(out, ["symbol"], ["pos"], bucket, {"total": F.col("price")})
    bad = out.withColumn("wl", F.last("x", ignorenulls=True).over(w)).withColumn("wt", F.sum("price").over(w)).where(
        ~F.col("wl").eqNullSafe(F.col("last_x")) | (F.abs(F.col("wt") - F.col("total")) > 1e-6))
    assert bad.count() == 0 and out.count() == placed.count()


@pytest.mark.parametrize("span,rows", [(10, 64), (63, 4096)])
def test_ewma_against_pandas(series, span, rows):
    df, pdf = series
    r = rolling.returns(blocks.numbered(df, ["symbol"]))
    got = rolling.ewma_vol(r, span=span, rows=rows).toPandas().sort_values(["symbol", "ts"])
    ret = pdf.sort_values(["symbol", "ts"]).groupby("symbol")["price"].pct_change()
    want = ret.groupby(pdf.sort_values(["symbol", "ts"])["symbol"]).transform(
        lambda s: s.ewm(span=span, min_periods=span).std() * np.sqrt(252))
    np.testing.assert_allclose(got["vol"].astype(float), want, rtol=1e-9)


def test_exact_percentiles(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 500), np.zeros(300), -np.exp(rng.normal(0, 8, 101))])
    df = spark.createDataFrame([("k", float(v)) for v in x], "g string, x double").repartition(5)
    got = quantiles.exact_percentiles(df, ["g"], "x", {"p05": 0.05, "p50": 0.5, "p95": 0.95}).first()
    np.testing.assert_allclose([got["p05"], got["p50"], got["p95"]], np.percentile(x, [5, 50, 95]), rtol=1e-12, atol=1e-15)


def test_equity_with_total_loss_and_sign_changes(spark):
    r = [0.1, -0.2, 0.05, -1.5, 0.3, -2.0, 0.1, -1.0, 0.4]
    days = pd.date_range("2020-01-01", periods=len(r), freq="100D")
    df = spark.createDataFrame(pd.DataFrame({"scenario": "s", "ts": days, "net": r})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = rolling.equity(df, seconds=200 * 86_400).toPandas().sort_values("ts")
    curve = np.cumprod(1 + np.array(r))
    np.testing.assert_allclose(got["equity"], curve, atol=1e-12)
    np.testing.assert_allclose(got["drawdown"], curve / np.maximum.accumulate(np.concatenate([[1.0], curve]))[1:] - 1, atol=1e-12)
    np.testing.assert_allclose(got["path_drawdown"], curve / np.maximum.accumulate(curve) - 1, atol=1e-12)


def test_early_start_drawdown(spark):
    df = spark.sql("select 's' scenario, timestamp_ntz'2020-01-01' ts, -0.1D net")
    row = rolling.equity(df).first()
    assert row["drawdown"] == pytest.approx(-0.1) and row["path_drawdown"] == 0.0
