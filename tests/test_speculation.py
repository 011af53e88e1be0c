"""Rules in guessed blocks against the same rule run through a whole series."""

import numpy as np
import pytest

from tidemark.operators import accounting
from tidemark.operators.speculation import speculated


def whole(frame, rule, keys=("symbol",)):
    names = [f.split()[0] for f in rule.outputs.split(", ")]
    parts = []
    for _, g in frame.groupby(list(keys)):
        g = g.sort_values("pos")
        parts.append(g.assign(**rule.run(list(rule.start), g)[1]))
    return {(r.symbol, r.pos): tuple(getattr(r, n) for n in names) for g in parts for r in g.itertuples()}


def check(spark, data, columns, rule, **blocks):
    df = spark.createDataFrame(data, columns).repartition(5)
    got = speculated(df, ["symbol"], rule, **blocks).toPandas()
    want = whole(df.toPandas(), rule)
    names = [f.split()[0] for f in rule.outputs.split(", ")]
    assert len(got) == len(data) and list(got.columns) == [*df.columns, *names]
    mine = {(r.symbol, r.pos): tuple(getattr(r, n) for n in names) for r in got.itertuples()}
    assert mine == want


def test_one_hot_symbol_and_a_short_one(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", i, float(rng.normal(0, 0.03))) for i in range(2000)] + [("cold", i, float(rng.normal(0, 0.1))) for i in range(3, 9)]
    short, long = [], []
    check(spark, rows, "symbol string, pos long, weight double", accounting.DeadBand(0.05), rows=50, warmup=4, replays=short)
    check(spark, rows, "symbol string, pos long, weight double", accounting.DeadBand(0.05), rows=50, warmup=40, replays=long)
    assert 0 <= sum(long) < sum(short) <= 40    # blocks; a longer warm-up guesses better


def test_a_band_that_never_forgets_is_finished_in_order(spark):
    rows = [(s, i, first if i == 0 else 0.04) for s, first in (("x", 0.06), ("y", 0.0)) for i in range(200)]
    replays = []
    check(spark, rows, "symbol string, pos long, weight double", accounting.DeadBand(0.05), rows=10, warmup=5, rounds=3, replays=replays)
    assert replays == [1, 1, 1]


def test_gaps_and_targets_that_are_not_numbers(spark):
    rng = np.random.default_rng(9)
    rows = [("x", int(i), float(w)) for i, w in zip(np.flatnonzero(rng.random(400) < 0.3), rng.normal(0, 0.1, 400))]
    rows = [r for r in rows if not 100 < r[1] < 180]
    check(spark, rows, "symbol string, pos long, weight double", accounting.DeadBand(0.05), rows=16, warmup=8)
    df = spark.createDataFrame([("x", 0, 0.1), ("x", 1, float("nan")), ("x", 2, 0.2)], "symbol string, pos long, weight double")
    got = [r["executed"] for r in accounting.dead_band(df, 0.05, rows=1, warmup=0).orderBy("pos").collect()]
    assert got == [0.1, None, 0.2]              # NaN leaves a Python task as NULL


def test_overlay_in_blocks(spark):
    rng = np.random.default_rng(6)
    mid = 100 * np.exp(rng.normal(0, 0.02, 1200).cumsum())
    rows = [("x", i, float(np.clip(rng.normal(0, 0.6), -1, 1)), float(rng.uniform(0.1, 0.4)), float(mid[i] * 0.999), float(mid[i] * 1.001))
            for i in range(1200)]
    rule = accounting.Overlay(max_step=0.3, max_sigma=0.35, loss_limit=-0.1, lookback=6, cooldown=4, threshold=0.05, slippage_bp=1.0)
    replays = []
    check(spark, rows, "symbol string, pos long, target double, sigma double, bid double, ask double", rule, rows=100, warmup=40,
          replays=replays)
    assert sum(replays) <= 6                    # of 12 blocks


def test_empty_table_and_long_warm_up(spark):
    df = spark.createDataFrame([], "symbol string, pos long, weight double")
    assert accounting.dead_band(df).count() == 0
    with pytest.raises(ValueError, match="warm-up"):
        accounting.dead_band(df, rows=4, warmup=5)
