"""Walk-forward calibration: k of a fold never sees its test bars."""

import datetime as dt

from tidemark.operators import calendars, scoring

START = dt.datetime(2024, 1, 1)


def _calendar(spark, hours):
    return spark.createDataFrame([(START + dt.timedelta(hours=h), i) for i, h in enumerate(hours)], "ts timestamp_ntz, pos long")


def test_k_uses_the_purged_training_slice_only(spark):
    calendar = _calendar(spark, range(8))
    folds = calendars.rolling_folds(calendar, 4, 2, 2, purge=1)
    rows = [("a", p, 0.1 * (p + 1) if p < 3 else 1e6, 1.0) for p in range(8)]
    forecast = spark.createDataFrame(rows, "symbol string, pos long, mu double, sigma double")
    got = {r["fold"]: r["k"] for r in scoring.walk_forward_k(forecast, folds, percentile=1.0, eps=0.0).collect()}
    assert sorted(got) == [0, 1]
    assert abs(got[0] - 0.5 / 0.3) < 1e-12  # rows 0 to 2; row 3 is purged, rows 4 and 5 are tested
    assert abs(got[1] - 0.5 / 1e6) < 1e-12


def test_evaluated_bars_skip_gaps_and_are_numbered_without_holes(spark):
    calendar = _calendar(spark, [0, 1, 2, 3, 4, 6, 7, 8])  # bar 4 is followed by a gap
    folds = calendars.rolling_folds(calendar, 2, 3, 3)
    got = sorted(tuple(r) for r in scoring.evaluated_bars(calendar, folds, 3600).collect())
    assert got == [(0, 2, 0), (0, 3, 1), (1, 5, 0), (1, 6, 1)]


def test_too_few_bars_give_no_fold(spark):
    calendar = _calendar(spark, range(3))
    folds = calendars.rolling_folds(calendar, 4, 2, 2)
    assert scoring.evaluated_bars(calendar, folds, 3600).count() == 0
    forecast = spark.createDataFrame([("a", 0, 0.1, 1.0)], "symbol string, pos long, mu double, sigma double")
    assert scoring.walk_forward_k(forecast, folds).count() == 0
