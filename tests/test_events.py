"""Event rule, labels and latches against plain loops and hand cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import events, ranking


def walk(flags):
    """The event rule row by row."""
    out, wait, blocked = [], None, -1
    for t, f in enumerate(flags):
        if not f & 1:
            wait = None
            continue
        if t <= blocked:
            continue
        if wait is not None:
            if f & 8:
                wait = None
            elif f & 4:
                out.append((t, wait))
                blocked, wait = t + 10, None
            elif t == wait + 3:
                wait = None
            continue
        if f & 2:
            wait = t
    return out


def test_blocked_state_machine(spark):
    rng = np.random.default_rng(2)
    rows, want = [], set()
    for s in ("hot", "cold"):
        flags = [int(rng.random() < 0.97) + 2 * int(rng.random() < 0.3) + 4 * int(rng.random() < 0.4) + 8 * int(rng.random() < 0.1) for _ in range(700)]
        rows += [(s, t, f) for t, f in enumerate(flags)]
        want |= {(s, t, p) for t, p in walk(flags)}
    df = spark.createDataFrame(rows, "symbol string, pos long, flags int").repartition(6)
    for size in (5, 64, 4096):
        got = {tuple(r) for r in events.pullback_events(df, rows=size).select("symbol", "t", "setup_start").collect()}
        assert got == want and len(want) > 20


BARS = "open double, high double, low double, close double"


def label(spark, bars, R=1.0, q=1.5, n=10, split=None, dividend=None, tie="stop_first", b=0.0, f=0.0):
    days = [f"2020-01-{i + 1:02d} 00:00:00" for i in range(len(bars))]
    split, dividend = split or [1.0] * len(bars), dividend or [0.0] * len(bars)
    m = spark.createDataFrame([("x", d, i, *map(float, v)) for i, (d, v) in enumerate(zip(days, bars))], "symbol string, ts string, pos long, " + BARS)
    a = spark.createDataFrame([("x", d, float(s), float(v)) for d, s, v in zip(days, split, dividend)], "symbol string, ts string, split double, dividend double")
    e = spark.createDataFrame([("x", 0, R, q, n, days[0])], "symbol string, t long, R double, q double, N int, signal_time string")
    return events.barrier_labels(e, m, a, b, f, tie).first()


FLAT = (100, 100.5, 99.5, 100)


def test_stop_target_time(spark):
    assert label(spark, [FLAT, FLAT, (100, 100.2, 98.5, 99)])["reason"] == "STOP"
    hit = label(spark, [FLAT, FLAT, (100, 102, 99.9, 101)])
    assert (hit["reason"], hit["barrier_class"], hit["net_R"]) == ("TARGET", 1, pytest.approx(1.5))
    late = label(spark, [FLAT] * 4, n=3)
    assert (late["reason"], late["exit_bar"], late["barrier_class"]) == ("TIME", 3, 0)


def test_gaps_come_first(spark):
    assert label(spark, [FLAT, FLAT, (98, 103, 97, 99)])["reason"] == "GAP_STOP"
    assert label(spark, [FLAT, FLAT, (103, 104, 97, 99)])["reason"] == "GAP_TARGET"


def test_tie_rule(spark):
    both = [FLAT, FLAT, (100, 103, 97, 100)]
    a, b = label(spark, both), label(spark, both, tie="target_first")
    assert (a["reason"], b["reason"]) == ("STOP", "TARGET") and a["ambiguous"] and b["ambiguous"]


def test_split_rescales_after_entry(spark):
    row = label(spark, [FLAT, FLAT, (50, 50.2, 49.9, 50), (50, 51, 49.9, 50.5)], split=[1.0, 1.0, 2.0, 1.0])
    assert (row["reason"], row["exit_bar"]) == ("TARGET", 3)
    assert row["net_R"] == pytest.approx(1.5)


def test_dividend_not_on_entry_day(spark):
    assert label(spark, [FLAT] * 4, n=3, dividend=[0, 5.0, 0.25, 0])["net_R"] == pytest.approx(0.25)


def test_first_failure_order(spark):
    assert label(spark, [FLAT])["status"] == "CENSORED"
    assert label(spark, [FLAT, FLAT, FLAT], n=10)["status"] == "CENSORED"
    bad = label(spark, [FLAT] * 4, n=3, split=[1.0, 1.0, 0.0, 1.0])
    assert (bad["status"], bad["bar"], bad["field"]) == ("ACTION_UNSUPPORTED", 2, "split")
    bad = label(spark, [FLAT] * 4, n=3, dividend=[0, 0, -1.0, 0])
    assert (bad["status"], bad["bar"], bad["field"]) == ("ACTION_UNSUPPORTED", 2, "dividend")
    assert label(spark, [FLAT] * 4, R=0.0, n=3)["status"] == "DATA_ERROR"
    # a failure after the exit bar does not count
    fine = label(spark, [FLAT, FLAT, (100, 102, 99.9, 101), FLAT], split=[1.0, 1.0, 1.0, 0.0])
    assert fine["status"] == "OK"


def test_nonpositive_stop_is_kept(spark):
    row = label(spark, [(1, 1.1, 0.9, 1)] * 4, R=2.0, n=3)
    assert row["status"] == "OK" and row["nonpositive_stop"]


def test_persistence_against_the_rule(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for s in ("x", "y"):
        months = sorted(rng.choice(90, 70, replace=False).tolist())
        value, pending, streak, last = None, None, 0, None
        for m in months:
            raw = None if rng.random() < 0.1 else float(rng.choice([-1, 0, 1]) * (1 + m))
            if last is not None and m != last + 1:
                pending, streak = None, 0
            last = m
            if raw is None:
                value, pending, streak = None, None, 0
            elif value is None or np.sign(raw) == np.sign(value):
                value, pending, streak = raw, None, 0
            else:
                streak = streak + 1 if pending == np.sign(raw) else 1
                pending = np.sign(raw)
                if streak >= 2:
                    value, pending, streak = raw, None, 0
            ts = f"{2000 + m // 12}-{m % 12 + 1:02d}-28 00:00:00"
            rows.append((s, ts, raw))
            want[(s, ts)] = value
    df = spark.createDataFrame(rows, "symbol string, ts string, signal double").withColumn("ts", F.to_timestamp_ntz("ts"))
    got = {(r["symbol"], str(r["ts"])): r["effective"] for r in events.persistent_signals(df, 2).collect()}
    assert got == want


def test_hysteresis_against_sets(spark):
    rng = np.random.default_rng(9)
    names = [f"s{i:02d}" for i in range(12)]
    rows, want = [], {}
    longs, shorts = set(), set()
    for p in range(150):
        edge = {n: float(round(rng.normal(), 1)) for n in names}
        ranked = sorted(names, key=lambda n: -edge[n])
        longs = (longs & set(ranked[:5])) | set(ranked[:3])
        shorts = (shorts & set(ranked[-5:])) | set(ranked[-3:])
        for i, n in enumerate(names):
            rows.append((n, p, i, edge[n]))
            want[(n, p)] = int(n in longs) - int(n in shorts)
    df = spark.createDataFrame(rows, "symbol string, pos long, universe_pos int, edge double")
    got = ranking.hysteresis_sides(df, 3, 3, 5, rows=16)
    assert {(r["symbol"], r["pos"]): r["side"] for r in got.collect()} == want
    with pytest.raises(ValueError):
        ranking.hysteresis_sides(df, 6, 3, 5)
