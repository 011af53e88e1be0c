"""Live operators against plain loops: arrival out of order, restarts, late rows, silent keys."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch
from tidemark.streaming import stateful
from tidemark.streaming.replay import Replay, late_rows, started

T0 = 1_700_000_000
SCHEMA = "symbol string, second long, price double"


class Feed:
    """A stream folder that a test fills by hand; every ``send`` restarts the query from its checkpoint."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.path, self.out = spark, schema, scratch(spark, "feed"), scratch(spark, "fed")
        spark.createDataFrame([], self._timed(spark.createDataFrame([], schema)).schema).write.parquet(self.path)
        self.stream = spark.readStream.schema(spark.read.parquet(self.path).schema).parquet(self.path)
        self.late = 0

    @staticmethod
    def _timed(df):
        return df.withColumn("ts", F.timestamp_seconds(F.lit(T0) + F.col("second"))).drop("second")

    def send(self, result, rows):
        self._timed(self.spark.createDataFrame(rows, self.schema)).coalesce(1).write.mode("append").parquet(self.path)
        query = started(result, self.out)
        query.awaitTermination()
        self.late += late_rows(query)
        return self.spark.read.schema(result.schema).parquet(self.out)


def second(us):
    return us // 1_000_000 - T0


def test_outcomes_of_rows_out_of_order_restarted_and_late(spark):
    rng = np.random.default_rng(5)
    price = np.exp(rng.normal(0, 0.01, 40).cumsum())
    rows = [(s, 60 * i, float(price[i] + k)) for k, s in enumerate("ab") for i in range(40)]
    feed = Feed(spark, SCHEMA)
    result = stateful.live_outcomes(feed.stream, 3, newest=20, batch=8, least=5, delay="10 minutes")
    first, second_part = [r for r in rows if r[1] < 1200], [r for r in rows if r[1] >= 1200]
    held_back = first.pop(10)                       # a row inside the delay that arrives with the next batch
    held_back = held_back if held_back[1] > 600 else first.pop(18)
    rng.shuffle(first)
    rng.shuffle(second_part)
    as_rows = lambda part: [(str(a), int(b), float(c)) for a, b, c in part]
    feed.send(result, as_rows(first))
    feed.send(result, as_rows([*second_part, held_back]))
    got = feed.send(result, [("a", 0, 1.0), ("b", 60, 1.0), (None, 10_000, None)]).toPandas()
    assert feed.late == 2
    used = {(s, t): p for s, t, p in rows if (s, t) in {(r[0], r[1]) for r in [*as_rows(first), held_back, *as_rows(second_part)]}}
    for s in "ab":
        series = [(t, p) for (k, t), p in sorted(used.items()) if k == s]
        mine = got[got["symbol"] == s].sort_values("us").reset_index(drop=True)
        assert second(mine["us"]).tolist() == [t for t, _ in series[:-3]]
        want = [math.log(series[i + 3][1]) - math.log(series[i][1]) for i in range(len(series) - 3)]
        assert np.allclose(mine["outcome"], want)
        assert mine["n_ready"].tolist() == [min(i + 1, 20) for i in range(len(want))]
        for i in range(len(want)):
            if i + 1 < 5:
                assert np.isnan(mine["batch_mean"][i])
            else:
                assert mine["batch_mean"][i] == pytest.approx(np.mean(want[max(0, i - 7):i + 1]))


def test_a_silent_key_is_forgotten(spark):
    feed = Feed(spark, SCHEMA)
    result = stateful.live_outcomes(feed.stream, 1, idle_ms=600_000)
    feed.send(result, [("a", 0, 1.0), ("b", 0, 1.0), ("a", 60, 2.0), ("b", 60, 2.0)])
    feed.send(result, [("b", 500, 4.0)])
    feed.send(result, [("b", 900, 8.0)])            # 840 s after the last row of a
    got = feed.send(result, [("a", 1000, 3.0), ("b", 1000, 9.0), ("a", 1060, 6.0), (None, 9000, None)]).toPandas()
    a = got[got["symbol"] == "a"]
    assert sorted(second(a["us"])) == [0, 1000]     # no outcome spans the silence
    assert sorted(second(got[got["symbol"] == "b"]["us"])) == [0, 60, 500, 900]


def test_news_join_waits_for_news_inside_the_delay(spark):
    feed = Feed(spark, "symbol string, second long, score double, is_bar boolean")
    from tidemark.streaming.eventtime import after_watermark, watermarked
    timed = watermarked(feed.stream, "ts", "5 minutes")
    live = stateful.live_news(after_watermark(timed, ~F.col("is_bar")).withColumnRenamed("ts", "created_at"),
                              after_watermark(timed, F.col("is_bar")), 10, delay=None)
    feed.send(live, [("a", 600, None, True), ("a", 0, 1.0, False), ("a", 1, 0.5, False), ("b", 600, None, True)])
    got = feed.send(live, [("a", 590, -1.0, False), ("a", 600, 0.0, False), ("a", 601, 1.0, False), ("a", 1300, None, True),
                           (None, 90_000, None, None)]).toPandas()
    rows = {(r.symbol, second(r.us)): (round(math.expm1(r.news_intensity)), r.news_sentiment) for r in got.itertuples()}
    assert rows == {("a", 600): (3, pytest.approx(-0.5 / 3)), ("b", 600): (0, 0.0), ("a", 1300): (0, 0.0)}


def test_book_skips_incomplete_bars_and_keeps_sides(spark):
    feed = Feed(spark, "universe string, symbol string, second long, edge double")
    result = stateful.live_book(feed.stream, 4, 1, 1, 2)
    bars = {0: (4, 3, 2, 1), 60: (3, 4, 1, 2), 180: (2, 4, 3, 1), 240: (4, 3, 2, 1)}
    rows = [("u", s, t, float(e)) for t, edges in bars.items() for s, e in zip("abcd", edges)]
    rows += [("u", s, 120, 1.0) for s in "abc"]     # d is missing
    feed.send(result, [r for r in rows if r[2] <= 60])
    got = feed.send(result, [r for r in rows if r[2] > 60] + [(None, None, 9000, None)]).toPandas()
    sides = {t: [] for t in bars}
    for r in got.assign(t=second(got["us"])).sort_values(["t", "symbol"]).itertuples():
        sides[r.t].append(r.side)
    assert sides == {0: [1, 0, 0, -1], 60: [1, 1, -1, -1], 180: [0, 1, 0, -1], 240: [1, 1, 0, -1]}
    assert got.groupby("us")["weight"].sum().abs().max() < 1e-12


def test_features_do_not_depend_on_the_cut(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i * 60, *(float(v) for v in rng.uniform(1, 2, 7))) for s in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, s long, " + ", ".join(f"{c} double" for c in stateful.BAR)).withColumn(
        "ts", F.timestamp_seconds(F.lit(T0) + F.col("s"))).drop("s")
    sizes = dict(vol_rows=6, vwap_rows=4, trade_rows=8, window=10, steps=5)
    tables = []
    for pieces in (1, 3):
        source = Replay(df, pieces=pieces)
        tables.append(source.to_table(stateful.live_features(source.stream, **sizes), "f").orderBy("symbol", "us").toPandas())
    a, b = tables
    assert len(a) == 2 * (60 - 8) and a["seq"].notna().sum() == 2 * (60 - 8 - 9 - 4)
    for c in a.columns.drop("seq"):
        assert (a[c].equals(b[c])) if c in ("symbol", "us") else np.allclose(a[c], b[c], equal_nan=True)
    assert all((x is None) == (y is None) and (x is None or np.allclose(np.vstack(x), np.vstack(y))) for x, y in zip(a["seq"], b["seq"]))


def test_empty_table_gives_no_rows(spark):
    source = Replay(spark.createDataFrame([], "symbol string, ts timestamp, price double"))
    assert source.to_table(stateful.live_outcomes(source.stream, 3), "none").count() == 0


def test_quotes_of_many_symbols_share_few_keys(spark, monkeypatch):
    """Two symbols in one state, a restart between quote and bar, a silence, equal moments."""
    monkeypatch.setattr(stateful, "SHARDS", 1, raising=False)
    feed = Feed(spark, "symbol long, second long, is_bar boolean, id long, value double")
    result = stateful.quoted_bars(feed.stream, idle_ms=600_000)
    feed.send(result, [(1, 0, False, 10, 1.0), (2, 5, True, 20, 9.0), (2, 10, False, 21, 2.0), (1, 20, True, 11, 5.0), (1, 20, False, 13, 4.0), (1, 20, False, 12, 3.0)])
    feed.send(result, [(2, 500, True, 22, 6.0), (1, 700, True, 14, 7.0)])
    got = feed.send(result, [(1, 710, False, 15, 8.0), (1, 711, True, 16, 8.5), (None, 9000, None, None, None)]).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == [(1, 11, 5.0, 13, 4.0), (1, 16, 8.5, 15, 8.0), (2, 22, 6.0, 21, 2.0)]


def test_a_state_entry_holds_a_batch_of_rows(spark):
    """Waiting rows cost one call of the state server per batch and not one per row."""
    import pandas as pd
    from tidemark.streaming.eventtime import EventOrder

    class Waiting:
        calls = 0

        def appendValue(self, value):
            self.calls, self.value = self.calls + 1, value

        def appendList(self, values):
            self.calls += len(values)
    order = EventOrder("symbol", ["us", "price"], "", "", None, ["us"], [], None)
    order.waiting, order._wake = Waiting(), lambda us: None
    list(order.handleInputRows(("a",), iter([pd.DataFrame({"us": range(1000), "price": 1.5})]), None))
    assert order.waiting.calls == 1 and order.waiting.value[0] == list(range(1000))
