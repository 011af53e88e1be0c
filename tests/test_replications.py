"""Many panels at once against each panel alone."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import accounting, calendars, replications, resampling, rolling
from tidemark.session import stored


@pytest.fixture(scope="module")
def worlds(spark):
    """Panels of unlike length; one has a hole for one symbol."""
    rng = np.random.default_rng(21)
    rows = []
    for world, seed, days in (("calm", 1, 120), ("calm", 2, 200), ("wild", 1, 90)):
        for k, s in enumerate("abc"):
            prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.01 * (1 + k), days)))
            rows += [(world, seed, s, f"{np.datetime64('2020-01-01') + d} 00:00:00", float(p)) for d, p in enumerate(prices) if not (world == "wild" and s == "b" and d == 40)]
    return spark.createDataFrame(rows, "world string, seed long, symbol string, ts string, price double").withColumn("ts", F.to_timestamp_ntz("ts"))


def each(worlds):
    return [(r["world"], r["seed"], worlds.where((F.col("world") == r["world"]) & (F.col("seed") == r["seed"])).drop("world", "seed"))
            for r in worlds.select("world", "seed").distinct().orderBy("world", "seed").collect()]


def test_calendars_and_cut_offs_of_each_panel(worlds):
    on = ["world", "seed"]
    days = replications.own_calendars(worlds, on)
    ends = {(r["world"], r["seed"]): r["dev_end"] for r in replications.development_ends(days, on).collect()}
    got = {(r["world"], r["seed"]): (r["n"], r["top"]) for r in days.groupBy(*on).agg(F.count("ts").alias("n"), F.max("pos").alias("top")).collect()}
    assert got == {("calm", 1): (120, 119), ("calm", 2): (200, 199), ("wild", 1): (89, 88)}
    for world, seed, panel in each(worlds):
        assert ends[world, seed] == calendars.development_end(calendars.common_calendar(panel)).first()["ts"]


def test_books_of_many_panels_equal_each_alone(spark, worlds):
    on = ["world", "seed"]
    rows = stored(replications.development_panels(worlds.where("world = 'wild' OR seed = 1"), on), "panels")
    returns = stored(rolling.returns(rows).where("ret IS NOT NULL").drop("log_ret"), "returns")
    cash = rows.select(*on, "pos").distinct().withColumn("cash", F.lit(0.0001))
    weight = F.when(F.col("asset") == "a", -0.4).when(F.col("asset") == "b", 0.9).otherwise(0.3)
    weights = rows.where((F.col("pos") % 17 == 5)).select(*on, F.lit("s").alias("scenario"), F.lit("m").alias("schedule"), F.col("pos").alias("decision_pos"), "symbol", weight.alias("weight"))
    grid = spark.createDataFrame([(1.0, 50.0), (3.0, 20.0)], "cost_mult double, borrow_bp double")
    keys = [*on, "scenario"]
    columns = ["cost_mult", "pos", "net", "turnover", "trade_cost"]
    both = accounting.lagged_returns(returns, cash, weights, grid, keys=keys, on=on).select(*on, *columns).toPandas()
    assert len(both) > 200
    for (world, seed), part in both.groupby(on):
        def mine(df, w=world, s=seed):
            return df.where((F.col("world") == w) & (F.col("seed") == s)).drop("world", "seed")
        alone = accounting.lagged_returns(mine(returns), mine(cash), mine(weights), grid).select(*columns).toPandas()
        a, b = (d[columns].sort_values(columns[:2]).to_numpy() for d in (part, alone))
        np.testing.assert_allclose(a, b, atol=1e-12)


def test_each_symbol_is_left_out_of_its_own_panel_only(spark):
    rows = [("w", 1, "w|1|a", 1.0), ("w", 1, "w|1|b", 1.0), ("w", 2, "w|2|a", 1.0), ("w", 2, "w|2|c", 1.0)]
    s = spark.createDataFrame(rows, "world string, seed long, symbol string, signal double")
    got = sorted((r["seed"], r["exclude_id"], r["symbol"]) for r in replications.without_each(s, ["world", "seed"]).collect())
    assert got == [(1, "w|1|a", "w|1|b"), (1, "w|1|b", "w|1|a"), (2, "w|2|a", "w|2|c"), (2, "w|2|c", "w|2|a")]


def test_records_of_screened_panels(spark):
    rows = [("w", 1, "x", True, False, 0.1, None), ("w", 1, "y", False, False, -0.1, None), ("w", 2, "x", True, True, 0.2, "x")]
    s = spark.createDataFrame(rows, "world string, seed long, variant string, gate_a boolean, passed_all boolean, ann_lower_95 double, candidate string").withColumn("dev_end", F.lit("2020-01-31"))
    got = {r["seed"]: r for r in replications.audit_records(s).collect()}
    assert got[1]["gate_a"] == {"x": True, "y": False} and got[1]["candidate"] is None and got[2]["candidate"] == "x"


def test_replicates_are_drawn_in_many_tasks_however_small_their_input_is(spark):
    """The text of the picks is far larger than that of the row they come from, so the size of the latter must not set the tasks."""
    v = spark.createDataFrame([("s", i, 300, float(i)) for i in range(300)], "scenario string, i long, n long, x double")
    tasks = resampling._replicates(v, 2000).withColumn("task", F.spark_partition_id())
    assert tasks.count() == 2000 and tasks.select("task").distinct().count() >= 16
    assert tasks.groupBy("n", "salt").agg(F.count_distinct("task").alias("k")).where("k > 1").count() == 0


def test_the_runs_of_a_replicate_equal_its_walk(spark):
    n, seed = 40, 5
    reps = spark.createDataFrame([(n, b, b % 32) for b in range(1, 31)], "n long, b int, salt int")
    for r in resampling.stationary_draws(reps, (1.0, 6.0, 1e9), seed).collect():
        at, walk = 0, []
        for i in range(n):
            text = hashlib.md5(f"{seed}|{r['b']}|{i}".encode()).hexdigest()
            again = not walk or int(text[:8], 16) / 2**32 < 1 / (1.0, 6.0, 1e9)[r["which"]]
            at = int(int(text[8:16], 16) / 2**32 * n) if again else (at + 1) % n
            walk.append(at)
        assert r["picks"] == walk


def test_long_replicates_take_time_in_proportion(spark):
    """Twelve times as many periods; a walk that copied its picks at every step took over fifty times as long."""
    def seconds(n):
        reps = spark.createDataFrame([(n, b, b % 32) for b in range(8)], "n long, b int, salt int").coalesce(1)
        began = time.perf_counter()
        resampling.stationary_draws(reps, (6.0,), 3).agg(F.sum(F.size("picks"))).collect()
        reps = resampling.stationary_draws(reps, (6.0,), 3).agg(F.sum(F.aggregate("picks", F.lit(0).cast("long"), lambda a, x: a + x))).collect()
        return time.perf_counter() - began
    seconds(100)
    assert seconds(36_000) < 36 * seconds(3_000)


def test_days_of_a_book_are_joined_once(spark, monkeypatch):
    """Books with and without shorts read the stored days; each join of their own would add its sort memory to the same task."""
    joins = {}

    def counted(df, name):
        joins[name] = df._jdf.queryExecution().sparkPlan().toString().count("Join")
        return stored(df, name)
    monkeypatch.setattr(accounting, "stored", counted)
    returns = spark.createDataFrame([(s, p, 0.01) for s in "ab" for p in range(1, 30)], "symbol string, pos long, ret double")
    cash = returns.select("pos").distinct().withColumn("cash", F.lit(0.0001))
    weights = spark.createDataFrame([(k, "m", p, s, w) for k, w in (("long", 0.5), ("short", -0.2)) for p in (3, 12) for s in "ab"],
                                    "scenario string, schedule string, decision_pos long, symbol string, weight double")
    grid = spark.createDataFrame([(1.0, 50.0)], "cost_mult double, borrow_bp double")
    assert accounting.lagged_returns(returns, cash, weights, grid).select("scenario").distinct().count() == 2
    assert joins["value-path"] <= 3
