"""Sequence samples, scaling, walk-forward forecasts and parameter estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendars, learning, rolling, statistics
from ..sources import tables
from . import ctes as c
from . import panels
from .features import bar_features_sql, channels_sql, extended_frame
from .registry import query

W = c.W
BASE = ["m1", "m5", "m21", "m63", "m126"]
EXTENDED = ["skip_momentum", "cross_rank", "vol_ratio", "drawdown", "market_corr"]
FIRST = 600


def samples(spark, folder):
    def build():
        frame = extended_frame(panels.aligned(spark, folder))
        return learning.dense_sequences(frame, BASE + EXTENDED).select("symbol", "ts", "pos", "seq", "y", "vol")
    return tables.kept(spark, ("samples", folder), build)


def base_samples(spark, folder):
    return tables.kept(spark, ("base_samples", folder), lambda: learning.dense_sequences(
        rolling.daily_channels(panels.aligned(spark, folder)), BASE).select("symbol", "ts", "pos", "seq", "y", "vol"))


def windows(spark, folder, first=FIRST, n=5):
    span = panels.calendar(spark, folder).agg(F.least(F.lit(first).cast("long"), F.max("pos") + 1).alias("first"), (F.max("pos") + 1).alias("last"))
    return calendars.expanding_windows(span, n)


SEQ_SQL = f"""{panels.ALIGNED_DAY}, {channels_sql()}, okr AS (SELECT *, m1 IS NOT NULL AND m5 IS NOT NULL AND m21 IS NOT NULL AND m63 IS NOT NULL AND m126 IS NOT NULL AS ok FROM ch),
sq AS (SELECT *, count(CASE WHEN ok THEN 1 END) OVER {c.frame(20)} AS nn FROM okr), dt AS (SELECT pos FROM sq WHERE nn = 20 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM p)),
smp AS (SELECT * FROM sq WHERE nn = 20 AND pos IN (SELECT pos FROM dt))"""


@query("dense_sequences", "W32", "symbol:s ts:t steps:i first_m1:d last_m126:d sum_m5:d y:d", f"""
WITH {SEQ_SQL}, a AS (SELECT symbol, pos, lag(m1, 19) OVER {W} AS first_m1, sum(m5) OVER {c.frame(20)} AS sum_m5 FROM okr)
SELECT s.symbol, s.ts, 20 AS steps, a.first_m1, m126 AS last_m126, a.sum_m5, y FROM smp s JOIN a USING (symbol, pos)""")
def dense_sequences(spark, folder):
    s = base_samples(spark, folder)
    return s.select("symbol", "ts", F.size("seq").alias("steps"), F.col("seq")[0][0].alias("first_m1"), F.col("seq")[19][4].alias("last_m126"),
                    F.aggregate("seq", F.lit(0.0), lambda a, v: a + v[1]).alias("sum_m5"), "y")


@query("compacted_sequences", "W33 M8", "symbol:s ts:t first_ret:d last_ret:d sum_vol:d target:d", f"""
WITH {panels.QUOTED_BARS}, {bar_features_sql()}, t AS (SELECT *, ln(lead(price, 1) OVER {W}) - ln(price) AS target FROM feat),
k AS (SELECT *, row_number() OVER {W} AS i FROM t WHERE log_return IS NOT NULL AND realized_vol IS NOT NULL AND trade_intensity IS NOT NULL AND vwap_deviation IS NOT NULL AND target IS NOT NULL AND hour(ts) % 6 <> 5)
SELECT symbol, ts, lag(log_return, 29) OVER w AS first_ret, log_return AS last_ret, sum(realized_vol) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS sum_vol, target FROM k WINDOW w AS (PARTITION BY symbol ORDER BY i) QUALIFY i >= 30""")
def compacted_sequences(spark, folder):
    f = rolling.forward_log_return(rolling.bar_features(panels.quoted_bars(spark, folder)), 1)
    gap = f.withColumn("target", F.when(F.hour("ts") % 6 != 5, F.col("target")))
    s = learning.compacted_sequences(gap, ["log_return", "realized_vol", "trade_intensity", "vwap_deviation"], "target", 30)
    return s.select("symbol", "ts", F.col("seq")[0][0].alias("first_ret"), F.col("seq")[29][0].alias("last_ret"),
                    F.aggregate("seq", F.lit(0.0), lambda a, v: a + v[1]).alias("sum_vol"), "target")


WINDOWS_SQL = f"""nn_ AS (SELECT least({FIRST}, max(pos) + 1) AS f, max(pos) + 1 AS l FROM p_cal), wi AS (SELECT w AS block, f + w * ((l - f) // 5) AS test_start, CASE WHEN w = 4 THEN l ELSE f + (w + 1) * ((l - f) // 5) END AS test_stop FROM nn_, (SELECT unnest(range(5)) AS w))"""


@query("mature_training_rows", "J9", "block:i rows:i last_pos:i y_sum:d", f"""
WITH {SEQ_SQL}, {WINDOWS_SQL} SELECT block, count(*) AS rows, max(pos) AS last_pos, sum(y) AS y_sum FROM smp JOIN wi ON pos <= test_start - 2 WHERE y IS NOT NULL GROUP BY 1""")
def mature_training_rows(spark, folder):
    t = learning.training_rows(base_samples(spark, folder), windows(spark, folder), 2)
    return t.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.max("pos").alias("last_pos"), F.sum("y").alias("y_sum"))


@query("refit_windows", "J10", "refit_pos:i rows:i first_pos:i last_pos:i days:i", f"""
WITH {SEQ_SQL}, el AS (SELECT pos, row_number() OVER (ORDER BY pos) AS rk FROM (SELECT DISTINCT pos FROM smp WHERE y IS NOT NULL)),
rf AS (SELECT unnest(range({FIRST} + 21, (SELECT max(pos) FROM smp) + 1, 21)) AS refit_pos), cn AS (SELECT refit_pos, (SELECT count(*) FROM el WHERE el.pos <= refit_pos - 2) AS k FROM rf)
SELECT refit_pos, count(*) AS rows, min(el.pos) AS first_pos, max(el.pos) AS last_pos, count(DISTINCT el.pos) AS days FROM cn JOIN el ON rk > greatest(k - 252, 0) AND rk <= k JOIN smp ON smp.pos = el.pos AND y IS NOT NULL GROUP BY 1""")
def refit_windows(spark, folder):
    s = base_samples(spark, folder)
    rows = learning.refit_rows(s, learning.refit_windows(s, FIRST))
    return rows.groupBy(F.col("block").alias("refit_pos")).agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first_pos"),
                                                              F.max("pos").alias("last_pos"), F.count_distinct("pos").alias("days"))


SCALER_SQL = f"""{SEQ_SQL}, {WINDOWS_SQL}, tr_ AS (SELECT block, symbol, pos FROM smp JOIN wi ON pos <= test_start - 2 WHERE y IS NOT NULL),
pr_ AS (SELECT block, ch.* FROM tr_ JOIN ch ON ch.symbol = tr_.symbol AND ch.pos BETWEEN tr_.pos - 19 AND tr_.pos),
sc AS (SELECT block, channel, avg(x) AS mean, stddev_pop(x) AS scale FROM (SELECT block, unnest([0, 1, 2, 3, 4]) AS channel, unnest([m1, m5, m21, m63, m126]) AS x FROM pr_) GROUP BY 1, 2)"""


@query("pooled_scaler", "M1", "block:i channel:i mean:d scale:d", f"WITH {SCALER_SQL} SELECT * FROM sc")
def pooled_scaler(spark, folder):
    return learning.pooled_scaler(learning.training_rows(base_samples(spark, folder), windows(spark, folder), 2))


@query("standardised_sequences", "M2 M5", "symbol:s ts:t block:i first_z:d last_z:d", f"""
WITH {SCALER_SQL}, o AS (SELECT smp.*, wi.block FROM smp JOIN wi ON pos >= test_start AND pos < test_stop), b AS (SELECT symbol, pos, lag(m1, 19) OVER {W} AS f1 FROM okr)
SELECT o.symbol, o.ts, o.block, greatest(-10, least(10, (f1 - s0.mean) / s0.scale)) AS first_z, greatest(-10, least(10, (m126 - s4.mean) / s4.scale)) AS last_z
FROM o JOIN b USING (symbol, pos) JOIN sc s0 ON s0.block = o.block AND s0.channel = 0 JOIN sc s4 ON s4.block = o.block AND s4.channel = 4""")
def standardised_sequences(spark, folder):
    s, w = base_samples(spark, folder), windows(spark, folder)
    scalers = learning.scaler_arrays(learning.pooled_scaler(learning.training_rows(s, w, 2)))
    z = learning.standardised(learning.owned(s, w), scalers)
    return z.select("symbol", "ts", "block", F.col("z")[0].alias("first_z"), F.col("z")[99].alias("last_z"))


@query("ridge_forecasts", "M3 M5", "symbol:s ts:t block:i forecast:d y:d")
def ridge_forecasts(spark, folder):
    return learning.ridge_forecasts(base_samples(spark, folder), windows(spark, folder))


@query("refit_ridge_forecasts", "M9 J10", "symbol:s ts:t block:i forecast:d y:d")
def refit_ridge_forecasts(spark, folder):
    return learning.refit_forecasts(base_samples(spark, folder), FIRST)


TREE_ROUNDS = 20


@query("feature_model_grid", "M4 M6 A19", "cell:s n_labels:i direction_accuracy:d always_up_accuracy:d normalized_mse:d label_second_moment:d long_share:d")
def feature_model_grid(spark, folder):
    s, w = samples(spark, folder), windows(spark, folder)
    base = list(range(len(BASE)))
    cells = {"base_ridge": learning.ridge_forecasts(s, w, subset=base), "ext_ridge": learning.ridge_forecasts(s, w),
             "base_trees": learning.tree_forecasts(s, w, subset=base, rounds=TREE_ROUNDS), "ext_trees": learning.tree_forecasts(s, w, rounds=TREE_ROUNDS)}
    rows = None
    for name, f in cells.items():
        part = f.select(F.lit(name).alias("cell"), "forecast", "y")
        rows = part if rows is None else rows.unionByName(part)
    return statistics.forecast_metrics(rows, ["cell"])


GRID_A = [round(0.02 + 0.01 * i, 2) for i in range(19)]
GRID_B = [round(0.70 + 0.01 * i, 2) for i in range(28)]


@query("variance_model_grid", "A29", "symbol:s omega:d alpha:d beta:d loglik:d", f"""
WITH RECURSIVE {panels.ALIGNED_WEEK}, r AS MATERIALIZED (SELECT symbol, pos - 1 AS i, ret FROM (SELECT symbol, pos, price / lag(price) OVER {W} - 1 AS ret FROM p) WHERE ret IS NOT NULL),
gr AS (SELECT r0.symbol, a / 100.0::DOUBLE AS alpha, b / 100.0::DOUBLE AS beta, v0 FROM (SELECT symbol, avg(ret * ret) AS v0 FROM r GROUP BY 1) r0, (SELECT unnest(range(2, 21)) AS a), (SELECT unnest(range(70, 98)) AS b) WHERE a + b < 99.9),
lp AS (SELECT symbol, alpha, beta, v0, 0::BIGINT AS i, v0 AS var, 0.0::DOUBLE AS ll FROM gr UNION ALL
 SELECT lp.symbol, alpha, beta, v0, lp.i + 1, v0 * (1 - (alpha + beta)) + alpha * ret * ret + beta * var, ll - 0.5 * (ln(var) + ret * ret / var) FROM lp JOIN r ON r.symbol = lp.symbol AND r.i = lp.i)
SELECT symbol, omega, alpha, beta, loglik FROM (SELECT symbol, v0 * (1 - (alpha + beta)) AS omega, alpha, beta, ll AS loglik, row_number() OVER (PARTITION BY symbol ORDER BY ll DESC, alpha, beta) AS rn FROM lp WHERE i = (SELECT max(i) + 1 FROM r)) WHERE rn = 1""")
def variance_model_grid(spark, folder):
    r = rolling.returns(panels.aligned(spark, folder, "week")).where(F.col("ret").isNotNull()).withColumn("pos", F.col("pos") - 1)
    return learning.variance_grid(r, GRID_A, GRID_B)


@query("correlation_factors", "A28", "symbol:s factor:i loading_size:d eigenvalue:d idio_vol:d")
def correlation_factors(spark, folder):
    r = rolling.returns(panels.aligned(spark, folder, "week")).where(F.col("ret").isNotNull())
    return learning.correlation_factors(r).withColumn("loading_size", F.abs("loading"))
