"""Return statistics, gates and regime estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, calendars, rolling, statistics
from ..sources import tables
from . import ctes as c
from . import panels
from .registry import query

W = c.W
EQ = "(PARTITION BY scenario ORDER BY ts)"
# weekly returns shrunk so that a scenario reads like a portfolio
SMALL = f"{panels.NET}, sm AS (SELECT scenario, ts, pos, net / 50 AS net FROM net)"
MONTHS = f"{SMALL}, mo AS (SELECT scenario, date_trunc('month', ts) AS month, sum(ln(1 + net)) AS log_ret FROM sm GROUP BY 1, 2)"
EXCESS = f"{MONTHS}, ex AS (SELECT m.scenario, m.month, m.log_ret - b.log_ret AS log_ret FROM mo m JOIN mo b ON b.month = m.month AND b.scenario = 'AF' WHERE m.scenario <> 'AF')"


def small(spark, folder):
    return panels.net_weekly(spark, folder).withColumn("net", F.col("net") / 50)


def excess(spark, folder):
    s = small(spark, folder)
    return statistics.excess_months(s.where(F.col("scenario") != "AF"), s.where(F.col("scenario") == "AF"))


@query("monthly_log_returns", "A1", "scenario:s month:t log_ret:d", f"WITH {MONTHS} SELECT * FROM mo")
def monthly_log_returns(spark, folder):
    return statistics.monthly_logs(small(spark, folder))


@query("monthly_excess", "J13 A1", "scenario:s month:t log_ret:d", f"WITH {EXCESS} SELECT * FROM ex")
def monthly_excess(spark, folder):
    return excess(spark, folder)


@query("compound_returns", "A2 A4", "scenario:s year:i annual_return:d", f"""
WITH {SMALL} SELECT scenario, year(ts) AS year, product(1 + net) - 1 AS annual_return FROM sm GROUP BY 1, 2""")
def compound_returns(spark, folder):
    return statistics.yearly_returns(small(spark, folder))


@query("full_year_excess", "A3", "scenario:s year:i excess:d", f"""
WITH {SMALL}, d AS (SELECT s.scenario, s.ts, ln(1 + s.net) - ln(1 + b.net) AS x FROM sm s JOIN sm b ON b.ts = s.ts AND b.scenario = 'AF' WHERE s.scenario <> 'AF')
SELECT scenario, year(ts) AS year, exp(sum(x)) - 1 AS excess FROM d GROUP BY 1, 2 HAVING bool_or(month(ts) = 1) AND bool_or(month(ts) = 12)""")
def full_year_excess(spark, folder):
    s = small(spark, folder)
    return statistics.full_years(daily_excess(s.where(F.col("scenario") != "AF"), s.where(F.col("scenario") == "AF")))


def daily_excess(net, benchmark):
    base = benchmark.select("ts", F.log1p("net").alias("_b"))
    return net.join(base, "ts").withColumn("log_excess", F.log1p("net") - F.col("_b"))


def stats_sql(src: str, key: str = "scenario", cash: str | None = None) -> str:
    """annualised statistics of ``src(key, ts, net)``; ``cash`` names a (ts, cash) table."""
    eq = f"(PARTITION BY {key} ORDER BY ts)"
    j = f"LEFT JOIN {cash} USING (ts)" if cash else ""
    x = "net - cash" if cash else "NULL::DOUBLE"
    return f"""eqx AS (SELECT {key}, ts, exp(sum(ln(1 + net)) OVER {eq}) AS equity FROM {src}),
ddx AS (SELECT {key}, min(d) AS max_drawdown FROM (SELECT {key}, least(0, equity / greatest(1.0, max(equity) OVER {eq}) - 1) AS d FROM eqx) GROUP BY 1),
agx AS (SELECT {key}, count(net) AS n_days, product(1 + net) AS g, avg(net) AS m, stddev_samp(net) * sqrt(252.0) AS v, avg({x}) AS xm, stddev_samp({x}) * sqrt(252.0) AS xv FROM {src} {j} GROUP BY 1),
stx AS (SELECT {key}, n_days, pow(g, 252.0 / n_days) - 1 AS cagr, coalesce(v, 0) AS vol_pa, CASE WHEN v > 0 THEN m * 252 / v ELSE 0 END AS sharpe,
 CASE WHEN xm IS NOT NULL THEN CASE WHEN xv > 0 THEN xm * 252 / xv ELSE 0 END END AS excess_sharpe, max_drawdown FROM agx JOIN ddx USING ({key}))"""


@query("annualised_stats", "A5 W30", "scenario:s n_days:i cagr:d vol_pa:d sharpe:d excess_sharpe:d max_drawdown:d", f"""
WITH {SMALL}, {panels.cash_sql('week')}, ck AS (SELECT k.ts, x.rate_pa_pct / 100 / 252 AS cash FROM p_cal k ASOF JOIN cash x ON k.ts >= x.ts), {stats_sql('sm', cash='ck')} SELECT * FROM stx""")
def annualised_stats(spark, folder):
    cal = panels.calendar(spark, folder, "week")
    cash = align.last_known(cal, panels.cash(spark, folder, "week"), ["rate_pa_pct"], keys=(), seconds=365 * 86400)
    return statistics.annualised(small(spark, folder), cash.select("ts", (F.col("rate_pa_pct") / 100 / 252).alias("cash")))


@query("monthly_excess_sharpe", "A6", "scenario:s monthly_excess_sharpe:d", f"""
WITH {EXCESS} SELECT scenario, CASE WHEN stddev_samp(log_ret) > 0 THEN avg(log_ret) * 12 / (stddev_samp(log_ret) * sqrt(12.0)) ELSE 0 END AS monthly_excess_sharpe FROM ex GROUP BY 1""")
def monthly_excess_sharpe(spark, folder):
    return statistics.monthly_sharpe(excess(spark, folder))


BARRETS = f"""{panels.EVENT_ALIGNED}, st AS (SELECT * FROM (SELECT symbol AS scenario, ts, (ln(price) - ln(lag(price) OVER {W})) / 50 AS net FROM b) WHERE net IS NOT NULL),
wk AS (SELECT scenario, CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 6 DAY AS ts, product(1 + net) - 1 AS net FROM st GROUP BY 1, 2)"""


def _weekly(spark, folder):
    r = rolling.returns(panels.event_aligned(spark, folder)).where(F.col("log_ret").isNotNull())
    return statistics.weekly_returns(r.select(F.col("symbol").alias("scenario"), "ts", (F.col("log_ret") / 50).alias("net")))


@query("weekly_period_returns", "A7", "scenario:s ts:t net:d", f"WITH {BARRETS} SELECT * FROM wk")
def weekly_period_returns(spark, folder):
    return _weekly(spark, folder)


@query("period_summary", "A8 W31", "scenario:s n_periods:i mean_return:d std_return:d t_statistic:d mean_over_std:d win_rate:d max_drawdown:d cumulative_return:d", f"""
WITH {BARRETS}, e AS (SELECT scenario, ts, exp(sum(ln(1 + net)) OVER {EQ}) AS eq FROM wk), d AS (SELECT scenario, eq / max(eq) OVER {EQ} - 1 AS dd FROM e),
dm AS (SELECT scenario, min(dd) AS max_drawdown FROM d GROUP BY 1),
s AS (SELECT scenario, count(*) AS n_periods, avg(net) AS mean_return, coalesce(stddev_samp(net), 0) AS std_return, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS win_rate, product(1 + net) - 1 AS cumulative_return FROM wk GROUP BY 1)
SELECT *, CASE WHEN std_return > 0 THEN mean_return / (std_return / sqrt(n_periods)) ELSE 0 END AS t_statistic, CASE WHEN std_return > 0 THEN mean_return / std_return ELSE 0 END AS mean_over_std FROM s JOIN dm USING (scenario)""")
def period_summary(spark, folder):
    return statistics.period_summary(_weekly(spark, folder))


SEEDS_SQL = "runs AS (SELECT l_linestatus AS variant, 'discount' AS metric, l_suppkey AS seed, avg(l_discount) + sum(l_tax) / 1000 AS value FROM lineitem GROUP BY 1, 2, 3)"


def _seed_runs(spark, folder):
    return (tables.table(spark, folder, "lineitem").groupBy(F.col("l_linestatus").alias("variant"), F.lit("discount").alias("metric"), F.col("l_suppkey").alias("seed"))
            .agg((F.avg("l_discount") + F.sum("l_tax") / 1000).alias("value")))


@query("seed_distribution", "A9", "variant:s metric:s n_seeds:i mean:d std:d min:d max:d", f"""
WITH {SEEDS_SQL} SELECT variant, metric, count(*) AS n_seeds, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max FROM runs GROUP BY 1, 2""")
def seed_distribution(spark, folder):
    return statistics.seed_distribution(_seed_runs(spark, folder))


@query("paired_comparison", "A10 J13", "metric:s n_pairs:i mean_diff:d std_diff:d t_statistic:d b_wins_rate:d", f"""
WITH {SEEDS_SQL}, p AS (SELECT a.metric, b.value - a.value AS d FROM runs a JOIN runs b ON a.seed = b.seed AND a.metric = b.metric AND a.variant = 'F' AND b.variant = 'O')
SELECT metric, count(*) AS n_pairs, avg(d) AS mean_diff, coalesce(stddev_samp(d), 0) AS std_diff, CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) ELSE 0 END AS t_statistic,
 avg(CASE WHEN d > 0 THEN 1.0 ELSE 0 END) AS b_wins_rate FROM p GROUP BY 1""")
def paired_comparison(spark, folder):
    r = _seed_runs(spark, folder)
    return statistics.paired_summary(align.paired(r.where("variant = 'F'"), r.where("variant = 'O'"), ["metric", "seed"], "value"))


@query("breakeven_multipliers", "A12", "scenario:s breakeven:d never:b", f"""
WITH {EXCESS}, l AS (SELECT scenario, m AS cost_mult, exp(sum(log_ret)) - 1 - 0.02 * m * m + CASE WHEN scenario > 'NO' THEN 0.2 ELSE 0.0 END AS excess FROM ex, (VALUES (1.0), (2.0), (5.0)) v(m) GROUP BY 1, 2),
s AS (SELECT *, lead(cost_mult) OVER w AS m2, lead(excess) OVER w AS e2, row_number() OVER w AS r FROM l WINDOW w AS (PARTITION BY scenario ORDER BY cost_mult)),
x AS (SELECT scenario, max(CASE WHEN r = 1 THEN excess END) AS e1, arg_min(CASE WHEN excess > 0 AND e2 <= 0 THEN cost_mult + (m2 - cost_mult) * excess / (excess - e2) END, CASE WHEN excess > 0 AND e2 <= 0 THEN cost_mult END) AS b FROM s GROUP BY 1)
SELECT scenario, CASE WHEN e1 <= 0 THEN 0.0 ELSE b END AS breakeven, e1 > 0 AND b IS NULL AS never FROM x""")
def breakeven_multipliers(spark, folder):
    total = excess(spark, folder).groupBy("scenario").agg(F.expm1(F.sum("log_ret")).alias("_t"))
    ladder = total.withColumn("cost_mult", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0)))).withColumn(
        "excess", F.col("_t") - 0.02 * F.col("cost_mult") * F.col("cost_mult") + F.when(F.col("scenario") > "NO", 0.2).otherwise(0.0))
    b = statistics.breakeven_multiplier(ladder)
    never = F.col("breakeven") == float("inf")
    return b.select("scenario", F.when(~never, F.col("breakeven")).alias("breakeven"), never.alias("never"))


@query("window_growth", "A31", "scenario:s block:i growth:d months:i", f"""
WITH {MONTHS}, b AS (SELECT w AS block, min(k.ts) AS a, max(k.ts) AS z FROM p_cal k, (SELECT unnest(range(5)) AS w) GROUP BY w),
t AS (SELECT block, (SELECT CAST(date_trunc('month', ts) AS DATE) FROM p_cal WHERE pos = block * (n // 5)) AS f, (SELECT CAST(date_trunc('month', ts) AS DATE) FROM p_cal WHERE pos = CASE WHEN block = 4 THEN n - 1 ELSE (block + 1) * (n // 5) - 1 END) AS l
 FROM b, (SELECT count(*) AS n FROM p_cal))
SELECT scenario, block, exp(sum(log_ret)) - 1 AS growth, count(*) AS months FROM mo JOIN t ON mo.month BETWEEN t.f AND t.l GROUP BY 1, 2""")
def window_growth(spark, folder):
    cal = panels.calendar(spark, folder, "week")
    n = F.max("pos") + 1
    blocks = calendars.expanding_windows(cal.agg(F.lit(0).cast("long").alias("first"), n.alias("last")), 5)
    month = F.to_date(F.trunc("ts", "month"))
    first = cal.select(F.col("pos").alias("test_start"), month.alias("first_month"))
    last = cal.select((F.col("pos") + 1).alias("test_stop"), month.alias("last_month"))
    spans = blocks.join(first, "test_start").join(last, "test_stop").select("block", "first_month", "last_month")
    return statistics.window_growth(statistics.monthly_logs(small(spark, folder)).withColumn("month", F.to_date("month")), spans)


FOLD_SQL = f"{panels.FORECASTS}, fy AS (SELECT *, ln(lead(price) OVER {W}) - ln(price) AS y, pos // 100 AS fold FROM fc)"


@query("fold_metrics", "A20", "fold:i n_test:i nll:d bce:d loss:d direction_accuracy:d mean_sigma:d residual_sd:d", f"""
WITH {FOLD_SQL}, r AS (SELECT *, CASE WHEN y > 0 THEN -greatest(ln(nullif(p_up, 0)), -100) ELSE -greatest(ln(nullif(1 - p_up, 0)), -100) END AS b FROM fy WHERE y IS NOT NULL),
a AS (SELECT fold, count(*) AS n_test, avg(0.5 * ln(2 * pi() * sigma * sigma) + (y - mu) * (y - mu) / (2 * sigma * sigma)) AS nll, avg(coalesce(b, 100)) AS bce,
 avg(CASE WHEN (p_up > 0.5) = (y > 0) THEN 1.0 ELSE 0 END) AS direction_accuracy, avg(sigma) AS mean_sigma, stddev_pop(y - mu) AS residual_sd FROM r GROUP BY 1) SELECT *, nll + 0.5 * bce AS loss FROM a""")
def fold_metrics(spark, folder):
    f = rolling.forward_log_return(panels.forecasts(spark, folder), 1, "y").where(F.col("y").isNotNull())
    return statistics.fold_metrics(f.withColumn("fold", F.floor(F.col("pos") / 100)))


@query("forecast_metrics", "A19", "model:s n_labels:i direction_accuracy:d always_up_accuracy:d normalized_mse:d label_second_moment:d long_share:d", f"""
WITH {FOLD_SQL}, m AS (SELECT 'mu' AS model, mu / sigma AS f, y / sigma AS y FROM fy UNION ALL SELECT 'p_up', p_up - 0.5, y / sigma FROM fy)
SELECT model, count(*) AS n_labels, avg(CASE WHEN (f > 0) = (y > 0) THEN 1.0 ELSE 0 END) AS direction_accuracy, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0 END) AS always_up_accuracy,
 avg((f - y) * (f - y)) AS normalized_mse, avg(y * y) AS label_second_moment, avg(CASE WHEN f > 0 THEN 1.0 ELSE 0 END) AS long_share FROM m WHERE y IS NOT NULL GROUP BY 1""")
def forecast_metrics(spark, folder):
    f = rolling.forward_log_return(panels.forecasts(spark, folder), 1, "y").withColumn("y", F.col("y") / F.col("sigma"))
    wide = f.select("y", (F.col("mu") / F.col("sigma")).alias("mu"), (F.col("p_up") - 0.5).alias("p_up"))
    return statistics.forecast_metrics(wide.unpivot(["y"], ["mu", "p_up"], "model", "forecast"))


REGIME_SQL = f"""{panels.ALIGNED_DAY}, r AS (SELECT * FROM (SELECT symbol, ts, pos, price / lag(price) OVER {W} - 1 AS ret FROM p) WHERE ret IS NOT NULL),
m AS (SELECT pos, avg(ret) AS m FROM r GROUP BY 1), v AS (SELECT pos, CASE WHEN count(m) OVER f = 21 THEN stddev_samp(m) OVER f END AS pv FROM m WINDOW f AS (ORDER BY pos ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
stt AS (SELECT pos, pv, CASE WHEN pv > (SELECT quantile_cont(pv, 0.5) FROM v WHERE pv IS NOT NULL) THEN 1 ELSE 0 END AS state FROM v WHERE pv IS NOT NULL)"""


def _regime(spark, folder):
    r = rolling.returns(panels.aligned(spark, folder)).where(F.col("ret").isNotNull())
    return r, statistics.regime_states(r)


@query("regime_transitions", "A27", "state:i next_state:i n:i share:d", f"""
WITH {REGIME_SQL}, q AS (SELECT state, lead(state) OVER (ORDER BY pos) AS next_state FROM stt), g AS (SELECT state, next_state, count(*) AS n FROM q WHERE next_state IS NOT NULL GROUP BY 1, 2)
SELECT *, n / sum(n) OVER (PARTITION BY state) AS share FROM g""")
def regime_transitions(spark, folder):
    return statistics.transitions(_regime(spark, folder)[1])


@query("regime_volatility", "A27", "symbol:s state:i vol:d n:i", f"""
WITH {REGIME_SQL} SELECT symbol, state, stddev_samp(ret) AS vol, count(*) AS n FROM r JOIN stt USING (pos) GROUP BY 1, 2""")
def regime_volatility(spark, folder):
    return statistics.state_volatility(*_regime(spark, folder))
