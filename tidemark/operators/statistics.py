"""Statistics of return series held as (scenario, ts, net) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import binary_cross_entropy, gaussian_nll
from .blocks import in_blocks
from .quantiles import exact_percentiles
from .rolling import TRADING_DAYS, equity, sd

Keys = Sequence[str]
SCENARIO = ("scenario",)


def compound(value: Column) -> Column:
    """Aggregate: prod(1 + r) - 1."""
    return F.product(1 + value) - 1


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not positive."""
    return F.when(b > 0, F.try_divide(a, b)).otherwise(0.0)


def monthly_logs(net: DataFrame, keys: Keys = SCENARIO, value: str = "net") -> DataFrame:
    """Sum of log(1 + r) per calendar month."""
    return (net.groupBy(*keys, F.trunc("ts", "month").alias("month"))
            .agg(F.sum(F.log1p(value)).alias("log_ret")))


def excess_months(net: DataFrame, benchmark: DataFrame, on: Keys = (), keys: Keys = SCENARIO) -> DataFrame:
    """Monthly log difference to a benchmark; ``on`` are the scenario columns both sides share."""
    base = monthly_logs(benchmark, on).withColumnRenamed("log_ret", "_base")
    return (monthly_logs(net, keys).join(base, [*on, "month"])
            .withColumn("log_ret", F.col("log_ret") - F.col("_base")).drop("_base"))


def annualised(net: DataFrame, cash: DataFrame | None = None, keys: Keys = SCENARIO) -> DataFrame:
    """CAGR, volatility, Sharpe, excess Sharpe over cash, drawdown from the starting equity, days."""
    keys = list(keys)
    rows = net if cash is None else net.join(cash.select("ts", F.col("cash").alias("_cash")), "ts", "left")
    x = F.col("net") - F.col("_cash") if cash is not None else F.lit(None).cast("double")
    s = rows.groupBy(*keys).agg(
        F.count("net").alias("n_days"), F.product(1 + F.col("net")).alias("_growth"), F.avg("net").alias("_mean"),
        F.stddev_samp("net").alias("_sd"), F.avg(x).alias("_xmean"), F.stddev_samp(x).alias("_xsd"))
    dd = equity(net, keys).groupBy(*keys).agg(F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"))
    root = TRADING_DAYS ** 0.5
    vol = F.coalesce(F.col("_sd"), F.lit(0.0)) * root
    xvol = F.coalesce(F.col("_xsd"), F.lit(0.0)) * root
    return (s.join(dd, keys).withColumn("vol_pa", vol)
            .withColumn("cagr", F.when(F.col("_growth") >= 0, F.pow("_growth", TRADING_DAYS / F.col("n_days")) - 1))
            .withColumn("sharpe", ratio(F.col("_mean") * TRADING_DAYS, vol))
            .withColumn("excess_sharpe", F.when(F.col("_xmean").isNotNull(), ratio(F.col("_xmean") * TRADING_DAYS, xvol)))
            .drop("_growth", "_mean", "_sd", "_xmean", "_xsd"))


def monthly_sharpe(months: DataFrame, keys: Keys = SCENARIO) -> DataFrame:
    vol = F.coalesce(F.stddev_samp("log_ret"), F.lit(0.0)) * 12 ** 0.5
    return months.groupBy(*keys).agg(ratio(F.avg("log_ret") * 12, vol).alias("monthly_excess_sharpe"))


def full_years(daily_logs: DataFrame, keys: Keys = SCENARIO, value: str = "log_excess") -> DataFrame:
    """Compounded excess of the calendar years that hold days in January and in December."""
    month = F.month("ts")
    return (daily_logs.groupBy(*keys, F.year("ts").alias("year"))
            .agg(F.expm1(F.sum(value)).alias("excess"), F.max(month == 1).alias("_a"), F.max(month == 12).alias("_b"))
            .where(F.col("_a") & F.col("_b")).drop("_a", "_b"))


def yearly_returns(net: DataFrame, keys: Keys = SCENARIO) -> DataFrame:
    return net.groupBy(*keys, F.year("ts").alias("year")).agg(compound(F.col("net")).alias("annual_return"))


def weekly_returns(net: DataFrame, keys: Keys = SCENARIO) -> DataFrame:
    """Compounded inside weeks that end on Sunday; weeks without rows are absent."""
    sunday = F.to_date(F.date_trunc("week", "ts")) + F.expr("INTERVAL 6 DAYS")
    return (net.groupBy(*keys, sunday.cast("timestamp_ntz").alias("ts"))
            .agg(compound(F.col("net")).alias("net")))


def period_summary(periods: DataFrame, keys: Keys = SCENARIO) -> DataFrame:
    """Mean, deviation, t, mean/deviation, win rate, drawdown (without a starting peak), total."""
    keys = list(keys)
    s = periods.groupBy(*keys).agg(
        F.count("net").alias("n_periods"), F.avg("net").alias("mean_return"),
        F.coalesce(F.stddev_samp("net"), F.lit(0.0)).alias("std_return"),
        F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), compound(F.col("net")).alias("cumulative_return"))
    dd = equity(periods, keys).groupBy(*keys).agg(F.min("path_drawdown").alias("max_drawdown"))
    return (s.join(dd, keys)
            .withColumn("t_statistic", ratio(F.col("mean_return") * F.sqrt("n_periods"), F.col("std_return")))
            .withColumn("mean_over_std", ratio(F.col("mean_return"), F.col("std_return"))))


def seed_distribution(runs: DataFrame, keys: Keys = ("variant", "metric")) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.count("value").alias("n_seeds"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def paired_summary(pairs: DataFrame, keys: Keys = ("metric",)) -> DataFrame:
    """Statistics of b - a over shared seeds (see :func:`align.paired`)."""
    s = pairs.groupBy(*keys).agg(
        F.count("diff").alias("n_pairs"), F.avg("diff").alias("mean_diff"),
        F.coalesce(F.stddev_samp("diff"), F.lit(0.0)).alias("std_diff"),
        F.avg((F.col("diff") > 0).cast("double")).alias("b_wins_rate"))
    return s.withColumn("t_statistic", ratio(F.col("mean_diff") * F.sqrt("n_pairs"), F.col("std_diff")))


def breakeven_multiplier(ladder: DataFrame, keys: Keys = SCENARIO) -> DataFrame:
    """Cost multiplier at which the compounded excess crosses zero (linear between the rungs).

    0 when it is not positive at the lowest rung, infinity when it never crosses.
    """
    w = Window.partitionBy(*keys).orderBy("cost_mult")
    steps = (ladder.withColumn("_m2", F.lead("cost_mult").over(w)).withColumn("_e2", F.lead("excess").over(w))
             .withColumn("_first", F.row_number().over(w) == 1))
    e, m = F.col("excess"), F.col("cost_mult")
    crossing = F.when((e > 0) & (F.col("_e2") <= 0), m + (F.col("_m2") - m) * F.try_divide(e, e - F.col("_e2")))
    return (steps.groupBy(*keys).agg(
        F.min_by(crossing, F.when(crossing.isNotNull(), m)).alias("_x"), F.max(F.when(F.col("_first"), e)).alias("_e1"))
        .withColumn("breakeven", F.when(F.col("_e1") <= 0, 0.0).otherwise(F.coalesce("_x", F.lit(float("inf")))))
        .drop("_x", "_e1"))


def year_driver_ok(years: DataFrame, keys: Keys = SCENARIO) -> DataFrame:
    """Whether the full years without the best one still compound above zero.

    One best year is dropped, the earliest of equals; a single full year is not enough.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("excess").desc(), "year")
    rest = years.withColumn("_r", F.row_number().over(order))
    return rest.groupBy(*keys).agg(F.coalesce(
        F.product(F.when(F.col("_r") > 1, 1 + F.col("excess"))) > 1, F.lit(False)).alias("years_ok"))


def screening_gates(facts: DataFrame, dd_cap: float = 0.15, floor: float = 0.02, least_excess: float = 0.0) -> DataFrame:
    """Gates A-D from one row per variant.

    Needs ``ann_lower_95, dd_base, dd_stress, cagr_stress, years_ok, loo_ok``.
    """
    a = F.col("ann_lower_95") > least_excess
    b = (F.abs("dd_base") <= dd_cap) & (F.abs("dd_stress") <= dd_cap)
    c = F.col("cagr_stress") >= floor
    out = facts.withColumns({"gate_a": a, "gate_b": b, "gate_c": c, "passed_abc": a & b & c})
    if "years_ok" in facts.columns:
        d = F.coalesce("years_ok", F.lit(False)) & F.coalesce("loo_ok", F.lit(False))
        out = out.withColumn("gate_d", d).withColumn("passed_all", F.col("passed_abc") & d)
    return out


def pick_candidate(gates: DataFrame, keys: Keys = (), score: str = "monthly_excess_sharpe") -> DataFrame:
    """The passing variant with the highest score; equal scores go to the first name."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "variant")
    passed = gates.where("passed_all").withColumn("_r", F.row_number().over(w))
    return passed.where(F.col("_r") == 1).select(*keys, F.col("variant").alias("candidate"))


def interval_verdict(intervals: DataFrame, band: float | None = None) -> DataFrame:
    """How many intervals exclude zero, and whether all of them end below ``band``."""
    low, high = F.col("ci_low_95"), F.col("ci_high_95")
    excluding = F.count_if((low > 0) | (high < 0))
    return intervals.agg(
        F.count(F.lit(1)).alias("intervals"), excluding.alias("excluding_zero"), F.count_if(low > 0).alias("above_zero"),
        F.coalesce(F.bool_and(high < band) if band is not None else F.lit(False), F.lit(False)).alias("all_below_band"),
    ).withColumn("reading", F.when(F.col("excluding_zero") == 0, "null result")
                 .when(F.col("excluding_zero") == 1, "hint, not evidence").otherwise("check axis consistency"))


def forecast_metrics(df: DataFrame, keys: Keys = ("model",)) -> DataFrame:
    """Direction accuracy, always-up accuracy, normalised error and label moment where a label exists."""
    f, y = F.col("forecast"), F.col("y")
    return df.where(y.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_labels"), F.avg(((f > 0) == (y > 0)).cast("double")).alias("direction_accuracy"),
        F.avg((y > 0).cast("double")).alias("always_up_accuracy"), F.avg((f - y) * (f - y)).alias("normalized_mse"),
        F.avg(y * y).alias("label_second_moment"), F.avg((f > 0).cast("double")).alias("long_share"))


def fold_metrics(df: DataFrame, keys: Keys = ("fold",), bce_weight: float = 0.5) -> DataFrame:
    """Likelihood, cross entropy, accuracy and calibration of (mu, sigma, p_up) forecasts."""
    y, up = F.col("y"), F.col("p_up")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(gaussian_nll(y, F.col("mu"), F.col("sigma"))).alias("nll"),
        F.avg(binary_cross_entropy(up, y > 0)).alias("bce"),
        F.avg(((up > 0.5) == (y > 0)).cast("double")).alias("direction_accuracy"),
        F.avg("sigma").alias("mean_sigma"), F.stddev_pop(y - F.col("mu")).alias("residual_sd"),
    ).withColumn("loss", F.col("nll") + bce_weight * F.col("bce"))


def regime_states(panel_returns: DataFrame, window: int = 21) -> DataFrame:
    """(ts, pos, state): rolling deviation of the panel mean above its median."""
    mean = panel_returns.groupBy("ts", "pos").agg(F.avg("ret").alias("_m"))
    vol = in_blocks(mean, [], lambda d, w: d.withColumn("panel_vol", sd("_m", window, w)), window).where(
        F.col("panel_vol").isNotNull())
    median = exact_percentiles(vol, [], "panel_vol", {"_median": 0.5}).scalar()
    return vol.withColumn("state", (F.col("panel_vol") > median).cast("int")).drop("_m")


def transitions(states: DataFrame) -> DataFrame:
    """Row shares of state changes between consecutive rows."""
    following = states.select((F.col("pos") - 1).alias("pos"), F.col("state").alias("next_state"))
    counts = states.join(following, "pos").groupBy("state", "next_state").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def state_volatility(panel_returns: DataFrame, states: DataFrame) -> DataFrame:
    return (panel_returns.join(states.select("pos", "state"), "pos").groupBy("symbol", "state")
            .agg(F.stddev_samp("ret").alias("vol"), F.count("ret").alias("n")))


def window_growth(months: DataFrame, windows: DataFrame) -> DataFrame:
    """Compounded monthly logs inside each evaluation window; a boundary month counts in both.

    ``windows`` is (block, first_month, last_month): each is spread over its months for an equi-join.
    """
    spread = windows.withColumn("month", F.explode(F.expr("sequence(first_month, last_month, interval 1 month)")))
    return (months.join(spread, "month").groupBy("scenario", "block")
            .agg(F.expm1(F.sum("log_ret")).alias("growth"), F.count(F.lit(1)).alias("months")))
