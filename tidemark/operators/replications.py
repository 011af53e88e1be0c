"""The screening over many panels at once, told apart by a tuple of key columns such as (world, seed).

Every panel has its own calendar, development cut-off, month ends, segments and resamples; all of them run as one job whose keys
begin with the panel's.  Symbols are named by their panel, so that windows per symbol need no further key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import accounting, ranking, resampling, rolling, statistics
from .blocks import numbered

Keys = Sequence[str]
LADDER = ((1.0, 50.0), (2.0, 50.0), (5.0, 50.0))


def own_calendars(panel: DataFrame, on: Keys) -> DataFrame:
    """(on, ts, pos): the timestamps that every symbol of a panel has, numbered per panel."""
    symbols = panel.groupBy(*on).agg(F.count_distinct("symbol").alias("_k"))
    days = panel.groupBy(*on, "ts").agg(F.count(F.lit(1)).alias("_n")).join(symbols, list(on))
    return numbered(days.where(F.col("_n") == F.col("_k")).select(*on, "ts"), list(on))


def development_ends(calendars: DataFrame, on: Keys, fraction: float = 0.8) -> DataFrame:
    """(on, dev_end): each panel's latest month end not after its row at ``int(n * fraction) - 1``."""
    n = calendars.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    limit = (calendars.join(n, list(on)).where(F.col("pos") == F.floor(F.col("_n") * F.lit(fraction)) - 1).select(*on, F.col("ts").alias("_limit")))
    ends = calendars.groupBy(*on, F.trunc("ts", "month").alias("_m")).agg(F.max("ts").alias("ts"))
    return ends.join(limit, list(on)).where(F.col("ts") <= F.col("_limit")).groupBy(*on).agg(F.max("ts").alias("dev_end"))


def development_panels(panel: DataFrame, on: Keys, fraction: float = 0.8) -> DataFrame:
    """(on, symbol, asset, ts, pos, price, dev_end): each panel on its own calendar up to its cut-off; ``symbol`` names panel and asset."""
    days = own_calendars(panel, on)
    days = days.join(development_ends(days, on, fraction), list(on)).where(F.col("ts") <= F.col("dev_end"))
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in on], "symbol")
    return panel.join(days, [*on, "ts"]).select(*on, name.alias("symbol"), F.col("symbol").alias("asset"), "ts", "pos", "price", "dev_end")


def trend_signals(panel: DataFrame, returns: DataFrame, on: Keys, look: Sequence[int], warm: int, span: int) -> DataFrame:
    """(on, scenario, schedule, decision_pos, symbol, signal, vol, long_only) at each panel's month ends after the warm-up."""
    signs = rolling.trend_signs(panel, look).select("symbol", "pos", *[f"mom{n}" for n in look], "combo")
    ends = (panel.where("pos >= 1").groupBy(*on, F.trunc("ts", "month").alias("_m")).agg(F.max("ts").alias("ts")).drop("_m"))
    rows = (rolling.ewma_vol(returns, span=span, rows=2048).join(ends, [*on, "ts"], "left_semi").where(F.col("pos") >= warm)
            .join(signs, ["symbol", "pos"]).withColumn("matched", F.lit(1.0)))
    rows = rows.unpivot([*on, "symbol", "pos", "vol"], [*[f"mom{n}" for n in look], "combo", "matched"], "_sig", "signal")
    modes = F.when(F.col("_sig") == "matched", F.array(F.lit("long"))).otherwise(F.array(F.lit("long_flat"), F.lit("long_short")))
    rows = rows.withColumn("_mode", F.explode(modes))
    return rows.select(*on, F.concat_ws("_", "_sig", "_mode").alias("scenario"), (F.col("_mode") != "long_short").alias("long_only"),
                       F.lit("month").alias("schedule"), F.col("pos").alias("decision_pos"), "symbol", "signal", "vol")


def target_weights(signals: DataFrame, returns: DataFrame, keys: Keys, cap: float, trail: int) -> DataFrame:
    base = ranking.signal_weights(signals, [*keys, "decision_pos"], F.col("long_only"))
    capped = ranking.volatility_cap(base.select(*keys, "schedule", "decision_pos", "symbol", "base"), returns, keys, cap, trail)
    return capped.select(*keys, "schedule", "decision_pos", "symbol", "weight")


def without_each(signals: DataFrame, on: Keys) -> DataFrame:
    """One copy of each panel's signals per symbol of that panel, without it; ``exclude_id`` names it."""
    left_out = signals.select(*on, F.col("symbol").alias("exclude_id")).distinct()
    return signals.join(left_out, list(on)).where(F.col("symbol") != F.col("exclude_id"))


def screen(panel: DataFrame, cash: DataFrame, on: Keys, look: Sequence[int], warm: int, span: int, trail: int, cap: float = 0.10, scale: float | Column = 1.0,
           bp: Column | None = None, n_boot: int = 10_000, seed: int = 0, fraction: float = 0.8, **limits: float) -> DataFrame:
    """(on, dev_end, variant, gates, candidate): the whole screening of every panel.

    ``panel`` is (on, symbol, ts, price), ``cash`` (ts, cash) for every timestamp, ``bp`` the cost of ``asset``.  Leave-one-out books are
    made only for variants that pass gates A to C.  Panels without a decision give no rows.
    """
    on = list(on)
    by, matched = [*on, "scenario"], F.col("scenario") == "matched_long"
    rows = stored(development_panels(panel, on, fraction), "panels")
    days = rows.select(*on, "ts", "pos").distinct()
    rates = stored(days.join(cash.select("ts", "cash"), "ts"), "panel-cash")
    returns = stored(rolling.returns(rows).where(F.col("ret").isNotNull()).withColumn("ret", F.col("ret") / scale).drop("log_ret"), "panel-returns")
    costs = rows.select("symbol", (F.lit(3.0) if bp is None else bp).alias("bp")).distinct()
    grid = panel.sparkSession.createDataFrame(LADDER, "cost_mult double, borrow_bp double")
    signals = stored(trend_signals(rows, returns, on, look, warm, span), "panel-signals")
    targets = stored(target_weights(signals, returns, by, cap, trail), "panel-targets")

    def book(weights: DataFrame, cells: DataFrame, keys: Keys) -> DataFrame:
        daily = accounting.lagged_returns(returns, rates, weights, cells, costs, keys, on=on)
        return daily.join(days, [*on, "pos"])

    daily = stored(book(targets, grid, by), "panel-books")
    excess = statistics.excess_months(daily.where(~matched), daily.where(matched), [*on, "cost_mult"], [*by, "cost_mult"])
    base = excess.where("cost_mult = 1").drop("cost_mult")
    boot = resampling.stationary_bootstrap(base, by, n_boot=n_boot, seed=seed).select(*by, "ann_lower_95")
    stats = statistics.annualised(daily.where(~matched & (F.col("cost_mult") <= 2)), cash, [*by, "cost_mult"])
    plain = stats.where("cost_mult = 1").select(*by, F.col("max_drawdown").alias("dd_base"))
    stress = stats.where("cost_mult = 2").select(*by, F.col("max_drawdown").alias("dd_stress"), F.col("cagr").alias("cagr_stress"))
    one = daily.where("cost_mult = 1")
    bench = one.where(matched).select(*on, "ts", F.log1p("net").alias("_b"))
    logs = one.where(~matched).join(bench, [*on, "ts"]).withColumn("log_excess", F.log1p("net") - F.col("_b"))
    years = statistics.year_driver_ok(statistics.full_years(logs, by), by)
    facts = boot.join(plain, by).join(stress, by).join(statistics.monthly_sharpe(base, by), by)
    early = stored(statistics.screening_gates(facts, **limits), "panel-gates")
    passed = early.where("passed_abc").select(*by)
    wanted = passed.unionByName(passed.select(*on).distinct().withColumn("scenario", F.lit("matched_long")))
    fewer = without_each(signals.join(wanted, by, "left_semi"), on)
    loo_keys = [*by, "exclude_id"]
    left = book(target_weights(fewer, returns, loo_keys, cap, trail), grid.where("cost_mult = 1"), loo_keys)
    loo = statistics.excess_months(left.where(~matched), left.where(matched), [*on, "exclude_id"], loo_keys)
    loo_ok = loo.groupBy(*loo_keys).agg(F.sum("log_ret").alias("_x")).groupBy(*by).agg(F.bool_and(F.expm1("_x") > 0).alias("loo_ok"))
    gates = statistics.screening_gates(early.select(*facts.columns).join(years, by, "left").join(loo_ok, by, "left")
                                       .na.fill(False, ["years_ok", "loo_ok"]), **limits)
    gates = stored(gates.withColumnRenamed("scenario", "variant"), "panel-screening")
    ends = rows.select(*on, "dev_end").distinct()
    return gates.join(ends, on).join(statistics.pick_candidate(gates, on), on, "left")


def audit_records(screened: DataFrame, on: Keys = ("world", "seed")) -> DataFrame:
    """One record per panel: candidate, gate A and the verdict per variant, as :mod:`sources.records` reads them."""
    def per_variant(value: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", value)))).alias(value)
    return screened.groupBy(*on).agg(F.max("candidate").alias("candidate"), per_variant("gate_a"), per_variant("passed_all"),
                                     per_variant("ann_lower_95"), F.max("dev_end").alias("dev_end"))
