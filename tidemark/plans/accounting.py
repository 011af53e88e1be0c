"""Weights to returns: trend books, scenario grids, value paths, position rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import target_position
from ..operators import accounting, align, calendars, ranking, resampling, rolling, statistics
from ..sources import tables
from . import crosssection, ctes as c
from . import panels
from .alignment import exclusions
from .features import ewma_sql
from .registry import query
from .resampling import boot_sql
from .statistics import stats_sql

W = c.W
LOOK = (12, 26, 52)          # weeks
WARM, SPAN, TRAIL = 64, 13, 13
LADDER = ((1.0, 50.0), (2.0, 50.0), (5.0, 50.0))


def cost_grid(spark, rows=LADDER):
    cells = F.array(*[F.struct(F.lit(m).alias("cost_mult"), F.lit(b).alias("borrow_bp")) for m, b in rows])
    return spark.range(1).select(F.explode(cells).alias("c")).select("c.*")


def symbol_bp(panel):
    return panel.select("symbol").distinct().withColumn("bp", F.when(F.col("symbol") < "NF", 1.5).otherwise(3.0))


def weekly_cash(spark, folder, unit="week"):
    return tables.kept(spark, ("cash", folder, unit), lambda: align.cash_rate(
        panels.calendar(spark, folder, unit), panels.cash(spark, folder, unit), causal=False))


def returns_panel(spark, folder, unit="week", scale=50.0):
    """Returns shrunk to portfolio size: the supplied prices move far more than a market does."""
    def build():
        p = rolling.returns(panels.aligned(spark, folder, unit)).where(F.col("ret").isNotNull())
        return p.withColumn("ret", F.col("ret") / scale).drop("log_ret")
    return tables.kept(spark, ("book_returns", folder, unit, scale), build)


def signals(spark, folder, unit="week", look=LOOK, warm=WARM, span=SPAN):
    """(variant, mode, schedule, decision_pos, symbol, signal, vol) at month ends after the warm-up."""
    def build():
        r = returns_panel(spark, folder, unit)
        vol = rolling.ewma_vol(r, span=span, rows=2048)
        s = rolling.trend_signs(panels.aligned(spark, folder, unit), look).drop("price", "ts")
        ends = calendars.month_ends(panels.calendar(spark, folder, unit).where(F.col("pos") >= 1)).select("ts")
        rows = vol.join(ends, "ts", "left_semi").where(F.col("pos") >= warm).join(s, ["symbol", "pos"])
        names = [f"mom{n}" for n in look] + ["combo"]
        rows = rows.withColumn("matched", F.lit(1.0)).unpivot(["symbol", "pos", "vol"], [*names, "matched"], "sig", "signal")
        rows = rows.withColumn("mode", F.explode(F.when(F.col("sig") == "matched", F.array(F.lit("long"))).otherwise(
            F.array(F.lit("long_flat"), F.lit("long_short")))))
        return rows.select(F.concat_ws("_", "sig", "mode").alias("scenario"), (F.col("mode") != "long_short").alias("long_only"),
                           F.lit("month").alias("schedule"), F.col("pos").alias("decision_pos"), "symbol", "signal", "vol")
    return tables.kept(spark, ("signals", folder, unit), build)


def trend_targets(sig, panel, keys=("scenario",), trail=TRAIL, cap=0.10):
    keys = list(keys)
    base = ranking.signal_weights(sig, [*keys, "decision_pos"], F.col("long_only"))
    capped = ranking.volatility_cap(base.select(*keys, "schedule", "decision_pos", "symbol", "base"), panel, keys, cap, trail)
    return capped.select(*keys, "schedule", "decision_pos", "symbol", "weight")


def targets(spark, folder, unit="week", trail=TRAIL):
    return tables.kept(spark, ("targets", folder, unit), lambda: trend_targets(
        signals(spark, folder, unit), returns_panel(spark, folder, unit), trail=trail))


def daily(spark, folder, unit="week", scale=50.0):
    def build():
        r = returns_panel(spark, folder, unit, scale)
        return accounting.lagged_returns(r, weekly_cash(spark, folder, unit), targets(spark, folder, unit), cost_grid(spark), symbol_bp(r))
    out = tables.kept(spark, ("book_daily", folder, unit, scale), build)
    return out.join(panels.calendar(spark, folder, unit), "pos")


SIGNALS_SQL = f"""{panels.ALIGNED_WEEK}, {panels.cash_sql('week')},
ck AS MATERIALIZED (SELECT k.ts, k.pos, coalesce(x.rate_pa_pct, (SELECT arg_min(rate_pa_pct, ts) FROM cash)) / 100 / 252 AS cash FROM p_cal k ASOF LEFT JOIN cash x ON k.ts >= x.ts),
r AS (SELECT * FROM (SELECT symbol, ts, pos, (price / lag(price) OVER {W} - 1) / 50 AS ret FROM p) WHERE ret IS NOT NULL),
vl AS ({ewma_sql(SPAN)}), sg0 AS (SELECT symbol, pos, {", ".join(f"sign(price / lag(price, {n}) OVER {W} - 1) AS mom{n}" for n in LOOK)} FROM p),
sg1 AS (SELECT *, (mom12 + mom26 + mom52) / 3.0 AS combo, 1.0 AS matched FROM sg0),
me AS (SELECT max(pos) AS pos FROM p_cal WHERE pos >= 1 GROUP BY date_trunc('month', ts)),
sg AS (SELECT symbol, pos, sig, CAST(signal AS DOUBLE) AS signal FROM (SELECT symbol, pos, mom12::DOUBLE AS mom12, mom26::DOUBLE AS mom26, mom52::DOUBLE AS mom52, combo::DOUBLE AS combo, matched::DOUBLE AS matched FROM sg1) UNPIVOT (signal FOR sig IN (mom12, mom26, mom52, combo, matched))),
sm AS (SELECT sig || '_' || mode AS scenario, mode, sg.symbol, sg.pos AS d, CASE WHEN mode <> 'long_short' THEN greatest(signal, 0) ELSE signal END AS signal, vol
 FROM sg JOIN vl USING (symbol, pos) JOIN me USING (pos), (VALUES ('long_flat'), ('long_short'), ('long')) v(mode) WHERE sg.pos >= {WARM} AND (sig = 'matched') = (mode = 'long')),
rw AS (SELECT *, coalesce(CASE WHEN vol > 0 THEN signal / vol END, 0) AS raw FROM sm),
bw AS (SELECT *, CASE WHEN sum(abs(raw)) OVER g > 0 THEN raw / sum(abs(raw)) OVER g ELSE 0 END AS base FROM rw WINDOW g AS (PARTITION BY scenario, d)),
pr AS (SELECT scenario, d, stddev_samp(x) * sqrt(252.0) AS risk FROM (SELECT b.scenario, b.d, r.pos, sum(b.base * r.ret) AS x FROM bw b JOIN r ON r.symbol = b.symbol AND r.pos BETWEEN b.d - {TRAIL - 1} AND b.d WHERE base <> 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
tg AS (SELECT b.scenario, b.d, b.symbol, b.base * CASE WHEN risk > 0 THEN least(1, 0.10 / risk) ELSE 1 END AS weight FROM bw b LEFT JOIN pr USING (scenario, d))"""


def loop_sql(costs, ladder_alias="cg", targets="tg", first="(SELECT min(d) FROM tg)", keys="scenario", panel="r", bp="CASE WHEN symbol < 'NF' THEN 1.5 ELSE 3.0 END") -> str:
    """The accounting loop row by row, weights as lists over the sorted symbols."""
    grid = ", ".join(f"({m}::DOUBLE, {b}::DOUBLE)" for m, b in costs)
    return f"""dl AS (SELECT pos, list(ret ORDER BY symbol) AS rs, max(cash) AS cash FROM {panel} JOIN ck USING (pos) GROUP BY 1),
bpl AS (SELECT list({bp} ORDER BY symbol) AS bps, list(0.0::DOUBLE ORDER BY symbol) AS zs FROM (SELECT DISTINCT symbol FROM {panel})),
tl AS (SELECT {keys}, d + 1 AS fpos, list(weight ORDER BY symbol) AS tw FROM {targets} GROUP BY {keys}, d),
{ladder_alias} AS (SELECT * FROM (VALUES {grid}) v(cost_mult, borrow_bp)),
lp AS (SELECT {keys}, cost_mult, borrow_bp, min(fpos) - 1 AS pos, any_value(zs) AS w, 0.0::DOUBLE AS gross_pnl, 0.0::DOUBLE AS cash_pnl, 0.0::DOUBLE AS borrow_cost, 0.0::DOUBLE AS trade_cost, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS ge
 FROM tl, {ladder_alias}, bpl GROUP BY {keys}, cost_mult, borrow_bp
 UNION ALL
 SELECT {keys}, cost_mult, borrow_bp, pos, CASE WHEN tw IS NULL THEN dw ELSE tw END, gp, cp, bc,
  CASE WHEN tw IS NULL THEN 0.0 ELSE list_sum(list_transform(range(1, len(dw) + 1), lambda i: abs(tw[i] - dw[i]) * bps[i])) / 1e4 * cost_mult END,
  CASE WHEN tw IS NULL THEN 0.0 ELSE list_sum(list_transform(range(1, len(dw) + 1), lambda i: abs(tw[i] - dw[i]))) END, list_sum(list_transform(dw, lambda x: abs(x)))
 FROM (SELECT *, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN 1 + gp + cp - bc > 0 THEN w[i] * (1 + rs[i]) / (1 + gp + cp - bc) ELSE w[i] END) AS dw
  FROM (SELECT {", ".join("lp." + k.strip() for k in keys.split(","))}, lp.cost_mult, lp.borrow_bp, dl.pos, lp.w, dl.rs, tl.tw, bpl.bps, list_dot_product(lp.w, dl.rs) AS gp,
   greatest(0, 1 - list_sum(list_transform(lp.w, lambda x: abs(x)))) * dl.cash AS cp, list_sum(list_transform(lp.w, lambda x: CASE WHEN x < 0 THEN -x ELSE 0 END)) * lp.borrow_bp / 1e4 / 252 * lp.cost_mult AS bc
   FROM lp JOIN dl ON dl.pos = lp.pos + 1 LEFT JOIN tl ON tl.fpos = dl.pos AND {" AND ".join(f"tl.{k.strip()} = lp.{k.strip()}" for k in keys.split(","))}, bpl))),
bk AS (SELECT lp.*, ts, gross_pnl + cash_pnl - trade_cost - borrow_cost AS net FROM lp JOIN p_cal USING (pos) WHERE (lp.scenario, lp.pos) NOT IN (SELECT (scenario, min(fpos) - 1) FROM tl GROUP BY scenario))"""


@query("trend_target_weights", "X10 X11 X13", "scenario:s pos:i symbol:s weight:d", f"WITH {SIGNALS_SQL} SELECT scenario, d AS pos, symbol, weight FROM tg")
def trend_target_weights(spark, folder):
    return targets(spark, folder).withColumnRenamed("decision_pos", "pos")


@query("trend_backtest_daily", "B1 P13 P14 A13", "scenario:s cost_mult:d ts:t gross_pnl:d cash_pnl:d borrow_cost:d trade_cost:d turnover:d net:d", f"""
WITH RECURSIVE {SIGNALS_SQL}, {loop_sql(LADDER)} SELECT * FROM bk""")
def trend_backtest_daily(spark, folder):
    return daily(spark, folder)


@query("trend_backtest_summary", "B1 B7 A5 A13 W30", "scenario:s cost_mult:d n_days:i cagr:d vol_pa:d sharpe:d excess_sharpe:d max_drawdown:d", f"""
WITH RECURSIVE {SIGNALS_SQL}, {loop_sql(LADDER)}, src AS (SELECT scenario || '@' || cost_mult AS k, ts, net, scenario, cost_mult FROM bk), {stats_sql('src', 'k', 'ck')}
SELECT DISTINCT scenario, cost_mult, stx.* FROM stx JOIN (SELECT DISTINCT k, scenario, cost_mult FROM src) USING (k)""")
def trend_backtest_summary(spark, folder):
    return statistics.annualised(daily(spark, folder), weekly_cash(spark, folder), ["scenario", "cost_mult"])


@query("total_loss_book", "B1", "scenario:s cost_mult:d ts:t gross_pnl:d cash_pnl:d borrow_cost:d trade_cost:d turnover:d net:d", f"""
WITH RECURSIVE {SIGNALS_SQL}, rl AS (SELECT symbol, ts, pos, CASE WHEN (pos + ascii(symbol[2:2])) % 41 = 0 THEN -1.0 ELSE greatest(ret * 20, -0.95) END AS ret FROM r),
tgl AS (SELECT scenario, d, symbol, weight * 3 AS weight FROM tg), {loop_sql(LADDER, targets='tgl', panel='rl')} SELECT * FROM bk""")
def total_loss_book(spark, folder):
    """A leveraged book on a panel where symbols are wiped out now and then and the whole book is ruined on some days."""
    r = returns_panel(spark, folder)
    lost = (F.col("pos") + F.ascii(F.substring("symbol", 2, 1))) % 41 == 0
    harsh = r.withColumn("ret", F.when(lost, -1.0).otherwise(F.greatest(F.col("ret") * 20, F.lit(-0.95))))
    wide = targets(spark, folder).withColumn("weight", F.col("weight") * 3)
    out = accounting.lagged_returns(harsh, weekly_cash(spark, folder), wide, cost_grid(spark), symbol_bp(r))
    return out.join(panels.calendar(spark, folder, "week"), "pos")


@query("book_totals", "A15", "scenario:s cost_mult:d total_turnover:d n_rebalances:i max_daily_gross:d trade_cost_sum:d borrow_cost_sum:d", f"""
WITH RECURSIVE {SIGNALS_SQL}, {loop_sql(LADDER)} SELECT scenario, cost_mult, sum(turnover) AS total_turnover, count(*) FILTER (turnover > 0) AS n_rebalances, max(ge) AS max_daily_gross,
 sum(trade_cost) AS trade_cost_sum, sum(borrow_cost) AS borrow_cost_sum FROM bk GROUP BY 1, 2""")
def book_totals(spark, folder):
    return accounting.book_totals(daily(spark, folder), ["scenario", "cost_mult"])


@query("instrument_contributions", "A15", "scenario:s symbol:s contribution:d", f"""
WITH RECURSIVE {SIGNALS_SQL}, {loop_sql(LADDER[:1])}, sy AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS i FROM (SELECT DISTINCT symbol FROM r))
SELECT n.scenario, sy.symbol, sum(y.w[sy.i] * dl.rs[sy.i]) AS contribution FROM bk n JOIN lp y ON y.scenario = n.scenario AND y.pos = n.pos - 1 JOIN dl ON dl.pos = n.pos, sy GROUP BY 1, 2""")
def instrument_contributions(spark, folder):
    d = daily(spark, folder).where(F.col("cost_mult") == 1.0)
    return accounting.contributions(returns_panel(spark, folder), targets(spark, folder), d)


BORROW = ((1.0, 25.0), (1.0, 50.0), (1.0, 100.0))


@query("borrow_sensitivity", "A14", "scenario:s borrow_bp:d growth:d borrow_sum:d", f"""
WITH RECURSIVE {SIGNALS_SQL}, tls AS (SELECT * FROM tg WHERE scenario LIKE '%long_short'), {loop_sql(BORROW, targets='tls')}
SELECT scenario, borrow_bp, product(1 + net) AS growth, sum(borrow_cost) AS borrow_sum FROM bk GROUP BY 1, 2""")
def borrow_sensitivity(spark, folder):
    r = returns_panel(spark, folder)
    t = targets(spark, folder).where(F.col("scenario").endswith("long_short"))
    d = accounting.lagged_returns(r, weekly_cash(spark, folder), t, cost_grid(spark, BORROW), symbol_bp(r))
    return d.groupBy("scenario", "borrow_bp").agg(F.product(1 + F.col("net")).alias("growth"), F.sum("borrow_cost").alias("borrow_sum"))


MIX = {"mix_100": {"AF": 1.0}, "mix_60_40": {"AF": 0.6, "AO": 0.4}}
MIX_SQL = f"""{SIGNALS_SQL}, mx AS (SELECT * FROM (VALUES ('mix_100', 'AF', 1.0::DOUBLE), ('mix_60_40', 'AF', 0.6::DOUBLE), ('mix_60_40', 'AO', 0.4::DOUBLE)) v(scenario, symbol, weight)),
md AS (SELECT DISTINCT d FROM tg), ms AS (SELECT DISTINCT symbol FROM r),
mt AS (SELECT s.scenario, md.d, ms.symbol, coalesce(mx.weight, 0.0) AS weight FROM (SELECT DISTINCT scenario FROM mx) s, md, ms LEFT JOIN mx ON mx.scenario = s.scenario AND mx.symbol = ms.symbol
 WHERE s.scenario <> 'mix_100' OR md.d = (SELECT min(d) FROM md))"""


@query("fixed_mix_benchmarks", "X12 B1", "scenario:s ts:t net:d turnover:d", f"""
WITH RECURSIVE {MIX_SQL}, {loop_sql(LADDER[:1], targets='mt')} SELECT * FROM bk""")
def fixed_mix_benchmarks(spark, folder):
    r = returns_panel(spark, folder)
    d = targets(spark, folder).select("decision_pos").distinct()
    first = d.select(F.min("decision_pos")).scalar()
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(s).alias("symbol"), F.lit(w).alias("weight"))
                               for k, v in MIX.items() for s, w in v.items()]))
    t = (d.withColumn("_m", rows).select("_m.scenario", F.col("_m.scenario").alias("schedule"), "decision_pos", "_m.symbol", "_m.weight")
         .where((F.col("scenario") != "mix_100") | (F.col("decision_pos") == first)))
    out = accounting.lagged_returns(r, weekly_cash(spark, folder), t, cost_grid(spark, LADDER[:1]), symbol_bp(r))
    return out.join(panels.calendar(spark, folder, "week"), "pos")


@query("holdout_restart", "B6 A17", "scenario:s ts:t net:d trade_cost:d", f"""
WITH RECURSIVE {SIGNALS_SQL}, ho AS (SELECT * FROM tg WHERE d > (SELECT count(*) * 3 // 5 FROM p_cal)), {loop_sql(LADDER[:1], targets='ho')} SELECT * FROM bk""")
def holdout_restart(spark, folder):
    r = returns_panel(spark, folder)
    cut = panels.calendar(spark, folder, "week").select(F.floor(F.count(F.lit(1)) * 3 / 5)).scalar()
    t = targets(spark, folder).where(F.col("decision_pos") > cut)
    d = accounting.lagged_returns(r, weekly_cash(spark, folder), t, cost_grid(spark, LADDER[:1]), symbol_bp(r))
    return d.join(panels.calendar(spark, folder, "week"), "pos")


N_BOOT, SEED = 10_000, 11


def gate_facts(d, cash, n_boot=N_BOOT, seed=SEED):
    """Per variant: lower bound of the excess over the matched book, drawdowns at single and double costs, stressed growth."""
    matched = F.col("scenario") == "matched_long"
    ex = statistics.excess_months(d.where(~matched), d.where(matched), ["cost_mult"], ["scenario", "cost_mult"])
    ex1 = ex.where(F.col("cost_mult") == 1.0).drop("cost_mult")
    boot = resampling.stationary_bootstrap(ex1, n_boot=n_boot, seed=seed).select("scenario", "ann_lower_95")
    st = statistics.annualised(d.where(~matched & (F.col("cost_mult") <= 2)), cash, ["scenario", "cost_mult"])
    base = st.where(F.col("cost_mult") == 1).select("scenario", F.col("max_drawdown").alias("dd_base"))
    stress = st.where(F.col("cost_mult") == 2).select("scenario", F.col("max_drawdown").alias("dd_stress"), F.col("cagr").alias("cagr_stress"))
    return boot.join(base, "scenario").join(stress, "scenario").join(statistics.monthly_sharpe(ex1), "scenario")


def screening(spark, folder, unit="week", n_boot=N_BOOT, seed=SEED, scale=50.0, **limits):
    """Gates A-D over all variants; leave-one-out books only for variants that pass A-C."""
    d = daily(spark, folder, unit, scale)
    cash, r = weekly_cash(spark, folder, unit), returns_panel(spark, folder, unit, scale)
    matched = F.col("scenario") == "matched_long"
    facts = gate_facts(d, cash, n_boot, seed)
    one = d.where(F.col("cost_mult") == 1)
    bench = one.where(matched).select("ts", F.log1p("net").alias("_b"))
    logs = one.where(~matched).join(bench, "ts").withColumn("log_excess", F.log1p("net") - F.col("_b"))
    years = statistics.year_driver_ok(statistics.full_years(logs))
    early = tables.stored(statistics.screening_gates(facts, **limits), "gates")
    loo = leave_one_out(spark, signals(spark, folder, unit), r, cash, early.where("passed_abc").select("scenario"))
    loo_ok = loo.groupBy("scenario").agg(F.bool_and(F.col("excess") > 0).alias("loo_ok"))
    gates = statistics.screening_gates(early.select(*facts.columns)
                                       .join(years, "scenario", "left").join(loo_ok, "scenario", "left"), **limits)
    return gates.withColumnRenamed("scenario", "variant")


def leave_one_out(spark, sig, panel, cash, scenarios):
    """Compounded excess per (scenario, exclusion): one job over all exclusions of the given scenarios."""
    table, ids = exclusions(spark)
    wanted = scenarios.unionByName(spark.range(1).select(F.lit("matched_long").alias("scenario")))
    few = sig.join(wanted, "scenario", "left_semi")
    cut = align.excluded_panels(few, table, ids)
    t = trend_targets(cut, panel, ["scenario", "exclude_id"])
    d = accounting.lagged_returns(panel, cash, t, cost_grid(spark, LADDER[:1]), symbol_bp(panel), ["scenario", "exclude_id"])
    d = d.join(cash.select("pos", "ts"), "pos")
    m = F.col("scenario") == "matched_long"
    ex = statistics.excess_months(d.where(~m), d.where(m), ["exclude_id"], ["scenario", "exclude_id"])
    return ex.groupBy("scenario", "exclude_id").agg(F.expm1(F.sum("log_ret")).alias("excess"))


SCREEN_SQL = f"""{SIGNALS_SQL}, {loop_sql(LADDER)}, mo AS (SELECT scenario, cost_mult, date_trunc('month', ts) AS month, sum(ln(1 + net)) AS l FROM bk GROUP BY 1, 2, 3),
ex AS (SELECT a.scenario, a.month, a.l - b.l AS log_ret FROM mo a JOIN mo b ON a.month = b.month AND a.cost_mult = b.cost_mult AND b.scenario = 'matched_long' WHERE a.scenario <> 'matched_long' AND a.cost_mult = 1),
{boot_sql('ex', SEED, N_BOOT, '[6.0::DOUBLE]')}, src AS (SELECT scenario || '@' || cost_mult AS k, ts, net FROM bk WHERE cost_mult <= 2 AND scenario <> 'matched_long'), {stats_sql('src', 'k')},
yl AS (SELECT a.scenario, year(a.ts) AS y, exp(sum(ln(1 + a.net) - ln(1 + b.net))) - 1 AS e FROM bk a JOIN bk b ON a.ts = b.ts AND b.scenario = 'matched_long' AND b.cost_mult = 1 WHERE a.cost_mult = 1 AND a.scenario <> 'matched_long'
 GROUP BY 1, 2 HAVING bool_or(month(a.ts) = 1) AND bool_or(month(a.ts) = 12)),
yo AS (SELECT scenario, coalesce(product(1 + e) FILTER (rn > 1) > 1, false) AS years_ok FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY e DESC, y) AS rn FROM yl) GROUP BY 1),
ms_ AS (SELECT scenario, CASE WHEN stddev_samp(log_ret) > 0 THEN avg(log_ret) * 12 / (stddev_samp(log_ret) * sqrt(12.0)) ELSE 0 END AS mes FROM ex GROUP BY 1),
gt AS (SELECT bo.scenario AS variant, ann_lower_95, s1.max_drawdown AS dd_base, s2.max_drawdown AS dd_stress, s2.cagr AS cagr_stress, coalesce(years_ok, false) AS years_ok, mes AS monthly_excess_sharpe
 FROM boot bo JOIN stx s1 ON s1.k = bo.scenario || '@1.0' JOIN stx s2 ON s2.k = bo.scenario || '@2.0' LEFT JOIN yo ON yo.scenario = bo.scenario JOIN ms_ ON ms_.scenario = bo.scenario),
g3 AS (SELECT *, ann_lower_95 > 0 AS gate_a, abs(dd_base) <= 0.15 AND abs(dd_stress) <= 0.15 AS gate_b, cagr_stress >= 0.02 AS gate_c FROM gt)"""


@query("trend_screening", "B7 A16 R1 A3 J16", "variant:s ann_lower_95:d dd_base:d dd_stress:d cagr_stress:d monthly_excess_sharpe:d years_ok:b gate_a:b gate_b:b gate_c:b", f"""
WITH RECURSIVE {SCREEN_SQL} SELECT * FROM g3""")
def trend_screening(spark, folder):
    return screening(spark, folder).withColumn("years_ok", F.coalesce("years_ok", F.lit(False)))


HELD_OUT = "ho AS (SELECT * FROM tg WHERE d > (SELECT count(*) * 3 // 5 FROM p_cal))"
HOLDOUT_SQL = SCREEN_SQL.replace(loop_sql(LADDER), f"{HELD_OUT}, {loop_sql(LADDER, targets='ho')}")


def holdout_daily(spark, folder):
    """Books restarted from cash after the first three fifths of the calendar, so that the entry is paid for, at every cost setting."""
    def build():
        r = returns_panel(spark, folder)
        cut = panels.calendar(spark, folder, "week").select(F.floor(F.count(F.lit(1)) * 3 / 5)).scalar()
        t = targets(spark, folder).where(F.col("decision_pos") > cut)
        return accounting.lagged_returns(r, weekly_cash(spark, folder), t, cost_grid(spark), symbol_bp(r))
    return tables.kept(spark, ("holdout_daily", folder), build).join(panels.calendar(spark, folder, "week"), "pos")


@query("holdout_gates", "A17 R1", "variant:s ann_lower_95:d dd_base:d dd_stress:d cagr_stress:d gate_a:b gate_b:b gate_c:b passed_all:b", f"""
WITH RECURSIVE {HOLDOUT_SQL} SELECT *, gate_a AND gate_b AND gate_c AS passed_all FROM g3""")
def holdout_gates(spark, folder):
    gates = statistics.screening_gates(gate_facts(holdout_daily(spark, folder), weekly_cash(spark, folder)))
    return gates.withColumn("passed_all", F.col("passed_abc")).withColumnRenamed("scenario", "variant")


@query("holdout_entry_costs", "A17 B6", "scenario:s cost_mult:d entry_ts:t entry_cost:d entry_turnover:d growth:d trade_cost_sum:d borrow_cost_sum:d", f"""
WITH RECURSIVE {SIGNALS_SQL}, {HELD_OUT}, {loop_sql(LADDER, targets='ho')}
SELECT scenario, cost_mult, min(ts) AS entry_ts, arg_min(trade_cost, ts) AS entry_cost, arg_min(turnover, ts) AS entry_turnover, product(1 + net) AS growth,
 sum(trade_cost) AS trade_cost_sum, sum(borrow_cost) AS borrow_cost_sum FROM bk GROUP BY 1, 2""")
def holdout_entry_costs(spark, folder):
    return holdout_daily(spark, folder).groupBy("scenario", "cost_mult").agg(
        F.min("ts").alias("entry_ts"), F.min_by("trade_cost", "ts").alias("entry_cost"), F.min_by("turnover", "ts").alias("entry_turnover"),
        F.product(1 + F.col("net")).alias("growth"), F.sum("trade_cost").alias("trade_cost_sum"), F.sum("borrow_cost").alias("borrow_cost_sum"))


LOO_SQL = f"""{SIGNALS_SQL.rsplit('rw AS', 1)[0]} exq AS (SELECT 'loo_' || symbol AS exclude_id, symbol FROM SLEEVES UNION ALL SELECT 'loo_sleeve_' || sleeve, symbol FROM SLEEVES),
sx AS (SELECT sm.scenario || '#' || i.exclude_id AS scenario, sm.d, sm.symbol, signal, vol FROM sm, (SELECT DISTINCT exclude_id FROM exq) i WHERE NOT EXISTS (SELECT 1 FROM exq e WHERE e.exclude_id = i.exclude_id AND e.symbol = sm.symbol)),
rw AS (SELECT *, coalesce(CASE WHEN vol > 0 THEN signal / vol END, 0) AS raw FROM sx),
bw AS (SELECT *, CASE WHEN sum(abs(raw)) OVER g > 0 THEN raw / sum(abs(raw)) OVER g ELSE 0 END AS base FROM rw WINDOW g AS (PARTITION BY scenario, d)),
pr AS (SELECT scenario, d, stddev_samp(x) * sqrt(252.0) AS risk FROM (SELECT b.scenario, b.d, r.pos, sum(b.base * r.ret) AS x FROM bw b JOIN r ON r.symbol = b.symbol AND r.pos BETWEEN b.d - {TRAIL - 1} AND b.d WHERE base <> 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
tg AS (SELECT q.scenario, q.d, y.symbol, coalesce(b.base, 0) * CASE WHEN risk > 0 THEN least(1, 0.10 / risk) ELSE 1 END AS weight FROM (SELECT DISTINCT scenario, d FROM bw) q, (SELECT DISTINCT symbol FROM r) y
 LEFT JOIN bw b ON b.scenario = q.scenario AND b.d = q.d AND b.symbol = y.symbol LEFT JOIN pr ON pr.scenario = q.scenario AND pr.d = q.d)"""


def _loo_sql() -> str:
    from .alignment import SLEEVE_SQL
    return LOO_SQL.replace("SLEEVES", SLEEVE_SQL)


@query("leave_one_out_excess", "J16 B7 A16", "scenario:s exclude_id:s excess:d", f"""
WITH RECURSIVE {_loo_sql()}, {loop_sql(LADDER[:1])}, mo AS (SELECT split_part(scenario, '#', 1) AS s, split_part(scenario, '#', 2) AS e, date_trunc('month', ts) AS month, sum(ln(1 + net)) AS l FROM bk GROUP BY 1, 2, 3)
SELECT a.s AS scenario, a.e AS exclude_id, exp(sum(a.l - b.l)) - 1 AS excess FROM mo a JOIN mo b ON a.e = b.e AND a.month = b.month AND a.s <> 'matched_long' AND b.s = 'matched_long' GROUP BY 1, 2""")
def leave_one_out_excess(spark, folder):
    every = signals(spark, folder)
    return leave_one_out(spark, every, returns_panel(spark, folder), weekly_cash(spark, folder),
                         every.where("scenario <> 'matched_long'").select("scenario").distinct())


# On the supplied prices no variant beats the matched book.  With the returns turned round some do, and at these limits the
# leave-one-out books and gate D come into play; volatilities and caps do not depend on the sign.
WIDE_LIMITS = {"dd_cap": 0.5, "floor": -0.5, "least_excess": -0.5}


def _all_gates_sql() -> str:
    w = WIDE_LIMITS
    loo = f"""WITH RECURSIVE {_loo_sql()}, {loop_sql(LADDER[:1])}, mo AS (SELECT split_part(scenario, '#', 1) AS s, split_part(scenario, '#', 2) AS e, date_trunc('month', ts) AS month, sum(ln(1 + net)) AS l FROM bk GROUP BY 1, 2, 3),
xs AS (SELECT a.s AS scenario, a.e AS exclude_id, exp(sum(a.l - b.l)) - 1 AS excess FROM mo a JOIN mo b ON a.e = b.e AND a.month = b.month AND a.s <> 'matched_long' AND b.s = 'matched_long' GROUP BY 1, 2)
SELECT scenario AS variant, bool_and(excess > 0) AS loo_ok FROM xs GROUP BY 1"""
    return f"""{SCREEN_SQL}, g4 AS (SELECT * EXCLUDE (gate_a, gate_b, gate_c), ann_lower_95 > {w['least_excess']} AS gate_a, abs(dd_base) <= {w['dd_cap']} AND abs(dd_stress) <= {w['dd_cap']} AS gate_b,
 cagr_stress >= {w['floor']} AS gate_c FROM g3), lo AS ({loo}),
g5 AS (SELECT g4.*, gate_a AND gate_b AND gate_c AS passed_abc, gate_a AND gate_b AND gate_c AND coalesce(lo.loo_ok, false) AS loo_ok FROM g4 LEFT JOIN lo USING (variant)),
g6 AS (SELECT *, years_ok AND loo_ok AS gate_d, passed_abc AND years_ok AND loo_ok AS passed_all FROM g5)""".replace("- 1) / 50 AS ret", "- 1) / -50 AS ret")


def all_gates(spark, folder):
    out = screening(spark, folder, scale=-50.0, **WIDE_LIMITS)
    return out.na.fill(False, ["years_ok", "loo_ok"])


@query("screening_all_gates", "A16 B7 J16", "variant:s monthly_excess_sharpe:d years_ok:b loo_ok:b gate_a:b gate_b:b gate_c:b gate_d:b passed_abc:b passed_all:b", f"""
WITH RECURSIVE {_all_gates_sql()} SELECT * FROM g6""")
def screening_all_gates(spark, folder):
    return all_gates(spark, folder)


@query("screening_candidate", "X14 A16", "candidate:s", f"""
WITH RECURSIVE {_all_gates_sql()} SELECT variant AS candidate FROM g6 WHERE passed_all ORDER BY monthly_excess_sharpe DESC, variant LIMIT 1""")
def screening_candidate(spark, folder):
    return statistics.pick_candidate(all_gates(spark, folder))


NAV_CASES = (1, 4)


def nav_targets(spark, folder):
    """Inverse-volatility targets gated by 26-week momentum, decided every row or every fourth row."""
    r = returns_panel(spark, folder)
    d = rolling.per_symbol(r, lambda w: {"vol": rolling.floored(rolling.sd("ret", 13, w))}, 13).where(F.col("vol").isNotNull())
    sign = rolling.trend_signs(panels.aligned(spark, folder, "week"), LOOK).select("symbol", "pos", F.col("mom26").alias("pred"))
    d = ranking.gated_inverse_vol(d.join(sign, ["symbol", "pos"]).where(F.col("pos") >= 60))
    cases = F.explode(F.array(*[F.lit(h) for h in NAV_CASES]))
    return (d.withColumn("_h", cases).where((F.col("pos") - 60) % F.col("_h") == 0)
            .select(F.concat(F.lit("hold"), F.col("_h").cast("string")).alias("scenario"),
                    F.concat(F.lit("hold"), F.col("_h").cast("string")).alias("schedule"),
                    F.col("pos").alias("decision_pos"), "symbol", F.col("base").alias("weight")))


NAV_SQL = f"""{SIGNALS_SQL}, nv AS (SELECT symbol, pos, CASE WHEN count(ret) OVER {c.frame(13)} = 13 THEN greatest(stddev_samp(ret) OVER {c.frame(13)}, 1e-6) END AS vol FROM r),
nt AS (SELECT 'hold' || h AS scenario, nv.symbol, nv.pos AS d, CASE WHEN mom26 > 0 THEN 1 / vol / sum(1 / vol) OVER (PARTITION BY h, nv.pos) ELSE 0 END AS weight FROM nv JOIN sg1 USING (symbol, pos), (VALUES (1), (4)) v(h) WHERE nv.pos >= 60 AND (nv.pos - 60) % h = 0),
dl AS (SELECT pos, list(ret ORDER BY symbol) AS rs, max(cash) AS cash FROM r JOIN ck USING (pos) GROUP BY 1),
tl AS (SELECT scenario, d + 1 AS fpos, list(weight ORDER BY symbol) AS tw FROM nt GROUP BY scenario, d),
zz AS (SELECT list(0.0::DOUBLE ORDER BY symbol) AS zs FROM (SELECT DISTINCT symbol FROM r)),
lp AS (SELECT scenario, bp, 0::BIGINT AS pos, zs AS w, 0.0::DOUBLE AS growth, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS gross FROM (SELECT DISTINCT scenario FROM tl), (VALUES (3.0::DOUBLE), (15.0::DOUBLE)) v(bp), zz
 UNION ALL SELECT scenario, bp, pos, CASE WHEN tw IS NULL THEN list_transform(h, lambda x: x / g) ELSE tw END, g, f5, CASE WHEN tw IS NULL THEN 0.0 ELSE f5 / bp * 1e4 END,
  CASE WHEN tw IS NULL THEN list_sum(h) / g ELSE list_sum(tw) END FROM (SELECT *, {{F5}} FROM (SELECT *, list_sum(h) + cv AS g FROM
  (SELECT lp.scenario, lp.bp, dl.pos, tl.tw, list_transform(range(1, len(lp.w) + 1), lambda i: lp.w[i] * (1 + dl.rs[i])) AS h, greatest(0, 1 - list_sum(lp.w)) * (1 + dl.cash) AS cv
   FROM lp JOIN dl ON dl.pos = lp.pos + 1 LEFT JOIN tl ON tl.fpos = dl.pos AND tl.scenario = lp.scenario))))"""


def _nav_sql() -> str:
    """Five rounds of fee = rate * turnover(fee) reach the root: each shrinks the error by the rate."""
    rounds, fee = [], "0.0"
    for i in range(1, 6):
        rounds.append(f"CASE WHEN tw IS NULL THEN 0.0 ELSE bp / 1e4 * list_sum(list_transform(range(1, len(h) + 1), "
                      f"lambda j: abs(tw[j] * (g - {fee}) - h[j]))) END AS f{i}")
        fee = f"f{i}"
    opening = "".join(f"(SELECT *, {r} FROM " for r in reversed(rounds))
    inner = "(SELECT *, list_sum(h) + cv AS g FROM"
    return NAV_SQL.replace("(SELECT *, {F5} FROM " + inner, opening + inner) + ")" * (len(rounds) - 1)


@query("self_financing_value", "B2 M7 P7", "scenario:s cost_bp:d ts:t net:d cost:d turnover:d gross:d", f"""
WITH RECURSIVE {_nav_sql()} SELECT scenario, bp AS cost_bp, ts, growth - cost - 1 AS net, cost, turnover, gross FROM lp JOIN p_cal USING (pos) WHERE pos > 0""")
def self_financing_value(spark, folder):
    # the first calendar row has no return: rows are numbered from the first return on
    back = F.col("pos") - 1
    cash = weekly_cash(spark, folder).where("pos > 0").withColumn("pos", back)
    t = nav_targets(spark, folder).withColumn("decision_pos", F.col("decision_pos") - 1)
    out = accounting.self_financing(returns_panel(spark, folder).withColumn("pos", back), cash, t, (3.0, 15.0))
    return out.join(cash.select("pos", "ts"), "pos")
