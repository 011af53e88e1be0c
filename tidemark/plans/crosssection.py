"""Ranks, books, selection and weights per timestamp."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import borrow_cost, trade_cost
from ..operators import blocks, calendars, ranking, rolling, scoring
from ..sources import tables
from . import ctes as c
from . import panels
from .registry import query

W = c.W

K_SQL = """kk AS (SELECT symbol, CASE WHEN q < 1e-6 THEN 0.0 ELSE 0.5 / q END AS k FROM
 (SELECT symbol, quantile_cont(abs(mu / (sigma * sigma + 1e-6)), 0.95) AS q FROM fc GROUP BY 1))"""


@query("calibrated_k", "A26", "symbol:s k:d", f"WITH {panels.FORECASTS}, {K_SQL} SELECT * FROM kk")
def calibrated_k(spark, folder):
    return scoring.calibrate_k(panels.forecasts(spark, folder))


TRAIN, TEST, PURGE = 200, 100, 1
FOLDS_SQL = f"""fd AS (SELECT s, s // {TEST} AS fold FROM (SELECT unnest(range(0, greatest(n - {TRAIN + TEST} + 1, 0), {TEST})) AS s FROM (SELECT count(*) AS n FROM b_cal))),
kf AS (SELECT symbol, fold, CASE WHEN q < 1e-6 THEN 0.0 ELSE 0.5 / q END AS k FROM
 (SELECT symbol, fold, quantile_cont(abs(mu / (sigma * sigma + 1e-6)), 0.95) AS q FROM fc JOIN fd ON pos >= s AND pos < s + {TRAIN - PURGE} GROUP BY 1, 2)),
ex AS (SELECT pos, lead(ts) OVER (ORDER BY ts) - ts = INTERVAL 1 HOUR AS exact FROM b_cal),
te AS (SELECT fold, ex.pos FROM ex JOIN fd ON ex.pos >= s + {TRAIN} AND ex.pos < s + {TRAIN + TEST} WHERE exact)"""
SCORES_SQL = f"""{panels.FORECASTS}, {FOLDS_SQL},
w0 AS (SELECT *, list(mu) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS past,
 exp(ln(lead(price) OVER {W}) - ln(price)) - 1 AS fwd, (price - lag(price, 20) OVER {W}) / lag(price, 20) OVER {W} AS momentum FROM fc),
w1 AS (SELECT w0.*, te.fold, mu / (sigma + 1e-6) AS mu_over_sigma, k * mu / (sigma * sigma + 1e-6) AS kelly_edge,
 CASE WHEN coalesce(len(past), 0) > 0 THEN len(list_filter(past, lambda v: v <= mu))::DOUBLE / len(past) ELSE 0.5 END AS mu_percentile,
 {c.uniform('7', 'w0.pos', 'w0.symbol')} AS random
 FROM w0 JOIN te USING (pos) JOIN kf ON kf.symbol = w0.symbol AND kf.fold = te.fold),
sc AS (SELECT symbol, ts, pos, fold, fwd, variant, score FROM (SELECT symbol, ts, pos, fold, fwd, mu, mu_over_sigma, kelly_edge, p_up, mu_percentile,
 random, momentum, -momentum AS reversal FROM w1) UNPIVOT (score FOR variant IN (mu, mu_over_sigma, kelly_edge, p_up, mu_percentile, random, momentum, reversal)))"""


def scored(spark, folder):
    """Test bars of the walk-forward folds; k comes from each fold's training slice, histories run over all bars."""
    def build():
        calendar = panels.event_aligned(spark, folder).select("ts", "pos").distinct()
        folds = calendars.rolling_folds(calendar, TRAIN, TEST, TEST, purge=PURGE)
        bars = scoring.evaluated_bars(calendar, folds, 3600)
        f = panels.forecasts(spark, folder)
        f = scoring.simple_forward(rolling.forward_log_return(f, 1)).select("symbol", "ts", "pos", "price", "fwd", "mu", "sigma", "p_up")
        tested = f.join(bars, "pos", "left")
        keep = ["symbol", "ts", "pos", "fold", "step", "fwd", "variant", "score"]
        model = scoring.score_variants(tested, scoring.walk_forward_k(f, folds), 50, ("fold", "symbol")).select(*keep)
        base = tested.select("symbol", "ts", "pos", "fold", "step", "price", "fwd")
        rnd = ranking.hash_scores(base, 7).withColumn("variant", F.lit("random"))
        mom = rolling.bar_momentum(base, 20)
        rows = [rnd, mom.withColumn("score", F.col("momentum")).withColumn("variant", F.lit("momentum")),
                mom.withColumn("score", F.col("reversal")).withColumn("variant", F.lit("reversal"))]
        for r in rows:
            model = model.unionByName(r.where(F.col("fold").isNotNull()).select(*keep))
        return model
    return tables.kept(spark, ("scored", folder), build)


@query("score_variants", "P19 P20 W27 W28 X16", "symbol:s ts:t variant:s score:d fwd:d", f"WITH {SCORES_SQL} SELECT * FROM sc")
def score_variants(spark, folder):
    return scored(spark, folder)


RANK_SQL = f"""{SCORES_SQL}, both_ AS (SELECT * FROM sc WHERE fwd IS NOT NULL AND score IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY ts, variant ORDER BY score) + (count(*) OVER (PARTITION BY ts, variant, score) - 1) / 2.0 AS rs,
 rank() OVER (PARTITION BY ts, variant ORDER BY fwd) + (count(*) OVER (PARTITION BY ts, variant, fwd) - 1) / 2.0 AS rf,
 row_number() OVER (PARTITION BY ts, variant ORDER BY score DESC, symbol) AS place, count(*) OVER (PARTITION BY ts, variant) AS n FROM both_)"""


@query("rank_ic", "X3", "ts:t variant:s ic:d n:i", f"""
WITH {RANK_SQL}, g AS (SELECT ts, variant, count(*) AS n, corr(rs, rf) AS ic FROM rk GROUP BY 1, 2)
SELECT ts, variant, CASE WHEN n >= 3 AND NOT isnan(ic) THEN ic END AS ic, n FROM g""")
def rank_ic(spark, folder):
    return ranking.rank_ic(scored(spark, folder))


@query("gross_spread", "X4", "ts:t variant:s spread:d", f"""
WITH {RANK_SQL} SELECT ts, variant, CASE WHEN max(n) >= 4 THEN sum(CASE WHEN place <= 2 THEN fwd END) / 2 - sum(CASE WHEN place > n - 2 THEN fwd END) / 2 END AS spread
FROM rk GROUP BY 1, 2""")
def gross_spread(spark, folder):
    return ranking.gross_spread(scored(spark, folder), 2, 2)


BOOK_SQL = f"""{RANK_SQL}, book AS (SELECT *, CASE WHEN place > n - 2 THEN -0.25 WHEN place <= 2 THEN 0.25 ELSE 0.0 END AS weight
 FROM rk WHERE n >= 4), tv AS (SELECT fold, variant, ts, sum(abs(weight - coalesce(pw, 0))) AS turnover FROM
 (SELECT *, lag(weight) OVER (PARTITION BY fold, variant, symbol ORDER BY pos) AS pw FROM book) GROUP BY 1, 2, 3)"""


def _book(spark, folder):
    return ranking.ranked_book(scored(spark, folder), 2, 2)


@query("ranked_book_weights", "X5", "symbol:s ts:t variant:s weight:d", f"WITH {BOOK_SQL} SELECT symbol, ts, variant, weight FROM book")
def ranked_book_weights(spark, folder):
    return _book(spark, folder)


@query("book_turnover", "X6", "fold:i variant:s ts:t turnover:d", f"WITH {BOOK_SQL} SELECT * FROM tv")
def book_turnover(spark, folder):
    return ranking.book_turnover(_book(spark, folder))


PER_BAR_SQL = f"""{BOOK_SQL}, ics AS (SELECT ts, variant, CASE WHEN count(*) >= 3 AND NOT isnan(corr(rs, rf)) THEN corr(rs, rf) END AS ic,
 CASE WHEN max(n) >= 4 THEN sum(CASE WHEN place <= 2 THEN fwd END) / 2 - sum(CASE WHEN place > n - 2 THEN fwd END) / 2 END AS spread FROM rk GROUP BY 1, 2),
pb AS (SELECT fold, variant, ts, ic, spread, turnover FROM tv JOIN ics USING (ts, variant))"""


def per_bar(spark, folder):
    s = scored(spark, folder)
    return tables.kept(spark, ("per_bar", folder), lambda: (
        ranking.book_turnover(_book(spark, folder))
        .join(ranking.rank_ic(s).drop("n"), ["ts", "variant"]).join(ranking.gross_spread(s, 2, 2), ["ts", "variant"])))


@query("signal_diagnostics", "A21 A11 A2", "variant:s mean_ic:d n_ic:i mean_spread:d mean_turnover:d ic_sd_folds:d share_folds_positive:d "
       "folds:i log_growth_gross1:d max_drawdown_gross1:d breakeven_cost:d", f"""
WITH {PER_BAR_SQL}, e AS (SELECT variant, ts, exp(sum(ln(abs(1 + spread / 2))) OVER v) * CASE WHEN sum(CASE WHEN spread < -2 THEN 1 ELSE 0 END) OVER v % 2 = 1 THEN -1 ELSE 1 END AS eq FROM pb WHERE spread IS NOT NULL WINDOW v AS (PARTITION BY variant ORDER BY ts)),
dd AS (SELECT variant, ts, eq, eq / greatest(1, max(eq) OVER (PARTITION BY variant ORDER BY ts)) - 1 AS d FROM e),
cv AS (SELECT variant, ln(arg_max(eq, ts)) AS log_growth_gross1, least(min(d), 0) AS max_drawdown_gross1 FROM dd GROUP BY 1),
fo AS (SELECT variant, stddev_pop(m) AS ic_sd_folds, avg(CASE WHEN m > 1e-12 THEN 1.0 ELSE 0.0 END) AS share_folds_positive, count(*) AS folds
 FROM (SELECT variant, fold, avg(ic) AS m FROM pb WHERE ic IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
fl AS (SELECT variant, avg(ic) AS mean_ic, count(ic) AS n_ic, avg(spread) AS mean_spread, avg(turnover) AS mean_turnover FROM pb GROUP BY 1)
SELECT *, mean_spread / 2 / mean_turnover AS breakeven_cost FROM fl JOIN fo USING (variant) JOIN cv USING (variant)""")
def signal_diagnostics(spark, folder):
    d = scoring.diagnostics(per_bar(spark, folder))
    return d.withColumn("log_growth_gross1", F.log("final_equity"))


HYST_SQL = f"""{panels.FORECASTS}, ed AS (SELECT symbol, ts, pos, mu / (sigma * sigma + 1e-6) AS edge FROM fc),
pl AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY edge DESC, symbol) AS place, count(*) OVER (PARTITION BY pos) AS n FROM ed),
ev AS (SELECT *, CASE WHEN place <= 1 THEN 1 WHEN place > 2 THEN 0 END AS le, CASE WHEN n - place + 1 <= 1 THEN 1 WHEN n - place + 1 > 2 THEN 0 END AS se FROM pl),
sd AS (SELECT *, coalesce(last_value(le IGNORE NULLS) OVER {W}, 0) - coalesce(last_value(se IGNORE NULLS) OVER {W}, 0) AS side FROM ev),
nw AS (SELECT *, CASE WHEN side <> 0 THEN side * 0.5 / count(*) OVER (PARTITION BY pos, side) ELSE 0.0 END AS weight FROM sd)"""


def hysteresis(spark, folder, zone=2):
    f = panels.forecasts(spark, folder)
    edges = f.select("symbol", "ts", "pos", (F.col("mu") / (F.col("sigma") * F.col("sigma") + 1e-6)).alias("edge"),
                     F.col("symbol").alias("universe_pos"))
    return ranking.neutral_weights(ranking.hysteresis_sides(edges, 1, 1, zone))


@query("hysteresis_selection", "X8 X7", "symbol:s ts:t place:i side:i weight:d", f"WITH {HYST_SQL} SELECT * FROM nw")
def hysteresis_selection(spark, folder):
    return hysteresis(spark, folder)


@query("hysteresis_overlapping_zones", "X8 X7", "symbol:s ts:t place:i side:i weight:d zone_overlap:b", f"""
WITH RECURSIVE {panels.FORECASTS}, ed AS (SELECT symbol, ts, pos, mu / (sigma * sigma + 1e-6) AS edge FROM fc),
pl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY edge DESC, symbol) AS place, count(*) OVER (PARTITION BY pos) AS n,
 row_number() OVER (PARTITION BY symbol ORDER BY pos) AS nth FROM ed),
st AS (SELECT symbol, 0::BIGINT AS nth, 0 AS side FROM (SELECT DISTINCT symbol FROM pl) UNION ALL
 SELECT symbol, nth, CASE WHEN lg AND (NOT sh OR was = 1) THEN 1 WHEN sh THEN -1 ELSE 0 END FROM (
  SELECT st.symbol, pl.nth, st.side AS was, place <= 1 OR st.side = 1 AND place <= 4 AS lg, n - place < 1 OR st.side = -1 AND n - place < 4 AS sh
  FROM st JOIN pl ON pl.symbol = st.symbol AND pl.nth = st.nth + 1))
SELECT symbol, ts, place, side, CASE WHEN side <> 0 THEN side * 0.5 / count(*) OVER (PARTITION BY pos, side) ELSE 0.0 END AS weight, n < 8 AS zone_overlap
FROM pl JOIN st USING (symbol, nth)""")
def hysteresis_overlapping_zones(spark, folder):
    return hysteresis(spark, folder, 4)


@query("net_exposure", "A30", "mean_abs_net:d max_abs_net:d bars:i", f"""
WITH {HYST_SQL}, x AS (SELECT pos, abs(sum(CASE WHEN symbol <> 'view' THEN weight ELSE 0 END)) AS a FROM nw GROUP BY 1)
SELECT avg(a) AS mean_abs_net, max(a) AS max_abs_net, count(*) AS bars FROM x""")
def net_exposure(spark, folder):
    held = hysteresis(spark, folder).withColumn("weight", F.when(F.col("symbol") != "view", F.col("weight")).otherwise(0.0))
    return (held.groupBy("pos").agg(F.abs(F.sum("weight")).alias("a"))
            .agg(F.avg("a").alias("mean_abs_net"), F.max("a").alias("max_abs_net"), F.count(F.lit(1)).alias("bars")))



@query("capped_inverse_vol_targets", "X9 X11 X13", "symbol:s ts:t base:d risk:d weight:d", f"""
WITH {panels.ALIGNED_DAY}, c0 AS (SELECT *, price / lag(price) OVER {W} - 1 AS ret FROM p),
c1 AS (SELECT *, {c.full('stddev_samp', 'ret', 63)} AS vol, price / lag(price, 126) OVER {W} - 1 AS pred FROM c0),
b AS (SELECT *, CASE WHEN pred > 0 THEN 1 / vol / sum(1 / vol) OVER (PARTITION BY ts) ELSE 0 END AS base FROM c1 WHERE pos >= 126 AND (pos - 126) % 21 = 0),
d AS (SELECT b.pos AS dpos, c0.pos, sum(b.base * c0.ret) AS r FROM b JOIN c0 ON b.symbol = c0.symbol AND c0.pos BETWEEN b.pos - 62 AND b.pos WHERE b.base <> 0 GROUP BY 1, 2),
k AS (SELECT dpos, stddev_samp(r) * sqrt(252.0) AS risk FROM d GROUP BY 1)
SELECT b.symbol, b.ts, b.base, k.risk, b.base * coalesce(least(1, 0.10 / k.risk), 1) AS weight FROM b LEFT JOIN k ON b.pos = k.dpos""")
def capped_inverse_vol_targets(spark, folder):
    p = rolling.returns(panels.aligned(spark, folder))
    d = rolling.per_symbol(p, lambda w: {"vol": rolling.sd("ret", 63, w), "pred": rolling.change(w, 126)}, 126)
    d = d.where((F.col("pos") >= 126) & calendars.cadence(F.col("pos"), 126, 21))
    base = ranking.gated_inverse_vol(d).select("symbol", "ts", F.col("pos").alias("decision_pos"), "base")
    return ranking.volatility_cap(base, p, [])


@query("signal_weight_bases", "X10", "mode:s symbol:s ts:t base:d", f"""
WITH {panels.ALIGNED_DAY}, c0 AS (SELECT *, price / lag(price) OVER {W} - 1 AS ret FROM p),
c1 AS (SELECT *, {c.full('stddev_samp', 'ret', 63)} AS vol, sign(price / lag(price, 63) OVER {W} - 1) AS sig FROM c0),
m AS (SELECT mode, c1.*, CASE WHEN mode = 'long_flat' THEN CASE WHEN sig IS NOT NULL THEN greatest(sig, 0) END ELSE sig END AS s2 FROM c1, (VALUES ('long_flat'), ('long_short')) v(mode)),
r AS (SELECT *, coalesce(CASE WHEN vol > 0 THEN s2 / vol END, 0) AS raw FROM m)
SELECT mode, symbol, ts, CASE WHEN sum(abs(raw)) OVER (PARTITION BY mode, ts) > 0 THEN raw / sum(abs(raw)) OVER (PARTITION BY mode, ts) ELSE 0 END AS base FROM r""")
def signal_weight_bases(spark, folder):
    p = rolling.returns(panels.aligned(spark, folder))
    d = rolling.per_symbol(p, lambda w: {"vol": rolling.sd("ret", 63, w), "signal": F.signum(rolling.change(w, 63))}, 63)
    d = d.withColumn("mode", F.explode(F.array(F.lit("long_flat"), F.lit("long_short"))))
    return ranking.signal_weights(d, ["mode", "ts"], F.col("mode") == "long_flat")


@query("rebalance_costs", "P13 P14", "ts:t trade_cost:d borrow_cost:d", f"""
WITH {HYST_SQL}, d AS (SELECT *, weight - coalesce(lag(weight) OVER {W}, 0) AS dw FROM nw)
SELECT ts, sum(abs(dw) * CASE WHEN symbol = 'view' THEN 1.5 ELSE 3.0 END / 1e4) * 2e4 AS trade_cost, sum(CASE WHEN weight < 0 THEN -weight ELSE 0 END) * 50 / 1e4 / 252 * 2e4 AS borrow_cost FROM d GROUP BY ts""")
def rebalance_costs(spark, folder):
    moved = rolling.per_symbol(hysteresis(spark, folder), lambda w: {
        "dw": F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))}, 1)
    bp = F.when(F.col("symbol") == "view", 1.5).otherwise(3.0)
    return moved.groupBy("ts").agg(trade_cost(F.col("dw"), bp, 2e4).alias("trade_cost"),
                                   borrow_cost(F.col("weight"), 50.0, 2e4).alias("borrow_cost"))


@query("equal_weight_period_return", "X15", "ts:t mean_ret:d symbols:i", f"""
WITH {c.brand('week')}, {c.own_pos()}, r AS (SELECT symbol, ts, ln(price) - ln(lag(price) OVER {W}) AS log_ret FROM p)
SELECT ts, avg(log_ret) AS mean_ret, count(log_ret) AS symbols FROM r GROUP BY 1""")
def equal_weight_period_return(spark, folder):
    p = rolling.returns(blocks.numbered(tables.brand_panel(spark, folder), ["symbol"]))
    return p.groupBy("ts").agg(F.avg("log_ret").alias("mean_ret"), F.count("log_ret").alias("symbols"))
