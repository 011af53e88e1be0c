"""Indicators, events, labels and latches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import target_position
from ..operators import accounting, blocks, calendars, events, rolling
from ..sources import tables
from ..sources.quality import bar_usable
from . import crosssection, ctes as c
from . import panels
from .registry import query

W = c.W


def bars(spark, folder):
    """Daily open/high/low/close with a lifted trend and a few broken bars."""
    def build():
        b = blocks.numbered(tables.ohlc_panel(spark, folder, "day"), ["symbol"])
        lift = F.exp(F.col("pos") * 0.001)
        out = b
        for x in ("open", "high", "low", "close"):
            out = out.withColumn(x, (100 + F.col(x) / 1000) * lift)
        return out.withColumn("close", F.when((F.year("ts") == 1997) & (F.dayofyear("ts") == 40), -F.col("close")).otherwise(F.col("close")))
    return tables.kept(spark, ("ohlc_day", folder), build)


BARS_SQL = f"""{c.ohlc('day')}, {c.own_pos('ohlc', 'o')}, lb AS (SELECT symbol, ts, pos, {", ".join(f"(100 + {x} / 1000) * exp(pos * 0.001) AS {x}" for x in ("open", "high", "low"))},
 CASE WHEN year(ts) = 1997 AND dayofyear(ts) = 40 THEN -((100 + close / 1000) * exp(pos * 0.001)) ELSE (100 + close / 1000) * exp(pos * 0.001) END AS close FROM o)"""

RUNS_SQL = f"""{BARS_SQL}, va AS (SELECT *, open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low AS valid FROM lb),
rn AS (SELECT *, pos - coalesce(max(CASE WHEN NOT valid THEN pos END) OVER {W}, -1) AS run_length FROM va)"""


def _ema_sql(n: int) -> str:
    a = 2 / (n + 1)
    g = 1 - a
    return f"""CASE WHEN valid AND run_length >= {n} THEN pow({g!r}, pos - 1250) * sum(CASE WHEN run_length <= {n} THEN close / {n} * pow({g!r}, 1250 - (pos - run_length + {n}))
 ELSE {a!r} * close * pow({g!r}, 1250 - pos) END) OVER rw END AS ema{n}"""


IND_SQL = f"""{RUNS_SQL}, i0 AS (SELECT *, CASE WHEN valid THEN pos - run_length END AS run_, CASE WHEN valid AND run_length >= 2 THEN ln(close / lag(close) OVER {W}) END AS logret,
 CASE WHEN valid AND run_length >= 2 THEN abs(close - lag(close) OVER {W}) END AS mv,
 CASE WHEN valid AND run_length >= 2 THEN greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) END AS tr FROM rn),
i1 AS (SELECT *, CASE WHEN valid AND run_length >= 21 THEN avg(tr) OVER {c.frame(20)} END AS atr20, CASE WHEN valid AND run_length >= 6 THEN stddev_samp(logret) OVER {c.frame(5)} END AS sigma5,
 CASE WHEN valid AND run_length >= 21 THEN stddev_samp(logret) OVER {c.frame(20)} END AS sigma20,
 CASE WHEN valid AND run_length >= 21 THEN abs(close - lag(close, 20) OVER {W}) / nullif(sum(mv) OVER {c.frame(20)}, 0) END AS er20,
 {_ema_sql(20)}, {_ema_sql(50)}, {_ema_sql(200)} FROM i0 WINDOW rw AS (PARTITION BY symbol, run_ ORDER BY pos)),
ind AS (SELECT *, coalesce(ema50 > ema200 AND ema50 > CASE WHEN run_length > 10 THEN lag(ema50, 10) OVER {W} END AND close > ema50, false) AS up FROM i1)"""


def indicator_frame(spark, folder):
    return tables.kept(spark, ("indicators", folder), lambda: events.indicators(bars(spark, folder)))


@query("valid_runs", "W20", "symbol:s ts:t valid:b run_length:i", f"WITH {RUNS_SQL} SELECT * FROM rn")
def valid_runs(spark, folder):
    return events.run_lengths(bars(spark, folder), bar_usable())


@query("bar_indicators", "E1 W21 W22 W23 W24 W25 W26", "symbol:s ts:t run_length:i logret:d tr:d atr20:d sigma5:d sigma20:d er20:d ema20:d ema50:d ema200:d up:b",
       f"WITH {IND_SQL} SELECT * FROM ind")
def bar_indicators(spark, folder):
    return indicator_frame(spark, folder)


LAG = "CASE WHEN run_length > 1 THEN lag({x}) OVER " + W + " END"
FLAG_SQL = f"""{IND_SQL}, lg AS (SELECT *, {", ".join(LAG.format(x=x) + f" AS {x}_1" for x in ("close", "high", "atr20", "ema20", "ema50", "up", "sigma5", "sigma20"))} FROM ind),
fl AS (SELECT *, coalesce(valid AND run_length >= 260 AND atr20_1 IS NOT NULL AND ema20_1 IS NOT NULL AND ema50_1 IS NOT NULL, false) AS usable,
 coalesce(up_1 AND close_1 > ema20_1 AND close < close_1 AND low <= ema20_1 + 0.25 * atr20_1 AND high >= ema20_1 - 0.25 * atr20_1 AND close > ema50_1, false) AS touch,
 coalesce(up AND close > high_1, false) AS confirm, coalesce(close <= ema50_1, false) AS broken FROM lg)"""

MACHINE_SQL = f"""{FLAG_SQL}, flm AS MATERIALIZED (SELECT symbol, pos, ts, usable, touch, confirm, broken FROM fl),
sm AS (SELECT symbol, -1::BIGINT AS pos, -1::BIGINT AS pending, -1::BIGINT AS blocked, false AS hit, -1::BIGINT AS setup FROM (SELECT DISTINCT symbol FROM flm)
 UNION ALL SELECT f.symbol, f.pos, CASE WHEN NOT usable THEN -1 WHEN f.pos <= blocked THEN pending WHEN pending >= 0 THEN CASE WHEN f.pos > pending + 3 OR broken OR confirm OR f.pos = pending + 3 THEN -1 ELSE pending END
  WHEN touch THEN f.pos ELSE -1 END, CASE WHEN usable AND f.pos > blocked AND pending >= 0 AND f.pos <= pending + 3 AND NOT broken AND confirm THEN f.pos + 10 ELSE blocked END,
  usable AND f.pos > blocked AND pending >= 0 AND f.pos <= pending + 3 AND NOT broken AND confirm, pending FROM sm JOIN flm f ON f.symbol = sm.symbol AND f.pos = sm.pos + 1),
ev AS (SELECT sm.symbol, sm.pos AS t, setup AS setup_start FROM sm WHERE hit)"""


def flagged(spark, folder):
    return events.setup_flags(indicator_frame(spark, folder))


@query("setup_predicates", "E2", "symbol:s ts:t flags:i", f"WITH {FLAG_SQL} SELECT symbol, ts, usable::INT + 2 * touch::INT + 4 * confirm::INT + 8 * broken::INT AS flags FROM fl")
def setup_predicates(spark, folder):
    return flagged(spark, folder)


def event_rows(spark, folder):
    return tables.kept(spark, ("events", folder), lambda: events.event_records(
        events.pullback_events(flagged(spark, folder), rows=512), indicator_frame(spark, folder)))


REC_SQL = f"""{MACHINE_SQL}, rec AS (SELECT ev.*, f.ts AS signal_time, f.atr20_1 AS R, (t - setup_start) / 3.0 AS c1,
 ((SELECT max(high) FROM lb h WHERE h.symbol = ev.symbol AND h.pos BETWEEN setup_start - 20 AND setup_start - 1) - (SELECT min(low) FROM lb h WHERE h.symbol = ev.symbol AND h.pos BETWEEN setup_start AND t)) / g.atr20_1 AS c2,
 (f.close - f.high_1) / f.atr20_1 AS c3, f.atr20_1 / f.close AS c4 FROM ev JOIN fl f ON f.symbol = ev.symbol AND f.pos = ev.t JOIN fl g ON g.symbol = ev.symbol AND g.pos = ev.setup_start)"""


@query("pullback_events", "E3", "symbol:s t:i setup_start:i", f"WITH RECURSIVE {MACHINE_SQL} SELECT * FROM ev")
def pullback_events(spark, folder):
    return events.pullback_events(flagged(spark, folder), rows=512)


@query("event_records", "E3 E4", "symbol:s t:i setup_start:i signal_time:t R:d c1:d c2:d c3:d c4:d", f"WITH RECURSIVE {REC_SQL} SELECT * FROM rec")
def event_records(spark, folder):
    return event_rows(spark, folder).select("*", *[F.col("context")[i].alias(f"c{i + 1}") for i in range(4)])


CHANNEL_SQL = f"""chn AS (SELECT symbol, pos, logret / sigma20_1 AS ret1, ln(close / lag(close, 5) OVER {W}) / (sigma20_1 * sqrt(5.0)) AS ret5, ln(close / lag(close, 20) OVER {W}) / (sigma20_1 * sqrt(20.0)) AS ret20,
 (close - ema20_1) / atr20_1 AS from_ema20, (close - ema50_1) / atr20_1 AS from_ema50, (ema50_1 - lag(ema50, 11) OVER {W}) / atr20_1 AS ema50_slope, tr / atr20_1 AS range_, sigma5_1 / sigma20_1 AS vol_ratio, er20 AS efficiency,
 CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS close_place FROM fl WHERE valid)"""


@query("event_tensors", "E4", "symbol:s t:i step:i ret1:d ret5:d ret20:d from_ema20:d from_ema50:d ema50_slope:d range_:d vol_ratio:d efficiency:d close_place:d", f"""
WITH RECURSIVE {MACHINE_SQL}, {CHANNEL_SQL} SELECT ev.symbol, t, chn.pos - t + 59 AS step, chn.* EXCLUDE (symbol, pos) FROM ev JOIN chn ON chn.symbol = ev.symbol AND chn.pos BETWEEN t - 59 AND t""")
def event_tensors(spark, folder):
    full = events.event_tensors(event_rows(spark, folder), events.event_channels(indicator_frame(spark, folder)))
    steps = full.where(F.col("feature_error").isNull()).select("symbol", "t", F.posexplode("sequence").alias("step", "v"))
    names = ["range_" if n == "range" else n for n in events.CHANNELS]
    return steps.select("symbol", "t", "step", *[F.col("v")[i].alias(n) for i, n in enumerate(names)])


def actions(spark, folder):
    d = F.dayofyear("ts")
    return bars(spark, folder).select("symbol", "ts", F.when(d % 17 == 0, 2.0).when(d % 43 == 0, 0.0).otherwise(1.0).alias("split"),
                                      F.when(d % 11 == 0, 0.5).when(d % 47 == 0, -1.0).otherwise(0.0).alias("dividend"))


def labels(spark, folder, tie="stop_first"):
    return events.barrier_labels(event_rows(spark, folder), bars(spark, folder), actions(spark, folder), 0.001, 0.0005, tie)


def label_sql(tie: str, name: str = "lab") -> str:
    first = "true" if tie == "stop_first" else "false"
    return f"""mk_{name} AS (SELECT *, coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low AND low <= least(open, close) AND greatest(open, close) <= high, false) AS ok,
 CASE WHEN dayofyear(ts) % 17 = 0 THEN 2.0::DOUBLE WHEN dayofyear(ts) % 43 = 0 THEN 0.0 ELSE 1.0 END AS split, CASE WHEN dayofyear(ts) % 11 = 0 THEN 0.5::DOUBLE WHEN dayofyear(ts) % 47 = 0 THEN -1.0 ELSE 0.0 END AS dividend FROM lb),
hd_{name} AS (SELECT r.symbol, r.t, r.signal_time, r.R, h AS off, m.* EXCLUDE (symbol), r.t + h AS k FROM rec r, (SELECT unnest(range(1, 11)) AS h) LEFT JOIN mk_{name} m ON m.symbol = r.symbol AND m.pos = r.t + h),
h2_{name} AS (SELECT *, first_value(open) OVER w * 1.001 AS entry, R / first_value(split) OVER w AS risk, exp(sum(CASE WHEN off > 1 AND split > 0 THEN ln(split) ELSE 0 END) OVER w) AS shares FROM hd_{name} WINDOW w AS (PARTITION BY symbol, t ORDER BY off)),
h3_{name} AS (SELECT *, (entry - risk) / shares AS stop, (entry + 1.5 * risk) / shares AS target, sum(CASE WHEN off > 1 AND dividend >= 0 THEN shares * dividend ELSE 0 END) OVER (PARTITION BY symbol, t ORDER BY off) AS paid FROM h2_{name}),
h4_{name} AS (SELECT *, CASE WHEN NOT coalesce(ok, false) THEN 'CENSORED' WHEN split <= 0 THEN 'ACTION_UNSUPPORTED' WHEN off = 1 AND NOT (entry > 0 AND risk > 0) THEN 'DATA_ERROR' WHEN dividend < 0 THEN 'ACTION_UNSUPPORTED' END AS fail,
 CASE WHEN open <= stop THEN 'GAP_STOP' WHEN open >= target THEN 'GAP_TARGET' WHEN low <= stop AND ({first} OR high < target) THEN 'STOP' WHEN high >= target THEN 'TARGET' WHEN off = 10 THEN 'TIME' END AS why FROM h3_{name}),
h5_{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY off) AS rn FROM h4_{name} WHERE fail IS NOT NULL OR why IS NOT NULL) WHERE rn = 1),
h6_{name} AS (SELECT *, 0.999 * CASE WHEN why LIKE 'GAP%' THEN open WHEN why = 'STOP' THEN stop WHEN why = 'TARGET' THEN target ELSE close END AS xp FROM h5_{name}),
h7_{name} AS (SELECT *, shares * xp - entry + paid - 0.0005 * entry - 0.0005 * shares * xp AS net FROM h6_{name}),
{name} AS (SELECT symbol, t, signal_time, coalesce(fail, 'OK') AS status, CASE WHEN fail = 'ACTION_UNSUPPORTED' THEN k END AS bar, CASE WHEN fail = 'ACTION_UNSUPPORTED' THEN CASE WHEN split <= 0 THEN 'split' ELSE 'dividend' END END AS field,
 CASE WHEN fail IS NULL THEN CASE WHEN why LIKE '%STOP' THEN -1 WHEN why LIKE '%TARGET' THEN 1 ELSE 0 END END AS barrier_class, CASE WHEN fail IS NULL THEN (net > 0)::INT END AS meta_label, CASE WHEN fail IS NULL THEN net / risk END AS net_R,
 CASE WHEN fail IS NULL THEN entry END AS entry, CASE WHEN fail IS NULL THEN xp END AS exit, CASE WHEN fail IS NULL THEN k END AS exit_bar, CASE WHEN fail IS NULL THEN why END AS reason,
 CASE WHEN fail IS NULL THEN why IN ('STOP', 'TARGET') AND low <= stop AND high >= target END AS ambiguous, CASE WHEN fail IS NULL THEN entry - risk <= 0 END AS nonpositive_stop, CASE WHEN fail IS NULL THEN ts END AS label_available_after FROM h7_{name})"""


@query("barrier_labels", "E5 E6 E7 J15", "symbol:s t:i status:s bar:d field:s barrier_class:d meta_label:d net_R:d entry:d exit:d exit_bar:d reason:s ambiguous:d nonpositive_stop:d label_available_after:t", f"""
WITH RECURSIVE {REC_SQL}, {label_sql('stop_first')} SELECT * FROM lab""")
def barrier_labels(spark, folder):
    return labels(spark, folder)


@query("event_census", "E8", "symbol:s year:i status:s reason:s events:i net_R:d", f"""
WITH RECURSIVE {REC_SQL}, {label_sql('stop_first')} SELECT symbol, year(signal_time) AS year, status, coalesce(reason, '-') AS reason, count(*) AS events, sum(net_R) AS net_R FROM lab GROUP BY 1, 2, 3, 4""")
def event_census(spark, folder):
    return events.census(labels(spark, folder))


@query("tie_sensitivity", "E8 E5", "events:i ambiguous_share:d mean_net_R_change:d", f"""
WITH RECURSIVE {REC_SQL}, {label_sql('stop_first', 'la')}, {label_sql('target_first', 'lt')}
SELECT count(*) AS events, avg(la.ambiguous::INT) AS ambiguous_share, avg(lt.net_R - la.net_R) AS mean_net_R_change FROM la JOIN lt USING (symbol, t) WHERE la.status = 'OK' AND lt.status = 'OK'""")
def tie_sensitivity(spark, folder):
    return events.tie_sensitivity(labels(spark, folder), labels(spark, folder, "target_first"))


MONTHLY_SQL = f"""{panels.ALIGNED_DAY}, sg AS (SELECT symbol, ts, pos, CASE WHEN month(ts) = 7 AND symbol < 'NF' THEN NULL ELSE sign(price / lag(price, 63) OVER {W} - 1) * (1 + pos / 10000.0) END AS signal FROM p),
e0 AS (SELECT max(ts) AS ts FROM p_cal GROUP BY date_trunc('month', ts)),
en AS (SELECT ts FROM e0 WHERE NOT (ts = (SELECT max(ts) FROM p_cal) AND CAST(ts AS DATE) < last_day(ts) - greatest(isodow(last_day(ts)) - 5, 0)::INTEGER)),
mm AS MATERIALIZED (SELECT symbol, ts, signal, year(ts) * 12 + month(ts) AS n, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM sg JOIN en USING (ts) WHERE NOT (month(ts) = 10 AND year(ts) % 2 = 0)),
lt AS (SELECT symbol, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, NULL::DOUBLE AS signal, NULL::DOUBLE AS effective, NULL::DOUBLE AS pend, 0 AS streak, NULL::BIGINT AS n FROM (SELECT DISTINCT symbol FROM mm)
 UNION ALL SELECT symbol, i, ts, signal, CASE WHEN signal IS NULL THEN NULL WHEN effective IS NULL OR sign(signal) = sign(effective) OR st2 >= 2 THEN signal ELSE effective END,
  CASE WHEN signal IS NULL OR effective IS NULL OR sign(signal) = sign(effective) OR st2 >= 2 THEN NULL ELSE sign(signal) END,
  CASE WHEN signal IS NULL OR effective IS NULL OR sign(signal) = sign(effective) OR st2 >= 2 THEN 0 ELSE st2 END, n
 FROM (SELECT m.symbol, m.i, m.ts, m.signal, m.n, lt.effective, CASE WHEN lt.n IS NOT NULL AND m.n <> lt.n + 1 THEN 1 WHEN lt.pend = sign(m.signal) THEN lt.streak + 1 ELSE 1 END AS st2 FROM lt JOIN mm m ON m.symbol = lt.symbol AND m.i = lt.i + 1))"""


def _signal(spark, folder):
    s = rolling.trend_signs(panels.aligned(spark, folder), (63,))
    gone = (F.month("ts") == 7) & (F.col("symbol") < "NF")
    return s.withColumn("signal", F.when(~gone, F.col("mom63") * (1 + F.col("pos") / 10000.0)))


@query("persistent_signals", "E9", "symbol:s ts:t signal:d effective:d", f"WITH RECURSIVE {MONTHLY_SQL} SELECT * FROM lt WHERE i > 0")
def persistent_signals(spark, folder):
    ends = calendars.month_ends(panels.calendar(spark, folder), drop_partial_last=True).select("ts")
    skipped = (F.month("ts") == 10) & (F.year("ts") % 2 == 0)
    monthly = _signal(spark, folder).join(ends, "ts", "left_semi").where(~skipped)
    return events.persistent_signals(monthly, 2)


@query("daily_persistent_signals", "E10 P2 J4", "symbol:s ts:t effective:d", f"""
WITH RECURSIVE {MONTHLY_SQL.replace(" WHERE NOT (month(ts) = 10 AND year(ts) % 2 = 0)", "")}, ex AS MATERIALIZED (SELECT * FROM lt WHERE i > 0),
d AS (SELECT k.ts, (SELECT max(en.ts) FROM en WHERE en.ts <= k.ts) AS m FROM p_cal k)
SELECT ex.symbol, d.ts, ex.effective FROM d JOIN ex ON ex.ts = d.m""")
def daily_persistent_signals(spark, folder):
    return events.daily_persistent(_signal(spark, folder), panels.calendar(spark, folder))


def _executed(spark, folder):
    h = crosssection.hysteresis(spark, folder).select("symbol", "ts", "pos", "weight")
    return h.withColumn("weight", F.col("weight") * (1 + 0.2 * F.sin(F.col("pos").cast("double"))))


@query("dead_band_weights", "B4", "symbol:s ts:t weight:d executed:d", f"""
WITH RECURSIVE {crosssection.HYST_SQL}, x AS MATERIALIZED (SELECT symbol, ts, weight * (1 + 0.2 * sin(pos)) AS weight, row_number() OVER {W} AS i FROM nw),
z AS (SELECT symbol, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS weight, 0.0::DOUBLE AS executed FROM (SELECT DISTINCT symbol FROM x)
 UNION ALL SELECT x.symbol, x.i, x.ts, x.weight, CASE WHEN abs(x.weight - z.executed) < 0.05 THEN z.executed ELSE x.weight END FROM z JOIN x ON x.symbol = z.symbol AND x.i = z.i + 1)
SELECT * FROM z WHERE i > 0""")
def dead_band_weights(spark, folder):
    return accounting.dead_band(_executed(spark, folder), 0.05)


def positioned(spark, folder):
    f = panels.forecasts(spark, folder)
    half = F.col("price") * (2.0 / 1e4) / 2
    return f.select("symbol", "ts", "pos", target_position(F.col("mu"), F.col("sigma"), 2.0).alias("target"), "sigma",
                    (F.col("price") - half).alias("bid"), (F.col("price") + half).alias("ask"))


POS_SQL = f"""{panels.FORECASTS}, ps AS (SELECT symbol, ts, pos, greatest(-1.0, least(1.0, 2.0 * (mu / (sigma * sigma + 1e-6)))) AS target, sigma, price - price * (2.0 / 1e4) / 2 AS bid, price + price * (2.0 / 1e4) / 2 AS ask FROM fc)"""


@query("spread_cost_returns", "B3", "symbol:s ts:t position_delta:d slippage_cost:d realized_return:d", f"""
WITH {POS_SQL}, l AS (SELECT *, coalesce(lag(target) OVER {W}, 0) AS before_, (bid + ask) / 2 AS mid, lag((bid + ask) / 2) OVER {W} AS pm FROM ps)
SELECT symbol, ts, target - before_ AS position_delta, abs(target - before_) * ((ask - bid) / 2 / mid + 1 / 1e4) AS slippage_cost,
 before_ * coalesce(mid / pm - 1, 0) - abs(target - before_) * ((ask - bid) / 2 / mid + 1 / 1e4) AS realized_return FROM l""")
def spread_cost_returns(spark, folder):
    return accounting.spread_cost_pnl(positioned(spark, folder).withColumnRenamed("target", "position"), slippage_bp=1.0)


OVERLAY = dict(max_step=0.3, max_sigma=0.35, loss_limit=-0.25, lookback=20, cooldown=10, threshold=0.05, slippage_bp=1.0)


RISK_SQL = f"""
WITH RECURSIVE {POS_SQL}, x AS MATERIALIZED (SELECT *, row_number() OVER {W} AS i, (bid + ask) / 2 AS mid FROM ps),
z AS (SELECT symbol, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS position, NULL::DOUBLE AS mid, []::DOUBLE[] AS rc, 0 AS rest, 0.0::DOUBLE AS realized_return FROM (SELECT DISTINCT symbol FROM x)
 UNION ALL SELECT symbol, i, ts, np, mid, CASE WHEN trig THEN []::DOUBLE[] ELSE rc2 END, CASE WHEN trig THEN 10 ELSE r1 END, er FROM (
  SELECT *, r1 = 0 AND list_sum(rc2) <= -0.25 AS trig FROM (SELECT *, list_slice(list_append(rc, er), greatest(len(rc) + 1 - 19, 1), len(rc) + 1) AS rc2 FROM (
  SELECT *, CASE WHEN pm IS NULL THEN 0 ELSE position * (mid - pm) / pm END - abs(np - position) * ((ask - bid) / 2 / mid + 1 / 1e4) AS er FROM (
  SELECT *, greatest(rest - 1, 0) AS r1, CASE WHEN rest > 0 THEN 0.0 WHEN abs(tg - position) < 0.05 THEN position ELSE position + greatest(-0.3, least(0.3, tg - position)) END AS np FROM (
  SELECT x.symbol, x.i, x.ts, x.bid, x.ask, x.mid, z.position, z.mid AS pm, z.rc, z.rest, CASE WHEN x.sigma > 0.35 THEN 0.0 ELSE x.target END AS tg FROM z JOIN x ON x.symbol = z.symbol AND x.i = z.i + 1))))))
SELECT symbol, ts, position, realized_return FROM z WHERE i > 0"""


@query("risk_overlay", "B5", "symbol:s ts:t position:d realized_return:d", RISK_SQL)
def risk_overlay(spark, folder):
    return accounting.risk_overlay(positioned(spark, folder), **OVERLAY)


