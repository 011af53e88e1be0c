"""Joins on time, calendars, splits and position projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import edge, headline_score, target_position
from ..operators import align, blocks, calendars, rolling
from ..sources import tables
from . import ctes as c
from . import panels
from .registry import query

W = c.W


@query("asof_quotes", "J1", "symbol:i event_id:i value:d quote_id:i quote_value:d", """
WITH bars AS (SELECT user_id AS symbol, ts, event_id, value FROM events WHERE event_type IN ('purchase', 'error')),
quotes AS (SELECT user_id AS symbol, ts, event_id AS quote_id, value AS quote_value FROM events WHERE event_type IN ('view', 'click'))
SELECT b.symbol, b.event_id, b.value, q.quote_id, q.quote_value FROM bars b ASOF JOIN quotes q
 ON b.symbol = q.symbol AND b.ts >= q.ts""")
def asof_quotes(spark, folder):
    quotes = tables.ticks(spark, folder, ["view", "click"]).select(
        "symbol", "ts", F.col("event_id").alias("quote_id"), F.col("value").alias("quote_value"))
    bars = tables.ticks(spark, folder, ["purchase", "error"])
    return align.last_known(bars, quotes, ["quote_id", "quote_value"], tie="quote_id")


@query("calendar_intersection", "J2 J3", "ts:t pos:i", f"""
WITH {c.brand('day')}, {c.aligned()} SELECT ts, pos FROM p_cal""")
def calendar_intersection(spark, folder):
    return calendars.common_calendar(tables.brand_panel(spark, folder, "day"))


@query("forward_filled_panel", "J4", "symbol:s ts:t price:d", f"""
WITH {c.brand('day')}, days AS (SELECT DISTINCT ts FROM panel), grid AS (SELECT symbol, days.ts FROM days, (SELECT symbol, min(ts) AS f FROM panel GROUP BY 1) WHERE days.ts >= f)
SELECT g.symbol, g.ts, p.price FROM grid g ASOF JOIN panel p ON g.symbol = p.symbol AND g.ts >= p.ts""")
def forward_filled_panel(spark, folder):
    panel = tables.kept(spark, ("brand_day", folder), lambda: tables.brand_panel(spark, folder, "day"))
    return align.forward_filled(panel, panel.select("ts").distinct())


@query("cash_filled_both_ways", "J5", "ts:t cash:d", f"""
WITH {panels.ALIGNED_DAY}, {panels.cash_sql()} SELECT k.ts, coalesce(x.rate_pa_pct, (SELECT arg_min(rate_pa_pct, ts) FROM cash)) / 100 / 252 AS cash
FROM p_cal k ASOF LEFT JOIN cash x ON k.ts >= x.ts""")
def cash_filled_both_ways(spark, folder):
    return align.cash_rate(panels.calendar(spark, folder), panels.cash(spark, folder), causal=False)


@query("cash_known_before", "J6", "ts:t cash:d", f"""
WITH {panels.ALIGNED_DAY}, {panels.cash_sql()}, f AS (SELECT k.ts, x.rate_pa_pct AS r FROM p_cal k ASOF LEFT JOIN cash x ON k.ts >= x.ts)
SELECT ts, lag(r) OVER (ORDER BY ts) / 100 / 252 AS cash FROM f""")
def cash_known_before(spark, folder):
    return align.cash_rate(panels.calendar(spark, folder), panels.cash(spark, folder), causal=True)


NEWS_SQL = f"""{c.bars()}, {c.news()}, scored AS (SELECT symbol, created_at, {c.words()} AS score FROM news),
nw AS (SELECT b.symbol, b.ts, ln(1 + count(n.score)) AS news_intensity, coalesce(avg(n.score), 0.0) AS news_sentiment
 FROM bars b LEFT JOIN scored n ON n.symbol = b.symbol AND n.created_at <= b.ts AND n.created_at > b.ts - INTERVAL 240 MINUTE GROUP BY 1, 2)"""


def _news(spark, folder):
    return tables.headline_feed(spark, folder).withColumn("score", headline_score(F.col("headline")))


@query("news_window_features", "J7 P18", "symbol:s ts:t news_intensity:d news_sentiment:d", f"WITH {NEWS_SQL} SELECT * FROM nw")
def news_window_features(spark, folder):
    return align.news_window(tables.minute_events(spark, folder), _news(spark, folder), 240)


@query("bars_with_news", "J14", "symbol:s ts:t price:d volume:d news_intensity:d news_sentiment:d", f"""
WITH {NEWS_SQL} SELECT b.symbol, b.ts, b.price, b.volume, nw.news_intensity, nw.news_sentiment FROM bars b LEFT JOIN nw USING (symbol, ts)""")
def bars_with_news(spark, folder):
    bars = tables.minute_events(spark, folder)
    extra = align.news_window(bars.select("symbol", "ts"), _news(spark, folder), 240)
    return align.attach(bars, extra)


@query("market_relative_return", "J8", "symbol:s ts:t market_relative_return:d", f"""
WITH {c.brand('day')}, ref AS (SELECT ts, price FROM panel WHERE symbol = (SELECT min(symbol) FROM panel)),
j AS (SELECT p.*, ref.price AS rp FROM panel p ASOF LEFT JOIN ref ON p.ts >= ref.ts)
SELECT symbol, ts, coalesce(ln(price) - ln(lag(price) OVER w) - (ln(rp) - ln(lag(rp) OVER w)), 0.0) AS market_relative_return
FROM j WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def market_relative_return(spark, folder):
    panel = tables.kept(spark, ("brand_day", folder), lambda: tables.brand_panel(spark, folder, "day"))
    first = panel.select(F.min("symbol")).scalar()
    ref = panel.where(F.col("symbol") == first).select("ts", F.col("price").alias("ref_price"))
    on_days = align.last_known(panel.select("ts").distinct(), ref, ["ref_price"], keys=(), keep_unmatched=True,
                               seconds=365 * 86400)
    return rolling.market_relative(blocks.numbered(panel, ["symbol"]), on_days)


@query("delayed_outcome", "J11", "symbol:s ts:t entry_price:d outcome:d", f"""
WITH {panels.QUOTED_BARS}, o AS (SELECT symbol, ts, price AS entry_price, ln(lead(price, 3) OVER {W}) - ln(price) AS outcome FROM b)
SELECT * FROM o WHERE outcome IS NOT NULL""")
def delayed_outcome(spark, folder):
    df = rolling.forward_log_return(panels.quoted_bars(spark, folder), 3, "outcome")
    return df.where(F.col("outcome").isNotNull()).withColumnRenamed("price", "entry_price")


@query("reproduction_mismatches", "J12", "symbol:s ts:t actual:d expected:d reason:s", f"""
WITH {c.flag('day')}, a AS (SELECT symbol, ts, price FROM panel WHERE NOT (symbol = 'AF' AND day(ts) = 3)),
b AS (SELECT symbol, ts, CASE WHEN day(ts) = 5 THEN price * (1 + 1e-6) ELSE price * (1 + 1e-12) END AS price FROM panel WHERE NOT (symbol = 'NO' AND day(ts) = 4)),
j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, a.price AS actual, b.price AS expected
 FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts)
SELECT *, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' ELSE 'value' END AS reason FROM j
WHERE actual IS NULL OR expected IS NULL OR abs(actual - expected) > 1e-12 + 1e-10 * abs(expected)""")
def reproduction_mismatches(spark, folder):
    p = tables.flag_panel(spark, folder, "day")
    a = p.where(~((F.col("symbol") == "AF") & (F.dayofmonth("ts") == 3)))
    b = (p.where(~((F.col("symbol") == "NO") & (F.dayofmonth("ts") == 4)))
         .withColumn("price", F.col("price") * F.when(F.dayofmonth("ts") == 5, 1 + 1e-6).otherwise(1 + 1e-12)))
    return align.mismatches(a, b, ["symbol", "ts"], "price")


@query("calendar_mismatch", "J15", "symbol:s ts:t only_in:s", f"""
WITH {c.flag('day')}, {c.brand('day', 'bp')}, l AS (SELECT symbol, ts FROM panel), r AS (SELECT symbol, ts + INTERVAL 1 DAY AS ts FROM panel)
SELECT symbol, ts, 'left' AS only_in FROM (FROM l EXCEPT FROM r) UNION ALL SELECT symbol, ts, 'right' AS only_in FROM (FROM r EXCEPT FROM l)""")
def calendar_mismatch(spark, folder):
    left = tables.flag_panel(spark, folder, "day").select("symbol", "ts")
    right = left.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    return align.calendar_mismatch(left, right)


SLEEVES = {"A": ["AF", "AO"], "N": ["NF", "NO"], "R": ["RF", "RO"]}


def sleeve_table(spark):
    rows = [F.struct(F.lit(k).alias("sleeve"), F.lit(s).alias("symbol")) for k, v in SLEEVES.items() for s in v]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


SLEEVE_SQL = "(VALUES " + ", ".join(f"('{k}', '{s}')" for k, v in SLEEVES.items() for s in v) + ") AS sl(sleeve, symbol)"


@query("sleeve_means", "J17", "sleeve:s ts:t log_price:d members:i", f"""
WITH {c.flag('week')} SELECT sleeve, ts, avg(ln(price)) AS log_price, count(*) AS members FROM panel JOIN {SLEEVE_SQL} USING (symbol) GROUP BY 1, 2""")
def sleeve_means(spark, folder):
    return (tables.flag_panel(spark, folder).join(sleeve_table(spark), "symbol").groupBy("sleeve", "ts")
            .agg(F.avg(F.log("price")).alias("log_price"), F.count(F.lit(1)).alias("members")))


@query("leave_out_panels", "J16", "exclude_id:s ts:t members:i log_price:d", f"""
WITH {c.flag('week')}, ex AS (SELECT 'loo_' || symbol AS exclude_id, symbol FROM {SLEEVE_SQL}
 UNION ALL SELECT 'loo_sleeve_' || sleeve, symbol FROM {SLEEVE_SQL}), ids AS (SELECT DISTINCT exclude_id FROM ex)
SELECT exclude_id, ts, count(*) AS members, avg(ln(price)) AS log_price FROM panel, ids
WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.exclude_id = ids.exclude_id AND ex.symbol = panel.symbol) GROUP BY 1, 2""")
def leave_out_panels(spark, folder):
    copies = align.excluded_panels(tables.flag_panel(spark, folder), *exclusions(spark))
    return copies.groupBy("exclude_id", "ts").agg(F.count(F.lit(1)).alias("members"), F.avg(F.log("price")).alias("log_price"))


def exclusions(spark):
    s = sleeve_table(spark)
    table = (s.select(F.concat(F.lit("loo_"), "symbol").alias("exclude_id"), "symbol")
             .unionByName(s.select(F.concat(F.lit("loo_sleeve_"), "sleeve").alias("exclude_id"), "symbol")))
    ids = [f"loo_{x}" for v in SLEEVES.values() for x in v] + [f"loo_sleeve_{k}" for k in SLEEVES]
    return table, ids


@query("month_end_dates", "P1 P2", "ts:t kept:b", f"""
WITH {panels.ALIGNED_DAY}, e AS (SELECT max(ts) AS ts FROM p_cal GROUP BY date_trunc('month', ts))
SELECT ts, NOT (ts = (SELECT max(ts) FROM p_cal) AND CAST(ts AS DATE) < last_day(ts) - greatest(isodow(last_day(ts)) - 5, 0)::INTEGER) AS kept FROM e""")
def month_end_dates(spark, folder):
    cal = panels.calendar(spark, folder)
    strict = calendars.month_ends(cal, drop_partial_last=True).select("ts", F.lit(True).alias("kept"))
    return calendars.month_ends(cal).select("ts").join(strict, "ts", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@query("development_cutoffs", "P3 P4", "fraction:d ts:t", f"""
WITH {panels.ALIGNED_DAY}, e AS (SELECT max(ts) AS ts FROM p_cal GROUP BY date_trunc('month', ts)), n AS (SELECT count(*) AS n FROM p_cal)
SELECT f AS fraction, (SELECT max(e.ts) FROM e WHERE e.ts <= (SELECT ts FROM p_cal WHERE pos = floor((SELECT n FROM n) * f)::BIGINT - 1)) AS ts
FROM (VALUES (0.8::DOUBLE), (0.6::DOUBLE)) v(f)""")
def development_cutoffs(spark, folder):
    cal = panels.calendar(spark, folder)
    return (calendars.development_end(cal, 0.8).withColumn("fraction", F.lit(0.8))
            .unionByName(calendars.development_end(cal, 0.6).withColumn("fraction", F.lit(0.6))))


@query("fraction_splits", "P5 P6 P7", "ts:t part80:s part25:s warm:b decide:b", f"""
WITH {panels.ALIGNED_DAY}, n AS (SELECT count(*) AS n FROM p_cal)
SELECT ts, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'head' ELSE 'tail' END AS part80, CASE WHEN pos < floor(n * 0.25) THEN 'head' ELSE 'tail' END AS part25,
 pos >= 315 AS warm, (pos - 315) % 21 = 0 AS decide FROM p_cal, n""")
def fraction_splits(spark, folder):
    cal = panels.calendar(spark, folder)
    out = calendars.fraction_split(calendars.fraction_split(cal, 0.8, "part80"), 0.25, "part25")
    return out.withColumn("warm", F.col("pos") >= 315).withColumn("decide", calendars.cadence(F.col("pos"), 315, 21))


@query("period_decisions", "P8", "ts:t anchor_ok:b", f"""
WITH {panels.ALIGNED_DAY}, e AS (SELECT max(ts) AS ts FROM p_cal GROUP BY date_trunc('month', ts)),
a AS (SELECT max(ts) AS ts FROM e WHERE ts < TIMESTAMP '1998-01-01'),
nx AS (SELECT min(k.ts) AS ts FROM p_cal k, a WHERE k.ts > a.ts AND k.ts <= TIMESTAMP '2000-06-15')
SELECT ts, true AS anchor_ok FROM e WHERE ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '2000-06-15'
UNION ALL SELECT a.ts, coalesce(nx.ts >= TIMESTAMP '1998-01-01', false) FROM a, nx WHERE a.ts IS NOT NULL""")
def period_decisions(spark, folder):
    cal = panels.calendar(spark, folder)
    return calendars.decisions_between(calendars.month_ends(cal), cal, "1998-01-01 00:00:00", "2000-06-15 00:00:00")


@query("exact_step_mask", "P9", "ts:t is_step:b", f"""
WITH {panels.EVENT_ALIGNED} SELECT ts, coalesce(lead(ts) OVER (ORDER BY ts) - ts = INTERVAL 1 HOUR, false) AS is_step FROM b_cal""")
def exact_step_mask(spark, folder):
    return calendars.exact_step_mask(panels.event_aligned(spark, folder).select("ts", "pos").distinct(), 3600)


@query("rolling_folds", "P10 P11", "fold:i train_start:i train_stop:i test_start:i test_stop:i", f"""
WITH {panels.ALIGNED_DAY}, n AS (SELECT count(*) AS n FROM p_cal), s AS (SELECT unnest(range(0, greatest(n - 500 - 100 + 1, 0), 100)) AS s FROM n)
SELECT s // 100 AS fold, s AS train_start, s + 500 - 5 AS train_stop, s + 500 AS test_start, s + 600 AS test_stop FROM s""")
def rolling_folds(spark, folder):
    return calendars.rolling_folds(panels.calendar(spark, folder), 500, 100, 100, purge=5)


@query("expanding_windows", "P12", "block:i test_start:i test_stop:i", f"""
WITH {panels.ALIGNED_DAY}, n AS (SELECT least(400, count(*)) AS f, count(*) AS l FROM p_cal)
SELECT w AS block, f + w * ((l - f) // 5) AS test_start, CASE WHEN w = 4 THEN l ELSE f + (w + 1) * ((l - f) // 5) END AS test_stop
FROM n, (SELECT unnest(range(5)) AS w)""")
def expanding_windows(spark, folder):
    n = F.count(F.lit(1))
    span = panels.calendar(spark, folder).agg(F.least(F.lit(400).cast("long"), n).alias("first"), n.alias("last"))
    return calendars.expanding_windows(span, 5)


@query("edge_and_target", "P15 P16", "symbol:s ts:t edge:d edge_clipped:d target:d", f"""
WITH {panels.FORECASTS} SELECT symbol, ts, mu / (sigma * sigma + 1e-6) AS edge, greatest(-0.5, least(0.5, mu / (sigma * sigma + 1e-6))) AS edge_clipped,
 greatest(-1.0, least(1.0, 2.0 * (mu / (sigma * sigma + 1e-6)))) AS target FROM fc""")
def edge_and_target(spark, folder):
    f = panels.forecasts(spark, folder)
    mu, sigma = F.col("mu"), F.col("sigma")
    return f.select("symbol", "ts", edge(mu, sigma).alias("edge"), edge(mu, sigma, limit=0.5).alias("edge_clipped"),
                    target_position(mu, sigma, 2.0).alias("target"))
