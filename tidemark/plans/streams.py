"""The live operators, run over replays of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import headline_score
from ..sources import tables
from ..streaming import recalibration, replay, stateful
from ..streaming.eventtime import after_watermark, watermarked
from . import crosssection, ctes as c
from . import events as ev
from . import panels
from .alignment import NEWS_SQL
from .features import Z_COLUMNS, bar_features_sql, zscore_sql
from .registry import query

W = c.W
def stamp():
    return F.timestamp_micros("us")



@query("live_quoted_bars", "T1 J1", "symbol:i event_id:i value:d quote_id:i quote_value:d", """
WITH bars AS (SELECT user_id AS symbol, ts, event_id, value FROM events WHERE event_type IN ('purchase', 'error')),
quotes AS (SELECT user_id AS symbol, ts, event_id AS quote_id, value AS quote_value FROM events WHERE event_type IN ('view', 'click'))
SELECT b.symbol, b.event_id, b.value, q.quote_id, q.quote_value FROM bars b ASOF JOIN quotes q ON b.symbol = q.symbol AND b.ts >= q.ts""")
def live_quoted_bars(spark, folder):
    source = replay.Replay(tables.table(spark, folder, "events").select(
        F.col("user_id").alias("symbol"), "ts", "event_type", F.col("event_id").alias("id"), "value"))
    quote, bar = F.col("event_type").isin("view", "click"), F.col("event_type").isin("purchase", "error")
    rows = after_watermark(watermarked(source.stream), quote | bar).withColumn("is_bar", bar)
    return source.to_table(stateful.quoted_bars(rows, delay=None), "quoted")


def _live(spark, folder):
    def build():
        source = replay.Replay(panels.booked_bars(spark, folder))
        return source.to_table(stateful.live_features(source.stream, tuple(Z_COLUMNS)), "features").withColumn("ts", stamp())
    return tables.kept(spark, ("live_features", folder), build)


@query("live_bar_features", "T2 S12", "symbol:s ts:t " + " ".join(f"{n}:d" for n in stateful.FEATURES), f"""
WITH {panels.BOOKED_BARS}, {bar_features_sql()} SELECT * FROM feat WHERE pos >= 50""")
def live_bar_features(spark, folder):
    return _live(spark, folder)


ZS = f"WITH {panels.BOOKED_BARS}, {bar_features_sql()}, z AS (SELECT symbol, ts, pos, {zscore_sql(Z_COLUMNS)} FROM feat)"


@query("live_scaled_features", "T3", "symbol:s ts:t " + " ".join(f"{n}_z:d" for n in Z_COLUMNS), f"{ZS} SELECT * FROM z WHERE pos >= 149")
def live_scaled_features(spark, folder):
    return _live(spark, folder).where(F.col("log_return_z").isNotNull())


@query("live_sequences", "T4", "symbol:s ts:t steps:i oldest:d newest:d", f"""
{ZS} SELECT * FROM (SELECT symbol, ts, pos, 30 AS steps, lag(log_return_z, 29) OVER {W} AS oldest, realized_vol_z AS newest FROM z) WHERE pos >= 178""")
def live_sequences(spark, folder):
    s = _live(spark, folder).where(F.col("seq").isNotNull())
    return s.select("symbol", "ts", F.size("seq").alias("steps"), F.col("seq")[0][0].alias("oldest"), F.col("seq")[29][1].alias("newest"))


@query("live_news_features", "T5 J7", "symbol:s ts:t news_intensity:d news_sentiment:d", f"WITH {NEWS_SQL} SELECT * FROM nw")
def live_news_features(spark, folder):
    news = tables.headline_feed(spark, folder).select("symbol", F.col("created_at").alias("ts"), headline_score(F.col("headline")).alias("score"))
    bars = tables.minute_events(spark, folder).select("symbol", "ts", F.lit(None).cast("double").alias("score"))
    both = news.withColumn("is_bar", F.lit(False)).unionByName(bars.withColumn("is_bar", F.lit(True)))
    source = replay.Replay(both)
    timed, bar = watermarked(source.stream), F.col("is_bar")
    at_news = after_watermark(timed, ~bar).withColumnRenamed("ts", "created_at")
    live = stateful.live_news(at_news, after_watermark(timed, bar), 240, delay=None)
    return source.to_table(live, "news").withColumn("ts", stamp())


@query("live_sizing", "T6 B5 P16", "symbol:s ts:t position:d realized_return:d", ev.RISK_SQL)
def live_sizing(spark, folder):
    source = replay.Replay(ev.positioned(spark, folder))
    return source.to_table(stateful.live_sizing(source.stream, **ev.OVERLAY), "sizing").withColumn("ts", stamp())


OUTCOMES = f"""{panels.QUOTED_BARS}, o AS (SELECT * FROM (SELECT symbol, ts, pos, price AS entry_price, ln(lead(price, 3) OVER {W}) - ln(price) AS outcome FROM b)
WHERE outcome IS NOT NULL)"""


def _outcomes(spark, folder):
    def build():
        source = replay.Replay(panels.quoted_bars(spark, folder))
        return source.to_table(stateful.live_outcomes(source.stream, 3), "outcomes").withColumn("ts", stamp())
    return tables.kept(spark, ("live_outcomes", folder), build)


@query("live_outcomes", "T7 J11", "symbol:s ts:t entry_price:d outcome:d", f"WITH {OUTCOMES} SELECT * FROM o")
def live_outcomes(spark, folder):
    return _outcomes(spark, folder)


@query("live_matured_batches", "T7", "symbol:s ts:t n_ready:i batch_mean:d batch_sd:d", f"""
WITH {OUTCOMES} SELECT symbol, ts, least(pos + 1, 5000) AS n_ready, avg(outcome) OVER v AS batch_mean, stddev_samp(outcome) OVER v AS batch_sd
FROM o WINDOW v AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 255 PRECEDING AND CURRENT ROW) QUALIFY pos >= 63""")
def live_matured_batches(spark, folder):
    return _outcomes(spark, folder).where(F.col("batch_mean").isNotNull())


@query("live_synchronised_book", "T8 X8 X7", "symbol:s ts:t side:i weight:d", f"""
WITH {crosssection.HYST_SQL} SELECT symbol, ts, side, weight FROM nw""")
def live_synchronised_book(spark, folder):
    edge = F.col("mu") / (F.col("sigma") * F.col("sigma") + 1e-6)
    source = replay.Replay(panels.forecasts(spark, folder).select(F.lit("all").alias("universe"), "symbol", "ts", edge.alias("edge")))
    return source.to_table(stateful.live_book(source.stream, 5, 1, 1, 2), "book").withColumn("ts", stamp())


@query("live_recalibrated_k", "T9 A26", "symbol:s k:d", f"""
WITH {panels.FORECASTS}, l AS (SELECT symbol, max(pos) AS m FROM fc GROUP BY 1)
SELECT symbol, CASE WHEN q < 1e-6 THEN 0.0 ELSE 0.5 / q END AS k FROM (SELECT fc.symbol, quantile_cont(abs(mu / (sigma * sigma + 1e-6)), 0.95) AS q FROM fc JOIN l ON l.symbol = fc.symbol AND pos > m - 256 GROUP BY 1)""")
def live_recalibrated_k(spark, folder):
    k = recalibration.recalibrated_k(replay.Replay(panels.forecasts(spark, folder)), 256)
    return k.join(k.select(F.max("batch").alias("batch")), "batch")


@query("live_matured_k", "T9 A26", "symbol:s k:d", f"""
WITH {panels.FORECASTS}, l AS (SELECT symbol, max(pos) AS m FROM fc GROUP BY 1)
SELECT symbol, CASE WHEN q < 1e-6 THEN 0.0 ELSE 0.5 / q END AS k FROM (SELECT fc.symbol, quantile_cont(least(abs(mu / (sigma * sigma + 1e-6)), 25.0), 0.95) AS q
 FROM fc JOIN l ON l.symbol = fc.symbol AND pos > m - 259 AND pos <= m - 3 GROUP BY 1 HAVING count(*) >= 64)""")
def live_matured_k(spark, folder):
    k = recalibration.recalibrated_k(replay.Replay(panels.forecasts(spark, folder)), 256, horizon=3, least=64, max_edge=25.0)
    return k.join(k.select(F.max("batch").alias("batch")), "batch")
