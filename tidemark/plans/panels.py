"""Panels the registered queries share, each with the SQL that builds the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, calendars, rolling
from ..sources import tables
from . import ctes as c

W = c.W


def aligned(spark: SparkSession, folder: str, unit: str = "day") -> DataFrame:
    return tables.kept(spark, ("aligned", folder, unit), lambda: calendars.on_common_calendar(
        tables.flag_panel(spark, folder, unit)))


def calendar(spark: SparkSession, folder: str, unit: str = "day") -> DataFrame:
    return aligned(spark, folder, unit).select("ts", "pos").distinct()


ALIGNED_DAY = f"{c.flag('day')}, {c.aligned()}"
ALIGNED_WEEK = f"{c.flag('week')}, {c.aligned()}"


def quoted_bars(spark: SparkSession, folder: str) -> DataFrame:
    return tables.kept(spark, ("bars", folder), lambda: blocks.numbered(
        rolling.quote_from_bar(tables.minute_events(spark, folder)), ["symbol"]))


def booked_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars whose spread and book sizes vary from bar to bar."""
    return tables.kept(spark, ("booked", folder), lambda: blocks.numbered(tables.booked_events(spark, folder), ["symbol"]))


QUOTED_BARS = f"{c.bars()}, {c.quoted()}, {c.own_pos('q', 'b')}"
BOOKED_BARS = f"{c.booked()}, {c.own_pos('q', 'b')}"


def cash(spark: SparkSession, folder: str, unit: str = "day") -> DataFrame:
    """Percent per year by month, with holes: every seventh order date and the first weeks are absent."""
    return (tables.table(spark, folder, "lineitem")
            .select(F.date_trunc(unit, "l_shipdate").cast("timestamp_ntz").alias("ts")).distinct()
            .where((F.dayofyear("ts") % 7 != 0) & (F.col("ts") >= F.to_timestamp_ntz(F.lit("1995-01-20 00:00:00"))))
            .withColumn("rate_pa_pct", 2 + F.month("ts") / 12.0))


def cash_sql(unit: str = "day", name: str = "cash") -> str:
    ts = c.TS.format(unit=unit, col="l_shipdate")
    return (f"{name} AS (SELECT ts, 2 + month(ts) / 12.0 AS rate_pa_pct FROM (SELECT DISTINCT {ts} AS ts FROM lineitem) "
            f"WHERE dayofyear(ts) % 7 <> 0 AND ts >= TIMESTAMP '1995-01-20 00:00:00')")


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, ts, pos, price, log_ret, mu, sigma, p_up): rolling statistics standing in for a model."""
    def cols(w):
        up = F.when(F.col("log_ret") > 0, 1.0).when(F.col("log_ret").isNotNull(), 0.0)
        return {"mu": blocks.full_frame(F.avg, F.col("log_ret"), 20, w), "sigma": rolling.sd("log_ret", 20, w),
                "p_up": blocks.full_frame(F.avg, up, 20, w)}
    return tables.kept(spark, ("forecasts", folder), lambda: rolling.per_symbol(
        rolling.returns(event_aligned(spark, folder)), cols, 21).where(F.col("sigma").isNotNull()))


def event_aligned(spark: SparkSession, folder: str) -> DataFrame:
    return tables.kept(spark, ("event_aligned", folder), lambda: calendars.on_common_calendar(
        tables.minute_events(spark, folder)))


EVENT_ALIGNED = f"{c.bars()}, {c.aligned('bars', 'b')}"
FORECASTS = f"""{EVENT_ALIGNED}, fc0 AS (SELECT *, ln(price) - ln(lag(price) OVER {W}) AS log_ret FROM b),
fc AS (SELECT * FROM (SELECT *, {c.full('avg', 'log_ret', 20)} AS mu, {c.full('stddev_samp', 'log_ret', 20)} AS sigma,
 CASE WHEN count(log_ret) OVER {c.frame(20)} = 20 THEN avg(CASE WHEN log_ret > 0 THEN 1.0 WHEN log_ret IS NOT NULL THEN 0.0 END)
 OVER {c.frame(20)} END AS p_up FROM fc0) WHERE sigma IS NOT NULL)"""


def net_weekly(spark: SparkSession, folder: str) -> DataFrame:
    """(scenario, ts, pos, net): weekly returns of each symbol as scenario series."""
    return tables.kept(spark, ("net", folder), lambda: rolling.returns(aligned(spark, folder, "week"))
                       .where(F.col("ret").isNotNull())
                       .select(F.col("symbol").alias("scenario"), "ts", "pos", F.col("ret").alias("net")))


NET = (f"{ALIGNED_WEEK}, net AS (SELECT * FROM (SELECT symbol AS scenario, ts, pos, "
       f"price / lag(price) OVER {W} - 1 AS net FROM p) WHERE net IS NOT NULL)")
