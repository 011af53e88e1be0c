"""Reading panels from parquet and deriving price panels from the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Store a derived panel once per session: the two-level windows read it more than once."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _KEPT:
        _KEPT[full] = stored(build(), str(key[0]))
    return _KEPT[full]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(value: Column) -> Column:
    """Whole cents, so that sums do not depend on the order of rows."""
    return F.floor(value * 100 + 0.5)


def mean_of_cents(value: Column) -> Column:
    return F.sum(cents(value)) / F.count(F.lit(1)) / 100.0


def unit_price() -> Column:
    return F.col("l_extendedprice") / F.col("l_quantity")


def flag_panel(spark: SparkSession, folder: str, unit: str = "week") -> DataFrame:
    """(symbol, ts, price): mean unit price per return-flag/line-status pair and day or week."""
    return (table(spark, folder, "lineitem")
            .groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"),
                     F.date_trunc(unit, "l_shipdate").cast("timestamp_ntz").alias("ts"))
            .agg(mean_of_cents(unit_price()).alias("price")))


def brand_panel(spark: SparkSession, folder: str, unit: str = "week") -> DataFrame:
    """(symbol, ts, price) with the part brand as symbol; ragged at day level."""
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    sums = (table(spark, folder, "lineitem").groupBy("l_partkey", F.date_trunc(unit, "l_shipdate").cast("timestamp_ntz").alias("ts"))
            .agg(F.sum(cents(unit_price())).alias("_cents"), F.count(F.lit(1)).alias("_n")))
    return (sums.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("symbol", "ts")
            .agg((F.sum("_cents") / F.sum("_n") / 100.0).alias("price")))


def ohlc_panel(spark: SparkSession, folder: str, unit: str = "week") -> DataFrame:
    """(symbol, ts, open, high, low, close) of the unit price by return-flag/line-status pair."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    p = cents(unit_price()) / 100.0
    return (table(spark, folder, "lineitem")
            .groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"),
                     F.date_trunc(unit, "l_shipdate").cast("timestamp_ntz").alias("ts"))
            .agg(F.min_by(p, order).alias("open"), F.max(p).alias("high"),
                 F.min(p).alias("low"), F.max_by(p, order).alias("close")))


def minute_events(spark: SparkSession, folder: str, unit: str = "hour") -> DataFrame:
    """(symbol, ts, price, volume, trade_count) per event type and hour (or minute)."""
    return (table(spark, folder, "events")
            .groupBy(F.col("event_type").alias("symbol"),
                     F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts"))
            .agg((mean_of_cents(F.col("value")) + 100.0).alias("price"),
                 (F.sum(cents(F.col("value"))) / 100.0).alias("volume"),
                 F.count(F.lit(1)).cast("double").alias("trade_count")))


def booked_events(spark: SparkSession, folder: str, unit: str = "hour") -> DataFrame:
    """Bars of ``minute_events`` with a book: even users bid and the others ask, the spread grows with the range of values."""
    money = cents(F.col("value"))
    bid = F.sum(F.when(F.col("user_id") % 2 == 0, money).otherwise(0))
    half = ((F.max(money) - F.min(money)) / 1e5 + 0.01) / 2
    price = mean_of_cents(F.col("value")) + 100.0
    return (table(spark, folder, "events")
            .groupBy(F.col("event_type").alias("symbol"),
                     F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts"))
            .agg(price.alias("price"), (F.sum(money) / 100.0).alias("volume"), F.count(F.lit(1)).cast("double").alias("trade_count"),
                 (price - half).alias("bid"), (price + half).alias("ask"), (bid / 100.0).alias("bid_volume"),
                 ((F.sum(money) - bid) / 100.0).alias("ask_volume")))


def ticks(spark: SparkSession, folder: str, kinds: list[str]) -> DataFrame:
    """(symbol, ts, event_id, value): raw events of the given types, user id as symbol."""
    return (table(spark, folder, "events").where(F.col("event_type").isin(kinds))
            .select(F.col("user_id").alias("symbol"), "ts", "event_id", "value"))


def headline_feed(spark: SparkSession, folder: str, start: str = "2024-01-01 00:00:00",
                  minutes_per_doc: int = 37, symbols: tuple[str, ...] = (
                      "click", "error", "purchase", "signup", "view")) -> DataFrame:
    """(symbol, created_at, headline): documents laid out on a clock, dealt over the event types."""
    names = F.array(*[F.lit(s) for s in symbols])
    return table(spark, folder, "documents").select(
        F.element_at(names, (F.col("doc_id") % len(symbols) + 1).cast("int")).alias("symbol"),
        F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp"))
                           + (F.col("doc_id") % 1160) * (minutes_per_doc * 60_000_000))
        .cast("timestamp_ntz").alias("created_at"),
        F.col("doc_id"), F.col("text").alias("headline"))


def release() -> None:
    """Forget the stored panels, so that the next query derives them again."""
    _KEPT.clear()
