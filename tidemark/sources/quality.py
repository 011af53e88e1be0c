"""Panel storage, fingerprints, manifests and fail-closed checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.calendars import common_calendar
from ..session import scratch


def build_or_load(spark: SparkSession, path: str, build, partition_by: Sequence[str] = ()) -> DataFrame:
    """Read the stored table; write it first when it does not exist.  Never overwrites."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        writer = build().write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return spark.read.parquet(path)


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored panel; a missing one is an error, never a rebuild."""
    return spark.read.parquet(path)


def row_digest(columns: Sequence[str]) -> Column:
    """48 bits of an md5 over the row's values as text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")


def fingerprint(panel: DataFrame, digest: Column) -> DataFrame:
    """Per symbol: row count and order-free sum and xor of row digests."""
    return (panel.withColumn("_h", digest).groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("_h").alias("digest_sum"),
                 F.bit_xor(F.col("_h").cast("long")).alias("digest_xor")))


def table_fingerprint(panel: DataFrame, digest: Column) -> DataFrame:
    """One sha-256 over the whole table, independent of row order and partitioning."""
    per = fingerprint(panel, digest)
    text = F.concat_ws("|", "symbol", F.col("rows").cast("string"), F.col("digest_sum").cast("string"),
                       F.col("digest_xor").cast("string"))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return (per.select(h.alias("_h")).agg(
        F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum("_h").cast("string"),
                           F.bit_xor(F.col("_h").cast("long")).cast("string")).cast("binary"), 256).alias("content_sha256")))


def manifest(panel: DataFrame, digest: Column) -> DataFrame:
    spans = panel.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return fingerprint(panel, digest).join(spans, "symbol")


def panel_faults(panel: DataFrame, cash: DataFrame, min_common: int) -> DataFrame:
    """Violations as rows (rule, subject, n): duplicates, missing or bad prices, rates, short calendar."""
    missing = F.col("price").isNull() | F.isnan("price")
    by_symbol = panel.groupBy("symbol").agg(
        (F.count(F.lit(1)) - F.count_distinct("ts")).alias("duplicate_ts"),
        F.count_if(missing).alias("missing_price"),
        F.count_if(F.col("price") <= 0).alias("nonpositive_price"))
    symbol_rows = by_symbol.unpivot(["symbol"], ["duplicate_ts", "missing_price", "nonpositive_price"], "rule", "n")
    rate = F.col("rate_pa_pct")
    cash_rows = cash.agg(F.count_if(rate.isNull() | F.isnan(rate)).alias("missing_rate"),
                         F.count_if((rate < -1) | (rate > 25)).alias("rate_out_of_range"),
                         (F.count(F.lit(1)) - F.count_distinct("ts")).alias("duplicate_rate_ts"))
    cash_rows = (cash_rows.withColumn("symbol", F.lit("cash"))
                 .unpivot(["symbol"], ["missing_rate", "rate_out_of_range", "duplicate_rate_ts"], "rule", "n"))
    calendar = (common_calendar(panel).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_common)
                .select(F.lit("panel").alias("symbol"), F.lit("short_calendar").alias("rule"), "n"))
    return symbol_rows.unionByName(cash_rows).where(F.col("n") > 0).unionByName(calendar)


def require_sound(panel: DataFrame, cash: DataFrame, min_common: int = 4800) -> DataFrame:
    """Return the panel, or raise on the first violations found."""
    faults = panel_faults(panel, cash, min_common).take(5)
    if faults:
        raise ValueError("; ".join(f"{r['rule']}: {r['symbol']} ({r['n']})" for r in faults))
    return panel


def bar_usable() -> Column:
    """Indicator view: four finite positive prices and high >= low."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    ok = F.lit(True)
    for p in prices:
        ok = ok & p.isNotNull() & ~F.isnan(p) & (p > 0) & (p < float("inf"))
    return F.coalesce(ok & (F.col("high") >= F.col("low")), F.lit(False))


def bar_tradeable() -> Column:
    """Label view, stricter: open and close also lie inside [low, high]."""
    return F.coalesce(bar_usable() & (F.col("low") <= F.least("open", "close"))
                      & (F.greatest("open", "close") <= F.col("high")), F.lit(False))


__all__ = ["scratch", "build_or_load", "load_panel", "row_digest", "fingerprint", "table_fingerprint",
           "manifest", "panel_faults", "require_sound", "bar_usable", "bar_tradeable"]
