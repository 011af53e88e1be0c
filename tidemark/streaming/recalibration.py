"""Periodic recalibration of the sizing constant on a stream of matured forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import calibrate_k
from ..session import scratch
from .replay import Replay


def newest(rows: DataFrame, n: int) -> DataFrame:
    last = rows.groupBy("symbol").agg(F.max("pos").alias("_last"))
    return rows.join(last, "symbol").where(F.col("pos") > F.col("_last") - n).drop("_last")


def matured(tail: DataFrame, horizon: int, least: int) -> DataFrame:
    """Forecasts that at least ``horizon`` rows follow, of symbols that have ``least`` of them."""
    ends = (tail.groupBy("symbol").agg(F.max("pos").alias("_last"), F.min("pos").alias("_first"))
            .where(F.col("_last") - F.col("_first") + 1 - horizon >= least))
    return tail.join(ends, "symbol").where(F.col("pos") <= F.col("_last") - horizon).drop("_last", "_first")


def recalibrated_k(source: Replay, rows: int = 256, horizon: int = 0, least: int = 1, max_edge: float | None = None) -> DataFrame:
    """After each micro-batch: k per symbol from the newest ``rows`` forecasts so far whose outcome is known.

    A forecast matures ``horizon`` rows after its own; symbols with fewer than ``least`` matured ones get no k yet.
    Only the newest rows are carried from batch to batch.  Each batch writes to folders of its own id, so a
    retried batch replaces itself, and a restarted query goes on from the folder of the batch before.
    """
    spark, path = source.spark, scratch(source.spark, "recalibration")

    def each(batch: DataFrame, batch_id: int) -> None:
        seen = batch.where(F.col("symbol").isNotNull()).select("symbol", "pos", "mu", "sigma")
        if batch_id > 0:
            seen = seen.unionByName(spark.read.parquet(f"{path}/tail/{batch_id - 1}"))
        here = f"{path}/tail/{batch_id}"
        newest(seen, rows + horizon).write.mode("overwrite").parquet(here)
        calibrate_k(matured(spark.read.parquet(here), horizon, least), max_edge=max_edge).write.mode("overwrite").parquet(f"{path}/k/batch={batch_id}")

    source.feed(lambda: (source.stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint")
                         .trigger(availableNow=True).start()))
    if source.beat is None:
        return spark.createDataFrame([], "symbol string, k double, batch int")
    return spark.read.parquet(f"{path}/k")
