"""Replays of stored tables as streams, and file sinks with checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocks import micros
from ..session import scratch


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the progress reports the query still holds."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


class Replay:
    """A stored table as a stream in time order.

    The table is written once, partitioned into ``pieces`` of equal time spans.  ``feed`` adds one piece after the other to the
    stream's folder and runs the query over it, each time from the query's checkpoint: a replay is a series of restarts.  The
    last piece ends with a heartbeat, a row of NULLs ``flush_days`` after the newest time, which moves the watermark past all
    rows.  A live deployment reads its own source instead; the operators take any streaming DataFrame.
    """

    def __init__(self, df: DataFrame, ts: str = "ts", pieces: int = 3, flush_days: int = 30):
        spark = df.sparkSession
        self.spark, self.pieces, self.late = spark, pieces, 0
        self.cut, self.live = scratch(spark, "replay-cut"), scratch(spark, "replay-live")
        us = micros(ts)
        low, high = df.select(F.min(us), F.max(us)).first()
        schema = df.schema
        self.schema = schema
        beat = None
        if low is not None:
            piece = F.least(F.floor((us - low) * pieces / (high - low + 1)), F.lit(pieces - 1)).cast("int")
            df.withColumn("_piece", piece).write.partitionBy("_piece").parquet(self.cut)
            stamp = F.timestamp_micros(F.lit(high + flush_days * 86_400_000_000))
            cells = [(stamp if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
            beat = spark.range(1).select(*cells)
        self.beat = beat
        spark.createDataFrame([], schema).write.parquet(self.live)
        self.stream = spark.readStream.schema(schema).parquet(self.live)

    def feed(self, start: Callable[[], StreamingQuery]) -> None:
        for k in range(self.pieces if self.beat is not None else 0):
            rows = self.spark.read.schema(self.schema).parquet(f"{self.cut}/_piece={k}") if self._has(k) else self.beat.limit(0)
            if k == self.pieces - 1:
                rows = rows.unionByName(self.beat)
            rows.write.mode("append").parquet(self.live)
            query = start()
            query.awaitTermination()
            self.late += late_rows(query)

    def _has(self, k: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.cut}/_piece={k}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def to_table(self, result: DataFrame, name: str) -> DataFrame:
        """Feed everything through ``result`` into an append-only parquet sink, then read the sink."""
        path = scratch(self.spark, name)
        self.feed(lambda: started(result, path))
        if self.beat is None:
            return self.spark.createDataFrame([], result.schema)
        return self.spark.read.schema(result.schema).parquet(path)


def started(result: DataFrame, path: str) -> StreamingQuery:
    """Run over everything available into the parquet sink ``path``, from its checkpoint if there is one."""
    return (result.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start())
