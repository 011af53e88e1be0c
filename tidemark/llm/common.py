"""Small helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_rows(df: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """Only the named columns and the text, NULL text counting as empty; other columns are ignored."""
    return df.select(*columns, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def smallest_hashes(df: DataFrame, n: int, total: int, *keys: str) -> DataFrame:
    """About the ``n`` rows of ``total`` with the smallest hashes of their keys; what a task passes on does not grow with the table."""
    hashed = F.xxhash64(*keys)
    share = min(1.0, 4.0 * n / max(1, total))
    near = df.where(F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else df
    return near.orderBy(F.pmod(hashed, F.lit(1 << 30)), *keys).limit(n)


def spans(lengths: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose lengths add up to about ``limit``; one longer row is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def per_chunk(work: Callable[[dict[str, pa.Array], list[str]], pa.RecordBatch], column: str = "text",
              limit: int = CHUNK_CHARS) -> Callable:
    """A mapInArrow function that hands ``work`` the columns of a few rows at a time, whole texts as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            sizes = pc.binary_length(batch.column(at)).to_pylist()
            for a, b in spans(sizes, limit):
                part = batch.slice(a, b - a)
                cols = {n: part.column(i) for i, n in enumerate(part.schema.names) if n != column}
                yield work(cols, part.column(at).to_pylist())

    return run


def distinct(values: np.ndarray) -> np.ndarray:
    """The values once each, in order."""
    ordered = np.sort(values)
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and the number of values in each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
