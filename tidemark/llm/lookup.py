"""Shard placement through a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, given by an offset and a stride.  Shards take turns
claiming their next free slot (a shard of weight w takes w turns per cycle) until the table is full, so slot counts differ by
no more than the weights and a shard that joins or leaves moves few keys.  A row is placed by one lookup of its key's slot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

SLOTS = 8191
SHARDS = 64
LARGEST_TABLE = 1_000_003


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _word(text: str, start: int) -> int:
    """Eight hex digits of the text's MD5, from digit ``start`` on."""
    return int(hashlib.md5(text.encode()).hexdigest()[start:start + 8], 16)


def fill(names: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> list[int]:
    """For each slot the position of its shard in ``names``."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and distinct")
    if not _prime(slots) or not len(names) <= slots <= LARGEST_TABLE:
        raise ValueError(f"the table size must be a prime from the number of shards up to {LARGEST_TABLE}")
    turns = [int((weights or {}).get(n, 1)) for n in names]
    if min(turns) < 0 or not sum(turns):
        raise ValueError("weights are whole numbers, one above 0 at least")
    at = [_word(n, 0) % slots for n in names]
    stride = [_word(n, 8) % (slots - 1) + 1 if slots > 2 else 1 for n in names]
    owner, left = [-1] * slots, slots
    while True:
        for k, w in enumerate(turns):
            for _ in range(w):
                while owner[at[k]] >= 0:
                    at[k] = (at[k] + stride[k]) % slots
                owner[at[k]] = k
                left -= 1
                if not left:
                    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def table_frame(spark: SparkSession, names: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> DataFrame:
    """(slot, shard): ``slots`` rows, at most ``LARGEST_TABLE``."""
    return spark.createDataFrame([(i, names[k]) for i, k in enumerate(fill(names, slots, weights))], "slot int, shard string")


def place(df: DataFrame, key: Column, names: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None,
          spread: Column | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` added (same-named columns are replaced); no shuffle.

    Equal keys share a shard.  Rows with a NULL key have no shard to share, so they go by ``spread`` (say, their text), or by
    the empty key if that is NULL too or not given.  Repeated rows go together; an empty table gives an empty result.  The broadcast side
    has exactly ``slots`` rows whatever the size of ``df``.
    """
    key = F.coalesce(key.cast("string"), *([spread.cast("string")] if spread is not None else []), F.lit(""))
    slot = slot_of(key, slots)
    theirs, = unused(df, "_slot")
    names_of = F.broadcast(table_frame(df.sparkSession, names, slots, weights)).withColumnRenamed("slot", theirs)
    kept = df.withColumn("slot", slot).drop("shard")
    return kept.join(names_of, F.col("slot") == F.col(theirs), "left").drop(theirs)
