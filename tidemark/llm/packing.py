"""Packing documents into fixed-size training sequences, balanced by attention cost.

A task packs the documents it reads, some millions of tokens at a time, so nothing is shuffled and memory stays bounded.
Inside such a group the sequences have exactly as many places as there are tokens: full ones of ``capacity`` places and, for the
rest, one for each power of two in it.  Documents go in descending order of cost (linear in the length for the
projections, quadratic for attention inside the document) to the sequence that costs least so far and still has room; one
that fits nowhere is cut at the room of the cheapest sequence and the remainder takes its turn.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_rows
from .tokens import encoder, vocabulary

CAPACITY = 4096
GROUP_TOKENS = 2_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
END_ID = 2
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "capacity long, sequence_cost double")


def cost(length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * length + quadratic * length * length


def rooms(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Sequence sizes that add up to ``tokens``: full ones, then the powers of two of the rest, largest first."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR,
           quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[int], np.ndarray]:
    """Pieces (document, start, length, sequence, offset), the sequence sizes and the cost of each sequence."""
    sizes = rooms(sum(lengths), capacity)
    room, spent = np.array(sizes, dtype=np.int64), np.zeros(len(sizes))
    waiting = []
    for d, n in enumerate(lengths):
        for start in range(0, n, capacity):
            waiting.append((-min(capacity, n - start), d, start))
    heapq.heapify(waiting)
    pieces = []
    while waiting:
        n, d, start = heapq.heappop(waiting)
        n = -n
        fits = room >= n
        s = int(np.where(fits, spent, np.inf).argmin())
        take = n
        if not fits[s]:
            s = int(np.where(room > 0, spent, np.inf).argmin())
            take = int(room[s])
            heapq.heappush(waiting, (take - n, d, start + take))
        pieces.append((d, start, take, s, sizes[s] - int(room[s])))
        room[s] -= take
        spent[s] += cost(take, linear, quadratic)
    return pieces, sizes, spent


def pack(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS,
         linear: float = LINEAR, quadratic: float = QUADRATIC, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document (``doc_id``, ``text``).

    NULL and empty texts have the end id only.  A NULL ``doc_id`` stays NULL.  Equal costs go in the order of the rows, repeated rows
    are packed once each, a text of any length is cut at the capacity, an empty table gives no rows, further columns are
    ignored.  ``sequence_id`` holds the task in its upper half.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    path = tokenizer or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32

        def packed(names: list, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal sequence
            pieces, sizes, spent = assign([len(x) // 4 for x in ids], capacity, linear, quadratic)
            pieces.sort()
            rows = [(names[d], start, n, zlib.crc32(ids[d][4 * start:4 * (start + n)]), len(ids[d]) // 4, sequence + s, offset,
                     sizes[s], float(spent[s])) for d, start, n, s, offset in pieces]
            sequence += len(sizes)
            kinds = [pa.int64()] * 8 + [pa.float64()]
            fields = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=fields)

        names, ids, tokens = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = encode(text.as_py()) + end
                names.append(name)
                ids.append(got)
                tokens += len(got) // 4
                if tokens >= group_tokens:
                    yield packed(names, ids)
                    names, ids, tokens = [], [], 0
        if names:
            yield packed(names, ids)

    return text_rows(df, "doc_id").mapInArrow(run, SCHEMA)
