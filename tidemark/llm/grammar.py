"""Token ids in grammar-compressed shards.

Documents in ascending ``doc_id`` order are cut into shards of some million ids.  Inside a shard the most frequent pairs of
neighbouring symbols are replaced by new symbols until no pair is left that occurs ``LEAST_COUNT`` times; a pair never spans two documents.  A shard is one row of a
Parquet folder: the rules as pairs, the number of ids each rule stands for, the remaining symbols, and where each document
starts in symbols and in ids.  One document, or a range of its ids, is decoded from its own symbols and those lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_rows
from .tokens import encoder, vocabulary

VOCABULARY = 49_408
END_ID = 1
SHARD_IDS = 2_000_000
PAIRS_PER_ROUND = 65_536
LEAST_COUNT = 16
KEPT_PIECES = 1_000_000
SHARD_SCHEMA = ("part int, seq int, n_ids long, n_docs int, doc_ids array<long>, doc_symbols array<int>, doc_starts array<long>, "
                "rules binary, lengths binary, symbols binary")


@dataclass(frozen=True)
class Grammar:
    """``rules[k]`` is the pair that symbol ``base + k`` stands for; ``lengths[k]`` the number of ids it expands to."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones(self.base, dtype=np.int64), self.lengths])[symbols]

    def _unfold(self, symbols: np.ndarray) -> np.ndarray:
        out = symbols
        while len(out) and (new := out >= self.base).any():
            at = np.cumsum(1 + new) - (1 + new)
            wide = np.empty(len(out) + int(new.sum()), dtype=np.uint32)
            pair = self.rules[out[new] - self.base]
            wide[at[~new]] = out[~new]
            wide[at[new]], wide[at[new] + 1] = pair[:, 0], pair[:, 1]
            out = wide
        return out.astype(np.uint32)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Each distinct symbol is unfolded once, which takes no more room than the result, then copied to its places."""
        used = np.zeros(self.base + len(self.rules), dtype=bool)
        used[symbols] = True
        distinct = np.flatnonzero(used)
        sizes = np.zeros(len(used), dtype=np.int64)
        sizes[distinct] = self.sizes(distinct)
        starts = np.cumsum(sizes) - sizes
        count = sizes[symbols]
        place = np.repeat(starts[symbols] - (np.cumsum(count) - count), count)
        place += np.arange(len(place))
        return self._unfold(distinct)[place]

    def span(self, symbols: np.ndarray, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of one document, expanding only the symbols that hold them."""
        ends = np.cumsum(self.sizes(symbols))
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + count, "left"))
        before = int(ends[first - 1]) if first else 0
        return self.expand(symbols[first:last + 1])[start - before:start - before + count]


def compress(ids: np.ndarray, starts: np.ndarray, base: int = VOCABULARY, pairs: int = PAIRS_PER_ROUND,
             least: int = LEAST_COUNT) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """The grammar, the remaining symbols and where each document starts in them.  Every document holds one id at least.

    A round replaces the most frequent pairs at once, ``pairs`` at most; every round that finds one shortens the symbols.
    Once all frequent pairs are replaced none of them is left, and pairs of older symbols only get rarer, so the next round
    counts the pairs that hold a symbol of the last one.
    """
    symbols, firsts = ids.astype(np.uint32), starts.astype(np.int64)
    rules, lengths = np.empty((0, 2), dtype=np.uint32), np.empty(0, dtype=np.int64)
    fresh = 0
    while len(symbols) > 1:
        late = symbols >= fresh
        inside = late[:-1] | late[1:]
        inside[firsts[1:] - 1] = False
        place = np.flatnonzero(inside)
        keys = symbols[place].astype(np.uint64) << np.uint64(32) | symbols[place + 1]
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, dtype=np.int64)
        counts = np.diff(np.r_[edge, len(ordered)])
        enough = np.flatnonzero(counts >= least)
        if not len(enough):
            break
        best = enough[np.argsort(-counts[enough], kind="stable")[:pairs]]
        chosen = np.sort(ordered[edge[best]])
        # A pair's slot in a small table by hash; pairs that share a slot are searched for.
        bits = np.uint64(64 - 18)
        mix = np.uint64(0x9E3779B97F4A7C15)
        slot = (chosen * mix >> bits).astype(np.int64)
        table = np.full(1 << 18, -1, dtype=np.int32)
        table[slot] = np.arange(len(chosen))
        table[slot[table[slot] != np.arange(len(chosen))]] = -2
        rule = table[(keys * mix >> bits).astype(np.int64)]
        near = np.flatnonzero(rule != -1)
        rule, wanted = rule[near], keys[near]
        shared = np.flatnonzero(rule == -2)
        rule[shared] = np.minimum(np.searchsorted(chosen, wanted[shared]), len(chosen) - 1)
        hit = chosen[rule] == wanted
        at, rule = place[near[hit]], rule[hit]
        # Where pairs overlap, every second one from the left is taken.
        step = np.arange(len(at))
        opens = np.r_[True, np.diff(at) != 1]
        taken = (step - np.maximum.accumulate(np.where(opens, step, 0))) % 2 == 0
        at, rule = at[taken], rule[taken]
        made = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        size = np.concatenate([np.ones(base, dtype=np.int64), lengths])
        fresh = base + len(rules) if len(enough) == len(best) else 0
        symbols[at] = (base + len(rules) + rule).astype(np.uint32)
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        firsts = firsts - np.searchsorted(at, firsts)
        symbols = symbols[keep]
        rules, lengths = np.concatenate([rules, made]), np.concatenate([lengths, size[made[:, 0]] + size[made[:, 1]]])
    return Grammar(base, rules, lengths), symbols, firsts


def encode_shards(df: DataFrame, tokenizer: str | None = None, shard_ids: int = SHARD_IDS, end_id: int = END_ID) -> DataFrame:
    """Shards of (``doc_id``, ``text``) in ascending order; (part, seq) numbers them in that order.

    NULL texts are empty and hold the end id only.  NULL ids come first.  Rows with equal ids stay next to each other in the
    order of the input's partitions, so an id that owns many rows is still split.  A text longer than a shard is a shard of its
    own.  An empty table gives no shards; further columns are ignored.
    """
    path = tokenizer or vocabulary()
    rows = text_rows(df, "doc_id").withColumn("_salt", F.spark_partition_id())
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("_salt")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "_salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, KEPT_PIECES).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0

        def shard(names: list, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal seq
            counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            starts = np.cumsum(counts) - counts
            grammar, symbols, firsts = compress(np.frombuffer(b"".join(ids), dtype="<u4"), starts)
            row = {"part": part, "seq": seq, "n_ids": int(counts.sum()), "n_docs": len(ids), "doc_ids": names,
                   "doc_symbols": firsts.astype(np.int32), "doc_starts": starts, "rules": grammar.rules.astype("<u4").tobytes(),
                   "lengths": grammar.lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes()}
            seq += 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()),
                     pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row.values(), kinds)], names=list(row))

        names, ids, held = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = encode(text.as_py()) + end
                if held and held + len(got) // 4 > shard_ids:
                    yield shard(names, ids)
                    names, ids, held = [], [], 0
                names.append(name)
                ids.append(got)
                held += len(got) // 4
        if names:
            yield shard(names, ids)

    return ranged.select("doc_id", "text").mapInArrow(run, SHARD_SCHEMA)


def write(df: DataFrame, path: str, **options: object) -> None:
    encode_shards(df, **options).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def _opened(row: dict) -> tuple[Grammar, np.ndarray]:
    rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
    return Grammar(VOCABULARY, rules, np.frombuffer(row["lengths"], dtype="<u4").astype(np.int64)), np.frombuffer(row["symbols"], dtype="<u4")


def bases(shards: DataFrame) -> DataFrame:
    """(part, seq, base): ids before each shard, in two levels: over the parts, and inside each."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = parts.select("part", F.coalesce(F.sum("_n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("_in"))
            .join(before, "part").select("part", "seq", (F.col("_part") + F.col("_in")).alias("base")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, decoded from the shards; ``start`` counts all ids before it."""
    shards = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pydict()
                row = {k: v[0] for k, v in row.items()}
                grammar, symbols = _opened(row)
                ids = grammar.expand(symbols).astype("<u4")
                starts = np.array([*row["doc_starts"], len(ids)])
                raw = ids.tobytes()
                pieces = [raw[4 * a:4 * b] for a, b in zip(starts[:-1], starts[1:])]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                     pa.array(pieces, pa.binary())],
                    names=["part", "seq", "doc_id", "_start", "n_tokens", "ids_crc32", "ids"])

    docs = (shards.select("part", "seq", "doc_ids", "doc_starts", "rules", "lengths", "symbols")
            .mapInArrow(run, "part int, seq int, doc_id long, _start long, n_tokens long, ids_crc32 long, ids binary"))
    return (docs.join(bases(shards), ["part", "seq"])
            .select("doc_id", (F.col("base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32", "ids"))
