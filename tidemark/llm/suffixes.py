"""Exact removal of repeated 200-byte strings across documents, by a distributed merge sort of suffixes.

A start is a place of a text with ``width`` bytes behind it.  Each start is led by an anchor, the place with the smallest hash among
the next ``REACH`` ones; equal strings have their anchors at the same offset.  Starts led by one anchor form a block, and a
record is the anchor's suffix, cut to ``width`` bytes, with the bytes from the block's first start to the anchor.  Two starts are equal
exactly if their offsets are, their suffixes share at least ``width - offset`` bytes and the bytes before the anchors at least ``offset``.

1. Anchors whose suffix begins like no other are dropped: the hash of the part every comparison needs occurs once.
2. Each task sorts its remaining records, keeps one of each kind, and writes sorted front-coded runs, one for each bucket of heads.
3. A bucket merges the runs of all tasks with a loser tree that carries common prefixes, so its output knows the prefix each suffix
   shares with its neighbour; with the like order of the bytes before the anchors this settles every offset.
4. The covered bytes go back to the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import per_chunk, ragged, unused
from .merging import Run, common_prefix, front_coded, merged

WIDTH = 200
REACH = 128
GRAM = 8
RECORDS_PER_BUCKET = 60_000
RUN_RECORDS = 100_000
CHUNK_CHARS = 250_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; ``data`` is padded by eight bytes."""
    return np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))


def blocks(texts: list[bytes], width: int = WIDTH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The padded bytes of all texts, where each text begins, and per block: text, first and last start, anchor (all in those bytes)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts) + bytes(width + 16), dtype=np.uint8)
    whole = int(sizes.sum())
    valid = np.zeros(whole + 1, dtype=np.int8)
    long = sizes >= width
    valid[begins[long]] += 1
    np.subtract.at(valid, begins[long] + sizes[long] - width + 1, 1)
    starts = np.flatnonzero(np.cumsum(valid[:whole]))
    if not len(starts):
        empty = np.empty(0, dtype=np.int64)
        return data, begins, empty, empty, empty, empty
    hashed = _words(data)[:whole + reach] * MIX
    hashed = (hashed ^ hashed >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    low = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64)
    span = 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[:len(low) - (reach - span)], low[reach - span:])
    anchor = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    opens = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)])
    first, last = starts[opens], starts[np.r_[opens[1:] - 1, len(starts) - 1]]
    return data, begins, np.searchsorted(begins, first, "right") - 1, first, last, anchor[opens]


def head_hashes(data: np.ndarray, anchors: np.ndarray, width: int = WIDTH, reach: int = REACH) -> np.ndarray:
    """Hash of the first ``width - reach + 1`` bytes of each anchor's suffix."""
    size, words = width - reach + 1, _words(data)
    out = np.full(len(anchors), size, dtype=np.uint64)
    for at in [*range(0, size - 8, 8), size - 8]:
        out = (out ^ words[anchors + at]) * MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def short_key(text: Column) -> Column:
    return F.xxhash64(text)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _own_text(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _heads(rows: DataFrame, width: int, reach: int) -> DataFrame:
    """(key, head) for every block of every text; ``rows`` has (key, text)."""

    def work(cols: dict[str, pa.Array], texts: list[str]) -> pa.RecordBatch:
        data, _, owner, _, _, anchor = blocks(_own_text(texts), width, reach)
        return pa.RecordBatch.from_arrays([cols["key"], ragged(head_hashes(data, anchor, width, reach), np.bincount(owner, minlength=len(texts)), pa.int64())],
                                          names=["key", "heads"])

    return rows.mapInArrow(per_chunk(work, limit=CHUNK_CHARS), "key long, heads array<long>").select("key", F.explode("heads").alias("head"))


def _packed(matrix: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(matrix.tobytes())


def _plain(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


RUN_FIELDS = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("run", pa.int64()), ("rec", pa.int32()), ("prefix", pa.binary()),
                        ("rest", pa.binary()), ("before", pa.binary()), ("sizes", pa.binary()), ("text_key", pa.binary()), ("first", pa.int32()),
                        ("last", pa.int32()), ("anchor", pa.int32())])
RUN_SCHEMA = ("kind string, bucket int, run long, rec int, prefix binary, rest binary, before binary, sizes binary, text_key binary, "
              "first int, last int, anchor int")


def _runs(rows: DataFrame, buckets: int, width: int, reach: int) -> DataFrame:
    """Sorted runs and the occurrences of their records; ``rows`` has (text_key, heads, text), each text once.

    ``sizes`` holds for each record the smallest and the largest offset of its starts and how often it occurs (2 for more).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 24)
        held: list[tuple] = []
        count = 0

        def written() -> tuple[pa.RecordBatch, pa.RecordBatch]:
            nonlocal number
            wide, bucket, key, first, last, anchor = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.argsort(np.ascontiguousarray(wide).view(f"V{wide.shape[1]}")[:, 0], kind="stable") if len(wide) else np.empty(0, dtype=np.int64)
            wide, bucket = wide[order], bucket[order]
            new = common_prefix(wide) < wide.shape[1]
            new[0] = True
            rec = np.cumsum(new) - 1
            often = np.minimum(np.bincount(rec), 2).astype(np.uint8)
            kept = np.flatnonzero(new)
            out: dict[str, list] = {name: [] for name in RUN_FIELDS.names}

            def put(**values: object) -> None:
                for name, column in out.items():
                    column.append(values.get(name))

            edges = np.flatnonzero(np.r_[True, np.diff(bucket[kept]) != 0, True])
            place = np.empty(len(kept), dtype=np.int64)
            for a, b in zip(edges[:-1], edges[1:]):
                part = wide[kept[a:b]]
                suffix, before = part[:, 4:4 + width], part[:, 4 + width:-2]
                prefix = common_prefix(suffix)
                place[a:b] = np.arange(b - a)
                put(kind="run", bucket=int(bucket[kept[a]]), run=number, prefix=_packed(prefix.astype(np.uint8)), rest=zstandard.ZstdCompressor(level=1).compress(
                    front_coded(suffix, prefix)), before=_packed(before), sizes=_packed(np.concatenate([part[:, -2:], often[a:b, None]], axis=1)))
            runs = pa.RecordBatch.from_pydict(out, schema=RUN_FIELDS)
            n = len(order)
            nulls = {name: pa.nulls(n, RUN_FIELDS.field(name).type) for name in ("prefix", "rest", "before", "sizes")}
            found = {"kind": pa.array(["occ"] * n), "bucket": pa.array(bucket, pa.int32()), "run": pa.array(np.full(n, number)),
                     "rec": pa.array(place[rec].astype(np.int32)), **nulls, "text_key": pa.array(list(key[order]), pa.binary()),
                     "first": pa.array(first[order].astype(np.int32)), "last": pa.array(last[order].astype(np.int32)), "anchor": pa.array(anchor[order].astype(np.int32))}
            number += 1
            return runs, pa.RecordBatch.from_arrays([found[f.name] for f in RUN_FIELDS], schema=RUN_FIELDS)

        def work(cols: dict[str, pa.Array], texts: list[str]) -> int:
            data, begins, owner, first, last, anchor = blocks(_own_text(texts), width, reach)
            head = head_hashes(data, anchor, width, reach)
            wanted = np.concatenate([np.asarray(x.values, dtype=np.int64) for x in cols["heads"]])
            whose = np.repeat(np.arange(len(texts)), [len(x) for x in cols["heads"]])
            have = np.stack([owner.astype(np.int64), head], axis=1)
            want = np.stack([whose.astype(np.int64), wanted], axis=1)
            pair = np.dtype([("t", "<i8"), ("h", "<i8")])
            keep = np.isin(np.ascontiguousarray(have).view(pair)[:, 0], np.ascontiguousarray(want).view(pair)[:, 0])
            owner, first, last, anchor, head = owner[keep], first[keep], last[keep], anchor[keep], head[keep]
            view = np.lib.stride_tricks.sliding_window_view(data, width)
            suffix = view[anchor].copy()
            ends = begins + np.array([len(t) for t in _own_text(texts)])
            suffix[np.arange(width)[None, :] >= (ends[owner] - anchor)[:, None]] = 0
            back = anchor[:, None] - 1 - np.arange(reach - 1)[None, :]
            before = np.where(back >= first[:, None], data[np.maximum(back, 0)], 0).astype(np.uint8)
            keys = np.array(cols["text_key"].to_pylist(), dtype=object)[owner]
            bucket = (head.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            wide = np.concatenate([bucket.astype(">i4").view(np.uint8).reshape(-1, 4), suffix, before, (anchor - last).astype(np.uint8)[:, None],
                                   (anchor - first).astype(np.uint8)[:, None]], axis=1)
            held.append((wide, bucket, keys, first - begins[owner], last - begins[owner], anchor - begins[owner]))
            return len(anchor)

        for found in per_chunk(work, limit=CHUNK_CHARS)(batches):
            count += found
            if count >= RUN_RECORDS:
                yield from written()
                count = 0
        if count:
            yield from written()

    return rows.select("text_key", "heads", "text").mapInArrow(run, RUN_SCHEMA)


def settled(prefix: np.ndarray, before: np.ndarray, sizes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which offsets of which records repeat, as a matrix; rows are in merged order, ``prefix`` is what each shares with the one before."""
    n, reach = len(prefix), before.shape[1] + 1
    least, most, often = (sizes[:, k].astype(np.int64) for k in range(3))
    left = np.argsort(np.ascontiguousarray(before).view(f"V{before.shape[1]}")[:, 0], kind="stable")
    shared = common_prefix(before[left])
    out = np.zeros((n, reach), dtype=bool)
    group_left = np.empty(n, dtype=np.int64)
    for offset in range(reach):
        live = np.flatnonzero((least <= offset) & (offset <= most))
        if not len(live):
            continue
        right = np.cumsum(prefix < width - offset)
        group_left[left] = np.cumsum(shared < offset)
        kind = right[live] * np.int64(n + 1) + group_left[live]
        _, where = np.unique(kind, return_inverse=True)
        out[live, offset] = np.bincount(where, weights=often[live])[where] >= 2
    return out


def _settle(runs: DataFrame, width: int, reach: int) -> DataFrame:
    """(run, bucket, rec, low, high): the ranges of offsets at which a record repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bucket_done(bucket: int, parts: list[tuple]) -> pa.RecordBatch:
            streams = [Run(zstandard.ZstdDecompressor().decompress(rest), _plain(prefix, "u1"), width) for _, prefix, rest, _, _ in parts]
            which, row, shared = (np.array(x, dtype=np.int64) for x in merged(streams, width))
            before = [_plain(b, "u1").reshape(-1, reach - 1) for _, _, _, b, _ in parts]
            sizes = [_plain(s, "u1").reshape(-1, 3) for _, _, _, _, s in parts]
            base = np.cumsum([0, *(len(s) for s in sizes)])
            at = base[which] + row
            marks = settled(shared, np.concatenate(before)[at], np.concatenate(sizes)[at], width)
            padded = np.zeros((len(marks), reach + 2), dtype=np.int8)
            padded[:, 1:-1] = marks
            step = np.diff(padded, axis=1)
            rec, low = np.nonzero(step == 1)
            _, high = np.nonzero(step == -1)
            numbers = np.array([p[0] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array(numbers[which[rec]]), pa.array(np.full(len(rec), bucket, dtype=np.int32)), pa.array(row[rec].astype(np.int32)),
                                               pa.array(low.astype(np.int32)), pa.array((high - 1).astype(np.int32))], names=["run", "bucket", "rec", "low", "high"])

        now, parts = None, []
        for batch in batches:
            for bucket, *part in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and parts:
                    yield bucket_done(now, parts)
                    parts = []
                now = bucket
                parts.append(tuple(part))
        if parts:
            yield bucket_done(now, parts)

    return (runs.select("bucket", "run", "prefix", "rest", "before", "sizes").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "run long, bucket int, rec int, low int, high int"))


def repeats(df: DataFrame, width: int = WIDTH, reach: int = REACH) -> DataFrame:
    """(text_key, spans): ranges of starts, first and last, whose ``width`` bytes also start elsewhere; a whole text that occurs twice has one
    range over all its starts.  Texts without such a start are not listed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    long = df.select(F.col("doc_id").cast("long").alias("_id"), text.alias("text")).where(F.octet_length("text") >= width)
    heads = stored(_heads(long.select(short_key(F.col("text")).alias("key"), "text"), width, reach), "heads")
    common = stored(heads.groupBy("head").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "common-heads")
    hits = stored(heads.join(common, "head", "left_semi"), "hits")
    buckets = max(1, -(-hits.count() // RECORDS_PER_BUCKET))
    wanted = hits.groupBy("key").agg(F.collect_set("head").alias("heads"))
    keyed = long.select(text_key(F.col("text")).alias("text_key"), short_key(F.col("text")).alias("key"), "_id", "text")
    copies = stored(keyed.groupBy("text_key").agg(F.min("_id").alias("_one"), F.any_value("key").alias("key"), F.count(F.lit(1)).alias("copies"),
                                                  F.any_value(F.octet_length("text")).alias("n_bytes")), "copies")
    asked = (copies.join(wanted, "key").select(F.col("text_key").alias("_key"), "_one", "heads"))
    once = (keyed.join(asked, (F.col("text_key") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_one")))
            .select("text_key", "heads", "text"))
    runs = stored(_runs(once, buckets, width, reach), "runs")
    settled_ = _settle(runs.where("kind = 'run'"), width, reach)
    seen = runs.where("kind = 'occ'").select("run", "bucket", "rec", "text_key", "anchor")
    marks = (seen.join(settled_, ["run", "bucket", "rec"])
             .select("text_key", (F.col("anchor") - F.col("high")).alias("first"), (F.col("anchor") - F.col("low")).alias("last")))
    twice = copies.where("copies > 1").select("text_key", F.lit(0).alias("first"), (F.col("n_bytes") - width).cast("int").alias("last"))
    return stored(marks.unionByName(twice).groupBy("text_key").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")


def covered(size: int, spans: list[tuple[int, int]], width: int = WIDTH) -> list[tuple[int, int]]:
    """The bytes covered by the starts in ``spans`` as disjoint ranges, end excluded, in order."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + width)
        else:
            out.append([first, last + width])
    return [(a, min(b, size)) for a, b in out]


def _cut(df: DataFrame, width: int, reach: int) -> tuple[DataFrame, str, str]:
    """``df`` with its texts, NULL as empty, and their spans; the names of the two columns."""
    text, spans, found = unused(df, "_text", "_spans", "_found")
    marks = repeats(df, width, reach).select(F.col("text_key").alias(found), F.col("spans").alias(spans))
    texts = df.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    return texts.join(marks, text_key(F.col(text)) == F.col(found), "left").drop(found), text, spans


def deduplicated(df: DataFrame, width: int = WIDTH, reach: int = REACH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of (``doc_id``, ``text``).

    Each byte is removed that lies in a string of ``width`` bytes that also starts elsewhere, in the same document or another.  Texts are
    UTF-8 bytes, NULL is empty; shorter texts stay whole; repeated rows of at least ``width`` bytes lose everything; ids may be NULL
    or repeat; an empty table gives no rows; further columns are ignored.
    """
    joined, text, spans = _cut(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, counts, digests = [], [], [], []
            for spans, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                ranges = covered(len(raw), [(s["first"], s["last"]) for s in spans or []], width)
                digest, at = hashlib.sha256(), 0
                for a, b in ranges:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                sizes.append(len(raw))
                gone.append(sum(b - a for a, b in ranges))
                counts.append(len(ranges))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(counts, pa.int64()),
                                              pa.array(digests)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("doc_id", spans, text).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(df: DataFrame, width: int = WIDTH, reach: int = REACH) -> DataFrame:
    """``df`` with the repeated strings cut out of ``text``; same columns and rows.  Bytes that no longer form a character are dropped."""
    joined, text, spans = _cut(df, width, reach)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans):
            if found is None or not len(found):
                out.append(text)
                continue
            raw, pieces, at = text.encode("utf-8", "surrogatepass"), [], 0
            for a, b in covered(len(raw), [(s["first"], s["last"]) for s in found], width):
                pieces.append(raw[at:a])
                at = b
            out.append(b"".join([*pieces, raw[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out)

    return joined.withColumn("text", F.when(F.col("text").isNotNull(), cut(F.col(text), F.col(spans)))).select(*df.columns)
