"""Ranked lexical search over bit-sliced Bloom signatures.

The index: documents of about the same number of different terms share a block.  A block has one bitmap of its documents per
signature bit, so the documents that may hold a term are the AND of a few bitmaps, never too few of them.  A term that occurs at least
``LEVELS[k]`` times sets the bits of that level as well, which bounds how often it may occur.

The search: with S_k the sum of the weights of an item's terms that may occur ``LEVELS[k]`` times, a document's score is at most
the sum of S_k times what that level can add at the document's length.  Twice as many documents as are asked for, those with the largest bounds, are scored
exactly; the last of the best asked for among them is a score that every document of the result reaches.  All documents whose bound reaches it are then
scored exactly from their whole texts, so false positives cost time and never change a result.

Items are taken in blocks of about ``PAIRS`` (item, term) pairs; what a task or the driver holds of them is bounded by that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import discard, stored
from .common import spans, text_rows

LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
HASHES = 4
BITS_PER_ENTRY = 12
BLOCK_ROWS = 4096
BLOCK_BITS = 1 << 24
FILTER_BITS = 1 << 22
HELD_TERMS = 200_000
PAIRS = 20_000
TOP = 10
CHUNK_BYTES = 1_000_000

#: A-Z become a-z; every other ASCII character that is no digit or small letter becomes a blank.
FOLD = bytes(c if c >= 128 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def hashes(terms: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(terms, categorize=False) if len(terms) else np.zeros(0, dtype=np.uint64)


def at_level(found: np.ndarray, level: int) -> np.ndarray:
    """The entry of a term at a level, by the 64-bit finaliser of splitmix."""
    z = found + np.uint64(0x9E3779B97F4A7C15 * level % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(31))


def places(entries: np.ndarray, width: int) -> np.ndarray:
    """(HASHES, entries): bit numbers of each entry in signatures of ``width`` bits."""
    first, step = entries & np.uint64(0xFFFFFFFF), entries >> np.uint64(32) | np.uint64(1)
    return ((first + np.arange(HASHES, dtype=np.uint64)[:, None] * step) % np.uint64(width)).astype(np.int64)


INDEX = "doc_ids array<{kind}>, lengths array<long>, width long, slices binary, terms array<binary>, holders array<long>"


def index(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Blocks of documents that have a term, and how many documents hold each term whose hash is in the filter ``wanted``.

    NULL and term-less texts are left out; rows with equal or NULL ids are documents of their own.
    """
    kind = docs.schema["doc_id"].dataType

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, list] = {}
        holders: Counter[bytes] = Counter()
        ids_type = None

        def row(ids, lengths, width, slices, terms, counts) -> pa.RecordBatch:
            return pa.record_batch([pa.array([ids], pa.list_(ids_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([width], pa.int64()),
                                    pa.array([slices], pa.binary()), pa.array([terms], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))],
                                   names=["doc_ids", "lengths", "width", "slices", "terms", "holders"])

        def block(size: int) -> pa.RecordBatch:
            members, width = open_blocks.pop(size), BITS_PER_ENTRY << size
            bits = np.zeros((width, len(members)), dtype=np.uint8)
            owner = np.repeat(np.arange(len(members)), [len(m[2]) for m in members])
            bits[places(np.concatenate([m[2] for m in members]), width), owner] = 1
            return row([m[0] for m in members], [m[1] for m in members], width, np.packbits(bits, axis=1).tobytes(), [], [])

        for batch in batches:
            ids_type = batch.column(0).type
            texts = batch.column(1)
            sizes = pa.compute.binary_length(texts).to_pylist()
            for a, b in spans(sizes, CHUNK_BYTES):
                split = [terms_of(texts[i].as_py()) for i in range(a, b)]
                counts = np.array([len(t) for t in split])
                if not counts.sum():
                    continue
                flat = np.empty(counts.sum(), dtype=object)
                flat[:] = [t for one in split for t in one]
                codes, known = pd.factorize(flat)
                found = hashes(known)
                pair, times = np.unique(np.repeat(np.arange(b - a), counts) * len(known) + codes, return_counts=True)
                doc, code = np.divmod(pair, len(known))
                held = np.bincount(code, minlength=len(known))
                for k in np.flatnonzero(np.unpackbits(wanted)[found % np.uint64(FILTER_BITS)]):
                    holders[known[k]] += int(held[k])
                per_level = [times >= level for level in LEVELS]
                entry = np.concatenate([at_level(found[code[m]], level) for m, level in zip(per_level, LEVELS)])
                place = np.concatenate([doc[m] for m in per_level])
                order = np.argsort(place, kind="stable")
                entry, ends = entry[order], np.cumsum(np.bincount(place, minlength=b - a))
                for i in np.flatnonzero(counts):
                    mine = entry[ends[i - 1] if i else 0:ends[i]]
                    size = max(6, int(len(mine) - 1).bit_length())
                    members = open_blocks.setdefault(size, [])
                    members.append((batch.column(0)[a + int(i)].as_py(), int(counts[i]), mine))
                    if len(members) >= min(BLOCK_ROWS, max(1, BLOCK_BITS // (BITS_PER_ENTRY << size))):
                        yield block(size)
                if len(holders) >= HELD_TERMS:
                    yield row([], [], 0, b"", list(holders), list(holders.values()))
                    holders.clear()
        for size in list(open_blocks):
            yield block(size)
        if holders:
            yield row([], [], 0, b"", list(holders), list(holders.values()))

    return text_rows(docs, "doc_id").mapInArrow(build, INDEX.format(kind=kind.simpleString()))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) once each; rows of the same item_id are one item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms = list(dict.fromkeys(terms_of(batch.column(1)[i].as_py())))
                yield pa.record_batch([batch.column(0).take(pa.array([i] * len(terms), pa.int64())), pa.array(terms, pa.binary())], names=["item_id", "term"])

    return text_rows(items, "item_id").mapInArrow(split, f"item_id {kind}, term binary").distinct()


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits with those of the items' terms set; the driver reads the bit numbers only."""

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"bit": (hashes(pdf["term"].map(bytes).to_numpy(dtype=object)) % np.uint64(FILTER_BITS)).astype(np.int64)})

    bits = np.zeros(FILTER_BITS, dtype=np.uint8)
    for row in terms.select("term").mapInPandas(numbers, "bit long").distinct().toLocalIterator():
        bits[row["bit"]] = 1
    return np.packbits(bits)


class Items:
    """A block of items with the weights of their terms, and the lengths they are scored at."""

    def __init__(self, rows: list[Row], n_docs: int, n_terms: int) -> None:
        self.ids = list(dict.fromkeys(r["item_id"] for r in rows))
        self.number = {item: k for k, item in enumerate(self.ids)}
        self.terms = list(dict.fromkeys(bytes(r["term"]) for r in rows))
        place = {t: k for k, t in enumerate(self.terms)}
        self.of: list[dict[bytes, int]] = [{} for _ in self.ids]
        for r in rows:
            self.of[self.number[r["item_id"]]][bytes(r["term"])] = r["w"]
        self.rows = [np.array([place[t] for t in own], dtype=np.int64) for own in self.of]
        self.weights = [np.array(list(own.values()), dtype=np.float64) for own in self.of]
        self.n_docs, self.n_terms = n_docs, n_terms

    def norm(self, length):
        return 10 + 90 * length * self.n_docs // self.n_terms

    def bounds(self, width: int, lengths: np.ndarray, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """For each item: its number and the largest score that each document of a block may have."""
        bitmaps = np.frombuffer(slices, dtype=np.uint8).reshape(width, -1)
        flat = np.array(self.terms, dtype=object)
        found, norm = hashes(flat), self.norm(lengths)
        live, above = np.arange(len(flat)), None
        held, gains, before = [], [], 0
        for k, level in enumerate(LEVELS):
            where = places(at_level(found[live], level), width)
            may = np.bitwise_and.reduce(bitmaps[where], axis=0)
            if above is not None:
                may &= above
            some = may.any(axis=1)
            live, above = live[some], may[some]
            if not len(live):
                break
            most = np.minimum(lengths, LEVELS[k + 1] - 1) if k + 1 < len(LEVELS) else lengths
            most = np.maximum(most, level)
            gain = 1_000_000_000 * most // (1000 * most + 8 * norm)
            at = np.full(len(flat), -1, dtype=np.int64)
            at[live] = np.arange(len(live))
            held.append((at, above))
            gains.append(gain - before)
            before = gain
        for i, (rows, weights) in enumerate(zip(self.rows, self.weights)):
            total = np.zeros(len(lengths), dtype=np.int64)
            for (at, may), gain in zip(held, gains):
                mine = at[rows]
                use = mine >= 0
                if not use.any():
                    break
                on = np.unpackbits(may[mine[use]], axis=1, count=len(lengths))
                total += (weights[use] @ on).astype(np.int64) * gain
            yield i, total

    def score(self, text: str, items: list[int]) -> list[int]:
        """The exact scores of a text for some of the items."""
        counts = Counter(terms_of(text))
        m = self.norm(sum(counts.values()))
        return [sum(w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m)) for t, w in self.of[i].items() if t in counts) for i in items]


def largest_bounds(blocks: DataFrame, items: Items, keep: int, kind: str) -> DataFrame:
    """(item, doc_id, bound): for each item the ``keep`` largest bounds of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [np.zeros(0, dtype=np.int64) for _ in items.ids]
        owners = [np.zeros(0, dtype=object) for _ in items.ids]
        id_type = None
        for ids, lengths, width, slices in _blocks(batches):
            id_type = ids.type
            names = np.array(ids.to_pylist() + [None], dtype=object)[:-1]
            for i, bound in items.bounds(width, lengths, slices):
                at = np.flatnonzero(bound > (tops[i].min() if len(tops[i]) >= keep else 0))
                if len(at) > keep:
                    at = at[np.argpartition(-bound[at], keep)[:keep]]
                if len(at):
                    both, who = np.r_[tops[i], bound[at]], np.r_[owners[i], names[at]]
                    best = np.argsort(-both, kind="stable")[:keep]
                    tops[i], owners[i] = both[best], who[best]
        if id_type is not None:
            yield pa.record_batch([pa.array(np.repeat(np.arange(len(tops)), [len(t) for t in tops]), pa.int64()), pa.array(np.concatenate(owners).tolist(), id_type),
                                   pa.array(np.concatenate(tops), pa.int64())], names=["item", "doc_id", "bound"])

    return blocks.mapInArrow(run, f"item long, doc_id {kind}, bound long")


def not_excluded(blocks: DataFrame, items: Items, least: np.ndarray, kind: str) -> DataFrame:
    """(item, doc_id) of every document whose bound reaches the item's ``least`` score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, width, slices in _blocks(batches):
            at, who = [], []
            for i, bound in items.bounds(width, lengths, slices):
                some = np.flatnonzero(bound >= max(1, int(least[i])))
                at.append(some)
                who.append(np.full(len(some), i, dtype=np.int64))
            yield pa.record_batch([pa.array(np.concatenate(who), pa.int64()), ids.take(pa.array(np.concatenate(at), pa.int64()))], names=["item", "doc_id"])

    return blocks.mapInArrow(run, f"item long, doc_id {kind}")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, int, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column(0)[i].values
            yield ids, batch.column(1)[i].values.to_numpy(zero_copy_only=False), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()


def exact(docs: DataFrame, candidates: DataFrame, items: Items, kind: str) -> DataFrame:
    """(item, doc_id, score): the scores above 0 of the candidates, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, who, score = [], [], []
            for k in range(batch.num_rows):
                mine = batch.column(2)[k].as_py()
                for i, s in zip(mine, items.score(batch.column(1)[k].as_py(), mine)):
                    if s > 0:
                        at.append(k)
                        who.append(i)
                        score.append(s)
            yield pa.record_batch([pa.array(who, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    asked = candidates.groupBy(F.col("doc_id").alias("asked_id")).agg(F.collect_set("item").alias("items"))
    texts = text_rows(docs, "doc_id")
    rows = texts.join(asked, texts["doc_id"].eqNullSafe(asked["asked_id"])).select("doc_id", "text", "items")
    return rows.mapInArrow(run, f"item long, doc_id {kind}, score long")


def ranked(rows: DataFrame, by: str, keep: int) -> DataFrame:
    """The first ``keep`` rows of each item, NULL ids last."""
    w = Window.partitionBy("item").orderBy(F.desc(by), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0; no terms or documents give no rows."""
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (items, "item_id")))
    asked = stored(item_terms(items), "item-terms")
    built = stored(index(docs, term_filter(asked)), "signatures")
    blocks = built.where("width > 0").select("doc_ids", "lengths", "width", "slices")
    size = built.select(F.explode("lengths").alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    spark = docs.sparkSession
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    if not size["docs"]:
        return out
    counts = (built.select(F.explode(F.arrays_zip("terms", "holders")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.holders").alias("df")))
    weight = F.floor(1000 * F.log((2 * F.lit(size["docs"]) + 2) / (2 * F.coalesce("df", F.lit(0)) + 1))).cast("long")
    weighed = asked.join(counts, "term", "left").select("item_id", "term", weight.alias("w"))
    n_blocks = max(1, -(-asked.count() // PAIRS))
    weighed = stored(weighed.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))), "item-weights")
    for part in range(n_blocks):
        rows = weighed.where(F.col("part") == part).collect()
        if rows:
            out = out.unionByName(_answers(docs, blocks, Items(rows, size["docs"], size["terms"]), top, kind, item_kind))
    discard(built)
    return out


def _answers(docs: DataFrame, blocks: DataFrame, items: Items, top: int, kind: str, item_kind: str) -> DataFrame:
    spark = docs.sparkSession
    first = ranked(largest_bounds(blocks, items, 2 * top, kind), "bound", 2 * top)
    first = stored(first.select("item", "doc_id").distinct(), "first-candidates")
    sure = ranked(exact(docs, first, items, kind), "score", top).where(F.col("rank") == top).select("item", "score").collect()
    least = np.zeros(len(items.ids), dtype=np.int64)
    for row in sure:
        least[row["item"]] = row["score"]
    left = stored(not_excluded(blocks, items, least, kind).distinct(), "candidates")
    best = stored(ranked(exact(docs, left, items, kind), "score", top), "ranked")
    names = spark.createDataFrame([(k, item) for k, item in enumerate(items.ids)], f"item long, item_id {item_kind}")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")
