"""Near-duplicate join of documents by an LSH forest of MinHash signatures.

Texts are compared by the Jaccard similarity of their sets of five-word shingles.  Each tree of the forest orders all distinct texts
by a prefix of their own slice of the signature.  Prefixes are shortened, from ``DEEPEST`` values down, until a pair at the threshold
meets in some tree with the target recall.  Texts that share a prefix are tied to the smallest of them, so a bucket of n texts gives n
rows; ties are joined into groups, and inside a group every pair is verified exactly on the shingle sets.  Groups of more than
``BLOCK`` texts are verified in blocks: only texts whose sizes allow the threshold are brought together, and a task returns counts and a
spanning set of links, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import per_chunk, ragged, unused
from .graphs import components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEEPEST = 12
RECALL = 0.999
BLOCK = 512
COLUMNS_AT_ONCE = 4096


def depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix with which a pair at the threshold meets with the target recall."""
    for d in range(deepest, 0, -1):
        if 1 - (1 - threshold ** d) ** trees >= recall:
            return d
    return 1


class Shingler:
    """Sorted distinct hashes of the shingles of a text; hashes of words are kept in a bounded table."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def _word(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > 500_000:
                self.words.clear()
            got = self.words[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got

    def shingles(self, text: str) -> np.ndarray:
        """Texts of fewer than five words have one shingle, texts without a word none."""
        words = text.split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        hashes = np.fromiter(map(self._word, words), dtype=np.uint64, count=len(words))
        n = max(1, len(words) - SHINGLE_WORDS + 1)
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(min(SHINGLE_WORDS, len(words))):
            mixed = (mixed ^ hashes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(low), 2048):
        np.minimum(out, (low[a:a + 2048, None] * factors + shifts).min(axis=0), out=out)
    return out


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def signatures(df: DataFrame, trees: int, prefix: int, seed: int = 3) -> DataFrame:
    """(doc_id, text_key, prefixes): one 64-bit key for each tree, none for texts without words."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 31, trees * prefix, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, trees * prefix, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()

        def work(cols: dict[str, pa.Array], texts: list[str]) -> pa.RecordBatch:
            found = []
            for t in texts:
                s = shingler.shingles(t)
                if len(s):
                    values = signature(s, factors, shifts).reshape(trees, prefix).astype(np.uint64)
                    key = np.arange(1, trees + 1, dtype=np.uint64)
                    for k in range(prefix):
                        key = (key ^ values[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(31)
                    found.append(key)
                else:
                    found.append(np.empty(0, dtype=np.uint64))
            keys = np.concatenate(found).view(np.int64)
            return pa.RecordBatch.from_arrays([cols["doc_id"], cols["text_key"], ragged(keys, np.array([len(f) for f in found]), pa.int64())],
                                              names=["doc_id", "text_key", "prefixes"])
        yield from per_chunk(work)(batches)

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key binary, prefixes array<long>")


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of shingle sets are at least that similar; exact, in blocks of shared shingles."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(m), sizes)
    flat = np.concatenate(sets) if m else np.empty(0, dtype=np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    opens = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.empty(0, dtype=bool)
    column = np.cumsum(opens) - 1
    shared = np.bincount(column)[column] > 1 if len(flat) else opens
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    both = np.zeros((m, m), dtype=np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, width, COLUMNS_AT_ONCE):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS_AT_ONCE])
        part = np.zeros((m, min(COLUMNS_AT_ONCE, width - a)), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        both += part @ part.T
    least = Fraction(str(threshold))
    common = both.astype(np.int64)
    out = common * least.denominator >= least.numerator * (sizes[:, None] + sizes[None, :] - common)
    out &= common > 0
    np.fill_diagonal(out, False)
    return out


def _heads(links: np.ndarray) -> np.ndarray:
    head = np.arange(len(links))
    while True:
        near = np.where(links, head[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(head, near)
        new = new[new]
        if (new == head).all():
            return head
        head = new


def _verified(groups: DataFrame, threshold: float) -> DataFrame:
    """(text_key, n_links, head) of each text in each block; ``groups`` has (block, side, text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()

        def verify(rows: dict[bytes, tuple[int, np.ndarray]]) -> pa.RecordBatch:
            keys = sorted(rows)
            links = linked([rows[k][1] for k in keys], threshold)
            side = np.array([rows[k][0] for k in keys])
            if side.any():
                links &= side[:, None] != side[None, :]
            head = _heads(links)
            counts = links.sum(axis=1)
            some = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[k] for k in some], pa.binary()), pa.array(counts[some], pa.int64()), pa.array([keys[head[k]] for k in some], pa.binary())],
                names=["text_key", "n_links", "head"])

        now, rows = None, {}
        for batch in batches:
            for block, side, key, text in zip(*(batch.column(k) for k in range(4))):
                block = block.as_py()
                if block != now:
                    if len(rows) > 1:
                        yield verify(rows)
                    now, rows = block, {}
                key = key.as_py()
                if key not in rows:
                    rows[key] = (side.as_py(), shingler.shingles(text.as_py()))
        if len(rows) > 1:
            yield verify(rows)

    ordered = groups.repartition("block").sortWithinPartitions("block")
    return ordered.select("block", "side", "text_key", "text").mapInArrow(run, "text_key binary, n_links long, head binary")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, class_key, n_links) of every row of (``doc_id``, ``text``).

    ``class_key`` is the key of the smallest text among those connected by links, the row's own for a text without links; ``n_links``
    counts the other distinct texts at least ``threshold`` similar.  Rows with equal texts share all three.  NULL texts are empty; texts
    without a word are alike only to equal ones; ids may be NULL or repeat; an empty table gives no rows; further columns are ignored.
    """
    prefix = depth(threshold, trees, recall)
    rows = stored(signatures(df, trees, prefix), "signatures")
    texts = rows.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.any_value("prefixes").alias("prefixes"))
    leaves = texts.select("text_key", F.posexplode("prefixes").alias("tree", "prefix"))
    buckets = leaves.groupBy("tree", "prefix").agg(F.min("text_key").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    ties = leaves.join(buckets, ["tree", "prefix"]).where("a != text_key").select("a", F.col("text_key").alias("b")).distinct()
    groups = stored(components(ties), "groups")
    counts = groups.groupBy("head").agg(F.count(F.lit(1)).alias("_total"))
    members = (groups.join(counts, "head").join(texts.select(F.col("text_key").alias("node"), F.col("doc_id").alias("_one")), "node"))
    docs = df.select(F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = (docs.join(members, (F.col("_key") == F.col("node")) & F.col("_id").eqNullSafe(F.col("_one")))
             .select(F.col("node").alias("text_key"), F.col("head").alias("group"), "_total", "text"))
    verified = stored(_verified(_laid_out(found, threshold, block), threshold), "links")
    links = verified.groupBy("text_key").agg(F.sum("n_links").alias("n_links"))
    classes = components(verified.select(F.col("text_key").alias("a"), F.col("head").alias("b")))
    known = links.join(classes.withColumnRenamed("node", "text_key"), "text_key", "left")
    return (rows.select("doc_id", "text_key").join(known, "text_key", "left")
            .select("doc_id", "text_key", F.coalesce("head", "text_key").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links")))


def _laid_out(found: DataFrame, threshold: float, block: int) -> DataFrame:
    """(block, side, text_key, text): a group that fits is one block; in a larger one, blocks of texts of like size meet in pairs.

    Sizes are shingle counts.  Texts at least ``threshold`` similar differ in shingles by that factor at most, so with classes of
    ``1 / threshold`` they lie in one class or in two neighbouring ones.
    """
    small = found.where(F.col("_total") <= block).select(F.hex("group").alias("block"), F.lit(0).alias("side"), "text_key", "text")

    @F.pandas_udf("int")
    def sizes(texts: pd.Series) -> pd.Series:
        shingler = Shingler()
        return texts.map(lambda t: len(shingler.shingles(t))).astype("int32")

    large = (found.where(F.col("_total") > block)
             .withColumn("_class", F.floor(F.log(F.greatest(sizes("text"), F.lit(1)).cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")))
    large = stored(large.select("group", "text_key", "text", "_class"), "large-groups")
    parts = large.groupBy("group", "_class").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_parts"))
    above = parts.select("group", (F.col("_class") - 1).alias("_class"), F.col("_parts").alias("_above"))
    below = parts.select("group", (F.col("_class") + 1).alias("_class"), F.col("_parts").alias("_below"))
    dealt = (large.join(parts, ["group", "_class"]).join(above, ["group", "_class"], "left").join(below, ["group", "_class"], "left")
             .withColumn("_mine", F.pmod(F.xxhash64("text_key"), F.col("_parts")).cast("int")))
    cells = F.expr("""concat(
        transform(sequence(0, _parts - 1), o -> struct(_class as c, least(o, _mine) as i, _class as d, greatest(o, _mine) as j,
                                                      case when o = _mine then 0 when _mine < o then 1 else 2 end as side)),
        if(_above is null, array(), transform(sequence(0, coalesce(_above, 1) - 1), o -> struct(_class as c, _mine as i, _class + 1 as d, o as j, 1 as side))),
        if(_below is null, array(), transform(sequence(0, coalesce(_below, 1) - 1), o -> struct(_class - 1 as c, o as i, _class as d, _mine as j, 2 as side))))""")
    spread = dealt.select("group", "text_key", "text", F.explode(cells).alias("_cell")).select(
        F.concat_ws("-", F.hex("group"), "_cell.c", "_cell.i", "_cell.d", "_cell.j").alias("block"), F.col("_cell.side").alias("side"), "text_key", "text")
    return small.unionByName(spread)


def one_of_each(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with one row of each class of near duplicates, that of the smallest id (NULL last, then text key); same columns."""
    found = near_duplicates(df, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))).alias("_first")
    mine, doc, theirs, other, nth = unused(df, "_text_key", "_doc", "_chosen_key", "_chosen_doc", "_nth")
    chosen = found.groupBy("class_key").agg(first).select(F.col("_first.doc_id").alias(other), F.col("_first.text_key").alias(theirs))
    keyed = df.withColumn(mine, text_key(F.col("text"))).withColumn(doc, F.col("doc_id").cast("long"))
    kept = keyed.join(chosen, (F.col(mine) == F.col(theirs)) & F.col(doc).eqNullSafe(F.col(other)))
    once = Window.partitionBy(mine, doc).orderBy(F.lit(1))
    return kept.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).select(*df.columns)
