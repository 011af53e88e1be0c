"""Toxicity score of whole texts: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is a hashed n-gram of the lower-cased text (white space as one blank) that occurs once or more, twice or more, four times or
more, and so on.  Its value is the log ratio of its
smoothed rates in toxic and other training texts; a logistic regression is fitted on these values.  Training takes at most ``toxic_rows``
and ``other_rows`` labelled rows, those with the smallest hashes of their id, and weighs them back to the rates of all labelled
rows, so that the score is a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import distinct, per_chunk, smallest_hashes, spans, text_rows

BITS = 20
ORDERS = (4, 6)
TOXIC_ROWS, OTHER_ROWS = 1_200, 2_000
CHUNK_CHARS = 250_000
LEVELS, LEVEL_MIX = 4, 0x5BD1E995
THRESHOLD = 0.3
BLANKS = re.compile(r"\s+")


def ngram_keys(texts: list[str], orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every distinct n-gram bucket of each text, ordered by row and bucket."""
    marked = [" " + BLANKS.sub(" ", t.lower()).strip() + " " for t in texts]
    sizes = np.array([len(m) for m in marked])
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    row = np.repeat(np.arange(len(marked), dtype=np.uint64), sizes)
    keys = []
    mixed = np.zeros(len(points), dtype=np.uint32)
    for k in range(max(orders)):
        mixed = mixed[:len(points) - k] * np.uint32(0x01000193) + points[k:]
        n = k + 1
        if n in orders and len(mixed):
            inside = row[:len(mixed)] == row[k:]
            hashed = (mixed ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            hashed = (hashed ^ hashed >> np.uint32(15)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)
            keys.append((row[:len(mixed)] << np.uint64(32) | hashed)[inside])
    found = np.sort(np.concatenate(keys)) if keys else np.empty(0, dtype=np.uint64)
    if len(found):
        opens = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        times, found = np.diff(np.r_[opens, len(found)]), found[opens]
        more = [found[times >= 1 << level] ^ np.uint64(level * LEVEL_MIX & (1 << bits) - 1) for level in range(1, LEVELS)]
        found = distinct(np.concatenate([found, *more]))
    return (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one float32 per bucket: the fitted weight times the log-count ratio
    bias: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    def score(self, texts: list[str]) -> np.ndarray:
        row, bucket = ngram_keys(texts, self.orders, self.bits)
        z = np.bincount(row, weights=self.weights[bucket], minlength=len(texts)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit(rows: list[np.ndarray], labels: np.ndarray, case_weights: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS,
        smoothing: float = 1.0, penalty: float = 1e-3, epochs: int = 8, least_docs: int = 5, seed: int = 7) -> Model:
    """Fit on the buckets of each training row; buckets in fewer than ``least_docs`` rows get no weight.

    With one class only, or no rows, the model is the constant rate.
    """
    size, w = 1 << bits, case_weights.astype(float)
    rate = float((labels * w).sum() / w.sum()) if len(labels) else 0.0
    if not 0 < rate < 1:
        return Model(np.zeros(size, dtype=np.float32), float(np.clip(np.log((rate + 1e-3) / (1 - rate + 1e-3)), -7, 7)), orders, bits)
    docs, toxic = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
    for r, y in zip(rows, labels):
        docs[r] += 1
        if y:
            toxic[r] += 1
    ratio = (np.log((smoothing + toxic) / (labels.sum() + 2 * smoothing))
             - np.log((smoothing + docs - toxic) / ((1 - labels).sum() + 2 * smoothing))).astype(np.float32)
    ratio[docs < least_docs] = 0.0
    names = np.flatnonzero(ratio)
    place = np.zeros(size, dtype=np.int32)
    place[names] = np.arange(len(names))
    starts = np.cumsum([0, *(int((ratio[r] != 0).sum()) for r in rows)])
    n_rows = len(rows)
    column = np.empty(starts[-1], dtype=np.int32)
    for k, r in enumerate(rows):
        column[starts[k]:starts[k + 1]] = place[r[ratio[r] != 0]]
    del rows[:]
    factor = ratio[names]
    weight, bias = np.zeros(len(names)), float(np.log(rate / (1 - rate)))
    grown, grown_bias = np.full(len(names), 1e-2), 1e-2
    rng, w = np.random.default_rng(seed), w / w.mean()
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n_rows), max(1, n_rows // 64)):
            at = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in batch])
            local = np.repeat(np.arange(len(batch)), starts[batch + 1] - starts[batch])
            here = column[at]
            value = factor[here]
            z = np.bincount(local, weights=weight[here] * value, minlength=len(batch)) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[batch]) * w[batch] / len(batch)
            cols, where = np.unique(here, return_inverse=True)
            gradient = np.bincount(where, weights=error[local] * value) + penalty * weight[cols]
            grown[cols] += gradient ** 2
            weight[cols] -= 0.3 * gradient / np.sqrt(grown[cols])
            grown_bias += error.sum() ** 2
            bias -= 0.3 * error.sum() / np.sqrt(grown_bias)
    full = np.zeros(size, dtype=np.float32)
    full[names] = weight * ratio[names]
    return Model(full, bias, orders, bits)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def one_text_first(keys: DataFrame, bounds: dict[int, int]) -> DataFrame:
    """Of distinct (doc_id, label, _key) at most ``bounds[label]`` rows a label: one of every id, then those with the smallest hashes."""
    first = keys.groupBy("doc_id", "label").agg(F.min("_key").alias("_key"))
    others = keys.join(F.broadcast(first.select("doc_id", "_key")), ["doc_id", "_key"], "left_anti")
    firsts, more = ({r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} for df in (first, others))
    for label, rows in bounds.items():
        room = rows - firsts.get(label, 0)
        if room > 0 and more.get(label):
            first = first.unionByName(smallest_hashes(others.where(F.col("label") == label), room, more[label], "doc_id", "_key").select(*first.columns))
    return first


def train(documents: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out.

    Labels with a NULL id or class are left out; an id with several labels is toxic if one of them says so.  Documents that share an id
    all take its label; equal ones count once, and each class has a bound of its own.
    """
    kept = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label")))
    total = {r["label"]: r["n"] for r in kept.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = {1: toxic_rows, 0: other_rows}
    parts = [smallest_hashes(kept.where(F.col("label") == label), rows, total.get(label, 0), "doc_id") for label, rows in bounds.items()]
    chosen = parts[0].unionByName(parts[1])
    texts_of = text_rows(documents, "doc_id").withColumn("_key", F.xxhash64("text"))
    picked = one_text_first(stored(texts_of.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "_key").distinct(), "toxicity-keys"), bounds)
    rows = (texts_of.join(F.broadcast(picked), ["doc_id", "_key"]).dropDuplicates(["doc_id", "_key"]).select("doc_id", "label", "text"))

    def work(cols: dict[str, pa.Array], texts: list[str]) -> pa.RecordBatch:
        row, bucket = ngram_keys(texts)
        parts = np.split(bucket.astype("<i4"), np.cumsum(np.bincount(row, minlength=len(texts)))[:-1])
        return pa.RecordBatch.from_arrays([cols["doc_id"], cols["label"], pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc_id", "label", "buckets"])

    return fitted(stored(rows.mapInArrow(per_chunk(work, limit=CHUNK_CHARS), "doc_id long, label int, buckets binary"), "toxicity-sample"), total)


def fitted(sample: DataFrame, total: dict[int, int]) -> Model:
    """The model of a stored sample of (doc_id, label, buckets); ``total`` has the labelled rows of each class.

    The sample is bounded and one task of an executor fits it: no bucket of it passes through the driver, which gets the weights only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, buckets = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            buckets += [np.frombuffer(b.as_buffer(), dtype="<i4") for b in batch.column(1)]
        label = np.array(labels, dtype=float)
        seen = {k: max(1, int((label == k).sum())) for k in (0, 1)}
        weight = np.where(label == 1, total.get(1, 0) / seen[1], total.get(0, 0) / seen[0]) if len(label) else np.empty(0)
        model = fit(buckets, label, weight)
        names = np.flatnonzero(model.weights).astype("<i4")
        yield pa.RecordBatch.from_arrays([pa.array([names.tobytes()], pa.binary()), pa.array([model.weights[names].tobytes()], pa.binary()), pa.array([float(model.bias)])],
                                         names=["names", "weights", "bias"])

    order = ["label", F.crc32(F.col("doc_id").cast("string").cast("binary")), "buckets"]
    got = (sample.coalesce(1).sortWithinPartitions(*order).select("label", "buckets")
           .mapInArrow(run, "names binary, weights binary, bias double").collect())
    if not got:
        return fit([], np.empty(0), np.empty(0))
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[np.frombuffer(got[0]["names"], dtype="<i4")] = np.frombuffer(got[0]["weights"], dtype=np.float32)
    return Model(weights, got[0]["bias"])


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    NULL and empty texts get the score of no features; repeated rows get equal scores; a text of any length is scored whole; ids may be
    NULL; an empty table gives no rows; further columns are ignored.  The model is a fixed array of ``2 ** bits`` weights.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(cols: dict[str, pa.Array], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols["doc_id"], pa.array(shared.value.score(texts))], names=["doc_id", "score"])

    got = text_rows(documents, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(per_chunk(work, limit=CHUNK_CHARS), "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def not_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without the rows that score ``threshold`` or more, with the same columns.

    The text is scored in the row it stands in: nothing is joined, so repeated and NULL ids need no care.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            held = texts.tolist()
            yield pd.Series(np.concatenate([np.empty(0), *(shared.value.score(held[a:b]) for a, b in spans([len(t) for t in held], CHUNK_CHARS))]))

    return documents.where(~(scored(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= threshold))
