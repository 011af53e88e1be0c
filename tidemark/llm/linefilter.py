"""Quality rules with cross-document line frequency.

Each task measures its documents and hashes their normalised lines (lower case, runs of white space and digits reduced).  A line is
counted once per document and host, in partial sums before the shuffle.  Lines in more than ``max_docs`` documents of a host are
removed from all of them; a document that keeps too few of its words is depleted and rejected.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import per_chunk, ragged

MAX_DOCS = 10
LEAST_SHARE = 0.5
LEAST_WORDS = 50
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
DIGITS = re.compile(r"[0-9]+")
FEATURES = ("doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "lines array<long>, line_words array<int>")


def normalised(line: str) -> str:
    """Lower case, every run of ASCII digits a 0, words separated by one blank."""
    return DIGITS.sub("0", " ".join(WORD.findall(line.lower())))


def line_key(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(normalised(line).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three that the text holds twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    often = {w for w, n in Counter(windows).items() if n > 1}
    if not often:
        return 0
    total, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measure(text: str) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words of each distinct normalised line."""
    words = WORD.findall(text)
    seen: dict[str, int] = {}
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += seen[line] > 0
            seen[line] += 1 if seen[line] else 0
        else:
            seen[line] = 1 if WORD.search(line) else 0
    lines: dict[int, int] = {}
    for line, times in seen.items():
        if times:
            key = line_key(line)
            lines[key] = lines.get(key, 0) + times * len(WORD.findall(line))
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines


def features(df: DataFrame, host: str = "source") -> DataFrame:
    def work(cols: dict[str, pa.Array], texts: list[str]) -> pa.RecordBatch:
        got = [measure(t) for t in texts]
        numbers = [pa.array([g[k] for g in got], pa.int64()) for k in range(5)]
        sizes = np.array([len(g[5]) for g in got], dtype=np.int64)
        keys = np.array([k for g in got for k in g[5]], dtype=np.int64)
        words = np.array([n for g in got for n in g[5].values()], dtype=np.int32)
        return pa.RecordBatch.from_arrays([cols["doc_id"], cols["host"], *numbers, ragged(keys, sizes, pa.int64()), ragged(words, sizes, pa.int32())],
                                          names=[f.split()[0] for f in FEATURES.split(", ")])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(per_chunk(work), FEATURES)


def assess(df: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The measures of each document, the words its frequent lines take away, and the verdict.

    A document is one row: repeated rows count as often as they occur and come back as often.  NULL texts are empty and fail the base
    rules; a NULL host is a host of its own; ids may be NULL.  Depleted: fewer than ``least_share`` of its words are left.  An empty table
    gives no rows; further columns are ignored.
    """
    rows = stored(features(df, host).withColumn("_row", F.monotonically_increasing_id()), "line-features")
    lines = rows.select("_row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("_l")).select(
        "_row", "host", F.col("_l.lines").alias("line"), F.col("_l.line_words").alias("words"))
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs).drop("n_docs")
    taken = lines.join(often, ["host", "line"], "left_semi").groupBy("_row").agg(F.sum("words").alias("removed_words"))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce(F.col("removed_words"), F.lit(0))
    depleted = (F.col("n_words") - removed) < least_share * F.col("n_words")
    return (rows.drop("lines", "line_words").join(taken, "_row", "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
                    (~base_failed & ~depleted).alias("kept"), removed.alias("removed_words")))


def cleaned(df: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """``df`` (doc_id, text, host) with the frequent lines cut out of each text; rules and limits as in :func:`assess`."""
    @F.pandas_udf("array<bigint>")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [line_key(x) if WORD.search(x) else 0 for x in (t or "").split("\n")])

    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "cleaned-rows")
    at = (rows.select("_row", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.posexplode(F.arrays_zip(
        keys("text").alias("key"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("line"))).alias("_at", "_l"))
        .select("_row", "_host", "_at", F.col("_l.key").alias("_key"), F.col("_l.line").alias("_line")))
    often = (at.where("_key != 0").select("_row", "_host", "_key").distinct().groupBy("_host", "_key").count()
             .where(F.col("count") > max_docs).drop("count"))
    left = at.join(often, ["_host", "_key"], "left_anti").groupBy("_row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_line"))), lambda x: x["_line"]), "\n").alias("_text"))
    return rows.join(left, "_row", "left").withColumn("text", F.coalesce("_text", F.lit(""))).drop("_row", "_text")
