"""Token counts of whole texts: short ones piece by piece, huge ones as overlapping chunks that are spliced at stable boundaries.

The vocabulary must be byte-level BPE whose pre-tokenizer scans the text from left to right and keeps no state but its place.
Wherever the scan of a chunk and the scan of the whole text both begin a piece, they agree from there on.  Each chunk of a huge
document reaches into the next one; the first place in that overlap where both chunks begin a piece is where they are spliced.
A place counts for the left chunk only if ``MARGIN`` characters follow it there, since no piece before it then looks beyond the chunk.

If an overlap holds no such place (one run of letters may be longer), the two chunks become one: its overlap is as wide as the next
chunk.  That is repeated for the documents concerned until every overlap has a place; a chunk that reaches the end needs none.

NULL texts are empty and have no token; rows with equal or NULL ids are counted on their own; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import per_chunk, text_rows

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
MARGIN = 16
TOKEN_LIMIT = 1024
KEPT = 200_000
KEPT_CHARS = 40

#: Everything up to white space that is certainly white space to the vocabulary's scanner.
SEGMENT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space of some but not all definitions; a text with any of it goes to the library whole.
UNSURE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
BLANK = re.compile(r"\s")

_OPEN: dict[str, Counter] = {}


class Recent(dict):
    """Token counts of segments, the recently used ones: a full table becomes the old one, and the older one is dropped."""

    def __init__(self, measure) -> None:
        super().__init__()
        self.measure, self.old = measure, {}

    def __missing__(self, segment: str) -> int:
        n = self.old.get(segment)
        if n is None:
            n = self.measure(segment)
            if len(segment) > KEPT_CHARS:
                return n
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[segment] = n
        return n


class Counter:
    """The library's tokenizer in one worker process."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        require_stateless(self.whole.to_str())
        self.known = Recent(self._library)

    def _library(self, text: str) -> int:
        return len(self.whole.encode(text, add_special_tokens=False))

    def count(self, text: str) -> int:
        """Tokens of a text.

        A piece always ends before a blank or line break that follows something else, and no piece looks past it, so the
        segments between such places can be counted on their own.
        """
        if UNSURE.search(text):
            return self._library(text)
        return sum(map(self.known.__getitem__, SEGMENT.findall(text)))

    def marks(self, text: str, upto: int, since: int, until: int) -> tuple[int, list, list]:
        """All tokens of a chunk, and (place, tokens before it) of the pieces that begin before ``upto`` or in [since, until]."""
        found = self.whole.encode(text, add_special_tokens=False)
        places, words = found.offsets, found.word_ids
        head, tail, last = [], [], None
        for i, word in enumerate(words):
            at = places[i][0]
            if word != last:
                last = word
                if at < upto:
                    head.append((at, i))
                if since <= at <= until:
                    tail.append((at, i))
        return len(words), head, tail


def require_stateless(description: str) -> None:
    """Refuse vocabularies for which places cannot be proved stable, or whose special strings are longer than the margin."""
    parts = json.loads(description)
    scan = parts["pre_tokenizer"] or {}
    known = (parts["model"]["type"] == "BPE" and scan.get("type") == "ByteLevel" and scan.get("use_regex") and not scan.get("add_prefix_space")
             and parts["normalizer"] is None and parts["post_processor"] is None and not parts["model"].get("dropout"))
    special = [t for t in parts["added_tokens"] if len(t["content"]) + 3 > MARGIN or t["lstrip"] or t["rstrip"] or t["single_word"] or BLANK.search(t["content"])]
    if not known or special:
        raise ValueError("not a byte-level vocabulary whose pieces depend on nothing before them")


def counter(path: str) -> Counter:
    """One tokenizer per worker process and vocabulary."""
    if path not in _OPEN:
        _OPEN[path] = Counter(path)
    return _OPEN[path]


def count(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    if not MARGIN < overlap <= chunk:
        raise ValueError("an overlap is wider than the margin and no wider than a chunk")
    texts = text_rows(docs, "doc_id").withColumn("n_bytes", F.octet_length("text").cast("long"))
    long = F.length("text") > chunk + overlap
    kind = docs.schema["doc_id"].dataType.simpleString()

    def short(cols: dict[str, pa.Array], lines: list[str]) -> pa.RecordBatch:
        measure = counter(path).count
        return pa.record_batch([cols["doc_id"], cols["n_bytes"], pa.array([measure(t) for t in lines], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    few = texts.where(~long).mapInArrow(per_chunk(short), f"doc_id {kind}, n_bytes long, n_tokens long")
    many = spliced(texts.where(long), path, kind, chunk, overlap)
    return few.unionByName(many).withColumn("over_limit", F.col("n_tokens") > limit)


def chunks(texts: DataFrame, kind: str, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, n_bytes, k, last, text): chunk k with the overlap that reaches into the next one, dealt over all tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "n_bytes", "k", "last", "text"]
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                text = one.column(3)[0].as_py()
                n = max(1, -(-(len(text) - overlap) // chunk))
                for a in range(0, n, 64):
                    ks = range(a, min(n, a + 64))
                    at = pa.array([0] * len(ks))
                    yield pa.record_batch([one.column(0).take(at), one.column(1).take(at), one.column(2).take(at), pa.array(list(ks), pa.int64()),
                                           pa.array([k == n - 1 for k in ks]), pa.array([text[k * chunk:(k + 1) * chunk + overlap] for k in ks])], names=names)

    named = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text")
    out = named.mapInArrow(cut, f"row long, doc_id {kind}, n_bytes long, k long, last boolean, text string")
    return out.repartition("row", "k")


MARKS = "row long, a long, b long, last boolean, n_tokens long, head array<struct<at:long,before:long>>, tail array<struct<at:long,before:long>>"


def encoded(pieces: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Tokens and places, counted from the document's start, of (row, a, b, last, text): the chunks a to b - 1 as one."""

    def work(cols: dict[str, pa.Array], lines: list[str]) -> pa.RecordBatch:
        tool = counter(path)
        starts, ends = cols["a"].to_pylist(), cols["b"].to_pylist()
        totals, heads, tails = [], [], []
        for a, b, last, text in zip(starts, ends, cols["last"].to_pylist(), lines):
            core = (b - a) * chunk
            n, head, tail = tool.marks(text, overlap, core, -1 if last else len(text) - MARGIN)
            totals.append(n)
            heads.append([{"at": a * chunk + at, "before": i} for at, i in head])
            tails.append([{"at": a * chunk + at, "before": i} for at, i in tail])
        place = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
        return pa.record_batch([cols["row"], cols["a"], cols["b"], cols["last"], pa.array(totals, pa.int64()), pa.array(heads, place), pa.array(tails, place)],
                               names=["row", "a", "b", "last", "n_tokens", "head", "tail"])

    return pieces.select("row", "a", "b", "last", "text").mapInArrow(per_chunk(work), MARKS)


def seams(marks: DataFrame) -> DataFrame:
    """(row, a, b, common): for every piece but the last, its first place shared with the next piece, or NULL."""
    after = marks.select("row", F.col("a").alias("b"), F.col("head").alias("ahead"))
    shared = F.filter("tail", lambda t: F.exists("ahead", lambda h: h["at"] == t["at"]))
    first = F.try_element_at(shared, F.lit(1))
    same = F.filter("ahead", lambda h: h["at"] == first["at"])
    return marks.where(~F.col("last")).join(after, ["row", "b"]).select(
        "row", "a", "b", first["at"].alias("common"), (first["before"] - F.try_element_at(same, F.lit(1))["before"]).alias("gain"))


def spliced(texts: DataFrame, path: str, kind: str, chunk: int, overlap: int) -> DataFrame:
    base = stored(chunks(texts, kind, chunk, overlap), "token-chunks")
    marks = stored(encoded(base.withColumn("a", F.col("k")).withColumn("b", F.col("k") + 1), path, chunk, overlap), "token-marks")
    while True:
        joints = stored(seams(marks), "token-seams")
        torn = joints.where(F.col("common").isNull())
        if torn.isEmpty():
            break
        marks = stored(widened(base, marks, torn, path, chunk, overlap), "token-marks")
    ends = marks.where("last").select("row", F.col("n_tokens").alias("gain"))
    totals = joints.select("row", "gain").unionByName(ends).groupBy("row").agg(F.sum("gain").alias("n_tokens"))
    return base.where("last").select("row", "doc_id", "n_bytes").join(totals, "row").drop("row")


def widened(base: DataFrame, marks: DataFrame, torn: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Places after every piece before a torn seam and the piece behind it were joined into one and encoded again."""
    w = Window.partitionBy("row").orderBy("a")
    broken = torn.select("row", F.col("b").alias("a"), F.lit(True).alias("torn"))
    touched = marks.select("row", "a", "b", "last").join(torn.select("row").distinct(), "row", "left_semi").join(broken, ["row", "a"], "left")
    runs = touched.withColumn("run", F.sum(F.when(F.col("torn"), 0).otherwise(1)).over(w))
    merged = runs.groupBy("row", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.bool_or("last").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = merged.withColumn("k", F.explode(F.sequence("a", F.col("b") - 1)))
    core = F.when(F.col("k") == F.col("b") - 1, F.col("text")).otherwise(F.substring("text", 1, chunk))
    pieces = (parts.join(base.select("row", "k", "text"), ["row", "k"]).groupBy("row", "a", "b", "last")
              .agg(F.array_sort(F.collect_list(F.struct("k", core.alias("core")))).alias("cores"))
              .select("row", "a", "b", "last", F.array_join(F.transform("cores", lambda c: c["core"]), "").alias("text")))
    inside = parts.select("row", F.col("k").alias("a"))
    kept = marks.join(inside, ["row", "a"], "left_anti")
    return kept.unionByName(encoded(pieces, path, chunk, overlap))
