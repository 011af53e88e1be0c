"""Spelling variants: the words one insertion, deletion or replacement away, found in a trie that is a table.

Every word enters the trie twice, as ``>word`` and as ``<drow``.  A state (word, position, node, edits) says that the first
``position`` letters of the word lead to the trie's ``node`` with so many edits.  States start with no edit in the middle of the
word, since an edit leaves one half as it is: edits behind the middle are found forwards, those before it backwards.  Level by level
the states are joined with the edges of their node; an edge tells what may follow below it, so that a state whose next letter
cannot follow is never passed on.  A state at the end of its word and of another one, with one edit, is a pair of neighbours.

Words of ``longest`` letters or more, one level each, are paired by their deletions instead: two words that differ by a
replacement share the rest, and an insertion leaves the whole other word.  Every pair so found is read letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .common import per_chunk, text_rows

LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
DAMAGED = 199
LONGEST = 48
HELD_WORDS = 300_000
DOUBLINGS = 5  # a form is TIMES times as frequent, so no chain of forms is longer than 27 for 64-bit counts
LOWER_RUN = "[a-zÀ-ÿ]"


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """(word, n) of all texts: letter runs in lower case, one letter less where the hash of document and run says so.

    NULL texts hold no word; a NULL doc_id hashes as an empty one; repeated rows count as often as they occur.
    """
    run = re.compile(LOWER_RUN + "{%d,}" % least)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def taken() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                prefix = zlib.crc32(f"{ids[i].as_py()}:".encode())
                for word, n in Counter(run.findall(texts[i].as_py().encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), prefix)
                    if not h % damaged:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) >= HELD_WORDS:
                    yield taken()
        if total:
            yield taken()

    rows = text_rows(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text"), "doc_id")
    return rows.mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def both_ways(words: DataFrame) -> DataFrame:
    """(word, start): each word marked and read forwards and backwards, with the letters before its middle."""
    half = F.floor(F.length("word") / 2).cast("int")
    forwards = F.struct(F.concat(F.lit(">"), "word").alias("word"), (half + 1).alias("start"))
    backwards = F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("word"), (F.length("word") - half + 1).alias("start"))
    return words.select(F.inline(F.array(forwards, backwards)))


def trie(marked: DataFrame, least: int) -> DataFrame:
    """(depth, node, ends, kids): the nodes from the first level that a state can stand on, and their edges.

    ``kids`` has one (letter, ends, after) per letter below the node: whether a word ends there, and the letters that follow.
    A node has no more of them than the alphabet has letters.
    """
    top = least // 2 + 1
    places = marked.select("word", F.explode(F.sequence(F.lit(top), F.length("word"))).alias("depth"))
    letter = F.when(F.col("depth") < F.length("word"), F.substring("word", F.col("depth") + 1, F.lit(1)))
    nodes = (places.select(F.substring("word", F.lit(1), F.col("depth")).alias("node"), letter.alias("letter"))
             .groupBy("node").agg(F.array_join(F.collect_set("letter"), "").alias("after"), F.bool_or(F.col("letter").isNull()).alias("ends")))
    nodes = stored(nodes, "trie-nodes")
    below = (nodes.where(F.length("node") > top).select(F.substring("node", F.lit(1), F.length("node") - 1).alias("node"),
             F.struct(F.substring("node", -1, 1).alias("letter"), "ends", "after").alias("kid")).groupBy("node").agg(F.collect_list("kid").alias("kids")))
    return nodes.join(below, "node", "left").select(F.length("node").alias("depth"), "node", "ends", "kids")


def letter(at: Column) -> Column:
    """The word's letter at this position, from 0; empty behind its end."""
    return F.substring("word", at + 1, F.lit(1))


def next_level(states: DataFrame, level: DataFrame) -> DataFrame:
    """(word, pos, node, edits, found): the states one level down that can still end, and the neighbours met on the way."""
    joined = states.join(level, "node")
    pos, size = F.col("pos"), F.length("word")
    here = joined.select("word", "pos", "node", "edits", F.explode("kids").alias("kid"))
    child = F.concat("node", "kid.letter")
    fresh = F.col("edits") == 0
    same = F.col("kid.letter") == letter(pos)

    def reached(at: Column) -> Column:
        return F.when(at == size, F.col("kid.ends")).otherwise((at < size) & F.contains("kid.after", letter(at)))

    def state(at: Column, edits: int) -> Column:
        done = (F.lit(edits) == 1) & (at == size)
        return F.struct(at.alias("pos"), child.alias("node"), F.lit(edits).alias("edits"), done.alias("found"))

    # an edit beside equal letters has several places; only the last of them is taken
    moves = F.array(
        F.when(fresh & same, state(pos + 1, 0)),
        F.when(~fresh & same & reached(pos + 1), state(pos + 1, 1)),
        F.when(fresh & ~same & (pos < size) & reached(pos + 1), state(pos + 1, 1)),
        F.when(fresh & ~same & reached(pos), state(pos, 1)),
        F.when(fresh & (letter(pos + 1) == F.col("kid.letter")) & (letter(pos) != letter(pos + 1)) & reached(pos + 2), state(pos + 2, 1)))
    down = here.select("word", F.explode(moves).alias("m")).where(F.col("m").isNotNull()).select("word", "m.pos", "m.node", "m.edits", "m.found")
    # the last letter left out: the node itself is the other word
    short = joined.where(fresh & (pos == size - 1) & F.col("ends")).select("word", "pos", "node", "edits", F.lit(True).alias("found"))
    return down.unionByName(short)


def frontier_pairs(words: DataFrame, least: int, longest: int) -> DataFrame:
    """(word, near) in both directions, for words of up to ``longest`` letters; pairs seen from both ends come twice."""
    marked = stored(both_ways(words), "marked-words")
    edges = stored(trie(marked, least).repartition("depth", "node"), "trie-edges")
    deepest = marked.agg(F.max(F.length("word"))).first()[0] or 0
    # every state of a level stands on a node of that depth, so a level reads its own edges only
    found, states = [], None
    for depth in range(least // 2 + 1, deepest):
        starting = marked.where(F.col("start") == depth).select("word", F.lit(depth).alias("pos"), F.substring("word", 1, depth).alias("node"), F.lit(0).alias("edits"))
        before = states
        now = starting if before is None else starting.unionByName(before.where(~F.col("found")).drop("found"))
        states = stored(next_level(now, edges.where(F.col("depth") == depth).drop("depth")), f"states-{depth}")
        found.append(stored(states.where("found").select(own("word").alias("word"), own("node").alias("near")), "neighbours"))
        if before is not None:
            discard(before)
    discard(marked, edges)
    out = words.select("word", F.col("word").alias("near")).where(F.lit(False))
    for part in found:
        out = out.unionByName(part)
    return out


def own(marked: str) -> Column:
    """A marked word as it was."""
    rest = F.substring(marked, F.lit(2), F.length(marked))
    return F.when(F.startswith(marked, F.lit(">")), rest).otherwise(F.reverse(rest))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def deletion_pairs(words: DataFrame) -> DataFrame:
    """(word, near) in both directions among long words, by the polynomial hash of each word without one of its letters."""
    multiplier = np.uint64(0x9E3779B97F4A7C15)

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = np.uint64(pow(int(multiplier), -1, 1 << 64))
        for batch in batches:
            for row, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                letters = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                weights = np.full(len(letters), multiplier, dtype=np.uint64)
                weights[0] = 1
                sums = np.r_[np.uint64(0), np.cumsum(letters * np.cumprod(weights))]
                less = sums[:-1] + (sums[-1] - sums[1:]) * back
                first = np.r_[True, letters[1:] != letters[:-1]]
                at = np.flatnonzero(first)
                hashes = np.r_[sums[-1:], less[at]].view(np.int64)
                places, sizes = np.r_[-1, at], np.r_[len(letters), np.full(len(at), len(letters) - 1)]
                yield pa.record_batch([pa.array(np.full(len(hashes), row, dtype=np.int64)), pa.array(hashes), pa.array(sizes.astype(np.int64)), pa.array(places.astype(np.int64))],
                                      names=["row", "hash", "size", "at"])

    def checked(cols: dict[str, pa.Array], texts: list[str]) -> pa.RecordBatch:
        near = cols["near"].to_pylist()
        good = [i for i, (a, b) in enumerate(zip(texts, near)) if one_edit(a, b)]
        return pa.record_batch([pa.array([texts[i] for i in good], pa.string()), pa.array([near[i] for i in good], pa.string())], names=["word", "near"])

    named = stored(words.select(F.monotonically_increasing_id().alias("row"), "word"), "long-words")
    keys = stored(named.mapInArrow(shortened, "row long, hash long, size long, at long"), "long-keys")
    other = keys.select(F.col("row").alias("near_row"), "hash", "size", F.col("at").alias("near_at"))
    cut = keys.where("at >= 0")
    # runs of equal letters are cut at their first letter, so a replacement may be cut at unlike places: the hash alone joins them
    replaced = cut.join(other.where("near_at >= 0"), ["hash", "size"]).where("row <> near_row").select("row", "near_row")
    inserted = cut.join(other.where("near_at < 0"), ["hash", "size"]).select("row", "near_row")
    pairs = replaced.unionByName(inserted).unionByName(inserted.select(F.col("near_row").alias("row"), F.col("row").alias("near_row"))).distinct()
    near = named.select(F.col("row").alias("near_row"), F.col("word").alias("near"))
    return pairs.join(named, "row").join(near, "near_row").select("word", "near").mapInArrow(per_chunk(checked, "word"), "word string, near string")


def neighbours(words: DataFrame, least: int = LEAST_LETTERS, longest: int = LONGEST) -> DataFrame:
    """(word, near): every ordered pair of words that one edit turns into each other, once."""
    size = F.length("word")
    pairs = frontier_pairs(words.where(size <= longest), least, longest)
    long = words.where(size >= longest)
    if not long.isEmpty():
        pairs = pairs.unionByName(deletion_pairs(long))
    return pairs.distinct()


def group(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, damaged: int = DAMAGED, longest: int = LONGEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``least`` letters that occurs ``least_count`` times.

    Of several near words of the largest count the first in code-point order is taken; no words give no rows.
    """
    words = stored(word_counts(docs, least, least_count, damaged), "words")
    pairs = neighbours(words.select("word"), least, longest)
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    summed = pairs.join(counts, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near_n = -F.col("best.less")
    strong = near_n >= times * F.col("n")
    forms = stored(words.join(summed, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                   F.when(strong, F.col("best.near")).alias("form"), F.when(strong, near_n).alias("form_n")), "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by following twice as many forms in every round."""
    up = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stored(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return up
