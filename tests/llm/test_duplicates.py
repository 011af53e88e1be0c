import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import forest, suffixes
from tidemark.llm.graphs import components
from tidemark.llm.merging import Run, common_prefix, front_coded, merged


@given(st.lists(st.lists(st.text("ab", min_size=5, max_size=5), min_size=1, max_size=9), min_size=1, max_size=7))
@settings(max_examples=150, deadline=None)
def test_merge_is_sorted_and_knows_prefixes(lists):
    rows = [sorted(x.encode() for x in r) for r in lists]
    runs = []
    for r in rows:
        m = np.frombuffer(b"".join(r), dtype="u1").reshape(-1, 5)
        p = common_prefix(m)
        runs.append(Run(front_coded(m, p), p, 5))
    which, at, prefix = merged(runs, 5)
    got = [rows[a][b] for a, b in zip(which, at)]
    assert got == sorted(sum(rows, []))
    assert prefix[1:] == common_prefix(np.frombuffer(b"".join(got), dtype="u1").reshape(-1, 5)).tolist()[1:]


def _brute(texts, width):
    counts = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - width + 1):
            if counts[t[i:i + width]] > 1:
                gone[i:i + width] = True
        kept = np.frombuffer(t, dtype="u1")[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_removal_equals_brute_force(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [some(n) for n in (200, 201, 230, 400, 900)]
    texts = []
    for _ in range(120):
        p = rng.choice(passages)
        texts.append(some(rng.randint(0, 300)) + p[rng.randint(0, 60):len(p) - rng.randint(0, 60)] + some(rng.randint(0, 200)) + rng.choice(passages))
    texts += ["x" * 500, "x" * 199, "ab" * 300, "\x00" * 260 + "y" * 260, "\x00" * 260 + "z" * 10, None, "", "é" * 150, "é" * 150]
    got = suffixes.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    want = _brute([(t or "").encode() for t in texts], 200)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(want))


@pytest.mark.parametrize("block", [512, 7])
def test_links_equal_brute_force(spark, monkeypatch, block):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(2, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(words) for _ in range(50)) for _ in range(20)] + [texts[0], texts[0], "two words", "two words", "two  words", "", None]
    got = forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).collect()
    shingler = forest.Shingler()
    different = sorted({t or "" for t in texts})
    links = forest.linked([shingler.shingles(t) for t in different], 0.8)
    for a, b in ((0, 1), (5, 9), (20, 40)):
        x, y = (set(shingler.shingles(different[k]).tolist()) for k in (a, b))
        assert links[a, b] == (len(x & y) >= 0.8 * len(x | y) and bool(x & y))
    count = dict(zip(different, links.sum(axis=1)))
    head = dict(zip(different, forest._heads(links)))
    assert {r["doc_id"]: r["n_links"] for r in got} == {k: count[t or ""] for k, t in enumerate(texts)}
    pairs = {(bytes(r["class_key"]), int(head[texts[r["doc_id"]] or ""])) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_target_recall_sets_the_prefix():
    d = forest.depth()
    assert 1 - (1 - 0.8 ** d) ** forest.TREES >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** forest.TREES


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (200, 201)], "a long, b long")
    got = {r["node"]: r["head"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 200: 200, 201: 200}


def test_prefixes_take_little_memory():
    rows = np.sort(np.random.default_rng(3).integers(0, 2, (40_000, 12), dtype=np.uint8).view("V12")[:, 0]).view(np.uint8).reshape(-1, 12)
    unlike = rows[1:] != rows[:-1]
    want = np.where(unlike.any(axis=1), unlike.argmax(axis=1), 12)
    assert common_prefix(rows).tolist() == [0, *want] == common_prefix(rows, 7).tolist()
    wide = np.zeros((40_000, 333), dtype=np.uint8)
    tracemalloc.start()
    try:
        assert (common_prefix(wide)[1:] == 333).all()
        assert tracemalloc.get_traced_memory()[1] < wide.nbytes / 3
    finally:
        tracemalloc.stop()
