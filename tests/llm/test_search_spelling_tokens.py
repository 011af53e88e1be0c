"""Ranked search, spelling variants and token counts against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import resync, signatures, spellings
from tidemark.llm.tokens import vocabulary
from .conftest import DOCS

ITEMS = "item_id long, text string"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return text.encode().lower().decode()


def plain_search(docs, items, top=10):
    """(item, rank, doc, score) with documents as a list of (doc_id, text)."""
    held = [(d, Counter(TERM.findall(lowered(t or "")))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        terms = set(TERM.findall(lowered(text or "")))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in held) + 1))) for t in terms}
        rows = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, k, row[3], -row[0]) for k, row in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_equals_plain_scores(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Éa", "éa", "x-y", "Q_q", "数字", "a1"]
    docs = [(k, " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.choice([1, 3, 30, 400])))) for k in range(300)]
    docs += [(k + 1000, docs[7][1]) for k in range(40)] + [(2000, None), (2001, ""), (2002, " .,- "), (None, "w59 w58"), (7, "w3 w3 w3")]
    items = [(k, " ".join(rng.sample(words, 8))) for k in range(30)] + [(90, None), (91, "nowhere"), (92, "w59 W59 w58"), (93, "")]
    got = signatures.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, ITEMS))
    assert found(got) == plain_search(docs, items)


def test_search_in_item_blocks_and_crowded_signatures(spark, monkeypatch):
    """Small signatures with many false positives, and a block per few items, change nothing."""
    rng = random.Random(6)
    docs = [(k, " ".join(f"t{rng.randrange(400)}" for _ in range(rng.choice([5, 90])))) for k in range(200)]
    items = [(k, " ".join(f"t{rng.randrange(400)}" for _ in range(12))) for k in range(20)]
    want = plain_search(docs, items, 3)
    monkeypatch.setattr(signatures, "PAIRS", 60)
    data = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    assert found(signatures.search(*data, top=3)) == want


def test_bounds_never_fall_below_scores(monkeypatch):
    import numpy as np
    from pyspark.sql import Row
    monkeypatch.setattr(signatures, "BITS_PER_ENTRY", 1)
    rng = random.Random(8)
    texts = [" ".join(f"t{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.choice([2, 40, 300]))) for _ in range(120)]
    rows = [Row(item_id=i, term=f"t{t}".encode(), w=rng.randrange(9000)) for i in range(6) for t in rng.sample(range(90), 15)]
    items = signatures.Items(rows, len(texts), sum(len(t.split()) for t in texts))
    bounds = np.zeros((6, 120), dtype=np.int64)
    for d, text in enumerate(texts):
        counts = Counter(text.split())
        entries = np.concatenate([signatures.at_level(signatures.hashes(np.array([t.encode() for t, n in counts.items() if n >= level], dtype=object)), level) for level in signatures.LEVELS])
        width = 64
        bits = np.zeros((width, 1), dtype=np.uint8)
        bits[signatures.places(entries, width).ravel(), 0] = 1
        for i, total in items.bounds(width, np.array([sum(counts.values())]), np.packbits(bits, axis=1).tobytes()):
            bounds[i, d] = total[0]
    scores = np.array([items.score(t, list(range(6))) for t in texts]).T
    assert (bounds >= scores).all() and scores.max() > 0


def test_search_of_nothing(spark, no_docs, odd_docs, clashing):
    items = spark.createDataFrame([(1, "seven words"), (None, "text")], ITEMS)
    assert signatures.search(no_docs, items).count() == 0
    assert signatures.search(odd_docs, items.where("false")).count() == 0
    want = plain_search([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [(1, "seven words"), (None, "text")])
    extra = items.withColumn("rank", F.lit("mine")).withColumn("part", F.lit(1))
    assert found(signatures.search(odd_docs, items)) == want == found(signatures.search(clashing, extra))


def plain_words(docs, least=6, least_count=5, damaged=199):
    total = Counter()
    for d, text in docs:
        for run, n in Counter(re.findall("[a-zÀ-ÿ]+", lowered(text or ""))).items():
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if not h % damaged:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += n
    return {w: n for w, n in total.items() if len(w) >= least and n >= least_count}


def edit_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_group(docs, times=5, **kw):
    words = plain_words(docs, **kw)
    near = {w: [x for x in words if edit_one(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def grouped(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def misspelt(rng, word, letters):
    at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    return word[:at] + rng.choice(letters) * (kind > 0) + word[at + (kind < 2):]


def spelling_docs(seed, letters="abÀé", sizes=(5, 6, 7, 9)):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.choice(sizes))) for _ in range(25)]
    words = base + [misspelt(rng, w, letters) for w in base for _ in range(4)] + ["aaaaaa", "aaaaaaa", "aabaaa"]
    docs = []
    for k in range(60):
        picked = rng.choices(words, weights=[30 / (1 + i) for i in range(len(words))], k=120)
        docs.append((k, " ".join(w.upper() if rng.random() < 0.2 else w for w in picked)))
    return docs + [(None, "aaaaaa " * 9), (None, None), (3, ""), (3, "aaaaaa\naaaaaa1aaaaaa×÷ aaaaaaß"), (4, docs[0][1])]


@pytest.mark.parametrize("seed,longest", [(1, 48), (2, 48), (3, 7), (4, 6)])
def test_spellings_equal_plain_pairs(spark, seed, longest):
    """Also with words of 7 or 6 letters already paired by their deletions."""
    docs = spelling_docs(seed)
    got = spellings.group(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), longest=longest, damaged=11)
    want = plain_group(docs, damaged=11)
    assert len(want) > 40 and any(r[1] for r in want) and grouped(got) == want


def test_very_long_words(spark):
    long = "".join(random.Random(9).choices("abcdefg", k=20_000))
    texts = [long] * 30 + [long[:500] + "z" + long[501:]] * 5 + [long[:9_000] + long[9_001:]] * 5 + [long + "q"] * 5 + [long[::-1]] * 5
    docs = [(k, t) for k, t in enumerate(texts)]
    got = spellings.group(spark.createDataFrame(docs, "doc_id long, text string"))
    want = {w: n for w, n in plain_words(docs).items()}
    rows = {r["word"]: r for r in got.collect()}
    assert set(rows) == set(want) and all(rows[w]["n"] == n for w, n in want.items())
    assert rows[long]["n_near"] == sum(edit_one(long, w) for w in want) >= 2 and rows[long]["form"] is None
    assert rows[long + "q"]["root"] == long if want.get(long + "q") else True


def test_chains_of_forms_end_at_their_root(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}" if k < 26 else None) for k in range(27)], "word string, form string")
    assert {r["root"] for r in spellings.roots(forms).collect()} == {"w26"}


def test_spellings_of_nothing(spark, no_docs, odd_docs, clashing):
    assert spellings.group(no_docs).count() == 0
    want = plain_group([(r["doc_id"], r["text"]) for r in odd_docs.collect()], least_count=1)
    assert grouped(spellings.group(odd_docs, least_count=1)) == want == grouped(spellings.group(clashing, least_count=1))


def plain_tokens(texts):
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return [len(tool.encode(t or "", add_special_tokens=False)) for t in texts]


def huge_texts():
    rng = random.Random(4)
    pieces = ["word", " word", "  two", "\n\n", " don't", "'s", "'re", "n't ", " 1234", "<|endoftext|>", " <|endoftext|>", "<|endof", "text|>", "  ", "\t", "é", " Ünï", "数字", "…", " ", " x", "!?", " 'll", "🙂", "\r\n", "\x1c"]
    mixed = ["".join(rng.choices(pieces, k=rng.choice([50, 400, 900]))) for _ in range(40)]
    runs = ["x" * 3000, " " * 2500 + "end", "a b " * 300 + "y" * 1500 + " c d" * 300 + "z" * 2000, "\n" * 1000 + " 7" * 900, "'" * 1200 + "re" * 500, "<|endoftext|>" * 200, "ab" * 200 + " " * 400 + "cd" * 300]
    return mixed + runs + ["", None, " ", "short text"]


@pytest.mark.parametrize("chunk,overlap", [(64, 17), (100, 40), (257, 256), (16_384, 256)])
def test_token_counts_equal_the_library(spark, chunk, overlap):
    texts = huge_texts()
    df = spark.createDataFrame([(k % 20 or None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = resync.count(df, vocabulary("byte_bpe_50k.json"), limit=100, chunk=chunk, overlap=overlap).collect()
    ids = [k % 20 or None for k in range(len(texts))]
    want = sorted(((i, len((t or "").encode()), n, n > 100) for i, t, n in zip(ids, texts, plain_tokens(texts))), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_overlaps_are_widened_where_no_place_is_shared(spark):
    """One run of letters over many chunks between ordinary words."""
    text = "some words here " * 20 + "q" * 5000 + " and some words there" * 20
    df = spark.createDataFrame([(1, text), (2, text + text)], "doc_id long, text string")
    texts = resync.text_rows(df, "doc_id").withColumn("n_bytes", F.octet_length("text").cast("long"))
    base = resync.stored(resync.chunks(texts, "bigint", 128, 32), "t")
    marks = resync.stored(resync.encoded(base.withColumn("a", F.col("k")).withColumn("b", F.col("k") + 1), vocabulary("byte_bpe_50k.json"), 128, 32), "m")
    assert resync.seams(marks).where("common IS NULL").count() > 30
    got = resync.spliced(texts, vocabulary("byte_bpe_50k.json"), "bigint", 128, 32).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == plain_tokens([text, text + text])


def test_token_counts_of_odd_tables(spark, no_docs, odd_docs, clashing):
    path = vocabulary("byte_bpe_50k.json")
    assert resync.count(no_docs, path).count() == 0
    rows = odd_docs.collect()
    want = sorted(((r["doc_id"], n) for r, n in zip(rows, plain_tokens([r["text"] for r in rows]))), key=repr)
    for docs in (odd_docs, clashing):
        assert sorted(((r["doc_id"], r["n_tokens"]) for r in resync.count(docs, path).collect()), key=repr) == want
    with pytest.raises(ValueError):
        resync.require_stateless(open(vocabulary("word_bpe_49k.json")).read())


def test_search_spelling_and_tokens_are_typed(spark):
    docs = spark.createDataFrame([(1, "one two three")], DOCS.split(", lang")[0])
    assert dict(signatures.search(docs, spark.createDataFrame([(1, "two")], ITEMS)).dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert dict(resync.count(docs, vocabulary("byte_bpe_50k.json")).dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
