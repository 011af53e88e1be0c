import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import grammar, packing
from tidemark.llm.tokens import Encoder, vocabulary
from tidemark.session import scratch

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ids(spark):
    tokenizer = Tokenizer.from_file(vocabulary())
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for r in rows}


def test_encoder_equals_library():
    encode, whole = Encoder(vocabulary()).encode, Tokenizer.from_file(vocabulary())
    for text in ["", " ", "a<|endoftext|>b", "É È x y\t\x1cz ǅ İstanbul don't I'm 's x.. a.b ß ª º", "日本語 テスト", "é café .,", "A'S b're $$$ x$$ 12 3.5\n\nend",
                 "word" * 3000]:
        assert np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() == encode(text)


def test_pieces_cover_documents_and_fill_sequences(spark, ids):
    got = packing.pack(spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3)).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for doc, parts in pieces.items():
        want, at = [*ids[doc], 2], 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at:at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    for parts in places.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == parts[0]["capacity"] and at & (at - 1) == 0 and at <= 4096


@given(st.lists(st.integers(1, 300), max_size=60))
@settings(max_examples=60, deadline=None)
def test_assign_is_complete_and_balanced(lengths):
    pieces, sizes, spent = packing.assign(lengths, capacity=64)
    used, held = Counter(), Counter()
    for d, _, n, s, _ in pieces:
        used[s] += n
        held[d] += n
    assert [held[d] for d in range(len(lengths))] == lengths and [used[s] for s in range(len(sizes))] == sizes


def test_cheapest_sequence_with_room_comes_first():
    pieces, sizes, _ = packing.assign([30, 30, 20, 20, 14, 14], capacity=64)
    assert sizes == [64, 64] and sorted(n for _, _, n, _, _ in pieces) == [14, 14, 20, 20, 30, 30]
    assert Counter(s for _, _, n, s, _ in pieces if n == 30) == {0: 1, 1: 1}


def test_shards_round_trip(spark, ids):
    path = scratch(spark, "test-shards")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    grammar.write(docs.repartition(4), path, shard_ids=40_000)
    got = {r["doc_id"]: r for r in grammar.read(spark, path).collect()}
    at = 0
    for doc in sorted(ids):
        raw = np.array([*ids[doc], 1], dtype="<u4").tobytes()
        r = got[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(raw) // 4, zlib.crc32(raw), raw)
        at += len(raw) // 4
    assert spark.read.parquet(path).selectExpr("max(octet_length(rules))").first()[0] > 0


@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=80), min_size=1, max_size=12))
@settings(max_examples=80, deadline=None)
def test_grammar_expands_to_its_ids(docs):
    flat, starts = np.concatenate(docs).astype(np.uint32), np.cumsum([0, *map(len, docs)])[:-1]
    rules, symbols, firsts = grammar.compress(flat, starts, base=6, least=2, pairs=3)
    assert (rules.expand(symbols) == flat).all()
    ends = [*firsts[1:], len(symbols)]
    for d, a, b in zip(docs, firsts, ends):
        assert (rules.expand(symbols[a:b]) == d).all()
        for start in range(len(d)):
            n = min(3, len(d) - start)
            assert (rules.span(symbols[a:b], start, n) == d[start:start + n]).all()


def test_no_frequent_pair_is_left_and_kept_pieces_change_nothing():
    rng = np.random.default_rng(3)
    ids, starts = rng.choice(40, size=5_000, p=np.arange(1, 41)[::-1] / 820).astype("<u4"), np.arange(0, 5_000, 50)
    rules, symbols, firsts = grammar.compress(ids, starts, base=40, least=5, pairs=7)
    pairs = Counter()
    for a, b in zip(firsts, [*firsts[1:], len(symbols)]):
        part = symbols[a:b].tolist()
        pairs.update(zip(part, part[1:]))
    # a run of equal symbols counts each pair once per place it can be replaced at
    assert all(n < 5 or a == b for (a, b), n in pairs.items()) and (rules.expand(symbols) == ids).all() and len(rules.rules) > 20
    texts = [" ".join(f"w{k % 37}{k % 11}" for k in range(n, n + 60)) for n in range(30)]
    wide, narrow = Encoder(vocabulary()), Encoder(vocabulary(), 4)
    assert [wide.encode(t) for t in texts] == [narrow.encode(t) for t in texts]
