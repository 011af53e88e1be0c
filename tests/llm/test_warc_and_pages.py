import gzip

import numpy as np
import pytest

from tidemark.llm import extraction, warc
from tidemark.session import scratch

PAGES = "page_id long, url string, html string, payload string"


def _payloads(found):
    return [g["payload"] for g in found if g["kind"] == "record" and g["head"].get("warc-type") == "response"]


def _archive(n, packed):
    raw = [warc.record(str(k), f"http://x/{k}", f"<p>page {k}</p>".encode() * 20, warc.digest(f"<p>page {k}</p>".encode() * 20), None) for k in range(n)]
    return [gzip.compress(r, mtime=0) if packed else r for r in raw]


@pytest.mark.parametrize("packed", [True, False])
def test_later_records_survive_damage(packed):
    parts = _archive(6, packed)
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = b"".join([parts[0], parts[1], bytes(broken), parts[3], b"garbage", parts[4], parts[5][:-30]])
    got = list(warc.salvage(data))
    assert len(_payloads(got)) == 4
    gaps = [(g["start"], g["end"]) for g in got if g["kind"] == "gap"]
    assert len(gaps) == 3 and gaps[0] == (len(parts[0]) + len(parts[1]), len(parts[0]) + len(parts[1]) + len(broken)) and gaps[-1][1] == len(data)
    covered = sorted({(g["start"], g["end"]) for g in got})
    assert covered[0][0] == 0 and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    assert list(warc.salvage(b"")) == [] and [g["kind"] for g in warc.salvage(b"junk")] == ["gap"]


def test_good_records_of_a_damaged_member_survive():
    raw = _archive(6, False)
    names = lambda data: [g["head"]["warc-record-id"][10:-1] for g in warc.salvage(data) if g["kind"] == "record"]
    gaps = lambda data: [g["reason"] for g in warc.salvage(data) if g["kind"] == "gap"]
    bad = raw[2].replace(b"<p>page 2</p>", b"<p>page X</p>", 1)
    inner = gzip.compress(b"".join([*raw[:2], bad, *raw[3:]]), mtime=0)
    assert names(inner) == ["0", "1", "3", "4", "5"] and len(gaps(inner)) == 1
    assert f"from byte {len(raw[0] + raw[1])} to {len(raw[0] + raw[1] + bad)}" in gaps(inner)[0]
    first = gzip.compress(bad + raw[3], mtime=0)
    assert names(b"junk" + first) == ["3"]
    whole = gzip.compress(b"".join(raw), 0, mtime=0)  # stored, so that a cut leaves whole records
    cut = whole[:len(whole) // 2]
    assert names(cut) == ["0", "1"] and gaps(cut)
    crc = whole[:-8] + bytes(4) + whole[-4:]
    assert names(crc + gzip.compress(raw[1], mtime=0)) == ["0", "1", "2", "3", "4", "5", "1"] and len(gaps(crc)) == 1


def test_equal_payloads_are_stored_once(spark):
    rows = [(3, "u3", "same", "x"), (9, "u9", "same", "x"), (5, None, "same", "x"), (4, "a\r\nb", "other\r\n\r\nWARC/1.1\r\n", "x"), (6, "u", None, None), (7, "u", "", "x"),
            (8, "long", "é" * 300_000, "x"), (None, "n", "same", "x")]
    path = scratch(spark, "test-warc")
    warc.write(spark.createDataFrame(rows, PAGES), path)
    got = warc.read(spark, path).collect()
    assert not [r for r in got if r["kind"] == "gap"]
    found = {r["record_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got}
    assert len(got) == len(rows)
    same, empty = warc.digest(b"same"), warc.digest(b"")
    assert found["9"] == ("response", None, 4, same) and found["3"] == found["5"] == found[""] == ("revisit", "9", 4, same)
    assert found["7"] == ("response", None, 0, empty) and found["6"] == ("revisit", "7", 0, empty)
    assert found["8"][2] == 600_000 and found["4"][0] == "response"
    none = scratch(spark, "test-no-warc")
    warc.write(spark.createDataFrame([], PAGES), none)
    assert warc.read(spark, none).count() == 0


def test_inflating_does_not_read_the_rest_for_every_member(monkeypatch):
    parts = _archive(300, True)
    data, fed, inflater = b"".join(parts), [], warc.zlib.decompressobj

    class Counted:
        def __init__(self, wbits):
            self.own = inflater(wbits)

        def decompress(self, piece):
            fed.append(len(piece))
            return self.own.decompress(piece)

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    assert len(_payloads(warc.salvage(data))) == 300
    assert sum(fed) <= len(data) + 300 * 8192 < 300 * len(data) / 4


@pytest.mark.parametrize("size", [1, 7, 300, 1 << 30])
def test_any_pieces_give_the_same_records(monkeypatch, size):
    parts = _archive(6, True)
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    for data in (b"".join(parts), b"".join([parts[0], bytes(broken), warc.EMPTY_MEMBER, parts[3], b"garbage", parts[4], parts[5][:-30]]), parts[0][:-8] + bytes(8) + parts[1]):
        want = list(warc.salvage(data))
        with monkeypatch.context() as patch:
            patch.setattr(warc, "PIECE_BYTES", size)
            assert list(warc.salvage(data)) == want


def test_payloads_stay_where_they_are_read(spark):
    rows = [(3, "u3", "same", "x"), (9, "u9", "same", "x"), (None, "n", "same", "x"), (4, "u4", "other", "x")]
    pages = warc.hashed(spark.createDataFrame(rows, PAGES))
    got = warc.resolved(pages, warc.repeated(pages))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "Sort" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["page_id"]: (r["refers_to"], r["payload"], r["payload_bytes"]) for r in got.collect()} == {
        3: (9, None, 4), 9: (None, b"same", 4), None: (9, None, 4), 4: (None, b"other", 5)}


def test_many_groups_and_no_payloads_give_the_same_records(spark, monkeypatch):
    rows = [(k, f"u{k}", f"<p>{k % 7}</p>" if k % 3 else f"<p>page {k}</p>", "x") for k in range(60)] + [(None, None, "<p>1</p>", None)]
    pages, found = spark.createDataFrame(rows, PAGES), []
    for most in (warc.BROADCAST_PAYLOADS, 0):
        monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", most)
        path = scratch(spark, "test-warc")
        warc.write(pages, path)
        whole, bare = warc.read(spark, path), warc.read(spark, path, payloads=False)
        assert bare.columns == whole.columns[:-1] and sorted(bare.collect(), key=str) == sorted(whole.drop("payload").collect(), key=str)
        found.append(sorted((tuple(r) for r in whole.drop("path", "start", "end").collect()), key=str))
    assert found[0] == found[1] and len(found[0]) == 61 and sum(r[3] == "revisit" for r in found[0]) == 34


def test_blocks_of_untidy_markup():
    got = extraction.blocks('<div class="a b">one &amp; two<br>three<p>four<p>five <b>six</b></div><script>x="</p>"</script><!-- no --><li>a<li>b &am')
    assert [b.text for b in got] == ["one & two three", "four", "five six", "a", "b &am"]
    assert got[0].path == ("div", ".a", ".b") and extraction.blocks("") == [] and extraction.blocks("<p") == []


@pytest.fixture(scope="module")
def model(spark):
    return extraction.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), 60)


def test_labels_of_other_page_shapes(spark, model):
    rng, right, total = np.random.default_rng(77), 0, 0
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        page = extraction.blocks(r["html"])
        y = extraction.own_labels(page)
        made = extraction.blocks(extraction.laid_out([b.text for b, k in zip(page, y) if k][:20], [b.text for b, k in zip(page, y) if not k], rng))
        want = np.array([extraction.MARK in b.text for b in made])
        for b in made:
            b.text = b.text.replace(extraction.MARK, "").strip() or "-"
        right += int(((model.forward([extraction.Describer().describe(made)])[0] >= 0.5) == want).sum())
        total += len(want)
    assert right >= 0.97 * total


def test_odd_pages(spark, model):
    rows = [(1, "u", None, None), (2, None, "", None), (None, "u", "<p></p>", "x"), (4, "u", "<script>only</script>", "x"), (4, "u", "<script>only</script>", "x")]
    got = extraction.extract(spark.createDataFrame(rows, PAGES), model).collect()
    assert len(got) == 5 and all(r["text"] == "" and r["n_chars"] == 0 for r in got)
    assert extraction.extract(spark.createDataFrame([], PAGES), model).count() == 0
    assert len(extraction.fit([]).forward([extraction.Describer().describe(extraction.blocks("<p>x</p>"))])[0]) == 1
