"""Both versions of the old format, round trips, revisits and damaged files."""

import gzip
import hashlib
import random

import pytest

from grainmill.llm import warc as w

SCHEMA = "page_id bigint, url string, html string"


def arc(version, records, name="old.arc"):
    out = w.version_block(version, name, "19970101000000")
    return out + b"".join(b"\n" + w.arc_record(version, u, p, k, "19970203040506") for u, p, k in records) + b"\n"


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_reading(version, packed):
    payloads = [b"", b"a\r\n\r\nb\n\nhttp://x/ 0.0.0.0 1 text/html 5\nWARC/1.0", "é".encode() * 5000, bytes(range(256))]
    content = arc(version, [(f"http://h/{i} x", p, i) for i, p in enumerate(payloads)])
    got = list(w.read_arc(gzip.compress(content) if packed else content))
    assert [w._http_parts(r["block"])[1] for r in got] == payloads
    assert [r["url"] for r in got] == [f"http://h/{i}%20x" for i in range(4)]
    assert all(len(r) == len(w.ARC_FIELDS[version]) + 1 for r in got)


def test_damage():
    good = arc(1, [("http://h/1", b"one", 1), ("http://h/2", b"two", 2)])
    assert len(list(w.read_arc(good.replace(b"http://h/1", b"\nbroken line\nhttp://h/1")))) == 2
    cut = list(w.read_arc(good[:-3]))
    assert len(cut) == 2 and w._http_parts(cut[1]["block"])[1] == b"t"
    assert list(w.read_arc(b"")) == [] and list(w.read_warc(b"")) == []


def test_dates():
    assert w.iso_date("19970203040506") == "1997-02-03T04:05:06Z" and w.iso_date("199702") == "1997-02-01T00:00:00Z"


def test_record_bytes():
    head = [("WARC-Record-ID", w.record_id("f", 1, "u")), ("WARC-Date", "2024-01-01T00:00:00Z")]
    blocks = [b"", b"x\r\n\r\ny", b"\xff\xfe"]
    content = b"".join(w.warc_record("response", head, b) + b"\r\n\r\n" for b in blocks)
    assert [b for _, b in w.read_warc(content)] == blocks
    assert w.record_id("f", 1, "u") != w.record_id("f", 2, "u")


def brute(rows):
    best = {}
    for k, _, h in rows:
        if k is not None:
            best[h or ""] = max(best.get(h or "", k), k)
    out = []
    for k, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= 1000 and k != best[h]
        out.append((k if k is not None else -1, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", best[h] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    bodies = [None, "", "short", "x" * 999, "y" * 1000, "zé\r\n\r\n" * 400, *("b" * rng.randrange(900, 1100) for _ in range(20))]
    rows = [(i, rng.choice([None, f"http://h/{i}", "no scheme", "http://a b\n/"]), rng.choice(bodies)) for i in range(80)]
    rows += [(80, "http://tie/", "y" * 1000), (80, "http://tie/", "y" * 1000), (None, "http://n/", "short")]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = w.round_trip(pages).collect()
    mine = sorted(((r.key if r.key is not None else -1, r.payload_bytes, r.payload_sha1, r.record_type, r.refers_to_key) for r in got), key=str)
    assert mine == brute(rows) and any(r.record_type == "revisit" for r in got)
    assert w.round_trip(pages.limit(0)).count() == 0


def test_files_and_other_versions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(arc(1, [("http://h/1", b"same" * 300, 1)]))
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(arc(2, [("http://h/2", b"same" * 300, 2), ("http://h/3", b"other", None)])))
    w.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r.url: r for r in w.warc_records(spark, str(tmp_path / "out")).collect()}
    assert got["http://h/1"].record_type == "revisit" and got["http://h/1"].refers_to == got["http://h/2"].record_id
    assert got["http://h/3"].date == "1997-02-03T04:05:06Z" and got["http://h/3"].key is None
    for f in (tmp_path / "out").glob("part*"):
        for h, block in w.read_warc(f.read_bytes()):
            assert h["content-length"] == str(len(block)) and h["warc-type"] in ("warcinfo", "response", "revisit")
            if "warc-block-digest" in h:
                assert h["warc-block-digest"] == w.sha1_label(hashlib.sha1(block).hexdigest())


def test_the_same_file_gives_the_same_bytes(spark, tmp_path):
    content = arc(1, [(f"http://h/{i}", b"same" * 300 if i % 3 else b"other", i) for i in range(9)])
    outs = []
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / "x.arc").write_bytes(content)
        w.convert(spark, str(tmp_path / k), str(tmp_path / f"out-{k}"))
        outs.append([gzip.decompress(f.read_bytes()) for f in (tmp_path / f"out-{k}").glob("part*")])
    assert outs[0] == outs[1] and b"WARC-Type: revisit" in outs[0][0]


def test_joining_by_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.arc").write_bytes(arc(1, [(f"http://h/{k}/{i}", b"same" * 300, 10 * k + i) for i in range(4)]))
    w.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), max_broadcast=0)
    got = w.warc_records(spark, str(tmp_path / "out")).collect()
    last = next(r.record_id for r in got if r.key == 23)
    assert len(got) == 12 and {r.key for r in got if r.record_type == "response"} == {23}
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {last}


def test_a_very_long_payload(spark):
    rows = [(1, "http://h/1", "long wörds " * 1_500_000), (2, "http://h/2", "long wörds " * 1_500_000)]
    got = {r.key: r for r in w.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].refers_to_key == 2 and got[1].payload_bytes == got[2].payload_bytes == 18_000_000
    assert got[2].payload_sha1 == hashlib.sha1(rows[0][2].encode()).hexdigest()
