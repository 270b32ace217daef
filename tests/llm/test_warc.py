import hashlib
import io

import pytest
import zstandard

from lodeseam.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, path string"
BIG, SAME = "é" * 600, "<p>text</p>" * 200
PAGES = [(1, "http://a/1", SAME), (2, "http://a/2\r\nX: y", SAME), (3, None, SAME), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", BIG), (9, "u", BIG), (None, "u", SAME), (10, "u", "x" * 999), (11, "u", "x" * 999)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_archive(spark, tmp_path):
    folder = str(tmp_path / "warc")
    manifest = warc.write(pages(spark), folder, archive_bytes=3000)
    assert manifest.count() > 1
    got = {r.page_id: r for r in warc.read(manifest, folder, payloads=True).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        data = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert r.payload == (b"" if r.record_type == "revisit" else data)
    assert {i: (got[i].record_type, got[i].refers_to) for i in (1, 2, None)} == dict.fromkeys((1, 2, None), ("revisit", 3))
    assert got[8].refers_to == 9 and all(got[i].record_type == "response" for i in (3, 4, 5, 6, 7, 9, 10, 11))
    assert got[2].url == "http://a/2 X: y" and got[3].url is None


def test_nothing(spark):
    assert warc.archive(pages(spark, [])).count() == 0


def records(n=300):
    return [warc.record(i, f"http://x/{i}", (f"<html>page {i} " + "common words of all pages " * 20).encode(), hashlib.sha1((f"<html>page {i} " + "common words of all pages " * 20).encode()).hexdigest(), None, False) for i in range(n)]


def test_dictionary_leads_and_helps():
    sink = io.BytesIO()
    made = records()
    assert warc.write_archive(sink, iter(made)) == 300
    data = sink.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    size = int.from_bytes(data[4:8], "little")
    assert list(warc.read_frames(io.BytesIO(data), 1000)) == made
    # the same with a compressed dictionary
    words = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    packed = warc.SKIPPABLE.to_bytes(4, "little") + len(words).to_bytes(4, "little") + words + data[8 + size :]
    assert list(warc.read_frames(io.BytesIO(packed))) == made
    assert len(data) - size < sum(len(zstandard.compress(x)) for x in made)


def test_damage_is_found():
    good = records(1)[0]
    headers, block = warc.parse(good)
    assert warc.payload_of(headers, block)[2].startswith(b"<html>page 0")
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/0.9"), good.replace(b"Content-Length: ", b"Content-Size: ", 1), b""):
        with pytest.raises(ValueError):
            warc.payload_of(*warc.parse(bad))
    with pytest.raises(ValueError):
        warc.payload_of(*warc.parse(good.replace(b"page 0", b"page 1")))
    sink = io.BytesIO()
    warc.write_archive(sink, iter(records(20)))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_frames(io.BytesIO(sink.getvalue()[:-5])))
    with pytest.raises(zstandard.ZstdError):
        data = bytearray(sink.getvalue())
        data[-8] ^= 255
        list(warc.read_frames(io.BytesIO(bytes(data))))
