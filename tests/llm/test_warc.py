import base64
import hashlib

import frames
import zstandard

from reachlens.llm import warc
from reachlens.session import scratch_path

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    payloads = {}
    for page, _, html in rows:
        if page is not None:
            raw = (html or "").encode()
            payloads[raw] = min(payloads.get(raw, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = payloads.get(raw)
        again = len(raw) >= least and first is not None and page != first
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def result(df, rule=warc.Archive()):
    return sorted((tuple(r)[:5] for r in warc.round_trip(df, rule).collect()), key=str)


def test_whole_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    back = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert result(pages) == brute(rows)
    for page, url, html in rows:
        assert back[page].url == url
        assert back[page].payload == (None if back[page].record_type == "revisit" else (html or "").encode())


def test_odd_rows(spark):
    rows = [
        (3, "u", "same"), (1, "u", "same"), (2, None, "same"), (5, "u\r\nX: y", None), (4, "u", ""), (None, "u", "same"), (None, "u", "own"),
        (7, "u", "é\r\n\r\nWARC/1.1\r\n"), (8, "u", "P*M\x18\0\0\0\0" * 50), (9, "u", "long " * 200000), (1, "u", "same"),
    ]
    df = frames.with_clashes(spark.createDataFrame(rows, SCHEMA), "digest", "first", "size", "known", "payload", "of")
    assert result(df) == brute(rows)
    assert result(df, warc.Archive(least_bytes=5)) == brute(rows, 5)


def test_hot_payload_over_many_archives(spark):
    rows = [(i, f"u{i}", "x" * 500 if i % 3 == 0 else f"page {i} " * 40) for i in range(300)]
    assert result(spark.createDataFrame(rows, SCHEMA), warc.Archive(target_bytes=20_000, sample_bytes=4_000)) == brute(rows)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_layout_of_an_archive(spark):
    """A dictionary in a skippable frame first, then one frame a record; a plain reader can follow with the dictionary."""
    rows = [(i, f"http://h/{i}", f"<html><body><p>paragraph {i} of the page</p></body></html>" * 8) for i in range(400)]
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path)
    raw = spark.read.format("binaryFile").load(path).select("content").collect()
    raw = max((r.content for r in raw), key=len)
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
    size = int.from_bytes(raw[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    assert dictionary.dict_id()
    offset, content = next(iter(warc.frames(raw)))
    alone = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(raw[offset:])
    assert alone == content and content.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    header, http, payload = warc.parse(content)
    assert int(http["Content-Length"]) == len(payload) and header["WARC-Target-URI"].startswith("http://h/")
    assert len(list(warc.frames(raw))) == len(rows)
