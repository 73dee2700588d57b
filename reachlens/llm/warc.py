"""WARC archives of raw pages, compressed record by record with a Zstandard dictionary of the archive.

An archive starts with a skippable frame that holds the dictionary, trained on the archive's own first records; every
record is a frame of its own, so it can be read alone from its offset. Archives are written by Spark's text writer,
so they go to any store that Spark reaches, a lost task is simply run again, and only committed files count. The
writer's line end is an empty skippable frame, which readers pass over.

Payloads are compared by their SHA-1. The page with the smallest id holds the payload in a response record, the others refer to
it in revisit records, which keep the HTTP header but not the payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlens.session import scratch_path

# Frame numbers of the Zstandard format and of dictionaries in WARC files.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
)


@dataclass(frozen=True)
class Archive:
    """``least_bytes``: smaller payloads are never revisits; ``target_bytes`` of payload per archive; dictionary size and
    the bytes of leading records it is trained on."""

    least_bytes: int = 0
    target_bytes: int = 32 << 20
    dictionary_bytes: int = 64 << 10
    sample_bytes: int = 4 << 20
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"


def bare_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five bytes are eight digits."""
    whole = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(whole, start, 10), 16, 32), 8, "0") for start in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _header(lines: list[tuple[str, str]], first: str = "WARC/1.1") -> bytes:
    """Header lines; line ends inside a value become blanks."""
    clean = [f"{name}: {' '.join(value.split())}" for name, value in lines]
    return "\r\n".join([first, *clean, "", ""]).encode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, revisit: bool, first: int | None, date: str) -> bytes:
    """A WARC record: an HTTP response header, and the payload unless it is a revisit."""
    block = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))], "HTTP/1.1 200 OK")
    block += b"" if revisit else payload or b""
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", url))
    if revisit:
        lines.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        lines.append(("WARC-Refers-To", _urn(first)))
    lines.append(("Content-Length", str(len(block))))
    return _header(lines) + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header of the record, header of the HTTP response, payload."""

    def fields(head: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _dictionary(samples: list[bytes], rule: Archive) -> bytes:
    """A trained dictionary; too few records can't train one, then they are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(rule.dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-rule.dictionary_bytes :]


def _write(rule: Archive):
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, compressor = [], 0, None

        def compressed(records: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([compressor.compress(r) for r in records], type=pa.binary())], names=["frame"])

        def start() -> pa.RecordBatch:
            nonlocal compressor
            raw = _dictionary(waiting, rule)
            kind = zstandard.DICT_TYPE_AUTO
            compressor = zstandard.ZstdCompressor(level=rule.level, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
            frame = struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
            return pa.RecordBatch.from_arrays([pa.array([frame], type=pa.binary())], names=["frame"])

        for batch in batches:
            part = []
            for page_id, url, payload, length, digest, revisit, first in zip(*(batch.column(i) for i in range(7))):
                body = payload.as_buffer().to_pybytes() if payload.is_valid else None
                part.append(record(page_id.as_py(), url.as_py(), body, length.as_py(), digest.as_py(), revisit.as_py(), first.as_py(), rule.date))
            if compressor is None:
                waiting += part
                size += sum(map(len, part))
                if size < rule.sample_bytes:
                    continue
                # Leading records up to the bound train the dictionary.
                part, waiting = waiting, _leading(waiting, rule.sample_bytes)
                yield start()
                waiting = []
            yield compressed(part)
        if compressor is None and waiting:
            part, waiting = waiting, _leading(waiting, rule.sample_bytes)
            yield start()
            yield compressed(part)

    return function


def _leading(records: list[bytes], most: int) -> list[bytes]:
    out, size = [], 0
    for raw in records:
        if out and size + len(raw) > most:
            break
        out.append(raw)
        size += len(raw)
    return out


def frames(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every record of an archive."""
    view, place, decompressor = memoryview(archive), 0, None
    while place < len(view):
        (magic,) = struct.unpack_from("<I", view, place)
        if magic in SKIPPABLE_FRAMES:
            (size,) = struct.unpack_from("<I", view, place + 4)
            if magic == DICTIONARY_FRAME and decompressor is None:
                raw = view[place + 8 : place + 8 + size].tobytes()
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            place += 8 + size
            continue
        reader, start, content = (decompressor or zstandard.ZstdDecompressor()).decompressobj(), place, []
        while not reader.eof:
            part = view[place : place + (1 << 16)]
            if not len(part):
                raise ValueError(f"the frame at {start} is cut off")
            content.append(reader.decompress(part))
            place += len(part)
        place -= len(reader.unused_data)
        yield start, b"".join(content)


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _read(with_payload: bool):
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for _, raw in frames(archive.as_buffer().to_pybytes()):
                    warc, http, payload = parse(raw)
                    digest, kind, refers = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"], None
                    if kind == "response":
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if own != digest or len(payload) != int(http["Content-Length"]):
                            raise ValueError(f"{warc['WARC-Record-ID']}: the payload isn't what its header says")
                    else:
                        refers = _page(warc["WARC-Refers-To"])
                    shown = payload if with_payload and kind == "response" else None
                    rows.append((_page(warc["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, refers, warc.get("WARC-Target-URI"), shown))
                    size += len(shown or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return function


def write_archives(
    pages: DataFrame, path: str, rule: Archive = Archive(), id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> None:
    """Write a record for every row of ``pages`` into archives under ``path``.

    A null payload is empty. Rows with the smallest id of a payload are responses, all of them if a row is
    repeated; null ids come last, and pages whose ids are all null are responses. Other columns are not read.
    """
    page_id, payload = F.col(id_column).cast("long"), F.encode(F.coalesce(F.col(html_column), F.lit("")), "UTF-8")
    rows = pages.select(page_id.alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", bare_digest(F.col("payload"))).withColumn("size", F.length("payload").cast("long"))
    narrow = rows.select("page_id", "digest", "size")
    first = narrow.where(F.col("size") >= rule.least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("each")
    )
    total = narrow.agg(F.sum("size"), F.count(F.lit(1))).first()
    archives = max(1, -(-((total[0] or 0) + 1024 * total[1]) // rule.target_bytes))
    # Who refers to whom, on ids and digests only; the payload is dealt out once, by page, whatever its copies.
    several = first.where("copies > 1").select("digest", "first")
    revisits = (
        narrow.select("page_id", "digest").distinct().join(several, "digest")
        .where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
        .withColumn("known", F.coalesce("page_id", F.lit(-1)))
        .select(F.col("digest").alias("of"), F.col("known").alias("page"), F.col("page_id").isNull().alias("no_id"), "first")
    )
    rows = rows.withColumn("known", F.coalesce("page_id", F.lit(-1))).repartition(archives, "digest", "known")
    revisits = revisits.repartition(archives, "of", "page")
    same = (F.col("digest") == F.col("of")) & (F.col("known") == F.col("page")) & (F.col("page_id").isNull() == F.col("no_id"))
    told = rows.join(revisits, same, "left").withColumn("revisit", F.col("of").isNotNull())
    records = told.select(
        "page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "size", "digest", "revisit", "first"
    )
    # The join may have made more partitions than asked for; they are put together without another shuffle.
    lines = records.coalesce(archives).mapInArrow(_write(rule), "frame binary").select(F.col("frame").cast("string").alias("value"))
    lines.write.option("lineSep", SEPARATOR.decode("ascii")).text(path)


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload`` of every record.

    The payload of a response is checked against its digest; revisits have none.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(with_payload), _READ)


def round_trip(pages: DataFrame, rule: Archive = Archive(), with_payload: bool = True) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, rule)
    return read_archives(spark, path, with_payload)
