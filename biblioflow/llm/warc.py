"""WARC archives with dictionary compression: one Zstandard frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path, table

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame, as text. Spark's text writer puts it after each row, where every Zstandard reader skips it.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
#: What an archive's dictionary is built from (its first records, up to so many bytes), and the dictionary's size.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10
#: A partition rolls over to a new archive after so many bytes of records, or rows of Spark's writer (the dictionary is one).
ARCHIVE_BYTES, ARCHIVE_ROWS = 256 << 20, 16_384
BATCH = 256


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name(page_id) -> str:
    """A record's URI. Of an id of any type, what a header or the URI can't hold is percent-encoded; null has none."""
    return f"<urn:page:{'' if page_id is None else quote(str(page_id), safe=':')}>"


def record(page_id, url: str | None, payload: bytes, rep, date: str) -> bytes:
    """A response, or a revisit where `rep` names the record that has the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = rep is not None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisit:
        head += [("WARC-Refers-To", name(rep)), ("WARC-Profile", REVISIT_PROFILE)]
    body = http if revisit else http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def dictionary(samples: list[bytes]):
    """A trained dictionary, or where there is too little to train on, the samples themselves as one."""
    import zstandard

    if sum(map(len, samples)) >= 16 * DICTIONARY_BYTES and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _archive(level: int, date: str):
    """Frames of one archive a partition; the first row is the dictionary's frame."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for page_id, url, html, rep in zip(*batch.columns, strict=True):
                yield record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), rep.as_py(), date)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])
        source = records(batches)
        rest = next(source, None)
        while rest is not None:
            first, size = [rest], len(rest)
            rest = None
            while size < SAMPLE_BYTES and len(first) + 1 < ARCHIVE_ROWS and (r := next(source, None)) is not None:
                first.append(r)
                size += len(r)
            known = dictionary(first)
            pack = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True)
            raw = known.as_bytes()
            out, rows = [struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw], 1
            for r in chain(first, source):
                if rows > len(first) and (size >= ARCHIVE_BYTES or rows == ARCHIVE_ROWS):
                    rest = r  # begins the next archive
                    break
                out.append(pack.compress(r))
                rows += 1
                size += len(r) if rows > len(first) + 1 else 0
                if len(out) >= BATCH:
                    yield batch_of(out)
                    out = []
            if rest is not None:  # the writer begins a file after ARCHIVE_ROWS rows; an empty row is its separator alone, a skippable frame
                out += [b""] * (ARCHIVE_ROWS - rows)
            yield batch_of(out)

    return run


def write(pages: DataFrame, path: str, min_bytes: int = 0, level: int = 3, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes archives to the folder `path`, by Spark's own committer to any file system it knows: one per partition, or several where it holds more
    than ARCHIVE_BYTES of records, so that an archive stays small enough to be read by one task (but for a single larger page).

    Among records of equal payloads (SHA-1, and at least `min_bytes` long) the one of smallest id is the response and the others revisit it.
    Classes are pre-aggregated and only those of several records are joined back: a short list is broadcast by Spark's own size
    check and the payloads stay where they are; a long one has one row per key, so that hot payloads can be split.

    Null html is an empty payload; a null url is left out. Rows that repeat the smallest id of their class are all responses; a null id
    revisits a known one. Ids of any type are written so that no header is broken. An empty table writes no record. Other columns are not read.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    base = base.withColumn("key", F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha1("html"))))
    classes = table(base.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), "least"))
    joined = base.join(classes, F.col("key") == F.col("k"), "left")
    rep = F.when(~F.coalesce(F.col("id") == F.col("least"), F.lit(False)), F.col("least"))
    frames = joined.select("id", "url", "html", rep.alias("rep")).mapInArrow(_archive(level, date), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", ARCHIVE_ROWS).text(path)


def frames(data: bytes) -> Iterator[bytes]:
    """Decompressed frames of an archive, one by one."""
    import zstandard

    at, known, unpack, view = 0, None, zstandard.ZstdDecompressor(), memoryview(data)
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic >> 4 == 0x184D2A5:
            (size,) = struct.unpack_from("<I", data, at + 4)
            if magic == DICTIONARY_MAGIC and at == 0:
                known = zstandard.ZstdCompressionDict(data[8 : 8 + size])
                unpack = zstandard.ZstdDecompressor(dict_data=known)
            at += 8 + size
        elif magic == FRAME_MAGIC:
            one = unpack.decompressobj()
            got = [one.decompress(view[at : at + 65_536])]
            end = at + 65_536
            while not one.eof:
                if end >= len(data):
                    raise ValueError("an archive ends within a record")
                got.append(one.decompress(view[end : end + 65_536]))
                end += 65_536
            at = min(end, len(data)) - len(one.unused_data)
            yield b"".join(got)
        else:
            raise ValueError(f"unknown frame at byte {at}")


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Records of the archives in `path`: (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    A revisit has no payload of its own (null), but its length and digest. A response whose payload doesn't fit its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: unquote(x[len("<urn:page:") : -1]) or None if x else None

        def pack(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for batch in batches:
            for content in batch.column(0):
                rows = []
                for frame in frames(content.as_py()):
                    warc, http, payload = parse(frame)
                    stated, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
                    if kind == "response" and digest(payload) != stated:
                        raise ValueError(f"payload of {warc['WARC-Record-ID']} differs from its digest")
                    rows.append((number(warc["WARC-Record-ID"]), warc.get("WARC-Target-URI"), payload if kind == "response" else None, int(http["Content-Length"]), stated, kind, number(warc.get("WARC-Refers-To"))))
                    if len(rows) >= BATCH:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return found.select(F.col("id").cast(id_type).alias("page_id"), "url", "payload", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives `pages` in the shared folder and reads the archives back."""
    spark = pages.sparkSession
    path = new_path(spark, ".warc")
    write(pages, path, min_bytes)
    return read(spark, path, pages.schema["page_id"].dataType.simpleString())
