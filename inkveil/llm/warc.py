"""Operator 3: WARC records in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, probable, scratch, table

#: Bytes of records in a frame, and of frames in a bundle, from which the next one is begun.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 24 << 20
#: Fixed values of the seekable format: skippable frames of the seek table and of the record index, and the footer's last four bytes.
SEEK_TABLE, RECORD_INDEX = 0x184D2A5E, 0x184D2A50
FOOTER = b"\xb1\xea\x92\x8f"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit record of an equal payload. The extension fields carry the ids of the table."""
    size = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    url = "".join(c for c in url or "" if c > " ")
    sha = digest(payload)
    name = lambda i: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{i} {sha}')}>"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(row_id), "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{sha}",
        "Content-Type": "application/http;msgtype=response", "Content-Length": len(block),
    }
    if row_id is not None:
        fields["X-Row-Id"] = row_id
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to), "X-Refers-To-Row-Id": refers_to}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Fields and block of the record at `at`, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    head = data[at:end].decode().split("\r\n")
    if head[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = {k: v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
    start, size = end + 4, int(fields["Content-Length"])
    return fields, data[start : start + size], start + size + 4


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Bundle:
    """Independent frames, then the index of record ids, then the seek table."""

    def __init__(self, level: int = 3):
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int]] = []  # record id, frame, offset in the frame's content
        self.open, self.size = bytearray(), 0

    def add(self, row_id: int | None, data: bytes) -> None:
        self.index.append(("" if row_id is None else str(row_id), len(self.frames), len(self.open)))
        self.open += data
        if len(self.open) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            frame = self.compressor.compress(bytes(self.open))
            self.frames.append(frame)
            self.table.append((len(frame), len(self.open)))
            self.size += len(frame)
            self.open = bytearray()

    def finish(self) -> bytes:
        self.flush()
        index = _skippable(RECORD_INDEX, self.compressor.compress(json.dumps(self.index).encode()))
        entries = [*self.table, (len(index), 0)]
        footer = b"".join(struct.pack("<II", *x) for x in entries) + struct.pack("<IB", len(entries), 0) + FOOTER
        return b"".join([*self.frames, index, _skippable(SEEK_TABLE, footer)])


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, content size) of each frame, from the footer alone."""
    n, _, magic = struct.unpack("<IB4s", bundle[-9:])
    if magic != FOOTER:
        raise ValueError("no seek table")
    sizes = np.frombuffer(bundle[-9 - 8 * n : -9], "<u4").reshape(-1, 2).astype(np.int64)
    return list(zip((np.cumsum(sizes[:, 0]) - sizes[:, 0]).tolist(), *sizes.T.tolist()))


def record_index(bundle: bytes) -> list[tuple[str, int, int]]:
    """(record id, frame, offset in the frame's content) of each record."""
    at, size, _ = seek_table(bundle)[-1]
    return [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(bundle[at + 8 : at + size]))]


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record, by decompressing its frame only."""
    at, size, _ = seek_table(bundle)[frame]
    return parse(zstandard.ZstdDecompressor().decompress(bundle[at : at + size]), offset)[:2]


def write_bundles(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = DATE) -> None:
    """Write a record for each row of `pages` to bundle files in the folder `path`.

    Of rows with equal payloads of at least `min_bytes` bytes, those with the smallest id are responses and the others
    revisit it. A null payload is empty; rows with a null id are responses; equal rows each get a record. A bundle is made of the rows
    of one partition as they come, so it needs memory for itself only. Spark's committer puts files in place, so a task
    that is run again leaves no second copy. Each file is one row of the text format: its last bytes, the format's line
    separator, are the last bytes of the seek table.
    """
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("p"))
    src = src.withColumn("sha", F.sha1(F.col("p").cast("binary")))
    slim = src.filter(F.octet_length("p") >= min_bytes).select("id", "sha")
    # written first, so that the join's partitions can be split where a payload, such as the empty one, is very common
    first = cut(slim.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "firsts")
    revisits = slim.join(first, "sha").filter("id > first").select("id", "sha", "first").distinct()

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = Bundle()
        for pdf in batches:
            for row_id, url, text, first in zip(pdf["id"].astype("Int64"), pdf["url"], pdf["p"], pdf["first"].astype("Int64")):
                row_id = None if pd.isna(row_id) else int(row_id)
                b.add(row_id, record(row_id, url, text.encode("utf-8", "replace"), None if pd.isna(first) else int(first), date))
                if b.size >= BUNDLE_BYTES:
                    yield pd.DataFrame({"value": [b.finish()[: -len(FOOTER)]]})
                    b = Bundle()
        if b.index:
            yield pd.DataFrame({"value": [b.finish()[: -len(FOOTER)]]})

    # most payloads can't be revisits, as a bitmap tells, and need no shuffle
    revisits = cut(revisits, "revisits")
    maybe = probable(src, "id", revisits).join(revisits, ["id", "sha"], "left").select("id", "url", "p", "first")
    others = probable(src, "id", revisits, absent=True).select("id", "url", "p", F.lit(None).cast("long").alias("first"))
    rows = others.unionByName(maybe).mapInPandas(bundle, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", FOOTER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Rows (row_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, bundle, frame, frame_offset) of the records of a folder of bundles.

    bundle, frame and frame_offset are the place by which read_record() finds the record again. Digests of responses are
    computed anew and must equal the ones written. A revisit's payload is null."""
    schema = "row_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, bundle string, frame int, frame_offset int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                data = bytes(data)
                for k, (at, size, content) in enumerate(seek_table(data)):
                    if not content:
                        continue
                    frame, offset, rows = zstandard.ZstdDecompressor().decompress(data[at : at + size]), 0, []
                    while offset < len(frame):
                        f, block, after = parse(frame, offset)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        revisit = f["WARC-Type"] == "revisit"
                        said = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and digest(payload) != said:
                            raise ValueError(f"payload of {f['WARC-Record-ID']} in {name} is damaged")
                        length = int(head.rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
                        rows.append((int(f["X-Row-Id"]) if "X-Row-Id" in f else None, f["WARC-Target-URI"], f["WARC-Type"], int(f["X-Refers-To-Row-Id"]) if revisit else None, length, said, None if revisit else payload, name, k, offset))
                        offset = after
                    out = pd.DataFrame(rows, columns=["row_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "bundle", "frame", "frame_offset"])
                    yield out.astype({"row_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").load(path)
    return files.filter(F.col("length") > 0).select("path", "content").mapInPandas(run, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_bundles(table(spark, sf_dir, "pages"), path)
    out = read_bundles(spark, path)
    return out.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: (((strpos('0123456789abcdef', substr(s, 1 + (i * 5 + j) // 4, 1)) - 1) // (1 << (3 - (i * 5 + j) % 4)::INT)) % 2) * (1 << (4 - j)::INT)))::BIGINT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > f THEN f END AS refers_to
FROM d
"""
