"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

``write_archives`` stores one record per page, a repeated payload as a revisit of its first page's response.
``read_archives`` loads each file's dictionary, decodes frame by frame in bounded memory, and checks the version line,
required headers, block length, trailing lines and payload digest; a file that breaks any of these raises an error.

Null html is an empty payload. Payloads under 100 bytes are always responses. Rows without page_id are responses and
no other page refers to them; repeated rows of the smallest page_id are all responses; an empty table gives no rows;
columns beside page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import checkpointed, new_folder, open_new, open_old, text_bytes
from strideflow.llm.near_dup import BROADCAST_IDS, spread_join

#: The dictionary frame's magic number, a Zstandard frame's, and a dictionary's.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
LEAST_REVISIT = 100
ROTATE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), *(f"{k}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    uri = "".join(c for c in url or f"urn:page:{page_id}" if c > " ")
    headers = {"WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(size)}
    if page_id is not None:
        headers["X-Page-Id"] = str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers["Content-Type"] = "application/http; msgtype=response"
    if refers_to is None:
        return record("response", headers, http + payload)
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page": str(refers_to)}
    return record("revisit", headers, http)


class ArchiveWriter:
    def __init__(self, folder: str, dictionary: bytes):
        self.uri, self.stream = open_new(folder, ".warc.zst")
        self.bytes = self.records = 0
        if dictionary:
            self._put(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        self._put(self.packer.compress(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.bytes += len(raw)

    def add(self, raw: bytes) -> None:
        self._put(self.packer.compress(raw))
        self.records += 1

    def close(self) -> dict:
        self.stream.close()
        return {"path": [self.uri], "records": [self.records], "bytes": [self.bytes]}


class FrameReader:
    """The decoded frames of one archive, one at a time."""

    def __init__(self, file, chunk: int = 1 << 20):
        self.file, self.chunk, self.rest = file, chunk, b""
        self.dictionary = None

    def _need(self, n: int) -> bool:
        while len(self.rest) < n:
            more = self.file.read(self.chunk)
            if not more:
                return False
            self.rest += more
        return True

    def __iter__(self) -> Iterator[bytes]:
        first = True
        while self._need(4) or self.rest:
            if len(self.rest) < 4:
                raise ValueError("trailing bytes after the last frame")
            (magic,) = struct.unpack_from("<I", self.rest)
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                if not self._need(8) or not self._need(8 + (size := struct.unpack_from("<I", self.rest, 4)[0])):
                    raise ValueError("a skippable frame is cut short")
                body, self.rest = self.rest[8 : 8 + size], self.rest[8 + size :]
                if first and magic == SKIPPABLE:
                    self._load(body)
            elif magic == FRAME:
                yield self._frame()
            else:
                raise ValueError("not a Zstandard frame")
            first = False

    def _load(self, body: bytes) -> None:
        (magic,) = struct.unpack_from("<I", body) if len(body) >= 4 else (0,)
        if magic == FRAME:  # the dictionary itself may be compressed
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            (magic,) = struct.unpack_from("<I", body) if len(body) >= 4 else (0,)
        if magic != DICTIONARY:
            raise ValueError("the leading frame holds no dictionary")
        self.dictionary = zstandard.ZstdCompressionDict(body)

    def _frame(self) -> bytes:
        unpack = zstandard.ZstdDecompressor(dict_data=self.dictionary).decompressobj()
        out, raw = [], self.rest
        while True:
            out.append(unpack.decompress(raw))
            if unpack.eof:
                self.rest = unpack.unused_data
                return b"".join(out)
            raw = self.file.read(self.chunk)
            if not raw:
                raise ValueError("a frame is cut short")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, validated."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not mark or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise ValueError("a malformed header line")
        headers[name.decode("ascii").title().replace("Warc-", "WARC-").replace("-Id", "-ID")] = value.strip().decode("utf-8")
    if missing := [n for n in REQUIRED if n not in headers]:
        raise ValueError(f"headers are missing: {missing}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length is not its Content-Length")
    return headers, rest[:-4]


def checked(headers: dict[str, str], block: bytes) -> dict:
    """The row of a response or revisit; its payload's length and digest must be the stated ones."""
    size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].partition(":")[2]
    if headers["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload differs from its digest or length")
    page, target = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
    return {"page_id": None if page is None else int(page), "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": None if target is None else int(target)}


def train_dictionary(pages: DataFrame, samples: int = 300, most_bytes: int = 1 << 16, size: int = 1 << 15) -> bytes:
    """A dictionary from at most ``samples`` pages (smallest hash of page_id) of at most ``most_bytes`` each; empty if they are too few."""
    some = pages.where(F.octet_length("html").between(64, most_bytes)).select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id").limit(samples)
    raw = [r["html"].encode("utf-8") for r in some.select("html").toLocalIterator()]
    try:
        return zstandard.train_dictionary(size, raw, threads=0).as_bytes() if len(raw) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def revisits(rows: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages that revisit another; payloads aren't moved for it, and a frequent digest is spread."""
    large = rows.where(F.col("size") >= LEAST_REVISIT).withColumn("_spread", F.monotonically_increasing_id())
    first = checkpointed(large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"))
    both = spread_join(large, first, ["digest"], first.agg(F.sum("n")).first()[0] or 0, "_spread")
    return checkpointed(both.where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct())


def write_archives(pages: DataFrame, folder: str, dictionary: bytes = b"") -> DataFrame:
    """path, records, bytes of each archive written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    writer = writer or ArchiveWriter(folder, dictionary)
                    writer.add(page_record(row["page_id"], row["url"], row["digest"], row["size"], row["refers_to"], row["payload"]))
                    if writer.bytes >= ROTATE_BYTES:
                        yield pa.RecordBatch.from_pydict(writer.close())
                        writer = None
        if writer:
            yield pa.RecordBatch.from_pydict(writer.close())

    payload = text_bytes(pages["html"])
    url = pages["url"] if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    first = revisits(rows.select("page_id", "digest", "size"))
    few = first.count() <= BROADCAST_IDS  # some tens of MB as a hash relation; beyond that both sides are shuffled
    rows = rows.join(F.broadcast(first) if few else first, ["page_id", "digest"], "left")
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    return checkpointed(rows.select("page_id", "url", "payload", "digest", "size", "refers_to").mapInArrow(run, "path string, records long, bytes long"))


def read_archives(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page record."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_old(path) as file:
                    rows = []
                    for raw in FrameReader(file):
                        headers, block = parse(raw)
                        if headers["WARC-Type"] in ("response", "revisit"):
                            rows.append(checked(headers, block))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    parts = max(1, files.count())
    return files.select("path").repartition(parts).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages, new_folder(pages.sparkSession, "warc"), train_dictionary(pages)))


ORACLE_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, payload_bytes, p.payload_digest,
  CASE WHEN p.page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id <> first_page THEN first_page END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
