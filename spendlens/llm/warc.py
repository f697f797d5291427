"""WARC archives: writer, and a sequential reader.

Each record is a gzip member of its own. The reader inflates member by member from a stream, takes the block by
its content length and verifies both digests. Payloads of at least `MIN_REVISIT` bytes that occur again are
revisit records, which keep the HTTP head and point to the response.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.files import attempt_name, create, new_folder, stream
from spendlens.llm.registry import query, table
from spendlens.session import cut_lineage

MIN_REVISIT = 100
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"  # fixed, so that archives are repeatable
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BrokenRecord(ValueError):
    """An archive that is cut short, or whose framing or digests do not hold."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def payload(self) -> bytes:
        """The block without its HTTP head."""
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def http(self) -> dict[str, str]:
        return _fields(self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:])


def _fields(lines: Iterable[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BrokenRecord(f"not a header: {line[:80]!r}")
        out[name.strip().lower().decode("utf-8")] = value.strip().decode("utf-8")
    return out


def encoded(headers: list[tuple[str, str]], block: bytes, level: int = 1) -> bytes:
    """One record as a gzip member."""
    head = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    text = "\r\n".join(head).encode() + b"\r\n\r\n"
    return b"".join([packer.compress(text), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()])


def _sha(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def members(source, chunk: int = CHUNK) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, inflated chunk by chunk."""
    waiting = b""
    while True:
        waiting = waiting or source.read(chunk)
        if not waiting:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not waiting:
                waiting = source.read(chunk)
                if not waiting:
                    raise BrokenRecord("the archive ends inside a member")
            try:
                parts.append(unpacker.decompress(waiting))
            except zlib.error as error:
                raise BrokenRecord(str(error)) from None
            waiting = unpacker.unused_data
        yield b"".join(parts)


def records(source, chunk: int = CHUNK) -> Iterator[Record]:
    """Verified records of an archive stream."""
    for data in members(source, chunk):
        head, gap, rest = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not gap or not lines[0].startswith(b"WARC/"):
            raise BrokenRecord("no record head")
        headers = _fields(lines[1:])
        length = headers.get("content-length", "")
        if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
            raise BrokenRecord("the block is not as long as stated")
        record = Record(headers, rest[: int(length)])
        if headers.get("warc-block-digest", _sha(record.block)) != _sha(record.block):
            raise BrokenRecord("the block's digest differs")
        if record.kind == "response" and headers.get("warc-payload-digest") != _sha(record.payload):
            raise BrokenRecord("the payload's digest differs")
        yield record


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    kind = "response" if refers_to is None else "revisit"
    block = http.encode() + (payload if refers_to is None else b"")
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        headers.append(("WARC-Target-URI", safe))
    if refers_to is not None:
        headers += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    headers += [
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", _sha(block)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return encoded(headers, block)


def _written(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        out, name, n, size = None, attempt_name(folder, "warc.gz"), 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    out = create(name)
                    info = encoded(
                        [
                            ("WARC-Type", "warcinfo"),
                            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                            ("WARC-Date", DATE),
                            ("Content-Type", "application/warc-fields"),
                        ],
                        b"format: WARC File Format 1.1\r\n",
                    )
                    out.write(info)
                    size += len(info)
                page, url, html, digest, refers = (c[i].as_py() for c in batch.columns)
                data = page_record(page, url, (html or "").encode(), digest, refers)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

    return run


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT
) -> DataFrame:
    """One archive per partition in the shared folder. Returns the list of archives: file, records, bytes.

    Of equal payloads of at least `min_revisit` bytes the rows of the least page_id (null last) are responses and
    the rest revisits. Null html is an empty payload; a null url leaves out the target. White space and control
    characters in a url are percent-encoded. An empty table gives no archives.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        payload.alias("html"),
        F.sha2(F.encode(payload, "UTF-8"), 256).alias("digest"),
    )
    large = F.octet_length("html") >= min_revisit
    # Only payloads with more than one id are joined; the smaller side is built per partition, pages stream by.
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    firsts = firsts.where("first != last").select(F.col("digest").alias("key"), "first")
    key = F.when(large, F.col("digest")).otherwise(F.concat_ws(":", F.lit("small"), "page_id", "url"))
    found = rows.withColumn("key", key).join(firsts.hint("shuffle_hash"), "key", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    rows = found.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    folder = new_folder(pages.sparkSession, "warc")
    return cut_lineage(rows.mapInArrow(_written(folder), "file string, records long, bytes long"))


def _read(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("refers_to", pa.int64()),
            ("html", pa.string()),
        ]
    )
    for batch in batches:
        for file in batch.column(0).to_pylist():
            rows, size = [], 0
            with stream(file) as source:
                for record in records(source):
                    if record.kind not in ("response", "revisit"):
                        continue
                    h = record.headers
                    rows.append(
                        {
                            "page_id": _page(h["warc-record-id"]),
                            "url": h.get("warc-target-uri"),
                            "record_type": record.kind,
                            "payload_bytes": int(record.http["content-length"]),
                            "payload_digest": h["warc-payload-digest"].removeprefix("sha256:"),
                            "refers_to": _page(h.get("warc-refers-to")),
                            "html": record.payload.decode("utf-8") if record.kind == "response" else None,
                        }
                    )
                    size += len(record.block)
                    if size > 16 * CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Records of the listed archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to, html
    (null for revisits). A record that does not hold fails the job."""
    # A stated number of partitions: by size alone adaptive execution would give all files to one task.
    files = archives.select("file").repartition(max(1, archives.count()), "file")
    return files.mapInArrow(
        _read,
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long,"
        " html string",
    )


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


@query("op2_warc_round_trip", SQL)
def op2_warc_round_trip(spark, sf):
    archives = write_archives(table(spark, sf, "pages"))
    read = read_archives(spark, archives)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
