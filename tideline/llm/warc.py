"""WARC archives: an index first, then coalesced byte-range reads.

Writing gives one or more ``.warc.gz`` files per partition, each record its
own gzip member, and an index table with the file, offset, length, URL and
digest of every record. Reading takes any selection of index rows, sorts them
by file and offset, and fetches neighbouring ranges with one read.

Of records with equal payloads the one with the smallest id is a response and
the others revisit it. A task that is run again writes new files; the index
names only those of tasks that were committed, so leftovers are never read.

Cases: a null payload is empty; a null URL leaves out the target header; a
null id is never the response of a group that has an id, and a group of null
ids only are all responses; rows that repeat the smallest id are all
responses, so ties need no settling; very long payloads are one record each; an
empty table gives an empty index; other columns, whatever their names, are not
stored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.store import Files, bound_arrow, materialize, new_folder, shuffle_partitions, tidy

#: Bytes after which a new archive file is begun.
FILE_BYTES = 1 << 30
#: The widest gap that a read spans, and the most bytes of one read.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Rows of repeated digests up to which they are broadcast; beyond, the same join is by shuffle.
BROADCAST_ROWS = 500_000
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, is_revisit: bool = False, date: str = _DATE) -> bytes:
    """One uncompressed WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if is_revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""

    def fields(lines: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, _, v in pairs}

    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record at this place")
    warc = fields(head)
    size = int(warc["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def classify(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``html`` and ``first``: for a revisit the id that it refers to, else null."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("html"))
    digest = F.sha1(F.col("html"))
    repeated = rows.where(F.octet_length("html") >= least_bytes).select("page_id", digest.alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c"))
    repeated = materialize(repeated.where("c > 1").select("digest", "first"), "warc-repeated")
    few = repeated.count() <= BROADCAST_ROWS
    joined = rows.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, digest)).join(F.broadcast(repeated) if few else repeated, "digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all rows as WARC files; returns the stored index."""
    spark = pages.sparkSession
    bound_arrow(spark)
    folder = folder or new_folder(spark, "warc")
    rows = classify(pages, page_id, url, html, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        files, out, name, offset = Files(folder), None, "", 0
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string())])
        try:
            for batch in batches:
                index = []
                for number, link, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.write(name)
                    payload = text.encode("utf-8")
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record(number, link, payload, first, first is not None)) + packer.flush()
                    out.write(member)
                    index.append((name, offset, len(member), number, link, digest_of(payload), len(payload), "revisit" if first is not None else "response"))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*index, strict=True) if index else [[]] * len(schema), schema, strict=True)], schema=schema)
        finally:
            if out is not None:
                out.close()

    index = materialize(rows.mapInArrow(tidy(run), INDEX), "warc-index")
    index._tideline_archive = folder
    return index


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the selected index rows, read from the archives: figures from the record itself, and the payload on request."""
    wanted = index.select("file", "offset", "length")
    wanted = wanted.repartitionByRange(shuffle_partitions(index.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")

    def ranges(rows) -> Iterator[list[tuple[str, int, int]]]:
        """Neighbouring records in groups that one read covers."""
        group: list[tuple[str, int, int]] = []
        for name, offset, length in rows:
            if group and (name != group[0][0] or offset > group[-1][1] + group[-1][2] + GAP_BYTES or offset + length - group[0][1] > READ_BYTES):
                yield group
                group = []
            group.append((name, offset, length))
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name, source = Files(folder), None, None
        try:
            for group in ranges(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if group[0][0] != name:
                    if source is not None:
                        source.close()
                    name = group[0][0]
                    source = files.read(name)
                begin, end = group[0][1], group[-1][1] + group[-1][2]
                source.seek(begin)
                chunk = source.read(end - begin)
                found = []
                for _, offset, length in group:
                    warc, http, payload = parse(zlib.decompress(chunk[offset - begin : offset - begin + length], 31))
                    revisit = warc["warc-type"] == "revisit"
                    digest = warc["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and digest != digest_of(payload):
                        raise ValueError(f"the payload of {warc['warc-record-id']} does not match its digest")
                    number, refers = (x.removeprefix("<urn:page:").removesuffix(">") for x in (warc["warc-record-id"], warc.get("warc-refers-to", "none")))
                    found.append((None if number == "none" else int(number), int(http["content-length"]) if revisit else len(payload), digest, warc["warc-type"], None if refers == "none" else int(refers), payload))
                columns = list(zip(*found, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays(arrays if payloads else arrays[:-1], names=names if payloads else names[:-1])
        finally:
            if source is not None:
                source.close()

    return wanted.mapInArrow(tidy(run), RECORDS + (", payload binary" if payloads else ""))
