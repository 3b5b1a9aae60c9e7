"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record, read by offset.

Archives live in the folder that driver and executors share, and are opened through its file system (any
that pyarrow knows: local, HDFS, object stores). Each task writes under a name of its own attempt, moves the
finished file into place and reports it as a row; only reported files are read, so a lost or repeated task
leaves nothing that counts. A file holds at most ROLL_BYTES of records before compression (one record more at
most), so tasks stay small whatever the table.
"""

from __future__ import annotations

import hashlib
import posixpath
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import cut, fresh_path

ROLL_BYTES = 64 << 20
#: Payloads below this size are always stored.
LEAST_SHARED = 100
_STEP = 1 << 20
_MANIFEST = "archive string, n_records long"


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def _gzip() -> "zlib._Compress":
    return zlib.compressobj(6, zlib.DEFLATED, 31)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; refers_to makes it a revisit, whose block has no payload."""
    name = "" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe=";/?:@&=+$,-_.!~*'()#%[]"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload (the block after its HTTP head)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _page(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def _records(stream) -> Iterator[bytes]:
    """The records of a gzip stream of any number of members, inflated once, piece by piece."""
    inflate, held, compressed = zlib.decompressobj(31), bytearray(), b""
    while True:
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            length = next(int(line.partition(b":")[2]) for line in bytes(held[:end]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
            size = end + 4 + length + 4
            if len(held) >= size:
                yield bytes(held[:size])
                del held[:size]
                continue
        if inflate.eof:
            compressed, inflate = inflate.unused_data + compressed, zlib.decompressobj(31)
        compressed = inflate.unconsumed_tail or compressed or stream.read(_STEP)
        if not compressed:
            break
        held += inflate.decompress(compressed, _STEP)
        compressed = b""
    if held:
        raise ValueError("the stream ends within a record")


class _Archive:
    """A file that is written under the attempt's own name and moved into place when it is whole."""

    def __init__(self, root: str, kind: str, number: int):
        context = TaskContext.get()
        self.fs, folder = _open(root)
        self.name = f"{kind}-{context.partitionId():05d}-{context.taskAttemptId()}-{number:05d}.warc.gz"
        self.path = posixpath.join(folder, self.name)
        self.stream = self.fs.open_output_stream(self.path + ".part", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.path + ".part", self.path)


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null in revisits), payload_digest, refers_to: what each page's record is.

    Of records with equal payloads of at least LEAST_SHARED bytes the smallest page_id is stored. Payloads
    stay where they are until this is known: only (page_id, digest) pairs are compared, and digests of one
    page only go no further. The pages then meet their decisions by (page_id, digest).
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(html, 256).alias("payload_digest"))
    keys = cut(rows.filter(F.octet_length("html") >= LEAST_SHARED).select("page_id", "payload_digest"), "warc-digests")
    stored = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    revisits = keys.join(stored, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = cut(revisits.select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), "first").distinct(), "warc-revisits")
    found = rows.join(revisits, rows["page_id"].eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest")), "left")
    return found.select("page_id", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), "payload_digest", F.col("first").alias("refers_to"))


def write_monolithic(records: DataFrame, root: str) -> DataFrame:
    """Archives as a crawler might leave them: one gzip stream over all records of a file. Returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, packer, plain, count, number, done = None, None, 0, 0, 0, []

        def finish() -> None:
            archive.write(packer.flush())
            archive.close()
            done.append((archive.name, count))

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if archive is None:
                    archive, packer, plain, count = _Archive(root, "raw", number), _gzip(), 0, 0
                    number += 1
                data = record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to)
                archive.write(packer.compress(data))
                plain, count = plain + len(data), count + 1
                if plain >= ROLL_BYTES:
                    finish()
                    archive = None
        if archive is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "n_records"])

    return cut(records.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, _MANIFEST), "warc-manifest")


def normalise(manifest: DataFrame, root: str) -> DataFrame:
    """Rewrite each archive of the manifest with every record as its own gzip member.

    Returns the sidecar index (archive, ordinal, offset, length, page_id, record_type), stored as a table
    beside the archives; archive names the new file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                filesystem, folder = _open(root)
                out, number, index = _Archive(root, "records", number), number + 1, []
                with filesystem.open_input_stream(posixpath.join(folder, name), compression=None) as stream:
                    for ordinal, record in enumerate(_records(stream)):
                        headers, _ = parse_record(record)
                        packer, offset = _gzip(), out.size
                        out.write(packer.compress(record) + packer.flush())
                        index.append((out.name, ordinal, offset, out.size - offset, _page(headers["warc-record-id"]), headers["warc-type"]))
                out.close()
                columns = list(zip(*index)) or [[]] * 6
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["archive", "ordinal", "offset", "length", "page_id", "record_type"])

    spread = manifest.select("archive").repartition(max(1, manifest.count()))  # a task per archive
    return cut(spread.mapInArrow(run, "archive string, ordinal long, offset long, length long, page_id long, record_type string"), "warc-index")


def read(index: DataFrame, root: str) -> DataFrame:
    """Records by their offsets: page_id, url, record_type, refers_to, payload, payload_digest (from the payload, or
    of a revisit from its header). Any part of the index may be given: other records are not touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = _open(root)
        name, file = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                out = []
                for archive, offset, length in zip(*[c.to_pylist() for c in whole.slice(start, 200).columns]):
                    if archive != name:
                        if file is not None:
                            file.close()
                        name, file = archive, filesystem.open_input_file(posixpath.join(folder, archive))
                    headers, payload = parse_record(zlib.decompress(file.read_at(length, offset), 31))
                    revisit = headers["warc-type"] == "revisit"
                    told = headers["warc-payload-digest"].partition(":")[2]
                    digest = told if revisit else hashlib.sha256(payload).hexdigest()
                    if digest != told:
                        raise ValueError(f"the payload of {headers['warc-record-id']} is not what was written")
                    out.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], _page(headers["warc-refers-to"]) if revisit else None, None if revisit else payload, digest))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, types)], ["page_id", "url", "record_type", "refers_to", "payload", "payload_digest"])
        if file is not None:
            file.close()

    archives = index.select("archive").distinct().count()
    wanted = index.select("archive", "offset", "length").repartition(max(1, archives), "archive").sortWithinPartitions("archive", "offset")
    return wanted.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string")


def archive_pages(pages: DataFrame, root: str | None = None) -> tuple[str, DataFrame]:
    """Write, normalise; returns the folder and the index. An empty table gives an empty index."""
    spark = pages.sparkSession
    root = root or fresh_path(spark, "warc")
    if "://" not in root and not root.startswith("/"):
        root = "file://" + root.removeprefix("file:")
    filesystem, folder = _open(root)
    filesystem.create_dir(folder, recursive=True)
    return root, normalise(write_monolithic(plan_records(pages), root), root)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for each row of pages, from the archives.

    A null html is an empty payload. Revisits get size and digest of the response they refer to. Rows that
    repeat a page_id are records of their own; those with the same payload are stored alike. A null page_id
    is kept; it is never the one that others refer to. Other columns are not read.
    """
    root, index = archive_pages(pages)
    back = read(index, root).select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest")
    back = cut(back, "warc-read")
    stored = back.filter("record_type = 'response'").groupBy(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("stored_bytes"))
    asked = (back["refers_to"] == stored["id"]) & (back["payload_digest"] == stored["digest"])
    return back.join(stored, asked, "left").select("page_id", F.coalesce("payload_bytes", "stored_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
