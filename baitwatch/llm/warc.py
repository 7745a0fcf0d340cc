"""WARC archives: records written as gzip members, and a splittable reader. A reader
task owns a byte range of a file: it looks for the gzip magic there, proves a
candidate by decoding it up to a WARC header, and reads on from member to member
while they start inside its range."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.llm.common import shared_path, utf8_column

# Smallest payload for which equal ones are replaced by revisits.
LEAST_REVISIT = 100
# Bytes of a file one task reads, and of one read call.
SPLIT_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
# Bytes handed to the decoder at once.
PIECE_BYTES = 16 << 10
# Fixed by the gzip and WARC formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Record types that carry a page; others are passed over.
PAGES = ("response", "revisit", "resource")

RECORD = "page_id long, record_id string, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _filesystem(path: str):
    """File system and path for a URI or a plain path, in a task or on the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _record(page_id: int, url: str, kind: str, refers: int | None, size: int, digest: str, payload: bytes) -> bytes:
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head = "\r\n".join([*fields, f"Content-Length: {len(payload)}"]) + "\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + payload + b"\r\n\r\n") + packer.flush()


def _writer(folder: str):
    """One archive per task, under a name of the attempt until it is whole."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():06d}.warc.gz"
        trial = f"{root}/_tmp-{context.taskAttemptId()}"
        n, out = 0, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for page_id, url, refers, size, digest, html in zip(*columns, strict=True):
                out = out or files.open_output_stream(trial)
                kind = "response" if refers is None else "revisit"
                out.write(_record(page_id, url or "", kind, refers, size, digest, b"" if refers is not None else (html or "").encode()))
                n += 1
        if out:
            out.close()
            files.move(trial, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return write


def write_archives(pages: DataFrame, folder: str | None = None) -> str:
    """Write ``page_id, url, html`` (other columns are ignored) and return the folder.
    A null html is empty, a null url too. Of equal payloads of LEAST_REVISIT bytes or
    more the smallest page_id is the response and the others refer to it; repeated
    rows of that page_id are responses too. A row with a null page_id gets a record
    whose name has no number; it may refer to a page, no page refers to it."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.octet_length(html).cast("long").alias("size"),
                        F.sha2(html, 256).alias("digest"), "html")
    # Only payloads that occur under several pages need the join.
    first = rows.where(F.col("size") >= LEAST_REVISIT).groupBy(F.col("digest").alias("same")).agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("same", "first")
    joined = rows.join(first, F.col("digest") == F.col("same"), "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    ready = joined.select("page_id", "url", refers.alias("refers"), "size", "digest", F.when(refers.isNull(), F.col("html")).alias("html"))
    ready.mapInArrow(_writer(folder), "n long").agg(F.sum("n")).collect()
    return folder


def _members(handle, begin: int, end: int, size: int) -> Iterator[bytes]:
    """Decoded members that start in ``[begin, end)``. Bytes are read in chunks, a
    record beyond the end of the range is read to its own end."""
    buffer, base = b"", begin

    def more(least: int) -> bool:
        nonlocal buffer
        at = base + len(buffer)
        if at >= size:
            return False
        handle.seek(at)
        buffer += handle.read(min(max(CHUNK_BYTES, least), size - at))
        return True

    def decode(offset: int) -> tuple[bytes, int] | None:
        """The member at a place of the buffer and the place after it."""
        unpacker, out, fed, proven, head = zlib.decompressobj(31), [], offset, False, bytearray()
        while not unpacker.eof:
            if fed >= len(buffer) and not more(0):
                return None
            piece = buffer[fed:fed + PIECE_BYTES]
            fed += len(piece)
            try:
                got = unpacker.decompress(piece)
            except zlib.error:
                return None
            out.append(got)
            if not proven:
                head += got
                if not head.startswith(VERSION[:len(head)]):
                    return None
                proven = head.find(b"\r\n\r\n", max(0, len(head) - len(got) - 3)) >= 0
        return (b"".join(out), fed - len(unpacker.unused_data)) if proven else None

    offset = 0
    while True:
        if base + offset >= end:
            return
        if len(buffer) < offset + len(MAGIC) and not more(0):
            return
        # The next candidate; a known member is followed by one at once.
        at = buffer.find(MAGIC, offset)
        if at < 0:
            offset = max(offset, len(buffer) - len(MAGIC) + 1)
            if not more(0):
                return
            continue
        if base + at >= end:
            return
        found = decode(at)
        if found is None:
            offset = at + 1
            continue
        yield found[0]
        offset = found[1]
        if offset >= CHUNK_BYTES:
            buffer, base, offset = buffer[offset:], base + offset, 0


def _number(urn: str | None) -> int | None:
    """The page_id in a record's name; names of other writers have none."""
    name = (urn or "").strip("<>")
    digits = name.removeprefix("urn:page:")
    return int(digits) if name != digits and digits.lstrip("-").isdigit() else None


def _parse(member: bytes) -> tuple | None:
    """A record's columns, None for a record that carries no page. Of a HTTP message
    the payload is what follows its header; a record without a length goes on to the
    end of its member, less the two line ends after it."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    kind = fields.get("warc-type", "")
    if kind not in PAGES:
        return None
    length = fields.get("content-length", "")
    payload = rest[:int(length)] if length.isdigit() else rest.removesuffix(b"\r\n\r\n")
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    if kind == "revisit":
        named = fields.get("warc-payload-digest", "")
        stated = fields.get("x-payload-length", "")
        size, digest = int(stated) if stated.isdigit() else None, named.removeprefix("sha256:") or None
    record = fields.get("warc-record-id")
    return _number(record), record, fields.get("warc-target-uri", ""), kind, _number(fields.get("warc-refers-to")), size, digest, payload


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path, begin, end, size in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                files, name = _filesystem(path)
                rows, held = [], 0
                with files.open_input_file(name) as handle:
                    for member in _members(handle, begin, end, size):
                        row = _parse(member)
                        if row is None:
                            continue
                        rows.append(row if with_payload else (*row[:-1], None))
                        held += len(member) if with_payload else 200
                        if held >= CHUNK_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return read


def read_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """All pages of the ``*.warc.gz`` files of a folder, in tasks of ``split_bytes`` of a
    file, whatever the file's size: records of the types PAGES, by any writer; those of
    other types are passed over. ``page_id`` and ``refers_to`` are null where the names
    are not this module's, sizes and digests of revisits where they aren't stated. An empty folder gives no rows; bytes that are
    no WARC member are passed over."""
    listed = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option(
        "pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    step = F.lit(split_bytes).cast("long")
    splits = listed.where("length > 0").select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("length") - 1, step)).alias("begin")).select(
        "path", "begin", F.least(F.col("begin") + split_bytes, F.col("length")).alias("end"), F.col("length").alias("size"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return splits.repartition(n).mapInArrow(_reader(payload), RECORD)
