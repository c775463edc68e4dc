"""WARC archives whose records are compressed singly under a Zstandard dictionary that the archive carries.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, built from the archive's own
first records; each record follows as a frame of its own, so any record can be read from its offset.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm._shared import byte_slices, drop_written, get_file, new_folder, put_file, tasks, written

_SKIP = 0x184D2A5D
_FRAME = 0xFD2FB528
_DATE = "1970-01-01T00:00:00Z"
_EPOCH_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8").int >> 64


def record_id(page_id: int) -> str:
    """A UUID whose last 64 bits are the page's id."""
    return f"<urn:uuid:{uuid.UUID(int=_EPOCH_SPACE << 64 | page_id & 0xFFFFFFFFFFFFFFFF)}>"


def page_of(record: str) -> int:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int & 0xFFFFFFFFFFFFFFFF
    return n - (1 << 64) if n >> 63 else n


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    """The text, with what can't stand in a header's line (control characters and the like, blanks at the ends) percent-encoded."""
    bare = text.strip(" ")
    at = text.index(bare) if bare else len(text)
    return "%20" * at + "".join(c if c.isprintable() else quote(c, safe="") for c in bare) + "%20" * (len(text) - at - len(bare))


def info_record(dict_bytes: int) -> bytes:
    """What an archive begins with: a description of it."""
    block = f"format: WARC File Format 1.1\r\ndescription: records compressed singly with Zstandard under the dictionary of {dict_bytes} bytes in the leading skippable frame\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Date: {_DATE}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, block.decode())}>", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = header_value(url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head.append(f"WARC-Record-ID: {record_id(page_id)}" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, uri + base32_sha1(payload))}>")
    if page_id is None:
        head.append("WARC-Page-Unknown: true")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] + ([f"WARC-Refers-To: {record_id(refers_to)}"] if refers_to is not None else [])
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict | None:
    """A page's record; None for an archive's description."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": None if "WARC-Page-Unknown" in fields else page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None}


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; their plain bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(first: list[bytes], rest, dict_bytes: int):
    """The archive's bytes: the dictionary's frame, then a frame for its description and for each record."""
    d = dictionary(first, dict_bytes)
    body = d.as_bytes()
    yield struct.pack("<II", _SKIP, len(body)) + body
    c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=True, write_checksum=True)
    yield c.compress(info_record(len(body)))
    for r in first:
        yield c.compress(r)
    for r in rest:
        yield c.compress(r)


def frame_size(data: memoryview, at: int) -> int:
    """Length of the compressed frame that begins at `at`, from its header and its blocks' headers."""
    magic, flags = struct.unpack_from("<IB", data, at)
    if magic != _FRAME:
        raise ValueError("no frame here")
    single, pos = flags >> 5 & 1, at + 5
    pos += (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return pos + 4 * (flags >> 2 & 1) - at


def read_archive(data: bytes):
    """All pages' records of an archive."""
    magic, n = struct.unpack_from("<II", data)
    if magic != _SKIP:
        raise ValueError("an archive begins with its dictionary")
    body = data[8 : 8 + n]
    trained = body[:4] == b"\x37\xa4\x30\xec"
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT))
    at, view = 8 + n, memoryview(data)
    while at < len(data):
        size = frame_size(view, at)
        if record := parse_record(d.decompress(view[at : at + size])):
            yield record
        at += size


def originals(df: DataFrame, page: str, payload: str, least: int) -> DataFrame:
    """(k, d, refers_to) of rows whose payload an earlier page holds too; only ids, digests and lengths are shuffled."""
    ids = df.select(F.col(page).cast("long").alias("k"), F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary")).alias("d"), F.octet_length(F.coalesce(F.col(payload), F.lit(""))).alias("n")).where(F.col("n") >= least)
    first = ids.groupBy("d", "n").agg(F.min("k").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").select("d", "n", "refers_to")
    first = written(first, "first")
    return written(ids.join(first, ["d", "n"]).where(~F.col("k").eqNullSafe(F.col("refers_to"))).select("k", "d", "refers_to").distinct(), "revisits")


def write_archives(df: DataFrame, page: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, dict_bytes: int = 32_768, sample_bytes: int = 1_000_000, archive_bytes: int = 64_000_000) -> DataFrame:
    """Archive every row; the manifest (path, records) as a written table.

    Of rows with equal payloads of at least `least` bytes that with the smallest id becomes a response, all others
    revisits of it. A null payload is empty, a null url an empty one; characters of a url that can't stand in a header are percent-encoded. A row with a null id is a revisit where an id
    holds its payload, else a response without an id; repeated rows become a record each, with the same type. A
    dictionary comes from an archive's first records, up to sample_bytes; a file ends after archive_bytes of records, or with one
    longer record, and carries the attempt's number: the manifest names the files of the attempt that counted. Empty tables give no
    archives; other columns aren't read, whatever their names.
    """
    folder = new_folder(df.sparkSession, "warc")

    def run(batches):
        task, seq = TaskContext.get(), 0

        def records():
            for batch in batches:
                for a, b in byte_slices(batch.column(2)):
                    cut = batch.slice(a, b - a)
                    for k, u, p, revisit, refers in zip(*(cut.column(i).to_pylist() for i in range(5)), strict=True):
                        yield build_record(k, u, p or b"", refers, revisit)

        source, over = records(), False
        while not over:
            first, n, count, total = [], 0, 0, 0
            for r in source:
                first.append(r)
                n += len(r)
                if n >= sample_bytes:
                    break
            if not first:
                return

            def rest(total=n):
                nonlocal count, over
                while total < archive_bytes:
                    r = next(source, None)
                    if r is None:
                        over = True
                        return
                    total += len(r)
                    count += 1
                    yield r

            path = f"{folder}/{task.partitionId():06d}-{seq:04d}-{task.taskAttemptId()}.warc.zst"
            put_file(path, archive(first, rest(), dict_bytes))
            seq += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [len(first) + count]})

    later = originals(df, page, payload, least)
    rows = df.select(F.col(page).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("p")).withColumn("d", F.sha1("p"))
    right = later.select(F.col("k").alias("k2"), F.col("d").alias("d2"), "refers_to", F.lit(True).alias("again"))
    joined = rows.join(right, F.col("k").eqNullSafe(F.col("k2")) & (F.col("d") == F.col("d2")), "left").select("k", "u", "p", F.coalesce("again", F.lit(False)).alias("again"), "refers_to")
    return written(joined.mapInArrow(run, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to [, payload]) of every record of the manifest's archives."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * keep_payload
    types = dict(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=False))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[c]) for c in names], names=names)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for r in read_archive(get_file(path)):
                    rows.append({c: r[c] for c in names})
                    if len(rows) == 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    n = min(max(1, manifest.count()), 4 * tasks(manifest.sparkSession))
    return manifest.select("path").repartition(n).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload)


__all__ = ["archive", "drop_written", "read_archive", "read_archives", "write_archives"]
