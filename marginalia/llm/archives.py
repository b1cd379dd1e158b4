"""Web archives (WARC) with a shared compression dictionary.

A dictionary is trained from a bounded sample of the records.  Every file begins with it, in a skippable
frame (magic 0x184D2A5D), so any reader can find it there; then every record is a Zstandard frame of its own, compressed with the dictionary, and
can be read alone from its offset.  Of equal payloads one record, a response, holds the bytes; the others are revisits
with headers only.

Tasks write files of their own rows under names that no other attempt has, and only the files of tasks that ended well are in the table that
is returned, so a lost task does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textwords import as_bytes, slices
from .token_files import file_system

SKIPPABLE, DICTIONARY_FRAME, FRAME = 0x184D2A50, 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, n_records long, n_bytes long"
#: The sample that a dictionary is trained from: so many records at most, and so many bytes of each.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8192, 64 << 10


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(same: bytes, page_id: int | None, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{same.hex()}:{page_id}:{n}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: bytes, own: str, refers: tuple[str, int | None] | None, date: str) -> bytes:
    """A response, or with `refers` (record, page) a revisit, which has the headers of the response but not its payload."""
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", own), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()))
    if refers:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers[0])]
        if refers[1] is not None:
            fields.append(("Refers-To-Page-Id", str(refers[1])))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _record(fields, head if refers else head + payload)


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; of samples that are too few or too alike to train from, the samples themselves."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def frames(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of every record of a file, with the dictionary that it begins with."""
    held, at, unpacker = b"", 0, zstandard.ZstdDecompressor()

    def more(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            got = stream.read(max(chunk, n - len(held)))
            if not got:
                return False
            held += got
        return True

    while more(4):
        magic = struct.unpack("<I", held[:4])[0]
        if magic & ~0xF == SKIPPABLE:
            if not more(8) or not more(8 + struct.unpack("<I", held[4:8])[0]):
                raise ValueError(f"the frame at {at} is cut short")
            size = struct.unpack("<I", held[4:8])[0]
            if magic == DICTIONARY_FRAME and at == 0:
                raw = held[8 : 8 + size]
                if raw[:4] == struct.pack("<I", FRAME):
                    raw = zstandard.decompress(raw)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            held, at = held[8 + size :], at + 8 + size
            continue
        one, parts, used = unpacker.decompressobj(), [], 0
        while True:
            parts.append(one.decompress(held))
            used += len(held)
            if one.eof:
                break
            held = stream.read(chunk)
            if not held:
                raise ValueError(f"the frame at {at} is cut short")
        held = one.unused_data
        used -= len(held)
        yield at, b"".join(parts)
        at += used


def fields_of(record: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record and its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"the record {fields.get('WARC-Record-ID')} has another length than it says")
    return fields, block


def _rows(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, html, size, sha1, same (the payload's SHA-256), _n (row) and, of pages that share a payload, last_id and
    last_n: the greatest page_id and the row that has it."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("size"), F.unhex(F.sha1("html")).alias("sha1"), F.unhex(F.sha2("html", 256)).alias("same"), F.monotonically_increasing_id().alias("_n"))
    rows = common.staged(rows, "pages")
    last = F.max(F.struct("page_id", "_n")).alias("last")
    groups = rows.where(F.col("size") >= least_bytes).groupBy("same").agg(last, F.count("*").alias("n")).where("n > 1")
    groups = common.staged(groups.select("same", F.col("last.page_id").alias("last_id"), F.col("last._n").alias("last_n")), "payloads")
    return common.looked_up(rows, groups, ["same"], "left")


def _dictionary(rows: DataFrame, date: str) -> bytes | None:
    """Trained in one task from a sample by digest."""

    def train(batches):
        samples = []
        for batch in batches:
            samples += batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([trained(samples)] if samples else [], pa.binary())], ["dictionary"])

    n = rows.count()
    if not n:
        return None
    # each payload as often as it is written: once
    written = rows.where("last_n is null or last_n = _n")
    share = min(1.0, 2 * SAMPLE / n)
    some = written.where(F.conv(F.substring(F.hex("same"), 1, 8), 16, 10).cast("long") < int(share * 2**32))

    def record(batches):
        for batch in batches:
            out = []
            for page_id, url, html, size, sha1, same, own in zip(*(c.to_pylist() for c in batch.columns)):
                out.append(page_record(page_id, url, html.encode()[:SAMPLE_BYTES], size, sha1, record_id(same, page_id, own), None, date))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    drawn = some.select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html"), "size", "sha1", "same", "_n").limit(SAMPLE)
    found = drawn.mapInArrow(record, "record binary").repartition(1).mapInArrow(train, "dictionary binary").collect()
    return bytes(found[0].dictionary) if found else None


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html) to files in folder, a path that all executors
    share.  Returns the files: path, n_records (pages), n_bytes.

    Of payloads of least_bytes or more that are equal the one with the greatest page_id (null is the least) is a response and the others
    revisit it; of rows that repeat that page_id one is the response.  Shorter payloads are all responses.  A null html is
    empty, a null url or page_id has no field.  Other columns are ignored; an empty table gives no file."""
    rows = _rows(pages, least_bytes)
    dictionary = _dictionary(rows, date)
    store, base = file_system(folder)
    store.create_dir(base, recursive=True)
    sent = rows.sparkSession.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        store, base = file_system(folder)
        raw = sent.value
        options = {"level": level, "write_checksum": True}
        if raw:
            options["dict_data"] = zstandard.ZstdCompressionDict(raw)
        packer = zstandard.ZstdCompressor(**options)
        out, path, n, size, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, n, size))
            out = None

        for batch in batches:
            offsets, _ = as_bytes(batch.column(2))
            for i, j in slices(offsets):
                for page_id, url, html, n_bytes, sha1, same, own, last_id, last_n in zip(*(c.to_pylist() for c in batch.slice(i, j - i).columns)):
                    if out is None:
                        path = f"{base}/pages-{part:08d}-{len(done):04d}-{attempt}.warc.zst"
                        out, n = store.open_output_stream(path, compression=None), 0
                        lead = b""
                        if raw:
                            packed = zstandard.compress(raw, 19)
                            lead = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
                        info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(b"", part, len(done))), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        lead += packer.compress(info)
                        out.write(lead)
                        size = len(lead)
                    refers = (record_id(same, last_id, last_n), last_id) if last_n is not None and last_n != own else None
                    payload = None if refers else (html or "").encode()
                    frame = packer.compress(page_record(page_id, url, payload, n_bytes, sha1, record_id(same, page_id, own), refers, date))
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
                    if size >= file_bytes:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])

    # a revisit needs no payload
    payload = F.when(F.col("last_n").isNull() | (F.col("last_n") == F.col("_n")), F.col("html")).alias("html")
    placed = rows.select("page_id", "url", payload, "size", "sha1", "same", "_n", "last_id", "last_n")
    return common.staged(placed.mapInArrow(write, FILES), "archives")


def read_archives(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, path and offset of every page record in the files, and
    html of responses if payloads are asked for.

    The digest of a response is that of the payload that was read; where it isn't what the record says, the file is damaged, and
    an error says so.  A revisit has the digest and length that its headers tell."""
    spark = files.sparkSession
    scheme = folder.split("://")[0] if "://" in folder else "file"
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "offset", "html"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    width = len(names) if payloads else len(names) - 1
    number = lambda x: None if x is None else int(x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, _ = file_system(f"{scheme}://{path}")
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for offset, record in frames(stream):
                        fields, block = fields_of(record)
                        kind = fields["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", head + b"\r\n")[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"the record at {offset} of {path} is damaged")
                        html = payload.decode() if payloads and kind == "response" else None
                        rows.append((number(fields.get("Page-Id")), fields.get("WARC-Target-URI"), size, digest, kind, number(fields.get("Refers-To-Page-Id")), path, offset, html))
                        held += len(html or "")
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(width)], names[:width])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(width)], names[:width])

    sql = {pa.int64(): "long", pa.string(): "string"}
    schema = ", ".join(f"{n} {sql[k]}" for n, k in zip(names[:width], kinds))
    # one row a file: a task for each
    spread = files.select("path").repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(read, schema)


def record_at(path: str, offset: int) -> tuple[dict[str, str], bytes]:
    """The fields and block of one record, from the dictionary at the start of its file and its own frame alone."""
    store, base = file_system(path)
    with store.open_input_file(base) as stream:
        magic, size = struct.unpack("<II", stream.read(8))
        lead = struct.pack("<II", magic, size) + stream.read(size) if magic == DICTIONARY_FRAME else b""
        stream.seek(offset)

        class Rest:
            first = lead

            def read(self, n):
                out, self.first = self.first, b""
                return out or stream.read(n)

        return fields_of(next(frames(Rest(), 1 << 16))[1])
