"""Token ids in files of fixed-width bits.

A file holds the documents of one range of ids in ascending order.  Every id takes `bits` bits, the
least that the vocabulary needs, least significant bit first.  Layout, all little-endian:

    header   8 bytes "FWTOK\\x01\\0\\0", then uint32 bits, uint32 block_ids, uint64 n_docs, uint64 n_ids
    docs     n_docs int64 document ids, n_docs uint8 flags (1: the document id is null),
             n_docs + 1 uint64 positions: document i has the ids position[i] to position[i + 1]
    blocks   n_blocks + 1 uint64 byte offsets, counted from the start of the packed ids
    packed   blocks of block_ids ids each (the last may be shorter), each from a whole byte on

So any block, and any document, can be read with a seek and unpacked by NumPy without what precedes.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .pieces import Encoded, Tokenizer, id_bytes, worker
from .textwords import as_bytes, slices

MAGIC = b"FWTOK\x01\0\0"
HEAD = np.dtype([("magic", "S8"), ("bits", "<u4"), ("block_ids", "<u4"), ("n_docs", "<u8"), ("n_ids", "<u8")])


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


def write_file(out, doc_ids: list, ids: list[np.ndarray], bits: int, block_ids: int) -> int:
    """Writes documents to an open binary stream; returns the number of ids."""
    positions = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<u8")
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [pack(every[i : i + block_ids], bits) for i in range(0, len(every), block_ids)]
    head = np.zeros(1, HEAD)
    head[0] = (MAGIC, bits, block_ids, len(doc_ids), len(every))
    out.write(head.tobytes())
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write(positions.tobytes())
    out.write(np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8").tobytes())
    for b in blocks:
        out.write(b)
    return len(every)


class TokenFile:
    """Reads a file of write_file from a seekable binary stream, block by block."""

    def __init__(self, stream):
        self.stream = stream
        head = np.frombuffer(stream.read(HEAD.itemsize), HEAD)[0]
        if not stream or head["magic"] != MAGIC.rstrip(b"\0"):
            raise ValueError("not a token file")
        self.bits, self.block_ids, n, self.n_ids = int(head["bits"]), int(head["block_ids"]), int(head["n_docs"]), int(head["n_ids"])
        ids, null = np.frombuffer(stream.read(8 * n), "<i8"), np.frombuffer(stream.read(n), np.uint8)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null)]
        self.positions = np.frombuffer(stream.read(8 * (n + 1)), "<u8").astype(np.int64)
        blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(stream.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.base = HEAD.itemsize + 8 * n + n + 8 * (n + 1) + 8 * (blocks + 1)
        self._kept: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def block(self, k: int) -> np.ndarray:
        if self._kept[0] != k:
            self.stream.seek(self.base + int(self.offsets[k]))
            raw = self.stream.read(int(self.offsets[k + 1] - self.offsets[k]))
            self._kept = (k, unpack(raw, min(self.block_ids, self.n_ids - k * self.block_ids), self.bits))
        return self._kept[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        parts = [self.block(k)[max(0, start - k * self.block_ids) : end - k * self.block_ids] for k in range(start // self.block_ids, -(-end // self.block_ids))]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.positions[i]), int(self.positions[i + 1]))


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, bits: int | None = None, partitions: int | None = None, block_ids: int = 1 << 16, file_ids: int = 1 << 24) -> DataFrame:
    """Encodes every document and writes its ids and end_id to files in folder, a path that all
    executors share.  Returns the files in order: file_no, path, n_docs, n_ids.

    Documents are in ascending doc_id order over all files (null ids first, equal ids by text): a range
    partitioning by the id and how the text begins puts them in order, so rows without an id, or of one id, are
    many ranges if they are many; each task writes files of about file_ids ids.  A file is written
    under a passing name and moved when it is whole, so a task that is lost and run again leaves one."""
    spark = docs.sparkSession
    known = Tokenizer(tokenizer_path)
    bits, plain = bits_for(known.vocabulary) if bits is None else bits, known.plain
    del known
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def make():
            tokenizer = Tokenizer(tokenizer_path, plain)
            kind, value = id_bytes(tokenizer.vocabulary)
            return kind, Encoded(tokenizer, value, b"".join)

        kind, encoded = worker(("ids", tokenizer_path), make)
        end = np.array([end_id], kind)
        store, base = file_system(folder)
        rows, doc_ids, ids, held = [], [], [], 0

        def close():
            nonlocal doc_ids, ids, held
            name = f"{base}/tokens-{part:08d}-{len(rows):04d}.fwtok"
            passing = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(passing) as out:
                count = write_file(out, doc_ids, ids, bits, block_ids)
            store.move(passing, name)
            rows.append((part * 10_000 + len(rows), name, len(doc_ids), count))
            doc_ids, ids, held = [], [], 0

        for batch in batches:
            for i, j in slices(as_bytes(batch.column(1))[0]):
                some = batch.slice(i, j - i)
                found = encoded.texts([t or "" for t in some.column(1).to_pylist()])
                for doc_id, raw in zip(some.column(0).to_pylist(), found):
                    doc_ids.append(doc_id)
                    ids.append(np.concatenate((np.frombuffer(raw, kind), end)))
                    held += len(ids[-1])
                    if held >= file_ids:
                        close()
        if doc_ids:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["file_no", "path", "n_docs", "n_ids"])

    store, base = file_system(folder)
    store.create_dir(base, recursive=True)
    placed = common.documents(docs).repartitionByRange(n, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return common.staged(placed.mapInArrow(write, "file_no long, path string, n_docs long, n_ids long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    spark = files.sparkSession
    scheme = folder.split("://")[0] if "://" in folder else "file"

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                store, _ = file_system(f"{scheme}://{path}")
                with store.open_input_file(path) as stream:
                    f = TokenFile(stream)
                    n = len(f.doc_ids)
                    for at in range(0, n, 4096):
                        to = min(n, at + 4096)
                        crc = [zlib.crc32(f.document(i).tobytes()) for i in range(at, to)]
                        yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids[at:to], pa.int64()), pa.array(f.positions[at:to] + first), pa.array(np.diff(f.positions[at : to + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one small row a file: the running sum over them needs no more than one task
    first = F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("path", "file_no", F.coalesce(first, F.lit(0)).alias("first"))
    wide = placed.repartition(max(1, spark.sparkContext.defaultParallelism), "file_no").select("path", "first")
    return wide.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, **options) -> DataFrame:
    """Writes the token files to a new folder in the shared one and reads the documents back.

    A null text has the end id alone.  Empty tables give no file and no row; repeated rows are written
    one after another; other columns are ignored."""
    folder = common.new_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer_path, end_id, **options), folder)
