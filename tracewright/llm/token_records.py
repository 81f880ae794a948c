"""Token ids as length-delimited binary records, with an offset index beside each file.

A file holds records one after another, each framed as: length of the body (unsigned 64 bit), masked checksum
of those eight bytes (unsigned 32 bit), body, masked checksum of the body. All numbers are little-endian. The
checksum is CRC-32 and the mask rotates it right by 15 bits and adds a constant, so that a body that
holds framed records itself isn't taken for one. A body is: flags (1 byte: 1 if the id is null, 2 if ids have 32
bits), doc_id (signed 64 bit), the ids. The index file has for each record its offset and its length, unsigned 64 bit,
so any record can be read on its own, in any order.

Files lie in the shared folder. Every task attempt writes files under names of its own and only those that a
finished attempt reports in the manifest (a Parquet table) count, so a lost executor or a speculative copy does no harm.

Defined cases: a null text is empty and gets the end id only; a null doc_id sorts first and reads back as null;
rows that repeat an id stay in order of their text; an empty table gives no file and an empty result. Other columns
of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, qualified, scratch, slices, texts
from .tokenization import tokenizer

MASK_ADDED = 0xA282EAD8
FRAME, HEAD = "<QI", "<Bq"
HEAD_BYTES = struct.calcsize(HEAD)
FILE_BYTES, BLOCK_BYTES = 128 << 20, 8 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADDED) & 0xFFFFFFFF


def framed(body: bytes) -> bytes:
    length = struct.pack("<Q", len(body))
    return length + struct.pack("<I", masked(length)) + body + struct.pack("<I", masked(body))


def unframed(data: bytes) -> bytes:
    """The body of one framed record; raises if a length or checksum doesn't hold."""
    if len(data) < 16:
        raise ValueError("a record is cut short")
    length, check = struct.unpack_from(FRAME, data)
    if masked(data[:8]) != check or len(data) != length + 16:
        raise ValueError("a record's length doesn't hold")
    body = data[12 : 12 + length]
    if masked(body) != struct.unpack_from("<I", data, 12 + length)[0]:
        raise ValueError("a record's checksum doesn't hold")
    return body


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store that a path's scheme names; a path without one (of a test) is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int, space: str = "dropped") -> DataFrame:
    """Encodes, ends each document with ``end_id``, writes files in doc_id order; the manifest has a row for each file.

    One range exchange by doc_id (ties by text); each task sorts its range, which spills if need be, and writes as it encodes.
    """
    folder = qualified(docs.sparkSession, folder).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        task, number, out, path = TaskContext.get().partitionId(), 0, None, ""
        encode, rows = tokenizer(vocabulary, space), []

        def close() -> pa.RecordBatch:
            out.close()
            with fs.open_output_stream(path + ".idx") as index:
                index.write(np.array(rows, "<u8")[:, :2].tobytes())
            return pa.RecordBatch.from_pylist([{"task": task, "number": number, "path": f"{folder}/{path.rsplit('/', 1)[-1]}", "n_records": len(rows), "n_bytes": place, "n_tokens": sum(r[2] for r in rows)}], schema=manifest)

        manifest = pa.schema([("task", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
        end, width = np.array([end_id], encode.dtype).tobytes(), encode.dtype.itemsize
        for batch in slices(batches, 1024):
            ids = encode.encode(texts(batch.column(1)))
            for doc_id, own in zip(batch.column(0).to_pylist(), ids, strict=True):
                if out is None:
                    path, rows, place = f"{base}/part-{task:06d}-{number:04d}-{uuid.uuid4().hex}.rec", [], 0
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(path)
                record = framed(struct.pack(HEAD, (doc_id is None) | (width == 4) << 1, doc_id or 0) + own + end)
                out.write(record)
                rows.append((place, len(record), len(own) // width + 1))
                place += len(record)
                if place >= FILE_BYTES:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(write, "task long, number long, path string, n_records long, n_bytes long, n_tokens long"), "records-manifest")


def read_one(fs: pafs.FileSystem, path: str, at: int, length: int) -> tuple[int | None, np.ndarray]:
    """Reads the record that the index of a file (a place in a store, as ``file_system`` gives them) has at ``at``: doc_id and its ids."""
    with fs.open_input_file(path) as f:
        body = unframed(f.read_at(length, at))
    flags, doc_id = struct.unpack_from(HEAD, body)
    return None if flags & 1 else doc_id, np.frombuffer(body, "<u4" if flags & 2 else "<u2", offset=HEAD_BYTES)


def read_records(manifest: DataFrame) -> DataFrame:
    """Reads all files back by their indexes, a file a row of the manifest, and checks every frame.

    ``start`` counts the ids of all documents before: files before it by a running sum over the manifest, which has a row
    for 128 MB of records, and those before it in its file.
    """
    before = F.sum("n_tokens").over(Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("base", F.coalesce(before, F.lit(0)).cast("long")).select("path", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = file_system(path)
                with fs.open_input_stream(path + ".idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                with fs.open_input_file(path) as f:
                    at = 0
                    while at < len(index):  # a block of records at a time, or one that is larger
                        end = max(at + 1, min(at + 512, int(np.searchsorted(index[:, 0], index[at, 0] + BLOCK_BYTES))))
                        part, out, at = index[at:end], [], end
                        block = f.read_at(int(part[-1].sum() - part[0, 0]), int(part[0, 0]))
                        for offset, length in (part - [part[0, 0], 0]).tolist():
                            body = unframed(block[offset : offset + length])
                            flags, doc_id = struct.unpack_from(HEAD, body)
                            ids = np.frombuffer(body, "<u4" if flags & 2 else "<u2", offset=HEAD_BYTES).astype("<u4")
                            out.append((None if flags & 1 else doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, vocabulary: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the records and reads them back: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids)."""
    folder = folder or scratch(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, vocabulary, end_id))
