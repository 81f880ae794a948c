"""ISO media containers: nested boxes and sample tables, read without decoding a payload.

``walk`` yields every box of a file, in any nesting; ``tracks`` decodes the sample tables of each track and gives
codec, duration, sample places and the byte ranges of its keyframes. ``store`` writes a payload losslessly as
one track of raw 8-bit samples, in frames of 64 bytes, the first of each chunk a keyframe.

Defined cases: null media gives null columns and no error; bytes that are no container, are fragmented, are cut short or whose
tables contradict each other give ``error`` and null columns, never an exception; a null text is the empty payload (64
bytes 0); equal texts give equal bytes. Rows are independent: repeated rows repeat, an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import given_apart, materialise, slices, texts

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FRAME_BYTES, CHUNK_FRAMES, FRAMES_A_SECOND = 64, 16, 25


def walk(data: bytes, begin: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of box types, begin and end of the box's content) of every box, outer before inner."""
    end = len(data) if end is None else end
    while begin < end:
        if end - begin < 8:
            raise ValueError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1:
            if end - begin < 16:
                raise ValueError("a box header is cut short")
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if kind == b"uuid":
            head += 16
        if size < head or begin + size > end:
            raise ValueError("a box reaches beyond what holds it")
        here = (*path, kind)
        yield here, begin + head, begin + size
        if kind in CONTAINERS:
            yield from walk(data, begin + head, begin + size, here)
        begin += size


def _table(data: bytes, begin: int, end: int, width: int, dtype: str) -> np.ndarray:
    """Entries of a full box: version and flags, count, then ``width`` numbers each."""
    count = struct.unpack_from(">I", data, begin + 4)[0]
    size = np.dtype(dtype).itemsize * width
    if count > (end - begin - 8) // size:
        raise ValueError("a table is cut short")
    return np.frombuffer(data, dtype, count * width, begin + 8).reshape(count, width).astype(np.int64)


def tracks(data: bytes) -> list[dict]:
    """One dict for each track: codec, timescale, duration, and arrays offset, size, time, keyframe of its samples."""
    found: list[dict] = []
    for path, begin, end in walk(data):
        if path[0] == b"moof" or path[:2] == (b"moov", b"mvex"):
            raise ValueError("a fragmented file; its samples are not read")
        if path[-1] == b"trak" and path[0] == b"moov":
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1][path[-1]] = (begin, end)
    out = []
    for boxes in found:
        if not {b"mdhd", b"stsd", b"stts", b"stsc"} <= boxes.keys():
            raise ValueError("a track lacks a table")
        begin, end = boxes[b"mdhd"]
        timescale, duration = struct.unpack_from(">IQ", data, begin + 20) if data[begin] == 1 else struct.unpack_from(">II", data, begin + 12)
        begin, end = boxes[b"stsd"]
        if end - begin < 16:
            raise ValueError("a sample description is cut short")
        codec = data[begin + 12 : begin + 16].decode("latin-1")
        if b"stsz" in boxes:
            begin, end = boxes[b"stsz"]
            same, count = struct.unpack_from(">II", data, begin + 4)
            if count > (len(data) // same if same else (end - begin - 12) // 4):  # more than the file or the table has room for
                raise ValueError("a size table doesn't hold")
            size = np.full(count, same, np.int64) if same else np.frombuffer(data, ">u4", count, begin + 12).astype(np.int64)
        elif b"stz2" in boxes:
            begin, end = boxes[b"stz2"]
            field, count = data[begin + 7], struct.unpack_from(">I", data, begin + 8)[0]
            if field not in (4, 8, 16) or count * field > (end - begin - 12) * 8:
                raise ValueError("a size table doesn't hold")
            raw = np.frombuffer(data, np.uint8, end - begin - 12, begin + 12)
            size = np.stack([raw >> 4, raw & 15], 1).ravel()[:count] if field == 4 else raw.view(">u2" if field == 16 else np.uint8)[:count]
            size = size.astype(np.int64)
        else:
            raise ValueError("a track lacks a size table")
        n = len(size)
        if b"co64" in boxes:
            chunk_at = _table(data, *boxes[b"co64"], 1, ">u8")[:, 0]
        elif b"stco" in boxes:
            chunk_at = _table(data, *boxes[b"stco"], 1, ">u4")[:, 0]
        else:
            raise ValueError("a track lacks chunk offsets")
        runs = _table(data, *boxes[b"stsc"], 3, ">u4")
        if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunk_at)):
            raise ValueError("a chunk table doesn't hold")
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk_at) + 1))) if len(runs) else np.zeros(0, np.int64)
        if per_chunk.sum() != n:
            raise ValueError("chunks and sizes disagree on the number of samples")
        chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
        ends = np.cumsum(size)
        before = ends - size
        first = np.cumsum(per_chunk) - per_chunk
        offset = chunk_at[chunk] + before - before[np.minimum(first, max(n - 1, 0))][chunk] if n else np.zeros(0, np.int64)
        steps = _table(data, *boxes[b"stts"], 2, ">u4")
        if steps[:, 0].sum() != n:
            raise ValueError("times and sizes disagree on the number of samples")
        step = np.repeat(steps[:, 1], steps[:, 0])
        key = np.ones(n, bool)
        if b"stss" in boxes:
            marked = _table(data, *boxes[b"stss"], 1, ">u4")[:, 0]
            if len(marked) and (marked.min() < 1 or marked.max() > n):
                raise ValueError("a keyframe table doesn't hold")
            key[:] = False
            key[marked - 1] = True
        if n and (offset.min() < 0 or (offset + size).max() > len(data)):
            raise ValueError("samples lie beyond the file")
        out.append({"codec": codec, "timescale": timescale, "duration": duration, "offset": offset, "size": size, "time": np.cumsum(step) - step, "keyframe": key})
    return out


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(text: str) -> tuple[int, bytes]:
    """UTF-8 bytes followed by bytes 0 up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def store(payload: bytes) -> bytes:
    """A container whose one track has the payload as raw samples of 64 bytes."""
    n = len(payload) // FRAME_BYTES
    if n * FRAME_BYTES != len(payload):
        raise ValueError("the payload is no multiple of a frame")
    chunks = -(-n // CHUNK_FRAMES)
    tail = n - (chunks - 1) * CHUNK_FRAMES
    keys = np.arange(0, n, CHUNK_FRAMES) + 1
    entry = struct.pack(">I4s6xH16xHH", 86, b"raw ", 1, FRAME_BYTES, 1) + struct.pack(">IIIH32sHh", 0x480000, 0x480000, 0, 1, b"", 8, -1)
    runs = [(1, CHUNK_FRAMES, 1)] * (chunks > (tail < CHUNK_FRAMES)) + [(chunks, tail, 1)] * (tail < CHUNK_FRAMES)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(at: int) -> bytes:
        tables = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, n, 1)),
            full(b"stss", 0, struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            full(b"stsc", 0, struct.pack(">I", len(runs)), np.array(runs, ">u4").tobytes()),
            full(b"stsz", 0, struct.pack(">II", FRAME_BYTES, n)),
            full(b"co64", 0, struct.pack(">I", chunks), (np.arange(chunks) * FRAME_BYTES * CHUNK_FRAMES + at).astype(">u8").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, FRAMES_A_SECOND, n, 0x55C4, 0)),
            full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"vide"), b"payload\0"),
            box(b"minf", full(b"vmhd", 1, bytes(8)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), tables),
        )
        track = box(b"trak", full(b"tkhd", 3, struct.pack(">IIII", 0, 0, 1, 0), struct.pack(">I8xhhhxx", n, 0, 0, 0), MATRIX, struct.pack(">II", FRAME_BYTES << 16, 1 << 16)), media)
        return box(b"moov", full(b"mvhd", 0, struct.pack(">IIIIIH10x", 0, 0, FRAMES_A_SECOND, n, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2)), track)

    data = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) + payload
    return head + moov(len(head) + len(moov(0)) + 16) + data


def index(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds to each row of a table with a binary column: codec, duration_s, n_samples, keyframes (place, length, time), error, tracks.

    ``tracks`` has the first four of every track, in the file's order; the columns beside are those of the first track. A column of
    the input that has one of these names is kept as ``<name>_given``.
    """
    own = T._parse_datatype_string("codec string, duration_s double, n_samples long, keyframes array<struct<offset:long,length:long,time_s:double>>, error string, tracks array<struct<codec:string,duration_s:double,n_samples:long,keyframes:array<struct<offset:long,length:long,time_s:double>>>>")
    at = media.columns.index(column)
    media = given_apart(media, own.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("time_s", pa.float64())])
        track = pa.struct([("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(key))])
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.list_(key), pa.string(), pa.list_(track))
        for batch in slices(batches):
            rows = []
            for data in batch.column(at).to_pylist():
                if data is None:
                    rows.append((None,) * 6)
                    continue
                try:
                    found = tracks(data)
                    if not found:
                        raise ValueError("no track")
                    made = []
                    for t in found:
                        scale = max(1, t["timescale"])
                        places = zip(t["offset"].tolist(), t["size"].tolist(), t["time"].tolist(), t["keyframe"].tolist(), strict=True)
                        made.append({"codec": t["codec"], "duration_s": t["duration"] / scale, "n_samples": len(t["size"]), "keyframes": [{"offset": a, "length": n, "time_s": s / scale} for a, n, s, k in places if k]})
                    rows.append((*made[0].values(), None, made))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((None, None, None, None, str(e), None))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[*batch.schema.names, *own.fieldNames()])

    return media.mapInArrow(run, T.StructType([*media.schema.fields, *own.fields]))


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every text's payload in a container."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [padded(x) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([store(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def digests(media: DataFrame) -> DataFrame:
    """Reads stored bytes (doc_id, n_bytes, media) through boxes and sample tables: the payload's and the file's digests, and a feature string."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for data in batch.column(2).to_pylist():
                t = tracks(data)[0]
                payload = b"".join(data[a : a + n] for a, n in zip(t["offset"].tolist(), t["size"].tolist(), strict=True))
                keys = [f"{a}+{n}" for a, n in zip(t["offset"][t["keyframe"]].tolist(), t["size"][t["keyframe"]].tolist(), strict=True)]
                feature = f"codec={t['codec'].strip()};duration={t['duration']}/{t['timescale']};samples={len(t['size'])};keyframes={len(keys)};first={keys[0]};last={keys[-1]};ranges={zlib.crc32(','.join(keys).encode()):08x}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_digests(docs: DataFrame) -> DataFrame:
    """Every text's payload is written in a container to a table in the shared folder, read back from there and digested."""
    return digests(materialise(stored(docs), "media", compression="zstd"))
