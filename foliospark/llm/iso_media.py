"""ISO media containers as columns.

Boxes are walked by their headers alone, nested ones as well; the sample tables of each track are decoded to where its samples lie;
codec, duration and the byte ranges of keyframes are stored. Payload bytes are not looked at. `mux` writes such containers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import read

FRAME = 64  # bytes of a frame: 8 x 8 samples of 8 bits
DEEPEST = 32  # levels of boxes below a track
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
TRACK = "struct<track_id:long,handler:string,codec:string,width:int,height:int,duration:double,n_samples:long,n_bytes:long,n_keyframes:long,keyframes:array<struct<start:long,end:long>>>"
TRACK_ARROW = pa.struct([
    ("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("duration", pa.float64()), ("n_samples", pa.int64()),
    ("n_bytes", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


class Malformed(ValueError):
    pass


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the body, end) of the boxes in a range. Size 1: 64-bit size follows; size 0: up to the end."""
    while start < end:
        if end - start < 8:
            raise Malformed("box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - body < 8:
                raise Malformed("box size is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if start + size > end or body > start + size:
            raise Malformed(f"box {kind.decode('latin-1')} passes its end")
        yield kind, body, start + size
        start += size


def leaves(data: memoryview, start: int, end: int) -> dict[bytes, tuple[int, int]]:
    """The first box of each type below a range, nested ones opened."""
    found: dict[bytes, tuple[int, int]] = {}
    level = [boxes(data, start, end)]
    while level:
        kind, body, stop = next(level[-1], (None, 0, 0))
        if kind is None:
            level.pop()
        elif kind in NESTED and kind != b"trak":
            if len(level) == DEEPEST:
                raise Malformed("boxes nest too deep")
            level.append(boxes(data, body, stop))
        else:
            found.setdefault(kind, (body, stop))
    return found


def table(data: memoryview, span: tuple[int, int], dtype: str, skip: int = 4) -> np.ndarray:
    """The entries of a full box: skip bytes (version, flags), a count, entries."""
    body, end = span
    (n,) = struct.unpack_from(">I", data, body + skip)
    kind = np.dtype(dtype)
    if body + skip + 4 + n * kind.itemsize > end:
        raise Malformed("table passes its box")
    return np.frombuffer(data, kind, n, body + skip + 4)


def sample_places(data: memoryview, found: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) in the file of each sample, from chunk offsets, samples by chunk and sample sizes; samples have to lie in the file."""
    if b"stsz" in found:
        same, n = struct.unpack_from(">II", data, found[b"stsz"][0] + 4)
        if same * n > len(data):
            raise Malformed("samples are longer than the file")
        sizes = np.full(n, same, np.int64) if same else table(data, found[b"stsz"], ">u4", 8).astype(np.int64)
    elif b"stz2" in found:
        width, n = struct.unpack_from(">BI", data, found[b"stz2"][0] + 7)
        body, end = found[b"stz2"][0] + 12, found[b"stz2"][1]
        if width not in (4, 8, 16) or body + -(-n * width // 8) > end:
            raise Malformed("table passes its box")
        raw = np.frombuffer(data, np.uint8, -(-n * width // 8), body)
        sizes = {4: lambda: np.stack([raw >> 4, raw & 15], 1).ravel(), 8: lambda: raw, 16: lambda: raw.view(">u2")}[width]()[:n].astype(np.int64)
    else:
        raise Malformed("no sample sizes")
    if b"co64" not in found and b"stco" not in found:
        raise Malformed("no chunk offsets")
    chunks = (table(data, found[b"co64"], ">u8") if b"co64" in found else table(data, found[b"stco"], ">u4")).astype(np.int64)
    if len(chunks) and (chunks.min() < 0 or chunks.max() > len(data)):
        raise Malformed("a chunk lies outside the file")
    runs = table(data, found[b"stsc"], ">u4,>u4,>u4")
    first = runs["f0"].astype(np.int64) - 1
    spans = np.diff(np.append(first, len(chunks)))
    if len(first) and (first[0] != 0 or spans.min() < 0):
        raise Malformed("chunk runs are out of order")
    per_chunk = np.repeat(np.minimum(runs["f1"].astype(np.int64), len(sizes)), spans)
    till = np.cumsum(per_chunk)
    if (till[-1] if len(till) else 0) < len(sizes):
        raise Malformed("chunks hold too few samples")
    chunk = np.searchsorted(till, np.arange(len(sizes)), "right")
    before = np.concatenate([[0], np.cumsum(sizes)])
    opens = np.concatenate([[0], till])[:-1]
    starts = chunks[chunk] + before[:-1] - before[np.minimum(opens, len(sizes))][chunk]
    if len(sizes) and (starts + sizes).max() > len(data):
        raise Malformed("a sample passes the end of the file")
    return starts, sizes


def ranges(starts: np.ndarray, sizes: np.ndarray) -> list[dict]:
    """Byte ranges of samples, neighbours joined."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(starts[1:] != (starts + sizes)[:-1]) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(starts)]]) - 1
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts[first], (starts + sizes)[last])]


def track(data: memoryview, body: int, end: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """A track's columns, and where its samples lie."""
    found = leaves(data, body, end)
    for need in (b"tkhd", b"mdhd", b"stsd", b"stsc"):
        if need not in found:
            raise Malformed(f"no {need.decode()}")
    at = found[b"mdhd"][0]
    scale, length = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    at = found[b"tkhd"][0]
    (track_id,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
    width, height = (x >> 16 for x in struct.unpack_from(">II", data, found[b"tkhd"][1] - 8))
    codec = bytes(data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]).decode("latin-1")
    handler = bytes(data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in found else None
    starts, sizes = sample_places(data, found)
    key = table(data, found[b"stss"], ">u4").astype(np.int64) - 1 if b"stss" in found else np.arange(len(sizes))
    if len(key) and (key.min() < 0 or key.max() >= len(sizes)):
        raise Malformed("a keyframe is no sample")
    return {
        "track_id": track_id, "handler": handler, "codec": codec, "width": width, "height": height, "duration": length / scale if scale else None, "n_samples": len(sizes),
        "n_bytes": int(sizes.sum()), "n_keyframes": len(key), "keyframes": ranges(starts[key], sizes[key]),
    }, starts, sizes


def tracks(data: bytes) -> list[tuple[dict, np.ndarray, np.ndarray]]:
    view = memoryview(data)
    try:
        for kind, body, end in boxes(view, 0, len(view)):
            if kind == b"moov":
                return [track(view, b, e) for k, b, e in boxes(view, body, end) if k == b"trak"]
    except (struct.error, IndexError, KeyError, ValueError, OverflowError, MemoryError) as x:
        raise Malformed(str(x) or type(x).__name__) from None
    raise Malformed("no moov")


def samples(data: bytes, number: int = 0) -> bytes:
    """All samples of a track, as stored: what the sample tables point at."""
    _, starts, sizes = tracks(data)[number]
    return b"".join(data[r["start"] : r["end"]] for r in ranges(starts, sizes))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def mux(payload: bytes, frame: int = FRAME, per_chunk: int = 16, key_every: int = 8, scale: int = 25) -> bytes:
    """One video track of raw 8 x 8 frames of 8-bit samples; the payload is a multiple of the frame."""
    n = len(payload) // frame
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    mdat = box(b"mdat", payload)
    at = len(ftyp) + len(mdat) - len(payload)
    n_chunks, last = -(-n // per_chunk), n % per_chunk
    chunks = at + np.arange(n_chunks, dtype=np.int64) * (per_chunk * frame)
    wide = len(chunks) and int(chunks[-1]) >= 2**32
    runs = [(1, per_chunk, 1)] if n >= per_chunk else []
    runs += [(n_chunks, last, 1)] if last else []
    unit = struct.pack(">9I", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, 1)),
        full(b"stss", struct.pack(">I", -(-n // key_every)), (np.arange(0, n, key_every) + 1).astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", frame, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", n_chunks), chunks.astype(">u8" if wide else ">u4").tobytes()),
    )
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, scale, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"raw\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), unit, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
    mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, scale, n), struct.pack(">IH", 65536, 256), bytes(10), unit, bytes(24), struct.pack(">I", 2))
    return ftyp + mdat + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of a frame, in a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            media = [mux(r + bytes(max(FRAME, -(-len(r) // FRAME) * FRAME) - len(r))) for r in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raws), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """df without the media column, plus media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32, tracks, media_error.

    payload is what the sample tables of the first track point at, read back from the stored bytes; tail is its last 64 bytes.
    tracks has codec, duration and keyframe byte ranges of each track. Null media give nulls; malformed media have no tracks
    and say why in media_error. Own columns of those names are replaced. Repeated rows get a row each.
    """
    new = [("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("tracks", pa.list_(TRACK_ARROW), f"array<{TRACK}>"), ("media_error", pa.string(), "string")]
    kept = [c for c in df.columns if c != media and c not in {n for n, *_ in new}]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), *(f"{n} {t}" for n, _, t in new)])

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(new)
        digest = hashlib.sha256(data).hexdigest()
        try:
            found = tracks(data)
            payload = samples(data) if found else b""
            return len(data), digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), [t for t, *_ in found], None
        except Malformed as x:
            return len(data), digest, None, None, None, None, str(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(m.as_py()) for m in batch.column(batch.num_columns - 1)]
            made = [pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*kept, *(n for n, *_ in new)])

    return df.select(*kept, F.col(media).cast("binary").alias("__media")).mapInArrow(run, schema)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(store_texts(read(spark, sf_dir, "documents")))
    t = F.col("tracks")[0]
    first, last = t["keyframes"][0], F.element_at(t["keyframes"], -1)
    feature = F.concat_ws("|", t["handler"], t["codec"], F.concat_ws("x", t["width"], t["height"]), F.format_string("%.3f", t["duration"]), t["n_samples"], t["n_keyframes"], F.concat_ws("-", first["start"], last["end"]))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
