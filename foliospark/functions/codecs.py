"""Stream filters as Arrow UDFs over binary columns. Each helper handles one value; damaged input gives what could be decoded."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F


def inflate(data: bytes) -> bytes:
    """zlib; if that gives nothing, raw deflate, then raw deflate after two bytes. Cut or damaged streams give their first part."""
    for skip, bits in ((0, 15), (0, -15), (2, -15)):
        codec, out = zlib.decompressobj(bits), bytearray()
        try:
            for at in range(skip, len(data), 512):
                out += codec.decompress(data[at : at + 512])
            out += codec.flush()
        except zlib.error:
            pass
        if out:
            return bytes(out)
    return b""


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (n := data[at]) != 128:
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def run_length_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        same = 1
        while same < 128 and data[at + same : at + same + 1] == data[at : at + 1]:
            same += 1
        if same > 1:
            out += bytes([257 - same, data[at]])
            at += same
            continue
        n = 1
        while n < 128 and at + n < len(data) and data[at + n : at + n + 1] != data[at + n + 1 : at + n + 2]:
            n += 1
        out += bytes([n - 1]) + data[at : at + n]
        at += n
    return bytes(out) + b"\x80"


_DIGITS = bytes(range(33, 118))
_NO_DIGITS = bytes(c for c in range(256) if c not in _DIGITS and c != 122)
_POWERS = np.array([52200625, 614125, 7225, 85, 1])


def _ascii85_words(digits: bytes) -> bytes:
    fill = -len(digits) % 5
    groups = np.frombuffer(digits + b"u" * fill, np.uint8).reshape(-1, 5).astype(np.int64) - 33
    out = ((groups @ _POWERS) & 0xFFFFFFFF).astype(">u4").tobytes()
    return out[: len(out) - fill] if fill < 4 else out[:-4]


def ascii85(data: bytes) -> bytes:
    """Groups of five digits; z is four zeros, ~ ends, other characters (z inside a group too) are skipped, a last group is filled with u."""
    first, *others = data.split(b"~", 1)[0].translate(None, _NO_DIGITS).split(b"z")
    out, run = [], bytearray(first)
    for part in others:
        if len(run) % 5 == 0:
            out += [_ascii85_words(bytes(run)), bytes(4)]
            run = bytearray()
        run += part
    return b"".join([*out, _ascii85_words(bytes(run))])


def _lzw_widths(entries: np.ndarray) -> np.ndarray:
    return 9 + (entries >= 512) + (entries >= 1024) + (entries >= 2048)


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, 256 clears the table, 257 ends; a code beyond the next one ends decoding.

    How wide a code is depends only on how many came since the table was cleared, so codes are cut out in blocks.
    """
    raw = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64)
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, last, out = base.copy(), b"", []
    at, since, bits = 0, 0, 8 * len(data)
    while at < bits:
        nth = np.arange(since, since + min(4096, (bits - at) // 9 + 1))
        widths = np.where(nth > 0, _lzw_widths(258 + np.clip(nth - 1, 0, 3838) + early), 9)
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, bits, "right"))
        if not n:
            break
        begins, widths = ends[:n] - widths[:n], widths[:n]
        byte = begins >> 3
        codes = (((raw[byte] << 16) | (raw[byte + 1] << 8) | raw[byte + 2]) >> (24 - (begins & 7) - widths)) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(stops[0]) if len(stops) else n
        for code in codes[:stop].tolist():
            size = len(table)
            if code < size:
                entry = table[code]
            elif code == size and last:
                entry = last + last[:1]
            else:
                return b"".join(out)
            out.append(entry)
            if last and size < 4096:
                table.append(last + entry[:1])
            last = entry
        if stop == n:
            at, since = int(ends[n - 1]), since + n
        elif codes[stop] == 257:
            break
        else:
            table, last, at, since = base.copy(), b"", int(ends[stop]), 0
    return b"".join(out)


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    """Words are known by their codes: the table leads from a code and a byte to the longer word's code."""
    codes, sizes = [256], [0]  # and the decoder's entries where each code is put
    table: dict[int, int] = {}
    size, seen, word = 258, 0, -1
    for c in data:
        if word < 0:
            word = c
            continue
        key = word << 8 | c
        longer = table.get(key)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        sizes.append(seen)
        table[key] = size
        size += 1
        seen = size - 1 + early  # the decoder's table is one entry behind
        word = c
        if size >= 4094:
            codes += [word, 256]
            sizes += [seen, seen]
            table, size, seen, word = {}, 258, 0, -1
    if word >= 0:
        codes.append(word)
        sizes.append(seen)
        seen = size + early
    codes.append(257)
    sizes.append(seen)
    widths = _lzw_widths(np.array(sizes))
    ends = np.cumsum(widths)
    begins = ends - widths
    put = np.array(codes) << (24 - (begins & 7) - widths)
    out = np.zeros((int(ends[-1]) + 7) // 8 + 3, np.int64)
    for i in range(3):
        np.add.at(out, (begins >> 3) + i, (put >> (16 - 8 * i)) & 255)
    return out[:-3].astype(np.uint8).tobytes()


def png_predictor(data: bytes, columns: int = 1, colors: int = 1, bits: int = 8) -> bytes:
    """Undoes the PNG row filters; a last row that is cut short is dropped."""
    pixel, row = max(1, colors * bits // 8), (columns * colors * bits + 7) // 8
    out, above = bytearray(), bytes(row)
    for at in range(0, len(data) - row, row + 1):
        kind, line = data[at], data[at + 1 : at + 1 + row]
        if kind == 1:
            held = np.frombuffer(line, np.uint8).copy()
            for i in range(pixel):
                held[i::pixel] = np.cumsum(held[i::pixel], dtype=np.uint8)
            line = held.tobytes()
        elif kind == 2:
            line = (np.frombuffer(line, np.uint8) + np.frombuffer(above, np.uint8)).tobytes()
        elif kind == 3:
            done = [0] * pixel + list(line)
            for i, (v, b) in enumerate(zip(line, above), pixel):
                done[i] = (v + (done[i - pixel] + b) // 2) & 255
            line = bytes(done[pixel:])
        elif kind == 4:
            done = [0] * pixel + list(line)
            for i, (v, b, c) in enumerate(zip(line, above, bytes(pixel) + above), pixel):
                a = done[i - pixel]
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - c - c)
                done[i] = (v + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            line = bytes(done[pixel:])
        out += line
        above = line
    return bytes(out)


def png_encode(data: bytes, columns: int = 1, colors: int = 1) -> bytes:
    """Rows of 8-bit pixels, filtered by each of the five kinds in turn; a last row is filled with zeros."""
    row = columns * colors
    v = np.frombuffer(data + bytes(-len(data) % row), np.uint8).reshape(-1, row).astype(np.int16)
    b = np.zeros_like(v)
    b[1:] = v[:-1]
    a, c = np.zeros_like(v), np.zeros_like(v)
    a[:, colors:], c[:, colors:] = v[:, :-colors], b[:, :-colors]
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    nearest = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
    kind = np.arange(len(v)) % 5
    for k, guess in ((1, a), (2, b), (3, (a + b) // 2), (4, nearest)):
        guess = guess[kind == k]
        v[kind == k] -= guess
    return np.hstack([kind[:, None], v & 255]).astype(np.uint8).tobytes()


def tiff_predictor(data: bytes, columns: int = 1, colors: int = 1, bits: int = 8) -> bytes:
    """Undoes horizontal differences of 8 or 16 bits, or of 1, 2 or 4 bits packed in bytes."""
    row = (columns * colors * bits + 7) // 8
    out = bytearray()
    for at in range(0, len(data), row):
        line = data[at : at + row]
        if bits == 16:
            v = np.frombuffer(line[: len(line) // 2 * 2], ">u2").astype(np.int64)
        elif bits == 8:
            v = np.frombuffer(line, np.uint8).astype(np.int64)
        else:
            b = np.unpackbits(np.frombuffer(line, np.uint8)).reshape(-1, bits)
            v = b @ (1 << np.arange(bits - 1, -1, -1))
        n = columns * colors
        for c in range(colors):
            v[c:n:colors] = np.cumsum(v[c:n:colors]) % (1 << bits)
        if bits == 16:
            out += v.astype(">u2").tobytes()
        elif bits == 8:
            out += v.astype(np.uint8).tobytes()
        else:
            out += np.packbits(((v[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).ravel()).tobytes()
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = bytes(c for c in data.split(b">", 1)[0] if c in b"0123456789abcdefABCDEF")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


#: Filter names, long and short, of the filters that are decoded here; others pass through.
FILTERS: dict[str, Callable[[bytes], bytes]] = {
    "FlateDecode": inflate, "Fl": inflate, "LZWDecode": lzw, "LZW": lzw, "ASCII85Decode": ascii85, "A85": ascii85, "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex, "RunLengthDecode": run_length, "RL": run_length,
}


def decode_chain(data: bytes | None, names, parms=None) -> bytes | None:
    """data through its filters; parms has the decoding parameters (predictor, columns, colors, bits, early) of each, or null."""
    if data is None:
        return None
    for i, name in enumerate(names if names is not None else ()):
        p = parms[i] if parms is not None and i < len(parms) and parms[i] is not None else {}
        value = lambda key, default, p=p: default if p.get(key) is None else int(p[key])
        if name in ("LZWDecode", "LZW"):
            data = lzw(data, value("early", 1))
        else:
            data = FILTERS.get(name, bytes)(data)
        predictor = value("predictor", 1)
        if name in ("FlateDecode", "Fl", "LZWDecode", "LZW") and predictor > 1:
            undo = tiff_predictor if predictor == 2 else png_predictor
            data = undo(data, max(1, value("columns", 1)), max(1, value("colors", 1)), max(1, value("bits", 8)))
    return data


def decode_stream(data, names, parms):
    """Column of streams decoded through their filters (an array of names) with an array of parameters, a batch of rows at a time."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, names: pd.Series, parms: pd.Series) -> pd.Series:
        return pd.Series([decode_chain(*row) for row in zip(data, names, parms)])

    return run(data, names, parms)


def codec(f: Callable[[bytes], bytes]):
    """A binary to binary UDF; nulls stay. Values go through one at a time, without pandas. Made where a session is there."""

    @F.arrow_udf("binary")
    def run(data: pa.Array) -> pa.Array:
        return pa.array((None if (d := v.as_py()) is None else f(d) for v in data), pa.binary())

    return run


def ascii85_encode(data: bytes) -> bytes:
    fill = -len(data) % 4
    words = np.frombuffer(data + bytes(fill), ">u4").astype(np.int64)
    if not words.all():  # four zeros are z
        return base64.a85encode(data) + b"~>"
    digits = (words[:, None] // _POWERS % 85 + 33).astype(np.uint8).tobytes()
    return digits[: len(digits) - fill] + b"~>"
