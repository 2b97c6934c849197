"""Media columns: AVI motion-JPEG written and read, and shots found in it.

Writing: the payload bytes are the 8-bit grey samples of 16 x 12 frames.  Each frame is one lossless JPEG
(ITU-T T.81 process 14, SOF3, predictor 1) in a ``00dc`` chunk of a RIFF AVI file with an ``idx1`` index.
The file's Huffman table gives difference category s a code of 9 - s bits; with its s extra bits every
difference takes exactly nine bits, so frames are packed and unpacked by array operations, not bit by bit.

Reading: the RIFF tree and ``idx1`` are parsed and every frame's own markers and tables are honoured.  Frames
with a nine-bit table are unpacked together; others are decoded bit by bit: lossless ones (8 bits, one
component, predictor 1) and baseline DCT ones (any sampling, restart intervals; the first component counts).
A frame without Huffman tables, as some recorders write, takes those that the caller gives.

Shots: 16-bin histograms of neighbouring frames differ by their L1 distance; a cut is a local maximum that
stands out from the mean and deviation of the distances around it.  Clips are the runs between cuts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .shingles import slices

WIDTH, HEIGHT, FPS = 16, 12, 25
FRAME = WIDTH * HEIGHT
#: Payloads are padded with this byte up to a multiple of ``FRAME``.
PAD = 32
#: Differences of frames at either side that the adaptive threshold is taken from, its deviations, and the least distance of a cut as a share of a frame's samples.
WINDOW, DEVIATIONS, LEAST = 8, 2.0, 0.25
BINS = 16
#: Frames that are held decoded at once.
BLOCK = 8192

_CATEGORIES = 9
_BITS = 9


def _category(d: np.ndarray) -> np.ndarray:
    """Bits of |d|."""
    return np.ceil(np.log2(np.abs(d) + 1)).astype(np.int64)


@lru_cache(maxsize=1)
def _nine_bits() -> tuple[np.ndarray, np.ndarray]:
    """(code of each difference -255..255, at index d + 255; difference of each 9-bit word)."""
    d = np.arange(-255, 256)
    s = _category(d)
    # canonical codes by length: category 8 has 1 bit, ... category 0 has 9
    first, code = {}, 0
    for length in range(1, _BITS + 1):
        first[_BITS - length] = code
        code = (code + 1) << 1
    head = np.array([first[int(x)] for x in s])
    extra = np.where(d < 0, d + (1 << s) - 1, d)
    word = (head << s) | extra
    back = np.zeros(1 << _BITS, np.int16)
    back[word] = d
    return word.astype(np.uint16), back


def _jpeg_head(width: int, height: int) -> bytes:
    counts = bytes([1] * _CATEGORIES + [0] * (16 - _CATEGORIES))  # one code of each length 1 to 9
    table = counts + bytes(range(_CATEGORIES - 1, -1, -1))
    return b"".join((
        b"\xff\xd8",
        b"\xff\xc4" + struct.pack(">HB", 3 + len(table), 0) + table,
        b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, height, width, 1, 1, 0x11, 0),
        b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0),
    ))


def _pack(samples: np.ndarray) -> np.ndarray:
    """(frames, height, width) samples to (frames, bytes) of entropy-coded data before byte stuffing."""
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    words = _nine_bits()[0][d.reshape(len(x), -1, 8) + 255].astype(np.uint64)  # 8 words make 9 bytes
    out = np.empty((*words.shape[:2], 9), np.uint8)
    for i in range(9):  # byte i takes the low bits of word i - 1 and the high bits of word i
        v = words[:, :, i] >> np.uint64(i + 1) if i < 8 else np.uint64(0)
        if i:
            v = v | (words[:, :, i - 1] << np.uint64(8 - i))
        out[:, :, i] = v & np.uint64(255)
    return out.reshape(len(x), -1)


def _unpack(data: np.ndarray, height: int, width: int, back: np.ndarray) -> np.ndarray:
    """The inverse of ``_pack``."""
    b = data.reshape(len(data), -1, 9).astype(np.uint16)
    words = np.empty((*b.shape[:2], 8), np.uint16)
    for i in range(8):  # word i is 9 bits from bit 9 i on: 8 - i bits of byte i, i + 1 of the next
        words[:, :, i] = ((b[:, :, i] << (i + 1)) | (b[:, :, i + 1] >> (7 - i))) & 511
    d = back[words.reshape(len(data), height, width)].astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


def write_avi(payload: bytes, width: int = WIDTH, height: int = HEIGHT, fps: int = FPS) -> bytes:
    """An AVI whose frames hold ``payload``, the last frame filled up with ``PAD``; at least one frame.

    width * height must be a multiple of 8.
    """
    size = width * height
    n = max(1, -(-len(payload) // size))
    samples = np.frombuffer(payload.ljust(n * size, bytes([PAD])), np.uint8).reshape(n, height, width)
    head, chunks, index, at = _jpeg_head(width, height), [], [], 4
    for lo in range(0, n, BLOCK):
        data = _pack(samples[lo : lo + BLOCK])
        raw, step = data.tobytes(), data.shape[1]
        for k in range(0, len(raw), step):
            body = head + raw[k : k + step].replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
            m = len(body)
            chunks.append(b"00dc" + m.to_bytes(4, "little") + body + (b"\x00" if m & 1 else b""))
            index.append((at, m))
            at += 8 + m + (m & 1)
    movi = b"movi" + b"".join(chunks)
    entry = np.zeros(n, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    entry["id"], entry["flags"], entry["at"], entry["size"] = b"00dc", 16, [a for a, _ in index], [m for _, m in index]
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 16, n, 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, fps, 0, n, 0, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", size, 0, 0, 0, 0)
    strl = _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf))
    body = _list(b"hdrl", _chunk(b"avih", avih) + strl) + _chunk(b"LIST", movi) + _chunk(b"idx1", entry.tobytes())
    return _chunk(b"RIFF", b"AVI " + body)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def _chunks(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks in data[lo:hi]."""
    while lo + 8 <= hi:
        n = int.from_bytes(data[lo + 4 : lo + 8], "little")
        if lo + 8 + n > hi:
            raise ValueError("a RIFF chunk passes the end of its list")
        yield data[lo : lo + 4], lo + 8, lo + 8 + n
        lo += 8 + n + (n & 1)


def riff_index(avi: bytes) -> tuple[int, list[tuple[int, int]]]:
    """Frames a second, and (start, end) of every video frame in the order of ``idx1``.  What is no such file, or is cut short, raises ValueError."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    period, movi, frames = 0, None, None
    end = 8 + int.from_bytes(avi[4:8], "little")
    if end > len(avi):
        raise ValueError("the file is cut short")
    for name, a, z in _chunks(avi, 12, end):
        kind = avi[a : a + 4] if name == b"LIST" else name
        if kind == b"hdrl":
            period = next((int.from_bytes(avi[x : x + 4], "little") for c, x, _ in _chunks(avi, a + 4, z) if c == b"avih"), 0)
        elif kind == b"movi":
            movi = a
        elif kind == b"idx1" and movi is not None:
            e = np.frombuffer(avi, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), (z - a) // 16, a)
            e = e[[x[2:] in (b"dc", b"db") for x in e["id"].tolist()]]
            at, size = e["at"].astype(np.int64), e["size"].astype(np.int64)
            # places count from the list's name, in some files from the beginning
            base = movi if not len(e) or avi[movi + at[0] : movi + at[0] + 4] == bytes(e["id"][0]) else 0
            start = at + base + 8
            if len(e) and (start + size).max() > len(avi):
                raise ValueError("the index passes the end of the file")
            frames = list(zip(start.tolist(), (start + size).tolist(), strict=True))
    if frames is None:
        raise ValueError("no index of frames")
    if frames and not period:
        raise ValueError("no frame rate")
    return round(1_000_000 / period) if period else 0, frames


class Head:
    """What the markers before a frame's entropy-coded data say."""

    def __init__(self, head: bytes, tables: bytes = b""):
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, dict[tuple[int, int], int]] = {}
        self.parts: list[tuple[int, int, int, int]] = []  # (id, across, down, quantisation)
        self.scan: list[tuple[int, int, int]] = []  # (id, dc table, ac table)
        self.height = self.width = self.process = self.restart = self.predictor = 0
        self.back: np.ndarray | None = None
        for data in (tables, head[2:]):
            at = 0
            while at + 4 <= len(data):
                if data[at] != 0xFF:
                    raise ValueError("a marker is missing")
                marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
                self._segment(marker, data[at + 4 : at + 2 + n])
                at += 2 + n
        if not (self.height and self.width and self.scan):
            raise ValueError("a frame lacks its size or scan")

    def _segment(self, marker: int, seg: bytes) -> None:
        if marker == 0xC4:
            while seg:
                counts, at, code, table = seg[1:17], 17, 0, {}
                for length, m in enumerate(counts, 1):
                    for k in range(m):
                        table[(length, code)] = seg[at + k]
                        code += 1
                    at, code = at + m, code << 1
                self.huffman[seg[0]] = table
                seg = seg[at:]
        elif marker == 0xDB:
            while seg:
                wide = seg[0] >> 4
                size = 128 if wide else 64
                self.quant[seg[0] & 15] = np.frombuffer(seg, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                seg = seg[1 + size :]
        elif marker == 0xDD:
            self.restart = int.from_bytes(seg[:2], "big")
        elif marker in (0xC0, 0xC1, 0xC3):
            self.process = marker
            if seg[0] != 8:
                raise ValueError("samples are not of 8 bits")
            self.height, self.width = struct.unpack(">HH", seg[1:5])
            self.parts = [(seg[6 + 3 * i], seg[7 + 3 * i] >> 4, seg[7 + 3 * i] & 15, seg[8 + 3 * i]) for i in range(seg[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("neither a baseline nor a lossless frame")
        elif marker == 0xDA:
            self.scan = [(seg[1 + 2 * i], seg[2 + 2 * i] >> 4, seg[2 + 2 * i] & 15) for i in range(seg[0])]
            self.predictor = seg[1 + 2 * seg[0]]
            if self.process == 0xC3 and (len(self.parts) != 1 or self.predictor != 1):
                raise ValueError("a lossless frame of another kind")
            if self.process == 0xC3 and not self.restart and 0 in self.huffman and all(n + s == _BITS for (n, _), s in self.huffman[0].items()):
                self.back = np.zeros(1 << _BITS, np.int16)
                for (_, code), s in self.huffman[0].items():
                    extra = np.arange(1 << s)
                    self.back[(code << s) + extra] = np.where(extra < (1 << s) >> 1, extra - (1 << s) + 1, extra)


@lru_cache(maxsize=64)
def _parse_head(head: bytes, tables: bytes = b"") -> Head:
    return Head(head, tables)


class Bits:
    """Bits of entropy-coded data without its stuffing, in the intervals between restart markers."""

    def __init__(self, data: bytes):
        self.data, self.at, self.left, self.word = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            if self.at >= len(self.data):
                raise ValueError("a frame's data end early")
            self.word, self.left, self.at = (self.word << 8) | self.data[self.at], self.left + 8, self.at + 1
        self.left -= n
        out = self.word >> self.left
        self.word &= (1 << self.left) - 1
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[(n, code)]
        raise ValueError("no such code")

    def number(self, size: int) -> int:
        """A number of ``size`` bits; the lower half of its range is negative."""
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _zigzag() -> np.ndarray:
    """Places in an 8 x 8 block in the order of the diagonals, which run up and down by turns."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


_ZIGZAG = _zigzag()
_COSINE = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _intervals(body: bytes) -> list[Bits]:
    """The data between restart markers."""
    cut, at, lo = [], 0, 0
    while (at := body.find(b"\xff", at)) >= 0 and at + 1 < len(body):
        if 0xD0 <= body[at + 1] <= 0xD7:
            cut.append(body[lo:at])
            lo = at + 2
        at += 2
    return [Bits(x.replace(b"\xff\x00", b"\xff")) for x in [*cut, body[lo:]]]


def decode_frame(head: Head, body: bytes) -> np.ndarray:
    """(height, width) samples of one frame, bit by bit; of several components the first."""
    try:
        return _lossless(head, _intervals(body)) if head.process == 0xC3 else _baseline(head, _intervals(body))
    except KeyError as missing:
        raise ValueError(f"a frame lacks table {missing}") from None
    except IndexError:
        raise ValueError("a frame's data end early") from None


def _lossless(head: Head, runs: list[Bits]) -> np.ndarray:
    table, out = head.huffman[head.scan[0][1] & 15], np.zeros((head.height, head.width), np.int64)
    rows = head.restart // head.width if head.restart else head.height
    for y in range(head.height):
        bits, first = runs[y // rows], y % rows == 0
        left = 128 if first else int(out[y - 1, 0])
        for x in range(head.width):
            left = out[y, x] = (left + bits.number(bits.symbol(table))) & 0xFFFF
    return out.astype(np.uint8)


def _baseline(head: Head, runs: list[Bits]) -> np.ndarray:
    across, down = max(p[1] for p in head.parts), max(p[2] for p in head.parts)
    alone = len(head.scan) == 1
    _, h, v, q = head.parts[0]
    width, height = -(-head.width * h // across), -(-head.height * v // down)
    wide, high = (-(-width // 8), -(-height // 8)) if alone else (-(-head.width // (8 * across)) * h, -(-head.height // (8 * down)) * v)
    out = np.zeros((8 * high, 8 * wide))
    units = wide * high if alone else (wide // h) * (high // v)
    per_row = wide if alone else wide // h
    by_id = {p[0]: p for p in head.parts}
    for unit in range(units):
        if unit == 0 or (head.restart and unit % head.restart == 0):
            bits, before = runs[unit // head.restart if head.restart else 0], dict.fromkeys(by_id, 0)
        for part, dc, ac in head.scan:
            _, hp, vp, qp = by_id[part]
            for k in range(1 if alone else hp * vp):
                block = np.zeros(64)
                before[part] += bits.number(bits.symbol(head.huffman[dc]))
                block[0] = before[part] * head.quant[qp][0]
                i = 1
                while i < 64:
                    rs = bits.symbol(head.huffman[16 | ac])
                    if rs & 15:
                        i += rs >> 4
                        block[_ZIGZAG[i]] = bits.number(rs & 15) * head.quant[qp][i]
                    elif rs != 0xF0:
                        break
                    else:
                        i += 15
                    i += 1
                if part == head.parts[0][0]:
                    y, x = divmod(unit, per_row)
                    if not alone:
                        y, x = y * v + k // h, x * h + k % h
                    out[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = _COSINE.T @ block.reshape(8, 8) @ _COSINE
    return np.clip(np.rint(out[:height, :width] + 128), 0, 255).astype(np.uint8)


def read_frames(avi: bytes, frames: list[tuple[int, int]], tables: bytes = b"") -> Iterator[np.ndarray]:
    """Blocks of (frames, height, width) samples.  ``tables``: Huffman tables (DHT segments) of frames that bring none."""
    shape = None
    for lo in range(0, len(frames), BLOCK):
        heads, bodies = [], []
        for a, z in frames[lo : lo + BLOCK]:
            jpeg = avi[a:z]
            sos = jpeg.find(b"\xff\xda")
            if jpeg[:2] != b"\xff\xd8" or sos < 0:
                raise ValueError("a frame is no JPEG")
            start = sos + 2 + int.from_bytes(jpeg[sos + 2 : sos + 4], "big")
            heads.append(_parse_head(jpeg[:start], tables))
            stop = jpeg.rfind(b"\xff\xd9")
            bodies.append(jpeg[start : stop if stop >= start else None])
        if len({(h.height, h.width) for h in heads} | ({shape} if shape else set())) > 1:
            raise ValueError("frames differ in size")
        shape = (heads[0].height, heads[0].width)
        if len(set(map(id, heads))) == 1 and heads[0].back is not None and shape[0] * shape[1] % 8 == 0:
            data = b"".join(b.replace(b"\xff\x00", b"\xff") for b in bodies)
            if len(data) != len(bodies) * shape[0] * shape[1] * _BITS // 8:
                raise ValueError("a frame's data end early")
            yield _unpack(np.frombuffer(data, np.uint8).reshape(len(bodies), -1), *shape, heads[0].back)
        else:
            yield np.stack([decode_frame(h, b) for h, b in zip(heads, bodies, strict=True)])


def histograms(samples: np.ndarray) -> np.ndarray:
    flat = (samples.reshape(len(samples), -1) >> 4).astype(np.int32) + BINS * np.arange(len(samples), dtype=np.int32)[:, None]
    return np.bincount(flat.ravel(), minlength=BINS * len(samples)).reshape(-1, BINS)


def find_cuts(hist: np.ndarray, area: int = FRAME) -> list[int]:
    """Frames at which a new shot begins, after the first."""
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1).astype(np.int64)
    n = len(d)
    if n < 2:
        return []
    lo, hi = np.maximum(np.arange(n) - WINDOW, 0), np.minimum(np.arange(n) + WINDOW + 1, n)
    s1, s2 = np.concatenate(([0], np.cumsum(d))), np.concatenate(([0], np.cumsum(d * d)))
    # the distance itself is left out of its surroundings
    m = hi - lo - 1
    mean = (s1[hi] - s1[lo] - d) / m
    spread = np.sqrt(np.maximum((s2[hi] - s2[lo] - d * d) / m - mean * mean, 0))
    peak = (d >= np.concatenate(([0], d[:-1]))) & (d > np.concatenate((d[1:], [0])))
    return (np.flatnonzero(peak & (d >= LEAST * area) & (d > mean + DEVIATIONS * spread)) + 1).tolist()


def clips(avi: bytes, tables: bytes = b"") -> tuple[bytes, list[tuple[int, int, int, int, int]]]:
    """The samples as bytes, and the clips: (first frame, end frame, start ms, end ms, mean sample in 1/256)."""
    fps, frames = riff_index(avi)
    raw, hists, sums, area = [], [], [], 0
    for block in read_frames(avi, frames, tables):
        raw.append(block.tobytes())
        hists.append(histograms(block))
        sums.append(block.reshape(len(block), -1).sum(axis=1, dtype=np.int64))
        area = block.shape[1] * block.shape[2]
    if not frames:
        return b"", []
    total = np.concatenate(([0], np.cumsum(np.concatenate(sums))))
    edges = [0, *find_cuts(np.concatenate(hists), area), len(frames)]
    return b"".join(raw), [(a, z, a * 1000 // fps, z * 1000 // fps, int((total[z] - total[a]) * 256 // (area * (z - a)))) for a, z in zip(edges, edges[1:], strict=False)]


def clip_rows(media: DataFrame, media_col: str = "media", id_col: str = "doc_id", tables: bytes = b"") -> DataFrame:
    """One row per clip of every AVI: the id, clip, first_frame, end_frame, start_ms, end_ms, mean256, error (null).

    Null media have no rows, files without frames neither.  A value that can't be read (no AVI, cut short,
    frames of other kinds or of unequal sizes) is one row with its ``error`` and nulls; it ends no job.
    """
    from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

    ints = ["clip", "first_frame", "end_frame"]
    names = [*ints, "start_ms", "end_ms", "mean256", "error"]
    kinds = [*([IntegerType()] * 3), LongType(), LongType(), IntegerType(), StringType()]
    types = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.int32(), pa.string()]
    narrow = media.select(F.col(id_col), F.col(media_col))

    def read(value: bytes) -> list[tuple]:
        try:
            return [(k, *c, None) for k, c in enumerate(clips(value, tables)[1])]
        except (ValueError, struct.error) as why:
            return [(*[None] * 6, str(why))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *c) for i, m in enumerate(b.column(1)) if m.is_valid for c in read(m.as_py())]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], [b.schema.field(0).name, *names])

    return mapped(narrow, run, StructType([narrow.schema.fields[0], *(StructField(n, k) for n, k in zip(names, kinds, strict=True))]))


def media_column(docs: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """``docs`` with the binary column ``out`` (replaced if there already): each text (null: empty) as an AVI."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    base = docs.drop(out)
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                media = pa.array([write_avi(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, media], [*b.schema.names, out])

    return mapped(base, run, StructType([*base.schema.fields, StructField(out, BinaryType())]))


def digest(text: str | None) -> tuple:
    """Writes and reads one text back; what the digest columns say of it comes from what was read."""
    body = (text or "").encode()
    avi = write_avi(body)
    payload, cut = clips(avi)
    feature = f"frames={len(payload) // FRAME};clips={len(cut)};" + ",".join(f"{a}-{z}@{s}ms:{m}" for a, z, s, _, m in cut)
    return (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(avi), hashlib.sha256(avi).hexdigest(), feature)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Each text is written as an AVI and its clips are read from that AVI, text by text, so memory holds one
    batch of texts and one file.  Null and empty texts are one frame of padding.  Equal texts give equal values.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digest(t.as_py()) for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types[1:], strict=True))], names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return mapped(docs.select(F.col(id_col), F.col(text_col)), run, schema)
