"""Operator 7, media columns: AVI with motion JPEG.

``clips`` reads a binary column of AVI files: it walks the RIFF chunks, takes frame places from ``idx1`` (or from the ``movi`` list
where there is no index), decodes the intra frames (baseline JPEG, first component), and finds shots: the difference of
neighbouring frames' grey histograms is compared with an adaptive limit, the mean plus ``sigma`` standard deviations of the last
``memory`` differences. Each shot is one clip row with its times.

``store`` writes bytes losslessly as such a file. A frame is 24 x 32 pixels of 12 blocks and carries 576 bytes in the format's own unit, the quantised
DCT coefficient: byte b is the coefficient 256 + b, 48 a block in zigzag order, DC 0. All coefficients have size category 9, so with the
frame's own Huffman tables (1-bit code for category 9) each takes 10 bits and a frame's scan has a fixed layout; such frames are
coded and decoded by array operations, all others by the general Huffman decoder. Any JPEG decoder reads these frames.

Nulls and edges: a null text counts as empty, one frame of padding; a null or broken file gives no clips (``clips``); repeated rows give repeated
results; a null id is returned as null; extra columns are ignored. One file's memory is a small multiple of its size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartulary.llm.batches import map_texts

UNIT = 576
PER_BLOCK, BLOCKS_WIDE, BLOCKS_HIGH = 48, 4, 3
BLOCKS = BLOCKS_WIDE * BLOCKS_HIGH
FPS = 25
BINS, SIGMA, MEMORY, LEAST = 16, 3.0, 8, 0.25

#: The zigzag order of an 8 x 8 block, as row * 8 + column.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_COS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, codes: list[list[int]]) -> bytes:
    """A DHT body: class/id byte, counts for the lengths 1 to 16, symbols."""
    codes = codes + [[] for _ in range(16 - len(codes))]
    return bytes([kind]) + bytes(len(c) for c in codes) + bytes(s for c in codes for s in c)


HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, 8 * BLOCKS_HIGH, 8 * BLOCKS_WIDE, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, _table(0x00, [[0]]))
    + _segment(0xC4, _table(0x10, [[0x09], [0x00]]))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)
TAIL = b"\xff\xd9"
BLOCK_BITS = 1 + 10 * PER_BLOCK + 2
SCAN_BITS = BLOCK_BITS * BLOCKS
SCAN_BYTES = -(-SCAN_BITS // 8)


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _scans(payload: bytes) -> list[bytes]:
    """The entropy-coded bytes of each frame, before byte stuffing."""
    n = len(payload) // UNIT
    bits = np.ones((n, SCAN_BYTES * 8), dtype=np.uint8)
    body = bits[:, :SCAN_BITS].reshape(n, BLOCKS, BLOCK_BITS)
    body[:, :, 0] = 0  # DC difference 0
    units = body[:, :, 1 : 1 + 10 * PER_BLOCK].reshape(n, BLOCKS, PER_BLOCK, 10)
    units[..., 0] = 0  # code of category 9, no zeros before; the magnitude's first bit stays 1 (256)
    units[..., 2:] = np.unpackbits(np.frombuffer(payload, dtype=np.uint8)).reshape(n, BLOCKS, PER_BLOCK, 8)
    body[:, :, 1 : 1 + 10 * PER_BLOCK] = units.reshape(n, BLOCKS, -1)
    body[:, :, -1] = 0  # end of block: 10
    packed = np.packbits(bits, axis=1).tobytes()
    return [packed[i : i + SCAN_BYTES] for i in range(0, len(packed), SCAN_BYTES)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """An AVI 1.0 file of JPEG frames with an index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    chunks, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        chunks.append(c)
        at += len(c)
    body = header + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def store(data: bytes) -> bytes:
    """The bytes, padded to whole frames, as an AVI file."""
    frames = [HEAD + s.replace(b"\xff", b"\xff\x00") + TAIL for s in _scans(padded(data))]
    return write_avi(frames, 8 * BLOCKS_WIDE, 8 * BLOCKS_HIGH)


@dataclass
class Video:
    fps: float
    frames: list[bytes]


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a chunk runs over its parent's end")
        yield name, at + 8, size
        at += 8 + size + size % 2


def read_avi(data: bytes) -> Video:
    """The video stream's frames, by the index if there is one. ValueError for what is no AVI with motion JPEG."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    fps, movi, index, stream, n_streams = None, None, None, None, 0
    for name, at, size in _chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for inner, p, n in _chunks(data, at + 4, at + size):
                if inner == b"avih":
                    fps = 1_000_000 / max(1, struct.unpack_from("<I", data, p)[0])
                elif inner == b"LIST" and data[p : p + 4] == b"strl":
                    for part, q, _ in _chunks(data, p + 4, p + n):
                        if part == b"strh" and data[q : q + 4] == b"vids" and stream is None:
                            if data[q + 4 : q + 8].upper() != b"MJPG":
                                raise ValueError("the video is not motion JPEG")
                            stream = n_streams
                            scale, rate = struct.unpack_from("<II", data, q + 20)
                            fps = rate / scale if scale and rate else fps
                    n_streams += 1
        elif name == b"LIST" and kind == b"movi":
            movi = (at, size)
        elif name == b"idx1":
            index = (at, size)
    if movi is None or stream is None or not fps:
        raise ValueError("a part of the file is missing")
    wanted = {b"%02ddc" % stream, b"%02ddb" % stream}
    frames = []
    if index:
        entries = [struct.unpack_from("<4sIII", data, index[0] + i) for i in range(0, index[1] - 15, 16)]
        base = movi[0] if entries and data[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0
        for name, _, offset, size in entries:
            if name in wanted:
                p = base + offset + 8
                if p + size > len(data):
                    raise ValueError("the index points beyond the file")
                frames.append(data[p : p + size])
    else:
        frames = [data[p : p + n] for name, p, n in _chunks(data, movi[0] + 4, movi[0] + movi[1]) if name in wanted]
    return Video(fps, frames)


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            if self.at >= self.end:
                raise ValueError("the scan is too short")
            v = v << 1 | (self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1)
            self.at += 1
        return v

    def symbol(self, codes: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def frame_coefficients(jpeg: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """First component of a baseline JPEG: coefficients (block rows, block columns, 64 in zigzag order), its quantisation table, width, height."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, quant, huff, restart, comps = 2, {}, {}, 0, None
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = jpeg[at + 1]
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else "u1").astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC0:
            height, width, n = struct.unpack_from(">HHB", body, 1)
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("the frame is not baseline JPEG")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    else:
        raise ValueError("the frame has no scan")
    if not comps or len(comps) != body[0]:
        raise ValueError("only frames of one interleaved scan are read")
    tables = {body[1 + 2 * i]: (huff[body[2 + 2 * i] >> 4], huff[0x10 | body[2 + 2 * i] & 15]) for i in range(body[0])}
    one = len(comps) == 1
    hmax, vmax = (1, 1) if one else (max(c[1] for c in comps), max(c[2] for c in comps))
    wide, high = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    h0, v0 = (1, 1) if one else comps[0][1:3]
    out = np.zeros((high * v0, wide * h0, 64), dtype=np.int32)
    parts, last = [], at
    while True:
        p = jpeg.find(b"\xff", last)
        if p < 0 or p + 1 >= len(jpeg):
            raise ValueError("the scan has no end")
        m = jpeg[p + 1]
        if 0xD0 <= m <= 0xD7:
            parts.append(jpeg[at:p].replace(b"\xff\x00", b"\xff"))
            at = last = p + 2
        elif m == 0:
            last = p + 2
        else:
            parts.append(jpeg[at:p].replace(b"\xff\x00", b"\xff"))
            break
    mcu = 0
    for part in parts:
        bits, dc = _Bits(part), {c[0]: 0 for c in comps}
        for _ in range(restart or wide * high):
            if mcu >= wide * high:
                break
            for k, (cid, h, v, _) in enumerate(comps):
                dcs, acs = tables[cid]
                for b in range(1 if one else h * v):
                    block = np.zeros(64, dtype=np.int32)
                    dc[cid] += bits.value(bits.symbol(dcs))
                    block[0], i = dc[cid], 1
                    while i < 64:
                        s = bits.symbol(acs)
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            if i > 63:
                                raise ValueError("a block is too long")
                            block[i] = bits.value(s & 15)
                        i += 1
                    if k == 0:
                        hh, vv = (1, 1) if one else (h, v)
                        out[(mcu // wide) * vv + b // hh, (mcu % wide) * hh + b % hh] = block
            mcu += 1
    if mcu < wide * high:
        raise ValueError("the scan is too short")
    return out, quant[comps[0][3]], width, height


def _fixed_layout(frames: list[bytes]) -> np.ndarray | None:
    """Coefficients (frames, block rows, block columns, 64) where all frames have ``store``'s tables and layout; else None."""
    if not frames or not all(f.startswith(HEAD) and f.endswith(TAIL) for f in frames):
        return None
    scans = [f[len(HEAD) : -2].replace(b"\xff\x00", b"\xff") for f in frames]
    if any(len(s) != SCAN_BYTES for s in scans):
        return None
    n = len(scans)
    bits = np.unpackbits(np.frombuffer(b"".join(scans), dtype=np.uint8)).reshape(n, SCAN_BYTES * 8)[:, :SCAN_BITS].reshape(n, BLOCKS, BLOCK_BITS)
    units = bits[:, :, 1 : 1 + 10 * PER_BLOCK].reshape(n, BLOCKS, PER_BLOCK, 10)
    if bits[:, :, 0].any() or units[..., 0].any() or not units[..., 1].all() or not bits[:, :, -2].all() or bits[:, :, -1].any():
        return None
    out = np.zeros((n, BLOCKS_HIGH, BLOCKS_WIDE, 64), dtype=np.int32)
    out[..., 1 : 1 + PER_BLOCK] = np.packbits(units[..., 2:].reshape(-1)).reshape(n, BLOCKS_HIGH, BLOCKS_WIDE, PER_BLOCK).astype(np.int32) + 256
    return out


def payload_of(coefficients: np.ndarray) -> bytes:
    """The bytes that ``store`` put into the coefficients."""
    return (coefficients[..., 1 : 1 + PER_BLOCK] - 256).astype(np.uint8).tobytes()


def _pixels(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Grey samples of blocks: (..., 64 in zigzag order) to (..., 8, 8)."""
    flat = np.zeros(coefficients.shape, dtype=np.float32)
    flat[..., ZIGZAG] = coefficients * quant
    cos = _COS.astype(np.float32)
    blocks = flat.reshape(-1, 8, 8)
    return np.clip(np.rint(cos.T @ blocks @ cos) + 128, 0, 255).astype(np.uint8).reshape(*coefficients.shape[:-1], 8, 8)


def _histogram(pixels: np.ndarray) -> np.ndarray:
    return np.bincount(pixels.reshape(-1) // (256 // BINS), minlength=BINS) / pixels.size


def histograms(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray | None]:
    """Grey histograms of all frames, and the coefficients where the layout is fixed."""
    fixed = _fixed_layout(frames)
    if fixed is None:
        out = []
        for f in frames:
            coefficients, quant, width, height = frame_coefficients(f)
            grey = _pixels(coefficients, quant).transpose(0, 2, 1, 3).reshape(coefficients.shape[0] * 8, -1)
            out.append(_histogram(grey[:height, :width]))
        return np.array(out).reshape(len(frames), BINS), None
    n = len(frames)
    cells = (_pixels(fixed, np.ones(64, dtype=np.int32)) // (256 // BINS)).reshape(n, -1).astype(np.int64) + BINS * np.arange(n)[:, None]
    counts = np.bincount(cells.reshape(-1), minlength=BINS * n).reshape(n, BINS)
    return counts / cells.shape[1], fixed


def shots(hists: np.ndarray, sigma: float = SIGMA, memory: int = MEMORY, least: float = LEAST) -> list[tuple[int, int]]:
    """(first frame, end) of each shot. A cut: a difference over ``least`` and over the mean + sigma deviations of those remembered since the last cut."""
    n = len(hists)
    diffs = (np.abs(np.diff(hists, axis=0)).sum(axis=1) / 2).tolist() if n > 1 else []
    cuts, recent = [0], []
    for i, d in enumerate(diffs):
        if recent:
            mean = sum(recent) / len(recent)
            limit = mean + sigma * (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5
        else:
            limit = least
        if d > least and d > limit:
            cuts.append(i + 1)
            recent = []
        else:
            recent = [*recent[-memory + 1 :], d]
    return list(zip(cuts, [*cuts[1:], n], strict=True)) if n else []


def clips(files: DataFrame, id_col: str, content_col: str, sigma: float = SIGMA, memory: int = MEMORY, least: float = LEAST) -> DataFrame:
    """One row a shot: id, clip, first_frame, n_frames, start_s, end_s, mean_grey (of the shot's histograms). Unreadable files give one row with an error and null clip."""
    rows = files.select(F.col(id_col).alias("id"), F.col(content_col).alias("_content"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "clip", "first_frame", "n_frames", "start_s", "end_s", "mean_grey", "error"]

    def run(batches):
        for batch in batches:
            out = []
            for key, data in zip(batch.column("id").to_pylist(), batch.column("_content").to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    video = read_avi(data)
                    hists, _ = histograms(video.frames)
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    out.append((key, None, None, None, None, None, None, str(e)))
                    continue
                grey = hists @ (np.arange(BINS) * (256 // BINS) + 128 // BINS)
                for k, (a, b) in enumerate(shots(hists, sigma, memory, least)):
                    out.append((key, k, a, b - a, a / video.fps, b / video.fps, float(grey[a:b].mean()), None))
            types = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return rows.mapInArrow(run, f"id {kind}, clip long, first_frame long, n_frames long, start_s double, end_s double, mean_grey double, error string")


def _digest(data: bytes) -> tuple:
    media = store(data)
    video = read_avi(media)
    hists, fixed = histograms(video.frames)
    payload = payload_of(fixed)
    found = shots(hists)
    longest = max(b - a for a, b in found)
    feature = f"frames={len(video.frames)};shots={len(found)};longest={longest};first_cut={found[0][1]};seconds={len(video.frames) / video.fps:.2f}"
    return (
        len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
        len(media), hashlib.sha256(media).hexdigest(), feature,
    )


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def make():
        return lambda texts: list(zip(*[_digest(t or b"") for t in texts])) if texts else [[] for _ in range(7)]

    return map_texts(docs, make, schema, id_col, text_col, binary=True)


def op7_avi_media(spark, sf_dir: str) -> DataFrame:
    return stored_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
