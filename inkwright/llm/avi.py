"""AVI motion-JPEG: RIFF indexes, intra frames, and shots from adaptive histogram differences.

Payloads are stored as samples of flat 8x8 blocks: with a DC quantiser of 8 a block's DC level is
its sample less 128, so every decoder gives the sample back exactly. The frames' Huffman table
gives category s a code of 9 - s bits, so that each difference takes 9 bits in all and an
end-of-block takes one; such frames are read and written by whole arrays. Any other baseline frame
is decoded symbol by symbol.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from ._arrow import map_texts, texts

SIDE = 32  # samples, and so blocks, on a side of a stored frame
FRAME = SIDE * SIDE
FPS = 25
BINS = 32


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DC_LENGTHS = bytes([1] * 9 + [0] * 7)
_DC_VALUES = bytes(range(8, -1, -1))
_AC_LENGTHS = bytes([1] + [0] * 15)
_QUANT = bytes([0]) + bytes([8] + [1] * 63)
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, _QUANT)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + _DC_LENGTHS + _DC_VALUES + b"\x10" + _AC_LENGTHS + b"\x00")
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    words, back = np.zeros(511, np.uint64), np.zeros(512, np.int16)
    for diff in range(-255, 256):
        s = abs(diff).bit_length()
        code = (1 << (9 - s)) - 2  # ones, then a zero
        word = (code << s) | (diff if diff >= 0 else diff + (1 << s) - 1)
        words[diff + 255], back[word] = word << 1, diff
    return words, back


_WORDS, _BACK = _tables()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG bytes of each row of an (n, FRAME) array of 8-bit samples."""
    if not len(samples):
        return []
    level = samples.astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.int16(0))
    word = _WORDS[diff + 255].reshape(len(samples), FRAME // 4, 4)
    packed = word[..., 0] << np.uint64(30) | word[..., 1] << np.uint64(20) | word[..., 2] << np.uint64(10) | word[..., 3]
    scan = np.ascontiguousarray(packed.astype(">u8").view(np.uint8).reshape(len(samples), FRAME // 4, 8)[:, :, 3:]).reshape(len(samples), -1)
    return [HEADER + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in scan]


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Luma samples of each frame, as a (height, width) array; of stored frames one sample a block."""
    out: list[np.ndarray | None] = [None] * len(frames)
    fast, scans = [], []
    for i, frame in enumerate(frames):
        scan = frame[len(HEADER) : -2].replace(b"\xff\x00", b"\xff") if frame.startswith(HEADER) and frame.endswith(b"\xff\xd9") else b""
        if len(scan) == FRAME * 10 // 8:
            fast.append(i)
            scans.append(scan)
        else:
            out[i] = decode_baseline(frame)
    if fast:
        five = np.zeros((len(fast), FRAME // 4, 8), np.uint8)
        five[:, :, 3:] = np.frombuffer(b"".join(scans), np.uint8).reshape(len(fast), FRAME // 4, 5)
        packed = five.view(">u8")[..., 0].astype(np.uint64)
        word = np.stack([(packed >> np.uint64(k)) & np.uint64(1023) for k in (30, 20, 10, 0)], axis=2).reshape(len(fast), FRAME) >> np.uint64(1)
        level = np.cumsum(_BACK[word.astype(np.intp)], axis=1, dtype=np.int16) + 128
        for i, samples in zip(fast, level.astype(np.uint8)):
            out[i] = samples.reshape(SIDE, SIDE)
    return out


_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_COSINE = np.array([[(0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
def _tail(first: list[int]) -> bytes:
    """The regular end of a standard AC table: for each run from 1 the sizes from first[run - 1] to 10."""
    return bytes(run << 4 | s for run, low in enumerate(first, 1) for s in range(low, 11))


#: The usual tables, for streams that leave theirs out, as motion JPEG may.
_STANDARD = {
    (0, 0): (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    (0, 1): (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    (1, 0): (
        bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
        bytes.fromhex("0102030004110512213141061351610722711432 8191a1082342b1c11552d1f02433627282090a") + _tail([6, 5, 4, 3, 3, 3, 3, 3, 2, 2, 2, 2, 2, 1, 1]),
    ),
    (1, 1): (
        bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
        bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f1") + _tail([7, 6, 5, 3, 3, 3, 3, 2, 2, 2, 2, 2, 2, 2, 2]),
    ),
}


def _codes(lengths: bytes, values: bytes) -> dict[tuple[int, int], int]:
    code, k, out = 0, 0, {}
    for size, n in enumerate(lengths, 1):
        for _ in range(n):
            out[size, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def take(self, n: int) -> int:
        if n > self.left:
            raise ValueError("the scan ends early")
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, codes: dict) -> int:
        code = 0
        for size in range(1, 17):
            code = code << 1 | self.take(1)
            if (size, code) in codes:
                return codes[size, code]
        raise ValueError("no such code")

    def signed(self, s: int) -> int:
        v = self.take(s) if s else 0
        return v if not s or v >> (s - 1) else v - (1 << s) + 1


def decode_baseline(data: bytes) -> np.ndarray:
    """The luma plane of any 8-bit baseline frame, with restarts, subsampling and several components."""
    quant, codes = {}, {k: _codes(*v) for k, v in _STANDARD.items()}
    at, parts, interval, height, width, scan = 2, [], 0, 0, 0, []
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[k] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            break
    tables = {c: (dc, ac) for c, dc, ac in scan}
    single = len(parts) == 1
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    wide, high = (-(-width // 8), -(-height // 8)) if single else (-(-width // (8 * across)), -(-height // (8 * down)))
    first, h, v, q = parts[0]
    h, v = (1, 1) if single else (h, v)
    plane = np.zeros((high * v * 8, wide * h * 8))
    runs = re.split(rb"\xff[\xd0-\xd7]", data[at : data.rindex(b"\xff\xd9")])
    unit = 0
    for run in runs:
        bits, last = _Bits(run.replace(b"\xff\x00", b"\xff")), {p[0]: 0 for p in parts}
        for _ in range(interval or wide * high):
            if unit >= wide * high:
                break
            for name, ph, pv, pq in parts:
                for block in range(1 if single else ph * pv):
                    level = np.zeros(64)
                    dc, ac = tables[name]
                    last[name] += bits.signed(bits.symbol(codes[0, dc]))
                    level[0], k = last[name], 1
                    while k < 64:
                        pair = bits.symbol(codes[1, ac])
                        run_of, s = pair >> 4, pair & 15
                        if not s and run_of != 15:
                            break
                        k += run_of
                        if s and k < 64:
                            level[k] = bits.signed(s)
                        k += 1
                    if name == first:
                        grid = np.zeros(64)
                        grid[_ZIGZAG] = level * quant[pq]
                        y = (unit // wide * v + block // h) * 8
                        x = (unit % wide * h + block % h) * 8
                        plane[y : y + 8, x : x + 8] = _COSINE.T @ grid.reshape(8, 8) @ _COSINE + 128
            unit += 1
    return np.clip(np.rint(plane[:height, :width]), 0, 255).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], payload: int, width: int = SIDE * 8, height: int = SIDE * 8, fps: int = FPS) -> bytes:
    """A RIFF AVI file of the frames with an idx1 index; the payload's length is its comment."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload %d\0" % payload))
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movi.append(piece := _chunk(b"00dc", frame))
        at += len(piece)
    return b"RIFF" + _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))[4:]


def _walk(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[list[bytes], float, str]:
    """(frames of the first video stream in index order, milliseconds a frame, comment).

    Positions come from idx1, whether counted from the file's or from the movi list's start;
    without an index the movi list is walked. ValueError if it is no AVI file.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, pace, comment = None, None, 1000 / FPS, ""
    for name, at, size in _walk(data, 12, len(data)):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for inner, a, n in _walk(data, at + 4, at + size):
                if inner == b"avih":
                    pace = struct.unpack_from("<I", data, a)[0] / 1000 or pace
        elif name == b"LIST" and kind == b"INFO":
            for inner, a, n in _walk(data, at + 4, at + size):
                if inner == b"ICMT":
                    comment = data[a : a + n].rstrip(b"\0").decode("utf-8", "replace")
        elif name == b"LIST" and kind == b"movi":
            movi = (at, size)
        elif name == b"idx1":
            index = (at, size)
    if movi is None:
        return [], pace, comment
    if index is None:
        return [data[a : a + n] for name, a, n in _walk(data, movi[0] + 4, sum(movi)) if name[2:] in (b"dc", b"db")], pace, comment
    rows = [r for r in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]) if r[0][2:] in (b"dc", b"db")]
    base = movi[0] if rows and data[movi[0] + rows[0][2] : movi[0] + rows[0][2] + 4] == rows[0][0] else 0
    return [data[base + at + 8 : base + at + 8 + n] for _, _, at, n in rows], pace, comment


def shots(planes: list[np.ndarray], window: int = 8, times: float = 3.0, floor: float = 0.12) -> list[tuple[int, int]]:
    """Frame ranges [start, end) of shots.

    A frame starts a shot if its histogram's distance from the one before is over `floor` and over
    the mean and `times` deviations of the last `window` distances within the shot so far.
    """
    if not planes:
        return []
    histograms = np.stack([np.bincount(p.ravel() >> 3, minlength=BINS) / p.size for p in planes])
    distance = (np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2).tolist()
    out, start, recent = [], 0, []
    for i, d in enumerate(distance, 1):
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > floor and d > mean + times * spread and recent or d > 0.5:
            out.append((start, i))
            start, recent = i, []
        else:
            recent = [*recent, d][-window:]
    return [*out, (start, len(planes))]


def text_to_avi(values: list[bytes]) -> list[bytes]:
    """An AVI file for each value, padded with zeros to a positive multiple of 64 bytes."""
    sizes = [max(64, -(-len(v) // 64) * 64) for v in values]
    counts = [-(-n // FRAME) for n in sizes]
    samples = np.frombuffer(b"".join(v.ljust(k * FRAME, b"\0") for v, k in zip(values, counts)), np.uint8).reshape(-1, FRAME)
    frames, at, out = encode_frames(samples), 0, []
    for n, k in zip(sizes, counts):
        out.append(write_avi(frames[at : at + k], n))
        at += k
    return out


def payload_of(planes: list[np.ndarray], comment: str) -> bytes:
    """The bytes that text_to_avi has stored."""
    found = re.fullmatch(r"payload (\d+)", comment)
    return b"".join(p.tobytes() for p in planes)[: int(found[1]) if found else None]


def clips(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """doc_id, clip, start_ms, end_ms, frames: a timed row for each shot of every AVI file.

    Null media, files that are no AVI and frames that are no baseline JPEG give one row whose clip
    is null and whose error says why. Other columns are ignored; an empty table gives none.
    """
    from pyspark.sql import functions as F

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for doc_id, media in zip(batch["doc_id"], batch["media"]):
                try:
                    frames, pace, _ = read_avi(bytes(media) if media is not None else b"")
                    for k, (a, b) in enumerate(shots(decode_frames(frames))):
                        rows.append((doc_id, k, a * pace, b * pace, b - a, None))
                except (ValueError, IndexError, KeyError, struct.error) as bad:
                    rows.append((doc_id, None, None, None, None, str(bad)))
            yield pd.DataFrame(rows, columns=["doc_id", "clip", "start_ms", "end_ms", "frames", "error"]).astype({"clip": "Int32", "frames": "Int32"})

    return df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInPandas(run, "doc_id long, clip int, start_ms double, end_ms double, frames int, error string")


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an AVI file, read it back, and describe both; see the module for the form.

    Null or empty text: 64 zero bytes. Null ids and repeated rows pass through, one row each;
    other columns are ignored; an empty table gives none.
    """

    def run(ids: list, values: list[str]) -> dict[str, list]:
        raw = [v.encode() for v in values]
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_clips")}
        files = text_to_avi(raw)
        parsed = [read_avi(media) for media in files]
        planes, at = decode_frames([f for frames, _, _ in parsed for f in frames]), 0
        for media, (frames, pace, comment) in zip(files, parsed):
            own = planes[at : at + len(frames)]
            at += len(frames)
            payload, found = payload_of(own, comment), shots(own)
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-64:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(";".join(f"{a * pace:.0f}-{b * pace:.0f}" for a, b in found))
            out["n_frames"].append(len(frames))
            out["n_clips"].append(len(found))
        return {"doc_id": ids, "n_bytes": [len(r) for r in raw]} | out

    return map_texts(texts(df, id_col, text_col), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, n_clips int")
