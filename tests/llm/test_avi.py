import hashlib
import struct
import zlib

import numpy as np

from inkwright.llm import avi


def test_frames_come_back(rng=np.random.default_rng(1)):
    samples = rng.integers(0, 256, (5, avi.FRAME)).astype(np.uint8)
    frames = avi.encode_frames(samples)
    assert (np.stack([p.ravel() for p in avi.decode_frames(frames)]) == samples).all()
    # the whole decoder sees flat blocks of the same samples
    plane = avi.decode_baseline(frames[0])
    assert plane.shape == (avi.SIDE * 8, avi.SIDE * 8)
    assert (plane.reshape(avi.SIDE, 8, avi.SIDE, 8) == samples[0].reshape(avi.SIDE, 1, avi.SIDE, 1)).all()


def test_usual_tables_are_whole():
    for (kind, _), (lengths, values) in avi._STANDARD.items():
        assert sum(lengths) == len(values) == len(set(values)) == (162 if kind else 12)
        assert len(avi._codes(lengths, values)) == len(values)


def test_baseline_with_ac_and_usual_tables():
    """One block, written here with the usual tables: DC 40 and one AC level, against the cosine sum."""
    dc = {v: k for k, v in avi._codes(*avi._STANDARD[0, 0]).items()}
    ac = {v: k for k, v in avi._codes(*avi._STANDARD[1, 0]).items()}
    bits = ""
    put = lambda code: format(code[1], f"0{code[0]}b")
    bits += put(dc[6]) + format(40, "06b") + put(ac[0x02]) + "11" + put(ac[0])  # level 3 at the second place
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = avi._segment
    data = b"\xff\xd8" + seg(0xDB, b"\0" + b"\2" * 64) + seg(0xC0, struct.pack(">BHHBBBB", 8, 8, 8, 1, 1, 0x11, 0)) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    x = np.arange(8)
    want = 80 / 8 + 6 / 4 * np.sqrt(0.5) * np.cos((2 * x + 1) * np.pi / 16) + 128
    assert (avi.decode_baseline(data) == np.rint(np.tile(want, (8, 1)))).all()


def test_index_positions_and_none():
    frames = avi.encode_frames(np.arange(3 * avi.FRAME, dtype=np.uint64).astype(np.uint8).reshape(3, -1))
    data = avi.write_avi(frames, 3 * avi.FRAME)
    got, pace, comment = avi.read_avi(data)
    assert got == frames and pace == 40.0 and comment == f"payload {3 * avi.FRAME}"
    at = data.index(b"idx1")
    assert avi.read_avi(data[:at])[0] == frames  # without an index
    start = data.index(b"movi")
    moved = bytearray(data)
    for k in range(3):
        offset = struct.unpack_from("<I", data, at + 8 + 16 * k + 8)[0]
        struct.pack_into("<I", moved, at + 8 + 16 * k + 8, offset + start)
    assert avi.read_avi(bytes(moved))[0] == frames  # counted from the file's start


def test_shots():
    dark, light = np.full((8, 8), 10, np.uint8), np.full((8, 8), 240, np.uint8)
    assert avi.shots([]) == []
    assert avi.shots([dark]) == [(0, 1)]
    assert avi.shots([dark] * 4 + [light] * 3 + [dark]) == [(0, 4), (4, 7), (7, 8)]


def test_digests(odd, none):
    rows = avi.media_digests(odd).collect()
    assert len(rows) == odd.count()
    for r, text in zip(sorted(rows, key=lambda r: (r.n_bytes, r.doc_id or 0)), sorted(odd.collect(), key=lambda r: (len((r.text or "").encode()), r.doc_id or 0))):
        raw = (text.text or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (text.doc_id, len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_bytes > len(padded) and len(r.media_sha256) == 64 and r.n_clips == len(r.feature.split(";"))
    assert avi.media_digests(none).count() == 0


def test_clips(spark):
    planes = np.concatenate([np.full((4, avi.FRAME), 20, np.uint8), np.full((3, avi.FRAME), 220, np.uint8)])
    good = avi.write_avi(avi.encode_frames(planes), 0)
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"RIFF....")), (None, bytearray(good[:300]))], "doc_id long, media binary")
    got = {r.doc_id: r for r in avi.clips(df).filter("clip IS NULL OR clip = 1").collect()}
    assert (got[1].start_ms, got[1].end_ms, got[1].frames, got[1].error) == (160.0, 280.0, 3, None)
    assert got[2].error and got[3].error
    assert avi.clips(df.filter("false")).count() == 0


def test_features_by_brute_force(docs):
    """The shots of every stored text, from its bytes alone: a byte is a flat block, a frame FRAME bytes."""
    got = {r.doc_id: r.feature for r in avi.media_digests(docs).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        raw = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        raw = raw.ljust(-(-len(raw) // avi.FRAME) * avi.FRAME, b"\0")
        shares = []
        for at in range(0, len(raw), avi.FRAME):
            counts = [0] * 32
            for b in raw[at : at + avi.FRAME]:
                counts[b >> 3] += 1
            shares.append([c / avi.FRAME for c in counts])
        cuts, recent = [0], []
        for i in range(1, len(shares)):
            d = sum(abs(a - b) for a, b in zip(shares[i - 1], shares[i])) / 2
            mean = sum(recent[-8:]) / len(recent[-8:]) if recent else 0.0
            spread = (sum((v - mean) ** 2 for v in recent[-8:]) / len(recent[-8:])) ** 0.5 if recent else 0.0
            if d > 0.5 or (recent and d > 0.12 and d > mean + 3 * spread):
                cuts.append(i)
                recent = []
            else:
                recent.append(d)
        assert got[r.doc_id] == ";".join(f"{a * 40}-{b * 40}" for a, b in zip(cuts, [*cuts[1:], len(shares)]))
