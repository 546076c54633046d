"""Media columns: bytes kept losslessly in AVI motion-JPEG, read back through the RIFF index, with clips by shot.

Form. The payload's bytes are the quantised coefficients of baseline greyscale JPEG blocks (JPEG's own unit; 64 of them, hence the
padding): a value of size category 8 has eight appended bits, and these are the byte itself. All coefficients are
coded, each restart interval is one block, so nothing is predicted and any byte can be stored. Frames are 32 x 32 pixels (16
blocks, 1,024 bytes); the last is filled with zero blocks, and a chunk 'plen' of the header list has the payload's length.

Reading: walk the RIFF lists, take frames by idx1, decode each frame's Huffman data (``decode_frame`` reads any baseline greyscale frame;
frames whose codes fall on whole bytes are decoded all at once), dequantise, and transform back to pixels. Shots: a frame starts a new one when its
grey histogram differs from the previous frame's by more than the mean of the shot's differences so far plus three
deviations, and at least FLOOR. Clips are the shots, timed at FPS frames a second.

Defined results: null text is empty; an empty payload is padded to 64 zero bytes; a text of any length is kept whole; a null doc_id stays
null; repeated rows are returned each; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _blocks as B

SIDE, FPS, BINS, FLOOR = 32, 25, 16, 0.2
BLOCKS = (SIDE // 8) ** 2
FRAME = BLOCKS * 64

#: Fixed values of the JPEG format: the zigzag order of an 8 x 8 block's coefficients.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_CODES = bytes([0, 0, 0, 0, 0, 0, 0, 1] + [0] * 8) + b"\x08"  # one code of eight bits, 00000000, for run 0 and size 8
_HEAD = b"".join([
    b"\xff\xd8", _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0"),
    _segment(0xC4, b"\x00" + _CODES), _segment(0xC4, b"\x10" + _CODES), _segment(0xDD, b"\0\1"), _segment(0xDA, b"\1\1\0\0\x3f\0"),
])
_END = b"\xff\xd9"
_BODY = BLOCKS * 130 - 2
_SIZE = len(_HEAD) + _BODY + 2


def _basis() -> np.ndarray:
    """Inverse transform, 64 coefficients in zigzag order to 64 pixels, in integers of 1/512: sums stay exact in float32."""
    x = np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) / 2
    c[:, 0] /= np.sqrt(2)
    full = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * 512).astype(np.float32)


_BASIS = _basis()


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def _frames(payload: bytes) -> list[bytes] | np.ndarray:
    n = -(-len(payload) // FRAME)
    data = np.zeros((n, BLOCKS, 64), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    if 255 not in payload:
        out = np.zeros((n, _SIZE), np.uint8)
        out[:, : len(_HEAD)] = np.frombuffer(_HEAD, np.uint8)
        body = np.zeros((n, BLOCKS, 130), np.uint8)
        body[:, :, 1:128:2] = data
        body[:, :, 128] = 255
        body[:, :, 129] = 0xD0 + np.arange(BLOCKS) % 8
        out[:, len(_HEAD) : -2] = body.reshape(n, -1)[:, :-2]
        out[:, -2:] = (255, 0xD9)
        return out
    return [_HEAD + b"".join(
        b"".join(b"\0\xff\0" if x == 255 else b"\0" + bytes((x,)) for x in block.tolist()) + (bytes((255, 0xD0 + i % 8)) if i + 1 < BLOCKS else b"")
        for i, block in enumerate(frame)) + _END for frame in data]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode(payload: bytes) -> bytes:
    """An AVI file of motion-JPEG frames that holds payload (a positive multiple of 64 bytes)."""
    frames = _frames(payload)
    n = len(frames)
    if isinstance(frames, np.ndarray):
        odd = _SIZE % 2
        rows = np.zeros((n, 8 + _SIZE + odd), np.uint8)
        rows[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", _SIZE), np.uint8)
        rows[:, 8 : 8 + _SIZE] = frames
        body, sizes = rows.tobytes(), [_SIZE] * n
    else:
        body, sizes = b"".join(_chunk(b"00dc", f) for f in frames), [len(f) for f in frames]
    at, index = 4, []
    for s in sizes:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, s))
        at += 8 + s + s % 2
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, max(sizes), SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, max(sizes), 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    image = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + strl + _chunk(b"plen", struct.pack("<Q", len(payload))))
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + body) + _chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, at: int, end: int):
    """(name, start, end) of the chunks in data[at:end]."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(end, at + 8 + size)
        at += 8 + size + size % 2


def parse(media: bytes) -> tuple[list[tuple[int, int]], int | None]:
    """(start, size) of each frame by the index idx1 (by the movi list if there is none), and the payload's length."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, length = None, None, None
    for name, a, z in chunks(media, 12, len(media)):
        if name == b"LIST" and media[a : a + 4] == b"movi":
            movi = (a, z)
        elif name == b"LIST" and media[a : a + 4] == b"hdrl":
            length = next((struct.unpack_from("<Q", media, s)[0] for n, s, _ in chunks(media, a + 4, z) if n == b"plen"), None)
        elif name == b"idx1":
            index = (a, z)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        return [(a, z - a) for n, a, z in chunks(media, movi[0] + 4, movi[1]) if n[2:] in (b"dc", b"db")], length
    table = np.frombuffer(media, "<u4", (index[1] - index[0]) // 16 * 4, index[0]).reshape(-1, 4)
    return [(movi[0] + o + 8, s) for c, o, s in table[:, [0, 2, 3]].tolist() if c >> 16 in (0x6364, 0x6264)], length


def decode_frame(jpeg: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Coefficients (blocks x 64, zigzag), quantisers, width and height of a baseline greyscale JPEG."""
    at, tables, quant, every, width, height, dc, ac = 2, {}, {}, 0, 0, 0, 0, 0
    frame_q = 0
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts, code, got, k = body[1:17], 0, {}, 17
                for bits, many in enumerate(counts, 1):
                    for _ in range(many):
                        got[bits, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = got
                body = body[k:]
        elif marker == 0xC0:
            height, width, parts = struct.unpack_from(">HHB", body, 1)
            if parts != 1:
                raise ValueError("only greyscale frames are read")
            frame_q = body[8]
        elif marker in (0xC1, 0xC2, 0xC3):
            raise ValueError("only baseline frames are read")
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            dc, ac = body[2] >> 4, 16 | (body[2] & 15)
            break
    total = -(-width // 8) * -(-height // 8)
    out = np.zeros((total, 64), np.int32)
    done, data = 0, jpeg[at : jpeg.rfind(_END)]
    while done < total:
        stop = next((i for i in range(len(data) - 1) if data[i] == 255 and 0xD0 <= data[i + 1] <= 0xD7), len(data)) if every else len(data)
        raw = data[:stop].replace(b"\xff\0", b"\xff")
        data = data[stop + 2 :]
        value, left = int.from_bytes(raw, "big"), 8 * len(raw)

        def symbol(table):
            nonlocal left
            code = 0
            for bits in range(1, 17):
                left -= 1
                code = code << 1 | (value >> left & 1)  # noqa: B023
                if (bits, code) in table:
                    return table[bits, code]
            raise ValueError("no such code")

        def number(bits):
            nonlocal left
            if not bits:
                return 0
            left -= bits
            x = value >> left & ((1 << bits) - 1)  # noqa: B023
            return x if x >> (bits - 1) else x - (1 << bits) + 1

        before = 0
        for _ in range(min(every or total, total - done)):
            before += number(symbol(tables[dc]))
            out[done, 0], k = before, 1
            while k < 64:
                s = symbol(tables[ac])
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    out[done, k] = number(s & 15)
                k += 1
            done += 1
    return out, quant[frame_q], width, height


def _coefficients(media: bytes, places: list[tuple[int, int]]) -> np.ndarray:
    """Quantised coefficients, frames x blocks x 64."""
    starts = np.array([a for a, _ in places])
    if {s for _, s in places} == {_SIZE} and (len(starts) < 2 or len(set(np.diff(starts).tolist())) == 1):
        step = int(starts[1] - starts[0]) if len(starts) > 1 else _SIZE
        data = np.frombuffer(media, np.uint8)
        rows = np.lib.stride_tricks.as_strided(data[starts[0] :], (len(starts), _SIZE), (step, 1), writeable=False)
        head = np.frombuffer(_HEAD, np.uint8)
        body = np.zeros((len(starts), BLOCKS, 130), np.uint8)
        body.reshape(len(starts), -1)[:, :-2] = rows[:, len(_HEAD) : -2]
        marks = np.frombuffer(b"".join(bytes((255, 0xD0 + i % 8)) for i in range(BLOCKS - 1)), np.uint8).reshape(-1, 2)
        if (rows[:, : len(_HEAD)] == head).all() and not body[:, :, :128:2].any() and (body[:, :-1, 128:] == marks).all():
            bits = body[:, :, 1:128:2].astype(np.int16)
            return np.where(bits < 128, bits - 255, bits)
    frames = [decode_frame(media[a : a + s]) for a, s in places]
    return np.stack([f[0] for f in frames])


def decode(media: bytes) -> tuple[bytes, np.ndarray]:
    """The payload, and grey pixels (frames x blocks x 64) of a file made by encode."""
    places, length = parse(media)
    c = _coefficients(media, places)
    payload = np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()[:length]
    pixels = c.reshape(-1, 64).astype(np.float32) @ _BASIS
    return payload, np.clip(np.floor_divide(pixels + 256, 512) + 128, 0, 255).astype(np.uint8).reshape(c.shape)


def clips(pixels: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) frames of shots, by adaptive differences of grey histograms."""
    n = len(pixels)
    flat = (pixels.reshape(n, -1) >> 4).astype(np.int64)
    size = flat.shape[1]
    hist = np.bincount((flat + np.arange(n)[:, None] * BINS).ravel(), minlength=n * BINS).reshape(n, BINS)
    apart = (np.abs(np.diff(hist, axis=0)).sum(1) / (2 * size)).tolist()
    cuts, count, total, square = [0], 0, 0.0, 0.0
    for i, d in enumerate(apart, 1):
        mean = total / count if count else 0.0
        spread = max(0.0, square / count - mean * mean) ** 0.5 if count else 0.0
        if d > max(FLOOR, mean + 3 * spread):
            cuts.append(i)
            count, total, square = 0, 0.0, 0.0
        else:
            count, total, square = count + 1, total + d, square + d * d
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, media binary of each row of docs (doc_id, text)."""

    def run(batches):
        for columns, texts in B.blocks(batches):
            for a in range(0, len(texts), 500):
                yield pa.RecordBatch.from_pydict({"doc_id": columns["doc_id"].slice(a, 500).cast(pa.int64()), "media": pa.array([encode(pad(t or b"")) for t in texts[a : a + 500]], pa.binary())})

    return B.own(docs, "doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_s, end_s, frames of media (doc_id, media): one row for each shot."""

    def run(batches):
        for b in batches:
            out = []
            for d, m in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                out += [(d, i, a / FPS, z / FPS, z - a) for i, (a, z) in enumerate(clips(decode(m)[1]))] if m else []
            yield pa.RecordBatch.from_pydict({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate((("doc_id", pa.int64()), ("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())))})

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, start_s double, end_s double, frames int")


_DIGEST = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def digest(docs: DataFrame) -> DataFrame:
    """Each row of docs stored, read back and described; feature: frames, and the clips as first-last frame."""

    def run(batches):
        for columns, texts in B.blocks(batches):
            out = []
            for d, t in zip(columns["doc_id"].to_pylist(), texts, strict=True):
                media = encode(pad(t or b""))
                back, pixels = decode(media)
                shots = " ".join(f"{a}-{z}" for a, z in clips(pixels))
                out.append((d, len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(pixels)} clips={shots}"))
            yield pa.RecordBatch.from_pydict({k: pa.array([x[i] for x in out], v) for i, (k, v) in enumerate(_DIGEST.items())})

    return B.own(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media_avi(spark, sf_dir: str) -> DataFrame:
    """Every text of documents, stored as a film, read back and described."""
    return digest(B.table(spark, sf_dir, "documents"))
