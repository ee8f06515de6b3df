"""Telephony audio columns.

Mu-law and A-law samples are expanded by 256-entry tables, IMA ADPCM blocks are
decoded with numpy across all blocks of a batch (one step of every block at a
time), and the result is stored as resampled 16-bit PCM.  Stored forms are WAV
files in memory: tag 7 (mu-law), 6 (A-law), 17 (IMA ADPCM), 1 (PCM).

Edge cases: null bytes count as empty; bytes that are not a WAV file of a known
tag decode to null with ``status`` naming the reason, never an exception; a last
ADPCM block that is cut short is decoded as far as it goes; repeated rows and
equal bytes give equal results.
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

from .common import buffers, slices

#: Bytes of a storage unit (one ADPCM block), and the byte that fills the last one up.
BLOCK, FILL = 576, 255
RATE, OUT_RATE = 8000, 16000
MULAW, ALAW, ADPCM, PCM = 7, 6, 17, 1

# Fixed values of the IMA ADPCM format.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEP_SIZE = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law byte (ITU-T G.711)."""
    u = ~np.arange(256) & 255
    t = ((((u & 15) << 3) + 132) << ((u & 112) >> 4)) - 132
    return np.where(u & 128, -t, t).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law byte (ITU-T G.711)."""
    a = np.arange(256) ^ 85
    part, seg = (a & 15) << 4, (a & 112) >> 4
    t = np.where(seg == 0, part + 8, (part + 264) << np.maximum(seg - 1, 0))
    return np.where(a & 128, t, -t).astype(np.int16)


_MULAW, _ALAW = mulaw_table(), alaw_table()
# what a code's three low bits add to the predictor, by step index
_DELTA = sum(np.where(np.arange(8)[None, :] & bit, STEP_SIZE[:, None] >> shift, 0) for bit, shift in ((4, 0), (2, 1), (1, 2))) + (STEP_SIZE[:, None] >> 3)
_CODE = np.arange(16)
_SIGNED = np.where(_CODE & 8, -_DELTA[:, _CODE & 7], _DELTA[:, _CODE & 7]).astype(np.int32).ravel()  # step index * 16 + code
_NEXT = np.clip(np.arange(89)[:, None] + INDEX_STEP[_CODE & 7], 0, 88).astype(np.int32).ravel() * 16


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples of each row of an (n, size) array of IMA ADPCM blocks: the header's, then two a byte."""
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    state = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(size - 4):
        for k, code in enumerate((data[i] & 15, data[i] >> 4)):
            at = state + code
            value += _SIGNED[at]
            np.clip(value, -32768, 32767, out=value)
            state = _NEXT[at]
            out[2 * i + 1 + k] = value
    return out.T


def resample(x: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, and a six-tap filter in 1/256 steps gives those between."""
    if not len(x):
        return np.zeros(0, np.int16)
    p = np.empty(len(x) + 5, np.int32)
    p[2:-3], p[:2], p[-3:] = x, x[0], x[-1]
    n = len(x)
    mid = (3 * (p[:n] + p[5:]) - 25 * (p[1 : n + 1] + p[4 : n + 4]) + 150 * (p[2 : n + 2] + p[3 : n + 3]) + 128) >> 8
    out = np.empty(2 * n, np.int16)
    out[::2] = x
    out[1::2] = np.clip(mid, -32768, 32767)
    return out


def wav(data: bytes, tag: int, rate: int = RATE, block: int = 1, bits: int = 8) -> bytes:
    """A mono WAV file around encoded bytes."""
    samples = len(data) // 2 if tag == PCM else (len(data) // block) * (2 * (block - 4) + 1) if tag == ADPCM else len(data)
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if tag == ADPCM else struct.pack("<H", 0)
    per_second = rate * block if tag != ADPCM else rate * block // (2 * (block - 4) + 1)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(file: bytes) -> tuple[int, int, int, bytes]:
    """Tag, rate, block size and encoded bytes; ``ValueError`` if the file is not one."""
    if len(file) < 12 or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt " and size >= 16:
            if at + 24 > len(file):
                raise ValueError("cut format chunk")
            head = struct.unpack_from("<HHIIHH", file, at + 8)
        elif name == b"data":
            if head is None:
                raise ValueError("no format chunk")
            if head[1] != 1:
                raise ValueError("not mono")
            return head[0], head[2], head[4], file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode(file: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a WAV file."""
    tag, rate, block, data = read_wav(file)
    raw = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return rate, _MULAW[raw]
    if tag == ALAW:
        return rate, _ALAW[raw]
    if tag == PCM:
        return rate, np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    if tag == ADPCM and block > 4:
        whole = len(raw) // block * block
        parts = [adpcm_decode(raw[:whole].reshape(-1, block)).ravel()] if whole else []
        if len(raw) - whole > 4:
            parts.append(adpcm_decode(raw[whole:].reshape(1, -1)).ravel())
        return rate, np.concatenate(parts) if parts else np.zeros(0, np.int16)
    raise ValueError(f"unknown tag {tag}")


def to_pcm(media: DataFrame, column: str, key: str) -> DataFrame:
    """``key``, ``pcm`` (a resampled 16-bit PCM WAV file, or null) and ``status`` of every row; no shuffle."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "m"):
            made, status = [], []
            for file in b.column("m").to_pylist():
                try:
                    rate, x = decode(file or b"")
                    if rate >= 1 << 30:  # four times it must fit 32 bits
                        raise ValueError("rate out of range")
                    made.append(wav(resample(x).tobytes(), PCM, 2 * rate, 2, 16))
                    status.append("ok")
                except ValueError as e:
                    made.append(None)
                    status.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(made, pa.binary()), pa.array(status, pa.string())], names=["k", "pcm", "status"])

    out = media.select(F.col(key).alias("k"), F.col(column).alias("m")).mapInArrow(run, f"k {kind}, pcm binary, status string")
    return out.withColumnRenamed("k", key)


def payload(text: bytes) -> bytes:
    """The bytes filled up to a positive multiple of ``BLOCK``."""
    return text + bytes([FILL]) * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def _loudness(x: np.ndarray) -> tuple[int, int, int]:
    """Root mean square, peak and sign changes."""
    wide = x.astype(np.int64)
    return int(np.sqrt(np.dot(wide, wide) // max(len(x), 1))), int(np.abs(wide).max(initial=0)), int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))


def describe(texts: list[bytes]) -> list[tuple]:
    """Media columns of each text; see ``audio_query``.

    The payload is stored as mu-law samples, one byte each, so that nothing is lost.  The stored
    bytes are read back and expanded three ways: as mu-law (resampled to 16 kHz), as A-law, and as
    ADPCM blocks of ``BLOCK`` bytes, all blocks of all texts together.
    """
    files = [wav(payload(t), MULAW) for t in texts]
    back = [read_wav(f)[3] for f in files]
    raw = np.frombuffer(b"".join(back), np.uint8)
    decoded = adpcm_decode(raw.reshape(-1, BLOCK))
    first = np.concatenate([[0], np.cumsum([len(p) // BLOCK for p in back])])
    out = []
    for i, (text, file, data) in enumerate(zip(texts, files, back, strict=True)):
        samples = np.frombuffer(data, np.uint8)
        pcm = resample(_MULAW[samples])
        rms, peak, turns = _loudness(pcm)
        blocks = decoded[first[i] : first[i + 1]]
        feature = f"rate={OUT_RATE};samples={len(pcm)};rms={rms};peak={peak};turns={turns};pcm={zlib.crc32(pcm.tobytes()):08x};alaw={_loudness(_ALAW[samples])[0]};adpcm={zlib.crc32(np.ascontiguousarray(blocks).tobytes()):08x}"
        out.append((len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature))
    return out


COLUMNS = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def audio_query(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``op10``: what storing each whole text as telephony audio and reading it back gives; no shuffle."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", *(c.split()[0] for c in COLUMNS.split(", "))]
        types = [pa.int64() if c.endswith("bigint") else pa.string() for c in COLUMNS.split(", ")]
        for b in slices(batches, "t"):
            data, offsets = buffers(b.column("t"))
            whole = data.tobytes()
            rows = describe([whole[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    out = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, {COLUMNS}")
    return out.withColumnRenamed("k", key)
