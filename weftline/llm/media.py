"""Texts carried as WAV audio, with spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded with 255 to a positive multiple of the frame length, are the 8-bit mono samples of a WAV
file. The stored file is read back by the ``wave`` module; a short-time Fourier transform of its frames gives spectral
peaks, and pairs of peaks in near frames give the fingerprint: an array of codes (first peak's bin, second peak's bin,
frames between) with the frame where each begins.

Null and empty texts hold one frame of padding. Rows are independent of each other: repeated rows give repeated
results, an empty table an empty one, and a null id is kept. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm import _bytes
from weftline.llm._spark import map_texts

FRAME = 576
RATE = 8000
#: Peaks of a frame, and frames ahead that a pair may span.
PEAKS = 3
FAN_OUT = 3
#: Frames transformed at a time, which bounds memory for any length.
CHUNK = 4096

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, media binary, times array<int>, codes array<long>"
)
FILE = "media binary"
#: Bytes of text read at a time; a longer text is still taken whole.
GROUP_BYTES = 1 << 20


def to_wav(text: bytes) -> bytes:
    """A text's padded bytes as an 8-bit mono WAV file."""
    padded = text + b"\xff" * ((-len(text)) % FRAME or (0 if text else FRAME))
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(padded)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The strongest local maxima of each frame's spectrum, by bin: frames x PEAKS, -1 where a frame has fewer.

    Magnitudes are rounded before they are compared and ties go to the lower bin, so equal samples give equal peaks.
    """
    frames = np.frombuffer(samples, np.uint8).reshape(-1, FRAME)
    window = np.hanning(FRAME)
    found = np.empty((len(frames), PEAKS), np.int64)
    for at in range(0, len(frames), CHUNK):
        part = (frames[at : at + CHUNK].astype(np.float64) - 128.0) * window
        power = np.round(np.abs(np.fft.rfft(part, axis=1)), 3)
        inner = power[:, 1:-1]
        height = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0.0)
        best = np.argsort(-height, axis=1, kind="stable")[:, :PEAKS]
        found[at : at + CHUNK] = np.where(np.take_along_axis(height, best, 1) > 0, best + 1, -1)
    return found


def pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of peak pairs, in order of time and code."""
    times, codes = [], []
    for ahead in range(1, FAN_OUT + 1):
        if len(found) <= ahead:
            break
        first, second = found[:-ahead, :, None], found[ahead:, None, :]
        code = (first << 20) | (second << 8) | ahead
        ok = np.broadcast_to((first >= 0) & (second >= 0), code.shape)
        t = np.broadcast_to(np.arange(len(found) - ahead)[:, None, None], code.shape)
        times.append(t[ok])
        codes.append(code[ok])
    if not times:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def feature(times: np.ndarray, codes: np.ndarray) -> str:
    """A fingerprint's digest: number of pairs, then a hash of the time-coded array."""
    both = np.stack([times, codes], axis=1).astype("<i8").tobytes()
    return f"{len(times)}:{hashlib.blake2b(both, digest_size=16).hexdigest()}"


def _rows(batches: Iterator[pa.RecordBatch], file: bool) -> Iterator[pa.RecordBatch]:
    for batch in _bytes.pieces(batches, 1, size=GROUP_BYTES):
        rows, times, codes = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            media = to_wav(text or b"")
            payload = from_wav(media)
            t, c = pairs(peaks(payload))
            times.append(t)
            codes.append(c)
            rows.append((
                doc_id, len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media),
                hashlib.sha256(media).hexdigest(), feature(t, c), *([media] if file else []),
            ))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] if file else [])]
        arrays = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        offsets = pa.array(np.cumsum([0, *map(len, times)]), pa.int32())
        arrays += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), k)) for x, k in ((times, pa.int32()), (codes, pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ") if file or x != FILE])


def media_columns(documents: DataFrame) -> DataFrame:
    """Each document's WAV file, its digests, and its fingerprint as arrays of times and codes."""
    return map_texts(documents, lambda batches: _rows(batches, True), SCHEMA)


def media_features(documents: DataFrame) -> DataFrame:
    """The same without the file, which does not leave the task that makes it."""
    return map_texts(documents, lambda batches: _rows(batches, False), SCHEMA.replace(f"{FILE}, ", ""))
