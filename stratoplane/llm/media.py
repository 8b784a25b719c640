"""Media columns: byte payloads stored as 8-bit mono WAV, and spectral-peak pair fingerprints of what is read back.

``store_wav`` wraps each payload with the wave module and writes the media to the shared store; ``fingerprints`` reads the stored
bytes with the wave module, takes a short-time Fourier transform and finds its peaks: places in time and frequency that are
strongest among their neighbours, PEAKS of a frame at most. Each peak is paired with the next FAN ones, up to
REACH frames later. A fingerprint is the array of these pairs as longs, time << 17 | f1 << 10 | f2 << 3 | dt, in time order. Both are
row-wise maps without a shuffle; a payload's frames are worked through in blocks, so memory is bounded by the payload itself.

Null payloads count as empty; every payload is padded with zero bytes to a positive multiple of UNIT, so the empty one is
UNIT zero bytes and has frames too. Equal payloads give equal media and fingerprints, in repeated rows as well; null ids are ids like
others. Extra columns of the input are dropped. Empty tables give empty results.
"""

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shared_store import written
from ..tables import table
from .arrowrows import map_rows

UNIT, RATE = 64, 8000
#: Samples of a frame, samples from frame to frame, frames per block.
FRAME, HOP, BLOCK = 256, 128, 4096
#: Frequencies and frames to either side that a peak must exceed, peaks of a frame, following peaks it is paired with, frames these may be later.
NEAR_F, NEAR_T, PEAKS, FAN, REACH = 4, 1, 3, 6, 7


def wav_bytes(payload: bytes) -> bytes:
    """The padded payload as an 8-bit mono WAV file."""
    payload += bytes(-len(payload) % UNIT or (0 if payload else UNIT))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def wav_samples(media: bytes) -> bytes:
    """The samples of a WAV file made by wav_bytes."""
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectrogram(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Power of the frames from lo to hi at frequencies 1 to FRAME/2 - 1; frame t is centred at sample t * HOP, with silence around
    the samples."""
    begin, end = lo * HOP - FRAME // 2, (hi - 1) * HOP + FRAME // 2
    part = x[max(0, begin) : end].astype(np.float32) - np.float32(128)
    front = max(0, -begin)
    part = np.pad(part, (front, end - begin - front - len(part)))
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
    # Without its mean, or a frame's level would drown its lowest frequency.
    spectrum = np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * np.hanning(FRAME).astype(np.float32), axis=1)[:, 1 : FRAME // 2]
    return spectrum.real**2 + spectrum.imag**2


def _highest(power: np.ndarray, near: int, axis: int) -> np.ndarray:
    """The maximum over the places up to ``near`` away along an axis."""
    out, n = power.copy(), power.shape[axis]
    for d in range(1, min(near, n - 1) + 1):
        ahead, behind = [slice(None)] * 2, [slice(None)] * 2
        ahead[axis], behind[axis] = slice(d, None), slice(None, n - d)
        np.maximum(out[tuple(behind)], power[tuple(ahead)], out=out[tuple(behind)])
        np.maximum(out[tuple(ahead)], power[tuple(behind)], out=out[tuple(ahead)])
    return out


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequencies (1 up to FRAME/2 - 1) of the spectral peaks, in order; the shortest payload
    has two frames, before and behind its middle."""
    x = np.frombuffer(samples, np.uint8)
    n, times, places = 1 + -(-len(x) // HOP), [], []
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        first, last = max(0, lo - NEAR_T), min(n, hi + NEAR_T)
        power = spectrogram(x, first, last)
        top = (power >= _highest(_highest(power, NEAR_F, 1), NEAR_T, 0)) & (power > 0)
        power = np.where(top, power, 0)[lo - first : hi - first]
        best = np.sort(np.argsort(-power, axis=1, kind="stable")[:, :PEAKS], axis=1)
        t, k = np.nonzero(np.take_along_axis(power, best, axis=1))
        times.append(t + lo)
        places.append(1 + best[t, k])
    return np.concatenate(times), np.concatenate(places)


def peak_pairs(time: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Time-coded pairs of each peak with the next FAN peaks, of its own frame or up to REACH frames later."""
    parts = [np.zeros(0, np.int64)]
    for d in range(1, min(FAN, len(time) - 1) + 1):
        later = time[d:] - time[: len(time) - d]
        ok = np.flatnonzero(later <= REACH)
        parts.append((time[ok] << 17) | (place[ok] << 10) | (place[ok + d] << 3) | later[ok])
    return np.sort(np.concatenate(parts))


def store_wav(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """id, n_bytes (of the payload as UTF-8, unpadded), media (WAV file), as a table of the shared store."""
    kind = dict(df.dtypes)[id_col]

    def rows(batch: pa.RecordBatch):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
            yield key, len(raw), wav_bytes(raw)

    made = map_rows(df.select(id_col, payload_col), f"`{id_col}` {kind}, n_bytes long, media binary", rows, lambda r: len(r[2]))
    return written(made, "media", "zstd")


def fingerprints(media: DataFrame, id_col: str) -> DataFrame:
    """Read the stored WAV files: sizes and digests of the samples and of the file, and the fingerprint array."""
    kind = dict(media.dtypes)[id_col]

    def rows(batch: pa.RecordBatch):
        for key, n, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            file = file.as_buffer().to_pybytes()
            samples = wav_samples(file)
            yield key, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), peak_pairs(*peaks(samples))

    return map_rows(
        media.select(id_col, "n_bytes", "media"),
        f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>",
        rows, lambda r: 300 + 8 * len(r[7]),
    )


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as WAV and its fingerprint; feature is the fingerprint array's length and digest."""
    found = fingerprints(store_wav(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    return found.selectExpr(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        "concat(size(fingerprint), ':', md5(array_join(fingerprint, ','))) AS feature", "fingerprint",
    )
