"""Media columns: WAV bytes in a binary column, spectral features and peak-pair fingerprints.

A media value is a whole RIFF/WAVE file, written and read by the standard `wave` module. Features come from a short-time
Fourier transform; spectral peaks are paired, and each pair is one time-coded 64-bit number
(time << 24 | first bin << 16 | second bin << 8 | distance in frames).
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
from pyspark.sql import types as T

RATE = 8000
FRAME, HOP = 64, 32
#: A peak tops its neighbours in time and frequency and this multiple of its frame's mean; it pairs with up to FAN later ones within REACH frames.
PEAK_RATIO, FAN, REACH = 2.0, 3, 15
#: Frames transformed at a time; blocks overlap, so that the result does not depend on it.
FRAMES_AT_ONCE = 1 << 14
ALIGN = 64


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> tuple[np.ndarray, int]:
    """Samples as int (frames, channels) centred on 0, and the rate. 8, 16 and 32 bits; other widths raise."""
    with wave.open(io.BytesIO(media), "rb") as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.int16) - 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}")
    else:
        raise ValueError(f"samples of {width} bytes are not supported")
    return x.reshape(-1, channels), rate


_WINDOW = np.hanning(FRAME).astype(np.float32)


def spectrum(x: np.ndarray) -> np.ndarray:
    """Magnitudes (frames, FRAME // 2) of the short-time transform, without the constant bin; a short signal is padded to one frame."""
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x.astype(np.float32), FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * _WINDOW, axis=1))[:, 1:].astype(np.float32)


def _peaks(m: np.ndarray, first: bool, last: bool) -> np.ndarray:
    """(frame, bin) of the peaks of m, whose outer frames are only context unless it is the first or last block."""
    top = m > PEAK_RATIO * m.mean(axis=1, keepdims=True)
    top[:, 1:] &= m[:, 1:] > m[:, :-1]
    top[:, :-1] &= m[:, :-1] >= m[:, 1:]
    top[1:] &= m[1:] > m[:-1]
    top[:-1] &= m[:-1] >= m[1:]
    if not first:
        top[0] = False
    if not last:
        top[-1] = False
    return np.argwhere(top)


def fingerprint(samples: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Frames, peaks (frame, bin) and the sorted time-coded pairs of a mono signal, of any length, block by block."""
    x = samples if len(samples) >= FRAME else np.pad(samples, (0, FRAME - len(samples)))
    n = (len(x) - FRAME) // HOP + 1
    found = []
    for at in range(0, n, FRAMES_AT_ONCE):
        lo, hi = max(0, at - 1), min(n, at + FRAMES_AT_ONCE + 1)
        p = _peaks(spectrum(x[lo * HOP : (hi - 1) * HOP + FRAME]), lo == at, hi == min(n, at + FRAMES_AT_ONCE))
        p[:, 0] += lo
        found.append(p)
    peaks = np.concatenate(found)
    codes = []
    for step in range(1, FAN + 1):
        a, b = peaks[:-step], peaks[step:]
        gap = b[:, 0] - a[:, 0]
        near = gap <= REACH
        codes.append((a[near, 0] << 24) | (a[near, 1] << 16) | (b[near, 1] << 8) | gap[near])
    return n, peaks, np.sort(np.concatenate(codes)) if len(peaks) else np.empty(0, np.int64)


def _map(df: DataFrame, make, added: list[T.StructField], arrow: list[pa.DataType], source: str, drop: tuple[str, ...] = ()) -> DataFrame:
    names = [f.name for f in added]
    kept = [c for c in df.columns if c not in names and c not in drop]
    schema = T.StructType([df.schema[c] for c in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(x.as_py()) for x in batch.column(batch.schema.get_field_index(source))]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + made, names=kept + names)

    return df.mapInArrow(run, schema)


def _stored(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "replace")
    return write_wav(data + bytes(ALIGN - len(data) % ALIGN if len(data) % ALIGN or not data else 0)), len(data)


def text_to_media(df: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Adds `media`: the text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as a WAV file of 8-bit samples,
    and `n_bytes`, their number before padding. Null text counts as empty. Other columns stay; namesakes are replaced. No shuffle."""
    return _map(df, _stored, [T.StructField(media, T.BinaryType()), T.StructField(n_bytes, T.LongType())], [pa.binary(), pa.int64()], text)


FEATURES = [
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("n_frames", T.LongType()),
    T.StructField("n_peaks", T.LongType()),
    T.StructField("pairs", T.ArrayType(T.LongType())),
]


def _features(media: bytes | None):
    if media is None:
        return (None,) * len(FEATURES)
    samples, _ = read_wav(media)
    with wave.open(io.BytesIO(media), "rb") as w:
        payload = w.readframes(w.getnframes())
    n, peaks, codes = fingerprint(samples[:, 0] if samples.shape[1] == 1 else samples.mean(axis=1))
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), n, len(peaks), codes


def media_features(df: DataFrame, media: str = "media", keep_media: bool = False) -> DataFrame:
    """Reads the stored files back and adds the columns of FEATURES: payload size, SHA-256, CRC-32 of its last 64 bytes, the file's
    own size and SHA-256, frames, peaks and the time-coded pairs. Null media gives nulls; a file that `wave` cannot read raises.
    Equal media give equal values. The media column goes unless keep_media. No shuffle."""
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return _map(df, _features, FEATURES, arrow, media, () if keep_media else (media,))
