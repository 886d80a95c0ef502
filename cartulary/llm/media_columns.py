"""Media columns: WAV samples and time-coded spectral-peak fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

#: Samples per second of the stored media, and the payload's unit in samples.
RATE, UNIT = 8_000, 576
#: Short-time Fourier transform: window and hop in samples.
WINDOW, HOP = 144, 72
#: Frequency bands whose strongest bin may be a peak, as bins of the transform.
BANDS = (2, 8, 16, 28, 44, 73)
#: A peak is over so many times its frame's mean; pairs span at most FAN peaks and SPAN frames.
LOUD, FAN, SPAN = 1.5, 3, 63
#: Least magnitude of a peak: a silent frame has none.
FLOOR = 1e-6
#: Frames transformed at once.
BLOCK = 8_192

ANALYSIS = T.StructType([
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("points", T.ArrayType(T.LongType())),
])


def to_wav(data: bytes) -> bytes:
    """A mono WAV of 8-bit samples: ``data`` and bytes 255 up to a positive multiple of UNIT."""
    units = max(1, -(-len(data) // UNIT))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, RATE, units * UNIT, "NONE", "not compressed"))
        w.writeframes(data.ljust(units * UNIT, b"\xff"))
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of spectral peaks, by time and then frequency.

    In each band of each frame the strongest bin counts if it is LOUD times the
    frame's mean and no weaker than the band's strongest in the frames beside it.
    """
    x = (samples.astype(np.float64) - 128.0) / 128.0
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    window = np.hanning(WINDOW)
    best, top = [], []
    for i in range(0, len(frames), BLOCK):
        part = frames[i : i + BLOCK]
        power = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * window, axis=1))
        mean = power[:, BANDS[0] : BANDS[-1]].mean(axis=1) * LOUD
        bins = np.stack([power[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS, BANDS[1:])], axis=1)
        value = np.take_along_axis(power, bins, axis=1)
        best.append(bins)
        top.append(np.where((value > mean[:, None]) & (value > FLOOR), value, 0.0))
    bins, value = np.concatenate(best), np.concatenate(top)
    beside = np.zeros_like(value)
    beside[1:] = value[:-1]
    beside[:-1] = np.maximum(beside[:-1], value[1:])
    frame, band = np.nonzero((value > 0) & (value >= beside))
    return frame, bins[frame, band]


def points(samples: np.ndarray) -> np.ndarray:
    """Fingerprint: for pairs of near peaks, time << 32 | first << 20 | second << 8 | frames between."""
    frame, bin_ = peaks(samples)
    out = []
    for d in range(1, FAN + 1):
        apart = frame[d:] - frame[:-d]
        near = apart <= SPAN
        a, b = frame[:-d][near].astype(np.int64), bin_[:-d][near].astype(np.int64)
        out.append(a << 32 | b << 20 | bin_[d:][near].astype(np.int64) << 8 | apart[near])
    return np.sort(np.concatenate(out))


@pandas_udf(T.BinaryType())
def wav(texts: pd.Series) -> pd.Series:
    return pd.Series([to_wav((t or "").encode("utf-8", "replace")) for t in texts], dtype=object)


def analysed(media: bytes) -> tuple[int, str, int, list[int]]:
    data = from_wav(media)
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), points(np.frombuffer(data, np.uint8))


@pandas_udf(ANALYSIS)
def analysis(media: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None,) * len(ANALYSIS) if m is None else analysed(m) for m in media], columns=ANALYSIS.names, dtype=object)


def media_column(text: Column) -> Column:
    """``text``'s UTF-8 bytes as a WAV file; a null or empty text makes one unit of padding."""
    return wav(text)


def media_features(media: Column) -> Column:
    """Struct of ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (last 32
    samples) and ``points``, the sorted time-coded peak pairs, all from the samples
    that the wave module reads back.  A text's length bounds the work, frames are
    transformed a block at a time, and equal media have equal features.  A media
    without two near peaks has no points, and a null media has nulls.  Bytes that
    are not a WAV file raise the wave module's error.
    """
    return analysis(media)


def digest(points_: Column) -> Column:
    """A fingerprint as a short string: its number of points and a hash of them."""
    return F.concat_ws(":", F.size(points_), F.hex(F.xxhash64(points_)))
