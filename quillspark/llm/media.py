"""Media columns: WAV sound in a binary column, read with the wave module, and spectral-peak pair fingerprints.

A payload of bytes becomes an 8-bit mono WAV (each byte one sample), so storing is lossless. Fingerprints come from the
samples read back: a short-time Fourier transform with a Hann window, the strongest bin of each of a few frequency bands
in each frame as that frame's peaks, and pairs of peaks in nearby frames, stored as an array of longs with the frame's
number in the upper and (bin, bin, distance) in the lower 32 bits.

Null payloads give null media and null media give null results. Payloads may be of any length: frames are transformed in
blocks of fixed size. Equal payloads give equal media and fingerprints; rows are kept as they come, repeated ids too. An
empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fields, map_columns

RATE = 8000
#: Samples of a frame and between frames.
FRAME, HOP = 256, 128
#: Bounds, in bins, of the bands that give one peak each.
BANDS = (2, 12, 32, 64, 129)
#: A peak is paired with those of so many frames after it.
REACH = 2
BLOCK = 4096


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x bands): the strongest bin of each band, and whether it stands out from its frame's mean strength."""
    x = np.zeros(max(FRAME, -(-len(samples) // HOP) * HOP), np.float32)
    x[: len(samples)] = samples
    x[: len(samples)] -= 128
    window = np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, strong = [], []
    for at in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft(frames[at : at + BLOCK] * window, axis=1)).astype(np.float32)
        mean = power[:, BANDS[0] :].mean(axis=1, keepdims=True)
        best = np.stack([lo + power[:, lo:hi].argmax(axis=1) for lo, hi in zip(BANDS, BANDS[1:])], axis=1)
        bins.append(best)
        strong.append(np.take_along_axis(power, best, 1) > mean)
    return np.concatenate(bins), np.concatenate(strong)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded pair codes, ascending: frame << 32 | first bin << 20 | second bin << 8 | distance in frames."""
    bins, strong = peaks(samples)
    out = []
    frame = np.arange(len(bins), dtype=np.int64)
    for reach in range(1, REACH + 1):
        for band in range(bins.shape[1]):
            both = strong[:-reach, band] & strong[reach:, band]
            out.append((frame[:-reach] << 32 | bins[:-reach, band] << 20 | bins[reach:, band] << 8 | reach)[both])
    return np.sort(np.concatenate(out))


def store(df: DataFrame, payload_col: str = "payload", id_col: str = "doc_id") -> DataFrame:
    """(id, media): payloads as WAV files."""

    def run(keys: pa.Array, payloads: pa.Array) -> list:
        return [keys, [None if x is None else to_wav(x) for x in payloads.to_pylist()]]

    return map_columns(df, [id_col, payload_col], fields(df, (id_col,), "media binary"), run, 500)


def load(df: DataFrame, media_col: str = "media", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, samples, fingerprint): what the media hold and their fingerprints."""

    def run(keys: pa.Array, media: pa.Array, *more: pa.Array) -> list:
        samples = [None if x is None else from_wav(x) for x in media.to_pylist()]
        found = [None if x is None else fingerprint(np.frombuffer(x, np.uint8)) for x in samples]
        ends = np.cumsum([0, *(0 if x is None else len(x) for x in found)])
        flat = np.concatenate([np.zeros(0, np.int64), *(x for x in found if x is not None)])
        null = pa.array([x is None for x in found])
        return [keys, *more, samples, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=null)]

    return map_columns(df, [id_col, media_col, *keep], fields(df, (id_col, *keep), "samples binary, fingerprint array<long>"), run, 500)


def text_payload(text: str = "text", unit: int = 64):
    """Column: a text's UTF-8 bytes (null: none) followed by bytes 0 up to a positive multiple of ``unit``."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = F.greatest(F.lit(unit), F.ceil(F.octet_length(raw) / unit) * unit).cast("int")
    return F.rpad(raw, size, F.lit(b"\0"))
