"""Media columns: WAV bytes, short-time spectra and spectral-peak fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import named
from sparkwright.llm.text import slices, texts

#: Samples in a frame, in a hop and in a second.
FRAME, HOP, RATE = 576, 288, 8000
#: Peaks kept in a frame; frames ahead that a peak is paired with.
PEAKS, AHEAD = 2, 2

_WINDOW = np.hanning(FRAME).astype(np.float32)


def wav_bytes(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples."""
    with io.BytesIO() as f:
        with wave.open(f, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(payload)
        return f.getvalue()


def wav_samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and hashes of pairs of spectral peaks.

    Each frame gives its ``PEAKS`` strongest local maxima over frequency (ties:
    the lower one); a peak at bin f pairs with the peaks g of the next ``AHEAD``
    frames, d frames later: hash = f * 2**12 + g * 2**3 + d.
    """
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    picked = []
    for k in range(0, len(frames), 512):
        power = np.abs(np.fft.rfft(frames[k : k + 512] * _WINDOW, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        score = np.where((inner >= power[:, :-2]) & (inner > power[:, 2:]), inner, np.float32(-1))
        best = np.empty((len(score), PEAKS), np.int32)
        rows = np.arange(len(score))
        for p in range(PEAKS):
            best[:, p] = score.argmax(axis=1)
            score[rows, best[:, p]] = -2
        picked.append(best + 1)
    peaks = np.concatenate(picked)
    times, hashes = [], []
    for d in range(1, AHEAD + 1):
        if len(peaks) > d:
            pair = (peaks[:-d, :, None] << 12) + (peaks[d:, None, :] << 3) + d
            hashes.append(pair.reshape(-1))
            times.append(np.repeat(np.arange(len(peaks) - d, dtype=np.int32), PEAKS * PEAKS))
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, h = np.concatenate(times), np.concatenate(hashes).astype(np.int32)
    order = np.lexsort((h, t))
    return t[order], h[order]


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, frame_times array<int>, frame_hashes array<int>"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the text's UTF-8 bytes, padded with bytes 255 to a
    positive multiple of 576, stored as a WAV file (``media``), read back by the
    wave module, and fingerprinted as two arrays of equal length (frame number,
    hash of a pair of peaks).

    Null text: empty, so one frame of padding.  Equal texts give equal values;
    repeated rows give repeated results; an empty table gives an empty result;
    other columns are not read.  A map without shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part, "text")):
                    raw = text.encode()
                    media = wav_bytes(raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME))
                    back = wav_samples(media)
                    t, h = fingerprint(back)
                    out.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), media, t, h))
                a, b, c, d, e, f, t, h = zip(*out)
                at = np.cumsum([0, *map(len, t)]).astype(np.int32)
                arrays = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(x))) for x in (t, h)]
                longs = [pa.array(x, pa.int64()) for x in (a, b, c, e)]
                yield pa.RecordBatch.from_arrays([*longs[:3], pa.array(d, pa.string()), longs[3], pa.array(f, pa.binary()), *arrays], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "frame_times", "frame_hashes"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(run, SCHEMA)


def media_digests(docs: DataFrame) -> DataFrame:
    """The media columns with digests in place of files and arrays, on odd rows and
    empty tables likewise."""
    pairs = F.zip_with("frame_times", "frame_hashes", lambda t, h: F.concat_ws(":", t, h))
    return media_columns(docs).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.array_join(pairs, ",").alias("feature"),
    )
