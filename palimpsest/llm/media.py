"""Media columns: any bytes stored as WAV samples, and spectral-peak pair fingerprints of what is read back.

The payload is a text's UTF-8 bytes with bytes 0 appended up to a positive multiple of 64. It is stored without loss as
the unsigned 8-bit mono samples of a WAV file written by the wave module. The features are taken from the samples read
back: a short-time Fourier transform (Hann window of `FRAME` samples every `HOP`), the peaks of each frame (bins louder
than both neighbours in frequency and no quieter than the frames before and after; the `PEAKS` loudest, in the order of
frequency), and pairs of a peak with the first `FAN` peaks of the `AHEAD` frames after it. A fingerprint is time-coded:
the frame of its first peak, and frequency, second frequency and frames between them in one integer.

Defined cases: null and empty texts are 64 bytes 0 and have no peak; very long payloads are transformed in blocks of
frames, so that memory stays bounded; ties between equally loud bins go to the lower frequency; equal texts have equal
results, and repeated rows each have theirs; an empty table gives no rows; other columns are ignored.
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
from pyspark.sql import functions as F

from palimpsest.llm.common import as_bytes, map_batches

RATE, FRAME, HOP, PEAKS, FAN, AHEAD = 8000, 256, 128, 3, 2, 8
BLOCK = 4096  # frames transformed at once
WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)
SCHEMA = "doc_id long, n_bytes long, media binary, times array<int>, codes array<int>"


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or 64 * (not data))


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def spectrum(samples: np.ndarray) -> np.ndarray:
    """Magnitudes by frame and frequency, of samples that make up whole frames."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * WINDOW, axis=1)).astype(np.float32)


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequency bins of the peaks, by frame and then frequency."""
    raw = np.frombuffer(payload, dtype=np.uint8)
    n_frames = max(1, -(-(len(raw) - FRAME) // HOP) + 1)
    found_t, found_f = [], []
    for first in range(0, n_frames, BLOCK):
        low, high = max(0, first - 1), min(n_frames, first + BLOCK + 1)  # a frame more on either side to compare with
        part = raw[low * HOP : (high - 1) * HOP + FRAME]
        samples = np.zeros((high - 1 - low) * HOP + FRAME, dtype=np.float32)
        used = part[: len(samples)]
        samples[: len(used)] = used.astype(np.float32) - 128
        loud = spectrum(samples)
        framed = np.pad(loud, ((1, 1), (0, 0)))
        core = loud[:, 1:-1]
        is_peak = (core > loud[:, :-2]) & (core >= loud[:, 2:]) & (core >= framed[:-2, 1:-1]) & (core >= framed[2:, 1:-1]) & (core > 1e-3)
        ranked = np.where(is_peak, core, np.float32(-1))
        rows = np.arange(len(ranked))
        best = np.empty((len(ranked), PEAKS), dtype=np.int64)
        for k in range(PEAKS):
            best[:, k] = ranked.argmax(axis=1)  # of equals the lowest
            ranked[rows, best[:, k]] = -2
        best.sort(axis=1)
        kept = np.take_along_axis(is_peak, best, axis=1)
        t, k = np.nonzero(kept)
        frames = t + low
        inside = (frames >= first) & (frames < first + BLOCK)
        found_t.append(frames[inside])
        found_f.append(best[t, k][inside] + 1)
    return np.concatenate(found_t), np.concatenate(found_f)


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame of the first peak) and codes of all peak pairs, in order."""
    t, f = peaks(payload)
    times, codes = [], []
    # A peak's partners are the first FAN peaks in later frames, AHEAD at most.
    after = np.searchsorted(t, t, side="right")
    for k in range(FAN):
        partner = after + k
        valid = partner < len(t)
        source, partner = np.flatnonzero(valid), partner[valid]
        apart = t[partner] - t[source]
        near = apart <= AHEAD
        source, partner, apart = source[near], partner[near], apart[near]
        times.append(t[source])
        codes.append((f[source] << 16) | (f[partner] << 8) | apart)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded), media (a WAV file's bytes), times and codes (the fingerprint, index by index)."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sizes, media, times, codes = [], [], [], []
                for text in batch.column("text").to_pylist():
                    text = text or b""
                    stored = write_wav(padded(text))
                    t, c = fingerprint(read_wav(stored))
                    sizes.append(len(text))
                    media.append(stored)
                    times.append(t)
                    codes.append(c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(times, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int32()))],
                    names=["doc_id", "n_bytes", "media", "times", "codes"],
                )

    source = as_bytes(docs, id_col, text_col)
    return map_batches(source, convert, SCHEMA.replace("doc_id long", f"doc_id {source.schema['doc_id'].dataType.simpleString()}"))


def media_digests(media: DataFrame) -> DataFrame:
    """What is read back from media_columns()'s files, as digests."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for stored, t, c in zip(*(batch.column(k) for k in ("media", "times", "codes")), strict=True):
                stored = stored.as_py()
                payload = read_wav(stored)
                both = np.stack([t.values.to_numpy(), c.values.to_numpy()], axis=1).astype("<i4") if len(t.values) else np.zeros((0, 2), "<i4")
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{len(both)}:{hashlib.sha256(both.tobytes()).hexdigest()}")
                for column, value in zip(columns.values(), values, strict=True):
                    column.append(value)
            kept = {k: batch.column(k) for k in ("doc_id", "n_bytes")}
            yield pa.RecordBatch.from_pydict(kept | {k: pa.array(v, pa.int64() if isinstance(v[0], int) else pa.string()) if v else pa.array(v, pa.int64() if k.endswith(("bytes", "32")) else pa.string()) for k, v in columns.items()})

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_batches(
        media,
        digest,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
