"""Media columns: text payloads kept as 8-bit audio, and features of the audio.

A payload is stored losslessly as a mono 8-bit WAV. From the samples read back
come, block by block: polyphase resampling (24 to 16 kHz), overlapped log-mel
filterbanks, and segments found by hysteresis on the energy of frames. Log-mel
frames leave as tensors of one fixed shape with the time span of each.

Every value is a function of the stored bytes alone: blocks lie at fixed
places, whatever else is in the batch. Memory is that of the stored forms and tensors
of ROWS texts; tensors take some two thirds of their text's bytes, so a very long text, which is
read whole, needs a small multiple of its own size.

Defined cases: a null text counts as empty; an empty text has one unit of
padding; repeated rows and equal texts give equal values, so there are no ties to settle; a null id stays null; an empty table gives an empty result;
columns other than the two named are never read.
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

from tallyward.llm.common import require

#: Payloads are a positive multiple of UNIT bytes, filled up with FILL.
UNIT, FILL = 576, 255
STORED_HZ, UP, DOWN = 24_000, 2, 3
HZ = STORED_HZ * UP // DOWN
FRAME, HOP, FFT, MELS = 400, 160, 512, 40
#: Frames of a tensor, and frames of a block of work.
TENSOR_FRAMES, BLOCK = 64, 1024
#: Texts whose tensors leave in one Arrow batch.
ROWS = 16
#: A segment starts at START and ends under STOP decibels above the quietest tenth of frames.
START, STOP = 6.0, 3.0
_TAPS = 24


def pad(data: bytes) -> bytes:
    return data + bytes([FILL]) * ((-len(data)) % UNIT or (0 if data else UNIT))


def to_wav(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, STORED_HZ, STORED_HZ, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def from_wav(stored: bytes) -> bytes:
    """The samples of a mono 8-bit WAV."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"data":
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _filters() -> np.ndarray:
    """Taps of both phases of the resampler, as columns that meet a run of _TAPS + 1 samples."""
    n = np.arange(2 * _TAPS) - (2 * _TAPS - 1) / 2
    low = np.sinc(n / DOWN) * np.hamming(2 * _TAPS)
    low *= UP / low.sum()
    out = np.zeros((_TAPS + 1, 2), np.float32)
    out[:_TAPS, 0] = low[0::2][::-1]
    out[1:, 1] = low[1::2][::-1]
    return out


def _mel() -> np.ndarray:
    to_mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(HZ / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * HZ / FFT
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


_PHASES, _BANK, _WINDOW = _filters(), _mel(), np.hanning(FRAME).astype(np.float32)


def resample(samples: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Resampled values start..stop (start even) of unsigned 8-bit samples; beyond both ends there is silence."""
    first, count = 3 * (start // 2) - (_TAPS - 1), (stop - start + 1) // 2
    last = first + 3 * (count - 1) + _TAPS + 1
    run = np.zeros(last - first, np.float32)
    a, b = max(0, first), min(len(samples), last)
    if b > a:
        run[a - first : b - first] = (samples[a:b].astype(np.float32) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(run, _TAPS + 1)[::3]
    return (np.ascontiguousarray(windows) @ _PHASES).reshape(-1)[: stop - start]


def log_mel(payload: bytes) -> Iterator[np.ndarray]:
    """Log-mel frames of a payload, a block of frames at a time; a short tail is filled with silence."""
    samples = np.frombuffer(payload, np.uint8)
    length = len(samples) * UP // DOWN
    frames = 1 + max(0, -(-(length - FRAME) // HOP))
    for start in range(0, frames, BLOCK):
        n = min(BLOCK, frames - start)
        signal = resample(samples, start * HOP, start * HOP + (n - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP] * _WINDOW
        power = np.abs(np.fft.rfft(cut, FFT, axis=1)) ** 2
        yield np.log10(power.astype(np.float32) @ _BANK + 1e-6).astype(np.float32)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, one past the last) of each loud segment, by hysteresis on energies in decibels."""
    if not len(energy):
        return []
    floor = float(np.sort(energy)[(len(energy) - 1) // 10])
    known = np.where(energy >= floor + START, 1, np.where(energy < floor + STOP, -1, 0))
    last = np.maximum.accumulate(np.where(known != 0, np.arange(len(energy)), -1))
    on = np.concatenate([[False], (last >= 0) & (known[last] > 0), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist()))


def features(payload: bytes) -> tuple[list[np.ndarray], int, list[tuple[int, int]]]:
    """Tensors of TENSOR_FRAMES x MELS (the last filled with zeros), the number of frames, the segments."""
    tensors, energy, count = [], [], 0
    for block in log_mel(payload):
        count += len(block)
        energy.append(10 * np.log10(np.sum(10.0 ** block.astype(np.float64), axis=1)))
        for i in range(0, len(block), TENSOR_FRAMES):
            tensor = np.zeros((TENSOR_FRAMES, MELS), np.float32)
            part = block[i : i + TENSOR_FRAMES]
            tensor[: len(part)] = part
            tensors.append(tensor)
    return tensors, count, segments(np.round(np.concatenate(energy), 3))


def _milliseconds(frame: int) -> int:
    return frame * HOP * 1000 // HZ


def _payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), pad(data)


_SPAN = [("start_ms", pa.int64()), ("end_ms", pa.int64())]
_KINDS = {
    "n_bytes": pa.int64(),
    "media": pa.binary(),
    "n_frames": pa.int64(),
    "segments": pa.list_(pa.struct(_SPAN)),
    "tensors": pa.list_(pa.struct([*_SPAN, ("n_frames", pa.int64()), ("values", pa.list_(pa.float32()))])),
}
_MEDIA = "n_bytes long, media binary, n_frames long, segments array<struct<start_ms:long,end_ms:long>>, tensors array<struct<start_ms:long,end_ms:long,n_frames:long,values:array<float>>>"


def _stored(text: str | None) -> tuple:
    n, payload = _payload(text)
    media = to_wav(payload)
    tensors, frames, found = features(from_wav(media))
    held = []
    for i, tensor in enumerate(tensors):
        first = i * TENSOR_FRAMES
        inside = min(TENSOR_FRAMES, frames - first)
        held.append({"start_ms": _milliseconds(first), "end_ms": _milliseconds(first + inside), "n_frames": inside, "values": tensor.ravel()})
    return n, media, frames, [{"start_ms": _milliseconds(a), "end_ms": _milliseconds(b)} for a, b in found], held


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: bytes of its text, the stored audio, its frames, segments and tensors with their spans.

    A tensor's values are flat, TENSOR_FRAMES * MELS of them; `as_tensors` makes Arrow's fixed-shape tensors of them.
    """
    require(docs, id_col, text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                columns = list(zip(*(_stored(t.as_py()) for t in part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, _KINDS.values()))], names=["doc_id", *_KINDS])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {_MEDIA}")


def _described(frames: int, spans: list[tuple[int, int]], tensors: pa.Array) -> str:
    """All features in a line: frames, tensors, segments, time in segments, hash of the tensors to 1/64 and of the spans of segments."""
    digest = hashlib.sha256()
    for values in tensors.field("values"):
        digest.update(np.round(values.values.to_numpy() * 64).astype("<i2").tobytes())
    digest.update(",".join(f"{a}-{b}" for a, b in spans).encode())
    return f"frames={frames};tensors={len(tensors)};segments={len(spans)};loud_ms={sum(b - a for a, b in spans)};sha256={digest.hexdigest()}"


def media_digest(media: DataFrame) -> DataFrame:
    """Of the rows of `media_columns`: sizes and checksums of the payload read back and of the stored form, and the features in a line."""
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                stored = batch.column("media")[i].as_py()
                back = from_wav(stored)
                spans = [(s["start_ms"], s["end_ms"]) for s in batch.column("segments")[i].as_py()]
                feature = _described(batch.column("n_frames")[i].as_py(), spans, batch.column("tensors")[i].values)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds.values()))], names=["doc_id", "n_bytes", *kinds])

    types = ", ".join(f"{k} {'long' if v == pa.int64() else 'string'}" for k, v in kinds.items())
    return media.select("doc_id", *_KINDS).mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, {types}")


def as_tensors(values: pa.Array) -> pa.FixedShapeTensorArray:
    """Arrow's fixed-shape tensors from flat lists of TENSOR_FRAMES * MELS numbers."""
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
    return pa.ExtensionArray.from_storage(kind, values.cast(pa.list_(pa.float32(), TENSOR_FRAMES * MELS)))
