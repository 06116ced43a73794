"""Operator 8, media columns: audio features of stored 8-bit PCM.

``store`` wraps samples in a RIFF/WAVE file (mono, 8-bit unsigned, ``RATE`` Hz) and ``load``
reads them back. ``features`` resamples to ``TARGET`` Hz with a polyphase windowed-sinc filter,
takes overlapped Hann frames through a mel filterbank to log energies, cuts the frames into
fixed-shape windows (an Arrow fixed_shape_tensor of FRAMES x MELS, zero-padded at the end) with
their time spans, and finds active spans by hysteresis: a span opens above one energy threshold
and closes below a lower one.

All figures of a text come from that text alone, one array operation a block, so equal texts get
equal bytes wherever they stand, and memory is bounded by the longest text.

Edge cases: null and empty texts store 64 zero bytes (one silent window, no span); a text whose
length is a multiple of 64 gets no padding; an empty table gives an empty result; repeated rows
get equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import map_batches, stored, utf8

RATE, TARGET = 16_000, 12_000
FRAME, HOP, MELS, FRAMES = 256, 128, 20, 32
TAPS = 12  # filter taps each side, per phase
UNIT = 64
BLOCK_FRAMES = 4096
#: A span opens this many dB above the text's median frame and closes this many below it.
OPEN_DB, CLOSE_DB = 1.0, 0.5


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def store(samples: bytes, used: int, rate: int = RATE) -> bytes:
    """A WAVE file; a ``tlen`` chunk holds how many of its samples are used."""
    body = b"WAVE" + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8) + struct.pack("<4sIQ", b"tlen", 8, used)
    body += struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def load(file: bytes) -> tuple[bytes, int, int]:
    """Samples, how many are used, and the rate of a WAVE file of ``store``."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate, used, samples = 12, 0, 0, b""
    while at < len(file):
        kind, size = struct.unpack_from("<4sI", file, at)
        at += 8
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", file, at + 4)[0]
        elif kind == b"tlen":
            used = struct.unpack_from("<Q", file, at)[0]
        elif kind == b"data":
            samples = file[at : at + size]
        at += size + (size & 1)
    return samples, used, rate


def lowpass(up: int, down: int) -> np.ndarray:
    """Hann-windowed sinc for a resampling by up/down, a row for each phase."""
    half = TAPS * max(up, down)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(up, down)) * np.hanning(2 * half + 3)[1:-1]
    h *= up / h.sum()
    rows = np.zeros((up, -(-len(h) // up)))
    for p in range(up):
        rows[p, : len(h[p::up])] = h[p::up]
    return rows.astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase: output n uses phase (n * down) mod up, so no sample is made that is not kept."""
    g = gcd(up, down)
    up, down = up // g, down // g
    rows = lowpass(up, down)
    taps, half = rows.shape[1], TAPS * max(up, down)
    n_out = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps, np.float32), x, np.zeros(taps + half // up + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n_out, np.float32)
    for first in range(min(up, n_out)):
        n = np.arange(first, n_out, up)
        place = n[0] * down + half
        begin = place // up - taps + 1 + taps
        step = down  # of the input, from one output of this phase to the next
        for k in range(0, len(n), 1 << 16):
            part = windows[begin + k * step : begin + (min(len(n), k + (1 << 16)) - 1) * step + 1 : step]
            out[n[k : k + (1 << 16)]] = part @ rows[place % up][::-1]
    return out


def mel_filters(rate: int = TARGET) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, FRAME // 2 + 1 bins by MELS."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    up, down = (bins[:, None] - low) / (mid - low), (high - bins[:, None]) / (high - mid)
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)
_MEL = mel_filters()


def log_mel(y: np.ndarray) -> np.ndarray:
    """Log-mel energies (dB) of overlapped frames, frames x MELS; the last frame is zero-padded."""
    n = max(1, -(-max(len(y) - FRAME, 0) // HOP) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((n, MELS), np.float32)
    for k in range(0, n, BLOCK_FRAMES):
        power = np.abs(np.fft.rfft(frames[k : k + BLOCK_FRAMES] * _HANN)) ** 2
        out[k : k + BLOCK_FRAMES] = 10 * np.log10(power.astype(np.float32) @ _MEL + 1e-6)
    return out


def active_spans(energy: np.ndarray, seconds: float) -> list[tuple[float, float]]:
    """Hysteresis: open where energy passes the upper threshold, close where it falls under the lower one."""
    middle = np.median(energy)
    on, off = energy > middle + OPEN_DB, energy < middle - CLOSE_DB
    event = np.where(on | off, np.arange(len(energy)), -1)
    last = np.maximum.accumulate(event)
    state = np.where(last >= 0, on[np.maximum(last, 0)], False).astype(np.int8)
    edge = np.diff(np.concatenate([[0], state, [0]]))
    return [(round(a * seconds, 4), round(b * seconds, 4)) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors (windows x FRAMES x MELS, float32), the windows' time spans, the active spans (seconds)."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, TARGET, rate))
    hop = HOP / TARGET
    n = -(-len(mel) // FRAMES)
    tensor = np.zeros((n * FRAMES, MELS), np.float32)
    tensor[: len(mel)] = np.round(mel, 2)
    spans = [(round(k * FRAMES * hop, 4), round(min((k + 1) * FRAMES, len(mel)) * hop, 4)) for k in range(n)]
    return tensor.reshape(n, FRAMES, MELS), spans, active_spans(mel.mean(1), hop)


def as_arrow(tensor: np.ndarray, spans: list[tuple[float, float]]) -> pa.RecordBatch:
    """A batch of a fixed_shape_tensor column and the spans' bounds."""
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensor))
    return pa.RecordBatch.from_arrays([column, pa.array([a for a, _ in spans]), pa.array([b for _, b in spans])], names=["log_mel", "start_s", "end_s"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(file: bytes) -> tuple:
    """COLUMNS of a stored file, its tensors (Arrow IPC) and its active spans."""
    payload, used, rate = load(file)
    tensor, spans, active = features(payload, rate)
    digest = f"{len(tensor)}x{FRAMES}x{MELS}:{spans[-1][1]:.4f}s:{len(active)}:{zlib.crc32(np.round(tensor, 1).tobytes()):08x}"
    row = (used, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), digest)
    return (*row, to_ipc(as_arrow(tensor, spans)), [{"start_s": a, "end_s": b} for a, b in active])


def media_files(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text's WAVE file."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            files = [store(pad(t or b""), len(t or b"")) for t in utf8(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["doc_id", "media"])

        return step

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def media_features(files: DataFrame) -> DataFrame:
    """doc_id, COLUMNS, tensors (Arrow IPC: fixed-shape tensors with time spans) and active spans of stored files (doc_id, media)."""
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["tensors", "active"]
    span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(span)]
    schema = f"doc_id {files.schema['doc_id'].dataType.simpleString()}, {COLUMNS}, tensors binary, active array<struct<start_s: double, end_s: double>>"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [describe(f) for f in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=["doc_id", *names])

        return step

    return map_batches(files.select("doc_id", "media"), make, schema)


def op8_audio_features(docs: DataFrame) -> DataFrame:
    """The thin query: files are written, read back and described; their tensors and spans are written; the digests come from there."""
    made = stored(media_features(stored(media_files(docs), "media")), "media-features")
    return made.select("doc_id", *[c.split()[0] for c in COLUMNS.split(", ")])
