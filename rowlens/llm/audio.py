"""Audio features over stored media: resampling, log-mel patches, energy segments.

A payload is kept as a WAV file of unsigned 8-bit samples in a binary column.
Features come from the stored bytes: a polyphase filter brings the samples to
the target rate, overlapped windows give log-mel frames, and two thresholds on
the frame energy (enter above the high one, leave below the low one) give
segments. Frames are cut into patches of one fixed shape, which are stored with
their time spans as a fixed-shape Arrow tensor column: one Arrow stream for each
document, in a binary column. ``patch_table`` reads such streams.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, utf8

PAD, BLOCK, TAIL = 255, 576, 32
RATE, TARGET = 16_000, 8_000
WINDOW, HOP, FFT, MELS = 200, 80, 256, 40
PATCH, PATCH_HOP = 32, 32
#: Log-mel values are kept in steps of 1/STEPS.
STEPS = 16
ENTER_DB, LEAVE_DB = 0.5, -0.5
#: Frames computed at once, however long the media is.
FRAMES_AT_ONCE = 4096
#: Bytes of media whose features leave a task together.
PIECE_BYTES = 4 << 20

MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, segments array<struct<start_s:double,end_s:double>>, patches binary"
#: Patches [PATCH, MELS] of half-precision values with their time spans.
TENSOR = pa.fixed_shape_tensor(pa.float16(), [PATCH, MELS], dim_names=["frame", "mel"])
PATCHES = pa.schema([("patch", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mel", TENSOR)])


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file with the payload as its unsigned 8-bit samples."""
    pad = len(payload) & 1
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad


def samples(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of an 8-bit mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data in the WAV file")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every text, padded to whole blocks.

    A null text is an empty one, which gives one block of padding. Row by row:
    repeated rows, and rows without a doc_id, are each stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in pieces(whole, "data", PIECE_BYTES)):
            data = b.column("data").to_pylist()
            media = [wav(x + bytes([PAD]) * (max(1, -(-len(x) // BLOCK)) * BLOCK - len(x))) for x in data]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data")).mapInArrow(run, MEDIA_SCHEMA)


@functools.cache
def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """A windowed sinc of ``2 * half * max(up, down) + 1`` taps, scaled for ``up``."""
    q = max(up, down)
    n = np.arange(-half * q, half * q + 1)
    return (np.sinc(n / q) * np.kaiser(len(n), 5.0) * up / q).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase resampling: each output takes only the taps of its own phase."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return x
    taps = low_pass(up, down)
    mid, n = len(taps) // 2, -(-len(x) * up // down)
    out = np.zeros(n, np.float32)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase and step by `down` inputs
        where = first * down + mid
        own, start = taps[where % up :: up], where // up
        m = -(-(n - first) // up)
        padded = np.zeros((m - 1) * down + start + len(own) + 1, np.float32)
        lead = len(own) - 1
        padded = np.concatenate([np.zeros(lead, np.float32), x, np.zeros(max(0, (m - 1) * down + start + 1 - len(x)), np.float32)])
        acc = np.zeros(m, np.float32)
        for k, tap in enumerate(own):  # sum of tap[k] * x[start - k + m * down]
            at = lead + start - k
            acc += tap * padded[at : at + (m - 1) * down + 1 : down]
        out[first::up] = acc
    return out


@functools.cache
def mel_bank(rate: int = TARGET, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale: [fft // 2 + 1, mels]."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    freq = np.arange(fft // 2 + 1) * rate / fft
    rise = (freq[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@functools.cache
def hann() -> np.ndarray:
    return np.hanning(WINDOW).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames [n, MELS] and their energies in dB, from overlapped windows."""
    if len(x) < WINDOW:
        x = np.pad(x, (0, WINDOW - len(x)))
    cut = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    mel, energy = [], []
    for at in range(0, len(cut), FRAMES_AT_ONCE):
        part = cut[at : at + FRAMES_AT_ONCE] * hann()
        power = np.abs(np.fft.rfft(part, FFT)).astype(np.float32) ** 2
        mel.append(np.log(power @ mel_bank() + 1e-6))
        energy.append(10 * np.log10((part * part).sum(1) + 1e-6))
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray, enter: float = ENTER_DB, leave: float = LEAVE_DB) -> np.ndarray:
    """[n, 2] first and past-the-end frames of the stretches between entering and leaving.

    Thresholds are relative to the median energy. Between them the state stays.
    """
    level = energy - np.median(energy)
    mark = np.where(level >= enter, 1, np.where(level < leave, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    state = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], state, [0]])))
    return edge.reshape(-1, 2)


def analyse(media: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Samples, log-mel frames and segments of one stored file."""
    rate, data = samples(media)
    x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x, rate, TARGET))
    return data, mel, segments(energy)


def patches(mel: np.ndarray) -> pa.RecordBatch:
    """Rows of PATCHES that hold all frames; the last patch is padded with its lowest value."""
    starts = np.arange(0, max(1, len(mel) - PATCH + PATCH_HOP), PATCH_HOP)
    ends = np.minimum(starts + PATCH, len(mel))
    own = np.full((starts[-1] + PATCH, MELS), mel[starts[-1] :].min(), np.float32)
    own[: len(mel)] = mel
    own = (np.rint(own * STEPS) / STEPS).astype(np.float16)
    cut = own.reshape(-1, PATCH, MELS) if PATCH_HOP == PATCH else own[starts[:, None] + np.arange(PATCH)]
    flat = pa.FixedSizeListArray.from_arrays(pa.array(cut.ravel()), PATCH * MELS)
    spans = pa.array(starts * HOP / TARGET), pa.array(((ends - 1) * HOP + WINDOW) / TARGET)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(starts), dtype=np.int32)), *spans, pa.ExtensionArray.from_storage(TENSOR, flat)], schema=PATCHES)


def features(media: DataFrame) -> DataFrame:
    """A row of FEATURE_SCHEMA for each stored file, from its bytes alone.

    ``patches`` is an Arrow stream of PATCHES, ``segments`` are the spans in
    which the energy stays up.
    """

    def one(doc_id, n_bytes, m: bytes) -> tuple:
        data, mel, seg = analyse(m)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, PATCHES) as out:
            out.write_batch(patches(mel))
        spans = [{"start_s": a * HOP / TARGET, "end_s": ((b - 1) * HOP + WINDOW) / TARGET} for a, b in seg.tolist()]
        return doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-TAIL:]), len(m), hashlib.sha256(m).hexdigest(), len(mel), spans, sink.getvalue().to_pybytes()

    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = {"segments": span, "patches": pa.binary(), "payload_sha256": pa.string(), "media_sha256": pa.string()}
    names = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in pieces(whole, "media", PIECE_BYTES)):
            rows = [one(*r) for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.int64())) for x, c in zip(zip(*rows, strict=True), names, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURE_SCHEMA)


def patch_table(stored: bytes) -> pa.Table:
    """The patches of one document, from the stream that ``features`` stores."""
    return pa.ipc.open_stream(stored).read_all()


def digests(stored: DataFrame) -> DataFrame:
    """Rows of ``features`` with ``feature`` in place of the tensors it is derived from.

    It gives the numbers of frames, patches and segments, the seconds inside
    segments, the mean log-mel level of the patches, and a checksum of their values.
    """
    rest = [x for x in FEATURE_SCHEMA.split(", ") if x.split()[0] not in ("patches", "segments", "n_frames")]
    schema = ", ".join([*rest, "feature string", "n_frames long", "n_segments long"])

    def one(n_frames: int, spans: list[dict], blob: bytes) -> str:
        table = patch_table(blob)
        mel = table.column("mel").combine_chunks().to_numpy_ndarray()
        inside = sum(x["end_s"] - x["start_s"] for x in spans)
        check = zlib.crc32(np.rint(mel.astype(np.float32) * STEPS).astype("<i2").tobytes())
        return f"frames={n_frames};patches={table.num_rows};segments={len(spans)};inside_s={inside:.2f};mel={mel.mean(dtype=np.float64):.3f};crc={check:08x}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in pieces(whole, "patches", PIECE_BYTES)):
            spans = b.column("segments").to_pylist()
            text = [one(n, s, x.as_py()) for n, s, x in zip(b.column("n_frames").to_pylist(), spans, b.column("patches"), strict=True)]
            keep = [x.split()[0] for x in rest]
            columns = [*(b.column(c) for c in keep), pa.array(text, pa.string()), b.column("n_frames"), pa.array([len(s) for s in spans], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "feature", "n_frames", "n_segments"])

    return stored.mapInArrow(run, schema)
