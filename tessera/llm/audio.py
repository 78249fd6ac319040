"""Media columns: bytes as 8-bit audio, with log-mel features and energy segments."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long, "
    "tensor array<float>, tensor_shape array<int>, spans array<float>"
)


@dataclass(frozen=True)
class AudioConfig:
    """``rate`` names the stored samples' rate; features are taken at ``rate * up / down``."""

    rate: int = 16_000
    up: int = 1
    down: int = 2
    taps_per_phase: int = 12
    frame: int = 256
    hop: int = 128
    mels: int = 32
    windows: int = 8
    block_frames: int = 4096
    high: float = 1.0
    low: float = 0.5
    pad_to: int = 192


def payload_of(text: str | None, pad_to: int = 192) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // pad_to)) * pad_to
    return len(raw), raw + b" " * (size - len(raw))


def store(payload: bytes, rate: int) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@lru_cache(maxsize=8)
def polyphase_filter(up: int, down: int, taps_per_phase: int) -> np.ndarray:
    """Hamming-windowed sinc low-pass at the lower Nyquist rate, as (up, taps) phases."""
    widest = max(up, down)
    n = 2 * taps_per_phase * widest // 2 * 2 + 1
    at = np.arange(n) - (n - 1) / 2
    h = np.sinc(at / widest) / widest * np.hamming(n) * up
    return np.pad(h, (0, -n % up)).reshape(-1, up).T.astype(np.float32)


def resample(samples: np.ndarray, up: int, down: int, taps_per_phase: int) -> np.ndarray:
    """Polyphase rate change: only kept outputs are computed, each from its own phase."""
    phases = polyphase_filter(up, down, taps_per_phase)
    taps = phases.shape[1]
    n_out = -(-len(samples) * up // down)
    padded = np.pad(samples, (taps - 1, taps))
    out = np.empty(n_out, np.float32)
    shift = (phases.size - 1) // 2
    for r in range(up):
        # outputs n with (n * down + shift) mod up == r share a phase
        n = np.arange(r, n_out, up) if up > 1 else np.arange(n_out)
        if not len(n):
            continue
        t = n[0] * down + shift
        phase, first = t % up, t // up
        windows = np.lib.stride_tricks.sliding_window_view(padded, taps)[first :: down][: len(n)]
        if len(windows) < len(n):
            windows = np.vstack([windows, np.zeros((len(n) - len(windows), taps), np.float32)])
        out[n] = windows @ phases[phase][::-1]
    return out


@lru_cache(maxsize=8)
def mel_filters(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, (frame // 2 + 1, mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise = (f - edges[:-2]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)
    fall = (edges[2:] - f) / np.maximum(edges[2:] - edges[1:-1], 1e-9)
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def hysteresis(level: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Maximal frame runs above ``low`` that reach ``high`` somewhere, as [start, end)."""
    above = np.concatenate(([0], (level >= low).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(above))
    starts, ends = edge[::2], edge[1::2]
    peaks = np.maximum.reduceat(level, starts) if len(starts) else np.empty(0)
    return [(int(a), int(b)) for a, b, p in zip(starts, ends, peaks) if p >= high]


def features(payload: bytes, config: AudioConfig = AudioConfig()) -> tuple[np.ndarray, list[tuple[float, float]], int]:
    """A (windows, mels) tensor of mean log-mel energies, the segments in seconds, the frames.

    The whole payload is used, in blocks of frames that overlap by the filter's and the
    frame's length, so memory doesn't grow with the text. The last frame is padded with zeros.
    """
    rate = config.rate * config.up / config.down
    samples = np.frombuffer(payload, np.uint8)
    n_out = -(-len(samples) * config.up // config.down)
    n_frames = 1 + -(-max(0, n_out - config.frame) // config.hop)
    window = np.hanning(config.frame).astype(np.float32)
    filters = mel_filters(rate, config.frame, config.mels)
    sums = np.zeros((config.windows, config.mels), np.float64)
    counts = np.zeros(config.windows, np.int64)
    energies = []
    margin = 4 * config.taps_per_phase * max(config.up, config.down)
    for first in range(0, n_frames, config.block_frames):
        last = min(first + config.block_frames, n_frames)
        begin = first * config.hop * config.down // config.up
        lead = min(begin, -(-margin // config.down) * config.down)
        end = (last * config.hop + config.frame) * config.down // config.up + margin
        part = (samples[begin - lead : end].astype(np.float32) - 128) / 128
        slow = resample(part, config.up, config.down, config.taps_per_phase)[lead * config.up // config.down :]
        need = (last - first - 1) * config.hop + config.frame
        slow = np.pad(slow, (0, max(0, need - len(slow))))[:need]
        frames = np.lib.stride_tricks.sliding_window_view(slow, config.frame)[:: config.hop]
        spectrum = np.fft.rfft(frames * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel = np.log(power @ filters + 1e-6)
        at = np.arange(first, last) * config.windows // n_frames
        for w in np.unique(at):
            sums[w] += mel[at == w].sum(axis=0, dtype=np.float64)
            counts[w] += int((at == w).sum())
        energies.append(np.log((frames**2).mean(axis=1) + 1e-6))
    tensor = np.round(sums / np.maximum(counts, 1)[:, None], 3).astype(np.float32)
    energy = np.concatenate(energies)
    level = (energy - energy.mean()) / (energy.std() + 1e-6)
    step = config.hop / rate
    spans = [(a * step, ((b - 1) * config.hop + config.frame) / rate) for a, b in hysteresis(level, config.high, config.low)]
    return tensor, spans, n_frames


def tensor_column(tensors: list[np.ndarray]) -> pa.FixedShapeTensorArray:
    """Feature tensors of one shape as an Arrow fixed-shape tensor column."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.stack(tensors))


def with_tensors(rows: pa.Table) -> pa.Table:
    """Rows as Spark returns them (``df.toArrow()``) with ``tensor`` as a fixed-shape tensor column again.

    Spark's schema has no such type, so there a tensor is a list beside its ``tensor_shape``.
    """
    if not len(rows):
        return rows
    shapes = {tuple(s) for s in rows["tensor_shape"].to_pylist()}
    if len(shapes) != 1:
        raise ValueError(f"tensors of different shapes: {sorted(shapes)}")
    shape = shapes.pop()
    flat = rows["tensor"].combine_chunks().flatten()
    storage = pa.FixedSizeListArray.from_arrays(flat, int(np.prod(shape)))
    tensors = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape), storage)
    return rows.set_column(rows.schema.get_field_index("tensor"), "tensor", tensors)


def audio_features(docs: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``; see ``SCHEMA``.

    ``tensor`` is the row-major (windows, mels) tensor of the shape in ``tensor_shape``, an Arrow fixed-shape tensor
    by :func:`with_tensors`; ``spans`` are the segments' start and end
    seconds in turn; ``feature`` is their digest with the frame count. Hashes are of what was
    read back from the stored form. Null text counts as empty and is padded to one unit of
    spaces; ids may be null or repeat, each row returns, equal texts with equal values; other columns are not read.
    An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                n_bytes, payload = payload_of(text.as_py(), config.pad_to)
                media = store(payload, config.rate)
                back = read_back(media)
                tensor, spans, n_frames = features(back, config)
                times = np.asarray(spans, np.float32).ravel()
                digest = hashlib.sha256(tensor.tobytes() + times.tobytes()).hexdigest()[:32]
                rows.append(
                    (doc_id, n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media),
                     hashlib.sha256(media).hexdigest(), f"logmel{config.windows}x{config.mels}:{n_frames}:{len(spans)}:{digest}",
                     n_frames, len(spans), tensor, times)
                )
            if not rows:
                continue
            columns = list(zip(*rows))
            longs = {0, 1, 2, 4, 5, 8, 9}
            arrays = [pa.array(c, pa.int64() if k in longs else pa.string()) for k, c in enumerate(columns[:10])]
            stored = tensor_column(list(columns[10])).storage
            shape = pa.array([[config.windows, config.mels]] * len(rows), pa.list_(pa.int32()))
            arrays += [stored.cast(pa.list_(pa.float32())), shape, pa.array(columns[11], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op10_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(table(spark, sf_dir, "documents").select("doc_id", "text"))
