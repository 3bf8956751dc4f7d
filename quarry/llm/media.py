"""Media columns: 8-bit audio in a binary column, and features of it.

A payload is stored losslessly as the samples of a WAV file (mono, unsigned 8 bit). Features come from the stored bytes
read back: polyphase resampling, overlapped log-mel filterbanks, and segments by energy with hysteresis. The
filterbank of each clip is pooled to one fixed shape; tasks store it with the time spans as Arrow's fixed-shape tensor in files of the shared folder.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from .common import discard, materialize, runs, work_dir

#: Samples per second as stored, and the resampling ratio (up / down) and its taps per phase.
RATE, UP, DOWN, TAPS = 16_000, 1, 4, 16
#: Frame and hop in resampled samples, mel filters, time steps of the pooled tensor, payload bytes analysed at once.
FRAME, HOP, MELS, STEPS, BYTES_AT_ONCE = 256, 128, 24, 32, 2_000_000
SHAPE = (STEPS, MELS)
PAD_TO = 64


def wav(payload: bytes) -> bytes:
    """The payload as the samples of a mono 8-bit WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The data chunk of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as UTF-8, padded by bytes 0 to a positive multiple of 64. Null text counts as empty.

    One row for each row, with null and repeated ids as they are; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                clips = [wav(t + bytes(-len(t) % PAD_TO or (0 if t else PAD_TO))) for t in raw]
                yield pa.record_batch([part.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(clips, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _taps(up: int, down: int, per_phase: int) -> np.ndarray:
    """A Hann-windowed sinc low-pass, in whole 1/4096, so that sums of products with samples are exact."""
    n = per_phase * max(up, down)
    k = np.arange(n) - (n - 1) / 2
    h = np.sinc(k / max(up, down)) * np.hanning(n + 2)[1:-1]
    return np.round(h / h.sum() * up * 4096)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, per_phase: int = TAPS) -> np.ndarray:
    """x at up / down times its rate. Each output sample uses one phase of the filter; samples beyond the ends count as 0."""
    h = _taps(up, down, per_phase)
    n_out = -(-len(x) * up // down)
    out = np.zeros(n_out)
    middle = len(h) // 2
    for first in range(min(up, n_out)):  # the outputs first, first + up, ... share one phase of the filter
        mine = np.arange(first, n_out, up)
        newest = (mine * down + middle) // up
        taps = h[(first * down + middle) % up :: up]
        if up == 1:  # split x by its place modulo `down`, and convolve each part with its taps
            padded = np.zeros((n_out + per_phase + 2) * down + len(h))
            padded[len(h) : len(h) + len(x)] = x[: len(padded) - len(h)]
            for d in range(down):
                at = (newest - d + len(h)) // down
                out[mine] += np.convolve(padded[(middle - d) % down :: down], taps[d::down])[at]
        else:
            for j, t in enumerate(taps):
                i = newest - j
                ok = (i >= 0) & (i < len(x))
                out[mine[ok]] += t * x[i[ok]]
    return out / 4096


def _filters(rate: float) -> np.ndarray:
    """Triangular filters evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(30), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down))


def segments(energy: np.ndarray, clip: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of frames of one clip at or above the low threshold that reach the high one: clip, first frame, end.

    Per clip the thresholds lie half a standard deviation below and above its mean energy.
    """
    count = np.maximum(np.bincount(clip, minlength=n), 1)
    mean = np.bincount(clip, energy, n) / count
    spread = np.sqrt(np.maximum(np.bincount(clip, energy * energy, n) / count - mean * mean, 0))
    low, high = energy >= (mean - spread / 2)[clip], energy >= (mean + spread / 2)[clip]
    edge = np.ones(len(energy), bool)
    edge[1:] = clip[1:] != clip[:-1]
    start = np.flatnonzero(low & (edge | ~np.r_[False, low[:-1]]))
    end = np.flatnonzero(low & np.r_[edge[1:] | ~low[1:], [True] * bool(len(low))]) + 1
    reached = np.concatenate([[0], np.cumsum(high)])
    keep = reached[end] > reached[start]
    return clip[start[keep]], start[keep], end[keep]


def analysed(payloads: list[bytes]) -> tuple[np.ndarray, list[list[dict]], list[str]]:
    """Of each payload its pooled log-mel tensor (in whole 1/1000), its segments as time spans in seconds, and a digest that tells of both."""
    n, gap = len(payloads), TAPS * DOWN  # silence between clips is as long as the filter
    joined = b"".join(p + bytes([128]) * (gap + -len(p) % DOWN) for p in payloads)
    x = np.frombuffer(joined, np.uint8).astype(np.float64) - 128
    y = resample(x)
    length = np.array([-(-len(p) // DOWN) for p in payloads])
    first = np.cumsum(length + gap // DOWN) - length - gap // DOWN
    frames = np.maximum(1, -(-(length - FRAME) // HOP) + 1)
    clip = np.repeat(np.arange(n), frames)
    inside = np.arange(frames.sum()) - np.repeat(np.cumsum(frames) - frames, frames)
    at = (first[clip] + inside * HOP)[:, None] + np.arange(FRAME)
    cut = y[np.minimum(at, len(y) - 1)]
    cut[at >= (first + length)[clip][:, None]] = 0
    rate = RATE * UP / DOWN
    power = np.abs(np.fft.rfft(cut * np.hanning(FRAME), axis=1)) ** 2
    mel = np.log(power @ _filters(rate) + 1.0)
    energy = np.log((cut * cut).sum(1) + 1.0).round(6)
    owner, start, end = segments(energy, clip, n)
    base = np.cumsum(frames) - frames
    spans: list[list[dict]] = [[] for _ in range(n)]
    for c, a, b in zip(owner.tolist(), (start - base[owner]).tolist(), (end - base[owner]).tolist(), strict=True):
        spans[c].append({"start": a * HOP / rate, "end": ((b - 1) * HOP + FRAME) / rate})
    # Pool to STEPS time steps; a clip with fewer frames repeats them.
    grid = clip * STEPS + inside * STEPS // frames[clip]
    total = np.stack([np.bincount(grid, mel[:, k], n * STEPS) for k in range(MELS)], 1)
    filled = np.bincount(grid, minlength=n * STEPS)
    source = np.where(filled > 0, np.arange(n * STEPS), 0)
    source = np.maximum.accumulate(source.reshape(n, STEPS), axis=1).ravel()
    source = np.maximum(source, np.repeat(np.arange(n) * STEPS, STEPS))
    tensor = np.round((total / np.maximum(filled, 1)[:, None])[source].reshape(n, *SHAPE) * 1000) / 1000
    mean = np.stack([np.bincount(clip, mel[:, k], n) for k in range(MELS)], 1) / frames[:, None]
    heard = np.bincount(owner, end - start, n)
    whole = [hashlib.blake2b(t.astype("<f4").tobytes() + repr(s).encode(), digest_size=8).hexdigest() for t, s in zip(tensor, spans, strict=True)]
    digest = [f"frames={f};segments={len(s)};active={h / f:.4f};mel=" + ",".join(f"{v:.3f}" for v in m) + f";tensor={w}" for f, s, h, m, w in zip(frames.tolist(), spans, heard.tolist(), mean, whole, strict=True)]
    return tensor, spans, digest


#: Tensors are stored in whole 1/1000, as analysed() rounds them.
TENSOR = pa.fixed_shape_tensor(pa.int16(), SHAPE)


def as_tensor(column: pa.Array) -> pa.FixedShapeTensorArray:
    """A tensor column (array<float>) as Arrow's fixed-shape tensor of SHAPE, in whole 1/1000."""
    whole = np.clip(np.rint(np.asarray(pc.list_flatten(column), np.float64) * 1000), -32768, 32767).astype(np.int16)
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(whole), STEPS * MELS))


def as_lists(column: pa.FixedShapeTensorArray) -> pa.Array:
    """What as_tensor() was made of."""
    flat = (np.asarray(column.storage.flatten()).astype(np.float64) / 1000).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, STEPS * MELS, dtype=np.int32)), pa.array(flat))


def filed(found: DataFrame, path: str) -> DataFrame:
    """Write features() as Arrow files below path, one a task, with the tensors as TENSOR; file and rows of each.

    A file counts once Spark has taken its task's row, so what a lost or repeated task wrote is named by none.
    """

    def run(batches):
        store, root = pafs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name, rows, writer = f"{root}/{uuid.uuid4().hex}.arrow", 0, None
        with store.open_output_stream(name) as sink:
            for batch in batches:
                part = batch.set_column(batch.schema.get_field_index("tensor"), pa.field("tensor", TENSOR), as_tensor(batch.column("tensor")))
                writer = writer or pa.ipc.new_file(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(part)
                rows += part.num_rows
            if writer is not None:
                writer.close()
        if rows:
            yield pa.record_batch([pa.array([name]), pa.array([rows], pa.int64())], ["file", "rows"])

    return found.mapInArrow(run, "file string, rows long")


def read_back(files: DataFrame, path: str, kind) -> DataFrame:
    """The rows of the Arrow files that filed() names, of schema kind; each task reads files of its own."""

    def run(batches):
        store, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_file(name) as source, pa.ipc.open_file(source) as held:
                    for k in range(held.num_record_batches):
                        part = held.get_batch(k)
                        at = part.schema.get_field_index("tensor")
                        yield part.set_column(at, "tensor", as_lists(part.column(at)))

    return files.repartition(max(1, files.count())).mapInArrow(run, kind)


def features(media: DataFrame, tensors: bool = True) -> DataFrame:
    """Features of a table from store(): hashes of the bytes read back, spans in seconds, the pooled log-mel tensor, a digest.

    One row for each row, repeated ones too; a null clip fails, as store() never writes one. Equal texts have equal values. Clips are
    analysed about BYTES_AT_ONCE together; a longer one is analysed whole, at some tens of bytes of memory a byte. The tensor is SHAPE
    flattened by rows, for as_tensor().
    """

    def run(batches):
        for batch in batches:
            clips = batch.column("media")
            sizes = np.asarray(pc.binary_length(clips)).astype(np.int64)
            for lo, hi in runs(sizes, BYTES_AT_ONCE):
                part = batch.slice(lo, hi - lo)
                held = part.column("media").to_pylist()
                payloads = [samples(m) for m in held]
                tensor, spans, digest = analysed(payloads)
                out = [part.column("doc_id"), part.column("n_bytes"), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-PAD_TO:]) for p in payloads], pa.int64()), pa.array([len(m) for m in held], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in held]), pa.array(digest), pa.array(spans, pa.list_(pa.struct({"start": pa.float64(), "end": pa.float64()})))]
                if tensors:
                    out.append(pa.array(list(tensor.reshape(len(held), -1).astype(np.float32)), pa.list_(pa.float32())))
                yield pa.record_batch(out, names[: len(out)])

    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, spans array<struct<start:double,end:double>>" + ", tensor array<float>" * tensors
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "spans", "tensor"]
    return media.mapInArrow(run, kind)


def stored_features(spark: SparkSession, docs: DataFrame, tensors: bool = True) -> DataFrame:
    """Write the media table to the shared folder, compute features from the bytes read back, and with tensors write these as Arrow files and read them back too."""
    held = materialize(spark, store(docs), "media")
    found = features(held, tensors)
    if not tensors:
        return found
    path = f"{work_dir(spark)}/quarry/tensors-{uuid.uuid4().hex}"
    files = materialize(spark, filed(found, path), "tensor-files")
    discard(spark, held)
    return read_back(files, path, found.schema)
