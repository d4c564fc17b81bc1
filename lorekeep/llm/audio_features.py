"""9. Media columns: audio features of 8-bit samples.

A payload is stored as a WAV file of unsigned 8-bit samples, read back, resampled by a polyphase
filter, cut into overlapping frames, and turned into log-mel energies; frames between two energy
thresholds keep the state they are in (hysteresis), which gives segments with time spans.  Each
segment's energies are pooled to a fixed shape, [POOLED, MELS], and kept as one Arrow tensor column.

A payload is worked on in blocks of frames, with the state carried over, so that memory stays
bounded for texts of any length.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE = 8000
UP, DOWN = 2, 5  # to 3200 samples a second
TAPS = 16
FRAME, HOP, MELS = 256, 128, 16
BLOCK = 4096  # frames worked on at once
HIGH, LOW = 0.5, -0.5  # thresholds, in standard deviations from the running mean of the frames' energy
POOLED = 4
MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, spans array<struct<start_ms:long,end_ms:long>>, tensor binary, feature string"


def payload_of(text: bytes) -> bytes:
    """Bytes padded with 0 to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def to_wav(payload: bytes) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples."""
    n = len(payload)
    return b"".join((b"RIFF", struct.pack("<I", (36 + n + (n & 1)) & 0xFFFFFFFF), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8), b"data", struct.pack("<I", n & 0xFFFFFFFF), payload, b"\0" * (n & 1)))


def from_wav(media: bytes) -> bytes:
    """The samples of a RIFF file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def _filter() -> np.ndarray:
    """Windowed-sinc low-pass, TAPS coefficients for each of the UP phases."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return (h / h.sum() * UP).reshape(TAPS, UP).T[:, ::-1].astype(np.float32).copy()


def _mel_bank() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(up, down), 0, None).astype(np.float32)


_PHASES, _BANK, _WINDOW = _filter(), _mel_bank(), np.hanning(FRAME).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """float32 samples at RATE * UP / DOWN: output k is phase (k * DOWN) % UP of the filter at input k * DOWN // UP."""
    x = np.concatenate([np.zeros(TAPS - 1, np.float32), samples])
    views = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    n = -(-len(samples) * UP // DOWN)
    out = np.empty(n, np.float32)
    for first in range(UP):  # outputs first, first + UP, ... share a phase
        k = np.arange(first, n, UP)
        if len(k):
            at = k[0] * DOWN // UP
            v = views[at :: DOWN][: len(k)]
            acc = np.zeros(len(k), np.float32)
            for j in range(TAPS):
                acc += v[:, j] * _PHASES[first * DOWN % UP, j]
            out[first::UP] = acc
    return out


def log_mels(samples: bytes):
    """Blocks of log-mel energies, [frames, MELS] of float32."""
    per_block = BLOCK * HOP * DOWN // UP
    carry = np.zeros(0, np.float32)
    for at in range(0, len(samples), per_block):
        lead = samples[max(0, at - TAPS * DOWN) : at]
        x = np.frombuffer(lead + samples[at : at + per_block], np.uint8).astype(np.float32) / 128 - 1
        y = resample(x)[len(lead) * UP // DOWN :]
        y = np.concatenate([carry, y])
        last = at + per_block >= len(samples)
        n = len(y) // HOP - 1 if not last else max(1, -(-(len(y) - FRAME) // HOP) + 1)
        if last and len(y) < (n - 1) * HOP + FRAME:
            y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)])
        if n < 1:
            carry = y
            continue
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[:: HOP][:n] * _WINDOW
        power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
        yield np.log(np.maximum(np.einsum("ij,jk->ik", power, _BANK), 1e-6))
        carry = y[n * HOP :]


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) frames that are on: on from HIGH, off below LOW, else as before."""
    mean, sd = float(energy.mean()), float(energy.std()) or 1.0
    z = (energy - mean) / sd
    mark = np.where(z >= HIGH, 1, np.where(z < LOW, 0, -1)).astype(np.int8)
    seen = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], np.where(seen >= 0, mark[seen] == 1, False), [False]])
    turn = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(turn[::2].tolist(), turn[1::2].tolist()))


def tensor_ipc(x: np.ndarray) -> bytes:
    """An Arrow IPC stream of one fixed-shape tensor column: [segments] of [POOLED, MELS] float32."""
    kind = pa.fixed_shape_tensor(pa.float32(), [POOLED, MELS])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), pa.float32()), POOLED * MELS)
    batch = pa.record_batch([pa.ExtensionArray.from_storage(kind, storage)], names=["log_mel"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def read_tensor(data: bytes) -> np.ndarray:
    """[segments, POOLED, MELS] of a stored tensor column."""
    batch = pa.ipc.open_stream(data).read_all()
    return batch.column(0).combine_chunks().to_numpy_ndarray()


def features(samples: bytes) -> tuple[int, list[dict], bytes, str]:
    """(frames, time spans, tensor, digest line) of a payload."""
    mels = np.concatenate(list(log_mels(samples)))
    spans = segments(mels.mean(axis=1))
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mels, axis=0, dtype=np.float64)])
    if spans:
        first, end = np.array(spans).T
        cut = first[:, None] + (end - first)[:, None] * np.arange(POOLED + 1) // POOLED
        lo, hi = np.minimum(cut[:, :-1], end[:, None] - 1), cut[:, 1:]
        hi = np.maximum(hi, lo + 1)  # a part of a segment shorter than POOLED repeats a frame
        pooled = ((sums[hi] - sums[lo]) / (hi - lo)[..., None]).astype(np.float32)
    else:
        pooled = np.zeros((0, POOLED, MELS), np.float32)
    ms = 1000 * HOP * DOWN / (RATE * UP)
    mean = sums[-1] / len(mels)
    line = f"frames={len(mels)};segments={len(spans)};on={sum(b - a for a, b in spans)};mel=" + ",".join(f"{v:.3f}" for v in mean)
    return len(mels), [{"start_ms": int(a * ms), "end_ms": int(b * ms)} for a, b in spans], tensor_ipc(pooled), line


def audio_columns(docs: DataFrame) -> DataFrame:
    """Media columns of every row of docs (doc_id, text); see MEDIA.

    A null or empty text is 64 zero bytes; equal texts give equal values; repeated rows each give a
    row; an empty table none.  feature has the numbers of frames, segments and frames in them, and
    the mean log-mel energies; tensor the pooled energies of each segment, spans its times.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part, out = b.slice(at, 200), []
                for x in part.column(1):
                    text = (x.as_py() or "").encode()
                    media = to_wav(payload_of(text))
                    payload = from_wav(media)
                    out.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), *features(payload)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])), pa.binary(), pa.string()]
                names = [x.split()[0] for x in MEDIA.replace("start_ms:long,end_ms:long", "").split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=names)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, MEDIA)
