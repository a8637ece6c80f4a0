"""Sorted 64-bit numbers as bytes: differences of one width, so that shuffles carry less."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in as few bytes each as the largest needs: (width, little-endian bytes)."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return width, x.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(width: int, data: bytes) -> np.ndarray:
    """Undo :func:`narrow`."""
    flat = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :width] = flat
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> tuple[int, bytes]:
    """Ascending numbers as differences: (width, bytes)."""
    return narrow(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(width: int, data: bytes) -> np.ndarray:
    return np.cumsum(widen(width, data), dtype=np.uint64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive runs of ``values``, ``counts`` long, as a list column."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binaries(rows: np.ndarray, counts: np.ndarray, present: np.ndarray) -> pa.Array:
    """Consecutive runs of byte rows as a binary column, null where not ``present``."""
    flat = np.ascontiguousarray(rows)
    ends = np.cumsum(counts) * rows.shape[1]
    starts = ends - counts * rows.shape[1]
    data = flat.tobytes()
    return pa.array([data[a:b] if ok else None for a, b, ok in zip(starts.tolist(), ends.tolist(), present.tolist(), strict=True)], pa.binary())


_ZSTD = "zstd"


def ints(x: np.ndarray) -> bytes:
    """Whole numbers from 0 up, self-describing."""
    width, data = narrow(x)
    return bytes([width]) + data


def from_ints(data: bytes) -> np.ndarray:
    return widen(data[0], data[1:]).astype(np.int64)


def rising(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers, self-describing."""
    width, data = pack_sorted(x)
    return bytes([width]) + data


def from_rising(data: bytes) -> np.ndarray:
    return unpack_sorted(data[0], data[1:])


def bundle(*parts: bytes) -> bytes:
    """Several byte strings as one, compressed."""
    sizes = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    raw = sizes + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec(_ZSTD, compression_level=1).compress(raw, asbytes=True)


def unbundle(data: bytes) -> list[bytes]:
    raw = pa.Codec(_ZSTD).decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<i8", n + 1, 0)[1:]) + 8 * (n + 1)
    starts = [8 * (n + 1), *ends.tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=False)]
