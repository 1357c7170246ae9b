"""Arrays packed for a shuffle: bytes of equal place together, then zstandard."""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard


def pack(arrays: dict[str, np.ndarray], level: int = 1) -> bytes:
    """Named arrays of numbers as one value; ``level`` is zstandard's."""
    parts, head = [], []
    for name, array in arrays.items():
        array = np.ascontiguousarray(array)
        size = array.dtype.itemsize
        parts.append(array.view(np.uint8).reshape(-1, size).T.tobytes() if len(array) else b"")
        head.append([name, array.dtype.str, len(array)])
    text = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=level).compress(
        struct.pack("<i", len(text)) + text + b"".join(parts)
    )


def unpack(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of :func:`pack`."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = struct.unpack_from("<i", raw)[0]
    at, out = 4 + n, {}
    for name, kind, count in json.loads(raw[4:at]):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size * count, at).reshape(size, count)
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
        at += size * count
    return out


def mixed_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD1B54A32D192ED03))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))
