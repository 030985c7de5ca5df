"""Numbers packed into binaries, and the mixing of keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

STEP, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)  # odd constants for keys


def pack(values: np.ndarray) -> bytes:
    """Non-negative numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd", 1).decompress(data[8:], n * 8, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).reshape(-1).view(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(32))) * STEP
    keys = (keys ^ (keys >> np.uint64(29))) * END
    return keys ^ (keys >> np.uint64(32))
