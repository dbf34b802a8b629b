"""Arrays as compressed values that travel between blocks of documents and shards of hashes."""

from __future__ import annotations

import numpy as np
import zstandard

from eventloom.llm.words import U


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for part in raw[4:at].decode().split(";"):
        kind, n = part.split(",")
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += out[-1].nbytes
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in as few bytes as hold them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def planes(sorted_keys: np.ndarray) -> np.ndarray:
    """Sorted 64-bit keys as differences in as few byte planes as they need (the number of planes comes first)."""
    d = np.diff(sorted_keys, prepend=U(0))
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return np.concatenate([[np.uint8(width)], d.view(np.uint8).reshape(-1, 8)[:, :width].T.ravel()])


def unplanes(raw: np.ndarray) -> np.ndarray:
    width = int(raw[0])
    n = (len(raw) - 1) // width
    d = np.zeros((n, 8), np.uint8)
    d[:, :width] = raw[1:].reshape(width, n).T
    return np.cumsum(d.view(U).ravel())


def shard_cuts(key: np.ndarray, shards: int, bits: int = 64) -> np.ndarray:
    """Where each shard's stretch of the sorted keys begins: shards are equal ranges of the hash of so many bits."""
    step = (1 << bits) // shards + 1
    return np.append(np.searchsorted(key, (np.arange(shards, dtype=object) * step).astype(U)), len(key))
