"""Vector columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vector is there and finite, and those vectors in double precision."""
    rows, out = [], []
    for i, x in enumerate(column.to_pylist()):
        if x is None or any(v is None for v in x):
            continue
        v = np.array(x, dtype=np.float64)
        if np.isfinite(v).all():
            rows.append(i)
            out.append(v)
    return np.array(rows, dtype=np.int64), out


def packed(v: np.ndarray) -> bytes:
    """A vector as bytes: single precision where that holds it exactly, else double."""
    single = v.astype(np.float32)
    return b"s" + single.tobytes() if (single == v).all() else b"d" + v.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=np.float32 if b[:1] == b"s" else np.float64, offset=1).astype(np.float64)


def units(x: np.ndarray) -> np.ndarray:
    """Rows by their lengths, scaled first so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rectangle(vectors: list[np.ndarray]) -> np.ndarray:
    """Shorter vectors end in zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), dtype=vectors[0].dtype if vectors else np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out
