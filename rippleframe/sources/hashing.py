"""BLAKE3 over Arrow batches of byte strings.

Spark has no BLAKE3. Messages of equal length are hashed together with NumPy, one
lane per message, so a batch costs a fixed number of array operations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the hash function.
IV = [0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19]
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT, KEYED = 1, 2, 4, 8, 16
CHUNK = 1024


def _rotate(x, n):
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _mix(v, a, b, c, d, x, y):
    v[a] = v[a] + v[b] + x
    v[d] = _rotate(v[d] ^ v[a], 16)
    v[c] = v[c] + v[d]
    v[b] = _rotate(v[b] ^ v[c], 12)
    v[a] = v[a] + v[b] + y
    v[d] = _rotate(v[d] ^ v[a], 8)
    v[c] = v[c] + v[d]
    v[b] = _rotate(v[b] ^ v[c], 7)


def _compress(cv, words, counter, length, flags):
    lanes = words.shape[1]
    full = lambda x: np.full(lanes, x & 0xFFFFFFFF, dtype=np.uint32)
    v = [c.copy() for c in cv] + [full(x) for x in (*IV[:4], counter, counter >> 32, length, flags)]
    m = list(words)
    for _ in range(7):
        for i in range(4):
            _mix(v, i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            _mix(v, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[p] for p in PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _chunk(data, key, base, counter, root):
    """Chaining value of one chunk for all lanes; ``data`` is [lanes, bytes]."""
    cv, size = key, data.shape[1]
    starts = list(range(0, size, 64)) or [0]
    for i, at in enumerate(starts):
        part = data[:, at : at + 64]
        block = np.zeros((data.shape[0], 64), dtype=np.uint8)
        block[:, : part.shape[1]] = part
        flags = base | (CHUNK_START if i == 0 else 0)
        if i == len(starts) - 1:
            flags |= CHUNK_END | (ROOT if root else 0)
        cv = _compress(cv, block.view("<u4").T, counter, part.shape[1], flags)
    return cv


def _tree(data, key, base, counter, root):
    size = data.shape[1]
    if size <= CHUNK:
        return _chunk(data, key, base, counter, root)
    chunks = -(-size // CHUNK)
    left = 1 << ((chunks - 1).bit_length() - 1)
    a = _tree(data[:, : left * CHUNK], key, base, counter, False)
    c = _tree(data[:, left * CHUNK :], key, base, counter + left, False)
    return _compress(key, np.stack(a + c), 0, 64, base | PARENT | (ROOT if root else 0))


def blake3_batch(messages: list[bytes], key: bytes | None = None) -> list[bytes]:
    """32-byte digests, keyed when a 32-byte key is given."""
    out: list[bytes | None] = [None] * len(messages)
    groups: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        groups.setdefault(len(m), []).append(i)
    words = np.frombuffer(key, dtype="<u4") if key else np.array(IV, dtype=np.uint32)
    for size, index in groups.items():
        data = np.frombuffer(b"".join(messages[i] for i in index), dtype=np.uint8).reshape(len(index), size)
        start = [np.full(len(index), w, dtype=np.uint32) for w in words]
        digest = np.stack(_tree(data, start, KEYED if key else 0, 0, True), axis=1).astype("<u4")
        for i, row in zip(index, digest):
            out[i] = row.tobytes()
    return out


def blake3(data: Column | str, key: bytes | None = None) -> Column:
    """BLAKE3-256 of a binary column; null stays null."""

    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        out[known] = blake3_batch([bytes(v) for v in values[known]], key)
        return out

    return run(data)
