"""Content hashes. SHA-256 is Spark's own; BLAKE3 is computed in Arrow batches, as neither Spark nor the box has it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the BLAKE3 specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK_BLOCKS, MASK = 64, 16, np.uint64(0xFFFFFFFF)
BATCH_BYTES = 1 << 22
COLUMNS_THEN_DIAGONALS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(chain: np.ndarray, m: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The compression of many blocks in step: ``chain`` 8 x n, ``m`` 16 x n, the rest n; 8 x n."""
    n = chain.shape[1]
    v = np.empty((16, n), np.uint32)
    v[:8], v[8:12] = chain, np.array(IV[:4], np.uint32)[:, None]
    v[12], v[13], v[14], v[15] = counter & MASK, counter >> np.uint64(32), size, flags
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(COLUMNS_THEN_DIAGONALS):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] += v[b] + word
                x = v[d] ^ v[a]
                v[d] = x >> r1 | x << (32 - r1)
                v[c] += v[d]
                x = v[b] ^ v[c]
                v[b] = x >> r2 | x << (32 - r2)
        m = m[list(PERMUTATION)]
    return v[:8] ^ v[8:]


def _chunks(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chaining values of all chunks (8 x n) and how many chunks each item has."""
    sizes = np.array([len(x) for x in items], np.int64)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    words = np.frombuffer(b"".join(x.ljust(n * BLOCK, b"\0") for x, n in zip(items, blocks.tolist(), strict=True)), "<u4").reshape(-1, 16)
    count = -(-blocks // CHUNK_BLOCKS)
    item = np.repeat(np.arange(len(items)), count)
    number = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    first = (np.cumsum(blocks) - blocks)[item] + number * CHUNK_BLOCKS
    of = np.minimum(CHUNK_BLOCKS, blocks[item] - number * CHUNK_BLOCKS)
    chain = np.repeat(np.array(IV, np.uint32)[:, None], len(item), axis=1)
    for k in range(int(of.max(initial=0))):
        on = np.flatnonzero(of > k)
        last = of[on] == k + 1
        ends = number[on] + 1 == count[item[on]]
        size = np.where(last & ends, sizes[item[on]] - (blocks[item[on]] - 1) * BLOCK, BLOCK)
        flags = CHUNK_START * (k == 0) + CHUNK_END * last + ROOT * (last & (count[item[on]] == 1))
        chain[:, on] = _compress(chain[:, on], words[first[on] + k].T, number[on].astype(np.uint64), size, flags)
    return chain, count


def blake3_many(items: list[bytes]) -> list[str]:
    """Hex BLAKE3 of each item; blocks at the same place of their chunks, and nodes at the same height of their trees, are computed together."""
    if not items:
        return []
    chain, count = _chunks(items)
    while count.max() > 1:
        within = np.arange(chain.shape[1]) - np.repeat(np.cumsum(count) - count, count)
        total = np.repeat(count, count)
        left = np.flatnonzero((within % 2 == 0) & (within + 1 < total))
        flags = PARENT + ROOT * (total[left] == 2)
        zero = np.zeros(len(left), np.uint64)
        start = np.repeat(np.array(IV, np.uint32)[:, None], len(left), axis=1)
        # a node without a neighbour goes up as it is
        chain[:, left] = _compress(start, np.concatenate([chain[:, left], chain[:, left + 1]]), zero, zero + np.uint64(BLOCK), flags)
        chain, count = chain[:, within % 2 == 0], -(-count // 2)
    return [x.tobytes().hex() for x in np.ascontiguousarray(chain.T.astype("<u4"))]


def blake3_hex(data: bytes) -> str:
    return blake3_many([data])[0]


def _parts(items: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Runs of items of about BATCH_BYTES."""
    part: list[bytes | None] = []
    size = 0
    for x in items:
        if part and size + len(x or b"") > BATCH_BYTES:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x or b"")
    yield part


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def blake3(c: Column) -> Column:
    """Hex BLAKE3 of a binary column."""

    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[str | None] = []
            for part in _parts([None if x is None else bytes(x) for x in batch]):
                found = iter(blake3_many([x for x in part if x is not None]))
                out += [None if x is None else next(found) for x in part]
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(hashed, "string")(c.cast("binary"))
