"""Vectorised text kernels shared by the operators; all work on UTF-8 bytes or code points of whole texts."""

from __future__ import annotations

import ctypes
import gc
import hashlib

import numpy as np

U64 = np.uint64
#: Words are runs without these bytes; only A-Z are folded.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20


_SHIFT_A, _SHIFT_B, _SHIFT_C = U64(30), U64(27), U64(31)
_MULTIPLY_A, _MULTIPLY_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise; array products wrap around."""
    x = (x ^ (x >> _SHIFT_A)) * _MULTIPLY_A
    x = (x ^ (x >> _SHIFT_B)) * _MULTIPLY_B
    return x ^ (x >> _SHIFT_C)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_EXACT = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0xD1342543DE82EF95))
#: Spans above this many bytes are hashed one by one, by BLAKE2.
_LONG = 128
_FULL = U64(0xFFFFFFFFFFFFFFFF)


def blocks_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of data as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,))


def _masked(blocks: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    bits = np.minimum(left, 8).astype(U64) * U64(8)
    return blocks[at] & np.where(bits == U64(64), _FULL, (U64(1) << (bits & U64(63))) - U64(1))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span data[start:end]; it depends on the span's bytes alone.

    Eight bytes at a time go through a mixing permutation, so no length or pattern of bytes cancels out; spans of up to
    eight bytes and equal length never collide. Long spans take BLAKE2.
    """
    blocks = blocks_of(data) if blocks is None else blocks
    size = ends - starts
    short = np.flatnonzero(size <= _LONG)
    state = mix(size.astype(U64) + U64(0xA0761D6478BD642F))
    at, left = starts[short], size[short]
    while len(short):
        state[short] = mix(state[short] ^ _masked(blocks, at, left))
        more = np.flatnonzero(left > 8)
        short, at, left = short[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _LONG).tolist():
        state[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return state


def same_spans(data: np.ndarray, blocks: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray, other_blocks: np.ndarray | None = None) -> np.ndarray:
    """Whether spans of equal size hold the same bytes; others may lie in other data of which blocks are given."""
    other_blocks = blocks if other_blocks is None else other_blocks
    same = np.ones(len(starts), bool)
    open_, at, to, left = np.arange(len(starts)), starts, others, sizes
    while len(open_):
        equal = _masked(blocks, at, left) == _masked(other_blocks, to, left)
        same[open_[~equal]] = False
        more = np.flatnonzero(equal & (left > 8))
        open_, at, to, left = open_[more], at[more] + 8, to[more] + 8, left[more] - 8
    return same


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word, A-Z folded. Long data go in chunks that end between words."""
    hashes, begins, at, n = [], [], 0, len(data)
    while at < n:
        end = min(n, at + _CHUNK)
        while end < n and not _SEP[data[end]]:
            gaps = np.flatnonzero(_SEP[data[end : end + _CHUNK]])
            end = min(n, end + (int(gaps[0]) if len(gaps) else _CHUNK))
        part = data[at:end]
        edge = np.ones(len(part) + 2, bool)
        edge[1:-1] = _SEP[part]
        turns = np.flatnonzero(edge[1:] != edge[:-1])
        hashes.append(span_hashes(_FOLD[part], turns[0::2], turns[1::2]))
        begins.append(turns[0::2] + at)
        at = end
    if not hashes:
        return np.empty(0, U64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins)


def _fold(words: np.ndarray, size: int) -> np.ndarray:
    total = mix(words[: len(words) - size + 1] + U64(size))
    for k in range(1, size):
        total = mix(total * U64(_BASE) + words[k : len(words) - size + 1 + k])
    return total


def batch_shingles(texts: list, width: int = 5):
    """For each text (bytes or None) the sorted distinct hashes of its word shingles.

    Fewer words than width count as one shingle; a text without words has the empty set.
    Texts are hashed together in runs of about a megabyte, so that short ones cost little.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= _CHUNK):
            size += len(texts[end] or b"") + 1
            end += 1
        run = [x or b"" for x in texts[at:end]]
        hashes, begins = _words(np.frombuffer(b"\n".join(run), np.uint8))
        edges = np.zeros(len(run) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in run], out=edges[1:])
        cuts = np.searchsorted(begins, edges)
        full = _fold(hashes, width) if len(hashes) >= width else None
        for k in range(len(run)):
            a, b = int(cuts[k]), int(cuts[k + 1])
            if b - a >= width:
                yield distinct(full[a : b - width + 1])
            elif b > a:
                yield _fold(hashes[a:b], b - a)
            else:
                yield np.empty(0, U64)
        at = end


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width bytes, built by doubling."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    total, done = None, 0
    block, size, factor, rest = _EXACT[data], 1, _BASE, width
    while rest:
        if rest & 1:
            if total is None:
                total, done = block, size
            else:
                total = total[: len(total) - size] * U64(factor) + block[done:]
                done += size
        rest >>= 1
        if rest:
            block = block[: len(block) - size] * U64(factor) + block[size:]
            size *= 2
            factor = factor * factor & (1 << 64) - 1
    return mix(total[:n])


def as_bytes(column) -> list:
    """The values of an Arrow string column as UTF-8 bytes, nulls as None."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def _trim() -> None:
    """Hand freed memory back to the system: a worker lives on after its task, beside those of later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, rows: int = 512):
    """Arrow batches in runs of a few rows, so that a task holds few whole texts as Python objects at once."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        gc.collect()
        _trim()
