"""Five-word shingle sets of whole texts, hashed over an Arrow batch at once.

Words are lower-cased for A to Z. A text's set holds its distinct runs of five words; a text of fewer words has one
shingle, the whole sequence; a text without words has none. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
CHUNK_BYTES = 1 << 20

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _random.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64((0xBF58476D1CE4E5B9 + 2 * seed) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, size: int) -> np.ndarray:
    if len(_powers[kind]) < size:
        steps = np.full(max(size, CHUNK_BYTES), np.uint64(_BASE if kind == "up" else _INVERSE), dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:size]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def _hashed(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The set of each text of a chunk, as sorted hashes; `bounds` are the texts' byte offsets in `data`."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    edge = inside[1:] != inside[:-1]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside[1:] & (edge | cut))
    ends = np.flatnonzero(inside[:-1] & (edge | cut))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=total[1:])
    words = mix((total[ends] - total[starts]) * _power("down", len(data) + 1)[starts])
    first = np.searchsorted(starts, bounds)
    runs = np.full(max(len(words) - WIDTH + 1, 0), _LENGTH * np.uint64(WIDTH), dtype=np.uint64)
    for k in range(WIDTH):
        runs += words[k:k + len(runs)] * _PLACE[k]
    runs = mix(runs)
    for low, high in zip(first[:-1], first[1:], strict=True):
        if high - low >= WIDTH:
            yield _distinct(runs[low:high - WIDTH + 1])
        elif high > low:
            few = words[low:high]
            yield mix(np.array([(few * _PLACE[:len(few)]).sum(dtype=np.uint64) + _LENGTH * np.uint64(len(few))], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column, in order. Holds about a megabyte of text, or one text, at a time."""
    offsets, data = text_bytes(column)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(column):
            upto = max(int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1, at + 1)
            yield from _hashed(data[offsets[at]:offsets[upto]], offsets[at:upto + 1] - offsets[at])
            at = upto


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit folds of a set; equal sets have equal keys."""
    with np.errstate(over="ignore"):
        keys = [mix(shingles, seed).sum(dtype=np.uint64) for seed in (1, 2)]
    return tuple(int(key.astype(np.int64)) for key in keys)
