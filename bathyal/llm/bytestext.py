"""Texts of an Arrow batch as flat numpy arrays of bytes: words, hashes and counts without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240)
#: A random odd number for each byte, or for each number of 16 bits.
_VALUES = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


class Slice(NamedTuple):
    """Rows first to last of a batch: their bytes, one after another, and each text's start and end among them."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES, split: bool = False) -> Iterator[Slice]:
    """Nulls count as empty. With `split`, a text over twice `most` comes in pieces that end before white space: slices of it
    whose first row is also their last, then one that ends the row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    held = texts.buffers()[2] if n else None
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        low, high = offsets[first], offsets[last]
        while split and high - low > 2 * most:
            cut = low + most
            while cut < high and not (white := np.flatnonzero(WHITE[data[cut : min(cut + most, high)]])).size:
                cut += most
            if cut >= high:
                break
            cut += white[0]
            yield Slice(first, first, data[low:cut], np.zeros(1, np.int64), np.full(1, cut - low))
            low = cut
        starts = np.maximum(offsets[first:last] - low, 0)
        yield Slice(first, last, data[low:high], starts, offsets[first + 1 : last + 1] - low)
        first = last


def _power(name: str, base: int, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        steps = np.full(max(n, SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        held = _powers[name] = np.cumprod(steps)
    return held


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (or numbers of 16 bits), by differences of one running polynomial sum modulo 2**64."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * _power("up", _BASE, n)[:n], out=sums[1:])
    down = _power("down", _INVERSE, n + 1)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text and after the last."""
    dark = ~WHITE[part.data]
    opens, closes = dark.copy(), dark.copy()
    opens[1:] &= ~dark[:-1]
    closes[:-1] &= ~dark[1:]
    inner = part.starts[(part.starts < len(dark)) & (part.ends > part.starts)]
    opens[inner] = dark[inner]
    closes[inner[1:] - 1] = dark[inner[1:] - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    bounds = np.searchsorted(starts, np.append(part.starts, len(dark)))
    return starts, ends, bounds


def per_text(flags: np.ndarray, part: Slice) -> np.ndarray:
    """The number of bytes of each text that are flagged."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[part.ends] - sums[part.starts]


def group_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
