"""Rolling hashes and sliding minima over whole batches of text, in numpy's 64-bit arithmetic."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the polynomial hashes and of the final mix; any odd numbers would do.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
TOP = np.uint64(2**64 - 1)
#: Code points that one numpy pass works on; a longer text is one pass of its own.
PASS_CHARS = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of ``x`` spread over all 64 bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(12, int(n - 1).bit_length())
    return _powers(size, int(base))[:n]


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """For every start i the hash of units[i:i+k]; len(units)-k+1 of them, equal for equal runs."""
    n = len(units)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(units) * powers(n, BASE_INVERSE), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * powers(n - k + 1))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over values[i:i+width] for every i, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    return _sliding(values, width, np.minimum)


def sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    return _sliding(values, width, np.maximum)


def passes(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most about PASS_CHARS bytes of text, at least one row each."""
    column = batch.column(text)
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > PASS_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)
