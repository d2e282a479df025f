"""Words of many texts at once, as arrays over the UTF-8 bytes of an Arrow column.

All separators used here are single ASCII bytes, which never occur inside a longer UTF-8 character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once, so that the arrays beside them stay in cache and memory.
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold_table() -> np.ndarray:
    """Byte to byte, A-Z to lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def blank_table() -> np.ndarray:
    """Which bytes are blank."""
    table = np.zeros(256, dtype=bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def letters_table() -> np.ndarray:
    """Which bytes are no letters; bytes of characters beyond ASCII count as letters."""
    table = np.ones(256, dtype=bool)
    table[65:91] = table[97:123] = table[128:] = False
    return table


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each, with the end; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray, size: int = BLOCK):
    """Ranges of about ``size`` bytes that end before a separator or at the start of a text, so no word lies in two."""
    at, total = 0, len(data)
    starts = offsets[1:-1]
    while at < total:
        end = min(at + size, total)
        if end < total:
            k = np.searchsorted(starts, end, "right") - 1
            near = int(starts[k]) if k >= 0 and starts[k] > at else 0
            gaps = np.flatnonzero(apart[data[max(at + 1, near, end - 4096) : end]])
            if len(gaps):
                end = max(at + 1, near, end - 4096) + int(gaps[-1])
            elif near > at:
                end = near
            else:  # a very long word
                while end < total and not apart[data[end]]:
                    end += 1
                later = starts[np.searchsorted(starts, at, "right") :]
                if len(later) and later[0] < end:
                    end = int(later[0])
        yield at, end
        at = end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        out.append(np.multiply.accumulate(factors))
    return tuple(out)


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray, fold: np.ndarray | None = None, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Start, end and 64-bit hash of every word; ``apart``: bytes between words, ``fold``: byte to byte.

    stems: for each of these numbers of bytes, a further array with the hash of the word's first bytes, 0 if it is not longer.
    """
    powers = inverses = None
    out: list[tuple[np.ndarray, ...]] = []
    for low, high in blocks(data, offsets, apart):
        part = data[low:high]
        n = len(part)
        inside = ~apart[part]
        new = np.zeros(n + 1, dtype=bool)
        new[0] = new[n] = True
        own = offsets[np.searchsorted(offsets, low, "left") : np.searchsorted(offsets, high, "right")] - low
        new[own[own <= n]] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | new[:n]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | new[1:])) + 1
        if not len(start):
            continue
        if powers is None or len(powers) < n + 1:
            powers, inverses = _powers(max(n, BLOCK) + 1)
        values = ((fold[part] if fold is not None else part).astype(np.uint64) + np.uint64(1)) * powers[:n]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        hashes = (sums[end] - sums[start]) * inverses[start]
        begun = []
        for k in stems:
            own = np.zeros(len(start), np.uint64)
            longer = np.flatnonzero(end - start > k)
            at = start[longer]
            own[longer] = mix((sums[at + k] - sums[at]) * inverses[at] ^ np.uint64(k << 48))
            begun.append(own)
        out.append((start + low, end + low, mix(hashes ^ ((end - start).astype(np.uint64) << np.uint64(40))), *begun))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * (1 + len(stems))
    return tuple(np.concatenate(x) for x in zip(*out))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans in order of their starts, which do not overlap."""
    out = np.empty(len(starts), np.uint64)
    powers = inverses = None
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        if powers is None or len(powers) < high - low + 1:
            powers, inverses = _powers(max(high - low, BLOCK) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * inverses[a] ^ (b - a).astype(np.uint64) << np.uint64(40))
        i = j
    return out


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and where each text's begin; a text with fewer words has one, of all; without words none.

    ``bounds``: where each text's words begin, with the end.
    """
    n = np.diff(bounds)
    combined = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        combined += hashes[k : k + len(combined)] * np.uint64((2 * k + 3) * 0xD1B54A32D192ED03 & (1 << 64) - 1 | 1)
    combined = mix(combined)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(starts[-1], np.uint64)
    full = np.flatnonzero(n >= size)
    if len(full):
        take = np.repeat(bounds[full] - starts[full], counts[full]) + np.concatenate([np.arange(a, b) for a, b in zip(starts[full], starts[full + 1])])
        place = take - np.repeat(bounds[full] - starts[full], counts[full])
        out[place] = combined[take]
    for i in np.flatnonzero((n > 0) & (n < size)):
        own = hashes[bounds[i] : bounds[i + 1]]
        value = np.full(1, len(own), np.uint64)
        for h in own:
            value = mix(value * np.uint64(_BASE) + h)
        out[starts[i]] = value[0]
    return out, starts
