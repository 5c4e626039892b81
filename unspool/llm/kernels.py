"""Vectorised text kernels over Arrow buffers (numpy only, no Spark)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step works on; a longer text is worked on alone and whole.
STEP_BYTES = 1 << 18
STEP_ROWS = 4096

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_MIX = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors that tell the places of a shingle's words apart.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffer_of(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its len+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def steps(offs: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text each, one row at least."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = min(max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1), at + STEP_ROWS)
        yield at, to
        at = to


def words(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run without bytes of `breaks` (white space), and the row it is in."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = breaks[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[offs[1:][offs[1:] > 0] - 1] = True
    begin, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return begin, end, np.searchsorted(offs[1:], begin, "right")


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes with A-Z lowered; begin and end as words() gives them."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    at = place + np.repeat(begin, size)
    power = np.full(int(size.max()), _STEP)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    return mix(np.add.reduceat(_BYTE_MIX[_LOWER[data[at]]] * power[place], first))


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row its sorted distinct shingle hashes; fewer words than `width` make one shingle, none makes none."""
    begin, end, row = words(data, offs)
    h = word_hashes(data, begin, end)
    n = len(offs) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    whole = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        whole += h[k : k + len(whole)] * _PLACE[k % len(_PLACE)] if len(whole) else 0
    whole = mix(whole)
    sets = []
    for i in range(n):
        a, c = int(first[i]), int(count[i])
        if c >= width:
            sets.append(np.unique(whole[a : a + c - width + 1]))
        elif c:
            sets.append(mix((h[a : a + c] * _PLACE[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def lower_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals U+00C0 to U+00DE lowered (U+00D7 is no letter); lengths stay."""
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    tail = data[lead]
    lead = lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)]
    out[lead] += 32
    return out


def letter_terms(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray, prefixes: tuple[int, ...], salts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of bytes that are not in `breaks`, once for each prefix length in code points (0: whole)."""
    begin, end, row = words(data, offs, breaks)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = end - begin
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    bytes_ = data[place + np.repeat(begin, size)]
    power = np.full(int(size.max()), _STEP)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    value = _BYTE_MIX[bytes_] * power[place]
    lead = np.cumsum((bytes_ & 0xC0) != 0x80)
    point = lead - np.repeat(lead[first], size)
    out = [mix(np.add.reduceat(value if not k else np.where(point < k, value, np.uint64(0)), first) + salt) for k, salt in zip(prefixes, salts, strict=True)]
    return np.tile(row, len(prefixes)), np.concatenate(out)
