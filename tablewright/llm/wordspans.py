"""Words of Arrow text columns as numpy arrays: byte classes, word bounds and 64-bit word hashes.

All steps work on the bytes of many texts at once, so no Python code runs per word. Texts are cut into groups of about
``SLICE_BYTES``, which bounds the temporary arrays; a longer text forms its own group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def byte_set(values) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of groups of whole texts; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_break: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of every maximal run of bytes outside ``is_break``; runs end with their text."""
    if len(data) == 0:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    body = ~is_break[data]
    before = np.empty_like(body)
    before[0] = False
    before[1:] = body[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = False
    after = np.empty_like(body)
    after[-1] = False
    after[:-1] = body[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    starts = np.flatnonzero(body & ~before)
    ends = np.flatnonzero(body & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class SpanHasher:
    """64-bit hashes of byte spans from one running sum: sum of value(byte) * P^place, divided by P^start."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 1):
        self.values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) >= n:
            return
        n = max(n, SLICE_BYTES + 1)
        for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 2**64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        total = np.empty(len(data) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(self.values[data] * self.power[: len(data)], out=total[1:])
        sums = (total[ends] - total[starts]) * self.inverse[starts]
        return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


WORD_BREAKS = byte_set([b for b in range(128) if not chr(b).isalnum()])  # what is left: digits, letters and bytes of other signs
SEGMENT_BYTES = 1 << 18


def raw_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.empty(0, np.uint8), offsets


def _cut_places(data: np.ndarray, start: int, end: int, is_break: np.ndarray, limit: int) -> list[int]:
    """Places of break bytes that cut data[start:end] into parts of at most ``limit`` bytes; a longer word stays whole."""
    out = []
    while end - start > limit:
        found = np.flatnonzero(is_break[data[start + 1 : start + limit + 1]])
        at = start + 1 + int(found[-1]) if len(found) else -1
        ahead = start + limit
        while at < 0 and ahead < end:
            found = np.flatnonzero(is_break[data[ahead : min(ahead + limit, end)]])
            at = ahead + int(found[0]) if len(found) else -1
            ahead += limit
        if at < 0:
            break
        out.append(at)
        start = at
    return out


def segments(column: pa.Array, is_break: np.ndarray, limit: int = SEGMENT_BYTES, cut=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of groups of at most about ``limit`` bytes. A longer text is cut at break bytes into several
    segments, each with the row of its text, so that temporary arrays don't grow with a text. ``cut`` may name the places otherwise."""
    data, offsets = raw_column(column)
    n = len(offsets) - 1
    long = np.flatnonzero(np.diff(offsets) > limit)
    places = {int(i): (cut or _cut_places)(data, int(offsets[i]), int(offsets[i + 1]), is_break, limit) for i in long}
    counts = np.ones(n, dtype=np.int64)
    for i, found in places.items():
        counts[i] += len(found)
    inner = np.array([x for found in places.values() for x in found], dtype=np.int64)
    rows = np.repeat(np.arange(n), counts)
    starts = np.sort(np.concatenate([offsets[:-1], inner]), kind="stable")
    ends = np.append(starts[1:], offsets[-1:])
    at = 0
    while at < len(rows):
        to = max(int(np.searchsorted(ends, starts[at] + limit, side="right")), at + 1)
        yield rows[at:to], data[starts[at] : ends[to - 1]], np.append(starts[at:to], ends[to - 1]) - starts[at]
        at = to


class LowerWords:
    """Words of letters, digits and non-ASCII signs of many texts, A-Z in lower case, with 64-bit hashes."""

    def __init__(self, seed: int):
        self.hasher, self.lower = SpanHasher(seed), lower_ascii()

    def slices(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, bytes, starts, ends, hashes) of the words of each slice."""
        for rows, data, offsets in segments(column, WORD_BREAKS):
            data = self.lower[data]
            starts, ends, at = word_bounds(data, offsets, WORD_BREAKS)
            yield rows[at], data, starts, ends, self.hasher(data, starts, ends)


class Lookup:
    """Numbers by 64-bit key, for many keys at once: open addressing in numpy arrays, at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, used: np.ndarray):
        self.keys, self.values, self.used = keys, values, used
        self.mask = np.uint64(len(keys) - 1)

    @classmethod
    def of(cls, keys, values) -> Lookup:
        keys, values = np.asarray(keys, dtype=np.uint64), np.asarray(values, dtype=np.int64)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        slots = np.full(size, -1, dtype=np.int64)
        left, place = np.arange(len(keys)), (keys & np.uint64(size - 1)).astype(np.int64)
        while len(left):
            free = left[slots[place[left]] < 0]
            taken, first = np.unique(place[free], return_index=True)
            slots[taken] = free[first]
            left = left[slots[place[left]] != left]
            place[left] = (place[left] + 1) % size
        used = slots >= 0
        pick = np.where(used, slots, 0)
        none = np.zeros(size, dtype=np.int64)
        return cls(keys[pick] if len(keys) else none.view(np.uint64), values[pick] if len(keys) else none, used)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for keys that are not in the table."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo, place = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(todo):
            at = place[todo]
            hit = self.used[at] & (self.keys[at] == keys[todo])
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[self.used[at] & ~hit]
            place[todo] = (place[todo] + 1) & int(self.mask)
        return out
