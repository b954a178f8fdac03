"""Word shingles of whole texts as 64-bit hashes, computed on the UTF-8 bytes of a batch at once, of a long text in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kinsift.llm.common import text_slices

_RANDOM = np.random.default_rng(20)
_BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACES = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, word offsets of the texts); A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    blank = _BLANK[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, blank[:-1]
    after[-1], after[:-1] = True, blank[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers(_BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, len(data))[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def _long_text_words(data: np.ndarray, piece: int) -> np.ndarray:
    """The hashes of one long text's words, read in pieces that end at a blank; a word longer than a piece is summed up over pieces."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + piece)
        if end < len(data):
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            if not len(blanks):
                total, length, power, start = np.uint64(0), 0, np.uint64(1), at
                while start < len(data):
                    part = data[start : start + piece]
                    stop = np.flatnonzero(_BLANK[part])
                    part = _LOWER[part[: stop[0]] if len(stop) else part]
                    powers = _powers(_BASE, len(part) + 1)
                    with np.errstate(over="ignore"):
                        total += (_BYTE_VALUES[part] * powers[:-1]).sum(dtype=np.uint64) * power
                        power *= powers[-1]
                    length, start = length + len(part), start + len(part)
                    if len(stop):
                        break
                found.append(mixed(np.array([total], np.uint64) + np.uint64(length)))
                at = start
                continue
            end = at + int(blanks[-1]) + 1
        found.append(word_hashes(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _sets_of(hashes: np.ndarray, at: np.ndarray, words: int) -> Iterator[np.ndarray]:
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled += hashes[j : j + n] * _PLACES[j]
    rolled = mixed(rolled)
    for first, last in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if last - first >= words:
            own = np.sort(rolled[first : last - words + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif last > first:
            few = (hashes[first:last] * _PLACES[: last - first]).sum(dtype=np.uint64)
            yield mixed(np.array([few + np.uint64(last - first)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles; a text of fewer words has its whole sequence as its only one."""
    yield from _sets_of(*word_hashes(data, offsets), words)


def batch_sets(column: pa.Array, words: int = 5, max_bytes: int = 512 << 10) -> Iterator[np.ndarray]:
    """The sets of a column's texts, in order; what is held beside the text is bounded by max_bytes and the text's words."""
    for _, data, offsets in text_slices(column, max_bytes):
        if len(data) > max_bytes:
            hashes = _long_text_words(data, max_bytes)
            yield from _sets_of(hashes, np.array([0, len(hashes)]), words)
        else:
            yield from shingle_sets(data, offsets, words)


_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set, as two unsigned numbers, the same wherever the set is met."""
    a = (int(mixed(shingles).sum(dtype=np.uint64)) + len(shingles) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF
    b = (int(mixed(shingles * _SECOND + _BASE).sum(dtype=np.uint64)) + len(shingles)) & 0xFFFFFFFFFFFFFFFF
    return a, b


def name_bytes(name: tuple[int, int]) -> bytes:
    return name[0].to_bytes(8, "big") + name[1].to_bytes(8, "big")
