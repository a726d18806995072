"""Word hashes of whole texts, computed on bytes: words are runs without ASCII white space, A-Z lower-cased."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from codequarry.llm.packets import mix

GROUP_BYTES = 1 << 19
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_VALUE[65:91] = _VALUE[97:123]
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, GROUP_BYTES + (1 << 16))
        made = []
        for base in (_BASE, _INVERSE):
            out, known = np.ones(1, dtype=np.uint64), 1
            while known < size:
                out = np.concatenate([out, out * np.uint64(pow(base, known, 1 << 64))])
                known *= 2
            made.append(out[:size])
        if size > 4 * GROUP_BYTES:
            return made[0][:n], made[1][:n]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def hashed(data: bytes, gaps: np.ndarray = _SPACE, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where it starts); ``gaps`` says which bytes part words, white space always among them. With
    ``first``, only so many bytes of a word count."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = gaps[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.insert(edge, 0, 0)
    if not space[-1]:
        edge = np.append(edge, len(b))
    starts, ends = edge[::2], edge[1::2]
    ends = ends if first is None else np.minimum(ends, starts + first)
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[b] * down[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * up[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts


def segments(data: bytes) -> Iterator[bytes]:
    """A long text in parts that end before white space; words stay whole."""
    at = 0
    while len(data) - at > GROUP_BYTES:
        found = _GAP.search(data, at + GROUP_BYTES)
        if not found:
            break
        yield data[at : found.start()]
        at = found.start()
    yield data[at:]


def grouped(texts: list[str], gaps: np.ndarray = _SPACE) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(numbers of the texts, hashes of their words in order, words in each) for groups of a few megabytes."""
    at, n = 0, len(texts)
    while at < n:
        group, size, end = [], 0, at
        while end < n and (not group or size < GROUP_BYTES):
            group.append(texts[end].encode())
            size += len(group[-1]) + 1
            end += 1
        last = group.pop() if len(group[-1]) > GROUP_BYTES else None
        found, counts = [], np.zeros(end - at, dtype=np.int64)
        if group:
            sizes = np.array([len(g) + 1 for g in group], dtype=np.int64)
            hashes, starts = hashed(b" ".join(group), gaps)
            found.append(hashes)
            counts[: len(group)] = np.bincount(np.searchsorted(np.cumsum(sizes), starts, side="right"), minlength=len(group))
        if last is not None:
            for part in segments(last):
                found.append(hashed(part, gaps)[0])
                counts[-1] += len(found[-1])
        yield range(at, end), np.concatenate(found), counts
        at = end
