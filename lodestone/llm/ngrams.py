"""Hashes of words and byte n-grams, computed for a whole batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer document is parted between words, a longer word is summed in pieces.
SEGMENT = 1 << 18
_P = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A byte's class in a word's shape: small letter, capital, digit, other; bytes of non-ASCII letters count as small.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2^64."""
    up, down = (np.full(n + 1, base, dtype=np.uint64) for base in (_P, pow(_P, -1, 2**64)))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down)


_UP, _DOWN = _powers(SEGMENT + 1)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(32)) * _MIX
        x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(32)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each, with the end; null texts are empty."""
    texts = texts.cast(pa.string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _segments(raw: np.ndarray, at: np.ndarray, is_space: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of at most ``SEGMENT`` bytes with the places inside at which a document starts.

    Cuts lie at separators. A word of more bytes than that is a range by itself.
    """
    cuts: list[int] = []
    for i in np.flatnonzero(np.diff(at) > SEGMENT).tolist():
        a, stop = int(at[i]), int(at[i + 1])
        while stop - a > SEGMENT:
            spaces = np.flatnonzero(is_space[raw[a + 1 : a + SEGMENT]])
            if len(spaces):
                a += int(spaces[-1]) + 1
            elif is_space[raw[a]]:
                a += 1
            else:
                a += SEGMENT
                while a < stop and not len(spaces):
                    spaces = np.flatnonzero(is_space[raw[a : min(a + SEGMENT, stop)]])
                    a = a + int(spaces[0]) if len(spaces) else min(a + SEGMENT, stop)
            cuts.append(a)
    edges = np.unique(np.concatenate([at, np.array(cuts, dtype=np.int64)]))
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + SEGMENT, side="right")) - 1)
        yield int(edges[a]), int(edges[b]), edges[a:b] - edges[a]
        a = b


def _long_word(word: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Hash and shape hash of one word of any length; the sums are carried over from piece to piece."""
    total = shape = np.zeros(1, dtype=np.uint64)
    up = shape_up = _UP[:1]
    last = None
    with np.errstate(over="ignore"):
        for i in range(0, len(word), SEGMENT):
            part = word[i : i + SEGMENT]
            total = total + up * ((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)]).sum()
            up = up * _UP[SEGMENT]
            kind = _SHAPE[part]
            kept = kind[np.concatenate([[last is None or kind[0] != last], kind[1:] != kind[:-1]])]
            shape = shape + shape_up * ((kept.astype(np.uint64) + np.uint64(1)) * _UP[: len(kept)]).sum()
            shape_up = shape_up * _UP[len(kept)]
            last = kind[-1]
    return mix(total)[0], mix(shape)[0]


def word_hashes(raw: np.ndarray, at: np.ndarray, is_space: np.ndarray = _SPACE, shapes: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, start, end[, shape hash]) of every word of all texts; start and end are byte offsets.

    A word's hash depends on its bytes alone. Its shape is the run-free sequence of its bytes' classes.
    """
    hashes, starts, ends, shaped = [], [], [], []
    for a, b, firsts in _segments(raw, at, is_space):
        part = raw[a:b]
        if len(part) > SEGMENT:
            one, shape = _long_word(part)
            hashes.append(np.array([one], dtype=np.uint64))
            shaped.append(np.array([shape], dtype=np.uint64))
            starts.append(np.array([a]))
            ends.append(np.array([b]))
            continue
        word = ~is_space[part]
        before = np.concatenate([[False], word[:-1]])
        before[firsts] = False
        start = np.flatnonzero(word & ~before)
        after = np.concatenate([word[1:], [False]])
        after[firsts[1:] - 1] = False
        end = np.flatnonzero(word & ~after) + 1
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)])])
            hashes.append(mix((total[end] - total[start]) * _DOWN[start]))
            if shapes:
                kind = _SHAPE[part]
                keep = np.concatenate([[True], kind[1:] != kind[:-1]])
                keep[start] = True
                rank = np.cumsum(keep) - 1
                total = np.concatenate([[np.uint64(0)], np.cumsum(np.where(keep, (kind.astype(np.uint64) + np.uint64(1)) * _UP[rank], np.uint64(0)))])
                shaped.append(mix((total[end] - total[start]) * _DOWN[rank[start]]))
        starts.append(start + a)
        ends.append(end + a)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
    out = join(hashes, np.uint64), join(starts, np.int64), join(ends, np.int64)
    return (*out, join(shaped, np.uint64)) if shapes else out


def owners(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each start lies in."""
    return np.searchsorted(at, starts, side="right") - 1
