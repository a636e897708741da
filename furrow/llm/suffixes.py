"""NumPy pieces of the sparse suffix array: anchors, multikey sort, byte ranges."""

from __future__ import annotations

import numpy as np

from furrow.llm.common import mix

GRAM = 32                    # bytes of an anchor
SEGMENT = 1 << 18            # window starts handled at once
_BASE = 0xD6E8FEB86659FD93
_CHECK = 0xA24BAED4963EE407   # base of the second polynomial
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POW, _INV, _CHECK_POW, _CHECK_INV = (
    np.concatenate(([np.uint64(1)], np.cumprod(np.full(SEGMENT + 4096, np.uint64(b)), dtype=np.uint64)))
    for b in (_BASE, pow(_BASE, -1, 1 << 64), _CHECK, pow(_CHECK, -1, 1 << 64)))
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_PLACE_BITS = np.uint64(24)


def segments(offsets: np.ndarray, length: int):
    """(first byte, last byte, document starts, window starts) of pieces with at most
    SEGMENT window starts: whole documents together, or parts of a long one that
    overlap by ``length - 1`` bytes. Document starts are relative to the piece."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > SEGMENT:
            for a in range(int(offsets[i]), int(offsets[i + 1]) - length + 1, SEGMENT):
                b = min(a + SEGMENT + length - 1, int(offsets[i + 1]))
                yield i, a, b, np.array([0, b - a])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
        yield i, int(offsets[i]), int(offsets[j]), offsets[i:j + 1] - offsets[i]
        i = j


def anchored_runs(raw: np.ndarray, starts: np.ndarray, length: int):
    """Runs of windows (``length`` bytes, inside a document) with one anchor: the
    leftmost GRAM of least hash in the window, so equal windows have equal anchors.

    Returns (first window, last window, anchor place, anchor hash, content hash,
    check); content: all bytes of the run's windows, hashed by two polynomials.
    """
    n, span = len(raw), length - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, *(empty.astype(np.uint64),) * 3
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _POW[:n], dtype=np.uint64, out=prefix[1:])
    m = n - GRAM + 1
    gram = mix((prefix[GRAM:] - prefix[:m]) * _INV[:m])
    packed = (gram >> _PLACE_BITS << _PLACE_BITS) | np.arange(m, dtype=np.uint64)
    padded = np.full(-(-m // span) * span + span, _LAST)
    padded[:m] = packed
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    w = n - length + 1
    anchor = (np.minimum(back[:w], ahead[span - 1:span - 1 + w]) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    inside = np.ones(w, dtype=bool)
    for cut in starts[1:-1]:                      # windows that cross into the next document
        inside[max(0, cut - length + 1):cut] = False
    change = np.empty(w, dtype=bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    stop = np.append(np.flatnonzero(change | ~inside), w)
    last = stop[np.searchsorted(stop, first, "right")] - 1
    content = mix((prefix[last + length] - prefix[first]) * _INV[first] + (last - first).astype(np.uint64))
    np.cumsum(_BYTE[raw] * _CHECK_POW[:n], dtype=np.uint64, out=prefix[1:])
    check = mix((prefix[last + length] - prefix[first]) * _CHECK_INV[first])
    place = anchor[first]
    return first, last, place, gram[place], content, check


def lead_word(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a big-endian number (leading tokens)."""
    word = np.zeros(len(at), np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | raw[at + j].astype(np.uint64)
    return word


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key, then only runs that are still tied by the next ones."""
    order = np.argsort(keys[0], kind="stable")
    tied = np.zeros(len(order), dtype=bool)
    if len(order) > 1:
        tied[1:] = keys[0][order[1:]] == keys[0][order[:-1]]       # equal to the one before
    for key in keys[1:]:
        member = tied.copy()
        member[:-1] |= tied[1:]
        at = np.flatnonzero(member)
        if not len(at):
            break
        run = np.cumsum(~tied[at])
        rows = order[at]
        rows = rows[np.lexsort((key[rows], run))]
        order[at] = rows
        tied[at[1:]] &= key[rows[1:]] == key[rows[:-1]]
    return order


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal runs (touching ranges join)."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > stop[:-1]
    at = np.flatnonzero(new)
    return start[at], stop[np.append(at[1:], len(start)) - 1]
