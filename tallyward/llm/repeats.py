"""Anchors for repeated strings of a text.

Every string of LENGTH bytes picks one of its GRAM-byte grams, the leftmost of
those with the least hash. The place of that gram is the string's anchor, and as
the pick depends on the string alone, equal strings have anchors with equal
grams at equal offsets. So repeats can be looked for among anchors, of which
there is one in some 75 bytes.
"""

from __future__ import annotations

import numpy as np

from tallyward.llm.minhash import _mix, _numbers

LENGTH, GRAM = 200, 50
WINDOW = LENGTH - GRAM + 1
_U = np.uint64
_PIECE = 1 << 20
_PLACE_BITS = 21
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, for every place of a piece."""
    if not _POWERS:
        n = _PIECE + 2 * LENGTH
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            powers = np.full(n, _U(base))
            powers[0] = 1
            _POWERS.append(np.multiply.accumulate(powers))
    return _POWERS[0], _POWERS[1]


def anchors(data: bytes) -> dict[str, np.ndarray]:
    """place, gram (hash), first and last (start of a string that has this anchor), context (hash of the bytes that those strings cover)."""
    powers, inverse = _powers()
    parts = []
    for begin in range(0, max(0, len(data) - LENGTH + 1), _PIECE):
        raw = np.frombuffer(data, np.uint8, min(len(data) - begin, _PIECE + LENGTH - 1), begin)
        n = len(raw)
        sums = np.zeros(n + 1, _U)
        np.cumsum((raw.astype(_U) + _U(1)) * powers[:n], out=sums[1:])
        hashes = _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
        keys = (hashes >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | np.arange(len(hashes), dtype=_U)
        # Least key of each window: the least up to the end of a block and from its start meet in the window.
        blocks = -(-len(keys) // WINDOW)
        table = np.full(blocks * WINDOW, _U(0xFFFFFFFFFFFFFFFF))
        table[: len(keys)] = keys
        table = table.reshape(blocks, WINDOW)
        right = np.minimum.accumulate(table, axis=1).reshape(-1)
        left = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        strings = n - LENGTH + 1
        picked = (np.minimum(left[:strings], right[WINDOW - 1 : WINDOW - 1 + strings]) & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
        last = np.append(first[1:], strings) - 1
        place = picked[first]
        stop = last + LENGTH
        shape = (place - first).astype(_U) * _U(1 << 20) + (last - first).astype(_U)
        context = _mix((sums[stop] - sums[first]) * inverse[first] + _mix(shape + _U(1)))
        parts.append((place + begin, hashes[place], first + begin, last + begin, context))
    names = ("place", "gram", "first", "last", "context")
    if not parts:
        return {k: np.zeros(0, _U if k in ("gram", "context") else np.int64) for k in names}
    return {k: np.concatenate(v) for k, v in zip(names, zip(*parts))}
