"""Compressed bitmaps over integer codes: per 65,536 codes a sorted array, plain bits or runs, whichever is smallest."""

from __future__ import annotations

import numpy as np

_SPAN = 1 << 16
ARRAY, BITS, RUNS = 0, 1, 2


def _pack(low: np.ndarray) -> tuple[int, np.ndarray]:
    """The smallest container for sorted distinct codes below 65,536."""
    starts = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
    sizes = {ARRAY: 2 * len(low), BITS: _SPAN // 8, RUNS: 4 * len(starts)}
    kind = min(sizes, key=lambda k: (sizes[k], k))
    if kind == ARRAY:
        return ARRAY, low.astype(np.uint16)
    if kind == BITS:
        bits = np.zeros(_SPAN, dtype=bool)
        bits[low] = True
        return BITS, np.packbits(bits, bitorder="little")
    ends = np.append(starts[1:], len(low)) - 1
    return RUNS, np.stack([low[starts], low[ends]], axis=1).astype(np.uint16)


def _mask(container: tuple[int, np.ndarray]) -> np.ndarray:
    kind, data = container
    if kind == BITS:
        return np.unpackbits(data, bitorder="little").astype(bool)
    mask = np.zeros(_SPAN + 1, dtype=np.int8)
    if kind == ARRAY:
        mask[data] = 1
        return mask[:_SPAN].astype(bool)
    np.add.at(mask, data[:, 0].astype(np.int64), 1)
    np.add.at(mask, data[:, 1].astype(np.int64) + 1, -1)
    return np.cumsum(mask[:_SPAN]).astype(bool)


def _unpack(container: tuple[int, np.ndarray]) -> np.ndarray:
    return container[1].astype(np.int64) if container[0] == ARRAY else np.flatnonzero(_mask(container))


class Bitmap:
    """A set of non-negative integers."""

    def __init__(self, containers: dict[int, tuple[int, np.ndarray]]):
        self.containers = containers

    @classmethod
    def of(cls, codes: np.ndarray) -> Bitmap:
        codes = np.unique(np.asarray(codes, dtype=np.int64))
        high = codes >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] >> 16): _pack(part & (_SPAN - 1)) for part in np.split(codes, cuts) if len(part)})

    def and_not(self, other: Bitmap) -> Bitmap:
        kept = {}
        for high, mine in self.containers.items():
            theirs = other.containers.get(high)
            if theirs is None:
                kept[high] = mine
                continue
            low = _unpack(mine)
            low = low[~_mask(theirs)[low]]
            if len(low):
                kept[high] = _pack(low)
        return Bitmap(kept)

    def decode(self) -> np.ndarray:
        parts = [(h << 16) + _unpack(c) for h, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)

    def nbytes(self) -> int:
        return sum(data.nbytes for _, data in self.containers.values())
