"""Compressed presence bitmaps over ordinals: sparse, dense or run containers of 65,536 ordinals each."""

from __future__ import annotations

import numpy as np

SPAN = 1 << 16
SPARSE = 4096  # up to here a sorted list of 2-byte members is smaller than 8 KB of bits
_FULL = np.arange(SPAN, dtype=np.uint16)


class _Box:
    """One container: members as a sorted list, as packed bits, or as (start, end) runs, whichever is smallest."""

    def __init__(self, members: np.ndarray):
        self.n = len(members)
        m = members.astype(np.int64)
        brk = np.flatnonzero(np.diff(m) != 1)
        runs = len(brk) + 1
        if runs * 2 < min(self.n, SPARSE):
            self.kind, self.data = "runs", np.column_stack([m[np.r_[0, brk + 1]], m[np.r_[brk, self.n - 1]]]).astype(np.uint16)
        elif self.n <= SPARSE:
            self.kind, self.data = "list", m.astype(np.uint16)
        else:
            bits = np.zeros(SPAN, bool)
            bits[m] = True
            self.kind, self.data = "bits", np.packbits(bits)

    def bits(self) -> np.ndarray:
        if self.kind == "bits":
            return self.data
        flags = np.zeros(SPAN, bool)
        if self.kind == "list":
            flags[self.data] = True
        else:
            for a, b in self.data.astype(np.int64):
                flags[a : b + 1] = True
        return np.packbits(flags)

    def members(self) -> np.ndarray:
        return self.data if self.kind == "list" else _FULL[np.unpackbits(self.bits()).astype(bool)]


class Presence:
    """Set of non-negative ordinals with AND and AND-NOT container by container."""

    def __init__(self, ordinals: np.ndarray | None = None):
        self.boxes: dict[int, _Box] = {}
        if ordinals is not None and len(ordinals):
            o = np.unique(np.asarray(ordinals, np.int64))
            high = o >> 16
            for part in np.split(o, np.flatnonzero(np.diff(high)) + 1):
                self.boxes[int(part[0] >> 16)] = _Box(part & (SPAN - 1))

    def _with(self, high: int, members: np.ndarray) -> None:
        if len(members):
            self.boxes[high] = _Box(members)

    def and_not(self, other: Presence) -> Presence:
        out = Presence()
        for high, a in self.boxes.items():
            b = other.boxes.get(high)
            if b is None:
                out.boxes[high] = a
            elif a.kind == "list" and b.kind == "list":
                out._with(high, np.setdiff1d(a.data, b.data, assume_unique=True))
            else:
                out._with(high, _FULL[np.unpackbits(a.bits() & ~b.bits()).astype(bool)])
        return out

    def and_(self, other: Presence) -> Presence:
        out = Presence()
        for high in self.boxes.keys() & other.boxes.keys():
            a, b = self.boxes[high], other.boxes[high]
            if a.kind == "list" and b.kind == "list":
                out._with(high, np.intersect1d(a.data, b.data, assume_unique=True))
            else:
                out._with(high, _FULL[np.unpackbits(a.bits() & b.bits()).astype(bool)])
        return out

    def ordinals(self) -> np.ndarray:
        parts = [(high << 16) + self.boxes[high].members().astype(np.int64) for high in sorted(self.boxes)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def nbytes(self) -> int:
        return sum(b.data.nbytes for b in self.boxes.values())
