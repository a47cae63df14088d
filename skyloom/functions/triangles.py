"""Numpy kernels of the region operator: ear clipping and bounding-volume hierarchies.

They run inside Spark tasks on one bounded block of rows each; Spark does the
partitioning (see ``operators/near.py``).
"""

from __future__ import annotations

import numpy as np

LEAF = 8
BLOCK = 1 << 17


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def _clip_same(poly: np.ndarray) -> np.ndarray:
    """Ear clipping of ``m`` simple counter-clockwise polygons of ``n`` vertices at once: (m, n-2, 3, 2)."""
    m, n, _ = poly.shape
    out, rows = [], np.arange(m)
    while n > 3:
        prev, nxt = np.roll(poly, 1, 1), np.roll(poly, -1, 1)
        ear = _cross(prev, poly, nxt)
        ok = ear > 0
        for j in range(n):  # no other vertex may lie in the ear
            p = poly[:, j : j + 1]
            inside = (_cross(prev, poly, p) >= 0) & (_cross(poly, nxt, p) >= 0) & (_cross(nxt, prev, p) >= 0)
            at = (p == prev).all(2) | (p == poly).all(2) | (p == nxt).all(2)
            ok &= ~(inside & ~at)
        # the ear with no vertex inside; where a polygon crosses itself and has none, its widest corner
        k = np.where(ok.any(1), ok.argmax(1), ear.argmax(1))
        out.append(np.stack([prev[rows, k], poly[rows, k], nxt[rows, k]], 1))
        keep = np.ones((m, n), bool)
        keep[rows, k] = False
        poly = poly[keep].reshape(m, n - 1, 2)
        n -= 1
    out.append(poly)
    return np.stack(out, 1)


def _clip_long(poly: np.ndarray) -> np.ndarray:
    """Ear clipping of one polygon with many vertices: one vectorised inside test per candidate ear."""
    alive, out, i, missed = list(range(len(poly))), [], 0, 0
    while len(alive) > 3:
        n = len(alive)
        i %= n
        a, b, c = poly[alive[i - 1]], poly[alive[i]], poly[alive[(i + 1) % n]]
        ear = _cross(a, b, c) > 0
        if ear:
            rest = poly[alive]
            inside = (_cross(a, b, rest) >= 0) & (_cross(b, c, rest) >= 0) & (_cross(c, a, rest) >= 0)
            at = (rest == a).all(1) | (rest == b).all(1) | (rest == c).all(1)
            ear = not (inside & ~at).any()
        if ear or missed > n:
            out.append(np.stack([a, b, c]))
            alive.pop(i)
            missed = 0
        else:
            i += 1
            missed += 1
    out.append(poly[alive])
    return np.stack(out)


def ear_clip(polys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Triangles of polygons given as (n, 2) vertex arrays: (polygon index, (t, 3, 2) corners).

    Repeated and closing vertices are dropped, clockwise polygons turned; one
    with no area, fewer than three vertices or a non-finite vertex has no triangles.
    """
    same: dict[int, list[int]] = {}
    clean: list[np.ndarray] = []
    owner, tris = [np.empty(0, np.int64)], [np.empty((0, 3, 2))]
    for k, p in enumerate(polys):
        p = np.asarray(p, float).reshape(-1, 2)
        if len(p):
            p = p[(p != np.roll(p, 1, 0)).any(1)]
        clean.append(p)
        if len(p) < 3 or not np.isfinite(p).all():
            continue
        area = (p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()
        if area == 0:
            continue
        if area < 0:
            clean[k] = p[::-1]
        if len(p) > 48:
            t = _clip_long(clean[k])
            owner.append(np.full(len(t), k))
            tris.append(t)
        else:
            same.setdefault(len(p), []).append(k)
    for n, ks in same.items():
        step = max(1, 2_000_000 // (n * n))
        for s in range(0, len(ks), step):
            part = ks[s : s + step]
            t = _clip_same(np.stack([clean[k] for k in part]))
            owner.append(np.repeat(part, n - 2))
            tris.append(t.reshape(-1, 3, 2))
    return np.concatenate(owner), np.concatenate(tris)


def ear_clip_quads(quads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``ear_clip`` for (m, 4, 2) counter-clockwise boxes, without a Python loop over polygons."""
    t = _clip_same(quads)
    return np.repeat(np.arange(len(quads)), 2), t.reshape(-1, 3, 2)


def _spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64) & np.uint64(0xFFFF)
    for s, m in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = (v | (v << np.uint64(s))) & np.uint64(m)
    return v


def curve_order(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Order of positions by plane, then along a Z-shaped curve."""

    def scale(v: np.ndarray) -> np.ndarray:
        lo, hi = v.min(), v.max()
        return ((v - lo) / (hi - lo) * 65535 if hi > lo else np.zeros(len(v))).astype(np.int64)

    return np.lexsort(((_spread(scale(x)) << np.uint64(1)) | _spread(scale(y)), z)) if len(x) else np.empty(0, int)


class Bvh:
    """Hierarchy of boxes (plane, x, y) over triangles, as implicit complete binary tree."""

    def __init__(self, z: np.ndarray, tris: np.ndarray):
        lo, hi = tris.min(1), tris.max(1)
        c = (lo + hi) / 2
        order = curve_order(z, c[:, 0], c[:, 1])
        self.tri = order
        n = len(order)
        leaves = 1
        while leaves * LEAF < n:
            leaves *= 2
        box = np.full((leaves * LEAF, 6), np.inf)
        box[:, 3:] = -np.inf
        box[:n] = np.column_stack([z[order], lo[order], z[order], hi[order]])
        self.slots = box
        level = box.reshape(leaves, LEAF, 6)
        level = np.concatenate([level[:, :, :3].min(1), level[:, :, 3:].max(1)], 1)
        self.levels = [level]
        while len(level) > 1:
            pair = level.reshape(-1, 2, 6)
            level = np.concatenate([pair[:, :, :3].min(1), pair[:, :, 3:].max(1)], 1)
            self.levels.append(level)
        self.levels.reverse()

    def candidates(self, z: np.ndarray, x: np.ndarray, y: np.ndarray):
        """Blocks of (point index, triangle index) whose boxes hold the point."""
        n = len(self.tri)
        for s in range(0, len(x) if n else 0, BLOCK):
            p = np.column_stack([z, x, y])[s : s + BLOCK]
            stack = [(np.arange(len(p)), np.zeros(len(p), np.int64), 0)]
            while stack:
                pt, node, depth = stack.pop()
                if len(pt) > 8 * BLOCK:  # crowded: go down in halves, so that a block stays small
                    h = len(pt) // 2
                    stack += [(pt[:h], node[:h], depth), (pt[h:], node[h:], depth)]
                    continue
                b = self.levels[depth][node]
                q = p[pt]
                hit = ((q >= b[:, :3]) & (q <= b[:, 3:])).all(1)
                pt, node = pt[hit], node[hit]
                if not len(pt):
                    continue
                if depth + 1 < len(self.levels):
                    stack.append((np.repeat(pt, 2), (2 * node[:, None] + np.arange(2)).ravel(), depth + 1))
                    continue
                for i in range(0, len(pt), BLOCK):
                    slot = (node[i : i + BLOCK, None] * LEAF + np.arange(LEAF)).ravel()
                    at = np.repeat(pt[i : i + BLOCK], LEAF)
                    b, q = self.slots[slot], p[at]
                    hit = ((q >= b[:, :3]) & (q <= b[:, 3:])).all(1)
                    if hit.any():
                        yield at[hit] + s, self.tri[slot[hit]]


def in_triangle(tris: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact test of points against their triangles (edges count as inside): (inside, on an edge).

    A determinant within its own rounding error counts as zero, so that no point
    on an edge shared by two triangles is lost to both.
    """
    inside, edge = np.ones(len(x), bool), np.zeros(len(x), bool)
    for i in range(3):
        o, a = tris[:, i], tris[:, (i + 1) % 3]
        left, right = (a[:, 0] - o[:, 0]) * (y - o[:, 1]), (a[:, 1] - o[:, 1]) * (x - o[:, 0])
        det, err = left - right, 3.4e-16 * (np.abs(left) + np.abs(right))
        zero = np.abs(det) <= err
        inside &= (det > 0) | zero
        edge |= zero
    return inside, inside & edge
