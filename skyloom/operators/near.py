"""Points near other points, and points inside regions.

Regions are polygons cut into triangles by ear clipping; the triangles are
distributed through a bounding-volume hierarchy and points tested exactly
against the triangles of the boxes they fall into:

* The upper hierarchy halves (plane, x, y) boxes until a box holds about
  ``LEAF_ROWS`` rows. Its cuts come from a bounded sample (``SAMPLE_ROWS``);
  every row is indexed. Its leaves are disjoint and cover everything, so a
  point goes to one leaf and a triangle to each leaf its box touches.
* A leaf is one Spark group, and there are as many tasks as leaves. In it a second hierarchy over its triangles yields
  candidate triangles, which are tested exactly.

One crowded plane or spot is cut further like any other, so that no leaf grows
with the table. Nearness is the same search: a point's region is the box about
its disc, and an exact distance check follows. On the sphere a point lies on one
of six gnomonic cube faces, on which great circles are straight lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import triangles as tri
from skyloom.functions.isolation import mixed

LEAF_ROWS = 40_000
SAMPLE_ROWS = 1 << 21  # rows of (long, double, double) the driver may hold to place the cuts
PER_LEAF = 8
ROUTED = "leaf int, is_point boolean, whole boolean, id bigint, z bigint, x double, y double"


class Cuts:
    """Upper hierarchy: at node k a cut of plane (0), x (1) or y (2), or leaf number ``leaf[k]``.

    Rows at one spot cannot be cut apart. Their leaf is split instead: into ``split[leaf]`` shares of
    its points, or of points and of regions.
    """

    def __init__(self, z: np.ndarray, x: np.ndarray, y: np.ndarray, leaves: int):
        self.dim, self.zcut, self.cut, self.child, self.leaf = [], [], [], [], []
        self.leaves, split = 0, []
        per = max(1.0, len(z) / leaves)
        todo = [(np.arange(len(z)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            k = len(self.dim)
            if parent is not None:
                self.child[parent][side] = k
            zs, xs, ys = z[rows], x[rows], y[rows]
            dim = -1
            if len(rows) > 1.5 * per:
                if len(zs) and zs.min() < zs.max():
                    dim = 0
                elif np.ptp(xs) > 0 or np.ptp(ys) > 0:
                    dim = 1 if np.ptp(xs) >= np.ptp(ys) else 2
            zc, c = 0, 0.0
            if dim >= 0:
                v = (zs, xs, ys)[dim]
                c = np.partition(v, len(v) // 2)[len(v) // 2]
                if c == v.min():
                    c = v[v > c].min()
                below = v < c
                todo += [(rows[~below], k, 1), (rows[below], k, 0)]
                zc, c = (int(c), 0.0) if dim == 0 else (0, float(c))
            self.dim.append(dim)
            self.zcut.append(zc)
            self.cut.append(c)
            self.child.append([0, 0])
            self.leaf.append(self.leaves if dim < 0 else -1)
            self.leaves += dim < 0
            if dim < 0:
                split.append(int(np.ceil(len(rows) / per)) if len(rows) > 1.5 * per else 1)
        self.dim, self.zcut, self.cut, self.child, self.leaf = map(np.array, (self.dim, self.zcut, self.cut, self.child, self.leaf))
        self.split = np.array(split)

    def groups(self, square: bool) -> int:
        return int((self.split**2 if square else self.split).sum())

    def shares(self, leaf: np.ndarray, ids: np.ndarray, points: bool, square: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) of rows of leaves: a point and a region of one leaf meet in exactly one group.

        ``square`` cuts both sides of a split leaf by their ids; else regions go to all shares of the points.
        """
        size = self.split**2 if square else self.split
        base = np.cumsum(size) - size
        s = self.split[leaf]
        if (s == 1).all():
            return np.arange(len(leaf)), base[leaf]
        own = (mixed(ids) % s.astype(np.uint64)).astype(np.int64)
        if points and not square:
            return np.arange(len(leaf)), base[leaf] + own
        row = np.repeat(np.arange(len(leaf)), s)
        other = np.arange(len(row)) - np.repeat(np.cumsum(s) - s, s)
        if not square:
            return row, base[leaf][row] + other
        return row, base[leaf][row] + (own[row] * s[row] + other if points else other * s[row] + own[row])

    def of_boxes(self, z, x0, y0, x1, y1) -> tuple[np.ndarray, np.ndarray]:
        """(box index, leaf) of every leaf that a box touches; a point is a box without extent."""
        rows, node = np.arange(len(z)), np.zeros(len(z), np.int64)
        done_r, done_l = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(rows):
            d = self.dim[node]
            end = d < 0
            done_r.append(rows[end])
            done_l.append(self.leaf[node[end]])
            rows, node, d = rows[~end], node[~end], d[~end]
            c, zc = self.cut[node], self.zcut[node]
            low = np.where(d == 0, z[rows] < zc, np.where(d == 1, x0[rows], y0[rows]) < c)
            high = np.where(d == 0, z[rows] >= zc, np.where(d == 1, x1[rows], y1[rows]) >= c)
            rows, node = np.concatenate([rows[low], rows[high]]), np.concatenate([self.child[node[low], 0], self.child[node[high], 1]])
        return np.concatenate(done_r), np.concatenate(done_l)


def place_cuts(at: DataFrame, leaf_rows: int = LEAF_ROWS) -> Cuts:
    """The upper hierarchy for positions ``(z, x, y)``, from at most ``SAMPLE_ROWS`` sampled rows."""
    n = at.count()
    leaves = max(1, min(math.ceil(n / leaf_rows), SAMPLE_ROWS // PER_LEAF))
    want = min(n, max(4096, leaves * PER_LEAF * 8), SAMPLE_ROWS)
    sample = at.sample(min(1.0, want / n), seed=11).limit(SAMPLE_ROWS).toArrow() if leaves > 1 else None
    if sample is None:
        return Cuts(np.empty(0, np.int64), np.empty(0), np.empty(0), 1)
    return Cuts(*(sample.column(c).to_numpy() for c in "zxy"), leaves)


def _routed(leaf, is_point, whole, ids, z, x, y) -> pa.RecordBatch:
    n = len(leaf)
    fill = lambda v, t: pa.array(np.broadcast_to(np.asarray(v, t), n))
    return pa.RecordBatch.from_arrays(
        [pa.array(leaf.astype(np.int32)), fill(is_point, bool), fill(whole, bool), pa.array(ids), pa.array(z), pa.array(x), pa.array(y)],
        ["leaf", "is_point", "whole", "id", "z", "x", "y"],
    )


# -- the sphere as six planes ---------------------------------------------------------------------

_AXES = np.array([[0, 1, 2], [1, 2, 0], [2, 0, 1]])  # main axis of a face, then its u and v


def unit(lon_deg: np.ndarray, lat_deg: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(np.mod(lon_deg, 360.0)), np.radians(lat_deg)
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def face_of(p: np.ndarray) -> np.ndarray:
    axis = np.abs(p).argmax(1)
    return 2 * axis + (p[np.arange(len(p)), axis] < 0)


def on_face(p: np.ndarray, face: np.ndarray) -> np.ndarray:
    """Gnomonic (u, v) of directions on the given faces; NaN behind the face's horizon."""
    ax = _AXES[face // 2]
    r = np.arange(len(p))
    w = np.where(face % 2, -p[r, ax[:, 0]], p[r, ax[:, 0]])
    w = np.where(w > 0.05, w, np.nan)
    return np.column_stack([p[r, ax[:, 1]] / w, p[r, ax[:, 2]] / w])


def from_face(face: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    out, r, ax = np.empty((len(u), 3)), np.arange(len(u)), _AXES[face // 2]
    out[r, ax[:, 0]] = np.where(face % 2, -1.0, 1.0)
    out[r, ax[:, 1]], out[r, ax[:, 2]] = u, v
    return out / np.sqrt((out * out).sum(1))[:, None]


def sky_plane(points: DataFrame, id: str, lon: str, lat: str) -> DataFrame:
    """Rows with a place on the sphere as ``(id, z face, x, y)``, in degrees; a longitude counts modulo 360."""
    ok = F.abs(F.col(lat)) <= 90.0
    ok &= F.abs(F.col(lon)) < float("inf")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = unit(b.column("lon").to_numpy(), b.column("lat").to_numpy())
            face = face_of(p)
            uv = on_face(p, face)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(face), pa.array(uv[:, 0]), pa.array(uv[:, 1])], ["id", "z", "x", "y"])

    kept = points.filter(ok & F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))
    return kept.mapInArrow(project, "id bigint, z bigint, x double, y double")


def flat_plane(points: DataFrame, id: str, plane: Column, x: str, y: str) -> DataFrame:
    """Rows with a place on a plane as ``(id, z, x, y)``; ``z`` is a 64-bit hash of the plane's name."""
    finite = (F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf"))
    return points.filter(finite & plane.isNotNull() & F.col(id).isNotNull()).select(
        F.col(id).cast("bigint").alias("id"), F.xxhash64(plane).alias("z"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )


# -- points near points -----------------------------------------------------------------------------


def near_pairs(at: DataFrame, radius: float, sphere: bool = False, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """All pairs ``(id_a, id_b)``, id_a < id_b, of rows of ``at`` (id, z, x, y) at most ``radius`` apart.

    ``radius`` is in the plane's unit, or in radians on the sphere; it is inclusive
    to within 1e-9 of itself (rounding of decimal positions). Rows that repeat an
    id at one position count once; an id at several positions has several places,
    a pair for each of them, and none with itself. An empty table gives no pairs. All
    rows at one spot are all neighbours: the result, not the work per block, is
    then quadratic.
    """
    cuts = place_cuts(at.select("z", "x", "y"), leaf_rows)
    grow = 1 + 2e-9
    reach = radius * grow

    def half(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Half the side of the box about a point's disc."""
        if not sphere:
            return np.full(len(x), reach) + 4e-16 * np.maximum(np.abs(x), np.abs(y))
        t = np.arctan(np.hypot(x, y))
        return (np.tan(t + reach) - np.tan(t)) * (1 + 1e-9) + 4e-16

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, z, x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "z", "x", "y"))
            h = half(x, y)
            r, leaf = cuts.of_boxes(z, x, y, x, y)
            home = np.empty(len(z), np.int64)
            home[r] = leaf
            r, group = cuts.shares(home, ids, True, True)
            # a point of a split leaf is no region there: its region is a row of its own
            yield _routed(group, True, cuts.split[home[r]] > 1, ids[r], z[r], x[r], y[r])
            # a pair is found from the point with the smaller x, so its region is the right half of the box
            r, leaf = cuts.of_boxes(z, x, y - h, x + h, y + h)
            away = (leaf != home[r]) | (cuts.split[leaf] > 1)
            r, leaf = r[away], leaf[away]
            k, group = cuts.shares(leaf, ids[r], False, True)
            r = r[k]
            yield _routed(group, False, False, ids[r], z[r], x[r], y[r])
            if not sphere:
                continue
            close = np.flatnonzero(np.maximum(np.abs(x), np.abs(y)) + 2 * h >= 1)
            p = from_face(z[close], x[close], y[close])
            for f in range(1, 6):  # a pair over an edge of the cube is found from its lower face
                k = z[close] < f
                uv = on_face(p[k], np.full(k.sum(), f))
                g = half(uv[:, 0], uv[:, 1])
                hit = np.abs(uv).max(1) - g <= 1  # False where the point is behind the face
                uv, g, own = uv[hit], g[hit], ids[close][k][hit]
                face = np.full(len(own), f)
                r, leaf = cuts.of_boxes(face, uv[:, 0] - g, uv[:, 1] - g, uv[:, 0] + g, uv[:, 1] + g)
                k, group = cuts.shares(leaf, own[r], False, True)
                r = r[k]
                yield _routed(group, False, True, own[r], face[r], uv[r, 0], uv[r, 1])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        get = {c: t.column(c).to_numpy() for c in t.column_names}
        rows = np.lexsort((get["y"], get["x"], get["z"], get["id"], get["is_point"]))
        same = np.ones(len(rows), bool)
        for c in ("is_point", "whole", "id", "z", "x", "y"):
            v = get[c][rows]
            same[1:] &= v[1:] == v[:-1]
        same[0] = False
        rows = rows[~same]  # repeated rows
        ids, z, x, y, whole = (get[c][rows] for c in ("id", "z", "x", "y", "whole"))
        plane = np.unique(z, return_inverse=True)[1].astype(float)
        h = half(x, y)
        point = get["is_point"][rows]
        region = np.flatnonzero(~(point & whole))
        rx, ry, rh = x[region], y[region], h[region]
        left = np.where(whole[region], rx - rh, rx)
        box = np.stack([np.column_stack(c) for c in ((left, ry - rh), (rx + rh, ry - rh), (rx + rh, ry + rh), (left, ry + rh))], 1)
        owner, tris = tri.ear_clip_quads(box)
        owner = region[owner]
        if not len(tris):
            return
        bvh = tri.Bvh(plane[owner], tris)
        pts = np.flatnonzero(point)
        pts = pts[tri.curve_order(plane[pts], x[pts], y[pts])]
        for pt, tr in bvh.candidates(plane[pts], x[pts], y[pts]):
            b, a = pts[pt], owner[tr]
            k = (ids[a] != ids[b]) & (whole[a] | (x[a] < x[b]) | (ids[a] < ids[b]))
            a, b, tr = a[k], b[k], tr[k]
            k = tri.in_triangle(tris[tr], x[b], y[b])[0]
            # a point on the diagonal is in both triangles of a box: it counts for the first one
            second = np.flatnonzero(k & (tr % 2 == 1))
            k[second] = ~tri.in_triangle(tris[tr[second] - 1], x[b[second]], y[b[second]])[0]
            a, b = a[k], b[k]
            if sphere:
                f = z[b].astype(int)
                chord = np.sqrt(((from_face(f, x[a], y[a]) - from_face(f, x[b], y[b])) ** 2).sum(1))
                d = 2 * np.arcsin(np.minimum(1, chord / 2))
            else:
                d = np.hypot(x[a] - x[b], y[a] - y[b])
            k = d <= radius * (1 + 1e-9)
            i, j = ids[a[k]], ids[b[k]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["id_a", "id_b"])

    routed = at.select("id", "z", "x", "y").mapInArrow(route, ROUTED)
    return routed.repartition(cuts.groups(True), "leaf").groupBy("leaf").applyInArrow(search, "id_a bigint, id_b bigint")


# -- points inside regions --------------------------------------------------------------------------


def sky_region_faces(ring: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A ring of (lon, lat) degrees within a hemisphere on each cube face that it may touch.

    Where a corner lies behind a face's horizon, the ring is first clipped to the face: by the four planes through
    the sphere's centre and the face's edges, in which great circles meet straight lines.
    """
    p = unit(ring[:, 0], ring[:, 1])
    for f in range(6):
        uv = on_face(p, np.full(len(p), f))
        if not np.isfinite(uv).all():
            ax = _AXES[f // 2]
            w = np.zeros(3)
            w[ax[0]] = (-1.0 if f % 2 else 1.0) * (1 + 1e-9)
            q = p
            for k, sign in ((1, 1.0), (1, -1.0), (2, 1.0), (2, -1.0)):
                side = w.copy()
                side[ax[k]] = sign
                q = _above(q, side)
            if len(q) < 3:
                continue
            uv = on_face(q, np.full(len(q), f))
        if (uv.min(0) <= 1).all() and (uv.max(0) >= -1).all():
            yield f, uv


def _above(p: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The corners of a ring of directions cut to the half space ``side``."""
    if not len(p):
        return p
    d = p @ side
    out = []
    for k in range(len(p)):
        if d[k - 1] < 0 < d[k] or d[k] < 0 < d[k - 1]:
            out.append(p[k - 1] + (p[k] - p[k - 1]) * (d[k - 1] / (d[k - 1] - d[k])))
        if d[k] >= 0:
            out.append(p[k])
    return np.array(out).reshape(-1, 3)


def sky_rings(regions: DataFrame) -> DataFrame:
    """Regions ``(region_id, ring of [lon, lat] degrees)`` on the cube faces of ``sky_plane``."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, ring in zip(b.column("region_id").to_pylist(), b.column("ring").to_pylist()):
                r = np.array([c for c in ring or [] if c and len(c) == 2 and None not in c], float).reshape(-1, 2)
                if len(r):
                    out += [(k, f, uv.tolist()) for f, uv in sky_region_faces(r)]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.list_(pa.float64())))], ["region_id", "z", "ring"])

    return regions.filter(F.col("region_id").isNotNull()).select(F.col("region_id").cast("bigint").alias("region_id"), "ring").mapInArrow(project, "region_id bigint, z bigint, ring array<array<double>>")


def regions_of(at: DataFrame, regions: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(id, region_id, on_boundary)`` for every row of ``at`` (id, z, x, y) and the regions that hold it.

    ``regions`` has ``region_id bigint, z bigint, ring array<array<double>>`` in the
    same planes. A region holds its boundary. However many of its triangles hold a
    point, a region is reported once for it; a point that lies on the boundary of
    several regions and inside none goes to the one with the smallest id. Rows
    repeating an id at one position count once. Regions without three distinct
    finite corners or without area hold nothing; empty inputs give no rows.
    """
    cuts = place_cuts(at.select("z", "x", "y"), leaf_rows)
    routed = "leaf int, id bigint, z bigint, x double, y double, corners array<double>"

    def batch(leaf, ids, z, x, y, corners) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(ids), pa.array(z), pa.array(x, pa.float64()), pa.array(y, pa.float64()), pa.array(corners, pa.list_(pa.float64()))], ["leaf", "id", "z", "x", "y", "corners"])

    def route_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, z, x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "z", "x", "y"))
            r, leaf = cuts.of_boxes(z, x, y, x, y)
            k, group = cuts.shares(leaf, ids[r], True, False)
            r = r[k]
            yield batch(group, ids[r], z[r], x[r], y[r], [None] * len(r))

    def route_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, z = b.column("region_id").to_numpy(zero_copy_only=False), b.column("z").to_numpy(zero_copy_only=False)
            rings = [np.array([c for c in ring or [] if c and len(c) == 2 and None not in c], float).reshape(-1, 2) for ring in b.column("ring").to_pylist()]
            owner, t = tri.ear_clip(rings)
            lo, hi = t.min(1), t.max(1)
            r, leaf = cuts.of_boxes(z[owner], lo[:, 0], lo[:, 1], hi[:, 0], hi[:, 1])
            k, leaf = cuts.shares(leaf, ids[owner[r]], False, False)
            r = r[k]
            yield batch(leaf, ids[owner[r]], z[owner[r]], np.full(len(r), np.nan), np.full(len(r), np.nan), list(t[r].reshape(-1, 6)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        ids, z, x, y = (t.column(c).to_numpy() for c in ("id", "z", "x", "y"))
        corners = t.column("corners")
        is_tri = corners.is_valid().to_numpy()
        flat = corners.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        plane = np.unique(z, return_inverse=True)[1].astype(float)
        tris, owner = flat.reshape(-1, 3, 2), ids[is_tri]
        if not len(tris):
            return
        bvh = tri.Bvh(plane[is_tri], tris)
        pts = np.flatnonzero(~is_tri)
        found, ends = [], {}
        for pt, tr in bvh.candidates(plane[pts], x[pts], y[pts]):
            p = pts[pt]
            k, edge = tri.in_triangle(tris[tr], x[p], y[p])
            found.append(np.column_stack([p[k], owner[tr[k]], _outer(tris, tr[k], x[p[k]], y[p[k]], edge[k], owner, plane[is_tri], ends)]))
        hits = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        if not len(hits):
            return
        hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
        first = np.r_[True, (hits[1:, :2] != hits[:-1, :2]).any(1)]  # interior before boundary: one row a region
        hits = hits[first]
        inner = np.zeros(len(ids), bool)
        inner[hits[hits[:, 2] == 0, 0]] = True
        start = np.r_[True, hits[1:, 0] != hits[:-1, 0]]
        hits = hits[inner[hits[:, 0]] | start]
        out = np.unique(np.column_stack([ids[hits[:, 0]], hits[:, 1], hits[:, 2]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2] > 0)], ["id", "region_id", "on_boundary"])

    both = at.select("id", "z", "x", "y").mapInArrow(route_points, routed).unionByName(regions.filter(F.col("region_id").isNotNull()).select("region_id", "z", "ring").mapInArrow(route_regions, routed))
    return both.repartition(cuts.groups(False), "leaf").groupBy("leaf").applyInArrow(search, "id bigint, region_id bigint, on_boundary boolean")


def _outer(tris, tr, x, y, edge, owner, plane, ends: dict[tuple, int]) -> np.ndarray:
    """1 where a point on a triangle's edge is on its region's boundary: no other triangle of it shares that edge.

    ``ends`` keeps how many triangles share each edge, counted when a point first lies on one.
    """
    out = np.zeros(len(tr), np.int64)
    if not edge.any():
        return out
    if not ends:
        for t in range(len(tris)):
            for i in range(3):
                a, b = sorted((tuple(tris[t, i]), tuple(tris[t, (i + 1) % 3])))
                ends[owner[t], plane[t], a, b] = ends.get((owner[t], plane[t], a, b), 0) + 1
    for k in np.flatnonzero(edge):
        t = tr[k]
        for i in range(3):
            a, b = tris[t, i], tris[t, (i + 1) % 3]
            cross = (b[0] - a[0]) * (y[k] - a[1]) - (b[1] - a[1]) * (x[k] - a[0])
            if abs(cross) <= 3.4e-16 * (abs((b[0] - a[0]) * (y[k] - a[1])) + abs((b[1] - a[1]) * (x[k] - a[0]))):
                p, q = sorted((tuple(a), tuple(b)))
                if ends[owner[t], plane[t], p, q] == 1:
                    out[k] = 1
    return out
