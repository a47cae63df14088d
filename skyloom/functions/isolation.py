"""Isolation forests of many sources at once, in numpy: all trees of a block grow level by level.

Every random choice is a hash of the forest's seed, the tree and the node, and every subsample
a hash order of the rows' own keys. A forest thus depends on its source's rows only, not on the
block, task or order in which it is grown.
"""

from __future__ import annotations

import numpy as np

TREES, SAMPLE = 32, 64


def mixed(*keys: np.ndarray | int) -> np.ndarray:
    """64-bit hash of integer keys, element by element (splitmix64 after each key)."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in keys:
            h = h ^ np.asarray(k).astype(np.int64).view(np.uint64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = (h ^ (h >> np.uint64(31))) + np.uint64(0x9E3779B97F4A7C15)
    return h


def fraction(h: np.ndarray) -> np.ndarray:
    """A hash as a number from 0 to under 1."""
    return (h >> np.uint64(11)).astype(float) * 2.0**-53


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.maximum(n, 1).astype(float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def scores(group: np.ndarray, features: np.ndarray, fit: np.ndarray, key: np.ndarray | None = None, seed: np.ndarray | None = None, trees: int = TREES, sample: int = SAMPLE) -> np.ndarray:
    """Isolation score (near 1: isolated early) of each row under the forest of its group.

    ``group`` numbers the rows' sources from 0; ``fit`` marks the rows that its forest is
    grown from, ``key`` identifies a row and ``seed`` a group. Each tree takes at most
    ``sample`` of the fit rows, the method's own subsample; every row is scored. Rows of a
    group with nothing to grow from score 0.5.
    """
    n, width = features.shape
    rows = np.flatnonzero(fit)
    if not len(rows):
        return np.full(n, 0.5)
    n_groups = int(group.max()) + 1
    key = np.arange(n) if key is None else key
    seed = np.arange(n_groups) if seed is None else seed
    # a group's fit rows in the order of their hashes; a tree takes a stretch of it from a place of its own
    rows = rows[np.lexsort((mixed(key[rows], seed[group[rows]]), group[rows]))]
    many = np.bincount(group[rows], minlength=n_groups)
    first = np.cumsum(many) - many
    of, number = np.repeat(np.arange(n_groups), trees), np.tile(np.arange(trees), n_groups)
    size = np.minimum(many, sample)[of]
    tree = np.repeat(np.arange(len(of)), size)
    place = np.arange(len(tree)) - np.repeat(np.cumsum(size) - size, size)
    begin = (mixed(seed[of], number, 1) % np.maximum(many[of], 1).astype(np.uint64)).astype(np.int64)
    point = rows[first[of[tree]] + (begin[tree] + place) % many[of[tree]]]
    depth = int(np.ceil(np.log2(max(2, size.max()))))

    # node k of a level goes on as 2k and 2k + 1; a leaf passes everything to 2k, so the path is read at the last level
    node, levels, length = np.zeros(len(tree), np.int64), [], np.zeros((len(of), 1 << depth))
    for d in range(depth + 1):
        wide = 1 << d
        at = tree * wide + node
        order = np.argsort(at, kind="stable")
        tree, point, node, at = tree[order], point[order], node[order], at[order]
        cuts, by = np.full(len(of) * wide, np.inf), np.zeros(len(of) * wide, np.int64)
        if len(tree):
            start = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
            count = np.diff(np.r_[start, len(at)])
            x = features[point]
            lo, hi = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
            t, k, r = tree[start], node[start], np.arange(len(start))
            draw = [fraction(mixed(seed[of[t]], number[t], wide + k, 2 + c)) for c in range(width + 1)]
            f = np.where(hi > lo, np.column_stack(draw[:width]), -1.0).argmax(1)
            split = (hi > lo).any(1) & (d < depth)
            cut = lo[r, f] + draw[width] * (hi[r, f] - lo[r, f])
            cut = np.minimum(cut, np.nextafter(hi[r, f], -np.inf))
            cuts[at[start[split]]], by[at[start[split]]] = cut[split], f[split]
            length[t[~split], k[~split] << (depth - d)] = d + _mean_path(count[~split])
            right = x[np.arange(len(x)), np.repeat(f, count)] > np.repeat(cut, count)
            on = np.repeat(split, count)
            tree, point, node = tree[on], point[on], (2 * node + right)[on]
        levels.append((cuts, by))

    flat, row, path = features.ravel(), np.arange(n) * width, np.zeros(n)
    for i in range(trees):
        own, at = group * trees + i, np.zeros(n, np.int64)
        for d in range(depth):
            cuts, by = levels[d]
            q = (own << d) + at
            at = 2 * at + (flat[row + by[q]] > cuts[q])
        path += length[own, at]
    norm = _mean_path(np.minimum(many, sample))[group]
    return np.where(norm > 0, 2.0 ** (-path / trees / np.maximum(norm, 1e-9)), 0.5)


def apart(score: np.ndarray, group: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """How far each row's score is above the median score of its group's fit rows, in scaled median absolute deviations."""

    def middle(v: np.ndarray) -> np.ndarray:
        order = np.lexsort((v, g))
        return v[order][first + (many - 1) // 2]

    rows = np.flatnonzero(fit)
    n_groups = int(group.max()) + 1 if len(group) else 0
    out = np.zeros(len(score))
    many = np.bincount(group[rows], minlength=n_groups)
    there = many > 0
    number = np.cumsum(there) - 1
    g, many = number[group[rows]], many[there]
    if not len(rows):
        return out
    first = np.cumsum(many) - many
    mid = middle(score[rows])
    mad = 1.4826 * middle(np.abs(score[rows] - mid[g]))
    k = there[group]
    own = number[group[k]]
    off = score[k] - mid[own]
    out[k] = np.where(np.abs(off) < 1e-12, 0.0, off / np.maximum(mad[own], 1e-12))
    return out


def counted(group: np.ndarray, features: np.ndarray, weight: np.ndarray, seed: np.ndarray, order: np.ndarray | None = None, trees: int = TREES) -> np.ndarray:
    """Isolation score of each cell under the forest of its group, which is grown from all the group's rows.

    A cell stands for ``weight`` rows with the same features (0: it is scored and grows nothing); ``order`` is its
    own number, ``seed`` has a number for each group. Each tree takes an equal share of the rows, ``SAMPLE`` at
    least, so that each row is in one tree at least. Trees end at the depth of ``SAMPLE`` rows.
    """
    n, width = features.shape
    total = np.bincount(group, weight, len(seed))
    size = np.maximum(np.minimum(total, SAMPLE), np.ceil(total / trees))
    depth, norm = int(np.ceil(np.log2(SAMPLE))), _mean_path(size)[group]
    # rows in a hash order of their cells; a tree takes one every ``step`` of them from a start of its own
    every = np.lexsort((mixed(seed[group], np.arange(n) if order is None else order, 1), group))
    before = np.zeros(n)
    before[every] = np.cumsum(weight[every]) - weight[every]
    before -= (np.cumsum(total) - total)[group]
    step = np.maximum(total / np.maximum(size, 1), 1.0)[group]
    path = np.zeros(n)
    for number in range(trees):
        share = np.ceil((before + weight) / step - number / trees) - np.ceil(before / step - number / trees)
        low, high = (np.where(share[:, None] > 0, features, end) for end in (np.inf, -np.inf))
        cell, node = every[total[group[every]] > 0], np.zeros(n, np.int64)
        for d in range(depth + 1):
            at = (group[cell] << d) + node[cell]
            by = np.argsort(at, kind="stable")
            cell, at = cell[by], at[by]
            if not len(cell):
                break
            start = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
            many = np.diff(np.r_[start, len(at)])
            lo, hi, rows = np.minimum.reduceat(low[cell], start), np.maximum.reduceat(high[cell], start), np.add.reduceat(share[cell], start)
            g, k, r = group[cell[start]], node[cell[start]], np.arange(len(start))
            draw = [fraction(mixed(seed[g], number, (1 << d) + k, 2 + c)) for c in range(width + 1)]
            f = np.where(hi > lo, np.column_stack(draw[:width]), -1.0).argmax(1)
            split = (hi > lo).any(1) & (d < depth)
            cut = np.minimum(lo[r, f] + draw[width] * (hi[r, f] - lo[r, f]), np.nextafter(hi[r, f], -np.inf))
            on = np.repeat(split, many)
            path[cell[~on]] += d + np.repeat(_mean_path(rows), many)[~on]
            right = features[cell, np.repeat(f, many)] > np.repeat(cut, many)
            node[cell] = 2 * node[cell] + right
            cell = cell[on]
    return np.where(norm > 0, 2.0 ** (-path / trees / np.maximum(norm, 1e-9)), 0.5)


def counted_apart(score: np.ndarray, group: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``apart`` of cells that stand for ``weight`` rows each: the median and the deviation are those of all the rows."""
    out, rows = np.zeros(len(score)), np.flatnonzero(weight > 0)
    if not len(rows):
        return out
    total = np.bincount(group[rows], weight[rows]).astype(np.int64)
    there = total > 0
    number = np.cumsum(there) - 1
    g, w, many = number[group[rows]], weight[rows].astype(np.int64), total[there]
    before = np.cumsum(many) - many

    def middle(v: np.ndarray) -> np.ndarray:
        order = np.lexsort((v, g))
        return v[order][np.searchsorted(np.cumsum(w[order]), before + (many - 1) // 2, "right")]

    mid = middle(score[rows])
    mad = 1.4826 * middle(np.abs(score[rows] - mid[g]))
    k = (group < len(there)) & there[np.minimum(group, len(there) - 1)]
    own = number[group[k]]
    off = score[k] - mid[own]
    out[k] = np.where(np.abs(off) < 1e-12, 0.0, off / np.maximum(mad[own], 1e-12))
    return out
