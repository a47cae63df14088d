"""Evaluation texts leaking into training text: latent semantic retrieval, then subsequence and answer checks.

The test items are a stated query set: it is taken in blocks of bounded size, each against all documents.

1. Texts become sequences of term numbers of the block's vocabulary; other words are -1. Long
   texts are cut into overlapping parts, so that no part is unbounded and no passage is cut.
2. Passages are windows of words, weighted by inverse document frequency over all
   documents. A randomised SVD over all passages, distributed (each task adds up
   its share of the sketch), gives the latent space.
3. An index from terms to items counts a passage's words of each item; where there are
   enough, the passage is a candidate if it is close to one of the item's windows in the latent space (cosine).
4. A candidate holds if a window of the item has a long enough common subsequence
   with the text about the passage and, exactly, few enough changed words. A passage that other
   text interrupts once holds if, besides, the words that only this item (or hardly another)
   has, which carry its answer, lie on both sides of the interruption.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.lookalike import skeleton
from skyloom.session import written

PART, OVERLAP = 4096, 64
WIDTH, STEP = 26, 5
# Wherever a leaked stretch lies, one of the windows over it has at least 18 words of its item; of an interrupted one at least 10, with a word that carries the answer.
KNOWN, HALF = 18, 10
RANK, SPARE, SEED = 160, 16, 5
COSINE = 0.5
BLOCK_WORDS = 20_000  # of the test items searched at once: at most so many terms, so the basis held by the driver and each task is under 50 MB
COMMON = 8  # words of over one in so many items are common ones
PART_WORDS, OWN_ITEMS, ANSWERS = 6, 3, 1  # an interrupted passage: least words of a part, items that a word with an answer is in at most, least such words of a part
# (words of an item window, words that may differ): a passage of n words of which one in eight may
# differ holds one of these windows with at most as many changes, whatever n from 20 on
WINDOWS = ((20, 2), (24, 3), (32, 4))

_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>\n]{0,200})?/?>", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words without regard to case, punctuation, white space, markup, line prefixes, accents and look."""
    t = _TAG.sub(" ", skeleton(html.unescape(text)))
    t = unicodedata.normalize("NFKD", t)
    if not t.isascii():
        t = "".join(c for c in t if not unicodedata.combining(c))
    return _WORD.findall(t.casefold())


class Passages:
    """Windows of a block of parts that hold a known word, with their terms and weights relative to the passage's norm."""

    def __init__(self, offsets: np.ndarray, ids: np.ndarray, weight: np.ndarray, unknown: float, step: int = STEP):
        self.ids, self.weight, self.unknown = ids, weight, unknown
        lengths = np.diff(offsets)
        n = np.maximum(1, -(-(lengths - WIDTH) // step) + 1)
        self.owner = np.repeat(np.arange(len(lengths)), n)
        self.start = offsets[self.owner] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
        self.end = np.minimum(self.start + WIDTH, offsets[self.owner + 1])
        there = np.r_[0, np.cumsum(ids >= 0)]
        self.keep(there[self.end] > there[self.start])

    def keep(self, which: np.ndarray) -> None:
        self.start, self.end, self.owner = self.start[which], self.end[which], self.owner[which]

    def rows(self, most: int = 2048) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(which passages, term and weight of each of their known words, first such word of each passage) in blocks."""
        for s in range(0, len(self.start), most):
            part = slice(s, min(s + most, len(self.start)))
            a, n = self.start[part], self.end[part] - self.start[part]
            row = np.repeat(np.arange(len(a)), n)
            term = self.ids[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            there = term >= 0
            rest = np.bincount(row[~there], minlength=len(a)) * self.unknown**2
            row, term = row[there], term[there]
            # a term that comes several times weighs as often
            key = row.astype(np.int64) * len(self.weight) + term
            key, times = np.unique(key, return_counts=True)
            row, term = key // len(self.weight), key % len(self.weight)
            w = self.weight[term] * times
            w /= np.sqrt(np.bincount(row, w * w, minlength=len(a)) + rest)[row]
            yield part, term, w.astype(np.float32), np.searchsorted(row, np.arange(len(a)))


def latent(basis: np.ndarray, term: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each passage in the latent space."""
    return np.add.reduceat(basis[term] * w[:, None], first)


def _blocks(batches: Iterator[pa.RecordBatch], most: int = 60_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, offsets, ids) of blocks of about ``most`` words."""
    for b in batches:
        col = b.column("ids")
        off, flat = np.asarray(col.offsets), np.asarray(col.values)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield b.slice(i, j - i), off[i : j + 1] - off[i], flat[off[i] : off[j]]
            i = j


def parts_of(docs: DataFrame, id: str, text: str, vocabulary: dict[str, int]) -> DataFrame:
    """``(doc_id, ids)`` of every part of every text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_, parts = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.array([vocabulary.get(w, -1) for w in words(t)], np.int32)
                for s in range(0, max(1, len(ids) - OVERLAP), PART - OVERLAP):
                    docs_.append(d)
                    parts.append(ids[s : s + PART])
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.filter(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(read, "doc_id bigint, ids array<int>")


def _added_up(parts: DataFrame, basis: np.ndarray, weight: np.ndarray, unknown: float, small: bool = False) -> np.ndarray:
    """Gram matrix A'A of passages that together hold every word, times ``basis`` (or basis' A'A basis): each task adds up its passages, Spark the tasks' blocks of rows."""
    width = basis.shape[1]
    n_rows = width if small else len(basis)
    step = 256

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, q = np.zeros((n_rows, width)), basis.astype(np.float32)
        for _, off, ids in _blocks(batches):
            for _, term, w, first in Passages(off, ids, weight, unknown, step=WIDTH).rows():
                y = latent(q, term, w, first)
                if small:
                    total += y.T @ y
                    continue
                order = np.argsort(term, kind="stable")
                some, at = np.unique(term[order], return_index=True)
                of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(term)]))[order]
                total[some] += np.add.reduceat(y[of] * w[order, None], at)
        blocks = [total[i : i + step].tobytes() for i in range(0, n_rows, step)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block = None, None
        for b in batches:
            for k, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist()):
                v = np.frombuffer(data)
                total, block = (v.copy() if total is None else total + v), k
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "data"])

    summed = parts.select("ids").mapInArrow(share, "block int, data binary").groupBy("block").applyInArrow(add, "block int, data binary")
    got = {r["block"]: np.frombuffer(r["data"]).reshape(-1, width) for r in summed.collect()}  # at most BLOCK_WORDS terms x rank
    return np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros((n_rows, width))


def latent_basis(parts: DataFrame, weight: np.ndarray, unknown: float, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of all passages, by a randomised SVD with one power step."""
    n = len(weight)
    width = min(n, rank + SPARE)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, width)))[0]
    q = np.linalg.qr(_added_up(parts, q, weight, unknown))[0]
    small = _added_up(parts, q, weight, unknown, small=True)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    return q @ vector[:, np.argsort(value)[::-1][:rank]]


# -- subsequence checks, all windows of many candidates at once -------------------------------------------

_ONE = np.uint64(1)


def _masks(pattern: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Bit j set where the window's word j equals the text's word; unknown words equal nothing."""
    eq = (pattern == word[:, None]) & (word >= 0)[:, None]
    return (eq.astype(np.uint64) << np.arange(pattern.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)


def common_subsequence(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each window (rows of ``pattern``) with its text, bit-parallel."""
    m = pattern.shape[1]
    full = np.uint64((1 << m) - 1)
    v = np.full(len(pattern), full)
    for k in range(text.shape[1]):
        u = v & _masks(pattern, text[:, k])
        v = ((v + u) | (v - u)) & full
    return m - np.bitwise_count(v).astype(int)


def least_changes(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Fewest changed, dropped or added words between each window and any stretch of its text, bit-parallel."""
    m = pattern.shape[1]
    full, top = np.uint64((1 << m) - 1), np.uint64(m - 1)
    pv, mv = np.full(len(pattern), full), np.zeros(len(pattern), np.uint64)
    score = np.full(len(pattern), m)
    best = score.copy()
    for k in range(text.shape[1]):
        eq = _masks(pattern, text[:, k])
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh & full
        score = score + ((ph >> top) & _ONE).astype(int) - ((mh >> top) & _ONE).astype(int)
        ph, mh = (ph << _ONE) & full, (mh << _ONE) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        best = np.minimum(best, score)
    return best


def least_changes_in_two(pattern: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """As ``least_changes`` where other text, however long, may stand once between the window's words: before one of those that ``at`` marks."""
    (rows, m), wide = pattern.shape, text.shape[1]
    far = np.int16(999)

    def ends(p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """[j, k]: fewest changes between the first j words of p and a stretch of t that ends before k; then the least up to k."""
        out = np.empty((m + 1, wide + 1, rows), np.int16)
        out[0] = 0
        out[:, 0] = np.arange(m + 1, dtype=np.int16)[:, None]
        for k in range(wide):
            for j in range(m):
                differs = ((p[:, j] != t[:, k]) | (t[:, k] < 0)).astype(np.int16)
                out[j + 1, k + 1] = np.minimum(np.minimum(out[j, k + 1] + 1, out[j + 1, k] + 1), out[j, k] + differs)
        return np.minimum.accumulate(out, 1)

    before, after = ends(pattern, text), ends(pattern[:, ::-1], text[:, ::-1])[::-1, ::-1]
    both = np.where(at.T, (before[:m] + after[:m]).min(1), far)
    return both.min(0)


def holds(cases: list[tuple[np.ndarray, np.ndarray]], answers: list[np.ndarray] | None = None, most: int = 40_000) -> np.ndarray:
    """For each (text words, item words): whether the text holds a passage of the item.

    ``answers`` marks the words of each case's item that carry its answer; with it, passages interrupted once count too.
    """
    out = np.zeros(len(cases), bool)
    present = [np.r_[0, np.cumsum(np.isin(item, text))] for text, item in cases]
    for n, changes in WINDOWS:
        # no subsequence is longer than the number of the window's words that the text has at all
        live = {i: np.flatnonzero(c[n:] - c[:-n] >= n - changes) for i, c in enumerate(present) if len(c) > n and not out[i]}
        todo = sorted((i for i, w in live.items() if len(w)), key=lambda i: len(cases[i][0]))
        k = 0
        while k < len(todo):
            rows, part = 0, []
            while k < len(todo) and rows < most:
                part.append(todo[k])
                rows += len(live[todo[k]])
                k += 1
            pattern = np.concatenate([np.lib.stride_tricks.sliding_window_view(cases[i][1], n)[live[i]] for i in part])
            of = np.repeat(np.arange(len(part)), [len(live[i]) for i in part])
            wide = max(len(cases[i][0]) for i in part)
            text = np.full((len(part), wide), -1, np.int32)
            for r, i in enumerate(part):
                text[r, : len(cases[i][0])] = cases[i][0]
            near = np.flatnonzero(common_subsequence(pattern, text[of]) >= n - changes)
            if not len(near):
                continue
            ok = least_changes(pattern[near], text[of[near]]) <= changes
            out[np.array(part)[of[near[ok]]]] = True
            if answers is None:
                continue
            near = near[~out[np.array(part)[of[near]]]]
            told = np.concatenate([np.lib.stride_tricks.sliding_window_view(answers[i], n)[live[i]] for i in part])[near]
            upto = np.cumsum(told, 1) - told  # before each word
            at = (upto >= ANSWERS) & (told.sum(1, keepdims=True) - upto >= ANSWERS)
            at[:, :PART_WORDS] = at[:, n - PART_WORDS + 1 :] = False
            near, at = near[at.any(1)], at[at.any(1)]
            few = max(1, 20_000_000 // (wide * n))
            for s in range(0, len(near), few):
                r = near[s : s + few]
                ok = least_changes_in_two(pattern[r], text[of[r]], at[s : s + few]) <= changes
                out[np.array(part)[of[r[ok]]]] = True
    return out


def _item_blocks(items: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """(item, words) in blocks of at most ``block_words``; an item of more is cut into overlapping pieces. The driver holds one block."""
    least, margin = WINDOWS[0][0], max(n for n, _ in WINDOWS)
    found = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).distinct().orderBy("i", "t")
    block, total = [], 0
    for k, t in found.toLocalIterator():
        w = words(t)
        for s in range(0, max(1, len(w) - margin), block_words - margin):
            piece = w[s : s + block_words]
            if len(piece) < least:
                continue
            if total + len(piece) > block_words:
                yield block
                block, total = [], 0
            block.append((k, piece))
            total += len(piece)
    if block:
        yield block


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, rank: int = RANK, cosine: float = COSINE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id)``: documents that hold a passage of an item.

    A passage is at least 20 consecutive words of the item, of which up to one
    in eight may be changed, dropped or added; other text of up to about 30 words may interrupt it once, if at least 6
    words, one of which hardly another item has, are on either side. However many, the items
    are searched in blocks of ``block_words`` words. Null ids and texts hold nothing; items under 20
    words have no passage; repeated rows count once; empty tables give no rows.
    """
    found = [_leaked(docs, doc_id, text, block, rank, cosine) for block in _item_blocks(items, item_id, item_text, block_words)]
    if not found:
        return docs.sparkSession.createDataFrame([], SHAPE)
    return reduce(DataFrame.unionByName, found).distinct()


SHAPE = "doc_id bigint, item_id bigint"


def _leaked(docs: DataFrame, doc_id: str, text: str, item_words: list[tuple[int, list[str]]], rank: int, cosine: float) -> DataFrame:
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, x in item_words for w in x}))}
    item_ids = [(k, np.array([vocabulary[w] for w in x], np.int32)) for k, x in item_words]
    # how often an item has a term does not matter: a word of the passage is the item's or not
    of_item = np.zeros((len(vocabulary) + 1, len(item_ids)), np.uint16)
    for i, (_, x) in enumerate(item_ids):
        of_item[x, i] = 1
    held = of_item.sum(1)
    rare = held <= OWN_ITEMS
    common = held > max(OWN_ITEMS, len(item_ids) // COMMON)  # counted for every item alike: a bound from above
    common[-1] = False
    special = ~common
    special[-1] = False
    answers = [rare[x] for _, x in item_ids]
    of_item += 256 * (of_item & rare[:, None])  # words in the lower byte, those that carry an answer in the upper one

    parts = written(parts_of(docs, doc_id, text, vocabulary), "parts")
    n = max(1, parts.count())
    df = np.zeros(len(vocabulary))
    for r in parts.select(F.explode(F.array_distinct("ids")).alias("t")).filter("t >= 0").groupBy("t").count().toLocalIterator():
        df[r["t"]] = r["count"]
    weight = np.log((n + 1) / (df + 1)) + 0.1
    unknown = float(np.log(n + 1)) + 0.1
    basis = latent_basis(parts, weight, unknown, rank)

    # windows of the items in the latent space
    width, targets = WINDOWS[0][0], []
    for _, x in item_ids:
        c = np.r_[np.zeros((1, basis.shape[1])), np.cumsum(weight[x][:, None] * basis[x], 0)]
        s = np.array(sorted({*range(0, len(x) - width + 1, 3), len(x) - width}))
        t = c[s + width] - c[s]
        targets.append((t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)).astype(np.float32))
    space, block = basis.astype(np.float32), max(4_096, 15_000_000 // len(item_ids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, off, ids in _blocks(batches, min(60_000, block)):
            p = Passages(off, ids, weight, unknown)
            # words of each item in each passage: differences of running counts (modulo 2^16)
            at, alike = np.r_[0, np.cumsum(special[ids])], np.r_[0, np.cumsum(common[ids])].astype(np.uint16)
            p.keep((alike[p.end] - alike[p.start]) + (at[p.end] - at[p.start]) >= HALF)
            run = np.zeros((at[-1] + 1, len(item_ids)), np.uint16)
            np.cumsum(of_item[ids[special[ids]]], 0, out=run[1:], dtype=np.uint16)
            many = run[at[p.end]] - run[at[p.start]] + (alike[p.end] - alike[p.start])[:, None]
            many = (many & 255 >= KNOWN) | (many & 255 >= HALF) & (many >= 256)
            del run
            enough = many.any(1)
            p.keep(enough)
            if not len(p.start):
                continue
            y = np.concatenate([latent(space, term, w, first) for _, term, w, first in p.rows()])
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            hits, many = [np.empty((0, 4), np.int64)], many[enough]
            for i in np.flatnonzero(many.any(0)):
                w = np.flatnonzero(many[:, i])
                w = w[(y[w] @ targets[i].T).max(1) >= cosine]
                hits.append(np.column_stack([p.owner[w], np.full(len(w), i), p.start[w], p.end[w]]))
            h = np.concatenate(hits)
            if not len(h):
                continue
            h = h[np.lexsort((h[:, 2], h[:, 1], h[:, 0]))]
            # neighbouring passages close to one item are one stretch of text
            margin = OVERLAP // 2
            new = np.r_[True, (h[1:, :2] != h[:-1, :2]).any(1) | (h[1:, 2] > h[:-1, 3] + 2 * margin)]
            s = np.flatnonzero(new)
            lo_, hi_ = h[s, 2] - margin, np.maximum.reduceat(h[:, 3], s) + margin
            lo_, hi_ = np.maximum(lo_, off[h[s, 0]]), np.minimum(hi_, off[h[s, 0] + 1])
            ok = holds([(ids[a:z], item_ids[i][1]) for a, z, i in zip(lo_, hi_, h[s, 1])], [answers[i] for i in h[s, 1]])
            if ok.any():
                docs_ = b.column("doc_id").to_numpy()[h[s[ok], 0]]
                pair = np.unique(np.column_stack([docs_, [item_ids[i][0] for i in h[s[ok], 1]]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["doc_id", "item_id"])

    return parts.mapInArrow(search, SHAPE)
