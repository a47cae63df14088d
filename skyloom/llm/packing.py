"""Filling containers of fixed capacity with texts, sized in tokens of a public tokenizer.

Bounded-space online packing: each partition keeps a fixed number of open windows,
puts a text where it fits best, and emits the fullest window when it fits in none.
Windows still open at the end are merged in groups of bounded size.
"""

from __future__ import annotations

import base64
import math
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.session import written

OPEN_WINDOWS = 64
MERGE_ROWS = 20_000
MAX_LIMITS = 1_000
RANKS = "byte_bpe_50k.tiktoken"

_ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_WINDOW = "limit_id int, capacity bigint, window string, is_full boolean, used bigint, items array<struct<doc_id:bigint,piece:int,start:bigint,n_tokens:bigint>>"
_NAMES = ["limit_id", "capacity", "window", "is_full", "used", "items"]


def tokenizer_path(name: str = RANKS) -> str:
    """Where the vocabulary lies: the folder in SKYLOOM_TOKENIZERS, or that of the installed public files."""
    folder = os.environ.get("SKYLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


# Fixed value: how this vocabulary splits text before its merges.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | None, path: str) -> int:
    return len(_encoding(path).encode_ordinary(text.encode("utf-8", "replace").decode())) if text else 0


class Open:
    """The open windows of one capacity: best fit in O(log n), the fullest emitted when none fits."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[tuple[int, int]] = []  # (space left, window), ascending
        self.items: dict[int, list] = {}
        self.next = 0

    def put(self, size: int, items: list) -> Iterator[tuple[int, int, list]]:
        """Places ``items`` of together ``size``; yields windows (number, used, items) that this closes."""
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            space, w = self.free.pop(k)
            self.items[w] += items
        else:
            if len(self.free) >= self.most:
                yield self._close(0)
            space, w = self.capacity, self.next
            self.next += 1
            self.items[w] = list(items)
        insort(self.free, (space - size, w))
        # full in tokens, or in texts: a window of empty texts must not grow without bound
        if space == size or len(self.items[w]) >= self.capacity:
            yield self._close(bisect_left(self.free, (space - size, w)))

    def _close(self, k: int) -> tuple[int, int, list]:
        space, w = self.free.pop(k)
        return w, self.capacity - space, self.items.pop(w)

    def rest(self) -> Iterator[tuple[int, int, list]]:
        while self.free:
            yield self._close(0)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.bool_()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.list_(_ITEM))], _NAMES)


def packed(docs: DataFrame, id: str, text: str, limits: DataFrame, path: str | None = None, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """``(limit_id, container_id, used, doc_id, piece, start, n_tokens)``: every text in a container of each capacity.

    ``limits`` holds ``limit_id`` and ``capacity_tokens`` (at most 1,000 rows; null or
    non-positive capacities and repeated rows are left out; an id with several capacities
    has containers of each, whose ids begin with the capacity). A text is whole
    (piece 0, start 0) unless it alone exceeds the capacity; then it is cut every
    ``capacity`` tokens, and only its last piece shares a container. Null and
    empty texts have no tokens and come out all the same; a container holds at most
    as many texts as tokens. A repeated row is packed each time; a null id is kept. An
    empty table gives no containers.
    """
    path = path or tokenizer_path()
    caps = [(r[0], r[1]) for r in limits.select(F.col("limit_id").cast("int"), F.col("capacity_tokens").cast("bigint")).filter("limit_id IS NOT NULL AND capacity_tokens > 0").distinct().limit(MAX_LIMITS + 1).collect()]
    if len(caps) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} capacities")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state = {(k, c): Open(c, open_windows) for k, c in caps}
        for b in batches:
            out = []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                n = n_tokens(t, path)
                for limit, cap in caps:
                    o = state[limit, cap]
                    pieces = max(1, math.ceil(n / cap))
                    for p in range(pieces):
                        size = min(cap, n - p * cap)
                        for w, used, items in o.put(size, [(doc, p, p * cap, size)]):
                            out.append((limit, cap, f"{cap}-{part}-{w}", True, used, items))
            if out:
                yield _rows(out)
        left = [(limit, cap, f"{cap}-{part}-{w}", False, used, items) for (limit, cap), o in state.items() for w, used, items in o.rest()]
        if left:
            yield _rows(left)

    windows = written(docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(pack, _WINDOW), "windows")
    left = windows.filter("NOT is_full")
    groups = max(1, math.ceil(left.count() / MERGE_ROWS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (-r["used"], r["window"]))
        if not rows:
            return
        limit, cap = rows[0]["limit_id"], rows[0]["capacity"]
        o = Open(cap, len(rows))
        done, name = [], {}
        for r in rows:  # longest first into the best fit: all windows of the group stay open
            first = o.next
            items = [(i["doc_id"], i["piece"], i["start"], i["n_tokens"]) for i in r["items"]]
            closed = list(o.put(r["used"], items))
            if o.next > first:
                name[first] = r["window"]
            done += closed
        done += o.rest()
        for k in range(0, len(done), 1000):
            yield _rows([(limit, cap, name[w], True, used, items) for w, used, items in done[k : k + 1000]])

    merged = left.withColumn("g", F.pmod(F.xxhash64("window"), F.lit(groups))).groupBy("limit_id", "capacity", "g").applyInArrow(lambda t: t if not t.num_rows else pa.Table.from_batches(list(merge(iter(t.drop_columns("g").to_batches()))), schema=t.drop_columns("g").schema), _WINDOW)
    both = windows.filter("is_full").unionByName(merged)
    return both.select("limit_id", F.col("window").alias("container_id"), "used", F.inline("items")).withColumnsRenamed({"col1": "doc_id"})
