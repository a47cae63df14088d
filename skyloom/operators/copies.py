"""Differences between two copies of one data set, key by key and field by field.

Keys of both sides share ordinals within blocks of the key's hash. A block holds
a presence bitmap per side: AND-NOT gives the keys that one side lacks, AND those
whose fields are compared column by column, aligned by ordinal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.presence import Presence

BLOCK_KEYS = 100_000
_BLANKS = r"^[\s\u00a0]+|[\s\u00a0]+$"


def folded(c: Column) -> Column:
    """Without regard to case and surrounding blanks."""
    return F.lower(F.regexp_replace(c, _BLANKS, ""))


def folded_path(c: Column) -> Column:
    """As ``folded``, ``\\`` as ``/``, null as empty."""
    return F.coalesce(F.translate(folded(c), "\\", "/"), F.lit(""))


def differences(left: DataFrame, right: DataFrame, key: str, seen: str, fields: list[str], missing: tuple[str, str], block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``(key, field_name, left_value, right_value)`` for every key lacking on a side and every differing field.

    Both sides have columns ``key``, ``seen`` and ``fields`` (already brought to one
    spelling; other columns are ignored, whatever their names). Of several rows of a
    key on a side the one with the latest ``seen`` holds; among equally late rows the
    one with the larger fields, in their order, nulls lowest; a null ``seen`` is
    earlier than all. ``missing`` names the field for keys lacking on the right and on
    the left. Null equals only null; NaN equals NaN; a null key counts as an empty
    one. Two empty sides give no rows.

    Repeated rows of a key are combined before the first shuffle, so a key that
    holds a third of all rows stays one row a task.
    """
    blocks = max(1, math.ceil((left.count() + right.count()) / block_keys))

    def side(df: DataFrame, flag: bool) -> DataFrame:
        rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.struct(F.col(seen), *[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(fields)]).alias("s"))
        last = rows.groupBy("k").agg(F.max("s").alias("s"))
        return last.select((F.pmod(F.xxhash64("k"), F.lit(blocks))).cast("int").alias("block"), F.lit(flag).alias("is_left"), "k", *[F.col(f"s.v{i}").alias(f"v{i}") for i in range(len(fields))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        is_left = t.column("is_left").to_numpy()
        keys = t.column("k").dictionary_encode().combine_chunks()
        # shared ordinals: rank of the key among the block's keys
        order = pc.array_sort_indices(keys.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ordinal = rank[keys.indices.to_numpy()]
        names = keys.dictionary.take(pa.array(order))
        row = np.full((2, len(order)), -1)
        row[is_left.astype(int), ordinal] = np.arange(len(ordinal))
        lefts, rights = Presence(ordinal[is_left]), Presence(ordinal[~is_left])

        def out(which: np.ndarray, name: str, a: pa.Array, b: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names.take(pa.array(which)), pa.array([name] * len(which)), a, b], ["key", "field_name", "left_value", "right_value"])

        for name, gone in ((missing[0], lefts.and_not(rights).ordinals()), (missing[1], rights.and_not(lefts).ordinals())):
            if len(gone):
                yield out(gone, name, pa.nulls(len(gone), pa.string()), pa.nulls(len(gone), pa.string()))
        both = lefts.and_(rights).ordinals()
        for i, name in enumerate(fields):
            v = t.column(f"v{i}").combine_chunks()
            a, b = v.take(pa.array(row[1, both])), v.take(pa.array(row[0, both]))
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            k = np.flatnonzero(~same.to_numpy(zero_copy_only=False))
            if len(k):
                yield out(both[k], name, a.take(pa.array(k)), b.take(pa.array(k)))

    both = side(left, True).unionByName(side(right, False))
    return both.repartition(blocks, "block").groupBy("block").applyInArrow(compare, "key string, field_name string, left_value string, right_value string")
