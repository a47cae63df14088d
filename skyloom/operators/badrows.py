"""Rows that fail to parse: an error-recovering recursive-descent grammar for quoted, comma-separated records.

    records := record (newline record)*
    record  := field (',' field)*
    field   := quoted | bare
    quoted  := '"' (no quote | '""')* '"'      followed by ',' or the record's end
    bare    := (no quote, comma or newline)*

A broken quote is a located error. The parser then resumes at the next record-start
anchor. Where a table tells where its records start, these are the anchors; else it is a
line start from which a whole record parses with the right number of fields and a
plausible first field. What lies between belongs to the broken record.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import written

_QUOTED = re.compile(r'"([^"]*(?:""[^"]*)*)"')
_BARE_LINE, _BARE = re.compile(r'[^",\n]*'), re.compile(r'[^",]*')
_ANCHOR = re.compile(r'\n(?=[^\s",][^",\n]*,)')
_START = re.compile(r'[^\s",][^",\n]*,')
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_FILTER = re.compile(r"F[0-9]{3}(?:W2|W|M|N)", re.IGNORECASE)


NOT_CLOSED = "quote is not closed"


class Broken(Exception):
    """A quoting error at a character offset."""

    def __init__(self, at: int, message: str):
        self.at, self.message = at, message


@dataclass
class Record:
    start: int
    end: int
    fields: list[str] = field(default_factory=list)
    error: Broken | None = None


class Records:
    """Recursive descent over ``text``. ``starts``: known places where records start; line breaks between two of them are the record's own."""

    def __init__(self, text: str, columns: int, starts: list[int] | None = None):
        self.text, self.columns, self.starts = text, columns, starts
        self.bare = _BARE_LINE if starts is None else _BARE
        self.found = -1  # the validated anchor found last: no line before it, from where it was searched, is one

    def quoted(self, at: int, stop: int) -> tuple[str, int]:
        m = _QUOTED.match(self.text, at, stop)
        if not m:
            raise Broken(at, NOT_CLOSED)
        return m[1].replace('""', '"'), m.end()

    def field(self, at: int, stop: int) -> tuple[str, int]:
        if self.text.startswith('"', at, stop):
            value, end = self.quoted(at, stop)
            if end < stop and self.text[end] != "," and (self.starts is not None or self.text[end] != "\n"):
                raise Broken(end, "text after a closing quote")
            return value, end
        m = self.bare.match(self.text, at, stop)
        if self.text.startswith('"', m.end(), stop):
            raise Broken(m.end(), "quote inside a bare field")
        return m[0], m.end()

    def fields(self, at: int, stop: int) -> tuple[list[str], int]:
        out = []
        while True:
            value, at = self.field(at, stop)
            out.append(value)
            if not self.text.startswith(",", at, stop):
                return out, at
            at += 1

    def record(self, at: int, stop: int | None = None) -> Record:
        out = Record(at, at)
        try:
            out.fields, out.end = self.fields(at, len(self.text) if stop is None else stop)
        except Broken as e:
            out.error = e
            out.end = self.anchor(at) if stop is None else stop
        return out

    def anchor(self, at: int) -> int:
        """End of a broken record: the newline before the next line start that begins a whole record.

        Searched from the record's start, as a stray quote may seem to close far behind it.
        """
        if self.found < at:
            self.found = next((m.start() for m in _ANCHOR.finditer(self.text, at) if self.starts_record(m.end())), len(self.text))
        return self.found

    def starts_record(self, at: int) -> bool:
        try:
            return len(self.fields(at, len(self.text))[0]) == self.columns
        except Broken:
            return False

    def records(self) -> Iterator[Record]:
        if self.starts is not None:
            for at, after in zip(self.starts, [*self.starts[1:], len(self.text) + 1]):
                yield self.record(at, after - 1)
            return
        at = 0
        while at <= len(self.text):
            r = self.record(at)
            yield r
            at = r.end + 1


# -- the observation listing: obs_id, filters, s_region ------------------------------------------------


def filters_of(value: str) -> list[str] | None:
    """Filter names in upper case, or None."""
    names = [x.strip() for x in value.split(";")]
    if len(names) > 2 or not _FILTER.fullmatch(names[0]):
        return None
    if len(names) == 2 and names[1].upper() != "CLEAR" and not _FILTER.fullmatch(names[1]):
        return None
    return [x.upper() for x in names]


def polygon_of(value: str) -> list[list[float]] | None:
    """Corners of ``POLYGON lon lat lon lat ...``, empty for a blank value, or None."""
    words = value.split()
    if not words:
        return []
    if words[0].upper() != "POLYGON" or len(words) < 7 or len(words) % 2 == 0:
        return None
    if not all(_NUMBER.fullmatch(w) for w in words[1:]):
        return None
    v = [float(w) for w in words[1:]]
    if not all(map(math.isfinite, v)):
        return None
    if not (all(0 <= x <= 360 for x in v[0::2]) and all(-90 <= y <= 90 for y in v[1::2])):
        return None
    return [list(p) for p in zip(v[0::2], v[1::2])]


def typed_observation(r: Record) -> tuple:
    """(obs_id, filters, ring, reason, error_at, message) of a record of the listing."""
    if r.error:
        return None, None, None, "quoting", r.error.at - r.start, r.error.message
    if len(r.fields) != 3:
        return None, None, None, "columns", None, f"{len(r.fields)} fields"
    obs_id, filters, ring = r.fields[0].strip(), filters_of(r.fields[1]), polygon_of(r.fields[2])
    if not obs_id:
        return None, None, None, "obs_id", 0, "blank obs_id"
    if filters is None:
        return obs_id, None, None, "filters", None, "not a filter name"
    if ring is None:
        return obs_id, filters, None, "s_region", None, "not a polygon"
    return obs_id, filters, ring, None, None, None


TYPED = "obs_id string, filters array<string>, ring array<array<double>>, reason string, error_at int, message string"
_TYPED = pa.struct([("obs_id", pa.string()), ("filters", pa.list_(pa.string())), ("ring", pa.list_(pa.list_(pa.float64()))), ("reason", pa.string()), ("error_at", pa.int32()), ("message", pa.string())])


def _struct(rows: list[tuple]) -> pa.Array:
    names = [f.name for f in _TYPED]
    return pa.array([dict(zip(names, r)) for r in rows], _TYPED)


def parsed_rows(rows: DataFrame, id: str, text: str) -> DataFrame:
    """One row per input row, each holding one record: ``id``, the typed fields, and the reason if it failed.

    The rows of a batch are parsed as one text whose anchors are the rows' starts: after a
    broken quote, however far it would run on, parsing resumes at the next row.
    ``reason`` is null for a valid row; else the first that applies of quoting,
    columns, obs_id, filters and s_region, with the place of a broken quote. A null
    text is an empty record (``columns``). Repeated rows come out repeated; other
    columns are left out, so none can clash. An empty table gives no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            starts = [0, *accumulate(len(x) + 1 for x in texts)][: len(texts)]
            typed = _struct([typed_observation(r) for r in Records("\n".join(texts), 3, starts).records()])
            yield pa.RecordBatch.from_arrays([b.column("id"), *typed.flatten()], ["id", *[f.name for f in _TYPED]])

    return rows.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(parse, f"id bigint, {TYPED}")


BLOCK_LINES = 2_000
LOOK_AHEAD = 256
LONGEST = 65_536


def parsed_files(
    lines: DataFrame, file: str, line_no: str, text: str, block_lines: int = BLOCK_LINES, look_ahead: int = LOOK_AHEAD, columns: int = 3, typed: Callable[[Record], tuple] = typed_observation,
    pos: str | None = None, longest: int = LONGEST,
) -> DataFrame:
    """Records of whole files given as physical lines: ``(file_name, first_line, first_pos, n_lines, typed fields, reason, ...)``.

    Lines are in order of ``line_no`` and, within one number, ``pos``. A record may run
    over several lines, and a broken quote may swallow its
    successors: parsing resumes at the next validated record start. Files are split
    into blocks of ``block_lines`` line numbers. A block's first validated anchor ends the
    segment before it and begins its own, so that every line is in one segment and a file
    with a third of all lines is many groups; a block without an anchor stays with the segment
    before it, so a file damaged throughout is one group. A segment sees the ``look_ahead`` lines (counted, whatever their numbers) after its
    end: an anchor found to lie inside a record that begins before it is given up, and the segments
    are read again as one; so they are while a quote is open at the last line seen. A quote open for
    ``longest`` lines or to the file's end is reported as not closed. Null lines count as empty; lines
    without a number have no place in the file and are left out; lines repeated
    under one number and place count once (the smallest).
    """

    def first_anchor(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lines_ = part.sort_values("rank")["line"].tolist()
        p, at, found = Records("\n".join(lines_), columns), 0, None
        for i, x in enumerate(lines_):
            if _START.match(p.text, at) and p.starts_record(at):
                found = i
                break
            at += len(x) + 1
        return pd.DataFrame({"file": [key[0]], "block": [key[1]], "size": [len(lines_)], "anchor": pd.array([found], "Int64")})

    def parse(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        lines_, nums, places, own = part["line"].tolist(), part["n"].to_numpy(), part["pos"].to_numpy(), int(part["own"].sum())
        ends = len(lines_) - own < look_ahead
        starts = np.r_[0, np.cumsum([len(x) + 1 for x in lines_])]
        text = "\n".join(lines_)
        until = int(starts[own])
        line_of = lambda at: int(starts[:-1].searchsorted(at, "right")) - 1
        p, at, out = Records(text, columns), 0, []
        while at < until:
            r = p.record(at)
            first, last = line_of(at), line_of(r.end)
            if r.error:
                r.end = min(r.end, until - 1)
                last = line_of(r.end)
                if r.error.message == NOT_CLOSED and not ends and len(lines_) - first < longest:
                    last = len(lines_) - 1  # not decided yet: the starts seen are given up
            out.append((key[0], int(nums[first]), int(places[first]), text.count("\n", at, r.end) + 1, *typed(r), key[1] + first, key[1] + last, last >= own))
            at = r.end + 1
        names = ["file_name", "first_line", "first_pos", "n_lines", *[f.name for f in _TYPED], "i0", "i1", "over"]
        return pd.DataFrame(out, columns=names).astype({"error_at": "Int32"})

    n, place = F.col(line_no).cast("bigint"), F.lit(0).cast("bigint") if pos is None else F.coalesce(F.col(pos).cast("bigint"), F.lit(0))
    rows = lines.select(F.col(file).cast("string").alias("file"), n.alias("n"), place.alias("pos"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("line")).filter(F.col("n").isNotNull())
    rows = rows.groupBy("file", "n", "pos").agg(F.min("line").alias("line")).withColumn("block", F.floor(F.col("n") / block_lines).cast("bigint"))
    rows = written(rows.withColumn("rank", F.row_number().over(Window.partitionBy("file", "block").orderBy("n", "pos")) - 1), "lines")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").applyInPandas(first_anchor, "file string, block bigint, size bigint, anchor bigint")
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    blocks = written(blocks.select("file", "block", "offset", F.when(F.col("offset") == 0, F.lit(0)).otherwise(F.col("offset") + F.col("anchor")).alias("start")), "blocks")
    while True:
        near = Window.partitionBy("file").orderBy("block").rowsBetween(-look_ahead, 0)
        b = blocks.withColumn("prev", F.last("start", ignorenulls=True).over(before))
        ends = F.collect_list(F.when(F.col("start").isNotNull() & F.col("prev").isNotNull(), F.struct(F.col("prev").alias("seg"), F.col("start").alias("end")))).over(near)
        b = b.withColumn("ends", F.filter(ends, lambda e: e["end"] + look_ahead > F.col("offset")))
        b = b.select(F.col("file").alias("f"), F.col("block").alias("k"), "offset", "start", "prev", "ends")
        at = rows.join(b, F.col("file").eqNullSafe(F.col("f")) & (F.col("block") == F.col("k"))).withColumn("i", F.col("offset") + F.col("rank"))
        mine = F.struct(F.when(F.col("i") >= F.col("start"), F.col("start")).otherwise(F.col("prev")).alias("seg"), F.lit(True).alias("own"))
        seen = F.transform(F.filter("ends", lambda e: (e["end"] <= F.col("i")) & (F.col("i") < e["end"] + look_ahead)), lambda e: F.struct(e["seg"].alias("seg"), F.lit(False).alias("own")))
        at = at.select("file", "n", "pos", "line", "i", F.explode(F.concat(F.array(mine), seen)).alias("s")).select("file", "n", "pos", "line", "i", "s.seg", "s.own")
        out = written(at.groupBy("file", "seg").applyInPandas(parse, f"file_name string, first_line bigint, first_pos bigint, n_lines int, {TYPED}, i0 bigint, i1 bigint, over boolean"), "records")
        over = out.filter("over").select("file_name", "i0", "i1")
        if over.isEmpty():
            return out.drop("i0", "i1", "over")
        inside = blocks.join(over, F.col("file").eqNullSafe(F.col("file_name")) & (F.col("start") > F.col("i0")) & (F.col("start") <= F.col("i1")), "left_semi").select(F.col("file").alias("f"), F.col("block").alias("k"), F.lit(True).alias("gone"))
        on = F.col("file").eqNullSafe(F.col("f")) & (F.col("block") == F.col("k"))
        blocks = written(blocks.join(inside, on, "left").select("file", "block", "offset", F.when(F.col("gone").isNull(), F.col("start")).alias("start")), "blocks")
