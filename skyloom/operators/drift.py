"""Schemas that drift between the files of a series: one union table and a log of every change.

File headers are read in parallel into (file, field, types) rows and folded in
Spark: within a file through a type-promotion lattice, over the files of a series in
the order they were produced. Only fields that come or go are looked up by value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import written

INTEGER, NUMBER, BOOLEAN, STRING = 1, 2, 4, 8
NAMES = {0: "none", INTEGER: "integer", NUMBER: "number", BOOLEAN: "boolean", STRING: "string"}


def promoted(mask: Column) -> Column:
    """Join of the types in ``mask``: integer below number; anything mixed otherwise, a string."""
    m = F.when(mask.isin(0, INTEGER, NUMBER, BOOLEAN), mask).when(mask == INTEGER + NUMBER, F.lit(NUMBER))
    return m.otherwise(F.lit(STRING))


class _Int(str):
    """A JSON integer's own spelling."""


class _Num(str):
    """A JSON number with point or exponent in its own spelling."""


_DECODER = json.JSONDecoder(parse_int=_Int, parse_float=_Num, parse_constant=lambda name: None if name == "NaN" else _Num(name.replace("Infinity", "inf")))


def _decoded(text: str | None) -> dict | None:
    try:
        found = _DECODER.decode(text) if text else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _number(text: str) -> str | None:
    try:
        return repr(float(text) + 0.0)
    except ValueError:
        return None


def _typed(v: object) -> tuple[int, str | None, str | None]:
    """(type, spelling, comparable value): numbers compare as numbers, however they are spelled."""
    if v is None:
        return 0, None, None
    if isinstance(v, _Int):
        return INTEGER, str(v), _number(v)
    if isinstance(v, _Num):
        return NUMBER, str(v), _number(v)
    if isinstance(v, bool):
        return BOOLEAN, str(v).lower(), "b:" + str(v).lower()
    if isinstance(v, str):
        n = _number(v) if v.strip() else None
        return (0, None, None) if n == "nan" else (STRING, v, n or "s:" + v)
    text = json.dumps(v, sort_keys=True, ensure_ascii=False)
    return STRING, text, "s:" + text


LONG = "series string, file string, produced timestamp, grp string, id bigint, field string, type int, value string, same string"


def fields_of(records: DataFrame, series: str, file: str, produced: str, group: str, id: str, payload: str) -> DataFrame:
    """One row per field of each record's JSON object (bare NaN allowed).

    Null and NaN have type 0 and no value; a nested value counts as a string. A
    payload that is null, not JSON or no object has no fields. A name that one
    object holds twice counts with its last value.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, names, types, values, same = [], [], [], [], []
            for i, text in enumerate(b.column("payload").to_pylist()):
                for name, v in (_decoded(text) or {}).items():
                    t, spelling, s = _typed(v)
                    at.append(i)
                    names.append(name)
                    types.append(t)
                    values.append(spelling)
                    same.append(s)
            own = b.select(["series", "file", "produced", "grp", "id"]).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names, pa.string()), pa.array(types, pa.int32()), pa.array(values, pa.string()), pa.array(same, pa.string())], [x.split()[0] for x in LONG.split(", ")])

    rows = records.select(
        F.col(series).cast("string").alias("series"), F.col(file).cast("string").alias("file"), F.col(produced).cast("timestamp").alias("produced"),
        F.col(group).cast("string").alias("grp"), F.col(id).cast("bigint").alias("id"), F.col(payload).cast("string").alias("payload"),
    )
    return rows.filter(F.col("series").isNotNull() & F.col("file").isNotNull()).mapInArrow(read, LONG)


def headers_of(long: DataFrame) -> DataFrame:
    """One row per file: ``header`` maps each field to its type, folded through the lattice."""
    fields = long.groupBy("series", "file", "field").agg(F.max("produced").alias("produced"), F.bit_or("type").alias("mask"))
    return fields.groupBy("series", "file").agg(F.max("produced").alias("produced"), F.map_from_entries(F.collect_list(F.struct("field", promoted(F.col("mask")).alias("type")))).alias("header"))


def with_previous(files: DataFrame, slab: str = "hour") -> DataFrame:
    """Adds ``previous_file`` and ``before`` (its header) in the order (produced, file) of each series.

    Ordered within slabs of time; a slab's first file follows the last one of the slab
    before it. A series with a third of all files is thus many windows, and the
    window over slabs has one row a slab.
    """
    key = F.struct("produced", "file")
    slabs = files.withColumn("slab", F.date_trunc(slab, "produced"))
    w = Window.partitionBy("series", "slab").orderBy("produced", "file")
    inner = slabs.withColumn("p", F.lag(F.struct("file", "header")).over(w))
    ends = slabs.groupBy("series", "slab").agg(F.max_by(F.struct("file", "header"), key).alias("end"))
    ends = ends.select("series", "slab", F.lag("end").over(Window.partitionBy("series").orderBy("slab")).alias("end"))
    on = (inner["series"] == ends["series"]) & inner["slab"].eqNullSafe(ends["slab"])
    joined = inner.join(ends, on, "left").select(inner["series"], inner["file"], inner["produced"], inner["header"], F.coalesce("p", "end").alias("p"))
    return joined.select("series", "file", "produced", "header", F.col("p.file").alias("previous_file"), F.col("p.header").alias("before"))


def changes_of(long: DataFrame, share: float = 0.5) -> DataFrame:
    """``(series, file, produced, previous_file, field_name, old_name, change_kind, old_type, new_type)``.

    Each file against the one before it in its series (by produced time, nulls
    first, then name). ``renamed``: a name goes, another comes, and of
    the groups with a value of both at least ``share`` keep the same value. Where
    several pairs qualify, the one with the larger share, then more groups, then
    smaller names is taken first, each name once. ``added``, ``removed``: the others.
    ``type``: a field kept or renamed changes its type; a file in which a field
    has no value has no type for it. The first file of a series and an empty table
    have no changes. Repeated rows and rows of a group with several values count
    once per value.
    """
    files = written(with_previous(written(headers_of(long), "headers")).filter(F.col("previous_file").isNotNull()), "files")
    files = files.withColumn("came", F.array_except(F.map_keys("header"), F.map_keys("before"))).withColumn("went", F.array_except(F.map_keys("before"), F.map_keys("header")))

    pairs = files.filter((F.size("came") > 0) & (F.size("went") > 0)).select("series", "file", "previous_file", "came", "went")
    pairs = pairs.withColumn("new", F.explode("came")).withColumn("old", F.explode("went")).select("series", "file", "previous_file", "new", "old")
    # values are looked up only for names that come or go
    values = long.filter(F.col("same").isNotNull() & F.col("grp").isNotNull()).select("series", "file", "field", "grp", "same")
    olds = pairs.select("series", "file", F.col("previous_file").alias("in_file"), "old", "new").join(values.select("series", F.col("file").alias("in_file"), F.col("field").alias("old"), "grp", F.col("same").alias("old_value")), ["series", "in_file", "old"]).drop("in_file").distinct()
    news = values.withColumnsRenamed({"field": "new", "same": "new_value"}).join(pairs.select("series", "file", "new").distinct(), ["series", "file", "new"], "left_semi").distinct()
    both = olds.join(news, ["series", "file", "new", "grp"])
    kept = both.groupBy("series", "file", "old", "new", "grp").agg(F.max((F.col("old_value") == F.col("new_value")).cast("int")).alias("eq"))
    scored = kept.groupBy("series", "file", "old", "new").agg(F.count("*").alias("n"), F.avg("eq").alias("share")).filter(F.col("share") >= share)
    # best pair first, each name once: a fold over the few candidates of one file
    ranked = scored.groupBy("series", "file").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("a"), (-F.col("n")).alias("b"), "old", "new"))).alias("c"))
    none = F.array().cast("array<struct<old:string,new:string>>")
    taken = F.aggregate("c", none, lambda acc, x: F.when(F.exists(acc, lambda y: (y["old"] == x["old"]) | (y["new"] == x["new"])), acc).otherwise(F.array_append(acc, F.struct(x["old"].alias("old"), x["new"].alias("new")))))
    renames = ranked.select("series", "file", taken.alias("renames"))

    f = files.join(renames, ["series", "file"], "left").withColumn("renames", F.coalesce("renames", none))
    event = lambda kind, new, old, told, tnew: F.struct(F.lit(kind).alias("change_kind"), new.alias("field_name"), old.alias("old_name"), told.alias("old_type"), tnew.alias("new_type"))
    nothing, no_type = F.lit(None).cast("string"), F.lit(None).cast("int")
    new_names, old_names = F.transform("renames", lambda r: r["new"]), F.transform("renames", lambda r: r["old"])
    renamed = F.transform("renames", lambda r: event("renamed", r["new"], r["old"], F.col("before")[r["old"]], F.col("header")[r["new"]]))
    added = F.transform(F.array_except("came", new_names), lambda x: event("added", x, nothing, no_type, F.col("header")[x]))
    removed = F.transform(F.array_except("went", old_names), lambda x: event("removed", x, nothing, F.col("before")[x], no_type))
    stayed = F.transform(F.array_intersect(F.map_keys("header"), F.map_keys("before")), lambda x: event("type", x, nothing, F.col("before")[x], F.col("header")[x]))
    retyped = F.filter(F.concat(stayed, F.transform(renamed, lambda r: event("type", r["field_name"], r["old_name"], r["old_type"], r["new_type"]))), lambda r: (r["old_type"] != r["new_type"]) & (r["old_type"] > 0) & (r["new_type"] > 0))
    out = f.select("series", "file", "produced", "previous_file", F.explode(F.concat(renamed, added, removed, retyped)).alias("e"))
    name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return out.select("series", "file", "produced", "previous_file", "e.field_name", "e.old_name", "e.change_kind", name[F.col("e.old_type")].alias("old_type"), name[F.col("e.new_type")].alias("new_type"))


def consistent(long: DataFrame, changes: DataFrame) -> DataFrame:
    """Every value under its field's first name in the series: ``(series, file, produced, grp, id, field_name, number, text)``.

    A field keeps the name it had before its renames, and has one type over all files of its
    series: it is a number (in ``number``) where some value is a JSON number and every value, string or
    not, reads as one; else a text (in ``text``, as it was spelled). ``united`` casts
    by the types alone. Repeated rows come out once.
    """
    rows = written(_named(long, changes), "named")
    reads = ~F.col("same").startswith("b:") & ~F.col("same").startswith("s:")
    folded = rows.groupBy("series", "field_name").agg((F.bool_and(reads) & F.bool_or(F.col("type").isin(INTEGER, NUMBER))).alias("is_number"))
    return rows.join(folded, ["series", "field_name"]).select(
        "series", "file", "produced", "grp", "id", "field_name", F.when(F.col("is_number"), F.col("same").try_cast("double")).alias("number"), F.when(~F.col("is_number"), F.col("value")).alias("text"),
    )


def promotions(long: DataFrame, changes: DataFrame) -> DataFrame:
    """The union schema: ``(series, field_name, type, seen, n_names, n_files, is_promoted)`` of every field under its first name.

    The types of all files of a series folded through ``promoted``; ``seen`` lists the types that its
    files have, in order, ``n_names`` the names it goes by. ``is_promoted`` where the union's type is not that of every file.
    """
    per_file = _named(long, changes).groupBy("series", "field_name", "file", "field").agg(F.bit_or("type").alias("mask"))
    folded = per_file.groupBy("series", "field_name").agg(
        promoted(F.bit_or("mask")).alias("t"), F.array_sort(F.collect_set(promoted(F.col("mask")))).alias("each"), F.count_distinct("field").alias("n_names"), F.count_distinct("file").alias("n_files"),
    )
    name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    seen = F.array_join(F.transform("each", lambda t: name[t]), ",")
    return folded.select("series", "field_name", name[F.col("t")].alias("type"), seen.alias("seen"), "n_names", "n_files", F.exists("each", lambda t: t != F.col("t")).alias("is_promoted"))


def united(long: DataFrame, changes: DataFrame) -> DataFrame:
    """Every value under its field's first name, cast to the field's one type over all files of its series.

    ``(series, file, produced, grp, id, field_name, type, integer, number, boolean, text, spelling)``:
    the types are folded through ``promoted`` over the files; the column of ``type`` holds
    the value, cast from its spelling. An integer field with a value beyond 64 bits is a string.
    Repeated rows come out once.
    """
    rows = written(_named(long, changes), "named")
    beyond = F.bool_or((F.col("type") == INTEGER) & F.col("value").try_cast("bigint").isNull())
    folded = rows.groupBy("series", "field_name").agg(promoted(F.bit_or("type")).alias("t"), beyond.alias("beyond"))
    folded = folded.select("series", "field_name", F.when((F.col("t") == INTEGER) & F.col("beyond"), F.lit(STRING)).otherwise(F.col("t")).alias("t"))
    of = lambda t, kind: F.when(F.col("t") == t, F.col("value").try_cast(kind))
    name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return rows.join(folded, ["series", "field_name"]).select(
        "series", "file", "produced", "grp", "id", "field_name", name[F.col("t")].alias("type"), of(INTEGER, "bigint").alias("integer"), of(NUMBER, "double").alias("number"),
        of(BOOLEAN, "boolean").alias("boolean"), of(STRING, "string").alias("text"), F.col("value").alias("spelling"),
    )


def _named(long: DataFrame, changes: DataFrame) -> DataFrame:
    """The values there are, each row once, with ``field_name``: the name the field had before its renames.

    Names are followed back once for each field of each file, and a file's few changed names joined to its rows.
    """
    moves = changes.filter("change_kind = 'renamed'")
    hops = moves.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("produced", "file", "old_name", "field_name"))).alias("hops"))
    made = F.struct("produced", "file")
    past = F.filter("hops", lambda h: F.struct(h["produced"].alias("produced"), h["file"].alias("file")) <= made)
    back = F.aggregate(F.reverse(past), F.col("field"), lambda acc, h: F.when(h["field_name"] == acc, h["old_name"]).otherwise(acc))
    names = long.groupBy("series", "file", "field").agg(F.max("produced").alias("produced")).join(hops, "series").withColumn("first_name", back)
    names = names.filter("first_name <> field").groupBy("series", "file").agg(F.map_from_entries(F.collect_list(F.struct("field", "first_name"))).alias("names"))
    rows = long.filter(F.col("value").isNotNull()).distinct().join(names, ["series", "file"], "left")
    return rows.withColumn("field_name", F.coalesce(F.try_element_at("names", F.col("field")), "field")).drop("names")
