"""Sectioned JSON documents and registration records, which may hold bare NaN."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRATION = """frames array<struct<filename:string,visit:int,exposure:int,detector:string,group_key:string,dx:double,dy:double,background_offset:double,
n_detected:int,n_matched:int,residual_rms_px:double,residual_max_px:double,is_reference:boolean,visit_dx:double,visit_dy:double>>"""


def section(path: str, name: str) -> dict:
    """One top-level section; empty where the file or the section is missing."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f).get(name, {})


def put_section(path: str, name: str, value: dict) -> None:
    """Replaces one section whole and keeps the others; the file changes at once or not at all."""
    whole = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
    whole[name] = value
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(whole, f, indent=2)
    os.replace(f"{path}.tmp", path)


def registration_frames(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of registration documents' ``frames``, a document a file or a line; shifts of visits lacking in older documents are 0, NaN is null."""
    f = spark.read.schema(REGISTRATION).option("multiLine", not lines).json(path).select(F.inline("frames"))
    reals = [c for c, t in f.dtypes if t == "double"]
    f = f.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in reals})
    return f.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("visit_dx", "visit_dy")})


def write_registrations(frames: DataFrame, path: str, *keys: str) -> None:
    """One JSON document a group (of ``keys``, say a visit) and line: its ``frames`` in order of exposure and file name, and their summary.

    A group is one survey's registrations, which a document holds whole. Null and NaN values are left out; ``registration_frames`` with ``lines`` reads the documents.
    """
    columns = [c.split(":")[0] for c in REGISTRATION[REGISTRATION.index("<struct<") + 8 :].replace("\n", "").split(",")]
    reals = {c for c, t in frames.dtypes if t == "double"}
    f = frames.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns if c in reals})
    moved = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    g = f.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("exposure", *[c for c in columns if c != "exposure"]))).alias("frames"), F.count("*").alias("n_frames"), F.avg("n_matched").alias("mean_matched"), F.sqrt(F.avg(moved * moved)).alias("rms_shift_px"),
        F.avg("residual_rms_px").alias("mean_residual_px"), F.max("residual_max_px").alias("max_residual_px"),
    )
    g.write.json(path)


def write_groups(groups: DataFrame, path: str) -> None:
    """Gauge groups or a colour plan, one JSON object a row and line."""
    groups.write.json(path)


def write_grid(cards: DataFrame, path: str) -> None:
    """Grids ``(file_name, card, value)`` as one JSON object a grid. A grid that exists is kept: writing it again is an error."""
    cards.groupBy("file_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("card", "value")))).alias("cards")).write.mode("errorifexists").json(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """``(file_name, card, value)`` of written grids."""
    return spark.read.schema("file_name string, cards map<string,double>").json(path).select("file_name", F.explode("cards").alias("card", "value"))


def with_bands(cube: DataFrame, bands: dict[str, str], scale_arcsec: float) -> DataFrame:
    """``cube`` with each band's channel and the pixel scale in its columns' metadata, which Parquet keeps."""
    return cube.select(
        *[F.col(c).alias(c, metadata={f"BAND{list(bands).index(c) + 1}": bands[c], "PIXSCALE": scale_arcsec}) if c in bands else F.col(c) for c in cube.columns]
    )
