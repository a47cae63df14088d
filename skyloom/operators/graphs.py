"""Match graphs: connected groups, edges between visits and their least-squares solution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import written


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)``: each node of the edges with the smallest node that it is linked to.

    The graph is contracted round by round: a label points to the smallest label within two
    links (so that the arms of a star meet in one round), pointers are followed to their
    ends, and links within a label vanish. The tables of a round are written, so no lineage
    grows. A node linked only to itself is its own root; null ends are left out.
    """
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = e.unionAll(e.select("v", "u"))
    roots = both.groupBy("u").agg(F.lit(1)).select(F.col("u").alias("node"), F.col("u").alias("root"))
    links = written(both.filter("u <> v").distinct(), "links")
    while not links.isEmpty():  # every round at least halves the labels that have links
        one = links.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("t"))
        two = links.join(one.select(F.col("u").alias("v"), "t"), "v").groupBy("u").agg(F.least(F.first("u"), F.min("t")).alias("t"))
        to, ended = written(two, "labels"), False
        while not ended:
            far = to
            for _ in range(3):  # each step doubles the hops
                far = far.join(far.select(F.col("u").alias("t"), F.col("t").alias("far")), "t").select("u", F.col("far").alias("t"))
            far = written(far, "labels")
            ended = not far.join(far.select(F.col("u").alias("t"), F.col("t").alias("far")), "t").filter("far <> t").limit(1).count()
            to = far
        moved = links.join(to, "u").select("v", F.col("t").alias("a")).join(to.withColumnRenamed("u", "v"), "v").select(F.col("a").alias("u"), F.col("t").alias("v"))
        roots = written(roots.join(to.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("t", "root").alias("root")), "roots")
        links = written(moved.filter("u <> v").distinct(), "links")
    return roots


def pair_edges(shifts: DataFrame, least: int = 20, sigma: float = 3.0) -> DataFrame:
    """Edges from differences ``(grp, a, b, dx, dy)``: clipped once per axis at ``sigma`` scaled MADs, medians, and the sum of plain MADs.

    Pairs of under ``least`` differences, before or after clipping, are left out. A MAD of zero clips nothing.
    """
    w = Window.partitionBy("grp", "a", "b")
    s = shifts
    for c in ("dx", "dy"):
        s = s.withColumn(f"m{c}", F.median(c).over(w)).withColumn(f"s{c}", 1.4826 * F.median(F.abs(F.col(c) - F.col(f"m{c}"))).over(w))
    inside = lambda c: (F.col(f"s{c}") == 0) | (F.abs(F.col(c) - F.col(f"m{c}")) <= sigma * F.col(f"s{c}"))
    s = s.withColumn("n_all", F.count("*").over(w)).filter((F.col("n_all") >= least) & inside("dx") & inside("dy"))
    s = s.withColumn("kx", F.median("dx").over(w)).withColumn("ky", F.median("dy").over(w))
    e = s.groupBy("grp", "a", "b").agg(
        F.count("*").alias("n"), F.first("kx").alias("dx"), F.first("ky").alias("dy"),
        (F.median(F.abs(F.col("dx") - F.col("kx"))) + F.median(F.abs(F.col("dy") - F.col("ky")))).alias("mad"),
    )
    return e.filter(F.col("n") >= least)


def edge_weight(n: str = "n", mad: str = "mad"):
    """Weight of an edge in the normal equations."""
    return F.sqrt(F.greatest(F.col(n), F.lit(1))) / F.greatest(F.col(mad), F.lit(0.05))


def visit_shifts(edges: DataFrame, gauge: object = None, sharpest: float = 0.2) -> DataFrame:
    """Per ``grp`` the node corrections ``(grp, node, dx, dy, residual_rms, gauge, is_consensus)`` that best explain its edges.

    Weighted least squares over rows ``b - a``, each edge by ``edge_weight``; a correction is the
    negated shift. The origin is no result of the edges: the ``gauge`` node, or each group's
    smallest node, stays where it is (0, 0). A gauge that a group's edges do not name is an error.
    ``residual_rms`` is the weighted rms of an axis. ``is_consensus``: while over three nodes
    are left, the one furthest from the mean of those left by more than max(3 rms,
    ``sharpest``) is set aside; this tells of displaced nodes only and moves none.

    Edges are summed up per pair of nodes first, so a group handed to one task is one row a pair of visits of a field.
    """
    w = edge_weight()
    dx, dy = F.col("dx"), F.col("dy")
    pairs = edges.filter("a <> b").groupBy("grp", "a", "b").agg(F.sum(w).alias("w"), F.sum(w * dx).alias("wx"), F.sum(w * dy).alias("wy"), F.sum(w * (dx * dx + dy * dy)).alias("ww"))
    kind = edges.schema["a"].dataType.simpleString()

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*p["a"], *p["b"]})
        if gauge is not None and gauge not in nodes:
            raise ValueError(f"gauge {gauge} is not among the nodes {nodes}")
        at = {v: i for i, v in enumerate(nodes)}
        a, b = p["a"].map(at).to_numpy(), p["b"].map(at).to_numpy()
        m, r = np.zeros((len(nodes), len(nodes))), np.zeros((len(nodes), 2))
        for i, j, sign in ((a, a, 1), (b, b, 1), (a, b, -1), (b, a, -1)):
            np.add.at(m, (i, j), sign * p["w"].to_numpy())
        z = p[["wx", "wy"]].to_numpy()
        np.add.at(r, b, z)
        np.add.at(r, a, -z)
        t = np.linalg.pinv(m, hermitian=True) @ r
        left = p["ww"].sum() - 2 * (t * r).sum() + (t * (m @ t)).sum()
        rms = float(np.sqrt(max(0.0, left) / p["w"].sum() / 2))
        stay = list(range(len(nodes)))
        while len(stay) > 3:
            off = np.hypot(*(t[stay] - t[stay].mean(0)).T)
            if off.max() <= max(3 * rms, sharpest):
                break
            stay.pop(int(off.argmax()))
        pinned = nodes[0] if gauge is None else gauge
        t = t[at[pinned]] - t
        return pd.DataFrame({"grp": p["grp"].iloc[0], "node": nodes, "dx": t[:, 0], "dy": t[:, 1], "residual_rms": rms, "gauge": pinned, "is_consensus": [i in stay for i in range(len(nodes))]})

    return pairs.groupBy("grp").applyInPandas(solve, f"grp string, node {kind}, dx double, dy double, residual_rms double, gauge {kind}, is_consensus boolean")


def brightest_separated(stars: DataFrame, separation: float, count: int | None = None) -> DataFrame:
    """``(grp, id, x, y, flux)`` of each group's stars, brightest first, that have no brighter accepted one closer than ``separation``; the first ``count`` of them.

    Equally bright stars go by id. The walk down the brightness order is a fixed point over close pairs, found round
    by round: a star is accepted once all brighter neighbours are refused, and refuses its own. No
    group is gathered; neighbours are equi-joins on cells as wide as the separation.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(separation)).cast("bigint")
    s = written(stars.filter("flux IS NOT NULL").select("grp", "id", "x", "y", "flux").dropDuplicates(["grp", "id"]), "stars")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = s.select("grp", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("flux").alias("af"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = s.select("grp", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("y_"), F.col("flux").alias("bf"), cell("x").alias("bcx"), cell("y").alias("bcy"), F.explode(around).alias("o"))
    b = b.withColumn("cx", F.col("bcx") + F.col("o.i")).withColumn("cy", F.col("bcy") + F.col("o.j"))
    brighter = (F.col("bf") > F.col("af")) | ((F.col("bf") == F.col("af")) & (F.col("b") < F.col("a")))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("y_")) * (F.col("ay") - F.col("y_"))
    open_ = written(a.join(b, ["grp", "cx", "cy"]).filter((F.col("a") != F.col("b")) & brighter & (d2 < separation * separation)).select("grp", "a", "b"), "close")
    refused = None
    while not open_.isEmpty():
        # brighter stars that nothing refuses any more
        waiting = open_.select("grp", "a").distinct()
        sure = open_.join(waiting.withColumnRenamed("a", "b"), ["grp", "b"], "left_anti")
        out = written(sure.select("grp", "a").distinct(), "refused")
        refused = out if refused is None else refused.unionByName(out)
        rest = open_.join(out, ["grp", "a"], "left_anti").join(out.withColumnRenamed("a", "b"), ["grp", "b"], "left_anti")
        open_ = written(rest, "close")
    kept = s if refused is None else s.join(refused.withColumnRenamed("a", "id"), ["grp", "id"], "left_anti")
    if count is None:
        return kept
    w = Window.partitionBy("grp").orderBy(F.desc("flux"), "id")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= count).drop("rank")
