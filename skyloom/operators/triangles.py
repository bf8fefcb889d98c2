"""Blind matching of two catalogs by the triangles of their brightest rows.

Each catalog's N brightest rows give all triangles; a triangle's side ratio and angle don't change under shift, turn and scale. Equal
bins vote for their three pairs of corners. Everything stays in the engine; N bounds the triangles (N = 50: 19,600), not the catalogs.

Defined cases: rows without a place or magnitude are not among the brightest; fewer rows than N give no match; coincident points make no
triangle; ties in brightness go to the lesser key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.common import finite


def ranked(df: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """(by..., id, x, y, r): the n brightest rows of each group with their rank from 1."""
    by = by or []
    good = df.select(
        *by, "id", finite("x").alias("x"), finite("y").alias("y"), finite("m").alias("m")
    ).where("id is not null and x is not null and y is not null and m is not null")
    if not by:
        top = good.orderBy("m", "id").limit(n)
        return top.withColumn("r", F.row_number().over(Window.orderBy("m", "id"))).select("id", "x", "y", "r")
    return good.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("m", "id"))).where(F.col("r") <= n).select(*by, "id", "x", "y", "r")


def triangles(top: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., a, b, c ids by rank, ra, rb, rc, vmax, angle) of all triples of ranked rows."""
    by = by or []
    # a group's N brightest are a small array, from which all triples are dealt out in place
    t = top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("r", "id", "x", "y"))).alias("_top"))
    later = lambda c: F.explode(F.filter("_top", lambda e: e["r"] > F.col(f"{c}.r")))
    t = t.withColumn("_a", F.explode("_top"))
    # few small rows become many here: spread by number, or they would be planned as one task
    t = t.repartition(max(2, t.sparkSession.sparkContext.defaultParallelism), *by, "_a.id")
    t = t.withColumn("_b", later("_a")).withColumn("_c", later("_b")).drop("_top")
    ux, uy, wx, wy = (F.col(f"_{p}.{c}") - F.col(f"_a.{c}") for p in "bc" for c in "xy")
    # each step is generated, so that the next takes its columns and not its expressions, which would multiply
    t = t.withColumn("_s", F.explode(F.array(F.struct(*(v.alias(n) for n, v in zip(("ux", "uy", "wx", "wy"), (ux, uy, wx, wy)))))))
    t = t.select(*by, *(F.col(f"_{p}.id").alias(p) for p in "abc"), *(F.col(f"_{p}.r").alias(f"r{p}") for p in "abc"), "_s.*")
    u2, w2 = F.expr("ux * ux + uy * uy"), F.expr("wx * wx + wy * wy")
    vmax = F.when(u2 < w2, -u2 / w2).otherwise(w2 / u2)
    angle = F.degrees(F.expr("atan2(ux * wx + uy * wy, ux * wy - uy * wx)"))
    found = F.struct(vmax.alias("vmax"), F.when(angle < 0, angle + 360).otherwise(angle).alias("angle"))
    t = t.withColumn("_g", F.explode(F.when((u2 > 0) & (w2 > 0), F.array(found))))
    return t.select(*by, "a", "b", "c", "ra", "rb", "rc", "_g.*")


def bin_edges(bins_vmax: int, bins_angle: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower edges of the bins of vmax in [-1, 1] and of the angle in [0, 360]."""
    # fixed values: the ends and steps of the edges
    return np.arange(-1, 1.01, 2.0 / bins_vmax), np.arange(0, 361, 360.0 / bins_angle)


def digitize(v: Column, edges: np.ndarray) -> Column:
    """How many of evenly spaced edges are at or below a value: the guess by the step, put right by the edges beside it."""
    step, n = float(edges[1] - edges[0]), len(edges)
    first, at = float(edges[0]), lambda i: F.lit(float(edges[0])) + i * F.lit(step)
    if not np.array_equal(edges, first + np.arange(n) * step):
        raise ValueError("the edges must be even")
    guess = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - first) / step))).cast("int")
    up = F.when((guess + 1 < n) & (v >= at(guess + 1)), guess + 2).when(v >= at(guess), guess + 1).otherwise(guess)
    return up.cast("int")


def votes(t1: DataFrame, t2: DataFrame, bins_vmax: int = 200, bins_angle: int = 360, by: list[str] | None = None) -> DataFrame:
    """(by..., id_1, id_2, votes): of each bin the first triangle of list 1 (by ranks) meets every triangle of list 2."""
    by = by or []
    ev, ea = bin_edges(bins_vmax, bins_angle)
    binned = lambda t: t.withColumns({"bv": digitize(F.col("vmax"), ev), "ba": digitize(F.col("angle"), ea)}).where(
        F.col("bv").between(1, len(ev) - 1) & F.col("ba").between(1, len(ea) - 1)
    )
    # ranks as one number, and the corners found again by it: a plain aggregate
    rank = F.col("ra").cast("long") * (1 << 42) + F.col("rb").cast("long") * (1 << 21) + F.col("rc").cast("long")
    ordered = binned(t1).withColumn("_rank", rank)
    least = ordered.groupBy(*by, "bv", "ba").agg(F.min("_rank").alias("_rank"))
    first = ordered.join(least, [*by, "bv", "ba", "_rank"]).select(*by, "bv", "ba", F.struct("a", "b", "c").alias("one"))
    hits = first.join(binned(t2), [*by, "bv", "ba"])
    pairs = hits.select(*by, F.inline(F.array(*(F.struct(F.col(f"one.{k}").alias("id_1"), F.col(k).alias("id_2")) for k in "abc"))))
    return pairs.groupBy(*by, "id_1", "id_2").agg(F.count("*").alias("votes"))


def triangle_match(a: DataFrame, b: DataFrame, n: int = 50, bins_vmax: int = 200, bins_angle: int = 360, by: list[str] | None = None) -> DataFrame:
    """(by..., id_1, id_2, votes): for each row of b the row of a with more than twice the votes of the next."""
    by = by or []
    ra, rb = ranked(a, n, by), ranked(b, n, by)
    enough = (lambda df: df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).drop("_n")) if by else None
    if by:
        ra, rb = ra.join(enough(rb), by, "left_semi"), rb.join(enough(ra), by, "left_semi")
    v = votes(triangles(ra, by), triangles(rb, by), bins_vmax, bins_angle, by)
    w = Window.partitionBy(*by, "id_2").orderBy(F.desc("votes"), "id_1")
    best = v.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("votes").over(w), F.lit(0)))
    out = best.where((F.col("_n") == 1) & (F.col("votes") > 2 * F.col("_next"))).select(*by, "id_1", "id_2", "votes")
    if not by:  # fewer rows than asked for on a side: no match
        both = ra.agg(F.count("*").alias("_na")).crossJoin(rb.agg(F.count("*").alias("_nb"))).where((F.col("_na") >= n) & (F.col("_nb") >= n))
        out = out.join(F.broadcast(both.select(F.lit(1))), how="left_semi", on=F.lit(True))
    return out
