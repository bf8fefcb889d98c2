"""Combining a star's readings over its lists: clipped, weighted means, and the means of stitched frames.

A star has at most one reading a list, so its readings fit in an array; the clip's few rounds then need no further shuffle.
Readings repeated for one (star, list) are first reduced to the one with the least key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.common import finite

FLUX = math.log(10) / 2.5


#: Types whose values an aggregate keeps in place, so that it hashes and needn't sort.
PLAIN = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def distinct_readings(obs: DataFrame, key: str = "obs_id") -> DataFrame:
    """One row for each (star_id, list_id): of repeated ones that with the least key."""
    rest = [c for c in obs.columns if c not in ("star_id", "list_id")]
    order, group = F.coalesce(F.col(key), F.lit(2**62)), obs.groupBy("star_id", "list_id")
    if all(t in PLAIN for c, t in obs.dtypes if c in rest):
        return group.agg(*(F.min_by(c, order).alias(c) for c in rest))
    return group.agg(F.min_by(F.struct(*rest), order).alias("_r")).select("star_id", "list_id", *(F.col(f"_r.{c}").alias(c) for c in rest))


def _median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    at = lambda i: F.get(s, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def _total(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def clip_rounds(readings: Column, sigma: float, rounds: int = 5) -> Column:
    """The structs whose ``v`` survives: within ``sigma`` population spreads of the median, in so many rounds."""

    def once(a: Column) -> Column:
        v = F.transform(a, lambda r: r["v"])
        n = F.size(a)
        mean = _total(v, lambda x: x) / n
        var = _total(v, lambda x: x * x) / n - mean * mean
        stats = F.struct(_median(v).alias("c"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("s"))
        # the statistics are bound once by a one-element transform
        return F.element_at(
            F.transform(
                F.array(stats),
                lambda q: F.filter(a, lambda r: (r["v"] >= q["c"] - sigma * q["s"] - 1e-12) & (r["v"] <= q["c"] + sigma * q["s"] + 1e-12))
            ),
            1
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), readings, lambda a, _: F.when(F.size(a) > 1, once(a)).otherwise(a))


def combine_lists(
    obs: DataFrame, col: str, weights: str | None = None, mask_val: float | None = None, mask_lists: list[int] | None = None, ismag: bool = False,
    sigma: float | None = 3.0
) -> DataFrame:
    """(star_id, <col>0, <col>0e, n): the mean and spread of a column over a star's lists.

    Weighted by inverse square errors if ``weights`` names them; magnitudes are combined as fluxes. A star with one surviving
    weighted reading gets its mean stated error, one with none NULL.
    """
    if mask_lists is not None and not isinstance(mask_lists, list):
        raise TypeError("mask_lists: a list of list ids")
    v = finite(col)
    if mask_val is not None:
        v = F.when(F.abs(v - mask_val) > 1e-8 + 1e-5 * abs(mask_val), v)
    flux, e, w = _terms(v, finite(weights) if weights else None, ismag)
    rows = obs.select("star_id", "list_id", flux.alias("v"), w.alias("w"), e.alias("e"))
    usable = F.col("v").isNotNull() & F.col("w").isNotNull()
    if mask_lists:
        usable = usable & ~F.col("list_id").isin(mask_lists)
    stars = rows.groupBy("star_id").agg(F.collect_list(F.when(usable, F.struct("v", "w"))).alias("a"), F.avg("e").alias("e"))
    if sigma:
        stars = stars.withColumn("a", clip_rounds(F.col("a"), sigma))
    stars = stars.withColumn("mean", _mean(F.col("a"))).withColumn("var", _variance(F.col("a"), F.col("mean")))
    out, err = _told(F.col("a"), F.col("mean"), F.col("var"), F.col("e") if weights else None, ismag)
    return stars.select("star_id", out.alias(f"{col}0"), err.alias(f"{col}0e"), F.size("a").alias("n"))


def _terms(v: Column, error: Column | None, ismag: bool) -> tuple[Column, Column, Column]:
    """Of a reading what is averaged (a magnitude's flux), its error and its weight."""
    flux = F.pow(F.lit(10.0), -v / 2.5) if ismag else v
    if error is None:
        return flux, F.lit(None).cast("double"), F.lit(1.0)
    e = error * flux * FLUX if ismag else error
    return flux, e, F.when(e != 0, 1 / (e * e))


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, _total(a, lambda r: r["w"] * r["v"]) / _total(a, lambda r: r["w"]))


def _variance(a: Column, mean: Column) -> Column:
    return F.when(F.size(a) > 0, _total_with(a, mean) / _total(a, lambda r: r["w"]))


def _told(a: Column, mean: Column, var: Column, e: Column | None, ismag: bool) -> tuple[Column, Column]:
    """The mean and its spread, those of fluxes as magnitudes; of a single reading with an error (``e``) that instead of the spread."""
    err = F.sqrt(F.greatest(var, F.lit(0.0)))
    if e is not None:
        err = F.when(F.size(a) == 1, e).otherwise(err)
    if ismag:
        mean, err = -2.5 * F.log10(mean), err / FLUX / mean
    return mean, F.when(F.size(a) > 0, err)


#: A star's readings so far as a column of the star: what its means and motion take.
HELD = "array<struct<list_id: bigint, t: double, x: double, xe: double, y: double, ye: double, m: double, me: double>>"


def held(df: DataFrame) -> DataFrame:
    """(star_id, readings): the readings of each star in an array."""
    cols = [F.col(c).cast("long" if c == "list_id" else "double").alias(c) for c in ("list_id", "t", "x", "xe", "y", "ye", "m", "me")]
    return df.groupBy("star_id").agg(F.collect_list(F.struct(*cols)).alias("readings"))


def means_of_held(stars: DataFrame, readings: str, weighted: bool, keep_original: bool, sigma: float = 3.0) -> DataFrame:
    """The stars with x0, y0, m0 and their errors combined, as by combine_lists, from an array of readings (HELD); without an array they stay."""

    def terms(c: str) -> Column:
        of = lambda r: _terms(finite(r[c]), finite(r[f"{c}e"]) if weighted else None, c == "m")
        return F.transform(readings, lambda r: F.struct(*(p.alias(n) for p, n in zip(of(r), ("v", "e", "w")))))

    out, errors = stars.withColumns({f"_a{c}": terms(c) for c in "xym"}), {}
    for c in "xym":
        a, e = F.col(f"_a{c}"), F.filter(F.transform(f"_a{c}", lambda r: r["e"]), lambda e: e.isNotNull())
        errors[f"_e{c}"] = F.when(F.size(e) > 0, _total(e, lambda v: v) / F.size(e))
        usable = F.filter(a, lambda r: r["v"].isNotNull() & r["w"].isNotNull())
        errors[f"_a{c}"] = F.transform(usable, lambda r: F.struct(r["v"].alias("v"), r["w"].alias("w")))
    out = out.withColumns(errors)
    out = out.withColumns({f"_a{c}": clip_rounds(F.col(f"_a{c}"), sigma) for c in "xym"})
    out = out.withColumns({f"_m{c}": _mean(F.col(f"_a{c}")) for c in "xym"})
    out = out.withColumns({f"_v{c}": _variance(F.col(f"_a{c}"), F.col(f"_m{c}")) for c in "xym"})
    keep = F.coalesce(F.col("ref_orig"), F.lit(False)) if keep_original else F.lit(False)
    new = {}
    for c in "xym":
        told = _told(*(F.col(f"_{k}{c}") for k in "amv"), F.col(f"_e{c}") if weighted else None, c == "m")
        for name, v in zip((f"{c}0", f"{c}0e"), told):
            new[name] = F.when(keep, F.col(name)).otherwise(F.coalesce(v, F.col(name)))
    return out.select(*(new[c].alias(c) if c in new else c for c in stars.columns))


def _total_with(a: Column, mean: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, r: s + r["w"] * (r["v"] - mean) * (r["v"] - mean))


def combine_lists_xym(
    obs: DataFrame, weighted_xy: bool = True, weighted_m: bool = True, mask_lists: list[int] | None = None, sigma: float | None = 3.0
) -> DataFrame:
    """(star_id, x0, x0e, y0, y0e, m0, m0e)."""
    parts = [
        combine_lists(obs, c, w if on else None, mask_lists=mask_lists, ismag=c == "m", sigma=sigma).drop("n") for c, w,
        on in (("x", "xe", weighted_xy), ("y", "ye", weighted_xy), ("m", "me", weighted_m))
    ]
    return parts[0].join(parts[1], "star_id").join(parts[2], "star_id")


def updated_aggregates(stars: DataFrame, fresh: DataFrame, keep_original: bool) -> DataFrame:
    """The stars' combined columns replaced by fresh ones; those from the reference list keep theirs with ``keep_original``."""
    cols = [c for c in fresh.columns if c != "star_id" and c in stars.columns]
    j = stars.alias("s").join(fresh.alias("f"), "star_id", "left")
    keep = F.coalesce(F.col("ref_orig"), F.lit(False)) if keep_original else F.lit(False)
    new = {c: F.when(keep, F.col(f"s.{c}")).otherwise(F.coalesce(F.col(f"f.{c}"), F.col(f"s.{c}"))) for c in cols}
    return j.select(
        *(new[c].alias(c) if c in new else F.col("star_id") if c == "star_id" else F.col(f"s.{c}") for c in stars.columns),
        *(F.col(f"f.{c}") for c in fresh.columns if c != "star_id" and c not in stars.columns)
    )


def mean_magnitude(obs: DataFrame) -> DataFrame:
    """(star_id, m_avg): the mean in flux."""
    return obs.groupBy("star_id").agg((-2.5 * F.log10(F.avg(F.pow(F.lit(10.0), -finite("m") / 2.5)))).alias("m_avg"))


def stitch_mean(obs: DataFrame, col: str, err: str) -> DataFrame:
    """(star_id, <col>, <col>e): the weighted mean of the frames' values and their spread; a single one with its own error; a star with none is dropped."""
    v, e = finite(col), finite(err)
    w = F.when(v.isNotNull() & (e > 0), 1 / (e * e))
    good = obs.select("star_id", v.alias("v"), e.alias("e"), w.alias("w")).where("w is not null")
    s = good.groupBy("star_id").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("v")).alias("swv"), F.first("e").alias("e1"))
    mean = F.col("swv") / F.col("sw")
    spread = good.join(s.select("star_id", mean.alias("mean")), "star_id").groupBy("star_id").agg(
        F.sum(F.col("w") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("ss")
    )
    out = s.join(spread, "star_id")
    return out.select("star_id", mean.alias(col), F.when(F.col("n") == 1, F.col("e1")).otherwise(F.sqrt(F.col("ss") / F.col("sw"))).alias(f"{col}e"))


def plain_mean(obs: DataFrame, col: str) -> DataFrame:
    """(star_id, <col>): the mean of the frames that have a value."""
    return obs.groupBy("star_id").agg(F.avg(finite(col)).alias(col))
