"""Fit quality and residual diagnostics: the numbers behind the plots, as tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.common import exact_median, finite
from skyloom.functions.models import Transform

# --- pairs: x, y, m, xe, ye (transformed list) against x_ref, y_ref, m_ref, xe_ref, ye_ref


def _errors(errs: str) -> tuple[Column, Column]:
    sq = lambda c: F.col(c) * F.col(c)
    if errs == "both":
        return F.sqrt(sq("xe") + sq("xe_ref")), F.sqrt(sq("ye") + sq("ye_ref"))
    if errs == "reference":
        return F.col("xe_ref"), F.col("ye_ref")
    if errs == "starlist":
        return F.col("xe"), F.col("ye")
    raise ValueError("errs: both, reference or starlist")


def residuals(pairs: DataFrame) -> DataFrame:
    """dx, dy, dm: reference minus list."""
    return pairs.withColumns({f"d{c}": F.col(f"{c}_ref") - F.col(c) for c in "xym"})


def alignment_chi2(pairs: DataFrame, model: Transform | int, errs: str = "both", by: list[str] | None = None) -> DataFrame:
    """(by..., chi2, n, dof, red_chi2) of matched positions under a model with so many free parameters."""
    k = model if isinstance(model, int) else n_parameters(model)
    sx, sy = _errors(errs)
    d = residuals(pairs).withColumns({"_c": (F.col("dx") / sx) ** 2 + (F.col("dy") / sy) ** 2}).where(F.col("_c").isNotNull())
    out = d.groupBy(*(by or [])).agg(F.sum("_c").alias("chi2"), F.count("*").alias("n"))
    return out.withColumn("dof", 2 * F.col("n") - k).withColumn("red_chi2", F.when(F.col("dof") > 0, F.col("chi2") / F.col("dof")))


def n_parameters(model: Transform) -> int:
    """Free parameters of a model: 4 of a similarity, (order + 1)(order + 2) of a polynomial."""
    if model.kind == "four_paramNW":
        return 4
    if model.kind == "Shift":
        return 2
    if model.kind == "PolyTransform":
        return (model.order + 1) * (model.order + 2)
    raise ValueError(f"no count for {model.kind}")


def _betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if i and abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def f_test(red_chi2_1: float, red_chi2_2: float, v1: int, v2: int) -> tuple[float, float]:
    """(F, p): the ratio of two reduced chi squares and the chance of a larger one."""
    f = red_chi2_1 / red_chi2_2
    return f, 1 - _betainc(v1 / 2, v2 / 2, v1 * f / (v1 * f + v2))


def histogram(df: DataFrame, col: str, width: float, low: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """(by..., bin, low, n): counts per bin of a given width; missing values have none."""
    v = finite(col)
    return df.where(v.isNotNull()).groupBy(
        *(by or []), F.floor((v - low) / width).cast("long").alias("bin")
    ).agg(F.count("*").alias("n")).withColumn("low", low + F.col("bin") * width)


def histogram_n(df: DataFrame, col: str, nbins: int) -> DataFrame:
    """(bin, low, n): counts in ``nbins`` even bins from the least to the greatest value, which falls in the last."""
    v = finite(col)
    ends = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    j = df.crossJoin(F.broadcast(ends)).where(v.isNotNull())  # one row
    width = (F.col("_hi") - F.col("_lo")) / nbins
    b = F.when(width > 0, F.least(F.lit(nbins - 1), F.floor((v - F.col("_lo")) / width))).otherwise(0).cast("long")
    return j.groupBy(b.alias("bin"), (F.col("_lo") + b * width).alias("low")).agg(F.count("*").alias("n"))


def error_ratios(pairs: DataFrame, errs: str = "both", outlier: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Residuals over errors (rx, ry, inlier) and their statistics with and without outliers."""
    sx, sy = _errors(errs)
    r = residuals(pairs).withColumns({"rx": F.col("dx") / sx, "ry": F.col("dy") / sy}).where("rx is not null and ry is not null")
    r = r.withColumn("inlier", (F.abs("rx") < outlier) & (F.abs("ry") < outlier))
    c = F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry")
    return r, r.agg(
        F.count("*").alias("n"), F.sum(c).alias("chi2"), F.sum(F.col("inlier").cast("int")).alias("n_in"),
        F.sum(F.when(F.col("inlier"), c)).alias("chi2_in")
    )


def tagged_positions(a: DataFrame, b: DataFrame, matches: DataFrame) -> DataFrame:
    """All rows of both lists with their source and whether they are matched."""
    mark = lambda df, side, src: df.select("id", "x", "y").join(
        matches.select(F.col(side).alias("id")).distinct().withColumn("matched", F.lit(True)), "id", "left"
    ).select(F.lit(src).alias("source"), "id", "x", "y", F.coalesce("matched", F.lit(False)).alias("matched"))
    return mark(a, "id_1", "reference").unionByName(mark(b, "id_2", "list"))


def velocity_ratios(pairs: DataFrame, scale: float | None = None) -> DataFrame:
    """Differences of velocities and over their joint errors; ``scale`` multiplies the differences and their errors alike."""
    k, out = 1.0 if scale is None else float(scale), {}
    for c in "xy":
        d, e = F.col(f"v{c}_ref") - F.col(f"v{c}"), F.sqrt(F.col(f"v{c}e") ** 2 + F.col(f"v{c}e_ref") ** 2)
        out |= {f"dv{c}": d * k, f"dv{c}e": e * k, f"rv{c}": d / F.when(e > 0, e)}
    return pairs.withColumns(out)


def residual_arrows(pairs: DataFrame, outlier: float | None = None, errs: str | None = None) -> DataFrame:
    """The residuals at the reference's places; those of |d| below ``outlier`` alone, in errors where ``errs`` names them."""
    r = residuals(pairs)
    if outlier is not None:
        r = r.where((F.abs("dx") < outlier) & (F.abs("dy") < outlier))
    if errs is not None:
        sx, sy = _errors(errs)
        r = r.withColumns({"dx": F.col("dx") / F.when(sx > 0, sx), "dy": F.col("dy") / F.when(sy > 0, sy)})
    return r.where("dx is not null and dy is not null")


def velocity_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """The velocities of both lists (id, vx, vy), told apart by ``source``."""
    part = lambda df, src: df.select(
        F.lit(src).alias("source"), "id", finite("vx").alias("vx"), finite("vy").alias("vy")
    ).where("vx is not null and vy is not null")
    return part(a, "reference").unionByName(part(b, "list"))


def proper_motions(stars: DataFrame, scale: float = 1e3) -> DataFrame:
    """Each star's motion, scaled."""
    return stars.where(finite("vx").isNotNull() & finite("vy").isNotNull()).select(
        "star_id", (finite("vx") * scale).alias("pm_x"), (finite("vy") * scale).alias("pm_y")
    )


def centred_offsets(sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Places in arcseconds from the mean place, the right ascension shortened by its declination, and motions from the mean motion."""
    c = sources.select(key, *(finite(v).alias(v) for v in ("ra", "dec", "pmra", "pmdec"))).where("ra is not null and dec is not null")
    mean = F.broadcast(c.agg(*(F.avg(v).alias(f"_{v}") for v in ("ra", "dec", "pmra", "pmdec"))))  # one row
    at = c.crossJoin(mean)
    turn = F.pmod(F.col("ra") - F.col("_ra") + 180, F.lit(360.0)) - 180
    return at.select(
        key, (turn * F.cos(F.radians("_dec")) * 3600).alias("dx"), ((F.col("dec") - F.col("_dec")) * 3600).alias("dy"),
        (F.col("pmra") - F.col("_pmra")).alias("dpm_x"), (F.col("pmdec") - F.col("_pmdec")).alias("dpm_y")
    )


# --- stars and their readings


def modelled(obs: DataFrame, stars: DataFrame) -> DataFrame:
    """Readings with the star's motion: dx, dy (reading minus model), dm, the model's error and the ratios."""
    keep = [c for c in ("x0", "y0", "m0", "vx", "vy", "t0", "x0e", "y0e", "vxe", "vye", "m0e") if c in stars.columns]
    j = obs.join(stars.select("star_id", *(finite(c).alias(c) for c in keep)), "star_id")
    dt = finite("t") - F.col("t0")
    out = {}
    for c in "xy":
        v = F.coalesce(F.col(f"v{c}"), F.lit(0.0)) if f"v{c}" in keep else F.lit(0.0)
        out[f"d{c}"] = finite(c) - (F.col(f"{c}0") + v * dt)
        if f"{c}0e" in keep and f"v{c}e" in keep:
            out[f"model_{c}e"] = F.sqrt(F.col(f"{c}0e") ** 2 + (F.coalesce(F.col(f"v{c}e"), F.lit(0.0)) * dt) ** 2)
        if f"{c}e" in obs.columns:
            out[f"sig_{c}"] = out[f"d{c}"] / F.when(finite(f"{c}e") > 0, finite(f"{c}e"))
    if "m0" in keep:
        out["dm"] = finite("m") - F.col("m0")
        if "me" in obs.columns:
            out["sig_m"] = out["dm"] / F.when(finite("me") > 0, finite("me"))
    return j.withColumns(out)


def residuals_by_epoch(m: DataFrame) -> DataFrame:
    """(list_id, n, mean and population spread of |dx|, |dy|, |dm|) over detected stars."""
    seen = m.where(finite("x").isNotNull())
    aggs = [f(F.abs(F.col(f"d{c}"))).alias(f"d{c}_{n}") for c in "xym" for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return seen.groupBy("list_id").agg(F.count("*").alias("n"), *aggs)


def quiver(m: DataFrame, scale: float = 1e3) -> DataFrame:
    """(list_id, star_id, x, y, dx, dy, dr) of the residuals, scaled."""
    return m.where("dx is not null and dy is not null").select(
        "list_id", "star_id", "x", "y", (F.col("dx") * scale).alias("dx"), (F.col("dy") * scale).alias("dy"),
        (F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) * scale).alias("dr")
    )


def quiver_statistics(m: DataFrame, reference: str = "use_in_trans", scale: float = 1e3) -> DataFrame:
    """(list_id, kind, n, mean and population spread of dx and dy, scaled): ``GOOD`` of all stars with residuals, ``REF`` of the flagged ones."""
    good = m.where("dx is not null and dy is not null").withColumn(
        "kind", F.explode(F.when(F.coalesce(F.col(reference), F.lit(False)), F.array(F.lit("GOOD"), F.lit("REF"))).otherwise(F.array(F.lit("GOOD"))))
    )
    aggs = [f(F.col(f"d{c}") * scale).alias(f"d{c}_{n}") for c in "xy" for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return good.groupBy("list_id", "kind").agg(F.count("*").alias("n"), *aggs)


def residuals_of_detected(m: DataFrame, n_detect: int) -> DataFrame:
    """Residual, error and ratio of every reading of the stars with exactly so many detections."""
    good = m.where("sig_x is not null and sig_y is not null")
    stars = good.groupBy("star_id").agg(F.count("*").alias("n_detect")).where(F.col("n_detect") == n_detect).select("star_id")
    return good.join(stars, "star_id", "left_semi").select("star_id", "list_id", "dx", "dy", "xe", "ye", "sig_x", "sig_y")


def several_alignments(parts: dict[str, DataFrame], turn: float, scale: float = 0.04) -> DataFrame:
    """The residuals of several alignments in the original frame, under their names."""
    out = None
    for name, m in parts.items():
        one = original_frame(m, turn, scale).withColumn("alignment", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no alignment")
    return out


def by_time(obs: DataFrame) -> DataFrame:
    """Each star's readings numbered by time, those without one last."""
    return obs.withColumn("n", F.row_number().over(Window.partitionBy("star_id").orderBy(finite("t").asc_nulls_last(), "list_id")))


def mean_residual_per_star(m: DataFrame) -> DataFrame:
    """(star_id, n, dr_mean) over a star's epochs."""
    dr = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    return m.where(dr.isNotNull()).groupBy("star_id").agg(F.count("*").alias("n"), F.avg(dr).alias("dr_mean"))


def chi2_per_star(m: DataFrame) -> DataFrame:
    """(star_id, n_detect, chi2_x, chi2_y, dof): of the readings about the motion."""
    good = m.where("sig_x is not null and sig_y is not null")
    return good.groupBy("star_id").agg(
        F.count("*").alias("n_detect"), F.sum(F.col("sig_x") ** 2).alias("chi2_x"), F.sum(F.col("sig_y") ** 2).alias("chi2_y")
    ).withColumn("dof", F.col("n_detect") - 2)


def chi2_medians(per_star: DataFrame, n_detect: int | None = None) -> DataFrame:
    """Medians of the reduced chi squares (of stars with so many detections)."""
    s = per_star.where(F.col("dof") > 0)
    s = s.where(F.col("n_detect") == n_detect) if n_detect else s
    out = s.agg(F.count("*").alias("n"))  # one row each
    for c in "xy":
        out = out.join(F.broadcast(exact_median(s, [], F.col(f"chi2_{c}") / F.col("dof"), f"red_chi2_{c}")), how="left", on=F.lit(True))
    return out


def chi2_mag_per_star(m: DataFrame, compat: bool = False) -> DataFrame:
    """(star_id, n_detect, chi2_m, red_chi2_m); dof n - 1, n - 2 with ``compat``."""
    g = m.where("sig_m is not null").groupBy("star_id").agg(F.count("*").alias("n_detect"), F.sum(F.col("sig_m") ** 2).alias("chi2_m"))
    dof = F.col("n_detect") - (2 if compat else 1)
    return g.withColumn("red_chi2_m", F.when(dof > 0, F.col("chi2_m") / dof))


def sigma_flags(m: DataFrame, limit: float = 4.0) -> DataFrame:
    """Readings more than ``limit`` errors off their star's motion, by field."""
    hit = F.array_compact(F.array(*(F.when(F.abs(F.col(f"sig_{c}")) > limit, F.lit(c)) for c in "xym")))
    return m.select("star_id", "list_id", F.explode(hit).alias("field"))


def radial_tangential(m: DataFrame) -> DataFrame:
    """Each reading's residual along and across the direction from the origin to its star, with the errors of both where x and y have errors."""
    r0 = F.sqrt(F.col("x0") ** 2 + F.col("y0") ** 2)
    out = [
        ((F.col("dx") * F.col("x0") + F.col("dy") * F.col("y0")) / r0).alias("d_r"),
        ((F.col("dx") * F.col("y0") - F.col("dy") * F.col("x0")) / r0).alias("d_t")
    ]
    if {"xe", "ye"} <= set(m.columns):
        along = lambda a, b: F.sqrt((F.col("xe") * F.col(a)) ** 2 + (F.col("ye") * F.col(b)) ** 2) / r0
        out += [along("x0", "y0").alias("d_r_err"), along("y0", "x0").alias("d_t_err")]
    return m.where(r0 > 0).select("star_id", "list_id", *out)


def angle_of(x: Column, y: Column) -> Column:
    """The direction of (x, y) in degrees within (-180, 180]."""
    return F.degrees(F.atan2(y, x))


def rotation_of(model: Transform) -> float:
    """The turn of a first-order model in degrees."""
    p = dict(model.px)
    return math.degrees(math.atan2(-p.get((0, 1), 0.0), p.get((1, 0), 1.0)))


def rotated(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x * c - y * s, x * s + y * c


def original_frame(m: DataFrame, turn: float, scale: float = 0.04) -> DataFrame:
    """Residuals turned back by ``turn`` degrees and in pixels of ``scale``, with their direction within [0, 360) and length."""
    dx, dy = F.col("dx") / scale, F.col("dy") / scale
    rx, ry = rotated(dx, dy, -turn)
    return m.where("dx is not null and dy is not null").select(
        "star_id", "list_id", "m", rx.alias("dx_orig"), ry.alias("dy_orig"), F.pmod(angle_of(dx, dy) - turn, F.lit(360.0)).alias("angle"),
        F.sqrt(dx * dx + dy * dy).alias("modulus")
    )


def errors_by_magnitude(stars: DataFrame) -> DataFrame:
    """Per star its radius, magnitude and mean errors of place and motion (in thousandths)."""
    e = lambda a, b: (F.col(a) + F.col(b)) / 2 * 1e3
    return stars.select(
        "star_id", "m0", F.sqrt(F.col("x0") ** 2 + F.col("y0") ** 2).alias("r"), e("x0e", "y0e").alias("pos_err"), e("vxe", "vye").alias("pm_err")
    )


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept) of y over x."""
    return df.agg(F.regr_slope(finite(y), finite(x)).alias("slope"), F.regr_intercept(finite(y), finite(x)).alias("intercept"))


def power_trend(df: DataFrame, m: str, d: str, faint: float, bins: int = 200) -> tuple[float, float, float, float]:
    """(A, m0, alpha, m1) of d = m1 + A sign(m/m0) |m/m0|^alpha for magnitudes beyond ``faint``.

    Fitted by Gauss and Newton to means in ``bins`` bins, so the driver sees those only; m0 is their mean magnitude, as A takes up its scale.
    """
    v = finite(m)
    good = df.select(v.alias("m"), finite(d).alias("d")).where((F.col("m") > faint) & F.col("d").isNotNull())
    ends = good.agg(F.min("m"), F.max("m")).first()
    if ends[0] is None or ends[0] == ends[1]:
        raise ValueError("too few magnitudes for a trend")
    width = (ends[1] - ends[0]) / bins
    rows = good.groupBy(F.floor((F.col("m") - ends[0]) / width).alias("b")).agg(F.avg("m").alias("m"), F.avg("d").alias("d"), F.count("*").alias("n")).collect()
    x, y, n = (np.array([r[c] for r in rows], float) for c in ("m", "d", "n"))
    m0 = float((x * n).sum() / n.sum())
    best = None
    for alpha in np.linspace(0.25, 40, 160):  # linear in A and m1 for a given alpha
        f = np.sign(x / m0) * np.abs(x / m0) ** alpha
        a = np.c_[f, np.ones_like(f)] * np.sqrt(n)[:, None]
        c, *_ = np.linalg.lstsq(a, y * np.sqrt(n), rcond=None)
        cost = float((((a @ c) - y * np.sqrt(n)) ** 2).sum())
        if best is None or cost < best[0]:
            best = (cost, c[0], alpha, c[1])
    return float(best[1]), m0, float(best[2]), float(best[3])


def sky_view(obs: DataFrame, m_lim: tuple[float, float] | None = None) -> DataFrame:
    """Readings with real positions, within magnitudes."""
    seen = obs.where((finite("x") > -1000) & (finite("y") > -1000))
    return seen.where((F.col("m") > m_lim[0]) & (F.col("m") < m_lim[1])) if m_lim else seen


def in_box(df: DataFrame, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    """Names and places within a closed box."""
    return df.where(F.col("x").between(*x) & F.col("y").between(*y))


def epochs_of(obs: DataFrame) -> DataFrame:
    """Distinct finite times."""
    return obs.select(finite("t").alias("t")).where("t is not null").distinct()
