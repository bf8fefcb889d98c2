"""Motions per star, straight or of any degree in time: weighted regressions over grouped sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.common import finite


def line_fit(df: DataFrame, by: list[str], x: str, y: str, sigma: str | None = None, absolute_sigma: bool = True) -> DataFrame:
    """(by..., slope, intercept, slope_err, intercept_err, chi2, n) of y over x with weights 1/sigma^2.

    Errors from the covariance, scaled by the root of chi2/(n - 2) without ``absolute_sigma``. NULL where the line isn't determined.
    """
    w = 1 / (F.col(sigma) * F.col(sigma)) if sigma else F.lit(1.0)
    good = df.select(*by, finite(x).alias("_x"), finite(y).alias("_y"), finite(w).alias("_w")).where("_x is not null and _y is not null and _w is not null")
    centre = Window.partitionBy(*by)
    good = good.withColumn("_c", F.sum(F.col("_w") * F.col("_x")).over(centre) / F.sum("_w").over(centre)).withColumn("_d", F.col("_x") - F.col("_c"))
    s = good.groupBy(*by).agg(
        F.count("*").alias("n"), F.first("_c").alias("c"), F.sum("_w").alias("s"), F.sum(F.col("_w") * F.col("_y")).alias("sy"),
        F.sum(F.col("_w") * F.col("_d") * F.col("_d")).alias("sdd"), F.sum(F.col("_w") * F.col("_d") * F.col("_y")).alias("sdy"),
        F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("syy")
    )
    slope = F.when((F.col("n") >= 2) & (F.col("sdd") > 1e-12 * F.col("s")), F.col("sdy") / F.col("sdd"))
    mean = F.col("sy") / F.col("s")
    out = s.withColumns(
        {"slope": slope, "intercept": mean - slope * F.col("c"), "chi2": F.greatest(F.col("syy") - F.col("sy") * mean - slope * F.col("sdy"), F.lit(0.0))}
    )
    scale = F.lit(1.0) if absolute_sigma else F.when(F.col("n") > 2, F.sqrt(F.col("chi2") / (F.col("n") - 2)))
    return out.select(
        *by, "slope", "intercept", (F.sqrt(1 / F.col("sdd")) * scale).alias("slope_err"),
        (F.sqrt(1 / F.col("s") + F.col("c") * F.col("c") / F.col("sdd")) * scale).alias("intercept_err"),
        F.when(slope.isNotNull(), F.col("chi2")).alias("chi2"), "n"
    )


def line_chi2(df: DataFrame, by: list[str], x: str, y: str, sigma: str, slope: Column, intercept: Column) -> DataFrame:
    """(by..., chi2) of given lines."""
    r = (F.col(y) - slope * F.col(x) - intercept) / F.col(sigma)
    return df.groupBy(*by).agg(F.sum(r * r).alias("chi2"))


def fit_velocities(
    obs: DataFrame, weighting: str = "var", absolute_sigma: bool = True, fixed_t0: DataFrame | None = None, mask_lists: list[int] | None = None,
    all_detected: int | None = None, compat: bool = False
) -> DataFrame:
    """(star_id, x0, x0e, vx, vxe, y0, ..., t0, n_vfit, chi2_vx, chi2_vy): each star's motion.

    obs: star_id, list_id, t, x, y, xe, ye. An epoch without an error gets the mean error of the star's others (1 if there
    are none). t0 is the mean time, weighted by 1/hypot(xe, ye), unless ``fixed_t0`` (star_id, t0) gives it. Without two
    different times the place is a weighted mean and the motion 0; of two epochs it is exact, with no error of its own. A star with no
    usable epoch gets NULLs. ``all_detected`` keeps to stars with so many usable epochs. ``compat`` lets y share x's weights in the mean.
    """
    if weighting not in ("var", "std"):
        raise ValueError("weighting: var or std")
    by_star = Window.partitionBy("star_id")
    cols = {c: finite(c) for c in ("t", "x", "y")}
    for c in ("xe", "ye"):
        e = F.when(finite(c) != 0, F.abs(finite(c))) if c in obs.columns else F.lit(1.0)
        cols[c] = e
    rows = obs.select("star_id", "list_id", *(v.alias(k) for k, v in cols.items()))
    if mask_lists:
        rows = rows.where(~F.col("list_id").isin(mask_lists))
    stars = obs.select("star_id").distinct()
    if all_detected is None:
        rows = rows.withColumns({c: F.coalesce(c, F.avg(F.when(F.col("x").isNotNull(), F.col(c))).over(by_star), F.lit(1.0)) for c in ("xe", "ye")})
    good = rows.where(" and ".join(f"{c} is not null" for c in ("t", "x", "y", "xe", "ye")))
    wt = 1 / F.sqrt(F.col("xe") * F.col("xe") + F.col("ye") * F.col("ye"))
    own = F.sum(F.col("t") * wt).over(by_star) / F.sum(wt).over(by_star)
    if fixed_t0 is not None:
        good = good.join(fixed_t0.select("star_id", F.col("t0").alias("_t0")), "star_id", "left").withColumn("t0", F.coalesce("_t0", own)).drop("_t0")
    else:
        good = good.withColumn("t0", own)
    good = good.withColumn("d", F.col("t") - F.col("t0"))
    aggs = [F.count("*").alias("n"), F.first("t0").alias("t0"), (F.max("t") - F.min("t")).alias("range")]
    for c in "xy":
        e = F.col(f"{c}e")
        s2 = e * e if weighting == "var" else e
        w, m = 1 / s2, 1 / (e * e if weighting == "var" else e)
        v, d = F.col(c), F.col("d")
        aggs += [
            F.sum(w).alias(f"s{c}"), F.sum(w * d).alias(f"sd{c}"), F.sum(w * d * d).alias(f"sdd{c}"), F.sum(w * v).alias(f"sv{c}"),
            F.sum(w * d * v).alias(f"sdv{c}"), F.sum(m).alias(f"m{c}"), F.sum(m * v).alias(f"mv{c}")
        ]
        aggs += [F.max_by(v, "t").alias(f"last{c}"), F.min_by(v, "t").alias(f"first{c}")]
    g = good.groupBy("star_id").agg(*aggs)
    flat = F.col("range") <= 1e-9
    two = (F.col("n") == 2) & ~flat
    for c in "xy":
        det = F.col(f"sdd{c}") * F.col(f"s{c}") - F.col(f"sd{c}") * F.col(f"sd{c}")
        slope = (F.col(f"s{c}") * F.col(f"sdv{c}") - F.col(f"sd{c}") * F.col(f"sv{c}")) / det
        at = (F.col(f"sdd{c}") * F.col(f"sv{c}") - F.col(f"sd{c}") * F.col(f"sdv{c}")) / det
        mean = F.col(f"mv{c}") / F.col(f"m{c}")
        g = g.withColumns(
            {
                f"v{c}": F.when(flat, 0.0).when(two, (F.col(f"last{c}") - F.col(f"first{c}")) / F.col("range")).otherwise(slope),
                f"{c}0": F.when(flat | two, mean).otherwise(at), f"det{c}": det
            }
        )
    # residuals about the fit, from the sums' own rows: exact where the sums would cancel
    back = good.join(g.select("star_id", "vx", "vy", "x0", "y0"), "star_id")
    sums = []
    for c in "xy":
        e = F.col(f"{c}e")
        r = F.col(c) - F.col(f"{c}0") - F.col(f"v{c}") * F.col("d")
        s2 = e * e if weighting == "var" else e
        m = 1 / (F.col("xe") * F.col("xe") if weighting == "var" else F.col("xe")) if compat and c == "y" else 1 / s2
        sums += [F.sum(r * r / s2).alias(f"chi{c}"), F.sum(m * r * r).alias(f"ss{c}"), F.sum(m).alias(f"sm{c}")]
    g = g.join(back.groupBy("star_id").agg(*sums), "star_id")
    out = {}
    for c in "xy":
        scale = F.lit(1.0) if absolute_sigma else F.sqrt(F.col(f"chi{c}") / (F.col("n") - 2))
        out |= {
            f"{c}0": F.col(f"{c}0"),
            f"{c}0e": F.when(flat, F.sqrt(F.col(f"ss{c}") / F.col(f"sm{c}"))).when(
                two, F.abs(F.col(f"last{c}") - F.col(f"first{c}")) / F.sqrt(F.lit(2.0))
            ).otherwise(F.sqrt(F.col(f"sdd{c}") / F.col(f"det{c}")) * scale),
            f"v{c}": F.col(f"v{c}"),
            f"v{c}e": F.when(flat | two, 0.0).otherwise(F.sqrt(F.col(f"s{c}") / F.col(f"det{c}")) * scale),
            f"chi2_v{c}": F.when(flat, 0.0).otherwise(F.col(f"chi{c}")),
        }
    fit = g.select("star_id", *(v.alias(k) for k, v in out.items()), "t0", F.col("n").alias("n_vfit"))
    if all_detected is not None:
        fit = fit.where(F.col("n_vfit") >= all_detected)
    return stars.join(fit, "star_id", "left").fillna(0, ["n_vfit"])


def fit_complete(obs: DataFrame, lists: list[int], weighting: str = "var", absolute_sigma: bool = True) -> DataFrame:
    """As ``fit_velocities`` over the chosen lists, of the stars with a usable reading in each of them; the other stars get NULLs."""
    fit = fit_velocities(obs.where(F.col("list_id").isin(lists)), weighting, absolute_sigma, all_detected=len(set(lists)))
    return obs.select("star_id").distinct().join(fit, "star_id", "left").fillna(0, ["n_vfit"])


def bootstrap_velocities(obs: DataFrame, n_boot: int, seed: int = 11, weighting: str = "var", fixed_t0: DataFrame | None = None) -> DataFrame:
    """(star_id, x0e_boot, y0e_boot, vxe_boot, vye_boot): spreads of motions fitted to epochs drawn with replacement.

    The draws come from hashes of (seed, star, draw), so they are the same however the rows lie. Each star's readings are gathered once
    and all its draws are fitted in Arrow batches by the rules of ``fit_velocities``, whose rows would be n_boot times as many.
    """
    if weighting not in ("var", "std"):
        raise ValueError("weighting: var or std")
    cols = ("t", "x", "y", "xe", "ye")
    value = {c: finite(c) for c in cols[:3]} | {c: F.when(finite(c) != 0, F.abs(finite(c))) if c in obs.columns else F.lit(1.0) for c in cols[3:]}
    one = F.struct("list_id", *(value[c].alias(c) for c in cols))
    # NULLs as NaN: unusable readings are drawn like others
    stars = obs.groupBy("star_id").agg(F.array_sort(F.collect_list(one)).alias("r")).select(
        "star_id", F.xxhash64(F.lit(seed), "star_id").alias("h"),
        *(F.transform(F.col(f"r.{c}"), lambda v: F.coalesce(v, F.lit(float("nan")))).alias(c) for c in cols)
    )
    if fixed_t0 is not None:
        stars = stars.join(fixed_t0.select("star_id", finite("t0").alias("t0")), "star_id", "left")
    else:
        stars = stars.withColumn("t0", F.lit(None).cast("double"))
    names = ("x0e_boot", "y0e_boot", "vxe_boot", "vye_boot")
    schema = T.StructType([stars.schema["star_id"], *(T.StructField(n, T.DoubleType()) for n in names)])
    return stars.mapInPandas(_drawn(n_boot, weighting, names), schema)


def _drawn(n_boot: int, weighting: str, names: tuple[str, ...]):
    """The spreads of each star's motions over its draws; stars with equally many readings are fitted together."""
    power = 2 if weighting == "var" else 1

    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def fitted(t, x, y, xe, ye, t0):
        """x0, y0, vx, vy of draws (along the last axis); t0 NaN where it isn't fixed."""
        known = ~np.isnan(x)
        for e in (xe, ye):
            have = known & ~np.isnan(e)
            mean = np.where(have, e, 0.0).sum(-1) / np.maximum(have.sum(-1), 1)
            np.copyto(e, np.where(have.any(-1), mean, 1.0)[..., None], where=np.isnan(e))
        good = ~(np.isnan(t) | np.isnan(x) | np.isnan(y))
        n = good.sum(-1)
        wt = good / np.hypot(xe, ye)
        t = np.where(good, t, 0.0)
        own = (t * wt).sum(-1) / wt.sum(-1)
        d = t - np.where(np.isnan(t0), own, t0)[..., None]
        late, early = np.where(good, t, -np.inf), np.where(good, t, np.inf)
        last, first = late.argmax(-1)[..., None], early.argmin(-1)[..., None]
        span = np.where(n > 0, late.max(-1) - early.min(-1), 0.0)
        flat = span <= 1e-9
        two = (n == 2) & ~flat
        places, motions = [], []
        for v, e in ((x, xe), (y, ye)):
            w, v = good / e**power, np.where(good, v, 0.0)
            s, sd, sdd, sv, sdv = w.sum(-1), (w * d).sum(-1), (w * d * d).sum(-1), (w * v).sum(-1), (w * d * v).sum(-1)
            det = sdd * s - sd * sd
            ends = (np.take_along_axis(v, last, -1) - np.take_along_axis(v, first, -1))[..., 0] / span
            motions.append(np.where(n == 0, np.nan, np.where(flat, 0.0, np.where(two, ends, (s * sdv - sd * sv) / det))))
            places.append(np.where(flat | two, sv / s, (sdd * sv - sd * sdv) / det))
        return *places, *motions

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            sizes = p["t"].map(len).to_numpy()
            out = np.full((len(p), 4), np.nan)
            for n in np.unique(sizes[sizes > 0]):
                every = np.flatnonzero(sizes == n)
                step = max(1, 1_000_000 // int(n * n_boot))
                for lo in range(0, len(every), step):
                    q = every[lo : lo + step]
                    h = p["h"].to_numpy()[q].astype(np.int64).view(np.uint64)[:, None, None]
                    place = np.arange(n_boot, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(n, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
                    pick = (mix(mix(h) + place) % np.uint64(n)).astype(np.int64)
                    drawn = (np.take_along_axis(np.array(p[c].iloc[q].tolist(), dtype=float)[:, None, :], pick, -1) for c in ("t", "x", "y", "xe", "ye"))
                    t0 = pd.to_numeric(p["t0"].iloc[q]).to_numpy(float)[:, None]
                    with np.errstate(all="ignore"):
                        for k, v in enumerate(fitted(*drawn, t0)):
                            have = ~np.isnan(v)
                            m = np.where(have, v, 0.0).sum(-1) / have.sum(-1)
                            out[q, k] = np.sqrt(np.where(have, (v - m[:, None]) ** 2, 0.0).sum(-1) / have.sum(-1))
            yield pd.DataFrame({"star_id": p["star_id"], **{name: pd.array(np.where(np.isnan(c), None, c), dtype="Float64") for name, c in zip(names, out.T)}})

    return run


def polynomial_motion(obs: DataFrame, degree: int) -> DataFrame:
    """(star_id, t0, n, dof, px, pxe, chi2x, py, pye, chi2y): x and y of each star as polynomials in t - t0, the constant first.

    obs: star_id, t, x, y, xe, ye. Weights 1/sigma^2, errors from the covariance scaled by chi2/dof; t0 and missing errors as in
    ``fit_velocities``. NULL where the times don't determine the polynomial, errors NULL also without a degree of freedom.
    """
    if degree < 0:
        raise ValueError("degree: 0 or more")
    by_star = Window.partitionBy("star_id")
    rows = obs.select("star_id", *(finite(c).alias(c) for c in ("t", "x", "y")), *(F.when(finite(c) != 0, F.abs(finite(c))).alias(c) for c in ("xe", "ye")))
    rows = rows.withColumns({c: F.coalesce(c, F.avg(F.when(F.col("x").isNotNull(), F.col(c))).over(by_star), F.lit(1.0)) for c in ("xe", "ye")})
    wt = 1 / F.sqrt(F.col("xe") * F.col("xe") + F.col("ye") * F.col("ye"))
    good = rows.where("t is not null and x is not null and y is not null").withColumn("t0", F.sum(F.col("t") * wt).over(by_star) / F.sum(wt).over(by_star))
    good = good.withColumn("d", F.col("t") - F.col("t0"))
    # powers of times within [-1, 1]
    half = F.max(F.abs("d")).over(by_star)
    good = good.withColumn("half", F.when(half > 0, half).otherwise(1.0))
    u = [F.pow(F.col("d") / F.col("half"), F.lit(k)) for k in range(2 * degree + 1)]
    aggs = [F.count("*").alias("n"), F.first("t0").alias("t0"), F.first("half").alias("half")]
    for c in "xy":
        w = 1 / (F.col(f"{c}e") * F.col(f"{c}e"))
        aggs += [F.array(*(F.sum(w * p) for p in u)).alias(f"s{c}"), F.array(*(F.sum(w * p * F.col(c)) for p in u[: degree + 1])).alias(f"b{c}")]
    sums = good.groupBy("star_id").agg(*aggs)
    many = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [
            sums.schema["star_id"], T.StructField("t0", T.DoubleType()), T.StructField("n", T.LongType()),
            *(T.StructField(f"{a}{c}", many) for c in "xy" for a in "pv")
        ]
    )
    found = sums.mapInPandas(_solved(degree), schema)
    # chi squares from the residuals: exact where the sums would cancel
    back = good.join(found.select("star_id", "px", "py"), "star_id")
    chi = []
    for c in "xy":
        r = (F.col(c) - F.aggregate(F.reverse(f"p{c}"), F.lit(0.0), lambda v, p: v * F.col("d") + p)) / F.col(f"{c}e")
        chi.append(F.sum(r * r).alias(f"chi2{c}"))
    fit = found.join(back.groupBy("star_id").agg(*chi), "star_id").withColumn("dof", F.col("n") - (degree + 1))
    error = lambda c: F.when(F.col("dof") > 0, F.transform(f"v{c}", lambda v: F.sqrt(v * F.col(f"chi2{c}") / F.col("dof")))).alias(f"p{c}e")
    fit = fit.select("star_id", "t0", "n", "dof", *(e for c in "xy" for e in (f"p{c}", error(c), f"chi2{c}")))
    return obs.select("star_id").distinct().join(fit, "star_id", "left").fillna(0, ["n"])


def _solved(degree: int):
    """Coefficients and the diagonal of the inverse normal matrix of each star, NULL where that has none."""
    at = np.add.outer(np.arange(degree + 1), np.arange(degree + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = p[["star_id", "t0", "n"]].copy()
            scale = p["half"].to_numpy()[:, None] ** np.arange(degree + 1)
            for c in "xy":
                a = np.array(p[f"s{c}"].tolist()).reshape(len(p), 2 * degree + 1)[:, at]
                b = np.array(p[f"b{c}"].tolist()).reshape(len(p), degree + 1)
                size = a[:, 0, 0][:, None]
                a, b = a / size[:, :, None], b / size
                value, vector = np.linalg.eigh(a)
                ok = (value[:, 0] > 1e-13 * value[:, -1]) & (p["n"].to_numpy() > degree)
                inv = np.einsum("sik,sk,sjk->sij", vector, 1 / np.where(ok[:, None], value, 1.0), vector)
                coef = np.einsum("sij,sj->si", inv, b) / scale
                var = np.einsum("sii->si", inv) / size / scale**2
                out[f"p{c}"] = [list(v) if k else None for v, k in zip(coef, ok)]
                out[f"v{c}"] = [list(v) if k else None for v, k in zip(var, ok)]
            yield out

    return run
