"""Fitting coordinate models: one aggregate of normal-equation sums per list, a small solve for each on the driver.

Sums are taken on centred and scaled coordinates. As many rows come to the driver as there are lists, whatever the number of stars.
Weights multiply the residuals, so a weight w counts as w squared in the sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.common import checkpointed, finite
from skyloom.functions import models
from skyloom.functions.models import Transform

Fit = dict[tuple, Transform]


def with_weight(pairs: DataFrame, how: str | None) -> DataFrame:
    """Column ``w`` from the errors of both, the reference or the list: inverse variance (``var``) or its root (``std``); 0 where it isn't finite."""
    if how is None:
        return pairs.withColumn("w", F.lit(1.0))
    side, _, kind = how.partition(",")
    sq = lambda c: F.col(c) * F.col(c)
    var = {"both": [sq("xe"), sq("ye"), sq("xe_ref"), sq("ye_ref")], "ref": [sq("xe_ref"), sq("ye_ref")], "list": [sq("xe"), sq("ye")]}[side]
    total = sum(var[1:], var[0])
    w = F.when(total > 0, 1 / (total if kind == "var" else F.sqrt(total)))
    return pairs.withColumn("w", F.coalesce(finite(w), F.lit(0.0)))


def _basis(kind: str, order: int) -> list[tuple[int, int]]:
    return models.legendre_powers(order) if kind == "legendre" else models.powers(order)


def _leg(v: Column, n: int) -> Column:
    c = np.polynomial.legendre.leg2poly([0] * n + [1])
    return models.value({(i, 0): float(x) for i, x in enumerate(c)}, v, F.lit(0.0))


def fit(pairs: DataFrame, order: int = 1, by: list[str] | None = None, kind: str = "poly", mag_trans: bool = True) -> Fit:
    """Transforms from (x, y, m) to (x_ref, y_ref, m_ref) per value of ``by``; with a column ``w`` weighted by it.

    Order 0 is a pure shift. The magnitude offset is the mean of m_ref - m, 0 without ``mag_trans``. A group with fewer
    pairs than coefficients gets the solution of least norm.
    """
    by = by or []
    pairs = pairs if "w" in pairs.columns else pairs.withColumn("w", F.lit(1.0))
    good = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("x_ref").isNotNull() & F.col("y_ref").isNotNull() & (F.col("w") > 0))
    if order == 0 and kind == "poly":
        ww = F.col("w") * F.col("w")
        rows = good.groupBy(*by).agg(
            (F.sum(ww * (F.col("x_ref") - F.col("x"))) / F.sum(ww)).alias("dx"), (F.sum(ww * (F.col("y_ref") - F.col("y"))) / F.sum(ww)).alias("dy"),
            F.avg(F.col("m_ref") - F.col("m")).alias("dm")
        ).collect()
        return {tuple(r[c] for c in by): models.polynomial([r["dx"]], [r["dy"]], (r["dm"] or 0.0) if mag_trans else 0.0) for r in rows if r["dx"] is not None}
    scale = good.groupBy(*by).agg(*(f(F.col(c)).alias(n) for c in "xy" for f, n in ((F.avg, f"_c{c}"), (F.stddev_pop, f"_s{c}"))))
    if kind == "legendre":  # its own domain is [-1, 1]: no conditioning
        scale = scale.withColumns({"_cx": F.lit(0.0), "_cy": F.lit(0.0), "_sx": F.lit(1.0), "_sy": F.lit(1.0)})
    scale = scale.withColumns({s: F.when(F.col(s) > 0, F.col(s)).otherwise(1.0) for s in ("_sx", "_sy")})
    joined = good.join(F.broadcast(scale), by) if by else good.crossJoin(F.broadcast(scale))  # one row a group
    joined = joined.withColumns({"_u": (F.col("x") - F.col("_cx")) / F.col("_sx"), "_v": (F.col("y") - F.col("_cy")) / F.col("_sy")})
    basis = _basis(kind, order)
    one = models.value
    term = (lambda i, j: _leg(F.col("_u"), i) * _leg(F.col("_v"), j)) if kind == "legendre" else (lambda i, j: one({(i, j): 1.0}, F.col("_u"), F.col("_v")))
    joined = joined.withColumns({f"_f{k}": term(i, j) for k, (i, j) in enumerate(basis)})
    ww, n = F.col("w") * F.col("w"), len(basis)
    sums = [F.sum(ww * F.col(f"_f{a}") * F.col(f"_f{b}")).alias(f"a{a}_{b}") for a in range(n) for b in range(a, n)]
    sums += [F.sum(ww * F.col(f"_f{a}") * F.col(c)).alias(f"{c}{a}") for a in range(n) for c in ("x_ref", "y_ref")]
    sums += [F.avg(F.col("m_ref") - F.col("m")).alias("dm"), *(F.first(c).alias(c) for c in ("_cx", "_cy", "_sx", "_sy"))]
    out: Fit = {}
    for r in joined.groupBy(*by).agg(*sums).collect():
        if r["a0_0"] is None:  # no pair at all
            continue
        a = np.array([[r[f"a{min(p, q)}_{max(p, q)}"] for q in range(n)] for p in range(n)])
        cx, cy = (np.linalg.lstsq(a, np.array([r[f"{c}{p}"] for p in range(n)]), rcond=1e-12)[0] for c in ("x_ref", "y_ref"))
        dm = (r["dm"] or 0.0) if mag_trans else 0.0
        if kind == "legendre":
            out[tuple(r[c] for c in by)] = models.legendre(list(cx), list(cy), order, dm)
        else:
            out[tuple(r[c] for c in by)] = models.polynomial(*(_unscale(basis, c, r, order) for c in (cx, cy)), dm)
    return out


def _unscale(basis: list[tuple[int, int]], c: np.ndarray, r, order: int) -> list[float]:
    """Coefficients over x and y from those over the centred, scaled coordinates."""
    x, y = np.polynomial.Polynomial([-r["_cx"] / r["_sx"], 1 / r["_sx"]]), np.polynomial.Polynomial([-r["_cy"] / r["_sy"], 1 / r["_sy"]])
    out = dict.fromkeys(models.powers(order), 0.0)
    for (i, j), v in zip(basis, c):
        for p, a in enumerate((x**i).coef):
            for q, b in enumerate((y**j).coef):
                out[p, q] = out.get((p, q), 0.0) + v * a * b
    return [out[k] for k in models.powers(order)]


def shift_sums(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., dx, dy, dxe, dye, n): the weighted mean shift, its error the weighted spread (without ``w``: the standard error)."""
    by = by or []
    dx, dy = F.col("x_ref") - F.col("x"), F.col("y_ref") - F.col("y")
    if "w" not in pairs.columns:
        n = F.count(dx)
        return pairs.groupBy(*by).agg(
            F.avg(dx).alias("dx"), F.avg(dy).alias("dy"), (F.stddev_samp(dx) / F.sqrt(n)).alias("dxe"), (F.stddev_samp(dy) / F.sqrt(n)).alias("dye"),
            n.alias("n")
        )
    w = F.col("w")
    mean = lambda d: F.sum(w * d) / F.sum(w)
    err = lambda d: F.sqrt(F.greatest(F.lit(0.0), mean(d * d) - mean(d) * mean(d))) / F.sqrt(F.count(d))
    return pairs.groupBy(*by).agg(mean(dx).alias("dx"), mean(dy).alias("dy"), err(dx).alias("dxe"), err(dy).alias("dye"), F.count(dx).alias("n"))


def similarity_sums(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., a0, a1, a2, b0): the least-squares similarity x' = a0 + a1 x + a2 y, y' = b0 - a2 x + a1 y."""
    by = by or []
    mean = {c: F.avg(c) for c in ("x", "y", "x_ref", "y_ref")}
    n = F.count("x")
    s = lambda p, q: F.sum(F.col(p) * F.col(q)) - n * mean[p] * mean[q]
    den = s("x", "x") + s("y", "y")
    a1, a2 = (s("x", "x_ref") + s("y", "y_ref")) / den, (s("y", "x_ref") - s("x", "y_ref")) / den
    return pairs.groupBy(*by).agg(
        (mean["x_ref"] - a1 * mean["x"] - a2 * mean["y"]).alias("a0"), a1.alias("a1"), a2.alias("a2"),
        (mean["y_ref"] + a2 * mean["x"] - a1 * mean["y"]).alias("b0")
    )


def fit_similarity(pairs: DataFrame, by: list[str] | None = None) -> Fit:
    by = by or []
    return {tuple(r[c] for c in by): models.similarity(r["a0"], r["b0"], r["a1"], r["a2"]) for r in similarity_sums(pairs, by).collect() if r["a1"] is not None}


def fit_inverse(pairs: DataFrame, order: int = 1, by: list[str] | None = None) -> Fit:
    """The fit with both sides exchanged."""
    swap = {a: b for p in ("x", "y", "m") for a, b in ((p, f"{p}_ref"), (f"{p}_ref", p))}
    return fit(pairs.withColumnsRenamed({k: f"_{v}" for k, v in swap.items()}).withColumnsRenamed({f"_{v}": v for v in swap.values()}), order, by)


def applied(df: DataFrame, fits: Fit, by: list[str] | None = None, compat: bool = False) -> DataFrame:
    """x, y, m (and xe, ye, vx, ..., with motions also x0, y0, x0e, y0e, where there are) moved by each group's transform; a group without one stays.

    Errors are evaluated at the original place; ``compat`` evaluates them at the moved one.
    """
    by = by or []
    out = df

    def pick(i: int, name: str, model_value) -> Column:
        c = F.col(name)
        for key, t in fits.items():
            is_it = F.lit(True)
            for b, k in zip(by, key):
                is_it = is_it & F.col(b).eqNullSafe(F.lit(k))
            c = F.when(is_it, model_value(t)[i]).otherwise(c)
        return c

    new = {}

    def moved(x: str, y: str, xe: str, ye: str) -> None:
        cx, cy = F.col(x), F.col(y)
        at = (lambda t: t.position(cx, cy)) if compat else (lambda t: (cx, cy))
        for i, c in enumerate((x, y)):
            new[c] = pick(i, c, lambda t: t.position(cx, cy))
        if {xe, ye} <= set(df.columns):
            for i, c in enumerate((xe, ye)):
                new[c] = pick(i, c, lambda t: t.position_error(*at(t), F.col(xe), F.col(ye)))

    moved("x", "y", "xe", "ye")
    if "m" in df.columns:
        new["m"] = pick(0, "m", lambda t: (t.magnitude(F.col("m")),))
    if {"vx", "vy"} <= set(df.columns):
        own = {"x0", "y0"} <= set(df.columns)
        if own:
            moved("x0", "y0", "x0e", "y0e")
        # a motion starts from the place at the reference time where there is one
        x, y, e = (F.col("x0"), F.col("y0"), ("x0e", "y0e")) if own else (F.col("x"), F.col("y"), ("xe", "ye"))
        for i, c in enumerate(("vx", "vy")):
            new[c] = pick(i, c, lambda t: t.velocity(x, y, F.col("vx"), F.col("vy")))
        if {"vxe", "vye", *e} <= set(df.columns):
            for i, c in enumerate(("vxe", "vye")):
                new[c] = pick(i, c, lambda t: t.velocity_error(x, y, F.col("vx"), F.col("vy"), F.col(e[0]), F.col(e[1]), F.col("vxe"), F.col("vye")))
    return out.withColumns(new)


def applied_by_table(df: DataFrame, fits: Fit, by: list[str]) -> DataFrame:
    """x, y, m moved by polynomials that are joined as a small table (one row a group): for many groups."""
    rows = [(*key, *(list(map(float, c)) for c in t.coefficients), float(t.mag_offset)) for key, t in fits.items()]
    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    order = max((t.order for t in fits.values()), default=1)
    table = df.sparkSession.createDataFrame(rows, f"{kinds}, _px array<double>, _py array<double>, _dm double")
    terms = [models.value({k: 1.0}, F.col("x"), F.col("y")) for k in models.powers(order)]
    at = lambda p: sum((F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) * t for i, t in enumerate(terms)), F.lit(0.0))
    moved = {c: F.when(F.col(p).isNull(), F.col(c)).otherwise(at(p)) for c, p in (("x", "_px"), ("y", "_py"))}
    if "m" in df.columns:
        moved["m"] = F.col("m") + F.coalesce("_dm", F.lit(0.0))
    return df.join(F.broadcast(table), by, "left").withColumns(moved).drop("_px", "_py", "_dm")


def fit_clipped(pairs: DataFrame, order: int = 1, by: list[str] | None = None, kind: str = "poly", niter: int = 3, sigma: float = 3.0) -> tuple[Fit, DataFrame]:
    """A fit repeated without the pairs whose residual lies more than ``sigma`` spreads off; with the pairs that stay."""
    by = by or []
    kept = pairs
    fits = fit(kept, order, by, kind)
    for _ in range(niter):
        moved = _residuals(kept, fits, by)
        stats = moved.groupBy(*by).agg(*(g(F.col(f"_d{c}")).alias(f"_{n}{c}") for c in "xy" for g, n in ((F.avg, "m"), (F.stddev_pop, "s"))))
        joined = moved.join(F.broadcast(stats), by) if by else moved.crossJoin(F.broadcast(stats))
        r = F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2)
        centre, spread = F.sqrt(F.col("_mx") ** 2 + F.col("_my") ** 2), F.sqrt(F.col("_sx") ** 2 + F.col("_sy") ** 2)
        kept = checkpointed(joined.where(F.abs(r - centre) <= sigma * spread).select(*pairs.columns))
        fits = fit(kept, order, by, kind)
    return fits, kept


def _residuals(pairs: DataFrame, fits: Fit, by: list[str]) -> DataFrame:
    both = pairs.withColumns({"_x": F.col("x"), "_y": F.col("y")})
    moved = applied_by_table(both, fits, by) if by else applied(both, fits)
    return moved.withColumns({"_dx": F.col("x_ref") - F.col("x"), "_dy": F.col("y_ref") - F.col("y"), "x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y")


def outlier_rejection(pairs: DataFrame, tol: float, by: list[str] | None = None, distance: str | None = None) -> DataFrame:
    """Pairs whose distance from the reference (``distance`` if there is such a column) is below ``tol`` times the distances' population spread (about their own mean)."""
    r = F.col(distance) if distance else F.sqrt((F.col("x_ref") - F.col("x")) ** 2 + (F.col("y_ref") - F.col("y")) ** 2)
    return _rejected(pairs, r, tol, by or [], strict=True)


def _rejected(pairs: DataFrame, r: Column, tol: float, by: list[str], strict: bool) -> DataFrame:
    spread = pairs.groupBy(*by).agg(F.stddev_pop(r).alias("_s"))
    joined = pairs.join(F.broadcast(spread), by) if by else pairs.crossJoin(F.broadcast(spread))  # one row a group
    return joined.where(r < tol * F.col("_s") if strict else r <= tol * F.col("_s")).drop("_s")


def residual_sigma_cut(pairs: DataFrame, k: float, by: list[str] | None = None) -> DataFrame:
    """As outlier_rejection, with the bound itself kept."""
    r = F.sqrt((F.col("x_ref") - F.col("x")) ** 2 + (F.col("y_ref") - F.col("y")) ** 2)
    return _rejected(pairs, r, k, by or [], strict=False)


def monte_carlo_errors(df: DataFrame, model: Transform, n: int = 500, seed: int = 5, key: str = "id") -> DataFrame:
    """(key, x_mc, y_mc): the spread of the transformed place over n draws of the measurement.

    Each row's draws are made and reduced where the row lies, from a generator seeded by the row's own values.
    """
    cols = ("x", "y", "xe", "ye")
    rows = df.select(key, *(finite(c).alias(c) for c in cols)).withColumn("_h", F.xxhash64(F.lit(seed), key, *cols))
    schema = T.StructType([df.schema[key], *(T.StructField(c, T.DoubleType()) for c in ("x_mc", "y_mc"))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                p = b.iloc[lo : lo + 2000]
                x, y, xe, ye = (p[c].to_numpy(float)[:, None] for c in cols)
                draws = np.stack([np.random.default_rng(h).standard_normal((2, n)) for h in p["_h"].to_numpy().astype(np.int64).view(np.uint64)])
                moved = model.position(x + xe * draws[:, 0], y + ye * draws[:, 1])
                yield pd.DataFrame({key: p[key], **{c: v.std(axis=1) for c, v in zip(("x_mc", "y_mc"), moved)}})

    return rows.mapInPandas(run, schema)
