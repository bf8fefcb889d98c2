"""From the sphere to a local plane: catalogs about a point, at an epoch, within a cone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.common import finite
from skyloom.operators.neighbours import great_circle


def parse_angle(text: str, hours: bool = False) -> float:
    """Degrees from sexagesimal (blanks, colons or letters between the parts) or decimal text."""
    parts = text.strip().lower()
    sign = -1.0 if parts.startswith("-") else 1.0
    for c in "hdms:°'\"":
        parts = parts.replace(c, " ")
    nums = [abs(float(p)) for p in parts.split()]
    if not nums:
        raise ValueError(f"no angle in {text!r}")
    value = sum(n / 60**i for i, n in enumerate(nums[:3]))
    return sign * value * (15.0 if hours and len(nums) > 1 else 1.0)


def cone(df: DataFrame, ra: float, dec: float, radius_arcsec: float, limit: int | None = 50_000, key: str = "source_id") -> DataFrame:
    """Rows within a radius of a point, with ``dist`` in degrees; the nearest ``limit`` of them."""
    r = radius_arcsec / 3600
    near = df.where(F.abs(finite("dec") - dec) <= r).withColumn(
        "dist", great_circle(finite("ra"), finite("dec"), F.lit(float(ra)), F.lit(float(dec)))
    ).where(F.col("dist") <= r)
    return near.orderBy("dist", key).limit(limit) if limit else near


def _plane(ra: float, dec: float):
    cos = math.cos(math.radians(dec))
    turn = F.pmod(finite("ra") - ra + 180, F.lit(360.0)) - 180
    return cos, turn * cos * 3600, (finite("dec") - dec) * 3600


def tangent_plane(df: DataFrame, ra: float, dec: float) -> DataFrame:
    """name, x0, y0, x0e, y0e (arcsec, x growing to the west), vx, vy, ... (arcsec/yr), t0, m, me about a point; missing motions are 0."""
    cos, east, north = _plane(ra, dec)
    zero = lambda c: F.coalesce(finite(c), F.lit(0.0))
    return df.select(
        F.col("source_id").cast("string").alias("name"), (-east).alias("x0"), north.alias("y0"), (finite("ra_error") * cos / 1e3).alias("x0e"), (finite("dec_error") / 1e3).alias("y0e"),
        (zero("pmra") / -1e3).alias("vx"), (zero("pmdec") / 1e3).alias("vy"), (zero("pmra_error") / 1e3).alias("vxe"), (zero("pmdec_error") / 1e3).alias("vye"),
        finite("ref_epoch").alias("t0"), finite("phot_g_mean_mag").alias("m"), (1.09 / finite("phot_g_mean_flux_over_error")).alias("me"),
    )


#: Targets at most that ``name_targets`` takes: a list kept by hand, sent to all executors.
TARGETS_MOST = 10_000


def name_targets(plane: DataFrame, targets: DataFrame, dr_max: float = 0.2) -> DataFrame:
    """The star nearest to each target (name, x, y) within ``dr_max`` takes the target's name; ties go to the lesser name.

    A star nearest to several targets takes the first of their names. More than ``TARGETS_MOST`` targets are refused.
    """
    short = targets.select(
        F.col("name").alias("tn"), finite("x").alias("tx"), finite("y").alias("ty")
    ).where("tn is not null and tx is not null and ty is not null")
    if short.limit(TARGETS_MOST + 1).count() > TARGETS_MOST:
        raise ValueError(f"more than {TARGETS_MOST} targets")
    # by cells twice as wide as the reach, so each star meets the targets about it only
    side, reach = 2 * dr_max, dr_max * (1 + 1e-9)
    cell = lambda c: F.floor(c / side)
    t = short
    for c, n in (("tx", "_cx"), ("ty", "_cy")):
        t = t.withColumn(n, F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach))))
    dr = F.sqrt((F.col("x0") - F.col("tx")) ** 2 + (F.col("y0") - F.col("ty")) ** 2)
    near = plane.withColumns(
        {"_cx": cell(F.col("x0")), "_cy": cell(F.col("y0"))}
    ).join(F.broadcast(t), ["_cx", "_cy"]).withColumn("_dr", dr).where(F.col("_dr") < dr_max)
    best = near.groupBy("tn").agg(
        F.min(F.struct("_dr", "name")).alias("_b")
    ).select("tn", F.col("_b.name").alias("name")).groupBy("name").agg(F.min("tn").alias("tn"))
    return plane.join(F.broadcast(best), "name", "left").withColumn("name", F.coalesce("tn", "name")).drop("tn").select(*plane.columns)


def at_epoch(df: DataFrame, epoch: float, ra: float, dec: float) -> DataFrame:
    """name, x, y, xe, ye, m, me, t about a point at an epoch; the error of ra isn't shortened by the declination here."""
    cos, east, north = _plane(ra, dec)
    dt = F.lit(float(epoch)) - finite("ref_epoch")
    zero = lambda c: F.coalesce(finite(c), F.lit(0.0))
    x, y = east + zero("pmra") / 1e3 * dt, north + zero("pmdec") / 1e3 * dt
    err = lambda e, v: F.sqrt((finite(e) / 1e3) ** 2 + (zero(v) / 1e3 * dt) ** 2)
    out = df.select(
        F.col("source_id").cast("string").alias("name"), (-x).alias("x"), y.alias("y"), err("ra_error", "pmra_error").alias("xe"),
        err("dec_error", "pmdec_error").alias("ye"), finite("phot_g_mean_mag").alias("m"), (1 / finite("phot_g_mean_flux_over_error")).alias("me"),
        F.lit(float(epoch)).alias("t")
    )
    return out.withColumns({"x_avg": F.col("x"), "y_avg": F.col("y"), "m_avg": F.col("m")})
