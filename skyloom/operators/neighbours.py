"""Points near other points or in regions, in the plane and on the sphere, by grid cells.

Each point has one home cell. As a possible neighbour it is also put into every cell that its search disc's bounding
box touches, so an equi-join on the cell finds each candidate pair and the exact distance decides. Cells are
``CELL`` radii wide. Cells with very many points are salted (hot.py).

Rows without a usable position (NULL, NaN, infinite, |dec| > 90) or without a key take no part. Rows repeated with the
same key and position count once. Empty inputs give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.common import finite
from skyloom.operators.hot import hot_keys, salted

#: Side of a cell in search radii.
CELL = 2.0
#: Slack of the bounding boxes against rounding; the exact test has none.
PAD = 1 + 1e-9


def planar_pairs(df: DataFrame, key: str, x: str, y: str, radius: float, by: list[str] | None = None) -> DataFrame:
    """Pairs (key_1 < key_2, distance) of rows with equal ``by`` at most ``radius`` apart; a NULL in ``by`` is a group of its own."""
    by = by or []
    group = [f"_g{i}" for i in range(len(by))]
    p = df.select(
        F.col(key).alias("_k"), finite(x).alias("_x"), finite(y).alias("_y"),
        *(
            F.to_json(F.struct(F.col(b))).alias(g) if df.schema[b].dataType.typeName() not in ("long", "integer", "string") else F.coalesce(
                F.col(b).cast("string"), F.lit("\x00null")
            ).alias(g) for b,
            g in zip(by, group)
        )
    )
    p = p.where(F.col("_k").isNotNull() & F.col("_x").isNotNull() & F.col("_y").isNotNull())
    side, reach = CELL * radius if radius > 0 else 1.0, radius * PAD
    cell = lambda c: F.floor(c / side)
    home = p.withColumns({"_cx": cell(F.col("_x")), "_cy": cell(F.col("_y"))})
    span = lambda c: F.sequence(cell(c - reach), cell(c + reach))
    spread = (
        home.withColumn("_nx", F.explode(span(F.col("_x"))))
        .where(F.col("_nx") >= F.col("_cx"))
        .withColumn("_ny", F.explode(span(F.col("_y"))))
        .where((F.col("_nx") > F.col("_cx")) | (F.col("_ny") >= F.col("_cy")))  # only onwards: a pair is met in one of its two cells
    )
    away = ((F.col("_nx") != F.col("_cx")) | (F.col("_ny") != F.col("_cy"))).alias("_away")
    left = home
    right = spread.select(
        F.col("_k").alias("_k2"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2"), *group, F.col("_nx").alias("_cx"), F.col("_ny").alias("_cy"),
        away
    )
    keys = [*group, "_cx", "_cy"]
    left, right, keys = salted(left, right, keys, F.col("_k"), hot_keys(home, keys))
    dx, dy = F.col("_x") - F.col("_x2"), F.col("_y") - F.col("_y2")
    near = (dx * dx + dy * dy <= F.lit(float(radius) * float(radius))) & (F.col("_k") != F.col("_k2")) & (F.col("_away") | (F.col("_k") < F.col("_k2")))
    return left.join(right, keys).where(near).select(
        F.least("_k", "_k2").alias("key_1"), F.greatest("_k", "_k2").alias("key_2"), F.sqrt(dx * dx + dy * dy).alias("distance")
    )


def _angle(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees (haversine: exact for small angles, safe for large ones)."""
    a = F.pow(F.sin(F.radians(dec1 - dec2) / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians(ra1 - ra2) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


great_circle = _angle


def _bands(height: float) -> int:
    return max(1, int(180 // height) + 1)


def _band(dec: Column, height: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(_bands(height) - 1), F.floor((dec + 90) / height))).cast("long")


def _slots(band: Column, height: float) -> Column:
    """Number of cells along a band of declination: about as wide as high in its middle."""
    mid = (band + 0.5) * height - 90
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(F.lit(90.0), mid))) / height)).cast("long")


def _slot(ra: Column, band: Column, height: float) -> Column:
    n = _slots(band, height)
    return F.pmod(F.floor(F.pmod(ra, F.lit(360.0)) / 360 * n), n).cast("long")


def _slot_span(west: Column, width: Column, band: Column, height: float) -> Column:
    """The cells of a band from ``west`` over ``width`` degrees eastwards, each once."""
    n = _slots(band, height)
    first = F.floor(west / 360 * n - 1e-9)
    last = F.least(F.floor((west + width) / 360 * n + 1e-9), first + n - 1)
    return F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.pmod(i, n).cast("long"))


def _sky(df: DataFrame, key: str, ra: str, dec: str) -> DataFrame:
    p = df.select(F.col(key).alias("_k"), F.pmod(finite(ra), F.lit(360.0)).alias("_ra"), finite(dec).alias("_dec"))
    return p.where(F.col("_k").isNotNull() & F.col("_ra").isNotNull() & (F.abs("_dec") <= 90)).distinct()


def sphere_pairs(df: DataFrame, key: str, ra: str, dec: str, radius_deg: float) -> DataFrame:
    """Pairs (key_1 < key_2, distance in degrees) of different keys at most ``radius_deg`` apart on the sphere.

    A key with several positions is near whatever is near any of them; the least distance is given.
    """
    h, r = CELL * radius_deg, radius_deg * PAD
    home = _sky(df, key, ra, dec).withColumn("_b", _band(F.col("_dec"), h)).withColumn("_s", _slot(F.col("_ra"), F.col("_b"), h))
    reach = F.when(F.abs("_dec") + r >= 90, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(r))) / F.cos(F.radians("_dec")))))
    )
    spread = (
        home.drop("_b", "_s")
        .withColumn("_reach", reach)
        .withColumn("_b", F.explode(F.sequence(_band(F.col("_dec") - r, h), _band(F.col("_dec") + r, h))))
        .withColumn("_s", F.explode(_slot_span(F.col("_ra") - F.col("_reach"), 2 * F.col("_reach"), F.col("_b"), h)))
        .select(F.col("_k").alias("_k2"), F.col("_ra").alias("_ra2"), F.col("_dec").alias("_dec2"), "_b", "_s")
    )
    left, right, keys = salted(home, spread, ["_b", "_s"], F.col("_k"), hot_keys(home, ["_b", "_s"]))
    d = _angle(F.col("_ra"), F.col("_dec"), F.col("_ra2"), F.col("_dec2"))
    pairs = left.join(right, keys).where(
        (F.col("_k") < F.col("_k2")) & (F.abs(F.col("_dec") - F.col("_dec2")) <= r)
    ).withColumn("_d", d).where(F.col("_d") <= radius_deg)
    return pairs.groupBy(F.col("_k").alias("key_1"), F.col("_k2").alias("key_2")).agg(F.min("_d").alias("distance"))


#: Smallest cell of the region grid in degrees; each level's cells are four times as wide as those below.
REGION_CELL = 1 / 16
#: Slack in degrees by which a point may lie outside a circle and still count as on its edge.
EDGE = 1e-9


def region_members(points: DataFrame, key: str, ra: str, dec: str, regions: DataFrame, region: str = "region_id") -> DataFrame:
    """Distinct (region_id, key) of the points inside a region or on its edge.

    ``regions``: shape ``box`` (ra_min eastwards to ra_max, dec_min to dec_max) or ``circle`` (ra_center, dec_center,
    radius_deg). Each region is laid on the grid level whose cells are about its size, so it covers few cells however
    large it is; points are looked up once per level in use (at most four). The widest cells are 4 degrees (about 2,600 on the
    sphere), and cells with very many points are salted. Regions of another shape or with a bound missing hold nothing.
    """
    box = F.col("shape") == "box"
    g = {c: finite(c).alias(c) for c in ("ra_min", "ra_max", "dec_min", "dec_max", "ra_center", "dec_center", "radius_deg")}
    rg = regions.select(F.col(region).alias("_r"), F.lower("shape").alias("shape"), *g.values()).where(F.col("_r").isNotNull())
    rg = rg.where(
        F.when(box, F.col("ra_min").isNotNull() & F.col("ra_max").isNotNull() & (F.col("dec_min") <= F.col("dec_max"))).otherwise(
            (F.col("shape") == "circle") & F.col("ra_center").isNotNull() & F.col("dec_center").isNotNull() & (F.col("radius_deg") >= 0)
        )
    )
    pad = 1e-6
    lo = F.when(box, F.col("dec_min")).otherwise(F.col("dec_center") - F.col("radius_deg")) - pad
    hi = F.when(box, F.col("dec_max")).otherwise(F.col("dec_center") + F.col("radius_deg")) + pad
    polar = F.abs("dec_center") + F.col("radius_deg") + pad >= 90
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians("radius_deg")) / F.cos(F.radians("dec_center"))))) + pad)
    west = F.when(box, F.pmod("ra_min", F.lit(360.0)) - pad).otherwise(F.col("ra_center") - half)
    width = F.when(
        box,
        F.when(
            F.col("ra_max") >= F.col("ra_min"), F.least(F.lit(360.0), F.col("ra_max") - F.col("ra_min"))
        ).otherwise(F.pmod(F.col("ra_max") - F.col("ra_min"), F.lit(360.0))) + 2 * pad
    ).otherwise(2 * half)
    rg = rg.withColumns({"_lo": lo, "_hi": hi, "_west": west, "_width": width})
    size = F.greatest(F.col("_hi") - F.col("_lo"), F.col("_width") * F.cos(F.radians((F.col("_hi") + F.col("_lo")) / 2)) / 32)
    top = 3
    rg = rg.withColumn("_level", F.greatest(F.lit(0), F.least(F.lit(top), F.ceil(F.log2(size / REGION_CELL) / 2))).cast("int"))
    levels = sorted(r[0] for r in rg.select("_level").distinct().collect())  # at most four numbers
    covers = []
    for k in levels:
        h = REGION_CELL * 4**k
        covers.append(
            rg.where(F.col("_level") == k)
            .withColumn("_b", F.explode(F.sequence(_band(F.col("_lo"), h), _band(F.col("_hi"), h))))
            .withColumn("_s", F.explode(_slot_span(F.col("_west"), F.col("_width"), F.col("_b"), h)))
        )
    p = _sky(points, key, ra, dec)
    if not covers:
        return p.select(F.lit(None).cast(regions.schema[region].dataType).alias("region_id"), F.col("_k").alias("key")).where(F.lit(False))
    cover = covers[0]
    for c in covers[1:]:
        cover = cover.unionByName(c)
    at = F.explode(
        F.array(
            *(F.struct(F.lit(k).alias("_level"), (b := _band(F.col("_dec"), REGION_CELL * 4**k)).alias("_b"), _slot(F.col("_ra"), b, REGION_CELL * 4**k).alias("_s")) for k in levels)
        )
    )
    looked = p.withColumn("_at", at).select("_k", "_ra", "_dec", "_at.*")
    east, start, end = F.col("_ra"), F.pmod("ra_min", F.lit(360.0)), F.when(F.col("ra_max") == 360, F.lit(360.0)).otherwise(F.pmod("ra_max", F.lit(360.0)))
    whole = F.col("ra_max") - F.col("ra_min") >= 360
    in_ra = whole | F.when(start <= end, (east >= start) & (east <= end)).otherwise((east >= start) | (east <= end))
    inside = F.when(box, in_ra & (F.col("_dec") >= F.col("dec_min")) & (F.col("_dec") <= F.col("dec_max"))).otherwise(
        _angle(F.col("_ra"), F.col("_dec"), F.col("ra_center"), F.col("dec_center")) <= F.col("radius_deg") + EDGE
    )
    keys = ["_level", "_b", "_s"]
    looked, cover, keys = salted(looked, cover, keys, F.col("_k"), hot_keys(looked, keys))
    return looked.join(cover, keys).where(inside).select(F.col("_r").alias("region_id"), F.col("_k").alias("key")).distinct()
