"""Queries of the catalog operators over whole tables, each with the SQL that gives the same rows.

Floats are rounded on both sides, so that the order of sums doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.common import finite, table
from skyloom.functions import models
from skyloom.operators import combine, crossmatch, filters, fits, motion, quality, sky, tables, triangles
from skyloom.sources import catalogs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Frame = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None):
    def add(f: Frame) -> Frame:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Beyond this size (bad readings reach 1e9) doubles have fewer sure digits: they are rounded to at most COARSE.
LARGE, COARSE = 1e5, 4


def near(v: Column, digits: int) -> Column:
    """The value rounded, so that the order of sums doesn't show; -0 as 0."""
    fine = F.round(v, digits)
    return (F.when(F.abs(v) > LARGE, F.round(v, COARSE)).otherwise(fine) if digits > COARSE else fine) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(near(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def fin(c: str) -> str:
    return f"(case when isnan({c}) or isinf({c}) then null else {c} end)"


def rnd(e: str, name: str, digits: int = 6) -> str:
    fine = f"round({e}, {digits})"
    return f"(case when abs({e}) > {LARGE} then round({e}, {COARSE}) else {fine} end) + 0.0 as {name}" if digits > COARSE else f"{fine} + 0.0 as {name}"


# --- inputs: stars without re-sent rows, readings one an epoch, pairs of readings and their stars


def stars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "startable").drop("loaded_at").distinct()


STARS = "stars as (select distinct * exclude (loaded_at) from startable)"


def readings(spark: SparkSession, d: str) -> DataFrame:
    """The distinct readings with their list's time where they have none."""
    obs = combine.distinct_readings(table(spark, d, "startable_obs").drop("loaded_at"))
    times = table(spark, d, "lists").select("list_id", "list_time")
    return obs.join(times, "list_id", "left").withColumn("t", F.coalesce(finite("t"), "list_time")).drop("list_time")


READINGS = f"""readings as (select o.* exclude (t, loaded_at), coalesce({fin('o.t')}, l.list_time) as t
  from (select distinct on (star_id, list_id) * from startable_obs order by star_id, list_id, obs_id) o left join lists l using (list_id))"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Readings within the field next to their stars' places, whose errors are put to fixed ones (the recorded ones have mixed units)."""
    s = stars(spark, d).select("star_id", finite("x0").alias("x_ref"), finite("y0").alias("y_ref"), finite("m0").alias("m_ref"))
    r = readings(spark, d).select("star_id", "list_id", *(finite(c).alias(c) for c in ("x", "y", "m", "xe", "ye")))
    good = r.where("x is not null and y is not null and m is not null and xe > 0 and ye > 0 and abs(x) < 10000 and abs(y) < 10000 and abs(m) < 40")
    return good.join(s, "star_id").where(
        "x_ref is not null and y_ref is not null and m_ref is not null"
    ).withColumns({"xe_ref": F.lit(0.05), "ye_ref": F.lit(0.07)})


PAIRS = f"""{STARS}, {READINGS}, pairs as (select r.star_id, r.list_id, r.x, r.y, r.m, r.xe, r.ye, s.x0 as x_ref, s.y0 as y_ref, s.m0 as m_ref, 0.05::double as xe_ref, 0.07::double as ye_ref
  from readings r join stars s using (star_id) where r.x is not null and not isnan(r.x) and not isinf(r.x) and r.y is not null and not isnan(r.y) and not isinf(r.y) and r.m is not null and not isnan(r.m) and not isinf(r.m)
  and r.xe > 0 and not isnan(r.xe) and not isinf(r.xe) and r.ye > 0 and not isnan(r.ye) and not isinf(r.ye) and abs(r.x) < 10000 and abs(r.y) < 10000 and abs(r.m) < 40
  and {fin('s.x0')} is not null and {fin('s.y0')} is not null and {fin('s.m0')} is not null)"""

# --- filters and projections


@query(f"select row_id, list_id from starlist where not coalesce({fin('m')} <= 12 or {fin('m')} >= 18, false) and not coalesce({fin('x')} <= 50, false)")
def filter_value(spark, d):
    """Rows within open intervals; missing values stay."""
    return filters.restrict_by_value(table(spark, d, "starlist"), m_min=12, m_max=18, x_min=50, y_max=None).select("row_id", "list_id")


@query("select row_id from starlist where x > 50 and x < 300 and y > 20 and y < 250 and not isnan(x) and not isnan(y)")
def filter_area(spark, d):
    """Rows in an open box."""
    return filters.restrict_by_area(table(spark, d, "starlist"), (50, 300), (20, 250)).select("row_id")


@query("select row_id from starlist where (x < 50 or x > 300) and (y < 20 or y > 250) and not isnan(x) and not isnan(y)")
def filter_area_exclude(spark, d):
    """Rows outside a box by both coordinates."""
    return filters.restrict_by_area(table(spark, d, "starlist"), (50, 300), (20, 250), exclude=True).select("row_id")


@query(f"with {STARS} select star_id, n_detect from stars where use_in_trans::varchar <> '0'")
def filter_use(spark, d):
    """Stars whose flag isn't 0."""
    return filters.restrict_by_use(stars(spark, d), "use_in_trans").select("star_id", "n_detect")


@query(f"with {STARS} select star_id from stars where not coalesce({fin('m0')} <= 13 or {fin('m0')} >= 17.5, false)")
def filter_magnitude(spark, d):
    """Magnitude limits by m0."""
    return filters.apply_mag_lim(stars(spark, d), 13, 17.5).select("star_id")


@query(
    f"with {STARS} select star_id, case when coalesce({fin('m0')} < 13 or {fin('m0')} >= 17.5, false) then false else use_in_trans end as use_in_trans from stars"
)
def magnitude_flag(spark, d):
    """P5: the flag put down outside [13, 17.5)."""
    return filters.mag_lim_as_flag(stars(spark, d), 13, 17.5, m="m0").select("star_id", "use_in_trans")


@query(f"with {READINGS} select star_id, count({fin('x')}) as n_detect from readings group by star_id")
def detections(spark, d):
    """Detections of each star."""
    return filters.detections(readings(spark, d))


@query(
    f"with {STARS}, {READINGS}, c as (select star_id, count({fin('x')}) as n from readings group by star_id) select s.star_id, coalesce(n, 0)::bigint as n_detect from stars s left join c using (star_id) where coalesce(n, 0) > 0"
)
def drop_undetected(spark, d):
    """Stars with detections."""
    return filters.drop_undetected(stars(spark, d), filters.detections(readings(spark, d))).select(
        "star_id", F.col("n_detect").cast("bigint").alias("n_detect")
    )


@query(
    f"with {STARS} select star_id from stars where sqrt(x0 * x0 + y0 * y0) < 400 and m0 < 18 and (vxe + vye) / 2 < 0.5 and not isnan(x0) and not isnan(y0) and not isnan(m0) and not isnan(vxe) and not isnan(vye)"
)
def good_ref_stars(spark, d):
    """Reference stars by radius, magnitude and error of motion."""
    s = stars(spark, d)
    s = s.withColumns({c: finite(c) for c in ("x0", "y0", "m0", "vxe", "vye")})
    return filters.pick_good_ref_stars(s, r_cut=400, m_cut=18, pm_err_cut=0.5).select("star_id")


@query(f"""with {PAIRS}, g as (select *, m_ref - m as d from pairs), s as (select list_id, median(d) as md, stddev_pop(d) as sd from g group by 1),
  z as (select list_id, avg(d) as zp from g join s using (list_id) where abs(d - md) <= 3 * sd group by 1)
  select star_id, list_id, {rnd('m + coalesce(zp, 0)', 'm', 7)} from pairs left join z using (list_id) where list_id in (select list_id from lists where filt = 'kp')""")
def epoch_zero_point(spark, d):
    """The magnitudes of one filter's lists moved by their zero points."""
    p = pairs(spark, d).withColumn("used_in_trans", F.lit(True))
    every = [r["list_id"] for r in table(spark, d, "lists").where("filt = 'kp'").select("list_id").collect()]
    s = p.select("star_id", F.col("m_ref").alias("m0")).distinct()
    return rounded(filters.epoch_subset(p.select("star_id", "list_id", "m", "used_in_trans"), s, every).select("star_id", "list_id", "m"), 7)


@query(
    f"with {STARS}, {READINGS} select r.star_id, r.obs_id, s.name, {rnd('r.t', 't', 4)} from readings r left join stars s using (star_id) where r.list_id = 7"
)
def epoch_extract(spark, d):
    """P10: one epoch as a star list."""
    return rounded(filters.epoch(readings(spark, d), stars(spark, d), 7).select("star_id", "obs_id", "name", "t"), 4)


AT = ", ".join(f"{fin(f'{c}0')} + {fin(f'v{c}')} * (2018.5::double - {fin('t0')}) as {c}_t" for c in "xy")


@query(f"with {STARS} select star_id, {AT} from stars")
def position_at_time(spark, d):
    """Places at a time by the motions."""
    s = stars(spark, d).withColumns({c: finite(c) for c in ("x0", "y0", "vx", "vy", "t0")})
    return filters.position_at(s, 2018.5).select("star_id", "x_t", "y_t")


@query(
    f"""with r as (select distinct on (list_id, x, y, m) * from starlist order by list_id, x, y, m, row_id) select row_id, name, x as x0, y as y0, m as m0, t as t0, xe as x0e, ye as y0e, x, y, m, t, xe, ye from r where list_id = 43"""
)
def renamed_for_reference(spark, d):
    """A list's columns renamed to a reference's and its reading columns filled in again."""
    s = table(spark, d, "starlist").where("list_id = 43").select("row_id", "name", "x", "y", "m", "t", "xe", "ye")
    once = s.join(s.groupBy("x", "y", "m").agg(F.min("row_id").alias("row_id")).select("row_id"), "row_id", "left_semi")
    return filters.fill_reference(filters.rename_for_ref(once)).select("row_id", "name", "x0", "y0", "m0", "t0", "x0e", "y0e", "x", "y", "m", "t", "xe", "ye")


def _reference_sql() -> str:
    moves = f"{fin('vx')} is not null"
    cols = [c for c in ("x0", "y0", "x0e", "y0e", "vx", "vy", "vxe", "vye", "t0")]
    at = lambda c: f"case when {moves} then {c}0 + v{c} * (2018.5::double - t0) else {c}0 end"
    err = lambda c: f"case when {moves} then sqrt({c}0e * {c}0e + (v{c}e * (2018.5 - t0)) * (v{c}e * (2018.5 - t0))) else {c}0e end"
    clean = ", ".join(f"{fin(c)} as {c}" for c in cols)
    return f"""with {STARS}, s as (select star_id, {clean} from stars) select star_id, {at('x')} as x, {at('y')} as y, {rnd(err('x'), 'xe', 6)}, {rnd(err('y'), 'ye', 6)}
  from s where x0 is not null and x0e is not null and t0 is not null"""


@query(_reference_sql())
def reference_list(spark, d):
    """The reference list at a time, with errors."""
    s = stars(spark, d).withColumns(
        {c: finite(c) for c in ("x0", "y0", "x0e", "y0e", "vx", "vy", "vxe", "vye", "t0")}
    ).where("x0 is not null and x0e is not null and t0 is not null")
    return filters.reference_at(s, 2018.5).select("star_id", "x", "y", near(F.col("xe"), 6).alias("xe"), near(F.col("ye"), 6).alias("ye"))


@query("select list_id, min_by(t, obs_id) as t from startable_obs where not isnan(t) and not isinf(t) group by list_id")
def list_epochs(spark, d):
    """Each list's first time."""
    return filters.first_epochs(table(spark, d, "startable_obs"))


RA, DEC = 271.38, -27.8
GAIA = "g as (select distinct * exclude (loaded_at) from gaia)"
EAST = f"((((({fin('ra')} - {RA} + 180)::double % 360) + 360) % 360) - 180)"


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gaia").drop("loaded_at").distinct()


ZERO = {c: f"coalesce({fin(c)}, 0)" for c in ("pmra", "pmdec", "pmra_error", "pmdec_error")}
PLANE = {
    "x0": rnd(f"-{EAST} * cos(radians({DEC})) * 3600", "x0", 4), "y0": rnd(f"({fin('dec')} - ({DEC})) * 3600", "y0", 4), "x0e": rnd(
        f"{fin('ra_error')} * cos(radians({DEC})) / 1000", "x0e", 9
    ), "y0e": f"{fin('dec_error')} / 1000 as y0e",
    "vx": f"{ZERO['pmra']} / -1000 + 0.0 as vx", "vy": f"{ZERO['pmdec']} / 1000 as vy", "vxe": f"{ZERO['pmra_error']} / 1000 as vxe", "vye": f"{ZERO['pmdec_error']} / 1000 as vye",
    "t0": f"{fin('ref_epoch')} as t0", "m": f"{fin('phot_g_mean_mag')} as m", "me": rnd(f"1.09 / {fin('phot_g_mean_flux_over_error')}", "me", 9),
}


@query(f"with {GAIA} select source_id::varchar as name, {', '.join(PLANE.values())} from g")
def tangent_plane(spark, d):
    """Sources on a local plane."""
    p = sky.tangent_plane(sources(spark, d), RA, DEC)
    n = {"x0": 4, "y0": 4, "x0e": 9, "me": 9}
    return p.select("name", *((near(F.col(c), n[c]) if c in n else F.col(c) + F.lit(0.0) if c == "vx" else F.col(c)).alias(c) for c in PLANE))


def _epoch_sql() -> str:
    east, north, dt = f"{EAST} * cos(radians({DEC})) * 3600", f"({fin('dec')} - ({DEC})) * 3600", "(2020.5 - ref_epoch)"
    err = lambda e, v: f"sqrt(({fin(e)} / 1000) * ({fin(e)} / 1000) + ({ZERO[v]} / 1000 * {dt}) * ({ZERO[v]} / 1000 * {dt}))"
    return f"""with {GAIA} select source_id::varchar as name, {rnd(f"-({east} + {ZERO['pmra']} / 1000 * {dt})", 'x', 5)}, {rnd(f"{north} + {ZERO['pmdec']} / 1000 * {dt}", 'y', 5)}, {rnd(err('ra_error', 'pmra_error'), 'xe', 7)}, {rnd(err('dec_error', 'pmdec_error'), 'ye', 7)},
  {fin('phot_g_mean_mag')} as m, {rnd(f"1 / {fin('phot_g_mean_flux_over_error')}", 'me', 9)} from g where not isnan(ref_epoch) and ref_epoch is not null"""


@query(_epoch_sql())
def gaia_at_epoch(spark, d):
    """Sources at an epoch."""
    p = sky.at_epoch(sources(spark, d).where(finite("ref_epoch").isNotNull()), 2020.5, RA, DEC)
    n = {"x": 5, "y": 5, "xe": 7, "ye": 7, "me": 9}
    return p.select("name", "m", *(near(F.col(c), k).alias(c) for c, k in n.items()))


TARGETS = [("target_a", 120.0, -80.0), ("target_b", -400.0, 300.0), ("target_c", 1500.0, 900.0)]


@query(f"""with {GAIA}, p as (select source_id::varchar as name, {PLANE['x0']}, {PLANE['y0']} from g), t(tn, tx, ty) as (values {', '.join(f"('{n}', {x}::double, {y}::double)" for n, x, y in TARGETS)}),
  c as (select tn, name, row_number() over (partition by tn order by sqrt((x0 - tx) * (x0 - tx) + (y0 - ty) * (y0 - ty)), name) as k from p, t where sqrt((x0 - tx) * (x0 - tx) + (y0 - ty) * (y0 - ty)) < 5000)
  select coalesce(tn, p.name) as name, x0, y0 from p left join (select * from c where k = 1) using (name)""")
def named_targets(spark, d):
    """The sources nearest to targets take their names."""
    p = sky.tangent_plane(sources(spark, d), RA, DEC).select("name", near(F.col("x0"), 4).alias("x0"), near(F.col("y0"), 4).alias("y0"))
    return sky.name_targets(p, spark.createDataFrame(TARGETS, "name string, x double, y double"), 5000.0)


HAV = f"degrees(2 * asin(least(1, sqrt(pow(sin(radians(dec - ({DEC})) / 2), 2) + cos(radians(dec)) * cos(radians({DEC})) * pow(sin(radians(ra - {RA}) / 2), 2)))))"


@query(f"with {GAIA} select source_id, {rnd(HAV, 'dist', 8)} from g where not isnan(dec) and not isnan(ra) and abs(dec - ({DEC})) <= 0.5 and {HAV} <= 0.5")
def cone_search(spark, d):
    """Sources within half a degree of a point."""
    return rounded(sky.cone(sources(spark, d), RA, DEC, 1800, limit=None).select("source_id", "dist"), 8)


# --- matching


def epochs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each list's readings against those of the list numbered one higher."""
    r = readings(spark, d).select("list_id", F.col("obs_id").alias("id"), "x", "y", "m", F.col("star_id").cast("string").alias("name"))
    return r, r.withColumn("list_id", F.col("list_id") - 1)


def _match_ctes(dr: float, dm: float | None, near: str = "dr") -> str:
    """The match of a with b (list_id, id, x, y, m): its result is q where sm = 1 and sd = 1."""
    keep = f"where adm <= {dm}" if dm else ""
    accept = f"and adm < {dm}" if dm else ""
    return f"""c0 as (select list_id, a.id as id_1, b.id as id_2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as dr, abs(a.x - b.x) as adx, a.m - b.m as dm, abs(a.m - b.m) as adm from a join b using (list_id)
    where abs(a.x - b.x) <= {dr} and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {dr} * {dr}::double),
  c as (select * from c0 {keep}),
  o as (select *, row_number() over (partition by list_id, id_1 order by adm nulls first, id_2) as rm, row_number() over (partition by list_id, id_1 order by {near}, id_2) as rd from c),
  p as (select * from o where rm = 1 and rd = 1 {accept}),
  q as (select *, row_number() over (partition by list_id, id_2 order by adm nulls first, id_1) as sm, row_number() over (partition by list_id, id_2 order by dr, id_1) as sd from p)"""


def _match_sql(dr: float, dm: float | None, near: str = "dr", move: tuple[str, str] = ("x", "y")) -> str:
    return f"""with {READINGS}, a as (select list_id, obs_id as id, {move[0]} as x, {move[1]} as y, {fin('m')} as m from (select * from readings where {fin('x')} is not null and {fin('y')} is not null)),
  b as (select list_id - 1 as list_id, obs_id as id, x, y, {fin('m')} as m from readings where {fin('x')} is not null and {fin('y')} is not null),
  {_match_ctes(dr, dm, near)}
  select list_id, id_1, id_2, {rnd('dr', 'dr')}, {rnd('dm', 'dm')} from q where sm = 1 and sd = 1"""


@query(_match_sql(3.0, None))
def xmatch_euclid(spark, d):
    """Unconfused matches within 3 pixels of each list with the next."""
    return rounded(crossmatch.cross_match(*epochs(spark, d), 3.0, by=["list_id"]))


@query(_match_sql(3.0, 0.5))
def xmatch_magnitude(spark, d):
    """J1 with a magnitude tolerance."""
    return rounded(crossmatch.cross_match(*epochs(spark, d), 3.0, 0.5, by=["list_id"]))


@query(_match_sql(3.0, 0.5, near="adx"))
def xmatch_x_only(spark, d):
    """J1 with several candidates ranked by |dx| alone."""
    return rounded(crossmatch.cross_match(*epochs(spark, d), 3.0, 0.5, by=["list_id"], metric="x_only"))


MOVED = models.polynomial([0.3, 1.0001, 0.0002], [-0.2, -0.0002, 0.9999])


@query(_match_sql(2.0, 0.5, move=("0.3 + 1.0001 * x + 0.0002 * y", "-0.2 + -0.0002 * x + 0.9999 * y")))
def transform_match(spark, d):
    """Matches after a transform."""
    return rounded(crossmatch.transform_and_match(*epochs(spark, d), MOVED, 2.0, 0.5, by=["list_id"]))


def both_names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "starlist").select(F.col("row_id").alias("id"), "name"), table(spark, d, "starlist_ext").select(F.col("ext_id").alias("id"), "name")


@query(
    "with a as (select name, min(row_id) as id_1 from starlist where not starts_with(name, 'star') group by 1), b as (select name, min(ext_id) as id_2 from starlist_ext where not starts_with(name, 'star') group by 1) select name, id_1, id_2 from a join b using (name)"
)
def match_names(spark, d):
    """Equal names, first rows."""
    return crossmatch.name_join(*both_names(spark, d))


@query("select a.name, a.row_id as id_1, b.ext_id as id_2 from starlist a join starlist_ext b using (name) where not contains(a.name, 'star')")
def guess_names(spark, d):
    """Equal names without ``star``."""
    return crossmatch.guess_join(*both_names(spark, d))


@query(
    f"with m as ({_match_sql(3.0, 0.5)}), {READINGS} select list_id - 1 as list_id, obs_id as id from readings where (list_id - 1, obs_id) not in (select list_id, id_2 from m)"
)
def new_sources(spark, d):
    """Readings of the next list that no match has."""
    a, b = epochs(spark, d)
    return crossmatch.unmatched(b, crossmatch.cross_match(a, b, 3.0, 0.5, by=["list_id"]), by=["list_id"]).select("list_id", "id")


@query(f"with {READINGS} select star_id, list_id, case when list_id = 7 then null else {fin('m')} end as m from readings")
def copy_over(spark, d):
    """Readings of an epoch replaced by others."""
    r = readings(spark, d).select("star_id", "list_id", finite("m").alias("m"))
    return crossmatch.copy_over(r, r.where("list_id = 7").withColumn("m", F.lit(None).cast("double")))


def labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = stars(spark, d).select(
        F.col("star_id").alias("id"), "name", finite("x0").alias("x"), finite("y0").alias("y"), finite("m0").alias("m")
    ).where("x is not null and y is not null and m is not null")
    return s, s.select(
        "id", F.concat("name", F.when(F.col("id") % 3 == 0, F.lit("_new")).otherwise(F.lit(""))).alias("name"), (F.col("x") + 0.01).alias("x"), "y",
        "m"
    )


def _relabel_sql() -> str:
    usable = " and ".join(f"{fin(c)} is not null" for c in ("x0", "y0", "m0"))
    first = lambda t: f"select name, min(id) as id from {t} where name is not null and not starts_with(name, 'star') group by 1"
    return f"""with {STARS}, s as (select star_id as id, name, x0 as x, y0 as y, m0 as m from stars where {usable}),
  l as (select id, name || (case when id % 3 = 0 then '_new' else '' end) as name, x + 0.01 as x, y, m from s), fs as ({first('s')}), fl as ({first('l')}),
  off as (select avg(s.x - l.x) as dx, avg(s.y - l.y) as dy, avg(s.m - l.m) as dm from fl join fs using (name) join l on l.id = fl.id join s on s.id = fs.id),
  a as (select 0 as list_id, id, x, y, m from s), b as (select 0 as list_id, id, x + coalesce(dx, 0) as x, y + coalesce(dy, 0) as y, m + coalesce(dm, 0) as m from l, off),
  {_match_ctes(0.05, 0.3)}, found as (select id_1 as id, l.name as label from q join l on l.id = q.id_2 where sm = 1 and sd = 1)
  select s.id, coalesce(label, s.name) as name, s.name as name_orig from s left join found using (id)"""


@query(_relabel_sql())
def relabel(spark, d):
    """Stars renamed after the labels they match, with their old names."""
    s, labels = labelled(spark, d)
    return crossmatch.relabel(s, labels).select("id", "name", "name_orig")


@query(
    f"with m as ({_match_sql(3.0, 0.5)}), {READINGS} select m.id_1, m.id_2, a.star_id::varchar as name, b.star_id::varchar as name_2 from m join readings a on a.obs_id = m.id_1 join readings b on b.obs_id = m.id_2"
)
def pair_table(spark, d):
    """Matched rows side by side."""
    a, b = epochs(spark, d)
    m = crossmatch.cross_match(a, b, 3.0, 0.5, by=["list_id"])
    return crossmatch.pair_table(a.select("id", "name"), b.select("id", "name"), m)


N_BRIGHT, FIRST = 50, 43


def bright_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One list's rows beside every list, and all lists, each in its own frame; re-sent rows once."""
    b = table(spark, d, "starlist").groupBy("list_id", "x", "y", "m").agg(F.min("row_id").alias("id"))
    every = F.broadcast(table(spark, d, "lists").where("kind = 'unmatched'").select("list_id"))  # one row a list
    return b.where(F.col("list_id") == FIRST).drop("list_id").crossJoin(every), b


def _triangles_sql(source: str, name: str, by: str = "list_id") -> str:
    """CTE ``name``: the triangles of the brightest rows of each list of ``source`` (list_id, id, x, y, m)."""
    angle = "degrees(atan2(ux * wx + uy * wy, ux * wy - uy * wx))"
    return f"""{name}_t as (select * from (select *, row_number() over (partition by list_id order by m, id) as r from ({source}) where {fin('x')} is not null and {fin('y')} is not null and {fin('m')} is not null) where r <= {N_BRIGHT}),
  {name}_s as (select a.list_id, a.id as a, b.id as b, c.id as c, a.r as ra, b.r as rb, c.r as rc, b.x - a.x as ux, b.y - a.y as uy, c.x - a.x as wx, c.y - a.y as wy
    from {name}_t a join {name}_t b on a.list_id = b.list_id and a.r < b.r join {name}_t c on b.list_id = c.list_id and b.r < c.r),
  {name} as (select *, case when ux * ux + uy * uy < wx * wx + wy * wy then -(ux * ux + uy * uy) / (wx * wx + wy * wy) else (wx * wx + wy * wy) / (ux * ux + uy * uy) end as vmax,
    case when {angle} < 0 then {angle} + 360 else {angle} end as angle from {name}_s where ux * ux + uy * uy > 0 and wx * wx + wy * wy > 0)"""


def _votes_sql() -> str:
    ev, ea = triangles.bin_edges(200, 360)
    edges = f"e as (select [{', '.join(repr(float(x)) for x in ev)}]::double[] as ev, [{', '.join(repr(float(x)) for x in ea)}]::double[] as ea)"

    def place(v: str, edge: str, values) -> str:
        g = f"greatest(0, least({len(values) - 1}, floor(({v} - ({float(values[0])!r})) / {float(values[1] - values[0])!r}::double)))::int"
        return f"(case when {g} + 1 < {len(values)} and {v} >= {edge}[{g} + 2] then {g} + 2 when {v} >= {edge}[{g} + 1] then {g} + 1 else {g} end)"

    every = "select list_id, x, y, m, min(row_id) as id from starlist group by 1, 2, 3, 4"
    bins = lambda g: f"select * from (select {g}.*, {place('vmax', 'ev', ev)} as bv, {place('angle', 'ea', ea)} as ba from {g}, e) where bv between 1 and {len(ev) - 1} and ba between 1 and {len(ea) - 1}"
    return f"""with {edges}, {_triangles_sql(f"select l.list_id, x, y, m, id from ({every}) s, lists l where s.list_id = {FIRST} and l.kind = 'unmatched'", 'g1')}, {_triangles_sql(every, 'g2')},
  b1 as ({bins('g1')}), b2 as ({bins('g2')}), f as (select * from (select *, row_number() over (partition by list_id, bv, ba order by ra, rb, rc) as k from b1) where k = 1),
  h as (select f.list_id, f.a as a1, b2.a as a2, f.b as b1, b2.b as b2, f.c as c1, b2.c as c2 from f join b2 on f.list_id = b2.list_id and f.bv = b2.bv and f.ba = b2.ba),
  u as (select list_id, a1 as id_1, a2 as id_2 from h union all select list_id, b1, b2 from h union all select list_id, c1, c2 from h), votes as (select list_id, id_1, id_2, count(*) as votes from u group by 1, 2, 3)"""


@query(
    f"with {_triangles_sql('select list_id, ext_id as id, x, y, m from starlist_ext', 'g')} select list_id, a, b, c, {rnd('vmax', 'vmax', 9)}, {rnd('angle', 'angle', 7)} from g"
)
def triangle_geometry(spark, d):
    """Triangles of each external list's 50 brightest."""
    e = table(spark, d, "starlist_ext").select("list_id", F.col("ext_id").alias("id"), "x", "y", "m")
    t = triangles.triangles(triangles.ranked(e, N_BRIGHT, ["list_id"]), ["list_id"])
    return t.select("list_id", "a", "b", "c", near(F.col("vmax"), 9).alias("vmax"), near(F.col("angle"), 7).alias("angle"))


@query(f"{_votes_sql()} select list_id, id_1, id_2, votes from votes")
def triangle_votes(spark, d):
    """Votes for pairs of one list with every other."""
    t1, t2 = (triangles.triangles(triangles.ranked(x, N_BRIGHT, ["list_id"]), ["list_id"]) for x in bright_lists(spark, d))
    return triangles.votes(t1, t2, by=["list_id"])


def _triangle_match_ctes() -> str:
    """CTE ``tm``: the pairs with more than twice the votes of the next."""
    return f"""{_votes_sql()}, n1 as (select list_id from g1_t group by 1 having count(*) >= {N_BRIGHT} intersect select list_id from g2_t group by 1 having count(*) >= {N_BRIGHT}),
  vw as (select *, row_number() over (partition by list_id, id_2 order by votes desc, id_1) as k, lead(votes) over (partition by list_id, id_2 order by votes desc, id_1) as nxt from votes where list_id in (select list_id from n1)),
  tm as (select list_id, id_1, id_2, votes from vw where k = 1 and votes > 2 * coalesce(nxt, 0))"""


@query(f"{_triangle_match_ctes()} select list_id, id_1, id_2, votes from tm")
def triangle_match(spark, d):
    """Of one list with every other the pairs with twice the votes of the next."""
    return triangles.triangle_match(*bright_lists(spark, d), N_BRIGHT, by=["list_id"])


@query("select row_id, m from starlist where m is not null and not isnan(m) and not isinf(m) order by m, row_id limit 50")
def brightest_n(spark, d):
    """O1: the brightest rows."""
    return filters.brightest(table(spark, d, "starlist"), 50).select("row_id", "m")


@query("select name from starlist intersect select name from starlist_ext")
def common_names(spark, d):
    """Names in both tables."""
    a, b = both_names(spark, d)
    return a.select("name").intersect(b.select("name"))


@query("select row_id as id, list_id, 'starlist' as source from starlist union all select ext_id, list_id, 'starlist_ext' from starlist_ext")
def stacked(spark, d):
    """Both tables stacked."""
    part = lambda t, k: table(spark, d, t).select(F.col(k).alias("id"), "list_id", F.lit(t).alias("source"))
    return part("starlist", "row_id").unionByName(part("starlist_ext", "ext_id"))


@query("select distinct t from startable_obs where t is not null and not isnan(t) and not isinf(t)")
def epochs_present(spark, d):
    """Distinct times."""
    return quality.epochs_of(table(spark, d, "startable_obs"))


def guess_sql() -> str:
    """First transforms of each list from the triangle pairs, where there are three."""
    every = "select list_id, x, y, m, min(row_id) as id from starlist group by 1, 2, 3, 4"
    source = f"""(select tm.list_id, b.x, b.y, {fin('b.m')} as m, a.x as x_ref, a.y as y_ref, {fin('a.m')} as m_ref, tm.votes::double as votes from tm join ({every}) a on a.id = tm.id_1 join ({every}) b on b.id = tm.id_2
    where tm.list_id in (select list_id from tm group by 1 having count(*) >= 3))"""
    return _fit_sql("votes", source, _triangle_match_ctes().removeprefix("with "))


# --- models

ORDER2 = models.polynomial([1.5, 1.0002, -0.0003, 1e-6, -2e-6, 3e-6], [-2.5, 0.0004, 0.9997, -1e-6, 2e-6, 1e-6], -0.25)


def moving(spark: SparkSession, d: str) -> DataFrame:
    s = stars(spark, d).select("star_id", *(finite(c).alias(c) for c in ("x0", "y0", "m0", "x0e", "y0e", "vx", "vy", "vxe", "vye")))
    return s.where(" and ".join(f"{c} is not null" for c in ("x0", "y0", "x0e", "y0e", "vx", "vy", "vxe", "vye")))


MOVING = f"{STARS}, mv as (select star_id, x0, y0, m0, x0e, y0e, vx, vy, vxe, vye from stars where " + " and ".join(
    f"{fin(c)} is not null" for c in ("x0", "y0", "x0e", "y0e", "vx", "vy", "vxe", "vye")
) + ")"
PX = "(1.5 + 1.0002 * x0 - 0.0003 * y0 + 1e-6 * x0 * x0 - 2e-6 * x0 * y0 + 3e-6 * y0 * y0)"
PY = "(-2.5 + 0.0004 * x0 + 0.9997 * y0 - 1e-6 * x0 * x0 + 2e-6 * x0 * y0 + 1e-6 * y0 * y0)"
XX, XY = "(1.0002 + 2e-6 * x0 - 2e-6 * y0)", "(-0.0003 - 2e-6 * x0 + 6e-6 * y0)"
YX, YY = "(0.0004 - 2e-6 * x0 + 2e-6 * y0)", "(0.9997 + 2e-6 * x0 + 2e-6 * y0)"


def model_columns(names: tuple[str, ...], values: tuple[Column, ...]) -> list[Column]:
    return [near(v, 6).alias(n) for n, v in zip(names, values)]


@query(f"with {MOVING} select star_id, {rnd(PX, 'x')}, {rnd(PY, 'y')}, {rnd(f'{fin("m0")} - 0.25', 'm')} from mv")
def poly_apply(spark, d):
    """Places and magnitudes moved by an order-2 polynomial."""
    s = moving(spark, d)
    return s.select("star_id", *model_columns(("x", "y", "m"), (*ORDER2.position(F.col("x0"), F.col("y0")), ORDER2.magnitude(F.col("m0")))))


@query(
    f"with {MOVING} select star_id, {rnd(f'sqrt({XX} * x0e * {XX} * x0e + {XY} * y0e * {XY} * y0e)', 'xe')}, {rnd(f'sqrt({YX} * x0e * {YX} * x0e + {YY} * y0e * {YY} * y0e)', 'ye')} from mv"
)
def poly_error(spark, d):
    """Errors of moved places."""
    return moving(spark, d).select("star_id", *model_columns(("xe", "ye"), ORDER2.position_error(*(F.col(c) for c in ("x0", "y0", "x0e", "y0e")))))


@query(f"with {MOVING} select star_id, {rnd(f'{XX} * vx + {XY} * vy', 'vx')}, {rnd(f'{YX} * vx + {YY} * vy', 'vy')} from mv")
def poly_velocity(spark, d):
    """T4: moved velocities."""
    return moving(spark, d).select("star_id", *model_columns(("vx", "vy"), ORDER2.velocity(*(F.col(c) for c in ("x0", "y0", "vx", "vy")))))


@query(f"""with {MOVING} select star_id, {rnd(f'sqrt(pow((2e-6 * vx - 2e-6 * vy) * x0e, 2) + pow((-2e-6 * vx + 6e-6 * vy) * y0e, 2) + pow({XX} * vxe, 2) + pow({XY} * vye, 2))', 'vxe')},
  {rnd(f'sqrt(pow((-2e-6 * vx + 2e-6 * vy) * x0e, 2) + pow((2e-6 * vx + 2e-6 * vy) * y0e, 2) + pow({YX} * vxe, 2) + pow({YY} * vye, 2))', 'vye')} from mv""")
def poly_velocity_error(spark, d):
    """T5: errors of moved velocities."""
    return moving(spark, d).select(
        "star_id", *model_columns(("vxe", "vye"), ORDER2.velocity_error(*(F.col(c) for c in ("x0", "y0", "vx", "vy", "x0e", "y0e", "vxe", "vye"))))
    )


SHIFTED = models.shift(0.1, 25.0, (0.02, 0.03))


@query(
    f"with {MOVING} select star_id, {rnd('x0 + 0.1', 'x')}, {rnd('y0 + 25', 'y')}, {rnd('sqrt(x0e * x0e + 0.02 * 0.02::double)', 'xe')}, {rnd('sqrt(y0e * y0e + 0.03 * 0.03::double)', 'ye')} from mv"
)
def shift_apply(spark, d):
    """A shift with its error."""
    c = [F.col(k) for k in ("x0", "y0", "x0e", "y0e")]
    return moving(spark, d).select("star_id", *model_columns(("x", "y", "xe", "ye"), (*SHIFTED.position(*c[:2]), *SHIFTED.position_error(*c))))


LEG = models.legendre([0.1, 1.0, 0.02, 0.0, 0.5, 0.01, 0.03, 0.0, 0.2], [0.2, 0.0, 0.01, 1.0, 0.3, 0.02, 0.04, 0.1, 0.0], 2)
L2X, L2Y = "((3 * u * u - 1) / 2)", "((3 * v * v - 1) / 2)"


@query(f"""with {MOVING}, q as (select star_id, x0 / 1000 - 1 as u, y0 / 1000 - 1 as v from mv) select star_id,
  {rnd(f'0.1 + u + 0.02 * {L2X} + 0.5 * u * v + 0.01 * {L2X} * v + 0.03 * {L2Y} + 0.2 * {L2X} * {L2Y}', 'x')}, {rnd(f'0.2 + 0.01 * {L2X} + v + 0.3 * u * v + 0.02 * {L2X} * v + 0.04 * {L2Y} + 0.1 * u * {L2Y}', 'y')} from q""")
def legendre_apply(spark, d):
    """A Legendre series over the mapped domain."""
    u, v = models.to_domain(F.col("x0"), 0.0, 2000.0), models.to_domain(F.col("y0"), 0.0, 2000.0)
    return moving(spark, d).select("star_id", *model_columns(("x", "y"), LEG.position(u, v)))


@query(f"with {MOVING} select star_id, {rnd('x0 / 1000 - 1', 'u', 9)}, {rnd('x0e / 1000', 'ue', 10)} from mv")
def domain_map(spark, d):
    """A domain mapped to [-1, 1]."""
    return moving(spark, d).select(
        "star_id", near(models.to_domain(F.col("x0"), 0.0, 2000.0), 9).alias("u"),
        near(models.error_to_domain(F.col("x0e"), 0.0, 2000.0), 10).alias("ue")
    )


@query(f"with {PAIRS} select star_id, list_id, {rnd('1 / (xe * xe + ye * ye + xe_ref * xe_ref + ye_ref * ye_ref)', 'w')} from pairs")
def fit_weights(spark, d):
    """Weights of matched pairs."""
    return rounded(fits.with_weight(pairs(spark, d), "both,var").select("star_id", "list_id", "w"))


# --- fits


def coefficients(spark: SparkSession, found: fits.Fit, n: int) -> DataFrame:
    rows = [(k[0], *map(float, t.coefficients[0][:n]), *map(float, t.coefficients[1][:n]), t.mag_offset) for k, t in found.items()]
    return spark.createDataFrame(rows, "list_id long, " + ", ".join(f"{c}{i} double" for c in "ab" for i in range(n)) + ", mag_offset double")


def _fit_sql(weight: str, source: str = "pairs", ctes: str = PAIRS) -> str:
    s = lambda p, q: f"sum(w * w * {p} * {q})"
    products = (
        ("u", "u", "uu"), ("u", "v", "uv"), ("v", "v", "vv"), ("u", "x_ref", "ux"), ("v", "x_ref", "vx"), ("u", "y_ref", "uy"), ("v", "y_ref", "vy"),
        ("u", "1", "u1"), ("v", "1", "v1"), ("1", "1", "n1"), ("x_ref", "1", "x1"), ("y_ref", "1", "y1")
    )
    sums = ", ".join(f"{s(p, q)} as {n}" for p, q, n in products)
    # centred by the weighted means, so the constant drops out
    out = []
    for c in "xy":
        a, b = f"((u{c} * vv - v{c} * uv) / (uu * vv - uv * uv))", f"((v{c} * uu - u{c} * uv) / (uu * vv - uv * uv))"
        k = "a" if c == "x" else "b"
        out += [rnd(f"{c}1 / n1 - {a} * cx - {b} * cy", f"{k}0", 5), rnd(a, f"{k}1", 7), rnd(b, f"{k}2", 7)]
    return f"""with {ctes}, p as (select *, {weight} as w from {source}), c as (select list_id, sum(w * w * x) / sum(w * w) as cx, sum(w * w * y) / sum(w * w) as cy from p group by 1),
  q as (select p.*, x - cx as u, y - cy as v, cx, cy from p join c using (list_id)), s as (select list_id, any_value(cx) as cx, any_value(cy) as cy, {sums}, avg(m_ref - m) as dm from q group by 1)
  select list_id, {', '.join(out)}, {rnd('dm', 'mag_offset')} from s"""


def _regressed_sql(source: str, basis: list[str]) -> str:
    """The rows of ``source`` with the least-squares values x_fit, y_fit of x_ref, y_ref list by list: the basis made orthogonal term by term."""
    over = lambda e: f"sum({e}) over (partition by list_id)"
    at = f"select *, (x - 650) / 400 as u, (y - 650) / 400 as v from {source}"
    for k, term in enumerate(basis):
        less = "".join(f" - {over(f'({term}) * q{j}')} / {over(f'q{j} * q{j}')} * q{j}" for j in range(k))
        at = f"select *, {term}{less} as q{k} from ({at})"
    fit = lambda c: " + ".join(f"{over(f'{c}_ref * q{k}')} / {over(f'q{k} * q{k}')} * q{k}" for k in range(len(basis)))
    drop = ", ".join(["u", "v", *(f"q{k}" for k in range(len(basis)))])
    return f"select * exclude ({drop}), {fit('x')} as x_fit, {fit('y')} as y_fit from ({at})"


def _clipped_sql(rounds: int = 3) -> str:
    out, source = [f"k0 as ({_regressed_sql('pairs', ['1.0', 'u', 'v'])})"], "k0"
    over = lambda f, e: f"{f}({e}) over (partition by list_id)"
    for k in range(1, rounds + 1):
        dx, dy = "x_ref - x_fit", "y_ref - y_fit"
        stats = f"sqrt(pow({over('avg', dx)}, 2) + pow({over('avg', dy)}, 2)) as centre, sqrt({over('var_pop', dx)} + {over('var_pop', dy)}) as spread"
        kept = f"(select * exclude (x_fit, y_fit, centre, spread) from (select *, {stats} from {source}) where abs(sqrt(pow({dx}, 2) + pow({dy}, 2)) - centre) <= 3 * spread)"
        out.append(f"k{k} as ({_regressed_sql(kept, ['1.0', 'u', 'v'])})")
        source = f"k{k}"
    return f"with {PAIRS}, {', '.join(out)} select star_id, list_id, {rnd('x_fit', 'x', 5)}, {rnd('y_fit', 'y', 5)} from {source}"


def _moved(df: DataFrame) -> DataFrame:
    return df.select("star_id", "list_id", near(F.col("x"), 5).alias("x"), near(F.col("y"), 5).alias("y"))


def rounded_fit(df: DataFrame) -> DataFrame:
    return df.select(
        "list_id", *((near(F.col(c), 5 if c[1] == "0" else 7)).alias(c) for c in df.columns if c[0] in "ab"),
        near(F.col("mag_offset"), 6).alias("mag_offset")
    )


@query(_fit_sql("1.0::double"))
def poly_fit(spark, d):
    """an affine transform of each list to the stars' places."""
    return rounded_fit(coefficients(spark, fits.fit(pairs(spark, d), 1, by=["list_id"]), 3))


@query(_fit_sql("1 / (xe * xe + ye * ye + xe_ref * xe_ref + ye_ref * ye_ref)"))
def poly_fit_weighted(spark, d):
    """F1 with weights."""
    return rounded_fit(coefficients(spark, fits.fit(fits.with_weight(pairs(spark, d), "both,var"), 1, by=["list_id"]), 3))


ORDER2_TERMS = ["1.0", "u", "v", "u * u", "u * v", "v * v"]


@query(f"with {PAIRS}, f as ({_regressed_sql('pairs', ORDER2_TERMS)}) select star_id, list_id, {rnd('x_fit', 'x', 5)}, {rnd('y_fit', 'y', 5)} from f")
def poly_fit_order2(spark, d):
    """F1 of order 2, T7: the readings moved by each list's fit."""
    p = pairs(spark, d)
    return _moved(fits.applied_by_table(p, fits.fit(p, 2, by=["list_id"]), ["list_id"]))


@query(
    f"with {PAIRS}, f as ({_regressed_sql('pairs', ['1.0', 'u', 'v', 'u * v'])}) select star_id, list_id, {rnd('x_fit', 'x', 5)}, {rnd('y_fit', 'y', 5)} from f"
)
def legendre_fit(spark, d):
    """The readings moved by each list's Legendre series on the mapped domain."""
    p = pairs(spark, d)
    p = p.withColumns({c: models.to_domain(F.col(c), 0.0, 2000.0) for c in ("x", "y")})
    return _moved(fits.applied(p, fits.fit(p, 1, by=["list_id"], kind="legendre"), ["list_id"]))


@query(_clipped_sql())
def poly_fit_clipped(spark, d):
    """The readings that stay when outliers are clipped in rounds, moved by the last fit."""
    found, kept = fits.fit_clipped(pairs(spark, d), 1, by=["list_id"])
    return _moved(fits.applied_by_table(kept, found, ["list_id"]))


TURNED = "(select star_id, list_id, x_ref as x, y_ref as y, m_ref as m, x as x_ref, y as y_ref, m as m_ref from pairs)"


@query(_fit_sql("1.0::double", TURNED))
def inverse_fit(spark, d):
    """The inverse transforms."""
    return rounded_fit(coefficients(spark, fits.fit_inverse(pairs(spark, d), 1, by=["list_id"]), 3))


@query(
    f"with {PAIRS} select list_id, {rnd('avg(x_ref - x)', 'dx', 7)}, {rnd('avg(y_ref - y)', 'dy', 7)}, {rnd('stddev_samp(x_ref - x) / sqrt(count(*))', 'dxe', 7)}, {rnd('stddev_samp(y_ref - y) / sqrt(count(*))', 'dye', 7)}, count(*) as n from pairs group by 1"
)
def shift_fit(spark, d):
    """mean shifts of each list."""
    return rounded(fits.shift_sums(pairs(spark, d), ["list_id"]), 7)


@query(f"""with {PAIRS}, c as (select list_id, avg(x) as cx, avg(y) as cy, avg(x_ref) as rx, avg(y_ref) as ry from pairs group by 1),
  s as (select list_id, any_value(cx) as cx, any_value(cy) as cy, any_value(rx) as rx, any_value(ry) as ry, sum((x - cx) * (x - cx) + (y - cy) * (y - cy)) as den, sum((x - cx) * (x_ref - rx) + (y - cy) * (y_ref - ry)) as n1, sum((y - cy) * (x_ref - rx) - (x - cx) * (y_ref - ry)) as n2 from pairs join c using (list_id) group by 1)
  select list_id, {rnd('rx - n1 / den * cx - n2 / den * cy', 'a0', 4)}, {rnd('n1 / den', 'a1', 6)}, {rnd('n2 / den', 'a2', 6)}, {rnd('ry + n2 / den * cx - n1 / den * cy', 'b0', 4)} from s""")
def similarity_fit(spark, d):
    """a similarity of each list."""
    s = fits.similarity_sums(pairs(spark, d), ["list_id"])
    return s.select("list_id", *(near(F.col(c), k).alias(c) for c, k in (("a0", 4), ("a1", 6), ("a2", 6), ("b0", 4))))


R = "sqrt((x_ref - x) * (x_ref - x) + (y_ref - y) * (y_ref - y))"


@query(
    f"with {PAIRS}, s as (select list_id, stddev_pop({R}) as s from pairs group by 1) select star_id, list_id from pairs join s using (list_id) where {R} < 2.5 * s"
)
def outlier_reject(spark, d):
    """Pairs within 2.5 spreads, list by list."""
    return fits.outlier_rejection(pairs(spark, d), 2.5, ["list_id"]).select("star_id", "list_id")


@query(
    f"with {PAIRS}, s as (select list_id, stddev_pop({R}) as s from pairs group by 1) select star_id, list_id from pairs join s using (list_id) where {R} <= 3 * s"
)
def residual_cut(spark, d):
    """Residuals cut at three spreads."""
    return fits.residual_sigma_cut(pairs(spark, d), 3.0, ["list_id"]).select("star_id", "list_id")


# --- combining


def _combine_sql(v: str, w: str, e: str, out: str, weighted: bool) -> str:
    parts = [f"{READINGS}, c0 as (select star_id, v, w from (select star_id, {v} as v, {w} as w from readings) where v is not null and w is not null)"]
    for k in range(5):
        parts.append(
            f"s{k} as (select star_id, median(v) as c, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) as s from c{k} group by 1), c{k + 1} as (select c{k}.* from c{k} join s{k} using (star_id) where v >= c - 3 * s - 1e-12 and v <= c + 3 * s + 1e-12)"
        )
    parts.append(
        f"m as (select star_id, sum(w * v) / sum(w) as mean, count(*) as n from c5 group by 1), z as (select star_id, sum(w * (v - mean) * (v - mean)) / sum(w) as var from c5 join m using (star_id) group by 1), e as (select star_id, avg({e}) as e from readings group by 1)"
    )
    return f"with {', '.join(parts)} {out}"


WX = f"(case when {fin('xe')} <> 0 then 1 / (xe * xe) end)"
OUT_X = f"select e.star_id, {rnd('mean', 'x0')}, {rnd('case when n = 1 then e else sqrt(var) end', 'x0e')}, coalesce(n, 0)::bigint as n from e left join m using (star_id) left join z using (star_id)"


@query(_combine_sql(fin("x"), WX, fin("xe"), OUT_X, True))
def combine_weighted(spark, d):
    """G1: clipped, weighted mean places."""
    return rounded(combine.combine_lists(readings(spark, d), "x", "xe").withColumn("n", F.col("n").cast("bigint")))


@query(
    _combine_sql(
        fin("y"), "1.0", "0.0",
        f"select e.star_id, {rnd('mean', 'y0', 9)}, {rnd('sqrt(var)', 'y0e', 5)}, coalesce(n, 0)::bigint as n from e left join m using (star_id) left join z using (star_id)",
        False
    )
)
def combine_plain(spark, d):
    """G1 without weights."""
    c = combine.combine_lists(readings(spark, d), "y")
    return c.select("star_id", near(F.col("y0"), 9).alias("y0"), near(F.col("y0e"), 5).alias("y0e"), F.col("n").cast("bigint").alias("n"))


@query(
    f"with {READINGS} select star_id, {rnd(f'-2.5 * log10(avg(pow(10.0, -{fin("m")} / 2.5)))', 'm_avg')} from readings where abs({fin('m')}) < 40 group by 1"
)
def mean_magnitude(spark, d):
    """Mean magnitudes in flux."""
    return rounded(combine.mean_magnitude(readings(spark, d).where(F.abs(finite("m")) < 40)))


FLUX_OF, FLUX_E = f"pow(10.0, -{fin('m')} / 2.5)", f"({fin('me')} * pow(10.0, -{fin('m')} / 2.5) * {combine.FLUX!r}::double)"


def _combined_sql(c: str) -> str:
    """star_id, <c>0, <c>0e, n of a weighted, clipped mean; magnitudes as fluxes."""
    if c == "m":
        v, e = FLUX_OF, FLUX_E
        out, err = "-2.5 * log10(mean)", f"(case when n = 1 then e else sqrt(var) end) / {combine.FLUX!r}::double / mean"
    else:
        v, e = fin(c), fin(f"{c}e")
        out, err = "mean", "case when n = 1 then e else sqrt(var) end"
    end = f"select e.star_id, {rnd(out, f'{c}0')}, {rnd(err, f'{c}0e')}, coalesce(n, 0)::bigint as n from e left join m using (star_id) left join z using (star_id)"
    return _combine_sql(v, f"(case when {e} <> 0 then 1 / ({e} * {e}) end)", e, end, True)


@query(_combined_sql("m"))
def combine_magnitude(spark, d):
    """Magnitudes combined as weighted fluxes."""
    return rounded(combine.combine_lists(readings(spark, d), "m", "me", ismag=True).withColumn("n", F.col("n").cast("bigint")))


@query(
    f"select star_id, x0, x0e, y0, y0e, m0, m0e from ({_combined_sql('x')}) a join ({_combined_sql('y')}) b using (star_id) join ({_combined_sql('m')}) c using (star_id)"
)
def combine_all(spark, d):
    """Places and magnitudes."""
    return rounded(combine.combine_lists_xym(readings(spark, d)))


@query(f"""with {READINGS}, g as (select star_id, {fin('x')} as v, {fin('xe')} as e from readings), h as (select star_id, v, e, 1 / (e * e) as w from g where v is not null and e > 0), m as (select star_id, sum(w * v) / sum(w) as mean, sum(w) as sw, count(*) as n, any_value(e) as e1 from h group by 1),
  z as (select star_id, sum(w * (v - mean) * (v - mean)) as ss from h join m using (star_id) group by 1) select star_id, {rnd('mean', 'x')}, {rnd('case when n = 1 then e1 else sqrt(ss / sw) end', 'xe')} from m join z using (star_id)""")
def stitch_mean(spark, d):
    """Means of stitched frames."""
    return rounded(combine.stitch_mean(readings(spark, d), "x", "xe"))


@query(f"with {READINGS} select star_id, {rnd(f'avg({fin("y")})', 'y', 9)} from readings group by 1")
def plain_mean(spark, d):
    """Plain means."""
    return rounded(combine.plain_mean(readings(spark, d), "y"), 9)


# --- motions


def plausible(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d).select("star_id", "list_id", *(finite(c).alias(c) for c in ("t", "x", "y", "m", "xe", "ye", "me")))
    return r.where("t is not null and abs(x) < 10000 and abs(y) < 10000 and xe > 0 and ye > 0")


PLAUSIBLE = f"{READINGS}, good as (select star_id, list_id, t, x, y, {fin('m')} as m, xe, ye, {fin('me')} as me from readings where {fin('t')} is not null and abs({fin('x')}) < 10000 and abs({fin('y')}) < 10000 and {fin('xe')} > 0 and {fin('ye')} > 0)"


def loose(spark: SparkSession, d: str) -> DataFrame:
    """All distinct readings; values beyond the field and errors that can't be count as missing."""
    r = readings(spark, d).select("star_id", "list_id", *(finite(c).alias(c) for c in ("t", "x", "y", "xe", "ye")))
    within = F.coalesce((F.abs("x") < 10000) & (F.abs("y") < 10000), F.lit(False))
    return r.withColumns({**{c: F.when(within, F.col(c)) for c in "xy"}, **{c: F.when(F.col(c) > 0, F.col(c)) for c in ("xe", "ye")}})


LOOSE = f"""{READINGS}, loose as (select star_id, list_id, {fin('t')} as t, case when abs({fin('x')}) < 10000 and abs({fin('y')}) < 10000 then x end as x, case when abs({fin('x')}) < 10000 and abs({fin('y')}) < 10000 then y end as y,
  case when {fin('xe')} > 0 then xe end as xe, case when {fin('ye')} > 0 then ye end as ye from readings)"""


def _motions_sql(power: int, source: str = "loose", complete: int | None = None) -> str:
    """Motions with every branch: no epoch, one time, two epochs, more; missing errors filled by the star's mean."""
    w = lambda c: f"(1 / ({c}e * {c}e))" if power == 2 else f"(1 / {c}e)"
    mean = lambda c: f"avg(case when x is not null then {c} end) over (partition by star_id)"
    fill = {c: c if complete else f"coalesce({c}, {mean(c)}, 1.0)" for c in ("xe", "ye")}
    sums = ", ".join(
        f"sum({w(c)}) as s{c}, sum({w(c)} * d) as sd{c}, sum({w(c)} * d * d) as sdd{c}, sum({w(c)} * {c}) as sv{c}, sum({w(c)} * d * {c}) as sdv{c}, max_by({c}, t) as l{c}, min_by({c}, t) as f{c}" for c in "xy"
    )
    det = lambda c: f"(sdd{c} * s{c} - sd{c} * sd{c})"
    fit = ", ".join(
        f"case when span <= 1e-9 then 0 when n = 2 then (l{c} - f{c}) / span else (s{c} * sdv{c} - sd{c} * sv{c}) / {det(c)} end as v{c}, case when span <= 1e-9 or n = 2 then sv{c} / s{c} else (sdd{c} * sv{c} - sd{c} * sdv{c}) / {det(c)} end as {c}0" for c in "xy"
    )
    chi = ", ".join(f"sum(pow({c} - {c}0 - v{c} * d, 2) * {w(c)}) as chi{c}" for c in "xy")
    out = []
    for c in "xy":
        out += [
            rnd(f"{c}0", f"{c}0", 5),
            rnd(f"case when span <= 1e-9 then sqrt(chi{c} / s{c}) when n = 2 then abs(l{c} - f{c}) / sqrt(2.0) else sqrt(sdd{c} / {det(c)}) end", f"{c}0e", 5),
            rnd(f"v{c}", f"v{c}", 5)
        ]
        out += [
            rnd(f"case when span <= 1e-9 or n = 2 then 0 else sqrt(s{c} / {det(c)}) end", f"v{c}e", 5),
            rnd(f"case when span <= 1e-9 then 0 else chi{c} end", f"chi2_v{c}", 2)
        ]
    having = f"having count(*) >= {complete}" if complete else ""
    return f"""with {LOOSE}, src as (select * from {source}), filled as (select star_id, t, x, y, {fill['xe']} as xe, {fill['ye']} as ye from src),
  ok as (select *, 1 / sqrt(xe * xe + ye * ye) as w from filled where t is not null and x is not null and y is not null and xe is not null and ye is not null), z as (select star_id, sum(t * w) / sum(w) as t0 from ok group by 1),
  q as (select ok.*, t - t0 as d, t0 from ok join z using (star_id)), g as (select star_id, any_value(t0) as t0, count(*) as n, max(t) - min(t) as span, {sums} from q group by 1 {having}), h as (select *, {fit} from g),
  k as (select star_id, {chi} from (select q.*, h.x0, h.y0, h.vx, h.vy from q join h using (star_id)) group by 1), every as (select distinct star_id from readings)
  select every.star_id, {', '.join(out)}, {rnd('t0', 't0', 5)}, coalesce(n, 0)::bigint as n_vfit from every left join h using (star_id) left join k using (star_id)"""


def _motions(df: DataFrame) -> DataFrame:
    digits = {"chi2_vx": 2, "chi2_vy": 2}
    return df.select(*(near(F.col(c), digits.get(c, 5)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(_motions_sql(2))
def motion_fit_var(spark, d):
    """Motions weighted by inverse variance, of stars with any number of epochs."""
    return _motions(motion.fit_velocities(loose(spark, d)))


@query(_motions_sql(1))
def motion_fit_std(spark, d):
    """G8 weighted by inverse errors."""
    return _motions(motion.fit_velocities(loose(spark, d), "std"))


COMPLETE = (3, 5, 7, 9)


@query(_motions_sql(2, f"(select * from loose where list_id in {COMPLETE})", len(COMPLETE)))
def motion_fit_complete(spark, d):
    """Motions of the stars that are usable in all of the chosen lists; the others have none."""
    return _motions(motion.fit_complete(loose(spark, d), list(COMPLETE)))


@query(f"""with {PLAUSIBLE}, c as (select star_id, sum(t / (xe * xe)) / sum(1 / (xe * xe)) as c, sum(1 / (xe * xe)) as s, sum(x / (xe * xe)) as sy, count(*) as n from good group by 1),
  q as (select star_id, any_value(c) as c, any_value(s) as s, any_value(sy) as sy, any_value(n) as n, sum((t - c) * (t - c) / (xe * xe)) as sdd, sum((t - c) * x / (xe * xe)) as sdy from good join c using (star_id) group by 1)
  select star_id, {rnd('sdy / sdd', 'slope', 5)}, {rnd('sqrt(1 / sdd)', 'slope_err', 5)}, n from q where n >= 3""")
def line_fit(spark, d):
    """Weighted lines."""
    return rounded(motion.line_fit(plausible(spark, d), ["star_id"], "t", "x", "xe").where("n >= 3").select("star_id", "slope", "slope_err", "n"), 5)


@query(f"with {PLAUSIBLE} select star_id, {rnd('sum(pow((x - 0.1 * (t - 2016) - 200) / 50, 2))', 'chi2', 5)} from (select * from good) group by 1")
def line_chi2(spark, d):
    """Chi squares of a given line."""
    p = plausible(spark, d).withColumns({"dt": F.col("t") - 2016, "s": F.lit(50.0)})
    return rounded(motion.line_chi2(p, ["star_id"], "dt", "x", "s", F.lit(0.1), F.lit(200.0)), 5)


def _polynomial_sql() -> str:
    """Parabolas in time by Cramer's rule on the weighted sums of powers."""
    sums = ", ".join(
        ", ".join(
            [*(f"sum(pow(d, {k}) / ({c}e * {c}e)) as s{c}{k}" for k in range(5)), *(f"sum(pow(d, {k}) * {c} / ({c}e * {c}e)) as t{c}{k}" for k in range(3))]
        ) for c in "xy"
    )

    def minors(c: str) -> dict[str, str]:
        s = [f"s{c}{k}" for k in range(5)]
        return {
            "00": f"({s[2]} * {s[4]} - {s[3]} * {s[3]})", "01": f"({s[1]} * {s[4]} - {s[2]} * {s[3]})", "02": f"({s[1]} * {s[3]} - {s[2]} * {s[2]})",
            "11": f"({s[0]} * {s[4]} - {s[2]} * {s[2]})", "12": f"({s[0]} * {s[3]} - {s[1]} * {s[2]})", "22": f"({s[0]} * {s[2]} - {s[1]} * {s[1]})"
        }

    fit = []
    for c in "xy":
        m, t = minors(c), [f"t{c}{k}" for k in range(3)]
        det = f"(s{c}0 * {m['00']} - s{c}1 * {m['01']} + s{c}2 * {m['02']})"
        fit += [
            f"case when n > 2 then ({t[0]} * {m['00']} - {t[1]} * {m['01']} + {t[2]} * {m['02']}) / {det} end as p{c}0",
            f"case when n > 2 then (-{t[0]} * {m['01']} + {t[1]} * {m['11']} - {t[2]} * {m['12']}) / {det} end as p{c}1"
        ]
        fit += [
            f"case when n > 2 then ({t[0]} * {m['02']} - {t[1]} * {m['12']} + {t[2]} * {m['22']}) / {det} end as p{c}2",
            *(f"{m[f'{k}{k}']} / {det} as i{c}{k}" for k in range(3))
        ]
    out = [rnd("t0", "t0", 5), "n", "n - 3 as dof"]
    for c in "xy":
        for k, name in enumerate((f"{c}0", f"v{c}", f"a{c}")):
            out += [rnd(f"p{c}{k}", name, 4), rnd(f"case when n > 3 then sqrt(i{c}{k} * chi{c} / (n - 3)) end", f"{name}e", 4)]
        out.append(rnd(f"chi{c}", f"chi2{c}", 3))
    chi = ", ".join(f"sum(pow(({c} - p{c}0 - p{c}1 * d - p{c}2 * d * d) / {c}e, 2)) as chi{c}" for c in "xy")
    return f"""with {PLAUSIBLE}, z as (select star_id, sum(t / sqrt(xe * xe + ye * ye)) / sum(1 / sqrt(xe * xe + ye * ye)) as t0 from good group by 1), q as (select good.*, t - t0 as d, t0 from good join z using (star_id)),
  g as (select star_id, any_value(t0) as t0, count(*) as n, {sums} from q group by 1), f as (select star_id, t0, n, {', '.join(fit)} from g), k as (select star_id, {chi} from q join f using (star_id) group by 1)
  select star_id, {', '.join(out)} from f join k using (star_id)"""


@query(_polynomial_sql())
def motion_polynomial(spark, d):
    """Motions with an acceleration."""
    p = motion.polynomial_motion(plausible(spark, d), 2)
    part = lambda c: [F.get(f"p{c}{e}", F.lit(k)).alias(f"{n}{e}") for k, n in enumerate((f"{c}0", f"v{c}", f"a{c}")) for e in ("", "e")]
    p = p.select("star_id", "t0", "n", "dof", *part("x"), "chi2x", *part("y"), "chi2y")
    digits = {"t0": 5, "chi2x": 3, "chi2y": 3}
    return p.select(*(near(F.col(c), digits.get(c, 4)).alias(c) if t == "double" else F.col(c) for c, t in p.dtypes))


@query()
def motion_bootstrap(spark, d):
    """Spreads of motions under resampled epochs."""
    return motion.bootstrap_velocities(plausible(spark, d), 100)


# --- diagnostics


def modelled(spark: SparkSession, d: str) -> DataFrame:
    """Plausible readings with the motions fitted to them."""
    p = plausible(spark, d)
    v = motion.fit_velocities(p).where("n_vfit >= 3")
    m = combine.mean_magnitude(p.where("abs(m) < 40")).withColumnRenamed("m_avg", "m0")
    return quality.modelled(p.where("abs(m) < 40 or m is null"), v.join(m, "star_id", "left"))




def _modelled_sql() -> str:
    det = lambda c: f"(sdd{c} * s{c} - sd{c} * sd{c})"
    sums = ", ".join(
        f"sum(1 / ({c}e * {c}e)) as s{c}, sum(d / ({c}e * {c}e)) as sd{c}, sum(d * d / ({c}e * {c}e)) as sdd{c}, sum({c} / ({c}e * {c}e)) as sv{c}, sum(d * {c} / ({c}e * {c}e)) as sdv{c}" for c in "xy"
    )
    fit = ", ".join(f"(sdd{c} * sv{c} - sd{c} * sdv{c}) / {det(c)} as {c}0, (s{c} * sdv{c} - sd{c} * sv{c}) / {det(c)} as v{c}" for c in "xy")
    return f"""{PLAUSIBLE}, z as (select star_id, sum(t / sqrt(xe * xe + ye * ye)) / sum(1 / sqrt(xe * xe + ye * ye)) as t0 from good group by 1), q as (select good.*, t - t0 as d, t0 from good join z using (star_id)),
  s as (select star_id, any_value(t0) as t0, {sums} from q group by 1 having count(*) >= 3), fit as (select star_id, t0, {fit} from s), mm as (select star_id, -2.5 * log10(avg(pow(10.0, -m / 2.5))) as m0 from good where abs(m) < 40 group by 1),
  md as (select g.*, f.x0, f.y0, g.x - (f.x0 + f.vx * (g.t - f.t0)) as dx, g.y - (f.y0 + f.vy * (g.t - f.t0)) as dy, g.m - mm.m0 as dm from good g join fit f using (star_id) left join mm using (star_id) where abs(g.m) < 40 or g.m is null)"""


MD = _modelled_sql()


@query(
    f"with {MD} select list_id, count(*) as n, {', '.join(rnd(f'{f}(abs(d{c}))', f'd{c}_{n}', 5) for c in 'xym' for f, n in (('avg', 'mean'), ('stddev_pop', 'std')))} from md group by 1"
)
def resid_by_epoch(spark, d):
    """Mean residuals of each list."""
    return rounded(quality.residuals_by_epoch(modelled(spark, d)), 5)


@query(f"with {MD} select list_id, star_id, {rnd('dx * 1000', 'dx', 4)}, {rnd('dy * 1000', 'dy', 4)} from md")
def quiver_residuals(spark, d):
    """Residuals of every reading."""
    return rounded(quality.quiver(modelled(spark, d)).select("list_id", "star_id", "dx", "dy"), 4)


@query(f"with {MD} select star_id, count(*) as n, {rnd('avg(sqrt(dx * dx + dy * dy))', 'dr_mean', 5)} from md group by 1")
def resid_per_star(spark, d):
    """Mean residual of each star."""
    return rounded(quality.mean_residual_per_star(modelled(spark, d)), 5)


@query(
    f"with {MD} select star_id, count(*) as n_detect, {rnd('sum(pow(dx / xe, 2))', 'chi2_x', 3)}, {rnd('sum(pow(dy / ye, 2))', 'chi2_y', 3)}, count(*) - 2 as dof from md group by 1"
)
def chi2_per_star(spark, d):
    """Chi squares of each star's motion."""
    return rounded(quality.chi2_per_star(modelled(spark, d)), 3)


@query(
    f"with {MD}, c as (select star_id, count(*) - 2 as dof, sum(pow(dx / xe, 2)) as cx, sum(pow(dy / ye, 2)) as cy from md group by 1) select count(*) as n, {rnd('median(cx / dof)', 'red_chi2_x', 5)}, {rnd('median(cy / dof)', 'red_chi2_y', 5)} from c where dof > 0"
)
def chi2_medians(spark, d):
    """Medians of the reduced chi squares."""
    return rounded(quality.chi2_medians(quality.chi2_per_star(modelled(spark, d))), 5)


@query(
    f"with {MD} select star_id, count(*) as n_detect, {rnd('sum(pow(dm / me, 2))', 'chi2_m', 3)}, {rnd('case when count(*) > 1 then sum(pow(dm / me, 2)) / (count(*) - 1) end', 'red_chi2_m', 3)} from md where me > 0 and dm is not null group by 1"
)
def chi2_magnitude(spark, d):
    """Chi squares of magnitudes."""
    return rounded(quality.chi2_mag_per_star(modelled(spark, d)), 3)


@query(
    f"with {MD} select star_id, list_id, f.field from md, (values ('x'), ('y'), ('m')) f(field) where case f.field when 'x' then abs(dx / xe) > 4 when 'y' then abs(dy / ye) > 4 else me > 0 and abs(dm / me) > 4 end"
)
def sigma_flags(spark, d):
    """Readings more than four errors off."""
    return quality.sigma_flags(modelled(spark, d))


RADIUS = "sqrt(x0 * x0 + y0 * y0)"
RADIAL = {
    "d_r": f"(dx * x0 + dy * y0) / {RADIUS}", "d_t": f"(dx * y0 - dy * x0) / {RADIUS}",
    "d_r_err": f"sqrt(pow(xe * x0, 2) + pow(ye * y0, 2)) / {RADIUS}", "d_t_err": f"sqrt(pow(xe * y0, 2) + pow(ye * x0, 2)) / {RADIUS}",
}


@query(f"with {MD} select star_id, list_id, {', '.join(rnd(e, n, 5) for n, e in RADIAL.items())} from md where x0 * x0 + y0 * y0 > 0")
def radial_tangential(spark, d):
    """Residuals along and across the radius, with their errors."""
    return rounded(quality.radial_tangential(modelled(spark, d)), 5)


@query(
    f"with {MD} select star_id, list_id, {rnd('(dx * cos(radians(-30)) - dy * sin(radians(-30))) / 0.04', 'dx_orig', 4)}, {rnd('sqrt(dx * dx + dy * dy) / 0.04', 'modulus', 4)} from md"
)
def original_frame(spark, d):
    """Residuals turned into the original frame."""
    return rounded(quality.original_frame(modelled(spark, d), 30.0).select("star_id", "list_id", "dx_orig", "modulus"), 4)


@query(
    f"with {PAIRS}, p as (select floor((m_ref - m) / 0.5) as b from pairs) select b::bigint as bin, count(*) as n, {rnd('b * 0.5', 'low')} from p group by b"
)
def magnitude_histogram(spark, d):
    """Differences of magnitudes by bins."""
    return rounded(quality.histogram(quality.residuals(pairs(spark, d)), "dm", 0.5))


@query(
    f"with {PAIRS}, p as (select floor((x_ref - x) / 0.25) as b from pairs) select b::bigint as bin, count(*) as n, {rnd('b * 0.25', 'low')} from p group by b"
)
def position_histogram(spark, d):
    """Differences of places by bins."""
    return rounded(quality.histogram(quality.residuals(pairs(spark, d)), "dx", 0.25))


CHI = "(pow((x_ref - x) / sqrt(xe * xe + xe_ref * xe_ref), 2) + pow((y_ref - y) / sqrt(ye * ye + ye_ref * ye_ref), 2))"


@query(
    f"with {PAIRS} select list_id, {rnd(f'sum({CHI})', 'chi2', 2)}, count(*) as n, 2 * count(*) - 6 as dof, {rnd(f'sum({CHI}) / (2 * count(*) - 6)', 'red_chi2', 3)} from pairs group by 1 having 2 * count(*) > 6"
)
def chi2_alignment(spark, d):
    """Chi square of each list's alignment under six parameters."""
    out = quality.alignment_chi2(pairs(spark, d), 6, by=["list_id"]).where("dof > 0")
    return out.select("list_id", near(F.col("chi2"), 2).alias("chi2"), "n", "dof", near(F.col("red_chi2"), 3).alias("red_chi2"))


IN = "(abs((x_ref - x) / sqrt(xe * xe + xe_ref * xe_ref)) < 10 and abs((y_ref - y) / sqrt(ye * ye + ye_ref * ye_ref)) < 10)"


@query(
    f"with {PAIRS} select count(*) as n, {rnd(f'sum({CHI})', 'chi2', 1)}, sum(case when {IN} then 1 else 0 end)::bigint as n_in, {rnd(f'sum(case when {IN} then {CHI} end)', 'chi2_in', 1)} from pairs"
)
def error_ratios(spark, d):
    """D3: residuals over errors with and without outliers."""
    return rounded(quality.error_ratios(pairs(spark, d))[1], 1)


@query(
    f"with {STARS} select star_id, {rnd(f'sqrt({fin("x0")} * {fin("x0")} + {fin("y0")} * {fin("y0")})', 'r', 5)}, {rnd(f'({fin("vxe")} + {fin("vye")}) / 2 * 1000', 'pm_err', 6)} from stars"
)
def errors_by_magnitude(spark, d):
    """Radius and errors of each star."""
    s = stars(spark, d).withColumns({c: finite(c) for c in ("x0", "y0", "x0e", "y0e", "vxe", "vye")})
    return quality.errors_by_magnitude(s).select("star_id", near(F.col("r"), 5).alias("r"), near(F.col("pm_err"), 6).alias("pm_err"))


@query("select row_id, list_id from starlist where x > -1000 and y > -1000 and m > 14 and m < 18 and not isnan(x) and not isnan(y) and not isnan(m)")
def sky_view(spark, d):
    """Readings with real places within magnitudes."""
    return quality.sky_view(table(spark, d, "starlist").withColumn("m", finite("m")), (14, 18)).select("row_id", "list_id")


@query(f"with {MD} select {rnd('regr_slope(dy, m)', 'slope', 7)}, {rnd('regr_intercept(dy, m)', 'intercept', 6)} from md where m is not null")
def charge_trend_line(spark, d):
    """The linear trend of residuals with magnitude."""
    t = quality.trend_line(modelled(spark, d).where("m is not null"), "m", "dy")
    return t.select(near(F.col("slope"), 7).alias("slope"), near(F.col("intercept"), 6).alias("intercept"))


@query()
def charge_trend_power(spark, d):
    """The power law of residuals with magnitude."""
    return spark.createDataFrame([quality.power_trend(modelled(spark, d), "m", "dy", 15.0)], "a double, m0 double, alpha double, m1 double")


# --- files


LIS = "printf('%-13s  %6.3f  %8.3f  %9.3f  %9.3f  %9.3f  %9.3f  %20.4f  %6.2f  %8d  %20.0f', coalesce(name, ''), " + ", ".join(
    f"coalesce({fin(c)}, 0)::double" for c in ("m", "t", "x", "y", "xe", "ye", "snr", "corr")
) + ", n_frames::bigint, flux::double)"


@query(f"select {LIS} as value from starlist where n_frames is not null and flux is not null")
def lis_lines(spark, d):
    """Star lists as lines of .lis files."""
    s = table(spark, d, "starlist").where("n_frames is not null and flux is not null").withColumns(
        {c: F.coalesce(finite(c), F.lit(0.0)) for c in ("m", "t", "x", "y", "xe", "ye", "snr", "corr")}
    )
    return catalogs.to_lis_lines(s)


WIDE = {
    "name": "coalesce(name, '')", **{c: f"coalesce({fin(c)}, 0)::double" for c in ("m", "t", "x", "y", "xe", "ye", "snr", "corr")},
    "n_frames": "coalesce(n_frames, 0)::bigint", "flux": "coalesce(flux, 0)::double"
}


@query("select printf('" + " ".join(catalogs.WIDTHS[c] for c in WIDE) + "', " + ", ".join(WIDE.values()) + ") as value from starlist")
def fixed_width_lines(spark, d):
    """Star lists as lines of fixed width."""
    s = table(spark, d, "starlist")
    return catalogs.to_fixed_width(
        s.select(
            F.coalesce("name", F.lit("")).alias("name"),
            *(F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in ("m", "t", "x", "y", "xe", "ye", "snr", "corr")),
            F.coalesce("n_frames", F.lit(0)).alias("n_frames"), F.coalesce("flux", F.lit(0)).alias("flux")
        )
    )


# --- further tables and diagnostics


def two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "starlist_ext").select("list_id", F.col("ext_id").alias("id"), "x", "y", "m")
    return e.where("list_id = 61").drop("list_id"), e.where("list_id = 62").drop("list_id")


def _tagged_sql() -> str:
    side = lambda k: f"select 0 as list_id, ext_id as id, x, y, {fin('m')} as m from starlist_ext where list_id = {k} and {fin('x')} is not null and {fin('y')} is not null"
    part = lambda k, i, name: f"select '{name}' as source, ext_id as id, {fin('x')} as x, {fin('y')} as y, ext_id in (select id_{i} from q where sm = 1 and sd = 1) as matched from starlist_ext where list_id = {k}"
    return f"with a as ({side(61)}), b as ({side(62)}), {_match_ctes(3.0, None)} {part(61, 1, 'reference')} union all {part(62, 2, 'list')}"


@query(_tagged_sql())
def tagged_positions(spark, d):
    """The rows of two lists and whether they are matched."""
    a, b = two_lists(spark, d)
    t = quality.tagged_positions(a, b, crossmatch.cross_match(a, b, 3.0))
    return t.withColumns({c: finite(c) for c in "xy"})


@query(
    f"with {PAIRS} select star_id, list_id, {rnd('(x_ref - x) / sqrt(xe * xe + xe_ref * xe_ref)', 'dx', 5)}, {rnd('(y_ref - y) / sqrt(ye * ye + ye_ref * ye_ref)', 'dy', 5)} from pairs where abs(x_ref - x) < 1.5 and abs(y_ref - y) < 1.5"
)
def residual_arrows(spark, d):
    """Residuals within 1.5 pixels over their errors."""
    return rounded(quality.residual_arrows(pairs(spark, d), 1.5, "both").select("star_id", "list_id", "dx", "dy"), 5)


@query(
    f"with {STARS}, {GAIA} select 'reference' as source, star_id as id, vx, vy from stars where {fin('vx')} is not null and {fin('vy')} is not null union all select 'list', source_id, pmra, pmdec from g where {fin('pmra')} is not null and {fin('pmdec')} is not null"
)
def velocity_points(spark, d):
    """The velocities of two catalogs."""
    return quality.velocity_points(
        stars(spark, d).withColumnRenamed("star_id", "id"), sources(spark, d).selectExpr("source_id as id", "pmra as vx", "pmdec as vy")
    )


def _ratio_sql() -> str:
    e = lambda c: f"sqrt(b.v{c}e * b.v{c}e + a.v{c}e * a.v{c}e)"
    out = ", ".join(
        f"{rnd(f'(a.v{c} - b.v{c}) * 40', f'dv{c}')}, {rnd(f'{e(c)} * 40', f'dv{c}e')}, {rnd(f'(a.v{c} - b.v{c}) / {e(c)}', f'rv{c}', 5)}" for c in "xy"
    )
    return f"with {MOVING} select a.star_id, {out} from mv a join mv b on b.star_id = a.star_id + 1"


@query(_ratio_sql())
def velocity_ratios(spark, d):
    """Differences of velocities, scaled, and over their errors (each star against the one numbered next)."""
    v = ("vx", "vy", "vxe", "vye")
    a = moving(spark, d).select("star_id", *(F.col(c).alias(f"{c}_ref") for c in v))
    b = moving(spark, d).select((F.col("star_id") - 1).alias("star_id"), *v)
    r = quality.velocity_ratios(a.join(b, "star_id"), 40.0).select("star_id", "dvx", "dvxe", "rvx", "dvy", "dvye", "rvy")
    return r.select("star_id", *(near(F.col(c), 5 if c[0] == "r" else 6).alias(c) for c in r.columns[1:]))


@query(f"with {STARS} select star_id, vx * 1000 as pm_x, vy * 1000 as pm_y from stars where {fin('vx')} is not null and {fin('vy')} is not null")
def proper_motions(spark, d):
    """Motions in thousandths."""
    return quality.proper_motions(stars(spark, d))


@query(f"""with {GAIA}, c as (select source_id, ra, dec, {fin('pmra')} as pmra, {fin('pmdec')} as pmdec from g where {fin('ra')} is not null and {fin('dec')} is not null), m as (select avg(ra) as r, avg(dec) as q, avg(pmra) as u, avg(pmdec) as v from c)
  select source_id, {rnd('(((((ra - r + 180) % 360) + 360) % 360) - 180) * cos(radians(q)) * 3600', 'dx', 3)}, {rnd('(dec - q) * 3600', 'dy', 4)}, {rnd('pmra - u', 'dpm_x', 5)}, {rnd('pmdec - v', 'dpm_y', 5)} from c, m""")
def centred_offsets(spark, d):
    """Places and motions about their means."""
    n = {"dx": 3, "dy": 4, "dpm_x": 5, "dpm_y": 5}
    o = quality.centred_offsets(sources(spark, d))
    return o.select("source_id", *(near(F.col(c), k).alias(c) for c, k in n.items()))


@query(f"""with {MD}, f as (select distinct star_id, use_in_trans from startable), w as (select md.*, f.use_in_trans from md join f using (star_id)), k as (select 'GOOD' as kind, * from w union all select 'REF', * from w where use_in_trans)
  select list_id, kind, count(*) as n, {', '.join(rnd(f'{f}(d{c} * 1000)', f'd{c}_{n}', 3) for c in 'xy' for f, n in (('avg', 'mean'), ('stddev_pop', 'std')))} from k group by 1, 2""")
def quiver_statistics(spark, d):
    """Means and spreads of the residuals of all stars and of the reference stars."""
    m = modelled(spark, d).join(stars(spark, d).select("star_id", "use_in_trans"), "star_id")
    return rounded(quality.quiver_statistics(m), 3)


@query(
    f"with {MD}, n as (select star_id from md group by 1 having count(*) = 12) select star_id, list_id, {rnd('dx', 'dx', 5)}, {rnd('dy', 'dy', 5)}, xe, ye, {rnd('dx / xe', 'sig_x', 4)}, {rnd('dy / ye', 'sig_y', 4)} from md where star_id in (select star_id from n)"
)
def residuals_of_detected(spark, d):
    """Residuals, errors and ratios of the stars with twelve detections."""
    r = quality.residuals_of_detected(modelled(spark, d), 12)
    n = {"dx": 5, "dy": 5, "sig_x": 4, "sig_y": 4}
    return r.select(*(near(F.col(c), n[c]).alias(c) if c in n else F.col(c) for c in r.columns))


@query(f"""with {MD}, k as (select 'all' as alignment, * from md union all select 'bright', * from md where m < 16) select alignment, star_id, list_id, {rnd('(dx * cos(radians(-30)) - dy * sin(radians(-30))) / 0.04', 'dx_orig', 4)},
  {rnd('(dx * sin(radians(-30)) + dy * cos(radians(-30))) / 0.04', 'dy_orig', 4)} from k""")
def several_alignments(spark, d):
    """The residuals of several alignments in the original frame."""
    m = modelled(spark, d)
    return rounded(quality.several_alignments({"all": m, "bright": m.where("m < 16")}, 30.0).select("alignment", "star_id", "list_id", "dx_orig", "dy_orig"), 4)


@query(f"with {READINGS} select star_id, list_id, row_number() over (partition by star_id order by {fin('t')} nulls last, list_id)::int as n from readings")
def readings_by_time(spark, d):
    """O2: every star's readings in order of time."""
    return quality.by_time(readings(spark, d)).select("star_id", "list_id", "n")


@query(f"""with {STARS}, {READINGS}, k(list_id) as (values (1), (2), (3), (4)), r as (select star_id, case list_id when 5 then 1 when 7 then 2 else 3 end as list_id, x, y, m, xe, ye from readings where list_id in (5, 7, 9) and star_id in (select star_id from stars)
    union all select star_id, 4, x, y, m, null, null from readings where list_id = 11 and star_id in (select star_id from stars))
  select s.star_id, k.list_id::bigint as list_id, case when k.list_id = 2 and s.star_id % 5 = 0 then null else x end as x, case when k.list_id = 2 and s.star_id % 5 = 0 then null else y end as y, m, xe, ye from stars s cross join k left join r on r.star_id = s.star_id and r.list_id = k.list_id""")
def star_table(spark, d):
    """M1, M3 to M6: a table from three lists, one more added column by column, some readings made invalid; one row a star and list."""
    s = stars(spark, d)
    r = readings(spark, d).join(s.select("star_id"), "star_id", "left_semi")
    part = lambda k: r.where(F.col("list_id") == k).select("star_id", "x", "y", "m", "xe", "ye")
    t = tables.StarTable(
        s.select("star_id", "name"), part(5).withColumn("list_id", F.lit(1).cast("long")).where(F.lit(False)),
        spark.createDataFrame([], "list_id long, list_name string, list_time double")
    )
    for k, lst in enumerate((5, 7, 9), 1):
        t = tables.add_list(t, part(lst), k)
    t = tables.add_values(t, 4, **{c: part(11).select("star_id", F.col(c).alias("value")) for c in ("x", "y", "m")})
    t = tables.invalidated(t, [2], s.where("star_id % 5 = 0"), ["x", "y"])
    return tables.full(t).select("star_id", "list_id", "x", "y", "m", "xe", "ye")


@query(
    f"with {MOVING} select star_id, {rnd(PX, 'x0')}, {rnd(PY, 'y0')}, {rnd(f'sqrt({XX} * x0e * {XX} * x0e + {XY} * y0e * {XY} * y0e)', 'x0e')}, {rnd(f'{XX} * vx + {XY} * vy', 'vx')}, {rnd(f'sqrt(pow((-2e-6 * vx + 2e-6 * vy) * x0e, 2) + pow((2e-6 * vx + 2e-6 * vy) * y0e, 2) + pow({YX} * vxe, 2) + pow({YY} * vye, 2))', 'vye')} from mv"
)
def catalog_moved(spark, d):
    """Places at the reference time, their errors and motions moved with a catalog."""
    s = moving(spark, d).withColumns({"x": F.col("x0"), "y": F.col("y0")})
    return rounded(fits.applied(s, {(): ORDER2}).select("star_id", "x0", "y0", "x0e", "vx", "vye"))
