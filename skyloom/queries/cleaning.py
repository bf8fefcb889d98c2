"""The p1_ to p4_ queries, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.common import table
from skyloom.operators import neighbours, spikes, unify
from skyloom.sources import raw_lines

#: Search radii of p1: pixels within a list, arcseconds on the sky.
PIXELS, ARCSEC = 1.2345, 0.75


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Close neighbours in each star list and on the sky, and the regions that hold each source."""
    out = lambda df, kind: df.select(F.lit(kind).alias("kind"), "key_1", "key_2")
    gaia = table(spark, d, "gaia")
    lists = neighbours.planar_pairs(table(spark, d, "starlist"), "row_id", "x", "y", PIXELS, by=["list_id"])
    sky = neighbours.sphere_pairs(gaia, "source_id", "ra", "dec", ARCSEC / 3600)
    regions = neighbours.region_members(gaia, "source_id", "ra", "dec", table(spark, d, "sky_regions"))
    return out(lists, "starlist").unionByName(out(sky, "gaia")).unionByName(
        out(regions.select(F.col("region_id").alias("key_1"), F.col("key").alias("key_2")), "region")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings of x, y, m and xe with the field at fault."""
    return spikes.implausible(table(spark, d, "startable_obs"), table(spark, d, "lists"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each failing line of the undecoded lists with the first reason that holds."""
    return raw_lines.failures(table(spark, d, "starlist_raw"))


def p3_valid(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines of the undecoded lists as catalog rows."""
    return raw_lines.load(table(spark, d, "starlist_raw"))


GAIA = dict(
    fields=[unify.Field("pmra", "motion", ("pmra_error",)), unify.Field("ra_error", "error", ("dec_error",))],
    texts=[("pm_unit", "motion"), ("err_unit", "error"), ("remark", "")]
)
STARS = dict(fields=[unify.Field("vx", "motion", ("vxe",)), unify.Field("x0e", "error", ("y0e",))], texts=[("unit_note", "")])


def _converted(spark: SparkSession, d: str) -> list[tuple[str, str, DataFrame, list[unify.Field]]]:
    catalogs = table(spark, d, "catalogs")
    return [
        (name, key, unify.with_units(table(spark, d, name), catalogs, **how), how["fields"]) for name, key,
        how in (("gaia", "source_id", GAIA), ("startable", "star_id", STARS))
    ]


def _fields(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key, df, fields in _converted(spark, d):
        each = F.inline(
            F.array(
                *(F.struct(F.lit(f.column).alias("field"), F.col(f"{f.column}_unit").alias("unit"), F.col(f"{f.column}_mas").alias("value")) for f in fields)
            )
        )
        one = df.select(F.lit(name).alias("tbl"), F.col(key).alias("row_key"), each)
        out = one if out is None else out.unionByName(one)
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of motions and errors that were recorded in another unit than mas/yr or mas."""
    return _fields(spark, d).where(F.col("row_key").isNotNull() & ~F.col("unit").isin("mas", "mas/yr")).select("tbl", "row_key", "field", "unit").distinct()


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """All motions and errors of both tables in mas/yr and mas."""
    return _fields(spark, d).where(F.col("value").isNotNull()).select("tbl", "row_key", "field", "value").distinct()


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_valid": p3_valid, "p4_found": p4_found, "p4_values": p4_values}

def _lines_sql() -> str:
    """CTE ``f``: the lines that are neither blank nor comments, with the first reason that holds (or NULL) and their unquoted cells."""
    quoted = '"(?:[^"]|"")*"'
    blank, comma = f'(?:{quoted}|[^" \\t]+)', f'[ \\t\\r]*(?:{quoted}[ \\t\\r]*|[^",]*)'
    blank, comma = blank.replace("\\\\", "\\"), comma.replace("\\\\", "\\")
    number = raw_lines.NUMBER
    val = lambda k: f"c[{k}]"
    within = lambda k, test: f"regexp_full_match({val(k)}, '{number[1:-1]}') and coalesce(try_cast({val(k)} as double) {test}, false)"
    return f"""t0 as (select line_id, list_id, layout = 'comma' and layout is not null as comma, trim(raw_line, chr(32) || chr(9) || chr(13)) as t from starlist_raw where line_id is not null and raw_line is not null),
  t as (select * from t0 where t <> '' and not starts_with(t, '#')),
  k as (select *, case when comma then regexp_full_match(t, '{comma}(?:,{comma})*') else regexp_full_match(t, '{blank}(?:[ \t]+{blank})*') end as good,
    case when comma then regexp_extract_all(t || ',', '({comma}),', 1) else regexp_extract_all(t, '{blank}') end as raw from t),
  u as (select *, list_transform(list_transform(raw, lambda r: trim(r, chr(32) || chr(9) || chr(13))), lambda r: case when starts_with(r, '"') then trim(replace(r[2:-2], '""', '"'), chr(32) || chr(9) || chr(13)) else r end) as c from k),
  f as (select *, case when not good then 'quotes' when len(c) <> 11 then 'columns' when trim(c[1]) = '' or contains(c[1], chr(65533)) then 'name'
    when not ({within(9, 'between 0 and 1')}) then 'corr' when not (regexp_full_match({val(10)}, '{raw_lines.COUNT[1:-1]}') and coalesce(try_cast({val(10)} as double) >= 1, false)) then 'n_frames'
    when not ({within(11, "> 0")} and not isinf(try_cast({val(11)} as double))) then 'flux' end as reason from u)"""


_NUMBERS = ", ".join(f"try_cast(c[{k}] as {'bigint' if n == 'n_frames' else 'double'}) as {n}" for k, n in enumerate(raw_lines.FIELDS, 1) if n != "name")

SQL = {
    "p3_found": f"with {_lines_sql()} select line_id, reason from f where reason is not null",
    "p3_valid": f"with {_lines_sql()} select line_id, list_id, nullif(c[1], '') as name, {_NUMBERS} from f where reason is null",
    "p1_found": f"""select 'starlist' as kind, a.row_id as key_1, b.row_id as key_2 from starlist a join starlist b on a.list_id = b.list_id and a.row_id < b.row_id
        and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {PIXELS} * {PIXELS}::double where not isnan(a.x) and not isnan(a.y) and not isnan(b.x) and not isnan(b.y)
      union all select distinct 'gaia', a.source_id, b.source_id from gaia a join gaia b on a.source_id < b.source_id and abs(a.dec - b.dec) <= 0.001
        and 2 * asin(least(1, sqrt(pow(sin(radians(a.dec - b.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(a.ra - b.ra) / 2), 2)))) <= radians({ARCSEC} / 3600.0::double) where not isnan(a.dec) and not isnan(b.dec) and not isnan(a.ra) and not isnan(b.ra)
      union all select distinct 'region', r.region_id, g.source_id from sky_regions r join gaia g on not isnan(g.ra) and not isnan(g.dec) and (
        (shape = 'box' and dec between dec_min and dec_max and case when ra_min <= ra_max then ra between ra_min and ra_max else ra >= ra_min or ra <= ra_max end)
        or (shape = 'circle' and degrees(2 * asin(least(1, sqrt(pow(sin(radians(dec - dec_center) / 2), 2) + cos(radians(dec)) * cos(radians(dec_center)) * pow(sin(radians(ra - ra_center) / 2), 2))))) <= radius_deg + 1e-9))""",
}
