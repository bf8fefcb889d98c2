"""Queries of the whole pipelines: mosaics, stitching, first transforms. All but the last depend on the order of lists and have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.common import checkpointed, finite, table
from skyloom.functions import models
from skyloom.operators import fits, triangles
from skyloom.plans.mosaic import Mosaic, pair_alignment, stitch, two_columns
from skyloom.queries.engine import N_BRIGHT, bright_lists, coefficients, guess_sql, rounded_fit

#: The frames of the test lists differ by a few pixels: all alignments begin with none.
SAME = models.polynomial([0.0, 1.0, 0.0], [0.0, 0.0, 1.0])


def star_lists(spark: SparkSession, d: str, name: str, key: str) -> dict[int, DataFrame]:
    """The star lists of a table by number, re-sent rows once, rows without a place or magnitude left out."""
    t = table(spark, d, name)
    once = t.groupBy("list_id", "x", "y", "m").agg(F.min(key).alias(key)).select(key)
    more = [F.coalesce(finite(c), F.lit(v)).alias(c) for c, v in (("xe", 1.0), ("ye", 1.0), ("me", 1.0), ("corr", 1.0)) if c in t.columns]
    rows = checkpointed(
        t.join(once, key, "left_semi").select(
            "list_id", F.col(key).alias("row_id"), "name", *(finite(c).alias(c) for c in ("x", "y", "m", "t")), *more
        ).where("x is not null and y is not null and m is not null")
    )
    numbers = sorted(r["list_id"] for r in rows.select("list_id").where("list_id is not null").distinct().collect())  # one row a list
    return {k: rows.where(F.col("list_id") == k).drop("list_id") for k in numbers}


def mosaic_self(spark: SparkSession, d: str) -> DataFrame:
    """All star lists taken into one table, beginning with the deepest; its stars with their detections."""
    lists = star_lists(spark, d, "starlist", "row_id")
    m = Mosaic(lists, ref_index=44, iters=1, dr_tol=4.0, outlier_tol=3.0, trans_input=[SAME] * len(lists))
    stars, _, _ = m.fit()
    return stars.select("star_id", "name", "x0", "y0", "m0", "n_detect")


def mosaic_to_ref(spark: SparkSession, d: str) -> DataFrame:
    """R2: the external lists taken to a star list as their reference, with motions; their readings."""
    lists = star_lists(spark, d, "starlist_ext", "ext_id")
    m = Mosaic(
        lists, reference=star_lists(spark, d, "starlist", "row_id")[44], iters=2, dr_tol=[4.0, 2.0], outlier_tol=[3.0, 3.0],
        trans_input=[SAME] * len(lists), use_vel=True, use_ref_new=False, update_ref_orig=False
    )
    return m.fit()[1].select("star_id", "list_id", "obs_id", "x", "y", "m")


def stitched_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames of one filter stitched."""
    of_filter = {r["list_id"] for r in table(spark, d, "lists").where("kind = 'unmatched' and filt = 'h'").select("list_id").collect()}
    lists = {k: df for k, df in star_lists(spark, d, "starlist", "row_id").items() if k in of_filter}
    return stitch(lists, min(lists), n_iter=1, dr_tol=1.5, order=1)


def initial_guess(spark: SparkSession, d: str) -> DataFrame:
    """First transforms of every list to one of them from triangles, where three pairs match; triangle pairs weigh by their votes."""
    ref, lst = bright_lists(spark, d)
    found = checkpointed(triangles.triangle_match(ref, lst, N_BRIGHT, by=["list_id"]))
    enough = found.groupBy("list_id").agg(F.count("*").alias("n")).where("n >= 3").select("list_id")
    a = ref.select("list_id", F.col("id").alias("id_1"), *(finite(c).alias(f"{c}_ref") for c in "xym"))
    pairs = found.join(enough, "list_id", "left_semi").withColumn("w", F.col("votes").cast("double")).join(a, ["list_id", "id_1"]).join(
        lst.select("list_id", F.col("id").alias("id_2"), *(finite(c).alias(c) for c in "xym")), ["list_id", "id_2"]
    )
    return rounded_fit(coefficients(spark, fits.fit(pairs, 1, by=["list_id"]), 3))


def generic_match(spark: SparkSession, d: str) -> DataFrame:
    """The two external lists aligned with trims of area and magnitude, and the table of both."""
    lists = {k: df.withColumnRenamed("row_id", "id") for k, df in star_lists(spark, d, "starlist_ext", "ext_id").items()}
    ref, lst = (lists[k] for k in sorted(lists))
    model, found = pair_alignment(ref, lst, [(1, 4.0), (1, 1.5)], start=SAME, sigma=3.0, area=((50.0, 1250.0), (50.0, 1250.0)), mag_lim=(None, 2.0))
    return two_columns(ref, lst, model, found).select("star_id", "name", "list_id", "x", "y", "m")


QUERIES = {f.__name__: f for f in (mosaic_self, mosaic_to_ref, stitched_frames, initial_guess, generic_match)}
SQL = {"initial_guess": guess_sql()}
