"""Matching catalogs: by place and brightness, by name, and what follows from it (fill, append, relabel).

The tolerance match is a range join by grid cells (equi-join on the cell, exact distance after it) with the rules for several
candidates as windows over one row's neighbours: a row keeps a candidate that is both nearest and closest in
brightness, and so does the other side; anything confused is dropped.

Defined cases: rows without a position or key match nothing; a missing magnitude counts as closest where no tolerance is set and
never matches where one is; ties go to the lesser key; repeated keys are rows of their own; an empty side gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.common import finite
from skyloom.functions.models import Transform
from skyloom.operators.hot import hot_keys, salted


def _placed(df: DataFrame, n: int, cols: list[str]) -> DataFrame:
    """The rows that can match, with the columns ``cols``."""
    return df.select(
        *cols, F.col("id").alias(f"id_{n}"), finite("x").alias(f"x_{n}"), finite("y").alias(f"y_{n}"), finite("m").alias(f"m_{n}")
    ).where(f"id_{n} is not null and x_{n} is not null and y_{n} is not null")


def _cell(c: Column, radius: float) -> Column:
    return F.floor(c / (2.0 * radius if radius > 0 else 1.0))


def hot_cells(a: DataFrame, radius: float, by: list[str] | None = None) -> DataFrame | None:
    """The cells with very many rows of a, for range_join."""
    left = _placed(a, 1, by or []).withColumns({"_cx": _cell(F.col("x_1"), radius), "_cy": _cell(F.col("y_1"), radius)})
    return hot_keys(left, [*(by or []), "_cx", "_cy"])


def range_join(
    a: DataFrame, b: DataFrame, radius: float, by: list[str] | None = None, carry: tuple[list[str], list[str]] = ([], []),
    hot: DataFrame | bool | None = True
) -> DataFrame:
    """Pairs of rows of a (id_1, x_1, y_1, m_1) and b (id_2, ...) with equal ``by`` columns at most ``radius`` apart, with d2.

    b is put into every cell its disc touches, a stays in its own. If b lacks columns of ``by``, its rows belong to each of a's groups.
    ``carry``: further columns of a and of b that come along. ``hot``: the hot cells where they are known, None where there are none.
    """
    by = by or []
    shared, reach = [c for c in by if c in b.columns], radius * (1 + 1e-9)
    left = _placed(a, 1, [*by, *carry[0]]).withColumns({"_cx": _cell(F.col("x_1"), radius), "_cy": _cell(F.col("y_1"), radius)})
    span = lambda c: F.explode(F.sequence(_cell(F.col(c) - reach, radius), _cell(F.col(c) + reach, radius)))
    right = _placed(b, 2, [*shared, *carry[1]]).withColumn("_cx", span("x_2")).withColumn("_cy", span("y_2"))
    keys = [*shared, "_cx", "_cy"]
    left, right, keys = salted(left, right, keys, F.col("id_1"), hot_keys(left, keys) if hot is True else hot)
    dx, dy = F.col("x_1") - F.col("x_2"), F.col("y_1") - F.col("y_2")
    return left.join(right, keys).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= float(radius) ** 2).drop("_cx", "_cy", "_salt")


def cross_match(
    a: DataFrame, b: DataFrame, dr_tol: float, dm_tol: float | None = None, by: list[str] | None = None, metric: str = "euclid",
    carry: tuple[list[str], list[str]] = ([], []), hot: DataFrame | bool | None = True
) -> DataFrame:
    """(by..., id_1, id_2, dr, dm, carried columns): the unconfused matches. ``metric`` "x_only" ranks several candidates by |dx| alone."""
    by = by or []
    c = range_join(a, b, dr_tol, by, carry, hot).withColumn("dm", F.col("m_1") - F.col("m_2")).withColumn("adm", F.abs("dm")).withColumn("dr", F.sqrt("d2"))
    c = c.withColumn("near", F.abs(F.col("x_1") - F.col("x_2")) if metric == "x_only" else F.col("dr"))
    if dm_tol is not None:
        c = c.where(F.col("adm") <= dm_tol)

    def both(df: DataFrame, side: str, other: str, near: str) -> DataFrame:
        w = Window.partitionBy(*by, side)
        rm = F.row_number().over(w.orderBy(F.col("adm").asc_nulls_first(), F.col(other)))
        rd = F.row_number().over(w.orderBy(F.col(near), F.col(other)))
        return df.withColumns({"_rm": rm, "_rd": rd}).where("_rm = 1 and _rd = 1").drop("_rm", "_rd")

    own = both(c, "id_1", "id_2", "near")
    if dm_tol is not None:
        own = own.where(F.col("adm") < dm_tol)
    return both(own, "id_2", "id_1", "dr").select(*by, "id_1", "id_2", "dr", "dm", *carry[0], *carry[1])


def transform_and_match(
    a: DataFrame, b: DataFrame, model: Transform, dr_tol: float = 1.0, dm_tol: float | None = None, by: list[str] | None = None
) -> DataFrame:
    """cross_match after the model has moved a's positions; magnitudes stay."""
    x, y = model.position(F.col("x").cast("double"), F.col("y").cast("double"))
    return cross_match(a.withColumns({"x": x, "y": y}), b, dr_tol, dm_tol, by)


def name_join(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., name, id_1, id_2): names in both that don't begin with ``star``, each with the first row of either side."""
    by = by or []
    first = lambda df, n: df.where(
        F.col("name").isNotNull() & ~F.startswith("name", F.lit("star"))
    ).groupBy(*by, "name").agg(F.min("id").alias(f"id_{n}"))
    return first(a, 1).join(first(b, 2), [*by, "name"])


def guess_join(a: DataFrame, b: DataFrame, ignore: str = "star", by: list[str] | None = None) -> DataFrame:
    """(by..., name, id_1, id_2) of equal names that don't contain ``ignore``."""
    by = by or []
    pick = lambda df, n: df.where(
        F.col("name").isNotNull() & ~F.contains("name", F.lit(ignore))
    ).select(*by, "name", F.col("id").alias(f"id_{n}"))
    return pick(a, 1).join(pick(b, 2), [*by, "name"])


def copy_over(obs: DataFrame, new: DataFrame) -> DataFrame:
    """Matched readings written into the long table: a reading of an epoch that is there already is replaced."""
    old = obs.join(new.select("star_id", "list_id"), ["star_id", "list_id"], "left_anti")
    return old.unionByName(new, allowMissingColumns=True)


def unmatched(lst: DataFrame, matches: DataFrame, key: str = "id", side: str = "id_2", by: list[str] | None = None) -> DataFrame:
    """Rows of a list that no match has: the new stars."""
    by = by or []
    return lst.join(matches.select(*by, F.col(side).alias(key)), [*by, key], "left_anti")


def new_name(list_index: Column, name: Column) -> Column:
    """The name of a star first seen in a list: its number, three wide, an underscore and the name there."""
    return F.format_string("%3d_%s", list_index.cast("int"), F.coalesce(name, F.lit("")))


def relabel(stars: DataFrame, labels: DataFrame, dr_tol: float = 0.05, dm_tol: float | None = 0.3) -> DataFrame:
    """Stars renamed after the labels they match; the labels are first moved by the mean offsets of equal names.

    stars and labels: id, name, x, y, m. The old name stays as ``name_orig``.
    """
    pairs = name_join(labels, stars)
    l, s = labels.alias("l"), stars.alias("s")
    off = pairs.join(l, F.col("id_1") == F.col("l.id")).join(s, F.col("id_2") == F.col("s.id")).agg(
        *(F.avg(F.col(f"s.{c}") - F.col(f"l.{c}")).alias(f"d{c}") for c in "xym")
    )
    moved = labels.crossJoin(F.broadcast(off)).withColumns({c: F.col(c) + F.coalesce(F.col(f"d{c}"), F.lit(0.0)) for c in "xym"})  # one row of offsets
    found = cross_match(stars, moved, dr_tol, dm_tol).join(
        labels.select(F.col("id").alias("id_2"), F.col("name").alias("_label")), "id_2"
    ).select(F.col("id_1").alias("id"), "_label")
    return stars.join(found, "id", "left").withColumn("name_orig", F.col("name")).withColumn("name", F.coalesce("_label", "name")).drop("_label")


def pair_table(a: DataFrame, b: DataFrame, matches: DataFrame) -> DataFrame:
    """The matched rows side by side: columns of a and, with _2, of b."""
    left = a.withColumnRenamed("id", "id_1")
    right = b.withColumnsRenamed({c: ("id_2" if c == "id" else f"{c}_2") for c in b.columns})
    return matches.select("id_1", "id_2").join(left, "id_1").join(right, "id_2")
