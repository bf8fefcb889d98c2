"""Quantities recorded in different units, brought to milliarcseconds and milliarcseconds a year.

Where the unit of a value is told, in order: the row's own unit columns, the row's remarks, the note on its catalog. Texts
are read by an automaton of unit aliases (functions/units.py). A catalog that tells nothing is compared by its usual
size of the field, on a logarithmic scale, with the rows whose unit is told, and takes the nearest unit. Conversion
factors are one small join: a unit's factor, times the catalog's plate scale where it is pixels.

Defined cases: NULL and NaN values have no unit and stay NULL; a row without a catalog has only its own texts, else
its unit is NULL; pixels without a plate scale get a unit but no converted value; repeated rows are converted each;
an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.common import checkpointed, finite
from skyloom.functions import units


@dataclass(frozen=True)
class Field:
    """A column in need of its unit; ``like`` are columns recorded in the same unit that help where none is told."""

    column: str
    kind: str  # "motion" or "error"
    like: tuple[str, ...] = ()


def factors(df: DataFrame) -> DataFrame:
    """(unit, factor, pixels): what one unit is in mas or mas/yr, pixels to be multiplied by the plate scale."""
    rows = []
    for a, f in units.MAS.items():
        rows.append((a, f or 1.0, f is None))
        rows += [(f"{a}/{t}", (f or 1.0) / y, f is None) for t, y in units.YEARS.items()]
    return df.sparkSession.createDataFrame(rows, "unit string, factor double, pixels boolean")


def _size(c: str) -> Column:
    v = F.abs(finite(c))
    return F.when(v > 0, F.log10(v))


def with_units(df: DataFrame, catalogs: DataFrame, fields: list[Field], texts: list[tuple[str, str]]) -> DataFrame:
    """The table with ``<column>_unit`` and ``<column>_mas`` for each field.

    ``texts``: (column, field it is about or "") in the order in which they count.
    """
    note = units.stated(F.col("_note"))
    cat = catalogs.where(F.col("catalog").isNotNull()).groupBy(F.col("catalog").alias("_catalog")).agg(F.max(finite("mas_per_pix")).alias("_scale"), F.max("note").alias("_note")).withColumn("_cat", note).select(
        "_catalog", "_scale", F.col("_cat.motion").alias("_cat_motion"), F.col("_cat.error").alias("_cat_error")
    )
    told = df.withColumns({f"_told{i}": units.stated(F.col(c).cast("string"), about) for i, (c, about) in enumerate(texts)})
    own = {
        k: F.coalesce(
            *(F.col(f"_told{i}.{k}") for i, (_, about) in enumerate(texts) if about in ("", k)), F.lit(None).cast("string")
        ) for k in ("motion", "error")
    }
    told = told.withColumns({f"_own_{k}": c for k, c in own.items()}).drop(*(f"_told{i}" for i in range(len(texts))))
    told = told.join(cat, told["catalog"] == cat["_catalog"], "left")
    for f in fields:
        told = told.withColumn(f"_unit_{f.column}", F.coalesce(f"_own_{f.kind}", f"_cat_{f.kind}"))
    guess = _guesses(told, fields)
    told = told.join(guess, "_catalog", "left") if guess is not None else told
    fac = factors(df)
    for f in fields:
        unit = F.coalesce(f"_unit_{f.column}", f"_guess_{f.column}") if guess is not None else F.col(f"_unit_{f.column}")
        has = ~F.isnan(F.col(f.column).cast("double"))
        told = told.withColumn(f"{f.column}_unit", F.when(F.col(f.column).isNotNull() & has, unit))
        told = told.join(
            F.broadcast(fac.select(F.col("unit").alias(f"{f.column}_unit"), F.col("factor").alias("_f"), F.col("pixels").alias("_p"))),
            f"{f.column}_unit", "left"
        )
        told = told.withColumn(
            f"{f.column}_mas", F.when(has, F.col(f.column).cast("double")) * F.col("_f") * F.when(F.col("_p"), F.col("_scale")).otherwise(1.0)
        ).drop("_f", "_p")
    return told.select(*(F.col(c) for c in df.columns), *(F.col(f"{f.column}_{x}") for f in fields for x in ("unit", "mas")))


def _guesses(told: DataFrame, fields: list[Field]) -> DataFrame | None:
    """Per catalog without a note on a field the unit in which its usual size comes nearest to that of the rows with a unit."""
    fac = {r.unit: (r.factor, r.pixels) for r in factors(told).collect()}
    lookup = F.create_map(*(x for u, (f, _) in fac.items() for x in (F.lit(u), F.lit(f))))
    pixels = F.array(*(F.lit(u) for u, (_, p) in fac.items() if p))
    shift = lambda u: F.log10(F.element_at(lookup, u)) + F.when(F.array_contains(pixels, u), F.log10("_scale")).otherwise(0.0)
    cols = [(f, c) for f in fields for c in (f.column, *f.like)]
    # of all rows and of each catalog in one pass, as the texts are read on the way
    known = [F.percentile_approx(_size(c) + shift(F.col(f"_unit_{f.column}")), 0.5).alias(f"{f.column}:{c}") for f, c in cols]
    each = [F.percentile_approx(F.when(F.col(f"_unit_{f.column}").isNull(), _size(c)), 0.5).alias(f"_m_{f.column}_{c}") for f, c in cols]
    sums = checkpointed(told.rollup("_catalog").agg(F.grouping_id().alias("_all"), F.max("_scale").alias("_scale"), *known, *each))  # one row a catalog
    usual = sums.where("_all = 1").first()
    if usual is None:
        return None
    theirs = sums.where("_all = 0 and _catalog is not null").drop(*(f"{f.column}:{c}" for f, c in cols))
    out = {}
    for f in fields:
        ends = [u for u in fac if ("/" in u) == (f.kind == "motion")]
        like = [c for ff, c in cols if ff is f and usual[f"{f.column}:{c}"] is not None]
        best = None
        for u in ends:
            miss = sum(
                (F.coalesce(F.abs(F.col(f"_m_{f.column}_{c}") + shift(F.lit(u)) - F.lit(usual[f"{f.column}:{c}"])), F.lit(0.0)) for c in like),
                F.lit(0.0)
            )
            usable = F.when(F.array_contains(pixels, F.lit(u)), F.col("_scale").isNotNull()).otherwise(True)
            s = F.when(usable & F.col(f"_m_{f.column}_{f.column}").isNotNull() & F.lit(bool(like)), F.struct(miss.alias("miss"), F.lit(u).alias("unit")))
            best = s if best is None else F.least(best, s)
        out[f"_guess_{f.column}"] = best["unit"]
    return theirs.select("_catalog", *(c.alias(n) for n, c in out.items()))
