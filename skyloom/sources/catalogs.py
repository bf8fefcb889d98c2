"""Catalog files: readers for star lists and label files, writers, and transform files."""

from __future__ import annotations

import os
import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.common import finite
from skyloom.functions import models
from skyloom.functions.models import Transform

# Column orders of files without a header, and of label files.
LIST = ["name", "m", "t", "x", "y"]
LIST_ERRORS = ["xe", "ye", "snr", "corr", "N_frames", "flux"]
LIST_PLAIN = ["snr", "corr", "N_frames", "flux"]
LABEL = ["name", "m", "x0", "y0", "x0e", "y0e", "vx", "vy", "vxe", "vye", "t0", "use", "r0"]
LABEL_ACCEL = ["name", "m", "x0", "y0", "x0e", "y0e", "vx", "vy", "vxe", "vye", "ax", "ay", "axe", "aye", "t0", "use", "r0"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value): the lines of text files in the order they have there, counted per file from its byte offsets' order."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    place = F.monotonically_increasing_id()  # grows with the place in the file: taken right at the scan, before any shuffle
    text = text.withColumn("_p", place)
    return text.withColumn("row_id", F.row_number().over(Window.partitionBy("_f").orderBy("_b", "_p")).cast("long") - 1).select("_f", "row_id", "value")


def _table(spark: SparkSession, path: str, names: list[str] | None, text_columns: set[str]) -> DataFrame:
    lines = _lines(spark, path).withColumn("value", F.trim(F.col("value"), F.lit(" \t\r")))
    head = lines.where((F.length("value") > 0)).orderBy("_f", "row_id").first()
    if head is None:
        raise ValueError(f"{path} holds no line")
    words = head["value"].lstrip("#").split()
    named = "name" in words or {"x", "y", "m"} <= set(words)
    cols = names or words
    body = lines.where((F.length("value") > 0) & ~F.startswith("value", F.lit("#")))
    if named and not head["value"].startswith("#"):
        body = body.where(F.col("value") != head["value"])
    if names is None and not named:
        n = len(words)
        cols = (LIST + (LIST_ERRORS if n >= len(LIST) + len(LIST_ERRORS) else LIST_PLAIN))[:n]
    cells = F.split("value", r"\s+")
    kinds = {"N_frames": "bigint", "N_fnd": "bigint"}
    out = [
        (F.get(cells, F.lit(i)) if c in text_columns else finite(F.get(cells, F.lit(i)).try_cast("double")).cast(kinds.get(c, "double"))).alias(c) for i,
        c in enumerate(cols)
    ]
    return body.select("row_id", *out)


def read_starlist(spark: SparkSession, path: str, error: bool = True) -> DataFrame:
    """A .lis file with its row numbers; a header names the columns, else they go by place (with or without errors)."""
    df = _table(spark, path, None, {"name"})
    if "name" in df.columns:
        return df
    names = LIST + (LIST_ERRORS if error else LIST_PLAIN)
    return df.toDF("row_id", *names[: len(df.columns) - 1])


def read_lis(spark: SparkSession, path: str, error: bool = True, quality_path: str | None = None) -> DataFrame:
    """read_starlist with ``me`` = 1/snr where there is none, and the fit quality of a one-column file joined by row."""
    df = read_starlist(spark, path, error)
    if error and "snr" in df.columns and "me" not in df.columns:
        df = df.withColumn("me", F.when(F.col("snr") != 0, 1 / F.col("snr")))
    if quality_path:
        q = _lines(spark, quality_path).where(F.length(F.trim("value")) > 0)
        q = q.select((F.row_number().over(Window.partitionBy("_f").orderBy("row_id")) - 1).alias("_k"), F.trim("value").try_cast("double").alias("sqrt_fvu"))
        if q.count() != df.count():
            raise ValueError("the quality file has another number of rows than the list")
        ranked = df.withColumn("_k", F.row_number().over(Window.orderBy("row_id")) - 1)  # one file of a catalog
        df = ranked.join(q, "_k").drop("_k").withColumn("fvu", F.col("sqrt_fvu") ** 2)
    return df


def label_motion(df: DataFrame, time: float | None = None, flip_x: bool = True, compat: bool = False) -> DataFrame:
    """Label columns in arcsec and arcsec/yr, moved to a time if one is given, x growing the other way.

    ``compat`` puts half of dt squared times axe squared under the root instead of its square.
    """
    v = [c for c in ("vx", "vy", "vxe", "vye") if c in df.columns]
    df = df.withColumns({c: F.col(c) * 0.001 for c in v})
    if time is not None:
        dt = F.lit(float(time)) - F.col("t0")
        out = {}
        for c in "xy":
            at = F.col(f"{c}0") + F.col(f"v{c}") * dt
            var = F.col(f"{c}0e") ** 2 + (dt * F.col(f"v{c}e")) ** 2
            if f"a{c}" in df.columns:
                at = at + 0.5 * F.col(f"a{c}") * dt * dt
                var = var + (0.5 * dt**2 * F.col(f"a{c}e") ** 2 if compat else (0.5 * dt * dt * F.col(f"a{c}e")) ** 2)
            out |= {c: at, f"{c}e": F.sqrt(var)}
        df = df.withColumns(out)
    if flip_x:
        df = df.withColumns({c: -F.col(c) for c in ("x0", "vx", "ax", "x") if c in df.columns and (c != "ax" or not compat)})
    return df


def read_label(spark: SparkSession, path: str, time: float | None = None, flip_x: bool = True) -> DataFrame:
    return label_motion(_table(spark, path, LABEL, {"name", "use"}), time, flip_x)


def read_label_accel(spark: SparkSession, path: str, time: float | None = None, flip_x: bool = True, compat: bool = False) -> DataFrame:
    return label_motion(_table(spark, path, LABEL_ACCEL, {"name", "use"}), time, flip_x, compat)


def _tie(v: Column, digits: int) -> Column:
    """The value, moved a little towards 0 where decimal rounding would take its digits up but the double lies below the tie.

    A double shown as a tie (2013.8155 at three digits) hardly ever is one: the error of the scaled product, which is exact by
    splitting the double, tells on which side it lies. A true tie goes to the even digit.
    """
    a, ten = F.abs(v), float(10**digits)
    high = a * 134217729.0 - (a * 134217729.0 - a)
    scaled = a * ten
    error = (high * ten - scaled) + (a - high) * ten
    down = (scaled - F.floor(scaled) == 0.5) & ((error < 0) | (error == 0) & (F.floor(scaled) % 2 == 0))
    return F.when(down, v * (1 - 1e-12)).otherwise(v)


# Format of the .lis line, its digits after the point.
LIS_FORMAT = "%-13s  %6.3f  %8.3f  %9.3f  %9.3f  %9.3f  %9.3f  %20.4f  %6.2f  %8d  %20.0f"
LIS_DIGITS = {"m": 3, "t": 3, "x": 3, "y": 3, "xe": 3, "ye": 3, "snr": 4, "corr": 2}


def to_lis_lines(df: DataFrame) -> DataFrame:
    """(value): the lines of a .lis file, the columns at fixed places."""
    n = "N_frames" if "N_frames" in df.columns else "n_frames"
    cols = [
        F.coalesce(F.col("name"), F.lit("")), *(_tie(F.col(c).cast("double"), k) for c, k in LIS_DIGITS.items()), F.col(n).cast("long"),
        _tie(F.col("flux").cast("double"), 0)
    ]
    return df.select(F.format_string(LIS_FORMAT, *cols).alias("value"))


def write_lis(df: DataFrame, path: str, order: str = "row_id") -> None:
    """A .lis file with its header line: one catalog image, so one file."""
    head = "# name".ljust(13) + "  " + "  ".join(
        c.rjust(w) for c, w in zip(("m", "t", "x", "y", "xe", "ye", "snr", "corr", "N_frames", "flux"), (6, 8, 9, 9, 9, 9, 20, 6, 8, 20))
    )
    body = to_lis_lines(df.orderBy(order).coalesce(1)) if order in df.columns else to_lis_lines(df.coalesce(1))
    df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).unionByName(body).coalesce(1).write.mode("error").text(path)


# Formats of the fixed-width list.
WIDTHS = {
    "name": "%-13s", "m": "%8.4f", "t": "%10.3f", "x": "%15.7f", "y": "%15.7f", "xe": "%15.7f", "ye": "%15.7f", "snr": "%10.4f", "corr": "%5.2f",
    "n_frames": "%3d", "N_frames": "%3d", "flux": "%10.1f"
}


def to_fixed_width(df: DataFrame) -> DataFrame:
    """(value): one line a row, every known column by its own format."""
    cols = [c for c in df.columns if c in WIDTHS]
    kind = lambda c: F.col(c).cast("string") if c == "name" else F.col(c).cast("long") if "frames" in c else _tie(
        F.col(c).cast("double"), int(re.search(r"\.(\d+)f", WIDTHS[c])[1])
    )
    return df.select(F.format_string(" ".join(WIDTHS[c] for c in cols), *(kind(c) for c in cols)).alias("value"))


def write_fixed_width(df: DataFrame, path: str) -> str:
    to_fixed_width(df).coalesce(1).write.mode("error").text(path)
    return path


def archive(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def open_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- transform files


def transform_text(
    model: Transform, starlist: str, reference: str, n_trans: int, delta_mag: float = 0.0, restrict: bool = False, weights: str | None = None
) -> str:
    if model.kind not in ("PolyTransform", "four_paramNW"):
        raise ValueError(f"{model.kind} can't be written")
    cx, cy = model.coefficients
    head = {
        "Date": date.today(), "File": f"{starlist}, Reference: {reference}", "Directory": os.getcwd(), "Transform Class": model.kind,
        "Order": model.order, "Restrict": restrict, "Weights": weights, "N_coeff": len(cx), "N_trans": n_trans, "Delta Mag": delta_mag
    }
    lines = [f"## {k}: {v}" for k, v in head.items()] + [f"{'# Xcoeff':16s} {'Ycoeff':16s}"] + [f"{a:16.6e}  {b:16.6e}" for a, b in zip(cx, cy)]
    return "\n".join(lines) + "\n"


def write_transform(model: Transform, path: str, **about) -> None:
    with open(path, "w") as f:
        f.write(transform_text(model, **about))


def parse_transform(text: str) -> Transform:
    """A model from the text of a transform file, of the class that its header names (a polynomial where it names none).

    A header's order, where told, must agree with the coefficients.
    """
    rows = [tuple(map(float, line.split()[:2])) for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    told = dict(re.findall(r"^##\s*([A-Za-z_ ]+):\s*(.*?)\s*$", text, re.M))
    dm, kind = float(told.get("Delta Mag") or 0.0), told.get("Transform Class", "PolyTransform")
    cx, cy = [r[0] for r in rows], [r[1] for r in rows]
    if kind == "four_paramNW":
        if len(rows) != 3:
            raise ValueError(f"a similarity has 3 pairs of coefficients, not {len(rows)}")
        return models.similarity(cx[0], cy[0], cx[1], cx[2], dm)
    if kind != "PolyTransform":
        raise ValueError(f"{kind} can't be read")
    model = models.polynomial(cx, cy, dm)
    if told.get("Order", str(model.order)) != str(model.order):
        raise ValueError(f"order {told['Order']} with {len(rows)} pairs of coefficients")
    return model


def read_transform(path: str) -> Transform:
    with open(path) as f:
        return parse_transform(f.read())


def starlist_frame(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A star list from rows, with its schema checked: name, x, y, m needed, xe and ye both or neither."""
    missing = {"name", "x", "y", "m"} - set(columns)
    if missing:
        raise ValueError(f"a star list needs {sorted(missing)}")
    if ("xe" in columns) != ("ye" in columns):
        raise TypeError("xe and ye: both or neither")
    schema = T.StructType(
        [T.StructField(c, T.StringType() if c in ("name", "use") else T.LongType() if c in ("row_id", "list_id", "n_frames") else T.DoubleType()) for c in columns]
    )
    df = spark.createDataFrame(rows, schema)
    return df if "row_id" in columns else df.withColumn("row_id", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long") - 1)
