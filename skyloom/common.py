"""Session, table and missing-value helpers shared by all operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def present(c: Column | str) -> Column:
    """The double with NaN turned into NULL; infinities stay (they are readings, if impossible ones)."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def finite(c: Column | str) -> Column:
    """The double with NaN and both infinities turned into NULL."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset, as in tests, a local temporary folder is named; that is safe in local mode alone, so elsewhere it is refused.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "skyloom-checkpoint")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table written in the shared folder, which all executors can read.

    Being columns on disk it is smaller than a checkpoint of rows, and only the columns in use are read again. It is removed when
    the driver ends, or before by ``released``. Tables that Parquet can't hold (columns of no type, names that
    differ in case alone) are checkpointed as they are.
    """
    spark, names = df.sparkSession, [c.lower() for c in df.columns]
    folder = shared_folder(spark)
    if len(set(names)) < len(names) or not names or any(t == "void" for _, t in df.dtypes):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return df.checkpoint(eager=True)
    path = f"{folder}/skyloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _hadoop(spark, path, lambda fs, p: fs.deleteOnExit(p))
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def released(*dfs: DataFrame | None) -> None:
    """Remove the tables of ``checkpointed`` that nothing will read any more."""
    for df in dfs:
        if (path := getattr(df, "_kept_at", None)) is not None:
            _hadoop(df.sparkSession, path, lambda fs, p: fs.delete(p, True))


def swept(df: DataFrame) -> DataFrame:
    """The table of ``checkpointed``, once the shuffle files of the plans that made it may go.

    Spark removes them when its driver has collected the plans as garbage, which a driver with memory to spare puts off.
    """
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def _hadoop(spark: SparkSession, path: str, do) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    do(p.getFileSystem(spark._jsc.hadoopConfiguration()), p)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def exact_median(df: DataFrame, by: list[str], value: Column, name: str = "median") -> DataFrame:
    """(by..., name): the median of each group without any group in one task's memory.

    Approximate quantiles bracket the middle; the values below are counted, and only the fiftieth of a group within the bracket is ordered.
    NULLs don't count; a group without values, or of a NULL key, has no row; without groups an empty table has the median NULL.
    """
    rows = df.select(*by, value.alias("_v")).where("_v is not null")
    ends = rows.groupBy(*by).agg(F.percentile_approx("_v", [0.49, 0.51], 1000).alias("_q"), F.count("*").alias("_n"))
    at = (rows.join(ends, by) if by else rows.crossJoin(F.broadcast(ends))).withColumns({"_lo": F.col("_q")[0], "_hi": F.col("_q")[1]})
    below = at.groupBy(*by).agg(F.sum((F.col("_v") < F.col("_lo")).cast("long")).alias("_below"))
    middle = at.where("_v >= _lo and _v <= _hi").select(*by, "_v", "_n")
    # without a group all rows are one: ranked by value all the same, as there are few of them left
    rank = F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_v")) - 1
    ranked = middle.withColumn("_r", rank)
    placed = (ranked.join(below, by) if by else ranked.crossJoin(F.broadcast(below))).withColumn("_k", F.col("_r") + F.col("_below"))
    mid = placed.where((F.col("_k") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_k") == F.floor(F.col("_n") / 2)))
    return mid.groupBy(*by).agg(F.avg("_v").alias(name))
