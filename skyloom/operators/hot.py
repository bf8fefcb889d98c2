"""Hot join keys: found on a sample for the plan only, then salted, so that no task gets a key's every row.

A key is hot by the rows it has, not by its share of the table, and is split into as many parts as its count asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Rows of one key that a task may well have: a key with more is hot and split into parts of about so many.
HOT_ROWS = 20_000
#: No more keys than this are ever split (what is broadcast): tables of over HOT_ROWS * HOT_MOST rows ask for accordingly more rows a key.
HOT_MOST = 100_000
#: Rows are looked at with this chance when hot keys are sought; the result never depends on it, only the plan.
SAMPLE = 0.01


def hot_keys(df: DataFrame, keys: list[str], rows: int | None = None, sample: float | None = None) -> DataFrame | None:
    """The hot combinations of ``keys`` with the parts they are to be split into (``_salts``), or None if there are none.

    ``sample`` of 1 takes the table as it is for a sample already drawn, of which ``rows`` make a key hot.
    """
    rows, sample = HOT_ROWS if rows is None else rows, SAMPLE if sample is None else sample
    seen = Observation()
    looked = df.select(*keys) if sample >= 1 else df.select(*keys).sample(sample, seed=7)
    counts = looked.observe(seen, F.count(F.lit(1)).alias("n")).groupBy(*keys).count()
    found = counts.where(F.col("count") > max(1.0, rows * min(sample, 1.0))).orderBy(F.desc("count")).limit(HOT_MOST).collect()
    if not found:
        return None
    part = max(rows * min(sample, 1.0), seen.get["n"] / HOT_MOST)
    hot = [(*(r[k] for k in keys), int(-(-r["count"] // part))) for r in found if r["count"] > part]
    if not hot:
        return None
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.sparkSession.createDataFrame(hot, f"{names}, _salts int")


def salted(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, hot: DataFrame | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a column ``_salt`` to be joined on besides ``keys``.

    The left side's rows of a hot key are spread over its parts by ``spread``; the right side's are repeated for each of
    them. Without hot keys nothing changes.
    """
    if hot is None:
        return left, right, keys
    mark, parts = F.broadcast(hot), F.coalesce("_salts", F.lit(1))  # at most HOT_MOST rows
    left = left.join(mark, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_salts")
    right = right.join(mark, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_salts")
    return left, right, [*keys, "_salt"]
