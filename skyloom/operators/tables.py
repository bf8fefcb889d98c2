"""Tables of many epochs in long form: stars, their readings list by list, and the lists.

Defined cases: a list's rows meet the stars by ``star_id``; a star that a list lacks has NULLs there; a column that a list lacks is NULL
for all its readings; repeated rows of a star in one list are refused; empty lists add an epoch without readings.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns every table has, and those that belong to one list as a whole.
NEEDED, META = ("x", "y", "m"), ("list_name", "list_time")


@dataclass(frozen=True)
class StarTable:
    """``stars``: star_id, name, ...; ``obs``: star_id, list_id, readings; ``lists``: list_id, list_name, list_time; ``ref_list``: the reference."""

    stars: DataFrame
    obs: DataFrame
    lists: DataFrame
    ref_list: int = 0

    @property
    def columns(self) -> list[str]:
        return [c for c in self.obs.columns if c not in ("star_id", "list_id")]


def _checked(df: DataFrame, what: str, both: tuple[str, ...] = ("xe", "ye")) -> DataFrame:
    missing = {"star_id", *NEEDED} - set(df.columns)
    if missing:
        raise ValueError(f"{what} lacks {sorted(missing)}")
    if len({c in df.columns for c in both}) > 1:
        raise ValueError(f"{what}: {' and '.join(both)} both or neither")
    return df


def create(stars: DataFrame, lists: list[DataFrame], ref_list: int = 0, times: list[float] | None = None, names: list[str] | None = None) -> StarTable:
    """A table from the stars (star_id, name) and one frame a list (star_id, x, y, m, ...), numbered from 0."""
    if not {"star_id", "name"} <= set(stars.columns):
        raise ValueError("stars need star_id and name")
    if not lists:
        raise ValueError("a table needs a list")
    if not 0 <= ref_list < len(lists):
        raise ValueError(f"ref_list {ref_list} is none of {len(lists)} lists")
    if any(v is not None and len(v) != len(lists) for v in (times, names)):
        raise ValueError("times and names: one for each list")
    spark = stars.sparkSession
    info = spark.createDataFrame([], "list_id long, list_name string, list_time double")
    table = StarTable(
        stars,
        _checked(lists[0], "list 0").select(
            "star_id", F.lit(0).cast("long").alias("list_id"), *(c for c in lists[0].columns if c not in ("star_id", "list_id"))
        ).where(F.lit(False)),
        info, ref_list
    )
    for k, df in enumerate(lists):
        table = add_list(table, df, k, None if times is None else times[k], None if names is None else names[k])
    return table


def add_list(table: StarTable, rows: DataFrame | None, list_id: int, time: float | None = None, name: str | None = None) -> StarTable:
    """The table with one list more; without rows an epoch that has no reading yet."""
    info = table.lists.sparkSession.createDataFrame(
        [(list_id, name, None if time is None else float(time))], "list_id long, list_name string, list_time double"
    )
    if table.lists.where(F.col("list_id") == list_id).limit(1).count():
        raise ValueError(f"list {list_id} is there already")
    obs = table.obs
    if rows is not None:
        fresh = _checked(rows, f"list {list_id}").drop("list_id").withColumn("list_id", F.lit(list_id).cast("long"))
        if fresh.groupBy("star_id").count().where("count > 1").limit(1).count():
            raise ValueError(f"list {list_id} has a star twice")
        if fresh.join(table.stars, "star_id", "left_anti").limit(1).count():
            raise ValueError(f"list {list_id} has stars that the table lacks")
        obs = obs.unionByName(fresh, allowMissingColumns=True)
    return replace(table, obs=obs, lists=table.lists.unionByName(info))


def add_values(table: StarTable, list_id: int, time: float | None = None, name: str | None = None, **values: DataFrame) -> StarTable:
    """As ``add_list``, from one frame (star_id, value) for each column."""
    rows = None
    for column, df in values.items():
        one = df.select("star_id", F.col("value").alias(column))
        rows = one if rows is None else rows.join(one, "star_id", "full")
    return add_list(table, rows, list_id, time, name)


def invalidated(table: StarTable, list_ids: list[int] | None = None, star_ids: DataFrame | None = None, columns: list[str] | None = None) -> StarTable:
    """The table with readings made NULL: of some lists, of some stars (star_id), of both together where both are given."""
    if list_ids is None and star_ids is None:
        return table
    hit, obs = F.lit(True), table.obs
    if list_ids is not None:
        hit = hit & F.col("list_id").isin(list_ids)
    if star_ids is not None:
        obs = obs.join(star_ids.select("star_id").distinct().withColumn("_hit", F.lit(True)), "star_id", "left")
        hit = hit & F.coalesce("_hit", F.lit(False))
    bad = columns if columns is not None else table.columns
    return replace(table, obs=obs.withColumns({c: F.when(~hit, F.col(c)) for c in bad}).drop("_hit"))


def full(table: StarTable) -> DataFrame:
    """One row for each star and list, NULL where a star has no reading. The lists are few (one row an image) and go to all executors."""
    return table.stars.select("star_id").crossJoin(F.broadcast(table.lists)).join(table.obs, ["star_id", "list_id"], "left")
