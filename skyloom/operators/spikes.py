"""Implausible readings per source: impossible values, frozen runs, and spikes against the source's own behaviour.

Each source's readings are put in order of time. A rolling median and median absolute deviation about the source's
steady motion (Hampel filter, the slope by Theil and Sen) sets the clear outliers aside; every reading is then held
against the scatter of the others in its window. The window is ``HALF`` readings to either side, so for sources of up to
``HALF`` + 1 readings it is the whole source.

Rows travel once, by source; the filter runs over many sources at a time on padded arrays. A source that holds a large
share of all rows is first reduced to its distinct epochs and then cut into runs of ``CHUNK`` epochs with ``HALF`` epochs
of overlap, so no task gets all of it and each window is still whole.

Defined cases: NULL and NaN are missing, never a case; a reading without a time (own or of its list) or without a source is only
tested for impossible values; repeated rows (the same source, list, time and values) are judged as one reading and all reported,
other rows of the same list are readings of their own; a row without a list repeats none; rows without an id count
as readings but can't be reported; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.common import finite, present
from skyloom.operators.hot import hot_keys, salted

HALF, CHUNK = 32, 4096
#: A frozen run has at least so many epochs; a spike needs at least so many readings of the field.
FROZEN, ENOUGH = 4, 9
#: Outliers that the Hampel filter sets aside, and the verdict, in scatters; weight of the stated errors in the scatter, in readings.
HAMPEL, SPIKE, PRIOR = 6.0, 7.25, 10.0
#: Usual scatter of the logarithm of a source's errors, and the verdict in such scatters (only upwards).
ERROR_SCATTER, ERROR_SPIKE = 0.25, 6.0
FIELDS = ("x", "y", "m", "xe")
#: (least, least excluded, most) of each field.
BOUNDS = {"x": (-1000.0, False, 1e7), "y": (-1000.0, False, 1e7), "m": (-40.0, False, 45.0), "xe": (0.0, True, float("inf"))}


def impossible(field: str) -> Column:
    """Whether a present value can't be."""
    lo, open_, hi = BOUNDS[field]
    v = F.col(field)
    bad = (F.abs(v) == float("inf")) | (v <= lo if open_ else v < lo) | (v > hi)
    return F.coalesce(v.isNotNull() & ~F.isnan(v) & bad, F.lit(False))


def _impossible(field: str, v: np.ndarray) -> np.ndarray:
    lo, open_, hi = BOUNDS[field]
    with np.errstate(invalid="ignore"):
        return np.isinf(v) | ((v <= lo) if open_ else (v < lo)) | (v > hi)


def _median(a: np.ndarray) -> np.ndarray:
    """Median of each row without its NaNs; NaN where there is nothing."""
    s = np.sort(a, axis=1)
    n = (~np.isnan(s)).sum(1)
    i = np.arange(len(s))
    lo, hi = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, max(a.shape[1] - 1, 0))
    return np.where(n > 0, (s[i, lo] + s[i, hi]) / 2, np.nan)


def spikes(t: np.ndarray, v: np.ndarray, err: np.ndarray, moving: bool) -> np.ndarray:
    """For each row (a window of readings, NaN = unusable) how many scatters each reading lies off the others."""
    if moving:
        i, j = np.triu_indices(v.shape[1], 1)
        dt = t[:, j] - t[:, i]
        with np.errstate(invalid="ignore", divide="ignore"):
            slope = _median(np.where(dt != 0, (v[:, j] - v[:, i]) / dt, np.nan))
        slope = np.where(np.isfinite(slope), slope, 0.0)
        mid = _median(np.where(np.isnan(v), np.nan, t))
        dt = t - mid[:, None]
        r = v - slope[:, None] * dt
    else:
        dt, r = np.zeros_like(v), v
    r = r - _median(r)[:, None]
    mad = 1.4826 * _median(np.abs(r))
    usual = np.where(np.isnan(err), 0.0, err)
    with np.errstate(invalid="ignore"):
        clean = np.abs(r) <= HAMPEL * np.maximum(np.maximum(mad, usual), 1e-12)[:, None]
    w = clean.astype(float)
    y, d = np.where(clean, r, 0.0), np.where(clean, dt, 0.0)
    one = (w, d, d * d, y, y * d, y * y)
    n, st, stt, sy, sty, syy = (a.sum(1)[:, None] - a for a in one)  # of the other readings of the window
    here, value = np.where(np.isnan(dt), 0.0, dt), r
    with np.errstate(invalid="ignore", divide="ignore"):
        det = n * stt - st * st
        line = moving & (det > 1e-9 * np.maximum(n * stt, 1e-300)) & (n > 2)
        b = np.where(line, (n * sty - st * sy) / np.where(line, det, 1.0), 0.0)
        a = (sy - b * st) / n
        sse = np.maximum(syy - a * sy - b * sty, 0.0)
        free = n - np.where(line, 2, 1)
        prior = np.where(np.isnan(err) | (err <= 0), 0.0, PRIOR)[:, None]
        e2 = (usual * usual)[:, None]
        lever = np.where(line, (stt - 2 * here * st + n * here * here) / np.where(line, det, 1.0), 1 / n)
        scatter = np.sqrt((sse + prior * e2) / (free + prior))
        off = (value - a - b * here) / np.maximum(scatter * np.sqrt(1 + np.minimum(lever, 4.0)), 1e-12)
    # three others determine the line; one degree of freedom without a stated error is no scatter to judge by
    return np.where((n > 2) & (free + prior > 1), off, np.nan)


def _judge(p: pd.DataFrame) -> pd.DataFrame:
    """Cases (key, field) among whole groups, in order of group and time. Columns: _g (group number), _t, fields, ye, me."""
    n = len(p)
    g, t = p["_g"].to_numpy(), p["_t"].to_numpy(float)
    first = np.r_[True, g[1:] != g[:-1]]
    start = np.flatnonzero(first)
    size = np.diff(np.r_[start, n])
    col = {f: p[f].to_numpy(float) for f in (*FIELDS, "ye", "me")}
    timed = ~np.isnan(t)
    found: dict[str, np.ndarray] = {}
    usable: dict[str, np.ndarray] = {}
    for f in FIELDS:
        v = col[f]
        bad = _impossible(f, v)
        same = np.zeros(n, bool)
        same[1:] = (v[1:] == v[:-1]) & (g[1:] == g[:-1]) & timed[1:] & timed[:-1]
        run = np.cumsum(~same)
        frozen = (np.bincount(run)[run] >= FROZEN) & ~np.isnan(v) & timed
        found[f] = bad | frozen
        usable[f] = timed & ~np.isnan(v) & ~found[f]
    errors = {"x": "xe", "y": "ye", "m": "me"}
    for least, most in ((ENOUGH, 12), (13, 17), (18, 24), (25, HALF + 1), (HALF + 2, None)):
        pick = np.flatnonzero((size >= least) & (size <= most if most else True))
        if not len(pick):
            continue
        if most:  # whole sources, one a row
            at = start[pick][:, None] + np.arange(most)[None, :]
            inside = np.arange(most)[None, :] < size[pick][:, None]
            blocks = [(at, inside, None)]
        else:  # one reading's window a row
            blocks = []
            for k in pick:
                for b in range(0, size[k], 512):
                    i = np.arange(b, min(b + 512, size[k]))
                    at = i[:, None] + np.arange(-HALF, HALF + 1)[None, :]
                    blocks.append((start[k] + at, (at >= 0) & (at < size[k]), start[k] + i))
        for at, inside, centre in blocks:
            at = np.where(inside, at, 0)
            tt = np.where(inside, t[at], np.nan)
            for f in FIELDS:
                seen = inside & timed[at] & ~np.isnan(col[f][at])
                enough = seen.sum(1) >= ENOUGH
                if not enough.any():
                    continue
                a, s = at[enough], (inside & usable[f][at])[enough]
                v = np.where(s, col[f][a], np.nan)
                if f == "xe":
                    off = spikes(tt[enough], np.log(v), np.full(len(v), ERROR_SCATTER), False) / ERROR_SPIKE
                else:
                    e = col[errors[f]][a]
                    with np.errstate(invalid="ignore"):
                        e = _median(np.where(s & (e > 0) & np.isfinite(e), e, np.nan))
                    off = np.abs(spikes(tt[enough], v, e, f != "m")) / SPIKE
                with np.errstate(invalid="ignore"):
                    hit = s & (off > 1)
                if centre is None:
                    found[f][a[hit]] = True
                else:
                    mid = hit[:, HALF]
                    found[f][centre[enough][mid]] = True
    return pd.concat([pd.DataFrame({"_i": np.flatnonzero(found[f]), "field": f}) for f in FIELDS], ignore_index=True)


def _kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Judges sorted rows; the last group of a batch waits for the next, as it may go on there."""

    def judged(p: pd.DataFrame) -> pd.DataFrame:
        star, chunk, one, two = (p[c].to_numpy() for c in ("_star", "_chunk", "_c1", "_c2"))
        new = np.r_[True, (star[1:] != star[:-1]) | (chunk[1:] != chunk[:-1])]
        # copies of one reading follow each other
        alone = p["_alone"].to_numpy(bool)
        again = np.r_[False, ~new[1:] & (one[1:] == one[:-1]) & (two[1:] == two[:-1]) & ~alone[1:] & ~alone[:-1]]
        epoch = np.cumsum(~again) - 1
        q = p[~again].assign(_g=np.cumsum(new)[~again]).reset_index(drop=True)
        cases = _judge(q)
        # back to every copy
        rows = pd.DataFrame({"_i": epoch, "_row": np.arange(len(p))}).merge(cases, on="_i")
        out = p.iloc[rows["_row"].to_numpy()][["_id", "_named", "_star", "_c1", "_c2", "_alone", "_core"]].assign(field=rows["field"].to_numpy())
        return out[out["_core"]].drop(columns="_core")

    kept: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        if not len(b):
            continue
        kept.append(b)
        size += len(b)
        last = (b["_star"].iloc[-1], b["_chunk"].iloc[-1])
        if size < 30_000 or (b["_star"].iloc[0], b["_chunk"].iloc[0]) == last:
            continue
        p = pd.concat(kept, ignore_index=True)
        cut = int(((p["_star"] == last[0]) & (p["_chunk"] == last[1])).to_numpy().argmax())
        yield judged(p.iloc[:cut].reset_index(drop=True))
        kept, size = [p.iloc[cut:]], len(p) - cut
    if kept:
        yield judged(pd.concat(kept, ignore_index=True))


ORDER = ["_t", "_list", "_c1", "_c2", "_id"]
KEPT = ["_id", "_named", "_star", "_t", *FIELDS, "ye", "me", "_c1", "_c2", "_alone", "_chunk", "_core"]


def implausible(obs: DataFrame, lists: DataFrame, key: str = "obs_id", star: str = "star_id", epoch: str = "list_id") -> DataFrame:
    """Distinct (obs_id, field) of the implausible readings."""
    times = lists.where(F.col("list_id").isNotNull()).groupBy(F.col("list_id").alias("_list")).agg(F.min(finite("list_time")).alias("_list_time"))
    values = [present(f).alias(f) for f in (*FIELDS, "ye", "me")]
    # an id of 0 stands for a missing one, which _named tells: with NULLs pandas would make doubles of all
    base = obs.select(
        F.coalesce(F.col(key), F.lit(0)).cast("long").alias("_id"), F.col(key).isNotNull().alias("_named"), F.col(star).alias("_star"),
        F.col(epoch).alias("_list"), finite("t").alias("_own"), *values
    )
    base = base.join(times, "_list", "left").withColumn("_t", F.coalesce("_own", "_list_time")).drop("_own", "_list_time")
    # 128 bits tell a reading from others; NULLs are marked, as the hash passes over them
    whole = [F.col("_list"), *(x for c in ("_t", *FIELDS, "ye", "me") for x in (F.col(c), F.col(c).isNull()))]
    same = {"_c1": F.xxhash64(*whole), "_c2": F.xxhash64(F.lit(1), *whole), "_alone": F.col("_list").isNull()}
    rows = base.where(F.col("_star").isNotNull()).withColumns({**same, "_chunk": F.lit(0).cast("long"), "_core": F.lit(True)})
    lone = base.where(F.col("_star").isNull()).withColumn(
        "field", F.explode(F.array_compact(F.array(*(F.when(impossible(f), F.lit(f)) for f in FIELDS))))
    ).where("_named").select("_id", "field")

    def cases(df: DataFrame) -> DataFrame:
        parted = df.repartition("_star", "_chunk").sortWithinPartitions("_star", "_chunk", F.col("_t").asc_nulls_last(), *ORDER[1:])
        return parted.select(*KEPT).mapInPandas(_kernel, "_id long, _named boolean, _star long, _c1 long, _c2 long, _alone boolean, field string")

    hot = hot_keys(rows, ["_star"])
    if hot is None:
        found = cases(rows).where("_named").select("_id", "field")
    else:
        mark = F.broadcast(hot.drop("_salts"))
        found = cases(rows.join(mark, "_star", "left_anti")).where("_named").select("_id", "field")
        much = rows.join(mark, "_star")
        flagged = cases(_chunked(much))
        # a reading without a list has no copies: it is reported by its own id
        own, keys = flagged.where("_alone and _named").select("_id", "field"), ["_star", "_c1", "_c2"]
        copies, cases_of = much.where("_named and not _alone").select(*keys, "_id"), flagged.where("not _alone").select(*keys, "field")
        copies, cases_of, keys = salted(copies, cases_of, keys, F.col("_id"), hot_keys(copies, keys))
        found = found.unionByName(copies.join(cases_of, keys).select("_id", "field")).unionByName(own)
    return found.unionByName(lone).distinct().select(F.col("_id").alias("obs_id"), "field")


def _chunked(rows: DataFrame) -> DataFrame:
    """The distinct readings of the hot sources, cut into chunks with ``HALF`` of overlap.

    Places in the order of time come from counts per slice (quantiles of time) plus the place within the slice.
    """
    once = rows.where("not _alone").groupBy(
        "_star", "_list", "_t", *FIELDS, "ye", "me", "_c1", "_c2", "_alone"
    ).agg(F.min("_id").alias("_id"), F.max("_named").alias("_named"))
    cols = ["_star", "_list", "_t", *FIELDS, "ye", "me", "_c1", "_c2", "_alone", "_id", "_named"]
    reps = once.select(*cols).unionByName(rows.where("_alone").select(*cols))
    timed = reps.where(F.col("_t").isNotNull())
    cuts = timed.groupBy("_star").agg(F.percentile_approx("_t", [i / 256 for i in range(1, 256)], 10_000).alias("_cuts"))
    sliced = timed.join(cuts, "_star").withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col("_t")))).drop("_cuts")
    counts = sliced.groupBy("_star", "_slice").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_star").orderBy("_slice")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_star", "_slice").orderBy(*ORDER)) - 1 + F.col("_before")
    placed = sliced.join(before, ["_star", "_slice"]).withColumn("_place", place)
    near = F.explode(F.array_distinct(F.array(*(F.floor((F.col("_place") + s) / CHUNK) for s in (-HALF, 0, HALF)))))
    cut = placed.withColumn("_chunk", near).where(F.col("_chunk") >= 0).withColumn("_core", F.floor(F.col("_place") / CHUNK) == F.col("_chunk"))
    rest = reps.where(F.col("_t").isNull()).withColumns({"_chunk": -1 - F.pmod("_c1", F.lit(256)), "_core": F.lit(True)})
    cols = [*KEPT, "_list"]
    return cut.select(*cols).unionByName(rest.select(*cols))
