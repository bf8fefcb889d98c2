"""Detections of the same star in two collections without a common key, each pair with a confidence.

1. Names that tell something (not mere numbering) give anchors; from them every list's frame is fitted to one frame (affine,
   outliers clipped), and every list's magnitude zero point.
2. MinHash blocking across attributes: the set of small cells under a disc about a detection, and the set of letter
   groups of its name. Detections that agree in one band are candidates.
3. Each second-collection star's candidates vote for its motion (cells of velocity, one vote a list); the candidates along the motion
   with most votes make its track. Stars whose track takes them out of their own disc are hashed once more at the place where each
   epoch bin (a year) should show them, and blocked with the first collection's detections of that bin.
4. The candidates of both blockings, and nothing else, are judged by their offset from the track: features of position and brightness
   feed a logistic classifier, trained on weak labels (names that agree or contradict); names then add their own
   log-odds, measured on the pairs that position decides; the result is calibrated on other stars than it was
   trained on. Pairs that only their names brought up are judged, but teach nothing: their names agree by choice. The
   accepted pairs make the tracks anew, and all are judged once more.
5. Within each pair of lists a detection keeps its best partner where the choice is mutual.

Copies of one detection are matched once and written out for each. Defined cases: rows without a position, key or list take no
part; missing magnitudes, names, times (the list's is taken) and errors only weaken the evidence; ties go to the lesser
key; without a single anchor the frames are taken as they are; empty tables give an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.common import checkpointed, finite, released, swept
from skyloom.operators.hot import HOT_ROWS, hot_keys, salted


@dataclass(frozen=True)
class Settings:
    disc: float = 6.0  # radius in pixels of the disc whose cells are hashed: candidates lie up to twice as far apart
    cell: float = 1.0  # side of those cells
    place_hashes: int = 7  # a pair 2 pixels apart is missed with a chance of 1 in 1,700, one 4 apart of 1 in 40
    name_bands: int = 6
    name_rows: int = 3
    motion: float = 0.15  # usual motion in pixels a year
    floor: float = 0.05  # error of a frame in pixels
    mag_floor: float = 0.08  # scatter of magnitudes between filters
    speed_cell: float = 0.2  # side of the cells of velocity that candidates vote for, in pixels a year
    votes: int = 3  # votes that a motion other than none needs at least; a list votes once, with a name that agrees three times
    fastest: float = 10.0  # pixels a year beyond which no motion is drafted
    moved: float = 2.0  # pixels off the own place from which on a predicted place is blocked anew
    serial: float = 0.1  # a name stem with a larger share of a collection's rows is numbering
    sample: int = 60_000  # most labelled pairs that the classifier is fitted on


NAME = r"^([a-z]+)[ _\-]*0*([0-9]+)[ _\-]*([a-z]?)$"


def _detections(df: DataFrame, key: str, times: DataFrame) -> DataFrame:
    """One row for each distinct detection: rep (least key), list, place, magnitude, errors, time, name parts."""
    e = lambda a: F.when((finite(a) > 0), finite(a))
    low = F.lower(F.trim(F.col("name")))
    rows = df.select(
        F.col(key).cast("long").alias("id"), F.col("list_id").cast("long").alias("list"), finite("x").alias("x"), finite("y").alias("y"), finite("m").alias("m"), F.greatest(e("xe"), e("ye")).alias("s"), finite("t").alias("t"),
        F.regexp_extract(low, NAME, 1).alias("stem"), F.nullif(
            F.regexp_extract(low, NAME, 2), F.lit("")
        ).alias("num"), F.regexp_extract(low, NAME, 3).alias("suf"),
    ).where("id is not null and list is not null and x is not null and y is not null")
    rows = rows.join(times, "list", "left").withColumn("t", F.coalesce("t", "list_t")).drop("list_t")
    return rows.groupBy("list", "x", "y", "m").agg(
        F.min("id").alias("id"), *(F.min(c).alias(c) for c in ("s", "t")), F.min_by(F.struct("stem", "num", "suf"), "id").alias("n")
    ).select("id", "list", "x", "y", "m", "s", "t", "n.*")


def _named(a: DataFrame, b: DataFrame, k: Settings) -> tuple[DataFrame, DataFrame]:
    """Both with ``tag`` (first letters, number and suffix of a name that tells something, else NULL)."""
    stems = None
    for df in (a, b):
        often = df.where(F.col("num").isNotNull()).groupBy("stem").count().where(F.col("count") > k.serial * df.count()).select("stem")  # at most 1/serial
        stems = often if stems is None else stems.unionByName(often)
    stems = F.broadcast(stems.distinct())
    tag = F.when(F.col("num").isNotNull() & (F.length("stem") > 1), F.concat(F.substring("stem", 1, 3), "num", "suf"))
    mark = lambda df: df.join(
        stems.withColumn("dull", F.lit(True)), "stem", "left"
    ).withColumn("tag", F.when(F.col("dull").isNull(), tag)).drop("dull")
    return mark(a), mark(b)


def _weighted(pairs: DataFrame) -> DataFrame:
    """The sums of an affine fit of (bx, by) by (x, y) per list."""
    p = {"1": F.lit(1.0), "x": F.col("x"), "y": F.col("y")}
    sums = {
        f"{a}{b}": F.sum(p[a] * p[b]) for a, b in ("11", "1x", "1y", "xx", "xy", "yy")
    } | {f"{a}{c}": F.sum(p[a] * F.col(c)) for a in p for c in ("bx", "by")}
    return pairs.groupBy("list").agg(*(s.alias(n) for n, s in sums.items()), F.percentile_approx(F.col("bm") - F.col("m"), 0.5).alias("zero"))


def _solve(pairs: DataFrame, least: int) -> dict[int, tuple[np.ndarray, np.ndarray, float | None]]:
    """Per list the coefficients of bx and by over (1, x, y), a mere shift below ``least`` pairs, and the zero point. One row a list comes back."""
    out = {}
    for r in _weighted(pairs).collect():
        n = r["11"]
        if n >= least:
            a = np.array([[r["11"], r["1x"], r["1y"]], [r["1x"], r["xx"], r["xy"]], [r["1y"], r["xy"], r["yy"]]])
            scale = 1 / np.sqrt(np.diag(a).clip(1e-300))
            inv = lambda v: scale * (np.linalg.pinv(a * np.outer(scale, scale), rcond=1e-10) @ (scale * v))  # noqa: B023, E731
            cx, cy = inv(np.array([r["1bx"], r["xbx"], r["ybx"]])), inv(np.array([r["1by"], r["xby"], r["yby"]]))
        else:
            cx, cy = np.array([(r["1bx"] - r["1x"]) / n, 1.0, 0.0]), np.array([(r["1by"] - r["1y"]) / n, 0.0, 1.0])
        out[r["list"]] = (cx, cy, r["zero"])
    return out


def _apply(df: DataFrame, fits: dict, names: tuple[str, str, str] = ("u", "v", "w")) -> DataFrame:
    """The table with the place (u, v) and magnitude (w) in the common frame; lists without a fit get the median fit's."""
    rows = [(int(lst), *map(float, cx), *map(float, cy), None if z is None else float(z)) for lst, (cx, cy, z) in fits.items()]
    schema = "list long, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double, zero double"
    f = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # one row a list
    u = F.coalesce(F.col("a0") + F.col("a1") * F.col("x") + F.col("a2") * F.col("y"), F.col("x"))
    v = F.coalesce(F.col("b0") + F.col("b1") * F.col("x") + F.col("b2") * F.col("y"), F.col("y"))
    return df.join(f, "list", "left").withColumns(
        {names[0]: u, names[1]: v, names[2]: F.col("m") + F.coalesce("zero", F.lit(0.0))}
    ).drop("a0", "a1", "a2", "b0", "b1", "b2", "zero")


def _frames(a: DataFrame, b: DataFrame, k: Settings) -> dict:
    """Fits of all lists of both collections to the frame of b's longest list."""
    first = b.groupBy("list").count().orderBy(F.desc("count"), "list").first()
    if first is None:
        return {}
    base = b.where(F.col("list") == first["list"])
    once = lambda df: df.where(F.col("tag").isNotNull()).groupBy("list", "tag").agg(
        F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("x", "y", "m"))
    ).where("n = 1").drop("n")
    ref = once(base).select("tag", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("m").alias("bm"))
    pairs = checkpointed(once(a.unionByName(b)).join(ref, "tag"))
    swept(pairs)
    mid = pairs.groupBy("list").agg(
        F.percentile_approx(F.col("bx") - F.col("x"), 0.5).alias("dx"), F.percentile_approx(F.col("by") - F.col("y"), 0.5).alias("dy")
    ).collect()
    fits = {r["list"]: (np.array([r["dx"], 1.0, 0.0]), np.array([r["dy"], 0.0, 1.0]), 0.0) for r in mid}
    # a list without an anchor stays where it is, its magnitudes level with the others' by their medians
    level = {r["list"]: r["m"] for r in a.unionByName(b).groupBy("list").agg(F.percentile_approx("m", 0.5).alias("m")).collect()}
    for lst, m in level.items():
        if lst not in fits and m is not None and level.get(first["list"]) is not None:
            fits[lst] = (np.array([0.0, 1.0, 0.0]), np.array([0.0, 0.0, 1.0]), level[first["list"]] - m)
    for clip in (40.0, 8.0, 3.0, 2.0):
        r = _apply(pairs, fits)
        fits = fits | _solve(r.where(F.hypot(F.col("u") - F.col("bx"), F.col("v") - F.col("by")) < clip).drop("u", "v", "w"), 8)
    released(pairs)
    return fits


def _place_bands(k: Settings):
    """(id, bin, band) from (id, bin, u, v): the MinHash of the cells under the disc about a place, by each of the hash functions."""
    r = int(np.ceil(k.disc / k.cell))
    ox, oy = (g.ravel() for g in np.meshgrid(np.arange(-r, r + 1), np.arange(-r, r + 1)))
    inside = (ox * ox + oy * oy) * k.cell**2 <= k.disc**2
    ox, oy = ox[inside].astype(np.int64), oy[inside].astype(np.int64)

    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for lo in range(0, len(p), 8192):
                q = p.iloc[lo : lo + 8192]
                cx = np.floor(q["u"].to_numpy() / k.cell).astype(np.int64)[:, None] + ox
                cy = np.floor(q["v"].to_numpy() / k.cell).astype(np.int64)[:, None] + oy
                h = mix(cx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(cy.astype(np.uint64)))
                bin_ = q["bin"].to_numpy().astype(np.uint64)
                bands = []
                for j in range(k.place_hashes):
                    x = (h ^ np.uint64(0x1234567 * (2 * j + 1))) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0xABCD1357 * j)
                    x ^= x >> np.uint64(29)
                    bands.append(mix(x.min(1) ^ mix(bin_ * np.uint64(64) + np.uint64(j))))
                yield pd.DataFrame({"id": np.repeat(q["id"].to_numpy(), k.place_hashes), "band": np.stack(bands, axis=1).ravel().view(np.int64)})

    return run


def _name_bands(k: Settings) -> Column:
    """MinHash bands of the letter groups of a telling name, NULL without one."""
    name = F.concat(F.lit("^"), "stem", "num", "suf", F.lit("$"))
    grams = F.array_distinct(
        F.concat(
            F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.substr(name, i, F.lit(3))),
            F.array(F.concat(F.lit("#"), "num"), F.concat(F.lit("#"), "num", "suf"), "tag")
        )
    )

    def bands_of(hashes: Column) -> Column:
        least = lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(j))))
        return F.array(*(F.xxhash64(F.lit(-1 - b), *(least(b * k.name_rows + i) for i in range(k.name_rows))) for b in range(k.name_bands)))

    # the letter groups are hashed once and bound by a one-element transform
    bands = F.element_at(F.transform(F.array(F.transform(grams, lambda g: F.xxhash64(g))), bands_of), 1)
    return F.when(F.col("tag").isNotNull(), bands)


def _agreeing(left: DataFrame, right: DataFrame, sample: DataFrame) -> DataFrame:
    """The rows of left (ia, band, ...) and right (ib, band, ...) joined on the band; ``sample``: bands of a few rows of left, for hot ones."""
    hot = hot_keys(sample.select("band"), ["band"], rows=max(1, int(HOT_ROWS * FEW)), sample=1.0)
    left, right, keys = salted(left, right, ["band"], F.col("ia"), hot)
    return left.join(right, keys)


#: Hot bands are sought on so small a part of the detections, drawn before they are hashed.
FEW = 0.02
ANY = -1  # the bin of detections that are compared whatever their time


def _places(df: DataFrame, k: Settings, name: str) -> DataFrame:
    """(name, band) of the places (u, v) in their epoch bins."""
    return df.select("id", "bin", "u", "v").mapInPandas(_place_bands(k), "id long, band long").withColumnRenamed("id", name)


def _candidates(a: DataFrame, b: DataFrame, k: Settings) -> DataFrame:
    """(ia, ib, blind): the distinct pairs that agree in a band; blind where a band of their places is among those."""

    def banded(df: DataFrame, name: str) -> DataFrame:
        places = _places(df.withColumn("bin", F.lit(ANY)), k, name).withColumn("blind", F.lit(True))
        names = df.where(F.col("tag").isNotNull()).select(F.col("id").alias(name), F.explode(_name_bands(k)).alias("band"), F.lit(False).alias("blind"))
        return places.unionByName(names)

    found = _agreeing(banded(a, "ia"), banded(b, "ib").drop("blind"), banded(a.sample(FEW, seed=7), "ia"))
    return found.groupBy("ia", "ib").agg(F.max("blind").alias("blind"))


def _predicted(a: DataFrame, b: DataFrame, tracks: DataFrame, known: DataFrame, k: Settings) -> DataFrame:
    """(ia, ib): further pairs, of the detections of an epoch bin and the places where tracks should be then, that agree in a band."""
    bins = F.broadcast(a.where("t is not null").select(F.floor("t").cast("int").alias("bin")).distinct())  # one row a year
    ahead = b.join(tracks, b["id"] == tracks["ib"]).where("t is not null").crossJoin(bins).withColumn("dt", F.col("bin") + 0.5 - F.col("t"))
    ahead = ahead.withColumns(
        {"du": F.col("p0") + F.col("p1") * F.col("dt"), "dv": F.col("q0") + F.col("q1") * F.col("dt")}
    ).where(F.hypot("du", "dv") > k.moved)
    ahead = ahead.select("id", "bin", (F.col("u") + F.col("du")).alias("u"), (F.col("v") + F.col("dv")).alias("v"))
    at = a.where("t is not null").select("id", F.floor("t").cast("int").alias("bin"), "u", "v")
    found = _agreeing(_places(at, k, "ia"), _places(ahead, k, "ib"), _places(at.sample(FEW, seed=7), k, "ia"))
    return found.select("ia", "ib").distinct().join(known, ["ia", "ib"], "left_anti")


SIDE = ("list", "u", "v", "w", "s", "t", "num", "tag")


def _pairs(pairs: DataFrame, a: DataFrame, b: DataFrame, k: Settings) -> DataFrame:
    """The candidates with what they are judged by."""
    left = a.select(F.col("id").alias("ia"), F.substring("stem", 1, 3).alias("stema"), *(F.col(c).alias(f"{c}a") for c in SIDE))
    right = b.select(F.col("id").alias("ib"), F.substring("stem", 1, 3).alias("stemb"), *(F.col(c).alias(f"{c}b") for c in SIDE))
    both = pairs.join(left, "ia").join(right, "ib")
    # slips of a letter or digit are neither agreement nor contradiction
    agree = F.when(F.col("taga").isNull() | F.col("tagb").isNull(), 0).when(F.col("taga") == F.col("tagb"), 1).when(
        (F.col("stema") != F.col("stemb")) & (F.levenshtein("numa", "numb") >= 2), -1
    ).otherwise(0)
    sq = lambda c: F.pow(F.coalesce(c, F.lit(0.3)), 2)
    out = {
        "agree": agree.cast("byte"), "dm": F.abs(F.col("wa") - F.col("wb")).cast("float"), "dt": (F.col("ta") - F.col("tb")).cast("float"), "du": (F.col("ua") - F.col("ub")).cast("float"), "dv": (F.col("va") - F.col("vb")).cast("float"),
        "var0": (sq("sa") + sq("sb") + k.floor**2).cast("float"), "varb": (sq("sb") + k.floor**2).cast("float"),
    }
    return both.select("ia", "ib", F.col("lista").cast("long"), F.col("listb").cast("long"), "blind", *(c.alias(n) for n, c in out.items()))


#: Years that must lie between two detections for them to tell a motion, and magnitudes within which a candidate may vote.
APART, ALIKE = 0.4, 1.0


def _motions(pairs: DataFrame, k: Settings) -> DataFrame:
    """(ib, vx, vy): the motions that more lists vote for than for standing still; ``votes`` votes at least."""
    usable = pairs.where(
        (F.coalesce("dm", F.lit(0.0)) < ALIKE) & F.col("dt").isNotNull()
    ).select("ib", "lista", "agree", "dt", "du", "dv", "var0").repartition("ib")
    still = F.hypot("du", "dv") < 4 * F.sqrt(F.col("var0") + F.pow(k.motion * F.col("dt"), 2))
    vx, vy = F.col("du") / F.col("dt"), F.col("dv") / F.col("dt")
    # two grids each way, half a cell apart, so that agreeing motions share a cell of one of them
    cells = lambda v: (F.floor(v / k.speed_cell) * 2, F.floor(v / k.speed_cell + 0.5) * 2 - 1)
    at = lambda moving, cx, cy, x, y: F.struct(F.lit(moving).alias("moving"), cx.alias("cx"), cy.alias("cy"), x.alias("vx"), y.alias("vy"))
    none = F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0)
    ballots = [
        F.when(still, at(False, *none)),
        *(F.when((F.abs("dt") >= APART) & (F.hypot(vx, vy) <= k.fastest), at(True, cx, cy, vx, vy)) for cx in cells(vx) for cy in cells(vy))
    ]
    votes = usable.select("ib", "lista", "agree", F.explode(F.array_compact(F.array(*ballots))).alias("v")).select("ib", "lista", "agree", "v.*")
    each = votes.groupBy("ib", "moving", "cx", "cy", "lista").agg(
        F.avg("vx").alias("vx"), F.avg("vy").alias("vy"), F.max(F.when(F.col("agree") == 1, 2).otherwise(0)).alias("named")
    )
    sums = each.groupBy("ib", "moving", "cx", "cy").agg((F.count("*") + F.sum("named")).alias("votes"), F.avg("vx").alias("vx"), F.avg("vy").alias("vy"))
    best = F.max_by(F.struct("moving", "vx", "vy"), F.struct("votes", ~F.col("moving"), -F.hypot("vx", "vy"), "cx", "cy"))
    return sums.where((F.col("votes") >= k.votes) | ~F.col("moving")).groupBy("ib").agg(best.alias("m")).select("ib", "m.*").where("moving")


def _links(pairs: DataFrame, k: Settings) -> DataFrame:
    """The candidate of each list that lies best along its star's motion, if near enough."""
    at = pairs.repartition("ib").join(_motions(pairs, k), "ib", "left").fillna(0.0, ["vx", "vy"]).where("dt is not null").withColumn("v2", F.expr("vx * vx + vy * vy"))
    off = F.hypot(F.col("du") - F.col("vx") * F.col("dt"), F.col("dv") - F.col("vy") * F.col("dt"))
    slack = F.sqrt(F.col("var0") + F.pow(F.when(F.col("moving"), k.speed_cell / 2).otherwise(k.motion) * F.col("dt"), 2))
    # a name that agrees draws, an odd brightness repels
    cost = F.pow(off / slack, 2) + F.pow(F.least(F.coalesce(F.col("dm"), F.lit(0.15)) / 0.15, F.lit(20.0)), 2) - 6 * F.col("agree")
    near = at.withColumn("cost", cost).where((off < 4 * slack) & (F.coalesce("dm", F.lit(0.0)) < 3.0))
    best = F.row_number().over(Window.partitionBy("ib", "lista").orderBy("cost", "ia"))
    return near.withColumn("one", best).where("one = 1").withColumn(
        "var", F.col("var0") + F.when(F.col("moving"), 0.04).otherwise(F.pow(k.motion * F.col("dt"), 2))
    )


def _tracks(links: DataFrame, k: Settings) -> DataFrame:
    """Motion of each b star by a clipped straight line through its links: ib, p0, p1 (x), q0, q1 (y), n."""
    w = Window.partitionBy("ib")
    cols = links.select("ib", "dt", "du", "dv", "var", "var0", "varb", "v2").withColumn("wt", 1 / F.col("var"))
    s = lambda e: F.sum(e).over(w)
    for _ in range(2):
        n, t, tt = s(F.col("wt")), s(F.col("wt") * F.col("dt")), s(F.col("wt") * F.col("dt") * F.col("dt"))
        # the b detection itself is a point at dt = 0; a pull to no motion, weaker the faster the drafted motion, keeps short tracks sane
        n, tt = n + 1 / F.col("varb"), tt + 1 / (k.motion**2 + F.col("v2"))
        fit = {}
        for c, v in (("p", F.col("du")), ("q", F.col("dv"))):
            y, ty = s(F.col("wt") * v), s(F.col("wt") * F.col("dt") * v)
            det = n * tt - t * t
            fit[f"{c}1"] = (n * ty - t * y) / det
            fit[f"{c}0"] = (tt * y - t * ty) / det
        cols = cols.withColumns(fit)
        off = F.hypot(F.col("du") - F.col("p0") - F.col("p1") * F.col("dt"), F.col("dv") - F.col("q0") - F.col("q1") * F.col("dt"))
        scale = F.greatest(F.sqrt("var0"), F.percentile(off, 0.5).over(w))
        cols = cols.withColumn("wt", F.when(off > 4 * scale, 1e-6).otherwise(1 / (F.col("var0") + off * off / 9)))
    good = F.count(F.when(F.col("wt") > 1e-5, 1))
    return cols.groupBy("ib").agg(*(F.first(c).alias(c) for c in ("p0", "p1", "q0", "q1")), good.alias("n"))


def _features() -> Column:
    """Position and brightness of a candidate pair as numbers for the classifier."""
    z = F.least(F.col("off") / F.sqrt("var1"), F.lit(30.0))
    dm = F.least(F.coalesce("dm", F.lit(0.15)) / F.lit(0.1), F.lit(30.0))
    return F.array(
        F.lit(1.0), z, F.log1p(z * z), F.log1p(F.col("off") * 10), dm, F.log1p(dm * dm), F.when(F.col("dm").isNull(), 1.0).otherwise(0.0),
        F.log1p("n")
    )


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Tracks (48 bytes each) that are sent to all executors; more are joined by a shuffle, to the same result.
FEW_TRACKS = 500_000


def _judged(pairs: DataFrame, tracks: DataFrame, k: Settings) -> DataFrame:
    """The candidates with their offsets from the tracks."""
    # few tracks go to the candidates, many are met by a shuffle
    at = pairs.join(F.broadcast(tracks) if tracks.count() <= FEW_TRACKS else tracks, "ib", "left").fillna(0.0, ["p0", "p1", "q0", "q1"]).fillna(0, ["n"])
    dt = F.coalesce("dt", F.lit(0.0))
    off = F.hypot(F.col("du") - F.col("p0") - F.col("p1") * dt, F.col("dv") - F.col("q0") - F.col("q1") * dt)
    slow = F.when(F.col("n") < 3, F.pow(k.motion * F.coalesce("dt", F.lit(5.0)), 2)).otherwise(0.0)
    return at.withColumns({"off": off, "var1": F.col("var0") + slow, "v2": F.expr("p1 * p1 + q1 * q1")}).drop("p0", "p1", "q0", "q1")


def _accepted(pairs: DataFrame, k: Settings) -> DataFrame:
    """The pairs with a confidence of a half at least that are each other's best in their two lists."""
    scored = pairs.withColumn("confidence", _classifier(pairs.withColumn("f", _features()), k)).where(F.col("confidence") >= 0.5)
    one = F.row_number().over(Window.partitionBy("ib", "lista").orderBy(F.desc("confidence"), "off", "ia"))
    two = F.row_number().over(Window.partitionBy("ia", "listb").orderBy(F.desc("confidence"), "off", "ib"))
    return scored.withColumn("one", one).withColumn("two", two).where("one = 1 and two = 1").drop("one", "two")


def matched(star: DataFrame, ext: DataFrame, lists: DataFrame, k: Settings = Settings()) -> DataFrame:
    """(row_id, ext_id, confidence): the pairs of detections of one star."""
    times = lists.where(F.col("list_id").isNotNull()).groupBy(F.col("list_id").cast("long").alias("list")).agg(F.min(finite("list_time")).alias("list_t"))
    a, b = _named(checkpointed(_detections(star, "row_id", times)), checkpointed(_detections(ext, "ext_id", times)), k)
    fits = _frames(a, b, k)
    a, b = _apply(a, fits), _apply(b, fits)
    # what a step has shuffled is swept away after it: the steps' files never lie on the disk together
    candidates = swept(checkpointed(_candidates(a, b, k)))
    first = swept(checkpointed(_pairs(candidates, a, b, k)))
    released(candidates)
    drafts = swept(checkpointed(_tracks(_links(first, k), k)))
    known = first.select("ia", "ib")
    # once more with the motions that the accepted pairs show
    links = _accepted(_judged(first, drafts, k), k).where("dt is not null").withColumn("var", F.col("var0") + 0.04)
    links = swept(checkpointed(links))
    tracks = swept(checkpointed(_tracks(links, k).unionByName(drafts.join(links.select("ib"), "ib", "left_anti"))))
    released(drafts, links)
    further = swept(checkpointed(_predicted(a, b, tracks, known, k)))
    second = swept(checkpointed(_pairs(further.withColumn("blind", F.lit(True)), a, b, k)))
    released(further)
    best = swept(checkpointed(_accepted(_judged(first.unionByName(second), tracks, k), k).select("ia", "ib", "confidence")))
    released(first, second, tracks)
    # every copy
    same = lambda df, key: df.select(
        F.col(key).cast("long").alias("id"), F.col("list_id").cast("long").alias("list"), finite("x").alias("x"), finite("y").alias("y"),
        finite("m").alias("m")
    )
    eq = lambda p, q: (p["list"] == q["list"]) & (p["x"] == q["x"]) & (p["y"] == q["y"]) & p["m"].eqNullSafe(q["m"])

    def copies(df: DataFrame, key: str, reps: DataFrame, rep: str) -> DataFrame:
        p, q = same(df, key).alias("p"), reps.select(F.col("id").alias(rep), "list", "x", "y", "m").alias("q")
        return p.join(
            q, eq({c: F.col(f"p.{c}") for c in ("list", "x", "y", "m")}, {c: F.col(f"q.{c}") for c in ("list", "x", "y", "m")})
        ).select(F.col("p.id").alias(key), rep)

    out = best.join(copies(star, "row_id", a, "ia"), "ia").join(copies(ext, "ext_id", b, "ib"), "ib")
    return out.select("row_id", "ext_id", "confidence")


def _posterior(logit: np.ndarray, agree: np.ndarray, wrong: float, chance: float) -> np.ndarray:
    """The chance of a match given position and brightness (logit) and whether the names agree."""
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    yes, no = p * np.where(agree == 1, 1 - wrong, wrong), (1 - p) * np.where(agree == 1, chance, 1 - chance)
    return yes / np.maximum(yes + no, 1e-300)


def _classifier(pairs: DataFrame, k: Settings) -> Column:
    """The calibrated confidence of a candidate pair as an expression."""
    h = F.pmod(F.xxhash64("ib"), F.lit(1_000_000))
    labelled = pairs.where("agree <> 0 and blind").select(
        (F.col("agree") == 1).cast("int").alias("y"), "f", F.pmod(h, F.lit(2)).alias("half"), F.xxhash64("ia", "ib").alias("o")
    )
    rows = labelled.orderBy("o").limit(k.sample).select("y", "f", "half").toPandas()
    wrong, chance = 0.08, 0.01  # how often a match's names contradict and a chance pair's agree: starting values
    if len(rows) < 30 or rows["y"].nunique() < 2:
        w, scale, shift = np.array([4.0, -0.3, -0.9, -0.3, -0.2, -0.8, 0.0, 0.1]), 1.0, 0.0  # fixed values for want of labels
    else:
        x, y, half = np.array(rows["f"].tolist()), rows["y"].to_numpy(float), rows["half"].to_numpy()
        train, held = half == 0, half == 1
        if min(train.sum(), held.sum()) < 15 or len(set(y[train])) < 2 or len(set(y[held])) < 2:
            train = held = np.ones(len(y), bool)
        soft = np.where(y == 1, 0.98, 0.15)
        for _ in range(25):  # names are noisy labels: expectation and maximisation over what the pairs really are
            w = _logistic(x[train], soft[train])
            soft = _posterior(x @ w, y, wrong, chance)
            wrong = float(np.clip(soft[train] @ (1 - y[train]) / soft[train].sum(), 0.005, 0.3))
            chance = float(np.clip((1 - soft[train]) @ y[train] / max((1 - soft[train]).sum(), 1e-9), 1e-4, 0.2))
        # Platt's calibration on the held-out stars
        shift, scale = _logistic(np.c_[np.ones(held.sum()), x[held] @ w], _posterior(x[held] @ w, y[held], wrong, chance))
    logit = F.lit(float(shift)) + F.lit(float(scale)) * F.aggregate(
        F.zip_with(_features(), F.array(*(F.lit(float(v)) for v in w)), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v
    )
    yes, no = np.log((1 - wrong) / chance), np.log(wrong / (1 - chance))
    odds = logit + F.when(F.col("agree") == 1, F.lit(float(yes))).when(F.col("agree") == -1, F.lit(float(no))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))
