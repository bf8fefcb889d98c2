"""Building a multi-epoch table from many lists: the loop of matching, fitting and combining.

Lists are taken in order, as each list's match may add stars and change the reference for the next; only the final match is one
job over all of them. Tables stay distributed; the driver holds the transforms and the loop. Each list's result is cut
off with a checkpoint in the shared folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.common import checkpointed, finite, released
from skyloom.functions import models
from skyloom.functions.models import Transform
from skyloom.operators import combine, crossmatch, filters, fits, motion, triangles
from skyloom.operators.hot import HOT_ROWS

#: What a fit takes of either side of a match.
FITTED = ("x", "y", "m", "xe", "ye")


def none_held() -> Column:
    return F.array().cast(combine.HELD)


def per_iteration(value, n: int, name: str) -> list:
    """A setting for each iteration: one value repeated, or as many as there are iterations."""
    out = list(value) if isinstance(value, (list, tuple)) else [value] * n
    if len(out) != n:
        raise ValueError(f"{name}: {len(out)} values for {n} iterations")
    return out


@dataclass
class Mosaic:
    """Settings of a mosaic. lists: list_id -> star list (row_id, name, x, y, m[, xe, ye, me, t]); ``reference`` only for a mosaic to one."""

    lists: dict[int, DataFrame]
    reference: DataFrame | None = None
    ref_index: int | None = None
    iters: int = 2
    dr_tol: float | list[float] = 1.0
    dm_tol: float | None | list = None
    outlier_tol: float | None | list = None
    order: int | list[int] = 1
    init_order: int = 1
    mag_trans: bool = True
    mag_lim: dict[int, tuple] | None = None
    ref_mag_lim: tuple | None = None
    weights: str | None = None
    weighting: str | None = "var"  # of the stars' means and motions: by errors (var, std) or, with None, plain
    compat: bool = False  # with motions the magnitudes are weighted just where the rest isn't
    trans_input: dict[int, Transform] | None = None
    use_vel: bool = False
    calc_trans_inverse: bool = False
    init_guess_mode: str = "miracle"
    use_ref_new: bool = True
    update_ref_orig: bool | str = True
    n_bright: int = 50
    iter_callback: Callable | None = None
    trans: dict[int, Transform] = field(default_factory=dict)
    trans_inverse: dict[int, Transform] = field(default_factory=dict)
    _written: dict[int, tuple[DataFrame, float, int]] = field(default_factory=dict, init=False, repr=False)

    def __post_init__(self) -> None:
        if not self.lists:
            raise ValueError("a mosaic needs a list")
        for name in ("dr_tol", "dm_tol", "outlier_tol", "order"):
            setattr(self, name, per_iteration(getattr(self, name), self.iters, name))
        if self.mag_lim is not None and not isinstance(self.mag_lim, dict):  # one pair for all lists
            self.mag_lim = {k: tuple(self.mag_lim) for k in self.lists}
        if self.trans_input is not None and not isinstance(self.trans_input, dict):  # one model for each list in turn
            if len(self.trans_input) != len(self.lists):
                raise ValueError(f"trans_input: {len(self.trans_input)} models for {len(self.lists)} lists")
            self.trans_input = dict(zip(self.lists, self.trans_input))
        if self.weighting not in (None, "var", "std") or self.init_guess_mode not in ("miracle", "name"):
            raise ValueError("weighting: var, std or None; init_guess_mode: miracle or name")

    def settings(self) -> dict:
        """The settings as plain values, for the log of a run."""
        plain = {k: v for k, v in vars(self).items() if k not in ("lists", "reference", "iter_callback", "trans", "trans_inverse", "_written")}
        models_ = {k: {"kind": t.kind, "coefficients": t.coefficients, "mag_offset": t.mag_offset} for k, t in (self.trans_input or {}).items()}
        return plain | {"lists": list(self.lists), "to_reference": self.reference is not None, "trans_input": models_}

    def write_settings(self, path: str) -> None:
        """The settings as a JSON file of the driver."""
        with open(path, "w") as f:
            json.dump(self.settings(), f, indent=1, default=str)

    def _std(self, df: DataFrame, lst: int) -> DataFrame:
        base = {"xe": 1.0, "ye": 1.0, "me": 1.0, "t": 0.0}
        out = df.withColumns({c: F.lit(v) for c, v in base.items() if c not in df.columns})
        return out.select(
            F.lit(lst).cast("long").alias("list_id"), F.col("row_id").cast("long").alias("id"), "name",
            *(F.col(c).cast("double").alias(c) for c in ("x", "y", "m", "xe", "ye", "me", "t"))
        )

    def _seed(self) -> DataFrame:
        """The stars to begin with: the reference, or the list chosen for it."""
        src = self.reference if self.reference is not None else self.lists[self.ref_index if self.ref_index is not None else next(iter(self.lists))]
        src = filters.fill_reference(filters.rename_for_ref(src) if "x0" not in src.columns else src)
        cols = {"x0e": 0.0, "y0e": 0.0, "m0e": 0.0, "vx": None, "vy": None, "vxe": None, "vye": None, "t0": None}
        src = src.withColumns({c: F.lit(v).cast("double") for c, v in cols.items() if c not in src.columns})
        key = F.col("row_id").cast("long")
        return src.select(
            F.concat(F.lit("r"), key).alias("star_id"), F.coalesce("name", F.concat(F.lit("r"), key)).alias("name"),
            *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "m0", *cols)), F.lit(True).alias("use_in_trans"), F.lit(True).alias("ref_orig")
        )

    def guess(self, ref: DataFrame, lst: DataFrame) -> Transform:
        """A first transform from equal names or from triangles of the brightest."""
        a, b = ref.select(F.col("star_id").alias("id"), "name", "x", "y", "m"), lst.select("id", "name", "x", "y", "m")
        if self.init_guess_mode == "name":
            pairs = crossmatch.guess_join(a, b).select("id_1", "id_2", F.lit(1.0).alias("w"))
        else:
            n = min(self.n_bright, a.count(), b.count())
            # true pairs share most of their triangles, chance ones a few: votes weigh
            pairs = triangles.triangle_match(a, b, n).select("id_1", "id_2", F.col("votes").cast("double").alias("w"))
        pairs = checkpointed(self._pairs(ref, lst, pairs.select("id_1", "id_2")).join(pairs.select("id_2", "w"), "id_2"))
        if pairs.count() < 3:
            raise ValueError("fewer than three matches for the first transform")
        return fits.fit(pairs, self.init_order, mag_trans=self.mag_trans)[()]

    @staticmethod
    def _pairs(ref: DataFrame, lst: DataFrame, matches: DataFrame) -> DataFrame:
        """Matches with the list's own values and, with _ref, the reference's."""
        r = ref.select(F.col("star_id").alias("id_1"), "use_in_trans", *(F.col(c).alias(f"{c}_ref") for c in ("x", "y", "m", "xe", "ye")))
        return matches.select("id_1", "id_2").join(r, "id_1").join(lst.withColumnRenamed("id", "id_2"), "id_2")

    def _read(self, lst_id: int) -> tuple[DataFrame, float, int]:
        """A list in its usual form, written once for all passes, with its time and its rows."""
        if lst_id not in self._written:
            lst = checkpointed(self._std(self.lists[lst_id], lst_id))
            t, n = lst.agg(F.min_by("t", "id"), F.count("*")).first()
            self._written[lst_id] = lst, t or 0.0, n
        return self._written[lst_id]

    def one_pass(self, stars: DataFrame, lst_id: int, it: int) -> DataFrame:
        """Fit one list to the stars (which hold their readings of this iteration) and take its readings in."""
        lst, t, n = self._read(lst_id)
        ref = self._reference_at(stars, t)
        trimmed_ref = filters.mag_lim_as_flag(ref, *(self.ref_mag_lim or (None, None)))
        trimmed = filters.apply_mag_lim(lst, *((self.mag_lim or {}).get(lst_id) or (None, None)))
        model = self.trans.get(lst_id) or (self.trans_input or {}).get(lst_id) or self.guess(trimmed_ref.where("use_in_trans"), trimmed)
        dr, dm = per_iteration(self.dr_tol, self.iters, "dr_tol")[it], per_iteration(self.dm_tol, self.iters, "dm_tol")[it]
        tol, order = per_iteration(self.outlier_tol, self.iters, "outlier_tol")[it], per_iteration(self.order, self.iters, "order")[it]
        a = trimmed_ref.select(F.col("star_id").alias("id"), "x", "y", "m", "use_in_trans", *(F.col(c).alias(f"{c}_ref") for c in FITTED))
        moved = fits.applied(trimmed.withColumns({f"{c}_own": F.col(c) for c in FITTED}), {(): model})
        # the matches carry what the fit takes, so nothing is joined to them
        hot = crossmatch.hot_cells(moved, dr) if n > HOT_ROWS else None
        carry = [f"{c}_own" for c in FITTED], ["use_in_trans", *(f"{c}_ref" for c in FITTED)]
        matches = checkpointed(crossmatch.cross_match(moved, a, dr, dm, carry=carry, hot=hot).where("use_in_trans"))
        pairs = matches if tol is None else fits.outlier_rejection(matches, tol, distance="dr")
        pairs = fits.with_weight(pairs.withColumnsRenamed({f"{c}_own": c for c in FITTED}), self.weights)
        used = fits.fit(pairs, order, mag_trans=self.mag_trans)
        model = used.get((), model)
        self.trans[lst_id] = model
        if self.calc_trans_inverse:
            self.trans_inverse[lst_id] = fits.fit_inverse(pairs, order)[()]
        moved = fits.applied(lst, {(): model})
        # the fit moves a list by about the tolerance: where no cell was hot none becomes so
        found = crossmatch.cross_match(moved, a, dr, dm, hot=True if hot is not None else None).select(F.col("id_1").alias("id"), F.col("id_2").alias("star_id"))
        out = self._take_in(stars, checkpointed(moved.join(found, "id", "left")))
        released(matches)
        return out

    def _reference_at(self, stars: DataFrame, t: float) -> DataFrame:
        s = stars if self.use_vel else stars.withColumns({c: F.lit(None).cast("double") for c in ("vx", "vy", "vxe", "vye")})
        return filters.reference_at(s, t)

    def _take_in(self, stars: DataFrame, readings: DataFrame) -> DataFrame:
        """The stars with a list's readings (star_id NULL where they match none) and the new stars among those."""
        fresh = F.col("star_id").isNull()
        readings_of = readings.withColumn("star_id", F.when(fresh, F.concat(F.lit("n"), F.col("list_id"), F.lit("_"), F.col("id"))).otherwise(F.col("star_id")))
        none = F.lit(None).cast("double")
        new_stars = readings.where(fresh).select(
            F.concat(F.lit("n"), F.col("list_id"), F.lit("_"), F.col("id")).alias("star_id"), crossmatch.new_name(F.col("list_id"), F.col("name")).alias("name"),
            F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("m").alias("m0"), F.col("xe").alias("x0e"), F.col("ye").alias("y0e"),
            F.col("me").alias("m0e"), *(none.alias(c) for c in ("vx", "vy", "vxe", "vye")), F.col("t").alias("t0"),
            F.lit(self.use_ref_new).alias("use_in_trans"), F.lit(False).alias("ref_orig"), none_held().alias("readings")
        )
        # a star keeps its readings with it: only those that this list shows are combined anew
        grown = stars.unionByName(new_stars).join(combine.held(readings_of).withColumnRenamed("readings", "_more"), "star_id", "left")
        grown = grown.withColumn("readings", F.when(F.col("_more").isNull(), F.col("readings")).otherwise(F.concat("readings", "_more")))
        before = None
        if self.update_ref_orig == "periter":
            grown = grown.drop("_more")
        elif self.use_vel:
            before = checkpointed(grown.drop("_more"))
            grown = self.aggregates(before, before.select("star_id", F.inline("readings")))
        else:
            grown = grown.withColumn("_shown", F.when(F.col("_more").isNotNull(), F.col("readings")))
            grown = combine.means_of_held(grown, "_shown", self.weighting is not None, self.update_ref_orig is False).drop("_more", "_shown")
        out = checkpointed(grown)
        released(stars, readings, before)
        return out

    def aggregates(self, stars: DataFrame, obs: DataFrame) -> DataFrame:
        """The stars' places, magnitudes and (if asked for) motions from their readings so far."""
        weighted = self.weighting is not None
        m = combine.combine_lists(obs, "m", "me" if weighted != (self.compat and self.use_vel) else None, ismag=True).drop("n")
        if self.use_vel:
            even = obs if weighted else obs.withColumns({"xe": F.lit(1.0), "ye": F.lit(1.0)})
            v = motion.fit_velocities(even, self.weighting or "var").drop("chi2_vx", "chi2_vy", "n_vfit")
            fresh = v.join(m, "star_id")
        else:
            e = lambda c: f"{c}e" if weighted else None
            fresh = combine.combine_lists(obs, "x", e("x")).drop("n").join(combine.combine_lists(obs, "y", e("y")).drop("n"), "star_id").join(m, "star_id")
        return combine.updated_aggregates(stars, fresh, keep_original=self.update_ref_orig is False)

    def fit(self) -> tuple[DataFrame, DataFrame, dict[int, Transform]]:
        """(stars, readings, transforms)."""
        stars = checkpointed(self._seed())
        for it in range(self.iters):
            begun, stars = stars, stars.withColumn("readings", none_held())
            for lst in self.lists:
                stars = self.one_pass(stars, lst, it)
            released(begun)
            shown = F.size(F.filter("readings", lambda r: finite(r["x"]).isNotNull())) > 0
            if self.reference is not None:
                shown = shown | F.coalesce("ref_orig", F.lit(False))
            before, stars = stars, checkpointed(stars.where(shown).drop("readings"))
            released(before)
            if self.iter_callback:
                self.iter_callback(stars, it)
        obs = self.match_lists(stars, per_iteration(self.dr_tol, self.iters, "dr_tol")[-1], per_iteration(self.dm_tol, self.iters, "dm_tol")[-1])
        stars = self.aggregates(stars, obs)
        stars = checkpointed(filters.drop_undetected(stars, filters.detections(obs)))
        released(*(lst for lst, _, _ in self._written.values()))
        self._written.clear()
        if self.iter_callback:
            self.iter_callback(stars, self.iters)
        return stars, obs, self.trans

    def match_lists(self, stars: DataFrame, dr_tol: float, dm_tol: float | None) -> DataFrame:
        """The final match of all lists at once, each against the stars at its own time, without new stars."""
        every, refs = None, None
        for lst_id in self.lists:
            lst, t, _ = self._read(lst_id)
            moved = fits.applied(lst.withColumns({f"{c}_orig": F.col(c) for c in ("x", "y", "m")}), {(): self.trans[lst_id]})
            every = moved if every is None else every.unionByName(moved)
            if self.use_vel:
                ref = self._reference_at(stars, t).select(F.lit(lst_id).cast("long").alias("list_id"), F.col("star_id").alias("id"), "x", "y", "m")
                refs = ref if refs is None else refs.unionByName(ref)
        if not self.use_vel:  # the stars are in the same place for all lists
            refs = self._reference_at(stars, 0.0).select(F.col("star_id").alias("id"), "x", "y", "m")
        every = checkpointed(every)
        found = crossmatch.cross_match(every, refs, dr_tol, dm_tol, by=["list_id"])
        rows = every.join(found.select("list_id", F.col("id_1").alias("id"), F.col("id_2").alias("star_id")), ["list_id", "id"])
        out = checkpointed(
            rows.select(
                "star_id", "list_id", "x", "y", "m", "xe", "ye", "me", "t", "x_orig", "y_orig", "m_orig", F.col("name").alias("name_in_list"),
                F.col("id").alias("obs_id")
            )
        )
        released(every)
        return out


def bootstrap_errors(
    stars: DataFrame, obs: DataFrame, n_boot: int = 100, order: int = 1, seed: int = 3, epochs_min: int = -1, with_velocities: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Errors from reference stars drawn with replacement.

    (star_id, list_id, xe_boot, ye_boot, me_boot) and, if asked for, the spreads of the motions (star_id, x0e_boot, ...). For
    every draw and list the transform is fitted anew, in one aggregate over all of them, and every reading moved by it. For the motions
    as many lists as there are are drawn with replacement too, the same for all stars in a draw; t0 stays the star's (its mean time where it has none).
    """
    good = obs.join(
        stars.where("use_in_trans").select("star_id", F.col("x0").alias("x_ref"), F.col("y0").alias("y_ref"), F.col("m0").alias("m_ref")), "star_id"
    ).where("x_orig is not null and x_ref is not null")
    ranked = good.withColumn(
        "_k", F.row_number().over(Window.partitionBy("list_id").orderBy("star_id")) - 1
    ).withColumn("_n", F.count("*").over(Window.partitionBy("list_id")))
    b = F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("boot")
    # the k-th draw takes the star at a hashed place
    draws = ranked.select("list_id", "_k", "_n", b).withColumn(
        "_k", F.pmod(F.xxhash64(F.lit(seed), "boot", "list_id", "_k"), F.col("_n")).cast("int")
    ).drop("_n")
    sample = draws.join(
        ranked.select("list_id", "_k", F.col("x_orig").alias("x"), F.col("y_orig").alias("y"), F.col("m_orig").alias("m"), "x_ref", "y_ref", "m_ref"),
        ["list_id", "_k"]
    )
    found = fits.fit(sample, order, by=["boot", "list_id"])
    enough = obs.groupBy("star_id").agg(F.count("x").alias("_d")).join(stars.select("star_id", "use_in_trans"), "star_id").where(
        (F.col("_d") >= epochs_min) | F.col("use_in_trans")
    ).select("star_id")
    each = obs.join(enough, "star_id", "left_semi").select(
        "star_id", "list_id", "t", "xe", "ye", F.col("x_orig").alias("x"), F.col("y_orig").alias("y"), F.col("m_orig").alias("m"), b
    )
    # the draws are dealt out again where they are needed: n_boot copies of the readings are never written
    moved = fits.applied_by_table(each, found, ["boot", "list_id"])
    readings = moved.groupBy("star_id", "list_id").agg(*(F.stddev_samp(c).alias(f"{c}e_boot") for c in "xym"))
    if not with_velocities:
        return readings, stars.select("star_id").where(F.lit(False))
    every = obs.select("list_id").distinct().withColumn("_k", F.row_number().over(Window.orderBy("list_id")) - 1)
    n = every.count()
    drawn = every.select("_k", b).withColumn(
        "_k", F.pmod(F.xxhash64(F.lit(seed), F.lit("epochs"), "boot", "_k"), F.lit(n)).cast("int")
    ).join(every, "_k").drop("_k")
    again = moved.join(F.broadcast(drawn), ["boot", "list_id"]).withColumn("star_id", F.struct("star_id", "boot"))  # n_boot rows a list
    own = motion.fit_velocities(obs.select("star_id", "list_id", "t", "x", "y", "xe", "ye")).select("star_id", F.col("t0").alias("_own"))
    t0 = stars.select("star_id", finite("t0").alias("t0")).join(own, "star_id").select(
        "star_id", F.coalesce("t0", "_own").alias("t0"), b
    ).select(F.struct("star_id", "boot").alias("star_id"), "t0")
    v = motion.fit_velocities(again, fixed_t0=t0)
    spread = v.groupBy(F.col("star_id.star_id").alias("star_id")).agg(
        *(F.stddev_samp(a).alias(e) for a, e in (("x0", "x0e_boot"), ("y0", "y0e_boot"), ("vx", "vxe_boot"), ("vy", "vye_boot")))
    )
    return readings, spread


def pair_alignment(
    ref: DataFrame, lst: DataFrame, steps: list[tuple[int, float]], dm_tol: float | None = None, weights: str | None = None,
    start: Transform | None = None, mode: str = "triangle", n_bright: int = 50, sigma: float | None = None,
    area: tuple[tuple[float, float], tuple[float, float]] | None = None, mag_lim: tuple[float | None, float | None] | None = None
) -> tuple[Transform, DataFrame]:
    """Two catalogs aligned: a first guess (names, triangles or given), then for each (order, tolerance) a match and a fit.

    ref, lst: id, name, x, y, m[, xe, ye]. The last match comes back with the model; ``sigma`` cuts its residuals and fits once more.
    ``area`` (ranges of x and y in the reference) and ``mag_lim`` trim what the fits see; the last match takes all rows.
    """
    side = lambda df: df.withColumns({c: F.lit(1.0) for c in ("xe", "ye") if c not in df.columns})
    ref, lst = side(ref), side(lst)
    whole = ref, lst
    if area is not None:
        ref = filters.restrict_by_area(ref, *area)
    if mag_lim is not None:
        ref, lst = (filters.apply_mag_lim(df, *mag_lim) for df in (ref, lst))

    def joined(m: DataFrame, how: str | None) -> DataFrame:
        r = ref.select(F.col("id").alias("id_2"), *(F.col(c).alias(f"{c}_ref") for c in ("x", "y", "m", "xe", "ye")))
        return fits.with_weight(m.select("id_1", "id_2").join(r, "id_2").join(lst.withColumnRenamed("id", "id_1"), "id_1"), how)

    model = start
    if model is None:
        if mode == "name":
            first = crossmatch.name_join(lst, ref).withColumn("votes", F.lit(1))
        else:
            first = triangles.triangle_match(ref, lst, n_bright).select(F.col("id_2").alias("id_1"), F.col("id_1").alias("id_2"), "votes")
        first = checkpointed(first)
        pairs = checkpointed(joined(first, None).drop("w").join(first.select("id_1", F.col("votes").cast("double").alias("w")), "id_1"))
        if pairs.count() < 3:
            raise ValueError("fewer than three matches for the first transform")
        model = fits.fit(pairs, 1)[()]
    for order, dr in steps:
        pairs = checkpointed(joined(crossmatch.transform_and_match(lst, ref, model, dr, dm_tol), weights))
        model = fits.fit(pairs, order)[()]
    if sigma:
        there = fits.applied(pairs.withColumns({"_x": F.col("x"), "_y": F.col("y")}), {(): model})
        kept = fits.residual_sigma_cut(there, sigma).select("id_1")
        pairs = pairs.join(kept, "id_1", "left_semi")
        model = fits.fit(pairs, steps[-1][0])[()]
    ref, lst = whole
    return model, crossmatch.transform_and_match(lst, ref, model, steps[-1][1], dm_tol)


def two_columns(ref: DataFrame, lst: DataFrame, model: Transform, matches: DataFrame) -> DataFrame:
    """(star_id, name, list_id, x, y, m, further columns of both): the matched rows as a table of two lists, 0 the reference and 1 the other, moved into its frame."""
    both = [c for c in ref.columns if c in lst.columns and c not in ("id", "name")]
    moved = fits.applied(lst, {(): model})
    one = matches.select(F.col("id_2").alias("id"), F.col("id_2").alias("star_id")).join(ref, "id").select(
        "star_id", "name", F.lit(0).cast("long").alias("list_id"), *both
    )
    names = one.select("star_id", "name")
    two = matches.select(F.col("id_1").alias("id"), F.col("id_2").alias("star_id")).join(moved.drop("name"), "id").join(names, "star_id").select(
        "star_id", "name", F.lit(1).cast("long").alias("list_id"), *both
    )
    return one.unionByName(two)


def stitch(lists: dict[int, DataFrame], initial: int, n_iter: int = 5, corr_thresh: float = 0.8, dr_tol: float = 1.0, order: int = 2) -> DataFrame:
    """Frames stitched one after the other onto a growing master: (star_id, name, x, y, m, xe, ye, n_frames).

    Each list keeps its rows above the correlation limit, is aligned in ``n_iter`` rounds, fills matched stars and adds the others.
    """

    def ready(k: int) -> DataFrame:
        df = lists[k].where(F.col("corr") > corr_thresh)
        return df.select(F.col("row_id").cast("long").alias("id"), "name", "x", "y", "m", "xe", "ye")

    first = ready(initial)
    obs = checkpointed(
        first.select(F.concat(F.lit(f"f{initial}_"), "id").alias("star_id"), F.lit(initial).cast("long").alias("list_id"), "name", "x", "y", "m", "xe", "ye")
    )
    for k in lists:
        if k == initial:
            continue
        lst = checkpointed(ready(k))
        master = checkpointed(_stitched(obs))
        ref = master.withColumnRenamed("star_id", "id")
        model, found = pair_alignment(ref, lst, [(min(order, 1), dr_tol * 3)] + [(order, dr_tol)] * n_iter, start=models.polynomial([0.0], [0.0]))
        moved = checkpointed(fits.applied(lst, {(): model}))
        found = checkpointed(found.select(F.col("id_1").alias("id"), F.col("id_2").alias("star_id")))
        new = moved.join(found, "id", "left").withColumn("star_id", F.coalesce("star_id", F.concat(F.lit(f"f{k}_"), "id")))
        obs = checkpointed(obs.unionByName(new.select("star_id", F.lit(k).cast("long").alias("list_id"), "name", "x", "y", "m", "xe", "ye")))
    return _stitched(obs)


def _stitched(obs: DataFrame) -> DataFrame:
    x, y = combine.stitch_mean(obs, "x", "xe"), combine.stitch_mean(obs, "y", "ye")
    rest = obs.groupBy("star_id").agg(F.min_by("name", "list_id").alias("name"), F.avg("m").alias("m"), F.count("*").alias("n_frames"))
    return rest.join(x, "star_id").join(y, "star_id")
