"""The table builder, catalog files by class, moved catalogs, settings and motions of the mosaic, intermediate tables."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from skyloom import common
from skyloom.functions import models
from skyloom.operators import combine, crossmatch, fits, motion, quality, sky, tables
from skyloom.plans.mosaic import Mosaic, pair_alignment, two_columns
from skyloom.sources import catalogs

ROW = "star_id long, x double, y double, m double"


def small(spark):
    stars = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "star_id long, name string")
    one = spark.createDataFrame([(1, 1.0, 2.0, 10.0), (2, 3.0, 4.0, 11.0)], ROW)
    two = spark.createDataFrame([(2, 3.1, 4.1, 11.1), (3, 5.0, 6.0, 12.0)], ROW).withColumn("snr", F.lit(9.0))
    return stars, one, two


def test_star_table(spark):
    stars, one, two = small(spark)
    t = tables.create(stars, [one, two], ref_list=1, times=[2000.0, 2001.0], names=["p", "q"])
    full = {(r.star_id, r.list_id): r for r in tables.full(t).collect()}
    assert len(full) == 6 and full[1, 1].x is None and full[2, 1].snr == 9.0 and full[2, 0].snr is None and full[3, 1].list_time == 2001.0 and t.ref_list == 1
    t = tables.add_list(t, None, 2, 2002.0)
    assert tables.full(t).where("list_id = 2 and x is null").count() == 3
    value = lambda *v: spark.createDataFrame(list(v), "star_id long, value double")
    t = tables.add_values(t, 3, x=value((1, 7.0)), y=value((1, 8.0)), m=value((1, 9.0), (2, 1.0)))
    got = {r.star_id: (r.x, r.y, r.m) for r in tables.full(t).where("list_id = 3").collect()}
    assert got == {1: (7.0, 8.0, 9.0), 2: (None, None, 1.0), 3: (None, None, None)}
    bad = tables.invalidated(t, [3], spark.createDataFrame([(1,)], "star_id long"))
    assert {(r.star_id, r.list_id) for r in tables.full(bad).where("m is not null").collect()} == {(1, 0), (2, 0), (2, 1), (3, 1), (2, 3)}
    assert tables.full(tables.invalidated(t, [0, 1], columns=["x"])).where("x is not null").count() == 1 and tables.invalidated(t) is t
    empty = tables.create(stars.limit(0), [one.limit(0)])
    assert tables.full(empty).count() == 0


def test_star_table_refuses(spark):
    stars, one, two = small(spark)
    t = tables.create(stars, [one])
    for wrong in (
        lambda: tables.create(stars, []),
        lambda: tables.create(stars, [one], ref_list=1),
        lambda: tables.create(stars.drop("name"), [one]),
        lambda: tables.create(stars, [one], times=[1.0, 2.0]),
        lambda: tables.create(stars, [one.drop("m")]),
        lambda: tables.add_list(t, one.withColumn("xe", F.lit(1.0)), 1),
        lambda: tables.add_list(t, one, 0),
        lambda: tables.add_list(t, one.unionByName(one), 1),
        lambda: tables.add_list(t, spark.createDataFrame([(9, 1.0, 1.0, 1.0)], ROW), 1),
    ):
        with pytest.raises(ValueError):
            wrong()


def test_transform_files_by_class():
    about = dict(starlist="a", reference="b", n_trans=5, delta_mag=-0.25)
    turn = models.similarity(1.5, -2.5, 0.999, 0.01)
    back = catalogs.parse_transform(catalogs.transform_text(turn, **about))
    assert back.kind == "four_paramNW" and back.mag_offset == -0.25
    for x, y in ((0.0, 0.0), (100.0, 7.0)):
        assert all(abs(p - q) < 1e-4 for p, q in zip(back.position(x, y), turn.position(x, y)))
    poly = models.polynomial([1.0, 2.0, 3.0, 4e-3, 5e-3, 6e-3], [-1.0, 0.5, 0.25, 1e-3, 2e-3, 3e-3])
    text = catalogs.transform_text(poly, **about)
    assert catalogs.parse_transform(text).order == 2
    with pytest.raises(ValueError):
        catalogs.parse_transform(text.replace("## Order: 2", "## Order: 1"))
    with pytest.raises(ValueError):
        catalogs.parse_transform(text.replace("PolyTransform", "Spline"))


def test_labels_with_acceleration(spark, tmp_path):
    path = str(tmp_path / "label.dat")
    columns = [c for c in catalogs.LABEL_ACCEL]
    values = {
        "name": "s1", "use": "8", "m": 10.0, "x0": 1.0, "y0": 2.0, "x0e": 0.3, "y0e": 0.4, "vx": 100.0, "vy": -200.0, "vxe": 10.0, "vye": 20.0,
        "ax": 2.0, "ay": 4.0, "axe": 0.2, "aye": 0.1, "t0": 2000.0
    }
    with open(path, "w") as f:
        f.write("# " + " ".join(columns) + "\n" + " ".join(str(values.get(c, 0.0)) for c in columns) + "\n")
    r = catalogs.read_label_accel(spark, path, time=2010.0, flip_x=False).first()
    assert abs(r.x - (1.0 + 0.1 * 10 + 0.5 * 2.0 * 100)) < 1e-9 and abs(r.y - (2.0 - 0.2 * 10 + 0.5 * 4.0 * 100)) < 1e-9
    assert abs(r.xe - math.sqrt(0.3**2 + (10 * 0.01) ** 2 + (0.5 * 100 * 0.2) ** 2)) < 1e-9
    assert catalogs.read_label_accel(spark, path).first().x0 == -1.0


def test_catalog_moves_as_a_whole(spark):
    model = models.similarity(10.0, 20.0, math.cos(0.3), math.sin(0.3), 0.5)
    df = spark.createDataFrame(
        [(1, 5.0, 6.0, 4.0, 3.0, 15.0, 0.1, 0.2, 0.3, 0.4, 1.0, 2.0, 0.01, 0.02)],
        "id long, x double, y double, x0 double, y0 double, m double, xe double, ye double, x0e double, y0e double, vx double, vy double, vxe double, vye double"
    )
    r = fits.applied(df, {(): model}).first()
    assert all(abs(p - q) < 1e-12 for p, q in zip((r.x, r.y, r.x0, r.y0), (*model.position(5.0, 6.0), *model.position(4.0, 3.0)))) and r.m == 15.5
    assert all(abs(p - q) < 1e-12 for p, q in zip((r.x0e, r.y0e), model.position_error(4.0, 3.0, 0.3, 0.4)))
    assert abs(math.hypot(r.vx, r.vy) - math.hypot(1, 2)) < 1e-12
    assert abs(quality.rotation_of(models.polynomial([0.0, math.cos(0.3), -math.sin(0.3)], [0.0, math.sin(0.3), math.cos(0.3)])) - math.degrees(0.3)) < 1e-9


def test_complete_stars(spark):
    rng = random.Random(1)
    rows = [(s, k, 2000.0 + k, s + 0.1 * k + rng.gauss(0, 0.01), 2.0 * s, 0.01, 0.01) for s in range(6) for k in range(5) if not (s == 3 and k == 2)]
    rows += [(9, 0, 2000.0, None, 1.0, 0.01, 0.01)]
    df = spark.createDataFrame(rows, "star_id long, list_id long, t double, x double, y double, xe double, ye double")
    r = {x.star_id: x for x in motion.fit_complete(df, [0, 2, 4]).collect()}
    assert {s for s, x in r.items() if x.n_vfit == 3} == {0, 1, 2, 4, 5} and r[3].vx is None and r[9].n_vfit == 0 and abs(r[1].vx - 0.1) < 0.02


def test_targets_take_the_nearest(spark):
    rng = random.Random(2)
    pts = [(f"s{i:03d}", rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(300)]
    targets = [("t1", 0.1, 0.2), ("t2", -3.0, 3.0), ("far", 50.0, 50.0), (None, 1.0, 1.0), ("lost", None, 1.0)]
    plane = spark.createDataFrame(pts, "name string, x0 double, y0 double")
    got = {(r.x0, r.y0): r.name for r in sky.name_targets(plane, spark.createDataFrame(targets, "name string, x double, y double"), 1.0).collect()}
    for name, x, y in targets[:2]:
        near = min(pts, key=lambda p: math.hypot(p[1] - x, p[2] - y))
        assert got[near[1], near[2]] == name
    assert sum(n in ("t1", "t2", "far") for n in got.values()) == 2 and len(got) == 300


def test_intermediate_tables_are_removed(spark):
    df = common.checkpointed(spark.range(5).withColumn("a b", F.array("id")))
    path = df._kept_at.removeprefix("file://")
    assert os.path.isdir(path) and path.startswith(common.shared_folder(spark).removeprefix("file://")) and df.count() == 5
    common.released(df, None)
    assert not os.path.exists(path)
    assert common.checkpointed(spark.range(2).withColumn("n", F.lit(None))).count() == 2  # what Parquet can't hold


LIST = "row_id long, name string, x double, y double, m double, xe double, ye double, me double, t double"


def moving_lists(spark, n=60, seed=5):
    rng = random.Random(seed)
    stars = [(rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(12, 18), rng.gauss(0, 0.4), rng.gauss(0, 0.4)) for _ in range(n)]
    out, shift = {}, {0: (0.0, 0.0), 1: (1.0, -0.5), 2: (-0.7, 0.8), 3: (0.4, 0.6)}
    for k, (dx, dy) in shift.items():
        t = 2010.0 + 2 * k
        rows = [
            (
                i, f"n{i}", x + vx * (t - 2010) - dx + rng.gauss(0, 0.01), y + vy * (t - 2010) - dy + rng.gauss(0, 0.01), m + rng.gauss(0, 0.01),
                0.01, 0.01, 0.01, t
            ) for i,
            (x, y, m, vx, vy) in enumerate(stars)
        ]
        out[k] = spark.createDataFrame(rows, LIST)
    return stars, out, shift


def test_mosaic_with_motions(spark):
    stars, lists, shift = moving_lists(spark)
    same = models.polynomial([0.0, 1.0, 0.0], [0.0, 0.0, 1.0])
    job = Mosaic(lists, ref_index=0, iters=2, dr_tol=[4.0, 2.0], dm_tol=0.3, trans_input=[same] * 4, use_vel=True, mag_lim=(None, 17.9), weights="both,var")
    table, readings, found = job.fit()
    assert readings.groupBy("star_id").count().where("count = 4").count() >= 55
    rows = {r.name: r for r in table.where("name like 'n%'").collect()}
    off = [abs(rows[f"n{i}"].vx - stars[i][3]) for i in range(60) if f"n{i}" in rows and rows[f"n{i}"].vx is not None]
    assert sorted(off)[len(off) // 2] < 0.1 and len(off) > 55
    assert all(abs(found[k].position(200.0, 200.0)[0] - 200.0 - shift[k][0]) < 0.35 for k in shift)


def test_settings_are_normalised_and_logged(spark, tmp_path):
    _, lists, _ = moving_lists(spark, 5)
    job = Mosaic(lists, iters=2, dr_tol=1.0, mag_lim=(10, 18), trans_input=[models.shift(0.0, 0.0)] * 4)
    assert job.dr_tol == [1.0, 1.0] and job.mag_lim == {k: (10, 18) for k in range(4)} and set(job.trans_input) == {0, 1, 2, 3}
    path = str(tmp_path / "run.json")
    job.write_settings(path)
    with open(path) as f:
        told = json.load(f)
    assert told["dr_tol"] == [1.0, 1.0] and told["lists"] == [0, 1, 2, 3] and "reference" not in told
    for wrong in (dict(dr_tol=[1.0]), dict(trans_input=[1]), dict(weighting="odd"), dict(init_guess_mode="odd")):
        with pytest.raises(ValueError):
            Mosaic(lists, iters=2, **wrong)
    with pytest.raises(ValueError):
        Mosaic({})


def test_weighting_of_means(spark):
    obs = spark.createDataFrame(
        [("s", 0, 2000.0, 1.0, 1.0, 10.0, 1.0, 1.0, 0.1), ("s", 1, 2001.0, 3.0, 3.0, 11.0, 2.0, 2.0, 0.3)],
        "star_id string, list_id long, t double, x double, y double, m double, xe double, ye double, me double"
    )
    stars = spark.createDataFrame(
        [("s", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False)],
        "star_id string, x0 double, y0 double, m0 double, x0e double, y0e double, m0e double, ref_orig boolean"
    )
    _, lists, _ = moving_lists(spark, 3)
    at = lambda **how: Mosaic(lists, **how).aggregates(stars, obs).first()
    plain = -2.5 * math.log10((10**-4 + 10**-4.4) / 2)
    assert abs(at().x0 - 1.4) < 1e-9 and abs(at(weighting=None).x0 - 2.0) < 1e-9 and abs(at(weighting=None).m0 - plain) < 1e-9
    assert abs(at(use_vel=True).m0 - at().m0) < 1e-9 and abs(at(use_vel=True, compat=True).m0 - plain) < 1e-9


def test_two_catalogs_with_trims(spark):
    _, lists, shift = moving_lists(spark)
    ref, lst = (lists[k].withColumnRenamed("row_id", "id").withColumn("snr", F.lit(float(k))) for k in (0, 1))
    same = models.polynomial([0.0, 1.0, 0.0], [0.0, 0.0, 1.0])
    model, found = pair_alignment(ref, lst, [(1, 4.0), (1, 2.0)], 0.3, start=same, area=((20.0, 380.0), (20.0, 380.0)), mag_lim=(None, 17.5), sigma=3.0)
    both = two_columns(ref, lst, model, found)
    assert found.count() > 45 and both.count() == 2 * found.count() and set(both.columns) == {
        "star_id", "name", "list_id", "x", "y", "m", "xe", "ye", "me", "t", "snr"
    }
    assert both.where("list_id = 1 and snr = 1").count() == found.count() and found.where("id_1 <> id_2").count() == 0


def test_exact_median(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.gauss(0, 1), 0.5, None]), 1) for g, n in ((1, 5001), (2, 4000), (3, 1), (4, 2)) for _ in range(n)] + [(5, None, 1), (6, 7.0, 1), (6, 7.0, 1)]
    df = spark.createDataFrame(rows, "g long, v double, median int")
    want = {}
    for g in {r[0] for r in rows}:
        v = sorted(r[1] for r in rows if r[0] == g and r[1] is not None)
        if v:
            want[g] = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    got = {r.g: r.median for r in common.exact_median(df, ["g"], F.col("v")).collect()}
    assert got == want
    every = sorted(r[1] for r in rows if r[1] is not None)
    assert common.exact_median(df, [], F.col("v")).first()["median"] == (every[(len(every) - 1) // 2] + every[len(every) // 2]) / 2
    assert common.exact_median(df.limit(0), ["g"], F.col("v")).count() == 0 and common.exact_median(df.limit(0), [], F.col("v")).first()["median"] is None


def test_means_of_held_readings(spark):
    rng = random.Random(11)
    some = lambda v: rng.choice([v, v, v, v, None, float("nan")])
    rows = [
        (f"s{i}", k, 2000.0 + k, some(rng.gauss(5, 0.1)), some(0.1 + 0.1 * rng.random()), rng.gauss(7, 0.1) + (50 if k == 9 else 0), some(0.2), some(rng.gauss(15, 0.2)), some(0.05))
        for i in range(40) for k in range(i % 12)
    ]
    obs = spark.createDataFrame(rows, "star_id string, list_id long, t double, x double, xe double, y double, ye double, m double, me double")
    stars = spark.createDataFrame(
        [(f"s{i}", *[float(i)] * 6, i % 5 == 0) for i in range(40)],
        "star_id string, x0 double, y0 double, m0 double, x0e double, y0e double, m0e double, ref_orig boolean"
    )
    told = lambda df: {r.star_id: [*r][1:7] for r in df.collect()}
    for weighted, keep in ((True, False), (False, True)):
        job = Mosaic({0: obs}, weighting="var" if weighted else None, update_ref_orig=not keep)
        want = told(job.aggregates(stars, obs))
        got = told(combine.means_of_held(stars.join(combine.held(obs), "star_id", "left"), "readings", weighted, keep))
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for s in want for a, b in zip(want[s], got[s]))
        assert got["s0"] == [0.0] * 6 and got["s11"][0] != 11.0


def test_cross_match_of_stars_common_to_all_groups(spark):
    a = spark.createDataFrame([(k, i, 10.0 * i + 0.1 * k, 3.0, 15.0) for k in range(3) for i in range(20)], "list_id long, id long, x double, y double, m double")
    b = spark.createDataFrame([(100 + i, 10.0 * i, 3.0, 15.0, f"n{i}") for i in range(15)], "id long, x double, y double, m double, name string")
    each = b.crossJoin(spark.range(3).select(F.col("id").alias("list_id")))
    rows = lambda df: sorted(tuple(r) for r in df.select("list_id", "id_1", "id_2").collect())
    common = crossmatch.cross_match(a, b, 1.0, by=["list_id"], carry=([], ["name"]))
    assert rows(common) == rows(crossmatch.cross_match(a, each, 1.0, by=["list_id"])) and len(rows(common)) == 45
    assert common.where("name = concat('n', id_1)").count() == 45
