"""Neighbours, spikes, raw lines and units: brute force, and the defined odd cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions.units import speak
from skyloom.operators import neighbours, spikes, unify
from skyloom.operators import hot as hot_module
from skyloom.sources import raw_lines

NAN, INF = float("nan"), float("inf")


def angle(a, b):
    d = math.sin(math.radians(a[1] - b[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(a[0] - b[0]) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(d))))


def test_planar_pairs_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 2, None]), rng.uniform(-20, 20), rng.uniform(-20, 20), "x") for i in range(400)]
    rows += [
        (1000, 1, None, 1.0, "x"), (1001, 1, NAN, 1.0, "x"), (1002, 1, INF, 1.0, "x"), (None, 1, 1.0, 1.0, "x"), (1003, 2, 5.0, 5.0, "a"),
        (1004, 2, 5.0, 5.0, "b"), (1005, 2, 1e300, 5.0, "b")
    ]
    df = spark.createDataFrame(rows, "id long, g long, x double, y double, key_1 string")
    got = {(r.key_1, r.key_2) for r in neighbours.planar_pairs(df, "id", "x", "y", 1.5, by=["g"]).collect()}
    good = [r for r in rows if r[0] is not None and r[2] is not None and math.isfinite(r[2])]
    want = {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[1] == b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 1.5}
    assert got == want and (1003, 1004) in got
    assert neighbours.planar_pairs(df.limit(0), "id", "x", "y", 1.5, by=["g"]).count() == 0


def test_planar_pairs_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "hot_keys", lambda df, keys: hot_module.hot_keys(df, keys, rows=20, sample=1.0))
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 0.2), rng.gauss(0, 0.2)) for i in range(300)] + [(i + 1000, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = [(r.key_1, r.key_2) for r in neighbours.planar_pairs(df, "id", "x", "y", 0.3).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.09}
    assert len(got) == len(set(got)) and set(got) == want


def test_sphere_pairs_brute_force(spark):
    rng = random.Random(3)
    pts = []
    for i in range(600):
        kind = i % 4
        ra = rng.uniform(0, 360) if kind < 2 else rng.gauss(0, 0.3) % 360
        dec = {0: rng.uniform(89.2, 90), 1: rng.uniform(-90, -89.2), 2: rng.gauss(0, 0.3), 3: rng.gauss(60, 0.3)}[kind]
        pts.append((i, ra, dec))
    rows = pts + [(0, pts[0][1], pts[0][2]), (9000, None, 1.0), (9001, 1.0, NAN), (9002, 5.0, 95.0)]
    df = spark.createDataFrame(rows, "id long, ra double, dec double")
    got = [(r.key_1, r.key_2) for r in neighbours.sphere_pairs(df, "id", "ra", "dec", 0.1).collect()]
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and angle(a[1:], b[1:]) <= 0.1}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_region_members(spark):
    rng = random.Random(4)
    pts = [
        (i, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(1500)
    ] + [(5000, 10.0, 5.0), (5001, 350.0, 0.0), (5002, 0.0, 89.99), (5003, None, 1.0)]
    regions = [
        (1, "box", 350.0, 10.0, -5.0, 5.0, None, None, None), (2, "circle", None, None, None, None, 0.0, 89.5, 2.0),
        (3, "circle", None, None, None, None, 180.0, 0.0, 60.0), (4, "box", 0.0, 360.0, 60.0, 70.0, None, None, None),
        (5, "box", None, 1.0, 1.0, 2.0, None, None, None), (6, "circle", None, None, None, None, 20.0, 20.0, 0.001),
        (7, "spiral", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)
    ]
    rg = spark.createDataFrame(
        regions,
        "region_id long, shape string, ra_min double, ra_max double, dec_min double, dec_max double, ra_center double, dec_center double, radius_deg double"
    )
    df = spark.createDataFrame(pts, "id long, ra double, dec double")
    got = {(r.region_id, r.key) for r in neighbours.region_members(df, "id", "ra", "dec", rg).collect()}
    want = set()
    for p in pts:
        if p[1] is None:
            continue
        for r in regions:
            if r[1] == "box" and r[2] is not None and r[4] <= p[2] <= r[5] and ((r[2] <= p[1] <= r[3]) if r[2] <= r[3] else (p[1] >= r[2] or p[1] <= r[3])):
                want.add((r[0], p[0]))
            if r[1] == "circle" and angle(p[1:], (r[6], r[7])) <= r[8] + 1e-9:
                want.add((r[0], p[0]))
    assert got == want and {(1, 5000), (1, 5001), (2, 5002)} <= got
    assert neighbours.region_members(df, "id", "ra", "dec", rg.limit(0)).count() == 0


OBS = "obs_id long, star_id long, list_id long, x double, y double, m double, xe double, ye double, me double, t double, field string"


def sky_star(star, n, first, rng, t0=2000.0):
    return [
        [
            first + i, star, i, 100 + 0.1 * i + rng.gauss(0, 0.05), 50 - 0.2 * i + rng.gauss(0, 0.05), 15 + rng.gauss(0, 0.02),
            0.05 + rng.uniform(0, 0.01), 0.05, 0.02, t0 + i, "clash"
        ] for i in range(n)
    ]


def test_implausible_readings(spark):
    rng = random.Random(5)
    rows = sky_star(1, 12, 100, rng) + sky_star(2, 12, 200, rng) + sky_star(3, 5, 300, rng)
    rows[4][3] += 5  # a spike in x
    rows[7][5] -= 1.0  # in m
    rows[9][6] = 1.0  # in xe
    for k in (13, 14, 15, 16):
        rows[k][4] = 33.0  # frozen y
    rows[25][3] += 50  # too few readings for a spike
    rows[26][5], rows[27][6], rows[28][3] = INF, -1.0, -5000.0
    copy = list(rows[4])
    copy[0] = 999
    lone = [
        [700, None, 1, 1e9, 1.0, 1.0, 1.0, 1.0, 1.0, 2000.0, "c"], [701, None, 1, None, NAN, 1.0, 1.0, 1.0, 1.0, None, "c"],
        [702, 4, None, 1.0, 1.0, 99.0, 1.0, 1.0, 1.0, None, "c"]
    ]
    df = spark.createDataFrame([tuple(r) for r in [*rows, copy, *lone]], OBS)
    lists = spark.createDataFrame([(i, 2000.0 + i) for i in range(12)], "list_id long, list_time double")
    got = {(r.obs_id, r.field) for r in spikes.implausible(df, lists).collect()}
    assert got == {
        (104, "x"), (999, "x"), (107, "m"), (109, "xe"), *((i, "y") for i in range(201, 205)), (302, "m"), (303, "xe"), (304, "x"), (700, "x"),
        (702, "m")
    }
    assert spikes.implausible(df.limit(0), lists).count() == 0


def test_spike_among_few_usable_readings(spark):
    rng = random.Random(8)
    rows = sky_star(1, 9, 100, rng) + sky_star(2, 9, 200, rng)
    for k in (0, 1, 2, 3):
        rows[k][4] = 33.0  # frozen y
    rows[6][4] += 9  # a spike among the five others
    lists = spark.createDataFrame([(i, 2000.0 + i) for i in range(9)], "list_id long, list_time double")
    got = {(r.obs_id, r.field) for r in spikes.implausible(spark.createDataFrame([tuple(r) for r in rows], OBS), lists).collect()}
    assert got == {*((i, "y") for i in (100, 101, 102, 103)), (106, "y")}


def test_hot_source_is_cut_alike(spark, monkeypatch):
    rng = random.Random(6)
    rows = sky_star(1, 700, 1000, rng)
    for k in (50, 333, 640):
        rows[k][3] += 9
    for k in range(250, 256):
        rows[k][5] = 17.125
    df = spark.createDataFrame([tuple(r) for r in [*rows, [77777, *rows[333][1:]]]], OBS)
    lists = spark.createDataFrame([], "list_id long, list_time double")
    plain = {(r.obs_id, r.field) for r in spikes.implausible(df, lists).collect()}
    monkeypatch.setattr(spikes, "CHUNK", 128)
    monkeypatch.setattr(spikes, "hot_keys", lambda d, keys: hot_module.hot_keys(d, keys, rows=10, sample=1.0))
    cut = {(r.obs_id, r.field) for r in spikes.implausible(df, lists).collect()}
    assert plain == cut and {(1050, "x"), (1333, "x"), (77777, "x"), (1640, "x"), (1250, "m"), (1255, "m")} <= cut


def test_same_list_twice_is_judged_alike_on_both_paths(spark, monkeypatch):
    """A second reading of a list, of another time and place, is no copy of the first; neither is list -1 a missing list."""
    rows = sky_star(1, 700, 5000, random.Random(9))
    t = {r[0]: r[9] for r in rows}
    later = list(rows[333])
    later[0], later[3], later[9] = 9000, later[3] + 9, (t[5333] or 2000.0) + 7
    below = list(rows[100])
    below[0], below[2], below[3] = 9001, -1, below[3] + 9
    again = [9002, *below[1:]]
    unlisted = [[9003, 1, None, *below[3:]]]
    nameless = [None, *rows[20][1:]]
    df = spark.createDataFrame([tuple(r) for r in [*rows, later, below, again, *unlisted, nameless]], OBS)
    lists = spark.createDataFrame([], "list_id long, list_time double")
    plain = {(r.obs_id, r.field) for r in spikes.implausible(df, lists).collect()}
    monkeypatch.setattr(spikes, "CHUNK", 128)
    monkeypatch.setattr(spikes, "hot_keys", lambda d, keys: hot_module.hot_keys(d, keys, rows=10, sample=1.0))
    assert plain == {(r.obs_id, r.field) for r in spikes.implausible(df, lists).collect()}
    assert {(9000, "x"), (9001, "x"), (9002, "x")} <= plain and not any(i in (5333, 5100) for i, _ in plain)


def test_hot_cell_of_points_and_regions(spark, monkeypatch):
    """Four in ten points in one cell of the widest level, where large regions lie too."""
    seen = []

    def hot(df, keys):
        seen.append(hot_module.hot_keys(df, keys, rows=20, sample=1.0))
        return seen[-1]

    monkeypatch.setattr(neighbours, "hot_keys", hot)
    rng = random.Random(12)
    pts = [
        (i, rng.uniform(9.0, 9.4), rng.uniform(5.0, 5.4)) if i % 5 < 2 else (
            i, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))
        ) for i in range(500)
    ]
    df = spark.createDataFrame(pts, "k long, ra double, dec double")
    shapes = [
        (1, "box", 0.0, 360.0, -90.0, 90.0, None, None, None), (2, "box", 300.0, 60.0, -30.0, 40.0, None, None, None),
        (3, "circle", None, None, None, None, 9.2, 5.2, 0.1), (4, "circle", None, None, None, None, 0.0, 89.0, 30.0)
    ]
    regions = spark.createDataFrame(
        shapes,
        "region_id long, shape string, ra_min double, ra_max double, dec_min double, dec_max double, ra_center double, dec_center double, radius_deg double"
    )
    got = sorted((r.region_id, r.key) for r in neighbours.region_members(df, "k", "ra", "dec", regions).collect())
    want = [(1, k) for k, _, _ in pts] + [(2, k) for k, ra, dec in pts if (ra >= 300 or ra <= 60) and -30 <= dec <= 40]
    want += [(3, k) for k, ra, dec in pts if angle((ra, dec), (9.2, 5.2)) <= 0.1] + [(4, k) for k, ra, dec in pts if angle((ra, dec), (0.0, 89.0)) <= 30]
    assert got == sorted(want) and seen[0] is not None and max(r["_salts"] for r in seen[0].collect()) > 1


def test_raw_lines(spark):
    ok = "a 1 2 3 4 5 6 7 0.5 2 9"
    lines = [
        (1, "blank", ok, None), (2, "blank", "   \t\r", None), (3, "blank", None, None), (4, "comma", '# "x', None), (
            5, "blank", '"a b" 1 2 3 4 nan NaN 7 .5 +2 9e3 \r', None
        ),
        (6, "blank", '"a 1 2 3 4 5 6 7 0.5 2 9', "quotes"), (7, "blank", 'a"b 1 2 3 4 5 6 7 0.5 2 9', "quotes"), (
            8, "blank", '"a"b 1 2 3 4 5 6 7 0.5 2 9', "quotes"
        ), (9, "comma", ok.replace(" ", " , "), None),
        (
            10, "comma", '"a,""b""",1,2,3,4,5,6,7,1,2,9', None
        ), (11, "comma", "a,,1,2,3,4,5,6,7,1,2,9", "columns"), (12, "blank", "a 1", "columns"), (13, "comma", '" ",1,2,3,4,5,6,7,9,2,9', "name"), (14, "blank", "�k 1 2 3 4 5 6 7 0.5 2 9", "name"),
        (15, "blank", "a 1 2 3 4 5 6 7 nan 2 9", "corr"), (16, "blank", "a 1 2 3 4 5 6 7 1.01 2 9", "corr"), (
            17, "blank", "a 1 2 3 4 5 6 7 1 2.0 9", "n_frames"
        ), (18, "blank", "a 1 2 3 4 5 6 7 1 0 9", "n_frames"),
        (19, "blank", "a 1 2 3 4 5 6 7 1 2 0", "flux"), (20, "blank", "a 1 2 3 4 5 6 7 1 2 1e999", "flux"), (21, "comma", '"",1,2,3,4,5,6,7,1,2,9', "name"), (22, "blank", "a 1 2 3 4 5 6 7 1 ８ 9", "n_frames"), (
            23, "blank", '"' + 'x""' * 20000 + '" 1 2 3 4 5 6 7 1 2 9', None
        ),
    ]
    df = spark.createDataFrame(
        [(i, 7, lay, ln, "clash") for i, lay, ln, _ in lines] + [(None, 7, "blank", "broken", "c")],
        "line_id long, list_id long, layout string, raw_line string, reason string"
    )
    got = {r.line_id: r.reason for r in raw_lines.failures(df).collect()}
    assert got == {i: w for i, _, _, w in lines if w}
    valid = {r.line_id: r for r in raw_lines.load(df).collect()}
    assert set(valid) == {1, 5, 9, 10, 23} and valid[10].name == 'a,"b"' and valid[5].n_frames == 2 and valid[5].flux == 9000 and valid[1].list_id == 7
    assert raw_lines.failures(df.limit(0)).count() == 0 and raw_lines.load(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,unit",
    [
        ("pm given as mas yr-1", ("mas/yr", None)), ("errors in as", (None, "arcsec")), ('sigma is " here', (None, "arcsec")), ("as/100yr // µas", ("arcsec/cy", "uas")), (
            "errors quoted in pixels and motions quoted in px/yr", ("pix/yr", "pix")
        ),
        ("NB units! °/yr for motion and 0.001 arcsec for errors", ("deg/yr", "mas")), ("see night log", (None, None)), ("", (None, None)), (None, (None, None)), (
            "Centennial proper motion, arcsec; mean error of right ascension, arcsec.", ("arcsec/cy", "arcsec")
        ),
        ("Values in 10^-3 arcsec; motions per annum", ("mas/yr", "mas")), (
            "Motions are in arcseconds per hundred years, while uncertainties are given in detector pixels", ("arcsec/cy", "pix")
        ), ("all columns in decimal degrees", ("deg/yr", "deg")),
        ("errors below 0.3 arcsec, motions mas yr⁻¹", ("mas/yr", "arcsec")), ("1/1000 arcsec for errors", (None, "mas")), ("pm in 1e-6 arcsec/yr", ("uas/yr", None)), ("milli-arc-seconds a year", ("mas/yr", None)), (
            "motion: arcsec a century; sigma: a thousandth of that", ("arcsec/cy", "mas")
        ),
        ("millionths of an arcsecond each year", ("uas/yr", None)), ("0.5 arcsec errors", (None, "arcsec")), ("all entries in pixels", ("pix/yr", "pix")),
        (
            "Velocities are detector pixels each year, and position errors are pixels too.", ("pix/yr", "pix")
        ), ("x" * 100_000, (None, None)), ("mas/yr " * 20_000, ("mas/yr", None)),
    ],
)
def test_units_in_text(text, unit):
    assert speak(text) == unit


def test_units_of_rows(spark):
    cats = spark.createDataFrame(
        [("a", None, "motions in mas/yr, errors in mas"), ("b", 10.0, "motions in pixels per year; errors in pixels"), ("c", None, None)],
        "catalog string, mas_per_pix double, note string"
    )
    rng = np.random.default_rng(1)
    rows = [(i, "a", float(v), float(v) / 10, None, 1) for i, v in enumerate(rng.uniform(1, 9, 60))] + [
        (100 + i, "c", float(v) / 1000, float(v) / 1e4, None, 1) for i, v in enumerate(rng.uniform(1, 9, 60))
    ]
    rows += [
        (500, "b", 0.5, 0.05, None, 1), (501, "b", 500.0, 0.05, "pm given as uas/yr", 1), (502, None, 1.0, 1.0, None, 1),
        (503, "a", None, NAN, None, 1), (500, "b", 0.5, 0.05, None, 1)
    ]
    df = spark.createDataFrame(rows, "id long, catalog string, pm double, err double, remark string, unit int")
    out = unify.with_units(df, cats, [unify.Field("pm", "motion"), unify.Field("err", "error")], [("remark", "")])
    got = {r.id: r for r in out.collect()}
    assert out.count() == len(rows) and set(df.columns) <= set(out.columns)
    assert (got[500].pm_unit, got[500].pm_mas, got[501].pm_unit, got[501].pm_mas, got[501].err_unit) == ("pix/yr", 5.0, "uas/yr", 0.5, "pix")
    assert {got[100 + i].pm_unit for i in range(60)} == {"arcsec/yr"} and {got[100 + i].err_unit for i in range(60)} == {"arcsec"}
    assert (got[502].pm_unit, got[503].pm_unit, got[503].err_unit) == (None, None, None)
    assert unify.with_units(df.limit(0), cats, [unify.Field("pm", "motion")], [("remark", "")]).count() == 0


def test_hot_keys_find_only_heavy_ones(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 500, 1).otherwise(F.col("id")).alias("k"))
    assert [r.k for r in hot_module.hot_keys(df, ["k"], rows=10, sample=1.0).collect()] == [1]
    assert hot_module.hot_keys(df, ["k"]) is None and hot_module.hot_keys(df.limit(0), ["k"]) is None
