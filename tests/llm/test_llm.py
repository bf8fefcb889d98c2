"""Operators for training data: planted cases, brute force and the defined odd cases."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skyloom.llm import leaks, lookalike, matching, mixing
from skyloom.operators import hot as hot_module

WORDS = "copper lantern bailiff harvest ledger sundial compass widow regatta kettle anchor verdict almanac pilot ferry glazier thicket orchard meadow quarry saddle violin cellar harbour timber candle mirror shutter".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(1, 400)) * (rng.random() < 0.4) for _ in range(n))


# --- look-alike text


def test_same_look(spark):
    texts = [
        (1, "Hello world, a nice day"), (2, "Hеllo wоrld, a nice day"), (3, "Ｈｅｌｌｏ world, a nice day"), (4, "Hello world, a nice day"), (5, "hello world, a nice day"), (6, "Hello​ world, a nice d­ay"),
        (7, "café ﬁne"), (8, "café fine"), (9, "cafe fine"), (10, "31 m²"), (11, "31 m2"), (12, ""), (13, None), (14, "\U0001f468‍\U0001f467 ok"), (15, "\U0001f468\U0001f467 ok"), (16, "ok!"), (17, "ok."),
        (18, "Москва хорошая"), (19, "Mосква xорошая"), (20, "tаble zz"), (21, "tablе zz"), (None, "café ﬁne"), (22, "x" * 300_000 + " é"), (23, "x" * 300_000 + " é"),
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id long, text string, one_form string")
    got = {(r.doc_id_1, r.doc_id_2) for r in lookalike.same_look(df).collect()}
    group = [1, 2, 3, 4, 6]
    want = {(a, b) for a in group for b in group if a < b and dict(texts)[a] != dict(texts)[b]} | {(7, 8), (18, 19), (20, 21), (22, 23)}
    assert got == want
    out = lookalike.one_form(df)
    assert out.columns == ["doc_id", "text", "one_form", "one_form_"] and out.count() == len(texts)
    form = {r.doc_id: r.one_form_ for r in out.collect()}
    assert form[2] == form[3] == form[6] == texts[0][1] and form[13] is None and form[12] == "" and form[19] == "Москва хорошая" and form[11] != form[10]
    assert lookalike.same_look(df.limit(0)).count() == 0


def test_same_look_hot_class(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "hot_keys", lambda d, keys: hot_module.hot_keys(d, keys, rows=10, sample=1.0))
    df = spark.createDataFrame([(i, "same text") for i in range(60)] + [(100, "same text"), (101, "other")], "doc_id long, text string")
    got = [(r.doc_id_1, r.doc_id_2) for r in lookalike.same_look(df).collect()]
    assert sorted(got) == [(i, 100) for i in range(60)]


def test_word_that_no_corpus_has_is_kept(spark):
    df = spark.createDataFrame([(1, "qwаrty")], "doc_id long, text string")
    assert lookalike.one_form(df).first().one_form == "qwаrty"


# --- leaked passages


def brute_leak(item, text):
    a, b = leaks.words(item), leaks.words(text)
    return any(a[i : i + 12] == b[j : j + 12] for i in range(len(a) - 11) for j in range(len(b) - 11))


def test_leaks(spark):
    rng = random.Random(1)
    shared = "Answer using only the facts that are given in the passage above and nothing else at all."
    items = [(i, f"{shared} {sentence(rng, 60)}") for i in range(30)]
    docs, want = [], set()
    for d in range(200):
        body = sentence(rng, 30)
        kind = d % 5
        it = rng.randrange(30)
        w = items[it][1].split()
        at = rng.randrange(20, 50)
        if kind == 0:
            quote, hit = w[at : at + 14], True
        elif kind == 1:
            quote, hit = w[at : at + 7], False
        elif kind == 2:  # altered spelling, case, signs, one word put in
            quote = w[at - 10 : at + 14]
            quote[5] = quote[5][1:] + quote[5][0]
            quote.insert(12, "indeed")
            quote, hit = [x.upper() + "," for x in quote], True
        elif kind == 3:
            quote, hit = shared.split(), False
        else:
            quote, hit = [], False
        docs.append((1000 + d, f"{body} {' '.join(quote)} {body[::-1]}"))
        if hit:
            want.add((it, 1000 + d))
    docs += [(5000, None), (5001, ""), (None, items[3][1]), (5002, sentence(rng, 30_000) + " " + items[4][1])]
    want |= {(4, 5002)}
    ii = spark.createDataFrame([*items, (None, "x y z"), (77, None), (78, "")], "item_id long, text string")
    dd = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    got = {(r.item_id, r.doc_id) for r in leaks.found(ii, dd).collect()}
    assert {(i, d) for i, d in ((i, d) for i, t in items for d, x in docs if d and x and d < 5000 and d % 5 == 0 and brute_leak(t, x))} <= got | set()
    assert got == want
    assert leaks.found(ii.limit(0), dd).count() == 0 and leaks.found(ii, dd.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, sentence(rng, 40)) for i in range(12)]
    docs = [(100 + i, sentence(rng, 20) + " " + items[i][1]) for i in range(12)]
    ii, dd = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK", 700)
    assert {(r.item_id, r.doc_id) for r in leaks.found(ii, dd).collect()} == {(i, 100 + i) for i in range(12)}
    with pytest.raises(ValueError):
        leaks.found(ii, dd, most=10)


# --- mixing


def test_budgets():
    leaves = {("a", "x"): 10.0, ("a", "y"): 90.0, ("b", "x"): 5.0, ("c", "x"): 100.0}
    got = mixing.budgets(leaves, {("a",): 0.5, ("b",): 0.3, ("c",): 0.2}, 100)
    assert abs(sum(got.values()) - 100) < 1e-6 and got[("b", "x")] == 5.0
    a, c = got[("a", "x")] + got[("a", "y")], got[("c", "x")]
    assert abs(a / c - 2.5) < 1e-6  # the shortage of b went to its siblings by weight
    inner = mixing.budgets({("a", "x"): 10.0, ("a", "y"): 90.0}, {("a", "x"): 0.5, ("a", "y"): 0.5}, 60)
    assert inner[("a", "x")] == 10.0 and abs(inner[("a", "y")] - 50) < 1e-6  # siblings first
    assert mixing.budgets({}, {}, 5) == {}


@pytest.mark.skipif(not Path(mixing.TOKENIZER).exists(), reason="no tokenizer")
def test_mix_reaches_shares(spark):
    rng = random.Random(3)
    rows = [
        (i, sentence(rng, 30), rng.choice(["en", "EN", None, "de"]), s) for i,
        s in enumerate(rng.choices([" Alpha", "alpha", "BETA", "gamma ", None, "other"], k=1500))
    ] + [(5000, None, "en", "alpha"), (5001, "", "en", "alpha")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = spark.createDataFrame(
        [("alpha", 0.2, 1), ("beta", 0.3, 3), ("gamma", 0.4, 2), ("absent", 0.1, 4)], "source string, target_share double, max_repeats long"
    )
    mix, report = mixing.mixed(docs, targets)
    r = {x.source: x for x in report.collect()}
    for s, w in (("alpha", 0.2), ("beta", 0.3), ("gamma", 0.4)):
        assert abs(r[s].share - w / 0.9) < 0.01
    assert r["absent"].tokens == 0 and mix.groupBy("source").agg(F.max("copies").alias("c")).where("source = 'alpha' and c > 1 or c > 3").count() == 0
    assert sorted(mix.select("doc_id", "copies").collect()) == sorted(mixing.mixed(docs.repartition(7), targets)[0].select("doc_id", "copies").collect())
    assert mixing.mixed(docs.limit(0), targets)[0].count() == 0


# --- matching


def observed(rng, n=260):
    stars = [
        (
            rng.uniform(0, 500), rng.uniform(0, 500), rng.uniform(12, 19), rng.gauss(0, 0.05), rng.gauss(0, 0.05),
            f"{rng.choice(['wen', 'tel', 'zar', 'kal'])}{rng.choice(['dra', 'mun', ''])}{i + 11}"
        ) for i in range(n)
    ]
    star, ext, truth = [], [], set()
    for lst, (ox, oy, t) in enumerate(((3.0, -1.0, 2012.0), (-2.0, 2.5, 2016.0), (0.5, 1.5, 2021.0))):
        for i, (x, y, m, vx, vy, name) in enumerate(stars):
            if rng.random() < 0.8:
                star.append(
                    (
                        len(star) + 1, lst, name.upper() if rng.random() < 0.5 else f"star_{i * 7 % n}",
                        x + vx * (t - 2015) + ox + rng.gauss(0, 0.05), y + vy * (t - 2015) + oy + rng.gauss(0, 0.05), m + rng.gauss(0, 0.04), 0.05,
                        0.05, t, i
                    )
                )
    for i, (x, y, m, vx, vy, name) in enumerate(stars):
        if rng.random() < 0.8:
            ext.append(
                (
                    10_000 + i, 61, name if rng.random() < 0.6 else f"ext_{i}", x + rng.gauss(0, 0.05), y + rng.gauss(0, 0.05), m - 18, 0.05, 0.05,
                    0.02, 2015.0, i
                )
            )
    truth = {(s[0], e[0]) for s in star for e in ext if s[-1] == e[-1]}
    return star, ext, truth


STAR = "row_id long, list_id long, name string, x double, y double, m double, xe double, ye double, t double, clash long"
EXT = "ext_id long, list_id long, name string, x double, y double, m double, xe double, ye double, me double, t double, clash long"


def test_matching_planted(spark):
    star, ext, truth = observed(random.Random(4))
    copies = [(90_001, *star[0][1:]), (90_002, *star[5][1:])]
    odd = [
        (90_003, 0, "a1", None, 1.0, 1.0, 0.1, 0.1, None, 0), (90_004, None, "a1", 1.0, 1.0, None, None, None, None, 0),
        (None, 0, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0)
    ]
    truth |= {(c[0], e) for c, s in zip(copies, (star[0], star[5])) for r, e in set(truth) if r == s[0]}
    a, b = spark.createDataFrame([*star, *copies, *odd], STAR), spark.createDataFrame(ext, EXT)
    lists = spark.createDataFrame([(0, 2012.0), (1, 2016.0), (2, 2021.0), (61, 2015.0)], "list_id long, list_time double")
    rows = matching.matched(a, b, lists).collect()
    got = {(r.row_id, r.ext_id) for r in rows}
    assert len(rows) == len(got) and all(0.5 <= r.confidence <= 1 for r in rows)
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97
    assert any(x[0] == 90_001 for x in got) == any(x[0] == star[0][0] for x in got)


def test_matching_empty(spark):
    lists = spark.createDataFrame([], "list_id long, list_time double")
    assert matching.matched(spark.createDataFrame([], STAR), spark.createDataFrame([], EXT), lists).count() == 0


def test_matching_keeps_pairs_that_only_a_band_found(spark):
    """Fast stars seen once, whose track ends short of the place where they are."""
    star, ext, _ = observed(random.Random(5))
    fast = set()
    for i in range(8):
        x, y, name = 40.0 + 55 * i, 250.0 + 7 * i, f"zyr{900 + i}"
        ext.append((20_000 + i, 61, name, x, y, -3.0, 0.05, 0.05, 0.02, 2015.0, 0))
        star.append((5_000 + i, 2, name, x + 9.0 + 0.5, y + 3.0 + 1.5, 15.0, None, None, 2021.0, 0))
        fast.add((5_000 + i, 20_000 + i))
    lists = spark.createDataFrame([(0, 2012.0), (1, 2016.0), (2, 2021.0), (61, 2015.0)], "list_id long, list_time double")
    got = {(r.row_id, r.ext_id) for r in matching.matched(spark.createDataFrame(star, STAR), spark.createDataFrame(ext, EXT), lists).collect()}
    assert len(got & fast) >= 7


def test_names_of_any_frequency_are_blocked(spark):
    cols = "id long, u double, v double, stem string, num string, suf string, tag string"
    a = spark.createDataFrame([(i, 100.0 * i, 0.0, "zyr", "7", "", "zyr7") for i in range(510)], cols)
    b = spark.createDataFrame([(9_000, 100.0 * 44, 30.0, "zyr", "7", "", "zyr7")], cols)
    got = {(r.ia, r.ib, r.blind) for r in matching._candidates(a, b, matching.Settings()).collect()}
    assert got == {(i, 9_000, False) for i in range(510)}


def test_nothing_is_matched_without_bands(spark, monkeypatch):
    """Every judged pair comes from the blocking: with no band agreeing there is no result."""
    star, ext, _ = observed(random.Random(6))
    lists = spark.createDataFrame([(0, 2012.0), (1, 2016.0), (2, 2021.0), (61, 2015.0)], "list_id long, list_time double")
    agreeing = matching._agreeing
    monkeypatch.setattr(matching, "_agreeing", lambda *x: agreeing(*x).where(F.lit(False)))
    assert matching.matched(spark.createDataFrame(star, STAR), spark.createDataFrame(ext, EXT), lists).count() == 0


def test_fast_stars_without_names(spark):
    """Stars of two pixels a year are found in lists years away, by their candidates' votes and the places they are predicted at."""
    rng = random.Random(7)
    times = [2011.0, 2012.5, 2014.2, 2014.6, 2015.6, 2016.1, 2018.0, 2022.0]
    stars = [(rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(12, 19), *(rng.gauss(0, 0.05) for _ in "xy")) for _ in range(400)]
    fast = [(rng.uniform(50, 850), rng.uniform(50, 850), rng.uniform(12, 19), *rng.choice([(2.0, 0.5), (-1.5, 1.5), (0.3, -2.2)])) for _ in range(12)]
    star, ext, far = [], [], {}
    for i, (x, y, m, vx, vy) in enumerate(stars + fast):
        name = f"{rng.choice(['wen', 'tel', 'zar', 'kal'])}{rng.choice(['dra', 'mun', ''])}{i + 11}" if i < 400 else None
        ext.append((10_000 + i, 61, name, x, y, m, 0.05, 0.05, 0.02, 2015.0, 0))
        for lst, t in enumerate(times):
            star.append(
                (
                    len(star) + 1, lst, name, x + vx * (t - 2015) + rng.gauss(0, 0.05), y + vy * (t - 2015) + rng.gauss(0, 0.05),
                    m + rng.gauss(0, 0.04), 0.05, 0.05, t, 0
                )
            )
            if i >= 400:
                d = abs(t - 2015) * (vx * vx + vy * vy) ** 0.5
                far.setdefault("near" if d < 4 else "middle" if d < 8 else "far", set()).add((len(star), 10_000 + i))
    lists = spark.createDataFrame([*enumerate(times), (61, 2015.0)], "list_id long, list_time double")
    got = {(r.row_id, r.ext_id) for r in matching.matched(spark.createDataFrame(star, STAR), spark.createDataFrame(ext, EXT), lists).collect()}
    assert {
        n: len(got & part) / len(part) >= 0.9 for n, part in far.items()
    } == dict.fromkeys(("near", "middle", "far"), True), {n: (len(got & part), len(part)) for n, part in far.items()}


# --- further scripts, classes, shortages


def test_more_scripts_than_two(spark):
    plainly = "the noun found on our path has copies"
    texts = [
        (1, plainly), (2, plainly.replace("o", "օ", 1)), (3, plainly.replace("u", "ս", 1)), (4, plainly.replace("a", "α")), (5, plainly.replace("p", "ρ")), (6, plainly.title()), (7, plainly.title().replace("H", "Ꮋ")),
        (8, "σοφός λόγος"), (9, "σoφός λόγoς"), (10, "noun noun"), (11, "abc "), (12, "abc\n"), (13, "a\tb\r\n"), (14, "a b\n"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id_1, r.doc_id_2) for r in lookalike.same_look(df).collect()}
    group = [1, 2, 3, 4, 5]
    assert got == {(a, b) for a in group for b in group if a < b} | {(6, 7), (8, 9), (11, 12), (13, 14)}
    rows = {r.doc_id: (r.class_id, r.members, r.spellings) for r in lookalike.look_classes(df.unionByName(df.where("doc_id = 2"))).collect()}
    assert {rows[i] for i in group} == {(1, 6, 5)} and rows[9] == (8, 2, 2) and rows[10] == (10, 1, 1) and len(rows) == 14
    assert lookalike.look_classes(df.limit(0)).count() == 0


def test_words_are_sought_alike_on_both_plans(spark, monkeypatch):
    texts = [(1, "a fine table here"), (2, "a fine tаble here"), (3, "a zqz tаblе"), (4, "a zqz table")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    few = sorted(lookalike.same_look(df).collect())
    monkeypatch.setattr(lookalike, "FEW_WORDS", 0)
    assert few == sorted(lookalike.same_look(df).collect()) and len(few) == 2


@pytest.mark.skipif(not Path(mixing.TOKENIZER).exists(), reason="no tokenizer")
def test_shortages_go_to_siblings_first(spark):
    rng = random.Random(8)
    rows = []
    for domain, lang, source, n in (
        ("AA-11", "en", "alpha", 40), ("AA-11", "en", "beta", 40), ("AA-11", "de", "alpha", 40), ("BB-22", "en", "alpha", 80),
        ("BB-22", "en", "beta", 80)
    ):
        rows += [(len(rows) + i, sentence(rng, 20), lang, source, f"{domain}9") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, item_sku string")
    targets = spark.createDataFrame([("alpha", 0.3, 1), ("beta", 0.7, 2)], "source string, target_share double, max_repeats long")
    even, report = mixing.mixed(docs, targets)
    r = {x.source: x for x in report.collect()}
    assert abs(r["alpha"].share - 0.3) < 0.01 and abs(r["beta"].share - 0.7) < 0.01
    total = 1.1 * sum(x.tokens for x in r.values())
    mix, report = mixing.mixed(docs, targets, total=total)
    assert mix.where("source = 'alpha' and copies > 1 or copies > 2").count() == 0
    r = {x.source: x for x in report.collect()}
    assert abs(sum(x.tokens for x in r.values()) / total - 1) < 0.02 and r["beta"].share < 0.7 - 0.01  # beta is used up, alpha took its place
    part = {
        (x.domain, x.lang, x.source): x.n for x in mix.groupBy("domain", "lang", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()
    }
    was = {
        (x.domain, x.lang, x.source): x.n for x in even.groupBy("domain", "lang", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()
    }
    # what beta lacks in a domain's language goes to alpha beside it; German, without beta, grows as planned only
    beside = part["BB-22", "en", "alpha"] / was["BB-22", "en", "alpha"]
    assert beside > 1.3 and abs(part["AA-11", "de", "alpha"] / was["AA-11", "de", "alpha"] - 1.1) < 0.05
    assert mixing.mixed(docs, targets.limit(0))[0].count() == 0


def test_many_tracks_are_joined_to_the_same_result(spark, monkeypatch):
    star, ext, _ = observed(random.Random(9), 120)
    lists = spark.createDataFrame([(0, 2012.0), (1, 2016.0), (2, 2021.0), (61, 2015.0)], "list_id long, list_time double")
    a, b = spark.createDataFrame(star, STAR), spark.createDataFrame(ext, EXT)
    few = {(r.row_id, r.ext_id) for r in matching.matched(a, b, lists).collect()}
    monkeypatch.setattr(matching, "FEW_TRACKS", 0)
    assert few == {(r.row_id, r.ext_id) for r in matching.matched(a, b, lists).collect()} and len(few) > 150


def test_matching_leaves_few_tables_on_disk(spark, data):
    from skyloom.common import shared_folder, table
    from skyloom.llm import matching

    import os

    folder = shared_folder(spark).removeprefix("file:")
    kept = lambda: {n for n in os.listdir(folder) if n.startswith("skyloom-")} if os.path.isdir(folder) else set()
    before = kept()
    out = matching.matched(*(table(spark, data, n) for n in ("starlist", "starlist_ext", "lists")))
    assert len(kept() - before) <= 3  # the detections of both sides and the accepted pairs
    assert out.count() > 0
