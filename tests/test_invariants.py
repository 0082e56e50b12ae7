"""What must hold of the results, whatever the data."""

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from growthlens.functions import binning, curves, geo, scalars
from growthlens.operators import estimates, fitting, hierarchical, history, rollup, sampling, spatial, temporal

DAY = date(2020, 1, 1)


def _versions(seed):
    rng = random.Random(seed)
    rows = []
    for way in range(30):
        day = DAY + timedelta(rng.randrange(40))
        for version in range(1, rng.randrange(2, 6)):
            for part in range(rng.randrange(1, 3)):
                rows.append((way, version, day, rng.random() < 0.8, rng.random() < 0.5, rng.randrange(1000), part, rng.choice([None, 1, 2]), rng.choice([None, 5, 6])))
            day += timedelta(rng.randrange(0, 9))
    return rows


SCHEMA = "way_id long, version long, valid_from date, visible boolean, road boolean, length long, part int, id0 long, id1 long"


@pytest.mark.parametrize("seed", range(3))
def test_intervals_and_series(spark, seed):
    rows = _versions(seed)
    iv = temporal.with_valid_to(spark.createDataFrame(rows, SCHEMA), "way_id", "version", "valid_from")
    for key, g in iv.toPandas().groupby(["way_id", "version"]):
        assert g["valid_from"].nunique() == 1 and g["valid_to"].nunique() == 1, key  # rows of a version share both
    for level in (-1, 0, 1):
        gaps = history.last_day_gaps(iv, level).collect()
        assert gaps and all(r["freq_gap"] == 0 and r["length_gap"] == 0 for r in gaps)
        series = history.collapse(iv, level)
        assert series.where("freq < 0 or length < 0").count() == 0
        keys = [c for c in series.columns if c not in ("dt", "freq", "length")]
        for _, g in series.toPandas().groupby(keys):
            assert (pd.to_datetime(g["dt"].sort_values()).diff().dropna() == pd.Timedelta(days=1)).all()  # no gaps
        # Against counting day by day.
        kept = history.level_rows(iv, level).toPandas()
        for r in series.sample(0.05, 3).collect():
            now = kept
            for k in keys:
                now = now[now[k] == r[k]]
            now = now[(now["valid_from"] <= r["dt"]) & (now["valid_to"] > r["dt"])]
            assert (len(now), now["length"].sum()) == (r["freq"], r["length"])


def test_series_of_nothing(spark):
    none = temporal.with_valid_to(spark.createDataFrame([], SCHEMA), "way_id", "version", "valid_from")
    assert history.collapse(none, 0).count() == 0


def test_edge_labels_match_cut(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=300), rng.integers(0, 4, 300), np.zeros(20), np.array([1.0])):
        values = values.astype(float).round(3)
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        edges = df.agg(binning.quantile_edges("v").alias("q"))
        got = sorted((r["v"], r["d"]) for r in df.crossJoin(edges).select("v", binning.edge_label(F.col("v"), F.col("q")).alias("d")).collect())
        q = np.percentile(values, np.arange(0, 101, 10))
        seen, keep = set(), []
        for i, e in enumerate(q):
            if e not in seen:
                seen.add(e)
                keep.append((i, e))
        inner = [(i, e) for i, e in keep if 0 < i < 10]
        for v, d in got:
            assert d == max([0, *(i for i, e in inner if e < v)])


def test_strict_lookup_fails(spark):
    left, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert rollup.strict_lookup(left.where("k = 1"), table, "k", "v").count() == 1
    with pytest.raises(Exception, match="no such key: 2"):
        rollup.strict_lookup(left, table, "k", "v").collect()


def test_numbers_over_ranges(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 as k", "id % 3 as g").repartition(6)
    got = rollup.numbered(df, [F.col("g").desc(), F.col("k")], "nth").orderBy("nth").collect()
    assert [r["nth"] for r in got] == list(range(1, 5001))
    assert [(r["g"], r["k"]) for r in got] == sorted(((r["g"], r["k"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert rollup.numbered(df.limit(0), [F.col("k").asc()], "nth").count() == 0
    assert {(r["k"], r["d"]) for r in rollup.dense_key(spark.createDataFrame([(5,), (9,), (5,)], "k int"), "k", "d").collect()} == {(5, 1), (9, 2)}


def test_region_totals_do_not_double(spark):
    rows = [("A", 1, 10), ("A", 2, 5), ("B", 1, 7), ("ALL", 1, 17), ("ALL", 2, 5)]
    out = rollup.by_region(spark.createDataFrame(rows, "u string, c int, v long"), spark.createDataFrame([("A", "x"), ("B", "x"), ("A", "y")], "u string, r string"), "u", "r", [], "c", "v")
    got = {(r["r"], r["c"]): r["v"] for r in out.collect()}
    assert got == {("x", 1): 17, ("x", 2): 5, ("x", 99): 22, ("y", 1): 10, ("y", 2): 5, ("y", 99): 15, ("WLD", 1): 17, ("WLD", 2): 5, ("WLD", 99): 22}


@pytest.mark.parametrize("block", [512, 16])
def test_bootstrap(spark, block):
    """Against drawing rows one by one, with chances of 1 / weight within each stratum."""
    rng = random.Random(1)
    # What is heavy, and so seldom drawn, differs from what is light.
    rows = [("g", rng.choice("ab"), float(rng.randrange(9)) if i % 4 else 9.0, float(rng.randrange(9)) if i % 4 else 1.0, 1.0 + rng.random() + 6.0 * (i % 4 == 0), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, s string, p double, m double, w double, i int")
    one = estimates.bootstrap_share(df, "g", "s", "p", "m", "w", ["i"], 3000, block=block).first()
    rep = np.random.default_rng(0)
    arr = [(np.array([(r[2] * r[4], (r[2] + r[3]) * r[4]) for r in rows if r[1] == s]), np.array([1 / r[4] for r in rows if r[1] == s])) for s in "ab"]
    plain = []
    for _ in range(3000):
        t = sum(a[rep.choice(len(a), len(a), p=p / p.sum())].sum(0) for a, p in arr)
        plain.append(t[0] / t[1])
    error = np.std(plain) / np.sqrt(3000)
    assert abs(one["mean"] - np.mean(plain)) < 6 * error and one["std"] == pytest.approx(np.std(plain), rel=0.06)
    assert one["p5"] == pytest.approx(np.percentile(plain, 5), abs=8 * error) and one["p95"] == pytest.approx(np.percentile(plain, 95), abs=8 * error)
    even = np.mean([t[0] / t[1] for t in (sum(a[rep.integers(0, len(a), len(a))].sum(0) for a, _ in arr) for _ in range(500))])
    assert abs(even - np.mean(plain)) > 30 * error  # drawing without the weights is another thing
    assert one == estimates.bootstrap_share(df.repartition(7), "g", "s", "p", "m", "w", ["i"], 3000, block=block).first()


def test_bootstrap_draws_as_many_rows(spark):
    """Every replicate draws exactly as many rows as there are, over all blocks."""
    rows = [("g", "s", 1.0, float(i == 0) * 1e6, 1.0, i) for i in range(300)]
    # The first row alone has anything missing: x = n / (n + 1e6 k) where it is drawn k times of n.
    df = spark.createDataFrame(rows, "g string, s string, p double, m double, w double, i int")
    one = estimates.bootstrap_share(df, "g", "s", "p", "m", "w", ["i"], 500, block=8).first()
    assert one["p95"] == 1.0  # not drawn at all in a third of the replicates, and then nothing is missing
    only = estimates.bootstrap_share(df.where("i = 0"), "g", "s", "p", "m", "w", ["i"], 50, block=8).first()
    assert (only["mean"], only["std"]) == (pytest.approx(1 / 1_000_001), pytest.approx(0))


def test_ramp_by_hand():
    """The ramp shifts the curve within its width alone."""
    p = [5.0, 1.0, 9.0, 2.0, 6.0, -3.0]
    plain = lambda x: 9 / (1 + np.exp(-(x - 5)))
    got = fitting.evaluate("sigmoid_ramp", np.array([1.0, 2.0, 4.0, 7.9, 8.0, 9.0]), p, 0, 10)
    np.testing.assert_allclose(got, [plain(1), plain(2), plain(4 + 3 * 2 / 6), plain(7.9 + 3 * 5.9 / 6), plain(8), plain(9)])


def test_long_histories_are_linear(spark):
    """One key of 100,000 versions."""
    rows = spark.range(100_000).selectExpr("0 as k", "cast(id / 2 as long) as version", "date_add(date'1900-01-01', cast(id / 2 as int)) as day")
    out = temporal.with_valid_to(rows, "k", "version", "day")
    assert out.where("valid_to = date_add(day, 1)").count() == 99_998 and out.where("valid_to = date'2099-12-31'").count() == 2


def test_latest_before_by_hand(spark):
    rng = random.Random(3)
    left = [(i, rng.choice([1, 2, None]), rng.randrange(30)) for i in range(200)]
    right = [(rng.choice([1, 2, 3, None]), rng.randrange(30), v, f"v{v}") for v in range(80)]
    out = temporal.latest_before(spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, t int, version int, v string"), ["k"], "t", "t", "version", ["v"], ["i"])
    want = {i: max((v for k2, t2, v, _ in right if k2 == k and t2 <= t), default=None) for i, k, t in left if k is not None}
    assert {r["i"]: r["v"] for r in out.collect()} == {i: f"v{v}" for i, v in want.items() if v is not None}


def test_curves_in_numpy_match_columns(spark):
    from growthlens.plans.curves import FIRST, LAST, TRIED

    x = np.linspace(0, 10, 60)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for name, p in TRIED.items():
        col = curves.CURVES[name].value(F.col("x"), [F.lit(v) for v in p], F.lit(FIRST), F.lit(LAST))
        got = [r[0] for r in df.orderBy("x").select(col).collect()]
        np.testing.assert_allclose(got, fitting.evaluate(name, x, p, FIRST, LAST), rtol=1e-9, atol=1e-9)
        end = curves.CURVES[name].end([F.lit(v) for v in p], F.lit(FIRST), F.lit(LAST))
        at = spark.range(1).select(end).first()[0]
        if name == "sigmoid":  # the curve is at the share that counts as complete
            assert fitting.evaluate(name, np.array([at]), p, FIRST, LAST)[0] == pytest.approx(0.99 * p[2])


def test_fit_recovers_a_curve(spark):
    x = np.linspace(0, 10, 80)
    rows = [(g, float(a), float(b)) for g, p in (("a", [4, 1.5, 7]), ("b", [6, 0.8, 3])) for a, b in zip(x, fitting.evaluate("sigmoid", x, p, 0, 10), strict=True)] + [("few", 1.0, 1.0)] * 3
    fits = fitting.fit_curves(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y", 0.0, 10.0, curves=("sigmoid", "line", "gompertz"))
    best = fitting.best_fit(fits.withColumn("ordinal", F.col("curve")), ["g"]).collect()
    assert {r["g"]: r["curve"] for r in best} == {"a": "sigmoid", "b": "sigmoid"}
    got = {r["g"]: r for r in best}
    assert got["a"]["params"] == pytest.approx([4, 1.5, 7], rel=0.02) and got["a"]["asymptote"] == pytest.approx(7, rel=0.02)


def test_jump_starts():
    x = np.arange(60.0)
    y = np.where(x > 20, 5.0, 0) + np.where(x > 40, 3.0, 0) + x * 0.01 + np.where((x > 50) & (x < 54), 0.4, 0)
    assert [r[0] for r in fitting.rise_starts(x, y, 2)] == [20.0, 40.0]
    assert fitting.rise_starts(x[:3], y[:3], 1) is None


def test_sampler_finds_its_parameters(spark):
    rng = np.random.default_rng(4)
    rows = []
    for cid in range(1, 9):
        for _ in range(150):
            x = float(rng.normal())
            total = int(rng.poisson(np.exp(1.5 + 0.4 * x)))
            rows.append((cid, float(rng.binomial(total, 1 / (1 + np.exp(-(0.5 + 0.8 * x))))), float(total), x))
    draws = hierarchical.sample_model(spark.createDataFrame(rows, "cid long, present double, total double, x double"), "linear", chains=2, iterations=800)
    got = {(r["part"], r["coefficient"]): r["mean"] for r in hierarchical.coefficient_table(draws).collect()}
    assert got["total", 0] == pytest.approx(1.5, abs=0.15) and got["total", 1] == pytest.approx(0.4, abs=0.15)
    assert got["share", 0] == pytest.approx(0.5, abs=0.2) and got["share", 1] == pytest.approx(0.8, abs=0.2)
    with pytest.raises(ValueError):
        hierarchical.sample_model(spark.createDataFrame(rows, "cid long, present double, total double, x double"), most_points=5)


def test_scored_rows_match_cells_and_unknown_is_null(spark):
    cells = spark.createDataFrame([(1, 1, 0.5), (2, 9, 0.5)], "k int, cid long, x double")
    draws = spark.createDataFrame([(i, 1, [1.0, 0.1 * i, 0.0], [0.0, 0.1 * i, 0.0]) for i in range(5)], "draw long, cid long, total_b array<double>, share_b array<double>")
    out = {r["k"]: r for r in hierarchical.score_cells(cells, draws).collect()}
    assert out[1]["segments_mean"] == pytest.approx(np.mean([np.exp(1 + 0.05 * i) for i in range(5)])) and out[2]["segments_mean"] is None and len(out) == 2


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_selection_probabilities(spark, monkeypatch, block):
    monkeypatch.setattr(sampling, "BLOCK_ROWS", block)
    rows = [("g", i, float(i)) for i in range(1, 11)]
    out = sampling.proportional(spark.createDataFrame(rows, "g string, i int, s double"), "g", "s", ["i"], 5000).groupBy("i").agg(F.count("*").alias("n"), F.first("selection").alias("p")).collect()
    for r in out:
        assert r["n"] == pytest.approx(r["p"], rel=0.35) and r["p"] == pytest.approx(5000 * r["i"] / 55)


def test_range_join_has_no_misses(spark):
    rng = random.Random(2)
    lows = [rng.uniform(-50, 50) for _ in range(40)]
    ranges = [(i, lo, lo + rng.choice([0.0, 3.0, 60.0])) for i, lo in enumerate(lows)]
    values = [(i, rng.uniform(-60, 120)) for i in range(200)] + [(1000, ranges[0][1]), (1001, ranges[1][2])]
    got = {(r["k"], r["f"]) for r in history.range_join(spark.createDataFrame(values, "k int, v double"), spark.createDataFrame(ranges, "f int, lo double, hi double"), "v", "lo", "hi", 7.5).collect()}
    assert got == {(k, f) for k, v in values for f, lo, hi in ranges if lo <= v <= hi}


def test_tiles_lose_no_pair(spark):
    rng = random.Random(6)
    boxes = [(i, x, y, x + rng.uniform(0, 9), y + rng.uniform(0, 9)) for i in range(40) for x, y in [(rng.uniform(-20, 20), rng.uniform(-20, 20))]]
    df = spark.createDataFrame(boxes, "k int, left double, low double, right double, high double")
    got = {(r["a"], r["b"]) for r in spatial.overlapping_boxes(df, "k", 4.0).collect()}
    assert got == {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]}


def _rings(rng, n):
    """Star-shaped rings, convex or not."""
    out = []
    for i in range(n):
        x, y, k = rng.uniform(-3, 3), rng.uniform(40, 43), rng.randrange(3, 12)
        turns = sorted(rng.uniform(0, 2 * np.pi) for _ in range(k))
        ring = [(x + rng.uniform(0.2, 1) * float(np.cos(t)), y + rng.uniform(0.2, 1) * float(np.sin(t))) for t in turns]
        out.append((i, [*ring, ring[0]]))
    return out


def _inside(x, y, ring):
    return sum((ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True)) % 2 == 1


def test_rings_by_hand(spark):
    rng = random.Random(12)
    rings = _rings(rng, 12)
    polygons = spark.createDataFrame([(i, r) for i, r in rings], "unit int, ring array<struct<x: double, y: double>>")
    points = [(i, rng.uniform(-4, 4), rng.uniform(39, 44)) for i in range(400)]
    got = {(r["p"], r["unit"]) for r in spatial.points_to_polygons(spark.createDataFrame(points, "p int, x double, y double"), polygons, "p", "unit", 0.37).collect()}
    assert {g for g in got if g[1] is not None} == {(p, i) for p, x, y in points for i, r in rings if _inside(x, y, r)} and {p for p, _ in got} == set(range(400))

    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def meets(a, b, ring):
        return _inside(*a, ring) or any(turn(c, d, a) * turn(c, d, b) <= 0 and turn(a, b, c) * turn(a, b, d) <= 0 for c, d in zip(ring[:-1], ring[1:], strict=True))

    lines = [(i, x, y, x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for i, x, y in points]
    got = {(r["way"], r["unit"]) for r in spatial.segments_to_polygons(spark.createDataFrame(lines, "way int, x0 double, y0 double, x1 double, y1 double"), polygons, "way", "unit", 0.37).collect()}
    assert {g for g in got if g[1] is not None} == {(w, i) for w, a, b, c, d in lines for i, r in rings if meets((a, b), (c, d), r)} and {w for w, _ in got} == set(range(400))

    some = rings[:3]
    pixels = {(r["unit"], r["row"], r["col"]) for r in spatial.rasterized(polygons.where("unit < 3").unionByName(polygons.where("unit = 0")), "unit").collect()}
    want = set()
    for i, ring in some:
        xs, ys = [x for x, _ in ring], [y for _, y in ring]
        for row in range(int((90 - max(ys)) * 120) - 1, int((90 - min(ys)) * 120) + 2):
            for col in range(int((min(xs) + 180) * 120) - 1, int((max(xs) + 180) * 120) + 2):
                if _inside((col + 0.5) / 120 - 180, 90 - (row + 0.5) / 120, ring):
                    want.add((i, row, col))
    assert pixels == want


def test_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert df.select(scalars.nan_to_null("x").alias("x")).agg(F.sum("x"), F.count("x")).first()[:] == (1.0, 1)


def test_lengths_on_the_ellipsoid(spark):
    """A degree along the equator, along a meridian at the equator and at 60 degrees, and from Flinders Peak to Buninyong, as published."""
    lines = [([(0.0, 0.0), (1.0, 0.0)], 111_319.491), ([(10.0, -0.5), (10.0, 0.5)], 110_574.276), ([(10.0, 59.5), (10.0, 60.5)], 111_412.27), ([(144.42486789, -37.95103342), (143.92649553, -37.65282114)], 54_972.271), ([(5.0, 5.0), (5.0, 5.0)], 0.0), ([(1.0, 1.0)], 0.0), ([], 0.0)]
    df = spark.createDataFrame([(i, [tuple(p) for p in points]) for i, (points, _) in enumerate(lines)], "i int, points array<struct<lon: double, lat: double>>")
    for r in df.select("i", geo.line_length(F.col("points")).alias("m")).collect():
        assert r["m"] == pytest.approx(lines[r["i"]][1], rel=1e-5, abs=1e-9)
