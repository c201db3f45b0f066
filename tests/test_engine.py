"""Hand-made grids, driver-side names, and tables written and read again."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nilas import config
from nilas.functions import angles, calendar, physics, units
from nilas.nulls import clip, nan_to_null
from nilas.operators import aggregates as agg
from nilas.operators import predicates as pred
from nilas.operators import relational as rel
from nilas.operators import spatial, temporal, windows
from nilas.plans.classify import classify
from nilas.plans.metrics import compute, needed, ranks
from nilas.sinks import tables as sinks
from nilas.sources import tables as sources
from nilas.streaming import daily

DAY = date(2000, 1, 1)
NAN = float("nan")


def days(spark, values, schema="time date, cell int, v double"):
    return spark.createDataFrame([(DAY + timedelta(i), 1, v) for i, v in enumerate(values)], schema)


def one(df):
    return df.first()[0]


# --- predicates and missing values


def test_fast_ice_in_single_precision(spark):
    rows = [(0.15, 1e-4), (0.1501, 5e-4), (0.9, 0.0), (0.9, NAN), (NAN, 1e-4), (0.9, 6e-4), (None, 1e-4)]
    df = nan_to_null(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, aice float, speed float"))
    got = df.select("i", pred.fast_ice(F.col("aice"), F.col("speed")).alias("f"), pred.sea_ice(F.col("aice")).alias("s")).orderBy("i").collect()
    assert [r.f for r in got] == [False, True, False, False, False, False, False]
    assert [r.s for r in got] == [True, True, True, True, False, True, False]


def test_boxes_share_edges_and_wrap(spark):
    values = ", ".join(f"('{n}', {a}D, {b}D, {c}D, {d}D)" for n, a, b, c, d in [*config.REGIONS, ("WRAP", 170.0, -170.0, -80.0, -60.0)])
    boxes = spark.sql(f"SELECT * FROM VALUES {values} AS t(region, lon_min, lon_max, lat_min, lat_max)")
    cells = spark.createDataFrame([(x, y) for x in (-102.0, -60.0, 20.0, 103.0, 146.0, 179.9, -179.9, 172.0, 257.9) for y in (-60.0, -80.0, -59.0)], "lon double, lat double")
    found = {}
    for r in agg.with_regions(cells, boxes, "lon", "lat").collect():
        found.setdefault((r.lon, r.lat), set()).add(r.region)
    assert found[(-102.0, -60.0)] == {"AS", "BS"} and found[(-60.0, -80.0)] == {"BS", "WS"} and (20.0, -60.0) not in found
    assert found[(103.0, -60.0)] == {"EIO", "Aus"} and found[(179.9, -80.0)] == found[(-179.9, -80.0)] == {"WRAP"}
    assert found[(172.0, -60.0)] == {"VOL", "WRAP"} and found[(257.9, -60.0)] == {"AS"}  # 102.1 degrees west
    assert not any(lat == -59.0 for _, lat in found)


def test_clip_keeps_missing(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (2.0,), (-1.0,)], "v double").select(clip(F.col("v"), 0, 1)).collect()] == [None, 1.0, 0.0]


def test_sums_of_nothing_are_zero_and_ratios_missing(spark):
    df = spark.createDataFrame([(1, 0.5, None, 2.0), (1, 0.5, 2.0, 2.0), (2, None, None, 2.0)], "t int, aice double, hi double, area double")
    m = F.col("aice") > 0.15
    got = df.groupBy("t").agg(agg.area(m, F.col("aice"), F.col("area"), 1).alias("a"), agg.thickness(m, F.col("aice"), F.col("hi"), F.col("area")).alias("h")).orderBy("t").collect()
    assert (got[0].a, got[0].h) == (2.0, 1.0)  # unknown thickness counts in the divisor
    assert (got[1].a, got[1].h) == (0.0, None)


def test_skill_of_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (None, 9.0)], "m double, o double")
    r = df.agg(*[c.alias(n) for n, c in agg.skill(F.col("m"), F.col("o")).items()]).first()
    assert r.bias == -2.0 and r.mae == 2.0 and r.corr is None


# --- windows


def test_binary_days_count_rows(spark):
    hits = [True] * 6 + [False] + [True] * 8 + [False] * 20 + [True] * 9 + [False]
    df = spark.createDataFrame([(DAY + timedelta(i + (i > 15)), 1, h) for i, h in enumerate(hits)], "time date, cell int, raw boolean")
    got = [r.b for r in df.select("time", F.coalesce(windows.binary_days("raw", ["cell"], "time"), F.lit(False)).alias("b")).orderBy("time").collect()]
    ref = [sum(hits[max(0, i - 5) : i + 6]) >= 9 for i in range(len(hits))]
    assert got == ref and any(g and not h for g, h in zip(got, hits, strict=True))
    with pytest.raises(ValueError):
        windows.centred(["cell"], "time", 10)


def test_rolling_mean_needs_full_support(spark):
    got = [r.m for r in days(spark, [1.0] * 10 + [None] + [1.0] * 16).select("time", windows.rolling_mean("v", ["cell"], "time").alias("m")).orderBy("time").collect()]
    assert [i for i, m in enumerate(got) if m is not None] == [18, 19]


def test_daily_values_stop_at_gaps_and_ends(spark):
    df = spark.createDataFrame([(1, DAY, 0.0), (1, DAY + timedelta(10), 1.0), (1, DAY + timedelta(60), 0.5)], "cell int, time date, v double")
    got = {(r.time - DAY).days: r.v for r in windows.daily_values(df, ["cell"], "time", "v", DAY - timedelta(2), DAY + timedelta(70), max_gap=15).collect()}
    assert got[-2] is None and got[5] == 0.5 and got[10] == 1.0 and got[25] == pytest.approx(0.85) and got[26] is None and got[61] is None
    near = {(r.time - DAY).days: r.v for r in windows.daily_values(df, ["cell"], "time", "v", DAY, DAY + timedelta(12), "nearest").collect()}
    assert near[5] == 0.0 and near[6] == 1.0


def test_nearest_in_time_prefers_the_earlier(spark):
    left = spark.createDataFrame([(1, DAY + timedelta(d)) for d in (0, 5, 6, 20)], "k int, time date")
    right = spark.createDataFrame([(1, DAY + timedelta(1), 1.0), (1, DAY + timedelta(9), 2.0)], "k int, time date, v double")
    got = {(r.time - DAY).days: r.v for r in windows.nearest_in_time(left, right, ["k"], "time", "v").collect()}
    assert got == {0: 1.0, 5: 1.0, 6: 2.0, 20: 2.0}


def test_staggered_grids(spark):
    df = spark.createDataFrame([(j, i, float(10 * j + i)) for j in range(3) for i in range(4)], "nj int, ni int, u double")
    c = {(r.nj, r.ni): r.centre for r in windows.corner_to_centre(df, "u", []).collect()}
    assert c[(0, 0)] == 5.5 and c[(0, 3)] == c[(0, 0)] and c[(2, 1)] is None
    e = {(r.nj, r.ni): r.e for r in df.select("nj", "ni", windows.edge_to_centre(df, "u", [], "x").alias("e")).collect()}
    assert e[(1, 1)] == 11.5 and e[(1, 3)] == (13 + 10) / 2


def test_speed_beside_land(spark):
    """3 x 3 cells, one missing corner at (0, 0): kept by Ta, 0 for Tb and Tc."""
    rows = [(j, i, None if j == i == 0 else 3.0, None if j == i == 0 else 4.0, 1.0, None if (j, i) == (1, 0) else 2.0) for j in range(3) for i in range(3)]
    df = spark.createDataFrame(rows, "nj int, ni int, uvel double, vvel double, uvelN double, vvelE double").withColumns({"uvelE": F.col("uvel"), "vvelN": F.col("vvel")})

    def speed(*a, **b):
        return {(r.nj, r.ni): r.speed for r in windows.centre_speed(df, [], *a, **b).collect()}

    a, b = speed("Ta"), speed("tb")
    assert a[(0, 0)] is None and a[(0, 2)] is None and a[(0, 1)] == 5.0 and a[(2, 1)] is None
    assert b[(0, 0)] == b[(0, 2)] == 3.75 and b[(1, 1)] == 5.0 and b[(2, 1)] is None
    assert speed("Ta, Tb")[(0, 0)] == 3.75 and speed("Tb Tx", regrid=lambda t, c: t)[(0, 0)] == 3.75 / 2
    assert speed(combine="uv")[(0, 0)] == pytest.approx((1.5**2 + 2**2) ** 0.5)
    assert speed()[(0, 0)] == pytest.approx((((1.5 + 1) / 2) ** 2 + ((1 + 2) / 2) ** 2) ** 0.5)
    assert config.grid_types(None) == ("Tc",) and config.grid_types("ta, Tb ta") == ("Ta", "Tb") and config.grid_types(["tx"]) == ("Tx",)
    for bad, error in ((("Tc Ta",), ValueError), (("Td",), ValueError), (("Tx",), NotImplementedError)):
        with pytest.raises(error):
            speed(*bad)
    with pytest.raises(KeyError):
        windows.centre_speed(df.drop("vvelE"), [])


# --- time


def test_first_of_equal_extrema(spark):
    df = days(spark, [1.0, 5.0, 2.0, 5.0, 0.0, 0.0])
    r = temporal.yearly_extrema(df, "time", "v", []).first()
    assert (r["max"], r["doy_max"], r["min"], r["doy_min"]) == (5.0, 2, 0.0, 5)


def test_noleap_days(spark):
    df = spark.createDataFrame([(date(2000, 2, 28),), (date(2000, 2, 29),), (date(2000, 3, 1),), (date(2001, 12, 31),)], "t date")
    assert [r[0] for r in df.select(calendar.noleap_day(F.col("t"))).collect()] == [59, None, 60, 365]


def test_stability_counts_exactly_the_limit(spark):
    rows = [(date(2000, 6, d), c, (c == 1 and d <= 4) or (c == 2 and d <= 3), 2.0) for d in range(1, 6) for c in (1, 2, 3)]
    df = spark.createDataFrame(rows, "time date, cell int, fi boolean, area double")
    r = temporal.stability(df, "fi", "time", "cell", "area").first()
    assert (r.persistent_area, r.ever_area, r["index"]) == (2.0, 4.0, 0.5)
    assert temporal.stability(df.where("cell = 9"), "fi", "time", "cell", "area").first()["index"] is None


# --- space


def test_neighbours_equal_brute_force(spark):
    import math
    import random

    rng = random.Random(2)
    point = lambda: (rng.uniform(-180, 180), rng.uniform(-90, -50))
    src, tgt = [(i, *point()) for i in range(80)], [(i, *point()) for i in range(60)]
    tgt[0] = (0, *src[7][1:])

    def km(a, b):
        v = [(math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y))) for x, y in (a, b)]
        return 2 * 6371 * math.asin(min(1, math.dist(*v) / 2))

    near = spatial.neighbours(spark.createDataFrame(tgt, "tgt_id int, lon double, lat double"), spark.createDataFrame(src, "src_id int, lon double, lat double"), 3, 900.0)
    got = {}
    for r in near.collect():
        got.setdefault(r.tgt_id, []).append((r["rank"], r.src_id))
    for i, *p in tgt:
        best = sorted((d, j) for j, *q in src if (d := km(p, q)) <= 900)[:3]
        assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in best]
    w = spatial.inverse_distance_weights(near, 2.5)
    sums = {r.tgt_id: (r.s, r.n) for r in w.groupBy("tgt_id").agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect()}
    assert all(s == pytest.approx(1) for s, _ in sums.values()) and sums[0] == (1.0, 1)
    field = spark.createDataFrame([(i, 4.0) for i, *_ in src], "src_id int, v double")
    assert all(r.v == pytest.approx(4.0) for r in spatial.apply_weights(field, w, [], "v").collect())


def rows_of_operators(df):
    """The greatest number of rows that an operator of a frame's plan gave out, once it has run."""
    df.collect()

    def walk(node):
        name, found = node.getClass().getSimpleName(), node.metrics().get("numOutputRows")
        yield found.get().value() if found.isDefined() else 0
        inner = node.children()
        for child in [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [inner.apply(n) for n in range(inner.size())]:
            yield from walk(child)

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_neighbours_at_the_same_places_do_not_meet_in_pairs(spark):
    none, nan = None, float("nan")
    src = [(i, (0.0, 1.0, 40.0)[i % 3], -70.0) for i in range(300)] + [(300, none, -70.0), (301, nan, -70.0)]
    tgt = [(i, (0.0, 1.0, 2.0, 120.0)[i % 4], -70.0) for i in range(400)] + [(400, 0.0, none), (401, nan, -70.0)] + [(4, 0.0, -70.0)]
    near = spatial.neighbours(spark.createDataFrame(tgt, "tgt_id int, lon double, lat double"), spark.createDataFrame(src, "src_id int, lon double, lat double"), 2, 1000.0)
    assert rows_of_operators(near) < 5000  # all pairs within the radius are some 60,000
    got = {}
    for r in near.collect():
        got.setdefault(r.tgt_id, []).append((r["rank"], r.src_id, round(r.km)))
    assert len(got) == 300
    for i, rows in got.items():  # an id that is there twice has its neighbours together
        assert sorted(rows) == ([(1, 0, 0), (2, 0, 0)] if i == 4 else [[(1, 0, 0), (2, 3, 0)], [(1, 1, 0), (2, 4, 0)], [(1, 1, 38), (2, 4, 38)]][i % 4])


def test_neighbours_are_exact_where_cubes_hold_less_than_k(spark):
    rng = random.Random(5)
    point = lambda: (rng.choice((rng.uniform(-180, 180), rng.uniform(10, 10.5))), rng.choice((rng.uniform(-90, 90), rng.uniform(-70.2, -70))))
    src, tgt = [(i, *point()) for i in range(150)], [(i, *point()) for i in range(60)]
    to = lambda p: (math.cos(math.radians(p[1])) * math.cos(math.radians(p[0])), math.cos(math.radians(p[1])) * math.sin(math.radians(p[0])), math.sin(math.radians(p[1])))
    frames = [spark.createDataFrame(p, f"{k} int, lon double, lat double") for k, p in (("tgt_id", tgt), ("src_id", src))]
    for k, radius in ((4, 2500.0), (200, 500.0), (7, 30000.0)):
        got = {}
        for r in spatial.neighbours(*frames, k, radius).collect():
            got.setdefault(r.tgt_id, []).append((r["rank"], r.src_id))
        for i, *p in tgt:
            near = sorted((d, j) for j, *q in src if (d := 2 * 6371 * math.asin(min(1, math.dist(to(p), to(q)) / 2))) <= radius)[:k]
            assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in near]


def test_weights_that_targets_share_are_applied_once(spark, tmp_path):
    from nilas.plans.queries import QUERIES

    customers = [(i, i % 2) for i in range(400)] + [(-7, 0), (-1, 1), (5, 0), (5, 1), (None, 0), (9, None), (900, 3)]
    suppliers = [(i, i % 2, i / 7) for i in range(300)] + [(-4, 0, 2.5), (-3, 1, None), (8, 0, 1.5), (None, 1, 9.0)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["j19_apply_weights"](spark, str(tmp_path))
    assert rows_of_operators(got) < 20_000  # all pairs of a nation are some 60,000
    want = {}
    for c, n in customers:
        for s, m, _ in suppliers:
            for again, _, v in suppliers if n == m and n is not None and s is not None else ():
                if again == s:
                    mod = None if c is None else int(math.fmod(c + s, 3))
                    want.setdefault(c, []).extend([] if mod is None or v is None else [(1 + mod) / 10 * v])
    rows = got.collect()
    assert len(rows) == len(want) and {r.tgt_id for r in rows} == set(want)
    assert all(r.value == (pytest.approx(sum(want[r.tgt_id])) if want[r.tgt_id] else None) for r in rows)


def test_nearest_has_no_radius(spark):
    import math
    import random

    rng = random.Random(4)
    xyz = lambda x, y: (math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y)))
    tgt = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(120)] + [(120, 0.0, 90.0), (121, 180.0, -80.0), (122, None, 0.0)]
    tight, wide = [(i, rng.gauss(10, 0.2), rng.gauss(-75, 0.1)) for i in range(150)], [(i, rng.uniform(-180, 180), rng.uniform(-90, -50)) for i in range(40)]
    for src in (tight, wide, wide + [(i + 40, x, y) for i, x, y in wide], [(7, 1.0, 1.0)]):
        got = {r.tgt_id: (r.src_id, r.km) for r in spatial.nearest(spark.createDataFrame(tgt, "tgt_id int, lon double, lat double"), spark.createDataFrame(src, "src_id int, lon double, lat double")).collect()}
        assert set(got) == set(range(122))
        for i, *p in tgt[:122]:
            d, j = min((2 * 6371 * math.asin(min(1, math.dist(xyz(*p), xyz(*q)) / 2)), j) for j, *q in src)
            assert got[i] == (j, pytest.approx(d))


def test_bilinear_keeps_targets_at_gaps_and_outside(spark):
    source = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, None)], "j int, i int, value double")
    targets = spark.createDataFrame([(0, 0.0, 0.5), (1, 0.75, 0.25), (2, -3.0, 9000.0), (3, 0.5, 0.0), (4, None, 0.0)], "k int, y double, x double")
    got = {r.k: r.value for r in spatial.bilinear(targets, source, ["k"]).collect()}
    assert got == {0: 2.0, 1: 5.0, 2: 3.0, 3: 3.0, 4: None}
    got = {r.k: r.value for r in spatial.bilinear(targets, source, ["k"], extrapolate=False).collect()}
    assert got == {0: 2.0, 1: None, 2: None, 3: 3.0, 4: None}


def test_clipped_lines_keep_their_length(spark):
    df = spark.createDataFrame([(0.5, 0.5, 9.5, 4.5), (3.0, 1.0, 3.0, 7.5), (2.0, 2.0, 2.0, 2.0), (-4.0, 1.0, 4.0, 1.0)], "x0 double, y0 double, x1 double, y1 double")
    r = spatial.line_density(df, 2.0).agg(F.sum("fx") * 2, F.sum("fy") * 2).first()
    assert r[0] == pytest.approx(9 + 0 + 8) and r[1] == pytest.approx(4 + 6.5)


def clipped_area(polygon, quad):
    """Area of a polygon in a convex quad that runs counter-clockwise: cut by one side after the other."""
    points = polygon
    for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        made = []
        for p, q in zip(points, points[1:] + points[:1], strict=True):
            s, e = side(p), side(q)
            if s >= 0:
                made.append(p)
            if s * e < 0:
                made.append((p[0] + (q[0] - p[0]) * s / (s - e), p[1] + (q[1] - p[1]) * s / (s - e)))
        points = made
        if not points:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True))) / 2


def test_polygons_in_slanted_cells_equal_brute_force(spark):
    """Star-shaped polygons, concave and in both directions, in a sheared grid of quads; one ring is unknown, one cell is far."""
    rng = random.Random(5)
    polygons, cells = {}, {}
    for k in range(25):
        x, y, n = rng.uniform(-12, 12), rng.uniform(-12, 12), rng.randint(3, 9)
        ring = [(x + r * math.cos(2 * math.pi * a / n), y + r * math.sin(2 * math.pi * a / n)) for a, r in enumerate(rng.uniform(0.3, 6) for _ in range(n))]
        polygons[k] = ring if k % 2 else ring[::-1]
    for i in range(-5, 5):
        for j in range(-5, 5):
            corner = lambda a, b: (2.7 * a + 0.6 * b, 2.3 * b - 0.4 * a)
            cells[i * 100 + j] = [corner(i, j), corner(i + 1, j), corner(i + 1, j + 1), corner(i, j + 1)]
    cells[9999] = [(500.0, 500.0), (501.0, 500.0), (501.0, 501.0), (500.0, 501.0)]
    want = {(k, c): a for k, p in polygons.items() for c, q in cells.items() if (a := clipped_area(p, q)) > 1e-7}
    rings = [*[(k, p, False) for k, p in polygons.items()], (77, [(0.0, 0.0), (1.0, None), (1.0, 1.0)], False), (78, [(0.0, 0.0), (1.0, 1.0)], False), (79, [], False), (80, None, False)]
    p = spark.createDataFrame(rings, "id int, ring array<struct<x:double,y:double>>, hole boolean")
    c = spark.createDataFrame(list(cells.items()), "cell_id int, corners array<struct<x:double,y:double>>")
    for size in (1.3, 5.0):
        rows = spatial.polygon_cover(p, c, size).collect()
        got = {(r.id, r.cell_id): r.area for r in rows if r.area > 1e-7}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(a, rel=1e-9, abs=1e-10) for k, a in want.items())
        assert all(r.cell_area == pytest.approx(2.7 * 2.3 + 0.6 * 0.4) for r in rows)
    holes = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], False), (1, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], True)], p.schema)
    box = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 4.0), (0.0, 4.0)]), (2, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)])], c.schema)
    assert [(r.cell_id, r.area, r.hits, r.fraction) for r in spatial.occupancy(spatial.polygon_cover(holes, box, 2.0)).collect()] == [(1, 6.0, 1, 0.75)]
    twice = holes.where("NOT hole").union(holes.where("NOT hole").withColumn("id", F.lit(2)))
    assert {r.cell_id: (r.hits, r.fraction) for r in spatial.occupancy(spatial.polygon_cover(twice, box, 2.0)).collect()} == {1: (2, 1.0), 2: (2, 1.0)}
    assert spatial.polygon_cover(p.limit(0), c, 2.0).isEmpty()


def slanted(spark, n=8):
    """Corners of a sheared grid, the one at (0, 0) in the origin."""
    return spark.createDataFrame([(j, i, 2.0 * i + 0.5 * j, 1.5 * j - 0.3 * i) for j in range(-n, n) for i in range(-n, n)], "nj int, ni int, x double, y double")


def test_lines_in_slanted_cells_keep_their_length(spark):
    cells = spatial.cells_of_corners(slanted(spark)).withColumns({"cell_id": F.struct("nj", "ni"), "dx": F.lit(2.0), "dy": F.lit(0.0)})
    rng = random.Random(3)
    lines = [(k // 3, *[rng.uniform(-4, 4) for _ in range(4)]) for k in range(60)]
    s = spark.createDataFrame([*lines, (90, 1.0, 1.0, 1.0, 1.0), (91, float("nan"), 1.0, 2.0, 2.0)], "source int, x0 double, y0 double, x1 double, y1 double")
    i, j = (2.0 / math.hypot(2, 0.3), -0.3 / math.hypot(2, 0.3)), (0.5 / math.hypot(0.5, 1.5), 1.5 / math.hypot(0.5, 1.5))
    along = [sum(abs((c - a) * e[0] + (d - b) * e[1]) for _, a, b, c, d in lines) for e in (i, j)]
    for size in (1.1, 4.0):
        out = spatial.line_cover(s, cells, size)
        r = out.agg(F.sum("sum_i"), F.sum("sum_j"), F.sum("fx"), F.sum("fy"), F.max("hits")).first()
        assert [r[0], r[1], r[2], r[3]] == [pytest.approx(along[0]), pytest.approx(along[1]), pytest.approx(along[0] / 2), 0.0] and r[4] <= 20
    alone = s.limit(0).union(spark.createDataFrame([(1, 0.1, 0.1, 0.9, 0.1), (1, 0.9, 0.1, 0.9, 0.2), (2, -50.0, 0.7, 50.0, 0.7)], s.schema))
    mine = spatial.line_cover(alone, cells, 2.0).where("cell_id.nj = 0 AND cell_id.ni = 0").first()
    assert mine.hits == 2


def test_cells_need_all_corners_and_area(spark):
    whole = slanted(spark, 2)
    assert spatial.cells_of_corners(whole).count() == 9
    holed = whole.withColumn("x", F.when((F.col("nj") != 0) | (F.col("ni") != 0), F.col("x")))
    assert spatial.cells_of_corners(holed).count() == 5 and spatial.cells_of_corners(whole.where("ni != 0")).count() == 3
    assert spatial.cells_of_corners(whole.withColumn("y", F.lit(0.0))).count() == 0


def test_conservative_weights_keep_sums_and_constants(spark):
    grid = spatial.cells_of_corners(slanted(spark)).select(F.struct("nj", "ni").alias("src_id"), "corners")
    square = lambda a, b: [(a, b), (a + 1.7, b), (a + 1.7, b + 1.7), (a, b + 1.7)]
    inside = spark.createDataFrame([(k, square(1.7 * (k % 3) - 2, 1.7 * (k // 3) - 2)) for k in range(9)] + [(9, square(15.0, 0.0)), (10, square(90.0, 90.0))], "tgt_id int, corners array<struct<x:double,y:double>>")
    sums = {r.tgt_id: r.w for r in spatial.conservative_weights(grid, inside, 2.0).groupBy("tgt_id").agg(F.sum("w").alias("w")).collect()}
    shares = {r.tgt_id: r.w for r in spatial.conservative_weights(grid, inside, 2.0, normalised=False).groupBy("tgt_id").agg(F.sum("w").alias("w")).collect()}
    assert sums.keys() == shares.keys() == set(range(10)) and all(v == pytest.approx(1.0) for v in sums.values())
    assert all(shares[k] == pytest.approx(1.0) for k in range(9)) and 0 < shares[9] < 1
    back = spatial.conservative_weights(inside.where("tgt_id < 9").withColumnRenamed("tgt_id", "src_id"), grid.withColumnRenamed("src_id", "tgt_id"), 2.0, normalised=False)
    kept = back.groupBy("src_id").agg((F.sum("w") * (2.0 * 1.5 + 0.5 * 0.3)).alias("area")).collect()
    assert len(kept) == 9 and all(r.area == pytest.approx(1.7**2) for r in kept)


def test_fields_with_one_line_more(spark):
    df = spark.createDataFrame([(j, i, None if (j, i) == (0, 3) else float(10 * j + i)) for j in range(3) for i in range(4)], "nj int, ni int, u double")
    x = {(r.nj, r.ni): r.centre for r in windows.enclosed_centres(df, "u", [], "x", wrap=False).collect()}
    assert len(x) == 9 and x[(0, 2)] is None and x[(1, 2)] == 12.5
    y = {(r.nj, r.ni): r.centre for r in windows.enclosed_centres(df, "u", [], "y", zero=True).collect()}
    assert len(y) == 8 and y[(0, 1)] == 6.0 and y[(0, 3)] == y[(0, 0)] == 5.0
    xy = {(r.nj, r.ni): r.centre for r in windows.enclosed_centres(df, "u", [], "xy", wrap=False).collect()}
    assert len(xy) == 6 and xy[(0, 0)] == 5.5 and xy[(0, 2)] is None and xy[(1, 2)] == 17.5


def test_polar_plane_round_trip(spark):
    df = spark.createDataFrame([(lon, lat) for lon in (-170.0, -30.0, 0.0, 90.0) for lat in (-89.0, -71.0, -55.0)], "lon double, lat double")
    x, y = angles.polar_xy(F.col("lon"), F.col("lat"))
    lon, lat = angles.polar_lonlat(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", x.alias("x"), y.alias("y")).select("*", lon.alias("a"), lat.alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-7) and r.b == pytest.approx(r.lat, abs=1e-7)
    r = spark.createDataFrame([(0.0, -71.0)], "lon double, lat double").select(y.alias("y")).first()
    assert r.y == pytest.approx(2_082_760.0, rel=2e-3)


def test_units_are_checked(spark):
    df = spark.createDataFrame([(1.0, "furlong")], "v double, u string")
    with pytest.raises(Exception, match="unknown area units"):
        df.select(units.area_million_km2(F.col("v"), F.col("u"))).collect()
    assert one(spark.createDataFrame([("1536mb",)], "t string").select(units.gigabytes(F.col("t")))) == 1.5
    assert one(spark.range(1).select(physics.rain(F.lit(None).cast("double"), F.lit(1.0)))) is None


# --- names


def test_names():
    assert config.method("Binary_Days") == "binary-days" and config.hemisphere("south") == "SH" and config.threshold_tag(5e-4) == "5.0e-4"
    assert sorted(["run10", "run9", "Run1"], key=config.natural_key) == ["Run1", "run9", "run10"]
    assert config.metric_names(("FIA", "FIA"), ("S:spatial",))[:2] == ["FIA", "SIHI"] and len(config.metric_names()) == 9
    for bad in (lambda: config.method("x"), lambda: config.metric_names(groups=("X:core",)), lambda: config.by_domain(["XIA"])):
        with pytest.raises(ValueError):
            bad()
    assert ranks(["FIA", "PIP", "SIA_by_region", "FIA_max_mean"]) == (["FIA"], ["PIP"], ["SIA_by_region"], ["FIA_max_mean"])
    assert needed(["FIA", "FIS", "SITVR_YR"]) == ["aice", "hi", "strength", "dvidtt"]
    assert rel.resolve(["Tc"]) == "Tc" and rel.resolve(["Tb", "Tc"], wanted="Tc") == "Tc"
    for bad in (lambda: rel.resolve(["Tb", "Tc"]), lambda: rel.resolve(["Ta"])):
        with pytest.raises(LookupError):
            bad()


# --- plans


def cells(spark):
    rows = [(DAY + timedelta(d), c, 0.2 * c, 1e-4 * (1 + (d + c) % 8), 1.0 + c, 1e4, 0.5, 0.1, 1e9 * c) for d in range(40) for c in range(1, 5)]
    return spark.createDataFrame(rows, "time date, cell int, aice float, speed float, hi float, strength float, dvidtt float, daidtt float, area double")


@pytest.mark.parametrize("method", ["raw", "binary-days", "rolling-mean"])
def test_fast_and_pack_ice_are_apart(spark, method):
    got = classify(cells(spark), method)
    assert got.where("fi AND pi").count() == 0
    if method == "raw":
        assert got.where("aice > 0.15 AND NOT (fi OR pi)").count() == 0
        areas = compute(got, ["FIA", "PIA"]).agg(F.sum("value")).first()[0]
        assert areas == pytest.approx(got.where(F.col("aice") > 0.15).agg(F.sum(F.col("aice") * F.col("area")) / 1e9).first()[0])
    cut = classify(cells(spark), method, first=DAY + timedelta(15), last=DAY + timedelta(20)).select("time", "cell", "fi")
    whole = got.where(F.col("time").between(F.lit(DAY + timedelta(15)), F.lit(DAY + timedelta(20)))).select("time", "cell", "fi")
    assert cut.exceptAll(whole).count() == 0 and cut.count() == whole.count() == 24


def test_metrics_of_every_rank(spark):
    names = ["FIA", "SITVR", "FIP", "SIHI", "FIA_max_mean"]
    got = compute(classify(cells(spark), "raw"), names)
    assert {r.metric for r in got.select("metric").distinct().collect()} == set(names)
    with pytest.raises(ValueError):
        compute(classify(cells(spark), "raw"), ["FIA_by_region"])


def test_catalogue_has_every_name_of_the_registry(spark):
    """27 core, 18 spatial, 6 regional, 48 summary, 54 stress, 42 diagnostic, 11 of fast ice."""
    every = config.metric_names(groups=tuple(f"{d}:{g}" for d in "FPS" for g in config.GROUPS) + ("F:spec",))
    assert len(every) == 206 and {"SIKuN_mag_valid_area_m2", "PI_R_ld_budget_mean", "FIPSI", "persistent_winter_area", "FIT_Corr"} <= set(every)
    assert sum(map(len, ranks(every))) == 206 and config.by_domain(["ever_winter_area"]) == {"F": ["ever_winter_area"]}
    assert needed(["FIKuE_mag_mean", "SI_tau_tilt_mean", "FIT_Bias"]) == ["aice", "KuxE", "KuyE", "earea", "strtltx", "strtlty", "hi"]
    with pytest.raises(ValueError):
        config.metric_names(groups=("P:spec",))


def test_stress_and_diagnostics_by_hand(spark):
    df = spark.createDataFrame(
        [(DAY, 1, True, True, 0.5, 2.0, 3.0, 4.0, 1.0), (DAY, 2, True, True, 1.0, 1.0, -6.0, None, 3.0), (DAY, 3, False, True, 1.0, 1.0, 100.0, 0.0, 1.0)],
        "time date, cell int, fi boolean, si boolean, aice double, hi double, KuxE double, KuyE double, area double",
    )
    names = ["FIKuxE_mean", "FIKuxE_abs_mean", "FIKuE_mag_mean", "FIKuE_mag_valid_area_m2", "SIKuxE_valid_area_m2", "FI_ld_mag_proxy_mean", "FI_tau_ld_est_mean"]
    got = {r.metric: r.value for r in compute(df, names).collect()}
    assert got == {"FIKuxE_mean": -15 / 4, "FIKuxE_abs_mean": 21 / 4, "FIKuE_mag_mean": 5.0, "FIKuE_mag_valid_area_m2": 1.0, "SIKuxE_valid_area_m2": 5.0, "FI_ld_mag_proxy_mean": 5.0, "FI_tau_ld_est_mean": 917 * 5.0}
    wide = df.withColumn("earea", F.lit(2.0))
    assert one(compute(wide, ["SIKuxE_valid_area_m2"]).select("value")) == 6.0
    alone = {r.metric: r.value for r in compute(df.drop("KuyE"), ["FI_ld_mag_proxy_mean"]).collect()}
    assert alone == {"FI_ld_mag_proxy_mean": (3 + 18) / 4}
    for missing in ("FIKuxN_mean", "FI_tau_air_mean", "FI_P_ld_est_mean"):
        with pytest.raises(ValueError, match="aren't there"):
            compute(df, [missing])


def test_stability_and_skill_in_the_catalogue(spark):
    rows = [(date(2000, 6, d), c, (c == 1 and d <= 4) or (c == 2 and d <= 3), 1.0, 1.0, 1e9 * c) for d in range(1, 6) for c in (1, 2, 3)]
    df = spark.createDataFrame(rows, "time date, cell int, fi boolean, aice double, hi double, area double")
    got = {r.metric: r.value for r in compute(df, list(config.STABILITY)).collect()}
    assert got == {"FIPSI": pytest.approx(1 / 3), "persistent_winter_area": 1.0, "ever_winter_area": 3.0}
    summer = df.withColumn("time", F.date_add("time", 180))
    assert [r.value for r in compute(summer, list(config.STABILITY)).collect()] == [None, None, None]
    obs = spark.createDataFrame([(date(2000, 6, 1), 2.0), (date(2000, 6, 4), 4.0), (date(2001, 1, 1), 9.0)], "time date, FIA double")
    got = {r.metric: r.value for r in compute(df, ["FIA_Bias", "FIA_RMSE", "FIA_MAE", "FIA_Corr"], obs=obs).collect()}
    assert got == {"FIA_Bias": -1.0, "FIA_RMSE": pytest.approx(5**0.5), "FIA_MAE": 2.0, "FIA_Corr": pytest.approx(-1.0)}
    with pytest.raises(ValueError, match="observations"):
        compute(df, ["FIT_Bias"], obs=obs)


def test_calculators_stand_in_for_the_catalogue(spark):
    rows = [(date(2000, m, 1), 1, True, 0.5, 1.0, 1e9 * m) for m in (3, 9)]
    df = spark.createDataFrame(rows, "time date, cell int, fi boolean, aice double, hi double, area double")
    got = {(r.metric, r.time): (r.value, r.units) for r in compute(df, ["FIA", "cells"], calculators={"cells": lambda have: F.count(F.when(F.lit("hi" in have), 1))}).collect()}
    assert got == {("FIA", date(2000, 3, 1)): (1.5, "1e3 km2"), ("FIA", date(2000, 9, 1)): (4.5, "1e3 km2"), ("cells", date(2000, 3, 1)): (1.0, None), ("cells", date(2000, 9, 1)): (1.0, None)}
    twice = {"FIA": lambda have: F.sum("area") / 1e9}
    obs = spark.createDataFrame([(date(2000, 3, 1), 1.0), (date(2000, 9, 1), 1.0)], "time date, FIA double")
    assert [r.value for r in compute(df, ["FIA_Bias"], obs=obs, calculators=twice).collect()] == [5.0]
    with pytest.raises(ValueError):
        compute(df, ["cells"])


def test_area_series_of_a_store(spark, tmp_path):
    root = str(tmp_path / "s")
    spark.createDataFrame([(date(2000, 1, d), 2e6 * d, "km2") for d in (1, 2)], "time date, sia double, units string").write.parquet(root)
    assert [r.sia for r in sources.area_series(spark, root, last=date(2000, 1, 1)).collect()] == [2.0]
    assert sorted(r.sia for r in sources.area_series(spark, root, unit="m2", first=date(2000, 1, 1)).collect()) == [2e-6, 4e-6]
    for asked in ({"variable": "other"}, {"candidates": ("SIA",)}, {"first": date(2001, 1, 1)}):
        with pytest.raises(LookupError):
            sources.area_series(spark, root, **asked)


# --- tables


def test_ingest_shifts_and_replaces_months(spark, tmp_path):
    root = str(tmp_path / "history")
    df = spark.createDataFrame([(datetime(2000, 2, 1), 1, 0.5), (datetime(2000, 2, 2), 1, 0.6), (datetime(2000, 3, 5), 1, NAN)], "time timestamp_ntz, cell int, aice float")
    sinks.ingest(df, root)
    sinks.ingest(df.where("time < '2000-02-02'").withColumn("aice", F.lit(0.9).cast("float")), root)
    got = sources.history(spark, root, date(2000, 1, 31), date(2000, 3, 31), ["aice"])
    assert [(r.time.day, r.aice) for r in got.orderBy("time").collect()] == [(31, pytest.approx(0.9)), (1, pytest.approx(0.6)), (4, None)]
    plan = sources.history(spark, root, date(2000, 2, 1), date(2000, 2, 28))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan
    assert sources.history(spark, root, date(2000, 2, 1), date(2000, 2, 28), pad_days=1).count() == 2


@pytest.mark.parametrize("frequency", ["hourly", "inst"])
def test_hourly_store_round_trip(spark, tmp_path, frequency):
    root = str(tmp_path / "hourly")
    df = spark.createDataFrame([(datetime(y, m, d, h), 1, float(h)) for y, m, d in ((1999, 12, 31), (2000, 1, 1), (2000, 1, 2), (2000, 3, 5)) for h in (0, 23)], "time timestamp_ntz, cell int, aice float")
    sinks.ingest(df, root, frequency=frequency)
    for first, last, n in ((date(2000, 1, 1), date(2000, 1, 1), 2), (date(2000, 1, 2), date(2000, 3, 5), 4), (date(1999, 12, 31), date(2000, 1, 1), 4), (date(1999, 1, 1), date(2000, 12, 31), 8)):
        got = sources.history(spark, root, first, last, frequency=frequency)
        assert got.count() == n == sources.history(spark, root, first, last).count()
    read = sources.history(spark, root, date(2000, 1, 1), date(2000, 1, 2), frequency=frequency)
    assert len(read.select(F.input_file_name()).distinct().collect()) == 2
    files = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in files and "2000_01_01" in files


def test_classification_and_metric_stores(spark, tmp_path):
    df = classify(cells(spark), "raw")
    root = str(tmp_path / "classified")
    assert sinks.classification(df, root) and not sinks.classification(df, root) and sinks.classification(df, root, overwrite=True)
    store = str(tmp_path / "metrics")
    sinks.metrics(compute(df, ["FIA"]), store)
    sinks.metrics(compute(df, ["FIA", "PIA"]).withColumn("value", F.lit(-1.0)), store)
    got = {r.metric: r.v for r in spark.read.parquet(store).groupBy("metric").agg(F.min("value").alias("v")).collect()}
    assert got["PIA"] == -1.0 and got["FIA"] >= 0
    sinks.metrics(compute(df, ["FIA"]).withColumn("value", F.lit(-2.0)), store, overwrite=True)
    assert sources.metrics(spark, store, ["FIA"], DAY, DAY).agg(F.max("value")).first()[0] == -2.0
    sinks.by_kind(spark.createDataFrame([("Tb", "raw", 1)], "grid_type string, method string, v int"), str(tmp_path / "c2"), "grid_type")
    assert sources.classified(spark, str(tmp_path / "c2"), "raw").count() == 1
    assert sources.first_method(spark, str(tmp_path / "c2"), ["raw", "binary-days"]).count() == 1


def test_files_and_reports(spark, tmp_path):
    for n in ("a_20000101.nc", "b_20000101.nc", "cryosat_200003.nc"):
        (tmp_path / n).write_bytes(b"abc")
    listing = sources.files(spark, str(tmp_path), "*.nc")
    got = {r.path.rsplit("/", 1)[1]: (r.date, r.size, r.sensor) for r in listing.collect()}
    assert got["a_20000101.nc"] == (date(2000, 1, 1), 3, "unknown") and got["cryosat_200003.nc"][::2] == (date(2000, 3, 15), "cryosat2")
    per_day = {r.date: r.path for r in sources.one_per_day(listing, date(2000, 1, 1), date(2000, 1, 2)).collect()}
    assert per_day[date(2000, 1, 1)].endswith("a_20000101.nc") and per_day[date(2000, 1, 2)] is None
    first = sinks.changed_groups(listing, None, "date")
    assert first.count() == 2 and sinks.changed_groups(listing, first, "date").count() == 0
    import pandas as pd

    parsed = sources.through(spark, str(tmp_path), "*.nc", lambda content, path: pd.DataFrame({"n": [len(content)]}), "n long")
    assert [r.n for r in parsed.collect()] == [3, 3, 3]
    text = spark.createDataFrame([("&x\n dt = 3600.0\n  name= 'a=b'\n/",)], "value string")
    assert {r.key: r["value"] for r in sources.key_values(text).collect()} == {"dt": "3600.0", "name": "'a=b'"}
    report = spark.createDataFrame([("Job Id: 12.x\n Exit Status: 0\n Service Units: 1.5\n Memory Used: 2.0GB\n Walltime Used: 01:00:01",)], "value string")
    r = sources.usage_reports(report).first()
    assert (r.job, r.exit_status, r.service_units, r.memory_gb, r.wall_s, r.project) == ("12.x", 0, 1.5, 2.0, 3601, None)


def test_static_tables(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0), (4, 0.0)], "k int, v double")
    assert {r.k for r in rel.drifted(a, b, ["k"], ["v"]).collect()} == {3, 4}
    with pytest.raises(Exception, match="keys differ"):
        rel.align_exact(a, b.withColumnRenamed("v", "w"), ["k"]).collect()


# --- streams


def test_streams(spark, tmp_path):
    rows = [(datetime(2000, 1, 1 + d, 12), d % 2, float(d)) for d in range(8)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts timestamp, k int, v double").repartition(2).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, k int, v double").parquet(source)
    q = daily.daily_groups(stream, "ts", ["k"], "v").writeStream.outputMode("append").format("memory").queryName("groups").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.day.day: r.total for r in spark.sql("SELECT * FROM groups").collect()}
    assert got == {d + 1: float(d) for d in range(5)}  # later days can still change

    out = str(tmp_path / "out")
    for _ in range(2):
        prepare = lambda b: b.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
        daily.replace_groups(stream, out, str(tmp_path / "check"), "day", prepare).awaitTermination(60)
    assert spark.read.parquet(out).count() == 8

    history = spark.createDataFrame([(DAY + timedelta(i), 1, True) for i in range(20)], "time date, cell int, raw boolean")
    assert daily.settled(history, ["cell"], "time", "raw", DAY + timedelta(19)).agg(F.max("time")).first()[0] == DAY + timedelta(14)


def test_values_of_a_store(spark, tmp_path):
    df = spark.createDataFrame([("raw", "Tb", 1), ("raw", "Tc", 2), ("binary-days", "Tb", 3)], "method string, grid_type string, v int")
    sinks.by_kind(df, f"{tmp_path}/deep", "method", "grid_type")
    sinks.append(df, f"{tmp_path}/flat")
    for root in ("deep", "flat"):
        assert sources.values_of(spark, f"{tmp_path}/{root}", "method") == ["binary-days", "raw"]
        assert sources.values_of(spark, f"{tmp_path}/{root}", "grid_type") == ["Tb", "Tc"]


def test_thickness_rates_by_their_own_units(spark):
    made = spark.createDataFrame([(DAY, 1, 0.9, 1.0, 86.4, u, True) for u in ("cm/day", "m d-1")], "time date, cell int, aice double, hi double, dvidtt double, dvidtt_units string, fi boolean")
    have = set(made.columns)
    from nilas.plans.metrics import thickness_rate

    assert [r[0] for r in made.select(thickness_rate("dvidtt", have)).collect()] == pytest.approx([0.864, 86.4])
    assert [r[0] for r in made.select(thickness_rate("dvidtt", set())).collect()] == pytest.approx([0.864, 0.864])


def test_what_speaks_against_factors_and_forcing(spark, tmp_path):
    good = spark.createDataFrame([(j, i, 0.5, 0.0) for j in range(2) for i in range(3)], "nj int, ni int, ffx double, ffy double")
    assert sinks.factor_problems(good, shape=(3, 2)) == []
    assert len(sinks.factor_problems(good.drop("ffy"))) == 1
    odd = good.where("nj > 0 OR ni > 0").withColumn("ffx", F.lit(NAN)).withColumn("ffy", F.lit(-1.0))
    assert len(sinks.factor_problems(odd, shape=(2, 4))) == 4
    assert sinks.forcing(good, f"{tmp_path}/f", rows=6) and not sinks.forcing(good, f"{tmp_path}/f", rows=6)
    with pytest.raises(ValueError):
        sources.union_sources({"a": good, "b": good.where("ni < 2")}, ["ni"])
    with pytest.raises(FileNotFoundError):
        sinks.backup(spark, f"{tmp_path}/none")


def test_method_names():
    assert [config.method(m) for m in ("Daily", " bin ", "roll")] == ["raw", "binary-days", "rolling-mean"]
    assert config.threshold_tag(5e-4, 0) == "5e-4" and config.method_folder("bin", config.Classification()) == "bin-win-11_bin-min-09"
