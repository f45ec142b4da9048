"""The engine against hand-made answers, invariants, and unbinned joins."""

import math

import pytest
from pyspark.sql import functions as F

from spanway import LRS, EventFrame, bearing, constrain_to, direction, integrate, intersection_nodes, intersection_pairs, options
from spanway.errors import CompatibilityError, GeometrySyncError, SchemaError
from spanway.functions import lines as L
from spanway.functions.weights import PROFILES, decay_weights, profile_integral, resolve_profile, trapezoidal
from spanway.lrs import CLOSURES
from spanway.errors import MeasureError, TopologyError
from spanway.operators.spatial import clip, generate_intersections, hausdorff, mask_parts, match_samples, parallel_project, project, split
from spanway.operators.topology import add_chaining, generate_linear_events, is_contiguous, merge_lines

LIN = LRS(key_col=("k",), beg_col="b", end_col="e", closed="both")


def intervals(spark, rows, closed="both", names="k string, b double, e double", **more):
    data = [(i, *r) for i, r in enumerate(rows)]
    return EventFrame(spark.createDataFrame(data, f"id long, {names}"), LIN.set_params(closed=closed, **more), "id")


def points(spark, rows, names="k string, loc double"):
    return EventFrame(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, {names}"), LRS(key_col=("k",), loc_col="loc"), "id")


def column(df, name):
    return [r[name] for r in df.orderBy("_rid").select(name).collect()]


def pairs_of(df):
    return sorted((r[0], r[1]) for r in df.select("l_rid", "r_rid").collect())


@pytest.fixture(scope="module")
def agg(spark):
    left = intervals(spark, [("g1", 0.0, 10.0), ("g1", 10.0, 20.0), ("g2", 20.0, 30.0), ("g2", 30.0, 40.0)], "right")
    right = intervals(spark, [("g1", 5.0, 15.0, 10.0), ("g1", 15.0, 25.0, 20.0), ("g2", 25.0, 35.0, 30.0)], "right", "k string, b double, e double, v double")
    return left.relate(right)


def test_aggregates(agg):
    assert column(agg.count(), "count") == [1, 2, 1, 1]
    assert column(agg.count(axis=0), "count") == [2, 1, 2]
    assert column(agg.sum("v"), "v") == [5.0, 15.0, 15.0, 15.0]
    assert column(agg.mean("v"), "v") == [10.0, 15.0, 30.0, 30.0]
    assert column(agg["v"].first(), "v")[:3] == [10.0, 10.0, 30.0]
    assert column(agg["v"].last(), "v")[:3] == [10.0, 20.0, 30.0]
    assert column(agg["v"].single(-1), "v") == [10.0, 20.0, 30.0, 30.0]
    assert column(agg["v"].list(), "v") == [[10.0], [10.0, 20.0], [30.0], [30.0]]
    assert column(agg["v"].set(), "v")[1] == [10.0, 20.0]
    assert column(agg["v"].mode(), "v") == [10.0, 10.0, 30.0, 30.0]
    assert column(agg.T.count(), "count") == [2, 1, 2]
    assert len(agg.equal_groups().collect()) == 6


def test_overlay_and_conserve(spark, agg):
    raw = {(r.l_rid, r.r_rid): r.w for r in agg.overlay(normalize=False).collect()}
    assert raw == {(0, 0): 5, (1, 0): 5, (1, 1): 5, (2, 2): 5, (3, 2): 5}
    left, right = intervals(spark, [("a", 0.0, 10.0), ("a", 10.0, 15.0)]), intervals(spark, [("a", 0.0, 20.0, 100.0)], names="k string, b double, e double, v double")
    assert column(left.relate(right).sum("v"), "v") == [50.0, 25.0]
    assert column(left.relate(right).sum("v", conserve=True), "v") == pytest.approx([200 / 3, 100 / 3])
    plain, uniform = (sorted(r.w for r in agg.overlay(profile=p).collect()) for p in (None, "uniform"))
    assert plain == pytest.approx(uniform)


def test_nulls_make_sums_null(spark):
    left = intervals(spark, [("a", 0.0, 10.0), ("b", 0.0, 1.0)])
    right = intervals(spark, [("a", 0.0, 5.0, None), ("a", 5.0, 9.0, 1.0)], names="k string, b double, e double, v double")
    assert column(left.relate(right).sum("v"), "v") == [None, 0.0]
    assert column(left.relate(right).mean("v"), "v") == [None, None]


def test_distribute(spark):
    left = intervals(spark, [("a", 10.0 * i, 10.0 * i + 10) for i in range(5)])
    right = intervals(spark, [("a", 15.0, 25.0, 2.0, 5.0)], names="k string, b double, e double, u double, v double")
    out = left.relate(right).distribute(["u", "v"], decay="linear", size=1)
    assert column(out, "u") == pytest.approx([0.25, 0.75, 0.75, 0.25, 0])
    assert column(out, "v") == pytest.approx([0.625, 1.875, 1.875, 0.625, 0])
    two = intervals(spark, [("A", 0.0, 10.0), ("A", 10.0, 20.0), ("A", 20.0, 30.0), ("B", 0.0, 10.0), ("B", 10.0, 20.0)])
    src = intervals(spark, [("A", 5.0, 15.0, 1.0), ("B", 5.0, 15.0, 3.0)], names="k string, b double, e double, v double")
    assert column(two.relate(src).distribute("v"), "v") == pytest.approx([3 / 7, 3 / 7, 1 / 7, 1.5, 1.5])


def holds(closed, first, last):
    return closed in ("left", "left_mod", "both") or (closed == "right_mod" and first), closed in ("right", "right_mod", "both") or (closed == "left_mod" and last)


def flagged(rows, closed):
    out, order = {}, sorted(range(len(rows)), key=lambda i: (rows[i][1], rows[i][2], i))
    for n, i in enumerate(order):
        nxt = rows[order[n + 1]] if n + 1 < len(order) else None
        prv = rows[order[n - 1]] if n else None
        out[i] = holds(closed, prv is None or rows[i][1] > prv[2], nxt is None or nxt[1] > rows[i][2])
    return out


@pytest.mark.parametrize("lc", CLOSURES)
def test_binned_equals_brute_force(spark, lc):
    a = [("k", 0.0, 5.0), ("k", 5.0, 10.0), ("k", 5.0, 5.0), ("k", 12.0, 20.0), ("k", 3.0, 14.0), ("k", 10.0, 12.0), ("k", 0.0, 4000.0)]
    b = [("k", 5.0, 10.0), ("k", 10.0, 12.0), ("k", 20.0, 21.0), ("k", 0.0, 0.0), ("k", 5.0, 10.0), ("k", 11.0, 13.0)]
    for rc in CLOSURES:
        fa, fb = flagged(a, lc), flagged(b, rc)
        want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (x[2] > y[1] and x[1] < y[2]) or (x[1] == y[2] and fa[i][0] and fb[j][1]) or (x[2] == y[1] and fa[i][1] and fb[j][0]))
        rel = intervals(spark, a, lc).relate(intervals(spark, b, rc), width=4.0)
        assert pairs_of(rel.intersect()) == want, (lc, rc)
    # a row over too many bins takes the way by key alone
    assert pairs_of(intervals(spark, a, lc).relate(intervals(spark, b, "both")).intersect()) == pairs_of(intervals(spark, a, lc).relate(intervals(spark, b, "both"), 7.0).intersect())


def test_modified_closure_of_points(spark):
    rows = [("k", 0.0, 5.0), ("k", 5.0, 10.0)]
    p = points(spark, [("k", 0.0), ("k", 5.0), ("k", 10.0)])
    assert pairs_of(p.relate(intervals(spark, rows, "left_mod")).intersect()) == [(0, 0), (1, 1), (2, 1)]
    assert pairs_of(p.relate(intervals(spark, rows, "right_mod")).intersect()) == [(0, 0), (1, 0), (2, 1)]
    gap = intervals(spark, [("k", 0.0, 5.0), ("k", 6.0, 10.0)], "left_mod")
    assert pairs_of(points(spark, [("k", 5.0)]).relate(gap).intersect()) == [(0, 0)]
    assert pairs_of(points(spark, [("k", 5.0), ("k", 10.0), ("k", 15.0)]).relate(points(spark, [("k", 5.0), ("k", 12.0), ("k", 15.0)])).intersect()) == [(0, 0), (2, 2)]


@pytest.mark.parametrize(("fill", "want"), [("none", [(0, 4), (4, 8)]), ("cut", [(0, 4), (4, 8), (8, 10)]), ("left", [(0, 4), (4, 8), (6, 10)]), ("right", [(0, 4), (4, 8), (8, 12)]), ("extend", [(0, 4), (4, 10)]), ("balance", [(0, 4), (4, 8), (8, 10)])])
def test_resegment(spark, fill, want):
    made = intervals(spark, [("k", 0.0, 10.0)]).resegment(4, fill).df
    assert sorted((r.b, r.e) for r in made.collect()) == want


def test_resegment_short(spark):
    short = intervals(spark, [("k", 0.0, 3.0)])
    for fill, want in (("none", (0, 3)), ("extend", (0, 3)), ("cut", (0, 3)), ("left", (-1, 3)), ("right", (0, 4))):
        assert [(r.b, r.e) for r in short.resegment(4, fill).df.collect()] == [want]
    assert sorted((r.b, r.e) for r in intervals(spark, [("k", 0.0, 9.0)]).resegment(4, "balance").df.collect()) == [(0, 4), (4, 9)]


def test_dissolve(spark):
    f = intervals(spark, [("A", 0.0, 1.0, "x"), ("A", 1.0, 2.0, "x"), ("A", 2.0, 3.0, "y"), ("B", 0.0, 2.0, "z"), ("B", 2.0, 4.0, "z")], names="k string, b double, e double, s string")
    got = sorted((r.k, r.s, r.b, r.e, r.dissolved_index) for r in f.dissolve(["s"]).df.collect())
    assert got == [("A", "x", 0, 2, [0, 1]), ("A", "y", 2, 3, [2]), ("B", "z", 0, 4, [3, 4])]


@pytest.mark.parametrize(("method", "at"), [("balanced", 6.25), ("center", 6.25), ("left", 8.0), ("right", 5.0)])
def test_separate(spark, method, at):
    out = intervals(spark, [("k", 0.0, 8.0), ("k", 5.0, 12.0)]).separate(method=method).df
    assert column(out, "e")[0] == at and column(out, "b")[1] == at


def test_separate_eclipsed(spark):
    f = intervals(spark, [("k", 0.0, 10.0), ("k", 2.0, 5.0)])
    assert column(f.separate().df, "b")[1] == column(f.separate().df, "e")[1] == 3.5
    assert f.separate(drop_short=True).df.count() == 1


def test_find_inside_and_same(spark):
    f = intervals(spark, [("k", 0.0, 10.0), ("k", 2.0, 8.0), ("k", 5.0, 7.0), ("k", 1.0, 3.0)])
    assert column(f.find_inside(), "inside") == [False, True, True, True]
    assert column(intervals(spark, [("k", 0.0, 10.0), ("k", 0.0, 5.0)]).find_inside(False), "inside") == [False, False]
    assert column(intervals(spark, [("k", 0.0, 10.0), ("k", 0.0, 5.0)]).find_inside(), "inside") == [False, True]
    assert column(intervals(spark, [("k", 0.0, 10.0)] * 2).find_inside(), "inside") == [False, False]
    assert column(intervals(spark, [("k", 0.0, 10.0), ("k", 2.0, 12.0), ("k", 2.0, 8.0)]).find_inside(False), "inside") == [False, False, True]
    same = intervals(spark, [("k", 0.0, 3.0), ("k", 5.0, 8.0)] * 2)
    assert column(same.find_same("first"), "duplicated") == [False, False, True, True]
    assert column(same.find_same("last"), "duplicated") == [True, True, False, False]
    assert column(same.find_same("none"), "duplicated") == [True] * 4


def test_cluster(spark):
    p = points(spark, [("A", 1.0), ("A", 1.01), ("A", 5.0), ("A", 5.005)])
    assert column(p.cluster(0.02).df, "cluster") == [0, 0, 1, 1]
    assert column(points(spark, [("A", 1.0), ("A", 1.0), ("A", 2.0)]).cluster().df, "cluster") == [0, 0, 1]
    assert column(points(spark, [("A", 0.0), ("A", 1.5)]).cluster(1.0).df, "cluster") == [0, 0]
    touch = intervals(spark, [("A", 0.0, 1.0), ("A", 1.0, 2.0)])
    assert column(touch.cluster(enforce_edges=True).df, "cluster") == [0, 0]
    assert column(touch.cluster().df, "cluster") == [0, 1]
    linked = points(spark, [("A", 1.0, 10), ("A", 5.0, None), ("B", 1.0, 10), ("B", 5.0, None)], "k string, loc double, i int")
    assert column(linked.cluster(0.02, link_col="i").df, "cluster") == [0, 1, 0, 2]
    with pytest.raises(SchemaError):
        p.cluster(enforce_edges=True)
    chain = intervals(spark, [("A", float(i), i + 1.5) for i in range(12)])
    assert len(set(column(chain.relate(chain).components(), "label"))) == 1


def test_integrate(spark):
    a, b = intervals(spark, [("k", 0.0, 5.0)]), intervals(spark, [("k", 7.0, 10.0)])
    assert sorted((r.beg, r.end) for r in integrate([a, b]).collect()) == [(0, 5), (7, 10)]
    assert integrate([a, b], fill_gaps=True).count() == 3
    x, y = intervals(spark, [("k", 0.0, 10.0), ("k", 5.0, 15.0)]), intervals(spark, [("k", 0.0, 20.0)])
    twice = [r for r in integrate([x, y], expand=True).collect() if (r.beg, r.end) == (5, 10)]
    assert sorted(r.integrated_index_0 for r in twice) == [0, 1]
    locs = integrate([intervals(spark, [("k", 0.0, 5.0), ("k", 5.0, 10.0)]), points(spark, [("k", 3.0), ("k", 7.0)])], split_at_locs=True)
    assert sorted(r.beg for r in locs.collect()) == [0, 3, 5, 7]


def test_constrain(spark):
    f = intervals(spark, [("A", 3.0, 10.0, "x")], names="k string, b double, e double, s string")
    got = constrain_to(f, intervals(spark, [("A", 0.0, 5.0), ("A", 8.0, 12.0)])).df
    assert sorted((r.b, r.e, r.s) for r in got.collect()) == [(3, 5, "x"), (8, 10, "x")]
    g, bounds = intervals(spark, [("A", 3.0, 7.0)]), intervals(spark, [("A", 0.0, 5.0), ("A", 5.0, 10.0)])
    assert [(r.b, r.e) for r in constrain_to(g, bounds).df.collect()] == [(3, 7)]
    assert sorted((r.b, r.e) for r in constrain_to(g, bounds, dissolve=False).df.collect()) == [(3, 5), (5, 7)]


def test_profiles_and_decay(spark):
    row = spark.range(1).select(*[profile_integral(n, F.lit(0.0), F.lit(0.25)).alias(n) for n in PROFILES], *[profile_integral(n, F.lit(0.0), F.lit(1.0)).alias(f"{n}1") for n in PROFILES]).first()
    assert row.uniform == 0.25 and row.triangular == 0.125 and row.parabolic == 0.15625 and row.trapezoidal == pytest.approx(1 / 6)
    assert all(row[f"{n}1"] == pytest.approx(1) for n in PROFILES)
    assert [round(decay_weights(n, 2)[1], 5) for n in ("linear", "exponential", "gaussian", "flat")] == [0.66667, 0.18888, 0.32465, 1.0]
    assert decay_weights(lambda k, n: 1 / (k + 1), 1) == [1.0, 0.5]
    with pytest.raises(ValueError):
        resolve_profile("no")
    with pytest.raises(ValueError):
        trapezoidal(0.6)


def line(spark, vertices):
    return spark.createDataFrame([([tuple(map(float, v)) for v in vertices],)], f"g {L.LINE_M}")


def test_lines(spark):
    m = line(spark, [(0, 0, 0), (1, 0, 10), (2, 0, 20), (3, 0, 30)])
    assert [m.select(L.m_to_distance(F.col("g"), F.lit(x))).first()[0] for x in (5.0, 15.0, 25.0, -1.0, 99.0)] == [0.5, 1.5, 2.5, 0.0, 3.0]
    assert m.select(L.m_to_distance(F.col("g"), F.lit(99.0), snap=False)).first()[0] is None
    assert [m.select(L.distance_to_m(F.col("g"), F.lit(x))).first()[0] for x in (0.5, 2.0, 9.0)] == [5.0, 20.0, 30.0]
    uneven = line(spark, [(0, 0, 0), (1, 0, 5), (2, 0, 25)])
    assert [uneven.select(L.m_to_distance(F.col("g"), F.lit(x))).first()[0] for x in (2.5, 15.0)] == [0.5, 1.5]
    part = m.select(L.cut(F.col("g"), F.lit(5.0), F.lit(25.0)).alias("c")).first().c
    assert [(p.x, p.m) for p in part] == [(0.5, 5), (1, 10), (2, 20), (2.5, 25)]
    assert m.select(L.cut(F.col("g"), F.lit(25.0), F.lit(5.0))).first()[0] is None
    assert m.select(L.to_wkt(F.col("g"))).first()[0] == "LINESTRING M (0.0 0.0 0.0, 1.0 0.0 10.0, 2.0 0.0 20.0, 3.0 0.0 30.0)"
    back = m.select(L.parse_wkt(F.concat(L.to_wkt(F.col("g")), F.lit(" # note"))).alias("g")).first().g
    assert [tuple(p) for p in back] == [(0, 0, 0), (1, 0, 10), (2, 0, 20), (3, 0, 30)]
    made = m.select(L.with_m(F.col("g"), F.lit(100.0), F.lit(160.0)).alias("g")).first().g
    assert [p.m for p in made] == [100, 120, 140, 160]
    got = m.select(L.nearest(F.col("g"), F.lit(1.5), F.lit(2.0)).alias("n"), L.proportions(F.col("g")).alias("p"), L.is_monotonic(F.col("g")).alias("ok"), bearing("g").alias("b"), direction("g").alias("d")).first()
    assert (got.n.d, got.n.m, got.ok, got.b, got.d) == (2.0, 15.0, True, 0.0, "E") and got.p == pytest.approx([1 / 3] * 3)
    assert line(spark, [(0, 0, 0), (0, 2, 1)]).select(direction("g")).first()[0] == "N"


def geometry(spark, rows, **lrs):
    data = [(i, k, [tuple(map(float, v)) for v in g]) for i, (k, g) in enumerate(rows)]
    df = spark.createDataFrame(data, f"id long, k string, g {L.LINE_M}")
    return EventFrame(df, LRS(key_col=("k",), geom_m_col="g", **lrs), "id")


def test_intersections(spark):
    f = geometry(spark, [("A", [(0, 0, 0), (10, 0, 10)]), ("A", [(10, 0, 10), (20, 0, 20)]), ("B", [(5, -5, 0), (5, 5, 10)]), ("B", [(15, -5, 0), (15, 5, 10)])])
    assert intersection_pairs(f, False, True, False).count() == 1
    assert intersection_pairs(f, False, False, True).count() == 2
    assert intersection_pairs(f, False).count() == 3
    assert intersection_pairs(f).count() == 2
    assert sorted((r.x, r.y, r.rids) for r in intersection_nodes(f).collect()) == [(5.0, 0.0, [0, 2]), (15.0, 0.0, [1, 3])]


def test_intersections_of_great_routes(spark, tmp_path):
    """Upright lines reach every axis, however great its route."""
    from spanway.queries import QUERIES

    routes = [0, 7, 14_999, 15_001, 40_000, 300_000]
    spark.createDataFrame([(r,) for r in routes], "l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, QUERIES["intersections"](spark, str(tmp_path)).collect()))
    assert got == sorted((r, 1_000_000 + k, True) for r in routes for k in range(1, 27))


def test_split_clip_project(spark):
    f = geometry(spark, [("A", [(0, 0, 0), (5, 0, 5)]), ("A", [(5, 0, 5), (10, 0, 10)]), ("A", [(10, 0, 10), (15, 0, 15)])])
    f = f.extract_m_values("b", "e")
    box = [(3, -1), (12, -1), (12, 1), (3, 1)]
    assert sorted({v for r in split(f, box).df.collect() for v in (r.b, r.e)}) == [0, 3, 5, 10, 12, 15]
    assert sorted((r.b, r.e) for r in clip(f, box).df.collect()) == [(3, 5), (5, 10), (10, 12)]
    assert sorted((r.b, r.e) for r in clip(f, box, "outside").df.collect()) == [(0, 3), (12, 15)]
    p = spark.createDataFrame([(0, 4.0, 1.0), (1, 400.0, 1.0), (2, 12.0, -2.0)], "_rid long, x double, y double")
    got = {r._rid: (r.line_rid, r.loc, r.distance) for r in project(p, "x", "y", f, buffer=5.0).collect()}
    assert got == {0: (0, 4.0, 1.0), 1: (None, None, None), 2: (2, 12.0, 2.0)}
    near = geometry(spark, [("z", [(1, 1, 0), (4, 1, 3)])])
    best = parallel_project(near, f, buffer=3.0).collect()
    assert [(r.line_rid, r.beg, r.end, r.distance) for r in best] == [(0, 1.0, 4.0, 1.0)]
    assert [(r.line_rid, r.n) for r in match_samples(near, f, buffer=3.0).collect()] == [(0, 3)]
    import numpy as np

    assert hausdorff(np.array([[0, 0], [1, 0]]), np.array([[0, 2], [1, 2]]), 0.1) == 2


def test_project_nearest_brute_force(spark):
    """Points inside segments, at distances, tied, on shared ends and without a line in the buffer."""
    shapes = [[(0, 0, 0), (30, 1, 30), (60, -2, 60)], [(0, 4, 0), (60, 4, 60)], [(60, -2, 5), (90, -2, 35)], [(0, -4, 0), (60, -4, 60)], [(70, 9, 0), (70, 9, 1)]]
    f = geometry(spark, [("A", g) for g in shapes])
    spots = [(x * 3.5 - 8, y * 0.75 - 12) for x in range(30) for y in range(34)] + [(60.0, -2.0), (40.0, 0.0), (70.0, 9.0), (65.0, 13.0)]

    def nearest(x, y):
        found = []
        for k, g in enumerate(shapes):
            for i, ((ax, ay, am), (bx, by, bm)) in enumerate(zip(g, g[1:], strict=False)):
                w = (bx - ax) ** 2 + (by - ay) ** 2
                t = min(max(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / w, 0.0), 1.0) if w else 0.0
                found.append((math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)), k, i, am + t * (bm - am)))
        return min(found) if min(found)[0] <= 5 else (None, None, None, None)

    p = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(spots)], "_rid long, x double, y double")
    rows = project(p, "x", "y", f, buffer=5.0).collect()
    assert len(rows) == len(spots) and {r.line_rid for r in rows} == {None, 0, 1, 2, 3, 4}
    for r in rows:
        far, line_rid, _, loc = nearest(*spots[r._rid])
        assert r.line_rid == line_rid and (r.distance, r.loc) == (pytest.approx(far), pytest.approx(loc))


def test_project_nearest_line_query(spark):
    """The whole table, against its SQL."""
    import duckdb

    from spanway.queries import ORACLE, QUERIES

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("orders", "lineitem", "supplier", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    want = sorted(con.execute(ORACLE["project_nearest_line"]).fetchall(), key=lambda r: r[0])
    got = sorted(map(tuple, QUERIES["project_nearest_line"](spark, d).collect()), key=lambda r: r[0])
    assert len(got) == len(want) == spark.read.parquet(f"{d}/orders.parquet").count() and got == want
    assert any(r[1] is None for r in got) and any(r[3] and r[3] > 0.1 for r in got)


def test_topology(spark):
    f = geometry(spark, [("A", [(1, 0, 1), (2, 0, 2)]), ("A", [(0, 0, 0), (1, 0, 1)]), ("B", [(0, 0, 0), (1, 0, 1)]), ("B", [(5, 0, 5), (6, 0, 6)])])
    chained = add_chaining(f)
    assert column(chained.df, "chain")[:2] == [0, 0] and sorted(column(chained.df, "chain")[2:]) == [0, 1]
    assert not is_contiguous(f) and is_contiguous(f.select_group("A"))
    merged = {(r.k, r.chain): len(r.line) for r in merge_lines(f).collect()}
    assert merged == {("A", 0): 3, ("B", 0): 2, ("B", 1): 2}
    out = generate_linear_events(f).df
    assert sorted((r.k, r.beg, r.end) for r in out.collect()) == [("A", 0, 1), ("A", 1, 2), ("B", 0, 1), ("B", 1, 2)]


def test_schema(spark):
    lrs = LRS(key_col="k", loc_col="loc")
    assert lrs.is_point and lrs.add_key("z").key_col == ("k", "z") and lrs.remove_key("k").key_col == ()
    with pytest.raises(KeyError):
        lrs.remove_key("q")
    with pytest.raises(SchemaError):
        lrs.set_closed("left")
    with pytest.raises(ValueError):
        LRS(closed="no")
    f = points(spark, [("a", 1.0), ("a", None), (None, 2.0), ("b", float("nan"))])
    assert f.drop_invalid().df.count() == 1 and f.invalid().df.count() == 3
    assert f.study()["located"]["valid"] and not f.study()["linear"]["valid"] and "LC" in repr(f)
    assert [r.loc for r in f.select_slice(0, 1).df.collect()] == [1.0]
    assert f.get_group("a").count() == 2 and f.drop_group("a").df.count() == 1 and f.select([0]).df.count() == 1
    with pytest.raises(ValueError):
        options.geometry_sync = "maybe"
    other = EventFrame(spark.createDataFrame([(1, 1.0)], "k long, loc double"), LRS(key_col=("k",), loc_col="loc"))
    with pytest.raises(CompatibilityError):
        f.relate(other)


def test_transforms(spark):
    p = points(spark, [("a", 2.5)])
    assert [(r.beg, r.end) for r in p.extend((1.0, 2.0)).df.collect()] == [(1.5, 4.5)]
    assert [r.loc for r in p.round().df.collect()] == [2.0] and [r.loc for r in p.shift(1).df.collect()] == [3.5]
    assert "loc" not in p.point_to_linear(drop_loc=True).df.columns
    f = geometry(spark, [("A", [(0, 0, 0), (5, 0, 5)])]).extract_m_values("b", "e")
    assert "g" not in f.shift(1).df.columns and "g" in f.shift(1, geometry_sync="none").df.columns
    with pytest.raises(GeometrySyncError):
        f.shift(1, geometry_sync="error")
    assert len(f.resegment(2.0).df.first().g) == 2
    swapped = intervals(spark, [("k", 5.0, 1.0)])
    assert not swapped.is_monotonic() and swapped.set_monotonic().is_monotonic()
    ll = swapped.set_monotonic()
    assert ll.concatenate(ll).df.count() == 2
    total = intervals(spark, [("k", 0.0, 7.3), ("k", 7.3, 9.0)])
    assert math.isclose(sum(r.e - r.b for r in total.resegment(1.0).df.collect()), 9.0)


def test_streams(spark, tmp_path):
    from spanway.streaming.relate import relate_stream, session_runs

    src = str(tmp_path / "in")
    spark.createDataFrame([("k", 1.0), ("k", 5.0), ("k", 30.0)], "k string, loc double").write.parquet(src)
    stream = spark.readStream.schema("k string, loc double").parquet(src)
    out = relate_stream(stream, intervals(spark, [("k", 0.0, 5.0), ("k", 5.0, 10.0)], "left"), "loc", ["k"], 4.0)
    q = out.writeStream.format("memory").queryName("met").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.loc, r.segment_rid) for r in spark.table("met").collect()) == [(1.0, 0), (5.0, 1)]
    batch = session_runs(spark.sql("select 'a' as k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,x) as ts from values (0),(1),(9) t(x)"), "ts", ["k"], "5 minutes", "1 hour")
    assert sorted(r.n for r in batch.collect()) == [1, 2]


CLASHING = ["w", "t", "s", "order", "_n", "_o", "_w", "v", "l_beg", "r_rid", "count", "sum", "len", "pos"]


def test_values_of_any_name(spark):
    names = "k string, b double, e double, " + ", ".join(f"{c} double" for c in CLASHING)
    left = intervals(spark, [("a", 0.0, 4.0), ("a", 9.0, 10.0)], "left")
    right = intervals(spark, [("a", 0.0, 2.0, *[1.0 + i for i in range(len(CLASHING))]), ("a", 2.0, 4.0, *[3.0 + i for i in range(len(CLASHING))])], "left", names)
    r = left.relate(right)
    for i, c in enumerate(CLASHING):
        assert column(r.sum(c), c) == [4.0 + 2 * i, 0.0] and column(r.mean(c), c) == [2.0 + i, None]
        assert column(r.first(c), c) == [1.0 + i, None] and column(r.mode(c), c) == [1.0 + i, None]
        assert column(r.list(c), c) == [[1.0 + i, 3.0 + i], []]
    assert column(r.distribute("len"), "len") and r.value_counts("w").columns == ["_rid", "1.0", "3.0"]
    named = left._with(left.df.withColumn("cluster", F.lit("old")))
    assert [c for c in named.cluster().df.columns if c == "cluster"] == ["cluster"]
    with pytest.raises(ValueError):
        left.cluster(-1.0)


def test_long_and_infinite_rows(spark):
    inf = float("inf")
    a = intervals(spark, [("a", 0.0, 1.0), ("a", -inf, inf), ("a", 5.0, inf), ("a", 0.0, 1e7), ("b", -inf, 0.0)], "left")
    b = intervals(spark, [("a", float(k), float(k) + 1) for k in range(40)] + [("a", 100.0, 1e6), ("b", -1.0, 1.0)], "left")
    ra, rb = ([r for r in f.df.select("_rid", "k", "b", "e").collect()] for f in (a, b))
    want = sorted((x[0], y[0]) for x in ra for y in rb if x[1] == y[1] and x[3] > y[2] and x[2] < y[3])
    for width in (None, 1.0, 50.0):
        assert pairs_of(a.relate(b, width).intersect()) == want
    free = a._with(a.df, a.lrs.set_params(key_col=()))
    other = b._with(b.df, b.lrs.set_params(key_col=()))
    assert pairs_of(free.relate(other).intersect()) == sorted((x[0], y[0]) for x in ra for y in rb if x[3] > y[2] and x[2] < y[3])
    assert free.relate(other).equal_groups().count() == len(ra) * len(rb)


def vertices(*points):
    return [dict(zip("xym", map(float, p), strict=True)) for p in points]


def measured(spark, rows, closed="left"):
    schema = "id long, k string, b double, e double, geom_m array<struct<x:double,y:double,m:double>>"
    data = [(i, k, g[0]["m"], g[-1]["m"], g) for i, (k, g) in enumerate(rows)]
    return EventFrame(spark.createDataFrame(data, schema), LIN.set_params(closed=closed, geom_m_col="geom_m"), "id")


def test_several_lines(spark):
    one, two = vertices((0, 0, 0), (4, 0, 4)), vertices((4, 0, 4), (4, 4, 8))
    rows = measured(spark, [("a", one), ("a", two)])
    wide = intervals(spark, [("a", 2.0, 6.0), ("a", 0.0, 1.0), ("b", 0.0, 1.0)], "left")
    flat = lambda g: None if g is None else [(p.x, p.y, p.m) for p in g]
    cut = lambda how: [flat(g) for g in column(wide.cut_from(rows, multiple=how), "geom_m")]
    assert cut("first") == [[(2, 0, 2), (4, 0, 4)], [(0, 0, 0), (1, 0, 1)], None]
    assert cut("last")[0] == [(4, 0, 4), (4, 2, 6)]
    assert cut("merge")[0] == [(2, 0, 2), (4, 0, 4), (4, 2, 6)] and cut("merge")[2] is None
    assert [len(x) for x in column(wide.cut_from(rows, multiple="list"), "geom_m")] == [2, 1, 0]
    with pytest.raises(Exception, match="several lines"):
        wide.cut_from(rows, multiple="raise").collect()
    with pytest.raises(ValueError):
        wide.cut_from(rows, multiple="some")
    assert flat(column(wide.relate(rows).line_merge_m("geom_m"), "geom_m")[0]) == [(0, 0, 0), (4, 0, 4), (4, 4, 8)]
    spots = points(spark, [("a", 1.0), ("a", 5.0)])
    assert [(p.x, p.y) for p in column(spots.interpolate_from(rows), "point")] == [(1, 0), (4, 1)]
    assert [len(p) for p in column(spots.interpolate_from(rows, multiple="list"), "point")] == [1, 1]
    merged = rows.dissolve()
    assert flat(merged.df.first()["geom_m"]) == [(0, 0, 0), (4, 0, 4), (4, 4, 8)]
    assert "geom_m" not in rows.dissolve(merge_geom=False).df.columns
    apart = measured(spark, [("a", one), ("a", vertices((9, 9, 4), (9, 9, 8)))])
    with pytest.raises(Exception, match="follow"):
        apart.dissolve().df.collect()
    with pytest.raises(SchemaError):
        wide.dissolve(merge_geom=True)
    part = constrain_to(rows, intervals(spark, [("a", 1.0, 5.0)], "left"), cut_geom=True)
    assert sorted(flat(r.geom_m) for r in part.df.collect()) == [[(1, 0, 1), (4, 0, 4)], [(4, 0, 4), (4, 1, 5)]]


def test_generated_intersections(spark):
    a = [("a", vertices((0, 0, 0), (5, 0, 5))), ("a", vertices((5, 0, 5), (10, 0, 10)))]
    b = [("b", vertices((3, -3, 100), (3, 3, 106)))]
    f = measured(spark, a + b)
    got = sorted((r.k, r.loc, r.x, r.y) for r in generate_intersections(f).collect())
    assert got == [("a", 3.0, 3.0, 0.0), ("b", 103.0, 3.0, 0.0)]
    assert generate_intersections(f, expand=False).count() == 1
    assert generate_intersections(f, project_nodes=False).columns == ["x", "y", "rids"]
    # lines of one key meet too, if asked for
    assert generate_intersections(f, exclude_groups=False, project_nodes=False).count() == 2


def test_masks(spark):
    f = measured(spark, [("a", vertices((0, 0, 0), (10, 0, 10)))])
    square = lambda a, b: [(a, -1), (b, -1), (b, 1), (a, 1), (a, -1)]
    holed = {"type": "Polygon", "coordinates": [square(1, 9), square(4, 6)]}
    spans = lambda g: sorted((r.b, r.e) for r in g.df.collect())
    assert spans(split(f, holed)) == [(0, 1), (1, 4), (4, 6), (6, 9), (9, 10)]
    assert spans(clip(f, holed)) == [(1, 4), (6, 9)] and spans(clip(f, holed, "outside")) == [(0, 1), (4, 6), (9, 10)]
    assert spans(clip(f, [holed, {"type": "Polygon", "coordinates": [square(4, 5)]}])) == [(1, 4), (4, 5), (6, 9)]
    assert spans(split(f, {"type": "LineString", "coordinates": [(2, -1), (2, 1)]})) == [(0, 2), (2, 10)]
    assert spans(split(f, {"type": "MultiPoint", "coordinates": [(7, 0), (8, 3)]})) == [(0, 7), (7, 10)]
    edge = {"type": "Polygon", "coordinates": [[(2, 0), (5, 0), (5, 4), (2, 4), (2, 0)]]}  # a side along the line
    assert spans(clip(f, edge)) == [(2, 5)] and spans(clip(f, edge, predicate="within")) == []
    assert "geom_m" in clip(f, holed).df.columns and "geom_m" not in clip(f, holed, cut_geom=False).df.columns
    assert mask_parts({"type": "GeometryCollection", "geometries": [holed, {"type": "Point", "coordinates": (1, 2)}]})[2] == [(1.0, 2.0)]
    for wrong in ({"type": "Circle", "coordinates": []}, [], 3):
        with pytest.raises(TypeError):
            split(f, wrong)
    with pytest.raises(TypeError):
        clip(f, {"type": "Point", "coordinates": (1, 2)})


def test_impute_options(spark):
    zones = EventFrame(spark.createDataFrame([(0, "a", "z1", 0.0, 5.0), (1, "a", "z2", 3.0, 9.0)], "id long, k string, zone string, b double, e double"), LIN.set_params(key_col=("k", "zone")), "id")
    spots = points(spark, [("a", 1.0), ("a", 4.0), ("a", 50.0)])
    values = lambda **how: column(zones.impute_keys(spots, **how).df, "zone")
    assert values(missing="ignore") == ["z1", "z1", None] and values(func="last", missing="ignore") == ["z1", "z2", None]
    assert values(fillna="none", missing="raise") == ["z1", "z1", "none"]
    with pytest.warns(UserWarning):
        values()
    with pytest.raises(ValueError):
        values(missing="raise")
    with pytest.raises(KeyError):
        values(keys=["other"])


def test_project_options(spark):
    f = measured(spark, [("a", vertices((0, 0, 0), (10, 0, 10)))])
    spots = spark.createDataFrame([(1, 2.0, 1.0), (2, 50.0, 50.0)], "id long, x double, y double")
    assert project(spots, "x", "y", f, 5.0, dropna=True, distance_col="far").columns == ["id", "x", "y", "line_rid", "loc", "far"]
    assert project(spots, "x", "y", f, 5.0, dropna=True).count() == 1 and project(spots, "x", "y", f, 5.0).count() == 2
    again = project(spots, "x", "y", f, 5.0)
    with pytest.raises(ValueError):
        project(again, "x", "y", f, 5.0)
    assert project(again, "x", "y", f, 5.0, replace=True).columns == again.columns


def test_generate_options(spark):
    f = measured(spark, [("a", vertices((0, 0, 0), (3, 4, 1))), ("a", vertices((3, 4, 0), (3, 9, 1))), ("b", vertices((0, 0, 0), (1, 0, 1))), ("b", vertices((5, 0, 0), (6, 0, 1)))])
    plain = f._with(f.df.drop("b", "e"), f.lrs.set_params(beg_col=None, end_col=None, geom_m_col=None, geom_col="geom_m"))
    made = generate_linear_events(plain, add_geom_m=True, geom_m_col="made", add_chain=False)
    assert "chain" not in made.df.columns and column(made.df, "end") == [5.0, 10.0, 1.0, 2.0]
    assert column(made.df.select("_rid", L.last_m(F.col("made")).alias("m")), "m") == [5.0, 10.0, 1.0, 2.0]
    with pytest.raises(TopologyError):
        generate_linear_events(plain, allow_disjoint=False)
    with pytest.raises(ValueError):
        generate_linear_events(made, replace=False)


def test_measured_lines_rise(spark):
    good, falls, bad = vertices((0, 0, 0), (1, 0, 1)), vertices((0, 0, 5), (1, 0, 2)), vertices((0, 0, 0), (1, 0, 3), (2, 0, 1))
    turned = measured(spark, [("a", good), ("a", falls)]).require_measured()
    assert column(turned.df.select("_rid", L.first_m(F.col("geom_m")).alias("m")), "m") == [0.0, 2.0]
    for rows, turn in (([("a", bad)], True), ([("a", falls)], False)):
        with pytest.raises(MeasureError):
            measured(spark, rows).require_measured(turn)
    line = spark.range(1).select(L.from_bounds(F.lit(0), F.lit(0), F.lit(4), F.lit(3), F.lit(10), F.lit(20)).alias("g"))
    assert line.select(L.m_to_norm_distance(F.col("g"), F.lit(15.0))).first()[0] == 0.5


def test_neighbours_strings(spark):
    f = intervals(spark, [("a", 0.0, 2.0), ("a", 2.0, 3.0), ("a", 5.0, 6.0), ("b", 0.0, 2.0), ("b", 1.0, 3.0)])
    out = f.neighbours()
    assert column(out, "string") == [0, 0, 1, 2, 3] and column(out, "next_overlapping") == [False, False, False, True, False]
    assert column(f.neighbours(enforce_edges=True), "next_overlapping") == [True, False, False, True, False]


def test_datasets(spark):
    from spanway.sources.tables import list_datasets, load_dataset

    assert "seg" in list_datasets() and load_dataset(spark, "seg", "/root/testdata/sf0.001").is_linear
    with pytest.raises(ValueError):
        load_dataset(spark, "none", "/root/testdata/sf0.001")


def test_distances_along_long_lines(spark):
    sizes = (1, 2, 128, 129, 130, 1000)
    lines = spark.createDataFrame([(n, [{"x": float(i), "y": float(i % 2), "m": 0.0} for i in range(n)]) for n in sizes], "n int, g array<struct<x:double,y:double,m:double>>")
    for r in lines.select("n", L.cumulative(F.col("g")).alias("c")).collect():
        assert r.c == pytest.approx([i * math.sqrt(2) for i in range(r.n)])
