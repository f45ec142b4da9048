"""Steps that must grow with their input: what meets, what is shuffled, how rows are dealt out."""

import re

import pytest
from pyspark.sql import functions as F

from spanway import LRS, EventFrame, intersection_nodes, intersection_pairs
from spanway.operators import spatial

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def roads(spark, rows):
    """Lines of two vertices: (id, key, x0, y0, x1, y1)."""
    df = spark.createDataFrame(rows, "id long, k string, x0 double, y0 double, x1 double, y1 double")
    vertex = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return EventFrame(df.select("id", "k", F.array(vertex("x0", "y0"), vertex("x1", "y1")).alias("g")), LRS(key_col=("k",), geom_col="g"), "id")


def test_rows_of_a_key_do_not_meet_in_a_cell(spark):
    rows = [(i, "flat", 0.0, float(i), 10.0, float(i)) for i in range(40)] + [(100, "up", 5.0, -1.0, 5.0, 50.0), (101, None, 6.0, -1.0, 6.0, 50.0), (102, None, -1.0, 3.5, 9.0, 3.5)]
    f = roads(spark, rows)
    want = sorted([(i, up) for i in range(40) for up in (100, 101)] + [(100, 102)])
    found = intersection_pairs(f, size=100.0)
    assert sorted((r.l_rid, r.r_rid) for r in found.collect()) == want
    assert "r__g" in plan(found)  # keys are part of the join


def test_nodes_of_different_keys(spark):
    f = roads(spark, [(i, "flat", 0.0, float(i), 10.0, float(i)) for i in range(5)] + [(9, "up", 5.0, -1.0, 5.0, 3.5)])
    found = intersection_nodes(f, size=100.0)
    assert sorted((r.x, r.y, r.rids) for r in found.collect()) == [(5.0, float(i), [i, 9]) for i in range(4)]
    assert "r__g" in plan(found)


def table(spark, rows, names, **lrs):
    return EventFrame(spark.createDataFrame(rows, f"id long, k string, {names}"), LRS(key_col=("k",), **lrs), "id")


def shuffles(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[: text.find("== Initial Plan ==")].count("Exchange hashpartitioning") if "== Initial Plan ==" in text else text.count("Exchange hashpartitioning")


def test_equal_groups_by_keys_shuffle_rows_only(spark):
    a = table(spark, [(i, "ab"[i % 2], 0.0, 1.0) for i in range(20)], "b double, e double", beg_col="b", end_col="e")
    p = table(spark, [(i, "ac"[i % 2], 0.0) for i in range(10)], "loc double", loc_col="loc")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = a.relate(p).equal_groups(keep_keys=True).groupBy("k").agg(F.count("*").alias("n"), F.sum("r_rid").alias("ids"))
        assert [tuple(r) for r in found.collect()] == [("a", 50, 200)]
        assert shuffles(found) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_interpolation_shuffles_points_and_no_lines(spark):
    rows = spark.createDataFrame([(7, "a", 0.0, 10.0), (8, "a", 0.0, 10.0), (9, "b", 0.0, 10.0)], "id long, k string, b double, e double")
    vertex = lambda i, y: F.struct((F.lit(i) * 1.0).alias("x"), F.lit(y).alias("y"), F.lit(i * 1.0).alias("m"))
    g = F.when(F.col("id") != 9, F.array(vertex(0, 0.0), vertex(10, 5.0)))  # b's line is null
    f = EventFrame(rows.withColumn("g", g), LRS(key_col=("k",), beg_col="b", end_col="e", geom_m_col="g", closed="both"), "id")
    p = table(spark, [(0, "a", 4.0), (1, "b", 4.0), (2, "c", 4.0), (3, "a", None)], "loc double", loc_col="loc")
    found = p.interpolate_from(f)
    assert [(r["_rid"], r.point and (r.point.x, r.point.y)) for r in found.orderBy("_rid").collect()] == [(0, (4.0, 2.0)), (1, None), (2, None), (3, None)]
    several = {r["_rid"]: r.point for r in p.interpolate_from(f, multiple="list").collect()}
    assert [len(several[i]) for i in range(4)] == [2, 1, 0, 0] and several[1] == [None]
    below = plan(found).split("Union", 1)[1]
    assert "zip_with" in below.split("Join", 1)[0]  # the point is made above the join, below the grouping


def test_a_segment_comes_to_a_cell_once_and_to_few(spark):
    seg = spark.createDataFrame([(0, 0.0, 0.0, 30.0, 1.0), (1, -7.0, 3.0, 22.0, -40.0), (2, 5.0, 5.0, 5.0, 5.0), (3, 100.0, 0.0, -100.0, 0.0)], "id long, ax double, ay double, bx double, by double")
    for size, margin in ((5.0, 5.0), (10.0, 2.0), (7.0, 0.0), (300.0, 1.0)):
        cells = [(r.id, r._cx, r._cy) for r in spatial._cells(seg, size, margin).select("id", "_cx", "_cy").collect()]
        assert len(cells) == len(set(cells))
        # every place of the segment, moved by the margin, is in one of its cells
        for r in seg.collect():
            for n in range(201):
                x, y = r.ax + (r.bx - r.ax) * n / 200, r.ay + (r.by - r.ay) * n / 200
                for dx, dy in ((0, 0), (margin, margin), (-margin, margin), (margin, -margin), (-margin, -margin)):
                    assert (r.id, (x + dx) // size, (y + dy) // size) in set(cells)


@pytest.mark.parametrize("closed", ["left", "both", "neither", "right", "left_mod"])
def test_components_are_islands(spark, closed):
    inf, nan = float("inf"), float("nan")
    rows = [(0, "a", 0.0, 10.0), (1, "a", 10.0, 10.0), (2, "a", 10.0, 12.0), (3, "a", 5.0, 5.0), (4, "a", 6.0, 8.0), (5, "a", 12.0, 12.0), (6, "a", 12.0, 12.0), (7, "a", 30.0, 20.0), (8, "a", 25.0, 26.0),
            (9, "a", None, 5.0), (10, None, 0.0, 5.0), (11, "b", 0.0, 5.0), (12, "b", 4.0, inf), (13, "b", 90.0, 91.0), (14, "a", nan, 4.0), (15, "b", -inf, -3.0), (16, "a", 25.5, 28.0), (17, "a", 0.0, 0.0)]
    f = table(spark, rows, "b double, e double", beg_col="b", end_col="e", closed=closed)
    edges = [(r.l_rid, r.r_rid) for r in f.relate(f).intersect().collect()]
    label = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = f.relate(f).components()
    assert {r["_rid"]: r.label for r in found.collect()} == label
    assert found.count() == len(rows)
    assert ("Window" in plan(found)) == (closed != "left_mod")  # without pairs, but where neighbours decide


def test_components_of_points(spark):
    p = table(spark, [(0, "a", 1.0), (1, "a", 1.0), (2, "a", 2.0), (3, "b", 1.0), (4, "a", None)], "loc double", loc_col="loc")
    assert {r["_rid"]: r.label for r in p.relate(p).components().collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_intervals_meet_points_at_their_own_level_alone(spark):
    from spanway.plans.pairs import _binned

    rows = [(i, "a", 3.0 * i, 3.0 * i + (9.5 if i % 7 else 70000.0)) for i in range(50)]
    f = table(spark, rows, "b double, e double", beg_col="b", end_col="e", closed="left")
    p = table(spark, [(i, "a", 1.7 * i) for i in range(100)], "loc double", loc_col="loc")
    want = {(r[0], i) for r in rows for i in range(100) if r[2] <= 1.7 * i < r[3]}
    for a, b, turn in ((f, p, False), (p, f, True)):
        got = [(r.r_rid, r.l_rid) if turn else (r.l_rid, r.r_rid) for r in a.relate(b, 1.0).intersect().collect()]
        assert len(got) == len(want) and set(got) == want
    side = f.side().withColumnsRenamed({"_beg": "l_beg", "_end": "l_end"})
    assert _binned(side, "l", 1.0, 4, False, True).filter("_level <> l_level").count() == 0


def test_pieces_of_overlapping_bounds_by_one_sweep(spark):
    from spanway import constrain_to

    own = table(spark, [(0, "a", 0.0, 20.0), (1, "a", 5.0, 6.0), (2, "b", 0.0, 9.0)], "b double, e double", beg_col="b", end_col="e")
    bounds = table(spark, [(0, "a", -1.0, 4.0), (1, "a", 2.0, 8.0), (2, "a", 2.0, 8.0), (3, "a", 8.0, 9.0), (4, "a", 12.0, 15.0), (5, "a", 13.0, 13.0)], "b double, e double", beg_col="b", end_col="e")
    out = constrain_to(own, bounds, dissolve=False).df
    assert sorted((r.constrained_index, r.b, r.e) for r in out.collect()) == [(0, 0.0, 2.0), (0, 2.0, 4.0), (0, 4.0, 8.0), (0, 8.0, 9.0), (0, 12.0, 15.0), (1, 5.0, 6.0)]
    assert plan(out).count("Join") == 1  # the pairs' own


def test_axes_are_dealt_out(spark):
    from spanway.sources.tables import lines, seg

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for made in (seg, lines):
        used = made(spark, SF).df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert used > n // 2  # adaptive execution puts so few keys in one task


def test_lines_are_not_made_below_their_aggregate(spark):
    from spanway.sources.tables import lines

    f = lines(spark, SF)
    below = plan(spatial.split(f, [(1.0, -5.0), (100.0, -5.0), (50.0, 1000.0)]).df)
    for part in below.split("Aggregate [l_suppkey")[1:]:
        assert "zip_with" not in part.split("Relation", 1)[0]
    short = roads(spark, [(0, "a", 0.0, 0.0, 1.0, 1.0)])
    odd = short._with(short.df.unionByName(short.df.withColumns({"_rid": F.lit(1).cast("long"), "g": F.slice("g", 1, 1)})).unionByName(short.df.withColumns({"_rid": F.lit(2).cast("long"), "g": F.lit(None).cast(short.df.schema["g"].dataType)})))
    assert [r["_rid"] for r in spatial._segments(odd.df, "g").collect()] == [0]


def integrated(spark):
    from spanway import integrate

    a = table(spark, [(0, "a", 0.0, 4.0), (1, "a", 2.0, 6.0), (2, "b", 0.0, 1.0)], "b double, e double", beg_col="b", end_col="e")
    b = table(spark, [(5, "a", 3.0, 4.0), (6, "a", 8.0, 9.0), (7, "a", 8.0, 9.0), (8, "c", 0.0, 1.0)], "b double, e double", beg_col="b", end_col="e")
    return lambda **how: integrate([a, b], **how)


def sweep(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_gaps_are_grouped_with_the_pairs(spark):
    found = integrated(spark)(fill_gaps=True)
    want = [("a", 0.0, 2.0, 0, None), ("a", 2.0, 3.0, 0, None), ("a", 3.0, 4.0, 0, 5), ("a", 4.0, 6.0, 1, None), ("a", 6.0, 8.0, None, None), ("a", 8.0, 9.0, None, 6), ("b", 0.0, 1.0, 2, None), ("c", 0.0, 1.0, None, 8)]
    assert sweep(found) == sorted(want, key=str)
    assert plan(found).count("min(") <= 2  # one grouping finds both tables' ids


@pytest.mark.parametrize("gaps", [False, True])
def test_expanded_pieces_are_joined_without_gaps(spark, gaps):
    found = integrated(spark)(expand=True, fill_gaps=gaps)
    want = [("a", 0.0, 2.0, 0, None), ("a", 2.0, 3.0, 0, None), ("a", 2.0, 3.0, 1, None), ("a", 3.0, 4.0, 0, 5), ("a", 3.0, 4.0, 1, 5), ("a", 4.0, 6.0, 1, None), ("a", 8.0, 9.0, None, 6), ("a", 8.0, 9.0, None, 7), ("b", 0.0, 1.0, 2, None), ("c", 0.0, 1.0, None, 8)]
    assert sweep(found) == sorted(want + ([("a", 6.0, 8.0, None, None)] if gaps else []), key=str)
    assert plan(found).count("Join") == (4 if gaps else 3)


def test_a_profile_stays_out_of_the_join(spark):
    from spanway.functions.weights import PROFILES
    from spanway.queries import QUERIES

    inf = float("inf")
    own = [(0, "a", 0.0, 10.0), (1, "a", 10.0, 20.0), (2, "a", 5.0, 5.0), (3, "a", -5.0, 40.0), (4, "b", 0.0, 1.0)]
    other = [(0, "a", 2.0, 14.0), (1, "a", 10.0, 12.0), (2, "a", 6.0, 6.0), (3, "a", 20.0, 30.0), (4, "c", 0.0, 1.0), (5, "a", 0.5, 0.5 + 3.0), (6, "a", -9.0, None)]
    a, b = (table(spark, rows, "b double, e double", beg_col="b", end_col="e") for rows in (own, other))
    ramp = lambda t: 4 / 3 * (2 * t * t if t < 0.25 else t - 0.125 if t <= 0.75 else 0.75 - 2 * (1 - t) ** 2)
    want = {(l[0], r[0]): ramp((min(l[3], r[3]) - r[2]) / (r[3] - r[2])) - ramp((max(l[2], r[2]) - r[2]) / (r[3] - r[2])) for l in own for r in other if r[3] is not None and l[1] == r[1] and min(l[3], r[3]) > max(l[2], r[2])}
    assert {(r.l_rid, r.r_rid): r.w for r in a.relate(b).overlay(profile="trapezoidal").collect()} == pytest.approx(want)
    endless = table(spark, [(0, "a", 0.0, inf)], "b double, e double", beg_col="b", end_col="e")
    assert [r.w for r in endless.relate(a).overlay(profile=PROFILES["trapezoidal"]).filter("r_rid = 1").collect()] == [1.0]
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for name in ("trapezoidal", "triangular", "parabolic"):
            made = QUERIES[f"overlay_profile_{name}"](spark, SF)
            joins = [line for line in plan(made).splitlines() if "Join" in line]
            assert joins and not any("CASE" in line or " * " in line for line in joins)
            text = made._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
            assert sizes and max(sizes) < 4000  # the JVM compiles no method beyond 8,000 bytes
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_segments_are_not_broadcast(spark):
    from spanway.queries import QUERIES

    made = QUERIES["overlay_profile_trapezoidal"](spark, SF)
    assert made.count() > 0
    made.collect()
    text = made._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("== Initial Plan ==")]
    # their number is 90 times what Spark takes it for, so that it would broadcast millions
    assert final.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in final
