"""The registered queries over the driver's tables, each with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanway.functions import lines as L
from spanway.functions.direction import bearing, direction
from spanway.operators import spatial
from spanway.operators.integrate import constrain_to, integrate
from spanway.sources.tables import LINEAR, chain, lin, lines, pts, read, seg

RID = "_rid"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FX = """WITH RECURSIVE fx_lin AS (
  SELECT *, route * 1000000000 + rid AS gid FROM (SELECT l_suppkey AS route,
    CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS beg_m,
    CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) + l_quantity AS end_m,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_quantity, l_orderkey, l_linenumber, l_partkey) AS rid,
    l_extendedprice AS price, l_returnflag AS flag FROM lineitem)),
fx_pts AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS route,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS loc,
    o_orderkey AS rid, o_totalprice AS val, o_orderpriority AS cat FROM orders),
fx_chain AS (SELECT * FROM (SELECT user_id AS route, event_id AS rid, floor(epoch(ts) / 60) - 28401120 AS beg_m,
    lead(floor(epoch(ts) / 60) - 28401120) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_m, value, event_type FROM events) WHERE end_m > beg_m),
fx_seg AS (SELECT route, CAST(k * 30 AS DOUBLE) AS beg_m, CAST((k + 1) * 30 AS DOUBLE) AS end_m, k AS rid, route * 1000 + k AS gid
  FROM (SELECT DISTINCT l_suppkey AS route FROM lineitem), range(0, 90) t(k))
"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL behind the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = FX + sql
        return f

    return add


def _closed(frame, closed: str):
    return frame.modify_lrs(closed=closed)


def _own(frame, found: DataFrame, *columns: str) -> DataFrame:
    """The key and id of a frame's rows beside what was found for them."""
    return frame.df.select("route", "rid", RID).join(found, RID).select("route", "rid", *columns)


# relations

SEG_W = 30.0


@query("SELECT s.route, s.rid, count(p.rid) AS n FROM fx_seg s LEFT JOIN fx_pts p ON p.route = s.route AND p.loc >= s.beg_m AND p.loc < s.end_m GROUP BY ALL")
def count_points_on_segments(spark, d):
    s = seg(spark, d)
    return _own(s, s.relate(pts(spark, d), SEG_W).count(name="n"), "n")


@query("SELECT p.rid, count(s.rid) AS n FROM fx_pts p LEFT JOIN fx_seg s ON p.route = s.route AND p.loc >= s.beg_m AND p.loc < s.end_m GROUP BY ALL")
def count_axis0(spark, d):
    return seg(spark, d).relate(pts(spark, d), SEG_W).count(axis=0, name="n").select(F.col(RID).alias("rid"), "n")


def _closure_query(lc: str, rc: str):
    def flags(side, c):
        b = {"left": "TRUE", "both": "TRUE", "left_mod": "TRUE", "right_mod": f"{side}.first_"}.get(c, "FALSE")
        e = {"right": "TRUE", "both": "TRUE", "right_mod": "TRUE", "left_mod": f"{side}.last_"}.get(c, "FALSE")
        return b, e

    (lb, le), (rb, re) = flags("l", lc), flags("r", rc)
    runs = "SELECT *, coalesce(lead(beg_m) OVER w > end_m, TRUE) AS last_, coalesce(beg_m > lag(end_m) OVER w, TRUE) AS first_ FROM {} WINDOW w AS (PARTITION BY route ORDER BY beg_m, end_m, rid)"
    sql = f""", l AS ({runs.format('fx_seg')}), r AS ({runs.format('fx_lin')})
    SELECT l.route, l.rid, count(r.rid) AS n, CAST(coalesce(sum(r.rid), 0) AS BIGINT) AS ids FROM l LEFT JOIN r ON l.route = r.route
      AND ((l.end_m > r.beg_m AND l.beg_m < r.end_m) OR (l.beg_m = r.end_m AND {lb} AND {re}) OR (l.end_m = r.beg_m AND {le} AND {rb})) GROUP BY ALL"""

    def run(spark, d):
        left, right = _closed(seg(spark, d), lc), _closed(lin(spark, d), rc)
        pairs = left.relate(right, SEG_W).intersect(right=["rid"])
        found = pairs.groupBy(F.col("l_rid").alias(RID)).agg(F.count("*").alias("n"), F.sum("r_v_rid").alias("ids"))
        return left.df.select("route", "rid", RID).join(found, RID, "left").select("route", "rid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.lit(0)).alias("ids"))

    run.__name__ = f"intersect_{lc}_{rc}"
    query(sql)(run)


for _pair in (("both", "both"), ("left", "right"), ("left_mod", "both"), ("both", "right_mod"), ("neither", "both")):
    _closure_query(*_pair)


@query("SELECT l.rid AS a, r.rid AS b, l.route, l.loc FROM fx_pts l JOIN fx_pts r ON l.route = r.route AND l.loc = r.loc AND l.rid < r.rid")
def points_at_points(spark, d):
    p = pts(spark, d)
    pairs = p.relate(p).intersect(left=["route", "loc"]).filter("l_rid < r_rid")
    return pairs.select(F.col("l_rid").alias("a"), F.col("r_rid").alias("b"), F.col("l_v_route").alias("route"), F.col("l_v_loc").alias("loc"))


OVER = "JOIN fx_lin r ON r.route = s.route AND s.end_m > r.beg_m AND s.beg_m < r.end_m"
W = "(least(s.end_m, r.end_m) - greatest(s.beg_m, r.beg_m))"
WN = f"({W} / (r.end_m - r.beg_m))"


@query(f"SELECT s.route, s.rid, CAST(sum({W}) AS DOUBLE) AS days, count(*) AS n FROM fx_seg s {OVER} GROUP BY ALL")
def overlay_raw(spark, d):
    s = seg(spark, d)
    o = s.relate(lin(spark, d), SEG_W).overlay(normalize=False)
    return _own(s, o.groupBy(F.col("l_rid").alias(RID)).agg(F.sum("w").alias("days"), F.count("*").alias("n")), "days", "n")


@query(f"SELECT s.route, s.rid, round(sum({WN}), 6) AS share FROM fx_seg s {OVER} GROUP BY ALL")
def overlay_norm_right(spark, d):
    s = seg(spark, d)
    o = s.relate(lin(spark, d), SEG_W).overlay()
    return _own(s, o.groupBy(F.col("l_rid").alias(RID)).agg(F.round(F.sum("w"), 6).alias("share")), "share")


@query(f"""SELECT route, rid, round(sum(g(hi) - g(lo)), 6) AS share FROM (
  SELECT s.route, s.rid, (least(s.end_m, r.end_m) - r.beg_m) / (r.end_m - r.beg_m) AS hi, (greatest(s.beg_m, r.beg_m) - r.beg_m) / (r.end_m - r.beg_m) AS lo FROM fx_seg s {OVER}) GROUP BY ALL""".replace("g(hi)", "(CASE WHEN hi < 0.5 THEN 2*hi*hi ELSE -2*hi*hi + 4*hi - 1 END)").replace("g(lo)", "(CASE WHEN lo < 0.5 THEN 2*lo*lo ELSE -2*lo*lo + 4*lo - 1 END)"))
def overlay_profile_triangular(spark, d):
    s = seg(spark, d)
    o = s.relate(lin(spark, d), SEG_W).overlay(profile="triangular")
    return _own(s, o.groupBy(F.col("l_rid").alias(RID)).agg(F.round(F.sum("w"), 6).alias("share")), "share")


def _agg(name: str, sql: str, run):
    run.__name__ = name
    query(sql)(run)


_agg("sum_overlay", f"SELECT s.route, s.rid, coalesce(round(sum({WN} * r.price), 4), 0.0) AS price FROM fx_seg s LEFT {OVER} GROUP BY ALL",
     lambda spark, d: (lambda s: _own(s, s.relate(lin(spark, d), SEG_W).sum("price"), F.round("price", 4).alias("price")))(seg(spark, d)))
_agg("sum_conserve", f""", o AS (SELECT s.route, s.rid, r.gid, r.price, {WN} AS w FROM fx_seg s {OVER}),
  c AS (SELECT *, w / sum(w) OVER (PARTITION BY gid) AS v FROM o)
  SELECT s.route, s.rid, coalesce(round(sum(v * price), 4), 0.0) AS price FROM fx_seg s LEFT JOIN c ON s.route = c.route AND s.rid = c.rid GROUP BY ALL""",
     lambda spark, d: (lambda s: _own(s, s.relate(lin(spark, d), SEG_W).sum("price", conserve=True), F.round("price", 4).alias("price")))(seg(spark, d)))
_agg("mean_weighted", f"SELECT s.route, s.rid, round(sum({WN} * r.price) / sum({WN}), 4) AS price FROM fx_seg s LEFT {OVER} GROUP BY ALL",
     lambda spark, d: (lambda s: _own(s, s.relate(lin(spark, d), SEG_W).mean("price"), F.round("price", 4).alias("price")))(seg(spark, d)))
PT = "LEFT JOIN fx_pts p ON p.route = s.route AND p.loc >= s.beg_m AND p.loc < s.end_m"
# moved off the halves: a mean of cents can lie on one
_agg("mean_of_points", f"SELECT s.route, s.rid, round(avg(p.val) + 0.0000123, 4) AS val FROM fx_seg s {PT} GROUP BY ALL",
     lambda spark, d: (lambda s: _own(s, s.relate(pts(spark, d), SEG_W).mean("val"), F.round(F.col("val") + 0.0000123, 4).alias("val")))(seg(spark, d)))
_agg("mode_weighted", f""", m AS (SELECT s.route, s.rid, r.flag, round(sum({W}), 6) AS w FROM fx_seg s {OVER} GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY route, rid ORDER BY w DESC, flag) AS p FROM m)
  SELECT s.route, s.rid, k.flag FROM fx_seg s LEFT JOIN k ON s.route = k.route AND s.rid = k.rid AND p = 1""",
     lambda spark, d: (lambda s: _own(s, s.relate(lin(spark, d), SEG_W).mode("flag", normalize=False), "flag"))(seg(spark, d)))
_agg("first_of_points", f"SELECT s.route, s.rid, arg_min(p.cat, (p.loc, p.rid)) AS cat FROM fx_seg s {PT} GROUP BY ALL",
     lambda spark, d: (lambda s: _own(s, s.relate(pts(spark, d), SEG_W).first("cat"), "cat"))(seg(spark, d)))
_agg("last_of_points", f"SELECT s.route, s.rid, arg_max(p.cat, (p.loc, p.rid)) AS cat FROM fx_seg s {PT} GROUP BY ALL",
     lambda spark, d: (lambda s: _own(s, s.relate(pts(spark, d), SEG_W).last("cat"), "cat"))(seg(spark, d)))
_agg("second_of_points", f"SELECT s.route, s.rid, list(p.cat ORDER BY p.loc, p.rid)[2] AS cat FROM fx_seg s {PT} GROUP BY ALL",
     lambda spark, d: (lambda s: _own(s, s.relate(pts(spark, d), SEG_W).single(1, "cat"), "cat"))(seg(spark, d)))
_agg("list_of_points", f"SELECT s.route, s.rid, coalesce(string_agg(p.cat, ',' ORDER BY p.loc, p.rid), '') AS cats FROM fx_seg s {PT} GROUP BY ALL",
     lambda spark, d: (lambda s: _own(s, s.relate(pts(spark, d), SEG_W).list("cat"), F.array_join("cat", ",").alias("cats")))(seg(spark, d)))
_agg("set_of_points", f"SELECT s.route, s.rid, coalesce(array_to_string(list_sort(list(DISTINCT p.cat)), ','), '') AS cats FROM fx_seg s {PT} GROUP BY ALL".replace("list(DISTINCT p.cat)", "list(DISTINCT p.cat) FILTER (p.cat IS NOT NULL)"),
     lambda spark, d: (lambda s: _own(s, s.relate(pts(spark, d), SEG_W).set("cat"), F.array_join("cat", ",").alias("cats")))(seg(spark, d)))
_agg("value_counts", "SELECT s.route, s.rid, " + ", ".join(f"count(*) FILTER (r.flag = '{v}') AS \"{v}\"" for v in "ANR") + f" FROM fx_seg s LEFT {OVER} GROUP BY ALL",
     lambda spark, d: (lambda s: _own(s, s.relate(lin(spark, d), SEG_W).value_counts("flag", ["A", "N", "R"]), "A", "N", "R"))(seg(spark, d)))


def _distribute(name: str, decay: str, weights: list[float]):
    steps = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in [(0, 1.0), *[(s * k, w) for k, w in enumerate(weights, 1) for s in (1, -1)]])
    sql = f""", m AS (SELECT s.route, s.rid, p.rid AS src FROM fx_seg s JOIN fx_pts p ON p.route = s.route AND p.loc >= s.beg_m AND p.loc < s.end_m),
    x AS (SELECT m.route, t.rid, src, sum(f * (t.end_m - t.beg_m)) AS w FROM m JOIN (VALUES {steps}) v(k, f) ON TRUE JOIN fx_seg t ON t.route = m.route AND t.rid = m.rid + k GROUP BY ALL),
    y AS (SELECT route, rid, w / sum(w) OVER (PARTITION BY src) AS w FROM x)
    SELECT s.route, s.rid, coalesce(round(sum(w), 6), 0.0) AS share FROM fx_seg s LEFT JOIN y ON s.route = y.route AND s.rid = y.rid GROUP BY ALL"""
    _agg(name, sql, lambda spark, d: (lambda s: _own(s, s.relate(pts(spark, d), SEG_W).distribute(decay=decay, size=2), F.round("sum", 6).alias("share")))(seg(spark, d)))


_distribute("distribute_linear", "linear", [2 / 3, 1 / 3])
_distribute("distribute_gaussian", "gaussian", [0.32465246735834974, 0.011108996538242306])


_distribute("distribute_exponential", "exponential", [0.18887560283756186, 0.03567399334725241])
_distribute("distribute_flat", "flat", [1.0, 1.0])


def _profile(name: str, sql_of) -> None:
    lo, hi = sql_of("lo"), sql_of("hi")
    _agg(f"overlay_profile_{name}", f"""SELECT route, rid, round(sum({hi} - {lo}), 6) AS share FROM (
      SELECT s.route, s.rid, (least(s.end_m, r.end_m) - r.beg_m) / (r.end_m - r.beg_m) AS hi, (greatest(s.beg_m, r.beg_m) - r.beg_m) / (r.end_m - r.beg_m) AS lo FROM fx_seg s {OVER}) GROUP BY ALL""",
         lambda spark, d: (lambda s: _own(s, s.relate(lin(spark, d)).overlay(profile=name).groupBy(F.col("l_rid").alias(RID)).agg(F.round(F.sum("w"), 6).alias("share")), "share"))(seg(spark, d)))


_profile("parabolic", lambda t: f"(3 * {t} * {t} - 2 * {t} * {t} * {t})")
_profile("trapezoidal", lambda t: f"(4.0::DOUBLE / 3 * CASE WHEN {t} < 0.25 THEN 2 * {t} * {t} WHEN {t} <= 0.75 THEN {t} - 0.125 ELSE 0.75 - 2 * (1 - {t}) * (1 - {t}) END)")
# the bins' width is found from the tables
_agg("count_by_found_width", "SELECT s.route, s.rid, count(p.rid) AS n FROM fx_seg s LEFT JOIN fx_pts p ON p.route = s.route AND p.loc >= s.beg_m AND p.loc < s.end_m GROUP BY ALL",
     lambda spark, d: (lambda s: _own(s, s.relate(pts(spark, d)).count(name="n"), "n"))(seg(spark, d)))
_agg("sum_by_found_width", f"SELECT s.route, s.rid, coalesce(round(sum({WN} * r.price), 4), 0.0) AS price FROM fx_seg s LEFT {OVER} GROUP BY ALL",
     lambda spark, d: (lambda s: _own(s, s.relate(lin(spark, d)).sum("price"), F.round("price", 4).alias("price")))(seg(spark, d)))
# rows of very different lengths: every thousandth reaches far along the axis
_agg("count_long_rows", """, w AS (SELECT route, rid, beg_m, CASE WHEN gid % 1000 = 0 THEN beg_m + 100000 ELSE end_m END AS end_m FROM fx_lin)
  SELECT w.route, w.rid, count(p.rid) AS n FROM w LEFT JOIN fx_pts p ON p.route = w.route AND p.loc >= w.beg_m AND p.loc < w.end_m GROUP BY ALL""",
     lambda spark, d: (lambda f: _own(f, f.relate(pts(spark, d), 1.0).count(name="n"), "n"))((lambda f: f._with(f.df.withColumn("end_m", F.when(F.col(RID) % 1000 == 0, F.col("beg_m") + 100000).otherwise(F.col("end_m")))))(lin(spark, d))))
_agg("equal_groups", "SELECT s.route, count(*) AS n, CAST(sum(p.rid) AS BIGINT) AS ids FROM fx_seg s JOIN fx_pts p ON p.route = s.route GROUP BY ALL",
     lambda spark, d: seg(spark, d).relate(pts(spark, d)).equal_groups(keep_keys=True).groupBy("route").agg(F.count("*").alias("n"), F.sum("r_rid").alias("ids")))


# transforms

_agg("dissolve_chain", """, b AS (SELECT *, CASE WHEN lag(end_m) OVER w = beg_m THEN 0 ELSE 1 END AS k FROM fx_chain WINDOW w AS (PARTITION BY route ORDER BY beg_m, end_m, rid)),
  r AS (SELECT *, sum(k) OVER (PARTITION BY route ORDER BY beg_m, end_m, rid) AS run FROM b)
  SELECT route, min(beg_m) AS beg_m, arg_max(end_m, (beg_m, end_m, rid)) AS end_m, count(*) AS n, string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS ids FROM r GROUP BY route, run""",
     lambda spark, d: chain(spark, d).dissolve().df.select("route", "beg_m", "end_m", F.size("dissolved_index").cast("long").alias("n"), F.array_join("dissolved_index", ",").alias("ids")))
_agg("dissolve_retain", """, b AS (SELECT *, CASE WHEN lag(end_m) OVER w = beg_m THEN 0 ELSE 1 END AS k FROM fx_chain WINDOW w AS (PARTITION BY route, event_type ORDER BY beg_m, end_m, rid)),
  r AS (SELECT *, sum(k) OVER (PARTITION BY route, event_type ORDER BY beg_m, end_m, rid) AS run FROM b)
  SELECT route, event_type, min(beg_m) AS beg_m, arg_max(end_m, (beg_m, end_m, rid)) AS end_m, count(*) AS n FROM r GROUP BY route, event_type, run""",
     lambda spark, d: chain(spark, d).dissolve(["event_type"]).df.select("route", "event_type", "beg_m", "end_m", F.size("dissolved_index").cast("long").alias("n")))

for _fill in ("none", "cut", "left", "right", "extend", "balance"):
    _n = "floor" if _fill in ("none", "extend") else "ceil"
    _m = "CASE WHEN n > 1 AND end_m - ((n - 1) * 7.0 + beg_m) < 3.5 THEN n - 1 ELSE greatest(n, 1) END" if _fill == "balance" else "greatest(n, 1)"
    _e = {"none": "CASE WHEN n = 0 THEN end_m ELSE (j * 7.0 + beg_m) + 7.0 END", "right": "(j * 7.0 + beg_m) + 7.0"}.get(_fill, "end_m")
    _b = "end_m - 7.0" if _fill == "left" else "j * 7.0 + beg_m"
    _agg(f"resegment_{_fill}", f""", n AS (SELECT *, CAST({_n}((end_m - beg_m) / 7.0) AS BIGINT) AS n FROM fx_lin), m AS (SELECT *, {_m} AS m FROM n),
      j AS (SELECT *, unnest(range(0, m)) AS j FROM m)
      SELECT route, rid, CAST(CASE WHEN j = m - 1 THEN {_b} ELSE j * 7.0 + beg_m END AS DOUBLE) AS beg_m, CAST(CASE WHEN j = m - 1 THEN {_e} ELSE (j + 1) * 7.0 + beg_m END AS DOUBLE) AS end_m FROM j""",
         lambda spark, d, fill=_fill: lin(spark, d).resegment(7.0, fill).df.select("route", "rid", "beg_m", "end_m"))

INSIDE = """EXISTS (SELECT 1 FROM fx_lin x WHERE x.route = l.route AND {})"""
_INCL = "((l.beg_m >= x.beg_m AND l.end_m < x.end_m) OR (l.beg_m > x.beg_m AND l.end_m <= x.end_m))"
_agg("find_inside", f"SELECT route, rid, {INSIDE.format(_INCL)} AS inside FROM fx_lin l", lambda spark, d: (lambda f: _own(f, f.find_inside(), "inside"))(lin(spark, d)))
_agg("find_inside_strict", f"SELECT route, rid, {INSIDE.format('l.beg_m > x.beg_m AND l.end_m < x.end_m')} AS inside FROM fx_lin l", lambda spark, d: (lambda f: _own(f, f.find_inside(False), "inside"))(lin(spark, d)))
for _keep, _sql in (("first", "row_number() OVER (PARTITION BY route, beg_m, end_m ORDER BY rid) > 1"), ("last", "row_number() OVER (PARTITION BY route, beg_m, end_m ORDER BY rid DESC) > 1"), ("none", "count(*) OVER (PARTITION BY route, beg_m, end_m) > 1")):
    _agg(f"find_same_{_keep}", f"SELECT route, rid, {_sql} AS duplicated FROM fx_lin", lambda spark, d, keep=_keep: (lambda f: _own(f, f.find_same(keep), "duplicated"))(lin(spark, d)))
_agg("duplicated_points", "SELECT route, rid, row_number() OVER (PARTITION BY route, loc ORDER BY rid) > 1 AS duplicated FROM fx_pts", lambda spark, d: (lambda f: _own(f, f.duplicated(), "duplicated"))(pts(spark, d)))
_agg("neighbours", """, n AS (SELECT *, lead(beg_m) OVER w AS nb, coalesce(lag(end_m) OVER w <> beg_m, TRUE) AS k FROM fx_chain WINDOW w AS (PARTITION BY route ORDER BY beg_m, end_m, rid))
  SELECT route, rid, nb IS NOT NULL AS next_same_group, coalesce(nb < end_m, FALSE) AS next_overlapping, coalesce(nb = end_m, FALSE) AS next_consecutive,
    CAST(sum(CAST(k AS INT)) OVER (ORDER BY route, beg_m, end_m, rid) - 1 AS BIGINT) AS string FROM n""",
     lambda spark, d: (lambda f: _own(f, f.neighbours(), "next_same_group", "next_overlapping", "next_consecutive", "string"))(chain(spark, d)))


def _separate(method: str):
    mid = {"center": "(c + nc) / 2", "left": "end_m", "right": "nb"}.get(method)
    if method == "balanced":
        near, centre = "least(greatest((end_m + nb) / 2, c), nc)", "(c + nc) / 2"
        fit = lambda m: f"{m} <= end_m AND {m} >= nb"
        mid = f"CASE WHEN {fit(centre)} THEN {centre} WHEN {fit(near)} THEN {near} END"
    sql = f""", f AS (SELECT l.*, (beg_m + end_m) / 2 AS c, {INSIDE.format(_INCL)} OR row_number() OVER (PARTITION BY route, beg_m, end_m ORDER BY rid) > 1 AS gone FROM fx_lin l),
    n AS (SELECT *, lead(beg_m) OVER w AS nb, lead(c) OVER w AS nc FROM f WHERE NOT gone WINDOW w AS (PARTITION BY route ORDER BY c, end_m - beg_m DESC, rid)),
    s AS (SELECT *, CASE WHEN end_m > nb THEN {mid} END AS mid FROM n),
    o AS (SELECT *, lag(mid) OVER (PARTITION BY route ORDER BY c, end_m - beg_m DESC, rid) AS pm FROM s)
    SELECT route, rid, coalesce(pm, beg_m) AS beg_m, coalesce(mid, end_m) AS end_m FROM o UNION ALL SELECT route, rid, c, c FROM f WHERE gone"""
    _agg(f"separate_{method}", sql, lambda spark, d: lin(spark, d).separate(method=method).df.select("route", "rid", "beg_m", "end_m"))


for _method in ("balanced", "center", "left", "right"):
    _separate(_method)

_agg("extend_points", "SELECT rid, loc - 2.5 AS beg, loc + 4.0 AS \"end\" FROM fx_pts", lambda spark, d: pts(spark, d).extend((2.5, 4.0)).df.select("rid", "beg", "end"))
_agg("shift", "SELECT route, rid, beg_m + 1.5 AS beg_m, end_m + 1.5 AS end_m FROM fx_lin", lambda spark, d: lin(spark, d).shift(1.5).df.select("route", "rid", "beg_m", "end_m"))
_agg("round_factor", "SELECT route, rid, round_even(beg_m / 4, 0) * 4 AS beg_m, round_even(end_m / 4, 0) * 4 AS end_m FROM fx_lin", lambda spark, d: lin(spark, d).round(factor=4).df.select("route", "rid", "beg_m", "end_m"))
_agg("point_to_linear", "SELECT rid, loc, loc AS beg, loc AS \"end\" FROM fx_pts", lambda spark, d: pts(spark, d).point_to_linear().df.select("rid", "loc", "beg", "end"))
_agg("set_monotonic", "SELECT route, rid, beg_m, end_m FROM fx_lin", lambda spark, d: (lambda f: f._with(f.df.select("route", "rid", RID, F.col("end_m").alias("beg_m"), F.col("beg_m").alias("end_m"))).set_monotonic().df.select("route", "rid", "beg_m", "end_m"))(lin(spark, d)))
_agg("group_counts", "SELECT route, count(*) AS count FROM fx_lin GROUP BY route", lambda spark, d: lin(spark, d).group_counts())
_agg("select_group", "SELECT rid, loc FROM fx_pts WHERE route = 3", lambda spark, d: pts(spark, d).select_group(3).df.select("rid", "loc"))
_agg("drop_group", "SELECT rid, loc FROM fx_pts WHERE route <> 3", lambda spark, d: pts(spark, d).drop_group(3).df.select("rid", "loc"))
_agg("valid_events", "SELECT rid FROM fx_pts WHERE loc IS NOT NULL AND route IS NOT NULL", lambda spark, d: pts(spark, d).drop_invalid().df.select("rid"))
_agg("sort_standard", "SELECT route, rid, beg_m, end_m FROM fx_seg ORDER BY ALL", lambda spark, d: seg(spark, d).sort_standard().select("route", "rid", "beg_m", "end_m"))
_agg("concatenate", "SELECT route, beg_m, end_m FROM fx_seg UNION ALL SELECT route, beg_m, end_m FROM fx_lin", lambda spark, d: seg(spark, d).concatenate(lin(spark, d)).df.select("route", "beg_m", "end_m"))
_agg("groups_hashed", "SELECT DISTINCT route, sha256(CAST(route AS VARCHAR)) AS group_hash FROM fx_seg", lambda spark, d: seg(spark, d).groups_hashed().df.select("route", "group_hash").distinct())


# integration and clusters

_agg("cluster_intervals", """, r AS (SELECT *, max(end_m) OVER (PARTITION BY route ORDER BY beg_m, end_m, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fx_lin),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR beg_m >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY beg_m, end_m, gid) AS isle FROM r),
  h AS (SELECT *, min(gid) OVER (PARTITION BY route, isle) AS head FROM i)
  SELECT route, rid, CAST(dense_rank() OVER (ORDER BY head) - 1 AS INTEGER) AS cluster FROM h""",
     lambda spark, d: lin(spark, d).cluster().df.select("route", "rid", F.col("cluster").cast("int").alias("cluster")))
_agg("cluster_points", """, r AS (SELECT *, lag(loc) OVER (PARTITION BY route ORDER BY loc, rid) AS before FROM fx_pts),
  i AS (SELECT *, sum(CASE WHEN before IS NULL OR loc - before >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY loc, rid) AS isle FROM r),
  h AS (SELECT *, min(rid) OVER (PARTITION BY route, isle) AS head FROM i)
  SELECT rid, CAST(dense_rank() OVER (ORDER BY head) - 1 AS INTEGER) AS cluster FROM h""",
     lambda spark, d: pts(spark, d).cluster(3.0).df.select("rid", F.col("cluster").cast("int").alias("cluster")))
_agg("cluster_link", """, i AS (SELECT rid, min(rid) OVER (PARTITION BY route, loc) AS head, CASE WHEN rid % 50 = 0 THEN rid % 700 END AS link FROM fx_pts),
  h AS (SELECT DISTINCT head, link FROM i WHERE link IS NOT NULL),
  r AS (SELECT head, head AS other FROM h UNION SELECT r.head, b.head FROM r JOIN h a ON a.head = r.other JOIN h b ON b.link = a.link),
  l AS (SELECT head, min(other) AS label FROM r GROUP BY head)
  SELECT rid, CAST(dense_rank() OVER (ORDER BY coalesce(label, i.head)) - 1 AS BIGINT) AS cluster FROM i LEFT JOIN l ON l.head = i.head""",
     lambda spark, d: (lambda p: p._with(p.df.withColumn("link", F.when(F.col("rid") % 50 == 0, F.col("rid") % 700))).cluster(0.0, link_col="link").df.select("rid", "cluster"))(pts(spark, d)))
_agg("components_of_overlaps", """, r AS (SELECT *, lag(loc) OVER (PARTITION BY route ORDER BY loc, rid) AS before FROM fx_pts),
  i AS (SELECT *, sum(CASE WHEN before IS NULL OR loc - before >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY loc, rid) AS isle FROM r)
  SELECT rid, min(rid) OVER (PARTITION BY route, isle) AS label FROM i""",
     lambda spark, d: (lambda f: f.relate(f).components().select(F.col(RID).alias("rid"), "label"))(pts(spark, d).extend(5.0)))

EDGES = """, e AS (SELECT route, beg_m AS x FROM fx_seg UNION SELECT route, end_m FROM fx_seg UNION SELECT route, beg_m FROM fx_lin UNION SELECT route, end_m FROM fx_lin),
  c AS (SELECT * FROM (SELECT route, x AS "beg", lead(x) OVER (PARTITION BY route ORDER BY x) AS "end" FROM e) WHERE "end" IS NOT NULL),
  a AS (SELECT c.route, c."beg", min(s.gid) AS s FROM c JOIN fx_seg s ON s.route = c.route AND s.end_m > c."beg" AND s.beg_m < c."end" GROUP BY ALL),
  b AS (SELECT c.route, c."beg", min(l.gid) AS l FROM c JOIN fx_lin l ON l.route = c.route AND l.end_m > c."beg" AND l.beg_m < c."end" GROUP BY ALL)
"""
INT = 'SELECT c.route, c."beg", c."end", a.s AS integrated_index_0, b.l AS integrated_index_1 FROM c LEFT JOIN a ON a.route = c.route AND a."beg" = c."beg" LEFT JOIN b ON b.route = c.route AND b."beg" = c."beg"'
_agg("integrate_least", EDGES + INT + " WHERE a.s IS NOT NULL OR b.l IS NOT NULL", lambda spark, d: integrate([seg(spark, d), lin(spark, d)], width=SEG_W))
_agg("integrate_gaps", EDGES + INT, lambda spark, d: integrate([seg(spark, d), lin(spark, d)], fill_gaps=True, width=SEG_W))
_agg("integrate_expand", EDGES + """SELECT c.route, c."beg", c."end", s.gid AS integrated_index_0, l.gid AS integrated_index_1 FROM c
  LEFT JOIN fx_seg s ON s.route = c.route AND s.end_m > c."beg" AND s.beg_m < c."end" LEFT JOIN fx_lin l ON l.route = c.route AND l.end_m > c."beg" AND l.beg_m < c."end"
  WHERE s.gid IS NOT NULL OR l.gid IS NOT NULL""", lambda spark, d: integrate([seg(spark, d), lin(spark, d)], expand=True, width=SEG_W))
_agg("constrain_to", """, b AS (SELECT * FROM fx_seg WHERE rid % 3 <> 0), p AS (SELECT l.route, l.gid, l.flag, greatest(l.beg_m, b.beg_m) AS x, least(l.end_m, b.end_m) AS y FROM fx_lin l JOIN b ON l.route = b.route AND l.end_m > b.beg_m AND l.beg_m < b.end_m),
  k AS (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY gid ORDER BY x) >= x THEN 0 ELSE 1 END AS n FROM p), r AS (SELECT *, sum(n) OVER (PARTITION BY gid ORDER BY x) AS run FROM k)
  SELECT route, gid AS constrained_index, min(x) AS beg_m, max(y) AS end_m, any_value(flag) AS flag FROM r GROUP BY route, gid, run""",
     lambda spark, d: (lambda s: constrain_to(lin(spark, d), s._with(s.df.filter("rid % 3 <> 0")), width=SEG_W).df.select("route", "constrained_index", "beg_m", "end_m", "flag"))(seg(spark, d)))
_agg("constrain_pieces", """SELECT l.route, l.gid AS constrained_index, greatest(l.beg_m, b.beg_m) AS beg_m, least(l.end_m, b.end_m) AS end_m, l.flag FROM fx_lin l JOIN fx_seg b ON l.route = b.route AND l.end_m > b.beg_m AND l.beg_m < b.end_m WHERE b.rid % 3 <> 0""",
     lambda spark, d: (lambda s: constrain_to(lin(spark, d), s._with(s.df.filter("rid % 3 <> 0")), dissolve=False).df.select("route", "constrained_index", "beg_m", "end_m", "flag"))(seg(spark, d)))
_agg("integrate_at_points", """, e AS (SELECT route, beg_m AS x FROM fx_seg UNION SELECT route, end_m FROM fx_seg UNION SELECT route, loc FROM fx_pts),
  c AS (SELECT * FROM (SELECT route, x AS "beg", lead(x) OVER (PARTITION BY route ORDER BY x) AS "end" FROM e) WHERE "end" IS NOT NULL)
  SELECT c.route, c."beg", c."end", s.gid AS integrated_index_0, CAST(NULL AS BIGINT) AS integrated_index_1 FROM c JOIN fx_seg s ON s.route = c.route AND s.end_m > c."beg" AND s.beg_m < c."end" """,
     lambda spark, d: integrate([seg(spark, d), pts(spark, d)], split_at_locs=True))
_agg("impute_keys", """SELECT p.rid, arg_min(s.rid % 7, (s.beg_m, s.end_m, s.gid)) AS zone FROM fx_pts p LEFT JOIN fx_seg s ON s.route = p.route AND p.loc >= s.beg_m AND p.loc < s.end_m GROUP BY ALL""",
     lambda spark, d: (lambda s: s._with(s.df.withColumn("zone", F.col("rid") % 7), LINEAR.add_key("zone")).impute_keys(pts(spark, d), ["zone"]).df.select("rid", "zone"))(seg(spark, d)))


# geometry

_agg("cut_lines", """SELECT s.route, s.rid, CAST(CASE WHEN s.beg_m < 2700 THEN s.beg_m END AS DOUBLE) AS m0, s.end_m AS m1, s.route + (s.rid % 3) + 0.0::DOUBLE AS y0, s.route + ((s.rid + 1) % 3) + 0.0::DOUBLE AS y1 FROM fx_seg s""",
     lambda spark, d: (lambda s: _own(s, s.cut_from(lines(spark, d)), L.first_m(F.col("geom_m")).alias("m0"), L.last_m(F.col("geom_m")).alias("m1"), F.element_at("geom_m", 1)["y"].alias("y0"), F.element_at("geom_m", -1)["y"].alias("y1")))(seg(spark, d)))
_agg("interpolate_points", """SELECT rid, round(loc, 6) AS x, round(route + k % 3 + (loc - 30 * k) / 30 * ((k + 1) % 3 - k % 3), 6) AS y FROM (SELECT *, CAST(floor(loc / 30) AS BIGINT) AS k FROM fx_pts WHERE route IN (SELECT l_suppkey FROM lineitem))
  UNION ALL SELECT rid, NULL, NULL FROM fx_pts WHERE route NOT IN (SELECT l_suppkey FROM lineitem)""",
     lambda spark, d: pts(spark, d).interpolate_from(lines(spark, d)).select(F.col(RID).alias("rid"), F.round("point.x", 6).alias("x"), F.round("point.y", 6).alias("y")))
_agg("line_measures", """, v AS (SELECT route, i, 30.0 * i AS x, route + i % 3 AS y FROM (SELECT DISTINCT route FROM fx_seg), range(0, 91) t(i)), g AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WINDOW w AS (PARTITION BY route ORDER BY i))
  SELECT route, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 6) AS length, 0.0::DOUBLE AS m0, 2700.0::DOUBLE AS m1, 0.0::DOUBLE AS bearing, 'E' AS direction FROM g WHERE nx IS NOT NULL GROUP BY route""",
     lambda spark, d: lines(spark, d).df.select("route", F.round(L.length(F.col("geom_m")), 6).alias("length"), L.first_m(F.col("geom_m")).alias("m0"), L.last_m(F.col("geom_m")).alias("m1"), bearing("geom_m").alias("bearing"), direction("geom_m").alias("direction")))


def network_screening(spark: SparkSession, d: str) -> DataFrame:
    """Dissolve, resegment, extend, relate with a profile, conserve: the flagship."""
    roads = seg(spark, d).dissolve().resegment(15.0, "balance")
    score = roads.relate(pts(spark, d).extend(7.5).modify_lrs(closed="left"), 15.0).sum(profile="triangular", conserve=True)
    return roads.df.select("route", "beg_m", "end_m", RID).join(score, RID).select("route", "beg_m", "end_m", F.round("sum", 6).alias("score"))


def _g(t: str) -> str:
    return f"(CASE WHEN {t} < 0.5 THEN 2*{t}*{t} ELSE -2*{t}*{t} + 4*{t} - 1 END)"


query(f""", r AS (SELECT route, 15.0 * k AS beg_m, 15.0 * (k + 1) AS end_m FROM (SELECT DISTINCT route FROM fx_seg), range(0, 180) t(k)),
  e AS (SELECT *, loc - 7.5 AS b, loc + 7.5 AS e FROM fx_pts),
  o AS (SELECT r.route, r.beg_m, e.rid, (least(r.end_m, e) - b) / 15.0 AS hi, (greatest(r.beg_m, b) - b) / 15.0 AS lo FROM r JOIN e ON r.route = e.route AND r.end_m > b AND r.beg_m < e),
  w AS (SELECT route, beg_m, rid, {_g('hi')} - {_g('lo')} AS w FROM o), c AS (SELECT route, beg_m, w / sum(w) OVER (PARTITION BY rid) AS w FROM w)
  SELECT r.route, CAST(r.beg_m AS DOUBLE) AS beg_m, CAST(r.end_m AS DOUBLE) AS end_m, coalesce(round(sum(w), 6), 0.0) AS score FROM r LEFT JOIN c ON r.route = c.route AND r.beg_m = c.beg_m GROUP BY ALL""")(network_screening)


# planar joins

def _grid(spark: SparkSession, d: str):
    """The axes' lines and upright ones across all of them, one for each 100 along the axis."""
    from spanway.frame import EventFrame
    from spanway.lrs import LRS

    flat = lines(spark, d).df.select(F.col("route").alias("_rid"), F.lit("flat").alias("route"), F.col("geom_m").alias("geom_m"))
    n = 26
    reach = flat.agg(F.min("_rid").alias("low"), F.max("_rid").alias("high"))
    up = spark.range(1, n + 1).crossJoin(reach).select((F.col("id") + 1_000_000).alias("_rid"), F.lit("up").alias("route"), F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.struct((F.col("id") * 100.0 + 5).alias("x"), F.when(i == 0, F.col("low") - 5000.0).otherwise(F.col("high") + 5000.0).alias("y"), (i * 1.0).alias("m"))).alias("geom_m"))
    return EventFrame(flat.union(up), LRS(key_col=("route",), geom_m_col="geom_m"))


@query("""SELECT l.route AS l_rid, 1000000 + k AS r_rid, TRUE AS crosses FROM (SELECT DISTINCT route FROM fx_seg) l, range(1, 27) t(k)""")
def intersections(spark, d):
    return spatial.intersection_pairs(_grid(spark, d), size=200.0)


@query(""", u AS (SELECT k * 100.0::DOUBLE + 5 AS x, 1000000 + k AS up FROM range(1, 27) t(k)),
  n AS (SELECT x, up, route, CAST(floor(x / 30) AS BIGINT) AS i FROM u, (SELECT DISTINCT route FROM fx_seg)),
  p AS (SELECT x, round(route + i % 3 + (x - 30.0::DOUBLE * i) / 30.0::DOUBLE * ((i + 1) % 3 - i % 3), 6) AS y, up, route FROM n)
  SELECT x, y, string_agg(DISTINCT CAST(r AS VARCHAR), ',' ORDER BY CAST(r AS VARCHAR)) AS rids FROM (SELECT x, y, up AS r FROM p UNION SELECT x, y, route FROM p) GROUP BY x, y""")
def intersection_nodes(spark, d):
    n = spatial.intersection_nodes(_grid(spark, d), size=200.0)
    n = n.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.explode("rids").alias("r"))
    return n.groupBy("x", "y").agg(F.array_join(F.array_sort(F.collect_set(F.col("r").cast("string"))), ",").alias("rids"))


@query(""", p AS (SELECT rid, loc AS x, CAST(route + (rid % 33) * 0.5::DOUBLE - 8 AS DOUBLE) AS y FROM fx_pts),
  k AS (SELECT p.*, CAST(floor(y) AS BIGINT) + a AS line, CAST(floor(x / 30.0::DOUBLE) AS BIGINT) + b AS i FROM p, range(-8, 9) u(a), range(-1, 2) w(b)),
  s AS (SELECT k.*, CAST(30 * i AS DOUBLE) AS ax, CAST(line + i % 3 AS DOUBLE) AS ay, CAST((i + 1) % 3 - i % 3 AS DOUBLE) AS dy FROM k SEMI JOIN lineitem ON l_suppkey = line WHERE i BETWEEN 0 AND 89),
  t AS (SELECT *, least(greatest(((x - ax) * 30.0::DOUBLE + (y - ay) * dy) / (900.0::DOUBLE + dy * dy), 0.0::DOUBLE), 1.0::DOUBLE) AS t FROM s),
  q AS (SELECT *, ax + t * 30.0::DOUBLE AS px, ay + t * dy AS py FROM t), n AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS far FROM q),
  m AS (SELECT rid, arg_min({'line': line, 'loc': px, 'far': far}, (far, line, i)) AS m FROM n WHERE far <= 5 GROUP BY rid)
  SELECT p.rid, m.m.line AS line_rid, round(m.m.loc, 6) AS loc, round(m.m.far, 6) AS distance FROM p LEFT JOIN m ON m.rid = p.rid""")
def project_nearest_line(spark, d):
    """All points, up to 8 beside their axis, on the nearest line within 5."""
    p = pts(spark, d).df.select("rid", RID, F.col("loc").alias("x"), (F.col("route") + (F.col("rid") % 33) * 0.5 - 8).alias("y"))
    out = spatial.project(p, "x", "y", lines(spark, d), buffer=5.0)
    return out.select("rid", "line_rid", F.round("loc", 6).alias("loc"), F.round("distance", 6).alias("distance"))


def _pieces(spark: SparkSession, d: str):
    """Segments as bent lines of two vertices; every tenth is missing, so an axis has nine chains."""
    s = seg(spark, d)
    at = lambda c, k: F.struct(F.col(c).alias("x"), (F.col("route") + k % 3).cast("double").alias("y"), F.col(c).alias("m"))
    return s._with(s.df.filter("rid % 10 <> 9").withColumn("geom_m", F.array(at("beg_m", F.col("rid")), at("end_m", F.col("rid") + 1))), s.lrs.set_params(geom_m_col="geom_m"))


_BENT = ", z AS (SELECT *, sqrt(900.0::DOUBLE + ((rid + 1) % 3 - rid % 3) ** 2) AS len FROM fx_seg WHERE rid % 10 <> 9)"


@query(_BENT + " SELECT route, rid, CAST(rid // 10 AS INTEGER) AS chain, CAST(rid % 10 AS INTEGER) AS place FROM z")
def chains_of_lines(spark, d):
    from spanway.operators.topology import chains

    p = _pieces(spark, d)
    return _own(p, chains(p).drop("route"), "chain", "place")


@query(_BENT + " SELECT route, CAST(rid // 10 AS INTEGER) AS chain, 10 AS vertices, round(sum(len), 6) AS length FROM z GROUP BY route, rid // 10")
def merged_lines(spark, d):
    from spanway.operators.topology import merge_lines

    return merge_lines(_pieces(spark, d)).select("route", "chain", F.size("line").alias("vertices"), F.round(L.length(F.col("line")), 6).alias("length"))


@query(_BENT + """ SELECT route, rid, round(sum(len) OVER w - len, 6) AS "beg", round(sum(len) OVER w, 6) AS "end" FROM z WINDOW w AS (PARTITION BY route ORDER BY rid)""")
def generated_events(spark, d):
    from spanway.operators.topology import generate_linear_events

    return generate_linear_events(_pieces(spark, d)).df.select("route", "rid", F.round("beg", 6).alias("beg"), F.round("end", 6).alias("end"))


_agg("dissolve_lines", _BENT + " SELECT route, rid // 10 AS chain, min(beg_m) AS beg_m, max(end_m) AS end_m, 10 AS vertices, round(sum(len), 6) AS length FROM z GROUP BY route, rid // 10",
     lambda spark, d: _pieces(spark, d).dissolve().df.select("route", F.floor(F.col("beg_m") / 300).alias("chain"), "beg_m", "end_m", F.size("geom_m").alias("vertices"), F.round(L.length(F.col("geom_m")), 6).alias("length")))
_agg("merge_of_relation", _BENT + """, c AS (SELECT route, rid // 10 AS chain, max(end_m) AS end_m FROM z GROUP BY ALL)
  SELECT c.route, c.chain, count(*) + 1 AS vertices, round(sum(len), 6) AS length FROM c JOIN z ON z.route = c.route AND z.rid // 10 = c.chain GROUP BY ALL""",
     lambda spark, d: (lambda p: (lambda w: w.df.select("route", RID, F.floor(F.col("beg_m") / 300).alias("chain")).join(w.relate(p).line_merge_m("geom_m"), RID).select("route", "chain", F.size("geom_m").cast("long").alias("vertices"), F.round(L.length(F.col("geom_m")), 6).alias("length")))(p.dissolve(merge_geom=False)))(_pieces(spark, d)))

#: A polygon with a hole; no side is parallel to the axes' lines.
_POLYGON = {"type": "Polygon", "coordinates": [[(101.0, -50.0), (1003.0, -40.0), (1207.0, 10_000_007.0), (95.0, 10_000_001.0), (101.0, -50.0)], [(301.0, -45.0), (303.0, 10_000_000.0), (411.0, 10_000_000.0), (403.0, -45.0), (301.0, -45.0)]]}
_SIDES = ", ".join(f"({p[0]}::DOUBLE, {p[1]}::DOUBLE, {q[0]}::DOUBLE, {q[1]}::DOUBLE)" for r in _POLYGON["coordinates"] for p, q in zip(r[:-1], r[1:], strict=True))
_SPLIT = f""", g AS (SELECT route, i, 30.0::DOUBLE * i AS ax, (route + i % 3)::DOUBLE AS ay, ((i + 1) % 3 - i % 3)::DOUBLE AS dy FROM (SELECT DISTINCT route FROM fx_seg), range(0, 90) t(i)),
  side AS (SELECT * FROM (VALUES {_SIDES}) v(px, py, qx, qy)),
  x AS (SELECT *, 30.0::DOUBLE * (qy - py) - dy * (qx - px) AS det FROM g, side),
  y AS (SELECT *, ((px - ax) * (qy - py) - (py - ay) * (qx - px)) / det AS t, ((px - ax) * dy - (py - ay) * 30.0::DOUBLE) / det AS u FROM x WHERE det <> 0),
  stops AS (SELECT route, round(ax + t * 30.0::DOUBLE, 6) AS m FROM y WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 UNION SELECT route, 0.0::DOUBLE FROM g UNION SELECT route, 2700.0::DOUBLE FROM g),
  parts AS (SELECT * FROM (SELECT route, m AS beg_m, lead(m) OVER (PARTITION BY route ORDER BY m) AS end_m FROM stops) WHERE end_m IS NOT NULL)"""
_round = lambda df: df.select("route", F.round("beg_m", 6).alias("beg_m"), F.round("end_m", 6).alias("end_m"))
_agg("split_by_polygon", _SPLIT + " SELECT route, beg_m, end_m FROM parts", lambda spark, d: _round(spatial.split(lines(spark, d), _POLYGON).df))
for _keep, _want in (("inside", "1"), ("outside", "0")):
    _agg(f"clip_{_keep}_polygon", _SPLIT + f""", mid AS (SELECT *, (beg_m + end_m) / 2 AS mx, CAST(floor((beg_m + end_m) / 60) AS BIGINT) AS i FROM parts),
      spot AS (SELECT mid.*, route + i % 3 + (mx - 30.0::DOUBLE * i) / 30.0::DOUBLE * ((i + 1) % 3 - i % 3) AS my FROM mid),
      hits AS (SELECT route, beg_m, end_m, count(*) FILTER ((py > my) <> (qy > my) AND mx < px + (my - py) * (qx - px) / (qy - py)) AS n FROM spot, side GROUP BY ALL)
      SELECT route, beg_m, end_m FROM hits WHERE n % 2 = {_want}""",
         lambda spark, d, keep=_keep: _round(spatial.clip(lines(spark, d), _POLYGON, keep).df))
_agg("measures_by_length", _BENT + " SELECT route, rid, beg_m AS m0, end_m AS m1, round(len, 6) AS length FROM z",
     lambda spark, d: (lambda p: p._with(p.df.select("route", "rid", "beg_m", "end_m", RID, "geom_m"), p.lrs.set_params(geom_col="geom_m")).add_geom_m("g").df.select("route", "rid", L.first_m(F.col("g")).alias("m0"), L.last_m(F.col("g")).alias("m1"), F.round(L.length(F.col("g")), 6).alias("length")))(_pieces(spark, d)))
_agg("measured_text", "SELECT route, rid, beg_m AS m0, end_m AS m1 FROM fx_seg WHERE rid % 10 <> 9",
     lambda spark, d: _pieces(spark, d).geom_m_to_wkt().parse_geom_m_wkt().extract_m_values("m0", "m1").df.select("route", "rid", "m0", "m1"))
