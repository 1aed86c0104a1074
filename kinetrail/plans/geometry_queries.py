"""Queries on midlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import matching, series
from ..operators import relational as r
from ..operators.cluster import silhouette as silhouette_of
from ..sources.views import DET, LAB, MID, det, lab, mid, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def exploded(df, keys, column="p", digits=6):
    return df.select(*keys, F.posexplode(column).alias("i", "q")).select(*keys, "i", (F.round("q.x", digits) + 0.0).alias("x"), (F.round("q.y", digits) + 0.0).alias("y"))  # no -0.0


SEG = MID + """, sg AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS d FROM mp WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
cum AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM sg), le AS (SELECT vec_id, sum(d) AS len FROM sg GROUP BY vec_id)"""


@query(f"WITH {SEG} SELECT vec_id, round(len, 6) AS len FROM le")
def arc_length(spark, d):
    return mid(spark, d).select("vec_id", F.round(g.arc_length(F.col("pts")), 6).alias("len"))


@query(f"""WITH {SEG}, t AS (SELECT vec_id, k, k * len / 48 AS t FROM le, (SELECT unnest(range(0, 49)) AS k)), j AS (SELECT t.vec_id, k, t, max(i) AS i FROM t JOIN cum ON cum.vec_id = t.vec_id AND cum.c <= t AND cum.d IS NOT NULL GROUP BY t.vec_id, k, t)
SELECT j.vec_id, CAST(k AS INTEGER) AS i, round(x + (x1 - x) * least((t - c) / d, 1), 5) + 0 AS x, round(y + (y1 - y) * least((t - c) / d, 1), 5) + 0 AS y FROM j JOIN cum ON cum.vec_id = j.vec_id AND cum.i = j.i""")
def resample_49(spark, d):
    return exploded(mid(spark, d).select("vec_id", g.resample(F.col("pts"), 49).alias("p")), ["vec_id"], digits=5)


FLIP = MID + """, fd AS (SELECT a.frame, a.vec_id AS a, b.vec_id AS b, least(avg(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)), avg(sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2))) AS d
FROM mid a JOIN mid b ON a.frame = b.frame AND a.vec_id < b.vec_id JOIN mp p ON p.vec_id = a.vec_id JOIN mp q ON q.vec_id = b.vec_id AND q.i = p.i JOIN mp s ON s.vec_id = b.vec_id AND s.i = 31 - p.i GROUP BY ALL)"""


@query(f"WITH {FLIP} SELECT frame, a, b, round(d, 6) AS d FROM fd")
def flip_distance_pairs(spark, d):
    return matching.flip_distances(mid(spark, d), ["frame"], "vec_id", "pts").withColumn("d", F.round("d", 6))


@query(f"WITH {MID} SELECT a.frame, a.vec_id AS a, b.vec_id AS b, round(min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)), 6) AS d FROM mid a JOIN mid b ON a.frame = b.frame AND a.vec_id < b.vec_id JOIN mp p ON p.vec_id = a.vec_id JOIN mp q ON q.vec_id = b.vec_id GROUP BY ALL")
def min_point_distance(spark, d):
    return matching.min_distances(mid(spark, d), ["frame"], "vec_id", "pts").withColumn("d", F.round("d", 6))


@query(f"""WITH {MID}, e AS (SELECT t.vec_id, t.frame, t.x, t.y, (t.x - n.x) / sqrt((t.x - n.x) ** 2 + (t.y - n.y) ** 2) AS tx, (t.y - n.y) / sqrt((t.x - n.x) ** 2 + (t.y - n.y) ** 2) AS ty FROM mp t JOIN mp n ON n.vec_id = t.vec_id AND ((t.i = 0 AND n.i = 4) OR (t.i = 31 AND n.i = 27))),
j AS (SELECT a.frame, a.vec_id AS a, b.vec_id AS b, b.x - a.x AS dx, b.y - a.y AS dy, a.tx, a.ty, b.tx AS ux, b.ty AS uy FROM e a JOIN e b ON a.frame = b.frame AND a.vec_id < b.vec_id)
SELECT frame, a, b, round(min(sqrt(dx ** 2 + dy ** 2)), 6) AS d FROM j WHERE sqrt(dx ** 2 + dy ** 2) <= 0.5 AND tx * dx + ty * dy > 0.5 * sqrt(dx ** 2 + dy ** 2) AND -(ux * dx + uy * dy) > 0.5 * sqrt(dx ** 2 + dy ** 2) GROUP BY frame, a, b""")
def two_pieces(spark, d):
    return matching.two_pieces(mid(spark, d), ["frame"], "vec_id", "pts", 0.5, 0.5).withColumn("d", F.round("d", 6))


ORIENT = MID + """, pr AS (SELECT vec_id, track, frame, lag(vec_id) OVER (PARTITION BY track ORDER BY frame, vec_id) AS p FROM mid),
ds AS (SELECT pr.vec_id, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS same, avg(sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2)) AS flip FROM pr JOIN mp a ON a.vec_id = pr.vec_id JOIN mp b ON b.vec_id = pr.p AND b.i = a.i JOIN mp c ON c.vec_id = pr.p AND c.i = 31 - a.i GROUP BY pr.vec_id)"""


def with_previous(spark, d):
    w = series.by(["track"], "frame", "vec_id")
    m = mid(spark, d).withColumn("prev", F.lag("pts").over(w))
    return m.withColumns({"same": g.mean_distance(F.col("pts"), F.col("prev")), "flip": g.mean_distance(F.col("pts"), F.reverse("prev"))})


@query(f"WITH {ORIENT} SELECT mp.vec_id, CASE WHEN same <= flip OR same IS NULL THEN mp.i ELSE 31 - mp.i END AS i, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM mp LEFT JOIN ds USING (vec_id)")
def orient_like(spark, d):
    m = with_previous(spark, d)
    return exploded(m.select("vec_id", g.orient_like(F.col("pts"), F.col("prev")).alias("p")), ["vec_id"])


@query(f"""WITH {MID}, e AS (SELECT vec_id, max(x) FILTER (i = 0) AS hx, max(y) FILTER (i = 0) AS hy, max(x) FILTER (i = 31) AS tx, max(y) FILTER (i = 31) AS ty FROM mp GROUP BY vec_id),
pr AS (SELECT vec_id, track, frame, lag(vec_id) OVER (PARTITION BY track ORDER BY frame, vec_id) AS p FROM mid),
c AS (SELECT pr.vec_id, pr.track, pr.frame, e.hx > 1 AS he, e.tx > 1 AS te, sqrt((e.hx - q.hx) ** 2 + (e.hy - q.hy) ** 2) AS hh, sqrt((e.tx - q.tx) ** 2 + (e.ty - q.ty) ** 2) AS tt, sqrt((e.hx - q.tx) ** 2 + (e.hy - q.ty) ** 2) AS ht, sqrt((e.tx - q.hx) ** 2 + (e.ty - q.hy) ** 2) AS th
FROM pr JOIN e USING (vec_id) LEFT JOIN e q ON q.vec_id = pr.p), f AS (SELECT *, CASE WHEN he AND NOT te THEN th < tt WHEN te AND NOT he THEN ht < hh ELSE ht + th < hh + tt END AS rel FROM c)
SELECT track, vec_id, sum(CASE WHEN rel THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame, vec_id) % 2 = 1 AS flipped FROM f""")
def orient_chain(spark, d):
    w = series.by(["track"], "frame", "vec_id")
    m = mid(spark, d).withColumns({"prev": F.lag("pts").over(w), "at": F.struct("frame", "vec_id")})
    p = F.col("pts")
    m = m.withColumn("c", g.continuity(p, F.col("prev"), F.element_at(p, 1)["x"] > 1, F.element_at(p, -1)["x"] > 1)).select("track", "vec_id", "at", "c.same", "c.flip")
    return series.orientation_parity(m, ["track"], "at", "same", "flip").select("track", "vec_id", "flipped")


@query(f"""WITH {SEG}, c AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my FROM mp GROUP BY vec_id), u AS (SELECT vec_id, x - mx AS u, y - my AS v FROM mp JOIN c USING (vec_id)), th AS (SELECT vec_id, 0.5 * atan2(2 * sum(u * v), sum(u * u) - sum(v * v)) AS t FROM u GROUP BY vec_id)
SELECT u.vec_id, round((max(-u * sin(t) + v * cos(t)) - min(-u * sin(t) + v * cos(t))) / 2 / any_value(len), 6) AS amp FROM u JOIN th USING (vec_id) JOIN le USING (vec_id) GROUP BY u.vec_id""")
def amplitude_pc(spark, d):
    p = F.col("pts")
    return mid(spark, d).select("vec_id", F.round(g.amplitude(p) / g.arc_length(p), 6).alias("amp"))


_W = g.gaussian_weights(1.5)
_K = ", ".join(f"({k - len(_W) // 2}, {w!r}::DOUBLE)" for k, w in enumerate(_W))
CURV = SEG + f""", wt(o, w) AS (VALUES {_K}), ex AS (SELECT vec_id, i, w, ((i + o) % 64 + 64) % 64 AS m FROM mp, wt), fx AS (SELECT vec_id, i, w, CASE WHEN m < 32 THEN m ELSE 63 - m END AS j FROM ex),
sm AS (SELECT fx.vec_id, fx.i, sum(w * x) AS x, sum(w * y) AS y FROM fx JOIN mp ON mp.vec_id = fx.vec_id AND mp.i = fx.j GROUP BY fx.vec_id, fx.i),
g1 AS (SELECT vec_id, i, CASE WHEN i = 0 THEN lead(x) OVER w - x WHEN i = 31 THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END AS dx, CASE WHEN i = 0 THEN lead(y) OVER w - y WHEN i = 31 THEN y - lag(y) OVER w ELSE (lead(y) OVER w - lag(y) OVER w) / 2 END AS dy FROM sm WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
g2 AS (SELECT *, CASE WHEN i = 0 THEN lead(dx) OVER w - dx WHEN i = 31 THEN dx - lag(dx) OVER w ELSE (lead(dx) OVER w - lag(dx) OVER w) / 2 END AS ddx, CASE WHEN i = 0 THEN lead(dy) OVER w - dy WHEN i = 31 THEN dy - lag(dy) OVER w ELSE (lead(dy) OVER w - lag(dy) OVER w) / 2 END AS ddy FROM g1 WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
kp AS (SELECT vec_id, i, (dx * ddy - dy * ddx) * len / pow(dx * dx + dy * dy, 1.5) AS k FROM g2 JOIN le USING (vec_id))"""


@query(f"WITH {CURV} SELECT vec_id, i, round(k, 4) AS k FROM kp")
def curvature49(spark, d):
    return mid(spark, d).select("vec_id", F.posexplode(g.curvature(F.col("pts"))).alias("i", "k")).withColumn("k", F.round("k", 4))


@query(f"""WITH {CURV}, z AS (SELECT vec_id, i, k, lead(k) OVER (PARTITION BY vec_id ORDER BY i) AS k1 FROM kp), c AS (SELECT vec_id, i + k / (k - k1) AS p FROM z WHERE k1 IS NOT NULL AND (k < 0) <> (k1 < 0))
SELECT v.vec_id, CASE WHEN count(p) >= 2 THEN round(2 * (max(p) - min(p)) / (count(p) - 1), 5) END AS wl FROM (SELECT DISTINCT vec_id FROM mp) v LEFT JOIN c USING (vec_id) GROUP BY v.vec_id""")
def zero_cross_wavelength(spark, d):
    return mid(spark, d).select("vec_id", F.round(g.wavelength(g.curvature(F.col("pts"))), 5).alias("wl"))


@query(f"WITH {MID} SELECT track, i, round(quantile_cont(x, 0.5), 6) AS x FROM mp GROUP BY track, i")
def elementwise_median_profile(spark, d):
    return mid(spark, d).select("track", F.posexplode("pts").alias("i", "q")).groupBy("track", "i").agg(F.round(r.median("q.x"), 6).alias("x"))


def hidden(spark, d):
    return mid(spark, d).withColumn("pts", F.transform("pts", lambda p: F.when(p["x"] >= -0.3, p)))


@query(f"WITH {MID} SELECT vec_id, CAST(count(*) FILTER (x >= -0.3) AS INTEGER) AS n, count(*) FILTER (x >= -0.3) >= 2 AS present, bool_and(x >= -0.3) AS full_ok, bool_and(x >= -0.3) FILTER (i BETWEEN 8 AND 23) AS core_ok, round(avg(x) FILTER (x >= -0.3), 6) AS cx FROM mp GROUP BY vec_id")
def visible_points(spark, d):
    p = F.col("pts")
    return hidden(spark, d).select("vec_id", g.visible(p).alias("n"), (g.visible(p) >= 2).alias("present"), g.all_visible(p).alias("full_ok"), g.all_visible(p, 8, 23).alias("core_ok"), F.round(g.centroid(p)["x"], 6).alias("cx"))


STAT = SEG + """, ty AS (SELECT track, quantile_cont(len, 0.5) * 1.1 AS body FROM le JOIN mid USING (vec_id) GROUP BY track), st AS (SELECT mid.vec_id, len, body, CASE WHEN h.x >= 0 AND t.x >= 0 THEN 'full' WHEN h.x < 0 AND t.x < 0 THEN 'both_ends_cut' WHEN len > body * 1.05 THEN 'visible_longer_than_body' WHEN t.x < 0 THEN 'tail_cut' ELSE 'head_cut' END AS status
FROM mid JOIN le USING (vec_id) JOIN ty USING (track) JOIN mp h ON h.vec_id = mid.vec_id AND h.i = 0 JOIN mp t ON t.vec_id = mid.vec_id AND t.i = 31)"""


@query(f"""WITH {STAT}, t AS (SELECT vec_id, k, status, len, CASE WHEN status = 'full' THEN k * len / 48 WHEN status = 'head_cut' THEN len - (48 - k) * body / 48 ELSE k * body / 48 END AS t FROM st, (SELECT unnest(range(0, 49)) AS k) WHERE status IN ('full', 'head_cut', 'tail_cut')),
u AS (SELECT vec_id, k, status, len, CASE WHEN abs(t) < 1e-9 THEN 0 WHEN abs(t - len) < 1e-9 THEN len ELSE t END AS t FROM t),
j AS (SELECT u.vec_id, k, t, max(i) AS i FROM u JOIN cum ON cum.vec_id = u.vec_id AND cum.c <= t AND cum.d IS NOT NULL WHERE t >= 0 AND t <= len GROUP BY u.vec_id, k, t)
SELECT j.vec_id, status, CAST(k AS INTEGER) AS i, round(x + (x1 - x) * (t - c) / d, 5) + 0 AS x, round(y + (y1 - y) * (t - c) / d, 5) + 0 AS y FROM j JOIN cum ON cum.vec_id = j.vec_id AND cum.i = j.i JOIN st ON st.vec_id = j.vec_id""")
def arc_labels(spark, d):
    m = mid(spark, d).withColumn("len", g.arc_length(F.col("pts")))
    body = m.groupBy("track").agg((r.median("len") * 1.1).alias("body"))
    m = m.join(body, "track")
    m = m.withColumn("status", g.end_statuses(F.col("len"), F.col("body"), F.get("pts", F.lit(0))["x"] < 0, F.get("pts", F.lit(31))["x"] < 0))
    m = m.withColumn("p", g.arc_labels(F.col("pts"), F.col("body"), F.col("status"), 49))
    return exploded(m, ["vec_id", "status"], digits=5).where("x is not null")


@query(f"WITH {SEG} SELECT h.vec_id, round((h.x - t.x) / sqrt((h.x - t.x) ** 2 + (h.y - t.y) ** 2), 6) AS tx, round((h.y - t.y) / sqrt((h.x - t.x) ** 2 + (h.y - t.y) ** 2), 6) AS ty FROM mp h JOIN mp t ON t.vec_id = h.vec_id AND t.i = 20 WHERE h.i = 10")
def unit_tangent(spark, d):
    t = g.tangent(F.col("pts"), 10, 20)
    return mid(spark, d).select("vec_id", F.round(t["x"], 6).alias("tx"), F.round(t["y"], 6).alias("ty"))


@query(f"WITH {MID}, c AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my FROM mp GROUP BY vec_id) SELECT vec_id, i, round(mx + (x - mx) * cos(0.5) - (y - my) * sin(0.5) + 2, 6) + 0 AS x, round(my + (x - mx) * sin(0.5) + (y - my) * cos(0.5) - 1, 6) + 0 AS y FROM mp JOIN c USING (vec_id)")
def rigid_transform(spark, d):
    return exploded(mid(spark, d).select("vec_id", g.rigid(F.col("pts"), F.lit(0.5), F.lit(2.0), F.lit(-1.0)).alias("p")), ["vec_id"])


@query(f"""WITH {MID}, v AS (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM mp WHERE x >= -0.3),
q AS (SELECT DISTINCT vec_id, i, CAST(round_even(4 + i * ((n - 9) / 6.0::DOUBLE), 0) AS BIGINT) AS k FROM v, (SELECT unnest(range(0, 7)) AS i) WHERE n >= 12)
SELECT vec_id, CAST(q.i AS INTEGER) AS i, round(x, 6) AS x FROM v JOIN q USING (vec_id, k)""")
def prompt_sampling(spark, d):
    return hidden(spark, d).select("vec_id", F.posexplode(g.prompt_points(F.col("pts"), 7)).alias("i", "q")).select("vec_id", "i", F.round("q.x", 6).alias("x"))


@query(f"WITH {MID} SELECT vec_id, round((avg(abs(x)) FILTER (i < 5)) / (avg(abs(x)) FILTER (i BETWEEN 10 AND 19)), 6) AS taper, round(avg(CASE WHEN abs(x) < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS thin FROM mp GROUP BY vec_id")
def taper_profile(spark, d):
    w = F.transform("pts", lambda p: F.abs(p["x"]))
    return mid(spark, d).select("vec_id", F.round(g.profile_ratio(w, 5), 6).alias("taper"), F.round(F.size(F.filter(w, lambda x: x < 0.5)) / F.size("pts"), 6).alias("thin"))


TRACKLET = LAB + """, dd AS (SELECT d.det_id % 20 AS tracklet, l.track, l.frame, least(avg(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)), avg(sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2))) AS dist
FROM det d JOIN lab l ON l.frame = d.frame JOIN mp p ON p.vec_id = d.det_id JOIN mp q ON q.vec_id = l.vec_id AND q.i = p.i JOIN mp s ON s.vec_id = l.vec_id AND s.i = 31 - p.i GROUP BY d.det_id, l.track, l.frame),
m AS (SELECT tracklet, track, quantile_cont(dist, 0.5) AS med, count(*) AS n FROM dd GROUP BY tracklet, track HAVING count(*) >= 3 AND quantile_cont(dist, 0.5) < 5)"""


@query(f"WITH {TRACKLET}, k AS (SELECT *, row_number() OVER (PARTITION BY tracklet ORDER BY med, track) AS r FROM m) SELECT tracklet, track, round(med, 6) AS med FROM k WHERE r = 1")
def tracklet_assign(spark, d):
    found = det(spark, d).select((F.col("det_id") % 20).alias("tracklet"), "frame", F.col("pts").alias("w"))
    labels = lab(spark, d).select("track", "frame", "pts")
    return matching.assign_tracklets(found, labels, "frame", "tracklet", "track", g.flip_distance(F.col("w"), F.col("pts")), 3, 5.0).withColumn("med", F.round("med", 6))


TARGET = 8.0


@query(f"""WITH {DET}, sg AS (SELECT vec_id, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS d FROM mp WINDOW w AS (PARTITION BY vec_id ORDER BY i)), le AS (SELECT vec_id, round(sum(d), 9) AS len FROM sg GROUP BY vec_id), m AS (SELECT det.*, len, abs(len - {TARGET}) AS away FROM det JOIN le ON vec_id = det_id),
k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det_id) AS r1, row_number() OVER (PARTITION BY frame ORDER BY len DESC, score DESC, det_id) AS r2, row_number() OVER (PARTITION BY frame ORDER BY model = 'ft' DESC, score DESC, det_id) AS r3, row_number() OVER (PARTITION BY frame ORDER BY away, score DESC, det_id) AS r4,
row_number() OVER (PARTITION BY frame, model ORDER BY score DESC, det_id) AS rm FROM m),
f AS (SELECT frame, max(det_id) FILTER (rm = 1 AND model = 'ft') AS fi, max(len) FILTER (rm = 1 AND model = 'ft') AS fl, max(away) FILTER (rm = 1 AND model = 'ft') AS fa, max(det_id) FILTER (rm = 1 AND model <> 'ft') AS oi, max(away) FILTER (rm = 1 AND model <> 'ft') AS oa FROM k GROUP BY frame)
SELECT k.frame, max(det_id) FILTER (r1 = 1) AS score, max(det_id) FILTER (r2 = 1) AS longest, max(det_id) FILTER (r3 = 1) AS ftfirst, max(det_id) FILTER (r4 = 1) AS "nearL",
any_value(CASE WHEN fi IS NULL OR (NOT fl BETWEEN 0.85 * {TARGET} AND 1.15 * {TARGET} AND oa < fa) THEN oi ELSE fi END) AS ftsafe FROM k JOIN f ON f.frame = k.frame GROUP BY k.frame""")
def rep_rules(spark, d):
    m = det(spark, d).select("frame", "det_id", "model", F.col("score").alias("sc"), F.round(g.arc_length(F.col("pts")), 9).alias("len"))
    return m.groupBy("frame").agg(*[matching.representative(rule, "sc", "len", "model", "det_id", TARGET).alias(rule) for rule in ("score", "longest", "ftfirst", "nearL", "ftsafe")])


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, a.label, b.label AS other, avg(list_distance(a.v, b.v)) AS m FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label),
s AS (SELECT vec_id, label, max(m) FILTER (label = other) AS a, min(m) FILTER (label <> other) AS b FROM p GROUP BY vec_id, label) SELECT vec_id, label, round(a, 5) AS a, round(b, 5) AS b, round((b - a) / greatest(a, b), 5) AS s FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def silhouette(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return silhouette_of(e, "vec_id", "label", "v").select("vec_id", "label", *[F.round(c, 5).alias(c) for c in "abs"])
