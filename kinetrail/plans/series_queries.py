"""Queries on sequences (tracks by frame)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from ..operators import relational as r
from ..operators import series as s
from ..sources.views import PTS, pts, table

QUERIES, ORACLES = {}, {}
FPS, LENGTH = 20.0, 100.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def R(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


SPEED = PTS + """, sp AS (SELECT *, CASE WHEN core AND lag(core) OVER w THEN sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) * 0.2 END AS speed FROM pts WINDOW w AS (PARTITION BY track ORDER BY frame))"""


def with_speed(spark, d):
    return s.speed(pts(spark, d), ["track"], "frame", "cx", "cy", "core", FPS, LENGTH)


@query(f"WITH {SPEED} SELECT track, frame, round(speed, 6) AS speed FROM sp")
def speed_diff(spark, d):
    return with_speed(spark, d).select("track", "frame", R("speed"))


INTERP = PTS + """, g AS (SELECT track, video, frame, CASE WHEN core THEN cx END AS y FROM pts),
h AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS f0,
  first_value(y IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS f1 FROM g
  WINDOW b AS (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY track ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ip AS (SELECT track, video, frame, y, CASE WHEN y IS NOT NULL THEN y WHEN f0 IS NULL OR frame - f0 > 3 THEN NULL WHEN f1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (frame - f0) / (f1 - f0) END AS filled FROM h)"""


def gappy(spark, d):
    return pts(spark, d).select("track", "video", "frame", F.when(F.col("core"), F.col("cx")).alias("y"))


@query(f"WITH {INTERP} SELECT track, frame, round(filled, 6) AS filled FROM ip")
def interp_limit(spark, d):
    return s.interpolate(gappy(spark, d), ["track"], "frame", "y", 3, "filled").select("track", "frame", R("filled"))


@query(f"WITH {PTS} SELECT track, frame, round(quantile_cont(cx, 0.5) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) AS med FROM pts")
def roll_median(spark, d):
    return s.rolling_median(pts(spark, d), ["track"], "frame", "cx", 10, "med").select("track", "frame", R("med"))


@query(f"WITH {PTS} SELECT track, frame, round(avg(cx) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS mean FROM pts")
def roll_mean(spark, d):
    return s.rolling_mean(pts(spark, d), ["track"], "frame", "cx", 21, "mean").select("track", "frame", R("mean"))


def reflected_sum(weights: list[float]) -> str:
    rows = ", ".join(f"({k - len(weights) // 2}, {w!r}::DOUBLE)" for k, w in enumerate(weights))
    return f"""{PTS}, k(o, w) AS (VALUES {rows}), n AS (SELECT track, count(*) AS n FROM pts GROUP BY track),
e AS (SELECT track, frame, w, n, ((frame + o) % (2 * n) + 2 * n) % (2 * n) AS m FROM pts JOIN n USING (track), k),
f AS (SELECT track, frame, w, CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END AS j FROM e)
SELECT f.track, f.frame, round(sum(f.w * coalesce(p.cx, 0)), 6) AS out FROM f JOIN pts p ON p.track = f.track AND p.frame = f.j GROUP BY f.track, f.frame"""


@query("WITH " + reflected_sum([1.0 / 8] * 8))
def box_filter(spark, d):
    return s.box_filter(pts(spark, d), ["track"], "frame", "cx", 8, "out").select("track", "frame", R("out"))


@query("WITH " + reflected_sum(s.gaussian_weights(2.0)))
def gaussian_time(spark, d):
    return s.gaussian_filter(pts(spark, d), ["track"], "frame", "cx", 2.0, "out").select("track", "frame", R("out"))


@query(f"WITH {PTS} SELECT track, frame, round(abs(cx - lag(cx) OVER (PARTITION BY track ORDER BY frame)) * 20, 6) AS act FROM pts")
def bend_activity(spark, d):
    return s.change_rate(pts(spark, d), ["track"], "frame", "cx", FPS, "act").select("track", "frame", R("act"))


RUNS = PTS + """, g AS (SELECT track, frame, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS g FROM pts WHERE core), ru AS (SELECT track, min(frame) AS a, max(frame) + 1 AS b FROM g GROUP BY track, g HAVING count(*) >= 3)"""


@query(f"WITH {RUNS} SELECT track, a, b FROM ru")
def runs_min_len(spark, d):
    return s.runs(pts(spark, d), ["track"], "frame", "core", 3)


BRIDGED = PTS + """, g AS (SELECT track, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) > 2 THEN 1 ELSE 0 END AS s FROM pts WHERE cx > 40),
h AS (SELECT *, sum(s) OVER (PARTITION BY track ORDER BY frame) AS g FROM g), br AS (SELECT track, min(frame) AS a, max(frame) AS b FROM h GROUP BY track, g HAVING max(frame) - min(frame) + 1 >= 2)"""


def bridged(spark, d):
    return s.bridged_runs(pts(spark, d).withColumn("near", F.col("cx") > 40), ["track"], "frame", "near", 2, 2)


@query(f"WITH {BRIDGED} SELECT track, a, b FROM br")
def runs_bridged(spark, d):
    return bridged(spark, d)


MERGED = BRIDGED + """, m AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY track ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 8 THEN 1 ELSE 0 END AS s FROM br),
o AS (SELECT *, sum(s) OVER (PARTITION BY track ORDER BY a, b) AS g FROM m), ep AS (SELECT track, min(a) AS a, max(b) AS b FROM o GROUP BY track, g)"""


@query(f"WITH {MERGED} SELECT track, a, b FROM ep")
def episodes_merged(spark, d):
    return s.merge_episodes(bridged(spark, d), ["track"], 4)


@query(f"WITH {MERGED} SELECT ep.track, a, b, b - a + 1 AS frames, (b - a + 1) / 20.0 AS seconds, count(*) FILTER (cx > 40) AS n_close, round(max(cx), 6) AS peak, CASE WHEN max(cx) > 100 THEN 'pile' WHEN count(*) FILTER (cx > 40) * 2 > count(*) THEN 'contact' ELSE 'touch' END AS kind FROM ep JOIN pts ON pts.track = ep.track AND frame BETWEEN a AND b GROUP BY ep.track, a, b")
def contact_episodes(spark, d):
    e = s.merge_episodes(bridged(spark, d), ["track"], 4)
    j = e.withColumn("frame", F.explode(F.sequence("a", "b"))).join(pts(spark, d), ["track", "frame"])
    out = j.groupBy("track", "a", "b").agg(F.count_if(F.col("cx") > 40).alias("n_close"), F.max("cx").alias("peak"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("peak") > 100, "pile").when(F.col("n_close") * 2 > F.col("n"), "contact").otherwise("touch")
    return out.select("track", "a", "b", (F.col("b") - F.col("a") + 1).alias("frames"), ((F.col("b") - F.col("a") + 1) / 20.0).alias("seconds"), "n_close", R("peak"), kind.alias("kind"))


ABSENT = PTS + """, v AS (SELECT track, frame, lead(frame) OVER (PARTITION BY track ORDER BY frame) AS nf FROM pts WHERE core), ab AS (SELECT track, frame AS a, nf AS b FROM v WHERE nf - frame > 1 AND nf - frame <= 6)"""


@query(f"""WITH {ABSENT}, o AS (SELECT video, track, frame, cx FROM pts WHERE core), j AS (SELECT DISTINCT ab.track, a, b, o.track AS neighbour FROM ab JOIN pts p ON p.track = ab.track AND (p.frame = a OR p.frame = b)
JOIN o ON o.video = p.video AND o.frame = p.frame AND o.track <> p.track AND abs(o.cx - p.cx) <= 0.5) SELECT track, a, b, min(neighbour) AS neighbour, count(*) AS n FROM j GROUP BY track, a, b""")
def absorbed_gaps(spark, d):
    core = pts(spark, d).where("core")
    return matching.absorbers(core, ["video"], "track", "frame", "cx", 0.5, 6).select("track", "a", "b", "neighbour", "n")


@query(f"""WITH {PTS}, n AS (SELECT track, max(frame) + 1 AS n FROM pts GROUP BY track), w AS (SELECT track, unnest(range(0, greatest(n - 20, 0) + 1, 10)) AS t0 FROM n)
SELECT w.track, CAST(t0 AS INTEGER) AS t0, count(*) AS n, count(*) FILTER (core) AS n_core, round(avg(cx), 6) AS mean_x, round(quantile_cont(cy, 0.5), 6) AS med_y FROM w JOIN pts ON pts.track = w.track AND frame >= t0 AND frame < t0 + 20
GROUP BY w.track, t0 HAVING count(*) FILTER (core) >= 12""")
def hop_features(spark, d):
    w = s.hop_windows(pts(spark, d), ["track"], "frame", 20, 10)
    out = w.groupBy("track", "t0").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("n_core"), F.avg("cx").alias("mean_x"), r.median("cy").alias("med_y")).where("n_core >= 12")
    return out.select("track", "t0", "n", "n_core", R("mean_x"), R("med_y"))


STATE = SPEED + """, g AS (SELECT track, video, frame, core, speed AS y FROM sp), h AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS f0,
  first_value(y IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS f1 FROM g
  WINDOW b AS (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY track ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ip AS (SELECT *, CASE WHEN y IS NOT NULL THEN y WHEN f0 IS NULL OR frame - f0 > 3 THEN NULL WHEN f1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (frame - f0) / (f1 - f0) END AS filled FROM h),
sm AS (SELECT *, quantile_cont(filled, 0.5) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS v FROM ip),
tf AS (SELECT video, track, count(*) FILTER (core) / 20.0 AS core_s, quantile_cont(v, 0.5) AS speed, avg(CASE WHEN v > 8 THEN 1.0::DOUBLE WHEN v <= 8 THEN 0.0::DOUBLE END) AS frac_move, avg(CASE WHEN v <= 8 THEN 1.0::DOUBLE WHEN v > 8 THEN 0.0::DOUBLE END) AS frac_pause FROM sm GROUP BY video, track)"""


def smooth_speed(spark, d):
    sp = with_speed(spark, d)
    sp = s.interpolate(sp, ["video", "track"], "frame", "speed", 3, "filled")
    return s.rolling_median(sp, ["video", "track"], "frame", "filled", 10, "v")


def track_states(spark, d):
    v = F.col("v")
    return smooth_speed(spark, d).groupBy("video", "track").agg((F.count_if("core") / 20.0).alias("core_s"), r.median("v").alias("speed"), F.avg((v > 8).cast("double")).alias("frac_move"), F.avg((v <= 8).cast("double")).alias("frac_pause"))


@query(f"WITH {STATE} SELECT video, track, core_s, round(speed, 6) AS speed, round(frac_move, 6) AS frac_move, round(frac_pause, 6) AS frac_pause FROM tf WHERE core_s >= 1")
def state_fractions(spark, d):
    return track_states(spark, d).where("core_s >= 1").select("video", "track", "core_s", R("speed"), R("frac_move"), R("frac_pause"))


@query(f"WITH {STATE} SELECT video, round(sum(speed * core_s) / sum(CASE WHEN speed IS NOT NULL THEN core_s END), 6) AS speed, round(sum(frac_move * core_s) / sum(CASE WHEN frac_move IS NOT NULL THEN core_s END), 6) AS frac_move FROM tf GROUP BY video")
def weighted_video_summary(spark, d):
    return r.weighted_mean(track_states(spark, d), ["video"], ["speed", "frac_move"], "core_s").select("video", R("speed"), R("frac_move"))


@query(f"""WITH {PTS}, v AS (SELECT track, frame, cx - lag(cx) OVER (PARTITION BY track ORDER BY frame) AS fw FROM pts), g AS (SELECT track, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS g FROM v WHERE fw < -1),
k AS (SELECT track, g FROM g GROUP BY track, g HAVING count(*) >= 2), c AS (SELECT track, count(*) AS n FROM k GROUP BY track), a AS (SELECT track, count(*) AS frames FROM pts GROUP BY track)
SELECT a.track, frames, coalesce(n, 0) AS n, round(coalesce(n, 0) * 1200.0 / frames, 6) AS per_min FROM a LEFT JOIN c USING (track)""")
def reversals(spark, d):
    p = pts(spark, d)
    p = p.withColumn("fw", F.col("cx") - F.lag("cx").over(s.by(["track"], "frame")))
    return s.reversals(p, ["track"], "frame", "fw", 1.0, 2, FPS).select("track", "frames", "n", R("per_min"))


@query(f"""WITH {PTS}, a AS (SELECT track, frame, cx - avg(cx) OVER (PARTITION BY track) AS v FROM pts), b AS (SELECT track, (v < 0) <> (lag(v) OVER (PARTITION BY track ORDER BY frame) < 0) AS c FROM a)
SELECT track, count(*) AS n, round(count(*) FILTER (c) / 2.0 * 20 / count(*), 6) AS rate FROM b GROUP BY track HAVING count(*) >= 20""")
def zero_cross_rate(spark, d):
    return s.zero_cross_rate(pts(spark, d), ["track"], "frame", "cx", FPS, 20).select("track", "n", R("rate"))


@query(f"WITH {PTS} SELECT track, frame, coalesce(core AND lag(core, 4) OVER w AND lead(core, 4) OVER w, false) AS ok FROM pts WINDOW w AS (PARTITION BY track ORDER BY frame)")
def window3_valid(spark, d):
    return s.valid_around(pts(spark, d), ["track"], "frame", "core", 4, "ok").select("track", "frame", "ok")


@query(f"""WITH {PTS}, n AS (SELECT track, max(frame) AS n FROM pts GROUP BY track), e AS (SELECT track, frame, k, least(greatest(frame + 4 * k, 0), n) AS f FROM pts JOIN n USING (track), (SELECT unnest(range(-5, 6)) AS k))
SELECT e.track, e.frame, string_agg(round(p.cx, 4)::VARCHAR, ',' ORDER BY k) AS stack FROM e JOIN pts p ON p.track = e.track AND p.frame = e.f GROUP BY e.track, e.frame""")
def context_stack(spark, d):
    st = s.context_stack(pts(spark, d), ["track"], "frame", "cx", 5, 4)
    return st.select("track", "frame", F.array_join(F.transform("stack", lambda x: F.round(x, 4).cast("string")), ",").alias("stack"))


@query(f"""WITH {PTS}, v AS (SELECT track, frame, cx, cy, lead(frame) OVER w AS nf, lead(cx) OVER w AS nx, lead(cy) OVER w AS ny FROM pts WHERE core WINDOW w AS (PARTITION BY track ORDER BY frame)),
g AS (SELECT *, unnest(range(frame + 1, nf)) AS k FROM v WHERE nf - frame > 1 AND nf - frame <= 4)
SELECT track, frame, round(cx, 6) AS cx, round(cy, 6) AS cy, false AS filled FROM v UNION ALL
SELECT track, CAST(k AS INTEGER), round(cx + (nx - cx) * ((k - frame) / (nf - frame)), 6), round(cy + (ny - cy) * ((k - frame) / (nf - frame)), 6), true FROM g""")
def lerp_gaps(spark, d):
    return s.lerp_gaps(pts(spark, d).where("core"), ["track"], "frame", ["cx", "cy"], 4).select("track", "frame", R("cx"), R("cy"), "filled")


def trades(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("k"), F.col("o_orderkey").alias("t"))
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("k"), (F.col("event_id") * 5).alias("et"), "value")
    return o, e


ASOF = "o AS (SELECT o_orderkey AS id, o_custkey % 50 AS k, o_orderkey AS t FROM orders), e AS (SELECT user_id % 50 AS k, event_id * 5 AS et, value FROM events)"


@query(f"WITH {ASOF} SELECT id, o.k, t, et AS et_match, value FROM o ASOF LEFT JOIN e ON o.k = e.k AND o.t >= e.et")
def asof_backward(spark, d):
    o, e = trades(spark, d)
    return s.asof(o, e, ["k"], "t", "et", ["value"])


@query(f"WITH {ASOF} SELECT id, o.k, t, CASE WHEN et - t <= 300 THEN et END AS et_match, CASE WHEN et - t <= 300 THEN value END AS value FROM o ASOF LEFT JOIN e ON o.k = e.k AND o.t <= e.et")
def asof_forward(spark, d):
    o, e = trades(spark, d)
    return s.asof(o, e, ["k"], "t", "et", ["value"], forward=True, within=300)


@query(f"""WITH {ASOF}, b AS (SELECT id, et AS t0, value AS v0 FROM o ASOF JOIN e ON o.k = e.k AND o.t >= e.et WHERE t - et <= 300), a AS (SELECT id, et AS t1, value AS v1 FROM o ASOF JOIN e ON o.k = e.k AND o.t <= e.et WHERE et - t <= 300)
SELECT id, k, t, CASE WHEN t0 IS NOT NULL AND (t1 IS NULL OR t - t0 <= t1 - t) THEN t0 ELSE t1 END AS et_match, CASE WHEN t0 IS NOT NULL AND (t1 IS NULL OR t - t0 <= t1 - t) THEN v0 ELSE v1 END AS value FROM o LEFT JOIN b USING (id) LEFT JOIN a USING (id)""")
def asof_nearest(spark, d):
    o, e = trades(spark, d)
    return s.nearest(o, e, ["k"], "t", "et", "value", 300)


@query(f"WITH {PTS} SELECT track, count(*) AS n_frames, min(frame) AS first_frame, max(frame) AS last_frame, round(quantile_cont(cx, 0.5), 6) AS med_x, bool_or(core) AS any_core, bool_and(core) AS all_core, arg_max(frame, cx) AS peak FROM pts GROUP BY track")
def track_stats(spark, d):
    peak = F.max_by("frame", F.when(F.col("cx").isNotNull(), F.struct("cx", -F.col("frame"))))  # of equal values the first frame
    return pts(spark, d).groupBy("track").agg(F.count(F.lit(1)).alias("n_frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.round(r.median("cx"), 6).alias("med_x"), F.bool_or("core").alias("any_core"), F.bool_and("core").alias("all_core"), peak.alias("peak"))


@query(f"""WITH {PTS}, n AS (SELECT max(frame) + 1 AS n FROM pts), a AS (SELECT track, count(*) AS n_frames, stddev_pop(cx) AS sx, stddev_pop(cy) AS sy, quantile_cont(cx, 0.5) AS area FROM pts GROUP BY track)
SELECT track, n_frames, n_frames < greatest(60, 0.005 * n) OR (sx < 40 AND sy < 28 AND area < 18) AS debris FROM a, n""")
def track_debris(spark, d):
    p = pts(spark, d)
    n = p.agg((F.max("frame") + 1).alias("n"))
    a = p.groupBy("track").agg(F.count(F.lit(1)).alias("n_frames"), F.stddev_pop("cx").alias("sx"), F.stddev_pop("cy").alias("sy"), r.median("cx").alias("area")).crossJoin(F.broadcast(n))
    debris = (F.col("n_frames") < F.greatest(F.lit(60.0), 0.005 * F.col("n"))) | ((F.col("sx") < 40) & (F.col("sy") < 28) & (F.col("area") < 18))
    return a.select("track", "n_frames", debris.alias("debris"))


@query("WITH f AS (SELECT user_id % 5 AS video, user_id AS track, min(event_id) AS f FROM events GROUP BY user_id) SELECT video, track, CAST(row_number() OVER (PARTITION BY video ORDER BY f, track) - 1 AS INTEGER) AS new_id FROM f")
def renumber_tracks(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("video"), F.col("user_id").alias("track"), "event_id")
    return s.renumber(e, ["video"], "track", "event_id", "new_id").select("video", "track", "new_id").distinct()


@query(f"WITH {PTS}, v AS (SELECT track, frame - lag(frame) OVER w AS gap, (cx - lag(cx) OVER w) * cos(cy) + (cy - lag(cy) OVER w) * sin(cy) AS dot FROM pts WHERE core WINDOW w AS (PARTITION BY track ORDER BY frame)) SELECT track, round(coalesce(sum(dot) FILTER (gap <= 3), 0), 5) AS score, coalesce(sum(dot) FILTER (gap <= 3), 0) < 0 AS flip FROM v GROUP BY track")
def orient_score(spark, d):
    w = s.by(["track"], "frame")
    v = pts(spark, d).where("core").withColumns({"gap": F.col("frame") - F.lag("frame").over(w), "dot": (F.col("cx") - F.lag("cx").over(w)) * F.cos("cy") + (F.col("cy") - F.lag("cy").over(w)) * F.sin("cy")})
    score = F.coalesce(F.sum(F.when(F.col("gap") <= 3, F.col("dot"))), F.lit(0.0))
    return v.groupBy("track").agg(F.round(score, 5).alias("score"), (score < 0).alias("flip"))


@query("WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 OR list_contains([floor(k * (n - 1) / 3.0)::BIGINT for k in range(0, 4)], i)")
def even_pick(spark, d):
    return s.even_pick(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4)


@query(f"""WITH RECURSIVE {PTS}, e AS (SELECT track, frame, cx AS v FROM pts WHERE frame = 0 UNION ALL SELECT p.track, p.frame, 0.9::DOUBLE * e.v + (1 - 0.9::DOUBLE) * p.cx FROM e JOIN pts p ON p.track = e.track AND p.frame = e.frame + 1) SELECT track, frame, round(v, 6) AS v FROM e""")
def ema_state(spark, d):
    return s.ema(pts(spark, d), ["track"], "frame", "cx", 0.9, "v").select("track", "frame", R("v"))


@query(f"""WITH {MERGED}, c AS (SELECT track, frame, cx FROM pts WHERE core), q AS (SELECT track, a AS ep, a, b FROM ep),
j AS (SELECT q.*, c.frame AS f, CASE WHEN a - c.frame BETWEEN 0 AND 2 THEN 0 WHEN c.frame - b BETWEEN 0 AND 2 THEN 1 ELSE 2 END AS side, CASE WHEN a - c.frame BETWEEN 0 AND 2 THEN a - c.frame WHEN c.frame - b BETWEEN 0 AND 2 THEN c.frame - b ELSE -cx END AS cost
FROM q JOIN c ON c.track = q.track AND c.frame BETWEEN a - 10 AND b + 10), k AS (SELECT *, row_number() OVER (PARTITION BY track, ep ORDER BY side, cost, f DESC) AS r FROM j) SELECT track, ep, f AS frame, side FROM k WHERE r = 1""")
def prompt_search(spark, d):
    from ..operators.matching import prompt_frames

    p = pts(spark, d)
    q = s.merge_episodes(bridged(spark, d), ["track"], 4).select("track", F.col("a").alias("ep"), "a", "b")
    return prompt_frames(q, p.where("core").select("track", "frame", F.col("cx").alias("clean")), ["track"], 2, 10)
