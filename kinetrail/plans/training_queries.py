"""Queries of training data selection, synthetic crossings, label files and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import training
from ..sources.views import MID, PTS, mid, pts

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def R(name, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


LABELS = PTS + """, lb AS (SELECT video, track, frame, cx + 50 AS length FROM pts WHERE core), nf AS (SELECT video, max(frame) + 1 AS n, quantile_cont(cx + 50, 0.5) AS med FROM pts GROUP BY video),
ce AS (SELECT a.video, a.track, a.frame FROM lb a JOIN lb b ON b.track = a.track AND b.frame = a.frame - 2 JOIN lb c ON c.track = a.track AND c.frame = a.frame + 2 JOIN nf ON nf.video = a.video WHERE a.frame >= 5 AND a.frame < n - 5 AND (a.frame - 5) % 3 = 0)"""


def labelled(spark, d):
    p = pts(spark, d).withColumn("length", F.col("cx") + 50)
    videos = p.groupBy("video").agg((F.max("frame") + 1).alias("n_frames"), F.percentile("length", F.lit(0.5)).alias("median_length"))
    return p.where("core"), videos


def found(spark, d):
    rows, videos = labelled(spark, d)
    return training.centres(rows, videos, 5, 2, 3)


@query(f"WITH {LABELS} SELECT * FROM ce")
def training_centres(spark, d):
    return found(spark, d)


@query(f"""WITH {LABELS}, ok AS (SELECT 'video' AS mode, lb.*, length BETWEEN 0.75 * med AND 1.25 * med AS ok FROM lb JOIN nf USING (video) UNION ALL
SELECT 'track', lb.*, length BETWEEN 0.8 * own AND 1.2 * own AND length >= 0.35 * med FROM lb JOIN nf USING (video) JOIN (SELECT track, quantile_cont(length, 0.5) AS own FROM lb GROUP BY track) USING (track))
SELECT m.mode, ce.* FROM ce, (VALUES ('video'), ('track')) AS m(mode) WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.mode = m.mode AND ok.video = ce.video AND ok.frame = ce.frame AND NOT ok.ok)""")
def gated_centres(spark, d):
    rows, videos = labelled(spark, d)
    out = [training.gated(found(spark, d), rows, videos, mode).withColumn("mode", F.lit(mode)) for mode in ("video", "track")]
    return out[0].unionByName(out[1])


@query(f"""WITH {LABELS}, pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY (frame * 1000 + track)::BIGINT * 2654435761 % 4294967296, frame * 1000 + track) AS r FROM ce) WHERE r <= 20),
th AS (SELECT a.video, a.track AS other, a.frame, p.cx, p.cy FROM lb a JOIN lb b ON b.track = a.track AND b.frame = a.frame - 2 JOIN lb c ON c.track = a.track AND c.frame = a.frame + 2 JOIN pts p ON p.track = a.track AND p.frame = a.frame),
rk AS (SELECT pk.video, pk.track, pk.frame, o.other, row_number() OVER (PARTITION BY pk.video, pk.track, pk.frame ORDER BY o.other <> pk.track, sqrt((o.cx - m.cx) ** 2 + (o.cy - m.cy) ** 2), o.other) - 1 AS slot FROM pk JOIN th o ON o.video = pk.video AND o.frame = pk.frame JOIN th m ON m.video = pk.video AND m.frame = pk.frame AND m.other = pk.track)
SELECT rk.video, rk.track, rk.frame, slot::INTEGER AS slot, rk.other, round(a.cx + b.cx + c.cx, 6) AS x FROM rk JOIN pts a ON a.track = other AND a.frame = rk.frame - 2 JOIN pts b ON b.track = other AND b.frame = rk.frame JOIN pts c ON c.track = other AND c.frame = rk.frame + 2 WHERE slot < 3""")
def training_samples(spark, d):
    rows, _ = labelled(spark, d)
    lab = rows.select("video", "track", "frame", F.array(F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))).alias("pts"))
    s = training.samples(found(spark, d), lab, 2, 20, 3)
    return s.select("video", "track", "frame", "slot", "other", F.round(F.aggregate("pts", F.lit(0.0), lambda t, p: t + p[0]["x"]), 6).alias("x"))


CROSSED = MID + """, pr AS (SELECT vec_id, vec_id + 1 AS don, 2 + vec_id % 28 AS i, 3 + vec_id % 25 AS j, (vec_id % 63) / 10.0::DOUBLE AS ang, (vec_id % 5 - 2) / 10.0::DOUBLE AS off FROM mid WHERE vec_id + 1 IN (SELECT vec_id FROM mid)),
wy AS (SELECT pr.*, atan2(b.y - a.y, b.x - a.x) AS way, atan2(h.y - e.y, h.x - e.x) AS dw, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM pr JOIN mp a ON a.vec_id = pr.vec_id AND a.i = pr.i - 2 JOIN mp b ON b.vec_id = pr.vec_id AND b.i = least(pr.i + 2, 31) JOIN mp p ON p.vec_id = pr.vec_id AND p.i = pr.i
  JOIN mp e ON e.vec_id = don AND e.i = j - 2 JOIN mp h ON h.vec_id = don AND h.i = least(j + 2, 31) JOIN mp q ON q.vec_id = don AND q.i = j)"""


@query(f"""WITH {CROSSED} SELECT wy.vec_id, m.i, round(px - sin(way) * off + cos(way + ang - dw) * (m.x - qx) - sin(way + ang - dw) * (m.y - qy), 6) AS x, round(py + cos(way) * off + sin(way + ang - dw) * (m.x - qx) + cos(way + ang - dw) * (m.y - qy), 6) AS y FROM wy JOIN mp m ON m.vec_id = don""")
def synthetic_crossings(spark, d):
    m = mid(spark, d)
    k = F.col("vec_id")
    pairs = m.join(m.select((k - 1).alias("vec_id"), F.col("pts").alias("donor")), "vec_id")
    out = training.crossed(F.col("pts"), F.col("donor"), 2 + k % 28, 3 + k % 25, (k % 63) / 10.0, (k % 5 - 2) / 10.0)
    return pairs.select("vec_id", F.posexplode(out).alias("i", "p")).select("vec_id", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"""WITH {MID}, p AS (SELECT track, frame, vec_id % 2 AS who, i, x, y FROM mp WHERE vec_id % 10 < 2 AND i IN (0, 31))
SELECT 'labeled-data' AS folder, track::VARCHAR AS video, 'img' || lpad(frame::VARCHAR, 5, '0') || '.png' AS image, {", ".join(f'round(max({c}) FILTER (who = {w} AND i = {i}), 6) AS "animal{w}_{b}_{c}"' for w in (0, 1) for i, b in ((0, "head"), (31, "tail")) for c in "xy")} FROM p GROUP BY track, frame""")
def collected_labels(spark, d):
    m = mid(spark, d).where("vec_id % 10 < 2").select(F.col("track").cast("string").alias("video"), "frame", F.concat(F.lit("animal"), (F.col("vec_id") % 2).cast("string")).alias("individual"), F.explode(F.array(*[F.struct(F.lit(b).alias("bodypart"), F.get("pts", F.lit(i)).alias("p")) for i, b in ((0, "head"), (31, "tail"))])).alias("b"))
    rows = training.collected_rows(m.select("video", "frame", "individual", "b.bodypart", F.round("b.p.x", 6).alias("x"), F.round("b.p.y", 6).alias("y")), ["animal0", "animal1"], ["head", "tail"])
    return rows.withColumnsRenamed({c: c.replace("|", "_") for c in rows.columns})


@query(f"""WITH {PTS}, t AS (SELECT video, track, avg(cx) AS a, max(cy) AS b FROM pts WHERE core GROUP BY video, track), v AS (SELECT video, avg(a) AS a, avg(b) AS b FROM t GROUP BY video), u AS (SELECT video, a, b, 'track' AS kind FROM t UNION ALL SELECT video, a, b, 'video' FROM v)
SELECT video, 'mean_x' AS feature, kind, round(a, 6) AS value FROM u UNION ALL SELECT video, 'most_y', kind, round(b, 6) FROM u""")
def figure_points(spark, d):
    t = pts(spark, d).where("core").groupBy("video", "track").agg(F.avg("cx").alias("mean_x"), F.max("cy").alias("most_y"))
    v = t.groupBy("video").agg(F.avg("mean_x").alias("mean_x"), F.avg("most_y").alias("most_y"))
    return training.feature_points(t.drop("track"), v, ["mean_x", "most_y"]).select("video", "feature", "kind", R("value"))


@query(f"WITH {PTS} SELECT video, round(quantile_cont(cx, 0.5), 6) AS cx, round(quantile_cont(cy, 0.5), 6) AS cy, count(*) AS n FROM pts GROUP BY video")
def figure_labels(spark, d):
    return training.map_labels(pts(spark, d), "video", "cx", "cy").select("video", R("cx"), R("cy"), "n")


