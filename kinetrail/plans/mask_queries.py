"""Queries of mask statistics, gated distances, label chains and mergeable track statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import digests, labels, masks, matching
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


def mask_runs(spark, d):
    """A mask per vector: a run of pixels at each of its points; what is dark are the masks of even vectors, a bit wider."""
    p = mid(spark, d).select("frame", (F.col("vec_id") % 10).alias("obj"), "vec_id", F.posexplode("pts").alias("i", "p"))
    x0 = F.floor(F.col("p.x") * 40).cast("int")
    runs = p.select("frame", "obj", "vec_id", F.floor(F.col("p.y") * 8).cast("int").alias("y"), x0.alias("x0"), (x0 + 3 + F.col("i") % 4).alias("x1"))
    dark = runs.where("vec_id % 2 = 0").select("frame", "y", (F.col("x0") - 1).alias("x0"), (F.col("x1") + 1).alias("x1"))
    objects = mid(spark, d).select("frame", (F.col("vec_id") % 10).alias("obj"), F.when(F.col("vec_id") % 7 > 0, g.arc_length(F.col("pts")) / 8).alias("length"))
    return masks.mask_statistics(runs.where("vec_id % 11 <> 0"), dark, objects, ["frame"], "obj", 25.0)


PIXELS = MID + """, rn AS (SELECT frame, vec_id % 10 AS obj, vec_id, CAST(floor(y * 8) AS INTEGER) AS y, CAST(floor(x * 40) AS INTEGER) AS x0, CAST(floor(x * 40) AS INTEGER) + 3 + i % 4 AS x1 FROM mp),
px AS (SELECT DISTINCT frame, obj, y, unnest(range(x0, x1)) AS x FROM rn WHERE vec_id % 11 <> 0), dk AS (SELECT DISTINCT frame, y, unnest(range(x0 - 1, x1 + 1)) AS x FROM rn WHERE vec_id % 2 = 0)"""


@query(f"""WITH {PIXELS}, a AS (SELECT frame, obj, count(*) AS n, count(dk.x) AS s FROM px LEFT JOIN dk USING (frame, y, x) GROUP BY frame, obj)
SELECT frame, vec_id % 10 AS obj, round(coalesce(n, 0) / 25.0::DOUBLE, 6) AS area, round(coalesce(s, 0)::DOUBLE / greatest(coalesce(n, 0), 1), 6) AS inside FROM mid LEFT JOIN a ON a.frame = mid.frame AND a.obj = vec_id % 10""".replace("SELECT frame, vec_id % 10 AS obj, round", "SELECT mid.frame, vec_id % 10 AS obj, round"))
def mask_objects(spark, d):
    return mask_runs(spark, d)[0].select("frame", "obj", R("area"), R("inside"))


@query(f"""WITH {PIXELS}, o AS (SELECT frame, sum(n * (n - 1) / 2) AS o FROM (SELECT frame, y, x, count(*) AS n FROM px GROUP BY frame, y, x) GROUP BY frame),
sg AS (SELECT vec_id, frame, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS d FROM mp WINDOW w AS (PARTITION BY vec_id ORDER BY i)), le AS (SELECT vec_id, frame, CASE WHEN vec_id % 7 > 0 THEN sum(d) / 8 END AS len FROM sg GROUP BY vec_id, frame)
SELECT frame, round(coalesce(max(o), 0) / 25.0::DOUBLE, 6) AS overlap, count(*) FILTER (len >= 0.6 AND len <= 1.3) AS n_plausible FROM le LEFT JOIN o USING (frame) GROUP BY frame""")
def mask_frames(spark, d):
    return mask_runs(spark, d)[1].select("frame", R("overlap"), "n_plausible")


@query(f"""WITH {MID}, p AS (SELECT a.frame, a.vec_id AS a, b.vec_id AS b, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM mp a JOIN mp b ON a.frame = b.frame AND a.vec_id < b.vec_id GROUP BY a.frame, a.vec_id, b.vec_id) SELECT frame, a, b, round(d, 6) AS d FROM p WHERE d < 0.02""")
def near_pairs(spark, d):
    return matching.near_distances(mid(spark, d), ["frame"], "vec_id", "pts", 0.02).select("frame", "a", "b", R("d"))


def chain_inputs(spark, d):
    """Tracks of 50 frames: labels in a third of them, two detections in half of them; every fifth frame is flagged."""
    m = mid(spark, d).select((F.col("vec_id") % 5).alias("track"), F.floor(F.col("vec_id") / 5).cast("int").alias("frame"), "vec_id", "pts")
    found = m.where("frame % 2 = 0 OR frame % 5 = 0").select("track", "frame", "pts", (F.col("vec_id") % 7 / 7.0).alias("score"), F.col("vec_id").alias("id"))
    other = m.where("frame % 4 = 0").select("track", (F.col("frame") + 1).alias("frame"), "pts", (F.col("vec_id") % 5 / 5.0).alias("score"), (F.col("vec_id") + 1_000_000).alias("id"))
    return m.where("frame % 3 = 0 AND frame % 40 > 8").select("track", "frame", "pts"), found.unionByName(other), m.where("frame % 5 = 0").select("frame").distinct()


@query(f"""WITH RECURSIVE {MID}, t AS (SELECT CAST(vec_id % 5 AS INTEGER) AS track, CAST(vec_id // 5 AS INTEGER) AS frame, vec_id FROM mid),
l AS (SELECT * FROM t WHERE frame % 3 = 0 AND frame % 40 > 8), c AS (SELECT track, frame, vec_id AS w, vec_id % 7 / 7.0::DOUBLE AS s, vec_id AS id FROM t WHERE frame % 2 = 0 OR frame % 5 = 0 UNION ALL SELECT track, frame + 1, vec_id, vec_id % 5 / 5.0::DOUBLE, vec_id + 1000000 FROM t WHERE frame % 4 = 0),
b AS (SELECT track, frame, arg_max(w, struct_pack(s := s, t := -id)) AS w, max(s) AS s FROM c GROUP BY track, frame),
j AS (SELECT track, frame, l.vec_id AS lab, b.w, b.s FROM l FULL JOIN b USING (track, frame)),
e AS (SELECT j.track, j.frame, lab, w, s, avg(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS d0, avg(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS d FROM j LEFT JOIN mp p ON p.vec_id = w LEFT JOIN mp q ON q.vec_id = lab AND q.i = p.i GROUP BY ALL),
e2 AS (SELECT e.*, (SELECT avg(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) FROM mp p JOIN mp q ON q.i = 31 - p.i WHERE p.vec_id = w AND q.vec_id = lab) AS r FROM e),
k AS (SELECT track, frame, lab, w, CASE WHEN lab IS NULL THEN 'fill' WHEN w IS NOT NULL AND frame % 5 = 0 AND s >= 0.5 AND least(d, r) > 0.15 THEN 'fix' END AS kind, row_number() OVER (PARTITION BY track ORDER BY frame) AS n FROM e2),
o AS (SELECT *, CASE WHEN kind IS NULL THEN lab ELSE w END AS own FROM k),
a AS (SELECT o.*, (SELECT min(n.frame) FROM o n WHERE n.track = o.track AND n.frame > o.frame AND n.lab IS NOT NULL) AS fa FROM o),
a2 AS (SELECT a.*, x.lab AS after FROM a LEFT JOIN o x ON x.track = a.track AND x.frame = a.fa),
st AS (SELECT track, n, frame, own, kind, false AS flipped FROM a2 WHERE n = 0 UNION ALL SELECT track, 0, -1000, NULL, NULL, false FROM (SELECT DISTINCT track FROM a2) UNION ALL
  SELECT a2.track, a2.n, a2.frame, a2.own, a2.kind, a2.kind IS NOT NULL AND coalesce((SELECT avg(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) > avg(sqrt((v.x - q.x) ** 2 + (v.y - q.y) ** 2)) FROM mp p JOIN mp v ON v.vec_id = p.vec_id AND v.i = 31 - p.i
    JOIN mp q ON q.vec_id = CASE WHEN a2.frame - st.frame <= 29 THEN st.own WHEN fa - a2.frame <= 29 THEN after END AND q.i = CASE WHEN a2.frame - st.frame <= 29 AND st.flipped THEN 31 - p.i ELSE p.i END WHERE p.vec_id = a2.own), false)
  FROM st JOIN a2 ON a2.track = st.track AND a2.n = st.n + 1)
SELECT track, frame, own AS vec_id, kind, flipped FROM st WHERE n > 0""")
def label_chain(spark, d):
    lab, found, flagged = chain_inputs(spark, d)
    out = labels.fill_and_fix(lab, found, flagged, ["track"], "frame", "pts", "score", "id", 0.15)
    # the vector whose points (or reversed points) a label has: its own frame's, or the one of the frame before
    m = mid(spark, d).select("vec_id", F.xxhash64("pts").alias("h"))
    own = out.withColumn("h", F.xxhash64(F.when(F.col("flipped"), F.reverse("pts")).otherwise(F.col("pts"))))
    return own.join(m, "h").select(F.col("track").cast("int").alias("track"), "frame", "vec_id", "kind", "flipped")


@query(f"""WITH {PTS}, v AS (SELECT video, track, cx AS x FROM pts WHERE core) SELECT CAST(video AS INTEGER) AS video, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, min(x) AS least, max(x) AS most,
true AS close FROM v GROUP BY video""")
def merged_digests(spark, d):
    """Digests per track and day part merged to videos; `close` says whether the merged median lies among the ranks that its error allows."""
    p = pts(spark, d).where("core").withColumn("part", F.col("frame") % 4)
    parts = digests.partial(p, ["video", "track", "part"], {"x": F.col("cx")}, k=400)
    whole = digests.merge(digests.merge(parts, ["video", "track"], ["x"], sketch=True), ["video"], ["x"], sketch=True)
    exact = p.groupBy("video").agg(F.percentile("cx", F.lit(0.46)).alias("lo"), F.percentile("cx", F.lit(0.54)).alias("hi"))
    close = digests.quantile("x", 0.5).between(F.col("lo"), F.col("hi"))
    return whole.join(exact, "video").select("video", "x.n", F.round(digests.mean("x"), 6).alias("mean"), F.round(digests.deviation("x"), 6).alias("sd"), "x.least", "x.most", close.alias("close"))
