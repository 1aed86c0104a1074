"""Queries of inherently sequential or iterative operators. Greedy choices have recursive SQL; the others are tested by properties and brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import cluster, pose_features, skeleton_graph, tracking
from ..sources.views import DET, PTS, det, lab, mid, pts, table

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def checked(sql: str):
    def add(f):
        ORACLES[f.__name__] = sql
        return query(f)

    return add


#: Greedy choice: `it` has the rows of a group g in order k, `near` those (g, k, j) before a row that exclude it; `gr` has what stays of each group.
GREEDY = """nl AS (SELECT g, k, list(j) AS near FROM near GROUP BY g, k), st AS (SELECT DISTINCT g, 0::BIGINT AS k, []::BIGINT[] AS kept FROM it UNION ALL
  SELECT st.g, it.k, CASE WHEN list_has_any(st.kept, coalesce(nl.near, []::BIGINT[])) THEN st.kept ELSE list_append(st.kept, it.k) END FROM st JOIN it ON it.g = st.g AND it.k = st.k + 1 LEFT JOIN nl ON nl.g = st.g AND nl.k = it.k),
gr AS (SELECT g, arg_max(kept, k) AS kept FROM st GROUP BY g)"""
ORDERED = "it AS (SELECT frame AS g, det_id, score, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det_id) AS k FROM det WHERE {on})"
#: Flip-invariant mean distances of the detections of a frame.
FLIPPED = """ds AS (SELECT a.g, a.k, b.k AS j, least(avg(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)), avg(sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2))) AS d FROM it a JOIN it b ON a.g = b.g AND b.k < a.k
  JOIN mp p ON p.vec_id = a.det_id JOIN mp q ON q.vec_id = b.det_id AND q.i = p.i JOIN mp r ON r.vec_id = b.det_id AND r.i = 31 - p.i GROUP BY a.g, a.k, b.k)"""


@query
def track_greedy(spark, d):
    c = pts(spark, d).select(F.col("video"), "frame", F.col("track").alias("comp_id"), (F.col("cx") * 10).alias("cx"), (F.col("cy") * 10).alias("cy"), (1500 + F.col("cy") * 10).alias("area"), (F.col("cx") < 3).alias("border"))
    return tracking.track(c)


@query
def link_tracklets(spark, d):
    v = det(spark, d).select(F.col("track").alias("video"), "frame", "det_id", "m")
    return tracking.link(v, reach=12.0, gap=3, least=3)


@checked(f"""WITH RECURSIVE {DET}, c AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy FROM mp GROUP BY vec_id), {ORDERED.format(on="score > 0.1")},
near AS (SELECT a.g, a.k, b.k AS j FROM it a JOIN it b ON a.g = b.g AND b.k < a.k JOIN c p ON p.vec_id = a.det_id JOIN c q ON q.vec_id = b.det_id JOIN mid m ON m.vec_id = a.det_id JOIN mid n ON n.vec_id = b.det_id
  WHERE sqrt((p.cx - q.cx) ** 2 + (p.cy - q.cy) ** 2) < 0.3 AND list_sum([(m.m[i] - n.m[i]) ** 2 for i in range(1, 9)]) < -ln(0.01)), {GREEDY}
SELECT it.g AS frame, det_id, score FROM it JOIN gr ON gr.g = it.g AND list_contains(kept, k)""")
def nms_latent(spark, d):
    v = det(spark, d).select("frame", "det_id", "score", g.centroid(F.col("pts"))["x"].alias("cx"), g.centroid(F.col("pts"))["y"].alias("cy"), F.slice("m", 1, 8).alias("latent"))
    return tracking.suppress(v, floor=0.1, cutoff=0.3, overlap=0.01)


@checked(f"""WITH RECURSIVE {DET}, {ORDERED.format(on="true")}, {FLIPPED}, near AS (SELECT g, k, j FROM ds WHERE d <= 1.3), {GREEDY}
SELECT it.g AS frame, det_id, (list_position(max(kept), coalesce(min(j) FILTER (list_contains(kept, j)), it.k)) - 1)::BIGINT AS cluster FROM it JOIN gr ON gr.g = it.g LEFT JOIN near n ON n.g = it.g AND n.k = it.k GROUP BY it.g, det_id, it.k""")
def ensemble_clusters(spark, d):
    return tracking.cluster_detections(det(spark, d).select("frame", "det_id", "score", "m"), reach=1.3)


@query
def hungarian_score(spark, d):
    truth = lab(spark, d).select("frame", F.flatten(F.transform("pts", lambda p: F.array(p["x"], p["y"]))).alias("m"), g.arc_length(F.col("pts")).alias("len"))
    return tracking.score_frames(truth, det(spark, d).where("score > 0.3").select("frame", "m", (F.col("score") < 0.35).alias("border")))


@checked(f"""WITH RECURSIVE {DET}, {ORDERED.format(on="true")}, {FLIPPED}, near AS (SELECT g, k, j FROM ds WHERE d < 1.2), {GREEDY}
SELECT it.g AS frame, det_id FROM it JOIN gr ON gr.g = it.g AND list_contains(kept, k)""")
def distinct_midlines(spark, d):
    return tracking.distinct_midlines(det(spark, d).select("frame", "det_id", "score", "m"), reach=1.2).select("frame", "det_id")


@checked(f"""WITH RECURSIVE {PTS}, it AS (SELECT track AS g, frame, core, row_number() OVER (PARTITION BY track ORDER BY core DESC, (frame + 1)::BIGINT * 2654435761 % 4294967296) AS k FROM pts),
near AS (SELECT a.g, a.k, b.k AS j FROM it a JOIN it b ON a.g = b.g AND b.k < a.k AND abs(a.frame - b.frame) < 3), {GREEDY}
SELECT it.g AS track, frame, core::INT AS priority FROM it JOIN gr ON gr.g = it.g AND list_contains(kept, k)""")
def min_gap_thinning(spark, d):
    return tracking.thin(pts(spark, d).select("track", "frame", F.col("core").cast("int").alias("priority")), "track", "frame", 3, "priority")


def pose(spark, d):
    """49-point travelling waves, one per user: the frames' phase and path follow the events' values."""
    p = pts(spark, d).withColumn("w", F.col("track") % 7 + 1)
    x = lambda i: F.col("frame") * 4.0 + i * 11.0
    y = lambda i: 40.0 * F.sin(i * 0.18 - F.col("frame") * 0.05 * F.col("w")) + F.col("cy")
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(48)), lambda i: F.array(x(i), y(i))))
    return p.select("video", "track", "frame", F.when(F.col("core") | (F.col("frame") % 2 == 0), flat).alias("pts"), F.lit(530.0).alias("body"))


@query
def track_features(spark, d):
    return pose_features.track_features(pose(spark, d), 5.0)


@query
def window_features(spark, d):
    return pose_features.track_features(pose(spark, d), 2.0, windows=True)


@query
def welch_freq(spark, d):
    import pandas as pd

    def run(key, pdf):
        x = pdf.sort_values("frame")["cx"].to_numpy(float)
        return pd.DataFrame([{"track": key[0], "freq": pose_features.dominant_frequency([x], 2.0)}])

    return pts(spark, d).groupBy("track").applyInPandas(run, "track long, freq double")


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query
def pca_scores(spark, d):
    return cluster.pca(vectors(spark, d), "vec_id", "v", 2)[0]


@query
def ward_clusters(spark, d):
    return cluster.ward(vectors(spark, d), "label", "vec_id", "v", 3)


@query
def kmeans_pick(spark, d):
    return cluster.diverse_pick(vectors(spark, d), "vec_id", "v", 8)


def skeletons(spark, d):
    """A cross of four branches per vector, with the vector's own coordinates for bends."""
    m = mid(spark, d)
    ends = [(1, 1.0, 0.0), (2, -1.0, 0.0), (3, 0.0, 1.0), (4, 0.0, -1.0)]
    rows = []
    for k, x, y in ends:
        co = F.array(*[v for t in range(9) for v in (F.lit(t * x * 10), F.lit(t * y * 10) + (F.abs(F.get("m", F.lit(t))) if 0 < t < 8 else F.lit(0.0)))])
        rows.append(F.struct(F.lit(k).cast("long").alias("edge_id"), F.lit(0).alias("n0"), F.lit(k).alias("n1"), (80.0 + F.abs(F.get("m", F.lit(k)))).alias("len"), co.alias("co")))
    return m.select(F.col("vec_id").alias("comp_id"), F.explode(F.array(*rows)).alias("e")).select("comp_id", "e.*")


@query
def graph_paths(spark, d):
    return skeleton_graph.split_paths(skeletons(spark, d), 4.0, 160.0)


@query
def longest_trail(spark, d):
    return skeleton_graph.longest_trails(skeletons(spark, d))
