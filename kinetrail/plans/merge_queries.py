"""Queries of candidates, merges, prompts, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import matching, merging, tracking
from ..operators import relational as r
from ..sources.views import DET, LAB, MID, PTS, QC, det, lab, mid, pts, qc, table

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


@query(f"WITH {QC} SELECT track, frame FROM qc WHERE NOT list_has_any(string_split(flags, ';'), ['cluster', 'touches_border'])")
def candidate_filter(spark, d):
    return merging.candidates(qc(spark, d), "flags", ("cluster", "touches_border")).select("track", "frame")


@query(f"WITH {MID} SELECT vec_id, i, round(least(x, y, 3 - 1 - x, 4 - 1 - y), 6) AS d, least(x, y, 3 - 1 - x, 4 - 1 - y) <= 0.2 AS at_edge FROM mp")
def edge_distance(spark, d):
    p = mid(spark, d).select("vec_id", F.posexplode("pts").alias("i", "p"))
    return p.select("vec_id", "i", F.round(g.edge_distance(F.col("p"), F.lit(3), F.lit(4)), 6).alias("d"), g.at_edge(F.col("p"), F.lit(3), F.lit(4), 0.2).alias("at_edge"))


SIZES = """sz AS (SELECT video, count(*) AS nf, CASE WHEN count(*) FILTER (core AND cy > 60) < 20 THEN quantile_cont(cy, 0.5) ELSE quantile_cont(cy, 0.5) FILTER (core AND cy > 60) END AS a,
  CASE WHEN count(*) FILTER (core AND cy > 60) < 20 THEN quantile_cont(len, 0.5) ELSE quantile_cont(len, 0.5) FILTER (core AND cy > 60) END AS m,
  CASE WHEN count(*) FILTER (core AND cy > 60) < 20 THEN quantile_cont(cy, 0.9) ELSE quantile_cont(cy, 0.9) FILTER (core AND cy > 60) END AS big FROM (SELECT *, cx + 50 AS len FROM pts) GROUP BY video)"""


def sized(spark, d):
    """Components with lengths, and their videos with frames and the sizes of clean components."""
    p = pts(spark, d).withColumn("len", F.col("cx") + 50)
    sizes = merging.body_sizes(p, "video", "cy", "len", F.col("core") & (F.col("cy") > 60))
    return p, sizes.join(p.groupBy("video").agg(F.count(F.lit(1)).alias("n_frames")), "video")


@query(f"WITH {PTS}, {SIZES} SELECT video, round(a, 6) AS median_area, round(m, 6) AS median_length, round(big, 6) AS big_area FROM sz")
def body_sizes(spark, d):
    return sized(spark, d)[1].select("video", R("median_area"), R("median_length"), R("big_area"))


@query(f"""WITH {PTS}, {SIZES}, t AS (SELECT video, track, count(*) AS n, greatest(stddev_pop(cx), stddev_pop(cy)) AS still, quantile_cont(cy, 0.5) AS area FROM pts WHERE core GROUP BY video, track)
SELECT video, track, n, n < greatest(5, 0.005::DOUBLE * nf) OR (still < 8 AND area < 0.3::DOUBLE * a) AS debris FROM t JOIN sz USING (video)""")
def debris_rule(spark, d):
    p, videos = sized(spark, d)
    return merging.debris(p.where("core"), videos, "video", "track", "cx", "cy", "cy")


@query(f"""WITH {PTS}, {SIZES}, t AS (SELECT video, track, quantile_cont(cx + 50, 0.5) FILTER (core) AS m, count(*) FILTER (core) AS n FROM pts GROUP BY video, track),
j AS (SELECT pts.track, frame, cx + 50 AS len, CASE WHEN t.n >= 10 THEN t.m ELSE sz.m END AS ref FROM pts JOIN sz USING (video) JOIN t USING (video, track)) SELECT track, frame, round(ref, 6) AS ref, frame % 11 <> 0 AND abs(len - ref) / ref > 0.2 AS outlier FROM j""")
def length_outliers(spark, d):
    p, videos = sized(spark, d)
    return merging.length_outliers(p, videos, "video", "track", "len", F.col("frame") % 11 == 0, F.col("core")).select("track", "frame", R("ref"), "outlier")


@query(f"""WITH {MID}, w AS (SELECT track, vec_id, avg(abs(x)) FILTER (i < 5) AS h, avg(abs(x)) FILTER (i >= 27) AS t FROM mp GROUP BY track, vec_id), a AS (SELECT track, avg(h) AS h, avg(t) AS t FROM w GROUP BY track)
SELECT track, round(CASE WHEN track % 2 = 1 THEN t ELSE h END, 6) AS head, round(CASE WHEN track % 2 = 1 THEN h ELSE t END, 6) AS tail FROM a""")
def end_widths(spark, d):
    m = mid(spark, d).withColumn("w", F.transform("pts", lambda p: F.abs(p["x"])))
    return merging.track_widths(m, ["track"], "w", F.col("track") % 2 == 1).select("track", R("head"), R("tail"))


@query(f"""WITH {PTS}, c AS (SELECT video, track, count(*) AS n, quantile_cont(cx, 0.5) AS m FROM pts GROUP BY video, track) SELECT video, track AS tracklet, row_number() OVER (PARTITION BY video ORDER BY track) - 1 + video * 2 AS track FROM c WHERE n >= 5 AND m >= 5 AND track % 3 <> 0""")
def new_tracks(spark, d):
    p = pts(spark, d).withColumnRenamed("track", "tracklet")
    taken = p.where("tracklet % 3 = 0").select("video", "tracklet").distinct()
    counts = p.where("video > 0").groupBy("video").agg((F.max("video") * 2).alias("n_tracks"))
    return merging.new_tracks(p, taken, counts, ["video"], "tracklet", "cx", 5, 5.0)


CHAIN = """s AS (SELECT track, vec_id, row_number() OVER (PARTITION BY track ORDER BY vec_id) - 1 AS k FROM mid), first AS (SELECT track, min(k) AS k FROM s WHERE k % 3 = 1 GROUP BY track), ref AS (SELECT s.track, arg_max(vec_id, s.k) AS vec_id FROM s JOIN first ON first.track = s.track AND s.k < first.k WHERE s.k % 3 = 0 GROUP BY s.track),
f AS (SELECT track, vec_id, k, lag(vec_id) OVER (PARTITION BY track ORDER BY k) AS before FROM s WHERE k % 3 = 1), p AS (SELECT f.track, f.vec_id, f.k, coalesce(before, ref.vec_id) AS prev FROM f LEFT JOIN ref USING (track)),
q AS (SELECT p.track, p.vec_id, p.k, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS same, avg(sqrt((r.x - b.x) ** 2 + (r.y - b.y) ** 2)) AS flip FROM p JOIN mp a ON a.vec_id = p.vec_id JOIN mp r ON r.vec_id = p.vec_id AND r.i = 31 - a.i LEFT JOIN mp b ON b.vec_id = p.prev AND b.i = a.i GROUP BY p.track, p.vec_id, p.k)"""


@query(f"WITH {MID}, {CHAIN} SELECT vec_id, sum(CASE WHEN flip < same THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY k) % 2 = 1 AS flipped FROM q")
def orientation_chain(spark, d):
    from ..operators.series import by

    m = mid(spark, d).withColumn("k", F.row_number().over(by(["track"], "vec_id")) - 1).select("track", "vec_id", "k", "pts")
    return merging.orientation_chain(m.where("k % 3 = 1"), m.where("k % 3 = 0"), ["track"], "k", "pts").select("vec_id", "flipped")


@query(f"""WITH {QC}, t AS (SELECT track, frame, CAST(track % 2 AS INTEGER) AS slot, CASE WHEN frame % 2 = 0 THEN 'found' ELSE 'no_midline' END AS kind FROM qc WHERE frame % 3 = 0),
p AS (SELECT qc.track, qc.frame, flags, kind, CASE WHEN slot = 0 THEN kind ELSE label_status END AS s0, CASE WHEN slot = 1 THEN kind ELSE '-' END AS s1 FROM qc LEFT JOIN t USING (track, frame)), g AS (SELECT *, CASE WHEN kind IS NULL THEN flags ELSE concat_ws(';', nullif(flags, ''), 'from_new') END AS f FROM p)
SELECT track, frame, CASE WHEN kind IS NULL THEN flags ELSE array_to_string(list_sort(list_filter(string_split(f, ';'), lambda x: x <> '')), ';') END AS flags, s0 || ';' || s1 AS status, CASE WHEN kind IS NULL THEN -1 ELSE CAST(s0 NOT IN ('', '-', 'no_midline', 'both_ends_cut', 'visible_longer_than_body') AS BIGINT) + CAST(s1 NOT IN ('', '-', 'no_midline', 'both_ends_cut', 'visible_longer_than_body') AS BIGINT) END AS worms FROM g""")
def quality_rewrite(spark, d):
    q = qc(spark, d).select("track", "frame", "flags", F.col("label_status").alias("status"), F.lit(-1).cast("long").alias("worms"))
    t = q.where("frame % 3 = 0").select("track", "frame", (F.col("track") % 2).alias("slot"), F.when(F.col("frame") % 2 == 0, "found").otherwise("no_midline").alias("kind"))
    return merging.rewrite_quality(q, t, ["track", "frame"], "flags", "status", "worms", "from_new", 2).select("track", "frame", "flags", "status", "worms")


@query(f"WITH {PTS} SELECT video, frame, count(*) AS n FROM pts WHERE cx >= floor(0.4::DOUBLE * 22) GROUP BY video, frame HAVING max(cx) <= 1.7::DOUBLE * 22")
def usable_masks(spark, d):
    return merging.usable_masks(pts(spark, d), ["video", "frame"], "cx", 22.0)


NEAR = """n AS (SELECT a.video, a.frame, a.track, min(abs(a.cx - b.cx)) AS d FROM pts a JOIN pts b ON a.video = b.video AND a.frame = b.frame AND a.track <> b.track WHERE a.core AND b.core GROUP BY a.video, a.frame, a.track)"""


@query(f"""WITH {PTS}, {NEAR}, v AS (SELECT video, track, frame AS a, lead(frame) OVER (PARTITION BY video, track ORDER BY frame) AS b FROM pts WHERE core), x AS (SELECT DISTINCT v.video, a, b FROM v JOIN n ON n.video = v.video AND n.track = v.track AND n.frame IN (v.a, v.b) AND n.d < 0.5 WHERE b - a > 1 AND b - a <= 6)
SELECT DISTINCT video, CAST(unnest(range(a + 1, b)) AS INTEGER) AS frame FROM x""")
def absorbed_mask(spark, d):
    core = pts(spark, d).where("core").select("video", "frame", "track", "cx")
    near = matching.nearest_along(core, ["video", "frame"], "track", "cx")
    return merging.absorbed_frames(core, near, "video", "track", "frame", 0.5, 6)


@query(f"WITH {QC}, {NEAR} SELECT qc.track, qc.frame FROM qc LEFT JOIN n USING (video, frame, track) WHERE label_status = 'full' AND coalesce(d >= 3 * 0.1::DOUBLE, true)")
def clean_labels(spark, d):
    core = pts(spark, d).where("core").select("video", "frame", "track", "cx")
    near = matching.nearest_along(core, ["video", "frame"], "track", "cx")
    return qc(spark, d).join(near, ["video", "frame", "track"], "left").where(merging.label_clean(F.col("label_status"), F.col("d"), 0.1)).select("track", "frame")


@query(f"WITH {PTS} SELECT track, frame FROM pts WHERE cx / 50.0::DOUBLE >= 0.9 AND cy / 500.0::DOUBLE <= 0.12 AND abs((cx + cy) / 70.0::DOUBLE - 1) <= 0.2")
def instance_gate(spark, d):
    c = F.col
    return pts(spark, d).where(merging.instance_gate(c("cx") / 50.0, c("cy") / 500.0, c("cx") + c("cy"), F.lit(70.0))).select("track", "frame")


@query(f"""WITH {MID}, p AS (SELECT frame, vec_id AS label, CAST(round_even(x * 10, 0) AS INTEGER) AS x, CAST(round_even(y * 10, 0) AS INTEGER) AS y FROM mp), runs AS (SELECT f.frame, c AS comp, y, CAST(c * 4 - 12 AS INTEGER) AS x0, CAST(c * 4 - 12 + 5 AS INTEGER) AS x1 FROM (SELECT DISTINCT frame FROM mid) f, (SELECT unnest(range(0, 6)) AS c), (SELECT CAST(unnest(range(-6, 7)) AS INTEGER) AS y)),
h AS (SELECT p.frame, label, comp, count(*) AS h FROM p JOIN runs r ON r.frame = p.frame AND r.y = p.y AND p.x BETWEEN x0 AND x1 GROUP BY p.frame, label, comp), t AS (SELECT frame, label, arg_max(comp, struct_pack(h := h, c := -comp)) AS comp, max(h) AS h FROM h GROUP BY frame, label)
SELECT frame, label, CAST(comp AS BIGINT) AS comp, round(h / 32.0::DOUBLE, 6) AS share FROM t WHERE h / 32.0::DOUBLE >= 0.3""")
def mask_of_label(spark, d):
    m = mid(spark, d)
    points = m.select("frame", F.col("vec_id").alias("label"), F.explode("pts").alias("p")).select("frame", "label", (F.col("p.x") * 10).alias("x"), (F.col("p.y") * 10).alias("y"))
    spans = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("comp")
    runs = m.select("frame").distinct().select("frame", spans).select("frame", "comp", F.explode(F.sequence(F.lit(-6), F.lit(6))).alias("y"))
    runs = runs.select("frame", F.col("comp").cast("long").alias("comp"), "y", (F.col("comp") * 4 - 12).alias("x0"), (F.col("comp") * 4 - 7).alias("x1"))
    return merging.mask_of_label(points, runs, "frame", "label", "comp", 0.3).select("frame", "label", "comp", R("share"))


def prompt_rows(spark, d):
    """Objects of episodes of ten vectors; every third has its neighbours named."""
    m = mid(spark, d).select(F.col("frame").alias("episode"), F.col("vec_id").alias("obj"), "pts", (F.col("vec_id") % 10 * 5).cast("int").alias("prompt_frame"), F.lit(3).alias("clip_start"))
    named = m.select((F.col("obj") - 1).alias("obj"), F.array("pts").alias("others")).where("obj % 3 = 0")
    return m.join(named, "obj", "left")


@query(f"""WITH {MID}, k7 AS (SELECT i AS j, CAST(round_even(4 + i * (23 / 6.0::DOUBLE), 0) AS INTEGER) AS i FROM (SELECT unnest(range(0, 7)) AS i)), k5 AS (SELECT i AS j, CAST(round_even(4 + i * (23 / 4.0::DOUBLE), 0) AS INTEGER) AS i FROM (SELECT unnest(range(0, 5)) AS i)), k4 AS (SELECT i AS j, CAST(round_even(4 + i * (23 / 3.0::DOUBLE), 0) AS INTEGER) AS i FROM (SELECT unnest(range(0, 4)) AS i)),
o AS (SELECT vec_id AS obj, frame AS episode, CAST(vec_id % 10 * 5 AS INTEGER) AS pf, vec_id % 3 = 0 AND vec_id + 1 IN (SELECT vec_id FROM mid) AS named FROM mid),
a AS (SELECT episode, obj, 1 AS label, 0 AS src, j, x FROM o JOIN mp ON vec_id = obj JOIN k7 USING (i) UNION ALL SELECT episode, obj, 0, obj + 1, j, x FROM o JOIN mp ON vec_id = obj + 1 JOIN k5 USING (i) WHERE named
UNION ALL SELECT o.episode, o.obj, 0, q.obj, j, x FROM o JOIN o q ON q.episode = o.episode AND q.obj <> o.obj AND abs(q.pf - o.pf) <= 6 JOIN mp ON vec_id = q.obj JOIN k4 USING (i) WHERE NOT o.named)
SELECT a.episode, a.obj, CAST(greatest(0, least(19, floor((pf - 3) / 2.0))) AS INTEGER) AS frame, CAST(row_number() OVER (PARTITION BY a.obj ORDER BY label DESC, src, j) - 1 AS INTEGER) AS k, label, round(x, 6) AS x FROM a JOIN o ON o.obj = a.obj""")
def prompt_builder(spark, d):
    p = merging.prompts(prompt_rows(spark, d), "episode", 2, 20)
    return p.select("episode", "obj", "frame", F.posexplode(F.arrays_zip("points", "labels")).alias("k", "z")).select("episode", "obj", "frame", "k", F.col("z.labels").alias("label"), F.round("z.points.x", 6).alias("x"))


@query(f"""WITH {PTS}, e AS (SELECT video, CAST(unnest([10, 40]) AS INTEGER) AS a, CAST(unnest([15, 45]) AS INTEGER) AS b FROM (SELECT DISTINCT video FROM pts)), c AS (SELECT DISTINCT video, frame FROM pts WHERE cx > 60 AND frame > 8),
j AS (SELECT e.video, a, b, max(frame) FILTER (frame < a) AS p, min(frame) FILTER (frame > b) AS n FROM e JOIN c USING (video) GROUP BY e.video, a, b) SELECT video, a, b, coalesce(p, n) AS start, p IS NULL AS reverse FROM j WHERE coalesce(p, n) IS NOT NULL""")
def clean_prompt(spark, d):
    p = pts(spark, d)
    e = p.select("video").distinct().select("video", F.explode(F.array(F.lit(10), F.lit(40))).alias("a")).withColumn("b", F.col("a") + 5)
    return merging.clean_prompt(e, p.where("cx > 60 and frame > 8").select("video", "frame").distinct(), ["video"], "frame")


SEGMENTS = """sg AS (SELECT vec_id, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS d FROM mp WINDOW w AS (PARTITION BY vec_id ORDER BY i)), le AS (SELECT vec_id, round(sum(d), 9) AS len FROM sg GROUP BY vec_id), m AS (SELECT det.*, len FROM det JOIN le ON vec_id = det_id)"""


def lengths(spark, d):
    return det(spark, d).withColumn("len", F.round(g.arc_length(F.col("pts")), 9))


@query(f"""WITH {DET}, {SEGMENTS}, fr AS (SELECT DISTINCT frame, CAST(frame % 3 AS INTEGER) AS clip FROM m WHERE frame % 7 <> 6), g AS (SELECT DISTINCT clip, model FROM fr, (SELECT DISTINCT model FROM m)), x AS (SELECT m.*, CAST(frame % 3 AS INTEGER) AS clip FROM m WHERE score > 0.8::DOUBLE AND frame % 7 <> 6),
f AS (SELECT g.clip, g.model, fr.frame, count(x.det_id) AS n, count(x.det_id) FILTER (len >= 0.6::DOUBLE * 8 AND len <= 1.3::DOUBLE * 8) AS p FROM g JOIN fr USING (clip) LEFT JOIN x ON x.model = g.model AND x.frame = fr.frame GROUP BY g.clip, g.model, fr.frame),
a AS (SELECT clip, model, avg(n) AS per_frame, avg(p) AS plausible, avg(CASE WHEN p >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ge2, avg(CASE WHEN p >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ge1 FROM f GROUP BY clip, model),
b AS (SELECT clip, model, quantile_cont(len, 0.5) AS median_length, (quantile_cont(len, 0.5) - 8) / 8 * 100 AS off_percent, quantile_cont(abs(len - 8), 0.5) FILTER (len >= 0.6::DOUBLE * 8 AND len <= 1.3::DOUBLE * 8) / 8 * 100 AS spread_percent, avg(CASE WHEN len < 0.85::DOUBLE * 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS short, avg(CASE WHEN len > 1.15::DOUBLE * 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS long FROM x GROUP BY clip, model)
SELECT clip, model, {", ".join(f"round({c}, 5) AS {c}" for c in ("per_frame", "plausible", "ge2", "ge1", "median_length", "off_percent", "spread_percent", "short", "long"))} FROM a JOIN b USING (clip, model)""")
def length_metrics(spark, d):
    """Three clips whose frames were not all searched; many frames are without detections of a model."""
    m = lengths(spark, d).withColumn("clip", (F.col("frame") % 3).cast("int"))
    out = merging.length_metrics(m.where("score > 0.8"), m.where("frame % 7 <> 6").select("clip", "frame"), ["clip", "model"], "frame", "len", 8.0)
    return out.select("clip", "model", *[R(c, 5) for c in ("per_frame", "plausible", "ge2", "ge1", "median_length", "off_percent", "spread_percent", "short", "long")])


@query(f"""WITH {DET}, {SEGMENTS}, c AS (SELECT frame, track, arg_max(model, struct_pack(s := score, t := -det_id)) AS best, arg_max(len, struct_pack(s := score, t := -det_id)) FILTER (model = 'base') AS b, arg_max(len, struct_pack(s := score, t := -det_id)) FILTER (model = 'ft') AS o FROM m GROUP BY frame, track)
SELECT count(*) AS clusters, count(*) FILTER (b IS NOT NULL AND o IS NOT NULL) AS duplicates, count(*) FILTER (b IS NOT NULL AND o IS NOT NULL AND best = 'base') AS base_wins, round(quantile_cont(b - o, 0.5), 6) AS length_difference FROM c""")
def duplicate_lengths(spark, d):
    return merging.duplicate_metrics(lengths(spark, d), ["frame", "track"], "model", "score", "len", "det_id", "base", "ft").select("clusters", "duplicates", "base_wins", R("length_difference"))


OBJECTS = """fr AS (SELECT DISTINCT video, frame FROM pts), ob AS (SELECT DISTINCT video, track FROM pts), x AS (SELECT fr.video, fr.frame, ob.track, coalesce(cy / 50, 0) AS area, CASE WHEN cy / 50 >= 0.15 AND core THEN cx / 20 ELSE 0 END AS sk, CASE WHEN cy / 50 >= 0.15 THEN cx / 25 ELSE 0 END AS tr FROM fr JOIN ob USING (video) LEFT JOIN pts USING (video, frame, track))"""


def tracked_objects(spark, d):
    p = pts(spark, d).withColumns({"skeleton": F.when(F.col("core"), F.col("cx") / 20), "trail": F.col("cx") / 25, "area": F.col("cy") / 50})
    frames = p.select("video", "frame").distinct()
    expected = r.product(p.select("video", "track").distinct(), frames, ["video"])
    return merging.object_metrics(p, expected, "video", "frame", "track", "area", ["skeleton", "trail"])


@query(f"""WITH {PTS}, {OBJECTS}, f AS (SELECT video, frame, bool_and(sk >= 0.6 AND sk <= 1.3) AS a, bool_and(tr >= 0.6 AND tr <= 1.3) AS b, count(*) FILTER (area < 0.15) AS l, count(*) AS n FROM x GROUP BY video, frame)
SELECT video, count(*) AS frames, round(avg(a::INT::DOUBLE), 6) AS all_skeleton, round(avg(b::INT::DOUBLE), 6) AS all_trail, round(sum(l)::DOUBLE / sum(n), 6) AS lost, (SELECT count(*) FROM ob WHERE ob.video = f.video) AS objects FROM f GROUP BY video""")
def object_metrics(spark, d):
    return tracked_objects(spark, d)[0].select("video", "frames", R("all_skeleton"), R("all_trail"), R("lost"), "objects")


@query(f"WITH {PTS}, {OBJECTS} SELECT video, track, round(avg(area), 6) AS area FROM x GROUP BY video, track")
def object_areas(spark, d):
    return tracked_objects(spark, d)[1].select("video", "track", R("area"))


@query("""WITH t AS (SELECT c_mktsegment AS video, c_name AS track, c_acctbal::DOUBLE AS b, c_custkey AS k FROM customer WHERE c_custkey % 5 = 0 AND c_mktsegment <> 'BUILDING'), v AS (SELECT DISTINCT c_mktsegment AS video FROM customer)
SELECT v.video, track, CASE WHEN track IS NULL THEN v.video || ': no tracks' ELSE track || ': L ' || printf('%.0f', b) || ' px, ' || CASE WHEN k % 2 = 0 THEN '–' ELSE printf('%.2f', b / 1000) END || ' L/s, ' || printf('%.2f', k / 7.0::DOUBLE) || ' Hz, wave ' || CASE WHEN k % 3 = 0 THEN '–' ELSE printf('%.2f', k / 11.0::DOUBLE) END || ' L, moving ' || printf('%.0f', 100 * (k % 10) / 10.0::DOUBLE) || ' %' END AS line FROM v LEFT JOIN t ON t.video = v.video""")
def track_report(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    b = F.col("c_acctbal").cast("double")
    t = c.where((k % 5 == 0) & (F.col("c_mktsegment") != "BUILDING")).select(F.col("c_mktsegment").alias("video"), F.col("c_name").alias("track"), b.alias("length"), F.when(k % 2 != 0, b / 1000).alias("speed"), (k / 7.0).alias("frequency"), F.when(k % 3 != 0, k / 11.0).otherwise(F.lit(float("nan"))).alias("wavelength"), ((k % 10) / 10.0).alias("moving"))
    return merging.track_report(c.select(F.col("c_mktsegment").alias("video")).distinct(), t, "video", "track")


WIDE = """w AS (SELECT vec_id, m, [0.1::DOUBLE + abs(m[1 + (k * 7) % 64]) for k in range(0, 49)] AS w FROM mid), z AS (SELECT vec_id, w, list_sort(w[13:37])[13] AS md, 5.0::DOUBLE + abs(m[1]) AS len FROM w)"""


@query(f"""WITH {MID}, {WIDE} SELECT vec_id, {", ".join(f"round({e}, 6) AS {n}" for n, e in (("width", "md"), ("width_length", "md / len"), ("area_length", "3.0::DOUBLE / (len * len)"), ("head", "list_avg(w[2:6]) / md"), ("tail", "list_avg(w[44:48]) / md"), ("head_quarter", "list_avg(w[7:13]) / md"), ("tail_quarter", "list_avg(w[37:43]) / md"), ("head_thin", "len(list_filter(w[1:25], lambda x: x < 0.5 * md)) / 25.0::DOUBLE"), ("tail_thin", "len(list_filter(w[25:49], lambda x: x < 0.5 * md)) / 25.0::DOUBLE")))} FROM z""")
def morphometry(spark, d):
    w = F.transform(F.sequence(F.lit(0), F.lit(48)), lambda k: 0.1 + F.abs(F.get("m", (k * 7) % 64)))
    shape = mid(spark, d).select("vec_id", merging.morphometry(w, 5.0 + F.abs(F.get("m", F.lit(0))), F.lit(3.0)).alias("s")).select("vec_id", "s.*")
    return shape.select("vec_id", *[R(c) for c in shape.columns[1:]])


@query(f"WITH {MID} SELECT vec_id, signbit(x) AS negative, signbit(x * 0) AS negative_zero FROM mp WHERE i = 3")
def sign_bits(spark, d):
    x = F.get("pts", F.lit(3))["x"]
    return mid(spark, d).select("vec_id", g.sign_bit(x).alias("negative"), g.sign_bit(x * 0).alias("negative_zero"))


@query(f"WITH {MID} SELECT vec_id, round(m[1 + len(m) // 2], 6) AS middle, ['red', 'green', 'blue'][1 + vec_id % 3] AS colour FROM mid")
def middle_and_colour(spark, d):
    colours = F.array(*map(F.lit, ("red", "green", "blue")))
    return mid(spark, d).select("vec_id", F.round(g.middle(F.col("m")), 6).alias("middle"), g.cyclic(colours, F.col("vec_id")).alias("colour"))


@query(f"WITH {PTS} SELECT track, min(frame) AS frame FROM pts WHERE cx > 30 GROUP BY track")
def first_seen(spark, d):
    return merging.first_seen(merging.complete(pts(spark, d).withColumn("cx", F.when(F.col("cx") > 30, F.col("cx"))), ["cx"]), "track", "frame")


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) AS level, count(*) AS n, 'cube' AS kind FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) UNION ALL SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus), count(*), 'rollup' FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def cube_and_rollup(spark, d):
    li = table(spark, d, "lineitem")
    columns = ["l_returnflag", "l_linestatus", (F.grouping("l_returnflag").cast("long") + F.grouping("l_linestatus").cast("long")).alias("level")]
    out = [f("l_returnflag", "l_linestatus").agg(columns[2], F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind)) for f, kind in ((li.cube, "cube"), (li.rollup, "rollup"))]
    return out[0].unionByName(out[1])


@query("SELECT o_orderpriority, year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n, min(date_diff('day', DATE '1990-01-01', o_orderdate::DATE)) AS first_day FROM orders GROUP BY ALL")
def sql_view(spark, d):
    """SQL text over a temporary view, with date parts."""
    table(spark, d, "orders").createOrReplaceTempView("kinetrail_orders")
    return spark.sql("SELECT o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, count(*) AS n, CAST(min(datediff(o_orderdate, DATE '1990-01-01')) AS BIGINT) AS first_day FROM kinetrail_orders GROUP BY 1, 2, 3")


@query()
def role_recovery(spark, d):
    flat = F.flatten(F.transform("pts", lambda p: F.array(p["x"], p["y"])))
    truth = lab(spark, d).select("frame", flat.alias("m"), g.arc_length(F.col("pts")).alias("len"), F.when(F.col("track") % 2 == 0, "base").otherwise("donor").alias("role"))
    return tracking.recovered_roles(truth, det(spark, d).where("score > 0.3").select("frame", "m"), recovered=0.2)
