"""Queries of relational operators on the star schema and the quality rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as r
from ..operators import series as s
from ..sources.views import DET, LAB, PTS, QC, det, lab, pts, qc, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def R(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def line(spark, d):
    return table(spark, d, "lineitem").withColumns({c: F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")})


LINE = "li AS (SELECT * REPLACE (l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax) FROM lineitem)"


@query(f"""WITH {LINE}, p AS (SELECT *, quantile_cont(l_extendedprice, 0.9) OVER (PARTITION BY l_linestatus) AS p FROM li)
SELECT l_linestatus, round(quantile_cont(l_discount + 0.55 * (l_tax - l_discount), 0.5), 6) AS threshold, count(*) AS n FROM p WHERE l_extendedprice >= 0.6 * p GROUP BY l_linestatus""")
def global_threshold(spark, d):
    return r.global_threshold(line(spark, d), ["l_linestatus"], "l_extendedprice", "l_tax", "l_discount").select("l_linestatus", R("threshold"), "n")


@query(f"WITH {LINE} SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS med, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(sqrt(avg(l_discount * l_discount)), 6) AS rms FROM li GROUP BY l_returnflag")
def group_median_p90(spark, d):
    price = F.col("l_extendedprice")
    out = r.quantiles(line(spark, d), ["l_returnflag"], {"med": (price, 0.5), "p90": (price, 0.9)}, {"rms": F.sqrt(F.avg(F.col("l_discount") * F.col("l_discount")))})
    return out.select("l_returnflag", R("med"), R("p90"), R("rms"))


@query(f"WITH {LINE}, s AS (SELECT l_suppkey, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM li GROUP BY l_suppkey) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) AS z FROM li JOIN s USING (l_suppkey)")
def zscore_pop(spark, d):
    return r.zscore(line(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_suppkey"], ["l_quantity"]).select("l_orderkey", "l_linenumber", F.round("l_quantity_z", 5).alias("z"))


@query(f"WITH {LINE}, v AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_discount > 0.02 THEN l_quantity END AS q FROM li), m AS (SELECT l_suppkey, quantile_cont(q, 0.5) AS m FROM v GROUP BY l_suppkey) SELECT l_orderkey, l_linenumber, round(coalesce(q, m), 6) AS q FROM v JOIN m USING (l_suppkey)")
def impute_median(spark, d):
    v = line(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).alias("v"))
    return r.impute_median(v, ["l_suppkey"], "v", "q").select("l_orderkey", "l_linenumber", R("q"))


@query(f"WITH {LINE} SELECT l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'ALL' ELSE l_linestatus END AS l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_discount, 0.5), 6) AS med, round(avg(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END), 6) AS share FROM li GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))")
def totals_grouping_sets(spark, d):
    aggregates = [F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(r.median("l_discount"), 6).alias("med"), F.round(F.avg((F.col("l_quantity") >= 25).cast("int")), 6).alias("share")]
    return r.with_totals(line(spark, d), ["l_returnflag"], "l_linestatus", aggregates)


@query(f"WITH {LINE} SELECT l_returnflag, " + ", ".join(f"round(avg(l_quantity) FILTER (l_linestatus = '{x}'), 6) AS \"{x}\"" for x in "OF") + " FROM li GROUP BY l_returnflag")
def pivot_mean(spark, d):
    return r.pivot(line(spark, d), ["l_returnflag"], "l_linestatus", ["O", "F"], F.round(F.avg("l_quantity"), 6))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{x}') AS \"{x}\"" for x in ("click", "view", "purchase", "signup", "error")) + " FROM events GROUP BY user_id")
def crosstab(spark, d):
    return r.crosstab(table(spark, d, "events"), "user_id", "event_type", ["click", "view", "purchase", "signup", "error"])


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) SELECT user_id, event_type AS vote FROM k WHERE r = 1")
def mode_vote(spark, d):
    return r.majority(table(spark, d, "events"), ["user_id"], "event_type", "vote")


@query(f"WITH {QC} SELECT video, count(*) FILTER (contains(flags, 'cluster')) AS cluster_like, count(*) FILTER (contains(flags, 'no_worm')) AS no_worm_like FROM qc GROUP BY video")
def flag_counts_substring(spark, d):
    return qc(spark, d).groupBy("video").agg(F.count_if(r.flag_like("flags", "cluster")).alias("cluster_like"), F.count_if(r.flag_like("flags", "no_worm")).alias("no_worm_like"))


@query(f"WITH {QC}, f AS (SELECT video, unnest(string_split(flags, ';')) AS flag FROM qc) SELECT video, flag, count(*) AS n FROM f WHERE flag <> '' GROUP BY video, flag")
def flag_counts_set(spark, d):
    return r.flag_counts(qc(spark, d), ["video"], "flags").select("video", F.explode("flag_counts").alias("flag", "n"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS flags FROM events GROUP BY user_id")
def flag_set_join(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(r.join_flags(F.collect_set("event_type")).alias("flags"))


STATUS = QC + ", st AS (SELECT video, frame, string_agg(label_status, ';' ORDER BY track) AS statuses, count(*) AS k FROM qc GROUP BY video, frame)"


def statuses(spark, d):
    rows = qc(spark, d).groupBy("video", "frame").agg(F.sort_array(F.collect_list(F.struct("track", "label_status"))).alias("s"), F.count(F.lit(1)).alias("k"))
    return rows.select("video", "frame", F.array_join("s.label_status", ";").alias("statuses"), "k")


@query(f"WITH {STATUS}, e AS (SELECT video, frame, unnest(string_split(statuses, ';')) AS st, generate_subscripts(string_split(statuses, ';'), 1) - 1 AS pos FROM st) SELECT video, frame, CAST(pos AS INTEGER) AS pos, CASE WHEN st IN ('-', 'no_worm') THEN '' ELSE st END AS status FROM e")
def status_explode(spark, d):
    return statuses(spark, d).select("video", "frame", F.posexplode(r.parse_status("statuses")).alias("pos", "status"))


@query(f"WITH {STATUS} SELECT video, frame, array_to_string([coalesce(string_split(statuses, ';')[i], '-') for i in range(1, 31)], ';') AS padded FROM st")
def status_pad(spark, d):
    return statuses(spark, d).select("video", "frame", F.array_join(r.pad_status(F.split("statuses", ";"), 30), ";").alias("padded"))


@query(f"WITH {STATUS} SELECT video, frame, CAST(len(list_filter(string_split(statuses, ';'), lambda x: x NOT IN ('no_midline', 'both_ends_cut', 'visible_longer_than_body', 'no_worm', '-', ''))) AS INTEGER) AS n FROM st")
def n_worms(spark, d):
    return statuses(spark, d).select("video", "frame", r.count_worms(F.split("statuses", ";")).alias("n"))


@query(f"WITH {QC} SELECT track, frame, CASE WHEN label_status = 'no_worm' THEN 0.0::DOUBLE WHEN flags <> '' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS likelihood FROM qc")
def likelihood_case(spark, d):
    return qc(spark, d).select("track", "frame", r.likelihood(F.col("label_status") == "no_worm", F.col("flags") != "").alias("likelihood"))


@query(f"WITH {PTS}, s AS (SELECT video, frame, track, CAST(row_number() OVER (PARTITION BY video, frame ORDER BY cx, track) - 1 AS INTEGER) AS slot FROM pts WHERE core) SELECT * FROM s WHERE slot < 4")
def slot_assign(spark, d):
    return r.slots(pts(spark, d).where("core"), ["video", "frame"], ["cx", "track"], 4).select("video", "frame", "track", "slot")


@query(f"""WITH {STATUS}, n AS (SELECT video, frame, k, len(list_filter(string_split(statuses, ';'), lambda x: x = 'full')) AS w FROM st), e AS (SELECT video, frame // 10 AS ep, max(w + CASE WHEN k > w THEN 1 ELSE 0 END) AS expected, max(w) AS found FROM n GROUP BY video, frame // 10)
SELECT video, CAST(ep AS BIGINT) AS ep, CAST(expected AS BIGINT) AS expected, CAST(found AS BIGINT) AS found, expected = found AS count_ok FROM e""")
def expected_count(spark, d):
    n = statuses(spark, d).withColumn("w", F.size(F.filter(F.split("statuses", ";"), lambda x: x == "full")))
    e = n.groupBy("video", F.floor(F.col("frame") / 10).alias("ep")).agg(F.max(F.col("w") + (F.col("k") > F.col("w")).cast("int")).alias("expected"), F.max("w").cast("long").alias("found"))
    return e.select("video", "ep", F.col("expected").cast("long").alias("expected"), "found", (F.col("expected") == F.col("found")).alias("count_ok"))


@query(f"""WITH {DET}, c AS (SELECT track, frame, count(*) AS n, count(DISTINCT model) AS models, arg_max(model, score) AS top, max(score) - min(score) AS spread FROM det GROUP BY track, frame)
SELECT track, count(*) AS clusters, count(*) FILTER (models = 2) AS both_models, round(avg(CASE WHEN top = 'base' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (models = 2), 6) AS base_wins, round(quantile_cont(spread, 0.5) FILTER (models = 2), 6) AS med_spread FROM c GROUP BY track""")
def dup_diagnostics(spark, d):
    c = det(spark, d).groupBy("track", "frame").agg(F.size(F.collect_set("model")).alias("models"), F.max_by("model", "score").alias("top"), (F.max("score") - F.min("score")).alias("spread"))
    both = F.col("models") == 2
    return c.groupBy("track").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(both).alias("both_models"), F.round(F.avg(F.when(both, (F.col("top") == "base").cast("double"))), 6).alias("base_wins"), F.round(r.median(F.when(both, F.col("spread"))), 6).alias("med_spread"))


@query(f"""WITH {QC}, f AS (SELECT video, frame, list_distinct(list_filter(flatten(list(string_split(flags, ';'))), lambda x: x <> '')) AS flags, list(label_status) AS st, count(*) FILTER (label_status = 'full') AS present FROM qc GROUP BY video, frame)
SELECT video, frame, NOT list_has_any(flags, ['cluster']) AND NOT list_has_any(st, ['no_worm']) AND present BETWEEN 1 AND 30 AS usable FROM f""")
def usable_frames(spark, d):
    f = qc(spark, d).groupBy("video", "frame").agg(F.array_distinct(F.flatten(F.collect_list(r.flag_set("flags")))).alias("flags"), F.collect_list("label_status").alias("st"), F.count_if(F.col("label_status") == "full").alias("present"))
    return f.select("video", "frame", r.usable(F.col("flags"), F.col("st"), ["cluster"], ["no_worm"], F.col("present"), 30).alias("usable"))


@query("WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE k <= 3")
def topk_per_group(spark, d):
    return r.top_k(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3).drop("l_extendedprice")


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE k <= 2")
def cap_per_group(spark, d):
    return r.cap_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 2)


@query("SELECT o_orderkey AS k, 'orders' AS src FROM orders UNION ALL SELECT l_orderkey, 'lineitem' FROM lineitem")
def union_by_name(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("orders").alias("src"))
    return a.unionByName(table(spark, d, "lineitem").select(F.lit("lineitem").alias("src"), F.col("l_orderkey").alias("k")))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O'")
def intersect_frames(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(li.where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def except_frames(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).exceptAll(table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 20 = 0)")
def anti_processed(spark, d):
    done = table(spark, d, "orders").where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return r.unprocessed(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_listed(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left_semi")


UPSERT = LAB + """, best AS (SELECT track, frame, arg_max(det_id, struct_pack(s := score, d := det_id)) AS b, max(score) AS s FROM det GROUP BY track, frame),
j AS (SELECT coalesce(l.track, b.track) AS track, coalesce(l.frame, b.frame) AS frame, l.vec_id AS old, b.b AS new, b.s, coalesce(l.vec_id % 2 = 0, false) AS flagged FROM lab l FULL JOIN best b ON l.track = b.track AND l.frame = b.frame),
u AS (SELECT *, CASE WHEN old IS NULL AND new IS NOT NULL THEN 'fill' WHEN flagged AND s >= 0.5 AND old <> new THEN 'fix' ELSE 'keep' END AS source FROM j)"""


@query(f"WITH {UPSERT} SELECT track, frame, source, CASE WHEN source = 'keep' THEN old ELSE new END AS id FROM u")
def upsert_fill_fix(spark, d):
    labels = lab(spark, d).select("track", "frame", F.col("vec_id").alias("id"), (F.col("vec_id") % 2 == 0).alias("flagged"))
    found = det(spark, d).select("track", "frame", F.col("det_id").alias("id"), "score", F.col("det_id").alias("tie"))
    return r.upsert(labels, found, ["track", "frame"], "id", "score", "tie", lambda a, b: a != b).select("track", "frame", "source", "id")


@query(f"WITH {LAB}, f AS (SELECT track, frame, max(det_id) AS vec_id FROM det WHERE score > 0.5 GROUP BY track, frame) SELECT * FROM f UNION ALL SELECT track, frame, vec_id FROM lab WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.track = lab.track AND f.frame = lab.frame)")
def overwrite_labels(spark, d):
    found = det(spark, d).where("score > 0.5").groupBy("track", "frame").agg(F.max("det_id").alias("vec_id"))
    return r.overwrite(lab(spark, d).select("track", "frame", "vec_id"), found, ["track", "frame"])


@query(f"WITH {QC}, t AS (SELECT DISTINCT track, frame FROM pts WHERE cy > 50) SELECT qc.track, qc.frame, array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(flags, ';'), CASE WHEN t.track IS NOT NULL THEN ['from_dtc'] ELSE [] END), lambda x: x <> ''))), ';') AS flags FROM qc LEFT JOIN t ON qc.track = t.track AND qc.frame = t.frame")
def qc_touched(spark, d):
    return r.touched(qc(spark, d), pts(spark, d).where("cy > 50"), ["track", "frame"], "flags", "from_dtc").select("track", "frame", "flags")


@query("WITH c AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) AS r FROM c) SELECT l_suppkey, p_brand AS brand FROM k WHERE r = 1")
def equi_join_majority(spark, d):
    j = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return r.majority(j, ["l_suppkey"], "p_brand", "brand")


@query("WITH s AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT l_orderkey, l_linenumber, coalesce(n_name, 'none') AS nation FROM lineitem LEFT JOIN s ON l_suppkey = s_suppkey AND s_suppkey > 3")
def lookup_default(spark, d):
    names = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_suppkey > 3").select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(names, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("n_name", F.lit("none")).alias("nation"))


@query(f"""WITH {LINE}, s AS (SELECT l_linestatus, count(*) FILTER (c) AS n, quantile_cont(l_extendedprice, 0.5) FILTER (c) AS mc, quantile_cont(l_extendedprice, 0.9) FILTER (c) AS pc, quantile_cont(l_extendedprice, 0.5) AS ma, quantile_cont(l_extendedprice, 0.9) AS pa FROM (SELECT *, l_discount > 0.03 AS c FROM li) GROUP BY l_linestatus),
k AS (SELECT l_linestatus, CASE WHEN n < 20 THEN ma ELSE mc END AS m, CASE WHEN n < 20 THEN pa ELSE pc END AS p FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_tax > 0.06 OR l_extendedprice > 1.5 * p OR (l_tax * 10 > 0.15 AND l_extendedprice > 1.2 * p AND (l_linenumber >= 4 OR l_discount > 0.35)) THEN 'cluster' WHEN l_extendedprice < 0.15 * m AND l_linestatus <> 'O' THEN 'small_fragment' ELSE 'single' END AS kind FROM li JOIN k USING (l_linestatus)""")
def const_crossjoin(spark, d):
    li = line(spark, d).withColumns({"spur": F.col("l_tax") * 10})
    loop = (F.col("l_returnflag") == "A") & (F.col("l_tax") > 0.06)
    kinds = r.classify_components(li, ["l_linestatus"], "l_extendedprice", F.col("l_discount") > 0.03, loop, "spur", "l_linenumber", "l_discount", F.col("l_linestatus") == "O")
    return kinds.select("l_orderkey", "l_linenumber", "kind")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("SELECT page_id, string_split(url, '/')[-1] AS base, regexp_replace(string_split(url, '/')[-1], '[^A-Za-z0-9._-]', '_', 'g') AS safe, regexp_extract(url, '([^/.]+)[.][^/.]*$', 1) AS stem, lpad(page_id::VARCHAR, 8, '0') AS padded FROM pages")
def url_basename(spark, d):
    base = F.element_at(F.split("url", "/"), -1)
    return table(spark, d, "pages").select("page_id", base.alias("base"), F.regexp_replace(base, "[^A-Za-z0-9._-]", "_").alias("safe"), F.regexp_extract("url", "([^/.]+)[.][^/.]*$", 1).alias("stem"), F.lpad(F.col("page_id").cast("string"), 8, "0").alias("padded"))


@query("SELECT CAST(least(floor(value / 10), 19) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 200 GROUP BY 1")
def hist_bucket(spark, d):
    return r.histogram(table(spark, d, "events"), "value", 0.0, 200.0, 20)


@query("SELECT c_mktsegment, max(c_custkey) AS latest, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY c_mktsegment")
def latest_per_key(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.max("c_custkey").alias("latest"), F.max_by("c_name", "c_custkey").alias("name"))


@query(f"""WITH {LINE}, g AS (SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS price FROM li GROUP BY l_suppkey) SELECT l_suppkey, n, price, CASE WHEN n IS NULL THEN 'no data' ELSE printf('%d rows', n) END AS report FROM g""")
def text_report(spark, d):
    price = F.try_divide(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), F.sum("l_quantity"))
    g = line(spark, d).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), price.alias("price"))
    return g.select("l_suppkey", "n", F.round("price", 4).alias("price"), F.coalesce(F.format_string("%d rows", "n"), F.lit("no data")).alias("report"))


@query("SELECT l_returnflag, round(quantile_cont(l_quantity::DOUBLE, 0.05), 6) AS p5, round(quantile_cont(l_quantity::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(l_quantity::DOUBLE, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag")
def length_percentiles(spark, d):
    p = F.percentile("l_quantity", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return line(spark, d).groupBy("l_returnflag").agg(p.alias("p")).select("l_returnflag", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))])


@query(f"""WITH {DET}, a AS (SELECT frame, model, count(*) AS n, count(*) FILTER (score BETWEEN 0.3 AND 0.9) AS plaus, max(score) AS top FROM det GROUP BY frame, model)
SELECT model, count(*) AS frames, round(avg(n), 6) AS det_per_frame, round(avg(plaus), 6) AS plaus_per_frame, round(avg(CASE WHEN plaus >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS ge1, round(avg(CASE WHEN plaus >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS ge2, round(quantile_cont(top, 0.5), 6) AS med_top FROM a GROUP BY model""")
def merge_metrics(spark, d):
    a = det(spark, d).groupBy("frame", "model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").between(0.3, 0.9)).alias("plaus"), F.max("score").alias("top"))
    return a.groupBy("model").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("n"), 6).alias("det_per_frame"), F.round(F.avg("plaus"), 6).alias("plaus_per_frame"), F.round(F.avg((F.col("plaus") >= 1).cast("double")), 6).alias("ge1"), F.round(F.avg((F.col("plaus") >= 2).cast("double")), 6).alias("ge2"), F.round(r.median("top"), 6).alias("med_top"))


@query(f"""WITH {PTS}, e AS (SELECT video, frame, max(cx) AS context, min(cx) AS area FROM pts GROUP BY video, frame), p AS (SELECT video, frame, area / context AS ratio FROM e)
SELECT video, frame, round(ratio, 6) AS ratio, CASE WHEN ratio > 1.6 THEN 'too_big' WHEN ratio < 0.3 THEN 'too_small' ELSE 'ok' END AS verdict FROM p""")
def prompt_sanity(spark, d):
    ratio = F.col("area") / F.col("context")
    e = pts(spark, d).groupBy("video", "frame").agg(F.max("cx").alias("context"), F.min("cx").alias("area"))
    return e.select("video", "frame", F.round(ratio, 6).alias("ratio"), F.when(ratio > 1.6, "too_big").when(ratio < 0.3, "too_small").otherwise("ok").alias("verdict"))


@query(f"WITH {QC}, f AS (SELECT DISTINCT video, frame, CASE WHEN flags = '' THEN 'clean' WHEN contains(flags, 'cluster') THEN 'cluster' ELSE 'context' END AS kind FROM qc), p AS (SELECT video, frame, kind, row_number() OVER (PARTITION BY video, frame ORDER BY CASE kind WHEN 'cluster' THEN 0 WHEN 'context' THEN 1 ELSE 2 END) AS r FROM f) SELECT video, frame, kind FROM p WHERE r = 1")
def frame_index(spark, d):
    kind = F.when(F.col("flags") == "", "clean").when(r.flag_like("flags", "cluster"), "cluster").otherwise("context")
    rank = F.when(F.col("kind") == "cluster", 0).when(F.col("kind") == "context", 1).otherwise(2)
    return qc(spark, d).select("video", "frame", kind.alias("kind")).groupBy("video", "frame").agg(F.min_by("kind", rank).alias("kind"))


@query("WITH f AS (SELECT regexp_replace(c_name, '[^A-Za-z]', '', 'g') AS name, c_custkey FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_custkey) - 1 AS i FROM f) SELECT c_custkey, CASE WHEN i = 0 THEN name ELSE name || '_' || i END AS file FROM k")
def name_collisions(spark, d):
    f = table(spark, d, "customer").select("c_custkey", F.regexp_replace("c_name", "[^A-Za-z]", "").alias("name"))
    i = F.row_number().over(s.by(["name"], "c_custkey")) - 1
    return f.withColumn("i", i).select("c_custkey", F.when(F.col("i") == 0, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("i").cast("string"))).alias("file"))


@query(f"WITH {DET} SELECT frame, arg_max(det_id, struct_pack(s := score, t := -det_id)) AS member FROM det GROUP BY frame")
def largest_component(spark, d):
    return r.best(det(spark, d), ["frame"], "det_id", F.struct("score", -F.col("det_id")), "member")

