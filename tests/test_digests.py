"""Digests that are merged in parts against the statistics of all rows."""

import numpy as np
from pyspark.sql import functions as F

from kinetrail.operators import digests


def test_parts_in_any_grouping_give_the_statistics_of_all_rows(spark):
    frame = spark.range(6000).select((F.col("id") % 3).alias("video"), (F.col("id") % 41).alias("track"), (F.col("id") % 7).alias("part"), F.when(F.col("id") % 11 > 0, F.pmod(F.col("id") * 7919, F.lit(10007))).alias("x"))
    parts = digests.partial(frame, ["video", "track", "part"], {"x": F.col("x")}, k=200)
    tracks = digests.merge(parts, ["video", "track"], ["x"], sketch=True)
    videos = digests.merge(tracks, ["video"], ["x"], sketch=True)
    got = {r["video"]: r for r in videos.select("video", "x", digests.mean("x").alias("mean"), digests.deviation("x").alias("sd"), *[digests.quantile("x", q).alias(f"q{q}") for q in (0.1, 0.5, 0.9)]).collect()}
    for video in range(3):
        x = np.sort([r["x"] for r in frame.where(f"video = {video} AND x IS NOT NULL").collect()]).astype(float)
        r = got[video]
        assert (r["x"]["n"], r["x"]["least"], r["x"]["most"], r["x"]["total"]) == (len(x), x[0], x[-1], x.sum())
        assert np.isclose(r["mean"], x.mean()) and np.isclose(r["sd"], x.std())
        for q in (0.1, 0.5, 0.9):
            assert abs(np.searchsorted(x, r[f"q{q}"]) / len(x) - q) < 0.04  # three times the stated rank error


def test_digests_without_values(spark):
    frame = spark.createDataFrame([(1, None), (1, None)], "k int, x double")
    one = digests.partial(frame, ["k"], {"x": F.col("x")}, k=200)
    r = digests.merge(one, ["k"], ["x"], sketch=True).select("x.n", digests.mean("x").alias("mean"), digests.deviation("x").alias("sd"), digests.quantile("x", 0.5).alias("q")).first()
    assert tuple(r) == (0, None, None, None)
    assert digests.merge(one.limit(0), ["k"], ["x"], sketch=True).count() == 0
