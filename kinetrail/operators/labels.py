"""Labels filled and fixed from detections that were assigned to tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .series import by

#: A label's reference lies less than 30 frames away; a detection replaces a flagged label from this score on.
REACH, FIX_SCORE = 29, 0.5


def fill_and_fix(labels: DataFrame, found: DataFrame, flagged: DataFrame, keys: list[str], frame: str, pts: str, score: str, id: str, width: Column | float, reach: int = REACH, floor: float = FIX_SCORE, widths: DataFrame | None = None) -> DataFrame:
    """(keys, frame, pts, kind, flipped) of all labels after the detections were written in frame order.

    labels: keys, frame, pts (complete ones). found: keys, frame, pts, score, id; the best score of a frame counts (ties: the
    smaller id). It fills a missing label; in flagged frames (rows of some of keys and frame) it replaces one that lies more
    than width away, if its score is floor at least. kind is fill, fix or null for labels that stay. widths: a table of some of the keys
    with the column that width names, where widths differ.

    What is written takes the orientation of the nearest label at most reach frames before it, as that one stands then,
    rewritten or not; else of the nearest one at most reach frames after it, as it stood at first; else it stays as it is.
    A written label that follows another written one is turned if either its own comparison or its predecessor's turn says
    so, but not both; every other comparison begins a new chain. So turns are sums modulo two within chains, and no row
    waits for another: all is windows over each key's frames.
    """
    w = by(keys, frame)
    best = found.groupBy(*keys, frame).agg(F.max_by(F.struct(F.col(pts).alias("__w"), F.col(score).alias("__s")), F.struct(F.col(score), -F.col(id))).alias("__f")).select(*keys, frame, "__f.*")
    marks = [c for c in flagged.columns if c in (*keys, frame)]
    rows = labels.select(*keys, frame, F.col(pts).alias("__l")).join(best, [*keys, frame], "full")
    rows = rows.join(flagged.select(*marks).distinct().withColumn("__bad", F.lit(True)), marks, "left")
    if widths is not None:
        rows = rows.join(widths, [c for c in widths.columns if c in keys], "left")
    had = F.col("__l").isNotNull()
    far = g.flip_distance(F.col("__w"), F.col("__l")) > (width if isinstance(width, Column) else F.lit(width))
    kind = F.when(~had, "fill").when(F.col("__w").isNotNull() & F.col("__bad") & (F.col("__s") >= floor) & far, "fix")
    rows = rows.withColumn("kind", kind).withColumn("__own", F.when(F.col("kind").isNotNull(), F.col("__w")).otherwise(F.col("__l")))
    before = F.lag(F.struct(F.col(frame).alias("f"), F.col("__own").alias("p"), F.col("kind").isNotNull().alias("new"))).over(w)
    after = F.last(F.when(had, F.struct(F.col(frame).alias("f"), F.col("__l").alias("p"))), True).over(by(keys, F.desc(frame)).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"__b": before, "__a": after})
    near = F.coalesce(F.col(frame) - F.col("__b.f") <= reach, F.lit(False))
    ref = F.when(near, F.col("__b.p")).when(F.col("__a.f") - F.col(frame) <= reach, F.col("__a.p"))
    compared = F.when(F.col("kind").isNotNull() & ref.isNotNull(), g.let(F.struct(F.col("__own").alias("p"), ref.alias("r")), lambda s: F.struct(g.mean_distance(s["p"], s["r"]).alias("same"), g.mean_distance(F.reverse(s["p"]), s["r"]).alias("turned"))))
    rows = rows.withColumn("__c", compared)
    turn = F.coalesce(F.col("__c.turned") < F.col("__c.same"), F.lit(False)).cast("int")
    chained = F.coalesce(F.col("kind").isNotNull() & near & F.col("__b.new") & (F.col("__c.turned") != F.col("__c.same")), F.lit(False))
    rows = rows.withColumns({"__t": turn, "__n": (~chained).cast("int")})
    rows = rows.withColumn("__g", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flipped = F.sum("__t").over(by([*keys, "__g"], frame).rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    rows = rows.withColumn("flipped", flipped)
    return rows.select(*keys, frame, F.when(F.col("flipped"), F.reverse("__own")).otherwise(F.col("__own")).alias(pts), "kind", "flipped")
