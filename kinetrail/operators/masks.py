"""Statistics of masks that are kept as pixel runs (y, x0, x1), x1 beyond the last pixel. Pixels are never expanded: every
number comes from one sweep over the ends of the runs of an image row, so work grows with the runs and not with their pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merging import plausible
from .series import by


def disjoint(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The same pixels per key as runs that neither overlap nor touch; empty runs go."""
    w = by([*keys, "y"], "x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = runs.where("x1 > x0").select(*keys, "y", "x0", "x1").withColumn("__s", F.coalesce((F.col("x0") > before).cast("int"), F.lit(1)))
    r = r.withColumn("__g", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "y", "__g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("__g")


def pixels(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("pixels"))


def common(runs: DataFrame, ground: DataFrame, frame: list[str], obj: str) -> DataFrame:
    """(frame, obj, common): pixels that an object shares with the ground. Both are disjoint runs. At each end x of a run, the
    ground's pixels before x are the lengths of its runs begun so far, less what the latest one has beyond x."""
    ends = runs.select(*frame, "y", obj, F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(-1).alias("sign")), F.struct(F.col("x1").alias("x"), F.lit(1).alias("sign")))).alias("e"))
    ends = ends.select(*frame, "y", F.col("e.x").alias("x"), obj, "e.sign", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("end"))
    begun = ground.select(*frame, "y", F.col("x0").alias("x"), F.lit(None).cast(runs.schema[obj].dataType).alias(obj), F.lit(None).cast("int").alias("sign"), (F.col("x1") - F.col("x0")).cast("long").alias("n"), F.col("x1").cast("long").alias("end"))
    w = by([*frame, "y"], "x").rangeBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.sum("n").over(w) - F.greatest(F.max("end").over(w) - F.col("x"), F.lit(0)), F.lit(0))
    return ends.unionByName(begun).withColumn("__b", before).where("sign is not null").groupBy(*frame, obj).agg(F.sum(F.col("sign") * F.col("__b")).cast("long").alias("common"))


def pair_overlap(runs: DataFrame, frame: list[str]) -> DataFrame:
    """(frame, overlap): pixels that two objects share, summed over all pairs: a pixel under d objects counts d (d - 1) / 2 times."""
    steps = runs.select(*frame, "y", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = steps.groupBy(*frame, "y", "e.x").agg(F.sum("e.d").alias("d"))
    w = by([*frame, "y"], "x")
    deep = steps.withColumns({"depth": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("x").over(w)})
    shared = F.col("depth") * (F.col("depth") - 1) / 2 * (F.col("next") - F.col("x"))
    return deep.groupBy(*frame).agg(F.coalesce(F.sum(shared), F.lit(0)).cast("long").alias("overlap"))


def mask_statistics(masks: DataFrame, ground: DataFrame, objects: DataFrame, frame: list[str], obj: str, area: Column | float, length: str = "length") -> tuple[DataFrame, DataFrame]:
    """(per object, per frame) numbers of tracked masks.

    masks: frame, obj and runs; ground: frame and runs of all that is dark; objects: a row for each object that is tracked
    in a frame, with the length of its midline relative to the body's (null or 0 without one). Per object: area relative to
    the body's and the share of it that is dark (an absent mask has area and share 0). Per frame: overlap of all pairs
    relative to the body's area, and how many lengths are plausible.
    """
    own = disjoint(masks, [*frame, obj])
    dark = disjoint(ground, frame)
    n = pixels(own, [*frame, obj])
    shared = common(own, dark, frame, obj)
    per_object = objects.join(n, [*frame, obj], "left").join(shared, [*frame, obj], "left")
    whole = F.coalesce("pixels", F.lit(0))
    per_object = per_object.select(*frame, obj, (whole / F.lit(area)).alias("area"), (F.coalesce("common", F.lit(0)) / F.greatest(whole, F.lit(1))).alias("inside"), length)
    per_frame = objects.groupBy(*frame).agg(F.count_if(F.coalesce(plausible(F.col(length), 1.0), F.lit(False))).alias("n_plausible"))
    per_frame = per_frame.join(pair_overlap(own, frame), frame, "left")
    return per_object, per_frame.select(*frame, (F.coalesce("overlap", F.lit(0)) / F.lit(area)).alias("overlap"), "n_plausible")
