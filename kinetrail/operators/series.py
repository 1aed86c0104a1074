"""Operators on sequences: rows per key, ordered by an integer frame. All windows are partitioned by the key.

Missing values are null (see functions.geometry.hidden_null for NaN input). A missing frame is no previous row: use
dense_spine first where frames can be missing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.geometry import evenly, filter1d, gaussian_weights


def by(keys: list[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def dense_spine(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """One row for every frame between a key's first and last; new rows are null otherwise."""
    ends = df.groupBy(*keys).agg(F.min(frame).alias("__a"), F.max(frame).alias("__b"))
    spine = ends.select(*keys, F.explode(F.sequence("__a", "__b")).alias(frame))
    return spine.join(df, [*keys, frame], "left")


def speed(df: DataFrame, keys: list[str], frame: str, x: str, y: str, valid: str, fps: float, length: float, out: str = "speed") -> DataFrame:
    """Distance to the previous row in lengths per second, where both rows are valid."""
    w = by(keys, frame)
    d = F.sqrt((F.col(x) - F.lag(x).over(w)) ** 2 + (F.col(y) - F.lag(y).over(w)) ** 2) * (fps / length)
    return df.withColumn(out, F.when(F.col(valid) & F.lag(valid).over(w), d))


def interpolate(df: DataFrame, keys: list[str], frame: str, value: str, limit: int, out: str) -> DataFrame:
    """Linear interpolation of the first `limit` rows of each gap; a trailing gap repeats the last value as far, a leading one stays null."""
    w = by(keys, frame)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(value).cast("double").alias("y"), F.col(frame).alias("f")))
    a = F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.last(seen, True).over(by(keys, F.desc(frame)).rowsBetween(Window.unboundedPreceding, 0))  # backwards: a frame that ends with the key is aggregated anew for each row
    df = df.withColumns({"__a": a, "__b": b})
    line = F.col("__a.y") + (F.col("__b.y") - F.col("__a.y")) * (F.col(frame) - F.col("__a.f")) / (F.col("__b.f") - F.col("__a.f"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("__a").isNull() | (F.col(frame) - F.col("__a.f") > limit), None).when(F.col("__b").isNull(), F.col("__a.y")).otherwise(line)
    return df.withColumn(out, filled).drop("__a", "__b")


def centred(keys: list[str], frame: str, size: int):
    """Rows of a centred window; an even size reaches one more to the left."""
    return by(keys, frame).rowsBetween(-(size // 2), size // 2 - 1 if size % 2 == 0 else size // 2)


def rolling_median(df: DataFrame, keys: list[str], frame: str, value: str, size: int, out: str) -> DataFrame:
    return df.withColumn(out, F.percentile(value, F.lit(0.5)).over(centred(keys, frame, size)))


def rolling_mean(df: DataFrame, keys: list[str], frame: str, value: str, size: int, out: str) -> DataFrame:
    return df.withColumn(out, F.avg(value).over(centred(keys, frame, size)))


def per_key_filter(df: DataFrame, keys: list[str], frame: str, value: str, weights: list[float], out: str) -> DataFrame:
    """A weighted window over each key's whole sequence, reflected at its ends; null counts as zero. One array per key."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(frame).alias("f"), F.coalesce(F.col(value), F.lit(0.0)).alias("v")))).alias("s"))
    filtered = rows.select(*keys, F.explode(F.arrays_zip(F.col("s.f").alias("f"), filter1d(F.col("s.v"), weights).alias("v"))).alias("z"))
    return df.join(filtered.select(*keys, F.col("z.f").alias(frame), F.col("z.v").alias(out)), [*keys, frame], "left")


def box_filter(df: DataFrame, keys: list[str], frame: str, value: str, size: int, out: str) -> DataFrame:
    return per_key_filter(df, keys, frame, value, [1.0 / size] * size, out)


def gaussian_filter(df: DataFrame, keys: list[str], frame: str, value: str, sigma: float, out: str) -> DataFrame:
    return per_key_filter(df, keys, frame, value, gaussian_weights(sigma), out)


def change_rate(df: DataFrame, keys: list[str], frame: str, value: str, fps: float, out: str) -> DataFrame:
    """Absolute change from the previous row per second."""
    return df.withColumn(out, F.abs(F.col(value) - F.lag(value).over(by(keys, frame))) * fps)


def runs(df: DataFrame, keys: list[str], frame: str, flag: str, least: int) -> DataFrame:
    """Half-open runs of consecutive frames with flag, of at least `least` frames."""
    on = df.where(F.col(flag)).withColumn("__g", F.col(frame) - F.row_number().over(by(keys, frame)))
    return on.groupBy(*keys, "__g").agg(F.min(frame).alias("a"), (F.max(frame) + 1).alias("b")).where(F.col("b") - F.col("a") >= least).drop("__g")


def bridged_runs(df: DataFrame, keys: list[str], frame: str, flag: str, gap: int, least: int) -> DataFrame:
    """Inclusive runs of frames with flag that lie at most gap apart, of at least `least` frames from end to end."""
    w = by(keys, frame)
    on = df.where(F.col(flag)).withColumn("__s", F.coalesce((F.col(frame) - F.lag(frame).over(w) > gap).cast("int"), F.lit(0)))
    on = on.withColumn("__g", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return on.groupBy(*keys, "__g").agg(F.min(frame).alias("a"), F.max(frame).alias("b")).where(F.col("b") - F.col("a") + 1 >= least).drop("__g")


def merge_episodes(episodes: DataFrame, keys: list[str], margin: int) -> DataFrame:
    """Episodes (a, b) closer than twice the margin become one."""
    w = by(keys, "a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = episodes.withColumn("__s", F.coalesce((F.col("a") - before > 2 * margin).cast("int"), F.lit(0)))
    e = e.withColumn("__g", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(*keys, "__g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("__g")


def absences(df: DataFrame, keys: list[str], frame: str, most: int) -> DataFrame:
    """(a, b) frames before and after each absence of a key that is longer than one frame and at most `most`."""
    d = df.withColumn("__n", F.lead(frame).over(by(keys, frame))).withColumn("__d", F.col("__n") - F.col(frame))
    return d.where((F.col("__d") > 1) & (F.col("__d") <= most)).select(*keys, F.col(frame).alias("a"), F.col("__n").alias("b"))


def hop_windows(df: DataFrame, keys: list[str], frame: str, size: int, step: int) -> DataFrame:
    """df once per window that its frame is in, with the window's start t0: windows start at frame 0, are whole, and a shorter sequence has one window."""
    last = F.max(frame).over(Window.partitionBy(*keys)) + 1
    latest = F.greatest(last - size, F.lit(0))
    f = F.col(frame)
    first = F.greatest(F.ceil((f - size + 1) / step), F.lit(0)).cast("int")
    end = F.least(F.floor(f / step), F.floor(latest / step)).cast("int")
    starts = F.when(first <= end, F.transform(F.sequence(first, end), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("__w", starts).withColumn("t0", F.explode("__w")).drop("__w")


def orientation_parity(df: DataFrame, keys: list[str], frame: str, same: str, flip: str, out: str = "flipped") -> DataFrame:
    """Whether a row ends up reversed when each row takes the orientation nearer to its oriented predecessor: relative flips, summed modulo two."""
    w = by(keys, frame)
    rel = F.coalesce((F.col(flip) < F.col(same)).cast("int"), F.lit(0))
    return df.withColumn(out, F.sum(rel).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1)


def ema(df: DataFrame, keys: list[str], frame: str, value: str, keep: float, out: str) -> DataFrame:
    """Running mean keep * before + (1 - keep) * now, from the first row's value on: sequential within a key."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame, kind="stable")
        values, mean, means = pdf[value].to_numpy(float), None, []
        for v in values.tolist():
            mean = v if mean is None else keep * mean + (1 - keep) * v
            means.append(mean)
        return pdf.assign(**{out: np.array(means, float)})

    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])
    return df.groupBy(*keys).applyInPandas(run, schema)


def zero_cross_rate(df: DataFrame, keys: list[str], frame: str, value: str, fps: float, least: int) -> DataFrame:
    """Half the sign changes of the demeaned values per second, for keys with at least `least` values."""
    d = df.where(F.col(value).isNotNull())
    d = d.withColumn("__v", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    d = d.withColumn("__c", ((F.col("__v") < 0) != (F.lag("__v").over(by(keys, frame)) < 0)).cast("int"))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("__c").alias("c")).where(F.col("n") >= least).select(*keys, "n", (F.coalesce("c", F.lit(0)) / 2.0 * fps / F.col("n")).alias("rate"))


def reversals(df: DataFrame, keys: list[str], frame: str, forward: str, threshold: float, least: int, fps: float) -> DataFrame:
    """Runs of backward motion (forward < -threshold) of at least `least` frames per key, and per minute."""
    flagged = df.withColumn("__back", F.coalesce(F.col(forward) < -threshold, F.lit(False)))
    n = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"))
    found = runs(flagged, keys, frame, "__back", least).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = n.join(found, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("per_min", F.col("n") * 60.0 * fps / F.col("frames"))


def lerp_gaps(df: DataFrame, keys: list[str], frame: str, values: list[str], most: int) -> DataFrame:
    """Rows with linear values for the missing frames of gaps of at most `most` frames, beside df's own rows; `filled` tells them apart."""
    w = by(keys, frame)
    lead = {f"__{c}": F.lead(c).over(w) for c in [frame, *values]}
    g = df.select(*keys, frame, *values).withColumns(lead).where((F.col(f"__{frame}") - F.col(frame) > 1) & (F.col(f"__{frame}") - F.col(frame) <= most))
    g = g.withColumn("__k", F.explode(F.sequence(F.col(frame) + 1, F.col(f"__{frame}") - 1)))
    t = (F.col("__k") - F.col(frame)) / (F.col(f"__{frame}") - F.col(frame))
    filled = g.select(*keys, F.col("__k").alias(frame), *[(F.col(v) + (F.col(f"__{v}") - F.col(v)) * t).alias(v) for v in values], F.lit(True).alias("filled"))
    return df.select(*keys, frame, *values, F.lit(False).alias("filled")).unionByName(filled)


def context_stack(df: DataFrame, keys: list[str], frame: str, value: str, around: int, skip: int, out: str = "stack") -> DataFrame:
    """The values at frames f + k * skip, k from -around to around; beyond the ends the nearest end counts."""
    w = by(keys, frame)
    whole = Window.partitionBy(*keys)
    first, last = F.min_by(value, frame).over(whole), F.max_by(value, frame).over(whole)
    n, at = F.count(F.lit(1)).over(whole), F.row_number().over(w)

    def part(k: int) -> Column:
        there = F.lag(value, -k * skip).over(w) if k < 0 else F.lead(value, k * skip).over(w) if k else F.col(value)
        return F.when(at + k * skip < 1, first).when(at + k * skip > n, last).otherwise(there)

    return df.withColumn(out, F.array(*[part(k) for k in range(-around, around + 1)]))


def valid_around(df: DataFrame, keys: list[str], frame: str, valid: str, offset: int, out: str) -> DataFrame:
    """Whether the row and those `offset` rows before and after are all valid."""
    w = by(keys, frame)
    return df.withColumn(out, F.coalesce(F.col(valid) & F.lag(valid, offset).over(w) & F.lead(valid, offset).over(w), F.lit(False)))


def even_pick(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each key at equal distances in the order, ends included."""
    w = by(keys, *order)
    d = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    return d.where(F.array_contains(evenly(F.col("__n").cast("int"), k), F.col("__i"))).drop("__i", "__n")


def renumber(df: DataFrame, scope: list[str], id: str, frame: str, out: str) -> DataFrame:
    """Ids 0, 1, ... within the scope by first appearance, ties by id."""
    first = df.groupBy(*scope, id).agg(F.min(frame).alias("__f"))
    first = first.withColumn(out, F.row_number().over(by(scope, "__f", id) if scope else Window.orderBy("__f", id)) - 1)
    return df.join(first.drop("__f"), [*scope, id])


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], forward: bool = False, allow_equal: bool = True, within=None) -> DataFrame:
    """left with the values of the nearest right row at or before (or after) it: one union and one window per key, no range join.

    Ties of right rows go to the greatest values. within: a right row farther away counts as none.
    """
    columns = [c for c in left.columns]
    lhs = left.select(*[F.col(c) for c in columns], F.col(left_time).alias("__t"), F.lit(None).cast(right.select(F.struct(right_time, *values).alias("s")).schema[0].dataType).alias("__r"), F.lit(1).alias("__side"))
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in keys else F.col(c) for c in columns]
    rhs = right.select(*blank, F.col(right_time).alias("__t"), F.struct(right_time, *values).alias("__r"), F.lit(0 if allow_equal else 2).alias("__side"))
    order = [F.col("__t").desc() if forward else F.col("__t").asc(), F.col("__side"), F.col("__r").asc()]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = lhs.unionByName(rhs).withColumn("__m", F.last("__r", True).over(w)).where("__side = 1")
    if within is not None:
        far = F.col("__t") - F.col(f"__m.{right_time}") if not forward else F.col(f"__m.{right_time}") - F.col("__t")
        both = both.withColumn("__m", F.when(far <= within, F.col("__m")))
    return both.select(*columns, F.col(f"__m.{right_time}").alias(f"{right_time}_match"), *[F.col(f"__m.{v}").alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, within) -> DataFrame:
    """left with the value of the nearest right row within the distance; a row before wins a tie."""
    back = asof(left, right, keys, left_time, right_time, [value], within=within).withColumnsRenamed({f"{right_time}_match": "__t0", value: "__v0"})
    both = asof(back, right, keys, left_time, right_time, [value], forward=True, within=within).withColumnsRenamed({f"{right_time}_match": "__t1", value: "__v1"})
    earlier = F.col("__t0").isNotNull() & (F.col("__t1").isNull() | (F.col(left_time) - F.col("__t0") <= F.col("__t1") - F.col(left_time)))
    return both.withColumns({f"{right_time}_match": F.when(earlier, F.col("__t0")).otherwise(F.col("__t1")), value: F.when(earlier, F.col("__v0")).otherwise(F.col("__v1"))}).drop("__t0", "__v0", "__t1", "__v1")

