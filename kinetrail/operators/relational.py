"""Relational operators: aggregates, selections, flags, joins with priorities, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(x: str | Column) -> Column:
    """Exact median with interpolation; nulls are left out."""
    return F.percentile(x, F.lit(0.5))


def p90(x: str | Column) -> Column:
    return F.percentile(x, F.lit(0.9))


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], also: dict[str, Column] | None = None, accuracy: int = 10000) -> DataFrame:
    """Exact quantiles with interpolation per key, for keys with few and large groups: wanted has (values, share) by name, also more
    aggregates. The same numbers as F.percentile, which takes all distinct values of a group to one task. A first pass finds by a sketch two
    values that each quantile lies between; a second counts those below, and only the distinct values between the two, some
    rows / accuracy, meet in a task. Groups of up to `accuracy` values meet whole. Nulls are left out of values; a null key is a group."""
    also = also or {}
    value = {n: c.cast("double") for n, (c, _) in wanted.items()}

    def ends(n: str) -> Column:
        share = wanted[n][1]
        return F.percentile_approx(value[n], F.array(*[F.lit(min(1.0, max(0.0, share + k / accuracy))) for k in (-3, 3)]), F.lit(accuracy))

    first = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(*[ends(n).alias(f"__e_{n}") for n in wanted], *[F.count(value[n]).alias(f"__c_{n}") for n in wanted], *[c.alias(f"__also_{n}") for n, c in also.items()])
    small = {n: F.col(f"__c_{n}") <= accuracy for n in wanted}
    between = {n: F.struct(F.lit(n).alias("q"), F.when(small[n], F.lit(float("-inf"))).otherwise(F.get(f"__e_{n}", F.lit(0))).alias("lo"), F.when(small[n], F.lit(float("nan"))).otherwise(F.get(f"__e_{n}", F.lit(1))).alias("hi"), F.when(F.col(f"__c_{n}") > 0, wanted[n][1] * (F.col(f"__c_{n}") - 1)).alias("at")) for n in wanted}
    bounds = first.select(*[c for c in first.columns if not c.startswith(("__e_", "__c_"))], F.explode(F.array(*between.values())).alias("__b"))
    rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("q"), value[n].alias("v")) for n in wanted])).alias("__r"))
    on = F.col("__r.q") == F.col("__b.q")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    v, b = F.col("__r.v"), F.col("__b")
    side = F.when(v.isNull(), 2).when(v < b["lo"], -1).when(v > b["hi"], 1).otherwise(0)
    rows = rows.join(F.broadcast(bounds), on).withColumn("__side", side).withColumn("__v", F.when(F.col("__side") == 0, v))
    counts = rows.groupBy(*keys, F.col("__b.q").alias("__q"), "__side", "__v").agg(F.count(F.lit(1)).alias("__n"), F.first("__b.at").alias("__at"), *[F.first(f"__also_{n}").alias(f"__also_{n}") for n in also])
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__q").orderBy("__side", "__v").rowsBetween(Window.unboundedPreceding, 0))
    here = F.struct("__side", "__v")
    found = counts.withColumn("__upto", upto).groupBy(*keys, "__q").agg(*[F.min_by(here, F.when(F.col("__upto") > f("__at"), here)).alias(n) for n, f in (("__a", F.floor), ("__z", F.ceil))], F.first("__at").alias("__at"), *[F.first(f"__also_{n}").alias(f"__also_{n}") for n in also])
    low, high, at = F.col("__a.__v"), F.col("__z.__v"), F.col("__at")
    line = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    outside = at.isNotNull() & ((F.col("__a.__side") != 0) | (F.col("__z.__side") != 0))
    line = F.when(outside, F.raise_error(F.lit("a quantile lies outside the values that its sketch gave")).cast("double")).when(at.isNotNull(), line)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__q") == n, line)).alias(n) for n in wanted], *[F.first(f"__also_{n}").alias(n) for n in also])


def product(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right by few keys that have many rows on both sides: a key's left rows are dealt over the tasks, and its right
    rows go to each of them, so that no task makes all pairs of a key."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("__deal", F.pmod(F.xxhash64(*left.columns), F.lit(n)).cast("int")).repartition(n, *keys, "__deal")
    return dealt.join(right.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n, *keys, "__deal"), [*keys, "__deal"]).drop("__deal")


def weighted_mean(df: DataFrame, keys: list[str], values: Sequence[str], weight: str) -> DataFrame:
    """Per key, each value's mean weighted by the weight of the rows that have it."""
    w = F.col(weight)
    return df.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(v) * w), F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in values])


def with_totals(df: DataFrame, group: list[str], part: str, aggregates: Sequence[Column], label: str = "ALL") -> DataFrame:
    """Aggregates per (group, part) and, as part `label`, per group: one pass with grouping sets."""
    cols = [F.col(c) for c in [*group, part]]
    sets = df.groupingSets([cols, cols[:-1]], *cols).agg(*aggregates, F.grouping(part).alias("__total"))
    return sets.withColumn(part, F.when(F.col("__total") == 1, label).otherwise(F.col(part))).drop("__total")


def pivot(df: DataFrame, keys: list[str], column: str, labels: Sequence[str], aggregate: Column) -> DataFrame:
    """One column per label; labels are given, so no extra pass finds them."""
    return df.groupBy(*keys).pivot(column, list(labels)).agg(aggregate)


def crosstab(df: DataFrame, rows: str, column: str, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(rows).agg(*[F.count_if(F.col(column) == x).alias(str(x)) for x in labels])


def majority(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The most frequent value per key; ties go to the least value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(out))


def zscore(df: DataFrame, keys: list[str], values: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / population standard deviation per key (zero deviation counts as one); the statistics are joined back, so a key's rows need not meet in one task."""
    stats = df.groupBy(*keys).agg(*[f(v).alias(f"__{n}_{v}") for v in values for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    out = {f"{v}{suffix}": (F.col(v) - F.col(f"__m_{v}")) / F.when(F.col(f"__s_{v}") == 0, 1.0).otherwise(F.col(f"__s_{v}")) for v in values}
    return joined.withColumns(out).drop(*[c for c in stats.columns if c.startswith("__")])


def impute_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """value, with the key's median in place of null."""
    stats = df.groupBy(*keys).agg(median(value).alias("__m"))
    return df.join(stats, keys).withColumn(out, F.coalesce(F.col(value).cast("double"), F.col("__m"))).drop("__m")


def usable_features(df: DataFrame, values: Sequence[str], share: float = 0.7) -> list[str]:
    """Values that more than `share` of the rows have."""
    row = df.agg(*[F.avg(F.col(v).isNotNull().cast("int")).alias(v) for v in values]).first()
    return [v for v in values if row[v] is not None and row[v] > share]


def top_k(df: DataFrame, keys: list[str], order: Sequence[Column | str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def cap_per_group(df: DataFrame, keys: list[str], id: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each key in an order that only the id and seed decide (a Knuth hash that any SQL engine can repeat)."""
    return top_k(df, keys, [((F.col(id) + seed) * 2654435761) % 4294967296, F.col(id)], k)


def best(df: DataFrame, keys: list[str], value: str, order: Column, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(out))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin of equal width; the last bin includes its upper end, values outside are left out."""
    x = F.col(value)
    b = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where((x >= low) & (x <= high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# flags


def flag_set(flags: str | Column) -> Column:
    """';'-joined flags as a sorted set without empties."""
    return F.array_sort(F.array_distinct(F.filter(F.split(flags, ";"), lambda x: x != "")))


def has_flag(flags: Column, name: str) -> Column:
    return F.array_contains(flags, name)


def flag_like(flags: str | Column, name: str) -> Column:
    """Substring test on the joined flags, as some published counts use it: `cluster` is also found in `from_cluster`."""
    return F.contains(flags, F.lit(name)) if isinstance(flags, Column) else F.contains(F.col(flags), F.lit(name))


def join_flags(flags: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(flags)), ";")


def flag_counts(df: DataFrame, keys: list[str], flags: str) -> DataFrame:
    """A map from flag to its number of rows, per key."""
    n = df.select(*keys, F.explode(flag_set(flags)).alias("flag")).groupBy(*keys, "flag").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("flag", "n")))).alias("flag_counts"))


def parse_status(status: str | Column) -> Column:
    """Status per track; '-' and 'no_worm' are empty."""
    return F.transform(F.split(status, ";"), lambda s: F.when(s.isin("-", "no_worm"), "").otherwise(s))


def pad_status(status: Column, n: int | Column) -> Column:
    """Exactly n statuses (one at least), '-' where there is none."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(n).cast("int"), F.lit(1)) - 1), lambda i: F.coalesce(F.get(status, i), F.lit("-")))


NOT_WORMS = ("no_midline", "both_ends_cut", "visible_longer_than_body", "no_worm", "-", "")


def count_worms(status: Column) -> Column:
    return F.size(F.filter(status, lambda s: ~s.isin(*NOT_WORMS)))


def likelihood(hidden: Column, flagged: Column) -> Column:
    return F.when(hidden, 0.0).when(flagged, 0.5).otherwise(1.0)


def usable(flags: Column, status: Column, bad: Sequence[str], bad_status: Sequence[str], present: Column, slots: int) -> Column:
    """No bad flag, no bad status, and from one worm up to the slots present."""
    return ~F.arrays_overlap(flags, F.array(*map(F.lit, bad))) & ~F.arrays_overlap(status, F.array(*map(F.lit, bad_status))) & present.between(1, slots)


def slots(df: DataFrame, keys: list[str], order: Sequence[Column | str], most: int, out: str = "slot") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w) - 1).where(F.col(out) < most)


# merges


def unprocessed(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(labels: DataFrame, found: DataFrame, keys: list[str], value: str, score: str, id: str, differs, floor: float = 0.5) -> DataFrame:
    """labels merged with found: of found's rows per key the best score counts (ties: greatest id); it fills what is
    missing, and replaces what is flagged, if it differs and scores at least `floor`. Label columns: value, flagged."""
    top = found.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v"), F.col(score).alias("s")), F.struct(score, id)).alias("__f"))
    both = labels.join(top, keys, "full_outer")
    old, new = F.col(value), F.col("__f.v")
    fix = F.coalesce(F.col("flagged"), F.lit(False)) & (F.col("__f.s") >= floor) & differs(old, new)
    kind = F.when(old.isNull() & new.isNotNull(), "fill").when(F.coalesce(fix, F.lit(False)), "fix").otherwise("keep")
    return both.withColumn("source", kind).withColumn(value, F.when(F.col("source") == "keep", old).otherwise(new)).drop("__f", "flagged")


def overwrite(labels: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """found's rows in place of labels' rows of the same key, and labels' other rows."""
    return labels.join(found.select(*keys).distinct(), keys, "left_anti").unionByName(found)


def touched(qc: DataFrame, frames: DataFrame, keys: list[str], flags: str, flag: str) -> DataFrame:
    """qc with flag added to the rows that frames names."""
    t = frames.select(*keys).distinct().withColumn("__t", F.lit(True))
    added = F.when(F.col("__t"), F.array_union(flag_set(flags), F.array(F.lit(flag)))).otherwise(flag_set(flags))
    return qc.join(t, keys, "left").withColumn(flags, join_flags(added)).drop("__t")


def global_threshold(df: DataFrame, keys: list[str], contrast: str, background: str, t: str) -> DataFrame:
    """Median of t + 0.55 (background - t) over the rows with at least 0.6 of the 90th percentile of the contrast."""
    stats = quantiles(df, keys, {"__p": (F.col(contrast), 0.9)})
    kept = df.join(F.broadcast(stats), keys).where(F.col(contrast) >= 0.6 * F.col("__p"))
    return quantiles(kept, keys, {"threshold": (F.col(t) + 0.55 * (F.col(background) - F.col(t)), 0.5)}, {"n": F.count(F.lit(1))})


#: Sizes relative to the video's 90th percentile and median of single components.
CLUSTER_AREA, BRANCHED_AREA, FRAGMENT_AREA = 1.5, 1.2, 0.15
BRANCHED_SPUR, BRANCHED_ENDS, BRANCHED_WIDTH = 0.15, 4, 0.35


def classify_components(df: DataFrame, keys: list[str], area: str, clean: Column, loop: Column, spur: str, n_end: str, width_cv: str, border: Column, least: int = 20) -> DataFrame:
    """cluster / small_fragment / single, by the areas of the clean components of the key (of all, where fewer than `least`
    are clean): a cluster is a loop, much larger than most single ones, or branched and larger; a fragment is small and inside."""
    a = F.col(area)
    stats = quantiles(df, keys, {n: (c, q) for k, c in (("c", F.when(clean, a)), ("a", a)) for n, q in ((f"__m{k}", 0.5), (f"__p{k}", 0.9))}, {"__n": F.count_if(clean)})
    few = F.col("__n") < least
    stats = stats.select(*keys, F.when(few, F.col("__ma")).otherwise(F.col("__mc")).alias("a_med"), F.when(few, F.col("__pa")).otherwise(F.col("__pc")).alias("a_p90"))
    branched = (F.col(spur) > BRANCHED_SPUR) & (a > BRANCHED_AREA * F.col("a_p90")) & ((F.col(n_end) >= BRANCHED_ENDS) | (F.coalesce(F.col(width_cv), F.lit(0.0)) > BRANCHED_WIDTH))
    kind = F.when(loop | (a > CLUSTER_AREA * F.col("a_p90")) | branched, "cluster").when((a < FRAGMENT_AREA * F.col("a_med")) & ~border, "small_fragment").otherwise("single")
    return df.join(F.broadcast(stats), keys).withColumn("kind", kind)
