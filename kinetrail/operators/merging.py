"""From detections to labels: candidates, debris, outliers, new tracks, orientation chains, quality rows, prompts, reports.

All are declarative: aggregates, equality joins and windows per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.printing import printed
from . import relational as r
from . import series as s

#: Flags that rule a component out, statuses without a midline, and limits of the rules below.
BAD_FLAGS = ("cluster", "small_fragment", "split")
UNLABELLED = ("", "-", "no_midline", "both_ends_cut", "visible_longer_than_body")
DEBRIS_FRAMES, DEBRIS_SHARE, DEBRIS_STILL, DEBRIS_AREA = 5, 0.005, 8.0, 0.3
OUTLIER, CLEAN_LEAST, SIZES_LEAST = 0.2, 10, 20
PLAUSIBLE = (0.6, 1.3)


def candidates(df: DataFrame, flags: str, bad: Sequence[str] = BAD_FLAGS) -> DataFrame:
    """Rows with none of the bad flags."""
    return df.where(~F.arrays_overlap(r.flag_set(flags), F.array(*map(F.lit, bad))))


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have all the columns; NaN counts as missing."""
    return df.na.drop(subset=list(columns))


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the least `order` of each: dedupe that keeps the order."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def plausible(length: Column, body: Column | float) -> Column:
    return (length >= PLAUSIBLE[0] * F.lit(body)) & (length <= PLAUSIBLE[1] * F.lit(body))


def body_sizes(df: DataFrame, video: str, area: str, length: str, clean: Column, least: int = SIZES_LEAST) -> DataFrame:
    """(video, median_area, median_length, big_area): medians and the 90th percentile of areas of a video's clean components; of all with a midline where fewer than `least` are clean."""
    c = F.coalesce(clean & F.col(length).isNotNull(), F.lit(False))
    any_of = lambda col, on: F.when(on, F.col(col))
    whole = F.col(length).isNotNull()
    out = df.groupBy(video).agg(F.count_if(c).alias("__n"), *[f(any_of(col, on)).alias(f"__{n}{k}") for k, on in (("c", c), ("a", whole)) for n, col, f in (("m", area, r.median), ("l", length, r.median), ("p", area, r.p90))])
    pick = lambda n: F.when(F.col("__n") < least, F.col(f"__{n}a")).otherwise(F.col(f"__{n}c"))
    return out.select(video, pick("m").alias("median_area"), pick("l").alias("median_length"), pick("p").alias("big_area"))


def debris(df: DataFrame, videos: DataFrame, video: str, track: str, x: str, y: str, area: str) -> DataFrame:
    """(video, track, n, debris): tracks of too few frames, or small ones that never move. videos: video, n_frames of the whole video and median_area of its clean components."""
    per_video = videos.select(video, F.col("n_frames").alias("__n"), F.col("median_area").alias("__a"))
    per_track = df.groupBy(video, track).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.stddev_pop(x), F.stddev_pop(y)).alias("__still"), r.median(area).alias("__area"))
    short = F.col("n") < F.greatest(F.lit(DEBRIS_FRAMES), DEBRIS_SHARE * F.col("__n"))
    still = (F.col("__still") < DEBRIS_STILL) & (F.col("__area") < DEBRIS_AREA * F.col("__a"))
    return per_track.join(per_video, video).select(video, track, "n", (short | still).alias("debris"))


def without_debris(df: DataFrame, videos: DataFrame, video: str, track: str, x: str, y: str, area: str) -> DataFrame:
    return df.join(debris(df, videos, video, track, x, y, area).where("debris"), [video, track], "left_anti")


def length_outliers(df: DataFrame, videos: DataFrame, video: str, track: str, length: str, border: Column, clean: Column, out: str = "outlier") -> DataFrame:
    """Whether a length off the border is more than 20 % from its track's: the median of the clean ones, or, where fewer than ten are clean, the video's median_length (of body_sizes)."""
    per_video = videos.select(video, F.col("median_length").alias("__v"))
    per_track = df.groupBy(video, track).agg(r.median(F.when(clean, F.col(length))).alias("__t"), F.count(F.when(clean, F.col(length))).alias("__n"))
    ref = F.when(F.col("__n") >= CLEAN_LEAST, F.col("__t")).otherwise(F.col("__v"))
    far = ~border & F.coalesce(F.abs(F.col(length) - ref) / ref > OUTLIER, F.lit(False))
    return df.join(per_track, [video, track]).join(per_video, video).withColumns({"ref": ref, out: far}).drop("__v", "__t", "__n")


def track_widths(df: DataFrame, keys: list[str], profile: str, turned: Column) -> DataFrame:
    """Mean head and tail widths per key; the other way round where the key turned out to be reversed."""
    w = g.end_widths(F.col(profile))
    ends = df.groupBy(*keys).agg(F.avg(w["head"]).alias("h"), F.avg(w["tail"]).alias("t"), F.bool_or(turned).alias("turned"))
    return ends.select(*keys, F.when(F.col("turned"), F.col("t")).otherwise(F.col("h")).alias("head"), F.when(F.col("turned"), F.col("h")).otherwise(F.col("t")).alias("tail"))


def new_tracks(found: DataFrame, assigned: DataFrame, counts: DataFrame, keys: list[str], tracklet: str, score: str, least: int = 60, floor: float = 0.5) -> DataFrame:
    """(keys, tracklet, track) of long, well-scored tracklets that no track took: they get the numbers after the key's existing tracks, in order. counts: keys, n_tracks (none: 0)."""
    sure = found.groupBy(*keys, tracklet).agg(F.count(F.lit(1)).alias("__n"), r.median(score).alias("__m")).where((F.col("__n") >= least) & (F.col("__m") >= floor))
    free = sure.join(assigned.select(*keys, tracklet), [*keys, tracklet], "left_anti").select(*keys, tracklet)
    free = free.join(counts.select(*keys, F.col("n_tracks").alias("__k")), keys, "left")
    return free.withColumn("track", (F.row_number().over(s.by(keys, tracklet)) - 1 + F.coalesce("__k", F.lit(0))).cast("long")).drop("__k")


def orientation_chain(found: DataFrame, labels: DataFrame, keys: list[str], frame: str, pts: str) -> DataFrame:
    """found with `flipped`: the first row of a key takes the orientation nearer to the key's last label before it, each
    later one that nearer to its oriented predecessor. On equal distances a row keeps its predecessor's turn."""
    w = s.by(keys, frame)
    firsts = found.groupBy(*keys).agg(F.min(frame).alias("__first"))
    refs = labels.join(firsts, keys).where(F.col(frame) < F.col("__first")).groupBy(*keys).agg(F.max_by(pts, frame).alias("__ref"))
    rows = found.join(refs, keys, "left").withColumn("__prev", F.coalesce(F.lag(pts).over(w), F.col("__ref")))
    rows = rows.withColumns({"__same": g.mean_distance(F.col(pts), F.col("__prev")), "__flip": g.mean_distance(F.reverse(F.col(pts)), F.col("__prev"))})
    return s.orientation_parity(rows, keys, frame, "__same", "__flip").drop("__ref", "__prev", "__same", "__flip")


def rewrite_quality(qc: DataFrame, touched: DataFrame, keys: list[str], flags: str, status: str, worms: str, flag: str, slots: int | Column) -> DataFrame:
    """Quality rows after a merge. touched: keys, slot, kind. Statuses are padded to `slots` (a column of qc where videos differ); in touched rows the slots get
    their kinds, the flag is added and the number of worms counted anew; the flags of other rows stay as they are."""
    kinds = touched.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), "kind"))).alias("__k"))
    padded = r.pad_status(F.split(status, ";"), slots)
    rows = qc.join(kinds, keys, "left").withColumn("__s", F.transform(padded, lambda x, i: F.coalesce(F.try_element_at("__k", i), x)))
    hit = F.col("__k").isNotNull()
    count = F.size(F.filter("__s", lambda x: ~x.isin(*UNLABELLED))).cast("long")
    added = F.when(hit, r.join_flags(F.array_union(r.flag_set(flags), F.array(F.lit(flag))))).otherwise(F.col(flags))
    return rows.withColumns({flags: added, worms: F.when(hit, count).otherwise(F.col(worms)), status: F.array_join("__s", ";")}).drop("__k", "__s")


def usable_masks(df: DataFrame, keys: list[str], area: str, body_area: Column | float, least: float = 0.4, most: float = 1.7) -> DataFrame:
    """Per frame, how many components are of a body's size; frames where a component is larger than one body could be, or that have none, are left out."""
    a, unit = F.col(area), F.lit(body_area)
    return df.where(a >= F.floor(least * unit)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(a).alias("__m"), F.max(unit).alias("__u")).where(F.col("__m") <= most * F.col("__u")).drop("__m", "__u")


def absorbed_frames(present: DataFrame, near: DataFrame, video: str, track: str, frame: str, reach: float, most: int = 400) -> DataFrame:
    """(video, frame) that lie in an absence of a track, of at most `most` frames, with another track within reach of it in the frame
    before or after. near: video, frame, track, d (least distance from any other track)."""
    gaps = s.absences(present.select(video, track, frame), [video, track], frame, most)
    ends = gaps.withColumn(frame, F.explode(F.array("a", "b"))).join(near.where(F.col("d") < reach), [video, track, frame], "left_semi")
    inside = ends.select(video, "a", "b").distinct()
    return inside.select(video, F.explode(F.sequence(F.col("a") + 1, F.col("b") - 1)).alias(frame)).distinct()


def label_clean(status: Column, distance: Column, width: Column | float) -> Column:
    """A whole label, three widths or more from the next one."""
    return (status == "full") & F.coalesce(distance >= 3 * F.lit(width), F.lit(True))


def instance_gate(inside: Column, spur: Column, length: Column, body: Column) -> Column:
    """A mask that holds the midline, hardly branches, and is of the body's length."""
    return (inside >= 0.9) & (spur <= 0.12) & (F.abs(length / body - 1) <= 0.2)


def mask_of_label(points: DataFrame, runs: DataFrame, frame: str, label: str, component: str, least: float = 0.9, size: tuple[int, int] | None = None) -> DataFrame:
    """(frame, label, component, share) of the component that holds most of a label's points, where it holds enough. points: x, y;
    runs: the pixel runs (y, x0, x1, both ends inside) of the components. size: width and height, into which points are clipped."""
    limited = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)) if size else c
    at = points.select(frame, label, *[limited(F.bround(c, 0).cast("int"), n).alias(a) for c, n, a in (("x", size and size[0], "__x"), ("y", size and size[1], "y"))])
    total = points.groupBy(frame, label).agg(F.count(F.lit(1)).alias("__n"))
    held = at.join(runs, [frame, "y"]).where(F.col("__x").between(F.col("x0"), F.col("x1"))).groupBy(frame, label, component).agg(F.count(F.lit(1)).alias("__h"))
    top = held.groupBy(frame, label).agg(F.max_by(F.struct(component, "__h"), F.struct("__h", -F.col(component))).alias("__t")).join(total, [frame, label])
    share = F.col("__t.__h") / F.col("__n")
    return top.where(share >= least).select(frame, label, f"__t.{component}", share.alias("share"))


def prompts(tracks: DataFrame, episode: str, step: int, frames: int, near: int = 3, mine: int = 7, of_others: int = 5, of_tracks: int = 4) -> DataFrame:
    """Prompts per tracked object of an episode: points on it (label 1) and on the others (label 0). Others are the midlines
    that the row names, or, without any, those of other objects prompted within `near` steps. Columns: obj, prompt_frame,
    clip_start, pts, others (arrays of points). Objects without enough visible points get none."""
    local = F.col("prompt_frame") - F.col("clip_start")
    rows = tracks.where(F.col("pts").isNotNull()).withColumn("pos", g.prompt_points(F.col("pts"), mine))
    rows = rows.withColumn("frame", F.greatest(F.lit(0), F.least(F.lit(frames - 1), F.floor(local / step))).cast("int"))
    other = rows.select(episode, F.col("obj").alias("__o"), F.col("prompt_frame").alias("__f"), g.prompt_points(F.col("pts"), of_tracks).alias("__p"))
    close = (F.col("obj") != F.col("__o")) & (F.abs(F.col("prompt_frame") - F.col("__f")) <= near * step)
    asked = rows.where(F.coalesce(F.size("others"), F.lit(0)) <= 0).select(episode, "obj", "prompt_frame").join(other, episode).where(close)
    found = asked.groupBy(episode, "obj").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__o", "__p"))), lambda x: x["__p"])).alias("__neg"))
    named = F.flatten(F.transform("others", lambda m: g.prompt_points(m, of_others)))
    rows = rows.where(F.size("pos") > 0).join(found, [episode, "obj"], "left")
    nothing = F.array().cast("array<struct<x:double,y:double>>")
    neg = F.when(F.coalesce(F.size("others"), F.lit(0)) > 0, named).otherwise(F.coalesce("__neg", nothing))
    rows = rows.withColumn("neg", neg)
    labels = F.concat(F.transform("pos", lambda p: F.lit(1)), F.transform("neg", lambda p: F.lit(0)))
    return rows.select(episode, "obj", "frame", F.concat("pos", "neg").alias("points"), labels.alias("labels"))


def clean_prompt(episodes: DataFrame, context: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """For each episode (a, b) its last context frame before it, else the first after it; reverse says which."""
    wanted = episodes.select(*keys, "a", "b")
    before = s.asof(wanted, context.select(*keys, frame), keys, "a", frame, [], allow_equal=False).withColumnRenamed(f"{frame}_match", "__p")
    ends = s.asof(before, context.select(*keys, frame), keys, "b", frame, [], forward=True, allow_equal=False).withColumnRenamed(f"{frame}_match", "__n")
    return ends.select(*keys, "a", "b", F.coalesce("__p", "__n").alias("start"), F.col("__p").isNull().alias("reverse")).where("start is not null")


#: Areas of a prompted mask, relative to a body's, beyond which the prompt took two bodies or missed.
PROMPT_AREAS = (0.3, 1.6)


def prompt_warning(name: Column, area: Column, body_area: Column | float) -> Column:
    """What to tell of an object whose mask at its prompt frame is too large or too small; null where it is neither."""
    ratio = area / F.greatest(F.lit(body_area), F.lit(1.0))
    size = printed(ratio, 1)
    big = F.concat(name, F.lit(": mask of "), size, F.lit(" bodies at its prompt frame, probably two; prompt again with negative points"))
    small = F.concat(name, F.lit(": mask of only "), size, F.lit(" bodies at its prompt frame, prompt missed; prompt again"))
    return F.when(ratio > PROMPT_AREAS[1], big).when(ratio < PROMPT_AREAS[0], small)


# metrics and reports


def length_metrics(df: DataFrame, frames: DataFrame, keys: list[str], frame: str, length: str, body: float) -> DataFrame:
    """Detections and plausible ones per frame, shares of frames with one and two plausible ones, and how lengths lie about the body's.
    frames: (some of keys, frame) of all frames that were searched; those without detections count with none. Detections of other frames are left out."""
    x = F.col(length)
    shared = [c for c in frames.columns if c in (*keys, frame)]
    searched = frames.select(*shared).distinct()
    df = df.join(searched, shared, "left_semi")
    common = [c for c in keys if c in shared]
    count = searched.groupBy(*[F.col(c) for c in common], F.lit(1).alias("__one")).agg(F.count(F.lit(1)).alias("__frames"))
    found = df.groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("n"), F.count_if(plausible(x, body)).alias("p"))
    sums = found.groupBy(*keys, F.lit(1).alias("__one")).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.count_if(F.col("p") >= 2).alias("p2"), F.count_if(F.col("p") >= 1).alias("p1"))
    per = lambda c, out: (F.col(c) / F.col("__frames")).alias(out)
    frames = sums.join(count, [*common, "__one"]).select(*keys, per("n", "per_frame"), per("p", "plausible"), per("p2", "ge2"), per("p1", "ge1"))
    share = lambda c: F.avg(c.cast("double"))
    lengths = df.groupBy(*keys).agg(
        r.median(x).alias("median_length"),
        ((r.median(x) - body) / body * 100).alias("off_percent"),
        (r.median(F.when(plausible(x, body), F.abs(x - body))) / body * 100).alias("spread_percent"),
        share(x < 0.85 * body).alias("short"),
        share(x > 1.15 * body).alias("long"),
    )
    return frames.join(lengths, keys)


def duplicate_metrics(df: DataFrame, cluster: list[str], model: str, score: str, length: str, id: str, base: str, other: str) -> DataFrame:
    """One row: clusters, those with both models, how often the base model's member has the best score there, and the
    median difference of the two models' best members in length."""
    order = F.struct(F.col(score), -F.col(id))
    first = lambda m: F.max_by(F.when(F.col(model) == m, F.col(length)), F.when(F.col(model) == m, order))
    c = df.groupBy(*cluster).agg(F.max_by(model, order).alias("best"), first(base).alias("b"), first(other).alias("o"))
    both = F.col("b").isNotNull() & F.col("o").isNotNull()
    return c.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(both).alias("duplicates"), F.count_if(both & (F.col("best") == base)).alias("base_wins"), r.median(F.when(both, F.col("b") - F.col("o"))).alias("length_difference"))


def object_metrics(df: DataFrame, expected: DataFrame, run: str, frame: str, obj: str, area: str, lengths: Sequence[str], lost: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(per run, per run and object). area and lengths are relative to the body's.

    expected: run, frame, obj of every object in every frame of its run; one without a row in df has area and lengths 0.
    Per run: frames, objects, the share of objects that are lost, and for each length the share of frames in which all
    objects are plausible by it; a null length is 0, and so is one of an object that is lost. Per object: its mean area.
    """
    keys = [run, frame, obj]
    rows = expected.select(*keys).distinct().join(df.select(*keys, area, *lengths), keys, "left").withColumn(area, F.coalesce(area, F.lit(0.0)))
    ok = lambda c: plausible(F.when(F.col(area) >= lost, F.coalesce(c, F.lit(0.0))).otherwise(0.0), 1.0)
    per_frame = rows.groupBy(run, frame).agg(*[F.bool_and(ok(c)).alias(f"all_{c}") for c in lengths], F.count_if(F.col(area) < lost).alias("lost"), F.count(F.lit(1)).alias("n"))
    per_run = per_frame.groupBy(run).agg(F.count(F.lit(1)).alias("frames"), *[F.avg(F.col(f"all_{c}").cast("double")).alias(f"all_{c}") for c in lengths], (F.sum("lost") / F.sum("n")).alias("lost"))
    per_run = per_run.join(rows.groupBy(run).agg(F.count_distinct(obj).alias("objects")), run)
    return per_run, rows.groupBy(run, obj).agg(F.avg(area).alias("area"))


#: Areas of contact relative to a body's, and limits of the kinds.
CONTACT_AREA, ONE_BODY, FEW_BRANCHED, CONTACT_GAP, CONTACT_LEAST = 1.5, 1.4, 0.3, 10, 5


def contact_kinds(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Contact episodes of a video's frames with a guess of what they show. frames: video, frame, area, branched, cluster; videos:
    video, fps, median_area. A frame is in contact where it is a cluster or its area is more than 1.5 bodies; gaps up to ten
    frames are closed, episodes under five left out. Kinds: two, unbranched (rarely branched, more than 1.5 bodies); one,
    branched (under 1.4 bodies); several, branched."""
    f = frames.join(videos.select("video", "fps", "median_area"), "video")
    f = f.withColumn("__on", F.coalesce(F.col("cluster"), F.lit(False)) | F.coalesce(F.col("area") > CONTACT_AREA * F.col("median_area"), F.lit(False))).where("__on")
    w = s.by(["video"], "frame")
    f = f.withColumn("__s", F.coalesce((F.col("frame") - F.lag("frame").over(w) > CONTACT_GAP).cast("int"), F.lit(0)))
    f = f.withColumn("__g", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    branched = F.count_if(F.coalesce(F.col("branched"), F.lit(False)) | F.coalesce(F.col("cluster"), F.lit(False)))
    e = f.groupBy("video", "__g").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("n"), branched.alias("__b"), F.coalesce(F.max(F.col("area") / F.col("median_area")), F.lit(0.0)).alias("area_max"), F.max("fps").alias("fps"))
    long = (F.col("end") - F.col("start") + 1).cast("long")
    kind = F.when((F.col("__b") < FEW_BRANCHED * F.col("n")) & (F.col("area_max") > CONTACT_AREA), "two, unbranched").when(F.col("area_max") < ONE_BODY, "one, branched").otherwise("several, branched")
    return e.where(long >= CONTACT_LEAST).select("video", "start", "end", long.alias("frames"), F.round(long / F.col("fps"), 1).alias("seconds"), "area_max", (F.col("__b") / F.col("n")).alias("branched"), kind.alias("kind"))


def contact_totals(kinds: DataFrame, videos: DataFrame) -> DataFrame:
    """Per video with contact: episodes, frames in contact, the longest in seconds, and the share of the video's n_frames."""
    t = kinds.groupBy("video").agg(F.count(F.lit(1)).alias("episodes"), F.sum("frames").alias("frames_in_contact"), F.max("seconds").alias("longest_s"))
    return t.join(videos.select("video", "n_frames"), "video").withColumn("share", F.col("frames_in_contact") / F.col("n_frames")).drop("n_frames")


def report_table(df: DataFrame, rows: str, column: str, labels: Sequence, value: str, names: dict[str, str], headings: dict[str, str], digits: int = 2) -> DataFrame:
    """Means of value per row name and label, as columns: names replaces row names (others stay), headings the columns' names, and numbers are rounded for print."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    named = df.withColumn(rows, F.coalesce(F.try_element_at(known, F.col(rows)), F.col(rows))) if names else df
    wide = r.pivot(named, [rows], column, labels, F.avg(value))
    return wide.select(rows, *[F.round(F.col(f"`{c}`"), digits).alias(str(c)) for c in labels]).withColumnsRenamed(headings)


def shown(x: Column, digits: int = 2) -> Column:
    """A number with so many digits, or a dash."""
    return F.when(x.isNull() | F.isnan(x), "–").otherwise(printed(x, digits))


def track_report(videos: DataFrame, tracks: DataFrame, video: str, track: str) -> DataFrame:
    """A line of text per track of each video asked for, and a line for videos without any. Columns of tracks: length, speed, frequency, wavelength, moving."""
    c = F.col
    line = F.concat(c(track), F.lit(": L "), shown(c("length"), 0), F.lit(" px, "), shown(c("speed")), F.lit(" L/s, "), shown(c("frequency")), F.lit(" Hz, wave "), shown(c("wavelength")), F.lit(" L, moving "), shown(100 * c("moving"), 0), F.lit(" %"))
    return videos.join(tracks, video, "left").select(video, track, F.when(c(track).isNull(), F.concat(c(video), F.lit(": no tracks"))).otherwise(line).alias("line"))


def morphometry(profile: Column, length: Column, area: Column) -> Column:
    """Shape numbers of a 49-point width profile (head first): median width of the body, its ratio to the length, area over squared length, and tapers."""

    def mean(w: Column, a: int, b: int) -> Column:
        return g.total(F.slice(w, a + 1, b - a)) / (b - a)

    def shape(v: Column) -> Column:
        w, m = v["w"], v["m"]
        thin = lambda part: F.size(F.filter(part, lambda x: x < 0.5 * m)) / 25.0
        return F.struct(
            m.alias("width"), (m / length).alias("width_length"), (area / (length * length)).alias("area_length"),
            (mean(w, 1, 6) / m).alias("head"), (mean(w, 43, 48) / m).alias("tail"), (mean(w, 6, 13) / m).alias("head_quarter"), (mean(w, 36, 43) / m).alias("tail_quarter"),
            thin(F.slice(w, 1, 25)).alias("head_thin"), thin(F.slice(w, 25, 25)).alias("tail_thin"),
        )

    return g.let(F.struct(profile.alias("w"), F.get(F.array_sort(F.slice(profile, 13, 25)), F.lit(12)).alias("m")), shape)
