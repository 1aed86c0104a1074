"""Line dedup: lines that many documents share stay in one of them only.

Lines are exploded with their positions and reduced to a 128-bit hash of the normalised line. Distinct documents are
counted per hash in two steps (by hash and document first, so a line that a third of all rows holds is spread and
pre-aggregated before its own key meets), hashes over the threshold are joined back, and each text is reassembled by
position. Lines with a thousandth of all common ones' places, of which there are a thousand at most, are named to all tasks, and their rows
meet their hash in SALTS places instead of one. Only hashes and positions move with the lines; texts move once, in the last join.

Defined cases: a null or empty text is one empty line and comes back as the empty text; a null doc_id counts as one document that is
smaller than any other; rows that repeat (same id, same text) get the same result each; an empty table gives an empty
result; very long texts are handled like others; other columns are kept as they are, whatever their names but those that
begin with `__l` (this operator's own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import written

SPACE = " \t\n\x0b\x0c\r"
SALTS = 16
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """A-Z to a-z only; lower() does just that where all characters are ASCII, and is faster."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, CAPITALS, SMALL))


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the text replaced by what is kept, and a struct `__lines` (n_lines, n_dropped)."""
    own = docs.columns
    docs = docs.withColumns({"__l_text": F.coalesce(F.col(text), F.lit("")), "__l_id": F.col(id).cast("long")}).withColumn("__l_row", F.xxhash64("__l_text"))
    lines = docs.select("__l_id", "__l_row", F.posexplode(F.split("__l_text", "\n")).alias("__l_pos", "__l_line"))
    lines = lines.select("__l_id", "__l_row", "__l_pos", F.btrim("__l_line", F.lit(SPACE)).alias("__l_line")).where(F.length("__l_line") >= min_chars)
    lines = lines.withColumn("__l_line", ascii_lower(F.col("__l_line")))
    lines = lines.select("__l_id", "__l_row", "__l_pos", F.xxhash64("__l_line").alias("__l_h1"), F.xxhash64(F.lit(7), "__l_line").alias("__l_h2"))
    held = lines.select("__l_h1", "__l_h2", "__l_id").distinct()
    common = held.groupBy("__l_h1", "__l_h2").agg(F.count(F.lit(1)).alias("__l_n"), F.max("__l_id").alias("__l_keep")).where(F.col("__l_n") >= min_docs)
    common = written(common, "common-lines")
    held_by = common.agg(F.sum("__l_n").alias("n")).first()["n"] or 0
    hot = common.where(F.col("__l_n") * 1000 > held_by).select("__l_h1", "__l_h2", F.lit(True).alias("__l_hot"))  # fewer than 1000 rows
    lines = lines.join(F.broadcast(hot), ["__l_h1", "__l_h2"], "left").withColumn("__l_salt", F.when(F.col("__l_hot"), F.pmod(F.xxhash64("__l_id", "__l_row", "__l_pos"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("__l_hot")
    salts = F.when(F.col("__l_n") * 1000 > held_by, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    common = common.withColumn("__l_salt", F.explode(salts)).drop("__l_n")
    drops = lines.join(common, ["__l_h1", "__l_h2", "__l_salt"]).where(~F.col("__l_id").eqNullSafe(F.col("__l_keep")))
    drops = drops.groupBy("__l_id", "__l_row").agg(F.collect_set("__l_pos").alias("__l_drop")).select(F.col("__l_id").alias("__l_id2"), F.col("__l_row").alias("__l_row2"), "__l_drop")
    joined = docs.join(drops, docs["__l_id"].eqNullSafe(drops["__l_id2"]) & (docs["__l_row"] == drops["__l_row2"]), "left")

    def rebuilt(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__l_drop"))
        return F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")

    n_lines = (F.length("__l_text") - F.length(F.replace("__l_text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    kept = F.when(F.col("__l_drop").isNull(), F.col("__l_text")).otherwise(F.element_at(F.transform(F.array(F.split("__l_text", "\n")), rebuilt), 1))
    joined = joined.withColumns({"__lines": F.struct(n_lines.alias("n_lines"), F.greatest(F.size("__l_drop"), F.lit(0)).cast("long").alias("n_dropped")), "__l_kept": kept})
    return joined.select(*[F.col("__l_kept").alias(c) if c == text else F.col(f"`{c}`") for c in own], "__lines")
