"""Upserts from a stream: changes are kept per micro-batch, and the newest row of each key is what counts.

Each micro-batch overwrites the partition of its own id, so one that is replayed after a failure changes nothing. The table as it
stands, or stood after any batch, is a read of the changes; `compact` writes such a state for readers that want it whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import best


def write_batch(changes: DataFrame, batch: int, path: str) -> None:
    """The changes of one micro-batch; written again, they replace themselves."""
    rows = changes.withColumn("batch", F.lit(batch).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def upserts(changes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream that keeps its rows as changes; trigger as for DataStreamWriter.trigger."""
    return changes.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, path)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def state(spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str] | None = None, upto: int | None = None) -> DataFrame:
    """The newest row of each key, of the batches up to `upto` (all where None). Within a batch the greatest by order (then by all columns) counts. A row
    whose `deleted` is true takes its key out, where there is such a column."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    if upto is not None:
        rows = rows.where(F.col("batch") <= upto)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = best(rows.withColumn("__v", F.struct(*values)), keys, "__v", F.struct("batch", *(order or []), "__v"), "__b").select(*keys, "__b.*")
    return newest.where(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in newest.columns else newest


def compact(spark: SparkSession, path: str, out: str, schema: str, keys: list[str], order: list[str] | None = None, upto: int | None = None) -> DataFrame:
    """Writes the state to a folder of its own and returns it read back."""
    state(spark, path, schema, keys, order, upto).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
