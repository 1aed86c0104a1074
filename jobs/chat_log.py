"""State of all chats of the service, kept up to date from its growing message log.

    python jobs/chat_log.py --input DIR/conversations.parquet --output OUT --checkpoint DIR [--config FILE] [--master M]

A file stream takes only the files that came since the last run (availableNow). Each micro-batch becomes one partial digest
per chat, written to the partition of its batch id: a batch that is replayed after a failure overwrites its own partition.
The report merges the digests of all batches, never the messages, and is written partitioned by state: `waiting` (the
latest message is a request), `answered` (a reply) or `idle`. Messages may arrive in any order and in any number of files.
"""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.settings import counted, load
from kinetrail.operators import digests

CONFIG = Path(__file__).with_suffix(".json")
MESSAGES = "conv_id long, turn long, role string, text string"
VALUES = ("request_chars", "reply_chars", "turn")
DIGEST = f"conv_id long, {digests.schema(VALUES)}, n_turns long, n_empty long, latest struct<turn:long,role:string>, batch long"
REPORT = "conv_id long, n_turns long, n_empty long, n_requests long, n_replies long, request_chars long, longest_request long, reply_chars long, longest_reply long, first_turn long, last_turn long, last_role string, state string"
log = logging.getLogger("jobs.chat_log")


def digest(messages: DataFrame, config: dict) -> DataFrame:
    """One partial digest per chat of these messages."""
    chars, role = F.length(F.coalesce("text", F.lit(""))), F.col("role")
    values = {"request_chars": F.when(role == config["requests"], chars), "reply_chars": F.when(role == config["replies"], chars), "turn": F.col("turn")}
    empty = F.count_if(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).alias("n_empty")
    return digests.partial(messages, ["conv_id"], values, F.count(F.lit(1)).alias("n_turns"), empty, F.max(F.struct("turn", "role")).alias("latest"))


def report(parts: DataFrame, config: dict) -> DataFrame:
    """The state of every chat, from the digests of all batches."""
    every = digests.merge(parts, ["conv_id"], VALUES, F.sum("n_turns").alias("n_turns"), F.sum("n_empty").alias("n_empty"), F.max("latest").alias("latest"))
    role = F.col("latest.role")
    state = F.when(role == config["requests"], "waiting").when(role == config["replies"], "answered").otherwise("idle")

    def whole(x: str):
        return F.coalesce(F.col(x), F.lit(0)).cast("long")

    return every.select(
        "conv_id", "n_turns", "n_empty", F.col("request_chars.n").alias("n_requests"), F.col("reply_chars.n").alias("n_replies"),
        whole("request_chars.total").alias("request_chars"), whole("request_chars.most").alias("longest_request"), whole("reply_chars.total").alias("reply_chars"), whole("reply_chars.most").alias("longest_reply"),
        F.col("turn.least").cast("long").alias("first_turn"), F.col("turn.most").cast("long").alias("last_turn"), role.alias("last_role"), state.alias("state"),
    )


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes what is new in source, rewrites the report and returns the whole of it as it stands then."""
    parts = f"{output.rstrip('/')}/digests"
    chats = f"{output.rstrip('/')}/chats"
    spark.createDataFrame([], DIGEST).write.mode("append").partitionBy("batch").parquet(parts)  # so that there is a folder, also without any message

    def take(new: DataFrame, batch: int) -> None:
        seen, wrote = Observation(), Observation()
        rows = digest(new.observe(seen, F.count(F.lit(1)).alias("rows")), config).observe(wrote, F.count(F.lit(1)).alias("rows"))
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(parts)
        log.info("batch %s: read %s new messages of %s, wrote %s digests to %s", batch, counted(seen), source, counted(wrote), parts)

    path = source.rstrip("/")
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")  # a stream takes a path as a folder, a pattern also as a file
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    wrote = Observation()
    rows = report(spark.read.schema(DIGEST).parquet(parts), config).observe(wrote, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("state") == "waiting").alias("waiting"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("state").parquet(chats)
    log.info("wrote %s chats, %s of them waiting, to %s", counted(wrote), counted(wrote, "waiting"), chats)
    return spark.read.schema(REPORT).parquet(chats)


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--input", required=True, help="Parquet table or folder of messages")
    p.add_argument("--output", required=True, help="folder of digests and report")
    p.add_argument("--checkpoint", required=True, help="folder of the stream's checkpoint")
    p.add_argument("--config", default=str(CONFIG))
    p.add_argument("--master", help="Spark master, where the launcher sets none")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName("chat-log").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    try:
        run(spark, a.input, a.output, a.checkpoint, load(a.config, CONFIG))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
