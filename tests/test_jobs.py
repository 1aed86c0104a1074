"""The jobs: SQL, command lines, growing input, reruns and failed batches."""

import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import pytest
from compare import plain, same
from pyspark.sql import functions as F

from jobs import chat_log, locomotion_report, queries, settings

ROOT = Path(__file__).resolve().parent.parent
CHAT = json.loads(chat_log.CONFIG.read_text())
MOVES = json.loads(locomotion_report.CONFIG.read_text())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, sf, name):
    same(spark, sf, queries.QUERIES[name], queries.ORACLES[name])


def rows(frame):
    return plain([r.asDict() for r in frame.collect()], sorted(frame.columns))


def messages(spark, *some):
    return spark.createDataFrame(list(some), chat_log.MESSAGES)


def by_chat(frame):
    return {r["conv_id"]: r for r in frame.collect()}


def test_chat_log_takes_only_new_files(spark, sf, tmp_path, caplog):
    every = spark.read.parquet(f"{sf}/conversations.parquet")
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    late = (F.col("conv_id") * 7 + F.col("turn")) % 3 == 0
    every.where(~late).coalesce(1).write.parquet(folder)
    with caplog.at_level(logging.INFO):
        first = rows(chat_log.run(spark, folder, out, checkpoint, CHAT))
        assert first == rows(chat_log.report(chat_log.digest(every.where(~late), CHAT), CHAT))
        caplog.clear()
        assert rows(chat_log.run(spark, folder, out, checkpoint, CHAT)) == first
        assert not [r for r in caplog.messages if r.startswith("batch")]  # nothing was new
        every.where(late).coalesce(2).write.mode("append").parquet(folder)
        caplog.clear()
        second = rows(chat_log.run(spark, folder, out, checkpoint, CHAT))
        assert sum(int(r.split(": read ")[1].split()[0]) for r in caplog.messages if r.startswith("batch")) == every.where(late).count()
    assert second == rows(chat_log.report(chat_log.digest(every, CHAT), CHAT))


def test_chat_log_redoes_a_failed_batch(spark, tmp_path, monkeypatch):
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    messages(spark, (1, 0, "user", "a"), (1, 1, "assistant", "bc"), (2, 0, "user", "d")).coalesce(1).write.parquet(folder)

    class Broken(Exception):
        pass

    real = chat_log.log.info
    monkeypatch.setattr(chat_log.log, "info", lambda *a: (_ for _ in ()).throw(Broken()) if str(a[0]).startswith("batch") else real(*a))
    with pytest.raises(Exception, match="Broken"):
        chat_log.run(spark, folder, out, checkpoint, CHAT)  # fails after the digests were written, before the batch was committed
    monkeypatch.setattr(chat_log.log, "info", real)
    got = by_chat(chat_log.run(spark, folder, out, checkpoint, CHAT))
    assert {k: (r["n_turns"], r["state"]) for k, r in got.items()} == {1: (2, "answered"), 2: (1, "waiting")}


def test_chat_log_of_odd_messages(spark, tmp_path):
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    messages(spark).write.parquet(folder)
    assert chat_log.run(spark, folder, out, checkpoint, CHAT).count() == 0
    messages(spark, (None, None, None, None), (1, 5, "user", None), (1, 5, "user", " \n"), (2, 0, "system", "x"), (3, 2, "user", "late"), (3, None, "assistant", "no turn")).coalesce(1).write.mode("append").parquet(folder)
    messages(spark, (3, 3, "assistant", "é" * 9)).coalesce(1).write.mode("append").parquet(folder)
    got = by_chat(chat_log.run(spark, folder, out, checkpoint, CHAT))
    assert (got[None]["n_turns"], got[None]["n_empty"], got[None]["state"]) == (1, 1, "idle")
    assert (got[1]["n_turns"], got[1]["n_empty"], got[1]["n_requests"], got[1]["longest_request"], got[1]["state"]) == (2, 2, 2, 2, "waiting")
    assert got[2]["state"] == "idle" and got[2]["n_requests"] == 0
    assert (got[3]["state"], got[3]["longest_reply"], got[3]["first_turn"], got[3]["last_turn"], got[3]["n_replies"]) == ("answered", 9, 2, 3, 2)
    assert {d for d in os.listdir(f"{out}/chats") if d.startswith("state=")} == {"state=answered", "state=idle", "state=waiting"}
    messages(spark, (1, 6, "assistant", "done")).coalesce(1).write.mode("append").parquet(folder)
    chat_log.run(spark, folder, out, checkpoint, CHAT)
    assert {d for d in os.listdir(f"{out}/chats") if d.startswith("state=")} == {"state=answered", "state=idle"}  # nobody waits any more


def test_settings_are_checked(tmp_path):
    own = tmp_path / "own.json"
    for wrong in ({}, MOVES | {"extra": 1}, MOVES | {"fps": 0}, MOVES | {"fps": "20"}, MOVES | {"median_frames": 2.5}, MOVES | {"fps": True}):
        own.write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            settings.load(own, locomotion_report.CONFIG)
    own.write_text(json.dumps(CHAT | {"replies": 3}))
    with pytest.raises(ValueError):
        settings.load(own, chat_log.CONFIG)
    assert settings.load(chat_log.CONFIG, chat_log.CONFIG) == CHAT


def test_locomotion_report_of_videos_that_are_not_there(spark, sf, tmp_path):
    out = str(tmp_path / "report")
    assert locomotion_report.run(spark, f"{sf}/events.parquet", out, MOVES, videos=[99]).count() == 0
    assert locomotion_report.run(spark, f"{sf}/events.parquet", out, MOVES, videos=[2]).select("video").distinct().count() == 1


def test_locomotion_report_replaces_only_its_videos(spark, sf, tmp_path):
    out = str(tmp_path / "report")
    whole = rows(locomotion_report.run(spark, f"{sf}/events.parquet", out, MOVES))
    before = {d: sorted(os.listdir(f"{out}/{d}")) for d in os.listdir(out) if d.startswith("video=")}
    assert len(before) == 5
    again = rows(locomotion_report.run(spark, f"{sf}/events.parquet", out, MOVES, videos=[3]))
    assert again == whole
    after = {d: sorted(os.listdir(f"{out}/{d}")) for d in before}
    assert {d for d in before if before[d] != after[d]} == {"video=3"}
    assert rows(locomotion_report.run(spark, f"{sf}/events.parquet", out, MOVES)) == whole


def test_command_lines(spark, sf, tmp_path):
    def call(*args):
        done = subprocess.run([sys.executable, *args, "--master", "local[2]"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        return done.stderr

    config = tmp_path / "own.json"
    config.write_text(json.dumps(MOVES | {"moving_above": 1e9}))
    said = call(str(ROOT / "jobs/locomotion_report.py"), "--input", f"{sf}/events.parquet", "--output", str(tmp_path / "report"), "--config", str(config))
    assert "read 1000 points" in said and "of 5 videos" in said
    assert spark.read.parquet(str(tmp_path / "report")).where("frac_move > 0").count() == 0
    args = ["--input", f"{sf}/conversations.parquet", "--output", str(tmp_path / "chats"), "--checkpoint", str(tmp_path / "checkpoint")]
    assert "batch 0: read" in call(str(ROOT / "jobs/chat_log.py"), *args) and "batch" not in call(str(ROOT / "jobs/chat_log.py"), *args).split("jobs.chat_log", 1)[1]
    assert rows(spark.read.schema(chat_log.REPORT).parquet(str(tmp_path / "chats/chats"))) == rows(chat_log.report(chat_log.digest(spark.read.parquet(f"{sf}/conversations.parquet"), CHAT), CHAT))
