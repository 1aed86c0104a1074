"""The jobs as registered queries, each run twice into one new folder, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.sources.folders import new_folder
from kinetrail.sources.views import PTS

from . import chat_log, locomotion_report
from .settings import load


def job1_locomotion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = new_folder(spark, "locomotion-report"), load(locomotion_report.CONFIG, locomotion_report.CONFIG)
    for _ in range(2):
        out = locomotion_report.run(spark, f"{sf_dir}/events.parquet", f"{folder}/report", config)
    return out.select("video", "track", *[F.round(c, 6).alias(c) for c in ("core_s", "speed", "frac_move", "frac_pause")], "bouts", "bout_frames", "longest_bout")


JOB1_SQL = f"""WITH {PTS}, sp AS (SELECT *, CASE WHEN core AND lag(core) OVER w THEN sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) * 20 END AS y FROM pts WINDOW w AS (PARTITION BY video, track ORDER BY frame)),
h AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS f0, first_value(y IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS f1 FROM sp
  WINDOW b AS (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY track ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ip AS (SELECT *, CASE WHEN y IS NOT NULL THEN y WHEN f0 IS NULL OR frame - f0 > 3 THEN NULL WHEN f1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (frame - f0) / (f1 - f0) END AS filled FROM h),
sm AS (SELECT *, quantile_cont(filled, 0.5) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS v FROM ip),
t AS (SELECT video, track, count(*) FILTER (core) / 20.0::DOUBLE AS core_s, quantile_cont(v, 0.5) AS speed, avg((v > 160)::INT::DOUBLE) AS frac_move, avg((v <= 160)::INT::DOUBLE) AS frac_pause FROM sm GROUP BY video, track),
m AS (SELECT video, track, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) > 2 THEN 1 ELSE 0 END AS s FROM sm WHERE v > 160),
g AS (SELECT *, sum(s) OVER (PARTITION BY track ORDER BY frame) AS g FROM m),
r AS (SELECT video, track, max(frame) - min(frame) + 1 AS n FROM g GROUP BY video, track, g HAVING max(frame) - min(frame) + 1 >= 2),
b AS (SELECT video, track, count(*) AS bouts, sum(n) AS bout_frames, max(n) AS longest_bout FROM r GROUP BY video, track),
k AS (SELECT t.*, coalesce(bouts, 0) AS bouts, coalesce(bout_frames, 0) AS bout_frames, coalesce(longest_bout, 0) AS longest_bout FROM t LEFT JOIN b USING (video, track)),
e AS (SELECT video, track::VARCHAR AS track, core_s, speed, frac_move, frac_pause, bouts, bout_frames, longest_bout FROM k UNION ALL
  SELECT video, 'ALL', sum(core_s), sum(speed * core_s) / sum(core_s) FILTER (speed IS NOT NULL), sum(frac_move * core_s) / sum(core_s) FILTER (frac_move IS NOT NULL), sum(frac_pause * core_s) / sum(core_s) FILTER (frac_pause IS NOT NULL), sum(bouts), sum(bout_frames), max(longest_bout) FROM k GROUP BY video)
SELECT video, track, round(core_s, 6) AS core_s, round(speed, 6) AS speed, round(frac_move, 6) AS frac_move, round(frac_pause, 6) AS frac_pause, bouts::BIGINT AS bouts, bout_frames::BIGINT AS bout_frames, longest_bout::BIGINT AS longest_bout FROM e"""


def job2_chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = new_folder(spark, "chat-log"), load(chat_log.CONFIG, chat_log.CONFIG)
    for _ in range(2):
        out = chat_log.run(spark, f"{sf_dir}/conversations.parquet", f"{folder}/out", f"{folder}/checkpoint", config)
    return out


JOB2_SQL = r"""WITH m AS (SELECT conv_id, turn, role, length(coalesce(text, ''))::BIGINT AS n, coalesce(regexp_matches(text, '\S'), false) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC NULLS LAST) AS k FROM conversations)
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (NOT said) AS n_empty, count(*) FILTER (role = 'user') AS n_requests, count(*) FILTER (role = 'assistant') AS n_replies,
  coalesce(sum(n) FILTER (role = 'user'), 0)::BIGINT AS request_chars, coalesce(max(n) FILTER (role = 'user'), 0)::BIGINT AS longest_request, coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT AS reply_chars, coalesce(max(n) FILTER (role = 'assistant'), 0)::BIGINT AS longest_reply,
  min(turn) AS first_turn, max(turn) AS last_turn, max(role) FILTER (k = 1) AS last_role, CASE max(role) FILTER (k = 1) WHEN 'user' THEN 'waiting' WHEN 'assistant' THEN 'answered' ELSE 'idle' END AS state FROM m GROUP BY conv_id"""

QUERIES = {"job1_locomotion_report": job1_locomotion_report, "job2_chat_log": job2_chat_log}
ORACLES = {"job1_locomotion_report": JOB1_SQL, "job2_chat_log": JOB2_SQL}
