"""Conversation tables derived from the given tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "passages": """
WITH b AS (SELECT conv_id AS recording_id, turn AS pos,
  CASE role WHEN 'user' THEN 'speaker_0' WHEN 'assistant' THEN 'speaker_1' ELSE 'unassigned' END AS speaker,
  CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN concat(CASE conv_id % 4 WHEN 0 THEN 'I''m Priya Shah. ' WHEN 1 THEN 'Hello, my name is Jean-Luc. ' WHEN 2 THEN 'I am late today. ' ELSE 'Hi I am Alex Kim and ' END, text) ELSE text END AS text
  FROM [conversations]),
d AS (SELECT *, CAST(length(text) AS BIGINT) * 1000 AS dur, CAST(((recording_id * 7 + pos * 3) % 5) * 4000 AS BIGINT) AS gap FROM b),
s AS (SELECT *, CAST(SUM(dur + gap) OVER (PARTITION BY recording_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - dur AS s0 FROM d)
SELECT recording_id, pos, CASE WHEN recording_id % 10 = 3 AND pos = 2 THEN 'unassigned-6' ELSE concat('p', CAST(pos AS STRING)) END AS passage_id, speaker, text,
  CASE WHEN pos > 0 AND (recording_id + pos) % 6 = 0 AND s0 >= 8000 THEN s0 - 8000 ELSE s0 END AS start_sample, s0 + dur AS end_sample FROM s""",
    "turns": """
WITH k AS (SELECT user_id AS recording_id, event_id, CAST(floor(value) AS BIGINT) AS v, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM [events])
SELECT recording_id, event_id AS turn_id, concat('speaker_', CAST(event_id % 3 AS STRING)) AS speaker,
  CAST(n AS BIGINT) * 24000 - (event_id % 5) * 6000 AS start_sample,
  CAST(n AS BIGINT) * 24000 - (event_id % 5) * 6000 + 8000 + v * 200 AS end_sample FROM k""",
    "vad_frames": """
SELECT user_id AS recording_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) * 512 AS start_sample,
  CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) * 512 AS end_sample,
  (event_id * 37) % 100 AS p100, event_id % 29 = 0 AS constant_block, event_id % 31 <> 0 AS observed FROM [events]""",
    "lang_probes": """
WITH d AS (SELECT *, CAST(floor(doc_id / 40.0E0) AS BIGINT) AS recording_id FROM [documents])
SELECT recording_id, doc_id AS probe_id, CAST(ROW_NUMBER() OVER (PARTITION BY recording_id ORDER BY doc_id) - 1 AS BIGINT) * 48000 AS start_sample,
  CAST(ROW_NUMBER() OVER (PARTITION BY recording_id ORDER BY doc_id) AS BIGINT) * 48000 AS end_sample,
  CASE WHEN doc_id % 17 = 0 THEN 'sw' ELSE lang END AS top_code, CASE WHEN lang = 'en' THEN 'de' ELSE 'en' END AS second_code,
  50 + (doc_id * 13) % 50 AS top_pct, ((50 - (doc_id * 13) % 50) * 7) AS second_permille, doc_id % 5 <> 0 AS text_ok, doc_id % 97 = 0 AS detector_error FROM d""",
    "clips": """
SELECT vec_id AS clip_id, concat('person_', CAST(label AS STRING)) AS person_id, concat('t', CAST(label AS STRING), '_', CAST(vec_id % 3 AS STRING)) AS track_id,
  vec_id % 4 = 0 AS enrolled, CASE WHEN label % 7 = 0 THEN 'model_old' ELSE 'model_a' END AS model_id, embedding FROM [embeddings]""",
    "edits": """
SELECT event_id AS edit_id, user_id AS recording_id, event_id % 8 AS pos,
  CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'speaker' WHEN 'purchase' THEN 'start' WHEN 'signup' THEN 'end' ELSE 'machine' END AS field,
  CAST(event_id % 4 AS BIGINT) AS given_revision FROM [events]""",
    "recordings": """
SELECT o_orderkey AS recording_id, concat('Recording ', CAST(o_orderkey AS STRING)) AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'meeting' ELSE 'import' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'recording' ELSE 'failed' END AS status, o_orderdate AS created, o_orderkey % 5 AS revision,
  CAST(floor(o_totalprice / 100) AS BIGINT) AS duration_s FROM [orders]""",
    "audio_notices": """
SELECT event_id AS arrival, recording_id, source_id, n AS seq, CASE WHEN event_id % 7 = 0 AND n >= 3 THEN (n - 3) * 4000 ELSE n * 4000 END AS start_sample,
  event_id % 7 = 0 AND n >= 3 AS late, CAST(4000 AS BIGINT) AS frames, CAST(floor(n / 20.0E0) AS BIGINT) AS language_epoch
FROM (SELECT event_id, user_id AS recording_id, CASE WHEN user_id % 2 = 0 THEN 'microphone_clean' ELSE 'system' END AS source_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS n FROM [events]) x""",
    "people": """
SELECT CAST(c_custkey AS STRING) AS person_id, c_name AS name, c_custkey % 3 = 0 AS has_profile,
  CASE WHEN c_custkey % 6 = 0 THEN 'model_old' ELSE 'model_a' END AS model_id FROM [customer]""",
}

VIEWS["states"] = f"""
WITH p AS ({VIEWS["passages"]}), k AS (SELECT *, recording_id * 7 + pos * 3 AS k FROM p)
SELECT recording_id, pos, passage_id, start_sample, end_sample, CASE WHEN k % 8 = 0 THEN '' ELSE text END AS text,
  CASE WHEN k % 17 = 0 THEN 'multiple_speakers' WHEN k % 23 = 0 THEN 'overlap_1' ELSE speaker END AS speaker,
  k % 19 = 0 AS separated, CASE WHEN k % 11 = 0 THEN 'words_reviewed' END AS resolution,
  CASE k % 13 WHEN 0 THEN 'token_limit' WHEN 1 THEN 'transcription_failed' WHEN 2 THEN 'insufficient_speech' WHEN 3 THEN 'possible_non_speech' WHEN 4 THEN 'other' END AS review_code,
  CASE WHEN k % 2 = 0 THEN 'auto' ELSE 'manual' END AS detection_mode,
  CASE k % 9 WHEN 0 THEN 'recent_context' WHEN 1 THEN 'best_effort' WHEN 2 THEN 'needs_language' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'mixed' WHEN 5 THEN 'insufficient_speech' ELSE 'detected' END AS detection_reason,
  CASE WHEN k % 9 BETWEEN 2 AND 5 THEN NULL ELSE 'en' END AS language,
  CASE k % 10 WHEN 0 THEN 'digital_silence' WHEN 1 THEN 'model_non_speech' WHEN 2 THEN 'insufficient_acoustic_context' END AS audio_state,
  CASE k % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'speaker,start' ELSE '' END AS protected,
  CASE WHEN k % 21 = 0 THEN 'audio_coverage' ELSE 'decoded' END AS timing, CASE k % 31 WHEN 0 THEN 'accuracy' WHEN 1 THEN 'language' END AS issue,
  CASE k % 12 WHEN 0 THEN 'edited' WHEN 1 THEN 'unresolved' ELSE 'final' END AS state, k % 16 = 0 AS partial, k % 27 = 0 AS candidate, k % 29 = 0 AS deleted,
  k % 4 <> 0 AS canonical, k % 3 <> 0 AS sealed, k % 14 <> 0 AS finalized, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS n_candidates, k % 6 <> 0 AS eligible,
  k % 4 AS revision FROM k"""
VIEWS["doc_speakers"] = """
SELECT recording_id, concat('speaker_', CAST(n AS STRING)) AS speaker,
  CASE WHEN (recording_id + n) % 5 = 0 THEN concat('Dr. Person ', CAST(recording_id AS STRING)) ELSE concat('Speaker ', CAST(n + 1 AS STRING)) END AS name
FROM (SELECT DISTINCT conv_id AS recording_id FROM [conversations]) c CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n) two"""

VIEWS["assignments"] = f"""
SELECT recording_id, speaker, CASE WHEN recording_id % 9 = 0 THEN '' ELSE CAST(recording_id % 20 + 1 AS STRING) END AS person_id,
  CASE WHEN recording_id % 7 = 0 THEN 'Former name' ELSE name END AS name FROM ({VIEWS["doc_speakers"]}) t
WHERE recording_id % 3 = 0 OR (speaker = 'speaker_0' AND recording_id % 5 = 0)"""
VIEWS["checks"] = f"""
SELECT recording_id, speaker, CASE recording_id % 4 WHEN 0 THEN 'checking' WHEN 1 THEN 'matched' WHEN 2 THEN 'unknown' ELSE 'cancelled' END AS status,
  recording_id % 8 = 0 AS manual FROM ({VIEWS["doc_speakers"]}) t WHERE speaker = 'speaker_1' AND recording_id % 2 = 0"""
VIEWS["votes"] = f"""
WITH p AS ({VIEWS["lang_probes"]}), v AS (SELECT recording_id, probe_id, start_sample, end_sample, top_code AS language, second_code,
  CASE WHEN probe_id % 4 < 3 THEN concat('speaker_', CAST(probe_id % 4 AS STRING)) END AS speaker FROM p WHERE top_pct >= 60 AND top_code <> 'sw')
SELECT recording_id, start_sample, end_sample, language, speaker FROM v
UNION ALL SELECT recording_id, start_sample, end_sample, second_code, speaker FROM v WHERE probe_id % 5 = 0
UNION ALL SELECT recording_id, start_sample + 24000, end_sample + 24000, language, speaker FROM v WHERE probe_id % 7 = 0
UNION ALL SELECT recording_id, start_sample, end_sample, language, speaker FROM v WHERE probe_id % 3 = 0"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    for table in ("conversations", "events", "documents", "embeddings", "orders", "customer"):
        sql = sql.replace(f"[{table}]", f"parquet.`{sf_dir}/{table}.parquet`")
    return spark.sql(sql)


def oracle(name: str) -> str:
    """The view as DuckDB SQL in brackets."""
    return "(" + VIEWS[name].replace("[", "").replace("]", "").replace("STRING", "VARCHAR") + ")"
