"""Explicit schemas of the artifacts; readers never infer types."""

from __future__ import annotations

from pyspark.sql.types import StructType

DDL = {
    "media": "video_id STRING, duration_ms BIGINT, width INT, height INT, fps DOUBLE, video_codec STRING, audio_tracks INT, audio_codec STRING, subtitle_tracks ARRAY<STRUCT<index: INT, codec: STRING, language: STRING, is_text: BOOLEAN>>, container STRING, size_bytes BIGINT",
    "chunks": "video_id STRING, id STRING, index INT, core_start_ms BIGINT, core_end_ms BIGINT, start_ms BIGINT, end_ms BIGINT, stages MAP<STRING, STRING>",
    "segments": "video_id STRING, chunk_id STRING, start_ms BIGINT, end_ms BIGINT, text STRING, avg_logprob DOUBLE, no_speech_prob DOUBLE, words ARRAY<STRUCT<start_ms: BIGINT, end_ms: BIGINT, word: STRING, prob: DOUBLE>>, lang STRING, lang_prob DOUBLE",
    "raw_shots": "video_id STRING, chunk_id STRING, start_ms BIGINT, end_ms BIGINT, clipped_start BOOLEAN, clipped_end BOOLEAN, keyframes ARRAY<STRUCT<ts_ms: BIGINT, file: STRING>>",
    "captions": "video_id STRING, chunk_id STRING, ts_ms BIGINT, file STRING, caption STRING, on_screen_text STRING, objects ARRAY<STRING>, people ARRAY<STRUCT<description: STRING, action: STRING, expression: STRING>>, setting STRING, time_of_day STRING, shot_type STRING, mood STRING, error STRING, model STRING",
    "dialogue": "video_id STRING, id STRING, start_ms BIGINT, end_ms BIGINT, text STRING, source STRING, reliable BOOLEAN, reason STRING, lang STRING, lang_prob DOUBLE, avg_logprob DOUBLE, word_prob DOUBLE, subtitled BOOLEAN",
    "on_screen_text": "video_id STRING, id STRING, start_ms BIGINT, end_ms BIGINT, text STRING, frames ARRAY<BIGINT>",
    "visuals": "video_id STRING, ts_ms BIGINT, file STRING, description STRING, objects ARRAY<STRING>, graphic BOOLEAN, people ARRAY<STRUCT<description: STRING, action: STRING, expression: STRING>>, setting STRING, mood STRING, shot_type STRING",
    "shots": "video_id STRING, shot INT, start_ms BIGINT, end_ms BIGINT, keyframes ARRAY<BIGINT>",
    "scenes": "video_id STRING, scene INT, start_ms BIGINT, end_ms BIGINT, shots STRUCT<first: INT, last: INT>, boundary_score DOUBLE, graphic BOOLEAN, title STRING, description STRING, characters ARRAY<STRING>, location STRING, time_of_day STRING, mood STRING, events ARRAY<STRING>, tags MAP<STRING, DOUBLE>, tag_evidence MAP<STRING, STRING>, error STRING",
    "items": "video_id STRING, pos INT, id STRING, kind STRING, scene INT, start_ms BIGINT, end_ms BIGINT, text STRING, ref STRING, embedding ARRAY<FLOAT>",
    "tag_scores": "video_id STRING, scene INT, tag STRING, score DOUBLE",
    "chapters": "video_id STRING, chapter INT, start_ms BIGINT, end_ms BIGINT, scenes STRUCT<first: INT, last: INT>, title STRING, summary STRING, events ARRAY<STRING>, characters ARRAY<STRING>, locations ARRAY<STRING>, mood STRING, error STRING",
    "profiles": "video_id STRING, video_type STRING, genres ARRAY<STRUCT<genre: STRING, confidence: DOUBLE, evidence: STRING>>, logline STRING, plot STRING, characters ARRAY<STRUCT<name: STRING, role: STRING, description: STRING>>, themes ARRAY<STRING>, setting STRING, tone STRING, ending STRING, tag_stats MAP<STRING, DOUBLE>, error STRING",
    "stage_runs": "video_id STRING, stage STRING, status STRING, updated_at TIMESTAMP, seconds DOUBLE, error STRING, fingerprint STRING",
    "jobs": "video_id STRING, status STRING, error STRING, updated_at TIMESTAMP",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
