"""Input and output schemas as Spark DDL; StructType.fromDDL(...).jsonValue() publishes them."""

from __future__ import annotations

from pyspark.sql.types import StructType

WORD = "struct<text:string,start_ms:bigint,end_ms:bigint,confidence:double>"
RAW_TRANSCRIPT = (
    "transcript_id string, duration_ms bigint, language string, engine string, model_versions map<string,string>, "
    "speakers array<struct<speaker_id:string,fingerprint_id:string,display_name:string,embedding:array<double>>>, "
    "segments array<struct<segment_id:string,speaker_id:string,start_ms:bigint,end_ms:bigint,text:string,"
    f"asr_confidence:double,diarization_quality:double,words:array<{WORD}>>>"
)
WORD_TIMINGS = "transcript_id string, word_seq int, word string, startTime double, endTime double, confidence double"
DIARIZATION_SPANS = (
    "transcript_id string, speakerId string, startTimeSeconds double, endTimeSeconds double, embedding array<double>, qualityScore double"
)
FINGERPRINTS = (
    "fingerprint_id string, embedding array<float>, display_name string, sample_count int, embedding_model string, "
    "embedding_dimension int, status string, discard_reason string, created_at string, updated_at string"
)
CANDIDATE_INFO = (
    "original_url string, entries array<struct<id:string,extractor:string,extractor_key:string,webpage_url:string,url:string,"
    "title:string,ext:string,availability:string,live_status:string,duration:double,is_live:boolean,format_id:string,protocol:string>>"
)


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def json_schema(ddl: str) -> dict:
    """The published form of a schema."""
    return struct(ddl).jsonValue()
