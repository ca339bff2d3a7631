"""Explicit schemas: optional fields are nullable, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

WORD = T.StructType([T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("word", T.StringType())])


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "map": T.MapType(T.StringType(), T.StringType()), "words": T.ArrayType(WORD), "strings": T.ArrayType(T.StringType())}


def _struct(text: str) -> T.StructType:
    """From 'name type, ...'; built without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(","))])


_SEGMENT = "id int, start_ms bigint, end_ms bigint, text_zh string, words words, recovered boolean, suspect_reasons strings, largest_internal_gap_ms bigint, speech_islands int, asr_suspect boolean, avg_logprob double, no_speech_prob double"
SEGMENT = _struct(_SEGMENT)
SEGMENTS = _struct("series string, episode string, pos int, " + _SEGMENT)
CUES = _struct("series string, episode string, id int, source_id int, start_ms bigint, end_ms bigint, text string")
SPEECH = _struct("series string, episode string, start_ms bigint, end_ms bigint")
GLOSSARY_FILE = _struct("characters map, terms map")
GLOSSARY = _struct("series string, section string, source string, en string")
TERMS = _struct("series string, source string, en string, status string, locked boolean, source_type string")
OCCURRENCES = _struct("series string, episode string, cue string, source string, en string, context string, suspect boolean, seq bigint")
MEMORY = _struct("series string, source string, signature string, en string, seq bigint")
CONDENSATION = _struct("series string, signature string, payload string, seq bigint")
FINGERPRINT = _struct("path string, size bigint, mtime_ns bigint, model string, beam_size int")
STATE = T.StructType([
    T.StructField("source", FINGERPRINT), T.StructField("segments", T.ArrayType(SEGMENT)), T.StructField("duration", T.DoubleType()), T.StructField("asr_runtime", T.DoubleType()),
    T.StructField("asr_audit", _struct("version int, enabled boolean")), T.StructField("translations", T.MapType(T.StringType(), T.StringType())), T.StructField("translation_signature", T.StringType()),
    T.StructField("translation_versions", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))), T.StructField("llm_calls", T.LongType()), T.StructField("translation_runtime", T.DoubleType()),
])
