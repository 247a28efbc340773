"""Small values from text: times, durations, file endings, aliases, null-safe casts, vectors as bytes, nested JSON."""

from __future__ import annotations

import hashlib
import ipaddress
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import AUDIO, PRIVATE, host_of, part

# Short names of the speaker model; endings of media types that a URL may name.
MODEL_ALIASES = {"community-1": "pyannote/speaker-diarization-community-1", "3.1": "pyannote/speaker-diarization-3.1"}
ENDINGS = {"audio/mpeg": ".mp3", "audio/mp4": ".m4a", "audio/x-wav": ".wav", "audio/ogg": ".ogg", "audio/flac": ".flac", "video/mp4": ".mp4"}
#: Days after which a release counts as stale.
STALE_DAYS = 120


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def number_or_null(c: Column) -> Column:
    """A text as double; null for null, '' and what is no number."""
    return F.btrim(c).try_cast("double")


def iso_time(c: Column, strict: bool = False) -> Column:
    """Timestamp of ISO 8601 text (Z or an offset, UTC without) or of YYYYMMDD; null, or with strict an error, for others."""
    compact = F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    zoned = F.when(compact.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & compact.contains(":"), compact).otherwise(F.concat(compact, F.when(compact.contains(":"), "Z").otherwise("T00:00:00Z")))
    if strict:
        return F.when(c != "", F.to_timestamp(zoned))
    return F.try_to_timestamp(F.when(c != "", zoned))


def epoch_ms(c: Column) -> Column:
    """Milliseconds since 1970 of ISO text, 0 for none."""
    return F.coalesce(F.unix_millis(iso_time(c)), F.lit(0).cast("long"))


def relative_ms(start: Column, end: Column, base_ms: Column) -> Column:
    """Struct of start_ms and end_ms relative to base_ms: neither negative, the end not before the start."""
    s = F.greatest(epoch_ms(start) - base_ms, F.lit(0).cast("long"))
    return F.struct(s.alias("start_ms"), F.greatest(epoch_ms(end) - base_ms, s).alias("end_ms"))


def clock(ms: Column) -> Column:
    """M:SS or H:MM:SS, cut off; '-' for null."""
    s = F.floor(ms / 1000)
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    long_ = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.when(ms.isNull(), "-").when(s >= 3600, long_).otherwise(short)


def is_stale(version: Column, today: Column) -> Column:
    """Whether a release named by its date, YYYYMMDD, is over STALE_DAYS old; null if it names none."""
    date = F.when(version.rlike(r"^\d{8}"), F.try_to_timestamp(F.left(version, F.lit(8)), F.lit("yyyyMMdd"))).cast("date")
    return F.date_diff(today, date) > STALE_DAYS


def title_hint(metadata: Column, path: Column) -> Column:
    """The title in the metadata (JSON text), else the file's name without its ending."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)/?$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(blank_to_null(F.get_json_object(metadata, "$.title")), blank_to_null(stem))


def ending(url: Column, mime: Column | None = None) -> Column:
    """File ending of a URL's path with its dot, else that of its media type, else null."""
    named = F.regexp_extract(F.regexp_extract(part(url, 5), r"([^/]*)$", 1), r".(\.[^.]+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    return F.coalesce(blank_to_null(named), F.element_at(known, F.lower(mime)) if mime is not None else F.lit(None).cast("string"))


def looks_like_audio_file(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(AUDIO) + ")$")


def model_name(name: Column) -> Column:
    """The model that a short name stands for; the first alias for null and ''."""
    aliases = F.create_map(*[F.lit(x) for pair in MODEL_ALIASES.items() for x in pair])
    given = F.coalesce(blank_to_null(name), F.lit(next(iter(MODEL_ALIASES))))
    return F.coalesce(F.element_at(aliases, given), given)


def file_recorded_at(path: Column) -> Column:
    """Timestamp in a file name like ...-FINAL-<seconds>-<seconds>-...; null without one."""
    return F.timestamp_seconds(blank_to_null(F.regexp_extract(path, r"-FINAL-(\d+\.\d+)-\d+\.\d+-[^/]*$", 1)).cast("double"))


def probe(output: Column) -> Column:
    """key=value lines of an audio probe as a struct; null where a value is missing or no number."""
    pairs = F.str_to_map(F.regexp_replace(F.btrim(output), r"\r?\n", "\n"), F.lit("\n"), F.lit("="))
    value = lambda k: F.btrim(F.element_at(pairs, k))
    return F.struct(
        value("codec_name").alias("codec"), value("sample_rate").try_cast("int").alias("sample_rate"),
        value("channels").try_cast("int").alias("channels"), number_or_null(value("duration")).alias("duration_s"),
    )


def audio_signature(output: Column) -> Column:
    """BLAKE2b-128 of the first FINGERPRINT= line of a fingerprint tool's output; null without one."""

    @F.pandas_udf(T.StringType())
    def digest(x: pd.Series) -> pd.Series:
        return pd.Series([None if not v else hashlib.blake2b(v.encode(), digest_size=16).hexdigest() for v in x])

    return digest(F.btrim(F.regexp_extract(output, r"(?m)^FINGERPRINT=([^\r\n]*)", 1)))


# --- vectors as bytes -------------------------------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def vector_bytes(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    import numpy as np

    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_of(b: pd.Series) -> pd.Series:
    import numpy as np

    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))


# --- addresses --------------------------------------------------------------------------------------------------------


@F.pandas_udf(T.BooleanType())
def _global_address(host: pd.Series) -> pd.Series:
    def one(h):
        try:
            return ipaddress.ip_address(h.strip("[]")).is_global
        except (ValueError, AttributeError):
            return True  # a name; names are resolved by whoever fetches

    return host.map(one)


def is_public_url(url: Column) -> Column:
    """http or https, with a host that is neither local by name nor a private address."""
    host = F.coalesce(blank_to_null(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\])", 1)), host_of(url))
    local = (host == "localhost") | host.endswith(".localhost") | host.endswith(".local")
    return F.coalesce(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).isin("http", "https") & (host != "") & ~local & _global_address(host), F.lit(False))


# --- nested JSON ------------------------------------------------------------------------------------------------------


def _parts(key: str) -> set[str]:
    """As urls.key_parts does."""
    import re

    return {w.lower() for w in re.findall("[A-Z]*[a-z0-9]+|[A-Z]+", key)}


def _public(value):
    if isinstance(value, dict):
        return {k: _public(v) for k, v in value.items() if not _parts(k) & set(PRIVATE)}
    return [_public(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def public_json(text: pd.Series) -> pd.Series:
    """JSON objects without the keys, at any depth, that have a private part; null for what is no object."""

    def one(x):
        try:
            value = json.loads(x) if x else None
        except ValueError:
            value = None
        return json.dumps(_public(value), separators=(",", ":"), ensure_ascii=False) if isinstance(value, dict) else None

    return text.map(one)


def redacted_json(text: Column) -> Column:
    """JSON with all its texts redacted, at any depth and in keys: each quoted text is redacted as a Column expression."""
    from .urls import redacted

    quoted = r'"(?:[^"\\]|\\.)*"'
    between, found = F.split(text, quoted, -1), F.regexp_extract_all(text, F.lit(quoted), F.lit(0))

    def one(q: Column) -> Column:
        plain = F.from_json(F.concat(F.lit('{"v":'), q, F.lit("}")), "v string")["v"]
        return F.regexp_extract(F.to_json(F.struct(redacted(plain).alias("v"))), r'^\{"v":(.*)\}$', 1)

    return F.array_join(F.zip_with(between, found, lambda a, q: F.concat(a, F.coalesce(one(q), F.lit("")))), "")
