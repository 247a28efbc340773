"""Registered queries of the store, its index, voices and assignment in order, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import export
from . import testdata as td
from .catalog import STORE, TURNS_SQL, query
from .operators import acoustics, segments, voice
from .search import TOKEN
from .shared import shared_folder
from .sources import processes
from .store import Store


def _store(spark, sf_dir: str, raw: bool = False) -> Store:
    db = Store(spark, shared_folder(spark, "store"))
    t = td.transcripts(spark, sf_dir)
    if raw:
        t = t.withColumn("raw_json", F.to_json(F.struct("transcript_id", "duration_ms")))
    db.save(t, td.segments(spark, sf_dir).select("transcript_id", "speaker_id").distinct(), td.segments(spark, sf_dir))
    return db


# --- search by the index ----------------------------------------------------------------------------------------------


def _starts(*words: str, prefix: bool = False) -> str:
    """Where a phrase begins in the tokens t, from 0."""
    same = [f"starts_with(t[i + {k}], '{w}')" if prefix and k == len(words) else f"t[i + {k}] = '{w}'" for k, w in enumerate(words, 1)]
    return f"list_filter(range(len(t) - {len(words) - 1}), lambda i: {' AND '.join(same)})"


#: Query, limit, what its phrases are, when a segment matches, and when each phrase's hits count; p0, p1, ... are the phrases' starts.
SEARCHES = [
    ("um because NOT with", None, [("um",), ("because",), ("with",)], "len(p0) > 0 AND len(p1) > 0 AND len(p2) = 0", ["true", "true", "false"]),
    ('"you know" OR "next steps"', None, [("you", "know"), ("next", "steps")], "len(p0) > 0 OR len(p1) > 0", ["true", "true"]),
    ("be* AND (like OR and)", None, [("be*",), ("like",), ("and",)], "len(p0) > 0 AND (len(p1) > 0 OR len(p2) > 0)", ["true", "true", "true"]),
    ("NEAR(um like, 3)", None, [("um",), ("like",)], "len(p0) > 0 AND len(p1) > 0", ["true", "true"]),
    ("um AND because AND like", 25, [("um",), ("because",), ("like",)], "len(p0) > 0 AND len(p1) > 0 AND len(p2) > 0", ["true", "true", "true"]),
]


def _search_sql() -> str:
    parts = []
    for q, (_, limit, phrases, match, shown) in enumerate(SEARCHES):
        starts = ", ".join(f"{_starts(*[w.rstrip('*') for w in p], prefix=p[-1].endswith('*'))} AS p{k}" for k, p in enumerate(phrases))
        own = f"SELECT * FROM (SELECT tok.*, {starts} FROM tok) WHERE {match}"
        if q == 3:  # NEAR: a hit counts with one of the other word so near that at most three tokens lie between
            near = lambda a, b: f"list_filter({a}, lambda x: len(list_filter({b}, lambda y: abs(x - y) <= 4)) > 0)"
            own = f"SELECT * FROM (SELECT * EXCLUDE (p0, p1), {near('p0', 'p1')} AS p0, {near('p1', 'p0')} AS p1 FROM ({own})) WHERE {match}"
        if limit:
            own = f"SELECT * FROM ({own}) ORDER BY transcript_id, seq LIMIT {limit}"
        hits = [f"list_transform(p{k}, lambda x: {{'pos': x, 'phrase': {k}, 'n': {len(p)}}})" for k, p in enumerate(phrases) if shown[k] == "true"]
        joined = reduce(lambda a, b: f"list_concat({a}, {b})", hits)
        parts.append(f"SELECT {q} AS q, transcript_id, seq, segment_id, speaker_id, n, pieces, gaps, unnest({joined}) AS h FROM ({own})")
    return " UNION ALL ".join(parts)


SEARCH = STORE + rf""",
tok AS MATERIALIZED (SELECT transcript_id, seq, segment_id, speaker_id, regexp_extract_all(text, '{TOKEN}') AS pieces, regexp_split_to_array(text, '{TOKEN}') AS gaps,
  list_transform(regexp_extract_all(text, '{TOKEN}'), lambda x: strip_accents(lower(x))) AS t, len(regexp_extract_all(text, '{TOKEN}')) AS n FROM segments),
hit AS MATERIALIZED (SELECT q, transcript_id, seq, segment_id, speaker_id, n, pieces, gaps, h.pos AS pos, h.phrase AS phrase, h.n AS size FROM ({_search_sql()})),
sentence AS (SELECT DISTINCT transcript_id, seq, i AS b FROM (SELECT transcript_id, seq, gaps, unnest(range(n)) AS i FROM (SELECT DISTINCT transcript_id, seq, n, gaps FROM hit)) WHERE i = 0 OR regexp_matches(gaps[i + 1], '[.:][ \t\r\n]+$')),
heads AS (SELECT q, transcript_id, seq, n, pos, max(b) AS first FROM hit JOIN sentence USING (transcript_id, seq) WHERE b <= pos GROUP BY ALL),
wins AS (SELECT q, transcript_id, seq, n, pos, first, pos AS w, 0 AS kind FROM heads UNION ALL SELECT q, transcript_id, seq, n, pos, first, first, 1 FROM heads WHERE first < pos AND n > 16),
scores AS (SELECT w.q, w.transcript_id, w.seq, w.n, w.pos, w.kind, w.w, 999 * count(DISTINCT x.phrase) + count(*) + CASE WHEN w.kind = 0 THEN 0 WHEN w.w = 0 THEN 120 ELSE 100 END AS score, arg_max(x.pos + x.size, x.pos * 1000 + x.phrase) AS last
  FROM wins w JOIN hit x ON x.q = w.q AND x.transcript_id = w.transcript_id AND x.seq = w.seq AND x.pos >= w.w AND x.pos < w.w + 16 GROUP BY w.q, w.transcript_id, w.seq, w.n, w.pos, w.kind, w.w),
best AS (SELECT q, transcript_id, seq, n, CASE WHEN kind = 1 THEN w ELSE greatest(least(pos - CAST(trunc((16 - (last - pos)) / 2.0) AS BIGINT), n - 16), 0) END AS first
  FROM scores QUALIFY row_number() OVER (PARTITION BY q, transcript_id, seq ORDER BY score DESC, pos, kind) = 1),
reach AS (SELECT *, max(pos + size - 1) OVER (PARTITION BY q, transcript_id, seq ORDER BY pos, phrase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM hit),
runs AS (SELECT *, sum(CASE WHEN r IS NULL OR pos > r THEN 1 ELSE 0 END) OVER (PARTITION BY q, transcript_id, seq ORDER BY pos, phrase ROWS UNBOUNDED PRECEDING) AS g FROM reach),
marks AS (SELECT q, transcript_id, seq, min(pos) AS a, max(pos + size - 1) AS b FROM runs GROUP BY q, transcript_id, seq, g),
shown AS (SELECT q, transcript_id, seq, first, n, unnest(range(first, least(first + 16, n))) AS i FROM best),
whole AS (SELECT DISTINCT q, transcript_id, seq, segment_id, speaker_id, pieces, gaps FROM hit),
lines AS (SELECT s.*, w.segment_id, w.speaker_id, w.gaps, (CASE WHEN i = first AND first > 0 THEN '...' ELSE gaps[i + 1] END)
    || CASE WHEN EXISTS (SELECT 1 FROM marks m WHERE m.q = s.q AND m.transcript_id = s.transcript_id AND m.seq = s.seq AND m.a = s.i) THEN '<<' ELSE '' END || pieces[i + 1]
    || CASE WHEN EXISTS (SELECT 1 FROM marks m WHERE m.q = s.q AND m.transcript_id = s.transcript_id AND m.seq = s.seq AND m.a >= s.first AND m.a <= s.i AND (m.b = s.i OR m.b > s.i AND s.i = least(s.first + 16, s.n) - 1)) THEN '>>' ELSE '' END AS line
  FROM shown s JOIN whole w USING (q, transcript_id, seq))"""


@query("SELECT CAST(q AS INTEGER) AS q, transcript_id, seq, any_value(segment_id) AS segment_id, any_value(speaker_id) AS speaker_id, string_agg(line, '' ORDER BY i) || CASE WHEN any_value(first) + 16 >= any_value(n) THEN any_value(gaps)[any_value(n) + 1] ELSE '...' END AS snippet FROM lines GROUP BY q, transcript_id, seq", SEARCH)
def search_index(spark, sf_dir):
    """AND, NOT, OR, phrases, a prefix, NEAR, and a limit, by the index that a save keeps, with snippets."""
    db = _store(spark, sf_dir)
    found = [db.search(q, limit).withColumn("q", F.lit(i)) for i, (q, limit, *_) in enumerate(SEARCHES)]
    return reduce(DataFrame.unionByName, found)


@query(
    r"""SELECT term, count(*) AS n_segments, CAST(sum(k) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS positions FROM (SELECT term, transcript_id, seq, count(*) AS k, sum(pos) AS total
    FROM (SELECT transcript_id, seq, unnest(t) AS term, unnest(range(n)) AS pos FROM tok) GROUP BY term, transcript_id, seq) GROUP BY term""", SEARCH[: SEARCH.index(",\nhit AS")])  # fmt: skip
def index_terms(spark, sf_dir):
    """Every term of the index with its segments, occurrences and the sum of its positions."""
    p = _store(spark, sf_dir).read("postings")
    total = F.aggregate("gaps", F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("sum")), lambda a, g: F.struct((a["at"] + g).alias("at"), (a["sum"] + a["at"] + g).alias("sum")))["sum"]
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.size("gaps")).alias("n"), F.sum(total).alias("positions"))


# --- the log ----------------------------------------------------------------------------------------------------------


@query(
    """SELECT transcript_id, duration_ms + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS duration_ms, '{"transcript_id":"' || transcript_id || '","duration_ms":' || duration_ms || '}' AS raw_json, created_at, n_segments, n_chars
    FROM (SELECT *, CAST(substr(transcript_id, 6) AS BIGINT) AS conv_id FROM transcripts) JOIN (SELECT transcript_id, count(*) AS n_segments, CAST(sum(length(CASE WHEN conv_id % 3 = 0 THEN 'again ' || text ELSE text END)) AS BIGINT) AS n_chars FROM segments WHERE conv_id % 3 > 0 OR seq % 2 = 0 GROUP BY transcript_id) USING (transcript_id)
    WHERE conv_id % 7 > 0""", STORE)  # fmt: skip
def store_cycle(spark, sf_dir):
    """All transcripts saved, a third saved again without raw JSON and with other segments, a seventh deleted, the log compacted, and what is there."""
    db = _store(spark, sf_dir, raw=True)
    s = td.segments(spark, sf_dir).where("conv_id % 3 = 0 and seq % 2 = 0").withColumn("text", F.concat(F.lit("again "), "text"))
    t = td.transcripts(spark, sf_dir).join(s.select("transcript_id").distinct(), "transcript_id", "left_semi")
    again = t.withColumns({"duration_ms": F.col("duration_ms") + 1, "created_at": F.lit("2030-01-01 00:00:00"), "raw_json": F.lit(None).cast("string")})
    db.save(again, s.select("transcript_id", "speaker_id").distinct(), s)
    db.delete(td.segments(spark, sf_dir).where("conv_id % 7 = 0").select("transcript_id").distinct())
    db.log.compact("segments")
    n = db.read("segments").groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.length("text")).alias("n_chars"))
    return db.read("transcripts").select("transcript_id", "duration_ms", "raw_json", "created_at").join(n, "transcript_id")


@query("SELECT transcript_id, seq, segment_id, text FROM segments", STORE)
def store_restored(spark, sf_dir):
    """A restore after a delete of all gives what the first commit held."""
    db = _store(spark, sf_dir)
    first = db.log.newest()
    db.delete(db.read("transcripts").select("transcript_id"))
    db.log.restore(first)
    return db.read("segments").select("transcript_id", "seq", "segment_id", "text")


# --- voices -----------------------------------------------------------------------------------------------------------


@query(
    """SELECT CAST(g AS VARCHAR) AS transcript_id, hz AS pitch_hz, CASE WHEN hz <= 120 AND g % 3 = 0 THEN 0.02 ELSE 0.0 END::DOUBLE AS jitter, 1.0::DOUBLE AS voiced
    FROM (SELECT vec_id // 16 AS g, CAST(90 + sum(CAST(floor(256 * CAST(embedding[1] AS DOUBLE)) AS BIGINT) % 160 + 160) % 160 AS BIGINT) AS hz FROM embeddings GROUP BY ALL)""")  # fmt: skip
def tone_voices(spark, sf_dir):
    """Pitch and jitter of recordings of known pitch, a recording per 16 vectors, through samples, frames, paths and marks."""
    first = F.pmod(F.floor(256 * F.get("embedding", F.lit(0)).cast("double")), F.lit(160)) + 160
    rows = td.table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 16).alias("g")).agg((90 + F.sum(first) % 160).alias("hz"))
    rows = rows.withColumn("odd", F.when((F.col("hz") <= 120) & (F.col("g") % 3 == 0), 0.01).otherwise(0.0))
    audio = acoustics.tones(rows.select(F.col("g").cast("string").alias("transcript_id"), "hz", "odd"), acoustics.RATE, 8800).select("transcript_id", "rate", "samples")
    spans = rows.select(F.col("g").cast("string").alias("transcript_id"), F.lit("S1").alias("speaker_id"), F.explode(F.array(F.struct(F.lit(0).alias("start_ms"), F.lit(300).alias("end_ms")), F.struct(F.lit(300).alias("start_ms"), F.lit(550).alias("end_ms")))).alias("s"))
    heard = acoustics.analysed(voice.speaker_samples(spans.select("transcript_id", "speaker_id", "s.*"), audio))
    out = voice.voice_metrics(heard)
    share = F.round(F.size(F.filter("f0", lambda x: x > 0)) / F.size("f0"), 1)
    return out.select("transcript_id", F.round("f0_mean_hz").cast("bigint").alias("pitch_hz"), F.round("jitter_local", 2).alias("jitter"), share.alias("voiced"))


# --- external programs ------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, 'ok' AS status, translate(regexp_replace(coalesce(text, ''), '\\n', ' ', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS stdout FROM conversations")
def piped_turns(spark, sf_dir):
    """Every turn through a program, as lines."""
    c = td.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return processes.run_lines(c, ["tr", "a-z", "A-Z"], timeout_s=300).select("conv_id", "turn", "status", "stdout")


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' WHEN 2 THEN 'missing' ELSE 'signal' END AS status, CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 3 THEN -15 END AS exit_code,
    CASE WHEN page_id % 4 = 0 THEN octet_length(encode(coalesce(html, '')))::VARCHAR || chr(10) WHEN page_id % 4 <> 2 THEN '' END AS stdout FROM pages""")  # fmt: skip
def page_programs(spark, sf_dir):
    """A program for each page: one that counts its bytes, one that fails, one that isn't there, one that is killed."""
    k = F.col("page_id") % 4
    sh = lambda s: F.array(F.lit("sh"), F.lit("-c"), F.lit(s))
    command = F.when(k == 0, sh("echo $(wc -c)")).when(k == 1, sh("exit 3")).when(k == 2, F.array(F.lit("/no/such/program"))).otherwise(sh("kill $$"))
    p = td.table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"), command.alias("command"))
    return processes.run_each(p, "command", "html", 60, 1).select("page_id", "status", "exit_code", "stdout")


# --- whole documents --------------------------------------------------------------------------------------------------


def _document_sql(detail: str) -> str:
    own = "{'segment_id': segment_id, 'speaker_id': speaker_id, 'start_ms': start_ms, 'end_ms': end_ms, 'text': text%s}"
    words, more = ", 'words': string_split(text, ' ')", ", 'enrichment': {'is_interruption': is_interruption, 'overlap_with_prev_ms': overlap_with_prev_ms, 'gap_before_ms': gap_before_ms}"
    seg = own % {"full": words + more, "standard": more, "minimal": ""}[detail]
    metric = "{'speaker_id': speaker_id, 'word_count': n%s}" % (", 'f0_mean_hz': 100 + n" if detail == "full" else "")
    meta = {
        "minimal": "regexp_replace(to_json({'source_path': source_path, 'duration_ms': duration_ms, 'meeting_type': meeting_type, 'recorded_at': recorded_at, 'diarization_state': diarization_state})::VARCHAR, '\"recorded_at\":null,', '')",
    }.get(detail, "to_json({'duration_ms': duration_ms, 'source_path': source_path, 'meeting_type': meeting_type, 'recorded_at': recorded_at, 'created_at': created_at, 'diarization_state': diarization_state, 'content_audio_fp': content_audio_fp})::VARCHAR")
    metrics = f"to_json((SELECT list({metric} ORDER BY speaker_id) FROM m WHERE m.transcript_id = t.transcript_id))::VARCHAR" if detail != "minimal" else "'[]'"
    return f"""SELECT '{detail}' AS detail, transcript_id, '{{"transcript_id":"' || transcript_id || '","metadata":' || {meta} || ',"speakers":' ||
      to_json((SELECT list({{'speaker_id': speaker_id, 'fingerprint_id': fingerprint_id, 'display_name': display_name}} ORDER BY ord) FROM speakers s WHERE s.transcript_id = t.transcript_id))::VARCHAR ||
      ',"segments":' || to_json((SELECT list({seg} ORDER BY seq) FROM turns u WHERE u.transcript_id = t.transcript_id))::VARCHAR || ',"speaker_metrics":' || {metrics} || '}}' AS document FROM transcripts t"""


DETAILS = ("full", "standard", "minimal")
TALK = STORE + "," + TURNS_SQL.removeprefix(td.SEGMENTS_SQL + ",") + ", m AS (SELECT transcript_id, speaker_id, count(*) AS n FROM segments GROUP BY ALL)"


@query(" UNION ALL ".join(map(_document_sql, DETAILS)), TALK)
def export_documents(spark, sf_dir):
    """Every transcript as a JSON document in all three details: speakers, metadata, enrichment, words and metrics."""
    s = segments.with_turn_taking(td.segments(spark, sf_dir))
    s = s.select("transcript_id", "seq", "segment_id", "speaker_id", "start_ms", "end_ms", "text", F.split("text", " ").alias("words"), "is_interruption", "overlap_with_prev_ms", "gap_before_ms")
    m = s.groupBy("transcript_id", "speaker_id").agg(F.count(F.lit(1)).alias("word_count")).withColumn("f0_mean_hz", 100 + F.col("word_count"))
    t, p = td.transcripts(spark, sf_dir), td.speakers(spark, sf_dir).select("transcript_id", "ord", "speaker_id", "fingerprint_id", "display_name")
    # seq orders the segments and isn't shown, as a segment's number is its id
    made = [export.transcript_documents(t, p, s, m, d).select(F.lit(d).alias("detail"), "transcript_id", "document") for d in DETAILS]
    return reduce(DataFrame.unionByName, made)
