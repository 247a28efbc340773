"""The registered queries over the generic tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import export, store
from . import testdata as td
from .functions import text as tx
from .functions import urls
from .operators import identity, metrics, ranges, segments, sequence, vectors
from .plans import fingerprints as plans
from .streaming import sessions as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, needs: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH {needs} " if needs else "") + sql
        return f

    return add


S, W, P = td.SEGMENTS_SQL, td.WORDS_SQL, td.SEGMENTS_SQL + "," + td.SPANS_SQL
big = lambda df, *cols: df.withColumns({c: F.col(c).cast("bigint") for c in cols})
#: Rounded as the SQL rounds a double: scaled, to a whole number, scaled back. F.round rounds its shortest decimal, so that 0.14125 gives 0.1413 there, 0.1412 here.
near = lambda df, *cols, n=6: df.withColumns({c: F.round(F.col(c) * 10.0**n) / 10.0**n for c in cols})

WORD_LIST = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
UNION_SQL = S + f""",
u0 AS (SELECT transcript_id, speaker_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY transcript_id, speaker_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM segments),
u1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id, speaker_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM u0),
u2 AS (SELECT transcript_id, speaker_id, max(end_ms) - min(start_ms) AS ms FROM u1 GROUP BY transcript_id, speaker_id, g),
talk AS (SELECT transcript_id, speaker_id, CAST(sum(ms) AS BIGINT) AS talk_time_ms FROM u2 GROUP BY ALL),
wc AS (SELECT transcript_id, speaker_id, CAST(sum(len({WORD_LIST})) AS BIGINT) AS word_count FROM segments GROUP BY ALL),
dur AS (SELECT transcript_id, max(end_ms) AS duration_ms FROM segments GROUP BY ALL),
balance AS (SELECT transcript_id, speaker_id, talk_time_ms, talk_time_ms / duration_ms::DOUBLE AS talk_ratio, word_count, CASE WHEN talk_time_ms > 0 THEN word_count / (talk_time_ms / 60000::DOUBLE) ELSE 0.0 END AS wpm
  FROM talk JOIN wc USING (transcript_id, speaker_id) JOIN dur USING (transcript_id))"""
TURNS_SQL = S + """,
t0 AS (SELECT *, start_ms - lag(end_ms) OVER w AS delta, speaker_id <> lag(speaker_id) OVER w AS other, lag(end_ms) OVER w - lag(start_ms) OVER w AS before, lag(speaker_id) OVER w AS prev_speaker
  FROM segments WINDOW w AS (PARTITION BY transcript_id ORDER BY seq)),
turns AS (SELECT *, CAST(CASE WHEN delta < 0 THEN -delta ELSE 0 END AS BIGINT) AS overlap_with_prev_ms, CAST(CASE WHEN delta >= 0 THEN delta ELSE 0 END AS BIGINT) AS gap_before_ms,
  coalesce(CASE WHEN delta < 0 THEN other AND -delta >= 200 ELSE other AND delta <= 150 AND before <= 2000 AND end_ms - start_ms >= 600 END, false) AS is_interruption FROM t0)"""
ISLANDS = """
i0 AS (SELECT *, CASE WHEN lag(speaker_id) OVER (PARTITION BY transcript_id ORDER BY seq) <> speaker_id THEN 1 ELSE 0 END AS turned FROM segments),
i1 AS (SELECT *, sum(turned) OVER (PARTITION BY transcript_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM i0),
i2 AS (SELECT *, max(end_ms) OVER (PARTITION BY transcript_id, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i1),
islands AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR start_ms - reach > 800 THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM i2)"""
FILLER_RE = "(?i)(" + "|".join(tx.FILLERS) + ")"
FILLER_LIST = f"list_transform(regexp_extract_all(text, '{FILLER_RE}', 1), lambda x: lower(x))"
PAUSES = """
pw AS (SELECT w.transcript_id, w.speaker_id, w.word_start_ms - lag(w.word_end_ms) OVER (PARTITION BY w.transcript_id, island ORDER BY w.seq, word_seq) AS gap FROM words w JOIN islands i ON i.transcript_id = w.transcript_id AND i.seq = w.seq),
pauses AS (SELECT transcript_id, speaker_id, count(*) AS pause_count, avg(gap) AS avg_pause_ms FROM pw WHERE gap >= 250 GROUP BY ALL)"""
RATES = f"""
r0 AS (SELECT transcript_id, speaker_id, CAST(sum(len({FILLER_LIST})) AS BIGINT) AS filler_count, CAST(sum(len({WORD_LIST})) AS BIGINT) AS n FROM segments GROUP BY ALL),
rates AS (SELECT transcript_id, speaker_id, filler_count, CASE WHEN n > 0 THEN filler_count / n::DOUBLE * 100 ELSE 0.0 END AS filler_rate FROM r0)"""
CUTS = """
cut0 AS (SELECT transcript_id, speaker_id AS who, 1 AS made, 0 AS received FROM turns WHERE is_interruption UNION ALL SELECT transcript_id, prev_speaker, 0, 1 FROM turns WHERE is_interruption),
cuts AS (SELECT transcript_id, who AS speaker_id, CAST(sum(made) AS BIGINT) AS interruptions_made, CAST(sum(received) AS BIGINT) AS interruptions_received FROM cut0 GROUP BY ALL)"""


@query("SELECT transcript_id, speaker_id, talk_time_ms, round(talk_ratio, 6) AS talk_ratio, word_count, round(wpm, 6) AS wpm FROM balance", UNION_SQL)
def talk_balance(spark, sf_dir):
    return near(metrics.talk_balance(td.segments(spark, sf_dir)), "talk_ratio", "wpm")


@query("SELECT transcript_id, seq, overlap_with_prev_ms, gap_before_ms, is_interruption FROM turns", TURNS_SQL)
def turn_taking(spark, sf_dir):
    return segments.with_turn_taking(td.segments(spark, sf_dir)).select("transcript_id", "seq", "overlap_with_prev_ms", "gap_before_ms", "is_interruption")


@query("SELECT * FROM cuts", TURNS_SQL + "," + CUTS)
def interruption_matrix(spark, sf_dir):
    return segments.interruption_counts(segments.with_turn_taking(td.segments(spark, sf_dir)))


@query(
    """SELECT transcript_id, segment_id AS after_segment_id, b AS before_segment_id, speaker_id AS speaker_before, sa AS speaker_after, end_ms AS gap_start_ms, n AS gap_end_ms, n - end_ms AS duration_ms
    FROM (SELECT *, lead(segment_id) OVER w AS b, lead(speaker_id) OVER w AS sa, lead(start_ms) OVER w AS n FROM segments WINDOW w AS (PARTITION BY transcript_id ORDER BY seq)) WHERE n - end_ms >= 250""", S)  # fmt: skip
def find_gaps(spark, sf_dir):
    return segments.find_gaps(td.segments(spark, sf_dir))


MERGED = """
m0 AS (SELECT transcript_id, island, min(seq) AS seq, min_by(segment_id, seq) AS segment_id, min_by(speaker_id, seq) AS speaker_id, min_by(start_ms, seq) AS start_ms, max(end_ms) AS end_ms,
  list_reduce(list(text ORDER BY seq), lambda a, x: trim(a || ' ' || x)) AS text, count(*) AS n_segments,
  list_reduce(list({'s': start_ms, 'e': end_ms, 'q': diarization_quality} ORDER BY seq), lambda a, x: {'s': a.s, 'e': greatest(a.e, x.e), 'q':
    CASE WHEN greatest(a.e - a.s, 0) + greatest(x.e - x.s, 0) > 0 THEN (a.q * greatest(a.e - a.s, 0) + x.q * greatest(x.e - x.s, 0)) / (greatest(a.e - a.s, 0) + greatest(x.e - x.s, 0)) END}).q AS q
  FROM islands GROUP BY transcript_id, island)"""


@query("SELECT transcript_id, island, seq, segment_id, speaker_id, start_ms, end_ms, text, n_segments, round(q, 6) AS diarization_quality FROM m0", S + "," + ISLANDS + "," + MERGED)
def merge_turns(spark, sf_dir):
    return near(segments.merge_turns(td.segments(spark, sf_dir)), "diarization_quality")


@query("SELECT transcript_id, speaker_id, pause_count, round(avg_pause_ms, 6) AS avg_pause_ms FROM pauses", W + "," + ISLANDS + "," + PAUSES)
def pause_profile(spark, sf_dir):
    islands = segments.with_islands(td.segments(spark, sf_dir)).select("transcript_id", "seq", "island")
    return near(metrics.pause_profile(td.words(spark, sf_dir).join(islands, ["transcript_id", "seq"])), "avg_pause_ms")


@query(
    """SELECT transcript_id, speaker_id, talk_time_ms, round(talk_ratio, 6) AS talk_ratio, word_count, round(wpm, 6) AS wpm, coalesce(pause_count, 0) AS pause_count, round(coalesce(avg_pause_ms, 0.0), 6) AS avg_pause_ms,
    filler_count, round(filler_rate, 6) AS filler_rate, coalesce(interruptions_made, 0) AS interruptions_made, coalesce(interruptions_received, 0) AS interruptions_received
    FROM balance LEFT JOIN pauses USING (transcript_id, speaker_id) LEFT JOIN rates USING (transcript_id, speaker_id) LEFT JOIN cuts USING (transcript_id, speaker_id)""",
    W + "," + UNION_SQL.removeprefix(S + ",") + "," + TURNS_SQL.removeprefix(S + ",") + "," + ISLANDS + "," + PAUSES + "," + RATES + "," + CUTS)
def speaker_metrics(spark, sf_dir):
    out = metrics.speaker_metrics(segments.with_turn_taking(td.segments(spark, sf_dir)), td.words(spark, sf_dir))
    return near(out, "talk_ratio", "wpm", "avg_pause_ms", "filler_rate")


@query("SELECT transcript_id, segment_id, round(avg(confidence), 6) AS asr_confidence FROM words GROUP BY ALL", W)
def asr_confidence(spark, sf_dir):
    return near(metrics.asr_confidence(td.words(spark, sf_dir)), "asr_confidence")


@query(f"SELECT transcript_id, seq, array_to_string({FILLER_LIST}, '|') AS fillers, CAST(len({FILLER_LIST}) AS BIGINT) AS n FROM segments", S)
def fillers(spark, sf_dir):
    f = tx.fillers(F.col("text"))
    return td.segments(spark, sf_dir).select("transcript_id", "seq", F.array_join(f, "|").alias("fillers"), F.size(f).cast("bigint").alias("n"))


@query("SELECT transcript_id, speaker_id, filler_count, round(filler_rate, 6) AS filler_rate FROM rates", S + "," + RATES)
def filler_rate(spark, sf_dir):
    return near(metrics.filler_rates(td.segments(spark, sf_dir)), "filler_rate")


_TOK = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}_](?:[\p{L}\p{N}_'']*[\p{L}\p{N}_])?'), lambda x: lower(x))"
_LEX = ", ".join(f"CAST(len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in ws)}))) AS BIGINT) AS {k}" for k, ws in tx.LEXICONS.items())


@query(f"SELECT transcript_id, seq, CAST(len(t) AS BIGINT) AS word_count, {_LEX} FROM (SELECT *, {_TOK} AS t FROM segments)", S)
def linguistic(spark, sf_dir):
    return td.segments(spark, sf_dir).select("transcript_id", "seq", tx.linguistic(F.col("text")).alias("l")).select("transcript_id", "seq", "l.*")


_TITLE_TEXTS = ["Build Lab day", "Happy Hour", "happy hour", "HH", "Cohort 3", "Weekly huddle", "Daily stand-up", "Onboarding", "Intro call", "Product demo", "Retro", "Interview", "Proposal review", "Panel", "Other"]
_TITLE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(title, '{p.replace('(?iU)', '(?i)').replace('(?U)', '')}') THEN '{k}|{c}'" for p, k, c in tx.TITLES) + " END"


@query(
    f"SELECT transcript_id, title, string_split(v, '|')[1] AS meeting_type, CAST(string_split(v, '|')[2] AS DOUBLE) AS confidence FROM (SELECT *, {_TITLE_CASE} AS v FROM (SELECT DISTINCT 'conv-' || conv_id AS transcript_id, ({_TITLE_TEXTS!r})[conv_id % {len(_TITLE_TEXTS)} + 1] AS title FROM conversations))")
def meeting_type_title(spark, sf_dir):
    titles = F.array(*map(F.lit, _TITLE_TEXTS))
    c = td.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    c = c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("transcript_id"), F.get(titles, (F.col("conv_id") % len(_TITLE_TEXTS)).cast("int")).alias("title"))
    return c.withColumn("v", tx.title_type(F.col("title"))).select("transcript_id", "title", "v.*")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_HINTS = ", ".join("(" + " + ".join(f"(length(t) - length(replace(t, {_sql_text(p)}, ''))) // {len(p)}" for p in ps) + f") AS {k}" for k, ps in tx.HINTS.items())
_TOP = f"greatest({', '.join(tx.HINTS)})"
_BEST = "CASE " + " ".join(f"WHEN {k} = top THEN '{k}'" for k in tx.HINTS) + " END"


@query(
    f"""SELECT transcript_id, CASE WHEN n = 2 AND interview >= 2 THEN 'interview' WHEN n = 2 AND top < 3 THEN 'one_on_one' WHEN n >= 4 AND top < 3 THEN 'huddle' WHEN top >= 5 THEN {_BEST} ELSE 'unknown' END AS meeting_type,
    round(CASE WHEN n = 2 AND interview >= 2 THEN 0.7::DOUBLE WHEN n = 2 AND top < 3 THEN 0.5::DOUBLE WHEN n >= 4 AND top < 3 THEN 0.4::DOUBLE WHEN top >= 5 THEN least(0.4::DOUBLE + 0.05::DOUBLE * top, 0.85::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS confidence
    FROM (SELECT *, {_TOP} AS top FROM (SELECT transcript_id, n, {_HINTS} FROM (SELECT transcript_id, count(DISTINCT speaker_id) AS n, lower(string_agg(text, ' ' ORDER BY seq)) AS t FROM segments GROUP BY ALL)))""", S)  # fmt: skip
def meeting_type_keywords(spark, sf_dir):
    return near(tx.meeting_types(td.segments(spark, sf_dir)), "confidence")


@query("SELECT transcript_id, seq, word_seq, word, word_start_ms, word_end_ms FROM words", W)
def even_words(spark, sf_dir):
    return td.words(spark, sf_dir).select("transcript_id", "seq", "word_seq", "word", "word_start_ms", "word_end_ms")


def _timed(spark, sf_dir):
    w = td.words(spark, sf_dir)
    return w.select("transcript_id", (F.col("seq") * 100000 + F.col("word_seq")).alias("word_id"), "word", (F.col("word_start_ms") / 1000.0).alias("start_s"), (F.col("word_end_ms") / 1000.0).alias("end_s"))


OWNERS = """
tw AS (SELECT transcript_id, seq * 100000 + word_seq AS word_id, word, word_start_ms / 1000.0::DOUBLE AS a, word_end_ms / 1000.0::DOUBLE AS b, (word_start_ms / 1000.0::DOUBLE + word_end_ms / 1000.0::DOUBLE) / 2 AS mid FROM words),
met AS (SELECT tw.*, s.span_idx, s.start_s <= mid AND mid <= s.end_s AS held, least(s.end_s, b) - greatest(s.start_s, a) AS over, least(abs(s.start_s - mid), abs(s.end_s - mid)) AS dist FROM tw JOIN sort s USING (transcript_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY transcript_id, word_id ORDER BY held DESC, CASE WHEN held THEN -over ELSE dist END, span_idx) AS r FROM met),
owners AS (SELECT transcript_id, word_id, span_idx, CASE WHEN held THEN 'owner' ELSE 'nearest' END AS how FROM best WHERE r = 1)"""


@query("SELECT * FROM owners", W + "," + td.SPANS_SQL + "," + OWNERS)
def word_to_span(spark, sf_dir):
    return ranges.words_to_spans(_timed(spark, sf_dir), td.sort_spans(spark, sf_dir)).select("transcript_id", "word_id", "span_idx", "how")


@query(
    """SELECT s.transcript_id, s.span_idx, s.label, coalesce(string_agg(word, ' ' ORDER BY word_id), '') AS text, count(word_id) AS n_words FROM sort s LEFT JOIN (SELECT * FROM owners JOIN tw USING (transcript_id, word_id)) o
    ON o.transcript_id = s.transcript_id AND o.span_idx = s.span_idx GROUP BY ALL""", W + "," + td.SPANS_SQL + "," + OWNERS)  # fmt: skip
def span_texts(spark, sf_dir):
    w, s = _timed(spark, sf_dir), td.sort_spans(spark, sf_dir)
    return ranges.span_texts(w, ranges.words_to_spans(w, s), s).select("transcript_id", "span_idx", "label", "text", "n_words")


MAP = """
ov AS (SELECT a.transcript_id, a.label AS al, p.label AS pl, a.span_idx AS ai, p.span_idx AS pi, p.quality, least(a.end_s, p.end_s) - greatest(a.start_s, p.start_s) AS over FROM sort a JOIN process p ON p.transcript_id = a.transcript_id AND p.end_s > a.start_s AND p.start_s < a.end_s),
ov1 AS (SELECT transcript_id, al, pl, sum(over) AS seconds, min([ai, pi]) AS first FROM ov WHERE over > 0 GROUP BY ALL),
mapped AS (SELECT transcript_id, al AS label, pl AS speaker, seconds FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, al ORDER BY round(seconds, 9) DESC, first) AS r FROM ov1) WHERE r = 1)"""


@query("SELECT transcript_id, label, speaker, round(seconds, 6) AS seconds FROM mapped", P + "," + MAP)
def overlap_map(spark, sf_dir):
    return near(ranges.overlap_map(td.sort_spans(spark, sf_dir), td.process_spans(spark, sf_dir)), "seconds")


@query(
    "SELECT s.transcript_id, s.span_idx, s.label, round(sum(over * ov.quality) / sum(over), 6) AS quality FROM sort s LEFT JOIN ov ON ov.transcript_id = s.transcript_id AND ov.ai = s.span_idx AND over > 0 AND ov.quality IS NOT NULL GROUP BY ALL",
    P + "," + MAP)
def overlap_quality(spark, sf_dir):
    out = ranges.overlap_quality(td.sort_spans(spark, sf_dir), td.process_spans(spark, sf_dir))
    return near(out.select("transcript_id", "span_idx", "label", "quality"), "quality")


@query(
    """SELECT m.transcript_id, m.label, m.speaker, p.pos, round(avg(p.x), 6) AS mean FROM mapped m JOIN (SELECT transcript_id, process.label AS speaker, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x
    FROM process JOIN embeddings ON vec_id = (conv_id * 7 + seq) % (SELECT count(*) FROM embeddings)) p ON p.transcript_id = m.transcript_id AND p.speaker = m.speaker GROUP BY ALL""", P + "," + MAP)  # fmt: skip
def hybrid_speakers(spark, sf_dir):
    process = td.process_spans(spark, sf_dir)
    e = td.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    heard = process.withColumn("vec_id", (F.col("conv_id") * 7 + F.col("seq")) % F.lit(e.count())).join(e, "vec_id")
    mean = vectors.vector_mean(heard, ["transcript_id", "label"]).withColumnRenamed("label", "speaker")
    mapped = ranges.overlap_map(td.sort_spans(spark, sf_dir), process).drop("seconds")
    return near(mapped.join(mean, ["transcript_id", "speaker"]).select("transcript_id", "label", "speaker", "pos", "mean"), "mean")


@query(
    """SELECT user_id, session, min(s) AS start_ms, max(s + 500) AS end_ms, count(*) AS n_words FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session
    FROM (SELECT user_id, event_id, s, CASE WHEN lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) IS NULL OR s - lag(s + 500) OVER (PARTITION BY user_id ORDER BY s, event_id) > 3600000 THEN 1 ELSE 0 END AS cut FROM (SELECT *, epoch_us(ts) // 1000 AS s FROM events))) GROUP BY ALL""")  # fmt: skip
def word_sessions(spark, sf_dir):
    from .config import Config

    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    e = td.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("word_seq"), ms.alias("start_ms"), (ms + 500).alias("end_ms"))
    s = segments.sessionise_words(e, ["user_id"], Config(word_gap_ms=3_600_000))
    return s.groupBy("user_id", "session").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_words"))


@query("SELECT transcript_id, 'fa-' || n AS segment_id, CAST(n AS BIGINT) AS position, speaker_id, start_ms FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY start_ms, role <> 'user', seq) AS n FROM segments)", S)
def dual_track_merge(spark, sf_dir):
    s = td.segments(spark, sf_dir)
    out = segments.merge_dual_track(s.where("role = 'user'"), s.where("role <> 'user'"))
    return out.select("transcript_id", "segment_id", "position", "speaker_id", "start_ms")


@query("SELECT CAST(label AS BIGINT) AS label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def vector_mean(spark, sf_dir):
    out = vectors.vector_mean(td.table(spark, sf_dir, "embeddings"), ["label"])
    return near(big(out, "label"), "mean")


FP, OB = td.PRINTS_SQL, td.OBSERVATIONS_SQL
TOP = FP + "," + OB + """,
sim AS (SELECT o.speaker_key, p.fingerprint_id, list_cosine_similarity(o.embedding, p.embedding::DOUBLE[]) AS s FROM obs o JOIN prints p ON p.status = 'active' AND p.model IS NOT DISTINCT FROM o.model WHERE o.embedding IS NOT NULL),
top2 AS (SELECT speaker_key, max(CASE WHEN r = 1 THEN fingerprint_id END) AS best_id, max(CASE WHEN r = 1 THEN s END) AS best, max(CASE WHEN r = 2 THEN fingerprint_id END) AS second_id, max(CASE WHEN r = 2 THEN s END) AS second
  FROM (SELECT *, row_number() OVER (PARTITION BY speaker_key ORDER BY round(s, 12) DESC, fingerprint_id) AS r FROM sim) WHERE r <= 2 GROUP BY speaker_key)"""


@query("SELECT speaker_key, best_id, round(best, 6) AS best, second_id, round(second, 6) AS second FROM obs LEFT JOIN top2 USING (speaker_key) WHERE embedding IS NOT NULL", TOP)
def cosine_top2(spark, sf_dir):
    obs, prints = td.observations(spark, sf_dir).where("embedding is not null"), td.prints(spark, sf_dir).where("status = 'active'")
    return near(vectors.nearest_two(obs, prints, "speaker_key", "fingerprint_id", "model"), "best", "second")


KINDS = TOP + """,
kinds AS (SELECT o.*, best, second, best_id, CASE WHEN o.fingerprint_id <> '' THEN 'preassigned' WHEN embedding IS NULL THEN CASE WHEN name_id IS NOT NULL THEN 'name_match' ELSE 'no_embedding' END
  WHEN best_id IS NOT NULL AND greatest(coalesce(best, 0), 0) >= 0.78 THEN 'strong' WHEN best_id IS NOT NULL AND greatest(coalesce(best, 0), 0) >= 0.62 AND greatest(coalesce(best, 0), 0) - greatest(coalesce(second, 0), 0) >= 0.15 THEN 'margin'
  WHEN duration_ms < 15000 THEN 'no_enroll' ELSE 'new' END AS kind, name_id FROM obs o LEFT JOIN top2 ON top2.speaker_key = o.speaker_key AND coalesce(o.fingerprint_id, '') = ''
  LEFT JOIN (SELECT model, lower(trim(display_name)) AS name, min(fingerprint_id) AS name_id FROM prints WHERE status = 'active' AND display_name <> '' GROUP BY ALL) n ON n.model IS NOT DISTINCT FROM o.model AND o.embedding IS NULL AND n.name = lower(trim(o.display_name)))"""


@query(
    """SELECT speaker_key, kind, CASE kind WHEN 'preassigned' THEN fingerprint_id WHEN 'name_match' THEN name_id WHEN 'strong' THEN best_id WHEN 'margin' THEN best_id END AS matched_id,
    round(best, 6) AS similarity, round(second, 6) AS second_similarity, round(best - second, 6) AS margin, kind = 'strong' AND coalesce(duration_ms >= 3000, true) AS folds FROM kinds""", KINDS)  # fmt: skip
def match_kinds(spark, sf_dir):
    out = identity.match_kinds(td.observations(spark, sf_dir), td.prints(spark, sf_dir))
    return near(out.select("speaker_key", "kind", "matched_id", "similarity", "second_similarity", "margin", "folds"), "similarity", "second_similarity", "margin")


@query(
    """SELECT p.fingerprint_id, pos, round((old * sample_count + total) / (sample_count + k), 6) AS value, CAST(sample_count + k AS BIGINT) AS sample_count FROM (SELECT fingerprint_id, sample_count, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS old FROM prints) p
    JOIN (SELECT best_id, pos, sum(x) AS total, count(*) AS k FROM (SELECT best_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM kinds WHERE kind = 'strong' AND coalesce(duration_ms >= 3000, true)) GROUP BY ALL) s ON s.best_id = p.fingerprint_id AND s.pos = p.pos""".replace("SELECT p.fingerprint_id, pos,", "SELECT p.fingerprint_id, p.pos,"), KINDS)  # fmt: skip
def centroid_fold(spark, sf_dir):
    prints = td.prints(spark, sf_dir)
    matched = identity.match_kinds(td.observations(spark, sf_dir), prints).where("folds")
    return near(big(identity.folded_centroids(prints, matched), "sample_count"), "value")


LIB = FP + """,
library AS (SELECT fingerprint_id, embedding, display_name, sample_count, model AS embedding_model, status, CASE WHEN status = 'discarded' THEN 'noise' END AS discard_reason, vec_id FROM prints)"""


def _library(spark, sf_dir):
    p = td.prints(spark, sf_dir)
    reason = F.when(F.col("status") == "discarded", F.lit("noise"))
    return p.select(
        "fingerprint_id", "embedding", "display_name", "sample_count", F.col("model").alias("embedding_model"), F.size("embedding").alias("embedding_dimension"),
        "status", reason.alias("discard_reason"), F.lit(None).cast("string").alias("created_at"), "vec_id",
    )


@query(
    """SELECT s.fingerprint_id AS source, t.fingerprint_id AS target, CAST(s.sample_count + t.sample_count AS BIGINT) AS sample_count, coalesce(t.display_name, s.display_name) AS display_name,
    round(list_sum(list_transform(list_zip(t.embedding, s.embedding), lambda z: (z[1]::DOUBLE * t.sample_count + z[2]::DOUBLE * s.sample_count) / (t.sample_count + s.sample_count))), 5) AS total
    FROM library s JOIN library t ON t.vec_id = s.vec_id + 2 AND s.vec_id % 4 = 0 WHERE s.status = 'active' AND t.status = 'active' AND s.embedding_model IS NOT DISTINCT FROM t.embedding_model""", LIB)  # fmt: skip
def centroid_merge(spark, sf_dir):
    lib = _library(spark, sf_dir)
    target = F.format_string("VP-%06d", F.col("vec_id") + 2)
    plan = plans.merge_plan(lib.drop("vec_id"), lib.where("vec_id % 4 = 0").select(F.col("fingerprint_id").alias("source"), target.alias("target")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return plan.select("source", "target", F.col("sample_count").cast("bigint").alias("sample_count"), "display_name", F.round(total, 5).alias("total"))


@query()
def collapse_speakers(spark, sf_dir):
    s = td.speakers(spark, sf_dir)
    e = td.table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "embedding")
    v = s.withColumn("vec_id", F.pmod(F.xxhash64("transcript_id", "speaker_id"), F.lit(e.count()))).join(e, "vec_id", "left")
    return identity.collapse_speakers(v, td.segments(spark, sf_dir))


@query()
def assign_sequential(spark, sf_dir):
    o = td.observations(spark, sf_dir).withColumn("transcript_id", F.floor(F.col("speaker_key") / 8)).withColumn("ord", F.col("speaker_key") % 8)
    return sequence.assign_by_rounds(o, td.prints(spark, sf_dir))


@query(
    "SELECT transcript_id, speaker_id, s.fingerprint_id, s.display_name AS old_name, p.display_name AS new_name FROM speakers s JOIN prints p USING (fingerprint_id) WHERE p.display_name IS NOT NULL AND s.display_name IS DISTINCT FROM p.display_name",
    S + "," + td.SPEAKERS_SQL + "," + FP)
def relabel_plan(spark, sf_dir):
    return identity.relabels(td.speakers(spark, sf_dir), td.prints(spark, sf_dir)).select("transcript_id", "speaker_id", "fingerprint_id", "old_name", "new_name")


@query("SELECT i.fingerprint_id, CASE WHEN p.fingerprint_id IS NULL THEN 'insert' ELSE 'replace' END AS action FROM (SELECT printf('VP-%06d', vec_id) AS fingerprint_id FROM embeddings) i LEFT JOIN prints p USING (fingerprint_id)", FP)
def import_plan(spark, sf_dir):
    incoming = td.table(spark, sf_dir, "embeddings").select(F.format_string("VP-%06d", "vec_id").alias("fingerprint_id"))
    return plans.import_plan(incoming, _library(spark, sf_dir), replace=True)


@query("SELECT fingerprint_id, display_name, CAST(sample_count AS BIGINT) AS sample_count, status FROM library WHERE status = 'active' AND embedding_model IS NULL", LIB)
def adopt_plan(spark, sf_dir):
    return big(plans.adopt_plan(_library(spark, sf_dir)).select("fingerprint_id", "display_name", "sample_count", "status"), "sample_count")


@query(
    """SELECT l.fingerprint_id, status AS current_status, 'discarded' AS target_status, 'noise' AS target_reason, status <> 'discarded' OR discard_reason IS DISTINCT FROM 'noise' AS will_write, coalesce(n, 0) AS speaker_rows
    FROM library l LEFT JOIN (SELECT fingerprint_id, count(*) AS n FROM speakers WHERE fingerprint_id IS NOT NULL GROUP BY ALL) r USING (fingerprint_id)""", S + "," + td.SPEAKERS_SQL + "," + LIB)  # fmt: skip
def action_plan(spark, sf_dir):
    return plans.action_plan(_library(spark, sf_dir), td.speakers(spark, sf_dir), "discard", " noise ")


STORE = S + "," + td.SPEAKERS_SQL + "," + td.TRANSCRIPTS_SQL


@query(
    """SELECT transcript_id, source_path, duration_ms, meeting_type, coalesce(a, 0) AS speaker_count, coalesce(b, 0) AS segment_count FROM transcripts
    LEFT JOIN (SELECT transcript_id, count(DISTINCT speaker_id) AS a FROM speakers GROUP BY ALL) USING (transcript_id) LEFT JOIN (SELECT transcript_id, count(DISTINCT segment_id) AS b FROM segments GROUP BY ALL) USING (transcript_id)
    WHERE source_path ILIKE '%call_1%' AND diarization_state = 'ok' ORDER BY coalesce(recorded_at, created_at) DESC, transcript_id LIMIT 50""", STORE)  # fmt: skip
def list_transcripts(spark, sf_dir):
    out = store.list_transcripts(td.transcripts(spark, sf_dir), td.speakers(spark, sf_dir), td.segments(spark, sf_dir), source="call_1", diarization_state="ok")
    return out.select("transcript_id", "source_path", "duration_ms", "meeting_type", "speaker_count", "segment_count")


@query(
    """SELECT (SELECT count(*) FROM transcripts) AS transcript_count, (SELECT CAST(sum(duration_ms) AS BIGINT) FROM transcripts) AS total_duration_ms, (SELECT round(sum(duration_ms) / 60000::DOUBLE, 3) FROM transcripts) AS total_duration_minutes,
    (SELECT count(*) FROM speakers) AS speaker_count, (SELECT count(*) FROM segments) AS segment_count, (SELECT count(*) FROM prints) AS fingerprint_count""", STORE + "," + FP)  # fmt: skip
def stats(spark, sf_dir):
    return store.stats(td.transcripts(spark, sf_dir), td.speakers(spark, sf_dir), td.segments(spark, sf_dir), td.prints(spark, sf_dir))


@query("SELECT status, count(*) AS n FROM prints GROUP BY ALL", FP)
def fingerprint_status(spark, sf_dir):
    return store.status_counts(td.prints(spark, sf_dir))


@query("SELECT CASE WHEN model IS NULL THEN 'legacy' WHEN model = 'm1' THEN 'compatible' ELSE 'incompatible' END AS namespace, count(*) AS n FROM prints WHERE status = 'active' GROUP BY ALL", FP)
def fingerprint_models(spark, sf_dir):
    return store.model_counts(td.prints(spark, sf_dir), "m1")


@query(
    """SELECT fingerprint_id, rank, transcript_id, segment_id, speaker_id, start_ms, end_ms, text FROM (SELECT s.fingerprint_id, g.*, row_number() OVER (PARTITION BY s.fingerprint_id ORDER BY g.transcript_id, g.start_ms, g.seq) AS rank
    FROM speakers s JOIN segments g ON g.transcript_id = s.transcript_id AND g.speaker_id = s.speaker_id WHERE s.fingerprint_id IS NOT NULL) WHERE rank <= 3""", S + "," + td.SPEAKERS_SQL)  # fmt: skip
def excerpts_topk(spark, sf_dir):
    out = store.excerpts(td.speakers(spark, sf_dir), td.segments(spark, sf_dir), td.prints(spark, sf_dir))
    return out.select("fingerprint_id", "rank", "transcript_id", "segment_id", "speaker_id", "start_ms", "end_ms", "text")


@query("SELECT g.transcript_id, g.segment_id, g.speaker_id FROM segments g WHERE NOT EXISTS (SELECT 1 FROM speakers s WHERE s.transcript_id = g.transcript_id AND s.speaker_id = g.speaker_id AND s.fingerprint_id IS NOT NULL)", S + "," + td.SPEAKERS_SQL)
def orphan_segments(spark, sf_dir):
    known = td.speakers(spark, sf_dir).where("fingerprint_id is not null")
    return store.orphan_segments(td.segments(spark, sf_dir), known).select("transcript_id", "segment_id", "speaker_id")


@query(
    """SELECT transcript_id, CASE WHEN transcript_id = one THEN two ELSE one END AS duplicate_of FROM transcripts JOIN (SELECT content_audio_fp, list(transcript_id ORDER BY created_at, transcript_id)[1] AS one, list(transcript_id ORDER BY created_at, transcript_id)[2] AS two
    FROM transcripts GROUP BY ALL) USING (content_audio_fp) WHERE two IS NOT NULL""", STORE)  # fmt: skip
def audio_duplicates(spark, sf_dir):
    return store.audio_duplicates(td.transcripts(spark, sf_dir))


@query("SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(CASE WHEN len(t) <= 4 THEN 1 ELSE len(t) - 3 END AS BIGINT) AS n_shingles, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def signature_tokens(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents").select("doc_id", tx.signature_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(tx.shingles(F.col("t"))).cast("bigint").alias("n_shingles"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query()
def simhash_exact(spark, sf_dir):
    return td.table(spark, sf_dir, "documents").select("doc_id", tx.text_signature(F.col("text")).alias("simhash"))


_HEX = "('0x' || {0})::UBIGINT"


@query("SELECT a.doc_id, CAST(bit_count(xor(('0x' || left(md5(a.text), 16))::UBIGINT, ('0x' || left(md5(b.text), 16))::UBIGINT)) AS BIGINT) AS distance FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def hamming_distance(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents").select("doc_id", F.left(F.md5(F.col("text").cast("binary")), F.lit(16)).alias("h"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("g"))
    return d.join(b, "doc_id").select("doc_id", tx.hamming_hex(F.col("h"), F.col("g")).cast("bigint").alias("distance"))


_LINE = r"' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' '"


def _search_sql(where: str) -> str:
    return f"SELECT transcript_id, segment_id, speaker_id FROM (SELECT *, {_LINE} AS t FROM segments) WHERE {where}"


def _found(spark, sf_dir, q: str):
    return tx.search(td.segments(spark, sf_dir), q, None).select("transcript_id", "segment_id", "speaker_id")


@query(_search_sql("contains(t, ' um ') AND contains(t, ' because ') AND NOT contains(t, ' with ')"), S)
def search_and(spark, sf_dir):
    return _found(spark, sf_dir, "um because NOT with")


@query(_search_sql("contains(t, ' you know ') OR contains(t, ' next steps ')"), S)
def search_phrase(spark, sf_dir):
    return _found(spark, sf_dir, '"you know" OR "next steps"')


@query(_search_sql("contains(t, ' be') AND (contains(t, ' like ') OR contains(t, ' and '))"), S)
def search_prefix(spark, sf_dir):
    return _found(spark, sf_dir, "be* (like OR and)")


@query("SELECT transcript_id, seq, CASE WHEN start_ms >= 3600000 THEN printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) ELSE printf('%02d:%02d', start_ms // 60000, start_ms // 1000 % 60) END AS at FROM (SELECT transcript_id, seq, start_ms * 37 AS start_ms FROM segments)", S)
def timestamps(spark, sf_dir):
    return td.segments(spark, sf_dir).select("transcript_id", "seq", tx.timestamp(F.col("start_ms") * 37).alias("at"))


@query(
    """SELECT transcript_id, seq, to_json({'transcript_id': transcript_id, 'segment_id': segment_id, 'speaker_id': speaker_id, 'start_ms': start_ms, 'end_ms': end_ms, 'n_words': len(string_split(text, ' ')), 'speaker_fingerprint_id': fingerprint_id, 'speaker_display_name': display_name})::VARCHAR AS line
    FROM segments LEFT JOIN speakers USING (transcript_id, speaker_id)""", S + "," + td.SPEAKERS_SQL)  # fmt: skip
def export_jsonl(spark, sf_dir):
    out = export.jsonl(td.segments(spark, sf_dir), td.speakers(spark, sf_dir))
    parsed = F.from_json("line", "transcript_id string, segment_id string, speaker_id string, start_ms bigint, end_ms bigint, text string, speaker_fingerprint_id string, speaker_display_name string")
    out = out.select("transcript_id", "seq", parsed.alias("p"))
    fields = [F.col(f"p.{c}") for c in ("transcript_id", "segment_id", "speaker_id", "start_ms", "end_ms")]
    n = F.size(F.split("p.text", " ")).alias("n_words")
    line = F.to_json(F.struct(*fields, n, "p.speaker_fingerprint_id", "p.speaker_display_name"), {"ignoreNullFields": "false"})
    return out.select("transcript_id", "seq", line.alias("line"))


@query(
    """SELECT transcript_id, speaker_id, coalesce(display_name, fingerprint_id, speaker_id) AS speaker_name, fingerprint_id, talk_time_ms, word_count FROM balance LEFT JOIN speakers USING (transcript_id, speaker_id)""",
    UNION_SQL + "," + td.SPEAKERS_SQL)
def export_csv(spark, sf_dir):
    out = export.csv_rows(metrics.talk_balance(td.segments(spark, sf_dir)), td.speakers(spark, sf_dir))
    return out.select("transcript_id", "speaker_id", "speaker_name", "fingerprint_id", "talk_time_ms", "word_count")


@query(
    """SELECT transcript_id, seq, CASE WHEN lag(speaker_id) OVER (PARTITION BY transcript_id ORDER BY seq) IS DISTINCT FROM speaker_id THEN '[' || CASE WHEN start_ms >= 3600000 THEN printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60)
    ELSE printf('%02d:%02d', start_ms // 60000, start_ms // 1000 % 60) END || '] ' || coalesce(display_name, fingerprint_id, speaker_id) END AS header, CASE WHEN is_interruption THEN '  [INT] ' ELSE '  ' END || trim(text) AS line
    FROM turns LEFT JOIN speakers USING (transcript_id, speaker_id) WHERE trim(text) <> ''""", TURNS_SQL + "," + td.SPEAKERS_SQL)  # fmt: skip
def export_text(spark, sf_dir):
    return export.text_lines(segments.with_turn_taking(td.segments(spark, sf_dir)), td.speakers(spark, sf_dir))


@query(
    """SELECT transcript_id, CASE WHEN conv % 7 = 0 THEN 'disabled' WHEN conv % 11 = 0 THEN 'missing-url' WHEN diarization_state = 'failed' THEN 'diarization-failed' ELSE 'ok' END AS reason,
    to_json({'event': 'meeting.transcript.ready', 'transcript_id': transcript_id, 'source': 'speechlake', 'recorded_at': recorded_at, 'store_ref': 'lake:store#' || transcript_id})::VARCHAR AS payload
    FROM (SELECT *, CAST(string_split(transcript_id, '-')[2] AS BIGINT) AS conv FROM transcripts)""", STORE)  # fmt: skip
def webhook_gate(spark, sf_dir):
    t = td.transcripts(spark, sf_dir).withColumn("conv", F.split("transcript_id", "-")[1].cast("bigint"))
    reason = export.emit_reason(F.col("conv") % 7 != 0, F.when(F.col("conv") % 11 != 0, F.lit("u")), F.lit("s"), F.lit(1), F.lit(False), F.col("diarization_state"))
    return t.select("transcript_id", reason.alias("reason"), export.payload("lake:store").alias("payload"))


@query(
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 3 ELSE 2 END AS n_kept, array_to_string(list_sort(CASE WHEN lang = 'en' THEN ['fileName', 'lang', 'sourceType'] ELSE ['fileName', 'sourceType'] END), ',') AS keys FROM documents""")  # fmt: skip
def sanitize_metadata(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    pairs = {"clientName": F.col("source"), "project_id": F.col("source"), "sourceType": F.col("source"), "fileName": F.lit("a"), "CRM-Owner": F.lit("x"), "lang": F.when(F.col("lang") == "en", "en").otherwise("")}
    m = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    kept = urls.compact(urls.public_entries(m))
    return d.select("doc_id", F.size(kept).alias("n_kept"), F.array_join(F.sort_array(F.map_keys(kept)), ",").alias("keys"))


@query(
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/?#]*@)?([^/?#]*)([^?#]*)', 1)) || lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/?#]*@)?([^/?#]*)([^?#]*)', 2))
    || regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/?#]*@)?([^/?#]*)([^?#]*)', 3) || '?a=1&id=' || page_id ELSE url END AS identity FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)""")  # fmt: skip
def url_identity(spark, sf_dir):
    bare = F.regexp_replace("url", "[?#].*$", "")
    signed = F.concat(bare, F.lit("?token=abc&id="), F.col("page_id").cast("string"), F.lit("&X-Amz-Date=9&a=1#top"))
    return td.table(spark, sf_dir, "pages").select("page_id", urls.url_identity(signed).alias("identity"))


@query("SELECT page_id, 'see ' || regexp_replace(url, '[?#].*$', '') || ' Bearer [redacted]' AS text FROM pages")
def redact_urls(spark, sf_dir):
    return td.table(spark, sf_dir, "pages").select("page_id", urls.redacted(F.concat(F.lit("see "), "url", F.lit("?token=abc Bearer sk_live_x1"))).alias("text"))


@query(
    """SELECT 'https://site.example/' || (page_id // 5) AS original_url, page_id AS id, CASE page_id % 5 WHEN 0 THEN 'page-voiceover' WHEN 1 THEN 'external-video' WHEN 2 THEN 'podcast-enclosure' ELSE 'generic-media' END AS kind,
    CASE WHEN page_id % 10 = 3 THEN 'requires-auth' WHEN page_id % 10 = 8 THEN 'found-but-unavailable' ELSE 'downloadable' END AS state,
    row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id % 10 IN (3, 8), CASE WHEN page_id % 5 = 0 THEN 3 ELSE 0 END, -((page_id * 37 % 100)::DOUBLE), page_id::VARCHAR) AS rank,
    CASE WHEN page_id % 5 = 1 THEN 'https://site.example/p/' || page_id WHEN page_id % 10 <> 8 THEN 'https://cdn.example/m/' || page_id || '?token=1' END AS ref, CASE page_id % 10 WHEN 3 THEN 'availability: subscriber_only' WHEN 8 THEN 'candidate is not directly downloadable; select a candidate with a concrete media or extractor URL' END AS reason FROM pages""")  # fmt: skip
def candidate_rank(spark, sf_dir):
    p = td.table(spark, sf_dir, "pages").select("page_id")
    k, i = F.col("page_id") % 5, F.col("page_id").cast("string")
    none = F.lit(None).cast("string")
    entry = F.struct(
        i.alias("id"), F.when(k == 1, "YouTube").otherwise("Generic").alias("extractor"), F.when(k == 1, "YouTube").otherwise("Generic").alias("extractor_key"),
        F.concat(F.lit("https://site.example/p/"), i).alias("webpage_url"),
        F.when(F.col("page_id") % 10 != 8, F.concat(F.lit("https://cdn.example/m/"), i, F.lit("?token=1"))).alias("url"), F.when(k == 0, "AI voiceover").otherwise("Talk").alias("title"),
        F.when(k == 2, "mp3").otherwise("mp4").alias("ext"), F.when(F.col("page_id") % 10 == 3, "subscriber_only").otherwise("public").alias("availability"), none.alias("live_status"),
        (F.col("page_id") * 37 % 100).cast("double").alias("duration"), F.lit(False).alias("is_live"), none.alias("format_id"), none.alias("protocol"),
    )
    info = p.groupBy(F.concat(F.lit("https://site.example/"), F.floor(F.col("page_id") / 5).cast("string")).alias("original_url")).agg(F.sort_array(F.collect_list(F.struct("page_id", entry.alias("e")))).alias("x"))
    out = urls.candidates(info.select("original_url", F.col("x.e").alias("entries")))
    return out.select("original_url", F.col("id").cast("bigint").alias("id"), "kind", "state", "rank", "ref", "reason")


@query(
    """SELECT user_id, n_events, round(total, 4) AS total FROM (SELECT user_id, g, count(*) AS n_events, sum(value) AS total FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g
    FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events)) GROUP BY user_id, g)""")  # fmt: skip
def stream_sessions(spark, sf_dir):
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="speechlake-stream-")
    base = f"{at}/stream-{uuid.uuid4().hex}"
    streams.run_to_table(streams.sessions(streams.event_stream(spark, sf_dir)), f"{base}/result", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/result").select("user_id", "n_events", F.round("total", 4).alias("total"))
