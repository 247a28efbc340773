"""More registered queries: library and store changes, exports as they are written, sources, candidates, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import export, store
from . import testdata as td
from .catalog import CUTS, FP, ISLANDS, KINDS, LIB, PAUSES, RATES, STORE, TURNS_SQL, UNION_SQL, W, S, _library, big, near, query
from .functions import scalars, urls
from .functions import text as tx
from .operators import identity, metrics, segments
from .sources import engines, meetings, readers

SPK = S + "," + td.SPEAKERS_SQL
FULL_METRICS = W + "," + UNION_SQL.removeprefix(S + ",") + "," + TURNS_SQL.removeprefix(S + ",") + "," + ISLANDS + "," + PAUSES + "," + RATES + "," + CUTS + """,
sm AS (SELECT transcript_id, speaker_id, talk_time_ms, talk_ratio, word_count, wpm, coalesce(pause_count, 0) AS pause_count, coalesce(avg_pause_ms, 0.0) AS avg_pause_ms, filler_count, filler_rate,
  coalesce(interruptions_made, 0) AS interruptions_made, coalesce(interruptions_received, 0) AS interruptions_received
  FROM balance LEFT JOIN pauses USING (transcript_id, speaker_id) LEFT JOIN rates USING (transcript_id, speaker_id) LEFT JOIN cuts USING (transcript_id, speaker_id))"""
NAME = "coalesce(display_name, fingerprint_id, speaker_id)"


def _metrics(spark, sf_dir):
    return metrics.speaker_metrics(segments.with_turn_taking(td.segments(spark, sf_dir)), td.words(spark, sf_dir))


# --- the print library ------------------------------------------------------------------------------------------------

COMMIT = KINDS + """,
lib0 AS (SELECT fingerprint_id, status, sample_count, embedding::DOUBLE[] AS embedding FROM prints UNION ALL SELECT 'NEW-' || speaker_key, 'active', 1, embedding FROM kinds WHERE kind = 'new'),
folds AS (SELECT best_id, sum(list_sum(embedding)) AS total, count(*) AS k FROM kinds WHERE kind = 'strong' AND coalesce(duration_ms >= 3000, true) GROUP BY best_id),
heard AS (SELECT CASE kind WHEN 'preassigned' THEN fingerprint_id WHEN 'name_match' THEN name_id WHEN 'new' THEN 'NEW-' || speaker_key ELSE best_id END AS fingerprint_id, speaker_key FROM kinds WHERE kind IN ('strong', 'margin', 'name_match', 'preassigned', 'new'))"""


def _commit(spark, sf_dir):
    prints = td.prints(spark, sf_dir)
    obs = td.observations(spark, sf_dir).withColumns({"transcript_id": F.concat(F.lit("t"), F.floor(F.col("speaker_key") / 8).cast("string")), "speaker_id": F.concat(F.lit("s"), (F.col("speaker_key") % 8).cast("string"))})
    found = identity.match_kinds(obs, prints)
    named = F.when(F.col("kind") == "new", F.concat(F.lit("NEW-"), F.col("speaker_key").cast("string"))).otherwise(F.col("matched_id"))
    return identity.committed(prints, obs, found.withColumn("matched_id", named))


@query("SELECT l.fingerprint_id, status, CAST(sample_count + coalesce(k, 0) AS BIGINT) AS sample_count, round((list_sum(embedding) * sample_count + coalesce(total, 0)) / (sample_count + coalesce(k, 0)), 4) AS total FROM lib0 l LEFT JOIN folds ON best_id = l.fingerprint_id", COMMIT)
def library_commit(spark, sf_dir):
    out, _ = _commit(spark, sf_dir)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return big(out.select("fingerprint_id", "status", "sample_count", F.round(total, 4).alias("total")), "sample_count")


@query("SELECT DISTINCT h.fingerprint_id, 't' || speaker_key // 8 AS transcript_id, 's' || speaker_key % 8 AS speaker_id FROM heard h JOIN lib0 l USING (fingerprint_id) WHERE l.status = 'active'", COMMIT)
def library_sources(spark, sf_dir):
    return _commit(spark, sf_dir)[1]


@query("SELECT fingerprint_id, CASE WHEN vec_id % 10 = 0 THEN 'Label ' || vec_id ELSE display_name END AS display_name FROM prints", FP)
def label_prints(spark, sf_dir):
    prints = td.prints(spark, sf_dir)
    names = prints.where("vec_id % 10 = 0").select("fingerprint_id", F.concat(F.lit("Label "), F.col("vec_id").cast("string")).alias("name"))
    return identity.labelled(prints, names).select("fingerprint_id", "display_name")


@query("SELECT transcript_id, speaker_id, CASE WHEN status IS DISTINCT FROM 'discarded' THEN s.fingerprint_id END AS fingerprint_id FROM speakers s LEFT JOIN prints p USING (fingerprint_id)", SPK + "," + FP)
def drop_discarded_refs(spark, sf_dir):
    return store.without_discarded(td.speakers(spark, sf_dir), td.prints(spark, sf_dir)).select("transcript_id", "speaker_id", "fingerprint_id")


@query("SELECT DISTINCT fingerprint_id, transcript_id, speaker_id FROM speakers s JOIN prints p USING (fingerprint_id) WHERE p.status = 'active'", SPK + "," + FP)
def guarded_sources(spark, sf_dir):
    s = td.speakers(spark, sf_dir)
    return store.guarded_sources(s.unionByName(s), td.prints(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM prints) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'discarded') AS discarded FROM prints", FP)
def status_report(spark, sf_dir):
    out = store.status_report(td.prints(spark, sf_dir))
    return out.select("total", *[F.coalesce(F.element_at("by_status", s), F.lit(0)).alias(s) for s in ("active", "discarded")])


@query("SELECT fingerprint_id, status FROM prints WHERE status = 'discarded' AND (display_name IS NULL OR display_name = '')", FP)
def discarded_unnamed(spark, sf_dir):
    return store.unnamed(store.with_status(td.prints(spark, sf_dir), "discarded")).select("fingerprint_id", "status")


# --- the store --------------------------------------------------------------------------------------------------------


@query("""SELECT transcript_id, '{"transcript_id":"' || transcript_id || '","skipped":true,"reason":"exists"}' AS message FROM transcripts WHERE meeting_type = 'huddle'""", STORE)
def skip_existing(spark, sf_dir):
    t = td.transcripts(spark, sf_dir)
    return store.guarded(t, t.where("meeting_type = 'huddle'"), "skip")[1]


@query(
    """SELECT transcript_id, duration_ms, coalesce(a, 0) AS n_speakers, b AS n_segments, t AS last_text FROM transcripts LEFT JOIN (SELECT transcript_id, count(*) AS a FROM speakers GROUP BY ALL) USING (transcript_id)
    LEFT JOIN (SELECT transcript_id, count(*) AS b, max_by(text, seq) AS t FROM segments GROUP BY ALL) USING (transcript_id)""", STORE)  # fmt: skip
def load_transcripts(spark, sf_dir):
    out = store.loaded(td.transcripts(spark, sf_dir), td.speakers(spark, sf_dir), td.segments(spark, sf_dir))
    n = lambda c: F.size(c).cast("bigint")
    return out.select("transcript_id", "duration_ms", n("speakers").alias("n_speakers"), n("segments").alias("n_segments"), F.element_at("segments", -1)["text"].alias("last_text"))


@query("SELECT transcript_id, seq, count(*) AS n_words, CAST(sum(word_start_ms) AS BIGINT) AS total FROM words GROUP BY ALL", W)
def segment_codec(spark, sf_dir):
    w = td.words(spark, sf_dir).groupBy("transcript_id", "seq").agg(F.collect_list(F.struct(F.col("word").alias("text"), F.col("word_start_ms").alias("start_ms"), F.col("word_end_ms").alias("end_ms"), "confidence")).alias("words"))
    from .schemas import WORD

    back = store.decoded_segments(store.encoded_segments(w), {"words": f"array<{WORD}>"})
    return back.select("transcript_id", "seq", F.size("words").cast("bigint").alias("n_words"), F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x["start_ms"]).alias("total"))


@query("SELECT transcript_id, speaker_id FROM segments GROUP BY ALL", S)
def distinct_speakers(spark, sf_dir):
    s = td.segments(spark, sf_dir)
    return meetings.distinct_speakers(s.where("role = 'user'"), s.where("role <> 'user'"))


@query("SELECT transcript_id FROM transcripts WHERE source_path ILIKE '%call_1%' OR coalesce(source_url ILIKE '%call_1%', false)", STORE.replace("'/Audio/Call_' || conv_id || '.wav' AS source_path", "'/Audio/' || conv_id || '.wav' AS source_path, CASE WHEN conv_id % 2 = 0 THEN 'https://site.example/Call_' || conv_id END AS source_url"))
def list_by_url(spark, sf_dir):
    t = td.transcripts(spark, sf_dir).withColumn("i", F.regexp_extract("source_path", r"_(\d+)\.", 1))
    t = t.withColumns({"source_path": F.concat(F.lit("/Audio/"), "i", F.lit(".wav")), "source_url": F.when(F.col("i").cast("int") % 2 == 0, F.concat(F.lit("https://site.example/Call_"), "i"))})
    return store.list_transcripts(t, td.speakers(spark, sf_dir), td.segments(spark, sf_dir), "call_1", limit=None).select("transcript_id")


# --- exports as they are written ---------------------------------------------------------------------------------------


@query(
    """SELECT transcript_id, seq, to_json({'transcript_id': transcript_id, 'segment_id': segment_id, 'speaker_id': speaker_id, 'start_ms': start_ms, 'end_ms': end_ms, 'text': text, 'asr_confidence': NULL::DOUBLE, 'diarization_quality': diarization_quality,
    'speaker_fingerprint_id': fingerprint_id, 'speaker_display_name': display_name, 'speaker_match_kind': NULL::VARCHAR, 'speaker_match_similarity': NULL::VARCHAR, 'speaker_match_second_similarity': NULL::VARCHAR, 'speaker_match_margin': NULL::VARCHAR,
    'speaker_match_similarity_threshold': NULL::VARCHAR, 'speaker_match_embedding_model': NULL::VARCHAR, 'enrichment': {'overlap_with_prev_ms': overlap_with_prev_ms, 'gap_before_ms': gap_before_ms, 'is_interruption': is_interruption}})::VARCHAR AS line
    FROM turns LEFT JOIN speakers USING (transcript_id, speaker_id)""", TURNS_SQL + "," + td.SPEAKERS_SQL)  # fmt: skip
def export_jsonl_lines(spark, sf_dir):
    return export.jsonl(segments.with_turn_taking(td.segments(spark, sf_dir)), td.speakers(spark, sf_dir))


_CSV = ["transcript_id", "speaker_id", NAME, "fingerprint_id", "''", "''", "''", "''", "''", "''", "talk_time_ms", "round(talk_ratio, 4)", "word_count", "round(wpm, 2)", "pause_count", "round(avg_pause_ms, 2)", "filler_count", "round(filler_rate, 4)", "interruptions_made", "interruptions_received"]


@query(
    f"""SELECT transcript_id, {','.join(export.CSV_FIELDS)!r} || chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY speaker_id) AS document
    FROM (SELECT transcript_id, speaker_id, {" || ',' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _CSV)} AS line FROM sm LEFT JOIN speakers USING (transcript_id, speaker_id)) GROUP BY transcript_id""", FULL_METRICS + "," + td.SPEAKERS_SQL)  # fmt: skip
def export_csv_text(spark, sf_dir):
    m = near(near(_metrics(spark, sf_dir), "talk_ratio", "filler_rate", n=4), "wpm", "avg_pause_ms", n=2)
    return export.csv_text(export.csv_rows(m, td.speakers(spark, sf_dir)))


_AT = "CASE WHEN start_ms >= 3600000 THEN printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) ELSE printf('%02d:%02d', start_ms // 60000, start_ms // 1000 % 60) END"
_SPOKEN = f"""
sp0 AS (SELECT transcript_id, seq, is_interruption, trim(text) AS shown, {_AT} || ' ' || {NAME} AS head, lag(speaker_id) OVER (PARTITION BY transcript_id ORDER BY seq) IS DISTINCT FROM speaker_id AS turned FROM turns LEFT JOIN speakers USING (transcript_id, speaker_id) WHERE trim(text) <> ''),
said AS (SELECT transcript_id, string_agg(CASE WHEN turned THEN '### ' || head || chr(10) ELSE '' END || CASE WHEN is_interruption THEN '**[INT]** ' ELSE '' END || shown || chr(10), chr(10) ORDER BY seq) AS md,
  string_agg(CASE WHEN turned THEN chr(10) || '[' || regexp_replace(head, ' ', '] ') || chr(10) ELSE '' END || CASE WHEN is_interruption THEN '  [INT] ' ELSE '  ' END || shown, chr(10) ORDER BY seq) AS txt FROM sp0 GROUP BY transcript_id),
who AS (SELECT transcript_id, string_agg('- **' || {NAME} || '**: ' || CAST(word_count AS BIGINT) || ' words', chr(10) ORDER BY -talk_ratio, speaker_id) AS md FROM sm LEFT JOIN speakers USING (transcript_id, speaker_id) GROUP BY transcript_id)"""


@query("SELECT transcript_id, regexp_replace('# Transcript ' || transcript_id || chr(10) || chr(10) || '- Meeting type: `' || meeting_type || '`' || chr(10) || chr(10) || who.md || chr(10) || chr(10) || said.md, '\\s+$', '') AS document FROM transcripts JOIN who USING (transcript_id) JOIN said USING (transcript_id)",
       FULL_METRICS + "," + STORE.removeprefix(S + ",") + "," + _SPOKEN)
def export_markdown(spark, sf_dir):
    """The whole document, but for the numbers that C and Java round in other ways."""
    t = td.transcripts(spark, sf_dir)
    out = export.rendered("markdown", {"transcripts": t, "segments": segments.with_turn_taking(td.segments(spark, sf_dir)), "metrics": _metrics(spark, sf_dir), "speakers": td.speakers(spark, sf_dir)}, "minimal")
    d = F.regexp_replace("document", "- Engine: `-`\n- Duration: `[0-9.]+s`\n", "")
    d = F.regexp_replace(F.regexp_replace(d, "\n## Speakers\n\n", "\n"), "\n## Transcript\n\n", "\n")
    return out.select("transcript_id", F.regexp_replace(d, r"\*\*: [0-9.]+% talk, ([0-9]+ words), [0-9]+ wpm", "**: $1").alias("document"))


@query("SELECT transcript_id, txt AS spoken FROM said", FULL_METRICS + "," + STORE.removeprefix(S + ",") + "," + _SPOKEN)
def export_text_document(spark, sf_dir):
    """The spoken part of the whole document."""
    t = td.transcripts(spark, sf_dir)
    out = export.rendered("text", {"transcripts": t, "segments": segments.with_turn_taking(td.segments(spark, sf_dir)), "metrics": _metrics(spark, sf_dir), "speakers": td.speakers(spark, sf_dir)}, "full")
    return out.select("transcript_id", F.element_at(F.split("document", "TRANSCRIPT\n-{40}\n", 2), 2).alias("spoken"))


@query("""SELECT fingerprint_id, to_json({'fingerprint_id': fingerprint_id, 'display_name': display_name, 'sample_count': sample_count, 'embedding_model': embedding_model, 'status': status, 'discard_reason': discard_reason})::VARCHAR AS line FROM library""", LIB)
def fingerprint_export(spark, sf_dir):
    return export.fingerprint_lines(_library(spark, sf_dir).select("fingerprint_id", "display_name", "sample_count", "embedding_model", "status", "discard_reason"))


@query(
    """SELECT transcript_id, '{"duration_ms":' || duration_ms || ',"language":"en","engine":null,"speakers":[' || sp || '],"segments":[' || sg || ']}' AS document FROM transcripts
    JOIN (SELECT transcript_id, string_agg('{"speaker_id":"' || speaker_id || '"' || CASE WHEN fingerprint_id IS NOT NULL THEN ',"fingerprint_id":"' || fingerprint_id || '"' ELSE '' END || CASE WHEN display_name IS NOT NULL THEN ',"display_name":"' || display_name || '"' ELSE '' END || '}', ',' ORDER BY ord) AS sp FROM speakers GROUP BY ALL) USING (transcript_id)
    JOIN (SELECT transcript_id, string_agg(to_json({'segment_id': segment_id, 'speaker_id': speaker_id, 'start_ms': start_ms, 'end_ms': end_ms, 'text': text, 'asr_confidence': NULL, 'diarization_quality': diarization_quality})::VARCHAR, ',' ORDER BY seq) AS sg FROM segments GROUP BY ALL) USING (transcript_id)""", STORE)  # fmt: skip
def export_raw_json(spark, sf_dir):
    from .schemas import WORD

    none = lambda t: F.lit(None).cast(t)
    s = td.segments(spark, sf_dir).select("transcript_id", "seq", "segment_id", "speaker_id", "start_ms", "end_ms", "text", none("double").alias("asr_confidence"), "diarization_quality", none(f"array<{WORD}>").alias("words"))
    p = td.speakers(spark, sf_dir)
    who = p.select("transcript_id", "ord", "speaker_id", none("string").alias("fingerprint_id"), none("string").alias("display_name"), none("array<double>").alias("embedding"))
    raw = store.loaded(td.transcripts(spark, sf_dir).select("transcript_id", "duration_ms", F.lit("en").alias("language"), none("string").alias("engine")), who, s)
    return export.rendered("raw-json", {"raw": raw, "speakers": p.drop("ord")})


# --- sources ------------------------------------------------------------------------------------------------------------

_CONV = "(SELECT conv_id, min(role) AS role FROM conversations GROUP BY ALL)"


def _conversations(spark, sf_dir):
    return td.table(spark, sf_dir, "conversations").select("conv_id").distinct()


@query(
    f"""SELECT conv_id, CASE conv_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'asr produced empty JSON' WHEN 2 THEN 'asr produced invalid JSON' WHEN 3 THEN 'asr produced non-object JSON' WHEN 4 THEN 'asr JSON is missing required key(s): segments' ELSE 'asr did not produce JSON output' END AS problem FROM {_CONV}""")
def engine_json(spark, sf_dir):
    c = _conversations(spark, sf_dir)
    k = F.col("conv_id") % 6
    text = F.when(k == 0, '{"words": [1], "segments": [{"words": 2}]}').when(k == 1, " \n").when(k == 2, '{"words": [').when(k == 3, "[1, 2]").when(k == 4, '{"words": [], "deep": {"segments": 1}}')
    return c.select("conv_id", engines.problem(text, "asr", ("words", "segments")).alias("problem"))


@query(
    """SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY round(start_s, 3), round(end_s, 3), i) - 1 AS BIGINT) AS span_idx, 'Speaker ' || i AS speaker, round(start_s, 3) AS start_s, round(end_s - start_s, 3) AS duration_s
    FROM (SELECT *, dense_rank() OVER (PARTITION BY transcript_id ORDER BY label) - 1 AS i FROM process)""", S + "," + td.SPANS_SQL)  # fmt: skip
def engine_spans(spark, sf_dir):
    return engines.span_documents(td.process_spans(spark, sf_dir)).select("transcript_id", "span_idx", "speaker", "start_s", "duration_s")


@query(
    """SELECT transcript_id, speaker_id, round(list_sum(list_transform(range(len(e)), lambda i: e[i + 1] * (i + 1))), 4) AS total FROM (SELECT transcript_id, speaker_id, list(m ORDER BY pos) AS e FROM (
    SELECT transcript_id, label AS speaker_id, pos, avg(x) AS m FROM (SELECT transcript_id, process.label AS label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM process JOIN embeddings ON vec_id = (conv_id * 7 + seq) % (SELECT count(*) FROM embeddings)) GROUP BY ALL) GROUP BY ALL)""", S + "," + td.SPANS_SQL)  # fmt: skip
def engine_speakers(spark, sf_dir):
    e = td.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    spans = td.process_spans(spark, sf_dir).withColumn("vec_id", (F.col("conv_id") * 7 + F.col("seq")) % F.lit(e.count())).join(e, "vec_id")
    out = engines.speakers_of(spans.select("transcript_id", F.col("label").alias("speakerId"), "embedding"))
    weighed = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("transcript_id", "speaker_id", F.round(weighed, 4).alias("total"))


@query(
    """SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY turn) - 1 AS BIGINT) AS seq, CASE WHEN role = 'user' THEN 'S1' ELSE 'S_unk_' || u END AS speaker_id, CAST(turn * 10000 AS BIGINT) AS start_ms, CAST(CASE WHEN turn % 3 = 0 THEN turn * 10000 ELSE turn * 10000 + 9000 END AS BIGINT) AS end_ms, md5(text) AS digest
    FROM (SELECT 'conv-' || conv_id AS transcript_id, turn, role, regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS text FROM conversations WHERE text IS NOT NULL) LEFT JOIN (SELECT 'conv-' || conv_id AS transcript_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS u FROM conversations WHERE role <> 'user' AND trim(text) <> '' GROUP BY conv_id, role) USING (transcript_id, role) WHERE text <> ''""")  # fmt: skip
def meeting_record(spark, sf_dir):
    c = td.table(spark, sf_dir, "conversations").where("text is not null").withColumn("conference", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")))
    iso = lambda s: F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ends = F.when(F.col("turn") % 3 == 0, iso(F.col("turn") * 10 - 5)).otherwise(iso(F.col("turn") * 10 + 9))
    entries = c.select("conference", F.col("turn").alias("i"), F.col("role").alias("ref"), "text", iso(F.col("turn") * 10).alias("start_time"), ends.alias("end_time"))
    records = c.select("conference", iso(F.lit(0)).alias("start_time")).distinct()
    people = records.select("conference", F.lit("user").alias("ref"), F.lit(0).alias("ord"))
    return meetings.record_segments(records, entries, people).select("transcript_id", "seq", "speaker_id", "start_ms", "end_ms", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    f"""SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'combined' WHEN conv_id % 4 = 1 THEN 'mic+system' END AS source, CAST((1700000000 + conv_id) * 1000 + 250 AS BIGINT) AS recorded_ms, CASE WHEN conv_id % 4 >= 2 THEN 'no audio found for meeting m' || conv_id END AS problem FROM {_CONV}""")
def meeting_audio(spark, sf_dir):
    c = _conversations(spark, sf_dir).withColumn("k", F.col("conv_id") % 4)
    variants = F.when(F.col("k") == 0, F.array(F.lit("combined"), F.lit("mic"))).when(F.col("k") == 1, F.array(F.lit("mic"), F.lit("system"))).otherwise(F.array(F.lit("mic")))
    at = F.format_string("/meetings/2024-m%d/rec-FINAL-%d.25-1.5-%s.m4a", "conv_id", F.lit(1_700_000_000) + F.col("conv_id"), "variant")
    out = meetings.meeting_audio(c.withColumn("variant", F.explode(variants)).select(at.alias("path")))
    return out.select(F.expr("cast(substring(id, 2) as bigint)").alias("conv_id"), "source", F.unix_millis("recorded_at").alias("recorded_ms"), "problem")


@query(
    f"""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'local-audio' WHEN conv_id % 2 = 0 THEN 'meet-recording' WHEN conv_id % 5 = 0 THEN 'meet-text-fallback' END AS source_kind, CASE WHEN conv_id % 3 = 0 THEN '/a/' || conv_id WHEN conv_id % 2 = 0 THEN 'new' END AS ref, conv_id % 3 <> 0 AND conv_id % 2 <> 0 AND conv_id % 5 <> 0 AS fails FROM {_CONV}""")
def source_choice(spark, sf_dir):
    c = _conversations(spark, sf_dir).withColumn("conference", F.col("conv_id").cast("string"))
    i = F.col("conv_id")
    conferences = c.select("conference", F.when(i % 3 == 0, F.concat(F.lit("/a/"), "conference")).otherwise("").alias("local_audio"))
    r = lambda state, end, file: F.struct(F.lit(state).alias("state"), F.lit(None).cast("string").alias("start_time"), F.lit(end).alias("end_time"), F.lit(file).alias("file"))
    recordings = c.where(i % 2 == 0).select("conference", F.explode(F.array(r("ENDED", "2024-01-01", "old"), r("FILE_GENERATED", "2024-02-01", "new"), r("STARTED", "2024-03-01", "running")))).select("conference", "col.*")
    out = meetings.chosen_source(conferences, recordings, c.where(i % 5 == 0).select("conference"))
    return out.select(F.col("conference").cast("bigint").alias("conv_id"), "source_kind", "ref", F.col("problem").isNotNull().alias("fails"))


@query("SELECT conv_id, turn, n FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 5")
def paged_items(spark, sf_dir):
    c = td.table(spark, sf_dir, "conversations").withColumn("page", F.floor(F.col("turn") / 3))
    saved = c.groupBy(F.col("conv_id").alias("query"), "page").agg(F.sort_array(F.collect_list("turn")).alias("items"))
    return meetings.pages(saved, 5).select(F.col("query").alias("conv_id"), F.col("item").alias("turn"), "n")


# --- scalars ------------------------------------------------------------------------------------------------------------


@query(
    """SELECT transcript_id, CASE WHEN d >= 3600000 THEN printf('%d:%02d:%02d', d // 3600000, d // 60000 % 60, d // 1000 % 60) ELSE printf('%d:%02d', d // 60000, d // 1000 % 60) END AS clock, coalesce(epoch_ms(strptime(recorded_at, '%Y-%m-%dT%H:%M:%S')), 0) AS recorded_ms,
    'Call_' || split_part(transcript_id, '-', 2) AS title, '.wav' AS ending FROM (SELECT *, duration_ms * 31 AS d FROM transcripts)""", STORE)  # fmt: skip
def transcript_scalars(spark, sf_dir):
    t = td.transcripts(spark, sf_dir)
    return t.select(
        "transcript_id", scalars.clock(F.col("duration_ms") * 31).alias("clock"), scalars.epoch_ms(F.col("recorded_at")).alias("recorded_ms"),
        scalars.title_hint(F.lit('{"title": ""}'), F.col("source_path")).alias("title"), scalars.ending(F.concat(F.lit("file://h"), F.col("source_path"))).alias("ending"),
    )


@query("SELECT page_id, page_id % 7 NOT IN (1, 2, 3, 4) AS public FROM pages")
def public_urls(spark, sf_dir):
    k = F.col("page_id") % 7
    url = F.when(k == 1, "http://localhost:8080/x").when(k == 2, "http://10.1.2.3/").when(k == 3, "https://printer.local./").when(k == 4, F.regexp_replace("url", "^https?", "ftp")).when(k == 5, "https://8.8.8.8/x").otherwise(F.col("url"))
    return td.table(spark, sf_dir, "pages").select("page_id", scalars.is_public_url(url).alias("public"))


@query("""SELECT page_id, 'see ' || regexp_replace(url, '[?#].*$', '') || ' Bearer [redacted]' AS text, CASE WHEN page_id % 2 = 0 THEN '{"a": ["' || regexp_replace(url, '[?#].*$', '') || '/[redacted]", 1]}' ELSE '[redacted]' END AS deep FROM pages""")
def redacted_texts(spark, sf_dir):
    p = td.table(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", "[?#].*$", "")
    secret = F.concat(bare, F.lit("/Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9?x=1"))
    nested = scalars.redacted_json(F.concat(F.lit('{"a": ["'), secret, F.lit('", 1]}')))
    deep = F.when(F.col("page_id") % 2 == 0, nested).otherwise(urls.redacted(F.lit("sk_livex.Ab1Cd2Ef3.Gh4Ij5Kl6")))
    return p.select("page_id", urls.redacted(F.concat(F.lit("see "), "url", F.lit(" Bearer abc.def"))).alias("text"), deep.alias("deep"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '{"fileName":"f","deep":[{"x":' || page_id || '}]}' WHEN 1 THEN '{}' END AS kept FROM pages""")
def nested_privacy(spark, sf_dir):
    k, i = F.col("page_id") % 3, F.col("page_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit('{"fileName": "f", "clientId": 1, "deep": [{"CRM_key": 2, "x": '), i, F.lit("}]}"))).when(k == 1, '{"ownerName": {"a": 1}}').otherwise("[1]")
    return td.table(spark, sf_dir, "pages").select("page_id", scalars.public_json(text).alias("kept"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lang || ' ' || source || ' (' || doc_id || ')!', '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') AS stem, left(sha1(source || doc_id), 16) AS id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def stems_and_ids(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    return d.select("doc_id", tx.safe_stem(F.concat("lang", F.lit(" "), "source", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")!"))).alias("stem"), tx.stable_id(F.concat("source", F.col("doc_id").cast("string"))).alias("id"))


@query(f"SELECT conv_id, strftime(make_timestamp(CAST((1700000000 + conv_id * 86400) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || 'Z' AS at FROM {_CONV}")
def feed_dates(spark, sf_dir):
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 86400)
    return _conversations(spark, sf_dir).select("conv_id", readers.iso_or_text(F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss '+0000'")).alias("at"))


@query(r"""SELECT d.doc_id, simhash FROM documents d LEFT JOIN (SELECT doc_id, printf('%08x', sum(CASE WHEN i >= 32 AND on_ THEN 1::BIGINT << (i - 32) ELSE 0 END)::BIGINT) || printf('%08x', sum(CASE WHEN i < 32 AND on_ THEN 1::BIGINT << i ELSE 0 END)::BIGINT) AS simhash
    FROM (SELECT doc_id, i, 2 * sum((h >> i) & 1) >= count(*) AS on_ FROM (SELECT doc_id, ('0x' || left(md5(f), 16))::UBIGINT AS h FROM (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' ')))) AS f
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents) WHERE len(t) >= 6)), (SELECT unnest(range(64))::INTEGER AS i) GROUP BY doc_id, i) GROUP BY doc_id) USING (doc_id)""")
def simhash_md5(spark, sf_dir):
    return tx.md5_signatures(td.table(spark, sf_dir, "documents"), "doc_id")


# --- candidates -----------------------------------------------------------------------------------------------------------


def _found(spark, sf_dir):
    """Five pages an address, of which some are open; page 3 of ten repeats; pages of nine stand alone as the root."""
    p = td.table(spark, sf_dir, "pages").select("page_id")
    i, none = F.col("page_id").cast("string"), F.lit(None).cast("string")
    entry = F.struct(
        i.alias("id"), F.lit("Generic").alias("extractor"), F.lit("Generic").alias("extractor_key"), F.concat(F.lit("https://site.example/p/"), i).alias("webpage_url"),
        F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("https://cdn.example/m/"), i, F.lit("?token=1"))).alias("url"), F.lit("Talk").alias("title"), F.lit("mp4").alias("ext"),
        F.when(F.col("page_id") % 5 != 1, "subscriber_only").otherwise("public").alias("availability"), none.alias("live_status"), F.lit(1.0).alias("duration"), F.lit(False).alias("is_live"),
        none.alias("format_id"), none.alias("protocol"),
    )
    alone = p.where("page_id % 9 = 0").select(F.concat(F.lit("https://alone.example/"), i).alias("original_url"), F.array().cast(f"array<{entry_type()}>").alias("entries"), entry.alias("root"))
    group = p.groupBy(F.concat(F.lit("https://site.example/"), F.floor(F.col("page_id") / 5).cast("string")).alias("original_url")).agg(F.flatten(F.collect_list(F.array(entry, entry))).alias("entries"))
    return urls.candidates(group.withColumn("root", F.lit(None).cast(entry_type())).unionByName(alone), lambda seed: F.left(F.md5(seed.cast("binary")), F.lit(20)))


def entry_type() -> str:
    from .schemas import CANDIDATE_INFO

    return CANDIDATE_INFO.split("entries array<", 1)[1][:-1]


FOUND = """
f0 AS (SELECT page_id, 'https://site.example/' || (page_id // 5) AS original_url FROM pages UNION ALL SELECT page_id, 'https://alone.example/' || page_id FROM pages WHERE page_id % 9 = 0),
found AS (SELECT *, left(md5('Generic' || chr(31) || page_id || chr(31) || original_url || chr(31)), 20) AS candidate_id, CASE WHEN page_id % 5 <> 1 THEN 'requires-auth' WHEN page_id % 3 <> 0 THEN 'downloadable' ELSE 'downloadable' END AS state,
  CASE WHEN page_id % 3 <> 0 THEN 'https://cdn.example/m/' || page_id || '?token=1' END AS ref FROM f0),
open AS (SELECT *, state = 'downloadable' AND ref IS NOT NULL AS free FROM found)"""


@query("""SELECT original_url, page_id, candidate_id, CASE WHEN state = 'requires-auth' THEN state WHEN free THEN state ELSE 'found-but-unavailable' END AS state, ref, CASE WHEN state = 'requires-auth' THEN 'availability: subscriber_only' WHEN NOT free THEN
    'candidate is not directly downloadable; select a candidate with a concrete media or extractor URL' END AS reason, row_number() OVER (PARTITION BY original_url ORDER BY NOT free, candidate_id) AS rank FROM open""", FOUND)  # fmt: skip
def candidate_ids(spark, sf_dir):
    return _found(spark, sf_dir).select("original_url", F.col("id").cast("bigint").alias("page_id"), "candidate_id", "state", "ref", "reason", "rank")


@query("""SELECT original_url, CASE WHEN n = 1 THEN id END AS candidate_id, CASE WHEN n = 1 THEN r END AS ref, CASE WHEN n = 0 THEN why END AS problem FROM (SELECT original_url, count(*) FILTER (free) AS n, max(candidate_id) FILTER (free) AS id, max(ref) FILTER (free) AS r,
    min_by(CASE WHEN state = 'requires-auth' THEN 'availability: subscriber_only' ELSE 'candidate is not directly downloadable; select a candidate with a concrete media or extractor URL' END, candidate_id) AS why FROM open GROUP BY original_url)""", FOUND)  # fmt: skip
def candidate_choice(spark, sf_dir):
    return urls.selected(_found(spark, sf_dir), sure=True)
