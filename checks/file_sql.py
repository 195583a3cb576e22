"""SQL of the file, model and whole-job queries."""

import re

from checks.layout_sql import PARTS as LAYOUT
from checks.text_sql import CENTI, CLOCK

# Fixed value: the format line of styles.
STYLE_FORMAT = (
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, "
    "Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, "
    "MarginR, MarginV, Encoding"
)

RANGE = f"{CLOCK.format('start_ms')} || ' --> ' || {CLOCK.format('end_ms')}"
STRICT_BACK = ("CAST(trunc(({0} // 3600000 * 3600 + ({0} % 3600000) // 60000 * 60 + "
               "CAST(printf('%02d.%03d', ({0} % 60000) // 1000, {0} % 1000) AS DOUBLE)) * 1000) AS BIGINT)")
WRAPPED = r"array_to_string(regexp_extract_all({0}, '.{{1,14}}'), '\N')"
DIALOGUE = "'Dialogue: 0,' || {s} || ',' || {e} || ',NoteStyle,,0,0,0,,' || {t}"


def parts_of(table: str, text: str, rows: int, sep: str = "chr(10)") -> str:
    return f"""
        SELECT track, (line - 1) // {rows} AS part, string_agg({text}, {sep} ORDER BY line) AS text
        FROM {table} GROUP BY track, (line - 1) // {rows}"""


def again(part: str) -> str:
    """A part over the timeline as really cut."""
    for name in ("ends_", "hits", "near_clip", "clip_timed", "moved"):
        part = part.replace(f" {name} ", f" {name}2 ").replace(f" {name}\n", f" {name}2\n")
    return part.replace("FROM timeline", "FROM cut_").replace("JOIN timeline", "JOIN cut_")


#: Queries whose tracks have two frame rates.
TWO_RATES = ("dubbed_cues", "dubbed_timeline")


def at_two_rates(sql: str) -> str:
    rate = "(CASE WHEN {} % 2 = 0 THEN 25.0 ELSE 30.0 END)::DOUBLE"
    # Where points meet segments, the point's track is meant.
    sql = re.sub(r"(p\.at_ms\) END / 1000\.0::DOUBLE\) \* )30\.0::DOUBLE(, 0\)\s*/ )30\.0::DOUBLE",
                 lambda m: m[1] + rate.format("p.track") + m[2] + rate.format("p.track"), sql)
    return sql.replace("30.0::DOUBLE", rate.format("track"))


PARTS = {
    "cut_": """
        SELECT track, seg_no, orig_start, orig_end, kind, clip_ms, video_speed, audio_speed,
               (sum(actual_frames) OVER w - actual_frames) / 30.0::DOUBLE * 1000.0::DOUBLE AS new_start,
               (sum(actual_frames) OVER w) / 30.0::DOUBLE * 1000.0::DOUBLE AS new_end,
               actual_frames / 30.0::DOUBLE * 1000.0::DOUBLE AS new_chunk_dur
        FROM realised WINDOW w AS (PARTITION BY track ORDER BY seg_no ROWS UNBOUNDED PRECEDING)""",
    "ends_2": again(LAYOUT["ends_"]),
    "hits2": again(LAYOUT["hits"]),
    "moved2": again(LAYOUT["moved"]),
    "near_clip2": again(LAYOUT["near_clip"]),
    "clip_timed2": again(LAYOUT["clip_timed"]),
    "muted_lines": "SELECT *, row_number() OVER (PARTITION BY track ORDER BY line) AS no FROM mutes",
    "told_lines": r"""
        SELECT track, line, row_number() OVER (PARTITION BY track ORDER BY line) AS no, text
        FROM lines WHERE trim(text) <> ''""",
    "ass_lines": f"""
        SELECT track || '/' || ((line - 1) // 40) AS track, 10 + (line - 1) % 40 AS line_no, start_ms // 10 * 10 AS start_ms,
               end_ms // 10 * 10 AS end_ms, {WRAPPED.format("(text || ', ' || kind)")} AS text FROM cues""",
    "replied": """
        SELECT c.track, c.line, c.start_ms, c.end_ms, c.text, (line - 1) // 40 AS batch, (line - 1) % 40 AS pos,
               first_value(start_ms) OVER (PARTITION BY track, (line - 1) // 40 ORDER BY line) AS t0
        FROM cues c""",
    "scenes": """
        SELECT track, frame_no, f AS ts_s, changed AND passed AS opens, bits
        FROM (SELECT track, frame_no, frame_no / 10.0::DOUBLE AS f,
                     len(list_filter(embedding, lambda x: abs(x) > 0.25::DOUBLE)) / len(embedding) >= 0.03 AS passed,
                     prev IS NULL OR list_sum(list_transform(range(1, 65),
                          lambda i: CASE WHEN (embedding[i] > 0) <> (prev[i] > 0) THEN 1 ELSE 0 END)) > 30 AS changed,
                     len(list_filter(embedding, lambda x: x > 0)) AS bits
              FROM (SELECT *, lag(embedding) OVER (PARTITION BY track ORDER BY frame_no) AS prev
                    FROM frames_ WHERE frame_no % 2 = 0))""",
    "scene_cues": """
        SELECT track, row_number() OVER (PARTITION BY track ORDER BY cue) AS line, start_ms, end_ms, text FROM (
            SELECT track, cue, CAST(round_even(min(ts_s) * 1000, 0) AS BIGINT) AS start_ms,
                   CAST(round_even(CASE WHEN count(*) > 1 THEN max(ts_s) ELSE min(ts_s) + 3.0::DOUBLE END * 1000, 0) AS BIGINT) AS end_ms,
                   CASE arg_min(bits, frame_no) % 4 WHEN 0 THEN 'red house' WHEN 1 THEN 'blue sky' ELSE '' END AS text
            FROM (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame_no
                                ROWS UNBOUNDED PRECEDING) AS cue FROM scenes)
            WHERE cue > 0 GROUP BY track, cue)
        WHERE text <> ''""",
}

from checks.interval_sql import clamped, islands  # noqa: E402

PARTS["scene_runs"] = islands("scene_cues", "text = ptext")

TRANSLATED = """
    SELECT track, line, (no - 1) // 30 AS batch, (no - 1) % 30 AS pos,
           first_value(line) OVER (PARTITION BY track, (no - 1) // 30 ORDER BY line) // 30 % 4 NOT IN (1, 2) AS ok, text,
           11 + length(string_agg(text, chr(10)) OVER (PARTITION BY track ORDER BY line
                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS size
    FROM told_lines"""

QUERIES = {
    "srt_by_ranges": ("cues", f"""
        SELECT line, {STRICT_BACK.format('start_ms')} AS start_ms, {STRICT_BACK.format('end_ms')} AS end_ms, track || ': ' || text AS text
        FROM cues WHERE {STRICT_BACK.format('end_ms')} > {STRICT_BACK.format('start_ms')}"""),
    "srt_write": ("cues", parts_of("cues", f"line || chr(10) || {RANGE} || chr(10) || text || chr(10)", 40)),
    "srt_write_untimed": ("muted_lines", f"""
        SELECT track, (no - 1) // 40 AS part, string_agg(line || chr(10) || {RANGE} || chr(10), chr(10) ORDER BY line) AS text
        FROM muted_lines GROUP BY track, (no - 1) // 40"""),
    "srt_parse": ("cues", f"""
        SELECT track, (line - 1) % 40 AS block, line, {STRICT_BACK.format('start_ms')} AS start_ms, {STRICT_BACK.format('end_ms')} AS end_ms,
               {CLOCK.format('start_ms')} AS start_raw, {CLOCK.format('end_ms')} AS end_raw, {RANGE} AS time,
               CASE WHEN event_id % 20 = 6 THEN text || chr(10) || 'two' ELSE text END AS text
        FROM cues WHERE event_id % 20 NOT IN (1, 2, 3, 4, 5) AND {STRICT_BACK.format('end_ms')} > {STRICT_BACK.format('start_ms')}"""),
    "srt_rejects": ("cues", f"""
        SELECT track, (line - 1) // 40 AS part, (line - 1) % 40 AS block,
               CASE event_id % 20 WHEN 1 THEN 'no index' WHEN 2 THEN 'no arrow' WHEN 3 THEN 'bad stamp' WHEN 4 THEN 'no length'
                    ELSE CASE WHEN {STRICT_BACK.format('end_ms')} <= {STRICT_BACK.format('start_ms')} THEN 'no length' ELSE 'empty text' END END AS reason
        FROM cues WHERE event_id % 20 IN (1, 2, 3, 4, 5) OR {STRICT_BACK.format('end_ms')} <= {STRICT_BACK.format('start_ms')}"""),
    "srt_parse_strict": ("cues", """
        SELECT track, line, round(s, 6) AS start_s, round(CASE WHEN e < s THEN s + 1.0 ELSE e END, 6) AS end_s,
               CASE event_id % 20 WHEN 5 THEN '<i></i>' WHEN 6 THEN '<b>' || text || '</b>' || chr(10) || '<i>two</i>' ELSE text END AS text
        FROM (SELECT *, CASE WHEN event_id % 20 = 3 THEN 0.0::DOUBLE ELSE start_ms / 1000.0::DOUBLE END AS s,
                     CASE WHEN event_id % 20 = 4 THEN 0.0::DOUBLE ELSE end_ms / 1000.0::DOUBLE END AS e FROM cues)
        WHERE event_id % 20 NOT IN (1, 2, 7)"""),
    "ass_render": ("cues", f"""
        SELECT track, line, {DIALOGUE.format(s=CENTI.format('start_ms'), e=CENTI.format('end_ms'), t=WRAPPED.format('text'))} AS value
        FROM cues"""),
    "ass_dialogues": ("ass_lines", f"""
        SELECT track, line_no, '0' AS layer, {CENTI.format('start_ms')} AS start, {CENTI.format('end_ms')} AS "end", 'NoteStyle' AS style,
               text, true AS complete, start_ms, end_ms FROM ass_lines"""),
    "ass_headers": ("ass_lines", """
        SELECT DISTINCT track, 'v4.00+' AS script_type, CAST(2 AS BIGINT) AS entries, 'Style: NoteStyle,Sans,60,&H00000000' AS styles,
               'Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text' AS events_format FROM ass_lines"""),
    "ass_scaled": ("ass_lines", f"""
        SELECT track, line_no, {DIALOGUE.format(s=CENTI.format('s'), e=CENTI.format('e'), t='text')} AS value
        FROM (SELECT track, line_no, text, s, CASE WHEN e <= s THEN s + 1 ELSE e END AS e FROM (
            SELECT track, line_no, text, greatest(1, CAST(round_even(start_ms / 1.5::DOUBLE, 0) AS BIGINT)) AS s,
                   greatest(1, CAST(round_even(end_ms / 1.5::DOUBLE, 0) AS BIGINT)) AS e FROM ass_lines))"""),
    "stamped_text": ("cues", parts_of("cues", f"'[' || {CLOCK.format('start_ms')} || '] ' || text", 40)),
    "minified_text": ("told_lines", """
        SELECT track, (no - 1) // 40 AS part, string_agg(trim(text), chr(10) ORDER BY no) AS text
        FROM told_lines GROUP BY track, (no - 1) // 40"""),
    "latin_report": ("cues", f"SELECT track, line, '[' || {RANGE} || ']' || chr(10) || text AS report FROM cues"),
    "word_json": ("tokens", """
        SELECT track, tok_idx // 40 AS part,
               to_json({'language': 'en', 'text': string_agg(text, '' ORDER BY tok_idx),
                        'time_stamps': list({'text': text, 'start_time': round(start_s, 3), 'end_time': round(end_s, 3)} ORDER BY tok_idx)})::VARCHAR AS json
        FROM tokens GROUP BY track, tok_idx // 40"""),
    "speech_queue": ("cues", """
        SELECT track, line, start_ms, end_ms, text, line - 1 AS clip_no, 'clips/dubb-' || (line - 1) || '.wav' AS filename,
               last_value(end_ms) OVER (PARTITION BY track ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total_ms
        FROM cues"""),
    "whole_text_queue": (None, """
        SELECT doc_id AS track, CAST(1 AS BIGINT) AS line, CAST(0 AS BIGINT) AS start_ms, CAST(0 AS BIGINT) AS end_ms, text,
               CAST(0 AS BIGINT) AS clip_no, 'dubb-0.wav' AS filename, CAST(0 AS BIGINT) AS total_ms FROM documents"""),
    "transcript_cues": ("replied", """
        SELECT track, batch, row_number() OVER (PARTITION BY track, batch ORDER BY pos) AS line,
               round(s + t0 / 1000.0::DOUBLE, 3) AS start_s, round(e + t0 / 1000.0::DOUBLE, 3) AS end_s, text
        FROM (SELECT *, (start_ms - t0) % 3600000 // 10 / 100.0::DOUBLE AS s, (end_ms - t0) % 3600000 // 10 / 100.0::DOUBLE AS e FROM replied)
        WHERE e > s"""),
    "manifest_outputs": (None, r"""
        SELECT input, output, output_dir, regexp_replace(regexp_extract(output, '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1') AS output_stem,
               input IS NULL AS rejected
        FROM (SELECT *, regexp_replace(output, '/[^/]*$', '') AS output_dir FROM (
            SELECT input, CASE WHEN input IS NULL THEN NULL
                        WHEN k = 1 THEN 'out/folder/' || stem || '.srt' WHEN k = 2 THEN 'out/named.txt'
                        WHEN k = 3 THEN 'out/v1.2' ELSE regexp_replace(input, '/[^/]*$', '') || '/' || stem || '.srt' END AS output
            FROM (SELECT *, regexp_replace(regexp_extract(input, '([^/]*)$', 1), '^(.+)\.mp4$', '\1') AS stem FROM (
                SELECT page_id % 6 AS k, CASE WHEN page_id % 6 <> 5 THEN 'in/' || regexp_replace(url, '[?#].*$', '') || '.mp4' END AS input
                FROM pages))))"""),
    "routed_lines": (None, r"""
        WITH p AS (SELECT page_id, 'in/' || regexp_replace(url, '[?#].*$', '') || '.mp4' AS track, html FROM pages),
        named AS (SELECT track, min(page_id) AS first_id FROM p GROUP BY track),
        lines AS (SELECT page_id, track, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS line FROM p)
        SELECT page_id, line, CASE WHEN first_id % 2 = 0 THEN 'out/folder/' ELSE regexp_replace(track, '/[^/]*$', '') || '/' END || stem || '.srt' AS output,
               stem AS output_stem
        FROM (SELECT l.*, first_id, regexp_replace(regexp_extract(track, '([^/]*)$', 1), '^(.+)\.mp4$', '\1') AS stem
              FROM lines l JOIN named USING (track))"""),
    "boxes": (None, """
        SELECT name, x, y, w, h FROM (
            SELECT p_partkey % 7 AS k, replace(p_name, ' ', '_') AS name, p_partkey AS x, CAST(p_size AS BIGINT) AS y,
                   CAST(p_size * 2 AS BIGINT) AS w, CAST(80 AS BIGINT) AS h FROM part)
        WHERE k IN (0, 5, 6)"""),
    "media_types": (None, """
        SELECT media, count(*) AS files FROM (
            SELECT CASE CASE WHEN url LIKE '%/' THEN 4 ELSE page_id % 9 END WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'srt' WHEN 3 THEN 'ass' WHEN 6 THEN 'video'
                        WHEN 8 THEN 'audio' ELSE 'unknown' END AS media FROM pages) GROUP BY media"""),
    "full_text": (None, """
        SELECT conv_id AS track, (no - 1) // 3 AS part, string_agg(text, chr(10) ORDER BY no) AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations)
        GROUP BY conv_id, (no - 1) // 3"""),
    "transcript": ("lines", r"""
        SELECT track, (no - 1) // 40 AS part, trim(regexp_replace(string_agg(trim(text), ' ' ORDER BY no), '\s+', ' ', 'g')) AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY line) AS no FROM lines WHERE text <> '')
        WHERE track % 3 <> 0 GROUP BY track, (no - 1) // 40
        UNION ALL SELECT doc_id, 0, trim(text) FROM documents WHERE doc_id % 3 = 0"""),
    "batch_messages": ("cues", f"""
        SELECT track, (line - 1) // 30 AS batch, count(*) AS blocks,
               'Translate.' || chr(10) || 'No context.' || chr(10)
               || string_agg(line || chr(10) || {RANGE} || chr(10) || text, chr(10) || chr(10) ORDER BY line) || chr(10) || 'End.' AS message
        FROM cues GROUP BY track, (line - 1) // 30"""),
    "translated_cues": ("told_lines", f"""
        SELECT track, line, batch, pos, CASE WHEN ok THEN '»' || size || ' ' || trim(text) ELSE text END AS text,
               CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status FROM ({TRANSLATED})"""),
    "translation_report": ("told_lines", f"""
        SELECT track, CAST(sum(n) AS BIGINT) AS total_blocks, count(*) AS total_batches, count(*) FILTER (ok) AS success,
               count(*) FILTER (NOT ok) AS failed
        FROM (SELECT track, batch, count(*) AS n, bool_and(ok) AS ok FROM ({TRANSLATED}) GROUP BY track, batch) GROUP BY track"""),
    "ledgered_calls": ("cues", """
        SELECT track, count(*) AS batches, count(*) AS answered, count(*) FILTER (batch % 2 = 0) AS asked_0,
               count(*) FILTER (batch % 2 = 1) AS asked_1, CAST(0 AS BIGINT) AS asked_2
        FROM (SELECT DISTINCT track, (line - 1) // 30 AS batch FROM cues) GROUP BY track"""),
    "batch_merge": ("cues", f"""
        SELECT track, line, CASE WHEN status = 'ok' THEN upper(text) ELSE text END AS text, status FROM (
            SELECT track, line, text, CASE WHEN batch % 4 = 3 THEN 'failed' WHEN batch % 4 = 1 AND n = 1 THEN 'failed'
                        WHEN batch % 4 = 1 OR bad > 0 THEN 'mismatch' ELSE 'ok' END AS status
            FROM (SELECT *, (line - 1) // 30 AS batch, count(*) OVER b AS n,
                         sum(CASE WHEN {STRICT_BACK.format('end_ms')} <= {STRICT_BACK.format('start_ms')} THEN 1 ELSE 0 END) OVER b AS bad
                  FROM cues WINDOW b AS (PARTITION BY track, (line - 1) // 30)))"""),
    "recognised_items": ("cues", """
        SELECT track, line, CASE WHEN line % 5 <> 0 THEN 'seen ' || kind ELSE '' END AS text FROM cues"""),
    "missing_clips_made": ("cues", """
        SELECT track, line - 1 AS clip_no, 40 * length(text) AS clip_ms, true AS ok FROM cues WHERE k % 7 = 0"""),
    "clip_outcomes": ("cues", """
        SELECT track, count(*) AS ok, CAST(0 AS BIGINT) AS err FROM cues WHERE k % 7 = 0 GROUP BY track"""),
    "ass_retimed": ("moved", f"""
        SELECT track, line AS line_no, {DIALOGUE.format(s=CENTI.format('s'), e=CENTI.format('e'), t="replace(text, 'x', 'x')")} AS value
        FROM (SELECT c.track, c.line, {WRAPPED.format('c.text')} AS text,
                     CAST(round_even(a.new_ms, 0) AS BIGINT) AS s, CAST(round_even(b.new_ms, 0) AS BIGINT) AS e
              FROM cues c JOIN centi_moved a ON a.track = c.track AND a.at_ms = c.start_ms // 10 * 10
              JOIN centi_moved b ON b.track = c.track AND b.at_ms = c.end_ms // 10 * 10)"""),
    "dubbed_cues": ("clip_timed2", """
        SELECT track, line, CAST(round_even(s_ms, 0) AS BIGINT) AS start_ms,
               CAST(round_even(CASE WHEN e_ms <= s_ms THEN s_ms + 100 ELSE e_ms END, 0) AS BIGINT) AS end_ms, text FROM clip_timed2"""),
    "dubbed_timeline": ("cut_", """
        SELECT track, round(orig_start, 6) AS orig_start, round(orig_end, 6) AS orig_end, round(new_start, 6) AS new_start,
               round(new_end, 6) AS new_end, round(video_speed, 6) AS video_speed, round(audio_speed, 6) AS audio_speed,
               round(new_chunk_dur, 6) AS new_chunk_dur, kind, clip_ms FROM cut_"""),
    "screen_text_cues_exact": ("scene_runs", clamped("scene_runs")),
    "overlap_report": ("cues", """
        SELECT track, count(*) AS overlaps
        FROM (SELECT *, lead(start_ms) OVER (PARTITION BY track ORDER BY start_ms, (kind = 'error')::INT, line) AS n FROM cues)
        WHERE end_ms > n GROUP BY track"""),
}
HEAD = ("[Script Info]", "ScriptType: v4.00+", "PlayResX: 1920", "", "[V4+ Styles]", STYLE_FORMAT, "Style: NoteStyle,Sans,60,&H00000000", "",
        "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text")
QUERIES["ass_scaled_files"] = ("ass_lines", f"""{QUERIES["ass_scaled"][1]}
        UNION ALL SELECT track, line_no, value FROM (SELECT DISTINCT track FROM ass_lines),
            (VALUES {", ".join(f"({i}, '{line}')" for i, line in enumerate(HEAD))}) h(line_no, value)""")
PARTS["centi_stops"] = "SELECT track, start_ms // 10 * 10 AS at_ms FROM cues UNION SELECT track, end_ms // 10 * 10 FROM cues"
PARTS["centi_hits"] = LAYOUT["hits"].replace("FROM stops", "FROM centi_stops")
PARTS["centi_moved"] = (
    LAYOUT["moved"].replace("FROM stops", "FROM centi_stops").replace("JOIN hits h", "JOIN centi_hits h")
)
QUERIES["ass_retimed"] = ("centi_moved", QUERIES["ass_retimed"][1])
