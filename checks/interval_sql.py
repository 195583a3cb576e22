"""SQL of the interval queries."""

PARTS = {
    "axis": """
        SELECT user_id AS track, event_id, event_type AS kind, value, props,
               date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) // 1000 AS start_ms
        FROM events""",
    "cues": """
        SELECT track, row_number() OVER (PARTITION BY track ORDER BY start_ms, event_id) AS line, event_id, kind,
               start_ms, start_ms + greatest(1, CAST(trunc(value * 600000) AS BIGINT)) AS end_ms,
               kind || ' ' || props AS text, CAST(json_extract(props, '$.k') AS BIGINT) AS k
        FROM axis""",
    "speech": "SELECT * FROM cues WHERE kind <> 'error'",
    "mutes": "SELECT * FROM cues WHERE kind = 'error'",
    "totals": "SELECT track, max(end_ms) AS total_ms FROM cues GROUP BY track",
    "series": "SELECT track, event_id, start_ms AS at_ms, value FROM axis",
    "lines": """
        SELECT doc_id AS track, generate_subscripts(string_split(text, chr(10)), 1) AS line,
               unnest(string_split(text, chr(10))) AS text
        FROM documents""",
    "clear": """
        SELECT track, row_number() OVER (PARTITION BY track ORDER BY line, start_ms) AS line, event_id, kind,
               start_ms, end_ms, text
        FROM (SELECT s.track, s.line, s.event_id, s.kind, s.start_ms, s.text, coalesce(z.first_zone, s.end_ms) AS end_ms,
                     z.first_zone
              FROM speech s LEFT JOIN (
                  SELECT s.track, s.line, min(m.start_ms) AS first_zone
                  FROM speech s JOIN mutes m ON s.track = m.track AND s.end_ms > m.start_ms AND s.start_ms < m.end_ms
                  GROUP BY s.track, s.line) z ON s.track = z.track AND s.line = z.line)
        WHERE (first_zone IS NULL OR first_zone > start_ms) AND end_ms - start_ms >= 100""",
    "lengths": "SELECT track, max(end_ms) AS length_ms FROM speech GROUP BY track",
    "valid": """
        SELECT m.track, m.line, m.start_ms, m.end_ms FROM mutes m JOIN lengths USING (track)
        WHERE m.start_ms >= 0 AND m.end_ms <= length_ms""",
    "timed_lines": "SELECT track, line, line * 1000 AS start_ms, line * 1000 + 900 AS end_ms, text FROM lines",
    "kinds": "SELECT track, line, start_ms, end_ms, kind AS text FROM cues",
}


def islands(table: str, same: str) -> str:
    """Runs of neighbours for which ``same`` holds, as one row each."""
    return f"""
        SELECT track, run AS line, min_by(start_ms, line) AS start_ms, max_by(end_ms, line) AS end_ms,
               min_by(text, line) AS text
        FROM (SELECT *, CAST(sum(CASE WHEN ({same}) THEN 0 ELSE 1 END)
                             OVER (PARTITION BY track ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
              FROM (SELECT *, lag(text) OVER w AS ptext, lag(end_ms) OVER w AS pend FROM {table}
                    WINDOW w AS (PARTITION BY track ORDER BY line)))
        GROUP BY track, run"""


def clamped(table: str) -> str:
    return f"""
        SELECT track, line, start_ms,
               least(CASE WHEN end_ms - start_ms < 1000 THEN start_ms + 1000
                          WHEN end_ms - start_ms > 7000 THEN start_ms + 7000 ELSE end_ms END,
                     coalesce(lead(start_ms) OVER (PARTITION BY track ORDER BY start_ms, line), 9223372036854775807)) AS end_ms,
               text
        FROM {table}"""


PARTS["runs"] = islands("kinds", "text = ptext")

DAY_BATCHES = """
    WITH RECURSIVE {parts}, numbered AS (
        SELECT track, line, start_ms FROM cues),
    walk(track, line, at_ms, batch, batch_start_ms) AS (
        SELECT track, line, start_ms, CAST(0 AS BIGINT), start_ms FROM numbered WHERE line = 1
        UNION ALL
        SELECT n.track, n.line, n.start_ms,
               CASE WHEN n.start_ms - w.batch_start_ms >= 86400000 THEN w.batch + 1 ELSE w.batch END,
               CASE WHEN n.start_ms - w.batch_start_ms >= 86400000 THEN n.start_ms ELSE w.batch_start_ms END
        FROM walk w JOIN numbered n ON n.track = w.track AND n.line = w.line + 1)
"""

# name: (last part needed, select)
QUERIES = {
    "clip_drop_cues": ("clear", "SELECT track, line, event_id, start_ms, end_ms, text FROM clear"),
    "merge_sources": ("mutes", """
        SELECT track, row_number() OVER (PARTITION BY track ORDER BY start_ms, source, line) AS line, event_id,
               start_ms, end_ms, text
        FROM (SELECT *, 0 AS source FROM speech UNION ALL SELECT *, 1 AS source FROM mutes)"""),
    "adjacent_overlaps": ("cues", """
        SELECT track, no - 1 AS first_idx, no AS second_idx, start_ms, end_ms, next_start_ms, next_end_ms
        FROM (SELECT *, row_number() OVER w AS no, lead(start_ms) OVER w AS next_start_ms, lead(end_ms) OVER w AS next_end_ms
              FROM cues WINDOW w AS (PARTITION BY track ORDER BY start_ms, line))
        WHERE end_ms > next_start_ms"""),
    "valid_segments": ("valid", "SELECT * FROM valid"),
    "segment_totals": ("valid", """
        SELECT track, count(*) AS segments, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM valid GROUP BY track"""),
    "mute_series": ("valid", """
        SELECT s.track, s.event_id, s.at_ms,
               CASE WHEN EXISTS (SELECT 1 FROM valid m WHERE m.track = s.track AND m.start_ms <= s.at_ms AND s.at_ms < m.end_ms)
                    THEN 0.0::DOUBLE ELSE s.value END AS value
        FROM series s"""),
    "extract_series": ("series", """
        SELECT s.track, s.event_id, s.at_ms, round(s.value * count(c.line), 6) AS value
        FROM series s LEFT JOIN (
            SELECT c.* FROM speech c JOIN (SELECT track, max(at_ms) AS length_ms FROM series GROUP BY track) USING (track)
            WHERE c.start_ms >= 0 AND c.end_ms <= length_ms) c
        ON c.track = s.track AND c.start_ms <= s.at_ms AND s.at_ms < c.end_ms
        GROUP BY s.track, s.event_id, s.at_ms, s.value"""),
    "enabled_points": ("series", """
        SELECT s.track, s.event_id, s.at_ms,
               EXISTS (SELECT 1 FROM cues m WHERE m.track = s.track AND s.at_ms BETWEEN m.start_ms AND m.end_ms) AS enabled
        FROM (SELECT track, event_id, at_ms - event_id % 1000 * 1000 AS at_ms FROM series) s"""),
    "snap_to_anchor": ("series", """
        SELECT s.track, s.event_id, s.at_ms,
               coalesce(arg_min(m.end_ms, struct_pack(d := abs(m.end_ms - s.at_ms), k := m.end_ms)), s.at_ms) AS snapped_ms
        FROM series s LEFT JOIN mutes m ON m.track = s.track
        GROUP BY s.track, s.event_id, s.at_ms"""),
    "interval_complement": ("totals", """
        SELECT track, start_ms, end_ms FROM (
            SELECT track, coalesce(lag(end_ms) OVER (PARTITION BY track ORDER BY rank, start_ms, end_ms), 0) AS start_ms,
                   start_ms AS end_ms
            FROM (SELECT track, start_ms, end_ms, 0 AS rank FROM mutes
                  UNION ALL SELECT track, total_ms, total_ms, 1 FROM totals))
        WHERE start_ms < end_ms"""),
    "merge_close": ("kinds", islands("kinds", "text = ptext AND start_ms - pend <= 500")),
    "collapse_repeats": ("timed_lines", islands("timed_lines", "text = ptext")),
    "clamp_durations": ("kinds", clamped("kinds")),
    "deduplicated_cues": ("runs", clamped("runs")),
    "renumbered_cues": ("cues", """
        SELECT track, row_number() OVER (PARTITION BY track ORDER BY start_ms, line) AS line, event_id, start_ms
        FROM cues WHERE end_ms - start_ms >= 1000000"""),
    "fixed_batches": ("cues", """
        SELECT track, line, event_id, (line - 1) // 30 AS batch, (line - 1) % 30 AS pos FROM cues"""),
    "carried_context": (None, r"""
        SELECT track, turn, role, coalesce(array_to_string(list_filter(list_transform(
                   string_split(regexp_replace(said, '\[.*?-->.*?\]\s*', '', 'g'), chr(10)), lambda x: trim(x)),
                   lambda x: x <> ''), chr(10)), '') AS context
        FROM (SELECT conv_id AS track, turn, role,
                     last_value(CASE WHEN role = 'assistant' THEN '[00:01.00 --> 00:02.50] ' ||
                         replace(text, chr(10), chr(10) || chr(10) || '[00:03.00 --> 00:04.00]  ') END IGNORE NULLS)
                     OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said
              FROM conversations)"""),
    "track_statistics": ("cues", """
        SELECT t.track, coalesce(entries, 0) AS entries, coalesce(total_ms, 0) AS total_ms,
               coalesce(total_chars, 0) AS total_chars, coalesce(avg_ms, 0) AS avg_ms, coalesce(avg_chars, 0) AS avg_chars,
               min_ms, max_ms
        FROM (SELECT DISTINCT track FROM cues) t LEFT JOIN (
            SELECT track, count(*) AS entries, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms,
                   CAST(sum(length(text)) AS BIGINT) AS total_chars, round(avg(end_ms - start_ms), 4) AS avg_ms,
                   round(avg(length(text)), 4) AS avg_chars, min(end_ms - start_ms) AS min_ms, max(end_ms - start_ms) AS max_ms
            FROM cues GROUP BY track) f USING (track)"""),
    "quiet_edges": ("series", """
        SELECT track, keep_from_ms, keep_to_ms, length_ms - (keep_to_ms - keep_from_ms) AS removed_ms
        FROM (SELECT track, length_ms,
                     CASE WHEN first_loud >= 100 THEN greatest(0, first_loud - 30) ELSE 0 END AS keep_from_ms,
                     CASE WHEN first_loud IS NULL THEN length_ms
                          WHEN length_ms - over_ms >= 100 THEN least(length_ms, over_ms + 30) ELSE length_ms END AS keep_to_ms
              FROM (SELECT track, total_ms AS length_ms, min(at_ms) FILTER (value >= 60) AS first_loud,
                           least(total_ms, arg_max(next_ms, at_ms * 1000000000 + event_id) FILTER (value >= 60)) AS over_ms
                    FROM (SELECT *, coalesce(lead(at_ms) OVER (PARTITION BY track ORDER BY at_ms, event_id),
                                             9223372036854775807) AS next_ms FROM series)
                    JOIN totals USING (track) GROUP BY track, total_ms))"""),
}

RECURSIVE = {
    "time_batches": ("cues", DAY_BATCHES, "SELECT * FROM walk"),
    "long_time_batches": ("cues", DAY_BATCHES.replace("86400000", "3600000"), "SELECT * FROM walk"),
    "time_batch_spans": ("cues", DAY_BATCHES, """
        SELECT track, batch, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY track ORDER BY batch), last_ms) AS end_ms, rows
        FROM (SELECT track, batch, min(batch_start_ms) AS start_ms, max(at_ms) AS last_ms, count(*) AS rows
              FROM walk GROUP BY track, batch)"""),
}
