"""SQL of the layout queries."""

PARTS = {
    "clips": "SELECT track, line - 1 AS clip_no, k * 600000 AS clip_ms FROM cues WHERE k % 7 <> 0",
    "queue": """
        SELECT c.*, coalesce(clip_ms, 0) AS clip_ms, clip_ms IS NULL AS clip_missing
        FROM clear c LEFT JOIN clips p ON p.track = c.track AND p.clip_no = c.line - 1""",
    "events_": """
        SELECT track, 0 AS rank, start_ms, 1 AS side, line, 'tts' AS kind, end_ms, clip_ms FROM queue
        UNION ALL SELECT track, 0, start_ms, 0, line, 'mute', end_ms, 0 FROM mutes
        UNION ALL SELECT track, 1, total_ms, 2, 0, 'end', total_ms, 0 FROM totals""",
    "swept": """
        SELECT *, coalesce(max(CASE WHEN kind = 'mute' THEN end_ms END)
                           OVER (PARTITION BY track ORDER BY rank, start_ms, side, line
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS muted_to,
               lag(kind) OVER w AS before, lead(start_ms) OVER w AS next_ms, lead(kind) OVER w AS next_kind
        FROM events_ WINDOW w AS (PARTITION BY track ORDER BY rank, start_ms, side, line)""",
    "begun": "SELECT *, greatest(start_ms, muted_to) AS begin_ms FROM swept",
    "slots": """
        SELECT track, 'gap' AS kind, muted_to AS start_ms, begin_ms AS end_ms, begin_ms - muted_to AS slot_ms,
               CAST(NULL AS BIGINT) AS hard_limit_ms, CAST(0 AS BIGINT) AS clip_ms
        FROM begun WHERE coalesce(before, '') <> 'tts' AND muted_to < begin_ms
        UNION ALL
        SELECT track, kind, begin_ms, begin_ms + slot, slot, hard, clip_ms FROM (
            SELECT *, CASE WHEN kind = 'tts' AND next_ms - begin_ms > 0 THEN next_ms - begin_ms
                           ELSE greatest(begin_ms, end_ms) - begin_ms END AS slot,
                   CASE WHEN kind = 'tts' AND next_kind = 'mute' THEN next_ms - begin_ms END AS hard
            FROM begun WHERE kind <> 'end')""",
    "paced": """
        SELECT *, CASE WHEN kind <> 'tts' OR clip <= room THEN 1.0::DOUBLE WHEN clip <= room / 0.5::DOUBLE THEN room / clip
                       ELSE 0.5::DOUBLE END AS video_speed,
               CASE WHEN kind <> 'tts' OR clip <= room / 0.5::DOUBLE THEN 1.0::DOUBLE ELSE clip / (room / 0.5::DOUBLE) END AS audio_speed,
               CASE WHEN kind <> 'tts' OR clip <= room THEN CAST(slot_ms AS DOUBLE) WHEN clip <= room / 0.5::DOUBLE THEN clip
                    ELSE room / 0.5::DOUBLE END AS new_ms,
               CASE WHEN kind <> 'tts' OR clip <= room THEN 1.0::DOUBLE ELSE room / clip END AS free_speed,
               CASE WHEN kind <> 'tts' OR clip <= room THEN CAST(slot_ms AS DOUBLE) ELSE clip END AS free_ms
        FROM (SELECT *, CAST(coalesce(hard_limit_ms, slot_ms) AS DOUBLE) AS room, CAST(clip_ms AS DOUBLE) AS clip FROM slots)""",
    "framed": """
        SELECT *, round_even(round_even((CAST(slot_ms AS DOUBLE) / 1000.0::DOUBLE) * 30.0::DOUBLE, 0) * (1.0::DOUBLE / video_speed), 0) AS frames
        FROM paced""",
    "timeline": """
        SELECT track, CAST(start_ms AS DOUBLE) AS orig_start, CAST(start_ms + slot_ms AS DOUBLE) AS orig_end,
               row_number() OVER w AS seg_no,
               (sum(frames) OVER w - frames) / 30.0::DOUBLE * 1000.0::DOUBLE AS new_start,
               (sum(frames) OVER w) / 30.0::DOUBLE * 1000.0::DOUBLE AS new_end,
               video_speed, audio_speed, frames / 30.0::DOUBLE * 1000.0::DOUBLE AS new_chunk_dur, kind, clip_ms, frames
        FROM framed
        WINDOW w AS (PARTITION BY track ORDER BY start_ms, start_ms + slot_ms, kind, clip_ms ROWS UNBOUNDED PRECEDING)""",
    "realised": """
        SELECT *, ceil(round_even(round_even(((orig_end - orig_start) / 1000.0::DOUBLE) * 30.0::DOUBLE, 0) / 30.0::DOUBLE
                                  / video_speed * 30.0::DOUBLE, 4)) AS actual_frames
        FROM timeline""",
    "ends_": """
        SELECT track, arg_max(orig_end, seg_no) AS last_orig, arg_max(new_end, seg_no) AS last_new,
               arg_min(orig_start, seg_no) AS first_orig, arg_min(new_start, seg_no) AS first_new
        FROM timeline GROUP BY track""",
    "stops": """
        SELECT DISTINCT track, start_ms AS at_ms FROM cues UNION SELECT track, end_ms FROM cues
        UNION SELECT track, end_ms FROM clear""",
    "hits": """
        SELECT p.track, p.at_ms, arg_min(struct_pack(os := t.orig_start, oe := t.orig_end, ns := t.new_start, nd := t.new_chunk_dur),
                                         t.seg_no) AS s
        FROM stops p JOIN timeline t ON t.track = p.track AND p.at_ms BETWEEN t.orig_start AND t.orig_end
        GROUP BY p.track, p.at_ms""",
    "moved": """
        SELECT p.track, p.at_ms, CASE
                   WHEN s IS NOT NULL AND s.oe - s.os <= 0 THEN s.ns
                   ELSE round_even((CASE
                       WHEN s IS NOT NULL THEN s.ns + ((p.at_ms - s.os) / (s.oe - s.os)) * s.nd
                       WHEN p.at_ms > last_orig THEN last_new + (p.at_ms - last_orig)
                       ELSE first_new - (first_orig - p.at_ms) END / 1000.0::DOUBLE) * 30.0::DOUBLE, 0)
                       / 30.0::DOUBLE * 1000.0::DOUBLE END AS new_ms
        FROM stops p JOIN ends_ e ON e.track = p.track LEFT JOIN hits h ON h.track = p.track AND h.at_ms = p.at_ms""",
    "near_clip": """
        SELECT c.track, c.line, arg_min(struct_pack(clip := t.clip_ms, ne := t.new_end), t.seg_no) AS s
        FROM clear c JOIN timeline t ON t.track = c.track AND t.kind = 'tts' AND abs(t.orig_start - c.start_ms) < 100
        GROUP BY c.track, c.line""",
    "clip_timed": """
        SELECT c.track, c.line, c.text, a.new_ms AS s_ms,
               CASE WHEN n.s.clip > 0 THEN least(a.new_ms + n.s.clip, n.s.ne) ELSE b.new_ms END AS e_ms
        FROM clear c JOIN moved a ON a.track = c.track AND a.at_ms = c.start_ms
        JOIN moved b ON b.track = c.track AND b.at_ms = c.end_ms
        LEFT JOIN near_clip n ON n.track = c.track AND n.line = c.line""",
    "slotted": """
        SELECT c.track, c.line, c.start_ms, n AS end_ms, n - c.start_ms AS slot_ms, coalesce(p.clip_ms, n - c.start_ms) AS clip_ms
        FROM (SELECT c.*, coalesce(lead(start_ms) OVER (PARTITION BY track ORDER BY start_ms, line), total_ms) AS n
              FROM cues c JOIN totals USING (track)) c
        LEFT JOIN clips p ON p.track = c.track AND p.clip_no = c.line - 1""",
}

SPEED_COLUMNS = "track, kind, start_ms, end_ms, slot_ms, hard_limit_ms, clip_ms"
SEGMENT = "track, round({0}orig_start, 6) AS orig_start, round({0}orig_end, 6) AS orig_end, "

QUERIES = {
    "clip_lookup": ("queue", "SELECT track, line, event_id, clip_ms, clip_missing FROM queue"),
    "classify_slots": ("slots", "SELECT * FROM slots"),
    "slot_speeds": ("paced", f"""
        SELECT {SPEED_COLUMNS}, round(video_speed, 6) AS video_speed, round(audio_speed, 6) AS audio_speed,
               round(new_ms, 6) AS new_ms, video_speed <= 0 AS needs_review FROM paced"""),
    "slot_speeds_uncapped": ("paced", f"""
        SELECT {SPEED_COLUMNS}, round(free_speed, 6) AS video_speed, 1.0::DOUBLE AS audio_speed,
               round(free_ms, 6) AS new_ms, free_speed <= 0 AS needs_review FROM paced"""),
    "build_timeline": ("timeline", """
        SELECT track, round(orig_start, 6) AS orig_start, round(orig_end, 6) AS orig_end, round(new_start, 6) AS new_start,
               round(new_end, 6) AS new_end, round(video_speed, 6) AS video_speed, round(audio_speed, 6) AS audio_speed,
               round(new_chunk_dur, 6) AS new_chunk_dur, kind, clip_ms FROM timeline"""),
    "timeline_with_head_and_tail": ("framed", """
        SELECT track, CAST(seg_no AS BIGINT) AS seg_no, round(orig_start, 6) AS orig_start, round(orig_end, 6) AS orig_end,
               round((run - frames) / 30.0::DOUBLE * 1000.0::DOUBLE, 6) AS new_start,
               round(run / 30.0::DOUBLE * 1000.0::DOUBLE, 6) AS new_end, round(video_speed, 6) AS video_speed,
               round(audio_speed, 6) AS audio_speed, round(frames / 30.0::DOUBLE * 1000.0::DOUBLE, 6) AS new_chunk_dur, kind, clip_ms
        FROM (SELECT *, sum(frames) OVER (PARTITION BY track ORDER BY seg_no ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT track, row_number() OVER (PARTITION BY track ORDER BY start_ms) AS seg_no, CAST(start_ms AS DOUBLE) AS orig_start,
                   CAST(start_ms + slot_ms AS DOUBLE) AS orig_end, video_speed, audio_speed, frames, kind, clip_ms
            FROM framed WHERE kind = 'tts'
            UNION ALL
            SELECT track, 0, 0.0, CAST(min(start_ms) AS DOUBLE), 1.0, 1.0,
                   round_even((CAST(min(start_ms) AS DOUBLE) / 1000.0::DOUBLE) * 30.0::DOUBLE, 0), 'gap', 0
            FROM framed WHERE kind = 'tts' GROUP BY track HAVING min(start_ms) > 0
            UNION ALL
            SELECT track, n + 1, CAST(last_ms AS DOUBLE), CAST(total_ms AS DOUBLE), 1.0, 1.0,
                   round_even((CAST(total_ms - last_ms AS DOUBLE) / 1000.0::DOUBLE) * 30.0::DOUBLE, 0), 'tail', 0
            FROM totals LEFT JOIN (SELECT track, arg_max(start_ms + slot_ms, start_ms) AS last_ms, count(*) AS n
                                   FROM framed WHERE kind = 'tts' GROUP BY track) USING (track)
            WHERE last_ms < total_ms))"""),
    "rebase_timeline": ("realised", """
        SELECT track, round(orig_start, 6) AS orig_start, round(orig_end, 6) AS orig_end,
               round((sum(actual_frames) OVER w - actual_frames) / 30.0::DOUBLE * 1000.0::DOUBLE, 6) AS new_start,
               round((sum(actual_frames) OVER w) / 30.0::DOUBLE * 1000.0::DOUBLE, 6) AS new_end,
               round(video_speed, 6) AS video_speed, round(audio_speed, 6) AS audio_speed,
               round(actual_frames / 30.0::DOUBLE * 1000.0::DOUBLE, 6) AS new_chunk_dur, kind, clip_ms
        FROM realised WINDOW w AS (PARTITION BY track ORDER BY seg_no ROWS UNBOUNDED PRECEDING)"""),
    "rebase_on_measured": ("realised", """
        SELECT track, CAST(seg_no AS BIGINT) AS seg_no, round(orig_start, 6) AS orig_start, round(orig_end, 6) AS orig_end,
               round((sum(a) OVER w - a) / 30.0::DOUBLE * 1000.0::DOUBLE, 6) AS new_start,
               round((sum(a) OVER w) / 30.0::DOUBLE * 1000.0::DOUBLE, 6) AS new_end,
               round(video_speed, 6) AS video_speed, round(audio_speed, 6) AS audio_speed,
               round(a / 30.0::DOUBLE * 1000.0::DOUBLE, 6) AS new_chunk_dur, kind, clip_ms
        FROM (SELECT *, actual_frames + seg_no % 2 AS a FROM realised
              QUALIFY 10 * seg_no <= 9 * count(*) OVER (PARTITION BY track))
        WINDOW w AS (PARTITION BY track ORDER BY seg_no ROWS UNBOUNDED PRECEDING)"""),
    "realised_frames": ("realised", """
        SELECT track, round(orig_start, 6) AS orig_start, round(orig_end, 6) AS orig_end, kind, actual_frames FROM realised"""),
    "timeline_complement": ("timeline", """
        SELECT track, round(start_ms, 6) AS start_ms, round(end_ms, 6) AS end_ms FROM (
            SELECT track, coalesce(lag(end_ms) OVER (PARTITION BY track ORDER BY rank, start_ms, end_ms), 0) AS start_ms,
                   start_ms AS end_ms
            FROM (SELECT track, new_start AS start_ms, new_end AS end_ms, 0 AS rank FROM timeline WHERE kind = 'mute'
                  UNION ALL SELECT track, max(new_end), max(new_end), 1 FROM timeline GROUP BY track))
        WHERE start_ms < end_ms"""),
    "remap_points": ("moved", """
        SELECT s.track, s.event_id, s.at_ms, round(new_ms, 6) AS new_ms
        FROM series s JOIN moved m ON m.track = s.track AND m.at_ms = s.at_ms"""),
    "retime_cues": ("moved", """
        SELECT c.track, c.line, CAST(round_even(a.new_ms, 0) AS BIGINT) AS start_ms,
               CAST(round_even(CASE WHEN b.new_ms <= a.new_ms THEN a.new_ms + 100 ELSE b.new_ms END, 0) AS BIGINT) AS end_ms, c.text
        FROM speech c JOIN moved a ON a.track = c.track AND a.at_ms = c.start_ms
        JOIN moved b ON b.track = c.track AND b.at_ms = c.end_ms"""),
    "retime_by_clip": ("clip_timed", """
        SELECT track, line, CAST(round_even(s_ms, 0) AS BIGINT) AS start_ms,
               CAST(round_even(CASE WHEN e_ms <= s_ms THEN s_ms + 100 ELSE e_ms END, 0) AS BIGINT) AS end_ms, text
        FROM clip_timed"""),
    "drift_audit": ("realised", """
        SELECT *, CASE WHEN drift_frames <= 3 AND not_rising = 0 AND seams = 0 AND uneven_steps = 0 AND worst_batch_frames <= 3
                       THEN 'PASS' ELSE 'FAIL' END AS verdict
        FROM (SELECT *, abs(actual_frames - expected_frames) AS drift_frames,
                     round(abs(actual_frames - expected_frames) / 30.0::DOUBLE * 1000.0::DOUBLE, 6) AS drift_ms
              FROM (SELECT track, CAST(sum(n) AS BIGINT) AS segments, CAST(sum(should) AS BIGINT) AS expected_frames,
                           CAST(sum(has) AS BIGINT) AS actual_frames, CAST(sum(flat) AS BIGINT) AS not_rising,
                           CAST(sum(seam) AS BIGINT) AS seams,
                           CAST(sum(uneven) AS BIGINT) AS uneven_steps, round(max(worst), 6) AS worst_step_ms, CAST(max(abs(has - should)) AS BIGINT) AS worst_batch_frames
                    FROM (SELECT track, (seg_no - 1) // 100 AS batch, count(*) AS n, sum(actual_frames) AS should, sum(frames) AS has,
                                 count(*) FILTER (new_start <= ps AND new_chunk_dur > 0) AS flat,
                                 count(*) FILTER (abs(new_start - pe) > 1000.0 / 30.0 * 0.5) AS seam,
                                 count(*) FILTER (abs(new_start - ps - pf * (1000.0::DOUBLE / 30.0::DOUBLE)) > 1000.0::DOUBLE / 30.0::DOUBLE * 0.5::DOUBLE) AS uneven,
                                 coalesce(max(abs(new_start - ps - pf * (1000.0::DOUBLE / 30.0::DOUBLE))), 0.0::DOUBLE) AS worst
                          FROM (SELECT *, lag(new_start) OVER w AS ps, lag(new_end) OVER w AS pe, lag(actual_frames) OVER w AS pf FROM realised
                                WINDOW w AS (PARTITION BY track ORDER BY seg_no))
                          GROUP BY track, batch)
                    GROUP BY track))"""),
    "adjacent_slots": ("slotted", "SELECT * FROM slotted"),
    "compression_targets": ("slotted", """
        SELECT *, CASE WHEN slot_ms > 0 AND clip_ms / slot_ms <= 1.5 THEN slot_ms
                       ELSE CAST(trunc(clip_ms / 1.5::DOUBLE) AS BIGINT) END AS target_ms
        FROM slotted WHERE clip_ms > slot_ms"""),
    "aligned_layout": ("slotted", """
        SELECT track, line, CAST(run - room AS BIGINT) AS start_ms, CAST(run AS BIGINT) AS end_ms, clip AS laid_ms,
               greatest(0, room - clip) AS padded_ms, greatest(0, clip - room) AS cut_ms
        FROM (SELECT *, sum(room) OVER (PARTITION BY track ORDER BY line ROWS UNBOUNDED PRECEDING) AS run
              FROM (SELECT *, CASE WHEN slot_ms <= 0 THEN greatest(1, clip_ms) ELSE slot_ms END AS room,
                           CASE WHEN clip_ms <= slot_ms THEN clip_ms
                                WHEN slot_ms > 0 AND clip_ms / slot_ms <= 1.5 THEN slot_ms
                                ELSE CAST(trunc(clip_ms / 1.5::DOUBLE) AS BIGINT) END AS clip FROM slotted))"""),
    "paused_schedule": ("clips", """
        SELECT track, clip_no, CAST(run - clip_ms - 250 AS BIGINT) AS start_ms, CAST(run - 250 AS BIGINT) AS end_ms
        FROM (SELECT *, sum(clip_ms + 250) OVER (PARTITION BY track ORDER BY clip_no ROWS UNBOUNDED PRECEDING) AS run FROM clips)"""),
}

RECURSIVE = {
    "serial_layout": ("slotted", """
        WITH RECURSIVE {parts}, items AS (
            SELECT c.track, c.line, c.start_ms, greatest(coalesce(p.clip_ms, c.end_ms - c.start_ms), c.end_ms - c.start_ms) AS len
            FROM cues c LEFT JOIN clips p ON p.track = c.track AND p.clip_no = c.line - 1),
        walk(track, line, start_ms, end_ms) AS (
            SELECT track, line, start_ms, start_ms + len FROM items WHERE line = 1
            UNION ALL
            SELECT i.track, i.line, greatest(w.end_ms, i.start_ms), greatest(w.end_ms, i.start_ms) + i.len
            FROM walk w JOIN items i ON i.track = w.track AND i.line = w.line + 1)
        """, """
        SELECT w.track, w.line, w.start_ms, w.end_ms,
               CASE WHEN w.line = max(w.line) OVER (PARTITION BY w.track) THEN greatest(0, t.total_ms - w.end_ms) ELSE 0 END AS tail_ms
        FROM walk w JOIN totals t USING (track)"""),
}
