"""SQL of the streamed queries: what the batch twins give."""

from checks.interval_sql import islands

PARTS = {
    "abs_cues": """
        SELECT track, row_number() OVER (PARTITION BY track ORDER BY start_ms, event_id) AS line, start_ms,
               start_ms + greatest(1, CAST(trunc(value * 600000) AS BIGINT)) AS end_ms, text
        FROM (SELECT user_id AS track, event_id, value, event_type AS text, epoch_us(ts) // 1000 AS start_ms FROM events)""",
    "numbered_vecs": """
        SELECT f.*, e.vec_id FROM flagged_ f
        JOIN (SELECT label::BIGINT AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no, vec_id FROM embeddings) e
        USING (track, frame_no)""",
}

PARTS["every_region"] = """
        SELECT track, box, frame_no, vec_id, flatten(list_transform(range(y1, y2), lambda r: embedding[r * 8 + x1 + 1:r * 8 + x2])) AS region
        FROM (SELECT f.*, e.vec_id FROM frames_ f
              JOIN (SELECT label::BIGINT AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no, vec_id FROM embeddings) e
              USING (track, frame_no)) JOIN boxes_ USING (track)"""
PARTS["every_diff"] = """
        SELECT track, box, frame_no, vec_id, prev IS NULL OR list_sum(list_transform(range(1, len(region) + 1),
                   lambda i: CASE WHEN (region[i] > 0) <> (prev[i] > 0) THEN 1 ELSE 0 END)) > 2 AS changed,
               len(list_filter(region, lambda x: abs(x) > 0.25::DOUBLE)) / len(region) >= 0.03 AS passed
        FROM (SELECT *, lag(region) OVER (PARTITION BY track, box ORDER BY frame_no) AS prev FROM every_region)"""

QUERIES = {
    "streamed_merges": ("abs_cues", islands("abs_cues", "text = ptext AND start_ms - pend <= 500")),
    "streamed_changes": ("numbered_vecs", """
        SELECT track, cue AS line, min(frame_no) AS frame_no, round(min(vec_id) / 10.0::DOUBLE, 6) AS start_s,
               round(CASE WHEN count(*) > 1 THEN max(vec_id) / 10.0::DOUBLE ELSE min(vec_id) / 10.0::DOUBLE + 3.0::DOUBLE END, 6) AS end_s
        FROM (SELECT *, CAST(sum(CASE WHEN changed AND passed THEN 1 ELSE 0 END)
                             OVER (PARTITION BY track ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cue FROM numbered_vecs)
        WHERE cue > 0 GROUP BY track, cue"""),
}

RECURSIVE = {
    "streamed_box_changes": ("every_diff", """
        WITH RECURSIVE {parts},
        walk(track, box, frame_no, vec_id, changed, passed, last) AS (
            SELECT track, box, frame_no, vec_id, changed, passed, frame_no FROM every_diff WHERE frame_no = 0
            UNION ALL
            SELECT f.track, f.box, f.frame_no, f.vec_id, f.changed AND f.frame_no - w.last >= 5, f.passed,
                   CASE WHEN f.changed AND f.frame_no - w.last >= 5 THEN f.frame_no ELSE w.last END
            FROM walk w JOIN every_diff f ON f.track = w.track AND f.box = w.box AND f.frame_no = w.frame_no + 1)
        """, """
        SELECT track, box, cue AS line, min(frame_no) AS frame_no, round(min(vec_id) / 10.0::DOUBLE, 6) AS start_s,
               round(CASE WHEN count(*) > 1 THEN max(vec_id) / 10.0::DOUBLE ELSE min(vec_id) / 10.0::DOUBLE + 3.0::DOUBLE END, 6) AS end_s
        FROM (SELECT *, CAST(sum(CASE WHEN changed AND passed THEN 1 ELSE 0 END)
                             OVER (PARTITION BY track, box ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cue FROM walk)
        WHERE cue > 0 GROUP BY track, box, cue"""),
    "streamed_batches": ("abs_cues", """
        WITH RECURSIVE {parts},
        walk(track, line, at_ms, batch, start_ms, text) AS (
            SELECT track, line, start_ms, CAST(0 AS BIGINT), start_ms, text FROM abs_cues WHERE line = 1
            UNION ALL
            SELECT n.track, n.line, n.start_ms, CASE WHEN n.start_ms - w.start_ms >= 86400000 THEN w.batch + 1 ELSE w.batch END,
                   CASE WHEN n.start_ms - w.start_ms >= 86400000 THEN n.start_ms ELSE w.start_ms END, n.text
            FROM walk w JOIN abs_cues n ON n.track = w.track AND n.line = w.line + 1)
        """, """
        SELECT track, batch, start_ms, coalesce(lead(start_ms) OVER b, last_ms) AS end_ms, rows, coalesce(lag(said) OVER b, '') AS context
        FROM (SELECT track, batch, min(start_ms) AS start_ms, max(at_ms) AS last_ms, count(*) AS rows, arg_max(text, line) AS said
              FROM walk GROUP BY track, batch)
        WINDOW b AS (PARTITION BY track ORDER BY batch)"""),
}
