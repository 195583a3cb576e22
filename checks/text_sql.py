"""SQL of the text, stamp and frame queries."""

CLOCK = ("printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} % 3600000) // 60000, ({0} % 60000) // 1000, {0} % 1000)")
CENTI = ("printf('%d:%02d:%02d.%02d', {0} // 3600000, ({0} % 3600000) // 60000, ({0} % 60000) // 1000, ({0} % 1000) // 10)")
STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
ACCENTED, MARKS = "[À-ÿ]", "[.,;:!?]"
KEPT = (f"CASE WHEN trim({{0}}, ' ' || chr(10)) = '' THEN '' WHEN regexp_matches({{0}}, '{ACCENTED}') THEN "
        f"array_to_string(regexp_extract_all({{0}}, '{ACCENTED}'), '') || array_to_string(regexp_extract_all({{0}}, '{MARKS}'), '') ELSE '' END")
BLANK = "trim({0}, ' ' || chr(10)) = ''"

PARTS = {
    "frames_": """
        SELECT label::BIGINT AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no, embedding
        FROM embeddings""",
    "changed_": """
        SELECT *, prev IS NULL OR distance > 30 AS changed FROM (
            SELECT *, CASE WHEN prev IS NOT NULL THEN CAST(list_sum(list_transform(range(1, 65),
                          lambda i: CASE WHEN (embedding[i] > 0) <> (prev[i] > 0) THEN 1 ELSE 0 END)) AS BIGINT) END AS distance
            FROM (SELECT *, lag(embedding) OVER (PARTITION BY track ORDER BY frame_no) AS prev FROM frames_))""",
    "flagged_": """
        SELECT track, frame_no, frame_no / 10.0::DOUBLE AS ts_s, changed,
               len(list_filter(embedding, lambda x: abs(x) > 0.25::DOUBLE)) / len(embedding) >= 0.03 AS passed
        FROM changed_""",
    "boxes_": """
        SELECT * FROM (
            SELECT n_nationkey % 10 AS track, n_name AS box, greatest(0, least(x, 8)) AS x1, greatest(0, least(y, 8)) AS y1,
                   greatest(0, least(x + w, 8)) AS x2, greatest(0, least(y + h, 8)) AS y2
            FROM (SELECT *, n_regionkey * 2 - 1 AS x, n_nationkey % 6 - 1 AS y, n_nationkey % 5 AS w, n_nationkey % 4 + 1 AS h FROM nation))
        WHERE x1 < x2 AND y1 < y2""",
    "regions_": """
        SELECT track, box, frame_no, frame_no // 2 AS step, flatten(list_transform(range(y1, y2), lambda r: embedding[r * 8 + x1 + 1:r * 8 + x2])) AS region
        FROM frames_ JOIN boxes_ USING (track) WHERE frame_no % 2 = 0""",
    "box_diffs_": """
        SELECT track, box, frame_no, step, distance, prev IS NULL OR distance > 2 AS changed,
               len(list_filter(region, lambda x: abs(x) > 0.25::DOUBLE)) / len(region) >= 0.03 AS passed
        FROM (SELECT *, CASE WHEN prev IS NOT NULL THEN CAST(list_sum(list_transform(range(1, len(region) + 1),
                            lambda i: CASE WHEN (region[i] > 0) <> (prev[i] > 0) THEN 1 ELSE 0 END)) AS BIGINT) END AS distance
              FROM (SELECT *, lag(region) OVER (PARTITION BY track, box ORDER BY frame_no) AS prev FROM regions_))""",
    "replies_": """
        SELECT track, line, CASE track % 7 WHEN 1 THEN substring(text, 1, 1) WHEN 2 THEN ' None' || chr(10)
                   WHEN 3 THEN text || ' https://x.example/y' WHEN 4 THEN CAST(line AS VARCHAR)
                   WHEN 5 THEN repeat(substring(text, 1, 1), line) WHEN 6 THEN line || chr(10) || track ELSE text END AS text
        FROM lines""",
    "line_chars": """
        SELECT track, line, text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i
        FROM lines WHERE text <> ''""",
}

REASON = r"""CASE WHEN {s} = '' THEN 'empty' WHEN lower({s}) IN ({words}) THEN 'empty word'
    WHEN contains(lower({t}), '图片中没有') OR contains(lower({t}), '没有可见的文字') OR contains(lower({t}), '没有可识别的文字')
      OR contains(lower({t}), 'no visible text') OR contains(lower({t}), 'no text found') OR contains(lower({t}), 'no text in the image')
      OR contains(lower({t}), 'không có văn bản') OR contains(lower({t}), '文件(f)') OR contains(lower({t}), '编辑(e)')
      OR contains(lower({t}), '视图(v)') OR contains(lower({t}), '书签(o)') THEN 'empty phrase'
    WHEN regexp_matches({t}, 'https?://\S') THEN 'url'
    WHEN regexp_full_match({t}, '[\d\s]+') AND contains({t}, chr(10)) THEN 'counting'
    WHEN regexp_full_match({s}, '\d\d?') THEN 'number' {more} END"""
STRICT = r"""WHEN length({s}) >= 9 AND replace({s}, {s}[1], '') = '' THEN 'one character'
    WHEN regexp_full_match({s}, '[a-zA-Z]') THEN 'one letter'"""


def reason(text: str, strict: bool) -> str:
    s = STRIP.format(text)
    return REASON.format(s=s, t=text, words="'none', 'empty'" if strict else "'none'", more=STRICT.format(s=s) if strict else "")


RAW_STAMP = f"""CASE event_id % 5 WHEN 0 THEN c WHEN 1 THEN right(c, 9) WHEN 2 THEN c || ':x' WHEN 3 THEN replace(c, ':', '-')
    ELSE replace(c, ',', '.') END"""

QUERIES = {
    "script_extraction": (None, f"""
        SELECT doc_id, kept, length(kept) AS char_count, length(kept) > 0 AS has_script,
               CASE WHEN {BLANK.format('text')} THEN 0 ELSE length(text) - length(kept) END AS removed_chars
        FROM (SELECT doc_id, text, {KEPT.format('text')} AS kept FROM documents)"""),
    "script_count_filter": ("lines", f"""
        SELECT * FROM (SELECT track, line, {KEPT.format('text')} AS kept FROM lines) WHERE length(kept) >= 5"""),
    "script_ratio_filter": ("lines", f"""
        SELECT track, line, round(ratio, 9) AS ratio, kept FROM (
            SELECT track, line, CASE WHEN text = '' THEN 0.0 ELSE length(regexp_replace(text, '[^À-ÿ]', '', 'g')) / length(text) END AS ratio,
                   {KEPT.format('text')} AS kept FROM lines)
        WHERE ratio >= 0.05 AND length(kept) >= 2"""),
    "script_runs_with_context": ("line_chars", """
        SELECT track, line, string_agg(c, '' ORDER BY i) AS run, min(i) - 1 AS start_at, max(i) AS end_at,
               substring(any_value(text), CAST(greatest(1, min(i) - 5) AS BIGINT),
                         CAST(least(length(any_value(text)), max(i) + 5) - greatest(1, min(i) - 5) + 1 AS BIGINT)) AS context
        FROM (SELECT *, i - row_number() OVER (PARTITION BY track, line ORDER BY i) AS run_no FROM line_chars
              WHERE regexp_full_match(c, '[À-ÿ]'))
        GROUP BY track, line, run_no"""),
    "junk_filter": ("replies_", f"""
        SELECT track, line, reason, CASE WHEN reason IS NULL THEN {STRIP.format('text')} ELSE '' END AS kept
        FROM (SELECT *, {reason('text', True)} AS reason FROM replies_)"""),
    "junk_filter_lenient": ("replies_", f"""
        SELECT * FROM (SELECT track, line, {reason('text', False)} AS reason FROM replies_) WHERE reason IS NOT NULL"""),
    "reasoning_removed": (None, f"""
        SELECT conv_id, turn, {STRIP.format('text')} AS spoken, {STRIP.format('text')} AS bare FROM conversations"""),
    "tagged_payload": (None, r"""
        SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ' ' || chr(10)) AS title FROM pages"""),
    "inline_tags_removed": (None, "SELECT page_id, regexp_replace(html, '</?[a-zA-Z]+>', '', 'g') AS html FROM pages"),
    "latin_warnings": ("lines", """
        SELECT track, count(*) AS warnings FROM lines WHERE regexp_matches(text, '[a-zA-Z0-9]') GROUP BY track"""),
    "stamp_conversions": ("cues", f"""
        SELECT track, line, {CLOCK.format('start_ms')} AS clock,
               CAST(trunc((start_ms // 3600000 * 3600 + (start_ms % 3600000) // 60000 * 60
                     + CAST(printf('%02d.%03d', (start_ms % 60000) // 1000, start_ms % 1000) AS DOUBLE)) * 1000) AS BIGINT) AS back_ms,
               {CENTI.format('start_ms')} AS centi, {CENTI.format('start_ms')} AS clock_centi,
               {CLOCK.format('(start_ms // 10 * 10)')} AS centi_clock, start_ms // 10 * 10 AS centi_ms,
               printf('%02d:%02d:%02d,%03d', w // 3600, (w % 3600) // 60, w % 60, CAST(trunc((s - w) * 1000) AS BIGINT)) AS seconds_clock
        FROM (SELECT *, CAST(trunc(s) AS BIGINT) AS w FROM (SELECT *, greatest(start_ms / 1000.0::DOUBLE - 5.0::DOUBLE, 0.0::DOUBLE) AS s FROM cues))"""),
    "tolerant_stamps": ("cues", f"""
        SELECT track, line, raw,
               CASE WHEN event_id % 5 IN (0, 2, 4) THEN round(h * 3600 + m * 60 + s, 6) ELSE 0.0 END AS tolerant_s,
               CASE WHEN event_id % 5 IN (0, 4) THEN round(h * 3600 + m * 60 + s, 6) WHEN event_id % 5 = 1 THEN round(m * 60 + s, 6) END AS flexible_s
        FROM (SELECT *, {RAW_STAMP} AS raw FROM (
            SELECT *, {CLOCK.format('start_ms')} AS c, start_ms // 3600000 AS h, (start_ms % 3600000) // 60000 AS m,
                   (start_ms % 60000) / 1000.0::DOUBLE AS s FROM cues))"""),
    "scaled_times": ("cues", """
        SELECT track, line, s AS start_ms, CASE WHEN e <= s THEN s + 1 ELSE e END AS end_ms
        FROM (SELECT track, line, greatest(1, CAST(round_even(start_ms / 0.65::DOUBLE, 0) AS BIGINT)) AS s,
                     greatest(1, CAST(round_even(end_ms / 0.65::DOUBLE, 0) AS BIGINT)) AS e FROM cues)"""),
    "padded_windows": ("mutes", """
        SELECT track, line, round(p, 6) AS left_pad_s, round(s - p, 6) AS from_s, round(e + 0.5::DOUBLE, 6) AS to_s
        FROM (SELECT *, least(0.5::DOUBLE, s) AS p FROM (
            SELECT track, line, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e FROM mutes))"""),
    "hard_wrapped": (None, r"""
        SELECT doc_id, array_to_string(list_transform(string_split(replace(text, chr(10), '\N'), '\N'),
               lambda x: CASE WHEN x = '' THEN '' ELSE array_to_string(regexp_extract_all(x, '.{1,14}'), '\N') END), '\N') AS wrapped
        FROM documents"""),
    "cjk_flags": (None, r"""
        SELECT doc_id, regexp_matches(text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]') AS cjk_text,
               split_part(lower(lang), '-', 1) IN ('zh', 'ja', 'th', 'yue', 'ko') AS cjk_language FROM documents"""),
    "sampled_frames": ("frames_", """
        SELECT track, frame_no, round(frame_no / 30.0::DOUBLE, 6) AS ts_s FROM frames_ WHERE frame_no % 3 = 0"""),
    "evenly_spaced_frames": ("frames_", """
        SELECT track, i AS sample_no, CASE WHEN i = 15 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 15.0::DOUBLE)) AS BIGINT) END AS frame_no
        FROM (SELECT track, count(*) AS n FROM frames_ GROUP BY track), range(16) r(i)"""),
    "clamped_boxes": (None, """
        SELECT p_partkey, x1, y1, x2, y2, x1 < x2 AND y1 < y2 AS valid FROM (
            SELECT p_partkey, greatest(0, least(x, width)) AS x1, greatest(0, least(y, height)) AS y1,
                   greatest(0, least(x + w, width)) AS x2, greatest(0, least(y + h, height)) AS y2
            FROM (SELECT p_partkey, CAST(p_size * 41 - 300 AS BIGINT) AS x, p_partkey % 1200 - 60 AS y, p_partkey % 700 AS w,
                         CAST(p_size * 3 AS BIGINT) AS h, min(p_partkey) OVER b + 600 AS width, max(p_size) OVER b * 9 AS height
                  FROM part WINDOW b AS (PARTITION BY p_brand)))"""),
    "active_frames": (None, """
        SELECT vec_id, len(list_filter(embedding, lambda x: abs(x) > 0.25::DOUBLE)) / len(embedding) >= 0.03 AS active
        FROM embeddings"""),
    "frame_changes": ("changed_", "SELECT track, frame_no, distance, changed FROM changed_"),
    "cell_changes": ("frames_", """
        SELECT track, frame_no, prev IS NULL OR list_sum(list_transform(range(1, len(embedding) + 1),
               lambda i: CASE WHEN abs(embedding[i] - prev[i]) > 0.2::DOUBLE THEN 1 ELSE 0 END)) / len(embedding) * 100 > 20 AS changed
        FROM (SELECT *, lag(embedding) OVER (PARTITION BY track ORDER BY frame_no) AS prev FROM frames_)"""),
    "change_cues": ("flagged_", """
        SELECT track, cue AS line, min(frame_no) AS frame_no, round(min(ts_s), 6) AS start_s,
               round(CASE WHEN count(*) > 1 THEN max(ts_s) ELSE min(ts_s) + 3.0::DOUBLE END, 6) AS end_s
        FROM (SELECT *, CAST(sum(CASE WHEN changed AND passed THEN 1 ELSE 0 END)
                             OVER (PARTITION BY track ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cue FROM flagged_)
        WHERE cue > 0 GROUP BY track, cue"""),
    "run_totals": ("flagged_", """
        SELECT track, count(*) AS frames, count(*) FILTER (frame_no % 3 = 0) AS processed,
               count(*) FILTER (frame_no % 3 = 0 AND changed AND passed) AS calls
        FROM flagged_ GROUP BY track"""),
}

BOX_WALK = """
        WITH RECURSIVE {parts},
        walk(track, box, step, frame_no, distance, changed, passed, last) AS (
            SELECT track, box, step, frame_no, distance, changed, passed, frame_no FROM box_diffs_ WHERE step = 0
            UNION ALL
            SELECT f.track, f.box, f.step, f.frame_no, f.distance, f.changed AND f.frame_no - w.last >= 5, f.passed,
                   CASE WHEN f.changed AND f.frame_no - w.last >= 5 THEN f.frame_no ELSE w.last END
            FROM walk w JOIN box_diffs_ f ON f.track = w.track AND f.box = w.box AND f.step = w.step + 1)
        """

RECURSIVE = {
    "box_changes": ("box_diffs_", BOX_WALK, "SELECT track, box, frame_no, distance, changed, passed FROM walk"),
    "box_cues": ("box_diffs_", BOX_WALK, """
        SELECT track, box, cue AS line, min(frame_no) AS frame_no, round(min(frame_no) / 10.0::DOUBLE, 6) AS start_s,
               round(CASE WHEN count(*) > 1 THEN max(frame_no) / 10.0::DOUBLE ELSE min(frame_no) / 10.0::DOUBLE + 3.0::DOUBLE END, 6) AS end_s
        FROM (SELECT *, CAST(sum(CASE WHEN changed AND passed THEN 1 ELSE 0 END)
                             OVER (PARTITION BY track, box ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cue FROM walk)
        WHERE cue > 0 GROUP BY track, box, cue"""),
    "box_totals": ("box_diffs_", BOX_WALK, """
        SELECT track, box, any_value(n) AS frames, count(*) AS processed, count(*) FILTER (changed AND passed) AS calls
        FROM walk JOIN (SELECT track, count(*) AS n FROM frames_ GROUP BY track) USING (track) GROUP BY track, box"""),
    "debounced_changes": ("flagged_", """
        WITH RECURSIVE {parts},
        walk(track, frame_no, kept, last) AS (
            SELECT track, frame_no, changed, CASE WHEN changed THEN frame_no END FROM flagged_ WHERE frame_no = 0
            UNION ALL
            SELECT f.track, f.frame_no, f.changed AND (w.last IS NULL OR f.frame_no - w.last >= 5),
                   CASE WHEN f.changed AND (w.last IS NULL OR f.frame_no - w.last >= 5) THEN f.frame_no ELSE w.last END
            FROM walk w JOIN flagged_ f ON f.track = w.track AND f.frame_no = w.frame_no + 1)
        """, "SELECT track, frame_no, kept AS changed FROM walk"),
}
