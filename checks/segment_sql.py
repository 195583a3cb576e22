"""SQL of the segmentation queries that SQL can express."""


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


_MARKS = "[,.?!;，。？；！ ]"
_NEAR = "(?s).{1,30}\\z|" + "|".join(f".{{{k}}}{_MARKS}" for k in range(27, 32)) + "|.{30}"
_STRONG, _EITHER = "。！？.!?…\\n", "。！？.!?…\\n，,；;、"
_SENTENCES = f"(?s)[^{_STRONG}]{{0,24}}[{_STRONG}]|[^{_STRONG}]{{24}}[^{_EITHER}]*[{_EITHER}]|.+"

PARTS = {
    "near_": f"""
        SELECT track, line, text, s, CASE WHEN length(s) <= 30 THEN s
               WHEN len(p) > 1 AND length(p[-1]) < 3 THEN {strip("array_to_string(list_append(p[1:len(p) - 2], p[-2] || p[-1]), chr(10))")}
               ELSE {strip("array_to_string(p, chr(10))")} END AS broken
        FROM (SELECT *, flatten(list_transform(string_split(replace(s, '\\n', chr(10)), chr(10)),
                     lambda x: regexp_extract_all({strip("x")}, '{_NEAR}'))) AS p
              FROM (SELECT track, line, text, {strip("text")} AS s FROM lines))""",
    "pieces_": rf"""
        SELECT track, line, text, regexp_extract_all(regexp_replace(regexp_replace({strip("text")}, '\s+', ' ', 'g'),
                   '(\pL\pL-)(\pL-?\pL)', '\1' || chr(1) || '\2', 'g'), ' |[^ \x01]+') AS pieces FROM lines""",
    "sentences_": f"""
        SELECT track, line, text, s, CASE WHEN length(s) > 50 AND regexp_matches(s, '[{_STRONG}]') THEN
                   CASE WHEN NOT regexp_matches(last, '[{_STRONG}]\\z')
                             AND NOT (regexp_matches(last, '[{_EITHER}]\\z') AND length(last) >= 25)
                             AND length(tail) < 3 AND tail <> '' AND len(clean) > 1
                        THEN list_append(clean[1:len(clean) - 2], clean[-2] || ' ' || tail) ELSE clean END END AS parts
        FROM (SELECT *, raw[-1] AS last, {strip("raw[-1]")} AS tail,
                     list_filter(list_transform(raw, lambda x: {strip("x")}), lambda x: x <> '') AS clean
              FROM (SELECT track, line, text, {strip("text")} AS s, regexp_extract_all({strip("text")}, '{_SENTENCES}') AS raw FROM lines)
              WHERE s <> '')""",
    "words_": """
        SELECT doc_id AS track, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w,
               generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) - 1 AS tok_idx,
               len(string_split(replace(text, chr(10), ' '), ' ')) AS n
        FROM documents""",
    "tokens": """
        SELECT track, tok_idx, text, chars * 0.06::DOUBLE AS start_s, chars * 0.06::DOUBLE + length(text) * 0.05::DOUBLE AS end_s
        FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY track ORDER BY tok_idx
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars
              FROM (SELECT track, tok_idx, CASE WHEN tok_idx < n - 1 THEN w || ' ' ELSE w END AS text FROM words_))""",
    "blocks": """
        SELECT *, CAST(coalesce(sum(CASE WHEN regexp_matches(text, '[.!?:;。！？：；]') THEN 1 ELSE 0 END) OVER (
                   PARTITION BY track ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block
        FROM tokens""",
}

QUERIES = {
    "soft_wrapped": ("pieces_", r"""
        SELECT track, line, CASE WHEN text = '' THEN text ELSE regexp_replace(r.done || rtrim(r.cur), '\n\z', '') END AS wrapped
        FROM (SELECT *, list_reduce(list_prepend({'done': '', 'cur': '', 'p': ''},
                         list_transform(pieces, lambda x: {'done': '', 'cur': '', 'p': x})), lambda a, b: {
                     'done': CASE WHEN (b.p = ' ' AND a.cur = '') OR length(a.cur) + length(b.p) <= 40 OR a.cur = '' THEN a.done
                             ELSE a.done || rtrim(a.cur) || chr(10) END,
                     'cur': CASE WHEN b.p = ' ' AND a.cur = '' THEN '' WHEN length(a.cur) + length(b.p) <= 40 THEN a.cur || b.p
                            WHEN b.p = ' ' THEN '' ELSE b.p END,
                     'p': ''}) AS r FROM pieces_)"""),
    "broken_near": ("near_", "SELECT track, line, broken FROM near_"),
    "broken_lines": ("near_", """
        SELECT track, line, unnest(string_split(broken, chr(10))) AS text,
               generate_subscripts(string_split(broken, chr(10)), 1) - 1 AS part
        FROM near_ WHERE s <> ''"""),
    "split_by_marks": ("sentences_", """
        SELECT track, row_number() OVER (PARTITION BY track ORDER BY line, grp) AS line, start_ms, end_ms, text FROM (
            SELECT track, line, 0 AS grp, line * 10000 AS start_ms, line * 10000 + 9000 AS end_ms, text
            FROM sentences_ WHERE parts IS NULL OR len(parts) <= 1
            UNION ALL
            SELECT track, line, grp, min(a), max(b), string_agg(part, ' ' ORDER BY i) FROM (
                SELECT *, sum(CASE WHEN i > 1 AND b - a < 1000 THEN 0 ELSE 1 END)
                          OVER (PARTITION BY track, line ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp
                FROM (SELECT track, line, i, part,
                             CAST(trunc(line * 10000 + (upto - length(part)) / length(s) * 9000) AS BIGINT) AS a,
                             CAST(trunc(line * 10000 + upto / length(s) * 9000) AS BIGINT) AS b
                      FROM (SELECT *, sum(length(part)) OVER (PARTITION BY track, line ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
                            FROM (SELECT track, line, s, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
                                  FROM sentences_ WHERE len(parts) > 1))))
            GROUP BY track, line, grp)"""),
    "grammar_blocks": ("tokens", """
        SELECT track, tok_idx, text,
               CAST(coalesce(sum(CASE WHEN regexp_matches(text, '[.,!?:;。，！？：；、]') THEN 1 ELSE 0 END) OVER (
                   PARTITION BY track ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block
        FROM tokens"""),
    "grammar_cues": ("blocks", """
        SELECT track, block + 1 AS line, round(greatest(0, arg_min(start_s, tok_idx) + 0.24::DOUBLE), 6) AS start_s,
               round(arg_max(end_s, tok_idx) + 0.24::DOUBLE, 6) AS end_s, trim(string_agg(text, '' ORDER BY tok_idx)) AS text
        FROM blocks GROUP BY track, block"""),
}

RECURSIVE = {
    "merge_short": ("kinds", """
        WITH RECURSIVE {parts},
        walk(track, todo, done, moved) AS (
            SELECT track, list({'s': start_ms, 'e': end_ms, 't': text} ORDER BY line), list({'s': start_ms, 'e': end_ms, 't': text}) [1:0], false
            FROM kinds GROUP BY track
            UNION ALL
            SELECT track,
                   CASE WHEN len(todo) = 0 THEN done
                        WHEN short AND NOT back THEN list_prepend({'s': c.s, 'e': n.e, 't': trim(c.t || ' ' || n.t)}, todo[3:])
                        ELSE todo[2:] END,
                   CASE WHEN len(todo) = 0 THEN done[1:0]
                        WHEN short AND back THEN list_append(done[1:len(done) - 1], {'s': b.s, 'e': c.e, 't': trim(b.t || ' ' || c.t)})
                        WHEN short THEN done ELSE list_append(done, c) END,
                   CASE WHEN len(todo) = 0 THEN false ELSE moved OR short END
            FROM (SELECT *, len(done) > 0 AND (len(todo) = 1 OR c.s - b.e <= n.s - c.e) AS back,
                         c.e - c.s < 3000000 AND (len(done) > 0 OR len(todo) > 1) AS short
                  FROM (SELECT *, todo[1] AS c, todo[2] AS n, done[len(done)] AS b FROM walk WHERE len(todo) > 0 OR moved))),
        joined AS (SELECT track, unnest(done) AS c, generate_subscripts(done, 1) AS line FROM walk WHERE len(todo) = 0 AND NOT moved)
        """, "SELECT track, line, c.s AS start_ms, c.e AS end_ms, c.t AS text FROM joined"),
    "cut_speech": ("tokens", """
        WITH RECURSIVE {parts},
        spoken AS (
            SELECT track, tok_idx // 150 AS segment, tok_idx, trim(text) AS word,
                   round(start_s, 3) * 1000 AS s, round(end_s, 3) * 1000 AS e
            FROM tokens),
        long AS (
            SELECT track, segment, min(s) AS s0, max(e) AS e0 FROM spoken GROUP BY track, segment),
        told AS (
            SELECT p.*, row_number() OVER (PARTITION BY p.track, p.segment ORDER BY tok_idx) AS n
            FROM spoken p JOIN long l ON l.track = p.track AND l.segment = p.segment
            WHERE word <> '' AND NOT (e0 - s0 <= 5000)),
        walk(track, segment, n, tok_idx, word, chunk, s0, e0) AS (
            SELECT track, segment, n, tok_idx, word, 0, s, e FROM told WHERE n = 1
            UNION ALL
            SELECT track, segment, n, tok_idx, word, CASE WHEN split THEN chunk + 1 ELSE chunk END,
                   CASE WHEN split THEN s ELSE s0 END, e
            FROM (SELECT t.track, t.segment, t.n, t.tok_idx, t.word, t.s, t.e, w.chunk, w.s0,
                         t.e - w.s0 > 5000 OR right(w.word, 1) IN ('.', '?', '!', '。', '？', '！') OR t.s - w.e0 >= 400
                         OR (right(w.word, 1) IN (',', ';', ':', '，', '；', '：', '、') AND t.s - w.e0 >= 400 * 0.375)
                         OR (w.e0 - w.s0 > 5000 * 0.5 AND t.s - w.e0 >= 400 * 0.5) AS split
                  FROM walk w JOIN told t ON t.track = w.track AND t.segment = w.segment AND t.n = w.n + 1)),
        pieces AS (
            SELECT track, segment, min(tok_idx) AS idx, CAST(trunc(arg_max(s0, n)) AS BIGINT) AS start_ms,
                   CAST(trunc(arg_max(e0, n)) AS BIGINT) AS end_ms,
                   trim(regexp_replace(string_agg(word, ' ' ORDER BY n), '\\s+([.,?!:;])', '\\1', 'g')) AS text
            FROM walk GROUP BY track, segment, chunk
            UNION ALL
            SELECT p.track, p.segment, 0, CAST(trunc(min(s)) AS BIGINT), CAST(trunc(max(e)) AS BIGINT),
                   trim(string_agg(t.text, '' ORDER BY p.tok_idx))
            FROM spoken p JOIN long l ON l.track = p.track AND l.segment = p.segment
            JOIN tokens t ON t.track = p.track AND t.tok_idx = p.tok_idx
            WHERE e0 - s0 <= 5000 GROUP BY p.track, p.segment)
        """, """
        SELECT track, row_number() OVER (PARTITION BY track ORDER BY segment, idx) AS line, start_ms, end_ms, text FROM pieces"""),
}
