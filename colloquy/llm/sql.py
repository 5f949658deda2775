"""DuckDB SQL that states the same results plainly."""

P1_FOUND = r"""
WITH current AS (
  SELECT conversation_id, turns FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY try_cast(meta['revision'] AS DOUBLE) DESC NULLS LAST) = 1
), ours AS (
  SELECT DISTINCT conversation_id AS c, lower(trim(turn.speaker)) AS p, CAST(round(1000 * turn."start") AS BIGINT) AS s, turn.turn_id AS t
  FROM (SELECT conversation_id, unnest(turns) AS turn FROM current)
  WHERE turn.speaker IS NOT NULL AND turn."start" IS NOT NULL
), md AS (
  SELECT conversation_id, max(clip_t0_sec) AS t0, max(nullif(ami_meeting, '')) AS meeting FROM instances_metadata GROUP BY 1
), clips AS (
  SELECT e.conversation_id AS e, e.turns,
    coalesce(md.meeting, nullif(e.meta['meeting'], ''), regexp_replace(e.conversation_id, '^(.*)_t.*$', '\1')) AS c,
    CAST(round(1000 * coalesce(md.t0, try_cast(e.meta['t0'] AS DOUBLE),
      try_cast(regexp_extract(e.conversation_id, '^.*_t([^-]*)', 1) AS DOUBLE), 0)) AS BIGINT) AS off
  FROM ext_conversations e LEFT JOIN md ON md.conversation_id = e.conversation_id
), theirs AS (
  SELECT DISTINCT e, c, off, unnest(turns) AS turn FROM clips
), x AS (
  SELECT e, c, turn, turn.turn_id AS t, lower(trim(turn.speaker)) AS p, CAST(round(1000 * turn."start") AS BIGINT) + off AS s FROM theirs
)
SELECT x.e AS ext_conversation_id, x.t AS ext_turn_id, o.c AS conversation_id, o.t AS turn_id
FROM x JOIN ours o ON o.c = x.c AND o.p = x.p AND abs(o.s - x.s) <= 750
QUALIFY row_number() OVER (PARTITION BY x.e, x.c, x.turn ORDER BY abs(o.s - x.s), o.s, o.t) = 1
"""

P3_FOUND = r"""
WITH current AS (
  SELECT conversation_id, speakers, turns FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY try_cast(meta['revision'] AS DOUBLE) DESC NULLS LAST) = 1
), t AS (
  SELECT DISTINCT conversation_id,
    CASE WHEN coalesce(len(speakers), 0) > 0 THEN len(speakers)
         ELSE coalesce(len(list_distinct([x.speaker FOR x IN turns])), 0) END AS n,
    unnest(turns) AS turn
  FROM current
), cells AS (
  SELECT n, coalesce(turn.overlap, false) AS o, count(*) AS available FROM t GROUP BY 1, 2
), targets AS (SELECT DISTINCT * FROM sample_targets)
SELECT plan_id, category FROM (
  SELECT s.plan_id, s.category, s.min_turns, s.share_bp, s.sample_size, coalesce(sum(c.available), 0) AS available
  FROM targets s LEFT JOIN cells c ON c.n BETWEEN s.min_speakers AND s.max_speakers AND c.o = s.overlapped
  GROUP BY ALL)
WHERE available < greatest(min_turns, share_bp * sample_size // 10000)
"""

P3_REPORT = r"""
WITH current AS (
  SELECT conversation_id, speakers, turns FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY try_cast(meta['revision'] AS DOUBLE) DESC NULLS LAST) = 1
), t AS (
  SELECT DISTINCT conversation_id,
    CASE WHEN coalesce(len(speakers), 0) > 0 THEN len(speakers)
         ELSE coalesce(len(list_distinct([x.speaker FOR x IN turns])), 0) END AS n,
    unnest(turns) AS turn
  FROM current
), cells AS (
  SELECT n, coalesce(turn.overlap, false) AS o, count(*) AS available FROM t GROUP BY 1, 2
), targets AS (SELECT DISTINCT * FROM sample_targets)
SELECT plan_id, category, available, wanted, least(available, wanted) AS drawn, wanted - least(available, wanted) AS gap, available < wanted AS short FROM (
  SELECT plan_id, category, CAST(available AS BIGINT) AS available, CAST(greatest(min_turns, share_bp * sample_size // 10000) AS BIGINT) AS wanted FROM (
  SELECT s.plan_id, s.category, s.min_turns, s.share_bp, s.sample_size, coalesce(sum(c.available), 0) AS available
  FROM targets s LEFT JOIN cells c ON c.n BETWEEN s.min_speakers AND s.max_speakers AND c.o = s.overlapped
  GROUP BY ALL))
"""

P4_FOUND = r"""
WITH current AS (
  SELECT conversation_id, turns FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY try_cast(meta['revision'] AS DOUBLE) DESC NULLS LAST) = 1
), t AS (
  SELECT DISTINCT conversation_id, unnest(turns) AS turn FROM current
), long AS (
  SELECT conversation_id, turn.turn_id AS turn_id, turn.text AS text FROM t WHERE length(turn.text) > 512
), w AS (
  SELECT conversation_id, turn_id, regexp_replace(text, '[\v\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g') AS text FROM long
), s AS (
  SELECT conversation_id, turn_id, unnest(string_split_regex(regexp_replace(regexp_replace(text,
      '([.!?…]+["''”’»)\]]*)([\s\p{Z}\x{1f}]|$)', '\1' || chr(10) || '\2', 'g'),
      '([。！？]+[”’」』]*)', '\1' || chr(10), 'g'), '[\n\r]')) AS sentence,
  row_number() OVER () AS id FROM w
), m AS (
  SELECT conversation_id, turn_id, id,
    length(regexp_replace(sentence, '^[\s\p{Z}\x{1f}]+|[\s\p{Z}\x{1f}]+$', '', 'g')) AS len,
    list_max([length(x) FOR x IN string_split_regex(sentence, '[\s\p{Z}\x{1f}]+')]) AS run
  FROM s
)
SELECT conversation_id, turn_id,
  CASE WHEN max(len) <= 512 THEN 'sentence' WHEN max(run) FILTER (WHERE len > 512) > 512 THEN 'hard' ELSE 'space' END AS cut
FROM m GROUP BY conversation_id, turn_id, id
"""


P4_PIECES_HOLD = r"""
WITH current AS (
  SELECT conversation_id, turns FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY try_cast(meta['revision'] AS DOUBLE) DESC NULLS LAST) = 1
), t AS (
  SELECT DISTINCT conversation_id, unnest(turns) AS turn FROM current
), l AS (
  SELECT conversation_id, turn.turn_id AS turn_id, regexp_replace(turn.text, '[\s\p{Z}\x{1c}-\x{1f}\x{85}\v]+', '', 'g') AS c,
    length(regexp_replace(turn.text, '^[\s\p{Z}\x{1c}-\x{1f}\x{85}\v]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}\v]+$', '', 'g')) > 512 AS cut_up
  FROM t WHERE length(turn.text) > 512
)
SELECT conversation_id, turn_id, CAST(length(c) AS BIGINT) AS characters, true AS fits, cut_up FROM l
"""
