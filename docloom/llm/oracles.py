"""SQL for the operators whose results it can express, by definition and not by method: all pairs, all windows, a recursive closure."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _reach(ids: str, links: str) -> str:
    """reach: id, component of the ids, by links (a, b) in both directions."""
    return f"""closure AS (SELECT id, id AS r FROM {ids} UNION SELECT c.id, l.b FROM closure c JOIN {links} l ON l.a = c.r),
  reach AS (SELECT id, min(r) AS component_id FROM closure GROUP BY id)"""


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_NORM = f"sqrt({_DOT.format(a='embedding', b='embedding')})"

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding, label, {_NORM} AS n FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id AND len(a.embedding) = len(b.embedding)
    WHERE a.n > 0 AND b.n > 0 AND {_DOT.format(a='a.embedding', b='b.embedding')} / (a.n * b.n) >= 0.93),
  ids AS (SELECT vec_id AS id FROM embeddings), {_reach('ids', 'links')}, deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN reach ON id = vec_id LEFT JOIN deg ON a = vec_id"""

_WORDS5 = f"coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS5} AS l FROM documents), b AS (SELECT item_id, {_WORDS5} AS l FROM benchmark),
  k AS (SELECT item_id, l, least(10, len(l)) AS m, unnest(generate_series(1, greatest(1, len(l) - 9))) AS k FROM b WHERE len(l) > 0),
  win AS (SELECT DISTINCT item_id, m, array_to_string(l[k:k + m - 1], ' ') AS w FROM k), sizes AS (SELECT DISTINCT m FROM win),
  spots AS (SELECT doc_id, l, m, unnest(generate_series(1, len(l) - m + 1)) AS p FROM d CROSS JOIN sizes WHERE len(l) >= m),
  dw AS (SELECT doc_id, m, p, array_to_string(l[p:p + m - 1], ' ') AS w FROM spots),
  hits AS (SELECT doc_id, p, win.m AS m, item_id FROM dw JOIN win ON win.m = dw.m AND win.w = dw.w),
  places AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + m - 1)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM hits)) GROUP BY doc_id),
  found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id"""

_WORDS9 = f"coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), [])"

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS9} AS l FROM documents),
  sh AS (SELECT DISTINCT doc_id, array_to_string(l[k:k + 4], ' ') AS s FROM (SELECT doc_id, l, unnest(generate_series(1, greatest(1, len(l) - 4))) AS k FROM d WHERE len(l) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
  links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
  ids AS (SELECT doc_id AS id FROM d), {_reach('ids', 'links')}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN reach ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: crc32 by its table; {bytes} is a list of numbers, and the table `crc_table` (t) has to be joined.
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
_CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

CONVERSATIONS = rf"""WITH RECURSIVE {_CRC_TABLE},
  sorts AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format(bytes="list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)")} % 20 AS kind FROM conversations, crc_table),
  damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM sorts, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM damaged),
  seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM ordered),
  faulty AS (SELECT *, blank OR again AS gone, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated, i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
  runs(a, mid, inserts, added) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
    (0, 2, 'I', chr(10) || 'user:'), (1, 2, 'I', chr(10) || 'user:'), (2, 3, 'I', chr(10) || 'assistant:'), (3, 2, 'I', chr(10) || 'user:')),
  edits(mid, edit, initial, b, price) AS (VALUES (0, 'D', NULL, 0, 4), (1, 'D', NULL, 1, 4), (2, 'D', NULL, 2, 4), (3, 'D', NULL, 3, 4),
    (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (3, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3)),
  ends(mid, inserts, added) AS (VALUES (0, '', ''), (1, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 'I', chr(10) || 'assistant:'), (3, '', '')),
  layers AS (SELECT conv_id, 0::BIGINT AS i, 0 AS mid, 0 AS cost, '' AS audit, '' AS repaired FROM (SELECT DISTINCT conv_id FROM faulty)
    UNION ALL SELECT conv_id, i, mid, cost, audit, repaired FROM (
      SELECT l.conv_id, r.i, e.b AS mid, l.cost + 3 * length(u.inserts) + e.price + CASE WHEN r.truncated AND e.edit <> 'D' THEN 3 ELSE 0 END AS cost, l.audit || u.inserts || e.edit AS audit,
        l.repaired || u.added || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || CASE e.b WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text END AS repaired,
        row_number() OVER (PARTITION BY l.conv_id, e.b ORDER BY l.cost + 3 * length(u.inserts) + e.price + CASE WHEN r.truncated AND e.edit <> 'D' THEN 3 ELSE 0 END, l.audit || u.inserts || e.edit) AS k
      FROM layers l JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i + 1 JOIN runs u ON u.a = l.mid JOIN edits e ON e.mid = u.mid
      WHERE e.edit = 'D' OR NOT r.gone AND (e.edit = 'R' OR e.initial = left(r.role, 1))) WHERE k = 1),
  lengths AS (SELECT conv_id, max(i) AS n FROM faulty GROUP BY conv_id),
  cheapest AS (SELECT l.conv_id, l.cost + 3 * length(e.inserts) AS cost, l.audit || e.inserts AS audit, l.repaired || e.added AS repaired,
      row_number() OVER (PARTITION BY l.conv_id ORDER BY l.cost + 3 * length(e.inserts), l.audit || e.inserts) AS k
    FROM layers l JOIN lengths n ON n.conv_id IS NOT DISTINCT FROM l.conv_id AND n.n = l.i JOIN ends e ON e.mid = l.mid),
  faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
  coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(c.cost, 0)::BIGINT AS cost, coalesce(c.audit, '') AS audit, sha256(coalesce(substr(c.repaired, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN (SELECT * FROM cheapest WHERE k = 1) c ON c.conv_id IS NOT DISTINCT FROM o.conv_id"""

_UTF8 = """flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [(192 | (ord(x) >> 6))::BIGINT, (128 | (ord(x) & 63))::BIGINT] END))"""

SPELLING = f"""WITH RECURSIVE {_CRC_TABLE},
  runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents),
  counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
  hashed AS (SELECT run, n, {_CRC.format(bytes=_UTF8.format(text="coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM counted, crc_table),
  damaged AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
  words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
  thin AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
  pairs AS (SELECT a.word, b.word AS other, b.n FROM thin a JOIN thin b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM thin a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM thin a JOIN words b ON a.rest = b.word),
  best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY word),
  forms AS (SELECT b.word, b.n_near, b.most, min(p.other) AS other FROM best b JOIN pairs p ON p.word = b.word AND p.n = b.most GROUP BY b.word, b.n_near, b.most),
  chosen AS (SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.most >= 10 * w.n THEN f.other END AS form, CASE WHEN f.most >= 10 * w.n THEN f.most END AS form_n FROM words w LEFT JOIN forms f ON f.word = w.word),
  walk AS (SELECT word, word AS now, 0 AS steps FROM chosen UNION ALL SELECT k.word, c.form, k.steps + 1 FROM walk k JOIN chosen c ON c.word = k.now WHERE c.form IS NOT NULL),
  ends AS (SELECT word, max_by(now, steps) AS root FROM walk GROUP BY word)
SELECT c.word, c.form, e.root, c.n, c.n_near::BIGINT AS n_near, c.form_n FROM chosen c JOIN ends e ON e.word = c.word"""
