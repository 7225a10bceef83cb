"""SQL of the repeated-text and near-duplicate queries, by their definitions alone: no hashes, no bands, no indexes.

A window's first document is found by grouping whole windows, components by reachability along links.
"""

from __future__ import annotations

import string

WORD = r"[^\x20\x09-\x0D]+"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
BYTES, CHUNK, WORDS = 50, 1000, 13


def repeated_words() -> str:
    """op6: words covered by a 13-word window that a document with a smaller doc_id has too."""
    window = " || ' ' || ".join(["word"] + [f"lead(word, {k}) OVER d" for k in range(1, WORDS)])
    return f"""
WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
words AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM lists),
windows AS (SELECT doc_id, i, word, {window} AS win FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM windows WHERE win IS NOT NULL GROUP BY win),
hits AS (SELECT w.doc_id, w.i, w.word, coalesce(f.first_doc < w.doc_id, false) AS hit FROM windows w LEFT JOIN firsts f ON f.win = w.win),
marked AS (
  SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WORDS - 1} PRECEDING AND CURRENT ROW) AS gone FROM hits)
SELECT d.doc_id, count(m.i) AS n_words, count(m.i) FILTER (m.gone) AS n_removed,
  sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (NOT m.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id"""


def repeated_bytes() -> str:
    """op3: bytes covered by a 50-byte string that starts in a document with a smaller doc_id too.  Texts are cut into
    overlapping chunks only so that a string is read from near the start of a short value."""
    return f"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
numbered AS (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(0, length(h) // {2 * CHUNK} + 1)) AS c FROM texts),
chunks AS (SELECT doc_id, n, c, substr(h, {2 * CHUNK} * c + 1, {2 * (CHUNK + BYTES - 1)}) AS part FROM numbered),
places AS (SELECT doc_id, n, c, part, unnest(range(0, least({CHUNK}, n - {CHUNK} * c))) AS r FROM chunks),
windows AS (
  SELECT doc_id, {CHUNK} * c + r AS i, substr(part, 2 * r + 1, 2) AS byte,
    CASE WHEN {CHUNK} * c + r + {BYTES} <= n THEN substr(part, 2 * r + 1, {2 * BYTES}) END AS win FROM places),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM windows WHERE win IS NOT NULL GROUP BY win),
hits AS (SELECT w.doc_id, w.i, w.byte, coalesce(f.first_doc < w.doc_id, false) AS hit FROM windows w LEFT JOIN firsts f ON f.win = w.win),
marked AS (
  SELECT doc_id, i, byte, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {BYTES - 1} PRECEDING AND CURRENT ROW) AS gone FROM hits),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked)
SELECT t.doc_id, length(t.h) // 2 AS n_bytes, count(r.i) FILTER (r.gone) AS n_removed, count(r.i) FILTER (r.opens) AS n_spans,
  sha256(unhex(coalesce(string_agg(r.byte, '' ORDER BY r.i) FILTER (NOT r.gone), ''))) AS kept_sha256
FROM texts t LEFT JOIN runs r ON r.doc_id = t.doc_id GROUP BY t.doc_id, t.h"""


def near_duplicates(width: int = 3, percent: int = 85) -> str:
    """op2: links of sets that overlap enough, and the least doc_id reachable along them.

    Two such sets share one of the rarest n - ceil(n * percent / 100) + 1 shingles of either, which finds the pairs to
    compare; the comparison counts all shingles."""
    shingle = ", ".join(["word"] + [f"lead(word, {k}) OVER d" for k in range(1, width)])
    return f"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS ws FROM documents),
words AS (SELECT doc_id, len(ws) AS n, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM lists),
runs AS (SELECT doc_id, n, i, concat_ws(' ', {shingle}) AS s FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
shingles AS (SELECT DISTINCT doc_id, s FROM runs WHERE i <= greatest(1, n - {width - 1})),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT s, count(*) AS docs FROM shingles GROUP BY s),
ranked AS (
  SELECT a.doc_id, a.s, z.n, row_number() OVER (PARTITION BY a.doc_id ORDER BY c.docs, a.s) AS k
  FROM shingles a JOIN common c ON c.s = a.s JOIN sizes z ON z.doc_id = a.doc_id),
rare AS (SELECT doc_id, s, n FROM ranked WHERE k <= n - (n * {percent} + 99) // 100 + 1),
near AS (
  SELECT DISTINCT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv FROM rare a JOIN rare b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
shared AS (
  SELECT p.u, p.v, p.nu, p.nv, count(*) AS same FROM near p JOIN shingles a ON a.doc_id = p.u JOIN shingles b ON b.doc_id = p.v AND b.s = a.s GROUP BY ALL),
links AS (SELECT u, v FROM shared WHERE 100 * same >= {percent} * (nu + nv - same)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT DISTINCT u AS doc_id, u AS node FROM ways
  UNION SELECT r.doc_id, w.v FROM reach r JOIN ways w ON w.u = r.node),
found AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(f.component_id, d.doc_id) AS component_id,
  coalesce(f.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id"""


def fill_in_middle(seed: int = 42, cut: int = 50, suffix_first: int = 80) -> str:
    """op11: units are matched one by one; prefix, middle and suffix are joined units."""
    draw = [f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4)]
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u FROM documents),
drawn AS (SELECT doc_id, t, u, len(u) AS n, {", ".join(draw)} FROM texts),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {cut} THEN 'plain'
      WHEN h4 % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT doc_id, t, n, form, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m,
    array_to_string(list_slice(u, b + 1, n), '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
    ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces"""


def secret_spans(rules, n_base: int) -> str:
    """op12: every rule on every text.  A match starts after the text between matches and the matches before it."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    one = []
    for i, r in enumerate(rules):
        pattern = quote(r.pattern)
        tests = [f"length(g) >= {r.least}"] + [f"regexp_matches(m, {quote(h)})" for h in r.has]
        one.append(f"""
SELECT doc_id, {i} AS rule, {quote(r.kind)} AS kind, m, start FROM (
  SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g,
    unnest([list_sum([length(x) FOR x IN between[1:k]]) + coalesce(list_sum([length(x) FOR x IN ms[1:k - 1]]), 0) FOR k IN range(1, len(ms) + 1)]) AS start
  FROM (
    SELECT doc_id, regexp_extract_all(text, {pattern}) AS ms, regexp_extract_all(text, {pattern}, {r.group}) AS gs,
      string_split_regex(text, {pattern}) AS between FROM documents WHERE regexp_matches(text, {pattern})))
WHERE {" AND ".join(tests)}""")
    counts = ", ".join(f"count(s.rule) FILTER (s.rule = {i}) AS n_{r.kind}" for i, r in enumerate(rules[:n_base]))
    said = "string_agg(kind || ':' || start || ':' || (start + length(m)), ',' ORDER BY start, rule)"
    return f"""
WITH spans AS ({" UNION ALL ".join(one)}),
told AS (SELECT doc_id, rule, kind, m, CAST(start AS BIGINT) AS start FROM spans)
SELECT d.doc_id, {counts}, sha256(coalesce({said} FILTER (s.rule < {n_base}), '')) AS base_sha256,
  coalesce({said}, '') AS spans, count(s.rule) FILTER (s.rule >= {n_base}) AS n_added
FROM documents d LEFT JOIN told s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""
