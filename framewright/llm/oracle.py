"""DuckDB SQL for the operators whose whole result SQL can express, over the same tables."""

from __future__ import annotations

from .rules import COMMON_WORDS, LISTED_CLASSES, Limits


def quality_rules(limits: Limits = Limits()) -> str:
    """Base counts, then references, distances and verdict, with the rules' own word lists and limits."""
    counts = ", ".join(f"length(regexp_replace(t, '[^{m}]+', '', 'g'))" for m in LISTED_CLASSES.values())
    n_class = len(LISTED_CLASSES) + 1
    lists = " UNION ALL ".join(f"SELECT '{x}' AS ref, {c!r} AS common" for x, c in COMMON_WORDS.items())
    votes = ", ".join(f"{{'n': len(list_filter(ws, lambda x: list_contains({c!r}, x))), 'k': {-k}, 'l': '{x}'}}" for k, (x, c) in enumerate(COMMON_WORDS.items()))
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"

    def distance(counts: str, shares: str) -> str:
        p, q = f"({counts}[i] / list_sum({counts}))", f"{shares}[i]"
        terms = f"({part.format(x=p, p=p, q=q)} + {part.format(x=q, p=p, q=q)}) / 2"
        return f"CASE WHEN list_sum({counts}) = 0 THEN 0 ELSE round(sqrt(greatest(list_sum(list_transform(range(1, len({counts}) + 1), lambda i: {terms})), 0)), 9) END"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
n AS (SELECT r, count(*) AS k FROM (
  SELECT DISTINCT r, p + o AS q FROM (
    SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM (
      SELECT r, p, ws[p] AS a, ws[p + 1] AS b, ws[p + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS p FROM w))), (VALUES (0), (1), (2)) AS s(o)
  WHERE times > 1) GROUP BY r),
lists AS ({lists}),
v AS (SELECT *, CASE WHEN lang IN ({", ".join(f"'{x}'" for x in COMMON_WORDS)}) THEN lang ELSE list_max([{votes}]).l END AS ref, [{counts}] AS cs FROM w),
h AS (SELECT v.*, len(ws) AS n, list_append(cs, length(t) - list_sum(cs)) AS classes,
    list_transform(common, lambda c: len(list_filter(ws, lambda x: x = c))) AS hits FROM v JOIN lists USING (ref)),
e AS (SELECT *, list_append(hits, n - list_sum(hits)) AS words FROM h),
rc AS (SELECT ref, list(g ORDER BY i) AS gs FROM (
    SELECT ref, i, exp(avg(ln((classes[i] + 0.5) / (list_sum(classes) + {0.5 * n_class})))) AS g
    FROM (SELECT ref, classes, unnest(range(1, {n_class} + 1)) AS i FROM e WHERE n >= {limits.guard_words}) GROUP BY ref, i) GROUP BY ref),
rw AS (SELECT ref, list(g ORDER BY i) AS gs FROM (
    SELECT ref, i, sum(words[i]) AS g FROM (SELECT ref, words, unnest(range(1, len(words) + 1)) AS i FROM e WHERE n >= {limits.guard_words}) GROUP BY ref, i) GROUP BY ref),
refs AS (SELECT rc.ref, list_transform(rc.gs, lambda x: round(x / list_sum(rc.gs), 12)) AS rcs, list_transform(rw.gs, lambda x: x / greatest(1, list_sum(rw.gs))) AS rws FROM rc JOIN rw USING (ref)),
j AS (SELECT e.*, {distance("classes", "rcs")} AS cd, {distance("words", "rws")} AS wd FROM e JOIN refs USING (ref)),
b AS (SELECT *, n < {limits.min_words} OR 100 * coalesce(k, 0) > {limits.max_repeat_percent} * n AS bad,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM (SELECT e.*, coalesce(cd, 0) AS cd, coalesce(wd, 0) AS wd FROM e LEFT JOIN (SELECT r, cd, wd FROM j) USING (r)) LEFT JOIN n USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_words,
  CAST(length(t) - classes[{list(LISTED_CLASSES).index("blank") + 1}] AS BIGINT) AS word_chars,
  CAST(classes[{list(LISTED_CLASSES).index("symbol") + 1}] AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words, bad AS base_failed,
  NOT bad AND NOT ((n >= {limits.guard_words} AND cd > {limits.max_class_distance}) OR (n >= {limits.word_guard} AND wd > {limits.max_word_distance})
    OR (n >= {limits.joint_guard} AND cd > {limits.joint_class_distance} AND wd > {limits.joint_word_distance})) AS kept
FROM b
"""


LINE_DEDUP = r"""
WITH u AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM u),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS pos, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
a AS (SELECT *, lead(line, 1) OVER o AS l1, lead(line, 2) OVER o AS l2, lead(w, 1) OVER o AS w1 FROM l WINDOW o AS (PARTITION BY doc_id, t ORDER BY pos)),
runs AS (
  SELECT doc_id, t, pos, 3 AS n, line AS x, l1 AS y, l2 AS z FROM a WHERE l2 IS NOT NULL
  UNION ALL SELECT doc_id, t, pos, 2, line, l1, '' FROM a WHERE l1 IS NOT NULL AND w + w1 >= 50
  UNION ALL SELECT doc_id, t, pos, 1, line, '', '' FROM a WHERE w >= 50),
f AS (SELECT *, row_number() OVER (PARTITION BY n, x, y, z ORDER BY doc_id NULLS FIRST, t, pos) AS k FROM runs),
g AS (SELECT DISTINCT doc_id, t, unnest(range(pos, pos + n)) AS pos FROM f WHERE k > 1),
z AS (SELECT l.doc_id, l.t, l.i FROM g JOIN l ON g.doc_id IS NOT DISTINCT FROM l.doc_id AND g.t = l.t AND g.pos = l.pos),
y AS (SELECT raw.doc_id, raw.t, coalesce(string_agg(raw.line, chr(10) ORDER BY raw.i) FILTER (z.i IS NULL), '') AS kept, count(z.i) AS gone,
    count(*) FILTER (regexp_matches(raw.line, '[^\x20\x09-\x0D]')) AS k
  FROM raw LEFT JOIN z ON raw.doc_id IS NOT DISTINCT FROM z.doc_id AND raw.t = z.t AND raw.i = z.i GROUP BY ALL)
SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE y.k END AS BIGINT) AS n_lines, CAST(y.gone AS BIGINT) AS n_removed,
  CASE WHEN text IS NULL THEN NULL ELSE CAST(length(kept) AS BIGINT) END AS kept_chars, sha256(kept) AS text_sha256
FROM documents d JOIN y ON d.doc_id IS NOT DISTINCT FROM y.doc_id AND coalesce(d.text, '') = y.t
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
f AS (SELECT *, length(replace(replace(text, '\', '\b'), '<', '\l'))
  + CASE WHEN before = role THEN 3 ELSE 3 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + 3 END AS len FROM p)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, list_transform(range(0, 4), lambda k: CAST('0x' || substr(x, CAST(1 + 8 * k AS INTEGER), 8) AS BIGINT)) AS h FROM d),
c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

# The checksum is folded over a feature's bytes with the usual table of 256 remainders, made by its rule.
IMPORTANCE = r"""
WITH tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tb),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
both_ AS (SELECT r, t FROM d UNION ALL SELECT -row_number() OVER (), coalesce(text, '') FROM benchmark),
w AS (SELECT r, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM both_),
f AS (
  SELECT r, unnest(ws) AS x FROM w
  UNION ALL SELECT r, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT r, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
n AS (SELECT r, x, count(*) AS k FROM f GROUP BY r, x),
x AS (SELECT DISTINCT x FROM n),
y AS (SELECT x, list_transform(range(0, octet_length(encode(x))), lambda i: CAST('0x' || substr(hex(encode(x)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS bs FROM x),
c AS (SELECT x, xor(list_reduce(list_concat([4294967295], bs), lambda c, b: xor(c // 256, tb[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM y, tab),
o AS (SELECT r, bucket, sum(k) AS k FROM n JOIN c USING (x) GROUP BY r, bucket),
g AS (SELECT bucket, coalesce(sum(k) FILTER (r > 0), 0) AS s, coalesce(sum(k) FILTER (r < 0), 0) AS t FROM o GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM g) + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM g) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM g),
m AS (SELECT r, CAST(sum(k) AS BIGINT) AS n_features, CAST(sum(k * gain) AS BIGINT) AS weight FROM o JOIN gain USING (bucket) GROUP BY r),
e AS (SELECT d.r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= 20 AS able,
    CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d JOIN w USING (r) LEFT JOIN m USING (r)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
q AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id NULLS FIRST, r) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT 5 * count(*) // 100 FROM e WHERE able) THEN CAST(place AS BIGINT) END AS rank FROM q
"""
