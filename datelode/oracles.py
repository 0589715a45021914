"""DuckDB SQL for the queries of datelode.catalog, built from shared common table expressions."""

from __future__ import annotations

from datelode.functions.patterns import BUILT_IN
from datelode.functions.timeparts import PRECISIONS
from datelode.operators.evidence import FOLDER_DECAY, FOLDER_DISCOUNT, METADATA_EXTENSIONS
from datelode.operators.labels import FIELD_WIDTH
from datelode.operators.mine import _RANGE as RANGES
from datelode.operators.mine import BASE, FIELDS, PRECISION
from datelode.operators.profile import LIGHT_DATES
from datelode.plans.export import EXTENSION, FORMATS, KINDS
from datelode.sources.album import FACTS, FOLDER, FORMAT, NAME, PART, SCREEN_RATIO, SCREENS

_RANK = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{p}' THEN {k}" for k, p in enumerate(PRECISIONS)) + " ELSE 0 END"
_CONTENT = "'" + "', '".join(METADATA_EXTENSIONS) + "'"

ALBUM = f"""
e0 AS (SELECT *, {", ".join(f"lpad(CAST(CAST(extract({u} FROM ts) AS INT) AS STRING), {n}, '0') AS {k}" for k, (u, n) in PART.items())} FROM events),
e1 AS (SELECT *, {NAME} AS filename, {FOLDER} AS folder_name, {", ".join(f"{v} AS {k}" for k, v in FACTS.items())} FROM e0),
e2 AS (SELECT *, 'u' || CAST(user_id AS STRING) || '/' || folder_name || '/' || filename AS relpath, regexp_replace(filename, '\\.[^.]*$', '') AS stem, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) AS ext FROM e1),
album AS MATERIALIZED (SELECT *, sha1(relpath || ':' || CAST(event_id AS STRING)) AS item_id, {FORMAT} AS format_real FROM e2)"""

SHOTS = " OR ".join(f"(least(width, height) = {min(s)} AND greatest(width, height) = {max(s)})" for s in SCREENS) + f" OR greatest(width, height) / least(width, height) > {SCREEN_RATIO}"


def _pattern_rows(source: str, text: str, carry: str) -> str:
    """One row a match of each pattern (names of the album hold each at most once)."""
    out = []
    for k, p in enumerate(BUILT_IN):
        before, after = ("(?:^|[^0-9])", "(?:[^0-9]|$)") if p.no_digit else ("", f"(?:[^{p.then[1:]}|$)" if p.then else "")
        part = lambda i, d: f"CAST(regexp_extract(m, '{p.core}', {i}) AS INT)" if i <= p.parts else str(d)  # noqa: B023, E731
        dt = f"make_timestamp({part(1, 1)}, {part(2, 1)}, {part(3, 1)}, {part(4, 0)}, {part(5, 0)}, CAST({part(6, 0)} AS DOUBLE))"
        out.append(f"SELECT {carry}, {k} AS k, '{p.name}' AS pattern_name, '{p.precision}' AS precision, {p.confidence}e0 AS confidence, m AS matched_text, {dt} AS dt FROM (SELECT *, regexp_extract({text}, '{before}({p.core}){after}', 1) AS m FROM {source}) WHERE m <> ''")
    return " UNION ALL ".join(out)


_ORDER = f"confidence DESC, {_RANK('precision')} DESC, k"
EVIDENCE = f"""{ALBUM},
live AS MATERIALIZED (SELECT * FROM album WHERE NOT unsupported),
ex AS (SELECT item_id, ev_seq, 'exif' AS source, dt, 'second' AS precision, confidence, TRUE AS is_direct FROM (
  SELECT item_id, 0 AS ev_seq, exif_original AS dt, 1e0 AS confidence FROM live WHERE ext IN ({_CONTENT}) UNION ALL SELECT item_id, 1, exif_digitized, 0.9e0 FROM live WHERE ext IN ({_CONTENT})) WHERE dt IS NOT NULL),
fs AS (SELECT item_id, 3 AS ev_seq, 'filesystem' AS source, mtime AS dt, 'second' AS precision, 0.2e0 AS confidence, FALSE AS is_direct FROM live WHERE ext IN ({_CONTENT}) AND exif_original IS NULL AND exif_digitized IS NULL),
fn0 AS MATERIALIZED ({_pattern_rows("live", "stem", "item_id")}),
fn AS MATERIALIZED (SELECT item_id, CAST(99 + row_number() OVER (PARTITION BY item_id ORDER BY {_ORDER}) AS INT) AS ev_seq, 'filename' AS source, dt, precision, confidence, TRUE AS is_direct, pattern_name, matched_text FROM fn0),
levels AS (SELECT item_id, 0 AS depth, folder_name AS name FROM live UNION ALL SELECT item_id, 1, 'u' || CAST(user_id AS STRING) FROM live UNION ALL SELECT item_id, 2, 'album' FROM live),
fo0 AS MATERIALIZED ({_pattern_rows("levels", "name", "item_id, depth, name")}),
fo AS MATERIALIZED (SELECT item_id, CAST(1000 * (depth + 1) - 1 + row_number() OVER (PARTITION BY item_id, depth ORDER BY {_ORDER}) AS INT) AS ev_seq, 'foldername' AS source, dt,
  CASE WHEN {_RANK("precision")} > 3 THEN 'day' ELSE precision END AS precision, round(confidence * {FOLDER_DISCOUNT}e0 * CASE depth WHEN 0 THEN {FOLDER_DECAY[0]}e0 WHEN 1 THEN {FOLDER_DECAY[1]}e0 ELSE {FOLDER_DECAY[2]}e0 END, 3) AS confidence, FALSE AS is_direct, name FROM fo0),
ev AS MATERIALIZED (SELECT * FROM ex UNION ALL SELECT * FROM fs UNION ALL SELECT item_id, ev_seq, source, dt, precision, confidence, is_direct FROM fn UNION ALL SELECT item_id, ev_seq, source, dt, precision, confidence, is_direct FROM fo)"""


def _resolve(ev: str) -> str:
    last = "- INTERVAL '1' MICROSECOND"
    wide = lambda u: f"date_trunc('{u}', dt)"
    return f"""
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY is_direct DESC, confidence DESC, {_RANK("precision")} DESC, ev_seq) AS rn FROM {ev} WHERE dt IS NOT NULL),
pr AS MATERIALIZED (SELECT * FROM rk WHERE rn = 1),
cf AS MATERIALIZED (SELECT rk.item_id, count(*) FILTER (WHERE rk.rn > 1 AND rk.confidence >= 0.5 AND abs(date_diff('microsecond', pr.dt, rk.dt)) > CASE WHEN rk.source = pr.source THEN 60 ELSE 30 END * 86400000000) AS n_conflicts FROM rk JOIN pr USING (item_id) GROUP BY 1),
sm AS MATERIALIZED (SELECT item_id, string_agg(source, ',' ORDER BY rn) AS source_summary FROM (SELECT item_id, source, min(rn) AS rn FROM rk GROUP BY 1, 2) GROUP BY 1),
resolved AS MATERIALIZED (SELECT item_id, dt AS final_datetime, confidence, precision,
  CASE precision WHEN 'second' THEN dt WHEN 'minute' THEN dt - INTERVAL '30' SECOND WHEN 'hour' THEN dt - INTERVAL '30' MINUTE WHEN 'day' THEN {wide("day")} WHEN 'month' THEN {wide("month")} WHEN 'year' THEN {wide("year")} END AS range_start,
  CASE precision WHEN 'second' THEN dt WHEN 'minute' THEN dt + INTERVAL '30' SECOND WHEN 'hour' THEN dt + INTERVAL '30' MINUTE WHEN 'day' THEN {wide("day")} + INTERVAL '1' DAY {last} WHEN 'month' THEN {wide("month")} + INTERVAL '1' MONTH {last} WHEN 'year' THEN {wide("year")} + INTERVAL '1' YEAR {last} END AS range_end,
  source AS primary_source, source_summary, n_conflicts FROM pr JOIN cf USING (item_id) JOIN sm USING (item_id))"""


RESOLVED = EVIDENCE + "," + _resolve("ev")
ORDERS = """oe AS (SELECT o_orderkey AS item_id, 0 AS ev_seq, 'order' AS source, CAST(o_orderdate AS TIMESTAMP) AS dt, 'day' AS precision, 0.7e0 AS confidence, TRUE AS is_direct FROM orders
  UNION ALL SELECT l_orderkey, l_linenumber, 'ship', CAST(l_shipdate AS TIMESTAMP), 'second', 0.55e0, FALSE FROM lineitem),""" + _resolve("oe")

_SCORES = f"""{RESOLVED},
scored AS MATERIALIZED (SELECT a.*, r.final_datetime, r.confidence, r.n_conflicts, r.primary_source, CASE WHEN r.confidence >= 0.9 THEN 2e0 WHEN r.confidence >= 0.7 THEN 1e0 ELSE 0e0 END + CASE WHEN exif_original IS NOT NULL THEN 3e0 ELSE 0e0 END + CASE WHEN has_gps THEN 0.5e0 ELSE 0e0 END
  + CASE WHEN (ext = 'jpg' AND format_real = 'JPEG') OR (ext = 'png' AND format_real = 'PNG') OR (ext = 'heic' AND format_real = 'HEIF') THEN 1e0 ELSE 0e0 END - CASE WHEN {SHOTS} THEN 1e0 ELSE 0e0 END AS score
  FROM album a LEFT JOIN resolved r USING (item_id))"""
SCORED = f"""{_SCORES},
dups AS MATERIALIZED (SELECT item_id, sha1 AS group_id, CAST(row_number() OVER (PARTITION BY sha1 ORDER BY score DESC, filesize DESC, relpath) - 1 AS INT) AS dup_rank, 'sha1' AS kind, FALSE AS needs_review
  FROM scored WHERE sha1 IN (SELECT sha1 FROM album WHERE sha1 <> '' GROUP BY 1 HAVING count(*) > 1))"""

_MISMATCH = "(format_real <> '' AND (" + " OR ".join(f"ext = '{e}' AND format_real NOT IN ('{"', '".join(f)}')" for e, f in FORMATS.items()) + "))"
_TARGET = "CASE format_real " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSION.items()) + " ELSE ext END"
_KIND = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
def _plan(scored: str) -> str:
    return f"""{scored},
p0 AS MATERIALIZED (SELECT s.*, d.group_id, d.dup_rank, d.kind, d.needs_review, {_MISMATCH} AS bad, coalesce(d.dup_rank > 0, FALSE) AS dup FROM scored s LEFT JOIN dups d USING (item_id)),
p1 AS MATERIALIZED (SELECT *, CASE WHEN bad THEN {_TARGET} ELSE ext END AS target, concat_ws('; ', CASE WHEN final_datetime IS NULL THEN 'time unresolved' WHEN confidence < 0.6 THEN 'low confidence (' || printf('%.2f', confidence) || ' < 0.6)' END,
  CASE WHEN n_conflicts > 0 THEN 'time conflict detected' END, CASE WHEN needs_review THEN 'visually similar to another photo' END, CASE WHEN bad THEN 'format mismatch: .' || ext || ' but actually ' || format_real END) AS reasons FROM p0),
plan AS MATERIALIZED (SELECT item_id, relpath AS source_relpath, CASE WHEN unsupported THEN 'skip_unsupported' WHEN dup THEN 'duplicate' WHEN bad THEN 'convert' ELSE 'copy' END AS action,
  CASE WHEN unsupported THEN 'unsupported' WHEN dup THEN 'duplicate' WHEN reasons <> '' THEN 'review' ELSE 'confident' END AS bucket,
  CASE WHEN unsupported THEN 'unsupported format: .' || ext WHEN dup THEN {_KIND} || ' duplicate (group=' || substr(group_id, 1, 8) || '…, rank=' || CAST(dup_rank AS STRING) || ')' WHEN reasons <> '' THEN reasons ELSE 'ok' END AS reason,
  CASE WHEN NOT unsupported AND NOT dup AND target <> ext THEN regexp_replace(relpath, '\\.[^./]*$', '.' || target) ELSE relpath END AS dest_relpath, ext AS source_ext, CASE WHEN unsupported OR dup THEN ext ELSE target END AS target_ext,
  final_datetime, coalesce(confidence, 0e0) AS confidence, coalesce(primary_source, '') AS primary_source, coalesce(group_id, '') AS duplicate_group_id, coalesce(dup_rank, 0) AS duplicate_rank, coalesce(kind, '') AS duplicate_kind FROM p1),
kept AS (SELECT p.*, k.source_relpath AS duplicate_kept_relpath FROM plan p LEFT JOIN (SELECT duplicate_group_id, source_relpath FROM plan WHERE duplicate_group_id <> '' AND duplicate_rank = 0) k USING (duplicate_group_id))"""


PLAN = _plan(SCORED)

_LINE = "─" * 40
NOTES = f"""SELECT item_id, bucket, CASE WHEN bucket = 'review' THEN concat_ws(chr(10), 'review note', '{_LINE}', 'file      : ' || source_relpath, 'reason    : ' || reason, '', 'resolved time:', '  datetime : ' || coalesce(CAST(final_datetime AS STRING), 'unknown'),
  '  confidence: ' || printf('%.2f', confidence), '  source   : ' || CASE WHEN primary_source = '' THEN '-' ELSE primary_source END,
  CASE WHEN duplicate_group_id <> '' THEN concat_ws(chr(10), '', 'duplicate info:', '  group  : ' || duplicate_group_id, '  rank   : ' || CAST(duplicate_rank AS STRING), '  kind   : ' || duplicate_kind) END)
  ELSE concat_ws(chr(10), 'duplicate file', '{_LINE}', 'This file is a duplicate and was not selected for export.', '', 'file     : ' || source_relpath, 'kept as  : ' || coalesce(duplicate_kept_relpath, '(unknown)'), 'kind     : ' || duplicate_kind, 'group    : ' || duplicate_group_id, 'rank     : ' || CAST(duplicate_rank AS STRING), '', 'You can safely delete this file.') END || chr(10) AS note
  FROM kept WHERE bucket IN ('review', 'duplicate')"""

COS = """cs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda k: CAST(a.embedding[k] AS DOUBLE) * CAST(b.embedding[k] AS DOUBLE))), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""
KNN = COS + """, nn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rk FROM cs WHERE score >= 0.3) WHERE rk <= 5)"""
HASH = """hs AS (SELECT vec_id AS id, list_reduce(list_transform(range(1, 65), lambda k: CASE WHEN embedding[k] > 0 THEN CAST(1 AS UBIGINT) << CAST(k - 1 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END), lambda a, b: a | b) AS h FROM embeddings),
hp AS (SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance FROM hs a JOIN hs b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 16)"""

def _sessions(key: str, dated: str, floating: str) -> str:
    return f"""{RESOLVED},
dated AS MATERIALIZED (SELECT a.*, r.final_datetime, r.confidence{dated} FROM album a LEFT JOIN resolved r USING (item_id)),
an0 AS (SELECT *, CASE WHEN date_diff('microsecond', lag(final_datetime) OVER w, final_datetime) > 21600000000 THEN 1 ELSE 0 END AS new FROM dated WHERE final_datetime IS NOT NULL AND confidence >= 0.6 WINDOW w AS (PARTITION BY {key} ORDER BY final_datetime, item_id)),
an AS MATERIALIZED (SELECT *, CAST(sum(new) OVER (PARTITION BY {key} ORDER BY final_datetime, item_id ROWS UNBOUNDED PRECEDING) AS INT) AS session_idx, 'u' || CAST(user_id AS STRING) || '/' || folder_name AS folder FROM an0),
st AS MATERIALIZED (SELECT {key}, session_idx, min(final_datetime) AS time_start, max(final_datetime) AS time_end, count(*) AS n_anchors, string_agg(DISTINCT CAST(year(final_datetime) AS STRING), ',' ORDER BY CAST(year(final_datetime) AS STRING)) AS year_candidates, min(year(final_datetime)) AS y0, list(DISTINCT year(final_datetime)) AS years,
  arg_min(folder, (final_datetime, item_id)) AS first_folder FROM an GROUP BY 1, 2),
fl AS (SELECT d.item_id, d.{key}, coalesce({floating}, 0) AS session_idx FROM dated d WHERE d.final_datetime IS NULL OR d.confidence < 0.6),
members AS MATERIALIZED (SELECT item_id, {key}, session_idx, TRUE AS is_anchor FROM an UNION ALL SELECT item_id, {key}, session_idx, FALSE FROM fl)"""


_FOLDER_OF = "'u' || CAST(d.user_id AS STRING) || '/' || d.folder_name"
SESSIONS = _sessions("user_id", "", f"(SELECT min(session_idx) FROM st WHERE st.user_id = d.user_id AND st.first_folder = {_FOLDER_OF})")
# the whole album as one key: the same folder, else any folder of the same user
ALBUM_SESSIONS = _sessions("whole", ", 0 AS whole", f"(SELECT min(session_idx) FROM st WHERE st.first_folder = {_FOLDER_OF}), (SELECT min(session_idx) FROM st WHERE string_split(st.first_folder, '/')[1] = 'u' || CAST(d.user_id AS STRING))")

TOKENS = f"""{SESSIONS},
fp AS (SELECT item_id, 0 AS depth, folder_name AS folder_text FROM live UNION ALL SELECT item_id, 1, 'u' || CAST(user_id AS STRING) FROM live),
dg AS (SELECT *, regexp_replace(folder_text, '[^0-9]', '', 'g') AS s FROM fp WHERE (item_id, folder_text) NOT IN (SELECT item_id, name FROM fo)),
d1 AS (SELECT *, length(s) AS n, TRY_CAST(substr(s, 1, 2) AS INT) AS a, TRY_CAST(substr(s, 3, 2) AS INT) AS b FROM dg WHERE length(s) BETWEEN 2 AND 7 AND regexp_matches(folder_text, '^[^0-9]*[0-9]+[^0-9]*$')),
d2 AS (SELECT item_id, depth, folder_text, s, CASE WHEN n = 4 AND CAST(s AS INT) BETWEEN 1900 AND 2100 THEN TRY_CAST(s || '-01-01' AS DATE) END AS c1, CASE WHEN n = 4 THEN TRY_CAST('2000-' || substr(s, 1, 2) || '-' || substr(s, 3, 2) AS DATE) END AS c2,
  CASE WHEN n = 4 THEN TRY_CAST(CAST(CASE WHEN a <= 30 THEN 2000 + a ELSE 1900 + a END AS STRING) || '-' || substr(s, 3, 2) || '-01' AS DATE) END AS c3 FROM d1),
tk AS (SELECT item_id, depth, folder_text, s, list_filter([c1, c2, c3], lambda x: x IS NOT NULL) AS c FROM d2),
tokens AS (SELECT item_id, depth, folder_text, s, c FROM tk WHERE len(c) > 0)"""

def _interpolate(sessions: str, key: str) -> str:
    return f"""{sessions},
i0 AS (SELECT m.*, 'u' || CAST(a.user_id AS STRING) || '/' || a.folder_name AS folder, coalesce(TRY_CAST(nullif(regexp_extract(a.stem, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT), 0) AS tail, d.final_datetime AS t, d.confidence AS c, CASE WHEN is_anchor THEN d.final_datetime ELSE a.mtime END AS by_time
  FROM members m JOIN album a USING (item_id) JOIN dated d USING (item_id)),
i1 AS (SELECT *, max(CASE WHEN is_anchor THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, session_idx, folder) AS wa FROM i0),
i2 AS (SELECT *, row_number() OVER (PARTITION BY {key}, session_idx ORDER BY wa DESC, folder, tail, is_anchor DESC, by_time, item_id) - 1 AS n FROM i1),
ia AS (SELECT {key}, session_idx, n, t, c, folder FROM i2 WHERE is_anchor),
ig AS (SELECT {key}, session_idx, count(*) AS na, min(n) AS n0, max(n) AS n1, arg_min(t, n) AS tf, arg_max(t, n) AS tl, min(t) AS t0, max(t) AS t1 FROM ia GROUP BY 1, 2),
i3 AS (SELECT i2.*, na, n0, n1, t0, t1, CASE WHEN na > 1 AND n1 <> n0 AND tl <> tf THEN date_diff('microsecond', tf, tl) / 1e6 / CAST(n1 - n0 AS DOUBLE) END AS scale FROM i2 JOIN ig USING ({key}, session_idx) WHERE NOT is_anchor),
i4 AS (SELECT *, CASE WHEN scale < 0 THEN CASE WHEN n1 > n THEN n1 END ELSE (SELECT max(ia.n) FROM ia WHERE ia.{key} = i3.{key} AND ia.session_idx = i3.session_idx AND ia.n < i3.n) END AS ln,
  CASE WHEN scale < 0 THEN CASE WHEN n0 < n THEN n0 END ELSE (SELECT min(ia.n) FROM ia WHERE ia.{key} = i3.{key} AND ia.session_idx = i3.session_idx AND ia.n > i3.n) END AS rn FROM i3),
i5 AS (SELECT i4.*, l.t AS lt, l.c AS lc, l.folder AS lf, r.t AS rt, r.c AS rc, r.folder AS rf, coalesce((i4.n - n0) * scale, CAST(i4.n AS DOUBLE)) AS x, coalesce((ln - n0) * scale, CAST(ln AS DOUBLE)) AS pl, coalesce((rn - n0) * scale, CAST(rn AS DOUBLE)) AS pr
  FROM i4 LEFT JOIN ia l ON l.{key} = i4.{key} AND l.session_idx = i4.session_idx AND l.n = ln LEFT JOIN ia r ON r.{key} = i4.{key} AND r.session_idx = i4.session_idx AND r.n = rn),
i6 AS (SELECT *, ln IS NOT NULL AND rn IS NOT NULL AS inner_, date_diff('microsecond', lt, rt) AS gap, coalesce(lt, rt) AS ot, coalesce(lc, rc) AS oc, coalesce(lf, rf) AS of_, coalesce(pl, pr) AS op, CASE WHEN na > 1 THEN date_diff('microsecond', t0, t1) / 1e6 / (na - 1) ELSE 60e0 END AS av FROM i5),
ip AS (SELECT item_id, CASE WHEN inner_ THEN lt + to_microseconds(CAST(round(gap * ((x - pl) / (pr - pl))) AS BIGINT)) ELSE ot END AS dt,
  CASE WHEN inner_ THEN CASE WHEN abs(gap / 1e6) / (pr - pl) < 3600 THEN 'minute' WHEN abs(gap / 1e6) / (pr - pl) < 86400 THEN 'hour' ELSE 'day' END ELSE 'day' END AS precision,
  CASE WHEN inner_ THEN round(greatest(0.1e0, least(0.85e0, least(lc, rc) * (1 - 0.6e0 * greatest(x - pl, pr - x) / (pr - pl)) + CASE WHEN folder = lf OR folder = rf THEN 0.1e0 ELSE 0e0 END)), 3)
  ELSE round(greatest(0.1e0, least(0.6e0, oc - 0.08e0 * (abs(x - op) / CASE WHEN av = 0 THEN 1e0 ELSE av END) + CASE WHEN folder = of_ THEN 0.1e0 ELSE 0e0 END)), 3) END AS confidence,
  CASE WHEN inner_ THEN 'inner' ELSE 'outer' END AS mode FROM i6)"""


INTERPOLATE = _interpolate(SESSIONS, "user_id")

_LABEL = "CASE " + " ".join(f"WHEN p = '{name}' AND k - start = {o} THEN 'B-{f}' WHEN p = '{name}' AND k - start > {o} AND k - start < {o + w} THEN 'I-{f}'" for name, fields in FIELD_WIDTH.items() for f, o, w in fields) + " ELSE 'O' END"
LABELS = f"""{EVIDENCE},
bp AS (SELECT item_id, arg_max(pattern_name, length(matched_text)) AS p, arg_max(matched_text, length(matched_text)) AS m FROM fn WHERE pattern_name IN ('DATETIME8_6', 'DATE8') GROUP BY 1),
lt AS (SELECT a.item_id AS id, stem, coalesce(p, '') AS p, coalesce(strpos(stem, m), 1) - 1 AS start FROM album a LEFT JOIN bp USING (item_id)),
lc AS (SELECT id, k, {_LABEL} AS label FROM (SELECT *, unnest(range(0, length(stem))) AS k FROM lt)),
sp AS (SELECT id, substr(label, 3) AS field, CAST(min(k) AS INT) AS begin, CAST(max(k) + 1 AS INT) AS "end" FROM lc WHERE label <> 'O' GROUP BY 1, 2)"""

SIGS = f"""{EVIDENCE},
tx AS MATERIALIZED (SELECT item_id, stem AS text FROM album UNION ALL SELECT item_id, folder_name FROM album UNION ALL SELECT item_id, 'u' || CAST(user_id AS STRING) FROM album UNION ALL SELECT item_id, 'album' FROM album),
tm0 AS MATERIALIZED ({_pattern_rows("tx", "text", "item_id, text")}),
cv AS (SELECT DISTINCT text FROM (SELECT text, first(precision ORDER BY {_ORDER}) AS precision FROM (SELECT DISTINCT text, k, precision, confidence FROM tm0) GROUP BY 1) WHERE {_RANK("precision")} >= 3),
sg AS (SELECT text, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x)) AS l, list_transform(list_filter(regexp_extract_all(regexp_replace(text, '^[^0-9]+|[^0-9]+$', '', 'g'), '[^0-9]+'), lambda x: regexp_matches(text, '[0-9]')), lambda x: CASE WHEN regexp_matches(x, '\\pL') THEN 'W' WHEN regexp_extract(x, '[-_./: ]') <> '' THEN regexp_extract(x, '[-_./: ]') ELSE '?' END) AS seps FROM tx WHERE text NOT IN (SELECT text FROM cv)),
sc AS (SELECT array_to_string(l, ',') || '|' || array_to_string(seps, ' ') AS sig, CAST(list_sum(l) AS INT) AS total, count(*) AS n FROM sg WHERE list_sum(l) >= 4 AND list_max(l) >= 4 GROUP BY 1, 2)"""


# the light date tests without look-arounds: neighbours are matched instead
LIGHT = "(" + " OR ".join(f"regexp_matches({{0}}, '{x}')" for x in (r.replace("(?<![0-9])", "(?:^|[^0-9])").replace("(?![0-9])", "(?:[^0-9]|$)").replace("(?![-_.0-9])", "(?:[^-_.0-9]|$)").replace("{", "{{").replace("}", "}}") for r in LIGHT_DATES)) + ")"


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


_FINEST = "CASE " + " ".join(f"WHEN list_contains(fs, '{f}') THEN '{f.lower()}'" for f in ("SECOND", "MINUTE", "HOUR", "DAY", "MONTH", "YEAR")) + " END"
_PART = lambda f, low: f"coalesce(max(CASE WHEN field = '{f}' THEN TRY_CAST(value AS INT) END), {low})"
TAGGED = f"""{LABELS},
tg AS (SELECT id, field, substr(stem, begin + 1, "end" - begin) AS value, 0.5e0 + (begin % 5) / 10 AS c FROM sp JOIN lt USING (id)),
td0 AS (SELECT id, list(field) AS fs, avg(c) AS mean, {_PART("YEAR", 0)} AS y, {_PART("MONTH", 1)} AS mo, {_PART("DAY", 1)} AS d, {_PART("HOUR", 0)} AS h, {_PART("MINUTE", 0)} AS mi, {_PART("SECOND", 0)} AS s FROM tg GROUP BY id),
td AS (SELECT id, CAST(len(fs) AS INT) AS n_fields, {_FINEST} AS precision, CASE WHEN y BETWEEN 1900 AND 2100 THEN TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, h, mi, s) AS TIMESTAMP) END AS dt, round(0.9e0 * mean, 4) AS confidence FROM td0)"""
SEGMENTS = f"""{RESOLVED},
sg0 AS (SELECT item_id, exif_original, confidence, 'stem' AS source, stem AS text FROM album LEFT JOIN (SELECT item_id, confidence FROM resolved) USING (item_id) UNION ALL
  SELECT item_id, exif_original, confidence, 'folder', f FROM (SELECT a.*, r.confidence, unnest([folder_name, 'u' || CAST(user_id AS STRING)]) AS f FROM album a LEFT JOIN resolved r USING (item_id))),
sgx AS MATERIALIZED (SELECT DISTINCT text AS t FROM sg0),
sgm AS MATERIALIZED ({_pattern_rows("sgx", "t", "t")}),
sga AS (SELECT s.*, (SELECT count(*) FROM sgm WHERE t = s.text AND dt IS NOT NULL) AS n_m FROM (SELECT *, row_number() OVER () AS rid FROM sg0) s),
sgp AS (SELECT DISTINCT rid FROM sga JOIN sgm ON t = text AND year(dt) = year(exif_original) AND ({_RANK("precision")} < 2 OR month(dt) = month(exif_original)) AND ({_RANK("precision")} < 3 OR day(dt) = day(exif_original)))"""
_GROUPED_ROWS = """hk AS MATERIALIZED (SELECT *, CASE WHEN sha1 = '' THEN 'nosha1_' || CAST(id AS STRING) ELSE sha1 END AS key FROM hx),
hr AS MATERIALIZED (SELECT key, min(id) AS first, arg_min(h, id) AS h FROM hk GROUP BY 1)"""
GROUPED = """hx AS MATERIALIZED (SELECT vec_id AS id, h, CASE WHEN vec_id % 9 = 0 THEN '' WHEN vec_id % 4 = 0 THEN sha1('c' || CAST(vec_id - vec_id % 20 AS STRING)) ELSE sha1('e' || CAST(vec_id AS STRING)) END AS sha1 FROM embeddings JOIN hs ON hs.id = vec_id),
""" + _GROUPED_ROWS
_GROUPED = lambda named: f"{named}, gm AS MATERIALIZED (SELECT id, sha1, g.group_id FROM hk JOIN gn g USING (key)), gg AS MATERIALIZED (SELECT id, group_id, kind FROM gm JOIN (SELECT group_id, CASE WHEN count(DISTINCT nullif(sha1, '')) = 1 THEN 'sha1' ELSE 'phash' END AS kind FROM gm GROUP BY 1 HAVING count(*) > 1) USING (group_id))"
BY_SHA1 = HASH + "," + GROUPED + "," + _GROUPED("gn AS MATERIALIZED (SELECT key, first AS group_id FROM hr)")
_NEAR = """, pe AS MATERIALIZED (SELECT a.first AS a, b.first AS b FROM hr a JOIN hr b ON a.first <> b.first AND bit_count(xor(a.h, b.h)) <= 16), pc AS (SELECT a, b FROM pe UNION SELECT pc.a, pe.b FROM pc JOIN pe ON pc.b = pe.a),""" + _GROUPED("gn AS MATERIALIZED (SELECT key, coalesce(least(first, (SELECT min(b) FROM pc WHERE a = first)), first) AS group_id FROM hr)")
BY_PHASH = HASH + "," + GROUPED + _NEAR
_ALIKE = f"""{_SCORES}, {HASH}, hx AS MATERIALIZED (SELECT event_id AS id, hs.h, coalesce(sha1, '') AS sha1 FROM album LEFT JOIN hs ON hs.id = event_id), {_GROUPED_ROWS}{_NEAR},
rd AS MATERIALIZED (SELECT item_id, CAST(group_id AS STRING) AS group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY score DESC, filesize DESC, relpath, event_id) - 1 AS INT) AS dup_rank, kind, FALSE AS needs_review FROM gg JOIN scored ON id = event_id)"""
PLAN_PHASH = _plan(_ALIKE + ", dups AS (SELECT * FROM rd)")
PLAN_CLIP = _plan(_ALIKE + f""", {COS}, dups AS (SELECT * FROM rd UNION ALL SELECT DISTINCT item_id, '', -1, 'clip', TRUE FROM cs JOIN album ON event_id = query_id WHERE score >= 0.35 AND query_id NOT IN (SELECT id FROM gg) AND vec_id NOT IN (SELECT id FROM gg) AND vec_id IN (SELECT event_id FROM album))""")


_ENDS = "CASE total " + " ".join(f"WHEN {n} THEN {[sum(f[: k + 1]) for k in range(len(f))]}" for n, f in FIELDS.items()) + " END"
_PRECISION = "CASE total " + " ".join(f"WHEN {n} THEN '{p}'" for n, p in PRECISION.items()) + " END"
_BASE = "CASE total " + " ".join(f"WHEN {n} THEN {BASE[p]}e0" for n, p in PRECISION.items()) + " END"
_SEPARATOR = "CASE seps[k] WHEN 'W' THEN '[^0-9]+' WHEN '?' THEN '[^0-9]?' ELSE '[' || regexp_replace(seps[k], '([-. ])', '\\\\\\1') || ']' END"
_STAMP = " || ".join(f"CASE WHEN length(d) >= {a + n - 1} THEN '{sep}' || substr(d, {a}, {n}) ELSE '{sep}{low}' END" for a, n, sep, low in ((1, 4, "", ""), (5, 2, "-", "01"), (7, 2, "-", "01"), (9, 2, " ", "00"), (11, 2, ":", "00"), (13, 2, ":", "00")))
MINED = f"""{SIGS},
m0 AS MATERIALIZED (SELECT array_to_string(l, ',') || '|' || array_to_string(seps, ' ') AS sig, any_value(l) AS l, any_value(seps) AS seps, CAST(list_sum(any_value(l)) AS INT) AS total, count(*) AS n FROM sg WHERE list_sum(l) >= 4 AND list_max(l) >= 4 GROUP BY 1),
m1 AS (SELECT *, sum(n) OVER (PARTITION BY total) AS gt, list_transform(range(1, len(l) + 1), lambda k: list_sum(l[1:k])) AS cum, {_ENDS} AS ends FROM m0),
m2 AS MATERIALIZED (SELECT *, array_to_string(list_transform(range(1, len(l) + 1), lambda k: array_to_string(list_transform(list_filter(range(1, len(ends) + 1), lambda i: ends[i] > CASE WHEN k = 1 THEN 0 ELSE cum[k - 1] END AND ends[i] <= cum[k]), lambda i: '(' || {RANGES}[i] || ')'), '') || CASE WHEN k <= len(seps) THEN {_SEPARATOR} ELSE '' END), '') AS core
  FROM m1 WHERE (n >= CASE WHEN total >= 12 THEN 2 WHEN total >= 8 THEN 3 WHEN total >= 6 THEN 4 ELSE 5 END OR (gt >= 5 AND n >= 2)) AND ends IS NOT NULL AND len(seps) = len(l) - 1 AND len(list_filter(cum, lambda c: NOT list_contains(ends, c))) = 0),
m3 AS (SELECT sig, core, text, regexp_replace(text, '[^0-9]', '', 'g') AS d, row_number() OVER (PARTITION BY sig ORDER BY sha1(text)) AS k FROM (SELECT DISTINCT text, array_to_string(l, ',') || '|' || array_to_string(seps, ' ') AS sig FROM sg) JOIN m2 USING (sig)),
m4 AS (SELECT sig, avg(CASE WHEN regexp_matches(text, '(?:^|[^0-9])' || core || '(?:[^0-9]|$)') AND TRY_CAST({_STAMP} AS TIMESTAMP) IS NOT NULL THEN 1e0 ELSE 0e0 END) AS rate FROM m3 WHERE k <= 50 GROUP BY 1),
m5 AS (SELECT 'MINED_' || array_to_string(l, '_') || '_' || {_PRECISION} AS name, core, {_PRECISION} AS precision, round(least(least({_BASE} + CASE WHEN len(l) >= 3 AND len(ends) >= 3 THEN 0.05e0 ELSE 0e0 END, 0.89e0) + 0.05e0 * (rate - 0.75e0), 0.89e0), 4) AS confidence, row_number() OVER (ORDER BY n DESC, sig) AS r FROM m2 JOIN m4 USING (sig) WHERE rate >= 0.75 ORDER BY n DESC, sig LIMIT 20)"""



def _mined_rows(source: str, text: str, carry: str) -> str:
    return f"""SELECT {carry}, 100 + r AS k, pattern_name, precision, confidence, matched_text, TRY_CAST({_STAMP} AS TIMESTAMP) AS dt FROM (SELECT *, regexp_replace(matched_text, '[^0-9]', '', 'g') AS d
  FROM (SELECT {carry}, r, m5.name AS pattern_name, precision, confidence, regexp_extract({text}, '(?:^|[^0-9])(' || core || ')(?:[^0-9]|$)', 1) AS matched_text FROM {source}, m5) WHERE matched_text <> '')"""


RESOLVED_MINED = f"""{MINED},
fx0 AS (SELECT * FROM fn0 UNION ALL {_mined_rows("live", "stem", "item_id")}),
fx AS (SELECT item_id, CAST(99 + row_number() OVER (PARTITION BY item_id ORDER BY {_ORDER}) AS INT) AS ev_seq, 'filename' AS source, dt, precision, confidence, TRUE AS is_direct FROM fx0 WHERE dt IS NOT NULL),
fy0 AS (SELECT * FROM fo0 UNION ALL {_mined_rows("(SELECT item_id, depth, name AS folder FROM levels)", "folder", "item_id, depth, folder")}),
fy AS (SELECT item_id, CAST(1000 * (depth + 1) - 1 + row_number() OVER (PARTITION BY item_id, depth ORDER BY {_ORDER}) AS INT) AS ev_seq, 'foldername' AS source, dt, CASE WHEN {_RANK("precision")} > 3 THEN 'day' ELSE precision END AS precision,
  round(confidence * {FOLDER_DISCOUNT}e0 * CASE depth WHEN 0 THEN {FOLDER_DECAY[0]}e0 WHEN 1 THEN {FOLDER_DECAY[1]}e0 ELSE {FOLDER_DECAY[2]}e0 END, 3) AS confidence, FALSE AS is_direct FROM fy0 WHERE dt IS NOT NULL),
ev2 AS MATERIALIZED (SELECT * FROM ex UNION ALL SELECT * FROM fs UNION ALL SELECT * FROM fx UNION ALL SELECT * FROM fy),{_resolve("ev2")}"""


def sql() -> dict[str, str]:
    cols = "item_id, ev_seq, source, dt, precision, confidence, is_direct"
    return {
        "album_items": _with(ALBUM, f"SELECT item_id, relpath, stem, ext, filesize, format_real, ({SHOTS}) AS is_screenshot FROM album"),
        "exif_evidence": _with(EVIDENCE, f"SELECT {cols} FROM ex"),
        "filesystem_evidence": _with(EVIDENCE, f"SELECT {cols} FROM fs"),
        "filename_evidence": _with(EVIDENCE, f"SELECT {cols} FROM fn"),
        "foldername_evidence": _with(EVIDENCE, f"SELECT {cols} FROM fo"),
        "evidence_union": _with(EVIDENCE, "SELECT source, precision, is_direct, count(*) AS n, min(dt) AS first_dt, max(dt) AS last_dt FROM ev GROUP BY 1, 2, 3"),
        "resolve_time": _with(RESOLVED, "SELECT * FROM resolved"),
        "time_interval": _with(RESOLVED, "SELECT item_id, precision, range_start, range_end FROM resolved"),
        "conflict_report": _with(RESOLVED, "SELECT primary_source, n_conflicts, count(*) AS items FROM resolved WHERE n_conflicts > 0 GROUP BY 1, 2"),
        "resolve_orders": _with(ORDERS, "SELECT item_id, final_datetime, primary_source, source_summary, n_conflicts FROM resolved"),
        "exact_dups": "SELECT sha1(text) AS sha1, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "dup_rank": _with(SCORED, "SELECT * EXCLUDE needs_review FROM dups"),
        "group_kinds": _with(ALBUM, "SELECT ext || CAST(event_id % 50 AS STRING) AS group_id, count(*) AS n, CASE WHEN count(DISTINCT nullif(sha1, '')) = 1 THEN 'sha1' ELSE 'phash' END AS kind FROM album GROUP BY 1"),
        "hamming_pairs": _with(HASH, "SELECT * FROM hp"),
        "near_dup_groups": _with(HASH + ", ed AS (SELECT id_a AS a, id_b AS b FROM hp UNION SELECT id_b, id_a FROM hp), rc AS (SELECT a, b FROM ed UNION SELECT rc.a, ed.b FROM rc JOIN ed ON rc.b = ed.a)", "SELECT a AS id, least(a, min(b)) AS group_id FROM rc GROUP BY a"),
        "cosine_pairs": _with(COS, "SELECT query_id AS id_a, vec_id AS id_b, score FROM cs WHERE query_id < vec_id AND score >= 0.35"),
        "knn_topk": _with(KNN, "SELECT * FROM nn"),
        "similar_lend": _with(KNN + ", kn AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(vec_id % 365 AS INT)) END AS t, CASE WHEN vec_id % 3 <> 0 THEN 0.5e0 + (vec_id % 5) / 10 END AS c FROM embeddings)",
            "SELECT n.query_id AS item_id, n.vec_id AS related_id, l.t AS dt, CASE WHEN score >= 0.98 THEN 0.75e0 WHEN score >= 0.95 THEN 0.65e0 WHEN score >= 0.90 THEN 0.55e0 WHEN score >= 0.85 THEN 0.45e0 ELSE 0.40e0 END AS confidence, score AS cosine FROM nn n JOIN kn q ON q.id = n.query_id AND (q.t IS NULL OR q.c < 0.6) JOIN kn l ON l.id = n.vec_id AND l.t IS NOT NULL AND l.c >= 0.6"),
        "sessions_by_user": "WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 21600000000 THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS session_idx FROM g) SELECT user_id, session_idx, count(*) AS n, min(ts) AS time_start, max(ts) AS time_end FROM s GROUP BY 1, 2",
        "session_stats": _with(SESSIONS, "SELECT user_id, session_idx, time_start, time_end, n_anchors, year_candidates, first_folder FROM st"),
        "session_assign": _with(SESSIONS, "SELECT * FROM members"),
        "folder_prefix": _with(SESSIONS, "SELECT m.user_id, session_idx, count(*) AS n_items, 'u' || CAST(m.user_id AS STRING) || CASE WHEN count(DISTINCT folder_name) = 1 THEN '/' || min(folder_name) ELSE '' END AS folder_path FROM members m JOIN album USING (item_id) GROUP BY 1, 2"),
        "struct_tokens": _with(TOKENS, "SELECT item_id, folder_text, depth, len(c) AS n_candidates, array_to_string(list_transform(c, lambda x: strftime(x, '%Y-%m-%d')), ',') AS dates FROM tokens"),
        "struct_resolve": _with(TOKENS + """, t0 AS (SELECT t.*, years, y0, time_start, time_end, n_anchors FROM tokens t JOIN members USING (item_id) LEFT JOIN st USING (user_id, session_idx) WHERE len(c) > 1),
            t1 AS (SELECT *, list_filter(c, lambda x: year(x) = 2000 OR coalesce(list_contains(years, year(x)), FALSE)) AS f FROM t0), t2 AS (SELECT *, CASE WHEN y0 IS NOT NULL AND len(f) > 0 THEN f ELSE c END AS c1 FROM t1),
            t3 AS (SELECT *, list_filter(c1, lambda x: year(x) = 2000 OR (month(x) - month(time_start) + 12) % 12 IN (0, 1, 11) OR (month(x) - month(time_end) + 12) % 12 IN (0, 1, 11)) AS f2 FROM t2), t4 AS (SELECT *, CASE WHEN len(c1) > 1 AND time_start IS NOT NULL AND len(f2) > 0 THEN f2 ELSE c1 END AS c2 FROM t3),
            t5 AS (SELECT *, CASE WHEN y0 IS NULL THEN c2 ELSE list_transform(c2, lambda x: CASE WHEN year(x) = 2000 THEN coalesce(TRY_CAST(CAST(y0 AS STRING) || strftime(x, '-%m-%d') AS DATE), x) ELSE x END) END AS c3 FROM t4),
            t6 AS (SELECT *, len(list_distinct(c3)) AS n, len(list_distinct(list_transform(c3, lambda x: year(x)))) = 1 AS y, len(list_distinct(list_transform(c3, lambda x: month(x)))) = 1 AS mo, len(list_distinct(list_transform(c3, lambda x: day(x)))) = 1 AS d, len(list_filter(c, lambda x: year(x) = 2000)) > 0 AS ph FROM t5),
            t7 AS (SELECT item_id, folder_text, CASE WHEN n = 1 OR (y AND mo AND d) THEN CAST(c3[1] AS TIMESTAMP) WHEN y AND mo THEN CAST(date_trunc('month', c3[1]) AS TIMESTAMP) WHEN y THEN CAST(date_trunc('year', c3[1]) AS TIMESTAMP) END AS dt,
            CASE WHEN n = 1 THEN CASE WHEN ph OR length(s) >= 6 OR (length(s) = 4 AND day(c3[1]) > 1) THEN 'day' WHEN length(s) = 4 THEN 'month' ELSE 'year' END WHEN y AND mo AND d THEN 'day' WHEN y AND mo THEN 'month' WHEN y THEN 'year' END AS precision,
            round(greatest(0.1e0, least(0.85e0, CASE WHEN n = 1 THEN 0.5e0 ELSE 0.3e0 END + CASE WHEN len(c1) < len(c) THEN 0.1e0 ELSE 0e0 END + CASE WHEN len(c2) < len(c1) THEN 0.1e0 ELSE 0e0 END + least(0.05e0 * coalesce(n_anchors, 0), 0.2e0) - 0.1e0 * depth)), 3) AS confidence FROM t6)""",
            "SELECT * FROM t7 WHERE dt IS NOT NULL AND confidence >= 0.25"),
        "interpolate": _with(INTERPOLATE, "SELECT * FROM ip"),
        "interpolate_wide": _with(INTERPOLATE, "SELECT * FROM ip"),
        "sessions_global": "WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (ORDER BY ts, event_id), ts) > 450000000 THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, CAST(sum(new) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS session_idx FROM g) SELECT session_idx, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS time_start, max(ts) AS time_end FROM s GROUP BY 1",
        "session_album": _with(ALBUM_SESSIONS, "SELECT item_id, session_idx, is_anchor FROM members"),
        "interpolate_album": _with(_interpolate(ALBUM_SESSIONS, "whole"), "SELECT * FROM ip"),
        "digit_signatures": _with(SIGS, "SELECT sig, total, n, CAST(sum(n) OVER (PARTITION BY total) AS BIGINT) AS group_total FROM sc"),
        "export_plan": _with(PLAN, "SELECT * FROM plan"),
        "export_plan_phash": _with(PLAN_PHASH, "SELECT * FROM plan"),
        "export_plan_clip": _with(PLAN_CLIP, "SELECT * FROM plan"),
        "bucket_counts": _with(PLAN, "SELECT bucket, count(*) AS n FROM plan GROUP BY 1"),
        "kept_backfill": _with(PLAN, "SELECT item_id, duplicate_group_id, duplicate_rank, duplicate_kept_relpath FROM kept WHERE duplicate_rank > 0"),
        "review_notes": _with(PLAN, NOTES),
        "latest_status": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1",
        "incremental_scan": _with(ALBUM, "SELECT item_id, relpath FROM album a WHERE NOT EXISTS (SELECT 1 FROM album c WHERE c.event_id % 3 <> 0 AND c.relpath = a.relpath AND c.filesize = a.filesize AND c.mtime = a.mtime)"),
        "profile_depth": "SELECT CAST(len(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')) - 1 AS INT) AS depth, count(*) AS n FROM pages GROUP BY 1",
        "profile_conf_hist": _with(RESOLVED, "SELECT CASE WHEN confidence >= 0.9 THEN '>=0.9' WHEN confidence >= 0.7 THEN '0.7-0.9' WHEN confidence >= 0.5 THEN '0.5-0.7' WHEN confidence >= 0.3 THEN '0.3-0.5' ELSE '<0.3' END AS bucket, count(*) AS n FROM resolved GROUP BY 1"),
        "profile_charclass": _with(ALBUM, "SELECT CASE WHEN regexp_matches(c, '[0-9]') THEN 'digit' WHEN regexp_matches(c, '[A-Za-z]') THEN 'latin' WHEN unicode(c) BETWEEN 19968 AND 40959 THEN 'han' WHEN c IN ('_', '-', '.', ' ', '/', ':') THEN 'separator' ELSE 'other' END AS char_class, count(*) AS n FROM (SELECT unnest(string_split(stem, '')) AS c FROM album) WHERE c <> '' GROUP BY 1"),
        "profile_coverage": _with(EVIDENCE, "SELECT source, count(DISTINCT item_id) AS items, (SELECT count(*) FROM album) AS n_items FROM ev GROUP BY 1"),
        "profile_percentiles": _with(ALBUM, "SELECT v[least(CAST(floor(len(v) * p / 100) AS BIGINT), len(v) - 1) + 1] AS value, p FROM (SELECT list(filesize ORDER BY filesize) AS v FROM album), (SELECT unnest([95, 50]) AS p)"),
        "profile_ext": _with(ALBUM, "SELECT ext, count(*) AS n FROM album GROUP BY 1"),
        "profile_length": _with(ALBUM, "SELECT CASE WHEN l <= 4 THEN '0-4' WHEN l <= 8 THEN '5-8' WHEN l <= 12 THEN '9-12' WHEN l <= 16 THEN '13-16' WHEN l <= 24 THEN '17-24' WHEN l <= 32 THEN '25-32' WHEN l <= 48 THEN '33-48' WHEN l <= 64 THEN '49-64' ELSE '65+' END AS bucket, count(*) AS n FROM (SELECT length(stem) AS l FROM album) GROUP BY 1"),
        "light_dates": _with(ALBUM, f"SELECT {LIGHT.format('stem')} AS has_date, count(*) AS n FROM album GROUP BY 1"),
        "top_folders": _with(ALBUM, "SELECT folder_name AS folder, count(*) AS n FROM album GROUP BY 1 ORDER BY n DESC, folder LIMIT 20"),
        "run_summary": _with(RESOLVED, "SELECT count(*) AS total, count(final_datetime) AS resolved, count(exif_original) AS has_exif, count(*) FILTER (WHERE exif_original IS NULL) AS no_exif, count(*) FILTER (WHERE coalesce(confidence < 0.6, TRUE)) AS low_confidence, count(*) FILTER (WHERE n_conflicts > 0) AS conflicts FROM album LEFT JOIN resolved USING (item_id)"),
        "bio_labels": _with(LABELS, "SELECT id, string_agg(label, ' ' ORDER BY k) AS labels FROM lc GROUP BY 1"),
        "bio_spans": _with(LABELS, "SELECT * FROM sp"),
        "span_prf": _with(LABELS + """, pd AS (SELECT id, field, begin, CASE WHEN id < '4' THEN "end" + 1 ELSE "end" END AS "end" FROM sp WHERE field <> 'SECOND'),
            bo AS (SELECT field, count(*) FILTER (WHERE p AND g) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM (SELECT *, TRUE AS p FROM pd) FULL JOIN (SELECT *, TRUE AS g FROM sp) USING (id, field, begin, "end") GROUP BY 1),
            b2 AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM bo)""", "SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-9) AS f1 FROM b2"),
        "char_vocab": _with(ALBUM, "SELECT c AS char, n, CAST(row_number() OVER (ORDER BY n DESC, c) + 1 AS INT) AS id FROM (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(stem, '')) AS c FROM album) WHERE c <> '' GROUP BY 1)"),
        "label_weights": _with(LABELS + ", lw AS (SELECT label, count(*) AS n FROM lc GROUP BY 1)", "SELECT label, n, CASE WHEN label = 'O' THEN 1e0 ELSE round(greatest(1e0, least(5e0, (SELECT sum(n) FROM lw) / ((SELECT count(*) FROM lw) * n))), 6) END AS weight FROM lw"),
        "livephoto_entry": _with(ALBUM + ", en AS (SELECT 'a' || CAST(event_id % 40 AS STRING) AS archive, CASE WHEN event_id % 3 = 0 THEN '__' ELSE '' END || filename AS name FROM album), er AS (SELECT *, list_position(['heic', 'heif', 'jpg', 'jpeg', 'png'], lower(regexp_extract(name, '\\.([^./]*)$', 1))) AS r FROM en)", "SELECT archive, arg_min(name, (r, name)) AS name FROM er WHERE r > 0 AND NOT starts_with(name, '__') GROUP BY 1"),
        "session_summary": _with(SESSIONS, "SELECT m.user_id, session_idx, count(*) AS n_items, count(*) FILTER (WHERE final_datetime IS NULL) AS n_unresolved, count(*) FILTER (WHERE confidence < 0.6 AND final_datetime IS NOT NULL) AS n_weak, coalesce(date_diff('microsecond', min(final_datetime) FILTER (WHERE is_anchor), max(final_datetime) FILTER (WHERE is_anchor)) / 1e6, 0e0) AS seconds, bool_or(is_anchor) AS has_anchor FROM members m JOIN dated d USING (item_id) GROUP BY 1, 2"),
        "path_profile": _with(ALBUM, "SELECT CAST(len(string_split(relpath, '/')) AS INT) AS depth, count(*) AS n, round(avg(length(stem)), 3) AS mean_length, CAST(max(length(stem)) AS INT) AS max_length, count(DISTINCT stem) AS stems FROM album GROUP BY 1"),
        "exif_quality": _with(RESOLVED, "SELECT count(exif_original) AS original, count(coalesce(exif_original, exif_digitized)) AS any_time, count(*) FILTER (WHERE coalesce(exif_original, exif_digitized) IS NULL) AS no_exif, count(*) FILTER (WHERE exif_original IS NOT NULL AND confidence >= 0.9) AS sure, count(*) FILTER (WHERE source_summary = 'filesystem') AS filesystem_only FROM album LEFT JOIN resolved USING (item_id)"),
        "date_coverage": _with(ALBUM + f", dc AS (SELECT item_id, {LIGHT.format('stem')} AS a, {LIGHT.format('folder_name')} AS b FROM album)", "SELECT 'segment' AS level, d AS dated, count(*) AS n FROM (SELECT unnest([a, b, FALSE]) AS d FROM dc) GROUP BY 1, 2 UNION ALL SELECT 'item', a OR b, count(*) FROM dc GROUP BY 1, 2"),
        "overall_scores": _with(LABELS + """, pd AS (SELECT id, field, begin, CASE WHEN id < '4' THEN "end" + 1 ELSE "end" END AS "end" FROM sp WHERE field <> 'SECOND' AND id < 'f'),
            bo AS (SELECT count(*) FILTER (WHERE p AND g) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM (SELECT *, TRUE AS p FROM pd) FULL JOIN (SELECT *, TRUE AS g FROM sp) USING (id, field, begin, "end")),
            cf2 AS (SELECT id IN (SELECT id FROM pd) AS p, id IN (SELECT id FROM sp) AS g FROM lt), cl AS (SELECT count(*) FILTER (WHERE p AND g) AS clf_tp, count(*) FILTER (WHERE p AND NOT g) AS clf_fp, count(*) FILTER (WHERE NOT p AND g) AS clf_fn, count(*) FILTER (WHERE NOT p AND NOT g) AS clf_tn FROM cf2),
            b2 AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM bo, cl)""", "SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-9) AS f1 FROM b2"),
        "exact_dates": _with(LABELS + """, gs AS (SELECT id, list_sort(list(field || ':' || begin || ':' || "end")) AS s FROM sp WHERE field IN ('YEAR', 'MONTH', 'DAY') GROUP BY id HAVING count(DISTINCT field) = 3),
            ps AS (SELECT id, list_sort(list(field || ':' || begin || ':' || CASE WHEN id < '4' THEN "end" + 1 ELSE "end" END)) AS p FROM sp WHERE field IN ('YEAR', 'MONTH', 'DAY') AND (field <> 'DAY' OR id < 'e') GROUP BY id)""", "SELECT count(*) AS total, count(*) FILTER (WHERE s = p) AS correct, round(count(*) FILTER (WHERE s = p) / greatest(count(*), 1), 4) AS accuracy FROM gs LEFT JOIN ps USING (id)"),
        "mined_patterns": _with(MINED, "SELECT * EXCLUDE r FROM m5"),
        "resolve_mined": _with(RESOLVED_MINED, "SELECT * FROM resolved"),
        "tagger_dates": _with(TAGGED, "SELECT * FROM td"),
        "tagger_evidence": _with(TAGGED + ", te AS (SELECT *, CASE WHEN id < '8' THEN 1e0 WHEN id < 'a' THEN 0.85e0 WHEN id < 'c' THEN 0.85e0 * 0.85e0 ELSE 0.85e0 * 0.7e0 END AS w, id < '8' AS stem FROM td)",
            "SELECT id AS item_id, CASE WHEN stem THEN 'filename' ELSE 'foldername' END AS source, dt, CASE WHEN NOT stem AND precision IN ('hour', 'minute', 'second') THEN 'day' ELSE precision END AS precision, round(least(confidence * w * 0.95e0, 0.82e0), 3) AS confidence, stem AS is_direct FROM te WHERE least(confidence * w * 0.95e0, 0.82e0) >= 0.3"),
        "char_ids": _with(ALBUM + ", cu AS (SELECT item_id, k, c FROM (SELECT item_id, unnest(string_split(stem, '')) AS c, generate_subscripts(string_split(stem, ''), 1) AS k FROM album) WHERE c <> ''), cn AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) + 1 AS id FROM cu GROUP BY c HAVING count(*) >= 500)",
            "SELECT item_id, string_agg(CAST(coalesce(id, 1) AS STRING), ' ' ORDER BY k) AS ids FROM cu LEFT JOIN cn USING (c) GROUP BY 1"),
        "tag_errors": _with(LABELS + """, gu AS (SELECT id, field, begin, CASE WHEN id < '4' THEN "end" + 1 ELSE "end" END AS "end" FROM sp WHERE field <> 'SECOND' AND id < 'f'),
            ee AS (SELECT 'ner_FP:' || string_agg(field, ',' ORDER BY field) AS type FROM (SELECT * FROM gu EXCEPT SELECT * FROM sp) GROUP BY id UNION ALL SELECT 'ner_FN:' || string_agg(field, ',' ORDER BY field) FROM (SELECT * FROM sp EXCEPT SELECT * FROM gu) GROUP BY id
            UNION ALL SELECT 'clf_FN' FROM (SELECT DISTINCT id FROM sp WHERE id NOT IN (SELECT id FROM gu)))""", "SELECT type, count(*) AS n FROM ee GROUP BY 1"),
        "label_shares": "WITH x AS (SELECT vec_id, list_transform(embedding[1:4], lambda v: exp(4e0 * CAST(v AS DOUBLE) - 4e0 * list_max(list_transform(embedding[1:4], lambda w: CAST(w AS DOUBLE))))) AS e FROM embeddings WHERE vec_id < 200) SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INT) AS best, round(list_max(e) / list_sum(e), 6) AS share FROM x",
        "segment_samples": _with(SEGMENTS, "SELECT source, CASE WHEN length(text) > 24 THEN 'toolong' WHEN n_m = 0 THEN 'neg' WHEN exif_original IS NULL OR coalesce(confidence, 0) < 0.85 THEN 'no_conf' WHEN rid IN (SELECT rid FROM sgp) THEN 'pos' ELSE 'noise' END AS status, count(*) AS n FROM sga GROUP BY 1, 2"),
        "segment_counts": _with(SEGMENTS, f"SELECT *, round(neg / nullif(pos, 0), 1) AS ratio FROM (SELECT count(*) FILTER (WHERE d AND s) AS pos, count(*) FILTER (WHERE d AND NOT s) AS ambiguous, count(*) FILTER (WHERE NOT d) AS neg FROM (SELECT {LIGHT.format('text')} AS d, exif_original IS NOT NULL AND coalesce(confidence, 0) >= 0.9 AS s FROM sg0))"),
        "select_intervals": """WITH x AS (SELECT l_orderkey, l_linenumber AS line, l_linenumber % 3 AS r, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS b, CAST(l_quantity AS INT) AS q FROM lineitem),
            y AS (SELECT l_orderkey, list([{'b': b, 'e': b + q, 'line': line}] ORDER BY r DESC, q DESC, b, line) AS xs FROM x GROUP BY 1),
            z AS (SELECT l_orderkey, list_reduce(xs, lambda a, v: CASE WHEN len(list_filter(a, lambda k: k.b < v[1].e AND v[1].b < k.e)) = 0 THEN list_concat(a, v) ELSE a END) AS k FROM y)
            SELECT l_orderkey, CAST(len(k) AS INT) AS n_kept, array_to_string(list_sort(list_transform(k, lambda v: CAST(v.line AS STRING))), ',') AS lines FROM z""",
        "checkpoint_restore": _with(ALBUM, """SELECT item_id, CASE WHEN event_id % 3 <> 0 THEN CASE WHEN unsupported THEN 'UNSUPPORTED' ELSE '' END WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'NO_EXIF' ELSE '' END ELSE 'OLD' END AS flags,
            CASE WHEN event_id % 3 <> 0 THEN '' WHEN event_id % 2 = 0 THEN 'scan,exif' ELSE 'scan' END AS stages, CASE WHEN event_id % 3 <> 0 OR (event_id % 2 = 0 AND event_id % 5 = 0) THEN sha1 WHEN event_id % 2 = 0 THEN 's' || CAST(event_id AS STRING) ELSE 'stale' END AS sha1,
            CAST(CASE WHEN event_id % 3 <> 0 OR (event_id % 2 = 0 AND event_id % 7 = 0) THEN width WHEN event_id % 2 = 0 THEN event_id % 7 ELSE 1 END AS INT) AS width FROM album"""),
        "snapshot_stats": _with(RESOLVED + ", sn AS (SELECT a.*, r.final_datetime, r.n_conflicts FROM album a LEFT JOIN resolved r USING (item_id))", " UNION ALL ".join(f"SELECT '{k}' AS kind, '{v}' AS name, count(*) AS n FROM sn WHERE {c}" for k, v, c in (("total", "total", "TRUE"), ("total", "resolved", "final_datetime IS NOT NULL"), ("total", "has_exif", "exif_original IS NOT NULL"), ("total", "has_clip", "event_id % 4 = 0"), ("flag", "UNSUPPORTED", "unsupported"), ("flag", "NO_EXIF", "exif_original IS NULL"), ("flag", "CONFLICT_TIME", "n_conflicts > 0"), ("stage", "scan", "TRUE"), ("stage", "exif", "NOT unsupported")))),
        "json_rows": _with(ALBUM, """SELECT '{"item_id":"' || item_id || '","relpath":"' || relpath || '","filesize":' || CAST(filesize AS STRING) || '}' AS json FROM album"""),
        "before_after": _with(INTERPOLATE, "SELECT count(*) FILTER (WHERE final_datetime IS NULL) AS newly, count(*) FILTER (WHERE final_datetime IS NOT NULL AND confidence < 0.6) AS boosted FROM dated WHERE item_id IN (SELECT item_id FROM ip)"),
        "timeline_spread": _with(INTERPOLATE, "SELECT precision, CASE WHEN confidence >= 0.6 THEN '>=0.6' WHEN confidence >= 0.4 THEN '0.4~0.6' ELSE '<0.4' END AS bin, count(*) AS n FROM ip GROUP BY 1, 2"),
        "confidence_bins": _with(RESOLVED, "SELECT CASE WHEN confidence >= 0.9 THEN '>=0.9' WHEN confidence >= 0.7 THEN '0.7~0.9' WHEN confidence >= 0.5 THEN '0.5~0.7' ELSE '<0.5' END AS bin, count(*) AS n FROM resolved GROUP BY 1"),
        "reresolve": _with(KNN + """, kn AS MATERIALIZED (SELECT vec_id AS id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(vec_id % 365 AS INT)) AS t, 0.5e0 + (vec_id % 5) / 10 AS c FROM embeddings WHERE vec_id % 3 <> 0),
            le AS MATERIALIZED (SELECT n.query_id AS item_id, CAST(9000 + row_number() OVER (PARTITION BY n.query_id ORDER BY score DESC, n.vec_id) AS INT) AS ev_seq, 'similar' AS source, l.t AS dt, 'day' AS precision, CASE WHEN score >= 0.98 THEN 0.75e0 WHEN score >= 0.95 THEN 0.65e0 WHEN score >= 0.90 THEN 0.55e0 WHEN score >= 0.85 THEN 0.45e0 ELSE 0.40e0 END AS confidence, FALSE AS is_direct
              FROM nn n LEFT JOIN kn q ON q.id = n.query_id JOIN kn l ON l.id = n.vec_id AND l.c >= 0.6 WHERE q.id IS NULL OR q.c < 0.6),
            xe AS MATERIALIZED (SELECT id AS item_id, 0 AS ev_seq, 'known' AS source, t AS dt, 'second' AS precision, c AS confidence, TRUE AS is_direct FROM kn UNION ALL SELECT * FROM le),""" + _resolve("xe"), "SELECT item_id, final_datetime, confidence, primary_source, source_summary, n_conflicts FROM resolved"),
        "lend_in_order": _with(KNN + """, kn AS MATERIALIZED (SELECT vec_id AS id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(vec_id % 365 AS INT)) AS t, CASE WHEN vec_id % 2 = 0 THEN 'second' ELSE 'day' END AS p, 0.3e0 + (vec_id % 4) / 10 AS c, vec_id % 3 > 0 AS direct FROM embeddings WHERE vec_id % 5 = 0),
            nk AS MATERIALIZED (SELECT nn.*, CASE WHEN score >= 0.98 THEN 0.75e0 WHEN score >= 0.95 THEN 0.65e0 WHEN score >= 0.90 THEN 0.55e0 WHEN score >= 0.85 THEN 0.45e0 ELSE 0.40e0 END AS lc FROM nn),
            todo AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT DISTINCT query_id AS id FROM nn WHERE query_id NOT IN (SELECT id FROM kn WHERE c >= 0.4))),
            lo(k, id, t, p, c, lent) USING KEY (id) AS (
              SELECT CAST(0 AS BIGINT), vec_id, t, coalesce(p, ''), c, CAST([] AS STRUCT(id BIGINT, t TIMESTAMP, p VARCHAR, c DOUBLE, s DOUBLE)[]) FROM embeddings LEFT JOIN kn ON kn.id = vec_id
              UNION SELECT x.k, x.id, r.t, r.p, r.c, l.lent FROM (SELECT todo.* FROM todo WHERE k = (SELECT max(k) + 1 FROM lo)) x
              CROSS JOIN LATERAL (SELECT coalesce(list({'id': n.vec_id, 't': o.t, 'p': o.p, 'c': n.lc, 's': n.score} ORDER BY n.score DESC, n.vec_id), []) AS lent FROM nk n JOIN recurring.lo o ON o.id = n.vec_id WHERE n.query_id = x.id AND o.t IS NOT NULL AND o.c >= 0.4) l
              CROSS JOIN LATERAL (SELECT first(t ORDER BY direct DESC, c DESC, rank DESC, s DESC, v) AS t, first(p ORDER BY direct DESC, c DESC, rank DESC, s DESC, v) AS p, first(c ORDER BY direct DESC, c DESC, rank DESC, s DESC, v) AS c FROM (
                SELECT direct, t, p, c, CASE p WHEN 'second' THEN 6 ELSE 3 END AS rank, 2e0 AS s, 0 AS v FROM kn WHERE kn.id = x.id UNION ALL SELECT FALSE, e.t, e.p, e.c, CASE e.p WHEN 'second' THEN 6 ELSE 3 END, e.s, e.id FROM (SELECT unnest(l.lent) AS e))) r),
            xe AS MATERIALIZED (SELECT id AS item_id, 0 AS ev_seq, 'known' AS source, t AS dt, p AS precision, c AS confidence, direct AS is_direct FROM kn UNION ALL SELECT id, 9000 + k, 'similar', e.t, e.p, e.c, FALSE FROM (SELECT id, unnest(range(1, len(lent) + 1)) AS k, unnest(lent) AS e FROM lo)),""" + _resolve("xe"), "SELECT resolved.*, coalesce((SELECT count(*) FROM xe WHERE xe.item_id = resolved.item_id AND source = 'similar'), 0) AS n_lent FROM resolved"),
        "best_evidence": _with(EVIDENCE, "SELECT item_id, ev_seq, source, dt, confidence FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, ev_seq) AS rn FROM ev) WHERE rn = 1"),
        "direct_evidence": _with(EVIDENCE, "SELECT precision, count(*) AS n, max(confidence) AS best FROM ev WHERE source = 'filename' AND is_direct GROUP BY 1"),
        "dedup_sha1": _with(BY_SHA1, "SELECT * FROM gg"),
        "dedup_phash": _with(BY_PHASH, "SELECT * FROM gg"),
        "dedup_clip": _with(BY_PHASH + "," + COS, "SELECT query_id AS id, arg_max(vec_id, (score, -vec_id)) AS related_id, max(score) AS score FROM cs WHERE score >= 0.35 AND query_id NOT IN (SELECT id FROM gg) AND vec_id NOT IN (SELECT id FROM gg) GROUP BY 1"),
        "hash_search": _with(HASH, "SELECT * FROM (SELECT a.id AS query_id, b.id, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance, CAST(row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.h, b.h)), b.id) AS INT) AS rk FROM hs a JOIN hs b ON a.id <> b.id AND a.id % 100 = 0 AND bit_count(xor(a.h, b.h)) <= 20) WHERE rk <= 5"),
        "digit_parse": _with(ALBUM + """, px AS (SELECT DISTINCT text, regexp_replace(text, '[^0-9]', '', 'g') AS s FROM (SELECT stem AS text FROM album UNION ALL SELECT folder_name FROM album UNION ALL SELECT 'u' || CAST(user_id AS STRING) FROM album UNION ALL SELECT 'album')),
            py AS (SELECT text, CASE length(s) WHEN 14 THEN 'second' WHEN 12 THEN 'minute' WHEN 8 THEN 'day' WHEN 6 THEN 'month' WHEN 4 THEN 'year' END AS precision, TRY_CAST(substr(s, 1, 4) || '-' || CASE WHEN length(s) >= 6 THEN substr(s, 5, 2) ELSE '01' END || '-' || CASE WHEN length(s) >= 8 THEN substr(s, 7, 2) ELSE '01' END || ' ' || CASE WHEN length(s) >= 10 THEN substr(s, 9, 2) ELSE '00' END || ':' || CASE WHEN length(s) >= 12 THEN substr(s, 11, 2) ELSE '00' END || ':' || CASE WHEN length(s) >= 14 THEN substr(s, 13, 2) ELSE '00' END AS TIMESTAMP) AS dt, s FROM px WHERE length(s) IN (4, 6, 8, 12, 14))""", "SELECT text, precision, dt FROM py WHERE dt IS NOT NULL AND CAST(substr(s, 1, 4) AS INT) BETWEEN 1900 AND 2100"),
        "path_order": _with(ALBUM, "SELECT relpath FROM album ORDER BY string_split(relpath, '/') LIMIT 50"),
        "stage_gate": _with(ALBUM + ", s1 AS (SELECT *, NOT unsupported AND ext <> 'mp4' AS x FROM album), s2 AS (SELECT *, x AND exif_original IS NULL AND starts_with(stem, 'IMG') AS f FROM s1)",
            "SELECT CASE WHEN f THEN 'exif,filename' WHEN x THEN 'exif' ELSE '' END AS stages, CASE WHEN unsupported THEN 'UNSUPPORTED' WHEN x AND exif_original IS NULL AND NOT f THEN 'NO_EXIF' ELSE '' END AS flags, count(*) AS n FROM s2 GROUP BY 1, 2"),
        "time_values": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN extract(microsecond FROM ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS iso, TRUE AS same, CAST(day(last_day(ts)) AS INT) AS days, TIMESTAMP '1970-01-01 00:00:00' + to_microseconds(CAST(event_id * 86400500000 AS BIGINT)) AS epoch FROM events",
        "bytes_text": _with(ALBUM, "SELECT item_id, CASE event_id % 3 WHEN 0 THEN '0xff00' WHEN 1 THEN stem ELSE '0x6107' || lower(hex(encode(stem))) END AS text FROM album"),
    }
