"""DuckDB counterparts of the queries, written on their own from what each query means."""

from __future__ import annotations

from ..functions.email import ADDRESS, GMAIL_TYPOS
from ..functions.names import NOISE_PATTERN
from ..operators.domains import BARE_ENDS, CUT_TAILS, GOV_TYPOS
from ..operators.provinces import NAMES, SLUGS
from ..operators.sequence import AGENCY
from .registrations import SQL as REGISTRATIONS


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def fold(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(replace(replace({c}, 'đ', 'd'), 'Đ', 'D'))), '\\s+', ' ', 'g'))"


_GMAIL = "(?i)@(?:" + "|".join(x.replace(".", "\\.") for x in GMAIL_TYPOS) + ")$"


def _repair(c: str) -> str:
    steps = f"regexp_replace(regexp_replace(replace({c}, ',', '.'), '@{{2,}}', '@', 'g'), '{_GMAIL}', '@gmail.com')"
    for pattern, to in (("\\.{2,}", "."), ("@\\.+", "@"), ("\\.+@", "@")):
        steps = f"regexp_replace({steps}, '{pattern}', '{to}', 'g')"
    return steps


def _found(c: str) -> str:
    got = f"regexp_extract({c}, '{ADDRESS}', 0)"
    before = f"regexp_extract({c}, '([^\\x00-\\x7F]?){ADDRESS}', 1)"
    return f"CASE WHEN {got} <> '' AND NOT regexp_matches({got}, '\\.\\.|^\\.|\\.@|@\\.|\\.$') AND NOT regexp_matches({before}, '[\\p{{L}}\\p{{N}}]') THEN lower({got}) END"


def _steps(registrations: str = REGISTRATIONS) -> str:
    """valid: registrations with address, name, phone and status."""
    return f"""
WITH {registrations},
cells AS (
  SELECT *, regexp_replace(raw_email, '\\s+', '', 'g') AS joined,
         trim(split_part(raw_email, '@', 1)) AS local_cell,
         trim(CASE WHEN contains(raw_email, '@') THEN substr(raw_email, strpos(raw_email, '@') + 1) ELSE raw_email END) AS domain_cell
  FROM registrations),
judged AS (
  SELECT *, coalesce(contains(raw_email, '@') AND regexp_matches(raw_email, '^[A-Za-z0-9._%+\\-@,\\s]+$')
      AND (regexp_matches(domain_cell, '[A-Za-z0-9][ \\t]+[A-Za-z0-9]')
        OR (regexp_matches(local_cell, '[A-Za-z0-9][ \\t]+[A-Za-z0-9]') AND NOT starts_with(lower(domain_cell), 'gmail')
          AND len(list_filter(regexp_split_to_array(local_cell, '[ \\t]+')[2:], lambda x: NOT regexp_matches(x, '^\\d+$'))) > 0)), false) AS ambiguous
  FROM cells),
addressed AS (
  SELECT *, CASE WHEN NOT ambiguous THEN coalesce(regexp_replace({_found("joined")}, '{_GMAIL}', '@gmail.com'), {_found(_repair("joined"))}) END AS email,
         regexp_replace(trim(coalesce(raw_phone, '')), '^(\\+?\\d+)\\.0+$', '\\1') AS phone_cell,
         trim(coalesce(raw_name, '')) AS name_cell
  FROM judged),
shaped AS (
  SELECT *, regexp_replace(regexp_extract(phone_cell, '(?:^|[^\\d])((?:\\+84|84|0)(?:[\\s.\\-()]?\\d){{9}})(?:[^\\d]|$)', 1), '[^\\d+]', '', 'g') AS first_number,
         regexp_replace(phone_cell, '[^\\d+]', '', 'g') AS all_signs,
         CASE WHEN regexp_matches({fold("name_cell")}, '{NOISE_PATTERN}')
              THEN substr(name_cell, 1, length(regexp_extract(lower(strip_accents(replace(replace(name_cell, 'đ', 'd'), 'Đ', 'D'))), '^(.*?)(?:{NOISE_PATTERN})', 1))) ELSE name_cell END AS name_part
  FROM addressed),
numbered AS (
  SELECT *, list_transform([first_number, all_signs], lambda c: CASE WHEN starts_with(c, '+84') THEN '0' || substr(c, 4)
        WHEN starts_with(c, '84') AND length(c) >= 10 THEN '0' || substr(c, 3)
        WHEN NOT starts_with(c, '0') AND length(c) = 9 THEN '0' || c ELSE c END) AS numbers,
      list_filter(string_split(trim(regexp_replace(regexp_replace(name_part, '[^\\p{{L}}\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS name_words
  FROM shaped),
classified AS (
  SELECT source, row_pos, stt, raw_name, raw_unit, raw_email, raw_phone, email,
         coalesce(list_filter(numbers, lambda x: regexp_matches(x, '^0\\d{{9}}$'))[1], '') AS phone,
         array_to_string(list_transform(name_words, lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ') AS name,
         CASE WHEN email IS NOT NULL THEN 'ok' WHEN trim(coalesce(raw_email, '')) = '' THEN 'missing_email' ELSE 'invalid_email_format' END AS status
  FROM numbered),
valid AS (SELECT * FROM classified WHERE status = 'ok')
"""


STEPS = _steps()


def _words(name: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(strip_accents(replace(replace({name}, 'đ', 'd'), 'Đ', 'D'))), '[^a-z0-9]+'), lambda x: x <> '')"


def _score(name: str, email: str) -> str:
    w, local = _words(name), f"regexp_replace(lower(split_part({email}, '@', 1)), '[^a-z0-9]', '', 'g')"
    initials = f"array_to_string(list_transform({w}[1:len({w}) - 1], lambda x: substr(x, 1, 1)), '')"
    full = " OR ".join(f"starts_with({local}, {x})" for x in (f"{initials} || {w}[-1]", f"{w}[-1] || {initials}", f"array_to_string({w}, '')"))
    return f"CASE WHEN len({w}) = 0 THEN 0 WHEN {full} THEN 2 WHEN length({w}[-1]) >= 3 AND contains({local}, {w}[-1]) THEN 1 ELSE 0 END"


def _fitted(name: str, email: str) -> str:
    rest = f"substr({name}, strpos({name}, ' ') + 1)"
    titled = f"lower(split_part({name}, ' ', 1)) IN ('ông', 'bà') AND len(string_split({name}, ' ')) >= 4"
    return f"CASE WHEN {titled} AND {_score(rest, email)} > {_score(name, email)} THEN {rest} ELSE {name} END"


def _fixes(source: str, prefix: str, each: str = "") -> str:
    """CTEs that find the mistyped domains of the table ``source``, with statistics over all, or over each source."""
    key, also = (f"{each}, ", f" AND a.{each} = b.{each}") if each else ("", "")
    return f""",
{prefix}_d AS (SELECT {key}split_part(email, '@', 2) AS domain, count(*) AS n FROM {source} GROUP BY ALL),
{prefix}_p AS (SELECT *, string_split(domain, '.') AS parts FROM {prefix}_d),
{prefix}_c AS (
  SELECT {f"a.{each}, " if each else ""}a.domain AS old, b.domain AS new, a.n, b.n AS n_new, 0 AS rule FROM {prefix}_p a JOIN {prefix}_p b
    ON b.domain = array_to_string(a.parts[1:len(a.parts) - 2], '.') || '.gov.vn'{also}
  WHERE len(a.parts) >= 3 AND a.parts[-2] IN ({_list(GOV_TYPOS)}) AND NOT ends_with(a.domain, '.gov.vn') AND b.n >= 3
  UNION ALL
  SELECT {f"a.{each}, " if each else ""}a.domain, b.domain, a.n, b.n, 1 FROM {prefix}_p a JOIN {prefix}_p b ON a.domain <> b.domain AND levenshtein(a.domain, b.domain) = 1{also}
  WHERE b.n >= 10 AND length(a.parts[1]) >= 5 AND length(b.parts[1]) >= 5),
{prefix}_f AS (
  SELECT {key}old, new, n, n_new FROM (SELECT *, row_number() OVER (PARTITION BY {key}old ORDER BY rule, n_new DESC, new) AS r FROM {prefix}_c WHERE n_new >= 5 * n AND old <> new) WHERE r = 1)"""


def _mode(each: str = "") -> str:
    """ranked: the records of a mode, with statistics of domains over all or over each source; cut: the cut domains."""
    key, also = (f"{each}, ", f" AND a.{each} = b.{each}") if each else ("", "")
    gone = f"({key}split_part(email, '@', 2))" if each else "split_part(email, '@', 2)"
    return (
        STEPS
        + f""",
fitted AS (SELECT * REPLACE ({_fitted("name", "email")} AS name) FROM valid)"""
        + _fixes("fitted", "v", each)
        + f""",
corrected AS (
  SELECT t.* REPLACE (CASE WHEN f.new IS NULL THEN t.email ELSE split_part(t.email, '@', 1) || '@' || f.new END AS email)
  FROM fitted t LEFT JOIN v_f f ON split_part(t.email, '@', 2) = f.old{f" AND t.{each} = f.{each}" if each else ""}),
hist AS (SELECT {key}split_part(email, '@', 2) AS domain, count(*) AS n FROM corrected GROUP BY ALL),
cut AS (
  SELECT DISTINCT {f"a.{each}, " if each else ""}a.domain FROM hist a JOIN hist b ON a.domain <> b.domain AND b.n >= 3 AND b.n >= 5 * a.n{also}
  WHERE (len(string_split(a.domain, '.')) > 1 AND string_split(a.domain, '.')[-1] IN ({_list(CUT_TAILS)}) AND starts_with(b.domain, a.domain))
     OR (a.domain IN ({_list(BARE_ENDS)}) AND ends_with(b.domain, '.' || a.domain))),
cutoff AS (SELECT * FROM corrected WHERE {gone} IN (SELECT {f"({each}, domain)" if each else "domain"} FROM cut)),
good AS (SELECT * FROM corrected WHERE {gone} NOT IN (SELECT {f"({each}, domain)" if each else "domain"} FROM cut)),
scored AS (SELECT *, {_score("name", "email")} AS score FROM good),
ranked AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY score DESC, source, row_pos) AS rank FROM scored)"""
    )


_FIXED = STEPS + _fixes("valid", "v")
_MODE1, _MODE2 = _mode(), _mode("source")
_NOTE = """'Trùng email với dòng ' || w.row_pos || CASE WHEN coalesce(w.stt, '') <> '' THEN ' (STT ' || w.stt || ')' ELSE '' END
  || ' - ' || w.name || ' (tệp ' || w.source || ')'"""
_RANKED = STEPS + f""",
scored AS (SELECT *, {_score("name", "email")} AS score FROM valid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY score DESC, source, row_pos) AS rank,
    first_value(source) OVER (PARTITION BY email ORDER BY source, row_pos) AS first_source,
    first_value(row_pos) OVER (PARTITION BY email ORDER BY source, row_pos) AS first_row_pos FROM scored)"""
_ORDINAL = """CASE WHEN regexp_matches(trim(stt), '^\\d+\\.*$') THEN TRY_CAST(regexp_extract(trim(stt), '^(\\d+)\\.*$', 1) AS BIGINT)
  WHEN regexp_matches(trim(stt), '^\\d+\\.\\d+$') AND abs(TRY_CAST(trim(stt) AS DOUBLE) - round(TRY_CAST(trim(stt) AS DOUBLE))) < 1e-6 THEN round(TRY_CAST(trim(stt) AS DOUBLE))::BIGINT END"""
_STT = f"WITH {REGISTRATIONS}, n AS (SELECT *, CASE WHEN {_ORDINAL} BETWEEN 1 AND 99999 THEN {_ORDINAL} END AS stt_no FROM registrations)"
_GAPS = _STT + """,
most AS (SELECT source, max(stt_no) AS most FROM n GROUP BY source),
gaps AS (
  SELECT source, stt_no FROM (SELECT source, unnest(generate_series(1, most)) AS stt_no FROM most WHERE most IS NOT NULL)
  EXCEPT SELECT source, stt_no FROM n)"""

_ROWS = ", ".join(f"('{name.lower()}', '{now}', '{kind}')" for name, now, kind in NAMES)
_PROVINCES = f"""dim AS (SELECT *, strip_accents(replace(name, 'đ', 'd')) AS plain FROM (VALUES {_ROWS}) AS t(name, current, kind))"""
_PLACE = "(?:^|[^\\p{L}\\p{N}_])"
_END = "(?:[^\\p{L}\\p{N}_]|$)"


def _mentioned(prefix_accented: str = "", prefix_plain: str = "") -> str:
    return f"""
low AS (SELECT raw_unit, lower(raw_unit) AS low, strip_accents(replace(lower(raw_unit), 'đ', 'd')) AS plain FROM (SELECT DISTINCT raw_unit FROM registrations)),
hits AS (
  SELECT l.raw_unit, d.current, d.kind, row_number() OVER (PARTITION BY l.raw_unit ORDER BY length(d.name) DESC, d.name DESC) AS r
  FROM low l, dim d WHERE CASE WHEN l.low <> l.plain THEN regexp_matches(l.low, '{_PLACE}{prefix_accented}' || d.name || '{_END}')
                               ELSE regexp_matches(trim(l.plain), '(?:^|[^a-z0-9]){prefix_plain}' || d.plain || '(?:[^a-z0-9]|$)') END)"""


def _commune(c: str) -> str:
    """The last commune that a text names, as '<level> <name>'."""
    sep, level = "[^\\s,;:()/–-]", "(?:^|[^\\p{L}\\p{N}])"
    patterns = {
        "low": f"{level}(xã|phường|thị trấn)((?:\\s+{sep}+){{1,5}})", "mixed": f"{level}([Tt]hị\\s*[Tt]rấn|[Xx]ã|[Pp]hường)((?:\\s+[\\p{{Lu}}\\p{{Nd}}]{sep}*)+)",
        "up": f"{level}(THỊ\\s*TRẤN|XÃ|PHƯỜNG)((?:\\s+[\\p{{Lu}}\\p{{Nd}}]+)+)",
    }
    last = {k: [f"regexp_extract_all({c}, '{p}', {g})[-1]" for g in (1, 2)] for k, p in patterns.items()}
    pick = [f"CASE WHEN {c} = lower({c}) THEN {last['low'][g]} ELSE coalesce({last['mixed'][g]}, {last['up'][g]}) END" for g in (0, 1)]
    name, first = f"trim({pick[1]})", f"lower({pick[0]})"
    titled = f"array_to_string(list_transform(string_split({name}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
    return f"upper(substr({first}, 1, 1)) || substr({first}, 2) || ' ' || CASE WHEN {name} = upper({name}) OR {c} = lower({c}) THEN {titled} ELSE {name} END"


_PLAIN_UNIT = "strip_accents(replace(lower({}), 'đ', 'd'))"
#: unit: raw_unit, don_vi and to_chuc of each distinct unit, with Cần Thơ as the default.
_UNITS = f"""{_PROVINCES}, {_mentioned("(?:tỉnh|thành\\s*phố|tp\\.?)\\s*", "(?:tinh|thanh\\s*pho|tp\\.?)\\s*")},
u0 AS (SELECT raw_unit, trim(raw_unit) AS cell, list_filter(list_transform(regexp_split_to_array(trim(raw_unit), '\\s+[-–—]\\s+|,\\s*|;\\s*'), lambda x: trim(x)), lambda x: x <> '') AS parts
       FROM (SELECT DISTINCT raw_unit FROM registrations)),
u1 AS (SELECT *, regexp_extract(parts[-1], '\\s+(?:thành\\s*phố|tỉnh)\\s+(.+)$', 1) AS tail FROM u0),
u2 AS (SELECT *, CASE WHEN len(parts) > 1 AND regexp_matches(parts[-1], '^Sở\\s+\\S') THEN
         CASE WHEN {_PLAIN_UNIT.format("tail")} IN (SELECT plain FROM dim) THEN regexp_replace(parts[-1], '\\s+(?:thành\\s*phố|tỉnh)\\s+.+$', '') ELSE parts[-1] END ELSE cell END AS text FROM u1),
u3 AS (SELECT *, {_commune("text")} AS commune, regexp_replace(text, '^(?:tỉnh|thành phố)\\s+', '') AS bare FROM u2),
unit AS (
  SELECT u.raw_unit, CASE WHEN cell = '' THEN '' WHEN commune IS NULL AND {_PLAIN_UNIT.format("bare")} IN (SELECT plain FROM dim) THEN bare
           ELSE coalesce(commune, trim(regexp_replace(text, 'TP\\.\\s*', 'Thành phố '))) || ' - ' || coalesce(h.current, 'Cần Thơ') END AS don_vi,
         upper(coalesce(h.kind || ' ' || h.current, 'thành phố Cần Thơ')) AS to_chuc
  FROM u3 u LEFT JOIN hits h ON u.raw_unit = h.raw_unit AND h.r = 1)"""
_MODE2_RECORDS = f"{_MODE2}, {_UNITS}, records AS (SELECT r.source, row_pos, stt, email, name, phone, don_vi, to_chuc FROM ranked r LEFT JOIN unit u ON r.raw_unit IS NOT DISTINCT FROM u.raw_unit WHERE rank = 1)"
_TITLED = f"""WITH {REGISTRATIONS}, t AS (SELECT source, row_pos, CASE WHEN stt = 'IV' THEN 'Phòng Mẫu' ELSE raw_name END AS raw_name,
        CASE WHEN stt <> 'IV' THEN raw_email END AS raw_email, CASE WHEN stt <> 'IV' THEN raw_phone END AS raw_phone, CASE WHEN stt <> 'IV' THEN raw_unit END AS raw_unit FROM registrations)"""
_JOB = "regexp_matches(lower({}), '^(?:chuyên viên|giám đốc)')"
#: Cells of shifted rows, each (id 0 to 5), each with the one after it (10 to 14), and the own cells of address and number
#: (20 and 21), as registrations of their own.
_FLAT = (
    REGISTRATIONS.replace("registrations AS", "base AS", 1)
    + """, s AS (SELECT source, row_pos, row_pos % 5 AS k, coalesce(stt, '') AS c0, coalesce(raw_name, '') AS c1, coalesce(raw_unit, '') AS c2, coalesce(raw_email, '') AS e, raw_phone AS p FROM base),
shifted AS (SELECT source, row_pos, c0, c1, c2, CASE k WHEN 0 THEN p WHEN 1 THEN '' ELSE e END AS c3,
  CASE k WHEN 0 THEN substr(e, 1, greatest(length(e) - 2, 0)) ELSE p END AS c4, CASE k WHEN 0 THEN substr(e, greatest(length(e) - 2, 0) + 1) WHEN 1 THEN e ELSE '' END AS c5 FROM s),
flat AS (SELECT source, row_pos, c3, c4, unnest([0, 1, 2, 3, 4, 5, 10, 11, 12, 13, 14, 20, 21]) AS id,
  unnest([trim(c0), trim(c1), trim(c2), trim(c3), trim(c4), trim(c5), trim(c0) || trim(c1), trim(c1) || trim(c2), trim(c2) || trim(c3), trim(c3) || trim(c4), trim(c4) || trim(c5), c3, c4]) AS cell FROM shifted),
registrations AS (SELECT source, row_pos * 100 + id AS row_pos, '' AS stt, '' AS raw_name, '' AS raw_unit, cell AS raw_email, cell AS raw_phone FROM flat)"""
)
_CELL_SEARCH = _steps(_FLAT) + r"""
, n AS (SELECT source, row_pos // 100 AS row_pos, row_pos % 100 AS id, raw_email AS c, email, phone FROM classified),
pairs AS (SELECT p.source, p.row_pos, min(p.id) AS id FROM n p JOIN n a ON a.source = p.source AND a.row_pos = p.row_pos AND a.id = p.id - 10 JOIN n b ON b.source = p.source AND b.row_pos = p.row_pos AND b.id = p.id - 9
  WHERE p.id BETWEEN 10 AND 14 AND p.email IS NOT NULL AND a.email IS NULL AND contains(a.c, '@') AND regexp_matches(b.c, '^[A-Za-z0-9.\-]{1,15}$') GROUP BY ALL),
own AS (SELECT source, row_pos, max(CASE WHEN id = 20 THEN email END) AS own, max(CASE WHEN id = 20 THEN c END) AS raw_email, max(CASE WHEN id = 21 THEN c END) AS raw_phone, max(CASE WHEN id = 21 THEN phone END) AS phone,
  min(id) FILTER (id IN (2, 4, 5) AND contains(c, '@') AND email IS NOT NULL) AS other FROM n GROUP BY ALL),
used AS (SELECT o.*, p.id AS pair, CASE WHEN own IS NOT NULL THEN 3 WHEN other IS NOT NULL THEN other WHEN p.id IS NOT NULL THEN -1 ELSE 3 END AS used FROM own o LEFT JOIN pairs p ON o.source = p.source AND o.row_pos = p.row_pos),
number AS (SELECT u.source, u.row_pos, arg_min(n.c, n.id) AS c FROM used u JOIN n ON n.source = u.source AND n.row_pos = u.row_pos AND n.id IN (2, 3, 5) AND n.id <> u.used
  WHERE u.phone = '' AND (u.used <> 3 OR trim(u.raw_phone) <> '') AND regexp_matches(n.c, '^[\d\s.+\-()]{9,20}$') AND n.phone <> '' GROUP BY ALL)
SELECT u.source, u.row_pos, coalesce(e.c, u.raw_email) AS raw_email, coalesce(k.c, u.raw_phone) AS raw_phone FROM used u
LEFT JOIN n e ON e.source = u.source AND e.row_pos = u.row_pos AND u.own IS NULL AND e.id = coalesce(u.other, u.pair)
LEFT JOIN number k ON k.source = u.source AND k.row_pos = u.row_pos"""
_CONTENT_ROWS = f"""WITH {REGISTRATIONS}, a AS (SELECT source, row_pos, CASE row_pos % 3 WHEN 0 THEN [stt, raw_name, raw_unit, raw_email, raw_phone] WHEN 1 THEN [stt, raw_email, raw_name, raw_phone, raw_unit]
          ELSE ['', stt, '', raw_name, raw_phone, raw_unit, raw_email] END AS cs FROM registrations),
        f AS (SELECT source, row_pos, i, c, trim(regexp_replace(c, '\\s*@\\s*', '@', 'g')) AS sq, regexp_replace(regexp_replace(c, '^(\\+?\\d+)\\.0+$', '\\1'), '[\\s.\\-]', '', 'g') AS tight
              FROM (SELECT source, row_pos, unnest(range(len(cs))) AS i, trim(coalesce(unnest(cs), '')) AS c FROM a) WHERE c <> ''),
        g AS (SELECT *, regexp_matches(sq, '{ADDRESS}') AS good, contains(c, '@') AND (NOT contains(sq, ' ') OR regexp_matches(c, '^[\\p{{L}}\\p{{M}}\\p{{N}}_.%+\\-,@\\s]+$')) AS at_,
              regexp_matches(c, '(?i)^[\\p{{L}}\\p{{N}}_%+\\-]+(?:\\.[\\p{{L}}\\p{{N}}_%+\\-]+){{2,}}\\.(?:vn|com|net)$') AS bare, regexp_matches(tight, '(?:\\+?84|0)\\d{{8,10}}|^\\d{{9}}$') AS number FROM f),
        e AS (SELECT source, row_pos, coalesce(min(i) FILTER (good), min(i) FILTER (at_), min(i) FILTER (bare), -1) AS ei, bool_or(good OR at_ OR bare OR number) AS has_identity, min(i) AS lo, arg_min(c, i) AS first FROM g GROUP BY ALL),
        p AS (SELECT e.*, coalesce((SELECT min(g.i) FROM g WHERE g.source = e.source AND g.row_pos = e.row_pos AND g.number AND g.i <> e.ei), -1) AS pi FROM e),
        q AS (SELECT *, CASE WHEN lo > 0 AND regexp_matches(first, '^(?:\\d{{1,4}}\\.?|[IVXLC]{{1,6}}\\.?)$') AND lo NOT IN (ei, pi) THEN lo ELSE 0 END AS si FROM p),
        r AS (SELECT q.source, q.row_pos, any_value(has_identity) AS has_identity, max(CASE WHEN i = ei THEN c END) AS raw_email, max(CASE WHEN i = pi THEN c END) AS raw_phone, coalesce(max(CASE WHEN i = si THEN c END), '') AS stt,
              list(c ORDER BY i) FILTER (i NOT IN (ei, pi, si)) AS texts FROM q JOIN g ON g.source = q.source AND g.row_pos = q.row_pos GROUP BY ALL)
        SELECT source, row_pos, regexp_replace(regexp_replace(stt, '^(\\d+)\\.$', '\\1'), '^(\\d+)\\.0$', '\\1') AS stt, coalesce(texts[1], '') AS raw_name, coalesce(texts[2], '') AS raw_unit, raw_email, raw_phone, has_identity FROM r"""

ORACLE_SQL: dict[str, str] = {
    "email_normalize": STEPS + "SELECT source, row_pos, email FROM classified",
    "email_classify": STEPS + "SELECT source, status, count(*) AS n FROM classified GROUP BY ALL",
    "email_repair": f"WITH {REGISTRATIONS} SELECT source, row_pos, {_repair('raw_email')} AS repaired FROM registrations WHERE raw_email IS NOT NULL",
    "phone_normalize": STEPS + "SELECT source, row_pos, phone FROM classified",
    "name_normalize": STEPS + "SELECT source, row_pos, name FROM classified",
    "accent_fold": f"SELECT doc_id, {fold('text')} AS folded FROM documents",
    "name_email_score": STEPS + f"SELECT source, row_pos, ({_score('name', 'email')})::BIGINT AS score FROM valid",
    "honorific_strip": STEPS + f"SELECT source, row_pos, {_fitted('name', 'email')} AS name FROM valid",
    "domain_histogram": STEPS + "SELECT source, split_part(email, '@', 2) AS domain, count(*) AS n, min(row_pos) AS first_pos FROM valid GROUP BY ALL",
    "dominant_domain": STEPS + """SELECT source, domain, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, p) AS r
        FROM (SELECT source, split_part(email, '@', 2) AS domain, count(*) AS n, min(row_pos) AS p FROM valid GROUP BY ALL)) WHERE r = 1 AND n >= 3""",
    "typo_domain_fixes": _FIXED + " SELECT old, new, n, n_new FROM v_f",
    "typo_domain_apply": _FIXED + """ SELECT source, row_pos, CASE WHEN new IS NULL THEN email ELSE split_part(email, '@', 1) || '@' || new END AS email
        FROM valid LEFT JOIN v_f ON split_part(email, '@', 2) = old""",
    "truncated_domains": STEPS + f""", hist AS (SELECT split_part(email, '@', 2) AS domain, count(*) AS n FROM valid GROUP BY 1)
        SELECT a.domain, max_by(b.domain, (b.n, b.domain)) AS whole FROM hist a JOIN hist b ON a.domain <> b.domain AND b.n >= 3 AND b.n >= 5 * a.n
        WHERE (len(string_split(a.domain, '.')) > 1 AND string_split(a.domain, '.')[-1] IN ({_list(CUT_TAILS)}) AND starts_with(b.domain, a.domain))
           OR (a.domain IN ({_list(BARE_ENDS)}) AND ends_with(b.domain, '.' || a.domain)) GROUP BY a.domain""",
    "dedupe_best_match": _RANKED + " SELECT source, row_pos, email, name, phone, score::BIGINT AS score, first_source, first_row_pos FROM ranked WHERE rank = 1",
    "dedupe_notes": _RANKED + f""" SELECT l.source, l.row_pos, 'duplicate_email' AS reason, {_NOTE} AS note
        FROM ranked l JOIN ranked w ON l.email = w.email AND w.rank = 1 WHERE l.rank > 1""",
    "mode1_records": _MODE1 + " SELECT source, row_pos, stt, email, name, phone FROM ranked WHERE rank = 1",
    "mode1_issues": _MODE1 + f""" SELECT source, row_pos, stt, raw_name, raw_email, raw_phone, status AS reason, NULL::VARCHAR AS note FROM classified WHERE status <> 'ok'
        UNION ALL SELECT source, row_pos, stt, raw_name, raw_email, raw_phone, 'invalid_email_format', NULL FROM cutoff
        UNION ALL SELECT l.source, l.row_pos, l.stt, l.raw_name, l.raw_email, l.raw_phone, 'duplicate_email', {_NOTE} FROM ranked l JOIN ranked w ON l.email = w.email AND w.rank = 1 WHERE l.rank > 1""",
    "mode1_stats": _MODE1 + """, t AS (SELECT count(*) AS total_rows, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'missing_email') AS missing_email,
        count(*) FILTER (status = 'invalid_email_format') AS invalid FROM classified), f AS (SELECT count(*) AS final_count FROM ranked WHERE rank = 1), c AS (SELECT count(*) AS n FROM cutoff)
        SELECT total_rows, ok - n AS valid_rows, missing_email, invalid + n AS invalid_email_format, final_count, ok - n - final_count AS duplicates_removed FROM t, f, c""",
    "mode2_records": f"{_MODE2_RECORDS} SELECT * FROM records",
    "mode2_issues": _MODE2 + f""" SELECT source, row_pos, raw_unit, status AS reason, NULL::VARCHAR AS note FROM classified WHERE status <> 'ok' UNION ALL SELECT source, row_pos, raw_unit, 'invalid_email_format', NULL FROM cutoff
        UNION ALL SELECT l.source, l.row_pos, l.raw_unit, 'duplicate_email', {_NOTE} FROM ranked l JOIN ranked w ON l.email = w.email AND w.rank = 1 WHERE l.rank > 1""",
    "mode2_per_source": f"{_MODE2_RECORDS} SELECT source, count(*) AS final_count, count(*) FILTER (to_chuc = '') AS to_chuc_missing FROM records GROUP BY source",
    "unit_normalize": f"WITH {REGISTRATIONS}, {_UNITS} SELECT raw_unit, don_vi FROM unit",
    "group_units": f"""{_TITLED}, m AS (SELECT *, trim(coalesce(raw_email, '')) = '' AND trim(coalesce(raw_phone, '')) = '' AND (trim(coalesce(raw_name, '')) <> '') <> (trim(coalesce(raw_unit, '')) <> '') AS title FROM t),
        g AS (SELECT *, trim(coalesce(raw_unit, '')) AS u, last_value(CASE WHEN title THEN coalesce(nullif(trim(coalesce(raw_name, '')), ''), trim(raw_unit)) END IGNORE NULLS) OVER (PARTITION BY source ORDER BY row_pos) AS grp FROM m)
        SELECT source, row_pos, CASE WHEN grp IS NOT NULL AND (NOT contains(u, ' ') OR {_JOB.format("u")}) THEN grp ELSE u END AS raw_unit FROM g WHERE NOT title""",
    "unit_blocks": f"""WITH {REGISTRATIONS}, b AS (SELECT *, trim(raw_unit) AS u, last_value(CASE row_pos % 9 WHEN 0 THEN 'UBND xã Mẫu Năm' WHEN 4 THEN 'Sở Mẫu Sáu' END IGNORE NULLS) OVER (PARTITION BY source ORDER BY row_pos) AS block FROM registrations)
        SELECT source, row_pos, CASE WHEN block IS NULL THEN u WHEN block LIKE 'UBND%' THEN 'Xã Mẫu Năm' WHEN u = '' OR u = 'Chuyên viên' THEN block WHEN u LIKE 'Giám đốc %' THEN substr(u, 10) ELSE u END AS raw_unit FROM b""",
    "continuation_rows": f"""WITH {REGISTRATIONS}, t AS (SELECT source, row_pos, stt, CASE WHEN row_pos % 7 <> 0 THEN raw_name END AS raw_name, CASE WHEN row_pos % 7 = 0 THEN 'gov.vn' ELSE raw_email END AS raw_email,
          CASE WHEN row_pos % 7 <> 0 THEN raw_phone END AS raw_phone FROM registrations),
        i AS (SELECT *, sum((row_pos % 7 <> 0)::INT) OVER w AS named, row_number() OVER w AS r FROM t WINDOW w AS (PARTITION BY source ORDER BY row_pos)),
        j AS (SELECT *, CASE WHEN named = 0 THEN -r ELSE named END AS island FROM i)
        SELECT source, min(row_pos) AS row_pos, arg_min(stt, row_pos) AS stt, count(*) AS n_rows, string_agg(trim(coalesce(raw_name, '')), '' ORDER BY row_pos) AS raw_name,
          string_agg(trim(coalesce(raw_email, '')), '' ORDER BY row_pos) AS raw_email, string_agg(trim(coalesce(raw_phone, '')), '' ORDER BY row_pos) AS raw_phone FROM j GROUP BY source, island""",
    "cell_search": _CELL_SEARCH,
    "content_rows": _CONTENT_ROWS,
    "per_source_counts": STEPS + """SELECT source, count(*) AS total_rows, count(*) FILTER (status = 'ok') AS valid_rows, count(*) FILTER (status = 'missing_email') AS missing_email,
        count(*) FILTER (status = 'invalid_email_format') AS invalid_email_format, count(*) FILTER (phone = '') AS without_phone FROM classified GROUP BY source""",
    "stt_parse": _STT + " SELECT source, row_pos, stt_no FROM n",
    "stt_gaps": _GAPS + " SELECT source, stt_no FROM gaps",
    "stt_warnings": _GAPS + """ SELECT g.source, CASE WHEN count(*) > 0.3 * max(most) THEN 'stt_sparse' ELSE 'stt_gap' END AS code, count(*) AS missing, max(most) AS most
        FROM gaps g JOIN most m ON g.source = m.source GROUP BY g.source""",
    "after_stt_label": _STT + """ SELECT source, row_pos, CASE WHEN stt_no IS NOT NULL THEN stt_no::VARCHAR WHEN prev IS NOT NULL THEN 'sau STT ' || prev ELSE 'đầu bảng' END AS row_label
        FROM (SELECT *, last_value(stt_no IGNORE NULLS) OVER (PARTITION BY source ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM n)""",
    "fill_forward_group": f"""WITH {REGISTRATIONS} SELECT source, row_pos,
        last_value(CASE WHEN row_pos % 6 = 0 AND trim(raw_unit) <> '' THEN trim(raw_unit) END IGNORE NULLS) OVER (PARTITION BY source ORDER BY row_pos) AS unit_filled FROM registrations""",
    "group_headers": f"""WITH {REGISTRATIONS}, t AS (SELECT source, row_pos, stt, stt = 'IV' AS titled, CASE WHEN stt = 'IV' THEN 'Phòng Mẫu' ELSE raw_name END AS raw_name,
        CASE WHEN stt <> 'IV' THEN raw_email END AS raw_email, CASE WHEN stt <> 'IV' THEN raw_phone END AS raw_phone FROM registrations),
        a AS (SELECT *, lead(stt) OVER w AS stt_below, lead(raw_email) OVER w AS email_below FROM t WINDOW w AS (PARTITION BY source ORDER BY row_pos)),
        m AS (SELECT *, coalesce(trim(coalesce(raw_email, '')) = '' AND trim(coalesce(raw_phone, '')) = '' AND trim(raw_name) <> '' AND CASE
            WHEN regexp_matches(trim(coalesce(stt, '')), '^([IVXLC]{{1,6}}\\.?)?$') THEN trim(stt) <> '' OR regexp_matches({fold("raw_name")}, '{AGENCY.replace("(?![a-z])", "(?:[^a-z]|$)")}')
            ELSE regexp_matches({fold("raw_name")}, '{AGENCY.replace("(?![a-z])", "(?:[^a-z]|$)")}') OR coalesce(trim(stt_below) = '' AND contains(email_below, '@'), false) END, false) AS is_group FROM a)
        SELECT source, row_pos, is_group, last_value(CASE WHEN is_group THEN trim(raw_name) END IGNORE NULLS) OVER (PARTITION BY source ORDER BY row_pos) AS "group" FROM m""",
    "sheet_overlap": f"""WITH {REGISTRATIONS}, c AS (SELECT source, row_pos % 3 AS sheet_idx, raw_email AS value FROM registrations
          UNION ALL SELECT source, 1, raw_email FROM registrations WHERE row_pos % 3 = 0 AND row_pos % 4 > 0),
        e AS (SELECT DISTINCT source, sheet_idx, unnest(regexp_extract_all(regexp_replace(lower(value), '\\s+', '', 'g'), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_.%+\\-]+@[\\p{{L}}\\p{{M}}\\p{{Nd}}_.\\-]+\\.[\\p{{L}}\\p{{M}}\\p{{Nd}}_]{{2,}}')) AS email FROM c),
        f AS (SELECT *, min(sheet_idx) OVER (PARTITION BY source, email) AS first FROM e),
        g AS (SELECT source, sheet_idx, count(*) AS emails, count(*) FILTER (first < sheet_idx) AS overlap FROM f GROUP BY ALL)
        SELECT s.source, s.sheet_idx, coalesce(emails, 0) AS emails, coalesce(overlap, 0) AS overlap, coalesce(emails, 0) >= 3 AND coalesce(overlap, 0) >= 0.5 * coalesce(emails, 0) AS skip
        FROM (SELECT DISTINCT source, sheet_idx FROM c) s LEFT JOIN g ON s.source = g.source AND s.sheet_idx = g.sheet_idx""",
    "province_lookup": f"""WITH {REGISTRATIONS}, {_PROVINCES} , one AS (SELECT plain, max(current) AS current FROM dim GROUP BY plain)
        SELECT source, row_pos, current AS province FROM registrations LEFT JOIN one ON plain = trim(strip_accents(replace(lower(raw_unit), 'đ', 'd')))""",
    "province_detect": f"""WITH {REGISTRATIONS}, {_PROVINCES}, {_mentioned()}
        SELECT r.source, r.row_pos, h.current AS province FROM registrations r LEFT JOIN hits h ON r.raw_unit = h.raw_unit AND h.r = 1""",
    "to_chuc": f"""WITH {REGISTRATIONS}, {_PROVINCES}, {_mentioned("(?:tỉnh|thành\\s*phố|tp\\.?)\\s*", "(?:tinh|thanh\\s*pho|tp\\.?)\\s*")}
        SELECT r.source, r.row_pos, upper(coalesce(h.kind || ' ' || h.current, 'thành phố Cần Thơ')) AS to_chuc FROM registrations r LEFT JOIN hits h ON r.raw_unit = h.raw_unit AND h.r = 1""",
    "province_from_domain": STEPS + f""", {_PROVINCES}, slugs AS (SELECT replace(replace(plain, ' ', ''), '-', '') AS slug, current FROM dim UNION SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in SLUGS.items())}) AS t(slug, current)),
        c AS (SELECT source, split_part(email, '@', 2) AS domain, count(*) AS n, min(row_pos) AS p FROM valid GROUP BY ALL),
        t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM c),
        g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, p) AS r FROM t WHERE ends_with(domain, '.gov.vn'))
        , one AS (SELECT slug, max(current) AS current FROM slugs GROUP BY slug)
        SELECT g.source, g.domain, current AS province FROM g LEFT JOIN one ON slug = string_split(g.domain, '.')[-3] WHERE r = 1 AND n >= 3 AND n >= 0.5 * total""",
    "freetext_contacts": f"""SELECT doc_id, email, count(*) AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{ADDRESS}'))) AS email FROM documents) GROUP BY ALL""",
    "page_contacts": f"""SELECT page_id, email, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '{ADDRESS}'))) AS email FROM pages) GROUP BY ALL""",
    "search_fold": f"""WITH {REGISTRATIONS} SELECT source, row_pos, raw_name, raw_email FROM registrations
        WHERE contains({fold("coalesce(raw_name, '')")}, 'dung') OR contains({fold("coalesce(raw_email, '')")}, 'dung')""",
    "preview_topk": f"""WITH {REGISTRATIONS} SELECT source, row_pos, raw_name FROM registrations ORDER BY {fold("coalesce(raw_name, '')")} COLLATE "C", source, row_pos LIMIT 200""",
    "used_phones": _MODE1 + """, lost AS (SELECT source, row_pos, status AS reason, raw_phone, phone FROM classified WHERE status <> 'ok' UNION ALL SELECT source, row_pos, 'invalid_email_format', raw_phone, phone FROM cutoff
        UNION ALL SELECT source, row_pos, 'duplicate_email', raw_phone, phone FROM ranked WHERE rank > 1), used AS (SELECT DISTINCT phone FROM ranked WHERE rank = 1 AND phone <> '')
        SELECT source, row_pos, reason, CASE WHEN u.phone IS NULL THEN raw_phone END AS raw_phone, u.phone IS NOT NULL AS phone_conflict FROM lost l LEFT JOIN used u ON l.phone = u.phone""",
    "asof_unit": _GAPS + """ SELECT g.source, g.stt_no, max_by(n.raw_unit, n.stt_no) AS unit FROM gaps g
        LEFT JOIN n ON n.source = g.source AND n.stt_no < g.stt_no AND n.raw_unit <> '' GROUP BY ALL""",
}

#: The same with the rows of all sources as one list.
for _long, _short in (("continuations", "continuation_rows"), ("titles", "group_headers"), ("units", "group_units"), ("labels", "after_stt_label"), ("gaps", "stt_gaps")):
    ORACLE_SQL[f"long_list_{_long}"] = ORACLE_SQL[_short].replace("SELECT n_name AS source", "SELECT 'all' AS source", 1)

# Numbers as people see them.
_LABELS = """, seen AS (SELECT *, last_value(no IGNORE NULLS) OVER (PARTITION BY source ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
    FROM (SELECT source, row_pos, CASE WHEN {0} BETWEEN 1 AND 99999 THEN {0} END AS no FROM registrations)),
  labels AS (SELECT source, row_pos, CASE WHEN no IS NOT NULL THEN no::VARCHAR WHEN prev IS NOT NULL THEN 'sau STT ' || prev ELSE 'đầu bảng' END AS row_label FROM seen)""".format(_ORDINAL)
ORACLE_SQL["issue_labels"] = _MODE1 + _LABELS + f""", lost AS (SELECT source, row_pos, status AS reason, NULL::VARCHAR AS note FROM classified WHERE status <> 'ok' UNION ALL SELECT source, row_pos, 'invalid_email_format', NULL FROM cutoff
    UNION ALL SELECT l.source, l.row_pos, 'duplicate_email', {_NOTE.replace("w.row_pos", "k.row_label")} FROM ranked l JOIN ranked w ON l.email = w.email AND w.rank = 1 JOIN labels k ON k.source = w.source AND k.row_pos = w.row_pos WHERE l.rank > 1)
    SELECT l.source, l.row_pos, k.row_label, reason, note FROM lost l JOIN labels k ON k.source = l.source AND k.row_pos = l.row_pos"""
ORACLE_SQL["template_binding"] = _MODE1 + """ SELECT NULL::VARCHAR AS c0, nullif(name, '') AS c1, email AS c2, NULL::VARCHAR AS c3, nullif(phone, '') AS c4, 'x' AS c5 FROM ranked WHERE rank = 1"""


def _natural(c: str) -> str:
    number = "regexp_replace(x, '^0+(\\d)', '\\1')"
    return f"""array_to_string(list_transform(regexp_extract_all({fold(f"coalesce({c}, '')")}, '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(length({number})::VARCHAR, 5, '0') || {number} ELSE x END), '') COLLATE "C" """


_SORTED = f"WITH {REGISTRATIONS}, n AS (SELECT source, row_pos, stt, row_number() OVER (ORDER BY {_natural('stt')}, source, row_pos) AS nth FROM registrations)"
ORACLE_SQL["preview_natural"] = f"WITH {REGISTRATIONS} SELECT source, row_pos, raw_phone FROM registrations ORDER BY {_natural('raw_phone')} DESC, source, row_pos LIMIT 200"
ORACLE_SQL["preview_next"] = _SORTED + " SELECT source, row_pos, stt FROM n WHERE nth BETWEEN 201 AND 400"
ORACLE_SQL["all_pages"] = _SORTED + " SELECT source, row_pos, stt, nth, (nth + 49) // 50 AS page FROM n"
ORACLE_SQL["filter_counts"] = _MODE1 + f""", lost AS (SELECT raw_name, status AS reason FROM classified WHERE status <> 'ok' UNION ALL SELECT raw_name, 'invalid_email_format' FROM cutoff UNION ALL SELECT raw_name, 'duplicate_email' FROM ranked WHERE rank > 1)
    SELECT count(*) AS total, count(*) FILTER (contains({fold("coalesce(raw_name, '')")}, 'sai dinh') OR reason = 'invalid_email_format') AS filtered FROM lost"""

_SOURCES = f"""WITH {REGISTRATIONS}, {_PROVINCES}, c AS (SELECT source, row_pos % 3 AS sheet_idx, row_pos, raw_email AS value FROM registrations
    UNION ALL SELECT source, 1, row_pos, raw_email FROM registrations WHERE row_pos % 3 = 0 AND row_pos % 4 > 0),
  a AS (SELECT source, sheet_idx, row_pos, unnest(regexp_extract_all(regexp_replace(lower(value), '\\s+', '', 'g'), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_.%+\\-]+@[\\p{{L}}\\p{{M}}\\p{{Nd}}_.\\-]+\\.[\\p{{L}}\\p{{M}}\\p{{Nd}}_]{{2,}}')) AS email FROM c),
  e AS (SELECT source, sheet_idx, email, min(row_pos) AS p FROM a GROUP BY ALL),
  f AS (SELECT *, min(sheet_idx) OVER (PARTITION BY source, email) AS first FROM e),
  g AS (SELECT source, sheet_idx, count(*) AS emails, count(*) FILTER (first < sheet_idx) AS overlap FROM f GROUP BY ALL),
  d AS (SELECT source, split_part(email, '@', 2) AS domain, count(*) AS n, min(p) AS p FROM e GROUP BY ALL),
  t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM d),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, p) AS r FROM t WHERE ends_with(domain, '.gov.vn')),
  slugs AS (SELECT replace(replace(plain, ' ', ''), '-', '') AS slug, current FROM dim UNION SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in SLUGS.items())}) AS t(slug, current)),
  one AS (SELECT slug, max(current) AS current FROM slugs GROUP BY slug),
  s AS (SELECT r.source, current FROM r JOIN one ON slug = string_split(r.domain, '.')[-3] WHERE r = 1 AND n >= 3 AND n >= 0.5 * total),
  o AS (SELECT g.source AS path, g.source || '.xlsx' AS file, 's' || g.sheet_idx AS sheet, emails, overlap, emails >= 3 AND overlap >= 0.5 * emails AS skip, current AS "default" FROM g LEFT JOIN s ON s.source = g.source)"""
ORACLE_SQL["source_relation"] = _SOURCES + " SELECT * FROM o"
ORACLE_SQL["source_bulk_default"] = _SOURCES + """ SELECT path, sheet, skip, CASE WHEN skip THEN "default" ELSE 'Huế' END AS "default" FROM o"""
ORACLE_SQL["csv_ranges"] = f"""WITH {REGISTRATIONS}, n AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY row_pos) - 1 AS nth,
    [row_pos::VARCHAR, stt, raw_name || CASE WHEN row_pos % 3 = 0 THEN ' "x",' || chr(10) || 'y' || chr(10) ELSE '' END, raw_email, raw_phone] AS cs FROM registrations)
  SELECT source, nth AS row_pos, (i - 1)::BIGINT AS col_idx, cs[i] AS value FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS i FROM n) WHERE trim(cs[i]) <> ''"""

# Lists as files hold them. The words and patterns below are written out here, not taken from the code.
_SHEETS = f"""WITH {REGISTRATIONS}, b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_pos) - 1 AS nth, regexp_extract(source, '(\\d+)', 1)::INT % 3 AS v FROM registrations),
  lists AS (SELECT source, nth + v + 1 AS row_pos, CASE v WHEN 0 THEN [stt, raw_name, raw_unit, raw_email, raw_phone] WHEN 1 THEN [stt, raw_email, raw_name, raw_phone, raw_unit] ELSE [stt, raw_name, raw_unit, raw_phone, raw_email] END AS cs FROM b
    UNION ALL SELECT source, v, CASE v WHEN 0 THEN ['STT', 'Họ và tên', 'Đơn vị công tác', 'Email', 'SĐT'] WHEN 1 THEN ['TT', 'E-mail', 'Họ tên', 'Số điện thoại', 'Phòng ban'] ELSE ['Ghi chú', 'Họ và tên', 'Chức vụ', 'Điện thoại', 'Thư điện tử'] END FROM b WHERE nth = 0
    UNION ALL SELECT source, unnest(range(v)), ['', 'Danh sách đăng ký'] FROM b WHERE nth = 0),
  cells AS (SELECT * FROM (SELECT source, row_pos, unnest(range(len(cs))) AS col_idx, unnest(cs) AS value FROM lists) WHERE trim(coalesce(value, '')) <> ''),
  top AS (SELECT *, {fold("value")} AS f, trim({_PLAIN_UNIT.format("value")}) AS k FROM cells WHERE row_pos < 15)"""
_MAIL, _CALL = "mail|thu dien tu|dia chi thu|thu cong vu", "dien thoai|sdt|phone|hotline|tel|di dong|mobile|so dt|zalo|dien loai"
ORACLE_SQL["header_search"] = _SHEETS + f""", n AS (SELECT source, row_pos, col_idx, CASE WHEN regexp_matches(f, '{NOISE_PATTERN}') THEN CASE WHEN trim(regexp_replace(f, '[^a-z0-9 ]', '', 'g')) IN ('stt', 'tt', 'so tt', 'so thu tu', 'thu tu') THEN 'stt' END
      WHEN regexp_matches(f, '{_MAIL}') THEN 'email' WHEN regexp_matches(f, '{_CALL}') THEN 'phone' WHEN regexp_matches(f, 'ten|name') THEN 'name' WHEN regexp_matches(f, 'mat khau|pass|mk') THEN 'password'
      WHEN trim(regexp_replace(f, '[^a-z0-9 ]', '', 'g')) IN ('stt', 'tt', 'so tt', 'so thu tu', 'thu tu') THEN 'stt' END AS field FROM top),
  g AS (SELECT source, row_pos, field, min(col_idx) AS col_idx FROM n WHERE field IS NOT NULL GROUP BY ALL), h AS (SELECT source, min(row_pos) AS header_pos FROM g WHERE field = 'email' GROUP BY source)
  SELECT g.source, header_pos, field, col_idx FROM g JOIN h ON g.source = h.source AND g.row_pos = h.header_pos"""
_RICH = _SHEETS + f""", u AS (SELECT *, CASE WHEN contains(k, 'don vi cong tac') THEN 0 WHEN contains(k, 'don vi') THEN 1 WHEN contains(k, 'phong ban') THEN 2 WHEN contains(k, 'bo phan') THEN 3 WHEN contains(k, 'co quan') THEN 4
      WHEN contains(k, 'noi cong tac') THEN 5 WHEN contains(k, 'chuc vu') THEN 6 WHEN contains(k, 'chuc danh') THEN 7 WHEN contains(k, 'vi tri cong tac') THEN 8 WHEN contains(k, 'vi tri') THEN 9 END AS best FROM top),
  m AS (SELECT source, row_pos, col_idx, k, 'email' AS field, 0 AS rank FROM u WHERE regexp_matches(k, '{_MAIL}') UNION ALL SELECT source, row_pos, col_idx, k, 'phone', 0 FROM u WHERE regexp_matches(k, '{_CALL}')
    UNION ALL SELECT source, row_pos, col_idx, k, 'name', 0 FROM u WHERE best IS NULL AND regexp_matches(k, 'ho va ten|ho ten|ten tai khoan|full name|hoten|ten nguoi dung') UNION ALL SELECT source, row_pos, col_idx, k, 'stt', 0 FROM u WHERE contains(k, 'tt')
    UNION ALL SELECT source, row_pos, col_idx, k, 'unit', best FROM u WHERE best IS NOT NULL),
  o AS (SELECT *, row_number() OVER (PARTITION BY source, row_pos, field ORDER BY rank, col_idx) AS nth FROM m),
  p AS (SELECT source, row_pos, col_idx, k, CASE WHEN nth = 1 THEN field WHEN nth = 2 AND field = 'email' THEN 'email_alt' END AS field FROM o),
  q AS (SELECT source, row_pos, col_idx, field FROM p WHERE field IS NOT NULL UNION ALL SELECT t.source, t.row_pos, t.col_idx, 'unit2' FROM top t JOIN p ON p.field = 'unit' AND p.source = t.source AND p.row_pos = t.row_pos AND t.col_idx = p.col_idx + 1 AND t.k = p.k),
  r AS (SELECT source, row_pos AS header_pos, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, row_pos) AS r FROM q GROUP BY source, row_pos HAVING bool_or(field IN ('name', 'email'))),
  found AS (SELECT q.source, header_pos, field, col_idx FROM q JOIN r ON r.r = 1 AND q.source = r.source AND q.row_pos = r.header_pos)"""
ORACLE_SQL["header_search_units"] = _RICH + " SELECT source, header_pos, field, col_idx FROM found"
ORACLE_SQL["sheet_rows"] = f"""WITH {REGISTRATIONS}, b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_pos) - 1 AS nth, regexp_extract(source, '(\\d+)', 1)::INT % 3 AS v FROM registrations)
  SELECT source, nth + v + 1 AS row_pos, CASE WHEN v < 2 AND trim(stt) <> '' THEN stt END AS stt, CASE WHEN trim(raw_name) <> '' THEN raw_name END AS name, CASE WHEN trim(raw_unit) <> '' THEN raw_unit END AS unit,
    CASE WHEN trim(raw_email) <> '' THEN raw_email END AS email, CASE WHEN trim(raw_phone) <> '' THEN raw_phone END AS phone FROM b"""
ORACLE_SQL["paged_tables"] = f"""WITH {REGISTRATIONS}, b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_pos) - 1 AS nth FROM registrations), t AS (SELECT *, nth // 40 AS t FROM b),
  r AS (SELECT source, t, nth % 40 + 1 AS row_pos, coalesce(stt, '') || '|' || coalesce(raw_name, '') || '|' || coalesce(raw_email, '') || CASE WHEN t // 2 % 2 = 0 THEN '|' || coalesce(raw_unit, '') ELSE '' END AS cells FROM t
    UNION ALL SELECT source, t, 0, 'STT|Họ tên|Email' || CASE WHEN t // 2 % 2 = 0 THEN '|Đơn vị' ELSE '' END FROM t WHERE nth % 40 = 0 AND t % 2 = 0)
  SELECT source, t // 2 + 1 AS logical_id, row_pos + 41 * (t % 2) AS row_pos, cells FROM r"""
ORACLE_SQL["text_people"] = f"""WITH {REGISTRATIONS}, b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_pos) - 1 AS nth FROM registrations)
  SELECT source, nth AS row_pos, trim(raw_name) AS raw_name, CASE WHEN trim(raw_email) <> '' THEN strip_accents(trim(raw_email)) END AS raw_email, CASE WHEN trim(raw_phone) <> '' THEN trim(raw_phone) END AS raw_phone FROM b"""
ORACLE_SQL["lost_rows"] = STEPS + f""", k AS (SELECT *, {_ORDINAL} AS no FROM valid WHERE phone <> ''), known AS (SELECT * FROM k WHERE no BETWEEN 1 AND 99999), most AS (SELECT source, max(no) AS most FROM known WHERE row_pos % 5 > 0 GROUP BY source)
  SELECT k.source, no AS stt_no, name AS raw_name, 'Phòng Mẫu' AS raw_unit, email AS raw_email, phone AS raw_phone FROM known k JOIN most m ON k.source = m.source AND no < most WHERE row_pos % 5 = 0"""
_STT_WARNINGS = f"""stt AS (SELECT source, CASE WHEN {_ORDINAL} BETWEEN 1 AND 99999 THEN {_ORDINAL} END AS no FROM registrations), most AS (SELECT source, max(no) AS most FROM stt GROUP BY source),
  gaps AS (SELECT source, no FROM (SELECT source, unnest(generate_series(1, most)) AS no FROM most WHERE most IS NOT NULL) EXCEPT SELECT source, no FROM stt),
  told AS (SELECT g.source, count(*) AS n, any_value(most) AS most, list(no ORDER BY no) AS nos FROM gaps g JOIN most m ON g.source = m.source GROUP BY g.source),
  stt_told AS (SELECT source, CASE WHEN n > 0.3 * most THEN 'stt_sparse' ELSE 'stt_gap' END AS code, CASE WHEN n > 0.3 * most THEN 'STT thưa: thiếu ' || n || '/' || most
    ELSE 'STT nhảy số: thiếu ' || array_to_string(nos[1:15], ', ') || CASE WHEN n > 15 THEN '... (tổng ' || n || ')' ELSE '' END END AS message FROM told)"""
_BLANK_PHONES = "SELECT source, 'no_phone', 'Không có số điện thoại nào trong ' || count(*) || ' bản ghi - kiểm tra tiêu đề cột SĐT' FROM ranked GROUP BY source HAVING count(*) >= 3 AND count(*) FILTER (phone <> '') = 0"
ORACLE_SQL["mode1_warnings"] = f"{_MODE1}, {_STT_WARNINGS} SELECT * FROM stt_told UNION ALL {_BLANK_PHONES} UNION ALL SELECT DISTINCT '', 'typo_domain_fixed', '@' || old || ' → @' || new FROM v_f"
ORACLE_SQL["mode2_warnings"] = f"""{_MODE2}, {_STT_WARNINGS}, {_UNITS},
  slugs AS (SELECT replace(replace(plain, ' ', ''), '-', '') AS slug, current FROM dim UNION SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in SLUGS.items())}) AS t(slug, current)), one AS (SELECT slug, max(current) AS current FROM slugs GROUP BY slug),
  dd AS (SELECT source, split_part(email, '@', 2) AS domain, count(*) AS n, min(row_pos) AS p FROM ranked GROUP BY ALL), dt AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM dd),
  dr AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, p) AS r FROM dt WHERE ends_with(domain, '.gov.vn') AND len(string_split(domain, '.')) >= 3)
  SELECT * FROM stt_told UNION ALL {_BLANK_PHONES} UNION ALL SELECT source, 'typo_domain_fixed', '@' || old || ' → @' || new FROM v_f
  UNION ALL SELECT r.source, 'no_unit', 'Không có Đơn vị nào trong ' || count(*) || ' bản ghi - kiểm tra cột Đơn vị công tác' FROM ranked r LEFT JOIN unit u ON r.raw_unit IS NOT DISTINCT FROM u.raw_unit GROUP BY r.source HAVING count(*) >= 3 AND count(*) FILTER (don_vi <> '') = 0
  UNION ALL SELECT source, 'province_mismatch', 'Email phổ biến @' || domain || ' gợi ý ' || current || ', nhưng Tổ chức mặc định đang là Cần Thơ' FROM dr JOIN one ON slug = string_split(domain, '.')[-3] WHERE r = 1 AND n >= 3 AND n >= 0.5 * total AND current <> 'Cần Thơ'"""
ORACLE_SQL["mode1_funnel"] = f"""WITH s AS ({ORACLE_SQL["mode1_stats"]}), l AS (SELECT unnest(['Tổng số dòng đọc được', 'Số dòng có email hợp lệ', 'Số dòng thiếu email', 'Số dòng email sai định dạng', 'Số dòng trùng email', 'Còn lại sau cùng']) AS line,
    unnest([total_rows, valid_rows, missing_email, invalid_email_format, duplicates_removed, final_count]) AS n FROM s) SELECT line, replace(format('{{:,}}', n), ',', '.') AS n FROM l"""
ORACLE_SQL["mode1_layout"] = _MODE1 + """ SELECT email AS "Email", 'x' AS "Mật khẩu", nullif(name, '') AS "Họ và tên", nullif(phone, '') AS "Điện thoại" FROM ranked WHERE rank = 1"""
ORACLE_SQL["mode2_layout"] = _MODE2_RECORDS + """ SELECT nullif(name, '') AS "Tên tài khoản", email AS "Email", nullif(phone, '') AS "SĐT", NULL::VARCHAR AS "Mật khẩu", NULL::VARCHAR AS "Giới tính", NULL::VARCHAR AS "Ngày sinh",
    nullif(don_vi, '') AS "Đơn vị", nullif(to_chuc, '') AS "Tổ chức" FROM records"""
ORACLE_SQL["issue_sheet"] = f"""WITH i AS ({ORACLE_SQL["mode1_issues"]}) SELECT source AS "Tệp nguồn", stt AS "STT", raw_name AS "Họ và tên (gốc)", raw_email AS "Email (gốc)", raw_phone AS "Điện thoại (gốc)",
    CASE reason WHEN 'missing_email' THEN 'Thiếu email' WHEN 'invalid_email_format' THEN 'Email sai định dạng' ELSE 'Trùng email' END AS "Lý do", note AS "Ghi chú" FROM i"""
_SHOWN = "CASE WHEN regexp_matches(trim({0}), '^-?\\d+\\.\\d+$') AND abs(TRY_CAST(trim({0}) AS DOUBLE) - round(TRY_CAST(trim({0}) AS DOUBLE))) < 1e-6 THEN round(TRY_CAST(trim({0}) AS DOUBLE))::BIGINT::VARCHAR ELSE trim(coalesce({0}, '')) END"
ORACLE_SQL["shown_cells"] = f"WITH {REGISTRATIONS} SELECT source, row_pos, {_SHOWN.format('stt')} AS stt, {_SHOWN.format('raw_phone')} AS phone FROM registrations"
_BOOK = f"""WITH {REGISTRATIONS}, c AS (SELECT source, row_pos % 3 AS sheet_idx, raw_email AS value FROM registrations UNION ALL SELECT source, 1, raw_email FROM registrations WHERE row_pos % 3 = 0 AND row_pos % 4 > 0
    UNION ALL SELECT source, 3, raw_name FROM registrations WHERE row_pos % 3 = 0),
  e AS (SELECT DISTINCT source, sheet_idx, unnest(regexp_extract_all(regexp_replace(lower(value), '\\s+', '', 'g'), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_.%+\\-]+@[\\p{{L}}\\p{{M}}\\p{{Nd}}_.\\-]+\\.[\\p{{L}}\\p{{M}}\\p{{Nd}}_]{{2,}}')) AS email FROM c),
  f AS (SELECT *, min(sheet_idx) OVER (PARTITION BY source, email) AS first FROM e), g AS (SELECT source, sheet_idx, count(*) AS emails, count(*) FILTER (first < sheet_idx) AS overlap FROM f GROUP BY ALL)"""
ORACLE_SQL["sheet_warnings"] = _BOOK + """ SELECT source, 'sheet_skipped' AS code, source || '.xlsx [Sheet: s' || sheet_idx || ']: bỏ qua sheet này vì trùng ' || overlap || '/' || emails || ' email với sheet trước; ' || (emails - overlap) || ' email mới trong sheet không được đọc' AS message
    FROM g WHERE emails >= 3 AND overlap >= 0.5 * emails"""
ORACLE_SQL["sheets_read"] = _BOOK + " SELECT c.source, c.sheet_idx, count(value) AS n FROM c JOIN g ON c.source = g.source AND c.sheet_idx = g.sheet_idx WHERE NOT (emails >= 3 AND overlap >= 0.5 * emails) GROUP BY ALL"
# A cut row can begin at its own word, or at a whole address of its page that starts like it.
ORACLE_SQL["cut_emails"] = STEPS + """, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_pos) - 1 AS nth FROM valid), p AS (SELECT *, nth // 30 AS page, split_part(email, '@', 1) AS head, split_part(email, '@', 2) AS domain FROM k),
  d AS (SELECT source, domain, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(row_pos)) AS r, count(*) AS n FROM p WHERE nth % 6 > 0 GROUP BY source, domain),
  c AS (SELECT p.*, d.domain AS wanted FROM p JOIN d ON d.source = p.source AND d.r = 1 AND d.n >= 3 WHERE nth % 6 = 0 AND length(head) >= 3 AND regexp_matches(head, '[a-z]')),
  v AS (SELECT source, page, head, row_pos, nth AS y, 1 AS good, email FROM c WHERE domain = wanted
    UNION ALL SELECT c.source, c.page, c.head, c.row_pos, o.nth, (substr(o.email, length(c.head) + 1, 1) IN ('.', '@'))::INT, o.email FROM c JOIN p o ON o.source = c.source AND o.page = c.page AND o.nth % 6 > 0 AND starts_with(o.email, c.head) AND o.domain = c.wanted),
  r AS (SELECT *, dense_rank() OVER (PARTITION BY source, page, head ORDER BY row_pos) AS a, dense_rank() OVER (PARTITION BY source, page, head ORDER BY good DESC, y) AS b FROM v)
  SELECT source, row_pos, 2::BIGINT AS col_idx, email FROM (SELECT *, row_number() OVER (PARTITION BY source, page, y ORDER BY row_pos) AS first FROM r WHERE a = b) WHERE first = 1"""
