"""The queries' SQL, in DuckDB's dialect, built from the same fixed values."""

from __future__ import annotations

from quillforge.functions.text import SAMPLE
from quillforge.operators import checks as k
from quillforge.operators import repair as rp
from quillforge.sources import candidates as s


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines(x: str) -> str:
    parts = f"string_split({x}, chr(10))"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def _convert(text: str) -> str:
    paragraphs = f"list_filter(list_transform(string_split({text}, chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: p <> '')"
    structured = f"len(list_filter({_lines('p')}, lambda x: regexp_matches(x, {q(s.LIST_LINE)}) OR regexp_matches(x, {q(s.FIELD_LINE)}))) > 0"
    body = f"list_transform({paragraphs}, lambda p: (CASE WHEN {structured} THEN p ELSE array_to_string({_lines('p')}, ' ') END) || chr(10))"
    head = "'# Document ' || doc_id || chr(10) || chr(10) || '**Source:** doc-' || doc_id || '.txt' || chr(10) || chr(10)"
    return f"({head} || CASE WHEN len({body}) > 0 THEN chr(10) || array_to_string({body}, chr(10)) ELSE '' END)"


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_SLICED = f"array_to_string(list_transform(range(0, greatest(((len(w) - 1) // {s.SLICE_WORDS}), 0) + 1), lambda i: array_to_string(w[i * {s.SLICE_WORDS} + 1 : i * {s.SLICE_WORDS} + {s.SLICE_WORDS}], ' ')), chr(10) || chr(10))"
_DAMAGE = "[" + ", ".join(q(d) for d in s.DAMAGE) + f"][doc_id % {len(s.DAMAGE)} + 1]"

CANDIDATES = f"""
base AS (SELECT doc_id, text, {_convert('text')} AS clean, {_WORDS} AS w FROM documents),
sliced AS (SELECT doc_id, text, clean, {_SLICED} AS t7 FROM base),
cands AS (
  SELECT doc_id, text AS source_text, unnest([
    {{'adapter': 'damaged', 'status': 'ok', 'md': clean || {_DAMAGE}}},
    {{'adapter': 'failed', 'status': 'timeout', 'md': clean}},
    {{'adapter': 'garbled', 'status': 'ok', 'md': translate(clean, {q(s.GARBLED)}, repeat(chr(65533), {len(s.GARBLED)}))}},
    {{'adapter': 'inhouse', 'status': 'ok', 'md': clean}},
    {{'adapter': 'linewise', 'status': 'ok', 'md': {_convert("replace(text, chr(10), chr(10) || chr(10))")}}},
    {{'adapter': 'rowsliced', 'status': 'ok', 'md': {_convert('t7')}}},
    {{'adapter': 'truncated', 'status': 'ok', 'md': left(text, {s.TRUNCATED_CHARS})}}
  ], recursive := true) FROM sliced
)"""


def _places(test: str) -> str:
    return f"list_filter(range(1, len(ls) + 1), lambda i: {test})"


_ROWS = f"list_filter(list_transform(ls, lambda x, i: {{'at': i, 'n': regexp_extract(x, {q(k.NUMBERED)}, 1), 'b': regexp_matches(x, '^\\s*$')}}), lambda r: NOT r.b)"
_GAP = "rows[i].n <> '' AND rows[i-1].n <> '' AND NOT (rows[i].at - rows[i-1].at > 1 AND TRY_CAST(rows[i].n AS BIGINT) = 1) AND TRY_CAST(rows[i].n AS BIGINT) <> TRY_CAST(rows[i-1].n AS BIGINT) + 1"
_TAGS = f"regexp_extract_all(md, {q(k.IMG_TAG)})"
_WIDTH = f"TRY_CAST(regexp_extract(t, {q(k.IMG_WIDTH)}, 1) AS DOUBLE)"
_SRC = "regexp_extract(t, '(?i)src\\s*=\\s*\"([^\"]*)\"', 1) || regexp_extract(t, '(?i)src\\s*=\\s*''([^'']*)''', 1)"
_PLAIN = "CASE WHEN starts_with(d, '<') THEN regexp_extract(d, '^<([^>]+)>', 1) ELSE regexp_replace(regexp_extract(d, '^\\S+'), '^[''\"]+|[''\"]+$', '', 'g') END"
_REFS = f"list_filter(list_concat(list_transform({_TAGS}, lambda t: trim({_SRC})), list_transform(list_transform(regexp_extract_all(md, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1), lambda d: trim(d)), lambda d: {_PLAIN})), lambda x: x <> '')"
_BARE = "replace(trim(regexp_replace(r, '(?s)[#?].*$', '')), chr(92), '/')"
_PARTS = "list_filter(string_split(b, '/'), lambda x: x <> '' AND x <> '.')"
_DEPTH = f"list_min(list_transform(range(1, greatest(len({_PARTS}), 1) + 1), lambda n: coalesce(list_sum(list_transform({_PARTS}[1:n], lambda x: CASE WHEN x = '..' THEN -1 ELSE 1 END)), 0)))"
_PROBLEM = (
    f"CASE WHEN b = '' THEN 'empty' WHEN regexp_matches(b, '(?i)^(http://|https://|data:)') THEN NULL WHEN regexp_matches(b, '(?i)^file://') THEN 'file_url' "
    f"WHEN starts_with(b, '/') OR regexp_matches(b, '^[A-Za-z]:/') THEN 'absolute' WHEN {_DEPTH} < 0 THEN 'escapes' WHEN NOT list_contains({s.IMAGES}, array_to_string({_PARTS}, '/')) THEN 'missing' END"
)
_KEY = "CASE WHEN regexp_matches(b, '(?i)^(http://|https://|data:|file://)') THEN b ELSE regexp_extract(b, '([^/]*)/*$', 1) END"
_BAD = "length(md) - length(regexp_replace(md, '[\\p{C}\\x{FFFD}\\p{Z}]', '', 'g')) - length(regexp_replace(md, '[^ \\n\\r\\t]', '', 'g'))"

# Blocks of Markdown without fences, HTML, front matter, rules, quotes, set-off tables and underlined headings, none of which the candidates have.
_KIND = " ".join(["CASE", "WHEN regexp_matches(line, '^\\s*$') THEN 'blank'", *(f"WHEN regexp_matches(line, {q('^(?:' + rp.PATTERNS[x] + ')')}) THEN '{x}'" for x in ("heading", "list_item", "image", "caption")), "WHEN length(line) - length(replace(line, '|', '')) > 1 AND (starts_with(trim(line), '|') OR ends_with(trim(line), '|')) THEN 'table'", "ELSE 'prose' END"])
_ENDED = f"regexp_matches({{}}, {q(rp.PATTERNS['terminal'])})"
_JOINS = f"""NOT {_ENDED.format('before')} AND greatest(length(x), length(before)) >= {rp.MIN_CHARS} AND least(length(x), length(before)) <= {rp.SHORT} AND (regexp_matches(x, '^\\p{{Ll}}') OR right(before, 1) IN (',', ';', ':', '-', '(', '[')
      OR list_contains({sorted(rp.WORDS)}, regexp_extract_all(lower(before), '[a-z][a-z''-]*')[-1]))"""
_SHARE = lambda part, whole: f"coalesce(({part})::DOUBLE / nullif({whole}, 0), 0.0)"

SIGNALS = f"""{CANDIDATES},
marked AS (SELECT doc_id, adapter, i, line, {_KIND} AS kind FROM (SELECT doc_id, adapter, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT doc_id, adapter, {_lines('md')} AS ls FROM cands))),
begun AS (SELECT *, coalesce(kind IN ('heading', 'image', 'caption') OR kind <> lag(kind) OVER w, true) AS fresh FROM marked WINDOW w AS (PARTITION BY doc_id, adapter ORDER BY i)),
numbered AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id, adapter ORDER BY i) AS b FROM begun),
blocks AS (SELECT doc_id, adapter, b, any_value(kind) AS kind, trim(regexp_replace(string_agg(line, ' ' ORDER BY i), '\\s+', ' ', 'g')) AS x FROM numbered WHERE kind <> 'blank' GROUP BY doc_id, adapter, b),
follow AS (SELECT *, CASE WHEN lag(kind) OVER w = 'prose' THEN lag(x) OVER w END AS before FROM blocks WINDOW w AS (PARTITION BY doc_id, adapter ORDER BY b)),
prose AS (SELECT *, before IS NOT NULL AS beside, coalesce({_JOINS}, false) AS joins FROM follow WHERE kind = 'prose'),
chained AS (SELECT *, sum(CAST(NOT joins AS INTEGER)) OVER (PARTITION BY doc_id, adapter ORDER BY b) AS c FROM prose),
chains AS (SELECT doc_id, adapter, max(n) AS longest, count(*) FILTER (n >= {rp.MIN_RUN}) AS runs FROM (SELECT doc_id, adapter, c, count(*) AS n FROM chained GROUP BY ALL) WHERE n > 1 GROUP BY ALL),
each AS (
  SELECT doc_id, adapter, count(*) AS prose, median(length(x))::DOUBLE AS median_chars, avg(CAST(length(x) <= {rp.SHORT} AS INTEGER)) AS short, avg(CAST(NOT {_ENDED.format('x')} AS INTEGER)) AS open,
    {_SHARE(f"count(*) FILTER (beside AND NOT {_ENDED.format('before')} AND regexp_matches(x, '^[[:lower:]]|^\\p{{Ll}}'))", f"count(*) FILTER (beside AND NOT {_ENDED.format('before')})")} AS lower, {_SHARE("count(*) FILTER (joins)", "count(*) FILTER (beside)")} AS pairs
  FROM prose GROUP BY ALL
),
hard AS (SELECT doc_id, adapter, count(*) FILTER (kind <> 'prose') AS structure, {_SHARE("count(*) FILTER (kind <> 'prose')", "count(*)")} AS structure_share FROM blocks GROUP BY ALL),
signs AS (
  SELECT c.doc_id, c.adapter, coalesce(prose, 0) AS prose, coalesce(structure, 0) AS structure, coalesce(median_chars, 0) AS median_chars, coalesce(short, 0) AS short, coalesce(open, 0) AS open, coalesce(lower, 0) AS lower,
    coalesce(pairs, 0) AS pairs, coalesce(runs, 0) AS runs, coalesce(longest, 0) AS longest, coalesce(structure_share, 0) AS structure_share
  FROM cands c LEFT JOIN each USING (doc_id, adapter) LEFT JOIN hard USING (doc_id, adapter) LEFT JOIN chains USING (doc_id, adapter)
),
signals AS (
  SELECT *, CASE {' '.join(f"WHEN {x} {'> ' + str(rp.MAX_STRUCTURE) if x == 'structure_share' else '< ' + str(rp._FLOOR[x])} THEN '{reason}'" for x, reason in rp.REASONS.items())} ELSE '{rp.SLICED}' END AS detection FROM signs
)"""
_PDF = f"doc_id % {s.PDF_EVERY} = 0"

JUDGED = f"""{SIGNALS},
src AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{3,}}'), lambda w: {_fold('w')}))) AS found FROM documents),
smp AS (SELECT doc_id, list_filter(found, lambda w, i: (i - 1) % greatest(len(found) // {SAMPLE}, 1) = 0)[1:{SAMPLE}] AS sample FROM src),
c1 AS (SELECT c.*, sample, {_lines('md')} AS ls, {_REFS} AS refs FROM cands c JOIN smp USING (doc_id)),
c2 AS (SELECT *, {_ROWS} AS rows, list_transform(refs, lambda r: {_BARE}) AS bare FROM c1),
judged AS (
  SELECT doc_id, adapter, status, md, source_text, bare, length({_strip('md')}) AS chars,
    CASE WHEN length(md) < {k.PRINTABLE_FROM} THEN 1.0::DOUBLE ELSE 1 - ({_BAD})::DOUBLE / length(md) END AS printable,
    CASE WHEN {_PDF} AND len(sample) > 0 THEN len(list_filter(sample, lambda w: contains({_fold('md')}, w)))::DOUBLE / len(sample) ELSE 1.0::DOUBLE END AS coverage,
    len(regexp_extract_all(md, {q(k.DOUBLE_BULLET)})) AS n_double_bullets,
    len(list_filter(range(2, len(rows) + 1), lambda i: coalesce({_GAP}, false))) AS n_list_gaps,
    len(list_filter(range(1, len(ls)), lambda i: regexp_matches(ls[i], {q(k.HEADING)}) AND NOT regexp_matches(regexp_extract(ls[i], {q(k.HEADING)}, 2), '[.?!:]$') AND regexp_matches({_strip('ls[i+1]')}, '^\\p{{Ll}}') AND length({_strip('ls[i+1]')}) < {k.FRAGMENT_CHARS})) AS n_fragmented,
    len(list_filter({_places(f"regexp_matches(ls[i], {q(k.CAPTION)})")}, lambda c: len(list_filter({_places(f"regexp_matches(ls[i], {q(k.IMG_TAG)})")}, lambda g: abs(g - c) <= {k.CAPTION_REACH})) = 0)) AS n_captions,
    len(list_filter({_places(f"regexp_matches(ls[i], {q(k.BOX)})")}, lambda b: len(list_filter(ls[b+1 : b+{k.BOX_REACH}], lambda x: {_strip('x')} <> '' AND NOT starts_with({_strip('x')}, '#'))) = 0)) AS n_boxes,
    len(list_filter({_TAGS}, lambda t: {_WIDTH} IS NULL OR {_WIDTH} <= 0 OR {_WIDTH} > {k.MAX_EM})) AS n_sizes,
    len(list_filter(list_distinct(heads), lambda h: len(list_filter(heads, lambda x: x = h)) >= {k.REPEATED})) AS n_repeated,
    len(list_filter(bare, lambda b: {_PROBLEM} IS NOT NULL)) AS n_unresolved,
    len(list_distinct(list_transform(bare, lambda b: {_KEY}))) AS n_refs,
    CASE WHEN {_PDF} THEN len(sample) - len(list_filter(sample, lambda w: contains({_fold('md')}, w))) ELSE 0 END AS n_missing_words, coalesce(sliced, 0) AS n_sliced
  FROM (SELECT *, list_filter(list_transform(regexp_extract_all(md, {q('(?m)' + k.HEADING)}, 2), lambda x: {_strip('x')}), lambda x: x <> '') AS heads FROM c2) LEFT JOIN (SELECT doc_id, adapter, CAST(detection = '{rp.SLICED}' AS BIGINT) AS sliced FROM signals) USING (doc_id, adapter)
)"""

GATED = f"""{JUDGED},
gated AS (
  SELECT *, CASE WHEN status <> 'ok' THEN 'adapter_run_status' WHEN chars < {k.MIN_CHARS} THEN 'not_empty' WHEN n_unresolved > 0 THEN 'no_broken_image_refs'
    WHEN printable < {k.MIN_PRINTABLE} THEN 'charset_plausible' WHEN coverage < {k.MIN_COVERAGE} THEN 'text_coverage_minimum' END AS first_failure FROM judged
)"""


def _score(name: str, status: str, issues: str, kind: str = "", grade: str = "") -> str:
    weight, _, cut, violation, severity, _ = k.CHECKS[name]
    details = f"least({issues}, {k.MAX_DETAILS})" if cut else issues
    times = str(k.MULTIPLIERS[name]) if name in k.MULTIPLIERS else f"greatest(least({details}, {k.MULTIPLIER_CAP}), 1)"
    return (
        f"{{'name': '{name}', 'status': {status}, 'issues': CAST({issues} AS BIGINT), 'score': CAST({weight} * (CASE {status} WHEN 'fail' THEN {k.SEVERITY['fail']} WHEN 'warn' THEN {k.SEVERITY['warn']} ELSE 0 END) * {times} AS DOUBLE), "
        f"'violation': CASE WHEN {status} <> 'pass' THEN {kind or q(violation)} END, 'severity': CASE WHEN {status} <> 'pass' THEN {grade or q(severity)} END}}"
    )


_ENTRIES = [_score(n, f"(CASE WHEN {m} > 0 THEN '{k.CHECKS[n][1]}' ELSE 'pass' END)", m) for n, m in k._MEASURES.items()]
_DIFF = f"(CASE WHEN {_PDF} THEN n_refs - {len(s.IMAGES)} ELSE 0 END)"
_COUNTED = f"(CASE abs({_DIFF}) WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' ELSE 'fail' END)"
_COVERED = f"(CASE WHEN coverage >= {k.COVERAGE_PASS} THEN 'pass' WHEN coverage < {k.COVERAGE_FAIL} THEN 'fail' ELSE 'warn' END)"
_GRADE = "CASE {} WHEN 'fail' THEN 'major' ELSE 'minor' END"
_ENTRIES.append(_score("image_count_match", _COUNTED, f"(CASE WHEN {_DIFF} <> 0 THEN 1 ELSE 0 END)", f"CASE WHEN {_DIFF} < 0 THEN 'missing_content' ELSE 'duplicated_content' END", _GRADE.format(_COUNTED)))
_ENTRIES.append(_score("text_coverage", _COVERED, "n_missing_words", "", _GRADE.format(_COVERED)))

CHECKED = f"""{GATED},
checked AS (SELECT *, [{', '.join(_ENTRIES)}] AS checks FROM gated)"""

SCORED = f"""{CHECKED},
scored AS (
  SELECT doc_id, adapter, first_failure, length(md) AS md_chars, list_filter(checks, lambda x: x.name = 'images_locally_resolvable')[1].score AS image_score, list_sum(list_transform(checks, lambda x: x.score)) AS total_score,
    len(list_filter(checks, lambda x: x.status = 'fail')) AS fail_count, len(list_filter(checks, lambda x: x.status = 'warn')) AS warn_count, len(list_filter(checks, lambda x: x.status = 'pass')) AS pass_count
  FROM checked
),
ranked AS (
  SELECT *, row_number() OVER w AS rank, first_value(total_score) OVER w AS best, lead(total_score) OVER w AS next_score
  FROM scored WHERE first_failure IS NULL WINDOW w AS (PARTITION BY doc_id ORDER BY total_score, adapter)
)"""

_BUCKET = "CASE WHEN pages <= 0 THEN 'unknown pages' WHEN pages = 1 THEN '1 page' WHEN pages <= 10 THEN '2-10 pages' WHEN pages <= 50 THEN '11-50 pages' WHEN pages <= 100 THEN '51-100 pages' WHEN pages <= 1000 THEN '101-1000 pages' ELSE '1000+ pages' END"

OBSERVED = f"""{SCORED},
obs AS (
  SELECT c.doc_id, c.adapter, c.status, CAST(len(string_split(c.source_text, chr(10))) // 2 AS BIGINT) AS pages, CASE WHEN c.adapter = 'garbled' THEN 0 ELSE length(c.md) * 7 % 100000 END AS timing_ms,
    r.total_score AS score, r.rank = 1 AS won, g.first_failure FROM cands c LEFT JOIN ranked r USING (doc_id, adapter) JOIN scored g USING (doc_id, adapter)
),
grouped AS (
  SELECT bucket, adapter, count(*) AS attempts, CAST(sum(greatest(pages, 0)) AS BIGINT) AS total_pages, CAST(sum(CASE WHEN timing_ms > 0 THEN timing_ms END) AS DOUBLE) AS total_ms,
    count(*) FILTER (status = 'ok') AS raw_successes, count(score) AS gate_passes, count(*) FILTER (won) AS wins,
    median(CAST(CASE WHEN timing_ms > 0 THEN timing_ms END AS DOUBLE)) AS median_ms, avg(score) AS mean_score
  FROM (SELECT *, {_BUCKET} AS bucket FROM obs) GROUP BY GROUPING SETS ((bucket, adapter), (adapter))
),
matrix AS (
  SELECT coalesce(bucket, 'all') AS bucket, adapter, attempts, total_pages, raw_successes, gate_passes, wins, total_ms, median_ms, mean_score,
    CAST(gate_passes AS DOUBLE) / attempts AS gate_pass_rate, CASE WHEN total_ms > 0 AND total_pages > 0 THEN total_pages / (total_ms / 1000) END AS pages_per_second FROM grouped
)"""

_TIER = """CASE WHEN mean_score IS NULL OR gate_pass_rate <= 0 THEN 'failed' WHEN gate_pass_rate < 0.5 THEN 'poor'
    WHEN mean_score <= 10 THEN CASE WHEN gate_pass_rate >= 0.95 THEN 'high' WHEN gate_pass_rate >= 0.8 THEN 'medium' ELSE 'low' END
    WHEN mean_score <= 50 THEN CASE WHEN gate_pass_rate < 0.8 THEN 'low' ELSE 'medium' END WHEN mean_score <= 100 THEN 'low' ELSE 'poor' END"""
_SIGNAL = """CASE WHEN raw_successes = 0 THEN 'not_available_or_unsupported' WHEN wins > 0 THEN 'keep_default_candidate'
    WHEN coalesce(total_ms >= 120000, false) OR coalesce(median_ms >= 30000, false) OR coalesce(pages_per_second <= 1, false) THEN 'move_to_optional_candidate' ELSE 'watch_no_wins' END"""


def measure(column: str) -> str:
    return f"WITH {JUDGED} SELECT doc_id, adapter, {column} FROM judged"


_MATH = "(?i)\\\\frac|\\\\sum|\\\\int|\\\\alpha|\\\\beta|\\\\theta|\\$[^$]{1,60}\\$|(?:^|[^\\w])(sin|cos|tan|log|lim)\\s*[({]"

ORACLE_SQL = {
    "txt_convert": f"SELECT doc_id, {_convert('text')} AS md FROM documents",
    "candidates": f"WITH {CANDIDATES} SELECT adapter, status, count(*) AS n, CAST(sum(length(md)) AS BIGINT) AS chars FROM cands GROUP BY ALL",
    "doc_traits_txt": f"SELECT doc_id, len({_WORDS}) AS word_count, CASE WHEN len(list_filter({_lines('text')}, lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 3 THEN 1 ELSE 0 END AS table_count, false AS is_table_heavy, regexp_matches(text, {q(_MATH)}) AS has_math FROM documents",
    "page_traits_html": f"SELECT page_id, image_count, table_count, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) AS word_count, image_count >= 5 AS is_image_heavy, table_count >= 2 AS is_table_heavy, image_count = 0 AS is_text_only, regexp_matches(body, {q(_MATH)}) AS has_math FROM (SELECT page_id, len(regexp_extract_all(html, '(?i)<img\\b')) AS image_count, len(regexp_extract_all(html, '(?i)<table\\b')) AS table_count, regexp_replace(html, '<[^>]+>', ' ', 'g') AS body FROM pages)",
    "gate_not_empty": f"WITH {JUDGED} SELECT doc_id, adapter, chars, chars >= {k.MIN_CHARS} AS passed FROM judged",
    "gate_charset": f"WITH {JUDGED} SELECT doc_id, adapter, printable, printable >= {k.MIN_PRINTABLE} AS passed FROM judged",
    "gate_image_refs": f"WITH {JUDGED} SELECT doc_id, adapter, n_unresolved, n_unresolved = 0 AS passed FROM judged",
    "gate_coverage": f"WITH {JUDGED} SELECT doc_id, adapter, coverage, coverage >= {k.MIN_COVERAGE} AS passed FROM judged",
    "gate_status": f"WITH {CANDIDATES} SELECT doc_id, adapter, status = 'ok' AS passed FROM cands",
    "gate_first_failure": f"WITH {GATED} SELECT doc_id, adapter, first_failure FROM gated",
    "text_coverage": f"WITH {CHECKED} SELECT doc_id, adapter, coverage, n_missing_words, checks[11].status AS status FROM checked",
    "check_double_bullets": measure("n_double_bullets"), "check_numbered_lists": measure("n_list_gaps"), "check_fragmented_headings": measure("n_fragmented"), "check_caption_near_image": measure("n_captions"),
    "check_row_sliced": measure("n_sliced"), "check_box_content": measure("n_boxes"), "check_image_size": measure("n_sizes"), "check_repeated_headings": measure("n_repeated"), "check_images_resolvable": measure("n_unresolved"),
    "paragraph_signals": f"WITH {SIGNALS} SELECT doc_id, adapter, prose::DOUBLE AS prose, structure::DOUBLE AS structure, median_chars::DOUBLE AS median_chars, short::DOUBLE AS short, open::DOUBLE AS open, lower::DOUBLE AS lower, pairs::DOUBLE AS pairs, runs::DOUBLE AS runs, longest::DOUBLE AS longest, structure_share::DOUBLE AS structure_share, detection FROM signals JOIN cands USING (doc_id, adapter) WHERE status = 'ok'",
    "image_refs": f"WITH {JUDGED} SELECT doc_id, adapter, b AS ref, {_KEY} AS ref_key, {_PROBLEM} AS problem FROM (SELECT doc_id, adapter, unnest(bare) AS b FROM judged)",
    "image_count_match": f"WITH {CHECKED} SELECT doc_id, adapter, n_refs, checks[10].status AS status FROM checked",
    "check_scores": f"WITH {CHECKED} SELECT doc_id, adapter, x.name AS check_name, x.status AS status, x.issues AS issues, x.score AS score, x.violation AS violation, x.severity AS severity FROM (SELECT doc_id, adapter, unnest(checks) AS x FROM checked)",
    "check_totals": f"WITH {CHECKED} SELECT x.name AS check_name, x.status AS status, count(*) AS n, sum(x.score) AS score FROM (SELECT unnest(checks) AS x FROM checked) GROUP BY ALL",
    "scorecards": f"WITH {SCORED} SELECT doc_id, adapter, total_score, fail_count, warn_count, pass_count, image_score FROM scored",
    "ranking": f"WITH {SCORED} SELECT doc_id, adapter, total_score, CAST(rank AS INTEGER) AS rank FROM ranked",
    "winners": f"WITH {SCORED} SELECT doc_id, adapter AS winner, total_score AS winning_score FROM ranked WHERE rank = 1",
    "near_ties": f"WITH {SCORED} SELECT doc_id, adapter, total_score - best AS delta FROM ranked WHERE rank > 1 AND total_score - best <= 10.0",
    "next_ranked_score": f"WITH {SCORED} SELECT doc_id, adapter, total_score, next_score FROM ranked",
    "disqualified": f"WITH {SCORED} SELECT first_failure, count(*) AS n, count(DISTINCT doc_id) AS docs FROM scored WHERE first_failure IS NOT NULL GROUP BY 1",
    "run_status_semi_join": f"WITH {CANDIDATES}, ok AS (SELECT doc_id, adapter FROM cands WHERE status = 'ok') SELECT doc_id, adapter, length(md) AS md_chars FROM cands SEMI JOIN ok USING (doc_id, adapter)",
    "promotion": f"WITH {SCORED} SELECT c.doc_id, c.adapter, sha256(c.md) AS md_sha256, c.images FROM (SELECT *, {s.IMAGES} AS images FROM cands) c JOIN ranked r USING (doc_id, adapter) WHERE rank = 1",
    "observations": f"WITH {OBSERVED} SELECT doc_id, adapter, status, pages, timing_ms, score, coalesce(won, false) AS won, first_failure FROM obs",
    "matrix_grouping_sets": f"WITH {OBSERVED} SELECT bucket, adapter, attempts, total_pages, raw_successes, gate_passes, wins, total_ms, median_ms, round(mean_score, 6) AS mean_score, round(pages_per_second, 6) AS pages_per_second FROM matrix",
    "quality_tiers": f"WITH {OBSERVED} SELECT bucket, adapter, {_TIER} AS quality_tier, {_SIGNAL} AS default_set_signal FROM matrix",
}
