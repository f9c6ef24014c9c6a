"""DuckDB counterparts of the registered queries.

Written on their own, without the look-arounds and possessive quantifiers the Spark side
uses, so that the two sides agree for a reason.
"""

from __future__ import annotations

from ..operators import documents as d
from ..operators import findings as fd
from ..operators import selection as sel
from ..functions.markdown import STOPWORDS
from ..functions.segments import SYSTEM_KEEP_WORDS
from .queries import AS_OF, DEBT_AS_OF, ROLES

ORACLES: dict[str, str] = {}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + _list(values)[1:-1] + ")"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _ext(path: str = "path") -> str:
    return f"lower(regexp_extract({path}, '(\\.[^./]*)$', 1))"


# A: file selection

_RULES = """
rules AS (
  SELECT project, origin_ord, line, body, starts_with(txt, '!') AS negated FROM (
    SELECT project, origin_ord, line, txt, regexp_replace(txt, '^!', '') AS body FROM (
      SELECT project, origin_ord, unnest(range(1, len(parts) + 1)) AS line, trim(unnest(parts)) AS txt
      FROM (SELECT project, origin_ord, string_split(content, chr(10)) AS parts FROM fx_ignore_files)
    ) WHERE txt <> '' AND NOT starts_with(txt, '#')
  )
)"""
ORACLES["a02_ignore_rules"] = f"""WITH {_RULES}
SELECT project, origin_ord, line, regexp_replace(body, '/$', '') AS pattern, negated, ends_with(body, '/') AS dir_only FROM rules
"""

# The regular expressions of the patterns in the view, worked out by hand.
_IGNORED = f"""{_RULES},
meaning(body, rx) AS (VALUES
  ('node_modules', '(^|/)node_modules(/|$)'), ('dist', '(^|/)dist(/|$)'), ('*.log', '(^|/)[^/]*[.]log(/|$)'),
  ('build/', '(^|/)build/'), ('logs/f*.log', '^logs/f[^/]*[.]log(/|$)'), ('/docs/', '^docs/'),
  ('src/**/f*.ts', '^src/([^/]*/)*f[^/]*[.]ts(/|$)'), ('f?.md', '(^|/)f[^/][.]md(/|$)'), ('[l-m]ib', '(^|/)[l-m]ib(/|$)'),
  ('readme*', '(^|/)readme[^/]*(/|$)'), ('readme59.md', '(^|/)readme59[.]md(/|$)')),
steps AS (
  SELECT project, path, unnest(list_concat([path],
    list_transform(range(1, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/') || '/'))) AS step
  FROM fx_files
),
decided AS (
  SELECT s.project, s.path, s.step, arg_max(NOT r.negated, r.origin_ord * 1000 + r.line) AS dropped
  FROM steps s JOIN rules r ON r.project = s.project JOIN meaning m ON m.body = r.body AND regexp_matches(s.step, m.rx)
  GROUP BY ALL
),
gone AS (SELECT DISTINCT project, path FROM decided WHERE dropped)"""
_NO_VCS = "NOT regexp_matches(path, '(^|/)[.]git/')"
ORACLES["a03_ignore_filter"] = f"""WITH {_IGNORED}
SELECT f.project, f.path, f.length FROM fx_files f ANTI JOIN gone g ON f.project = g.project AND f.path = g.path WHERE {_NO_VCS}
"""
ORACLES["a04_vcs_dir_filter"] = f"SELECT project, path FROM fx_files WHERE {_NO_VCS}"
ORACLES["a05_root_path_filter"] = (
    "SELECT project, path FROM fx_files WHERE starts_with(path, 'src/') OR starts_with(path, 'docs/')"
)
ORACLES["a06_size_filter"] = "SELECT project, path, length FROM fx_files WHERE length <= 4096"
ORACLES["a06_oversize_report"] = "SELECT project, path, length FROM fx_files WHERE length > 4096"
_BASE = "lower(regexp_extract(path, '([^/]*)$', 1))"
_IS_TEXT = f"""CASE WHEN {_ext()} IN {_in(sel.TEXT_NAMES)} OR {_BASE} IN {_in(sel.TEXT_NAMES)} THEN true
  WHEN {_ext()} IN {_in(sel.BINARY_EXTENSIONS)} THEN false ELSE instr(content, chr(0)) = 0 END"""
ORACLES["a07_text_filter"] = f"SELECT project, path FROM fx_files WHERE {_IS_TEXT}"
ORACLES["a08_locale_order"] = (
    "SELECT project, path, seq FROM fx_files ORDER BY icu_sort_key(project, 'und'), icu_sort_key(path, 'und')"
)


def _given(field: str, default: str, cast: str) -> str:
    value = f"json_extract(json, '$.{field}')"
    return f"CASE WHEN NOT bad THEN CASE WHEN {value} IS NULL THEN {default} ELSE {cast.format(value)} END END"


_JOINED = "array_to_string(CAST({} AS VARCHAR[]), ',')"
ORACLES["a09_effective_config"] = f"""
SELECT project, {_given('cleaner.whitelist', "'//!'", _JOINED)} AS whitelist,
  {_given('cleaner.keepJSDoc', 'true', 'CAST({} AS BOOLEAN)')} AS keep_doc,
  {_given('cleaner.useGitignore', 'true', 'CAST({} AS BOOLEAN)')} AS clean_use_vcs_ignore,
  {_given('cleaner.ignore', "''", _JOINED)} AS clean_ignore,
  {_given('packer.ignore', "'" + ','.join(sel.DEFAULT_IGNORE) + "'", _JOINED)} AS pack_ignore,
  {_given('packer.useGitignore', 'true', 'CAST({} AS BOOLEAN)')} AS pack_use_vcs_ignore,
  {_given('packer.contentBasedBinaryDetection', 'false', 'CAST({} AS BOOLEAN)')} AS probe_content,
  CASE WHEN NOT bad THEN json_extract_string(json, '$.prompts.pack') END AS pack_prompt, bad AS invalid
FROM (SELECT *, coalesce(json_type(json, '$.packer.useGitignore') NOT IN ('BOOLEAN', 'NULL'), false)
  OR coalesce(json_type(json, '$.prompts.pack') NOT IN ('VARCHAR', 'NULL'), false) OR contains(json, '["a",1]') AS bad FROM fx_config)
"""
ORACLES["a10_extension_filter"] = f"SELECT project, path FROM fx_files WHERE {_ext()} IN {_in(sel.CLEANABLE_EXTENSIONS)}"
ORACLES["a11_input_path_filter"] = """
SELECT project, path FROM fx_files WHERE starts_with(path, 'src/auth/') OR path = 'docs' OR starts_with(path, 'docs/')
  OR path = 'package.json' OR starts_with(path, 'package.json/')"""
ORACLES["a12_changed_filter"] = "SELECT project, path FROM fx_code WHERE path IN (SELECT path FROM fx_changes)"
ORACLES["a12_staged_filter"] = (
    "SELECT project, path FROM fx_code WHERE path IN (SELECT path FROM fx_changes WHERE list = 'staged')"
)
ORACLES["a12_audit_scope"] = f"SELECT DISTINCT path FROM fx_changes WHERE {_ext()} IN {_in(sel.AUDITED_EXTENSIONS)}"
ORACLES["a13_list_files"] = f"SELECT project, path FROM fx_files WHERE {_NO_VCS}"
ORACLES["a00_find_files"] = f"""WITH {_IGNORED}
SELECT f.project, f.path, f.length FROM fx_files f ANTI JOIN gone g ON f.project = g.project AND f.path = g.path
WHERE {_NO_VCS} AND regexp_matches(path, '^(src|lib|docs)/') AND length <= 16384 AND {_IS_TEXT}
"""

# What the settings of each project of the view leave of its tree.
_TREE_KEPT = """k <> 4 AND NOT (starts_with(path, 'node_modules/') AND k NOT IN (1, 3)) AND NOT (starts_with(path, 'gen/') AND {gen})
  AND NOT (k = 3 AND starts_with(path, 'lib/')) AND {more}"""
_TREE = "SELECT *, CAST(substr(project, 2) AS INT) AS k FROM fx_tree"
_TREE_CLEANED = f"""
SELECT project, path, content AS original, 'const a = 1; ' || chr(10) || CASE k WHEN 5 THEN '' ELSE '/** doc */' END || chr(10) || 'b(d);' AS content,
  CAST(CASE k WHEN 5 THEN 3 ELSE 2 END AS BIGINT) AS removed
FROM ({_TREE}) WHERE {_TREE_KEPT.format(gen="k <> 2", more="NOT (k = 0 AND regexp_matches(path, '^src/f1.*[.]ts$'))")} AND {_ext()} IN ('.ts', '.js')"""
ORACLES["a00_clean_configured"] = f"SELECT project, path, content, removed FROM ({_TREE_CLEANED})"
ORACLES["a00_clean_configured_summary"] = f"""
SELECT project, count(*) AS files_processed, count(*) AS files_changed, CAST(sum(removed) AS BIGINT) AS comments_removed, CAST(sum(strlen(original)) AS BIGINT) AS bytes_before,
  CAST(sum(strlen(content)) AS BIGINT) AS bytes_after, CAST(sum(strlen(original)) - sum(strlen(content)) AS BIGINT) AS bytes_saved,
  CAST(round((sum(strlen(original)) - sum(strlen(content))) / 4) AS BIGINT) AS tokens_saved
FROM ({_TREE_CLEANED}) GROUP BY project"""

# B: comment removal

_HTML = "(?s)<!--.*?-->"
_CODE = (
    r'"(?:[^"\\\n]|\\.)*"|' + r"''(?:[^''\\\n]|\\.)*''|" + r"`(?:[^`\\]|\\.)*`|/\*(?:[^*]|\*+[^*/])*\*+/|//[^\n]*"
)
_JSX = r"\{/\*(?:[^*]|\*+[^*/])*\*+/\}|" + _CODE


def _keeps(token: str, extra: str, keep_doc: bool = True) -> str:
    words = "|".join(SYSTEM_KEEP_WORDS) + ("|" + extra if extra else "")
    doc = f" OR starts_with({token}, '/**')" if keep_doc else ""
    return f"(regexp_matches(lower({token}), '{words}'){doc})"


def _stripped(source: str, extra: str = "//!", keep_doc: bool = True) -> str:
    """CTEs ``cut`` and ``stripped`` over ``source(project, path, content)``."""
    pattern = f"""CASE WHEN ends_with(path, '.html') THEN '{_HTML}' WHEN ends_with(path, '.tsx') THEN '{_JSX}' ELSE '{_CODE}' END"""
    cases = " ".join(
        f"WHEN {test} THEN struct_pack(p := string_split_regex(content, '{rx}'), t := regexp_extract_all(content, '{rx}'))"
        for test, rx in (("ends_with(path, '.html')", _HTML), ("ends_with(path, '.tsx')", _JSX))
    )
    del pattern
    comment = "(starts_with(x, '//') OR starts_with(x, '/*') OR starts_with(x, '{') OR starts_with(x, '<!--'))"
    drop = f"({comment} AND NOT {_keeps('x', extra, keep_doc)})"
    drop_k = drop.replace("(x", "(t[k]")
    return f"""
cut AS (SELECT project, path, content AS original, c.p AS p, c.t AS t FROM (
  SELECT *, CASE {cases} ELSE struct_pack(p := string_split_regex(content, '{_CODE}'), t := regexp_extract_all(content, '{_CODE}')) END AS c
  FROM ({source}))),
stripped AS (SELECT project, path, original, list_filter(t, lambda x: {drop}) AS matches,
  coalesce(array_to_string(list_transform(range(1, len(t) + 1), lambda k: p[k] || CASE WHEN {drop_k} THEN
    CASE WHEN regexp_matches(p[k], '[A-Za-z0-9_$]$') AND regexp_matches(p[k + 1], '^[A-Za-z0-9_$]') AND NOT starts_with(t[k], '{{') THEN ' ' ELSE '' END
    ELSE t[k] END), ''), '') || p[len(p)] AS content
  FROM cut)"""


_CORPUS = "SELECT * FROM fx_pages UNION ALL SELECT * FROM fx_code"
_FLAT = "trim(regexp_replace(x, '[ \\t\\n\\f\\r]+', ' ', 'g'))"
_SUMMARY = """count(*) AS files_processed, count(*) FILTER (len(matches) > 0) AS files_changed,
  CAST(sum(len(matches)) AS BIGINT) AS comments_removed, CAST(sum(strlen(original)) AS BIGINT) AS bytes_before,
  CAST(sum(strlen(content)) AS BIGINT) AS bytes_after, CAST(sum(strlen(original)) - sum(strlen(content)) AS BIGINT) AS bytes_saved,
  CAST(round((sum(strlen(original)) - sum(strlen(content))) / 4) AS BIGINT) AS tokens_saved"""

ORACLES["b01_strip_html_comments"] = (
    f"WITH {_stripped('SELECT * FROM fx_pages')} SELECT path, content, CAST(len(matches) AS BIGINT) AS removed FROM stripped"
)
ORACLES["b02_strip_code_comments"] = (
    f"WITH {_stripped('SELECT * FROM fx_code')} SELECT project, path, content, CAST(len(matches) AS BIGINT) AS removed FROM stripped"
)
ORACLES["b02_strip_nested_comments"] = "SELECT project, path, content, CAST(comments AS BIGINT) AS removed FROM fx_components_bare"
ORACLES["b03_comment_keep_predicate"] = f"""WITH {_stripped('SELECT * FROM fx_code', 'ring', False)}
SELECT path, CAST(len(matches) AS BIGINT) AS removed, coalesce(array_to_string(matches, ' | '), '') AS matches FROM stripped"""
ORACLES["b04_token_boundary_space"] = f"""WITH {_stripped('SELECT * FROM fx_code', '')}
SELECT project, path, content FROM stripped"""
ORACLES["b05_clean_summary"] = f"WITH {_stripped(_CORPUS)} SELECT project, {_SUMMARY} FROM stripped GROUP BY project"
ORACLES["b05_clean_total"] = f"WITH {_stripped('SELECT * FROM fx_pages')} SELECT {_SUMMARY} FROM stripped"
ORACLES["b06_comment_previews"] = f"""WITH {_stripped(_CORPUS)}
SELECT project, path, CAST(len(matches) AS BIGINT) AS removed,
  array_to_string(list_transform(matches, lambda x: {_FLAT}), ' | ') AS previews, CAST(0 AS BIGINT) AS more
FROM stripped WHERE len(matches) > 0"""
ORACLES["b07_clean_report"] = f"""WITH {_stripped(_CORPUS)}
SELECT project, path, CAST(len(matches) AS BIGINT) AS removed,
  coalesce(array_to_string(list_transform(matches, lambda x: {_FLAT}), ' | '), '') AS previews FROM stripped"""
ORACLES["b08_write_cleaned"] = f"WITH {_stripped(_CORPUS)} SELECT project, path, content FROM stripped WHERE len(matches) > 0"
ORACLES["b09_backup_originals"] = (
    f"WITH {_stripped(_CORPUS)} SELECT project, path, original AS content FROM stripped WHERE len(matches) > 0"
)

# C: tokens

ORACLES["c02_token_cost"] = """
SELECT source, tokens, printf('%.4f', tokens / 1000000.0 * 5.0) AS usd
FROM (SELECT source, CAST(sum(CAST(round(strlen(text) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY source)"""
ORACLES["c03_token_estimate"] = "SELECT doc_id, CAST(round(strlen(text) / 4) AS BIGINT) AS tokens FROM documents"

# D: packing

_ORDER = "icu_sort_key(path, 'und'), path"
_XML = "'<file path=\"' || path || '\">' || chr(10) || content || chr(10) || '</file>'"
_GAP = "chr(10) || chr(10)"


def _pieces(source: str, order: str, chunk: str = _XML, head: str = "'<files>' || chr(10)", sep: str = _GAP, tail: str = "chr(10) || '</files>'") -> str:
    """All columns of a source with the piece of text of each row and whether it is its project's last."""
    return f"""SELECT *, CASE WHEN row_number() OVER w = 1 THEN {head} ELSE {sep} END || {chunk}
  || CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY project) THEN {tail} ELSE '' END AS text,
  row_number() OVER w = count(*) OVER (PARTITION BY project) AS last
FROM {source} WINDOW w AS (PARTITION BY project ORDER BY {order})"""


def _whole(pieces: str, order: str) -> str:
    """The pieces of each project put together in order, in parts of 4 MiB."""
    return f"""SELECT project, part, min(start) AS start, count(*) AS pieces, coalesce(string_agg(text, '' ORDER BY {order}), '') AS text FROM (
  SELECT *, start // 4194304 AS part FROM (
    SELECT *, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY project ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM ({pieces}))) GROUP BY project, part"""


_SEQ = _ORDER + ", seq"
_PACKED = _pieces("fx_files", _SEQ)
_PACKED_TEXT = _pieces("fx_files", _SEQ, "'// file: ' || path || chr(10) || content", "''", _GAP, "''")
_LISTED = _pieces("fx_files", _SEQ, "path", "''", "chr(10)", "''")


def _placed(chunk: str = _XML, head: str = "'<files>' || chr(10)", sep: str = _GAP, tail: str = "chr(10) || '</files>'") -> str:
    """Like ``_pieces`` of the files, which may lack a text and share path and seq: ``nth`` is the place in the project,
    the first and the last file that have a text get head and tail."""
    order = "icu_sort_key(path, 'und') NULLS FIRST, path NULLS FIRST, seq NULLS FIRST, chunk NULLS LAST"
    return f"""SELECT project, nth, with_text = texts AS last, CASE WHEN with_text = 1 THEN {head} ELSE {sep} END || chunk || CASE WHEN with_text = texts THEN {tail} ELSE '' END AS text
  FROM (SELECT project, chunk, row_number() OVER w AS nth, count(chunk) OVER w AS with_text, count(chunk) OVER (PARTITION BY project) AS texts
    FROM (SELECT *, {chunk} AS chunk FROM fx_files) WINDOW w AS (PARTITION BY project ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


_PLACED = _placed()
_PLACED_TEXT = _placed("'// file: ' || path || chr(10) || content", "''", _GAP, "''")
_PLACED_LIST = _placed("path", "''", "chr(10)", "''")
_TREE_PACKED = f"(SELECT project, path, content FROM ({_TREE}) WHERE {_TREE_KEPT.format(gen='k <> 3', more='true')})"
ORACLES["a00_pack_configured"] = f"SELECT project, path, text FROM ({_pieces(_TREE_PACKED, _ORDER)})"
_TOTALS = f"""SELECT project, count(*) AS files,
  CAST(sum(strlen({_XML})) + (count(*) - 1) * 2 + 17 AS BIGINT) AS context_bytes FROM fx_files GROUP BY project"""
ORACLES["d01_pack_xml"] = _whole(_PACKED, _SEQ)
ORACLES["d01_pack_xml_rows"] = f"SELECT project, path AS first_path, text FROM ({_PACKED})"
ORACLES["d02_pack_text"] = _whole(_PLACED_TEXT, "nth")
ORACLES["d03_file_list"] = _whole(_PLACED_LIST, "nth")
_PROMPTS = f"""
totals AS (SELECT *, CAST(round(context_bytes / 4) AS BIGINT) AS tokens FROM ({_TOTALS})),
prompts AS (SELECT p.project, p.source, p.named, coalesce(t.content, CASE WHEN instr(source, chr(10)) > 0
    OR (regexp_matches(source, '[^\\s]') AND NOT regexp_matches(source, '[/\\\\]') AND NOT regexp_matches(source, '\\.[^/]*$')) THEN source END) AS template
  FROM fx_project_prompts p LEFT JOIN fx_templates t ON t.name = p.source)"""
_HOLDER = "'\\{\\{(context|fileList)\\}\\}'"


def _filled(packed: str, listed: str, place: str = "path, seq", none: str = "'' AS path, CAST(NULL AS BIGINT) AS seq", tokens: str = "tokens") -> str:
    """Own texts of a template at even slots, the rows of the context or of the file list between them at odd ones."""
    return f"""
full_template AS (SELECT project, {tokens}, CASE WHEN instr(template, '{{{{context}}}}') > 0 THEN template ELSE template || chr(10) || chr(10) || '{{{{context}}}}' END AS t
  FROM chosen JOIN totals USING (project)),
cut AS (SELECT project, tokens, string_split_regex(t, {_HOLDER}) AS p, regexp_extract_all(t, {_HOLDER}, 1) AS h FROM full_template),
slots AS (SELECT project, tokens, unnest(range(0, len(p))) AS i, unnest(p) AS piece, unnest(list_concat(h, [NULL])) AS holder FROM cut),
filled AS (
SELECT project, CAST(i * 2 AS INT) AS slot, {none}, holder IS NULL AS last,
  replace(replace(piece, '{{{{tokenCount}}}}', CAST(tokens AS VARCHAR)), '{{{{usdEstimate}}}}', printf('%.4f', tokens / 1000000.0 * 5.0)) AS text FROM slots
UNION ALL SELECT s.project, CAST(i * 2 + 1 AS INT), {place}, FALSE, text FROM slots s JOIN ({packed}) c ON c.project = s.project AND holder = 'context'
UNION ALL SELECT s.project, CAST(i * 2 + 1 AS INT), {place}, FALSE, text FROM slots s JOIN ({listed}) c ON c.project = s.project AND holder = 'fileList')"""


_FILLED = _filled(_PACKED, _LISTED)
_FILLED_PLACED = _filled(_PLACED, _PLACED_LIST, "nth", "CAST(NULL AS BIGINT) AS nth", "coalesce(tokens, 0) AS tokens")
_CONFIGURED = f"WITH {_PROMPTS}, chosen AS (SELECT project, template FROM prompts WHERE template IS NOT NULL)"
_BY_CONFIG = f"{_CONFIGURED}, {_FILLED}"
ORACLES["d04_fill_template"] = f"{_CONFIGURED}, {_FILLED_PLACED} {_whole('SELECT * FROM filled', 'slot, nth')}"
ORACLES["d04_fill_template_rows"] = f"{_BY_CONFIG} SELECT project, slot, path AS first_path, text FROM filled"
ORACLES["d05_resolve_template"] = """
SELECT id, source, coalesce(t.content, inline) AS template, coalesce(t.content, inline) IS NOT NULL AS found
FROM (SELECT id, source, CASE WHEN instr(source, chr(10)) > 0 OR (regexp_matches(source, '[^\\s]') AND instr(source, '/') = 0
    AND instr(source, chr(92)) = 0 AND NOT regexp_matches(source, '\\.[^/]*$')) THEN source END AS inline FROM fx_prompts) p
LEFT JOIN fx_templates t ON t.name = p.source"""
_BY_NAME = """coalesce(
  (SELECT content FROM fx_templates t WHERE instr({n}, '.') > 0 AND t.name = {n}),
  (SELECT content FROM fx_templates t WHERE instr({n}, '.') = 0 AND t.name = {n} || '.md'),
  (SELECT content FROM fx_templates t WHERE instr({n}, '.') = 0 AND t.name = {n} || '.txt'))"""
ORACLES["d05_resolve_template_name"] = f"""
SELECT id, named, {_BY_NAME.format(n='named')} AS template, {_BY_NAME.format(n='named')} IS NOT NULL AS found FROM fx_prompts"""


def _output(packed: str, filled: str, place: str = "path, seq", none: str = "'', NULL") -> str:
    return f"""WITH {_PROMPTS},
named AS (SELECT project, named, coalesce({_BY_NAME.format(n='named')}, CASE WHEN named IS NULL THEN template END, CASE WHEN named IS NULL THEN '' END) AS t,
    named IS NOT NULL AND {_BY_NAME.format(n='named')} IS NULL AS missing, named IS NULL AND template IS NULL AS raw
  FROM totals LEFT JOIN prompts USING (project)),
chosen AS (SELECT project, t AS template FROM named WHERE NOT missing AND NOT raw), {filled},
output AS (SELECT *, CAST(NULL AS VARCHAR) AS error FROM filled
UNION ALL SELECT project, 1, {place}, last, text, NULL FROM ({packed}) JOIN named USING (project) WHERE raw
UNION ALL SELECT project, 0, {none}, TRUE, NULL, 'template not found: ' || named FROM named WHERE missing)"""


_OUTPUT = _output(_PACKED, _FILLED)
ORACLES["d06_choose_output"] = f"""{_output(_PLACED, _FILLED_PLACED, "nth", "NULL")} SELECT *, CAST(NULL AS VARCHAR) AS error FROM ({_whole('SELECT * FROM output WHERE error IS NULL', 'slot, nth')})
UNION ALL SELECT project, 0, 0, 0, NULL, error FROM output WHERE error IS NOT NULL"""
ORACLES["d07_write_context"] = f"""
SELECT project, path, seq, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY project ORDER BY {_SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  text || CASE WHEN last THEN chr(10) ELSE '' END AS text FROM ({_PACKED_TEXT})"""
ORACLES["d07_context_files"] = f"""{_OUTPUT}
SELECT project || '/context.xml' AS path, CAST(sum(strlen(text)) + 1 AS BIGINT) AS length FROM output WHERE error IS NULL GROUP BY project"""
ORACLES["d08_pack_summary"] = f"""
SELECT project, files, context_bytes, tokens, tokens / 1000000.0 * 5.0 AS usd, 'xml' AS format
FROM (SELECT *, CAST(round(context_bytes / 4) AS BIGINT) AS tokens FROM ({_TOTALS}))"""
ORACLES["d09_pack_clean"] = f"WITH {_stripped('SELECT * FROM fx_code')} {_whole(_pieces('stripped', _ORDER), _ORDER)}"

# E: import graph

_RAW = """
raw AS (SELECT project, path, unnest(regexp_extract_all(content, '(?m)^((import|export)[^"]*"[^"]+")', 1)) AS m FROM fx_imports),
edges AS (SELECT project, path, regexp_extract(m, '"([^"]+)"', 1) AS specifier,
  CASE WHEN starts_with(m, 'import type') THEN 'type' WHEN starts_with(m, 'export') THEN 're-export' ELSE 'import' END AS kind FROM raw),
resolved AS (SELECT e.project, e.path, e.specifier, e.kind, NOT starts_with(e.specifier, '.') AS external, f.path AS resolved
  FROM edges e LEFT JOIN fx_imports f ON f.project = e.project AND starts_with(e.specifier, '.')
   AND f.path = 'src/' || regexp_extract(e.specifier, '(part[0-9]+)', 1) || '.ts')"""
ORACLES["e01_import_edges_raw"] = f"WITH {_RAW} SELECT project, path, specifier, kind FROM edges"
# What each group of projects of the view has in force, and which folder a specifier then means.
ORACLES["e02_path_aliases"] = """
SELECT * FROM (VALUES ('al0', '@/*', 'src/*', false), ('al5', '@/*', 'lib/*', false),
  ('al0', 'first', 'src/part10 | lib/part15', false), ('al5', 'first', 'src/part10 | lib/part15', false),
  ('al1', '@/deep/*', 'src/* | lib/*', false), ('al6', '@/deep/*', 'src/* | lib/*', false),
  ('al2', '@/*', 'src/*', false), ('al7', '@/*', 'lib/*', false), ('al2', '*', 'src/*', true), ('al7', '*', 'lib/*', true),
  ('al3', '@/*', 'none/*', false), ('al8', '@/*', 'none/*', false),
  ('al3', '@/deep/*', 'none/* | src/* | lib/*', false), ('al8', '@/deep/*', 'none/* | src/* | lib/*', false)) t(project, alias, targets, fallback)
WHERE project IN (SELECT project FROM fx_aliased)"""
ORACLES["e02_resolve_aliases"] = """
WITH parts AS (SELECT *, p_partkey % 10 AS g, unnest([1, 2, 3, 4, 5]) AS line FROM part),
said AS (SELECT g, p_partkey AS n, p_partkey + line * 10 AS m, line,
    CASE line WHEN 1 THEN '@/part' || (p_partkey + 10) WHEN 2 THEN '@/deep/part' || (p_partkey + 20) WHEN 3 THEN 'part' || (p_partkey + 30) WHEN 4 THEN 'first' ELSE 'react' END AS specifier,
    CASE line WHEN 1 THEN g IN (0, 5, 2, 7) WHEN 2 THEN g IN (1, 6, 3, 8) WHEN 3 THEN g IN (2, 7) WHEN 4 THEN g IN (0, 5) ELSE false END AS hit,
    CASE line WHEN 1 THEN g IN (0, 5, 2, 7, 3, 8) WHEN 2 THEN g NOT IN (4, 9) WHEN 4 THEN g IN (0, 5) ELSE false END AS meant FROM parts),
goal AS (SELECT *, CASE WHEN line = 4 THEN CASE g WHEN 0 THEN 10 ELSE 15 END ELSE m END AS target FROM said),
file AS (SELECT p_partkey, CASE WHEN p_partkey % 10 < 5 THEN 'src/' ELSE 'lib/' END || 'part' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '/index.ts' ELSE '.ts' END AS path FROM part)
SELECT 'al' || g AS project, f.path, specifier, 'import' AS kind, NOT meant AND t.path IS NULL AS external, t.path AS resolved
FROM goal JOIN file f ON f.p_partkey = n LEFT JOIN file t ON hit AND t.p_partkey = target"""
ORACLES["e02_resolve_imports"] = f"WITH {_RAW} SELECT * FROM resolved"


def _reached(depth: int) -> str:
    return f"""{_RAW},
links AS (SELECT DISTINCT path AS src, resolved AS dst FROM resolved WHERE resolved IS NOT NULL),
walk(path, depth) AS (SELECT 'src/part0.ts', 0 UNION SELECT dst, depth + 1 FROM walk JOIN links ON src = path WHERE depth < {depth}),
reach AS (SELECT path, min(depth) AS depth FROM walk GROUP BY path),
reasons AS (SELECT r.path, CASE WHEN r.depth = 0 THEN 'entry point' ELSE 'import from ' ||
  (SELECT min(l.src) FROM links l JOIN reach s ON s.path = l.src WHERE l.dst = r.path AND s.depth = r.depth - 1) END AS reason FROM reach r)"""


# The tree below the first part is shallower than this at every scale.
_DEEP = 24
ORACLES["e03_reachable"] = f"WITH RECURSIVE {_reached(_DEEP)} SELECT 'app' AS project, path, depth FROM reach"
ORACLES["e03_reachable_bounded"] = f"WITH RECURSIVE {_reached(3)} SELECT 'app' AS project, path, depth FROM reach"
ORACLES["e04_explain"] = f"WITH RECURSIVE {_reached(_DEEP)} SELECT 'app' AS project, path, reason FROM reasons"
ORACLES["e05_pack_reachable"] = f"""WITH RECURSIVE {_reached(_DEEP)}
SELECT project, path, text FROM ({_pieces('(SELECT * FROM fx_imports WHERE path IN (SELECT path FROM reach))', _ORDER)})"""
ORACLES["a13_list_files_with_reasons"] = f"""WITH RECURSIVE {_reached(_DEEP)}
SELECT project, f.path, f.path || '  ← ' || coalesce(reason, '') AS entry FROM fx_imports f LEFT JOIN reasons r ON r.path = f.path"""

ORACLES["e06_import_cycles"] = """
SELECT 'p' || p_partkey // 700 AS project, 'src/m' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || '.ts' AS node,
  'src/m' || lpad(CAST(p_partkey - p_partkey % 7 AS VARCHAR), 7, '0') || '.ts' AS cycle
FROM part WHERE p_partkey % 7 <= 3 AND p_partkey - p_partkey % 7 + 3 <= (SELECT max(p_partkey) FROM part)"""

# F: product documents


def _section(content: str, heading: str) -> str:
    level = heading.index(" ")
    tail = f"regexp_extract({content}, '(?m)^{heading}\\b[^\\n]*$((?s:.*))', 1)"
    return _trim(f"string_split_regex({tail}, '(?m)^#{{1,{level}}} ')[1]")


def _norm(x: str) -> str:
    return f"lower(translate({x}, 'ёЁ', 'еЕ'))"


def _items(content: str, heading: str) -> str:
    """List of the items below a heading."""
    lines = f"string_split({_section(content, heading)}, chr(10))"
    item = "^\\s*(?:[0-9]+\\.|[-*•])\\s+(.+)"
    return (
        f"list_transform(list_filter({lines}, lambda x: regexp_matches(x, '{item}')), "
        f"lambda x: {_trim(f'''regexp_replace(regexp_extract(x, '{item}', 1), '[*]+([^*]+)[*]+', '\\1', 'g')''')})"
    )


def _cells(content: str, heading: str, skip) -> str:
    lines = f"string_split({_section(content, heading)}, chr(10))"
    rows = f"list_filter({lines}, lambda x: instr(x, '|') > 0 AND NOT regexp_matches(x, '^\\s*\\|[-: |]+\\|\\s*$'))"
    first = f"list_transform({rows}, lambda x: {_trim('''string_split(regexp_replace(x, '^[|]+', ''), '|')[1]''')})"
    return f"list_filter({first}, lambda x: x <> '' AND x NOT IN {_in(skip)})"


def _words(x: str) -> str:
    tokens = f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')"
    return (
        f"list_filter(list_transform(list_filter({tokens}, lambda w: regexp_matches(w, '^[а-яёА-ЯЁa-zA-Z]{{5,}}$')), "
        f"lambda w: {_norm('w')}), lambda w: w NOT IN {_in(STOPWORDS)})"
    )


_ALL_SECTIONS = " UNION ALL ".join(
    f"SELECT project, rel_path, '{h}' AS heading, {_section('content', h)} AS body FROM fx_docs WHERE rel_path = '{p}'"
    for p, hs in d.HEADINGS.items()
    for h in hs
)
ORACLES["f01_sections"] = f"SELECT * FROM ({_ALL_SECTIONS}) WHERE body <> ''"
ORACLES["f01_stand_block"] = """
SELECT project, rel_path, string_split_regex(substr(content, instr(content, '## Stand: dev')), chr(10) || '## ')[1] AS block FROM fx_runbooks"""
ORACLES["f02_list_items"] = (
    f"SELECT project, unnest({_items('content', '## Out of scope')}) AS item FROM fx_docs WHERE rel_path = '{d.VISION}'"
)
ORACLES["f03_table_first_column"] = f"""
SELECT project, unnest({_cells('content', '## Entities', d.ENTITY_HEADERS)}) AS cell FROM fx_docs WHERE rel_path = '{d.SPEC}'"""
ORACLES["f04_keywords"] = (
    f"SELECT conv_id, turn, coalesce(array_to_string({_words('text')}, ' '), '') AS words FROM conversations"
)
ORACLES["f05_normalize"] = f"SELECT conv_id, turn, {_norm('text')} AS text FROM conversations"
_META = """
meta AS (SELECT project, rel_path, nullif(regexp_extract(content, '[*][*]Status:[*][*]\\s*(draft|in review|approved)', 1), '') AS status,
  nullif(regexp_extract(content, '[*][*]Date:[*][*]\\s*(\\d{4}-\\d{2}-\\d{2})', 1), '') AS date FROM fx_docs)"""
ORACLES["f06_doc_metadata"] = f"WITH {_META} SELECT * FROM meta"
ORACLES["f06_metadata_issues"] = f"""WITH {_META}
SELECT project, rel_path, 'status' AS detail FROM meta WHERE status IS NULL UNION ALL SELECT project, rel_path, 'date' FROM meta WHERE date IS NULL"""

_HEADS = "heads(rel_path, heading) AS (VALUES " + ", ".join(f"('{p}', '{h}')" for p, hs in d.HEADINGS.items() for h in hs) + ")"
_ABSENT = f"""
SELECT p.project, e.rel_path, 'missing document' AS rule, '' AS detail
FROM (SELECT DISTINCT project FROM docs) p JOIN (SELECT DISTINCT rel_path FROM heads) e ON true
ANTI JOIN docs x ON x.project = p.project AND x.rel_path = e.rel_path
UNION ALL
SELECT x.project, x.rel_path, 'missing heading', h.heading FROM docs x JOIN heads h ON h.rel_path = x.rel_path
WHERE NOT regexp_matches(x.content, '(?m)^\\s*' || h.heading)"""
ORACLES["f07_required_documents_and_headings"] = f"""WITH {_HEADS},
docs AS (SELECT * FROM fx_docs UNION ALL SELECT project, 'INDEX.md', content FROM fx_runbooks)
{_ABSENT}"""


def _lines(source: str) -> str:
    """CTE ``lines`` of trimmed lines with a running count of fence lines."""
    return f"""
lines AS (SELECT project, rel_path, line, txt, count(*) FILTER (starts_with(txt, '```')) OVER (PARTITION BY project, rel_path ORDER BY line) AS fences
  FROM (SELECT project, rel_path, unnest(range(1, len(parts) + 1)) AS line, {_trim('unnest(parts)')} AS txt
    FROM (SELECT project, rel_path, string_split(content, chr(10)) AS parts FROM ({source})))),
prose AS (SELECT * FROM lines WHERE fences % 2 = 0 AND NOT starts_with(txt, '```'))"""


ORACLES["f08_placeholders"] = f"""WITH {_lines('SELECT * FROM fx_docs')}
SELECT project, rel_path, line, txt AS detail FROM prose WHERE regexp_matches(txt, '\\[[^\\]]+\\]([^(]|$)')"""

_PHRASES = "phrases(ord, phrase) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(d.BANNED)) + ")"
_ANY_PHRASE = "|".join(
    ["(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(p for p in d.BANNED if " " not in p) + ")(?:[^\\p{L}\\p{N}_]|$)"]
    + [p for p in d.BANNED if " " in p]
)
_FIRST_PHRASE = f"""
SELECT project, rel_path, line, CASE WHEN instr(phrase, ' ') > 0 THEN 'banned phrase' ELSE 'banned word' END AS rule, phrase AS detail
FROM (SELECT project, rel_path, line, arg_min(phrase, ord) AS phrase FROM suspects JOIN phrases
  ON instr(folded, phrase) > 0 AND (instr(phrase, ' ') > 0 OR regexp_matches(folded, '(^|[^\\p{{L}}\\p{{N}}_])' || phrase || '([^\\p{{L}}\\p{{N}}_]|$)'))
  GROUP BY ALL)"""
# Only lines with a hit meet the phrase list.
_SUSPECTS = f"""
suspects AS MATERIALIZED (SELECT * FROM (SELECT project, rel_path, line, {_norm('txt')} AS folded FROM prose) WHERE regexp_matches(folded, '{_ANY_PHRASE}'))"""
ORACLES["f09_banned_words"] = f"""WITH {_PHRASES},
{_lines('SELECT * FROM fx_docs UNION ALL SELECT project, path AS rel_path, content FROM fx_texts')},
{_SUSPECTS}
{_FIRST_PHRASE}"""
_SHORT = f"""
SELECT project, rel_path, heading || ' ' || CAST(length(body) AS VARCHAR) AS detail FROM ({_ALL_SECTIONS})
WHERE rel_path <> 'INDEX.md' AND heading NOT IN {_in(d.LENGTH_EXEMPT)} AND body <> '' AND length(body) < 60"""
ORACLES["f10_short_sections"] = _SHORT
_METRICS = f"""
SELECT project, cells[1] AS detail FROM (
  SELECT project, list_transform(string_split(regexp_replace(row, '^[|]+|[|]+$', '', 'g'), '|'), lambda c: trim(c)) AS cells FROM (
    SELECT project, unnest(string_split({_section('content', '## Success metrics')}, chr(10))) AS row FROM fx_docs WHERE rel_path = '{d.VISION}')
  WHERE instr(row, '|') > 0 AND NOT regexp_matches(row, '^\\s*\\|[-: |]+\\|\\s*$'))
WHERE cells[1] NOT IN ('Metric', 'Метрика', '') AND NOT regexp_matches(coalesce(cells[2], ''), '[0-9]')"""
ORACLES["f11_metrics_without_number"] = _METRICS

_BOTH = f"""
both_docs AS (SELECT project, v.content AS vision, s.content AS spec FROM (SELECT * FROM fx_docs WHERE rel_path = '{d.VISION}') v
  JOIN (SELECT * FROM fx_docs WHERE rel_path = '{d.SPEC}') s USING (project)),
inside AS (SELECT project, item, {_words('item')} AS words FROM (SELECT project, unnest({_items('vision', '## In scope')}) AS item FROM both_docs)),
outside AS (SELECT project, item, {_words('item')} AS words FROM (SELECT project, unnest({_items('vision', '## Out of scope')}) AS item FROM both_docs)),
abilities AS (SELECT project, item, {_words('item')} AS words FROM (SELECT project, unnest({_items('vision', '## Key capabilities')}) AS item FROM both_docs)),
texts AS (SELECT project, {_norm('spec')} AS spec, {_norm('vision')} AS vision,
  {_norm(_section('spec', '## Key operations') + " || ' ' || " + _section('spec', '## Pages and screens'))} AS scope,
  {_norm(_section('vision', '## Goal'))} AS goal, {_norm(_section('spec', '## Key operations'))} AS operations,
  {_norm(f"replace(spec, {_section('spec', '## Glossary')}, '')")} AS rest FROM both_docs)"""
_CONTRADICTIONS = """
SELECT project, included, excluded, array_to_string(list_sort(shared), ', ') AS shared FROM (
  SELECT o.project, i.item AS included, o.item AS excluded, list_distinct(o.words) AS words, list_intersect(list_distinct(o.words), i.words) AS shared
  FROM outside o JOIN inside i ON i.project = o.project) WHERE len(shared) >= 2 AND len(shared) / len(words) >= 0.5"""
ORACLES["f12_scope_contradictions"] = f"WITH {_BOTH} {_CONTRADICTIONS}"
_SPECIFIED = """
SELECT project, item AS excluded, array_to_string(found, ', ') AS found FROM (
  SELECT o.project, item, list_filter(words, lambda w: instr(scope, w) > 0) AS found FROM outside o JOIN texts USING (project)) WHERE len(found) >= 2"""
ORACLES["f13_excluded_but_specified"] = f"WITH {_BOTH} {_SPECIFIED}"


def _weak(items: str, minimum: float) -> str:
    return f"""
SELECT project, item, CAST(len(found) AS BIGINT) AS found, CAST(len(words) AS BIGINT) AS total, len(found) / len(words) AS share FROM (
  SELECT i.project, item, words, list_filter(words, lambda w: instr(spec, w) > 0) AS found FROM {items} i JOIN texts USING (project))
WHERE len(words) > 0 AND len(found) / len(words) < {minimum}"""


ORACLES["f14_capability_coverage"] = f"WITH {_BOTH} {_weak('abilities', 0.4)}"
ORACLES["f15_inscope_coverage"] = f"WITH {_BOTH} {_weak('inside', 0.35)}"
_ENTITIES = f"""
SELECT project, entity FROM (SELECT project, unnest({_cells('spec', '## Entities', d.ENTITY_HEADERS)}) AS entity FROM both_docs)
JOIN texts USING (project) WHERE instr(operations, {_norm('entity')}) = 0"""
ORACLES["f16_entities_without_operation"] = f"WITH {_BOTH} {_ENTITIES}"
_SUBSECTIONS = f"""
SELECT project, subsection FROM (SELECT project, {_section('spec', '## Testing')} AS body, unnest({_list(d.TEST_SUBSECTIONS)}) AS subsection FROM both_docs)
WHERE instr(body, subsection) = 0"""
ORACLES["f17_testing_subsections"] = f"WITH {_BOTH} {_SUBSECTIONS}"
_TERMS = f"""
SELECT project, term FROM (SELECT project, unnest({_cells('spec', '## Glossary', d.TERM_HEADERS)}) AS term FROM both_docs)
JOIN texts USING (project) WHERE instr(rest, {_norm('term')}) = 0 AND instr(vision, {_norm('term')}) = 0"""
ORACLES["f18_unused_glossary_terms"] = f"WITH {_BOTH} {_TERMS}"
_GOALS = """
SELECT project, item AS excluded, array_to_string(list_sort(shared), ', ') AS shared FROM (
  SELECT o.project, item, list_distinct(words) AS words, list_filter(list_distinct(words), lambda w: instr(goal, w) > 0) AS shared
  FROM outside o JOIN texts USING (project)) WHERE len(shared) >= 2 AND len(shared) / len(words) >= 0.5"""
ORACLES["f19_goal_conflicts"] = f"WITH {_BOTH} {_GOALS}"
_ARTIFACTS = f"""
SELECT a.project, a.rel_path FROM fx_artifacts a ANTI JOIN fx_docs x ON x.project = a.project AND x.rel_path IN {_in(d.HEADINGS)}
  AND (instr(x.content, a.rel_path) > 0 OR instr(x.content, regexp_extract(a.rel_path, '([^/]*)$', 1)) > 0)"""
ORACLES["f20_unmentioned_artifacts"] = _ARTIFACTS
ORACLES["f21_status_report"] = f"""WITH {_META}, {_HEADS}
SELECT p.project, e.rel_path, CASE WHEN m.project IS NULL THEN 'MISSING' ELSE coalesce(m.status, '?') END AS status,
  CASE WHEN m.project IS NULL THEN '' ELSE coalesce(m.date, '?') END AS date
FROM (SELECT DISTINCT project FROM meta) p JOIN (SELECT DISTINCT rel_path FROM heads) e ON true
LEFT JOIN meta m ON m.project = p.project AND m.rel_path = e.rel_path"""
ORACLES["f22_set_status"] = """
SELECT project, rel_path, new AS content, new <> content AS changed FROM (SELECT *, regexp_replace(
  regexp_replace(content, '[*][*]Status:[*][*]\\s*(draft|in review|approved)', '**Status:** approved', 'g'),
  '[*][*]Date:[*][*]\\s*\\d{4}-\\d{2}-\\d{2}', '**Date:** 2024-12-31', 'g') AS new FROM fx_docs)"""
ORACLES["f23_validate_documents"] = f"""WITH {_META}, {_HEADS}, {_PHRASES}, {_lines('SELECT * FROM fx_docs')}, {_SUSPECTS}, {_BOTH},
docs AS (SELECT * FROM fx_docs),
staged(project, stage, rel_path, rule, detail) AS (
  SELECT project, 1, rel_path, rule, detail FROM ({_ABSENT})
  UNION ALL SELECT project, 1, rel_path, 'metadata', 'status' FROM meta WHERE status IS NULL
  UNION ALL SELECT project, 1, rel_path, 'metadata', 'date' FROM meta WHERE date IS NULL
  UNION ALL SELECT project, 1, rel_path, 'placeholder', txt FROM prose WHERE regexp_matches(txt, '\\[[^\\]]+\\]([^(]|$)')
  UNION ALL SELECT project, 1, rel_path, rule, detail FROM ({_FIRST_PHRASE})
  UNION ALL SELECT project, 1, rel_path, 'short section', detail FROM ({_SHORT})
  UNION ALL SELECT project, 1, '{d.VISION}', 'metric without number', detail FROM ({_METRICS})
  UNION ALL SELECT project, 2, '{d.VISION}', 'scope contradiction', excluded FROM ({_CONTRADICTIONS})
  UNION ALL SELECT project, 2, '{d.VISION}', 'excluded but specified', excluded FROM ({_SPECIFIED})
  UNION ALL SELECT project, 2, '{d.VISION}', 'capability not covered', item FROM ({_weak('abilities', 0.4)})
  UNION ALL SELECT project, 2, '{d.VISION}', 'scope item not covered', item FROM ({_weak('inside', 0.35)})
  UNION ALL SELECT project, 2, '{d.SPEC}', 'entity without operation', entity FROM ({_ENTITIES})
  UNION ALL SELECT project, 2, '{d.SPEC}', 'missing test subsection', subsection FROM ({_SUBSECTIONS})
  UNION ALL SELECT project, 2, '{d.SPEC}', 'unused term', term FROM ({_TERMS})
  UNION ALL SELECT project, 2, '{d.VISION}', 'goal conflict', excluded FROM ({_GOALS})
  UNION ALL SELECT project, 3, rel_path, 'artifact not mentioned', '' FROM ({_ARTIFACTS}))
SELECT * FROM staged WHERE (project, stage) IN (SELECT project, min(stage) FROM staged GROUP BY project)"""
_NAMED_WELL = "(SELECT * FROM fx_gate WHERE instr(project, ' ') = 0)"
ORACLES["f23_validate_projects"] = f"""
SELECT * FROM ({ORACLES["f23_validate_documents"].replace("fx_docs", _NAMED_WELL)}) WHERE project IN (SELECT project FROM {_NAMED_WELL})
UNION ALL SELECT DISTINCT project, 0, '', 'project name', 'spaces' FROM fx_gate WHERE instr(project, ' ') > 0"""
ORACLES["f24_project_name_issues"] = """
SELECT project, 'empty' AS problem FROM fx_names WHERE trim(project) = ''
UNION ALL SELECT project, 'forbidden characters' FROM fx_names WHERE regexp_matches(project, '[/\\\\:*?"<>|]')
UNION ALL SELECT project, 'spaces' FROM fx_names WHERE instr(project, ' ') > 0"""

# G: technical contracts

_FILES5 = "('IMPLEMENTATION_GUIDE.md', 'DATABASE_MODEL.md', 'API_CONTRACTS.md', 'ARCHITECTURE.md', 'TESTING_PLAN.md')"


def _contract_views(docs: str) -> str:
    """CTEs of the contract checks over ``docs``."""
    return f"""
blocks AS (SELECT project, rel_path, CASE rel_path WHEN 'DATABASE_MODEL.md' THEN 'prisma' ELSE 'graphql' END AS language,
  CASE rel_path WHEN 'DATABASE_MODEL.md' THEN regexp_extract(content, '```prisma\\n((?s:.)*?)```', 1)
    ELSE regexp_extract(content, '```graphql\\n((?s:.)*?)```', 1) END AS body
  FROM {docs} WHERE rel_path IN ('DATABASE_MODEL.md', 'API_CONTRACTS.md')),
models AS (SELECT project, unnest(regexp_extract_all(body, 'model\\s+(\\w+)\\s*\\{{((?s:.)*?)\\n\\}}', 1)) AS model,
  unnest(regexp_extract_all(body, 'model\\s+(\\w+)\\s*\\{{((?s:.)*?)\\n\\}}', 2)) AS body FROM blocks WHERE language = 'prisma'),
covered AS (SELECT m.project, model, instr(lower(x.content), lower(model)) > 0 AS hit, row_number() OVER () AS n
  FROM models m JOIN {docs} x ON x.project = m.project AND x.rel_path = 'API_CONTRACTS.md'),
coverage AS (SELECT project, count(*) FILTER (hit) AS covered, count(*) AS total, string_agg(model, ', ' ORDER BY n) FILTER (NOT hit) AS missing
  FROM covered GROUP BY project HAVING count(*) FILTER (hit) / count(*) < 0.5),
untraced AS (SELECT project, rel_path FROM {docs} WHERE rel_path IN ('DATABASE_MODEL.md', 'API_CONTRACTS.md') AND NOT regexp_matches(content, 'SPEC\\.md|VISION\\.md')),
api_lines AS (SELECT project, line, trim(txt) AS txt, regexp_extract(trim(txt), '^type\\s+(Query|Mutation|Subscription)\\b', 1) AS opened,
    len(regexp_extract_all(txt, '\\{{')) - len(regexp_extract_all(txt, '\\}}')) AS step
  FROM (SELECT project, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS txt FROM (SELECT project, string_split(body, chr(10)) AS p FROM blocks WHERE language = 'graphql'))),
api_blocks AS (SELECT *, count(*) FILTER (opened <> '') OVER (PARTITION BY project ORDER BY line) AS block FROM api_lines),
api_depth AS (SELECT *, sum(step) OVER (PARTITION BY project, block ORDER BY line) AS depth, max(opened) OVER (PARTITION BY project, block) AS root_type,
    bool_or(regexp_matches(txt, '(?i)\\b(first|after|limit|offset|page|cursor)\\b')) OVER (PARTITION BY project ORDER BY line ROWS 8 PRECEDING) AS paged FROM api_blocks),
api_inside AS (SELECT *, min(depth) OVER (PARTITION BY project, block ORDER BY line) AS lowest FROM api_depth),
unpaged AS (SELECT project, line, root_type, regexp_extract(txt, '(\\w+)\\s*[(:]', 1) AS field FROM api_inside
  WHERE block > 0 AND lowest > 0 AND regexp_matches(txt, ':\\s*\\[\\w') AND NOT paged),
timeless AS (SELECT project, model FROM models WHERE instr(model, '_') = 0 AND instr(body, 'createdAt') = 0 AND instr(body, 'updatedAt') = 0),
layered AS (SELECT project, rel_path FROM {docs} WHERE rel_path = 'ARCHITECTURE.md'
  AND regexp_matches(content, 'src/(entities|features|widgets|pages|shared|app)/|app/(entities|features|widgets|pages|shared)/')),
unguided AS (
  SELECT project, 'Stack' AS section FROM {docs} WHERE rel_path = 'IMPLEMENTATION_GUIDE.md' AND NOT regexp_matches(content, '(?mi)^#{{1,3}}\\s*stack\\b')
  UNION ALL SELECT project, 'Already Implemented' FROM {docs} WHERE rel_path = 'IMPLEMENTATION_GUIDE.md' AND NOT regexp_matches(content, '(?mi)^#{{1,3}}\\s*(already implemented|what.s already)')
  UNION ALL SELECT project, 'Local Setup' FROM {docs} WHERE rel_path = 'IMPLEMENTATION_GUIDE.md'
    AND NOT regexp_matches(content, '(?mi)^#{{1,3}}\\s*(local (setup|run|start)|getting started|quick start)'))"""


_MISSING5 = f"""
SELECT p.project, e.rel_path FROM (SELECT DISTINCT project FROM fx_blueprints) p JOIN (SELECT unnest({'[' + _FILES5[1:-1] + ']'}) AS rel_path) e ON true
ANTI JOIN fx_blueprints x ON x.project = p.project AND x.rel_path = e.rel_path"""
_G = "WITH " + _contract_views("fx_blueprints")
ORACLES["g01_missing_files"] = _MISSING5
ORACLES["g02_code_block"] = f"{_G} SELECT * FROM blocks"
ORACLES["g03_layer_paths"] = f"{_G} SELECT * FROM layered"
ORACLES["g04_model_coverage"] = f"{_G} SELECT * FROM coverage"
ORACLES["g05_traceability"] = f"{_G} SELECT * FROM untraced"
ORACLES["g06_list_fields_without_paging"] = f"{_G} SELECT * FROM unpaged"
ORACLES["g07_models_without_timestamps"] = f"{_G} SELECT * FROM timeless"
ORACLES["g08_guide_sections"] = f"{_G} SELECT * FROM unguided"
ORACLES["g09_migration_section"] = """
SELECT project, rel_path FROM fx_blueprints WHERE rel_path = 'DATABASE_MODEL.md'
  AND NOT regexp_matches(content, '(?mi)^#{1,3}\\s*(migration plan|db changes|database changes)')"""
ORACLES["g10_blueprint_verdict"] = f"""WITH absent AS ({_MISSING5}),
complete AS (SELECT * FROM fx_blueprints WHERE project NOT IN (SELECT project FROM absent)), {_contract_views('complete')},
unblocked AS (SELECT DISTINCT project FROM blocks WHERE body = ''),
issues(project, severity) AS (SELECT project, 'error' FROM absent UNION ALL SELECT project, 'error' FROM blocks WHERE body = ''
  UNION ALL SELECT project, 'error' FROM layered UNION ALL SELECT project, 'error' FROM untraced UNION ALL SELECT project, 'error' FROM unguided
  UNION ALL SELECT project, 'error' FROM coverage WHERE project NOT IN (FROM unblocked)
  UNION ALL SELECT project, 'error' FROM timeless WHERE project NOT IN (FROM unblocked)
  UNION ALL SELECT project, 'warning' FROM unpaged WHERE project NOT IN (FROM unblocked))
SELECT p.project, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
  count(*) FILTER (severity = 'error') = 0 AS passed
FROM (SELECT DISTINCT project FROM fx_blueprints) p LEFT JOIN issues i ON i.project = p.project GROUP BY p.project"""

# H: findings and scans

_MARKERS = "CASE WHEN {p} = 'package.json' THEN 0 WHEN {p} = 'go.mod' THEN 1 WHEN {p} IN ('pyproject.toml', 'requirements.txt', 'setup.py') THEN 2 WHEN {p} = 'Cargo.toml' THEN 3 WHEN {p} = 'pom.xml' OR regexp_matches({p}, '^(build|settings)[.]gradle') THEN 4 END"


def _runtimes(source: str) -> str:
    return f"""
runtimes AS (SELECT project, coalesce(['node', 'go', 'python', 'rust', 'java'][r + 1], 'generic') AS runtime,
  coalesce(['first-class', 'first-class', 'general', 'general', 'general'][r + 1], 'fallback') AS tier
  FROM (SELECT project, min({_MARKERS.format(p='path')}) AS r FROM ({source}) GROUP BY project))"""


ORACLES["h01_detect_runtime"] = (
    f"WITH {_runtimes('SELECT project, path FROM fx_files UNION ALL SELECT project, path FROM fx_env')} SELECT * FROM runtimes"
)
ORACLES["h02_detect_stack"] = """
SELECT project, bool_or(path IN ('docker-compose.yml', 'docker-compose.yaml')) AS compose, bool_or(path = 'Dockerfile') AS dockerfile,
  bool_or(path = '.env.example') AS env_example FROM fx_files GROUP BY project"""
# The reports of the view hold one finding each, in columns that depend on the header.
_PARSED = """
parsed AS (SELECT session, audit, component, c[1] AS check_id, c[2] AS check,
  regexp_extract(c[3], '(PASS|FAIL|ACCEPTED|UNVERIFIED)', 1) AS status,
  CASE WHEN instr(c[3], '🔴') > 0 THEN 'critical' WHEN instr(c[3], '🟠') > 0 THEN 'high' WHEN instr(c[3], '🟡') > 0 THEN 'medium' WHEN instr(c[3], '🟢') > 0 THEN 'low' END AS severity,
  CASE WHEN len(c) = 7 THEN c[4] END AS confidence, replace(c[len(c) - 2], '`', '') AS evidence, nullif(c[len(c) - 1], '—') AS solution, instr(c[len(c)], 'Yes') > 0 AS fixed
FROM (SELECT session, audit, component, list_transform(string_split(regexp_extract(content, '(?m)^[|] (SEC-.*) [|]$', 1), ' | '), lambda x: trim(x)) AS c FROM fx_reports))"""
ORACLES["h03_parse_findings"] = f"WITH {_PARSED} SELECT * FROM parsed"
_ACCEPTED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY check_id, file ORDER BY coalesce(expires, DATE '9999-12-31') DESC, type DESC NULLS LAST) AS n FROM fx_baseline),
entries AS (SELECT * FROM ranked WHERE n = 1),
accepted AS (SELECT f.* EXCLUDE (status), CASE WHEN coalesce(o.check_id, a.check_id) IS NOT NULL THEN 'ACCEPTED' ELSE f.status END AS status,
  CASE WHEN o.check_id IS NOT NULL THEN o.expires ELSE a.expires END AS expires, CASE WHEN o.check_id IS NOT NULL THEN o.type ELSE a.type END AS baseline_type
  FROM fx_findings f LEFT JOIN entries o ON o.check_id = f.check_id AND o.file = f.file LEFT JOIN entries a ON a.check_id = f.check_id AND a.file IS NULL)"""
ORACLES["h04_apply_baseline"] = (
    f"WITH {_ACCEPTED} SELECT session, audit, check_id, solution, status, expires, baseline_type FROM accepted"
)
_EXPIRED = f"coalesce(status = 'ACCEPTED' AND expires < DATE '{AS_OF}', false)"
ORACLES["h05_expire_baseline"] = f"""WITH {_ACCEPTED}
SELECT session, check_id, solution, CASE WHEN {_EXPIRED} THEN 'FAIL' ELSE status END AS status, CASE WHEN {_EXPIRED} THEN 'high' ELSE severity END AS severity,
  CASE WHEN {_EXPIRED} THEN '[baseline expired: ' || CAST(expires AS VARCHAR) || ']' END AS note FROM accepted"""
ORACLES["h05_expired_entries"] = (
    f"SELECT check_id, expires, accepted_by, reason FROM fx_baseline WHERE expires < DATE '{AS_OF}'"
)
_ENTRY = "b.project = f.project AND b.check_id = f.check_id AND (b.file IS NULL OR b.file = f.file)"
ORACLES["h05_session_status"] = f"""
WITH told AS (SELECT project, session, check_id, file, status, severity, solution,
    EXISTS (SELECT 1 FROM fx_baseline_periods b WHERE {_ENTRY} AND f.session BETWEEN b.since AND coalesce(b.expires, DATE '9999-12-31')) AS valid,
    (SELECT max(b.expires) FROM fx_baseline_periods b WHERE {_ENTRY} AND b.expires < f.session) AS ended FROM fx_findings f)
SELECT project, session, check_id, file, solution, CASE WHEN status = 'FAIL' AND valid THEN 'ACCEPTED' ELSE status END AS status,
  CASE WHEN status = 'FAIL' AND NOT valid AND ended IS NOT NULL THEN 'high' ELSE severity END AS severity,
  CASE WHEN status = 'FAIL' AND NOT valid AND ended IS NOT NULL THEN '[baseline expired: ' || CAST(ended AS VARCHAR) || ']' END AS note FROM told"""
ORACLES["h06_untyped_baseline"] = f"""
SELECT check_id, file, reason, CASE WHEN instr(reason, 'not real') > 0 THEN 'false-positive' WHEN instr(reason, 'intentional') > 0 THEN 'intentional-design' ELSE 'accepted-risk' END AS recommended_type
FROM fx_baseline WHERE type IS NULL OR type NOT IN {_in(fd.BASELINE_TYPES)}"""
ORACLES["h07_component_summary"] = f"""WITH {_ACCEPTED}
SELECT coalesce(component, 'TOTAL') AS component, count(*) FILTER (status = 'FAIL' AND severity = 'critical') AS critical,
  count(*) FILTER (status = 'FAIL' AND severity = 'high') AS high, count(*) FILTER (status = 'FAIL' AND severity IN ('medium', 'low')) AS medium_low,
  count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status = 'FAIL') AS total_fail FROM accepted GROUP BY ROLLUP (component)"""
ORACLES["h08_critical_breakdown"] = """
SELECT component, check_id, "check", evidence, trim(replace(string_split(solution, chr(92) || chr(92))[1], '**', '')) AS resolution
FROM fx_findings WHERE status = 'FAIL' AND severity = 'critical'"""
ORACLES["h09_uncovered_modules"] = f"""
SELECT DISTINCT project, regexp_extract(path, '^(.*/)', 1) AS directory FROM fx_files f WHERE starts_with(path, 'src/') AND {_ext()} IN ('.ts', '.js', '.py')
AND NOT EXISTS (SELECT 1 FROM fx_findings g WHERE g.project = f.project AND starts_with(coalesce(g.evidence, ''), regexp_extract(f.path, '^(.*/)', 1)))"""
ORACLES["h10_weak_evidence"] = """
SELECT session, check_id, solution, CASE WHEN evidence IS NULL THEN 'no evidence' ELSE 'no line, only a file name' END AS problem
FROM fx_findings WHERE status = 'FAIL' AND (evidence IS NULL OR NOT regexp_matches(evidence, ':[0-9]+'))"""
_VERIFIED = """
verified AS (SELECT f.*, CASE WHEN i.path IS NULL THEN 'stale' WHEN instr(evidence, ':') = 0 OR CAST(regexp_extract(evidence, ':([0-9]+)', 1) AS INT) BETWEEN 1 AND len(string_split(i.content, chr(10)))
    THEN 'confirmed' ELSE 'false positive' END AS verdict
  FROM fx_findings f LEFT JOIN fx_imports i ON i.path = string_split(f.evidence, ':')[1])"""
ORACLES["h11_verify_findings"] = f"WITH {_VERIFIED} SELECT session, check_id, solution, evidence, verdict FROM verified"
_VERIFIED_SECRETS = """
verified AS (SELECT f.*, CASE WHEN i.path IS NULL THEN 'stale' WHEN instr(evidence, ':') = 0 OR ends_with(evidence, ':2') THEN 'confirmed' ELSE 'false positive' END AS verdict
  FROM fx_secret_findings f LEFT JOIN fx_secrets i ON i.project = f.project AND i.path = string_split(f.evidence, ':')[1])"""
ORACLES["h11_verify_project_findings"] = f"WITH {_VERIFIED_SECRETS} SELECT project, check_id, severity, evidence, verdict FROM verified"
ORACLES["h12_stale_sessions"] = f"""
SELECT project, session, datediff('day', session, DATE '{AS_OF}') AS age_days FROM fx_sessions WHERE datediff('day', session, DATE '{AS_OF}') > 30"""
ORACLES["h13_latest_session"] = "SELECT project, max(session) AS session FROM fx_sessions GROUP BY project"
ORACLES["h13_keep_newest"] = """
SELECT project, session FROM fx_sessions QUALIFY row_number() OVER (PARTITION BY project ORDER BY session DESC) <= 2"""
ORACLES["h14_merge_reports"] = f"""WITH {_PARSED}
SELECT * FROM (SELECT session, audit, component, check_id, "check", status, severity, evidence, solution FROM parsed
  UNION ALL SELECT session, audit, component, check_id, "check", status, severity, evidence, solution FROM fx_findings)
WHERE status IN ('FAIL', 'ACCEPTED')"""


# A report has one finding, in its fourth line; the third cell of the line is its status.
_SPLICED = """
given AS (SELECT r.report, r.component AS project, string_split(r.content, chr(10)) AS l, i.content AS code, 'src/a' || regexp_extract(r.content, 'src/a([0-9]+)[.]ts', 1) || '.ts' AS path
  FROM fx_reports r LEFT JOIN fx_report_files i ON i.project = r.component AND i.path = 'src/a' || regexp_extract(r.content, 'src/a([0-9]+)[.]ts', 1) || '.ts'),
told AS (SELECT *, CASE WHEN code IS NULL THEN 'gone' WHEN len(string_split(code, chr(10))) < 7 THEN 'false positive' WHEN report % 5 = 0 THEN 'stale' ELSE 'confirmed' END AS verdict,
  code IS NOT NULL AND len(string_split(code, chr(10))) >= 7 AND report % 5 <> 0 AND instr(l[4], 'ACCEPTED') > 0 AS expired FROM given)"""
ORACLES["h14_rewrite_reports"] = f"""WITH {_SPLICED},
cells AS (SELECT *, string_split(l[4], '|') AS c FROM told),
marked AS (SELECT *, CASE WHEN verdict = 'stale' THEN rtrim(c[4]) || ' [✓ stale] ' WHEN expired THEN ' ❌ FAIL 🟠 [baseline expired: 1997-01-01] ' ELSE c[4] END AS state FROM cells)
SELECT project, report, array_to_string(list_concat(l[1:3], CASE WHEN verdict IN ('gone', 'false positive') THEN [] ELSE [array_to_string(list_concat(c[1:3], [state], c[5:]), '|')] END,
  CASE WHEN report % 4 = 0 THEN ['| SEC-07 | Missed | ❌ FAIL 🔴 | `src/b.ts:1` | — | No |'] ELSE [] END, l[5:]), chr(10)) AS content
FROM marked WHERE verdict <> 'confirmed' OR expired OR report % 4 = 0"""
ORACLES["h14_removal_log"] = f"""WITH {_SPLICED}
SELECT project, report, CAST(3 AS INT) AS line, trim(string_split(l[4], '|')[2]) AS check_id,
  CASE verdict WHEN 'gone' THEN '[removed: ' || path || ' not found]' ELSE '[removed: false positive]' END AS reason FROM told WHERE verdict IN ('gone', 'false positive')"""


def _secret_oracle() -> str:
    from ..operators.scans import PLACEHOLDER_VALUE, SECRET_PATTERNS

    placeholder = PLACEHOLDER_VALUE.replace("'", "''")
    lines = """SELECT project, path, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS txt FROM (SELECT project, path, string_split(content, chr(10)) AS p FROM fx_texts)"""
    parts = []
    for name, pattern in SECRET_PATTERNS.items():
        rx = pattern.regex.replace("'", "''")
        parts.append(
            f"""SELECT project, path, line, '{name}' AS pattern, n FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS n, unnest(vs) AS v
FROM (SELECT *, regexp_extract_all(txt, '{rx}', 1) AS vs FROM lines)) WHERE NOT regexp_full_match(v, '{placeholder}')"""
        )
    return f"WITH lines AS ({lines}) " + " UNION ALL ".join(parts)


# By construction of the view: which pattern the second line of a file holds.
_SECRET_KIND = """SELECT 'p' || p_partkey % 10 AS project, 'src/d' || (p_partkey // 10) % 4 AS folder, 'src/d' || (p_partkey // 10) % 4 || '/conf' || (p_partkey // 10) || '.ts' AS path,
  ['assignment', 'cloud access key', 'assignment', 'assignment', 'url credentials', 'url parameter', 'private key', 'repository token', 'model provider key', NULL, NULL, 'assignment'][p_partkey % 12 + 1] AS pattern,
  CASE p_partkey % 12 WHEN 11 THEN 2 ELSE 1 END AS hits FROM part"""
ORACLES["h15_scan_secrets"] = f"""
SELECT project, path, CAST(2 AS BIGINT) AS line, pattern, unnest(range(1, hits + 1)) AS n FROM ({_SECRET_KIND}) WHERE pattern IS NOT NULL"""
ORACLES["h15_scan_patterns"] = _secret_oracle()
ORACLES["h16_critical_paths"] = """
SELECT project, path, tier, CAST(row_number() OVER (PARTITION BY project ORDER BY CASE tier WHEN 'critical' THEN 0 WHEN 'standard' THEN 1 ELSE 2 END, path) AS INTEGER) AS rank FROM (SELECT project, path,
  CASE WHEN regexp_matches(path, '^src/(auth|payments|workers)/') THEN 'critical' WHEN starts_with(path, 'src/utils/') THEN 'low' ELSE 'standard' END AS tier
  FROM fx_files WHERE starts_with(path, 'src/') AND regexp_matches(path || chr(10) || content, 'auth|login|payment|billing|webhook|cron|migration'))"""
_USED = f"""{_runtimes('SELECT project, path FROM fx_env')},
used AS (SELECT DISTINCT project, unnest(CASE runtime
  WHEN 'node' THEN regexp_extract_all(content, '(?:process|import\\.meta)\\.env\\.([A-Z0-9_]+)', 1)
  WHEN 'go' THEN regexp_extract_all(content, 'os\\.Getenv\\("([A-Z0-9_]+)"\\)', 1)
  WHEN 'python' THEN regexp_extract_all(content, 'os\\.environ\\.get\\("([A-Z0-9_]+)', 1)
  WHEN 'rust' THEN regexp_extract_all(content, 'env::var\\("([A-Z0-9_]+)"', 1)
  WHEN 'java' THEN regexp_extract_all(content, 'System\\.getenv\\("([A-Z0-9_]+)"\\)', 1)
  ELSE regexp_extract_all(content, '[A-Z][A-Z0-9_]{{2,}}') END) AS name FROM fx_env JOIN runtimes USING (project))"""
ORACLES["h17_extract_env_vars"] = f"WITH {_USED} SELECT project, name FROM used"
_SYNC = """SELECT project, name, CASE WHEN l IS NULL THEN 'unused' ELSE 'undocumented' END AS problem
FROM (SELECT coalesce(a.project, b.project) AS project, coalesce(a.name, b.name) AS name, a.name AS l, b.name AS r
  FROM used a FULL JOIN listed b ON a.project = b.project AND a.name = b.name) WHERE l IS NULL OR r IS NULL"""
ORACLES["h18_env_sync"] = f"""WITH {_USED},
listed AS (SELECT DISTINCT project, unnest(regexp_extract_all(content, '(?m)^\\s*(?:export +)?([A-Z][A-Z0-9_]*)=', 1)) AS name FROM fx_env WHERE path = '.env.example')
{_SYNC}"""
ORACLES["h18_command_sync"] = f"""WITH used AS (SELECT project, unnest(json_keys(json, '$.scripts')) AS name FROM fx_manifests),
listed AS (SELECT DISTINCT project, unnest(regexp_extract_all(content, '(?:npm|pnpm|yarn) run ([A-Za-z0-9:_-]+)', 1)) AS name FROM fx_readmes)
{_SYNC}"""
# The targets of the links in the view, worked out by hand.
ORACLES["h19_broken_links"] = """
WITH links AS (SELECT DISTINCT project, rel_path, unnest(regexp_extract_all(content, '\\]\\(([^)\\s]+)\\)', 1)) AS link FROM fx_docs),
targets AS (SELECT *, CASE
  WHEN starts_with(link, '#') THEN rel_path WHEN instr(link, 'VISION.md') > 0 THEN '1_PRODUCT_VISION/VISION.md'
  WHEN instr(link, 'SPEC.md') > 0 THEN '2_PRODUCT_SPEC/SPEC.md' ELSE link END AS target, nullif(regexp_extract(link, '#(.*)$', 1), '') AS slug
  FROM links WHERE NOT starts_with(link, 'https:')),
slugs AS (SELECT DISTINCT project, rel_path, replace(lower(unnest(regexp_extract_all(content, '(?m)^#+ +(.*)$', 1))), ' ', '-') AS slug FROM fx_docs)
SELECT project, rel_path, link, problem FROM (SELECT t.*, CASE
  WHEN NOT EXISTS (SELECT 1 FROM fx_docs x WHERE x.project = t.project AND x.rel_path = t.target) THEN 'missing file'
  WHEN t.slug IS NOT NULL AND NOT EXISTS (SELECT 1 FROM slugs s WHERE s.project = t.project AND s.rel_path = t.target AND s.slug = t.slug) THEN 'missing heading' END AS problem
  FROM targets t) WHERE problem IS NOT NULL"""
ORACLES["h20_duplicate_blocks"] = """
WITH lines AS (SELECT project, path, line, txt, CAST(len(regexp_extract_all(txt, '\\S+')) AS BIGINT) AS tokens FROM (
    SELECT project, path, unnest(range(1, len(p) + 1)) AS line, regexp_replace(unnest(p), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS txt
    FROM (SELECT project, path, string_split(content, chr(10)) AS p FROM fx_texts)) WHERE txt <> ''),
windows AS (SELECT project, path, row_number() OVER w AS pos, line, lead(line, 7) OVER w AS last_line,
    string_agg(txt, chr(10)) OVER (PARTITION BY project, path ORDER BY line ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS block
  FROM lines WINDOW w AS (PARTITION BY project, path ORDER BY line)),
shared AS (SELECT * FROM windows WHERE last_line IS NOT NULL AND block IN (SELECT block FROM windows WHERE last_line IS NOT NULL GROUP BY block HAVING count(*) > 1)),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY project, path ORDER BY pos) AS run FROM shared),
blocks AS (SELECT project, path, min(line) AS start_line, max(last_line) AS end_line, count(*) + 7 AS lines FROM runs GROUP BY project, path, run)
SELECT b.project, b.path, start_line, end_line, b.lines, CAST(sum(l.tokens) AS BIGINT) AS tokens
FROM blocks b JOIN lines l ON l.project = b.project AND l.path = b.path AND l.line BETWEEN start_line AND end_line
GROUP BY ALL HAVING sum(l.tokens) >= 50"""
ORACLES["h20_clone_classes"] = r"""
WITH RECURSIVE texts AS (SELECT source AS project, 'doc' || doc_id || '.md' AS path,
    CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), ' ') WHEN 1 THEN replace(text, '. ', '.' || chr(10)) ELSE text END AS content FROM documents),
listed AS (SELECT *, row_number() OVER (ORDER BY project, path) AS file FROM texts),
lined AS (SELECT file, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS txt FROM (SELECT file, string_split(content, chr(10)) AS p FROM listed)),
words AS (SELECT file, line, unnest(range(1, len(t) + 1)) AS k, unnest(t) AS token FROM (SELECT file, line, regexp_extract_all(txt, '[^ \t\n\x0b\f\r]+') AS t FROM lined)),
stream AS (SELECT file, list(token ORDER BY line, k) AS ts, list(line ORDER BY line, k) AS ls FROM words GROUP BY file),
wins AS (SELECT file, s, md5(array_to_string(ts[s + 1 : s + 50], ' ')) AS digest FROM (SELECT file, ts, unnest(range(0, greatest(len(ts) - 49, 0))) AS s FROM stream)),
rep AS (SELECT digest FROM wins GROUP BY digest HAVING count(*) > 1),
shared AS (SELECT file, s, digest, s - row_number() OVER (PARTITION BY file ORDER BY s) AS run FROM wins WHERE digest IN (SELECT digest FROM rep)),
held AS (SELECT *, min(s) OVER (PARTITION BY file, run) AS first, count(*) OVER (PARTITION BY file, run) AS n FROM shared),
numbered AS (SELECT file, first, max(n) + 49 AS tokens, row_number() OVER (ORDER BY file, first) AS id FROM held GROUP BY file, first),
has AS (SELECT DISTINCT n.id, h.digest FROM held h JOIN numbered n ON n.file = h.file AND n.first = h.first),
hub AS (SELECT digest, min(id) AS least FROM has GROUP BY digest),
e0 AS (SELECT DISTINCT id AS a, least AS b FROM has JOIN hub USING (digest) WHERE id <> least),
e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
reach(id, other) AS (SELECT id, id FROM numbered UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other),
class AS (SELECT id, min(other) AS c FROM reach GROUP BY id),
sized AS (SELECT id, c, count(*) OVER (PARTITION BY c) AS members FROM class)
SELECT l.project, l.path, n.first AS start_token, n.tokens, s.ls[n.first + 1] AS start_line, s.ls[n.first + n.tokens] AS end_line,
  hl.project AS class_project, hl.path AS class_path, hn.first AS class_token, z.members
FROM numbered n JOIN sized z ON z.id = n.id JOIN listed l ON l.file = n.file JOIN stream s ON s.file = n.file
JOIN numbered hn ON hn.id = z.c JOIN listed hl ON hl.file = hn.file"""
ORACLES["h21_debt_markers"] = f"""
SELECT project, path, line, problem FROM (SELECT project, path, line, CASE
  WHEN TRY_CAST(regexp_extract(txt, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS DATE) < DATE '{DEBT_AS_OF}' - INTERVAL 6 MONTH THEN 'old'
  WHEN NOT regexp_matches(txt, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND NOT regexp_matches(txt, '(TODO|FIXME)\\([^)]+\\)|@[A-Za-z0-9_-]+')
    AND NOT regexp_matches(txt, '[A-Z][A-Z0-9]+-[0-9]+|#[0-9]+|https?://') THEN 'untracked' END AS problem
  FROM (SELECT project, path, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS txt FROM (SELECT project, path, string_split(content, chr(10)) AS p FROM fx_debt))
  WHERE regexp_matches(txt, '\\b(TODO|FIXME)\\b')) WHERE problem IS NOT NULL"""
ORACLES["h22_verification_totals"] = f"""WITH {_VERIFIED}
SELECT coalesce(audit, 'TOTAL') AS audit, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'false positive') AS false_positive,
  count(*) FILTER (verdict = 'stale') AS stale, count(*) FILTER (verdict = 'missed') AS missed FROM verified GROUP BY ROLLUP (audit)"""

_MISSED = f"""{_VERIFIED_SECRETS},
spots AS (SELECT DISTINCT project, folder, path, pattern FROM ({_SECRET_KIND}) WHERE pattern IS NOT NULL),
named AS (SELECT *, string_split(evidence, ':')[1] AS file, ends_with(evidence, ':2') AS on_line FROM verified),
sources AS (SELECT n.project, s.folder, s.pattern, n.audit, n.check_id, min(s.path) || ':2' AS found_from
  FROM named n JOIN spots s ON s.project = n.project AND s.path = n.file WHERE on_line AND verdict = 'confirmed' AND severity = 'critical' GROUP BY ALL),
missed AS (SELECT s.project, audit, check_id, path, CAST(2 AS BIGINT) AS line, s.pattern, found_from, 'missed' AS verdict
  FROM spots s JOIN sources c ON c.project = s.project AND c.folder = s.folder AND c.pattern = s.pattern
  WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.project = s.project AND n.file = s.path AND on_line))"""
ORACLES["h22_missed_findings"] = f"WITH {_MISSED} SELECT * FROM missed"
ORACLES["h22_verification_with_missed"] = f"""WITH {_MISSED}
SELECT coalesce(project, 'TOTAL') AS project, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'false positive') AS false_positive,
  count(*) FILTER (verdict = 'stale') AS stale, count(*) FILTER (verdict = 'missed') AS missed
FROM (SELECT project, verdict FROM verified UNION ALL SELECT project, verdict FROM missed) GROUP BY ROLLUP (project)"""


def _matrix_oracle() -> str:
    def role(column: str) -> str:
        return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{rx}') THEN '{name}'" for name, rx in ROLES) + " ELSE 'other' END"

    cells = ", ".join(
        f"coalesce(string_agg(purpose, ', ' ORDER BY purpose) FILTER (callee = '{name}'), '') AS {name}"
        for name in [r[0] for r in ROLES] + ["other"]
    )
    return f"""WITH {_RAW},
cells AS (SELECT DISTINCT {role('path')} AS caller, {role('resolved')} AS callee, kind AS purpose FROM resolved WHERE resolved IS NOT NULL)
SELECT caller, {cells} FROM cells GROUP BY caller"""


ORACLES["h23_call_matrix"] = _matrix_oracle()
ORACLES["h24_classify_manifest"] = """
SELECT project, CASE
  WHEN list_has_any(deps, ['react', 'vue']) THEN 'frontend' WHEN list_has_any(dev, ['vite']) THEN 'frontend'
  WHEN list_has_any(deps, ['@nestjs/core', 'express', 'fastify']) THEN 'backend' WHEN json_extract(json, '$.bin') IS NOT NULL THEN 'CLI' ELSE 'library' END AS kind
FROM (SELECT project, json, coalesce(json_keys(json, '$.dependencies'), []) AS deps, coalesce(json_keys(json, '$.devDependencies'), []) AS dev FROM fx_manifests)"""
ORACLES["h25_active_decisions"] = """
SELECT project, rel_path, id, title, status, created_at, CAST(row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id, rel_path) AS INTEGER) AS rank FROM (SELECT project, rel_path, regexp_extract(content, '(?m)^id:\\s*(.*)$', 1) AS id,
  regexp_extract(content, '(?m)^title:\\s*(.*)$', 1) AS title, regexp_extract(content, '(?m)^status:\\s*(.*)$', 1) AS status,
  regexp_extract(content, '(?m)^created_at:\\s*(.*)$', 1) AS created_at FROM fx_decisions)
WHERE status IN ('active', 'needs_review')"""
ORACLES["h26_project_stage"] = """
SELECT project, bool_or(path = 'docs/' || project || '/2_PRODUCT_SPEC/SPEC.md') AS specified, bool_or(starts_with(path, 'prototype/src/')) AS prototyped,
  bool_or(path = 'blueprint/' || project || '/3_TECH_BLUEPRINT/IMPLEMENTATION_GUIDE.md') AS planned,
  bool_or(starts_with(path, 'projects/' || project || '/backend/src/')) AND bool_or(starts_with(path, 'projects/' || project || '/frontend/src/')) AS implemented,
  coalesce(max(modified) FILTER (ends_with(path, 'SPEC.md')) > max(modified) FILTER (ends_with(path, 'DATABASE_MODEL.md')), false) AS outdated
FROM fx_workspace GROUP BY project"""
ORACLES["h27_checks_catalog"] = f"""
WITH catalog AS (SELECT audit, prefix || '-' || lpad(CAST(unnest(range(1, n + 1)) AS VARCHAR), 2, '0') AS check_id
  FROM (VALUES {', '.join(f"('{a}', '{p}', {n})" for a, (p, n) in fd.CHECKS.items())}) t(audit, prefix, n))
SELECT c.check_id, c.audit, count(f.status) FILTER (f.status <> 'UNVERIFIED') AS checked, count(f.status) FILTER (f.status = 'UNVERIFIED') AS not_checked
FROM catalog c LEFT JOIN fx_findings f ON f.check_id = c.check_id GROUP BY ALL"""
