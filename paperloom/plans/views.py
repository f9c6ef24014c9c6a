"""Input views the queries run on, derived from the driver tables.

Every view is plain SQL that Spark and DuckDB read alike; ``{bytes}`` stands for the one
function whose name differs. No backslash is written, since the two read it differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"
TICKS = "chr(96) || chr(96) || chr(96)"


def _text(*lines: str) -> str:
    """SQL for lines joined by newlines; a line is an SQL expression."""
    return f" || {NL} || ".join(lines)


VIEWS: dict[str, str] = {}

# Documents laid out as the files of twenty projects.
VIEWS["fx_files"] = """
SELECT source AS project,
  CASE WHEN i % 10 = 9 THEN
    CASE i WHEN 9 THEN CASE doc_id % 5 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' WHEN 2 THEN 'pyproject.toml'
                                       WHEN 3 THEN 'Cargo.toml' ELSE 'notes.txt' END
           WHEN 19 THEN 'docker-compose.yml' WHEN 29 THEN 'Dockerfile' WHEN 39 THEN '.env.example'
           ELSE 'readme' || CAST(i AS STRING) || '.md' END
  ELSE CASE i % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/auth/' WHEN 2 THEN 'node_modules/dep/' WHEN 3 THEN 'docs/'
                  WHEN 4 THEN 'src/api/' WHEN 5 THEN 'dist/' WHEN 6 THEN 'lib/.git/' ELSE 'logs/' END
    || 'f' || CAST(doc_id AS STRING)
    || CASE i % 11 WHEN 0 THEN '.ts' WHEN 1 THEN '.md' WHEN 2 THEN '.png' WHEN 3 THEN '.xyz' WHEN 4 THEN '.tsx'
                   WHEN 5 THEN '.log' WHEN 6 THEN '.html' WHEN 7 THEN '.py' WHEN 8 THEN '.PNG' WHEN 9 THEN '.js' ELSE '' END
  END AS path,
  CAST({bytes}(text) AS BIGINT) AS length, text AS content, i AS seq
FROM (SELECT *, CAST(floor(doc_id / 20) AS BIGINT) AS i FROM documents) d
"""

VIEWS["fx_ignore_files"] = f"""
SELECT project, 1 AS origin_ord, {_text("'node_modules'", "'dist'")} AS content FROM (SELECT DISTINCT source AS project FROM documents) a
UNION ALL
SELECT project, 2, {_text("'# comment'", "'*.log'", "''", "'  build/  '")} FROM (SELECT DISTINCT source AS project FROM documents) b
UNION ALL
SELECT project, 3, CASE WHEN length(project) = 4 THEN {_text("'!logs/f*.log'", "'/docs/'")}
  ELSE {_text("'src/**/f*.ts'", "'f?.md'", "'[l-m]ib'", "'readme*'", "'!readme59.md'")} END
FROM (SELECT DISTINCT source AS project FROM documents) c
"""

VIEWS["fx_code"] = f"""
SELECT 'p' || CAST(p_partkey % 10 AS STRING) AS project,
  'src/part' || CAST(p_partkey AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '.js' END AS path,
  {_text(
    "'// ' || p_name",
    "'const url = \"http://x//' || CAST(p_partkey AS STRING) || '\"; /* ' || p_brand || ' */'",
    "CASE p_partkey % 4 WHEN 0 THEN '/** doc */' WHEN 1 THEN '// TODO PROJ-' || CAST(p_partkey AS STRING) "
    "WHEN 2 THEN '// @ts-ignore' ELSE '//! keep' END",
    "'const v = a/*c*/b;'",
    "'const t = ' || chr(96) || 'x // y ' || p_type || chr(96) || '; // ' || p_name || ' is a longer remark than sixty bytes can hold, ' || p_type",
    "CASE p_partkey % 3 WHEN 1 THEN 'const j = <b>{{/* none */}}</b>;' ELSE 'const j = 1;' END",
    "'const e = process.env.VAR_' || CAST(p_partkey % 7 AS STRING) || ';'",
  )} AS content
FROM part
"""

# Components with templates in templates and text between tags. Each line is a list of SQL parts; those
# in a tuple are comments that go.
_NESTED = {
    "tsx": [
        ["'import x from \"a\"; '", ("'// ' || p_name",)],
        ["'const a = <a href=\"http://x\">see http://h/x now</a>;'"],
        ["'const b = <p>it''s part ' || CAST(p_partkey AS STRING) || ' // not gone</p>; '", ("'// ' || p_brand",)],
        ["'const c = <div>'", ("'{{/* ' || p_brand || ' */}}'",), "'{{a'", ("'/* braces stay */'",), "'}}<b/></div>;'"],
        ["'const t = ' || chr(96) || 'x $' || '{{a '", ("'/* ' || p_type || ' */'",), "'}} // y $' || '{{' || chr(96) || 'in $' || '{{b}}' || chr(96) || '}}' || chr(96) || '; '", ("'/* z */'",)],
        ["'const f = <T,>(x: T) => x < 2; '", ("'// generic, no tag'",)],
    ],
    "ts": [
        ["'const t = ' || chr(96) || 'x $' || '{{f('", ("'/* ' || p_type || ' */'",), "' 1)}} // ' || p_name || chr(96) || ';'", ("'// ' || p_name",)],
        ["'const q = a < b; '", ("'/* ' || p_brand || ' */'",)],
    ],
}


def nested_text(kind: str, comments: bool = True) -> str:
    """SQL for the text of a component, with or without its comments."""
    lines = [[part if isinstance(part, str) else part[0] for part in line if comments or isinstance(part, str)] for line in _NESTED[kind]]
    return _text(*[" || ".join(line) for line in lines])


def nested_comments(kind: str) -> int:
    return sum(isinstance(part, tuple) for line in _NESTED[kind] for part in line)


def _components(comments: bool) -> str:
    return f"""
SELECT 'p' || CAST(p_partkey % 10 AS STRING) AS project,
  'src/comp' || CAST(p_partkey AS STRING) || CASE p_partkey % 2 WHEN 0 THEN '.tsx' ELSE '.ts' END AS path,
  CASE p_partkey % 2 WHEN 0 THEN {nested_text("tsx", comments)} ELSE {nested_text("ts", comments)} END AS content,
  CASE p_partkey % 2 WHEN 0 THEN {nested_comments("tsx")} ELSE {nested_comments("ts")} END AS comments
FROM part
"""


VIEWS["fx_components"] = _components(True)
# The same texts written without the comments, for comparison.
VIEWS["fx_components_bare"] = _components(False)

VIEWS["fx_pages"] = "SELECT 'web' || CAST(page_id % 10 AS STRING) AS project, 'page' || CAST(page_id AS STRING) || '.html' AS path, html AS content FROM pages"

VIEWS["fx_texts"] = "SELECT source AS project, 'doc' || CAST(doc_id AS STRING) || '.md' AS path, text AS content FROM documents"

VIEWS["fx_imports"] = f"""
SELECT 'app' AS project, 'src/part' || CAST(p_partkey AS STRING) || '.ts' AS path,
  {_text(
    "'import a from \"./part' || CAST(p_partkey * 2 + 1 AS STRING) || '\";'",
    "'export * from \"./part' || CAST(p_partkey * 2 + 2 AS STRING) || '.js\";'",
    "'import type {{ T }} from \"../src/part' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) || '\";'",
    "'import r from \"react\";'",
  )} AS content
FROM part
"""

# Ten projects that use one alias for different folders, by configuration files that extend each other.
VIEWS["fx_aliased"] = f"""
SELECT 'al' || CAST(p_partkey % 10 AS STRING) AS project,
  CASE WHEN p_partkey % 10 < 5 THEN 'src/' ELSE 'lib/' END || 'part' || CAST(p_partkey AS STRING) || CASE p_partkey % 4 WHEN 0 THEN '/index.ts' ELSE '.ts' END AS path,
  {_text(
    "'import a from \"@/part' || CAST(p_partkey + 10 AS STRING) || '\";'",
    "'import b from \"@/deep/part' || CAST(p_partkey + 20 AS STRING) || '\";'",
    "'import c from \"part' || CAST(p_partkey + 30 AS STRING) || '\";'",
    "'import d from \"first\";'",
    "'import r from \"react\";'",
  )} AS content
FROM part
""" + """UNION ALL
SELECT DISTINCT 'al' || CAST(p_partkey % 10 AS STRING), 'tsconfig.json',
  CASE WHEN p_partkey % 10 IN (0, 5) THEN '{{"compilerOptions":{{"paths":{{"@/*":["' || CASE WHEN p_partkey % 10 = 0 THEN 'src' ELSE 'lib' END || '/*"],"first":["src/part10","lib/part15"]}}}}}}'
       WHEN p_partkey % 10 IN (1, 6) THEN '{{"extends":"./conf/one","compilerOptions":{{"strict":true}}}}'
       WHEN p_partkey % 10 IN (2, 7) THEN '{{"extends":"./conf/one.json","compilerOptions":{{"baseUrl":"' || CASE WHEN p_partkey % 10 = 2 THEN 'src' ELSE 'lib' END || '"}}}}'
       WHEN p_partkey % 10 IN (3, 8) THEN '{{"compilerOptions":{{"paths":{{"@/*":["none/*"],"@/deep/*":["none/*","src/*","lib/*"]}}}}}}'
       ELSE '{{}}' END
FROM part
UNION ALL
SELECT DISTINCT 'al' || CAST(p_partkey % 10 AS STRING), 'conf/one.json', '{{"extends":"./two"}}' FROM part
UNION ALL
SELECT DISTINCT 'al' || CAST(p_partkey % 10 AS STRING), 'conf/two.json',
  CASE WHEN p_partkey % 10 IN (1, 6) THEN '{{"compilerOptions":{{"paths":{{"@/deep/*":["../src/*","../lib/*"]}}}}}}' ELSE '{{"compilerOptions":{{"paths":{{"@/*":["*"]}}}}}}' END
FROM part
"""

# Modules in blocks of seven: a chain through the block, a way back from its fourth to its first, and a
# way on to the next block of ten.
VIEWS["fx_modules"] = f"""
SELECT 'p' || CAST(CAST(floor(p_partkey / 700) AS BIGINT) AS STRING) AS project, 'src/m' || lpad(CAST(p_partkey AS STRING), 7, '0') || '.ts' AS path,
  {_text(
    "CASE WHEN p_partkey % 7 < 6 THEN 'import a from \"./m' || lpad(CAST(p_partkey + 1 AS STRING), 7, '0') || '\";' ELSE '' END",
    "CASE WHEN p_partkey % 7 = 3 THEN 'import b from \"./m' || lpad(CAST(p_partkey - 3 AS STRING), 7, '0') || '\";' ELSE '' END",
    "CASE WHEN p_partkey % 70 < 63 THEN 'export * from \"./m' || lpad(CAST(p_partkey + 7 AS STRING), 7, '0') || '\";' ELSE '' END",
  )} AS content
FROM part
"""

# Project trees with settings and ignore files of their own.
VIEWS["fx_tree"] = """
SELECT project, path, CAST({bytes}(content) AS BIGINT) AS length, content FROM (
  SELECT 'p' || CAST(p_partkey % 10 AS STRING) AS project,
    CASE p_partkey % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib/' WHEN 2 THEN 'node_modules/x/' ELSE 'gen/' END || 'f' || CAST(p_partkey AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.md' ELSE '.js' END AS path,
    'const a = 1; // ' || p_name || chr(10) || '/** doc */' || chr(10) || 'b/* c */(d);' AS content
  FROM part
  UNION ALL SELECT DISTINCT 'p' || CAST(p_partkey % 10 AS STRING), '.gitignore', 'gen' || chr(10) FROM part) t
"""

VIEWS["fx_tree_config"] = """
SELECT DISTINCT 'p' || CAST(p_partkey % 10 AS STRING) AS project,
  CASE p_partkey % 10 WHEN 0 THEN '{{"cleaner":{{"ignore":["src/f1*.ts"]}}}}' WHEN 1 THEN '{{"packer":{{"ignore":[]}}}}'
    WHEN 2 THEN '{{"cleaner":{{"useGitignore":false}}}}' WHEN 3 THEN '{{"packer":{{"useGitignore":false,"ignore":["lib"]}}}}'
    WHEN 4 THEN '{{"cleaner":{{"useGitignore":"no"}}}}' WHEN 5 THEN '{{"cleaner":{{"keepJSDoc":false,"whitelist":[]}}}}' ELSE '{{}}' END AS json
FROM part WHERE p_partkey % 10 < 8
"""

VIEWS["fx_changes"] = """
SELECT k AS list, 'src/part' || CAST(doc_id AS STRING) || CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '.js' END AS path
FROM (SELECT doc_id, 'staged' AS k FROM labels WHERE quality = 1
      UNION ALL SELECT doc_id, 'unstaged' FROM labels WHERE toxic = 1
      UNION ALL SELECT doc_id, 'untracked' FROM labels WHERE quality = 0 AND toxic = 0) l
"""

VIEWS["fx_config"] = """
SELECT 'proj' || CAST(s_suppkey AS STRING) AS project,
  CASE s_suppkey % 7
    WHEN 0 THEN '{{"cleaner":{{"keepJSDoc":false}}}}'
    WHEN 1 THEN '{{"packer":{{"ignore":[]}},"unknown":1}}'
    WHEN 2 THEN '{{"cleaner":{{"whitelist":["keep' || CAST(s_suppkey AS STRING) || '"]}},"prompts":{{"pack":"p.md"}}}}'
    WHEN 3 THEN '{{"packer":{{"useGitignore":false,"contentBasedBinaryDetection":true}}}}'
    WHEN 4 THEN '{{"packer":{{"useGitignore":"wrong"}}}}'
    WHEN 5 THEN '{{"cleaner":{{"useGitignore":false,"ignore":["a","b"]}}}}'
    ELSE CASE s_suppkey % 3 WHEN 0 THEN '{{"prompts":{{"pack":5}}}}' WHEN 1 THEN '{{"cleaner":{{"whitelist":["a",1]}}}}' ELSE '{{}}' END END AS json
FROM supplier
"""

VIEWS["fx_manifests"] = """
SELECT 'proj' || CAST(s_suppkey AS STRING) AS project,
  CASE s_suppkey % 7
    WHEN 0 THEN '{{"dependencies":{{"react":"1","express":"2"}},"scripts":{{"dev":"x","build":"y"}}}}'
    WHEN 1 THEN '{{"devDependencies":{{"vite":"1"}},"bin":"x"}}'
    WHEN 2 THEN '{{"dependencies":{{"express":"1"}},"bin":"x","scripts":{{"dev":"z"}}}}'
    WHEN 3 THEN '{{"dependencies":{{"lodash":"1"}},"bin":{{"tool":"x"}}}}'
    WHEN 4 THEN '{{"dependencies":{{"@nestjs/core":"1"}}}}'
    WHEN 5 THEN '{{"dependencies":{{"vue":"3"}}}}'
    ELSE '{{"scripts":{{"test":"t"}}}}' END AS json
FROM supplier
"""

VIEWS["fx_templates"] = """
SELECT lower(n_name) || '.md' AS name,
  CASE n_regionkey WHEN 0 THEN 'Plain prompt of ' || n_name
    ELSE 'Files: {{{{fileList}}}} Tokens: {{{{tokenCount}}}} Cost: {{{{usdEstimate}}}} {{{{context}}}} again {{{{tokenCount}}}}' END AS content
FROM nation
UNION ALL
SELECT lower(n_name) || '.txt', 'Second choice of ' || n_name FROM nation
"""

VIEWS["fx_prompts"] = """
SELECT c_custkey AS id,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN lower(n_name) || '.md' WHEN 'MACHINERY' THEN c_name
    WHEN 'FURNITURE' THEN 'prompts/' || c_name WHEN 'BUILDING' THEN 'line' || chr(10) || 'a/b.md' ELSE '   ' END AS source,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN lower(n_name) WHEN 'MACHINERY' THEN lower(n_name) || '.txt'
    WHEN 'FURNITURE' THEN c_name ELSE lower(n_name) || '.doc' END AS named
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

VIEWS["fx_project_prompts"] = """
SELECT source AS project,
  CASE n_regionkey WHEN 0 THEN lower(n_name) || '.md' WHEN 1 THEN 'summarize this' WHEN 2 THEN 'missing/prompt.md'
    WHEN 3 THEN lower(n_name) || '.md' END AS source,
  CASE n_regionkey WHEN 2 THEN lower(n_name) WHEN 3 THEN lower(n_name) || '.txt' WHEN 4 THEN 'nowhere' END AS named
FROM (SELECT DISTINCT source FROM documents) d JOIN nation ON source = 'src' || CAST(n_nationkey AS STRING)
"""

_DOC_DATE = "'**Date:** 2024-0' || CAST(1 + s_suppkey % 9 AS STRING) || '-11'"
VIEWS["fx_docs"] = f"""
SELECT 'proj' || CAST(s_suppkey AS STRING) AS project, 'INDEX.md' AS rel_path,
  {_text(
    "'# Index'",
    "'**Status:** draft | ' || " + _DOC_DATE,
    "'## Navigation'",
    "'- [Vision](1_PRODUCT_VISION/VISION.md)'",
    "'- [Spec](./2_PRODUCT_SPEC/SPEC.md#key-operations)'",
    "CASE WHEN s_nationkey = 3 THEN '- [Gone](./old/PLAN.md)' ELSE '- [Site](https://example.com/a.md)' END",
    "'## Quick links'",
    "'- [Top](#navigation)'",
  )} AS content
FROM supplier WHERE s_acctbal >= 0
UNION ALL
SELECT 'proj' || CAST(s_suppkey AS STRING), '1_PRODUCT_VISION/VISION.md',
  {_text(
    "'# ' || s_name",
    "'**Status:** ' || CASE s_suppkey % 13 WHEN 0 THEN 'unknown' WHEN 1 THEN 'in review' WHEN 2 THEN 'approved' ELSE 'draft' END || ' | ' || "
    + _DOC_DATE,
    "'## Problem'",
    "CASE WHEN s_suppkey % 11 = 0 THEN 'Short.' ELSE 'Suppliers cannot compare their delivery schedules across several regional warehouses today.' END",
    "'## Target audience'",
    "'Regional warehouse managers who plan deliveries for several suppliers every week of the year.'",
    "'## Goal'",
    "'Give suppliers delivery schedules in one place so that every warehouse plans with the same numbers.'",
    "'## Key capabilities'",
    "'1. **Compare** delivery schedules across warehouses'",
    "CASE WHEN s_nationkey % 4 = 0 THEN '2. Forecast seasonal demand beyond horizon' ELSE '2. Export delivery schedules nightly' END",
    "'## Success metrics'",
    "'| Metric | Target value |'",
    "'|---|---|'",
    "'| Orders | ' || CASE WHEN s_suppkey % 17 = 0 THEN 'many' ELSE CAST(s_suppkey AS STRING) END || ' |'",
    "'| Delay | 30 minutes at most for every confirmed order |'",
    "'## In scope'",
    "'1. Compare delivery schedules of the chosen warehouses'",
    "CASE WHEN s_nationkey % 6 = 0 THEN '- Quarterly procurement forecasting workshops' ELSE '- Export the delivery calendar nightly' END",
    "'## Out of scope'",
    "CASE WHEN s_suppkey % 3 = 0 THEN '- Delivery schedules for customers' ELSE '- Payroll accounting exports' END",
    "'* Hardware *procurement* planning'",
    "CASE WHEN s_suppkey % 19 = 0 THEN '[fill this in]' ELSE 'See [spec](../2_PRODUCT_SPEC/SPEC.md) for a ' || CASE WHEN s_suppkey % 23 = 0 THEN 'fast' ELSE 'measured' END || ' start.' END",
  )}
FROM supplier
UNION ALL
SELECT 'proj' || CAST(s_suppkey AS STRING), '2_PRODUCT_SPEC/SPEC.md',
  {_text(
    "'# Spec'",
    "'**Status:** draft | **Date:** 2024-02-01'",
    "'## References'",
    "'- [Vision](../1_PRODUCT_VISION/VISION.md#goal)'",
    "'## How the system works'",
    "'The service collects the schedules of every supplier each night and shows them side by side.'",
    TICKS + " || 'text'",
    "'[not a placeholder] but fast code'",
    TICKS,
    "'## Glossary'",
    "'| Term | Definition |'",
    "'|---|---|'",
    "'| ' || CASE WHEN s_suppkey % 4 = 0 THEN 'Manifest' ELSE 'Warehouse' END || ' | a place or a list that the teams agreed on |'",
    "'## Entities'",
    "'| Entity | Description |'",
    "'|---|---|'",
    "'| ' || CASE WHEN s_nationkey % 5 = 0 THEN 'Carrier' ELSE 'Schedule' END || ' | what is compared for every supplier and warehouse |'",
    "'## Pages and screens'",
    "'The comparison page lists the schedules by warehouse and by day of the chosen week.'",
    "'## Key operations'",
    "'- Compare ' || CASE WHEN s_suppkey % 9 = 0 THEN 'lists' ELSE 'delivery schedules' END || ' per warehouse and export the delivery calendar nightly'",
    "'## Integrations'",
    "CASE WHEN s_nationkey = 7 THEN '[todo](#unknown-part)' ELSE 'None.' END",
    "'## Testing'",
    "'**Critical scenarios** compare, export'",
    "CASE WHEN s_nationkey % 8 = 1 THEN 'More to come in the next weeks of the project.' ELSE '**Business rules** one schedule per supplier' END",
    "'**Negative scenarios** no schedule'",
    "'## Artifacts'",
    "'- part' || CAST(s_suppkey AS STRING) || '.png'",
  )}
FROM supplier
"""

# The same documents with the heading that is also a banned word, and stops nearly all of them, in a code
# block, and some projects with a refused name.
VIEWS["fx_gate"] = f"""
SELECT CASE WHEN CAST(substr(project, 5) AS INT) % 29 = 3 THEN replace(project, 'proj', 'my proj') ELSE project END AS project, rel_path,
  replace(content, '## Quick links', {TICKS} || {NL} || '## Quick links' || {NL} || {TICKS}) AS content
FROM ({VIEWS["fx_docs"]}) g
"""

VIEWS["fx_artifacts"] = """
SELECT DISTINCT 'proj' || CAST(l_suppkey AS STRING) AS project, '3_ARTIFACTS/part' || CAST(l_partkey % 150 AS STRING) || '.png' AS rel_path
FROM lineitem
"""

VIEWS["fx_runbooks"] = f"""
SELECT 'proj' || CAST(s_suppkey AS STRING) AS project, 'RUNBOOK.md' AS rel_path,
  {_text("'# Runbook'", "''", "'## Stand: dev (dev stand)'", "'- ' || s_name", "'- b'", "''", "'## Stand: prod (prod)'", "'- c'", "''")} AS content
FROM supplier
"""

VIEWS["fx_blueprints"] = f"""
SELECT 'proj' || CAST(s_suppkey AS STRING) AS project, 'DATABASE_MODEL.md' AS rel_path,
  {_text(
    "'## Schema'",
    TICKS + " || CASE WHEN s_nationkey = 11 THEN 'sql' ELSE 'prisma' END",
    "'model Supplier {{'", "'  id Int'", "CASE WHEN s_suppkey % 3 = 0 THEN '  name String' ELSE '  createdAt DateTime' END", "'}}'",
    "'model Invoice {{'", "'  id Int'", "'  updatedAt DateTime'", "'}}'",
    "'model Crate_Tag {{'", "'  id Int'", "'}}'",
    TICKS,
    "CASE WHEN s_suppkey % 4 = 0 THEN '### Migration Plan' ELSE 'From SPEC.md' END",
  )} AS content
FROM supplier
UNION ALL
SELECT 'proj' || CAST(s_suppkey AS STRING), 'API_CONTRACTS.md',
  {_text(
    TICKS + " || 'graphql'",
    "'type Query {{'",
    "'  suppliers' || CASE WHEN s_suppkey % 2 = 0 THEN '(first: Int)' ELSE '' END || ': [Supplier]'",
    "'  a: Int'", "'  b: Int'", "'  c: Int'", "'  d: Int'", "'  e: Int'", "'  f: Int'", "'  g: Int'",
    "'  parts(filter: {{ open: Int }}): [Part]'",
    "'}}'",
    "'type Mutation'", "'{{'", "'  skipped: [Supplier]'", "'}}'",
    "'type Row {{'", "'  tags: [String]'", "'}}'",
    "CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'type Invoice {{ id: Int }}' END",
    TICKS,
    "'See VISION.md'",
  )}
FROM supplier WHERE s_acctbal >= 0
UNION ALL
SELECT 'proj' || CAST(s_suppkey AS STRING), 'ARCHITECTURE.md', {_text("'## Modules'", "CASE WHEN s_suppkey % 6 = 0 THEN 'src/features/cart/ui' ELSE 'Cart, Orders' END")} FROM supplier
UNION ALL
SELECT 'proj' || CAST(s_suppkey AS STRING), 'IMPLEMENTATION_GUIDE.md', {_text("'## Stack'", "CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE '## Already Implemented' END", "'## Local Setup'")} FROM supplier
UNION ALL
SELECT 'proj' || CAST(s_suppkey AS STRING), 'TESTING_PLAN.md', '## Unit tests' FROM supplier
"""

VIEWS["fx_findings"] = """
SELECT CAST(o_orderdate AS DATE) AS session,
  CASE o_orderkey % 3 WHEN 0 THEN 'audit-secrets' WHEN 1 THEN 'audit-owasp' ELSE 'audit-errors' END AS audit,
  'comp' || CAST(o_custkey % 9 AS STRING) AS component,
  CASE o_orderkey % 3 WHEN 0 THEN 'SEC-0' WHEN 1 THEN 'OWA-0' ELSE 'ERR-0' END || substr(o_orderpriority, 1, 1) AS check_id,
  'Rule ' || substr(o_orderpriority, 3) AS check,
  CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'UNVERIFIED' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  'src' || CAST(o_custkey % 20 AS STRING) AS project,
  'src/part' || CAST(o_custkey * 2 AS STRING) || '.ts' AS file,
  CASE WHEN o_totalprice < 1500 THEN CAST(NULL AS STRING) WHEN o_totalprice < 50000 THEN 'src/part' || CAST(o_custkey * 2 AS STRING) || '.ts'
    ELSE 'src/part' || CAST(o_custkey * 2 AS STRING) || '.ts:' || CAST(o_orderkey % 9 AS STRING) END AS evidence,
  '**1. Fix ' || CAST(o_orderkey AS STRING) || '** ' || chr(92) || chr(92) || ' 2. Replace ' || chr(92) || chr(92) || ' 3. Keep' AS solution
FROM orders
"""

VIEWS["fx_reports"] = f"""
SELECT CAST(o_orderdate AS DATE) AS session, 'audit-secrets' AS audit, 'comp' || CAST(o_custkey % 9 AS STRING) AS component, o_orderkey AS report,
  {_text(
    "'# Audit Report'",
    "CASE WHEN o_orderpriority < '3' THEN '| Check ID | Check | Status | Evidence | Solution | Fixed |' ELSE '| Check ID | Check | Status | Confidence | Evidence | Solution | Fixed |' END",
    "'|----------|----------|----|---|'",
    "'| SEC-0' || substr(o_orderpriority, 1, 1) || ' | Rule ' || CAST(o_orderkey AS STRING) || ' | ' || CASE o_orderstatus WHEN 'F' THEN '❌ FAIL ' || "
    "CASE o_orderkey % 4 WHEN 0 THEN '🔴' WHEN 1 THEN '🟠' WHEN 2 THEN '🟡' ELSE '🟢' END WHEN 'O' THEN '✅ PASS' ELSE '⏸ ACCEPTED' END || ' | '"
    " || CASE WHEN o_orderpriority < '3' THEN '' ELSE 'High | ' END || chr(96) || 'src/a' || CAST(o_custkey AS STRING) || '.ts:7' || chr(96)"
    " || ' | ' || CASE o_orderstatus WHEN 'F' THEN '**1. Fix** ' || chr(92) || chr(92) || ' 2. Keep' ELSE '—' END || ' | '"
    " || CASE WHEN o_totalprice > 200000 THEN '✅ Yes' ELSE 'No' END || ' |'",
    "'Checked: src/**'",
  )} AS content
FROM orders
"""

VIEWS["fx_baseline"] = """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'SEC-0' WHEN 1 THEN 'OWA-0' ELSE 'ERR-0' END || CAST(1 + c_nationkey % 5 AS STRING) AS check_id,
  CASE WHEN c_acctbal > 9900 THEN CAST(NULL AS STRING) ELSE 'src/part' || CAST(c_custkey * 2 AS STRING) || '.ts' END AS file,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'intentional helper' WHEN 'MACHINERY' THEN 'tool was wrong, not real' ELSE 'limit at the proxy' END AS reason,
  CASE WHEN c_acctbal < 2000 THEN CAST(NULL AS STRING) WHEN c_acctbal < 4000 THEN 'other' WHEN c_acctbal < 6000 THEN 'false-positive' ELSE 'accepted-risk' END AS type,
  c_name AS accepted_by,
  CASE WHEN c_acctbal < 3000 THEN DATE '1996-12-31' WHEN c_acctbal < 6000 THEN DATE '2099-01-01' ELSE CAST(NULL AS DATE) END AS expires
FROM customer
"""

# Files of ten projects with equal paths; the second line holds a secret of each kind or a placeholder.
_P = "CAST(p_partkey AS STRING)"
SECRET_LINES = [
    f"""'password = "hunter' || {_P} || '", token = "example"'""",
    f"""'AKIA' || lpad({_P}, 16, '0') || ' key = "todo"'""",
    f"""'"password": "hunter' || {_P} || '"'""",
    f"""'dbPassword = "hunter' || {_P} || '"'""",
    f"""'url = postgres://user:pass' || {_P} || '@host/db'""",
    f"""'fetch("http://h/x?api_key=abc' || {_P} || '&y=1")'""",
    "'-----BEGIN RSA PRIVATE KEY-----'",
    f"""'ghp_' || lpad({_P}, 36, '0')""",
    f"""'x sk-' || lpad({_P}, 24, '0')""",
    """CASE CAST(floor(p_partkey / 12) AS BIGINT) % 12 WHEN 0 THEN 'secret = "<secret>"' WHEN 1 THEN 'secret = "$' || '{{SECRET}}"' WHEN 2 THEN 'secret = "xxxx"'
      WHEN 3 THEN 'secret = "****"' WHEN 4 THEN 'secret = "your-secret"' WHEN 5 THEN 'secret = "changeme"' WHEN 6 THEN 'secret = "EXAMPLE"'
      WHEN 7 THEN 'secret = "placeholder"' WHEN 8 THEN 'secret = "todo"' WHEN 9 THEN 'secret = "..."' WHEN 10 THEN 'secret = "{{{{secret}}}}"' ELSE 'secret = "%s"' END""",
    "CASE p_partkey % 2 WHEN 0 THEN 'url = https://user:$' || '{{PASS}}@host' ELSE 'GET /x?token=<token>' END",
    f"""'api_token = "a' || {_P} || '", monkey = "no", x-secret: ' || chr(39) || 'b' || {_P} || chr(39)""",
]
VIEWS["fx_secrets"] = f"""
SELECT 'p' || CAST(p_partkey % 10 AS STRING) AS project,
  'src/d' || CAST(CAST(floor(p_partkey / 10) AS BIGINT) % 4 AS STRING) || '/conf' || CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS STRING) || '.ts' AS path,
  {_text("'const keyboard = \"a\";'", "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN {line}" for i, line in enumerate(SECRET_LINES)) + " END", "'end'")} AS content
FROM part
"""

# Findings about those files: some on the line of the secret, some on another or on no line at all.
VIEWS["fx_secret_findings"] = """
SELECT 'p' || CAST(p_partkey % 10 AS STRING) AS project, 'audit-secrets' AS audit, 'SEC-0' || CAST(1 + p_partkey % 3 AS STRING) AS check_id, 'FAIL' AS status,
  CASE p_size % 3 WHEN 0 THEN 'high' ELSE 'critical' END AS severity,
  'src/d' || CAST(CAST(floor(p_partkey / 10) AS BIGINT) % 4 AS STRING) || '/conf' || CAST(CAST(floor(p_partkey / 10) AS BIGINT) + CASE p_partkey % 7 WHEN 5 THEN 1000000 ELSE 0 END AS STRING) || '.ts'
    || CASE p_partkey % 7 WHEN 0 THEN ':2' WHEN 1 THEN ':9' WHEN 2 THEN '' ELSE ':2' END AS evidence
FROM part WHERE p_partkey % 13 = 0
"""

# Entries that hold from a day on, some until another: several for one file, and some for all files of a check.
VIEWS["fx_baseline_periods"] = """
SELECT 'src' || CAST(c_custkey % 20 AS STRING) AS project,
  CASE c_custkey % 3 WHEN 0 THEN 'SEC-0' WHEN 1 THEN 'OWA-0' ELSE 'ERR-0' END || CAST(1 + c_nationkey % 5 AS STRING) AS check_id,
  CASE WHEN c_acctbal > 9700 THEN CAST(NULL AS STRING) ELSE 'src/part' || CAST((c_custkey % 200) * 2 AS STRING) || '.ts' END AS file,
  CAST(DATE '1992-01-01' + INTERVAL 1 DAY * (c_custkey % 2500) AS DATE) AS since,
  CASE WHEN c_acctbal < 0 THEN CAST(NULL AS DATE) ELSE CAST(DATE '1992-03-01' + INTERVAL 1 DAY * (c_custkey % 2500 + c_nationkey * 9 - 30) AS DATE) END AS expires
FROM customer
"""

# Files the reports speak of: every third has the line, every third is too short, the others are gone.
VIEWS["fx_report_files"] = """
SELECT 'comp' || CAST(c_custkey % 9 AS STRING) AS project, 'src/a' || CAST(c_custkey AS STRING) || '.ts' AS path,
  CASE c_custkey % 3 WHEN 0 THEN repeat('x' || chr(10), 9) ELSE 'x' END AS content
FROM customer WHERE c_custkey % 3 < 2
"""

VIEWS["fx_sessions"] = "SELECT DISTINCT 'comp' || CAST(o_custkey % 9 AS STRING) AS project, CAST(o_orderdate AS DATE) AS session FROM orders"

VIEWS["fx_env"] = f"""
SELECT 'p' || CAST(p_partkey % 10 AS STRING) AS project, 'src/m' || CAST(p_partkey AS STRING) || '.ts' AS path,
  {_text(
    "'a = process.env.VAR_' || CAST(p_size AS STRING) || ' + import.meta.env.VITE_' || CAST(p_size % 5 AS STRING)",
    "'b = os.Getenv(\"GO_' || CAST(p_size AS STRING) || '\")'",
    "'c = os.environ.get(\"PY_' || CAST(p_size AS STRING) || '\")'",
    "'d = std::env::var(\"RS_' || CAST(p_size AS STRING) || '\")'",
    "'e = System.getenv(\"JV_' || CAST(p_size AS STRING) || '\")'",
  )} AS content
FROM part
UNION ALL
SELECT DISTINCT 'p' || CAST(p_partkey % 10 AS STRING), CASE p_partkey % 10 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' WHEN 2 THEN 'setup.py'
  WHEN 3 THEN 'Cargo.toml' WHEN 4 THEN 'build.gradle.kts' WHEN 5 THEN 'README.md' ELSE 'package.json' END, 'x'
FROM part
UNION ALL
SELECT DISTINCT 'p' || CAST(p_partkey % 10 AS STRING), '.env.example',
  {_text("'VAR_1=x'", "'GO_2=y'", "'# VAR_4=no'", "'export PY_3=z'", "'EXTRA_' || CAST(p_partkey % 10 AS STRING) || '=1'")}
FROM part
"""

VIEWS["fx_debt"] = f"""
SELECT 'p' || CAST(p_partkey % 10 AS STRING) AS project, 'src/d' || CAST(p_partkey AS STRING) || '.ts' AS path,
  {_text(
    "'const a = 1;'",
    "CASE p_size % 6 WHEN 0 THEN '// TODO clean up ' || p_name WHEN 1 THEN '// FIXME 2020-01-02 ' || p_name WHEN 2 THEN '// TODO(bob): ' || p_name "
    "WHEN 3 THEN '// TODO PROJ-' || CAST(p_partkey AS STRING) WHEN 4 THEN '// FIXME: 2024-05-01 later' ELSE '// TODOs are fine' END",
    "'const TODO_LIST = 2; // FIXME'",
  )} AS content
FROM part
"""

VIEWS["fx_workspace"] = """
SELECT 'proj' || CAST(o_custkey AS STRING) AS project,
  CASE substr(o_orderpriority, 1, 1)
    WHEN '1' THEN 'docs/proj' || CAST(o_custkey AS STRING) || '/2_PRODUCT_SPEC/SPEC.md'
    WHEN '2' THEN 'blueprint/proj' || CAST(o_custkey AS STRING) || '/3_TECH_BLUEPRINT/DATABASE_MODEL.md'
    WHEN '3' THEN 'blueprint/proj' || CAST(o_custkey AS STRING) || '/3_TECH_BLUEPRINT/IMPLEMENTATION_GUIDE.md'
    WHEN '4' THEN 'projects/proj' || CAST(o_custkey AS STRING) || CASE o_orderstatus WHEN 'F' THEN '/backend/src/' ELSE '/frontend/src/' END || 'f' || CAST(o_orderkey AS STRING) || '.ts'
    ELSE 'prototype/src/f' || CAST(o_orderkey AS STRING) || '.ts' END AS path,
  o_orderdate AS modified
FROM orders
"""

VIEWS["fx_decisions"] = f"""
SELECT 'proj' || CAST(p_partkey % 20 AS STRING) AS project, 'DEC-' || CAST(p_partkey AS STRING) || '.md' AS rel_path,
  {_text(
    "'---'", "'id: DEC-' || CAST(p_partkey AS STRING)", "'title: ' || p_name",
    "'status: ' || CASE p_partkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'needs_review' ELSE 'superseded' END",
    "'created_at: 2024-01-' || CAST(10 + p_partkey % 20 AS STRING)", "'---'", "'Body'",
  )} AS content
FROM part
"""

VIEWS["fx_readmes"] = f"""
SELECT 'proj' || CAST(s_suppkey AS STRING) AS project, 'README.md' AS rel_path,
  {_text("'# ' || s_name", "'Start with npm run dev and check with pnpm run test:' || CAST(s_nationkey AS STRING)", "'Then yarn run build.'")} AS content
FROM supplier
"""

VIEWS["fx_names"] = """
SELECT CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type || '/' || p_name ELSE ' ' END AS project FROM part
"""

TABLES = {
    "fx_files": ["documents"],
    "fx_ignore_files": ["documents"],
    "fx_texts": ["documents"],
    "fx_code": ["part"],
    "fx_components": ["part"],
    "fx_components_bare": ["part"],
    "fx_pages": ["pages"],
    "fx_imports": ["part"],
    "fx_aliased": ["part"],
    "fx_modules": ["part"],
    "fx_tree": ["part"],
    "fx_tree_config": ["part"],
    "fx_changes": ["labels"],
    "fx_config": ["supplier"],
    "fx_manifests": ["supplier"],
    "fx_templates": ["nation"],
    "fx_prompts": ["customer", "nation"],
    "fx_project_prompts": ["documents", "nation"],
    "fx_docs": ["supplier"],
    "fx_gate": ["supplier"],
    "fx_artifacts": ["lineitem"],
    "fx_runbooks": ["supplier"],
    "fx_blueprints": ["supplier"],
    "fx_findings": ["orders"],
    "fx_reports": ["orders"],
    "fx_baseline": ["customer"],
    "fx_secrets": ["part"],
    "fx_secret_findings": ["part"],
    "fx_baseline_periods": ["customer"],
    "fx_report_files": ["customer"],
    "fx_sessions": ["orders"],
    "fx_env": ["part"],
    "fx_debt": ["part"],
    "fx_workspace": ["orders"],
    "fx_decisions": ["part"],
    "fx_readmes": ["supplier"],
    "fx_names": ["part"],
}


# Tables of a few rows at every scale.
TINY = ("region", "nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.

    A table that comes as fewer scan partitions than there are cores, such as one small file,
    is spread over the cores, since the work per text row is far larger than moving the row.
    A large table has more partitions than cores and is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name not in TINY and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of ``sf_dir``."""
    for base in TABLES[name]:
        table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(VIEWS[name].format(bytes="octet_length"))


def with_views(sql: str) -> str:
    """``sql`` for DuckDB, preceded by the views it names."""
    used = [name for name in VIEWS if name in sql]
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].format(bytes='strlen')})" for name in used)
    if not used:
        return sql
    head, rest = ("WITH RECURSIVE ", sql[len("WITH RECURSIVE") :]) if sql.startswith("WITH RECURSIVE") else ("WITH ", None)
    if rest is not None:
        return f"{head}{ctes}, {rest}"
    if sql.startswith("WITH "):
        return f"WITH {ctes}, {sql[5:]}"
    return f"WITH {ctes}\n{sql}"
