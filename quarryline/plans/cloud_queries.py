"""Registered queries of cloud costs, trees of rich text, phased plans, files and documents of services."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files as fl
from ..operators import cloud as cl
from ..operators import ingest as ig
from ..operators import planning as pl
from .bindings import LINES, VIEWS, with_views
from .queries import job

_S = lambda e: f"CAST({e} AS VARCHAR(20))"
VIEWS["cloud_items"] = f"""SELECT l_orderkey AS request_id, l_linenumber AS ordinal, CAST(l_partkey % 90 AS BIGINT) AS unit_id,
 CASE CAST(l_partkey % 9 AS INT) WHEN 0 THEN 'pages behind a CDN' WHEN 1 THEN 'writes to the Service' WHEN 2 THEN 'Bus topics' WHEN 3 THEN 'keeps sessions in Redis' WHEN 4 THEN 'documents in cosmos' WHEN 5 THEN NULL WHEN 6 THEN '' WHEN 7 THEN 'an azure function app' ELSE concat('part ', {_S("l_partkey")}) END AS reason FROM {LINES} l"""
VIEWS["cloud_units"] = "SELECT p_partkey AS unit_id, CASE CAST(p_size % 5 AS INT) WHEN 0 THEN 'frontend' WHEN 1 THEN 'backendCrud' WHEN 2 THEN 'integration' WHEN 3 THEN 'qa' ELSE 'backendLogic' END AS category FROM part WHERE p_partkey < 81"
VIEWS["cloud_systems"] = f"SELECT l_orderkey AS request_id, l_linenumber AS ordinal, concat('S', {_S('l_suppkey % 24')}) AS system FROM {LINES} l"
VIEWS["cloud_models"] = f"SELECT DISTINCT concat('S', {_S('s_suppkey % 24')}) AS system, CASE CAST(s_suppkey % 24 % 6 AS INT) WHEN 0 THEN 'IB Countrywise' WHEN 1 THEN 'ib by region' WHEN 2 THEN 'Multi-region' WHEN 3 THEN 'single' ELSE NULL END AS deployment_model FROM supplier WHERE s_suppkey % 24 > 3"
_RULES = [
    ("category", "frontend", "app_service", 1, "hosting"), ("category", "frontend", "cdn", 1, "static files"), ("category", "backendCrud", "app_service", 2, "interface"), ("category", "backendCrud", "sql_small", 1, "database"),
    ("category", "backendLogic", "sql_large", 1, "database of rules"), ("category", "backendLogic", "cache", 1, "caching"), ("category", "integration", "bus", 1, "broker"), ("category", "integration", "function", 1, "adapter"),
    ("system", "S4", "bus", 3, "many messages"), ("system", "S5", "cache", 1, "sessions"), ("system", "S5", "app_service", 2, "web tier"), ("system", "S9", "hub", 1, "devices"), ("system", "S22", "vault", 2, "keys"),
    ("baseline", "", "insights", 1, "watching"), ("baseline", "", "vault", 1, "secrets"), ("baseline", "", "free_net", 1, "network"),
    ("keyword", "service bus", "bus", 1, "bus is named"), ("keyword", "cosmos", "document_store", 1, "cosmos is named"), ("keyword", "redis", "cache", 1, "redis is named"), ("keyword", "cdn", "cdn", 1, "cdn is named"), ("keyword", "function app", "function", 1, "function app is named"), ("keyword", "azure function", "function", 1, "azure function is named"),
]
VIEWS["cloud_rules"] = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{key}' AS key, {i} AS ordinal, '{r}' AS resource, {n} AS quantity, '{why}' AS reason" for i, (k, key, r, n, why) in enumerate(_RULES))
VIEWS["cloud_prices"] = "SELECT CASE CAST(n_nationkey AS INT) WHEN 0 THEN 'app_service' WHEN 1 THEN 'cdn' WHEN 2 THEN 'sql_small' WHEN 3 THEN 'sql_large' WHEN 4 THEN 'cache' WHEN 5 THEN 'bus' WHEN 6 THEN 'function' WHEN 7 THEN 'hub' WHEN 8 THEN 'vault' WHEN 9 THEN 'insights' ELSE 'document_store' END AS resource, 500 + 1250 * CAST(n_nationkey AS INT) AS price FROM nation WHERE n_nationkey < 11"
_VIEWS = ("cloud_items", "cloud_units", "cloud_systems", "cloud_models", "cloud_rules", "cloud_prices")

_LINES = """, said AS (SELECT request_id, lower(string_agg(reason, ' ' ORDER BY ordinal)) AS text FROM cloud_items GROUP BY request_id),
 seen AS (SELECT request_id, coalesce(category, 'backendLogic') AS key, min(ordinal) AS seen FROM cloud_items LEFT JOIN cloud_units USING (unit_id) GROUP BY ALL), systems AS (SELECT request_id, system AS key, min(ordinal) AS seen FROM cloud_systems GROUP BY ALL),
 called AS (SELECT request_id, 1 AS step, seen, ordinal, resource, quantity, reason FROM seen JOIN cloud_rules USING (key) WHERE kind = 'category'
  UNION ALL SELECT request_id, 2, seen, ordinal, resource, quantity, concat(key, ': ', reason) FROM systems JOIN cloud_rules USING (key) WHERE kind = 'system'
  UNION ALL SELECT request_id, 3, 0, ordinal, resource, quantity, reason FROM (SELECT request_id FROM cloud_items UNION SELECT request_id FROM cloud_systems), cloud_rules WHERE kind = 'baseline'
  UNION ALL SELECT request_id, 4, 0, ordinal, resource, quantity, reason FROM said JOIN cloud_rules ON kind = 'keyword' AND contains(text, key)),
 firsts AS (SELECT request_id, resource, reason, min((step, seen, ordinal)) AS f FROM called GROUP BY ALL), whys AS (SELECT request_id, resource, min(f) AS f, array_to_string((list(reason ORDER BY f))[1:2], '; ') AS reason FROM firsts GROUP BY ALL),
 factors AS (SELECT request_id, max(CASE WHEN contains(m, 'ib') AND contains(m, 'country') THEN 3.0::DOUBLE WHEN (contains(m, 'ib') AND contains(m, 'region')) OR contains(m, 'multi') THEN 2.0 ELSE 1.0 END) AS multiplier FROM (SELECT s.request_id, lower(coalesce(deployment_model, '')) AS m FROM cloud_systems s LEFT JOIN cloud_models USING (system)) GROUP BY request_id),
 lines AS (SELECT request_id, resource, max(quantity)::BIGINT AS quantity, any_value(coalesce(price, 0))::DOUBLE AS unit_cost, any_value(w.reason) AS reason, any_value(f) AS f, any_value(multiplier) AS multiplier FROM called c JOIN whys w USING (request_id, resource) LEFT JOIN cloud_prices USING (resource) JOIN factors USING (request_id) GROUP BY request_id, resource)
"""


def _called(items, units, systems, models, rules, prices):
    many = cl.request_multiplier(systems, models)
    return cl.cloud_lines(cl.called_for(items, units, systems, rules), many, prices), many


@job(
    with_views(*_VIEWS) + _LINES + "SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY unit_cost * quantity DESC, f) AS line, resource, quantity, unit_cost, unit_cost * quantity * multiplier AS cost, reason FROM lines",
    _VIEWS,
)
def cloud_lines(*views):
    return _called(*views)[0].withColumn("line", F.col("line").cast("long"))


@job(
    with_views(*_VIEWS) + _LINES + "SELECT request_id, resources, round_even(t, 0)::BIGINT AS monthly_total, round_even(t * 0.6, 0)::BIGINT AS non_production, round_even(t + round_even(t * 0.6, 0), 0)::BIGINT AS with_non_production, multiplier FROM (SELECT request_id, count(*) AS resources, sum(unit_cost * quantity * multiplier) AS t, any_value(multiplier) AS multiplier FROM lines GROUP BY request_id)",
    _VIEWS,
)
def cloud_totals(*views):
    return cl.cloud_totals(*_called(*views))


VIEWS["adf"] = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 1 THEN o_orderpriority WHEN o_orderkey % 13 = 2 THEN NULL WHEN o_orderkey % 13 = 3 THEN concat('{"type": "doc", "content": ', o_orderkey, '}') WHEN o_orderkey % 13 = 4 THEN concat('{"text": ', o_orderkey, ', "content": [{"text": "', o_orderpriority, '"}]}')
 ELSE concat('{"type": "doc", "version": 1, "attrs": {"text": "hidden"}, "content": [', CASE WHEN o_orderkey % 2 = 0 THEN '{"type": "heading", "content": [{"type": "text", "text": "Order \\\\"X\\\\""}]}, ' ELSE '' END,
  '{"type": "paragraph", "content": [{"type": "text", "text": "', o_orderpriority, '", "marks": [{"type": "link", "attrs": {"text": "no"}}]}, {"type": "mention", "attrs": {"id": "7", "text": "@someone"}}, {"type": "text", "text": "of ', o_orderstatus, '"}]}, ',
  CASE WHEN o_orderkey % 3 = 0 THEN concat('{"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "', o_custkey, '"}]}, {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "deep"}]}]}]}]}]}, ') ELSE '' END,
  '{"type": "rule"}, {"type": "media", "content": [{"type": "file", "attrs": {"text": "no"}}]}]}') END AS tree FROM orders"""
VIEWS["adf"] = VIEWS["adf"].replace("o_orderkey, '", "CAST(o_orderkey AS VARCHAR(20)), '").replace("', o_custkey, '", "', CAST(o_custkey AS VARCHAR(20)), '").replace('\\\\"', "''")


@job(
    with_views("adf") + """SELECT id, CASE WHEN tree IS NULL THEN '' WHEN NOT json_valid(tree) THEN tree WHEN json_type(tree, '$.content') != 'ARRAY' THEN '' ELSE array_to_string(list_filter([x->>'$' FOR x IN list_concat(json_extract(tree, '$.content[*].text'), json_extract(tree, '$.content[0].content[*].text'), json_extract(tree, '$.content[1].content[*].text'), json_extract(tree, '$.content[*].content[*].content[*].content[*].text'), json_extract(tree, '$.content[*].content[*].content[*].content[*].content[*].content[*].text'))], lambda x: x IS NOT NULL), ' ') END AS text FROM adf""",
    ("adf",),
)
def rich_text_trees(trees):
    return trees.select("id", F.regexp_replace(ig.rich_text(F.col("tree")), " +", " ").alias("text"))


_NL = "chr(10)"
VIEWS["plans"] = f"""SELECT p_partkey AS doc_id, CASE CAST(p_partkey % 8 AS INT)
 WHEN 0 THEN concat('## Phase 1: ', trim(p_type), {_NL}, '- ', trim(p_brand), {_NL}, 'x', {_NL}, '### Release - 2', {_NL}, 'UC#', {_S("p_size")}, ' and uc ', {_S("p_size + 1")}, {_NL}, '- not shown')
 WHEN 1 THEN concat('| UC# | Feature | Phase |', {_NL}, '|---|---|:---:|', {_NL}, '| ', {_S("p_size")}, ' | ', trim(p_brand), ' | Phase - 2 |', {_NL}, '| 7 | other | phase -1 |', {_NL}, '| 8 | none | later |', {_NL}, '| 9 | more | Release 2 |')
 WHEN 2 THEN concat('Name   Owner   Delivery Phase', {_NL}, trim(p_brand), '   me   Phase 1', {_NL}, trim(p_type), '   you   Phase 3')
 WHEN 3 THEN concat('UC ', {_S("p_size")}, ' of ', trim(p_type), ' Phase -1', {_NL}, trim(p_brand), ' Phase 2', {_NL}, 'Phase x', {_NL}, 'last one Release - 2 ')
 WHEN 4 THEN concat('Do UC#', {_S("p_size")}, ' [Phase 2] and Search_', {_S("p_size")}, ' now [Sprint 1-3], not this [Phase x]', {_NL}, '(', trim(p_type), ') [Release 2]; Pay [ release - 4 ]')
 WHEN 5 THEN concat('# Milestone 1 - ', trim(p_brand), {_NL}, '1. ', trim(p_type), {_NL}, '2) ok', {_NL}, 'Milestone 2: Rest', {_NL}, '* item ', {_S("p_size")}, {_NL}, 'Milestone 3')
 WHEN 6 THEN concat('Phase 1', {_NL}, 'Phase 2 - ', trim(p_brand), {_NL}, 'A [Phase 1] B [Phase 2] C [Phase 3]') ELSE concat('Phase 1', {_NL}, '- ', trim(p_type), {_NL}, 'Phase 2 is told elsewhere') END AS text FROM part"""


@job(
    """SELECT p_partkey AS doc_id, layout, warning, ordinal, name, use_cases FROM (SELECT *, trim(p_brand) AS b, trim(p_type) AS t FROM part), LATERAL (VALUES
 (0, 'heading', NULL, 1, concat('Phase 1: ', t), b), (0, 'heading', NULL, 2, 'Phase 2', concat('UC#', p_size, '|UC#', p_size + 1)), (1, 'table', NULL, 1, 'Phase 1', '7'), (1, 'table', NULL, 2, 'Phase 2', concat(p_size, '|9')),
 (2, 'table', NULL, 1, 'Phase 1', b), (2, 'table', NULL, 2, 'Phase 3', t), (3, 'line end', NULL, 1, 'Phase 1', concat('UC#', p_size)), (3, 'line end', NULL, 2, 'Phase 2', concat(b, '|last one')),
 (4, 'mark', NULL, 1, 'Phase 1', concat('and Search_', p_size, ' now')), (4, 'mark', NULL, 2, 'Phase 2', concat('UC#', p_size)), (4, 'mark', NULL, 3, 'Phase 4', 'Pay'),
 (5, 'milestone', NULL, 1, concat('Milestone 1 - ', b), t), (5, 'milestone', NULL, 2, 'Milestone 2 - Rest', concat('item ', p_size)), (6, NULL, 'layouts disagree on the number of phases', 0, NULL, NULL)) v(kind, layout, warning, ordinal, name, use_cases) WHERE kind = p_partkey % 8""",
    ("plans",),
)
def phase_plan(docs):
    return pl.phase_plan(docs).withColumn("use_cases", F.array_join("use_cases", "|"))


_DIRS = ["", "src/", "src/test/java/", "web/node_modules/x/", "packages/Json.13.0.3/lib/", "packages/app/", "api/bin/Release/", "bin/", "obj/", "wwwroot/lib/jq/", "wwwroot/css/", "Public/img/", "deploy/", "helm/app/", ".github/workflows/", "Shop.Tests/", "e2e/", "docs/", "Config/", "a/Migrations/", "charts/", "third_party/", "conf/", "deep/er/than/that/"]
_NAMES = ["{w}.py", "{w}Thing.TSX", "{w}.png", "{w}.test.js", "{w}.yml", "{w}.xyz", "{w}", "Dockerfile.{w}", "yarn.lock", "{w}.min.js", "{w}.js.map", "{w}.svg", "openapi-{w}.json", "{w}.proto", "main-{w}.tf", "{w}.csproj", "requirements-{w}.txt", "{w}Tests.cs", "test_{w}.py", "README", "{w}.md", ".env.{w}", ".gitignore", "appsettings.{w}.json", "{w}.Designer.cs", "values-{w}.yaml", "{w}.tpl", "{w}.tar.gz", "Makefile", "environment.{w}.ts", "{w}.XML", ".{w}", "{w}.sql", "{w}.webmanifest", "package.json", "{w}.bundle.js", "go.sum", "{w}.config", "{w}.h", "Jenkinsfile"]


def _choice(at: str, values: list[str]) -> str:
    return f"CASE CAST({at} AS INT) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


VIEWS["repo_files"] = f"""SELECT id, concat(dir, replace(name, '{{w}}', word)) AS path, size, mode, head FROM (SELECT CAST(p_partkey AS BIGINT) AS id, {_choice(f"p_partkey % {len(_DIRS)}", _DIRS)} AS dir, {_choice(f"floor(p_partkey / {len(_DIRS)}) % {len(_NAMES)}", _NAMES)} AS name, replace(trim(p_name), ' ', '_') AS word,
 CAST(p_size * 25000 AS BIGINT) AS size, CASE WHEN p_partkey % 31 = 0 THEN '120000' WHEN p_partkey % 37 = 0 THEN '160000' WHEN p_partkey % 5 = 0 THEN NULL ELSE '100644' END AS mode, CASE WHEN p_partkey % 29 = 1 THEN concat('x', chr(0)) WHEN p_partkey % 4 = 1 THEN concat('apiVersion: v1', chr(10), 'kind: Pod') WHEN p_partkey % 4 = 2 THEN 'kind: x' WHEN p_partkey % 4 = 3 THEN NULL ELSE 'text' END AS head FROM part) f"""
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_GLOB = lambda names: f"len(list_filter({_LIST(names)}, lambda g: name GLOB g)) > 0"
_HAS = lambda values, names: f"list_has_any({values}, {_LIST(names)})"
_CODE = f"list_contains({_LIST(fl.CODE_EXTENSIONS)}, ext)"


@job(
    with_views("repo_files") + f""", parts AS (SELECT *, string_split(path, '/')[-1] AS name, string_split(path, '/')[:-2] AS dirs, coalesce(mode, '') AS m, coalesce(head, '') AS h FROM repo_files),
 ends AS (SELECT *, [lower(d) FOR d IN dirs] AS low, CASE WHEN contains(ltrim(name, '.'), '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS ext FROM parts),
 classes AS (SELECT *, CASE WHEN m = '160000' THEN 'submodule' WHEN m = '120000' THEN 'symlink' WHEN {_HAS("dirs", fl.VENDOR_DIRS)} OR contains(path, 'packages/Json.13.0.3/') OR contains(path, 'wwwroot/lib/') THEN 'vendor' WHEN {_HAS("dirs", fl.GENERATED_DIRS)} OR {_GLOB(fl.GENERATED_NAMES)} OR contains(path, 'bin/Release/') THEN 'generated'
  WHEN list_contains({_LIST(fl.LOCKFILES)}, name) THEN 'lockfile' WHEN {_GLOB(fl.MINIFIED_NAMES)} THEN 'minified' WHEN list_contains({_LIST(fl.BINARY_EXTENSIONS)}, ext) OR contains(h, chr(0)) THEN 'binary' WHEN ext = 'svg' OR ({_HAS("low", fl.ASSET_DIRS)} AND NOT {_CODE} AND NOT list_contains({_LIST(fl.SETTING_EXTENSIONS)}, ext) AND name[1] != '.') THEN 'asset' WHEN size > 1000000 THEN 'large' WHEN {_GLOB(fl.CONTRACT_NAMES)} THEN 'api_contract'
  WHEN {_GLOB(fl.INFRA_NAMES)} OR starts_with(path, '.github/workflows/') OR (ext IN ('yml', 'yaml') AND ({_HAS("low", fl.INFRA_DIRS)} OR (contains(h, 'apiVersion:') AND contains(h, 'kind:')))) OR ({_HAS("low", ["helm", "charts", "terraform"])} AND ext IN ('tpl', 'tf', 'json', 'yaml')) THEN 'infra'
  WHEN {_GLOB(fl.MANIFEST_NAMES)} THEN 'build_manifest' WHEN {_HAS("dirs", fl.TEST_DIRS)} OR contains(path, 'src/test/') OR contains(path, 'Tests/') OR {_GLOB(fl.TEST_NAMES)} THEN 'test' WHEN list_contains({_LIST(fl.DOC_EXTENSIONS)}, ext) OR {_GLOB(fl.DOC_NAMES)} THEN 'docs' WHEN {_GLOB(fl.CONFIG_NAMES)} OR ({_HAS("low", fl.CONFIG_DIRS)} AND NOT {_CODE}) THEN 'config' WHEN {_CODE} THEN 'source' ELSE 'other' END AS class FROM ends),
 tongues AS (SELECT unnest({_LIST([e for t in fl.LANGUAGES.values() for e in t.split()])}) AS ext, unnest({_LIST([n for n, t in fl.LANGUAGES.items() for _ in t.split()])}) AS tongue)
 SELECT id, class, CASE WHEN m = '160000' THEN 'unknown' WHEN name = 'Makefile' THEN 'make' WHEN name = 'Jenkinsfile' THEN 'groovy' WHEN name GLOB 'Dockerfile*' THEN 'dockerfile' WHEN name GLOB '.env*' THEN 'dotenv' ELSE coalesce(tongue, 'unknown') END AS language,
  CASE WHEN class IN ('vendor', 'generated', 'binary', 'lockfile', 'minified', 'asset', 'large', 'symlink', 'submodule') THEN 'skipped:' || class ELSE 'pending' END AS status FROM classes LEFT JOIN tongues USING (ext)""",
    ("repo_files",),
)
def classify_file(files):
    return files.select("id", fl.classify_file(F.col("path"), F.col("size"), F.col("mode"), F.col("head").cast("binary")).alias("c")).select("id", "c.*")


_ROWS = lambda name, kind: f"concat('### {name}', {_NL}, '| Field | Type |', {_NL}, '|---|---|', {_NL}, '| id | {kind} |')"
_BODY = lambda name, kind: f"concat('#### Schema {name}', {_NL}, '| Field | Type |', {_NL}, '|---|---|', {_NL}, '| id | {kind} |')"
VIEWS["service_texts"] = f"""SELECT doc_id, service, brand, get, post, overview, concat('---', {_NL}, 'service_id: ', service, {_NL}, 'aliases: [', brand, ', "second one"]', {_NL}, 'doc_type: API_SPEC', {_NL}, CASE WHEN doc_id % 2 = 0 THEN concat('domain: sales', {_NL}) ELSE '' END, '---', {_NL}, '# Title', {_NL}, {_NL}, '## Overview', {_NL}, overview, {_NL}, {_NL}, '## Endpoints', {_NL}, get, {_NL}, {_NL}, post, {_NL}, {_NL},
 '## Schemas', {_NL}, {_ROWS("Order", "Item[]")}, {_NL}, {_NL}, {_ROWS("Item", "Price or string")}, {_NL}, {_NL}, {_ROWS("Price", "Order")}, {_NL}, {_NL}, {_ROWS("Unused", "Other")}, {_NL}) AS text FROM (SELECT p_partkey AS doc_id, concat('svc-', {_S("p_size")}) AS service, trim(p_brand) AS brand, concat('About ', trim(p_name), {_NL}, '```', {_NL}, '## no heading', {_NL}, '```') AS overview,
 concat('### GET /', {_S("p_partkey")}, {_NL}, CASE WHEN p_partkey % 3 = 0 THEN 'Response `200`: `Order`' WHEN p_partkey % 3 = 1 THEN concat('Response `200`: `Item`', {_NL}, '| Field | Type |', {_NL}, '| id | Price |') ELSE 'Response `204`: `None`' END) AS get, concat('### POST /', trim(p_type), {_NL}, 'Request body: `Price`') AS post FROM part) p"""


@job(
    with_views("service_texts") + f""", schemas AS (SELECT {_BODY("Order", "Item[]")} AS o, {_BODY("Item", "Price or string")} AS i, {_BODY("Price", "Order")} AS p), gap AS (SELECT concat({_NL}, {_NL}) AS g),
 rows AS (SELECT doc_id, 0 AS chunk_index, 'Overview' AS section_title, service, brand, concat('## Overview', {_NL}, overview) AS part FROM service_texts
  UNION ALL SELECT doc_id, 1, 'Endpoints', service, brand, '## Endpoints' FROM service_texts
  UNION ALL SELECT doc_id, 2, concat('Endpoints › ', substr(string_split(get, {_NL})[1], 5)), service, brand, concat(get, CASE doc_id % 3 WHEN 0 THEN concat(g, o, g, i, g, p) WHEN 1 THEN concat(g, p, g, o) ELSE '' END) FROM service_texts, schemas, gap
  UNION ALL SELECT doc_id, 3, concat('Endpoints › ', substr(string_split(post, {_NL})[1], 5)), service, brand, concat(post, g, p, g, o, g, i) FROM service_texts, schemas, gap
  UNION ALL SELECT doc_id, 4, 'Schemas', service, brand, concat('## Schemas', {_NL}, replace(concat(o, g, i, g, p, g, {_BODY("Unused", "Other")}), '#### Schema', '###')) FROM service_texts, schemas, gap)
 SELECT doc_id, chunk_index, section_title, concat('[', service, ' | aka ', brand, ', second one | ', CASE WHEN doc_id % 2 = 0 THEN 'sales' ELSE 'unknown' END, '] API_SPEC › ', section_title, {_NL}, {_NL}, part) AS display_text FROM rows""",
    ("service_texts",),
)
def service_doc_chunks(docs):
    return ig.service_doc_chunks(docs, least=0).select("doc_id", "chunk_index", "section_title", "display_text")
