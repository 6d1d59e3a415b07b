"""Queries over the document tree, page links and conversation texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archtrail.functions import paths, text
from archtrail.operators import audit, cycles, edges, hierarchy, impact
from archtrail.plans import tables as t
from archtrail.plans.registry import query
from archtrail.plans.trade_queries import CLOSURE
from archtrail.sources import events

WITH = f"WITH {t.DOCS_SQL}"
RECURSIVE = f"WITH RECURSIVE {t.DOCS_SQL}, {t.POINTERS_SQL}, ids AS (SELECT 'doc:' || doc_id AS id FROM docs)"


# ----------------------------------------------------------------- text and paths
@query("loc_by_document", f"{WITH} SELECT doc_id, loc FROM docs")
def loc_by_document(spark, sf_dir):
    return t.document_files(spark, sf_dir).select("doc_id", "loc")


@query("role_of_path", f"{WITH} SELECT path, role FROM docs")
def role_of_path(spark, sf_dir):
    return t.document_files(spark, sf_dir).select("path", "role")


PAGE_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def page_path():
    return F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")


@query(
    "classify_suffix",
    rf"""SELECT page_id, CASE lower(regexp_extract(parse, '.(\.[^./]+)$', 1))
      WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript'
      WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' END AS language
    FROM (SELECT page_id, regexp_replace({PAGE_PATH}, '\.html$', '.ts') AS parse FROM pages)""",
)
def classify_suffix(spark, sf_dir):
    renamed = F.regexp_replace(page_path(), r"\.html$", ".ts")
    return t.table(spark, sf_dir, "pages").select("page_id", paths.language(renamed).alias("language"))


@query(
    "anchors",
    f"""{WITH} SELECT path, array_to_string(string_split(path, '/')[1:2], '/') AS module_anchor,
      split_part(path, '/', 1) AS component_anchor FROM docs""",
)
def anchors(spark, sf_dir):
    files = t.document_files(spark, sf_dir)
    return files.select(
        "path",
        paths.module_anchor(F.col("path")).alias("module_anchor"),
        paths.component_anchor(F.col("path")).alias("component_anchor"),
    )


@query(
    "common_directory",
    f"""{WITH}, parts AS (SELECT source, string_split(path, '/')[1:-2] AS dirs FROM docs),
    ends AS (SELECT source, min(dirs) AS low, max(dirs) AS high FROM parts GROUP BY source)
    SELECT source, array_to_string(low[1:(SELECT max(i) FROM range(0, 6) r(i)
      WHERE i <= least(len(low), len(high)) AND low[1:i] = high[1:i])], '/') AS directory FROM ends""",
)
def common_directory(spark, sf_dir):
    files = t.document_files(spark, sf_dir).withColumn("source", F.substring_index("path", "/", 1))
    return files.groupBy("source").agg(paths.common_directory(F.col("path")).alias("directory"))


@query(
    "slug_id",
    rf"""SELECT page_id, 'mod:' || coalesce(nullif(left(regexp_replace(regexp_replace(lower(url),
        '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), ''), 'mod')
      || '-' || left(sha256(url), 10) AS id FROM pages""",
)
def slug_id(spark, sf_dir):
    url = F.col("url")
    return t.table(spark, sf_dir, "pages").select("page_id", text.stable_id("mod", url, url).alias("id"))


@query(
    "title_labels",
    r"""WITH words AS (SELECT p_partkey, regexp_extract_all(p_name || '_' || p_type || '7b', '[A-Za-z0-9]+') AS found
      FROM part),
    parts AS (SELECT p_partkey, unnest(found) AS word, generate_subscripts(found, 1) AS place FROM words),
    runs AS (SELECT *, list_transform(regexp_extract_all(word, '[A-Za-z]+|[0-9]+'),
        lambda x: upper(x[1:1]) || lower(x[2:])) AS capital FROM parts)
    SELECT p_partkey, string_agg(CASE WHEN length(word) <= 2 THEN upper(word)
      ELSE array_to_string(capital, '') END, ' ' ORDER BY place) AS label FROM runs GROUP BY p_partkey""",
)
def title_labels(spark, sf_dir):
    raw = F.concat("p_name", F.lit("_"), "p_type", F.lit("7b"))
    return t.table(spark, sf_dir, "part").select("p_partkey", text.title_label(raw).alias("label"))


@query(
    "redact_text",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '(?i)(authorization\s*:\s*\S+\s+)\S+', '\1[REDACTED]', 'g'),
        '(?i)\b([A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD)[A-Z0-9_]*\s*=\s*)("[^"]*"|''[^'']*''|\S+)',
        '\1[REDACTED]', 'g'),
        '(?i)(--?(?:password|passwd|token|api-?key|secret)(?:[=\s]))("[^"]*"|''[^'']*''|\S+)',
        '\1[REDACTED]', 'g'),
        '://([^/\s:@]+):([^@/\s]+)@', '://\1:[REDACTED]@', 'g') AS clean FROM documents""",
)
def redact_text(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("clean"))


# Commands are put together from the part names: "small ring" → "cd small; pytest ring".
COMMAND_SQL = r"""commands AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'cd ' || p_name || '; pytest -q'
    WHEN 'SMALL' THEN 'npm run test ' || p_name WHEN 'STANDARD' THEN 'echo pytester ' || p_name
    ELSE 'make ' || p_name END AS command FROM part)"""


@query(
    "classify_command",
    rf"""WITH {COMMAND_SQL} SELECT p_partkey, CASE WHEN regexp_matches(command, '(?i)(^|[;&|]\s*|\s)'
      '(pytest|vitest|jest|mocha|tox|nox|cargo\s+test|go\s+test|npm\s+(run\s+)?test|pnpm\s+(run\s+)?test|yarn\s+test|make\s+test)'
      '(\s|$)') THEN 'Test' ELSE 'Bash' END AS tool FROM commands""".replace("'\n      '", ""),
)
def classify_command(spark, sf_dir):
    parts = t.table(spark, sf_dir, "part")
    return parts.select("p_partkey", text.classify_tool(F.lit("Bash"), _command()).alias("tool"))


def _command():
    kind, name = F.col("p_type"), F.col("p_name")
    return (
        F.when(kind == "ECONOMY", F.concat(F.lit("cd "), name, F.lit("; pytest -q")))
        .when(kind == "SMALL", F.concat(F.lit("npm run test "), name))
        .when(kind == "STANDARD", F.concat(F.lit("echo pytester "), name))
        .otherwise(F.concat(F.lit("make "), name))
    )


@query(
    "capture_records",
    rf"""WITH {COMMAND_SQL} SELECT p_partkey AS sequence, CASE WHEN p_type = 'LARGE' THEN 'Read' WHEN
        p_type IN ('ECONOMY', 'SMALL') THEN 'Test' ELSE 'Bash' END AS tool,
      CASE WHEN p_type = 'LARGE' THEN p_name ELSE '' END AS path,
      CASE WHEN p_type = 'LARGE' THEN '{{}}' ELSE '{{"command":"' || command || ' --token [REDACTED]"}}' END AS detail
    FROM commands JOIN part USING (p_partkey) WHERE p_type <> 'PROMO'""",
)
def capture_records(spark, sf_dir):
    """Hook payloads made of parts: large ones are read, promoted ones use a tool
    that is not recorded, all others run a command with a secret in it."""
    kind, name = F.col("p_type"), F.col("p_name")
    payloads = t.table(spark, sf_dir, "part").select(
        F.lit("s").alias("session_id"),
        F.when(kind == "LARGE", "Read").when(kind == "PROMO", "Other").otherwise("Bash").alias("tool_name"),
        F.concat(_command(), F.lit(" --token "), F.sha2("p_name", 256)).alias("command"),
        name.alias("file_path"), F.lit("").alias("search_path"), F.lit("").alias("tool_use_id"),
        F.lit("PreToolUse").alias("hook_event"), F.lit(0.0).alias("timestamp"),
        F.col("p_partkey").alias("sequence"),
    )
    return events.capture(payloads).select("sequence", "tool", "path", "detail")


@query(
    "href_facts",
    r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""",
)
def href_facts(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return t.table(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("target"))


@query(
    "normalized_links",
    r"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS word FROM pages)
    SELECT page_id, word, word AS inside, '../' || word AS outside FROM l WHERE word NOT IN ('.', '..')""",
)
def normalized_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="/([^"/]+)"'), F.lit(1))
    words = t.table(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("word")).distinct()
    down = F.concat(F.lit("a/./b/../../"), "word")
    up = F.concat(F.lit("a/../../"), "word")
    return words.where(~F.col("word").isin(".", "..")).select(
        "page_id", "word", paths.normalize(down).alias("inside"), paths.normalize(up).alias("outside")
    )


@query(
    "source_urls",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
    SELECT page_id, 'vscode://file//repo/' || path || ':' || page_id AS link FROM p WHERE page_id > 0
    UNION ALL SELECT page_id, 'vscode://file//repo/' || path FROM p WHERE page_id = 0""",
)
def source_urls(spark, sf_dir):
    pages = t.table(spark, sf_dir, "pages")
    link = text.source_url(F.lit("/repo/"), page_path(), F.col("page_id"))
    return pages.select("page_id", link.alias("link"))


# --------------------------------------------------------------------- hierarchy
@query(
    "non_source_buckets",
    f"""{WITH} SELECT 'nonsource:' || source AS id, source || ' · non-source' AS label,
      count(*) || ' non-source ' || CASE WHEN count(*) = 1 THEN 'file' ELSE 'files' END || ' ('
        || string_agg(DISTINCT role, ', ' ORDER BY role) || ').' AS summary,
      count(*) AS members, CAST(sum(loc) AS BIGINT) AS loc
    FROM docs WHERE role <> 'source' GROUP BY source""",
)
def non_source_buckets(spark, sf_dir):
    return hierarchy.non_source_buckets(t.document_files(spark, sf_dir))


@query(
    "non_source_members",
    f"{WITH} SELECT 'doc:' || doc_id AS child, 'nonsource:' || source AS parent FROM docs WHERE role <> 'source'",
)
def non_source_members(spark, sf_dir):
    return hierarchy.non_source_members(t.document_files(spark, sf_dir))


# ------------------------------------------------------------------------- audit
AUDIT = f"""{WITH}, modules AS (SELECT source || '/' || lang AS id, CAST(sum(loc) AS BIGINT) AS loc,
    count(*) AS source_files FROM docs WHERE role = 'source' GROUP BY source, lang)"""


@query(
    "audit_large_file",
    f"""{WITH} SELECT 'large-file:doc:' || doc_id AS id, 'large-file' AS code, 'warning' AS severity,
      'doc_' || doc_id || '.txt has ' || format('{{:,}}', loc)
        || ' LOC; inspect it for multiple responsibilities.' AS message,
      'doc:' || doc_id AS node_ids, 'loc=' || loc || '|warning threshold=800' AS evidence
    FROM docs WHERE role = 'source' AND loc >= 800""",
)
def audit_large_file(spark, sf_dir):
    return _flat(audit.large_files(t.document_nodes(spark, sf_dir)))


def _flat(findings: DataFrame) -> DataFrame:
    return findings.withColumn("node_ids", F.array_join("node_ids", "|")).withColumn(
        "evidence", F.array_join("evidence", "|")
    )


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.module_sizes(t.document_nodes(spark, sf_dir), t.document_membership(spark, sf_dir))


@query(
    "audit_large_module",
    f"""{AUDIT} SELECT 'large-module:' || id AS id, 'large-module' AS code, 'warning' AS severity,
      id || ' contains ' || source_files || ' source files and ' || format('{{:,}}', loc)
        || ' LOC; inspect this boundary for hidden submodules.' AS message, id AS node_ids,
      'source files=' || source_files || '|loc=' || loc || '|warning thresholds=15 files or 2500 LOC' AS evidence
    FROM modules WHERE source_files >= 15 OR loc >= 2500""",
)
def audit_large_module(spark, sf_dir):
    return _flat(audit.large_modules(_sizes(spark, sf_dir)))


@query(
    "audit_thin_module",
    f"""{AUDIT} SELECT 'thin-module:' || id AS id, 'thin-module' AS code, 'notice' AS severity,
      id || ' is a ' || loc || '-LOC singleton module; it may be architectural noise.' AS message,
      id AS node_ids, 'source files=1|loc=' || loc || '|notice threshold=25 LOC' AS evidence
    FROM modules WHERE source_files = 1 AND loc <= 25""",
)
def audit_thin_module(spark, sf_dir):
    return _flat(audit.thin_modules(_sizes(spark, sf_dir)))


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document references moved up to modules, with the number of references."""
    sites = t.document_edges(spark, sf_dir).select(
        "source", "target", F.col("source").alias("file"), F.col("target").alias("line"),
        F.array().cast("array<string>").alias("symbols"),
    )
    return edges.edge_weights(edges.roll_sites(sites, t.document_membership(spark, sf_dir)))


MODULE_CYCLES = f"""{RECURSIVE}, homes AS (SELECT 'doc:' || doc_id AS doc, source || '/' || lang AS module
    FROM docs WHERE role = 'source'),
  module_edges AS (SELECT a.module AS source, b.module AS target, count(*) AS weight
    FROM links JOIN homes a ON a.doc = links.source JOIN homes b ON b.doc = links.target
    WHERE a.module <> b.module GROUP BY a.module, b.module),
  module_ids AS (SELECT DISTINCT module AS id FROM homes),
  {CLOSURE.format(edges='module_edges', nodes='module_ids')},
  regions AS (SELECT component, list_sort(list(node)) AS members FROM comps GROUP BY component
    HAVING count(*) > 1),
  proof AS (SELECT c.component, string_agg(e.source || ' -> ' || e.target || ': ' || e.weight
      || ' imports site(s)', '|' ORDER BY e.source, e.target) AS evidence
    FROM module_edges e JOIN comps c ON c.node = e.source JOIN comps d ON d.node = e.target
      AND d.component = c.component GROUP BY c.component)"""


@query(
    "audit_module_cycle",
    f"""{MODULE_CYCLES} SELECT 'module-cycle:' || members[1] AS id, 'module-cycle' AS code,
      'warning' AS severity, array_to_string(members[1:-2], ', ') || ' and ' || members[-1]
        || ' participate in a module dependency cycle.' AS message,
      array_to_string(members, '|') AS node_ids, evidence
    FROM regions JOIN proof USING (component)""",
)
def audit_module_cycle(spark, sf_dir):
    nodes = t.document_nodes(spark, sf_dir)
    modules = nodes.where(F.col("kind") == "module")
    links = module_edges(spark, sf_dir)
    components = cycles.strong_components(modules, links)
    members = audit.module_cycle_members(components, links)
    return _flat(audit.module_cycles(members, nodes, links))


@query(
    "audit_summary",
    f"""{MODULE_CYCLES}, modules AS (SELECT source || '/' || lang AS id, sum(loc) AS loc,
        count(*) AS source_files FROM docs WHERE role = 'source' GROUP BY source, lang)
    SELECT (SELECT count(*) FROM docs) AS files, (SELECT count(*) FROM modules) AS modules,
      (SELECT count(DISTINCT split_part(id, '/', 1)) FROM modules) AS components,
      (SELECT count(*) FROM links WHERE source <> target) + (SELECT count(*) FROM module_edges) AS edges,
      (SELECT count(*) FROM docs WHERE role = 'source' AND loc >= 800)
        + (SELECT count(*) FROM modules WHERE source_files >= 15 OR loc >= 2500)
        + (SELECT count(*) FROM regions) AS warnings,
      (SELECT count(*) FROM modules WHERE source_files = 1 AND loc <= 25) AS notices""",
)
def audit_summary(spark, sf_dir):
    nodes, links, findings = _audited(spark, sf_dir)
    return audit.audit_summary(nodes, links, findings)


def _audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = t.document_nodes(spark, sf_dir)
    upper = module_edges(spark, sf_dir)
    lower = t.document_edges(spark, sf_dir).where(F.col("source") != F.col("target"))
    modules = nodes.where(F.col("kind") == "module")
    components = cycles.strong_components(modules, upper)
    links = lower.unionByName(upper)
    return nodes, links, audit.audit(nodes, t.document_membership(spark, sf_dir), links, components)


@query("audit_labels", f"{AUDIT} SELECT id, CASE WHEN source_files < 15 AND loc > 25 THEN 'Map audit clear' "
       "ELSE source_files || ' warning' || CASE WHEN source_files = 1 THEN '' ELSE 's' END || ' · ' || loc "
       "|| ' notice' || CASE WHEN loc = 1 THEN '' ELSE 's' END END AS label FROM modules")
def audit_labels(spark, sf_dir):
    """The one-line verdict, fed with two counts per module (files, lines)."""
    sizes = _sizes(spark, sf_dir)
    quiet = (F.col("source_files") < 15) & (F.col("loc") > 25)
    warnings = F.when(quiet, F.lit(0)).otherwise(F.col("source_files"))
    notices = F.when(quiet, F.lit(0)).otherwise(F.col("loc"))
    return sizes.select("id", text.audit_label(warnings, notices).alias("label"))


# ------------------------------------------------------------------------ cycles
@query(
    "scc_documents",
    f"{RECURSIVE}, {CLOSURE.format(edges='links', nodes='ids')} SELECT node, component FROM comps",
)
def scc_documents(spark, sf_dir):
    nodes = t.document_files(spark, sf_dir).select("id")
    return cycles.strong_components(nodes, t.document_edges(spark, sf_dir))


@query(
    "cyclic_regions",
    f"""{RECURSIVE}, {CLOSURE.format(edges='links', nodes='ids')},
    sizes AS (SELECT component, count(*) AS n FROM comps GROUP BY component)
    SELECT node, component FROM comps JOIN sizes USING (component)
    WHERE n > 1 OR node IN (SELECT source FROM links WHERE source = target)""",
)
def cyclic_regions(spark, sf_dir):
    links = t.document_edges(spark, sf_dir)
    components = cycles.strong_components(t.document_files(spark, sf_dir).select("id"), links)
    return cycles.cyclic_regions(components, links)


@query(
    "cycle_representative",
    f"""{RECURSIVE}, {CLOSURE.format(edges='links', nodes='ids')},
    inside AS (SELECT DISTINCT a.component, source, target FROM links JOIN comps a ON a.node = source
      JOIN comps b ON b.node = target WHERE a.component = b.component),
    far(component, node, depth) USING KEY (component, node) AS (SELECT DISTINCT component, component, 0 FROM inside
      UNION SELECT DISTINCT f.component, i.target, f.depth + 1 FROM far f JOIN inside i ON i.component = f.component AND i.source = f.node
        WHERE NOT EXISTS (SELECT 1 FROM recurring.far r WHERE r.component = f.component AND r.node = i.target)),
    ending AS (SELECT i.component, min(struct_pack(d := depth, n := source)) AS e FROM inside i JOIN far f
      ON f.component = i.component AND f.node = i.source WHERE i.target = i.component GROUP BY i.component),
    nearer AS (SELECT i.component, i.target AS node, min(i.source) AS via FROM inside i
      JOIN far a ON a.component = i.component AND a.node = i.source JOIN far b ON b.component = i.component AND b.node = i.target
      WHERE a.depth + 1 = b.depth GROUP BY i.component, i.target),
    way AS (SELECT component, e.n AS node, e.d AS position FROM ending
      UNION ALL SELECT w.component, via, position - 1 FROM way w JOIN nearer n ON n.component = w.component AND n.node = w.node)
    SELECT component, CAST(position AS BIGINT) AS position, node FROM way""",
)
def cycle_representative(spark, sf_dir):
    """Of each cyclic component a shortest cycle through its smallest node."""
    links = t.document_edges(spark, sf_dir)
    components = cycles.strong_components(t.document_files(spark, sf_dir).select("id"), links)
    return cycles.representative_cycles(components, links)


# ----------------------------------------------------------------- review order
# Every document is changed; labelled documents are also known by a second path
# that no node has, so the order ends with unmapped paths.
@query(
    "review_order",
    f"""{RECURSIVE}, {CLOSURE.format(edges='links', nodes='ids')},
    needs AS (SELECT DISTINCT a.component AS grp, b.component AS needs FROM links
      JOIN comps a ON a.node = links.source JOIN comps b ON b.node = links.target
      WHERE a.component <> b.component),
    grps AS (SELECT DISTINCT component AS grp FROM comps),
    kahn AS (SELECT 0 AS step, CAST([] AS VARCHAR[]) AS done
      UNION ALL SELECT step + 1, list_append(done, (SELECT min(grp) FROM grps
        WHERE NOT list_contains(done, grp) AND NOT EXISTS (SELECT 1 FROM needs
          WHERE needs.grp = grps.grp AND NOT list_contains(done, needs.needs))))
      FROM kahn WHERE step < (SELECT count(*) FROM grps)),
    placed AS (SELECT unnest(done) AS grp, generate_subscripts(done, 1) AS place FROM kahn
      WHERE step = (SELECT count(*) FROM grps)),
    mapped AS (SELECT 'path/' || node AS path, row_number() OVER (ORDER BY place, node) AS position
      FROM placed JOIN comps ON component = grp)
    SELECT position, path FROM mapped UNION ALL
    SELECT (SELECT count(*) FROM mapped) + row_number() OVER (ORDER BY 'new/' || doc_id), 'new/' || doc_id
    FROM labels""",
)
def review_order(spark, sf_dir):
    known = t.document_files(spark, sf_dir).select(
        F.concat(F.lit("path/"), "id").alias("path"), F.col("id").alias("node_id")
    )
    new = t.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("path"),
        F.lit(None).cast("string").alias("node_id"),
    )
    return impact.review_order(known.unionByName(new), t.document_edges(spark, sf_dir))
