"""Queries over the trade graph: edges, roll-ups, metrics, hotspots, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archtrail.operators import cycles, edges, enrich, hierarchy, impact
from archtrail.operators import query as ask
from archtrail.plans import tables as t
from archtrail.session import cut_lineage
from archtrail.plans.registry import query
from archtrail.sources import artifacts

WITH = f"WITH {t.SITES_SQL}, {t.TRADE_SQL}"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.edge_weights(t.trade_sites(spark, sf_dir))


# ------------------------------------------------------------------------ edges
@query("file_edges", f"{WITH} SELECT source, target, weight FROM edges")
def file_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("edge_evidence", f"{WITH} SELECT DISTINCT source, target, file, line FROM sites")
def edge_evidence(spark, sf_dir):
    return edges.evidence(t.trade_sites(spark, sf_dir))


@query(
    "edge_labels",
    f"""{WITH} SELECT source, target, string_agg(symbol, ', ' ORDER BY symbol) AS label
    FROM (SELECT DISTINCT source, target, symbol FROM sites) GROUP BY source, target""",
)
def edge_labels(spark, sf_dir):
    return edges.full_labels(edges.edge_symbols(t.trade_sites(spark, sf_dir)))


ROLLED = """rolled AS (
  SELECT a.parent AS source, b.parent AS target, file, line, symbol
  FROM sites JOIN members a ON a.child = source JOIN members b ON b.child = target
  WHERE a.parent <> b.parent)"""
COMPONENT_ROLLED = """rolled AS (
  SELECT c.parent AS source, d.parent AS target, file, line, symbol
  FROM sites JOIN members a ON a.child = source JOIN members b ON b.child = target
  JOIN members c ON c.child = a.parent JOIN members d ON d.child = b.parent
  WHERE c.parent <> d.parent)"""
ROLLED_EDGES = """SELECT source, target, weight, label FROM (
    SELECT source, target, count(*) AS weight FROM
      (SELECT DISTINCT source, target, file, line FROM rolled) GROUP BY source, target)
  JOIN (SELECT source, target, array_to_string(list_sort(list(symbol))[1:5], ', ')
          || CASE WHEN count(*) > 5 THEN ' (+' || (count(*) - 5) || ' more)' ELSE '' END AS label
        FROM (SELECT DISTINCT source, target, symbol FROM rolled) GROUP BY source, target)
  USING (source, target)"""


@query("rolled_edges_module", f"{WITH}, {ROLLED} {ROLLED_EDGES}")
def rolled_edges_module(spark, sf_dir):
    # Weights and labels both read the rolled sites, so they are joined once and written.
    return edges.build_edges(cut_lineage(t.trade_rolled_sites(spark, sf_dir)), labels="short")


@query("rolled_edges_component", f"{WITH}, {COMPONENT_ROLLED} {ROLLED_EDGES}")
def rolled_edges_component(spark, sf_dir):
    return edges.build_edges(cut_lineage(t.trade_rolled_sites(spark, sf_dir, component=True)), labels="short")


@query(
    "edge_label_overflow",
    f"""{WITH}, {ROLLED} SELECT source, target, array_to_string(list_sort(list(symbol))[1:5], ', ')
      || CASE WHEN count(*) > 5 THEN ' (+' || (count(*) - 5) || ' more)' ELSE '' END AS label
    FROM (SELECT DISTINCT source, target, symbol FROM rolled) GROUP BY source, target""",
)
def edge_label_overflow(spark, sf_dir):
    return edges.short_labels(cut_lineage(edges.edge_symbols(t.trade_rolled_sites(spark, sf_dir))))


@query(
    "undirected_weights",
    f"""{WITH}, {ROLLED} SELECT least(source, target) AS low, greatest(source, target) AS high,
      CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT source, target, count(*) AS weight FROM
        (SELECT DISTINCT source, target, file, line FROM rolled) GROUP BY source, target)
    GROUP BY low, high""",
)
def undirected_weights(spark, sf_dir):
    return edges.undirected_weights(edges.edge_weights(t.trade_rolled_sites(spark, sf_dir)))


FAN = """fan AS (
  SELECT id, (SELECT count(DISTINCT source) FROM edges e WHERE e.target = n.id) AS fan_in,
         (SELECT count(DISTINCT target) FROM edges e WHERE e.source = n.id) AS fan_out FROM files n)"""


@query("fan_metrics", f"{WITH}, {FAN} SELECT id, fan_in, fan_out FROM fan")
def fan_metrics(spark, sf_dir):
    return edges.fan_metrics(t.trade_files(spark, sf_dir), _edges(spark, sf_dir))


@query(
    "visible_edges",
    f"""{WITH} SELECT source, target, weight FROM edges
    WHERE source IN (SELECT id FROM files WHERE role = 'source')
      AND target IN (SELECT id FROM files WHERE role = 'source')""",
)
def visible_edges(spark, sf_dir):
    visible = t.trade_files(spark, sf_dir).where(F.col("role") == "source")
    return edges.edges_among(_edges(spark, sf_dir), visible)


# ---------------------------------------------------------------- single lookups
BUSIEST = """busiest AS (SELECT target AS id FROM edges GROUP BY target
  ORDER BY count(*) DESC, target LIMIT 1)"""


def _busiest(links: DataFrame) -> str:
    """The most used node: a one-row top-k, read to name the node to ask about."""
    counted = links.groupBy("target").agg(F.count(F.lit(1)).alias("_uses"))
    return counted.orderBy(F.desc("_uses"), "target").first()["target"]


@query("deps", f"""{WITH}, first_customer AS (SELECT min(source) AS id FROM edges)
  SELECT DISTINCT target AS id FROM edges WHERE source = (SELECT id FROM first_customer)""")
def deps(spark, sf_dir):
    links = _edges(spark, sf_dir)
    node = links.agg(F.min("source").alias("id")).first()["id"]
    return edges.neighbours(links, t.trade_files(spark, sf_dir), node)


@query("rdeps", f"""{WITH}, {BUSIEST}
  SELECT DISTINCT source AS id FROM edges WHERE target = (SELECT id FROM busiest)""")
def rdeps(spark, sf_dir):
    links = _edges(spark, sf_dir)
    return edges.neighbours(links, t.trade_files(spark, sf_dir), _busiest(links), reverse=True)


@query(
    "explain_relationships",
    f"""{WITH}, {BUSIEST} SELECT 'used_by' AS direction, e.source AS other_id,
      coalesce(n.kind, 'unknown') AS other_kind, coalesce(n.label, 'Unknown') AS other_label,
      e.weight, l.label
    FROM edges e JOIN (SELECT source, target, string_agg(symbol, ', ' ORDER BY symbol) AS label
        FROM (SELECT DISTINCT source, target, symbol FROM sites) GROUP BY source, target) l
      ON l.source = e.source AND l.target = e.target
    LEFT JOIN nodes n ON n.id = e.source WHERE e.target = (SELECT id FROM busiest)""",
)
def explain_relationships(spark, sf_dir):
    links = cut_lineage(edges.build_edges(t.trade_sites(spark, sf_dir)))
    return ask.relationships(links, t.trade_nodes(spark, sf_dir), _busiest(links))


@query(
    "explain_hierarchy",
    f"""{WITH}, {BUSIEST}, chain AS (
      SELECT 2 AS place, parent AS id FROM members WHERE child = (SELECT id FROM busiest)
      UNION ALL SELECT 1, m.parent FROM members m WHERE m.child =
        (SELECT parent FROM members WHERE child = (SELECT id FROM busiest)))
    SELECT CAST(place AS BIGINT) AS place, id, kind, label FROM chain JOIN nodes USING (id)""",
)
def explain_hierarchy(spark, sf_dir):
    nodes = t.trade_nodes(spark, sf_dir)
    busiest = _busiest(_edges(spark, sf_dir))
    one = nodes.where(F.col("id") == busiest)
    above = hierarchy.ancestors(one, t.trade_membership(spark, sf_dir))
    return ask.lineage_of(above, nodes, busiest)


# ------------------------------------------------------------------- hierarchy
@query(
    "ancestors",
    f"""{WITH} SELECT id AS node, id AS ancestor, CAST(0 AS BIGINT) AS distance FROM nodes
    UNION ALL SELECT child, parent, 1 FROM members
    UNION ALL SELECT a.child, b.parent, 2 FROM members a JOIN members b ON b.child = a.parent""",
)
def ancestors(spark, sf_dir):
    return hierarchy.ancestors(t.trade_nodes(spark, sf_dir), t.trade_membership(spark, sf_dir))


DESCENDANTS = """below AS (SELECT id AS node, id AS file FROM files
  UNION ALL SELECT parent, child FROM members WHERE parent LIKE 'n:%'
  UNION ALL SELECT b.parent, a.child FROM members a JOIN members b ON b.child = a.parent)"""


@query("descendants", f"{WITH}, {DESCENDANTS} SELECT DISTINCT node, file FROM below")
def descendants(spark, sf_dir):
    return hierarchy.descendant_files(t.trade_nodes(spark, sf_dir), t.trade_membership(spark, sf_dir))


@query("level_members", f"{WITH} SELECT child AS id FROM members WHERE parent = 'r:1'")
def level_members(spark, sf_dir):
    return hierarchy.members(t.trade_membership(spark, sf_dir), "r:1")


@query(
    "membership_map",
    f"""{WITH} SELECT parent, array_to_string(list_sort(list(child)), ',') AS children
    FROM members WHERE parent LIKE 'r:%' GROUP BY parent""",
)
def membership_map(spark, sf_dir):
    levels = hierarchy.level_map(t.trade_module_membership(spark, sf_dir))
    return levels.select("parent", F.array_join("children", ",").alias("children"))


@query("system_level", f"{WITH} SELECT id FROM nodes WHERE kind = 'component'")
def system_level(spark, sf_dir):
    return hierarchy.top_level(t.trade_nodes(spark, sf_dir))


@query(
    "loc_rollup",
    f"""{WITH}, per_module AS (SELECT parent AS id, CAST(sum(loc) AS BIGINT) AS loc
      FROM members JOIN files ON child = id GROUP BY parent)
    SELECT id, loc FROM per_module UNION ALL
    SELECT parent, CAST(sum(loc) AS BIGINT) FROM members JOIN per_module ON child = id GROUP BY parent""",
)
def loc_rollup(spark, sf_dir):
    modules = hierarchy.roll_up(t.trade_files(spark, sf_dir), t.trade_file_membership(spark, sf_dir), "loc")
    components = hierarchy.roll_up(modules, t.trade_module_membership(spark, sf_dir), "loc")
    return modules.unionByName(components)


# -------------------------------------------------------------------- hotspots
CHURN = """churn AS (SELECT 's:' || json_extract_string(props, '$.k') AS file, count(*) AS commits
  FROM events GROUP BY file)"""


@query(
    "hotspots_topk",
    f"""{WITH}, {CHURN}, {DESCENDANTS}, node_churn AS (SELECT node AS id, CAST(sum(commits) AS BIGINT) AS churn
      FROM (SELECT DISTINCT node, file FROM below) JOIN churn USING (file) GROUP BY node),
    fans AS (SELECT target AS id, count(DISTINCT source) AS fan_in FROM edges GROUP BY target)
    SELECT coalesce(fan_in, 0) * coalesce(churn, 0) AS score, coalesce(fan_in, 0) AS fan_in,
      coalesce(churn, 0) AS churn, id
    FROM nodes LEFT JOIN fans USING (id) LEFT JOIN node_churn USING (id)
    ORDER BY score DESC, fan_in DESC, churn DESC, id LIMIT 20""",
)
def hotspots_topk(spark, sf_dir):
    key = F.concat(F.lit("s:"), F.get_json_object("props", "$.k"))
    churn = t.table(spark, sf_dir, "events").groupBy(key.alias("file")).agg(
        F.count(F.lit(1)).alias("commits")
    )
    nodes = t.trade_nodes(spark, sf_dir)
    metrics = edges.fan_metrics(nodes, _edges(spark, sf_dir))
    # Churn is counted per file first, so it moves up the hierarchy as one row per
    # file and two small joins.
    own = churn.select(F.col("file").alias("id"), F.col("commits").alias("churn"))
    files = t.trade_files(spark, sf_dir).join(own, "id").select("id", "churn")
    modules = hierarchy.roll_up(files, t.trade_file_membership(spark, sf_dir), "churn")
    components = hierarchy.roll_up(modules, t.trade_module_membership(spark, sf_dir), "churn")
    return ask.hotspots(metrics, files.unionByName(modules).unionByName(components), 20)


@query(
    "node_churn",
    f"""{WITH}, {CHURN}, {DESCENDANTS} SELECT node AS id, CAST(sum(commits) AS BIGINT) AS churn
    FROM (SELECT DISTINCT node, file FROM below) JOIN churn USING (file) GROUP BY node""",
)
def node_churn(spark, sf_dir):
    key = F.concat(F.lit("s:"), F.get_json_object("props", "$.k"))
    churn = t.table(spark, sf_dir, "events").groupBy(key.alias("file")).agg(
        F.count(F.lit(1)).alias("commits")
    )
    below = hierarchy.descendant_files(t.trade_nodes(spark, sf_dir), t.trade_membership(spark, sf_dir))
    return ask.node_churn(below, churn)


# ------------------------------------------------------------------------ cycles
# A firm that buys and sells under one number: customers and suppliers share keys.
FIRM_SQL = """firm AS (SELECT DISTINCT 'f:' || o_custkey AS source, 'f:' || l_suppkey AS target
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
firms AS (SELECT 'f:' || c_custkey AS id FROM customer UNION SELECT 'f:' || s_suppkey FROM supplier)"""
CLOSURE = """reach AS (SELECT source, target FROM {edges} WHERE source <> target
  UNION SELECT r.source, e.target FROM reach r JOIN {edges} e ON e.source = r.target),
mutual AS (SELECT a.source AS node, a.target AS other FROM reach a
  JOIN reach b ON b.source = a.target AND b.target = a.source),
comps AS (SELECT id AS node, least(id, coalesce(min(other), id)) AS component
  FROM {nodes} LEFT JOIN mutual ON mutual.node = id GROUP BY id)"""


def firm_graph(spark, sf_dir):
    links = t.trade_pairs(spark, sf_dir, any_part=True).select(
        t._key("f:", "buyer").alias("source"), t._key("f:", "seller").alias("target")
    )
    customers = t.table(spark, sf_dir, "customer").select(t._key("f:", "c_custkey").alias("id"))
    suppliers = t.table(spark, sf_dir, "supplier").select(t._key("f:", "s_suppkey").alias("id"))
    return customers.unionByName(suppliers).distinct(), links


@query("scc_firms", f"WITH RECURSIVE {FIRM_SQL}, {CLOSURE.format(edges='firm', nodes='firms')} "
       "SELECT node, component FROM comps")
def scc_firms(spark, sf_dir):
    return cycles.strong_components(*firm_graph(spark, sf_dir))


# Nations linked where one buys clearly more from the other than it sells to it.
NET_SQL = f"""WITH RECURSIVE {t.SITES_SQL}, {t.TRADE_SQL}, {ROLLED}, flow AS (
    SELECT source, target, count(*) AS weight FROM (SELECT DISTINCT source, target, file, line FROM rolled)
    GROUP BY source, target),
  net AS (SELECT a.source, a.target, a.weight FROM flow a LEFT JOIN flow b
    ON b.source = a.target AND b.target = a.source WHERE a.weight * 2 > coalesce(b.weight, 0) * 3),
  nations AS (SELECT 'n:' || n_nationkey AS id, n_name AS label FROM nation)"""


def net_flow(spark, sf_dir):
    flow = cut_lineage(edges.edge_weights(t.trade_rolled_sites(spark, sf_dir)))
    back = flow.select(
        F.col("source").alias("target"), F.col("target").alias("source"), F.col("weight").alias("_back")
    )
    return (
        flow.join(back, ["source", "target"], "left")
        .where(F.col("weight") * 2 > F.coalesce("_back", F.lit(0)) * 3)
        .select("source", "target", "weight")
    )


def nations(spark, sf_dir):
    return t.trade_nodes(spark, sf_dir).where(F.col("kind") == "module")


@query("scc_net_flow", f"{NET_SQL}, {CLOSURE.format(edges='net', nodes='nations')} "
       "SELECT node, component FROM comps")
def scc_net_flow(spark, sf_dir):
    return cycles.strong_components(nations(spark, sf_dir), net_flow(spark, sf_dir))


# ------------------------------------------------------------------------ impact
# A change set: parties in debt. The market segment or nation decides the status;
# orders of urgent priority stand for paths that no node has.
CHANGES_SQL = """changes AS (
  SELECT 'c:' || c_custkey AS path, CASE c_mktsegment WHEN 'BUILDING' THEN 'added'
      WHEN 'AUTOMOBILE' THEN 'deleted' ELSE 'modified' END AS status FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 's:' || s_suppkey, CASE WHEN s_nationkey < 5 THEN 'renamed' ELSE 'modified' END
    FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT 'o:' || o_orderkey, 'deleted' FROM orders WHERE o_orderpriority = '1-URGENT'),
mapped AS (SELECT path, status, id AS node_id FROM changes LEFT JOIN files ON id = path),
dependents AS (SELECT DISTINCT target AS changed_node_id, source AS dependent_node_id FROM edges
  WHERE target IN (SELECT node_id FROM mapped WHERE node_id IS NOT NULL)
    AND source NOT IN (SELECT node_id FROM mapped WHERE node_id IS NOT NULL))"""


def change_set(spark, sf_dir):
    segment = F.col("c_mktsegment")
    customers = t.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(
        t._key("c:", "c_custkey").alias("path"),
        F.when(segment == "BUILDING", "added").when(segment == "AUTOMOBILE", "deleted")
        .otherwise("modified").alias("status"),
    )
    suppliers = t.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(
        t._key("s:", "s_suppkey").alias("path"),
        F.when(F.col("s_nationkey") < 5, "renamed").otherwise("modified").alias("status"),
    )
    orders = t.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        t._key("o:", "o_orderkey").alias("path"), F.lit("deleted").alias("status")
    )
    changes = customers.unionByName(suppliers).unionByName(orders)
    return changes.withColumn("old_path", F.lit(None).cast("string"))


def file_index(spark, sf_dir):
    return t.trade_files(spark, sf_dir).select("id", F.col("id").alias("path"))


def mapped_changes(spark, sf_dir):
    return impact.changed_nodes(change_set(spark, sf_dir), file_index(spark, sf_dir))


@query("changed_nodes", f"{WITH}, {CHANGES_SQL} SELECT path, status, node_id FROM mapped")
def changed_nodes(spark, sf_dir):
    return mapped_changes(spark, sf_dir).drop("old_path")


@query("direct_dependents", f"{WITH}, {CHANGES_SQL} SELECT * FROM dependents")
def direct_dependents(spark, sf_dir):
    mapped = mapped_changes(spark, sf_dir)
    return impact.direct_dependents(mapped, _edges(spark, sf_dir), file_index(spark, sf_dir))


@query(
    "impact_summary",
    f"""{WITH}, {CHANGES_SQL} SELECT (SELECT count(*) FROM mapped) AS changed_files,
      (SELECT count(node_id) FROM mapped) AS mapped_files,
      (SELECT count(DISTINCT dependent_node_id) FROM dependents) AS direct_dependents""",
)
def impact_summary(spark, sf_dir):
    return impact.impact_summary(mapped_changes(spark, sf_dir), direct_dependents(spark, sf_dir))


@query(
    "change_status_rollup",
    f"""{WITH}, {CHANGES_SQL} SELECT parent AS id, CASE WHEN count(DISTINCT status) = 1
      THEN min(status) ELSE 'mixed' END AS status
    FROM mapped JOIN members ON child = node_id GROUP BY parent""",
)
def change_status_rollup(spark, sf_dir):
    nodes = t.trade_nodes(spark, sf_dir)
    membership = t.trade_membership(spark, sf_dir)
    visible = nodes.where(F.col("kind") == "module")
    return impact.status_overlay(mapped_changes(spark, sf_dir), membership, visible)


@query(
    "impact_risk",
    f"""{WITH}, {CHANGES_SQL} SELECT DISTINCT dependent_node_id AS id FROM dependents""",
)
def impact_risk(spark, sf_dir):
    nodes = t.trade_nodes(spark, sf_dir)
    membership = t.trade_membership(spark, sf_dir)
    visible = nodes.where(F.col("kind") == "file")
    mapped = mapped_changes(spark, sf_dir)
    statuses = impact.status_overlay(mapped, membership, visible)
    return impact.risk_overlay(direct_dependents(spark, sf_dir), statuses, membership, visible)


# --------------------------------------------------------------- export and checks
@query(
    "mermaid_lines",
    f"""{WITH}, {ROLLED}, shown AS ({ROLLED_EDGES})
    SELECT '  n_n_' || n_nationkey || '["' || n_name || '"]' AS line FROM nation UNION ALL
    SELECT '  n_' || replace(source, ':', '_') || ' -->|"' || label || '"| n_' || replace(target, ':', '_') FROM shown""",
)
def mermaid_lines(spark, sf_dir):
    return artifacts.mermaid_lines(nations(spark, sf_dir), rolled_edges_module(spark, sf_dir)).select("line")


@query(
    "contract_violations",
    """SELECT 'c:' || c_custkey AS subject, 'metrics are not negative' AS rule FROM customer WHERE floor(c_acctbal) < 0
    UNION ALL SELECT 's:' || s_suppkey, 'metrics are not negative' FROM supplier WHERE floor(s_acctbal) < 0""",
)
def contract_violations(spark, sf_dir):
    """The trade graph with balances as they are: a negative one breaks the contract."""
    balances = [
        t.table(spark, sf_dir, name).select(
            t._key(f"{name[0]}:", f"{name[0]}_{key}").alias("id"), F.floor(f"{name[0]}_acctbal").alias("_loc")
        )
        for name, key in (("customer", "custkey"), ("supplier", "suppkey"))
    ]
    sites = t.trade_sites(spark, sf_dir)
    links = edges.edge_weights(sites)
    nodes = t.trade_files(spark, sf_dir).withColumn("kind", F.lit("file"))
    nodes = nodes.join(balances[0].unionByName(balances[1]), "id").withColumn("loc", F.col("_loc"))
    measured = nodes.drop("_loc").join(edges.fan_metrics(nodes, links), "id")
    return artifacts.map_violations(measured, links, edges.evidence(sites))


@query(
    "prompt_context",
    f"""{WITH}, {ROLLED}, links AS (SELECT DISTINCT source, target FROM rolled)
    SELECT parent AS component, count(*) AS items FROM (
      SELECT parent FROM members WHERE parent LIKE 'r:%' UNION ALL
      SELECT a.parent FROM links JOIN members a ON a.child = source JOIN members b ON b.child = target
      WHERE a.parent = b.parent) GROUP BY parent""",
)
def prompt_context(spark, sf_dir):
    """How many context items each component offers to a prompt."""
    nodes = t.trade_nodes(spark, sf_dir).select(
        "*", F.col("id").alias("path"), F.lit("").alias("summary"),
        F.lit(0).alias("fan_in"), F.lit(0).alias("fan_out"),
    )
    context = enrich.module_context(nodes, rolled_edges_module(spark, sf_dir), t.trade_membership(spark, sf_dir))
    return context.groupBy("component").agg(F.count(F.lit(1)).alias("items"))


@query(
    "change_set",
    f"{WITH}, {CHANGES_SQL} SELECT status, count(*) AS paths FROM changes GROUP BY status",
)
def change_set_by_status(spark, sf_dir):
    return change_set(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("paths"))
