"""Command line: ``python -m archtrail.cli <command> …``.

``analyze`` writes a map folder (parquet tables, on request also JSON); all other
commands read one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.operators import cycles, edges, hierarchy, impact, incremental, trace
from archtrail.operators import query as ask
from archtrail.plans import analyze as plan
from archtrail.session import build_session
from archtrail.sources import artifacts, changes, events
from archtrail.streaming import tail


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="archtrail")
    parser.add_argument("--master", help="Spark master; leave out on a cluster")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> None:
        sub = commands.add_parser(name)
        for argument in positional:
            sub.add_argument(argument)
        for option, settings in options.items():
            sub.add_argument("--" + option.replace("_", "-"), **settings)

    many = {"action": "append", "default": []}
    command("analyze", "repo", "map", json={}, previous={}, generated=many, vendored=many)
    command("impact", "repo", "map", changes={"required": True}, map_version={})
    command("ingest", "log", "map", repo={"required": True}, output={"required": True})
    command("watch", "directory", "map", output={"required": True}, state={"required": True})
    for name in ("deps", "rdeps", "explain"):
        command(name, "node", "map")
    command("cycles", "map")
    command("audit", "map")
    command("hotspots", "map", churn={"required": True}, limit={"type": int, "default": 20})
    return parser.parse_args()


def _print(df: DataFrame) -> None:
    """Rows as tab-separated lines, streamed."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if value is None else str(value) for value in row))


def main() -> None:
    options = _arguments()
    spark = build_session(master=options.master)
    if options.command == "analyze":
        sources = plan.tree_sources(spark, options.repo)
        facts = earlier = None
        if options.previous:
            if options.previous == options.map:
                raise SystemExit("write the new map to another folder than the previous one")
            earlier = artifacts.load_map(spark, options.previous)
            before = spark.read.parquet(f"{options.previous}/digests")
            facts, found = incremental.refresh_facts(sources.files, before, earlier.facts)
            _print(incremental.report(sources.files, found))
        result = plan.analyze(sources, options.generated, options.vendored, facts, earlier)
        artifacts.save_map(result, options.map)
        digests = result.facts.select("path", "digest")
        digests.write.mode("overwrite").parquet(f"{options.map}/digests")
        version = changes.content_version(digests)
        print(f"version\t{version}")
        if options.json:
            artifacts.write_json(artifacts.map_document(result, version), options.json)
        return
    known = artifacts.load_map(spark, options.map)
    file_nodes = known.nodes.where("kind = 'file'").select("id", "path")
    if options.command == "impact":
        if options.map_version:
            changes.check_version(options.map_version, spark.read.parquet(f"{options.map}/digests"))
        mapped = impact.changed_nodes(changes.read_changes(spark, options.changes), file_nodes)
        dependents = impact.direct_dependents(mapped, known.edges, file_nodes)
        for part in (mapped, dependents, impact.review_order(mapped, known.edges).orderBy("position"),
                     impact.impact_summary(mapped, dependents)):
            _print(part)
    elif options.command == "ingest":
        resolved = trace.ingest(events.read_log(spark, options.log), file_nodes, options.repo)
        resolved.write.mode("overwrite").parquet(options.output)
        _print(trace.trace_summary(resolved))
    elif options.command == "watch":
        raw = tail.read_tail(spark, options.directory)
        tail.follow(raw, options.output, options.state).awaitTermination()
    elif options.command in ("deps", "rdeps"):
        _print(edges.neighbours(known.edges, known.nodes, options.node, options.command == "rdeps"))
    elif options.command == "explain":
        one = known.nodes.where(F.col("id") == options.node)
        above = hierarchy.ancestors(one, known.membership)
        for part in ask.explain_node(known.nodes, known.edges, above, known.findings, options.node).values():
            _print(part)
    elif options.command == "cycles":
        regions = cycles.strong_components(known.nodes, known.edges)
        _print(cycles.representative_cycles(regions, known.edges).orderBy("component", "position"))
    elif options.command == "audit":
        _print(known.findings)
    elif options.command == "hotspots":
        below = hierarchy.descendant_files(known.nodes, known.membership)
        churn = ask.node_churn(below, changes.read_churn(spark, options.churn))
        _print(ask.hotspots(known.nodes, churn, options.limit))


if __name__ == "__main__":
    main()
