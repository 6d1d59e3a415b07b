"""Which import sites a change of files can touch: an inverse index of what was looked up.

Resolution is a set of questions: is there a file at this path, which file reads as this
module next to this directory, which of them provides this symbol, where does a package file
hand a symbol on to. Every site keeps its questions as rows (kind, directory, name,
symbol), which sites of one directory that name one module share. A change is turned into the questions whose answer differs before and after, and
only sites that asked one of them are resolved again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.functions import paths
from archtrail.operators import reexports, resolve
from archtrail.operators.facts import import_sites
from archtrail.operators.incremental import structural_difference
from archtrail.operators.ranking import first_n
from archtrail.session import cut_lineage

KEY = ["kind", "directory", "name", "symbol"]
ASKING = ["script", "home", "module"]
#: Parts the questions are stored in, by a hash of the name: a change reads those of its names only.
BUCKETS = 64


@dataclass(frozen=True)
class Resolution:
    """What one resolution leaves for the next."""

    facts: DataFrame
    sites: DataFrame  # site, importer, language, module, line, fallbacks, symbols
    direct: DataFrame  # site, importer, line, symbols, target, via
    questions: DataFrame  # bucket, kind, directory, name, symbol, script, home, module, site
    ends: DataFrame  # file, symbol, final, steps, circular, sure
    resolved: DataFrame  # site, source, target, file, line, symbols
    markers: DataFrame
    configs: DataFrame


@dataclass(frozen=True)
class Change:
    """What a refresh did. ``delta`` has edge sites with ``sign`` -1 (gone) or 1 (new)."""

    delta: DataFrame
    again: DataFrame  # site, importer of what was resolved again


def _question(kind: str, directory, name, symbol) -> list:
    return [F.lit(kind).alias("kind"), directory.alias("directory"), name.alias("name"), symbol.alias("symbol")]


def questions(numbered: DataFrame, direct: DataFrame, configs: DataFrame) -> DataFrame:
    """(bucket, kind, directory, name, symbol, script, home, module, site): everything that was looked up, whether or not it was there.

    Sites of one directory that name one module ask the same: their questions stand once, under
    (script, home, module). Only what is handed on is asked by each ``site``; there those three are null."""
    nowhere, python = F.lit(""), F.col("language") == "python"
    home = paths.directory(F.col("importer")).alias("home")
    told = cut_lineage(resolve.live_sites(numbered.where(python)).select(
        home, "module", "package", F.try_element_at("symbols", F.lit(1)).alias("wanted")
    ).distinct())
    near = F.explode(paths.ancestor_directories(F.col("home"))).alias("near")
    asking = ["home", "module"]
    absolute = told.select(*asking).distinct().where("left(module, 1) <> '.'").select(*asking, near)
    package = told.where("left(package, 1) <> '.' and wanted is not null").select(*asking, "package", "wanted", near)
    dotted = resolve._as_sites(told, "package")
    beside = resolve.relative_places(dotted.where("left(module, 1) = '.'"), F.col("module")).unionByName(
        resolve.relative_places(dotted.where("left(package, 1) = '.'"), F.col("package"))
    ).select("site.*", "path")
    scripts = resolve._as_sites(numbered.where(~python).select(home, "module").distinct())
    tried = resolve.script_places(scripts, configs).select("site.*", "path")
    handed = resolve.with_first_symbol(direct).where(resolve.movable())

    def shared(rows: DataFrame, script: bool, *question) -> DataFrame:
        return rows.select(*question, F.lit(script).alias("script"), *asking, F.lit(None).cast("string").alias("site"))

    nobody = F.lit(None).cast("string")
    asked = (
        shared(absolute, False, *_question("module", F.col("near"), F.col("module"), nowhere))
        .unionByName(shared(package, False, *_question("provides", F.col("near"), F.col("package"), F.col("wanted"))))
        .unionByName(shared(beside, False, *_question("file", nowhere, F.col("path"), nowhere)))
        .unionByName(shared(tried, True, *_question("file", nowhere, F.col("path"), nowhere)))
        .unionByName(handed.select(
            *_question("handed", nowhere, F.col("target"), F.col("symbol")), F.lit(None).cast("boolean").alias("script"),
            nobody.alias("home"), nobody.alias("module"), "site",
        ))
    )
    return asked.select(_bucket("name"), *KEY, *ASKING, "site")


def _bucket(name: str):
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int").alias("bucket")


def resolve_all(facts: DataFrame, markers: DataFrame, configs: DataFrame) -> Resolution:
    """Resolve every site and keep its questions."""
    numbered = cut_lineage(resolve.numbered_sites(import_sites(facts)))
    direct = cut_lineage(resolve.direct_targets(numbered, facts, markers, configs))
    nodes, options = reexports.handed_on(numbered, direct, facts)
    ends = cut_lineage(reexports.follow(nodes))
    rows = cut_lineage(resolve.site_rows(resolve._follow_packages(resolve.with_first_symbol(direct), nodes, options, ends)))
    asked = cut_lineage(questions(numbered, direct, configs), by="bucket")
    return Resolution(facts, numbered, direct, asked, ends, rows, markers, configs)


def _named(facts: DataFrame, roots: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, root, module) of the files that read as one of ``modules(module)``, and those below a search root."""
    files = facts.where("language = 'python'").select("path")
    named = resolve.module_names(resolve.asked_files(files, modules), modules)
    return named, named.join(roots, "root", "left_semi")


def _answers(named: DataFrame, rooted: DataFrame, keys: list[str]) -> DataFrame:
    """near, ``keys``, path, how: what a look-up of a module finds next to a directory."""
    below = rooted.select("path", *keys, F.explode(paths.ancestor_directories(paths.parent(F.col("path")))).alias("near")).distinct()
    lowest = first_n(below, ["near", *keys], [F.col("path")], 2).select("near", *keys, "path", F.lit("below").alias("how"))
    return lowest.unionByName(named.select(F.col("root").alias("near"), *keys, "path", F.lit("root").alias("how")))


def _provided(facts: DataFrame) -> DataFrame:
    return resolve._provided(facts)


def changed_questions(before: Resolution, facts: DataFrame, changed: DataFrame, markers: DataFrame) -> DataFrame:
    """(kind, directory, name, symbol) whose answer may differ: ``changed(path)`` are files added, deleted or edited."""
    old, new = (cut_lineage(f.join(changed, "path", "left_semi")) for f in (before.facts, facts))
    there = structural_difference(old.select("path"), new.select("path"), ["path"]).select("path")
    was_roots = cut_lineage(resolve.search_roots(before.facts.select("path"), before.markers))
    now_roots = cut_lineage(resolve.search_roots(facts.select("path"), markers))
    moved_roots = structural_difference(was_roots, now_roots, ["root"]).select("root")
    python = F.col("path").endswith(".py")
    # Names of files that came or went, and of all files below a root that did.
    names = resolve.module_names(there.where(python)).select("module")
    moved_roots = cut_lineage(moved_roots)
    if not moved_roots.isEmpty():
        for side in (before.facts, facts):
            named = resolve.module_names(side.where("language = 'python'").select("path"))
            names = names.unionByName(named.join(moved_roots, "root", "left_semi").select("module"))
    names = cut_lineage(names.distinct())
    symbols = structural_difference(_provided(old).distinct(), _provided(new).distinct(), ["path", "symbol"]).select("path", "symbol")
    symbols = cut_lineage(symbols)
    told = cut_lineage(resolve.module_names(symbols.select("path").distinct().where(python)).join(symbols, "path").select("module", "symbol").unionByName(
        _provided(before.facts).unionByName(_provided(facts)).join(_named(before.facts, was_roots, names)[0].unionByName(_named(facts, now_roots, names)[0]).select("path", "module").distinct(), "path").select("module", "symbol")
    ).distinct())
    sides, sides_told = [], []
    for side, roots in ((before.facts, was_roots), (facts, now_roots)):
        named, rooted = _named(side, roots, names)
        sides.append(_answers(named, rooted, ["module"]))
        named, rooted = _named(side, roots, told.select("module"))
        able = _provided(side).join(named.select("path").distinct(), "path", "left_semi").join(told.select("symbol").distinct(), "symbol", "left_semi")
        named, rooted = (n.join(able, "path").join(told, ["module", "symbol"], "left_semi") for n in (named, rooted))
        sides_told.append(_answers(named, rooted, ["module", "symbol"]))
    modules = structural_difference(*sides, ["near", "module", "path", "how"]).select(*_question("module", F.col("near"), F.col("module"), F.lit("")))
    provides = structural_difference(*sides_told, ["near", "module", "symbol", "path", "how"]).select(*_question("provides", F.col("near"), F.col("module"), F.col("symbol")))
    files = there.select(*_question("file", F.lit(""), F.col("path"), F.lit("")))
    return modules.unionByName(provides).unionByName(files).distinct()


def _asking(sites: DataFrame) -> DataFrame:
    """``sites`` with the columns that their shared questions stand under."""
    return sites.select("*", (F.col("language") != "python").alias("script"), paths.directory(F.col("importer")).alias("home"))


def _askers(asked: DataFrame, changed: DataFrame, sites: DataFrame) -> DataFrame:
    """Those of ``sites`` that asked one of the changed questions; only the buckets of their names are read."""
    keyed = cut_lineage(changed.withColumn("bucket", _bucket("name")))
    buckets = [r.bucket for r in keyed.select("bucket").distinct().collect()]
    if not buckets:
        return sites.limit(0).select("site")
    met = cut_lineage(asked.where(F.col("bucket").isin(*buckets)).join(keyed.drop("bucket"), KEY, "left_semi").select(*ASKING, "site"))
    several = _asking(sites).join(met.where("site is null").select(*ASKING).distinct(), ASKING, "left_semi").select("site")
    return several.unionByName(met.where("site is not null").select("site")).distinct()


def resolve_changed(before: Resolution, facts: DataFrame, changed: DataFrame, markers: DataFrame, configs: DataFrame) -> tuple[Resolution, Change]:
    """Resolve again what ``changed(path)`` can touch; everything else is taken over.

    ``facts`` are those of the new snapshot. Script sites are all resolved again where
    ``configs`` differ."""
    own = before.sites.join(changed.select(F.col("path").alias("importer")), "importer", "left_semi").select("site", "importer")
    asked = _askers(before.questions, changed_questions(before, facts, changed, markers), before.sites)
    foreign = before.sites.join(asked, "site", "left_semi").join(changed.select(F.col("path").alias("importer")), "importer", "left_anti")
    if not structural_difference(before.configs, configs, before.configs.columns).isEmpty():
        foreign = foreign.unionByName(before.sites.where("language <> 'python'").join(changed.select(F.col("path").alias("importer")), "importer", "left_anti")).dropDuplicates(["site"])
    foreign = cut_lineage(foreign)
    fresh_own = resolve.numbered_sites(import_sites(facts.join(changed, "path", "left_semi")))
    fresh = cut_lineage(fresh_own.unionByName(foreign.select(*fresh_own.columns)))
    gone = cut_lineage(own.select("site").unionByName(foreign.select("site")).distinct())
    direct = cut_lineage(resolve.direct_targets(fresh, facts, markers, configs))
    all_direct = before.direct.join(gone, "site", "left_anti").unionByName(direct)
    all_sites = before.sites.join(gone, "site", "left_anti").unionByName(fresh)

    # Ways through package files are a small view over their own sites; where an end differs, its askers follow.
    nodes, options = reexports.handed_on(all_sites, all_direct, facts)
    ends = cut_lineage(reexports.follow(nodes))
    columns = ["file", "symbol", "final", "circular", "sure"]
    turned = structural_difference(before.ends, ends, columns).select(*_question("handed", F.lit(""), F.col("file"), F.col("symbol"))).distinct()
    walkers = _askers(before.questions, turned, before.sites).join(gone, "site", "left_anti")
    moved = cut_lineage(before.sites.join(walkers, "site", "left_semi"))
    again = fresh.unionByName(moved.select(*fresh.columns))
    again_direct = direct.unionByName(before.direct.join(moved.select("site"), "site", "left_semi"))
    placed = resolve.with_first_symbol(again_direct)
    rows = cut_lineage(resolve.site_rows(resolve._follow_packages(placed, nodes, options, ends)))

    dropped = cut_lineage(gone.unionByName(moved.select("site")))
    minus = before.resolved.join(dropped, "site", "left_semi")
    kept = before.resolved.join(dropped, "site", "left_anti")
    changed_rows = structural_difference(minus, rows, ["source", "target", "file", "line", "symbols", "site"])
    delta = cut_lineage(changed_rows.withColumn("sign", F.when(F.col("side") == "before", -1).otherwise(1)).drop("side"))
    # Shared questions of a directory and module that lost or got a site are written anew, from all who ask them now.
    asking = cut_lineage(_asking(before.sites.join(gone, "site", "left_semi")).unionByName(_asking(fresh)).select(*ASKING).distinct())
    now = _asking(all_sites).join(asking, ASKING, "left_semi").select(*fresh.columns)
    alone = F.col("site").isNotNull()
    kept_asked = before.questions.where(alone).join(gone, "site", "left_anti").unionByName(before.questions.where(~alone).join(asking, ASKING, "left_anti").select("site", *[c for c in before.questions.columns if c != "site"]))
    asked_now = kept_asked.select(*before.questions.columns).unionByName(cut_lineage(questions(now, direct, configs), by="bucket").select(*before.questions.columns))
    after = replace(before, facts=facts, sites=all_sites, direct=all_direct, questions=asked_now, ends=ends, resolved=kept.unionByName(rows), markers=markers, configs=configs)
    return after, Change(delta, cut_lineage(again.select("site", "importer")))
