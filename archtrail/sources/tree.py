"""Source trees as DataFrames.

Spark's own file listing hides names starting with ``_`` or ``.``, and package
files are called ``__init__.py``. So paths are enumerated first and contents are
read by the tasks; with a tree on shared storage every executor reads its part.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archtrail.functions import paths
from archtrail.operators import ignore

# ---------------------------------------------------------------------------
# Directories never entered (the first is our own output), files
# that mark a package.
PRUNED_DIRECTORIES = frozenset(
    {
        ".archtrail",
        ".git",
        ".hg",
        ".mypy_cache",
        ".pytest_cache",
        ".svn",
        ".venv",
        "__pycache__",
        "build",
        "dist",
        "node_modules",
        "venv",
    }
)
PACKAGING_MARKERS = ("pyproject.toml", "setup.cfg", "setup.py")
README_NAMES = ("README.md", "README.rst", "README.txt")
CONFIG_NAME = "tsconfig.json"
# ---------------------------------------------------------------------------


def path_pattern(line: str) -> str:
    """A configured path pattern as an expression for ``rlike``: it matches files
    and everything below a matching directory."""
    parsed = ignore.rule(line)
    if parsed is None:
        raise ValueError(f"invalid path pattern: {line!r}")
    below = "/.+" if parsed[2] else "(?:/.+)?"
    return "^" + parsed[0] + below + "$"


def walk(root: str | Path) -> Iterator[str]:
    """Relative paths of all files below ``root`` outside of pruned directories."""
    base = str(Path(root).resolve())
    for folder, inner, names in os.walk(base):
        inner[:] = sorted(set(inner) - PRUNED_DIRECTORIES)
        yield from (os.path.relpath(os.path.join(folder, name), base).replace(os.sep, "/") for name in sorted(names))


def kinds_of(listing: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, path) of the source files, readmes, markers and configs among ``listing(path)``.

    All of a directory that the ignore ``rules`` leave out is gone; a rule for a file itself
    counts for source files."""
    left = ignore.kept_paths(listing, rules, tuple(sorted(PRUNED_DIRECTORIES)))
    name = paths.basename(F.col("path"))
    source = paths.language(F.col("path")).isNotNull() & ~F.col("by_name")
    kinds = F.array(
        F.when(source, "source"), F.when(name.isin(*PACKAGING_MARKERS), "marker"),
        F.when(name.isin(*README_NAMES), "readme"), F.when(name == CONFIG_NAME, "config"),
    )
    return left.select(F.explode(F.array_compact(kinds)).alias("kind"), "path")


def list_tree(spark: SparkSession, root: str | Path) -> DataFrame:
    """kind, path for everything in the tree that matters to the analysis."""
    listing = spark.createDataFrame([(p,) for p in walk(root)], "path string")
    rules = ignore.rule_sets(read_contents(listing.where(paths.basename(F.col("path")) == ignore.IGNORE_FILE), root))
    own = Path(root) / ".git" / "info" / "exclude"
    if own.is_file():  # holds like a file at the top whose lines come first
        top = spark.createDataFrame([("", own.read_text(), 0)], "base string, lines string, place int")
        rules = top.unionByName(rules.withColumn("place", F.lit(1))).groupBy("base").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "lines"))), lambda r: r.lines), "\n").alias("lines")
        )
    return kinds_of(listing, rules)


def read_contents(listing: DataFrame, root: str | Path) -> DataFrame:
    """path, content (binary) of listed files, read inside the tasks."""
    base = str(Path(root).resolve())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = [Path(base, path).read_bytes() for path in batch["path"]]
            yield pd.DataFrame({"path": batch["path"], "content": contents})

    return listing.select("path").mapInPandas(read, "path string, content binary")


def relaxed_json(text: str) -> dict:
    """JSON with comments, trailing commas and single quotes, as config files use."""
    token = r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//[^\n]*|/\*.*?\*/'

    def clean(found: re.Match) -> str:
        part = found.group()
        if part.startswith("/"):
            return " "
        return json.dumps(part[1:-1].replace("\\'", "'")) if part[0] == "'" else part

    plain = re.sub(token, clean, text, flags=re.DOTALL)
    plain = re.sub(r",(\s*[}\]])", r"\1", plain)
    plain = re.sub(r"([{,]\s*)([A-Za-z_$][\w$]*)(\s*:)", r'\1"\2"\3', plain)
    return json.loads(plain)


def parse_configs(contents: DataFrame) -> DataFrame:
    """Script path configuration: directory, base, pattern, target, ordinal. One
    row per alias target and one with a null pattern per file; files that cannot
    be read are left out."""
    from archtrail.operators.resolve import CONFIG_TYPE

    def rows_of(path: str, content: bytes) -> list[tuple]:
        try:
            options = relaxed_json(bytes(content).decode("utf-8")).get("compilerOptions", {})
        except (ValueError, AttributeError):
            return []
        directory = path.rpartition("/")[0]
        base = os.path.normpath(os.path.join(directory, options.get("baseUrl", ".")))
        base = "" if base == "." else base
        rows = [(directory, base, None, None, 0)]
        for pattern, targets in options.get("paths", {}).items():
            listed = targets if isinstance(targets, list) else [targets]
            rows += [(directory, base, pattern, target, at) for at, target in enumerate(listed)]
        return rows

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for pair in zip(batch["path"], batch["content"]) for row in rows_of(*pair)]
            yield pd.DataFrame(rows, columns=["directory", "base", "pattern", "target", "ordinal"])

    return contents.mapInPandas(parse, CONFIG_TYPE)
