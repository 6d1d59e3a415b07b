"""Which paths the ignore files among them leave out, as joins on directories.

A rule holds below the directory of its file. Every directory, and every file, meets the rule
sets of the directories above it in one join; a rule set answers with its last line that
fits, the deepest answer counts. What lies in a directory that is left out is left out with
it, whatever says otherwise further down, as nobody would look there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.functions import paths

IGNORE_FILE = ".gitignore"
DECISION = "path string, depth int, left_out boolean"


def expression(glob: str) -> str:
    """A path pattern of an ignore file, without its marks, as a regular expression."""
    out, at = "", 0
    while at < len(glob):
        sign = glob[at]
        if sign == "*":
            stars = len(glob) - at - len(glob[at:].lstrip("*"))
            whole = stars == 2 and (at == 0 or glob[at - 1] == "/")
            at += stars
            if whole and glob.startswith("/", at):  # any directories, or none
                out, at = out + "(?:[^/]+/)*", at + 1
            elif whole and at == len(glob):  # all that is inside
                out += ".+"
            else:
                out += "[^/]*"
            continue
        close = glob.find("]", at + 2) if sign == "[" else -1
        if close > 0:
            inside = glob[at + 1 : close]
            negated = inside[0] in "!^"
            inside = re.sub(r"[\\\[\]^&~|]", lambda m: "\\" + m[0], inside[negated:])
            out += f"(?!/)[{'^' * negated}{inside}]"
            at = close + 1
            continue
        if sign == "\\" and at + 1 < len(glob):
            at += 1
            sign = glob[at]
        out += "[^/]" if sign == "?" else re.escape(sign)
        at += 1
    return out


def rule(line: str) -> tuple[str, bool, bool] | None:
    """(expression over paths below the file's directory, leaves out, directories only) of one line."""
    text = re.sub(r"(?<!\\)[ \t\r]+$", "", line.rstrip("\n"))
    if not text or text[0] == "#":
        return None
    leaves_out = text[0] != "!"
    text = text if leaves_out else text[1:]
    only_directories = text.endswith("/")
    body = text.rstrip("/") if only_directories else text
    if not body:
        return None
    anywhere = "/" not in body
    return ("(?:.*/)?" if anywhere else "") + expression(body.lstrip("/")), leaves_out, only_directories


@lru_cache(maxsize=4096)
def _compiled(lines: str) -> list[tuple[re.Pattern, bool, bool]]:
    """The rules of one file, last line first; each file is compiled once in a worker."""
    found = [r for r in map(rule, lines.split("\n")) if r]
    return [(re.compile(e, re.DOTALL), leaves_out, only) for e, leaves_out, only in reversed(found)]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, is_directory, base, lines) → what the rule set of ``base`` says, if anything."""
    for batch in batches:
        out = []
        for path, is_directory, base, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            inner = path[len(base) + 1 :] if base else path
            for pattern, leaves_out, only_directories in _compiled(lines):
                if (is_directory or not only_directories) and pattern.fullmatch(inner):
                    out.append((path, base.count("/") + 1 if base else 0, leaves_out))
                    break
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.bool_()), strict=True)], names=["path", "depth", "left_out"])


def _left_out(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """``path`` of the entries (path, is_directory) whose deepest answer leaves them out."""
    asked = entries.select("path", "is_directory", F.explode(paths.ancestor_directories(paths.parent(F.col("path")))).alias("base"))
    answers = asked.join(rules, "base").select("path", "is_directory", "base", "lines").mapInArrow(_decide, DECISION)
    deepest = answers.groupBy("path").agg(F.max_by("left_out", "depth").alias("left_out"))
    return deepest.where("left_out").select("path")


def rule_sets(files: DataFrame) -> DataFrame:
    """(base, lines) of the ignore files among ``files(path, content)``."""
    return files.where(paths.basename(F.col("path")) == IGNORE_FILE).select(
        paths.parent(F.col("path")).alias("base"), F.decode("content", "UTF-8").alias("lines")
    )


def kept_paths(listing: DataFrame, rules: DataFrame, pruned: tuple[str, ...] = ()) -> DataFrame:
    """``listing(path)`` without what ``rules(base, lines)`` leave out, with ``by_name``: left out
    by a rule for the file itself, not for a directory above it (such files are dropped
    too unless the caller wants them).

    ``pruned``: names of directories that are always left out."""
    inside = F.filter(paths.ancestor_directories(paths.parent(F.col("path"))), lambda d: d != "")
    below = listing.select("path", inside.alias("_above"))
    if pruned:
        below = below.where(~F.exists("_above", lambda d: F.substring_index(d, "/", -1).isin(*pruned)))
    directories = below.select(F.explode("_above").alias("path")).distinct()
    shut = _left_out(directories.withColumn("is_directory", F.lit(True)), rules).select(F.col("path").alias("_shut"))
    gone = below.select("path", F.explode("_above").alias("_shut")).join(shut, "_shut", "left_semi").select("path").distinct()
    open_ = below.select("path").join(gone, "path", "left_anti")
    named = _left_out(open_.withColumn("is_directory", F.lit(False)), rules).withColumn("by_name", F.lit(True))
    return open_.join(named, "path", "left").select("path", F.coalesce("by_name", F.lit(False)).alias("by_name"))
