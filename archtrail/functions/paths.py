"""Path expressions over repository-relative POSIX paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# File classes and directory names with a set meaning.
LANGUAGE_BY_SUFFIX = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
}
FIXTURE_DIRECTORIES = ("fixtures", "testdata")
GENERATED_DIRECTORIES = ("generated", "__generated__")
TEST_DIRECTORIES = ("tests",)
TEST_FILE_ENDING = r"\.test\.(ts|tsx|js|jsx)$"
GENERIC_DIRECTORIES = (".", "app", "apps", "lib", "libs", "pkg", "packages", "source", "src")
ENTRY_STEMS = ("__init__", "index")
# ---------------------------------------------------------------------------


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last dotted part of the file name with its dot; a leading dot is no suffix."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def parent_parts(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parent(path: Column) -> Column:
    """Directory of a path, empty at the root."""
    return F.array_join(parent_parts(path), "/")


def directory(path: Column) -> Column:
    """The same without an array, for the many rows of sites and files."""
    return F.left(path, F.length(path) - F.length(basename(path)) - 1)


def language(path: Column) -> Column:
    lowered = F.lower(suffix(path))
    result = F.lit(None).cast("string")
    for ending, name in LANGUAGE_BY_SUFFIX.items():
        result = F.when(lowered == ending, F.lit(name)).otherwise(result)
    return result


def role(
    path: Column, generated: Sequence[str] = (), vendored: Sequence[str] = ()
) -> Column:
    """Provenance class of a file. ``generated`` and ``vendored`` are regular
    expressions compiled from configured path patterns; they win over the
    conventions, which look at whole directory names before the file name."""
    directories = parent_parts(path)
    name = basename(path)
    chain = F.when(F.lit(False), F.lit("source"))
    for pattern in generated:
        chain = chain.when(path.rlike(pattern), F.lit("generated"))
    for pattern in vendored:
        chain = chain.when(path.rlike(pattern), F.lit("vendored"))
    return (
        chain.when(F.arrays_overlap(directories, _strings(FIXTURE_DIRECTORIES)), F.lit("fixture"))
        .when(F.arrays_overlap(directories, _strings(GENERATED_DIRECTORIES)), F.lit("generated"))
        .when(F.arrays_overlap(directories, _strings(TEST_DIRECTORIES)), F.lit("test"))
        .when(name.startswith("test_") & name.endswith(".py"), F.lit("test"))
        .when(name.rlike(TEST_FILE_ENDING), F.lit("test"))
        .otherwise(F.lit("source"))
    )


def module_anchor(path: Column) -> Column:
    """First two directories; ``.`` at the root."""
    anchor = F.array_join(F.slice(parent_parts(path), 1, 2), "/")
    return F.when(anchor == "", F.lit(".")).otherwise(anchor)


def component_anchor(path: Column) -> Column:
    """First directory; ``.`` at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def common_prefix(left: Column, right: Column) -> Column:
    """Leading elements two arrays share.

    For a whole group it is enough to compare the smallest and the largest
    array, because arrays order element by element: ``common_prefix(min, max)``.
    That keeps a group's common directory a plain two-value aggregate."""
    shared = F.least(F.size(left), F.size(right))
    matching = F.filter(
        F.sequence(F.lit(0), shared),
        lambda n: F.slice(left, F.lit(1), n) == F.slice(right, F.lit(1), n),
    )
    return F.slice(left, F.lit(1), F.array_max(matching))


def common_directory(path: Column) -> Column:
    """Aggregate: deepest directory that holds every path; ``.`` when none does."""
    low = F.min(parent_parts(path))
    high = F.max(parent_parts(path))
    joined = F.array_join(common_prefix(low, high), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def ancestor_directories(directory: Column) -> Column:
    """Every directory from the root (empty string) down to ``directory``."""
    parts = F.filter(F.split(directory, "/"), lambda part: part != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def depth(directory: Column) -> Column:
    """Number of segments; the root has none."""
    return F.size(F.filter(F.split(directory, "/"), lambda part: part != ""))


def normalize(path: Column) -> Column:
    """Resolve ``.`` and ``..`` lexically. Steps above the start stay visible as
    ``..``, so such a path matches no repository file."""

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        can_pop = (F.size(done) > 0) & (last != "..")
        popped = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when(part.isin("", "."), done)
            .when((part == "..") & can_pop, popped)
            .otherwise(F.concat(done, F.array(part)))
        )

    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def event_path(path: Column, root: str) -> Column:
    """Path of an activity record relative to the repository root when it lies
    inside it, absolute otherwise, empty when there is none."""
    base = root.rstrip("/")
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path))
    absolute = F.concat(F.lit("/"), normalize(joined))
    inside = absolute.startswith(base + "/")
    relative = F.substring(absolute, len(base) + 2, 1 << 30)
    return (
        F.when(F.coalesce(path, F.lit("")) == "", F.lit(""))
        .when(inside, relative)
        .when(absolute == (base or "/"), F.lit("."))
        .otherwise(absolute)
    )


def meaningful_segment(directory: Column) -> Column:
    """Deepest directory name that says something; null when all are generic."""
    telling = F.filter(
        F.split(directory, "/"),
        lambda part: (part != "") & ~F.lower(part).isin(*GENERIC_DIRECTORIES),
    )
    return F.try_element_at(telling, F.lit(-1))
