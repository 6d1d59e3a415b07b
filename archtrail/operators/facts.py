"""Facts of source files: definitions, imports, exports, line counts, prose.

Parsing is the one step that needs Python. It runs per file inside
``mapInArrow``; everything after it is relational.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.functions import paths
from archtrail.operators.script import script_facts

IMPORT_TYPE = "array<struct<module:string,line:bigint,fallbacks:array<string>,symbols:array<string>>>"
FACT_TYPE = (
    "path string, definitions array<string>, exports array<string>, "
    f"public_names array<string>, imports {IMPORT_TYPE}, docstring string, loc bigint, error string, digest string"
)
_NAMES = pa.list_(pa.string())
_IMPORTS = pa.list_(pa.struct([("module", pa.string()), ("line", pa.int64()), ("fallbacks", _NAMES), ("symbols", _NAMES)]))
FACT_SCHEMA = pa.schema([
    ("path", pa.string()), ("definitions", _NAMES), ("exports", _NAMES), ("public_names", _NAMES), ("imports", _IMPORTS),
    ("docstring", pa.string()), ("loc", pa.int64()), ("error", pa.string()), ("digest", pa.string()),
])

_DEFINITION = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _python_import(node: ast.AST) -> Iterator[tuple]:
    if isinstance(node, ast.Import):
        for name in node.names:
            yield name.name, node.lineno, (), (name.asname or name.name.split(".")[-1],)
    elif isinstance(node, ast.ImportFrom):
        package = "." * node.level + (node.module or "")
        for name in node.names:
            if name.name == "*":
                yield package, node.lineno, (), ("*",)
            else:
                inner = package + name.name if package.endswith(".") else f"{package}.{name.name}"
                yield inner, node.lineno, (package,) if package else (), (name.name,)


def _statements(tree: ast.AST) -> Iterator[ast.AST]:
    """All statements of a file, however deep; expressions, which hold none, are not entered."""
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        for name in ("body", "orelse", "finalbody", "handlers", "cases"):
            inner = getattr(node, name, None)
            if inner:
                waiting.extend(inner)
                yield from inner


def python_facts(content: bytes) -> dict:
    tree = ast.parse(content)
    top = [statement.name for statement in tree.body if isinstance(statement, _DEFINITION)]
    assigned = [
        target.id
        for statement in tree.body
        if isinstance(statement, (ast.Assign, ast.AnnAssign))
        for target in getattr(statement, "targets", None) or [statement.target]
        if isinstance(target, ast.Name)
    ]
    nodes = list(_statements(tree))
    docstring = ast.get_docstring(tree)
    return {
        "definitions": {node.name for node in nodes if isinstance(node, _DEFINITION)},
        "exports": {*top, *assigned},
        "public_names": set(top),
        "imports": {fact for node in nodes for fact in _python_import(node)},
        "docstring": docstring.splitlines()[0].strip() if docstring else None,
    }


def _facts_of(path: str, content: bytes) -> tuple:
    """Facts of one file in the order of ``FACT_SCHEMA``, without the path; a file that
    cannot be parsed keeps its place without any."""
    try:
        found = python_facts(content) if path.lower().endswith(".py") else script_facts(content, jsx=not path.lower().endswith(".ts"))
        error = None
    except (SyntaxError, ValueError, RecursionError) as problem:
        found, error = {}, str(problem) or type(problem).__name__
    ordered = sorted(found.get("imports", ()), key=lambda fact: (fact[1], fact[0], fact[2], fact[3]))
    return (
        sorted(found.get("definitions", ())),
        sorted(found.get("exports", ())),
        sorted(found.get("public_names", ())),
        ordered,
        found.get("docstring"),
        len(content.decode("utf-8", errors="replace").splitlines()),
        error,
        hashlib.sha256(content).hexdigest(),
    )


def _lists(values: list, inner: pa.DataType) -> pa.Array:
    """Lists as one flat column and the places where each begins."""
    begins = list(accumulate(map(len, values), initial=0))
    flat = pa.array([item for value in values for item in value], inner)
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), flat)


def _import_lists(values: list) -> pa.Array:
    """Facts are tuples (module, line, fallbacks, symbols)."""
    begins = list(accumulate(map(len, values), initial=0))
    modules, lines, fallbacks, symbols = zip(*(fact for value in values for fact in value)) if begins[-1] else ((), (), (), ())
    names = pa.string()
    flat = pa.StructArray.from_arrays(
        [pa.array(modules, names), pa.array(lines, pa.int64()), _lists(fallbacks, names), _lists(symbols, names)], fields=list(_IMPORTS.value_type)
    )
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), flat)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.string()
    for batch in batches:
        if not batch.num_rows:
            continue
        found = zip(*map(_facts_of, batch["path"].to_pylist(), batch["content"].to_pylist()))
        definitions, exports, public, imports, docstring, loc, error, digest = found
        yield pa.RecordBatch.from_arrays([
            batch["path"].cast(names), _lists(definitions, names), _lists(exports, names), _lists(public, names), _import_lists(imports),
            pa.array(docstring, names), pa.array(loc, pa.int64()), pa.array(error, names), pa.array(digest, names),
        ], schema=FACT_SCHEMA)


def extract(files: DataFrame) -> DataFrame:
    """Facts per file from ``files(path, content)``; content is binary. A file is
    read and parsed once; lines are counted in the same pass, and ``digest`` is of the
    very bytes that were parsed.

    Files are dealt by path first: small sources compress so well that splits by bytes
    leave most cores without work."""
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    parsed = files.select("path", "content").repartition(tasks, "path").mapInArrow(_parse, FACT_TYPE)
    return parsed.withColumn("language", paths.language(F.col("path")))


def import_sites(facts: DataFrame) -> DataFrame:
    """One row per import: importer, language, module, line, fallbacks, symbols."""
    return facts.select(F.col("path").alias("importer"), "language", F.inline("imports"))
