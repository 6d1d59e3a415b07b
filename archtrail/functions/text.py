"""String expressions: line counts, labels, slugs, stable ids, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Results must agree with these patterns and limits.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
TEST_COMMAND = (
    r"(?i)(^|[;&|]\s*|\s)"
    r"(pytest|vitest|jest|mocha|tox|nox|cargo\s+test|go\s+test|"
    r"npm\s+(run\s+)?test|pnpm\s+(run\s+)?test|yarn\s+test|make\s+test)"
    r"(\s|$)"
)
REDACTIONS = (
    (r"(?i)(authorization\s*:\s*\S+\s+)\S+", "$1[REDACTED]"),
    (
        r"(?i)\b([A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD)[A-Z0-9_]*\s*=\s*)"
        r"(\"[^\"]*\"|'[^']*'|\S+)",
        "$1[REDACTED]",
    ),
    (
        r"(?i)(--?(?:password|passwd|token|api-?key|secret)(?:[=\s]))"
        r"(\"[^\"]*\"|'[^']*'|\S+)",
        "$1[REDACTED]",
    ),
    (r"://([^/\s:@]+):([^@/\s]+)@", "://$1:[REDACTED]@"),
)
SUPPORTED_TOOLS = ("Bash", "Edit", "Grep", "Read", "Write")
UNKNOWN_SESSION = "unknown-session"
SUMMARY_LIMIT = 240
SLUG_LIMIT = 40
DIGEST_LENGTH = 10
# ---------------------------------------------------------------------------


def line_count(text: Column) -> Column:
    """Lines as Python's ``splitlines`` counts them: every line break ends one
    line, and text after the last break is one more."""
    unterminated = (F.length(text) > 0) & ~text.rlike(f"(?:{LINE_BREAK})\\z")
    return (F.regexp_count(text, F.lit(LINE_BREAK)) + F.when(unterminated, 1).otherwise(0)).cast(
        "bigint"
    )


def title_label(value: Column) -> Column:
    """Human label: words of at most two characters in capitals, others with each
    run of letters capitalised (a digit starts a new run, as ``str.title`` does)."""

    def one_word(word: Column) -> Column:
        runs = F.regexp_extract_all(word, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))
        capitalised = F.array_join(F.transform(runs, F.initcap), "")
        return F.when(F.length(word) <= 2, F.upper(word)).otherwise(capitalised)

    words = F.filter(F.split(value, "[^A-Za-z0-9]+"), lambda word: F.length(word) > 0)
    return F.array_join(F.transform(words, one_word), " ")


def slug(value: Column, fallback: str) -> Column:
    """Lower-case, every other run of characters as one dash, cut to the limit."""
    dashed = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")
    cut = F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(SLUG_LIMIT))
    return F.when(F.length(cut) > 0, cut).otherwise(F.lit(fallback))


def stable_id(prefix: str, slug_source: Column, digest_source: Column) -> Column:
    """``prefix:slug-digest`` where the digest is a shortened SHA-256."""
    digest = F.left(F.sha2(digest_source, 256), F.lit(DIGEST_LENGTH))
    return F.concat(F.lit(f"{prefix}:"), slug(slug_source, prefix), F.lit("-"), digest)


def redact(text: Column) -> Column:
    """Replace credentials in a command, four substitutions in fixed order."""
    for pattern, replacement in REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def classify_tool(tool_name: Column, command: Column) -> Column:
    """The recorded tool; a shell call that runs tests becomes ``Test`` and a
    tool outside the supported five becomes null."""
    runs_tests = (tool_name == "Bash") & F.coalesce(command, F.lit("")).rlike(TEST_COMMAND)
    return F.when(runs_tests, F.lit("Test")).when(tool_name.isin(*SUPPORTED_TOOLS), tool_name)


def safe_session_id(value: Column) -> Column:
    cleaned = F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-")
    trimmed = F.regexp_replace(cleaned, r"^[.\-]+|[.\-]+$", "")
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(F.lit(UNKNOWN_SESSION))


def thousands(value: Column) -> Column:
    """Integer with comma separators."""
    return F.format_number(value, 0)


def overflow_label(first: Column, total: Column, shown: int = 5) -> Column:
    """``a, b, c, d, e (+N more)``; null when there is nothing to show.

    ``first`` holds the sorted leading names (at most ``shown`` of them)."""
    joined = F.array_join(first, ", ")
    more = F.concat(joined, F.lit(" (+"), (total - shown).cast("string"), F.lit(" more)"))
    return F.when(total > shown, more).when(total > 0, joined)


def audit_label(warnings: Column, notices: Column) -> Column:
    def counted(number: Column, noun: str) -> Column:
        ending = F.when(number == 1, F.lit(f" {noun}")).otherwise(F.lit(f" {noun}s"))
        return F.concat(number.cast("string"), ending)

    return F.when((warnings == 0) & (notices == 0), F.lit("Map audit clear")).otherwise(
        F.concat(counted(warnings, "warning"), F.lit(" · "), counted(notices, "notice"))
    )


def source_url(root: Column, file: Column, line: Column) -> Column:
    """Editor link for a file, with the line appended when there is one."""
    absolute = F.when(file.startswith("/"), file).otherwise(
        F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), F.regexp_replace(file, "^/+", ""))
    )
    escaped = F.regexp_replace(F.replace(F.url_encode(absolute), F.lit("%2F"), F.lit("/")), r"\+", "%20")
    suffix = F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(F.lit(":"), line.cast("string")))
    return F.concat(F.lit("vscode://file/"), escaped, F.coalesce(suffix, F.lit("")))


def mermaid_id(node_id: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(node_id, "[^a-zA-Z0-9_]", "_"))


def mermaid_label(label: Column) -> Column:
    return F.translate(label, '"\n', "' ")
