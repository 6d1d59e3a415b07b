"""Facts of JavaScript and TypeScript files, read token by token.

A scanner tells code from strings, templates, comments, regular expressions and JSX
text; imports, exports and definitions are then short runs of tokens. A bracket that
does not match changes nothing: no file loses its facts for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

# ---------------------------------------------------------------------------
# Words of the language that matter here.
NOT_SYMBOLS = frozenset({"as", "export", "from", "import", "type"})
NOT_METHODS = frozenset({"catch", "for", "function", "if", "return", "switch", "while", "with"})
BEFORE_EXPRESSION = frozenset({
    "await", "case", "default", "delete", "do", "else", "export", "extends", "in", "instanceof", "new", "of",
    "return", "throw", "typeof", "void", "yield",
})
MODIFIERS = frozenset({"abstract", "async", "declare", "default"})
DECLARED = frozenset({"class", "enum", "function", "interface", "type"})
CONDITIONS = frozenset({"for", "if", "while", "with"})
PUBLIC = frozenset({"class", "const", "function", "let", "var"})
# ---------------------------------------------------------------------------

_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
_PIECE = re.compile(
    rf"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>{_NAME})|(?P<number>\.?\d(?:[\w.]|(?<=[eE])[+-])*)
    |(?P<string>'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?)|(?P<sign>=>|\.\.\.|\?\.|\+\+|--|.)""",
    re.DOTALL | re.VERBOSE,
)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[\w$]*")
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.DOTALL)
_GENERIC = re.compile(rf"<\s*(?:{_NAME})\s*(?:,|extends\b)")
_BARE = re.compile(rf"<\s*(?P<name>{_NAME})\s*>\s*\(")
_STATEMENT = re.compile(r"^[ \t]*(?:import|export)\b", re.MULTILINE)
_TAG_PART = re.compile(r"""\s+|[\w$.:-]+|=|'[^']*'|"[^"]*"|/>|>|\{|/|.""", re.DOTALL)


class Token(NamedTuple):
    kind: str  # name, number, string, template, pattern, sign, text
    text: str
    line: int
    fresh: bool  # first token of its line


def _ends_value(token: Token) -> bool:
    """Whether an operand ends with this token, so that ``/`` divides and ``<`` compares (brackets apart)."""
    if token.kind == "sign":
        return token.text in {"]", "++", "--"}
    return not (token.kind == "name" and token.text in BEFORE_EXPRESSION)


def _opens_block(before: Token | None, ended: bool) -> bool:
    """Whether ``{`` after this token opens a block, not an object."""
    if before is None or before.text in {"=>", ";", "{", "}", ")"} and before.kind == "sign":
        return True
    return ended or (before.kind == "name" and before.text in {"else", "do", "try", "finally", "default"})


def _is_type_parameters(source: str, at: int) -> bool:
    """Whether ``<`` begins type parameters (of a function type or a generic arrow) and no tag.

    A bare ``<T>(…)`` is one where ``=>`` follows, which text of a tag cannot hold, or ``:``
    and nothing closes a tag of that name."""
    if _GENERIC.match(source, at):
        return True
    if not (found := _BARE.match(source, at)):
        return False
    depth, k = 0, found.end() - 1
    for k in range(found.end() - 1, len(source)):
        depth += (source[k] == "(") - (source[k] == ")")
        if not depth:
            break
    after = re.compile(r"\s*(=>|:)?").match(source, k + 1)[1]
    return after == "=>" or (after == ":" and f"</{found['name']}" not in source[at:])


def tokens(source: str, jsx: bool) -> Iterator[Token]:
    """The tokens of a file. Where a template or tag never ends it was taken for one by
    mistake (or the file is broken): reading goes on at the next line that imports or exports."""
    at, line = 0, 1
    while True:
        found, unclosed = _scan(source, at, line, jsx)
        again = _STATEMENT.search(source, unclosed[1] + 1) if unclosed else None
        if not again:
            yield from found
            return
        yield from found[: unclosed[0]]
        at, line = again.start(), source.count("\n", 0, again.start()) + 1


def _scan(source: str, at: int, line: int, jsx: bool) -> tuple[list[Token], tuple[int, int] | None]:
    """Tokens from ``at`` on, and (tokens before it, place) of the first template or tag that stays open.

    ``modes`` says what a closing brace goes back to, ``brackets`` whether a closing bracket ends an operand."""
    out: list[Token] = []
    seen_line, ended = 0, False
    modes: list[str] = []  # "{", "`" (template), "<" (inside a tag), ">" (JSX children)
    opened: list[tuple[int, int]] = []
    brackets: list[bool] = []

    def push(mode: str) -> None:
        modes.append(mode)
        opened.append((len(out), at))

    def pop() -> None:
        modes.pop()
        opened.pop()

    def made(kind: str, text: str) -> None:
        nonlocal seen_line, ended
        out.append(Token(kind, text, line, line != seen_line))
        seen_line = line + text.count("\n")
        ended = _ends_value(out[-1])

    while at < len(source):
        mode = modes[-1] if modes else "{"
        if mode == "`":
            body = _TEMPLATE.match(source, at).group()
            made("template", body)
            at += len(body)
            line += body.count("\n")
            if source.startswith("${", at):
                push("{")
                brackets.append(False)
                ended = False
                at += 2
            elif at < len(source):
                pop()
                at += 1
            continue
        if mode == ">":
            end = min((p for p in (source.find("<", at), source.find("{", at)) if p >= 0), default=len(source))
            line += source.count("\n", at, end)
            at = end
            if source.startswith("{", at):
                push("{")
                brackets.append(False)
                ended = False
                at += 1
            elif source.startswith("</", at):
                close = source.find(">", at)
                pop()
                line += source.count("\n", at, close + 1 if close >= 0 else len(source))
                at = close + 1 if close >= 0 else len(source)
                made("text", "")
            elif at < len(source):
                push("<")
                at += 1
            continue
        if mode == "<":
            part = _TAG_PART.match(source, at).group()
            at += len(part)
            line += part.count("\n")
            if part == "/>":
                pop()
                made("text", "")
            elif part == ">":
                modes[-1] = ">"
            elif part == "{":
                push("{")
                brackets.append(False)
                ended = False
            continue
        found = _PIECE.match(source, at)
        kind, text = found.lastgroup, found.group()
        if kind == "sign" and text == "/" and not ended and (pattern := _PATTERN.match(source, at)):
            kind, text = "pattern", pattern.group()
        if kind == "sign" and text == "<" and jsx and not ended and re.match(r"<[A-Za-z_$>]", source[at : at + 2]) and not _is_type_parameters(source, at):
            push("<")
            at += 1
            continue
        if kind == "sign" and text == "`":
            push("`")
            at += 1
            continue
        at += len(text)
        before, value = out[-1] if out else None, ended
        if kind == "sign" and text == "{" and modes:
            push("{")
        elif kind == "sign" and text == "}" and modes:
            pop()
            if modes and modes[-1] != "{":  # back in a template, a tag or its children
                brackets and brackets.pop()
                continue
        if kind != "skip":
            made(kind, text)
        if kind == "sign" and text == "(":
            called = len(out) > 2 and out[-3].text in {".", "?."}
            brackets.append(not (before is not None and before.kind == "name" and before.text in CONDITIONS and not called))
        elif kind == "sign" and text == "{":
            brackets.append(not _opens_block(before, value))
        elif kind == "sign" and text in (")", "}"):
            ended = brackets.pop() if brackets else text == ")"
        line += text.count("\n")
    return out, next((place for mode, place in zip(modes, opened, strict=True) if mode != "{"), None)


def _closing(code: list[Token], at: int, opened: str, closed: str) -> int:
    """Place after the bracket that closes the one at ``at`` (the end where none does)."""
    depth = 0
    for k in range(at, len(code)):
        if code[k].kind == "sign":
            depth += (code[k].text == opened) - (code[k].text == closed)
            if depth == 0 and code[k].text == closed:
                return k + 1
    return len(code)


class _Reader:
    def __init__(self, code: list[Token]) -> None:
        self.code = code
        self.imports: set[tuple] = set()
        self.definitions: set[str] = set()
        self.exports: set[str] = set()
        self.public: set[str] = set()

    def text(self, at: int) -> str:
        """Text of a name or sign; strings and the like never look like code."""
        return self.code[at].text if 0 <= at < len(self.code) and self.code[at].kind in ("name", "sign") else ""

    def is_name(self, at: int) -> bool:
        return at < len(self.code) and self.code[at].kind == "name"

    def is_string(self, at: int) -> bool:
        return at < len(self.code) and self.code[at].kind == "string"

    def add(self, at: int, line: int, symbols: set[str]) -> None:
        module = self.code[at].text[1:].rstrip(self.code[at].text[0])
        if module:
            self.imports.add((module, line, (), tuple(sorted(symbols))))

    def clause(self, at: int) -> tuple[int, set[str]] | None:
        """(place of the module, names) of ``… from "module"``; None where it is something else."""
        names: set[str] = set()
        while at < len(self.code):
            token = self.code[at]
            if token.text == "from" and token.kind == "name" and self.is_string(at + 1):
                return at + 1, names - NOT_SYMBOLS
            if self.text(at - 1) == "}" and token.text != "from":  # what was in braces is local
                return None
            if token.kind == "name" and token.text not in ("import", "export"):
                names.add(token.text)
            elif not (token.kind == "string" or token.text in {",", "{", "}", "*"}):
                return None
            at += 1
        return None

    def starts(self, at: int) -> bool:
        """Whether a statement can begin here."""
        return at == 0 or self.code[at].fresh or self.text(at - 1) in {";", "}", "{"}

    def import_at(self, at: int) -> None:
        line = self.code[at].line
        if self.text(at + 1) == "(" or not self.starts(at):
            return
        if self.is_string(at + 1):
            module = self.code[at + 1].text
            self.add(at + 1, line, set(re.findall(_NAME, module)) - NOT_SYMBOLS)
            return
        follows = self.text(at + 2)
        if self.text(at + 1) == "type" and follows not in {"from", ","} | ({""} if self.is_string(at + 2) else set()):
            return
        if found := self.clause(at + 1):
            self.add(found[0], line, found[1])

    def export_at(self, at: int) -> None:
        line, next_ = self.code[at].line, self.text(at + 1)
        if next_ in {"{", "*"}:
            if found := self.clause(at + 1):
                self.add(found[0], line, found[1])
            return
        k = at + 1
        while self.text(k) in MODIFIERS and (self.is_name(k + 1) or self.text(k + 1) == "{"):
            k += 1
        k += self.text(k) == "const" and self.text(k + 1) == "enum"
        word = self.text(k)
        name = k + 1 + (self.text(k + 1) == "*")
        if self.is_name(name) and self.code[name].text not in {"extends", "implements"}:
            if word in DECLARED:
                self.exports.add(self.code[name].text)
            if word in PUBLIC:
                self.public.add(self.code[name].text)

    def methods(self, at: int) -> None:
        """Methods of the class whose keyword is at ``at``; nested bodies are skipped, not lost."""
        body = next((k for k in range(at, len(self.code)) if self.text(k) == "{"), len(self.code))
        end, k = _closing(self.code, body, "{", "}"), body + 1
        while k < end - 1:
            if self.text(k) == "{":
                k = _closing(self.code, k, "{", "}")
                continue
            after = k + 1
            if self.is_name(k) and self.text(after) == "<":
                after = _closing(self.code, after, "<", ">")
            if self.is_name(k) and self.text(after) == "(":
                after = _closing(self.code, after, "(", ")")
                if self.text(after) == ":":
                    while after < end - 1 and self.text(after) not in {"{", ";", "="}:
                        after += 1
                if self.text(after) == "{" and self.code[k].text not in NOT_METHODS and self.text(k - 1) not in {"=", ".", "new", "@"}:
                    self.definitions.add(self.code[k].text)
                k = after
                continue
            k = _closing(self.code, k, "(", ")") if self.text(k) == "(" else k + 1

    def read(self) -> None:
        for at, token in enumerate(self.code):
            if token.kind != "name" or self.text(at - 1) in {".", "?."}:
                continue
            if token.text in ("import", "require") and self.text(at + 1) == "(" and self.is_string(at + 2):
                self.add(at + 2, token.line, set())
            elif token.text == "import":
                self.import_at(at)
            elif token.text == "export" and self.starts(at):
                self.export_at(at)
            elif token.text in ("function", "class"):
                name = at + 1 + (self.text(at + 1) == "*")
                if self.is_name(name) and self.code[name].text not in {"extends", "implements"}:
                    self.definitions.add(self.code[name].text)
                if token.text == "class" and self.text(at + 1) != ":":
                    self.methods(at)


def script_facts(content: bytes, jsx: bool = True) -> dict:
    """Definitions, exports and imports of one script; ``jsx`` where tags may occur."""
    reader = _Reader([t for t in tokens(content.decode("utf-8"), jsx) if t.kind != "text"])
    reader.read()
    return {
        "definitions": reader.definitions, "exports": reader.exports, "public_names": reader.public,
        "imports": reader.imports, "docstring": None,
    }
