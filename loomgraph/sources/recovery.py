"""Syntax trees of Python sources with errors, in time that grows with the source.

One scan cuts the source into logical lines by a stack of brackets and by its strings, and
one pass over their indents makes statements with blocks of them.  A bracket that isn't
closed ends where a line can only be a new statement: at a keyword that no expression
holds, or at the statement's own indent; the lines up to there are part of the error, but
for a head's.  A statement is parsed as a whole; where that
fails, its head is parsed by itself and its block's statements are, so that an error costs
the logical line it is in.  What is parsed is never parsed with other text in its place.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

#: Deepest block; the language itself allows no more.
DEEPEST = 100

_TOKEN = re.compile(r"""#.*|(?P<long>\"{3}|'{3})|"(?:\\.|[^"\\\r\n])*"|'(?:\\.|[^'\\\r\n])*'|(?P<cut>["'])|[\[({]|[\])}]|\\(?=\r?\n|\r|$)""")
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: Lines that are no part of an expression.
_FRESH = re.compile(r"[ \t]*+(?:(?:async[ \t]+)?def[ \t]|class[ \t]+\w+[ \t]*[:(]|return\b|raise\b|import[ \t]|from[ \t]+[\w.]+[ \t]+import\b|(?:pass|break|continue)[ \t]*(?:#.*)?$|(?:del|global|nonlocal|assert)[ \t]|(?:try|finally)[ \t]*:)")
_CLAUSE = re.compile(r"[ \t]*+(else|elif|except|finally)\b")
_DEFINES = re.compile(r"[ \t]*+(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)")
#: What a clause needs before it to be parsed.
_BEFORE = {"else": "if 1", "elif": "if 1", "except": "try", "finally": "try"}
_FAILURES = (SyntaxError, ValueError, RecursionError, MemoryError)


class Scope(ast.stmt):
    """A definition whose head has an error but whose name can be read. It is no symbol, but holds
    those in its block; silent: names in it may be hidden by what can't be read."""

    _fields = ("body",)

    def __init__(self, name: str, body: list[ast.stmt], silent: bool):
        super().__init__()
        self.name, self.body, self.silent = name, body, silent


@dataclass
class Line:
    """A logical line: physical lines first to end (exclusive)."""

    first: int
    end: int
    indent: int
    broken: bool
    opens: bool  # it ends in a colon


@dataclass
class Statement:
    """marks: decorators. clauses: (head, block) pairs, more than one where else and the like follow."""

    marks: list[Line] = field(default_factory=list)
    clauses: list[tuple[Line, list[Statement]]] = field(default_factory=list)
    broken: bool = False


def _indent(line: str) -> int:
    blank = line[: len(line) - len(line.lstrip(" \t\f"))]
    return len(blank) if blank.count(" ") == len(blank) else len(blank.replace("\f", "").expandtabs(8))


def _bare(line: str) -> bool:
    text = line.strip()
    return not text or text[0] == "#"


class _Scanner:
    def __init__(self, lines: list[str]):
        self.lines, self.again = lines, 0
        # where a long string of either kind ends last, so that one without an end is known at once
        self.last = {q: max((k for k, line in enumerate(lines) if q in line), default=-1) for q in ('"""', "'''")}

    def _after_string(self, k: int, at: int, quote: str) -> tuple[int, int] | None:
        """(line, column) behind a long string's end, searched from a place within it."""
        while k <= self.last[quote]:
            line = self.lines[k]
            while (found := line.find(quote, at)) >= 0:
                slashes = found - len(line[at:found].rstrip("\\")) - at
                if slashes % 2 == 0:
                    return k, found + 3
                at = found + 1
            k, at = k + 1, 0
        return None

    def logical(self, first: int) -> Line:
        lines, n = self.lines, len(self.lines)
        own, stack = _indent(lines[first]), []
        first_opens = lines[first].partition("#")[0].rstrip().endswith(":")
        k, at, code_end = first, 0, 0
        while True:
            line, goes_on = lines[k], False
            while m := _TOKEN.search(line, at):
                token, at = m[0], m.end()
                if token[0] == "#":
                    line = line[: m.start()]
                    break
                if m["long"]:
                    behind = self._after_string(k, at, m["long"])
                    if behind is None:
                        return Line(first, k + 1, own, True, False)
                    if behind[0] != k:
                        k, at = behind
                        line = lines[k]
                    else:
                        at = behind[1]
                elif m["cut"]:
                    return Line(first, k + 1, own, True, False)
                elif token in "([{":
                    stack.append(token)
                elif token in ")]}":
                    if not stack or stack.pop() != _CLOSES[token]:
                        return Line(first, k + 1, own, True, line[at:].rstrip().endswith(":"))
                elif token == "\\":
                    goes_on = True
            code_end = k
            if not stack and not goes_on:
                return Line(first, k + 1, own, False, line.rstrip().endswith(":"))
            k, at = k + 1, 0
            if stack:
                while k < n and _bare(lines[k]):
                    k += 1
            if k >= n or stack and (_FRESH.match(lines[k]) or _indent(lines[k]) <= own and lines[k].lstrip()[0] not in ")]}"):
                # below what looks like a head, the lines taken in are looked at again, as often as blocks can be nested
                head = first_opens and code_end > first and self.again < DEEPEST * n
                if head:
                    self.again += code_end - first
                return Line(first, (first if head else code_end) + 1, own, True, first_opens or line.rstrip().endswith(":"))

    def all(self) -> list[Line]:
        out, k = [], 0
        while k < len(self.lines):
            if _bare(self.lines[k]):
                k += 1
                continue
            out.append(self.logical(k))
            k = out[-1].end
        return out


def blocks(lines: list[str], found: list[Line]) -> list[Statement]:
    """The statements of logical lines, by their indents."""
    root: list[Statement] = []
    levels: list[tuple[int, list[Statement]]] = [(0, root)]
    for line in found:
        while levels[-1][0] > line.indent:
            levels.pop()
        if levels[-1][0] < line.indent:
            above = levels[-1][1]
            deeper = above[-1].clauses[-1][1] if above and above[-1].clauses else above
            levels.append((line.indent, deeper))
        here = levels[-1][1]
        text = lines[line.first]
        if text.lstrip().startswith("@") and not line.opens:
            if not here or here[-1].clauses:
                here.append(Statement())
            here[-1].marks.append(line)
        elif _CLAUSE.match(text) and here and here[-1].clauses:
            here[-1].clauses.append((line, []))
        elif here and not here[-1].clauses:
            here[-1].clauses.append((line, []))
        else:
            here.append(Statement([], [(line, [])]))
    return root


class _Builder:
    def __init__(self, lines: list[str]):
        self.lines = lines

    def parsed(self, first: int, end: int, before: str = "", after: str = "") -> list[ast.stmt] | None:
        """The statements of some lines, at their places; None with an error. before and after: text
        that makes a head a statement."""
        indent = re.match(r"[ \t\f]*", self.lines[first])[0]
        head = "if 1:\n" if indent else ""
        if before:
            head += f"{indent}{before}:\n{indent} pass\n"
        text = head + "".join(self.lines[first:end])
        if after:
            text = f"{text.rstrip()}\n{indent} {after}\n"
        try:
            tree = ast.parse(text)
        except _FAILURES:
            return None
        ast.increment_lineno(tree, first - head.count("\n"))
        return tree.body[0].body if indent else tree.body

    def span(self, s: Statement) -> tuple[int, int]:
        first = (s.marks or [s.clauses[0][0]])[0].first
        at: Statement | None = s
        end = first
        while at is not None:
            end = max([end, *(x.end for x in at.marks), *(head.end for head, _ in at.clauses)])
            inner = [b for _, b in at.clauses if b]
            at = inner[-1][-1] if inner else None
        return first, end

    def flag(self, top: list[Statement]) -> None:
        """Marks statements that hold a broken line, the inner ones first."""
        order, todo = [], list(top)
        while todo:
            s = todo.pop()
            order.append(s)
            todo += [x for _, block in s.clauses for x in block]
        for s in reversed(order):
            s.broken = not s.clauses or any(x.broken for x in s.marks) or any(head.broken or any(x.broken for x in block) for head, block in s.clauses)

    def built(self, s: Statement, depth: int = 0) -> list[ast.stmt]:
        """A statement's tree, or what can be had of it."""
        first, end = self.span(s)
        if not s.broken and (whole := self.parsed(first, end)) is not None:
            return whole
        if depth > DEEPEST:
            return []
        out: list[ast.stmt] = []
        for k, (head, block) in enumerate(s.clauses):
            body = [x for inner in block for x in self.built(inner, depth + 1)]
            node = self.headed(s.marks if k == 0 else [], head, bool(block))
            if node is None:
                defines = _DEFINES.match(self.lines[head.first])
                if defines:
                    silent = defines[1] == "def"
                    out.append(Scope(defines[2], [x for x in body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, Scope))] if silent else body, silent))
                else:
                    out += body
                continue
            if block and hasattr(node[-1], "body"):
                node[-1].body = body or [ast.Pass()]
                node[-1].end_lineno, node[-1].end_col_offset = self.span_end(head, block)
                body = []
            out += [*node, *body]
        return out

    def span_end(self, head: Line, block: list[Statement]) -> tuple[int, int]:
        end = max(head.end, self.span(block[-1])[1])
        return end, len(self.lines[end - 1].rstrip("\r\n").encode())

    def headed(self, marks: list[Line], head: Line, opens: bool) -> list[ast.stmt] | None:
        """The head as a statement by itself, with its decorators if these are sound."""
        if head.broken:
            return None
        after = "pass" if head.opens else ""
        clause = _CLAUSE.match(self.lines[head.first])
        if clause:
            got = self.parsed(head.first, head.end, _BEFORE[clause[1]], after)
            if got is None:
                return None
            # what the clause itself says: a condition, or the type of an exception
            node = got[-1]
            own = node.orelse if isinstance(node, ast.If) and clause[1] == "elif" else [ast.Expr(h.type) for h in getattr(node, "handlers", []) if h.type is not None]
            return own or [ast.Pass()]
        if marks and (got := self.parsed(marks[0].first, head.end, after=after)) is not None:
            return got
        return self.parsed(head.first, head.end, after=after)


def recovered(lines: list[str]) -> ast.Module:
    """The tree of lines (with their ends) that don't parse as a whole."""
    top = blocks(lines, _Scanner(lines).all())
    builder = _Builder(lines)
    builder.flag(top)
    return ast.Module([node for s in top for node in builder.built(s)], [])
