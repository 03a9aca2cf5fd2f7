"""Facts of Python sources: one pass of the parser over each file, rows out; names are resolved later, by joins.

Every row has the same columns, so that one scan feeds all tables.  ``kind`` says what a row is:

module    name
class     name, extra (bases), flag (abstract), detail (``protocol``)
function  owner (module), name, detail (class), extra (decorators), flag (async)
param     owner (function), name, detail (annotation), ordinal
import    owner (module), name (local), detail (what it names)
attr      owner (class), name, detail (type as written), ordinal
local     owner (function), name, detail (type as written), ordinal
call      owner (function), name (root), extra (attribute chain), detail (label: cut source), frames, flag (in a loop), args
fork      owner (function), name (kind), detail (selector), extra (names read), flag (paths meet again)
arm       owner (function), name (label), detail (terminal), extra (fork line and column), ordinal
route     owner (function), name (method), detail (path), extra (router)
const     owner (module), name, detail (string)
table     owner (module), name, detail (dotted value), extra (key), ordinal: entries of a dict of constants to names
lookup    owner (function), name (table), detail (key as written), ordinal (column): a call of what a table holds
argref    as call, of which it is an argument, but name and extra are those of the argument, a dotted name
pattern   owner (module), name (route), detail (view, class or include), extra (dotted name), ordinal: a url pattern

``args`` is what the whole tree of a call says of its arguments: where the call ends, the dotted name and the string given first,
the first string, the first string with those put together or wrapped by calls (an SQL statement), and the keyword ``prefix``.
``frames`` is the stack of control around a call: kind, site (``owner:line``) and arm.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from forkline.session import ship

FACTS = (
    "repo string, path string, kind string, ordinal int, owner string, name string, detail string, line int, end_line int, extra array<string>, "
    "frames array<struct<kind:string,site:string,arm:int>>, flag boolean, "
    "args struct<end_line:int,end_column:int,name:string,first:string,literal:string,statement:string,prefix:string>"
)
_FRAMES = pa.list_(pa.struct([("kind", pa.string()), ("site", pa.string()), ("arm", pa.int32())]))
_ARGS = pa.struct([("end_line", pa.int32()), ("end_column", pa.int32()), *((c, pa.string()) for c in ("name", "first", "literal", "statement", "prefix"))])
_TYPES = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), _FRAMES, pa.bool_(), _ARGS)
_NAMES = [c.split()[0] for c in FACTS.split(", ")]
VERBS = ("get", "post", "put", "patch", "delete")
# Functions that make a url pattern.
URL_CALLS = ("path", "re_path", "url")
Def = ast.FunctionDef | ast.AsyncFunctionDef


#: Fixed value: what stands for an expression that is nested too deeply to be written out.
UNPARSEABLE = "<unparseable>"


def source_of(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except RecursionError:
        return UNPARSEABLE


def dotted(node: ast.expr | None) -> list[str] | None:
    """Root name and attributes of a plain dotted expression."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return [node.id, *reversed(parts)] if isinstance(node, ast.Name) else None


def type_text(node: ast.expr | None) -> str | None:
    """Dotted name of an annotation or constructor, without subscripts and ``| None``."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value.split("[")[0].strip()
    if isinstance(node, ast.BinOp):
        return type_text(node.left) if not (isinstance(node.left, ast.Constant) and node.left.value is None) else type_text(node.right)
    if isinstance(node, ast.Subscript):
        inner = dotted(node.value)
        return type_text(node.slice) if inner and inner[-1] == "Optional" else (".".join(inner) if inner else None)
    parts = dotted(node)
    return ".".join(parts) if parts else None


def string(node: ast.expr) -> str | None:
    """Text of a string or f-string, its expressions in braces; None for anything else."""
    if isinstance(node, ast.JoinedStr):
        return "".join(v.value if isinstance(v, ast.Constant) else f"{{{source_of(v.value)}}}" for v in node.values)
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def statement_text(node: ast.expr) -> str | None:
    """As ``string``, also through ``+`` and ``%`` and the arguments of a call around it."""
    if isinstance(node, ast.BinOp):
        sides = [statement_text(node.left), statement_text(node.right)]
        return None if sides == [None, None] else "".join("{}" if s is None else s for s in sides)
    if isinstance(node, ast.Call):
        return next((s for a in node.args if (s := statement_text(a)) is not None), None)
    return string(node)


def arguments(node: ast.Call) -> dict:
    given = [a.args[0] for a in ast.walk(node) if isinstance(a, ast.Call) and a.args and string(a.args[0]) is not None]
    literal = min(given, key=lambda a: (a.lineno, a.col_offset), default=None)
    prefix = next((k.value for k in node.keywords if k.arg == "prefix"), None)
    return {
        "end_line": node.end_lineno, "end_column": node.end_col_offset,
        "name": ".".join(dotted(node.args[0]) or []) if node.args else "", "first": string(node.args[0]) if node.args else None,
        "literal": string(literal) if literal is not None else None,
        "statement": next((s for a in [*node.args, *(k.value for k in node.keywords)] if (s := statement_text(a)) is not None), None),
        "prefix": prefix.value if isinstance(prefix, ast.Constant) and isinstance(prefix.value, str) else None,
    }


def terminal(body: list[ast.stmt]) -> str:
    """How a block ends: returns, raises, continues or falls_through."""
    last = body[-1] if body else None
    if isinstance(last, ast.Return):
        return "returns"
    if isinstance(last, ast.Raise):
        return "raises"
    if isinstance(last, (ast.Continue, ast.Break)):
        return "continues"
    if isinstance(last, (ast.With, ast.AsyncWith)):
        return terminal(last.body)
    if isinstance(last, ast.If) and last.orelse and terminal(last.body) == terminal(last.orelse):
        return terminal(last.body)
    return "falls_through"


class FileFacts:
    """Rows of one file."""

    def __init__(self, repo: str, path: str, content: str | None) -> None:
        self.repo, self.path, self.rows = repo, path, []
        self.flattened: set[ast.If] = set()  # ``elif``: arms of the ``if`` above
        self.module = path.removesuffix(".py").replace("/", ".")
        try:
            if content is None:
                raise ValueError("no content")
            self.read(content)
        except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last two: nesting too deep for the parser or for us
            self.rows.clear()
            self.add("unparsed", name=self.module)

    def read(self, content: str) -> None:
        tree = ast.parse(content)
        self.add("module", name=self.module)
        for node in ast.walk(tree):
            self.imported(node)
        rest = []
        for node in tree.body:
            if isinstance(node, Def):
                self.function(node, None)
            elif isinstance(node, ast.ClassDef):
                self.class_(node)
            elif not isinstance(node, (ast.Import, ast.ImportFrom)):
                rest.append(node)
                self.module_level(node)
                if isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
                    for t in node.targets:
                        if isinstance(t, ast.Name):
                            self.add("const", owner=self.module, name=t.id, detail=node.value.value, line=node.lineno)
        owner = f"{self.module}.<module>"
        self.add("function", owner=self.module, name=owner, line=1, end_line=len(content.splitlines()) or 1, extra=[])
        self.block(rest, owner, (), False)

    def add(self, kind: str, ordinal: int = 0, owner: str = "", name: str = "", detail: str | None = None, line: int = 0, end_line: int = 0, extra: list[str] | None = None, frames: tuple = (), flag: bool = False, args: dict | None = None) -> None:
        self.rows.append((self.repo, self.path, kind, ordinal, owner, name, detail or "", line, end_line or line, extra or [], [dict(zip(("kind", "site", "arm"), f)) for f in frames], flag, args))

    def module_level(self, node: ast.stmt) -> None:
        """Tables of names and url patterns."""
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AnnAssign, ast.AugAssign)) else []
        value = node.value if targets else None
        for name in (t.id for t in targets if isinstance(t, ast.Name)):
            if isinstance(value, ast.Dict) and value.keys and all(isinstance(k, ast.Constant) for k in value.keys) and all(map(dotted, value.values)):
                for k, (key, to) in enumerate(zip(value.keys, value.values)):
                    self.add("table", k, self.module, name, ".".join(dotted(to)), key.lineno, extra=[str(key.value)])
            if name == "urlpatterns" and value is not None:
                for part in ast.walk(value):
                    for k, item in enumerate(part.elts if isinstance(part, ast.List) else ()):
                        self.pattern(item, k)

    def pattern(self, node: ast.expr, k: int) -> None:
        if not (isinstance(node, ast.Call) and (dotted(node.func) or [""])[-1] in URL_CALLS and len(node.args) > 1 and string(node.args[0]) is not None):
            return
        view, kind, to = node.args[1], "view", dotted(node.args[1])
        if isinstance(view, ast.Call) and isinstance(view.func, ast.Attribute) and view.func.attr == "as_view":
            kind, to = "class", dotted(view.func.value)
        elif isinstance(view, ast.Call) and (dotted(view.func) or [""])[-1] == "include" and view.args:
            kind, to = "include", [string(view.args[0])] if string(view.args[0]) is not None else dotted(view.args[0])
        if to:
            self.add("pattern", k, self.module, string(node.args[0]), kind, node.lineno, extra=[".".join(to)])

    def imported(self, node: ast.AST) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                self.add("import", owner=self.module, name=a.asname or a.name.split(".")[0], detail=a.name if a.asname else a.name.split(".")[0], line=node.lineno)
        elif isinstance(node, ast.ImportFrom):
            package = self.module.split(".")[: -node.level] if node.level else []
            source = ".".join([*package, *([node.module] if node.module else [])])
            for a in node.names:
                self.add("import", owner=self.module, name=f"*{source}" if a.name == "*" else a.asname or a.name, detail=f"{source}.{a.name}" if a.name != "*" else source, line=node.lineno)

    def class_(self, node: ast.ClassDef) -> None:
        fqn = f"{self.module}.{node.name}"
        bases = [b for b in map(type_text, node.bases) if b]
        methods = [n for n in node.body if isinstance(n, Def)]
        protocol = any(b.split(".")[-1] == "Protocol" for b in bases)
        marked = any((dotted(d) or [""])[-1] == "abstractmethod" for m in methods for d in m.decorator_list)
        self.add("class", name=fqn, owner=self.module, extra=bases, detail="protocol" if protocol else "", line=node.lineno, end_line=node.end_lineno, flag=protocol or marked or any(b.split(".")[-1] == "ABC" for b in bases))
        k = 0
        for n in node.body:
            if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
                self.add("attr", k, fqn, n.target.id, type_text(n.annotation), n.lineno)
                k += 1
        for m in methods:
            if m.name == "__init__":
                given = {a.arg: type_text(a.annotation) for a in [*m.args.posonlyargs, *m.args.args, *m.args.kwonlyargs]}
                for n in ast.walk(m):
                    targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
                    for t in targets:
                        if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                            value = n.value
                            kind = type_text(n.annotation) if isinstance(n, ast.AnnAssign) else given.get(value.id) if isinstance(value, ast.Name) else type_text(value.func) if isinstance(value, ast.Call) else None
                            if kind:
                                self.add("attr", k, fqn, t.attr, kind, n.lineno)
                                k += 1
            self.function(m, fqn)

    def function(self, node: Def, cls: str | None) -> None:
        fqn = f"{cls or self.module}.{node.name}"
        self.add("function", owner=self.module, name=fqn, detail=cls, line=node.lineno, end_line=node.end_lineno, extra=[".".join(d) for d in map(dotted, (x.func if isinstance(x, ast.Call) else x for x in node.decorator_list)) if d], flag=isinstance(node, ast.AsyncFunctionDef))
        args = node.args
        for k, a in enumerate(x for x in [*args.posonlyargs, *args.args, args.vararg, *args.kwonlyargs, args.kwarg] if x is not None and x.arg not in ("self", "cls")):
            self.add("param", k, fqn, a.arg, type_text(a.annotation), node.lineno)
            if type_text(a.annotation):
                self.add("local", -1, fqn, a.arg, type_text(a.annotation), node.lineno)
        for d in node.decorator_list:
            parts = dotted(d.func) if isinstance(d, ast.Call) else None
            if parts and len(parts) == 2 and parts[1] in VERBS and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                self.add("route", owner=fqn, name=parts[1].upper(), detail=d.args[0].value, line=node.lineno, extra=[parts[0]])
            self.calls(d, fqn, (), False)
        self.block(node.body, fqn, (), False)

    def block(self, body: list[ast.stmt], owner: str, frames: tuple, loop: bool) -> None:
        for k, node in enumerate(body):
            self.statement(node, owner, frames, loop, k + 1 < len(body))

    def statement(self, node: ast.stmt, owner: str, frames: tuple, loop: bool, follows: bool) -> None:
        site = f"{owner}:{node.lineno}"
        into = lambda kind, arm: (*frames, (kind, site, arm))
        if isinstance(node, (*Def.__args__, ast.ClassDef)):
            self.block(node.body, owner, frames, loop)
        elif isinstance(node, ast.If):
            arms, at = [(source_of(node.test), node.body)], node
            while len(at.orelse) == 1 and isinstance(at.orelse[0], ast.If):
                at = at.orelse[0]
                self.flattened.add(at)
                arms.append((source_of(at.test), at.body))
            arms.append(("else", at.orelse))
            if node not in self.flattened:
                self.fork(node, owner, "branch", arms[0][0], arms, follows)
            self.calls(node.test, owner, frames, loop)
            self.block(node.body, owner, into("if", 0), loop)
            self.block(node.orelse, owner, into("if", 1), loop)
        elif isinstance(node, ast.Match):
            arms = [(source_of(c.pattern) + (f" if {source_of(c.guard)}" if c.guard else ""), c.body) for c in node.cases]
            self.fork(node, owner, "match", source_of(node.subject), arms, follows)
            self.calls(node.subject, owner, frames, loop)
            for k, c in enumerate(node.cases):
                self.block(c.body, owner, into("match", k), loop)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            arms = [("try", node.body), *((source_of(h.type) if h.type else "except", h.body) for h in node.handlers)]
            if any(isinstance(x, ast.Call) for h in node.handlers for s in h.body for x in ast.walk(s)):
                self.fork(node, owner, "except", "try", arms, follows)
            self.block(node.body, owner, into("try", 0), loop)
            for k, h in enumerate(node.handlers, 1):
                self.block(h.body, owner, into("try", k), loop)
            self.block(node.orelse, owner, into("try", len(node.handlers) + 1), loop)
            self.block(node.finalbody, owner, into("try", len(node.handlers) + 2), loop)
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            self.calls(node.test if isinstance(node, ast.While) else node.iter, owner, frames, loop)
            self.block(node.body, owner, into("loop", 0), True)
            self.block(node.orelse, owner, into("loop", 1), loop)
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                self.calls(item.context_expr, owner, frames, loop)
                if isinstance(item.optional_vars, ast.Name) and isinstance(item.context_expr, ast.Call) and type_text(item.context_expr.func):
                    self.add("local", node.lineno, owner, item.optional_vars.id, type_text(item.context_expr.func), node.lineno)
            self.block(node.body, owner, into("with", 0), loop)
        else:
            self.locals(node, owner)
            self.calls(node, owner, frames, loop)

    def locals(self, node: ast.stmt, owner: str) -> None:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        for t in targets:
            kind = type_text(node.annotation) if isinstance(node, ast.AnnAssign) else type_text(node.value.func) if isinstance(node.value, ast.Call) else None
            if isinstance(t, ast.Name) and kind:
                self.add("local", node.lineno, owner, t.id, kind, node.lineno)

    def fork(self, node: ast.stmt, owner: str, kind: str, selector: str, arms: list[tuple[str, list[ast.stmt]]], follows: bool) -> None:
        first = node.test if isinstance(node, ast.If) else node.subject if isinstance(node, ast.Match) else None
        reads = list(dict.fromkeys(".".join(p) for x in (ast.walk(first) if first is not None else ()) if (p := dotted(x))))
        key = [str(node.lineno), str(node.col_offset)]
        self.add("fork", node.col_offset, owner, kind, selector[:120], node.lineno, node.end_lineno, reads, flag=follows)
        for k, (label, body) in enumerate(arms):
            span = [str(min(s.lineno for s in body)), str(max(s.end_lineno for s in body))] if body else ["0", "-1"]
            self.add("arm", k, owner, label[:120], terminal(body), node.lineno, node.end_lineno, key + span)

    def chosen(self, node: ast.Call, owner: str) -> None:
        """Calls of what is picked at run time: from a table by a key, or by a name that is worked out."""
        func, table, key, name = node.func, None, None, None
        if isinstance(func, ast.Subscript):
            if isinstance(func.value, ast.Name):
                table, key = func.value.id, func.slice
            elif isinstance(func.value, ast.Call) and dotted(func.value.func) == ["globals"]:
                name = func.slice
        elif isinstance(func, ast.Call):
            inner = dotted(func.func)
            if inner == ["getattr"] and len(func.args) > 1:
                name = func.args[1]
            elif inner and len(inner) == 2 and inner[1] == "get" and func.args:
                table, key = inner[0], func.args[0]
        if table:
            self.add("lookup", node.col_offset, owner, table, source_of(key), node.lineno, node.end_lineno)
        if name is not None and not isinstance(name, ast.Constant):
            where = [str(node.lineno), str(node.col_offset)]
            self.add("fork", node.col_offset, owner, "dynamic", source_of(name)[:120], node.lineno, node.end_lineno, flag=True)
            start = name.values[0] if isinstance(name, ast.JoinedStr) and name.values else None
            if isinstance(start, ast.Constant):
                self.add("arm", 0, owner, f"{start.value}*", "falls_through", node.lineno, node.end_lineno, [*where, "0", "-1"])

    def ternary(self, node: ast.IfExp, owner: str) -> None:
        """A conditional expression with a call in it is a fork; its arms have the calls of their lines."""
        if any(isinstance(x, ast.Call) for x in ast.walk(node)):
            reads = list(dict.fromkeys(".".join(p) for x in ast.walk(node.test) if (p := dotted(x))))
            self.add("fork", node.col_offset, owner, "branch", source_of(node.test)[:120], node.lineno, node.end_lineno, reads, flag=True)
            for k, (label, side) in enumerate(((source_of(node.test), node.body), ("else", node.orelse))):
                self.add("arm", k, owner, label[:120], "falls_through", node.lineno, node.end_lineno, [str(node.lineno), str(node.col_offset), str(side.lineno), str(side.end_lineno)])

    def calls(self, node: ast.AST, owner: str, frames: tuple, loop: bool) -> None:
        found = [n for n in ast.walk(node) if isinstance(n, ast.Call)]
        for n in ast.walk(node):
            if isinstance(n, ast.IfExp):
                self.ternary(n, owner)
        for n in sorted(found, key=lambda c: (c.lineno, c.col_offset, -(c.end_col_offset or 0))):
            parts, text, given = dotted(n.func), source_of(n)[:120], arguments(n)
            self.chosen(n, owner)
            for a in [*n.args, *(k.value for k in n.keywords)]:
                if to := dotted(a):
                    self.add("argref", n.col_offset, owner, to[0], text, n.lineno, n.end_lineno, to[1:], frames, loop, given)
            self.add("call", n.col_offset, owner, parts[0] if parts else "", text, n.lineno, n.end_lineno, parts[1:] if parts else [], frames, loop, given)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for repo, path, content in zip(*(part.column(k).to_pylist() for k in range(3))):
            rows = FileFacts(repo, path, content).rows
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def facts(sources: DataFrame) -> DataFrame:
    """Rows of all files (repo, path, content); a file that does not parse, is nested too deeply or has no content gives one
    ``unparsed`` row, a row without path none."""
    ship(sources.sparkSession)
    return sources.where("path is not null").select("repo", "path", "content").mapInArrow(_facts, FACTS)
