"""Python sources as symbols and edges.

Files come as rows (path, content), for example from Spark's binaryFile reader; each
is parsed where it lies.  A call becomes an edge only if its name is bound by a
module-level definition or an import and isn't rebound in the functions around it.
A source with errors is marked as not parsed and gives the rows of what is sound: a
definition whose head has an error is no symbol, but what its block defines is; calls
in a function whose parameters can't be read are left out, as these may hide names.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import ship
from loomgraph.sources.files import local_path
from loomgraph.sources.recovery import Scope, recovered

#: A row of a parsed file: nodes and edges share it. Further kinds are for names across files: alias (the module
#: qualified_name binds name to the name target of module label; * for all), bound (the module binds name to something
#: else), all (the module lists name as public) and use (source calls name of module label).
ROW = "kind string, label string, name string, qualified_name string, source string, target string, file_path string, start_line int, end_line int, properties string, doc string, lines long, parsed boolean"

# Warning classes that mark a deprecation, and calls that issue warnings.
DEPRECATION = re.compile(r"(?:Pending)?DeprecationWarning\b|RemovedIn\w*Warning\b")
WARN_CALLS = ("warnings.warn", "warn")

_STRING = re.compile(r"""^[A-Za-z]*(\"{3}|'{3}|"|')(.*)\1$""", re.S)
# lines with their ends, as the parser counts them
_LINES = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def module_of(path: str) -> str:
    return re.sub(r"/__init__$", "", re.sub(r"\.py$", "", path)).replace("/", ".")


class _Module:
    """One parsed file; rows() yields its symbols and edges."""

    def __init__(self, path: str, text: str, tree: ast.Module):
        self.path, self.text, self.tree, self.name = path, text, tree, module_of(path)
        self.package = self.name if path.endswith("__init__.py") else self.name.rpartition(".")[0]
        self.bound: dict[str, str] = {}
        self.imports: dict[str, str] = {}
        #: local name -> (module, name) of names imported from modules; of those, the module's own
        self.origins: dict[str, tuple[str, str]] = {}
        self.aliases: dict[str, tuple[str, str]] = {}
        self.stars: list[str] = []
        self.rebound: set[str] = set()
        self.public: list[str] | None = None
        self.lines = [line.encode() for line in _LINES.findall(text)]

    def _source(self, node: ast.AST) -> str:
        """The node's text; the lines are split once a file."""
        part = self.lines[node.lineno - 1 : node.end_lineno]
        if not part:
            return ""
        part[-1] = part[-1][: node.end_col_offset]
        part[0] = part[0][node.col_offset :]
        return b"".join(part).decode(errors="replace")

    # --- descriptions and deprecation

    def doc(self, node: ast.AST) -> str:
        """First paragraph of the docstring as it is written, on one line, at most 200 long."""
        first = node.body[0] if node.body else None
        if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
            return ""
        m = _STRING.match(self._source(first.value))
        if not m or m[1] in re.sub(r"\\.", "", m[2], flags=re.S):  # joined strings
            return ""
        return m[2].strip().split("\n\n")[0].replace("\n", " ").strip()[:200]

    def _warns(self, body: list[ast.stmt]) -> bool:
        for s in body:
            if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and self._source(s.value.func) in WARN_CALLS and DEPRECATION.search(self._source(s.value)):
                return True
            if isinstance(s, ast.Raise) and DEPRECATION.search(self._source(s)):
                return True
        return False

    def deprecated(self, node: ast.AST) -> bool:
        """As a whole: by a decorator of that name or a warning in its own body or __init__."""
        called = (d.func if isinstance(d, ast.Call) else d for d in node.decorator_list)
        if any(self._source(d).rsplit(".", 1)[-1] == "deprecated" for d in called):
            return True
        if isinstance(node, _FUNCTIONS):
            return self._warns(node.body)
        return any(isinstance(s, _FUNCTIONS) and s.name == "__init__" and self._warns(s.body) for s in node.body)

    # --- symbols and imports

    def symbols(self) -> Iterator[dict]:
        stack: list[tuple[ast.AST, str]] = [(self.tree, self.name)]
        while stack:
            at, scope = stack.pop()
            below = []
            for child in at.body if isinstance(at, _DEFS) else ast.iter_child_nodes(at):
                if isinstance(child, _DEFS):
                    qualified = f"{scope}.{child.name}"
                    if scope == self.name:
                        self.bound[child.name] = qualified
                    yield {"kind": "node", "label": "Class" if isinstance(child, ast.ClassDef) else "Function", "name": child.name, "qualified_name": qualified, "start_line": child.lineno, "end_line": child.end_lineno, "properties": '{"deprecated": true}' if self.deprecated(child) else "{}", "doc": self.doc(child)}
                    yield {"kind": "edge", "label": "DEFINES", "source": self.path, "target": qualified}
                    below.append((child, qualified))
                elif isinstance(child, Scope):
                    below.append((child, f"{scope}.{child.name}"))
                elif isinstance(child, (ast.Import, ast.ImportFrom)):
                    yield from self._imported(child, scope == self.name)
                else:
                    below.append((child, scope))
            stack += reversed(below)

    def _absolute(self, node: ast.ImportFrom) -> str | None:
        """The module that is imported from; None beyond the top."""
        if not node.level:
            return node.module or ""
        parts = self.package.split(".") if self.package else []
        if node.level - 1 > len(parts):
            return None
        return ".".join([*parts[: len(parts) - node.level + 1], *([node.module] if node.module else [])])

    def _imported(self, node: ast.Import | ast.ImportFrom, of_module: bool) -> Iterator[dict]:
        origin = self._absolute(node) if isinstance(node, ast.ImportFrom) else None
        for a in node.names:
            if a.name == "*":
                if origin is not None and of_module:
                    self.stars.append(origin)
                continue
            here = a.asname or (a.name if isinstance(node, ast.ImportFrom) else a.name.split(".")[0])
            for table in (self.origins, *([self.aliases] if of_module else [])):
                if origin is None:
                    table.pop(here, None)
                else:
                    table[here] = origin, a.name
            if origin is None and of_module:
                self.rebound.add(here)
            if isinstance(node, ast.Import):
                local, target = a.asname or a.name.split(".")[0], a.name
            else:
                base = "." * node.level + (node.module or "")
                local, target = a.asname or a.name, base + ("" if base.endswith(".") else ".") + a.name
            self.imports[local] = target
            yield {"kind": "edge", "label": "IMPORTS", "source": self.path, "target": target}

    # --- names for other files

    def _module_names(self) -> None:
        """What the module's own code binds beside definitions and imports, and its list of public names."""
        todo: list[ast.AST] = list(self.tree.body)
        while todo:
            node = todo.pop()
            if isinstance(node, (*_DEFS, Scope, ast.Lambda)):
                if isinstance(node, Scope):
                    self.rebound.add(node.name)
                continue
            if isinstance(node, ast.Name) and isinstance(node.ctx, (ast.Store, ast.Del)):
                self.rebound.add(node.id)
            if isinstance(node, (ast.Assign, ast.AugAssign)) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in (node.targets if isinstance(node, ast.Assign) else [node.target])):
                listed = [x.value for x in getattr(node.value, "elts", []) if isinstance(x, ast.Constant) and isinstance(x.value, str)]
                self.public = [*(self.public or []), *listed]
            todo += ast.iter_child_nodes(node)

    def names(self) -> Iterator[dict]:
        """Run after symbols(): the module's aliases, other bindings and public names. A name that is
        bound in several ways is a definition first, then something else, then an alias."""
        self._module_names()
        for local, (origin, name) in self.aliases.items():
            if local not in self.rebound:
                yield {"kind": "alias", "qualified_name": self.name, "name": local, "label": origin, "target": name}
        for origin in dict.fromkeys(self.stars):
            yield {"kind": "alias", "qualified_name": self.name, "name": "*", "label": origin, "target": "*"}
        for local in sorted(self.rebound):
            yield {"kind": "bound", "label": self.name, "qualified_name": self.name, "name": local}
        for name in dict.fromkeys(self.public or []):
            yield {"kind": "all", "label": self.name, "qualified_name": self.name, "name": name}

    # --- calls

    def _assigned(self, target: ast.AST) -> Iterator[str]:
        if isinstance(target, ast.Name):
            yield target.id
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                yield from self._assigned(t)

    def _own_names(self, function: ast.AST) -> set[str]:
        """Parameters, first assignment targets and nested definitions of a function."""
        args = function.args
        names = {a.arg for a in (*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg) if a}
        todo: list[ast.AST] = list(function.body)
        while todo:
            node = todo.pop()
            if isinstance(node, (*_DEFS, Scope)):
                names.add(node.name)
            elif isinstance(node, ast.Assign):
                names.update(self._assigned(node.targets[0]))
            elif isinstance(node, ast.AnnAssign):
                names.update(self._assigned(node.target))
            else:
                todo += ast.iter_child_nodes(node)
        return names

    def calls(self) -> Iterator[dict]:
        """Run after symbols(), which binds names. Default values, annotations and base classes
        are not searched; decorators belong to the scope around."""
        stack: list[tuple[ast.AST, str, frozenset[str]]] = [(self.tree, self.name, frozenset())]
        while stack:
            node, scope, hidden = stack.pop()
            if isinstance(node, _DEFS):
                stack += [(d, scope, hidden) for d in node.decorator_list]
                inner = hidden | self._own_names(node) if isinstance(node, _FUNCTIONS) else hidden
                stack += [(s, f"{scope}.{node.name}", inner) for s in node.body]
                continue
            if isinstance(node, Scope):
                stack += [] if node.silent else [(s, f"{scope}.{node.name}", hidden) for s in node.body]
                continue
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id not in hidden:
                name = node.func.id
                target = self.bound.get(name) or self.imports.get(name)
                if target:
                    yield {"kind": "edge", "label": "CALLS", "source": scope, "target": target}
                if name not in self.bound and name not in self.rebound:
                    if name in self.origins:
                        yield {"kind": "use", "source": scope, "label": self.origins[name][0], "name": self.origins[name][1]}
                    elif self.stars and name not in self.imports:
                        yield {"kind": "use", "source": scope, "label": self.name, "name": name}
            stack += [(c, scope, hidden) for c in ast.iter_child_nodes(node)]


def _tolerant(text: str) -> tuple[ast.Module, bool]:
    """(tree, whether all of the text is in it)."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text), True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return recovered(_LINES.findall(text.replace("\0", " "))), False


def parse_source(path: str, content: bytes) -> list[dict]:
    """Rows of a file: its File node first, then symbols, definitions, imports and calls. Never
    raises on bad sources."""
    lines = content.count(b"\n") + 1
    file = {"kind": "node", "label": "File", "name": path.rsplit("/", 1)[-1], "qualified_name": path, "start_line": 1, "end_line": lines, "properties": "{}", "doc": "", "lines": lines}
    text = content.decode(errors="replace").removeprefix("\ufeff")
    try:
        tree, whole = _tolerant(text)
        module = _Module(path, text, tree)
        found = [*module.symbols(), *module.names(), *module.calls()]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        found, whole = [], False
    whole = whole and text.encode() == content.removeprefix(b"\xef\xbb\xbf")  # else bytes were no UTF-8
    return [{**r, "file_path": path} for r in (file | {"parsed": whole}, *found)]


_NAMES = [c.split()[0] for c in ROW.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ROW.split(", ")])
#: Rows of a batch that the parser hands on, about.
_BATCH = 10_000


def parsed(sources: DataFrame) -> DataFrame:
    """Rows (ROW) of sources (path, content). A null path is an empty one, a null content an empty
    source. Sources are dealt to four tasks a core: a file of a table that is read by one task may
    make many of them, and it is parsing that takes the time."""
    ship(sources.sparkSession)
    tasks = 4 * sources.sparkSession.sparkContext.defaultParallelism

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(_NAMES, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows += parse_source(path.as_py() or "", content.as_py() or b"")
                if len(rows) >= _BATCH:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return sources.select("path", F.col("content").cast("binary")).repartition(tasks, "path").mapInArrow(run, ROW)


def nodes_of(rows: DataFrame, project: str, version: int) -> DataFrame:
    cols = ("label", "name", "qualified_name", "file_path", "start_line", "end_line", "properties", "doc")
    return rows.where("kind = 'node'").select(F.lit(project).alias("project"), *cols, F.lit(version).cast("long").alias("version"))


def edges_of(rows: DataFrame, project: str, version: int) -> DataFrame:
    return rows.where("kind = 'edge'").select(F.lit(project).alias("project"), "source", "target", F.col("label").alias("type"), F.lit("{}").alias("properties"), F.lit(version).cast("long").alias("version"))


#: Bytes of sources that are handed on at once, about.
_READ = 16 << 20


def _mounted(spark: SparkSession, root: Path, names: list[str]) -> DataFrame:
    """Files of a mounted folder. Spark's own readers pass over names that begin with an underscore,
    which packages' __init__.py do; tasks open the files instead. Those that are gone are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.binary())], names=["path", "content"])
        rows, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    content = (root / name).read_bytes()
                except (FileNotFoundError, IsADirectoryError):
                    continue
                rows.append((name, content))
                size += len(content)
                if size >= _READ:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    listed = spark.createDataFrame([(n,) for n in names], "path string")
    return listed.repartition(max(1, min(len(names) // 64, 2 * spark.sparkContext.defaultParallelism)), "path").mapInArrow(run, "path string, content binary")


def read_sources(spark: SparkSession, root: str, tracked: list[str] | None = None) -> DataFrame:
    """(path relative to root, content) of the .py files below root, or of the tracked ones. A root
    that isn't a mounted folder is read by Spark, without files whose name begins with _ or a dot."""
    local = local_path(root)
    if local is not None:
        names = sorted(str(p.relative_to(local)) for p in local.rglob("*.py") if p.is_file()) if tracked is None else tracked
        return _mounted(spark, local, names)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    base = F.lit(re.sub(r"^[a-z]+://*", "/", root).rstrip("/") + "/")
    path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    out = files.select(F.substring(path, F.length(base) + 1, F.length(path)).alias("path"), "content")
    if tracked is None:
        return out
    return out.join(spark.createDataFrame([(t,) for t in tracked], "path string"), "path", "left_semi")
