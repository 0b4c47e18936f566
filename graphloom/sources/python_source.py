"""Records from Python source: nodes, edges and the names that imports bind; minting with reuse; closure over imports."""

from __future__ import annotations

import ast
import builtins
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.session import cut

#: One row per node or edge. ``at`` and ``held`` are the imported module and name, ``head`` the name an import binds,
#: ``bare`` whether it binds the first segment of a dotted module only.
RECORD = "kind string, id string, type string, src string, dst string, src_repr string, dst_repr string, line long, head string, at string, held string, bare boolean, args array<string>, annotations map<string,string>, docstring string, role string, path string"
FIELDS = [part.split(" ")[0] for part in RECORD.replace(", ", ",").replace("string,string", "string").split(",")]
STANDARD = tuple(sorted(sys.stdlib_module_names))
BUILTINS = tuple(sorted(dir(builtins)))
DOCSTRING = 200
#: Records that are handed over at once, those of the last file on top.
HANDED = 5_000
_DEFS = ast.FunctionDef | ast.AsyncFunctionDef


def label(node: ast.AST) -> str | None:
    """The dotted text of a name; a call inside it reads ``(...)``. None for what has no name."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = label(node.value)
        return base and f"{base}.{node.attr}"
    if isinstance(node, ast.Call):
        base = label(node.func)
        return base and base + "(...)"
    return label(node.value) if isinstance(node, ast.Subscript) else None


def _parameters(f: ast.AST) -> list[ast.arg]:
    a = f.args
    return [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]


def _bound(body: list[ast.stmt]) -> set[str]:
    """Names that the statements bind in their own scope, inner scopes left out."""
    out, todo = set(), list(body)
    while todo:
        x = todo.pop()
        if isinstance(x, _DEFS | ast.ClassDef):
            out.add(x.name)
        elif isinstance(x, ast.Import | ast.ImportFrom):
            out.update(a.asname or a.name.split(".")[0] for a in x.names)
        elif isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
            out.add(x.id)
        elif not isinstance(x, ast.Lambda):
            todo.extend(ast.iter_child_nodes(x))
    return out


class _File:
    """The records of one file."""

    def __init__(self, corpus: str, path: str):
        self.corpus, self.path = corpus, path.replace("\\", "/")
        stem = self.path.removesuffix(".py").strip("/")
        self.package = stem == "__init__" or stem.endswith("/__init__")
        self.module = stem.removesuffix("__init__").strip("/").replace("/", ".") or corpus
        self.role = "test" if any(p in ("test", "tests") for p in self.path.split("/")[:-1]) or self.path.rsplit("/", 1)[-1].startswith("test_") else None
        self.rows: list[dict] = []
        self.top = self.make("module", self.module)

    def make(self, kind: str, dotted: str) -> str:
        return f"{self.corpus}://{kind}/{dotted}"

    def node(self, node_id: str, kind: str, line: int, of: ast.AST | None, **more) -> None:
        doc = ast.get_docstring(of) if of is not None else None
        self.rows.append({"kind": "node", "id": node_id, "type": kind, "line": line, "docstring": doc and doc[:DOCSTRING], "role": self.role, **more})

    def edge(self, kind: str, line: int, **more) -> None:
        self.rows.append({"kind": "edge", "type": kind, "line": line, **more})

    def read(self, text: str) -> list[dict]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            tree = None
        self.node(self.top, "module", 1, tree)
        if tree is not None:
            self.outer = _bound(tree.body)
            self.define(self.top, self.module, tree.body, False)
            for x in ast.walk(tree):
                if isinstance(x, ast.Import | ast.ImportFrom):
                    self.imported(x)
        return [{"path": self.path, **r} for r in self.rows]

    def imported(self, x: ast.Import | ast.ImportFrom) -> None:
        if isinstance(x, ast.Import):
            for a in x.names:
                self.edge("imports", x.lineno, src=self.top, dst=self.make("module", a.name), head=a.asname or a.name.split(".")[0], at=a.name, bare=a.asname is None)
            return
        base = x.module or ""
        if x.level:
            up = self.module.split(".")
            up = up[: max(0, len(up) - x.level + self.package)]
            base = ".".join([*up, *([x.module] if x.module else [])])
        for a in x.names:
            self.edge("imports", x.lineno, src=self.top, dst=self.make("module", base or a.name), head=a.asname or a.name, at=base, held=a.name, bare=False)

    def define(self, holder: str, dotted: str, body: list[ast.stmt], in_class: bool) -> None:
        for s in body:
            if isinstance(s, _DEFS | ast.ClassDef):
                kind = "class" if isinstance(s, ast.ClassDef) else "method" if in_class else "func"
                own = self.make(kind, f"{dotted}.{s.name}")
                more = {}
                if kind != "class":
                    params = _parameters(s)
                    more = {"args": [p.arg for p in params], "annotations": {p.arg: ast.unparse(p.annotation) for p in params if p.annotation is not None}}
                self.node(own, kind, s.lineno, s, **more)
                self.edge("contains", s.lineno, src=holder, dst=own)
                for d in s.decorator_list:
                    if label(d):
                        self.edge("decorates", d.lineno, src_repr=label(d), dst=own)
                if kind == "class":
                    for b in s.bases:
                        if label(b):
                            self.edge("inherits", b.lineno, src=own, dst_repr=label(b))
                    self.define(own, f"{dotted}.{s.name}", s.body, True)
                else:
                    self.uses(own, s, frozenset())
            elif isinstance(s, ast.If | ast.Try | ast.With):
                self.define(holder, dotted, [c for x in ast.iter_child_nodes(s) for c in ([x] if isinstance(x, ast.stmt) else getattr(x, "body", []) if isinstance(x, ast.ExceptHandler) else [])], in_class)

    def uses(self, own: str, f: ast.AST, hidden: frozenset[str]) -> None:
        """Calls, and module-level names read as values, of a function and all inside it; both are the outermost's."""
        hidden = hidden | {p.arg for p in _parameters(f)} | (_bound(f.body) if isinstance(f.body, list) else set())
        values = [*f.args.defaults, *[d for d in f.args.kw_defaults if d is not None]]
        todo = [(x, True) for x in (*(f.body if isinstance(f.body, list) else [f.body]), *values)]
        while todo:
            x, value = todo.pop()
            if isinstance(x, _DEFS | ast.Lambda):
                self.uses(own, x, hidden)
            elif isinstance(x, ast.Call):
                name = label(x.func)
                if name:
                    self.edge("calls", x.lineno, src=own, dst_repr=name)
                todo.extend([(x.func, False), *((a, True) for a in x.args), *((k.value, True) for k in x.keywords)])
            elif isinstance(x, ast.Name | ast.Attribute) and label(x) and "(...)" not in label(x):
                head = label(x).split(".")[0]
                if value and isinstance(x.ctx, ast.Load) and head in self.outer and head not in hidden:
                    self.edge("references", x.lineno, src=own, dst_repr=label(x))
            elif isinstance(x, ast.AnnAssign):
                todo.extend((c, True) for c in (x.target, x.value) if c is not None)
            else:
                todo.extend((c, True) for c in ast.iter_child_nodes(x))


def source_records(corpus: str, path: str, text: str) -> list[dict]:
    """Module, class, function and method nodes; contains, imports, inherits, decorates, calls and references edges.

    Calls and references belong to the outermost function or method around them; those of a module or class body give
    none. A name is referenced where it is read as a value, the module binds it and no scope between hides it. Ends that
    only have a text stay text until ``resolve`` binds them. A file that doesn't parse gives its module only.
    """
    return _File(corpus, path).read(text)


def records(files: DataFrame, corpus: str) -> DataFrame:
    """``RECORD`` rows of ``files(path, text)``; a null text counts as empty.

    Files are dealt to all cores, however few splits their table has; records of small files are handed over together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                rows += [tuple(map(r.get, FIELDS)) for r in source_records(corpus, path, text or "")]
                if len(rows) >= HANDED:
                    yield pd.DataFrame(rows, columns=FIELDS, dtype=object)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=FIELDS, dtype=object)

    return dealt(files.select("path", "text")).mapInPandas(run, RECORD)


def dealt(files: DataFrame) -> DataFrame:
    """The files over as many partitions as a shuffle has, or as there are cores if these are more."""
    spark = files.sparkSession
    return files.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def mint(files: DataFrame, corpus: str, held: DataFrame | None = None) -> DataFrame:
    """Records with ``sha``; files whose path and hash are in ``held`` are not parsed again, their records are reused.

    Equal to a full mint of ``files``: records of files that changed or went aren't taken over.
    """
    hashed = files.select("path", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    keys = hashed.select(C.posix(F.col("path")).alias("path"), "sha")
    if held is None:
        return records(hashed, corpus).join(keys, "path")
    fresh = hashed.join(held.select("path", "sha").distinct(), [C.posix(hashed["path"]) == held["path"], hashed["sha"] == held["sha"]], "left_anti")
    parsed = records(fresh, corpus).join(keys, "path")
    return parsed.unionByName(held.join(keys, ["path", "sha"], "left_semi"))


def ring(site: DataFrame, first: str, standard: tuple[str, ...] = STANDARD) -> tuple[DataFrame, DataFrame]:
    """Records of a package and, wave by wave, of every package of ``site(package, path, text)`` that these import.

    Beside them ``(scheme, reason)`` of imports that were not minted: ``standard`` or ``not held``. Waves end when
    nothing new is imported; each is checkpointed.
    """
    spark = site.sparkSession
    available = cut(site.select(F.col("package").alias("scheme")).distinct())
    wave = available.filter(F.col("scheme") == first)
    minted, out, imported = wave, None, None
    while not wave.isEmpty():
        files = site.join(wave, site["package"] == wave["scheme"], "left_semi")
        found = cut(records(files, first).withColumn("package", F.split("path", "[/.]")[0]))
        out = found if out is None else out.unionByName(found)
        named = found.filter("type = 'imports' AND at <> ''").select(F.split("at", r"\.")[0].alias("scheme")).distinct()
        imported = named if imported is None else imported.unionByName(named).distinct()
        wave = cut(named.filter(~F.col("scheme").isin(*standard)).join(available, "scheme", "left_semi").join(minted, "scheme", "left_anti"))
        minted = minted.unionByName(wave)
    if out is None:
        empty = spark.createDataFrame([], RECORD + ", package string")
        return empty, spark.createDataFrame([(first, "not held")], "scheme string, reason string")
    skipped = imported.join(minted, "scheme", "left_anti")
    return out, skipped.withColumn("reason", F.when(F.col("scheme").isin(*standard), "standard").otherwise("not held"))
