"""Symbols, comments, imports and fingerprints of source files; a file is parsed once and gives all its rows.

Python is parsed; the fifteen other languages are read by their tokens (``lexed_code``) and give no imports. Verdicts about them
stay UNKNOWN, as no resolver is at hand.
"""

from __future__ import annotations

import ast
import hashlib
import io
import json
import re
import tokenize
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rule_tables import SKIP_DIRS
from ..operators.comments import first_tag
from ..runtime import ship, stored
from ..schemas import COMMENTS, FINGERPRINTS, IMPORTS, SYMBOLS
from . import lexed_code
from .lexer import language_of

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_FLOW = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match, ast.IfExp)
ROWS = {"symbol": SYMBOLS, "comment": COMMENTS, "fingerprint": FINGERPRINTS + ", tokens array<string>", "import": IMPORTS}


def _file_system(root: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(root) if re.match(r"[a-z][a-z0-9+.-]*:", root) else (LocalFileSystem(), root)


def unlisted(root: str, extensions: tuple[str, ...]) -> list[str]:
    """Relative paths that Spark's readers take for hidden and pass over: a file or folder below the root starts with ``_`` or a dot."""
    files, base = _file_system(root)
    found, folders = [], [base.rstrip("/")]
    while folders:
        for entry in files.get_file_info(FileSelector(folders.pop())):
            if entry.type == FileType.Directory and entry.base_name not in SKIP_DIRS:
                folders.append(entry.path)
            elif entry.type == FileType.File and entry.size and entry.base_name.lower().endswith(extensions):
                found.append(entry.path[len(base.rstrip("/")) + 1 :])
    return sorted(p for p in found if any(part[0] in "_." for part in p.split("/")))


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".py",)) -> DataFrame:
    """(``path`` relative to the root, ``text``, ``content_hash``) of the files below ``root``; skipped directories and empty files are left out.

    Spark's reader gives all files but those it takes for hidden, such as ``__init__.py``; these are listed and opened by name, one
    at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    path = F.substring_index(F.regexp_replace("path", r"^[a-z]+:/*", "/"), re.sub(r"^[a-z]+:/*", "/", prefix), -1)
    rows = files.select(path.alias("path"), "content")
    if names := unlisted(root, extensions):

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            system, base = _file_system(root)
            for batch in batches:
                for name in batch["path"]:
                    with system.open_input_file(f"{base.rstrip('/')}/{name}") as f:
                        yield pd.DataFrame({"path": [name], "content": [f.read()]})

        ship(spark)
        rows = rows.unionByName(spark.createDataFrame([(n,) for n in names], "path string").mapInPandas(read, "path string, content binary"))
    rows = rows.select("path", F.expr("make_valid_utf8(cast(content AS string))").alias("text"), F.sha2("content", 256).alias("content_hash"))
    rows = rows.filter(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"))
    return rows.filter(~F.exists(F.split("path", "/"), lambda p: p.isin(*SKIP_DIRS)))


def cognitive(function: ast.AST) -> int:
    """Cognitive complexity: each break of the flow counts 1 and its nesting; else and elif count 1; runs of one boolean operator count 1."""
    total = 0
    own = function.name
    owner_names = ("self", "cls")

    def booleans(node: ast.BoolOp) -> int:
        ops: list[type] = []

        def walk(n: ast.AST) -> None:
            if isinstance(n, ast.BoolOp):
                for i, v in enumerate(n.values):
                    if i:
                        ops.append(type(n.op))
                    walk(v)
            elif isinstance(n, ast.UnaryOp):
                walk(n.operand)

        walk(node)
        return sum(1 for i, o in enumerate(ops) if not i or ops[i - 1] is not o)

    def visit(node: ast.AST, nest: int, inside: bool = False) -> None:
        nonlocal total
        down = partial(each, nest=nest + 1)
        if isinstance(node, ast.If):
            total += 1 + nest
            visit(node.test, nest)
            down(node.body)
            rest = node.orelse
            while len(rest) == 1 and isinstance(rest[0], ast.If) and rest[0].col_offset == node.col_offset:
                total += 1
                visit(rest[0].test, nest)
                down(rest[0].body)
                rest = rest[0].orelse
            if rest:
                total += 1
                down(rest)
            return
        if isinstance(node, _LOOPS):
            total += 1 + nest
            visit(node.test if isinstance(node, ast.While) else node.iter, nest)
            down(node.body)
            each(node.orelse, nest)
            return
        if isinstance(node, ast.ExceptHandler):
            total += 1 + nest
            down(node.body)
            return
        if isinstance(node, ast.IfExp):
            total += 1 + nest
            down([node.test, node.body, node.orelse])
            return
        if isinstance(node, ast.Match):
            total += 1 + nest
            down([s for c in node.cases for s in c.body])
            return
        if isinstance(node, (*_DEFS, ast.Lambda)):
            down(node.body if isinstance(node.body, list) else [node.body])
            return
        if isinstance(node, ast.comprehension):
            total += 1 + nest + len(node.ifs)
            down([node.iter, *node.ifs])
            return
        if isinstance(node, ast.BoolOp) and not inside:
            total += booleans(node)
            for v in node.values:
                visit(v, nest, True)
            return
        if isinstance(node, ast.Call):
            f = node.func
            if (isinstance(f, ast.Name) and f.id == own) or (isinstance(f, ast.Attribute) and f.attr == own and isinstance(f.value, ast.Name) and f.value.id in owner_names):
                total += 1
        for child in ast.iter_child_nodes(node):
            visit(child, nest, inside and isinstance(node, (ast.BoolOp, ast.UnaryOp)))

    def each(nodes: list[ast.AST], nest: int) -> None:
        for n in nodes:
            visit(n, nest)

    each(function.body, 0)
    return total


def _fingerprint(path: str, node: ast.AST, scope: str, text_tokens: list[tuple[int, str]]) -> dict:
    shape, calls, count = [], [], -1
    for n in ast.walk(node):
        count += 1
        shape.append("ID" if isinstance(n, ast.Name | ast.arg | ast.Attribute) else "LIT" if isinstance(n, ast.Constant) else type(n).__name__)
        if isinstance(n, ast.Call):
            f = n.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                calls.append(name)
    raw = [t for line, t in text_tokens if node.lineno <= line <= node.end_lineno]
    sha = lambda items: hashlib.sha1("\x02".join(items).encode()).hexdigest()
    flow = any(isinstance(n, _FLOW) for n in ast.walk(node) if n is not node)
    return {
        "path": path, "name": node.name, "kind": "function", "line": node.lineno, "end_line": node.end_lineno, "scope": scope, "shape_hash": sha(shape), "raw_token_hash": sha(raw), "call_hash": sha(sorted(calls)) if calls else None,
        "node_count": count, "nstmts": len(node.body), "has_control_flow": flow, "cognitive": cognitive(node), "tokens": shape,
    }


def rows_of(path: str, text: str) -> Iterator[tuple[str, dict]]:
    """(row type, row) of one file; a file that does not parse gives nothing."""
    try:
        tree = ast.parse(text)
        marks = list(tokenize.generate_tokens(io.StringIO(text).readline))
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
        return
    exported = {e.value for n in tree.body if isinstance(n, ast.Assign | ast.AugAssign | ast.AnnAssign) for t in (n.targets if isinstance(n, ast.Assign) else [n.target]) if isinstance(t, ast.Name) and t.id == "__all__" for e in getattr(n.value, "elts", ()) if isinstance(e, ast.Constant)}
    skip = (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER)
    words = [(t.start[0], t.string) for t in marks if t.type not in skip and t.string.strip()]

    def comment(line: int, end: int, kind: str, doc: bool, scope: str, owner: int | None, body: str) -> tuple[str, dict]:
        return "comment", {"path": path, "line": line, "end_line": end, "kind": kind, "is_doc": doc, "scope": scope, "owner_line": owner, "text": body}

    def docstring(node: ast.AST, scope: str, owner: int | None) -> Iterator[tuple[str, dict]]:
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            yield comment(first.lineno, first.end_lineno, "doc", True, scope, owner, first.value.value)

    def walk(nodes: list[ast.AST], scope: str) -> Iterator[tuple[str, dict]]:
        for n in nodes:
            if isinstance(n, (*_DEFS, ast.ClassDef)):
                is_class = isinstance(n, ast.ClassDef)
                decorators = ["@" + ast.unparse(d) for d in n.decorator_list]
                yield "symbol", {"path": path, "kind": "class" if is_class else "function", "name": n.name, "line": n.lineno, "end_line": n.end_lineno, "scope": scope, "decorators": decorators, "exported": not scope and n.name in exported}
                own = f"{scope}.{n.name}" if scope else n.name
                yield from docstring(n, own, n.lineno)
                if not is_class:
                    yield "fingerprint", _fingerprint(path, n, scope, words)
                yield from walk(n.body, own)
            elif isinstance(n, ast.Assign | ast.AnnAssign) and not scope:
                targets = n.targets if isinstance(n, ast.Assign) else [n.target]
                if len(targets) == 1 and isinstance(targets[0], ast.Name):
                    yield "symbol", {"path": path, "kind": "variable", "name": targets[0].id, "line": n.lineno, "end_line": n.end_lineno, "scope": "", "decorators": [], "exported": targets[0].id in exported}
            else:
                for part in ("body", "orelse", "finalbody", "handlers"):
                    below = getattr(n, part, None)
                    if isinstance(below, list):
                        yield from walk(below, scope) if part != "handlers" else walk([s for h in below for s in h.body], scope)

    yield from docstring(tree, "", None)
    yield from walk(tree.body, "")
    for t in marks:
        if t.type == tokenize.COMMENT:
            yield comment(t.start[0], t.end[0], "line", False, "", None, t.string)
    for n in ast.walk(tree):
        if isinstance(n, ast.ImportFrom):
            # a relative import is stated from the root
            folders = path.split("/")[:-1] if n.level else []
            module = ".".join([*folders[: len(folders) + 1 - n.level], *([n.module] if n.module else [])]) if n.level else n.module
            for a in n.names:
                yield "import", {"path": path, "module": module, "name": a.name, "alias": a.asname or a.name, "line": n.lineno}
        elif isinstance(n, ast.Import):
            for a in n.names:
                yield "import", {"path": path, "module": a.name, "name": None, "alias": a.asname or a.name, "line": n.lineno}


def file_rows(path: str, text: str) -> Iterator[tuple[str, dict]]:
    """(row type, row) of one file in any language; a suffix of no language gives nothing."""
    name = language_of(path)
    if name == "python":
        yield from rows_of(path, text)
    elif name is not None:
        yield from lexed_code.rows_of(path, text, name)


def extract(files: DataFrame) -> dict[str, DataFrame]:
    """``symbol``, ``comment``, ``fingerprint`` and ``import`` rows of (``path``, ``text``): one pass of the parser, stored, told apart by type."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(kind, json.dumps(row)) for path, text in zip(batch["path"], batch["text"], strict=True) for kind, row in file_rows(path, text or "")]
            yield pd.DataFrame(out, columns=["kind", "row"])

    ship(files.sparkSession)
    tagged = stored(files.select("path", "text").mapInPandas(run, "kind string, row string"), "extracted")
    out = {k: tagged.filter(F.col("kind") == k).select(F.from_json("row", schema).alias("r")).select("r.*") for k, schema in ROWS.items()}
    out["comment"] = out["comment"].withColumn("tag", first_tag("text"))
    return out
