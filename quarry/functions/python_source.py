"""Structure, imports, calls and skeletons of Python sources by the standard ``ast`` module."""

from __future__ import annotations

import ast
import copy
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quarry.scratch import spread

#: Letters of the files after which a worker hands its rows on.
LETTERS = 1 << 18
BRANCHES = (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.BoolOp)
NODES = "path string, node_id int, parent_id int, last_desc_id int, depth int, type string, name string, start_line int, end_line int, signature string, decorators array<string>, modifiers array<string>, docstring string, lines int, max_depth int, branches int"


def tree_depth(node: ast.AST) -> int:
    """Levels of the syntax tree below a node."""
    depth, level = 0, [node]
    while level := [c for n in level for c in ast.iter_child_nodes(n)]:
        depth += 1
    return depth


def node_rows(content: str) -> list[tuple]:
    """Classes, functions and methods in pre-order, runs of imports as one node; no bodies of functions."""
    try:
        tree = ast.parse(content)
    except SyntaxError as e:
        return [(0, -1, 0, 0, "parse-error", str(e.msg), e.lineno or 1, e.lineno or 1, None, [], [], None, None, None, None)]
    rows: list[list] = []

    def visit(body: list[ast.stmt], parent: int, depth: int, inside: bool) -> None:
        run: list | None = None
        for n in body:
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                if run is None:
                    run = [len(rows), parent, len(rows), depth, "imports", "imports", n.lineno, n.end_lineno, None, [], [], None, None, None, None]
                    rows.append(run)
                run[7] = n.end_lineno
                continue
            run = None
            if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(n, ast.ClassDef)
                kind = "class" if is_class else "method" if inside else "function"
                signature = f"({', '.join(ast.unparse(b) for b in n.bases)})" if is_class and n.bases else None if is_class else f"({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
                row = [len(rows), parent, 0, depth, kind, n.name, n.lineno, n.end_lineno, signature, ["@" + ast.unparse(x) for x in n.decorator_list], ["async"] if isinstance(n, ast.AsyncFunctionDef) else [], (ast.get_docstring(n) or "").split("\n")[0] or None, n.end_lineno - n.lineno + 1, tree_depth(n), sum(isinstance(x, BRANCHES) for x in ast.walk(n))]
                rows.append(row)
                if is_class:
                    visit(n.body, row[0], depth + 1, True)
                row[2] = len(rows) - 1

    visit(tree.body, -1, 0, False)
    return [tuple(r) for r in rows]


def call_rows(content: str) -> list[tuple[str | None, str, int]]:
    """(caller, callee, line): the caller is the nearest enclosing definition, null at module level."""
    try:
        tree = ast.parse(content)
    except SyntaxError:
        return []
    rows: list[tuple[str | None, str, int]] = []

    def visit(node: ast.AST, caller: str | None, function: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Call):
                f = n.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    rows.append((caller, name, n.lineno))
            is_function = isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))
            if is_function or isinstance(n, ast.ClassDef):  # decorators stand outside of what they decorate
                visit(ast.Expression(ast.List(n.decorator_list, ast.Load())), caller, function)
                n.decorator_list = []
            visit(n, n.name if is_function and not function else caller, function or is_function)

    visit(tree, None, False)
    return rows


#: Letters up to which an expression is shown as it is, and how much of a long string stays.
SHOWN, STRING_SHOWN, STRING_LEFT = 60, 16, 13
#: What an expression must hold for its assignment to be shown.
TELLING = (ast.Call, ast.BinOp, ast.BoolOp, ast.Compare, ast.IfExp, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


class _Shorter(ast.NodeTransformer):
    """Lambdas as one sign and long strings by their beginning; with ``calls`` also what calls inside of calls are given."""

    def __init__(self, calls: bool):
        self.calls, self.inside = calls, 0

    def visit(self, node: ast.AST) -> ast.AST:
        if isinstance(node, ast.Lambda):
            return ast.Name("λ")
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and len(node.value) > STRING_SHOWN:
            return ast.Constant(node.value[:STRING_LEFT] + "…")
        if not (self.calls and isinstance(node, ast.Call)):
            return self.generic_visit(node)
        if self.inside:
            return ast.Call(self.visit(node.func), [ast.Name("…")] if node.args or node.keywords else [], [])
        func = self.visit(node.func)
        self.inside += 1
        given = [self.visit(x) for x in node.args], [ast.keyword(k.arg, self.visit(k.value)) for k in node.keywords]
        self.inside -= 1
        return ast.Call(func, *given)


def shown(expr: ast.AST) -> str:
    """An expression in one line: whole if it is short, else with long strings, lambdas and nested arguments left out, and only then cut."""
    text = ""
    for shorter, most in ((None, SHOWN), (_Shorter(False), SHOWN), (_Shorter(True), 2 * SHOWN)):
        if shorter:
            expr = shorter.visit(copy.deepcopy(expr))
        text = " ".join(ast.unparse(expr).split())
        if len(text) <= most:
            return text
    return text[: SHOWN - 1] + "…"


def _parts(n: ast.stmt) -> Iterator[tuple[str, int | None, list[ast.stmt], int]]:
    """What a compound statement says: (text, line, statements below, how deep below); nothing for others."""
    match n:
        case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
            documented = bool(n.body) and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant)
            yield f"class {n.name}:" if isinstance(n, ast.ClassDef) else f"def {n.name}(…):", n.lineno, n.body[documented:], 1
        case ast.If():
            word, rest = "if", [n]
            while len(rest) == 1 and isinstance(rest[0], ast.If):
                (test,) = rest
                yield f"{word} {shown(test.test)}:", test.lineno, test.body, 1
                word, rest = "elif", test.orelse
            if rest:
                yield "else:", None, rest, 1
        case ast.For() | ast.AsyncFor():
            yield f"for {shown(n.target)} in {shown(n.iter)}:", n.lineno, n.body, 1
        case ast.While():
            yield f"while {shown(n.test)}:", n.lineno, n.body, 1
        case ast.With() | ast.AsyncWith():
            held = (shown(i.context_expr) + (f" as {shown(i.optional_vars)}" if i.optional_vars else "") for i in n.items)
            yield f"with {', '.join(held)}:", n.lineno, n.body, 1
        case ast.Try():
            yield "try:", n.lineno, n.body, 1
            for h in n.handlers:
                yield "except" + (f" {shown(h.type)}" if h.type else "") + (f" as {h.name}" if h.name else "") + ":", h.lineno, h.body, 1
            if n.finalbody:
                yield "finally:", None, n.finalbody, 1
        case ast.Match():
            yield f"match {shown(n.subject)}:", n.lineno, [], 1
            for c in n.cases:
                yield f" case {shown(c.pattern)}:", None, c.body, 2


def _said(n: ast.stmt) -> str | None:
    """A simple statement that says something; None for one that is folded."""
    match n:
        case ast.Return(value=value) | ast.Raise(exc=value):
            word = "return" if isinstance(n, ast.Return) else "raise"
            return f"{word} {shown(value)}" if value else word
        case ast.Assert():
            return f"assert {shown(n.test)}"
        case ast.Break() | ast.Continue():
            return ast.unparse(n)
        case ast.AugAssign():
            sign = ast.unparse(ast.AugAssign(ast.Name("x"), n.op, ast.Name("y")))[2:-2]
            return f"{shown(n.target)} {sign} {shown(n.value)}"
        case ast.Assign() | ast.AnnAssign() if n.value is not None and any(isinstance(x, TELLING) for x in ast.walk(n.value)):
            return f"{', '.join(map(shown, getattr(n, 'targets', None) or [n.target]))} = {shown(n.value)}"
        case ast.Expr(value=ast.Call() | ast.Await() | ast.Yield() | ast.YieldFrom()):
            return shown(n.value)
    return None


def _notes(content: str) -> dict[int, str]:
    """Comments that stand behind code, by line; those on lines of their own are left out."""
    try:
        return {t.start[0]: t.string.rstrip() for t in tokenize.generate_tokens(io.StringIO(content).readline) if t.type == tokenize.COMMENT and t.line[: t.start[1]].strip()}
    except (tokenize.TokenError, IndentationError):
        return {}


def skeleton(content: str) -> list[str]:
    """What a program does, a space for each level: definitions, branches, loops, calls, telling assignments, each with the comment behind
    it; stretches of the rest folded to one mark."""
    try:
        tree = ast.parse(content)
    except SyntaxError:
        return []
    out: list[str] = []
    notes = _notes(content)

    def put(depth: int, text: str, line: int | None) -> None:
        note = notes.pop(line, None) if line else None
        out.append(" " * depth + text + (f"  {note}" if note else ""))

    def visit(body: list[ast.stmt], depth: int) -> None:
        for n in body:
            parts = list(_parts(n))
            for text, line, below, deeper in parts:
                put(depth, text, line)
                visit(below, depth + deeper)
            if parts:
                continue
            if (text := _said(n)) is not None:
                put(depth, text, n.lineno)
            elif out[-1:] != [" " * depth + "…"]:
                out.append(" " * depth + "…")

    visit(tree.body, 0)
    return out


def _mapped(files: DataFrame, rows, columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, letters = [], 0
            for p, c in zip(b["path"], b["content"], strict=True):
                out += ((p, *r) for r in rows(c or ""))
                letters += len(c or "")
                if letters >= LETTERS:
                    yield pd.DataFrame(out, columns=names)
                    out, letters = [], 0
            yield pd.DataFrame(out, columns=names)

    return spread(files.select("path", "content"), "path").mapInPandas(run, columns)


def nodes(files: DataFrame) -> DataFrame:
    return _mapped(files, node_rows, NODES)


def calls(files: DataFrame) -> DataFrame:
    return _mapped(files, call_rows, "caller_file string, caller_name string, callee_name string, line int")


def bodies(files: DataFrame) -> DataFrame:
    """(path, line_no, text): what stands below the header of the definition that each row's content is, as indented as it comes."""

    def body(content: str) -> Iterator[tuple[int, str]]:
        lines = skeleton("if 1:\n" + content) if content[:1] in (" ", "\t") else [" " + x for x in ["", *skeleton(content)]]
        return enumerate((x[2:] for x in lines[2:]), 1)

    return _mapped(files, body, "path string, line_no int, text string")


def skeletons(files: DataFrame) -> DataFrame:
    return _mapped(files, lambda c: enumerate(skeleton(c), 1), "path string, line_no int, text string")


def samples(spark: SparkSession) -> DataFrame:
    rows = [
        ("m.py", "import os\nimport sys\n\n\nclass A(Base):\n    '''Doc.'''\n\n    @property\n    def name(self) -> str:\n        if self.x:\n            return helper(self.x)\n        y = 1\n        return str(y)\n\n\ndef helper(v):\n    return v.strip()\n\n\nprint(helper('a'))\n"),
        ("broken.py", "def f(:\n"),
    ]
    return spark.createDataFrame(rows, "path string, content string")
