"""Trees, history and the pattern tier on small fixtures."""

from __future__ import annotations

import os
import subprocess

import pytest

from quarry.functions import pattern_tables
from quarry.operators import changes, imports
from quarry.sources import history, tree


@pytest.fixture
def repo(tmp_path):
    def git(*args, when="2024-01-01T00:00:00Z"):
        env = os.environ | {f"GIT_{who}_{what}": v for who in ("AUTHOR", "COMMITTER") for what, v in (("NAME", "a"), ("EMAIL", "a@b.c"), ("DATE", when))}
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True, capture_output=True, env=env)

    git("init", "-q")
    (tmp_path / "__init__.py").write_text("")
    (tmp_path / "a.py").write_text("one\ntwo\n")
    (tmp_path / "gone.py").write_text("x\n")
    (tmp_path / ".gitignore").write_text("*.log\nout/\n!keep.log\n")
    git("add", "-A")
    git("commit", "-qm", "first")
    (tmp_path / "a.py").write_text("one\nchanged\n")
    (tmp_path / "gone.py").unlink()
    git("add", "-A")
    git("commit", "-qm", "second", when="2024-06-01T00:00:00Z")
    return tmp_path


def test_tree_reads_hidden_names_and_obeys_rules(spark, repo):
    (repo / "x.log").write_text("no")
    (repo / "keep.log").write_text("yes")
    (repo / "out").mkdir()
    (repo / "out" / "b.py").write_text("no")
    (repo / "pic.dat").write_bytes(b"a\0b")
    (repo / "node_modules").mkdir()
    (repo / "node_modules" / "m.js").write_text("no")
    got = {r["path"]: r for r in tree.files(spark, str(repo)).collect()}
    assert set(got) == {"__init__.py", "a.py", "keep.log", "pic.dat"}  # rule files themselves are skipped
    assert got["pic.dat"]["is_binary"] and got["pic.dat"]["content"] is None
    assert got["a.py"]["language"] == "python" and got["a.py"]["content"] == "one\nchanged\n"
    assert {r["content"] for r in tree.files(spark, str(repo), contents=False).collect()} == {None}


def test_empty_tree(spark, tmp_path):
    assert tree.files(spark, str(tmp_path)).count() == 0


def test_history(spark, repo):
    root = str(repo)
    assert {(r["path"], r["churn"]) for r in changes.churn(history.commits(spark, root)).collect()} == {("__init__.py", 1), ("a.py", 2), (".gitignore", 1)}
    last = history.line_edits(root, spark.createDataFrame([("a.py",)], "path string"), since_epoch=1_714_000_000).collect()
    assert [(r["path"], r["line_no"]) for r in last] == [("a.py", 2)]
    (repo / "a.py").write_text("third\n")
    (repo / "new.py").write_text("n\n")
    assert {(r["path"], r["status"]) for r in history.changed(spark, root).collect()} == {("a.py", "M"), ("new.py", "?")}
    old = history.old_files(root, spark.createDataFrame([("a.py",), ("new.py",)], "path string")).collect()
    assert [(r["path"], r["content"]) for r in old] == [("a.py", "one\nchanged\n")]
    assert history.repo_root(str(repo / "a.py")) == os.path.realpath(root)


def test_no_history(spark, tmp_path):
    assert history.commits(spark, str(tmp_path)).count() == 0
    assert history.changed(spark, str(tmp_path)).count() == 0


SOURCES = [
    ("m.go", 'package main\nimport (\n\t"fmt"\n\tx "a/b"\n)\ntype T struct {\n}\nfunc (t *T) Run() {\n}\nfunc main() {\n}\n'),
    ("l.rs", "use std::io;\npub struct S;\nimpl Show for S {\npub fn go() {}\n}\nfn main() {}\n"),
    ("a.ts", "import {x} from './x'\nexport const f = async (a) => 1\nexport default class K {}\n"),
    ("A.java", "import java.util.List;\npublic class A {\n  public static void main(String[] a) {\n  }\n}\n"),
    ("q.sql", "CREATE TABLE IF NOT EXISTS t (\nid int);\ncreate schema s;\n"),
    ("r.md", "# Top\n## Sub ##\n[l](x.md) ![i](p.png)\n"),
    ("e.rb", None),
]


def test_patterns(spark):
    files = spark.createDataFrame(SOURCES, "path string, content string").selectExpr("*", f"{pattern_tables.language_of()} as language")
    nodes = {(r["path"], r["line_no"], r["type"], r["name"]) for r in pattern_tables.structures(files).collect()}
    assert nodes == {
        ("m.go", 6, "struct", "T"), ("m.go", 8, "method", "Run"), ("m.go", 10, "function", "main"),
        ("l.rs", 2, "struct", "S"), ("l.rs", 3, "impl", "Show for S"), ("l.rs", 4, "function", "go"), ("l.rs", 6, "function", "main"),
        ("a.ts", 2, "function", "f"), ("a.ts", 3, "class", "K"), ("A.java", 2, "class", "A"), ("A.java", 3, "method", "main"),
        ("q.sql", 1, "table", "t"), ("r.md", 1, "heading-1", "Top"), ("r.md", 2, "heading-2", "Sub"),
    }
    found = {(r["path"], r["type"], r["name"]) for r in pattern_tables.imports(files).collect()}
    grouped = {(r["path"], r["type"], r["name"]) for r in imports.grouped(files).collect()}
    assert grouped == {("m.go", "import", "fmt"), ("m.go", "import", "a/b"), ("l.rs", "std", "std::io")}
    assert found == {("a.ts", "import", "./x"), ("A.java", "import", "java.util.List"), ("r.md", "image", "p.png"), ("r.md", "link", "x.md")}
    entries = {(r["path"], r["type"], r["name"]) for r in pattern_tables.entry_points(files).collect()}
    assert entries == {("m.go", "main_function", "main"), ("l.rs", "main_function", "main"), ("a.ts", "default_export", "K"), ("A.java", "main_function", "main"), ("q.sql", "schema", "s")}


def test_every_pattern_compiles(spark):
    files = spark.createDataFrame([(f"x.{exts.split()[0]}", "class A { }\nimport x\n") for exts in pattern_tables.EXTENSIONS.values()], "path string, content string").selectExpr("*", f"{pattern_tables.language_of()} as language")
    for find in (pattern_tables.structures, pattern_tables.imports, pattern_tables.entry_points):
        assert find(files).count() >= 0
