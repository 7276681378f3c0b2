"""Condensed forms, focus, import targets and views on small inputs."""

from __future__ import annotations

from quarry.operators import condense, graphs, imports, views


def lines(spark, text, language="python"):
    return spark.createDataFrame([("f", language, i + 1, x) for i, x in enumerate(text)], "path string, language string, line_no bigint, text string")


def ordered(df):
    return [r.text for r in df.orderBy("line_no").collect()]


def test_depth_limit_ranks_widths_and_marks_once(spark):
    text = ["class A", "\tdef f", "\t\tx = 1", "\t\ty = 2", "    def g", "  \t  z = 3"]
    assert ordered(condense.depth_limit(lines(spark, text), 2)) == ["class A", "\tdef f", "  …", "    def g", "  …"]
    assert condense.depth_limit(lines(spark, []), 1).count() == 0


def test_compact_drops_blanks_closers_and_folds_comments(spark):
    text = ["def f():", "", "    # one", "    # two", "    return {  ", "    }", "# end"]
    assert ordered(condense.compact(lines(spark, text))) == ["def f():", "    …", "    return {", "…"]
    assert ordered(condense.compact(lines(spark, ["// a", "x();"], "go"))) == ["…", "x();"]


def test_focus_tiers(spark):
    nodes = spark.createDataFrame([("f", 1, "A", []), ("f", 2, "B", ["A"]), ("f", 3, "run", ["A", "B"]), ("f", 4, "runner", [])], "path string, node_id int, name string, ancestors array<string>")
    got = {(r.focus, r.node_id, r.tier) for r in condense.focus(nodes, ["run", "A.run", "B.A.run", "RUN", "none"]).collect()}
    assert got == {("run", 3, 1), ("A.run", 3, 2), ("RUN", 3, 3), ("RUN", 4, 3)}


def test_import_targets_by_language(spark):
    files = ["app/main.py", "app/util.py", "src/core/__init__.py", "web/a.ts", "web/lib/b/index.ts", "src/main/java/x/Y.java", "css/_base.scss", "css/site.scss", "src/net.rs", "src/main.rs"]
    found = [("app/main.py", "python", ".util"), ("app/main.py", "python", "core"), ("app/main.py", "python", "os"), ("app/main.py", "python", None), ("web/a.ts", "typescript", "./lib/b"), ("web/a.ts", "typescript", "react"), ("z/Z.java", "java", "x.Y"), ("css/site.scss", "scss", "base"), ("src/main.rs", "rust", "net"), ("src/main.rs", "rust", "crate::net::{a, b}"), ("web/a.ts", "cobol", "a")]
    edges = graphs.import_edges(imports.candidates(spark.createDataFrame(found, "path string, language string, name string")), spark.createDataFrame([(f,) for f in files], "path string"))
    assert {(r.src, r.dst) for r in edges.collect()} == {
        ("app/main.py", "app/util.py"), ("app/main.py", "src/core/__init__.py"), ("web/a.ts", "web/lib/b/index.ts"), ("z/Z.java", "src/main/java/x/Y.java"), ("css/site.scss", "css/_base.scss"), ("src/main.rs", "src/net.rs"),
    }


def test_views(spark):
    df = spark.createDataFrame([(0, "0B"), (9, "9B"), (10, "10.0B"), (1024, "1KB"), (12544, "12.2KB"), (5 * 1024**4, "5.0TB"), (None, None)], "s bigint, want string")
    assert all(r.got == r.want or r.s is None for r in df.selectExpr("s", "want", f"{views.size_label('s')} as got").collect())
    nodes = spark.createDataFrame([("f", 1, 0, "class", "A", None, 3, "Doc."), ("f", 2, 1, "method", "m", "(self)", 4, "")], "path string, node_id int, depth int, type string, name string, signature string, start_line int, doc string")
    assert [r.line for r in views.tree_lines(nodes).orderBy("node_id").collect()] == ["- A @3 # Doc.", "  - m (self) @4"]
    assert "signature" not in views.as_json(nodes).where("node_id = 1").first().json
    names = spark.createDataFrame([("g", i, f"n{i}") for i in range(7)] + [("h", 1, "x")], "g string, i int, name string")
    assert {r.g: r.line for r in views.compact_line(names, "g", "name", "i").collect()} == {"g": "n0, n1, n2, n3, n4, ... (7 total)", "h": "x"}
