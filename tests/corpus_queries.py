"""Questions to the small source tree of ``corpus``, whose answers stand in ``expected``: they read no driver table, and are tests."""

from __future__ import annotations

from collections.abc import Callable

import corpus
from expected import EXPECTED
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import config_files, images, pattern_tables, python_source
from quarry.operators import changes, condense, consensus, graphs, health, imports, markup, nodes, paths, report, rules, text, views
from quarry.plans import tools
from quarry.scratch import staged

QUESTIONS: dict[str, Callable] = {}
ANSWERS: dict[str, str] = {}


def planted(f: Callable) -> Callable:
    """A question to the corpus; its rows stand in ``expected``."""
    QUESTIONS[f.__name__] = f
    ANSWERS[f.__name__] = values(*EXPECTED[f.__name__])
    return f


def query(sql: str) -> Callable:
    def registered(f: Callable) -> Callable:
        QUESTIONS[f.__name__], ANSWERS[f.__name__] = f, sql
        return f

    return registered


def _value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of a table of literal rows; columns are "name type, ..."."""
    fields = [c.rsplit(" ", 1) for c in columns.split(", ")]
    casts = ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, t in fields)
    names = ", ".join(f'"{n}"' for n, _ in fields)
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) AS t({names})"


_facts: dict[tuple, tools.Facts] = {}


def facts_of(spark, names: tuple[str, ...] | None = None) -> tools.Facts:
    """The tables of the corpus, or of some of its files, parsed once by each application."""
    key = spark.sparkContext.applicationId, names
    if key not in _facts:
        _facts[key] = tools.Facts(corpus.files(spark, names))
    return _facts[key]


@planted
def tree_languages(spark, d):
    """What the walks of the analysis and of a directory scan take, and what each file is for."""
    rows = corpus.files(spark)
    return rows.selectExpr(
        "path", "language", f"{rules.below_skipped('path')} or {rules.skip_file(rules.name_of('path'))} as walk_skips", f"coalesce({rules.analyze_skips('language', 'path')}, false) as analyze_skips", f"coalesce({rules.scan_skips('language', rules.name_of('path'))}, false) as scan_skips",
        f"coalesce({rules.low_value('language', 'path', 'size')}, false) as low_value", f"{rules.is_source('path')} as is_source", f"{rules.cluster('language', 'path', 'content')} as cluster",
    )


@planted
def default_exclusions(spark, d):
    return paths.ignored(corpus.files(spark).select("path"), paths.ignore_rules(rules.DEFAULT_EXCLUSIONS + "docs/*\n!docs/guide.md\n")).where("ignored")


@planted
def glob_matches(spark, d):
    rows = corpus.files(spark).select("path")
    globs = [g for p in ("**/*", "**/*.{py,ts}", "app/*", "**/org/*/*.java", "*.json", "**/main.?") for g in paths.expand_braces(p)]
    out = None
    for g in globs:
        one = rows.where(rules.glob_match("path", g)).groupBy(F.lit(g).alias("glob")).agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))
        out = one if out is None else out.unionByName(one)
    return out


@planted
def source_structures(spark, d):
    return pattern_tables.structures(corpus.files(spark))


@planted
def source_imports(spark, d):
    return pattern_tables.imports(corpus.files(spark))


@planted
def source_entry_points(spark, d):
    found = facts_of(spark).entry_points
    return found.selectExpr("path", "type", "name", "line", f"{views.entry_label('language', 'type', 'name', 'line', 'framework')} as label")


@planted
def source_calls(spark, d):
    return pattern_tables.calls(corpus.files(spark)).where("caller_file not like 'app/%'")


@planted
def source_definitions(spark, d):
    """Definitions of the pattern tier, parents unknown."""
    return pattern_tables.definitions(corpus.files(spark)).where("file not like '%.py'")


@planted
def source_import_edges(spark, d):
    return facts_of(spark).edges


@planted
def config_references(spark, d):
    return config_files.imports(corpus.files(spark).where("language = 'config'"))


@planted
def config_entry_points(spark, d):
    return config_files.entry_points(corpus.files(spark).where("language = 'config'"))


@planted
def sql_table_columns(spark, d):
    return config_files.sql_columns(corpus.files(spark).where("language = 'sql'"))


@planted
def css_rule_counts(spark, d):
    return config_files.css_rules(corpus.files(spark).where("language = 'css'"))


@planted
def html_element_counts(spark, d):
    return config_files.html_counts(corpus.files(spark).where("language = 'html'"))


@planted
def parsed_nodes(spark, d):
    """Nodes of the syntax tier and of the line tier; files with an error fall back to patterns."""
    found = facts_of(spark).nodes.where("tier <> 'pattern' or path like '%.py'")
    return found.selectExpr("path", "node_id", "parent_id", "last_desc_id", "depth", "type", "name", "start_line", "end_line", "signature", "array_join(decorators, ' ') as decorators", "docstring", "lines", "branches", "tier")


@planted
def heading_tree(spark, d):
    return nodes.headings(text.lines(corpus.files(spark).where("language = 'markdown'")))


@planted
def text_outline(spark, d):
    return nodes.outline(text.lines(corpus.files(spark).where("language = 'text'")))


@planted
def node_definitions(spark, d):
    return nodes.definitions(python_source.nodes(corpus.files(spark).where("path like 'app/%.py'"))).selectExpr("file", "type", "name", "line", "signature", "parent", "enclosing_kind")


@planted
def node_candidates(spark, d):
    return nodes.candidates(facts_of(spark).nodes.where("path like '%.py' and tier = 'syntax'")).select("path", "name")


@planted
def structure_filters(spark, d):
    every = facts_of(spark).nodes
    wanted = {"type": {"type_filter": "method"}, "name": {"name_pattern": "^s.*e"}, "decorator": {"has_decorator": "router.post"}, "complexity": {"min_complexity": 5, "type_filter": "method"}}
    out = None
    for name, f in wanted.items():
        rows = nodes.filtered(every, **f).select(F.lit(name).alias("filter"), "path", "name")
        out = rows if out is None else out.unionByName(rows)
    return out


@planted
def focus_view(spark, d):
    facts = facts_of(spark, ("app/store.py",))
    return tools.focused(facts, "Store.size").unionByName(tools.focused(facts, "s")).select("node_id", "part", "line")


@planted
def node_key_changes(spark, d):
    """Keys of the nodes of two versions, what has become of each, and the summary of each file."""
    old = corpus.files(spark, ["app/util.py", "app/store.py"])
    new = old.withColumn("content", F.expr("replace(replace(replace(content, 'return str(v)', 'return repr(v)'), 'def leftover', 'def renamed'), '        return row\\n\\n', '        return row   \\n\\n\\n')"))
    diff = tools.node_changes(old, new)
    return diff.join(changes.diff_summary(diff), "path")


@planted
def delta_view(spark, d):
    """Unchanged nodes keep their header alone."""
    rows = spark.createDataFrame([("f", "/function:a", "x"), ("f", "/function:b", "y"), ("f", "/function:c", "z")], "path string, node_key string, skeleton string")
    diff = spark.createDataFrame([("f", "/function:a", "unchanged"), ("f", "/function:b", "changed"), ("f", "/function:gone", "removed")], "path string, node_key string, status string")
    return changes.apply_delta(rows, diff).select("node_key", "status", "skeleton")


@planted
def tree_view(spark, d):
    """The whole scan of two files: signatures, decorators, docs, skeletons of salient nodes."""
    return tools.scan(facts_of(spark, ("app/store.py", "docs/guide.md"))).select("path", "node_id", "part", "line")


@planted
def tree_view_within_budget(spark, d):
    return tools.scan(facts_of(spark, ("app/store.py",)), tokens=14).select("node_id", "part", "line")


@planted
def directory_lines(spark, d):
    return tools.directory_view(facts_of(spark, ("app/util.py", "app/store.py", "web/page.ts")))


@planted
def nested_view(spark, d):
    return views.nested_lines(facts_of(spark).nodes.where("path in ('app/store.py', 'srv/main.go')")).select("path", "node_id", "line")


@planted
def folded_lines(spark, d):
    """The skeleton of languages without a syntax tree."""
    return condense.skeleton(text.lines(corpus.files(spark, ["web/page.ts", "srv/main.go"])))


@planted
def comment_folds(spark, d):
    rows = spark.createDataFrame([("a.css", "css", i, t) for i, t in enumerate(["/* one", " two", "*/", "p {", "  /* three */", "  color: red;", "}", "// four", "q"], 1)], "path string, language string, line_no int, text string")
    return condense.compact(rows).select("line_no", "text")


@planted
def structure_totals(spark, d):
    return nodes.structure_counts(facts_of(spark).nodes, corpus.files(spark)).selectExpr("*", f"{views.stats_label('files', 'classes', 'functions', 'methods')} as label")


@planted
def file_spans(spark, d):
    return nodes.line_spans(facts_of(spark).nodes)


@planted
def route_verdicts(spark, d):
    return health.orphan_routes(corpus.files(spark), facts_of(spark).nodes)


@planted
def template_verdicts(spark, d):
    return health.orphan_templates(corpus.files(spark))


@planted
def distinctive_tokens(spark, d):
    routes = [("/users/{id}/profile",), ("/a/b",), ("/konto/:id/hint-page",), ("/health",), ("/same/size/four",), ("/static/x.css",)]
    return spark.createDataFrame(routes, "route string").selectExpr("route", f"{rules.distinctive('route')} as token", f"{rules.is_external('route')} as external")


@planted
def dead_definitions(spark, d):
    return facts_of(spark).dead()


@planted
def off_graph_rules(spark, d):
    rows = [
        ("python", "visit_x", "method", [], "class", "A"), ("python", "x", "function", [], None, None), ("typescript", "x", "method", ["private"], "class", "A"), ("typescript", "x", "method", [], "class", "A"), ("go", "Open", "function", [], None, None), ("go", "open", "function", [], None, None),
        ("rust", "f", "function", [], "impl", "Show for A"), ("rust", "f", "function", [], "impl", "A"), ("java", "f", "method", ["public"], "class", "A"), ("java", "f", "method", ["private"], "class", "A"), ("csharp", "f", "method", ["internal"], "class", "A"), ("cpp", "f", "function", ["static"], None, None),
        ("cpp", "f", "function", [], "namespace", "n"), ("cpp", "f", "method", ["private"], "class", "A"), ("cpp", "f", "method", ["private", "virtual"], "class", "A"), ("php", "__get", "method", ["private"], "class", "A"), ("php", "f", "method", ["private"], "class", "A"), ("swift", "f", "method", ["override"], "class", "A"),
        ("swift", "f", "method", [], "class", "A"), ("zig", "f", "function", ["pub"], None, None), ("zig", "f", "function", [], None, None), ("ruby", "f", "method", [], "class", "A"),
    ]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, language string, name string, kind string, modifiers array<string>, enclosing string, parent string")
    return table.selectExpr("id", "language", "name", f"{rules.reachable_off_graph('language', 'name', 'kind', 'modifiers', 'enclosing', 'parent')} as reachable", f"language in ({rules.listed(rules.CLAIMS_DEAD)}) as claims_dead", f"{rules.is_public('modifiers')} as public")


@planted
def protocol_witnesses(spark, d):
    rows = [
        ("a.swift", "protocol", "Runs", None, None), ("a.swift", "method", "start", "Runs", None), ("a.swift", "struct", "Job", None, ": Runs, Hashable"), ("a.swift", "method", "start", "Job", None), ("a.swift", "method", "hash", "Job", None), ("a.swift", "method", "spare", "Job", None),
        ("b.swift", "class", "View", None, ": UIView where T: X"), ("b.swift", "method", "layout", "View", None), ("b.swift", "struct", "Plain", None, None), ("b.swift", "method", "own", "Plain", None),
    ]
    table = spark.createDataFrame(rows, "file string, type string, name string, parent string, signature string")
    return nodes.witnesses(table, spark.createDataFrame([("Hashable", "hash")], "protocol string, member string"))


@planted
def flaggable_nodes(spark, d):
    facts = facts_of(spark)
    return health.flaggable(facts.nodes.where("tier = 'syntax'"), facts.entry_points.select("name"))


@planted
def health_report(spark, d):
    return tools.health_of(facts_of(spark))


@planted
def review_report(spark, d):
    facts = facts_of(spark)
    drift = spark.createDataFrame([("app/util.py:helper", "clean", "check"), ("other.py:x", "a", "b")], "site string, anchor string, missing string")
    return report.tail_lines(staged(facts.orphans(), "orphans"), staged(facts.dead(), "dead"), drift, staged(corpus.files(spark, ["app/util.py", "app/main.py", "web/page.ts"]).select("path"), "changed"))


def _family(spark) -> tuple[DataFrame, DataFrame]:
    """Nine functions of one family, of which one leaves out a call; callers of noise beside them."""
    calls = [("m.py", f"extract_{i}", c) for i in range(8) for c in ("read_node", "record", "append")] + [("m.py", "extract_odd", "read_node"), ("m.py", "extract_odd", "append"), ("m.py", None, "record"), ("tests/t.py", "try_it", "read_node")]
    calls += [("m.py", f"noise{i}", f"only{i}") for i in range(24)]
    names = sorted({c for *_, c in calls} | {c for _, c, _ in calls if c})
    return spark.createDataFrame([("m.py", n) for n in names], "file string, name string"), spark.createDataFrame(calls, "caller_file string, caller_name string, callee_name string")


FAMILY = """WITH c AS (SELECT 'm.py:extract_' || i AS cid, x AS callee FROM range(8) r(i), (VALUES ('read_node'), ('record')) v(x) UNION ALL VALUES ('m.py:extract_odd', 'read_node') UNION ALL SELECT 'm.py:noise' || i, 'only' || i FROM range(24) r(i))"""


@query(FAMILY + " SELECT * FROM c")
def family_bags(spark, d):
    return consensus.usage(*_family(spark))


@query(
    FAMILY
    + """, n AS (SELECT callee, count(*) AS callers, count(*) / (SELECT count(DISTINCT cid) FROM c) AS rate FROM c GROUP BY callee),
p AS (SELECT x.callee AS anchor, y.callee AS other, count(*) AS together FROM c x JOIN c y ON x.cid = y.cid AND x.callee <> y.callee GROUP BY 1, 2),
r AS (SELECT p.*, na.callers, no.rate FROM p JOIN n na ON anchor = na.callee JOIN n no ON other = no.callee WHERE na.callers >= 3 AND together > na.callers * 0.5 AND together < na.callers),
t AS (SELECT *, unnest(generate_series(together, callers)) AS j FROM r),
s AS (SELECT anchor, other, together, callers, -ln(sum(exp(lgamma(callers + 1) - lgamma(j + 1) - lgamma(callers - j + 1) + j * ln(rate) + (callers - j) * ln(1 - rate)))) / ln(10) AS e FROM t GROUP BY ALL)
SELECT 'm.py:extract_odd' AS site, anchor, other AS missing, together, callers, round(e * -log10((callers - together) / (callers + 1)), 5) AS strength, 'm.py:extract_0 m.py:extract_1 m.py:extract_2' AS peers FROM s WHERE e >= 3"""
)
def family_findings(spark, d):
    bags = consensus.usage(*_family(spark))
    held = consensus.audit(consensus.candidates(bags))
    sites = consensus.same_role(consensus.missing_sites(held, bags), held, bags)
    return consensus.findings(sites, held, bags).selectExpr("site", "anchor", "missing", "together", "callers", "round(strength, 5) as strength", "array_join(peers, ' ') as peers")


@planted
def family_lines(spark, d):
    bags = consensus.usage(*_family(spark))
    held = consensus.audit(consensus.candidates(bags))
    return consensus.divergence_lines(consensus.findings(consensus.missing_sites(held, bags), held, bags))


@planted
def role_lenses(spark, d):
    """Sites that each lens keeps: one of the peers' kind, one of another name, file cluster, and degree."""
    calls = [(f"a{i}.py:load_{i}", c) for i in range(6) for c in ("open_it", "close_it", "log_it")] + [(s, c) for s in ("b.py:load_x", "b.py:scan_x", "t.py:load_y") for c in ("open_it", "log_it")] + [("b.py:load_z", c) for c in ("open_it", *(f"more{k}" for k in range(7)))]
    bags = spark.createDataFrame(calls, "cid string, callee string")
    held = spark.createDataFrame([("open_it", "close_it")], "anchor string, other string")
    sites = consensus.missing_sites(held.selectExpr("*", "6L as together", "10L as callers", "1D as strength"), bags)
    files = spark.createDataFrame([(f"a{i}.py", "core_logic") for i in range(6)] + [("b.py", "core_logic"), ("t.py", "tests")], "path string, cluster string")
    out = None
    for lenses in ((), ("name",), ("cluster",), ("graph",), ("name", "cluster", "graph")):
        rows = consensus.same_role(sites, held, bags, files, lenses).select(F.lit("+".join(lenses)).alias("lenses"), "site")
        out = rows if out is None else out.unionByName(rows)
    return out


@planted
def noise_callees(spark, d):
    return spark.createDataFrame([("append",), ("len",), ("record",), ("ValueError",), ("splitlines",), ("read_node",)], "name string").selectExpr("name", f"{rules.is_noise('name')} as noise", f"{rules.name_role('name')} as role")


@planted
def important_files(spark, d):
    facts = facts_of(spark)
    return graphs.important_files(facts.file_nodes, graphs.hot(facts.call_nodes))


@planted
def file_inventory(spark, d):
    facts = facts_of(spark)
    return report.inventory(facts.file_nodes, graphs.important_files(facts.file_nodes, graphs.hot(facts.call_nodes)))


@planted
def cluster_totals(spark, d):
    return report.clusters(facts_of(spark).clusters)


@planted
def cluster_contents(spark, d):
    facts = facts_of(spark)
    return report.cluster_members(facts.clusters, nodes.members(facts.definitions, facts.call_nodes))


@planted
def file_members(spark, d):
    facts = facts_of(spark)
    return nodes.members(facts.definitions, facts.call_nodes).where("file like 'app/%'").selectExpr("file", "type", "name", "round(centrality, 6) as centrality", "rank")


@planted
def next_steps(spark, d):
    facts = facts_of(spark)
    return report.recommended(facts.files.selectExpr("path", "mtime / 86400 as age"), facts.file_nodes, graphs.hot(facts.call_nodes))


@planted
def preview_report(spark, d):
    return tools.preview(corpus.files(spark), facts=facts_of(spark)).selectExpr("section", "turn", "line")


@planted
def search_report(spark, d):
    return tools.search_structures(facts_of(spark), "return|fetch").select("path", "type", "name", "hits", "file_total")


@planted
def collapsed_folders(spark, d):
    from quarry.sources import tree

    dirs = tree.summary(corpus.files(spark)).selectExpr("if(dir = '', '.', dir) as dir", "if(parent = '', '.', parent) as parent", "name", "n_files", "size")
    return paths.collapsed(dirs).where("dir not like '%/%'").select("dir", "label", "n_files", "size")


@planted
def python_call_rows(spark, d):
    return python_source.calls(corpus.files(spark).where("path like 'app/%.py'"))


@planted
def image_colours(spark, d):
    return images.colours(images.painted(spark)).selectExpr("path", "rank", "colour", "round(share, 4) as share")


@planted
def template_rows(spark, d):
    return markup.template_nodes(markup.samples(spark))


@planted
def page_elements(spark, d):
    """Elements and template blocks of pages, each element with the block around it."""
    pages = spark.createDataFrame([("p.html", "<!doctype html>\n<main id='top'>\n<h1>One <b>two</b></h1>\n{% block body %}\n<ul>\n{% for x in xs %}\n<li id='{{ x }}'>a</li>\n{% endfor %}\n</ul>\n{% endblock %}\n</main>\n<form><input>")], "path string, content string")
    return markup.with_templates(pages.unionByName(corpus.files(spark).where("language = 'html'").select("path", "content")))


@planted
def type_references(spark, d):
    names = spark.createDataFrame([("a.swift", "swift", "View"), ("a.swift", "swift", "Gone"), ("b.swift", "swift", "View")], "path string, language string, name string")
    return imports.by_type(names, spark.createDataFrame([("z.swift", "View", 1), ("b.swift", "View", 9), ("b.swift", "View", 2)], "file string, name string, line int"))
