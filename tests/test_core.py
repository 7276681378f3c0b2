"""Operators of the library on hand-computed facts, and every query against its SQL."""

from __future__ import annotations

import os

import pytest
from oracle import differences, frames

import __spark_entry__ as entry
from quarry.functions import images, python_source
from quarry.operators import changes, consensus, graphs, health, markup, paths, ranking, text
from quarry.streaming import memory

SF = "/root/testdata/sf0.001"
OWN = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, name):
    assert differences(*frames(spark, SF, name)) == ""


def facts(spark, defs, calls):
    return spark.createDataFrame(defs, "fqn string, name string, parent string"), spark.createDataFrame(calls, "caller_name string, callee_name string")


def test_ambiguous_names_share_one_call(spark):
    d, c = facts(spark, [("a:target", "target", None), ("b:target", "target", None), ("a:caller", "caller", None)], [("caller", "target"), ("caller", "target"), ("caller", "caller")])
    n = {r["fqn"]: r for r in graphs.call_nodes(d, graphs.call_edges(d, c)).collect()}
    assert (n["a:target"]["in_weight"], n["b:target"]["in_weight"], n["a:caller"]["out_weight"]) == (0.5, 0.5, 1.0)
    assert {n[x]["centrality"] for x in n} == {1.0}


def test_contract_counts_callers(spark):
    d, c = facts(spark, [("a:f", "f", "K")], [("f", "x"), ("K", "x"), ("gone", "x"), (None, "x")])
    assert tuple(graphs.contract_health(d, c).first()) == (3, 2, 1, 2 / 3)


def test_consensus_finds_the_outlier(spark):
    rows = [(f"extract_{i}", x) for i in range(8) for x in ("read_node", "record")] + [("extract_outlier", "read_node")] + [(f"noise{i}", f"n{i}") for i in range(24)]
    bags = spark.createDataFrame(rows, "cid string, callee string")
    rules = consensus.candidates(bags)
    found = {(r["anchor"], r["other"]): r for r in rules.collect()}
    rule = found["read_node", "record"]
    assert (rule["together"], rule["callers"]) == (8, 9) and rule["strength"] == pytest.approx(4.075, abs=5e-3)
    sites = consensus.missing_sites(consensus.audit(rules), bags).collect()
    assert [(s["site"], s["missing"]) for s in sites] == [("extract_outlier", "record")]
    assert consensus.review(consensus.missing_sites(rules, bags), spark.createDataFrame([("other",)], "site string")).count() == 0


def test_last_preorder_span_wins(spark):
    spans = spark.createDataFrame([("f", 1, 1, 100), ("f", 2, 10, 20), ("f", 3, 15, 30)], "path string, node_id int, start_line long, end_line long")
    points = spark.createDataFrame([("f", 5), ("f", 17), ("f", 12), ("f", 200)], "path string, line_no long")
    assert {r["line_no"]: r["node_id"] for r in text.containing(points, spans).collect()} == {5: 1, 17: 3, 12: 2, 200: None}


def test_commits_are_their_own_clock(spark):
    c = spark.createDataFrame([("1", "2019-06-01", "a.py"), ("2", "2020-01-01", "b.py"), ("3", "2020-03-01", "b.py")], "commit_id string, ts string, path string").selectExpr("commit_id", "cast(ts as timestamp) as ts", "path")
    assert {r["path"]: r["churn"] for r in changes.churn(changes.active_window(c)).collect()} == {"b.py": 2}


def test_node_diff_labels(spark):
    t = "path string, node_key string, digest string"
    old, new = spark.createDataFrame([("f", "a", "1"), ("f", "b", "2"), ("f", "gone", "3")], t), spark.createDataFrame([("f", "a", "1"), ("f", "b", "9"), ("f", "c", "4")], t)
    assert {r["node_key"]: r["status"] for r in changes.node_diff(old, new).collect()} == {"a": "unchanged", "b": "changed", "gone": "removed", "c": "new"}


def test_patterns(spark):
    assert sorted(paths.expand_braces("a.{b,c{d,e}}")) == ["a.b", "a.cd", "a.ce"]
    f = spark.createDataFrame([("build/x.py",), ("src/a.log",), ("src/keep.log",), ("build/keep.log",), ("a.py",)], "path string")
    got = {r["path"]: r["ignored"] for r in paths.ignored(f, paths.ignore_rules("build/\n*.log\n!keep.log\n# note\n")).collect()}
    assert got == {"build/x.py": True, "src/a.log": True, "src/keep.log": False, "build/keep.log": True, "a.py": False}


def test_budget_and_saliency(spark):
    n = spark.createDataFrame([("f", i, 10 - i, 10, float(i), 1.0, 2.0, 0) for i in range(10)], "path string, node int, score int, cost int, info double, novelty double, centrality double, churn int")
    assert ranking.within_budget(n, "path", "score", "node", "cost", 30).where("kept").count() == 3
    assert ranking.top_share(n, "path", "score", "node").count() == 2
    assert ranking.saliency(n, "path").orderBy("saliency", ascending=False).first()["node"] == 9


def test_orphans(spark):
    p, c = spark.createDataFrame([(1, "used"), (2, "dead"), (3, "")], "pid int, token string"), spark.createDataFrame([("x /used/1",)], "text string")
    assert [r["pid"] for r in health.orphans(p, c).collect()] == [2]
    part = spark.createDataFrame([(1, "se"), (2, "used/1"), (3, "xx"), (4, "d/1")], "pid int, token string")
    assert sorted(r["pid"] for r in health.orphans(part, c).collect()) == [3]


def test_parsers(spark):
    n = {(r["path"], r["name"]): r for r in python_source.nodes(python_source.samples(spark)).collect()}
    assert n["m.py", "name"]["type"] == "method" and n["m.py", "A"]["last_desc_id"] == n["m.py", "name"]["node_id"] and n["m.py", "imports"]["end_line"] == 2
    calls = {(r["caller_name"], r["callee_name"]) for r in python_source.calls(python_source.samples(spark)).collect()}
    assert ("name", "helper") in calls and (None, "print") in calls
    t = {(r["path"], r["name"]): r for r in markup.template_nodes(markup.samples(spark)).collect()}
    assert t["a.html", "for x in xs"]["end_line"] == 4 and t["a.html", "x.name"]["parent_id"] == t["a.html", "for x in xs"]["node_id"]
    assert [tuple(r)[1:] for r in images.meta(images.samples(spark)).orderBy("path").collect()] == [("PNG", 64, 32, True), ("GIF", 5, 7, False), (None, None, None, None)]


def test_scan_memory_expires(spark):
    turns = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 9, "b")], "conv_id long, turn long, text string")
    got = [r["label"] for r in memory.replay_versions(spark, turns).orderBy("at").collect()]
    assert got == ["first", "unchanged", "changed", "first"]


def test_incremental_keeps_and_renews(spark):
    known, files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, fingerprint string"), spark.createDataFrame([("a", "1"), ("b", "2")], "path string, fingerprint string")
    fresh, kept = memory.incremental(known, files)
    assert [r["path"] for r in fresh.collect()] == ["b"] and [r["path"] for r in kept.collect()] == ["a"]


def test_cooccurrence_of_hubs(spark, monkeypatch):
    rows = [(f"c{i}", f"f{j}") for i in range(4) for j in range(30 if i == 0 else 3 + i)]
    bags = spark.createDataFrame(rows, "cid string, callee string")
    want = {tuple(r) for r in consensus.cooccurrence(bags).collect()}
    monkeypatch.setattr(consensus, "HUB", 4)
    assert {tuple(r) for r in consensus.cooccurrence(bags).collect()} == want and len(want) == 30 * 29


def test_tokens_meet_texts_by_their_rarest_gram(spark):
    texts = spark.createDataFrame([(f"/api/v{i}/users/list",) for i in range(50)] + [("/api/v1/zebra",), ("ab",), ("",)], "text string")
    tokens = spark.createDataFrame([("/api/v1/zebra",), ("/api/v1/quagga",), ("/api/v7/users",), ("ab",), ("b",), ("xyz",), ("api/v49/users/list",), ("/api/v50",), ("",)], "token string")
    assert sorted(r["token"] for r in health.holding(tokens, texts).collect()) == ["/api/v1/zebra", "/api/v7/users", "ab", "api/v49/users/list", "b"]


def test_condensed_python():
    source = 'import os\nclass A(B):\n    """Doc."""\n    x: int = 3\n    @deco\n    async def f(self, a):\n        "doc"\n        y = 1\n        z = a + 1  # sum\n        y //= 2\n        if a:  # first\n            return g(a)  # never\n        elif b > 2:\n            pass\n        else:\n            x.y(1)\n        with open(p) as q, r: w()\n        try:\n            t()\n        except (E, F) as e:\n            raise\n        finally:\n            u()\n        match v:\n            case 1: yield z\n        assert a, "m"\n        foo(bar(1, 2, baz=3), lambda k: k + 1, "a very long string that goes on", qux(), more_arguments_here, 12345)\n        # alone\n        return\n'
    assert python_source.skeleton(source) == [
        "…", "class A:", " …", " def f(…):", "  …", "  z = a + 1  # sum", "  y //= 2", "  if a:  # first", "   return g(a)  # never", "  elif b > 2:", "   …", "  else:", "   x.y(1)", "  with open(p) as q, r:", "   w()", "  try:", "   t()",
        "  except (E, F) as e:", "   raise", "  finally:", "   u()", "  match v:", "   case 1:", "    (yield z)", "  assert a", "  foo(bar(…), λ, 'a very long s…', qux(), more_arguments_here, 12345)", "  return",
    ]
    assert python_source.skeleton("def f(:") == [] and python_source.skeleton("") == [] and python_source.skeleton("x = [" + "a.b, " * 60 + "f()]")[0].endswith("…")
