"""What keeps tasks and the driver small as tables grow."""

from __future__ import annotations

import re

import pytest

from quarry import scratch
from quarry.functions import brackets, python_source
from quarry.operators import changes, declarations, graphs, health, imports, nodes
from quarry.streaming import memory


@pytest.fixture
def table(spark, tmp_path):
    """Rows by SQL over ``id`` as a table of one file."""

    def make(n: int, *columns: str):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        spark.range(n).selectExpr(*columns).coalesce(1).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def grown(monkeypatch):
    """Every table counts as one that is too large to be sent."""
    monkeypatch.setattr(scratch, "SENT", 0)


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_conformances_are_dealt(table, grown):  # F4
    defined = table(100, "concat('w', id) as file", "if(id % 2 = 0, 'struct', 'method') as type", "concat('n', id) as name", "if(id % 2 = 1, concat('n', id - 1), null) as parent", "': Unknown' as signature")
    found = nodes.witnesses(defined, table(1, "'P' as protocol", "'m' as member"))
    assert "BroadcastExchange" not in planned(found) and found.count() == 50


def test_links_are_dealt(table, grown):  # F5
    rows = table(90, "array('go', 'csharp', 'python')[id % 3] as language", "concat('d', id, '/a', array('.go', '.cs', '.py')[id % 3]) as path", "concat('d', (id + 3) % 90, array('', '.a', '.a')[id % 3]) as name")
    found = imports.edges(rows, rows.select("path"))
    assert "BroadcastExchange" not in planned(found) and found.count() == 90


def test_files_of_one_split_go_to_many_tasks(table):  # F7, F20, F25
    files = table(3 * scratch.FILES_A_TASK, "concat('f', id) as path", "'java' as language", "'class A { int f() { return g(1); } }' as content")
    assert files.rdd.getNumPartitions() == 1
    for made in (brackets.parsed(files), python_source.nodes(files)):
        assert made.rdd.getNumPartitions() == 3 and made.select("path").distinct().count() == 3 * scratch.FILES_A_TASK


def test_import_edges_are_dealt_by_bytes(table, monkeypatch, grown):  # F13, F14, F15, F16
    monkeypatch.setattr(scratch, "BYTES_A_TASK", 100)
    asked = table(200, "concat('s', id % 7) as source_file", "array(concat('p', id % 50), concat('q', id % 50)) as candidates")
    files = table(50, "concat(if(id % 2 = 0, 'p', 'q'), id) as path")
    found = graphs.import_edges(asked, files)
    assert found.count() == 200 and scratch.tasks_for(asked) > 8 and f"hashpartitioning(candidates#" in planned(found)
    assert f", {scratch.tasks_for(asked)}), REPARTITION_BY_NUM" in planned(found)


def test_calls_of_a_hub_do_not_come_together(table, monkeypatch, grown):  # F21, F22, F23
    monkeypatch.setattr(scratch, "BYTES_A_TASK", 100)
    defined = table(101, "concat('a', id) as fqn", "concat('n', id) as name")
    edges = graphs.call_edges(defined, table(100, "concat('n', id) as caller_name", "'n100' as callee_name"))
    assert edges.count() == 100 and edges.agg({"weight": "sum"}).first()[0] == 100
    assert ", REPARTITION_BY_NUM" in planned(edges)  # as many tasks as the calls' bytes ask for


def test_rows_are_dealt_by_the_bytes_of_their_tables(table, monkeypatch, grown):  # F24
    monkeypatch.setattr(scratch, "BYTES_A_TASK", 100)
    rows = table(1000, "id as path", "id % 7 as rank")
    assert scratch.dealt(rows, "path").rdd.getNumPartitions() == -(-scratch.scanned(rows) // 100)


def test_versions_and_scans_are_dealt(table, grown):  # F8, F18
    old, new = (table(100, "id as path", "'k' as node_key", f"if(id % {k} = 0, 'a', 'b') as digest", "concat('f', id) as fingerprint") for k in (2, 3))
    diff = changes.node_diff(old.drop("fingerprint"), new.drop("fingerprint"))
    fresh, kept = memory.incremental(old.select("path", "fingerprint"), new.select("path", "fingerprint"))
    assert all("BroadcastExchange" not in planned(df) for df in (diff, fresh, kept)) and (diff.count(), fresh.count(), kept.count()) == (100, 0, 100)


def test_type_references_go_to_many_tasks(table):  # F9
    files = table(2 * scratch.FILES_A_TASK, "concat('f', id) as path", "'swift' as language", "concat('struct A', id, ' { var b: B', id, ' }') as content")
    found = imports.type_references(files)
    assert found.rdd.getNumPartitions() == 2 and found.count() == 2 * scratch.FILES_A_TASK


def test_numbered_tokens_meet_few_texts(table):  # F10, F17
    tokens, texts = table(6000, "concat('page', 100000 + id) as token"), table(3000, "concat('/page', 100000 + 2 * id, '/held') as text")
    assert health._meeting(tokens, texts).count() <= 6000 and health.holding(tokens, texts).count() == 3000


def test_findings_read_their_bags_once(spark):  # F19
    import __spark_entry__ as entry

    found = entry.queries()["divergence_findings"](spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "lineitem" in f]


def test_rows_of_staged_tables_are_dealt_by_their_number(table, monkeypatch):  # F11, F12
    monkeypatch.setattr(scratch, "ROWS_A_TASK", 20)
    parsed = scratch.staged(brackets.parsed(table(200, "concat('f', id) as path", "'java' as language", "'class A { int f() { return g(1); } int g(int a) { return 1; } }' as content")), "segments")
    declared = declarations.nodes(parsed)
    assert declared.count() == 600 and ", 30), REPARTITION_BY_NUM" in planned(declared)  # 600 nodes


def test_call_nodes_are_dealt_by_their_number(table, monkeypatch):  # F12, F22, F23
    monkeypatch.setattr(scratch, "ROWS_A_TASK", 20)
    defined = table(400, "concat('a', id) as fqn", "concat('n', id) as name")
    edges = graphs.call_edges(defined, table(400, "concat('n', id) as caller_name", "concat('n', (id + 1) % 400) as callee_name"))
    found = graphs.call_nodes(defined, edges)
    assert found.agg({"centrality": "sum"}).first()[0] == 1200 and "hashpartitioning(fqn#" in planned(found) and ", 20), REPARTITION_BY_NUM" in planned(found)


def test_calls_of_names_with_many_definitions_are_dealt_by_their_edges(table, monkeypatch):  # F22, F23
    monkeypatch.setattr(scratch, "ROWS_A_TASK", 20)
    defined = table(160, "concat('a', id) as fqn", "if(id < 80, 'from', 'to') as name")
    edges = graphs.call_edges(defined, table(1, "'from' as caller_name", "'to' as callee_name"))  # one call, 6,400 edges
    assert edges.count() == 6400 and round(edges.agg({"weight": "sum"}).first()[0], 9) == 1 and ", 80), REPARTITION_BY_NUM" in planned(edges)


def test_imports_are_dealt_before_they_are_made_distinct(spark, monkeypatch, grown):  # F14
    from quarry.plans import catalogue

    monkeypatch.setattr(scratch, "BYTES_A_TASK", 1000)
    monkeypatch.setattr(scratch, "ROWS_A_TASK", 20)
    tables = "/root/testdata/sf0.001"
    plan, li = planned(catalogue._import_edges(spark, tables)), scratch.read_table(spark, tables, "lineitem").select("l_suppkey", "l_partkey")
    parts = 2 * scratch.read_table(spark, tables, "part").count() // 20
    assert re.search(rf"hashpartitioning\(l_suppkey#\d+L?, l_partkey#\d+L?, {scratch.tasks_for(li)}\), REPARTITION_BY_NUM", plan)
    assert re.search(rf"hashpartitioning\(path#\d+, {parts}\), REPARTITION_BY_NUM", plan)
