"""Source files written out of driver rows, and what the library finds in them.

Each part is a function of a file: nine languages in turn, ten functions to a file, so there are as many files as the
table asks for.  Names, lines, visibility and calls follow from the row alone, and so SQL can state nodes, calls
and dead code from the same rows without parsing anything.  Strings and comments hold brackets, on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import brackets, config_files, python_source, sql_text
from quarry.functions.pattern_tables import _quoted, language_of
from quarry.operators import declarations, entries, health, imports, nodes, rules, text, views
from quarry.plans import tools
from quarry.plans.catalogue import query
from quarry.scratch import dealt, portioned, read_table, staged

# language, extension, lines before the functions, header of a function (private, public; {n} its name), a call of {n}, comment mark, last line,
# type of the container and of the functions, its name, modifiers (private, public)
LANGUAGES = [
    ("java", "java", "package p;|public class C{a} {", "  private int {n}(int a) {", "  public int {n}(int a) {", "{n}(1);", "//", "}", "class", "method", "C", "private", "public"),
    ("csharp", "cs", "using System;|public class C{a} {", "  private int {n}(int a) {", "  internal int {n}(int a) {", "return {n}(1);", "//", "}", "class", "method", "C", "private", "internal"),
    ("go", "go", "package p|type C{a} struct { // {|}", "func {n}(a int) int {", "func {n}(a int) int {", "return {n}(1)", "//", "", "struct", "function", "C", "", ""),
    ("rust", "rs", "use std::fmt;|impl C{a} {", "    fn {n}(a: i32) -> i32 {", "    pub fn {n}(a: i32) -> i32 {", "{n}(1);", "//", "}", "impl", "function", "C", "", "pub"),
    ("cpp", "cpp", "#include <x>|namespace n{a} {", "static int {n}(int a) {", "int {n}(int a) {", "return {n}(1);", "//", "}", "namespace", "function", "n", "static", ""),
    ("php", "php", "<?php|class C{a} {", "  private function {n}($a) {", "  public function {n}($a) {", "$this->{n}(1);", "#", "}", "class", "method", "C", "private", "public"),
    ("swift", "swift", "import F|struct C{a} {", "  private func {n}(_ a: Int) -> Int {", "  public func {n}(_ a: Int) -> Int {", "return {n}(1)", "//", "}", "struct", "method", "C", "private", "public"),
    ("typescript", "ts", "import {x} from './x';|export class C{a} {", "  private {n}(a: number): number {", "  public {n}(a: number): number {", "return this.{n}(1);", "//", "}", "class", "method", "C", "private", "public"),
    ("zig", "zig", "const y = 1;|const C{a} = struct {", "    fn {n}(a: i32) i32 {", "    pub fn {n}(a: i32) i32 {", "_ = {n}(1);", "//", "};", "struct", "function", "C", "", "pub"),
]
TO_FILE = 10


def _by(column: int, key: str = "l") -> str:
    """SQL of a column of LANGUAGES for the row's language number."""
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '" + row[column].replace("'", "''") + "'" for k, row in enumerate(LANGUAGES)) + " END"


# (k, l, a, path, hidden, deep, calls, name, callee) of each part, in DuckDB
ROWS = f"""WITH p AS (SELECT p_partkey AS k, CAST(p_partkey % {len(LANGUAGES)} AS INT) AS l, p_partkey // {len(LANGUAGES) * TO_FILE} AS a, p_size % 3 = 0 AS hidden, p_size % 4 AS deep, p_size % 2 = 0 AS calls FROM part),
r AS (SELECT p.*, 'f' || a || '/m' || l || '.' || {_by(1)} AS path, CASE WHEN l = 2 AND NOT hidden THEN 'Fn' ELSE 'fn' END || k AS name, 3 + deep + CASE WHEN calls THEN 1 ELSE 0 END AS n FROM p),
f AS (SELECT r.*, 1 + CASE WHEN l = 2 THEN 3 ELSE 2 END + coalesce(sum(n) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
             row_number() OVER (PARTITION BY path ORDER BY k) AS turn, count(*) OVER (PARTITION BY path) AS members, CASE WHEN l = 2 AND NOT coalesce(o.p_size % 3 = 0, true) THEN 'Fn' ELSE 'fn' END || (k + {len(LANGUAGES)}) AS callee, o.p_partkey IS NOT NULL AS there
      FROM r LEFT JOIN part o ON o.p_partkey = k + {len(LANGUAGES)})"""


def files(spark, d) -> DataFrame:
    """(path, content, language, size, mtime, is_binary) of the written files."""
    parts = read_table(spark, d, "part").selectExpr("p_partkey as k", "p_size")
    n, count = len(LANGUAGES), parts.count()
    after = parts.selectExpr(f"k - {n} as k", "p_size % 3 = 0 as callee_hidden")
    rows = portioned(parts, count, "k").join(dealt(after), "k", "left").selectExpr("k", f"cast(k % {n} as int) as l", f"k div {n * TO_FILE} as a", "p_size % 3 = 0 as hidden", "p_size % 4 as deep", "p_size % 2 = 0 as calls", "callee_hidden")
    spelled = lambda hidden, key: f"concat(if(l = 2 and not {hidden}, 'Fn', 'fn'), {key})"
    quoted = lambda c: "case l " + " ".join(f"when {i} then {_quoted(row[c])}" for i, row in enumerate(LANGUAGES)) + " end"
    body = f"""array_join(flatten(array(array(replace(if(hidden, {quoted(3)}, {quoted(4)}), '{{n}}', {spelled('hidden', 'k')}), concat('    ', {quoted(6)}, ' }} fn0( "')),
        transform(filter(sequence(1, deep), i -> deep > 0 and i <= deep), i -> '    if (a > 0) {{ x = "}}("; }}'), if(calls, array(concat('    ', replace({quoted(5)}, '{{n}}', {spelled('coalesce(callee_hidden, true)', f'k + {n}')}))), cast(array() as array<string>)), array('  }}'))), '\\n')"""
    written = rows.selectExpr("k", "l", "a", f"{body} as body", f"replace(replace({quoted(2)}, '{{a}}', a), '|', '\\n') as head", f"{quoted(7)} as foot", f"{quoted(0)} as language", f"concat('f', a, '/m', l, '.', {quoted(1)}) as path")
    # ten functions to a file at most
    text = portioned(written, count, "path").groupBy("path", "language", "head", "foot").agg(F.expr("array_join(transform(array_sort(collect_list(struct(k, body))), x -> x.body), '\\n')").alias("bodies"))
    return text.selectExpr("path", "concat_ws('\\n', head, bodies, if(foot = '', null, foot)) as content", "language").selectExpr("path", "content", "language", "cast(octet_length(content) as bigint) as size", "0D as mtime", "false as is_binary")


def _parsed(spark, d) -> tuple[DataFrame, DataFrame]:
    found = staged(brackets.parsed(files(spark, d)), "rendered-segments")
    return found, staged(declarations.nodes(found), "rendered-nodes")


@query(f"""{ROWS}, c AS (SELECT path, l, a, 0 AS node_id, -1 AS parent_id, CASE WHEN l = 2 THEN 0 ELSE max(members) END AS last_desc_id, 0 AS depth, 2 AS start_line, CASE WHEN l = 2 THEN 3 ELSE max(start + n) END AS end_line FROM f GROUP BY 1, 2, 3)
SELECT path, CAST(turn AS INT) AS node_id, CAST(CASE WHEN l = 2 THEN -1 ELSE 0 END AS INT) AS parent_id, CAST(turn AS INT) AS last_desc_id, CAST(CASE WHEN l = 2 THEN 0 ELSE 1 END AS INT) AS depth, {_by(9)} AS type, name, CAST(start AS INT) AS start_line, CAST(start + n - 1 AS INT) AS end_line,
       CASE WHEN hidden THEN {_by(11)} ELSE {_by(12)} END AS modifiers FROM f
UNION ALL SELECT path, node_id, parent_id, CAST(last_desc_id AS INT), depth, {_by(8)}, {_by(10)} || a, start_line, CAST(end_line AS INT), CASE l WHEN 0 THEN 'public' WHEN 1 THEN 'public' WHEN 7 THEN 'export' WHEN 8 THEN 'const' ELSE '' END FROM c""")
def nested_nodes(spark, d):
    """Containers and their functions in nine languages, from their brackets."""
    return _parsed(spark, d)[1].selectExpr("path", "node_id", "parent_id", "last_desc_id", "depth", "type", "name", "start_line", "end_line", "array_join(modifiers, ' ') as modifiers")


@query(f"""{ROWS}, t AS (SELECT path, name FROM f)
SELECT f.path AS caller_file, f.name AS caller_name, callee AS callee_name, CAST(start + 2 + deep AS INT) AS line, t.name IS NULL AS is_cross_file FROM f LEFT JOIN t ON t.path = f.path AND t.name = callee WHERE calls""")
def nested_calls(spark, d):
    """Calls with the function around them."""
    return declarations.calls(*_parsed(spark, d))


@query(f"""{ROWS}, c AS (SELECT DISTINCT callee FROM f WHERE calls)
SELECT path AS file, CASE WHEN l IN (2, 4) THEN name ELSE 'C' || a || '.' || name END AS qualified FROM f WHERE hidden AND name NOT IN (SELECT callee FROM c)""")
def dead_code(spark, d):
    """Functions that nothing calls and that nobody else can reach, by each language's rule."""
    return tools.Facts(files(spark, d)).dead()


@query("""SELECT 'e' || p_partkey || '.java' AS path, 'java' AS language, round((p_size - least(p_size, p_size % 7)) / (p_size + p_size % 7), 6) AS ratio, (p_size - least(p_size, p_size % 7)) / (p_size + p_size % 7) > 0.5 AS fallback FROM part""")
def bracket_errors(spark, d):
    """How much of a file's brackets match, and the files that are left to patterns."""
    rows = read_table(spark, d, "part").selectExpr("concat('e', p_partkey, '.java') as path", "'java' as language", "concat(repeat('(\\n', p_size), '// )))\\n', repeat(')', p_size % 7)) as content")
    return declarations.broken(brackets.parsed(rows)).withColumn("ratio", F.round("ratio", 6))


def _written(spark, d, path: str, content: str, columns: str = "p_partkey as k, p_size as z") -> DataFrame:
    """A file for each part: (path, content, language, ...) from SQL over k and z."""
    rows = read_table(spark, d, "part").selectExpr(*columns.split(", ")).selectExpr(f"{path} as path", f"{content} as content")
    return rows.selectExpr("*", f"{language_of()} as language", "cast(octet_length(content) as bigint) as size", "0D as mtime", "false as is_binary")


# --- entry points that name what follows ------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS z, p_partkey % 4 AS l FROM part)
SELECT 'x' || k || CASE l WHEN 0 THEN '.java' WHEN 1 THEN '.rs' WHEN 2 THEN '.cs' ELSE '.swift' END AS path,
       CASE l WHEN 0 THEN CASE z % 4 WHEN 0 THEN 'spring_boot_app' WHEN 1 THEN 'servlet' WHEN 2 THEN 'rest_controller' ELSE 'controller' END WHEN 1 THEN CASE z % 3 WHEN 0 THEN 'async_main' WHEN 1 THEN 'test' ELSE 'benchmark' END WHEN 2 THEN 'http_handler' ELSE 'main_type' END AS type,
       CASE WHEN l = 0 AND z % 5 = 0 THEN 'Unknown' ELSE CASE l WHEN 2 THEN 'Act' ELSE 'n' END || k END || CASE WHEN l = 0 AND z % 4 = 1 THEN ':/u' || k ELSE '' END AS name,
       CAST(2 + z % 3 AS INT) AS line, CASE l WHEN 0 THEN CASE z % 4 WHEN 0 THEN 'Spring Boot' WHEN 1 THEN 'Servlet' ELSE 'Spring' END WHEN 1 THEN CASE WHEN z % 3 = 0 THEN 'tokio' END WHEN 2 THEN 'ASP.NET' END AS framework
FROM p WHERE NOT (l IN (1, 3) AND z % 5 = 0)""")
def marked_entry_points(spark, d):
    """Annotations and attributes with the class or function that they mark, some lines on; in every fifth file nothing fits."""
    mark = """case k % 4 when 0 then case z % 4 when 0 then '@SpringBootApplication' when 1 then concat('@WebServlet("/u', k, '")') when 2 then '@RestController' else '@Controller' end
      when 1 then case z % 3 when 0 then '#[tokio::main]' when 1 then '#[test]' else '#[bench]' end when 2 then '  [HttpGet]' else '@main' end"""
    target = """case k % 4 when 0 then if(z % 5 = 0, 'interface I {', concat('public class n', k, ' {')) when 1 then if(z % 5 = 0, concat('let y = 1;\\nfn n', k, '() {'), concat(if(z % 3 = 0, 'async ', ''), 'fn n', k, '() {'))
      when 2 then concat('  public async Task<int> Act', k, '(int a) {') else if(z % 5 = 0, concat('let y = 1\\nstruct n', k, ' {'), concat('struct n', k, ' {')) end"""
    files_ = _written(spark, d, "concat('x', k, case k % 4 when 0 then '.java' when 1 then '.rs' when 2 then '.cs' else '.swift' end)", f"concat('// one\\n', repeat('\\n', z % 3), {mark}, '\\n', repeat('  \\n', z % 4), {target}, '\\n}}\\n')")
    return entries.marked(files_).drop("language")


# --- grouped imports ---------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS z FROM part)
SELECT 'i' || k || '.rs' AS path, CAST(2 + z % 3 AS INT) AS line_no, 'use' AS type, 'b' || z AS name, 'x' || k || ' self' AS names FROM p WHERE k % 3 = 0 UNION ALL
SELECT 'i' || k || '.rs', CAST(2 + z % 3 AS INT), 'use', 'b' || z || '::y', 'z' || k || ' w' FROM p WHERE k % 3 = 0 UNION ALL
SELECT 'i' || k || '.rs', CAST(7 + z % 3 AS INT), 'std', 'std::io', '' FROM p WHERE k % 3 = 0 UNION ALL
SELECT 'i' || k || '.rs', CAST(8 + z % 3 AS INT), 'use_as', 'crate::m' || z, 'v' FROM p WHERE k % 3 = 0 UNION ALL
SELECT 'i' || k || '.go', CAST(2 + z % 3 AS INT), 'import', m, n FROM p, (VALUES ('fmt', ''), ('ex/b', 'al')) v(m, n) WHERE k % 3 = 1 UNION ALL
SELECT 'i' || k || '.php', CAST(2 + z % 3 AS INT), 'use_grouped', 'App\\B' || z || '\\' || n, '' FROM p, (VALUES ('X'), ('Y')) v(n) WHERE k % 3 = 2""")
def grouped_imports(spark, d):
    """Trees, blocks and groups of imports, at the line where they begin."""
    text = """case k % 3 when 0 then concat('// use a::b;\\n', repeat('\\n', z % 3), 'use b', z, '::{x', k, ', y::{\\n  z', k, ',\\n  w as v,\\n}, self};\\n\\nuse std::io;\\npub use crate::m', z, ' as v;\\n')
      when 1 then concat('package p\\n', repeat('\\n', z % 3), 'import (\\n\\t"fmt"\\n\\tal "ex/b"\\n\\t// "no"\\n)\\n') else concat('<?php\\n', repeat('\\n', z % 3), 'use App\\\\B', z, '\\\\{X, Y as Z};\\nuse App\\\\One;\\n') end"""
    files_ = _written(spark, d, "concat('i', k, case k % 3 when 0 then '.rs' when 1 then '.go' else '.php' end)", text)
    return imports.grouped(files_).selectExpr("path", "line_no", "type", "name", "array_join(names, ' ') as names")


# --- types that Swift files name, and what protocols ask for ---------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS z FROM part), t AS (SELECT z, min(k) AS home FROM p GROUP BY z),
n AS (SELECT k, unnest(['T' || ((z + 1) % 51), 'T' || ((z + 2) % 51), 'T' || ((z + 3) % 51), 'T' || ((z + 4) % 51), 'T' || ((z + 5) % 51), 'T' || ((z + 6) % 51), 'T' || ((z + 7) % 51)]) AS name FROM p)
SELECT DISTINCT 's' || n.k || '.swift' AS src, 's' || t.home || '.swift' AS dst FROM n JOIN t ON n.name = 'T' || t.z WHERE n.k <> t.home""")
def type_edges(spark, d):
    """Files that the types which a Swift file names are first defined in: annotations, parameters, results, instances, ancestors, casts
    and type arguments, without the types that every program has."""
    of = lambda i: f"'T', (z + {i}) % 51"
    text = f"""concat('struct T', z, ': ', {of(5)}, ' {{\\n  var a: ', {of(1)}, '?\\n  let v: View\\n  func f(_ b: ', {of(2)}, ', c: Int) -> ', {of(3)}, ' {{\\n    g(x as! ', {of(6)}, ')\\n    return ', {of(4)}, '(String(1))\\n  }}\\n  var d: Array<', {of(7)}, '>\\n}}\\n')"""
    files_ = _written(spark, d, "concat('s', lpad(k, 9, '0'), '.swift')", text)
    found = imports.type_references(files_)
    defined = declarations.nodes(staged(brackets.parsed(files_), "swift-segments")).selectExpr("path as file", "name", "start_line as line")
    trimmed = lambda c: f"concat('s', cast(cast(regexp_extract({c}, '([0-9]+)', 1) as bigint) as string), '.swift')"
    return imports.by_type(found, defined).selectExpr(f"{trimmed('src')} as src", f"{trimmed('dst')} as dst")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS z FROM part)
SELECT 'w' || k || '.swift' AS file, 'S' || k || '.' || m AS qualified FROM p, (VALUES ('draw', 0), ('hash', 1), ('draw', 2), ('hash', 2), ('spare', 2)) v(m, c) WHERE z % 4 = c""")
def conformance_witnesses(spark, d):
    """Methods that a protocol may call: those that a known one asks for, all of a type that derives from something unknown."""
    text = """concat('protocol P', k, ' { func draw() }\\nstruct S', k, case z % 4 when 0 then concat(': P', k) when 1 then ': Hashable' when 2 then concat(': P', k, ', UIThing') else '' end, ' {\\n  func draw() {}\\n  func hash() {}\\n  func spare() {}\\n}\\n')"""
    defined = declarations.definitions(declarations.nodes(staged(brackets.parsed(_written(spark, d, "concat('w', k, '.swift')", text)), "swift-segments")))
    known = spark.createDataFrame([(p, m) for p, ms in nodes.PROTOCOLS.items() for m in ms.split()], "protocol string, member string")
    return nodes.witnesses(defined, known)


# --- SQL files ----------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS z FROM part), q AS (SELECT 'q' || k || '.sql' AS path, k, z, CASE z % 4 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'mysql' WHEN 2 THEN 'sqlite' ELSE 'generic' END AS dialect FROM p)
SELECT path, dialect, 'table' AS type, 't' || k AS name, CAST(2 + z % 3 AS INT) AS start_line, CAST(5 + z % 3 AS INT) AS end_line, 'id bigint,price numeric(10, 2),note varchar(' || z || ')' AS columns FROM q UNION ALL
SELECT path, dialect, 'view', 'v' || k, CAST(6 + z % 3 AS INT), CAST(6 + z % 3 AS INT), '' FROM q UNION ALL
SELECT path, dialect, 'function', 'f' || k, CAST(7 + z % 3 AS INT), CAST(10 + z % 3 AS INT), '' FROM q WHERE z % 4 = 0""")
def sql_statements(spark, d):
    """Dialect, names, lines and columns of statements: wrapped declarations, semicolons in strings, comments and dollar quotes."""
    table = "'CREATE TABLE t', k, ' (\\n  id bigint PRIMARY KEY, price numeric(10, 2)\\n    NOT NULL, -- one; two\\n  note varchar(', z, '), PRIMARY KEY (id)', case z % 4 when 1 then ') ENGINE=InnoDB' when 2 then ') WITHOUT ROWID' else ')' end, ';\\n'"
    view = "'CREATE VIEW v', k, ' AS SELECT id, \\'a;b\\' AS x FROM t', k, ';\\n'"
    function = "'CREATE FUNCTION f', k, '() RETURNS int AS $$\\nBEGIN\\n  RETURN 1; END;\\n$$ LANGUAGE plpgsql;\\n'"
    files_ = _written(spark, d, "concat('q', k, '.sql')", f"concat('/* head; */\\n', repeat('\\n', z % 3), {table}, {view}, if(z % 4 = 0, concat({function}), ''))")
    return sql_text.structures(files_).withColumn("columns", F.expr("array_join(columns, ',')"))


# --- questions to the tables of the written files -----------------------------------------------------------


@query(f"""{ROWS}, s AS (SELECT *, {_by(9)} AS type, CASE WHEN hidden THEN {_by(11)} ELSE {_by(12)} END AS modifiers FROM f)
SELECT 'type' AS filter, path, name FROM s WHERE type = 'method' UNION ALL SELECT 'name', path, name FROM s WHERE regexp_matches(name, '^Fn.*7$') UNION ALL SELECT 'complexity', path, name FROM s WHERE n >= 6 AND type = 'function' UNION ALL
SELECT 'candidate', path, name FROM s""")
def structure_filters(spark, d):
    """Nodes by type, by name, by type and length; and those that may be shown in full, of more than one line with none below them."""
    every = _parsed(spark, d)[1]
    wanted = {"type": {"type_filter": "method"}, "name": {"name_pattern": "^Fn.*7$"}, "complexity": {"min_complexity": 6, "type_filter": "function"}}
    out = nodes.candidates(every).where("type in ('method', 'function')").select(F.lit("candidate").alias("filter"), "path", "name")
    for name, f in wanted.items():
        out = out.unionByName(nodes.filtered(every, **f).select(F.lit(name).alias("filter"), "path", "name"))
    return out


@query(f"""{ROWS}, s AS (SELECT path, name, k, l, a, CASE WHEN l IN (2, 4) THEN name ELSE 'C' || a || '.' || name END AS qualified FROM f), c AS (SELECT callee, count(*) AS callers FROM f WHERE calls GROUP BY 1), o AS (SELECT k FROM f WHERE calls AND there)
SELECT path || ':' || qualified AS fqn, coalesce(callers, 0) AS n_callers, CASE WHEN o.k IS NULL THEN 0 ELSE 1 END AS n_callees, CAST(2 * coalesce(callers, 0) + CASE WHEN o.k IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS centrality
FROM s LEFT JOIN c ON c.callee = name LEFT JOIN o ON o.k = s.k UNION ALL SELECT DISTINCT path || ':C' || a, 0, 0, 0::DOUBLE FROM s WHERE l IN (0, 1, 2, 3, 5, 6, 7, 8)""")
def function_centrality(spark, d):
    """The call graph of the written files, through definitions with their containers."""
    return tools.Facts(files(spark, d)).call_nodes.select("fqn", "n_callers", "n_callees", "centrality")


@query(f"""{ROWS}, c AS (SELECT path, l, a, max(members) AS members, max(start + n) AS finish FROM f GROUP BY 1, 2, 3)
SELECT path, CAST(turn AS INT) AS node_id, repeat('  ', CASE WHEN l = 2 THEN 1 ELSE 2 END) || {_by(9)} || ': ' || name || CASE l WHEN 0 THEN ' (int a) : int' WHEN 1 THEN ' (int a) : int' WHEN 2 THEN ' (a int) int' WHEN 3 THEN ' (a: i32) -> i32' WHEN 4 THEN ' (int a) : int' WHEN 5 THEN ' ($a)' WHEN 6 THEN ' (_ a: Int) -> Int' WHEN 7 THEN ' (a: number): number' ELSE ' (a: i32) i32' END
       || ' (' || start || '-' || (start + n - 1) || ')' AS line FROM f
UNION ALL SELECT path, 0, '  ' || {_by(8)} || ': ' || {_by(10)} || a || ' (2-' || CASE WHEN l = 2 THEN 3 ELSE finish END || ')' FROM c""")
def nested_tree(spark, d):
    """The lines of a directory view: kind, name, signature and span of every node, indented."""
    return views.nested_lines(_parsed(spark, d)[1])


@query(f"""{ROWS}, s AS (SELECT path, CASE WHEN l IN (2, 4) THEN '/' ELSE '/' || {_by(8)} || ':C' || a || '/' END || CASE l WHEN 4 THEN 'namespace:n' || a || '/' ELSE '' END || {_by(9)} || ':' || name AS node_key, CASE WHEN k % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM f),
c AS (SELECT path, '/' || {_by(8)} || ':' || {_by(10)} || a AS node_key, CASE WHEN l <> 2 AND bool_or(k % 7 = 0) THEN 'changed' ELSE 'unchanged' END AS status FROM f GROUP BY path, l, a) SELECT * FROM s UNION ALL SELECT * FROM c""")
def node_status(spark, d):
    """What has become of each node between two versions of the written files: those of every seventh part have another first line."""
    old = files(spark, d)
    # a node counts as changed with what stands inside it; blank lines and space at the end of lines don't
    new = old.withColumn("content", F.expr("regexp_replace(regexp_replace(content, '([fF]n[0-9]+)([(](?:int a|a int|a: i32|[$]a|_ a: Int|a: number)[)][^\\n]*[{])\\n', '$1$2   \\n\\n'), '@', '')"))
    seventh = old.selectExpr("path", "posexplode(split(content, '\\n')) as (at, line)").withColumn("k", F.expr("try_cast(regexp_extract(line, '[fF]n([0-9]+)[(](?:int a|a int|a: i32|[$]a|_ a: Int|a: number)[)]', 1) as bigint)"))
    marked = seventh.withColumn("line", F.expr("if(k % 7 = 0, concat(line, ' // new'), line)")).groupBy("path").agg(F.expr("array_join(transform(array_sort(collect_list(struct(at, line))), x -> x.line), '\\n')").alias("content"))
    new = new.drop("content").join(marked.withColumn("content", F.expr("regexp_replace(content, '([{]|new)\\n', '$1  \\n\\n')")), "path")
    return tools.node_changes(old, new)


# --- Python --------------------------------------------------------------------------------------------------------

PYTHON = """WITH p AS (SELECT p_partkey AS k, p_partkey // 10 AS a, p_size % 4 AS deep, p_size % 2 = 0 AS calls, p_size % 3 = 0 AS marked FROM part),
f AS (SELECT *, 'py/m' || a || '.py' AS path, 4 + deep + deep + CASE WHEN calls THEN 1 ELSE 0 END + CASE WHEN marked THEN 1 ELSE 0 END AS n FROM p),
g AS (SELECT *, 7 + coalesce(sum(n) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN marked THEN 1 ELSE 0 END AS start, row_number() OVER (PARTITION BY path ORDER BY k) AS turn, count(*) OVER (PARTITION BY path) AS members FROM f)"""


def _python_files(spark, d) -> DataFrame:
    """Ten parts to a file: a class with a method for each."""
    body = """concat(if(p_size % 3 = 0, '    @deco\\n', ''), '    def fn', k, '(self, a):\\n        # } (\\n', repeat('        if a > 0:\\n            a += 1\\n', p_size % 4), if(p_size % 2 = 0, concat('        self.fn', k + 1, '(1)\\n'), ''), '        return a\\n\\n')"""
    rows = read_table(spark, d, "part").selectExpr("p_partkey as k", "p_size").selectExpr("k", "k div 10 as a", f"{body} as body")
    text = rows.groupBy("a").agg(F.expr("array_join(transform(array_sort(collect_list(struct(k, body))), x -> x.body), '')").alias("bodies"))  # ten to a file
    return text.selectExpr("concat('py/m', a, '.py') as path", "concat('import os\\nfrom py.m', a + 1, ' import x\\n\\nclass C', a, '(Base):\\n    \\'\\'\\'Doc ', a, '.\\'\\'\\'\\n\\n', bodies) as content", "'python' as language")


@query(f"""{PYTHON} SELECT path, CAST(1 + turn AS INT) AS node_id, 1 AS parent_id, 'method' AS type, 'fn' || k AS name, CAST(start AS INT) AS start_line, CAST(start + n - 2 - CASE WHEN marked THEN 1 ELSE 0 END AS INT) AS end_line, '(self, a)' AS signature, CASE WHEN marked THEN '@deco' ELSE '' END AS decorators, '' AS docstring, CAST(deep AS INT) AS branches FROM g
UNION ALL SELECT path, 1, -1, 'class', 'C' || a, 4, CAST(max(start + n - 2 - CASE WHEN marked THEN 1 ELSE 0 END) AS INT), '(Base)', '', 'Doc ' || a || '.', CAST(sum(deep) AS INT) FROM g GROUP BY path, a
UNION ALL SELECT DISTINCT path, 0, -1, 'imports', 'imports', 1, 2, '', '', '', 0 FROM g""")
def python_structure(spark, d):
    """Nodes of Python by its syntax tree: classes, methods, imports, decorators, docs and branches."""
    found = python_source.nodes(_python_files(spark, d))
    return found.selectExpr("path", "node_id", "parent_id", "type", "name", "start_line", "end_line", "coalesce(signature, '') as signature", "array_join(decorators, ' ') as decorators", "coalesce(docstring, '') as docstring", "coalesce(branches, 0) as branches")


@query(f"{PYTHON} SELECT path AS caller_file, 'fn' || k AS caller_name, 'fn' || (k + 1) AS callee_name, CAST(start + 2 + 2 * deep AS INT) AS line FROM g WHERE calls")
def python_calls(spark, d):
    return python_source.calls(_python_files(spark, d))


@query(f"""{PYTHON}, h AS (SELECT path, a, k, [' def fn' || k || '(…):'] || flatten(list_transform(range(deep), lambda i: ['  if a > 0:', '   a += 1'])) || CASE WHEN calls THEN ['  self.fn' || (k + 1) || '(1)'] ELSE CAST([] AS VARCHAR[]) END || ['  return a'] AS said FROM g),
l AS (SELECT path, -1 AS k, 1 AS i, '…' AS text FROM h GROUP BY path UNION ALL SELECT path, -1, 2, 'class C' || min(a) || ':' FROM h GROUP BY path UNION ALL SELECT path, k, unnest(range(1, len(said) + 1)) AS i, unnest(said) FROM h)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY k, i) AS INT) AS line_no, text FROM l""")
def python_condensed(spark, d):
    """What Python files do, line by line: headers, branches, calls; documentation, imports and comments of their own left out."""
    return python_source.skeletons(_python_files(spark, d))


# --- routes and templates ------------------------------------------------------------------------------------------

# a part's route, by k % 6: told by a page, told by a helper's name, external, without a telling word, told by nobody, declared by a call
_ROUTE = "CASE k % 6 WHEN 0 THEN '/page' || k || '/held' WHEN 1 THEN '/named' || k || '/x' WHEN 2 THEN '/r' || k || '/health' WHEN 3 THEN '/a/{id}' WHEN 4 THEN '/lost' || k || '/entry' ELSE '/called' || k || '/y' END"


@query(f"""WITH p AS (SELECT p_partkey AS k FROM part), r AS (SELECT 'api/r' || k || '.py' AS location, 'h' || k AS pid, {_ROUTE} AS key, k FROM p WHERE k % 6 < 5 UNION ALL SELECT 'web/r' || k || '.ts', {_ROUTE}, {_ROUTE}, k FROM p WHERE k % 6 = 5)
SELECT pid, location, key, 'route' AS tag, CASE k % 6 WHEN 0 THEN 'reached' WHEN 1 THEN 'reached' WHEN 2 THEN 'external' WHEN 3 THEN 'unresolvable' ELSE 'orphan' END AS verdict FROM r""")
def route_verdicts(spark, d):
    """Routes on decorators and by calls; told by pages and by helpers, external by contract, or by nobody."""
    route = "case k % 6 when 0 then concat('/page', k, '/held') when 1 then concat('/named', k, '/x') when 2 then concat('/r', k, '/health') when 3 then '/a/{id}' when 4 then concat('/lost', k, '/entry') else concat('/called', k, '/y') end"
    made = _written(spark, d, "if(k % 6 = 5, concat('web/r', k, '.ts'), concat('api/r', k, '.py'))", f"if(k % 6 = 5, concat('router.get(\"', {route}, '\", f);\\n'), concat('@app.get(\"', {route}, '\")\\ndef h', k, '():\\n    return 1\\n'))")
    told = _written(spark, d, "concat('web/p', k, '.html')", "case k % 6 when 0 then concat('<a href=\"/page', k, '/held\">x</a>') when 1 then concat('<a href=\"{{ url_for(\\'h', k, '\\') }}\">x</a>') else '<p>no</p>' end")
    return health.orphan_routes(made.unionByName(told), python_source.nodes(made.where("language = 'python'")))


@query("""SELECT 't' || p_partkey || '.html' AS pid, 'app/templates/t' || p_partkey || '.html' AS location, 't' || p_partkey || '.html' AS key, 'template' AS tag, CASE WHEN p_partkey % 4 < 2 THEN 'reached' ELSE 'orphan' END AS verdict FROM part""")
def template_verdicts(spark, d):
    """Templates that code or another template names, and those that nothing does."""
    made = _written(spark, d, "concat('app/templates/t', k, '.html')", "if(k % 4 = 0 and z > 0, concat('{% include \"t', k + 1, '.html\" %}'), '<p>x</p>')")
    code = _written(spark, d, "concat('app/v', k, '.py')", "if(k % 4 = 0, concat('render(\"t', k, '.html\")\\n'), if(k % 4 = 1, concat('x = \"t', k, '.html\"\\n'), 'y = 1\\n'))")
    return health.orphan_templates(made.unionByName(code))


# --- headings, sections, styles ----------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey // 10 AS a, 1 + p_size % 6 AS level, 1 + 2 + p_size % 3 AS n FROM part),
h AS (SELECT *, 'd' || a || '.md' AS path, row_number() OVER (PARTITION BY a ORDER BY k) - 1 AS id, 1 + coalesce(sum(n) OVER (PARTITION BY a ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(n) OVER (PARTITION BY a) AS total, count(*) OVER (PARTITION BY a) AS m FROM p),
t AS (SELECT h.*, coalesce((SELECT max(b.id) FROM h b WHERE b.a = h.a AND b.id < h.id AND b.level < h.level), -1) AS parent, coalesce((SELECT min(b.id) FROM h b WHERE b.a = h.a AND b.id > h.id AND b.level <= h.level), m) - 1 AS last FROM h)
SELECT t.path, CAST(t.id AS INT) AS node_id, CAST(t.parent AS INT) AS parent_id, CAST(t.last AS INT) AS last_desc_id, 'heading-' || t.level AS type, 'Part ' || t.k AS name, CAST(t.start AS BIGINT) AS start_line, CAST(e.start + e.n - 1 AS BIGINT) AS end_line FROM t JOIN t e ON e.a = t.a AND e.id = t.last""")
def heading_tree(spark, d):
    """Headings of Markdown with their parents and last lines; a heading ends with its last descendant."""
    rows = read_table(spark, d, "part").selectExpr("p_partkey as k", "p_partkey div 10 as a", "concat(repeat('#', 1 + p_size % 6), ' Part ', p_partkey, '\\n\\ntext', repeat('\\nmore #text', p_size % 3)) as body")
    text_ = rows.groupBy("a").agg(F.expr("array_join(transform(array_sort(collect_list(struct(k, body))), x -> x.body), '\\n')").alias("content"))  # ten to a file
    return nodes.headings(text.lines(text_.selectExpr("concat('d', a, '.md') as path", "content")))


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 3 AS z, 'o' || p_partkey || '.txt' AS path FROM part)
SELECT path, 'section' AS type, 'HEAD ' || k AS name, 1::BIGINT AS start_line, CAST(4 + z AS BIGINT) AS end_line, NULL::BIGINT AS section_line FROM p UNION ALL
SELECT path, 'section', 'Under ' || k, CAST(5 + z AS BIGINT), CAST(10 + z AS BIGINT), NULL FROM p UNION ALL
SELECT path, 'paragraph', 'paragraph (3-' || (3 + z) || ')', 3, 3 + z, 1 FROM p UNION ALL
SELECT path, 'paragraph', 'paragraph (' || (8 + z) || '-' || (8 + z) || ')', 8 + z, 8 + z, 5 + z FROM p""")
def text_outline(spark, d):
    """Sections and paragraphs of plain text: headers in capitals and underlined, paragraphs that a blank line ends, and one that runs
    to the end below a header, which counts for nothing."""
    made = _written(spark, d, "concat('o', k, '.txt')", "concat('HEAD ', k, '\\n\\nbody one', repeat('\\nmore', z % 3), '\\n\\nUnder ', k, '\\n=====\\n\\nsecond\\n\\nopen end')")
    return nodes.outline(text.lines(made))


@query("""SELECT 'c' || p_partkey || '.css' AS path, CASE WHEN p_size % 3 = 0 THEN '.a' || p_partkey ELSE '.a' || p_partkey || ' (+' || (p_size % 3) || ')' END AS name, CAST(1 + p_size % 3 AS INT) AS selectors, CAST(1 + p_size % 4 AS INT) AS declarations, p_size % 2 = 0 AS has_variables FROM part UNION ALL
SELECT 'c' || p_partkey || '.css', 'p', 1, 1, false FROM part""")
def style_rules(spark, d):
    """Rules of style sheets: selectors, declarations, variables; comments and blocks of @-rules aside."""
    made = _written(spark, d, "concat('c', k, '.css')", "concat('/* .no { x: y; } */\\n.a', k, repeat(', .b', z % 3), ' {\\n  ', if(z % 2 = 0, '--c', 'color'), ': red;', repeat('\\n  margin: 0;', z % 4), '\\n}\\n@font-face { src: url(x); }\\np { top: 0; }\\n')")
    return config_files.css_rules(made)


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS z FROM part) SELECT 'k' || k || '/package.json' AS path, 'lib/m' || k || '.js' AS name, 2 AS line, 'main_entry' AS type FROM p WHERE k % 3 = 0 UNION ALL SELECT 'k' || k || '/package.json', 'npm_project', 1, 'project_config' FROM p WHERE k % 3 = 0 UNION ALL
SELECT 'k' || k || '/package.json', 'tool' || k, 3, 'bin_script' FROM p WHERE k % 3 = 0 UNION ALL SELECT 'k' || k || '/pyproject.toml', 'python_project', 1, 'project_config' FROM p WHERE k % 3 = 1 UNION ALL
SELECT 'k' || k || '/pyproject.toml', 'project_scripts', CAST(2 + z % 4 AS INT), 'scripts_section' FROM p WHERE k % 3 = 1 UNION ALL SELECT 'k' || k || '/tsconfig.json', 'typescript_project', 1, 'project_config' FROM p WHERE k % 3 = 2""")
def config_starts(spark, d):
    """What configuration starts: entries, scripts, projects, with the lines where they stand."""
    content = """case k % 3 when 0 then concat('{\\n  "main": "lib/m', k, '.js",\\n  "bin": {"tool', k, '": "x.js"}\\n}\\n') when 1 then concat('[project]\\n', repeat('x = 1\\n', z % 4), '[project.scripts]\\nrun = "a:b"\\n') else '{\\n  "extends": "./base.json"\\n}\\n' end"""
    made = _written(spark, d, "concat('k', k, '/', case k % 3 when 0 then 'package.json' when 1 then 'pyproject.toml' else 'tsconfig.json' end)", content)
    return config_files.entry_points(made).drop("framework")


# --- what walks leave out -------------------------------------------------------------------------------------------------

# path ({k}: the part), and whether the walk, the analysis, a directory scan skip it, whether it may be left out of an inventory, and whether it is the product's own
PATHS = [
    ("src/a{k}.py", "ffff", True), ("node_modules/x{k}/a.js", "tfff", False), ("src/__pycache__/a{k}.py", "tfff", False), ("lib/a{k}.pyc", "tfff", True), ("web/a{k}.min.js", "fttf", True), ("web/bundle{k}.js", "fttf", True), ("web/t{k}.d.ts", "fttf", True), ("srv/a{k}.pb.go", "fttt", True),
    ("srv/generated{k}.go", "fttf", True), ("srv/vendor/x/a{k}.go", "?tff", False), ("src/a{k}.pb.rs", "fttf", True), ("x{k}/target/a.rs", "?tff", True), ("j/A{k}.class", "tfff", True), ("c/A{k}.designer.cs", "fttf", True), ("c/A{k}.g.cs", "fttf", True), ("c/bin/A{k}.cs", "?tff", True),
    ("ios/Generated{k}.swift", "fttf", True), ("tests/test_a{k}.py", "ffff", False), ("test/a{k}.py", "ffff", False), ("examples/a{k}.go", "ffff", False), ("third_party/b{k}/a.c", "?fff", False), ("a{k}/package-info.java", "ffft", True), ("m{k}/app.py", "ffff", True),
]


@query("WITH p AS (SELECT p_partkey AS k, p_partkey % " + str(len(PATHS)) + " AS i FROM part) SELECT replace(CASE i " + " ".join(f"WHEN {i} THEN '{p}'" for i, (p, _, _) in enumerate(PATHS)) + " END, '{k}', CAST(k AS VARCHAR)) AS path, "
       + ", ".join(f"substr(CASE i " + " ".join(f"WHEN {i} THEN '{f}'" for i, (_, f, _) in enumerate(PATHS)) + f" END, {c}, 1) = 't' AS {n}" for c, n in ((2, "analysis"), (3, "scan"), (4, "low_value"))) + ", CASE i " + " ".join(f"WHEN {i} THEN {str(o).lower()}" for i, (_, _, o) in enumerate(PATHS)) + " END AS own FROM p")
def path_rules(spark, d):
    """What the analysis and a directory scan pass over by language, what an inventory may leave out, and what is the product's own."""
    path = "replace(case k % " + str(len(PATHS)) + " " + " ".join(f"when {i} then '{p}'" for i, (p, _, _) in enumerate(PATHS)) + " end, '{k}', cast(k as string))"
    made = read_table(spark, d, "part").selectExpr("p_partkey as k").selectExpr(f"{path} as path").selectExpr("path", f"{language_of()} as language", "500L as size")
    return made.selectExpr("path", f"coalesce({rules.analyze_skips('language', 'path')}, false) as analysis", f"coalesce({rules.scan_skips('language', rules.name_of('path'))}, false) as scan", f"coalesce({rules.low_value('language', 'path', 'size')}, false) as low_value", f"{rules.is_source('path')} as own")
