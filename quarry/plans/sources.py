"""Further operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scoring
from quarry.functions.pattern_tables import language_of
from quarry.operators import budget, changes, consensus, graphs, imports, nodes, paths, ranking, report, rules, views
from quarry.plans.catalogue import AUDIT, _import_edges, call_facts, query, usage
from quarry.scratch import dealt, fresh_path, read_table, staged
from quarry.streaming import memory


@query("WITH b AS (SELECT DISTINCT o_custkey || ':' || o_orderstatus AS cid, p_brand AS callee FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey UNION SELECT DISTINCT 'x:' || p_brand, p_brand FROM part), n AS (SELECT callee, count(*) AS n FROM b GROUP BY 1) SELECT cid, coalesce(n, 0) AS in_degree FROM (SELECT DISTINCT cid FROM b) LEFT JOIN n ON split_part(cid, ':', 2) = callee")
def in_degrees(spark, d):
    bags = usage(spark, d, True).unionByName(read_table(spark, d, "part").selectExpr("concat('x:', p_brand) as cid", "p_brand as callee").distinct())
    return nodes.in_degrees(bags)


@query("WITH c AS (SELECT 'c' || o_custkey AS caller_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), k AS (SELECT 'c' || c_custkey AS name FROM customer WHERE c_acctbal > 0) SELECT caller_name, count(*) AS calls FROM c WHERE caller_name NOT IN (SELECT name FROM k) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def dropped_callers(spark, d):
    return graphs.top_dropped(*call_facts(spark, d))


# --- budgets, saliency, reports on the driver's tables --------------------------------------------

LEVELS = """WITH n0 AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rank, CAST(floor(l_quantity) AS BIGINT) AS q, count(*) OVER (PARTITION BY l_orderkey) AS members FROM lineitem),
s0 AS (SELECT *, CASE WHEN rank <= greatest(1, floor(0.2 * members)) THEN 3 ELSE 2 END AS level FROM n0)"""


def _step(k: int) -> str:
    cost = "CASE level WHEN 3 THEN q WHEN 2 THEN q // 2 WHEN 1 THEN q // 4 ELSE 0 END"
    down = {3: "q // 2", 2: "q // 4", 1: "0"}[k]
    return f""", a{k} AS (SELECT *, sum({cost}) OVER (PARTITION BY path) - coalesce(sum(CASE WHEN level = {k} THEN ({cost}) - {down} ELSE 0 END) OVER (PARTITION BY path ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM s{3 - k}),
s{4 - k} AS (SELECT path, rank, q, members, CASE WHEN level = {k} AND total > 60 THEN {k - 1} ELSE level END AS level FROM a{k})"""


@query(LEVELS + _step(3) + _step(2) + _step(1) + " SELECT path, rank, CASE level WHEN 3 THEN 'full' ELSE CAST(level AS VARCHAR) END AS level FROM s3")
def budget_levels(spark, d):
    rows = dealt(read_table(spark, d, "lineitem"), "l_orderkey").selectExpr("l_orderkey as path", "row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey) as rank", "cast(floor(l_quantity) as bigint) as cost_full")
    return budget.degraded(rows.selectExpr("*", "cost_full div 2 as cost_2", "cost_full div 4 as cost_1"), "60").selectExpr("path", "cast(rank as bigint) as rank", "level")


@query("SELECT doc_id AS path, CAST(length(text) // 4 + len(string_split(text, chr(10))) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimates(spark, d):
    rows = read_table(spark, d, "documents").where("text is not null").selectExpr("doc_id as path", "split(text, '\\n') as lines")
    return rows.selectExpr("path", f"cast({budget.tokens('lines')} as bigint) as tokens")


def _blend(weights: tuple[float, float, float, float]) -> str:
    norm = lambda c: f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"
    base = f"({weights[0]} * {norm('a')} + {weights[1]} * {norm('b')} + {weights[2]} * {norm('c')})"
    return f"SELECT path, node, round(CASE WHEN max(e) OVER w > min(e) OVER w THEN {base} * {1 - weights[3]} + {weights[3]} * {norm('e')} ELSE {base} END, 11) AS saliency FROM n WINDOW w AS (PARTITION BY path)"


BLEND = "WITH n AS (SELECT l_orderkey AS path, l_linenumber AS node, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b, l_partkey::DOUBLE AS c, (l_suppkey % 3)::DOUBLE AS e FROM lineitem) "


def _saliency(spark, d, mode):
    rows = read_table(spark, d, "lineitem").selectExpr("l_orderkey as path", "l_linenumber as node", "cast(l_quantity as double) as info", "cast(l_extendedprice as double) as novelty", "cast(l_partkey as double) as centrality", "cast(l_suppkey % 3 as double) as churn")
    return ranking.saliency(rows, "path", mode).select("path", "node", F.round("saliency", 11).alias("saliency"))


@query(BLEND + _blend((0.30, 0.50, 0.20, 0.15)))
def saliency_balanced(spark, d):
    return _saliency(spark, d, "balanced")


@query(BLEND + _blend((0.25, 0.30, 0.10, 0.45)))
def saliency_active(spark, d):
    return _saliency(spark, d, "active")


EDGES = "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_partkey % 3 <> 0 UNION SELECT DISTINCT 's' || l_suppkey, 'q' || (l_partkey + 1) FROM lineitem WHERE l_partkey % 3 = 0), x AS (SELECT src AS path, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e), f AS (SELECT path, CAST(sum(o) AS BIGINT) AS n_imports, CAST(sum(i) AS BIGINT) AS n_importers, CAST(2 * sum(i) + sum(o) AS BIGINT) AS centrality FROM x GROUP BY path)"


@query(EDGES + " SELECT * FROM f WHERE centrality > 0 ORDER BY centrality DESC, path LIMIT 20")
def core_files(spark, d):
    return report.core_files(graphs.file_centrality(_import_edges(spark, d)))


@query(EDGES + ", t AS (SELECT path, centrality FROM f ORDER BY centrality DESC, path LIMIT 5), r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rank, count(*) OVER (PARTITION BY src) AS n FROM e) SELECT src AS path, string_agg(dst, ', ' ORDER BY dst) AS imported, max(greatest(n - 3, 0)) AS hidden FROM r JOIN t ON src = t.path WHERE rank <= 3 GROUP BY src")
def key_dependencies(spark, d):
    edges = _import_edges(spark, d)
    return report.key_dependencies(graphs.file_centrality(edges), edges)


@query("WITH c AS (SELECT event_type AS path, count(DISTINCT user_id || ':' || CAST(ts AS DATE)) AS churn FROM events GROUP BY 1), f AS (SELECT DISTINCT event_type AS path FROM events UNION SELECT r_name FROM region) SELECT f.path, c.churn FROM f LEFT JOIN c USING (path)")
def churn_labels(spark, d):
    commits = read_table(spark, d, "events").selectExpr("concat(user_id, ':', date(ts)) as commit_id", "ts", "event_type as path")
    files = commits.select("path").unionByName(read_table(spark, d, "region").selectExpr("r_name as path")).distinct()
    return nodes.with_churn(files, changes.churn(commits))


@query("SELECT lang AS name, count(*) AS n_files, count(*) FILTER (n_chars > 1500) AS n_code, round(count(*) * (1 + 0.3 * count(*) FILTER (n_chars > 1500) / count(*)), 6) AS relevance, CASE WHEN count(*) > 1000 THEN 'large' ELSE '' END AS note FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY relevance DESC, name LIMIT 10")
def top_directories(spark, d):
    dirs = read_table(spark, d, "documents").where("lang is not null").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n_files"), F.expr("count_if(n_chars > 1500)").alias("n_code"))
    return report.top_directories(dirs).withColumn("relevance", F.round("relevance", 6))


@query("WITH f AS (SELECT p_brand AS top, lower(split_part(p_type, ' ', -1)) AS ext FROM part), c AS (SELECT top, ext, count(*) AS n, row_number() OVER (PARTITION BY top ORDER BY count(*) DESC, ext) AS rank, count(*) OVER (PARTITION BY top) AS kinds FROM f GROUP BY 1, 2) SELECT top, string_agg(ext || ':' || n, ' ' ORDER BY rank) || CASE WHEN max(kinds) > 3 THEN ' ...' ELSE '' END AS types FROM c WHERE rank <= 3 GROUP BY top")
def folder_extensions(spark, d):
    return paths.extensions(read_table(spark, d, "part").selectExpr("concat(p_brand, '/', p_partkey, '.', lower(element_at(split(p_type, ' '), -1))) as path"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN a < 1 THEN CASE WHEN CAST(floor(a * 24) AS INT) > 0 THEN CAST(floor(a * 24) AS INT) || 'h ago' ELSE 'just now' END WHEN a < 7 THEN CAST(floor(a) AS INT) || 'd ago' WHEN a < 30 THEN CAST(floor(a / 7) AS INT) || 'w ago' WHEN a < 365 THEN CAST(floor(a / 30) AS INT) || 'mo ago' ELSE printf('%.1f', a / 365) || 'y ago' END AS label FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 7) * (l_quantity::DOUBLE * l_quantity::DOUBLE) / 16 AS a FROM lineitem)")
def age_labels(spark, d):
    rows = read_table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "(l_partkey % 7) * (cast(l_quantity as double) * cast(l_quantity as double)) / 16 as a")
    return rows.selectExpr("l_orderkey", "l_linenumber", f"{views.age_label('a')} as label")


@query("SELECT o_orderkey, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || CASE WHEN s // 60 = 1 THEN ' min ago' ELSE ' mins ago' END WHEN s < 86400 THEN s // 3600 || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END WHEN s < 604800 THEN s // 86400 || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END WHEN s < 2592000 THEN s // 604800 || CASE WHEN s // 604800 = 1 THEN ' week ago' ELSE ' weeks ago' END WHEN s < 31536000 THEN s // 2592000 || CASE WHEN s // 2592000 = 1 THEN ' month ago' ELSE ' months ago' END ELSE s // 31536000 || CASE WHEN s // 31536000 = 1 THEN ' year ago' ELSE ' years ago' END END AS label, CASE WHEN s >= 1000 THEN (s + 50) // 1000 || '.' || (s + 50) // 100 % 10 || 'k' ELSE CAST(s AS VARCHAR) END AS n FROM (SELECT o_orderkey, CAST(o_custkey AS BIGINT) * o_custkey * (o_orderkey % 53) AS s FROM orders)")
def span_labels(spark, d):
    rows = read_table(spark, d, "orders").selectExpr("o_orderkey", "cast(o_custkey as bigint) * o_custkey * (o_orderkey % 53) as s")
    return rows.selectExpr("o_orderkey", f"{views.since_label('s')} as label", f"{views.count_label('s')} as n")


@query("WITH i AS (SELECT conv_id AS path, turn AS node_id, turn * 10 + 2 AS a, turn * 10 + 4 AS b FROM conversations), o AS (SELECT conv_id AS path, turn AS id, turn * 10 AS a, turn * 10 + 14 AS b FROM conversations) SELECT i.path, i.node_id, arg_max(o.id, o.a) AS parent FROM i JOIN o ON i.path = o.path AND o.a <= i.a AND i.b <= o.b GROUP BY 1, 2")
def nested_spans(spark, d):
    c = read_table(spark, d, "conversations")
    return nodes.nested(c.selectExpr("conv_id as path", "turn as node_id", "turn * 10 + 2 as start_line", "turn * 10 + 4 as end_line"), c.selectExpr("conv_id as path", "turn as node_id", "turn * 10 as start_line", "turn * 10 + 14 as end_line"))


@query("SELECT conv_id AS path, arg_max(md5(text), turn) AS fingerprint, CAST(arg_max(len(string_split(text, chr(10))), turn) AS INT) AS n_lines FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1")
def stream_incremental(spark, d):
    turns = read_table(spark, d, "conversations").where("conv_id is not null")
    scans = turns.selectExpr("conv_id as path", "md5(text) as fingerprint", "coalesce(text, '') as content", "turn")
    return memory.incremental_stream(spark, scans)


@query("SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
def snapshot_refresh(spark, d):
    """Two refreshes, of which the second finds nothing changed and leaves the snapshot as it is."""
    snapshot = memory.Snapshot(spark, fresh_path(spark, "snapshot"))
    docs = read_table(spark, d, "documents")
    files = docs.selectExpr("doc_id as path", "md5(text) as fingerprint", "n_chars")
    compute = lambda rows: rows.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    if not snapshot.refresh(files, compute) or snapshot.refresh(files, compute):
        raise RuntimeError("a snapshot of the same files was worked out anew")
    return snapshot.read()


@query("WITH d AS (SELECT DISTINCT p_brand AS top FROM part), n AS (SELECT 'root' AS name UNION ALL SELECT top FROM d) SELECT count(*) AS dirs FROM n")
def listed_folders(spark, d):
    from quarry.sources import tree

    dirs = tree.summary(read_table(spark, d, "part").selectExpr("concat(p_brand, '/', p_partkey) as path", "cast(p_size as bigint) as size"))
    return dirs.agg(F.count("*").alias("dirs"))


@query("""WITH b AS (SELECT doc_id AS path, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents), c AS (SELECT path, x, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT path, sum(n) AS total FROM c GROUP BY 1),
e AS (SELECT path, -sum(n / total * log2(n / total)) AS entropy FROM c JOIN t USING (path) GROUP BY 1) SELECT doc_id AS path, round(coalesce(entropy, 0), 6) + 0.0 AS entropy FROM documents LEFT JOIN e ON doc_id = path""")
def byte_entropy(spark, d):
    return scoring.byte_entropy(read_table(spark, d, "documents").selectExpr("doc_id as path", "text as content")).withColumn("entropy", F.expr("round(entropy, 6) + 0D"))


# --- peers that agree, and sites that don't --------------------------------------------------------------------------

# an order is a function, its brands are what it calls; those that load open and close, and some forget to
PEERS = """WITH o AS (SELECT o_orderkey, 'f' || (o_orderkey % 7) || '.py:' || CASE WHEN o_custkey % 2 = 0 THEN 'load_' ELSE 'scan_' END || o_orderkey AS cid, o_custkey % 2 = 0 AS loads FROM orders),
b AS (SELECT DISTINCT cid, p_brand AS callee FROM lineitem JOIN o ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey UNION SELECT cid, 'open_it' FROM o WHERE loads OR o_orderkey % 101 = 0 UNION SELECT cid, 'close_it' FROM o WHERE loads AND o_orderkey % 97 <> 0),
n AS (SELECT callee, count(*) AS callers, count(*) / (SELECT count(DISTINCT cid) FROM b) AS rate FROM b GROUP BY callee),
p AS (SELECT x.callee AS anchor, y.callee AS other, count(*) AS together FROM b x JOIN b y ON x.cid = y.cid AND x.callee <> y.callee GROUP BY 1, 2),
q AS (SELECT p.*, na.callers, no.rate FROM p JOIN n na ON anchor = na.callee JOIN n no ON other = no.callee)"""


# tails too small for a number are summed beside their largest term
FENCED = AUDIT.replace("-ln(sum(exp(x))) / ln(10)) AS enrichment FROM u", "-(max(x) + ln(sum(exp(x - m)))) / ln(10)) AS enrichment FROM (SELECT *, max(x) OVER (PARTITION BY anchor, other) AS m FROM u)")


def _peers(spark, d):
    orders = read_table(spark, d, "orders").selectExpr("o_orderkey", "concat('f', o_orderkey % 7, '.py:', if(o_custkey % 2 = 0, 'load_', 'scan_'), o_orderkey) as cid", "o_custkey % 2 = 0 as loads")
    items = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(read_table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    brands = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("cid", "p_brand as callee")
    return consensus.bags(brands.unionByName(orders.where("loads or o_orderkey % 101 = 0").selectExpr("cid", "'open_it' as callee")).unionByName(orders.where("loads and o_orderkey % 97 <> 0").selectExpr("cid", "'close_it' as callee")))


@query(PEERS + FENCED + " SELECT anchor, other, together, callers, round(strength, 4) AS strength FROM a")
def divergence_fence(spark, d):
    """Rules above the fence of all candidates: one, between what loaders open and close."""
    return consensus.audit(consensus.candidates(_peers(spark, d))).select("anchor", "other", "together", "callers", F.round("strength", 4).alias("strength"))


@query(PEERS + FENCED + """, z AS (SELECT cid, regexp_extract(cid, ':([a-z]+)_', 1) AS name, CASE WHEN cid LIKE 'f3.py%' THEN 'tests' ELSE 'core_logic' END AS cluster, count(*) AS size FROM b GROUP BY cid),
w AS (SELECT a.anchor, a.other AS missing, z.*, '0/' || CASE WHEN size = 2 THEN '0' WHEN size <= 4 THEN '1-2' WHEN size <= 7 THEN '3-5' ELSE '6+' END AS graph FROM a JOIN b x ON x.callee = a.anchor JOIN b y ON y.callee = a.other AND y.cid = x.cid JOIN z ON z.cid = x.cid),
mn AS (SELECT anchor, missing, name FROM w GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY anchor, missing ORDER BY count(*) DESC, min(cid)) = 1),
mc AS (SELECT anchor, missing, cluster FROM w GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY anchor, missing ORDER BY count(*) DESC, min(cid)) = 1),
mg AS (SELECT anchor, missing, graph FROM w GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY anchor, missing ORDER BY count(*) DESC, min(cid)) = 1),
s1 AS (SELECT z.*, a.anchor, a.other AS missing, '0/' || CASE WHEN size = 1 THEN '0' WHEN size <= 3 THEN '1-2' WHEN size <= 6 THEN '3-5' ELSE '6+' END AS graph FROM a JOIN b ON b.callee = a.anchor JOIN z ON z.cid = b.cid WHERE b.cid NOT IN (SELECT cid FROM b WHERE callee = a.other))
SELECT cid AS site, anchor, missing FROM s1 JOIN mn USING (anchor, missing, name) JOIN mc USING (anchor, missing, cluster) JOIN mg USING (anchor, missing, graph)""")
def divergence_findings(spark, d):
    """Loaders that open and don't close, told apart from scanners, from tests, and from functions of another size, by three lenses."""
    bags = staged(_peers(spark, d), "peer-bags")  # both are read several times
    held = staged(consensus.audit(consensus.candidates(bags)), "peer-rules")
    clusters = bags.selectExpr("regexp_extract(cid, '^(.*):', 1) as path").distinct().selectExpr("path", "if(path = 'f3.py', 'tests', 'core_logic') as cluster")
    return consensus.same_role(consensus.missing_sites(held, bags), held, bags, clusters).select("site", "anchor", "missing")


# --- files that imports stand for ---------------------------------------------------------------------------------------

# language, importing file, what it imports, the file that answers
LINKS = [
    ("python", "p{k}/a.py", "pkg{k}.mod", "pkg{k}/mod.py"), ("typescript", "w{k}/a.ts", "./lib", "w{k}/lib.ts"), ("java", "j{k}/App.java", "org.d{k}.Part", "src/main/java/org/d{k}/Part.java"), ("csharp", "n{k}/P.cs", "D{k}.Tools", "D{k}/Tools.cs"),
    ("php", "h{k}/i.php", "App\\M{k}", "app/M{k}.php"), ("ruby", "r{k}/run.rb", "./tool", "r{k}/tool.rb"), ("rust", "src/u{k}.rs", "crate::m{k}::Item", "src/m{k}.rs"), ("zig", "z{k}/main.zig", "lib{k}.zig", "z{k}/lib{k}.zig"),
    ("go", "g{k}/main.go", "ex.org/proj/g{k}/store", "g{k}/store/db.go"), ("cpp", "c{k}/m.c", "util.h", "c{k}/util.h"), ("sql", "q{k}/a.sql", "x{k}", "q{k}/x{k}"), ("scss", "s{k}/a.scss", "mix", "s{k}/_mix.scss"), ("python", "o{k}/a.py", "os", None), ("java", "l{k}/A.java", "java.util.List", None),
]


def _links(column: int, number: str, quote) -> str:
    return f"replace(CASE {number} % {len(LINKS)} " + " ".join(f"WHEN {i} THEN {'NULL' if row[column] is None else quote(row[column])}" for i, row in enumerate(LINKS)) + f" END, '{{k}}', CAST({number} AS STRING))"


@query(f"SELECT {_links(1, 'p_partkey', repr).replace('STRING', 'VARCHAR').replace(chr(92) * 2, chr(92))} AS src, {_links(3, 'p_partkey', repr).replace('STRING', 'VARCHAR')} AS dst FROM part WHERE {_links(3, 'p_partkey', repr).replace('STRING', 'VARCHAR')} IS NOT NULL")
def import_links(spark, d):
    """Imports of eleven languages with the file that each stands for; what belongs to the language itself stands for none."""
    quoted = lambda x: rules.listed([x])
    rows = read_table(spark, d, "part").selectExpr(f"{_links(0, 'p_partkey', quoted)} as language", f"{_links(1, 'p_partkey', quoted)} as path", f"{_links(2, 'p_partkey', quoted)} as name", f"{_links(3, 'p_partkey', quoted)} as target")
    every = rows.select("path").unionByName(rows.selectExpr("target as path").where("path is not null")).distinct()
    return imports.edges(rows.select("path", "language", "name"), every)


# path ({k}: the part), and what the file is for by its name and folder
CLUSTERS = [
    ("a{k}/main.py", "entry_points"), ("a{k}/test_x.py", "tests"), ("a{k}/settings.py", "config"), ("x/plugins/p{k}.py", "plugins"), ("x/utils/u{k}.py", "utilities"), ("x{k}/parser.py", "core_logic"), ("x{k}/plain.py", "other"),
    ("w{k}/app.tsx", "entry_points"), ("w{k}/env.ts", "config"), ("w/types/t{k}.ts", "utilities"), ("w/components/c{k}.tsx", "core_logic"), ("g/handlers/h{k}.go", "core_logic"), ("g{k}/settings.go", "config"), ("j/services/S{k}.java", "core_logic"), ("j/x{k}/AppConfig.java", "config"),
    ("n{k}/Startup.cs", "entry_points"), ("n/x/Y{k}Service.cs", "core_logic"), ("n/x/Z{k}Extensions.cs", "utilities"), ("r/x{k}/mod.rs", "infrastructure"), ("r{k}/lib.rs", "entry_points"), ("c/third_party/t{k}.c", "infrastructure"), ("c/api/t{k}.c", "core_logic"), ("h/views/v{k}.php", "presentation"),
    ("h/models/m{k}.php", "core_logic"), ("b/spec/s{k}.rb", "tests"), ("b/lib/s{k}.rb", "core"), ("i/x/V{k}ViewModel.swift", "core_logic"), ("z{k}/build.zig", "config"), ("q/v{k}_add.sql", "migrations"), ("q/x/seed{k}.sql", "seeds"), ("d/README{k}.md", "entry_points"), ("docs/d{k}.md", "documentation"),
    ("s/_p{k}.scss", "utilities"), ("y{k}.yaml", "config"), ("t{k}/index.html", "entry_points"), ("t/reset{k}.css", "utilities"), ("t/card{k}.css", "core_logic"),
]


@query(f"WITH p AS (SELECT p_partkey AS k, p_partkey % {len(CLUSTERS)} AS i FROM part) SELECT replace(CASE i " + " ".join(f"WHEN {i} THEN '{p}'" for i, (p, _) in enumerate(CLUSTERS)) + " END, '{k}', CAST(k AS VARCHAR)) AS path, CASE i " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(CLUSTERS)) + " END AS cluster FROM p")
def path_clusters(spark, d):
    """What files of sixteen languages are for, by their names and folders."""
    path = f"replace(case p_partkey % {len(CLUSTERS)} " + " ".join(f"when {i} then '{p}'" for i, (p, _) in enumerate(CLUSTERS)) + " end, '{k}', cast(p_partkey as string))"
    rows = read_table(spark, d, "part").selectExpr(f"{path} as path").selectExpr("path", f"{language_of()} as language", "'' as content")
    return rows.selectExpr("path", f"{rules.cluster('language', 'path', 'content')} as cluster")
