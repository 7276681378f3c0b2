"""Each operator of the library on a driver table of the same shape, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scoring
from quarry.operators import changes, condense, consensus, graphs, health, imports, markup, paths, ranking, rules, text, views
from quarry.scratch import dealt, portioned, read_table
from quarry.streaming import memory

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- inputs -----------------------------------------------------------------------------------


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("doc_id is not null").selectExpr("doc_id as path", "coalesce(text, '') as content")


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").selectExpr("regexp_replace(url, '^[a-z]+://', '') as path", "cast(length(html) as bigint) as size", "html").selectExpr("regexp_replace(path, '[?#].*$', '') as path", "size", "html")


def part_calls(spark: SparkSession, d: str) -> DataFrame:
    """(custkey, status, brand, type) of each line item."""
    o, li, p = (read_table(spark, d, t) for t in ("orders", "lineitem", "part"))
    ordered = dealt(li.select("l_orderkey", "l_partkey"), "l_orderkey").join(dealt(o.select("o_orderkey", "o_custkey", "o_orderstatus")), F.col("l_orderkey") == F.col("o_orderkey"))
    return dealt(ordered, "l_partkey").join(dealt(p.select("p_partkey", "p_brand", "p_type")), F.col("l_partkey") == F.col("p_partkey"))


def call_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    calls = part_calls(spark, d).selectExpr("concat('c', o_custkey) as caller_name", "p_brand as callee_name")
    own = read_table(spark, d, "customer").where("c_acctbal > 0").selectExpr("concat('cust:c', c_custkey) as fqn", "concat('c', c_custkey) as name", "cast(null as string) as parent")
    brands = read_table(spark, d, "part").selectExpr("concat(p_type, ':', p_brand) as fqn", "p_brand as name", "p_type as parent").distinct()
    return own.unionByName(brands), calls


def usage(spark: SparkSession, d: str, by_status: bool = False) -> DataFrame:
    cid = "concat(o_custkey, ':', o_orderstatus)" if by_status else "cast(o_custkey as string)"
    return consensus.bags(part_calls(spark, d).selectExpr(f"{cid} as cid", "p_brand as callee"))


def commit_facts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").selectExpr("concat(user_id, ':', date(ts)) as commit_id", "ts", "event_type as path")


# --- lines, sections, search, words -----------------------------------------------------------

LINES = "SELECT doc_id AS path, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL"
SECTIONS = f"""WITH l AS ({LINES}), h AS (SELECT path, line_no, CASE WHEN line_no - coalesce(lag(line_no) OVER (PARTITION BY path ORDER BY line_no), -1) > 1 THEN 1 ELSE 0 END AS head FROM l WHERE trim(text, ' ') <> ''),
s AS (SELECT path, line_no, sum(head) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section_no FROM h),
n AS (SELECT path, CAST(section_no AS BIGINT) AS section_no, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_lines FROM s GROUP BY 1, 2)"""


@query(f"SELECT path, line_no, md5(text) AS digest FROM ({LINES})")
def lines_explode(spark, d):
    return text.lines(doc_files(spark, d)).selectExpr("path", "line_no", "md5(text) as digest")


@query(SECTIONS + " SELECT * FROM n")
def section_split(spark, d):
    return text.sections(text.lines(doc_files(spark, d)))


@query(
    SECTIONS
    + """, m AS (SELECT l.path, l.line_no, max(n.section_no) AS node_id FROM l LEFT JOIN n ON l.path = n.path AND l.line_no BETWEEN n.start_line AND n.end_line WHERE regexp_matches(l.text, '(?i)disgusting|license|www') GROUP BY 1, 2),
g AS (SELECT m.path, m.node_id, n.start_line, n.end_line, count(*) AS hits FROM m LEFT JOIN n ON m.path = n.path AND m.node_id = n.section_no GROUP BY ALL)
SELECT path, node_id, start_line, end_line, hits, CAST(sum(hits) OVER (PARTITION BY path) AS BIGINT) AS file_total FROM g ORDER BY path % 7 = 0, file_total DESC, path, hits DESC, start_line LIMIT 40"""
)
def search_ranked(spark, d):
    wanted = "disgusting|license|www"
    ls = text.lines(text.with_hits(doc_files(spark, d), wanted))
    return text.search(ls, text.sections(ls).withColumnRenamed("section_no", "node_id"), wanted, is_test="path % 7 = 0")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM documents) GROUP BY word")
def word_counts(spark, d):
    return text.word_counts(doc_files(spark, d))


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([A-Za-z0-9_]+)\s*\(', 1)) AS word FROM documents) GROUP BY word")
def call_like_counts(spark, d):
    return text.word_counts(doc_files(spark, d), r"([A-Za-z0-9_]+)\s*\(", 1)


@query("SELECT word AS name FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM documents) WHERE length(word) >= 4 GROUP BY word HAVING count(*) = 1")
def unreferenced_terms(spark, d):
    counts = text.word_counts(doc_files(spark, d))
    return text.unreferenced(counts.select(F.col("word").alias("name")), counts)


@query("""WITH b AS (SELECT doc_id AS path, unnest(string_split(text, chr(10) || chr(10))) AS body FROM documents WHERE text IS NOT NULL),
n AS (SELECT path, list_filter(list_transform(string_split(body, chr(10)), lambda x: rtrim(x, ' ')), lambda x: x <> '') AS ls FROM b)
SELECT md5(array_to_string(ls, chr(10))) AS digest, len(ls) AS n_lines, count(*) AS members, min(path) AS first_path FROM n GROUP BY ls HAVING count(*) >= 2 AND len(ls) >= 1""")
def duplicate_blocks(spark, d):
    blocks = doc_files(spark, d).select("path", F.explode(F.split("content", "\n\n", -1)).alias("body"))
    return text.duplicate_blocks(blocks, min_lines=1).where("digest <> md5('')").selectExpr("digest", "cast(n_lines as bigint) as n_lines", "members", "first_path")


@query("SELECT path, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT path, n, sum(n) OVER (PARTITION BY path) AS t FROM (SELECT path, c, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id AS path, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1, 2)) GROUP BY path")
def shannon_entropy(spark, d):
    return text.shannon_entropy(doc_files(spark, d)).select("path", F.round("entropy", 6).alias("entropy"))


# --- graphs -----------------------------------------------------------------------------------

CALLS = """WITH c0 AS (SELECT 'c' || o_custkey AS caller_name, p_brand AS callee_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
d AS (SELECT 'cust:c' || c_custkey AS fqn, 'c' || c_custkey AS name, NULL AS parent FROM customer WHERE c_acctbal > 0 UNION ALL SELECT DISTINCT p_type || ':' || p_brand, p_brand, p_type FROM part),
c AS (SELECT DISTINCT * FROM c0), m AS (SELECT name, count(*) AS n FROM d GROUP BY name),
e AS (SELECT a.fqn AS src, b.fqn AS dst, sum(1.0::DOUBLE / (ma.n * mb.n)) AS weight FROM c JOIN m ma ON caller_name = ma.name JOIN m mb ON callee_name = mb.name JOIN d a ON caller_name = a.name JOIN d b ON callee_name = b.name WHERE a.fqn <> b.fqn GROUP BY 1, 2),
i AS (SELECT dst AS fqn, sum(weight) AS w, count(*) AS n FROM e GROUP BY 1), o AS (SELECT src AS fqn, sum(weight) AS w, count(*) AS n FROM e GROUP BY 1),
v AS (SELECT d.fqn, round(coalesce(i.w, 0), 6) AS in_weight, round(coalesce(o.w, 0), 6) AS out_weight, coalesce(i.n, 0) AS n_callers, coalesce(o.n, 0) AS n_callees, round(2 * coalesce(i.w, 0) + coalesce(o.w, 0), 6) AS centrality FROM d LEFT JOIN i USING (fqn) LEFT JOIN o USING (fqn))"""


@query(CALLS + " SELECT src, dst, round(weight, 6) AS weight FROM e")
def call_edges(spark, d):
    return graphs.call_edges(*call_facts(spark, d)).select("src", "dst", F.round("weight", 6).alias("weight"))


def _nodes(spark, d):
    defs, calls = call_facts(spark, d)
    n = graphs.call_nodes(defs, graphs.call_edges(defs, calls))
    return n.select("fqn", *(F.round(c, 6).alias(c) for c in ("in_weight", "out_weight")), "n_callers", "n_callees", F.round("centrality", 6).alias("centrality"))


@query(CALLS + " SELECT * FROM v")
def call_centrality(spark, d):
    return _nodes(spark, d)


@query(CALLS + " SELECT * FROM v WHERE centrality > 0 ORDER BY centrality DESC, fqn LIMIT 10")
def hot_functions(spark, d):
    return graphs.hot(_nodes(spark, d))


@query(CALLS + ", k AS (SELECT name FROM d UNION SELECT parent FROM d WHERE parent IS NOT NULL) SELECT count(*) AS total, count(k.name) AS resolved, count(*) - count(k.name) AS dropped, round(count(k.name) / count(*), 6) AS rate FROM c0 LEFT JOIN k ON caller_name = k.name")
def contract_health(spark, d):
    return graphs.contract_health(*call_facts(spark, d)).withColumn("rate", F.round("rate", 6))


IMPORTS = "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_partkey % 3 <> 0 UNION SELECT DISTINCT 's' || l_suppkey, 'q' || (l_partkey + 1) FROM lineitem WHERE l_partkey % 3 = 0)"


def _import_edges(spark, d):
    # dealt before it is made distinct: a split has nearly as many pairs as rows, and would hold them all
    li = dealt(read_table(spark, d, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct()
    imports = li.selectExpr("concat('s', l_suppkey) as source_file", "array(concat('p', l_partkey), concat('q', l_partkey + 1)) as candidates")
    parts = read_table(spark, d, "part")
    files = parts.selectExpr("explode(array(case when p_partkey % 3 <> 0 then concat('p', p_partkey) end, concat('q', p_partkey + 1))) as path").where("path is not null")
    return graphs.import_edges(imports, portioned(files, 2 * parts.count(), "path").distinct())


@query(IMPORTS + " SELECT * FROM e")
def import_edges(spark, d):
    return _import_edges(spark, d)


@query(IMPORTS + ", x AS (SELECT src AS path, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT path, CAST(sum(o) AS BIGINT) AS n_imports, CAST(sum(i) AS BIGINT) AS n_importers, CAST(2 * sum(i) + sum(o) AS BIGINT) AS centrality FROM x GROUP BY path")
def file_centrality(spark, d):
    return graphs.file_centrality(_import_edges(spark, d))


# --- divergence -------------------------------------------------------------------------------


def _bag_sql(cid: str) -> str:
    return f"""WITH b AS (SELECT DISTINCT {cid} AS cid, p_brand AS callee FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
n AS (SELECT callee, count(*) AS callers, count(*) / (SELECT count(DISTINCT cid) FROM b) AS rate FROM b GROUP BY callee),
p AS (SELECT x.callee AS anchor, y.callee AS other, count(*) AS together FROM b x JOIN b y ON x.cid = y.cid AND x.callee <> y.callee GROUP BY 1, 2),
q AS (SELECT p.*, na.callers, no.rate FROM p JOIN n na ON anchor = na.callee JOIN n no ON other = no.callee)"""


RULES = """, r AS (SELECT * FROM q WHERE callers >= 3 AND together > callers * 0.5 AND together < callers),
t AS (SELECT anchor, other, together, callers, rate, unnest(generate_series(together, callers)) AS j FROM r),
u AS (SELECT anchor, other, together, callers, rate, lgamma(callers + 1) - lgamma(j + 1) - lgamma(callers - j + 1) + j * ln(rate) + (callers - j) * ln(1 - rate) AS x FROM t WHERE rate < 1),
s0 AS (SELECT anchor, other, together, callers, rate, greatest(0, -ln(sum(exp(x))) / ln(10)) AS enrichment FROM u GROUP BY ALL),
s AS (SELECT *, enrichment * -log10((callers - together) / (callers + 1)) AS strength FROM s0)"""
AUDIT = RULES + """, h AS (SELECT * FROM s WHERE enrichment >= 3), f AS (SELECT count(*) AS n, quantile_cont(strength, 0.25) AS q1, quantile_cont(strength, 0.75) AS q3, max(strength) AS most FROM s),
a AS (SELECT h.* FROM h, f WHERE strength > CASE WHEN n < 8 THEN '-infinity'::DOUBLE WHEN q1 = q3 THEN most ELSE q3 + 3 * (q3 - q1) END)"""
BY_CUST, BY_STATUS = "CAST(o_custkey AS VARCHAR)", "o_custkey || ':' || o_orderstatus"


@query(_bag_sql(BY_CUST) + " SELECT * FROM b")
def usage_bags(spark, d):
    return usage(spark, d)


@query(_bag_sql(BY_CUST) + " SELECT callee, callers, round(rate, 6) AS rate FROM n")
def base_rates(spark, d):
    return consensus.base_rates(usage(spark, d)).withColumn("rate", F.round("rate", 6))


@query(_bag_sql(BY_CUST) + " SELECT anchor, other, together, callers FROM q")
def cooccurrence(spark, d):
    return consensus.cooccurrence(usage(spark, d))


def _rounded(rules: DataFrame) -> DataFrame:
    return rules.select("anchor", "other", "together", "callers", F.round("enrichment", 5).alias("enrichment"), F.round("strength", 5).alias("strength"))


@query(_bag_sql(BY_CUST) + RULES + " SELECT anchor, other, together, callers, round(enrichment, 5) AS enrichment, round(strength, 5) AS strength FROM s")
def divergence_candidates(spark, d):
    return _rounded(consensus.candidates(usage(spark, d)))


@query(_bag_sql(BY_STATUS) + AUDIT + " SELECT anchor, other, together, callers, round(enrichment, 5) AS enrichment, round(strength, 5) AS strength FROM a")
def divergence_audit(spark, d):
    return _rounded(consensus.audit(consensus.candidates(usage(spark, d, True))))


@query(_bag_sql(BY_STATUS) + RULES.replace("callers * 0.5", "callers * 0.0") + ", h AS (SELECT * FROM s WHERE enrichment >= 3) SELECT b.cid AS site, h.anchor, h.other AS missing, h.together, h.callers, round(h.strength, 5) AS strength FROM h JOIN b ON b.callee = h.anchor WHERE NOT EXISTS (SELECT 1 FROM b z WHERE z.cid = b.cid AND z.callee = h.other) AND b.cid LIKE '%:O'")
def divergence_review(spark, d):
    bags = usage(spark, d, True)
    rules = consensus.candidates(bags, share=0.0).where(F.col("enrichment") >= consensus.SIGNIFICANT)
    sites = consensus.missing_sites(rules, bags).withColumn("strength", F.round("strength", 5))
    return consensus.review(sites, bags.where("cid like '%:O'").select(F.col("cid").alias("site")))


# --- markup -----------------------------------------------------------------------------------


@query(r"SELECT page_id AS path, level, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<h([1-6])', 1)) AS level FROM pages) GROUP BY 1, 2")
def html_headings(spark, d):
    return markup.headings(read_table(spark, d, "pages").selectExpr("page_id as path", "html as content"))


@query(r"SELECT page_id AS path, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(section|article|nav|aside|header|footer|main|form|table|ul|ol)[\s>]', 1)) AS tag FROM pages) GROUP BY 1, 2")
def html_sections(spark, d):
    return markup.landmarks(read_table(spark, d, "pages").selectExpr("page_id as path", "html as content"))


@query(r"""SELECT page_id AS path, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:a|link|script|img)[^>]*?(?:href|src)="([^"]*)"', 1)) AS target FROM pages) WHERE target <> '' AND NOT regexp_matches(target, '^(?:[a-z]+:)?//') GROUP BY 1, 2""")
def html_imports(spark, d):
    return markup.local_links(read_table(spark, d, "pages").selectExpr("page_id as path", "html as content"))


@query(r"SELECT page_id AS path, regexp_matches(html, '(?i)<!doctype html') AS has_doctype, regexp_matches(html, '(?i)<meta[^>]*viewport') AS has_viewport FROM pages WHERE regexp_matches(html, '(?i)<!doctype html|<meta[^>]*viewport')")
def html_entry_points(spark, d):
    return markup.entry_points(read_table(spark, d, "pages").selectExpr("page_id as path", "html as content"))


# --- paths ------------------------------------------------------------------------------------

PAGE_PATHS = "WITH f AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, length(html) AS size FROM pages), p AS (SELECT *, string_split(path, '/') AS parts FROM f)"


@query(PAGE_PATHS + " SELECT split_part(path, '/', 1) AS top, split_part(path, '/', 2) AS sub, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY ROLLUP (1, 2)")
def path_rollup(spark, d):
    return paths.rollup(page_paths(spark, d))


@query(PAGE_PATHS + ", e AS (SELECT parts, unnest(generate_series(1, len(parts) - 1)) AS depth FROM p) SELECT DISTINCT array_to_string(parts[1:depth], '/') AS prefix, CAST(depth AS INT) AS depth FROM e WHERE depth <= 3")
def dir_listing(spark, d):
    return paths.listing(page_paths(spark, d))


@query(PAGE_PATHS + " SELECT CASE WHEN len(parts) = 1 THEN '(root)' ELSE parts[1] END AS top, count(*) AS n_files, count(DISTINCT CASE WHEN len(parts) > 2 THEN parts[2] END) AS n_subs FROM p GROUP BY 1")
def dir_structure(spark, d):
    return paths.structure(page_paths(spark, d))


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rank FROM documents GROUP BY 1, 2) WHERE rank = 1")
def language_tag(spark, d):
    return ranking.modal(read_table(spark, d, "documents"), "source", "lang")


@query("SELECT source AS name, count(*) AS n_files, count(*) FILTER (lang = 'en') AS n_code, round(count(*) * (1 + 0.3 * count(*) FILTER (lang = 'en') / count(*)), 6) AS relevance FROM documents WHERE source IS NOT NULL GROUP BY 1")
def relevance(spark, d):
    dirs = read_table(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n_files"), F.expr("count_if(lang = 'en')").alias("n_code"))
    return paths.relevance(dirs).withColumn("relevance", F.round("relevance", 6))


DIRS = "WITH RECURSIVE d AS (SELECT 'r' || r_regionkey AS dir, NULL AS parent, r_name AS name, 0 AS n_files FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 1 FROM nation UNION ALL SELECT 'c' || c_nationkey, 'n' || c_nationkey, 'leaf', CAST(count(*) AS INT) FROM customer GROUP BY c_nationkey)"


@query(DIRS + """, o AS (SELECT parent, min(dir) AS child FROM d WHERE parent IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
w AS (SELECT dir AS head, dir, 0 AS depth FROM d UNION ALL SELECT w.head, o.child, w.depth + 1 FROM w JOIN d x ON w.dir = x.dir JOIN o ON o.parent = w.dir WHERE x.n_files <= 3 AND x.name NOT IN ('src', 'lib', 'app', 'tests', 'docs', 'bin', 'pkg'))
SELECT head, arg_max(dir, depth) AS tail, max(depth) AS hops FROM w GROUP BY head""")
def chain_collapse(spark, d):
    r, n, c = (read_table(spark, d, t) for t in ("region", "nation", "customer"))
    dirs = r.selectExpr("concat('r', r_regionkey) as dir", "cast(null as string) as parent", "r_name as name", "0 as n_files").unionByName(n.selectExpr("concat('n', n_nationkey) as dir", "concat('r', n_regionkey) as parent", "n_name as name", "1 as n_files"))
    leaves = c.groupBy("c_nationkey").count().selectExpr("concat('c', c_nationkey) as dir", "concat('n', c_nationkey) as parent", "'leaf' as name", "cast(count as int) as n_files")
    return paths.chains(dirs.unionByName(leaves))


RULE_ROWS = [(0, False, ".*/en/.*"), (1, True, ".*/en/[0-9]$"), (2, False, "^m[.].*"), (3, True, ".*/fr/.*")]


@query(PAGE_PATHS + ", r(ord, negated, regex) AS (VALUES (0, false, '.*/en/.*'), (1, true, '.*/en/[0-9]$'), (2, false, '^m[.].*'), (3, true, '.*/fr/.*')) SELECT f.path, coalesce(NOT arg_max(r.negated, r.ord), false) AS ignored FROM f LEFT JOIN r ON regexp_matches(f.path, r.regex) GROUP BY f.path")
def last_match_wins(spark, d):
    return paths.last_match(page_paths(spark, d).select("path"), spark.createDataFrame(RULE_ROWS, "ord int, negated boolean, regex string"))


@query(PAGE_PATHS + " SELECT path, size FROM f WHERE regexp_matches(path, '^(?:.*/)?(?:en|fr)/[0-9][^/]*$')")
def glob_filter(spark, d):
    wanted = " or ".join(f"path rlike '{paths.glob_regex(g)}'" for g in paths.expand_braces("**/{en,fr}/[0-9]*"))
    return page_paths(spark, d).where(wanted).select("path", "size")


@query(PAGE_PATHS + " SELECT path FROM f WHERE NOT list_contains(parts_(path), 'de')".replace("parts_(path)", "string_split(path, '/')[1:-2]"))
def skip_dirs(spark, d):
    return paths.skipped(page_paths(spark, d), ("de",)).select("path")


# --- ranking ----------------------------------------------------------------------------------


@query("""WITH f AS (SELECT doc_id AS path, n_chars AS size, doc_id AS age, doc_id % 5 // 3 AS importers FROM documents), b AS (SELECT min(age) + (max(age) - min(age)) * 0.25 AS recent, min(age) + (max(age) - min(age)) * 0.5 AS old FROM f),
m AS (SELECT greatest(2000, (list_sort(list(size) FILTER (size > 0)))[CAST(floor(count(*) FILTER (size > 0) / 2) AS INT) + 1]) AS large FROM f)
SELECT path, CASE WHEN importers > 0 AND age <= recent THEN 'active_core' WHEN importers > 0 AND age >= old AND size < 1000 THEN 'stable_utilities' WHEN importers > 0 AND age >= old THEN 'core_infrastructure' WHEN importers = 0 AND age <= recent AND size >= large THEN 'active_development' WHEN importers = 0 AND age >= old AND size < 1000 THEN 'potentially_stale' END AS archetype FROM f, b, m""")
def archetypes(spark, d):
    return ranking.archetypes(_aged(spark, d))


def _aged(spark, d):
    return read_table(spark, d, "documents").selectExpr("doc_id as path", "n_chars as size", "doc_id as age", "doc_id % 5 div 3 as importers")


@query("""WITH f AS (SELECT doc_id AS path, n_chars AS size, doc_id AS age, doc_id % 5 // 3 AS importers, CASE WHEN doc_id % 5 >= 3 THEN 'active_core' WHEN n_chars > 1500 THEN 'active_development' ELSE 'potentially_stale' END AS archetype FROM documents)
SELECT path, archetype, row_number() OVER (PARTITION BY archetype ORDER BY CASE archetype WHEN 'active_core' THEN -importers WHEN 'active_development' THEN age ELSE -age END, path) AS rank FROM f QUALIFY rank <= 4""")
def archetype_leaders(spark, d):
    rows = _aged(spark, d).withColumn("archetype", F.expr("case when importers > 0 then 'active_core' when size > 1500 then 'active_development' else 'potentially_stale' end"))
    return ranking.first_by_archetype(rows).select("path", "archetype", "rank")


@query("SELECT (list_sort(list(n_chars) FILTER (n_chars > 0)))[CAST(floor(count(*) FILTER (n_chars > 0) / 2) AS INT) + 1] AS median FROM documents")
def upper_median(spark, d):
    return ranking.upper_median(read_table(spark, d, "documents"), "n_chars")


@query("SELECT doc_id AS path, CASE doc_id % 6 WHEN 0 THEN 'tests' WHEN 1 THEN 'config' WHEN 2 THEN 'core_logic' WHEN 3 THEN 'plugins' WHEN 4 THEN 'entry_points' ELSE CASE WHEN contains(text, 'if __name__ ==') OR contains(text, 'def main(') THEN 'entry_points' ELSE 'other' END END AS cluster FROM documents WHERE text IS NOT NULL")
def classify(spark, d):
    names = "array('test_a.py', 'settings.py', 'row_parser.py', 'x.py', '__main__.py', 'x.py')[doc_id % 6]"
    rows = read_table(spark, d, "documents").where("text is not null").selectExpr("doc_id", "text", f"concat('src/', if(doc_id % 6 = 3, 'plugins/', ''), {names}) as path")
    return rows.selectExpr("doc_id as path", f"{rules.cluster("'python'", 'path', 'text')} as cluster")


@query("SELECT o_custkey AS file, o_orderstatus AS name, max(o_orderkey) AS line FROM orders GROUP BY 1, 2")
def top_entry_dedupe(spark, d):
    return ranking.last_by(read_table(spark, d, "orders").selectExpr("o_custkey as file", "o_orderstatus as name", "o_orderkey as line"), ["file", "name"], "line")


def _line_nodes(spark, d):
    return read_table(spark, d, "lineitem").selectExpr("l_orderkey as path", "l_linenumber as node", "l_extendedprice as score", "l_quantity as cost")


LINE_NODES = "WITH n AS (SELECT l_orderkey AS path, l_linenumber AS node, l_extendedprice AS score, l_quantity AS cost FROM lineitem)"


@query(LINE_NODES + ", r AS (SELECT *, sum(cost) OVER (PARTITION BY path ORDER BY score DESC, node ROWS UNBOUNDED PRECEDING) AS running FROM n) SELECT path, node, running, running <= 60 AS kept FROM r")
def prefix_budget(spark, d):
    return ranking.within_budget(_line_nodes(spark, d), "path", "score", "node", "cost", 60).select("path", "node", "running", "kept")


@query(LINE_NODES + " SELECT path, node, CASE WHEN row_number() OVER (PARTITION BY path ORDER BY score DESC, node) <= 3 THEN 'full' ELSE 'short' END AS tier FROM n")
def tiers(spark, d):
    return ranking.tiers(_line_nodes(spark, d), "path", "score", "node").select("path", "node", "tier")


@query(LINE_NODES + ", r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, node) AS rank, count(*) OVER (PARTITION BY path) AS members FROM n) SELECT path, node FROM r WHERE rank <= greatest(1, floor(0.2 * members))")
def top_salient(spark, d):
    return ranking.top_share(_line_nodes(spark, d), "path", "score", "node").select("path", "node")


@query(LINE_NODES + ", m AS (SELECT *, min(score) OVER (PARTITION BY path) AS lo, max(score) OVER (PARTITION BY path) AS hi FROM n) SELECT path, node, round(CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END, 6) AS normal FROM m")
def minmax_norm(spark, d):
    return ranking.min_max(_line_nodes(spark, d), "path", "score").select("path", "node", F.round("normal", 6).alias("normal"))


@query("SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS rank FROM customer GROUP BY 1, 2) WHERE rank = 1")
def modal_role(spark, d):
    return ranking.modal(read_table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


# --- changes ----------------------------------------------------------------------------------

COMMITS = "WITH c AS (SELECT user_id || ':' || CAST(ts AS DATE) AS commit_id, ts, event_type AS path FROM events), w AS (SELECT * FROM c WHERE ts >= (SELECT max(ts) FROM c) - INTERVAL 10 DAY)"


@query(COMMITS + " SELECT path, count(DISTINCT commit_id) AS churn FROM c GROUP BY path")
def churn(spark, d):
    return changes.churn(commit_facts(spark, d))


@query(COMMITS + ", s AS (SELECT DISTINCT commit_id, path FROM c), z AS (SELECT commit_id FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20), p AS (SELECT x.path AS a, y.path AS b, count(*) AS together FROM s x JOIN s y ON x.commit_id = y.commit_id AND x.path < y.path JOIN z ON x.commit_id = z.commit_id GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5) SELECT * FROM p WHERE together >= 2")
def co_change(spark, d):
    return changes.co_change(commit_facts(spark, d))


@query(COMMITS + " SELECT path, count(DISTINCT commit_id) AS churn FROM w GROUP BY path")
def activity_window(spark, d):
    return changes.churn(changes.active_window(commit_facts(spark, d), days=10))


@query("""WITH k AS (SELECT conv_id AS path, CAST(turn AS VARCHAR) AS node_key, sha1(text) AS h FROM conversations), n AS (SELECT conv_id AS path, CAST(turn - 1 AS VARCHAR) AS node_key, sha1(text) AS h FROM conversations WHERE turn > 0)
SELECT coalesce(k.path, n.path) AS path, coalesce(k.node_key, n.node_key) AS node_key, CASE WHEN k.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN k.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM k FULL JOIN n ON k.path = n.path AND k.node_key = n.node_key""")
def node_diff(spark, d):
    c = read_table(spark, d, "conversations")
    return changes.node_diff(c.selectExpr("conv_id as path", "cast(turn as string) as node_key", "sha1(text) as digest"), c.where("turn > 0").selectExpr("conv_id as path", "cast(turn - 1 as string) as node_key", "sha1(text) as digest"))


@query("WITH s AS (SELECT conv_id AS path, turn AS node_id, turn * 10 AS start_line, turn * 10 + 14 AS end_line FROM conversations), e AS (SELECT user_id AS path, event_id % 60 AS line_no, CAST(CAST(ts AS DATE) AS VARCHAR) AS commit_id FROM events) SELECT s.path, s.node_id, count(DISTINCT e.commit_id) AS edits FROM s LEFT JOIN e ON s.path = e.path AND e.line_no BETWEEN s.start_line AND s.end_line GROUP BY 1, 2")
def line_edits(spark, d):
    spans = read_table(spark, d, "conversations").selectExpr("conv_id as path", "turn as node_id", "turn * 10 as start_line", "turn * 10 + 14 as end_line")
    edits = read_table(spark, d, "events").selectExpr("user_id as path", "event_id % 60 as line_no", "cast(date(ts) as string) as commit_id")
    return changes.span_edits(spans, edits)


# --- health -----------------------------------------------------------------------------------


@query(r"WITH p AS (SELECT page_id AS pid, regexp_extract(url, '/([A-Za-z0-9_-]+)(?:[?#].*)?$', 1) AS token FROM pages), t AS (SELECT DISTINCT token FROM p WHERE token <> ''), h AS (SELECT token FROM t WHERE EXISTS (SELECT 1 FROM pages WHERE contains(html, token))) SELECT pid, token FROM p WHERE token <> '' AND token NOT IN (SELECT token FROM h)")
def orphan_tokens(spark, d):
    pages = read_table(spark, d, "pages")
    return health.orphans(pages.selectExpr("page_id as pid", r"regexp_extract(url, '/([A-Za-z0-9_-]+)(?:[?#].*)?$', 1) as token"), pages.selectExpr("explode(split(html, '\\\\n')) as text")).select("pid", "token")


@query("SELECT doc_id AS name, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source NOT IN ('src1', 'src2')")
def reachability_antijoin(spark, d):
    docs = read_table(spark, d, "documents").selectExpr("doc_id as name", "source")
    return health.unreachable(docs, read_table(spark, d, "labels").selectExpr("doc_id as name"), docs.where("source in ('src1', 'src2')"))


@query("""WITH c AS (SELECT word AS name, count(*) AS calls FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM documents) GROUP BY 1),
f AS (SELECT DISTINCT word AS name, item_id AS file FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM benchmark)), n AS (SELECT *, count(*) OVER (PARTITION BY name) AS defs FROM f)
SELECT c.name, n.file, c.calls FROM c JOIN n ON c.name = n.name WHERE n.defs <= 2 AND n.file >= 5 ORDER BY c.calls DESC, c.name, n.file LIMIT 5""")
def leads(spark, d):
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("name")
    bench = read_table(spark, d, "benchmark")
    return health.leads(read_table(spark, d, "documents").select(words), bench.select(F.col("item_id").alias("file"), words).distinct(), bench.where("item_id < 5").select(F.col("item_id").alias("file")))


# --- beyond SQL -------------------------------------------------------------------------------


@query()
def new_information(spark, d):
    return scoring.new_information(text.lines(doc_files(spark, d)).groupBy("path").agg(F.expr("transform(array_sort(collect_list(struct(line_no, text))), x -> x.text)").alias("blocks")))


@query("""WITH s AS (SELECT conv_id AS path, md5(text) AS mark, CAST('2023-11-14 22:13:20' AS TIMESTAMP) + to_seconds(turn * 600) AS moment FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT *, lag(mark) OVER w AS last_mark, lag(moment) OVER w AS last_at FROM s WINDOW w AS (PARTITION BY path ORDER BY moment))
SELECT path, moment AS at, CASE WHEN last_at IS NULL OR moment - last_at > INTERVAL 30 MINUTE THEN 'first' WHEN mark IS NOT DISTINCT FROM last_mark THEN 'unchanged' ELSE 'changed' END AS label FROM l""")
def stream_memory_ttl(spark, d):
    return memory.replay_versions(spark, read_table(spark, d, "conversations")).withColumn("at", F.expr("cast(at as timestamp_ntz)"))


@query("SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark, d):
    return memory.hourly(spark, read_table(spark, d, "events"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS head FROM events),
s AS (SELECT user_id, ts, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_activity(spark, d):
    return read_table(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n")).selectExpr("user_id", "cast(w.start as timestamp_ntz) as start", "n")


# --- condensed forms, focus, import targets, views --------------------------------------------

SKELETON = "WITH s AS (SELECT l_orderkey AS path, l_linenumber AS line_no, repeat(' ', CAST(floor(min(l_quantity)) AS INT) % 5) || min(l_returnflag) AS text, CAST(floor(min(l_quantity)) AS INT) % 5 AS width FROM lineitem GROUP BY 1, 2)"


@query(SKELETON + """, r AS (SELECT *, dense_rank() OVER (PARTITION BY path ORDER BY width) > 2 AS cut FROM s),
m AS (SELECT *, coalesce(lag(cut) OVER (PARTITION BY path ORDER BY line_no), false) AS before FROM r)
SELECT path, line_no, CASE WHEN cut THEN '  …' ELSE text END AS text FROM m WHERE NOT (cut AND before)""")
def depth_limit(spark, d):
    rows = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line_no")).agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("flag"))
    return condense.depth_limit(rows.selectExpr("path", "line_no", "concat(repeat(' ', cast(floor(q) as int) % 5), flag) as text"), 2)


@query("SELECT doc_id AS path, line_no, rtrim(text, ' ' || chr(9) || chr(13)) AS text FROM (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) WHERE NOT regexp_matches(text, '^[\\s{}()\\[\\];,]*$')")
def compact_lines(spark, d):
    return condense.compact(text.lines(doc_files(spark, d)).selectExpr("*", "'text' as language")).selectExpr("path", "line_no", "text")


FOCUS = ["NATION_1", "REGION_1.NATION_1", "ASIA.CHINA", "asia", "CHINA", "_1", "an"]


@query(f"""WITH n AS (SELECT r_name AS path, CAST(r_regionkey AS BIGINT) * 1000 AS node_id, r_name AS name, NULL AS parent FROM region UNION ALL SELECT r_name, CAST(r_regionkey AS BIGINT) * 1000 + 1 + n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT *, unnest({FOCUS!r}) AS focus FROM n), t AS (SELECT *, CASE WHEN name = focus THEN 1 WHEN name = split_part(focus, '.', 2) AND parent = split_part(focus, '.', 1) THEN 2 WHEN contains(lower(name), lower(focus)) THEN 3 END AS tier FROM f)
SELECT focus, path, node_id, name, tier FROM t WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY focus, path)""")
def focus_nodes(spark, d):
    r, n = read_table(spark, d, "region"), read_table(spark, d, "nation")
    tops = r.selectExpr("r_name as path", "r_regionkey * 1000L as node_id", "r_name as name", "cast(array() as array<string>) as ancestors")
    below = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("r_name as path", "r_regionkey * 1000L + 1 + n_nationkey as node_id", "n_name as name", "array(r_name) as ancestors")
    return condense.focus(tops.unionByName(below), FOCUS)


@query("""WITH f AS (SELECT DISTINCT p_brand || '/' || p_size || '.h' AS path FROM part), i AS (SELECT DISTINCT p_brand || '/' || p_size || '.h' AS src, p_brand AS dir, (p_size + 1) || '.h' AS name FROM part)
SELECT src, dir || '/' || name AS dst FROM i JOIN f ON f.path = dir || '/' || name""")
def import_targets(spark, d):
    files = read_table(spark, d, "part").selectExpr("concat(p_brand, '/', p_size, '.h') as path", "concat('../', p_brand, '/./', p_size + 1, '.h') as name").distinct()
    return graphs.import_edges(imports.candidates(files.selectExpr("path", "'cpp' as language", "name")), files.select("path").distinct())


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s < 1024 THEN CASE WHEN s >= 10 THEN printf('%.1fB', s::DOUBLE) ELSE printf('%.0fB', s::DOUBLE) END
WHEN s < 1048576 THEN CASE WHEN s / 1024 >= 10 THEN printf('%.1fKB', s / 1024::DOUBLE) ELSE printf('%.0fKB', s / 1024::DOUBLE) END
WHEN s < 1073741824 THEN CASE WHEN s / 1048576 >= 10 THEN printf('%.1fMB', s / 1048576::DOUBLE) ELSE printf('%.0fMB', s / 1048576::DOUBLE) END
ELSE CASE WHEN s / 1073741824 >= 10 THEN printf('%.1fGB', s / 1073741824::DOUBLE) ELSE printf('%.0fGB', s / 1073741824::DOUBLE) END END AS label
FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) * CAST(floor(l_quantity) AS BIGINT) * (CAST(floor(l_extendedprice) AS BIGINT) % 977) * l_linenumber AS s FROM lineitem)""")
def size_labels(spark, d):
    s = "cast(floor(l_quantity) as bigint) * cast(floor(l_quantity) as bigint) * (cast(floor(l_extendedprice) as bigint) % 977) * l_linenumber as s"
    return read_table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", s).selectExpr("l_orderkey", "l_linenumber", f"{views.size_label('s')} as label")


@query("SELECT l_orderkey, l_linenumber, concat_ws(' ', CASE WHEN l > 100 THEN 'L' || l END, CASE WHEN dp > 5 THEN 'D' || dp END, CASE WHEN b > 10 THEN 'B' || b END) AS label FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) * 5 AS l, l_partkey % 11 AS dp, l_suppkey % 23 AS b FROM lineitem)")
def complexity_labels(spark, d):
    rows = read_table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(floor(l_quantity) as bigint) * 5 as l", "l_partkey % 11 as dp", "l_suppkey % 23 as b")
    return rows.selectExpr("l_orderkey", "l_linenumber", f"{views.complexity_label('l', 'dp', 'b')} as label")


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, string_agg('o' || o_orderkey, ', ' ORDER BY o_orderkey) || CASE WHEN max(n) > 5 THEN ', ... (' || max(n) || ' total)' ELSE '' END AS line FROM r WHERE k <= 5 GROUP BY o_custkey")
def compact_files(spark, d):
    return views.compact_line(read_table(spark, d, "orders").selectExpr("o_custkey", "o_orderkey", "concat('o', o_orderkey) as name"), "o_custkey", "name", "o_orderkey")
