"""Structure nodes as a flat table: (path, node_id in pre-order, parent_id or -1, last_desc_id, depth, type,
name, start_line, end_line, ...).  A node's descendants are the ids after its own up to last_desc_id, so
tests on ancestors are comparisons and need no recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.rules import listed
from quarry.scratch import dealt

#: Types that are never candidates for display.
SKIP_TYPES = ("file-info", "imports", "error", "parse-error", "section", "paragraph", "heading", *(f"heading-{n}" for n in range(1, 7)), "code-block", "comment")
#: Methods that protocols outside the corpus ask for.
PROTOCOLS = {
    "Codable": "encode init", "Encodable": "encode", "Decodable": "init", "Equatable": "==", "Comparable": "< <= > >=", "Hashable": "hash", "Sequence": "makeIterator", "IteratorProtocol": "next",
    "RawRepresentable": "init", "ExpressibleByStringLiteral": "init",
}
CONTAINERS = ("class", "struct", "enum", "protocol", "actor", "extension")
MEMBERS = ("method", "function", "initializer", "deinitializer")


def filtered(nodes: DataFrame, type_filter: str | None = None, name_pattern: str | None = None, has_decorator: str | None = None, min_complexity: int | None = None) -> DataFrame:
    """Nodes that pass all filters given; nodes without a measured length pass the one on complexity."""
    kept = F.lit(True)
    if type_filter:
        kept &= F.col("type") == type_filter
    if name_pattern:
        kept &= F.col("name").rlike(name_pattern)
    if has_decorator:
        kept &= F.expr(f"coalesce(exists(decorators, d -> contains(d, {listed([has_decorator])})), false)")
    if min_complexity:
        kept &= F.expr(f"lines is null or lines >= {int(min_complexity)}")
    return nodes.where(kept)


def candidates(nodes: DataFrame) -> DataFrame:
    """Nodes of more than one line with a name and a type that counts, and none of these below them."""
    eligible = nodes.where(f"type not in ({listed(SKIP_TYPES)}) and name <> '' and end_line > start_line")
    return eligible.selectExpr("*", "lead(node_id) over (partition by path order by node_id) as next").where("next is null or next > last_desc_id").drop("next")


def definitions(nodes: DataFrame) -> DataFrame:
    """(file, type, name, line, signature, parent, enclosing_kind, modifiers, decorators) of classes, functions and methods; parent is the nearest class."""
    return nodes.sparkSession.sql(
        """
        SELECT n.path AS file, n.type, n.name, n.start_line AS line, n.signature, c.name AS parent, c.type AS enclosing_kind, n.modifiers, n.decorators FROM {n} n LEFT JOIN (
          SELECT m.path, m.node_id, max_by(struct(a.name, a.type), a.node_id) AS nearest FROM {n} m JOIN {n} a
            ON m.path = a.path AND a.type = 'class' AND a.node_id < m.node_id AND m.node_id <= a.last_desc_id GROUP BY m.path, m.node_id) x
          ON n.path = x.path AND n.node_id = x.node_id LATERAL VIEW OUTER inline(array(x.nearest)) c AS name, type
        WHERE n.type IN ('class', 'function', 'method')""",
        n=nodes,
    )


def pruned(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """For targets (path, node_id): the nodes at the top and those beside the way to the target, with ``role`` target, way or beside."""
    t = targets.select("path", F.col("node_id").alias("target"))
    near = nodes.join(t, "path").withColumn("role", F.expr("case when node_id = target then 'target' when node_id < target and target <= last_desc_id then 'way' else 'beside' end"))
    way = near.where("role = 'way'").select("path", "target", F.col("node_id").alias("parent_id"))
    return near.join(way.unionByName(t.withColumn("parent_id", F.lit(-1))), ["path", "target", "parent_id"], "left_semi").select("target", *nodes.columns, "role")


def structure_counts(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, files, classes, functions, methods) by folder, of files (path) and their nodes."""
    counts = nodes.groupBy("path").agg(*(F.expr(f"count_if(type = '{t}')").alias(a) for t, a in (("class", "classes"), ("function", "functions"), ("method", "methods"))))
    folder = "if(path like '%/%', regexp_replace(path, '/[^/]*$', ''), '')"
    return files.select("path").join(counts, "path", "left").groupBy(F.expr(folder).alias("dir")).agg(F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("classes", "functions", "methods")))


def line_spans(nodes: DataFrame) -> DataFrame:
    """(path, first_line, last_line) over the nodes that stand on lines."""
    return nodes.where("start_line > 0 or end_line > 0").groupBy("path").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


def in_degrees(bags: DataFrame) -> DataFrame:
    """(cid, in_degree) of bags (cid "file:name", callee): how many bags hold a callee of its bare name."""
    named = bags.select("cid").distinct().withColumn("name", F.expr("regexp_extract(cid, '([^:]*)$', 1)"))
    counts = bags.groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("n"))
    return named.join(counts, "name", "left").select("cid", F.expr("coalesce(n, 0L)").alias("in_degree"))


def with_churn(files: DataFrame, churn: DataFrame) -> DataFrame:
    """files with churn (null, and so no label, where nothing has changed)."""
    return files.join(churn.select("path", "churn"), "path", "left")


def witnesses(definitions_: DataFrame, known_protocols: DataFrame) -> DataFrame:
    """(file, qualified) of methods that a protocol may call.

    definitions_: (file, type, name, parent, signature); known_protocols: (protocol, member) of protocols outside
    the corpus.  A type's conformances stand in its signature.  A conformance that nobody knows protects
    all of its methods, a known one those that it asks for.
    """
    names = "transform(split(split(regexp_replace(substr(trim(signature), 2), '<[^>]*>', ''), ' where ')[0], ','), x -> trim(x))"
    types = definitions_.where(f"type in ({listed(CONTAINERS)})")
    claims = types.where("trim(signature) like ':%'").select(F.col("name").alias("parent"), F.explode(F.expr(f"filter({names}, x -> x <> '')")).alias("protocol")).distinct()
    methods = definitions_.where(f"parent is not null and type in ({listed(MEMBERS)})").select("file", "name", "parent")
    asked = methods.select(F.col("parent").alias("protocol"), F.col("name").alias("member")).unionByName(known_protocols.select("protocol", "member")).distinct()
    known = types.select(F.col("name").alias("protocol")).unionByName(known_protocols.select("protocol")).distinct().withColumn("known", F.lit(True))
    claimed = dealt(methods).join(dealt(claims), "parent").join(dealt(known), "protocol", "left")
    placed = claimed.join(dealt(asked.withColumn("asks", F.lit(True)).withColumnRenamed("member", "name")), ["protocol", "name"], "left")
    return placed.where("known is null or asks").selectExpr("file", "concat(parent, '.', name) as qualified").distinct()


def nested(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(path, node_id, parent): for each inner span (path, node_id, start_line, end_line) the smallest outer one that
    holds it, told by the latest start, then the earliest end."""
    return inner.sparkSession.sql(
        """
        SELECT i.path, i.node_id, min_by(o.node_id, struct(-o.start_line, o.end_line, o.node_id)) AS parent
        FROM {i} i LEFT JOIN {o} o ON i.path = o.path AND o.start_line <= i.start_line AND i.end_line <= o.end_line
        GROUP BY i.path, i.node_id""",
        i=inner, o=outer,
    )


def members(definitions_: DataFrame, call_nodes: DataFrame, classes: int = 4, functions: int = 5) -> DataFrame:
    """(file, type, name, signature, centrality, rank, of_type): the first classes and functions of each file by the centrality of
    "file:name", ties in order of their line; methods have no such name."""
    scored = definitions_.where("type in ('class', 'function')").withColumn("fqn", F.expr("concat(file, ':', name)")).join(call_nodes.select("fqn", "centrality"), "fqn", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    ranked = scored.selectExpr("*", "row_number() over (partition by file, type order by centrality desc, line, name) as rank", "count(*) over (partition by file, type) as of_type")
    return ranked.where(f"rank <= if(type = 'class', {classes}, {functions})").select("file", "type", "name", "signature", "centrality", "rank", "of_type")


def outline(lines: DataFrame) -> DataFrame:
    """Sections and paragraphs of plain text: (path, type, name, start_line, end_line, section_line).

    lines: (path, line_no, text).  A header is a line in capitals of more than three letters, or a line above one
    of ``=`` or ``-`` alone.  A paragraph ends at a blank line; one that a header cuts off is dropped, and so is
    one that runs to the end of the file below a header.
    """
    upper = "({0} = upper({0}) and {0} <> lower({0}))"
    trimmed = lines.selectExpr("path", "line_no", "trim(regexp_replace(text, '\\s', ' ')) as s")
    seen = trimmed.selectExpr("*", "coalesce(lag(s) over (partition by path order by line_no), '') as before")
    kinds = seen.selectExpr(
        "path", "line_no", "s", "before",
        f"case when s = '' then 'blank' when length(s) > 3 and {upper.format('s')} then 'caps' when s rlike '^[=-]{{3,}}$' and line_no > 1 then if(before <> '' and not {upper.format('before')}, 'underline', 'none') else 'text' end as kind",
    )
    marks = kinds.selectExpr("*", "case kind when 'caps' then line_no when 'underline' then line_no - 1 end as head", "left(if(kind = 'caps', s, before), 50) as title")
    heads = marks.where("head is not null").selectExpr("path", "head", "title", "lead(if(kind = 'caps', line_no - 1, line_no - 2)) over (partition by path order by line_no) as until")
    last = lines.groupBy("path").agg(F.max("line_no").alias("last"))
    sections = heads.join(last, "path").selectExpr("path", "'section' as type", "title as name", "head as start_line", "coalesce(until, last) as end_line", "cast(null as bigint) as section_line")
    islands = marks.selectExpr("*", "sum(if(kind in ('blank', 'caps', 'underline'), 1, 0)) over (partition by path order by line_no rows between unbounded preceding and 1 preceding) as island", "max(head) over (partition by path order by line_no rows unbounded preceding) as section_line")
    ends = islands.groupBy("path", F.expr("coalesce(island, 0)").alias("island")).agg(F.expr("min(if(kind = 'text', line_no, null))").alias("start_line"), F.max("line_no").alias("end_no"), F.expr("max_by(kind, line_no)").alias("by"), F.expr("min_by(section_line, line_no)").alias("section_line"))
    closed = ends.join(last, "path").where("start_line is not null and (by = 'blank' or end_no = last and by in ('text', 'none') and section_line is null)")
    paragraphs = closed.selectExpr("path", "'paragraph' as type", "start_line", "if(by = 'blank', end_no - 1, end_no) as end_line", "section_line")
    paragraphs = paragraphs.selectExpr("path", "type", "concat('paragraph (', start_line, '-', end_line, ')') as name", "start_line", "end_line", "section_line")
    return sections.unionByName(paragraphs)


def headings(lines: DataFrame) -> DataFrame:
    """The heading tree of Markdown: (path, node_id, parent_id, last_desc_id, type, name, start_line, end_line).

    lines: (path, line_no, text).  Headings are marked by ``#`` or underlined; fenced code blocks are leaves, and nothing
    inside them counts.  A heading's parent is the nearest one before it of a lower level.  A heading
    ends with its last descendant, and one without any just before the next node, or with the file.
    """
    fenced = lines.selectExpr("path", "line_no", "text", "text rlike '^ {0,3}```' as fence").selectExpr("*", "sum(cast(fence as int)) over (partition by path order by line_no) as fences")
    seen = fenced.selectExpr("*", "fences % 2 = 1 and not fence as inside", "lag(trim(text)) over (partition by path order by line_no) as before", "lag(fence or fences % 2 = 1) over (partition by path order by line_no) as fenced_before")
    closing = seen.where("fence").selectExpr("path", "line_no", "text", "fences", "lead(line_no) over (partition by path order by line_no) as close")
    last = lines.groupBy("path").agg(F.max("line_no").alias("last"))
    blocks = closing.where("fences % 2 = 1").join(last, "path").selectExpr("path", "line_no as start_line", "coalesce(close, last) as end_line", "0 as level", "concat('code block', coalesce(concat(' (', nullif(regexp_extract(text, '```(\\\\w+)', 1), ''), ')'), '')) as name")
    plain = seen.where("not inside and not fence")
    marked = plain.where("text rlike '^#{1,6}\\\\s+\\\\S'").selectExpr("path", "line_no as start_line", "line_no as end_line", "length(regexp_extract(text, '^(#+)', 1)) as level", "trim(regexp_replace(regexp_extract(text, '^#+\\\\s+(.*)$', 1), '\\\\s+#+\\\\s*$', '')) as name")
    under = plain.where("trim(text) rlike '^(?:={3,}|-{3,})$' and coalesce(before, '') <> '' and not coalesce(fenced_before, false) and not before rlike '^(?:#|[-*+>|] ?|[0-9]+[.] |={3,}$|-{3,}$)'").selectExpr("path", "line_no - 1 as start_line", "line_no as end_line", "if(contains(text, '='), 1, 2) as level", "before as name")
    rows = blocks.unionByName(marked).unionByName(under).selectExpr("*", "row_number() over (partition by path order by start_line) - 1 as node_id")
    # the last heading before a row of each level, and the next one
    before = "rows between unbounded preceding and 1 preceding"
    after = "rows between 1 following and unbounded following"
    for k in range(1, 7):
        rows = rows.withColumn(f"p{k}", F.expr(f"max(if(level = {k}, node_id, null)) over (partition by path order by node_id {before})"))
        rows = rows.withColumn(f"n{k}", F.expr(f"min(if(level between 1 and {k}, node_id, null)) over (partition by path order by node_id {after})"))
    parent = "greatest(-1, " + ", ".join(f"if(level = 0 or level > {k}, p{k}, null)" for k in range(1, 7)) + ")"
    follow = "case level " + " ".join(f"when {k} then n{k}" for k in range(1, 7)) + " end"
    sized = rows.selectExpr("*", f"{parent} as parent_id", f"if(level = 0, node_id, coalesce({follow}, 1 + max(node_id) over (partition by path)) - 1) as last_desc_id", "lead(start_line) over (partition by path order by node_id) as next_start")
    leaf = sized.join(last, "path").selectExpr("path", "node_id as last_desc_id", "case when level = 0 then end_line else coalesce(next_start - 1, last) end as leaf_end")
    return sized.join(leaf, ["path", "last_desc_id"]).selectExpr("path", "cast(node_id as int) as node_id", "cast(parent_id as int) as parent_id", "cast(last_desc_id as int) as last_desc_id", "if(level = 0, 'code-block', concat('heading-', level)) as type", "name", "start_line", "leaf_end as end_line")
