"""The questions a user asks of a source tree, put together from the library's operators.

``Facts`` turns files (path, content, language, size, mtime) into tables, each parsed once, when it is first asked
for, and staged; the functions below it answer one question each, as a table of lines or of rows.
"""

from __future__ import annotations

from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import brackets, config_files, pattern_tables, python_source, scoring, sql_text
from quarry.operators import budget, changes, condense, consensus, declarations, entries, graphs, health, imports, markup, nodes, paths, ranking, report, rules, text, views
from quarry.operators.rules import listed
from quarry.scratch import spread, staged
from quarry.sources import history, tree
from quarry.streaming.memory import ScanMemory

#: Names of unchanged files that a directory scan lists.
NAMES = 40
NODE = "path string, node_id int, parent_id int, last_desc_id int, depth int, type string, name string, start_line int, end_line int, signature string, decorators array<string>, modifiers array<string>, docstring string, lines int, max_depth int, branches int, tier string"


def _shaped(rows: DataFrame, tier: str) -> DataFrame:
    """Rows with the columns of NODE, null where they have none."""
    have = set(rows.columns)
    fields = [f.split(" ", 1) for f in NODE.split(", ")]
    values = {"tier": f"'{tier}'", "decorators": "cast(array() as array<string>)", "modifiers": "cast(array() as array<string>)"}
    return rows.selectExpr(*(f"cast({n if n in have else values.get(n, 'null')} as {t}) as {n}" for n, t in fields))


def parsed(files: DataFrame, languages: Collection[str] | None = None, declared: DataFrame | None = None, broken: DataFrame | None = None) -> DataFrame:
    """Nodes of all files: Python by its syntax tree, brace languages by their brackets (``declared``), HTML by its elements, Markdown and text
    by their lines, other languages by patterns; a Python file with an error and a file whose brackets don't match (``broken``) by patterns too,
    the former's names marked.  languages: those that the files have, if known."""
    has = lambda *names: languages is None or any(n in languages for n in names)
    parts = []
    flat = files.where("language not in ('python', 'markdown', 'text', 'html', 'sql')")
    if has("python"):
        python = staged(python_source.nodes(files.where("language = 'python'")), "python-nodes")
        failed = python.where("type = 'parse-error'").select("path")
        parts.append(_shaped(python.join(failed, "path", "left_anti"), "syntax"))
        flat = flat.unionByName(files.where("language = 'python'").join(failed, "path", "left_semi"))
    if declared is not None:
        parts.append(_shaped(declared.join(broken.where("fallback").select("path"), "path", "left_anti"), "tokens"))
        held = flat.where(f"language in ({listed(brackets.LANGUAGES)})").join(broken.where("fallback").select("path"), "path", "left_semi")
        flat = flat.where(f"language not in ({listed(brackets.LANGUAGES)})").unionByName(held)
    if languages is None or any(x in pattern_tables.STRUCTURES and x != "markdown" for x in languages):
        found = pattern_tables.structures(flat, languages)
        one = found.selectExpr("path", "type", "if(language = 'python', concat(name, ' (fallback)'), name) as name", "line_no as start_line", "line_no as end_line", "row_number() over (partition by path order by line_no, type, name) - 1 as node_id").selectExpr("*", "-1 as parent_id", "node_id as last_desc_id", "0 as depth")
        parts.append(_shaped(one, "pattern"))
    if has("sql"):
        made = sql_text.structures(files.where("language = 'sql'"))
        parts.append(_shaped(made.selectExpr("path", "type", "name", "start_line", "end_line", "array_join(columns, ', ') as signature", "row_number() over (partition by path order by start_line, name) - 1 as node_id").selectExpr("*", "-1 as parent_id", "node_id as last_desc_id", "0 as depth"), "statements"))
    if has("html"):
        parts.append(_shaped(markup.elements(files.where("language = 'html'")), "markup"))
    if has("markdown"):
        marked = nodes.headings(text.lines(files.where("language = 'markdown'"))).withColumn("depth", F.expr("if(type = 'code-block', if(parent_id < 0, 0, 1), cast(right(type, 1) as int) - 1)"))
        parts.append(_shaped(marked, "lines"))
    if has("text"):
        plain = nodes.outline(text.lines(files.where("language = 'text'"))).selectExpr("*", "row_number() over (partition by path order by start_line, end_line desc) - 1 as node_id", "if(section_line is null, 0, 1) as depth")
        heads = plain.where("type = 'section'").selectExpr("path", "start_line as section_line", "node_id as parent_id")
        below = plain.join(heads, ["path", "section_line"], "left").withColumn("parent_id", F.expr("if(type = 'section', -1, coalesce(parent_id, -1))"))
        ends = below.groupBy("path", F.col("parent_id").alias("node_id")).agg(F.max("node_id").alias("last_desc_id"))
        parts.append(_shaped(below.join(ends, ["path", "node_id"], "left").withColumn("last_desc_id", F.coalesce("last_desc_id", "node_id")), "lines"))
    out = parts[0] if parts else _shaped(files.where("false").selectExpr("path"), "lines")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _each(pool: ThreadPoolExecutor, work, items: list) -> list:
    """The work on all items, in the context of the caller, so that what it stages belongs to the caller's scope."""
    return [f.result() for f in [pool.submit(copy_context().run, work, x) for x in items]]


class Facts:
    def __init__(self, files: DataFrame):
        self.spark, self.every = files.sparkSession, staged(files, "facts-files")
        self.files = self.every.where("content is not null")

    @cached_property
    def languages(self) -> set[str]:
        """Those that the files have: two dozen at most."""
        return {r["language"] for r in self.files.where("language is not null").select("language").distinct().collect()}

    def prepare(self) -> Facts:
        """Work all tables out, those that don't need one another side by side: small trees are all waiting."""
        self.languages  # noqa: B018 (asked for by all)
        steps = [["definitions", "calls", "entry_points", "imports", "clusters"], ["edges", "call_nodes", "bags"], ["file_nodes", "rules"]]
        with ThreadPoolExecutor(5) as pool:
            for names in steps:  # a step needs no more than the steps before it
                _each(pool, lambda n: getattr(self, n), names)
        return self

    @cached_property
    def bags(self) -> DataFrame:
        return staged(consensus.usage(self.definitions.select("file", "name"), self.calls), "consensus-bags")

    @cached_property
    def rules(self) -> DataFrame:
        return staged(consensus.candidates(self.bags), "consensus-rules")

    @cached_property
    def braced(self) -> bool:
        return bool(self.languages & set(brackets.LANGUAGES))

    @cached_property
    def bracketed(self) -> DataFrame:
        return staged(brackets.parsed(self.files), "facts-segments")

    @cached_property
    def broken(self) -> DataFrame:
        return staged(declarations.broken(self.bracketed), "facts-broken")

    @cached_property
    def segments(self) -> DataFrame:
        """What the brackets of brace languages enclose; files whose brackets don't match are left to the patterns."""
        return self.bracketed.join(self.broken.where("fallback").select("path"), "path", "left_anti")

    @cached_property
    def declared(self) -> DataFrame:
        return staged(declarations.nodes(self.segments), "facts-declared")

    @cached_property
    def nodes(self) -> DataFrame:
        return staged(parsed(self.files, self.languages, *((self.declared, self.broken) if self.braced else ())), "facts-nodes")

    @cached_property
    def definitions(self) -> DataFrame:
        rows = nodes.definitions(self.nodes.where("tier <> 'tokens'")).join(self.files.select(F.col("path").alias("file"), "language"), "file")
        if self.braced:
            rows = rows.unionByName(declarations.definitions(self.declared).select(rows.columns))
        return staged(rows.withColumn("fqn", F.expr("concat(file, ':', concat_ws('.', parent, name))")), "facts-definitions")

    @cached_property
    def calls(self) -> DataFrame:
        own = python_source.calls(self.files.where("language = 'python'"))
        if self.languages <= {"python"}:
            return staged(own, "facts-calls")
        left = self.files.where("language <> 'python'")
        if self.braced:
            own = own.unionByName(declarations.calls(self.segments, self.declared).select(own.columns))
            left = left.where(f"language not in ({listed(brackets.LANGUAGES)})").unionByName(left.join(self.broken.where("fallback").select("path"), "path", "left_semi").select(left.columns))
        return staged(own.unionByName(pattern_tables.calls(left).select(own.columns)), "facts-calls")

    @cached_property
    def entry_points(self) -> DataFrame:
        found = pattern_tables.entry_points(self.files, self.languages).selectExpr("path", "language", "type", "name", "line_no as line", "cast(null as string) as framework")
        if self.languages & set(entries.MARKS):
            found = found.unionByName(entries.marked(self.files))
        if "config" not in self.languages:
            return staged(found, "facts-entry-points")
        config = config_files.entry_points(self.files.where("language = 'config'")).selectExpr("path", "'config' as language", "type", "name", "line", "framework")
        return staged(found.unionByName(config), "facts-entry-points")

    @cached_property
    def imports(self) -> DataFrame:
        found = pattern_tables.imports(self.files, self.languages).selectExpr("path", "language", "name")
        if self.languages & {"go", "php", "rust"}:
            found = found.unionByName(imports.grouped(self.files).select("path", "language", "name"))
        if "swift" in self.languages:
            found = found.unionByName(imports.type_references(self.files))
        if "config" not in self.languages:
            return staged(found, "facts-imports")
        config = config_files.imports(self.files.where("language = 'config'")).selectExpr("path", "'config' as language", "name")
        return staged(found.unionByName(config), "facts-imports")

    @cached_property
    def edges(self) -> DataFrame:
        return staged(imports.edges(self.imports, self.files, self.definitions), "facts-edges")

    @cached_property
    def file_nodes(self) -> DataFrame:
        """Every file with its centrality, those without links at nothing."""
        linked = graphs.file_centrality(self.edges)
        rows = self.files.select("path", "language", "size", "mtime").join(linked, "path", "left").na.fill(0, ["n_imports", "n_importers", "centrality"])
        return staged(rows, "facts-file-nodes")

    @cached_property
    def call_nodes(self) -> DataFrame:
        qualified = self.definitions.withColumn("qualified", F.expr("concat_ws('.', parent, name)"))
        named = qualified.selectExpr("fqn", "explode(array_distinct(array(qualified, name))) as name", "parent")
        return staged(graphs.call_nodes(named, staged(graphs.call_edges(named, self.calls), "facts-call-edges")), "facts-call-nodes")

    @cached_property
    def clusters(self) -> DataFrame:
        return staged(self.files.selectExpr("path", f"{rules.cluster('language', 'path', 'content', self.languages)} as cluster"), "facts-clusters")

    def findings(self, top: int = consensus.TOP, suspects: DataFrame | None = None) -> DataFrame:
        bags, every = self.bags, self.rules
        if suspects is None:
            held = consensus.audit(every)
            sites = consensus.same_role(consensus.missing_sites(held, bags), held, bags, self.clusters)
        else:
            held = every.where(F.col("enrichment") >= consensus.SIGNIFICANT)
            sites = consensus.review(consensus.missing_sites(held, bags), suspects)
        return consensus.findings(sites, held, bags, top)

    def dead(self) -> DataFrame:
        """Of the languages that claim it and whose definitions are parsed; patterns don't tell what stands inside what."""
        own = self.definitions.join(self.nodes.where("tier in ('syntax', 'tokens')").select(F.col("path").alias("file")).distinct(), "file", "left_semi").where("name not like '% (fallback)'")
        files = spread(self.files, "path")  # a split of compressed texts holds too many words
        words, called = text.word_counts(files), text.word_counts(files, r"\b([A-Za-z0-9_]+)\s*\(", 1)
        known = self.spark.createDataFrame([(p, m) for p, ms in nodes.PROTOCOLS.items() for m in ms.split()], "protocol string, member string")
        asked = nodes.witnesses(self.definitions.where("language = 'swift'"), known)
        return health.dead(own, self.call_nodes, self.entry_points.select("name"), words, called, asked)

    def orphans(self) -> DataFrame:
        both = health.orphan_routes(self.files, self.nodes).unionByName(health.orphan_templates(self.files))
        return both.where("verdict = 'orphan'").drop("verdict")


def _content(facts: Facts) -> DataFrame:
    return facts.nodes.join(facts.files.select("path", "content"), "path")


def _span_lines(spans: DataFrame) -> DataFrame:
    """(path "file#node", line_no, text) of nodes with their file's content."""
    rows = spans.selectExpr("concat(path, '#', node_id) as path", "start_line", "posexplode(slice(split(content, '\\n'), start_line, greatest(0, end_line - start_line + 1))) as (at, text)")
    return rows.selectExpr("path", "cast(start_line + at as bigint) as line_no", "rtrim(text) as text")


def _gathered(lines: DataFrame, name: str) -> DataFrame:
    return lines.groupBy("path").agg(F.expr(f"transform(array_sort(collect_list(struct(line_no, text))), x -> x.text) as {name}"))


def salient(facts: Facts, mode: str = "balanced", edits: DataFrame | None = None, tokens: int | None = None) -> DataFrame:
    """(path, node_id, saliency, rank, level, skeleton): candidate nodes by saliency, shown as far as the budget goes."""
    chosen = nodes.candidates(facts.nodes)
    spans = facts.files.select("path", "content").join(chosen.groupBy("path").agg(F.expr("collect_list(struct(node_id, name, start_line, end_line))").alias("spans")), "path")
    scores = staged(scoring.node_scores(spans), "node-scores")
    commits = changes.span_edits(chosen.select("path", "node_id", "start_line", "end_line"), edits) if edits is not None else chosen.select("path", "node_id", F.lit(0).alias("edits"))
    scored = ranking.saliency(scores.join(commits.withColumnRenamed("edits", "churn"), ["path", "node_id"]), "path", mode)
    ranked = scored.selectExpr("path", "node_id", "saliency", "churn as edits", "cast(row_number() over (partition by path order by round(saliency, 9) desc, node_id) as int) as rank")
    sources = chosen.join(facts.files.select("path", "content", "language"), "path")
    whole = condense.skeleton(_span_lines(sources.where("tier <> 'syntax'")))
    if "python" in facts.languages:  # by the syntax tree, without the header, which the node's own line shows
        own = sources.where("tier = 'syntax'").selectExpr("concat(path, '#', node_id) as path", "array_join(slice(split(content, '\\n'), start_line, end_line - start_line + 1), '\\n') as content")
        whole = whole.unionByName(python_source.bodies(own).selectExpr("path", "cast(line_no as bigint) as line_no", "text"))
    whole = staged(whole, "node-skeletons")
    full, two, one = _gathered(whole, "full"), _gathered(condense.depth_limit(whole, 2), "two"), _gathered(condense.depth_limit(whole, 1), "one")
    shown = full.join(two, "path").join(one, "path").selectExpr("substring_index(path, '#', -1) as id", "substring_index(path, '#', 1) as path", "full", "two", "one").selectExpr("path", "cast(id as int) as node_id", "full", "two", "one")
    priced = ranked.join(shown, ["path", "node_id"]).selectExpr("*", f"{budget.tokens('full')} as cost_full", f"{budget.tokens('two')} as cost_2", f"{budget.tokens('one')} as cost_1")
    levels = budget.degraded(staged(priced, "node-costs"), str(tokens if tokens is not None else 1 << 60))
    picked = "case level when 'full' then full when '2' then two when '1' then one end"
    return levels.selectExpr("path", "node_id", "saliency", "edits", "rank", "level", f"if(exists({picked}, x -> trim(x) <> '…'), {picked}, null) as skeleton")


def scan(facts: Facts, mode: str = "balanced", tokens: int | None = None, edits: DataFrame | None = None, status: DataFrame | None = None) -> DataFrame:
    """(path, node_id, part, line): the tree of every file with the skeletons of its salient nodes; nodes whose status (path, node_id, status) is
    unchanged keep their header alone."""
    best = salient(facts, mode, edits, tokens)
    varied = best.selectExpr("*", "if(max(edits) over (partition by path) > min(edits) over (partition by path), edits, 0) as shown").drop("edits").withColumnRenamed("shown", "edits")
    rows = facts.nodes.join(varied.select("path", "node_id", "edits", "saliency", "skeleton"), ["path", "node_id"], "left")
    if status is not None:
        rows = rows.join(status, ["path", "node_id"], "left").withColumn("skeleton", F.expr("if(status = 'unchanged', null, skeleton)"))
    return views.tree_lines(rows)


#: What a depth stands for, in tokens.
DEPTHS = {"quick": 300, "normal": 1500, "deep": None}
AGE = "if({0} < 60, concat(cast({0} as int), ' sec'), concat(cast({0} / 60 as int), ' min'))"


def _files_of(facts: Facts) -> DataFrame:
    return facts.files.selectExpr("path", "concat(mtime, ':', size, ':', xxhash64(content)) as fingerprint")


def remembered(facts: Facts, memory: ScanMemory, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, age) of files as they were shown before, (path, node_id, status) of the nodes of changed ones, and (path, line) on what has changed;
    what is shown now is recorded."""
    every = staged(_files_of(facts), "memory-files")
    same = staged(memory.unchanged(every, now), "memory-same")
    fresh = staged(every.join(same, "path", "left_anti"), "memory-fresh")
    chains = staged(_chains(facts).join(fresh.select("path"), "path", "left_semi"), "memory-chains")
    keys = staged(changes.node_keys(chains), "memory-keys")
    diff = staged(memory.changes(keys, now), "memory-diff")
    named = chains.selectExpr("path", "node_id", "concat('/', array_join(transform(chain, c -> concat(c.type, ':', c.name)), '/')) as node_key")
    status = named.join(diff, ["path", "node_key"]).select("path", "node_id", "status")
    notes = changes.diff_summary(diff).selectExpr("path", "concat('(delta since last scan: ', changed, ' changed/new, ', unchanged, ' unchanged; code detail only for changed', if(removed = '', '', concat('; removed: ', removed)), '; delta=False for everything)') as line")
    memory.record(fresh, keys, now)
    return same, staged(status, "memory-status"), staged(notes, "memory-notes")


def scan_content(spark: SparkSession, content: str, filename: str, **settings) -> DataFrame:
    return scan(Facts(tree.content(spark, content, filename)), **settings)


def scan_file(spark: SparkSession, root: str, path: str, focus: str | None = None, depth: str | None = None, tokens: int | None = None, memory: ScanMemory | None = None, now: float = 0.0, whole: DataFrame | None = None, **settings) -> DataFrame:
    """(path, node_id, part, line): the tree of one file; with a focus its header, and what stands beside and on the way to the node.

    depth stands for a number of tokens where none is given.  With a memory, a file as it was shown before is one line, and of a changed one
    unchanged nodes have no code; a focus asks for content and leaves the memory alone.  whole: the files of the corpus, if the loose ends of this
    file are to be told behind its tree.
    """
    facts = Facts(tree.one_file(spark, root, path))
    if focus is not None:
        return focused(facts, focus)
    settings["tokens"] = tokens if tokens is not None else DEPTHS.get(depth)
    edits = history.line_edits(root, facts.files.select("path"))
    if memory is None:
        return _with_tail(scan(facts, edits=edits, **settings), facts, whole)
    same, status, notes = remembered(facts, memory, now)
    known = same.selectExpr("path", "-1 as node_id", "0 as part", f"concat(path, ': unchanged since last scan (', {AGE.format('age')}, ' ago); structure is identical to the previous response (delta=False for full output)') as line")
    if not known.isEmpty():
        return known
    return _with_tail(notes.selectExpr("path", "-1 as node_id", "0 as part", "line").unionByName(scan(facts, edits=edits, status=status, **settings)), facts, whole)


def _with_tail(lines: DataFrame, facts: Facts, whole: DataFrame | None) -> DataFrame:
    """lines, and behind them what the corpus leaves loose in these files."""
    if whole is None:
        return lines
    corpus = Facts(whole)
    drift = corpus.findings().select("site", "anchor", "missing")
    tail = report.tail_lines(staged(corpus.orphans(), "orphans"), staged(corpus.dead(), "dead"), staged(drift, "drift"), facts.files.select("path"))
    return lines.unionByName(tail.selectExpr("'(tail)' as path", f"{1 << 30} as node_id", "turn as part", "line"))


def focused(facts: Facts, focus: str) -> DataFrame:
    """(path, node_id, part, line): the header of the focus on node -1, then the nodes around it; candidates where several answer."""
    named = staged(with_chain(facts.nodes).where("type <> 'file-info'"), "node-chains")
    found = condense.focus(named.selectExpr("path", "node_id", "name", "slice(transform(chain, c -> c.name), 1, size(chain) - 1) as ancestors"), [focus])
    placed = staged(found.join(named.selectExpr("path", "node_id", "start_line", "end_line", "array_join(transform(chain, c -> c.name), '.') as qualified"), ["path", "node_id"]), "focus")
    heads = views.focus_lines(placed).selectExpr("path", "-1 as node_id", "rank as part", "line")
    single = placed.selectExpr("*", "count(*) over (partition by path) as n").where("n = 1")
    body = views.tree_lines(nodes.pruned(facts.nodes, single).where("role <> 'target'"))
    target = single.select("path", "node_id", "start_line", "end_line").join(facts.files.select("path", "content"), "path")
    lines = target.selectExpr("path", "node_id", "posexplode(slice(split(content, '\\n'), start_line, end_line - start_line + 1)) as (at, text)", "start_line").selectExpr("path", "node_id", "at as part", "concat('  ', start_line + at, ' | ', text) as line")
    return heads.unionByName(body).unionByName(lines)


def scan_directory(spark: SparkSession, root: str, glob: str = "**/*", exclude: str = "", max_files: int | None = None, depth: str | None = None, memory: ScanMemory | None = None, now: float = 0.0, commits: DataFrame | None = None) -> DataFrame:
    """(section, path, part, line) of the files that a directory scan takes: notes first, then each file's nodes in a line with its churn and a
    glimpse, the files that are as they were shown before in one line, and the health of them all.  There is no depth: asking for one gives a note."""
    facts = Facts(tree.scanned(tree.files(spark, root), glob, exclude, max_files))
    shown = directory_view(facts)
    if commits is not None:
        of = changes.churn(changes.active_window(commits)).selectExpr("path", "concat(' ', churn, 'x/90d') as label")
        shown = shown.join(of, "path", "left").withColumn("line", F.expr("if(part = 0, concat(line, coalesce(label, '')), line)")).drop("label")
    notes = [(0, "", 0, "Note: scan_directory has no depth setting, so 'depth' was ignored; narrow it by pattern, or ask scan_file or preview for depth")] if depth is not None else []
    out = spark.createDataFrame(notes, "section int, path string, part int, line string")
    if memory is not None:
        same, _, _ = remembered(facts, memory, now)
        shown = shown.join(same.select("path"), "path", "left_anti")
        # the first names, as a corpus may have any number
        first = same.selectExpr(f"{rules.name_of('path')} as name").orderBy("name").limit(NAMES).agg(F.expr("array_join(array_sort(collect_list(name)), ', ')").alias("names"))
        told = same.agg(F.count("*").alias("n")).crossJoin(first).where("n > 0")  # one row each
        out = out.unionByName(told.selectExpr("2 as section", "'' as path", "0 as part", f"concat('unchanged since last scan (', n, ' files): ', names, if(n > {NAMES}, concat(', +', n - {NAMES}), ''), ' (delta=False for everything)') as line"))
    health_ = health_of(facts).selectExpr("3 as section", "'' as path", "turn as part", "line")
    return out.unionByName(shown.selectExpr("1 as section", "path", "part", "line")).unionByName(health_)


def directory_view(facts: Facts) -> DataFrame:
    """(path, line): for each file its first nodes in one line, and a glimpse of the most salient one."""
    own = facts.nodes.where("parent_id = -1 and type not in ('imports', 'file-info')")
    first = views.compact_line(own, "path", "name", "node_id").selectExpr("path", "0 as part", "line")
    best = salient(facts).join(facts.nodes.select("path", "node_id", "name"), ["path", "node_id"])
    return first.unionByName(views.glimpses(best).selectExpr("path", "1 as part", "line"))


def health_of(facts: Facts) -> DataFrame:
    """(turn, line) on definitions that nothing mentions and equal blocks."""
    named = health.flaggable(facts.nodes.where("tier in ('syntax', 'tokens', 'statements', 'pattern') and name not like '% (fallback)'"), facts.entry_points.select("name").where("name is not null"))
    alone = text.unreferenced(named.selectExpr("path", "name", "start_line"), text.word_counts(facts.files))
    blocks = _content(facts).where("type in ('function', 'method', 'class')").selectExpr("path", "start_line", "array_join(slice(split(content, '\\n'), start_line, end_line - start_line + 1), '\\n') as body")
    return report.health_lines(alone, text.duplicate_blocks(blocks))


def preview(files: DataFrame, depth: str = "deep", commits: DataFrame | None = None, facts: Facts | None = None) -> DataFrame:
    """(section, turn, line): folders alone for quick, files and their links for normal, calls and patterns too for deep."""
    facts = facts or (Facts(files) if depth != "quick" else None)
    if facts:
        facts.prepare()
    files = facts.every if facts else files
    code = "language is not null and language not in ('generic', 'image', 'text')"
    tops = files.selectExpr("if(path like '%/%', split_part(path, '/', 1), '(root)') as name", "size", f"cast({code} as int) as code").groupBy("name").agg(F.count("*").alias("n_files"), F.sum("code").alias("n_code"), F.sum("size").alias("size"))
    parts = [("FOLDERS", report.preview_lines(tops, paths.extensions(files)))]
    if depth == "quick":
        return report.architecture_lines(parts)
    newest = facts.files.agg(F.max("mtime").alias("newest"))  # one row
    ages = facts.files.crossJoin(F.broadcast(newest)).selectExpr("path", "coalesce((newest - mtime) / 86400, 0) as age", "size")
    kinds = ranking.first_by_archetype(ranking.archetypes(ages.join(facts.file_nodes.select("path", F.col("n_importers").alias("importers")), "path")).join(ages, "path").join(facts.file_nodes.select("path", F.col("n_importers").alias("importers")), "path"))
    parts.append(("FILE ARCHETYPES", report.numbered(kinds, "archetype, rank", f"concat(archetype, ': ', path, '  ', {views.age_label('age')}, '  ', {views.size_label('size')})")))
    entries = ranking.last_by(facts.entry_points, ["path", "name"], "line").orderBy("path", "line", "name").limit(20)
    parts.append(("ENTRY POINTS", report.numbered(entries, "path, line, name", f"concat(path, ':', {views.entry_label('language', 'type', 'name', 'line', 'framework')})")))
    parts.append(("CORE FILES (by centrality)", report.numbered(report.core_files(facts.file_nodes), "centrality desc, path", "concat(path, ': imports ', n_imports, ', used by ', n_importers, ' files')")))
    parts.append(("ARCHITECTURE", report.numbered(report.clusters(facts.clusters), "cluster", "concat(cluster, ': ', n_files, ' files: ', first_files)")))
    parts.append(("KEY DEPENDENCIES", report.numbered(report.key_dependencies(facts.file_nodes, facts.edges), "path", "concat(path, ' imports ', imported, if(hidden > 0, concat(', +', hidden), ''))")))
    hot = staged(graphs.hot(facts.call_nodes), "hot")
    if depth == "deep":
        parts.append(("HOT FUNCTIONS (most called)", report.numbered(hot, "round(centrality, 6) desc, fqn", "concat(split_part(fqn, ':', 2), ': called by ', n_callers, ', calls ', n_callees, ' @', split_part(fqn, ':', 1))")))
        parts.append(("PEER DIVERGENCE", consensus.divergence_lines(facts.findings(5))))
    parts.append(("FILE INVENTORY", report.numbered(report.inventory(facts.file_nodes, graphs.important_files(facts.file_nodes, hot)), "folder", "concat(folder, ' ', names, if(hidden > 0, concat(', +', hidden), ''))")))
    if depth == "deep" and commits is not None:
        recent = changes.active_window(commits)
        parts.append(("ACTIVITY", report.activity_lines(changes.churn(recent), changes.co_change(recent))))
    parts.append(("NEXT STEPS", report.recommended(ages, facts.file_nodes, hot)))
    with ThreadPoolExecutor(6) as pool:  # each part is a few lines, and most of its time is waiting
        made = _each(pool, lambda p: (p[0], staged(p[1].coalesce(1), "report-part")), parts)
    return report.architecture_lines(made)


def with_chain(nodes_: DataFrame) -> DataFrame:
    """nodes with ``chain``: type and name of each ancestor, then of the node itself."""
    chains = nodes_.sparkSession.sql(
        """
        SELECT n.path, n.node_id, transform(array_sort(collect_list(struct(a.node_id, a.type, a.name))), x -> struct(x.type AS type, x.name AS name)) AS chain
        FROM {n} n JOIN {n} a ON n.path = a.path AND a.node_id <= n.node_id AND n.node_id <= a.last_desc_id GROUP BY n.path, n.node_id""",
        n=nodes_,
    )
    return nodes_.join(chains, ["path", "node_id"])


def _chains(facts: Facts) -> DataFrame:
    """(path, node_id, chain, lines) of the named nodes."""
    rows = with_chain(facts.nodes.where("name <> ''")).join(facts.files.select("path", "content"), "path")
    return rows.selectExpr("path", "node_id", "chain", "slice(split(content, '\\n'), start_line, end_line - start_line + 1) as lines")


def _keys(facts: Facts) -> DataFrame:
    return changes.node_keys(_chains(facts))


def node_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, node_key, status) of two versions of files (path, content, language, ...)."""
    return changes.node_diff(_keys(Facts(old)), _keys(Facts(new)))


def scan_diff(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """(path, turn, line): what has changed against a revision by nodes, and the loose ends that the change leaves."""
    moved = history.changed(spark, root, ref)
    every = tree.files(spark, root)
    here = every.join(moved.where("status <> 'D'").select("path"), "path", "left_semi")
    back = history.old_files(root, moved.where("status in ('M', 'R', 'D')").selectExpr("coalesce(old_path, path) as path"), ref)
    renamed = moved.selectExpr("coalesce(old_path, path) as was", "path")
    before = back.withColumnRenamed("path", "was").join(renamed, "was").selectExpr("path", "cast(length(content) as bigint) as size", "cast(null as double) as mtime", "false as is_binary", "content", f"{pattern_tables.language_of()} as language")
    new = Facts(here)
    diff = node_changes(before, here).join(moved.select("path", F.col("status").alias("how")), "path")
    summary = changes.diff_summary(diff.select("path", "node_key", "status")).join(moved, "path")
    head = summary.selectExpr("path", "0 as turn", "case status when 'D' then concat(path, ' [deleted]') when '?' then concat(path, ' [new file]') when 'A' then concat(path, ' [new file]') else concat(path, ' [changed', if(status = 'R', concat(' from ', old_path), ''), ': ', changed, ' new/changed, ', unchanged, ' unchanged]', if(removed = '', '', concat('  removed: ', removed))) end as line")
    body = diff.where("status in ('new', 'changed') and how <> 'D'").selectExpr("path", "cast(1 + row_number() over (partition by path order by node_key) as int) as turn", "concat('  ', status, ' ', substr(node_key, 2)) as line")
    facts = Facts(every)
    suspects = new.definitions.selectExpr("concat(file, ':', name) as site")
    review = report.tail_lines(staged(facts.orphans(), "orphans"), staged(facts.dead(), "dead"), staged(facts.findings(suspects=suspects), "drift"), staged(moved.select("path"), "changed"))
    return head.unionByName(body).unionByName(review.selectExpr("'(review)' as path", "turn", "line"))


def find_divergence(files: DataFrame, top: int = consensus.TOP) -> DataFrame:
    return consensus.divergence_lines(Facts(files).findings(top))


def search_structures(facts: Facts, content_pattern: str | None = None, **filters) -> DataFrame:
    """Nodes that pass the filters; with a content pattern the ranked hits in them, whose types need only contain the type asked for."""
    if content_pattern is None:
        return nodes.filtered(facts.nodes, **filters).select("path", "node_id", "type", "name", "start_line", "end_line")
    anchors = facts.nodes.where("type not in ('imports', 'file-info', 'error', 'parse-error')").selectExpr("path", "node_id", "cast(start_line as bigint) as start_line", "cast(end_line as bigint) as end_line")
    hits = text.search(text.lines(text.with_hits(facts.files, content_pattern)), anchors, content_pattern, is_test=paths.is_test("path", "search"))
    named = hits.join(facts.nodes.select("path", "node_id", "type", "name"), ["path", "node_id"], "left")
    if filters.get("type_filter"):
        named = named.where(F.col("type").contains(filters["type_filter"]))
    return named.where(F.col("name").rlike(filters["name_pattern"])) if filters.get("name_pattern") else named
