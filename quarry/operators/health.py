"""What nothing refers to: routes and templates, definitions, names; and where to look next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import rules
from quarry.operators.paths import is_test
from quarry.operators.rules import listed, name_of, pattern
from quarry.scratch import portioned, staged

#: Letters of a token by which it is looked up before the exact test: as many of these as it has.  Short grams are few, so that
#: more and more texts share one as tables grow.
GRAMS = (1, 2, 3, 4, 8, 16)
#: Letters of a text that are looked through at once.
PIECE = 256
# How frameworks declare routes, on a decorator and by a call, and how texts refer to them.
DECORATED = (
    r"@\w+\.(?:get|post|put|delete|patch|route)\(\s*[\"'](/[^\"']*)[\"']",
    r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"']",
    r"@(?:Get|Post|Put|Delete|Patch|All)\(\s*[\"']([^\"']*)[\"']",
)
IMPERATIVE = r"\b(?:app|api|server|router|routes|\w*[Rr]outer)\.(?:get|post|put|delete|patch|all|head|options)\(\s*[\"'](/[^\"']*)[\"']"
FRAGMENT = r"/[\w\-]{3,}(?:/[\w\-{}.:]+)*"
BY_NAME = r"url_(?:path_)?for\(\s*[\"']([^\"']+)[\"']"
TEMPLATE = r"[\"']([\w\-/]+\.(?:html|j2|jinja))[\"']"
ROUTE_FILES = tuple("py ts tsx js jsx java kt go rb php".split())
REFERRING = tuple("html j2 jinja vue svelte py js jsx ts tsx mjs cjs java kt kts swift dart m mm go rs zig cs rb php json yaml yml xml".split())


def reference_files(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """files (path, content) in which producers or references are looked for: by extension, not too large, none of
    others' code."""
    return files.where(f"{rules.suffix_of(name_of('path'))} in ({listed(extensions)}) and octet_length(content) <= {rules.REFERENCE_BYTES} and not {rules.in_folders('path', rules.VENDORED)}")


def _declared(text: str) -> str:
    """SQL of the route that a line or decorator declares; null for none."""
    found = [f"if({text} rlike {pattern(p)}, regexp_extract({text}, {pattern(p)}, 1), null)" for p in (*DECORATED, IMPERATIVE)]
    return f"coalesce({', '.join(found)})"


def routes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pid, location, key, tag): routes on decorators of nodes (path, name, decorators), named by their handler, and those
    declared by a call in files (path, content), named by the route; one for each file and route, decorators first."""
    sources = reference_files(files, ROUTE_FILES).where(f"not {is_test('path', 'tail')}")
    on = nodes.join(sources.select("path"), "path", "left_semi").select("path", "name", F.explode("decorators").alias("d")).withColumn("key", F.expr(_declared("d"))).where("key is not null").selectExpr("name as pid", "path as location", "key", "0 as turn")
    called = sources.select("path", F.explode(F.regexp_extract_all("content", F.lit(IMPERATIVE), F.lit(1))).alias("key")).selectExpr("key as pid", "path as location", "key", "1 as turn")
    first = on.unionByName(called).groupBy("location", "key").agg(F.expr("min_by(pid, struct(turn, pid))").alias("pid"))
    return first.selectExpr("pid", "location", "key", "'route' as tag")


def route_references(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text) of all URL fragments outside of lines that declare a route, and (pid) of handlers named in URL helpers."""
    lines = reference_files(files, REFERRING).select(F.explode(F.split("content", "\r?\n")).alias("line")).where(F.expr(_declared("line")).isNull())
    fragments = lines.select(F.explode(F.regexp_extract_all("line", F.lit(FRAGMENT), F.lit(0))).alias("text")).distinct()
    return fragments, lines.select(F.explode(F.regexp_extract_all("line", F.lit(BY_NAME), F.lit(1))).alias("pid")).distinct()


def template_root(files: DataFrame) -> str | None:
    """The first folder called templates, by path."""
    found = files.where("path rlike '(?:^|/)templates/'").select(F.min(F.regexp_extract("path", "^((?:.*?/)??templates)/", 1)).alias("root")).first()
    return found["root"]


def templates(files: DataFrame) -> DataFrame:
    """(pid, location, key, tag) of the template files under the root of templates."""
    root = template_root(files)
    if root is None:
        return files.sparkSession.createDataFrame([], "pid string, location string, key string, tag string")
    below = files.where(F.col("path").startswith(root + "/") & F.col("path").rlike("[.](?:html|j2|jinja)$"))
    return below.selectExpr("path as location", f"substr(path, {len(root) + 2}) as key").selectExpr("key as pid", "location", "key", "'template' as tag")


def template_references(files: DataFrame) -> DataFrame:
    return reference_files(files, ("py", "html", "j2", "jinja")).select(F.explode(F.regexp_extract_all("content", F.lit(TEMPLATE), F.lit(1))).alias("text")).distinct()


def holding(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """(token) of those that some text contains."""
    return _meeting(tokens, texts).where("contains(text, token)").select("token").distinct()


def _meeting(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """(token, text) of pieces of texts that may contain the token; every token that a text contains meets one that does.

    A token meets texts by the rarest of its longest grams (``GRAMS``), as counted over the texts, so that a
    beginning that many tokens share brings nothing together; a gram that no text has settles its tokens at once.
    """
    size = "case " + " ".join(f"when length(token) >= {n} then {n}" for n in reversed(GRAMS)) + " end"
    tokens = tokens.select("token").where("token <> ''").distinct().withColumn("n", F.expr(size))
    about = tokens.agg(F.collect_set("n").alias("sizes"), F.max(F.length("token")).alias("longest")).first()  # seven numbers at most
    if not about["sizes"]:
        return tokens.selectExpr("token", "cast(null as string) as text")
    of_token = tokens.select("token", F.explode(F.expr("array_distinct(transform(sequence(1, length(token) - n + 1), i -> substr(token, i, n)))")).alias("gram"))
    # long texts go in pieces that overlap by a token, as each look into a text counts its letters from the start
    pieces = texts.select("text").distinct().select(F.explode(F.expr(f"transform(sequence(1, greatest(length(text), 1), {PIECE}), p -> substr(text, p, {PIECE} + {about['longest']} - 1))")).alias("text")).distinct()
    grams = pieces.select("text", F.explode(F.array(*map(F.lit, sorted(about["sizes"])))).alias("n")).where("length(text) >= n")
    # one row for each different gram of a piece that some token has
    grams = grams.select("text", F.explode(F.expr("array_distinct(transform(sequence(1, length(text) - n + 1), i -> substr(text, i, n)))")).alias("gram"))
    met = staged(grams.join(of_token.select("gram").distinct(), "gram", "left_semi"), "token-grams")
    counted = of_token.join(met.groupBy("gram").agg(F.count("*").alias("held")), "gram", "left").groupBy("token").agg(F.expr("min_by(struct(gram, coalesce(held, 0) as held), struct(coalesce(held, 0), gram))").alias("rarest"))
    wanted = counted.where("rarest.held > 0").selectExpr("token", "rarest.gram as gram")
    return wanted.join(met, "gram").select("token", "text")


def resolved(producers: DataFrame, texts: DataFrame, names: DataFrame | None = None, token: str = "token", external: str = "false") -> DataFrame:
    """producers (pid, ...) with ``verdict``: external, reached (a text contains the token, or the name is referred to),
    unresolvable (no token) or orphan."""
    rows = producers.selectExpr("*", f"{token} as __token", f"{external} as __external")
    found = holding(rows.selectExpr("__token as token"), texts).selectExpr("token as __token", "true as __held")
    rows = rows.join(found, "__token", "left")
    rows = rows.join(names.select("pid").distinct().withColumn("__named", F.lit(True)), "pid", "left") if names is not None else rows.withColumn("__named", F.lit(None).cast("boolean"))
    verdict = "case when __external then 'external' when __token is null then 'unresolvable' when coalesce(__held, false) or coalesce(__named, false) then 'reached' else 'orphan' end"
    return rows.selectExpr(*producers.columns, f"{verdict} as verdict")


def orphan_routes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    texts, names = route_references(files)
    return resolved(routes(files, nodes), texts, names, rules.distinctive("key"), rules.is_external("key"))


def orphan_templates(files: DataFrame) -> DataFrame:
    return resolved(templates(files), template_references(files), None, name_of("key"), f"{name_of('key')} in ('base.html', 'layout.html')")


def orphans(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Producers (pid, token) whose token no consumer's text (text) contains."""
    rows = producers.where("token is not null and token <> ''")
    return rows.join(holding(rows.select("token"), consumers), "token", "left_anti").select(*producers.columns)


def unreachable(definitions: DataFrame, called: DataFrame, roots: DataFrame) -> DataFrame:
    """Definitions (name, ...) that nothing calls and that are no roots."""
    return definitions.join(called.select("name").distinct(), "name", "left_anti").join(roots.select("name").distinct(), "name", "left_anti")


def dead(definitions: DataFrame, call_nodes: DataFrame, entry_points: DataFrame, word_counts: DataFrame, call_counts: DataFrame, reachable: DataFrame) -> DataFrame:
    """(file, qualified) of functions and methods without callers that nothing else explains.

    definitions: (file, language, type, name, parent, modifiers, decorators, enclosing_kind); call_nodes: (fqn, n_callers);
    entry_points: (name); word_counts and call_counts: (word, n) over the corpus; reachable: (file, qualified).
    Spared are entry points, tests, names that stand somewhere without being called, what the corpus shows to
    be reached by dispatch, decorated definitions, and what the language's own rule lets be reached.
    """
    qualified = "concat_ws('.', parent, name)"
    rows = definitions.count()
    own = definitions.where(f"type in ('function', 'method') and language in ({listed(rules.CLAIMS_DEAD)})").withColumn("qualified", F.expr(qualified)).withColumn("fqn", F.expr("concat(file, ':', qualified)"))
    alone = portioned(own, rows, "fqn").join(call_nodes.where("n_callers = 0").select("fqn"), "fqn", "left_semi").where(f"not {is_test('file', 'tail')} and coalesce(size(decorators), 0) <= 0")
    alone = alone.where(f"not {rules.reachable_off_graph('language', 'name', 'type', 'modifiers', 'enclosing_kind', 'parent')}")
    bare = word_counts.join(call_counts.withColumnRenamed("n", "calls"), "word", "left").where("n - coalesce(calls, 0) >= 1").select(F.col("word").alias("name"))
    roots = entry_points.select("name").unionByName(bare).distinct()
    return portioned(alone, rows, "name").join(roots, "name", "left_anti").join(reachable.select("file", "qualified"), ["file", "qualified"], "left_anti").select("file", "qualified")


def flaggable(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, name, start_line) of nodes that may be called unreferenced.

    Left out are containers, members of types that derive from others, short names, dunders, tests, names that more than one
    node has, and roots: universal ones, decorated or overriding nodes' names, and those in ``roots`` (name).
    """
    named = nodes.where("type not in ('file-info', 'imports', 'error', 'parse-error', 'section', 'paragraph', 'heading', 'code-block', 'comment') and type not like 'heading-%' and name <> '' and end_line >= start_line")
    parents = nodes.selectExpr("path", "node_id as parent_id", "signature as parent_signature")
    placed = named.join(parents, ["path", "parent_id"], "left").selectExpr("*", "count(*) over (partition by name) as times")
    rooted = named.where("size(decorators) > 0 or array_contains(modifiers, 'override')").select("name").unionByName(roots.select("name")).distinct()
    own = placed.where(f"last_desc_id = node_id and coalesce(parent_signature, '') = '' and length(name) >= 4 and times = 1 and name not in ({listed(rules.ROOTS)}) and not startswith(name, '__') and not startswith(lower(name), 'test')")
    return own.join(rooted, "name", "left_anti").select("path", "name", "start_line")


def leads(calls: DataFrame, definitions: DataFrame, hit_files: DataFrame, most: int = 2, top: int = 5) -> DataFrame:
    """Names that hit blocks call, defined once or twice and elsewhere, by the number of calls."""
    counted = calls.groupBy("name").agg(F.count("*").alias("calls"))
    few = definitions.selectExpr("*", "count(*) over (partition by name) as defs").where(f"defs <= {most}")
    return counted.join(few, "name").join(hit_files.select("file").distinct(), "file", "left_anti").select("name", "file", "calls").orderBy(F.desc("calls"), "name", "file").limit(top)
