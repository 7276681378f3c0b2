"""Text views as tables of lines: each is a projection or a bounded aggregate, sorted only when shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_label(size: str) -> str:
    """SQL of a size for people: bytes up to terabytes, one decimal from ten on, ties to even."""
    whens = []
    for i, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        value = f"cast({size} as decimal(30, 0)) / cast({1024**i} as decimal(15, 0))" if i else f"cast({size} as decimal(30, 0))"
        exact = f"cast({value} as decimal(38, 16))"
        small = f"when {size} < {1024 ** (i + 1)} then " if i < 4 else "else "
        label = f"concat(if({exact} >= 10 or {i} = 4, cast(cast(bround({exact}, 1) as decimal(20, 1)) as string), cast(cast(bround({exact}, 0) as bigint) as string)), '{unit}')"
        whens.append(small + label)
    return f"case {' '.join(whens)} end"


def complexity_label(lines: str, depth: str, branches: str) -> str:
    """SQL of the measures that are over their bounds."""
    return f"concat_ws(' ', if({lines} > 100, concat('L', {lines}), null), if({depth} > 5, concat('D', {depth}), null), if({branches} > 10, concat('B', {branches}), null))"


def compact_line(nodes: DataFrame, group: str, name: str, order: str, first: int = 5) -> DataFrame:
    """(group, line): the first names of each group and how many there are in all; a group of any size
    brings no more than ``first`` names together."""
    ranked = nodes.selectExpr(group, name, order, f"row_number() over (partition by {group} order by {order}) as rank", f"count(*) over (partition by {group}) as total").where(f"rank <= {first}")
    line = f"concat(array_join(transform(array_sort(collect_list(struct(rank, {name}))), x -> x.{name}), ', '), if(max(total) > {first}, concat(', ... (', max(total), ' total)'), ''))"
    return ranked.groupBy(group).agg(F.expr(line).alias("line"))


def age_label(days: str) -> str:
    """SQL of an age in days for people."""
    d = f"cast({days} as double)"
    return (
        f"case when {d} < 1 then if(cast({d} * 24 as int) > 0, concat(cast({d} * 24 as int), 'h ago'), 'just now') when {d} < 7 then concat(cast({d} as int), 'd ago') when {d} < 30 then concat(cast({d} / 7 as int), 'w ago') "
        f"when {d} < 365 then concat(cast({d} / 30 as int), 'mo ago') else concat(format_string('%.1f', {d} / 365), 'y ago') end"
    )


def since_label(seconds: str) -> str:
    """SQL of a time span for people, in words."""
    parts = []
    for limit, unit, size in ((3600, "min", 60), (86400, "hour", 3600), (604800, "day", 86400), (2592000, "week", 604800), (31536000, "month", 2592000), (None, "year", 31536000)):
        n = f"cast({seconds} div {size} as int)"
        label = f"concat({n}, if({n} = 1, ' {unit} ago', ' {unit}s ago'))"
        parts.append(f"when {seconds} < {limit} then {label}" if limit else f"else {label}")
    return f"case when {seconds} < 60 then 'just now' {' '.join(parts)} end"


def count_label(n: str) -> str:
    """SQL of a count for people: thousands with one decimal, halves up."""
    return f"if({n} >= 1000, concat(({n} + 50) div 1000, '.', ({n} + 50) div 100 % 10, 'k'), cast({n} as string))"


def stats_label(files: str, classes: str, functions: str, methods: str) -> str:
    """SQL of "(2 files, 1 class, ...)", without what there is none of."""
    words = ((files, "file", "files"), (classes, "class", "classes"), (functions, "function", "functions"), (methods, "method", "methods"))
    parts = ", ".join(f"if({n} > 0, concat({n}, if({n} = 1, ' {one}', ' {many}')), null)" for n, one, many in words)
    return f"coalesce(concat('(', nullif(concat_ws(', ', {parts}), ''), ')'), '')"


#: How entry points are called, by language and type; a null place has none.
ENTRY_LABELS = {
    ("python", "main_function"): "main() @{line}", ("python", "if_main"): "if __name__ @{line}", ("python", "app_instance"): "{framework} {name} @{line}", ("python", "export"): "{name}", ("typescript", "app_instance"): "{framework} {name} @{line}",
    ("go", "main_function"): "func main() @{line}", ("go", "init_function"): "func init() @{line}", ("rust", "main_function"): "fn main() @{line}", ("rust", "async_main"): "async fn main() @{line}", ("rust", "bin_target"): "binary target @{line}",
    ("java", "main_function"): "public static void main @{line}", ("java", "annotation"): "@{name} @{line}", ("config", "docker_service"): "docker {name} @{line}",
}


def entry_label(language: str, kind: str, name: str, line: str, framework: str) -> str:
    """SQL of an entry point as shown after its file."""
    fields = {"{line}": line, "{name}": name, "{framework}": f"coalesce({framework}, '')"}
    whens = []
    for (lang, k), form in ENTRY_LABELS.items():
        for place, value in fields.items():
            form = form.replace(place, f"', {value}, '")
        whens.append(f"when {language} = '{lang}' and {kind} = '{k}' then concat('{form}')")
    return f"case {' '.join(whens)} else concat(coalesce(nullif({name}, ''), {kind}), if(coalesce({line}, 0) > 0, concat(' @', {line}), '')) end"


def tree_lines(nodes: DataFrame) -> DataFrame:
    """(path, node_id, part, line) of nodes (path, node_id, depth, name, signature, start_line, ...), indented.

    Modifiers, edits, status, the complexity label and the first line of the doc follow on the node's own line where the table has them;
    decorators come on lines of their own, and then the lines of a skeleton.
    """
    has = set(nodes.columns)
    extra = {
        "modifiers": "coalesce(concat(' [', nullif(array_join(modifiers, ' '), ''), ']'), '')", "edits": "if(coalesce(edits, 0) > 0, concat(' [', edits, ' edits/90d]'), '')", "status": "coalesce(concat(' [', nullif(status, 'unchanged'), ']'), '')",
        "max_depth": f"coalesce(concat(' ', nullif({complexity_label('lines', 'max_depth', 'branches')}, '')), '')", "docstring": "coalesce(concat(' # ', nullif(docstring, '')), '')", "doc": "coalesce(concat(' # ', nullif(doc, '')), '')",
    }
    indent = "repeat('  ', cast(depth as int))"
    own = f"concat({indent}, '- ', name, coalesce(concat(' ', nullif(signature, '')), ''), ' @', start_line{''.join(', ' + e for c, e in extra.items() if c in has)})"
    below = "cast(array() as array<string>)"
    if "decorators" in has:
        below = f"concat({below}, transform(coalesce(decorators, array()), d -> concat({indent}, '   ', d)))"
    if "skeleton" in has:
        below = f"concat({below}, transform(coalesce(skeleton, array()), s -> concat({indent}, '   ', s)))"
    return nodes.selectExpr("path", "node_id", f"posexplode(concat(array({own}), {below})) as (part, line)")


def nested_lines(nodes: DataFrame) -> DataFrame:
    """(path, node_id, line) as a directory view shows the nodes of its files, with their kind."""
    return nodes.selectExpr("path", "node_id", "concat(repeat('  ', cast(depth as int) + 1), type, ': ', name, coalesce(concat(' ', nullif(signature, '')), ''), ' (', start_line, '-', end_line, ')') as line")


def glimpses(nodes: DataFrame, most: int = 100) -> DataFrame:
    """(path, line): of the most salient node of each file (name, skeleton, saliency) its outer lines in one, the declaration left out."""
    best = nodes.where("skeleton is not null and saliency is not null").groupBy("path").agg(F.expr("max_by(struct(name, skeleton), struct(saliency, -node_id)) as b")).select("path", "b.*")
    width = "length(regexp_extract({0}, '^[ \\\\t]*', 0))"
    levels = best.selectExpr("*", f"slice(array_sort(array_distinct(transform(skeleton, s -> {width.format('s')}))), 1, 2) as outer")
    kept = levels.selectExpr("path", "name", f"filter(skeleton, s -> array_contains(outer, {width.format('s')}) and trim(s) <> '…') as kept")
    body = kept.selectExpr("path", "name", "if(size(kept) > 0 and contains(kept[0], trim(split(name, '[(]')[0])), slice(kept, 2, size(kept)), kept) as body").where("size(body) > 0")
    line = "concat('> ', name, ': ', array_join(transform(body, s -> trim(s)), ' ; '))"
    return body.selectExpr("path", f"{line} as line").selectExpr("path", f"if(length(line) > {most}, concat(left(line, {most - 1}), '…'), line) as line")


def focus_lines(matches: DataFrame, top: int = 10) -> DataFrame:
    """(focus, path, line): the header of a focus that one node (path, node_id, qualified, start_line, end_line) answers, a list of the first where
    several do."""
    counted = matches.selectExpr("*", "count(*) over (partition by focus, path) as n", "row_number() over (partition by focus, path order by node_id) as rank")
    one = counted.where("n = 1").selectExpr("focus", "path", "0 as rank", "concat('focus: ', qualified, ' @', start_line, '-', end_line) as line")
    several = counted.where(f"n > 1 and rank <= {top}").selectExpr("focus", "path", f"inline(if(rank = 1, array(struct(0 as rank, concat('focus ', focus, ' is ambiguous (', n, ' matches): use a qualified path') as line), struct(rank, concat('  ', qualified, ' @', start_line) as line)), array(struct(rank, concat('  ', qualified, ' @', start_line) as line))))")
    return one.unionByName(several).select("focus", "path", "rank", "line")


def as_json(nodes: DataFrame) -> DataFrame:
    """(path, node_id, json): a node without its empty fields."""
    fields = [c for c in nodes.columns if c not in ("path", "node_id")]
    kinds = dict(nodes.dtypes)
    full = ", ".join(f"if({c} = '', null, {c}) as {c}" if kinds[c] == "string" else f"if(size({c}) = 0, null, {c}) as {c}" if kinds[c].startswith("array") else c for c in fields)
    return nodes.selectExpr("path", "node_id", f"to_json(struct({full})) as json")


def unmatched(path: str, asked: str, nodes: DataFrame) -> DataFrame:
    """(line) for a focus that nothing answers: the names at the top of a file."""
    names = nodes.where(F.col("path") == path).where("parent_id = -1").agg(F.expr("array_join(transform(array_sort(collect_list(struct(node_id, name))), x -> x.name), ', ') as names"))
    return names.select(F.concat(F.lit(f"focus '{asked}' matches no node. Top-level nodes: "), "names").alias("line"))


def hit_text(text: str) -> str:
    """SQL of a hit's line as shown."""
    return f"left(trim({text}), 120)"
