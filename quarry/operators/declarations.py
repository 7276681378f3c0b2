"""What the segments of brace languages declare: nested nodes, definitions, calls with their callers.

A segment is classified by the first pattern of its language that its header matches; members count only right inside
a container.  A node's parent is the nearest segment around it that is a node, so joins on (path, segment) give
parents, pre-order numbers and the owner of each call; a segment that declares nothing is transparent, and what it
encloses belongs to the next node around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import brackets
from quarry.functions.pattern_tables import CALL_KEYWORDS
from quarry.operators.rules import listed, pattern
from quarry.scratch import dealt, portioned, staged

CONTAINERS = ("class", "interface", "struct", "record", "enum", "trait", "impl", "protocol", "extension", "actor", "union", "namespace")
#: Containers whose members need no body.
ABSTRACT = ("interface", "trait", "protocol")
CALLABLE = ("function", "method", "constructor", "initializer", "deinitializer", "test")

# Words that stand before a bracket and a block without declaring anything, and modifiers.
_CONTROL = "if|else|for|foreach|while|do|switch|match|catch|try|finally|guard|using|lock|fixed|return|synchronized|throw|new|sizeof|typeof|defer|go|select|when|repeat|super|this|base|await|yield|case|elseif|declare|loop|unsafe|comptime|errdefer|orelse|assert|print|func"
MODIFIERS = "public private protected internal static final abstract sealed partial virtual override async readonly synchronized default native export extern inline pub open fileprivate mutating indirect required convenience lazy weak const unsafe friend constexpr explicit declare".split()

# A row is (type, place, pattern): group 1 is the name, group 2 what follows it.  Places: any; body, a block follows; open, none does;
# member, right inside a container; free, not inside a container.
_ARGS = r"\((?:[^()]|\([^()]*\))*\)"
_TYPED = rf"[\w>\]?*&]\s+(?!(?:{_CONTROL})\b)"
_NOT = rf"(?!(?:{_CONTROL})\b)"
_GENERIC = r"(?:\s*<(?:[^<>()]|<[^<>()]*>)*>)?"


def _kinds(*names: str, before: str = r"(?<![.\w])", generic: str = _GENERIC) -> list[tuple[str, str, str]]:
    return [(n, "body", rf"{before}{n}\s+(\w+)({generic}.*)$") for n in names]


DECLARATIONS: dict[str, list[tuple[str, str, str]]] = {
    "java": [
        ("class", "body", r"(?<![.\w])(?:class|record)\s+(\w+)(.*)$"), ("interface", "body", r"(?<![.\w])@?interface\s+(\w+)(.*)$"), *_kinds("enum"),
        ("constructor", "member body", rf"(?:^|\s){_NOT}(\w+)\s*({_ARGS}(?:\s*throws\s[\w.,\s]+)?)$"), ("method", "member", rf"{_TYPED}(\w+)\s*({_ARGS}(?:\s*throws\s[\w.,\s]+)?)$"),
    ],
    "csharp": [
        ("namespace", "body", r"^namespace\s+([\w.]+)(.*)$"), ("record", "any", r"(?<![.\w])record\s+(?:class\s+|struct\s+)?(\w+)(.*)$"), *_kinds("class", "interface", "struct", "enum"),
        ("constructor", "member body", rf"(?:^|\s){_NOT}(\w+)\s*({_ARGS}(?:\s*:\s*(?:base|this)\s*{_ARGS})?)$"), ("method", "member", rf"{_TYPED}(\w+)({_GENERIC}\s*{_ARGS}(?:\s*where\s.*)?)(?:\s*=>.*)?$"),
        ("property", "member body", r"[\w>\]?]\s+(\w+)()$"),
    ],
    "go": [
        ("struct", "body", r"^type\s+(\w+)((?:\[[^\]]*\])?)\s+struct$"), ("interface", "body", r"^type\s+(\w+)((?:\[[^\]]*\])?)\s+interface$"),
        ("method", "body", rf"^func\s*\([^)]*\)\s*(\w+)\s*({_ARGS}.*)$"), ("function", "body", rf"^func\s+(\w+)\s*((?:\[[^\]]*\])?\s*{_ARGS}.*)$"),
    ],
    "rust": [
        ("struct", "any", r"(?:^|\s)struct\s+(\w+)(.*)$"), *_kinds("enum", "trait", "union"), ("impl", "body", r"(?:^|\s)impl\b(?:\s*<[^{]*?>)?\s+([^{]+?)()(?:\s+where\s.*)?$"), ("module", "body", r"(?:^|\s)mod\s+(\w+)()$"),
        ("function", "any", rf"(?:^|\s)fn\s+(\w+)\s*({_GENERIC}\s*\(.*)$"),
    ],
    "cpp": [
        ("namespace", "body", r"^(?:inline\s+)?namespace\s+([\w:]+)()$"), ("class", "body", r"(?:^|\s)class\s+(?:[A-Z_]+\s+)?(\w+)((?:\s+final)?(?:\s*:.*)?)$"), ("struct", "body", r"(?:^|\s)struct\s+(\w+)((?:\s*:.*)?)$"), ("enum", "body", r"(?:^|\s)enum\s+(?:class\s+|struct\s+)?(\w+)((?:\s*:.*)?)$"), ("union", "body", r"(?:^|\s)union\s+(\w+)()$"),
        ("constructor", "member body", rf"(?:^|\s){_NOT}(~?\w+)\s*({_ARGS})(?:\s*(?:noexcept|override|final))*(?:\s*:.*)?$"),
        ("function", "body", rf"{_TYPED}[*&]*((?:[\w]+::)*~?\w+)\s*({_ARGS}(?:\s*(?:const|noexcept|override|final))*(?:\s*->\s*[\w:<>*&\s]+)?)(?:\s*:.*)?$"),
    ],
    "php": [
        ("namespace", "body", r"^(?:<\?php\s+)?namespace\s+([\w\\]+)()$"), *_kinds("class", "interface", "trait", "enum"),
        ("method", "member", rf"(?:^|\s)function\s+&?(\w+)\s*({_ARGS}.*)$"), ("function", "free body", rf"(?:^|\s)function\s+&?(\w+)\s*({_ARGS}.*)$"),
    ],
    "swift": [
        *((n, "body", rf"(?:^|\s){n}\s+(?!func\b|var\b|let\b)([\w.]+){_GENERIC}\s*(.*)$") for n in ("class", "struct", "enum", "protocol", "extension", "actor")),
        ("method", "member", rf"(?:^|\s)func\s+(\w+)\s*({_GENERIC}\s*\(.*)$"), ("function", "free body", rf"(?:^|\s)func\s+(\w+)\s*({_GENERIC}\s*\(.*)$"),
        ("initializer", "member body", r"(?:^|\s)(init)[?!]?\s*(\(.*)$"), ("deinitializer", "member body", r"(?:^|\s)(deinit)()$"), ("subscript", "member body", r"(?:^|\s)(subscript)\s*(\(.*)$"),
    ],
    "typescript": [
        *_kinds("class", "interface", "enum"), ("function", "body", rf"(?:^|\s)function\s*\*?\s*(\w+)\s*({_GENERIC}\s*{_ARGS}.*)$"),
        ("function", "any", rf"(?:^|\s)(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?({_ARGS}|\w+)\s*(?::\s*[^=]+)?=>.*$"),
        ("method", "member", rf"(?:^|\s)(?:get\s+|set\s+|\*\s*)?{_NOT}([\w$#]+)\??\s*({_GENERIC}{_ARGS}(?:\s*:.*)?)$"),
    ],
    "zig": [(n, "body", rf"(?:^|\s)const\s+(\w+)()\s*=\s*(?:packed\s+|extern\s+)?{n}(?:\s*\(.*\))?$") for n in ("struct", "enum", "union")] + [("function", "any", r"(?:^|\s)fn\s+(\w+)\s*(\(.*)$"), ("test", "body", r"^test\s+\"([^\"]+)\"()$")],
}
_PLAIN = r"regexp_replace(trim({}), '\\s+', ' ')"


def classified(segments: DataFrame) -> DataFrame:
    """(path, language, item, up, ups, type, name, tail, ...) of segments that declare something."""
    rows = segments.where("kind in ('block', 'statement')").selectExpr("*", f"{_PLAIN.format('header')} as plain", f"{_PLAIN.format('raw')} as whole")
    found = None
    for language, rules in DECLARATIONS.items():  # one plan for each, as all patterns together are too long to be compiled
        tried = []
        for kind, place, expression in rules:
            text = "whole" if kind == "test" else "plain"
            fits = [f"{text} rlike {pattern(expression)}"] + ["kind = 'block'"] * ("body" in place.split())
            name, tail = (f"regexp_extract({text}, {pattern(expression)}, {k})" for k in (1, 2))
            tried.append(f"if({' and '.join(fits)}, struct('{kind}' as type, trim({name}) as name, trim({tail}) as tail, '{place.split()[0]}' as place), null)")
        part = rows.where(F.col("language") == language).withColumn("found", F.expr(f"filter(array({', '.join(tried)}), x -> x is not null)")).where("size(found) > 0")
        found = part if found is None else found.unionByName(part)
    found = staged(found, "declaring")
    rows = found.count()
    # what stands right around it decides which of the patterns hold
    outer = dealt(found).where("kind = 'block'").selectExpr("path", "item as up", "found[0].type as outer", "found[0].name as outer_name", "found[0].place as outer_place")
    inside = f"coalesce(outer in ({listed(CONTAINERS)}), false)"
    kinship = "(x.type <> 'constructor' or regexp_replace(x.name, '^~', '') = regexp_replace(outer_name, '<.*$', ''))"
    allowed = f"filter(found, x -> case x.place when 'member' then {inside} and outer <> 'namespace' and {kinship} when 'free' then not {inside} or outer = 'namespace' else true end)"
    placed = portioned(found, rows, "path", "up").join(outer, ["path", "up"], "left").selectExpr("*", f"get({allowed}, 0) as won").where("won is not null")
    bodied = f"kind = 'block' or outer in ({listed(ABSTRACT)}) or won.type in ('struct', 'record') or plain rlike '=>' or plain rlike '\\\\b(?:abstract|native|extern)\\\\b'"
    kept = placed.where(bodied).selectExpr("path", "language", "kind", "item", "up", "ups", f"if(won.type = 'function' and {inside} and outer <> 'namespace' and language <> 'rust' and language <> 'zig', 'method', won.type) as type", "won.name as name", "won.tail as tail", "plain", "raw", "comment", "start_line", "end_line")
    return kept


def _ancestors(rows: DataFrame, nodes: DataFrame, keys: list[str], number: int) -> DataFrame:
    """rows (path, ups, ...), some ``number``, for each of the nodes (path, item, ...) around them."""
    around = portioned(nodes, number, "path", "item").selectExpr("path", "item as around", *(f"{k} as around_{k}" for k in keys))
    return rows.withColumn("around", F.explode("ups")).join(around, ["path", "around"])


def _modifiers() -> str:
    return f"array_distinct(filter(split(split(regexp_replace(regexp_replace(plain, '@\\\\w+(?:\\\\([^)]*\\\\))?', ''), '[(=].*$', ''), concat('\\\\b', regexp_replace(name, '[^\\\\w].*$', ''), '\\\\b'))[0], '[^\\\\w]+'), w -> w in ({listed(MODIFIERS)})))"


def _signature() -> str:
    """The parameters with the result behind them; for types what they derive from."""
    before = "trim(regexp_extract(plain, concat('([\\\\w.]+(?:<.*>)?(?:\\\\[\\\\])*[?*&]*)\\\\s+[*&]*', regexp_replace(name, '[^\\\\w:].*$', ''), '\\\\s*[(<]'), 1))"
    return f"case when type in ('method', 'function') and language in ('java', 'csharp', 'cpp') then concat(tail, if({before} = '', '', concat(' : ', {before}))) when language = 'go' and type = 'method' then concat(regexp_extract(plain, '^func\\\\s*(\\\\([^)]*\\\\))', 1), ' ', tail) else tail end"


_DECORATORS = r"regexp_extract_all(raw, '(?:^|\\s)(@(?!interface)[\\w.]+(?:\\([^)]*\\))?|#\\[[^\\]]*\\]|\\[[A-Z][\\w]*(?:\\([^)]*\\))?\\])', 1)"
_DOC = r"nullif(trim(regexp_extract(regexp_replace(if(language in ('cpp', 'csharp'), regexp_replace(comment, '(?m)^[ \t]*#.*$', ''), regexp_replace(comment, '^<[?](?:php|=)?', '')), '(?m)^[\\s/*!#]+', ''), '^\\s*([^\\n]*?)\\s*(?:[*]/)?\\s*(?:\\n|$)', 1)), '')"


def nodes(segments: DataFrame) -> DataFrame:
    """Nodes in pre-order with their segment ``item``; of C++ members the last access label before them is a modifier."""
    found = staged(classified(segments), "declared")
    rows = found.count()
    found = portioned(found, rows, "path", "item")
    labels = segments.where("kind = 'label'").selectExpr("path", "up", "item", "regexp_extract(header, '(\\\\w+)', 1) as label", "false as real").unionByName(found.where("language = 'cpp'").selectExpr("path", "up", "item", "cast(null as string) as label", "true as real"))
    access = labels.selectExpr("*", "last(label, true) over (partition by path, up order by item) as access").where("real and access is not null").select("path", "item", "access")
    outer = found.selectExpr("path", "item as up", "type as outer")
    shown = found.join(dealt(access), ["path", "item"], "left").join(outer, ["path", "up"], "left")
    # members of a C++ class are private where no label stands before them
    given = "case when language = 'cpp' and outer in ('class', 'struct') then array(coalesce(access, if(outer = 'class', 'private', 'public'))) else array() end"
    shown = shown.withColumn("modifiers", F.expr(f"array_union({_modifiers()}, {given})")).withColumn("signature", F.expr(_signature())).withColumn("decorators", F.expr(_DECORATORS)).withColumn("docstring", F.expr(_DOC))
    numbered = staged(portioned(shown, rows, "path").selectExpr("*", "cast(row_number() over (partition by path order by item) - 1 as int) as node_id"), "declared-nodes")
    pairs = staged(_ancestors(numbered.select("path", "item", "ups", "node_id"), numbered, ["node_id"], rows), "declared-pairs")
    rows = max(rows, pairs.count())
    above = portioned(pairs, rows, "path", "node_id").groupBy("path", "node_id").agg(F.max("around_node_id").alias("parent_id"), F.count("*").cast("int").alias("depth"))
    below = portioned(pairs.selectExpr("path", "around_node_id as node_id", "node_id as within"), rows, "path", "node_id").groupBy("path", "node_id").agg(F.max("within").alias("last"))
    out = numbered.join(dealt(above), ["path", "node_id"], "left").join(dealt(below), ["path", "node_id"], "left")
    return out.selectExpr("path", "language", "item", "ups", "node_id", "coalesce(parent_id, -1) as parent_id", "coalesce(last, node_id) as last_desc_id", "coalesce(depth, 0) as depth", "type", "name", "start_line", "end_line", "signature", "decorators", "modifiers", "docstring", "end_line - start_line + 1 as lines")


def definitions(declared: DataFrame) -> DataFrame:
    """(file, language, item, type, name, line, signature, parent, enclosing_kind, modifiers, decorators) of what can be called and of
    types; the parent is the nearest container but a namespace."""
    outer = declared.where(f"type in ({listed(CONTAINERS)}) and type <> 'namespace'").select("path", "item", "name", "type")
    rows = declared.count()
    near = portioned(_ancestors(declared.select("path", "item", "ups"), outer, ["name", "type"], rows), rows, "path", "item").groupBy("path", "item").agg(F.expr("max_by(struct(around_name as parent, around_type as kind), around)").alias("near"))
    wanted = declared.where(f"type in ({listed((*CONTAINERS, *CALLABLE))}) and type not in ('namespace', 'test')")
    return wanted.join(dealt(near), ["path", "item"], "left").selectExpr("path as file", "language", "item", "type", "name", "start_line as line", "signature", "near.parent as parent", "near.kind as enclosing_kind", "modifiers", "decorators")


def calls(segments: DataFrame, declared: DataFrame) -> DataFrame:
    """(caller_file, caller_name, callee_name, line, is_cross_file) of calls inside of definitions.

    Only what was found to be a definition owns a call; what stands between is transparent, and calls outside of all
    are left out.  The name in a definition's own header is no call.
    """
    words = " ".join(f"when '{k}' then array({listed(CALL_KEYWORDS[k].split())})" for k in DECLARATIONS)
    sites = segments.where(f"kind = 'call' and not array_contains(case language {words} end, header)").selectExpr("path", "ups", "head", "header as callee", "start_line as line", "monotonically_increasing_id() as site")
    sites = staged(sites, "call-sites")
    rows = sites.count()
    own = declared.selectExpr("path", "item as head", "regexp_extract(name, '(\\\\w+)$', 1) as callee", "true as named")
    real = portioned(sites, rows, "path", "head", "callee").join(dealt(own.distinct()), ["path", "head", "callee"], "left").where("named is null")
    callers = declared.where(f"type in ({listed(CALLABLE)})").select("path", "item", "name")
    inside = portioned(_ancestors(real, callers, ["name"], rows), rows, "site").groupBy("site").agg(F.expr("max_by(struct(path, around_name as caller, callee, line), around)").alias("c")).select("c.*")
    here = declared.where(f"type in ({listed((*CONTAINERS, *CALLABLE))})").selectExpr("path", "name as callee", "true as here").distinct()
    return portioned(inside, rows, "path", "callee").join(dealt(here), ["path", "callee"], "left").selectExpr("path as caller_file", "caller as caller_name", "callee as callee_name", "line", "here is null as is_cross_file")


def broken(segments: DataFrame) -> DataFrame:
    """(path, language, ratio, fallback) of every file: brackets without a partner among the first ``SAMPLE``."""
    return segments.where("kind = 'file'").selectExpr("path", "language", "if(brackets > 0, errors / brackets, 0D) as ratio", f"brackets > 0 and errors / brackets > {brackets.BROKEN} as fallback")
