"""Files that imports stand for, by language; all in SQL expressions and equi joins.

Most languages give candidate paths in order of preference, of which the first that is a file counts.
Some look a target up instead: Go a package's folder by the end of its path, C# a file by the last part
of a namespace, Swift the file that defines a type.  Modules that can't be files of the corpus (those of
the language itself, URLs, wildcards) have no candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.rules import listed, pattern
from quarry.scratch import dealt, spread

_SCRIPTS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]
# Packages that are never files of the corpus.
_GO = "fmt os io net http time sync context strings bytes encoding crypto runtime reflect database log testing path regexp sort".split()
_CPP = "iostream string vector map set algorithm cstdio cstdlib cstring cmath memory utility stdio.h stdlib.h string.h math.h".split()
_PHP = "Illuminate Symfony Doctrine Monolog PHPUnit Carbon GuzzleHttp Psr".split()


def normal(path: str) -> str:
    """SQL of a path without ``.`` and ``..`` steps."""
    return f"array_join(aggregate(split({path}, '/'), cast(array() as array<string>), (a, x) -> case when x in ('', '.') then a when x = '..' then slice(a, 1, greatest(size(a) - 1, 0)) else concat(a, array(x)) end), '/')"


def _all(bases: list[str], ends: list[str]) -> list[str]:
    return [f"concat({b}, '{e}')" for b in bases for e in ends]


def _unless(test: str, exprs: list[str]) -> list[str]:
    return [f"if({test}, null, {e})" for e in exprs]


def _rules() -> dict[str, list[str]]:
    near, dotted = "concat(dir, '/', name)", "replace(name, '.', '/')"
    up = "concat(dir, repeat('/..', length(regexp_extract(name, '^[.]*', 0)) - 1), '/', replace(ltrim('.', name), '.', '/'))"
    absolute = [f"concat({dotted}, '.py')", "concat(replace(regexp_replace(name, '^[^.]*[.]?', ''), '.', '/'), '.py')", f"concat({dotted}, '/__init__.py')", f"concat('src/', {dotted}, '.py')", f"concat('src/', {dotted}, '/__init__.py')"]
    script = f"case when name like '.%' then {near} when name like '%/%' then name end"
    crate = "replace(regexp_replace(name, '^crate::', ''), '::', '/')"
    jvm = "concat(replace(name, '.', '/'), '.java')"
    slashed = r"replace(name, '\\', '/')"
    web = "name rlike '^(?:https?:|//|data:|mailto:|#)'"
    named = "regexp_replace(name, '#.*$', '')"
    partial = "if(name like '%/%', regexp_replace(name, '/([^/]*)$', '/_$1'), concat('_', name))"
    sass = [f"if({b} rlike '[.]s[ac]ss$', {b}, concat({b}, '{e}'))" for b in ("name", partial) for e in (".scss", ".sass", "")]
    return {
        "python": _unless("name like '.%'", absolute) + [f"if(name like '.%', concat({up}, '{e}'), null)" for e in (".py", "/__init__.py")],
        "typescript": _all([script], [*_SCRIPTS, *(f"/index{e}" for e in _SCRIPTS), ""]),
        "rust": [f"if(name like 'crate::%', {e}, null)" for e in (f"if({crate} like '%/%', concat('src/', regexp_replace({crate}, '/[^/]*$', ''), '.rs'), concat('src/', {crate}, '.rs'))", f"concat('src/', {crate}, '/mod.rs')")],
        "java": _unless("name like '%.*' or name rlike '^(?:javax?|sun|com[.]sun)[.]'", [jvm, f"concat('src/main/java/', {jvm})"]),
        "csharp": _unless("name rlike '^(?:System|Microsoft|Windows)'", [f"concat({dotted}, '.cs')"]),
        "cpp": _unless(f"name in ({listed(_CPP)}) or name like 'sys/%'", [near, "name", "concat('include/', name)", "concat('src/', name)"]),
        "php": _unless(f"name rlike '^(?:{'|'.join(_PHP)})[\\\\\\\\]'", [f"concat({slashed}, '.php')", f"if({slashed} like 'App/%', concat('app/', substr({slashed}, 5), '.php'), null)", near]),
        "ruby": [f"if(name like '%/%' or name like '.%', {e}, null)" for e in (f"concat({near}, '.rb')", "concat(name, '.rb')")] + _all([f"concat('{p}', replace(name, '::', '/'))" for p in ("lib/", "app/", "")], [".rb", "/init.rb"]),
        "zig": _unless("name in ('std', 'builtin')", ["name", near, "concat('src/', name)"]),
        "sql": ["name", "if(name like '%.sql', null, concat(name, '.sql'))", near],
        "markdown": _unless(web, [named, f"concat(dir, '/', {named})"]),
        "html": _unless(web, ["name", near]),
        "css": _unless(web, ["name", "if(name like '%.css', null, concat(name, '.css'))", near]),
        "scss": [*sass, *(f"concat(dir, '/', {e})" for e in sass)],
        "config": ["name", near],
    }


def candidates(imports: DataFrame) -> DataFrame:
    """(source_file, candidates) of imports (path, language, name); null or unknown languages give none."""
    whens = " ".join(f"when '{lang}' then transform(array({', '.join(exprs)}), x -> {normal('x')})" for lang, exprs in _rules().items())
    placed = imports.where("path is not null and name is not null").selectExpr("path", "language", "name", "if(path like '%/%', regexp_replace(path, '/[^/]*$', ''), '') as dir")
    return spread(placed, "path").selectExpr("path as source_file", f"filter(case language {whens} end, x -> x is not null and x <> '') as candidates").where("size(candidates) > 0")


def by_folder(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): for Go the first file of the folder that the longest end of the import's path names."""
    wanted = imports.where(f"language = 'go' and split_part(name, '/', 1) not in ({listed(_GO)})").select("path", "name").distinct()
    ends = wanted.selectExpr("path", "name", "posexplode(transform(sequence(1, size(split(name, '/'))), i -> array_join(slice(split(name, '/'), i, size(split(name, '/'))), '/'))) as (pos, folder)")
    folders = files.where("path like '%/%.go'").selectExpr("path as dst", "explode(transform(sequence(1, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))) as folder")
    first = folders.groupBy("folder").agg(F.min("dst").alias("dst"))
    return dealt(ends).join(dealt(first), "folder").groupBy("path", "name").agg(F.expr("min_by(dst, pos)").alias("dst")).where("dst <> path").selectExpr("path as src", "dst").distinct()


def by_file_name(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): for C#, where no path fits, the first file called like the last part of the namespace."""
    wanted = imports.where("language = 'csharp' and not name rlike '^(?:System|Microsoft|Windows)'").selectExpr("path", "name", "concat(regexp_extract(name, '([^.]*)$', 1), '.cs') as file", "concat(replace(name, '.', '/'), '.cs') as whole").distinct()
    missed = dealt(wanted).join(dealt(files.select(F.col("path").alias("whole"))), "whole", "left_anti")
    first = files.where("path like '%.cs'").selectExpr("path as dst", "regexp_extract(path, '([^/]*)$', 1) as file").groupBy("file").agg(F.min("dst").alias("dst"))
    return dealt(missed).join(dealt(first), "file").where("dst <> path").selectExpr("path as src", "dst").distinct()


# Types of Swift that every program has, and words that look like types.
SWIFT_TYPES = (
    "Int Int8 Int16 Int32 Int64 UInt UInt8 UInt16 UInt32 UInt64 Float Double Bool String Character Void Never Any AnyObject AnyClass Array Dictionary Set Optional Date Data URL UUID Error NSObject NSError NSCoding "
    "View Text Image Button VStack HStack ZStack List NavigationView NavigationStack NavigationLink Color Font CGFloat CGPoint CGSize CGRect UIView UIViewController UIColor UIImage UITableView UICollectionView UIButton UILabel "
    "Codable Decodable Encodable Hashable Equatable Comparable Identifiable CustomStringConvertible ObservableObject Published Self self Type some"
).split()
_SWIFT_TYPE = r"(\[?\w+\]?(?:<[^>]+>)?(?:\?|!)?)"
# where types are named: the pattern, its group, and what parts several of them
_REFERENCES = [
    (rf"(?:var|let)\s+\w+\s*:\s*{_SWIFT_TYPE}", 1, None), (rf"\(\s*(?:\w+\s+)?\w+\s*:\s*{_SWIFT_TYPE}", 1, None), (rf"->\s*{_SWIFT_TYPE}", 1, None), (r"\b([A-Z]\w+)\s*\(", 1, None),
    (r"(?:struct|class|enum|actor|extension)\s+\w+(?:<[^>]+>)?\s*:\s*([^{]+)\{", 1, ","), (r"\bas[?!]?\s+([A-Z]\w+)", 1, None), (r"<([^>]+)>", 1, "[,:]"),
]


def type_references(files: DataFrame) -> DataFrame:
    """(path, language, name) of the types that Swift files name, without those that every program has."""
    found = []
    for expression, group, parts in _REFERENCES:
        held = f"regexp_extract_all(content, {pattern(expression)}, {group})"
        cut = {None: "regexp_replace({}, '[\\\\[\\\\]<>?!].*', '')", ",": "regexp_replace({}, '<.*', '')", "[,:]": "{}"}[parts]
        held = held if parts is None else f"flatten(transform({held}, t -> split(t, '{parts}')))"
        found.append(f"transform({held}, x -> trim({cut.format('x')}))")
    names = f"array_distinct(filter(flatten(array({', '.join(found)})), x -> x rlike '^\\\\p{{Lu}}'))"
    swift = spread(files.where("language = 'swift' and content is not null").select("path", "language", "content"), "path")
    rows = swift.selectExpr("path", "language", f"explode({names}) as name")
    return rows.where(f"name not in ({listed(SWIFT_TYPES)})")


_GO_BLOCK, _PHP_GROUP = r"^import\s*\(([^)]*)\)", r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+?)\\?\s*\{([^}]+)\}\s*;"
#: A use tree is read from left to right: an opening bracket begins a level below what stands before it.
_EMIT = "if(s.pending = '', s.out, array_append(s.out, struct(s.levels[0] as base, s.pending as name)))"
_FOLD = f"""aggregate(regexp_extract_all(tree, '[{{}},]|[^{{}},]+', 0), cast(struct(array('') as levels, '' as pending, array() as out) as struct<levels:array<string>,pending:string,out:array<struct<base:string,name:string>>>), (s, t) -> case
  when t = '{{' then struct(concat(array(concat(s.levels[0], s.pending)), s.levels) as levels, '' as pending, s.out as out)
  when t = ',' then struct(s.levels as levels, '' as pending, {_EMIT} as out)
  when t = '}}' then struct(slice(s.levels, 2, size(s.levels)) as levels, '' as pending, {_EMIT} as out)
  else struct(s.levels as levels, btrim(t, ' \\n\\t\\r') as pending, s.out as out) end, s -> {_EMIT})"""


def _pieces(files: DataFrame, language: str, begins: str) -> DataFrame:
    """(path, language, line_no, piece): the file from each beginning to the next, with its line."""
    parts = files.where(F.col("language") == language).selectExpr("path", "language", f"posexplode(split(content, {pattern(begins)})) as (at, piece)")
    before = "over (partition by path order by at rows between unbounded preceding and 1 preceding)"
    return parts.selectExpr("path", "language", f"cast(1 + coalesce(sum(length(piece) - length(replace(piece, '\\n', ''))) {before}, 0) as int) as line_no", "piece")


def grouped(files: DataFrame) -> DataFrame:
    """(path, language, line_no, type, name, names) of import blocks of Go, use trees of Rust and groups of PHP; names are those taken
    from the module (Go: its alias), the line is that of the block's beginning."""
    go = _pieces(files, "go", r"(?m)(?=^import\s*\()").selectExpr("path", "language", "line_no", f"explode(split(regexp_extract(piece, {pattern(_GO_BLOCK)}, 1), '\\n')) as line").where("not line rlike '^\\\\s*//'")
    go = go.selectExpr("path", "language", "line_no", "'import' as type", "regexp_extract(line, '\"([^\"]+)\"', 1) as name", "filter(array(regexp_extract(line, '(\\\\w+)\\\\s+\"', 1)), x -> x <> '') as names").where("name <> ''")
    php = _pieces(files, "php", r"(?m)(?=^[ \t]*use\s)").selectExpr("path", "language", "line_no", f"regexp_extract(piece, {pattern(_PHP_GROUP)}, 1) as base", f"regexp_extract(piece, {pattern(_PHP_GROUP)}, 2) as items").where("base <> ''")
    php = php.selectExpr("path", "language", "line_no", "base", "explode(filter(transform(split(items, ','), x -> btrim(split(x, ' as ')[0], ' \\n\\t\\r')), x -> x <> '')) as item").selectExpr("path", "language", "line_no", "'use_grouped' as type", "concat(base, '\\\\', item) as name", "cast(array() as array<string>) as names")
    trees = _pieces(files, "rust", r"(?m)(?=^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s)").selectExpr("path", "language", "line_no", "regexp_extract(piece, '^\\\\s*(?:pub(?:[(][^)]*[)])?\\\\s+)?use\\\\s+([^;]+);', 1) as tree").where("tree <> ''")
    leaves = trees.selectExpr("path", "language", "line_no", f"{_FOLD} as leaves")
    bases = leaves.selectExpr("path", "language", "line_no", "leaves", "explode(array_distinct(transform(leaves, x -> if(x.base = '', x.name, x.base)))) as base")
    root = "case when base like 'super::%' or base like 'self::%' then 'relative' when base like 'crate::%' then 'crate' when base like '::%' then 'absolute' when base like 'std::%' then 'std' else 'use' end"
    rust = bases.selectExpr("path", "language", "line_no", f"case when base like '%::' then 'use' when base like '% as %' then 'use_as' else {root} end as type", "trim(split(regexp_replace(base, '::$', ''), ' as ')[0]) as name",
                            "if(base like '%::', transform(filter(leaves, x -> x.base = base), x -> btrim(split(x.name, ' as ')[0], ' \\n\\t\\r')), filter(array(trim(get(split(base, ' as '), 1))), x -> x is not null)) as names")
    return go.unionByName(php).unionByName(rust)


def by_type(imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """(src, dst): for Swift the file of the first definition (file, name, line) of a type's name, by file and line."""
    first = definitions.groupBy("name").agg(F.expr("min_by(file, struct(file, line))").alias("dst"))
    return dealt(imports.where("language = 'swift'").select("path", "name")).join(dealt(first), "name").where("dst <> path").selectExpr("path as src", "dst").distinct()


def edges(imports: DataFrame, files: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """(src, dst) of all imports (path, language, name) that files (path) of the corpus answer."""
    from quarry.operators.graphs import import_edges

    out = import_edges(candidates(imports), files.select("path")).unionByName(by_folder(imports, files)).unionByName(by_file_name(imports, files))
    return (out if definitions is None else out.unionByName(by_type(imports, definitions))).distinct()
