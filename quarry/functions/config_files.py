"""What configuration files refer to and what they start: JSON by its fields, other formats by pattern; SQL alone.

files: (path, content).  A reference found by its text stands on the line of its first occurrence, 0 if it is
not found as it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.rules import name_of, pattern

FIELDS = "extends string, files array<string>, include array<string>, compilerOptions struct<paths: map<string, array<string>>>, scripts map<string, string>, main string, bin map<string, string>"
SCRIPT_FILE = r"\b(?:\./)?[\w/.-]+\.(?:js|ts|mjs|cjs|json|jsx|tsx)\b"
#: (type, file name pattern, line pattern): group 1 is the target.
BY_LINE = [
    ("env_file", "docker-compose.*[.]ya?ml$", r"env_file:\s*[\"']?(\.env[^\s\"']*)"),
    ("dockerfile", "docker-compose.*[.]ya?ml$", r"(?i)dockerfile:\s*[\"']?([^\s\"']+Dockerfile[^\s\"']*)"),
    ("volume_mount", "docker-compose.*[.]ya?ml$", r"[-\s]+[\"']?(\.{1,2}/[^:\s\"']+):[^\s\"']+"),
    ("config_file", "^pyproject[.]toml$", r"config_file\s*=\s*[\"']([^\"']+)[\"']"),
    ("path_dependency", "^cargo[.]toml$", r"path\s*=\s*[\"']([^\"']+)[\"']"),
    ("config_value", "[.]ini$", r"^\s*[\w_-]+\s*=\s*[\"']?([./][^\s\"']+\.[a-zA-Z0-9]+)"),
    ("path_reference", "[.](?:json|ya?ml|toml|ini)$", r"[\"'](\.{1,2}/(?:[^/\"\s]+/)*[^/\"\s]+\.[a-zA-Z0-9]+)[\"']"),
    ("path_reference", "[.](?:json|ya?ml|toml|ini)$", r"(?:^|\s)(\./[^\s:\"']+\.[a-zA-Z0-9]+|\.\./(?:[^/\s\"']+/)*[^/\s\"']+\.[a-zA-Z0-9]+)(?:\s|$)"),
]
#: (type, name, framework, file name pattern, line pattern); without a line pattern the file itself counts, on line 1.
STARTS = [
    ("project_config", "npm_project", "npm", "^package[.]json$", None), ("project_config", "typescript_project", "TypeScript", "^tsconfig[.]json$", None), ("project_config", "python_project", "Python", "^pyproject[.]toml$", None),
    ("project_config", "rust_project", "Rust", "^cargo[.]toml$", None), ("project_config", "docker_compose_project", "Docker", "docker-compose.*[.]ya?ml$", None),
    ("scripts_section", "project_scripts", "Python", "^pyproject[.]toml$", r"\[project\.scripts\]"), ("bin_target", "bin", "Rust", "^cargo[.]toml$", r"\[\[bin\]\]"), ("services_section", "services", "Docker", "docker-compose.*[.]ya?ml$", r"^services:\s*$"),
]
CONSTRAINTS = "primary|foreign|unique|check|constraint|key|index|exclude|like|period"


def _parsed(files: DataFrame) -> DataFrame:
    return files.selectExpr("path", "content", f"lower({name_of('path')}) as base").withColumn("data", F.from_json("content", FIELDS))


def _line_of(text: str) -> str:
    return f"if(contains(content, {text}), size(split(substring_index(content, {text}, 1), '\\n')), 0)"


def _lines(files: DataFrame) -> DataFrame:
    return files.selectExpr("path", f"lower({name_of('path')}) as base", "posexplode(split(content, '\\r?\\n')) as (at, text)").selectExpr("path", "base", "at + 1 as line", "text")


def imports(files: DataFrame) -> DataFrame:
    """(path, name, line, type): the files that configuration refers to."""
    data = _parsed(files)
    listed = [
        ("extends", "base = 'tsconfig.json'", "array(data.extends)"), ("file_reference", "base = 'tsconfig.json'", "data.files"), ("include_pattern", "base = 'tsconfig.json'", "filter(data.include, x -> x not like '*%')"),
        ("path_mapping", "base = 'tsconfig.json'", "flatten(map_values(data.compilerOptions.paths))"), ("script_file", "base = 'package.json'", f"flatten(transform(map_values(data.scripts), s -> regexp_extract_all(s, {pattern(SCRIPT_FILE)}, 0)))"),
    ]
    out = None
    for kind, where, names in listed:
        rows = data.where(where).selectExpr("path", "content", f"explode({names}) as name").where("name is not null").selectExpr("path", "name", f"{_line_of('name')} as line", f"'{kind}' as type")
        out = rows if out is None else out.unionByName(rows)
    lines = _lines(files)
    for kind, base, regex in BY_LINE:
        rows = lines.where(F.col("base").rlike(base)).selectExpr("path", "line", f"explode(regexp_extract_all(text, {pattern(regex)}, 1)) as name").where("not contains(name, '://')")
        out = out.unionByName(rows.selectExpr("path", "name", "line", f"'{kind}' as type"))
    return out.distinct()


def entry_points(files: DataFrame) -> DataFrame:
    """(path, type, name, line, framework)."""
    data, lines = _parsed(files), _lines(files)
    out = data.where("base = 'package.json' and data.main is not null").selectExpr("path", "'main_entry' as type", "data.main as name", f"{_line_of('data.main')} as line", "'npm' as framework")
    out = out.unionByName(data.where("base = 'package.json'").selectExpr("path", "content", "explode(map_keys(data.bin)) as name").selectExpr("path", "'bin_script' as type", "name", f"{_line_of('name')} as line", "'npm' as framework"))
    for kind, name, framework, base, regex in STARTS:
        found = data.where(F.col("base").rlike(base)).select("path", F.lit(1).alias("line")) if regex is None else lines.where(F.col("base").rlike(base) & F.col("text").rlike(regex)).select("path", "line")
        if base.endswith("json$"):
            found = found.join(data.where("data is not null and trim(content) like '{%'").select("path"), "path", "left_semi")
        out = out.unionByName(found.select("path", F.lit(kind).alias("type"), F.lit(name).alias("name"), "line", F.lit(framework).alias("framework")))
    return out


def sql_columns(files: DataFrame) -> DataFrame:
    """(path, table_name, name, type, line) of the columns that CREATE TABLE statements list, one to a line."""
    lines = files.selectExpr("path", "posexplode(split(content, '\\r?\\n')) as (at, text)").selectExpr("path", "at + 1 as line", "regexp_replace(text, '--.*$', '') as text")
    create = r"(?i)^\s*create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([\w.]+)"
    marked = lines.selectExpr("*", f"nullif(regexp_extract(text, {pattern(create)}, 1), '') as opens", "text rlike '^\\\\s*[)]|;\\\\s*$' as closes")
    spans = "over (partition by path order by line rows unbounded preceding)"
    before = "over (partition by path order by line rows between unbounded preceding and 1 preceding)"
    seen = marked.selectExpr("*", f"max(if(opens is not null, line, null)) {spans} as begun", f"max_by(opens, if(opens is not null, line, null)) {spans} as table_name", f"max(if(closes, line, null)) {before} as ended")
    inside = seen.where("opens is null and begun is not null and coalesce(ended, 0) < begun")
    column = r"^\s*[`\"\[]?(\w+)[`\"\]]?\s+(\w+(?:\s*\([^)]*\))?)"
    named = inside.selectExpr("path", "table_name", f"regexp_extract(text, {pattern(column)}, 1) as name", f"regexp_extract(text, {pattern(column)}, 2) as type", "line")
    return named.where(f"name <> '' and not lower(name) rlike '^(?:{CONSTRAINTS})$'")


def css_rules(files: DataFrame) -> DataFrame:
    """(path, name, selectors, declarations, has_variables) of style rules; the name is the first selector and how many follow."""
    plain = files.selectExpr("path", "regexp_replace(content, '(?s)/[*].*?[*]/', '') as content")
    rules_ = plain.selectExpr("path", "posexplode(regexp_extract_all(content, '[^{};]+[{][^{}]*[}]', 0)) as (at, body)")
    cut = rules_.selectExpr("path", "at", "filter(transform(split(split_part(body, '{', 1), ','), s -> trim(regexp_replace(s, '\\\\s+', ' '))), s -> s <> '') as selectors", "regexp_extract_all(split_part(body, '{', 2), '(?:^|[;\\\\s])\\\\s*(-{0,2}[A-Za-z][\\\\w-]*)\\\\s*:[^;}]*', 1) as properties")
    kept = cut.where("size(selectors) > 0 and not startswith(selectors[0], '@')")
    return kept.selectExpr("path", "left(concat(selectors[0], if(size(selectors) > 1, concat(' (+', size(selectors) - 1, ')'), '')), 50) as name", "size(selectors) as selectors", "size(properties) as declarations", "exists(properties, p -> p like '--%') as has_variables")


def html_counts(files: DataFrame) -> DataFrame:
    """(path, type, n, width): controls of each form, items of each list, rows and the widest row of each table."""
    out = None
    for kind, tag, counted in (("form", "form", "(?i)<(?:input|select|textarea|button|fieldset|label|output|datalist)[\\s>/]"), ("list", "ul|ol|dl", "(?i)<(?:li|dt)[\\s>]"), ("table", "table", "(?i)<tr[\\s>]")):
        spans = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(f"(?is)<(?:{tag})(?:\\s[^>]*)?>(?:(?!</(?:{tag})>).)*+"), F.lit(0))).alias("at", "body"))
        width = "array_max(transform(split(body, '(?i)<tr'), r -> regexp_count(r, '(?i)<t[dh][\\\\s>]')))" if kind == "table" else "cast(null as int)"
        rows = spans.select("path", "at", F.lit(kind).alias("type"), F.regexp_count("body", F.lit(counted)).alias("n"), F.expr(width).alias("width"))
        out = rows if out is None else out.unionByName(rows)
    return out
