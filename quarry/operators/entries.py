"""Entry points whose name stands further on: an annotation or attribute and the class or function that it marks.

Lines of files that hold a mark are windowed forward, file by file: *after* takes the first target at or behind the
mark, *next* only what follows it with nothing but white space between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.operators.rules import pattern

_RUST_FN = r"^\s*(?:async\s+)?fn\s+(\w+)"
# Fixed values: (type, mark, framework); a group of the mark is its URL (java) or its framework (rust).
MARKS: dict[str, list[tuple[str, str, str | None]]] = {
    "java": [("spring_boot_app", r"@SpringBootApplication", "Spring Boot"), ("servlet", r"@WebServlet\s*(?:\([^)]*\))?", "Servlet"), ("rest_controller", r"@RestController", "Spring"), ("controller", r"@Controller\b", "Spring")],
    "csharp": [("http_handler", r"^\s*\[Http(?:Get|Post|Put|Delete|Patch|Head|Options)\]", "ASP.NET")],
    "rust": [("async_main", r"#\[(tokio|async_std|actix_web)::main\]", None), ("async_test", r"#\[(tokio|async_std|actix_web)::test\]", None), ("test", r"#\[(?:cfg\(test\)|test)\]", None), ("benchmark", r"#\[bench\]", None)],
    "swift": [("main_type", r"@main\b", None), ("app_delegate", r"@(?:UIApplicationMain|NSApplicationMain)\b", None)],
}
#: What a mark stands for, and its name where there is none (null: no entry point).
TARGETS: dict[str, tuple[str, str, str | None]] = {
    "java": ("after", r"\bclass\s+(\w+)", "Unknown"),
    "csharp": ("after", r"^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal)\s+)?(?:async\s+)?[A-Za-z_][\w.<>?]*\s+([A-Za-z_]\w*)\s*\(", "ActionMethod"),
    "rust": ("next", _RUST_FN, None),
    "swift": ("next", r"^\s*(?:(?:public|internal|private|fileprivate)\s+)*(?:struct|class|enum)\s+(\w+)", None),
}


def marked(files: DataFrame) -> DataFrame:
    """(path, language, type, name, line, framework) of files (path, language, content)."""
    whens = lambda values: "case language " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"
    any_mark = {k: pattern("(?m)" + "|".join(m for _, m, _ in rows).replace(r"(tokio|", r"(?:tokio|")) for k, rows in MARKS.items()}
    held = files.where(f"content rlike {whens(any_mark)}")
    lines = held.selectExpr("path", "language", "posexplode(split(content, '\\r?\\n')) as (at, text)").where("text rlike '\\\\S'")
    hits = {}
    for language, rows in MARKS.items():
        found = ", ".join(f"if(text rlike {pattern(m)}, struct('{t}' as type, {pattern(m)} as mark, {'null' if f is None else repr(f)} as framework), null)" for t, m, f in rows)
        hits[language] = f"filter(array({found}), x -> x is not null)"
    target = whens({k: f"nullif(regexp_extract(text, {pattern(p)}, 1), '')" for k, (_, p, _) in TARGETS.items()})
    ahead = "over (partition by path order by at rows between {} and unbounded following)"
    seen = lines.selectExpr("path", "language", "at", "text", f"{target} as target", f"{whens(hits)} as hits").selectExpr("*", f"first(target, true) {ahead.format('1 following')} as later", "lead(text) over (partition by path order by at) as next_text")
    rows = seen.where("size(hits) > 0").selectExpr("path", "language", "at + 1 as line", "text", "later", "next_text", "inline(hits)")
    rows = rows.selectExpr("*", "regexp_extract(text, concat(mark, '(.*)$'), if(mark like '%(tokio%', 2, 1)) as rest", "if(mark like '%(tokio%', regexp_extract(text, mark, 1), framework) as by")
    here = whens({k: f"nullif(regexp_extract(rest, {pattern(p)}, 1), '')" for k, (_, p, _) in TARGETS.items()})
    follow = whens({k: f"nullif(regexp_extract(if(not rest rlike '\\\\S', next_text, rest), {pattern(p)}, 1), '')" if how == "next" else f"coalesce({here}, later, '{missing}')" for k, (how, p, missing) in TARGETS.items()})
    url = "nullif(regexp_extract(regexp_extract(text, mark, 0), '[@(].*[\"\\']([^\"\\']+)[\"\\']', 1), '')"
    named = rows.selectExpr("path", "language", "type", f"{follow} as name", "line", "by as framework", f"if(type = 'servlet', {url}, null) as url").where("name is not null")
    return named.selectExpr("path", "language", "type", "if(url is null, name, concat(name, ':', url)) as name", "line", "framework")
