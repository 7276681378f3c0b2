"""Shorter forms of a source text and of a node table: depth cuts, compact lines, focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that hold closing or separating marks only.
CLOSERS = r"^[\s{}()\[\];,]*$"

#: Comment openers by language, for lines that hold nothing else.
COMMENTS = {
    "hash": (r"^\s*#", "python ruby config"),
    "slash": (r"^\s*(?://|/\*.*\*/\s*$)", "typescript go rust java csharp cpp php swift zig scss css"),
    "dash": (r"^\s*--", "sql"),
    "angle": (r"^\s*<!--.*-->\s*$", "html markdown"),
}


def indent_width(line: str) -> str:
    """SQL of a line's indentation in columns, tab stops every four."""
    return f"length(regexp_replace(regexp_extract({line}, '^[ \\\\t]*', 0), ' {{4}}| {{0,3}}\\\\t', '    '))"


def depth_limit(lines: DataFrame, deepest: int) -> DataFrame:
    """lines (path, line_no, text) with each stretch below ``deepest`` levels cut to one mark.

    Levels are ranks of the indentation widths that a file has, so any indentation step will do.
    """
    mark = " " * deepest + "…"
    ranked = lines.selectExpr("path", "line_no", "text", f"dense_rank() over (partition by path order by {indent_width('text')}) > {deepest} as cut")
    seen = ranked.selectExpr("*", f"lag(cut or text = '{mark}', 1, false) over (partition by path order by line_no) as marked")
    return seen.where("not (cut and marked)").selectExpr("path", "line_no", f"if(cut, '{mark}', text) as text")


#: Statements that say something: control flow, definitions, calls, assignments.
SIGNIFICANT = (
    r"(?:^|[^\w.])(?:if|else|elif|for|foreach|while|do|switch|case|match|when|guard|loop|try|catch|except|finally|return|break|continue|throw|raise|yield|defer|new|await|def|fn|func|function|class|struct|enum|interface|impl|trait|lambda|let|const|local)\b"
    r"|\w\s*\(|[^=!<>]=[^=]|[-+*/%|&^]="
)


def skeleton(lines: DataFrame) -> DataFrame:
    """lines (path, line_no, text) folded: lines that say something stay, closers and blank lines go, and each stretch of others
    becomes one mark at the first one's indentation."""
    kept = lines.where(f"not text rlike {_literal(CLOSERS)}").selectExpr("*", f"not text rlike {_literal(SIGNIFICANT)} as folded")
    seen = kept.selectExpr("*", "lag(folded, 1, false) over (partition by path order by line_no) as marked")
    return seen.where("not (folded and marked)").selectExpr("path", "line_no", "case when folded then concat(repeat(' ', length(text) - length(ltrim(text))), '…') else rtrim(text) end as text")


def _is_comment() -> str:
    rules = " ".join(f"when language in ({', '.join(repr(x) for x in langs.split())}) then text rlike {_literal(pattern)}" for pattern, langs in COMMENTS.values())
    return f"coalesce(case {rules} else false end, false)"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def compact(lines: DataFrame) -> DataFrame:
    """lines (path, language, line_no, text) without blank lines and closers; a stretch of lines that are
    comments and nothing else, those inside a block comment among them, becomes one mark at the first one's
    indentation."""
    opened = "over (partition by path order by line_no rows between unbounded preceding and 1 preceding)"
    block = f"language in ({', '.join(repr(x) for x in COMMENTS['slash'][1].split())})"
    ends = lines.selectExpr("*", f"if({block} and text rlike '^\\\\s*/[*]' and not text rlike '[*]/', line_no, null) as begins", f"if({block} and text rlike '[*]/', line_no, null) as closes")
    inside = ends.selectExpr("*", f"coalesce(max(begins) {opened}, 0) > coalesce(max(closes) {opened}, 0) or begins is not null as in_block").drop("begins", "closes")
    kept = inside.where(f"not text rlike {_literal(CLOSERS)}").selectExpr("*", f"({_is_comment()} or in_block) as noted")
    seen = kept.selectExpr("*", "lag(noted or trim(text) = '…', 1, false) over (partition by path order by line_no) as marked")
    return seen.where("not (noted and marked)").selectExpr("path", "line_no", "case when noted then concat(repeat(' ', length(text) - length(ltrim(text))), '…') else rtrim(text) end as text")


def _in_order(parents: Column, chain: Column) -> Column:
    """Whether ``parents`` stand in ``chain`` in that order, gaps allowed."""
    found = F.aggregate(chain, F.lit(0), lambda n, x: n + F.when(F.get(parents, n) == x, 1).otherwise(0))
    return found == F.size(parents)


def focus(nodes: DataFrame, asked: list[str]) -> DataFrame:
    """(focus, path, node_id, name, tier): the nodes each asked name stands for, in each path.

    nodes: (path, node_id, name, ancestors array<string>).  The first tier that has a match holds: the
    exact name, then ``parent.name`` with parents in order, then any name that contains it.
    """
    each = nodes.withColumn("focus", F.explode(F.array(*map(F.lit, asked)))).withColumn("steps", F.split("focus", "[.]"))
    parents, leaf = F.slice("steps", 1, F.size("steps") - 1), F.element_at("steps", -1)
    tier = F.when(F.col("name") == F.col("focus"), 1).when((F.size("steps") > 1) & (F.col("name") == leaf) & _in_order(parents, F.col("ancestors")), 2).when(F.contains(F.lower("name"), F.lower("focus")), 3)
    matched = each.withColumn("tier", tier).where("tier is not null")
    return matched.selectExpr("*", "min(tier) over (partition by focus, path) as best").where("tier = best").select("focus", "path", "node_id", "name", "tier")
