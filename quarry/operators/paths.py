"""Paths: prefixes, directory rollups, chains, glob and ignore patterns, skip rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import rules


def prefixes(files: DataFrame) -> DataFrame:
    """(path, prefix, depth): each ancestor directory."""
    return files.selectExpr("path", "split(path, '/') as parts").selectExpr("path", "posexplode(transform(sequence(1, greatest(1, size(parts) - 1)), i -> array_join(slice(parts, 1, i), '/'))) as (depth, prefix)", "size(parts) as n").where("n > 1").selectExpr("path", "prefix", "depth + 1 as depth")


def extensions(files: DataFrame, top: int = 3) -> DataFrame:
    """(top, types): each top folder's most common extensions with their counts, ``...`` where there are more."""
    counts = files.selectExpr("if(path like '%/%', split_part(path, '/', 1), '(root)') as top", f"regexp_extract({rules.name_of('path')}, '[^.][.]([^./]*)$', 1) as ext").where("ext <> ''").groupBy("top", "ext").agg(F.count("*").alias("n"))
    ranked = counts.selectExpr("*", "row_number() over (partition by top order by n desc, ext) as rank", "count(*) over (partition by top) as kinds").where(f"rank <= {top}")
    return ranked.groupBy("top").agg(F.expr(f"concat(array_join(transform(array_sort(collect_list(struct(rank, ext, n))), x -> concat(x.ext, ':', x.n)), ' '), if(max(kinds) > {top}, ' ...', ''))").alias("types"))


def rollup(files: DataFrame) -> DataFrame:
    """(top, sub, n_files, bytes) with subtotals, from files (path, size)."""
    return files.selectExpr("split_part(path, '/', 1) as top", "split_part(path, '/', 2) as sub", "size").rollup("top", "sub").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def listing(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """Distinct directories down to a depth."""
    return prefixes(files).where(F.col("depth") <= max_depth).select("prefix", "depth").distinct()


def structure(files: DataFrame) -> DataFrame:
    """Top directory with its number of files and of different sub-directories."""
    return files.selectExpr("split(path, '/') as p").selectExpr("case when size(p) = 1 then '(root)' else p[0] end as top", "case when size(p) > 2 then p[1] end as sub").groupBy("top").agg(F.count("*").alias("n_files"), F.count_distinct("sub").alias("n_subs"))


def relevance(dirs: DataFrame) -> DataFrame:
    """files * (1 + 0.3 code ratio); version-control folders next to nothing."""
    return dirs.selectExpr("*", "case when name in ('.git', '.hg', '.svn') then 0.001D else n_files * (1 + 0.3D * n_code / n_files) end as relevance")


def chains(dirs: DataFrame, stop: tuple[str, ...] = ("src", "lib", "app", "tests", "docs", "bin", "pkg")) -> DataFrame:
    """dirs (dir, parent, name, n_files): from each directory down its only child, while files are few."""
    names = ", ".join(f"'{s}'" for s in stop)
    return dirs.sparkSession.sql(
        f"""
        WITH RECURSIVE only_child AS (SELECT parent, min(dir) AS child FROM {{d}} WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) = 1),
        walk(head, dir, depth) AS (
          SELECT dir, dir, 0 FROM {{d}}
          UNION ALL
          SELECT w.head, o.child, w.depth + 1 FROM walk w JOIN {{d}} x ON w.dir = x.dir JOIN only_child o ON o.parent = w.dir
          WHERE x.n_files <= 3 AND x.name NOT IN ({names}))
        SELECT head, max_by(dir, depth) AS tail, max(depth) AS hops FROM walk GROUP BY head""",
        d=dirs,
    )


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ** any path, * and ? within a name, classes as they are."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c in "*?":
            out, i = out + ("[^/]*" if c == "*" else "[^/]"), i + 1
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def expand_braces(pattern: str) -> list[str]:
    """All alternatives of {a,b}, nested ones too."""
    depth, start = 0, pattern.find("{")
    if start < 0:
        return [pattern]
    cuts = [start]
    for i in range(start, len(pattern)):
        depth += (pattern[i] == "{") - (pattern[i] == "}")
        if pattern[i] == "," and depth == 1:
            cuts.append(i)
        if depth == 0:
            cuts.append(i)
            return [pattern[:start] + x + rest for a, b in zip(cuts, cuts[1:], strict=False) for x in expand_braces(pattern[a + 1 : b]) for rest in expand_braces(pattern[i + 1 :])]
    return [pattern]


def ignore_rules(text: str) -> list[tuple[int, bool, str]]:
    """(ordinal, negated, regex) of an ignore file's lines."""
    out = []
    for i, line in enumerate(text.splitlines()):
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!").rstrip("/")
        anchored = "/" in line
        out.append((i, negated, glob_regex(line.lstrip("/") if anchored else "**/" + line)))
    return out


def ignored(files: DataFrame, rules: list[tuple[int, bool, str]]) -> DataFrame:
    """files with ``ignored``: the last rule that matches decides, and an ignored directory takes all below it."""
    deciders = F.lit(False)
    for _, negated, regex in sorted(rules):
        deciders = F.when(F.col("prefix").rlike(regex), F.lit(not negated)).otherwise(deciders)
    steps = prefixes(files).select("path", "prefix").unionByName(files.selectExpr("path", "path as prefix"))
    return steps.withColumn("hit", deciders).groupBy("path").agg(F.max("hit").alias("ignored"))


def collapsed(dirs: DataFrame) -> DataFrame:
    """(dir, label, n_files, size) of the children of each folder, chains of only children taken as one: dirs (dir, parent, name,
    n_files, size); sizes are summed along a chain."""
    heads = chains(dirs).select("head", "tail", "hops")
    steps = dirs.sparkSession.sql(
        """
        WITH RECURSIVE up(head, dir, at, label, n_files, size) AS (
          SELECT h.head, h.tail, h.hops, d.name, cast(d.n_files as bigint), cast(d.size as bigint) FROM {h} h JOIN {d} d ON h.tail = d.dir
          UNION ALL
          SELECT u.head, d.parent, u.at - 1, concat(p.name, '/', u.label), u.n_files + p.n_files, u.size + p.size FROM up u JOIN {d} d ON u.dir = d.dir JOIN {d} p ON d.parent = p.dir WHERE u.at > 0)
        SELECT head AS dir, label, n_files, size FROM up WHERE at = 0""",
        h=heads, d=dirs,
    )
    return steps


def last_match(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (path) by a small table of rules (ord, negated, regex): whether the last match ignores it."""
    return files.sparkSession.sql("SELECT f.path, coalesce(NOT max_by(r.negated, r.ord), false) AS ignored FROM {f} f LEFT JOIN {r} r ON f.path RLIKE r.regex GROUP BY f.path", f=files, r=rules)


def skipped(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Files below no directory of these names or storage suffixes."""
    listed = ", ".join(f"'{n}'" for n in names)
    suffix = " or ".join(f"d like '%{s}'" for s in rules.SKIP_DIR_SUFFIXES)
    return files.where(f"not exists(slice(split(path, '/'), 1, greatest(0, size(split(path, '/')) - 1)), d -> d in ({listed}) or {suffix})")


def is_test(path: str, rule: str) -> str:
    """SQL of the test-path rules, which differ on purpose: search, tail (also routes); source is the rule for code that is no
    product of its own, and counts folders alone."""
    parts, name = f"split({path}, '/')", f"element_at(split({path}, '/'), -1)"
    if rule == "search":
        return f"(arrays_overlap({parts}, array('test', 'tests', 'testing')) or {name} like 'test\\\\_%' or {name} like '%\\\\_test.py')"
    if rule == "tail":
        return f"(arrays_overlap({parts}, array('test', 'tests')) or {name} like 'test\\\\_%')"
    if rule == "source":
        return f"(not {rules.is_source(path)})"
    raise ValueError(rule)
