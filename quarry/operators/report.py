"""Ranked parts of reports: what a reader sees of a corpus first.  Every one is a top-k with a total order,
so that no more than what is shown comes together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import rules, views


def core_files(file_nodes: DataFrame, top: int = 20) -> DataFrame:
    """The most central files (path, n_imports, n_importers, centrality), none without links."""
    return file_nodes.where("centrality > 0").orderBy(F.desc("centrality"), "path").limit(top)


def key_dependencies(file_nodes: DataFrame, edges: DataFrame, files: int = 5, imports: int = 3) -> DataFrame:
    """(path, imported, hidden): the first imports of the most central files, and how many more there are."""
    first = file_nodes.orderBy(F.desc("centrality"), "path").limit(files).select("path", "centrality")
    ranked = edges.withColumnRenamed("src", "path").join(F.broadcast(first), "path").selectExpr("*", "row_number() over (partition by path order by dst) as rank", "count(*) over (partition by path) as n")  # a few rows
    shown = ranked.where(f"rank <= {imports}").groupBy("path", "centrality", "n").agg(F.expr("array_join(array_sort(collect_list(dst)), ', ')").alias("imported"))
    return shown.selectExpr("path", "imported", f"greatest(n - {imports}, 0) as hidden")


def clusters(files: DataFrame) -> DataFrame:
    """(cluster, n_files, first_files): files (path, cluster) of each cluster, the first three by name."""
    ranked = files.selectExpr("path", "cluster", "row_number() over (partition by cluster order by path) as rank", "count(*) over (partition by cluster) as n").where("rank <= 3")
    return ranked.groupBy("cluster").agg(F.max("n").alias("n_files"), F.expr("array_join(array_sort(collect_list(path)), ', ')").alias("first_files"))


def cluster_members(files: DataFrame, members: DataFrame, shown: tuple[str, ...] = ("entry_points", "core_logic", "plugins")) -> DataFrame:
    """(cluster, path, type, name): the first two classes and functions of the first three files of the clusters that are shown in full."""
    ranked = files.where(f"cluster in ({rules.listed(shown)})").selectExpr("path", "cluster", "row_number() over (partition by cluster order by path) as rank").where("rank <= 3")
    return ranked.select("cluster", "path").join(members.where("rank <= 2").select(F.col("file").alias("path"), "type", "name"), "path").select("cluster", "path", "type", "name")


def inventory(files: DataFrame, important: DataFrame, folders: int = 12, shown: int = 8) -> DataFrame:
    """(folder, names, hidden): of the fullest two-level folders the first files, important ones (path) first, then by centrality;
    files (path, language, size, centrality) of low value are left out unless they are important."""
    folder = "case when path not like '%/%' then '(root)' else concat(split_part(path, '/', 1), '/', split_part(path, '/', 2), '/') end"
    placed = files.join(important.select("path").distinct().withColumn("__important", F.lit(1)), "path", "left").selectExpr("*", f"{folder} as folder", "coalesce(__important, 0) as important")
    fullest = placed.groupBy("folder").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "folder").limit(folders)
    kept = placed.where(f"important = 1 or not {rules.low_value('language', 'path', 'size')}").join(F.broadcast(fullest), "folder")  # a dozen rows
    ranked = kept.selectExpr("folder", "n_files", f"{rules.name_of('path')} as name", "row_number() over (partition by folder order by important desc, centrality desc, path) as rank", "count(*) over (partition by folder) as n").where(f"rank <= {shown}")
    return ranked.groupBy("folder", "n_files").agg(F.expr("array_join(transform(array_sort(collect_list(struct(rank, name))), x -> x.name), ', ')").alias("names"), F.expr(f"greatest(max(n) - {shown}, 0)").alias("hidden")).select("folder", "names", "hidden")


def top_directories(dirs: DataFrame, top: int = 10) -> DataFrame:
    """dirs (name, n_files, n_code, ...) by relevance, with a note on foreign or large ones."""
    from quarry.operators.paths import relevance

    note = "case when name in ('vendor', 'third_party', 'external', 'lib', 'libs') then '3rd-party' when n_files > 1000 then 'large' else '' end"
    return relevance(dirs).orderBy(F.desc("relevance"), "name").limit(top).selectExpr("*", f"{note} as note")


def recommended(files: DataFrame, file_nodes: DataFrame, hot: DataFrame) -> DataFrame:
    """(turn, line): where to look next: two active folders, the file that most import, the hottest function; three lines at most.

    files: (path, age) with the age in days; file_nodes: (path, n_importers); hot: (fqn, centrality).
    """
    bounds = files.agg(F.min("age").alias("lo"), F.max("age").alias("hi")).selectExpr("lo + if(hi > lo, hi - lo, 1) * 0.25 as recent")
    active = files.where("path like '%/%'").join(F.broadcast(bounds)).where("age <= recent").selectExpr("split_part(path, '/', 1) as top").distinct().orderBy("top").limit(2)  # one row is sent
    lines = active.selectExpr("0 as part", "top as k", "concat('scan_directory(\"', top, '/\")') as line")
    lines = lines.unionByName(file_nodes.where("n_importers >= 2").orderBy(F.desc("n_importers"), "path").limit(1).selectExpr("1 as part", "path as k", "concat('scan_file(\"', path, '\")') as line"))
    lines = lines.unionByName(hot.orderBy(F.desc("centrality"), "fqn").limit(1).selectExpr("2 as part", "fqn as k", "concat('read ', split_part(fqn, ':', 2), '() in ', split_part(fqn, ':', 1)) as line"))
    return lines.selectExpr("cast(row_number() over (order by part, k) as int) as turn", "line").where("turn <= 3")


def preview_lines(dirs: DataFrame, types: DataFrame) -> DataFrame:
    """(turn, line) of the quick view: folders (name, n_files, n_code, size) by relevance with their types (top, types)."""
    shown = top_directories(dirs).join(types.withColumnRenamed("top", "name"), "name", "left")
    line = f"concat(rpad(concat(name, '/'), 16, ' '), ' ', lpad({views.count_label('n_files')}, 5, ' '), '    ', rpad(coalesce(types, ''), 24, ' '), ' ', {views.size_label('size')}, if(note = '', '', concat('  ', note)))"
    return shown.selectExpr("cast(row_number() over (order by relevance desc, name) as int) as turn", f"rtrim({line}) as line")


def architecture_lines(sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """(section, turn, line) of a report: titled parts (turn, line), in order; empty parts have no title."""
    out = None
    for k, (title, part) in enumerate(sections):
        rows = part.selectExpr(f"{k} as section", "cast(turn as int) as turn", "concat('  ', line) as line")
        head = part.limit(1).selectExpr(f"{k} as section", "0 as turn", f"{rules.listed([f'━━━ {title} ━━━'])} as line")
        both = head.unionByName(rows)
        out = both if out is None else out.unionByName(both)
    return out


def numbered(rows: DataFrame, order: str, line: str) -> DataFrame:
    """(turn, line) of a table of a few rows."""
    return rows.selectExpr(f"cast(row_number() over (order by {order}) as int) as turn", f"{line} as line")


def health_lines(unreferenced: DataFrame, duplicates: DataFrame, most: int = 12, groups: int = 5) -> DataFrame:
    """(turn, line) on names (path, name, start_line) that nothing mentions, and equal blocks (n_lines, members, first_path); none where all is well."""
    first = unreferenced.orderBy("path", "start_line", "name").limit(most)
    named = first.agg(F.expr(f"array_join(transform(array_sort(collect_list(struct(path, start_line, name))), x -> concat({rules.name_of('x.path')}, ':', x.name, '@', x.start_line)), ', ')").alias("names"), F.count("*").alias("n")).where("n > 0")
    lines = named.selectExpr("0 as part", "0L as k", "'' as p", "concat('UNREFERENCED (no mention elsewhere in this scan): ', names) as line")
    same = duplicates.orderBy(F.desc("members"), "first_path", "digest").limit(groups).selectExpr("1 as part", "-members as k", "first_path as p", "concat('DUPLICATE (', members, 'x identical, ', n_lines, ' lines): ', first_path) as line")
    return numbered(lines.unionByName(same), "part, k, p", "line")


def activity_lines(churn: DataFrame, pairs: DataFrame, top: int = 8) -> DataFrame:
    """(turn, line) on the files that change most, and those that change together."""
    files = churn.orderBy(F.desc("churn"), "path").limit(top).selectExpr("0 as part", "-churn as k", "path as p", "concat(path, ': ', churn, if(churn = 1, ' commit', ' commits')) as line")
    both = pairs.selectExpr("1 as part", "-together as k", "concat(a, b) as p", "concat(a, ' + ', b, ': ', together, ' commits together') as line")
    return numbered(files.unionByName(both), "part, k, p", "line")


def tail_lines(orphans: DataFrame, dead: DataFrame, drift: DataFrame, files: DataFrame | None = None, most: int = 12) -> DataFrame:
    """(turn, line) on loose ends: orphans (location, tag, key, pid), dead definitions (file, qualified) and drift (site, anchor, missing), of
    the files (path) given or of all; the same lines serve a file's tail and the review of a change."""
    if files is not None:
        of = files.select("path").distinct()
        orphans = orphans.join(of.selectExpr("concat(path, '') as location"), "location", "left_semi")
        dead = dead.join(of.selectExpr("concat(path, '') as file"), "file", "left_semi")
        drift = drift.withColumn("place", F.expr("regexp_extract(site, '^(.*):[^:]*$', 1)")).join(of.selectExpr("concat(path, '') as place"), "place", "left_semi")
    # each part is a handful of rows with names of its own
    a = orphans.orderBy("tag", "key", "pid").limit(most).selectExpr("0 as part", "concat(tag, ' ', key, ' ', pid) as k", "concat('orphan: ', tag, ' ', key, '  (', pid, ')') as line")
    b = dead.orderBy("qualified", "file").limit(most).selectExpr("1 as part", "concat(qualified, ' ', file) as k", "concat('candidate-dead: ', qualified, '  (', file, ')') as line")
    c = drift.orderBy("site", "anchor", "missing").limit(most).selectExpr("2 as part", "concat(site, anchor) as k", "concat('drift: ', regexp_extract(site, '([^:]*)$', 1), ' calls ', anchor, ' but (unlike peers) not ', missing) as line")
    return numbered(a.unionByName(b).unionByName(c), "part, k", "line")
