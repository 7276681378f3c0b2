"""Lines, sections, search and word statistics over a ``files`` table (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a bucket of the range join between lines and sections.
BUCKET = 64


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no from 1, text)."""
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text")).selectExpr("path", "cast(pos + 1 as bigint) as line_no", "text")


def sections(lines_: DataFrame) -> DataFrame:
    """Stretches of non-blank lines: (path, section_no from 1, start_line, end_line, n_lines)."""
    return lines_.sparkSession.sql(
        """
        SELECT path, section_no, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_lines FROM (
          SELECT path, line_no, sum(head) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section_no FROM (
            SELECT path, line_no, cast(line_no - coalesce(lag(line_no) OVER (PARTITION BY path ORDER BY line_no), -1) > 1 AS bigint) AS head
            FROM {l} WHERE trim(text) <> ''))
        GROUP BY path, section_no""",
        l=lines_,
    )


def containing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Range join of points (path, line_no, ...) with spans (path, node_id, start_line, end_line, ...).

    Of the spans that hold a line the last in pre-order wins; points outside all spans keep nulls, and points are told apart
    by their columns.  Spans are dealt by the buckets of lines that they touch, which makes it an equi
    join, and either side is read once.
    """
    own = ", ".join(f"p.{c}" for c in points.columns)
    return points.sparkSession.sql(
        f"""
        SELECT {", ".join(points.columns)}, best.node_id, best.start_line, best.end_line FROM (
          SELECT {own}, max_by(if(b.node_id IS NULL, NULL, struct(b.node_id, b.start_line, b.end_line)), b.node_id) AS best
          FROM (SELECT *, line_no div {BUCKET} AS bucket FROM {{p}}) p
          LEFT JOIN (SELECT *, explode(sequence(start_line div {BUCKET}, end_line div {BUCKET})) AS bucket FROM {{s}}) b
            ON p.path = b.path AND p.bucket = b.bucket AND p.line_no BETWEEN b.start_line AND b.end_line
          GROUP BY {own})""",
        p=points, s=spans,
    )


def with_hits(files: DataFrame, pattern: str) -> DataFrame:
    """Files of which some line can match: the others need neither lines nor sections."""
    return files.where(F.col("content").rlike("(?im)" + pattern))


def search(lines_: DataFrame, spans: DataFrame, pattern: str, is_test: str = "false", limit: int = 40) -> DataFrame:
    """Ranked hits grouped by the section they stand in."""
    hits = lines_.where(F.col("text").rlike("(?i)" + pattern))
    found = containing(hits.select("path", "line_no"), spans)
    return lines_.sparkSession.sql(
        f"""
        SELECT path, node_id, start_line, end_line, hits, file_total FROM (
          SELECT *, sum(hits) OVER (PARTITION BY path) AS file_total FROM (
            SELECT path, node_id, start_line, end_line, count(*) AS hits FROM {{f}} GROUP BY path, node_id, start_line, end_line))
        ORDER BY {is_test}, file_total DESC, path, hits DESC, start_line LIMIT {limit}""",
        f=found,
    )


def word_counts(files: DataFrame, pattern: str = r"[A-Za-z0-9_]+", group: int = 0) -> DataFrame:
    """(word, n) of all matches."""
    return files.select(F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(group))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def unreferenced(definitions: DataFrame, counts: DataFrame, least: int = 4) -> DataFrame:
    """Definition names that occur once at most in all text."""
    named = definitions.where(F.length("name") >= least)
    return named.join(counts.withColumnRenamed("word", "name"), "name", "left").where("coalesce(n, 0) <= 1").select(*definitions.columns)


def duplicate_blocks(blocks: DataFrame, min_lines: int = 4, min_members: int = 2) -> DataFrame:
    """Blocks (path, start_line, body) whose lines, right-trimmed and without blanks, are equal."""
    return blocks.sparkSession.sql(
        f"""
        SELECT md5(body) AS digest, size(split(body, '\\n')) AS n_lines, count(*) AS members, min(path) AS first_path FROM (
          SELECT path, array_join(filter(transform(split(body, '\\n'), x -> rtrim(x)), x -> x <> ''), '\\n') AS body FROM {{b}})
        GROUP BY body HAVING count(*) >= {min_members} AND size(split(body, '\\n')) >= {min_lines}""",
        b=blocks,
    )


def shannon_entropy(files: DataFrame) -> DataFrame:
    """(path, entropy) in bits a character."""
    return files.sparkSession.sql(
        """
        SELECT path, -sum(n / total * log2(n / total)) AS entropy FROM (
          SELECT path, n, sum(n) OVER (PARTITION BY path) AS total FROM (
            SELECT path, c, count(*) AS n FROM (SELECT path, explode(split(content, '')) AS c FROM {f} WHERE content <> '') WHERE c <> '' GROUP BY path, c))
        GROUP BY path""",
        f=files,
    )
