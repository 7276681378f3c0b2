"""SQL files: the dialect that their words vote for, and their statements with names, lines and columns.

Statements end at a ``;`` outside of quotes, dollar quotes and comments.  Text is cut into tokens by one pattern, and
running sums over the tokens of a file number statements and lines, so no parser runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.pattern_tables import STRUCTURES
from quarry.operators.rules import listed, pattern

# Words that speak for a dialect, in capitals.
MARKERS = {
    "postgresql": ["DO $$", "DO $", "$$;", "PLPGSQL", "PL/PGSQL", "RAISE NOTICE", "RAISE EXCEPTION", "RAISE WARNING", "PARTITION BY LIST", "PARTITION BY RANGE", "PG_CLASS", "PG_NAMESPACE", "PG_CATALOG", "UNLOGGED TABLE", "DEFERRABLE INITIALLY", "EXECUTE FORMAT("],
    "mysql": ["ENGINE=INNODB", "ENGINE=MYISAM", "AUTO_INCREMENT", "UNSIGNED", "`", "TINYINT", "MEDIUMINT"],
    "sqlite": ["AUTOINCREMENT", "WITHOUT ROWID", "PRAGMA"],
}
#: What begins an entry of a table that is no column.
CONSTRAINTS = ("primary", "foreign", "unique", "check", "constraint", "key", "index", "exclude", "like", "partition")
_TOKEN = r"(?s)'(?:[^']|'')*+'|([$]\w*+[$]).*?\1|--[^\n]*+|/[*].*?(?:[*]/|\z)|;|[^;'$/-]++|."


def dialect(content: str) -> str:
    """SQL of the dialect: PostgreSQL where no other has more votes, then MySQL with more than SQLite, then SQLite; else generic."""
    votes = {k: f"size(filter(array({listed(words)}), w -> contains(upper({content}), w)))" for k, words in MARKERS.items()}
    p, m, s = (votes[k] for k in ("postgresql", "mysql", "sqlite"))
    return f"case when {p} > 0 and {p} >= {m} and {p} >= {s} then 'postgresql' when {m} > {s} then 'mysql' when {s} > 0 then 'sqlite' else 'generic' end"


def statements(files: DataFrame) -> DataFrame:
    """(path, turn, start_line, end_line, text) of each statement of files (path, content); text without comments, lines from the first
    word to the last."""
    tokens = files.where("content is not null").select("path", F.posexplode(F.regexp_extract_all("content", F.lit(_TOKEN), F.lit(0))).alias("at", "token"))
    before = "over (partition by path order by at rows between unbounded preceding and 1 preceding)"
    placed = tokens.selectExpr("path", "at", "token", f"coalesce(sum(if(token = ';', 1, 0)) {before}, 0) as turn", f"1 + coalesce(sum(length(token) - length(replace(token, '\\n', ''))) {before}, 0) as line", "token like '--%' or token like '/*%' as comment")
    # lines of a token's first and last sign that is no space
    lead, tail = "length(regexp_replace(regexp_extract(token, '^(\\\\s*)', 1), '[^\\n]', ''))", "length(regexp_replace(regexp_replace(token, '\\\\s+$', ''), '[^\\n]', ''))"
    said = placed.where("not comment and token <> ';'").selectExpr("path", "turn", "at", "token", f"if(trim(regexp_replace(token, '\\\\s', ' ')) = '', null, line + {lead}) as first", f"if(trim(regexp_replace(token, '\\\\s', ' ')) = '', null, line + {tail}) as last")
    whole = said.groupBy("path", "turn").agg(F.min("first").alias("start_line"), F.max("last").alias("end_line"), F.expr("array_join(transform(array_sort(collect_list(struct(at, token))), x -> x.token), '')").alias("text"))
    return whole.where("start_line is not null").selectExpr("path", "cast(row_number() over (partition by path order by turn) as int) as turn", "cast(start_line as int) as start_line", "cast(end_line as int) as end_line", "trim(regexp_replace(text, '\\\\s+', ' ')) as text")


def structures(files: DataFrame) -> DataFrame:
    """(path, dialect, type, name, start_line, end_line, columns) of statements that create something; columns are "name type" of tables,
    however their declarations are wrapped."""
    kinds = ", ".join(f"struct('{t}' as type, regexp_extract(text, {pattern(p)}, 1) as name)" for t, p in STRUCTURES["sql"])
    made = statements(files).selectExpr("path", "start_line", "end_line", "text", f"get(filter(array({kinds}), x -> x.name <> ''), 0) as made").where("made is not null")
    body = "regexp_extract(text, '(?is)^create[^(]*?[(](.*)[)][^)]*$', 1)"
    entries = f"transform(regexp_extract_all({body}, '((?:[^,()]|[(](?:[^()]|[(][^()]*[)])*[)])+)', 1), x -> trim(x))"
    named = f"filter({entries}, x -> x <> '' and lower(split(x, '[ (]')[0]) not in ({listed(CONSTRAINTS)}))"
    short = "concat(regexp_replace(split(x, ' ')[0], '[`\"\\\\[\\\\]]', ''), ' ', regexp_extract(x, '^\\\\S+\\\\s+(\\\\w+(?:\\\\s*[(][^)]*[)])?)', 1))"
    rows = made.selectExpr("path", "made.type as type", "made.name as name", "start_line", "end_line", f"if(made.type = 'table', transform({named}, x -> trim({short})), cast(array() as array<string>)) as columns")
    return rows.join(files.selectExpr("path", f"{dialect('content')} as dialect"), "path").select("path", "dialect", "type", "name", "start_line", "end_line", "columns")
