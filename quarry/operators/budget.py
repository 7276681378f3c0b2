"""Display levels within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame


def tokens(lines: str) -> str:
    """SQL of the tokens that an array of lines takes, about: a quarter of its characters, and one for each line."""
    return f"(length(array_join({lines}, '\\n')) div 4 + size({lines}))"


def degraded(nodes: DataFrame, budget: str, full_share: float = 0.2) -> DataFrame:
    """nodes (path, rank from 1, cost_full, cost_2, cost_1, ...) with ``level``: full, 2, 1 or 0.

    The first fifth of each path, one node at least, starts in full and the rest at depth 2.  While the total is over
    ``budget`` (SQL), nodes step down, the last ones first: all that are in full to depth 2, then all at
    depth 2 to depth 1, then all at depth 1 to nothing.  Each step ends as soon as the total fits, which
    is where the least of the totals so far does.
    """
    out = nodes.selectExpr("*", f"if(rank <= greatest(1, floor({full_share} * count(*) over (partition by path))), 'full', '2') as level")
    cost = "case level when 'full' then cost_full when '2' then cost_2 when '1' then cost_1 else 0 end"
    for here, down in (("full", "2"), ("2", "1"), ("1", "0")):
        fall = f"if(level = '{here}', cost_{here} - {'0' if down == '0' else f'cost_{down}'}, 0)"
        out = out.selectExpr("*", f"sum({cost}) over (partition by path) - coalesce(sum({fall}) over (partition by path order by rank desc rows between unbounded preceding and 1 preceding), 0) as __left")
        out = out.selectExpr("*", "min(__left) over (partition by path order by rank desc rows unbounded preceding) as __least").drop("__left")
        out = out.selectExpr(*[f"if(level = '{here}' and __least > {budget}, '{down}', level) as level" if c == "level" else c for c in out.columns if c != "__least"])
    return out
