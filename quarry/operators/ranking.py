"""Tiers, budgets, normalisation, modes, medians and archetypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_share(nodes: DataFrame, group: str, score: str, key: str, share: float = 0.2) -> DataFrame:
    """The best fifth of each group, one at least."""
    return nodes.selectExpr("*", f"row_number() over (partition by {group} order by {score} desc, {key}) as rank", f"count(*) over (partition by {group}) as members").where(f"rank <= greatest(1, floor({share} * members))")


def tiers(nodes: DataFrame, group: str, score: str, key: str, full: int = 3) -> DataFrame:
    """Display level by rank: full for the first, two lines for the rest."""
    return nodes.selectExpr("*", f"case when row_number() over (partition by {group} order by {score} desc, {key}) <= {full} then 'full' else 'short' end as tier")


def within_budget(nodes: DataFrame, group: str, score: str, key: str, cost: str, budget: float) -> DataFrame:
    """Least salient nodes are cut first, each while what is left of the total is over the budget."""
    return nodes.selectExpr("*", f"sum({cost}) over (partition by {group} order by {score} desc, {key} rows unbounded preceding) as running").selectExpr("*", f"running <= {budget} as kept")


def min_max(nodes: DataFrame, group: str, value: str) -> DataFrame:
    low, high = f"min({value}) over (partition by {group})", f"max({value}) over (partition by {group})"
    return nodes.selectExpr("*", f"case when {high} = {low} then 0D else ({value} - {low}) / ({high} - {low}) end as normal")


#: Weights of information, novelty and centrality, and the share of churn, by what a reader is after.
PROFILES = {"balanced": (0.30, 0.50, 0.20, 0.15), "active": (0.25, 0.30, 0.10, 0.45)}


def saliency(nodes: DataFrame, group: str, mode: str = "balanced") -> DataFrame:
    """Blend of information, novelty and centrality, and of churn where that varies within the group."""
    info, novelty, centrality, churn = PROFILES[mode]
    for v in ("info", "novelty", "centrality", "churn"):
        nodes = min_max(nodes, group, v).withColumnRenamed("normal", f"n_{v}")
    base = f"({info} * n_info + {novelty} * n_novelty + {centrality} * n_centrality)"
    return nodes.selectExpr("*", f"case when max(churn) over (partition by {group}) > min(churn) over (partition by {group}) then {base} * {1 - churn} + {churn} * n_churn else {base} end as saliency")


def modal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most common value of each group; ties go to the least value."""
    return rows.groupBy(group, value).agg(F.count("*").alias("n")).selectExpr("*", f"row_number() over (partition by {group} order by n desc, {value}) as rank").where("rank = 1").drop("rank")


def last_by(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Of rows with one key, that of the highest line."""
    return rows.selectExpr("*", f"row_number() over (partition by {', '.join(keys)} order by {line} desc) as rank").where("rank = 1").drop("rank")


def upper_median(rows: DataFrame, value: str, default: int = 1000) -> DataFrame:
    """The upper middle of the positive values, without gathering them.

    Values are counted by how many bits they have, then, in the class that holds the middle, one by one, so what passes
    through one task is a row for each number of bits and the counts of one class.
    """
    counts = rows.where(f"{value} > 0").groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")).withColumn("bits", F.expr("length(bin(cast(v as bigint)))"))
    classes = counts.groupBy("bits").agg(F.sum("n").alias("n"))
    placed = classes.selectExpr("bits", "sum(n) over (order by bits rows unbounded preceding) as upto", "n", "sum(n) over () as total")
    middle = placed.where("upto > total div 2").agg(F.expr("min_by(struct(bits, upto - n as below, total), bits) as m")).select("m.*")
    inside = counts.join(F.broadcast(middle), "bits")  # one row
    ranked = inside.selectExpr("v", "below + sum(n) over (order by v rows unbounded preceding) as upto", "total")
    return ranked.where("upto > total div 2").agg(F.coalesce(F.min("v"), F.lit(default)).alias("median"))


def archetypes(files: DataFrame, small: int = 1000) -> DataFrame:
    """files (path, size, age, importers) with an archetype, the first rule that holds, or none.

    A file is recent in the first quarter of the span of ages and old from its middle on; it is large from the upper median,
    2000 at least, on.
    """
    bounds = files.agg(F.min("age").alias("lo"), F.max("age").alias("hi")).selectExpr("lo + if(hi > lo, hi - lo, 1) * 0.25 as recent", "lo + if(hi > lo, hi - lo, 1) * 0.5 as old")
    large = upper_median(files, "size").selectExpr("greatest(median, 2000) as large")
    return files.join(F.broadcast(bounds)).join(F.broadcast(large)).selectExpr(  # one row each
        "path",
        f"case when importers > 0 and age <= recent then 'active_core' when importers > 0 and age >= old and size < {small} then 'stable_utilities' when importers > 0 and age >= old then 'core_infrastructure' "
        f"when importers = 0 and age <= recent and size >= large then 'active_development' when importers = 0 and age >= old and age > recent and size < {small} then 'potentially_stale' end as archetype",
    )


def first_by_archetype(files: DataFrame, top: int = 4) -> DataFrame:
    """The first files of each archetype: central kinds by importers, those in development newest first, stale ones oldest first."""
    order = "case when archetype in ('core_infrastructure', 'active_core', 'stable_utilities') then -importers when archetype = 'active_development' then age else -age end"
    return files.where("archetype is not null").selectExpr("*", f"row_number() over (partition by archetype order by {order}, path) as rank", "count(*) over (partition by archetype) as members").where(f"rank <= {top}")
