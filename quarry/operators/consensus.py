"""Sites that break a pattern which their peers follow, mined from usage bags (cid, callee)."""

from __future__ import annotations

from math import lgamma

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import rules
from quarry.operators.nodes import in_degrees
from quarry.scratch import dealt

SIGNIFICANT, FENCE_LEAST, BAGS_LEAST, PEERS, TOP = 3.0, 8, 3, 3, 20
#: Callees from which a bag is dealt in blocks.
HUB = 1000
#: Factorials whose logarithms are listed; a series gives those beyond.
LISTED = 32


def bags(calls: DataFrame) -> DataFrame:
    """Distinct (cid, callee); module-level calls have no caller and are left out."""
    return calls.where("cid is not null and callee is not null").select("cid", "callee").transform(dealt, "cid", "callee").distinct()


def usage(definitions: DataFrame, calls: DataFrame, source_only: bool = True) -> DataFrame:
    """Bags of calls (caller_file, caller_name, callee_name) to names that definitions (file, name) have, without
    names that say nothing; by default of the product's own sources alone."""
    if source_only:
        definitions, calls = definitions.where(rules.is_source("file")), calls.where(rules.is_source("caller_file"))
    inside = definitions.where("name <> ''").select(F.col("name").alias("callee_name")).distinct()
    kept = calls.where(f"caller_name <> '' and not {rules.is_noise('callee_name')}").join(inside, "callee_name", "left_semi")
    return bags(kept.selectExpr("concat(caller_file, ':', caller_name) as cid", "callee_name as callee"))


def base_rates(bags_: DataFrame) -> DataFrame:
    """(callee, callers, rate)."""
    return _rates(bags_).select("callee", "callers", "rate")


def _rates(bags_: DataFrame) -> DataFrame:
    total = bags_.agg(F.count_distinct("cid").alias("bags"))
    return bags_.groupBy("callee").agg(F.count("*").alias("callers")).join(F.broadcast(total)).selectExpr("callee", "callers", "callers / bags as rate", "bags")  # one row


def cooccurrence(bags_: DataFrame) -> DataFrame:
    """(anchor, other, together, callers): ordered pairs that callers of the anchor mostly share.

    A bag of many callees, whose pairs are the square of it, is dealt by blocks of ``HUB`` anchors, each of which meets the whole bag.
    """
    return bags_.sparkSession.sql(
        f"""
        WITH b AS (SELECT * FROM {{b}}), s AS (SELECT cid, count(*) div {HUB} AS last FROM b GROUP BY cid HAVING count(*) >= {HUB}),
        a AS (SELECT b.cid, callee, if(last IS NULL, 0L, pmod(xxhash64(callee), last + 1)) AS block FROM b LEFT JOIN s ON b.cid = s.cid),
        o AS (SELECT b.cid, callee, explode(sequence(0L, coalesce(last, 0L))) AS block FROM b LEFT JOIN s ON b.cid = s.cid)
        SELECT p.anchor, p.other, p.together, n.callers FROM (
          SELECT a.callee AS anchor, o.callee AS other, count(*) AS together FROM a JOIN o ON a.cid = o.cid AND a.block = o.block AND a.callee <> o.callee GROUP BY a.callee, o.callee) p
        JOIN (SELECT callee, count(*) AS callers FROM b GROUP BY callee) n ON p.anchor = n.callee""",
        b=bags_,
    )


def _log_factorial(n: str) -> str:
    """SQL of ln n!: listed for small n, else Stirling's series, whose error is below 1e-12 there."""
    known = ", ".join(f"{lgamma(k + 1)!r}D" for k in range(LISTED))
    x = f"cast({n} as double)"
    return f"case when {n} < {LISTED} then get(array({known}), cast({n} as int)) else {x} * ln({x}) - {x} + 0.5D * ln(6.283185307179586D * {x}) + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}) + 1 / (1260 * power({x}, 5)) end"


def candidates(bags_: DataFrame, share: float = 0.5) -> DataFrame:
    """Rules anchor -> other with k of n callers, their enrichment and strength; none from fewer than three bags.

    Enrichment is -log10 P(X >= k) for X ~ Bin(n, base rate of other).  Of the tail's terms those within twenty
    deviations of its largest are summed; the rest is nothing in double precision.
    """
    pairs = cooccurrence(bags_).where(f"callers >= 3 and together > callers * {share} and together < callers")
    rates = _rates(bags_).where(f"bags >= {BAGS_LEAST}").select(F.col("callee").alias("other"), "rate")
    near = "cast(20 * sqrt(callers) as bigint) + 100"
    first, last = f"greatest(together, cast(callers * rate as bigint) - ({near}))", f"least(callers, greatest(together, cast(callers * rate as bigint)) + ({near}))"
    # the first term by logarithms, each further one by its ratio to the one before
    head = f"{_log_factorial('callers')} - ({_log_factorial('first')}) - ({_log_factorial('(callers - first)')}) + first * ln(rate) + (callers - first) * ln(1 - rate)"
    ratio = "a.t * (callers - j + 1) / j * odds"
    tail = f"aggregate(if(first < last, sequence(first + 1, last), cast(array() as array<bigint>)), struct(1D as t, 1D as s), (a, j) -> struct({ratio} as t, a.s + {ratio} as s), a -> a.s)"
    pairs = pairs.join(rates, "other").selectExpr("*", f"cast({first} as bigint) as first", f"cast({last} as bigint) as last", "if(rate < 1, rate / (1 - rate), 0D) as odds")
    scored = pairs.withColumn("enrichment", F.expr(f"case when rate >= 1 then 0D else greatest(0D, -({head} + ln({tail})) / ln(10D)) end"))
    return scored.selectExpr("anchor", "other", "together", "callers", "rate", "enrichment", "enrichment * -log10((callers - together) / (callers + 1)) as strength")


def audit(rules_: DataFrame) -> DataFrame:
    """Significant rules strictly above the outer Tukey fence of all candidates, where there are enough to have one."""
    fence = rules_.agg(F.count("*").alias("n"), F.expr("percentile(strength, array(0.25, 0.75))").alias("q"), F.max("strength").alias("most"))
    fence = fence.selectExpr(f"case when n < {FENCE_LEAST} then double('-infinity') when q[1] = q[0] then most else q[1] + 3 * (q[1] - q[0]) end as fence")
    return rules_.where(F.col("enrichment") >= SIGNIFICANT).join(F.broadcast(fence)).where("strength > fence").drop("fence")  # one row


def missing_sites(rules_: DataFrame, bags_: DataFrame) -> DataFrame:
    """(site, anchor, missing, strength): callers of the anchor that lack what the rule expects."""
    sites = rules_.join(bags_.withColumnRenamed("callee", "anchor"), "anchor")
    return sites.join(bags_.withColumnRenamed("callee", "other"), ["cid", "other"], "left_anti").select(F.col("cid").alias("site"), "anchor", F.col("other").alias("missing"), "together", "callers", "strength")


def conformers(rules_: DataFrame, bags_: DataFrame) -> DataFrame:
    """(anchor, missing, cid): callers of both ends of a rule."""
    both = rules_.select("anchor", F.col("other").alias("missing")).distinct()
    return both.join(bags_.withColumnRenamed("callee", "anchor"), "anchor").join(bags_.withColumnRenamed("callee", "missing"), ["cid", "missing"], "left_semi").select("anchor", "missing", "cid")


def same_role(sites: DataFrame, rules_: DataFrame, bags_: DataFrame, clusters: DataFrame | None = None, lenses: tuple[str, ...] = ("name", "cluster", "graph")) -> DataFrame:
    """Sites whose role is that of most conformers under every lens.

    Roles are the first word of the name, the cluster of the file (path, cluster; only if given), and the bands of how many
    call it and how many it calls, the two ends of the rule left out.  Of roles as common as
    others, that of the first conformer counts.
    """
    sizes = bags_.groupBy("cid").agg(F.count("*").alias("out"))
    about = sizes.join(in_degrees(bags_), "cid").withColumn("path", F.expr("regexp_extract(cid, '^(.*):[^:]*$', 1)"))
    about = about.join(clusters.select("path", "cluster"), "path", "left") if clusters is not None else about.withColumn("cluster", F.lit("other"))
    name = rules.name_role("regexp_extract(cid, '([^:]*)$', 1)")
    peers = conformers(rules_, bags_).join(about, "cid").selectExpr("anchor", "missing", "cid", f"{name} as name", "coalesce(cluster, 'other') as cluster", f"concat({rules.band('in_degree')}, '/', {rules.band('out - 2')}) as graph")
    out = sites.join(about.withColumnRenamed("cid", "site"), "site").withColumn("cid", F.col("site"))
    own = {"name": name, "cluster": "coalesce(cluster, 'other')", "graph": f"concat({rules.band('in_degree')}, '/', {rules.band('out - 1')})"}
    for lens in lenses:
        counts = peers.groupBy("anchor", "missing", lens).agg(F.count("*").alias("n"), F.min("cid").alias("first"))
        modal = counts.groupBy("anchor", "missing").agg(F.expr(f"min_by({lens}, struct(-n, first))").alias("__modal"))
        out = out.join(modal, ["anchor", "missing"], "left").where(f"__modal is null or {own[lens]} = __modal").drop("__modal")
    return out.select(*sites.columns)


def review(sites: DataFrame, suspects: DataFrame) -> DataFrame:
    """Findings at suspects (site) alone."""
    return sites.join(suspects.select("site").distinct(), "site", "left_semi")


def findings(sites: DataFrame, rules_: DataFrame, bags_: DataFrame, top: int = TOP) -> DataFrame:
    """The strongest findings with the first peers that conform: site, anchor, missing, together, callers, strength, peers."""
    best = sites.orderBy(F.desc(F.round("strength", 9)), "site", "anchor", "missing").limit(top)
    asked = best.select("anchor", "missing").distinct()
    ranked = conformers(rules_, bags_).join(F.broadcast(asked), ["anchor", "missing"]).selectExpr("*", "row_number() over (partition by anchor, missing order by cid) as rank").where(f"rank <= {PEERS}")  # at most ``top`` rows are sent
    peers = ranked.groupBy("anchor", "missing").agg(F.expr("transform(array_sort(collect_list(struct(rank, cid))), x -> x.cid)").alias("peers"))
    return best.join(peers, ["anchor", "missing"], "left").select("site", "anchor", "missing", "together", "callers", "strength", "peers")


def divergence_lines(found: DataFrame) -> DataFrame:
    """(turn, line) of findings grouped by site, sites by their strongest: a report of at most some dozen lines."""
    placed = found.selectExpr("*", "max(strength) over (partition by site) as most", "row_number() over (partition by site order by strength desc, anchor, missing) as k", "count(*) over (partition by site) as of_site")
    line = "concat('  ', site, ' — calls ', anchor, ' but not ', missing, ' (', together, '/', callers, ' peers do)  [strength ', format_number(strength, 1), ']')"
    lines = placed.selectExpr("most", "site", "k", f"{line} as line").unionByName(
        placed.where("k = 1 and size(peers) > 0").selectExpr("most", "site", "cast(of_site + 1 as int) as k", "concat('      e.g. siblings that conform: ', array_join(peers, ', ')) as line")
    )
    return lines.selectExpr("cast(row_number() over (order by most desc, site, k) as int) as turn", "line")
