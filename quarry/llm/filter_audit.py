"""What five quality filters remove together: a histogram of failure masks instead of 120 runs.

A document fails a set of filters, whatever order they are applied in, so each one becomes a mask of five
bits, built by native expressions; the fifth bit (an identical text of a smaller doc_id exists) comes from
the least doc_id of each text's digest.  Masks are counted into 32 cells for each part.  An order removes
a document at the first filter that it fails, so what a step keeps and removes follows from the cells, the
step's filter and the set of filters before it: 80 cases, each of which stands for the steps of all orders
that share it.

The least doc_id of a text is aggregated before the shuffle and joined by (text, doc_id), so a text that a
third of all documents share is no hot key; counts of cells are pre-aggregated, so a hot part is none either.

Defined results: a null text is empty (it fails A alone, and E if a smaller doc_id's text is empty too); a
null source is the part ''; a text of any length is counted whole; rows without a doc_id have no labels, never
fail E and make no other row fail it; rows that share the least doc_id of their text all pass E; repeated rows
count each; a doc_id is good (toxic) if any of its labels says so, and labels without a doc_id are ignored; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scratch import joined, staged

FILTERS = "ABCDE"
#: Labelled documents up to which their table is sent to all executors.
MOST_SENT = 300_000
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of every document; the mask has the bits of A to D."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("coalesce(cast(source as string), '')").alias("part"), F.expr("coalesce(text, '')").alias("text"))
    rows = rows.withColumn("words", F.expr(r"array_remove(split(text, '[\\x20\\x09-\\x0D]+'), '')")).withColumn("n", F.expr("cast(size(words) as bigint)"))
    fails = [
        "n < 200",
        "100 * cast(size(array_distinct(words)) as bigint) < 50 * n",
        "100L * length(regexp_replace(text, '[^A-Z]+', '')) > 2L * length(text)",
        "text rlike '[#$%&*|]'",
    ]
    mask = " + ".join(f"if({f}, {1 << k}, 0)" for k, f in enumerate(fails))
    return rows.selectExpr("doc_id", "part", f"{mask} as mask", "unhex(sha2(text, 256)) as digest")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part and set of failed filters."""
    rows = staged(masks(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "audit-masks")
    named = rows.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.expr("coalesce(bool_or(quality = 1), false)").alias("good"), F.expr("coalesce(bool_or(toxic = 1), false)").alias("toxic"))
    marked = named.join(first, ["digest", "doc_id"], "left").selectExpr("doc_id", "part", f"mask + if(first is null, {1 << 4}, 0) as mask", "n")
    marked = joined(marked.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")), staged(known, "audit-labels"), ["doc_id"], "left", MOST_SENT)
    nameless = rows.where("doc_id is null").selectExpr("part", "mask", "n", "false as good", "false as toxic")
    every = marked.select("part", "mask", "n", "good", "toxic").unionByName(nameless)
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.expr("if(good, n, 0L)")).alias("good"), F.sum(F.expr("if(toxic, n, 0L)")).alias("toxic"))


def _orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit, before): all steps of all orders, with the mask of the filters before each."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def interactions(counted: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the cells (part, mask, n, good, toxic)."""
    bits = ", ".join(str(1 << k) for k in range(len(FILTERS)))
    cases = counted.selectExpr("*", f"explode(array({bits})) as bit").selectExpr("*", f"explode(filter(sequence(0, {(1 << len(FILTERS)) - 1}), b -> b & bit = 0)) as before")
    fails, passed = "mask & bit <> 0", "mask & before = 0"
    total = lambda when, what="n": F.sum(F.expr(f"if({when}, {what}, 0L)"))
    sums = cases.groupBy("part", "bit", "before").agg(
        total(f"{passed} and mask & bit = 0").alias("kept"),
        total(f"{passed} and {fails}").alias("removed"),
        total(f"not ({passed}) and {fails}").alias("redundant"),
        total("mask = bit").alias("unique_fails"),
        total(f"{passed} and {fails}", "good").alias("good_lost"),
        total(f"{passed} and {fails}", "toxic").alias("toxic_lost"),
        # of the orders, an equal share begins with each of the filters that a document fails
        total(fails, "n * (120L div bit_count(mask))").alias("shapley"),
    )
    orders = counted.sparkSession.createDataFrame(_orders(), "filter_order string, step int, bit int, before int")  # 600 rows, always
    return sums.join(F.broadcast(orders), ["bit", "before"]).select(*(f.split()[0] for f in RESULT.split(", ")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns of RESULT, 600 rows for each part of ``docs`` (doc_id, text, source)."""
    return interactions(staged(cells(docs, labels), "audit-cells"))
