"""What filters remove in every order of applying them: an audit of their interactions, per part of a corpus.

Each document gets a mask of the filters that it fails. Documents with equal part, mask and labels collapse to cells with
counts, at most 2^filters for each part and pair of labels. Every cell then folds over the constant array of all orders
with the higher-order functions ``transform`` and ``aggregate``, which gives a weighted struct for each step of each order;
the structs of a part's cells are merged by elementwise sums. Only built-in functions are used.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from descry.llm.common import SPACE, written

#: Filters by letter, in the order of the bits of a mask; the last is the one that looks at other documents.
FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: str = "text") -> Column:
    """Bits of the filters A to D that a text fails; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(whole, "[^A-Z]+", ""))
    fails = [n < FEWEST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(whole), whole.rlike(SYMBOLS)]
    return sum((F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate(fails)), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail these filters and have these labels.

    Copies are found by the SHA-256 of whole texts. Of the documents with one text those with the smallest doc_id pass the
    last filter; so does a null doc_id, which is neither smaller nor larger than another. A document is good or toxic if any
    of its labels says so; one without labels, or with a null doc_id, is neither.
    """
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    facts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), digest.alias("digest"), text_mask().alias("mask")), "facts")
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    false = F.lit(False)
    named = facts.where("doc_id IS NOT NULL").join(known, "doc_id", "left").fillna({"good": False, "toxic": False})
    key = ["digest", "part", "mask", "good", "toxic"]
    # Copies collapse in every task: a text that a third of all documents share is a few rows from here on.
    rows = named.groupBy("doc_id", *key).agg(F.count("*").alias("n"))
    cells = rows.groupBy(*key).agg(F.min(F.struct("doc_id", "n")).alias("first"), F.sum("n").alias("n"))
    least = cells.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    cells = cells.join(least, "digest")
    passes = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask"), passes.alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - passes).alias("n"))))
    counted = cells.select("part", "good", "toxic", split.alias("s")).select("part", "s.mask", "good", "toxic", "s.n")
    unnamed = facts.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", false.alias("good"), false.alias("toxic"), "n")
    return counted.where("n > 0").unionByName(unnamed).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _has(mask: Column, number: Column) -> Column:
    return F.call_function("bit_get", mask, number) == 1


def _folded(orders: Column) -> Column:
    """The structs of one cell (columns mask, n, n_good, n_toxic), order by order and step by step."""
    mask = F.col("mask")

    def step(state: Column, number: Column) -> Column:
        failed, alive, n = _has(mask, number), state["alive"], F.col("n")

        def measure(holds: Column, weight: str = "n") -> Column:
            return F.when(holds, F.col(weight)).otherwise(F.lit(0)).cast("long")

        removed = alive & failed
        row = F.struct(measure(alive & ~failed).alias("kept"), measure(removed).alias("removed"), measure(~alive & failed).alias("redundant"),
                       F.when(mask == F.call_function("shiftleft", F.lit(1), number), n).otherwise(F.lit(0)).cast("long").alias("unique_fails"),
                       measure(removed, "n_good").alias("good_lost"), measure(removed, "n_toxic").alias("toxic_lost"))
        return F.struct((alive & ~failed).alias("alive"), F.concat(state["rows"], F.array(row)).alias("rows"))

    kind = "array<struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">>"
    start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("rows"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["rows"])))


def _summed(cells: Column, size: int) -> Column:
    zero = F.struct(*[F.lit(0).cast("long").alias(m) for m in MEASURES])
    return F.aggregate(cells, F.array_repeat(zero, size), lambda sums, cell: F.zip_with(
        sums, cell, lambda a, b: F.struct(*[(a[m] + b[m]).alias(m) for m in MEASURES])))


def audit_orders(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley; see the module and ``mask_counts``.

    A part is a value of ``source``, null being the empty one. An empty table has no parts. Whole texts are looked at;
    columns other than doc_id, text, source and the labels' doc_id, quality, toxic are ignored. Repeated rows count each time.
    """
    names = ["".join(order) for order in permutations(FILTERS)]
    orders = F.array(*[F.array(*[F.lit(FILTERS.index(f)) for f in name]) for name in names])
    steps = len(FILTERS)
    weighed = mask_counts(docs, labels).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"))
    folded = weighed.select("part", _folded(orders).alias("cell"))
    merged = folded.groupBy("part").agg(_summed(F.collect_list("cell"), len(names) * steps).alias("sums"))  # at most 2^filters cells
    rows = merged.select("part", F.posexplode("sums").alias("at", "row"))
    order, step = F.floor(F.col("at") / steps).cast("int"), (F.col("at") % steps).cast("int")
    rows = rows.select("part", F.get(F.array(*map(F.lit, names)), order).alias("filter_order"), (step + 1).alias("step"), *[F.col("row")[m].alias(m) for m in MEASURES])
    filtered = W.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # each filter once in every order
    return rows.withColumn("shapley", F.sum("removed").over(filtered))
