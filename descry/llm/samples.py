"""Bounded samples of documents for training, chosen by a hash of doc_id: ids first, then the texts of these alone."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_HALF = 1 << 63


def hashed_ids(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """(doc_id, rank): the ``limit`` distinct doc_ids with the smallest hash, fewer if there are fewer; null ids are left out.

    Rows are counted first. Only those under a bound on the hash, which ``limit`` of them hardly ever miss, are
    brought together, so that what comes from a task does not grow with the number of tasks.
    """
    known = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    known = known.select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("rank"))
    share = (limit + 10 * sqrt(limit) + 10) / max(1, known.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]) * 1.1
    bound = _HALF - 1 if share >= 1 else int(-_HALF + share * 2 * _HALF)
    return known.where(F.col("rank") <= bound).distinct().orderBy("rank", "doc_id").limit(limit)


def texts_of(docs: DataFrame, ids: DataFrame, characters: int, *columns: str) -> DataFrame:
    """The columns of ``docs`` and ``ids`` for the documents in ``ids`` (doc_id, rank and others; a bounded table), in the
    order of rank, as long as all texts together have at most ``characters`` characters. Texts are scanned once.

    Of several rows with one doc_id the smallest text counts; null counts as empty.
    """
    extra = [c for c in ids.columns if c != "doc_id"]
    mine = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *columns)
    found = mine.join(F.broadcast(ids), "doc_id").groupBy("doc_id", *extra).agg(F.min(F.struct("text", *columns)).alias("row"))
    found = found.select("doc_id", *extra, "row.*")
    total = F.sum(F.length("text")).over(W.orderBy("rank", "doc_id", *[c for c in extra if c != "rank"]).rowsBetween(W.unboundedPreceding, 0))
    return found.withColumn("__total", total).where(F.col("__total") <= characters).drop("__total").orderBy("rank", "doc_id")
