"""Summaries of growing folders, and result sets that are whole or absent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from descry.errors import AnalysisError
from descry.operators import profile
from descry.plans import incremental, sinks


@pytest.fixture
def folder(spark, tmp_path):
    def add(name, low, high):
        rows = spark.range(low, high).selectExpr("id", "CAST(id % 97 AS DOUBLE) / 7 AS x", "IF(id % 5 = 0, NULL, concat('label ', id % 1300)) AS label")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/data/{name}")

    add("a", 0, 4000)
    add("b", 4000, 9000)
    return tmp_path, add


def reader(spark, seen):
    def read(files):
        seen.append(sorted(files))
        return spark.read.parquet(*files)

    return read


def test_fingerprint_of_a_growing_folder(spark, folder):
    path, add = folder
    data, store, seen = f"{path}/data", f"{path}/store", []
    read = reader(spark, seen)

    def whole():
        return tuple(profile.dataset_fingerprint(spark.read.option("recursiveFileLookup", True).parquet(data), {"s": 1}).head())

    first = tuple(incremental.folder_fingerprint(spark, data, store, read, {"s": 1}).head())
    assert first == whole() and first[0] == 9000 and len(seen[0]) == 2
    seen.clear()
    assert tuple(incremental.folder_fingerprint(spark, data, store, read, {"s": 1}).head()) == first and all(len(files) == 1 for files in seen)
    add("c", 9000, 9500)
    seen.clear()
    state = incremental.update_folder(spark, data, store, read, incremental.file_hashes)
    assert (state.files_read, state.files_kept, state.files_removed) == (1, 2, 0) and "/data/c/" in seen[0][0] and len(seen) == 1
    assert tuple(incremental.folder_fingerprint(spark, data, store, read, {"s": 1}).head()) == whole() != first
    add("b", 100, 200)  # replaced: the old file is gone, a new one is there
    state = incremental.update_folder(spark, data, store, read, incremental.file_hashes)
    assert (state.files_read, state.files_kept, state.files_removed) == (1, 2, 1)
    assert tuple(incremental.folder_fingerprint(spark, data, store, read, {"s": 1}).head()) == whole()
    assert incremental.folder_fingerprint(spark, data, store, read, {"s": 2}).head()[1] != whole()[1]


def test_distinct_counts_of_a_growing_folder(spark, folder):
    path, add = folder
    read = reader(spark, seen := [])
    for _ in range(2):
        got = {r["variable"]: r for r in incremental.folder_distinct_counts(spark, f"{path}/data", f"{path}/store", read, ["id", "x", "label"]).collect()}
        exact = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/data").agg(
            *[F.count_distinct(c).alias(c) for c in ("id", "x", "label")], F.count("label").alias("n"), F.count("*").alias("rows")).head()
        for name in ("id", "x", "label"):
            assert abs(got[name]["unique_nonmissing"] - exact[name]) <= incremental.HLL_ERROR * exact[name] + 1
        assert (got["label"]["nonmissing"], got["label"]["missing"]) == (exact["n"], exact["rows"] - exact["n"])
        add("c", 9000, 40_000)
    assert len(seen) == 2 and len(seen[1]) == 1


def test_quantiles_of_a_growing_folder(spark, tmp_path):
    rng = np.random.default_rng(2)
    columns = {"skewed": rng.lognormal(0, 3, 30_000), "flat": np.full(30_000, 4.5), "ties": rng.integers(0, 5, 30_000).astype(float)}
    columns["skewed"][:20] = np.inf
    read, probabilities = reader(spark, []), [0.01, 0.25, 0.5, 0.9, 0.999]
    for part, (a, b) in enumerate([(0, 10_000), (10_000, 30_000)]):
        rows = spark.createDataFrame(list(zip(*[c[a:b].tolist() for c in columns.values()])), "skewed double, flat double, ties double")
        rows.coalesce(1).write.parquet(f"{tmp_path}/data/{part}")
        got = incremental.folder_quantiles(spark, f"{tmp_path}/data", f"{tmp_path}/store", read, list(columns), probabilities).collect()
        assert len(got) == 15
        for r in got:
            values = columns[r["variable"]][:b]
            values = values[np.isfinite(values)]
            low, high = (values < r["quantile"]).mean(), (values <= r["quantile"]).mean()
            assert r["n"] == len(values) and low - incremental.KLL_RANK_ERROR <= r["probability"] <= high + incremental.KLL_RANK_ERROR


def test_results_are_whole_or_absent(spark, tmp_path):
    store = str(tmp_path)
    sinks.write_results({"one": spark.range(3), "two": spark.range(5)}, store)
    broken = spark.range(4).select(F.raise_error(F.lit("killed")).cast("string").alias("id"))
    with pytest.raises(Exception, match="killed"):
        sinks.write_results({"one": spark.range(30), "two": broken}, store)
    assert {name: table.count() for name, table in sinks.read_results(spark, store).items()} == {"one": 3, "two": 5}
    sinks.write_results({"one": spark.range(7)}, store, format="json")
    assert {name: table.count() for name, table in sinks.read_results(spark, store).items()} == {"one": 7}
    with pytest.raises(AnalysisError):
        sinks.read_results(spark, str(tmp_path / "none"))
