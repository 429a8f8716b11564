import random

import pytest
from pyspark.sql import functions as F

from descry import AnalysisError
from descry.functions import text
from descry.operators import compare
from descry.sources import delimited, heads, positions, tables


def write(folder, **files):
    for name, content in files.items():
        data = content if isinstance(content, bytes) else content.encode()
        (folder / f"{name}.csv").write_bytes(data)
    return str(folder)


@pytest.mark.parametrize(
    "payload,separator",
    [("﻿group,score\nA,1\n", ","), ("group;score\nA;1\n", ";"), ("group\tscore\nA\t1\n", "\t")],
)
def test_separators_and_bom(spark, tmp_path, payload, separator):
    scan = delimited.strict_scan(spark, write(tmp_path, a=payload), separator=separator)
    assert scan.typed().columns == ["group", "score"]
    assert tuple(scan.typed().head()) == ("A", 1)


def test_gb18030_and_decimal_comma(spark, tmp_path):
    path = write(tmp_path, a="组别;分数\n甲;1,5\n乙; 2\n".encode("gb18030"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        scan = delimited.strict_scan(spark, path, separator=";", encoding="GB18030", decimal=",")
        assert [tuple(r) for r in scan.typed().collect()] == [("甲", 1.5), ("乙", 2.0)]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


@pytest.mark.parametrize("payload", ["a,a\n1,2\n", "a,A\n1,2\n", "a, \n1,2\n", " , \n1,2\n", ""])
def test_bad_headers_are_rejected(spark, tmp_path, payload):
    with pytest.raises(AnalysisError):
        delimited.strict_scan(spark, write(tmp_path, a=payload))


def test_ragged_rows_fail_the_scan_or_are_marked(spark, tmp_path):
    path = write(tmp_path, a="a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        delimited.strict_scan(spark, path).text.collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        delimited.strict_scan(spark, path).text.select("a").collect()
    marked = delimited.strict_scan(spark, path, reject_ragged=False).text
    assert marked.where(F.col("_malformed").isNotNull()).cache().count() == 2


def test_na_is_a_value_and_only_blank_is_missing(spark, tmp_path):
    path = write(tmp_path, a='code,value\nNA,1\n,2\n"",3\n"x ""y"", z",4\n')
    rows = delimited.strict_scan(spark, path).typed().collect()
    assert [tuple(r) for r in rows] == [("NA", 1), (None, 2), (None, 3), ('x "y", z', 4)]
    rows = delimited.lenient_scan(spark, path).typed().collect()
    assert [r["code"] for r in rows] == [None, None, None, 'x "y", z']


def test_line_breaks_in_quotes_need_multiline(spark, tmp_path):
    path = write(tmp_path, a='a,b\n"one\ntwo",2\n')
    assert tuple(delimited.strict_scan(spark, path, multiline=True).typed().head()) == ("one\ntwo", 2)
    assert delimited.ragged_audit(spark, path).head()["open_quotes"] == 2


def test_type_inference(spark):
    rows = [("1", "1.5", "True", "1.0d", "inf", "9", None), (" 2", "1e3", "false", "2", "-inf", "x", None), (None, ".5", None, "3", "nan", "7", None)]
    df = spark.createDataFrame(rows, "i string, d string, b string, j string, inf string, mixed string, none string")
    got = {r["label"]: r["inferred_type"] for r in delimited.infer_text_types(df).collect()}
    assert got == {"i": "bigint", "d": "double", "b": "boolean", "j": "string", "inf": "double", "mixed": "string", "none": "string"}
    cast = delimited.cast_inferred(df)
    assert [r["i"] for r in cast.collect()] == [1, 2, None] and [r["b"] for r in cast.collect()] == [True, False, None]


def test_separator_audit(spark, tmp_path):
    path = write(
        tmp_path, comma="a,b\n1,2\n", semicolon="a;b;c\n1;2,5;3\n4;5,5;6\n", both="a;b,c;d\n1;2,3;4\n", tie="a;b,c\n1;2,3\n",
        one="a\n1\n", later="a,b\n" + "1,2\n" * 11 + "broken\n", uneven="a,b\n1\n", tab="a\tb\n\n1\t2\n", blank="\n  \n",
    )
    got = {r["file"].rsplit("/", 1)[1][:-4]: (r["separator"], r["verdict"]) for r in delimited.separator_audit(spark, path).collect()}
    assert got == {
        "comma": (",", "detected"), "semicolon": (";", "detected"), "both": (";", "detected"), "tie": (None, "ambiguous"),
        "one": (None, "ambiguous"), "later": (",", "detected"), "uneven": (None, "ambiguous"), "tab": ("\t", "detected"),
        "blank": (None, "empty"),
    }


def test_header_audit(spark, tmp_path):
    path = write(
        tmp_path, ok='﻿a,"b, c",d\n1,2,3\n', dup="a, A,b\n", blank="a, ,b\n", none=" , \n1,2\n", nul=b"a,b\n1,\x00\n",
        late_nul=b"a,b\n" + b"1,2\n" * 2000 + b"\x00,1\n", wide=",".join(f"c{i}" for i in range(251)) + "\n",
    )
    got = {r["file"].rsplit("/", 1)[1][:-4]: (r["columns"], r["verdict"]) for r in delimited.header_audit(spark, path).collect()}
    assert got == {
        "ok": (3, "ok"), "dup": (3, "duplicate_label"), "blank": (3, "blank_label"), "none": (2, "no_header"),
        "nul": (2, "binary"), "late_nul": (2, "ok"), "wide": (251, "too_many_columns"),
    }


def test_ragged_audit(spark, tmp_path):
    path = write(tmp_path, good='a,b\n1,"x,y"\n2,\n', bad="a,b\n1\n\n1,2,3\n1,2\n", tabs="a\tb\n1\t2\n")
    got = {r["file"].rsplit("/", 1)[1][:-4]: tuple(r)[1:5] for r in delimited.ragged_audit(spark, path).collect()}
    assert got["good"] == (2, 2, 0, 0) and got["bad"] == (2, 4, 3, 1)


def test_size_gate(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.lit(1))
    rows = {r["check"]: (r["actual"], r["passed"]) for r in tables.size_gate(df, max_rows=10, max_columns=1, max_cells=19).collect()}
    assert rows == {"rows": (10, True), "columns": (2, False), "cells": (20, False)}
    assert all(r["passed"] for r in tables.size_gate(df).collect())
    stored = spark.read.csv(write(tmp_path, a="x\n" * 8), header=True)
    rows = {r["check"]: (r["actual"], r["passed"]) for r in tables.size_gate(stored, max_bytes=10).collect()}
    assert rows["bytes"] == (16, False)


def test_trailing_blank_records(spark):
    rows = [(1, "a", 1.0), (2, None, None), (3, "", float("nan")), (4, "b", None), (5, "", None), (6, None, float("nan"))]
    df = spark.createDataFrame(rows, "i int, t string, x double").repartition(3)
    assert sorted(r["i"] for r in tables.trim_trailing_blank(df, "i").collect()) == [1, 2, 3, 4]
    assert tables.trim_trailing_blank(df.where("i > 4"), "i").count() == 0
    unordered = df.unionByName(df.where("i = 4").withColumn("i", F.lit(None).cast(df.schema["i"].dataType)))
    assert tables.trim_trailing_blank(unordered, "i").where("i IS NULL").count() == 1


def test_preview(spark):
    df = spark.range(50).selectExpr("50 - id as k").repartition(5)
    assert [r["k"] for r in tables.preview(df, ["k"]).collect()] == list(range(1, 21))
    assert tables.preview(df, rows=3).count() == 3


def test_files_must_share_their_header(spark, tmp_path):
    path = write(tmp_path, one="x,y\n1,2\n", two="y,x\n4,3\n")
    with pytest.raises(Exception, match="two|one"):
        delimited.strict_scan(spark, path).text.collect()


def test_blank_lines_are_refused(spark, tmp_path):
    path = write(tmp_path, one="x,y\n1,2\n\n3,4\n")
    with pytest.raises(AnalysisError, match="one"):
        delimited.strict_scan(spark, path)
    assert delimited.strict_scan(spark, path, reject_blank=False).text.count() == 2


def test_separator_is_found(spark, tmp_path):
    path = write(tmp_path, one="x;y\n1,5;2\n", two="x;y\n2,5;3\n", none="")
    assert delimited.strict_scan(spark, path, separator=None).text.count() == 2
    audit = {r["file"].rsplit("/", 1)[1].split(".")[0]: r["verdict"] for r in delimited.separator_audit(spark, path).collect()}
    assert audit == {"one": "detected", "two": "detected", "none": "empty"}
    audited = {r["file"].rsplit("/", 1)[1].split(".")[0]: (r["columns"], r["verdict"]) for r in delimited.header_audit(spark, path, separator=None).collect()}
    assert audited == {"one": (2, "ok"), "two": (2, "ok"), "none": (0, "empty")}


def test_encodings_that_spark_does_not_read(spark, tmp_path):
    path = write(tmp_path, a='组别;分数\n"甲;乙";1,5\n乙; 2\n'.encode("gb18030"))
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
    scan = delimited.strict_scan(spark, path, separator=";", encoding="GB18030", decimal=",")
    assert scan.labels == ["组别", "分数"] and [tuple(r) for r in scan.typed().collect()] == [("甲;乙", 1.5), ("乙", 2.0)]
    assert delimited.header_audit(spark, path, separator=";", encoding="gb18030").head()["verdict"] == "ok"
    assert delimited.ragged_audit(spark, path, separator=";", encoding="gb18030").head()["malformed"] == 0
    with pytest.raises(ValueError):
        heads.spark_encoding("cp037")


def test_only_heads_are_read(spark, tmp_path, monkeypatch):
    lines = [f"{i},{'x' * 50}" for i in range(60_000)]
    path = write(tmp_path, long="a,b\n" + "\n".join(lines), endless="z" * (3 << 20), old="a,b\r1,2\r\n3,4", none="", nul=b"a,\x00\n")
    got = {r["file"].rsplit("/", 1)[1].split(".")[0]: r for r in heads.first_lines(spark, path, 12).collect()}
    assert got["long"]["lines"] == ["a,b", *lines[:11]] and not got["long"]["cut"]
    assert got["endless"]["cut"] and len(got["endless"]["lines"][0]) == heads.LIMIT
    assert got["old"]["lines"] == ["a,b", "1,2", "3,4"] and got["none"]["lines"] == [] and got["nul"]["has_nul"]
    by_spark = {r["file"].rsplit("/", 1)[1].split(".")[0]: (r["lines"], r["has_nul"]) for r in heads.first_lines(spark, path, 12, by_spark=True).collect()}
    assert all(by_spark[name] == (got[name]["lines"], got[name]["has_nul"]) for name in ("long", "old", "none", "nul"))
    read = []

    class Counted:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.stream.close()

        def read(self, size):
            data = self.stream.read(size)
            read.append(len(data))
            return data

    opened = heads._opened
    monkeypatch.setattr(heads, "_opened", lambda uri: Counted(opened(uri)))
    heads._head(f"file:{path}/long.csv", 12, "UTF-8")
    assert sum(read) == heads.CHUNK
    heads._head(f"file:{path}/endless.csv", 12, "UTF-8")
    assert sum(read) <= heads.CHUNK + heads.LIMIT
    audit = {r["file"].rsplit("/", 1)[1].split(".")[0]: r["verdict"] for r in delimited.header_audit(spark, path).collect()}
    assert audit == {"long": "ok", "endless": "line_too_long", "old": "ok", "none": "empty", "nul": "binary"}


def test_case_folding_of_all_characters(spark):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    rows = [("".join(every[i : i + 1000]),) for i in range(0, len(every), 1000)] + [("Straße ΣΑΣ",), ("PLAIN",), (None,)]
    for value, folded in spark.createDataFrame(rows, "t string").select("t", text.fold(F.col("t"))).collect():
        assert folded == (None if value is None else value.casefold())


@pytest.mark.parametrize("size", ["100b", "3k", "128m"])
def test_rows_keep_the_order_of_their_files(spark, tmp_path, size):
    rows = [(f"g{i * 7919 % 1000 % 37}", float(i)) for i in range(2000)]
    seen = list(dict.fromkeys(g for g, _ in rows))
    (tmp_path / "csv").mkdir()
    write(tmp_path / "csv", one="g,x\n" + "".join(f"{g},{x}\n" for g, x in rows[:1200]), two="g,x\n" + "".join(f"{g},{x}\n" for g, x in rows[1200:]))
    for i, (a, b) in enumerate(((0, 700), (700, 2000))):
        spark.createDataFrame(rows[a:b], "g string, x double").coalesce(1).write.parquet(f"{tmp_path}/parquet/part{i}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        csv = delimited.strict_scan(spark, str(tmp_path / "csv")).typed()
        stored = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/parquet")
        for df in (csv, csv.where("x >= 0").withColumn("y", F.lit(1)), stored, stored.repartition(7)):
            found = compare.group_statistics(df, "x", "g").orderBy("first_seen").collect()
            assert [r["group"] for r in found] == seen
        assert positions.row_position(csv.repartition(3)) is None and positions.row_position(stored.union(stored)) is None
        assert positions.row_position(spark.range(3)) is None and compare.group_statistics(csv.repartition(3), "x", "g").head()["first_seen"] is None
        two = stored.where("g IN ('g36', 'g1')")
        found = compare.cohens_d(two, "x", "g").head()
        assert (found["group_1"], found["group_2"]) == tuple(g for g in seen if g in ("g36", "g1"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def plain_records(data, separator=","):
    """Fields of each record, counted character by character."""
    fields, counts, quoted, empty = 1, [], False, True
    for c in data.removesuffix("\n") + "\n":
        if c == '"':
            quoted = not quoted
        if c == "\n" and not quoted:
            counts.append(0 if empty else fields)
            fields, empty = 1, True
            continue
        fields += c == separator and not quoted
        empty = False
    return counts + ([fields] if quoted else []), quoted


@pytest.mark.parametrize("size", ["37b", "200b", "128m"])
def test_records_with_quoted_line_breaks(spark, tmp_path, size):
    rng = random.Random(11)
    cell = lambda: rng.choice(["1", "", '"a,b"', '"two\nlines"', '"\n\n,\n"', '"say ""so"",\nand go"', "plain"])
    files = {f"f{k}": "a,b,c\n" + "".join(rng.choice([",".join(cell() for _ in range(rng.choice([3, 3, 3, 2, 4]))), ""]) + "\n" for _ in range(60)) for k in range(4)}
    files["open"] = files["f0"] + 'x,"never closed,\n1,2\n3\n'
    files["none"] = "a,b,c\n1,2,3\n4,5\n"
    path = write(tmp_path, **files)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        found = {r["file"].rsplit("/", 1)[1][:-4]: tuple(r)[1:] for r in delimited.ragged_audit(spark, path, quoted_breaks=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, data in files.items():
        counts, quoted = plain_records(data)
        assert found[name] == (3, len(counts) - 1, sum(n != 3 for n in counts[1:]), counts.count(0), int(quoted)), name
