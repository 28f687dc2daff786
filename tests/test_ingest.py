"""Reading, cleaning, typing and merging on the literal fixtures."""

from __future__ import annotations

import pytest

from tidegauge.functions.columns import Roles, is_technical
from tidegauge.operators.clean import clean, find_key, number_rows
from tidegauge.operators.ingest import ingest, load_source
from tidegauge.operators.merge import merge
from tidegauge.operators.pivot import PivotRequest, run_pivot
from tidegauge.operators.typing import cast_types, semantic_types
from tidegauge.sources import store
from tidegauge.sources.delimited import read_delimited, read_report, read_saved_text, sniff

IN_CSV = (
    "Unnamed: 0,Condition,Owner,Size,Type,Quality,week\n11,N,7,2,BOX,G1,9\n12,N,7,2,BOX,G2,9\n"
    "13,U,8,2,BOX,G1,9\n14,N,8,1,TANK,G3,9\n15,U,7,1,TANK,G3,9\n"
)
OUT_CSV = (
    "Unnamed: 0,Owner,Size,Type,Quality,DaysInDeposit,week\n11,7,2,BOX,G1,17,9\n12,7,2,BOX,G2,3,9\n"
    "13,8,2,BOX,G1,41,9\n14,8,1,TANK,G3,22,9\n15,7,1,TANK,G3,8,9\n"
)


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


def codes(df):
    return {r["code"] for r in df.collect()}


def test_sniff_latin1_semicolon(spark, tmp_path):
    path = put(tmp_path, "a.csv", "Unnamed: 0;Owner;Type\n41;Señal;K\n42;Q;L\n".encode("latin-1"))
    form = sniff(spark, path)
    assert (form.encoding, form.separator) == ("latin-1", ";")
    df = read_delimited(spark, path, form)
    assert [r["Owner"] for r in df.collect()] == ["Señal", "Q"]
    report = read_report(df, path, form).first()
    assert (report["n_rows"], report["n_columns"], report["filename"]) == (2, 3, "a.csv")


def test_reader_rules(spark, tmp_path):
    path = put(tmp_path, "b.csv", '﻿  Unnamed: 0 ; Owner  ;Type;Type\n1;"a;b";X\n2;NA;Y;Z\n3;c;d;e;f\n')
    df = read_delimited(spark, path)
    cleaned, dropped, _ = clean(df, "in_file")
    assert cleaned.columns == ["Unnamed: 0", "Owner", "Type", "Type.1"] and dropped == []
    rows = [tuple(r) for r in cleaned.orderBy("Unnamed: 0").collect()]
    assert rows == [("1", "a;b", "X", None), ("2", None, "Y", "Z")]


def test_reader_rejects_unusable(spark, tmp_path):
    with pytest.raises(ValueError):
        sniff(spark, put(tmp_path, "c.csv", "only\n"))
    with pytest.raises(ValueError):
        sniff(spark, put(tmp_path, "d.csv", ""))


def test_key_rules(spark):
    named = spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string")
    assert find_key(named) == "id"
    unique = spark.createDataFrame([(i % 3, f"u{i}") for i in range(30)], "g int, code string")
    assert find_key(unique) == "code"
    nothing = spark.createDataFrame([(i % 3, i % 5, None) for i in range(30)], "g int, h int, e string")
    cleaned, dropped, notes = clean(nothing, "in_file")
    assert dropped == ["e"] and codes(notes) == {"index_inferred"}
    ids = sorted(r["Unnamed: 0"] for r in number_rows(nothing.repartition(4), "Unnamed: 0").collect())
    assert ids == list(range(30))
    assert is_technical(" Unnamed: 0 ") and is_technical("Row_ID") and not is_technical("id")


def test_typing_discrete_and_continuous(spark):
    discrete = spark.createDataFrame([(str(i), str(1 + i % 2)) for i in range(12)], "`Unnamed: 0` string, Size string")
    typed, notes = cast_types(discrete, "out_file")
    kinds = {r["column"]: r["semantic_type"] for r in semantic_types(typed).collect()}
    assert kinds["Size"] == "categorical_discrete" and codes(notes) == {"size_casted_to_categorical_discrete"}
    assert {r["Size"] for r in typed.collect()} == {"1", "2"}
    wide = spark.createDataFrame([(str(i), f"{10 + i}.0") for i in range(20)], "`Unnamed: 0` string, Size string")
    typed, notes = cast_types(wide, "out_file")
    assert dict(typed.dtypes)["Size"] == "double" and notes.count() == 0
    text = spark.createDataFrame([("1", "big"), ("2", "3"), ("3", " nan "), ("4", "10d")], "`Unnamed: 0` string, Size string")
    typed, notes = cast_types(text, "in_file")
    assert codes(notes) == {"size_casted_to_categorical"}
    assert {r["Size"] for r in typed.collect()} == {"big", "3", None, "10d"}


def test_merge_fixture(spark):
    left = spark.createDataFrame([("p4", "K", "u"), ("p7", "L", "v"), ("p9", "M", "w"), ("p5", "K", "w")], "`Unnamed: 0` string, Owner string, Type string")
    right = spark.createDataFrame([("p7", "L", 3.0), ("p9", "M", 31.0), ("q1", "N", 4.5)], "`Unnamed: 0` string, Owner string, DaysInDeposit double")
    merged = merge(left, right)
    assert merged.table.columns == ["Unnamed: 0", "Type", "DaysInDeposit", "Owner"]
    assert sorted(r["Unnamed: 0"] for r in merged.table.collect()) == ["p7", "p9"]
    report = merged.report.first()
    assert (report["merged_rows"], report["unmatched_in_rows"], report["unmatched_out_rows"]) == (2, 2, 1)
    differing = right.replace("L", "Q", "Owner")
    assert merge(left, differing).table.columns == ["Unnamed: 0", "Owner_in", "Type", "Owner_out", "DaysInDeposit"]
    alone = merge(left, None)
    assert alone.report.first()["mode"] == "passthrough" and alone.table.count() == 4
    with pytest.raises(ValueError):
        merge(None, None)


def test_ingest_end_to_end(spark, tmp_path):
    paths = put(tmp_path, "in.csv", IN_CSV), put(tmp_path, "out.csv", OUT_CSV)
    flow = ingest(spark, *paths)
    assert flow.merged.columns == ["Unnamed: 0", "Condition", "DaysInDeposit", "Owner", "Size", "Type", "Quality", "week"]
    assert flow.merged.count() == 5
    assert codes(flow.warnings) == {"size_casted_to_categorical_discrete"}
    request = PivotRequest("Owner", "Quality", "Size", "sum", source="in")
    matrix = {(r["level"], r["row_key"]): r["value"] for r in run_pivot(flow.in_df, request).collect()}
    assert matrix[("grand_total", None)] == 8.0 and matrix[("row_total", "7")] == 5.0
    only_out = ingest(spark, None, paths[1])
    assert only_out.metadata["merge"].first()["mode"] == "passthrough"
    typed, _ = load_source(spark, paths[1], "out")
    assert dict(typed.dtypes)["DaysInDeposit"] == "double"
    with pytest.raises(ValueError):
        load_source(spark, paths[1], "other")


def test_missing_expected_columns(spark, tmp_path):
    path = put(tmp_path, "in.csv", "Unnamed: 0,Owner\n1,A\n2,\n")
    flow = ingest(spark, path)
    assert codes(flow.warnings) == {"missing_expected_columns_in", "missing_values_detected"}


def test_store_round_trips(spark, tmp_path):
    flow = ingest(spark, put(tmp_path, "in.csv", IN_CSV), put(tmp_path, "out.csv", OUT_CSV))
    store.save_dataset(flow.merged, str(tmp_path / "ds"), {"name": "w1"}, period="week")
    table, metadata = store.load_dataset(spark, str(tmp_path / "ds"))
    assert table.columns == flow.merged.columns and metadata["name"] == "w1"
    store.save_text(flow.merged, str(tmp_path / "text"))
    again = read_saved_text(spark, str(tmp_path / "text"), metadata["dtypes"])
    assert dict(again.dtypes)["DaysInDeposit"] == "double" and dict(again.dtypes)["Owner"] == "string"
    assert sorted(map(str, again.collect())) == sorted(map(str, flow.merged.select(*again.columns).collect()))
    assert [r["Unnamed: 0"] for r in store.preview(table, "Unnamed: 0", 2).collect()] == ["11", "12"]
    with pytest.raises(ValueError):
        store.preview(table, "Unnamed: 0", 0)
    described = {r["column"]: r for r in store.descriptor(flow.merged, Roles().target).collect()}
    assert described["DaysInDeposit"]["is_target"] and described["Owner"]["n_rows"] == 5
