import glob
import json
import os

import fixture_pages as fx
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators import leads, lists, runlog
from pageloom.functions.base import checked_limit
from pageloom.sources import captured
from pageloom.sources import export as sink


def _csv(path):
    return "".join(open(p, encoding="utf-8", newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_table_to_csv(spark, tmp_path):
    rows = lists.extract_items(fx.pages_df(spark, [8]), "table tbody tr")
    wide = sink.widen(rows, "keys", "values", ["page_id", "item_idx"]).drop("page_id", "item_idx")
    path = str(tmp_path / "prices.csv")
    receipt = sink.export(wide.coalesce(1), path)
    content = _csv(path)
    assert content.startswith("﻿Steg,Länge,Tiefe,Saison\n")
    assert 'Nord,9 m,"2,1 m",£840.00' in content and '"£1,410.50"' in content
    assert (receipt.records, receipt.format, receipt.columns) == (2, "csv", ["Steg", "Länge", "Tiefe", "Saison"])
    assert receipt.bytes == sum(os.path.getsize(p) for p in glob.glob(f"{path}/part-*"))


def test_generic_header(spark, tmp_path):
    rows = lists.extract_items(fx.pages_df(spark, [3]), "li.product").select(*lists.GENERIC)
    path = str(tmp_path / "x.csv")
    assert sink.export(sink.for_csv(rows), path, bom=False).columns == [
        "title", "price", "priceValue", "currency", "link", "image", "text",
    ]
    assert _csv(path).startswith("title,price,priceValue")


def test_flatten(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('c', 'x', 'd', named_struct('e', 2.50D)) AS b, array(1, null) AS d, CAST(null AS STRING) AS e, 1e9D AS f, true AS g")
    assert sink.flatten(df).first().asDict() == {"a": "1", "b.c": "x", "b.d.e": "2.5", "d": "1; null", "e": "", "f": "1000000000", "g": "true"}


def test_unwrap(spark):
    payloads = ['{"items":[{"a":1}]}', '"plain"', "[1,{\"b\":2}]", '{"items":[],"emails":["x"]}', '{"z":1}', "null"]
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, p string")
    got = [(r.i, json.loads(r.record)) for r in sink.unwrap(df, "p", ["i"]).orderBy("i", "row_no").collect()]
    assert got == [(0, {"a": 1}), (1, {"value": "plain"}), (2, {"value": 1}), (2, {"b": 2}), (3, {"value": "x"}), (4, {"z": 1}), (5, {"value": None})]


def test_unwrap_typed(spark):
    df = spark.sql("SELECT array(named_struct('a', 1)) AS rows, 'x' AS note")
    assert sink.unwrap_typed(df).columns == ["a"]
    assert sink.unwrap_typed(spark.sql("SELECT array('m') AS emails")).columns == ["value"]
    assert sink.unwrap_typed(spark.sql("SELECT 1 AS k")).columns == ["k"]


def test_ragged_records(spark):
    df = spark.createDataFrame([(1, '{"ad":"x","puan":1}'), (2, '{"ad":"y","puan":2.5,"not":{"k":"v"}}')], "i int, r string")
    table = sink.records_table(df, "r", ["i"])
    assert table.columns == ["i", "ad", "puan", "not.k"]
    assert [tuple(r) for r in table.orderBy("i").collect()] == [(1, "x", "1", ""), (2, "y", "2.5", "v")]


def test_ragged_names(spark):
    rows = [(1, '{"AVOID":1,"VOID":null,"OBJECT":{"VOID":[{"a b":2}]}}'), (2, '{"AVOID":2.5,"x":[null]}')]
    table = sink.records_table(spark.createDataFrame(rows, "i int, r string"), "r", ["i"])
    got = [r.asDict() for r in table.orderBy("i").collect()]
    assert [g["AVOID"] for g in got] == ["1", "2.5"] and got[0]["OBJECT.VOID"] == '{"a b":2}'


def test_numbers(spark):
    cases = {1.2345678901234567e-5: "0.000012345678901234568", 1e20: "100000000000000000000", 1.5e21: "1.5e+21", 1e-7: "1e-7", -2.5e-6: "-0.0000025", 0.0: "0", 12345678.5: "12345678.5", 1.0: "1", 123456789012345680.0: "123456789012345680", 0.1: "0.1"}
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(cases)], "i int, x double")
    assert [r.x for r in sink.flatten(df).orderBy(F.col("i").cast("int")).collect()] == list(cases.values())


def test_unwrap_rows_choose(spark):
    df = spark.createDataFrame([([], ["b"]), (["a"], ["c"])], "items array<string>, rows array<string>")
    assert sorted(r.value for r in sink.unwrap_typed(df).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        sink.unwrap_typed(spark.sql("SELECT array(1) AS items, array('x') AS rows"))


def test_field_names(spark):
    fields = {"price.value": {"selector": ".price"}, "a`b": {"selector": "a", "attr": "href"}}
    html = '<div class=i><a href=/x>x</a><b class=price>2,00 TL</b></div>'
    df = spark.createDataFrame([(1, "https://a.test/", html)], "page_id long, url string, html string")
    row = lists.extract_items(df, ".i", fields).first().asDict()
    assert (row["price.value"], row["a`b"]) == ("2,00 TL", "https://a.test/x")
    with pytest.raises(ValueError):
        lists.extract_items(df, ".i", {"page_id": {"selector": "a"}})


def test_formats(spark, tmp_path):
    assert [sink.format_of(p) for p in ("a.csv", "b.JSON", "c", "d.txt")] == ["csv", "json", "json", "json"]
    path = str(tmp_path / "out")
    sink.export(spark.sql("SELECT 1 AS a, CAST(null AS INT) AS b"), path)
    assert json.loads(_csv(path)) == {"a": 1, "b": None}
    with pytest.raises(ValueError):
        sink.export(spark.range(1), str(tmp_path / "z"), "xml")
    with pytest.raises(ValueError, match="no rows"):
        sink.export(spark.range(0), str(tmp_path / "e.csv"))


def test_datasets(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("known_rows")
    assert sink.export_dataset(spark, "known_rows", str(tmp_path / "k.json")).records == 3
    with pytest.raises(ValueError, match="known_rows"):
        sink.export_dataset(spark, "unknown_rows", str(tmp_path / "u.json"))


def test_image_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x" * 10)
    (tmp_path / "b.txt").write_bytes(b"y")
    rows = captured.read_image_files(spark, str(tmp_path), "https://a.test/").orderBy("url").collect()
    assert [(r.url, r.content_type, len(r.content)) for r in rows] == [
        ("https://a.test/a.png", "image/png", 10), ("https://a.test/b.txt", "application/octet-stream", 1),
    ]


def test_run_log(spark):
    rows = [("1", "list", "u", "done", "2024-01-01 00:00:00", "2024-01-01 00:00:01.5", None, {"items": 3}), ("2", "nope", "u", "done", None, None, None, None)]
    df = spark.createDataFrame(rows, "run_id string, type string, url string, status string, started_at string, finished_at string, error string, counts map<string,bigint>")
    log = runlog.runs(df)
    assert [(r.run_id, r.duration_ms) for r in runlog.recent(log).collect()] == [("1", 1500)]
    assert log.schema == runlog.RUN_LOG


def test_run_log_on_disk(spark, tmp_path):
    rows = [("1", "list", "u", "done", "2024-01-01 00:00:00", "2024-01-01 00:00:02", None, {"items": 3}), ("2", "text", "v", "error", None, None, "x", None)]
    df = spark.createDataFrame(rows, "run_id string, type string, url string, status string, started_at string, finished_at string, error string, counts map<string,bigint>")
    runlog.append_runs(df, str(tmp_path / "log"))
    log = runlog.read_runs(spark, str(tmp_path / "log"))
    assert log.count() == 2 and [(d.dataset_id, d.tool, d.url, d.counts) for d in runlog.datasets(log).collect()] == [("1", "list", "u", {"items": 3})]


def test_masking(spark):
    rows = leads.page_leads(fx.pages_df(spark, [2]))
    assert not [r for r in leads.masked(rows).collect() if "@" in r.value]


def test_bounds():
    assert checked_limit(None, "n") is None and checked_limit(99, "n") == 99
    with pytest.raises(ValueError):
        checked_limit(0, "n")
