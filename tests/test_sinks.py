import csv
import math

import pytest
from tickloom.sinks import files


def test_canonical_json_and_fingerprint():
    a, b = {"x": [1, math.nan, {"k": "é"}], "a": 1.5}, {"a": 1.5, "x": (1, math.inf, {"k": "é"})}
    assert files.canonical_json(a) == files.canonical_json(b) == '{"a":1.5,"x":[1,null,{"k":"é"}]}'.encode()
    assert files.fingerprint(a) == files.fingerprint(b) != files.fingerprint({})


def test_csv_cells(tmp_path):
    files.write_csv(tmp_path / "x.csv", [{"a": "=1+1", "b": -2.5}, {"b": float("nan"), "c": {"z": [1]}, "a": " @x"}, {"a": True, "c": None}])
    with (tmp_path / "x.csv").open(encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f)) == [["a", "b", "c"], ["'=1+1", "-2.5", ""], ["' @x", "", '{"z": [1]}'], ["true", "", ""]]


def test_publish_is_idempotent_and_guards_its_target(tmp_path):
    bundle = {"a.csv": [{"x": 1}], "b.json": {"k": 2}}
    one = files.publish(bundle, tmp_path, "run", "f" * 64)
    assert files.publish(bundle, tmp_path, "run", "f" * 64) == one and {p.name for p in one.iterdir()} == {"a.csv", "b.json", "SHA256SUMS"}
    with pytest.raises(FileExistsError):
        files.publish({"a.csv": []}, tmp_path, "run", "f" * 64)
    assert [p.name for p in tmp_path.iterdir()] == [one.name]


def test_table_hash_ignores_order_and_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as b", "cast(null as string) as c")
    h = files.table_hash(df)
    assert files.table_hash(df.orderBy("b").repartition(5)) == h != files.table_hash(df.limit(999))
    assert files.table_hash(df.unionByName(df.limit(2))) != h
