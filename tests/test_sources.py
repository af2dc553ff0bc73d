from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from plumbline.sources import landing, readers, sinks


def test_file_kinds():
    assert [readers.file_kind(n) for n in (".CSV", "jsonl", "NDJSON ", "parquet")] == ["csv", "json", "json", "parquet"]
    with pytest.raises(ValueError):
        readers.file_kind("exe")


def test_csv_types_and_bad_cells(spark, tmp_path):
    path = tmp_path / "messy.csv"
    path.write_text("user_id,age,is_active\n1,25,yes\n2,thirty,1\n3,,true\n4,40,false\n")
    df = readers.read_table(spark, str(path), "csv")
    assert dict(df.dtypes) == {"user_id": "int", "age": "string", "is_active": "string"}
    assert df.filter("age IS NULL").count() == 1
    typed = readers.read_table(spark, str(path), "csv", schema="user_id int, age int, is_active string")
    assert [r["age"] for r in typed.orderBy("user_id").collect()] == [25, None, None, 40]


def test_json_forms(spark, tmp_path):
    rows = [{"id": 1, "product": "a", "details": {"color": "red", "size": 2}},
            {"id": 2, "product": "b", "details": {"color": "blue", "size": 3}}]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "line.json").write_text(json.dumps(rows))
    (tmp_path / "lines.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    for name in ("array.json", "line.json", "lines.jsonl"):
        df = readers.read_table(spark, str(tmp_path / name), "json")
        assert df.count() == 2 and dict(df.dtypes)["details"] == "struct<color:string,size:bigint>"
        assert df.select("details.color").filter("color = 'red'").count() == 1


def test_load_envelope(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4\n")
    row = readers.read_table(spark, str(tmp_path / "t.csv"), "csv", describe=True).first()
    assert (row["table_name"], row["row_count"], row["column_count"], row["columns"]) == ("t.csv", 2, 2, ["a", "b"])


def test_jdbc_options():
    o = readers.jdbc_options("jdbc:x", "t", "id", (1, 1000), 50)
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("id", "1", "1000", "50")
    assert "partitionColumn" not in readers.jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "t", "id")


def test_landing_catalog(spark, tmp_path):
    pq.write_table(pa.table({"a": list(range(37))}), tmp_path / "real.parquet")
    pq.write_table(pa.table({"a": [1, 2, 3]}), tmp_path / "lie.csv")
    (tmp_path / "good.csv").write_text("a,b\n1,2\n3,4\n5,6")
    (tmp_path / "array.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "dict.json").write_text('{"meta": 1, "rows": [1, 2, 3, 4]}')
    (tmp_path / "single.json").write_text('{"a": 1,\n "b": 2}')
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    (tmp_path / "image.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR")
    (tmp_path / "binary.csv").write_bytes(b"a,b\x00\x01\x02")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "big.csv").write_text("a\n" + "1\n" * 5000)
    (tmp_path / "latin.csv").write_bytes("name\nJos\xe9\n".encode("latin-1"))
    catalog = landing.admit_files(landing.catalog_files(spark, str(tmp_path), max_bytes=5000), max_bytes=5000)
    rows = {r["file_name"]: r for r in catalog.collect()}
    seen = {n: (r["kind"], r["row_estimate"], r["extension_lies"], r["reason"]) for n, r in rows.items()}
    assert seen["real.parquet"] == ("parquet", 37, False, None)
    assert seen["lie.csv"] == ("parquet", 3, True, None)
    assert seen["good.csv"] == ("csv", 3, False, None)
    assert seen["array.json"] == ("json", 2, False, None)
    assert seen["dict.json"] == ("json", 4, False, None)
    assert seen["single.json"][:2] == ("json", 2)  # several lines: counted as lines
    assert seen["lines.jsonl"] == ("json", 3, False, None)
    assert seen["image.png"][3] == "unsupported content" and seen["binary.csv"][3] == "unsupported content"
    assert seen["empty.csv"][3] == "empty file"
    assert seen["big.csv"][3] == "file too large"
    assert seen["latin.csv"][:2] == ("csv", 1)


def test_records_keep_nulls(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, TIMESTAMP_NTZ '2024-01-02 03:04:05.678' AS t")
    assert json.loads(sinks.to_records(df).first()["record"]) == {"a": 1, "b": None, "t": "2024-01-02T03:04:05.678"}


def test_result_path(spark, tmp_path):
    path = sinks.store_result(spark.range(3), str(tmp_path), "q_001")
    assert path.endswith("/result_q_001.parquet") and spark.read.parquet(path).count() == 3
