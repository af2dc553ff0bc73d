"""Files read in ranges of a few bytes must give what reading them whole gives."""

from __future__ import annotations

import csv
import json
import random
import tracemalloc

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from plumbline.sources import byte_ranges, landing, readers

R = random.Random(3)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    deep = [{"a": R.choice(['x"y', "back\\slash", "\\\\\"", "[,{", "é,\n"]), "b": [1, {"c": [2, 3]}], "d": {}} for _ in range(23)]
    (folder / "array.json").write_text(json.dumps(deep))
    (folder / "array_indented.json").write_text(" \n" + json.dumps(deep, indent=2))
    (folder / "lines.json").write_text("\n".join(json.dumps(d) for d in deep) + "\n\n  \n")
    (folder / "one.json").write_text(json.dumps({"a": "[", "b": {"c": None}}))
    (folder / "broken.json").write_text("[1, 2, {\n")
    (folder / "brackets.csv").write_text("[a],[b]\n[1],[2]\n")
    (folder / "plain.csv").write_text("a,b\n" + "".join(f"{i},x\n" for i in range(30)))
    (folder / "no_end.csv").write_text("a,b\n1,2\n\n3,4")
    (folder / "blank.csv").write_text(" \n\t\n")
    (folder / "zero.csv").write_bytes(b"a,b\x00\n1,2\n")
    (folder / "image.csv").write_bytes(b"PK\x03\x04 no archive\x00 at all\n")
    pq.write_table(pa.table({"a": list(range(37))}), folder / "real.csv")
    return folder


@pytest.mark.parametrize("range_bytes", [50, 1 << 20])
def test_large_files_are_typed_and_counted_like_small_ones(spark, files, range_bytes):
    whole = {r["file_name"]: (r["kind"], r["row_estimate"]) for r in landing.catalog_files(spark, str(files)).collect()}
    cut = landing.catalog_files(spark, str(files), max_bytes=0, range_bytes=range_bytes)
    assert {r["file_name"]: (r["kind"], r["row_estimate"]) for r in cut.collect()} == whole
    assert whole["array.json"] == ("json", 23) and whole["real.csv"] == ("parquet", 37) and whole["brackets.csv"][0] == "csv"
    assert whole["lines.json"] == ("json", 23) and whole["plain.csv"] == ("csv", 30)
    assert cut.filter("kind = 'json'").count() == 4
    refused = {r["reason"] for r in landing.admit_files(cut, max_bytes=0).collect()}
    assert refused == {"file too large"}


@pytest.fixture(scope="module")
def quoted(tmp_path_factory):
    folder = tmp_path_factory.mktemp("quoted")
    rows = []
    for i in range(60):
        text = "".join(R.choice(['"', "\n", ",", "é", "a", " b", "\\"]) for _ in range(R.randint(0, 12)))
        rows.append([i, "x" + text + "y", R.choice(["1.5", "", "7"])])
    rows.append([60, "long " + "line\n" * 60, "2"])
    for name, part in (("a.csv", rows[:40]), ("b.csv", rows[40:])):
        with open(folder / name, "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\r\n" if name == "b.csv" else "\n")
            writer.writerow(["id", "some text", "n"])
            writer.writerows(part)
    return folder, rows


@pytest.mark.parametrize("range_bytes", [60, 1 << 20])
def test_quoted_csv_in_ranges(spark, quoted, range_bytes):
    folder, rows = quoted
    df = readers.read_table(spark, str(folder), "csv", multi_line=True, range_bytes=range_bytes)
    assert dict(df.dtypes) == {"id": "int", "some text": "string", "n": "double"}
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(i, t, float(n) if n else None) for i, t, n in rows]
    given = readers.read_table(spark, str(folder), "csv", "id long, t string, n string", multi_line=True, range_bytes=range_bytes)
    assert dict(given.dtypes) == {"id": "bigint", "t": "string", "n": "string"} and given.count() == len(rows)


def test_one_file_is_many_tasks(spark, quoted):
    folder, rows = quoted
    spans = byte_ranges.record_spans(spark, str(folder / "a.csv"), 64).collect()
    size = (folder / "a.csv").stat().st_size
    spans = sorted((r["start"], r["stop"]) for r in spans)
    assert len(spans) > 5 and spans[0][0] == 0 and spans[-1][1] == size
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    counted = landing.count_rows_by_file(spark, str(folder), "csv", multi_line=True).collect()
    assert sorted(r["row_count"] for r in counted) == [21, 40]


def test_empty_csv(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    assert readers.read_table(spark, str(tmp_path), "csv", multi_line=True).count() == 0
    (tmp_path / "head.csv").write_text("a,b\n")
    df = readers.read_table(spark, str(tmp_path), "csv", multi_line=True)
    assert df.columns == ["a", "b"] and df.count() == 0


def test_a_range_is_not_held_whole(tmp_path):
    """Scanning a range and cutting it into records takes a few blocks of memory, not many times the range."""
    path, row = str(tmp_path / "big.csv"), '"' + 'x, ""y""\n' * 500 + '",1\n'
    n = (24 << 20) // len(row)
    (tmp_path / "big.csv").write_text("text,id\n" + row * n)
    size = (tmp_path / "big.csv").stat().st_size
    spans = pd.DataFrame({"path": [path], "size": [size], "start": [0], "stop": [size]})
    tracemalloc.start()
    scanned = pd.concat(list(byte_ranges._quote_scan(iter([spans]))))
    records = sum(int((frame["value"].str.strip() != "").sum()) for frame in byte_ranges._records(iter([spans])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (scanned["quotes"][0], scanned["outside"][0], records) == (0, 8, n + 1)
    assert peak < 3 * size


def test_records_over_block_borders(tmp_path, monkeypatch):
    rows = ["a,b", '"x\ny",1', "", '"""q""\r\n,",é', "last,2\r"]
    (tmp_path / "cut.csv").write_bytes("\n".join(rows).encode())
    path = str(tmp_path / "cut.csv")
    span = pd.DataFrame({"path": [path], "start": [0], "stop": [len("\n".join(rows).encode())]})
    for block in (1, 2, 3, 7, 100):
        monkeypatch.setattr(byte_ranges, "BLOCK_BYTES", block)
        found = pd.concat(list(byte_ranges._records(iter([span]))), ignore_index=True)
        assert found["value"].tolist() == [r.rstrip("\r") for r in rows]
        assert found["head"].tolist() == [True, False, False, False, False]
