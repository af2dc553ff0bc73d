"""Files read in byte ranges, so that one large file is many tasks whatever its format.

What a range means can depend on all bytes before it: whether it starts inside quotes, and how deep in brackets. Each range
therefore reports what it does from either start, and a running combination over the ranges of a file tells which it was.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyarrow.dataset import dataset
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_BYTES = 32 << 20
#: Bytes looked back for backslashes before a range, bytes in which a first line is sought, rows handed on at a time, and bytes of a
#: range that are scanned, or handed on as records, at a time.
LOOK_BACK, HEAD_BYTES, BATCH_ROWS, BLOCK_BYTES = 4096, 1 << 20, 10_000, 4 << 20
QUOTE, NEWLINE, BACKSLASH, COMMA = b'"\n\\,'
OPENING, CLOSING = b"[{", b"]}"
BLANK = np.isin(np.arange(256), list(b" \t\r\n\x0b\x0c"))


def _file(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file:///" + path[5:].lstrip("/") if path.startswith("file:/") else path)


def reachable(path: str) -> bool:
    """Whether tasks can open files of this address by themselves; of other stores only Spark's readers can."""
    try:
        _file(path)
    except Exception:  # an unknown scheme, or a driver that is not installed
        return False
    return True


def read_bytes(path: str, start: int, stop: int) -> bytes:
    store, name = _file(path)
    with store.open_input_file(name) as file:
        file.seek(start)
        return file.read(stop - start)


def byte_blocks(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The bytes from ``start`` to ``stop`` in blocks, so that a range never lies in memory whole."""
    store, name = _file(path)
    with store.open_input_file(name) as file:
        file.seek(start)
        while start < stop and (block := file.read(min(BLOCK_BYTES, stop - start))):
            yield block
            start += len(block)


def parquet_blocks(folder: str, rows: int) -> Iterator[pd.DataFrame]:
    """The rows of a Parquet folder in blocks of at most ``rows``."""
    store, name = _file(folder)
    for batch in dataset(name, filesystem=store, format="parquet").to_batches(batch_size=rows):
        if batch.num_rows:
            yield batch.to_pandas()


def file_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, glob: str = "*", least_bytes: int = 0) -> DataFrame:
    """(path, size, start, stop) of every range of the files of more than ``least_bytes`` bytes; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    files = files.filter(F.col("length") > least_bytes).select("path", F.col("length").alias("size"))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    return _spread(files.withColumn("start", start).withColumn("stop", F.least("size", F.col("start") + range_bytes)))


def _spread(rows: DataFrame) -> DataFrame:
    """A task for every few ranges; the rows are some bytes each."""
    many = rows.select(F.count(F.lit(1))).first()[0]
    return rows.repartition(max(1, min(many, 100_000)), "path", "start") if many else rows


def _before():
    """The ranges of a file before this one."""
    return Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)


# ---- records of CSV files with line breaks inside quotes


def _quoted(block: bytes, state: int) -> tuple[np.ndarray, np.ndarray]:
    """The parity of the quotes up to each byte, ``state`` being that before the block, and the places of line ends."""
    data = np.frombuffer(block, np.uint8)
    return (np.cumsum(data == QUOTE, dtype=np.uint8) + np.uint8(state)) & 1, np.flatnonzero(data == NEWLINE)


def _quote_scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each range the parity of its quotes, and where its first record starts if it begins outside or inside quotes."""
    for batch in batches:
        out = []
        for path, start, stop in zip(batch["path"], batch["start"], batch["stop"]):
            state, first, at = 0, [None, None], start
            for block in byte_blocks(path, start, stop):
                parity, ends = _quoted(block, state)
                for side in (0, 1):
                    if first[side] is None and len(found := ends[parity[ends] == side][:1]):
                        first[side] = at + int(found[0]) + 1
                state, at = int(parity[-1]), at + len(block)
            out.append((state, *first))
        found = pd.DataFrame(out, columns=["quotes", "outside", "inside"]).astype({"outside": "Int64", "inside": "Int64"})
        yield pd.concat([batch.reset_index(drop=True), found], axis=1)


def record_spans(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, stop): spans of whole CSV records, about one per range; quotes inside quotes are doubled.

    A doubled quote changes the state twice, so parities suffice: the state at a range's start is the parity of all
    quotes before it. A record that is longer than a range lies in the span in which it starts.
    """
    scanned = file_ranges(spark, path, range_bytes).mapInPandas(
        _quote_scan, "path string, size long, start long, stop long, quotes int, outside long, inside long"
    )
    inside = F.coalesce(F.sum("quotes").over(_before()), F.lit(0)) % 2 == 1
    begins = F.when(F.col("start") == 0, F.lit(0).cast("long")).otherwise(F.when(inside, F.col("inside")).otherwise(F.col("outside")))
    starts = scanned.withColumn("begins", begins).filter("begins < size").select("path", "size", F.col("begins").alias("start"))
    follows = F.lead("start").over(Window.partitionBy("path").orderBy("start"))
    return _spread(starts.select("path", "start", F.coalesce(follows, "size").alias("stop")))


def _span_records(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The records of a span one by one; only a record that goes on in the next block is kept."""
    state, begun = 0, []
    for block in byte_blocks(path, start, stop):
        parity, ends = _quoted(block, state)
        at = 0
        for end in ends[parity[ends] == 0].tolist():
            yield b"".join([*begun, block[at:end]])
            begun, at = [], end + 1
        begun.append(block[at:])
        state = int(parity[-1])
    yield b"".join(begun)


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def frame(path: str, values: list[str], first: bool) -> pd.DataFrame:
        if first:
            values[0] = values[0].removeprefix("\ufeff")
        return pd.DataFrame({"path": path, "head": first & (np.arange(len(values)) == 0), "value": values})

    for batch in batches:
        for path, start, stop in zip(batch["path"], batch["start"], batch["stop"]):
            values, size, first = [], 0, bool(start == 0)
            for record in _span_records(path, start, stop):
                values.append(record.rstrip(b"\r").decode("utf-8", "replace"))
                size += len(record)
                if len(values) >= BATCH_ROWS or size >= BLOCK_BYTES:
                    yield frame(path, values, first)
                    values, size, first = [], 0, False
            if values:
                yield frame(path, values, first)


def csv_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, head, value): the records of CSV files as text, ``head`` for the first of a file; blank records are left out."""
    records = record_spans(spark, path, range_bytes).mapInPandas(_records, "path string, head boolean, value string")
    return records.filter(F.trim("value") != "")


# ---- what large files hold


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([
            {"path": path, "size": size, "start": start, **_summary(path, start, stop)}
            for path, size, start, stop in zip(batch["path"], batch["size"], batch["start"], batch["stop"])
        ])


def _escaped(path: str, start: int, data: np.ndarray) -> np.ndarray:
    """Which bytes follow an odd run of backslashes."""
    back = min(start, LOOK_BACK)
    near = np.concatenate([np.frombuffer(read_bytes(path, start - back, start), np.uint8), data]) if back else data
    slash = near == BACKSLASH
    # length of the run of backslashes that ends right before each byte
    place = np.arange(len(near))
    last_other = np.maximum.accumulate(np.where(slash, -1, place)) if len(near) else place
    run = np.concatenate([[0], (place - last_other)[:-1]])
    return (run % 2 == 1)[back:]


def _summary(path: str, start: int, stop: int) -> dict:
    magic = read_bytes(path, 0, 4)
    known, rows = None, None
    if magic == b"PAR1":
        known = "parquet"
    elif magic == b"PK\x03\x04" and _is_workbook(path):
        known = "xlsx"
    if known:
        if start == 0:
            rows = _footer_rows(path) if known == "parquet" else 1
        nothing = [{"net": 0, "low": 0, "commas": {}, "closed": {}} for _ in range(2)]
        return {"known": known, "rows": rows, "first": None, "binary": False, "breaks": 0, "ends_line": False,
                "filled": 0, "first_filled": False, "last_filled": False, "quotes": 0, "outside": nothing[0], "inside": nothing[1], "line_json": False}
    raw = read_bytes(path, start, stop)
    head = read_bytes(path, 0, max(stop, HEAD_BYTES)) if start == 0 else b""
    data = np.frombuffer(raw, np.uint8)
    text = ~BLANK[data]
    ends = np.flatnonzero(data == NEWLINE)
    lines = np.add.reduceat(text, np.concatenate([[0], ends[ends < len(data) - 1] + 1])) > 0
    if len(ends) and ends[-1] == len(data) - 1:
        lines = np.append(lines, False)
    quote = (data == QUOTE) & ~_escaped(path, start, data)
    state = np.cumsum(quote) & 1
    step = np.isin(data, list(OPENING)).astype(np.int64) - np.isin(data, list(CLOSING))
    return {
        "known": None, "rows": None, "first": chr(data[text.argmax()]) if text.any() else None,
        "binary": b"\x00" in head[:10_000], "breaks": len(ends), "ends_line": bool(data[-1] == NEWLINE),
        "filled": int(lines[1:-1].sum()), "first_filled": bool(lines[0]), "last_filled": bool(lines[-1]), "quotes": int(quote.sum()),
        "outside": _depths(data, step * (state == 0), state == 0), "inside": _depths(data, step * (state == 1), state == 1),
        "line_json": _first_line_is_object(head),
    }


def _depths(data: np.ndarray, step: np.ndarray, plain: np.ndarray) -> dict:
    """Of the bytes that are not in strings: net and lowest depth, commas and brackets closed, by depth; depths are relative to the start."""
    depth = np.cumsum(step)
    counts = [np.unique(depth[which], return_counts=True) for which in (plain & (data == COMMA), step < 0)]
    commas, closed = ({int(d): int(n) for d, n in zip(*x)} for x in counts)
    return {"net": int(depth[-1]), "low": int(depth.min()), "commas": commas, "closed": closed}


def _first_line_is_object(raw: bytes) -> bool:
    try:
        return isinstance(json.loads(raw.lstrip().split(b"\n", 1)[0].decode("utf-8")), dict)
    except ValueError:
        return False


def _is_workbook(path: str) -> bool:
    store, name = _file(path)
    with store.open_input_file(name) as file:
        try:
            return any(n.startswith("xl/") or n == "[Content_Types].xml" for n in zipfile.ZipFile(io.BufferedReader(file)).namelist())
        except Exception:  # not a whole archive
            return False


def _footer_rows(path: str) -> int:
    store, name = _file(path)
    try:
        with store.open_input_file(name) as file:
            return pq.read_metadata(file).num_rows
    except Exception:  # damaged footer: counted as one row like other unreadable files
        return 1


def large_files(spark: SparkSession, path: str, least_bytes: int, glob: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, length, kind, row_estimate) of the files of more than ``least_bytes`` bytes, read range by range.

    Parquet and workbooks by their first bytes (the rows of a Parquet file from its footer). JSON opens with ``{`` or ``[``, and its
    brackets outside strings close once, at the end; or its first line is an object. Its rows: the filled lines where it
    opens with ``{`` and has more than one, the elements of an array by the commas at depth one, else one (an object's lists
    are not looked into). A zero byte among
    the first 10,000 is no table; everything else is CSV, counted by its lines less the header. A file of blanks has no kind.
    """
    half = "struct<net:long, low:long, commas:map<long,long>, closed:map<long,long>>"
    ranges = file_ranges(spark, path, range_bytes, glob, least_bytes).mapInPandas(
        _summaries,
        "path string, size long, start long, known string, rows long, first string, binary boolean, breaks long, ends_line boolean, "
        f"filled long, first_filled boolean, last_filled boolean, quotes long, outside {half}, inside {half}, line_json boolean",
    )
    so_far = lambda c: F.coalesce(F.sum(c).over(_before()), F.lit(0))
    ranges = ranges.withColumn("own", F.when(so_far("quotes") % 2 == 1, F.col("inside")).otherwise(F.col("outside")))
    ranges = ranges.withColumns({"depth": so_far(F.col("own.net")), "line": so_far("breaks")})
    at_depth = lambda name, n: F.coalesce(F.try_element_at(f"own.{name}", n - F.col("depth")), F.lit(0))
    # lines that reach over borders: each border line is met from both of its sides
    borders = ranges.select("path", F.inline(F.array(
        F.struct("line", F.col("first_filled").alias("is_filled")),
        F.struct((F.col("line") + F.col("breaks")).alias("line"), F.col("last_filled").alias("is_filled")),
    ))).groupBy("path", "line").agg(F.max("is_filled").alias("is_filled")).groupBy("path").agg(
        F.count_if("is_filled").alias("on_borders")
    )
    files = ranges.groupBy("path").agg(
        F.first("size").alias("length"), F.max("known").alias("known"), F.max("rows").alias("rows"),
        F.min_by("first", F.when(F.col("first").isNotNull(), F.col("start"))).alias("first"),
        F.max("binary").alias("binary"), F.sum("breaks").alias("breaks"), F.max_by("ends_line", "start").alias("ends_line"),
        F.sum("filled").alias("inner"), F.sum("quotes").alias("quotes"), F.sum("own.net").alias("net"),
        F.min(F.col("depth") + F.col("own.low")).alias("low"), F.sum(at_depth("commas", 1)).alias("commas"),
        F.sum(at_depth("closed", 0)).alias("documents"), F.max("line_json").alias("line_json"),
    ).join(borders, "path")
    filled = F.col("inner") + F.col("on_borders")
    closed = (F.col("net") == 0) & (F.col("low") == 0) & (F.col("documents") == 1) & (F.col("quotes") % 2 == 0)
    is_json = (F.col("first").isin("{", "[") & closed) | ((F.col("first") == "{") & F.col("line_json"))
    kind = (
        F.when(F.col("known").isNotNull(), F.col("known")).when(F.col("first").isNull(), F.lit(None).cast("string"))
        .when(is_json, "json").when(F.col("binary"), F.lit(None).cast("string")).otherwise("csv")
    )
    lines = F.col("breaks") + F.when(F.col("ends_line"), 0).otherwise(1)
    rows = (
        F.when(F.col("rows").isNotNull(), F.col("rows"))
        .when(F.col("kind") == "csv", F.greatest(F.lit(0), lines - 1))
        .when((F.col("kind") == "json") & (F.col("first") == "["), F.col("commas") + 1)
        .when((F.col("kind") == "json") & (filled > 1), filled)
        .when(F.col("kind").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    )
    return files.withColumn("kind", kind).select("path", "length", "kind", rows.cast("bigint").alias("row_estimate"))
