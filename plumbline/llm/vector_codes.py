"""Vectors as short codes: integer codebooks per part, fitted and applied through a trie over the distinct parts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions.frames import col
from plumbline.llm.common import saved

#: Parts under one prefix from which on they are measured together, not by further branches.
BUNDLE = 256
#: Sums of squares under this are exact in double precision; above, Python's integers are used.
EXACT = 2**53

#: Of each part position an array of entries (rows) by components.
Codebooks = list[np.ndarray]


def usable(vector: Any) -> Any:
    """Whether a vector is not null and holds neither nulls nor non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _whole(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """id, x (integer components) and the other columns as struct ``source``, of the usable vectors."""
    vector = col(vector_column).cast("array<double>")
    others = [c for c in vectors.columns if c not in (id_column, vector_column)]
    return vectors.filter(usable(vector)).select(
        col(id_column).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x * scale)).alias("x"),
        F.struct(*[col(c) for c in others] or [F.lit(None).cast("string").alias("none")]).alias("source"),
    )


def smallest(rows: DataFrame, n: int) -> list:
    """The ``n`` rows (id, x) of smallest id, ties by x, null ids last.

    A bound on the id is sought first by counting, so that no task hands on ``n`` rows only to have them dropped.
    """
    count, low, high = rows.agg(F.count("id"), F.min("id"), F.max("id")).first()
    near = rows
    if count > n:
        bound = low + (high - low) * 2 * n // count
        while rows.filter(F.col("id") <= bound).limit(n).count() < n:
            bound = low + 2 * (bound - low) + 1
        near = rows.filter(F.col("id") <= bound)
    return near.orderBy(F.col("id").asc_nulls_last(), "x").select("id", "x").limit(n).collect()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct parts in lexicographic order the nearest entry (ties to the lower index) and its squared distance.

    The order makes them a trie: parts with a common prefix lie side by side. A depth-first walk carries
    the distances of all entries over the prefix read so far, worked out once for all parts below; under a branch of
    at most ``BUNDLE`` parts what is left of them is measured in one product.
    """
    n, dims = parts.shape
    most = max((abs(int(x)) for a in (parts, entries) if a.size for x in (a.min(), a.max())), default=0)
    kind = np.float64 if 4 * max(1, dims) * (most + 1) ** 2 < EXACT else object
    parts, entries = parts.astype(kind), entries.astype(kind)
    codes, distances = np.zeros(n, np.int64), np.zeros(n, kind)
    rest = np.zeros((len(entries), dims + 1), kind)  # squares of an entry from a component on
    for d in range(dims - 1, -1, -1):
        rest[:, d] = rest[:, d + 1] + entries[:, d] * entries[:, d]
    branches = [(0, n, 0, np.zeros(len(entries), kind))] if n else []
    while branches:
        low, high, depth, carried = branches.pop()
        if high - low <= BUNDLE or depth == dims:
            own = parts[low:high, depth:]
            at = carried + rest[:, depth] + (own * own).sum(axis=1)[:, None] - 2 * (own @ entries[:, depth:].T)
            codes[low:high] = at.argmin(axis=1)
            distances[low:high] = at.min(axis=1)
            continue
        column = parts[low:high, depth]
        starts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [high - low]])
        for a, b in zip(starts[-2::-1], starts[:0:-1]):
            step = column[a] - entries[:, depth]
            branches.append((low + a, low + b, depth + 1, carried + step * step))
    return codes, distances


def _columns(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def _sums(codebooks: Codebooks):
    """The weighted sums of a task's distinct parts by nearest entry."""
    shape = codebooks[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(codebooks), *shape), np.int64)
        counts = np.zeros((len(codebooks), shape[0]), np.int64)
        for batch in batches:
            at, weights = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            parts = _columns(batch, "part", shape[1])
            for k in np.unique(at):
                own = at == k
                codes, _ = nearest(parts[own], codebooks[k])
                np.add.at(sums[k], codes, parts[own] * weights[own, None])
                np.add.at(counts[k], codes, weights[own])
        k, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({
            "at": k.astype(np.int32), "entry": entry.astype(np.int32), "n": counts[k, entry], "sums": list(sums[k, entry]),
        }), schema=pa.schema([("at", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    return run


def train_codebooks(
    vectors: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> Codebooks:
    """Codebooks fitted to all usable vectors, as integers.

    Components become floor(scale * x); a vector is cut into ``parts`` equal consecutive parts. Entries start as the parts of the
    ``entries`` vectors of smallest id (fewer if there are fewer). A round gives every part its nearest entry and replaces
    each used entry by the floor of its parts' mean. Equal parts are counted first (combined before the shuffle, so
    copies cost nothing) and kept in lexicographic order, which ``nearest`` walks as a trie; a round is a pass over them that
    returns at most one row per entry and task. The codebooks, parts * entries rows, are all that the driver holds.

    Vectors take part if they have the most common length that ``parts`` divides (ties: the shorter). Without any the
    codebooks have no entries.
    """
    rows = _whole(vectors, scale, id_column, vector_column)
    lengths = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).filter(f"dims > 0 and dims % {parts} = 0")
    usual = lengths.orderBy(F.desc("n"), "dims").first()
    if usual is None:
        return [np.zeros((0, 0), np.int64)] * parts
    dims = usual["dims"]
    rows, size = rows.filter(F.size("x") == dims), dims // parts
    start = np.array([r["x"] for r in smallest(rows, entries)], np.int64)
    books = [start[:, k * size : (k + 1) * size].copy() for k in range(parts)]
    cut = F.array(*[F.slice("x", k * size + 1, size) for k in range(parts)])
    distinct = saved(
        rows.select(F.posexplode(cut).alias("at", "part")).groupBy("at", "part").agg(F.count(F.lit(1)).alias("n"))
        .repartitionByRange("at", "part").sortWithinPartitions("at", "part"), "vector-parts",
    )
    for _ in range(rounds):
        found = distinct.mapInArrow(_sums(books), "at int, entry int, n long, sums array<long>")
        # a row per entry and component: at most as many as the codebooks have numbers
        means = (
            found.select("at", "entry", "n", F.posexplode("sums").alias("i", "s"))
            .groupBy("at", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        )
        for r in means.collect():
            books[r["at"]][r["entry"], r["i"]] = r["s"] // r["n"]
    return books


def _encoder(codebooks: Codebooks, schema: pa.Schema):
    size = codebooks[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = batch.column("fits").to_numpy(zero_copy_only=False)
            x = _columns(batch.filter(batch.column("fits")).select(["x"]), "x", size * len(codebooks))
            codes, errors = np.zeros((len(x), len(codebooks)), np.int64), np.zeros(len(x), object)
            for k, book in enumerate(codebooks):
                distinct, back = np.unique(x[:, k * size : (k + 1) * size], axis=0, return_inverse=True)
                code, distance = nearest(distinct, book)
                codes[:, k] = code[back.reshape(-1)]
                errors += np.array([int(d) for d in distance], object)[back.reshape(-1)]
            code = np.full(batch.num_rows, None, object)
            error = np.full(batch.num_rows, None, object)
            code[fits] = ["".join(f"{c:02x}" for c in row) for row in codes]
            error[fits] = errors
            out = [batch.column("id"), pa.array(code, pa.string()), pa.array(error, pa.int64()), batch.column("source")]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def encode(
    vectors: DataFrame, codebooks: Codebooks, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """The usable vectors as codes: id, code, error (squared distance, summed over parts) and the other columns as ``source``.

    One row per usable row, repeated ones too; null vectors and those holding nulls or non-finite components are left out. A vector
    of another length than the codebooks' keeps its row with a null code and error. No shuffle. An error beyond 64 bits raises.
    """
    rows = _whole(vectors, scale, id_column, vector_column)
    dims = len(codebooks) * codebooks[0].shape[1] if len(codebooks[0]) else -1
    schema = T.StructType.fromDDL("id long, code string, error long").add(rows.schema["source"])
    if dims < 0:
        return rows.select("id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), "source")
    rows = rows.withColumn("fits", F.size("x") == dims)
    return rows.mapInArrow(_encoder(codebooks, to_arrow_schema(schema)), schema)


def codebook_rows(codebooks: Codebooks) -> list[tuple[int, int, int, int]]:
    """(part, entry, component, value) of all entries, in this order."""
    return [(k, e, i, int(v)) for k, book in enumerate(codebooks) for e, row in enumerate(book) for i, v in enumerate(row)]
