"""Similar vectors and similar schemas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.fixed_values import SIMILAR_AT
from plumbline.functions.frames import col
from plumbline.functions.vectors import as_vector, cosine
from plumbline.session import shared_folder
from plumbline.sources.byte_ranges import parquet_blocks, reachable

QUERY_ROWS, BASE_ROWS = 8192, 65_536
QUERIES_PER_PRODUCT = 512  # bounds the score matrix a task holds at once
HASH_DIMS = 64


def relevance(items: DataFrame, vector: str, question: Sequence[float]) -> DataFrame:
    """Add ``relevance``: cosine to the question's vector, never below zero."""
    return items.withColumn("relevance", F.greatest(F.lit(0.0), cosine(col(vector), as_vector(question))))


def find_similar(
    df: DataFrame, key: str, vector: str, query: Sequence[float], threshold: float = SIMILAR_AT
) -> DataFrame:
    """The row most similar to the query vector if it reaches the threshold; otherwise no row.

    An empty or all-zero query matches nothing.
    """
    if not any(query):
        scored = df.withColumn("similarity", F.lit(None).cast("double")).filter(F.lit(False))
    else:
        scored = df.withColumn("similarity", cosine(col(vector), as_vector(query)))
    return scored.filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), col(key)).limit(1)


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of those that are not zero, and where they stand."""
    stacked = np.array(vectors.tolist(), dtype="float64")
    lengths = np.linalg.norm(stacked, axis=1)
    return stacked[lengths > 0] / lengths[lengths > 0, None], np.flatnonzero(lengths > 0)


def _nearest(k: int):
    """The best ``k`` base rows of a block for each query of a block."""

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["query_id", "similarity", "base_id"], ascending=[True, False, True], kind="stable")
        return rows.groupby("query_id", sort=False).head(k)

    def compare(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "base_id": [], "similarity": []})]
        if len(queries) and len(base):
            matrix, q_at = _unit(queries["v"])
            vectors, b_at = _unit(base["v"])
            q_ids, b_ids = queries["q"].to_numpy()[q_at], base["b"].to_numpy()[b_at]
            for first in range(0, len(matrix) if len(b_ids) else 0, QUERIES_PER_PRODUCT):
                # rounded so that equal vectors tie exactly wherever they lie in the product
                scores = np.round(matrix[first:first + QUERIES_PER_PRODUCT] @ vectors.T, 12)
                border = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else scores.min(axis=1)
                q, at = np.nonzero(scores >= border[:, None])
                found.append(best(pd.DataFrame({"query_id": q_ids[q + first], "base_id": b_ids[at], "similarity": scores[q, at]})))
        return pd.concat(found[1:] or found)

    return compare


def _nearest_of_written(folder: str, k: int, query_rows: int, base_rows: int):
    """The best ``k`` rows of each slab of a task for each query of a Parquet folder."""
    compare = _nearest(k)

    def against_all(slab: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for block in parquet_blocks(folder, query_rows):
            yield compare(block, slab)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= base_rows:
                yield from against_all(pd.concat(held))
                held, rows = [], 0
        if rows:
            yield from against_all(pd.concat(held))

    return run


def knn(
    queries: DataFrame, query_key: str, query_vector: str, base: DataFrame, base_key: str, base_vector: str, k: int,
    query_rows: int = QUERY_ROWS, base_rows: int = BASE_ROWS,
) -> DataFrame:
    """The ``k`` most similar base rows of every query: query_id, base_id, similarity, place.

    Exact. The queries are written to the shared folder. The base is read once, where it lies: a task takes ``base_rows`` of its
    rows at a time, goes through the queries in blocks of ``query_rows``, and hands on its ``k`` best per query, which is all
    that is shuffled. Where tasks cannot open the shared folder by themselves, both sides are dealt into such blocks by a hash of
    their keys instead, and every block of queries meets every block of the base in a task of its own.
    """
    key_type = base.schema[base_key].dataType.simpleString()
    query_type = queries.schema[query_key].dataType.simpleString()
    schema = f"query_id {query_type}, base_id {key_type}, similarity double"
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "base_id")
    place = F.row_number().over(order)
    folder = shared_folder(queries.sparkSession, "queries")
    if reachable(folder):
        asked = queries.select(col(query_key).alias("q"), col(query_vector).cast("array<double>").alias("v")).filter("v is not null")
        asked.write.parquet(folder)
        known = base.select(col(base_key).alias("b"), col(base_vector).cast("array<double>").alias("v")).filter("v is not null")
        found = known.mapInPandas(_nearest_of_written(folder, k, query_rows, base_rows), schema)
        return found.withColumn("place", place).filter(F.col("place") <= k)

    def side(df: DataFrame, key: str, vector: str, name: str, rows: int) -> tuple[DataFrame, Column]:
        plain = df.select(col(key).alias(name), col(vector).cast("array<double>").alias("v")).filter("v is not null")
        blocks = F.greatest(F.lit(1), F.ceil(plain.agg(F.count(F.lit(1))).scalar() / rows)).cast("int")
        return plain.withColumn(f"{name}_block", F.pmod(F.xxhash64(name), blocks).cast("int")), blocks

    wanted, query_blocks = side(queries, query_key, query_vector, "q", query_rows)
    known, base_blocks = side(base, base_key, base_vector, "b", base_rows)
    wanted = wanted.withColumn("b_block", F.explode(F.sequence(F.lit(0), base_blocks - 1)))
    known = known.withColumn("q_block", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
    found = wanted.groupBy("q_block", "b_block").cogroup(known.groupBy("q_block", "b_block")).applyInPandas(_nearest(k), schema)
    return found.withColumn("place", place).filter(F.col("place") <= k)


def schema_texts(columns: DataFrame, dataset: str, name: str, semantic: str) -> DataFrame:
    """``name:type name:type ...`` per dataset, sorted; a dataset's columns form one short list."""
    part = F.concat(col(name), F.lit(":"), col(semantic))
    parts = columns.select(col(dataset), part.alias("_part")).distinct()
    return parts.groupBy(col(dataset)).agg(
        F.array_join(F.sort_array(F.collect_list("_part")), " ").alias("schema_text")
    )


def schema_vectors(columns: DataFrame, dataset: str, name: str, semantic: str, dims: int = HASH_DIMS) -> DataFrame:
    """The schema text of each dataset with its unit vector of hashed tokens.

    A token falls into slot (first 8 hex digits of its MD5) mod ``dims``.
    """
    texts = schema_texts(columns, dataset, name, semantic)
    tokens = texts.select(col(dataset), F.explode(F.split("schema_text", " ")).alias("_token"))
    slot = F.conv(F.substring(F.md5(F.col("_token").cast("binary")), 1, 8), 16, 10).cast("bigint") % dims
    counts = tokens.groupBy(col(dataset), slot.cast("int").alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    filled = counts.groupBy(col(dataset)).agg(
        F.map_from_entries(F.collect_list(F.struct("_slot", "_n"))).alias("_by_slot"),  # at most ``dims`` entries
        F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_norm"),
    )
    vector = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.coalesce(F.try_element_at("_by_slot", i), F.lit(0)) / F.col("_norm"),
    )
    return texts.join(filled, dataset).select(col(dataset), "schema_text", vector.alias("vector"))


def match_schemas(new: DataFrame, known: DataFrame, threshold: float = SIMILAR_AT) -> DataFrame:
    """For each new dataset: a known one with the same fingerprint, else the most similar one, else none.

    Both inputs have dataset, fingerprint and vector.
    """
    exact = known.groupBy("fingerprint").agg(F.min("dataset").alias("_same"))
    first = new.join(exact, "fingerprint", "left")
    rest = first.filter(F.col("_same").isNull())
    near = knn(rest, "dataset", "vector", known, "dataset", "vector", 1)
    near = near.filter(F.col("similarity") >= threshold).select(
        F.col("query_id").alias("dataset"), F.col("base_id").alias("_near"), F.col("similarity").alias("_score")
    )
    joined = first.join(near, "dataset", "left")
    how = F.when(F.col("_same").isNotNull(), "exact").when(F.col("_near").isNotNull(), "similar").otherwise("none")
    return joined.select(
        "dataset",
        F.coalesce("_same", "_near").alias("matched"),
        F.when(F.col("_same").isNotNull(), F.lit(1.0)).otherwise(F.col("_score")).alias("similarity"),
        how.alias("match_kind"),
    )
