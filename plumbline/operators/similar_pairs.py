"""All pairs of vectors above a cosine, found by banded signs of random hyperplanes and counted without listing them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import SIMILAR_AT
from plumbline.functions.frames import col, written
from plumbline.operators.components import components

#: Signs compared before vectors are, in 64-bit words, and the chance that they turn a similar pair away in deviations.
SKETCH_WORDS, SKETCH_DEVIATIONS = 4, 7
#: Members of a band's bucket that meet in one task; members up to which buckets are compared side by side.
CELL_ROWS, SMALL = 4096, 64
BUCKET_ROWS = 8  # aimed at for vectors that have nothing in common


def bands_for(classes: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits of a band, bands): so many that a pair at the threshold shares no band with a chance under ``miss``.

    Two vectors at an angle differ in the sign of a random projection with probability angle / pi. Bits grow with the
    number of vectors, so that a bucket of unlike ones stays small.
    """
    same = 1 - math.acos(min(1.0, threshold)) / math.pi
    bits = min(30, max(6, math.ceil(math.log2(max(2, classes) / BUCKET_ROWS))))
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-min(same**bits, 1 - 1e-12))))


def sketch_limit(threshold: float) -> int:
    """Signs in which a pair at the threshold may differ."""
    bits, differ = 64 * SKETCH_WORDS, math.acos(min(1.0, threshold)) / math.pi
    return math.ceil(bits * differ + SKETCH_DEVIATIONS * math.sqrt(bits * differ * (1 - differ)))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_list()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signer(bits: int, bands: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, part in batch.groupby(batch["vector"].map(len)):
                planes = np.random.default_rng([dims, bits]).standard_normal((64 * SKETCH_WORDS + bits * bands, dims))
                signs = _unit(part["vector"]) @ planes.T > 0
                sketch = np.packbits(signs[:, : 64 * SKETCH_WORDS], axis=1).view(np.int64)
                codes = signs[:, 64 * SKETCH_WORDS :].reshape(len(part), bands, bits) @ (1 << np.arange(bits))
                yield part.assign(sketch=list(sketch), codes=list(codes.astype(np.int32)))

    return sign


def _pairs(cell: np.ndarray, side: np.ndarray, sketch: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of row numbers (i, j) of the same cell whose sketches allow a similar pair; rows come in order of cell.

    In a cell cut out of two chunks (sides 0 and 1), only pairs between them count.
    """
    sketch = sketch.view(np.uint64)  # of a signed word the bits of its absolute value would be counted
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(cell)))
    in_small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, sizes.max(initial=0))):
        i = np.flatnonzero((cell[step:] == cell[:-step]) & in_small[step:])
        if not len(i):
            break
        j = i + step
        keep = (side[i] != side[j]) | (side[i] == 2)
        i, j = i[keep], j[keep]
        close = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= limit
        yield i[close], j[close]
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        own = sketch[start : start + size]
        for at in range(0, size, 256):
            close = np.bitwise_count(own[at : at + 256, None, :] ^ own[None, :, :]).sum(axis=2) <= limit
            i, j = np.nonzero(close)
            i += at
            keep = (i < j) & ((side[start + i] != side[start + j]) | (side[start + i] == 2))
            yield start + i[keep], start + j[keep]


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches that hold whole cells, of rows that come in order of cell."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        last = batch["cell"].iloc[-1] if len(batch) else None
        done = batch["cell"] != last
        if done.any():
            yield pd.concat([*held, batch[done]], ignore_index=True)
            held = []
        elif held and len(batch) and held[-1]["cell"].iloc[-1] != last:
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(batch[~done])
    if held:
        yield pd.concat(held, ignore_index=True)


def _survivors(limit: int):
    """Members of cells that have a partner there by their sketches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _cells(batches):
            near = np.zeros(len(rows), bool)
            sketch = np.stack(rows["sketch"].to_list()) if len(rows) else np.zeros((0, SKETCH_WORDS), np.int64)
            for i, j in _pairs(rows["cell"].to_numpy(), rows["side"].to_numpy(), sketch, limit):
                near[i] = near[j] = True
            yield rows.loc[near, ["cell", "side", "band", "class"]]

    return run


def _linked(limit: int, threshold: float):
    """Per member of a cell its links that no earlier band has, their rows, and the smallest member it is linked to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _cells(batches):
            if not len(rows):
                continue
            classes, weights, band = (rows[c].to_numpy() for c in ("class", "n_rows", "band"))
            sketch, codes = np.stack(rows["sketch"].to_list()), np.stack(rows["codes"].to_list())
            dims = rows["vector"].map(len).to_numpy()
            unit = {d: _unit(part["vector"]) for d, part in rows.groupby(dims)}
            place = rows.groupby(dims).cumcount().to_numpy()
            links, linked = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            low, found = classes.copy(), []
            for i, j in _pairs(rows["cell"].to_numpy(), rows["side"].to_numpy(), sketch, limit):
                for at in range(0, len(i), 65_536):
                    a, b = i[at : at + 65_536], j[at : at + 65_536]
                    first = (codes[a] == codes[b]).argmax(axis=1) == band[a]
                    a, b = a[first], b[first]
                    cosine = np.zeros(len(a))
                    for d, x in unit.items():
                        own = dims[a] == d
                        cosine[own] = np.einsum("ij,ij->i", x[place[a[own]]], x[place[b[own]]])
                    close = np.round(cosine, 12) >= threshold
                    a, b = a[close], b[close]
                    for one, other in ((a, b), (b, a)):
                        np.add.at(links, one, 1)
                        np.add.at(linked, one, weights[other])
                    found.append((a, b))
            while found:  # the smallest member of the cell that links lead to
                before = low.copy()
                for a, b in found:
                    np.minimum.at(low, a, low[b])
                    np.minimum.at(low, b, low[a])
                if (before == low).all():
                    break
            out = pd.DataFrame({"class": classes, "links": links, "linked": linked, "low": low})
            yield out[links > 0]

    return run


def similar_vectors(
    df: DataFrame, key: str, vector: str, threshold: float = SIMILAR_AT, miss: float = 1e-6, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Which vectors have others of a cosine of at least ``threshold``, one row per class of equal vectors.

    class_id (smallest key of the class), n_rows, n_links (other classes within the threshold), linked_rows (rows
    of those) and group_id (smallest key that links lead to). Null vectors, vectors of zeros and those with null or non-finite
    components are left out; vectors of different length are not compared.

    1. A class gets the signs of random projections: a sketch, and codes of a few bits each, its bands (``bands_for``).
    2. Classes are posted under their bands. Buckets of more than ``cell_rows`` are cut into chunks that meet in pairs, each in
       a cell of its own. Who has no partner there by the sketches' differing bits goes no further.
    3. The others' vectors follow, and exact cosines decide. A pair counts in its first common band. Cells hand on
       sums and the smallest member linked to, so no pair is ever a row.
    4. Those links are united (``components``).

    A pair above the threshold that shares no band is missed, with a chance of at most ``miss``; so is one that differs in more bits
    of the sketch than ``sketch_limit`` (seven deviations).
    """
    v = col(vector).cast("array<double>")
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = df.filter(whole & F.exists(v, lambda x: x != 0)).select(col(key).alias("key"), v.alias("vector"))
    classes = written(
        rows.groupBy("vector").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("class", F.monotonically_increasing_id()), "similar-classes",
    )
    bits, bands = bands_for(classes.count(), threshold, miss)
    signed = written(
        classes.select("class", "n_rows", "vector").mapInPandas(
            _signer(bits, bands), "class long, n_rows long, vector array<double>, sketch array<long>, codes array<int>"
        ), "similar-signed",
    )
    posted = signed.select("class", "sketch", F.size("vector").alias("dims"), F.posexplode("codes").alias("band", "code")).withColumn(
        "bucket", F.xxhash64("dims", "band", "code")
    ).drop("dims", "code")
    large = posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows).select(
        F.col("bucket").alias("large"), F.ceil(F.col("n") / cell_rows).alias("chunks")
    )
    posted = posted.join(large, F.col("bucket") == F.col("large"), "left").withColumn("chunk", F.pmod(F.xxhash64("class"), F.coalesce("chunks", F.lit(1))))
    # a chunk meets itself (side 2) and every other one, as the lower (side 0) or the higher (side 1) of the two
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)).cast("long") - 1))
    cells = posted.withColumn("other", other).select(
        F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"),
        F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1).alias("side"),
        "band", "class", "sketch",
    )
    limit = sketch_limit(threshold)
    together = lambda d: d.repartition("cell").sortWithinPartitions("cell")
    near = written(
        together(cells).mapInPandas(_survivors(limit), "cell long, side int, band int, class long"), "similar-near"
    )
    found = written(
        together(near.join(signed, "class")).mapInPandas(_linked(limit, threshold), "class long, links long, linked long, low long"),
        "similar-links",
    )
    sums = found.groupBy("class").agg(F.sum("links").alias("n_links"), F.sum("linked").alias("linked_rows"))
    roots = components(found.select(F.col("class").alias("a"), F.col("low").alias("b")))
    named = classes.join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "class_id", "n_rows", F.coalesce("root", "class").alias("root")
    )
    heads = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return named.join(heads, "root").join(sums, "class", "left").select(
        "class_id", "n_rows", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("linked_rows", F.lit(0)).alias("linked_rows"),
        "group_id",
    )
