"""Near-duplicate documents by an inverted join on signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import col
from plumbline.llm.common import saved
from plumbline.llm.graph import connected_components

CACHED_WORDS = 1_000_000
#: 64-bit words of a sketch; a power of two.
SKETCH_WORDS = 16
#: Odd multipliers mixing the positions of a shingle's words.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class WordHashes(dict):
    """64-bit hash of a word; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingle_set(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text, A-Z lower-cased; of all its words if it has fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([known[w] for w in words], np.uint64)
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        total = mixed(total + hashes[k : len(hashes) - width + 1 + k] * MIX[k % len(MIX)])
    return np.unique(total)


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed the smallest of the shingles' scrambled hashes."""
    return np.array([mixed(shingles ^ s).min() for s in seeds]) if len(shingles) else np.zeros(0, np.uint64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits that say of each slot whether an odd number of shingles falls into it, as signed 64-bit words.

    The sketches of two sets differ in no more bits than the sets do in shingles.
    """
    odd = np.bincount((shingles & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be_similar(a: str, b: str, percent: int) -> Column:
    """False only if sizes (``n_``) or sketches (``sketch_``) of the two sides rule the similarity out."""
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    differ = F.lit(0)
    for i in range(SKETCH_WORDS):
        differ = differ + F.bit_count(F.get(F.col(f"sketch_{a}"), F.lit(i)).bitwiseXOR(F.get(F.col(f"sketch_{b}"), F.lit(i))))
    # sets of similarity p share p / (1 + p) of their summed sizes and differ in the rest
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * differ <= (100 - percent) * (n_a + n_b))


def _over_texts(work: Callable[[pd.DataFrame], pd.DataFrame], rows: int = 1000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                yield work(batch.iloc[at : at + rows])

    return run


def shared_coordinates(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    coordinates: int = 24,
    matches: int = 12,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    1. Every text gets a MinHash signature; equal sets become one class, so exact copies cost nothing more.
    2. A class is posted under its coordinate-value pairs that another class has too. A class with fewer than
       ``matches`` of them can match nothing. Two classes that agree in ``matches`` coordinates also agree in one
       of the ``n - matches + 1`` rarest of either's n pairs, so only these prefixes are posted: the long lists
       are skipped, yet no pair of classes above the match threshold is lost.
    3. In each list the members are compared with its first class only; collisions over the whole signature are
       counted, then the shingle sets confirm. After these links are united, lists that still hold several groups
       compare their members across groups; set sizes and sketches, which rule out no similar pair, are a part of
       that join's condition. So neither thousands of near copies of one text nor thousands of texts around one
       passage become pairs.
    4. Confirmed links are united to components.

    At the default of 12 of 24 coordinates a pair of similarity 0.8 is missed with probability 2.2e-4, one of 0.85 with 9e-6.

    One row per row of ``docs``: doc_id, text_key (hash of the text), row (unique), n_shingles, component_id (smallest doc_id of the
    component), kept (doc_id = component_id) and leads (true for exactly one row of each component, also where
    ids repeat or are null). Null and blank texts have no shingles and are linked with nothing; a null id
    counts as none when the smallest is sought, and such a row is kept only if its component has no id at
    all; repeated rows fall into one component; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(col(id_column).cast("long").alias("doc_id"), col(text_column).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    seeds = mixed(np.arange(1, coordinates + 1, dtype=np.uint64))

    def sign(part: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, width, WORDS) for t in part["text"]]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        signs = [signature(s, seeds).view(np.int64) for s in sets]
        return pd.DataFrame({
            "doc_id": part["doc_id"].astype("Int64"), "text_key": part["text_key"],
            "n_shingles": [len(s) for s in sets], "set_key": keys, "signature": signs, "sketch": [odd_sketch(s) for s in sets],
        })

    schema = "doc_id long, text_key long, n_shingles long, set_key binary, signature array<long>, sketch array<long>"
    signed = saved(
        rows.mapInPandas(_over_texts(sign), schema).withColumn("row", F.monotonically_increasing_id()), "minhash-signed"
    )
    of_text = signed.filter("n_shingles > 0")
    classes = saved(
        of_text.groupBy("set_key").agg(
            F.min("row").alias("class"), F.min("doc_id").alias("least_id"), F.min("n_shingles").alias("n"),
            F.min(F.struct("row", "doc_id", "text_key", "signature", "sketch")).alias("first"),
        ).select("set_key", "class", "least_id", "n", F.col("first.doc_id").alias("doc_id"), "first.text_key", "first.signature", "first.sketch"),
        "minhash-classes",
    )
    pairs = classes.select("class", F.posexplode("signature").alias("at", "value")).select(
        "class", F.xxhash64("at", "value").alias("pair")
    )
    common = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranked = pairs.join(common, "pair").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("shared"))
    posted = saved(
        ranked.filter(F.size("shared") >= matches)
        .select("class", F.slice("shared", F.lit(1), F.size("shared") - matches + 1).alias("shared"))
        .join(classes.select("class", "doc_id", "text_key", "n", "signature", "sketch"), "class"),
        "minhash-posted",
    )

    def shingles(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"class": part["class"], "shingles": [shingle_set(t, width, WORDS).view(np.int64) for t in part["text"]]})

    wanted = posted.select("class", F.col("doc_id").alias("wanted_id"), "text_key")
    sets = saved(
        rows.join(wanted, (rows["text_key"] == wanted["text_key"]) & rows["doc_id"].eqNullSafe(F.col("wanted_id")))
        .groupBy("class").agg(F.first("text").alias("text"))
        .mapInPandas(_over_texts(shingles), "class long, shingles array<long>"),
        "minhash-sets",
    )
    lists = posted.select("class", F.explode("shared.pair").alias("pair"))

    def confirmed(candidates: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that collide often enough and whose sets are similar."""
        own = ("signature", "sketch", "n")
        side = lambda name: posted.select(F.col("class").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in own])
        collided = saved(
            candidates.distinct().join(side("b"), "b").join(side("a"), "a")
            .filter(may_be_similar("a", "b", percent) & (shared_coordinates(F.col("signature_a"), F.col("signature_b")) >= matches))
            .select("a", "b"),
            "minhash-collided",
        )
        full = lambda name: sets.select(F.col("class").alias(name), F.col("shingles").alias(f"set_{name}"))
        both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        union = F.size("set_a") + F.size("set_b") - both
        return collided.join(full("b"), "b").join(full("a"), "a").filter(100 * both >= percent * union).select("a", "b")

    first = lists.groupBy("pair").agg(F.min("class").alias("a"))
    stars = saved(
        confirmed(lists.join(first, "pair").select("a", F.col("class").alias("b")).filter("a < b")), "minhash-links"
    )
    groups = connected_components(stars)
    grouped = lists.join(groups, lists["class"] == groups["node"], "left").select(
        "pair", "class", F.coalesce("component", "class").alias("group")
    )
    mixed_lists = grouped.groupBy("pair").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high")
    open_lists = saved(
        grouped.join(mixed_lists.select("pair"), "pair", "left_semi").join(posted.select("class", "n", "sketch"), "class"), "minhash-open"
    )
    side = lambda name: open_lists.select("pair", *[F.col(c).alias(f"{c}_{name}") for c in ("class", "group", "n", "sketch")])
    one, other = side("a"), side("b")
    across = one.join(
        other,
        (one["pair"] == other["pair"]) & (F.col("class_a") < F.col("class_b")) & (F.col("group_a") != F.col("group_b"))
        & may_be_similar("a", "b", percent),
    ).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    links = stars.unionByName(saved(confirmed(across), "minhash-links"))
    joined = connected_components(links)
    of_class = classes.select("set_key", "class", "least_id").join(
        joined, F.col("class") == F.col("node"), "left"
    ).select("set_key", "class", "least_id", F.coalesce("component", "class").alias("component"))
    least = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min("class").alias("any_row"))
    named = of_class.join(least, "component").select("set_key", "component", "component_id")
    out = signed.select("doc_id", "text_key", "row", "n_shingles", "set_key").join(
        named, (signed["set_key"] == named["set_key"]) & (signed["n_shingles"] > 0), "left"
    )
    out = saved(
        out.select(
            "doc_id", "text_key", "row", "n_shingles",
            F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component",
        ), "minhash-rows",
    )
    leaders = out.filter("component is not null").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m")
    ).select(F.col("m.row").alias("leader"))
    return out.join(leaders, out["row"] == leaders["leader"], "left").select(
        "doc_id", "text_key", "row", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        (F.col("component").isNull() | F.col("leader").isNotNull()).alias("leads"),
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **more) -> DataFrame:
    """``docs`` with one row left of each group of near duplicates, the one of smallest id; ``more`` as in ``near_duplicates``.

    Rows of the same id and text are the same document, of which one stays. Documents without words all stay.
    """
    found = near_duplicates(docs, id_column=id_column, text_column=text_column, **more)
    lead = found.filter("leads").select(F.col("doc_id").alias("lead_id"), F.col("text_key").alias("lead_key")).distinct()
    whole = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"), col(id_column).cast("long").alias("own_id"), F.xxhash64(col(text_column)).alias("own_key")
    )
    kept = whole.join(lead, F.col("own_id").eqNullSafe(F.col("lead_id")) & (F.col("own_key") == F.col("lead_key")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_key"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])


#: Shared by the batches of a worker process.
WORDS = WordHashes()
