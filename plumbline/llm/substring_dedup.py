"""Passages that stand in an earlier document, found by rolling hashes of every window of words and cut out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions.frames import col

CACHED_WORDS = 200_000
#: Windows whose repetitions a task settles itself before the rest is shuffled, windows that meet in a task after it, and
#: rows and texts handled at a time.
CHUNK_WINDOWS, BUCKET_WINDOWS, BATCH_ROWS, SLICE_ROWS = 1_000_000, 1_000_000, 250_000, 500
CHARACTERS_PER_WORD = 6  # only the number of buckets depends on it
#: Of the key that stands for a window: steps between sorted keys of a chunk so take five bytes.
KEY_BITS = 58
PACKED = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
PACKED_SCHEMA = pa.schema(list(zip(("bucket", "steps", "checks", "ids"), PACKED)))
FOUND = {"n_words": "long", "n_removed": "long", "starts": "array<long>", "ends": "array<long>", "kept": "binary"}
#: Odd bases of the two rolling hashes modulo 2**64, and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


class WordHashes(dict):
    """64-bit hash of a word; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: Shared by the batches of a worker process.
WORDS = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Powers:
    """The powers of a base modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.known):
            steps = np.full(max(n, 2 * len(self.known)), self.base, np.uint64)
            steps[0] = 1
            self.known = np.cumprod(steps, dtype=np.uint64)
        return self.known[:n]


RISING, FALLING = [[Powers(b) for b in bases] for bases in (BASES, INVERSES)]


def rolled(hashes: np.ndarray, width: int, lane: int) -> np.ndarray:
    """The polynomial hash of each run of ``width`` word hashes, modulo 2**64.

    With S the running sum of hash k times base**-k, a window from i is (S after it - S before it) times
    base**(i + width - 1): each step along the text costs the same whatever the width.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * FALLING[lane].upto(len(hashes)), out=sums[1:], dtype=np.uint64)
    return (sums[width:] - sums[:-width]) * RISING[lane].upto(len(hashes))[width - 1 :]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def window_keys(hashes: np.ndarray, width: int) -> np.ndarray:
    """The upper ``KEY_BITS`` bits of every window's first hash."""
    return (rolled(hashes, width, 0) >> np.uint64(64 - KEY_BITS)).view(np.int64)


def window_checks(hashes: np.ndarray, width: int) -> np.ndarray:
    """16 further bits of every window, the upper ones of a polynomial over scrambled word hashes."""
    other = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (rolled(other ^ (other >> np.uint64(33)), width, 1) >> np.uint64(48)).astype(np.uint16)


def planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on; those that hardly change compress to nothing."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def by_window(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """An order in which equal windows lie side by side and keys rise."""
    order = np.argsort(key)
    key, check = key[order], check[order]
    if ((key[1:] == key[:-1]) & (check[1:] != check[:-1])).any():  # different windows of one key
        return order[np.lexsort((check, key))]
    return order


def least_of_equal(key: np.ndarray, check: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of windows in order of their key the smallest document that holds the same one."""
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
    return np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]


def settled(ids: np.ndarray, key: np.ndarray, check: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows of a chunk (each once per document) packed by bucket, a range of keys.

    Only of a window's smallest document other chunks can still tell whether it stands in an earlier one. For the
    others of the chunk that is sure; they go to buckets under 0, which are handed on as they are.
    """
    key = key.view(np.uint64)
    order = by_window(key, check)
    key, check, ids = key[order], check[order], ids[order]
    first = ids == least_of_equal(key, check, ids)
    sure = np.flatnonzero(~first)
    out = []
    for i in range(0, len(sure), BATCH_ROWS):
        part = sure[i : i + BATCH_ROWS]
        out.append((-1 - int(key[part[0]]), planes(key[part]), b"", planes(ids[part])))
    key, check, ids = key[first], check[first], ids[first]
    bucket = ((key >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(starts, [*starts[1:], len(key)]):
        steps = np.diff(key[a:b], prepend=np.uint64(0))
        out.append((int(bucket[a]), planes(steps), planes(check[a:b]), planes(ids[a:b])))
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), PACKED)], schema=PACKED_SCHEMA)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    """The rows one by one; only a slice of a batch is held as Python's strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield from zip(part.column("id").to_pylist(), part.column("text").to_pylist())


def _windows(width: int, chunk_windows: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, checks, waiting = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, keys, checks, waiting
            if waiting:
                yield from settled(np.concatenate(ids), np.concatenate(keys), np.concatenate(checks), buckets)
            ids, keys, checks, waiting = [], [], [], 0

        for doc_id, text in _texts(batches):
            words = words_of(text)
            if len(words) < width:
                continue
            hashes = word_hashes(words)
            key, at = np.unique(window_keys(hashes, width), return_index=True)
            check = window_checks(hashes, width)[at]
            ids.append(np.full(len(key), doc_id, np.int64))
            keys.append(key)
            checks.append(check)
            waiting += len(key)
            if waiting >= chunk_windows:
                yield from flush()
        yield from flush()

    return run


def _met(bucket: pd.DataFrame) -> pd.DataFrame:
    """(id, key) of the windows of a bucket that a document of smaller id holds too."""
    key = [from_planes(x, np.uint64) for x in bucket["steps"]]
    ids = np.concatenate([from_planes(x, np.int64) for x in bucket["ids"]])
    if bucket["bucket"].iloc[0] < 0:
        key = np.concatenate(key)
        return pd.DataFrame({"id": ids, "key": key.view(np.int64)})
    key = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in key])
    check = np.concatenate([from_planes(x, np.uint16) for x in bucket["checks"]])
    order = by_window(key, check)
    key, check, ids = key[order], check[order], ids[order]
    later = ids > least_of_equal(key, check, ids)
    return pd.DataFrame({"id": ids[later], "key": key[later].view(np.int64)})


def intervals(hit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the longest runs of words that the marked windows cover."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    breaks = np.flatnonzero(np.diff(at) > width)
    return at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])] + width


def _cut(width: int, schema: pa.Schema):
    def cut(text: str | None, repeated: np.ndarray | None) -> tuple:
        words = words_of(text)
        starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if repeated is not None:
            starts, ends = intervals(np.isin(window_keys(word_hashes(words), width), repeated), width)
        kept, last = [], 0
        for start, end in zip(starts, ends):
            kept += words[last:start]
            last = end
        kept += words[last:]
        return len(words), int((ends - starts).sum()), starts, ends, b" ".join(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                lists = (r.values.to_numpy() if r.is_valid else None for r in part.column("repeated"))
                out = [cut(t, r) for t, r in zip(part.column("text").to_pylist(), lists)]
                columns = [pa.array([x[i] for x in out], schema.field(name).type) for i, name in enumerate(FOUND)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns, part.column("source")], names=["id", *FOUND, "source"])

    return run


def repeated_windows(docs: DataFrame, width: int, chunk_windows: int, bucket_windows: int) -> DataFrame:
    """(id, key): the windows of each document (columns ``id`` and ``text``) that also start in one of smaller id."""
    texts = docs.filter("id is not null and text is not null").select("id", "text")
    characters = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-characters // (CHARACTERS_PER_WORD * bucket_windows)))
    packed = texts.mapInArrow(_windows(width, chunk_windows, buckets), "bucket long, steps binary, checks binary, ids binary")
    return packed.groupBy("bucket").applyInPandas(_met, "id long, key long")


def remove_repeated_passages(
    docs: DataFrame, width: int = 13, id_column: str = "doc_id", text_column: str = "text",
    chunk_windows: int = CHUNK_WINDOWS, bucket_windows: int = BUCKET_WINDOWS,
) -> DataFrame:
    """Cut out of each document the words covered by a window of ``width`` words that also starts in a document of smaller id.

    1. Every window of every text is hashed by two rolling polynomials (74 bits in all). Within a chunk of about
       ``chunk_windows`` windows of a task, all but the smallest document of a window are settled, so that one which
       stands in every document goes on once a chunk.
    2. One shuffle brings the rest together in ranges of hashes, buckets of about ``bucket_windows`` windows whose number grows with
       the texts; there the smallest document of each window over all chunks is found. Keys travel as packed steps
       from one to the next.
    3. A document's repeated windows are brought to its text, hashed again there, and merged into the longest
       intervals to remove.

    One row per row of ``docs``: doc_id, n_words, n_removed, starts and ends (of the removed intervals, in words, end
    exclusive), kept (the words left, joined by one space) and the other columns of ``docs`` as struct ``source``. Words are
    runs of anything but ASCII white space. Windows are judged on the input, not on what is left. A null or blank text has
    no words; one with fewer than ``width`` is left whole. A document repeated under one id is no smaller than itself, so
    both copies stay as far as no other id precedes them. A null id precedes nothing and is preceded by nothing.
    Extra columns of any name do no harm; an empty table gives no rows. Equal hashes of different windows would cut
    too much: among 10**13 windows 2,600 are expected, among 10**10 none (3e-3).
    """
    others = [c for c in docs.columns if c not in (id_column, text_column)]
    whole = docs.select(
        col(id_column).cast("long").alias("id"), col(text_column).cast("string").alias("text"),
        F.struct(*[col(c) for c in others] or [F.lit(None).cast("string").alias("none")]).alias("source"),
    )
    # not written in between: the lists stay where the join wants them
    found = repeated_windows(whole, width, chunk_windows, bucket_windows).groupBy("id").agg(F.collect_list("key").alias("repeated"))
    joined = whole.join(found.withColumnRenamed("id", "repeated_id"), F.col("id") == F.col("repeated_id"), "left").select(
        "id", "text", "repeated", "source"
    )
    out = T.StructType.fromDDL("id long, " + ", ".join(f"{n} {t}" for n, t in FOUND.items())).add(joined.schema["source"])
    cut = joined.mapInArrow(_cut(width, to_arrow_schema(out)), out)
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "starts", "ends", F.col("kept").cast("string").alias("kept"), "source")
