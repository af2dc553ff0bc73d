"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import col

UNKNOWN = "und"
#: Characters worked on together, and characters after which a very long text is cut (at a space).
BATCH_CHARS, PART_CHARS = 400_000, 1_000_000
#: Letter groups whose vectors a worker keeps.
KEPT_VECTORS = 40_000


class Profiles:
    """Vectors of letter groups: permuted random letter vectors bound together by multiplication.

    A letter's vector of +1 and -1 depends on the letter alone. In a group, the vector of the k-th
    letter from the end is rotated by k places; the product of the rotated vectors is the group's vector.
    Letters count in lower case; everything else is one gap between words, a symbol like the letters.
    """

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions
        self.symbols = np.full(0x110000, -1, np.int32)
        self.letters: dict[int, np.ndarray] = {}
        self.groups: dict[int, np.ndarray] = {}

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        found = self.symbols[points]
        if (found < 0).any():
            for c in np.unique(points[found < 0]).tolist():
                self.symbols[c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
            found = self.symbols[points]
        return found

    def _letter(self, symbol: int) -> np.ndarray:
        if symbol not in self.letters:
            self.letters[symbol] = (np.random.default_rng([2, symbol]).integers(0, 2, self.dimensions) * 2 - 1).astype(np.int8)
        return self.letters[symbol]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        known = self.groups
        if len(known) > KEPT_VECTORS:
            known.clear()
        out = np.empty((len(codes), self.dimensions), np.float32)
        for row, code in enumerate(codes.tolist()):
            vector = known.get(code)
            if vector is None:
                a, b, c = (self._letter(code >> shift & 0x1FFFFF) for shift in (42, 21, 0))
                vector = known[code] = np.roll(a, 2) * np.roll(b, 1) * c
            out[row] = vector
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes of the letter groups that occur, counts by text and code, whether each text has a letter)."""
        points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        symbols, owner = self._symbols(points), np.append(owner, len(texts) - 1)
        lettered = np.bincount(owner, symbols > 0, minlength=len(texts)) > 0
        keep = (symbols != 0) | np.append(True, symbols[:-1] != 0)
        symbols, owner = symbols[keep].astype(np.int64), owner[keep]
        a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
        inside = (b != 0) | (owner[:-2] == owner[2:])
        codes = (a << 42 | b << 21 | c)[inside]
        of = np.where(b != 0, owner[1:-1], owner[:-2])[inside]
        codes, at = np.unique(codes, return_inverse=True)
        counted = np.bincount(of * len(codes) + at, minlength=len(texts) * len(codes))
        return codes, counted.reshape(len(texts), len(codes)), lettered


def _parts(text: str) -> list[str]:
    """The text itself, or pieces of a very long one, cut at spaces where there are any."""
    parts, start = [], 0
    while len(text) - start > PART_CHARS:
        stop = text.rfind(" ", start, start + PART_CHARS) + 1 or start + PART_CHARS
        parts.append(text[start:stop])
        start = stop
    return [*parts, text[start:]]


def bundled(profiles: Profiles, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, vectors, lettered) of consecutive texts; a text's vector is the sum of its groups' vectors."""
    start = 0
    while start < len(texts):
        stop, chars, pieces, of = start, 0, [], []
        while stop < len(texts) and chars < BATCH_CHARS:
            for part in _parts(texts[stop] or ""):
                pieces.append(part)
                of.append(stop - start)
            chars += len(texts[stop] or "")
            stop += 1
        vectors, lettered = np.zeros((stop - start, profiles.dimensions), np.float32), np.zeros(stop - start, bool)
        step = len(pieces) if chars < 2 * BATCH_CHARS else 1
        for at in range(0, len(pieces), step):
            codes, counted, has = profiles.counts(pieces[at : at + step])
            np.add.at(vectors, of[at : at + step], counted.astype(np.float32) @ profiles.vectors(codes))
            np.logical_or.at(lettered, of[at : at + step], has)
        yield start, stop, vectors, lettered
        start = stop


def held_out(doc_id: Column) -> Column:
    """A fixed quarter of the ids, never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_prototypes(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", dimensions: int = 1024
) -> dict[str, np.ndarray]:
    """The bundled vector of all letters groups of each language's texts.

    Tasks add up their own texts by language, Spark adds up the tasks; the driver gets one vector per value of
    ``lang_column``, whose number is that of the labels' set and does not grow with the rows. Rows with a null text or language
    teach nothing.
    """
    rows = docs.select(col(text_column).alias("text"), col(lang_column).cast("string").alias("lang"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles, sums = Profiles(dimensions), {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                total = sums.setdefault(lang, np.zeros(dimensions))
                texts, start = part["text"].tolist(), 0
                while start < len(texts):
                    stop, chars = start, 0
                    while stop < len(texts) and chars < BATCH_CHARS:
                        chars += len(texts[stop])
                        stop += 1
                    for piece in _parts("\n".join(texts[start:stop])):
                        codes, counted, _ = profiles.counts([piece])
                        total += counted[0].astype(np.float32) @ profiles.vectors(codes)
                    start = stop
        yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    taught = rows.dropna().mapInPandas(learn, "lang string, vector array<double>")
    summed = taught.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = {}
    for lang, at, value in summed.orderBy("lang", "at").toLocalIterator():
        found.setdefault(lang, np.zeros(dimensions))[at] = value
    return found


class Guess:
    """Compares texts with the prototypes of the languages."""

    def __init__(self, prototypes: dict[str, np.ndarray]) -> None:
        self.names = sorted(prototypes)
        self.dimensions = len(prototypes[self.names[0]]) if self.names else 1
        self.profiles = Profiles(self.dimensions)
        units = [prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in self.names]
        self.matrix = np.stack(units).T.astype(np.float32) if units else None

    def over(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last + 1, languages, scores) of consecutive texts."""
        for start, stop, vectors, lettered in bundled(self.profiles, texts):
            lang, score = np.full(stop - start, UNKNOWN, object), np.zeros(stop - start)
            if self.names:
                length = np.linalg.norm(vectors, axis=1)
                cosine = (vectors @ self.matrix) / np.where(length > 0, length, 1)[:, None]
                best = cosine.argmax(axis=1)
                lang = np.where(lettered, np.array(self.names, object)[best], UNKNOWN)
                score = np.where(lettered, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(float)
            yield start, stop, lang, score


def identify_language(
    docs: DataFrame, prototypes: dict[str, np.ndarray], id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Predict each whole text's language: the prototype whose cosine with the text's vector is largest.

    One row per row: doc_id, lang_pred and score (that cosine, 0 at least). Texts that are null or
    have no letter get ``und`` and 0; ties go to the language first in alphabetical order; with no
    prototype all are ``und``. Repeated rows and null ids stay, other columns are never looked at, an
    empty table gives no rows. No shuffle.
    """
    rows = docs.select(col(id_column).cast("long").alias("doc_id"), col(text_column).alias("text"))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guess = Guess(prototypes)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for start, stop, lang, score in guess.over(texts):
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[start:stop].astype("Int64"), "lang_pred": lang, "score": score})

    return rows.mapInPandas(predict, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], text_column: str = "text", above: float = 0.0) -> DataFrame:
    """The rows of ``docs``, unchanged, that have a letter and a score greater than ``above``: what is like no language goes.

    Texts of a word or two have small scores too, so the default asks for any likeness only.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = Guess(prototypes)
        for batch in batches:
            texts = batch.column(text_column).to_pylist()
            good = np.zeros(len(texts), bool)
            for start, stop, lang, score in guess.over(texts):
                good[start:stop] = (lang != UNKNOWN) & (score > above)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
