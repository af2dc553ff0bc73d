"""SentencePiece BPE encoding by vectorised merge rounds, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHED_WORDS = 1_000_000
#: Of the pair tables: the size as a power of two, and the odd multipliers of their hash.
SLOT_BITS = 20
FACTORS = tuple(np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: New words merged together in one call, in characters; rows worked on together.
BATCH_CHARS, ROWS = 500_000, 500


class PieceTable:
    """Pieces, scores and mergeable pairs of a BPE model with byte fallback.

    ``pairs`` are keys ``left * size + right`` over symbols; a symbol is a piece's id, or, for a
    character that is no piece, a number from ``size`` on, which merges with nothing. ``rank`` orders
    the pieces by falling score, equal for equal scores. ``settled`` says of a piece that every longer piece starting or ending
    with it has a worse rank: all its pairs in a word can then be merged at once, because no merge that
    one of them makes possible would come before the next of them.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        names = [model.id_to_piece(i) for i in range(self.size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(self.size)]
        self.ids = {name: i for i, name in enumerate(names) if not special[i]}
        own = sorted(self.ids.values())
        self.rank = np.full(self.size, self.size, np.int64)
        self.rank[own] = np.unique([-model.get_score(i) for i in own], return_inverse=True)[1]
        self.bytes = [0] * 256
        self.text = [b""] * self.size
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.bytes[int(name[1:-1], 16)] = i
                self.text[i] = bytes([int(name[1:-1], 16)])
            elif not special[i]:
                self.text[i] = name.replace(SPACE, " ").encode()
        self.text[self.unknown] = " ⁇ ".encode()
        keys, merged = [], []
        self.settled = np.ones(self.size, bool)
        for name, i in self.ids.items():
            for cut in range(1, len(name)):
                left, right = self.ids.get(name[:cut]), self.ids.get(name[cut:])
                for part in (left, right):
                    if part is not None and self.rank[i] <= self.rank[part]:
                        self.settled[part] = False
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(i)
        self.pairs, self.merged = np.array(keys, np.uint64), np.array(merged, np.int64)
        self._hash()

    def _hash(self) -> None:
        """Tables of places in ``pairs``: a pair whose slot in one table is taken goes to the next."""
        self.slots = np.zeros((len(FACTORS), 1 << SLOT_BITS), np.int32)
        left = np.arange(len(self.pairs), dtype=np.int32)
        for table, factor in zip(self.slots, FACTORS):
            slot = (self.pairs[left] * factor) >> np.uint64(64 - SLOT_BITS)
            table[slot[::-1]] = left[::-1]
            left = left[table[slot] != left]
        if len(left):
            raise ValueError("the model has too many pairs for the tables; raise SLOT_BITS")

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair merges to, or -1."""
        key = (left * self.size + right).astype(np.uint64)
        out = np.full(len(key), -1, np.int64)
        for table, factor in zip(self.slots, FACTORS):
            at = table[(key * factor) >> np.uint64(64 - SLOT_BITS)]
            found = self.pairs[at] == key
            out[found] = self.merged[at[found]]
        out[(left >= self.size) | (right >= self.size)] = -1
        return out

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each word; spaces are already ``SPACE``.

        All words lie behind each other in one symbol array. In each round, every word merges its
        best-ranked pair: the leftmost one, or all that do not overlap, counted from the left, if the
        piece is settled. Merged-away symbols are squeezed out, finished words leave the array.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        known, back = np.unique(letters, return_inverse=True)
        codes = np.array([self.ids.get(chr(c), self.size + int(c)) for c in known], np.int64)
        symbols, word = codes[back], np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = np.append(np.where(word[1:] == word[:-1], self.joined(symbols[:-1], symbols[1:]), -1), -1)[: len(symbols)]
        while len(symbols):
            rank = np.where(pair >= 0, self.rank[pair], self.size)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(word)))
            active = np.repeat(best < self.size, sizes)
            if not active.all():
                done.append((word[~active], symbols[~active]))
                symbols, word, pair, rank = symbols[active], word[active], pair[active], rank[active]
                sizes, best = sizes[best < self.size], best[best < self.size]
                if not len(symbols):
                    break
                first = np.cumsum(sizes) - sizes
            hit = rank == np.repeat(best, sizes)
            # of pairs that overlap, every second one from the left; unless settled, only the leftmost
            place = np.flatnonzero(hit)
            run = np.append(True, np.diff(place) > 1)
            lead = np.append(True, word[place[1:]] != word[place[:-1]])
            run |= lead
            start = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            take = place[((np.arange(len(place)) - start) % 2 == 0) & (self.settled[pair[place]] | lead)]
            symbols[take] = pair[take]
            keep = np.ones(len(symbols), bool)
            keep[take + 1] = False
            fresh = np.zeros(len(symbols), bool)
            fresh[take] = True
            symbols, word, pair, fresh = symbols[keep], word[keep], pair[keep], fresh[keep]
            look = np.flatnonzero(fresh | np.append(fresh[1:], False))
            inside = look[(look + 1 < len(word))]
            pair[look] = -1
            inside = inside[word[inside] == word[inside + 1]]
            pair[inside] = self.joined(symbols[inside], symbols[inside + 1])
        if not done:
            return [b""] * len(words)
        word, symbols = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        place = np.argsort(word, kind="stable")
        word, symbols = word[place], symbols[place]
        if (symbols >= self.size).any():
            spelled = [[s] if s < self.size else [self.bytes[b] for b in chr(s - self.size).encode()] for s in symbols.tolist()]
            word = np.repeat(word, [len(s) for s in spelled])
            symbols = np.array([i for s in spelled for i in s], np.int64)
        flat = symbols.astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def decode(self, ids: bytes) -> str:
        """Text of ids: the space that encoding puts in front goes, broken byte sequences become U+FFFD."""
        text = self.text
        data = b"".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class Encoder:
    """Encodes texts; each distinct word is merged once while it stays in the cache."""

    #: A word with the spaces before it: no piece holds a space after another character.
    STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")

    def __init__(self, table: PieceTable) -> None:
        self.table, self.cache = table, {}
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (table.begin, table.end))

    def _learn(self, fresh: list[str]) -> None:
        start = 0
        while start < len(fresh):
            stop, chars = start, 0
            while stop < len(fresh) and chars < BATCH_CHARS:
                chars += len(fresh[stop])
                stop += 1
            self.cache.update(zip(fresh[start:stop], self.table.merge(fresh[start:stop])))
            start = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end ids; an empty text has these two alone."""
        split = [self.STRETCH.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        cache = self.cache
        found = set().union(*split)
        fresh = found - cache.keys()
        if len(cache) + len(fresh) > CACHED_WORDS:
            cache.clear()
            fresh = found
        self._learn(sorted(fresh, key=len))
        return [self.begin + b"".join([cache[w] for w in words]) + self.end for words in split]


def encode_pieces(
    docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Encode every whole text with a SentencePiece BPE model, then decode the ids.

    One row per row of ``docs``: doc_id, ids (with begin and end ids, little-endian unsigned 32-bit) and
    decoded. A null text counts as empty: begin and end id, decoded to an empty text. Repeated rows and null
    ids stay as they are, an empty table gives no rows, other columns are ignored. A row needs nothing
    from another, so there is no shuffle and a lost task is simply run again.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = PieceTable(model_path)
        encoder = Encoder(table)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                ids = encoder.encode(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": ids, "decoded": [table.decode(i) for i in ids]})

    return rows.mapInPandas(encode, "doc_id long, ids binary, decoded string")
