"""Packing of tokenised documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import saved

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)
#: Tokens gathered before a round of packing, and tokens that a second-pass task packs.
BLOCK_TOKENS, TASK_TOKENS = 1_000_000, 4_000_000
CACHED_WORDS = 700_000


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit) of a text between two spaces or line breaks.

    The vocabulary lower-cases, splits and merges inside such a stretch only, so each distinct one
    is encoded once. Plain Latin stretches take the split and the merges of the loaded tokenizer
    directly; all others go through its whole ``encode``.
    """

    PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}

    def _part(self, part: str) -> bytes:
        # printable ASCII stands for itself
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
        if len(self.parts) >= CACHED_WORDS:
            self.parts.clear()
        self.parts[part] = ids
        return ids

    def __missing__(self, stretch: str) -> bytes:
        known = self.parts
        if stretch.isascii() and stretch.isalpha():  # one part
            part = stretch.lower()
            ids = known.get(part) or self._part(part)
        elif self.PLAIN.fullmatch(stretch) and "<|" not in stretch:
            ids = b"".join([known.get(p) or self._part(p) for p in self.PARTS.findall(stretch.lower())])
        else:
            ids = np.array(self.tokenizer.encode(stretch, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[stretch] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):  # a composition may reach across anything
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self[w] for w in text.replace("\n", " ").split(" ")])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The vocabulary with the words met so far: a Python worker keeps them from one task to the next."""
    return WordIds(path)


def fullest_set(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The multiset of ``lengths`` (descending, ``counts`` copies each) whose sum is nearest below ``capacity``.

    ``reach`` has bit s set when some sub-multiset sums to s. The bitset before each length is kept, so
    the number of copies of every length is read off backwards.
    """
    mask, reach, trail = (1 << capacity + 1) - 1, 1, []
    for length in lengths:
        left = min(counts[length], capacity // length)
        if left <= 0:
            continue
        trail.append((length, reach))
        step = 1
        while left > 0:
            taken = min(step, left)
            reach |= (reach << taken * length) & mask
            left -= taken
            step *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(trail):
        copies = 0
        while not before >> total & 1:
            total -= length
            copies += 1
        if copies:
            chosen[length] = copies
    return chosen


def plan_windows(counts: dict[int, int], window: int, max_slack: int) -> tuple[list[dict[int, int]], dict[int, int]]:
    """Windows as {length: copies}, and the counts left over because no set fills a window well enough.

    Each window starts with the longest piece left; a set is repeated while the counts allow it, so the
    number of searches follows the number of different lengths, not of pieces.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    lengths, windows, rest = sorted(left, reverse=True), [], {}
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        chosen = fullest_set(left, lengths, window - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        if window - sum(k * v for k, v in chosen.items()) > max_slack:
            rest[longest] = left.pop(longest)
        else:
            times = min(left[k] // v for k, v in chosen.items())
            windows += [chosen] * times
            for k, v in chosen.items():
                left[k] -= v * times
        lengths = [k for k in lengths if left.get(k, 0) > 0]
    return windows, rest


class Packer:
    """Packs one task's pieces, a block at a time; what does not fill a window stays for the next block."""

    def __init__(self, window: int, max_slack: int, first_sequence: int) -> None:
        self.window, self.max_slack, self.sequence = window, max_slack, first_sequence
        self.waiting: list[tuple] = []
        self.tokens = 0

    def add(self, piece: tuple) -> list[tuple]:
        """piece: (doc_id, start, length, ids, doc_tokens). Returns the rows placed by this call."""
        if piece[2] == self.window:
            return self._place([piece])
        self.waiting.append(piece)
        self.tokens += piece[2]
        return self.pack() if self.tokens >= BLOCK_TOKENS else []

    def _place(self, pieces: list[tuple]) -> list[tuple]:
        rows, offset = [], 0
        for piece in pieces:
            rows.append((*piece, self.sequence, offset))
            offset += piece[2]
        self.sequence += 1
        return rows

    def pack(self) -> list[tuple]:
        by_length: dict[int, list[tuple]] = {}
        for piece in self.waiting:
            by_length.setdefault(piece[2], []).append(piece)
        windows, rest = plan_windows({k: len(v) for k, v in by_length.items()}, self.window, self.max_slack)
        rows = []
        for chosen in windows:
            rows += self._place([by_length[k].pop() for k, v in chosen.items() for _ in range(v)])
        loose = [piece for k in sorted(rest, reverse=True) for piece in by_length[k]]
        rows += self._cut(loose, [self.window] * (sum(p[2] for p in loose) // self.window))
        self.tokens = sum(p[2] for p in self.waiting)
        return rows

    def _cut(self, pieces: list[tuple], sizes: list[int]) -> list[tuple]:
        """Fill sequences of the given sizes with the pieces in turn, cutting at the borders; the others wait."""
        rows, queue = [], pieces[::-1]
        for size in sizes:
            filled, taken = 0, []
            while filled < size:
                doc, start, length, ids, total = queue.pop()
                part = min(length, size - filled)
                taken.append((doc, start, part, ids[: 4 * part], total))
                filled += part
                if part < length:
                    queue.append((doc, start + part, length - part, ids[4 * part :], total))
            rows += self._place(taken)
        self.waiting = queue[::-1]
        return rows

    def finish(self) -> list[tuple]:
        """Pack everything; what is less than a window is cut into powers of two, which need no padding."""
        rows = self.pack()
        left = sum(p[2] for p in self.waiting)
        return rows + self._cut(self.waiting, [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    out = pd.DataFrame(rows, columns=columns)
    for name in ("doc_id", "sequence_id", "offset"):
        out[name] = out[name].astype("Int64")
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    end_id: int = 1,
    max_slack: int = 8,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Tokenise every text, end it with ``end_id`` and pack the ids into windows of at most ``window`` tokens.

    Minimum bin slack: a window takes its longest waiting piece, and a bitset of reachable sums picks the
    multiset of waiting lengths that leaves the least room; windows with more than ``max_slack`` tokens of
    room are not used, their pieces are cut at window borders instead. Documents longer than a window give
    whole windows first. Each task packs its own rows block by block, without a shuffle; the pieces that fill
    no window (less than one window per task) are packed together in a second pass, where the last of
    them go to sequences of a power of two. Sequences are thus full up to ``max_slack``.

    One row per piece: doc_id, start (ids of the document before it), length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset in the sequence. A null text counts as empty and gives the end
    id alone; repeated rows are packed each for itself; a null id stays null; an empty table gives no rows;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(tokenizer_path)
        packer = Packer(window, max_slack, TaskContext.get().partitionId() << 32)
        out, size = [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                doc = None if pd.isna(doc) else int(doc)
                ids = (words.encode(text) if text is not None else b"") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    placed = packer.add((doc, start, len(piece) // 4, piece, total))
                    out += placed
                    size += sum(p[2] for p in placed)
                    if size >= BLOCK_TOKENS:
                        yield _frame(out)
                        out, size = [], 0
        out += packer.pack()
        out += [(*piece, None, None) for piece in packer.waiting]
        yield _frame(out)

    def second_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(window, max_slack, (1 << 62) + (TaskContext.get().partitionId() << 32))
        for batch in batches:
            out = []
            for doc, start, length, ids, total in zip(*[batch[c] for c in batch.columns[:5]]):
                out += packer.add((None if pd.isna(doc) else int(doc), start, length, ids, total))
            yield _frame(out)
        yield _frame(packer.finish())

    first = saved(rows.mapInPandas(first_pass, PIECES), "packing")
    loose = first.filter("sequence_id is null")
    tokens = loose.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    again = loose.repartition(max(1, -(-tokens // TASK_TOKENS))).mapInPandas(second_pass, PIECES)
    return first.filter("sequence_id is not null").unionByName(again)
