"""Personal data in texts: fixed patterns, made consistent over each document by a skip-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in their order. Label 0 is "none", label k the k-th kind.
KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, which the look-behind says so that long runs are passed once
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNAL = re.compile(r"[0-9@]")
TOKEN_END = re.compile(r"\S*")
NOT_DIGIT = re.compile(r"[^0-9]")
EDGE = "\"'.,;:!?()[]{}<>|*#"

#: Dimensions of the hashed features, labelled tokens to learn from at most, rounds of learning.
FEATURES, SAMPLE, EPOCHS = 1 << 10, 20_000, 60
#: Message passing ends once no message moves by more than SETTLED, and at the latest after PASSES rounds.
SETTLED, PASSES = 1e-4, 1000
#: Log-potential of equal labels on a skip edge, of a rule's own label, and the probability from which a span is added.
SKIP, EVIDENCE, SURE = 6.0, 30.0, 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind from 1, end) of the fixed patterns' matches, by start and kind; each kind from the left without overlap."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, 1, end))
        at = text.find("@", at + 1)
    if not SIGNAL.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append((m.start(), 2, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 3, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 4, m.end()))
    return sorted(found)


@dataclass
class Tokens:
    """The tokens of some texts that hold a digit or an at sign; all others have the label "none" and cut the chain."""

    doc: list[int]
    start: list[int]
    end: list[int]
    label: list[int]  # of the base span that covers it, else 0
    core: list[str]  # what makes tokens similar: the digits, or the address in lower case; empty if too short
    shape: list[str]
    follows: list[bool]  # only white space lies between it and the token before

    def __len__(self) -> int:
        return len(self.doc)


def shape_of(token: str) -> str:
    """Digits become 9, letters a; runs of more than four are cut to four, the whole to 24 characters."""
    kinds = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", token[:200]))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", kinds)[:24]


def signal_tokens(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> Tokens:
    out = Tokens([], [], [], [], [], [], [])
    for doc, text in enumerate(texts):
        last, at, signal = 0, 0, SIGNAL.search(text)
        while signal:
            start = signal.start()
            while start > last and not text[start - 1].isspace():
                start -= 1
            end = TOKEN_END.match(text, start).end()
            token = text[start:end]
            while at < len(spans[doc]) and spans[doc][at][2] <= start:
                at += 1
            covering = next((k for a, k, b in spans[doc][at : at + 4] if a < end and b > start), 0)
            digits = NOT_DIGIT.sub("", token)
            core = token.strip(EDGE).lower() if "@" in token else digits
            out.doc.append(doc)
            out.start.append(start)
            out.end.append(end)
            out.label.append(covering)
            out.core.append(core if len(core) >= 3 else "")
            out.shape.append(shape_of(token))
            out.follows.append(len(out) > 1 and out.doc[-2] == doc and not text[last:start].strip() and last > 0)
            last = end
            signal = SIGNAL.search(text, end)
    return out


def _slot(name: str) -> int:
    value = 2166136261
    for b in name.encode():
        value = (value ^ b) * 16777619 & 0xFFFFFFFF
    return value % FEATURES


def feature_slots(tokens: Tokens) -> np.ndarray:
    """Hashed features of each token: its shape, its neighbours' shapes, and its set of characters."""
    n, shape, follows = len(tokens), tokens.shape, tokens.follows
    rows = []
    for i in range(n):
        before = shape[i - 1] if follows[i] else ""
        behind = shape[i + 1] if i + 1 < n and follows[i + 1] else ""
        rows.append([_slot("s" + shape[i]), _slot("b" + before), _slot("n" + behind), _slot("c" + "".join(sorted(set(shape[i]))))])
    return np.array(rows, np.int64).reshape(n, 4)


@dataclass(frozen=True)
class Field:
    """weights: features by labels; chain: log-potentials of labels of tokens that follow each other."""

    weights: np.ndarray
    chain: np.ndarray


def fit_field(slots: np.ndarray, labels: np.ndarray, before: np.ndarray) -> Field:
    """Softmax weights by gradient descent, and smoothed log-odds of neighbouring labels (``before``: -1 for none)."""
    weights = np.zeros((FEATURES, LABELS))
    if not len(labels):
        return Field(weights, np.zeros((LABELS, LABELS)))
    truth = np.eye(LABELS)[labels]
    for _ in range(EPOCHS):
        score = weights[slots].sum(axis=1)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        error = truth - score / score.sum(axis=1, keepdims=True)
        step = np.zeros_like(weights)
        np.add.at(step, slots.ravel(), np.repeat(error, slots.shape[1], axis=0))
        weights += 0.5 * step / np.maximum(np.bincount(slots.ravel(), minlength=FEATURES), 1)[:, None]
    seen = np.ones((LABELS, LABELS))
    np.add.at(seen, (before[before >= 0], labels[before >= 0]), 1)
    joint = seen / seen.sum()
    return Field(weights, np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))))


def edges_of(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, int]:
    """(pairs, whether a skip edge, hubs): neighbours in the text, and each token with the hub of its core in its document.

    A hub is a variable without evidence of its own, numbered behind the tokens, for each core that a document has more than
    once; so all repetitions are two links apart, however many there are.
    """
    pairs, skip, members = [], [], {}
    for i in range(len(tokens)):
        if tokens.follows[i]:
            pairs.append((i - 1, i))
            skip.append(False)
        if tokens.core[i]:
            members.setdefault((tokens.doc[i], tokens.core[i]), []).append(i)
    repeated = [own for own in members.values() if len(own) > 1]
    for hub, own in enumerate(repeated, len(tokens)):
        pairs += [(i, hub) for i in own]
        skip += [True] * len(own)
    return np.array(pairs, np.int64).reshape(-1, 2), np.array(skip, bool), len(repeated)


def marginals(tokens: Tokens, field: Field) -> np.ndarray:
    """Label probabilities of each token by loopy message passing over chain and skip edges of all documents at once."""
    own = field.weights[feature_slots(tokens)].sum(axis=1)
    labels = np.array(tokens.label)
    own[np.arange(len(tokens)), labels] += np.where(labels > 0, EVIDENCE, 0)
    pairs, skip, hubs = edges_of(tokens)
    belief = np.concatenate([own, np.zeros((hubs, LABELS))])
    if len(pairs):
        potential = np.where(skip[:, None, None], SKIP * np.eye(LABELS), field.chain)
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        messages = np.zeros((len(source), LABELS))
        # documents share no edge: those whose messages have settled are left out of later rounds
        doc = np.array(tokens.doc)[pairs[:, 0]]
        doc = np.concatenate([doc, doc])
        moving = np.arange(len(source))
        for _ in range(PASSES):
            heard = belief.copy()
            np.add.at(heard, target[moving], messages[moving])
            sent = (heard[source[moving]] - messages[back[moving]])[:, :, None] + potential[moving]
            fresh = np.logaddexp.reduce(sent, axis=1)
            fresh = fresh - fresh.max(axis=1, keepdims=True)
            moved = np.abs(fresh - messages[moving]).max(axis=1) > SETTLED
            messages[moving] = 0.5 * messages[moving] + 0.5 * fresh
            moving = moving[np.isin(doc[moving], doc[moving][moved])]
            if not len(moving):
                break
        np.add.at(belief, target, messages)
    belief = belief[: len(tokens)]
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def added_spans(texts: list[str], tokens: Tokens, chance: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Spans of neighbouring tokens of one label that no rule covers but the field is sure of, without punctuation at the ends."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    best, sure = chance.argmax(axis=1), chance.max(axis=1) >= SURE
    open_ = None
    for i in range(len(tokens)):
        free = tokens.label[i] == 0 and best[i] > 0 and sure[i]
        if free and open_ and tokens.follows[i] and open_[1] == best[i]:
            open_ = (open_[0], open_[1], tokens.end[i], tokens.doc[i])
        else:
            _close(open_, texts, out)
            open_ = (tokens.start[i], int(best[i]), tokens.end[i], tokens.doc[i]) if free else None
    _close(open_, texts, out)
    return out


def _close(span: tuple | None, texts: list[str], out: list[list[tuple[int, int, int]]]) -> None:
    if span:
        start, kind, end, doc = span
        token = texts[doc][start:end]
        start += len(token) - len(token.lstrip(EDGE.replace("(", "")))
        end -= len(token) - len(token.rstrip(EDGE))
        if start < end:
            out[doc].append((start, kind, end))


def learn_field(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> Field:
    """Fit the field to what the fixed patterns say about at most ``sample`` tokens, drawn from all texts by a hash."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).filter("text is not null")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            tokens = signal_tokens(texts, [base_spans(t) for t in texts])
            slots, labels = feature_slots(tokens), np.array(tokens.label, np.int64)
            before = np.where(np.array(tokens.follows, bool), np.append(-1, labels[:-1])[: len(labels)], -1)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64").to_numpy()[tokens.doc], "at": tokens.start,
                "slots": pd.Series(list(slots), dtype=object), "label": labels, "before": before,
            }).astype({"doc_id": "Int64"})

    seen = rows.mapInPandas(look, "doc_id long, at long, slots array<long>, label long, before long")
    some = seen.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "label").limit(sample).toPandas()
    slots = np.array(some["slots"].tolist(), np.int64).reshape(len(some), 4)
    return fit_field(slots, some["label"].to_numpy(np.int64), some["before"].to_numpy(np.int64))


def find_personal_data(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Find e-mail and IP addresses, card and phone numbers in every whole text.

    The fixed patterns' matches all stay. In each document the tokens with a digit or an at sign form a conditional random
    field: label weights from hashed features, chain edges between neighbours, skip edges that tie tokens with the
    same digits or address anywhere in the document to one hub. Message passing carries the label of a matched token to its
    repetitions (a phone number written again without its country code, say); what then is labelled with a
    probability of at least ``SURE`` is added.

    One row per row: doc_id and spans, array<struct<kind, start, end, base>> in code points, end exclusive, by start and kind.
    A null text has no spans; repeated rows and null ids stay; other columns are ignored; an empty table gives no rows. A row
    needs nothing from another one, so nothing is shuffled.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            base = [base_spans(t) for t in texts]
            tokens = signal_tokens(texts, base)
            more = added_spans(texts, tokens, marginals(tokens, field)) if len(tokens) else [[]] * len(texts)
            spans = [
                [{"kind": KINDS[k - 1], "start": a, "end": b, "base": own} for a, k, b, own in
                 sorted([(*s, True) for s in old] + [(*s, False) for s in new])]
                for old, new in zip(base, more)
            ]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "spans": spans})

    return rows.mapInPandas(find, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
