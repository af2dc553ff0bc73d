"""Operators that treat every text for itself, against the libraries or plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.langid import held_out, identify_language, keep_identified, language_prototypes
from plumbline.llm.packing import fullest_set, pack_documents, plan_windows, word_ids
from plumbline.llm.pii import EVIDENCE, FEATURES, LABELS, SKIP, Field, base_spans, feature_slots, find_personal_data, fit_field, learn_field, marginals, signal_tokens
from plumbline.llm.piece_codec import Encoder, PieceTable, encode_pieces
from plumbline.llm.secrets import RULES, find_secrets, listed, redacted, trigram_query

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, row int, spans string, lang string"
TEXTS = [
    None, "", " ", "\n\n", "Don't  stop\tNOW", "é漢😀▁ x", "z" * 5000, "the quick brown fox " * 2000, "same", "same",
    "x<|endoftext|>y", "é İ ς \x00",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "x", 1, None, "en") for i, t in enumerate(TEXTS)]
    rows += [(9, "same", None, None, None, None), (9, "same", None, None, None, None), (None, "no id", None, 1, "x", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(docs):
    return docs.limit(0)


def random_texts(n, alphabet, most=60, seed=7):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_fullest_set_is_the_best_of_all_subsets():
    r = random.Random(1)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 5))}
        items = [k for k, v in counts.items() for _ in range(v)]
        sums = {0}
        for i in items:
            sums |= {s + i for s in sums}
        chosen = fullest_set(counts, sorted(counts, reverse=True), 40)
        assert sum(k * v for k, v in chosen.items()) == max(s for s in sums if s <= 40)
        assert all(v <= counts[k] for k, v in chosen.items())


def test_plan_uses_every_piece_once():
    counts = {700: 5, 300: 9, 48: 40, 1: 3}
    windows, rest = plan_windows(counts, 1024, 4)
    used = {k: sum(w.get(k, 0) for w in windows) + rest.get(k, 0) for k in counts}
    assert used == counts and all(1020 <= sum(k * v for k, v in w.items()) <= 1024 for w in windows)


def test_packing_holds_each_id_once_with_little_padding(docs):
    rows = pack_documents(docs, WORDS).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    parts, sequences = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        parts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(TEXTS):
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        copies = 3 if i == 9 else 1
        assert b"".join(p for _, p in sorted(parts[i, len(want) // 4])[::copies]) == want
    assert (None, 3) in parts or any(k[0] is None for k in parts)
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 8 * len(sequences)
    assert pack_documents(empty(docs), WORDS).count() == 0


@pytest.mark.parametrize("alphabet", ["abcde ting the", "ab c ", "x ▁\n\t09éß漢😀\x00", " ", "aet"])
def test_merge_rounds_equal_the_library(alphabet):
    library, table = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceTable(PIECES)
    texts = random_texts(600, alphabet) + ["", " ", "  a  ", alphabet * 50]
    for text, ids in zip(texts, Encoder(table).encode(texts)):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert table.decode(ids) == library.decode(want)


def test_broken_bytes_decode_like_the_library():
    library, table = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceTable(PIECES)
    ids = [1, 3 + 0xE2, 3 + 0x82, 300, 3 + 0xFF, 2]
    assert table.decode(np.array(ids, "<u4").tobytes()).replace("�", "") == library.decode(ids).replace("�", "")


def test_piece_codec_over_a_table(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = encode_pieces(docs, PIECES).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            want = library.encode(TEXTS[r.doc_id] or "", add_bos=True, add_eos=True)
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.decoded == library.decode(want)
    assert encode_pieces(empty(docs), PIECES).count() == 0


ASSIGN = re.compile(RULES[0].pattern)


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in sorted(found))


def test_mandatory_trigrams():
    assert trigram_query(RULES[2].pattern) == []
    assert frozenset({"tok", "oke", "ken"}) in trigram_query(RULES[0].pattern)
    assert trigram_query(RULES[1].pattern) == [frozenset({"aki", "kia"})]


def test_a_worker_keeps_the_words_it_has_met(spark):
    """The vocabulary is loaded and words are encoded once in a Python worker, not once in a task; every part equals the tokenizer's own."""
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = word_ids(path)
    plain = Tokenizer.from_file(path)
    for text in ["Hello", "hello don't", "ABC,def 12a", "Ünïcode straße", "x<|y", "ÀB", "中文 a", "\tTab\x0b", "ªº", "İI ǅ"]:
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    known = len(ids)
    assert word_ids(path) is ids and ids.encode("Hello") and len(ids) == known


def test_texts_without_candidates_pass_by_the_join_of_secrets(spark, capsys):
    rows = [(i, f"plain words {i} " * 20) for i in range(50)] + [(90, "password: abcdefgh1"), (91, "a token"), (92, None), (93, "f" * 32)]
    found = find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    assert got == {i: "" for i in range(50)} | {90: "assign:0:19", 91: "", 92: "", 93: "hex:0:32"}
    found.explain()
    plan = capsys.readouterr().out
    assert "Union" in plan and "subquery" in plan.lower()


def test_secrets_equal_plain_patterns(spark, docs):
    parts = ["token", "=", "secret:", "abcdefgh1", " ", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "'", '"', "é😀", "api_key", "PASSWORD = ", "\n"]
    texts = random_texts(400, parts, 14)
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in find_secrets(found, RULES[:3]).select("text", listed(F.col("spans")).alias("s"), redacted(F.col("text"), F.col("spans")).alias("r")).collect():
        assert r.s == plain_secrets(r.text)
        assert r.r == r.text if not r.s else "[secret]" in r.r
    rows = find_secrets(docs)
    assert rows.count() == docs.count() and rows.columns == [*[c for c in docs.columns if c != "spans"], "spans"]
    assert {str(r.spans) for r in rows.collect()} == {"[]"}
    assert find_secrets(empty(docs)).count() == 0


def test_added_token_formats(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 9 + " xoxb-1234567890-abcdef"
    rows = find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.explode("spans.kind").alias("k")).collect()
    assert [r.k for r in rows] == ["private_key", "repository", "chat"]


def plain_personal(text):
    found = [(m.start(), 1, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        found += [(m.start(), 2, m.end())] if all(int(p) <= 255 for p in m[0].split(".")) else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        odd = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
        found += [(m.start(), 3, m.end())] if 14 <= len(digits) <= 19 and odd % 10 == 0 else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        found += [(m.start(), 4, m.end())] if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15 else []
    return sorted(found)


def test_personal_data_patterns():
    parts = [*"1209.-+()@a", " ", "..", "b.c", "x@y.z", "é", "255", "+1 (775) 555-3054", "4242424242424242", "\n"]
    for text in random_texts(20000, parts, 25):
        assert base_spans(text) == plain_personal(text)
    assert base_spans("9" * 200_000) == [] and base_spans("a" * 200_000 + "@") == []


def test_field_marks_what_repeats_a_match(spark, docs):
    text = "call +1 (775) 555-3054 now, later (775) 555-3054. Not 12345."
    rows = spark.createDataFrame([(1, text), (2, None), (3, "nothing 77"), (4, "")], "doc_id long, text string")
    taught = [(i, f"call +1 ({i}) 555-{i * 37 % 9000 + 1000} or 10.0.0.{i} and item 12{i}") for i in range(200, 250)]
    field = learn_field(spark.createDataFrame(taught, "doc_id long, text string"))
    found = {r.doc_id: [(s.kind, text[s.start : s.end], s.base) for s in r.spans] for r in find_personal_data(rows, field).collect()}
    assert found[1] == [("phone", "+1 (775) 555-3054", True), ("phone", "(775) 555-3054", False)]
    assert found[2] == found[3] == found[4] == []
    none = fit_field(np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert isinstance(learn_field(empty(docs)), Field) and find_personal_data(docs, none).count() == docs.count()
    assert find_personal_data(empty(docs), none).count() == 0


@pytest.mark.parametrize("repetitions", [3, 15, 50])
@pytest.mark.parametrize("leaning", [0.0, 1.0])
def test_every_repetition_has_the_exact_marginals(repetitions, leaning):
    text = "call +17755553054 now" + " and later 17755553054 again" * repetitions
    tokens = signal_tokens([text], [base_spans(text)])
    assert len(tokens) == repetitions + 1 and tokens.label == [4] + [0] * repetitions
    weights = np.zeros((FEATURES, LABELS))
    weights[np.unique(feature_slots(tokens)[1:]), 0] = leaning / 4
    field = Field(weights, np.zeros((LABELS, LABELS)))
    own = np.exp(weights[feature_slots(tokens)].sum(axis=1) + EVIDENCE * np.eye(LABELS)[tokens.label] * (np.array(tokens.label) > 0)[:, None])
    tie = np.exp(SKIP * np.eye(LABELS))
    # brute force: given the hub's label the tokens are independent
    joint = np.array([[own[i] * tie[h] for h in range(LABELS)] for i in range(len(tokens))])
    hub = np.log(joint.sum(axis=2)).sum(axis=0)
    hub = np.exp(hub - hub.max()) / np.exp(hub - hub.max()).sum()
    want = (joint / joint.sum(axis=2, keepdims=True) * hub[None, :, None]).sum(axis=1)
    got = marginals(tokens, field)
    assert np.abs(got - want).max() < 1e-3
    assert leaning or (got[:, 4] > 0.9).all()


def test_language(spark, docs):
    en, de = "the cat sat on the mat with that hat ", "die katze und der hund sind nicht schön "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(40)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = language_prototypes(labelled.filter(~held_out(F.col("doc_id"))))
    assert sorted(prototypes) == ["de", "en"]
    for r in identify_language(labelled, prototypes).join(labelled, "doc_id").collect():
        assert r.lang_pred == r.lang and 0 < r.score <= 1
    assert {r.doc_id for r in labelled.filter(held_out(F.col("doc_id"))).collect()} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2}
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(docs, prototypes).collect()}
    assert len(got) == len(TEXTS) + 1 and all(got[i] == ("und", 0.0) for i in range(4)) and got[7][0] == "en"
    kept = keep_identified(docs, prototypes)
    assert kept.schema == docs.schema and {0, 1, 2, 3}.isdisjoint({r.doc_id for r in kept.collect()})
    assert identify_language(empty(docs), prototypes).count() == 0 and language_prototypes(empty(docs)) == {}
    assert {r.lang_pred for r in identify_language(docs, {}).collect()} == {"und"}


def test_digests_are_those_of_the_contract(spark):
    ids = np.array([1, 2], "<u4").tobytes()
    row = spark.createDataFrame([(bytearray(ids),)], "ids binary").select(F.sha2("ids", 256).alias("s"), F.crc32("ids").alias("c")).first()
    assert row.s == hashlib.sha256(ids).hexdigest() and row.c == zlib.crc32(ids)
