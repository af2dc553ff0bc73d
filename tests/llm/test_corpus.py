"""Operators that compare documents, lines, vectors or pages with each other, against brute force."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import embedding_dedup
from plumbline.llm import line_dedup
from plumbline.llm.embedding_dedup import near_duplicate_vectors
from plumbline.llm.graph import connected_components
from plumbline.llm.line_dedup import WORD_BANDS, deduplicate_lines, edit_distance_within, index_shapes, key_of, pair_parity, probe_shapes
from plumbline.llm.minhash import drop_near_duplicates, near_duplicates, odd_sketch
from plumbline.llm.quality import quality_rules
from plumbline.llm.warc import read_archive, write_archive

R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def roots(n, pairs):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(i) for i in range(n)]


def test_components(spark):
    pairs = [(R.randint(0, 199), R.randint(0, 199)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    want = roots(400, pairs)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found.get(i, i) == want[i] for i in range(400))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edit_distance(spark):
    def changed(t, k):
        t = list(t)
        for _ in range(k):
            i = R.randrange(len(t) + 1)
            t[i : i + R.randint(0, 1)] = R.choice(["", "a", "é", "😀"])
        return "".join(t)

    rows = [(a, changed(a, R.randint(0, 4))) for a in ["".join(R.choice("abcé😀") for _ in range(R.randint(0, 30))) for _ in range(500)]]
    df = spark.createDataFrame([*rows, (None, "a"), ("", "")], "a string, b string")
    for k in (1, 2):
        want = F.least(F.levenshtein("a", "b"), F.when(F.col("a").isNotNull(), k + 1))
        assert df.filter(~edit_distance_within(F.col("a"), F.col("b"), k).eqNullSafe(want)).count() == 0
    near = df.filter("levenshtein(a, b) <= 2").select(pair_parity(F.col("a")).alias("x"), pair_parity(F.col("b")).alias("y"))
    assert near.filter(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) > 8).count() == 0 and near.filter("x <> y").count() > 50
    keys = lambda c, shapes: F.transform(shapes, lambda s: key_of(F.col(c), F.length(c), s, 2))
    close = df.filter("length(a) >= 9 and length(b) <= length(a) and levenshtein(a, b) <= 2")
    assert close.count() > 50
    assert close.filter(~F.arrays_overlap(keys("a", probe_shapes(2)), keys("b", index_shapes(2)))).count() == 0


def brute_lines(docs, edits, least):
    """docs: sorted (id, text). The texts without the lines whose class stood at an earlier place."""
    places = [(d, n, line) for d, (_, text) in enumerate(docs) for n, line in enumerate((text or "").split("\n")) if len(line) >= least]
    lines = list(dict.fromkeys(line for _, _, line in places))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if abs(len(lines[i]) - len(lines[j])) <= edits and distance(lines[i], lines[j]) <= edits]
    root, number, seen, gone = roots(len(lines), pairs), {line: i for i, line in enumerate(lines)}, set(), set()
    for d, n, line in places:
        if root[number[line]] in seen:
            gone.add((d, n))
        seen.add(root[number[line]])
    return {
        doc: None if text is None else "\n".join(line for n, line in enumerate(text.split("\n")) if (d, n) not in gone)
        for d, (doc, text) in enumerate(docs)
    }


def test_lines(spark):
    common, docs = [prose(6) for _ in range(6)], []
    for i in range(60):
        lines = [prose(5) for _ in range(3)] + [R.choice(common) for _ in range(2)] + ["short", ""]
        line = R.choice(common)
        at = R.randrange(len(line))
        docs.append((i, "\n".join([*lines, line[:at] + R.choice(["", "x", "yz"]) + line[at + R.randint(0, 1) :]])))
    docs += [(60, None), (61, ""), (62, "\n\n"), (63, prose(3000))]
    rows = [(i, t, "n", 1, None) for i, t in docs] + [(None, common[0] + "\nown words of this last one, long enough", "n", None, None)]
    table = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, number string, n_dropped int, row string").repartition(3)
    got = deduplicate_lines(table)
    assert got.columns == ["doc_id", "text", "number", "row", "n_lines", "n_dropped"]
    found = got.collect()
    want = brute_lines(docs, 2, 24)
    assert len(found) == len(rows) + 1
    for r in found:
        if r.doc_id is None:
            assert r.text == "own words of this last one, long enough" and r.n_dropped == 1
        else:
            assert r.text == want[r.doc_id]
            assert r.n_lines == len((docs[r.doc_id][1] or "").split("\n")) * (docs[r.doc_id][1] is not None)
    assert deduplicate_lines(table.limit(0)).count() == 0


def test_lines_of_a_wide_family_take_pivots(spark, monkeypatch):
    """Members are up to 4 edits apart, so no one line unites them; unrelated lines share a segment with them."""
    monkeypatch.setattr(line_dedup, "PIVOTS", 2)
    r, center = random.Random(11), "abcdefghijklmnopqrstuvwxyz0123456789"
    texts = []
    for _ in range(45):
        line = list(center)
        for at in r.sample(range(len(line)), 2):
            line[at] = r.choice("ABCD")
        texts.append("".join(line))
    texts += [center[:12] + "".join(r.choice("EFGH") for _ in range(24)) for _ in range(15)]
    r.shuffle(texts)
    docs = list(enumerate(texts))
    want = brute_lines(docs, 2, 24)
    assert 15 < sum(t != "" for t in want.values()) < 60
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {row.doc_id: row.text for row in deduplicate_lines(table).collect()} == want


def test_keys_of_lines_split_at_all_spaces(spark):
    """However its words are set apart, a line has the keys of its words, and lines that lack a few words of it meet it."""
    r = random.Random(3)
    base = [r.choice(VOCABULARY) for _ in range(85)]
    gone = [r.sample(range(85), n % 4 + 1) for n in range(20)]
    edited = [" ".join(w for i, w in enumerate(base) if i not in out) for out in gone]
    odd = ["\t".join(base), " \x0b\r ".join(base), "  " + " \f".join(base) + " "]
    lines = spark.createDataFrame([(line,) for line in (" ".join(base), *odd, *edited)], "line string").withColumn("h1", F.xxhash64("line"))
    first, *others = [x.h1 for x in lines.collect()]
    posts, probes = [line_dedup.keys_of_lines(lines, probe, 2, WORD_BANDS, 42) for probe in (False, True)]
    of = {h: sorted(x.key for x in posts.filter(F.col("h1") == h).collect()) for h in (first, *others[:3])}
    assert len(of[first]) == 7 and all(keys == of[first] for keys in of.values())
    met = probes.filter(F.col("h1") == first).select("key").join(posts, "key").select("h1").distinct().collect()
    assert {x.h1 for x in met} == {first, *others}


def test_keys_of_lines_come_from_one_pass(spark):
    """What a line is posted under is among what it seeks, marked, so that lines are read and split once for both."""
    r = random.Random(8)
    texts = [" ".join(r.choice(VOCABULARY) for _ in range(n)) for n in (4, 10, 19, 20, 21, 39, 43, 44, 79, 83, 85, 86, 170, 20500)]
    lines = spark.createDataFrame([(text,) for text in texts], "line string").withColumn("h1", F.xxhash64("line"))
    posts, probes = [line_dedup.keys_of_lines(lines, probe, 2, WORD_BANDS, 42) for probe in (False, True)]
    assert "Union" not in probes._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted((x.h1, x.key) for x in df.collect())
    assert rows(posts) == rows(probes.filter("posted")) and posts.count() < probes.count()
    per_line = dict(posts.groupBy("h1").count().collect())
    spelled, edits = lambda n: 3 * (n < 42), lambda n: max([-1, *[e for least, e in WORD_BANDS if n >= least]])
    assert [per_line[x.h1] for x in lines.collect()] == [spelled(n) + edits(n) + 1 for n in (len(text.split()) for text in texts)]


def test_lines_are_told_apart_before_distances(spark):
    """Bits alone rule out long lines with more edits than allowed, and no distance of characters is asked for lines without their parity."""
    r = random.Random(9)
    line = [r.choice(VOCABULARY) for _ in range(700)]
    other = [f"new{i}" if i % 25 == 0 else word for i, word in enumerate(line)]
    of = lambda text: F.transform(F.split(F.lit(text), " "), lambda word: F.xxhash64(word))
    bits = [spark.range(1).select(*line_dedup.word_parity(of(" ".join(text)))).first() for text in (line, other, line[:-1] + ["new"])]
    turned = lambda a, b: sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) + 2**64).bit_count() for x, y in zip(a, b))
    assert turned(bits[0], bits[1]) > 2 * 16 and turned(bits[0], bits[2]) <= 2
    sides = spark.createDataFrame([("a b", "a b", None, None), ("a b", "a b", 1, None), ("a b", "a c", 1, 1), ("a b", "xyz", 1, 1)], "line_a string, line_b string, parity_a long, parity_b long")
    assert [x[0] for x in sides.select(line_dedup.letters_within(2)).collect()] == [False, False, True, False]


def test_lines_without_open_lists_are_united_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(line_dedup, "connected_components", lambda links: calls.append(1) or connected_components(links))
    table = spark.createDataFrame([(1, "a line of more than some characters"), (2, "a line of more than some character")], "doc_id long, text string")
    assert [r.n_dropped for r in deduplicate_lines(table).orderBy("doc_id").collect()] == [0, 1] and len(calls) == 1


def test_long_lines_by_words(spark):
    def word_distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    r, docs = random.Random(5), []
    passage = [r.choice(VOCABULARY) for _ in range(9)]
    for n in (9, 10, 11, 19, 20, 21, 22, 39, 40, 41, 43, 44, 79, 83, 90, 165):
        for _ in range(2):
            first = passage + [r.choice(VOCABULARY) for _ in range(n - 9)]
            docs.append(first)
            for edits in (1, 2, 3, 5, 8):
                copy = list(first)
                for _ in range(edits):
                    at = r.randrange(len(copy))
                    copy[at : at + r.randint(0, 1)] = [["anotherratherlongword"], ["x", "y"][: r.randint(0, 2)]][r.randint(0, 1)]
                docs.append(copy)
    lines = [" ".join(d) for d in docs]
    limit = lambda n: max([0, *[edits for least, edits in WORD_BANDS if n >= least]])
    letters = lambda i, j: len(lines[i]) - len(lines[j]) in range(-2, 3) and word_distance(lines[i], lines[j]) <= 2
    near = lambda a, b: abs(len(a) - len(b)) <= (k := limit(min(len(a), len(b)))) and word_distance(a, b) <= k
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if near(docs[i], docs[j]) or letters(i, j)]
    top = roots(len(docs), pairs)
    assert len(set(top)) < len(docs) < len(pairs) + len(set(top))
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    found = {row.doc_id: row.n_dropped for row in deduplicate_lines(table).collect()}
    assert found == {i: int(top[i] != i) for i in range(len(docs))}


def test_short_lines_go_as_exact_copies(spark):
    rows = [(1, "All rights reserved.\n\n---\n12"), (2, "one\nAll rights reserved.\n\n---\n12\nAll rights reserved"), (None, "one\none\n等\n等")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in deduplicate_lines(table, short_copies=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("one\n\n---\n12\nAll rights reserved", 1), None: ("等", 3)}
    assert {r.n_dropped for r in deduplicate_lines(table).collect()} == {0}
    staged = corpus_pipeline.lines(spark, table.withColumn("n_chars", F.length("text").cast("long")), "")
    assert {r.doc_id: r.text for r in staged.collect()} == {doc: text for doc, (text, _) in got.items()}


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    docs = []
    for _ in range(25):
        words = prose(60).split()
        for _ in range(R.randint(1, 5)):
            copy = list(words)
            for _ in range(R.randint(0, 3)):
                copy[R.randrange(len(copy))] = R.choice(VOCABULARY)
            docs.append(" ".join(copy))
    docs += [None, "", " \t", "one two", "ONE  two", "one two three four five", prose(4000), docs[0], docs[0]]
    sets = [shingles(t, width) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(len(docs), links)
    rows = [(i, t, "x", 1.0) for i, t in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, row string, component double").repartition(3)
    found = {r.doc_id: r for r in near_duplicates(table, width=width).collect()}
    assert [found[i].component_id for i in range(len(docs))] == want
    assert all(found[i].n_shingles == len(sets[i]) and found[i].kept == found[i].leads == (want[i] == i) for i in range(len(docs)))
    twice = table.unionByName(table).unionByName(table.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(docs[0]).alias("text"), "row", "component"))
    left = drop_near_duplicates(twice, width=width)
    assert left.columns == table.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))
    assert near_duplicates(table.limit(0)).count() == 0 and drop_near_duplicates(table.limit(0)).count() == 0


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 500, rng.integers(1, 400))).astype(np.uint64) for _ in range(2))
        bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in odd_sketch(a) ^ odd_sketch(b))
        assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("leaf_rows", [2048, 40])
def test_vectors(spark, leaf_rows):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    near = np.concatenate([base[rng.integers(0, 60, 300)] + 0.12 * rng.standard_normal((300, 16)), base])
    rows = [(i, v.tolist(), int(rng.integers(0, 2)), "x") for i, v in enumerate(near)] + [(400 + i, near[0].tolist(), 1, None) for i in range(5)]
    rows += [(500, None, 1, "x"), (501, [0.0] * 16, 1, "x"), (502, [float("nan")] * 16, 1, "x"), (503, [None] * 16, 1, "x")]
    rows += [(504, near[0].tolist(), None, "x"), (505, [1.0, 2.0], 1, "x"), (506, [], 1, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row string").repartition(3)
    usable = [(k, i) for k, (i, v, label, _) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 16]
    units = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k, _ in usable}
    links = [(a, b) for a, _ in usable for b, _ in usable if b < a and rows[a][2] == rows[b][2] and units[a] @ units[b] >= 0.93]
    root = roots(len(rows), links)
    got = {r.vec_id: r for r in near_duplicate_vectors(table, leaf_rows=leaf_rows).collect()}
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    missed = sum(abs(got[r[0]].n_links - degree[k]) for k, r in enumerate(rows))
    assert missed <= 0.02 * degree.sum() and degree.sum() > 500
    assert all(got[r[0]].n_links <= degree[k] for k, r in enumerate(rows))
    wrong = sum(got[r[0]].component_id != rows[root[k]][0] for k, r in enumerate(rows))
    assert wrong == 0 if leaf_rows == 2048 else wrong <= 8
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 507))
    assert near_duplicate_vectors(table.limit(0)).count() == 0


def test_a_bundle_of_near_copies_is_not_split_for_ever():
    near = np.zeros((5000, 1)) + 1e-6 * np.arange(5000)[:, None]
    assert all(np.isnan(embedding_dedup.fit_splits(np.repeat(near, 5, 1), 5, 0.1, 100)))


def test_archive(spark):
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, R.choice(["<p>a", "<p>é", "", None, prose(9)]), 1) for i in range(60)]
    rows += [(7, "u", rows[7][2], None), (None, "u", "only", None), (None, "u", "only", None), (99, "u", "x" * 300_000, 2)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    got = read_archive(write_archive(table)).collect()
    assert len(got) == len(rows)
    last, responses = {}, {}
    for page, _, html, _ in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    for r in got:
        payload = bytes(r.payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode() and r.payload_bytes == len(payload)
        record = bytes(r.record)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(payload * (r.record_type == "response") + b"\r\n\r\n")
        head = record.split(b"\r\n\r\n")[0]
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert len(record) == len(head) + 4 + length + 4
        if r.record_type == "response":
            responses[payload] = responses.get(payload, 0) + 1
            assert r.refers_to is None and (r.page_id if r.page_id is not None else -1) == last[payload.decode()]
        else:
            assert (r.refers_to if r.refers_to is not None else -1) == last[payload.decode()]
    assert set(responses.values()) == {1} and len(responses) == len(last)
    assert all(r.record_type == "response" for r in read_archive(write_archive(table, least_bytes=10**6)).collect())
    assert read_archive(write_archive(table.limit(0))).count() == 0


def test_quality(spark):
    good, bad = [prose(80) for _ in range(30)], [" | ".join(w.upper() + "!!" for w in prose(80).split()) for _ in range(12)]
    texts = [*good, *bad, None, "", "a b\na b\n\n x #", "one two three four five " * 4 + prose(10), prose(5000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, good[0], None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 20)] + [(30 + i, 0, 0) for i in range(8)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(docs.repartition(3), labels).collect()}
    for i, text in enumerate(texts):
        words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x.split()]
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(grams) < 3000 else set()
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        if len(grams) < 3000:
            assert r.n_repeat_words == len(covered) and r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    assert all(got[i].kept for i in range(30)) and not any(got[i].kept for i in range(30, 45))
    assert got[None].kept
    assert quality_rules(docs.limit(0), labels.limit(0)).count() == 0
    assert all(r.kept != r.base_failed for r in quality_rules(docs, labels.limit(0)).collect())


def test_pipeline(spark):
    shared = prose(60)
    clean = [prose(70) + "\n" + prose(30) for _ in range(12)]
    changed = clean[1].split(" ")
    changed[10] = changed[-1] = "replaced"
    texts = [*clean, shared + "\n" + prose(40), prose(40) + "\n" + shared, clean[0], " ".join(changed), None, "", "12 34 !!", prose(30) + " token = abcdefgh12345"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "MinHash near-dedup", "secret scan", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.saved(stage(spark, kept, ""), "test")
        assert kept.schema == docs.schema
        ids = {r.doc_id for r in kept.collect()}
        assert set(range(14)) | {19} <= ids
        if name == "language ID":
            assert {16, 17, 18}.isdisjoint(ids)
    found = {r.doc_id: r for r in kept.collect()}
    assert set(found) == set(range(14)) | {19}
    assert shared in found[12].text and shared not in found[13].text
    assert found[19].text.endswith("[secret]") and all(r.n_chars == len(r.text) for r in found.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    assert {r.doc_id for r in packed} == set(found)


def test_pipeline_stages_keep_columns_of_clashing_names(spark):
    line = prose(12)
    rows = [(1, line, "mine", 7, "x", None), (2, line + "\n" + prose(9) + " token = abcdefgh12345", None, 7, "y", 1.5), (3, None, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_dropped int, N_Lines string, input_spans double")
    for _, stage in corpus_pipeline.STAGES[1], corpus_pipeline.STAGES[3]:
        got = stage(spark, docs, "")
        assert got.schema == docs.schema
        assert {row.doc_id: tuple(row)[2:] for row in got.collect()} == {row[0]: row[2:] for row in rows}
        assert stage(spark, docs.limit(0), "").count() == 0
    assert got.filter("text like '%[secret]'").count() == 1


def test_a_small_graph_is_dealt_over_few_tasks(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 10 != 9], "a long, b long")
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        classes = connected_components(links)
        assert {(r["node"], r["component"]) for r in classes.collect()} == {(i, i - i % 10) for i in range(300)}
        assert len(set(classes.inputFiles())) <= 8
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
