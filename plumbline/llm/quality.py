"""Quality rules: counts, repetition, and a hashed n-gram log-likelihood ratio against a trusted corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import col, one_row
from plumbline.llm.common import saved, words

#: Buckets of the hashed n-grams, the largest number of trusted documents, and the smoothing of counts.
BUCKETS, TRUSTED, SMOOTHING = 1 << 16, 20_000, 1.0
#: Words of a window; the share of repeated words above which and the number of words below which a text fails.
WINDOW, REPEATED_PERCENT, LEAST_WORDS = 5, 20, 10
SYMBOLS = r"[#*$%&|<>]"


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of a text's words and of its pairs of neighbouring words, from the words' hashes."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pairs = F.transform(
        F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(buckets)).cast("int"),
    )
    return F.concat(single, pairs)


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def bucket_weights(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row with ``weights``: for each bucket log(target share / raw share).

    Raw counts come from all of ``docs``, target counts from those whose ids are in ``trusted`` (bounded by its maker). Both
    are summed in one pass; what is shuffled is at most the buckets of each task.
    """
    good = F.broadcast(trusted.select(F.col(id_column).alias("trusted_id")))
    seen = docs.select(col(id_column).alias("id"), col(text_column).alias("text")).join(good, F.col("id") == F.col("trusted_id"), "left")
    # a one-element array, so that the hashes are worked out once
    grams = F.transform(F.array(word_hashes(F.col("text"))), lambda h: ngram_buckets(h, buckets))[0]
    seen = seen.select(
        F.col("trusted_id").isNotNull().cast("long").alias("target"), F.explode(grams).alias("bucket")
    )
    counts = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target"))
    every = docs.sparkSession.range(buckets).join(counts, F.col("id") == F.col("bucket"), "left").select(
        "id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")
    )
    lists = every.agg(
        F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"), F.sort_array(F.collect_list(F.struct("id", "raw", "target"))).alias("cells")
    )
    share = lambda count, total: (count + F.lit(SMOOTHING)) / (total + F.lit(SMOOTHING * buckets))
    return lists.select(
        F.transform("cells", lambda c: F.log(share(c["target"], F.col("n_target")) / share(c["raw"], F.col("n_raw")))).alias("weights")
    )


def trusted_ids(labels: DataFrame, most: int = TRUSTED, id_column: str = "doc_id", label_column: str = "quality") -> DataFrame:
    """At most ``most`` ids of documents labelled 1, drawn by a hash of the id."""
    good = labels.filter((F.col(label_column) == 1) & F.col(id_column).isNotNull()).select(id_column).distinct()
    return good.orderBy(F.xxhash64(id_column), id_column).limit(most)


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``window`` words found at least twice in the text."""
    starts = F.size(hashes) - window + 1
    grams = F.transform(
        F.slice(hashes, 1, F.greatest(starts, F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, window)]),
    )

    def covered(ordered: Column) -> Column:
        """From (gram, place) in order: what the places of grams met twice cover, counted once."""
        same = lambda i, s: F.coalesce(F.get(ordered, i)["gram"] == s["gram"], F.lit(False))
        marked = F.transform(ordered, lambda s, i: F.struct(s["at"].alias("at"), (same(i + 1, s) | same(i - 1, s)).alias("twice")))
        places = F.array_sort(F.transform(F.filter(marked, lambda s: s["twice"]), lambda s: s["at"]))
        begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))
        return F.aggregate(
            places, begin,
            lambda s, at: F.struct((at + window).alias("end"), (s["words"] + F.least(F.lit(window), at + window - s["end"])).alias("words")),
            lambda s: s["words"],
        )

    def counted(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("gram"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(F.transform(F.array(ordered), covered)[0])

    # one-element arrays: each step's array is worked out once
    return F.transform(F.array(grams), counted)[0]


def measured(text: Column, weights: Column) -> Column:
    """Struct of a text's base counts and its ``score``, the mean weight of its n-grams (0 without words)."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    grams = lambda hashes: F.aggregate(
        ngram_buckets(hashes, BUCKETS), F.lit(0.0), lambda total, b: total + F.get(weights, b)
    )

    def of(w: Column, hashes: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda total, word: total + F.length(word)).alias("word_chars"),
            F.regexp_count(full, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
            repeated_words(hashes).cast("long").alias("n_repeat_words"),
            F.when(n > 0, grams(hashes) / (2 * n - 1)).otherwise(0.0).alias("score"),
        )

    both = F.transform(F.array(words(text)), lambda w: F.struct(w.alias("w"), F.transform(w, lambda x: F.xxhash64(x)).alias("h")))
    return F.transform(both, lambda p: of(p["w"], p["h"]))[0]


def quality_rules(
    docs: DataFrame, labels: DataFrame, share: float = 0.5, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Base counts, base verdict, likelihood-ratio score and verdict of every whole text.

    The score is the mean over a text's words and word pairs, hashed into ``BUCKETS`` buckets, of log(target share / raw
    share): target are at most ``TRUSTED`` documents labelled good, raw is the whole corpus. The threshold lies at
    ``share`` of the way from the mean score of documents labelled bad to that of those labelled good (without
    either label nothing fails by score). A document is kept if it passes the base rules and its score reaches the threshold.

    One row per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept. A null or blank
    text has no words and fails; repeated rows are judged alike; a null id is judged by its text; other columns are
    ignored; an empty table gives no rows.
    """
    weights = one_row(bucket_weights(docs, trusted_ids(labels), BUCKETS, id_column, text_column))["weights"]
    weighed = docs.select(col(id_column).cast("long").alias("doc_id"), col(text_column).alias("text"), weights.alias("weights"))
    rows = saved(weighed.select("doc_id", measured(F.col("text"), F.col("weights")).alias("m")).select("doc_id", "m.*"), "quality")
    graded = labels.select(F.col(id_column).alias("id"), F.col("quality").alias("grade")).filter("grade in (0, 1)").distinct()
    means = rows.join(graded, F.col("doc_id") == F.col("id")).agg(
        F.avg(F.when(F.col("grade") == 0, F.col("score"))).alias("bad"), F.avg(F.when(F.col("grade") == 1, F.col("score"))).alias("good")
    )
    threshold = one_row(means.select(F.coalesce(F.col("bad") + share * (F.col("good") - F.col("bad")), F.lit(float("-inf"))).alias("least")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score",
        (~failed & (F.col("score") >= threshold["least"])).alias("kept"),
    )
