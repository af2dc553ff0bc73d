"""Question texts: intent and domain, time phrases, answers as JSON, evaluation of labels."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import (
    BAD_JSON_MESSAGE, DEFAULT_DOMAIN, DEFAULT_INTENT, DOMAIN_PHRASES, INTENT_PHRASES,
)
from plumbline.functions.frames import col

TIME_PHRASE = (
    r"(?i)\b(?:last|this|next|previous) (?:day|week|month|quarter|year)\b|\bq[1-4] (?:19|20)[0-9]{2}\b"
    r"|\b(?:19|20)[0-9]{2}\b"
)
FENCED = r"(?is)^```(?:json)?\s*(.*?)\s*```"


def _first_match(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str, whole_word: bool) -> Column:
    pick = None
    for label, phrases in rules:
        if whole_word:
            hit = text.rlike(r"\b(" + "|".join(re.escape(p.strip()) for p in phrases) + r")\b")
        else:
            hit = reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])
        pick = F.when(hit, label) if pick is None else pick.when(hit, label)
    return pick.otherwise(default)


def classify_questions(df: DataFrame, text: str, whole_word: bool = False) -> DataFrame:
    """Add ``intent`` and ``domain`` by key phrases; the first rule that fits wins.

    Phrases match inside words as well (``order`` in ``border``) unless ``whole_word`` is set.
    """
    # a column of its own, so that the text is lower-cased once and not per phrase
    lowered = df.withColumn("_lower", F.lower(F.coalesce(col(text), F.lit(""))))
    lower = F.col("_lower")
    return lowered.withColumns({
        "intent": _first_match(lower, INTENT_PHRASES, DEFAULT_INTENT, whole_word),
        "domain": _first_match(lower, DOMAIN_PHRASES, DEFAULT_DOMAIN, whole_word),
    }).drop("_lower")


def extract_time_phrase(df: DataFrame, text: str) -> DataFrame:
    """Add ``time_dimension``: the first time phrase in the text, or NULL."""
    return df.withColumn("time_dimension", F.nullif(F.regexp_extract(col(text), TIME_PHRASE, 0), F.lit("")))


def label_pairs(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Counts per predicted and expected label: all that the evaluation needs."""
    return df.groupBy(col(predicted).alias("predicted"), col(expected).alias("expected")).agg(F.count(F.lit(1)).alias("n"))


def evaluate_labels(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Accuracy per expected class and over all (class NULL); a missing expectation always passes."""
    pairs = label_pairs(df, predicted, expected)
    right = F.when(F.col("expected").isNull() | (F.col("predicted") == F.col("expected")), F.col("n")).otherwise(0)
    per_class = pairs.groupBy("expected").agg(F.sum("n").alias("n"), F.sum(right).alias("correct"))
    overall = per_class.agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))
    labelled = per_class.select(F.coalesce(F.col("expected").cast("string"), F.lit("(none)")).alias("label"), "n", "correct")
    return labelled.unionByName(overall.select(F.lit("(all)").alias("label"), "n", "correct")).withColumn(
        "accuracy", F.try_divide("correct", "n")
    )


def parse_json_answers(df: DataFrame, text: str, schema: str | None = None) -> DataFrame:
    """Strip a code fence and parse: adds ``answer`` and, for text that is no JSON, ``error`` and ``raw_content``.

    ``answer`` is the JSON text, or a struct when a schema is given.
    """
    bare = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    body = F.when(bare.rlike(FENCED), F.trim(F.regexp_extract(bare, FENCED, 1))).otherwise(bare)
    ok = F.try_parse_json(body).isNotNull()
    answer = F.when(ok, body if schema is None else F.from_json(body, schema))
    return df.withColumns({
        "answer": answer,
        "error": F.when(~ok, F.lit(BAD_JSON_MESSAGE)),
        "raw_content": F.when(~ok, body),
    })
