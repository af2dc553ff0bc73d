"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what the one before kept, written as Parquet and read again, and works on all of it. Columns beyond
doc_id and text pass through unchanged, also those with names that an operator gives to its own figures; n_chars is kept equal to the
text's length where it is there. Empty tables give empty tables; repeated rows of one id and text are one document; ties go to the
smallest doc_id, a null one last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import saved, table, words
from plumbline.llm.langid import held_out, keep_identified, language_prototypes
from plumbline.llm.line_dedup import deduplicate_lines
from plumbline.llm.minhash import drop_near_duplicates
from plumbline.llm.packing import pack_documents
from plumbline.llm.secrets import find_secrets, redacted

#: No SQL: the stages use learned prototypes and a tokenizer.
ORACLE_SQL = None


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """A new text and its number of characters in the place of the old ones."""
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def _set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns of these names renamed, so that an operator may use the names; and old name to new name."""
    renamed, taken = {}, {c.lower() for c in docs.columns}
    for name in (c for c in docs.columns if c.lower() in names):
        free = "input_" + name
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        renamed[name] = free
    return docs.withColumnsRenamed(renamed), renamed


def _restored(done: DataFrame, docs: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """The columns of ``docs`` in their order, those set aside under their old names."""
    return done.select(*[F.col(f"`{renamed.get(c, c)}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null and empty texts, and those without a letter."""
    taught = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return keep_identified(docs, language_prototypes(taught))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen earlier in the corpus go, and documents that have no word left after it; null texts and those that lose no line stay."""
    apart, renamed = _set_aside(docs, ("n_lines", "n_dropped"))
    done = deduplicate_lines(apart, short_copies=True)
    kept = done.filter((F.col("n_dropped") == 0) | (F.size(words(F.col("text"))) > 0))
    return _restored(_with_text(kept, F.col("text")), docs, renamed)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id; texts without a word stay."""
    return drop_near_duplicates(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay, null texts as they are."""
    apart, renamed = _set_aside(docs, ("spans",))
    found = find_secrets(apart)
    return _restored(_with_text(found, redacted(F.col("text"), F.col("spans"))), docs, renamed)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left, a null text as an empty one."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("secret scan", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "corpus-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
