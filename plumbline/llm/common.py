"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_folder

#: ASCII white space, the separators of words throughout these operators.
SPACES = r"[\x20\x09-\x0D]+"
#: Bits of the fixed-size filter that spares most texts a shuffle: 2 ** FILTER_WORDS words of 64.
FILTER_WORDS = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: what follows survives a lost executor by rereading the files, and no plan below
    is run twice.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text, split at ASCII white space; empty for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def _bit(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 40), F.lit(64)).cast("int")


def key_filter(keys: DataFrame) -> Column:
    """A filter of fixed size over the column ``key`` as one value, to be asked by ``maybe_in``; true for every key in it."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("key")))
    words = keys.select(F.pmod("key", F.lit(1 << FILTER_WORDS)).alias("at"), bit.alias("bit"))
    held = words.groupBy("at").agg(F.bit_or("bit").alias("word"))
    spark = keys.sparkSession
    every = spark.range(1 << FILTER_WORDS).join(held, F.col("id") == F.col("at"), "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    lists = every.agg(F.sort_array(F.collect_list(F.struct("id", "word"))).alias("words"))
    return lists.select(F.col("words.word").alias("words")).scalar()


def maybe_in(bits: Column, key: Column) -> Column:
    word = F.get(bits, F.pmod(key, F.lit(1 << FILTER_WORDS)).cast("int"))
    return F.call_function("shiftright", word, _bit(key)).bitwiseAND(F.lit(1)) == 1
