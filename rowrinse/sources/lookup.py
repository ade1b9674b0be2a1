"""A list of keys as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowrinse.functions.text import strip
from rowrinse.operators.ordering import ORDER, with_order

# What separates keys in a list.
SEPARATORS = r"[\r\n,;\t]+"


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Read a key list from text files."""
    return lookup_keys(with_order(spark.read.text(path)))


def lookup_keys(lines: DataFrame) -> DataFrame:
    """Keys in lines of text (``value``, ordered by ``ORDER``), each with the place it is first seen at.

    Bytes that are not UTF-8 are left out, quotes around a key are taken off,
    empty keys are dropped.
    """
    text = F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))
    tokens = lines.select(ORDER, F.posexplode(F.split(text, SEPARATORS)).alias("place", "token"))
    bare = F.trim(F.trim(strip(F.col("token")), F.lit('"')), F.lit("'"))
    return (
        tokens.select(bare.alias("key"), F.struct(F.col(ORDER).alias("line"), "place").alias("seen"))
        .filter(F.col("key") != "")
        .groupBy("key")
        .agg(F.min("seen").alias("first_seen"))
    )
