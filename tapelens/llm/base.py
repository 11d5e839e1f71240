"""Shared column helpers of the corpus operators."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words; everything else belongs to a word.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def word_list(text: Column) -> Column:
    """All words of a text in order; none for an empty text."""
    return F.array_remove(F.split(text, BLANKS, -1), "")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def select_over(docs: DataFrame, keep: Sequence[str], **made: Column) -> DataFrame:
    """Only `keep` and the made columns, so that extra columns of the input cannot clash."""
    return docs.select(*keep, *[value.alias(name) for name, value in made.items()])


def bits_of(flags: Sequence[Column]) -> Column:
    """A long with bit i set where flag i is true; a null flag counts as false."""
    parts = [F.when(flag, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
             for i, flag in enumerate(flags)]
    return functools.reduce(lambda a, b: a.bitwiseOR(b), parts)
