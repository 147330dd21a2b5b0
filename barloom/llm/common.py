"""Small expression helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the text contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once per row however often the body names it.

    A column that is only projected before may be inlined by the optimizer into a lambda and then be computed again for
    every element; the variable of a one-element ``transform`` cannot.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column, separators: str = SPACE) -> Column:
    """The words between separators, without the empty strings at both ends; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def indices(size: Column) -> Column:
    """0 .. size - 1, empty for sizes below one (``sequence`` would count down)."""
    return F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def lower_ascii(text: Column) -> Column:
    """Lower case for matching ASCII words: the Kelvin sign is the one other letter whose lower case is ASCII."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("å")))


def packed(docs: DataFrame) -> Column:
    """A document's columns as one struct, so that no extra column can clash with an operator's own names."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns])
