"""Payloads without a fixed shape as VARIANT: fields that are a scalar in one record and an array in the next, texts that don't parse, and what shapes there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_variant(rows: DataFrame, text: str, name: str = "v") -> DataFrame:
    """The rows with the text as a variant; null where it doesn't parse."""
    return rows.withColumn(name, F.try_parse_json(F.col(text)))


def malformed(text: str, v: str = "v") -> Column:
    """Whether there is a text that doesn't parse."""
    return F.col(text).isNotNull() & F.col(v).isNull()


def first_of(v: str, path: str, kind: str) -> Column:
    """A field that is a value or an array of values: the value, or the first of the array; null if it is missing or of another kind."""
    return F.coalesce(F.try_variant_get(F.col(v), f"$.{path}[0]", kind), F.try_variant_get(F.col(v), f"$.{path}", kind))


def all_of(v: str, path: str, kind: str) -> Column:
    """All values of such a field, as an array; empty if it is missing."""
    one = F.try_variant_get(F.col(v), f"$.{path}", kind)
    many = F.try_variant_get(F.col(v), f"$.{path}", f"array<{kind}>")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast(f"array<{kind}>"))


def first_present(v: str, kind: str, *paths: str) -> Column:
    """The first of several fields that is there: a chain of fallbacks."""
    return F.coalesce(*[first_of(v, p, kind) for p in paths])


def shapes(rows: DataFrame, by: str, text: str) -> DataFrame:
    """by, payloads, malformed, shape: how many payloads of each kind there are, how many don't parse, and the one schema that fits the others."""
    own = with_variant(rows.select(by, text), text)
    return own.groupBy(by).agg(F.count(text).alias("payloads"), F.count_if(malformed(text)).alias("malformed"), F.schema_of_variant_agg("v").alias("shape"))
