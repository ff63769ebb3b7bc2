"""Vectors: cosine similarity and text embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank_to_null, squash


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def bind(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), result), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero or null vector or different lengths, never NaN."""
    value = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.when((F.size(a) == F.size(b)) & ~F.isnan(value), value)


def offer_text(title: Column, category: Column, store: Column) -> Column:
    """The text that an offer's embedding stands for."""
    return blank_to_null(squash(F.concat_ws(" ", title, category, store)))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Unit vector of hashed word counts; null for a blank text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of(place: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(place, lambda p: p == k)).cast("double"))
        return bind(counts, lambda c: bind(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)), lambda length: F.transform(c, lambda x: (x / length).cast("float"))))

    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    return F.when(F.size(words) > 0, bind(places, of))


def embed_missing(df: DataFrame, text: Column, vector: str = "embedding", embedder=hashed_embedding) -> DataFrame:
    """``df`` with the vector computed where it is null and the text is not blank."""
    return df.withColumn(vector, F.coalesce(F.col(vector), embedder(text)))
