"""Embeddings: input texts, encoders, normalisation and checks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 384
Encoder = Callable[[list[str]], np.ndarray]


def embedding_input(filename: str = "filename", kind: str = "document_type", topic: str = "topic", section: str = "section", heading: str = "heading", chunk: str = "chunk_type", text: str = "text") -> Column:
    """What is embedded: the known fields of a chunk before its text. Unknown ones drop out."""
    named = F.concat(F.lit("Document: "), F.col(filename), F.coalesce(F.concat(F.lit(" ("), F.col(kind), F.lit(")")), F.lit("")))
    parts = [named, *[F.concat(F.lit(f"{label}: "), F.col(c)) for label, c in (("Topic", topic), ("Section", section), ("Heading", heading), ("Type", chunk))]]
    head = F.concat_ws(" | ", *parts)
    return F.when(head != "", F.concat(head, F.lit("\n\n"), F.col(text))).otherwise(F.col(text))


def hash_encoder(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Signed feature hashing of words, unit length: needs no model and gives the same vectors everywhere."""
    out = np.zeros((len(texts), dimension))
    memo: dict[str, tuple[int, int]] = {}
    for row, text in zip(out, texts, strict=True):
        for word in re.findall(r"\w+", text.lower()):
            if word not in memo:
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                memo[word] = (h % dimension, 1 if h >> 63 else -1)
            at, sign = memo[word]
            row[at] += sign
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, column: str, encoder: Encoder = hash_encoder, batch: int = 100, out: str = "embedding") -> DataFrame:
    """df with the vector of `column`; the encoder is called for `batch` texts at a time."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = texts.fillna("").tolist()
            parts = [encoder(rows[i : i + batch]).astype("float32") for i in range(0, len(rows), batch)]
            yield pd.Series([v for p in parts for v in p])

    return df.withColumn(out, encode(F.col(column).cast("string")))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """The vector at unit length; one of zeros stays."""
    # The norm is bound once, not evaluated for each element.
    scaled = F.transform(F.array(norm(vector)), lambda s: F.transform(vector, lambda x: F.when(s == 0, x.cast("double")).otherwise(x.cast("double") / s)))
    return F.get(scaled, F.lit(0))


def dimension_check(df: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    return df.groupBy(F.size(vector).cast("bigint").alias("dimension")).agg(F.count("*").alias("rows")).withColumn("fits", F.col("dimension") == dimension)
