"""Text to vectors: a pluggable encoder, and an offline default."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from string import ascii_lowercase

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx

BATCH = 256
HASH_DIM = 256


def embed(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]],
          out: str = "embedding", batch: int = BATCH, scale: bool = True) -> DataFrame:
    """Adds vectors from an encoder, of unit length unless ``scale`` is off.

    ``load`` runs once per task and returns the encoder, which maps a list of texts to a
    matrix with one row per text.
    """
    @F.pandas_udf("array<float>")
    def encode(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for chunk in chunks:
            texts = chunk.fillna("").tolist()
            rows: list[np.ndarray] = []
            for at in range(0, len(texts), batch):
                block = np.asarray(encoder(texts[at:at + batch]), dtype="float32")
                if scale:
                    length = np.linalg.norm(block, axis=1, keepdims=True)
                    block = block / np.where(length > 0, length, 1.0)
                rows.extend(block)
            yield pd.Series(rows)

    return df.withColumn(out, encode(F.col(text)))


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often each letter from a to z occurs: an encoder without a model file, and exact."""
    return np.array([[t.count(c) for c in ascii_lowercase] for t in texts], dtype="float32").reshape(-1, 26)


class HashedTfidf:
    """Words hashed to a fixed number of dimensions, weighted by idf; no model file needed.

    ``fit`` keeps one number per dimension.
    """

    def __init__(self, dim: int = HASH_DIM):
        self._count = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf")
        self._idf = None

    def _counted(self, df: DataFrame, text: str) -> DataFrame:
        return self._count.transform(df.withColumn("_words", tx.tokens(tx.clean(F.col(text)))))

    def fit(self, df: DataFrame, text: str) -> HashedTfidf:
        self._idf = IDF(inputCol="_tf", outputCol="_weighted").fit(self._counted(df, text))
        return self

    def transform(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        scale = Normalizer(p=2.0, inputCol="_weighted", outputCol="_unit")
        rows = scale.transform(self._idf.transform(self._counted(df, text)))
        return rows.withColumn(out, vector_to_array("_unit", "float32")).drop(
            "_words", "_tf", "_weighted", "_unit")
