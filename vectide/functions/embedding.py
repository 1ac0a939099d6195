"""Embedding functions: the caller's model, run over text columns on the executors."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class EmbeddingFunction(ABC):
    """Implement embed(); instances must pickle, since executors get a copy each."""

    @abstractmethod
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        """One vector for each text."""

    def column(self, text: Column, batch: int = 256) -> Column:
        """Vectors of a text column, embedded `batch` texts at a time; NULL for NULL."""
        own = self

        @F.pandas_udf("array<float>")
        def run(values: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(values), index=values.index, dtype=object)
            present = values[values.notna()]
            for lo in range(0, len(present), batch):
                part = present.iloc[lo : lo + batch]
                for at, vector in zip(part.index, own.embed(part.tolist())):
                    out.at[at] = [float(x) for x in vector]
            return out

        return run(text)
