"""Running a caller's model over a frame in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def score_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_size: int = 256) -> DataFrame:
    """Apply `fn` to pieces of at most `batch_size` rows; `fn` returns the columns of `schema`, ids included.

    Results carry ids, so their order does not matter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                yield fn(batch.iloc[start : start + batch_size])

    return df.mapInPandas(run, schema)


def unscored(inputs: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Inputs the model returned no row for: must be empty."""
    return inputs.select(key).join(scored.select(key), key, "left_anti")
