"""Ordered folds for results that depend on row order: one pass over sorted partitions, state carried from row to row.

A group is never gathered; its rows stream by, sorted, so a long one costs time but no memory. A hot key's rows still pass
one after the other, which is what such a fold means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tesserae.ship import ship

Step = Callable[[dict | None, dict], tuple[dict | None, dict]]


def folded(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """For every row the output of step(state, row), where state is None at a key's first row. order must be total within a key."""
    ship(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            out = []
            for row in zip(*(b[c].tolist() for c in names)):
                r = dict(zip(names, row))
                k = tuple(r[c] for c in keys)
                if k != key:
                    key, state = k, None
                state, o = step(state, r)
                out.append(o)
            if out:
                yield pd.DataFrame(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
