"""Ordered folds: what depends on the order of a key's rows in a way that no window frame expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string


def folded(df: DataFrame, by: list[str], order: list[str], start: Callable[[Any], Any], step: Callable[[Any, Any], tuple[Any, tuple]], schema: str) -> DataFrame:
    """Runs each key's rows in order through step(state, row) -> (state, result row); start(key) gives the first state.

    Rows come sorted and are streamed, so a task holds one state at a time, however many rows a key has.
    """
    names = [f.name for f in _parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for values in zip(*(batch[c].tolist() for c in batch), strict=True):
                row = dict(zip(batch.columns, values, strict=True))
                now = tuple(row[c] for c in by)
                if now != key:
                    key, state = now, start(now)
                state, result = step(state, row)
                out.append(result)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
