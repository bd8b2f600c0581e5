"""Folds in a given order within each key, as a stream: a task holds one key's state, never its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, keys: list[str], order: list[str | Column], uses: list[str], new: str, begin: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]]) -> DataFrame:
    """All columns, with those of the schema `new`. step(state, (values of `uses`)) gives the next state and the new values; begin() gives each
    key's first state. Rows are dealt by key and sorted; where one key ends and the next begins is seen in the stream. Null keys are one key."""
    names = [f.split()[0] for f in new.split(", ")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in names]
    rest = [c for c in df.columns if c not in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = begin  # no key equals this
        state: object = None
        for pdf in batches:
            made = []
            key_rows = zip(*(pdf[k].tolist() for k in keys), strict=True)
            for key, values in zip(key_rows, zip(*(pdf[c].tolist() for c in uses), strict=True), strict=True):
                key = tuple(None if k != k else k for k in key)
                if key != now:
                    now, state = key, begin()
                state, out = step(state, values)
                made.append(out)
            yield pdf[rest].assign(**{n: [m[i] for m in made] for i, n in enumerate(names)})

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, ", ".join([*fields, new]))
