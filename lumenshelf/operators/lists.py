"""Short lists that stand for long ones."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 50_000  # rows that are thinned at once, or more


def first_under_any_price(rows: DataFrame, key: str, rank: str, price: str, k: int) -> DataFrame:
    """(key, rank, price): the rows that are, for some price limit, among the first k by rank of the rows of their key within the limit. A
    row without a price is among them only without a limit. One pass over each partition as it comes, whose rows so far are thinned
    whenever they have doubled, by the k lowest prices of each key in order of rank; then one over what is left of each key: the
    first pass leaves about k * ln(rows / k) rows a key and partition. Nothing is sorted as a whole."""

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank, kind="stable")
        lowest: dict[object, list[float]] = {}
        keep = []
        prices = pdf[price].fillna(float("inf")).to_numpy()
        for i, (name, p) in enumerate(zip(pdf[key].tolist(), prices.tolist(), strict=True)):
            heap = lowest.setdefault(name, [])
            if len(heap) < k:
                heapq.heappush(heap, -p)
                keep.append(i)
            elif p < -heap[0]:
                heapq.heapreplace(heap, -p)
                keep.append(i)
        return pdf.iloc[keep]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n, limit = 0, LEAST
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= limit:
                held = [thin(pd.concat(held))]
                n = len(held[0])
                limit = max(LEAST, 2 * n)
        if held:
            yield thin(pd.concat(held))

    narrow = rows.select(key, rank, F.col(price).cast("double").alias(price))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema)
    return narrow.mapInPandas(fold, schema).repartition(key).mapInPandas(fold, schema)
