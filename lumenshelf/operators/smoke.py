"""Smoke checks of searches: each search's results are looked at in the pass that fetches them, by observed metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PROBLEM = "search string, problem string, detail string, results long"


class Search:
    """Results in order, with `position` from 1, `in_stock` and `catalog`; expected: the catalog of the first one, None for any."""

    def __init__(self, name: str, results: DataFrame, expected: str | None = None, position: str = "position", stock: str = "in_stock", catalog: str = "catalog"):
        self.name, self.expected = name, expected
        self.metrics = Observation(f"smoke-{uuid.uuid4().hex}")
        sold_out = F.count_if(F.col(stock).eqNullSafe(F.lit(False)))
        self.results = results.observe(self.metrics, F.count(F.lit(1)).alias("n"), sold_out.alias("sold_out"), F.min_by(catalog, position).alias("top"))

    def problems(self) -> list[tuple[str, str, str, int]]:
        """To be asked once the results have been fetched."""
        got = self.metrics.get
        n, found = got["n"], []
        if not n:
            return [(self.name, "no results", "", 0)]
        if got["sold_out"]:
            found.append((self.name, "sold out", f"{got['sold_out']} returned", n))
        if self.expected and got["top"] != self.expected:
            found.append((self.name, "wrong catalog", f"{got['top']} instead of {self.expected}", n))
        return found


def check(spark: SparkSession, searches: list[Search], keep: str | None = None) -> DataFrame:
    """(PROBLEM) What is wrong with the searches; no rows if nothing is. The results are fetched once, to the folder `keep` if they are
    wanted; the metrics come from that pass."""
    for i, s in enumerate(searches):
        if keep:
            s.results.write.mode("overwrite").parquet(f"{keep}/{i}")
        else:
            s.results.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([p for s in searches for p in s.problems()], PROBLEM)
