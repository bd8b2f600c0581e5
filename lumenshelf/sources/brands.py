"""Brands and their collections as a stored dimension, and listings kept by brand.

The dimension has a row for each collection (brand, base_url, category, path, ...); it is small and stored as one table. Listings lie
in a folder for each brand, so a run over some brands reads only these: the dimension's filter reaches the listings' partitions
through the join, while the query runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = "brand string, base_url string, adapter string, category string, collections array<struct<path: string, sub_category: string, occasion: array<string>, style: array<string>, gender: string>>"
PART = "brand_key"


def brand_key(brand: str | Column) -> Column:
    """The name of a brand's folder: without regard to case and outer blanks."""
    return F.lower(F.trim(F.col(brand) if isinstance(brand, str) else brand))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A row for each collection of each brand, from JSON (an array of brands, or one a line)."""
    return collections(spark.read.schema(CONFIG).json(path, multiLine=True))


def collections(config: DataFrame) -> DataFrame:
    """config: rows of CONFIG. Adds the collection's address and the brand's key; brands without collections keep a row."""
    flat = config.select("brand", brand_key("brand").alias(PART), F.rtrim(F.col("base_url"), F.lit("/")).alias("base_url"), "adapter", "category", F.explode_outer("collections").alias("c"))
    return flat.select("brand", PART, "base_url", "adapter", "category", "c.*", F.concat("base_url", "c.path").alias("url"))


def parse_only(text: str | None) -> list[str]:
    """`Alder, Birch B` -> the keys of these brands; empty: no limit."""
    return [b for b in (x.strip().lower() for x in (text or "").split(",")) if b]


def allowed(only: list[str], brand: str | Column = "brand") -> Column:
    return brand_key(brand).isin(only) if only else F.lit(True)


def store_dimension(dimension: DataFrame, folder: str) -> None:
    dimension.coalesce(1).write.mode("overwrite").parquet(folder)


def store_listings(listings: DataFrame, folder: str, brand: str = "brand") -> None:
    """Listings by brand; each brand's rows are dealt to a few tasks, so that a large brand isn't written by one."""
    keyed = listings.withColumn(PART, brand_key(brand))
    keyed.repartition(PART, F.pmod(F.xxhash64(*listings.columns), F.lit(4))).write.mode("overwrite").partitionBy(PART).parquet(folder)


def run(spark: SparkSession, listings: str, dimension: str, only: str | None = None, category: str | None = None) -> DataFrame:
    """Listings of the brands that a run covers, with what their collections say (a row for each collection of the listing's category).
    Only the folders of these brands are read."""
    brands = spark.read.parquet(dimension)
    keys = parse_only(only)
    if keys:
        brands = brands.where(F.col(PART).isin(keys))
    if category:
        brands = brands.where(F.col("category") == category)
    rows = spark.read.parquet(listings)
    return rows.join(brands.drop("brand"), PART)
