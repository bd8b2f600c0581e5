"""The driver's tables seen as a catalog, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` with the columns of a catalog; what the table doesn't have is derived from type and size."""
    p = table(spark, sf_dir, "part")
    m = F.col("p_size") % 10
    strings = lambda *x: F.array(*(F.lit(v) for v in x)) if x else F.array().cast("array<string>")
    kinds = {"PROMO": ("party", "eid"), "STANDARD": ("casual",), "ECONOMY": ("office", "casual"), "LARGE": ("wedding",), "SMALL": ()}
    occasion = F.lit(None).cast("array<string>")
    for kind, values in kinds.items():
        occasion = F.when(F.col("p_type") == kind, strings(*values)).otherwise(occasion)
    tone = color.infer("p_name")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
        F.when(m == 0, False).when(m == 1, None).otherwise(True).alias("in_stock"),
        F.when(F.col("p_size") % 4 == 0, "men").when(F.col("p_size") % 4 == 1, "kids").otherwise("women").alias("gender"),
        tone["primary"].alias("primary_color"),
        tone["colors"].alias("colors"),
        tone["shades"].alias("exact_colors"),
        occasion.alias("occasion"),
        F.lower("p_type").alias("dress_style"),
        F.when(F.col("p_size") % 5 == 0, "other").otherwise("suit").alias("sub_category"),
        F.when(F.col("p_size") % 3 == 0, "unstitched").otherwise("stitched").alias("stitching"),
        (F.col("p_size") % 3 + 1).alias("pieces"),
        F.element_at(F.split("p_name", " "), 2).alias("fabric"),
        F.when(F.col("p_size") % 2 == 0, "printed").otherwise("plain").alias("pattern"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"),
        F.lit(None).cast("string").alias("neckline"),
        F.when(F.col("p_size") % 7 == 0, None).otherwise(strings("summer")).alias("season"),
    )


SQL = """
products AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price,
    CASE WHEN p_size % 10 = 0 THEN false WHEN p_size % 10 = 1 THEN NULL ELSE true END AS in_stock,
    CASE p_size % 4 WHEN 0 THEN 'men' WHEN 1 THEN 'kids' ELSE 'women' END AS gender,
    CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'Red' WHEN 'blue' THEN 'Blue' ELSE 'Multicolor' END AS primary_color,
    CASE p_type WHEN 'PROMO' THEN ['party', 'eid'] WHEN 'STANDARD' THEN ['casual'] WHEN 'ECONOMY' THEN ['office', 'casual']
      WHEN 'LARGE' THEN ['wedding'] WHEN 'SMALL' THEN []::VARCHAR[] END AS occasion,
    lower(p_type) AS dress_style, CASE WHEN p_size % 5 = 0 THEN 'other' ELSE 'suit' END AS sub_category,
    CASE WHEN p_size % 3 = 0 THEN 'unstitched' ELSE 'stitched' END AS stitching, p_size % 3 + 1 AS pieces,
    split_part(p_name, ' ', 2) AS fabric, CASE WHEN p_size % 2 = 0 THEN 'printed' ELSE 'plain' END AS pattern,
    p_name || ' ' || p_type AS description, CASE WHEN p_size % 7 = 0 THEN NULL ELSE ['summer'] END AS season
  FROM part)"""
