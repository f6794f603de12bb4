"""Deterministic load-test entities of any number, made where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CATEGORIES = ("sports", "politics", "science", "culture", "business")


def articles(spark: SparkSession, n: int = 400_000, authors: int = 50_000) -> DataFrame:
    """Articles with categories in turn, two tenants in turn, every hundredth owned by one known user."""
    rows = spark.range(n)
    pick = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("id") % len(CATEGORIES) + 1).cast("int"))
    return rows.select(
        F.col("id").cast("string").alias("Id"), F.concat(F.lit("Article "), F.col("id")).alias("Title"), F.repeat(F.concat(F.lit("body of "), F.col("id"), F.lit(" ")), 20).alias("Body"),
        (F.col("id") % authors).cast("string").alias("AuthorId"), pick.alias("Category"), (F.col("id") * 37 % 2000).cast("int").alias("WordCount"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 61).alias("PublishedAt"),
        F.when(F.col("id") % 100 == 0, "known-user").otherwise(F.concat(F.lit("user-"), F.col("id") % 1000)).alias("OwnerId"),
        F.concat(F.lit("tenant-"), F.col("id") % 2).alias("TenantId"),
    )


def authors(spark: SparkSession, n: int = 50_000) -> DataFrame:
    rows = spark.range(n)
    owner = F.when(F.col("id") % 100 == 0, "known-user").otherwise(F.concat(F.lit("user-"), F.col("id") % 1000))
    return rows.select(
        F.col("id").cast("string").alias("Id"), F.concat(F.lit("Author "), F.col("id")).alias("Name"), F.concat(F.lit("a"), F.col("id"), F.lit("@example.com")).alias("Email"),
        owner.alias("OwnerId"), F.concat(F.lit("tenant-"), F.col("id") % 2).alias("TenantId"),
    )


def tags(spark: SparkSession, n: int = 10_000) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("string").alias("Id"), F.concat(F.lit("tag-"), F.col("id")).alias("Name"), F.concat(F.lit("tenant-"), F.col("id") % 2).alias("TenantId"))
