"""Adapter views: the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priced_events(spark, sf_dir) -> DataFrame:
    """event_type as currency, value as price."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("currency"), F.col("value").alias("price"), F.lit(None).cast("double").alias("shipping"), F.to_date("ts").alias("sold_date"))


def sales(spark, sf_dir) -> DataFrame:
    """Line items as sales: l_returnflag as currency, tax as shipping that is unknown where 0."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"), F.col("l_returnflag").alias("currency"), F.col("l_extendedprice").alias("price"), (F.nullif("l_tax", F.lit(0.0)) * 100).alias("shipping"),
        F.to_date("l_shipdate").alias("sold_date"), F.col("l_returnflag").alias("condition"), (F.col("l_linestatus") == "F").alias("sponsored"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
    )


def readings(spark, sf_dir) -> DataFrame:
    """Repeated readings of a sale: rank by quantity, seq a total order within the key."""
    order = Window.partitionBy("item_id").orderBy("sold_date", "l_partkey", "l_suppkey", "l_quantity", "price")
    return sales(spark, sf_dir).withColumn("rank", (F.col("l_quantity") % 3).cast("int")).withColumn("seq", F.row_number().over(order).cast("long"))


def observations(spark, sf_dir) -> DataFrame:
    """Sales seen by searches for part names: matching where discounted, at their line number."""
    s = sales(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("keywords_norm"))
    return s.join(p, "l_partkey").select(F.lit("site").alias("site"), "item_id", "keywords_norm", F.col("keywords_norm").alias("search_id"), (F.col("l_discount") > 0.05).alias("matches_query"), F.col("l_linenumber").cast("long").alias("position"), "sold_date", "l_partkey", "l_suppkey", "l_quantity", "price")
