"""Search and store reports, evaluation, costs, positions and stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soldlens.functions.text import fold_quotes
from soldlens.operators.geometry import image_tokens


def searches_report(searches: DataFrame, pages: DataFrame, observations: DataFrame) -> DataFrame:
    """Per search: pages, total_results, distinct listings and exact matches, zero where none."""
    by_page = pages.groupBy("search_id").agg(F.count(F.lit(1)).alias("pages"), F.max("total_results").alias("total_results"))
    item = F.struct("site", "item_id")
    by_item = observations.groupBy("search_id").agg(F.count_distinct(item).alias("listings"), F.count_distinct(F.when(F.col("matches_query"), item)).alias("exact_matches"))
    out = searches.withColumnRenamed("id", "search_id").join(by_page, "search_id", "left").join(by_item, "search_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pages", "listings", "exact_matches")})


def summary(listings: DataFrame) -> DataFrame:
    """One row: counts, and the range of sold dates."""
    return listings.agg(
        F.count(F.lit(1)).alias("listings"),
        F.count("price").alias("priced"),
        F.count_if("has_real_id").alias("with_real_id"),
        F.count_if("sponsored").alias("sponsored"),
        F.count_distinct("site").alias("sites"),
        F.min("sold_date").alias("first_sold"),
        F.max("sold_date").alias("last_sold"),
    )


def counts_by(listings: DataFrame, column: str) -> DataFrame:
    return listings.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def positions(cards: DataFrame, page: str, order: str) -> DataFrame:
    """1-based position in page order, and matches_query: no divider before it."""
    w = Window.partitionBy(page).orderBy(order)
    divided = F.max(F.col("is_divider").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = cards.withColumn("matches_query", divided == 0).where(~F.col("is_divider"))
    return rows.withColumn("position", F.row_number().over(w).cast("long"))


def kept_pages(pages: DataFrame) -> DataFrame:
    """Pages up to the first that has no listings, reaches loose matches or is the last; pages: search_id, page, listings, loose, has_next."""
    stop = (F.col("listings") == 0) | (F.col("loose") > 0) | (~F.coalesce("has_next", F.lit(True)))
    before = Window.partitionBy("search_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("__stopped", F.coalesce(F.max(stop.cast("int")).over(before), F.lit(0))).where("__stopped = 0").drop("__stopped")


def field_accuracy(pairs: DataFrame) -> DataFrame:
    """pairs: field, expected, predicted. Per field: total, correct, missing and accuracy (null if nothing was expected)."""
    given = F.col("expected").isNotNull()
    right = given & (fold_quotes(F.col("expected")) == fold_quotes(F.col("predicted")))
    out = pairs.groupBy("field").agg(F.count_if(given).alias("total"), F.count_if(right).alias("correct"), F.count_if(given & F.col("predicted").isNull()).alias("missing"))
    return out.withColumn("accuracy", F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total"), 4)))


def confidence(fields: Column, card: Column, no_price: Column, no_title: Column) -> Column:
    """Mean field confidence times the card's, halved without a price, times 0.7 without a title, within 0..1."""
    values = F.map_values(fields)
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(values), F.lit(1))
    out = mean * card * F.when(no_price, 0.5).otherwise(1.0) * F.when(no_title, 0.7).otherwise(1.0)
    return F.round(F.greatest(F.least(out, F.lit(1.0)), F.lit(0.0)), 3)


def cost_estimate(slices: DataFrame, prompt_tokens: int, output_tokens: int, usd_in: float | None, usd_out: float | None) -> DataFrame:
    """slices (w, h): requests, tokens in and out, and dollars (null for a model without a price)."""
    out = slices.agg(F.count(F.lit(1)).alias("requests"), F.sum(image_tokens(F.col("w"), F.col("h")) + prompt_tokens).alias("input_tokens"), (F.count(F.lit(1)) * output_tokens).alias("output_tokens"))
    usd = F.lit(None).cast("double") if usd_in is None or usd_out is None else F.round((F.col("input_tokens") * usd_in + F.col("output_tokens") * usd_out) / 1e6, 4)
    return out.withColumn("usd", usd)


def search_pages(searches: DataFrame, pages: int) -> DataFrame:
    """Every search with every page number."""
    return searches.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))


def card_report(cards: DataFrame) -> DataFrame:
    """cards: side ("both", "expected" or "predicted") and similarity (of titles, where both): precision, recall, mean similarity, share of 0.9 and over.

    A ratio without anything to count is null.
    """
    n = lambda *sides: F.count_if(F.col("side").isin(*sides))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 4)
    near = F.count_if((F.col("side") == "both") & (F.col("similarity") >= 0.9))
    return cards.agg(ratio(n("both"), n("both", "predicted")).alias("precision"), ratio(n("both"), n("both", "expected")).alias("recall"), F.round(F.avg(F.when(F.col("side") == "both", F.col("similarity"))), 4).alias("mean_similarity"), ratio(near, n("both")).alias("share_near"))


def usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """calls (tokens_in, tokens_out, cached): requests and token sums per keys; what a call does not say counts as none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), total("tokens_in"), total("tokens_out"), total("cached"))
