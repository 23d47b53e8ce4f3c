"""The listing query: keyword scope, exactness, filters and order, as semi joins and one pre-aggregate."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soldlens.functions.text import clean_text

KEY = ["site", "item_id"]
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c):
    """Lower case for A-Z alone."""
    return F.translate(c, _UP, _LOW)


def keyword_scope(observations: DataFrame, searches: DataFrame, keywords_norm: str | None) -> DataFrame:
    """Observations of searches with these keywords; all of them for blank keywords."""
    if not keywords_norm or not keywords_norm.strip():
        return observations
    ids = searches.where(F.col("keywords_norm") == keywords_norm).select(F.col("id").alias("search_id"))
    return observations.join(ids, "search_id", "left_semi")


def in_scope(listings: DataFrame, observations: DataFrame, *, keyed: bool, exact_only: bool = True) -> DataFrame:
    """Keyed: listings seen in scope (matching, if exact_only). Unkeyed and exact: matched somewhere or never observed."""
    if keyed:
        seen = observations.where("matches_query") if exact_only else observations
        return listings.join(seen, KEY, "left_semi")
    if not exact_only:
        return listings
    matched = observations.groupBy(*KEY).agg(F.bool_or("matches_query").alias("__matched"))
    return listings.join(matched, KEY, "left").where(F.coalesce("__matched", F.lit(True))).drop("__matched")


def latest(observations: DataFrame) -> DataFrame:
    """Per listing: obs_match (any) and obs_position (of the latest observation, null if that has none)."""
    at = F.struct("observed_at", "id")
    return observations.groupBy(*KEY).agg(F.bool_or("matches_query").alias("obs_match"), F.max(F.struct(at.alias("at"), F.col("position").alias("p")))["p"].alias("obs_position"))


def filtered(listings: DataFrame, *, site=None, item_id=None, since: date | str | None = None, until: date | str | None = None, condition: str | None = None, currency: str | None = None, include_sponsored: bool = False, priced_only: bool = False) -> DataFrame:
    """Only the filters asked for become part of the plan, so that each may reach the scan."""
    out = listings
    if site:
        out = out.where(F.col("site") == site)
    if item_id is not None:
        out = out.where(F.col("item_id") == item_id)
    if priced_only:
        out = out.where(F.col("price").isNotNull())
    if since:
        out = out.where(F.col("sold_date") >= F.lit(str(since)).cast("date"))
    if until:
        out = out.where(F.col("sold_date") <= F.lit(str(until)).cast("date"))
    if condition:
        out = out.where(ascii_lower(F.col("condition")) == ascii_lower(clean_text(F.lit(condition))))
    if currency and currency.strip().upper() == "UNKNOWN":
        out = out.where(F.col("currency").isNull())
    elif currency:
        out = out.where(ascii_lower(F.col("currency")) == ascii_lower(F.lit(currency.strip())))
    if not include_sponsored:
        out = out.where(~F.col("sponsored"))
    return out


def newest_first(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest sale first, undated last, then last seen, then id."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    out = rows.orderBy(F.col("sold_date").desc_nulls_last(), F.col("last_seen_at").desc(), "item_id")
    return out if limit is None else out.limit(limit)


def query_listings(listings: DataFrame, observations: DataFrame, searches: DataFrame, keywords_norm: str | None = None, *, exact_matches_only: bool = True, limit: int | None = None, **filters) -> DataFrame:
    """Listings that fit, with matches_query, position and listing_format filled in."""
    keyed = bool(keywords_norm and keywords_norm.strip())
    scope = keyword_scope(observations, searches, keywords_norm)
    rows = in_scope(filtered(listings, **filters), scope, keyed=keyed, exact_only=exact_matches_only)
    rows = rows.join(latest(scope), KEY, "left").withColumn("matches_query", F.coalesce("obs_match", F.lit(True))).withColumnRenamed("obs_position", "position").drop("obs_match")
    if "listing_format" in rows.columns:
        rows = rows.withColumn("listing_format", F.coalesce("listing_format", F.lit("unknown")))
    return newest_first(rows, limit)


def resolve_alias(ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """ids (site, item_id) with aliases replaced by what they stand for."""
    named = aliases.select("site", F.col("alias_id").alias("item_id"), F.col("item_id").alias("__to"))
    return ids.join(named, KEY, "left").withColumn("item_id", F.coalesce("__to", "item_id")).drop("__to")
