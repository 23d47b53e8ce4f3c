"""The store's life: saved pages become facts, and listings and observations are derived from all facts and published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soldlens.functions import text, urls
from soldlens.operators import identity, listing, merge
from soldlens.sources import cards, pages, transcribed
from soldlens.sources.shared import written
from soldlens.sources.store import Store


def import_pages(spark: SparkSession, store: Store, path: str, keywords: str | None = None, site: str = urls.DEFAULT_SITE) -> DataFrame:
    """Reads saved pages into readings and searches, publishes listings and observations; one row per page read.

    A page's search is the keywords given, or its own, or its file's stem; its number is its place within the search. A
    page imported again adds readings that change nothing.
    """
    site = urls.normalize_site(site)
    files = pages.read_pages(spark, path)
    stem = F.regexp_extract("path", r"([^/]+?)\.html(?:\.gz)?$", 1)
    named = F.lit(keywords).cast("string") if keywords else F.coalesce(pages.guess_keywords(F.col("html")), stem)
    numbered = pages.number_pages(files.withColumn("keywords", named)).drop("search_id")
    parsed = cards.read_cards(numbered, key="path", site=site)
    facts = numbered.drop("html").withColumnRenamed("fetched_at", "seen_at")
    found = cards.listings(parsed, key="path", site=site).join(facts.select("path", "keywords_norm", "page", "seen_at"), "path")
    found = _identified(found)
    store.append("readings", found.withColumn("confidence", F.lit(None).cast("double")))
    report = parsed.join(facts, "path").select("path", "keywords", "keywords_norm", "page", "seen_at", "layout", "total_results", "has_next_page", F.size("cards").cast("long").alias("listings"), "exact_match_count")
    store.append("pages", report)
    publish(store)
    return report


def import_transcripts(spark: SparkSession, store: Store, answers: DataFrame, site: str = urls.DEFAULT_SITE) -> DataFrame:
    """Transcribed pages into readings, then publishes; the readings.

    answers: path, keywords, page, seen_at, answer (a JSON array of entries, see `transcribed.entries`), one row per path.
    """
    facts = answers.select("path", text.normalize_keywords(F.col("keywords")).alias("keywords_norm"), F.col("page").cast("long").alias("page"), "seen_at")
    found = transcribed.listings(transcribed.entries(answers.select("path", "answer")), page="path", site=site).join(facts, "path")
    found = written(_identified(found).withColumn("confidence", F.lit(None).cast("double")), "transcribed")
    store.append("readings", found)
    publish(store)
    return found


def _identified(found: DataFrame) -> DataFrame:
    """Readings with their titles' matching form; one that shows no id gets a synthetic one."""
    norm = text.normalize_title(F.col("title"))
    own = F.coalesce("item_id", text.synthetic_id(F.col("site"), norm, F.col("price"), F.col("sold_date")))
    return found.withColumn("title_norm", norm).withColumn("has_real_id", F.col("item_id").isNotNull()).withColumn("item_id", own)


def _aliases(merged: DataFrame) -> DataFrame:
    """site, alias_id, item_id: synthetic rows that are absorbed, and the rows that they end in."""
    name = F.concat_ws("@", "item_id", "site")  # an id may be on two sites
    rows = merged.select(name.alias("item_id"), "site", text.normalize_title(F.col("title")).alias("title_norm"), "price", "sold_date")
    part = lambda c, i: F.split(c, "@")[i]
    _, ends = identity.absorb(rows)
    return written(ends.select(part("rid", 1).alias("site"), part("rid", 0).alias("alias_id"), part("item_id", 0).alias("item_id")), "aliases")


def _moved(readings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Readings of absorbed rows under the absorbing row's id; `own` says which were that row's before."""
    ends = aliases.select("site", F.col("alias_id").alias("item_id"), F.col("item_id").alias("__to"))
    moved = readings.join(ends, listing.KEY, "left").withColumn("own", F.col("__to").isNull())
    return moved.withColumn("item_id", F.coalesce("__to", "item_id")).drop("__to")


def publish(store: Store) -> None:
    """Derives listings, aliases and observations from all readings: the result depends on the facts alone, not on their order.

    A reading without an id whose synthetic row has one best fit among the other rows is a reading of that sale: under equal
    ranks the sale's own readings stand, and its own observation does where both were seen on one page.
    """
    readings = store.facts("readings").dropDuplicates(["keywords_norm", "site", "item_id", "page", "position", "extraction", "seen_at"])
    clean = merge.blank_to_null(readings.withColumn("rank", merge.rank_of(F.col("extraction"))))
    at_seen = F.struct("seen_at", "path", "page", "position")
    merged = written(merge.precedence_merge(clean.withColumn("seq", at_seen), listing.KEY, merge.MERGED_FIELDS, "title_norm"), "merged")
    lone = text.is_synthetic(F.col("item_id")) & (F.col("price").isNotNull() | F.col("sold_date").isNotNull())
    if merged.where(lone).isEmpty():
        aliases = store.spark.createDataFrame([], "site string, alias_id string, item_id string")
    else:
        aliases = _aliases(merged)
    if aliases.isEmpty():
        rows, clean = merged, clean.withColumn("own", F.lit(True))
    else:
        clean = _moved(clean, aliases)
        rows = merge.precedence_merge(clean.withColumn("seq", F.struct("own", at_seen.alias("at"))), listing.KEY, merge.MERGED_FIELDS, "title_norm")
    clean = clean.withColumn("seq", F.struct("own", at_seen.alias("at")))
    rows = rows.withColumn("has_real_id", ~text.is_synthetic(F.col("item_id"))).withColumn("total_price", F.round(F.col("price") + F.col("shipping"), 2))
    store.publish("listings", rows)
    store.publish("aliases", aliases)
    own_first = clean.withColumn("rank", F.col("rank") + F.when(F.col("own"), len(merge.RANKS)).otherwise(0))
    seen = merge.upsert_observations(own_first, ["keywords_norm", *listing.KEY, "page"])
    at = clean.groupBy("keywords_norm", *listing.KEY, "page").agg(F.max("seen_at").alias("observed_at"))
    seen = seen.join(at, ["keywords_norm", *listing.KEY, "page"])
    store.publish("observations", seen.select(F.col("keywords_norm").alias("search_id"), *listing.KEY, "page", "position", "matches_query", "observed_at", F.struct("keywords_norm", "page").alias("id")))


def query(store: Store, keywords: str | None = None, **options) -> DataFrame:
    """The listing query over the current snapshots; a search's id is its keywords in their normal form."""
    observations = store.current("observations")
    norm = store.spark.range(1).select(text.normalize_keywords(F.lit(keywords or ""))).first()[0] or None  # as pages were stored
    searches = observations.select(F.col("search_id").alias("id"), F.col("search_id").alias("keywords_norm")).distinct()
    return listing.query_listings(store.current("listings"), observations, searches, norm, **options)
